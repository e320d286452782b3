"""Clusters of identities that keep confirmed names apart and keep their numbers from run to run.

Nulls: a region without a cluster (null or below zero) gets none; a null or empty name is no confirmed one; a null old
number is none. Ties go to the smaller key, name or number. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.operators.ranges import numbered
from quaymark.sources.shared import stored


def split_by_names(regions: DataFrame) -> DataFrame:
    """``key, cluster, part, old``: a cluster of several confirmed names is cut into a part for each.

    Members without a name go with the name that most have; ``part`` is null where a cluster is whole.
    """
    named = F.nullif("name", F.lit(""))
    members = regions.where("cluster >= 0").select("key", "cluster", named.alias("name"), "old")
    counts = members.where("name IS NOT NULL").groupBy("cluster", "name").agg(F.count("*").alias("n"))
    leading = counts.groupBy("cluster").agg(F.count("*").alias("names"), F.min(F.struct((-F.col("n")).alias("less"), "name")).alias("most"))
    torn = leading.where("names > 1").select("cluster", F.col("most.name").alias("most"))
    return members.join(torn, "cluster", "left").select("key", "cluster", F.when(F.col("most").isNotNull(), F.coalesce("name", "most")).alias("part"), "old")


def inherited(parts: DataFrame) -> DataFrame:
    """``key, number``: each cluster takes the old number that most of its members had.

    The largest cluster claims first; a cluster whose number is taken, or whose members had none, gets a new one above all old
    ones, in the same order. A cluster claims one number only, so the claims are settled number by number.
    """
    own = ["cluster", "part"]
    votes = parts.groupBy(*own, F.when(F.col("old") >= 0, F.col("old")).alias("old")).agg(F.count("*").alias("n"), F.min("key").alias("first"))
    clusters = votes.groupBy(*own).agg(
        F.sum("n").alias("size"), F.min("first").alias("first"), F.min(F.when(F.col("old").isNotNull(), F.struct((-F.col("n")).alias("less"), "old"))).alias("vote")
    )
    clusters = stored(clusters.select(*own, "size", "first", F.col("vote.old").alias("wish")), "identity-clusters")
    # the best claim on each number, by partial aggregates
    best = clusters.where("wish IS NOT NULL").groupBy("wish").agg(F.min(F.struct((-F.col("size")).alias("less"), "first")).alias("best"))
    won = clusters.join(best, "wish", "left").withColumn("won", F.coalesce((F.col("best.first") == F.col("first")), F.lit(False)))
    kept = won.where("won").select(*own, F.col("wish").alias("number"))
    top = parts.agg((F.greatest(F.coalesce(F.max("old"), F.lit(-1)), F.lit(-1)) + 1).alias("next"))
    fresh = numbered(won.where("NOT won").select(*own, (-F.col("size")).alias("less"), "first"), [], ["less", "first"])
    fresh = fresh.join(F.broadcast(top)).select(*own, (F.col("next") + F.col("position")).alias("number"))  # one row
    numbers = kept.unionByName(fresh)
    same = (parts["cluster"] == numbers["cluster"]) & parts["part"].eqNullSafe(numbers["part"])
    return parts.join(numbers, same).select("key", "number")


def recluster(regions: DataFrame) -> DataFrame:
    """``key, number`` of regions (key, cluster, name, old); -1 for those in no cluster."""
    found = inherited(stored(split_by_names(regions), "identity-parts"))
    return regions.select("key").join(found, "key", "left").select("key", F.coalesce("number", F.lit(-1)).alias("number"))
