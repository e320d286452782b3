"""Bursts: what is alike, lies together and was shot in quick succession."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark.operators.graph import connected_components
from quaymark.sources.shared import stored


def bursts(members: DataFrame, max_drift: float, least: float) -> DataFrame:
    """``member, part, burst, place, cover`` of similar groups cut three times.

    ``members``: grp, member, is_reference, score, folder, albums, epoch. First go members without a time and those less similar to their
    reference than ``least``. Then what shares no folder and no album, by chains, comes apart: a folder links its members to
    its first one, so that links are as many as members and tags. Last, a gap of more than ``max_drift`` seconds starts a new burst;
    single members make none. The cover is the reference if it is there, else the first shot. Members are unique; null folders are one folder.
    """
    near = F.coalesce(F.col("is_reference"), F.lit(False)) | (F.coalesce("score", F.lit(-1.0)) >= least)
    kept = stored(members.where(F.col("epoch").isNotNull() & near & F.col("member").isNotNull()), "burst-members")
    albums = F.transform(F.coalesce("albums", F.array().cast("array<string>")), lambda a: F.concat(F.lit("a/"), a))
    tags = kept.select("grp", "member", F.explode(F.concat(F.array(F.concat(F.lit("f/"), F.coalesce("folder", F.lit("")))), F.filter(albums, lambda a: a.isNotNull()))).alias("tag"))
    firsts = tags.groupBy("grp", "tag").agg(F.min("member").alias("first"))
    same = tags["grp"].eqNullSafe(firsts["grp"]) & (tags["tag"] == firsts["tag"])
    links = tags.join(firsts, same).select(F.col("first").alias("a"), F.col("member").alias("b"))
    placed = kept.join(connected_components(links, "a", "b"), F.col("node") == F.col("member")).withColumnRenamed("component", "part")
    order = Window.partitionBy("part").orderBy("epoch", "member")
    opens = F.when(F.col("epoch") - F.lag("epoch").over(order) <= max_drift, 0).otherwise(1)
    runs = placed.withColumn("opens", opens).withColumn("burst", F.sum("opens").over(order))
    own = Window.partitionBy("part", "burst")
    cover = F.min(F.struct((~F.coalesce(F.col("is_reference"), F.lit(False))).alias("other"), "epoch", "member")).over(own)
    sized = runs.withColumns({"n": F.count("*").over(own), "cover": cover, "place": F.row_number().over(own.orderBy("epoch", "member"))})
    return sized.where("n > 1").select("member", "part", "burst", "place", F.col("cover.member").alias("cover"))
