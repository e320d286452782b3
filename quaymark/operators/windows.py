"""Samples, sessions and running folds over ordered rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.sources.shared import stored


def spaced_samples(rows: DataFrame, bucket: str, order: list[Column], k: int) -> DataFrame:
    """At most ``k`` rows of each bucket, evenly spaced in the given order."""
    w = Window.partitionBy(bucket)
    numbered = rows.withColumns({"_rn": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    step = F.greatest(F.lit(1), F.expr(f"_n div {k}"))
    kept = numbered.withColumn("_step", step).where(F.expr(f"_rn % _step = 0 AND _rn div _step < {k}"))
    return kept.drop("_rn", "_n", "_step")


def sessions(rows: DataFrame, owner: str, time: str, gap_seconds: int, tie: str) -> DataFrame:
    """``rows`` with ``session``, counted from 1 for each owner; a gap of more than the limit starts a new one."""
    w = Window.partitionBy(owner).orderBy(time, tie)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000
    starts = rows.withColumn("_gap", seconds - F.lag(seconds).over(w))
    fresh = F.when(F.col("_gap").isNull() | (F.col("_gap") > gap_seconds), 1).otherwise(0)
    return starts.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap", "_new")


def delays(rows: DataFrame, owner: str, time: str, tie: str, low: int = 40, high: int = 1000, default: int = 100) -> DataFrame:
    """Milliseconds to the next row within bounds; the default where there is none above zero; the last repeats. Times count by the nearest millisecond."""
    w = Window.partitionBy(owner).orderBy(time, tie)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    half = micros + F.when(micros < 0, -500).otherwise(500)
    millis = ((half - half % 1000) / 1000).cast("long")
    ahead = rows.withColumn("_d", F.lead(millis).over(w) - millis)
    bounded = F.when(F.col("_d") > 0, F.least(F.greatest("_d", F.lit(low)), F.lit(high))).otherwise(F.when(F.col("_d").isNotNull(), default))
    placed = ahead.withColumn("_b", bounded)
    return placed.withColumn("delay", F.coalesce("_b", F.lag("_b").over(w), F.lit(default))).drop("_d", "_b")


def suppressed(rows: DataFrame, key: str, time: str, tie: str, minutes: int) -> DataFrame:
    """Rows that are at least ``minutes`` after the last kept row of their key.

    What is kept hangs on what was kept before, so each key is folded in order. The fold
    streams over sorted rows and holds one time for the key at hand.
    """
    schema = rows.schema

    def keep(frames):
        key_now, last = object(), None
        for frame in frames:
            kept = []
            for k, t in zip(frame[key], frame[time]):
                if k != key_now:
                    key_now, last = k, None
                fresh = last is None or (t - last) >= pd.Timedelta(minutes=minutes)
                if fresh:
                    last = t
                kept.append(fresh)
            yield frame[kept]

    return rows.repartition(key).sortWithinPartitions(key, time, tie).mapInPandas(keep, schema)


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: the result of upserts in order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before its time; one sort, no pairs."""
    both = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)}).unionByName(
        right.select(key, time, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"{value}_as_of", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, the place of each in its group from 1, and ``n``, the size of the group.

    A group may hold most of the rows: they are dealt out by ranges of ``(group, *order)``, counted by range, and each row's
    place is its place in the range behind the rows of the ranges before. So no task holds a whole group. ``order`` is
    made of columns that rise, the last of which tells rows apart; equal rows otherwise share a range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(parts, group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_c"))
    # one row for each group and range
    own = Window.partitionBy(group)
    before = counts.withColumns({"_before": F.coalesce(F.sum("_c").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_c").over(own)})
    before = before.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), "_before", "n")
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    placed = dealt.withColumn("_place", within).join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return placed.withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_g", "_r", "_before", "_place")


def medians(rows: DataFrame, group: str, value: str, tie: str, name: str) -> DataFrame:
    """``(group, name)``: the exact median of each group's values, the mean of the middle two where they are even in number."""
    known = rows.where(F.col(value).isNotNull()).select(group, value, tie)
    placed = ranked(known, group, [value, tie], "_place")
    middle = placed.where(F.expr("_place IN ((n + 1) div 2, (n + 2) div 2)"))
    return middle.groupBy(group).agg(F.avg(value).alias(name))
