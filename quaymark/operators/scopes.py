"""Scopes, tolerant joins and orders of a library."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.operators.similarity import cosine

KM_PER_DEGREE = 111.32


def below(path: Column, node: str) -> Column:
    """The node itself or anything under it."""
    return (path == node) | path.startswith(node + "/")


def directly_in(path: Column, folder: str) -> Column:
    return path.startswith(folder + "/") & ~F.substring(path, len(folder) + 2, 1 << 20).contains("/")


def box_around(lat: Column, lon: Column, at: tuple[float, float], km: float) -> Column:
    """A square box around a point, wider in degrees away from the equator; it may cross the antimeridian."""
    high = km / KM_PER_DEGREE
    wide = high / max(math.cos(math.radians(at[0])), 0.01)
    west, east = at[1] - wide, at[1] + wide
    inside = lon.between(west, east)
    if west < -180:
        inside = inside | (lon >= west + 360)
    if east > 180:
        inside = inside | (lon <= east - 360)
    return lat.between(at[0] - high, at[0] + high) & inside


def without(files: DataFrame, key: str, *hidden: DataFrame) -> DataFrame:
    """``files`` less the keys of all the tables of hidden ones."""
    for table in hidden:
        files = files.join(table.select(key), key, "left_anti")
    return files


def within_tolerance(left: DataFrame, right: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Pairs of equal keys whose times differ by ``seconds`` at most: times meet in buckets, not each with each.

    The columns of ``right`` other than the key get the suffix ``_r``.
    """
    number = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    renamed = right.select(key, *[F.col(c).alias(f"{c}_r") for c in right.columns if c != key])
    a = left.withColumn("_b", F.floor(number(time) / seconds))
    b = renamed.withColumn("_b", F.explode(F.array(*[F.floor(number(f"{time}_r") / seconds) + d for d in (-1, 0, 1)])))
    return a.join(b, [key, "_b"]).where(F.abs(number(time) - number(f"{time}_r")) <= seconds).drop("_b")


def similar_within(rows: DataFrame, owner: str, key: str, hour: str, vector: str, hours: int, least: float) -> DataFrame:
    """``(a, b)`` of one owner, within some hours and with a cosine of at least ``least``."""
    a = rows.select(owner, F.col(key).alias("a"), F.col(hour).alias("ha"), F.col(vector).alias("va"), F.floor(F.col(hour) / hours).alias("_b"))
    b = rows.select(owner, F.col(key).alias("b"), F.col(hour).alias("hb"), F.col(vector).alias("vb"), F.explode(F.array(*[F.floor(F.col(hour) / hours) + d for d in (-1, 0, 1)])).alias("_b"))
    near = a.join(b, [owner, "_b"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ha") - F.col("hb")) <= hours))
    return near.where(cosine(F.col("va"), F.col("vb")) >= least).select("a", "b")


def even_members(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """``n`` members of each group at even distances, both ends kept; halves round to even."""
    w = Window.partitionBy(group)
    placed = rows.withColumns({"_at": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (n - 1)).cast("long"))
    return placed.where((F.col("_n") <= n) | F.array_contains(spots, F.col("_at").cast("long"))).drop("_at", "_n")


def numbered_names(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Equal names, whatever their case, get `` (2)``, `` (3)`` in order; the first keeps its own."""
    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(*order))
    return rows.withColumn("name", F.when(n == 1, F.col(name)).otherwise(F.concat(name, F.lit(" ("), n.cast("string"), F.lit(")"))))


def first_seen_union(parts: list[DataFrame], key: str, position: str) -> DataFrame:
    """``(key, place)``: the union of ordered sets in order of first sight."""
    tagged = [p.select(key, F.struct(F.lit(i).alias("part"), F.col(position).cast("long").alias("position")).alias("at")) for i, p in enumerate(parts)]
    both = tagged[0]
    for more in tagged[1:]:
        both = both.union(more)
    return both.groupBy(key).agg(F.min("at").alias("at")).select(key, F.col("at.part").alias("part"), F.col("at.position").alias("position"))
