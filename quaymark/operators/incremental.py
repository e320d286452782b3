"""An index of files that is kept as versions of a table and brought up to date by what has changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.sources.shared import write_parquet


def changes(files: DataFrame, index: DataFrame, key: str, moved: float = 0.01) -> DataFrame:
    """``key, change``: ``new``, ``changed`` (a time ``mtime`` that has moved by more than ``moved`` seconds, or another ``size``) or ``gone``."""
    now = files.select(key, F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_here"))
    seen = index.select(key, F.col("mtime").alias("_mi"), F.col("size").alias("_si"), F.lit(True).alias("_known"))
    both = now.join(seen, key, "full")
    other = ~F.col("_s").eqNullSafe(F.col("_si")) | F.coalesce(F.abs(F.col("_m") - F.col("_mi")) > moved, F.col("_m").isNotNull() | F.col("_mi").isNotNull())
    change = F.when(F.col("_known").isNull(), "new").when(F.col("_here").isNull(), "gone").when(other, "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def latest(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The last version of an index that was written whole, and its number; no index has the number 0."""
    try:
        marks = spark.read.schema("version long").json(f"{path}/versions")
        number = marks.agg(F.max("version")).first()[0] or 0
    except Exception as error:  # no version yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        number = 0
    return (spark.read.parquet(f"{path}/data/v{number}") if number else None), number


def update(spark: SparkSession, path: str, files: DataFrame, key: str, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The index after a pass over ``files``, read back, and the changes that it took in.

    ``extract`` reads the new and changed files only and gives their rows, with ``key``, ``mtime`` and ``size``; other rows stay, those of files that
    are gone go. The new version is written beside the old one and counts when its mark is there, so that a pass that is cut short changes nothing.
    """
    index, number = latest(spark, path)
    if index is None:
        found = files.select(key, F.lit("new").alias("change"))
        rows = extract(files)
    else:
        found = changes(files, index, key)
        todo = files.join(found.where("change <> 'gone'"), key, "left_semi")
        rows = index.join(found, key, "left_anti").unionByName(extract(todo))
    write_parquet(rows, f"{path}/data/v{number + 1}")
    write_parquet(found, f"{path}/changes/v{number + 1}")
    spark.range(1).select(F.lit(number + 1).alias("version")).write.mode("append").json(f"{path}/versions")
    return spark.read.parquet(f"{path}/data/v{number + 1}"), spark.read.parquet(f"{path}/changes/v{number + 1}")
