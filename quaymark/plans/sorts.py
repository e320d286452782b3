"""Pages of songs in named orders; parts stand for songs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.sorts import SONGS, sorted_page
from quaymark.plans.registry import query, table

#: Orders, their directions, and their SQL.
PAGES = (
    ("artist", False, "lower(name), lower(album), disc, track, lower(title), id"),
    ("artist", True, "lower(name) DESC, lower(album), disc, track, lower(title), id"),
    ("track", True, "disc DESC, track DESC, lower(title), id"),
    ("year", True, "year IS NULL, year DESC, lower(name), lower(album), disc, track, lower(title), id"),
    ("year", False, "year IS NULL, year, lower(name), lower(album), disc, track, lower(title), id"),
    ("nothing", True, "lower(name) DESC, lower(album), disc, track, lower(title), id"),
)
_ONE = "SELECT * FROM (SELECT '{}' AS sort, {} AS descending, id AS p_partkey FROM s ORDER BY {} LIMIT 90)"


@query("""WITH s AS (SELECT p_partkey AS id, p_brand AS name, p_type AS album, coalesce(CASE WHEN p_size % 4 > 0 THEN p_size % 4 END, 0) AS disc, p_size % 9 AS track, p_name AS title,
CASE WHEN p_size % 7 > 0 THEN 1960 + p_size END AS year FROM part) """ + " UNION ALL ".join(_ONE.format(name, str(down).lower(), by) for name, down, by in PAGES))
def song_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page in some orders."""
    size = F.col("p_size")
    songs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_type").alias("album"), F.when(size % 4 > 0, size % 4).alias("disc"), (size % 9).alias("track"),
        F.col("p_name").alias("title"), F.when(size % 7 > 0, 1960 + size).alias("year"),
    )
    pages = [sorted_page(songs, SONGS, name, down, "id", 90).select(F.lit(name).alias("sort"), F.lit(down).alias("descending"), F.col("id").alias("p_partkey")) for name, down, _ in PAGES]
    return reduce(DataFrame.unionAll, pages)
