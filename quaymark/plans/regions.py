"""Boxes and fields. Lines stand for boxes: an order is an image, and figures of the line give the place and size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.fields import date_range, filled, merged_tags, parse_date, rendered
from quaymark.operators.boxes import best_matches, distinct_boxes, rollup_scores, tracks
from quaymark.plans.registry import query, table

SQL_BOXES = """b AS (SELECT l_orderkey AS image, l_linenumber AS line, l_orderkey * 10 + l_linenumber AS key, l_returnflag AS kind,
l_discount * 5 AS cx, l_tax * 5 AS cy, 0.2 + l_quantity / 100 AS w, 0.2 + (l_partkey % 50) / 100 AS h FROM lineitem)"""
SIDE = "greatest(least(x.{c} + x.{s} / 2, y.{c} + y.{s} / 2) - greatest(x.{c} - x.{s} / 2, y.{c} - y.{s} / 2), 0)"
SHARED = f"({SIDE.format(c='cx', s='w')} * {SIDE.format(c='cy', s='h')})"
SQL_IOU = f"{SHARED} / (x.w * x.h + y.w * y.h - {SHARED})"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_returnflag").alias("kind"),
        (F.col("l_discount") * 5).alias("cx"), (F.col("l_tax") * 5).alias("cy"), (0.2 + F.col("l_quantity") / 100).alias("w"), (0.2 + (F.col("l_partkey") % 50) / 100).alias("h"),
    )


@query(f"""WITH {SQL_BOXES}, s AS (SELECT x.image, x.line AS lx, y.line AS ly, {SQL_IOU} AS o FROM b x JOIN b y ON x.image = y.image AND x.line % 2 = 1 AND y.line % 2 = 0)
SELECT count(*) AS pairs, count(*) FILTER (o > 0.3) AS overlapping, round(sum(o), 3) AS total FROM s""")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the odd boxes of all images overlap the even ones."""
    from quaymark.operators.boxes import BOX, iou

    boxes = _boxes(spark, sf_dir)
    a = boxes.where("line % 2 = 1").select("image", *[F.col(c).alias(f"a_{c}") for c in BOX])
    b = boxes.where("line % 2 = 0").select("image", *[F.col(c).alias(f"b_{c}") for c in BOX])
    scored = a.join(b, "image").select(iou([F.col(f"a_{c}") for c in BOX], [F.col(f"b_{c}") for c in BOX]).alias("o"))
    return scored.agg(F.count("*").alias("pairs"), F.count_if(F.col("o") > 0.3).alias("overlapping"), F.round(F.sum("o"), 3).alias("total"))


@query(f"""WITH {SQL_BOXES}, s AS (SELECT x.key AS a, y.key AS b, {SQL_IOU} AS o FROM b x JOIN b y ON x.image = y.image AND x.line % 2 = 1 AND y.line % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY o DESC, b) AS rn FROM s WHERE o >= 0.1) SELECT a, b, round(o, 6) AS overlap FROM r WHERE rn = 1""")
def box_best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    found = best_matches(boxes.where("line % 2 = 1"), boxes.where("line % 2 = 0"), "image", "key", 0.1)
    return found.select("a", "b", F.round("overlap", 6).alias("overlap"))


@query()
def box_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_boxes(_boxes(spark, sf_dir), "image", "key", 0.55)


@query()
def box_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(_boxes(spark, sf_dir).where("key IS NOT NULL"), "image", "line", "kind", "key")


@query("""WITH s AS (SELECT l_returnflag AS kind, count(*) FILTER (l_linestatus = 'F') AS hits, count(*) FILTER (l_linestatus = 'O' AND l_linenumber < 3) AS wrong,
count(*) FILTER (l_linestatus = 'O' AND l_linenumber >= 3) AS missed FROM lineitem GROUP BY 1),
p AS (SELECT *, CASE WHEN hits + wrong > 0 THEN hits / (hits + wrong) ELSE 0 END AS p, CASE WHEN hits + missed > 0 THEN hits / (hits + missed) ELSE 0 END AS r FROM s)
SELECT kind, hits, wrong, missed, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM p""")
def detection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, late = F.col("l_linestatus") == "F", F.col("l_linenumber") >= 3
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("kind"), found.cast("long").alias("hits"), (~found & ~late).cast("long").alias("wrong"), (~found & late).cast("long").alias("missed")
    )
    scores = rollup_scores(rows, "kind")
    return scores.select("kind", "hits", "wrong", "missed", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("""SELECT o_orderkey, o_orderdate::DATE AS parsed FROM orders""")
def any_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in four ways, read back."""
    date = F.col("o_orderdate")
    written = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format(date, "yyyy-MM-dd HH:mm"))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format(date, "yyyy:MM:dd"))
        .when(F.col("o_orderkey") % 4 == 2, F.date_format(date, "yyyyMMdd"))
        .otherwise(F.date_format(date, "dd.MM.yyyy"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_date(written).alias("parsed"))


@query("""WITH b AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN a::DATE = z::DATE THEN strftime(a, '%-d %b %Y') WHEN strftime(a, '%Y-%m') = strftime(z, '%Y-%m') THEN strftime(a, '%-d') || '-' || strftime(z, '%-d %b %Y')
WHEN year(a) = year(z) THEN strftime(a, '%-d %b') || ' - ' || strftime(z, '%-d %b %Y') ELSE strftime(a, '%-d %b %Y') || ' - ' || strftime(z, '%-d %b %Y') END AS range FROM b""")
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    return spans.select("o_custkey", date_range(F.col("a"), F.col("z")).alias("range"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS artist FROM part""")
def fill_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 0, F.lit("  "))
    return table(spark, sf_dir, "part").select("p_partkey", filled(current, F.col("p_brand")).alias("artist"))


@query("""WITH t AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), string_split(upper(p_type || ' ' || p_name), ' ')) AS t FROM part),
u AS (SELECT p_partkey, unnest(t) AS t, unnest(range(1, len(t) + 1)) AS i FROM t),
f AS (SELECT p_partkey, arg_min(t, i) AS t, min(i) AS i FROM u GROUP BY p_partkey, lower(t))
SELECT p_partkey, string_agg(t, ' ' ORDER BY i) AS tags FROM f GROUP BY p_partkey""")
def tag_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.split(F.upper(F.concat_ws(" ", "p_type", "p_name")), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(merged_tags(F.split("p_name", " "), new), " ").alias("tags"))


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(p_brand || ' - ' || CASE WHEN p_size > 25 THEN p_type ELSE '' END || ' - ', '\\s+', ' ', 'g'), '(?:\\s*[-,/]\\s*)+$|^(?:\\s*[-,/]\\s*)+', '', 'g')) AS name FROM part""")
def name_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"brand": F.col("p_brand"), "type": F.when(F.col("p_size") > 25, F.col("p_type")), "none": F.lit(None)}
    return table(spark, sf_dir, "part").select("p_partkey", rendered("{brand} -  {type} - {none}", fields).alias("name"))
