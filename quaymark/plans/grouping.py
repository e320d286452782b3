"""Trips, places, people, albums and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.operators.groups import overlaps, trips
from quaymark.operators.sequences import dtw_score, offset_votes, resampled
from quaymark.plans.registry import query, table


@query()
def trips_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of each user: gaps of 36 hours, or jumps of the place that the value stands for."""
    placed = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", (F.col("value") % 90).alias("lat"), F.when(F.col("event_id") % 3 != 0, F.col("value") % 180).alias("lon")
    )
    return trips(placed, "user_id", "ts", "lat", "lon", "event_id", 36, 2000).select("event_id", "user_id", "trip")


@query("""SELECT n_name, year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY ALL HAVING count(*) >= 3""")
def group_places_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by place and year, small groups left out."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    owners = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    counts = orders.join(owners, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "y").agg(F.count("*").alias("n"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return counts.where("n >= 3").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "y", "n")


@query("""WITH s AS (SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), ',') AS people FROM lineitem GROUP BY 1)
SELECT people, count(*) AS n FROM s GROUP BY people HAVING count(*) >= 2""")
def group_people_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the exact set of who is in them."""
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ",").alias("people"))
    return sets.groupBy("people").agg(F.count("*").alias("n")).where("n >= 2")


@query("""WITH b AS (SELECT user_id, min(ts) AS a, max(ts) AS z, count(*) AS n, count(*) FILTER (value > 50) / count(*) AS share FROM events GROUP BY 1),
t AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2)
SELECT user_id, (floor((epoch(z) - epoch(a)) / 86400) + 1)::BIGINT AS days, n, round(share, 6) AS share,
(SELECT string_agg(event_type, ',' ORDER BY rn) FROM t WHERE t.user_id = b.user_id AND rn <= 3) AS top FROM b""")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span in days, size, share and the commonest kinds of each group."""
    events = table(spark, sf_dir, "events")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    base = events.groupBy("user_id").agg(
        (F.floor((seconds(F.max("ts")) - seconds(F.min("ts"))) / 86400) + 1).alias("days"), F.count("*").alias("n"), F.round(F.count_if(F.expr("value > 50")) / F.count("*"), 6).alias("share")
    )
    kinds = events.groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    ranked = kinds.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("c"), "event_type"))).where("rn <= 3")
    tops = ranked.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rn", "event_type"))).alias("t"))
    return base.join(tops, "user_id").select("user_id", "days", "n", "share", F.array_join("t.event_type", ",").alias("top"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem), a AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS i FROM lineitem),
z AS (SELECT g, count(*) AS size FROM m GROUP BY 1), s AS (SELECT g, a, count(*) AS shared FROM m JOIN a USING (i) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY shared DESC, a) AS rn FROM s)
SELECT g AS l_orderkey, a AS l_suppkey, round(shared / size, 6) AS share FROM r JOIN z USING (g) WHERE rn = 1""")
def album_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The album that holds the most of each group."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    found = overlaps(lines, lines, "l_orderkey", "l_partkey", "l_suppkey")
    return found.select("l_orderkey", "l_suppkey", F.round("share", 6).alias("share"))


STEPS = "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, floor(value * 10)::BIGINT AS v FROM events)"


@query(f"""WITH s AS {STEPS}, k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY v) AS c FROM s) WHERE c <= 32),
o AS (SELECT x.user_id AS a, y.user_id AS b, y.pos - x.pos AS "offset", count(*) AS votes FROM k x JOIN k y ON x.v = y.v AND x.user_id < y.user_id GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY votes DESC, "offset") AS rn FROM o WHERE votes >= 2)
SELECT a, b, "offset"::INTEGER AS "offset", votes FROM r WHERE rn = 1""")
def offset_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far one user's sequence runs behind another's."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).alias("pos"), F.floor(F.col("value") * 10).alias("v"))
    return offset_votes(steps, "user_id", "pos", "v", 32, 2)


@query()
def dtw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of each user's first and second half of values; of a half with more than 256, evenly spaced ones."""
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", (F.col("value") / 1000).alias("v")).alias("step"))
    whole = rows.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list("step")), lambda x: x["v"]).alias("v"))
    middle = F.floor(F.size("v") / 2).cast("int")
    halves = whole.withColumns({"a": F.slice("v", F.lit(1), middle), "b": F.slice("v", middle + 1, F.size("v"))})
    pairs = halves.select("user_id", *[resampled(F.col(c), 256).alias(c) for c in ("a", "b")])
    return dtw_score(pairs, "a", "b").select("user_id", F.round("score", 6).alias("score"))
