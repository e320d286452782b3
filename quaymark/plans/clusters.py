"""Clusters of vectors, passages, names and pair scorers."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.operators.neighbours import approximate_clusters, threshold_clusters, unit_rows
from quaymark.operators.similarity import cosine, dot, literal
from quaymark.operators.sequences import kept_steps
from quaymark.plans.registry import query, table
from quaymark.plans.vectors import _vector
from quaymark.sources.shared import stored

EPS, LEAST = 0.55, 2
UNIT = """u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"""
NEAR = f"""{UNIT}, e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND 1 - list_dot_product(x.v, y.v) <= {EPS})"""


@query(f"""WITH RECURSIVE {NEAR}, r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component FROM r GROUP BY node), s AS (SELECT component, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= {LEAST}),
k AS (SELECT component, row_number() OVER (ORDER BY n DESC, component) - 1 AS cluster FROM s)
SELECT vec_id, coalesce(cluster, -1)::INTEGER AS cluster FROM u LEFT JOIN c ON node = vec_id LEFT JOIN k USING (component)""")
def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of vectors by a distance, exactly, whichever blocks they fall into."""
    found = threshold_clusters(unit_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), EPS, LEAST)
    return found.select(F.col("key").alias("vec_id"), F.col("cluster").cast("int").alias("cluster"))


@query()
def vector_clusters_about(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clusters from tables of random hyperplanes, which may miss a link."""
    found = approximate_clusters(unit_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), EPS, LEAST)
    return found.select(F.col("key").alias("vec_id"), F.col("cluster").cast("int").alias("cluster"))


@query()
def vector_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means on unit vectors under the cosine, k from the number of rows."""
    units = stored(unit_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("key", array_to_vector("v").alias("features")), "kmeans")
    n = units.count()
    k = max(2, min(40, round(math.sqrt(n / 2))))
    if n <= k:
        return units.select(F.col("key").alias("vec_id"), F.lit(0).alias("cluster"))
    model = KMeans(k=k, seed=0, distanceMeasure="cosine").fit(units)
    return model.transform(units).select(F.col("key").alias("vec_id"), F.col("prediction").alias("cluster"))


@query(f"""WITH {UNIT}, s AS (SELECT a.vec_id, a.vec_id % 50 AS book, list_dot_product(a.v, q.v) AS score FROM u a, u q WHERE q.vec_id = 4),
r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY score DESC, vec_id) AS rn, max(score) OVER (PARTITION BY book) AS best FROM s)
SELECT book, vec_id, rn::INTEGER AS rn, round(score, 6) AS score, round(best, 6) AS best FROM r WHERE rn <= 3""")
def passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three passages of each book; its best one is the book's score."""
    score = cosine(F.col("embedding"), literal(_vector(spark, sf_dir, 4)))
    scored = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("book"), score.alias("score"))
    own = Window.partitionBy("book")
    ranked = scored.withColumns({"rn": F.row_number().over(own.orderBy(F.desc("score"), "vec_id")), "best": F.max("score").over(own)})
    return ranked.where("rn <= 3").select("book", "vec_id", "rn", F.round("score", 6).alias("score"), F.round("best", 6).alias("best"))


@query(f"""WITH {UNIT}, s AS (SELECT a.vec_id, list_dot_product(a.v, q.v) + 0.25 * (('0x' || substr(md5('5/' || a.vec_id), 1, 8))::BIGINT / 4294967296.0 - 0.5) AS score FROM u a, u q WHERE q.vec_id = 6)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 50""")
def noisy_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearness to a seed with noise that a seed fixes."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit("5/"), F.col("vec_id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    score = cosine(F.col("embedding"), literal(_vector(spark, sf_dir, 6))) + 0.25 * (drawn - 0.5)
    found = table(spark, sf_dir, "embeddings").select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(50)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH {UNIT}, r AS (SELECT v FROM u WHERE vec_id < 5) SELECT vec_id FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE 1 - list_dot_product(r.v, u.v) <= 0.7)""")
def not_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are near none of a few rejected ones, which become constants of the query."""
    units = unit_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    kept = F.lit(True)
    for row in units.where("key < 5").orderBy("key").limit(5).collect():
        kept = kept & (1 - dot(F.col("v"), literal(list(row["v"]))) > 0.7)
    return units.where(kept).select(F.col("key").alias("vec_id"))


@query("""WITH m AS (SELECT vec_id, label, CASE WHEN vec_id % 7 = 0 THEN 'name' || (label % 3 + vec_id % 2) END AS name FROM embeddings),
c AS (SELECT label, name, count(*) AS n FROM m WHERE name IS NOT NULL GROUP BY ALL), t AS (SELECT label, name FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, name) AS rn FROM c) WHERE rn = 1)
SELECT vec_id, coalesce(m.name, t.name) AS name FROM m LEFT JOIN t USING (label)""")
def propagated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster's most frequent confirmed name goes to its members without one."""
    name = F.when(F.col("vec_id") % 7 == 0, F.concat(F.lit("name"), (F.col("label") % 3 + F.col("vec_id") % 2).cast("string")))
    members = table(spark, sf_dir, "embeddings").select("vec_id", "label", name.alias("own"))
    counts = members.where("own IS NOT NULL").groupBy("label", "own").agg(F.count("*").alias("n"))
    top = counts.groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("own").alias("name"))).alias("t"))
    return members.join(top, "label", "left").select("vec_id", F.coalesce("own", "t.name").alias("name"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_orderkey % 4 AS cached FROM lineitem)
SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN cached = 0 THEN 1.0 END, CASE WHEN l_quantity > 40 THEN l_quantity / 50 END, CASE WHEN l_discount > 0.05 THEN 1 - l_discount END, l_tax), 6) AS score FROM p""")
def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorers in their order; the first that has a verdict gives it, and a cached verdict comes before all."""
    lines = table(spark, sf_dir, "lineitem")
    cache = lines.where("l_orderkey % 4 = 0").select("l_orderkey", F.lit(1.0).alias("verdict")).distinct()
    scorers = [
        F.col("verdict"),
        F.when(F.col("l_quantity") > 40, F.col("l_quantity") / 50),
        F.when(F.col("l_discount") > 0.05, 1 - F.col("l_discount")),
        F.col("l_tax"),
    ]
    return lines.join(cache, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.round(F.coalesce(*scorers), 6).alias("score"))


@query("""WITH s AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 86400000000 THEN 0 ELSE 1 END AS opens, event_type FROM events),
b AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS burst FROM s)
SELECT user_id, event_type, burst::INTEGER AS burst, count(*) AS n FROM b GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def burst_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like things of one owner whose times follow within a day; a longer gap starts another burst."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    opens = F.when(t - F.lag(t).over(w) <= 86_400_000_000, 0).otherwise(1)
    numbered = table(spark, sf_dir, "events").withColumn("opens", opens).withColumn("burst", F.sum("opens").over(w).cast("int"))
    return numbered.groupBy("user_id", "event_type", "burst").agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH RECURSIVE s AS (SELECT user_id, floor(value)::BIGINT AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS rn FROM s WHERE x % 64 > 3 AND x % 64 < 61),
k(user_id, rn, last, kept) AS (SELECT user_id, rn, x, [x] FROM f WHERE rn = 1 UNION ALL
SELECT k.user_id, f.rn, CASE WHEN abs(f.x - k.last) <= 20 THEN k.last ELSE f.x END, CASE WHEN abs(f.x - k.last) <= 20 THEN k.kept ELSE list_append(k.kept, f.x) END FROM k JOIN f ON f.user_id = k.user_id AND f.rn = k.rn + 1),
e AS (SELECT user_id, arg_max(kept, rn) AS kept FROM k GROUP BY 1)
SELECT user_id, coalesce(array_to_string(kept, ','), '') AS kept, round(least(greatest((coalesce(len(kept), 0) - 60) / 140.0, 0), 1), 6)::DOUBLE AS cost FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN e USING (user_id)""")
def index_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each sequence without flat ones and near repeats of the last one kept, and their cost as a ramp."""
    steps = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.floor("value").cast("long").alias("x")))).alias("s"))
    kept = kept_steps(F.col("s.x"), lambda x: (x % 64 <= 3) | (x % 64 >= 61), 20)
    return steps.select("user_id", kept.alias("kept")).select("user_id", F.array_join("kept", ",").alias("kept"), F.round(F.least(F.greatest((F.size("kept") - 60) / F.lit(140.0), F.lit(0.0)), F.lit(1.0)), 6).alias("cost"))
