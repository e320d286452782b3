"""Vector ranking, clustering figures, Hamming joins and duplicate groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.operators.groups import farthest, leader_clusters
from quaymark.operators.similarity import (
    centroids, cosine, exact_groups, hamming_pairs, hash_classes, linked_components, literal, reference_order, text_bits, top_k,
)
from quaymark.plans.registry import query, table
from quaymark.sources.shared import stored

LIMIT = 5
#: Centroids that travel with every task.
CENTROIDS_AT_ONCE = 1024
UNIT = "(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def _vector(spark: SparkSession, sf_dir: str, key: int) -> list[float]:
    """The vector of one row, which becomes a constant of the query."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == key).select("embedding").first()
    if row is None:
        raise ValueError(f"no vector {key}")
    return list(row[0])


@query(f"""SELECT a.vec_id, round({COS.format(a='a.v', b='q.v')}, 6) AS score FROM {UNIT} a, {UNIT} q
WHERE q.vec_id = 0 ORDER BY {COS.format(a='a.v', b='q.v')} DESC, a.vec_id LIMIT 20""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 20, "vec_id", "embedding")
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"""SELECT a.vec_id, round({COS.format(a='a.v', b='q.v')}, 6) AS score FROM {UNIT} a, {UNIT} q
WHERE q.vec_id = 3 AND a.vec_id <> 3 ORDER BY {COS.format(a='a.v', b='q.v')} DESC, a.vec_id LIMIT 10""")
def similar_to_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = table(spark, sf_dir, "embeddings").where("vec_id <> 3")
    return top_k(others, _vector(spark, sf_dir, 3), 10, "vec_id", "embedding").select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT a.vec_id, {COS.format(a='a.v', b='p.v')} - 0.7 * {COS.format(a='a.v', b='n.v')} AS score FROM {UNIT} a, {UNIT} p, {UNIT} n WHERE p.vec_id = 0 AND n.vec_id = 1),
t AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 5000)
SELECT vec_id, round(score, 6) AS score FROM t WHERE score >= (SELECT greatest(0.1, 0.75 * max(score)) FROM t) OR score = (SELECT max(score) FROM t)""")
def vector_rank_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near one vector and away from another; what comes within three quarters of the best stays."""
    near = cosine(F.col("embedding"), literal(_vector(spark, sf_dir, 0)))
    away = cosine(F.col("embedding"), literal(_vector(spark, sf_dir, 1)))
    scored = table(spark, sf_dir, "embeddings").select("vec_id", (near - 0.7 * away).alias("score")).orderBy(F.desc("score"), "vec_id").limit(5000)
    # the other side is one row
    best = scored.agg(F.max("score").alias("best"))
    kept = scored.crossJoin(F.broadcast(best)).where((F.col("score") >= F.greatest(F.lit(0.1), 0.75 * F.col("best"))) | (F.col("score") == F.col("best")))
    return kept.select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT a.vec_id, {COS.format(a='a.v', b='q.v')} AS score FROM {UNIT} a, {UNIT} q WHERE q.vec_id = 0),
t AS (SELECT least(max(score), greatest(0.05, avg(score) + stddev_pop(score), 0.75 * max(score))) AS cut FROM s)
SELECT vec_id FROM s, t WHERE score >= cut""")
def vector_filter_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold from the scores themselves: mean and deviation, or a share of the best."""
    scored = table(spark, sf_dir, "embeddings").select("vec_id", cosine(F.col("embedding"), literal(_vector(spark, sf_dir, 0))).alias("score"))
    cut = F.least(F.max("score"), F.greatest(F.lit(0.05), F.avg("score") + F.stddev_pop("score"), 0.75 * F.max("score")))
    return scored.crossJoin(F.broadcast(scored.agg(cut.alias("cut")))).where("score >= cut").select("vec_id")


CENTROIDS = f"""u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM {UNIT}),
e AS (SELECT label, i, avg(v[i]) AS m, count(*) AS n FROM (SELECT *, unnest(range(1, 65)) AS i FROM u) GROUP BY 1, 2),
c AS (SELECT label, max(n) AS n, list(m ORDER BY i) AS c FROM e GROUP BY 1)"""


@query(f"""WITH {CENTROIDS}, d AS (SELECT u.label, 1 - {COS.format(a='u.v', b='c.c')} AS d FROM u JOIN c USING (label))
SELECT label, count(*) AS n, round(avg(d), 6) AS radius, round(stddev_pop(d), 6) AS spread FROM d GROUP BY label""")
def centroid_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the distances to each label's centroid."""
    vectors = table(spark, sf_dir, "embeddings")
    found = vectors.join(centroids(vectors, "label", "embedding", "vec_id").drop("n"), "label")
    off = found.select("label", (1 - cosine(F.col("embedding"), F.col("centroid"))).alias("d"))
    return off.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("radius"), F.round(F.stddev_pop("d"), 6).alias("spread"))


@query(f"""WITH {CENTROIDS}, s AS (SELECT u.vec_id, c.label, {COS.format(a='u.v', b='c.c')} AS s FROM u, c)
SELECT vec_id, arg_max(label, s) AS nearest FROM s GROUP BY vec_id""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label with the nearest centroid; centroids travel in blocks of a bounded size."""
    vectors = table(spark, sf_dir, "embeddings")
    found = stored(centroids(vectors, "label", "embedding", "vec_id"), "centroids")
    blocks = -(-found.count() // CENTROIDS_AT_ONCE)
    block = F.pmod(F.xxhash64("label"), F.lit(max(1, blocks))).alias("block")
    packed = found.groupBy(block).agg(F.collect_list(F.struct("label", "centroid")).alias("all"))
    scores = F.transform("all", lambda c: F.struct(cosine(F.col("embedding"), c["centroid"]).alias("s"), c["label"].alias("label")))
    best = F.array_max(scores).alias("best")
    # each block against all rows; with one block there is nothing to compare afterwards
    if blocks <= 1:
        return vectors.crossJoin(F.broadcast(packed)).select("vec_id", best).select("vec_id", F.col("best.label").alias("nearest"))
    each = [vectors.crossJoin(F.broadcast(packed.where(F.col("block") == i))).select("vec_id", best) for i in range(blocks)]
    return reduce(DataFrame.unionAll, each).groupBy("vec_id").agg(F.max("best").alias("best")).select("vec_id", F.col("best.label").alias("nearest"))


@query(f"""WITH {CENTROIDS}, d AS (SELECT u.vec_id, u.label, 1 - {COS.format(a='u.v', b='c.c')} AS d FROM u JOIN c USING (label)),
s AS (SELECT label, avg(d) AS r, stddev_pop(d) AS sd FROM d GROUP BY 1)
SELECT vec_id, round(d, 6) AS distance FROM d JOIN s USING (label) WHERE d > r + 2 * sd""")
def centroid_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors beyond their label's radius and two deviations."""
    vectors = table(spark, sf_dir, "embeddings")
    off = vectors.join(centroids(vectors, "label", "embedding", "vec_id").drop("n"), "label").select("vec_id", "label", (1 - cosine(F.col("embedding"), F.col("centroid"))).alias("d"))
    bounds = off.groupBy("label").agg((F.avg("d") + 2 * F.stddev_pop("d")).alias("far"))
    return off.join(bounds, "label").where("d > far").select("vec_id", F.round("d", 6).alias("distance"))


@query("""SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 3""")
def cluster_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rn"))
    return ranked.where("rn <= 3").drop("rn")


BITS = """w AS (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS word FROM (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS l FROM documents)),
g AS (SELECT doc_id, ('0x' || md5(word)[1:16])::UBIGINT AS h FROM w), k AS (SELECT unnest(range(64))::UTINYINT AS i),
v AS (SELECT doc_id, i, 2 * coalesce(sum((h >> i) & 1), 0) > count(h) AS b FROM g, k GROUP BY ALL),
f AS (SELECT doc_id, coalesce(sum(CASE WHEN b THEN 1::HUGEINT << i::HUGEINT END), 0)::HUGEINT AS h FROM v GROUP BY 1),
c AS (SELECT h, min(doc_id) AS first, count(*) AS n FROM f GROUP BY h),
p AS (SELECT x.first AS a, y.first AS b, bit_count(xor(x.h, y.h)) AS distance FROM c x JOIN c y ON x.first < y.first AND bit_count(xor(x.h, y.h)) <= %d)""" % LIMIT


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(text_bits(table(spark, sf_dir, "documents"), "doc_id", "text"), "fingerprints")


def _pairs(hashes: DataFrame) -> DataFrame:
    return hamming_pairs(hash_classes(hashes, "doc_id", "h"), "first", "h", LIMIT)


@query(f"WITH {BITS} SELECT a, b, distance::INTEGER AS distance FROM p")
def hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of text fingerprints within five bits; a class of equal ones is one, under its smallest key."""
    return _pairs(_fingerprints(spark, sf_dir))


@query(f"""WITH RECURSIVE {BITS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), m AS (SELECT node, min(root) AS component FROM r GROUP BY node)
SELECT doc_id, coalesce(component, first) AS component FROM f JOIN c USING (h) LEFT JOIN m ON node = first""")
def near_dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest document that each one is linked to, through equal and near fingerprints."""
    hashes = _fingerprints(spark, sf_dir)
    found = linked_components(_pairs(hashes))
    classes = hash_classes(hashes, "doc_id", "h").join(found, F.col("node") == F.col("first"), "left")
    return hashes.join(classes.select("h", F.coalesce("component", "first").alias("component")), "h").select("doc_id", "component")


@query(f"""WITH RECURSIVE {BITS}, e AS (SELECT a, b, distance FROM p UNION SELECT b, a, distance FROM p),
r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS component FROM r GROUP BY node), t AS (SELECT a AS node, sum(1 - distance / 64) AS total FROM e GROUP BY 1)
SELECT component, node, round(total, 6) AS total, row_number() OVER (PARTITION BY component ORDER BY total DESC, node)::INTEGER AS rank FROM m JOIN t USING (node)""")
def dup_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each group behind its best connected one."""
    pairs = stored(_pairs(_fingerprints(spark, sf_dir)), "pairs").withColumn("score", 1 - F.col("distance") / 64)
    found = reference_order(pairs, linked_components(pairs), "score")
    return found.select("component", "node", F.round("total", 6).alias("total"), "rank")


@query("""SELECT sha256(text) AS digest, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1""")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def leader_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-alikes by leaders, for each label."""
    found = leader_clusters(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.3)
    return found.select(F.col("owner").alias("label"), F.col("key").alias("vec_id"), "cluster")


@query()
def farthest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight vectors far from each other."""
    return farthest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
