"""Tokens that need positions, parts of texts or other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.tokens import Fields, search, split_negatives
from quaymark.operators.similarity import about_keys
from quaymark.plans.registry import query, table
from quaymark.plans.vectors import _vector


def _untagged(key: str, **parts) -> Fields:
    return Fields(key=key, tags=F.array().cast("array<string>"), **parts)


@query("""WITH liked AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)
SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM liked))
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3) AND o_totalprice > 1000""")
def person_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``person:fav`` and ``-person:3`` among other tokens: suppliers stand for people."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")

    def person(value: str) -> DataFrame | None:
        if value.lower() in ("fav", "favorite", "favourite"):
            liked = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
            return lines.join(liked, "l_suppkey", "left_semi")
        return lines.where(F.col("l_suppkey") == int(value)) if value.lstrip("-").isdigit() else None

    fields = _untagged("o_orderkey", relations={"person": person}, numbers={"total": F.col("o_totalprice")})
    return search(table(spark, sf_dir, "orders"), "person:fav -person:3 person:nobody total:>1000", fields).select("o_orderkey")


@query("""WITH s AS (SELECT l_orderkey AS stack, min(l_partkey) AS cover, count(*) AS n, CASE WHEN count(*) > 4 THEN 'burst' WHEN count(DISTINCT l_returnflag) > 1 THEN 'split' ELSE 'raw' END AS kind FROM lineitem GROUP BY 1)
SELECT p_partkey FROM part WHERE p_partkey IN (SELECT cover FROM s) AND p_partkey IN (SELECT cover FROM s WHERE kind = 'raw') AND p_partkey NOT IN (SELECT cover FROM s WHERE kind = 'split') AND p_size > 5""")
def stack_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers of stacks by kind: an order's parts are a stack, its first part the cover."""
    lines = table(spark, sf_dir, "lineitem")
    kind = F.when(F.count("*") > 4, "burst").when(F.count_distinct("l_returnflag") > 1, "split").otherwise("raw")
    stacks = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"), kind.alias("kind"))

    def stack(value: str) -> DataFrame | None:
        value = value.strip().lower()
        if value in ("", "any", "all", "yes"):
            return stacks
        return stacks.where(F.col("kind") == value) if value in ("raw", "burst", "manual", "split") else None

    fields = _untagged("p_partkey", relations={"stack": stack}, numbers={"size": F.col("p_size")})
    return search(table(spark, sf_dir, "part"), "stack:any stack:raw -stack:split stack:heap size:>5", fields).select("p_partkey")


_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


@query(f"""WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id, a.label, {_COS.format(a='a.v', b='p.v')} - 0.7 * {_COS.format(a='a.v', b='n.v')} AS score FROM u a, u p, u n WHERE p.vec_id = 2 AND n.vec_id = 5),
t AS (SELECT least(greatest(0.05, avg(score) + stddev_pop(score), 0.4 * max(score)), max(score)) AS cut FROM s),
z AS (SELECT a.vec_id, {_COS.format(a='a.v', b='p.v')} AS score FROM u a, u p WHERE p.vec_id = 9)
SELECT vec_id FROM s, t WHERE score >= cut AND label >= 2 AND vec_id NOT IN (SELECT vec_id FROM z WHERE score >= (SELECT least(greatest(0.05, avg(score) + stddev_pop(score), 0.4 * max(score)), max(score)) FROM z))""")
def about_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``about:`` with words that push away, its negation, and a plain token in one search."""
    known, rows = {"two": 2, "five": 5, "nine": 9}, table(spark, sf_dir, "embeddings")

    def about(value: str) -> DataFrame | None:
        wanted, turned = split_negatives(" ".join(value.replace("+", " ").replace("_", " ").split()))
        if wanted not in known:
            return None
        vectors = [_vector(spark, sf_dir, known[w]) for w in [wanted, *[t for t in turned if t in known]]]
        return about_keys(rows, "vec_id", "embedding", vectors[0], vectors[1:], ratio=0.4)

    fields = _untagged("vec_id", relations={"about": about}, numbers={"label": F.col("label")})
    return search(rows, "about:two_-five -about:nine label:>=2", fields).select("vec_id")


_PLACED = "(SELECT event_id, value % 90 AS lat, CASE WHEN event_id % 3 > 0 THEN value % 360 - 180 END AS lon FROM events)"


@query(f"""SELECT event_id FROM {_PLACED} WHERE lon IS NOT NULL AND lat BETWEEN 40 - 2500 / 111.32 AND 40 + 2500 / 111.32
AND lon BETWEEN -140 - 2500 / 111.32 / cos(radians(40)) AND -140 + 2500 / 111.32 / cos(radians(40)) AND NOT (lat BETWEEN 30 AND 60 AND (lon >= 170 OR lon <= -150))""")
def position_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gps:``, ``near:`` and a ``bbox:`` over the antimeridian that is turned away."""
    placed = table(spark, sf_dir, "events").select("event_id", (F.col("value") % 90).alias("lat"), F.when(F.col("event_id") % 3 > 0, F.col("value") % 360 - 180).alias("lon"))
    fields = _untagged("event_id", position=(F.col("lat"), F.col("lon")))
    return search(placed, "gps:yes near:40,-140,2500 -bbox:30,170,60,-150", fields).select("event_id")


@query("""SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE contains(lower(text), 'ing') AND contains(lower(source), '1') AND NOT contains(lower(lang), 'fr')
AND coalesce(quality * 4, n_chars % 5) >= 2 ORDER BY coalesce(quality * 4, n_chars % 5) DESC NULLS LAST, doc_id LIMIT 200""")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``desc:``, ``event:``, ``lang:`` by a part of their text, and ``rating:`` by a user's stars or else the model's."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 4).alias("user_stars"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    rating = F.coalesce("user_stars", F.col("n_chars") % 5)
    fields = _untagged("doc_id", parts={"desc": F.col("text"), "event": F.col("source"), "lang": F.col("lang")}, numbers={"rating": rating})
    return search(docs, 'desc:"ing" event:1 -lang:fr rating:>=2 sort:-rating', fields, 200).select("doc_id")


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, coalesce(CASE WHEN l_returnflag = 'R' THEN l_shipdate END, CASE WHEN l_linestatus = 'O' THEN l_shipdate + INTERVAL 1 DAY END) AS taken FROM lineitem)
ORDER BY taken DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey LIMIT 500""")
def taken_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sort:-taken``: the first date that a file has of several, files without any last."""
    taken = F.coalesce(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")), F.when(F.col("l_linestatus") == "O", F.col("l_shipdate") + F.expr("INTERVAL 1 DAY")))
    fields = _untagged("key", sorts={"taken": taken})
    lines = table(spark, sf_dir, "lineitem").withColumn("key", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return search(lines, "sort:-taken", fields, 500).select("l_orderkey", "l_linenumber")
