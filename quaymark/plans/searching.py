"""Searches over files: here parts stand for files, the words of their names for tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.tokens import Fields, search
from quaymark.plans.registry import query, table

TAGS = "string_split(lower(p_name), ' ')"


def parts() -> Fields:
    return Fields(
        key="p_partkey",
        tags=F.split(F.lower("p_name"), " "),
        texts=(F.col("p_name"), F.col("p_type")),
        numbers={"size": F.col("p_size"), "price": F.col("p_retailprice")},
        words={"kind": F.col("p_type"), "artist": F.col("p_brand")},
    )


COLUMNS = ["p_partkey", "p_name", "p_size", "p_retailprice"]


def _parts(spark: SparkSession, sf_dir: str, text: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    return search(table(spark, sf_dir, "part"), text, parts(), limit, offset).select(*COLUMNS)


@query(f"""SELECT p_partkey, p_name, p_size, p_retailprice FROM part
WHERE list_contains({TAGS}, 'red') AND NOT list_contains({TAGS}, 'ring') AND p_size BETWEEN 10 AND 30
ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 50""")
def gallery_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of fifty: a tag, not another, a number range, by falling price."""
    return _parts(spark, sf_dir, "tag:red -tag:ring size:10..30 sort:-price", 50)


@query(f"""SELECT p_partkey, p_name, p_size, p_retailprice FROM part
WHERE (list_contains({TAGS}, 'red') OR list_contains({TAGS}, 'blue')) AND NOT list_contains({TAGS}, 'bolt')
AND len(list_filter({TAGS}, lambda x: x LIKE 'g%')) = 0""")
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "tags:red|blue,-bolt,-g*")


@query("""SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_size > 20 AND p_retailprice <= 1500""")
def number_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "size:>20 price:<=1500")


@query("""SELECT p_partkey, p_name, p_size, p_retailprice FROM part
WHERE NOT (p_size BETWEEN 5 AND 40) AND NOT (lower(p_brand) = 'brand#11')""")
def negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "-size:40..5 -artist:brand#11")


@query(f"SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE len({TAGS}) >= 2")
def tag_count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "tagcount:>=2")


@query("""SELECT p_partkey, p_name, p_size, p_retailprice FROM part
ORDER BY p_size NULLS LAST, p_retailprice DESC NULLS LAST, p_partkey LIMIT 40 OFFSET 20""")
def sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a chained sort."""
    return _parts(spark, sf_dir, "sort:size sort:-price", 40, 20)


@query("""SELECT o_orderkey, o_orderdate FROM orders
WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-03-01' AND '1995-04-30' OR strftime(o_orderdate, '%Y-%m-%d') > '1998-06-30'""")
def date_token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    fields = Fields(key="o_orderkey", tags=F.array().cast("array<string>"), date=F.col("o_orderdate"))
    first, second = search(orders, "date:1995-03..1995-04", fields), search(orders, "date:>1998-06", fields)
    return first.union(second).select("o_orderkey", "o_orderdate")


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'mit license')")
def free_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = Fields(key="doc_id", tags=F.array().cast("array<string>"), texts=(F.col("text"),))
    return search(table(spark, sf_dir, "documents"), "MIT License", fields).select("doc_id", "lang", "source")


@query("""SELECT event_id, user_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 10 AND 20""")
def json_prop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value inside a JSON column; text that is no JSON matches nothing."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").where(k.between(10, 20)).select("event_id", "user_id")


@query("""SELECT p_partkey, coalesce(p_size > 25 AND p_retailprice > 1200, false) AS passed FROM part""")
def pass_and_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter node with two outputs: every row is in exactly one, whatever is null."""
    passed = F.coalesce((F.col("p_size") > 25) & (F.col("p_retailprice") > 1200), F.lit(False))
    return table(spark, sf_dir, "part").select("p_partkey", passed.alias("passed"))


@query(f"""WITH t AS (SELECT unnest({TAGS}) AS term FROM part)
SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT 50""")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(50)


@query("""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events
GROUP BY k ORDER BY n DESC, k NULLS LAST LIMIT 50""")
def json_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"].alias("k")
    return table(spark, sf_dir, "events").groupBy(k).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("k").asc_nulls_last()).limit(50)
