"""More tokens, scopes and orders of a search: parts stand for pictures, orders for photos with people, customers for files with places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.functions.tokens import Fields, every_term, search, split_negatives
from quaymark.operators.similarity import cosine, literal
from quaymark.plans.registry import query, table
from quaymark.plans.vectors import _vector

PICTURES = """f AS (SELECT p_partkey, p_name, p_type, 100 + (p_partkey % 37) * 50 AS w, CASE WHEN p_partkey % 19 = 0 THEN 0 ELSE 100 + (p_partkey % 23) * 60 END AS h,
CASE WHEN p_partkey % 4 = 0 THEN [] WHEN p_partkey % 4 = 1 THEN ['?' || split_part(p_name, ' ', 1)] WHEN p_partkey % 4 = 2 THEN ['?' || split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]
ELSE string_split(p_name, ' ') END AS tags, lower(p_name) || '/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' ELSE '.cr2' END AS path FROM part)"""


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, nth = F.split("p_name", " "), F.col("p_partkey") % 4
    unsure = F.concat(F.lit("?"), words[0])
    tags = F.when(nth == 0, F.array().cast("array<string>")).when(nth == 1, F.array(unsure)).when(nth == 2, F.array(unsure, words[1])).otherwise(words)
    suffix = F.element_at(F.array(F.lit(".JPG"), F.lit(".png"), F.lit(".cr2")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_type", (100 + (F.col("p_partkey") % 37) * 50).alias("w"),
        F.when(F.col("p_partkey") % 19 == 0, 0).otherwise(100 + (F.col("p_partkey") % 23) * 60).alias("h"),
        tags.alias("tags"), F.concat(F.lower("p_name"), F.lit("/"), F.col("p_partkey").cast("string"), suffix).alias("path"),
    )


def _found(spark: SparkSession, sf_dir: str, text: str, limit: int | None = None) -> DataFrame:
    raw = F.lower("path").endswith(".cr2")
    kinds = {"raw": raw, "photo": ~raw, "image": ~raw}

    def kind(value: str) -> Column:
        found = F.lit(False)
        for name in value.split("|"):
            found = found | kinds.get(name, F.lit(False))
        return found

    fields = Fields(
        key="p_partkey", tags=F.col("tags"), texts=(F.col("p_name"),), sides=(F.col("w"), F.col("h")), path=F.col("path"), handlers={"kind": kind},
        sorts={
            "pixels": F.col("w") * F.col("h"), "minside": F.least("w", "h"), "maxside": F.greatest("w", "h"), "ratio": F.try_divide(F.col("w").cast("double"), F.col("h")),
            "path": F.lower("path"), "filename": F.lower(F.substring_index("path", "/", -1)), "tags": F.size("tags"), "width": F.col("w"), "height": F.col("h"),
        },
    )
    return search(_pictures(spark, sf_dir), text, fields, limit).select("p_partkey")


UNSURE, SURE = "len(list_filter(tags, lambda t: starts_with(t, '?')))", "len(list_filter(tags, lambda t: NOT starts_with(t, '?')))"


@query(f"WITH {PICTURES} SELECT p_partkey FROM f WHERE len(tags) = 0")
def untagged_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "is:untagged")


@query(f"WITH {PICTURES} SELECT p_partkey FROM f WHERE {UNSURE} > 0 AND {SURE} = 0")
def unconfirmed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "is:tagged is:unconfirmed")


@query(f"WITH {PICTURES} SELECT p_partkey FROM f WHERE len(tags) > 0 AND NOT ({UNSURE} > 0)")
def confirmed_only_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "is:tagged -is:tagunconfirmed")


@query(f"WITH {PICTURES} SELECT p_partkey FROM f WHERE h > 0 AND (w / h BETWEEN 16 / 9 * 0.95 AND 16 / 9 * 1.05 OR w / h BETWEEN 1 / 1.05 AND 1.05 OR w / h > 3)")
def ratio_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "ratio:16:9|square|>3")


@query(f"WITH {PICTURES} SELECT p_partkey FROM f WHERE h > 0 AND w / h BETWEEN 1.05 AND 1e9 AND NOT (w / h BETWEEN 1.5::DOUBLE * (1 - 0.2::DOUBLE) AND 1.5::DOUBLE * (1 + 0.2::DOUBLE))")
def orientation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "orient:landscape -ratio:1.5~0.2")


@query(f"WITH {PICTURES} SELECT p_partkey FROM f WHERE w * h / 1e6 BETWEEN 0.5 AND 1.5 AND w * h > 600000")
def pixel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "mp:1.5..0.5 pixels:>600000")


@query(f"WITH {PICTURES} SELECT p_partkey FROM f WHERE (lower(path) LIKE '%.jpg' OR lower(path) LIKE '%.png') AND contains(lower(path), 'red') AND NOT contains(lower(path), 'ring')")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "ext:jpg|.png path:red -path:ring")


@query(f"WITH {PICTURES} SELECT p_partkey FROM f WHERE lower(path) LIKE '%.cr2'")
def raw_kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "kind:raw|nothing")


@query(f"WITH {PICTURES} SELECT p_partkey FROM f ORDER BY CASE WHEN h > 0 THEN w / h END DESC NULLS LAST, least(w, h), p_partkey LIMIT 60")
def shape_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "sort:-ratio sort:minside", 60)


@query(f"WITH {PICTURES} SELECT p_partkey FROM f ORDER BY len(tags) DESC, string_split(lower(path), '/')[-1], p_partkey LIMIT 60")
def name_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "sort:-tags sort:filename", 60)


@query("""WITH p AS (SELECT l_orderkey AS o, list(DISTINCT 's' || l_suppkey) AS names, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey FROM orders LEFT JOIN p ON o = o_orderkey WHERE (list_contains(names, 's1') OR list_contains(names, 's2')) AND NOT coalesce(list_contains(names, 's3'), false) AND coalesce(n, 0) >= 3""")
def people_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is on a photo, and how many are: suppliers stand for people."""
    people = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("people"))
    photos = table(spark, sf_dir, "orders").select("o_orderkey").join(people, "o_orderkey", "left")
    fields = Fields(key="o_orderkey", tags=F.array().cast("array<string>"), names={"name": F.col("people")}, numbers={"people": F.coalesce(F.size("people"), F.lit(0))})
    return search(photos, "name:s1|s2,-s3 people:>=3", fields).select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey = 3 OR s_acctbal > 9000)""")
def person_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person by id, or any favourite one."""
    liked = table(spark, sf_dir, "supplier").where("s_suppkey = 3 OR s_acctbal > 9000").select(F.col("s_suppkey").alias("l_suppkey"))
    seen = table(spark, sf_dir, "lineitem").join(liked, "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(seen, "o_orderkey", "left_semi")


@query("""SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE lower(r_name) = 'asia' AND lower(n_name) LIKE 'nation_1%' OR lower(r_name) = 'europe' AND FALSE""")
def location_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place with the place it lies in; an alias stands for the region's name."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    placed = table(spark, sf_dir, "customer").join(places, F.col("n_nationkey") == F.col("c_nationkey"))
    fields = Fields(key="c_custkey", tags=F.array().cast("array<string>"), places=F.array("n_name", "r_name"))
    return search(placed, 'location:"nation_1*, Asia"', fields).select("c_custkey")


FAVOURITES = "(SELECT o_custkey, max(o_orderdate) AS liked FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1)"


@query(f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM {FAVOURITES}) AND c_acctbal > 0")
def favourite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir, "fav:no balance:>0").select("c_custkey")


@query(f"SELECT c_custkey FROM customer LEFT JOIN {FAVOURITES} ON o_custkey = c_custkey ORDER BY liked DESC NULLS LAST, c_custkey LIMIT 80")
def favourite_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the time at which a user made them favourites, the others last."""
    return _customers(spark, sf_dir, "sort:-favorited", 80).select("c_custkey")


def _customers(spark: SparkSession, sf_dir: str, text: str, limit: int | None = None) -> DataFrame:
    liked = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("liked_at"))
    rows = table(spark, sf_dir, "customer").join(liked, "c_custkey", "left")
    fields = Fields(key="c_custkey", tags=F.array().cast("array<string>"), numbers={"balance": F.col("c_acctbal")}, flags={"fav": F.col("liked_at").isNotNull()}, sorts={"favorited": F.col("liked_at")})
    return search(rows, text, fields, limit)


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS cover FROM lineitem) WHERE l_linenumber = cover AND l_returnflag = 'R'""")
def stack_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covers of stacks of one kind: lines of an order are a stack."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    covers = lines.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    return lines.where("l_returnflag = 'R'").join(covers, ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber")


COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


@query(f"""WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id, a.label, {COS.format(a='a.v', b='p.v')} - 0.7 * {COS.format(a='a.v', b='n.v')} AS score FROM u a, u p, u n WHERE p.vec_id = 2 AND n.vec_id = 5),
t AS (SELECT least(max(score), greatest(0.05, avg(score) + stddev_pop(score), 0.75 * max(score))) AS cut, avg(score) + stddev_pop(score) AS mild FROM s)
SELECT vec_id FROM s, t WHERE score >= mild AND label <> 3""")
def about_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearness to a text as one condition among others; words behind a minus push away."""
    known = {"two": 2, "five": 5}
    wanted, turned = split_negatives("two -five")
    rows = table(spark, sf_dir, "embeddings")
    score = cosine(F.col("embedding"), literal(_vector(spark, sf_dir, known[wanted])))
    for word in turned:
        score = score - 0.7 * cosine(F.col("embedding"), literal(_vector(spark, sf_dir, known[word])))
    scored = rows.select("vec_id", "label", score.alias("score"))
    # the other side is one row
    cut = scored.agg((F.avg("score") + F.stddev_pop("score")).alias("cut"))
    return scored.crossJoin(F.broadcast(cut)).where("score >= cut AND label <> 3").select("vec_id")


@query("""SELECT page_id, CASE WHEN p LIKE '%example.com/%' THEN 'shop' WHEN p LIKE '%example.org/%' THEN 'wiki' END AS section FROM (SELECT page_id, url AS p FROM pages) WHERE p LIKE '%example.com/%' OR p LIKE '%example.org/%'""")
def section_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a library by the folders below which they lie."""
    section = F.when(F.contains("url", F.lit("example.com/")), "shop").when(F.contains("url", F.lit("example.org/")), "wiki")
    return table(spark, sf_dir, "pages").select("page_id", section.alias("section")).where("section IS NOT NULL")


@query("""SELECT c_custkey FROM customer WHERE (contains(lower(c_name), '1') OR contains(lower(c_mktsegment), '1')) AND (contains(lower(c_name), 'auto') OR contains(lower(c_mktsegment), 'auto'))
AND NOT regexp_matches(concat_ws(' ', c_name, c_mktsegment), '(?i)99|machin')""")
def browse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word in one of the columns, and none of the excluded patterns in all of them together."""
    columns = [F.col("c_name"), F.col("c_mktsegment")]
    kept = every_term("1 AUTO", columns) & ~F.concat_ws(" ", *columns).rlike("(?i)99|machin")
    return table(spark, sf_dir, "customer").where(kept).select("c_custkey")


@query("""WITH r(kind, value) AS (VALUES ('folder', 'https://m.'), ('tag', 'fr'), ('album', '7'))
SELECT DISTINCT page_id FROM pages, r WHERE kind = 'folder' AND starts_with(url, value) OR kind = 'tag' AND contains(url, '/' || value || '/') OR kind = 'album' AND (page_id % 100)::VARCHAR = value""")
def share_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any rule of a share admits: rules are folded into one condition, so no rows are paired with rules."""
    admits = {
        "folder": lambda v: F.startswith("url", F.lit(v)),
        "tag": lambda v: F.contains("url", F.lit(f"/{v}/")),
        "album": lambda v: (F.col("page_id") % 100).cast("string") == v,
    }
    condition = F.lit(False)
    for kind, value in (("folder", "https://m."), ("tag", "fr"), ("album", "7")):
        condition = condition | admits[kind](value)
    return table(spark, sf_dir, "pages").where(condition).select("page_id")


GROUPS = """g AS (SELECT o_custkey AS grp, count(*) AS files, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS days, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS placed FROM orders GROUP BY 1)"""


@query(f"WITH {GROUPS} SELECT grp, files >= 5 AND files <= 30 AND days >= 100 AND placed >= 0.3 AS kept FROM g")
def group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with enough files, days and places, and those dropped."""
    days = F.datediff(F.max("o_orderdate"), F.min("o_orderdate"))
    groups = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(
        F.count("*").alias("files"), days.alias("days"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("placed")
    )
    return groups.select("grp", F.expr("files >= 5 AND files <= 30 AND days >= 100 AND placed >= 0.3").alias("kept"))


@query("""WITH a AS (SELECT o_custkey AS grp, 'first' AS part FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT c_custkey AS grp, 'second' AS part FROM customer WHERE c_acctbal > 0)
SELECT grp, part FROM a UNION ALL SELECT grp, part FROM b WHERE grp NOT IN (SELECT grp FROM a)""")
def group_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of two sources by their ids; the first source wins."""
    first = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("grp"), F.lit(0).alias("nth"))
    second = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("grp"), F.lit(1).alias("nth"))
    best = first.union(second).groupBy("grp").agg(F.min("nth").alias("nth"))
    return best.select("grp", F.when(F.col("nth") == 0, "first").otherwise("second").alias("part"))


@query("""SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100) ORDER BY md5('7/' || o_orderkey), o_orderkey LIMIT 50""")
def recent_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the newest, by a seeded order."""
    newest = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)
    return _seeded(newest.select("o_orderkey"), "o_orderkey", 7, 50)


@query("SELECT p_partkey FROM part ORDER BY md5('3/' || p_partkey), p_partkey LIMIT 40")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeded(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 3, 40)


def _seeded(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), key).limit(n)


@query("""SELECT p_partkey FROM part WHERE ('0x' || substr(md5('11/' || p_partkey), 1, 8))::BIGINT / 4294967296.0 < [0.1, 0.3, 0.5, 0.8, 1.0][p_size % 5 + 1]""")
def radio_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks kept with odds by their stars, the same for a seed."""
    odds = F.element_at(F.array(*[F.lit(x) for x in (0.1, 0.3, 0.5, 0.8, 1.0)]), F.col("p_size") % 5 + 1)
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit("11/"), F.col("p_partkey").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return table(spark, sf_dir, "part").where(drawn < odds).select("p_partkey")


@query("""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS slot FROM part WHERE p_size = 10),
m AS (SELECT p_partkey, slot, row_number() OVER (ORDER BY slot) AS nth, row_number() OVER (ORDER BY p_partkey DESC) AS wish FROM p WHERE p_partkey % 3 = 0)
SELECT p.p_partkey, coalesce(to_.slot, p.slot) AS slot FROM p LEFT JOIN m ON m.p_partkey = p.p_partkey LEFT JOIN m to_ ON to_.nth = m.wish""")
def manual_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed members take, in their new order, the slots that they already hold; an album is the unit that is ordered."""
    album = table(spark, sf_dir, "part").where("p_size = 10").select("p_size", "p_partkey")
    placed = album.withColumn("slot", F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")))
    listed = placed.where("p_partkey % 3 = 0")
    mine, wish = Window.partitionBy("p_size").orderBy("slot"), Window.partitionBy("p_size").orderBy(F.desc("p_partkey"))
    slots = listed.select("p_size", F.row_number().over(mine).alias("nth"), F.col("slot").alias("new"))
    moved = listed.select("p_size", "p_partkey", F.row_number().over(wish).alias("nth")).join(slots, ["p_size", "nth"]).select("p_partkey", "new")
    return placed.join(moved, "p_partkey", "left").select("p_partkey", F.coalesce("new", "slot").cast("long").alias("slot"))


@query("""SELECT p_partkey FROM part ORDER BY (p_size % 7 = 0), p_brand DESC, p_name, p_partkey LIMIT 70""")
def music_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first key takes the direction; what lacks it stays last, and ties always rise."""
    return table(spark, sf_dir, "part").orderBy(F.col("p_size") % 7 == 0, F.desc("p_brand"), "p_name", "p_partkey").limit(70).select("p_partkey")
