"""Reading orders, eras, merged groups, block profiles, plans of groups, providers and selections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.operators.boxes import line_blocks, reading_order
from quaymark.operators.graph import connected_components
from quaymark.operators.neighbours import links_within
from quaymark.operators.windows import medians
from quaymark.plans.clusters import NEAR, unit_rows
from quaymark.plans.regions import SQL_BOXES, _boxes
from quaymark.plans.registry import query, table
from quaymark.sources.shared import stored


@query()
def panel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of each page by rows, and across within a row."""
    return reading_order(_boxes(spark, sf_dir), "image", "key")


@query(f"""WITH RECURSIVE {SQL_BOXES}, e AS (SELECT x.key AS a, y.key AS b FROM b x JOIN b y ON x.image = y.image
AND abs(x.cy - y.cy) - (x.h + y.h) / 2 < greatest(x.h, y.h) * 0.1 - 0.3 AND least(x.cx + x.w / 2, y.cx + y.w / 2) - greatest(x.cx - x.w / 2, y.cx - y.w / 2) > 0.2),
r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), m AS (SELECT node, min(root) AS component FROM r GROUP BY node),
k AS (SELECT image, coalesce(component, key) AS component, min(cy) AS y, min(cx) AS x FROM b LEFT JOIN m ON node = key GROUP BY 1, 2),
n AS (SELECT image, component, row_number() OVER (PARTITION BY image ORDER BY round(y, 2), x, component)::INTEGER AS block FROM k)
SELECT b.image, b.key, block FROM b LEFT JOIN m ON node = key JOIN n ON n.image = b.image AND n.component = coalesce(m.component, b.key)""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page that lie below each other are a block, however many lie between; blocks are numbered from the top."""
    return line_blocks(_boxes(spark, sf_dir))


@query(f"""WITH RECURSIVE {NEAR}, s AS (SELECT a, b FROM e JOIN u x ON x.vec_id = a JOIN u y ON y.vec_id = b WHERE x.label = y.label),
r(node, root) AS (SELECT a, a FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node), m AS (SELECT node, min(root) AS component FROM r GROUP BY node),
f AS (SELECT vec_id, label, coalesce(component, vec_id) AS era, (vec_id * 37) % 1000 AS epoch FROM u LEFT JOIN m ON node = vec_id),
d AS (SELECT label, era, median(epoch) AS middle FROM f GROUP BY ALL)
SELECT vec_id, label, (SELECT count(*) FROM d o WHERE o.label = f.label AND (o.middle, o.era) < (d.middle, d.era))::INTEGER AS era FROM f JOIN d USING (label, era)""")
def era_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's vectors by chains of near ones, the chains in the order of their middle times."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    owners = vectors.select("vec_id", "label")
    units = unit_rows(vectors, "vec_id", "embedding").join(owners.toDF("key", "cell"), "key")
    found = connected_components(stored(links_within(units.where("cell IS NOT NULL").select("cell", "key", "v"), 0.55), "era-links"), "a", "b")
    faces = unit_rows(vectors, "vec_id", "embedding").select(F.col("key").alias("vec_id")).join(owners, "vec_id").join(found, F.col("node") == F.col("vec_id"), "left")
    faces = stored(faces.select("vec_id", "label", F.coalesce("component", "vec_id").alias("chain"), (F.col("vec_id") * 37 % 1000).alias("epoch")), "eras")
    middles = medians(faces, "chain", "epoch", "vec_id", "middle").join(faces.select("chain", "label").distinct(), "chain")
    era = (F.row_number().over(Window.partitionBy("label").orderBy("middle", "chain")) - 1).alias("era")
    return faces.select("vec_id", "chain").join(middles.select("chain", "label", era), "chain").select("vec_id", "label", "era")


@query("""WITH RECURSIVE u AS (SELECT vec_id, label, vec_id // 10 AS run, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
x AS (SELECT label, run, min(vec_id) * 5 + run % 3 * 20 AS opens, max(vec_id) * 5 + run % 3 * 20 AS ends FROM u GROUP BY label, run),
y AS (SELECT label, run, list(s ORDER BY i) AS s FROM (SELECT label, run, i, sum(v[i]) AS s FROM (SELECT *, unnest(range(1, 65)) AS i FROM u) GROUP BY label, run, i) GROUP BY label, run),
g AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY opens, run) AS rn FROM x JOIN y USING (label, run)),
k(label, rn, run, head, s, ends) AS (SELECT label, rn, run, run, s, ends FROM g WHERE rn = 1 UNION ALL
SELECT label, rn, run, CASE WHEN j THEN head ELSE run END, CASE WHEN j THEN list_transform(range(1, 65), lambda i: ks[i] + gs[i]) ELSE gs END, CASE WHEN j THEN greatest(ke, ge) ELSE ge END FROM
(SELECT g.label, g.rn, g.run, k.head, k.s AS ks, g.s AS gs, k.ends AS ke, g.ends AS ge, g.opens - k.ends <= 72 AND list_dot_product(k.s, g.s) / sqrt(list_dot_product(k.s, k.s) * list_dot_product(g.s, g.s)) >= 0.2 AS j
FROM k JOIN g ON g.label = k.label AND g.rn = k.rn + 1))
SELECT label, run, head AS merged FROM k""")
def merged_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups next to each other in time and alike become one, which is compared as a whole with the next.

    A group is one row with the sum of its unit vectors; an owner's groups are read in order, and the fold holds one sum.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr("vec_id div 10").alias("run"), "embedding")
    shift = F.col("run") % 3 * 20
    spans = vectors.groupBy("label", "run").agg(F.min("vec_id").alias("least"), F.max("vec_id").alias("most"))
    spans = spans.select("label", "run", (F.col("least") * 5 + shift).alias("opens"), (F.col("most") * 5 + shift).alias("ends"))
    units = unit_rows(vectors, "vec_id", "embedding").join(vectors.select(F.col("vec_id").alias("key"), "label", "run"), "key")
    cells = units.select("label", "run", F.posexplode("v").alias("i", "x")).groupBy("label", "run", "i").agg(F.sum("x").alias("x"))
    sums = cells.groupBy("label", "run").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select("label", "run", F.col("s.x").alias("s"))
    groups = spans.join(sums, ["label", "run"])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, head, total, end = object(), None, None, None
        for frame in frames:
            heads = []
            for who, run, opens, ends, s in frame[["label", "run", "opens", "ends", "s"]].itertuples(index=False):
                s = np.asarray(s)
                alike = who == owner and opens - end <= 72 and float(total @ s) / np.sqrt((total @ total) * (s @ s)) >= 0.2
                head, total, end = (head, total + s, max(end, ends)) if alike else (run, s, ends)
                owner = who
                heads.append(head)
            yield frame[["label", "run"]].assign(merged=heads)

    return groups.repartition("label").sortWithinPartitions("label", "opens", "run").mapInPandas(fold, "label int, run long, merged long")


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, floor(value * 1000)::BIGINT * 1000 AS v FROM events),
n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), j AS (SELECT unnest(range(-3, 4)) AS j),
p AS (SELECT x.user_id AS a, j, x.user_id % 5 - 2 + j AS o, x.pos - greatest(0, -(x.user_id % 5 - 2 + j)) AS place, bit_count(xor(x.v, y.v)) AS bits
FROM s x, j, s y WHERE y.user_id = x.user_id + 1 AND y.pos = x.pos + x.user_id % 5 - 2 + j),
b AS (SELECT a, o, place // 64 AS block, count(*) AS n, avg(bits) / 32 AS ber FROM p GROUP BY ALL HAVING count(*) >= 8),
t AS (SELECT a, o, coalesce(sum(n) FILTER (ber < 0.35), 0) AS hit FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY hit DESC, o) AS rn FROM t)
SELECT a, a + 1 AS b, o AS "offset", round(hit / greatest(x.n, y.n), 6) AS score FROM r JOIN n x ON x.user_id = a JOIN n y ON y.user_id = a + 1 WHERE rn = 1""")
def block_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the longer sequence in blocks of 64 steps whose bits agree, at the best of seven offsets.

    Each step meets the one step that an offset names, so pairs of sequences are never multiplied out.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), (F.floor(F.col("value") * 1000) * 1000).alias("v"))
    steps = stored(steps, "steps")
    shift = F.col("a") % 5 - 2 + F.col("j")
    left = steps.toDF("a", "pa", "va").withColumn("j", F.explode(F.sequence(F.lit(-3), F.lit(3)))).withColumn("offset", shift)
    right = steps.toDF("b", "pb", "vb")
    met = left.join(right, (F.col("b") == F.col("a") + 1) & (F.col("pb") == F.col("pa") + F.col("offset")))
    block = F.floor((F.col("pa") - F.greatest(F.lit(0), -F.col("offset"))) / 64).alias("block")
    blocks = met.groupBy("a", "offset", block).agg(F.count("*").alias("n"), (F.avg(F.bit_count(F.col("va").bitwiseXOR(F.col("vb")))) / 32).alias("ber")).where("n >= 8")
    hits = blocks.groupBy("a", "offset").agg(F.sum(F.when(F.col("ber") < 0.35, F.col("n")).otherwise(0)).alias("hit"))
    best = hits.groupBy("a").agg(F.min(F.struct((-F.col("hit")).alias("less"), F.col("offset"))).alias("t")).select("a", (-F.col("t.less")).alias("hit"), "t.offset")
    sizes = steps.groupBy("user_id").agg(F.count("*").alias("n"))
    scored = best.join(sizes.toDF("a", "na"), "a").join(sizes.select((F.col("user_id") - 1).alias("a"), F.col("n").alias("nb")), "a")
    return scored.select("a", (F.col("a") + 1).alias("b"), "offset", F.round(F.col("hit") / F.greatest("na", "nb"), 6).alias("score"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
g AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS z, any_value(n) AS n, coalesce(min(o_orderkey) FILTER (o_totalprice > 0 AND best = 1), min(o_orderkey) FILTER (rn = n // 2)) AS cover
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, rn) AS best FROM m) GROUP BY 1)
SELECT 'album' AS op, o_custkey AS "group", c_name || ' ' || year(a) AS album, n AS files, strftime(a, '%Y-%m-%d') AS opens, strftime(z, '%Y-%m-%d') AS ends, cover FROM g JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'tag', o_custkey, 'large', n, strftime(a, '%Y-%m-%d'), strftime(z, '%Y-%m-%d'), cover FROM g WHERE n >= 12""")
def group_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be done with each group, as rows: an album with its best member as cover, and a tag for large groups."""
    own = Window.partitionBy("o_custkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    placed = orders.withColumns({"rn": F.row_number().over(own.orderBy("o_orderdate", "o_orderkey")) - 1, "n": F.count("*").over(own)})
    best = F.min(F.when(F.col("o_totalprice") > 0, F.struct((-F.col("o_totalprice")).alias("less"), "rn", "o_orderkey")))
    middle = F.min(F.when(F.expr("rn = n div 2"), F.col("o_orderkey")))
    groups = placed.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"), F.max("n").alias("files"), F.coalesce(best["o_orderkey"], middle).alias("cover"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    facts = [F.col("files"), day("a").alias("opens"), day("z").alias("ends"), F.col("cover")]
    # one row for each group, and at most two entries of it
    made = F.array(F.struct(F.lit("album").alias("op"), F.concat_ws(" ", "c_name", F.year("a").cast("string")).alias("album")))
    tagged = F.array(F.struct(F.lit("tag").alias("op"), F.lit("large").alias("album")))
    entries = F.when(F.col("files") >= 12, F.concat(made, tagged)).otherwise(made)
    return groups.join(names, "o_custkey").select(F.col("o_custkey").alias("group"), F.inline(entries), *facts).select("op", "group", "album", "files", "opens", "ends", "cover")


Provider = Callable[[SparkSession, str, str], DataFrame]
#: Named sources of search results besides the files, each with rows ``id, title``.
PROVIDERS: dict[str, Provider] = {}


def provider(kind: str) -> Callable[[Provider], Provider]:
    """Adds a source of search results; its rows carry its name as their kind."""

    def add(function: Provider) -> Provider:
        PROVIDERS[kind] = function
        return function

    return add


@provider("part")
def _parts(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains(text)).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))


@provider("nation")
def _nations(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return table(spark, sf_dir, "nation").where(F.lower("n_name").contains(text)).select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"))


@provider("page")
def _pages(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.lower("url").contains(text)).select(F.col("page_id").alias("id"), F.col("url").alias("title"))


@query("""SELECT 'part' AS kind, p_partkey AS id, p_name AS title FROM part WHERE contains(lower(p_name), 'in') UNION ALL
SELECT 'nation', n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'in') UNION ALL SELECT 'page', page_id, url FROM pages WHERE contains(lower(url), 'in')""")
def provided_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every registered provider finds for a word."""
    found = [p(spark, sf_dir, "in").select(F.lit(kind).alias("kind"), "id", "title") for kind, p in PROVIDERS.items()]
    return reduce(DataFrame.unionByName, found)


Strategy = Callable[[DataFrame, int], DataFrame]


def _recent(pool: DataFrame, n: int) -> DataFrame:
    return pool.orderBy(F.desc("made"), "key").limit(n)


def _random(pool: DataFrame, n: int) -> DataFrame:
    return pool.orderBy(F.md5(F.concat(F.lit("7/"), F.col("key").cast("string"))), "key").limit(n)


def _by_kind(pool: DataFrame, n: int) -> DataFrame:
    """Kinds in turn, the newest of each first."""
    turn = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("made"), "key"))
    return pool.withColumn("turn", turn).orderBy("turn", "kind", "key").limit(n).drop("turn")


#: Ways to pick training rows from a pool of ``key, made, kind``; ``farthest_sample`` is the one by vectors.
STRATEGIES: dict[str, Strategy] = {"recent": _recent, "random": _random, "by_kind": _by_kind}


@query("""WITH p AS (SELECT o_orderkey AS key, o_orderdate AS made, o_orderpriority AS kind FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
t AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY made DESC, key) AS turn FROM p)
SELECT * FROM (SELECT 'recent' AS strategy, key FROM p ORDER BY made DESC, key LIMIT 40) UNION ALL SELECT * FROM (SELECT 'random', key FROM p ORDER BY md5('7/' || key), key LIMIT 40)
UNION ALL SELECT * FROM (SELECT 'by_kind', key FROM t ORDER BY turn, kind, key LIMIT 40)""")
def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty rows by each strategy, from those that no set holds yet."""
    held = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    pool = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("made"), F.col("o_orderpriority").alias("kind")).join(held, "key", "left_anti")
    return reduce(DataFrame.unionByName, [pick(pool, 40).select(F.lit(name).alias("strategy"), "key") for name, pick in STRATEGIES.items()])
