"""Joins, aggregates, windows, sets and field functions over orders, parts and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.operators.boxes import BOX
from quaymark.plans.regions import SQL_BOXES, _boxes
from quaymark.plans.registry import query, table
from quaymark.sources.shared import new_path


@query("""SELECT c_custkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderstatus = 'O' AND c_acctbal < 0 AND o_custkey % 3 = 0 GROUP BY ALL""")
def approximate_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables, kept where the exact value is missing."""
    lost = table(spark, sf_dir, "customer").where("c_acctbal < 0 AND c_custkey % 3 = 0")
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    named = lost.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return named.join(held, "c_custkey", "left_semi").select("c_custkey", "n_name")


@query("""SELECT c_custkey FROM customer WHERE c_acctbal > 500 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1998-03-01')
AND (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) < TIMESTAMP '1999-01-01'""")
def due_watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watches whose time has come, but for those that wait in the queue already."""
    orders = table(spark, sf_dir, "orders")
    last = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"), F.max((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") >= F.lit("1998-03-01").cast("timestamp"))).alias("waits"))
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 500")
    return rich.join(last, "c_custkey").where("last < TIMESTAMP '1999-01-01' AND NOT waits").select("c_custkey")


@query("""SELECT doc_id, quality, n_chars, hit FROM labels JOIN documents USING (doc_id) LEFT JOIN (SELECT doc_id, true AS hit FROM documents WHERE n_chars > 3000) USING (doc_id)""")
def rated_with_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables by their shared key, and a third where it has a row."""
    documents = table(spark, sf_dir, "documents")
    cache = documents.where("n_chars > 3000").select("doc_id", F.lit(True).alias("hit"))
    return table(spark, sf_dir, "labels").join(documents.select("doc_id", "n_chars"), "doc_id").join(cache, "doc_id", "left").select("doc_id", "quality", "n_chars", "hit")


@query("""WITH t AS (SELECT o_orderkey, 'nation_' || (o_orderkey % 30) AS typed FROM orders), d AS (SELECT lower(n_name) AS name, n_nationkey AS k FROM nation UNION ALL SELECT 'nation_7', 21),
m AS (SELECT name, min(k) AS k, max(k) - min(k) AS apart FROM d GROUP BY 1)
SELECT o_orderkey, CASE WHEN apart <= 3 THEN k END AS place FROM t LEFT JOIN m ON name = typed""")
def typed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed names against a dimension; a name of places too far apart is none."""
    nations = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("typed"), F.col("n_nationkey").alias("k"))
    twice = table(spark, sf_dir, "nation").where("n_nationkey = 21").select(F.lit("nation_7").alias("typed"), F.col("n_nationkey").alias("k"))
    dimension = nations.union(twice).groupBy("typed").agg(F.min("k").alias("k"), (F.max("k") - F.min("k")).alias("apart"))
    wanted = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("nation_"), (F.col("o_orderkey") % 30).cast("string")).alias("typed"))
    return wanted.join(dimension, "typed", "left").select("o_orderkey", F.when(F.col("apart") <= 3, F.col("k")).alias("place"))


INSIDE = "x.cx BETWEEN y.cx - y.w / 2 AND y.cx + y.w / 2 AND x.cy BETWEEN y.cy - y.h / 2 AND y.cy + y.h / 2"
OVER = """greatest(least(x.cx + x.w / 2, y.cx + y.w / 2) - greatest(x.cx - x.w / 2, y.cx - y.w / 2), 0) * greatest(least(x.cy + x.h / 2, y.cy + y.h / 2) - greatest(x.cy - x.h / 2, y.cy - y.h / 2), 0) / (x.w * x.h)"""


@query(f"""WITH {SQL_BOXES}, s AS (SELECT x.key AS line, y.key AS panel, y.line AS nth, {INSIDE} AS inside, {OVER} AS part FROM b x JOIN b y ON x.image = y.image AND x.line % 2 = 1 AND y.line % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY inside DESC, CASE WHEN inside THEN nth END, part DESC, nth) AS rn FROM s WHERE inside OR part > 0.05)
SELECT b.key AS line, coalesce(r.panel, -1)::BIGINT AS panel FROM b LEFT JOIN r ON r.line = b.key AND rn = 1 WHERE b.line % 2 = 1""")
def lines_in_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line belongs to the first panel that holds its middle, else to the one that covers most of it."""
    boxes = _boxes(spark, sf_dir)
    x = boxes.where("line % 2 = 1").select("image", F.col("key").alias("line"), *[F.col(c).alias(f"x_{c}") for c in BOX])
    y = boxes.where("line % 2 = 0").select("image", F.col("key").alias("panel"), F.col("line").alias("nth"), *[F.col(c).alias(f"y_{c}") for c in BOX])
    within = lambda c, s: F.col(f"x_{c}").between(F.col(f"y_{c}") - F.col(f"y_{s}") / 2, F.col(f"y_{c}") + F.col(f"y_{s}") / 2)
    edge = lambda o, c, s, sign: F.col(f"{o}_{c}") + sign * F.col(f"{o}_{s}") / 2
    shared = lambda c, s: F.greatest(F.least(edge("x", c, s, 1), edge("y", c, s, 1)) - F.greatest(edge("x", c, s, -1), edge("y", c, s, -1)), F.lit(0.0))
    part = shared("cx", "w") * shared("cy", "h") / (F.col("x_w") * F.col("x_h"))
    scored = x.join(y, "image").select("line", "panel", "nth", (within("cx", "w") & within("cy", "h")).alias("inside"), part.alias("part")).where("inside OR part > 0.05")
    # the least of (outside, place or 0, uncovered, place) is the panel
    key = F.struct((~F.col("inside")).alias("out"), F.when(F.col("inside"), F.col("nth")).alias("first"), (-F.col("part")).alias("bare"), "nth", "panel")
    best = scored.groupBy("line").agg(F.min(key).alias("best"))
    return x.select("line").join(best, "line", "left").select("line", F.coalesce("best.panel", F.lit(-1)).cast("long").alias("panel"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS comments, count(*) FILTER (event_type = 'view') AS likes, count(*) FILTER (event_type = 'view' AND event_id % 2 = 0) AS mine,
epoch_us(max(ts)) AS last FROM events GROUP BY 1""")
def engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind == "click").alias("comments"), F.count_if(kind == "view").alias("likes"), F.count_if((kind == "view") & (F.col("event_id") % 2 == 0)).alias("mine"), F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("last"),
    )


@query("""WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, arg_max(l_linenumber, n * 1000 - l_linenumber) AS width, max(n) AS n FROM c GROUP BY 1""")
def dominant_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common width of each model, the smaller one of equals."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", (-F.col("l_linenumber")).alias("less"))).alias("top")
    return counts.groupBy("l_returnflag").agg(top).select("l_returnflag", (-F.col("top.less")).alias("width"), F.col("top.n").alias("n"))


@query("""SELECT event_type, count(*) AS runs, round(avg(value), 6) AS mean, max(value) AS slowest FROM events GROUP BY 1""")
def job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("runs"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("slowest"))


@query("SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 15")
def slowest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(15).select("event_id", "event_type", "value")


@query("SELECT DISTINCT strftime(o_orderdate, '%Y') AS year FROM orders")
def distinct_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy").alias("year")).distinct()


@query("""WITH n AS (SELECT l_suppkey, l_returnflag AS tag, min(l_orderkey * 10 + l_linenumber) AS met FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, (SELECT string_agg(tag, ',' ORDER BY met, tag) FROM n WHERE n.l_suppkey = s.l_suppkey) AS tags, max(len(p_name)) AS longest FROM lineitem s JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def best_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the notes on a thing, each tag once in the order met, and the length of the longest text."""
    lines = table(spark, sf_dir, "lineitem")
    first = lines.groupBy("l_suppkey", "l_returnflag").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    tags = first.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct("at", "l_returnflag"))).alias("t")).select("l_suppkey", F.array_join("t.l_returnflag", ",").alias("tags"))
    longest = lines.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("l_suppkey").agg(F.max(F.length("p_name")).cast("long").alias("longest"))
    return tags.join(longest, "l_suppkey")


@query("SELECT user_id, epoch_us(max(ts)) AS played FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1")
def recent_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "events").where("ts >= TIMESTAMP '2024-01-10'")
    return late.groupBy("user_id").agg(F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("played"))


@query("""SELECT o_orderstatus, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS held, count(*) FILTER (o_orderdate < TIMESTAMP '1995-01-01') AS swept FROM orders GROUP BY 1""")
def retention_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("held"), F.count_if(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")).alias("swept")
    )


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus)::INTEGER AS g1, grouping(o_orderpriority)::INTEGER AS g2 FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def status_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority")
    return cube.agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("int").alias("g1"), F.grouping("o_orderpriority").cast("int").alias("g2"))


@query("SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY GROUPING SETS ((n_regionkey, n_nationkey), (n_regionkey), ())")
def place_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return placed.rollup("n_regionkey", "n_nationkey").agg(F.sum("c").alias("n"))


@query("SELECT event_type, true AS near FROM events GROUP BY 1")
def sketch_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a sketch of the distinct users of each kind is within a tenth of the exact number."""
    # pairs first: beside a distinct count each pair would hold a sketch of its own
    pairs = table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    both = pairs.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"), F.count("user_id").alias("exact"))
    return both.select("event_type", (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))


@query("""SELECT o_custkey, max(n)::BIGINT + 1 AS next_seq FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1""")
def next_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that the next entry of each history gets."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count("*") + 1).alias("next_seq"))


@query("""SELECT o_orderkey, dense_rank() OVER w::INTEGER AS dense, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS quarter,
lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def order_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, by_priority = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.dense_rank().over(by_priority).alias("dense"), F.ntile(4).over(own).alias("quarter"), F.lead("o_orderkey").over(own).alias("after"),
        F.round(F.avg("o_totalprice").over(own.rowsBetween(-2, 0)), 4).alias("moving"),
    )


@query("""(SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49""")
def returned_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda condition: table(spark, sf_dir, "lineitem").where(condition).select("l_partkey")
    return of("l_returnflag = 'R'").intersect(of("l_returnflag = 'A'")).subtract(of("l_quantity > 49"))


@query("""SELECT user_id, event_type AS name, CASE WHEN event_type IN ('view', 'click') THEN 'd_original' WHEN event_type = 'signup' THEN 'd_digitized' ELSE 'd_modified' END AS bucket,
epoch_us(CASE WHEN event_type IN ('view', 'click', 'signup') THEN min(ts) ELSE max(ts) END) AS at FROM events GROUP BY 1, 2""")
def date_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of date fields by what they mean; the earliest date counts, for changes the latest."""
    kind = F.col("event_type")
    bucket = F.when(kind.isin("view", "click"), "d_original").when(kind == "signup", "d_digitized").otherwise("d_modified")
    ends = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.first(bucket).alias("bucket"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    at = F.when(F.col("bucket") == "d_modified", F.col("high")).otherwise(F.col("low")).cast("timestamp")
    return ends.select("user_id", "name", "bucket", F.unix_micros(at).alias("at"))


def slug(text: Column) -> Column:
    """Lower case, with one dash for each run of other characters."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y/%m') || '/' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') || '/' || lpad(o_orderkey::VARCHAR, 8, '0') AS place FROM orders""")
def storage_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a template puts each file: year and month, the slug of a field, a padded number."""
    place = F.concat_ws("/", F.date_format("o_orderdate", "yyyy/MM"), slug(F.col("o_orderpriority")), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", place.alias("place"))


@query("""WITH k AS (SELECT user_id, epoch_us(ts) AS t, value AS x, lead(epoch_us(ts)) OVER w AS t2, lead(value) OVER w AS x2, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, t, CASE WHEN event_type <> 'error' AND t2 > t THEN round(x + (x2 - x) * ((t + t2) // 2 - t) / (t2 - t), 4) END AS middle FROM k""")
def keyframe_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box between its keyframes; none after one that leaves the picture, nor beyond the last."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    k = table(spark, sf_dir, "events").select("user_id", "event_type", t.alias("t"), F.col("value").alias("x"), F.lead(t).over(w).alias("t2"), F.lead("value").over(w).alias("x2"))
    at = F.floor((F.col("t") + F.col("t2")) / 2)
    middle = F.when((F.col("event_type") != "error") & (F.col("t2") > F.col("t")), F.round(F.col("x") + (F.col("x2") - F.col("x")) * (at - F.col("t")) / (F.col("t2") - F.col("t")), 4))
    return k.select("user_id", "t", middle.alias("middle"))


@query("""WITH c AS (SELECT event_id, (event_id % 90)::INTEGER AS d, (event_id % 60)::INTEGER AS m FROM events)
SELECT event_id, round((CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * (d + m / 60.0), 6)::DOUBLE AS lat, (CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(d * 2 + 0.5, 6) END)::DOUBLE AS lon FROM c""")
def parsed_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees and minutes with a side, and signed ISO 6709 text, read back; what is beyond the globe is none."""
    n = F.col("event_id")
    side = F.when(n % 2 == 0, "N").otherwise("S")
    text = F.concat((n % 90).cast("string"), F.lit(","), (n % 60).cast("string"), side)
    iso = F.concat(F.lit("+"), F.when(n % 7 == 0, F.lit("999.5")).otherwise(F.concat((n % 90 * 2).cast("string"), F.lit(".5"))), F.lit("/"))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("text"), iso.alias("iso"))
    number = lambda c, pattern: F.regexp_extract(c, pattern, 1).cast("double")
    lat = (number("text", r"^(\d+),") + number("text", r",(\d+)") / 60) * F.when(F.col("text").endswith("S"), -1).otherwise(1)
    lon = number("iso", r"^([+-]\d+(?:\.\d+)?)/$")
    return rows.select("event_id", F.round(lat, 6).alias("lat"), F.when(F.abs(lon) <= 180, F.round(lon, 6)).alias("lon"))


@query("""SELECT name, regexp_replace(name, '_[0-9]+$', '') AS stem, count(*) AS n FROM (SELECT replace(lower(p_name), ' ', '_') || '_' || (p_partkey % 3) AS name FROM part) GROUP BY 1, 2""")
def name_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without the number of a copy."""
    name = F.concat_ws("_", F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")), (F.col("p_partkey") % 3).cast("string"))
    return table(spark, sf_dir, "part").select(name.alias("name")).groupBy("name", F.regexp_replace("name", "_[0-9]+$", "").alias("stem")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, len(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g'), '(?i)</?(?:nav|ul|li|div|footer|article|head|html|body|meta|title)\b[^>]*>', '', 'g'), '(?i)\s+(?:on[a-z]+|style|class|href)="[^"]*"', '', 'g'))::BIGINT AS kept FROM pages""")
def sanitised_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts go with what is in them, other tags alone, and attributes that can run or fetch."""
    clean = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)>", "")
    clean = F.regexp_replace(clean, r"(?i)</?(?:nav|ul|li|div|footer|article|head|html|body|meta|title)\b[^>]*>", "")
    clean = F.regexp_replace(clean, r'(?i)\s+(?:on[a-z]+|style|class|href)="[^"]*"', "")
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(clean).cast("long").alias("kept"))


@query("""SELECT page_id, len(regexp_extract(html, '(?is)<article>(.*)</article>', 1))::BIGINT AS inner_chars FROM pages""")
def between_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text between a start and an end marker."""
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(F.regexp_extract("html", "(?is)<article>(.*)</article>", 1)).cast("long").alias("inner_chars"))


@query("""SELECT event_id, CASE WHEN k % 2 = 0 THEN k END AS up, CASE WHEN k % 2 = 1 THEN k END AS down FROM (SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events)""")
def engagement_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of tags such as ``score_up: 12``."""
    k = F.get_json_object("props", "$.k").cast("int")
    tags = F.concat(F.when(k % 2 == 0, "score_up: ").otherwise("score_down: "), k.cast("string"))
    number = lambda name: F.regexp_extract(F.col("tag"), rf"^{name}:\s*(\d+)$", 1)
    found = table(spark, sf_dir, "events").select("event_id", tags.alias("tag"))
    return found.select("event_id", *[F.when(number(f"score_{x}") != "", number(f"score_{x}")).cast("int").alias(x) for x in ("up", "down")])


@query("""SELECT p_partkey, regexp_extract(p_name, '^(\\w+)', 1) || ' of ' || p_brand AS text, CASE WHEN p_size >= 25 THEN 'large' WHEN contains(p_name, 'red') THEN 'red' ELSE 'other' END AS gate,
NOT (p_name = '' OR lower(p_type) IN ('no', 'false', '0', 'none', 'null')) AS truthy FROM part""")
def text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the text nodes of a graph do: match, fill in, compare, choose; and what counts as true."""
    word = F.regexp_extract("p_name", r"^(\w+)", 1)
    gate = F.when(F.col("p_size") >= 25, "large").when(F.contains("p_name", F.lit("red")), "red").otherwise("other")
    false = (F.col("p_name") == "") | F.lower("p_type").isin("no", "false", "0", "none", "null")
    return table(spark, sf_dir, "part").select("p_partkey", F.format_string("%s of %s", word, F.col("p_brand")).alias("text"), gate.alias("gate"), (~false).alias("truthy"))


@query("""WITH s AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 5 = 0 THEN '.tmp' WHEN p_partkey % 5 = 1 THEN '.xmp' ELSE '.jpg' END AS name, p_partkey % 5 AS k, p_name FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN 'temporary' WHEN k = 1 AND p_name NOT IN (SELECT p_name FROM s WHERE k > 1) THEN 'orphan' WHEN k = 1 THEN 'sidecar' ELSE 'fine' END AS state FROM s""")
def integrity_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporary names, and sidecars whose file is gone."""
    suffix = F.when(F.col("p_partkey") % 5 == 0, ".tmp").when(F.col("p_partkey") % 5 == 1, ".xmp").otherwise(".jpg")
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", suffix).alias("name")).withColumn("stem", F.regexp_replace("name", r"\.[a-z]+$", ""))
    whole = files.where("NOT endswith(name, '.tmp') AND NOT endswith(name, '.xmp')").select("stem").distinct().withColumn("here", F.lit(True))
    state = F.when(F.col("name").endswith(".tmp"), "temporary").when(~F.col("name").endswith(".xmp"), "fine").when(F.col("here"), "sidecar").otherwise("orphan")
    return files.join(whole, "stem", "left").select("p_partkey", state.alias("state"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity END AS per_px, CASE WHEN l_tax > 0 THEN l_extendedprice * 8 / (l_tax * 100) / 1e6 END AS mbit FROM lineitem""")
def bits_per_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = F.try_divide(F.col("l_extendedprice"), F.when(F.col("l_quantity") > 0, F.col("l_quantity")))
    rate = F.try_divide(F.col("l_extendedprice") * 8, F.when(F.col("l_tax") > 0, F.col("l_tax") * 100)) / 1e6
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", per.alias("per_px"), rate.alias("mbit"))


@query("""SELECT doc_id, CASE WHEN text IS NULL OR n_chars < 80 THEN 'reject' WHEN n_chars > 2000 AND contains(text, chr(10)) THEN 'accept' ELSE 'triage' END AS verdict FROM documents""")
def document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted, rejected or left to a person, by size and content."""
    small = F.col("text").isNull() | (F.col("n_chars") < 80)
    verdict = F.when(small, "reject").when((F.col("n_chars") > 2000) & F.contains("text", F.lit("\n")), "accept").otherwise("triage")
    return table(spark, sf_dir, "documents").select("doc_id", verdict.alias("verdict"))


@query("""SELECT doc_id FROM documents LEFT JOIN (SELECT doc_id, quality AS seen FROM labels) USING (doc_id) WHERE seen IS NULL OR abs(n_chars % 2 - seen) > 0.01""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental index takes up again: new rows, and those whose time has moved."""
    index = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("seen"))
    joined = table(spark, sf_dir, "documents").join(index, "doc_id", "left")
    return joined.where(F.col("seen").isNull() | (F.abs(F.col("n_chars") % 2 - F.col("seen")) > 0.01)).select("doc_id")


@query("SELECT 'doc' || doc_id || '.txt' AS filename, quality / 2.0 + 0.25 AS score FROM labels")
def label_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as a file of names and scores, replaced as a whole and read back."""
    path = new_path(spark, "label-file")
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), (F.col("quality") / 2.0 + 0.25).alias("score"))
    rows.limit(0).write.mode("overwrite").option("header", True).csv(path)
    rows.write.mode("overwrite").option("header", True).csv(path)
    return spark.read.schema("filename string, score double").option("header", True).csv(path)


@query("""WITH p AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30)
SELECT p_partkey, count(l_orderkey) AS sold FROM p LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def enriched_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of files first, and what is known of them joined to the page alone."""
    page = table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(30).select("p_partkey")
    sold = table(spark, sf_dir, "lineitem").join(F.broadcast(page), F.col("l_partkey") == F.col("p_partkey"), "left_semi").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("sold"))
    return page.join(sold, "p_partkey", "left").select("p_partkey", F.coalesce("sold", F.lit(0)).alias("sold"))
