"""Counts, joins, timelines and sets behind browse pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.functions.text import chunks, first_heading, plain_html, sort_title
from quaymark.operators.groups import ancestors, both_ways, tree_totals
from quaymark.operators.similarity import wilson
from quaymark.operators.windows import as_of, delays, latest, medians, ranked, sessions, spaced_samples, suppressed
from quaymark.plans.registry import query, table
from quaymark.streaming.streams import deduplicated, drained, file_stream, pending, suppressed_within, windowed_counts


@query("""SELECT c_custkey, c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def album_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each album, empty albums kept."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that still lack a result."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""SELECT d.doc_id, coalesce(l.quality, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) AS rating,
l.doc_id IS NULL AND n_chars > 500 AS pending FROM documents d LEFT JOIN labels l USING (doc_id)""")
def rating_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's rating, else the computed one, and whether one is due."""
    labels = table(spark, sf_dir, "labels").withColumn("rated", F.lit(True))
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    computed = F.when(F.col("n_chars") > 2000, 1).otherwise(0)
    return joined.select("doc_id", F.coalesce("quality", computed).alias("rating"), (F.col("rated").isNull() & (F.col("n_chars") > 500)).alias("pending"))


@query("""SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name) HAVING r_name IS NOT NULL""")
def place_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each place and of the places in it; customers are counted before the join."""
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = counts.join(places, "n_nationkey")
    return joined.rollup("r_name", "n_name").agg(F.sum("n").alias("n")).where("r_name IS NOT NULL")


@query("""WITH p AS (SELECT regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages),
c AS (SELECT path, count(*) AS n, string_split(path, '/') AS parts FROM p WHERE path IS NOT NULL GROUP BY path),
e AS (SELECT array_to_string(parts[1:i], '/') AS node, path, n FROM (SELECT path, n, parts, unnest(range(1, len(parts) + 1)) AS i FROM c))
SELECT node, sum(CASE WHEN node = path THEN n ELSE 0 END)::BIGINT AS direct, sum(n)::BIGINT AS total FROM e GROUP BY node""")
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and total counts of each folder of the pages' paths."""
    return tree_totals(table(spark, sf_dir, "pages"), F.regexp_extract("url", "://([^?#]*)", 1))


@query("""WITH e AS (SELECT p_partkey, array_to_string(string_split(lower(p_type), ' ')[1:i], '/') AS node
FROM (SELECT *, unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS i FROM part))
SELECT node, count(DISTINCT p_partkey) AS n FROM e GROUP BY node""")
def tag_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct files at and below each node of a tree of tags."""
    path = F.replace(F.lower("p_type"), F.lit(" "), F.lit("/"))
    return table(spark, sf_dir, "part").select(F.explode(ancestors(path)).alias("node"), "p_partkey").groupBy("node").agg(F.countDistinct("p_partkey").alias("n"))


@query("""SELECT coalesce(strftime(o_orderdate, '%Y-%m'), 'undated') AS bucket, count(*) AS n FROM orders GROUP BY ALL""")
def timeline_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.coalesce(F.date_format("o_orderdate", "yyyy-MM"), F.lit("undated"))
    return table(spark, sf_dir, "orders").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS bucket, o_orderdate FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY o_orderdate DESC, o_orderkey) - 1 AS rn, count(*) OVER (PARTITION BY bucket) AS c FROM b)
SELECT o_orderkey, bucket FROM n WHERE rn % greatest(1, c // 4) = 0 AND rn // greatest(1, c // 4) < 4""")
def timeline_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four evenly spaced files of each month."""
    dated = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM").alias("bucket"))
    return spaced_samples(dated, "bucket", [F.desc("o_orderdate"), F.asc("o_orderkey")], 4).select("o_orderkey", "bucket")


@query("""WITH d AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderdate FROM orders WHERE strftime(o_orderdate, '%m-%d') IN ('06-14', '06-15', '06-16')),
n AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY o_orderdate DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY y) AS c FROM d)
SELECT o_orderkey, y::INTEGER AS y, c AS in_year FROM n WHERE rn <= 5 AND c >= 2""")
def memories_on_this_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days around one date in all years: up to five files a year, of years with two or more."""
    near = table(spark, sf_dir, "orders").where(F.date_format("o_orderdate", "MM-dd").isin("06-14", "06-15", "06-16")).withColumn("y", F.year("o_orderdate"))
    w = Window.partitionBy("y")
    ranked = near.withColumns({"rn": F.row_number().over(w.orderBy(F.desc("o_orderdate"), "o_orderkey")), "in_year": F.count("*").over(w)})
    return ranked.where("rn <= 5 AND in_year >= 2").select("o_orderkey", "y", "in_year")


@query("""SELECT p_brand, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_orders, round(sum(coalesce(l_quantity, 0)), 2) AS quantity,
max(l_shipdate) AS last_ship, min(CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS first_returned, min(nullif(p_name, '')) AS cover
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def entity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several measures of each artist in one pass over the facts."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("p_brand").agg(
        F.count("*").alias("n_lines"),
        F.countDistinct("l_orderkey").alias("n_orders"),
        F.round(F.sum(F.coalesce("l_quantity", F.lit(0.0))), 2).alias("quantity"),
        F.max("l_shipdate").alias("last_ship"),
        F.min(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("first_returned"),
        F.min(F.nullif("p_name", F.lit(""))).alias("cover"),
    )


@query("""SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT (o_custkey, o_orderstatus)) AS pairs,
count(DISTINCT o_orderpriority) AS priorities, round(sum(o_totalprice), 2) AS total FROM orders""")
def global_distincts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(
        F.countDistinct("o_custkey").alias("customers"),
        F.countDistinct(F.struct("o_custkey", "o_orderstatus")).alias("pairs"),
        F.countDistinct("o_orderpriority").alias("priorities"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
    )


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c)
SELECT user_id, event_type, n FROM r WHERE rn = 1""")
def mode_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    ranked = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return counts.withColumn("rn", F.row_number().over(ranked)).where("rn = 1").drop("rn")


@query("""SELECT count(*) FILTER (quality = 0) AS low, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 1 AND toxic = 0) AS clean,
count(*) AS total FROM labels""")
def review_queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").agg(
        F.count_if(F.expr("quality = 0")).alias("low"), F.count_if(F.expr("toxic = 1")).alias("toxic"), F.count_if(F.expr("quality = 1 AND toxic = 0")).alias("clean"), F.count("*").alias("total")
    )


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT * FROM (SELECT o_orderkey AS id, o_totalprice AS price, 'order' AS kind FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT p_partkey, p_retailprice, 'part' FROM part) ORDER BY price DESC NULLS LAST, kind, id LIMIT 100""")
def archive_union_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page over two kinds of rows."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.lit("order").alias("kind"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.lit("part").alias("kind"))
    return orders.unionByName(parts).orderBy(F.col("price").desc_nulls_last(), "kind", "id").limit(100)


@query("""SELECT l_suppkey AS a, l_partkey AS b FROM lineitem UNION SELECT l_partkey, l_suppkey FROM lineitem""")
def exclusion_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners in both directions, each pair once."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    return both_ways(lines, "a", "b")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE rn = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each key."""
    return latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT coalesce(c_nationkey, s_nationkey) AS nation, CASE WHEN s IS NULL THEN 'new' WHEN c IS NULL THEN 'dropped' WHEN c <> s THEN 'changed' ELSE 'same' END AS state
FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 5000 GROUP BY 1) FULL JOIN
(SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey""")
def desired_against_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a full outer join finds new, changed, dropped or the same."""
    wanted = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    current = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    state = F.when(F.col("s").isNull(), "new").when(F.col("c").isNull(), "dropped").when(F.col("c") != F.col("s"), "changed").otherwise("same")
    return wanted.join(current, F.col("c_nationkey") == F.col("s_nationkey"), "full").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), state.alias("state"))


@query("""WITH g AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session HAVING count(*) >= 2""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without a gap of over six hours, of two events or more."""
    found = sessions(table(spark, sf_dir, "events"), "user_id", "ts", 21_600, "event_id")
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).where("n >= 2")


@query("""WITH d AS (SELECT *, epoch_ms(lead(ts) OVER w) - epoch_ms(ts) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CASE WHEN d > 0 THEN least(greatest(d, 40), 1000) WHEN d IS NOT NULL THEN 100 END AS b FROM d)
SELECT event_id, coalesce(b, lag(b) OVER (PARTITION BY user_id ORDER BY ts, event_id), 100)::BIGINT AS delay FROM b""")
def frame_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delays(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", F.col("delay").cast("long").alias("delay"))


SUPPRESSED = """WITH RECURSIVE e AS (SELECT event_id, ts, user_id || '/' || event_type AS key, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
k(key, rn, ts, event_id) AS (SELECT key, rn, ts, event_id FROM e WHERE rn = 1 UNION ALL
SELECT key, rn, ts, event_id FROM (SELECT e.key, e.rn, e.ts, e.event_id, row_number() OVER (PARTITION BY e.key ORDER BY e.rn) AS x FROM k JOIN e ON e.key = k.key AND e.rn > k.rn AND e.ts >= k.ts + INTERVAL 24 HOUR) WHERE x = 1)
SELECT event_id, key FROM k"""


@query(SUPPRESSED)
def alert_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a kind at least a day after the last kept one of their user."""
    keyed = table(spark, sf_dir, "events").select("event_id", "ts", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"))
    return suppressed(keyed, "key", "ts", "event_id", 24 * 60).select("event_id", "key")


@query("""SELECT e.event_id, arg_max(o.value, o.ts) AS value_as_of FROM (SELECT * FROM events WHERE event_type = 'click') e
LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) o ON o.user_id = e.user_id AND o.ts <= e.ts GROUP BY e.event_id""")
def last_value_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each click the value of the user's last purchase up to then."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return as_of(events.where("event_type = 'click'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "value").select("event_id", "value_as_of")


@query("""SELECT c_custkey, CASE WHEN n = 0 THEN 0.0 ELSE round((p + 3.8416/(2*n) - 1.96*sqrt(p*(1-p)/n + 3.8416/(4*n*n)))/(1 + 3.8416/n), 9) END AS score
FROM (SELECT c_custkey, n, up / n AS p FROM (SELECT c_custkey, count(o_orderkey)::DOUBLE AS n, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS up
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1))""")
def wilson_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower bound of the share of finished orders."""
    votes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.expr("o_orderstatus = 'F'")).alias("up"), F.count_if(F.expr("o_orderstatus <> 'F'")).alias("down"))
    joined = table(spark, sf_dir, "customer").join(votes, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["up", "down"])
    return joined.select("c_custkey", F.round(wilson(F.col("up"), F.col("down")), 9).alias("score"))


@query("""WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1),
d AS (SELECT e.*, abs(value - med) AS dev FROM events e JOIN m USING (event_type)), s AS (SELECT event_type, median(dev) AS mad FROM d GROUP BY 1)
SELECT event_id, round(dev / greatest(mad, 1.0), 6) AS spread FROM d JOIN s USING (event_type) WHERE dev / greatest(mad, 1.0) > 4""")
def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values more than four median deviations from their kind's median; kinds are few, so each is spread over ranges."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    off = events.join(medians(events, "event_type", "value", "event_id", "med"), "event_type").withColumn("dev", F.abs(F.col("value") - F.col("med")))
    spread = F.col("dev") / F.greatest("mad", F.lit(1.0))
    found = off.join(medians(off, "event_type", "dev", "event_id", "mad"), "event_type")
    return found.where(spread > 4).select("event_id", F.round(spread, 6).alias("spread"))


@query("""WITH r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rv, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rt FROM events)
SELECT event_type, round(corr(rv, rt), 6) AS rho FROM r GROUP BY event_type""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of value and time of each kind."""
    by_value = ranked(table(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts"), "event_type", ["value", "event_id"], "rv").drop("n")
    both = ranked(by_value, "event_type", ["ts", "event_id"], "rt")
    return both.groupBy("event_type").agg(F.round(F.corr(F.col("rv").cast("double"), F.col("rt").cast("double")), 6).alias("rho"))


@query("""WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, value FROM events)
SELECT event_id, round(CASE WHEN n < 5 THEN value ELSE pos / (n - 1) END, 9) AS score FROM r""")
def percentile_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each value among those of its source, the value itself in small ones."""
    w = Window.partitionBy("user_id")
    ranked = table(spark, sf_dir, "events").select("event_id", "value", (F.row_number().over(w.orderBy("value", "event_id")) - 1).alias("pos"), F.count("*").over(w).alias("n"))
    return ranked.select("event_id", F.round(F.when(F.col("n") < 5, F.col("value")).otherwise(F.try_divide("pos", F.col("n") - 1)), 9).alias("score"))


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM p""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", plain_html(F.col("html")).alias("text"))


@query("""SELECT page_id, trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS heading FROM pages""")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", first_heading(F.col("html")).alias("heading"))


@query("""WITH t AS (SELECT page_id, lower(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1))) AS t FROM pages)
SELECT page_id, regexp_replace(t, '^(the|a|an|le|la|les|der|die|das|el|los|las|un)\\s+(.+)$', '\\2, \\1') AS title FROM t""")
def sort_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sort_title(first_heading(F.col("html"))).alias("title"))


@query()
def chunk_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks of all documents."""
    return chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""SELECT doc_id, CASE WHEN ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % 100 < 10 THEN 'val' ELSE 'train' END AS split FROM documents""")
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable split by a hash of the key."""
    part = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 100
    return table(spark, sf_dir, "documents").select("doc_id", F.when(part < 10, "val").otherwise("train").alias("split"))


@query("""SELECT user_id, event_type, min(ts) AS first_ts, count(*) AS n FROM events GROUP BY ALL""")
def usage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys seen in a stream of files, each once."""
    seen = deduplicated(file_stream(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"])
    return drained(seen, "dedupe")


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and kind, kept up by a stream of files."""
    counts = windowed_counts(file_stream(spark, sf_dir, "events"), "ts", "event_type", "1 day", "60 days")
    flat = counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
    return drained(flat, "counts", "complete")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def stream_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep over a stream of new documents."""
    return drained(pending(file_stream(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id"), "pending")


@query(SUPPRESSED)
def stream_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a stream, each at least a day after the last kept one of its key."""
    keyed = file_stream(spark, sf_dir, "events").select("event_id", "ts", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"))
    return suppressed_within(keyed, "key", "ts", "event_id", 24 * 60).select("event_id", "key")


@query("""WITH e AS (SELECT user_id, ts, value FROM events), w AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS d, sum(round(value * 100)::BIGINT) AS v FROM e GROUP BY ALL)
SELECT user_id, strftime(d, '%Y-%m-%d') AS day, greatest(v - 5000, 0)::BIGINT AS used FROM w""")
def usage_over_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use above an allowance by day, never below zero."""
    spent = F.sum(F.round(F.col("value") * 100).cast("long"))
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(spent.alias("v"))
    return daily.select("user_id", "day", F.greatest(F.col("v") - 5000, F.lit(0)).alias("used"))
