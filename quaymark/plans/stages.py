"""Staged deduplication, bursts, streams in several feeds and sketches kept by the day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators.bursts import bursts
from quaymark.operators.sketches import merged_counts, period_sketches
from quaymark.operators.staged import confirmed_groups, exact_firsts, guarded, verdicts, verified, without_exclusions, word_overlap
from quaymark.plans.registry import query, table
from quaymark.plans.vectors import LIMIT
from quaymark.sources.shared import stored
from quaymark.streaming.streams import fed, session_counts, sliding_counts

CONFIRM = 0.6
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> ''))"


@query(f"""WITH RECURSIVE d AS (SELECT min(doc_id) AS doc_id, any_value(text) AS text FROM documents GROUP BY coalesce(text, '')),
l AS (SELECT doc_id, {_WORDS} AS l FROM d), w AS (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS word FROM l),
g AS (SELECT doc_id, ('0x' || md5(word)[1:16])::UBIGINT AS h FROM w), k AS (SELECT unnest(range(64))::UTINYINT AS i),
v AS (SELECT doc_id, i, 2 * coalesce(sum((h >> i) & 1), 0) > count(h) AS b FROM g, k GROUP BY ALL),
f AS (SELECT doc_id, coalesce(sum(CASE WHEN b THEN 1::HUGEINT << i::HUGEINT END), 0)::HUGEINT AS h FROM v GROUP BY 1),
c AS (SELECT h, min(doc_id) AS first FROM f GROUP BY h),
p AS (SELECT x.first AS a, y.first AS b FROM c x JOIN c y ON x.first < y.first AND bit_count(xor(x.h, y.h)) <= {LIMIT}
      UNION ALL SELECT first, doc_id FROM f JOIN c USING (h) WHERE doc_id <> first),
e AS (SELECT doc_id, md5(word) AS m FROM w WHERE word IS NOT NULL),
t AS (SELECT doc_id, ('0x' || m[3 * i + 1 : 3 * i + 3])::BIGINT AS x FROM e, (SELECT unnest(range(8)) AS i)),
u AS (SELECT doc_id, x & 1023 AS bit FROM t GROUP BY ALL HAVING sum(1 - 2 * ((x >> 10) & 1)) > 0),
s AS (SELECT l.doc_id, list(bit) FILTER (bit IS NOT NULL) AS bits FROM l LEFT JOIN u USING (doc_id) GROUP BY 1),
q AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
      WHERE len(coalesce(x.bits, [])) + len(coalesce(y.bits, [])) - 2 * len(list_intersect(coalesce(x.bits, []), coalesce(y.bits, []))) <= 60 AND (a + b) % 7 > 0),
o AS (SELECT a, b, CASE WHEN (a + b) % 3 = 0 THEN 0.9 WHEN len(x.l) > 0 AND len(y.l) > 0 THEN len(list_intersect(x.l, y.l)) / (len(x.l) + len(y.l) - len(list_intersect(x.l, y.l))) ELSE 0.5 END AS score
      FROM q JOIN l x ON x.doc_id = a JOIN l y ON y.doc_id = b),
r AS (SELECT * FROM o WHERE score >= {CONFIRM}), z AS (SELECT a, b, score FROM r UNION ALL SELECT b, a, score FROM r),
n(node, root) AS (SELECT a, a FROM z UNION SELECT z.b, n.root FROM n JOIN z ON z.a = n.node),
m AS (SELECT node, min(root) AS component FROM n GROUP BY node), y AS (SELECT a AS node, sum(score) AS total FROM z GROUP BY 1)
SELECT component, node, round(total, 6) AS total, row_number() OVER (PARTITION BY component ORDER BY total DESC, node)::INTEGER AS rank FROM m JOIN y USING (node)""")
def staged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates through all stages; a third of the pairs has a cached verdict, a seventh is excluded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    firsts = exact_firsts(docs, "doc_id", "text").where("doc_id = first").select("doc_id")
    single = docs.join(firsts, "doc_id", "left_semi")
    near = stored(verified(stored(guarded(single, "doc_id", "text"), "staged-guarded"), single, "doc_id", "text"), "staged-near")
    ruled_out = near.where("(a + b) % 7 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = stored(without_exclusions(near, ruled_out), "staged-pairs")
    cache = pairs.where("(a + b) % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit("words").alias("model"), F.lit(0.9).alias("score"))
    scorers = [("words", word_overlap(single, "doc_id", "text")), ("even", lambda misses: misses.withColumn("score", F.lit(0.5)))]
    found = confirmed_groups(verdicts(pairs, cache, "words", scorers), CONFIRM)
    return found.select("component", "node", F.round("total", 6).alias("total"), "rank")


_DRIFT = 172_800


@query(f"""WITH RECURSIVE g AS (SELECT user_id AS grp, event_id AS member, event_id = min(event_id) OVER (PARTITION BY user_id) AS ref, 1 - (value % 10) / 10 AS score, event_type AS folder,
  CASE WHEN event_id % 6 = 0 THEN event_id % 60 END AS album, CASE WHEN event_id % 11 > 0 THEN epoch_us(ts) / 1e6 END AS epoch FROM events),
k AS (SELECT * FROM g WHERE epoch IS NOT NULL AND (ref OR score >= 0.3)),
t AS (SELECT grp, member, 'f/' || folder AS tag FROM k UNION ALL SELECT grp, member, 'a/' || album FROM k WHERE album IS NOT NULL),
f AS (SELECT grp, tag, min(member) AS first FROM t GROUP BY ALL),
e AS (SELECT DISTINCT first AS a, member AS b FROM t JOIN f USING (grp, tag)), z AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
n(node, root) AS (SELECT a, a FROM z UNION SELECT z.b, n.root FROM n JOIN z ON z.a = n.node WHERE n.root < z.b),
c AS (SELECT node, min(root) AS part FROM n GROUP BY node),
o AS (SELECT k.*, part, CASE WHEN epoch - lag(epoch) OVER (PARTITION BY part ORDER BY epoch, member) <= {_DRIFT} THEN 0 ELSE 1 END AS opens FROM k JOIN c ON node = member),
r AS (SELECT *, sum(opens) OVER (PARTITION BY part ORDER BY epoch, member) AS burst FROM o),
s AS (SELECT *, count(*) OVER (PARTITION BY part, burst) AS n, row_number() OVER (PARTITION BY part, burst ORDER BY epoch, member) AS place,
  first_value(member) OVER (PARTITION BY part, burst ORDER BY NOT ref, epoch, member) AS cover FROM r)
SELECT member, part, burst::BIGINT AS burst, place::INTEGER AS place, cover FROM s WHERE n > 1""")
def event_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each user's events, which are alike by value, together by kind or album and close in time."""
    events = table(spark, sf_dir, "events")
    firsts = events.groupBy("user_id").agg(F.min("event_id").alias("event_id")).select("event_id", F.lit(True).alias("is_reference"))
    members = events.join(firsts, "event_id", "left").select(
        F.col("user_id").alias("grp"), F.col("event_id").alias("member"), "is_reference", (1 - F.col("value") % 10 / 10).alias("score"), F.col("event_type").alias("folder"),
        F.when(F.col("event_id") % 6 == 0, F.array((F.col("event_id") % 60).cast("string"))).alias("albums"),
        F.when(F.col("event_id") % 11 > 0, F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("epoch"),
    )
    return bursts(members, _DRIFT, 0.3)


#: Rows of the first days come with the last feed, too late; some of the second feed's last day come with it in time.
_TOO_LATE, _IN_TIME = "event_id % 50 = 0 AND ts < TIMESTAMP '2024-01-06'", "event_id % 50 = 1 AND ts >= TIMESTAMP '2024-01-20 12:00:00' AND ts < TIMESTAMP '2024-01-21'"


def _feeds(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The events in three feeds, and a row long after them that closes what is open."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    moved = f"({_TOO_LATE}) OR ({_IN_TIME})"
    cuts = [("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2030-01-01")]
    feeds = [events.where(f"ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}' AND NOT ({moved})") for a, b in cuts]
    end = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2031-01-01").cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("user_id"))
    return [*feeds[:2], feeds[2].unionByName(events.where(moved)), end]


_KEPT = f"k AS (SELECT user_id, ts, event_id FROM events WHERE NOT ({_TOO_LATE}))"


@query(f"""WITH {_KEPT}, o AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 43200000000 THEN 0 ELSE 1 END AS opens FROM k),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM o)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 43200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, nth""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users in a stream of several feeds; rows behind the watermark are dropped."""
    found = fed(spark, _feeds(spark, sf_dir), lambda s: session_counts(s, "ts", "user_id", "12 hours", "1 day"), "sessions")
    return found.where("user_id IS NOT NULL").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(f"""WITH {_KEPT}, w AS (SELECT user_id, date_trunc('day', ts) - to_days(d::INTEGER) AS day FROM k, range(2) r(d))
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM w GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each user in windows of two days that begin every day, from the same feeds."""
    found = fed(spark, _feeds(spark, sf_dir), lambda s: sliding_counts(s, "ts", "user_id", "2 days", "1 day", "1 day"), "sliding")
    return found.where("user_id IS NOT NULL").select("user_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


@query()
def sketched_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customers of each year and priority: from sketches kept by the day, and counted."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    daily = stored(period_sketches(orders, ["day", "o_orderpriority"], "o_custkey"), "daily-sketches")
    keys = [F.year("day").alias("year"), F.col("o_orderpriority")]
    exact = orders.groupBy(*keys).agg(F.count_distinct("o_custkey").alias("exact"))
    return merged_counts(daily, keys).join(exact, ["year", "o_orderpriority"]).select("year", "o_orderpriority", "about", "exact")
