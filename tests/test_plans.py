"""What the planner makes of joins whose sizes it cannot see."""

from pyspark.sql import functions as F

from quaymark.operators.keyframes import BOX, boxes_at
from quaymark.operators.similarity import hamming_pairs
from quaymark.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_hamming_pairs_are_not_broadcast(spark):
    hashes = spark.range(5000).select(F.col("id").alias("key"), F.xxhash64("id").alias("h"))
    found = hamming_pairs(hashes, "key", "h", 5)
    assert "BroadcastHashJoin" not in plan(found)
    found.count()
    assert "BroadcastHashJoin" not in plan(found)


def test_boxes_of_stretches_are_compared_with_few_moments(spark):
    """A hundred tracks of one video, each on screen for a short while: pairs of tracks and moments are not made."""
    box = [F.lit(0.5).alias(c) for c in BOX]
    keys = spark.range(200).select(F.lit(1).alias("video"), F.floor(F.col("id") / 2).alias("track"), (F.floor(F.col("id") / 2) * 100 + F.col("id") % 2 * 99).alias("t"), *box, F.lit(False).alias("outside"))
    moments = spark.range(10_000).select(F.lit(1).alias("video"), F.col("id").alias("t"))
    found = boxes_at(keys, moments)
    assert found.count() == 10_000  # a track's last keyframe shows its box too
    rows = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        while "QueryStage" in node.nodeName():
            node = node.plan()
        made = node.metrics().get("numOutputRows")
        rows.append(made.get().value() if made.isDefined() else 0)
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    result = found._jdf.queryExecution().executedPlan()
    found._jdf.collectToPython()
    walk(result)
    assert 10_000 <= max(rows) <= 40_000


def test_pairs_hold_no_sketch_of_their_own(spark):
    lines = plan(registry.QUERIES["sketch_error"](spark, "/root/testdata/sf0.001")).splitlines()
    assert not any("approx_count_distinct" in x and "keys=[event_type" in x and "user_id" in x.split("functions=")[0] for x in lines if "functions=" in x)


def written(df):
    """Rows that the shuffles of a run have written."""
    rows, seen = [], set()

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        while "QueryStage" in node.nodeName():
            node = node.plan()
        made = node.metrics().get("shuffleRecordsWritten")
        if made.isDefined() and made.get().id() not in seen:
            seen.add(made.get().id())
            rows.append(made.get().value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    df._jdf.collectToPython()
    walk(df._jdf.queryExecution().executedPlan())
    return sum(rows)


def test_keyframes_are_shuffled_once(spark):
    box = [F.lit(0.5).alias(c) for c in BOX]
    keys = spark.range(40_000).select((F.col("id") % 8).alias("video"), F.floor(F.col("id") / 40).alias("track"), (F.col("id") % 40 * 977 + F.col("id") % 13).alias("t"), *box, F.lit(False).alias("outside"))
    moments = spark.range(800).select((F.col("id") % 8).alias("video"), F.col("id").alias("t"))
    found = boxes_at(keys, moments)
    assert 40_000 <= written(found) <= 44_000


def test_turned_hashes_are_not_shuffled(spark):
    hashes = spark.range(3000).select(F.xxhash64("id").alias("h"))
    assert written(hamming_pairs(hashes, "h", "h", 5)) <= 6 * 3000
