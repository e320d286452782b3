"""Operators without SQL against plain versions, and their edge cases."""

import collections
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaymark.functions.text import chunks
from quaymark.functions.tokens import Fields, period, search
from quaymark.operators import groups, similarity
from quaymark.operators.graph import connected_components
from quaymark.operators.groups import both_ways, leader_clusters, overlaps, tree_totals, trips
from quaymark.operators.sequences import dtw_cost, dtw_score, offset_votes
from quaymark.operators.similarity import hamming_pairs, haversine, sign_bits
from quaymark.operators.windows import as_of, sessions, suppressed
from quaymark.streaming import streams


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("n, m", [(0, 0), (6, 3), (300, 200), (60, 400)])
def test_components(spark, n, m):
    rng = random.Random(n + m)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(40 * (m > 0))]
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in connected_components(frame, "a", "b").collect()} == union_find(edges)


def test_components_ignore_null_ends(spark):
    frame = spark.createDataFrame([(1, None), (None, 2), (4, 4), (5, 4)], "a long, b long")
    assert {r.node: r.component for r in connected_components(frame, "a", "b").collect()} == {4: 4, 5: 4}


def test_hamming_join_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    hashes = rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)
    hashes[200:240] = hashes[200]
    for i in range(60):
        hashes[100 + i] = hashes[i] ^ np.int64(sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 6), replace=False)))
    found = hamming_pairs(spark.createDataFrame([(i, int(h)) for i, h in enumerate(hashes)], "i long, h long"), "i", "h", 5)
    wanted = {(i, j) for i in range(300) for j in range(i + 1, 300) if (int(hashes[i]) ^ int(hashes[j])).bit_count() <= 5 or ((int(hashes[i]) ^ int(hashes[j])) & (2**64 - 1)).bit_count() <= 5}
    assert {(r.a, r.b) for r in found.collect()} == wanted


def test_hamming_join_by_other_limits_and_keys(spark):
    """Keys of text, null keys and hashes, large buckets over many batches, few pairs at a time, other limits."""
    rng = np.random.default_rng(1)
    base = [int(h) for h in rng.integers(-(2**63), 2**63 - 1, 12, dtype=np.int64)]
    flip = lambda h, bits: ((h & (2**64 - 1)) ^ sum(1 << int(b) for b in bits)) - (2**64 if ((h & (2**64 - 1)) ^ sum(1 << int(b) for b in bits)) >> 63 else 0)
    hashes = sorted({flip(base[i % 12], rng.choice(64, rng.integers(0, 9), replace=False)) for i in range(250)})
    frame = spark.createDataFrame([(f"k{i}", h) for i, h in enumerate(hashes)] + [(None, base[0]), ("none", None)], "i string, h long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for limit in (0, 1, 2, 5, 9, 16):
            apart = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
            wanted = {(*sorted((f"k{i}", f"k{j}")), apart(x, y)) for i, x in enumerate(hashes) for j, y in enumerate(hashes[:i]) if apart(x, y) <= limit}
            assert sorted(map(tuple, hamming_pairs(frame, "i", "h", limit).collect())) == sorted(wanted)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_near_hashes_come_in_pieces(monkeypatch):
    h = np.arange(64, dtype=np.uint64)
    whole = list(similarity._near(h, np.zeros(64, np.int64), 0, 3, [0, 1, 2, 4], [], 2))
    monkeypatch.setattr(similarity, "AT_ONCE", 5)
    pieces = list(similarity._near(h, np.zeros(64, np.int64), 0, 3, [0, 1, 2, 4], [], 2))
    pairs = lambda found: sorted((min(a, b), max(a, b), n) for i, j, d in found for a, b, n in zip(i.tolist(), j.tolist(), d.tolist()))
    assert len(pieces) > 4 * len(whole) and pairs(pieces) == pairs(whole)
    assert pairs(whole) == [(a, b, d) for a in range(64) for b in range(a + 1, 64) if (d := (a ^ b).bit_count()) <= 2 and (a % 8 ^ b % 8).bit_count() <= 1]


def test_sign_bits(spark):
    vector = [1.0 if i % 3 == 0 or i == 63 else -1.0 for i in range(64)]
    row = spark.createDataFrame([(vector,)], "v array<double>").select(sign_bits(F.col("v")).alias("h")).first()
    assert row.h & (2**64 - 1) == sum(1 << i for i in range(64) if vector[i] > 0)


FILES = [("a.png", 1920, 1080, ["female", "outdoor"]), ("b.jpg", 1080, 1920, ["male", "outdoor"]), ("c.png", 1000, 1000, ["female", "male"]), ("d.png", 3000, 1000, ["?female", "hair_long"]), ("e.png", None, None, None)]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("tags:+female,-male", "ad"), ("-tag:male", "ade"), ("tags:hair*", "d"), ("tags:male|hair_long", "bcd"), ("tagcount:>2", ""),
        ("width:1000..2000", "abc"), ("-width:>1500", "bc"), ("sort:width", "cbade"), ("sort:-height", "bacde"), ("sort:bogus", "abcde"),
        ("jpg", "b"), ('".png" tag:male', "c"), ("width:x", ""),
    ],
)
def test_search_tokens(spark, text, wanted):
    files = spark.createDataFrame(FILES, "rel_path string, width int, height int, tags array<string>")
    fields = Fields("rel_path", F.col("tags"), (F.col("rel_path"),), {"width": F.col("width"), "height": F.col("height")})
    found = "".join(r.rel_path[0] for r in search(files, text, fields).collect())
    assert found == wanted if "sort" in text else sorted(found) == sorted(wanted)


def test_periods():
    assert period("2024-02") == ("2024-02-01", "2024-02-29")
    assert period("2023-02-30") is None and period("x") is None


def test_sessions_keep_a_gap_equal_to_the_limit(spark):
    rows = [(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 01:00:00"), (3, 1, "2024-01-01 02:00:01")]
    frame = spark.createDataFrame(rows, "id int, u int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r.session for r in sessions(frame, "u", "ts", 3600, "id").orderBy("id").collect()] == [1, 1, 2]


def test_suppression_compares_with_the_last_kept(spark):
    rows = [(i, "k", f"2024-01-01 00:{m:02d}:00") for i, m in enumerate([0, 6, 11, 12, 25])]
    frame = spark.createDataFrame(rows, "id int, k string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(r.id for r in suppressed(frame, "k", "ts", "id", 10).collect()) == [0, 2, 4]


def test_as_of(spark):
    left = spark.createDataFrame([(1, 1, 5), (2, 1, 1), (3, 2, 9)], "id int, u int, t int")
    right = spark.createDataFrame([(1, 2, 10.0), (1, 5, 20.0)], "u int, t int, v double")
    found = as_of(left, right, "u", "t", "v")
    assert {r.id: r.v_as_of for r in found.collect()} == {1: 20.0, 2: None, 3: None}


def test_trips_break_on_gaps_and_jumps(spark):
    lisbon, porto = (38.72, -9.14), (41.15, -8.61)
    rows = [(0, "u", 0, *lisbon), (1, "u", 1, None, None), (2, "u", 2, *porto), (3, "u", 3, *porto), (4, "u", 99, *porto)]
    frame = spark.createDataFrame(rows, "id int, u string, h int, lat double, lon double").withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,h)"))
    assert [r.trip for r in trips(frame, "u", "ts", "lat", "lon", "id", 36, 100).orderBy("id").collect()] == [1, 1, 2, 2, 3]
    distance = spark.range(1).select(haversine(*[F.lit(x) for x in (*lisbon, *porto)]).alias("d")).first().d
    assert 270 < distance < 280


def test_tree_and_overlap(spark):
    paths = spark.createDataFrame([("t/a",), ("t/2026/b",), ("t/2026/trip/c",)], "p string")
    nodes = {r.node: (r.direct, r.total) for r in tree_totals(paths, F.regexp_extract("p", "^(.*)/[^/]*$", 1)).collect()}
    assert nodes == {"t": (1, 3), "t/2026": (1, 2), "t/2026/trip": (1, 1)}
    members = spark.createDataFrame([("g", x) for x in "abcd"], "g string, i string")
    albums = spark.createDataFrame([("x", "a"), ("y", "a"), ("y", "b"), ("y", "c")], "a string, i string")
    assert [tuple(r) for r in overlaps(members, albums, "g", "i", "a").collect()] == [("g", "y", 0.75)]


@pytest.mark.parametrize("held", [1 << 16, 6])
def test_overlaps_send_a_row_for_each_item_and_count_large_groups_by_rows(spark, monkeypatch, held):
    monkeypatch.setattr(groups, "HELD", held)
    rng = np.random.default_rng(4)
    members = [(int(g), int(i)) for g, i in rng.integers(0, 30, (200, 2))] + [(None, 1), (40, None), (40, 3), (50, None)]
    albums = [(f"a{a}", int(i)) for a, i in rng.integers(0, 30, (200, 2))] + [(None, 3), (None, 4), ("b", None)]
    frames = type(spark.range(0))
    sent, into = [], frames.mapInArrow
    monkeypatch.setattr(frames, "mapInArrow", lambda frame, *a: (sent.append(frame.count()), into(frame, *a))[1])
    found = overlaps(spark.createDataFrame(members, "g int, i int"), spark.createDataFrame(albums, "a string, i int"), "g", "i", "a")
    wanted = set()
    for g in {g for g, _ in members if g is not None}:
        items = {i for h, i in members if h == g}
        shared = collections.Counter(a for a, i in set(albums) if i in items and i is not None)
        if shared:
            best = min(shared, key=lambda a: (-shared[a], a is None, a or ""))
            wanted.add((g, best, shared[best] / len(items)))
    assert {tuple(r) for r in found.collect()} == wanted and found.count() == len(wanted)
    assert sent[0] <= len(set(members))


def test_pairs_both_ways_once(spark, monkeypatch):
    monkeypatch.setattr(groups, "ROWS", 4)
    pairs = [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (4, None), (None, None), (None, None), (5, None), (9, 7)]
    found = both_ways(spark.createDataFrame(pairs, "a int, b int"), "a", "b")
    assert sorted(map(tuple, found.collect()), key=str) == sorted({*pairs, *[(b, a) for a, b in pairs]}, key=str)
    assert found.rdd.getNumPartitions() >= 4


def test_dtw(spark):
    assert dtw_cost(np.arange(10.0), np.arange(10.0)) == 0
    frame = spark.createDataFrame([([1.0, 2.0], [1.0, 1.0, 2.0]), ([0.0], [1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r.score for r in dtw_score(frame, "a", "b").collect()] == [1.0, 0.0, 0.0]


def test_offset_vote_skips_common_values(spark):
    rows = [("a", i, i) for i in range(6)] + [("b", i + 2, i) for i in range(6)] + [("a", 50 + i, 99) for i in range(9)]
    found = offset_votes(spark.createDataFrame(rows, "s string, p int, v int"), "s", "p", "v", 4, 3)
    assert [(r.a, r.b, r.offset, r.votes) for r in found.collect()] == [("a", "b", 2, 6)]


def test_leaders_and_chunks(spark):
    rng = np.random.default_rng(1)
    base = np.eye(8)[:2]
    rows = [("o", i, (base[i % 2] + rng.normal(0, 0.02, 8)).tolist()) for i in range(8)]
    found = leader_clusters(spark.createDataFrame(rows, "o string, k int, v array<double>"), "o", "k", "v", 0.9)
    assert found.groupBy("cluster").count().toPandas()["count"].tolist() == [4, 4]
    text = "A sentence of some words here. " * 100
    docs = spark.createDataFrame([(1, text), (2, None), (3, "short")], "d int, t string")
    parts = chunks(docs, "d", "t").toPandas()
    assert set(parts.d) == {1} and parts.piece.str.len().between(81, 1200).all() and isinstance(parts, pd.DataFrame)


def test_a_cooldown_goes_on_from_batch_to_batch(spark, tmp_path):
    schema = "id int, k string, ts timestamp_ntz"
    at = lambda i, k, h: f"SELECT {i} id, '{k}' k, timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,{h}) ts"
    for n, rows in enumerate([[(1, "a", 0), (2, "a", 5), (3, "b", 3)], [(4, "a", 23), (5, "a", 24), (6, "b", 2), (7, "c", 0)], [(8, "a", 30), (9, "b", 27)]]):
        spark.sql(" UNION ALL ".join(at(*r) for r in rows)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = streams.suppressed_within(stream, "k", "ts", "id", 24 * 60)
    assert sorted(r.id for r in found.collect()) == [1, 3, 5, 7, 9] and found.columns == ["id", "k", "ts"]
    # one table for each batch, and no call for each key
    assert len({f.split("batch=")[1].split("/")[0] for f in found.inputFiles()}) == 3
