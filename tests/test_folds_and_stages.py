"""Tiers, identities, neighbours, routes, matches, votes, paths, stages, bursts and feeds against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.functions import fingerprints
from quaymark.functions.fingerprints import wide_votes, word_votes
from quaymark.operators import assignments, bursts, identities, media, neighbours, routes, sequences, sketches, staged, tiers
from quaymark.plans import registry
from quaymark.sources import shared
from quaymark.streaming import streams

SF = "/root/testdata/sf0.001"


# tiers


def plain_plan(files, levels, headroom, hysteresis):
    total, shares = sum(f["size"] or 0 for f in files) or 1, sum(t.ratio for t in levels)
    budget = [total * t.ratio / shares for t in levels]
    used, out = [0] * len(levels), {}

    def floor(f):
        need = (f["bitrate"] or 8.0) * headroom / 8
        return max((i for i, t in enumerate(levels) if t.speed >= need), default=0)

    videos = [f for f in files if f["kind"] == "video"]
    for f in sorted(videos, key=lambda f: (-floor(f), f["bitrate"] or 0, f["key"])):
        at = own = floor(f)
        size = f["size"] or 0
        if used[own] + size > budget[own]:
            room = [t for t in range(own - 1, -1, -1) if used[t] + size <= budget[t]]
            at = room[0] if room else own
        used[at] += size
        out[f["key"]] = at
    spot = 0
    images = [f for f in files if f["kind"] != "video"]
    for f in sorted(images, key=lambda f: (-(2.5 if f["quality"] is None else f["quality"]), 1e9 if f["per_pixel"] is None else f["per_pixel"], f["key"])):
        size = f["size"] or 0
        while spot < len(levels) - 1 and used[spot] + size > budget[spot]:
            spot += 1
        used[spot] += size
        out[f["key"]] = spot
    here = [sum(f["size"] or 0 for f in files if f["current"] == i) for i in range(len(levels))]
    moves = {}
    for f in files:
        cur, to = f["current"], out[f["key"]]
        slow = f["kind"] == "video" and cur is not None and cur > floor(f)
        moves[f["key"]] = cur is None or (cur != to and (slow or here[cur] > budget[cur] * (1 + hysteresis) or abs(cur - to) > 1))
    return {k: (out[k], moves[k]) for k in out}


@pytest.mark.parametrize("seed", range(3))
def test_tier_plan_equals_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    pick = lambda f: None if rng.random() < 0.05 else f()
    files = [
        {
            "key": i, "kind": rng.choice(["video", "image", None]), "size": pick(lambda: int(10 ** rng.uniform(0, 5))), "bitrate": pick(lambda: rng.choice([0.0, 3.0, rng.uniform(1, 3000)])),
            "quality": pick(lambda: rng.randint(0, 5) / 1.0), "per_pixel": pick(lambda: rng.random()), "current": pick(lambda: rng.randint(0, 3)),
        }
        for i in range(600)
    ]
    levels = [tiers.Tier(500, 1), tiers.Tier(150, 1), tiers.Tier(60, 3), tiers.Tier(10, 2)]
    frame = spark.createDataFrame(files, "key long, kind string, size long, bitrate double, quality double, per_pixel double, current int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.key: (r.target, r.moves) for r in tiers.tier_plan(frame, levels).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == plain_plan(files, levels, 1.5, 0.1)
    assert tiers.tier_plan(frame.limit(0), levels).collect() == []


# identities


def plain_numbers(regions):
    """Label by label, then the largest cluster first."""
    members = defaultdict(list)
    for r in sorted(regions, key=lambda r: r[0]):
        if r[1] is not None and r[1] >= 0:
            members[r[1]].append(r)
    parts = []
    for rows in members.values():
        names = Counter(r[2] for r in rows if r[2])
        if len(names) <= 1:
            parts.append(rows)
            continue
        most = min(names, key=lambda n: (-names[n], n))
        by_name = defaultdict(list)
        for r in rows:
            by_name[r[2] or most].append(r)
        parts += by_name.values()
    top = max((r[3] for p in parts for r in p if r[3] is not None), default=-1)
    taken, out, following = set(), {r[0]: -1 for r in regions}, max(top, -1) + 1
    for rows in sorted(parts, key=lambda p: (-len(p), min(r[0] for r in p))):
        olds = Counter(r[3] for r in rows if r[3] is not None and r[3] >= 0)
        wish = min(olds, key=lambda o: (-olds[o], o)) if olds else -1
        if wish < 0 or wish in taken:
            wish, following = following, following + 1
        taken.add(wish)
        out.update({r[0]: wish for r in rows})
    return out


def test_identities_equal_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, -1, *range(25)]), rng.choice([None, "", "", "Ana", "Rui", "Eva"]), rng.choice([None, -1, *range(30)])) for i in range(500)]
    frame = spark.createDataFrame(rows, "key long, cluster int, name string, old long").repartition(5)
    assert {r.key: r.number for r in identities.recluster(frame).collect()} == plain_numbers(rows)
    alone = spark.createDataFrame([(1, 0, None, None), (2, 0, None, None), (3, 1, "Ana", None)], "key long, cluster int, name string, old long")
    assert {r.key: r.number for r in identities.recluster(alone).collect()} == {1: 0, 2: 0, 3: 1}
    assert identities.recluster(alone.limit(0)).collect() == []


# neighbours


def unit_frame(spark, vectors):
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "key long, v array<double>")


def components(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        if x != y:
            root = [x if r == y else r for r in root]
    groups = defaultdict(set)
    for i, r in enumerate(root):
        groups[r].add(i)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def clouds(rng, groups, each, spread, width=24):
    centres = rng.normal(size=(groups, width))
    return np.concatenate([c + spread * rng.normal(size=(each, width)) for c in centres])


def test_spanning_forest_connects_what_all_links_connect():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.02, 0.3, 1.0):
        near = rng.random((40, 30)) < share
        i, j = neighbours.spanning_forest(near)
        assert near[i, j].all() and len(i) <= max(near.sum() if near.sum() < 70 else 69, 0)
        full = [(a, 40 + b) for a, b in zip(*np.nonzero(near))]
        assert components(70, list(zip(i.tolist(), (j + 40).tolist()))) == components(70, full)


def test_links_connect_exactly_what_is_near(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(1)
    vectors, frame = unit_frame(spark, np.concatenate([clouds(rng, 6, 20, 0.15), rng.normal(size=(20, 24)), np.ones((30, 24))]))
    near = np.argwhere(np.triu(1 - vectors @ vectors.T <= 0.1, 1))
    links = [(r.a, r.b) for r in neighbours.near_links(frame, 0.1).collect()]
    assert components(len(vectors), links) == components(len(vectors), near.tolist())
    assert len(set(links)) < 0.6 * len(near)
    assert {(r.a, r.b) for r in neighbours.near_pairs(frame, 0.1).collect()} == set(map(tuple, near.tolist()))
    assert neighbours.near_links(frame.limit(0), 0.1).collect() == []


def test_hyperplane_tables_find_most_and_compare_few(spark):
    rng = np.random.default_rng(2)
    candidates = {}
    for groups in (30, 120):
        vectors, frame = unit_frame(spark, clouds(rng, groups, 10, 0.18))
        exact = components(len(vectors), np.argwhere(np.triu(1 - vectors @ vectors.T <= 0.1, 1)).tolist())
        found = components(len(vectors), [(r.a, r.b) for r in neighbours.approximate_links(frame, 0.1, bucket=16).collect()])
        pairs = lambda groups: {p for g in groups for p in itertools.combinations(sorted(g), 2)}
        assert len(pairs(found) & pairs(exact)) >= 0.9 * len(pairs(exact)) and pairs(found) <= pairs(exact)
        cells = neighbours.hyperplane_cells(frame, 0.1, 0.95, 16, 2, 0)
        homes = cells.select(F.explode("home").alias("c")).groupBy("c").agg(F.count("*").alias("x"))
        guests = cells.select(F.explode("guest").alias("c")).groupBy("c").agg(F.count("*").alias("y"))
        candidates[len(vectors)] = homes.join(guests, "c").agg(F.sum(F.col("x") * F.col("y"))).first()[0]
    (n, few), (m, many) = sorted(candidates.items())
    assert math.log(many / few) / math.log(m / n) < 1.5


# routes


def plain_route(vectors, labels, first):
    clusters = sorted(set(labels))
    middles = np.stack([vectors[labels == c].mean(axis=0) for c in clusters])
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)

    def walk(rows, start):
        left, out = [r for r in rows if r != start], [start]
        while left:
            out.append(max(left, key=lambda r: (vectors[r] @ vectors[out[-1]], -r)))
            left.remove(out[-1])
        return out

    tour, start = [], clusters.index(labels[first])
    left = set(range(len(clusters))) - {start}
    tour = [start]
    while left:
        tour.append(max(left, key=lambda c: (middles[c] @ middles[tour[-1]], -c)))
        left.remove(tour[-1])
    tour = routes.uncrossed(middles, tour) if len(tour) > 3 else tour
    out, entrance = [], vectors[first]
    for t in tour:
        rows = np.flatnonzero(labels == clusters[t]).tolist()
        out += walk(rows, max(rows, key=lambda r: (vectors[r] @ entrance, -r)))
        entrance = middles[t]
    return out


def test_route_equals_a_plain_walk(spark):
    rng = np.random.default_rng(3)
    vectors, frame = unit_frame(spark, clouds(rng, 7, 12, 0.4))
    labels = np.arange(len(vectors)) // 12
    labelled = frame.withColumn("cluster", F.floor(F.col("key") / 12).cast("int"))
    found = [r.key for r in routes.route(labelled, 30).orderBy("place").collect()]
    assert found == plain_route(vectors, labels, 30) and found[0] == 30
    away = 1 - np.eye(5)
    assert sorted(routes.uncrossed(np.linalg.qr(away)[0], [0, 2, 1, 3, 4])) == list(range(5))


def test_long_clusters_are_walked_cut_by_cut(spark, monkeypatch):
    monkeypatch.setattr(routes, "WALK", 10)
    _, frame = unit_frame(spark, np.random.default_rng(4).normal(size=(65, 8)))
    found = routes.route(frame.withColumn("cluster", F.lit(0)), 5).orderBy("place").collect()
    assert sorted(r.key for r in found) == list(range(65)) and found[0].key == 5 and [r.place for r in found] == list(range(65))


# matches


def test_poses_take_their_boxes_one_to_one(spark):
    boxes = spark.createDataFrame([(1, 1, 0.5, 0.5, 0.4, 0.4), (1, 2, 0.5, 0.5, 1.0, 1.0), (1, 3, 0.9, 0.9, 0.1, 0.1), (2, 4, 0.5, 0.5, 0.2, 0.2), (3, 5, None, 0.5, 0.2, 0.2)], "image int, box int, cx double, cy double, w double, h double")
    near, far = [(0.45, 0.5, 0.9), (0.55, 0.5, 0.9), (0.5, 0.6, 0.1)], [(0.1, 0.1, 0.9), (0.2, 0.3, 0.9)]
    poses = spark.createDataFrame([(1, 7, near), (1, 8, far), (2, 9, far), (2, 10, [(0.5, 0.5, 0.9)]), (3, 11, None)], "image int, person int, points array<struct<x: double, y: double, v: double>>")
    rows = assignments.pose_subjects(boxes, poses).collect()
    assert {(r.image, r.box, r.person, r.needs_review) for r in rows} == {(1, 1, 7, False), (1, 2, 8, False), (1, 3, None, True), (2, 4, 10, False), (2, None, 9, False), (3, 5, None, True)}
    made = next(r for r in rows if r.person == 9)
    assert np.allclose([made.cx, made.cy, made.w, made.h], [0.15, 0.2, 0.16, 0.26])
    assert {(r.box, r.person) for r in assignments.pose_subjects(boxes, poses, "drop").collect()} == {(1, 7), (2, 8), (4, 10), (None, 9)}
    assert not any(r.needs_review for r in assignments.pose_subjects(boxes, poses, "keep").collect())


def test_poses_and_boxes_with_nulls_and_repeats(spark):
    at = (0.5, 0.5, 1.0, 1.0)
    boxes = spark.createDataFrame([(None, 1, *at), (1, None, *at), (2, 3, *at), (2, 3, *at), (3, 4, *at)], "image int, box int, cx double, cy double, w double, h double")
    near = [(0.4, 0.4, 0.9), (0.6, 0.6, 0.9)]
    poses = spark.createDataFrame([(None, 1, near), (1, 2, near), (2, 3, near), (3, None, near), (4, 5, near)], "image int, person int, points array<struct<x: double, y: double, v: double>>")
    rows = Counter((r.image, r.box, r.person, r.needs_review) for r in assignments.pose_subjects(boxes, poses).collect())
    # without an image nothing is matched; a box without a key takes a skeleton but does not show it
    assert rows == {(None, 1, None, True): 1, (None, None, 1, False): 1, (1, None, None, True): 1, (2, 3, 3, False): 2, (3, 4, None, True): 1, (3, None, None, False): 1, (4, None, 5, False): 1}
    # an image's boxes and skeletons are dealt out once, and joined with nothing
    plan = assignments.pose_subjects(boxes, poses)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Aggregate") == 2 and "Join" not in plan


# votes and steps


def test_offsets_are_voted_by_all_values(spark):
    rng = random.Random(5)
    tracks = {t: [rng.randint(1, 40) if rng.random() < 0.5 else 7 for _ in range(60)] for t in range(4)}
    tracks[4] = [0] * 5 + tracks[0][12:]
    rows = [(t, i, v) for t, values in tracks.items() for i, v in enumerate(values)]
    frame = spark.createDataFrame([*rows, (9, None, 3), (None, 1, 3)], "track long, position long, value long")
    pairs = spark.createDataFrame(list(itertools.combinations(range(5), 2)), "a long, b long")

    def plain(a, b):
        places = defaultdict(list)
        for q, v in enumerate(b):
            places[v].append(q)
        votes = [q - p for p, v in enumerate(a) if v for q in places[v][:8]]
        halves = Counter(v // 2 for v in votes)
        best = 2 * min(halves, key=lambda h: (-halves[h], h))
        near = Counter(v for v in votes if best - 2 <= v <= best + 3)
        return min(near, key=lambda v: (-near[v], v))

    found = {(r.a, r.b): r.offset for r in media.voted_offsets(pairs, frame).collect()}
    assert found == {(x, y): plain(tracks[x], tracks[y]) for x, y in itertools.combinations(range(5), 2)}


def test_candidates_agree_on_an_offset(spark):
    rng = random.Random(6)
    first = [rng.randint(1, 2**32 - 2) for _ in range(300)]
    tracks = {0: first, 1: first[40:], 2: [rng.randint(1, 2**32 - 2) for _ in range(300)], 3: [77] * 300}
    frame = spark.createDataFrame([(t, i, v) for t, values in tracks.items() for i, v in enumerate(values)], "track long, position long, value long")
    assert [tuple(r) for r in media.voted_candidates(frame).collect()] == [(0, 1)]
    wanted = {(t, i) for t, values in tracks.items() for i, v in enumerate(values) if (v * 2654435761 >> 16 & 0xFFFF) % 8 == 0}
    assert {(r.track, r.position) for r in media.sampled(frame).collect()} == wanted and len(wanted) > 50


def test_shared_steps_equal_brute_force(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(63) for _ in range(12)]
    bend = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(63), n))
    clips = {0: base[:6], 1: [bend(h, 3) for h in base[:4]], 2: [bend(base[0], 4)], 3: base[6:9], 4: [0, 1, base[6], bend(base[6], 1), base[7]], 5: [rng.getrandbits(63)], 6: base[:6], 7: [0, 3]}
    frame = spark.createDataFrame([(c, i, h) for c, steps in clips.items() for i, h in enumerate(steps)], "clip long, step long, h long")
    bits = lambda h: bin(h).count("1")
    kept = {}
    for c, steps in clips.items():
        out = []
        for h in steps:
            if 3 < bits(h) < 61 and not (out and bits(out[-1] ^ h) <= 2):
                out.append(h)
        if out:
            kept[c] = out
    pairs, classes = media.shared_step_pairs(frame)
    assert {r.clip: r.first for r in classes.collect()} == {c: min(k for k in kept if kept[k] == kept[c]) for c in kept}
    firsts = [c for c in kept if not any(kept[k] == kept[c] and k < c for k in kept)]
    wanted = set()
    for a, b in itertools.combinations(firsts, 2):
        shared = sum(bits(x ^ y) <= 5 for x in kept[a] for y in kept[b])
        if shared >= min(2, len(kept[a]), len(kept[b])) and shared:
            wanted.add((a, b, shared))
    assert {tuple(r) for r in pairs.collect()} == wanted and len(wanted) >= 4


def test_shared_steps_are_counted_in_rounds(spark, monkeypatch):
    """Clips that all share one step: their pairs are met in several rounds and are those of one round."""
    rng = random.Random(8)
    common, other = [rng.getrandbits(63) for _ in range(2)]
    rows = [(c, i, h) for c in range(60) for i, h in enumerate([common, rng.getrandbits(63), *[other] * (c % 4 == 0)])]
    frame = spark.createDataFrame(rows, "clip long, step long, h long")
    rounds, count = [], media._in_rounds
    monkeypatch.setattr(media, "_in_rounds", lambda reach, right, n: rounds.append(n) or count(reach, right, n))
    monkeypatch.setattr(media, "EACH", 100)
    one = {tuple(r) for r in media.shared_step_pairs(frame)[0].collect()}
    monkeypatch.setattr(media, "EACH", 2)
    assert {tuple(r) for r in media.shared_step_pairs(frame)[0].collect()} == one
    assert one == {(a, b, 2) for a in range(0, 60, 4) for b in range(a + 4, 60, 4)} and rounds == [1, 8]


def test_passages_equal_steps_by_rows(spark):
    """Fingerprints of passages, made where a text is read, are those of votes that are added up by key; rows of one key vote together."""
    rng = random.Random(9)
    some = lambda n: " ".join(rng.choice(["The", "sea", "Is", "x1", "é", "--"]) + str(rng.randrange(40)) for _ in range(n))
    texts = [(i, some(rng.choice([0, 1, 23, 24, 25, 48, 300]))) for i in range(60)] + [(3, some(100)), (3, None), (7, some(30)), (None, some(50)), (90, None), (91, " -- ")]
    frame = spark.createDataFrame(texts, "k long, t string")
    length, votes = 24, defaultdict(list)
    for k, t in texts:
        words = re.findall("[a-z0-9]+", (t or "").lower())
        for nth in range(0, len(words), length):
            votes[k, nth // length] += [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for w in set(words[nth : nth + length])]
    rows = []
    for (k, nth), found in votes.items():
        h = sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in found) > len(found))
        rows.append((k, nth, h - (1 << 64 if h >> 63 else 0)))
    wanted = media.indexed_steps(spark.createDataFrame(rows, "clip long, step long, h long"))
    found = media.indexed_passages(frame, "k", "t", length)
    plain = lambda df: {r.clip: r.kept for r in df.collect() if r.kept}
    assert plain(found) == plain(wanted) and len(plain(found)) > 30


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(2000))
    whole = next(fingerprints._passage_bits(24)(iter([[text, None]])))
    monkeypatch.setattr(fingerprints, "AT_ONCE", 100)
    monkeypatch.setattr(fingerprints, "KEPT", 8)
    pieces = next(fingerprints._passage_bits(24)(iter([[text, None]])))
    assert whole[0].tolist() == pieces[0].tolist() and len(whole[0]) == 84 and not len(whole[1]) and not len(pieces[1])


# paths


def plain_path_cost(a, b):
    best = np.full((len(a) + 1, len(b) + 1), np.inf)
    best[0, 0] = 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = abs(x - y) + min(best[i, j], best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


def test_warping_paths_are_cheapest():
    rng = np.random.default_rng(8)
    for n, m in [(1, 1), (1, 7), (7, 1), (5, 9), (30, 21), (40, 40)]:
        a, b = rng.random(n), rng.random(m)
        i, j, cost = sequences.warping_path(a, b)
        assert (i[0], j[0], i[-1], j[-1]) == (0, 0, n - 1, m - 1)
        assert set(zip(np.diff(i).tolist(), np.diff(j).tolist())) <= {(0, 1), (1, 0), (1, 1)}
        assert np.isclose(cost.sum(), plain_path_cost(a, b))
        wide, near = sequences.warping_path(a, b, max(n, m))[2].sum(), sequences.warping_path(a, b, 2)[2].sum()
        assert np.isclose(wide, cost.sum()) and near >= cost.sum() - 1e-9


def test_path_query_equals_the_plain_cost(spark):
    found = registry.QUERIES["dtw_path_steps"](spark, SF).groupBy("user_id").agg(F.sum("cost").alias("c")).collect()
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect()
    users = defaultdict(list)
    for e in events:
        users[e.user_id].append(e.value)
    for r in found:
        v = users[r.user_id]
        assert len(v) <= 2 * 64 and abs(r.c - plain_path_cost(v[: len(v) // 2], v[len(v) // 2 :])) < 1e-3


# stages


def test_each_stage_drops_something(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    base = [rng.sample(words, 120) for _ in range(6)]
    rows = [(10 * i, " ".join(w)) for i, w in enumerate(base)] + [(10 * i + 1, " ".join([*w[:-1], "new"])) for i, w in enumerate(base)]
    rows += [(5, rows[0][1]), (6, None), (7, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    firsts = staged.exact_firsts(docs, "doc_id", "text")
    assert {r.doc_id: r.first for r in firsts.collect() if r.doc_id != r.first} == {5: 0, 7: 6, 8: 6}
    single = docs.join(firsts.where("doc_id = first"), "doc_id", "left_semi")
    wide = {r.doc_id: list(r.wide) for r in single.select("doc_id", wide_votes(F.col("text")).alias("wide")).collect()}
    bits = {k: sum(bin(x & (2**64 - 1)).count("1") for x in v) for k, v in wide.items()}
    assert bits[6] == 0 and all(100 < n < 900 for k, n in bits.items() if k != 6)
    pairs = spark.createDataFrame([(0, 1), (10, 11), (20, 21), (0, 10), (30, 31)], "a long, b long")
    near = staged.verified(pairs, single, "doc_id", "text")
    distance = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(wide[a], wide[b]))
    assert {tuple(r) for r in near.collect()} == {(a, b, distance(a, b)) for a, b in [(0, 1), (10, 11), (20, 21), (30, 31)]} and distance(0, 10) > 60
    left = staged.without_exclusions(near, spark.createDataFrame([(11, 10), (10, 11), (4, 4)], "a long, b long"))
    assert {(r.a, r.b) for r in left.collect()} == {(0, 1), (20, 21), (30, 31)}
    asked = []

    def first_scorer(misses):
        asked.extend((r.a, r.b) for r in misses.collect())
        return misses.where("a = 20").withColumn("score", F.lit(0.95))

    cache = spark.createDataFrame([(1, 0, "m", 0.3), (31, 30, "other", 0.9)], "a long, b long, model string, score double")
    found = staged.verdicts(left, cache, "m", [("m", first_scorer), ("fallback", lambda x: x.withColumn("score", F.lit(0.7)))])
    assert {tuple(r) for r in found.collect()} == {(0, 1, 0.3, "cache"), (20, 21, 0.95, "m"), (30, 31, 0.7, "fallback")}
    assert sorted(asked) == [(20, 21), (30, 31)]
    assert {tuple(r) for r in staged.updated_cache(cache, found, "m").collect()} == {(1, 0, "m", 0.3), (31, 30, "other", 0.9), (20, 21, "m", 0.95)}
    assert {(r.component, r.node) for r in staged.confirmed_groups(found, 0.9).collect()} == {(20, 20), (20, 21)}


def test_votes_equal_a_count_word_by_word(spark, monkeypatch):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(90)] + ["ÉTÉ", "K9", "x_y"]
    texts = [None, "", "...", "One one ONE"] + [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(2)
    found = {r.i: r for r in docs.select("i", word_votes(F.col("text")).alias("v"), wide_votes(F.col("text")).alias("wide")).collect()}
    for i, text in enumerate(texts):
        digests = [hashlib.md5(w.encode()).hexdigest() for w in set(re.findall("[a-z0-9]+", (text or "").lower()))]
        ones = [sum(int(d[:16], 16) >> bit & 1 for d in digests) for bit in range(64)]
        assert found[i].v.n == len(digests) and list(found[i].v.votes) == [ones[b] | ones[b + 32] << 32 for b in range(32)]
        sums = Counter()
        for d in digests:
            for k in range(8):
                x = int(d[3 * k : 3 * k + 3], 16)
                sums[x % 1024] += -1 if x // 1024 % 2 else 1
        assert {64 * lane + b for lane, x in enumerate(found[i].wide) for b in range(64) if x >> b & 1} == {b for b, n in sums.items() if n > 0}
    monkeypatch.setattr(fingerprints, "KEPT", 8)  # what is remembered is emptied again and again, and outgrown by one text
    hashes = fingerprints._Places((), "<u8", lambda d: int.from_bytes(d[:8], "big")).hashes
    for text in texts[1:]:
        low = text.lower()
        assert sorted(hashes(low).tolist()) == sorted(int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in set(re.findall("[a-z0-9]+", low)))


# bursts


@pytest.mark.parametrize(("skip", "drift", "wanted"), [((), 2, [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a")]), (("a",), 2, [("b", "b"), ("c", "b"), ("d", "b")]), ((), 0.1, [])])
def test_bursts_of_the_fixture(spark, skip, drift, wanted):
    rows = [
        (1, "a", True, 1.0, "f", ["trip"], 10.0), (1, "b", False, 0.95, "f", None, 11.0), (1, "c", False, 0.95, "g", ["trip"], 12.5), (1, "d", False, 0.95, "f", ["trip"], 13.0),
        (1, "e", False, 0.95, "f", None, 60.0), (1, "x", False, 0.6, "f", None, 11.5), (1, "u", False, 0.95, "f", None, None), (1, "z", False, 1.0, "h", ["other"], 11.0),
        (2, "y", False, 1.0, "f", ["trip"], 11.2),
    ]
    members = spark.createDataFrame([r for r in rows if r[1] not in skip], "grp int, member string, is_reference boolean, score double, folder string, albums array<string>, epoch double")
    found = bursts.bursts(members, drift, 0.9).orderBy("part", "burst", "place").collect()
    assert [(r.member, r.cover) for r in found] == wanted


# feeds and sketches


def test_feeds_keep_state_and_drop_what_is_late(spark):
    day = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    feed = lambda rows: spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("t"))
    feeds = [
        feed([("a", day(1, 1)), ("a", day(1, 5)), ("b", day(5, 23))]),
        feed([("b", day(6, 2)), ("a", day(2, 1)), ("c", day(5, 20))]),  # a's second row is behind the watermark, c's is not
        feed([("z", day(20))]),
        feed([("z", day(30))]),
    ]
    found = streams.fed(spark, feeds, lambda s: streams.session_counts(s, "t", "k", "6 hours", "1 day"), "test-sessions").collect()
    assert {(r.k, str(r.start), str(r.end), r.n) for r in found} == {
        ("a", "2024-01-01 01:00:00", "2024-01-01 11:00:00", 2), ("b", "2024-01-05 23:00:00", "2024-01-06 08:00:00", 2),
        ("c", "2024-01-05 20:00:00", "2024-01-06 02:00:00", 1), ("z", "2024-01-20 00:00:00", "2024-01-20 06:00:00", 1),
    }


def test_merged_sketches_stay_within_their_bound(spark):
    rows = spark.range(60_000).select((F.col("id") % 12).alias("day"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("who"))
    daily = sketches.period_sketches(rows, ["day"], "who")
    about = {r.half: r.about for r in sketches.merged_counts(daily, [F.expr("day div 6").alias("half")]).collect()}
    exact = {r.half: r.n for r in rows.groupBy(F.expr("day div 6").alias("half")).agg(F.count_distinct("who").alias("n")).collect()}
    assert all(abs(about[h] - exact[h]) <= 4 * 1.04 / math.sqrt(2**sketches.LOG_REGISTERS) * exact[h] for h in exact)
    whole = sketches.merged_counts(daily, [F.lit(0).alias("all")]).first().about
    assert abs(whole - rows.select("who").distinct().count()) <= 0.07 * 20_000


# products of vectors


def test_vectors_are_sent_to_no_more_blocks_than_the_spread(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    monkeypatch.setattr(neighbours, "SPREAD", 4)
    rng = np.random.default_rng(5)
    vectors, frame = unit_frame(spark, np.concatenate([clouds(rng, 6, 20, 0.15), rng.normal(size=(40, 24))]))
    sent, multiplied = [], neighbours._multiplied
    monkeypatch.setattr(neighbours, "_multiplied", lambda left, right, *rest: (sent.append(left.count() + right.count()), multiplied(left, right, *rest))[1])
    near = np.argwhere(np.triu(1 - vectors @ vectors.T <= 0.55, 1)).tolist()
    for found in (neighbours.near_links(frame, 0.55), neighbours.approximate_links(frame, 0.55)):
        assert components(len(vectors), [(r.a, r.b) for r in found.collect()]) == components(len(vectors), near)
    # one copy for each block and one more, whatever the number of tables or pivots
    assert sent == [5 * len(vectors)] * 2
    labelled = frame.withColumn("cell", F.col("key") % 3)
    apart = [(a, b) for a, b in near if a % 3 == b % 3]
    assert components(len(vectors), [(r.a, r.b) for r in neighbours.links_within(labelled, 0.55).collect()]) == components(len(vectors), apart)


def test_tables_and_pivots_are_used_where_they_cost_less(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "SENT", 0)
    rng = np.random.default_rng(2)
    vectors, frame = unit_frame(spark, clouds(rng, 60, 10, 0.05))
    exact = components(len(vectors), np.argwhere(np.triu(1 - vectors @ vectors.T <= 0.02, 1)).tolist())
    used, cells, pivots = [], neighbours.hyperplane_cells, neighbours._products
    monkeypatch.setattr(neighbours, "hyperplane_cells", lambda *a: (used.append("tables"), cells(*a))[1])
    monkeypatch.setattr(neighbours, "_products", lambda *a: (used.append("cells"), pivots(*a))[1])
    pairs = lambda groups: {p for g in groups for p in itertools.combinations(sorted(g), 2)}
    found = pairs(components(len(vectors), [(r.a, r.b) for r in neighbours.approximate_links(frame, 0.02, bucket=8).collect()]))
    assert used == ["tables", "cells"] and found <= pairs(exact) and len(found) >= 0.9 * len(pairs(exact))
    assert components(len(vectors), [(r.a, r.b) for r in neighbours.near_links(frame, 0.02).collect()]) == exact
    assert used == ["tables", "cells", "cells"]


def test_a_stored_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_\d+_\S+?\.data", disk.getAllFiles().mkString(" ")))
    before, setting = shuffles(), spark.conf.get(shared.FILES_GO, None)
    rows = spark.range(0, 1000, 1, 4).selectExpr("id % 7 AS k", "id").groupBy("k").agg(F.sum("id").alias("s"))
    table = shared.stored(rows.join(rows.withColumnRenamed("s", "t"), "k"), "no-shuffles")
    assert not shuffles() - before
    assert spark.conf.get(shared.FILES_GO, None) == setting
    assert table.count() == 7 and table.where("s = t").count() == 7
