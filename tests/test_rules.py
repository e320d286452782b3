"""Rules over files, verdicts on boxes, and the queries that SQL can't say, against plain versions over whole tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.functions import html, rules
from quaymark.operators import boxes, files
from quaymark.operators.similarity import haversine
from quaymark.plans import registry  # isort: skip
from quaymark.plans import regions

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# rules


@pytest.mark.parametrize(
    ("name", "wanted"),
    [
        ("Exif.Photo.DateTimeOriginal", "d_original"), ("Exif.Image.DateTime", "d_actual"), ("Exif.Image.ModifyDate", "d_actual"), ("Exif.Photo.CreateDate", "d_digitized"), ("Xmp.xmp.CreateDate", "d_actual"),
        ("Xmp.xmp.ModifyDate", "d_modified"), ("Iptc.Digital.DateCreated", "d_digitized"), ("Xmp.x.CaptureTime", "d_capture"), ("Exif.Photo.OffsetTime", None), ("Exif.Photo.SubSecTimeOriginal", None), ("Exif.Image.Model", None), (None, None),
    ],
)
def test_date_buckets(spark, name, wanted):
    assert one(spark, rules.date_bucket(F.lit(name).cast("string"))) == wanted


def test_names_and_leftovers(spark):
    asked = [("lib/a/IMG_1_2.JPG", ("img_1_2", "img_1"), "lib/a"), ("x.tar.gz", ("x.tar", "x.tar"), ""), ("a\\b\\ C_12.png", ("c_12", "c"), ""), (".hidden", (".hidden", ".hidden"), ""), (None, ("", ""), "")]
    for path, keys, folder in asked:
        c = F.lit(path).cast("string")
        assert tuple(one(spark, rules.stem_keys(c))) == keys and one(spark, rules.folder_of(c)) == folder
    assert [one(spark, rules.temporary(F.lit(n))) for n in ("a.PART", "~$x.docx", "a.part.jpg", "~lock.x#", "b.!qB")] == [".part", "~$", None, "~lock.", ".!qb"]
    orphans = spark.createDataFrame([("f", n) for n in ("IMG_1.xmp", "IMG_1.jpg", "b.jpg.xmp", "b.jpg", "c.xmp", "c.txt", "d.XMP")] + [("g", "IMG_1.xmp")], "folder string, name string")
    assert {tuple(r) for r in files.orphan_sidecars(orphans).collect()} == {("f", "c.xmp"), ("f", "c.txt"), ("f", "d.XMP"), ("g", "IMG_1.xmp")}


def test_texts(spark):
    assert [one(spark, rules.truthy(F.lit(v).cast("string"))) for v in ("yes", " NO ", "0", "", None, "null", "00")] == [True, False, False, False, False, False, True]
    book = "Produced\n*** START OF THIS PROJECT GUTENBERG EBOOK É ***body\n***END OF THE PROJECT GUTENBERG X*** license"
    assert one(spark, rules.without_boilerplate(F.lit(book))) == "body\n"
    assert one(spark, rules.without_boilerplate(F.lit("*** END OF THE PROJECT GUTENBERG X*** *** START OF THE PROJECT GUTENBERG X***rest"))) == "rest"
    assert one(spark, rules.without_boilerplate(F.lit("plain"))) == "plain"
    tags = F.array(*map(F.lit, ["score_up: 1,200", "Score_Down=x", "score_down= 7", "site : E621", "views", "xscore_up: 3"]), F.lit(None))
    assert tuple(one(spark, rules.engagement(tags))) == (1200.0, 7.0, None, "e621")
    assert tuple(one(spark, rules.engagement(F.lit(None).cast("array<string>")))) == (None, None, None, None)


def test_text_verdicts(spark):
    tags = "red, blue, green, " + "tree, " * 100
    asked = [(9, "x", False, "sidecar"), (9000, "x " * 4500, True, "sidecar"), (700, tags, False, "sidecar"), (700, tags + "End. \nNo", False, "triage"), (5000, "é" * 2500, False, "triage"), (5000, "words of prose. " * 320, False, "book"), (5000, "\x00" * 5000, False, "skip")]
    for size, value, owner, wanted in asked:
        assert one(spark, rules.text_verdict(F.lit(size), F.lit(value), F.lit(owner)))["verdict"] == wanted


def test_page_verdicts_equal_a_plain_rule(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()

    def plain(r):
        size, seen, low = len(r.html.encode()), len(html.text_of(r.html)), r.html.lower()
        if r.page_id % 9 == 0:
            return "part"
        if r.page_id % 7 == 0:
            return "skip"
        if r.page_id % 8 == 0:
            return "part"
        if size < 8192 and seen < 1500 or low.count("<a ") > 60 and seen < 4000:
            return "skip"
        return "book" if seen > 6000 else "triage"

    found = {r.page_id: r.verdict for r in registry.QUERIES["page_file_verdicts"](spark, SF).collect()}
    assert found == {r.page_id: plain(r) for r in pages}


def test_kilometres(spark):
    point = lambda *p: [F.lit(float(x)) for x in p]
    km = one(spark, haversine(*point(38.72, -9.14), *point(41.15, -8.61)))
    assert 270 < km < 280 and one(spark, haversine(*point(0, 0), *point(0, 180))) == pytest.approx(math.pi * 6371)


def test_towns_of_a_name(spark):
    towns = spark.createDataFrame([(1, "Springfield", "US", "Illinois", 39.8, -89.6), (2, "Springfield", "US", "Ohio", 39.9, -83.8), (3, "Porto", "PT", None, 41.1, -8.6), (4, "Porto", "PT", "Porto", 41.2, -8.5)], "town int, city string, cc string, state string, lat double, lon double")
    wants = [(1, " springfield", None, None), (2, "Springfield", "us", "oh"), (3, "Springfield", "US", "Ohio"), (4, "PORTO", None, "nowhere"), (5, "Porto", "ES", None), (6, None, None, None), (7, "", "US", None)]
    found = files.typed_places(spark.createDataFrame(wants, "want int, city string, cc string, state string"), towns, {"OH": "Ohio"})
    assert {r.want: r.town for r in found.collect()} == {2: 2, 3: 2, 4: 3}


@pytest.mark.parametrize(
    ("lines", "wanted"),
    [
        (["name,score", "a.jpg, 7.5", "b.jpg,12", "c", "d,-1"], {"a.jpg": 0.075, "b.jpg": 0.12, "d": 0.0}), (["a\t0.5", "b\t1"], {"a": 0.5, "b": 1.0}),
        (["1 953 0 1 5 17 38 36 15 6 5 1 1 22", "2 954 0 0 0 0 0 0 0 0 0 0 1 1"], {"953": 0.56370967}),
    ],
)
def test_label_files(spark, tmp_path, lines, wanted):
    (tmp_path / "labels.txt").write_text("\n".join(lines))
    found = {r.name: r.score for r in files.read_labels(spark, f"file://{tmp_path}/labels.txt").collect()}
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-6 for k in wanted)


# boxes


def overlap(a, b):
    w = min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2)
    h = min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2)
    shared = max(w, 0) * max(h, 0)
    return shared / (a[2] * a[3] + b[2] * b[3] - shared) if shared else 0.0


def test_verdicts_on_boxes(spark):
    schema = "image int, key int, kind string, cx double, cy double, w double, h double"
    truth = [(1, 1, "a", 0.2, 0.2, 0.2, 0.2), (1, 2, "a", 0.21, 0.2, 0.2, 0.2), (1, 3, "b", 0.7, 0.7, 0.2, 0.2), (1, 4, "a", 0.7, 0.2, 0.2, 0.2), (1, 5, "c", 0.2, 0.7, 0.2, 0.2), (2, 6, "a", 0.5, 0.5, 0.1, 0.1)]
    guesses = [(1, 11, "a", 0.2, 0.2, 0.2, 0.2), (1, 12, "a", 0.2, 0.21, 0.2, 0.2), (1, 13, "b", 0.7, 0.7, 0.12, 0.2), (1, 14, "a", 0.7, 0.2, 0.32, 0.2), (1, 15, "d", 0.2, 0.7, 0.2, 0.2), (3, 16, "a", 0.5, 0.5, 0.1, 0.1), (3, 17, None, None, 0.5, 0.1, 0.1)]
    found = boxes.box_diff(spark.createDataFrame(truth, schema), spark.createDataFrame(guesses, schema)).collect()
    assert {(r.image, r.verdict, r.gt, r.pred, r.confused_with) for r in found} == {
        (1, "dup_gt", 2, None, None), (1, "correct", 1, 11, None), (1, "tightened", 3, 13, None), (1, "loosened", 4, 14, None), (1, "dropped", 5, None, None),
        (1, "dup_pred", None, 12, None), (1, "added", None, 15, "c"), (2, "dropped", 6, None, None), (3, "added", None, 16, None),
    }
    assert boxes.box_diff(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).collect() == []


def by_image(spark):
    found = defaultdict(list)
    for r in regions._boxes(spark, SF).collect():
        found[r.image].append(r)
    return found


def box(r):
    return r.cx, r.cy, r.w, r.h


def test_distinct_boxes_equal_a_plain_loop(spark):
    wanted = set()
    for image, rows in by_image(spark).items():
        kept = []
        for r in sorted(rows, key=lambda r: (-(r.w * r.h), r.key)):
            if all(overlap(box(r), box(k)) <= 0.55 for k in kept):
                kept.append(r)
        wanted |= {(image, k.key) for k in kept}
    assert {(r.image, r.key) for r in registry.QUERIES["box_distinct"](spark, SF).collect()} == wanted


def test_tracks_equal_a_plain_loop(spark):
    wanted = {}
    for rows in by_image(spark).values():
        before, now, at, n = [], [], None, 0
        for r in sorted(rows, key=lambda r: (r.line, r.key)):
            if r.line != at:
                before, now, at = now, [], r.line
            near = [(overlap(box(r), box(o)), -t) for t, o in before if o.kind == r.kind]
            best, t = max(near, default=(0, 0))
            if best > 0.3:
                t = -t
                before = [(u, o) for u, o in before if u != t]
            else:
                n += 1
                t = n
            now.append((t, r))
            wanted[r.key] = wanted.get(r.key, Counter())
            wanted[r.key][t] += 1
    found = defaultdict(Counter)
    for r in registry.QUERIES["box_tracks"](spark, SF).collect():
        found[r.key][r.track] += 1
    single = {k for k, rows in Counter(r.key for rows in by_image(spark).values() for r in rows).items() if rows == 1}
    repeated = {r.image for rows in by_image(spark).values() for r in rows if r.key not in single}
    keys = {r.key for image, rows in by_image(spark).items() if image not in repeated for r in rows}
    assert len(keys) > 1000 and {k: found[k] for k in keys} == {k: wanted[k] for k in keys}


def test_panels_are_read_by_rows(spark):
    wanted = defaultdict(list)
    for image, rows in by_image(spark).items():
        left = sorted(((r.cy - r.h / 2, r.cx, r.key, r.cy + r.h / 2) for r in rows))
        while left:
            top, low, row, rest = left[0][0], left[0][3], [left[0]], []
            for p in left[1:]:
                if min(p[3], low) - max(p[0], top) > 0.4 * min(p[3] - p[0], low - top):
                    row.append(p)
                    top, low = min(top, p[0]), max(low, p[3])
                else:
                    rest.append(p)
            wanted[image] += [p[2] for p in sorted(row, key=lambda p: (p[1], p[0], p[2]))]
            left = rest
    found = defaultdict(list)
    for r in registry.QUERIES["panel_order"](spark, SF).orderBy("image", "place").collect():
        found[r.image].append(r.key)
    assert found == wanted


# vectors, trips, sequences, chunks


def vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return rows, {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(r.embedding) for r in rows}


def test_leaders_equal_a_plain_loop(spark):
    rows, unit = vectors(spark)
    sums, wanted = defaultdict(list), {}
    for r in rows:
        scores = [s @ unit[r.vec_id] / np.linalg.norm(s) for s in sums[r.label]]
        if scores and max(scores) >= 0.3:
            at = int(np.argmax(scores))
            sums[r.label][at] = sums[r.label][at] + unit[r.vec_id]
        else:
            at = len(scores)
            sums[r.label].append(unit[r.vec_id])
        wanted[r.vec_id] = at
    assert {r.vec_id: r.cluster for r in registry.QUERIES["leader_groups"](spark, SF).collect()} == wanted


def test_farthest_equal_a_plain_loop(spark):
    _, unit = vectors(spark)
    picks = [min(unit)]
    while len(picks) < 8:
        picks.append(min((k for k in unit if k not in picks), key=lambda k: (round(max(unit[k] @ unit[p] for p in picks), 12), k)))
    assert [r.vec_id for r in registry.QUERIES["farthest_sample"](spark, SF).orderBy("pick").collect()] == picks


def test_kmeans_is_settled(spark):
    _, unit = vectors(spark)
    labels = {r.vec_id: r.cluster for r in registry.QUERIES["vector_kmeans"](spark, SF).collect()}
    assert labels.keys() == unit.keys() and len(set(labels.values())) == 16
    centres = {c: np.mean([unit[k] for k in unit if labels[k] == c], axis=0) for c in set(labels.values())}
    centres = {c: v / np.linalg.norm(v) for c, v in centres.items()}
    best = {k: max(centres, key=lambda c: unit[k] @ centres[c]) for k in unit}
    assert sum(best[k] == labels[k] for k in unit) >= 0.93 * len(unit)


def events(spark):
    users = defaultdict(list)
    for e in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect():
        users[e.user_id].append(e)
    return users


def test_trips_equal_a_plain_loop(spark):
    def km(a, b):
        y1, x1, y2, x2 = map(math.radians, (*a, *b))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    wanted = {}
    for rows in events(spark).values():
        trip, last, place = 0, None, None
        for e in rows:
            here = (e.value % 90, e.value % 180) if e.event_id % 3 else None
            if last is None or (e.ts - last).total_seconds() > 36 * 3600 or (place and here and km(place, here) > 2000):
                trip, place = trip + 1, None
            last, place = e.ts, here or place
            wanted[e.event_id] = trip
    assert {r.event_id: r.trip for r in registry.QUERIES["trips_stateful"](spark, SF).collect()} == wanted


def test_alignment_scores_equal_a_plain_loop(spark):
    found = {r.user_id: r.score for r in registry.QUERIES["dtw_scores"](spark, SF).collect()}
    for user, rows in events(spark).items():
        v = [e.value / 1000 for e in rows]
        a, b = v[: len(v) // 2], v[len(v) // 2 :]
        best = np.full((len(a) + 1, len(b) + 1), np.inf)
        best[0, 0] = 0
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = abs(x - y) + min(best[i, j], best[i, j + 1], best[i + 1, j])
        assert len(b) <= 256 and abs(found[user] - min(max(1 - best[-1, -1] / max(len(a), len(b)), 0), 1)) < 1e-5



def test_chunks_equal_a_plain_loop(spark):
    wanted = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        at, n = 0, 0
        while at < len(r.text):
            end = at + 1200
            if end < len(r.text):
                ends = [i for mark in (". ", "! ", "? ", ".\n") for i in range(max(end - 300, 0), end - 1) if r.text[i : i + 2] == mark]
                if ends and max(ends) > at:
                    end = max(ends) + 1
            piece = r.text[at:end].strip()
            if len(piece) > 80:
                wanted.add((r.doc_id, n, piece))
                n += 1
            if end >= len(r.text):
                break
            at = max(end - 200, at + 1)
    assert {tuple(r) for r in registry.QUERIES["chunk_passages"](spark, SF).collect()} == wanted
