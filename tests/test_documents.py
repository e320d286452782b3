"""HTML readers, positions, storage templates, tracks, indexes, passages and tokens against fixtures and plain versions."""

import html as entities
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaymark.functions import coordinates, html, places, text
from quaymark.functions.tokens import Fields, search
from quaymark.operators import incremental, keyframes
from quaymark.plans import registry
from quaymark.sources.shared import new_path

SF = "/root/testdata/sf0.001"

# pages

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class=x>before
<h1 id="a">One &amp; only</h1><p onclick="x()">caf&eacute; &#8364; <b>b&lt;c</b><br/>x<script>var a = '<p>';</script></p>
<H2>Two</H2><a href="javascript:alert(1)" title='q"'>bad</a> <a href=/ok?a=1&amp;b=2>good</a><custom>in</custom> &copy; &bogus; <img src="http://h/i.png" alt=i>
<h2></h2></body></html>"""


def test_html_is_read_with_references():
    assert html.text_of("<p>a &amp; b&nbsp;&eacute;</p>\n<script>x</script> c") == "a & b é c"
    assert html.text_of("") == "" and html.text_of("<p") in ("", "<p")
    assert [(t, w) for t, _, _, w in html.sections_of(PAGE)] == [("", 1), ("One & only", 4), ("Two", 3)]
    assert html.sections_of(PAGE)[1][2] == "One & onlycafé € b<cx"
    clean = html.clean_of(PAGE)
    assert '<h1 id="a">One &amp; only</h1><p>café € <b>b&lt;c</b><br>x</p>' in clean
    assert '<a title="q&quot;">bad</a> <a href="/ok?a=1&amp;b=2">good</a>in © &amp;bogus; <img src="http://h/i.png" alt="i">' in clean
    assert "script" not in clean and "onclick" not in clean and "javascript" not in clean
    assert html.clean_of(clean) == clean


def test_page_queries_equal_a_plain_reading(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}

    def plain(page):
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", page)
        bare = re.sub(r"(?s)<!--.*?-->|<![^>]*>|</?[a-zA-Z][^>]*>", "", bare)
        return re.sub(r"\s+", " ", entities.unescape(bare)).strip()

    found = registry.QUERIES["page_readings"](spark, SF).collect()
    assert {r.page_id: r.text for r in found} == {k: plain(p) for k, p in pages.items()}
    for r in found:
        assert html.text_of(r.clean) == r.text or "<title" in pages[r.page_id] or html.text_of(r.clean).replace(" ", "") == r.text.replace(" ", "")
    parts = defaultdict(list)
    for r in registry.QUERIES["page_sections"](spark, SF).orderBy("page_id", "nth").collect():
        parts[r.page_id].append(r)
    for k, page in pages.items():
        body = re.search(r"(?is)<body[^>]*>(.*)</body>", page)
        whole = plain(body[1] if body else page)
        assert "".join(r.text for r in parts[k]).replace(" ", "") == whole.replace(" ", "")
        assert sum(r.words for r in parts[k]) >= len(re.findall(r"\w+", whole))
        assert [r.title for r in parts[k] if r.title] == [plain(h) for h in re.findall(r"(?is)<h[12][^>]*>(.*?)</h[12]>", body[1] if body else page) if plain(h)]


# positions


def test_positions_of_the_fixture(spark):
    rows = [("37,46.27N",), ("122,25.5W",), ("48,51,29.6N",), ("-33.5",), ("33.5s",), ("x",), (None,), ("48,",)]
    found = spark.createDataFrame(rows, "v string").select(F.round(coordinates.xmp_degrees(F.col("v")), 6)).collect()
    assert [r[0] for r in found] == [37.771167, -122.425, 48.858222, -33.5, -33.5, None, None, None]
    rows = [("37/1 46/1 1629/100", "N"), ("37/1,46/1", "South"), ("10", "w"), ("1/0 2 3", "N"), ("", "N"), (None, None), ("a b", "N"), ("5/", None)]
    found = spark.createDataFrame(rows, "v string, s string").select(coordinates.exif_degrees(F.col("v"), F.col("s"))).collect()
    wanted = [37 + 46 / 60 + 16.29 / 3600, -37 - 46 / 60, -10.0, None, None, None, None, 5.0]
    assert all(r[0] is None if w is None else math.isclose(r[0], w) for r, w in zip(found, wanted))
    rows = [("+37.7749-122.4194+010.000/",), ("+00.0+000.0/",), ("+91.0+010.0/",), ("+10.0+181.0/",), (None,), ("no",)]
    found = spark.createDataFrame(rows, "v string").select(coordinates.iso6709(F.col("v"))).collect()
    assert [r[0] and tuple(r[0]) for r in found] == [(37.7749, -122.4194), None, None, None, None, None]


# places


def test_storage_templates(spark):
    row = [("Été: à la mer", "IMG_1", ".JPG", 7, None, "a/b", "users/ana/in/x.jpg")]
    frame = spark.createDataFrame(row, "title string, name string, ext string, month int, empty string, folder string, path string")
    fields = {c: F.col(c) for c in frame.columns}
    render = lambda t: frame.select(places.rendered_path(t, fields)).first()[0]
    assert render("{month|pad2}/{title|slug}") == "07/ete-a-la-mer/IMG_1.JPG"
    assert render("{empty}/{folder|upper}/ - {empty} -/{name}{ext}") == "A-B/IMG_1.JPG"
    assert render("{empty|default:none}/{unknown}x/{name|lower}") == "none/x/img_1.JPG"
    assert render("{title}/{name}.jpg") == "Été: à la mer/IMG_1.jpg" and render("") == "IMG_1.JPG" and render("../{empty}/{folder|what}") == "a-b/IMG_1.JPG"
    guard = lambda target: frame.select(places.in_owner_tree(F.lit(target), F.col("path"))).first()[0]
    assert guard("2024/x.jpg") == "users/ana/2024/x.jpg" and guard("Users/Ana/x.jpg") == "Users/Ana/x.jpg"
    clash = spark.createDataFrame([(1, "a/b.jpg"), (2, "a/B.jpg"), (3, "a/b.jpg"), (4, "a/.hid"), (5, "a/.hid")], "k int, t string")
    assert [r.t for r in places.without_clashes(clash, "k", "t").orderBy("k").collect()] == ["a/b.jpg", "a/B (2).jpg", "a/b (3).jpg", "a/.hid", "a/.hid (2)"]


# tracks


def test_track_of_the_fixture(spark):
    frames = [(1, 1, t, cx, 0.5, 0.1, 0.1, out) for t, cx, out in [(0, 0.2, False), (2, 0.6, None), (4, 0.8, True), (6, 0.9, False)]]
    keys = spark.createDataFrame([*frames, (1, 1, None, 0.1, 0.5, 0.1, 0.1, False), (2, 9, 5, 0.1, 0.5, 0.1, 0.1, False)], "video int, track int, t int, cx double, cy double, w double, h double, outside boolean")
    moments = spark.createDataFrame([(1, t) for t in (-1, 0, 1, 2, 3, 4, 5, 6, 7)] + [(2, 5), (2, 6), (1, None)], "video int, t int")
    found = {(r.video, r.t): round(r.cx, 9) for r in keyframes.boxes_at(keys, moments).collect()}
    assert found == {(1, 0): 0.2, (1, 1): 0.4, (1, 2): 0.6, (1, 3): 0.7, (1, 6): 0.9, (2, 5): 0.1}


def test_tracks_dealt_out_equal_a_plain_loop(spark, monkeypatch):
    """Videos of more keyframes than come together, keyframes of one time, nulls in boxes, more moments than go out at a time."""
    monkeypatch.setattr(keyframes, "TOGETHER", 40)
    rng, rows = random.Random(5), []
    for i in range(400):
        track = rng.randrange(24)
        rows.append((f"v{track % 3}" if i % 50 else None, track, rng.randrange(90) if i % 37 else None, rng.random() if i % 11 else None, rng.random(), 0.1 + i / 1000, 0.2, rng.random() < 0.2))
    asked = [(f"v{rng.randrange(4)}", rng.randrange(-5, 95)) for _ in range(150)] + [(None, 5), ("v1", None)]
    keys = spark.createDataFrame(rows, "video string, track long, t long, cx double, cy double, w double, h double, outside boolean")
    found = sorted(map(repr, map(tuple, keyframes.boxes_at(keys, spark.createDataFrame(asked, "video string, t long")).collect())))
    last = {}
    for video, track, t, *box, outside in rows:
        if video is not None and t is not None:
            order = [(b is None, b or 0.0) for b in box]
            last[video, track, t] = max(last.get((video, track, t), ([], None, None)), (order, box, outside), key=lambda x: x[0])
    wanted = []
    for (video, track, t), (_, box, outside) in last.items():
        later = min((x for v, k, x in last if (v, k) == (video, track) and x > t), default=None)
        for at in {x for v, x in asked if v == video and x is not None and not outside and (t <= x < later if later is not None else x == t)}:
            then = last[video, track, later][1] if later is not None else box
            moved = box if later is None else [None if a is None or b is None else a + (b - a) * (at - t) / (later - t) for a, b in zip(box, then)]
            wanted.append(repr((video, track, at, *moved)))
    assert found == sorted(wanted) and len(found) > 300


def test_moments_go_out_in_pieces(monkeypatch):
    """A piece ends where its moments are enough, whatever a row has; all rows and moments come."""
    monkeypatch.setattr(keyframes, "AT_ONCE", 4)
    t, later = [0, 3, 5, 90, 40, 99, 7], [30, 4, 6, None, 41, 100, None]
    rows = pa.record_batch({"t": pa.array(t), "later": pa.array(later, pa.int64())})
    pieces = list(keyframes._within(rows, np.arange(0, 95, 2)))
    assert len(pieces) > 1
    found = [(r["t"], r["later"], r["moments"]) for p in pieces for r in p.to_pylist()]
    assert found == [(a, b, m) for a, b in zip(t, later) if (m := [x for x in range(0, 95, 2) if (a <= x < b if b is not None else x == a)])]


# indexes


def test_index_takes_in_changes_only(spark):
    path, read = new_path(spark, "test-index"), []

    def extract(rows):
        read.append(sorted(r.k for r in rows.collect()))
        return rows.withColumn("info", F.concat(F.lit(f"pass {len(read)} of "), "k"))

    files = lambda rows: spark.createDataFrame(rows, "k string, mtime double, size long")
    index, found = incremental.update(spark, path, files([("a", 1.0, 1), ("b", 1.0, 1), ("c", None, 1), ("d", 1.0, 1)]), "k", extract)
    assert index.count() == 4 and {r.change for r in found.collect()} == {"new"}
    index, found = incremental.update(spark, path, files([("a", 1.005, 1), ("b", 1.0, 2), ("c", 2.0, 1), ("e", 1.0, None)]), "k", extract)
    assert {(r.k, r.change) for r in found.collect()} == {("b", "changed"), ("c", "changed"), ("d", "gone"), ("e", "new")}
    assert {(r.k, r.info) for r in index.collect()} == {("a", "pass 1 of a"), ("b", "pass 2 of b"), ("c", "pass 2 of c"), ("e", "pass 2 of e")}
    assert read == [["a", "b", "c", "d"], ["b", "c", "e"]]
    again, found = incremental.update(spark, path, index.select("k", "mtime", "size"), "k", extract)
    assert found.count() == 0 and again.count() == 4 and incremental.latest(spark, path)[1] == 3


# passages


def test_passages_equal_a_plain_ranking(spark):
    from hashlib import md5

    def vector(value):
        votes = Counter()
        for word in re.split("[^a-z0-9]+", value.lower()):
            if word:
                x = int(md5(word.encode()).hexdigest()[:4], 16)
                votes[x % 64] += 1 - 2 * (x // 64 % 2)
        length = math.sqrt(sum(n * n for n in votes.values()))
        return {a: n / length for a, n in votes.items() if n} if length else {}

    question = vector(spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text)
    pieces = text.chunks(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text").collect()
    scored = defaultdict(list)
    for r in pieces:
        v = vector(r.piece)
        if any(a in question for a in v):
            scored[r.doc_id].append((-sum(x * question.get(a, 0) for a, x in v.items()), r.chunk))
    wanted = {(d, c, i + 1): round(-s, 5) for d, found in scored.items() for i, (s, c) in enumerate(sorted((round(s, 9), c) for s, c in found)[:3])}
    found = {(r.doc_id, r.chunk, r.place): r.score for r in registry.QUERIES["passage_hits"](spark, SF).collect()}
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 2e-5 for k in wanted)


# tokens


@pytest.mark.parametrize(
    ("asked", "wanted"),
    [
        ("gps:yes", {1, 2, 3}), ("gps:no", {4, 5}), ("-gps:yes", {4, 5}), ("near:48.8584,2.2945,2", {1}), ("near:48.8584,2.2945", {1}), ("near:x,1", set()), ("bbox:40,170,60,-150", {3}),
        ("bbox:40,0,60,10", {1, 2}), ("-bbox:40,0,60,10", {3, 4, 5}), ("desc:SEA", {1, 4}), ("owner:ana", {1, 2}), ("-owner:ana", {3, 4, 5}), ("-owner:nobody desc:sea", {1, 4}), ("owner:? gps:no", {4, 5}),
    ],
)
def test_tokens_of_positions_parts_and_tables(spark, asked, wanted):
    rows = [(1, 48.858, 2.294, "by the sea"), (2, 50.0, 9.0, "hill"), (3, 51.0, 179.0, None), (4, None, None, "Sea"), (5, 1.0, None, "x")]
    files = spark.createDataFrame(rows, "k int, lat double, lon double, d string")
    people = spark.createDataFrame([("ana", 1), ("ana", 2), ("ana", 2)], "who string, k int")
    relations = {"owner": lambda v: None if v == "?" else people.where(F.col("who") == v)}
    fields = Fields(key="k", tags=F.array().cast("array<string>"), parts={"desc": F.col("d")}, position=(F.col("lat"), F.col("lon")), relations=relations)
    assert {r.k for r in search(files, asked, fields).collect()} == wanted


def test_text_tokens_find_something(spark):
    assert registry.QUERIES["text_tokens"](spark, SF).count() > 0


def test_pages_and_texts_go_to_workers_few_at_a_time(spark):
    """Plans without Arrow batches, which hold ten thousand rows."""
    column = F.col("html")
    pages = spark.createDataFrame([(1, "<h1>A</h1><p>b &amp; c</p>"), (2, None)], "page_id int, html string")
    made = pages.select("page_id", html.html_to_text(column).alias("text"), html.sanitised(column), html.heading(column))
    assert [r.text for r in made.orderBy("page_id").collect()] == ["Ab & c", None]
    for frame in (made, html.sections(pages, "page_id", "html"), text.chunks(pages, "page_id", "html")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "Arrow" not in plan and "MapInPandas" not in plan
