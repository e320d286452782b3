"""Dates, tags, boxes and scopes on small cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from quaymark.functions.fields import date_range, filled, merged_tags, parse_date, rendered
from quaymark.operators.boxes import best_matches, distinct_boxes, reading_order, tracks
from quaymark.operators.scopes import box_around, even_members, numbered_names, within_tolerance

BOX = "cx double, cy double, w double, h double"


def test_dates(spark):
    cases = {
        "2021-03-04T10:00": (2021, 3, 4), "2021:03:04 10:00:00": (2021, 3, 4), "20210304": (2021, 3, 4), "4.3.2021": (2021, 3, 4), "03/25/2021": (2021, 3, 25),
        "2021": (2021, 1, 1), "2021-02-31": (2021, 2, 28), "1700-01-01": None, "x": None, None: None, "2021-13-01": None, "123456789": None,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "t string").select("t", parse_date(F.col("t")).alias("d"))
    assert {r.t: r.d for r in frame.collect()} == {k: v and datetime.date(*v) for k, v in cases.items()}


def test_ranges_blanks_tags_and_templates(spark):
    row = spark.range(1).select(
        date_range(F.lit("2024-06-03").cast("date"), F.lit("2024-06-05").cast("date")).alias("r"),
        F.array(filled(F.lit(" "), F.lit("n")), filled(F.lit("c"), F.lit("n"))).alias("f"),
        merged_tags(F.array(F.lit("Red"), F.lit("a")), F.array(F.lit("RED"), F.lit("B"), F.lit("A"))).alias("t"),
        merged_tags(F.lit(None).cast("array<string>"), F.array(F.lit("B"))).alias("u"),
        rendered("{a} - {b}", {"a": F.lit("x"), "b": F.lit(None)}).alias("s"),
    ).first()
    assert (row.r, row.f, row.t, row.u, row.s) == ("3-5 Jun 2024", ["n", "c"], ["Red", "a", "B"], ["B"], "x")


def test_boxes(spark):
    rows = [("i", 1, 0.5, 0.5, 0.4, 0.4), ("i", 2, 0.51, 0.5, 0.38, 0.4), ("i", 3, 0.1, 0.1, 0.1, 0.1), ("j", 4, 0.5, 0.5, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, f"image string, key long, {BOX}")
    assert {r.key for r in distinct_boxes(frame, "image", "key", 0.55).collect()} == {1, 3, 4}
    assert [(r.a, r.b) for r in best_matches(frame.where("key = 2"), frame.where("key <> 2"), "image", "key", 0.3).collect()] == [(2, 1)]


def test_tracks_follow_overlap(spark):
    rows = [("v", f, "cat", 10 * f + k, 0.2 + 0.02 * f + 0.5 * k, 0.5, 0.2, 0.2) for f in range(3) for k in range(2)] + [("v", 3, "dog", 30, 0.24, 0.5, 0.2, 0.2), ("v", 5, "cat", 50, 0.24, 0.5, 0.2, 0.2)]
    frame = spark.createDataFrame(rows, f"video string, frame int, kind string, key long, {BOX}")
    found = {r.key: r.track for r in tracks(frame, "video", "frame", "kind", "key").collect()}
    assert found == {0: 1, 10: 1, 20: 1, 1: 2, 11: 2, 21: 2, 30: 3, 50: 4}


def test_scopes(spark):
    points = spark.createDataFrame([(0.0, 179.5), (0.0, -179.5), (0.0, 0.0)], "lat double, lon double")
    assert points.where(box_around(F.col("lat"), F.col("lon"), (0.0, 179.9), 150.0)).count() == 2
    names = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "k int, n string")
    assert sorted(r.name for r in numbered_names(names, "n", [F.asc("k")]).collect()) == ["A (2)", "a", "b"]
    ten = spark.createDataFrame([("g", c) for c in "abcdefghij"], "g string, c string")
    assert sorted(r.c for r in even_members(ten, "g", [F.asc("c")], 3).collect()) == ["a", "e", "j"]
    times = spark.createDataFrame([("k", 1, "2024-01-01 00:00:00"), ("k", 2, "2024-01-01 00:00:02"), ("k", 3, "2024-01-01 00:00:05")], "k string, i int, t string")
    stamped = times.withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert sorted((r.i, r.i_r) for r in within_tolerance(stamped, stamped, "k", "t", 2).where("i < i_r").collect()) == [(1, 2)]


@pytest.mark.parametrize("leftward, wanted", [(False, [1, 2, 3, 4, 5]), (True, [2, 3, 1, 5, 4])])
def test_reading_order(spark, leftward, wanted):
    """A tall panel with two stacked ones beside it is a row; the tier below is another."""
    panels = [(9, 1, 0.2, 0.3, 0.6), (9, 2, 0.7, 0.15, 0.28), (9, 3, 0.7, 0.45, 0.28), (9, 4, 0.3, 0.8, 0.3), (9, 5, 0.8, 0.81, 0.3), (8, 1, 0.5, 0.5, 0.1), (8, 2, None, 0.5, 0.1)]
    found = reading_order(spark.createDataFrame(panels, "page long, key long, cx double, cy double, h double"), "page", "key", leftward=leftward)
    rows = sorted((r.page, r.place, r.key) for r in found.collect())
    assert [k for p, _, k in rows if p == 9] == wanted and [k for p, _, k in rows if p == 8] == [1]


def test_lines_of_an_image_are_blocks_across_batches():
    import numpy as np
    import pandas as pd

    from quaymark.operators import boxes

    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"image": np.sort(rng.integers(0, 12, 90)), "key": np.arange(90), **{c: rng.random(90).round(1) for c in ("cx", "cy")}, "w": rng.random(90) / 2, "h": 0.2 + rng.random(90) / 4})
    rows["top"] = rows["cy"]
    wanted = {}
    for image, lines in rows.groupby("image"):
        of = {k: k for k in lines.key}
        near = [(x.key, y.key) for x in lines.itertuples() for y in lines.itertuples() if abs(x.cy - y.cy) - (x.h + y.h) / 2 < max(x.h, y.h) * 0.1 - 0.3 and min(x.cx + x.w / 2, y.cx + y.w / 2) - max(x.cx - x.w / 2, y.cx - y.w / 2) > 0.2]
        for _ in range(90):
            for a, b in near:
                of[a] = of[b] = min(of[a], of[b])
        heads = sorted(set(of.values()), key=lambda c: (min(lines.top[k] for k in of if of[k] == c), min(lines.cx[k] for k in of if of[k] == c), c))
        wanted |= {k: heads.index(c) + 1 for k, c in of.items()}
    assert len(set(wanted.values())) > 2 and len({(rows.image[k], b) for k, b in wanted.items()}) < 90
    for size in (1, 7, 90):
        found = pd.concat(boxes._blocks_by_image(rows.iloc[at : at + size] for at in range(0, 90, size)))
        assert dict(zip(found.key, found.block)) == wanted
