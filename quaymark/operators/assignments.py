"""Assigning one side of scored pairs to the other, each at most once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("cx", "cy", "w", "h")


def first_come(turns: Column, left: str, right: str, least: float) -> Column:
    """Matches ``(left, right)`` of an array of turns ``(left, offers)``, of types ``left`` and ``right``: each left in turn takes its best right that is free.

    Offers are ``(less, right)`` in order, ``less`` being the score below zero. A right is taken only at a score of ``least`` or more.
    """
    none = F.array().cast(f"array<struct<left: {left}, right: {right}>>")

    def step(taken: Column, turn: Column) -> Column:
        free = F.filter(turn["offers"], lambda o: ~F.exists(taken, lambda t: t["right"] == o["right"]))
        best = F.get(free, F.lit(0))
        match = F.array(F.struct(turn["left"].alias("left"), best["right"].alias("right")))
        return F.when(-best["less"] >= least, F.concat(taken, match)).otherwise(taken)

    return F.aggregate(turns, none, step)


def _inside(point: Column, box: Sequence[Column]) -> Column:
    cx, cy, w, h = box
    return (F.abs(point["x"] - cx) <= w / 2) & (F.abs(point["y"] - cy) <= h / 2)


def pose_subjects(boxes: DataFrame, poses: DataFrame, unmatched: str = "flag", least: float = 0.4, visible: float = 0.2, pad: float = 0.03) -> DataFrame:
    """Subjects of images from detector boxes (image, box, cx, cy, w, h) and skeletons (image, person, points: x, y, v).

    A box takes the free skeleton with the largest share of its visible points inside. A box without one is kept, flagged or dropped, as
    ``unmatched`` says; a skeleton without a box gets one around its visible points if these are two or more and span something.
    Gives ``image, box, person, needs_review, cx, cy, w, h``; a made box has no ``box``. Boxes with a null side hold no point; null points are not visible.
    An image is small: its boxes and skeletons are gathered once, as two arrays of one row, and all that follows is done within the row.
    """
    seen = poses.select("image", "person", F.filter("points", lambda p: F.coalesce(p["v"] >= visible, F.lit(False))).alias("seen"))
    box, person = F.struct("box", *SIDES).alias("b"), F.struct("person", "seen").alias("p")
    rows = boxes.select("image", box).unionByName(seen.select("image", person), allowMissingColumns=True)
    # those without an image are not gathered
    alone = F.when(F.col("image").isNull(), F.xxhash64("b", "p")).alias("alone")
    images = rows.groupBy("image", alone).agg(F.collect_list("b").alias("boxes"), F.collect_list("p").alias("people"))

    def offer(b: Column, p: Column) -> Column:
        inside = F.size(F.filter(p["seen"], lambda point: _inside(point, [b[c] for c in SIDES])))
        return F.struct((-F.coalesce(F.try_divide(inside, F.size(p["seen"])), F.lit(0.0))).alias("less"), p["person"].alias("right"))

    def turn(key: Column) -> Column:
        own = F.filter("boxes", lambda b: b["box"].eqNullSafe(key))
        offers = F.flatten(F.transform(own, lambda b: F.transform("people", lambda p: offer(b, p))))
        return F.struct(key.alias("left"), F.sort_array(F.filter(offers, lambda o: o["less"] < 0)).alias("offers"))

    turns = F.transform(F.sort_array(F.array_distinct(F.transform("boxes", lambda b: b["box"]))), turn)
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((boxes, "box"), (poses, "person"))]
    matches = first_come(F.when(F.col("image").isNotNull(), turns).otherwise(F.slice(turns, 1, 0)), *kinds, least)
    images = images.withColumn("matches", matches)

    def held(b: Column) -> Column:
        taken = F.get(F.filter("matches", lambda m: m["left"] == b["box"]), F.lit(0))["right"]
        review = taken.isNull() if unmatched == "flag" else F.lit(False)
        return F.struct(b["box"].alias("box"), taken.alias("person"), review.alias("needs_review"), *[b[c].alias(c) for c in SIDES])

    def span(p: Column) -> Column:
        low = lambda axis: F.greatest(F.lit(0.0), F.array_min(F.transform(p["seen"], lambda q: q[axis])) - pad)
        high = lambda axis: F.least(F.lit(1.0), F.array_max(F.transform(p["seen"], lambda q: q[axis])) + pad)
        return F.struct(p["person"].alias("person"), low("x").alias("x1"), high("x").alias("x2"), low("y").alias("y1"), high("y").alias("y2"))

    def made(s: Column) -> Column:
        sides = [(s["x1"] + s["x2"]) / 2, (s["y1"] + s["y2"]) / 2, s["x2"] - s["x1"], s["y2"] - s["y1"]]
        return F.struct(F.lit(None).cast(kinds[0]).alias("box"), s["person"].alias("person"), F.lit(False).alias("needs_review"), *[v.alias(c) for c, v in zip(SIDES, sides)])

    free = F.filter("people", lambda p: (F.size(p["seen"]) >= 2) & ~F.coalesce(F.exists("matches", lambda m: m["right"] == p["person"]), F.lit(False)))
    spans = F.filter(F.transform(free, span), lambda s: (s["x2"] - s["x1"] >= 0.001) & (s["y2"] - s["y1"] >= 0.001))
    kept = F.transform("boxes", held)
    if unmatched == "drop":
        kept = F.filter(kept, lambda b: b["person"].isNotNull())
    return images.select("image", F.inline(F.concat(kept, F.transform(spans, made))))
