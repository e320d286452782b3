"""Boxes in normalised centre form (``cx, cy, w, h``): overlaps, matches, tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("cx", "cy", "w", "h")


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union; zero where the boxes have no area together."""
    side = lambda c1, s1, c2, s2: F.greatest(F.least(c1 + s1 / 2, c2 + s2 / 2) - F.greatest(c1 - s1 / 2, c2 - s2 / 2), F.lit(0.0))
    shared = side(a[0], a[2], b[0], b[2]) * side(a[1], a[3], b[1], b[3])
    return F.coalesce(F.try_divide(shared, a[2] * a[3] + b[2] * b[3] - shared), F.lit(0.0))


def best_matches(left: DataFrame, right: DataFrame, image: str, key: str, least: float) -> DataFrame:
    """For each box of ``left`` the box of ``right`` on the same image that overlaps it most, if by ``least``."""
    a = left.select(image, F.col(key).alias("a"), *[F.col(c).alias(f"a_{c}") for c in BOX])
    b = right.select(image, F.col(key).alias("b"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    scored = a.join(b, image).withColumn("overlap", iou([F.col(f"a_{c}") for c in BOX], [F.col(f"b_{c}") for c in BOX])).where(F.col("overlap") >= least)
    best = Window.partitionBy("a").orderBy(F.desc("overlap"), "b")
    return scored.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select("a", "b", "overlap")


def _iou(a: tuple, b: tuple) -> float:
    w = max(0.0, min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2))
    h = max(0.0, min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2))
    total = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / total if total > 0 else 0.0


def distinct_boxes(boxes: DataFrame, image: str, key: str, most: float) -> DataFrame:
    """``(image, key)`` of boxes kept, the largest first, each overlapping no kept one by more than ``most``.

    What is kept hangs on what was kept before: an image's boxes are read in order, and its kept ones held.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = object(), []
        for frame in frames:
            out = []
            for name, k, *box in frame[[image, key, *BOX]].itertuples(index=False):
                if name != now:
                    now, kept = name, []
                if all(_iou(tuple(box), other) <= most for other in kept):
                    kept.append(tuple(box))
                    out.append((name, k))
            yield pd.DataFrame(out, columns=[image, key])

    schema = f"{image} {boxes.schema[image].dataType.simpleString()}, {key} {boxes.schema[key].dataType.simpleString()}"
    sized = boxes.select(image, key, *BOX, (F.col("w") * F.col("h")).alias("_area"))
    return sized.repartition(image).sortWithinPartitions(image, F.desc("_area"), key).mapInPandas(fold, schema)


def tracks(boxes: DataFrame, video: str, frame: str, kind: str, key: str, least: float = 0.3) -> DataFrame:
    """``(video, key, track)``: each box goes to the open track of its kind that it overlaps most, else starts one.

    A track is open while the last frame held it; a video's boxes are read in order and its open tracks held.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at, count, open_, fresh = object(), None, 0, [], []
        for part in frames:
            out = []
            for name, k, f, what, *box in part[[video, key, frame, kind, *BOX]].itertuples(index=False):
                if name != now:
                    now, at, count, open_, fresh = name, f, 0, [], []
                elif f != at:
                    open_, fresh, at = fresh, [], f
                scores = [(_iou(tuple(box), b), -t) for t, w, b in open_ if w == what]
                overlap, track = max(scores, default=(0.0, 0))
                if overlap > least:
                    track = -track
                    open_ = [o for o in open_ if o[0] != track]
                else:
                    count += 1
                    track = count
                fresh.append((track, what, tuple(box)))
                out.append((name, k, track))
            yield pd.DataFrame(out, columns=[video, key, "track"])

    schema = f"{video} {boxes.schema[video].dataType.simpleString()}, {key} {boxes.schema[key].dataType.simpleString()}, track int"
    return boxes.repartition(video).sortWithinPartitions(video, frame, key).mapInPandas(fold, schema)


def rollup_scores(matches: DataFrame, by: str) -> DataFrame:
    """Precision, recall and their harmonic mean from counts ``hits``, ``wrong`` and ``missed``."""
    sums = matches.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("hits", "wrong", "missed")])
    precision = F.coalesce(F.try_divide("hits", F.col("hits") + F.col("wrong")), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", F.col("hits") + F.col("missed")), F.lit(0.0))
    return sums.select(by, "hits", "wrong", "missed", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def reading_order(boxes: DataFrame, page: str, key: str, share: float = 0.4, leftward: bool = False) -> DataFrame:
    """``(page, key, place)``: panels by rows from the top, and by their middles within a row.

    A panel is of the row of the uppermost one left if they share more than ``share`` of the lower height; the row then reaches
    as far as both do. Equal places follow the key. A page is small: its panels are one array.
    """
    kind = boxes.schema[key].dataType.simpleString()

    @F.pandas_udf(f"array<{kind}>")
    def order(pages: pd.Series) -> pd.Series:
        return pages.map(lambda panels: _read(panels, share, leftward))

    panel = F.struct((F.col("cy") - F.col("h") / 2).alias("top"), "cx", F.col(key).alias("key"), (F.col("cy") + F.col("h") / 2).alias("low"))
    known = boxes.select(page, key, "cx", "cy", "h").na.drop()
    return known.groupBy(page).agg(F.sort_array(F.collect_list(panel)).alias("p")).select(page, F.posexplode(order("p")).alias("place", key))


def _read(panels, share: float, leftward: bool) -> list:
    left = [(p["top"], p["cx"], p["key"], p["low"]) for p in panels]
    out: list = []
    while left:
        (top, _, _, low), row, rest = left[0], left[:1], []
        for panel in left[1:]:
            if min(panel[3], low) - max(panel[0], top) > share * min(panel[3] - panel[0], low - top):
                row.append(panel)
                top, low = min(top, panel[0]), max(low, panel[3])
            else:
                rest.append(panel)
        out += [p[2] for p in sorted(row, key=lambda p: (-p[1] if leftward else p[1], p[0], p[2]))]
        left = rest
    return out


def line_blocks(boxes: DataFrame) -> DataFrame:
    """``(image, key, block)``: lines below each other are a block, however many lie between; an image's blocks are numbered from the top, then from the left.

    Links are only within an image, whose lines lie side by side in one task: a line is held against those after it, all images of a batch
    at once. A task holds a batch and the lines of one image. Lines without image or key are left out.
    """
    kinds = {c: boxes.schema[c].dataType.simpleString() for c in ("image", "key")}
    lines = boxes.where("image IS NOT NULL AND key IS NOT NULL").select("image", "key", *BOX, F.round("cy", 2).alias("top"))
    schema = f"image {kinds['image']}, key {kinds['key']}, block int"
    return lines.repartition("image").sortWithinPartitions("image", "key").mapInPandas(_blocks_by_image, schema)


def _blocks_by_image(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if len(frame):
            image = frame["image"].to_numpy()
            # the last image may go on
            last = int(np.argmax(image == image[-1]))
            yield _numbered_blocks(frame.iloc[:last])
            rest = frame.iloc[last:]
    if rest is not None:
        yield _numbered_blocks(rest)


def _numbered_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    if rows.empty:
        return pd.DataFrame({"image": [], "key": [], "block": []})
    image, key = rows["image"].to_numpy(), rows["key"].to_numpy()
    cx, cy, w, h, top = (rows[c].to_numpy(dtype=float) for c in (*BOX, "top"))
    at, links, ahead = np.arange(len(rows)), [], 1
    i = at[:-1]
    while len(i := i[i + ahead < len(at)]) and len(i := i[image[i] == image[i + ahead]]):
        j = i + ahead
        gap = np.abs(cy[i] - cy[j]) - (h[i] + h[j]) / 2
        shared = np.minimum(cx[i] + w[i] / 2, cx[j] + w[j] / 2) - np.maximum(cx[i] - w[i] / 2, cx[j] - w[j] / 2)
        near = (gap < np.maximum(h[i], h[j]) * 0.1 - 0.3) & (shared > 0.2) | (key[i] == key[j])
        links.append(np.stack([i[near], j[near]]))
        ahead += 1
    a, b = np.concatenate(links, axis=1) if links else np.empty((2, 0), int)
    # the first line of each block, by least marks that spread along links
    first, before = at.copy(), None
    while before is None or (first != before).any():
        before = first.copy()
        least = np.minimum(first[a], first[b])
        for ends in (a, b, before[a], before[b]):
            np.minimum.at(first, ends, least)
        first = first[first]
    heads, block = np.unique(first, return_inverse=True)
    tops, lefts = np.full(len(heads), np.nan), np.full(len(heads), np.nan)
    np.fmin.at(tops, block, top)
    np.fmin.at(lefts, block, cx)
    of = np.unique(image, return_inverse=True)[1][heads]
    order = np.lexsort((heads, lefts, tops, of))
    starts = np.searchsorted(of[order], of[order])
    number = np.empty(len(heads), np.int32)
    number[order] = np.arange(len(heads)) - starts + 1
    return pd.DataFrame({"image": image, "key": key, "block": number[block]})


# Two boxes of a class are one object at this overlap, or if this share of the smaller one lies in the other.
SAME_OVERLAP, SAME_CONTAINED = 0.5, 0.85


def _same_object(a: tuple, b: tuple) -> bool:
    """``a`` and ``b`` are (key, kind, cx, cy, w, h)."""
    if a[1] != b[1]:
        return False
    overlap = _iou(a[2:], b[2:])
    if overlap >= SAME_OVERLAP or overlap <= 0:
        return overlap > 0
    areas = a[4] * a[5], b[4] * b[5]
    return overlap * sum(areas) / (1 + overlap) / min(areas) >= SAME_CONTAINED


def _image_verdicts(truth: list[tuple], guesses: list[tuple], good: float, least: float, tolerance: float) -> list[tuple]:
    """``(verdict, kind, overlap, truth key, guess key, confused with)`` of the boxes of one image."""
    out, kept = [], []
    for box in truth:
        if any(_same_object(k, box) for k in kept):
            out.append(("dup_gt", box[1], 0.0, box[0], None, None))
        else:
            kept.append(box)
    free = dict(enumerate(guesses))
    taken = []
    for box in kept:
        scored = [(_iou(box[2:], g[2:]), -j) for j, g in free.items() if g[1] == box[1]]
        best, j = max(scored, default=(0.0, 0))
        if best <= 0 or best < least:
            out.append(("dropped", box[1], 0.0, box[0], None, None))
            continue
        guess = free.pop(-j)
        taken.append((-j, guess))
        size = guess[4] * guess[5] / (box[4] * box[5])
        verdict = "correct" if best >= good else "tightened" if size < 1 - tolerance else "loosened" if size > 1 + tolerance else "shifted"
        out.append((verdict, box[1], best, box[0], guess[0], None))
    matched = [g for _, g in sorted(taken)]
    for guess in free.values():
        if any(_same_object(m, guess) for m in matched):
            out.append(("dup_pred", guess[1], 0.0, None, guess[0], None))
            continue
        matched.append(guess)
        overlap, _, other = max(((_iou(b[2:], guess[2:]), -n, b) for n, b in enumerate(kept) if b[1] != guess[1]), default=(0.0, 0, None))
        confused = other is not None and overlap > 0 and overlap >= least
        out.append(("added", guess[1], overlap if confused else 0.0, None, guess[0], other[1] if confused else None))
    return out


def box_diff(truth: DataFrame, guesses: DataFrame, good: float = 0.7, least: float = 0.3, tolerance: float = 0.15) -> DataFrame:
    """``image, verdict, kind, overlap, gt, pred, confused_with`` of the boxes (image, key, kind, cx, cy, w, h) of images.

    True boxes that are one object with an earlier one are ``dup_gt``. The others take turns by key, each the free guess of its kind that overlaps it most: ``correct`` from
    ``good`` on, else from ``least`` on ``tightened``, ``loosened`` or ``shifted`` by its area; without one it is ``dropped``. A guess left is ``dup_pred`` if it is one
    object with a guess before it, else ``added``, and confused with a kind whose box it overlaps. An image's boxes are few and come to one task; boxes with a null side are left out.
    """
    sides = ("gt", "pred")
    rows = [d.select("image", "key", F.trim(F.coalesce("kind", F.lit(""))).alias("kind"), *[F.col(c).cast("double").alias(c) for c in BOX], F.lit(side).alias("side")) for side, d in zip(sides, (truth, guesses))]
    kinds = {c: truth.schema[c].dataType.simpleString() for c in ("image", "key")}

    names = ["image", "verdict", "kind", "overlap", "gt", "pred", "confused_with"]

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, boxes = None, {side: [] for side in sides}
        for frame in frames:
            out = []
            for image, side, *box in frame[["image", "side", "key", "kind", *BOX]].itertuples(index=False, name=None):
                if image != now:
                    out += [(now, *v) for v in _image_verdicts(*boxes.values(), good, least, tolerance)]
                    now, boxes = image, {side: [] for side in sides}
                boxes[side].append(tuple(box))
            yield pd.DataFrame(out, columns=names, dtype=object)
        yield pd.DataFrame([(now, *v) for v in _image_verdicts(*boxes.values(), good, least, tolerance)], columns=names, dtype=object)

    schema = f"image {kinds['image']}, verdict string, kind string, overlap double, gt {kinds['key']}, pred {kinds['key']}, confused_with string"
    both = rows[0].unionByName(rows[1]).na.drop(subset=[*BOX, "image", "key"])
    return both.repartition("image").sortWithinPartitions("image", "side", "key").mapInPandas(judge, schema)
