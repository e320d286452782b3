"""Vectors, Hamming joins and groups of duplicates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions.fingerprints import word_votes
from quaymark.operators.graph import connected_components

#: Pairs of hashes that a task compares at a time.
AT_ONCE = 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def literal(vector: list[float]) -> Column:
    """A query vector as a constant."""
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(vectors: DataFrame, vector: list[float], k: int, key: str, column: str) -> DataFrame:
    """The ``k`` rows nearest to a query vector of the same width."""
    scored = vectors.where(F.size(column) == len(vector)).withColumn("score", cosine(F.col(column), literal(vector)))
    return scored.orderBy(F.col("score").desc_nulls_last(), key).limit(k)


def about_keys(vectors: DataFrame, key: str, column: str, wanted: list[float], turned: list[list[float]], threshold: float = 0.0, least: float = 0.05, ratio: float = 0.75) -> DataFrame:
    """Keys of vectors that are near enough to a wanted one and away from others.

    A positive ``threshold`` is the cut. Else it follows from the scores of the query: at least one standard deviation above their mean,
    ``ratio`` of the best and ``least``, but never above the best. Vectors of another width are not asked.
    """
    same = vectors.where(F.size(column) == len(wanted))
    score = cosine(F.col(column), literal(wanted))
    for vector in turned:
        score = score - 0.7 * cosine(F.col(column), literal(vector))
    scored = same.select(key, score.alias("score")).where("score IS NOT NULL")
    if threshold > 0:
        return scored.where(F.col("score") >= threshold).select(key)
    best = F.max("score")
    cut = F.least(F.greatest(F.lit(least), F.avg("score") + F.stddev_pop("score"), F.when(best > 0, best * ratio).otherwise(F.lit(least))), best)
    return scored.join(F.broadcast(scored.agg(cut.alias("cut")))).where("score >= cut").select(key)  # one row


def sign_bits(vector: Column, width: int = 64) -> Column:
    """The signs of the first ``width`` numbers as a long."""
    bit = lambda i: F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0))
    out = bit(0)
    for i in range(1, width):
        out = out.bitwiseOR(bit(i))
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def text_bits(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, h)``: a fingerprint of 64 bits for each key; a bit is set where most of its distinct words have it.

    Texts without words are zero. The votes of a text are added up where it is read: 64 counts go on, whatever its length. Rows of one key vote together.
    """
    voted = rows.select(key, word_votes(F.col(text)).alias("v"))
    lanes = [F.sum(F.get("v.votes", F.lit(i))).alias(f"s{i}") for i in range(32)]
    votes = voted.groupBy(key).agg(F.sum("v.n").alias("n"), *lanes)
    h = F.lit(0).cast("long")
    for i in range(64):
        seen = F.shiftright(f"s{i % 32}", 32) if i >= 32 else F.col(f"s{i}").bitwiseAND(F.lit((1 << 32) - 1))
        h = h.bitwiseOR(F.when(2 * seen > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)))
    return votes.select(key, h.alias("h"))


def hamming_pairs(hashes: DataFrame, key: str, column: str, limit: int) -> DataFrame:
    """All pairs ``(a, b, distance)``, ``a < b``, within ``limit`` bits of 64. Null keys and hashes are left out.

    Of one chunk more than half the limit, one differs in a bit at most; so one half of that chunk is equal, and the other one is with one of its bits turned, if any.
    Hashes are dealt out by the half that has to be equal, two rows for each chunk: with a limit of five, six rows of ten or eleven bits. There they lie sorted, and each looks
    up the other half with each bit turned, one after the other, so that turned hashes are not shuffled. A task holds the hashes of one such bucket and so many pairs at a time. A pair meets
    on one half of a chunk only, and the first of the chunks that it meets on gives it, so pairs need no shuffle to be unique. Rows with equal hashes pair with each other: make hashes unique
    first, as ``hash_classes`` does.
    """
    n = limit // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    spans = list(zip(cuts, cuts[1:]))
    ways = [way for i, (low, high) in enumerate(spans) for mid in [(low + high) // 2] for way in (((low, mid), (mid, high), i, True), ((mid, high), (low, mid), i, False))]
    part = lambda h, low, high: F.shiftrightunsigned(F.shiftleft(h, 64 - high), 64 - high + low)
    buckets = F.array(*[F.shiftleft(F.lit(w).cast("long"), 32).bitwiseOR(part(F.col(column), *equal)) for w, (equal, *_) in enumerate(ways)])
    known = hashes.where(F.col(key).isNotNull() & F.col(column).isNotNull())
    dealt = known.select(F.col(key).alias("key"), F.col(column).alias("h"), F.explode(buckets).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket")
    kind = hashes.schema[key].dataType.simpleString()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches):
            h, bucket = (rows.column(c).to_numpy() for c in ("h", "bucket"))
            for w, start in zip(*np.unique(bucket >> 32, return_index=True)):
                own = slice(start, np.searchsorted(bucket, w + 1 << 32))
                _, (low, high), chunk, same = ways[w]
                turns = [0] * same + [1 << x for x in range(high - low)]
                for i, j, distance in _near(h[own].view(np.uint64), bucket[own], low, high, turns, spans[:chunk], limit):
                    ends = [rows.column("key").take(pa.array(start + x)).combine_chunks() for x in (i, j)]
                    yield pa.RecordBatch.from_arrays([*ends, pa.array(distance, pa.int32())], ["x", "y", "distance"])

    near = dealt.mapInArrow(met, f"x {kind}, y {kind}, distance int")
    return near.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by bucket, cut where a bucket ends."""
    held: list[pa.RecordBatch] = []
    for batch in filter(len, batches):
        held.append(batch)
        if held[0].column("bucket")[0] != batch.column("bucket")[-1]:
            rows = pa.Table.from_batches(held)
            bucket = rows.column("bucket").to_numpy()
            last = int(np.searchsorted(bucket, bucket[-1]))
            yield rows.slice(0, last)
            held = rows.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _near(h: np.ndarray, bucket: np.ndarray, low: int, high: int, turns: list[int], before: list[tuple[int, int]], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``i, j, distance`` of rows of one bucket whose bits from ``low`` to ``high`` are equal when turned, within ``limit`` bits, and by more than a bit apart in the spans before."""
    nth = np.cumsum(np.diff(bucket, prepend=bucket[0]) != 0).astype(np.uint64)
    at = nth << np.uint64(32) | h >> np.uint64(low) & np.uint64((1 << high - low) - 1)
    order = np.argsort(at)
    at, h = at[order], h[order]
    for turn in map(np.uint64, turns):
        behind = np.searchsorted(at, at ^ turn, "right")
        # each two rows once
        first = np.maximum(np.searchsorted(at, at ^ turn), np.arange(1, len(at) + 1))
        met = np.flatnonzero(behind > first)
        ends = np.cumsum(behind[met] - first[met])
        for low_end in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
            place = np.arange(low_end, min(low_end + AT_ONCE, int(ends[-1])))
            row = np.searchsorted(ends, place, "right")
            i, j = met[row], behind[met[row]] - (ends[row] - place)
            differ = h[i] ^ h[j]
            distance = np.bitwise_count(differ)
            found = distance <= limit
            for x, y in before:
                found &= np.bitwise_count(differ & np.uint64((1 << y) - (1 << x))) > 1
            if found.any():
                yield order[i[found]], order[j[found]], distance[found]


def hash_classes(hashes: DataFrame, key: str, column: str) -> DataFrame:
    """``(first, column, n)``: rows of equal hashes are one class, which its smallest key stands for."""
    return hashes.groupBy(column).agg(F.min(key).alias("first"), F.count("*").alias("n"))


def exact_groups(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``(first, n)`` of each text that occurs more than once; the first row stands for the group."""
    return rows.groupBy(F.sha2(column, 256).alias("digest")).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")


def reference_order(pairs: DataFrame, components: DataFrame, score: str) -> DataFrame:
    """Members of each component behind its reference, the one with the largest sum of scores.

    ``pairs(a, b, score)``, ``components(node, component)``; gives ``component, node, total, rank``.
    """
    ends = pairs.select(F.col("a").alias("node"), F.col(score).alias("s")).union(pairs.select("b", score))
    totals = ends.groupBy("node").agg(F.sum("s").alias("total"))
    order = Window.partitionBy("component").orderBy(F.col("total").desc(), "node")
    return components.join(totals, "node").withColumn("rank", F.row_number().over(order))


def linked_components(pairs: DataFrame) -> DataFrame:
    return connected_components(pairs, "a", "b")


def centroids(vectors: DataFrame, label: str, column: str, key: str) -> DataFrame:
    """``(label, n, centroid)``: the mean of unit vectors, itself of unit length."""
    unit = vectors.withColumn("_n", norm(F.col(column))).where("_n > 0")
    parts = unit.select(label, F.posexplode(F.transform(F.col(column).cast("array<double>"), lambda x: x / F.col("_n"))).alias("i", "x"))
    means = parts.groupBy(label, "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    whole = means.groupBy(label).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))
    mean = whole.withColumn("_c", F.col("v.m"))
    return mean.select(label, "n", F.transform("_c", lambda x: x / norm(F.col("_c"))).alias("centroid"))


def wilson(up: Column, down: Column, z: float = 1.96) -> Column:
    """Lower bound of the share of ups; zero without votes."""
    n = (up + down).cast("double")
    p = up / n
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (p + z * z / (2 * n) - spread) / (1 + z * z / n)).otherwise(0.0)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points on a sphere of 6371 km."""
    d = math.pi / 180
    h = F.pow(F.sin((lat2 - lat1) * d / 2), F.lit(2)) + F.cos(lat1 * d) * F.cos(lat2 * d) * F.pow(F.sin((lon2 - lon1) * d / 2), F.lit(2))
    return 2 * 6371 * F.asin(F.sqrt(h))
