"""Alignment of sequences and votes on their offset."""

from __future__ import annotations

import numpy as np
import pandas as pd
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dtw_cost(a: np.ndarray, b: np.ndarray) -> float:
    """Least total absolute difference along a warping path."""
    # cells of one antidiagonal hang on those of the two before it alone; index i stands for row i of the diagonal
    n, m = len(a), len(b)
    older, old = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    older[0] = 0.0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        now = np.full(n + 1, np.inf)
        now[i] = np.abs(a[i - 1] - b[d - i - 1]) + np.minimum(older[i - 1], np.minimum(old[i - 1], old[i]))
        older, old = old, now
    return float(old[n])


def resampled(values: Column, most: int) -> Column:
    """Evenly spaced members of an array, the ends kept, where it has more than ``most``."""
    n = F.size(values)
    nth = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(values, F.floor(i * (n - 1) / (most - 1) + 0.5).cast("int")))
    return F.when(n > most, nth).otherwise(values)


def kept_steps(values: Column, flat: Callable[[Column], Column], near: int) -> Column:
    """An array of numbers without flat ones, and without those within ``near`` of the last one kept."""
    told = F.filter(values, lambda x: ~flat(x))
    fresh = lambda kept, x: (F.size(kept) == 0) | (F.abs(F.element_at(kept, F.greatest(F.size(kept), F.lit(1))) - x) > near)
    return F.aggregate(told, F.array().cast("array<long>"), lambda kept, x: F.when(fresh(kept, x), F.concat(kept, F.array(x))).otherwise(kept))


def dtw_score(pairs: DataFrame, a: str, b: str, out: str = "score") -> DataFrame:
    """``1 - cost / longer`` clipped to 0..1, for the array columns ``a`` and ``b``; empty sequences score zero."""

    @F.pandas_udf("double")
    def score(xs: pd.Series, ys: pd.Series) -> pd.Series:
        def one(x, y) -> float:
            x, y = np.asarray(x if x is not None else [], float), np.asarray(y if y is not None else [], float)
            if not len(x) or not len(y):
                return 0.0
            return float(np.clip(1 - dtw_cost(x, y) / max(len(x), len(y)), 0, 1))

        return pd.Series([one(x, y) for x, y in zip(xs, ys)])

    return pairs.withColumn(out, score(a, b))


def offset_votes(steps: DataFrame, sequence: str, position: str, value: str, most: int, least: int) -> DataFrame:
    """``(a, b, offset, votes)``: how far ``b`` runs behind ``a``, voted by the values they share.

    Values that occur more often than ``most`` say nothing about position and cast no vote; an offset
    needs ``least`` votes; the smallest offset wins ties.
    """
    counted = steps.withColumn("_n", F.count("*").over(Window.partitionBy(value))).where(F.col("_n") <= most).drop("_n")
    left = counted.select(F.col(sequence).alias("a"), F.col(position).alias("pa"), F.col(value).alias("v"))
    right = counted.select(F.col(sequence).alias("b"), F.col(position).alias("pb"), F.col(value).alias("v"))
    votes = left.join(right, "v").where("a < b").groupBy("a", "b", (F.col("pb") - F.col("pa")).alias("offset")).agg(F.count("*").alias("votes"))
    best = Window.partitionBy("a", "b").orderBy(F.col("votes").desc(), "offset")
    return votes.where(F.col("votes") >= least).withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def warping_path(a: np.ndarray, b: np.ndarray, band: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps ``(i, j)`` of the cheapest path from the first members to the last ones, and what each costs.

    A step goes on in both sequences or in one; of equal ways back the one through both is taken, then the one that stays in ``b``. With a
    ``band`` only members that far from the straight line between the corners are compared, so that memory is the longer length times the band.
    """
    n, m = len(a), len(b)
    width = m if band is None else min(m, 2 * max(band, -(-m // max(n, 1))) + 1)
    middle = np.round(np.arange(n) * (m - 1) / max(n - 1, 1)).astype(int)
    low = np.clip(middle - width // 2, 0, m - width)
    total = np.full((n, width), np.inf)
    for i in range(n):
        cost = np.abs(a[i] - b[low[i] : low[i] + width])
        if i == 0:
            total[0] = np.cumsum(cost) if low[0] == 0 else np.inf
            continue
        shift = low[i] - low[i - 1]
        before = np.full(width + 1, np.inf)  # the row above, from the member left of the first one on
        before[1 : width + 1 - shift] = total[i - 1, shift:]
        before[0] = total[i - 1, shift - 1] if shift > 0 else np.inf
        entered, run = cost + np.minimum(before[:-1], before[1:]), np.cumsum(cost)
        total[i] = run + np.minimum.accumulate(entered - run)

    def at(i: int, j: int) -> float:
        return total[i, j - low[i]] if i >= 0 and 0 <= j - low[i] < width else np.inf

    i, j, path = n - 1, m - 1, [(n - 1, m - 1)]
    while i or j:
        ways = [(i - 1, j - 1), (i - 1, j), (i, j - 1)]
        i, j = min((w for w in ways if w[0] >= 0 and w[1] >= 0), key=lambda w: at(*w))
        path.append((i, j))
    rows, columns = np.array(path[::-1]).T
    return rows, columns, np.abs(np.asarray(a)[rows] - np.asarray(b)[columns])


def dtw_paths(pairs: DataFrame, key: str, a: str, b: str, band: int | None = None) -> DataFrame:
    """``key, step, i, j, cost``: the warping path of each pair of arrays, a row for each step. Empty or null ones have none."""
    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k, x, y in zip(rows[key], rows[a], rows[b]):
                if x is not None and y is not None and len(x) and len(y):
                    i, j, cost = warping_path(np.asarray(x, float), np.asarray(y, float), band)
                    yield pd.DataFrame({key: k, "step": range(len(i)), "i": i, "j": j, "cost": cost})

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, a, b).mapInPandas(trace, f"{key} {kind}, step long, i long, j long, cost double")
