"""Neighbours among unit vectors: all of them, or most of them from tables of random hyperplanes.

Both deal vectors out to cells such that near ones meet in one. A cell is cut into blocks of ``BLOCK`` rows, or into ``SPREAD``
blocks if these are larger, and tasks multiply a block of residents with one of guests, so that a hot cell is spread over many tasks and no
vector is sent out more than some ``SPREAD`` times. Cells or tables are only used where they cost less than the products of all
blocks. Where links are only wanted for components, a task gives no more of them than it has rows: a
spanning forest of what is near in its products. Equal vectors are one row from the start.

Nulls and vectors without length are left out by ``unit_rows``. An empty table gives no links.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.operators.graph import connected_components
from quaymark.operators.ranges import numbered
from quaymark.operators.similarity import dot, literal, norm
from quaymark.sources.shared import stored

#: Rows of vectors that are multiplied with as many at once.
BLOCK = 4096
#: Blocks that a cell is cut into at most.
SPREAD = 32
#: Comparisons that cost as much as sending a vector to a task.
SENT = 256


def unit_rows(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, v)`` of unit length; vectors without length are left out."""
    return vectors.withColumn("_n", norm(F.col(column))).where("_n > 0").select(F.col(key).alias("key"), F.transform(F.col(column).cast("array<double>"), lambda x: x / F.col("_n")).alias("v"))


def _blocks(rows: DataFrame) -> DataFrame:
    """``(cell, blocks)``: into how many blocks the rows of each cell are cut."""
    return stored(rows.groupBy("cell").agg(F.least(F.lit(SPREAD), F.ceil(F.count("*") / BLOCK)).cast("int").alias("blocks")), "near-blocks")


def _multiplied(left: DataFrame, right: DataFrame, eps: float, forest: bool) -> DataFrame:
    """``(a, b)``, ``a < b``: near ones between the block ``left`` (cell, x, y, key, v) and the block ``right`` (with _b), or a forest of them."""

    def multiply(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found = [np.empty((0, 2), np.int64)]
        if len(rows) and len(others):
            a, b, v, w = rows["key"].to_numpy(), others["key_b"].to_numpy(), np.stack(rows["v"]), np.stack(others["v_b"])
            for at in range(0, len(a), BLOCK):
                for to in range(0, len(b), BLOCK):
                    away = v[at : at + BLOCK] @ w[to : to + BLOCK].T
                    near = np.subtract(1, away, out=away) <= eps
                    i, j = spanning_forest(near) if forest else np.nonzero(near)
                    ends = np.stack([a[at + i], b[to + j]], axis=1)
                    # a pair that both sides hold comes from the one whose resident is smaller; a forest may have it from either
                    found.append(np.sort(ends[ends[:, 0] != ends[:, 1]], axis=1) if forest else ends[ends[:, 0] < ends[:, 1]])
        links = np.concatenate(found)
        links = links[joining(links)] if forest else links
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    return left.groupBy("cell", "x", "y").cogroup(right.groupBy("cell_b", "x_b", "y_b")).applyInPandas(multiply, "a long, b long")


def _products(residents: DataFrame, guests: DataFrame, eps: float, forest: bool) -> DataFrame:
    """``(a, b)``, ``a < b``: near ones among the residents and guests (cell, key, v) of each cell, or a forest of them."""
    blocks = _blocks(guests)
    own, every = F.pmod(F.xxhash64("key"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = residents.join(blocks, "cell").select("key", "v", "cell", own.alias("x"), every.alias("y"))
    right = guests.join(blocks, "cell").select(F.col("key").alias("key_b"), F.col("v").alias("v_b"), F.col("cell").alias("cell_b"), every.alias("x_b"), own.alias("y_b"))
    return _multiplied(left, right, eps, forest)


def links_within(units: DataFrame, eps: float) -> DataFrame:
    """``(a, b)``: links that connect what is near within each cell of ``units`` (cell, key, v); each two blocks are multiplied once."""
    placed = units.join(_blocks(units), "cell").withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    left = placed.select("key", "v", "cell", F.col("own").alias("x"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("y"))
    right = placed.select(F.col("key").alias("key_b"), F.col("v").alias("v_b"), F.col("cell").alias("cell_b"), F.explode(F.sequence(F.lit(0), "own")).alias("x_b"), F.col("own").alias("y_b"))
    return _multiplied(left, right, eps, True)


def whole_cost(n: int) -> float:
    """What the products of all blocks cost for each of ``n`` vectors, in comparisons."""
    return SENT * (min(SPREAD, math.ceil(n / BLOCK)) + 1) + n / 2


def spanning_forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a matrix of links, so few that they make no circle, that connect what all links connect."""
    i, j = np.nonzero(near)
    if len(i) < sum(near.shape):
        return i, j
    row_left, column_left = near.any(axis=1), near.any(axis=0)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while row_left.any():
        rows = np.array([np.argmax(row_left)])
        row_left[rows] = False
        while len(rows):
            columns = np.flatnonzero(column_left & near[rows].any(axis=0))
            column_left[columns] = False
            out.append((rows[near[np.ix_(rows, columns)].argmax(axis=0)], columns))
            reached = np.flatnonzero(row_left & near[:, columns].any(axis=1)) if len(columns) else columns
            row_left[reached] = False
            if len(reached):
                out.append((reached, columns[near[np.ix_(reached, columns)].argmax(axis=1)]))
            rows = reached
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def joining(links: np.ndarray) -> np.ndarray:
    """Whether each link (a, b) in turn connects what the links before it do not."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    kept = np.zeros(len(links), bool)
    for n, (a, b) in enumerate(links.tolist()):
        if (x := top(a)) != (y := top(b)):
            kept[n], up[x] = True, y
    return kept


def _by_pivots(units: DataFrame, eps: float, pivots: int) -> tuple[DataFrame, DataFrame] | None:
    """Residents and guests of the cells of a few pivots.

    A vector lives with its nearest pivot and is a guest of every pivot that may have a near one of it: none is farther from a pivot than its
    cell's radius, so a guest is at most that and the limit away, and at most twice the limit farther than its own pivot.
    """
    chosen = [list(r[0]) for r in units.orderBy(F.md5(F.col("key").cast("string")), "key").limit(pivots).select("v").collect()]
    if not chosen:
        return None
    limit = math.sqrt(2 * eps)
    away = F.array(*[F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(F.col("v"), literal(p)))) for p in chosen])
    placed = stored(units.withColumn("away", away), "near-cells")
    home = placed.select("key", "v", (F.array_position("away", F.array_min("away")) - 1).cast("int").alias("cell"), F.array_min("away").alias("least"))
    radii = home.groupBy("cell").agg(F.max("least").alias("radius"))  # a row for each pivot
    guests = placed.select("key", "v", F.array_min("away").alias("least"), F.posexplode("away").alias("cell", "d")).join(F.broadcast(radii), "cell")
    reach = F.least(F.col("least") + 2 * limit, F.col("radius") + limit)
    return home.select("cell", "key", "v"), guests.where(F.col("d") <= reach + 1e-9).select("cell", "key", "v")


def near_pairs(units: DataFrame, eps: float, pivots: int = 16) -> DataFrame:
    """``(a, b)``, ``a < b``: all unit vectors within a cosine distance of ``eps``."""
    cells = _by_pivots(units, eps, pivots)
    return _products(*cells, eps, False) if cells else units.select(F.col("key").alias("a"), F.col("key").alias("b"))


def _distinct(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each vector, and the links of its other rows to that one."""
    firsts = stored(units.groupBy("v").agg(F.min("key").alias("key")), "near-distinct")
    copies = units.join(firsts.withColumnRenamed("key", "first"), "v").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    return firsts.select("key", "v"), copies


def near_links(units: DataFrame, eps: float, pivots: int = 16) -> DataFrame:
    """``(a, b)``: links that connect exactly what vectors within ``eps`` connect, no more than a few for each row and cell."""
    firsts, copies = _distinct(units)
    return _links(firsts, eps, pivots).union(copies)


def _links(firsts: DataFrame, eps: float, pivots: int = 16) -> DataFrame:
    """The links of distinct vectors: from the cells of pivots, or from all blocks if these cost less."""
    n = firsts.count()
    cells = _by_pivots(firsts, eps, pivots) if n > BLOCK else None
    if cells:
        # a row for each pivot
        counts = {side: dict(rows.groupBy("cell").count().collect()) for side, rows in zip(("homes", "guests"), cells)}
        blocks = {c: min(SPREAD, math.ceil(g / BLOCK)) for c, g in counts["guests"].items()}
        cost = sum(SENT * (h + counts["guests"][c]) * blocks[c] + h * counts["guests"][c] for c, h in counts["homes"].items())
        if cost < whole_cost(n) * n:
            return _products(*cells, eps, True)
    return links_within(firsts.select(F.lit(0).alias("cell"), "key", "v"), eps)


def table_sizes(n: int, eps: float, recall: float, bucket: int) -> tuple[int, int]:
    """Hyperplanes of a table, and tables, for ``n`` vectors; see ``hyperplane_cells``."""
    agree = 1 - math.acos(max(-1.0, min(1.0, 1 - eps))) / math.pi
    bits = max(1, math.ceil(math.log2(max(n / bucket, 2))))
    # vectors that agree on all planes are in one cell of any table
    return bits, 1 if agree >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-(agree**bits))))


def hyperplane_cells(units: DataFrame, eps: float, recall: float, bucket: int, probes: int, seed: int) -> DataFrame:
    """``key, v, home, guest``: the cells of each vector in every table, and those where it is a guest too.

    A cell is the side of ``bits`` random hyperplanes on which a vector lies, so many that a table has some ``bucket`` vectors
    in a cell. Vectors at an angle t agree on a plane with 1 - t / pi; there are so many tables that a pair
    at the limit shares a cell of one of them with a probability of ``recall``. A guest also stands in the ``probes`` cells across
    its nearest planes, which finds more.
    """
    first = units.select("v").first()
    width = len(first[0]) if first else 1
    bits, tables = table_sizes(units.count(), eps, recall, bucket)
    planes = np.random.default_rng(seed).normal(size=(width, tables * bits))

    @F.pandas_udf("struct<home: array<long>, guest: array<long>>")
    def cells(vectors: pd.Series) -> pd.DataFrame:
        sides = (np.stack(vectors.to_numpy()) @ planes).reshape(len(vectors), tables, bits)
        own = ((sides > 0) << np.arange(bits)).sum(axis=2) + (np.arange(tables, dtype=np.int64) << 40)
        nearest = np.argsort(np.abs(sides), axis=2)[:, :, : min(probes, bits)]
        across = own[:, :, None] ^ (np.int64(1) << nearest)
        guest = np.concatenate([own, across.reshape(len(vectors), -1)], axis=1)
        return pd.DataFrame({"home": list(own), "guest": list(guest)})

    return units.withColumn("cells", cells("v")).select("key", "v", "cells.home", "cells.guest")


def approximate_links(units: DataFrame, eps: float, recall: float = 0.95, bucket: int = 64, probes: int = 2, seed: int = 0) -> DataFrame:
    """``(a, b)``: links between most vectors within ``eps``, a forest of each product of blocks.

    A wide limit needs so many tables that sending the vectors to all their cells costs more than multiplying all blocks, which misses nothing; then these are taken.
    """
    firsts, copies = _distinct(units)
    n = firsts.count()
    _, tables = table_sizes(n, eps, recall, bucket)
    if tables * (SENT * (2 + probes) + bucket * (1 + probes)) >= whole_cost(n):
        return _links(firsts, eps).union(copies)
    placed = stored(hyperplane_cells(firsts, eps, recall, bucket, probes, seed), "near-tables")
    homes, guests = placed.select(F.explode("home").alias("cell"), "key", "v"), placed.select(F.explode("guest").alias("cell"), "key", "v")
    return _products(homes, guests, eps, True).union(copies)


def clusters_of(units: DataFrame, links: DataFrame, least: int) -> DataFrame:
    """``(key, cluster)``: components of links, numbered by falling size and first member; small ones are -1."""
    found = connected_components(stored(links, "near-links"), "a", "b")
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ranks = numbered(sizes.withColumn("less", -F.col("n")), [], ["less", "component"]).select("component", F.col("position").alias("cluster"))
    of = found.join(ranks, "component").select(F.col("node").alias("key"), "cluster")
    return units.select("key").join(of, "key", "left").select("key", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def threshold_clusters(units: DataFrame, eps: float, least: int) -> DataFrame:
    """Clusters of vectors within ``eps`` of each other, directly or by others, exactly."""
    return clusters_of(units, near_links(units, eps), least)


def approximate_clusters(units: DataFrame, eps: float, least: int, recall: float = 0.95) -> DataFrame:
    """The same from tables of hyperplanes, for tables too large for the products of cells."""
    return clusters_of(units, approximate_links(units, eps, recall), least)
