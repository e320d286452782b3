"""Positions and running sums in order, with no group in one task.

Rows are dealt out by ranges of the whole order, so that a large group is cut into many tasks. Each task
numbers or adds up its own rows; the counts and sums of the parts before it, one row for each part of a group,
are carried over. Ties must be told apart by the order given, else their order is that of the tasks.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.sources.shared import stored

#: Bits that ``monotonically_increasing_id`` leaves for the rows of a partition.
_ROW_BITS = 33


def laid_out(df: DataFrame, groups: Sequence[str], orders: Sequence[Column | str], name: str = "laid-out") -> DataFrame:
    """``df`` dealt out by ranges of ``groups`` and ``orders`` and sorted, with ``_at``: ascending, its upper bits the part."""
    sort = [*map(F.col, groups), *(F.col(o) if isinstance(o, str) else o for o in orders)]
    sorted_parts = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    return stored(sorted_parts.withColumn("_at", F.monotonically_increasing_id()), name)


def _same(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> Column:
    """Equal groups (nulls too) and parts; the right side's columns start with ``_g_``."""
    part = F.shiftright(left["_at"], _ROW_BITS) == right["_part"]
    return functools.reduce(operator.and_, [left[g].eqNullSafe(right[f"_g_{g}"]) for g in groups], part)


def numbered(df: DataFrame, groups: Sequence[str], orders: Sequence[Column | str]) -> DataFrame:
    """``df`` with ``position`` (from 0) in its group by ``orders``, and ``group_size``. Nulls are a group of their own."""
    laid = laid_out(df, groups, orders, "numbered")
    runs = laid.groupBy(*[F.col(g).alias(f"_g_{g}") for g in groups], F.shiftright("_at", _ROW_BITS).alias("_part")).agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first")
    )
    whole = Window.partitionBy(*[f"_g_{g}" for g in groups])
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(
        *[f"_g_{g}" for g in groups],
        "_part",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("group_size"),
    )
    found = laid.join(shifts, _same(laid, shifts, groups))
    return found.select(*[laid[c] for c in df.columns], (F.col("_at") + F.col("_shift")).alias("position"), "group_size")


def summed_before(df: DataFrame, groups: Sequence[str], orders: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (null: 0) over the rows of its group that come before it."""
    laid = laid_out(df, groups, orders, "summed")
    own, part = F.coalesce(F.col(value), F.lit(0)), F.shiftright("_at", _ROW_BITS)
    totals = laid.groupBy(*[F.col(g).alias(f"_g_{g}") for g in groups], part.alias("_part")).agg(F.sum(own).alias("_total"))
    before = Window.partitionBy(*[f"_g_{g}" for g in groups]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[f"_g_{g}" for g in groups], "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carried"))
    # a window here is the part of a group that one task has sorted
    within = Window.partitionBy(*groups, part).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = laid.withColumn("_local", F.coalesce(F.sum(own).over(within), F.lit(0)))
    found = local.join(carried, _same(local, carried, groups))
    return found.select(*[local[c] for c in df.columns], (F.col("_carried") + F.col("_local")).alias(name))
