"""Distinct counts from sketches that are kept by period and merged later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two to this power registers; the standard error is about 1.04 by their root.
LOG_REGISTERS = 12


def period_sketches(rows: DataFrame, keys: list[Column | str], value: str) -> DataFrame:
    """A sketch of the distinct ``value`` of each key, a table to be kept and added to by the period. Nulls count as nothing."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, F.lit(LOG_REGISTERS)).alias("sketch"))


def merged_counts(sketches: DataFrame, keys: list[Column | str]) -> DataFrame:
    """``about`` of each coarser key, from the sketches alone."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
