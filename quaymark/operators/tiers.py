"""Placing files on storage tiers with budgets: a fold over ordered rows that is made parallel by ranges.

Tiers go from the fastest to the slowest; each has a share of all bytes as its budget. Videos come first,
from the slowest floor up and by rising bitrate: a video goes to its floor, the slowest tier that can stream it; where that is
full, to the next faster tier with room, and if there is none it stays on the floor all the same. Images follow, the best first; they fill
the tiers one after the other and never go back to one that was too full for an image before.

What a row does hangs on all rows before it, through the bytes used of each tier. Rows are dealt out by ranges of the order.
A range whose rows all end in one place, as its total and smallest file show, moves the state on by its sum; only ranges in
which a tier runs full are read one row after the other, by one task that holds the state alone. Then every
range knows the state before it, and all are placed at once.

Nulls: a file without a size counts as empty; without a bitrate its video needs eight megabits a second; without a quality it is
of 2.5; an unknown kind is an image. Ties follow the key. An empty table gives no plan.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.operators.ranges import laid_out
from quaymark.sources.shared import stored


@dataclass(frozen=True)
class Tier:
    """Megabytes a second, and a share of all bytes."""

    speed: float
    ratio: float


class Shelves:
    """Bytes used of each tier, and the tier that images have come to."""

    def __init__(self, budgets: Sequence[float], used: Sequence[float] | None = None, at: int = 0) -> None:
        self.budgets, self.used, self.at = list(budgets), list(used or [0.0] * len(budgets)), at

    def video(self, floor: int, size: int) -> int:
        tier = floor
        if self.used[tier] + size > self.budgets[tier]:
            tier = next((t for t in range(floor - 1, -1, -1) if self.used[t] + size <= self.budgets[t]), floor)
        self.used[tier] += size
        return tier

    def image(self, size: int) -> int:
        while self.at < len(self.budgets) - 1 and self.used[self.at] + size > self.budgets[self.at]:
            self.at += 1
        self.used[self.at] += size
        return self.at

    def place(self, floor: int, size: int) -> int:
        """The tier of the next file; images have the floor -1."""
        return self.image(size) if floor < 0 else self.video(floor, size)

    def skip(self, lowest: int, highest: int, total: int, least: int) -> bool:
        """Takes in a whole range of files if all of them go to one tier whatever their order."""
        if lowest != highest:
            return False
        if lowest < 0:
            if self.at < len(self.budgets) - 1 and self.used[self.at] + total > self.budgets[self.at]:
                return False
            self.used[self.at] += total
            return True
        for tier in range(lowest, -1, -1):
            if self.used[tier] + total <= self.budgets[tier]:
                self.used[tier] += total
                return True
            if self.used[tier] + least <= self.budgets[tier]:
                return False
        self.used[lowest] += total
        return True


def floor_tier(bitrate: Column, tiers: Sequence[Tier], headroom: float) -> Column:
    """The slowest tier that streams ``bitrate`` megabits a second with room to spare, else the fastest."""
    need = F.coalesce(F.nullif(bitrate, F.lit(0.0)), F.lit(8.0)) * headroom / 8.0
    fits = [F.when(F.lit(t.speed) >= need, F.lit(i)) for i, t in enumerate(tiers)]
    return F.coalesce(*reversed(fits), F.lit(0))


def tier_plan(files: DataFrame, tiers: Sequence[Tier], headroom: float = 1.5, hysteresis: float = 0.1) -> DataFrame:
    """``key, target, moves`` of files (key, kind, size, bitrate, quality, per_pixel, current).

    A file without a tier is always moved; one with a tier only if that is not its target and is too slow for it, is over
    its budget by more than ``hysteresis``, or is more than one tier away.
    """
    is_video = F.coalesce(F.col("kind") == "video", F.lit(False))
    floor = F.when(is_video, floor_tier(F.col("bitrate"), tiers, headroom)).otherwise(-1)
    rows = files.select(
        "key", F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")).alias("size"), floor.cast("int").alias("floor"), F.col("current").cast("int").alias("current"),
        F.when(is_video, F.coalesce("bitrate", F.lit(0.0))).otherwise(-F.coalesce("quality", F.lit(2.5))).alias("rank"),
        F.when(~is_video, F.coalesce("per_pixel", F.lit(1e9))).alias("per_pixel"),
    )
    ordered = laid_out(rows.withColumn("turn", -F.col("floor")), [], ["turn", "rank", "per_pixel", "key"], "tier-order").withColumn("part", F.shiftright("_at", 33))
    parts = ordered.groupBy("part").agg(
        F.min("floor").alias("lowest"), F.max("floor").alias("highest"), F.sum("size").alias("total"), F.min("size").alias("least"),
        *[F.sum(F.when(F.col("current") == i, F.col("size")).otherwise(0)).alias(f"on_{i}") for i in range(len(tiers))],
    )
    # a row for each range, as many as there are shuffle partitions
    ranges = sorted(parts.collect(), key=lambda r: r["part"])
    whole, shares = sum(r["total"] for r in ranges) or 1, sum(t.ratio for t in tiers) or 1
    budgets = [whole * t.ratio / shares for t in tiers]
    shelves, before = Shelves(budgets), []
    for r in ranges:
        before.append((r["part"], list(shelves.used), shelves.at))
        if not shelves.skip(r["lowest"], r["highest"], r["total"], r["least"]):
            shelves = _state_after(ordered.where(F.col("part") == r["part"]), shelves)

    spark = files.sparkSession
    states = spark.createDataFrame(before, "part long, used array<double>, at int")
    placing = ordered.join(F.broadcast(states), "part").repartition("part").sortWithinPartitions("part", "_at")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, now = None, None
        for rows in batches:
            targets = []
            for k, floor, size, used, at in zip(rows["part"], rows["floor"], rows["size"], rows["used"], rows["at"]):
                if k != part:
                    part, now = k, Shelves(budgets, used.tolist(), int(at))
                targets.append(now.place(int(floor), int(size)))
            yield rows[["key", "floor", "current"]].assign(target=targets)

    kind = files.schema["key"].dataType.simpleString()
    placed = placing.select("key", "floor", "current", "size", "part", "used", "at").mapInPandas(place, f"key {kind}, floor int, current int, target int")
    over = [i for i in range(len(tiers)) if sum(r[f"on_{i}"] for r in ranges) > budgets[i] * (1 + hysteresis)]
    here, to = F.col("current"), F.col("target")
    too_slow = (F.col("floor") >= 0) & (here > F.col("floor"))
    moves = here.isNull() | ((here != to) & (too_slow | here.isin(over) | (F.abs(here - to) > 1)))
    return stored(placed, "tier-plan").select("key", "target", moves.alias("moves"))


def _state_after(part: DataFrame, shelves: Shelves) -> Shelves:
    """The state behind one range, read in order by one task that keeps nothing else."""
    start = functools.partial(Shelves, shelves.budgets, shelves.used, shelves.at)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = start()
        for rows in batches:
            for floor, size in zip(rows["floor"].tolist(), rows["size"].tolist()):
                now.place(floor, size)
        yield pd.DataFrame({"used": [now.used], "at": [now.at]})

    in_order = part.repartition(1).sortWithinPartitions("_at").select("floor", "size")
    row = in_order.mapInPandas(fold, "used array<double>, at int").first()
    return Shelves(shelves.budgets, row["used"], row["at"])
