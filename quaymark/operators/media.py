"""Candidates and offsets of sequences of fingerprints: shared steps, votes for one offset.

Nulls: rows with a null sequence, position or value are left out. Repeated rows count as often as they occur. An
empty table gives no pairs.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions.fingerprints import passage_bits
from quaymark.operators.similarity import hamming, hamming_pairs, text_bits
from quaymark.sources.shared import stored

# Steps with so few or so many bits are flat; a step this near to the last one kept is a repeat.
FLAT_LOW, FLAT_HIGH, REPEAT_BITS = 3, 61, 2
# Fingerprints of silence, the multiplier and the rate of content-defined sampling.
SILENT, MULTIPLIER, SAMPLE = (0, 0xFFFFFFFF), 2654435761, 8
#: Pairs of clips that a round meets, for each step of a clip.
EACH = 4


def kept_steps(steps: Column) -> Column:
    """Of an array of 64-bit fingerprints in order those that are not flat and no near repeats of the last one kept."""

    def add(kept: Column, h: Column) -> Column:
        last = F.element_at(kept, F.greatest(F.size(kept), F.lit(1)))
        fresh = (F.size(kept) == 0) | (hamming(last, h) > REPEAT_BITS)
        return F.when(fresh, F.concat(kept, F.array(h))).otherwise(kept)

    told = F.filter(steps, lambda h: (F.bit_count(h) > FLAT_LOW) & (F.bit_count(h) < FLAT_HIGH))
    return F.aggregate(told, F.array().cast("array<bigint>"), add)


def indexed_steps(steps: DataFrame) -> DataFrame:
    """``clip, kept``: the 64-bit fingerprints of each clip in order, without flat ones and near repeats of the last one kept."""
    known = steps.where("clip IS NOT NULL AND step IS NOT NULL AND h IS NOT NULL")
    told = known.where(~((F.bit_count("h") <= FLAT_LOW) | (F.bit_count("h") >= FLAT_HIGH)))
    clips = told.groupBy("clip").agg(F.sort_array(F.collect_list(F.struct("step", "h"))).alias("s"))
    return clips.select("clip", kept_steps(F.col("s.h")).alias("kept"))


def indexed_passages(texts: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """``clip, kept``: the same of texts, whose passages of ``length`` words are the steps.

    A text's passages are made into fingerprints where it is read, and only those go on. Passages of rows with one key vote together: keys that occur more than once are
    found first, by keys alone, and their votes added up. Texts without a step have an empty array.
    """
    rows = texts.where(F.col(key).isNotNull()).select(F.col(key).alias("clip"), F.col(text).alias("text"))
    repeated = stored(rows.groupBy("clip").agg(F.count("*").alias("n")).where("n > 1").select("clip"), "media-repeated")
    steps = rows.select("clip", passage_bits(F.col("text"), length).alias("steps")).join(repeated, "clip", "left_anti")
    kept = steps.select("clip", kept_steps(F.col("steps")).alias("kept"))
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), "")
    passage = lambda i: F.array_join(F.slice("words", (i * length + 1).cast("int"), F.lit(length)), " ")
    passages = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / length)), passage))
    cut = rows.join(repeated, "clip", "left_semi").select("clip", words.alias("words")).where(F.size("words") > 0).select("clip", passages.alias("nth", "passage"))
    bits = text_bits(cut.select(F.struct("clip", "nth").alias("id"), "passage"), "id", "passage")
    return kept.unionByName(indexed_steps(bits.select("id.clip", F.col("id.nth").alias("step"), "h")))


def shared_step_pairs(steps: DataFrame, limit: int = 5, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """As ``shared_kept_pairs``, of rows ``clip, step, h``."""
    return shared_kept_pairs(indexed_steps(steps), limit, least)


def shared_kept_pairs(indexed: DataFrame, limit: int = 5, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b, shared)`` of clips that share enough steps, and the classes ``(clip, first)`` of clips with equal steps; ``indexed``: clip, kept.

    Two steps are shared if they differ in ``limit`` bits or fewer; a pair needs ``least`` such pairs of steps, or as many as the smaller clip has
    steps. Clips with equal steps are one class, under its smallest clip, and steps with equal fingerprints one row of the Hamming
    join, so that copies are not paired with each other.
    """
    # asked of what is written; before, the condition would make each array twice
    kept = stored(indexed, "media-steps").where(F.size("kept") > 0)
    firsts = kept.groupBy("kept").agg(F.min("clip").alias("first"))
    classes = kept.join(firsts, "kept").select("clip", "first")
    own = firsts.select(F.col("first").alias("clip"), F.least(F.lit(least), F.size("kept")).alias("need"), F.explode("kept").alias("h"))
    counts = stored(own.groupBy("clip", "need", "h").agg(F.count("*").alias("m")), "media-counts")
    hashes = counts.select("h").distinct()
    near = hamming_pairs(hashes, "h", "h", limit).select(F.col("a").alias("ha"), F.col("b").alias("hb"))
    near = stored(near.unionByName(near.select(F.col("hb").alias("ha"), F.col("ha").alias("hb"))).unionByName(hashes.select(F.col("h").alias("ha"), F.col("h").alias("hb"))), "media-near")
    reach = stored(counts.select(F.col("clip").alias("a"), F.col("need").alias("na"), F.col("h").alias("ha"), F.col("m").alias("ma")).join(near, "ha").drop("ha"), "media-reach")
    right = counts.select(F.col("clip").alias("b"), F.col("need").alias("nb"), F.col("h").alias("hb"), F.col("m").alias("mb"))
    return _in_rounds(reach, right, _rounds(reach, counts)), classes


def _rounds(reach: DataFrame, counts: DataFrame) -> int:
    """So many that a round meets ``EACH`` pairs for each step of a clip; about."""
    degrees = counts.groupBy(F.col("h").alias("hb")).agg(F.count("*").alias("n"))
    steps, met = counts.count(), reach.join(degrees, "hb").agg(F.sum("n")).first()[0] or 0
    return max(1, math.ceil(met / (2 * EACH * max(steps, 1))))


def _in_rounds(reach: DataFrame, right: DataFrame, rounds: int) -> DataFrame:
    """``(a, b, shared)``, counted for some of the clips ``a`` at a time: what a round shuffles goes with it, and the pairs that share enough stay.

    Pairs that share one step are many times those that share enough, and grow with the square of a passage's frequency.
    """

    def shared(some: DataFrame) -> DataFrame:
        met = some.join(right, "hb").where("a < b").groupBy("a", "b")
        counted = met.agg(F.sum(F.col("ma") * F.col("mb")).alias("shared"), F.min(F.least("na", "nb")).alias("need"))
        return counted.where("shared >= need").select("a", "b", "shared")

    if rounds == 1:
        return shared(reach)
    part = F.pmod(F.xxhash64("a"), F.lit(rounds))
    done = [stored(shared(reach.where(part == i)), "media-shared") for i in range(rounds)]
    return functools.reduce(DataFrame.unionByName, done)


def sampled(fingerprints: DataFrame) -> DataFrame:
    """The fingerprints that their own hash picks, silence left out."""
    # the lower half of a 64-bit product, from the halves of the value, which a long can hold
    low, high = F.col("value").bitwiseAND(0xFFFF), F.shiftright("value", 16).bitwiseAND(0xFFFF)
    product = low * MULTIPLIER + F.shiftleft((high * MULTIPLIER).bitwiseAND(0xFFFF), 16)
    picked = F.shiftright(product, 16).bitwiseAND(0xFFFF) % SAMPLE == 0
    return fingerprints.where(~F.col("value").isin(*SILENT) & picked)


def voted_candidates(fingerprints: DataFrame, votes: int = 3, most: int = 32) -> DataFrame:
    """``(a, b)``: tracks of which ``votes`` pairs of equal sampled values agree on an offset, in steps of four.

    ``fingerprints``: track, position, value (32 bits as a long). By this index's rule a value that occurs more than ``most`` times places nothing; so a value
    gives a bounded number of pairs.
    """
    picked = stored(sampled(fingerprints.where("track IS NOT NULL AND position IS NOT NULL").select("track", "position", "value")), "media-sampled")
    told = picked.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("value")
    rows = picked.join(told, "value")
    left, right = rows.toDF("value", "a", "pa"), rows.toDF("value", "b", "pb")
    bucket = F.floor((F.col("pb") - F.col("pa")) / 4)
    return left.join(right, "value").where("a < b").groupBy("a", "b", bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") >= votes).select("a", "b").distinct()


def voted_offsets(pairs: DataFrame, fingerprints: DataFrame, first: int = 8) -> DataFrame:
    """``(a, b, offset)`` of pairs of tracks: how far ``b`` runs behind ``a``, voted by all values that they share.

    Each position of ``a`` votes with the ``first`` positions of ``b`` that hold its value, in steps of two; around the step with the most votes the
    single offset with the most of them wins, the smallest of equals. A value that fills a track costs ``first`` votes for each position, not their square.
    Pairs without a shared value have no row.
    """
    told = fingerprints.where("track IS NOT NULL AND position IS NOT NULL").where(~F.col("value").isin(*SILENT)).select("track", "position", "value")
    early = told.withColumn("nth", F.row_number().over(Window.partitionBy("track", "value").orderBy("position"))).where(F.col("nth") <= first)
    asked = pairs.select("a", "b").distinct()
    votes = asked.join(told.toDF("a", "pa", "value"), "a").join(early.select(F.col("track").alias("b"), "value", F.col("position").alias("pb")), ["b", "value"])
    counts = stored(votes.groupBy("a", "b", (F.col("pb") - F.col("pa")).alias("offset")).agg(F.count("*").alias("n")), "media-votes")
    halves = counts.groupBy("a", "b", F.floor(F.col("offset") / 2).alias("half")).agg(F.sum("n").alias("n"))
    best = halves.groupBy("a", "b").agg(F.min(F.struct((-F.col("n")).alias("less"), "half")).alias("best")).select("a", "b", (F.col("best.half") * 2).alias("at"))
    near = counts.join(best, ["a", "b"]).where("offset BETWEEN at - 2 AND at + 3")
    won = near.groupBy("a", "b").agg(F.min(F.struct((-F.col("n")).alias("less"), "offset")).alias("won"))
    return won.select("a", "b", F.col("won.offset").alias("offset"))
