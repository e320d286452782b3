"""Near-duplicates in stages: exact copies, a 64-bit guard, a 1,024-bit check, exclusions, scores with a cache, groups.

Each stage takes the pairs that the one before it left and can drop some; wide fingerprints and scores are made for what is still in question only.
Pairs are ``(a, b)`` with ``a < b``.

Nulls: a null key is left out; a null text is empty. An empty table gives no pairs. Ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions.fingerprints import wide_votes
from quaymark.operators.graph import connected_components
from quaymark.operators.similarity import hamming, hamming_pairs, hash_classes, reference_order, text_bits
from quaymark.sources.shared import stored

GUARD, VERIFY = 5, 60
Scorer = tuple[str, Callable[[DataFrame], DataFrame]]


def distinct_words(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), ""))


def exact_firsts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, first``: the smallest key with the same text."""
    digests = rows.where(F.col(key).isNotNull()).select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))
    return digests.join(digests.groupBy("digest").agg(F.min(key).alias("first")), "digest").select(key, "first")


def guarded(firsts: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs whose 64-bit fingerprints differ in ``GUARD`` bits or fewer; of equal fingerprints, each with the class's first."""
    bits = stored(text_bits(firsts, key, text), "staged-bits")
    classes = stored(hash_classes(bits, key, "h"), "staged-classes")
    near = hamming_pairs(classes, "first", "h", GUARD).select("a", "b")
    equal = bits.join(classes.select("h", "first"), "h").where(F.col(key) != F.col("first")).select(F.col("first").alias("a"), F.col(key).alias("b"))
    return near.unionByName(equal)


def verified(pairs: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(a, b, distance)``: pairs whose wide fingerprints differ in ``VERIFY`` bits or fewer."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    wide = stored(rows.join(asked, key, "left_semi").select(key, wide_votes(F.col(text)).alias("wide")), "staged-wide")
    both = pairs.join(wide.select(F.col(key).alias("a"), F.col("wide").alias("wa")), "a").join(wide.select(F.col(key).alias("b"), F.col("wide").alias("wb")), "b")
    distance = F.aggregate(F.zip_with("wa", "wb", hamming), F.lit(0), lambda n, x: n + x)
    return both.select("a", "b", distance.alias("distance")).where(F.col("distance") <= VERIFY)


def without_exclusions(pairs: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Pairs that no row of ``exclusions`` (a, b) names, in whichever order."""
    named = exclusions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    return pairs.join(named, ["a", "b"], "left_anti")


def verdicts(pairs: DataFrame, cache: DataFrame, model: str, scorers: Sequence[Scorer]) -> DataFrame:
    """``a, b, score, by``: the cached verdict of ``model``, else the score of the first scorer that gives one.

    ``cache``: a, b, model, score, with the pair in whichever order. A scorer takes the pairs still without a score and returns ``a, b, score``
    of those that it can judge; only misses come to it. ``by`` names who answered; what ``model`` itself answered is to be put into the cache.
    """
    known = cache.where(F.col("model") == model).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))
    found = pairs.join(known, ["a", "b"]).select("a", "b", "score", F.lit("cache").alias("by"))
    left = stored(pairs.select("a", "b").join(known, ["a", "b"], "left_anti"), "staged-misses")
    for name, scorer in scorers:
        scored = stored(scorer(left).where("score IS NOT NULL").select("a", "b", "score", F.lit(name).alias("by")), "staged-scores")
        found = found.unionByName(scored)
        left = left.join(scored, ["a", "b"], "left_anti")
    return found


def updated_cache(cache: DataFrame, found: DataFrame, model: str) -> DataFrame:
    """The cache with the verdicts that ``model`` has given now."""
    return cache.select("a", "b", "model", "score").unionByName(found.where(F.col("by") == model).select("a", "b", F.lit(model).alias("model"), "score"))


def word_overlap(rows: DataFrame, key: str, text: str) -> Callable[[DataFrame], DataFrame]:
    """A scorer: the share of distinct words that two texts have in common; none for texts without words."""

    def score(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
        words = stored(rows.join(asked, key, "left_semi").select(key, distinct_words(F.col(text)).alias("words")).where(F.size("words") > 0), "staged-words")
        both = pairs.join(words.toDF("a", "wa"), "a").join(words.toDF("b", "wb"), "b")
        return both.select("a", "b", (F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))).alias("score"))

    return score


def confirmed_groups(scored: DataFrame, least: float) -> DataFrame:
    """``component, node, total, rank`` of the groups that pairs of a score of ``least`` or more make, the best connected member first."""
    sure = stored(scored.where(F.col("score") >= least).select("a", "b", "score"), "staged-sure")
    return reference_order(sure, connected_components(sure, "a", "b"), "score")
