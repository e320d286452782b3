"""SimHash near-duplicates: a popcount embedding, a grid range join, an exact check, components.

A fingerprint of 64 bits is seen as 32 segments of two bits. Its vector of segment popcounts, packed into
one long, is its cell. Two fingerprints that differ in at most two bits have cells at a Manhattan distance of two
or less, so a point of the grid lies within one step of both: cells are joined at such points. No more
than 65 cells meet at one, by construction, so no group grows with the data. The fingerprints of two cells that meet are paired
and checked by their differing bits; a fingerprint has no more than 2,080 others within two bits.

A change of one word in a few hundred flips several bits, and at a similarity of 0.8 some fifteen of 64 differ, where
popcounts bound nothing. Where ``least`` asks for such near copies (the pipeline does, the query op5 does not), an exact
set-similarity join of five-word shingles links them too: see ``similar_links``.

Only distinct fingerprints and texts take part; their members come back by a join. Nulls: a null text has no
words and the fingerprint zero; it links as any other. A null ``doc_id`` gets the component of its
fingerprint, and null if no document of the component has an id. Repeated ids are kept as they are.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators.graph import connected_components
from quaymark.sources.shared import stored

WORDS = 3
SEED = 42
#: For texts that are similar but more than two bits apart: words of a shingle and least similarity.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Hashes that two similar texts must share in their prefixes, as a part of the set; longer prefixes tell more texts apart.
SHARED_PART = 20
#: Buckets that a text is in while groups of like texts are found, least hashes that a bucket shares, and rounds of grouping.
BANDS, BAND, ROUNDS = 16, 3, 2
_MIXTURES = np.random.default_rng(0).integers(1 << 62, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles hashed at a time, so that a very long text needs little memory beyond its words.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the shingles of a text with ASCII letters lower-cased, as an unsigned number."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(tokens) - words + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        some = tokens[at : min(at + BLOCK, n) + words - 1]
        shingles = zip(*(some[k:] for k in range(words))) if len(tokens) >= words else [tokens]
        hashes = np.array([digest(b" ".join(s), SEED) for s in shingles], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of all five-word shingles of a text, in ascending order; of its words, if it has fewer."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, found = xxhash.xxh64_intdigest, [np.empty(0, np.uint64)]
    n = max(1, len(tokens) - SHINGLE_WORDS + 1) if tokens else 0
    for at in range(0, n, BLOCK):
        some = tokens[at : min(at + BLOCK, n) + SHINGLE_WORDS - 1]
        runs = zip(*(some[k:] for k in range(SHINGLE_WORDS))) if len(tokens) >= SHINGLE_WORDS else [tokens]
        found.append(np.fromiter((digest(b" ".join(s), SEED) for s in runs), np.uint64))
    return np.unique(np.concatenate(found))


def needed(size: int, least: float) -> int:
    """Of a set of ``size``, what any set of that similarity must share."""
    return math.ceil(least * size - 1e-9)


def bands(hashes: np.ndarray) -> np.ndarray:
    """For each of ``BANDS``, one number for the least ``BAND`` hashes under as many mixtures; two sets of similarity j agree in each with a chance of j ** BAND."""
    least = [(hashes * odd ^ (hashes * odd >> np.uint64(29))).min() if len(hashes) else odd for odd in _MIXTURES]
    mixed = np.array(least, np.uint64).reshape(BANDS, BAND) * _MIXTURES[:BAND]
    return (np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(31)), axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def fingerprints(docs: DataFrame, words: int = WORDS, least: float | None = None) -> DataFrame:
    """``(doc_id, text_key, fp, n, prefix)`` of each row: the id, a hash of the text, the fingerprint as a signed
    long, the number of shingles, and 40 bits of the least shingle hashes, of which texts of a similarity of ``least`` share as many
    as ``SHARED_PART`` says; the last two are empty without ``least``."""

    @F.pandas_udf("fp long, n int, prefix array<long>")
    def prints(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            found = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            sizes, prefixes = [], []
            for text in texts:
                hashes = shingles(text) if least is not None else np.empty(0, np.uint64)
                n = len(hashes)
                sizes.append(n)
                prefixes.append((hashes[: n - needed(n, least or 1) + n // SHARED_PART + 1] >> np.uint64(24)).astype(np.int64))
            yield pd.DataFrame({"fp": found, "n": sizes, "prefix": prefixes})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), prints("text").alias("p"))
    return keyed.select("doc_id", "text_key", "p.fp", "p.n", "p.prefix")


def cell(fp: Column) -> Column:
    """Popcounts of the 32 two-bit segments, in two bits each; by bit operations alone, so never an overflow."""
    ones = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(ones), F.shiftrightunsigned(fp, 1).bitwiseAND(ones)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _steps(at: Column) -> Column:
    """The cell and all cells one step away: a count of 0, 1 or 2 goes up or down by one."""
    around = [at]
    for shift in range(0, 64, 2):
        count = F.shiftrightunsigned(at, shift).bitwiseAND(F.lit(3))
        # 01 turns 0 into 1 and back, 11 turns 1 into 2 and back
        around += [F.when(count < 2, at.bitwiseXOR(_signed(1 << shift))), F.when(count > 0, at.bitwiseXOR(_signed(3 << shift)))]
    return F.array_compact(F.array(*around))


def _signed(word: int) -> Column:
    return F.lit(word - (1 << 64) if word >> 63 else word).cast("long")


def links(distinct: DataFrame) -> DataFrame:
    """``(src, dst)``: all pairs of ``distinct(fp, node)`` within two bits of each other."""
    placed = distinct.select("node", "fp", cell(F.col("fp")).alias("cell"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"))
    # few and short rows, of which many are made: over all tasks, not as few as their size would need
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = cells.repartition(tasks, "cell").select("cell", F.explode(_steps(F.col("cell"))).alias("point"))
    met = points.groupBy("point").agg(F.sort_array(F.collect_list("cell")).alias("cells")).where(F.size("cells") > 1)
    later = F.expr("flatten(transform(cells, (a, i) -> transform(slice(cells, i + 2, size(cells)), b -> struct(a AS a, b AS b))))")
    across = met.select(F.explode(later).alias("pair")).select("pair.a", "pair.b").distinct()
    within = cells.where("n > 1").select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    ends = [placed.select(F.col("cell").alias(x), F.col("fp").alias(f"fp_{x}"), F.col("node").alias(f"node_{x}")) for x in ("a", "b")]
    paired = across.union(within).join(ends[0], "a").join(ends[1], "b")
    close = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= 2
    # a pair within one cell comes in both orders, and with itself
    once = (F.col("a") != F.col("b")) | (F.col("fp_a") < F.col("fp_b"))
    return paired.where(close & once).select(F.col("node_a").alias("src"), F.col("node_b").alias("dst"))


def similar_links(docs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """``(src, dst)``, hashes of texts, that connect all texts of a similarity of ``least`` or more in their shingles.

    Of texts of n hashes and a similarity of ``least``, at least ``k`` are among the first ``n - least * n + k`` of both, in
    any order that holds for all texts. In the order of the hashes themselves, this leaves the few texts that share
    so many with others. Each of these is held against one text with the same least hashes, under each of ``BANDS`` mixtures of the
    hashes, and what is similar becomes one group; so a large group of like texts is not paired with itself. Groups that still share enough
    tokens with others are joined exactly, see ``_set_join``.
    """
    distinct = prints.where("n > 0").groupBy("text_key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    heads = distinct.select("text_key", "n", F.explode("prefix").alias("token"))
    repeated = heads.groupBy("token").agg(F.count("*").alias("times")).where("times > 1").select("token")
    meeting = stored(heads.join(repeated, "token", "left_semi"), "similar-heads")
    # a similar text can be shorter, and share fewer
    enough = F.count("*") >= F.floor(F.max(_must("n", least)) / SHARED_PART) + 1
    few = stored(meeting.groupBy("text_key").agg(enough.alias("enough")).where("enough").select("text_key"), "similar-few")
    sets = _sets(docs, few)
    groups = _groups(sets, least)
    group = F.coalesce("component", "text_key").alias("group")
    meeting = meeting.join(few, "text_key", "left_semi").join(groups.withColumnRenamed("node", "text_key"), "text_key", "left").select("text_key", "n", "token", group)
    across = meeting.groupBy("token").agg((F.min("group") < F.max("group")).alias("apart")).where("apart").select("token")
    left = meeting.join(across, "token", "left_semi").groupBy("text_key", "group").agg(enough.alias("enough")).where("enough")
    joined = _set_join(sets.join(stored(left.select("text_key", "group"), "similar-left"), "text_key"), sets, least)
    return groups.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(joined)


def _groups(sets: DataFrame, least: float) -> DataFrame:
    """``(node, component)``: groups of texts that are connected by similar ones. Round by round, other bands hold
    against each other what stands in different groups: the middlemost text of each group in a bucket and that of all."""
    every = sets.select("text_key", F.posexplode("bands").alias("nth", "band"))
    crowds = every.groupBy("band").agg(F.count("*").alias("crowd")).where("crowd > 1")
    # what agrees with most others lies in the middle of its like, and is likely similar to all of them
    middle = every.join(crowds, "band").groupBy("text_key").agg(F.struct(F.sum("crowd"), "text_key").alias("middle"))
    every = stored(every.join(crowds.select("band"), "band", "left_semi").join(middle, "text_key"), "similar-bands")
    edges, groups = None, sets.select(F.col("text_key").alias("node"), F.col("text_key").alias("component")).limit(0)
    for i in range(ROUNDS):
        bands = every.where(F.col("nth") % ROUNDS == i).join(groups.withColumnRenamed("node", "text_key"), "text_key", "left")
        members = bands.groupBy("band", F.coalesce("component", "text_key").alias("group")).agg(F.max("middle").alias("middle"))
        first = members.groupBy("band").agg(F.max("middle").alias("first"), F.count("*").alias("n")).where("n > 1").select("band", "first")
        pairs = members.join(first, "band").where("first <> middle").select(F.array_sort(F.array("first.text_key", "middle.text_key")).alias("ends"))
        pairs = pairs.select(F.col("ends")[0].alias("src"), F.col("ends")[1].alias("dst")).distinct()
        found = stored(_verified(pairs, sets, least), "similar-first")
        edges = found if edges is None else edges.union(found)
        groups = stored(connected_components(edges), "similar-groups")
    return groups


def _must(n: str, least: float) -> Column:
    """Of a set of ``n``, what any set of that similarity must share."""
    return F.ceil(F.lit(least) * F.col(n) - 1e-9).cast("int")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(text_key, n, all, bands)``: all shingles of the texts of ``wanted``. The copies of a text have one key, and one of them is enough."""

    def whole(texts: pd.Series) -> pd.DataFrame:
        found = [shingles(t) for t in texts]
        return pd.DataFrame({"all": [x.view(np.int64) for x in found], "bands": [bands(x) for x in found]})

    keyed = docs.select(F.xxhash64("text").alias("text_key"), "text").join(wanted, "text_key", "left_semi")
    found = keyed.groupBy("text_key").agg(F.first("text").alias("text"))
    return stored(found.select("text_key", F.pandas_udf(whole, "all array<long>, bands array<long>")("text").alias("s")).select("text_key", F.size("s.all").alias("n"), "s.all", "s.bands"), "similar-sets")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(src, dst)`` that are similar by their whole sets."""
    sizes = [sets.select(F.col("text_key").alias(x), F.col("n").alias(f"n_{x}")) for x in ("src", "dst")]
    near = F.least("n_src", "n_dst") >= F.ceil(F.lit(least) * F.greatest("n_src", "n_dst") - 1e-9)
    pairs = stored(pairs.join(sizes[0], "src").join(sizes[1], "dst").where(near).select("src", "dst"), "similar-pairs")
    for x in ("src", "dst"):
        pairs = pairs.join(sets.select(F.col("text_key").alias(x), F.col("all").alias(f"all_{x}")), x)
    shared = F.size(F.array_intersect("all_src", "all_dst"))
    return pairs.where(shared >= F.lit(least) * (F.size("all_src") + F.size("all_dst") - shared) - 1e-9).select("src", "dst")


def _set_join(grouped: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``(src, dst)``: all texts of different groups of ``grouped(text_key, n, all, group)`` that are similar.

    Tokens are ordered by the number of texts that hold them, rarest first; those that one text alone holds meet nothing.
    The longer text of a pair looks up its first ``n - least * n + 1`` tokens, and the shorter one is found by its first
    ``n - 2 * least / (1 + least) * n + 1`` (prefix filter); lengths and positions thin out the pairs as they are
    made, and the whole sets decide. So a passage that many texts share is looked up only where nearly all of a text is so common.
    """
    tokens = grouped.select("text_key", F.explode("all").alias("token"))
    # written first, so that the files of this shuffle are gone before all tokens are dealt out again
    common = stored(tokens.groupBy("token").agg(F.count("*").alias("held")).where("held > 1"), "similar-common")
    ranked = (
        tokens.join(common, "token")
        .groupBy("text_key")
        .agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("ranked"))
        .join(grouped.select("text_key", "n", "group"), "text_key")
        .withColumn("most", F.size("ranked"))
        .where(F.col("most") >= _must("n", least))
    )
    first = F.slice("ranked", F.lit(1), F.col("most") - _must("n", least) + 1)
    entries = ranked.select("text_key", "group", "n", "most", F.posexplode(first).alias("at", "entry"))
    found_by = F.col("at") <= F.col("most") - F.ceil(F.lit(2 * least / (1 + least)) * F.col("n") - 1e-9)
    entries = entries.select("text_key", "group", "n", (F.col("most") - F.col("at")).alias("left"), F.col("entry.token").alias("token"), found_by.alias("found_by"))
    entries = stored(entries, "similar-prefixes")
    x, y = entries.alias("x"), entries.where("found_by").alias("y")
    both = F.col("x.n") + F.col("y.n")
    meet = (
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.group") != F.col("y.group"))
        & ((F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.text_key") < F.col("x.text_key"))))
        & (F.col("y.n") >= F.ceil(F.lit(least) * F.col("x.n") - 1e-9))
        & (F.least("x.left", "y.left") >= F.ceil(F.lit(least / (1 + least)) * both - 1e-9))
    )
    return _verified(x.join(y, meet).select(F.col("x.text_key").alias("src"), F.col("y.text_key").alias("dst")).distinct(), sets, least)


def near_duplicates(docs: DataFrame, words: int = WORDS, least: float | None = None) -> DataFrame:
    """``(doc_id, text_key, fp, component_id)`` of each row of ``docs``.

    Fingerprints link within two bits; with ``least``, texts of that similarity in five-word shingles link too.
    """
    prints = stored(fingerprints(docs, words, least), "fingerprints")
    # a node is the smallest doc_id with the fingerprint; one without ids takes part under none
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct-fingerprints")
    edges = links(distinct.where("node is not null"))
    if least is not None:
        # each part of the edges is written on its own, so that the driver plans few joins at a time
        edges = stored(edges, "fingerprint-links")
        # the texts stand for their fingerprints
        of = stored(prints.groupBy("text_key").agg(F.first("fp").alias("fp")).join(distinct, "fp").select("text_key", "node"), "text-nodes")
        similar = similar_links(docs, prints, least)
        for end in ("src", "dst"):
            similar = similar.join(of.withColumnRenamed("text_key", end), end).drop(end).withColumnRenamed("node", end)
        edges = edges.union(similar.select("src", "dst"))
    components = connected_components(edges)
    labelled = distinct.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.select("doc_id", "text_key", "fp").join(labelled, "fp")


def deduplicated(docs: DataFrame, words: int = WORDS, least: float | None = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, and the smallest hash of the text."""
    found = stored(near_duplicates(docs, words, least), "near-duplicates")
    # documents without an id in a component without ids stand for themselves by their fingerprint
    group = F.coalesce("component_id", "fp"), F.col("component_id").isNull()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("row")
    chosen = found.groupBy(group[0].alias("group"), group[1].alias("nameless")).agg(least)
    times = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("times"))
    picked = chosen.select(F.col("row.doc_id").alias("of_doc"), F.col("row.text_key").alias("of_text"))
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_text"))
    staying = stored(times.join(picked, same).select("of_doc", "of_text", "times"), "deduplicated-keys")
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("of_doc")) & (F.xxhash64("text") == F.col("of_text"))
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "text").join(staying, here).select("doc", "of_doc", "of_text", "times")
    # only rows that are repeated as a whole need another look
    once, more = rows.where("times = 1"), rows.where("times > 1").dropDuplicates(["of_doc", "of_text"])
    return once.union(more).select("doc.*")


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5: doc_id, fingerprint, component_id of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
