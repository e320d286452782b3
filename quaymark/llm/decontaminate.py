"""Benchmark decontamination by latent semantic retrieval.

The words of the benchmark items are the terms; a text is a sequence of term codes, other words being
holes. Documents are cut into blocks of ``STRIDE`` words; a passage is two blocks in a row, so passages overlap.
Terms are weighted by the square of the inverse document frequency, counted over all documents. A
randomised singular value decomposition of the TF-IDF passages gives the latent space: tasks multiply their
passages with a random matrix, then with the basis found, and Spark adds up the products term by term.
Its axes are scaled to unit variance, or else the words that most passages share would rule the cosines. It is fitted
on every passage of every document and of the benchmark, which weighs against the documents as it would against
``BESIDE`` of them, or else its own words would lose their axes as a corpus grows. The search then runs over the same passages.

A passage with a cosine of ``COSINE`` or more to an item is a candidate. Around it the longest common subsequence
with the item is taken: ``LCS`` of the item's words must occur in order within a span of the text, and of the
item's answer words (its rarest terms) ``ANSWER`` must be there. This admits verbatim and lightly
paraphrased passages.

The benchmark is the stated query set. All its items share one vocabulary and one latent space, and documents are
encoded and searched once; a task multiplies its passages with ``ITEMS`` items at a time. What is sent to the
tasks is bounded by ``TERMS``: only a benchmark of more distinct words is taken in parts. No document is collected or shuffled.

Nulls: null texts have no passages; items without words are left out; null ids are kept. Repeated rows are
judged each. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.sources.shared import stored

STRIDE = 16
RANK = 128
OVERSAMPLE = 8
ITEMS = 1024
TERMS = 1 << 18
COSINE = 0.25
BESIDE = 2000
LCS = 0.5
ANSWER = 0.33
#: Blocks whose similarities a task holds at a time.
BLOCKS = 4096
#: The same for the fit, whose sums of vectors then stay near the processor.
FIT_BLOCKS = 1024
#: Rows that are added up one after the other.
RUN = 16

_SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
CODES = "kind int, doc_id long, text_key long, codes binary, term int, n long"
HITS = "doc_id long, text_key long, item_id long, cosine double, lcs double, answer double, start long"


def words(text: str | None) -> list[bytes]:
    """Words in lower case, cut at ASCII marks and blanks."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def lcs_length(item: list[int], passage: list[int]) -> int:
    """Length of the longest common subsequence, by bits; negative codes match nothing."""
    places: dict[int, int] = {}
    for i, code in enumerate(item):
        places[code] = places.get(code, 0) | 1 << i
    full = row = (1 << len(item)) - 1
    for code in passage:
        if match := places.get(code, 0):
            both = row & match
            row = ((row + both) | (row - both)) & full
    return len(item) - row.bit_count()


@dataclass
class Items:
    """A block of the benchmark: ids, term codes and the vocabulary."""

    ids: list[int]
    codes: list[list[int]]
    vocabulary: dict[bytes, int]

    @classmethod
    def parts(cls, rows: Iterator) -> Iterator[Items]:
        """All items together, unless they have more than ``TERMS`` distinct words."""
        part = cls([], [], {})
        for row in rows:
            if found := words(row["text"]):
                part.ids.append(row["item_id"])
                part.codes.append([part.vocabulary.setdefault(w, len(part.vocabulary)) for w in found])
            if len(part.vocabulary) >= TERMS:
                yield part
                part = cls([], [], {})
        if part.ids:
            yield part


class Blocks:
    """Sums of term vectors over the blocks of some documents."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        lengths = np.array([len(d) for d in docs])
        self.count = -(-lengths // STRIDE)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        codes = np.concatenate(docs) if docs else np.empty(0, np.int32)
        at = np.concatenate([f + np.arange(n) // STRIDE for f, n in zip(self.first, lengths)]) if docs else codes
        known = codes >= 0
        self.codes, self.block = codes[known], at[known]
        ends = self.first[1:][self.count > 0] - 1
        #: Whether the next block belongs to the same document.
        self.goes_on = np.ones(self.first[-1], bool)
        self.goes_on[ends] = False

    def sums(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros((self.first[-1], vectors.shape[1]), np.float32)
        add_rows(out, self.block, vectors, self.codes)
        return out

    def passages(self, vectors: np.ndarray) -> np.ndarray:
        out = self.sums(vectors)
        out[:-1][self.goes_on[:-1]] += out[1:][self.goes_on[:-1]]
        return out

    def back(self, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Adds the transpose of the passages' term counts times ``rows`` to ``out``, which has a row for each term."""
        spread = rows.copy()
        spread[1:][self.goes_on[:-1]] += rows[:-1][self.goes_on[:-1]]
        order = np.argsort(self.codes.astype(np.uint16) if len(out) <= 1 << 16 else self.codes, kind="stable")
        add_rows(out, self.codes[order], spread, self.block[order])
        return out


def add_rows(out: np.ndarray, to: np.ndarray, rows: np.ndarray, of: np.ndarray) -> None:
    """Adds ``rows[of]`` to ``out[to]``; ``to`` ascends.

    What goes to one row is cut into runs of ``RUN``. The first rows of all runs are taken at once, then all second ones are added, and so on: a
    sum of each run on its own (``reduceat``) takes ten times as long. The sums of runs are added up in the same way.
    """
    while len(to):
        new = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        place = np.arange(len(to)) - np.repeat(new, np.diff(new, append=len(to)))
        starts = np.flatnonzero(place % RUN == 0)
        held = np.diff(starts, append=len(to))
        order = np.argsort(-held, kind="stable")
        first, less = starts[order], -held[order]
        sums = rows[of[first]]
        more = np.empty_like(sums)
        for k in range(1, -less[0]):
            n = np.searchsorted(less, -k)
            np.take(rows, of[first[:n] + k], axis=0, out=more[:n], mode="clip")
            sums[:n] += more[:n]
        if len(starts) == len(new):
            out[to[first]] += sums
            return
        to, rows, of = to[starts], sums, np.argsort(order)


def encode(docs: DataFrame, items: Items) -> DataFrame:
    """Kind 0: the term codes of each document. Kind 1: document frequencies, one row for a term and task."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        # the last place is for other words, -1
        counts, at = np.zeros(len(vocabulary.value) + 1, np.int64), np.empty(len(vocabulary.value) + 1, np.int64)
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = words(text.as_py())
                codes = np.fromiter(map(get, found, itertools.repeat(-1)), np.int32, len(found))
                # of equal codes, one place stays
                places = np.arange(len(codes))
                at[codes] = places
                counts[codes[at[codes] == places]] += 1
                out.append(codes.tobytes())
            yield _rows(0, batch["doc_id"], batch["text_key"], out, None, None)
        terms = np.flatnonzero(counts[:-1])
        yield _rows(1, None, None, None, terms, counts[terms])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return stored(keyed.mapInArrow(run, CODES), "term-codes", "kind")


def _rows(kind: int, doc_id, text_key, codes, terms, n) -> pa.RecordBatch:
    size = len(codes) if codes is not None else len(terms)
    columns = (([kind] * size, pa.int32()), (doc_id, pa.int64()), (text_key, pa.int64()), (codes, pa.binary()), (terms, pa.int32()), (n, pa.int64()))
    arrays = [pa.nulls(size, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in columns]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "doc_id", "text_key", "codes", "term", "n"])


def weights(codes: DataFrame, terms: int) -> np.ndarray:
    """Squared inverse document frequencies; no more rows than terms come to the driver."""
    total = codes.where("kind = 0").count()
    found = np.zeros(terms)
    for row in codes.where("kind = 1").groupBy("term").agg(F.sum("n").alias("n")).collect():
        found[row["term"]] = row["n"]
    return np.log((total + 1) / (found + 0.5)) ** 2


def latent_basis(codes: DataFrame, items: Items, idf: np.ndarray) -> np.ndarray:
    """``terms x rank`` basis of the whitened latent space: a randomised decomposition with one power step."""
    terms = len(idf)
    rank = min(RANK, terms)
    width = min(rank + OVERSAMPLE, terms)
    own = Blocks([np.array(c, np.int32) for c in items.codes])
    weight = max(1.0, codes.where("kind = 0").count() / BESIDE)
    basis = np.random.default_rng(0).standard_normal((terms, width))
    for _ in range(2):
        product = _product(codes.where("kind = 0"), idf, basis) + weight * idf[:, None] * own.back(own.passages((idf[:, None] * basis).astype(np.float32)), np.zeros(basis.shape))
        basis_before, (basis, _) = basis, np.linalg.qr(product)
    # the last product belongs to the basis before; its small matrix orders the directions
    small = basis.T @ product @ (basis_before.T @ basis)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:rank]
    return basis @ turned[:, order] / np.sqrt(np.maximum(values[order], 1e-9))


def _product(codes: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The Gram matrix of the documents' TF-IDF passages times ``basis``, added up by Spark for each term."""
    sent = codes.sparkSession.sparkContext.broadcast(((idf[:, None] * basis).astype(np.float32), idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, idf = sent.value
        out = np.zeros(vectors.shape, np.float64)
        for docs in _documents(batches, FIT_BLOCKS):
            blocks = Blocks([d for _, _, d in docs])
            blocks.back(blocks.passages(vectors), out)
        for at in range(0, len(out), 1024):
            part = idf[at : at + 1024, None] * out[at : at + 1024]
            values = pa.ListArray.from_arrays(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part)), pa.int32()), values], names=["term", "row"])

    rows = codes.mapInArrow(run, "term int, row array<double>").withColumn("row", array_to_vector("row"))
    found = rows.groupBy("term").agg(vector_to_array(Summarizer.sum(F.col("row"))).alias("row")).collect()
    out = np.zeros(basis.shape)
    for row in found:
        out[row["term"]] = row["row"]
    return out


def _documents(batches: Iterator[pa.RecordBatch], most: int = BLOCKS) -> Iterator[list[tuple]]:
    """Documents of some blocks in all; a long one comes alone."""
    some, size = [], 0
    for batch in batches:
        for doc_id, key, raw in zip(batch["doc_id"].to_pylist(), batch["text_key"].to_pylist(), batch["codes"]):
            codes = np.frombuffer(raw.as_buffer(), np.int32)
            some.append((doc_id, key, codes))
            size += len(codes) // STRIDE + 1
            if size >= most:
                yield some
                some, size = [], 0
    if some:
        yield some


def search(codes: DataFrame, items: Items, idf: np.ndarray, basis: np.ndarray) -> DataFrame:
    """``HITS``: the items that each document holds, each with its best passage."""
    vectors = (idf[:, None] * basis).astype(np.float32)
    counts = np.zeros((len(items.ids), len(idf)), np.float32)
    for i, item in enumerate(items.codes):
        np.add.at(counts[i], item, 1)
    queries = counts @ vectors
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
    floor = 0.25 * float(np.median(np.linalg.norm(counts @ vectors, axis=1)))
    answers = [set(sorted(set(c), key=lambda t: (-idf[t], t))[: max(3, len(set(c)) // 4)]) for c in items.codes]
    sent = codes.sparkSession.sparkContext.broadcast((vectors, queries.T.copy(), floor, items.ids, items.codes, answers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, queries, floor, ids, wanted, answers = sent.value
        for docs in _documents(batches):
            blocks = Blocks([d for _, _, d in docs])
            passages = blocks.passages(vectors)
            passages /= np.maximum(np.linalg.norm(passages, axis=1, keepdims=True), floor)
            best: dict[tuple[int, int], tuple] = {}
            for at, first in itertools.product(range(0, len(passages), BLOCKS), range(0, len(ids), ITEMS)):
                cosines = passages[at : at + BLOCKS] @ queries[:, first : first + ITEMS]
                rows, near = np.nonzero(cosines >= COSINE)
                of = np.searchsorted(blocks.first, at + rows, side="right") - 1
                starts = (at + rows - blocks.first[of]) * STRIDE
                for doc, start, item, cosine in zip(of.tolist(), starts.tolist(), (first + near).tolist(), cosines[rows, near].tolist()):
                    found = _verified(docs[doc][2], start, wanted[item], answers[item])
                    if found and found[0] > best.get((doc, item), (0, 0, -1.0))[2]:
                        best[doc, item] = (start, cosine, *found)
            if best:
                yield pa.RecordBatch.from_pylist(
                    [
                        {"doc_id": docs[doc][0], "text_key": docs[doc][1], "item_id": ids[item], "cosine": c, "lcs": lcs, "answer": a, "start": start}
                        for (doc, item), (start, c, lcs, a) in best.items()
                    ],
                    schema=pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("start", pa.int64())]),
                )

    return codes.where("kind = 0").mapInArrow(run, HITS)


def _verified(doc: np.ndarray, start: int, item: list[int], answer: set[int]) -> tuple[float, float] | None:
    """Share of the item's words in order, and of its answer words, around a passage; none if too few."""
    n = len(item)
    around = doc[max(0, start - n) : start + 2 * STRIDE + n]
    share = len(answer.intersection(around.tolist())) / len(answer)
    if share < ANSWER or lcs_length(item, around := around.tolist()) < LCS * n:
        return None
    # the words must lie within a span of one and a half times the item
    span, most = n + n // 2, 0
    for at in range(0, max(1, len(around) - span + 1), max(1, n // 4)):
        most = max(most, lcs_length(item, around[at : at + span]))
    if len(around) > span:
        most = max(most, lcs_length(item, around[-span:]))
    return (most / n, share) if most >= LCS * n else None


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``HITS`` of all documents against all items."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").orderBy("item_id", "text")
    parts = [_against(docs, items) for items in Items.parts(rows.toLocalIterator())]
    return functools.reduce(DataFrame.union, parts, benchmark.sparkSession.createDataFrame([], HITS))


def _against(docs: DataFrame, items: Items) -> DataFrame:
    codes = encode(docs, items)
    idf = weights(codes, len(items.vocabulary))
    return stored(search(codes, items, idf, latent_basis(codes, items, idf)), "contaminated")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    hits = contaminated(docs, benchmark).select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_text")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_text"))
    # the row travels as one column, so that its own columns can have any names
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "text")
    return rows.join(hits, same, "left_anti").select("doc.*")


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op4: each document and item it holds, with the figures of the best passage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "cosine", "lcs", "answer", "start")
