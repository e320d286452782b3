"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds, in this order: one frame for each document (more for documents of over
``FRAME_TOKENS`` ids), a skippable frame with the index of the documents, and a skippable frame with
the seek table of the public seekable format: each frame's compressed and full size and the low
half of the XXH64 of its contents. ``zstd -d`` reads such a file as the plain array of all ids. A
reader fetches the two indexes at the end and then only the frames of the documents it wants.

Nulls: a null text is an empty document; a null ``doc_id`` sorts first and is kept as null. Rows with
the same ``doc_id`` are all written, in any order among themselves. An empty table gives no
files and no rows. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import itertools
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.llm.tokens import default_tokenizer, encoder
from quaymark.sources.shared import filesystem, new_path, stored

END_ID = 2
FRAME_TOKENS = 1 << 18
#: Bytes of texts encoded in one call, and rows of a batch, so that a task holds few of them at a time.
CHARACTERS = 4_000_000
TEXTS = 256
#: Frames that one reading task takes.
READ_FRAMES = 4096

# Fixed values of the zstandard seekable format.
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A5D
SEEK_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

_ENTRY = np.dtype([("packed", "<u4"), ("full", "<u4"), ("checksum", "<u4")])
_DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("first_frame", "<u4"), ("n_tokens", "<u8")])
MANIFEST = "path string, part long, n_docs long, n_frames long, n_tokens long"
READ = "path string, nth long, doc_id long, n_tokens long, ids binary"


def checksum(full: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(full) & 0xFFFFFFFF


class FrameWriter:
    """Appends documents to a binary stream; ``close`` writes the indexes."""

    def __init__(self, out, width: int) -> None:
        import zstandard

        self.out, self.width = out, width
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True).compress
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.n_tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(self.entries), len(ids)))
        self.n_tokens += len(ids)
        for at in range(0, len(ids), FRAME_TOKENS):
            full = ids[at : at + FRAME_TOKENS].astype(f"<u{self.width}").tobytes()
            packed = self.pack(full)
            self.out.write(packed)
            self.entries.append((len(packed), len(full), checksum(full)))

    def close(self) -> None:
        docs = np.array(self.docs, dtype=_DOC).tobytes()
        index = struct.pack("<QI", len(self.docs), self.width) + docs
        entries = np.array(self.entries, dtype=_ENTRY).tobytes()
        footer = struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, SEEK_MAGIC)
        table = struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(footer)) + entries + footer
        # the index ends with its own length, which a reader finds just before the seek table
        index += struct.pack("<Q", len(index) + 16)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index + table)
        self.out.close()


class FrameReader:
    """Random access to the documents of one file by range reads."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        n_frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("not a file of seekable frames with checksums")
        table = size - 9 - n_frames * _ENTRY.itemsize - 8
        self.entries = np.frombuffer(self._at(table + 8, n_frames * _ENTRY.itemsize), _ENTRY)
        (length,) = struct.unpack("<Q", self._at(table - 8, 8))
        index = self._at(table - length, length - 8)
        n_docs, self.width = struct.unpack_from("<QI", index, 8)
        self.docs = np.frombuffer(index, _DOC, n_docs, 20)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def document(self, nth: int) -> np.ndarray:
        """Ids of the ``nth`` document of the file."""
        import zstandard

        doc = self.docs[nth]
        first = int(doc["first_frame"])
        n_frames = -(-int(doc["n_tokens"]) // FRAME_TOKENS)
        raw = self._at(int(self.starts[first]), int(self.starts[first + n_frames] - self.starts[first]))
        parts, at = [], 0
        for entry in self.entries[first : first + n_frames]:
            packed = raw[at : at + int(entry["packed"])]
            full = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(entry["full"]))
            if len(full) != entry["full"] or checksum(full) != entry["checksum"]:
                raise ValueError(f"frame of document {nth} is damaged")
            parts.append(np.frombuffer(full, f"<u{self.width}"))
            at += len(packed)
        return np.concatenate(parts).astype("<u4") if parts else np.empty(0, "<u4")


def encoded(batches: Iterable[pa.RecordBatch], tokenizer: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """``(doc_id, ids with the end id)`` of the rows of Arrow batches, a few texts at a time."""
    words = encoder(tokenizer)
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            # a very long text comes alone
            to = max(at + 1, int(np.searchsorted(sizes, CHARACTERS + (sizes[at - 1] if at else 0), side="right")))
            ids, starts = words.encode(batch["text"].slice(at, to - at), END_ID)
            for n, doc_id in enumerate(batch["doc_id"].slice(at, to - at).to_pylist()):
                yield doc_id, ids[starts[n] : starts[n + 1]]
            at = to
    # a worker that waits for its next task keeps the newer words only
    words.before = {}


def write_frames(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Writes the ids of ``docs`` in ascending ``doc_id`` order; returns the manifest of the files."""
    spark = docs.sparkSession
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = encoded(batches, tokenizer)
        first = next(rows, None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        width = 2 if len(encoder(tokenizer).ends_word) <= 1 << 16 else 4
        # each attempt has a file of its own; the manifest names those of the attempts that count
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.zst"
        fs, path = filesystem(name)
        writer = FrameWriter(fs.open_output_stream(path, compression=None), width)
        for doc_id, ids in itertools.chain([first], rows):
            writer.add(doc_id, ids)
        writer.close()
        yield pa.RecordBatch.from_pylist(
            [{"path": name, "part": part, "n_docs": len(writer.docs), "n_frames": len(writer.entries), "n_tokens": writer.n_tokens}]
        )

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("nth"))
        .repartitionByRange("doc_id", "nth")
        .sortWithinPartitions("doc_id", "nth")
        .select("doc_id", "text")
    )
    return stored(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_frames(manifest: DataFrame) -> DataFrame:
    """All documents of the files of a manifest, each task taking some frames of one file."""
    spans = (
        manifest.where("n_docs > 0")
        .withColumn("from_doc", F.explode(F.expr(f"sequence(0L, n_docs - 1, {READ_FRAMES}L)")))
        .select("path", F.sequence("from_doc", F.least(F.col("from_doc") + READ_FRAMES, "n_docs") - 1).alias("wanted"))
    )
    n = max(1, spans.count())
    return spans.repartition(n).mapInArrow(_read_wanted, READ)


def _read_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of spans (path, numbers of the wanted ones): a file's two indexes and the frames of these alone are fetched."""
    for span in (row for batch in batches for row in batch.to_pylist()):
        fs, path = filesystem(span["path"])
        with fs.open_input_file(path) as file:
            reader = FrameReader(file, file.size())
            rows = []
            for nth in span["wanted"]:
                doc, ids = reader.docs[nth], reader.document(nth)
                doc_id = int(doc["doc_id"]) if doc["known"] else None
                rows.append((span["path"], nth, doc_id, len(ids), ids.tobytes()))
                if len(rows) == TEXTS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "nth", "doc_id", "n_tokens", "ids"]
    )


def document_index(manifest: DataFrame) -> DataFrame:
    """``path, nth, doc_id``: what the files say of themselves; of each file its two indexes are fetched and no frame."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (path for batch in batches for path in batch["path"].to_pylist()):
            fs, path = filesystem(uri)
            with fs.open_input_file(path) as file:
                docs = FrameReader(file, file.size()).docs
            for at in range(0, len(docs), READ_FRAMES):
                some = docs[at : at + READ_FRAMES]
                ids = pa.array(some["doc_id"], pa.int64(), mask=some["known"] == 0)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(some)), pa.array(range(at, at + len(some)), pa.int64()), ids], names=["path", "nth", "doc_id"])

    files = manifest.where("n_docs > 0").select("path")
    return files.repartition(max(1, files.count())).mapInArrow(read, "path string, nth long, doc_id long")


def document_ids(files: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Ids of the requested documents only: ``doc_ids`` has a column ``doc_id``. Only their frames are fetched and unpacked."""
    found = document_index(files).join(doc_ids.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    spans = found.groupBy("path", F.expr(f"nth div {READ_FRAMES}").alias("span")).agg(F.sort_array(F.collect_list("nth")).alias("wanted"))
    return spans.select("path", "wanted").mapInArrow(_read_wanted, READ)


def token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op1: doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_frames(docs, new_path(spark, "tokens"), default_tokenizer())
    # one row for each file: the ids of the files before it
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("path").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    digests = read_frames(manifest).select("path", "nth", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return (
        digests.withColumn("local", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(bases, "path")
        .select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
    )
