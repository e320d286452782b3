"""Packing of tokenized documents into sequences, online and in bounded space.

Each task reads its documents once. It keeps at most ``open_windows`` windows; a piece goes to the
window that it fits best. Where none fits, the fullest one is emitted, filled up with a cut of the
piece if its gap is worth a cut. Full stretches of long documents become sequences directly. The
windows left at the end of the tasks are few for each task; rounds of tasks merge those of ``fan_in``
tasks at a time, largest first, until one task is left. That one cuts freely: its sequences are full
but for a tail whose parts have powers of two as lengths, which need no padding.

Nulls: a null text is an empty document (its end id alone); a null ``doc_id`` is kept. Repeated rows are
packed as often as they occur. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.token_frames import encoded
from quaymark.llm.tokens import default_tokenizer
from quaymark.sources.shared import stored

SEQUENCE = 4096
OPEN_WINDOWS = 32
#: The least gap that is filled with a cut of a piece; smaller ones stay padding.
LEAST_CUT = 32
FAN_IN = 16
ROWS = 512

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, merge boolean"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("merge", pa.bool_()),
    ]
)


class Packer:
    """Best-fit packing with a bounded number of open windows.

    ``first_id``: the ids of the sequences count up from it. ``rows`` holds what was emitted.
    A piece is ``(doc_id, start, doc_tokens, ids)``.
    """

    def __init__(self, first_id: int, size: int = SEQUENCE, open_windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT) -> None:
        self.next_id, self.size, self.most, self.least_cut = first_id, size, open_windows, least_cut
        self.windows: list[tuple[int, list]] = []
        self.rows: list[tuple] = []

    def add(self, piece: tuple) -> None:
        doc_id, start, total, ids = piece
        while len(ids) >= self.size:
            self._emit([(doc_id, start, total, ids[: self.size])], False)
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            gaps = [self.size - used for used, _ in self.windows]
            fitting = [(gap, i) for i, gap in enumerate(gaps) if gap >= len(ids)]
            if fitting:
                self._put(min(fitting)[1], (doc_id, start, total, ids))
                return
            if len(self.windows) < self.most:
                self.windows.append((len(ids), [(doc_id, start, total, ids)]))
                return
            gap, i = min((gap, i) for i, gap in enumerate(gaps))
            if gap >= self.least_cut:
                self._put(i, (doc_id, start, total, ids[:gap]))
                start, ids = start + gap, ids[gap:]
            else:
                self._emit(self.windows.pop(i)[1], False)

    def _put(self, i: int, piece: tuple) -> None:
        used, pieces = self.windows[i]
        pieces.append(piece)
        self.windows[i] = used + len(piece[3]), pieces
        if self.windows[i][0] == self.size:
            self._emit(self.windows.pop(i)[1], False)

    def _emit(self, pieces: list[tuple], merge: bool) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            self.rows.append((doc_id, start, len(ids), total, self.next_id, offset, ids.tobytes(), merge))
            offset += len(ids)
        self.next_id += 1

    def leave(self) -> None:
        """Emits the open windows for a later merge."""
        for _, pieces in self.windows:
            self._emit(pieces, True)
        self.windows = []

    def finish(self) -> None:
        """Cuts what the open windows hold into full sequences and a tail of powers of two."""
        rest = [piece for _, pieces in self.windows for piece in pieces]
        left, self.windows = sum(len(p[3]) for p in rest), []
        while left:
            size = min(self.size, 1 << (left.bit_length() - 1)) if left < self.size else self.size
            left -= size
            sequence = []
            while size:
                doc_id, start, total, ids = rest.pop(0)
                if len(ids) > size:
                    rest.insert(0, (doc_id, start + size, total, ids[size:]))
                    ids = ids[:size]
                sequence.append((doc_id, start, total, ids))
                size -= len(ids)
            self._emit(sequence, False)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    packer = Packer(TaskContext.get().partitionId() << 32)
    for doc_id, ids in encoded(batches, tokenizer):
        packer.add((doc_id, 0, len(ids), ids))
        if len(packer.rows) >= ROWS:
            yield packer.taken()
    packer.leave()
    yield packer.taken()


def _merge(table: pa.Table, level: int, last: bool) -> pa.Table:
    """One task's share of the open windows, few by construction, largest first."""
    rows = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
    windows: dict[int, list] = {}
    for r in rows:
        piece = (r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4"))
        windows.setdefault(r["sequence_id"], []).append(piece)
    packer = Packer((level << 56) | (rows[0]["to"] << 32))
    for pieces in sorted(windows.values(), key=lambda ps: -sum(len(p[3]) for p in ps)):
        for piece in pieces:
            packer.add(piece)
    if last:
        packer.finish()
    else:
        packer.leave()
    return pa.Table.from_batches([packer.taken()])


def _merging(level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    def merge(table: pa.Table) -> pa.Table:
        return _merge(table, level, last)

    return merge


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of ``docs`` with their ids and places: see ``PIECE``; ids are little-endian unsigned 32-bit."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table, level, done = stored(keyed.mapInArrow(functools.partial(_pack, tokenizer=tokenizer), PIECE), "packed"), 0, []
    sender = F.shiftright("sequence_id", 32).bitwiseAND(F.lit((1 << 24) - 1))
    tasks = (table.where("merge").agg(F.max(sender)).first()[0] or 0) + 1
    while True:
        done.append(table.where("not merge"))
        level, tasks = level + 1, -(-tasks // FAN_IN)
        groups = table.where("merge").withColumn("to", F.floor(sender / FAN_IN).cast("long")).groupBy("to")
        table = stored(groups.applyInArrow(_merging(level, tasks == 1), PIECE), f"packed-{level}")
        if tasks == 1:
            return functools.reduce(DataFrame.union, [*done, table]).drop("merge")


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7: a row for each piece, its checksum derived from the packed ids."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
