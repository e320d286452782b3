"""Prefix trie of conversations by union-find over the common prefixes of sorted neighbours.

A conversation is a key: a unit of ``UNIT`` bytes for each turn, the digest of its role and text and the bytes of its
text. Equal keys are one sequence with its members. Sequences are sorted by key; the depth that two neighbours
share is an edge. Within a block of sequences the edges are taken from the deepest to the shallowest and the
components at both ends are united: every union makes a branching node or widens the one that is there already at that depth.
Turns between two branching nodes are nodes with one child.

Blocks are cut anywhere in the order. A block knows how many turns its first and last sequence share with the neighbour
outside; nodes that reach over a boundary are the ones at those depths or less. They are few, as
many as the boundary is deep, and everything below them is contracted into their sums. Counts of members, leaves and
saved tokens add up over blocks, because a turn's first copy is counted in the block where its node
begins and nowhere else; so the forests are merged by one sum for each node that reaches over a boundary,
known by the digest of its path. Its children take its smallest member by a join.

A conversation is a row of 24 bytes for each turn, in one task; texts stay outside. Turns are numbered and sequences sorted by ranges, so that
neither a conversation's turns nor a group of copies is in one task. The ids of a group of copies are joined piece by
piece in order; one task hashes the pieces, because SHA-256 can only go along, without holding them.

Nulls: null turns come first; turns that tie are ordered by role and digest; a null role or text is empty. Rows without a ``conv_id`` belong to
no conversation and are left out. Repeated rows are turns of their own. An empty table has no trie, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.llm.merkle import CRC_TABLE, crc32_sql
from quaymark.operators.ranges import laid_out, numbered
from quaymark.sources.shared import stored

#: Bytes of a turn in a key: 16 of its digest, 8 of the length of its text.
UNIT = 24
#: Sequences of a block, which one task holds.
BLOCK = 16_384
#: Ids that are joined in one piece.
IDS = 4096
NODE = "node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()

_SIZE = np.dtype([("digest", "V16"), ("bytes", ">i8")])


def turn_units(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, unit`` (hex): what a turn adds to a key."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the length of the role keeps role and text apart
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    unit = F.concat(digest, F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), unit.alias("unit"))


def keys_of(units: DataFrame) -> DataFrame:
    """``conv_id, key`` of conversations from ``conv_id, place, unit``; a null unit is no turn."""
    ordered = F.sort_array(F.collect_list(F.struct("place", "unit")))
    hexes = F.array_join(F.transform(ordered, lambda x: F.coalesce(x["unit"], F.lit(""))), "")
    return units.groupBy("conv_id").agg(F.unhex(hexes).alias("key"))


def ends_of(members: DataFrame) -> DataFrame:
    """``key_digest, ends_sha256`` of groups of copies (``key_digest, conv_id``): the hash of their ids in order, with commas."""
    in_order = members.repartitionByRange("key_digest", "conv_id").sortWithinPartitions("key_digest", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids = None, None, []
        names = ["key_digest", "first", "ids"]
        for batch in batches:
            rows = []
            for digest, conv_id in zip(batch["key_digest"].to_pylist(), batch["conv_id"].to_pylist()):
                if digest != key or len(ids) == IDS:
                    if ids:
                        rows.append((key, first, ",".join(ids)))
                    key, first, ids = digest, conv_id, []
                ids.append(str(conv_id))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([first]), pa.array([",".join(ids)])], names=names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        names = ["key_digest", "ends_sha256"]
        for batch in batches:
            rows = []
            for this, ids in zip(batch["key_digest"].to_pylist(), batch["ids"].to_pylist()):
                if this == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        rows.append((key, digest.hexdigest()))
                    key, digest = this, hashlib.sha256()
                digest.update(ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=names)

    parts = in_order.mapInArrow(pieces, "key_digest binary, first long, ids string")
    return parts.repartition("key_digest").sortWithinPartitions("key_digest", "first").mapInArrow(hashed, "key_digest binary, ends_sha256 string")


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two keys begin with alike."""
    n = min(len(a), len(b)) // UNIT * UNIT
    if a[:n] == b[:n]:
        return n // UNIT
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // UNIT


class Forest:
    """The trie of one block of sorted, distinct keys."""

    def __init__(self, keys: list[bytes], before: int, after: int) -> None:
        """``before``, ``after``: turns that the first and last key share with the neighbour outside, -1 without one."""
        m = len(keys)
        self.lengths = np.array([len(k) // UNIT for k in keys], np.int64)
        edges = np.array([shared_turns(a, b) for a, b in zip(keys, keys[1:])], np.int64)
        self.left, self.right = list(range(m)), list(range(m))
        self.depth, self.parent, self.n_children = self.lengths.tolist(), [-1] * m, [0] * m
        # the component of a sequence: its two ends know its top node, like a union-find over neighbours
        top = list(range(m))
        for at in np.argsort(-edges, kind="stable").tolist():
            a, b, depth = top[at], top[at + 1], int(edges[at])
            if self.depth[a] == depth:
                node = a
            else:
                node = self._node(depth, a)
            self.parent[b] = node
            self.n_children[node] += 1
            self.right[node] = self.right[b]
            top[self.left[node]] = top[self.right[node]] = node
        whole = top[0]
        if self.depth[whole]:
            whole = self._node(0, whole)
        #: A sequence is a leaf unless the next one goes on from it.
        self.leaf = np.append(edges, after) < self.lengths

    def _node(self, depth: int, child: int) -> int:
        node = len(self.depth)
        self.depth.append(depth)
        self.parent.append(-1)
        self.n_children.append(1)
        self.left.append(self.left[child])
        self.right.append(self.right[child])
        self.parent[child] = node
        return node


def block_nodes(keys: list[bytes], n: np.ndarray, least: np.ndarray, ends: list[str], before: int, after: int) -> dict[str, list]:
    """``NODE`` columns of a block; those of nodes that reach over a boundary are the block's part, with ``node`` set."""
    m, forest = len(keys), Forest(keys, before, after)
    left, right, depth = np.array(forest.left), np.array(forest.right), np.array(forest.depth, np.int64)
    parent, n_children = np.array(forest.parent), np.array(forest.n_children, np.int64)
    members = np.concatenate([[0], np.cumsum(n)])
    leaves = np.concatenate([[0], np.cumsum(forest.leaf)])
    n_convs, n_leaves = members[right + 1] - members[left], leaves[right + 1] - leaves[left]
    # bytes of the turns of each key up to each depth, one key after the other
    sizes = np.frombuffer(b"".join(keys), _SIZE)["bytes"].astype(np.int64)
    ends_at = np.cumsum(forest.lengths)
    start = ends_at - forest.lengths
    total = np.concatenate([[0], np.cumsum(sizes)])

    def bytes_between(sequence: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of the turns after ``low`` up to ``high``."""
        return total[start[sequence] + high] - total[start[sequence] + low]

    def saved(node: np.ndarray, low: np.ndarray) -> np.ndarray:
        """What the turns after ``low`` on the way to each node save; a turn is kept once, in the block where its node begins."""
        kept_from = np.where(left[node] == 0, np.clip(before, low, depth[node]), low)
        return n_convs[node] * bytes_between(left[node], low, depth[node]) - bytes_between(left[node], kept_from, depth[node])

    above = np.where(parent >= 0, depth[parent], -1)
    low = np.maximum(above, 0)
    own = saved(np.arange(len(depth)), low)
    smallest = least.tolist() + [None] * (len(depth) - m)
    below = [0] * len(depth)
    order = np.lexsort((np.arange(len(depth)), -depth)).tolist()  # children before their parents
    parents, own_list = parent.tolist(), own.tolist()
    for v in order:
        if (p := parents[v]) >= 0:
            below[p] += below[v] + own_list[v]
            if smallest[p] is None or smallest[v] < smallest[p]:
                smallest[p] = smallest[v]
    smallest, below = np.array(smallest, np.int64), np.array(below, np.int64)

    # a row for each depth between a node and its parent
    rows = np.repeat(np.arange(len(depth)), depth - above)
    first = np.cumsum(depth - above) - (depth - above)
    at = np.arange(len(rows)) - np.repeat(first, depth - above) + above[rows] + 1
    is_end = at == depth[rows]
    opens_left, opens_right = (left[rows] == 0) & (at <= before), (right[rows] == m - 1) & (at <= after)
    children = np.where(is_end, n_children[rows], 1) - ((left[rows] == 0) & (at < before) & (at <= depth[rows]))
    sequence_ends = is_end & (forest.lengths[left[rows]] == depth[rows])
    up = np.where(at - 1 > above[rows], rows, parent[rows])
    up_open = (at > 0) & (((left[up] == 0) & (at - 1 <= before)) | ((right[up] == m - 1) & (at - 1 <= after)))

    def paths(key: bytes, depths: int) -> list[bytes]:
        digest, found = hashlib.sha256(), []
        for d in range(depths + 1):
            found.append(digest.digest() + d.to_bytes(8, "big"))
            digest.update(key[d * UNIT : (d + 1) * UNIT])
        return found

    of_first, of_last = paths(keys[0], before), paths(keys[-1], after)

    def path(is_open: np.ndarray, at_left: np.ndarray, depths: np.ndarray) -> list[bytes | None]:
        found: list[bytes | None] = [None] * len(rows)
        for k in np.flatnonzero(is_open).tolist():
            found[k] = (of_first if at_left[k] else of_last)[depths[k]]
        return found

    node = path(opens_left | opens_right, opens_left, at)
    over = path(up_open, (left[up] == 0) & (at - 1 <= before), at - 1)
    known = ~up_open & (at > 0)
    return {
        "node": node,
        "parent": over,
        "conv_id": smallest[rows],
        "depth": at,
        "parent_conv_id": [int(x) if k else None for x, k in zip(smallest[up], known)],
        "n_convs": n_convs[rows],
        "n_children": children,
        "n_leaves": n_leaves[rows],
        "saved_tokens": below[rows] + saved(rows, np.maximum(at - 1, 0)),
        "ends_sha256": [ends[s] if e else None for s, e in zip(left[rows].tolist(), sequence_ends.tolist())],
    }


def trie(keys: DataFrame, size: int = BLOCK) -> DataFrame:
    """The nodes of the trie of ``conv_id, key``; ``size``: sequences of a block."""
    members = stored(keys.withColumn("key_digest", F.unhex(F.sha2("key", 256))), "trie-keys")
    groups = members.groupBy("key_digest").agg(F.first("key").alias("key"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    groups = stored(groups, "trie-sequences")
    copies = groups.where("n > 1").select("key_digest")
    ends = stored(ends_of(members.join(copies, "key_digest", "left_semi").select("key_digest", "conv_id")), "trie-ends")
    alone = F.sha2(F.col("least").cast("string"), 256)
    sequences = groups.join(ends, "key_digest", "left").select("key", "n", "least", F.coalesce("ends_sha256", alone).alias("ends"))
    # the upper bits of _at are the part; a part's rows are cut into blocks
    laid = laid_out(sequences, [], ["key"], "trie-sorted")
    part_of, row_of = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    blocks = laid.withColumn("block", F.shiftleft(part_of, 33) + F.floor(row_of / size))
    limits = blocks.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    # a row for each block, in order; its neighbours' keys are two of its columns
    in_order = Window.orderBy("block")
    limits = limits.select("block", "first", "last", F.lag("last").over(in_order).alias("previous"), F.lead("first").over(in_order).alias("next"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            before = [-1 if r["previous"] is None else shared_turns(r["previous"], r["first"]) for r in rows]
            after = [-1 if r["next"] is None else shared_turns(r["last"], r["next"]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch["block"], pa.array(before, pa.int64()), pa.array(after, pa.int64())], names=["block", "before", "after"])

    shared = stored(limits.mapInArrow(compared, "block long, before long, after long"), "trie-limits")

    def made(block: pa.Table) -> pa.Table:
        block = block.sort_by("_at")
        found = block_nodes(
            block["key"].to_pylist(), block["n"].to_numpy(), block["least"].to_numpy(), block["ends"].to_pylist(), block["before"][0].as_py(), block["after"][0].as_py()
        )
        kinds = {"node": pa.binary(), "parent": pa.binary(), "ends_sha256": pa.string()}
        return pa.table({name: pa.array(values, kinds.get(name, pa.int64())) for name, values in found.items()})

    parts = stored(blocks.join(shared, "block").groupBy("block").applyInArrow(made, NODE), "trie-parts")
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    merged = parts.where("node is not null").groupBy("node", "depth").agg(
        F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums], F.max("ends_sha256").alias("ends_sha256")
    )
    merged = stored(merged, "trie-merged")
    nodes = parts.where("node is null").unionByName(merged.withColumn("parent_conv_id", F.lit(None).cast("long")))
    known = merged.select(F.col("node").alias("up"), F.col("conv_id").alias("up_conv_id"))
    found = nodes.join(known, nodes["parent"] == known["up"], "left")
    parent, ends_sha256 = F.coalesce("up_conv_id", "parent_conv_id"), F.coalesce("ends_sha256", F.lit(NO_ENDS))
    return found.select("conv_id", "depth", parent.alias("parent_conv_id"), *sums, ends_sha256.alias("ends_sha256"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, key`` of every conversation c: the first h turns of c - c % 5, then its own after its first h; h = crc32(c) % 9."""
    h = F.crc32(F.col("conv_id").cast("string")) % 9
    placed = stored(numbered(turn_units(turns), ["conv_id"], ["turn", "role", "unit"]).select("conv_id", (F.col("position") + 1).alias("nth"), "unit"), "trie-turns")
    convs = placed.where("nth = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    heads = placed.where("nth <= 8").select(F.col("conv_id").alias("base"), "nth", "unit")
    taken = convs.join(heads, "base").where("nth <= h").select("conv_id", F.struct(F.lit(0).alias("own"), F.col("nth")).alias("place"), "unit")
    own = placed.where(F.col("nth") > h).select("conv_id", F.struct(F.lit(1).alias("own"), F.col("nth")).alias("place"), "unit")
    # a conversation without turns has a key too
    every = convs.select("conv_id", F.struct(F.lit(-1).alias("own"), F.lit(0).cast("long").alias("nth")).alias("place"), F.lit(None).cast("string").alias("unit"))
    return keys_of(taken.unionByName(own).unionByName(every))


def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op12: every node of the prefix trie of the rebuilt conversations."""
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = f"""
WITH {CRC_TABLE},
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                                sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS nth
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 9 AS h, conv_id - conv_id % 5 AS base
      FROM (SELECT DISTINCT conv_id FROM o), crc_table),
r AS (SELECT c.conv_id, 0 AS own, o.nth, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.nth <= c.h
      UNION ALL SELECT c.conv_id, 1, o.nth, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.nth > c.h),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, nth) AS depth, role, text FROM r),
p AS (SELECT conv_id, 0 AS depth, '' AS path, NULL AS up, 0 AS bytes FROM c
      UNION ALL
      SELECT conv_id, depth, string_agg(sha256(strlen(role)::VARCHAR || ':' || role || text), '') OVER w,
             coalesce(string_agg(sha256(strlen(role)::VARCHAR || ':' || role || text), '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), strlen(text)
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (SELECT path, depth, any_value(up) AS up, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY path, depth),
k AS (SELECT up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
below AS (SELECT DISTINCT a.path, b.path AS deeper FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
s AS (SELECT below.path, count(*) FILTER (k.up IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
      FROM below JOIN n ON n.path = below.deeper LEFT JOIN k ON k.up = below.deeper GROUP BY below.path),
e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
      FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN n u ON u.path = n.up LEFT JOIN k ON k.up = n.path LEFT JOIN e ON e.path = n.path JOIN s ON s.path = n.path
"""
