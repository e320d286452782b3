"""Merkle manifest of a table of documents, with a proof for each of them.

A document's leaf is the SHA-256 of its columns, each with its length, so that no two rows run together. The
leaves of a language make a tree, the languages' subroots another one on top. A level is one aggregate: each
run of ``FANOUT`` children is spread into slot columns by conditional aggregates, the columns concatenated and
hashed give the parent, and leaving out a child's own slot gives its siblings. Going down again, each node
takes its parent's path, so that a document's proof comes from one join with its parent.

Leaves are numbered by ranges of (language, id): no language is in one task. All is native Spark; the levels are
written to the shared folder, each an eighth of the one below.

Nulls: a null column counts as ``-``; documents without a language are the tree that comes first; a null ``doc_id``
sorts first and is never tampered with. Rows with the same id are ordered by their leaf; repeated rows are
leaves of their own. An empty text has the length 0. Long texts are hashed whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators.ranges import numbered
from quaymark.sources.shared import stored

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = [f"slot_{i}" for i in range(FANOUT)]


def leaf_hash(values: list[Column]) -> Column:
    """SHA-256 of columns: for each the count of its UTF-8 bytes, a colon and itself; a null is a dash."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def tampered(docs: DataFrame) -> Column:
    """The text in small letters (A-Z only) where 3 divides the CRC-32 of the decimal id."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return F.when(chosen, F.translate("text", CAPITALS, SMALL)).otherwise(F.col("text"))


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels above ``nodes`` (tree, position, group_size, digest), lowest first, and each tree's root (tree, digest).

    A level has a row for each run: tree, group_size (of its children), position, the slots and their digest.
    """
    most = nodes.agg(F.max("group_size")).first()[0] or 0
    roots, levels = [nodes.where("group_size = 1").select("tree", "digest")], []
    while most > 1:
        slot = F.col("position") % FANOUT
        spread = [F.max(F.when(slot == i, F.col("digest"))).alias(name) for i, name in enumerate(SLOTS)]
        runs = nodes.where("group_size > 1").groupBy("tree", "group_size", F.expr(f"position div {FANOUT}").alias("run")).agg(*spread)
        level = stored(runs.select("tree", "group_size", F.col("run").alias("position"), *SLOTS, F.sha2(F.concat_ws("", *SLOTS), 256).alias("digest")), "merkle-level")
        levels.append(level)
        nodes = level.select("tree", "position", F.expr(f"(group_size + {FANOUT - 1}) div {FANOUT}").alias("group_size"), "digest")
        roots.append(nodes.where("group_size = 1").select("tree", "digest"))
        most = -(-most // FANOUT)
    found = roots[0]
    for more in roots[1:]:
        found = found.union(more)
    return levels, found


def _step(position: Column) -> Column:
    """The siblings before and after a child, from its parent's slots."""
    slot = position % FANOUT
    before = F.concat_ws("", *[F.when(slot > i, F.col(f"up_{s}")) for i, s in enumerate(SLOTS)])
    after = F.concat_ws("", *[F.when(slot < i, F.col(f"up_{s}")) for i, s in enumerate(SLOTS)])
    return F.struct(before.alias("before"), after.alias("after"))


def with_paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``nodes`` with their ``path``, an array of (before, after) up to the root, and the other columns of ``tops``.

    ``tops`` has a row for each tree: tree, path (what is above its root) and what its nodes are to know.
    """
    known = [c for c in tops.columns if c not in ("tree", "path")]

    def joined(children: DataFrame, above: DataFrame | None, is_root: str) -> DataFrame:
        """``children`` with paths: roots take their tree's, others their parent's and one step more."""
        heads = children.where(is_root)
        found = heads.join(tops, heads["tree"].eqNullSafe(tops["tree"])).select(*[heads[c] for c in children.columns], "path", *known)
        if above is None:
            return found
        up = above.select(*[F.col(c).alias(f"up_{c}") for c in ("tree", "position", "path", *SLOTS)], *known)
        others = children.where(f"not ({is_root})")
        place = others["tree"].eqNullSafe(up["up_tree"]) & (F.expr(f"position div {FANOUT}") == up["up_position"])
        path = F.concat(F.array(_step(F.col("position"))), "up_path").alias("path")
        return found.unionByName(others.join(up, place).select(*[others[c] for c in children.columns], path, *known))

    above = None
    for level in reversed(levels):
        above = stored(joined(level.drop("digest"), above, f"group_size <= {FANOUT}"), "merkle-paths")
    return joined(nodes, above, "group_size = 1")


def manifest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, path, and ``shown``, the leaf of the tampered row."""
    rows = docs.select(*FIELDS).withColumn("shown_text", tampered(docs))
    same = [F.col(c) for c in FIELDS[:-1]]
    leaves = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").alias("tree"),
        leaf_hash([*same, F.col("text")]).alias("digest"),
        F.when(~F.col("text").eqNullSafe(F.col("shown_text")), leaf_hash([*same, F.col("shown_text")])).alias("shown"),
        F.monotonically_increasing_id().alias("nth"),
    )
    nodes = stored(numbered(leaves, ["tree"], ["doc_id", "digest", "nth"]), "merkle-leaves")
    levels, found = build(nodes)
    subroots = stored(found, "merkle-subroots")
    # the trees of the languages, in order, are the leaves of the tree above them
    heads = stored(
        numbered(subroots.select(F.lit(0).alias("top"), F.col("tree").alias("lang"), "digest"), ["top"], ["lang"]).withColumnRenamed("top", "tree"),
        "merkle-heads",
    )
    upper, root = build(heads)
    empty = F.array().cast("array<struct<before: string, after: string>>")
    tops = with_paths(heads, upper, root.select("tree", empty.alias("path"), F.col("digest").alias("root")))
    tops = stored(tops.select(F.col("lang").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "merkle-tops")
    return with_paths(nodes, levels, tops).select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", F.coalesce("shown", "digest").alias("shown"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op11: every document's leaf, roots and proof, and whether the (tampered) row still leads to the root."""
    found = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), "")
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("shown"), F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB has no CRC-32: its table of 256 values, and the sum over the digits of a number as text.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc32_sql(text: str) -> str:
    """SQL for the CRC-32 of ASCII ``text``; ``crc_table.t`` must be in scope."""
    return (
        f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), "
        "lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295)"
    )


def _field(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


_LEAF = " || ".join(_field(v) for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR"))

ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT *, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN translate(text, '{CAPITALS}', '{SMALL}') ELSE text END AS shown_text
      FROM documents, crc_table),
l AS (SELECT doc_id, lang, sha256({_LEAF} || {_field("text")}) AS leaf, sha256({_LEAF} || {_field("shown_text")}) AS shown FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
lower_nodes AS (
  SELECT lang, 0 AS level, pos, n, leaf AS h FROM p
  UNION ALL
  SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM lower_nodes WHERE n > 1 GROUP BY lang, level, pos // 8, n),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lower_nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1 GROUP BY level, pos // 8, n),
nodes AS (
  SELECT 1 AS part, lang, level, pos, n, h FROM lower_nodes
  UNION ALL SELECT 2, NULL, level, pos, n, h FROM upper_nodes),
siblings AS (
  SELECT a.part, a.lang, a.level, a.pos, a.n,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM nodes a JOIN nodes b ON a.part = b.part AND a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.pos // 8 = b.pos // 8
  WHERE a.n > 1 GROUP BY ALL),
paths AS (
  SELECT row_number() OVER () AS k, p.doc_id, p.leaf, p.lang, s.subroot, s.pos AS lang_pos, p.pos, p.shown FROM p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang),
walk AS (
  SELECT k, 1 AS part, 0 AS level, lang, pos, lang_pos, shown AS h, '' AS proof,
         EXISTS (SELECT 1 FROM p WHERE p.lang IS NOT DISTINCT FROM paths.lang AND p.n > 1) AS inner_levels FROM paths
  UNION ALL
  SELECT w.k, CASE WHEN s.part IS NULL THEN w.part + 1 ELSE w.part END, CASE WHEN s.part IS NULL THEN 0 ELSE w.level + 1 END,
         CASE WHEN s.part IS NULL THEN NULL ELSE w.lang END, CASE WHEN s.part IS NULL THEN w.lang_pos ELSE w.pos // 8 END, w.lang_pos,
         CASE WHEN s.part IS NULL THEN w.h ELSE sha256(s.before || w.h || s.after) END,
         w.proof || coalesce(s.before || s.after, ''), true
  FROM walk w LEFT JOIN siblings s ON s.part = w.part AND s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.pos = w.pos
  WHERE w.part <= 2)
SELECT doc_id, leaf, subroot, (SELECT h FROM upper_nodes WHERE n = 1) AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root,
       w.h = (SELECT h FROM upper_nodes WHERE n = 1) AS verified
FROM paths JOIN walk w USING (k) WHERE w.part = 3
"""
