"""Merkle manifest, prefix trie and byte-pair encoding against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from awkward import TABLES

from quaymark.llm import bpe, merkle, prefix_trie, registry
from quaymark.llm.tokens import default_tokenizer


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """The root, and each leaf's path of (before, after)."""
    paths, places, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for path, place in zip(paths, places):
            run, slot = runs[place // 8], place % 8
            path.append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        places, nodes = [p // 8 for p in places], ["".join(r) and sha("".join(r)) for r in runs]
    return nodes[0], paths


def plain_manifest(rows):
    def leaf(row):
        doc_id, text, lang, source, n_chars = row
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def small(text):
        return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append(row)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    built = {lang: plain_tree([leaf(r) for r in trees[lang]]) for lang in langs}
    root, upper = plain_tree([built[lang][0] for lang in langs])
    out = []
    for lang, above in zip(langs, upper):
        for row, path in zip(trees[lang], built[lang][1]):
            path = path + above
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            fold = leaf((row[0], small(row[1]) if hit else row[1], *row[2:]))
            for before, after in path:
                fold = sha(before + fold + after)
            out.append((row[0], leaf(row), built[lang][0], root, sha("".join(a + b for a, b in path)), fold, fold == root))
    return out


def test_op11_equals_a_plain_tree(spark, edge_dir):
    found = registry.QUERIES["op11_merkle"](spark, edge_dir).collect()
    wanted = plain_manifest(TABLES["documents"][0]())
    assert Counter(map(tuple, found)) == Counter(wanted)
    assert {r.verified for r in found} == {True, False}


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (8, 9), (64, 65), (3, 0, 73), tuple([1] * 20)])
def test_op11_trees_of_all_shapes(spark, sizes):
    rows = [(i * 100 + j, f"Text {j}", f"l{i:02d}", None, 3) for i, n in enumerate(sizes) for j in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = merkle.manifest(docs).select("doc_id", "leaf", "subroot", "root", merkle.folded(merkle.F.col("leaf"), merkle.F.col("path")).alias("again")).collect()
    assert Counter(r[:4] for r in found) == Counter(r[:4] for r in plain_manifest(rows))
    assert all(r.again == r.root for r in found)


def plain_trie(sequences):
    """Nodes of ``conv_id -> [(role, text)]``, prefix by prefix."""
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out, sums = [], {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        below = [sums[c] for c in children[path]]
        sums[path] = leaves, saved = sum(x for x, _ in below) or 1, own + sum(x for _, x in below)
        ends = ",".join(str(c) for c in sorted(members[path]) if len(sequences[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(members[path]), len(path), parent, len(members[path]), len(children[path]), leaves, saved, sha(ends)))
    return out


def plain_rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0), role, sha(f"{len(role.encode())}:{role}{text}"), text))
    turns = {c: [(r[1], r[3]) for r in sorted(t)] for c, t in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def test_op12_equals_a_plain_trie(spark, edge_dir):
    found = registry.QUERIES["op12_prefix_trie"](spark, edge_dir).collect()
    assert Counter(map(tuple, found)) == Counter(plain_trie(plain_rebuilt(TABLES["conversations"][0]())))


@pytest.mark.parametrize("size", [1, 2, 5, 64])
def test_op12_blocks_meet_at_their_boundaries(spark, size):
    rng = random.Random(size)
    words = ["a", "bb", "ccc", "é"]
    sequences = {i: [(rng.choice(["user", ""]), rng.choice(words)) for _ in range(rng.randint(0, 5))] for i in range(150)}
    sequences |= {200 + i: sequences[3] for i in range(40)} | {300 + i: [("user", "x")] * (i + 1) for i in range(8)}
    units = [(c, (0, n), f"{sha(f'{len(r.encode())}:{r}{t}')[:32]}{len(t.encode()):016X}") for c, turns in sequences.items() for n, (r, t) in enumerate(turns)]
    units += [(c, (-1, 0), None) for c in sequences]
    keys = prefix_trie.keys_of(spark.createDataFrame(units, "conv_id long, place struct<own: int, nth: int>, unit string"))
    assert Counter(map(tuple, prefix_trie.trie(keys, size).collect())) == Counter(plain_trie(sequences))


def test_op12_ids_of_many_copies_are_joined_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    members = spark.range(1000).selectExpr("CAST(x'0A' AS BINARY) AS key_digest", "id AS conv_id").repartition(5)
    assert [r.ends_sha256 for r in prefix_trie.ends_of(members).collect()] == [sha(",".join(map(str, range(1000))))]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def test_op13_equals_the_library(spark, edge_dir, library):
    wanted = []
    for doc_id, text, *_ in TABLES["documents"][0]():
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        wanted.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))))
    assert Counter(map(tuple, registry.QUERIES["op13_bpe"](spark, edge_dir).collect())) == Counter(wanted)


def test_op13_odd_texts(library):
    rng = random.Random(1)
    parts = ["a", "é", "É", "İ", "Σ", "ß", "'s", "'LL", "́", " ", "\n", "<|endoftext|>", "<|", "中", "😀", "²", "_", "...", "ﬁ", "\x00", "\x1c", "가", "ing", "zz"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["z" * 3000, "ab" * 3000, "é" * 500, "!" * 400, None, ""]
    words = bpe.encoder(default_tokenizer())
    for text, ids in zip(texts, words.encode_all(pa.array(texts))):
        wanted = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == wanted
        assert words.decode(ids).decode() == library.decode(wanted, skip_special_tokens=False)


def test_op13_cuts_are_where_no_token_spans(library):
    words = bpe.encoder(default_tokenizer())
    letters = bpe.byte_letters()
    tokens = [t.removesuffix("</w>") for t in library.get_vocab(with_added_tokens=False)]
    inside = {t[i : i + 2] for t in tokens for i in range(len(t) - 1)}
    some = ["naïve".encode(), "zebra中文".encode(), b"q", "ßxÿ".encode(), bytes(range(256))]
    for word, fragments in zip(some, words.fragments_of(some)):
        assert b"".join(fragments) == word
        at = 0
        cuts = {at := at + len(f) for f in fragments[:-1]}
        assert cuts == {i for i in range(1, len(word)) if letters[word[i - 1]] + letters[word[i]] not in inside}
