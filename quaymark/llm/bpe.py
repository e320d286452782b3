"""Byte-pair encoding cut at forced boundaries, and decoding.

Every token is a run of bytes. A pair of neighbouring bytes that stands inside no token of the vocabulary can't be
merged over, whatever comes before or after it: the boundary between them is certain. A word's bytes are cut
there, the fragments are encoded by the ranked merges, each on its own, and their ids are put one after
the other. A word's last fragment carries the mark of the word's end. Fragments repeat far more
often than words, so a worker keeps those that it has met.

Texts are normalized and cut into words as the vocabulary file says; names of special tokens are cut out
before that, as the library does. Decoding joins the tokens' texts with blanks, as a vocabulary
without a decoder does.

Nulls: a null text is an empty one, without ids; a null ``doc_id`` is kept. Repeated rows are encoded as often as
they occur; long texts and fragments are encoded whole. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.token_frames import CHARACTERS
from quaymark.llm.tokens import TEXTS, WORDS, WordEncoder, default_tokenizer

#: Fragments that a worker keeps, twice at most.
MAX_FRAGMENTS = 400_000
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_LATIN = re.compile("[a-zß-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class ForcedBoundaryEncoder(WordEncoder):
    """Ids of texts, their words cut at forced boundaries and the fragments merged by the library, many in one call."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        letters = byte_letters()
        #: Letters of a word, read as Latin-1, and back.
        self.letters = dict(enumerate(letters))
        self.bytes = {ord(letter): chr(b) for b, letter in enumerate(letters)}
        #: Which bytes stand side by side inside some token.
        self.joined = np.zeros((256, 256), dtype=bool)
        for token in vocabulary:
            inner = token.removesuffix(suffix).translate(self.bytes).encode("latin-1")
            for pair in zip(inner, inner[1:]):
                self.joined[pair] = True
        #: Merges within a word, and at its end.
        self.mergers = {}
        for ends, mark in ((False, {}), (True, {"end_of_word_suffix": suffix})):
            self.mergers[ends] = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, **mark))
            self.mergers[ends].pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        special = self.tokenizer.get_added_tokens_decoder()
        self.special = {token.content: i for i, token in special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if special else None
        #: Ids of fragments met lately and before that, inner ones and last ones.
        self.fragments: dict[bool, dict[bytes, bytes]] = {False: {}, True: {}}
        self.older: dict[bool, dict[bytes, bytes]] = {False: {}, True: {}}
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.texts = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.texts[i] = token.encode()

    # cutting

    def fragments_of(self, words: list[bytes]) -> list[list[bytes]]:
        """Each word cut wherever two bytes meet that no token holds side by side."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cuts = np.flatnonzero(~self.joined[raw[:-1], raw[1:]]) + 1
        first, last = np.searchsorted(cuts, ends - np.diff(ends, prepend=0), "right").tolist(), np.searchsorted(cuts, ends).tolist()
        found = [[w] for w in words]
        for n in np.flatnonzero(np.array(last) > np.array(first)).tolist():
            start = int(ends[n]) - len(words[n])
            at = [0, *(cuts[first[n] : last[n]] - start).tolist(), len(words[n])]
            found[n] = [words[n][a:b] for a, b in zip(at, at[1:])]
        return found

    def _words(self, text: str) -> list[bytes]:
        """The words of a text without special tokens, in bytes."""
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [w.translate(self.bytes).encode("latin-1") for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    # encoding

    def _known(self, pieces: list[str]) -> list[bytes]:
        words, before = self.words, self.before
        ids = [words.get(p) if p in words else before.get(p) for p in pieces]
        missing = [n for n, x in enumerate(ids) if x is None]
        # the words of each new piece, and the ids of special tokens in their places
        parts: list[list[bytes | int]] = []
        for n in missing:
            piece = pieces[n]
            if _LATIN.fullmatch(piece):  # a word as it stands
                parts.append([piece.encode()])
            else:
                cut = self.specials.split(piece) if self.specials else [piece]
                parts.append([w for p in cut for w in ([self.special[p]] if p in self.special else self._words(p))])
        encoded = iter(self._encoded([w for some in parts for w in some if isinstance(w, bytes)]))
        for n, some in zip(missing, parts):
            ids[n] = b"".join([next(encoded) if isinstance(w, bytes) else np.uint32(w).tobytes() for w in some])
        words.update(zip(pieces, ids))
        return ids

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word: those of its fragments, one after the other."""
        cut = self.fragments_of(words)
        known = {
            ends: self._merged([f for fragments in cut for f in (fragments[-1:] if ends else fragments[:-1])], ends) for ends in (False, True)
        }
        inner, last = known[False], known[True]
        return [b"".join([*map(inner.__getitem__, f[:-1]), last[f[-1]]]) if len(f) > 1 else last[f[0]] for f in cut]

    def _merged(self, fragments: list[bytes], ends: bool) -> dict[bytes, bytes]:
        """The ids of each fragment by itself; new ones are merged by the library."""
        kept, older = self.fragments[ends], self.older[ends]
        if len(kept) > MAX_FRAGMENTS:
            self.older[ends], older = kept, kept
            kept = self.fragments[ends] = {}
        known = {f: kept.get(f) or older.get(f) for f in fragments}
        new = [f for f, ids in known.items() if ids is None]
        for at in range(0, len(new), WORDS * TEXTS):
            some = [new[n : n + WORDS] for n in range(at, min(at + WORDS * TEXTS, len(new)), WORDS)]
            lines = [" ".join([f.decode("latin-1").translate(self.letters) for f in s]) for s in some]
            for s, encoding in zip(some, self.mergers[ends].encode_batch(lines, add_special_tokens=False)):
                of = np.array(encoding.word_ids, np.int64)
                raw, cuts = np.array(encoding.ids, "<u4").tobytes(), (4 * np.searchsorted(of, np.arange(len(s) + 1))).tolist()
                known.update((f, raw[a:b]) for f, a, b in zip(s, cuts, cuts[1:]))
        kept.update(known)
        return known

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        ids, starts = self.encode(texts, 0)  # each text's ids end with a 0 that is not its own
        return [ids[a : b - 1] for a, b in zip(starts.tolist(), starts[1:].tolist())]

    def forget(self) -> None:
        """Drops the older halves: a worker that waits for its next task keeps the newer ones only."""
        self.before, self.older = {}, {False: {}, True: {}}

    # decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts with blanks between them, in UTF-8."""
        return b" ".join(map(self.texts.__getitem__, ids.tolist()))


_encoders: dict[str, ForcedBoundaryEncoder] = {}


def encoder(path: str) -> ForcedBoundaryEncoder:
    """The encoder of this process for the vocabulary file at ``path``."""
    if path not in _encoders:
        _encoders[path] = ForcedBoundaryEncoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids (little-endian unsigned 32-bit), decoded``, for each document."""
    return _mapped(docs, tokenizer, "doc_id long, ids binary, decoded string", lambda ids, text: (ids.tobytes(), text.decode()))


def _mapped(docs: DataFrame, tokenizer: str, schema: str, made) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        fields = [pa.field(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))]
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:  # a very long text comes alone
                to = max(at + 1, int(np.searchsorted(sizes, CHARACTERS + (sizes[at - 1] if at else 0), side="right")))
                ids = words.encode_all(batch["text"].slice(at, to - at))
                rows = [made(x, words.decode(x)) for x in ids]
                columns = [batch["doc_id"].slice(at, to - at), *map(list, zip(*rows))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))
                at = to
        words.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op13: the count and digests of each whole text's ids, and of the text that they decode to."""

    def made(ids: np.ndarray, text: bytes) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()

    return _mapped(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), ENCODED, made)
