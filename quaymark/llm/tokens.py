"""Tokenizing whole texts with the ``tokenizers`` library, fast inside long-lived Python workers.

``word_bpe_49k.json`` splits every text at white space before anything else, so the ids of a text
are the ids of its blank-separated pieces, joined. Arrow cuts the texts of a batch into pieces and
numbers the distinct ones; a worker keeps the ids of pieces it has met, the library encodes the new ones, many in
one call, and numpy puts the ids of the pieces in the order of the texts. Pieces are cut further only where the
cut is known to be one of the tokenizer's own: between a Latin-1 letter and an ASCII mark that is no
apostrophe. All else goes to the library as it stands.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps, twice at most, so that memory does not grow with the texts.
MAX_WORDS = 400_000
#: Words that the library encodes in one text, and texts in one call.
WORDS, TEXTS = 500, 64

#: ASCII marks but the apostrophe, which can join the letters that follow it.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = re.compile("[a-zß-öø-ÿ]+")
#: Of each byte: its lower case, blanks for line feeds; and 1 for ASCII letters, 2 for marks, 0 for all else.
_LOWER = np.frombuffer(bytes(range(256)).lower().replace(b"\n", b" "), np.uint8)
_KIND = np.array([1 if chr(b).isalpha() and b < 128 else 2 if b in _MARKS else 0 for b in range(256)], np.uint8)
#: First byte of the letters of Latin-1 in UTF-8, and the second bytes of the two signs among them.
_LATIN_LEAD, _SIGNS = 0xC3, (0x97, 0xB7)

_encoders: dict[str, WordEncoder] = {}


def default_tokenizer() -> str:
    """Path of the tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> WordEncoder:
    """The encoder of this process for the vocabulary file at ``path``."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _pieces(texts: pa.Array) -> pa.ListArray:
    """The pieces of each text: cut at blanks, and between letters and marks; Latin-1 letters in lower case, as
    the tokenizer sees them, so that fewer differ. Texts with names of special tokens are cut at blanks only."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    low, kind = _LOWER[raw], _KIND[raw]
    special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
    lead = np.flatnonzero(raw[:-1] == _LATIN_LEAD)
    second = raw[lead + 1]
    letters = lead[~np.isin(second, _SIGNS)]
    kind[letters] = kind[letters + 1] = 1
    capital = letters[raw[letters + 1] < 0x9F]
    low[capital + 1] += 0x20
    if special.any():
        inside = np.repeat(special, np.diff(offsets))
        low[inside], kind[inside] = np.where(raw[inside] == 10, 32, raw[inside]), 0
    cuts = np.flatnonzero(kind[:-1] + kind[1:] * 4 == 9) + 1, np.flatnonzero(kind[:-1] * 4 + kind[1:] == 9) + 1
    cuts = np.sort(np.concatenate(cuts))
    cut = np.insert(low, cuts, 32)
    offsets = (offsets + np.searchsorted(cuts, offsets)).astype(np.int32)
    lowered = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(cut))
    return pc.split_pattern(lowered, " ")


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids of texts under a BPE vocabulary with word ends, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: For words that need no normalizing and no cuts but at blanks.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends_word[i] = token.endswith("</w>")
        #: Words met lately and before that; the older half goes when the newer one is full.
        self.words: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``end`` after each, and where each text begins; a null text is empty."""
        pieces = _pieces(texts)
        numbered = pieces.flatten().dictionary_encode()
        if len(self.words) > MAX_WORDS:
            self.before, self.words = self.words, {"": b""}
        known = self._known(_strings(numbered.dictionary))
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        at = numbered.indices.to_numpy()
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        ids = flat[np.repeat(starts[at] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        offsets = pieces.offsets.to_numpy()
        offsets = np.concatenate([[0], ends])[offsets - offsets[0]]
        return np.insert(ids, offsets[1:], np.uint32(end)).astype("<u4", copy=False), offsets + np.arange(len(offsets))

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; new ones are learnt."""
        words, before = self.words, self.before
        ids = list(map(words.get, pieces))
        later, missing = [], {}
        for i in [i for i, x in enumerate(ids) if x is None]:
            piece = pieces[i]
            if (known := before.get(piece)) is not None:
                words[piece] = ids[i] = known
            elif _LATIN.fullmatch(piece):
                later.append(i)
                missing[piece] = None
            else:
                words[piece] = ids[i] = self._ids(piece).tobytes()
        self._learn_words(list(missing))
        for i in later:
            ids[i] = words[pieces[i]]
        return ids

    def _learn_words(self, new: list[str]) -> None:
        for at in range(0, len(new), WORDS * TEXTS):
            some = [new[i : i + WORDS] for i in range(at, min(at + WORDS * TEXTS, len(new)), WORDS)]
            encodings = self.plain.encode_batch_fast([" ".join(s) for s in some], add_special_tokens=False)
            for words, encoding in zip(some, encodings):
                ids = np.array(encoding.ids, dtype="<u4")
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) == len(words) and (not len(ids) or ends[-1] == len(ids)):
                    raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                    self.words.update((w, raw[a:b]) for w, a, b in zip(words, cuts, cuts[1:]))
                else:
                    self.words.update((w, self._ids(w).tobytes()) for w in words)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
