"""Fingerprints of texts by the votes of their words, a batch of rows at a time.

A word is hashed once for all rows that a worker meets it in, because a corpus has far fewer words than word places. What is remembered is
emptied at ``KEPT`` words. Words are runs of ASCII letters and digits of the lower-cased text; each distinct one of a text votes once.
A null text has no words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KEPT = 1 << 18
WIDE, VOTES = 1024, 8
#: Words of a text whose bits are counted at a time; about.
AT_ONCE = 1 << 16
_WORD = re.compile("[a-z0-9]+")


class _Places(dict):
    """The row of a table that holds a word's hash; a word that is new is hashed into the next row."""

    def __init__(self, shape: tuple[int, ...], dtype: str, one: Callable[[bytes], object]):
        super().__init__()
        self.table, self.one = np.empty((KEPT, *shape), dtype), one

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.table[place] = self.one(hashlib.md5(word.encode()).digest())
        return place

    def hashes(self, text: str | None) -> np.ndarray:
        """The hashes of a text's distinct words, a row for each."""
        words = set(_WORD.findall(text or ""))
        at = self.places(words, words)
        return self.table[at]

    def places(self, words: Collection[str], distinct: set[str]) -> np.ndarray:
        """The rows of ``table`` that hold the hashes of words; good until the next call."""
        if len(self) + len(distinct) > len(self.table):
            self.clear()
            if len(distinct) > len(self.table):  # one text with more words than are remembered
                self.table = np.empty((len(distinct), *self.table.shape[1:]), self.table.dtype)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _lanes(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    hashes = _Places((), "<u8", lambda digest: int.from_bytes(digest[:8], "big")).hashes
    for batch in texts:
        sizes, votes = [], []
        for text in batch:
            found = hashes(text)
            bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            sizes.append(len(found))
            votes.append(bits[:32] | bits[32:] << 32)
        yield pd.DataFrame({"n": sizes, "votes": votes})


def _passage_bits(length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places = (known := _Places((), "<u8", lambda digest: int.from_bytes(digest[:8], "big"))).places
        for batch in texts:
            made = []
            for text in batch:
                words = _WORD.findall(text or "")
                at = places(words, set(words))
                bits = [np.empty(0, np.int64)]
                # so many words at a time have 64 bytes each
                for i in range(0, len(at), AT_ONCE - AT_ONCE % length):
                    own = at[i : i + AT_ONCE - AT_ONCE % length]
                    nth, place = np.divmod(np.unique(np.arange(len(own)) // length * len(known.table) + own), len(known.table))
                    starts = np.flatnonzero(np.diff(nth, prepend=-1))
                    votes = np.add.reduceat(np.unpackbits(known.table[place].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), starts, axis=0, dtype=np.int64)
                    sizes = np.diff(starts, append=len(nth))
                    bits.append(np.packbits(2 * votes > sizes[:, None], axis=1, bitorder="little").view("<i8").ravel())
                made.append(np.concatenate(bits))
            yield pd.Series(made, dtype=object)

    return fingerprints


def _wide(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def ballots(digest: bytes) -> list[int]:
        thirds = [int(digest.hex()[3 * i : 3 * i + 3], 16) for i in range(VOTES)]
        return [2 * (x & WIDE - 1) + (x >> 10 & 1) for x in thirds]

    hashes = _Places((VOTES,), "int32", ballots).hashes
    for batch in texts:
        made = []
        for text in batch:
            votes = np.bincount(hashes(text).ravel(), minlength=2 * WIDE)
            made.append(np.packbits(votes[0::2] > votes[1::2], bitorder="little").view("<i8"))
        yield pd.Series(made)


def word_votes(text: Column) -> Column:
    """``n, votes``: the number of distinct words, and for each of 64 bits how many have it: a long holds bit i in its lower half, bit i + 32 in its upper one.

    A word's bits are the first eight bytes of its MD5.
    """
    return F.pandas_udf(_lanes, "n long, votes array<long>")(F.lower(text))


def wide_votes(text: Column) -> Column:
    """1,024 bits as 16 longs. Each distinct word votes for or against eight bits that its MD5 picks; a bit is set by a majority."""
    return F.pandas_udf(_wide, "array<long>")(F.lower(text))


def passage_bits(text: Column, length: int) -> Column:
    """The 64-bit fingerprints, as longs, of a text's passages of ``length`` words in order: a bit is set where most of a passage's distinct words have it."""
    return F.pandas_udf(_passage_bits(length), "array<long>")(F.lower(text))
