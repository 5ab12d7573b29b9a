"""Vectorised word work on Arrow text columns: word bounds, word hashes, k-gram hashes.

Both word rules of this package look at single bytes of UTF-8 only, so a whole
slice of a column is tokenised with a few numpy passes and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
#: Lower-cases A-Z only.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in text whose A-Z are lower-cased.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: Bytes of words [^\x20\x09-\x0D]+.
NON_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))

#: The ALNUM words as a regular expression on lower-cased text.
ALNUM_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Factors by which k-grams of word hashes are hashed; those by one tell nothing about those by the other.
GRAM, OTHER_GRAM = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_SLICE_BYTES = 1 << 19
#: Characters that are hashed at once.
_AT_ONCE = 1 << 15

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive texts: bounds in `data`, and for each text the range of its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of_text: np.ndarray  # n + 1 positions in starts

    def hashes(self, seed: int = 0) -> np.ndarray:
        """One 64-bit hash for each word, equal for equal characters; those of two seeds tell nothing about each other.

        Each character and its place in the word give a number of their own, and those are added up: no arrangement of
        characters makes two words alike but by chance.
        """
        size = self.ends - self.starts
        upto, found, first = np.cumsum(size), np.empty(size.size, np.uint64), 0
        while first < size.size:  # some words at a time, as each character takes a few numbers
            stop = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + _AT_ONCE, "right")))
            own = size[first:stop]
            begin = np.cumsum(own) - own
            place = np.arange(own.sum()) - np.repeat(begin, own)
            sign = self.data[place + np.repeat(self.starts[first:stop], own)]
            rolled = np.zeros(place.size + 1, np.uint64)
            np.cumsum(mix(mix((place.astype(np.uint64) << np.uint64(24)) + sign + np.uint64(1)) + np.uint64(seed)), out=rolled[1:])
            found[first:stop] = rolled[begin + own] - rolled[begin]
            first = stop
        return mix(found + size.astype(np.uint64))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.of_text.size - 1), np.diff(self.of_text))


def gram_hashes(hashes: np.ndarray, of_text: np.ndarray, k: int, by: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-grams of words, and their positions in `hashes`; no k-gram crosses texts."""
    n = hashes.size
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - k + 1, np.uint64)
    factor = 1
    for j in range(k):
        total += hashes[j : n - k + 1 + j] * np.uint64(factor)
        factor = factor * by % (1 << 64)
    ends = np.repeat(of_text[1:], np.diff(of_text))
    at = np.flatnonzero(np.arange(n - k + 1) + k <= ends[: n - k + 1])
    return mix(total[at]), at


def text_slices(texts: pa.Array, limit: int = _SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of row ranges of about `limit` bytes; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if texts.null_count:
        kept = np.where(np.asarray(texts.is_null()), 0, np.diff(offsets))
        if kept.sum() != offsets[-1] - offsets[0]:
            texts = texts.fill_null("")
            yield from text_slices(texts, limit)
            return
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        last = min(last, n)
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Words of lower-cased `data`: maximal runs of bytes that `inside` marks, within one text each."""
    data = LOWER[data]
    if not data.size:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(offsets.size, np.int64))
    mark = np.zeros(data.size + 1, bool)
    mark[:-1] = inside[data]
    first = mark[:-1].copy()
    first[1:] &= ~mark[:-2]
    edges = offsets[:-1][(np.diff(offsets) > 0)]
    first[edges] = mark[edges]
    last = mark[:-1] & ~mark[1:]
    edges = edges[edges > 0] - 1
    last[edges] = mark[edges]
    starts = np.flatnonzero(first)
    return Words(data, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))
