"""Exact token counts at every prefix of a text, by dynamic programming.

A byte-level BPE vocabulary encodes each word-like part of a text on its own. Inside a
part the counts of all prefixes follow from left to right, one step each: the encoding of
a prefix ends in exactly one token whose bytes are a suffix of the prefix and which may
follow the last token of the rest. The count at the end of a part is the count at the end
of the one before and the part's own. The table over part ends is what is stored; a
prefix that ends inside a part takes the step-by-step counts of that part alone. So
questions of truncation and budget are answered without encoding a text again.

The places of the special token's own text are that one token, as in the library.

Defined results: a null or empty text has no tokens; repeated rows each give a row; equal
parts are counted once and very long ones in steps of one token's length each; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlist.llm.words import Words, text_slices

LIMIT = 512
#: Fixed value: the special token of the vocabulary.
SPECIAL = "<|endoftext|>"
_CACHE = 200_000
_PAIRS = 400_000
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    found = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            found[c] = _LETTER if kind == "L" else _NUMBER
        elif kind == "Z" or c in (0x85, *range(0x09, 0x0E)):
            found[c] = _SPACE
    return found


def split_parts(points: np.ndarray, offsets: np.ndarray) -> Words:
    """The parts of texts given as code points: contractions, runs of one class with a space before, white space."""
    n = points.size
    kind = _classes()[points]
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | head[1:n]
    start = change.copy()
    last = np.ones(n, bool)  # of its run
    last[:-1] = change[1:]
    space = kind == _SPACE
    at_end = np.zeros(n, bool)
    at_end[offsets[1:][offsets[1:] > 0] - 1] = True
    # The last character of white space before something else stands alone, or, if it's a blank, goes with what follows.
    alone = np.flatnonzero(space & last & ~at_end)
    start[alone] = True
    blank = alone[points[alone] == 0x20]
    start[blank + 1] = False
    # An apostrophe that begins a part takes one of seven endings along.
    mark = np.flatnonzero((points == 0x27) & start & last & ~at_end)
    if mark.size:
        padded = np.concatenate([points, [0, 0]])
        run_end = np.concatenate([np.flatnonzero(change), [n]])
        stop = run_end[np.searchsorted(run_end, mark + 1, "right")]  # of the run after the mark
        a, b = padded[mark + 1], padded[mark + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (stop >= mark + 3) & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        for size, which in ((1, mark[one]), (2, mark[two & ~one])):
            start[which + 1] = False
            rest = which + 1 + size
            rest = rest[rest < n]
            start[rest] = True
            follow = rest[space[rest] & ~last[rest]]  # white space of several characters begins a part as before
            start[follow] = True
    starts = np.flatnonzero(start)
    return Words(points, starts, np.concatenate([starts[1:], [n]]), np.searchsorted(starts, offsets))


@dataclass
class Vocabulary:
    """ids: each token's bytes to its id; suffixes: each proper suffix of a token that is none itself to -1."""

    ids: dict[bytes, int]
    suffixes: dict[bytes, int]
    library: object
    pairs: dict[tuple[int, int], bool]
    surface: list[bytes]

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            known = self.library.encode_single_piece(self.surface[a] + self.surface[b]) == [a, b]
            self.pairs[a, b] = known
        return known

    def prefix_counts(self, part: bytes) -> list[int]:
        """The number of tokens of each of the part's prefixes, from the empty one on."""
        counts, last, get, pairs = [0], [-1], self.suffixes.get, self.pairs
        for i in range(1, len(part) + 1):
            ends = []
            j = i - 1
            while j >= 0:
                token = get(part[j:i])
                if token is None:
                    break
                if token >= 0:
                    ends.append((token, j))
                j -= 1
            for token, j in reversed(ends):
                known = True if j == 0 else pairs.get((last[j], token))
                if self.follows(last[j], token) if known is None else known:
                    counts.append(counts[j] + 1)
                    last.append(token)
                    break
        return counts


@lru_cache(maxsize=1)
def load_vocabulary(path: str) -> Vocabulary:
    """From a file of base64 tokens and ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    suffixes = dict(ids)
    for token in ids:
        for i in range(1, len(token)):
            suffixes.setdefault(token[i:], -1)
    surface = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        surface[i] = token
    library = tiktoken.Encoding("prefix", pat_str=r"(?s).+", mergeable_ranks=ids, special_tokens={})
    return Vocabulary(ids, suffixes, library._core_bpe, {}, surface)


class PartCounts:
    """Token counts of parts, by part hash; holds those met lately, the oldest half goes first."""

    def __init__(self, vocabulary: Vocabulary, size: int = _CACHE) -> None:
        self.vocabulary, self.size = vocabulary, size
        self.new: dict[int, int] = {}
        self.old: dict[int, int] = {}

    def of(self, parts: Words) -> np.ndarray:
        hashes, first, inverse = np.unique(parts.hashes(), return_index=True, return_inverse=True)
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        new, old, ids = self.new, self.old, self.vocabulary.ids
        counts = []
        for h, s, e in zip(hashes.tolist(), parts.starts[first].tolist(), parts.ends[first].tolist(), strict=True):
            n = new.get(h)
            if n is None:
                n = old.get(h)
                if n is None:
                    part = parts.data[s:e].tobytes().decode("utf-32-le").encode()
                    n = 1 if part in ids else self.vocabulary.prefix_counts(part)[-1]
                new[h] = n
            counts.append(n)
        return np.array(counts, np.int64)[inverse]


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 texts as code points and their offsets."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, before[offsets]


def count_texts(data: np.ndarray, offsets: np.ndarray, counter: PartCounts) -> tuple[Words, np.ndarray]:
    """The parts of each text and the tokens of each part."""
    points, cuts = _points(data, offsets)
    special = np.array([ord(c) for c in SPECIAL], np.uint32)
    found = np.flatnonzero(points[: max(0, points.size - special.size + 1)] == special[0])
    found = np.array([i for i in found.tolist() if np.array_equal(points[i : i + special.size], special) and np.searchsorted(cuts, i, "right") == np.searchsorted(cuts, i + special.size - 1, "right")], np.int64)
    if not found.size:
        parts = split_parts(points, cuts)
        return parts, counter.of(parts)
    # Specials are texts of their own for the split, then parts of one token.
    edges = np.unique(np.concatenate([cuts, found, found + special.size]))
    parts = split_parts(points, edges)
    inside = np.zeros(points.size + 1, np.int64)
    inside[found] += 1
    inside[found + special.size] -= 1
    inside = np.cumsum(inside)[:-1].astype(bool)
    keep = ~inside[parts.starts] | np.isin(parts.starts, found)
    starts = parts.starts[keep]
    parts = Words(points, starts, np.concatenate([starts[1:], [points.size]]), np.searchsorted(starts, cuts))
    counts = counter.of(parts)
    counts[np.isin(parts.starts, found)] = 1
    return parts, counts


def prefix_count(text: str, length: int, ends: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> int:
    """Tokens of the first `length` characters; `ends`, `counts`: where the text's parts end and the tokens up to there."""
    i = int(np.searchsorted(ends, length, "left"))
    if i < len(ends) and ends[i] == length and (length == len(text) or not text[length - 1].isspace()) or length == 0:
        return int(counts[i]) if length else 0
    # The cut part splits anew; white space at the cut belongs to the run it is in.
    while i > 0 and text[int(ends[i - 1]) : length].isspace() and text[int(ends[i - 1]) - 1].isspace():
        i -= 1
    begin, before = (int(ends[i - 1]), int(counts[i - 1])) if i else (0, 0)
    data = np.frombuffer(text[begin:length].encode(), np.uint8)
    points, cuts = _points(data, np.array([0, data.size]))
    rest = split_parts(points, cuts)
    return before + sum(vocabulary.prefix_counts(points[s:e].tobytes().decode("utf-32-le").encode())[-1] for s, e in zip(rest.starts, rest.ends, strict=True))


def token_counts(docs: DataFrame, path: str, prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row; with `prefixes` also `ends` and `counts`: the parts' ends in code points and the tokens up to each."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("ends", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
    arrow = pa.schema(fields if prefixes else fields[:3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PartCounts(load_vocabulary(path))
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1), 2 << 20):
                parts, counts = count_texts(data, offsets, counter)
                total = np.concatenate([[0], np.cumsum(counts)])
                cuts = parts.of_text
                columns = [batch.column(0).slice(first, last - first), pa.array(np.diff(offsets)), pa.array(total[cuts[1:]] - total[cuts[:-1]])]
                if prefixes:
                    text, begin = parts.text_of_word(), _points(data, offsets)[1]
                    lists = pa.array(cuts, pa.int32())
                    columns += [pa.ListArray.from_arrays(lists, pa.array(parts.ends - begin[text])), pa.ListArray.from_arrays(lists, pa.array(total[1:] - total[cuts[:-1]][text]))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    schema = "doc_id long, n_bytes long, n_tokens long" + ", ends array<long>, counts array<long>" * prefixes
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def longest_prefix(text: str, budget: int, ends: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> int:
    """The most characters of a text that have at most `budget` tokens; `ends`, `counts` as in prefix_count().

    Cut inside a part, a text has the part's own prefix counts, from one table; only cuts in white space, contractions and
    special tokens split anew.
    """
    if not len(counts) or counts[-1] <= budget:
        return len(text)
    over = int(np.searchsorted(counts, budget, "right"))  # the first part that ends beyond
    # White space counts as one part where a text ends in it, so a cut in the part after may still do.
    for i in range(min(over + 1, len(ends) - 1), -1, -1):
        begin, before = (int(ends[i - 1]), int(counts[i - 1])) if i else (0, 0)
        part = text[begin : int(ends[i])]
        body = part[1:] if part[:1] == " " else part
        if len(body) > 1 and not any(c.isspace() for c in body) and body[0] != "'" and SPECIAL[:2] not in text[max(0, begin - len(SPECIAL)) : int(ends[i])]:
            table = vocabulary.prefix_counts(part.encode())
            stops = np.cumsum([len(c.encode()) for c in part]).tolist()
            fits = [n for n, stop in enumerate(stops[:-1], 1) if before + table[stop] <= budget and n > len(part) - len(body)]
            if fits:
                return begin + fits[-1]
            tried = range(begin + len(part) - len(body), begin, -1)
        else:
            tried = range(int(ends[i]) - 1, begin, -1)
        for length in (*tried, *([begin] if i == 0 or prefix_count(text, begin, ends, counts, vocabulary) <= budget else [])):
            if length == 0 or prefix_count(text, length, ends, counts, vocabulary) <= budget:
                return length
    return 0


def within_budget(docs: DataFrame, path: str, budget: int = LIMIT) -> DataFrame:
    """doc_id, n_tokens and `prefix_end`: how many of the text's first characters have at most `budget` tokens, to the character."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("prefix_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(path)
        counter = PartCounts(vocabulary)
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1), 2 << 20):
                parts, counts = count_texts(data, offsets, counter)
                begin, cuts, texts = _points(data, offsets)[1], parts.of_text, batch.column(1).slice(first, last - first).to_pylist()
                total, kept = [], []
                for k, (s, e) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
                    own = np.cumsum(counts[s:e])
                    total.append(int(own[-1]) if e > s else 0)
                    kept.append(longest_prefix(texts[k] or "", budget, parts.ends[s:e] - begin[k], own, vocabulary))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(total, pa.int64()), pa.array(kept, pa.int64())], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, prefix_end long")
