"""Alignment of two tokenizers' tokens over the same texts, and how often ids meet.

Both tokenizers cut the bytes of a text, a space before it. Offsets at which tokens of
both end cut the tokens into groups; two tokens link if they share a group. Most texts are
long stretches in which each token of one is a token of the other. Diagonal run skipping
jumps them: at the current shift between the two lists of token ends, slices of doubling
length are compared, and the first place that differs is found by halving. There the
irregular group is walked token by token up to the next common end, which gives the shift
from which the next run is probed.

A single blank between two characters that are no white space begins a token of either
tokenizer, whatever else the text holds. So stretches between such blanks are encoded and
aligned one after the other in long lists, each distinct one once, and remembered for a
while by their text; a document is put together from its stretches.

Each document's distinct id pairs and their links are written once, column by column.
Counting the documents of each pair is a grouping with partial sums. The counts of a
document's links are then looked up: those of the FREQUENT most frequent pairs, which most
links are, in the task, the others by a join on the pair, of which none is hot any more.
The largest count of each id is bounded by the vocabulary.

Defined results: a null or empty text, and one that either tokenizer doesn't give back
byte for byte (U+2581 reads as a space), has no tokens and no groups; repeated rows are
documents each; equal counts all are an id's best; very long texts are aligned whole, and
of a large group the products of its ids' numbers are taken, not each link by itself; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlist.llm.common import written
from setlist.llm.lattice import SPACE

#: Id pairs whose counts tasks hold (16 bytes each); the others are joined.
FREQUENT = 1 << 18
#: Bytes of text put together at once, and documents at most.
_SLICE, _ROWS = 1 << 19, 1 << 12
#: Stretches, and tokens of them, that are remembered.
_STRETCHES, _TOKENS = 150_000, 2_000_000
#: Stretches that are encoded in one go.
_TOGETHER = 500
#: A pair is the first id times 2^20 and the second.
_SHIFT = 20
_BLANK = re.compile(r" (?<=\S )(?=\S)")


@dataclass
class Tokenizers:
    """Both tokenizers and the bytes of each of their tokens."""

    byte_level: object
    pieces: object
    surface: tuple[list[bytes], list[bytes]]
    sizes: tuple[np.ndarray, np.ndarray]
    decimal: list[bytes]
    whole: bool  # whether texts can't be cut at blanks

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a text with a space before, by either."""
        return self.byte_level.encode_ordinary(" " + text), self.pieces.encode(text, num_threads=1)

    def encode_each(self, texts: list[str], rough: list[str] = ()) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """By either tokenizer the ids of stretches one after the other, and n + 1 positions where they end; whether each is given back byte for byte: others have no ids.

        texts: stretches without white space at their ends, encoded together with a blank between them; rough: others, after those.
        """
        step = 1 if self.whole else _TOGETHER
        runs = [texts[k : k + step] for k in range(0, len(texts), step)] + [[t] for t in rough]
        ids, counts, good = ([], []), ([], []), []
        while runs:
            run = runs.pop(0)
            text = " ".join(run)
            own, data = self.encode(text), (" " + text).encode()
            if all(b"".join(map(surface.__getitem__, x)) == data for x, surface in zip(own, self.surface, strict=True)):
                stops = np.cumsum(np.array(list(map(len, map(str.encode, run))), np.int64) + 1)
                for side in (0, 1):
                    x = np.array(own[side], np.int64)
                    ids[side].append(x)
                    counts[side].append(np.diff(np.searchsorted(np.cumsum(self.sizes[side][x]), stops, "right"), prepend=0))
                good += [True] * len(run)
            elif len(run) > 1:
                runs[:0] = [[t] for t in run]
            else:
                good.append(False)
                for side in (0, 1):
                    counts[side].append(np.zeros(1, np.int64))
        none = np.zeros(0, np.int64)
        return [np.concatenate([none, *x]) for x in ids], [_ends(np.concatenate([none, *x])) for x in counts], np.array(good, bool)


@lru_cache(maxsize=1)
def load_tokenizers(ranks_path: str, pattern: str, model_path: str) -> Tokenizers:
    """From a file of base64 tokens and ranks with the pattern of its parts, and a SentencePiece model."""
    import sentencepiece
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    byte_level = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=model_path)
    first = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        first[rank] = token
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    second = [bytes([int(n[3:5], 16)]) if pieces.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
    if max(len(first), len(second)) > 1 << _SHIFT:
        raise ValueError(f"ids have {_SHIFT} bits")
    decimal = [b"%d%c" % (i, sign) for i in range(max(len(first), len(second))) for sign in b",|;"]
    sizes = tuple(np.array(list(map(len, x)), np.int64) for x in (first, second))
    return Tokenizers(byte_level, pieces, (first, second), sizes, decimal, any(SPACE in n.lstrip(SPACE) for n in names))


def align(a: list[int], b: list[int]) -> np.ndarray:
    """From two lists of token ends with the same last one the groups that are not of one token each: (begin, end in a, begin, end in b)."""
    irregular: list[tuple[int, int, int, int]] = []
    i, shift, n = 0, 0, len(a)
    while i < n:
        step = 1
        while i < n and a[i : i + step] == b[i + shift : i + shift + step]:
            i += step
            step <<= 1
        if i >= n:
            break
        while step := step >> 1:
            if a[i : i + step] == b[i + shift : i + shift + step]:
                i += step
        begin, j = i, i + shift
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i += 1
        irregular.append((begin, i, begin + shift, j + 1))
        shift = j + 1 - i
    return np.array(irregular, np.int64).reshape(-1, 4)


def _ends(sizes: np.ndarray) -> np.ndarray:
    """n + 1 positions from the sizes of n things."""
    return np.concatenate([[0], np.cumsum(sizes)])


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of each of several ranges, one range after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


class Stretches:
    """What stretches of text have: tokens, groups and links. Numbered from 0 as they come.

    The first ones that come, among which the frequent ones are, are remembered; once there are enough, later ones are
    known for one slice of text each.
    sizes: tokens of either side, groups, links and distinct pairs of each stretch; bad: not given back byte for byte.
    """

    def __init__(self, tokenizers: Tokenizers, lists: bool = False) -> None:
        self.tokenizers, self.lists = tokenizers, lists
        self.number: dict[str, int] = {}
        self.names: list[bytes] = []
        self.sizes, self.bad = np.zeros((5, 0), np.int64), np.zeros(0, bool)
        self.pairs = self.links = np.zeros(0, np.int64)
        self.ids = [np.zeros(0, np.int64)] * 2
        self.members = [np.zeros(0, np.int64)] * 2
        self.passing: list[str] = []

    def forget(self) -> None:
        """Drops the stretches of the last slice if there are enough others."""
        if len(self.number) <= _STRETCHES and self.sizes[:2].sum() <= _TOKENS:
            self.passing = []
            return
        for t in self.passing:
            del self.number[t]
        self.passing = []
        n = len(self.number)
        del self.names[n:]
        self.sizes, self.bad = self.sizes[:, :n], self.bad[:n]
        a, b, groups, _, pairs = self.sizes.sum(axis=1).tolist()
        self.pairs, self.links = self.pairs[:pairs], self.links[:pairs]
        self.ids = [x[:k] for x, k in zip(self.ids, (a, b), strict=True)]
        self.members = [x[:groups] for x in self.members]

    def add(self, texts: list[str]) -> None:
        """Encodes and aligns stretches that are not known yet."""
        plain = [t for t in texts if t == t.strip()]
        rough = [t for t in texts if t != t.strip()] if len(plain) < len(texts) else []
        texts = plain + rough
        self.passing += texts
        ids, cuts, good = self.tokenizers.encode_each(plain, rough)
        ends = [np.cumsum(size[i]) for i, size in zip(ids, self.tokenizers.sizes, strict=True)]
        irregular = align(ends[0].tolist(), ends[1].tolist())
        last = [_last_of_group(i.size, irregular[:, 2 * side], irregular[:, 2 * side + 1]) for side, i in enumerate(ids)]
        members = [np.diff(np.flatnonzero(x), prepend=-1) for x in last]
        groups = np.searchsorted(_ends(members[0]), cuts[0])
        of, pair, links = _pairs(ids, members, np.repeat(np.arange(len(texts)), np.diff(groups)))
        at = np.searchsorted(of, np.arange(len(texts) + 1))
        sizes = np.stack([np.diff(cuts[0]), np.diff(cuts[1]), np.diff(groups), np.diff(_ends(links)[at]), np.diff(at)])
        begin = len(self.number)
        self.number.update(zip(texts, range(begin, begin + len(texts)), strict=True))
        self.names += _names(ids, last, members, cuts, self.tokenizers.decimal)
        self.sizes, self.bad = np.concatenate([self.sizes, sizes], axis=1), np.concatenate([self.bad, ~good])
        self.pairs, self.links = np.concatenate([self.pairs, pair]), np.concatenate([self.links, links])
        if self.lists:
            self.ids = [np.concatenate(x) for x in zip(self.ids, ids, strict=True)]
            self.members = [np.concatenate(x) for x in zip(self.members, members, strict=True)]

    def of(self, stretches: list[str]) -> np.ndarray:
        """The numbers of stretches until the next call; those not known are added."""
        self.forget()
        self.add(list(set(stretches) - self.number.keys()))
        return np.fromiter(map(self.number.__getitem__, stretches), np.int64, len(stretches))

    def gathered(self, numbers: np.ndarray, kind: int, *values: np.ndarray) -> tuple[np.ndarray, ...]:
        """The values of stretches one after the other; kind: the row of `sizes` that says how many each has."""
        begin = np.cumsum(self.sizes[kind]) - self.sizes[kind]
        at = _spread(begin[numbers], self.sizes[kind][numbers])
        return tuple(v[at] for v in values)


def _last_of_group(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each of n tokens is the last of its group."""
    inside = np.zeros(n + 1, np.int64)
    inside[begin] += 1
    inside[end - 1] -= 1
    return np.cumsum(inside)[:-1] == 0


def _names(ids: list[np.ndarray], last: list[np.ndarray], members: list[np.ndarray], cuts: list[np.ndarray], decimal: list[bytes]) -> list[bytes]:
    """The groups of each stretch as text, with a semicolon after each; decimal: each number with a comma, a bar and a semicolon after it."""
    group_of = [np.cumsum(x) - x for x in last]
    # A group's tokens of the first tokenizer come before those of the second.
    place = [np.arange(ids[0].size) + (np.cumsum(members[1]) - members[1])[group_of[0]], np.arange(ids[1].size) + np.cumsum(members[0])[group_of[1]]]
    code = np.empty(ids[0].size + ids[1].size, np.int64)
    for side in (0, 1):
        code[place[side]] = 3 * ids[side] + np.where(last[side], side + 1, 0)
    named, cut = [decimal[c] for c in code.tolist()], (cuts[0] + cuts[1]).tolist()
    return [b"".join(named[s:e]) for s, e in zip(cut, cut[1:], strict=False)]


def _summed(of: np.ndarray, pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs of one stretch or document made one, in order; there are under 2^23 of those."""
    key = (of << 2 * _SHIFT) + pair
    order = key.argsort()
    key = key[order]
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, key.size), bool), key[1:] != key[:-1]]))
    links = np.add.reduceat(links[order], heads) if heads.size else links
    return key[heads] >> 2 * _SHIFT, key[heads] & (1 << 2 * _SHIFT) - 1, links


def _pairs(ids: list[np.ndarray], members: list[np.ndarray], of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, pair, links) of the distinct linked id pairs of each stretch; `of`: the stretch of each group."""
    every = np.arange(of.size)
    (ga, ida, na), (gb, idb, nb) = (_counted(i, np.repeat(every, m)) for i, m in zip(ids, members, strict=True))
    # Each distinct id of a group on one side with each on the other.
    begin = np.searchsorted(gb, ga)
    wide = np.searchsorted(gb, ga, "right") - begin
    left, right = np.repeat(np.arange(ga.size), wide), _spread(begin, wide)
    return _summed(of[ga[left]], (ida[left] << _SHIFT) + idb[right], na[left] * nb[right])


def _counted(ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, how often) of the distinct ids of each group, in order."""
    key, count = np.unique((group << _SHIFT) + ids, return_counts=True)
    return key >> _SHIFT, key & (1 << _SHIFT) - 1, count


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(np.array([len(t or "") for t in batch.column(1).to_pylist()], np.int64))
    row = 0
    while row < batch.num_rows:
        last = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + _SLICE, "right")))
        last = min(last, row + _ROWS)
        yield batch.slice(row, last - row)
        row = last


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_LISTS = ["a_ids", "b_ids", "a_sizes", "b_sizes"]


def groups(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, lists: bool = False) -> DataFrame:
    """For each row doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct id pairs with their links; with `lists` also the groups: ids and how many of them each has, by tokenizer."""
    own = [("pairs", pa.int64()), ("links", pa.int64()), *((n, pa.int32()) for n in _LISTS if lists)]
    arrow = pa.schema([*((n, pa.int64()) for n in ("doc_id", *_NUMBERS)), ("groups_sha256", pa.string()), *((n, pa.list_(kind)) for n, kind in own)])

    def aligned(part: pa.RecordBatch, known: Stretches) -> pa.RecordBatch:
        stretches, cuts = [], [0]
        for text in part.column(1).to_pylist():
            if text:
                stretches += [text] if known.tokenizers.whole else _BLANK.split(text)
            cuts.append(len(stretches))
        numbers, cuts = known.of(stretches), np.array(cuts)
        size = np.diff(cuts)
        lost = np.diff(_ends(known.bad[numbers])[cuts]) > 0
        numbers, size = numbers[~np.repeat(lost, size)], np.where(lost, 0, size)
        cuts = _ends(size)
        counts = [_ends(known.sizes[k][numbers])[cuts] for k in range(5)]
        names, listed, cut = known.names, numbers.tolist(), cuts.tolist()
        digests = [hashlib.sha256(b"".join([names[k] for k in listed[s:e]])[:-1]).hexdigest() if e > s else "" for s, e in zip(cut, cut[1:], strict=False)]
        of, pair, links = _summed(np.repeat(np.arange(size.size), np.diff(counts[4])), *known.gathered(numbers, 4, known.pairs, known.links))
        at = np.searchsorted(of, np.arange(size.size + 1))
        columns = [_ragged(pair, at, pa.int64()), _ragged(links, at, pa.int64())]
        if known.lists:
            columns += [_ragged(known.gathered(numbers, k, known.ids[k])[0], counts[k], pa.int32()) for k in (0, 1)]
            columns += [_ragged(x, counts[2], pa.int32()) for x in known.gathered(numbers, 2, *known.members)]
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.diff(c), pa.int64()) for c in counts[:4]), pa.array(digests, pa.string()), *columns], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Stretches(load_tokenizers(ranks_path, pattern, model_path), lists)
        for batch in batches:
            for part in _slices(batch):
                yield aligned(part, known)

    schema = ", ".join([*(f"{n} long" for n in ("doc_id", *_NUMBERS)), "groups_sha256 string, pairs array<long>, links array<long>", *(f"{n} array<int>" for n in _LISTS if lists)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _ragged(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def pair_counts(grouped: DataFrame) -> DataFrame:
    """pair, documents: how many rows hold an id pair linked."""
    return grouped.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents"))


def _columns(rows: DataFrame, *names: str) -> tuple[np.ndarray, ...]:
    """Columns of a table of bounded size, in the order of the first."""
    found = rows.select(*names).toArrow()
    arrays = [found[n].to_numpy().astype(np.int64) for n in names]
    order = arrays[0].argsort()
    return tuple(x[order] for x in arrays)


def link_counts(grouped: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for `grouped`: groups(), written, with `row` to tell its rows."""
    counts = written(pair_counts(grouped))
    first = F.shiftright("pair", _SHIFT)
    tops = counts.groupBy(first.alias("id")).agg(F.max("documents").alias("best"))  # the vocabulary at most
    ids, best = _columns(tops, "id", "best")
    few = counts.count() <= frequent
    held, held_counts = _columns(counts if few else counts.orderBy(F.desc("documents"), "pair").limit(frequent), "pair", "documents")
    kept = ["row", "doc_id", *_NUMBERS, "groups_sha256"]
    arrow = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in (*kept, "n_best", "count_sum")])

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(row of the batch, pair, links, place among those the task holds, whether it is one of them)."""
        pair, links = (batch.column(n).flatten().to_numpy() for n in ("pairs", "links"))
        of = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("pairs").value_lengths(), np.int64))
        at = np.minimum(np.searchsorted(held, pair), max(held.size - 1, 0))
        return of, pair, links, at, (held[at] == pair) if held.size else np.zeros(pair.size, bool)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, pair, links, at, here = read(batch)
            of, pair, links, count = of[here], pair[here], links[here], held_counts[at[here]]
            top = best[np.searchsorted(ids, pair >> _SHIFT)] == count
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], of[top], links[top])
            np.add.at(sums[1], of, links * count)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *map(pa.array, sums)], schema=arrow)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, pair, links, _, here = read(batch)
            yield pa.RecordBatch.from_arrays([pa.array(x[~here]) for x in (batch.column("row").to_numpy()[of], pair, links)], names=["row", "pair", "links"])

    schema = ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in arrow.names)
    found = grouped.select(*kept, "pairs", "links").mapInArrow(summed, schema)
    if not few:
        rare = grouped.select("row", "pairs", "links").mapInArrow(others, "row long, pair long, links long").join(counts, "pair")
        rare = rare.withColumn("id", first).join(F.broadcast(tops), "id").groupBy("row")
        rare = rare.agg(F.sum(F.when(F.col("documents") == F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("documents")).alias("more_sum"))
        more = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
        found = found.join(rare, "row", "left").withColumns(more)
    return found.select("doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256")


def alignment(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row."""
    found = groups(docs, ranks_path, pattern, model_path)
    return link_counts(written(found.withColumn("row", F.monotonically_increasing_id())), frequent)
