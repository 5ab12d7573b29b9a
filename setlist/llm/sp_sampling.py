"""SentencePiece encoding by sampling without replacement, and decoding.

A text's segmentations are the paths of its lattice. Each path gets a Gumbel-perturbed
log probability, and the k paths with the largest ones are k distinct samples without
replacement. They are found by A* search from the top: a node of the search is a path
prefix, its bound is the largest perturbed value below it, and a popped node is expanded
into the piece that inherits the bound and the rest, whose bound is truncated below it.
The search works with exp(-value), the arrival times of an exponential race, in which a
truncated Gumbel is simply a later arrival: the siblings of a chosen piece arrive after
their parent by an exponential time at the rate of their summed probability. As the
chosen child inherits the bound, it is always popped next, so a whole descent runs at
once, vectorised over all words of many texts.

All random numbers are hashes of the row's key and the place of the draw: a row gets the
same samples on any cluster, in any batch and on every retry.

A BPE model's scores are ranks, not probabilities; a piece of rank r gets the Zipf
probability 1 / (r + RANK_SHIFT), byte pieces that of the last rank.

Defined results: a null or empty text has one segmentation, of no pieces; a text whose
lattice has fewer than k paths gives all of them; U+2581 in a text decodes as a space, as in
the library; rows that repeat a key get equal samples; null ids decode as null; an empty
table gives an empty one; very long texts are encoded whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlist.llm.lattice import SPACE, Pieces, build, load_pieces
from setlist.llm.words import Words, mix, text_slices

SAMPLES = 2
SEED = 17
RANK_SHIFT = 10.0
_MARK = SPACE.encode()
#: Bytes of text whose lattices are held at once; each takes some 500 bytes of memory.
_SLICE = 1 << 17
#: Scales probabilities by exp(SCALE) a byte, so that those of usual units stay near 1.
SCALE = 2.5


def piece_log_probabilities(pieces: Pieces) -> np.ndarray:
    rank = np.where(pieces.scores <= 0, -pieces.scores, 0)
    rank[pieces.byte_ids] = len(pieces)
    p = 1 / (np.minimum(rank, len(pieces)) + RANK_SHIFT)
    return np.log(p / p.sum())


def split_units(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Units of texts that each begin with a space: a run of spaces and what follows up to the next."""
    space = data == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[offsets[:-1]] = True
    starts = np.flatnonzero(first)
    return Words(data, starts, np.concatenate([starts[1:], [data.size]]), np.searchsorted(starts, offsets))


def with_prefix(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each, and their offsets."""
    n = np.diff(offsets)
    out = np.full(data.size + n.size, 0x20, np.uint8)
    out[np.arange(data.size) + np.repeat(np.arange(1, n.size + 1), n)] = data
    return out, offsets + np.arange(offsets.size)


class _Draws:
    """Uniform numbers in (0, 1) for places in texts, from the texts' keys."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys

    def at(self, text: np.ndarray, stream: int, unit: np.ndarray, step: int | np.ndarray) -> np.ndarray:
        place = mix((unit.astype(np.uint64) << np.uint64(24)) + np.uint64(1) * np.asarray(step).astype(np.uint64) + np.uint64(stream << 56))
        return ((mix(self.keys[text] ^ place) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class _Chain:
    """Lattices of the distinct units of some texts, ready for descents."""

    def __init__(self, units: list[bytes], pieces: Pieces, log_p: np.ndarray) -> None:
        lattice = build(units, pieces)
        lengths = np.array([len(x) for x in pieces.surface])
        weights = np.exp(log_p + SCALE * lengths)[lattice.piece]
        beta = lattice.backward(weights, np.add)
        if (beta[lattice.start] > 1e-250).all() and (beta < 1e250).all():
            self.share = weights * beta[lattice.end] / beta[lattice.start]
        else:  # a very long unit
            weights = log_p[lattice.piece]
            beta = lattice.backward(weights)
            self.share = np.exp(weights + beta[lattice.end] - beta[lattice.start])
        self.begin, self.last, self.end, self.piece, self.node = lattice.begin, lattice.last, lattice.end, lattice.piece, lattice.start
        self.first = first = lattice.first
        total = np.concatenate([[0], np.cumsum(self.share)])
        self.upto = total[1:] - total[first[self.node]]
        several = np.diff(first)
        self.upto[first[1:][several > 0] - 1] = np.inf
        self.share[first[:-1][several == 1]] = 1.0
        self.log_share = np.log(self.share)

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        edge = self.first[node]
        more = np.arange(edge.size)
        while (more := more[u[more] >= self.upto[edge[more]]]).size:
            edge[more] += 1
        return edge


#: A descent's places of which no path had this little log probability before them are looked at first;
#: no later one can come before _SURE, as no waiting time is under 2 ** -54.
_DEPTH = -60.0
_SURE = 2.0**-54 * np.exp(-_DEPTH)


class _Sample:
    """One segmentation of each text: edges, and for its first places the arrival of the first path that leaves there."""

    def __init__(self, edges: np.ndarray, unit: np.ndarray, step: np.ndarray, of_text: np.ndarray) -> None:
        self.edges, self.unit, self.step, self.of_text = edges, unit, step, of_text

    def settle(self, chain: _Chain, draws: _Draws, stream: int, since: np.ndarray, arrival: np.ndarray, depth: float = _DEPTH) -> None:
        """`since`: for each text its first edge that leaves room for others; `arrival`: of this sample."""
        total = np.concatenate([[0], np.cumsum(chain.log_share[self.edges])])
        base = total[self.of_text[:-1]]
        self.log_p = total[self.of_text[1:]] - base
        # Sums fall, so the places above `depth` are the first ones of each text.
        above = total[:-1] > np.repeat(base + depth, np.diff(self.of_text))
        self.lead = np.concatenate([[0], np.cumsum(np.add.reduceat(above, self.of_text[:-1]))])
        place = np.flatnonzero(above)
        text = np.repeat(np.arange(base.size), np.diff(self.lead))
        self.before = total[place] - base[text]
        with np.errstate(divide="ignore", over="ignore"):
            wait = -np.log(draws.at(text, stream, self.unit[place], self.step[place])) / (1 - chain.share[self.edges[place]])
            self.leaves = arrival[text] + wait * np.exp(-self.before)
        self.leaves[place - self.of_text[:-1][text] < since[text]] = np.inf
        if depth == _DEPTH and (above.size > place.size) and (self.next()[0] > arrival + _SURE).any():
            self.settle(chain, draws, stream, since, arrival, -np.inf)

    def next(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text the first arrival and its place."""
        least = np.minimum.reduceat(self.leaves, self.lead[:-1])
        hit = np.flatnonzero(self.leaves == np.repeat(least, np.diff(self.lead)))
        return least, hit[np.searchsorted(hit, self.lead[:-1])] - self.lead[:-1]


def _descend(chain: _Chain, draws: _Draws, sample: int, own: np.ndarray, node: np.ndarray, text: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges chosen from `node` to the end of each unit; (index into own, step, edge)."""
    at, found, step = np.arange(own.size), [], 0
    goal = chain.last[own]
    at = at[node != goal]
    node = node[at]
    while at.size:
        edge = chain.choose(node, draws.at(text[at], 2 * sample, number[at], step))
        found.append((at, np.full(at.size, step), edge))
        node = chain.end[edge]
        on = node != goal[at]
        at, node, step = at[on], node[on], step + 1
    if not found:
        return (np.zeros(0, np.int64),) * 3
    at, steps, edges = (np.concatenate(x) for x in zip(*found, strict=True))
    return at, steps, edges


def _in_order(at: np.ndarray, step: np.ndarray, edge: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The edges unit by unit: (edges, units, steps, where each unit begins)."""
    begin = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))])
    place = begin[at] + step
    edges, units, steps = (np.empty(at.size, np.int64) for _ in range(3))
    edges[place], units[place], steps[place] = edge, at, step
    return edges, units, steps, begin


def sample_texts(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, pieces: Pieces, log_p: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to k of (piece ids, log probability, log inclusion score), in sampling order."""
    empty = np.diff(offsets) == 0
    out: list[list[tuple[np.ndarray, float, float]]] = [[(np.zeros(0, np.int32), 0.0, 0.0)] if e else [] for e in empty]
    full = np.flatnonzero(~empty)
    if not full.size:
        return out
    offsets = np.concatenate([offsets[full], [data.size]])
    data, offsets = with_prefix(data, offsets)
    units = split_units(data, offsets)
    _, first, own = np.unique(units.hashes(), return_index=True, return_inverse=True)
    flat = data.tobytes()
    distinct = [flat[s:e].replace(b" ", _MARK) for s, e in zip(units.starts[first].tolist(), units.ends[first].tolist(), strict=True)]
    chain, draws = _Chain(distinct, pieces, log_p), _Draws(keys[full])
    text, n = units.text_of_word(), full.size
    number = np.arange(own.size) - units.of_text[text]

    edges, unit, step, begin = _in_order(*_descend(chain, draws, 0, own, chain.begin[own], text, number), own.size)
    samples = [_Sample(edges, number[unit], step, begin[units.of_text])]
    everywhere = np.arange(n)
    arrival = -np.log(draws.at(everywhere, 255, everywhere * 0, 0))
    samples[0].settle(chain, draws, 1, np.zeros(n, np.int64), arrival)
    times = [arrival]
    taken: list[dict[tuple[int, int], set[int]]] = [{} for _ in range(n)]  # edges that are gone at (sample, place)
    order = np.zeros(n, np.int64)  # samples so far, less one
    for s in range(1, k + 1):
        # The next arrival of each text: the least over all places of all its samples.
        best, where, which = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for r, x in enumerate(samples):
            least, place = x.next()
            better = np.flatnonzero(least < best)
            best[better], where[better], which[better] = least[better], place[better], r
        times.append(best)
        if s == k:
            break
        forced, prefix = np.full(n, -1), np.zeros(n, np.int64)
        pick, wait = draws.at(everywhere, 2 * s, everywhere * 0 + (1 << 30), 1), -np.log(draws.at(everywhere, 2 * s, everywhere * 0 + (1 << 30), 2))
        for t in np.flatnonzero(np.isfinite(best)).tolist():
            x, place = samples[which[t]], int(where[t])
            at = int(x.of_text[t]) + place
            node = chain.node[x.edges[at]]
            gone = taken[t].setdefault((int(which[t]), place), {int(x.edges[at])})
            rest = [e for e in range(chain.first[node], chain.first[node + 1]) if e not in gone]
            share = np.cumsum(chain.share[rest])
            chosen = rest[min(int(np.searchsorted(share, pick[t] * share[-1], "right")), len(rest) - 1)]
            gone.add(chosen)
            left = float(sum(chain.share[e] for e in rest if e != chosen))
            with np.errstate(over="ignore"):
                lead = int(x.lead[t]) + place
                x.leaves[lead] = best[t] + wait[t] / left * np.exp(-x.before[lead]) if left > 0 else np.inf
            forced[t], prefix[t] = chosen, place
        # Descents from the forced edges on; texts without one copy their last sample and are left out below.
        start, live = chain.begin[own].copy(), np.zeros(own.size, bool)
        heads = []
        for t in np.flatnonzero(forced >= 0).tolist():
            x = samples[which[t]]
            at = int(x.of_text[t]) + int(prefix[t])
            branch = int(units.of_text[t] + x.unit[at])
            live[branch : units.of_text[t + 1]] = True
            start[branch] = chain.end[forced[t]]
            heads.append((t, x, int(x.of_text[t]), at))
        ids = np.flatnonzero(live)
        at, steps, new = _descend(chain, draws, s, own[ids], start[ids], text[ids], number[ids])
        tail, tail_unit, tail_step, begin = _in_order(at, steps, new, ids.size)
        tail_text, tail_number = text[ids][tail_unit], number[ids][tail_unit]
        cuts = np.searchsorted(tail_text, np.arange(n + 1))
        edges, unit, step, of_text = [], [], [], np.zeros(n + 1, np.int64)
        since = np.zeros(n, np.int64)
        kept = np.zeros(n, bool)
        for t, x, low, at in heads:
            part = slice(cuts[t], cuts[t + 1])
            edges += [x.edges[low:at], [forced[t]], tail[part]]
            unit += [x.unit[low : at + 1], tail_number[part]]
            # Steps only name draws: the forced edge's unit goes on where a fresh descent would begin.
            step += [x.step[low : at + 1], tail_step[part]]
            of_text[t + 1] = at + 1 - low + cuts[t + 1] - cuts[t]
            since[t], kept[t] = at + 1 - low, True
        for t in np.flatnonzero(~kept).tolist():
            edges.append([samples[0].edges[samples[0].of_text[t]]])
            unit.append([0])
            step.append([0])
            of_text[t + 1], since[t] = 1, 1
        # Parts lie by text only if every text has them in turn.
        turn = [t for t, *_ in heads] + np.flatnonzero(~kept).tolist()
        joined = _by_text(turn, of_text, edges, unit, step)
        of_text = np.cumsum(of_text)
        samples.append(_Sample(*joined, of_text))
        samples[-1].settle(chain, draws, 2 * s + 1, since, np.where(np.isfinite(best), best, 0.0))
        order += kept
    with np.errstate(divide="ignore"):
        for i, t in enumerate(full.tolist()):
            end = times[order[i] + 1][i]  # the first arrival after the samples
            for x in samples[: order[i] + 1]:
                rate = x.log_p[i] + np.log(end)
                inside = rate if rate < -30 else float(np.log(-np.expm1(-np.exp(rate)))) if rate < 700 else 0.0
                out[t].append((chain.piece[x.edges[x.of_text[i] : x.of_text[i + 1]]].astype(np.int32), float(x.log_p[i]), float(inside)))
    return out


def _by_text(turn: list[int], sizes: np.ndarray, *columns: list) -> tuple[np.ndarray, ...]:
    """Columns whose parts come in the order `turn` of texts, put in the order of texts."""
    flat = [np.concatenate([np.asarray(p, np.int64) for p in c]) if c else np.zeros(0, np.int64) for c in columns]
    n = sizes[1:][turn]
    begin = np.zeros(sizes.size - 1, np.int64)
    begin[turn] = np.cumsum(n) - n
    own = sizes[1:]
    take = np.repeat(begin - (np.cumsum(own) - own), own) + np.arange(own.sum())
    return tuple(c[take] for c in flat)


def encode(docs: DataFrame, path: str, k: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """doc_id, sample (1 the first), ids (array<int>), log_probability, log_inclusion: up to k rows for each row of docs."""
    arrow = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_probability", pa.float64()), ("log_inclusion", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(path)
        log_p = piece_log_probabilities(pieces)
        for batch in batches:
            keys = batch.column(1).to_numpy().view(np.uint64)
            for first, last, data, offsets in text_slices(batch.column(2), _SLICE):
                found = sample_texts(data, offsets, keys[first:last], pieces, log_p, k)
                rows = [(i, j + 1, *x) for i, own in enumerate(found) for j, x in enumerate(own)]
                ids = [x[2] for x in rows]
                cuts = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([first + x[0] for x in rows])),
                        pa.array([x[1] for x in rows], pa.int32()),
                        pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(ids))),
                        pa.array([x[3] for x in rows]),
                        pa.array([x[4] for x in rows]),
                    ],
                    schema=arrow,
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(seed), "doc_id").alias("key"), F.replace("text", F.lit(SPACE), F.lit(" ")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, sample int, ids array<int>, log_probability double, log_inclusion double")


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    text = b"".join(map(pieces.surface.__getitem__, ids)).replace(_MARK, b" ")
    return text.removeprefix(b" ").decode()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encode() with `text`, what their ids spell."""
    fields = [f for f in encoded.schema.fieldNames() if f != "text"]
    schema = encoded.select(*fields).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(path)
        at = fields.index("ids")
        for batch in batches:
            lists = batch.column(at)
            ids, there = lists.flatten().to_numpy(zero_copy_only=False), lists.is_valid().to_pylist()
            cuts = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
            texts = [decode_ids(ids[s:e].tolist(), pieces) if own else None for own, s, e in zip(there, cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*fields, "text"])

    return encoded.select(*fields).mapInArrow(run, schema)
