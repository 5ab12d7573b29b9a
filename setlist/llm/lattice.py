"""Segmentation lattices over a fixed public vocabulary of pieces.

A unit is one word with the spaces before it, as SentencePiece joins them; no piece of
such vocabularies crosses from a word into the next space, so the lattice of a text is
the chain of its units' lattices. Nodes are byte positions; an edge is a piece. A
character that no piece has goes byte by byte, over its byte pieces alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

SPACE = "▁"


@dataclass
class Pieces:
    """step[state, byte] walks the trie of all pieces from state 0 (0 again: no piece goes on so); piece_at[state]: the piece that ends there, or -1."""

    step: np.ndarray
    piece_at: np.ndarray
    byte_ids: np.ndarray
    surface: list[bytes]
    scores: np.ndarray

    def __len__(self) -> int:
        return len(self.surface)

    @property
    def longest(self) -> int:
        return max(map(len, self.surface))


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    """The vocabulary of a SentencePiece model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    byte_ids, surface, scores = np.zeros(256, np.int64), [], []
    states, ends = {b"": 0}, {}
    for i in range(model.vocab_size()):
        name = model.id_to_piece(i)
        scores.append(model.get_score(i))
        if model.is_byte(i):
            value = int(name[3:5], 16)
            byte_ids[value] = i
            surface.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            surface.append(b"")
        else:
            surface.append(name.encode())
            for n in range(1, len(surface[-1]) + 1):
                states.setdefault(surface[-1][:n], len(states))
            ends[states[surface[-1]]] = i
    step, piece_at = np.zeros((len(states), 256), np.int32), np.full(len(states), -1, np.int32)
    for prefix, state in states.items():
        if prefix:
            step[states[prefix[:-1]], prefix[-1]] = state
    piece_at[list(ends)] = list(ends.values())
    return Pieces(step, piece_at, byte_ids, surface, np.array(scores))


def _char_size(lead: np.ndarray) -> np.ndarray:
    """Bytes of the characters with these first bytes; 0 for bytes inside a character."""
    return np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0], [1, 0, 2, 3], 4)


@dataclass
class Lattice:
    """Edges of many units' lattices, by start node.

    Nodes are numbered by their distance in bytes from their unit's end, so all nodes at
    one distance lie together and each edge leads to a smaller number.
    """

    begin: np.ndarray  # each unit's first node
    last: np.ndarray  # each unit's last node
    levels: np.ndarray  # where the nodes of each distance begin
    first: np.ndarray  # where the edges of each node begin, and their number
    rank: np.ndarray  # of the units by falling length
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray

    @property
    def unit(self) -> np.ndarray:
        """The unit of each edge."""
        of_rank = np.empty_like(self.rank)
        of_rank[self.rank] = np.arange(self.rank.size)
        level = np.searchsorted(self.levels, self.start, "right") - 1
        return of_rank[self.start - self.levels[level]]

    def backward(self, weights: np.ndarray, add: np.ufunc = np.logaddexp) -> np.ndarray:
        """For each node the summed weight of all ways to its unit's end.

        `weights`: a weight for each edge, or a row of them. With np.logaddexp all are logs,
        with np.add plain numbers.
        """
        zero, one, times = (-np.inf, 0.0, np.add) if add is np.logaddexp else (0.0, 1.0, np.multiply)
        beta = np.full((self.levels[-1], *weights.shape[1:]), zero)
        beta[self.last] = one
        for low, high in zip(self.levels[1:-1], self.levels[2:], strict=True):
            e0, e1 = self.first[low], self.first[high]
            if e1 > e0:
                cuts = self.first[low:high]
                own = np.flatnonzero(self.first[low + 1 : high + 1] > cuts)
                beta[low + own] = add.reduceat(times(weights[e0:e1], beta[self.end[e0:e1]]), cuts[own] - e0, axis=0)
        return beta

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """The logs of the summed weights of all ways from the unit's begin to each node; log weights."""
        alpha = np.full((self.levels[-1], *weights.shape[1:]), -np.inf)
        alpha[self.begin] = 0
        distance = np.searchsorted(self.levels, np.arange(self.levels[-1]), "right") - 1
        at = distance[self.begin][self.unit] - distance[self.end]
        order = np.lexsort((self.end, at))
        for edges in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if order.size else []:
            end = self.end[edges]
            cuts = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
            alpha[end[cuts]] = np.logaddexp.reduceat(weights[edges] + alpha[self.start[edges]], cuts, axis=0)
        return alpha


def build(units: list[bytes], pieces: Pieces) -> Lattice:
    """The lattices of `units` (UTF-8); a node's edges come with the longest first."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    data = np.frombuffer(b"".join(units), np.uint8)
    rank = np.empty(len(units), np.int64)
    rank[np.argsort(-sizes, kind="stable")] = np.arange(len(units))
    long_enough = np.cumsum(np.bincount(sizes)[::-1])[::-1] if len(units) else np.zeros(1, np.int64)
    levels = np.concatenate([[0], np.cumsum(long_enough)])
    unit = np.repeat(np.arange(len(units)), sizes)
    stop = np.cumsum(sizes)[unit]
    char = _char_size(data)
    begin = np.flatnonzero(char)
    at, state, length = begin, pieces.step[0, data[begin]], 1
    whole = np.zeros(data.size, bool)  # characters that are a piece
    found = []
    while at.size:
        on = state > 0
        at, state = at[on], state[on]
        piece = pieces.piece_at[state]
        hit = piece >= 0
        found.append((at[hit], length, piece[hit]))
        whole[at[hit & (char[at] == length)]] = True
        on = at + length < stop[at]
        at, state = at[on], state[on]
        state = pieces.step[state, data[at + length]]
        length += 1
    missing = begin[~whole[begin]]
    for j in range(4):
        at = missing[char[missing] > j] + j
        found.append((at, 1, pieces.byte_ids[data[at]]))
    nodes = levels[stop - np.arange(data.size)] + rank[unit]
    count = np.zeros(levels[-1], np.int64)
    for at, _, _ in found:
        count[nodes[at]] += 1
    first = np.concatenate([[0], np.cumsum(count)])
    free = first[:-1].copy()
    start, end, ids = (np.empty(first[-1], np.int32) for _ in range(3))
    for at, length, piece in reversed(found):
        node = nodes[at]
        place = free[node]
        free[node] += 1
        start[place], ids[place] = node, piece
        end[place] = levels[stop[at] - at - length] + rank[unit[at]]
    return Lattice(levels[sizes] + rank, rank, levels, first, rank, start, end, ids)


def log_sums(units: list[bytes], pieces: Pieces, log_p: np.ndarray, scale: float = 2.5) -> np.ndarray:
    """For each unit and each row of log_p (languages x pieces) the log of the summed probability of all segmentations.

    A forward pass over byte positions, for many units at once, on probabilities that are
    scaled by exp(scale) a byte (and again where a unit is long), so that they stay near 1.
    """
    lengths = np.array([len(x) for x in pieces.surface])
    weights = np.exp(log_p.T + (lengths * scale)[:, None])
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    out = np.zeros((len(units), len(log_p)))
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(units):
        widest = max(1, int(sizes[order[at]]))
        rows = order[at : at + max(1, min(20_000, (1 << 20) // widest))]
        rows = rows[np.maximum(sizes[rows], 1) * 2 >= widest]  # so that little of the table is padding
        few = widest > _LONG_UNIT and rows.size <= _FEW_UNITS
        sums = np.stack([_forward_one(units[i], pieces, weights) for i in rows]) if few else _forward([units[i] for i in rows], sizes[rows], pieces, weights)
        out[rows] = sums - scale * sizes[rows][:, None]
        at += rows.size
    return out


#: A few units longer than this go one by one, as their bytes give too little to do at once.
_LONG_UNIT, _FEW_UNITS = 1000, 8


def _forward_one(unit: bytes, pieces: Pieces, weights: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """The log of the scaled sum of one long unit: edges are found for a block of places at once, then summed place by place."""
    data = np.frombuffer(unit, np.uint8)
    char, longest, n = _char_size(data), pieces.longest, data.size
    spelt = np.zeros(n + 4, bool)  # bytes of characters that are no piece
    held = np.zeros((block + longest + 1, weights.shape[1]))
    held[0] = 1
    shift = np.zeros(weights.shape[1])
    for low in range(0, n, block):
        high = min(low + block, n)
        at = low + np.flatnonzero(char[low:high])
        begin, state, length, found, known = at, np.zeros(at.size, np.int32), 1, [], np.zeros(high - low, bool)
        while at.size:
            state = pieces.step[state, data[at + length - 1]]
            at, state = at[state > 0], state[state > 0]
            hit = pieces.piece_at[state] >= 0
            found.append((at[hit], np.full(hit.sum(), length), pieces.piece_at[state[hit]]))
            known[at[hit & (char[at] == length)] - low] = True
            on = at + length < n
            at, state, length = at[on], state[on], length + 1
        missing = begin[~known[begin - low]]
        for j in range(4):
            spelt[missing[char[missing] > j] + j] = True
        at = low + np.flatnonzero(spelt[low:high])
        found.append((at, np.ones(at.size, np.int64), pieces.byte_ids[data[at]]))
        start, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        ends, own = (start + size)[order] - low, weights[piece[order]]
        first = np.searchsorted(start[order], np.arange(low, high + 1)).tolist()
        for p in range(high - low):
            if p % 32 == 0:
                top = held[p : p + longest].max(axis=0)
                top[top == 0] = 1
                held[p : p + longest] /= top
                shift += np.log(top)
            e0, e1 = first[p], first[p + 1]
            if e1 > e0:  # the edges of one place have different ends
                held[ends[e0:e1]] += held[p] * own[e0:e1]
        rest = held[high - low : high - low + longest + 1].copy()
        held[:] = 0
        held[: rest.shape[0]] = rest
    with np.errstate(divide="ignore"):
        return np.log(held[0]) + shift


def _forward(units: list[bytes], sizes: np.ndarray, pieces: Pieces, weights: np.ndarray) -> np.ndarray:
    """Logs of the scaled sums of units that are sorted by falling size."""
    widest, n = int(sizes[0]), len(units)
    data = np.zeros((widest, n), np.uint8)
    data.T[np.arange(widest) < sizes[:, None]] = np.frombuffer(b"".join(units), np.uint8)
    alpha = np.zeros((widest + 1, n, weights.shape[1]))
    alpha[0] = 1
    shift, longest = np.zeros(alpha.shape[1:]), pieces.longest
    spelt = np.zeros((widest + 4, n), bool)  # bytes of characters that are no piece
    for p in range(widest):
        if p and p % 32 == 0:
            window = alpha[p : p + longest]
            top = window.max(axis=0)
            top[top == 0] = 1
            window /= top
            shift += np.log(top)
        live = np.searchsorted(-sizes, -p, "left")  # units longer than p
        char = _char_size(data[p, :live])
        rows = np.flatnonzero(char)
        state, known = pieces.step[0, data[p, rows]], np.zeros(live, bool)
        own, length = alpha[p, rows], 1
        while rows.size:
            on = state > 0
            rows, state, own = rows[on], state[on], own[on]
            piece = pieces.piece_at[state]
            hit = piece >= 0
            alpha[p + length, rows[hit]] += own[hit] * weights[piece[hit]]
            known[rows[hit & (char[rows] == length)]] = True
            on = sizes[rows] > p + length
            rows, state, own = rows[on], state[on], own[on]
            if rows.size:
                state = pieces.step[state, data[p + length, rows]]
            length += 1
        rows = np.flatnonzero((char > 0) & ~known)
        for j in range(4):
            spelt[p + j, rows[char[rows] > j]] = True
        rows = np.flatnonzero(spelt[p, :live])
        alpha[p + 1, rows] += alpha[p, rows] * weights[pieces.byte_ids[data[p, rows]]]
    with np.errstate(divide="ignore"):
        return np.log(alpha[sizes, np.arange(n)]) + shift
