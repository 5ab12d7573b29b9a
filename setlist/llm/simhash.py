"""SimHash near-duplicates through a Gray-order hierarchical index.

A text's fingerprint takes, for each of 64 bits, the majority over the XXH64 hashes of
its word shingles. Two fingerprints link at `distance` or fewer differing bits, and a
document's component is what links reach.

Linkable fingerprints agree on at least one of `distance + 1` blocks of bits. For each
block the fingerprints are rotated so that it leads and sorted by Gray rank, in which
neighbours share long bit patterns. Leaves are LEAF consecutive fingerprints; leaves and
the nodes above them keep the bits on which all below agree. Two nodes are compared by
those shared patterns alone: a whole pair of groups is pruned once the differences
gathered on the way down exceed `distance`, or if the leading block differs anywhere (that
pair is looked at in the order of another block). Ranges of the Gray order are Spark
partitions, cut where the leading block changes, so that above them every pair of groups
is pruned; inside, all links come out of the tree. It gives a spanning forest, never the
pairs, and the forests of all ranges are merged by alternating large-star and small-star
steps on DataFrames.

A leading block that very many fingerprints have is cut into groups by the next bits of
the Gray rank (and by a hash where these don't tell them apart), and each pair of groups
whose shared patterns allow a link is a range of its own.

Defined results: null and empty texts have fingerprint zero and link like any other;
equal texts, repeated rows included, share a component; a null doc_id is never a
component's id unless it has no other; an empty table gives an empty one; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlist.llm.common import BROADCAST_ROWS, attach, durable, text_key, without

BITS = 64
SHINGLE = 3
DISTANCE = 3
SEED = 42
LEAF = 16


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 for none."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(bits), 255):  # as many rows as a byte can count
        counts += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(bits), bitorder="little").view("<u8")[0])


def text_fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Of a text in UTF-8; bytes.lower() and bytes.split() know ASCII letters and white space only."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, SEED)
    cuts = [0, *accumulate(len(w) + 1 for w in words)]
    return simhash(np.array([digest(joined[s : e - 1], SEED) for s, e in zip(cuts, cuts[size:], strict=False)], np.uint64))


def fingerprints(df: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, fingerprint (long, the bits as signed) for each row."""
    arrow = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fingerprint", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [text_fingerprint(t, size) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(prints, np.uint64).view(np.int64))], schema=arrow)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key")).mapInArrow(run, "doc_id long, text_key long, fingerprint long")


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the order in which neighbours differ in one bit."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes the labels of a[i] and b[i] equal, and each label the smallest of its class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label[:] = up


class _Level:
    """Nodes of one height: the bits on which all fingerprints below agree, and their values."""

    def __init__(self, all_set: np.ndarray, any_set: np.ndarray) -> None:
        self.all_set, self.any_set = all_set, any_set
        self.shared = ~(all_set ^ any_set)

    def above(self) -> _Level:
        cuts = np.arange(0, self.all_set.size, LEAF)
        return _Level(np.bitwise_and.reduceat(self.all_set, cuts), np.bitwise_or.reduceat(self.any_set, cuts))

    def compare(self, i: np.ndarray, j: np.ndarray, d: np.ndarray, known: np.ndarray, distance: int, lead: np.uint64) -> tuple[np.ndarray, ...]:
        """The pairs of nodes that may have links below, their differences so far, and the bits these were counted on."""
        both = self.shared[i] & self.shared[j]
        differ = (self.all_set[i] ^ self.all_set[j]) & both
        d = d + np.bitwise_count(differ & ~known)
        keep = (d <= distance) & ((differ & lead) == 0)
        return i[keep], j[keep], d[keep], both[keep]


def tree_forest(prints: np.ndarray, distance: int = DISTANCE, lead: int = 0, chunk: int = 1 << 12, seen: dict[str, int] | None = None) -> np.ndarray:
    """For fingerprints in Gray order the position of the first one of each one's class.

    Classes are those of the links whose `lead` bits agree. `seen` takes the numbers of
    compared and pruned pairs of nodes, and of compared pairs of fingerprints.
    """
    label, lead, seen = np.arange(prints.size), np.uint64(lead), {} if seen is None else seen
    levels = [_Level(prints, prints)]
    while levels[-1].all_set.size > LEAF:
        levels.append(levels[-1].above())
    inner = np.arange(LEAF)

    def compared(height: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, known: np.ndarray) -> None:
        found = levels[height].compare(i, j, d, known, distance, lead)
        what = "nodes" if height else "fingerprints"
        seen[what] = seen.get(what, 0) + i.size
        seen["pruned " + what] = seen.get("pruned " + what, 0) + i.size - found[0].size
        if height:
            stack.append((height, *found))
        else:
            _join_labels(label, found[0], found[1])

    stack: list[tuple] = []
    i, j = np.triu_indices(levels[-1].all_set.size, 1 if len(levels) == 1 else 0)
    compared(len(levels) - 1, i, j, np.zeros(i.size, np.int64), np.zeros(i.size, np.uint64))
    while stack:
        height, i, j, d, known = stack.pop()
        size = levels[height - 1].all_set.size
        if height == 1 and i.size:  # pairs of leaves that are already one class need no look
            cuts = np.arange(0, size, LEAF)
            low, high = np.minimum.reduceat(label, cuts), np.maximum.reduceat(label, cuts)
            keep = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
            i, j, d, known = i[keep], j[keep], d[keep], known[keep]
        for at in range(0, i.size, chunk):
            part = slice(at, at + chunk)
            ci = (i[part, None, None] * LEAF + inner[None, :, None]).repeat(LEAF, 2).ravel()
            cj = (j[part, None, None] * LEAF + inner[None, None, :]).repeat(LEAF, 1).ravel()
            there = (ci + (height == 1) <= cj) & (cj < size) & (ci < size)
            compared(height - 1, ci[there], cj[there], np.repeat(d[part], LEAF * LEAF)[there], np.repeat(known[part], LEAF * LEAF)[there])
    return label


def _rotate(prints: np.ndarray, by: int) -> np.ndarray:
    """The bits moved left in a circle."""
    return prints << np.uint64(by) | prints >> np.uint64(BITS - by) if by % BITS else prints


def _orders(distance: int):
    """(cell, rank) of each fingerprint in the order of each block; cell: the block's number and its Gray rank there."""
    width = BITS // (distance + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for b in range(distance + 1):
                rank = gray_rank(_rotate(prints, b * width))
                cell = (rank >> np.uint64(BITS - width)).astype(np.int64) + (b << width)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(rank.view(np.int64))], names=["cell", "rank"])

    return run


def _tree_links(distance: int, at_once: int = 1 << 16):
    """(a, b) of a spanning forest in each range of rows (cell, pair, rank), which come sorted."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    width = BITS // (distance + 1)
    lead = ((1 << width) - 1) << (BITS - width)

    def links(cell: np.ndarray, pair: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole cells; one tree for all of an order, or of a pair of groups."""
        block = cell >> width
        starts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (pair[1:] != pair[:-1])]))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), cell.size], strict=True):
            prints = rank[s:e] ^ rank[s:e] >> np.uint64(1)
            label = tree_forest(prints, distance, lead)
            linked = np.flatnonzero(label != np.arange(prints.size))
            back = BITS - int(block[s]) * width
            own = [_rotate(prints[x], back).view(np.int64) for x in (linked, label[linked])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in own], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= at_once:
                cell, pair, rank = _columns(held)
                cut = int(np.flatnonzero((cell != cell[-1]) | (pair != pair[-1]))[-1]) + 1 if (cell[0], pair[0]) != (cell[-1], pair[-1]) else 0
                if cut:  # all but the last cell are whole
                    yield from links(cell[:cut], pair[:cut], rank[:cut])
                rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (cell[cut:], pair[cut:], rank[cut:].view(np.int64))], names=["cell", "pair", "rank"])
                held = [rows]
        if held and sum(x.num_rows for x in held):
            yield from links(*_columns(held))

    return run


def _columns(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cell, pair, rank = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in range(3))
    return cell, pair, rank.view(np.uint64)


def _group_pairs(rows: DataFrame, hot: DataFrame, distance: int, tile: int) -> DataFrame:
    """The rows (cell, rank) of hot cells, once for each pair of groups of about `tile` rows whose shared patterns allow a link."""
    width = BITS // (distance + 1)
    bits = F.least(F.lit(BITS - width - 1), F.ceil(F.log2(2 * F.col("count") / tile)).cast("int"))
    place = F.call_function("shiftrightunsigned", F.shiftleft("rank", width), F.lit(BITS) - bits)
    rows = rows.join(F.broadcast(hot), "cell").select("cell", "rank", place.alias("place"))
    sizes = rows.groupBy("cell", "place").agg(F.ceil(F.count("*") / tile).alias("parts"))
    rows = durable(rows.join(sizes, ["cell", "place"]).select("cell", "rank", F.struct("place", F.pmod(F.xxhash64("rank"), F.col("parts")).alias("part")).alias("own")))
    code = F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", 1))
    groups = durable(rows.groupBy("cell", "own").agg(F.bit_and(code).alias("all_set"), F.bit_or(code).alias("any_set")))
    groups = groups.select("cell", "own", "all_set", F.bitwise_not(F.col("all_set").bitwiseXOR(F.col("any_set"))).alias("shared"))
    a, b = groups.alias("a"), groups.alias("b")
    differ = F.col("a.all_set").bitwiseXOR(F.col("b.all_set")).bitwiseAND(F.col("a.shared")).bitwiseAND(F.col("b.shared"))
    near = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.own") <= F.col("b.own")) & (F.bit_count(differ) <= distance))
    ends = near.select(F.col("a.cell").alias("cell"), F.xxhash64("a.own", "b.own").alias("pair"), F.explode(F.array_distinct(F.array("a.own", "b.own"))).alias("own"))
    return rows.join(ends, ["cell", "own"]).select("cell", "pair", "rank")


def near_links(prints: DataFrame, distance: int = DISTANCE, tile: int = 1 << 20) -> DataFrame:
    """a, b: a spanning forest of the links inside each range of the Gray orders of the distinct fingerprints."""
    rows = prints.select("fingerprint").mapInArrow(_orders(distance), "cell long, rank long")
    # At most a row for each value of each block.
    hot = durable(rows.groupBy("cell").count().where(F.col("count") > tile))
    ranges = rows.select("cell", F.lit(0).cast("long").alias("pair"), "rank")
    if hot.count():
        ranges = ranges.join(F.broadcast(hot.select("cell")), "cell", "left_anti").unionByName(_group_pairs(rows, hot, distance, tile))
    return ranges.repartitionByRange("cell", "pair").sortWithinPartitions("cell", "pair", "rank").mapInArrow(_tree_links(distance), "a long, b long")


def _attach(left: DataFrame, right: DataFrame, key: str, few: bool) -> DataFrame:
    """A join that stays even where one key has most rows: broadcast, or a shuffle join that adaptive execution can split."""
    return left.join(F.broadcast(right) if few else durable(right), key)


def star_components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reached) for each end of `links` (a, b), but for the roots themselves."""
    links = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, few = now, now[0] <= BROADCAST_ROWS
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _attach(both, least, "u", few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = durable(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _attach(large, least, "u", few)
        small = small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("v"))
        links = durable(small.where("u <> v").distinct())


def components(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, text_key, fingerprint (long), root (the smallest fingerprint of the component), component_id for each document."""
    prints = durable(fingerprints(docs, size))
    nodes = durable(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")))
    roots = durable(star_components(near_links(nodes, distance)))
    few = roots.count() <= BROADCAST_ROWS
    named = nodes.join(F.broadcast(roots) if few else roots, nodes.fingerprint == roots.node, "left")
    named = durable(named.select("fingerprint", "rows", "first_id", F.coalesce("root", "fingerprint").alias("root")))
    # Only components of several fingerprints need a second look.
    heads = roots.select("root").distinct()
    several = named.join(F.broadcast(heads) if few else heads, "root", "left_semi")
    smallest = several.groupBy("root").agg(F.min("first_id").alias("smallest"), F.count("*").alias("prints"))
    named = attach(named, durable(smallest), ["root"], "prints", "left")
    named = durable(named.select("fingerprint", "rows", "root", F.coalesce("smallest", "first_id").alias("component_id")))
    return attach(prints, named, ["fingerprint"], "rows").select("doc_id", "text_key", "fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (long), component_id for each document."""
    return components(docs, size, distance).select("doc_id", "fingerprint", "component_id")


def without_near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of docs for each component: one with its smallest doc_id."""
    rows = durable(components(docs, size, distance))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    again = durable(rows.where(kept).groupBy("root").count().where("count > 1").select("root"))
    again = rows.where(kept).join(again, "root", "left_semi").withColumnRenamed("root", "group")
    return without(docs, rows.where(~kept), again)
