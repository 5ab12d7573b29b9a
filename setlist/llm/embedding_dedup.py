"""Near-duplicate embeddings by Euclidean p-stable hashing, then exact cosine checks.

Vectors are normalised, so a cosine is a Euclidean distance. A hash is a random Gaussian
projection moved by a random offset and cut into cells of one width; `hashes` of them
together name a vector's bucket in one table, and there are `tables` of those. The width is
six times the distance of the weakest pair that is to be found. The number of hashes grows
with the logarithm of the number of vectors, so that unrelated vectors in a bucket stay
about FALSE; the number of tables follows from it, so that even the weakest pair meets with
probability RECALL at every size. Pairs of a bucket are compared by their exact cosines in
double precision, and a pair that several tables find counts in the first of them alone.

Equal vectors are one vector with a number of copies. A bucket of more than TILE vectors is
cut by a hash of theirs, and each pair of cuts is a task's work of its own. Tasks pass on
each vector's number of links and a spanning forest of the links, never the pairs; the
forests are merged by star steps on DataFrames.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing, nor do vectors of different lengths with each other; equal vectors,
repeated rows included, link; a null id is never a component's unless it has no other; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlist.llm.common import BROADCAST_ROWS, attach, durable
from setlist.llm.simhash import _join_labels, star_components
from setlist.llm.vector_codes import usable
from setlist.llm.words import mix

COSINE = 0.95
#: Least probability with which a pair of that cosine meets in a table.
RECALL = 0.99
#: Unrelated vectors in a bucket, about.
FALSE = 64
#: Vectors of a bucket that are compared at once.
TILE = 2048
#: Vectors that equal rows are broadcast with.
_BROADCAST_VECTORS = 20_000
_SEED = 20_011
_STRIP = 256


def meets(width: float, distance: float) -> float:
    """Probability that one hash with cells of `width` gives two vectors at `distance` one value."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(vectors: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[float, int, int]:
    """Width of cells, hashes of a table, tables."""
    distance = math.sqrt(2 - 2 * cosine)
    width = 6 * distance
    hashes = max(1, math.ceil(math.log(max(1, vectors / FALSE)) / -math.log(meets(width, math.sqrt(2)))))
    return width, hashes, math.ceil(math.log(1 - recall) / math.log(1 - meets(width, distance) ** hashes))


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows."""
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def bucket_keys(unit: np.ndarray, width: float, hashes: int, tables: int) -> np.ndarray:
    """(rows, tables): a 64-bit key for each vector's bucket in each table."""
    size = unit.shape[1]
    draw = np.random.default_rng([_SEED, size])
    cells = np.empty((len(unit), tables), np.uint64)
    for t in range(tables):
        across, shift = draw.standard_normal((size, hashes)), draw.uniform(0, width, hashes)
        cell = np.floor((unit @ across + shift) / width).astype(np.int64).view(np.uint64)
        key = np.full(len(unit), t * 65_537 + size, np.uint64)
        for k in range(hashes):
            key = mix(mix(key) + cell[:, k])
        cells[:, t] = key
    return cells.view(np.int64)


def _by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each length of vectors."""
    sizes, values = np.asarray(column.value_lengths()), column.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, values[starts[rows][:, None] + np.arange(size)]


def signed(vectors: DataFrame, width: float, hashes: int, tables: int) -> DataFrame:
    """node, keys: the buckets of each vector, by table."""
    arrow = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.empty((batch.num_rows, tables), np.int64)
            for rows, found in _by_length(batch.column(1)):
                keys[rows] = bucket_keys(normalised(found), width, hashes, tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], schema=arrow)

    return vectors.select("node", "vector").mapInArrow(run, "node long, keys array<long>")


def tile_links(unit: np.ndarray, keys: np.ndarray, copies: np.ndarray, first: np.ndarray, whole: bool, table: int, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """For vectors of one bucket of `table`: how many others each links to that no earlier table joins it with, and the first vector of each one's class.

    All pairs are compared if it is a `whole` cut, or else those of a vector that `first` marks and one that it doesn't.
    """
    links, label = np.zeros(len(unit), np.int64), np.arange(len(unit))
    left = np.flatnonzero(first)
    right = left if whole else np.flatnonzero(~first)
    for at in range(0, left.size, _STRIP):
        i = left[at : at + _STRIP]
        j = right[at:] if whole else right
        linked = unit[i] @ unit[j].T >= cosine
        if whole:
            linked &= i[:, None] < j[None, :]
        if not linked.any():
            continue
        a, b = np.nonzero(linked)
        _join_labels(label, i[a], j[b])
        for t in range(table):
            linked &= keys[i, t][:, None] != keys[j, t][None, :]
        links[i] += linked @ copies[j]
        links[j] += copies[i] @ linked
    return links, label


def _tiles(cosine: float):
    """node, links and node, root of a forest, for rows sorted by tile."""
    arrow = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compared(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        node, copies, side, low = (rows[c].to_numpy() for c in ("node", "copies", "side", "low"))
        keys = rows["keys"].chunk(0).flatten().to_numpy().reshape(len(node), -1)
        size = len(rows["vector"][0])
        unit = normalised(rows["vector"].chunk(0).flatten().to_numpy().reshape(-1, size))
        links, label = tile_links(unit, keys, copies, side == low, low[0] == rows["high"][0].as_py(), rows["table"][0].as_py(), cosine)
        some = np.flatnonzero((links > 0) | (label != np.arange(label.size)))
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[label[some]])], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(c).to_numpy() for c in ("key", "low", "high")], axis=1)
            starts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            cuts = [0, *starts.tolist(), batch.num_rows]
            if held and tuple(names[0]) != last:
                yield compared(pa.Table.from_batches(held))
                held = []
            for s, e in zip(cuts, cuts[1:], strict=False):
                held.append(batch.slice(s, e - s))
                if e < batch.num_rows:
                    yield compared(pa.Table.from_batches(held))
                    held = []
            last = tuple(names[-1])
        if held:
            yield compared(pa.Table.from_batches(held))

    return run


def found_links(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """node, links, root for `vectors` (node, vector, copies; written): parts of each vector's number of links, and a spanning forest."""
    width, hashes, tables = parameters(vectors.count(), cosine, recall)
    keys = durable(signed(vectors, width, hashes, tables))
    rows = keys.select("node", F.posexplode("keys").alias("table", "key"))
    buckets = durable(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    cuts = F.ceil(F.col("size") / tile).cast("int")
    rows = attach(rows, buckets, ["key"], "size").withColumn("side", F.pmod(F.xxhash64("node"), cuts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    rows = rows.select("key", "table", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node")
    rows = rows.join(vectors.select("node", "vector", "copies"), "node").join(keys, "node")
    rows = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    return rows.mapInArrow(_tiles(cosine), "node long, links long, root long")


def near_embeddings(df: DataFrame, column: str = "embedding", cosine: float = COSINE, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("vector"))
    fit = usable(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    alone = rows.where(~F.coalesce(fit, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    vectors = rows.where(fit).groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    vectors = durable(vectors.select(F.monotonically_increasing_id().alias("node"), "vector", "copies", "first_id"))
    found = durable(found_links(vectors, cosine, recall, tile))
    roots = durable(star_components(found.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b"))))
    few = roots.count() <= BROADCAST_ROWS
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = vectors.select("node", "copies", "first_id").join(links, "node", "left").join((F.broadcast(roots) if few else roots).withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left")
    named = durable(named.select("node", "copies", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")))
    heads = roots.select("root").distinct()
    several = named.join(F.broadcast(heads) if few else heads, "root", "left_semi")
    smallest = durable(several.groupBy("root").agg(F.min("first_id").alias("smallest"), F.count("*").alias("size")))
    named = attach(named, smallest, ["root"], "size", "left")
    named = durable(named.select("node", "copies", "first_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "first_id").alias("component_id")))
    single = named.where("copies = 1").select(F.col("first_id").alias("vec_id"), "n_links", "component_id")
    known = durable(vectors.where("copies > 1").select("node", "vector").join(named, "node").select("vector", "copies", "n_links", "component_id"))
    copied = attach(rows.where(fit), known, ["vector"], "copies", most=_BROADCAST_VECTORS).select("vec_id", "n_links", "component_id")
    both = single.unionByName(copied).unionByName(alone)
    return both.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
