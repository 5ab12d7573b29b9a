"""Vector codes: each vector's parts are replaced by the numbers of their nearest codebook entries.

Components become integers, vectors are cut into equal parts, and each part position gets
a codebook that starts as that part of the vectors with the smallest ids and is moved to
the means of its parts in a few rounds.

The nearest entries are found by LAESA. Each part position has a few fixed pivots, taken
from its first codebook by farthest-first choice. The distances of all parts to their
pivots are computed once and kept with the vectors. A round computes only those between
pivots and entries: the largest difference |d(part, pivot) - d(entry, pivot)| bounds the
distance of part and entry from below, so a part looks at its entries in the order of that
bound, evaluates their exact integer distances, and stops at the first bound beyond the
best one found. Bounds carry a margin for rounding; distances are integers throughout.

Tasks add up their own parts by entry, so a round moves at most a row for each entry and
position from each task, and the driver gets the sums of the entries alone.

Defined results: rows whose vector is null, empty or of a length that parts don't divide,
or has null or non-finite components, are dropped; so are those that have not the length
that most rows have (of equally frequent ones the smallest). Integers beyond 2^26 in size
count as that. Null ids come after all others, and of rows with one id the one with the
smaller integers is first. Repeated rows each give a row. With fewer vectors than entries
a codebook has an entry for each vector. An empty table gives an empty one; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setlist.llm.common import attach, durable

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
PIVOTS = 4
#: Largest integer in size; squared distances of parts of up to 512 components stay below 2^63.
MOST = 1 << 26
#: Share of two distances by which their difference is lowered: they are kept as 32-bit floats.
_SLACK = 1e-6
_ROWS = 1000


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    wrong = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: wrong(x.cast("double"))), F.lit(False))


def integers(df: DataFrame, column: str = "embedding", parts: int = PARTS) -> DataFrame:
    """vec_id, label (as text; null if it is), whole (array of long) of the rows that are kept."""
    vector = F.col(column)
    rows = df.where(usable(vector) & (F.size(vector) % parts == 0))
    most = rows.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").first()
    whole = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(MOST)), F.lit(-MOST)))
    return rows.where(F.size(vector) == (most["size"] if most else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), whole.alias("whole"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis."""
    apart = a - b
    return (apart * apart).sum(axis=-1)


@dataclass
class Pivots:
    """points: the pivots of each part position, (parts, pivots, width)."""

    points: np.ndarray

    @classmethod
    def of(cls, book: np.ndarray, number: int = PIVOTS) -> Pivots:
        """From the entries of each part position: the first one, then each time the one farthest from those chosen."""
        chosen = np.zeros((len(book), 1), np.int64)
        every = np.arange(len(book))
        near = squared(book, book[:, :1])
        while chosen.shape[1] < min(number, book.shape[1]):
            far = near.argmax(axis=1)
            chosen = np.concatenate([chosen, far[:, None]], axis=1)
            near = np.minimum(near, squared(book, book[every, far][:, None]))
        return cls(book[every[:, None], chosen])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """(..., parts, pivots) of points (..., parts, width)."""
        return np.sqrt(squared(points[..., None, :], self.points).astype(np.float64))


class Search:
    """Nearest entries of parts by their pivot distances."""

    def __init__(self, book: np.ndarray, pivots: Pivots) -> None:
        self.book = book
        self.to_pivots = pivots.distances(book.swapaxes(0, 1)).swapaxes(0, 1)  # (parts, entries, pivots)
        self.evaluated = 0

    def nearest(self, points: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry (the lower of equally near ones) and squared distance for each of points (rows, parts, width)."""
        n, parts, width = points.shape
        entries = self.book.shape[1]
        lower = np.zeros((n, parts, entries))
        for k in range(to_pivots.shape[-1]):
            own, other = to_pivots[:, :, None, k].astype(np.float64), self.to_pivots[None, :, :, k]
            np.maximum(lower, np.abs(own - other) - _SLACK * (own + other), out=lower)
        lower = lower.reshape(n * parts, entries)
        order = lower.argsort(axis=1)
        points, part = points.reshape(n * parts, width), np.tile(np.arange(parts), n)
        best, entry = np.full(n * parts, np.iinfo(np.int64).max), np.full(n * parts, entries)
        rows = np.arange(n * parts)
        for step in range(entries):
            e = order[rows, step]
            may = lower[rows, e] ** 2 <= best[rows]
            rows, e = rows[may], e[may]
            if not rows.size:
                break
            d = squared(points[rows], self.book[part[rows], e])
            self.evaluated += rows.size
            better = (d < best[rows]) | (d == best[rows]) & (e < entry[rows])
            best[rows[better]], entry[rows[better]] = d[better], e[better]
        return entry.reshape(n, parts), best.reshape(n, parts)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    size = rows.nbytes // max(1, len(rows))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def with_pivots(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """vec_id, label, whole, near: the integers and their pivot distances as 32-bit values in binary columns."""
    parts, _, width = pivots.points.shape
    arrow = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("whole", pa.binary()), ("near", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                whole = part.column(2).flatten().to_numpy().reshape(-1, parts, width)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _binary(whole.astype(np.int32)), _binary(pivots.distances(whole).astype(np.float32))], schema=arrow)

    return rows.mapInArrow(run, "vec_id long, label string, whole binary, near binary")


def _searched(batches: Iterator[pa.RecordBatch], search: Search) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, integers, entries, distances) of the rows of with_pivots()."""
    parts, _, width = search.book.shape
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            rows = batch.slice(at, _ROWS)
            points = _matrix(rows.column("whole"), np.int32, parts, width).astype(np.int64)
            yield rows, points, *search.nearest(points, _matrix(rows.column("near"), np.float32, parts, search.to_pivots.shape[-1]))


def moved(rows: DataFrame, book: np.ndarray, pivots: Pivots) -> np.ndarray:
    """The codebook whose entries are the means of the parts that are nearest to them; entries without parts stay."""
    parts, entries, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for _, points, entry, _ in _searched(batches, Search(book, pivots)):
            cell = (entry + np.arange(parts) * entries).ravel()
            number += np.bincount(cell, minlength=parts * entries)
            for k in range(width):  # 1,000 rows of integers up to 2^26 add up exactly in a double
                total[:, k] += np.bincount(cell, points[:, :, k].ravel(), parts * entries).astype(np.int64)
        used = np.flatnonzero(number)
        columns = [np.repeat(used, width), np.tile(np.arange(width), used.size), np.repeat(number[used], width), total[used].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cell", "position", "number", "total"])

    sums = rows.mapInArrow(run, "cell long, position long, number long, total long").groupBy("cell", "position").agg(F.sum("number"), F.sum("total"))
    after = book.copy().reshape(parts * entries, width)
    for cell, position, number, total in sums.collect():  # a row for each component of the codebook at most
        after[cell, position] = total // number
    return after.reshape(book.shape)


def coded(rows: DataFrame, book: np.ndarray, pivots: Pivots) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error (squared distances summed over parts)."""
    arrow = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, entry, best in _searched(batches, Search(book, pivots)):
            codes = [row.tobytes().hex() for row in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(codes, pa.string()), pa.array(best.sum(axis=1), pa.int64())], schema=arrow)

    return rows.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(df: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error for each row that is kept; the codebooks (parts, entries, width)). At most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits: 1 to 256 entries")
    rows = integers(df, column, parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).collect()
    if not first:
        return df.sparkSession.createDataFrame([], "vec_id long, label string, code string, error long"), np.zeros((parts, 0, 0), np.int64)
    book = np.array([r.whole for r in first], np.int64).reshape(len(first), parts, -1).swapaxes(0, 1).copy()
    pivots = Pivots.of(book)
    rows = durable(with_pivots(rows, pivots))
    for _ in range(rounds):
        book = moved(rows, book, pivots)
    return coded(rows, book, pivots), book


def book_digest(book: np.ndarray) -> str:
    """SHA-256 of the components as decimal numbers, joined by commas, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def vector_codes(df: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error (errors summed over the rows of one label, nulls together), codebooks_sha256 for each row that is kept."""
    rows, book = compress(df, column)
    label = F.coalesce(F.concat(F.lit("="), "label"), F.lit("null"))
    rows = durable(rows.select("vec_id", label.alias("label"), "code", "error"))
    known = durable(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")))
    return attach(rows, known, ["label"], "rows").select("vec_id", "code", "error", "label_error", F.lit(book_digest(book)).alias("codebooks_sha256"))
