"""Small pieces that several operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that Python workers get at once; whole texts go along, so Spark's 10,000 would be tens of MB each time.
ROWS_AT_ONCE = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds what Spark and its Python workers hold of texts on their way between them, for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the session's spark.checkpoint.dir. Only a session on one machine may
    leave it unset; on a cluster a folder of one machine would go with it.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoint_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-", dir=os.environ.get("TMPDIR")))


def written(df: DataFrame) -> DataFrame:
    """`df` as a table of columns in the checkpoint folder: for wide rows of which later steps read a part, and which compress well."""
    context = df.sparkSession.sparkContext
    _checkpoint_folder(df.sparkSession)
    path = f"{context._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", "parquet.block.size": 1 << 24}).parquet(path)  # what a task holds of it
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows of a few numbers (about 100 bytes each in memory) up to which a table is broadcast.
BROADCAST_ROWS = 200_000
#: Rows of one key from which it is joined apart from the others.
HOT_ROWS = 1 << 17


def attach(rows: DataFrame, known: DataFrame, key: list[str], size: str, how: str = "inner", most: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`rows` joined to `known` (written), which has each key once and in `size` how many rows have it.

    A small `known` is broadcast. Of a large one only the keys that very many rows have are, of
    which there are at most rows / hot_rows, so that no hot key is moved to one task.
    """
    if known.count() <= most:
        return rows.join(F.broadcast(known), key, how)
    while (hot := durable(known.where(F.col(size) >= hot_rows))).count() > most:
        hot_rows *= 16
    if hot.isEmpty():
        return rows.join(known, key, how)
    first = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(known.where(F.col(size) < hot_rows), key, how)
    return first.unionByName(rest)


def text_key(text: Column) -> Column:
    """What tells rows with one doc_id apart."""
    return F.xxhash64(text)


def without(docs: DataFrame, dropped: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """The rows of docs but for those with the doc_id and text_key() of a row of `dropped`.

    Of the rows that `several` (doc_id, text_key, group) names one of each group stays,
    whichever it may be of equal ones. Null ids are ids like any other.
    """
    names = [n + "_" * max(map(len, docs.columns)) for n in ("id", "key", "group")]  # no column is called so
    named = docs.withColumn(names[1] + "own", text_key(F.col("text")))
    own = [docs[c] for c in docs.columns]

    def meet(rows: DataFrame, how: str, *more: str) -> DataFrame:
        other = rows.select(F.col("doc_id").cast("long").alias(names[0]), F.col("text_key").alias(names[1]), *more)
        few = rows.count() <= BROADCAST_ROWS
        return named.join(F.broadcast(other) if few else other, named["doc_id"].cast("long").eqNullSafe(F.col(names[0])) & (F.col(names[1] + "own") == F.col(names[1])), how)

    dropped = dropped.select("doc_id", "text_key")
    several = durable(several.select("doc_id", "text_key", "group").distinct()) if several is not None else None
    if several is None or several.isEmpty():
        return meet(durable(dropped.distinct()), "left_anti").select(*own)
    rest = meet(durable(dropped.unionByName(several.select("doc_id", "text_key")).distinct()), "left_anti").select(*own)
    row = F.struct(*own)
    one = meet(several, "inner", F.col("group").alias(names[2])).groupBy(names[2]).agg(F.min_by(row, F.to_json(row)).alias(names[0]))
    return rest.unionByName(one.select(f"{names[0]}.*"))
