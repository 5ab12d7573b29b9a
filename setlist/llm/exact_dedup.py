"""Exact deduplication by skew-safe combining.

A first pass gives each row its digest. Rows whose digest nobody shares are done. The
texts of the others are combined in three stages, each of which groups by the digest
and the full normalised text, so that rows are equal only if their contents are:
each task combines its own rows of equal text and passes on one row for each; these
are merged within salts (a salt is a class of input partitions, so a hot text meets
itself in many tasks); and the salts' winners are combined globally.

The rows then look up their winner by digest, a second hash and the length; the winners
of hot texts are broadcast, so no task gets all rows of one. Should two different texts
ever share all three, the job fails and says so.

Defined results: a null text counts as empty; texts are equal when identical after
lower-casing A-Z only; of equal ones the largest doc_id stays, and of repeated rows
with that doc_id each is marked kept; rows with a null doc_id stay only if their
group has no other; an empty table gives an empty one; other columns are not read.
without_duplicates() keeps one row of each text, of repeated rows too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlist.llm.common import BROADCAST_ROWS, attach, durable, text_key, without

SALTS = 16
KEY = ["digest", "hash", "bytes"]


def normalised(text: bytes | None) -> bytes:
    """A text in UTF-8 with A-Z lower-cased: bytes.lower() knows ASCII only."""
    return (text or b"").lower()


def digests(docs: DataFrame, with_content: bool = False) -> DataFrame:
    """doc_id, text_key, digest (SHA-256), hash (XXH64) and bytes (length) of each row's normalised text, and its content if asked for."""
    fields = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("digest", pa.binary()), ("hash", pa.int64()), ("bytes", pa.int64()), ("content", pa.binary())]
    arrow = pa.schema(fields if with_content else fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [normalised(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                columns = [
                    part.column(0),
                    part.column(2),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    pa.array([xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.binary())] * with_content, schema=arrow)

    schema = "doc_id long, text_key long, digest binary, hash long, bytes long" + ", content binary" * with_content
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key")).mapInArrow(run, schema)


def shared_groups(docs: DataFrame, own: DataFrame, salts: int = SALTS) -> DataFrame:
    """digest, hash, bytes, keep_id, group_size for each text that several rows have; `own`: digests(docs)."""
    shared = durable(own.groupBy("digest").count().where("count > 1").select("digest"))
    rows = digests(docs, with_content=True).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    rows = rows.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, "digest", "left_semi")
    largest, size = F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    salted = rows.groupBy("salt", *KEY, "content").agg(largest, size)
    groups = salted.groupBy(*KEY, "content").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = groups.groupBy(*KEY).agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts"))
    sure = F.when(F.col("texts") > 1, F.raise_error(F.lit("different texts with one SHA-256, XXH64 and length"))).otherwise(F.col("group_size"))
    return groups.select(*KEY, "keep_id", sure.cast("long").alias("group_size"))


def marked(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """doc_id, text_key, keep_id, group_size, kept, text_sha256 for each row."""
    own = durable(digests(docs))
    groups = durable(shared_groups(docs, own, salts))
    rows = attach(own, groups, KEY, "group_size", "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select(
        "doc_id",
        "text_key",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row."""
    return marked(docs, salts).drop("text_key")


def without_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row of docs for each text: one with the largest doc_id."""
    rows = durable(marked(docs, salts).where("group_size > 1"))
    again = rows.where("kept").groupBy("text_sha256").count().where("count > 1").select("text_sha256")
    again = rows.where("kept").join(again, "text_sha256", "left_semi").withColumnRenamed("text_sha256", "group")
    return without(docs, rows.where("not kept"), again)
