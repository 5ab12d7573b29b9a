"""Intermediate tables that several steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staged(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder: worked out once, kept when an executor is lost, and its plan ends there.

    The folder is the session's spark.checkpoint.dir. Only a session on one machine may leave it unset; on a cluster a
    folder of one machine would go with it. Tables are Parquet there, so a step reads no more than its columns and Spark knows
    which tables are small; what Parquet can't hold, columns without a type, is a checkpoint.
    """
    if "void" in df.schema.simpleString():
        _set_folder(df.sparkSession)
        return df.checkpoint(eager=True)
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` for a join with a table that grows as it does: both are shuffled, neither goes through the driver.

    Spark broadcasts what it takes for small by the bytes of files, packed ones, without the rows that explode() adds. Keys
    cut out of some MB of names are some hundred MB in memory.
    """
    return df.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the checkpoint folder, for tables that a job writes and reads back."""
    _set_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def _set_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
