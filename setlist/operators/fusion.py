"""Event rows from several sources made one list; manifests and stores of what is known already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setlist.functions.dates import strip
from setlist.functions.names import clean_line

LOW_RESULT = 3
IMAGE_TYPES = ["jpg", "jpeg", "png", "webp"]
MAX_BYTES, MAX_SIDE, MAX_PIXELS = 12 * 1024 * 1024, 12_000, 12_000_000


def performer_key(performer: Column) -> Column:
    """Lower-case letters, digits and underscores of a recognised performer; one that has nothing else needs no cleaning."""
    cleaned = F.regexp_replace(clean_line(performer), r"(?U)[^\w一-鿿]", "")
    return F.lower(F.when(performer.rlike(r"(?U)^\w++\z"), performer).otherwise(cleaned))


def deduplicated(events: DataFrame, group: list[str], order: str = "ord") -> DataFrame:
    """One row for each group, date and performer key: the first with a venue, else the first; `order` is that of the first. Blank keys go."""
    rest = [c for c in events.columns if c not in (*group, order)]
    # Equal rows become one before anything is worked out of them: keys are those of distinct names.
    rows = events.groupBy(*group, *rest).agg(F.min(order).alias(order)).withColumn("pkey", performer_key(F.col("performer"))).where("pkey <> ''")
    best = F.min_by(F.struct(*rest), F.struct(F.col("venue") == "", order)).alias("e")
    return rows.groupBy(*group, F.col("date_text").alias("_date"), "pkey").agg(best, F.min(order).alias(order)).select(*group, order, "e.*")


def fused(results: DataFrame) -> DataFrame:
    """note_id, ord and the deduplicated events of results (note_id, batch_index, attempt_ord, events array<struct(date_text, performer, venue)>, error) without error."""
    usable = results.where((F.coalesce("error", F.lit("")) == "") & (F.size("events") > 0))
    rows = usable.select("note_id", "batch_index", "attempt_ord", F.posexplode("events").alias("pos", "e"))
    return deduplicated(rows.select("note_id", F.struct("batch_index", "attempt_ord", "pos").alias("ord"), "e.*"), ["note_id"])


def accepted_attempts(results: DataFrame, threshold: int = LOW_RESULT, fallback: bool = True) -> DataFrame:
    """note_id, batch_index, upto: the attempts of a batch up to `upto` are merged; null: the batch failed.

    The first attempt with `threshold` rows ends the search, and so do all earlier low ones once two or more
    agree on their keys. Without fallback only the first attempt counts, with any rows.
    """
    keys = F.sort_array(F.array_distinct(F.filter(F.transform("events", lambda e: F.struct(e["date_text"].alias("d"), performer_key(e["performer"]).alias("k"))), lambda x: x["k"] != "")))
    good = (F.coalesce("error", F.lit("")) == "") & (F.size("events") > 0)
    item = F.struct("attempt_ord", good.alias("good"), F.size("events").alias("n"), keys.alias("keys"))
    batches = results.groupBy("note_id", "batch_index").agg(F.sort_array(F.collect_list(item)).alias("tries"))
    if not fallback:
        first = F.element_at("tries", 1)
        return batches.select("note_id", "batch_index", F.when(first["good"], first["attempt_ord"]).alias("upto"))
    key_type = "array<struct<d:string,k:string>>"
    begin = F.struct(F.lit(None).cast("int").alias("upto"), F.lit(None).cast(key_type).alias("keys"), F.lit(0).alias("low"), F.lit(True).alias("same"))

    def step(s: Column, x: Column) -> Column:
        same = s["same"] & ((s["low"] == 0) | (x["keys"] == s["keys"])) & (F.size(x["keys"]) > 0)
        low = F.struct(F.when(same & (s["low"] >= 1), x["attempt_ord"]).cast("int").alias("upto"), F.coalesce(s["keys"], x["keys"]).alias("keys"), (s["low"] + 1).alias("low"), same.alias("same"))
        enough = F.struct(x["attempt_ord"].cast("int").alias("upto"), s["keys"].alias("keys"), s["low"].alias("low"), s["same"].alias("same"))
        return F.when(s["upto"].isNotNull() | ~x["good"], s).when(x["n"] >= threshold, enough).otherwise(low)

    return batches.select("note_id", "batch_index", F.aggregate("tries", begin, step)["upto"].alias("upto"))


def published(results: DataFrame, threshold: int = LOW_RESULT, fallback: bool = True) -> DataFrame:
    """note_id, failed, total, and the fused events (note_id, ord, ...) of notes all of whose batches were accepted."""
    attempts = accepted_attempts(results, threshold, fallback)
    whole = attempts.groupBy("note_id").agg(F.count_if(F.col("upto").isNull()).alias("failed")).where("failed = 0").select("note_id")
    rows = results.join(attempts, ["note_id", "batch_index"]).where(F.col("attempt_ord") <= F.col("upto")).join(whole, "note_id", "left_semi")
    return fused(rows.select(*results.columns))


def batch_status(attempts: DataFrame) -> DataFrame:
    """note_id, failed, total of accepted_attempts()."""
    return attempts.groupBy("note_id").agg(F.count_if(F.col("upto").isNull()).alias("failed"), F.count("*").alias("total"))


def valid_images(manifest: DataFrame, max_bytes: int = MAX_BYTES, max_side: int = MAX_SIDE, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Rows of (filename, size_bytes, width, height) with a known type and within the limits."""
    kind = F.lower(F.regexp_extract(strip(F.col("filename")), r"[^/.]\.([A-Za-z0-9]+)$", 1))
    side = lambda c: F.col(c).between(1, max_side)
    return manifest.where(kind.isin(*IMAGE_TYPES) & F.col("size_bytes").between(1, max_bytes) & side("width") & side("height") & (F.col("width").cast("long") * F.col("height") <= max_pixels))


def split_by_store(inputs: DataFrame, store: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Inputs that the store has under all of `keys`, and those to work on."""
    known = store.select(*keys).distinct()
    return inputs.join(known, keys, "left_semi"), inputs.join(known, keys, "left_anti")


def refreshed(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a store with new ones in place of those with the same keys; sources.store.Store does so for what is written."""
    return store.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
