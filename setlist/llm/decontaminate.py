"""Benchmark decontamination by winnowing.

Every text keeps, of each `window` consecutive k-gram hashes, the smallest (the last
of equal ones). Two texts that share `k + window - 1` words in a row share a
fingerprint, so with the default k = 7 and window = 7 no shared span of 13 words is
missed. Training fingerprints are joined to those of the benchmark; a hit is extended to
the spans of 13 words around it, and these are joined to the spans of the items, by two
independent 64-bit hashes of all their words. Only numbers are joined, never texts, and a
span knows the set of its items by name, so one phrase that all items and documents have
costs a row for each document.

Defined results: a null or empty text has no words and is not contaminated; a null or
empty item is skipped, one with a null id marks words but is not listed; an item of fewer
words than a span is one span, found by hashes of exactly its length; repeated rows each
give a row, equal and overlapping spans count once; an empty table of documents gives an
empty one, of items no hits; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setlist.llm.common import BROADCAST_ROWS, attach, durable, text_key
from setlist.llm.words import ALNUM, ALNUM_PATTERN, OTHER_GRAM, Words, find_words, gram_hashes, text_slices

SPAN = 13

_WORD = re.compile(ALNUM_PATTERN)
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_ASCII_LOWER))


def winnow(hashes: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Positions that some window chooses; `ends`: for each position where its text's hashes end."""
    n = hashes.size
    if n < window:
        return np.zeros(0, np.int64)
    m = n - window + 1
    least = hashes[:m].copy()
    for j in range(1, window):
        np.minimum(least, hashes[j : m + j], out=least)
    chosen = np.zeros(m, np.int64)
    for j in range(window):
        chosen[hashes[j : m + j] == least] = j
    full = np.arange(m) + window <= ends[:m]
    keep = np.zeros(n, bool)
    keep[(np.arange(m) + chosen)[full]] = True
    return np.flatnonzero(keep)


def _fingerprints(words: Words, span: int, k: int, short: list[int]) -> tuple[np.ndarray, ...]:
    """(words per text, text, position, hash) of the winnowed k-grams and all n-grams for n in `short`."""
    hashes, text = words.hashes(), words.text_of_word()
    grams, at = gram_hashes(hashes, words.of_text, k)
    per_text = np.bincount(text[at], minlength=words.of_text.size - 1)
    ends = np.repeat(np.cumsum(per_text), per_text)
    keep = winnow(grams, ends, span - k + 1)
    found = [(at[keep], grams[keep])]
    for n in short:
        grams, at = gram_hashes(hashes, words.of_text, n)
        found.append((at, grams ^ np.uint64(n)))
    at = np.concatenate([x for x, _ in found])
    grams = np.concatenate([x for _, x in found])
    return np.diff(words.of_text), text[at], at - words.of_text[text[at]], grams


def marks_of(words: Words, marks: np.ndarray) -> np.ndarray:
    """For each text the bits of the marks (hashes of words, 63 at most) that it has."""
    found = np.zeros(words.of_text.size - 1, np.int64)
    if marks.size and words.starts.size:
        order = marks.argsort()
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(marks[order], hashes), marks.size - 1)
        there = marks[order][at] == hashes
        np.bitwise_or.at(found, words.text_of_word()[there], np.int64(1) << order[at[there]])
    return found


def fingerprint_rows(df: DataFrame, key: str, text: str, span: int, k: int, short: list[int], marks: list[str] = ()) -> DataFrame:
    """A row (key, text_key, n_words, position -1) for each text and one (position, hash) for each fingerprint; marks: which of these words the text has, as bits."""
    schema = "key long, text_key long, n_words long, position int, hash long, marks long"
    arrow = pa.schema([("key", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("position", pa.int32()), ("hash", pa.int64()), ("marks", pa.int64())])
    listed = " ".join(marks).encode()
    wanted = find_words(np.frombuffer(listed, np.uint8), np.array([0, len(listed)]), ALNUM).hashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(2)):
                words = find_words(data, offsets, ALNUM)
                n_words, of, position, grams = _fingerprints(words, span, k, short)
                rows = np.concatenate([np.arange(last - first), of])
                own = pa.array(first + rows)
                text_key = batch.column(1).take(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(own),
                        text_key,
                        pa.array(np.concatenate([n_words, np.zeros(of.size, np.int64)])),
                        pa.array(np.concatenate([np.full(last - first, -1, np.int32), position.astype(np.int32)])),
                        pa.array(np.concatenate([text_key[: last - first].to_numpy(), grams.view(np.int64)])),
                        pa.array(marks_of(words, wanted)[rows]),
                    ],
                    schema=arrow,
                )

    rows = df.select(F.col(key).cast("long").alias("key"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)


def _item_rows(span: int, k: int):
    """(item, n, a, b) of (item, text) rows: for n = 0 a fingerprint `a`, else a span of n words by its two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1)):
                words = find_words(data, offsets, ALNUM)
                hashes, text, size = words.hashes(), words.text_of_word(), np.diff(words.of_text)
                grams, at = gram_hashes(hashes, words.of_text, k)
                long = size[text[at]] >= span
                grams, at = grams[long], at[long]
                per_text = np.bincount(text[at], minlength=last - first)
                keep = winnow(grams, np.repeat(np.cumsum(per_text), per_text), span - k + 1)
                found = [(text[at[keep]], 0, grams[keep], grams[keep])]
                for n in sorted({*size[size < span].tolist(), span} - {0}):
                    one, at = gram_hashes(hashes, words.of_text, n)
                    own = np.flatnonzero((size[text[at]] >= span) if n == span else (size[text[at]] == n))
                    found.append((text[at[own]], n, one[own], gram_hashes(words.hashes(1), words.of_text, n, OTHER_GRAM)[0][own]))
                    if n < span:
                        found.append((text[at[own]], 0, one[own] ^ np.uint64(n), one[own]))
                of, a, b = (np.concatenate([x[i] for x in found]) for i in (0, 2, 3))
                n = np.concatenate([np.full(x[0].size, x[1], np.int32) for x in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + of)), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["item", "n", "a", "b"])

    return run


def _spans_around(span: int, k: int, short: list[int]):
    """(key, text_key, start, n, a, b) of the spans around the hits at places `at` of (key, text_key, text, at) rows."""
    arrow = pa.schema([("key", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(2)):
                words = find_words(data, offsets, ALNUM)
                hashes, text = words.hashes(), words.text_of_word()
                places = batch.column(3)[first:last]
                at = words.of_text[np.repeat(np.arange(last - first), np.asarray(places.value_lengths()))] + places.flatten().to_numpy()
                for n in [span, *short]:
                    # Spans begin up to span - k words before a fingerprint's place; short ones are found by their own.
                    before = span - k if n == span else 0
                    edge = np.zeros(hashes.size + 1, np.int64)
                    np.add.at(edge, np.maximum(at - before, words.of_text[text[at]] if at.size else at), 1)
                    np.add.at(edge, at + 1, -1)
                    one, start = gram_hashes(hashes, words.of_text, n)
                    own = np.flatnonzero(np.cumsum(edge)[start] > 0)
                    of = text[start[own]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(first + of)),
                            batch.column(1).take(pa.array(first + of)),
                            pa.array(start[own] - words.of_text[of]),
                            pa.array(np.full(own.size, n, np.int32)),
                            pa.array(one[own].view(np.int64)),
                            pa.array(gram_hashes(words.hashes(1), words.of_text, n, OTHER_GRAM)[0][own].view(np.int64)),
                        ],
                        schema=arrow,
                    )

    return run


def shared_spans(docs: DataFrame, benchmark: DataFrame, span: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, text_key, n_words) of every document, (key, text_key, start, n, items_set) of the spans that it shares with items, and (items_set, items)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    rows = durable(items.mapInArrow(_item_rows(span, k), "item string, n int, a long, b long"))
    short = sorted(r.n for r in rows.where(f"n between 1 and {span - 1}").select("n").distinct().collect())  # span - 1 at most
    spans = rows.where("n > 0").groupBy("n", "a", "b").agg(F.sort_array(F.collect_set("item")).alias("items"))
    spans = durable(spans.withColumn("items_set", F.md5(F.to_json("items"))))
    sets = durable(spans.groupBy("items_set").agg(F.first("items").alias("items")))  # equal ones
    spans = spans.drop("items")
    marks = durable(rows.where("n = 0").select(F.col("a").alias("hash")).distinct().withColumn("known", F.lit(True)))

    found = fingerprint_rows(docs, "doc_id", "text", span, k, short)
    found = found.join(F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks, "hash", "left")
    found = durable(found.where("position < 0 or known").select("key", "text_key", "n_words", "position"))
    hits = found.where("position >= 0")
    near = hits.groupBy("key", "text_key").agg(F.collect_set("position").alias("at"))
    whole = docs.select(F.col("doc_id").cast("long").alias("key"), text_key(F.col("text")).alias("text_key"), "text")
    near = F.broadcast(near) if hits.count() <= BROADCAST_ROWS else near
    texts = whole.join(near, (whole.text_key == near.text_key) & whole.key.eqNullSafe(near.key)).select(whole.key, whole.text_key, "text", "at")
    around = texts.mapInArrow(_spans_around(span, k, short), "key long, text_key long, start long, n int, a long, b long")
    if spans.count() > BROADCAST_ROWS:
        around = durable(around)
        spans = durable(spans.join(around.groupBy("n", "a", "b").agg(F.count("*").alias("rows")), ["n", "a", "b"]))
    else:
        spans = spans.withColumn("rows", F.lit(0))
    shared = attach(around, spans, ["n", "a", "b"], "rows").select("key", "text_key", "start", "n", "items_set").distinct()
    return found.where("position < 0").select("key", "text_key", "n_words"), durable(shared), sets


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = 7) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items (sorted ids as strings), spans (word ranges that are hit) for each document."""
    all_docs, shared, sets = shared_spans(docs.select("doc_id", "text"), benchmark, span, k)
    one = ["key", "text_key"]
    order = Window.partitionBy(*one).orderBy("start", "n")
    end = F.col("start") + F.col("n")
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = shared.withColumn("apart", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*one, "run").agg(F.min("start").alias("start"), F.max(end).alias("end"))
    runs = runs.groupBy(*one).agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = shared.select(*one, "items_set").distinct()
    named = named.join(F.broadcast(sets) if sets.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0] <= BROADCAST_ROWS else sets, "items_set")
    named = named.groupBy(*one).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hit = durable(runs.join(named, (runs.text_key == named.text_key) & runs.key.eqNullSafe(named.key)).select(runs.key, runs.text_key, "n_hit", "spans", "items"))
    joined = all_docs.join(hit, (all_docs.text_key == hit.text_key) & all_docs.key.eqNullSafe(hit.key), "left")
    return joined.select(
        all_docs.key.alias("doc_id"), all_docs.text_key, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans")
    )


def contaminated(n_words, n_hit):
    """The rule on column values: at least one hit word and at least one word in twenty hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
