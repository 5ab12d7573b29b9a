"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and their beginnings of three to six letters, as 64-bit
hashes. Those that a few learnt texts have are features, whether or not they go with the
label on their own; a factorization machine learns a weight for each and a vector whose
inner products weigh pairs, so that an insult next to a group's mention can count for more
than both alone. The solver's steps are alike for all features, so their values are a
prior: one that goes with the label (or against it) far beyond chance counts in full, a
neutral one for LEAST_VALUE. That keeps rare words, of which long texts have thousands,
from adding up to a verdict, and leaves neutral words to be learnt in pairs.

Only a bounded sample of labelled rows is learnt from, one text of each family of near
copies (those with one smallest shingle hash); every row is scored.

Defined results: a null or empty text scores as one without terms; where one class has
no labelled row, all texts score the share of toxic labels (0 for none); of several
labels of one doc_id the largest counts; repeated rows each give a row; very long texts
are scored whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlist.llm.common import durable, held_out
from setlist.llm.words import ALNUM, Words, find_words, gram_hashes, text_slices

#: Labelled rows of each class to learn from, at most.
TOXIC_ROWS, CLEAN_ROWS = 3000, 5000
#: Rows that have a feature at least, and features at most; beyond it those of the least values go.
ROWS_WITH, FEATURES = 3, 1 << 16
#: Log-likelihood ratio with the label from which a feature counts in full, and the value of a neutral one.
RATIO, LEAST_VALUE = 28.0, 0.1
FACTORS, ROUNDS, STEP = 4, 60, 0.1
_CACHE = 40_000


def word_terms(word: str) -> list[int]:
    """Hashes of a lower-cased word and of its beginnings."""
    own = [xxhash.xxh64_intdigest("=" + word)]
    return own + [xxhash.xxh64_intdigest("^" + word[:n]) for n in range(3, min(len(word), 6) + 1)]


@dataclass
class Machine:
    """terms: hash of each feature to its place; score = sigmoid(bias + weights + products of vectors)."""

    terms: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Of n texts, from distinct (text, feature) pairs."""
        sums = lambda of: np.bincount(text, of[feature], n)
        linear, squares = sums(self.weights), sums((self.vectors**2).sum(axis=1))
        total = np.stack([sums(v) for v in self.vectors.T], axis=1)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + ((total**2).sum(axis=1) - squares) / 2, -500, 500)))


class WordFeatures:
    """Features of words, by word hash; holds the words met lately, the oldest half goes first."""

    def __init__(self, terms: dict[int, int], size: int = _CACHE) -> None:
        self.terms, self.size, self.places = terms, size, max(terms.values(), default=0) + 1
        self.new: dict[int, tuple[int, ...]] = {}
        self.old: dict[int, tuple[int, ...]] = {}

    def pairs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) pairs."""
        hashes, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        new, old, flat, hit = self.new, self.old, words.data.tobytes(), {}
        for i, (h, s, e) in enumerate(zip(hashes.tolist(), words.starts[first].tolist(), words.ends[first].tolist(), strict=True)):
            own = new.get(h)
            if own is None:
                own = old.get(h)
                if own is None:
                    own = tuple(self.terms[t] for t in word_terms(flat[s:e].decode()) if t in self.terms)
                new[h] = own
            if own:
                hit[i] = own
        n = self.places
        sizes, places = np.zeros(hashes.size, np.int64), np.fromiter(chain.from_iterable(hit.values()), np.int64)
        sizes[list(hit)] = [len(x) for x in hit.values()]
        begin = np.cumsum(sizes) - sizes
        # Each word once a text, then each feature once a text.
        once = np.unique(words.text_of_word() * np.int64(max(1, hashes.size)) + inverse)
        text, word = once // max(1, hashes.size), once % max(1, hashes.size)
        own = sizes[word]
        at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(begin[word], own)
        both = np.unique(np.repeat(text, own) * n + places[at])
        return both // n, both % n


def _text_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(family, label, terms) of (text, label) rows."""
    arrow = pa.schema([("family", pa.int64()), ("label", pa.int32()), ("terms", pa.list_(pa.int64()))])
    for batch in batches:
        family, terms = [], []
        for _, _, data, offsets in text_slices(batch.column(0)):
            words = find_words(data, offsets, ALNUM)
            grams, at = gram_hashes(words.hashes(), words.of_text, 5)
            flat = words.data.tobytes()
            for i in range(offsets.size - 1):
                low, high = words.of_text[i], words.of_text[i + 1]
                own = grams[np.searchsorted(at, low) : np.searchsorted(at, high)]
                text = flat[offsets[i] : offsets[i + 1]]
                family.append(int(own.min()) if own.size else xxhash.xxh64_intdigest(text))
                distinct = {flat[s:e] for s, e in zip(words.starts[low:high].tolist(), words.ends[low:high].tolist(), strict=True)}
                terms.append(np.array(sorted({t for w in distinct for t in word_terms(w.decode())}), np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(family, np.uint64).view(np.int64)), batch.column(1), pa.array(terms, pa.list_(pa.int64()))], schema=arrow)


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int) -> DataFrame:
    """text, label of the labelled rows to learn from: for each class those with the smallest id hashes."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    order = [F.xxhash64(F.lit("sample"), "doc_id"), "doc_id"]
    ids = known.where("label = 1").orderBy(*order).limit(toxic_rows).unionByName(known.where("label = 0").orderBy(*order).limit(clean_rows))
    return docs.select("doc_id", "text").join(F.broadcast(durable(ids)), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "label")


def known_terms(rows: DataFrame, limit: int, rows_with: int) -> list[tuple[int, float]]:
    """(hash, value) of the terms that `rows_with` of the (label, terms) rows have, at most `limit`: the largest values and the most rows first."""
    n, toxic = rows.agg(F.count("*"), F.sum("label")).first()
    share = toxic / n
    terms = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("a"), F.count("*").alias("n")).where(F.col("n") >= rows_with)

    def part(seen, of, rate):
        return F.when(seen > 0, seen * F.log(seen / (of * rate))).otherwise(0.0)

    a, m = F.col("a").cast("double"), F.col("n").cast("double")
    rest = F.lit(float(n)) - m
    score = 2 * (part(a, m, F.lit(share)) + part(m - a, m, F.lit(1 - share)) + part(toxic - a, rest, F.lit(share)) + part(n - toxic - (m - a), rest, F.lit(1 - share)))
    value = F.least(F.lit(1.0), F.greatest(F.lit(LEAST_VALUE), score / RATIO))
    return [(r.term, r.value) for r in terms.withColumn("value", value).orderBy(F.desc("value"), F.desc("n"), "term").limit(limit).select("term", "value").collect()]


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, features: int = FEATURES, seed: int = 7) -> Machine:
    """Learns from rows whose ids are not held out; sends the terms and the machine to the driver."""
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.linalg import Vectors, VectorUDT

    sample = labelled_sample(docs, labels, toxic_rows, clean_rows)
    rows = sample.mapInArrow(_text_terms, "family long, label int, terms array<long>")
    rows = durable(rows.groupBy("family").agg(F.max(F.struct("label", "terms")).alias("x")).select("x.label", "x.terms"))
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    chosen = known_terms(rows, features, ROWS_WITH) if 0 < toxic < n else []
    if not chosen:
        share = toxic / n if n else 0.0
        return Machine({}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(0), np.zeros((0, 1)))
    place = {t: i for i, (t, _) in enumerate(chosen)}
    value = np.array([x for _, x in chosen])

    @F.udf(VectorUDT())
    def vector(terms):
        own = sorted(place[t] for t in terms if t in place)
        return Vectors.sparse(value.size, own, value[own])

    data = durable(rows.select(F.col("label").cast("double").alias("label"), vector("terms").alias("features")).repartition(2))
    model = FMClassifier(factorSize=FACTORS, maxIter=ROUNDS, stepSize=STEP, regParam=1e-4, initStd=0.05, solver="adamW", seed=seed).fit(data)
    return Machine({t & ((1 << 64) - 1): i for t, i in place.items()}, float(model.intercept), model.linear.toArray() * value, model.factors.toArray() * value[:, None])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score for each row."""
    arrow = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordFeatures(machine.terms)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, last, data, offsets in text_slices(batch.column(1)):
                text, feature = words_of.pairs(find_words(data, offsets, ALNUM))
                scores[first:last] = machine.scores(text, feature, last - first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    scored = score(docs, fit(docs, labels, **options))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score under `threshold`, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordFeatures(machine.terms)
        for batch in batches:
            clean = np.zeros(batch.num_rows, bool)
            for first, last, data, offsets in text_slices(batch.column(at)):
                text, feature = words_of.pairs(find_words(data, offsets, ALNUM))
                clean[first:last] = machine.scores(text, feature, last - first) < threshold
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
