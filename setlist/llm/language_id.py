"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary, learned by
expectation maximisation from a bounded sample of labelled texts. A text's likelihood in
a language is the product over its words of the summed probability of all segmentations
of the word, by the forward algorithm on the word's lattice.

Defined results: a null text and one without a letter get `und` with score 0; rows
without a language, or in the held-out fold, teach nothing; if nothing is left to learn from,
all texts get `und`; of languages that are equally likely the first by name is taken;
very long texts are scored whole; repeated rows each give a row; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlist.llm.common import durable, held_out
from setlist.llm.lattice import SPACE, Pieces, build, load_pieces, log_sums
from setlist.llm.words import find_words, text_slices

#: Labelled texts to learn from, for each language.
TEXTS = 800
ROUNDS = 3
#: Prior count of each piece in each language.
PRIOR = 0.05
#: A character of one of Unicode's letter categories.
_LETTER = regex.compile(r"\p{L}")
_CACHE = 200_000


#: ASCII case, digits, punctuation and control characters tell no language apart.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_INSIDE = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


def words_in(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8, lower-cased in ASCII, without what _KEPT drops."""
    return (text or b"").translate(_KEPT).split()


def units_of(words: list[bytes]) -> list[bytes]:
    mark = SPACE.encode()
    return [mark + w for w in words]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of (lang, text) rows."""
    for batch in batches:
        n: Counter[tuple[int, bytes]] = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            n.update((lang, w) for w in words_in(text))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in n], pa.int32()), pa.array([w for _, w in n], pa.binary()), pa.array(map(float, n.values()), pa.float64())], names=["lang", "word", "n"])


def _expected(path: str, log_p: np.ndarray):
    """Expected counts of each language's pieces in (lang, word, n) rows."""
    arrow = pa.schema([("lang", pa.int32()), ("piece", pa.int32()), ("n", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(path)
        total = np.zeros(log_p.shape)
        for batch in batches:
            lang, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            lattice = build(units_of(batch.column(1).to_pylist()), pieces)
            unit = lattice.unit
            weights = log_p[lang[unit], lattice.piece]
            alpha, beta = lattice.forward(weights), lattice.backward(weights)
            share = np.exp(alpha[lattice.start] + weights + beta[lattice.end] - beta[lattice.begin][unit])
            np.add.at(total, (lang[unit], lattice.piece), share * n[unit])
        lang, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[lang, piece])], schema=arrow)

    return run


def fit_languages(texts: DataFrame, path: str, per_language: int = TEXTS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and their log piece probabilities, from (doc_id, text, lang) rows; sends languages x pieces numbers to the driver."""
    known = texts.where(F.col("lang").isNotNull())
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    pieces = load_pieces(path)
    log_p = np.full((len(languages), len(pieces)), -np.log(len(pieces)))
    if not languages:
        return languages, log_p
    # An even share of each language's rows by a hash of the id, so that it's the same on every run.
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, per_language / sizes[lang])))])
    place = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    words = sample.select(place[F.col("lang")].alias("lang"), "text").mapInArrow(_word_counts, "lang int, word binary, n double")
    counts = durable(words.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        found = counts.mapInArrow(_expected(path, log_p), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        total = np.full(log_p.shape, PRIOR)
        for r in found.collect():
            total[r.lang, r.piece] += r.n
        log_p = np.log(total / total.sum(axis=1, keepdims=True))
    return languages, log_p


class WordScores:
    """Log likelihoods of words in each language, by word hash; holds the words met lately, the oldest half goes first."""

    def __init__(self, pieces: Pieces, log_p: np.ndarray, size: int = _CACHE) -> None:
        self.pieces, self.log_p, self.size = pieces, log_p, size
        self.new: dict[int, int] = {}
        self.old: dict[int, int] = {}
        self.rows, self.old_rows = np.zeros((0, len(log_p))), np.zeros((0, len(log_p)))

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The summed log likelihood of the words of each text in `data`."""
        words = find_words(data, offsets, _INSIDE)
        hashes, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.new) > self.size:
            self.old, self.old_rows, self.new, self.rows = self.new, self.rows, {}, self.rows[:0]
        keys = hashes.tolist()
        missing = [i for i, h in enumerate(keys) if h not in self.new]
        again = [i for i in missing if keys[i] in self.old]
        fresh = [i for i in missing if keys[i] not in self.old]
        self.new.update(zip([keys[i] for i in again + fresh], range(len(self.new), len(self.new) + len(missing)), strict=True))
        flat, starts, ends = words.data.tobytes(), words.starts[first[fresh]].tolist(), words.ends[first[fresh]].tolist()
        known = self.old_rows[[self.old[keys[i]] for i in again]] if again else self.rows[:0]
        units = units_of([flat[s:e] for s, e in zip(starts, ends, strict=True)])
        self.rows = np.concatenate([self.rows, known, log_sums(units, self.pieces, self.log_p)])
        at = np.array([self.new[h] for h in keys], np.int64)[inverse]
        # Each text is summed by itself, so that its score is the same in any batch.
        sums, full = np.zeros((offsets.size - 1, len(self.log_p))), np.diff(words.of_text) > 0
        if full.any():
            sums[full] = np.add.reduceat(self.rows[at], words.of_text[:-1][full], axis=0)
        return sums


def identify(docs: DataFrame, languages: list[str], log_p: np.ndarray, path: str) -> DataFrame:
    """doc_id, lang_pred, score (posterior of lang_pred) and log_likelihood in each language for each row."""
    arrow = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("log_likelihood", pa.list_(pa.float64()))])
    shared = docs.sparkSession.sparkContext.broadcast(log_p)  # languages x pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(load_pieces(path), shared.value) if languages else None
        for batch in batches:
            names, best, all_sums = [], [], []
            for first, last, data, offsets in text_slices(batch.column(1), 2 << 20):
                lettered = np.array([scores is not None and bool(_LETTER.search(t or "")) for t in batch.column(1)[first:last].to_pylist()])
                sums = np.zeros((last - first, 1)) if scores is None else scores.sums(data, offsets)
                top = sums.argmax(axis=1)
                share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                names += [languages[i] if ok else "und" for i, ok in zip(top, lettered, strict=True)]
                best += np.where(lettered, share, 0.0).tolist()
                all_sums += sums.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(all_sums, pa.list_(pa.float64()))], schema=arrow)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, log_likelihood array<double>")


def languages_of(docs: DataFrame, path: str, per_language: int = TEXTS) -> DataFrame:
    """identify() with a model fitted on the rows that are not held out, and `held_out`."""
    languages, log_p = fit_languages(docs.where(~held_out(F.col("doc_id"))), path, per_language)
    return identify(docs, languages, log_p, path).withColumn("held_out", held_out(F.col("doc_id")))
