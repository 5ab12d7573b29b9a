"""URL filters: rules on hosts and paths, and gradient-boosted trees for the rest.

The URLs that a rule judges are the labelled ones; from a bounded sample of them trees
learn lexical features: lengths, depth, digit ratio, entropy of the characters,
parameters, and how often the host's suffixes are blocked. These shares are counted over
all labelled rows; for a URL that is learnt from they leave out its own fold of URLs, so a
feature never tells a label by itself. URLs without a rule get the trees' verdict.

Defined results: a null URL and one without :// have an empty host and path and match no
rule; if the sample has one class only, that is the verdict (allow if it is empty); a URL
is learnt from once however many rows have it; repeated rows each give a row; an empty
table gives an empty one; very long URLs are read whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setlist.llm.common import BROADCAST_ROWS, attach, durable, lower_ascii

#: Fixed values: (host, path, verdict); a rule fits its host and all its subdomains.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Distinct URLs of each class to learn from, at most: those with the smallest hashes.
ROWS = 3000
FOLDS = 5
TREES, DEPTH = 10, 4
#: Weight of the overall share in a suffix's share of blocked URLs, in URLs.
PRIOR = 20.0

FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "value_length", "fragment", "hyphens", "suffix_block", "domain_block"]


def url_parts(url: Column) -> dict[str, Column]:
    """host (lower-cased) and path as the rules see them."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return {"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))}


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together), and its verdict; nulls for none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    chars = F.split(text, "")
    n = F.size(chars)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(F.length(text) > 0, F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    parameters = F.filter(F.split(query, "&"), lambda p: p != "")
    size = lambda x: F.coalesce(F.length(x).cast("double"), F.lit(0.0))
    found = {
        "url_length": size(url),
        "host_length": size(host),
        "path_length": size(path),
        "depth": size(F.regexp_replace(path, "[^/]", "")),
        "labels": F.size(F.split(host, r"\.")).cast("double"),
        "digits": size(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(size(url), F.lit(1.0)),
        "entropy": entropy(url),
        "parameters": F.size(parameters).cast("double"),
        "value_length": size(F.array_join(F.transform(parameters, lambda p: F.regexp_replace(p, "^[^=]*=?", "")), "")),
        "fragment": F.instr(url, "#").cast("boolean").cast("double"),
        "hyphens": size(F.regexp_replace(host, "[^-]", "")),
    }
    return {k: F.coalesce(v, F.lit(0.0)) for k, v in found.items()}


def suffixes(host: Column) -> dict[str, Column]:
    labels = F.split(host, r"\.")
    last = F.element_at(labels, -1)
    return {"suffix": last, "domain": F.when(F.size(labels) > 1, F.concat_ws(".", F.element_at(labels, -2), last)).otherwise(last)}


def judged(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, url, host, path, rule and its verdict, suffix, domain, and label (1: blocked) where a rule judges."""
    rows = pages.select("page_id", "url").withColumns(url_parts(F.col("url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "rule_verdict": verdict} | suffixes(F.col("host")))
    return rows.withColumn("label", F.when(F.col("rule_verdict").isNotNull(), (F.col("rule_verdict") == "block").cast("double")))


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), url), F.lit(FOLDS))


def _share(blocked: Column, n: Column, overall: float) -> Column:
    """Share of blocked rows, drawn to the overall share."""
    return (blocked + PRIOR * overall) / (n + PRIOR)


def block_counts(rows: DataFrame, *by: str) -> DataFrame:
    """by, blocked, n of labelled rows."""
    return rows.groupBy(*by).agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n"))


def with_fold_shares(sample: DataFrame, counts: DataFrame, key: str, overall: float) -> DataFrame:
    """The learnt URLs with the share of blocked rows that have their key, but for those of their own fold."""
    few = counts.join(F.broadcast(sample.select(key).distinct()), key, "left_semi")
    own, every = block_counts(few, key, "fold"), block_counts(few, key).withColumnsRenamed({"blocked": "all_blocked", "n": "all_n"})
    share = _share(F.col("all_blocked") - F.col("blocked"), F.col("all_n") - F.col("n"), overall)
    return sample.join(own.join(every, key).select(key, "fold", share.alias(f"{key}_block")), [key, "fold"])


def with_shares(rows: DataFrame, counts: DataFrame, key: str, overall: float) -> DataFrame:
    """Rows with the share of blocked ones of all labelled rows that have their key; the overall share for none."""
    known = durable(block_counts(counts, key).select(key, _share(F.col("blocked"), F.col("n"), overall).alias(f"{key}_block"), "n"))
    if known.count() > BROADCAST_ROWS:  # then it matters how many rows each has
        known = durable(known.drop("n").join(rows.groupBy(key).agg(F.count("*").alias("n")), key))
    return attach(rows, known, [key], "n", "left").drop("n").withColumn(f"{key}_block", F.coalesce(f"{key}_block", F.lit(overall)))


def learnt_sample(rows: DataFrame, size: int) -> DataFrame:
    """Distinct labelled URLs, of each class at most `size`, with the smallest hashes."""
    known = rows.where("label is not null").groupBy("url").agg(*[F.first(c).alias(c) for c in ("label", "host", "path", "domain", "suffix")])  # all follow from the URL
    order = [F.xxhash64(F.lit("sample"), "url"), "url"]
    return known.where("label = 1").orderBy(*order).limit(size).unionByName(known.where("label = 0").orderBy(*order).limit(size))


def _lexical(rows: DataFrame) -> DataFrame:
    return rows.withColumns(lexical_features(F.col("url"), F.col("host"), F.col("path")))


def fit_urls(rows: DataFrame, size: int = ROWS, trees: int = TREES, depth: int = DEPTH, seed: int = 3):
    """A function that adds block_score to rows of judged(), learnt from those with a label; the share of blocked ones where there is one class only."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    sample = durable(_lexical(learnt_sample(rows, size)).withColumn("fold", _fold(F.col("url"))))
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return lambda df: df.withColumn("block_score", F.lit(1.0 if 1.0 in sizes else 0.0))
    each = rows.where("label is not null").withColumn("fold", _fold(F.col("url"))).groupBy("domain", "suffix", "fold")
    counts = durable(each.agg(F.sum("label").alias("blocked"), F.count("*").alias("n")))
    total = counts.agg(F.sum("blocked"), F.sum("n")).first()
    overall = total[0] / total[1]
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    learnt = with_fold_shares(with_fold_shares(sample, counts, "domain", overall), counts, "suffix", overall)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=16, seed=seed).fit(durable(assembler.transform(learnt).select("label", "features").repartition(2)))

    def score(df: DataFrame) -> DataFrame:
        ready = assembler.transform(with_shares(with_shares(_lexical(df), counts, "domain", overall), counts, "suffix", overall))
        return model.transform(ready).withColumn("block_score", vector_to_array("probability")[1])

    return score


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score (of the trees) for each row."""
    rows = judged(pages, rules)
    scored = fit_urls(rows, **options)(rows)
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
