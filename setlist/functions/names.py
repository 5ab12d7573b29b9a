"""Names of artists and performers: cleaning, comparison keys, tokens, similarity."""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setlist.functions.dates import let, strip

_CJK = "一-鿿"
#: White space as `(?U)\s` has it, and the signs that a key goes without.
_WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SIGNS = """'"`.,:;!?()[]{}<>·•-_/\\（），。、！：；《》【】"""
#: Where it isn't found, clean_name() leaves a name as it is.
_UNCLEAN = rf"(?U)[/&+×]|[^\S ]|\s\s|^\s|\s$|[{_CJK}]\s"
#: Latin words and numbers that cleaning leaves as they are.
_WORDS = r"^[A-Za-z0-9]++(?: [A-Za-z0-9]++)*+\z"

#: Words that tell no performer apart.
WEAK_TOKENS = ["and", "the", "live", "concert", "show", "festival", "上海", "嘉宾", "专场"]

#: Names of one artist.
ALIAS_GROUPS = [
    ["周华健", "Wakin Chau", "Emil Chau", "Emil Wakin Chau"],
    ["周兴哲(Eric)", "周兴哲", "Eric Chou"],
    ["周兴哲", "Eric Chou"],
    ["迈克学摇滚", "Michael Learns To Rock", "MLTR"],
    ["Belle&Sebastian", "Belle and Sebastian", "Belle Sebastian"],
    ["Molly Nilsson", "Molly Nillson"],
    ["GAI", "GAI周延", "周延"],
    ["王嘉尔", "Jackson Wang", "Jackson Wang 王嘉尔"],
    ["张智霖", "Julian Cheung", "Chilam Cheung"],
    ["周传雄", "Steve Chou", "小刚"],
    ["杨千嬅", "Miriam Yeung"],
    ["齐豫", "Chyi Yu"],
    ["安溥", "张悬", "Deserts Chang", "Anpu"],
    ["江美琪", "Maggie Chiang"],
    ["林志炫", "Terry Lin"],
    ["林宥嘉", "Yoga Lin"],
    ["李荣浩", "Ronghao Li"],
    ["潘玮柏", "Wilber Pan"],
    ["游鸿明", "Chris Yu"],
    ["徐良", "Xu Liang"],
]


@F.pandas_udf(T.StringType())
def fold_marks(names: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return names.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def casefold(names: pd.Series) -> pd.Series:
    return names.map(lambda x: x if x is None else x.casefold())


def _points(texts: pd.Series, width: int) -> np.ndarray:
    """Code points of strings of at most `width` characters, filled up with zeros."""
    return np.frombuffer("".join(x.ljust(width, "\0") for x in texts).encode("utf-32-le"), np.uint32).reshape(-1, width)


def most_common(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Length of the longest common subsequence of each two strings, of 64 characters at most: one bit for each character of the first, all pairs at once."""
    width = max(1, int(a.str.len().max()), int(b.str.len().max()))
    left, right = _points(a, width), _points(b, width)
    bits = np.uint64(1) << np.arange(width, dtype=np.uint64)
    row = np.full(len(a), ~np.uint64(0))
    for j in range(width):
        same = ((left == right[:, j : j + 1]) & (left != 0)) @ bits
        met = row & same
        row = (row + met) | (row - met)
    return np.bitwise_count(~row & (~np.uint64(0) >> np.uint64(64 - width)))


def may_reach(a: pd.Series, b: pd.Series, least: float) -> np.ndarray:
    """Whether the ratio of two strings each may be `least`.

    Matching blocks are a common subsequence, so twice the longest one over both lengths bounds the ratio from above.
    """
    size = (a.str.len() + b.str.len()).to_numpy()
    short = ((a.str.len() <= 64) & (b.str.len() <= 64)).to_numpy()
    may = ~short
    if short.any():
        may[short] = 2.0 * most_common(a[short], b[short]) >= least * size[short] - 1e-9
    may[size == 0] = True
    return may


def ratios(a: pd.Series, b: pd.Series, least: float) -> tuple[np.ndarray, int]:
    """Ratios of the matching blocks of two strings each, in this order, or 0 where that is under `least`; and how many pairs were matched, those that may reach it."""
    out, may = np.zeros(len(a)), may_reach(a, b, least)
    for i in np.flatnonzero(may).tolist():
        ratio = difflib.SequenceMatcher(None, a.iat[i], b.iat[i]).ratio()
        out[i] = ratio if ratio >= least else 0.0
    return out, int(may.sum())


def matching_ratio(a: Column, b: Column, least: float) -> Column:
    """ratios() of two columns of strings."""

    @F.pandas_udf(T.DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(ratios(x, y, least)[0])

    return ratio(a, b)


def _one_line(text: Column) -> Column:
    plain = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.regexp_replace(plain, rf"(?U)(?<=[{_CJK}])\s+(?=[{_CJK}])", "")


def _tight(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s*([/&+×])\s*", "$1"))


def clean_name(text: Column) -> Column:
    """Single blanks, none between Chinese characters or around / & + ×."""
    return F.when(text.rlike(_UNCLEAN), _tight(_one_line(text))).otherwise(F.coalesce(text, F.lit("")))


def clean_line(text: Column) -> Column:
    """As clean_name for recognised lines: no blank from Chinese to Latin either, two split names joined."""
    plain = _tight(F.regexp_replace(_one_line(text), rf"(?U)([{_CJK}])\s+([A-Za-z0-9])", "$1$2"))
    cleaned = strip(F.replace(F.replace(plain, F.lit("M AO"), F.lit("MAO")), F.lit("7 HERTZ"), F.lit("7HERTZ")))
    split = F.contains(text, F.lit("M AO")) | F.contains(text, F.lit("7 HERTZ"))
    # Most lines are words with one blank between, which a plainer pattern tells than those of all white space.
    return F.when(text.rlike(_WORDS) & ~split, text).when(split | text.rlike(_UNCLEAN), cleaned).otherwise(F.coalesce(text, F.lit("")))


def key_of_folded(folded: Column) -> Column:
    """Comparison key of a cleaned name without marks."""
    plain = F.translate(F.lower(folded), "丨|" + _WHITE + _SIGNS, "ii")
    return F.coalesce(F.replace(F.replace(plain, F.lit("&"), F.lit("and")), F.lit("+"), F.lit("and")), F.lit(""))


def name_key(text: Column) -> Column:
    return key_of_folded(fold_marks(clean_name(text)))


def look_alike_key(key: Column) -> Column:
    """1, i and l, and 0 and o, made one."""
    return F.translate(key, "1i0", "llo")


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{_CJK}]")


def tokens_of_folded(folded: Column) -> Column:
    """Words of a cleaned name without marks, weak ones dropped."""
    parts = F.split(F.lower(folded), rf"[^a-z0-9{_CJK}]+")
    return F.filter(parts, lambda x: (x != "") & ~x.isin(*WEAK_TOKENS))


def bigrams(key: Column) -> Column:
    """Distinct pairs of neighbouring characters; a key of one or two is its own."""
    n = F.char_length(key)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(2)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= 2, F.array(key)).otherwise(F.array_distinct(pairs))


def name_keys(values: DataFrame, column: str = "name") -> DataFrame:
    """name, key, ocr, latin for each distinct name: what the exact joins need of name_features()."""
    rows = values.select(F.col(column).alias("name")).where(F.col("name").isNotNull()).distinct()
    rows = rows.select("name", fold_marks(clean_name(F.col("name"))).alias("folded"))
    # Cleaning takes only blanks away, so the cleaned name has a Latin letter if the name has one.
    return rows.select("name", key_of_folded(F.col("folded")).alias("key"), look_alike_key(key_of_folded(F.col("folded"))).alias("ocr"), F.col("folded").rlike("(?i)[a-z]").alias("latin"))


def name_features(values: DataFrame, column: str = "name", nearness: bool = True) -> DataFrame:
    """One row for each distinct name with all that comparisons need; Python sees each name once. `nearness`: what only relevance() needs too."""
    rows = values.select(F.col(column).alias("name")).where(F.col("name").isNotNull()).distinct()
    rows = rows.withColumns({"folded": fold_marks(clean_name(F.col("name")))} | ({"name_cf": casefold(F.col("name"))} if nearness else {}))
    rows = rows.withColumn("key", key_of_folded(F.col("folded")))
    more = [
        "name_cf",
        F.array_distinct(F.filter(F.regexp_extract_all("name_cf", F.lit(rf"[a-z0-9{_CJK}]+"), F.lit(0)), lambda x: x != "and")).alias("words"),
        bigrams(F.col("key")).alias("grams"),
    ]
    return rows.select(
        "name",
        "key",
        look_alike_key(F.col("key")).alias("ocr"),
        has_cjk(F.col("name")).alias("cjk"),
        F.col("folded").rlike("(?i)[a-z]").alias("latin"),  # as in name_keys()
        tokens_of_folded(F.col("folded")).alias("tokens"),
        *(more if nearness else []),
    )


def spelling_similarity(a: Column, b: Column) -> Column:
    """Nearness of two keys at one or two slips: a swap of neighbours, wrong letters, or letters left out; 0 beyond."""
    return let(F.struct(a.alias("a"), b.alias("b"), F.char_length(a).alias("n"), F.char_length(b).alias("m")), lambda p: _similarity(p["a"], p["b"], p["n"], p["m"]))


def _similarity(a: Column, b: Column, n: Column, m: Column) -> Column:
    short, long = F.least(n, m), F.greatest(n, m)
    allowed = F.when(short < 8, 1).otherwise(2)
    wrong = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, F.struct(x.alias("x"), y.alias("y")))), lambda p: p.isNotNull())
    # A swap leaves two wrong places, side by side and crossed; then exchanging them makes the keys equal.
    places = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)), i)), lambda i: i.isNotNull())

    def equal_length(w: Column, at: Column) -> Column:
        first, second = F.try_element_at(w, F.lit(1)), F.try_element_at(w, F.lit(2))
        swap = (F.size(w) == 2) & (F.try_element_at(at, F.lit(2)) == F.try_element_at(at, F.lit(1)) + 1) & (first["x"] == second["y"]) & (first["y"] == second["x"])
        return F.when(swap, 1 - 1 / n).when(F.size(w) > allowed, 0.0).otherwise(1 - F.size(w) / n)

    little, large = F.when(n < m, F.split(a, "")).otherwise(F.split(b, "")), F.when(n < m, F.split(b, "")).otherwise(F.split(a, ""))
    matched = let(little, lambda own: F.aggregate(large, F.lit(0), lambda k, c: k + F.coalesce(c == F.try_element_at(own, k + 1), F.lit(False)).cast("int")))
    slips = let(matched, lambda k: long + short - 2 * k)
    unequal = let(slips, lambda k: F.when(k > allowed, 0.0).otherwise(1 - k / long))
    same = let(wrong, lambda w: let(places, lambda at: equal_length(w, at)))
    return F.when(short == 0, 0.0).when(a == b, 1.0).when(long - short > allowed, 0.0).when(n == m, same).otherwise(unequal)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "高", 3).when(confidence == "中", 2).when(confidence == "低", 1).otherwise(0)
