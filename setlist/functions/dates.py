"""Month-day dates and date ranges written as text (`7.20`, `7/20-21`, `10.31-11.1`).

A date has no year. Every function takes and returns columns; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of the months; February has 28 everywhere.
MONTH_DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
YEAR_DAYS = sum(MONTH_DAYS)
_WHOLE = r"^(\d{1,2})[/.](\d{1,2})(?:-(?:(\d{1,2})[/.])?(\d{1,2}))?$"
_SLASH, _DOT = r"(\d{1,2})/(\d{1,2})", r"(\d{1,2})\.(\d{1,2})"
_BLANKS = r"(?U)^\s+|\s+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once and named once, so that expressions built on expressions stay small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, "")


def blank(text: Column) -> Column:
    """Whether strip() leaves nothing."""
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def compact(text: Column) -> Column:
    """One kind of slash and hyphen, no blanks."""
    return strip(F.translate(F.coalesce(text, F.lit("")), "／–—－− ", "/----"))


def _number(text: Column, pattern: str, group: int) -> Column:
    # Casting an empty text costs an exception each time, a null nothing.
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("int")


def parse_date(text: Column) -> Column:
    """struct(month, day) of the first m/d, or else the first m.d; null if there is none or it is out of range."""
    groups = lambda plain, pattern: F.struct(_number(plain, pattern, 1).alias("month"), _number(plain, pattern, 2).alias("day"))
    found = let(compact(text), lambda plain: F.when(plain.rlike(_SLASH), groups(plain, _SLASH)).otherwise(groups(plain, _DOT)))
    parsed = let(found, lambda d: F.when(d["month"].between(1, 12) & d["day"].between(1, 31), d))
    # Few texts have a sign of a date; patterns are tried on these alone.
    return F.when(F.contains(text, F.lit("/")) | F.contains(text, F.lit(".")) | F.contains(text, F.lit("／")), parsed)


def _span_text(m1: Column, d1: Column, m2: Column, d2: Column) -> Column:
    """`m.d`, `m.d-d2` or `m.d-m2.d2`; null m2 or d2 for no end."""
    start = F.concat(m1.cast("string"), F.lit("."), d1.cast("string"))
    end = F.when(m1 == m2, d2.cast("string")).otherwise(F.concat(m2.cast("string"), F.lit("."), d2.cast("string")))
    return F.coalesce(F.concat(start, F.lit("-"), end), start)


def merge_date_range(start: Column, end: Column | None = None) -> Column:
    """Canonical text of a start date and what stands beside it: a full date, or a day of the start's month."""
    none = F.lit(None).cast("int")
    if end is None:
        return let(parse_date(start), lambda d: F.when(d.isNull(), strip(start)).otherwise(_span_text(d["month"], d["day"], none, none)))
    day = _number(compact(end), r"(\d{1,2})$", 1)
    both = F.struct(parse_date(start).alias("first"), parse_date(end).alias("full"), F.when(day.between(1, 31), day).alias("day"))

    def merged(x: Column) -> Column:
        first, full, own = x["first"], x["full"], F.when(x["day"] != x["first"]["day"], x["day"])
        month = F.when(full.isNotNull(), full["month"]).when(own.isNotNull(), first["month"])
        return F.when(first.isNull(), strip(start)).otherwise(_span_text(first["month"], first["day"], month, F.coalesce(full["day"], own)))

    return let(both, merged)


def _ordinal(month: Column, day: Column) -> Column:
    """Day of the year; null unless the month has that day."""
    before = F.array(*[F.lit(sum(MONTH_DAYS[:i])) for i in range(12)])
    length = F.array(*map(F.lit, MONTH_DAYS))
    known = F.when(month.between(1, 12), month)
    return F.when(day.between(1, 31) & (day <= F.element_at(length, known)), F.element_at(before, known) + day)


def parse_date_range(text: Column) -> Column:
    """struct(s, e) of days of the year, e in the next year for a range across New Year; null if invalid."""
    ends = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    parts = lambda plain: F.struct(*[_number(plain, _WHOLE, i).alias(f"g{i}") for i in range(1, 5)])
    whole = lambda plain: let(parts(plain), lambda g: ends(_ordinal(g["g1"], g["g2"]), _ordinal(F.coalesce(g["g3"], g["g1"]), F.coalesce(g["g4"], g["g2"]))))
    one = lambda plain: let(parse_date(plain), lambda d: let(_ordinal(d["month"], d["day"]), lambda n: ends(n, n)))
    found = let(compact(text), lambda plain: F.when(plain.rlike(_WHOLE), whole(plain)).otherwise(one(plain)))
    return let(found, lambda r: F.when(r["s"].isNotNull() & r["e"].isNotNull(), ends(r["s"], F.when(r["e"] < r["s"], r["e"] + YEAR_DAYS).otherwise(r["e"]))))


def range_variants(span: Column) -> Column:
    """The range itself, a year later if it starts in January, a year earlier if it ends in the next year."""
    return let(span, _variants)


def _variants(span: Column) -> Column:
    moved = lambda days: F.struct((span["s"] + days).alias("s"), (span["e"] + days).alias("e"))
    return F.filter(F.array(span, F.when(span["s"] <= 31, moved(YEAR_DAYS)), F.when(span["e"] > YEAR_DAYS, moved(-YEAR_DAYS))), lambda x: x.isNotNull())


def spans_overlap(a: Column, a_text: Column, b: Column, b_text: Column) -> Column:
    """Whether two parsed ranges overlap in any variant; if one is null, whether the compact texts are equal."""
    meet = let(range_variants(b), lambda others: F.exists(range_variants(a), lambda x: F.exists(others, lambda y: (x["s"] <= y["e"]) & (y["s"] <= x["e"]))))
    return F.when(a.isNull() | b.isNull(), compact(a_text) == compact(b_text)).otherwise(meet)


def date_ranges_overlap(left: Column, right: Column) -> Column:
    both = F.struct(parse_date_range(left).alias("l"), parse_date_range(right).alias("r"))
    return let(both, lambda x: spans_overlap(x["l"], left, x["r"], right))


def span_days(span: Column) -> Column:
    """Days of a parsed range, at least 1."""
    return F.greatest(F.coalesce(span["e"] - span["s"] + 1, F.lit(1)), F.lit(1))


def display(text: Column) -> Column:
    """`7月20日-21日` for `7.20-21`; other texts only trimmed."""
    plain, pattern = strip(text), r"^(\d{1,2})\.(\d{1,2})(?:-(?:(\d{1,2})\.)?(\d{1,2}))?$"
    m1, d1, m2, d2 = (_number(plain, pattern, i) for i in range(1, 5))
    date = lambda m, d: F.concat(m.cast("string"), F.lit("月"), d.cast("string"), F.lit("日"))
    same = F.coalesce(m2, m1) == m1
    end = F.when(d2.isNull(), "").when(same, F.concat(F.lit("-"), d2.cast("string"), F.lit("日"))).otherwise(F.concat(F.lit("-"), date(m2, d2)))
    return F.when(plain.rlike(pattern), F.concat(date(m1, d1), end)).otherwise(plain)


def sort_key(text: Column) -> Column:
    """Month * 100 + day of a leading m.d, 9999 for none."""
    pattern = r"^(\d{1,2})\.(\d{1,2})"
    return F.coalesce(_number(text, pattern, 1) * 100 + _number(text, pattern, 2), F.lit(9999))


def recognised_date(text: Column) -> Column:
    """Canonical date of a recognised field, which may use ~ or 至 in a range."""
    from setlist.functions.names import clean_line

    plain = F.regexp_replace(F.translate(clean_line(text), "／", "/"), r"(?U)\s+", "")
    pattern = r"^(\d{1,2})[/.](\d{1,2})(?:[-~–—至](?:(\d{1,2})[/.])?(\d{1,2}))?$"
    m1, d1, m2, d2 = (_number(plain, pattern, i) for i in range(1, 5))
    return F.when(plain.rlike(pattern), _span_text(m1, d1, F.when(d2.isNotNull(), F.coalesce(m2, m1)), d2)).otherwise(merge_date_range(plain))
