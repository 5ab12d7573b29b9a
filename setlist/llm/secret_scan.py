"""Secret scans: fixed patterns, and sliding-window Shannon entropy of candidate strings.

All work is column expressions. The places of a pattern's matches follow from the lengths
of the matches and of what lies between them. Candidates are long runs of the characters
that keys are written in. What a pattern has found already, with the letters and digits
that adjoin it, and what the allow-list knows is cut out of a candidate; what is left on
either side counts. A window slides over each piece: its counts of characters and of their
kinds, and with them the entropy, change by the character that comes and the one that
goes. The kinds in a window tell its class (digits, hex, one case, mixed), and each class
has a threshold of its own. A span is a maximal run of characters that dense windows cover.

The work grows in proportion to the text: matches are placed in groups and candidates are
looked at in blocks of windows, so no array is copied for each of its entries.

Defined results: a null or empty text has no spans; places count code points, ends are
exclusive; repeated rows each give a row; an empty table gives an empty one; very long
texts and candidates are scanned whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the kinds, in the order in which spans with one start are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits a character that a window of random characters of each class passes and prose does not; digits alone never do.
LEAST_BITS = {"digits": 3.4, "hex": 2.9, "one case": 3.8, "mixed": 3.85}
#: Windows of a candidate that are looked at in one go, and matches that are placed in one go.
BLOCK, GROUP = 2048, 256
#: The characters of candidates in the order of a window's counts, their kinds, and the kinds in the order of theirs.
_CHARS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
_KIND_OF = "d" * 10 + "h" * 6 + "l" * 20 + "H" * 6 + "L" * 20 + "s" * 5
_KINDS = "dhlHLs"
_SEGMENT, _APART = "[A-Za-z0-9]", "(?<![A-Za-z0-9])"
#: Parts of candidates that are known not to be secrets: segments with a placeholder and those joined to them by
#: hyphens or underscores (possessive: no run of signs is tried from each of its places), and UUIDs. Patterns from ^ to $ are for all that is left in one piece: words, each in one
#: case or capitalised, and digits, joined by any sign.
ALLOWED = [
    rf"(?i){_APART}(?:{_SEGMENT}++[-_]++|(?<![-_])[-_]++)?{_SEGMENT}*?(?:example|sample|dummy|placeholder|changeme|redacted|x{{6}}|0{{8}}|12345678){_SEGMENT}*(?:[-_]+{_SEGMENT}*)?",
    rf"{_APART}[0-9a-fA-F]{{8}}(?:-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}(?![A-Za-z0-9])",
    r"^(?!.*(?:[0-9]|[a-z][A-Z]|[A-Z]{2}[a-z])).*$",
    r"^[-_/+=0-9]*$",
]
#: What a base span is replaced by; the rest of a segment that it is in belongs to the same string.
_MARK = "\x01"
_MARKED = rf"{_APART}{_SEGMENT}*\x01[A-Za-z0-9\x01]*"

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
_PLACE = "array<struct<start:bigint,kind:int,end:bigint,byte:bigint,match:string>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(items: Column, i: Column) -> Column:
    """The entry before place i (from 0), or the first one."""
    return F.element_at(items, F.greatest(i, F.lit(1)))


def places(text: Column, pattern: str, kind: int) -> Column:
    """(start, kind, end, byte, match) of each match, leftmost and not overlapping; byte: of its start in UTF-8."""
    long = lambda x: x.cast("long")
    sizes = lambda gap, match: F.struct(
        long(F.char_length(gap)).alias("gap"), long(F.octet_length(gap)).alias("gap_bytes"), long(F.char_length(match)).alias("size"), long(F.octet_length(match)).alias("bytes"), match.alias("match")
    )
    at = lambda chars, octets: F.struct(chars.alias("at"), octets.alias("byte"))
    zero = at(long(F.lit(0)), long(F.lit(0)))

    def after(own: Column, begin: Column) -> Column:
        return F.aggregate(own, begin, lambda s, x: at(s["at"] + x["gap"] + x["size"], s["byte"] + x["gap_bytes"] + x["bytes"]))

    def placed(own: Column, begin: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            start, byte = s["at"] + x["gap"], s["byte"] + x["gap_bytes"]
            end = start + x["size"]
            place = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), byte.alias("byte"), x["match"].alias("match"))
            return F.struct(end.alias("at"), (byte + x["bytes"]).alias("byte"), F.array_append(s["out"], place).alias("out"))

        return F.aggregate(own, F.struct(begin["at"].alias("at"), begin["byte"].alias("byte"), F.array().cast(_PLACE).alias("out")), step, lambda s: s["out"])

    def grouped(groups: Column) -> Column:
        begins = F.aggregate(groups, F.array(zero), lambda out, g: F.array_append(out, after(g, F.element_at(out, -1))))
        return F.flatten(F.zip_with(groups, F.slice(begins, F.lit(1), F.size(groups)), placed))

    def found(own: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / GROUP).cast("int")), lambda i: F.slice(own, i * GROUP + 1, F.lit(GROUP)))
        return F.when(F.size(own) > 0, _let(groups, grouped)).otherwise(F.array().cast(_PLACE))

    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), sizes)
    return _let(F.filter(both, lambda x: x["match"].isNotNull()), found)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def joined(ranges: Column) -> Column:
    """Ranges (start, end), by rising start and end, with those that touch made one."""

    def join(own: Column) -> Column:
        first = F.filter(own, lambda x, i: (i == 0) | (x["start"] > _before(own, i)["end"]))
        last = F.filter(own, lambda x, i: (i == F.size(own) - 1) | (F.element_at(own, F.least(i + 2, F.size(own)))["start"] > x["end"]))
        return F.zip_with(first, last, lambda x, y: F.struct(x["start"].alias("start"), y["end"].alias("end")))

    return _let(ranges, join)


def _least(kinds: Column, bits: dict[str, float]) -> Column:
    """The threshold of a window with these counts of kinds."""
    has = {k: F.substring(kinds, i + 1, 1) != "0" for i, k in enumerate(_KINDS)}
    lower, upper = has["h"] | has["l"], has["H"] | has["L"]
    return F.when(~lower & ~upper, bits["digits"]).when(~has["l"] & ~has["L"], bits["hex"]).when(~(lower & upper), bits["one case"]).otherwise(bits["mixed"])


def _block_ranges(block: Column, window: int, bits: dict[str, float]) -> Column:
    """Ranges (start, end) of a short string that its dense windows cover."""
    # A count is one character of a string, "0" for none: a change looks at no other count.
    slot = lambda counts, i: F.ascii(F.substr(counts, i, F.lit(1))) - ord("0")
    put = lambda counts, i, n: F.overlay(counts, F.char(n + ord("0")), i, F.lit(1))
    part = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))
    numbers = lambda c: F.struct(F.position(c, F.lit(_CHARS)).alias("char"), F.position(F.translate(c, _CHARS, _KIND_OF), F.lit(_KINDS)).alias("kind"))
    none = F.array_repeat(F.struct(F.lit(0).alias("char"), F.lit(0).alias("kind")), window)
    steps = _let(F.transform(F.split(block, ""), numbers), lambda own: F.zip_with(own, F.slice(F.concat(none, own), F.lit(1), F.size(own)), lambda come, go: F.struct(come.alias("come"), go.alias("go"))))

    def changed(counts: Column, x: Column, by: int) -> Column:
        def put_both(own: Column) -> Column:
            n, k = own["n"], own["k"]
            # The entropy of a window of n is log2(n) less the sum of c log2(c) over its counts, divided by n.
            return F.struct(put(counts["chars"], x["char"], n + by).alias("chars"), put(counts["kinds"], x["kind"], k + by).alias("kinds"), (counts["sum"] + part(n + by) - part(n)).alias("sum"))

        return _let(F.struct(slot(counts["chars"], x["char"]).alias("n"), slot(counts["kinds"], x["kind"]).alias("k")), put_both)

    def step(s: Column, x: Column) -> Column:
        left = F.when(x["go"]["char"] > 0, changed(s["counts"], x["go"], -1)).otherwise(s["counts"])

        def told(counts: Column) -> Column:
            end = s["end"] + 1
            dense = (end >= window) & (F.log2(F.lit(float(window))) - counts["sum"] / window >= _least(counts["kinds"], bits) - 1e-9)
            apart = dense & (end - window > s["last"])
            out = F.when(apart, F.array_append(s["out"], F.struct(s["first"].alias("start"), s["last"].alias("end")))).otherwise(s["out"])
            first = F.when(apart | dense & s["first"].isNull(), end - window).otherwise(s["first"])
            return F.struct(counts.alias("counts"), end.alias("end"), F.coalesce(out, s["out"]).alias("out"), first.alias("first"), F.when(dense, end).otherwise(s["last"]).alias("last"))

        return _let(_let(left, lambda counts: changed(counts, x["come"], 1)), told)

    nothing = F.struct(F.lit("0" * len(_CHARS)).alias("chars"), F.lit("0" * len(_KINDS)).alias("kinds"), F.lit(0.0).alias("sum"))
    unset = F.lit(None).cast("int")
    begin = F.struct(nothing.alias("counts"), F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("out"), unset.alias("first"), unset.alias("last"))
    done = lambda s: F.when(s["first"].isNull(), s["out"]).otherwise(F.array_append(s["out"], F.struct(s["first"].alias("start"), s["last"].alias("end"))))
    return F.aggregate(steps, begin, step, done)


def dense_ranges(candidate: Column, window: int = WINDOW, bits: dict[str, float] = LEAST_BITS, block: int = BLOCK) -> Column:
    """Maximal ranges (start, end), from 0, of a candidate that dense windows cover."""

    def of(data: Column) -> Column:
        last = F.floor((F.greatest(F.octet_length(data) - window + 1, F.lit(1)) - 1) / block).cast("int")

        def moved(i: Column) -> Column:
            text = F.substring(data, i * block + 1, F.lit(block + window - 1)).cast("string")
            return F.transform(_block_ranges(text, window, bits), lambda r: F.struct((r["start"] + i * block).alias("start"), (r["end"] + i * block).alias("end")))

        return joined(F.flatten(F.transform(F.sequence(F.lit(0), last), moved)))

    # Candidates are ASCII, and bytes are cut without a walk from the first one.
    return _let(candidate.cast("binary"), of)


def _blank(text: Column, pattern: str) -> Column:
    """`text` with spaces for each match."""

    def blank(own: Column) -> Column:
        parts = F.zip_with(F.split(own, pattern, -1), F.regexp_extract_all(own, F.lit(pattern), F.lit(0)), lambda gap, match: F.concat(gap, F.coalesce(F.repeat(F.lit(" "), F.char_length(match)), F.lit(""))))
        return F.when(own.rlike(pattern), F.array_join(parts, "")).otherwise(own)

    return _let(text, blank)


def _cut(text: Column, spans: Column) -> Column:
    """`text` with a _MARK for each character of the places of one kind, which are ASCII."""

    def cut(data: Column, own: Column) -> Column:
        stop = lambda x: x["byte"] + x["end"] - x["start"]
        at = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(stop(_before(own, i)))
        text_of = lambda first, n: F.substring(data, (first + 1).cast("int"), n.cast("int")).cast("string")
        parts = F.transform(own, lambda x, i: F.concat(text_of(at(i), x["byte"] - at(i)), F.repeat(F.lit(_MARK), (x["end"] - x["start"]).cast("int"))))
        rest = text_of(stop(F.element_at(own, -1)), F.octet_length(data))
        return F.array_join(F.array_append(parts, rest), "")

    return _let(text, lambda whole: F.when(F.size(spans) > 0, _let(whole.cast("binary"), lambda data: _let(spans, lambda own: cut(data, own)))).otherwise(whole))


def entropy_spans(text: Column, window: int = WINDOW, least: dict[str, float] = LEAST_BITS, allowed: list[str] = ALLOWED) -> Column:
    """Spans of dense windows in the pieces of candidates that the _MARKs of known spans and the allow-list leave."""
    whole, parts = [x for x in allowed if x.startswith("^")], [x for x in allowed if not x.startswith("^")]
    kind = len(KINDS) - 1

    def pieces(run: Column) -> Column:
        left = reduce(_blank, [_MARKED, *parts], run["match"])
        return F.transform(places(left, CANDIDATE, kind), lambda x: F.struct((x["start"] + run["start"]).alias("start"), x["match"].alias("match")))

    found = F.flatten(F.transform(places(text, CANDIDATE.replace("[", "[" + _MARK, 1), kind), pieces))
    found = F.filter(found, lambda x: ~reduce(or_, [x["match"].rlike(pattern) for pattern in whole], F.lit(False)))
    spans = lambda x: F.transform(dense_ranges(x["match"], window, least), lambda r: F.struct((x["start"] + r["start"]).alias("start"), F.lit(kind).alias("kind"), (x["start"] + r["end"]).alias("end")))
    return F.flatten(F.transform(found, spans))


def scan(docs: DataFrame, window: int = WINDOW, least: dict[str, float] = LEAST_BITS, allowed: list[str] = ALLOWED) -> DataFrame:
    """doc_id, base and added: sorted (start, kind, end) spans, kind by its place in KINDS."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Most texts have no match of one kind or another; a first look that stops early spares them the rest.
    assign = F.filter(places(text, ASSIGN, 0), lambda x: F.char_length(F.regexp_extract(x["match"], ASSIGN, 2)) >= ASSIGN_LEAST)
    access = F.filter(places(text, ACCESS, 1), lambda x: x["end"] - x["start"] >= ACCESS_LEAST)
    hexes = places(text, HEX[:-1] + f"{{{HEX_LEAST},}}", 2)
    nothing = F.array().cast(_PLACE)
    kinds = {"assign": F.when(text.rlike(ASSIGN), assign), "access": F.when(F.contains(text, F.lit("AKIA")), access), "hex": F.when(text.rlike(f"[0-9a-f]{{{HEX_LEAST}}}"), hexes)}
    rows = rows.select("doc_id", "text", *[F.coalesce(found, nothing).alias(kind) for kind, found in kinds.items()])
    left = reduce(_cut, [F.col(kind) for kind in kinds], text)
    added = F.when(text.rlike(CANDIDATE), _let(left, lambda own: entropy_spans(own, window, least, allowed))).otherwise(_none())
    return rows.select("doc_id", F.array_sort(F.concat(*[_bare(F.col(kind)) for kind in kinds])).alias("base"), F.array_sort(added).alias("added"))


def span_names(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
