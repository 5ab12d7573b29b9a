"""Semi-structured answers of recognition and matching services, parsed to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setlist.functions.dates import let, parse_date, recognised_date, strip
from setlist.functions.names import clean_line

#: The names under which fields come, first first.
DATE_NAMES = ["date_text", "date", "dateText", "演出日期", "日期"]
PERFORMER_NAMES = ["performer", "artist", "artist_name", "lineup", "name", "歌手", "阵容"]
VENUE_NAMES = ["venue", "location", "place", "场地", "演出场所"]
CONFIDENCES = ["高", "中", "低"]


#: What a scan for braces passes in one step: other characters, a backslash with what follows, a quote or a brace.
_STEPS = r'(?s)[^"{}\\]+|\\.|["{}\\]'


def first_object(text: Column) -> Column:
    """The text without a code fence; from its first { on, up to the matching } if there is one.

    Braces in strings don't count, nor do quotes after a backslash there; outside strings a backslash is like any character.
    """
    plain = strip(F.coalesce(text, F.lit("")))
    bare = strip(F.regexp_replace(plain, "^`+|`+$", ""))
    plain = F.when(F.startswith(plain, F.lit("```")), strip(F.regexp_replace(bare, "^json", ""))).otherwise(plain)

    def step(s: Column, token: Column) -> Column:
        escaped = F.startswith(token, F.lit("\\"))
        sign = F.when(escaped & s["quoted"], F.lit("")).otherwise(F.right(token, F.lit(1)))
        depth = s["depth"] + F.when(s["quoted"], 0).when(sign == "{", 1).when(sign == "}", -1).otherwise(0)
        done = (sign == "}") & ~s["quoted"] & (depth == 0)
        moved = F.struct(depth.alias("depth"), F.when(sign == '"', ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (s["size"] + F.char_length(token)).alias("size"), done.alias("done"))
        return F.when(s["done"], s).otherwise(moved)

    def found(whole: Column) -> Column:
        rest = F.substring(whole, F.position(F.lit("{"), whole), F.char_length(whole))
        begin = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("size"), F.lit(False).alias("done"))
        return let(rest, lambda own: F.substring(own, F.lit(1), F.aggregate(F.regexp_extract_all(own, F.lit(_STEPS), F.lit(0)), begin, step, lambda s: s["size"])))

    return let(plain, lambda whole: F.when(F.contains(whole, F.lit("{")), found(whole)).otherwise(whole))


def _field(item: Column, names: list[str]) -> Column:
    """The first of the named fields that is there and not null, as trimmed text."""
    return strip(F.coalesce(*[F.try_variant_get(item, f"$['{n}']", "string") for n in names], F.lit("")))


def _list(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "array<variant>")


def recognised_events(responses: DataFrame) -> DataFrame:
    """note_id, batch_index, attempt_ord, pos, date_text, performer, venue of the usable rows in raw_text.

    An answer is an object with a list under events, rows or items (an empty one passes to the next); of a text
    only the first object counts. Answers that are no JSON give no rows.
    """
    value = F.try_parse_json(first_object(F.col("raw_text")))
    rows = responses.withColumn("v", value)
    lists = [F.when(F.size(_list(F.col("v"), n)) > 0, _list(F.col("v"), n)) for n in ("events", "rows", "items")]
    items = F.coalesce(F.try_variant_get(F.col("v"), "$", "array<variant>"), *lists)
    rows = rows.select("note_id", "batch_index", "attempt_ord", F.posexplode(items).alias("pos", "item"))
    rows = rows.select(
        "note_id", "batch_index", "attempt_ord", "pos",
        recognised_date(_field(F.col("item"), DATE_NAMES)).alias("date_text"),
        clean_line(_field(F.col("item"), PERFORMER_NAMES)).alias("performer"),
        clean_line(_field(F.col("item"), VENUE_NAMES)).alias("venue"),
    )
    return rows.where((F.col("performer") != "") & parse_date(F.col("date_text")).isNotNull())


def parsed_decision(raw_text: Column) -> Column:
    """struct(is_match, confidence, reason); null if the answer is no JSON or its confidence is unknown."""
    v = F.try_parse_json(first_object(raw_text))
    confidence = _field(v, ["confidence"])
    flag, raw = F.try_variant_get(v, "$.is_match", "boolean"), F.coalesce(F.try_variant_get(v, "$.is_match", "string"), F.lit(""))
    kind = F.schema_of_variant(F.try_variant_get(v, "$.is_match", "variant"))
    truth = F.when(kind == "STRING", raw != "").otherwise(F.coalesce(flag, F.lit(False)))
    return F.when(confidence.isin(*CONFIDENCES), F.struct(truth.alias("is_match"), confidence.alias("confidence"), _field(v, ["reason"]).alias("reason")))


def _whole(value: Column) -> Column:
    """A JSON value as a whole number: a text of digits only, a number without its fraction, true and false as 1 and 0."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    text = strip(F.try_variant_get(value, "$", "string"))
    digits = F.when(text.rlike(r"^[+-]?[0-9]+(?:_[0-9]+)*$"), F.replace(text, F.lit("_"), F.lit("")).try_cast("int"))
    flag = F.try_variant_get(value, "$", "boolean").cast("int")
    return F.when(kind == "STRING", digits).when(kind == "BOOLEAN", flag).otherwise(F.try_variant_get(value, "$", "double").try_cast("int"))


def parsed_suggestions(responses: DataFrame) -> DataFrame:
    """job_id, batch_id, event_index, artist_name, confidence, reason, event_performer from (job_id, batch_id, response_ord, raw_text) rows.

    Matches stand in a list, or, if that is empty, in lists inside events, whose index and performer they take over
    where they name none. Rows without a whole index or an artist are skipped; any other row with an unknown confidence
    spoils its whole response; of several rows for an event the last of a response counts.
    """
    rows = responses.withColumn("v", F.try_parse_json(first_object(F.col("raw_text"))))
    part = lambda v, n: F.try_variant_get(v, f"$.{n}", "variant")
    text = lambda v, n: F.try_variant_get(v, f"$.{n}", "string")
    item = lambda m, index, performer: F.struct(m.alias("m"), index.alias("index"), performer.alias("performer"))
    own = F.transform(_list(F.col("v"), "matches"), lambda m: item(m, _whole(part(m, "event_index")), F.coalesce(text(m, "event_performer"), F.lit(""))))

    def inherited(e: Column, m: Column) -> Column:
        # A field that is there but null is not taken over.
        index = F.when(part(m, "event_index").isNull(), _whole(part(e, "event_index"))).otherwise(_whole(part(m, "event_index")))
        performer = F.when(part(m, "event_performer").isNull(), text(e, "event_performer")).otherwise(text(m, "event_performer"))
        return item(m, index, F.coalesce(performer, F.lit("")))

    nothing = F.array().cast("array<variant>")
    nested = F.flatten(F.transform(F.coalesce(_list(F.col("v"), "events"), nothing), lambda e: F.transform(F.coalesce(_list(e, "matches"), nothing), lambda m: inherited(e, m))))
    wrong = part(F.col("v"), "matches").isNotNull() & _list(F.col("v"), "matches").isNull()
    listed = F.when(wrong, None).when(F.size(own) > 0, own).otherwise(nested)
    rows = rows.select("job_id", "batch_id", "response_ord", F.posexplode(listed).alias("pos", "x"))
    rows = rows.select(
        "job_id", "batch_id", "response_ord", "pos", F.col("x.index").alias("event_index"),
        strip(text(F.col("x.m"), "artist_name")).alias("artist_name"),
        strip(text(F.col("x.m"), "confidence")).alias("confidence"),
        strip(text(F.col("x.m"), "reason")).alias("reason"),
        strip(F.col("x.performer")).alias("event_performer"),
    ).where(F.col("event_index").isNotNull() & (F.col("artist_name") != ""))
    response = Window.partitionBy("job_id", "batch_id", "response_ord")
    rows = rows.withColumn("bad", F.max((~F.col("confidence").isin(*CONFIDENCES)).cast("int")).over(response)).where("bad = 0")
    kept = rows.groupBy("job_id", "batch_id", "response_ord", "event_index").agg(F.max_by(F.struct("artist_name", "confidence", "reason", "event_performer"), "pos").alias("s"))
    return kept.select("job_id", "batch_id", "response_ord", "event_index", "s.*")
