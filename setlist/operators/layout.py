"""Positioned text lines of poster images turned into event rows.

images: note_id, image_ord, image_name, width, lines array<struct<line_ord,text,x1,y1,x2,y2>>. All geometry is
within one image, so it is worked out on the row's array; rows move once, by note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setlist.functions.dates import let, merge_date_range, parse_date
from setlist.functions.names import clean_line
from setlist.operators.fusion import deduplicated

#: Fixed values, in pixels: row height, distance of a row whose venue stands below, width of a date column.
ROW, GAP_LEAST, GAP_MOST, COLUMN = 18.0, 40.0, 72.0, 70.0
#: Short names of venues, and parts of longer ones.
VENUE_NAMES = ["东体", "梅奔", "虹馆", "红石", "摩登", "静安", "瓦肆", "JZ", "Jz", "MAO", "MOSH", "CAVE", "Coven", "Legacy", "Encore", "Cream", "MeHub", "WEST", "翡声", "霏声", "乐无界"]
VENUE_PARTS = r"(?i)馆|堂|空间|球场|体育场|体育馆|音乐厅|足球场|剧院|演艺|Livehouse|Legacy|Encore|Cream|MeHub|CAVE|Coven|WEST|Wast|est|MAO|MOSH|JZ|梅奔|东体|虹馆|红石|摩登|静安|瓦肆|育音堂|新歌空间|翡声|霏声|乐无界|星在|GT\.?CH|虹口|东艺"
#: Header words of either kind of page, and weekdays.
_HEADERS = "日期|场地|阵容|仅供参考|实际演出为准"
_SUMMARY_HEADERS = "(?i)日期|歌手|阵容|场地|周|week|artist"
_WEEKDAYS = "^(周|星期)?[一二三四五六日天]$"


def looks_like_venue(text: Column) -> Column:
    def known(plain: Column) -> Column:
        short = F.lower(F.regexp_replace(plain, r"(?U)\s+", "")).isin(*sorted({v.lower() for v in VENUE_NAMES}))
        return ~plain.isin("", "地点", "场馆", "声") & (plain.rlike(VENUE_PARTS) | short)

    return let(clean_line(text), known)


def _named(plain: Column) -> Column:
    """Whether a cleaned line has a letter, and two characters of words."""
    return plain.rlike("[A-Za-z一-鿿]") & (F.char_length(F.regexp_replace(plain, r"(?U)[^\w一-鿿]", "")) >= 2)


def is_performer(plain: Column, x1: Column, x2: Column, scale: Column) -> Column:
    return (x1 >= 210 * scale) & (x2 <= 910 * scale) & _named(plain) & ~plain.rlike(_HEADERS)


def is_summary_performer(plain: Column) -> Column:
    return _named(plain) & parse_date(plain).isNull() & ~plain.rlike(_WEEKDAYS) & ~plain.rlike(_SUMMARY_HEADERS)


def clustered(lines: Column) -> Column:
    """Lines by height with the number of their row: a line joins the row whose mean height so far is near."""
    sized = F.sort_array(F.transform(lines, lambda x: F.struct(((x["y1"] + x["y2"]) / 2).alias("cy"), x["line_ord"].alias("line_ord"), x["text"].alias("raw"), x["x1"].alias("x1"), x["x2"].alias("x2"))))
    begin = F.struct(F.array().cast("array<int>").alias("out"), F.lit(-1).alias("row"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        same = (s["n"] > 0) & (F.abs(x["cy"] - s["sum"] / F.greatest(s["n"], F.lit(1))) <= ROW)
        row = F.when(same, s["row"]).otherwise(s["row"] + 1)
        return F.struct(F.array_append(s["out"], row).alias("out"), row.alias("row"), F.when(same, s["sum"] + x["cy"]).otherwise(x["cy"]).alias("sum"), F.when(same, s["n"] + 1).otherwise(1).alias("n"))

    # Only the numbers of the rows are carried along.
    joined = lambda x, row: F.struct(row.alias("row"), *[x[c].alias(c) for c in ("cy", "line_ord", "raw", "x1", "x2")])
    return let(sized, lambda own: F.zip_with(own, F.aggregate(own, begin, step, lambda s: s["out"]), joined))


def column_starts(lines: Column) -> Column:
    """Left edges of date columns: dates from left to right, each farther than a column's width from all before."""
    dates = F.filter(lines, lambda x: x["dated"] & ~x["raw"].rlike("^[-－–—]"))
    return F.aggregate(F.sort_array(F.transform(dates, lambda x: x["x1"])), F.array().cast("array<double>"), lambda s, x: F.when(F.forall(s, lambda y: F.abs(x - y) > COLUMN), F.array_append(s, x)).otherwise(s))


def _prepared(images: DataFrame) -> DataFrame:
    """images with `scale` and `lines`: by row, with cleaned text, what each may be, and its place."""
    scale = F.when(F.coalesce("width", F.lit(0)) == 0, 1080).otherwise(F.col("width")) / 1080.0
    rows = images.select("note_id", "image_ord", "image_name", (scale * 1080).alias("wide"), scale.alias("scale"), clustered(F.col("lines")).alias("lines"))
    told = lambda x, i: F.struct(i.alias("place"), x["row"].alias("row"), x["cy"].alias("cy"), x["line_ord"].alias("line_ord"), x["x1"].alias("x1"), x["x2"].alias("x2"), x["raw"].alias("raw"), clean_line(x["raw"]).alias("text"), parse_date(x["raw"]).isNotNull().alias("dated"))
    rows = rows.withColumn("lines", F.transform("lines", told))
    return rows.withColumn("starts", column_starts(F.col("lines")))


def _summary_rows() -> Column:
    """Events of a page of several date columns: each performer between a date and the next column."""
    wide, starts, lines = F.col("wide"), F.col("starts"), F.col("lines")
    dates = F.filter(lines, lambda d: d["dated"] & F.exists(starts, lambda s: F.abs(d["x1"] - s) <= COLUMN))

    def inside(d: Column, p: Column) -> Column:
        next_start = F.coalesce(F.array_min(F.filter(starts, lambda s: s > d["x1"] + COLUMN)), wide + 1)
        return (p["row"] == d["row"]) & (p["x1"] >= d["x2"] + F.greatest(F.lit(52.0), wide * 0.04)) & (p["x1"] < next_start - F.greatest(F.lit(16.0), wide * 0.015)) & is_summary_performer(p["text"])

    pair = lambda d, p: F.struct(F.struct(d["row"].cast("double").alias("a"), d["x1"].alias("b"), d["place"].alias("c"), p["place"].alias("d")).alias("at"), d["raw"].alias("date"), F.lit(None).cast("string").alias("until"), p["text"].alias("performer"), F.lit("").alias("venue"))
    return F.flatten(F.transform(dates, lambda d: F.transform(F.filter(lines, lambda p: inside(d, p)), lambda p: pair(d, p))))


def _detail_rows() -> Column:
    """Events of a page of one column: each performer with the nearest venue and date of its row, or of the row just below."""
    scale = F.col("scale")

    def with_venue(lines: Column) -> Column:
        right = lambda x: x["x1"] >= 900 * scale

        def venue_of(x: Column) -> Column:
            """The venue's name if the line is one; a name split in two glyphs stands for its second one."""
            beside = lambda glyph: F.exists(lines, lambda y: (y["row"] == x["row"]) & right(y) & (y["text"] == glyph))
            first = F.when(x["text"] != "声", F.when(beside("霏") & beside("声"), "霏")).when(beside("霏"), "霏").when(beside("翡"), "翡")
            plain = F.when(looks_like_venue(x["text"]), x["text"])
            # In a row with both glyphs only they name a venue.
            return let(first, lambda f: F.when((x["text"] == "声") & f.isNotNull(), F.concat(f, F.lit("声"))).when(f.isNull(), plain))

        def told(x: Column) -> Column:
            span = (x["x1"] >= 105 * scale) & (x["x1"] <= 210 * scale) & x["raw"].rlike("[0-9]")
            fields = [x[c].alias(c) for c in ("place", "row", "cy", "line_ord", "raw", "text")]
            return F.struct(*fields, F.when(right(x), venue_of(x)).alias("venue"), F.when(x["dated"] & (x["x1"] < 110 * scale), x["raw"]).alias("date"), F.when(span, x["raw"]).alias("span"), is_performer(x["text"], x["x1"], x["x2"], scale).alias("performer"))

        return F.transform(lines, told)

    def nearest(some: Column, p: Column, field: str) -> Column:
        """Of the lines that have the field the one next in height, the first of equal ones."""
        own = F.filter(some, lambda x: x[field].isNotNull())
        return F.array_min(F.transform(own, lambda x: F.struct(F.abs(x["cy"] - p["cy"]).alias("far"), x["place"].alias("place"), x[field].alias("x"))))["x"]

    def event(p: Column, lines: Column) -> Column:
        around = F.filter(lines, lambda x: (x["row"] == p["row"]) | (x["row"] == p["row"] + 1))
        halves = lambda near: F.struct(F.filter(near, lambda x: x["row"] == p["row"]).alias("own"), F.filter(near, lambda x: x["row"] > p["row"]).alias("under"))

        def seen(rows: Column) -> Column:
            far = F.aggregate(rows["under"], F.lit(0.0), lambda s, x: s + x["cy"]) / F.greatest(F.size(rows["under"]), F.lit(1)) - p["cy"]
            gap = F.when((F.size(rows["under"]) > 0) & far.between(GAP_LEAST, GAP_MOST), nearest(rows["under"], p, "venue"))
            return F.struct(nearest(rows["own"], p, "venue").alias("here"), gap.alias("gap"))

        def chosen(rows: Column, venues: Column) -> Column:
            low = venues["here"].isNull() & venues["gap"].isNotNull() & F.exists(rows["under"], lambda x: x["date"].isNotNull())
            at = F.struct(p["line_ord"].cast("double").alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d"))
            venue = F.coalesce(venues["here"], venues["gap"], F.lit(""))
            return let(F.when(low, rows["under"]).otherwise(rows["own"]), lambda row: F.struct(at.alias("at"), nearest(row, p, "date").alias("date"), nearest(row, p, "span").alias("until"), p["text"].alias("performer"), venue.alias("venue")))

        return let(let(around, halves), lambda rows: let(seen(rows), lambda venues: chosen(rows, venues)))

    events = lambda lines: F.transform(F.filter(lines, lambda x: x["performer"]), lambda p: event(p, lines))
    return F.filter(let(with_venue(F.col("lines")), events), lambda e: e["date"].isNotNull())


def layout_events(images: DataFrame) -> DataFrame:
    """note_id, event_index, date_text, performer, venue, image_name: deduplicated events in order of images and lines."""
    rows = _prepared(images)
    # One look at each image: as a filter, the number of columns would be worked out again for each kind of page.
    several = F.size("starts") >= 2
    found = rows.select("note_id", "image_ord", "image_name", F.inline(F.when(several, _summary_rows()).otherwise(_detail_rows())))
    date = F.when(F.col("until").isNull(), merge_date_range(F.col("date"))).otherwise(merge_date_range(F.col("date"), F.col("until")))
    events = found.select("note_id", F.struct("image_ord", "at").alias("ord"), date.alias("date_text"), "performer", "venue", "image_name")
    # A note's events are numbered together in the end, so they move there at once and both groupings find them in place.
    return indexed(deduplicated(events.repartition("note_id"), ["note_id"]))


def indexed(events: DataFrame) -> DataFrame:
    """Events with `event_index` from 0 in each note in place of `ord`."""
    from pyspark.sql import Window

    order = Window.partitionBy("note_id").orderBy("ord")
    return events.withColumn("event_index", F.row_number().over(order) - 1).select("note_id", "event_index", "date_text", "performer", "venue", "image_name")
