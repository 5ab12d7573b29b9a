from pyspark.sql import functions as F

from setlist.functions.dates import blank, display, parse_date_range, sort_key, span_days, strip
from setlist.functions.names import clean_name, key_of_folded, tokens_of_folded
from setlist.operators import matching as m
from setlist.operators.numbering import counted
from setlist.operators.stage import staged

CJK = "一-鿿"


def read(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stages_are_read_by_column(spark):
    """A step that wanted one column read whole rows, and no stage was known to be small."""
    rows = [(i, f"n{i}", [(i, None)], None if i % 2 else float("nan")) for i in range(5)]
    made = spark.createDataFrame(rows, "a long, b string, c array<struct<x:int,y:string>>, d double")
    kept = staged(made)
    assert kept.schema == made.schema and sorted(map(str, kept.collect())) == sorted(map(str, made.collect()))
    assert "ReadSchema: struct<b:string>" in read(kept.select("b"))
    assert "BroadcastHashJoin" in read(spark.range(1000).join(kept, F.col("id") == F.col("a")))
    assert staged(made.where("a < 0")).count() == 0
    assert staged(made.select("a", F.lit(None).alias("x"), F.struct(F.lit(None).alias("y")).alias("z"))).count() == 5


def test_places_need_no_shuffle_of_the_rows(spark):
    rows = counted(spark.range(100).select(F.lit("j").alias("g"), "id"), "g", F.col("id"))
    assert "SortMergeJoin" not in read(rows) and {(r.id, r["index"]) for r in rows.collect()} == {(i, i + 1) for i in range(100)}


def test_dates_are_worked_out_once_for_each_text(spark):
    texts = ["7.1", "7.1-3", "12.30-1.2", "tbd", "", " ", "2.30", "７.1", None]
    rows = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(90)], "i int, date_text string")
    dates = m.known_dates(rows)
    assert dates.count() == len(texts)
    date, span = F.col("date_text"), parse_date_range(F.col("date_text"))
    plain = rows.select("i", "date_text", span.alias("span"), span_days(span).alias("days"), m._cells(date).alias("cells"), display(date).alias("shown"), sort_key(date).alias("at"))
    known = m.dated(rows, dates, "span", "days", "cells", "shown", "at")
    assert sorted(map(str, known.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_names_are_cleaned_as_by_the_plain_rules(spark):
    white = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    signs = [*"'\"`.,:;!?()[]{}<>·•-_/\\|（），。、！：；《》【】丨&+×", "​", "﻿", "᠎"]
    names = [f.format(x) for x in white + signs for f in ("a{0}b", "{0}a", "a{0}", "中{0}文", "中{0}b", "a {0} b", "{0}", "a{0}{0}b")] + ["", None, "Plain Name", "ÀÉ İß", "R&B+x", "and the a", "A  B\n", "中 文 x"]
    rows = spark.createDataFrame([(x,) for x in names], "name string")
    name = F.col("name")
    line = strip(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", " "))
    line = F.regexp_replace(line, rf"(?U)(?<=[{CJK}])\s+(?=[{CJK}])", "")
    cleaned = strip(F.regexp_replace(line, r"(?U)\s*([/&+×])\s*", "$1"))
    key = F.regexp_replace(F.translate(F.lower(name), "丨|", "ii"), "[&+]", "and")
    key = strip(F.regexp_replace(key, r"""(?U)[\s'"`.,:;!?()\[\]{}<>·•\-_/\\|（），。、！：；《》【】]""", ""))
    words = F.split(F.regexp_replace(F.lower(name), "[&+]", " and "), rf"[^a-z0-9{CJK}]+")
    words = F.filter(words, lambda x: ~x.isin("", "and", "the", "live", "concert", "show", "festival", "上海", "嘉宾", "专场"))
    both = rows.select("name", cleaned.alias("x"), clean_name(name).alias("x2"), key.alias("y"), key_of_folded(name).alias("y2"), words.alias("z"), tokens_of_folded(name).alias("z2"), (strip(name) == "").alias("w"), blank(name).alias("w2"))
    assert both.where("not (x <=> x2 and y <=> y2 and z <=> z2 and w <=> w2)").collect() == []
