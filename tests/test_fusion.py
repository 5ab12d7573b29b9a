import random
import re

from pyspark.sql import functions as F

from setlist.functions.names import clean_line
from setlist.operators.fusion import deduplicated, performer_key


def test_keys_of_plain_performers_are_those_of_cleaned_ones(spark):
    rng = random.Random(31)
    names = ["", " ", "abc\n", "\nabc", "a b", "ÀÉß", "İx", "M AO", "MAO", "7 HERTZ", "林 志炫", "林志炫 x", "a_1", "é", "क्षि", "a‍b", "x&y", "x & y", "٣Ⅷ²", None]
    names += ["".join(rng.choice("aZ9_ é林\n　&-́") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in names], "performer string")
    full = F.lower(F.regexp_replace(clean_line(F.col("performer")), r"(?U)[^\w一-鿿]", ""))
    found = rows.select(performer_key(F.col("performer")).alias("key"), full.alias("full")).collect()
    assert len(found) == len(names) and all(r.key == r.full for r in found)


def test_equal_rows_are_one_before_keys_are_worked_out(spark):
    rng = random.Random(32)
    rows = [(rng.choice("pq"), f"1.{rng.randint(1, 3)}", rng.choice(["Ab", "ab", "a b", "AB!", "c", "-"]), rng.choice(["", "hall", "MAO"]), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "note_id string, date_text string, performer string, venue string, ord long")
    best = {}
    for note, date, performer, venue, i in rows:
        key = re.sub(r"\W", "", performer).lower()
        if key:
            first, place, e = best.get((note, date, key), (i, (True, i + 1), None))
            best[note, date, key] = (min(first, i), *min((place, e), ((venue == "", i), (performer, venue)), key=lambda x: x[0]))
    expected = {(note, date, first, *e) for (note, date, _), (first, _, e) in best.items()}
    got = deduplicated(frame.repartition(5), ["note_id"])
    assert {(r.note_id, r.date_text, r.ord, r.performer, r.venue) for r in got.collect()} == expected
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
