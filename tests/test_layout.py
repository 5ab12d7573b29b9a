import json
import random

from pyspark.sql import functions as F

from setlist.functions.names import clean_line
from setlist.operators import fusion, layout, responses

LINE = "struct<line_ord:int,text:string,x1:double,y1:double,x2:double,y2:double>"
PAGES = {
    "range": [("7 / 20", 16, 1200, 83, 1230), ("-21", 135, 1200, 182, 1230), ("BADBADNOTGOOD", 418, 1200, 703, 1230), ("瓦肆Vast", 943, 1200, 1051, 1230)],
    "two": [("7 / 11", 16, 80, 83, 110), ("LakiPak", 529, 80, 620, 110), ("迈克学摇滚", 912, 80, 1029, 110), ("7 / 12", 16, 250, 83, 280), ("Hanser", 531, 250, 618, 280), ("李荣浩", 932, 250, 1010, 280)],
    "columns": [(t, x1, 200, x2, 230) for t, x1, x2 in [("7 / 11", 20, 90), ("周五", 120, 160), ("Thomas Bergersen", 205, 350), ("7 / 12", 390, 460), ("周六", 490, 530), ("Hanser", 575, 650), ("7 / 13", 740, 810), ("周日", 835, 875), ("PREP", 920, 990)]],
    "gap": [("6 / 6", 16, 540, 83, 554), ("山形瑞秋Rachael Yamagata", 365, 540, 754, 554), ("星在2F", 945, 590, 1050, 617)],
    "gapdate": [("6 / 6", 16, 540, 83, 554), ("山形瑞秋Rachael Yamagata", 365, 540, 754, 554), ("星在2F", 945, 590, 1050, 617), ("9 / 6", 16, 590, 83, 617)],
    "glyph": [("7 / 10", 16, 300, 83, 310), ("康士坦的变化球", 400, 300, 700, 310), ("霏", 930, 300, 955, 310), ("声", 956, 300, 990, 310)],
    "novenue": [("7 / 17", 16, 370, 83, 377), ("Zella Day", 518, 370, 630, 377), ("Quinn葱因", 910, 370, 1031, 377)],
    "empty": [],
}
EXPECTED = {
    "range": [("7.20-21", "BADBADNOTGOOD", "瓦肆Vast")],
    "two": [("7.11", "LakiPak", ""), ("7.12", "Hanser", "")],
    "columns": [("7.11", "Thomas Bergersen", ""), ("7.12", "Hanser", ""), ("7.13", "PREP", "")],
    "gap": [("6.6", "山形瑞秋Rachael Yamagata", "星在2F")],
    "gapdate": [("9.6", "山形瑞秋Rachael Yamagata", "星在2F")],
    "glyph": [("7.10", "康士坦的变化球", "霏声")],
    "novenue": [("7.17", "Zella Day", "")],
}


def images(spark, pages):
    rows = [(n, 0, f"{n}.jpg", 1080, [(i, t, float(a), float(b), float(c), float(d)) for i, (t, a, b, c, d) in enumerate(lines)]) for n, lines in pages.items()]
    return spark.createDataFrame(rows, f"note_id string, image_ord int, image_name string, width int, lines array<{LINE}>")


def test_pages(spark):
    got = {}
    for r in layout.layout_events(images(spark, PAGES)).orderBy("note_id", "event_index").collect():
        got.setdefault(r.note_id, []).append((r.date_text, r.performer, r.venue))
    assert got == EXPECTED


def test_venues(spark):
    names = ["梅奔", "JZ", "瓦肆Vast", "霏声", "声", "李荣浩", "PREP", "DAKOOKA"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, x string").select(layout.looks_like_venue(F.col("x"))).collect()
    assert [r[0] for r in rows] == [True] * 4 + [False] * 4


def test_row_clusters_follow_the_running_mean(spark):
    heights = [0, 10, 18, 26, 30, 31, 60, 79, 95]
    pages = {"p": [("x", 0, y, 1, y) for y in heights]}
    rows = images(spark, pages).select(F.inline(layout.clustered(F.col("lines")))).collect()
    expected, members, row = [], [], -1
    for y in heights:
        if not members or abs(y - sum(members) / len(members)) > layout.ROW:
            members, row = [], row + 1
        members.append(y)
        expected.append(row)
    assert [r.row for r in rows] == expected


def test_responses(spark):
    raw = {
        0: "```json\n" + json.dumps({"events": [{"date": "7 / 11", "performer": "Thomas Bergersen", "venue": "MAO"}, {"date_text": "7 / 12", "artist": "Hanser", "venue": ""}]}) + "\n```",
        1: json.dumps({"items": [{"date": "", "performer": "x"}, {"date": "7/13", "performer": "PREP"}]}),
        2: json.dumps({"events": [], "rows": [{"日期": "7.14~15", "歌手": "LakiPak", "date_text": None}]}) + " and more } text",
        3: "no json {",
        4: None,
        5: json.dumps([{"date": "7/13", "performer": "only the first object of a text counts"}]),
    }
    frame = spark.createDataFrame([("n", i, 0, t) for i, t in raw.items()], "note_id string, batch_index int, attempt_ord int, raw_text string")
    got = sorted((r.batch_index, r.pos, r.date_text, r.performer, r.venue) for r in responses.recognised_events(frame).collect())
    assert got == [(0, 0, "7.11", "Thomas Bergersen", "MAO"), (0, 1, "7.12", "Hanser", ""), (1, 1, "7.13", "PREP", ""), (2, 0, "7.14-15", "LakiPak", "")]


def _first_object(text):
    plain = (text or "").strip()
    if plain.startswith("```"):
        plain = plain.strip("`").strip().removeprefix("json").strip()
    begin = plain.find("{")
    if begin < 0:
        return plain
    depth, quoted, skip = 0, False, False
    for i in range(begin, len(plain)):
        c = plain[i]
        if skip:
            skip = False
        elif quoted and c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return plain[begin : i + 1]
    return plain[begin:]


def test_first_object_against_a_plain_loop(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(['{', '}', '"', '\\', 'a', ' ', '\n', '🎉', '`', 'json', '{"k":', '\\"', '"}']) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["```json\n{\"a\": \"}\"} rest```", "```{}```", "``` none ```", None, "", "{" * 5000 + "}" * 5000, '{"' + "x" * 200_000 + '"} y']
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = {r.i: r.y for r in frame.select("i", responses.first_object(F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(texts))] == [_first_object(t) for t in texts]


def test_suggestion_answers(spark):
    raw = {
        0: "```json\n" + json.dumps({"matches": [{"event_index": 0, "artist_name": "No", "confidence": "低"}, {"event_index": 0, "artist_name": "Zella Day", "confidence": "高"}, {"event_index": 1, "artist_name": None}]}) + "```",
        1: json.dumps({"events": [{"event_index": 101, "event_performer": "P", "matches": [{"artist_name": "Rachael Yamagata", "confidence": "中", "reason": " r "}]}]}),
        2: json.dumps({"matches": [{"event_index": 5, "artist_name": "A", "confidence": "高"}, {"event_index": 6, "artist_name": "B", "confidence": "maybe"}]}),
        3: "nothing",
        4: json.dumps({"matches": [{"event_index": x, "artist_name": f"A{i}", "confidence": "高"} for i, x in enumerate([" 7 ", "12abc", "3.7", 8.9, True, None, "+1_0", [], "-2", 1e12])]}),
        5: json.dumps({"events": [{"event_index": "41", "event_performer": "P", "matches": [{"artist_name": "A", "confidence": "中"}, {"artist_name": "B", "confidence": "中", "event_index": None}, {"artist_name": "C", "confidence": "中", "event_index": 42, "event_performer": "Q"}]}]}),
    }
    frame = spark.createDataFrame([("j", 0, i, t) for i, t in raw.items()], "job_id string, batch_id int, response_ord int, raw_text string")
    got = sorted((r.response_ord, r.event_index, r.artist_name, r.confidence, r.event_performer) for r in responses.parsed_suggestions(frame).collect())
    whole = [(4, -2, "A8", "高", ""), (4, 1, "A4", "高", ""), (4, 7, "A0", "高", ""), (4, 8, "A3", "高", ""), (4, 10, "A6", "高", "")]
    assert got == [(0, 0, "Zella Day", "高", ""), (1, 101, "Rachael Yamagata", "中", "P"), *whole, (5, 41, "A", "中", "P"), (5, 42, "C", "中", "Q")]


def test_decisions(spark):
    raw = ['{"is_match": true, "confidence": "高", "reason": " r "}', '{"is_match": false, "confidence": "低"}', '{"is_match": true, "confidence": "maybe"}', "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string").select(responses.parsed_decision(F.col("t")).alias("d")).collect()
    assert [tuple(r.d) if r.d else None for r in rows] == [(True, "高", "r"), (False, "低", ""), None, None]


EVENTS = "array<struct<date_text:string,performer:string,venue:string>>"
RESULT = f"note_id string, batch_index int, attempt_ord int, events {EVENTS}, error string"


def test_fusion(spark):
    one = [("7.1", "A B", ""), ("7.2", "C", "")]
    two = [("7.1", "a b", "MAO"), ("7.2", "C", ""), ("7.3", "D", ""), ("7.4", "!", "")]
    frame = spark.createDataFrame([("n", 0, 0, one, ""), ("n", 0, 1, two, ""), ("n", 0, 2, [("9.9", "X", "")], "failed")], RESULT)
    got = [(r.date_text, r.performer, r.venue) for r in fusion.fused(frame).orderBy("ord").collect()]
    assert got == [("7.1", "a b", "MAO"), ("7.2", "C", ""), ("7.3", "D", "")]


def test_attempts(spark):
    row = lambda n: [(f"7.{i}", f"b{i}", "") for i in range(1, n + 1)]
    rows = [
        ("low then enough", 0, 0, row(1), ""), ("low then enough", 0, 1, row(3), ""), ("low then enough", 0, 2, row(5), ""),
        ("low then failed", 0, 0, row(1), ""), ("low then failed", 0, 1, [], "x"),
        ("low ones agree", 0, 0, row(2), ""), ("low ones agree", 0, 1, row(2), ""),
        ("low ones differ", 0, 0, row(2), ""), ("low ones differ", 0, 1, row(1), ""), ("low ones differ", 0, 2, row(1), ""),
        ("one batch of two", 0, 0, row(3), ""), ("one batch of two", 1, 0, [], "x"),
    ]
    frame = spark.createDataFrame(rows, RESULT)
    got = {(r.note_id, r.batch_index): r.upto for r in fusion.accepted_attempts(frame).collect()}
    assert got == {("low then enough", 0): 1, ("low then failed", 0): None, ("low ones agree", 0): 1, ("low ones differ", 0): None, ("one batch of two", 0): 0, ("one batch of two", 1): None}
    assert {r.note_id for r in fusion.published(frame).collect()} == {"low then enough", "low ones agree"}
    assert {(r.note_id, r.upto) for r in fusion.accepted_attempts(frame, fallback=False).where("batch_index = 0").collect() if r.note_id.startswith("low then")} == {("low then enough", 0), ("low then failed", 0)}
    status = {r.note_id: (r.failed, r.total) for r in fusion.batch_status(fusion.accepted_attempts(frame)).collect()}
    assert status["one batch of two"] == (1, 2)


def test_manifest(spark):
    rows = [("", 1, 1, 1), ("a.JPG", 5, 10, 10), ("b.gif", 5, 10, 10), ("c.png", 13 * 1024 * 1024, 10, 10), ("d.webp", 5, 400, 400), ("e.jpeg", 5, 401, 1), ("f.jpg", 0, 1, 1), (None, 1, 1, 1)]
    frame = spark.createDataFrame(rows, "filename string, size_bytes long, width int, height int")
    assert [r.filename for r in fusion.valid_images(frame).collect()] == ["a.JPG", "d.webp", "e.jpeg"]
    assert [r.filename for r in fusion.valid_images(frame, max_pixels=100_000, max_side=400).collect()] == ["a.JPG"]


def test_store(spark, tmp_path):
    from setlist.sources import tables

    new = spark.createDataFrame([("a", 1), ("b", 2)], "fingerprint string, n int")
    tables.write_store(new, str(tmp_path / "s"), "v1", "x")
    store = tables.read_store(spark, str(tmp_path / "s"), "v1", "x")
    hits, misses = fusion.split_by_store(spark.createDataFrame([("a",), ("c",)], "fingerprint string"), store, ["fingerprint"])
    assert [r[0] for r in hits.collect()] == ["a"] and [r[0] for r in misses.collect()] == ["c"]
    merged = fusion.refreshed(store.select("fingerprint", "n"), spark.createDataFrame([("a", 9)], "fingerprint string, n int"), ["fingerprint"])
    assert {tuple(r) for r in merged.collect()} == {("a", 9), ("b", 2)}


def test_playlist_files(spark, tmp_path):
    from setlist.sources import tables

    (tmp_path / "p.json").write_text(json.dumps({"playlist": {"id": 7, "trackIds": [{"id": 1}, {"id": None}, {"id": 3}], "tracks": [{"id": 3, "name": "T", "artists": [], "ar": [{"name": " B "}, {"name": ""}]}]}}))
    tracks, own = tables.read_playlists(spark, str(tmp_path / "p.json"))
    assert [(r.playlist_id, r.track_ord, r.song_id) for r in tracks.collect()] == [("7", 0, "1"), ("7", 2, "3")]
    assert [(r.song_id, r.artists) for r in own.collect()] == [("3", ["B"])]
    assert tables.read_playlists(spark, str(tmp_path / "p.json"), limit=2)[0].count() == 1
    (tmp_path / "s.json").write_text(json.dumps({"songs": [{"id": 1, "name": "old", "artists": [{"name": "A"}], "ar": []}, {"id": 1, "name": "new", "artists": [], "ar": [{"name": "B"}]}]}))
    from setlist.operators.playlist import resolve_songs

    songs = resolve_songs(tracks, tables.read_songs(spark, str(tmp_path / "s.json")), own).orderBy("track_ord").collect()
    assert [(r.name, r.artists) for r in songs] == [("new", ["B"]), ("T", ["B"])]
    (tmp_path / "e.json").write_text('{"note_id":"n","date_text":"7.1","performer":"P"}\n{"note_id":"n","performer":"Q"}\n')
    assert [tuple(r) for r in tables.read_events(spark, str(tmp_path / "e.json")).select("performer", "venue").collect()] == [("P", "")]


def test_clean_line(spark):
    assert spark.range(1).select(clean_line(F.lit("7  HERTZ"))).first()[0] == "7HERTZ"


def test_written_lines_are_compressed(spark, tmp_path):
    from setlist.sources.tables import read_lines, write_lines

    lines = [(i, f"Band {i}", 1.0, 2.0, 3.0, 4.0) for i in range(50)]
    kind = "note_id string, image_ord int, image_name string, width int, height int, lines array<struct<line_ord:int,text:string,x1:double,y1:double,x2:double,y2:double>>"
    write_lines(spark.createDataFrame([("n", 0, "n.jpg", 1080, 1920, lines)], kind), str(tmp_path / "lines"))
    files = [p for p in (tmp_path / "lines").iterdir() if p.name.startswith("part-")]
    assert files and all(p.suffix == ".gz" for p in files)
    assert [tuple(x) for x in read_lines(spark, str(tmp_path / "lines")).first().lines] == lines


def test_images_are_looked_at_once(spark):
    from setlist.operators.layout import layout_events

    kind = "note_id string, image_ord int, image_name string, width int, lines array<struct<line_ord:int,text:string,x1:double,y1:double,x2:double,y2:double>>"
    plan = layout_events(spark.createDataFrame([], kind))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1


def test_events_move_once_by_note(spark):
    """Both groupings and the numbering of a note's events shuffled them."""
    images = spark.createDataFrame([("n", 0, "a.jpg", 1080, [(i, text, *map(float, box)) for i, (text, *box) in enumerate(PAGES["range"])])], f"note_id string, image_ord int, image_name string, width int, lines array<{LINE}>")
    rows = layout.layout_events(images)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r.date_text, r.performer, r.venue) for r in rows.collect()] == EXPECTED["range"]


def test_lines_are_cleaned_as_by_the_plain_rules(spark):
    from setlist.functions import dates, names

    signs = [" ", "  ", "\t", "\u3000", "\xa0", "\n", "/", " / ", "／", ".", "．", "&", "+", "×", "-", "–"]
    texts = [f.format(x) for x in signs for f in ("a{0}b", "{0}a", "a{0}", "中{0}文", "中{0}b", "7{0}20", "12{0}3{0}4", "{0}", "M{0}AO", "7{0}HERTZ", "a {0} b")]
    texts += ["", None, "M AO", "xM AOx", "7 HERTZ", "17 HERTZ x", "13/40 2.3", "2.30", "0/1", "٧/١", "Band 12", "Band 12\n", "7.", "1234/5678"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    plain = names._tight(F.regexp_replace(names._one_line(F.col("x")), rf"(?U)([{names._CJK}])\s+([A-Za-z0-9])", "$1$2"))
    plain = dates.strip(F.replace(F.replace(plain, F.lit("M AO"), F.lit("MAO")), F.lit("7 HERTZ"), F.lit("7HERTZ")))
    one = dates.compact(F.col("x"))
    found = lambda pattern: F.struct(*[F.nullif(F.regexp_extract(one, pattern, i), F.lit("")).try_cast("int").alias(n) for i, n in ((1, "month"), (2, "day"))])
    date = F.when(one.rlike(r"(\d{1,2})/(\d{1,2})"), found(r"(\d{1,2})/(\d{1,2})")).otherwise(found(r"(\d{1,2})\.(\d{1,2})"))
    date = F.when(date["month"].between(1, 12) & date["day"].between(1, 31), date)
    both = rows.select("x", clean_line(F.col("x")).alias("a"), plain.alias("b"), dates.parse_date(F.col("x")).alias("c"), date.alias("d"))
    assert both.where("not (a <=> b and c <=> d)").collect() == [] and both.where("c is not null").count() > 5
