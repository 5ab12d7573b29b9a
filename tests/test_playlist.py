import random

from pyspark.sql import functions as F

from setlist.operators.numbering import counted
from setlist.operators.playlist import roll_up


def test_a_title_in_many_classes_is_one(spark):
    rng = random.Random(51)
    rows = [("hot" if rng.random() < 0.8 else "b", i, rng.choice(["", "first", *(f"t{k}" for k in range(30))]), rng.choice([["A"], ["A", "B"], ["A", "A"]])) for i in range(600)]
    frame = spark.createDataFrame(rows, "playlist_id string, track_ord int, name string, artists array<string>").repartition(5)
    expected = {}
    for playlist, _, title, credited in rows:
        for artist in credited:
            own = expected.setdefault((playlist, artist), [0, []])
            own[0] += 1
            if title and title not in own[1]:
                own[1].append(title)
    for salts, samples in ((1, 2), (32, 2), (7, 40)):
        got = {(r.playlist_id, r.name): [r.song_count, r.sample_songs] for r in roll_up(frame, samples, salts).collect()}
        assert got == {k: [n, titles[:samples]] for k, (n, titles) in expected.items()}


def test_columns_of_the_order_are_not_written(spark):
    frame = spark.range(50).select((F.col("id") % 3).alias("g"), (-F.col("id")).alias("at"), F.col("id").alias("v"))
    rows = counted(frame, "g", "at", spare=("at",))
    assert sorted(rows.columns) == ["g", "index", "v"]
    assert [r.v for r in rows.where("g = 1").orderBy("index").collect()] == list(range(49, 0, -3))
    assert "at" not in rows._jdf.queryExecution().optimizedPlan().collectLeaves().head().output().mkString(" ")
