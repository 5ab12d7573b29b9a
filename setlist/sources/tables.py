"""Readers and writers: playlists, songs, positioned lines, event rows, answers, reports, stores."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlist.operators.playlist import credited
from setlist.sources.store import Store

_SONG = "struct<id:bigint,name:string,artists:array<struct<name:string>>,ar:array<struct<name:string>>>"
PLAYLIST = f"playlist struct<id:bigint,trackIds:array<struct<id:bigint>>,tracks:array<{_SONG}>>"
SONGS = f"songs array<{_SONG}>"
LINES = "array<struct<line_ord:int,text:string,x1:double,y1:double,x2:double,y2:double>>"
RAW_IMAGE = "note_id string, image_ord int, image_name string, width int, height int, lines array<struct<text:string,x1:double,y1:double,x2:double,y2:double>>"
EVENT = "note_id string, event_index int, date_text string, performer string, venue string, image_name string, source_note string"
#: The report's headers.
HEADERS = ["序号", "日期", "歌手", "演出场所", "歌单出现次数", "歌单代表歌曲", "置信度"]


#: Tracks of a playlist that are read.
TRACKS = 1000


def read_playlists(spark: SparkSession, path: str, limit: int = TRACKS) -> tuple[DataFrame, DataFrame]:
    """Tracks (playlist_id, track_ord, song_id) without blank ids, the first `limit` of each playlist, and the playlists' own songs (playlist_id, song_id, name, artists, ord)."""
    raw = spark.read.schema(PLAYLIST).option("multiLine", True).json(path).select("playlist.*").withColumn("playlist_id", F.col("id").cast("string"))
    tracks = raw.select("playlist_id", F.posexplode(F.slice("trackIds", 1, limit)).alias("track_ord", "t")).select("playlist_id", "track_ord", F.col("t.id").cast("string").alias("song_id"))
    own = raw.select("playlist_id", F.posexplode("tracks").alias("ord", "s")).where("s.id <> 0")
    return tracks.where("song_id <> '0'"), own.select("playlist_id", F.col("s.id").cast("string").alias("song_id"), F.col("s.name").alias("name"), credited(F.col("s")).alias("artists"), "ord")


def read_songs(spark: SparkSession, path: str) -> DataFrame:
    """song_id, name, artists, ord of song details; ord: the file's name and the place in it."""
    rows = spark.read.schema(SONGS).option("multiLine", True).json(path).select(F.input_file_name().alias("file"), F.posexplode("songs").alias("pos", "s")).where("s.id <> 0")
    return rows.select(F.col("s.id").cast("string").alias("song_id"), F.col("s.name").alias("name"), credited(F.col("s")).alias("artists"), F.struct("file", "pos").alias("ord"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """url (the file's path) and html of whole pages."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Images with positioned lines, numbered in their order."""
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("line_ord"), *[x[c].alias(c) for c in ("text", "x1", "y1", "x2", "y2")]))
    return spark.read.schema(RAW_IMAGE).json(path).withColumn("lines", numbered)


def write_lines(images: DataFrame, path: str) -> None:
    plain = F.transform("lines", lambda x: F.struct(*[x[c].alias(c) for c in ("text", "x1", "y1", "x2", "y2")]))
    images.withColumn("lines", plain).write.json(path, compression="gzip")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event rows; ones without date or performer are rejected, other text defaults to ''."""
    rows = spark.read.schema(EVENT).json(path).where("date_text is not null and performer is not null")
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("venue", "image_name", "source_note")})


def write_events(events: DataFrame, path: str) -> None:
    events.write.json(path)


def file_hashes(spark: SparkSession, path: str, chunk: int = 1 << 23) -> DataFrame:
    """path, length and SHA-256 of each file, of any size: tasks get the files' names and read them piece by piece. Spark's reader lists no file without content."""
    arrow = pa.schema([("path", pa.string()), ("length", pa.int64()), ("sha256", pa.string())])

    def digest(name: str) -> str:
        system, inner = fs.FileSystem.from_uri(name)
        found = hashlib.sha256()
        with system.open_input_stream(inner) as f:
            while piece := f.read(chunk):
                found.update(piece)
        return found.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([length]), pa.array([digest(name)])], schema=arrow)

    names = spark.read.format("binaryFile").load(path).select("path", "length")  # without their content
    return names.repartition("path").mapInArrow(run, "path string, length long, sha256 string")


def files_fingerprint(hashes: DataFrame, by: str, order: str = "path") -> DataFrame:
    """by, fingerprint: SHA-256 over each group's ordered hashes, each followed by a line end; a group is sorted and passes by row by row."""
    kind = hashes.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, None
        for batch in batches:
            for group, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found is None or group != last:
                    if found is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([last], batch.column(0).type), pa.array([found.hexdigest()])], names=[by, "fingerprint"])
                    last, found = group, hashlib.sha256()
                found.update(own.encode() + b"\n")
            kinds = batch.column(0).type
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], kinds), pa.array([found.hexdigest()])], names=[by, "fingerprint"])

    return hashes.repartition(by).sortWithinPartitions(by, order, "sha256").select(by, "sha256").mapInArrow(run, f"`{by}` {kind}, fingerprint string")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """path and raw_text, one row for each file."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("raw_text"))


def write_store(rows: DataFrame, path: str, version: str, source: str) -> None:
    """Rows with a fingerprint, in place of those of this version and source with the same ones."""
    Store(rows.sparkSession, path).merge(rows.withColumns({"cache_version": F.lit(version), "source": F.lit(source)}))


def read_store(spark: SparkSession, path: str, version: str, source: str) -> DataFrame | None:
    """The rows of a version and source; None of a store that has none."""
    return Store(spark, path).read(version, source)


def report_rows(matches: DataFrame) -> DataFrame:
    """job_id and the report's seven columns, in order within a job."""
    values = ["index", "date_display", "artist_name", "venue", "playlist_song_count", F.array_join("sample_songs", "；"), "confidence"]
    named = [(F.col(v) if isinstance(v, str) else v).alias(h) for v, h in zip(values, HEADERS, strict=True)]
    return matches.repartitionByRange("job_id", "index").sortWithinPartitions("job_id", "index").select("job_id", *named)


def write_report(matches: DataFrame, path: str) -> None:
    report_rows(matches).write.partitionBy("job_id").option("header", True).csv(path)


def result_json(matches: DataFrame, counts: DataFrame) -> DataFrame:
    """job_id and a JSON document with a job's matches and counts."""
    item = F.struct("index", F.col("date_display").alias("date"), F.col("artist_name").alias("artist"), "venue", "playlist_song_count", "sample_songs", "confidence")
    lists = matches.groupBy("job_id").agg(F.sort_array(F.collect_list(item)).alias("matches"))
    rows = counts.join(lists, "job_id", "left")
    body = F.struct(F.coalesce("matches", F.array().cast(lists.schema["matches"].dataType)).alias("matches"), "match_count", "playlist_artist_count", "event_count")
    return rows.select("job_id", F.to_json(body).alias("json"))
