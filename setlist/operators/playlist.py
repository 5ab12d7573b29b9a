"""Track lists rolled up to artists.

tracks: playlist_id, track_ord, song_id; songs: song_id, name, artists array<string>, and `ord`, their order where ids
repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setlist.functions.dates import strip
from setlist.operators.numbering import counted

SAMPLES = 5
#: Classes into which the credits of an artist are cut.
SALTS = 32


def credited(song: Column) -> Column:
    """Trimmed artist names of a song struct: `artists`, or `ar` if that is empty; blank names dropped."""
    both = F.when(F.size(song["artists"]) > 0, song["artists"]["name"]).otherwise(song["ar"]["name"])
    return F.transform(F.filter(F.coalesce(both, F.array().cast("array<string>")), lambda n: n.isNotNull() & (n != "")), strip)


def _last(songs: DataFrame, by: list[str]) -> DataFrame:
    """Of the songs with equal ids the last by `ord`; without that column the largest, so that any run takes the same."""
    song = F.struct("name", "artists")
    return songs.groupBy(*by).agg(F.max_by(song, F.struct(*["ord"] * ("ord" in songs.columns), song)).alias("song"))


def resolve_songs(tracks: DataFrame, details: DataFrame, fallback: DataFrame) -> DataFrame:
    """tracks with name and artists from details, else from the playlist's own rows (playlist_id, song_id), else none."""
    own = _last(details, ["song_id"]).withColumnRenamed("song", "detail")
    inline = _last(fallback, ["playlist_id", "song_id"]).withColumnRenamed("song", "inline")
    song = F.coalesce("detail", "inline")
    rows = tracks.where(F.col("song_id").isNotNull() & ~F.col("song_id").isin("", "0")).join(own, "song_id", "left").join(inline, ["playlist_id", "song_id"], "left")
    return rows.select("playlist_id", "track_ord", "song_id", song["name"].alias("name"), F.coalesce(song["artists"], F.array().cast("array<string>")).alias("artists"))


def roll_up(songs: DataFrame, samples: int = SAMPLES, salts: int = SALTS) -> DataFrame:
    """playlist_id, artist_ord, name, song_count, sample_songs from (playlist_id, track_ord, name, artists) rows.

    Every credit counts; the samples are the first distinct titles that are not blank. An artist's credits are cut into
    classes, each with its count, first place and first titles, which are all that meets, and artists are numbered by sorted
    ranges. So a playlist, an artist of one, or a title may have any share of all rows.
    """
    one = ["playlist_id", "artist"]
    credits = songs.select("playlist_id", strip(F.col("name")).alias("title"), "track_ord", F.posexplode("artists").alias("pos", "artist"))
    credits = credits.select(*one, "title", F.struct("track_ord", "pos").alias("at"), F.pmod(F.xxhash64("track_ord"), F.lit(salts)).alias("salt"))
    # One shuffle of the credits serves their titles, the order of these and the classes.
    titles = credits.repartition(*one, "salt").groupBy(*one, "salt", "title").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    first = Window.partitionBy(*one, "salt").orderBy(F.col("title") == "", "at", "title")
    kept = F.when((F.col("k") <= samples) & (F.col("title") != ""), F.struct("at", "title"))
    classes = titles.withColumn("k", F.row_number().over(first)).groupBy(*one, "salt").agg(F.sum("n").alias("n"), F.min("at").alias("at"), F.collect_list(kept).alias("kept"))
    # A title among an artist's first ones is among those of the class that has its first place.
    sample = F.slice(F.array_distinct(F.sort_array(F.flatten(F.collect_list("kept")))["title"]), 1, samples)
    rows = classes.groupBy(*one).agg(F.sum("n").cast("int").alias("song_count"), F.min("at").alias("at"), sample.alias("sample_songs"))
    rows = counted(rows, "playlist_id", "at", "artist", spare=("at",))
    return rows.select("playlist_id", (F.col("index") - 1).alias("artist_ord"), F.col("artist").alias("name"), "song_count", "sample_songs")
