"""Playlist and note URLs, image URLs and their fingerprints."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setlist.functions.dates import strip

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?[^#]*)?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


@F.pandas_udf(T.ArrayType(T.StringType()))
def unescape_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda xs: None if xs is None else [html.unescape(x) for x in xs])


def playlist_id(url: Column) -> Column:
    """`id` of the query, of the fragment's query, or the first id= with digits; null for none."""
    text = strip(url)
    value = lambda part: F.nullif(F.regexp_extract(part, r"(?:^|&)id=([^&]+)", 1), F.lit(""))
    query = F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1)
    inner = F.regexp_extract(text, r"^[^#]*#[^?]*\?(.*)$", 1)
    return F.coalesce(F.try_url_decode(F.coalesce(value(query), value(inner))), F.nullif(F.regexp_extract(text, r"id=(\d+)", 1), F.lit("")))


def note_url(url: Column) -> Column:
    """Without query and fragment, lower-case host, https for no scheme, no slash at the end."""
    text = strip(url)
    path = F.regexp_replace(_part(text, 3), "/+$", "")
    scheme, host = F.lower(_part(text, 1)), F.lower(_part(text, 2))
    path = F.when(path == "", "/").otherwise(path)
    return F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit(":"), F.when((host != "") | F.startswith(path, F.lit("//")), F.concat(F.lit("//"), host)).otherwise(""), F.when((host != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path))


def note_key(url: Column) -> Column:
    return F.sha2(note_url(url), 256)


def image_mark(url: Column) -> Column:
    """What stays of an image URL across dates and sizes: its id after /spectrum/, or the URL without query."""
    text = strip(url)
    path = _part(text, 3)
    stable = F.regexp_replace(F.regexp_extract(path, r"/spectrum/([^!]*)", 1), "^/+|/+$", "")
    scheme, host = F.lower(_part(text, 1)), F.lower(_part(text, 2))
    plain = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit(":"), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), F.regexp_replace(path, "/+$", ""))
    return F.when(stable != "", F.concat(F.lit("xhs-spectrum:"), F.lower(stable))).otherwise(plain)


def images_fingerprint(urls: Column) -> Column:
    """SHA-256 of the marks of an ordered list of image URLs."""
    return F.sha2(F.array_join(F.transform(urls, image_mark), "\n"), 256)


def source_key(source: Column) -> Column:
    return F.left(F.sha2(F.coalesce(source, F.lit("")), 256), F.lit(16))


def image_urls(page: Column, limit: int | None = None) -> Column:
    """Distinct https URLs of the marked images of a page, in order."""
    tags = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"(?i)<img\b[^>]*data-xhs-img[^>]*>"), F.lit(0))
    raw = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r'\bsrc="([^"]+)"', 1)), lambda u: u != "")
    # Only the first http:// of a URL is changed.
    secure = F.array_distinct(F.transform(unescape_all(raw), lambda u: F.when(F.contains(u, F.lit("http://")), F.concat(F.substring_index(u, "http://", 1), F.lit("https://"), F.substring(u, F.char_length(F.substring_index(u, "http://", 1)) + 8, F.char_length(u)))).otherwise(u)))
    return secure if limit is None else F.slice(secure, 1, limit)
