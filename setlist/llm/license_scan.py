"""License scans by diagonal voting.

All rolling word k-gram hashes of the texts are joined to the positions of the same
k-grams in license templates. A hit votes for its diagonal (text position less template
position). A diagonal with every k-gram of its template is an exact place; neighbouring
diagonals, which insertions and deletions give, are merged and kept if they gather the
votes that any place with enough of the template's words has: each template has the
longest of GRAMS that leaves such a place a vote (bounds()). All places are then verified
on the words themselves: the share of words in order, by the longer of template and
place; the words that decide which license of its family it is have to be there, and none
of another license's.

Defined results: a null or empty text has no words and no places; rows that repeat a
doc_id and text each give a row; a null doc_id is kept as it is; places of one template
that overlap are one place; an empty table gives an empty one; very long texts are
scanned whole; other columns are not read; a template needs at least min(GRAMS) words.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setlist.llm.common import durable, text_key
from setlist.llm.decontaminate import fingerprint_rows, words_of
from setlist.llm.words import ALNUM, find_words, gram_hashes, text_slices

#: Words of a gram; a template takes the first that is short enough.
GRAMS = (5, 2)
#: Merged diagonals of a template lie at most this far apart, or as far as it may lack words.
SLACK = 3
#: Share of a template's words that a place needs, in order, to name its license; of the whole texts, of LONG words.
LEAST, LEAST_LONG, LONG = 0.75, 0.9, 40
#: Positions of templates, and places to verify, up to which they are broadcast.
BROADCAST_POSITIONS, BROADCAST_PLACES = 200_000, 100_000


class Template(NamedTuple):
    """core: the words of the text that tell its license from the others of its family."""

    label: str
    text: str
    core: str = ""
    family: str = ""

    @property
    def least(self) -> float:
        return LEAST_LONG if len(words_of(self.text)) >= LONG else LEAST


#: The phrases whose every exact place counts.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: The parts of Creative Commons and GNU license names.
CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
GNU = {"gpl-2": ("", "2"), "gpl-3": ("", "3"), "lgpl-2.1": ("Lesser ", "2.1"), "lgpl-3": ("Lesser ", "3"), "agpl-3": ("Affero ", "3")}

#: Usual notices of public licenses, and whole texts of short ones.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
TEMPLATES = [
    Template("mit", "Released under the MIT License", "mit"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    ),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", "apache 2", "apache"),
    Template("apache-1.1", "Licensed under the Apache License, Version 1.1", "apache 1", "apache"),
    Template(
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "apache 2",
        "apache",
    ),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    Template("bsd-2", "Licensed under the BSD 2-Clause License", "bsd 2", "bsd"),
    Template("bsd-3", "Licensed under the BSD 3-Clause License", "bsd 3", "bsd"),
    Template("bsd-2", _BSD + _BSD_END, "", "bsd text"),
    Template("bsd-3", _BSD + _BSD_3 + _BSD_END, "endorse promote", "bsd text"),
    Template("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2", "mpl"),
    Template("mpl-1.1", "subject to the Mozilla Public License Version 1.1", "mozilla 1", "mpl"),
    Template("epl-2", "made available under the terms of the Eclipse Public License 2.0", "eclipse 2", "epl"),
    Template("epl-1", "made available under the terms of the Eclipse Public License v1.0", "eclipse v1", "epl"),
    Template("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
    Template("cc0-1", "CC0 1.0 Universal Public Domain Dedication", "cc0"),
    *[Template(f"cc-{c}", f"{before}CC {c.upper()} 4.0", f"cc {c.removeprefix('by-') if '-' in c else 'by'}", "cc") for c in CC for before in ("", "Licensed under ")],
    *[Template(f"cc-{c}", f"licensed under a Creative Commons {name} 4.0 International License", f"commons {name}", "creative commons") for c, name in CC.items()],
    *[Template(label, f"This work is licensed under the GNU {kind}General Public License, version {version}", f"gnu {kind}{version}", "gnu") for label, (kind, version) in GNU.items()],
    *[
        Template(label, f"under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version", f"gnu {kind}{version}", "gnu")
        for label, (kind, version) in GNU.items()
    ],
]


class Bounds(NamedTuple):
    """Of each template: the words of its grams, the votes that a place has at least, and the words that it may lack."""

    k: list[int]
    votes: list[int]
    lack: list[int]


def bounds(sizes: list[int], least: list[float], grams: tuple[int, ...] = GRAMS) -> Bounds:
    """Of n words a place may lack m. One that another takes the place of spoils k of the n - k + 1 grams.

    One left out spoils k and one put in k - 1, which a run of n text words has m times at most.
    """
    lack = [int((1 - share) * n + 1e-9) for n, share in zip(sizes, least, strict=True)]
    k = [next((k for k in grams if n - (k - 1) - k * m >= 1), min(grams)) for n, m in zip(sizes, lack, strict=True)]
    return Bounds(k, [max(1, n - (k - 1) - (2 * k - 1) * m) for n, m, k in zip(sizes, lack, k, strict=True)], lack)


def template_positions(templates: list[str], ks: list[int], longest: int) -> list[tuple[int, int, int]]:
    """(hash, template, position) of the k-grams of each template; hashes of grams shorter than `longest` as fingerprint_rows() has them."""
    found = []
    for i, (text, k) in enumerate(zip(templates, ks, strict=True)):
        for _, _, data, offsets in text_slices(pa.array([text])):
            words = find_words(data, offsets, ALNUM)
            grams, at = gram_hashes(words.hashes(), words.of_text, k)
            grams = grams if k == longest else grams ^ np.uint64(k)
            found += [(h, i, p) for h, p in zip(grams.view(np.int64).tolist(), at.tolist(), strict=True)]
    return found


class Rule(NamedTuple):
    """What a place of a template is verified by: its words, which of them decide, and the deciding ones of its family that it has not."""

    words: list[str]
    least: float
    core: frozenset[str]
    others: frozenset[str]


def rules_of(phrases: list[tuple[str, str]], templates: list[Template]) -> list[Rule]:
    cores = {}
    for t in templates:
        cores.setdefault(t.family, set()).update(words_of(t.core))
    own = [Rule(words_of(text), 1.0, frozenset(), frozenset()) for _, text in phrases]
    return own + [Rule(w := words_of(t.text), t.least, frozenset(words_of(t.core)), frozenset((cores[t.family] if t.family else set()) - set(w))) for t in templates]


def verified(run: list[str], rule: Rule) -> tuple[int, int, float] | None:
    """(first, last + 1, score) of the rule's words in a run of text words, if they name its license."""
    blocks = [b for b in SequenceMatcher(None, run, rule.words, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return None
    first, last = blocks[0].a, blocks[-1].a + blocks[-1].size
    score = sum(b.size for b in blocks) / max(len(rule.words), last - first)
    inside = set(run[first:last])
    return (first, last, score) if score >= rule.least - 1e-9 and rule.core <= inside and not rule.others & inside else None


def best_place(words: list[str], start: int, end: int, rule: Rule) -> tuple[int, int, float] | None:
    """The best verified place in words[start:end]: of all of them, or of a run as long as the template."""
    start, end, n = max(0, start), min(len(words), end), len(rule.words)
    there = set(words[start:end])
    if not rule.core <= there or sum(w in there for w in rule.words) < rule.least * n - 1e-9:
        return None
    runs = [(start, end)]
    if n < LONG:
        runs += [(s, s + n) for s in range(start, end - n + 1)]
    found = [(s + p[0], s + p[1], p[2]) for s, e in runs if (p := verified(words[s:e], rule))]
    return max(found, key=lambda p: (p[2], -p[0]), default=None)


def _verify(rules: list[Rule]):
    arrow = pa.schema([("key", pa.int64()), ("text_key", pa.int64()), ("places", pa.list_(pa.struct([("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("exact", pa.bool_()), ("score", pa.float64())])))])

    def place(words: list[str], x: dict) -> dict | None:
        rule = rules[x["template"]]
        if x["exact"] and words[x["start"] : x["end"]] == rule.words:
            return {**x, "score": 1.0}
        found = best_place(words, x["start"], x["end"], rule) if not x["exact"] else None
        return {**x, "start": found[0], "end": found[1], "score": found[2]} if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"key": [], "text_key": [], "places": []}
            for row in batch.to_pylist():
                words = words_of(row["text"])
                out["key"].append(row["key"])
                out["text_key"].append(row["text_key"])
                out["places"].append([p for x in row["places"] if (p := place(words, x))])
            yield pa.RecordBatch.from_pydict(out, arrow)

    return run


def needed_words(rules: list[Rule], ks: list[int], lack: list[int], most: int = 63) -> tuple[list[str], list[int], list[int]]:
    """(words, bits of those that each rule's places all have, bits of those of which they have one at least; 0 for no demand).

    Deciding words are always there, and so is each word of a rule that lacks none. Of any lack + 1 words one is; the longest
    are taken. Rules with the longest grams need none: few texts have those.
    """
    number: dict[str, int] = {}

    def bits(words: set[str]) -> int:
        if len(number.keys() | words) > most:
            return 0
        return sum(1 << number.setdefault(w, len(number)) for w in sorted(words))

    every = [bits(set(r.core) | (set(r.words) if m == 0 else set())) for r, m in zip(rules, lack, strict=True)]
    some = [bits(set(sorted(set(r.words), key=lambda w: (-len(w), w))[: m + 1])) if not own and k < max(GRAMS) and len(set(r.words)) > m else 0 for r, own, k, m in zip(rules, every, ks, lack, strict=True)]
    return list(number), every, some


def hits(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row (key, text_key, n_words, position -1) for each text, and one (position, template, at) for each k-gram that it shares with a template.

    Only with those whose needed words the text has: the pairs of words that templates share with any text, like "under the",
    give no rows where nothing speaks of the license.
    """
    k, _, lack = bounds([len(r.words) for r in rules], [r.least for r in rules])
    longest = max(k)
    words, every, some = needed_words(rules, k, lack)
    positions = [(h, i, p, every[i], some[i]) for h, i, p in template_positions([" ".join(r.words) for r in rules], k, longest)]
    known = docs.sparkSession.createDataFrame(positions, "hash long, template int, at int, every long, some long")
    rows = fingerprint_rows(docs, "doc_id", "text", longest, longest, sorted(set(k) - {longest}), words)
    rows = rows.join(F.broadcast(known) if len(positions) <= BROADCAST_POSITIONS else known, "hash", "left")
    marks = F.col("marks")
    likely = (marks.bitwiseAND(F.col("every")) == F.col("every")) & ((F.col("some") == 0) | (marks.bitwiseAND(F.col("some")) != 0))
    return durable(rows.where(F.col("position").eqNullSafe(-1) | (F.col("template").isNotNull() & likely)).select("key", "text_key", "n_words", "position", "template", "at"))


def license_places(docs: DataFrame, rules: list[Rule], slack: int = SLACK) -> DataFrame:
    """doc_id, text_key, n_words, places (template, start, end, exact, score) for each document; words count from 0, ends are exclusive."""
    sizes = [len(r.words) for r in rules]
    if min(sizes) < min(GRAMS):
        raise ValueError(f"a template needs at least {min(GRAMS)} words")
    k, fewest, lack = bounds(sizes, [r.least for r in rules])
    rows = hits(docs, rules)

    size, gram, few, spread = (F.element_at(F.array(*map(F.lit, x)), F.col("template") + 1) for x in (sizes, k, fewest, lack))
    text = ["key", "text_key", "template"]
    votes = rows.where("position >= 0").select(*text, "position", "at").distinct()
    diagonals = votes.groupBy(*text, (F.col("position") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"))
    order = Window.partitionBy(*text).orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > F.greatest(F.lit(slack), spread)).cast("int"), F.lit(0))
    diagonals = diagonals.withColumn("apart", apart).withColumn("group", F.sum("apart").over(order)).withColumn("whole", F.col("votes") == size - (gram - 1))
    exact = diagonals.where("whole").select(*text, F.col("diagonal").alias("start"), (F.col("diagonal") + size).alias("end"), F.lit(True).alias("exact"))
    merged = diagonals.groupBy(*text, "group").agg(F.sum("votes").alias("votes"), F.max("whole").alias("whole"), F.min("diagonal").alias("first"), F.max("diagonal").alias("last"))
    # The grams left may all be from one end of the template, and words put in or left out shift the rest.
    merged = merged.where(~F.col("whole") & (F.col("votes") >= few)).select(*text, (F.col("first") - spread).alias("start"), (F.col("last") + size + spread).alias("end"), F.lit(False).alias("exact"))
    places = exact.unionByName(merged).groupBy("key", "text_key").agg(F.sort_array(F.collect_list(F.struct("template", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "exact"))).alias("places"))
    places = durable(places)

    whole = docs.select(F.col("doc_id").cast("long").alias("key"), text_key(F.col("text")).alias("text_key"), "text")
    there = places.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    near = F.broadcast(places) if there <= BROADCAST_PLACES else places
    texts = whole.join(near, (whole.text_key == near.text_key) & whole.key.eqNullSafe(near.key)).select(whole.key, whole.text_key, "text", "places")
    kind = "array<struct<template:int,start:bigint,end:bigint,exact:boolean,score:double>>"
    verified = texts.mapInArrow(_verify(rules), f"key long, text_key long, places {kind}").dropDuplicates(["key", "text_key"])
    all_docs = rows.where("position < 0")
    joined = all_docs.join(verified, (all_docs.text_key == verified.text_key) & all_docs.key.eqNullSafe(verified.key), "left")
    return joined.select(all_docs.key.alias("doc_id"), all_docs.text_key, "n_words", F.coalesce("places", F.array().cast(kind)).alias("places"))


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[Template] = TEMPLATES, slack: int = SLACK) -> DataFrame:
    """license_places() with `base`, the exact places of the phrases, and sorted `base_labels`, `labels` and the best `score`."""
    names = [label for label, _ in phrases] + [t.label for t in templates]
    found = license_places(docs, rules_of(phrases, templates), slack)
    named = F.array(*map(F.lit, names))
    base = F.filter("places", lambda p: p["exact"] & (p["template"] < len(phrases)))
    label = lambda p: F.element_at(named, p["template"] + 1)
    return found.withColumns(
        {
            "base": base,
            "base_labels": F.array_sort(F.array_distinct(F.transform(base, label))),
            "labels": F.array_sort(F.array_distinct(F.transform("places", label))),
            "score": F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)),
        }
    )
