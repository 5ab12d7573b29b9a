"""Operators that compare texts with each other, and the pipeline, against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from setlist.llm import decontaminate, exact_dedup, simhash, sp_sampling
from setlist.llm.common import attach
from setlist.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, key string, fingerprint long"
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 7) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))


def test_exact_duplicates(spark):
    texts = [None, "", "A b", "a B", "É", "é", "x" * 200_000, "X" * 200_000, "solo", "a b"] + ["hot"] * 50
    rows = list(enumerate(texts)) + [(3, "a B"), (None, "a b"), (None, "null id")]
    got = exact_dedup.exact_duplicates(docs(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(A_TO_Z), []).append(i)
    expected = []
    for i, t in rows:
        own = groups[(t or "").translate(A_TO_Z)]
        keep = max((x for x in own if x is not None), default=None)
        expected.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").translate(A_TO_Z).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0
    rest = exact_dedup.without_duplicates(docs(spark, rows))
    assert rest.columns == ["doc_id", "text", "key", "fingerprint"] and rest.where("text = 'hot'").count() == 1
    kept = sorted((t or "").translate(A_TO_Z) for t in (r.text for r in rest.collect()))
    assert kept == sorted(groups)


def brute_contamination(text, items):
    own = words(text)
    hit, found = set(), set()
    for item_id, item in items:
        w = words(item)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            for i in range(len(own) - n + 1):
                if own[i : i + n] == w[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item_id))
    return len(own), len(hit), sorted(found)


def test_decontamination(spark):
    rng = random.Random(1)
    vocabulary = ["ab", "cd", "ef", "über", "x1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([40, 13, 14, 5, 1, 60, 12])] + [(100, None), (101, ""), (102, "!"), (5, "same id other text with enough words to be a window of thirteen words")]
    texts = [None, "", "no words here at all", items[0][1].upper(), "x " + items[1][1], items[3][1] + " zz", "zz " * 400 + items[2][1], items[5][1][:-3], items[6][1], items[-1][1]]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]
    got = decontaminate.decontaminate(docs(spark, rows), bench).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in got) == sorted(repr((i, *brute_contamination(t, items))) for i, t in rows)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)
    assert decontaminate.decontaminate(docs(spark, []), bench).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(docs(spark, rows), bench.limit(0)).collect()} == {0}


def test_phrase_of_all_items_and_documents(spark):
    phrase = " ".join(f"p{i}" for i in range(20))
    items = [(i, f"{phrase} own{i} " + " ".join(f"i{i}x{j}" for j in range(13))) for i in range(60)] + [(60, "p3"), (61, "p0 p1 p2")]
    texts = [(i, f"d{i} {phrase} e{i} " + (items[i][1] if i < 5 else "")) for i in range(80)] + [(0, "p3 only")]
    got = decontaminate.decontaminate(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in got) == sorted(repr((i, *brute_contamination(t, items))) for i, t in texts)
    all_docs, shared, sets = decontaminate.shared_spans(docs(spark, texts).select("doc_id", "text"), spark.createDataFrame(items, "item_id long, text string"), 13, 7)
    assert sets.count() <= 60 + 3 and shared.count() <= 80 * 8 + 5 * 60 + 400  # no row for each pair of a document and an item


def test_winnowing_keeps_one_of_every_window():
    hashes = np.random.default_rng(2).integers(0, 9, 500).astype(np.uint64)
    kept = set(decontaminate.winnow(hashes, np.full(500, 500), 7).tolist())
    assert all(kept & set(range(i, i + 7)) for i in range(494))


def brute_fingerprint(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z))
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(own[i : i + 3]), 42) for i in range(max(1, len(own) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """The smallest id reachable from each (id, fingerprint)."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 3:
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return [smallest.get(root(i)) for i in range(len(prints))]


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["ab", "cd", "Ef", "gh", "ij"]) + str(rng.randint(0, 30)) for _ in range(120)) for _ in range(6)]
    texts = [None, "", " \n", "one", "one two", "one two three", "ONE\ttwo  three", "é\u00a0x y z"]
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    rows = list(enumerate(texts)) + [(2, texts[10]), (None, texts[11])]
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    expected = sorted(repr((i, f, c)) for (i, f), c in zip(prints, components(prints), strict=True))
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted(repr((r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id)) for r in got) == expected
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_hot_cells_are_tiled(spark):
    rng = np.random.default_rng(6)
    prints = np.unique(np.concatenate([np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)), rng.integers(0, 1 << 63, 200).astype(np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fingerprint long")
    links = simhash.near_links(frame, tile=16)
    roots = {r.node: r.root for r in simhash.star_components(links).collect()}
    ids = [int(x) for x in prints.view(np.int64)]
    expected = components(list(zip(ids, [int(x) for x in prints], strict=True)))
    assert [roots.get(i, i) for i in ids] == expected


def test_tree_makes_all_links(spark):
    """On whole tables: equal to all pairs, most pairs of groups are pruned unseen, and nothing but the tree makes links."""
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = np.unique(np.array([r.fingerprint for r in simhash.fingerprints(known).collect()], np.int64).view(np.uint64))
    rng = np.random.default_rng(9)  # near copies of the table's own fingerprints
    more = prints[rng.integers(0, prints.size, 2000)]
    for _ in range(3):
        more = more ^ (np.uint64(1) << rng.integers(0, 64, more.size).astype(np.uint64))
    prints = np.unique(np.concatenate([prints, more]))
    forest, seen = np.arange(prints.size), {}
    for block in range(4):
        turned = simhash._rotate(prints, 16 * block)
        order = np.argsort(simhash.gray_rank(turned))
        label = simhash.tree_forest(turned[order], lead=0xFFFF << 48, seen=seen)
        simhash._join_labels(forest, order, order[label])
    every = np.arange(prints.size)
    for i in range(prints.size):
        near = np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= 3) + i + 1
        simhash._join_labels(every, np.full(near.size, i), near)
    assert np.array_equal(forest, every) and (np.bincount(every) > 1).sum() > 100
    pairs = prints.size * (prints.size - 1) // 2
    assert seen["pruned nodes"] > 0.4 * seen["nodes"] and seen["fingerprints"] < 0.1 * 4 * pairs
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fingerprint long")
    for tile in (1 << 20, 64):
        roots = {r.node: r.root for r in simhash.star_components(simhash.near_links(frame, tile=tile)).collect()}
        found = np.array([roots.get(int(x), int(x)) for x in prints.view(np.int64)])
        assert np.unique(found).size == np.unique(every).size and all(found[i] == found[j] for i, j in enumerate(every))


def test_hot_keys_are_joined_apart(spark):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(90)] + [(None, 99)], "k int, x int")
    known = spark.createDataFrame([(k, n, f"v{k}") for k, n in rows.groupBy("k").count().where("k < 5").collect()], "k int, n long, v string")
    for how in ("inner", "left"):
        expected = sorted(map(repr, rows.join(known, ["k"], how).collect()))
        for most, hot_rows in ((100, 1), (0, 1 << 20), (2, 20), (1, 2)):
            assert sorted(map(repr, attach(rows, known, ["k"], "n", how, most, hot_rows).collect())) == expected


def test_long_chains_are_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(500, 501)], "a long, b long")
    roots = {r.node: r.root for r in simhash.star_components(chain.orderBy(F.rand(1))).collect()}
    assert roots == {i: 0 for i in range(1, 61)} | {501: 500}


def test_cell_forest_against_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(10):
        base = rng.integers(0, 1 << 63, size=20, dtype=np.uint64)
        prints = base[rng.integers(0, 20, int(rng.integers(1, 700)))]
        for _ in range(int(rng.integers(0, 7))):
            prints = prints ^ (np.uint64(1) << rng.integers(0, 64, prints.size).astype(np.uint64))
        prints = np.unique(prints)
        prints = prints[np.argsort(simhash.gray_rank(prints))]
        label = np.arange(prints.size)
        for i in range(prints.size):
            near = np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= 3) + i + 1
            simhash._join_labels(label, np.full(near.size, i), near)
        assert np.array_equal(label, simhash.tree_forest(prints))


ROWS = [
    (3, "text A of some words", "x"), (3, "text B of other words", "x"), (7, "Text A of some words", "y"), (9, "twice", "x"), (9, "twice", "x"), (9, "TWICE", "z"), (None, "twice", "x"),
    (None, "nobody", "x"), (None, "nobody", "x"), (None, "nobody", "y"), (1, None, "x"), (2, "", "y"), (2, "", None),
]


def test_stages_on_repeated_rows(spark):
    """doc_id, text, text_key and another column; ids repeat with other texts, and whole rows repeat."""
    frame = spark.createDataFrame([(i, t, k, 1) for i, t, k in ROWS], "doc_id long, text string, text_key string, kept int")
    one = [tuple(r)[:2] for r in corpus_pipeline.drop_copies(spark, frame, "").collect()]
    assert sorted(map(repr, ((i, (t or "").lower()) for i, t in one))) == sorted(map(repr, [(7, "text a of some words"), (3, "text b of other words"), (9, "twice"), (None, "nobody"), (2, "")]))
    near = corpus_pipeline.drop_near_copies(spark, frame, "")
    assert near.columns == frame.columns
    prints = {(t, brute_fingerprint(t)) for _, t, _ in ROWS}
    assert len({p for _, p in prints}) == 5  # far apart, but for case
    assert sorted(map(repr, ((r.doc_id, (r.text or "").lower()) for r in near.collect()))) == sorted(map(repr, [(3, "text a of some words"), (3, "text b of other words"), (9, "twice"), (None, "nobody"), (1, "")]))
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        assert stage(spark, frame.limit(0), "").count() == 0


def test_contaminated_rows_go_by_id_and_text(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(20))
    spark.createDataFrame([(1, passage), (2, None), (3, " ")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, passage), (1, "clean"), (None, passage), (None, "clean"), (2, passage), (2, passage), (3, passage + " word" * 400), (4, None), (4, "clean"), (4, "clean")]
    frame = docs(spark, rows)
    left = corpus_pipeline.drop_contaminated(spark, frame, str(tmp_path)).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left))) == sorted(map(repr, [x for x in rows if x[1] != passage]))
    assert corpus_pipeline.drop_contaminated(spark, docs(spark, []), str(tmp_path)).count() == 0


def test_toxic_stage_without_labels(spark, tmp_path):
    frame = docs(spark, [(1, "a"), (1, None), (None, "b"), (2, "a"), (2, "a")])
    for labels in ([], [(1, 0, 0), (2, 1, None), (None, 1, 1)]):
        folder = str(tmp_path / str(len(labels)))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, frame, folder).count() == 5
        assert corpus_pipeline.drop_toxic(spark, frame.limit(0), folder).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    known = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = known
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == known.columns
        rows = after.collect()
        kept.append(rows)
        before = spark.createDataFrame(rows, known.schema)
    assert not any(labels.get(r.doc_id) == 0 for r in set(known.collect()) - set(kept[0]))
    texts = [r.text.translate(A_TO_Z) for r in kept[1]]
    assert len(texts) == len(set(texts)) == len({r.text.translate(A_TO_Z) for r in kept[0]})
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in kept[1]]
    assert {r.doc_id for r in kept[2]} == set(components(prints))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in kept[2] if not (lambda n, hit, _: hit and 20 * hit >= n)(*brute_contamination(r.text, items))}
    assert {r.doc_id for r in kept[3]} == clean
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == clean
    # Every encoding spells its document's text.
    texts = {r.doc_id: r.text for r in kept[3]}
    encoded = sp_sampling.decode(out, tokenizer_path("piece_bpe_32k.model")).collect()
    assert all(r.text == texts[r.doc_id] for r in encoded) and len({(r.doc_id, tuple(r.ids)) for r in encoded}) == len(encoded)
