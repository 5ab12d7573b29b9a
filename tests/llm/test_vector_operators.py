"""Vector codes, near-duplicate embeddings and token alignment against brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from setlist.llm import embedding_dedup, token_alignment, vector_codes
from setlist.llm.queries import tokenizer_path

VECTORS = "vec_id long, embedding array<float>, label int, node long, whole string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, "x") for i, v, label in rows], VECTORS)


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and not len(v) % parts and all(x is not None and math.isfinite(x) for x in v)]
    most = sorted(Counter(len(v) for _, v, _ in kept).items(), key=lambda x: (-x[1], x[0]))[0][0]
    kept = [x for x in kept if len(x[1]) == most]
    width = most // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    first = sorted(kept, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: [min((apart(x, e), k) for k, e in enumerate(book)) for x, book in zip(cut(v), books, strict=True)]
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v, _ in kept:
            for p, (x, (_, k)) in enumerate(zip(cut(v), nearest(v), strict=True)):
                own[p, k].append(x)
        for (p, k), found in own.items():
            books[p][k] = tuple(sum(c) // len(found) for c in zip(*found, strict=True))
    out = [(i, "".join(f"{k:02x}" for _, k in nearest(v)), sum(d for d, _ in nearest(v)), label) for i, v, label in kept]
    by_label = Counter()
    for _, _, error, label in out:
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, code, error, by_label[label], digest) for i, code, error, label in out]


def test_vector_codes(spark):
    draw = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in draw.normal(0, 0.3, 32)], int(i % 4) or None) for i in draw.permutation(130)]
    rows += [(200 + i, rows[3][1], 2) for i in range(60)] + [rows[0], (rows[1][0], rows[2][1], 3), (None, rows[5][1], None)]
    rows += [(300, None, 1), (301, [None] + [0.0] * 31, 1), (302, [float("nan")] * 32, 1), (303, [float("inf")] + [0.0] * 31, 1), (304, [], 1), (305, [0.5] * 16, 1), (306, [1.0] * 31, 1), (307, [0.0] * 32, 9), (308, [-0.001] * 32, 9)]
    for some in (rows, rows[:40], rows[-2:-1]):
        got = [tuple(r) for r in vector_codes.vector_codes(vectors(spark, some).repartition(5)).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute_codes(some)))
    assert vector_codes.vector_codes(vectors(spark, [])).count() == 0
    assert vector_codes.vector_codes(vectors(spark, rows[-9:-8])).count() == 0
    huge = vectors(spark, [(i, [3e38 * (-1) ** i] * 16, 1) for i in range(3)])
    assert [r.error for r in vector_codes.vector_codes(huge).collect()] == [0, 0, 0]


def test_search_prunes_and_finds_the_nearest():
    draw = np.random.default_rng(6)
    points, book = draw.integers(-100, 100, (500, 3, 4)), draw.integers(-100, 100, (3, 64, 4))
    book[:, 40] = book[:, 9]  # a tie goes to the lower number
    pivots = vector_codes.Pivots.of(book)
    search = vector_codes.Search(book, pivots)
    entry, best = search.nearest(points, pivots.distances(points).astype(np.float32))
    every = ((points[:, :, None] - book[None]) ** 2).sum(axis=3)
    assert np.array_equal(entry, every.argmin(axis=2)) and np.array_equal(best, every.min(axis=2))
    assert search.evaluated < every.size / 4


def brute_links(rows):
    kept = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root = list(range(len(rows)))
    links = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in kept:
        for b in kept:
            x, y = rows[a][1], rows[b][1]
            if a < b and len(x) == len(y) and math.sumprod(x, y) / math.sqrt(math.sumprod(x, x) * math.sumprod(y, y)) >= 0.95:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    return [(i, links[k], smallest.get(find(k)), i == smallest.get(find(k))) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("tile", [2048, 8])
def test_near_embeddings(spark, tile):
    draw = np.random.default_rng(7)
    near = lambda v, by: [float(np.float32(x)) for x in np.asarray(v) + draw.normal(0, by, len(v))]
    centres = [near([0.0] * 24, 1.0) for _ in range(40)]
    rows = [(int(i), near(centres[i % 40], 0.02 if i % 3 else 1.0)) for i in draw.permutation(160)]
    rows += [(500 + i, centres[0]) for i in range(30)] + [(600 + i, near(centres[1], 0.01)) for i in range(30)]
    rows += [(700, [2 * x for x in centres[2]]), (701, [-x for x in centres[2]]), (701, centres[3]), (701, centres[3]), (None, centres[4]), (None, near([0.0] * 24, 1.0))]
    rows += [(800, None), (801, []), (802, [0.0] * 24), (803, [0.0] * 24), (804, [float("nan")] * 24), (805, [None, 1.0]), (806, [1.0, 0.0]), (807, [1.0, 0.01]), (808, [1.0]), (809, [3e38] * 24), (810, [1e-38] * 24)]
    got = embedding_dedup.near_embeddings(vectors(spark, [(i, v, 1) for i, v in rows]).repartition(5), tile=tile)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_links(rows)))
    assert embedding_dedup.near_embeddings(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("number", [1_000, 1_000_000_000])
def test_the_weakest_pairs_meet(number):
    draw = np.random.default_rng(8)
    a = draw.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.normal(size=(1500, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b
    width, hashes, tables = embedding_dedup.parameters(number)
    meet = (embedding_dedup.bucket_keys(a, width, hashes, tables) == embedding_dedup.bucket_keys(b, width, hashes, tables)).any(axis=1)
    assert meet.mean() > 0.98


def brute_alignment(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    byte_level = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    byte_level.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed value: the bytes that stand for themselves
    bytes_of = {chr(b): b for b in letters} | {chr(256 + n): b for n, b in enumerate(x for x in range(256) if x not in letters)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    found = []
    for t in texts:
        wanted = (" " + t).encode() if t else None
        a = byte_level.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pieces.encode(t) if t else []
        a_bytes = [bytes(bytes_of[c] for c in byte_level.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(a_bytes) != wanted or b"".join(b_bytes) != wanted:
            found.append([])
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in s]).tolist() for s in (a_bytes, b_bytes))
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        found.append(groups)
    count, best = Counter(), Counter()
    for groups in found:
        count.update({(x, y) for a, b in groups for x in a for y in b})
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for groups in found:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), digest))
    return out


TEXTS = [None, "", " ", "a", "  two  blanks \n\n and\ttabs ", "It's the end<|endoftext|> of <s>it</s>", "naïve café Straße ½ ﬁ", "日本語のテキスト 🎉🎉🎉 x", "▁ is lost", "x\x00y﻿", "aaaa" * 50, "-" * 70, "é" * 33, "the cat sat on the mat", "the cat sat on the mat", "The Cat; sat_on 12345 the mat!"]


@pytest.mark.parametrize("frequent", [1 << 18, 7, 0])
def test_alignment(spark, frequent):
    import public_tokenizers

    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()]
    rows = list(enumerate(texts)) + [(None, "the cat"), (3, "the cat"), (3, "the cat")]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, row long, pair string, a_ids long").repartition(4)
    got = token_alignment.alignment(df, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokenizer_path("piece_bpe_32k.model"), frequent=frequent)
    expected = [(i, *x) for (i, _), x in zip(rows, brute_alignment([t for _, t in rows]), strict=True)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    assert token_alignment.alignment(df.limit(0), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokenizer_path("piece_bpe_32k.model"), frequent=frequent).count() == 0


def test_runs_are_skipped():
    a = list(range(1, 1001))
    assert token_alignment.align(a, list(a)).size == 0
    b = [x for x in a if x not in (1, 2, 500, 701, 703)]
    assert token_alignment.align(a, b).tolist() == [[0, 3, 0, 1], [499, 501, 497, 498], [700, 702, 697, 698], [702, 704, 698, 699]]
    assert token_alignment.align(b, a).tolist() == [[i, j, k, m] for k, m, i, j in token_alignment.align(a, b).tolist()]
    assert token_alignment.align([], []).size == 0


def test_stretches_between_blanks_stand_alone():
    import public_tokenizers

    both = token_alignment.load_tokenizers(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokenizer_path("piece_bpe_32k.model"))
    assert not both.whole
    draw = np.random.default_rng(9)
    for _ in range(300):
        text = "".join(draw.choice(list("abz XY'.,-19\n\t\r\x85\xa0\u2003\x1c好é🎉\u0301") + ["  ", " '", "'s", " the", "ing ", " 20", "<s>"], 60))
        stretches = token_alignment._BLANK.split(text)
        assert " ".join(stretches) == text
        whole, cut = both.encode(text), [both.encode(x) for x in stretches]
        assert sum([x[0] for x in cut], []) == whole[0] and sum([x[1] for x in cut], []) == whole[1]
        plain = [x == x.strip() for x in stretches]
        order = [x for x, p in zip(stretches, plain, strict=True) if p], [x for x, p in zip(stretches, plain, strict=True) if not p]
        ids, ends, good = both.encode_each(*order)
        cut = [both.encode(x) for x in sum(order, [])]
        whole = [sum([x[side] for x in cut], []) for side in (0, 1)]
        assert all(i.tolist() == w for i, w in zip(ids, whole, strict=True)) and good.all()
        assert all(np.diff(e).tolist() == [len(x[side]) for x in cut] for side, e in enumerate(ends))


def test_groups(spark):
    import public_tokenizers

    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    paths = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokenizer_path("piece_bpe_32k.model")
    for r in token_alignment.groups(df, *paths, lists=True).collect():
        assert (len(r.a_ids), len(r.b_ids), len(r.a_sizes)) == (r.n_a, r.n_b, r.n_groups)
        i = j = 0
        named, links = [], Counter()
        for n, m in zip(r.a_sizes, r.b_sizes, strict=True):
            a, b = r.a_ids[i : i + n], r.b_ids[j : j + m]
            named.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
            links.update((x << 20) + y for x in a for y in b)
            i, j = i + n, j + m
        assert links == dict(zip(r.pairs, r.links, strict=True)) and sum(r.links) == r.n_links
        assert r.groups_sha256 == (hashlib.sha256(";".join(named).encode()).hexdigest() if named else "")
