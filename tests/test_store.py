"""The store: merges in part, failed writes, reading by bucket; hashes of files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from setlist.sources.store import KEY, Store
from setlist.sources.tables import file_hashes, files_fingerprint


def rows(spark, own, version="v", source="s"):
    return spark.createDataFrame([(version, source, f, n) for f, n in own], "cache_version string, source string, fingerprint string, n int")


def content(store, version="v", source="s"):
    return sorted((r.fingerprint, r.n) for r in store.read(version, source).collect())


def test_merge_replaces_keys_and_rewrites_their_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=8)
    assert store.read("v", "s") is None and store.versions() == []
    first = [(f"f{i}", i) for i in range(40)] + [("f0", 100)]
    assert store.merge(rows(spark, first)) == 1
    before = store.folders()
    assert content(store) == sorted(first) and len(before) == 8
    update = rows(spark, [("f1", -1), ("f1", -2), ("new", 7)])
    assert store.merge(update) == 2
    assert content(store) == sorted([x for x in first if x[0] != "f1"] + [("f1", -1), ("f1", -2), ("new", 7)])
    touched = set(store.touched(update))
    assert {b for b, f in store.folders().items() if f != before.get(b)} == touched and len(touched) <= 2
    # Another version of the cache, and a column that came later.
    store.merge(rows(spark, [("f2", 5)], version="w").withColumn("more", F.lit("x")))
    assert content(store, "w") == [("f2", 5)] and len(content(store)) == 43
    hits, misses = store.split(rows(spark, [("f3", 0), ("nowhere", 0)]).select(*KEY))
    assert [r.fingerprint for r in hits.collect()] == ["f3"] and [r.fingerprint for r in misses.collect()] == ["nowhere"]


def test_failed_merges_are_never_seen(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    store.merge(rows(spark, [("a", 1), ("b", 2)]))
    with monkeypatch.context() as broken:
        broken.setattr(Store, "_switch", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.merge(rows(spark, [("a", 9)]))
    assert content(store) == [("a", 1), ("b", 2)] and store.versions() == [1]
    (tmp_path / "store/versions/2").mkdir()  # a version that was begun and not ended
    assert content(store) == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        store.merge(rows(spark, [("a", 9)]))
    gone = store.clean()
    assert "2" in gone and len(gone) == 3 and store.merge(rows(spark, [("a", 5)])) == 2
    assert content(store) == [("a", 5), ("b", 2)]
    store.merge(rows(spark, [("b", 6)]))
    store.clean(keep=1)
    assert store.versions() == [3] and content(store) == [("a", 5), ("b", 6)]


def test_file_hashes(spark, tmp_path):
    for i in range(1, 6):
        (tmp_path / f"{i}.bin").write_bytes(bytes([i]) * i * 1000)
    with (tmp_path / "large.bin").open("wb") as f:
        f.truncate((1 << 31) + 5)  # more than an array or a row can hold
        f.seek(1 << 31)
        f.write(b"end")
    found = {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256) for r in file_hashes(spark, str(tmp_path)).collect()}
    for i in range(1, 6):
        assert found[f"{i}.bin"] == (i * 1000, hashlib.sha256(bytes([i]) * i * 1000).hexdigest())
    expected = hashlib.sha256()
    with (tmp_path / "large.bin").open("rb") as f:
        while piece := f.read(1 << 24):
            expected.update(piece)
    assert found["large.bin"] == ((1 << 31) + 5, expected.hexdigest())


def test_fingerprints_of_file_groups(spark):
    own = [(g, i, hashlib.sha256(f"{g}{i}".encode()).hexdigest()) for g in ("a", None, "b") for i in range(3000 if g == "b" else 3)]
    frame = spark.createDataFrame(own, "note string, path int, sha256 string").repartition(7)
    got = {r.note: r.fingerprint for r in files_fingerprint(frame, "note").collect()}
    assert got == {g: hashlib.sha256("".join(h + "\n" for k, _, h in own if k == g).encode()).hexdigest() for g in ("a", None, "b")}
    assert files_fingerprint(frame.limit(0), "note").count() == 0
