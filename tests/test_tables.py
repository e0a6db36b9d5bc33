"""Merges into a saved table: equal to one import of everything, in touched files alone, one winner among two writers."""

import pytest
from pyspark.sql import functions as F

from rankloom.sources import storage, tables
from rankloom.streaming import sessions as S

SCHEMA = "track_id string, name string, seq long"


def _rows(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def _read(df):
    return [tuple(r) for r in df.orderBy("ord").select("track_id", "name", "ord").collect()]


def _merged(table, rows):
    """The same by a loop: key to (value, place)."""
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[2])
    after = max((place for _, place in table.values()), default=None)
    table = dict(table)
    for key, value, seq in rows:
        place = seq if after is None else seq - rows[0][2] + after + 1
        table[key] = (value, table.get(key, (None, place))[1])
    return table


def _listed(table):
    return sorted(((k, v, place) for k, (v, place) in table.items()), key=lambda r: r[2])


def test_merges_equal_one_import(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [(f"k{i % 90}", f"a{i}", i) for i in range(200)] + [(None, "x", 500)]
    later = [[(f"k{i * 7 % 120}", f"b{i}", i) for i in range(40)], [("k3", None, 5), ("k3", "mid", 4), ("new", "n", 9)]]
    assert tables.merge(_rows(spark, *first), path, buckets=8) == 1
    plain = _merged({}, first)
    assert _read(tables.load(spark, path)) == _listed(plain)
    assert _listed(plain) == _read(storage.upserted(_rows(spark, *first)))  # one import is an upsert
    for n, rows in enumerate(later):
        assert tables.merge(_rows(spark, *rows), path) == n + 2
        plain = _merged(plain, rows)
        assert _read(tables.load(spark, path)) == _listed(plain)
    found = {r[0]: r[1] for r in _read(tables.load(spark, path))}
    assert found["k3"] is None and found["new"] == "n"  # a later null counts
    assert len(_read(tables.load(spark, path, 1))) == 90  # a former version is still there
    with pytest.raises(ValueError):
        tables.load(spark, path, 9)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.merge(_rows(spark, *((f"k{i}", "a", i) for i in range(500))), path, buckets=16)
    before = {r["bucket"]: r["folder"] for r in tables.manifest(spark, path)}
    assert len(before) == 16
    tables.merge(_rows(spark, ("k7", "b", 0)), path)
    after = {r["bucket"]: r["folder"] for r in tables.manifest(spark, path)}
    assert sum(before[b] != after[b] for b in before) == 1
    (changed,) = [r for r in tables.manifest(spark, path) if before[r["bucket"]] != r["folder"]]
    assert len(list((tmp_path / "t/data" / changed["folder"]).glob("bucket=*"))) == 1
    keys = spark.createDataFrame([("k7",), ("absent",), ("k7",)], "track_id string")
    some = tables.lookup(spark, path, keys)
    assert [r["name"] for r in some.collect()] == ["b"]
    assert len({f.rsplit("/", 2)[1] for f in some.inputFiles()}) <= 3  # two buckets and the list of keys at most
    assert tables.lookup(spark, path, keys.limit(0)).collect() == []


def test_two_writers_one_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.merge(_rows(spark, ("a", "one", 1)), path, buckets=4)
    real = tables._claimed

    def beaten(session, source, target):
        monkeypatch.setattr(tables, "_claimed", real)
        tables.merge(_rows(spark, ("b", "winner", 1)), path)
        real(session, source, target)

    monkeypatch.setattr(tables, "_claimed", beaten)
    with pytest.raises(tables.Conflict):
        tables.merge(_rows(spark, ("a", "loser", 1)), path)
    assert _read(tables.load(spark, path)) == [("a", "one", 1), ("b", "winner", 2)]
    assert len(tables.folders(spark, f"{path}/data")) == 2  # the loser's files are gone
    monkeypatch.setattr(tables, "_claimed", beaten)
    assert tables.merge(_rows(spark, ("a", "again", 1)), path, attempts=2) == 4
    assert {r[0]: r[1] for r in _read(tables.load(spark, path))} == {"a": "again", "b": "winner"}


def test_edges_of_merges(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        tables.merge(_rows(spark), path)
    with pytest.raises(ValueError):
        tables.load(spark, path)
    with pytest.raises(ValueError):
        tables.merge(_rows(spark, ("a", "x", 1)).withColumn("bucket", F.lit(1)), path)
    assert tables.versions(spark, path) == [] and tables.folders(spark, f"{path}/incoming") == {}
    assert tables.merge(_rows(spark, ("a", "x", 1), ("b", "y", 2)), path, batch=3) == 1
    assert tables.merge(_rows(spark, ("a", "z", 1)), path, batch=3) == 1  # sent again
    assert tables.merge(_rows(spark), path, batch=4) == 1
    assert tables.merge(_rows(spark, (None, "z", 1)), path) == 1  # no key, so no change
    wider = spark.createDataFrame([("b", 2.5, 1), ("c", 3.5, 2)], "track_id string, popularity double, seq int")
    assert tables.merge(wider, path, batch=5) == 2
    rows = {r["track_id"]: (r["name"], r["popularity"], r["ord"]) for r in tables.load(spark, path).collect()}
    assert rows == {"a": ("x", None, 1), "b": (None, 2.5, 2), "c": (None, 3.5, 4)}
    assert tables.merge(spark.createDataFrame([("a", 1)], "track_id string, seq long"), path) == 3  # keys alone
    assert len(tables.load(spark, path).where("name is null").collect()) == 3


def test_vacuum_keeps_what_versions_name(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(4):
        tables.merge(_rows(spark, *((f"k{i}", f"v{n}", i) for i in range(30 if n == 0 else 3))), path, buckets=8)
    whole, former = _read(tables.load(spark, path)), _read(tables.load(spark, path, 3))
    assert tables.vacuum(spark, path, keep=2) == 0  # too young
    assert tables.versions(spark, path) == [3, 4]
    assert tables.vacuum(spark, path, keep=2, idle_hours=0) == 1  # the second merge's, wholly replaced by the third's
    assert (_read(tables.load(spark, path)), _read(tables.load(spark, path, 3))) == (whole, former)
    with pytest.raises(ValueError):
        tables.vacuum(spark, path, keep=0)


def test_saved_batches_are_compacted(spark, tmp_path):
    schema = "device_id long, seq long, action string, track_id string"
    files = (
        [(1, 1, "add", "a"), (2, 1, "add", "z"), (None, 1, "add", "n")], [(1, 2, "add", "b")], [(1, 3, "open", "b")],
        [(2, 2, "clear", None), (1, 4, "new", None)], [(1, 5, "add", "c"), (None, 2, "add", "m")],
    )
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    found = {}
    for every in (0, 2):
        path = str(tmp_path / f"saved-{every}")
        S.autosave(S.sessions(S.turn_source(spark, str(tmp_path / "in/*"), schema)), path, compact_every=every).awaitTermination()
        found[every] = sorted(map(repr, S.saved_lists(spark, path).collect()))
    assert found[0] == found[2] and len(found[0]) == 4
    path = str(tmp_path / "saved-2")
    assert len(tables.folders(spark, path)) == 1  # the fifth batch waits for its merge
    kept = spark.read.parquet(f"{path}/batch-4").collect()
    assert S.compact_lists(spark, path) == 1 and tables.folders(spark, path) == {}
    spark.createDataFrame(kept, "device_id long, lists int, seq long, playlist string").write.parquet(f"{path}/batch-4")
    before = tables.versions(spark, f"{path}-table")  # as after a loss between merge and drop
    assert S.compact_lists(spark, path) == 1 and tables.versions(spark, f"{path}-table") == before
    assert sorted(map(repr, S.saved_lists(spark, path).collect())) == found[0] and S.compact_lists(spark, path) == 0
