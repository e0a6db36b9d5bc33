import hashlib
import json

import pytest
from pyspark.sql import functions as F

from rankloom.sources import storage


def _rows(spark, rows):
    return spark.createDataFrame(rows, "track_id string, name string, seq long")


def test_upsert_keeps_the_first_place_and_the_last_value(spark):
    rows = _rows(spark, [("b", "one", 1), ("a", "two", 2), ("b", "three", 3), (None, "x", 4)])
    assert [tuple(r) for r in storage.upserted(rows).orderBy("ord").collect()] == [("b", "three", 1), ("a", "two", 2)]


def test_import_commits_by_marker(spark, tmp_path):
    path = str(tmp_path / "catalog")
    assert storage.import_catalog(_rows(spark, [("b", "one", 1), ("a", "two", 2), ("b", "three", 3)]), path, "here") == 2
    assert {r["name"] for r in storage.load_catalog(spark, path, "here").collect()} == {"two", "three"}
    with pytest.raises(ValueError):
        storage.load_catalog(spark, path, "elsewhere")
    with pytest.raises(ValueError):
        storage.import_catalog(_rows(spark, []), path, "here")
    assert storage.load_catalog(spark, path, "here").count() == 2  # the failed import left the old one


def test_chunks_resume(spark, tmp_path):
    path, seen = str(tmp_path / "chunks"), []
    sessions = spark.range(10).withColumn("ord", F.col("id"))

    def process(part):
        seen.append(sorted(r["chunk"] for r in part.select("chunk").distinct().collect()))
        return part.select("id", "chunk", F.explode(F.array(F.lit(1), F.lit(2))).alias("turn"))

    storage.run_chunks(sessions.where("ord < 6"), process, path, 3)
    out = storage.run_chunks(sessions, process, path, 3, 2)
    assert seen == [[0, 1], [2, 3]] and out.count() == 20


def test_json_list_and_predictions(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"query_id": 1, "predicted_track_ids": ["x", "y"]}, {"query_id": 2, "predicted_track_ids": []}]')
    rows = storage.read_json_list(spark, str(tmp_path / "a.json"), "query_id long, predicted_track_ids array<string>")
    long = storage.long_form(rows)
    assert sorted(tuple(r) for r in long.select("query_id", "rank", "item_id").collect()) == [(1, 1, "x"), (1, 2, "y")]
    storage.write_predictions(long, str(tmp_path / "out"), as_json=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def _artifact():
    weights = {"HH": 0.1, "HL": 0.1, "LH": 0.1, "LL": 0.1}
    return {
        "schema_version": 1, "hybrid": {"candidate_k": 50, "reservoir_k": 100, "dense_weight": 0.25, "rrf_k": 60, "fusion_rrf_k": 60}, "fusion_weights": weights, "exact_weights": weights,
        "diversity": {"protect": 10, "weight": 0.2}, "selective": {"protect": 12, "weight": 1.35, "bonus": 0.14, "start": 11, "end": 100},
        "diversity_statistics": {"total_turns": 3}, "selective_statistics": {"total_turns": 3},
    }


def test_artifact_is_checked_and_replayed(spark, tmp_path):
    rank = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id long, rank int, item_id string")
    other = spark.createDataFrame([(1, 1, "b"), (1, 2, "a")], "query_id long, rank int, item_id string")
    times = spark.createDataFrame([("a", 1)], "item_id string, times long")
    path = str(tmp_path / "artifact")
    storage.export_artifact(spark, _artifact(), {"times": times}, rank, rank, path)
    with pytest.raises(ValueError):
        storage.export_artifact(spark, _artifact(), {"times": times}, rank, other, path)
    settings, tables = storage.load_artifact(spark, path)
    assert settings["selective"]["weight"] == 1.35 and tables["times"].count() == 1
    assert tables["rankings"].first()["predicted_track_ids"] == ["a", "b"]
    folder = tmp_path / "artifact" / settings["tables"]["times"]
    for row in storage.file_digests(spark, str(folder)).collect():
        content = (folder / row["file"]).read_bytes()
        assert (row["length"], row["sha256"]) == (len(content), hashlib.sha256(content).hexdigest())
    times.limit(0).write.mode("append").parquet(str(folder))  # a file more
    with pytest.raises(ValueError):
        storage.load_artifact(spark, path)
    assert [r["query_id"] for r in storage.replay_mismatches(rank, other).collect()] == [1]
    for broken in ({"schema_version": 2}, {"diversity": {"protect": float("nan"), "weight": 0.1}}, {"selective": {}}, {"diversity_statistics": {}}):
        with pytest.raises(ValueError):
            storage.validated_artifact(_artifact() | broken)


def test_best_so_far_is_saved_when_it_is_better(spark, tmp_path):
    path = str(tmp_path / "best")
    scores = lambda *rows: spark.createDataFrame(rows, "config_id int, final_score double")
    assert storage.load_best(spark, path) is None
    assert not storage.save_best(scores((1, None), (2, float("nan"))), path)
    assert storage.save_best(scores((3, 0.5), (2, 0.5), (1, 0.4)), path)
    assert not storage.save_best(scores((1, 0.5), (9, 0.1)), path)  # no better
    assert tuple(storage.load_best(spark, path)) == (2, 0.5)
    assert storage.save_best(scores((7, 0.6)), path)
    assert tuple(storage.load_best(spark, path)) == (7, 0.6)


def test_training_examples(spark, tmp_path):
    (tmp_path / "examples.json").write_text(json.dumps({"add": ["add it", " ", "put it in"], "clear": []}, indent=1))
    rows = storage.read_examples(spark, str(tmp_path / "examples.json")).collect()
    assert sorted(map(tuple, rows)) == [("add", 0, "add it"), ("add", 2, "put it in")]


def test_staged_tables_of_former_runs_are_cleared(spark):
    """Those of an age go; younger ones, indexes and other folders stay."""
    import os
    import time

    folder = storage.shared_dir(spark)
    number = "0123456789abcdef" * 2
    names = [f"rankloom-old-{number}", f"rankloom-stream-x-{number}-checkpoint", f"rankloom-young-{number}", f"rankloom-index-{number}", "rankloom-old", f"other-{number}"]
    for name in names:
        spark.range(1).write.parquet(f"{folder}/{name}")
        age = 0 if "young" in name else 5000 * 3600
        os.utime(f"{folder}/{name}", (time.time() - age,) * 2)
    mine = storage.staged(spark.range(3), "mine")
    assert storage.clear_staged(spark, idle_hours=4000) == names[:2]
    assert mine.count() == 3 and all(os.path.isdir(f"{folder}/{name}") for name in names[2:])
