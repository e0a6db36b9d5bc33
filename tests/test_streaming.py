"""The session state machine by hand, and a stream that goes on from its state."""

from rankloom.streaming import sessions as S


def _run(*commands):
    state = S.start()
    for action, track, *request in commands:
        state = S.step(state, action, track, request[0] if request else None)
    return state


def test_states():
    assert _run(("add", "a"), ("add", "b"), ("add", "a"), ("remove", "a"))["playlist"] == ["b"]
    assert _run(("suggest", "x,y,z", "one"), ("choose", "1,9"))["pending"] == ["x", "y", "z"]
    chosen = _run(("suggest", "x,y,z", "one"), ("choose", "3,1,3"))
    assert chosen["playlist"] == ["z", "x"] and chosen["pending"] == []
    assert _run(("suggest", "x", "one"), ("suggest", "y", "two"), ("suggest", "z", "three"))["requests"] == ["two", "three"]
    assert _run(("suggest", "x", "one"), ("reject", None))["pending"] == []
    cleared = _run(("new", None), ("add", "a"), ("open", "a"), ("suggest", "x", "one"), ("clear", None))
    assert cleared == S.start() | {"lists": 1}


def test_words_choose_among_suggestions():
    names = {"x": ["The Ants", "Red"], "y": ["The Bees", "Blue"], "z": ["The Ants", "Bee song"]}

    def said(*picked):
        return S.step(S.step(S.start(), "suggest", "x,y,z", "r", names), "say", None, None, None, picked)

    for picked, playlist in (
        (("all", [], ""), ["x", "y", "z"]), (("places", [-1, 1], ""), ["z", "x"]), (("first", [2], ""), ["x", "y"]),
        (("by", [], "bees"), ["y"]), (("except", [], "blue"), ["x", "z"]), (("none", [], ""), []),
    ):
        assert (said(*picked)["playlist"], said(*picked)["pending"]) == (playlist, [])
    # beyond what waits, a name of two tracks or of none, and words that are no choice: all go on waiting
    for picked in (("first", [4], ""), ("places", [0], ""), ("places", [9], ""), ("by", [], "ants"), ("by", [], "red"), ("except", [], "bee"), ("except", [], "nobody")):
        assert (said(*picked)["playlist"], said(*picked)["pending"]) == ([], ["x", "y", "z"])
    assert S.step(S.start(), "say", None, None, None, ("all", [], "")) == S.start()


def test_stream_keeps_state_between_batches(spark, tmp_path):
    schema = "device_id long, seq long, action string, track_id string"
    for n, rows in enumerate(([(1, 1, "add", "a"), (2, 1, "add", "z")], [(1, 2, "add", "b"), (1, 3, "remove", "a")], [(2, 2, "clear", None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = S.turn_source(spark, str(tmp_path / "in/*"), schema)
    rows = {(r["device_id"], r["seq"]): r["tracks"] for r in S.drained(S.sessions(source), "test").collect()}
    assert rows == {(1, 1): 1, (1, 2): 2, (1, 3): 1, (2, 1): 1, (2, 2): 0}


def test_lists_are_saved_after_updates_and_a_restart_goes_on(spark, tmp_path):
    schema, path = "device_id long, seq long, action string, track_id string", str(tmp_path / "saved")

    def run(n, *rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        S.autosave(S.sessions(S.turn_source(spark, str(tmp_path / "in/*"), schema)), path).awaitTermination()
        return {(r["device_id"], r["lists"]): (r["seq"], r["playlist"]) for r in S.saved_lists(spark, path).collect()}

    assert run(0, (1, 1, "add", "a"), (1, 2, "add", "b"), (2, 1, "open", "z")) == {(1, 0): (2, "a,b")}
    later = run(1, (1, 3, "suggest", "x,y"), (1, 4, "new", None), (1, 5, "choose", "1"), (2, 2, "add", "z"))
    assert later == {(1, 0): (2, "a,b"), (1, 1): (5, ""), (2, 0): (2, "z")}  # a new list forgets what was suggested
    assert run(2, (1, 6, "add", "c"), (2, 3, "clear", None)) == {(1, 0): (2, "a,b"), (1, 1): (6, "c"), (2, 0): (3, "")}


def test_no_updates_save_no_list(spark, tmp_path):
    schema = "device_id long, seq long, action string, track_id string"
    for name, rows in (("none", []), ("looks", [(1, 1, "open", "a"), (None, 2, None, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}/0"))
        source = S.turn_source(spark, str(tmp_path / f"{name}/*"), schema)
        S.autosave(S.sessions(source), str(tmp_path / f"{name}-saved")).awaitTermination()
        assert S.saved_lists(spark, str(tmp_path / f"{name}-saved")).collect() == []


def test_a_table_that_is_a_folder_streams_all_its_files(spark, sf_dir, tmp_path):
    """Larger tables are folders of files."""
    from rankloom.plans import registry

    spark.read.parquet(f"{sf_dir}/conversations.parquet").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    query = registry.queries()["stream_turns"]
    wanted = sorted(map(tuple, query(spark, sf_dir).collect()))
    assert wanted and sorted(map(tuple, query(spark, str(tmp_path)).collect())) == wanted
