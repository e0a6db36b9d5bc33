import hashlib
from collections import Counter

import numpy as np
import pytest
from compare import assert_same

from rankloom.llm import line_dedup, queries
from rankloom.llm.line_dedup import Cuckoo, LineState, dedup

FOLD = {c: c + 32 for c in range(65, 91)}


def key(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def plain(docs: list[tuple], threshold: int = 10, least: int = 1, counted: list[tuple] | None = None) -> list[tuple]:
    lines = [(i, (t or "").split("\n")) for i, t in docs]
    seen = Counter(k for _, t in (docs if counted is None else counted) for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, text in lines:
        kept = [x for x in text if len(key(x)) < least or seen[key(x)] < threshold]
        out.append((i, len(text), len(text) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4)


def held(state):
    return {(r["h1"], r["h2"]): r["n"] for r in state.counts().collect()}


def test_query_against_sql_and_plain_loops(spark, sf_dir, docs):
    found = queries.op12_line_dedup(spark, sf_dir)
    assert_same(found, queries.oracle_sql()["op12_line_dedup"], sf_dir)
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain([tuple(r) for r in docs.select("doc_id", "text").collect()])}
    assert {tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()} == want
    assert sum(w[2] for w in want) > 0


@pytest.fixture(scope="module")
def batches():
    make = lambda lo, hi: [(i, "\n".join([f"line {i}", " Shared LINE\t", f"of {i % 3} thirds", "", f"mod {i % 11}"])) for i in range(lo, hi)]
    return make(0, 60), make(60, 130)


def test_insertions_and_deletions_are_exact_and_reversible(spark, batches):
    old, new = batches
    first, second = frame(spark, old), frame(spark, new)
    state = LineState.create(first)
    before = held(state)
    assert rows(dedup(first, state)) == plain(old)
    state.insert(second)
    assert held(state) == held(LineState.create(frame(spark, old + new)))
    assert rows(dedup(first.union(second), state)) == plain(old + new)
    state.delete(first)
    assert rows(dedup(second, state)) == plain(new)
    state.insert(first)
    state.delete(second)
    assert held(state) == before and rows(dedup(first, state)) == plain(old)
    with pytest.raises(ValueError):
        state.delete(second)
    assert held(state) == before


def test_only_touched_shards_are_written(spark, batches):
    state = LineState.create(frame(spark, batches[0]))
    before = state.manifest()
    state.insert(frame(spark, [(1000, "a line of its own")]))
    after = state.manifest()
    assert sum(before["folders"][s] != after["folders"][s] for s in before["folders"]) == 1
    assert after["version"] == before["version"] + 1
    assert LineState(spark, state.path).insert(frame(spark, batches[0]).where("1 = 0")).manifest() == after


def test_shards_grow_with_the_keys(spark, batches, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    monkeypatch.setattr(line_dedup, "SHARDS", 1)
    state = LineState.create(frame(spark, batches[0][:20]))
    few = state.manifest()["shards"]
    state.insert(frame(spark, batches[0][20:] + batches[1]))
    assert state.manifest()["shards"] > few
    assert rows(dedup(frame(spark, batches[0]), state)) == plain(batches[0], counted=batches[0] + batches[1])


def test_without_a_broadcast(spark, edge, batches, monkeypatch):
    docs = frame(spark, batches[0] + [(0, batches[0][0][1])])
    state, other = LineState.create(docs), LineState.create(edge, threshold=2)
    want, edges = rows(dedup(docs, state)), rows(dedup(edge, other))
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert rows(dedup(docs, state)) == want and rows(dedup(edge, other)) == edges


def test_edges(spark, edge, empty):
    texts = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    for threshold, least in ((1, 1), (2, 1), (2, 0), (2, 6)):
        state = LineState.create(edge, threshold=threshold, least=least)
        assert rows(dedup(edge, state)) == plain(texts, threshold, least)
    nothing = LineState.create(empty)
    assert rows(dedup(empty, nothing)) == [] and held(nothing) == {}
    nothing.insert(edge)
    assert rows(dedup(edge, nothing)) == plain(texts)


def test_filter_holds_copies_and_forgets(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64)
    found = Cuckoo.of(keys)
    assert found.holds(keys).all() and len(found.table) * 4 < 3 * len(keys)
    assert not found.holds(rng.integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64)).any()
    assert all(found.delete(int(k)) for k in keys[:1500])
    assert found.holds(keys[1500:]).all() and not found.holds(keys[:1500]).any()
    twice = Cuckoo(1)
    assert all(twice.insert(7) for _ in range(4)) and not twice.insert(7)
    assert all(twice.delete(7) for _ in range(3))
    assert Cuckoo.from_bytes(found.to_bytes()).holds(keys[1500:]).all()


def test_keys_that_the_filter_confuses_are_exceptions(spark):
    import pandas as pd

    build = line_dedup._filters(10)
    twin = (5 << 32) | 77
    counts = pd.DataFrame({"h1": [0, 64], "h2": [twin, twin], "was": [0, 0], "n": [12, 3]})
    made = build((0,), counts, pd.DataFrame({"shard": [], "keys": [], "exceptions": []}))
    probe = line_dedup._Probe([tuple(made.iloc[0])], 64)
    assert probe.frequent(np.array([[0, twin], [64, twin]])).tolist() == [True, False]
