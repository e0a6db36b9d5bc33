"""Exact sizes, gapless slots, the drawn matrix, and uniformity."""

import zlib

import numpy as np
import pytest

from rankloom.llm import sharding


@pytest.mark.parametrize("seed", range(4))
def test_matrix_sums(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 1000, 13).tolist()
    total = sum(counts)
    sizes = [total // 8 + (s < total % 8) for s in range(8)]
    m = sharding.communication_matrix(counts, sizes, seed)
    assert m.min() >= 0 and m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes


def test_matrix_follows_the_hypergeometric_law():
    draws = np.array([sharding.communication_matrix([30, 70], [20, 80], seed)[0, 0] for seed in range(2000)])
    assert abs(draws.mean() - 6) < 0.2 and abs(draws.var() - 30 * 0.2 * 0.8 * 70 / 99) < 0.4


def test_whole_table(docs):
    rows = sharding.shard(docs, rows_per_part=20).collect()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert len(rows) == len(text)
    shards = {}
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["law"] == "rows" and r["grown_shard"] is None
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(shards) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    again = sharding.shard(docs.repartition(7), rows_per_part=20).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_ids_mix_evenly(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text")
    rows = sharding.shard(docs, rows_per_part=300).toPandas()
    table = np.zeros((8, 8))
    np.add.at(table, (rows["shard"].to_numpy(), (rows["doc_id"] * 8 // 4000).to_numpy()), 1)
    assert ((table - 62.5) ** 2 / 62.5).sum() < 95  # chi square, 49 degrees of freedom
    assert abs(np.corrcoef(rows["slot"], rows["doc_id"])[0, 1]) < 0.06


def test_edge_rows(edge, empty):
    rows = sharding.shard(edge).collect()
    assert len(rows) == edge.count() and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert sharding.shard(empty).count() == 0


def test_the_law_of_large_populations():
    """Draws beyond numpy's range: the same law as numpy's where both work, and right moments where only one does."""
    import math

    rng = np.random.default_rng(3)
    for good, bad, drawn in ((300, 700, 200), (50, 60, 90), (40_000, 360_000, 5_000)):
        ours = [sharding.hypergeometric(rng, good, bad, drawn, largest=0) for _ in range(6000)]
        theirs = rng.hypergeometric(good, bad, drawn, 6000)
        cuts = np.unique(np.quantile(theirs, np.linspace(0, 1, 9)[1:-1]))
        a, b = (np.bincount(np.searchsorted(cuts, x), minlength=len(cuts) + 1) for x in (ours, theirs))
        assert ((a - b) ** 2 / (a + b)).sum() < 30, (good, bad, drawn, a, b)
    good, bad, drawn = 12_500_000_000, 87_500_000_000, 1_500_000
    draws = np.array([sharding.hypergeometric(rng, good, bad, drawn) for _ in range(4000)], float)
    mean, var = drawn / 8, drawn / 8 * 7 / 8
    assert abs(draws.mean() - mean) < 5 * math.sqrt(var / 4000) and abs(draws.var() / var - 1) < 0.15
    counts, sizes = [10**10 // 4] * 4, [10**10 // 8] * 8
    m = sharding.communication_matrix(counts, sizes, 1)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes
