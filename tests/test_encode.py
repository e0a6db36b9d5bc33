"""The encode hook, dense top-k in tiles against numpy, vectors of mixed lengths, and searches that stop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import dense, encode, evaluation, tuning

TEXTS = [(1, "slow jazz for the night"), (2, "SLOW jazz, night"), (3, None), (4, "  "), (5, "loud metal " * 400), (6, "!!!")]


def counted():
    """An encoder that says in its vectors how often it was called; made here, so that workers get its code."""

    class Counted:
        calls = 0

        def __call__(self, texts):
            self.calls += 1
            assert texts == sorted(texts, key=len)
            return np.array([[3.0, 4.0 * self.calls] for _ in texts])

    return Counted


def test_default_encoder_equals_a_plain_reading(spark):
    found = {r["id"]: r["vector"] for r in encode.encoded(spark.createDataFrame(TEXTS, "id long, query string")).collect()}
    rows = encode.HashingEncoder()([t for _, t in TEXTS if t is not None])
    for (i, _), row in zip([x for x in TEXTS if x[1] is not None], rows):
        if i != 4:
            norm = np.linalg.norm(row)
            assert found[i] == pytest.approx(list(row / norm if norm else row))
    assert found[3] is None and found[4] is None and found[6] == [0.0] * 64
    assert np.dot(found[1], found[2]) > 0.6 > np.dot(found[1], found[5])


def test_an_encoder_is_built_once_and_fed_by_length(spark):
    rows = spark.createDataFrame([(i, "x" * (i * 7 % 40 + 1)) for i in range(50)], "id long, query string").coalesce(1)
    found = encode.encoded(rows, make=counted(), batch=10).collect()
    ratios = sorted({round(r["vector"][1] / r["vector"][0], 6) for r in found})
    assert ratios == [pytest.approx(4 * n / 3, abs=1e-5) for n in range(1, 6)]
    assert all(np.linalg.norm(r["vector"]) == pytest.approx(1) for r in found)


def plain(queries, items, k, first=None, cosine=True):
    out = set()
    for q, v in queries:
        scores = []
        for i, x in items:
            if v is not None and x is not None and None not in v and None not in x and len(v) == len(x) > 0:
                a, b = np.array(v[:first], float), np.array(x[:first], float)
                if cosine:
                    a, b = a / (np.linalg.norm(a) or 1), b / (np.linalg.norm(b) or 1)
                scores.append((-np.round(a @ b, 6), i))
        out |= {(q, r + 1, i, round(float(-s), 6)) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("cosine, first", [(True, None), (False, 3)])
def test_dense_in_tiles_with_mixed_lengths(spark, monkeypatch, cosine, first):
    monkeypatch.setattr(dense, "QUERIES", 7)
    monkeypatch.setattr(dense, "ITEMS", 30)
    rng = np.random.default_rng(3)
    some = lambda n: [rng.integers(-3, 4, 2 if i % 5 == 0 else 6).tolist() for i in range(n)]
    queries = list(enumerate(some(25))) + [(100, None), (101, []), (102, [1, None]), (103, [0] * 6)]
    items = [(f"i{n:03}", v) for n, v in enumerate(some(140))] + [("none", None), ("hole", [1, None]), ("zero", [0] * 6)]
    q, i = spark.createDataFrame(queries, "query_id long, vector array<int>"), spark.createDataFrame(items, "item_id string, vector array<int>")
    found = {(r[0], r[1], r[2], round(r[3], 6) + 0.0) for r in dense.top_k(q, i, 4, first, cosine).collect()}
    assert found == {(a, b, c, d + 0.0) for a, b, c, d in plain(queries, items, 4, first, cosine)}
    counted = {r["length"]: (r["valid"], r["dropped"]) for r in dense.validity(i).collect()}
    assert counted == {2: (28, 1), 6: (113, 0), None: (0, 1)}
    assert {r["query_id"] for r in dense.top_k(q, i, 4, dim=2).collect()} == {n for n, v in queries if v is not None and len(v) == 2 and None not in v}
    assert dense.top_k(q.where("1 = 0"), i, 4).isEmpty() and dense.top_k(q, i.where("1 = 0"), 4).isEmpty()


def test_a_search_stops_at_the_first_that_reaches_the_target(spark):
    configs = tuning.grid(spark, a=range(10), b=range(10))
    seen = []

    def evaluate(block):
        seen.append([r["config_id"] for r in block.collect()])
        return block.select("config_id", (F.col("a") * F.col("b") / 81.0).alias("final_score"))

    scores = tuning.search(configs, evaluate, block=20, target=0.3)
    assert len(seen) == 2 and scores.count() == 40 and evaluation.best_config(scores, target=0.3).first()["config_id"] == 39  # 3 * 9
    assert tuning.search(configs, evaluate, block=20, target=2.0).count() == 100
    assert evaluation.best_config(tuning.search(configs, evaluate, block=30)).first()["config_id"] == 99
