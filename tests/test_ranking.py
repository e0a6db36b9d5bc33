"""Fusion and re-ranking against plain Python over random rankings, and by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import evaluation, ranking, requests, tuning
from rankloom.sources import storage


def frame(spark, lists):
    return spark.createDataFrame([(q, r, i) for q, items in lists.items() for r, i in enumerate(items, 1)], "query_id long, rank int, item_id string")


def lists_of(df):
    return {r["query_id"]: list(r["predicted_track_ids"]) for r in storage.array_form(df).collect()}


def random_lists(rng, queries=6, pool=40, most=20, least=0):
    out = {q: rng.sample([f"t{i:02d}" for i in range(pool)], rng.randint(least, most)) for q in range(queries)}
    return {q: items for q, items in out.items() if items}


def plain_rrf(a, b, w, k, top):
    score = {i: (1 / (k + a.index(i) + 1) if i in a else 0) + (w / (k + b.index(i) + 1) if i in b else 0) for i in {*a, *b}}
    place = lambda items, i: items.index(i) if i in items else 10**9
    return sorted(score, key=lambda i: (-round(score[i], 9), place(a, i), place(b, i), i))[:top]


def novelty(count, turns):
    return math.log((turns + 1) / (count + 1)) / math.log(turns + 1) if turns > 0 else 0.0


def counts(lists):
    out = {}
    for items in lists.values():
        for i in items:
            out[i] = out.get(i, 0) + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rrf(spark, seed):
    rng = random.Random(seed)
    a, b = random_lists(rng), random_lists(rng)
    found = lists_of(ranking.rrf(frame(spark, a), frame(spark, b), 0.25))
    assert found == {q: plain_rrf(a.get(q, []), b.get(q, []), 0.25, 60, 20) for q in {*a, *b}}


def test_rrf_by_hand(spark):
    assert lists_of(ranking.rrf(frame(spark, {1: ["A", "B", "C"]}), frame(spark, {1: ["B", "D"]}), 0.25)) == {1: ["B", "A", "C", "D"]}
    assert lists_of(ranking.rrf(frame(spark, {1: ["A"]}), frame(spark, {1: ["B"]}), 1.0)) == {1: ["A", "B"]}


def test_rrf_is_the_same_after_repartition(spark):
    rng = random.Random(9)
    a, b = frame(spark, random_lists(rng, 12)), frame(spark, random_lists(rng, 12))
    chained = lambda x, y: ranking.rrf(ranking.rrf(x, y, 0.25).drop("score"), ranking.rrf(y, x, 0.5).drop("score"), 0.5)
    assert lists_of(chained(a, b)) == lists_of(chained(a.repartition(7), b.repartition(3, "item_id")))


@pytest.mark.parametrize("seed", range(3))
def test_diversity(spark, seed):
    rng = random.Random(seed)
    lists = random_lists(rng, 8, 25)
    times, turns, p, w = counts(lists), len(lists), 5, 0.4
    base = frame(spark, lists)

    def plain(items):
        tail = items[p:]
        score = {i: round((len(tail) - n) / len(tail) + w * novelty(times[i], turns), 9) for n, i in enumerate(tail)}
        return items[:p] + sorted(tail, key=lambda i: (-score[i], tail.index(i)))

    assert lists_of(ranking.diversity_rerank(base, ranking.frequency(base), turns, p, w)) == {q: plain(x) for q, x in lists.items()}


@pytest.mark.parametrize("seed", range(3))
def test_expansion(spark, seed):
    rng = random.Random(seed)
    lists, pool = random_lists(rng, 6, 60, 20, 3), random_lists(rng, 6, 60, 50)
    times, turns, p, r, w, start, end = counts(lists), len(lists), 8, 5, 1.5, 11, 40

    def plain(items, reservoir):
        n = len(items)
        swapped = max(0, min(r, n - min(p, n)))
        new = [i for i in reservoir[start - 1 : end] if i not in items]
        score = {i: round(21 / max(reservoir.index(i) + 1, 21) + w * novelty(times.get(i, 0), turns), 9) for i in new}
        new.sort(key=lambda i: (-score[i], reservoir.index(i)))
        out = items[: n - swapped] + new[:swapped]
        return (out + [i for i in items if i not in out])[:n]

    base = frame(spark, lists)
    found = lists_of(ranking.candidate_expansion(base, frame(spark, pool), ranking.frequency(base), turns, p, r, w, start, end))
    assert found == {q: plain(x, pool.get(q, [])) for q, x in lists.items()}


@pytest.mark.parametrize("seed", range(3))
def test_selective(spark, seed):
    rng = random.Random(seed)
    lists, pool = random_lists(rng, 6, 70, 20, 3), random_lists(rng, 6, 70, 60)
    times, turns, p, w, bonus, start, end = counts(lists), len(lists), 6, 1.35, 0.14, 5, 50

    def plain(items, reservoir):
        pick = {}
        for i in [*items[p:], *reservoir[start - 1 : end]]:
            if i in items[:p]:
                continue
            own = i in items
            rank = reservoir.index(i) + 1 if i in reservoir else items.index(i) + 1
            was = items.index(i) + 1 if own else 10**9
            pick[i] = (-round(1 / math.log2(rank + 1) + w * novelty(times.get(i, 0), turns) + bonus * own, 9), -own, rank, was, i)
        best = sorted(pick, key=pick.get)[: max(0, len(items) - p)]
        return items[:p] + sorted(best, key=lambda i: pick[i][2:])

    base = frame(spark, lists)
    found = lists_of(ranking.selective_rerank(base, frame(spark, pool), ranking.frequency(base), turns, p, w, bonus, start, end))
    assert found == {q: plain(x, pool.get(q, [])) for q, x in lists.items()}


def test_selective_by_hand(spark):
    base, reservoir = [f"i{n:03d}" for n in range(1, 21)], [f"i{n:03d}" for n in range(1, 101)]
    times = spark.createDataFrame([(i, 100) for i in base], "item_id string, times long")
    found = lists_of(ranking.selective_rerank(frame(spark, {1: base}), frame(spark, {1: reservoir}), times, 100))
    assert found == {1: [f"i{n:03d}" for n in [*range(1, 13), *range(21, 29)]]}


def test_exact_weight_zero_changes_nothing(spark):
    base = {1: list("dcba"), 2: list("abc")}
    scores = spark.createDataFrame([(1, "a", 15.0), (2, "c", 6.0)], "query_id long, item_id string, exact double")
    assert lists_of(ranking.exact_rerank(frame(spark, base), scores, 0.0)) == base
    assert lists_of(ranking.exact_rerank(frame(spark, base), scores, 0.1)) == {1: list("adcb"), 2: list("acb") if 1 / 3 + 0.6 < 1.0 else list("cab")}


def test_metrics_by_hand(spark):
    lists = frame(spark, {1: ["x", "y", "g"], 2: [f"n{i}" for i in range(10)] + ["g"]})
    gold = spark.createDataFrame([(1, "g"), (2, "g"), (3, "g")], "query_id long, item_id string")
    found = {r["query_id"]: r["ndcg_10"] for r in evaluation.ndcg(lists, gold).collect()}
    assert found == {1: 0.5, 2: 0.0, 3: 0.0}
    assert [r["query_id"] for r in evaluation.missing(gold, lists).collect()] == [3]
    assert evaluation.diversity(lists, 0).first()["catalog_diversity"] == 0.0
    twice = frame(spark, {1: ["A", "A"]})
    assert evaluation.duplicates(twice).count() == 1


def test_best_config_takes_the_first_of_equals_and_the_first_at_the_target(spark):
    scores = spark.createDataFrame([(0, 0.1, 0.1, 0.1), (1, 0.3, 0.1, 0.26), (2, 0.4, 0.1, 0.3), (3, 0.4, 0.1, 0.3)], "config_id int, ndcg_20 double, catalog_diversity double, final_score double")
    assert evaluation.best_config(scores).first()["config_id"] == 2
    assert evaluation.best_config(scores, target=0.25).first()["config_id"] == 1
    assert evaluation.best_config(scores, target=0.9).first()["config_id"] == 2


def test_fusion_search_finds_the_best_weights(spark):
    """Gold items stand first in the second branch, and the first branch hides them: high weights must win."""
    a = frame(spark, {q: [f"n{q}{i}" for i in range(20)] for q in range(4)})
    b = frame(spark, {q: [f"g{q}"] + [f"m{q}{i}" for i in range(5)] for q in range(4)})
    kinds = spark.createDataFrame([(q, s) for q, s in enumerate(("HH", "HL", "LH", "LL"))], "query_id long, specificity string")
    gold = spark.createDataFrame([(q, f"g{q}") for q in range(4)], "query_id long, item_id string")
    weights, scores = tuning.fusion_by_kind(a, b, kinds, gold, (0.0, 0.5, 2.0), 100, 4, {"HH": 0.0, "HL": 0.0, "LH": 0.0, "LL": 0.0})
    assert set(weights.values()) == {2.0}
    assert scores.count() == 2**4


def test_requests_are_answered(spark):
    asked = spark.createDataFrame([(1, "a", 2), (2, " ", 5), (3, "b", 0), (4, None, 3), (5, "c", 99), (6, "d", None)], "query_id long, query string, k int")
    seen = []

    def retrieve(live, depth):
        seen.append((sorted(r["query_id"] for r in live.collect()), depth))
        return live.where("query_id <> 6").select("query_id", F.posexplode(F.array(*map(F.lit, "xyz"))).alias("rank", "item_id")).withColumn("rank", F.col("rank") + 1)

    out = {r["query_id"]: r["predicted_track_ids"] for r in requests.answered(asked, retrieve, 3).collect()}
    assert out == {1: ["x", "y"], 2: [], 3: [], 4: [], 5: ["x", "y", "z"], 6: []}
    assert seen == [([1, 5], 3)]
