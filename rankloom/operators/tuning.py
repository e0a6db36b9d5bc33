"""Searching parameters of the ranking stages: configurations are rows, crossed with rankings and scored in one job.

A table of configurations is small and literal; what it is crossed with is one ranking a query. Large grids go through
in blocks of config ids, so that what is alive at once is a block times the rankings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.operators import evaluation, ranking
from rankloom.operators.groups import dealt, parts
from rankloom.sources.storage import staged

CONFIG_KEYS = ("config_id", "query_id")

#: Fixed grids of the searches.
DENSE_WEIGHTS = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)
EXACT_WEIGHTS = (0.0, 0.025, 0.05, 0.075, 0.1, 0.15, 0.2)
PROTECT, NOVELTY = (5, 8, 10, 12, 15), (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0)
FUSION_WEIGHTS, FUSION_STEPS = (0.0, 0.05, 0.10, 0.20, 0.30, 0.50, 0.75, 1.00), (-0.10, -0.05, 0.05, 0.10)
EXPANSION = {"protect": (10, 11, 12, 13, 14, 15), "replacements": (5, 6, 7, 8, 9, 10), "weight": (1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 7.5, 10.0)}
SELECTIVE = {
    "protect": (12, 11, 13), "start": (11, 10, 12, 9, 13), "weight": (1.50, 1.45, 1.55, 1.40, 1.60, 1.35, 1.65, 1.30, 1.70, 1.20, 1.80),
    "bonus": (0.150, 0.145, 0.155, 0.140, 0.160, 0.135, 0.165, 0.130, 0.170, 0.120, 0.180, 0.110, 0.190, 0.100, 0.200),
}


def grid(spark: SparkSession, **values: Iterable) -> DataFrame:
    """(config_id, one column a parameter) of the product, numbered in order with the last parameter fastest."""
    rows = [(i, *combo) for i, combo in enumerate(product(*values.values()))]
    return spark.createDataFrame(rows, ["config_id", *values]).withColumn("config_id", F.col("config_id").cast("int"))


def crossed(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """Every row with every configuration; configurations are some thousand literal rows at most."""
    return rows.crossJoin(F.broadcast(configs))


def search(configs: DataFrame, evaluate: Callable[[DataFrame], DataFrame], block: int = 500, target: float | None = None, by: str = "final_score") -> DataFrame:
    """Scores of all configurations, `block` of them a job; with a target, of those up to the first that reaches it.

    Blocks go in the order of the ids. Each block's scores are written, so a search that stops has not run what follows.
    """
    n = (configs.agg(F.max("config_id")).first()[0] or 0) + 1
    done: list[DataFrame] = []
    for at in range(0, n, block):
        done.append(staged(evaluate(configs.where(F.col("config_id").between(at, at + block - 1))), "scores"))
        if target is None:
            continue
        first = done[-1].where(F.col(by) >= target).agg(F.min("config_id")).first()[0]
        if first is not None:
            done[-1] = done[-1].where(F.col("config_id") <= first)
            break
    return reduce(DataFrame.union, done)


def dense_weight(first: DataFrame, second: DataFrame, gold: DataFrame, configs: DataFrame, catalog_size: int, turns: int, k: int = 60) -> DataFrame:
    """Scores of fusion weights (config_id, weight)."""
    weights = configs.select("config_id", "weight")
    a, b = crossed(first, weights.select("config_id")), crossed(second, weights.select("config_id"))
    by_list = crossed(first.select("query_id").union(second.select("query_id")).distinct(), weights)
    fused = ranking.rrf(a, b, by_list, k, keys=CONFIG_KEYS)
    return evaluation.score_configs(fused, gold, catalog_size, turns)


def diversity(base: DataFrame, times: DataFrame, gold: DataFrame, configs: DataFrame, catalog_size: int, turns: int) -> DataFrame:
    """Scores of (config_id, protect, weight) of the diversity stage."""
    rows = crossed(base.select("query_id", "rank", "item_id"), configs)
    out = ranking.diversity_rerank(rows, times, turns, F.col("protect"), F.col("weight"), keys=CONFIG_KEYS)
    return evaluation.score_configs(out, gold, catalog_size, turns)


def expansion(base: DataFrame, reservoir: DataFrame, times: DataFrame, gold: DataFrame, configs: DataFrame, catalog_size: int, turns: int) -> DataFrame:
    """Scores of (config_id, protect, replacements, weight) of candidate expansion, those that fit a list of 20."""
    fits = configs.where("protect + replacements <= 20")
    rows = _tried(base, reservoir, times, turns, fits)
    out = ranking.expanded(rows, F.col("protect"), F.col("replacements"), F.col("weight"), keys=CONFIG_KEYS)
    return evaluation.score_configs(out, gold, catalog_size, turns)


def _tried(base: DataFrame, reservoir: DataFrame, times: DataFrame, turns: int, configs: DataFrame) -> DataFrame:
    """What lists and reservoirs hold, with every configuration: lists meet their reservoirs once and are dealt by query,
    to as many partitions as their rows need, before they are crossed, so that no crossed row is shuffled."""
    rows = staged(ranking.met(base, reservoir, times, turns), "met")
    n = parts(rows.sparkSession, rows.count() * configs.count())
    return crossed(dealt(rows, n, "query_id"), configs)


def selective(base: DataFrame, reservoir: DataFrame, times: DataFrame, gold: DataFrame, configs: DataFrame, catalog_size: int, turns: int) -> DataFrame:
    """Scores of (config_id, protect, start, weight, bonus) of selective expansion."""
    rows = _tried(base, reservoir, times, turns, configs)
    out = ranking.selected(rows, F.col("protect"), F.col("weight"), F.col("bonus"), F.col("start"), keys=CONFIG_KEYS)
    return evaluation.score_configs(out, gold, catalog_size, turns)


def exact(base: DataFrame, scores: DataFrame, kinds: DataFrame, gold: DataFrame, configs: DataFrame, catalog_size: int, turns: int) -> DataFrame:
    """Scores of (config_id, HH, HL, LH, LL): a weight of exact matches for each kind of query.

    A list depends on the weight of its own kind alone, so each (query, weight) is ranked once; configurations then
    pick a ranking of every query by a join.
    """
    long = configs.select("config_id", F.explode(F.create_map(*(x for s in ("HH", "HL", "LH", "LL") for x in (F.lit(s), F.col(s))))).alias("specificity", "weight"))
    tried = long.select("specificity", "weight").distinct()
    lists = base.select("query_id", "rank", "item_id").join(kinds, "query_id").join(F.broadcast(tried), "specificity")
    ranked = ranking.exact_rerank(lists, scores, F.col("weight"), keys=("query_id", "specificity", "weight"))
    rows = ranked.join(F.broadcast(long), ["specificity", "weight"])
    return evaluation.score_configs(rows.select("config_id", "query_id", "rank", "item_id"), gold, catalog_size, turns)


def fusion_by_kind(first: DataFrame, second: DataFrame, kinds: DataFrame, gold: DataFrame, weights: Iterable[float], catalog_size: int, turns: int, start: dict[str, float], k: int = 60, steps: Iterable[float] = FUSION_STEPS) -> tuple[dict[str, float], DataFrame]:
    """(weights by kind, scores of the last grid): one pass over the kinds, then the neighbourhood of what it found.

    The pass must look at its scores before it goes on: a job of len(weights) configurations for each kind. Its
    neighbourhood has 0, the weight found and those a step away, of every kind. Each (query, weight) is ranked once.
    """
    spark, weights = first.sparkSession, list(weights)

    def ranked(some: set[float]) -> DataFrame:
        tried = spark.createDataFrame([(w,) for w in sorted(some)], "tried double")
        slim = lambda df: crossed(df.select("query_id", "rank", "item_id"), tried)
        by_list = crossed(kinds.select("query_id"), tried).withColumn("weight", F.col("tried"))
        return staged(ranking.rrf(slim(first), slim(second), by_list, k, keys=("query_id", "tried")).join(kinds, "query_id"), "fused-by-weight")

    def scored(fused: DataFrame, configs: list[dict[str, float]]) -> DataFrame:
        long = spark.createDataFrame([(i, s, w) for i, c in enumerate(configs) for s, w in c.items()], "config_id int, specificity string, tried double")
        rows = fused.join(F.broadcast(long), ["specificity", "tried"])
        return evaluation.score_configs(rows.select("config_id", "query_id", "rank", "item_id"), gold, catalog_size, turns)

    best = dict(start)
    fused = ranked(set(weights) | set(best.values()))
    for kind in sorted(best):
        configs = [best | {kind: w} for w in weights]
        found = evaluation.best_config(scored(fused, configs)).first()
        best = configs[found["config_id"]] if found else best
    near = {s: sorted({0.0, w, *(x for d in steps if 0 <= (x := round(w + d, 2)) <= 1)}) for s, w in best.items()}
    configs = [dict(zip(near, combo)) for combo in product(*near.values())]
    scores = staged(scored(ranked({w for values in near.values() for w in values}), configs), "scores")
    found = evaluation.best_config(scores).first()
    return (configs[found["config_id"]] if found else best), scores
