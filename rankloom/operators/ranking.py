"""Fusion and re-ranking of rankings.

A ranking is (keys, rank, item_id): keys name a list, by default query_id, and ranks run from 1 without gaps. Every
operator takes and returns rankings. Parameters are numbers or columns, so that a table of configurations can be
crossed with a ranking and all of them are computed in one job with keys (config_id, query_id).

All work on one list happens after one exchange by its keys: lists are short (a hundred items), keys are many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.functions.scalars import novelty, relevance

KEYS = ("query_id",)
#: Digits to which scores are rounded before they are compared, so that the last bit of a logarithm decides nothing.
DIGITS = 9


def _param(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _ranked(df: DataFrame, keys: Sequence[str], *order: Column | str, top: Column | int | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Ranks from 1 by `order` within each list, the first `top` only."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return (out if top is None else out.where(F.col("rank") <= top)).select(*keys, "rank", "item_id", *extra)


def _merged(first: DataFrame, second: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keys, item_id, r1, r2, keep): the rank of each item in either ranking. Two rankings partitioned by their keys
    meet without a further exchange; a union would not keep its partitions apart once they are coalesced."""
    a = first.select(*keys, "item_id", F.col("rank").alias("r1"), *(F.col(c).alias(f"{c}_1") for c in keep))
    b = second.select(*keys, "item_id", F.col("rank").alias("r2"), *(F.col(c).alias(f"{c}_2") for c in keep))
    both = a.join(b, [*keys, "item_id"], "full_outer")
    return both.select(*keys, "item_id", "r1", "r2", *(F.coalesce(f"{c}_1", f"{c}_2").alias(c) for c in keep))


def rrf(first: DataFrame, second: DataFrame, weight: Column | float | DataFrame, k: int = 60, top: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weighted reciprocal-rank fusion, 1 / (k + r1) + weight / (k + r2), with the score.

    weight is a number or a table (query_id, weight). Ties go to the better first rank, then the better second, then
    the smaller id.
    """
    both = _merged(first, second, keys)
    if isinstance(weight, DataFrame):
        both, weight = both.join(weight, list(keys)), F.col("weight")
    score = F.coalesce(1.0 / (F.col("r1") + k), F.lit(0.0)) + F.coalesce(_param(weight) / (F.col("r2") + k), F.lit(0.0))
    both = both.withColumn("score", F.round(score, DIGITS))
    return _ranked(both, keys, F.desc("score"), F.col("r1").asc_nulls_last(), F.col("r2").asc_nulls_last(), "item_id", top=top, extra=("score",))


def exact_rerank(ranking: DataFrame, scores: DataFrame, weight: Column | float | DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Orders a list by (n - rank + 1) / n + weight * exact, ties by rank. scores: (query_id, item_id, exact)."""
    rows = ranking.join(scores, ["query_id", "item_id"], "left")
    if isinstance(weight, DataFrame):
        rows, weight = rows.join(weight, "query_id"), F.col("weight")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    rows = rows.withColumn("score", F.round((F.col("n") - F.col("rank") + 1) / F.col("n") + _param(weight) * F.coalesce("exact", F.lit(0.0)), DIGITS)).withColumnRenamed("rank", "before")
    return _ranked(rows, keys, F.desc("score"), "before", extra=("score",))


def frequency(ranking: DataFrame) -> DataFrame:
    """(item_id, times) over all lists."""
    return ranking.groupBy("item_id").agg(F.count("*").alias("times"))


def _novel(rows: DataFrame, times: DataFrame, turns: Column | float) -> DataFrame:
    return rows.join(times, "item_id", "left").withColumn("novelty", novelty(F.coalesce("times", F.lit(0)), _param(turns)))


def diversity_rerank(ranking: DataFrame, times: DataFrame, turns: Column | float, protect: Column | int, weight: Column | float, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first `protect` stay; the m others go by (m - i + 1) / m + weight * novelty, ties by rank."""
    p, w = _param(protect), _param(weight)
    rows = _novel(ranking.withColumn("tail", F.col("rank") - p), times, turns).withColumn("m", F.count("*").over(Window.partitionBy(*keys)) - p)
    score = F.when(F.col("tail") > 0, F.round((F.col("m") - F.col("tail") + 1) / F.col("m") + w * F.col("novelty"), DIGITS))
    rows = rows.withColumn("score", score).withColumnRenamed("rank", "before")
    kept = F.when(F.col("tail") > 0, p + 1).otherwise(F.col("before"))
    return _ranked(rows, keys, kept, F.desc("score"), "before")


def met(ranking: DataFrame, reservoir: DataFrame, times: DataFrame, turns: Column | float) -> DataFrame:
    """(query_id, item_id, r1, r2, novelty): what a list and its reservoir hold, which no parameter of the stages changes."""
    slim = lambda df: df.select(*KEYS, "rank", "item_id")
    return _novel(_merged(slim(ranking), slim(reservoir), KEYS), times, turns).select(*KEYS, "item_id", "r1", "r2", "novelty")


def candidate_expansion(
    ranking: DataFrame, reservoir: DataFrame, times: DataFrame, turns: Column | float, protect: Column | int, replacements: Column | int, weight: Column | float, start: Column | int = 21, end: Column | int = 100, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Replaces the end of a list by reservoir items that it lacks, best by 21 / max(rank, 21) + weight * novelty.

    Of a list of n the first n - replacements stay, `protect` at least; what the reservoir can't fill is filled by the
    list's own end again.
    """
    cfg = [c for c in ranking.columns if c not in (*keys, "rank", "item_id", "score")]
    return expanded(_novel(_merged(ranking, reservoir, keys, cfg), times, turns), protect, replacements, weight, start, end, keys)


def expanded(rows: DataFrame, protect: Column | int, replacements: Column | int, weight: Column | float, start: Column | int = 21, end: Column | int = 100, keys: Sequence[str] = KEYS) -> DataFrame:
    """candidate_expansion of rows as `met` gives them, or of these crossed with configurations."""
    rows = rows.withColumn("n", F.count("r1").over(Window.partitionBy(*keys)))
    swapped = F.greatest(F.lit(0), F.least(_param(replacements), F.col("n") - F.least(_param(protect), F.col("n"))))
    rows = rows.withColumn("swapped", swapped)
    new = F.col("r1").isNull() & F.col("r2").between(_param(start), _param(end))
    rows = rows.where(F.col("r1").isNotNull() | new)
    score = F.when(F.col("r1").isNull(), F.round(21.0 / F.greatest(F.col("r2"), F.lit(21)) + _param(weight) * F.col("novelty"), DIGITS))
    rows = rows.withColumn("score", score)
    place = F.row_number().over(Window.partitionBy(*keys, F.col("r1").isNull()).orderBy(F.desc("score"), "r2", "item_id"))
    rows = rows.withColumn("place", place)
    kept = F.col("r1") <= F.col("n") - F.col("swapped")
    class_ = F.when(kept, 0).when(F.col("r1").isNull(), 1).otherwise(2)
    rows = rows.where((F.col("r1").isNotNull()) | (F.col("place") <= F.col("swapped")))
    return _ranked(rows, keys, class_, F.coalesce("r1", "place"), top=F.col("n"))


def selective_rerank(
    ranking: DataFrame, reservoir: DataFrame, times: DataFrame, turns: Column | float, protect: Column | int = 12, weight: Column | float = 1.35, bonus: Column | float = 0.14, start: Column | int = 11, end: Column | int = 100, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The first `protect` stay; the list's own end and the reservoir's ranks start..end compete for the other places.

    A candidate scores 1 / log2(rank + 1) + weight * novelty, and `bonus` if the list had it, with its reservoir rank
    where it has one. Winners stand in the order of their ranks, not of their scores.
    """
    cfg = [c for c in ranking.columns if c not in (*keys, "rank", "item_id", "score")]
    return selected(_novel(_merged(ranking, reservoir, keys, cfg), times, turns), protect, weight, bonus, start, end, keys)


def selected(rows: DataFrame, protect: Column | int, weight: Column | float, bonus: Column | float, start: Column | int, end: Column | int = 100, keys: Sequence[str] = KEYS) -> DataFrame:
    """selective_rerank of rows as `met` gives them, or of these crossed with configurations."""
    p = _param(protect)
    rows = rows.withColumn("n", F.count("r1").over(Window.partitionBy(*keys)))
    fixed = F.coalesce(F.col("r1") <= p, F.lit(False))
    own = F.col("r1").isNotNull()
    rows = rows.where(own | F.col("r2").between(_param(start), _param(end)))
    found = F.when(own, F.coalesce("r2", "r1")).otherwise(F.col("r2"))
    score = F.round(relevance(found) + _param(weight) * F.col("novelty") + F.when(own, _param(bonus)).otherwise(0.0), DIGITS)
    rows = rows.withColumns({"fixed": fixed, "own": own.cast("int"), "found": found, "was": F.coalesce("r1", F.lit(10**9)), "score": score})
    order = Window.partitionBy(*keys, "fixed").orderBy(F.desc("score"), F.desc("own"), "found", "was", "item_id")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("fixed") | (F.col("place") <= F.col("n") - F.least(p, F.col("n"))))
    return _ranked(rows, keys, F.when(F.col("fixed"), F.col("r1")).otherwise(10**9), "found", "was", "item_id")


def final_ranking(adaptive: DataFrame, goal: DataFrame, reservoir: DataFrame, catalog: DataFrame, exact: DataFrame, settings: dict, top: int = 20) -> DataFrame:
    """The whole chain: branch fusion, exact matches, diversity, selective expansion, items of the catalog only.

    settings: fusion_weights and exact_weights are tables (query_id, weight); diversity and selective are parameters of
    the stages above; diversity_statistics and selective_statistics are (times, turns).
    """
    fused = rrf(adaptive, goal, settings["fusion_weights"], settings["fusion_rrf_k"], 20)
    matched = exact_rerank(fused.drop("score"), exact, settings["exact_weights"])
    diverse = diversity_rerank(matched.drop("score"), *settings["diversity_statistics"], **settings["diversity"])
    chosen = selective_rerank(diverse, reservoir, *settings["selective_statistics"], **settings["selective"])
    valid = chosen.join(catalog.select("item_id").distinct(), "item_id", "left_semi").withColumnRenamed("rank", "before")
    return _ranked(valid, KEYS, "before", top=top)
