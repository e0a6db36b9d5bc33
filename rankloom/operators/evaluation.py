"""Ranking quality: nDCG at a depth, catalog diversity, and their combination; also for many configurations at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

DEPTHS = (1, 10, 20)


def gain(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1.0)


def best_gain(golds: Column, k: int) -> Column:
    """The sum of gains of min(golds, k) items at the first ranks."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(golds.cast("int"), F.lit(k)))), F.lit(0.0), lambda acc, i: acc + gain(i))


def ndcg(ranking: DataFrame, gold: DataFrame, depths: Sequence[int] = DEPTHS, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """(query_id, ndcg_k ...) of every query that has gold items (query_id, item_id); 0 without a hit.

    A ranking that holds an item twice counts its first rank alone; `duplicates` finds such lists.
    """
    wanted = gold.distinct().groupBy(*keys).agg(F.count("*").alias("golds"))
    hits = ranking.groupBy(*keys, "item_id").agg(F.min("rank").alias("rank")).join(gold.distinct(), [*keys, "item_id"])
    return _gains(hits, wanted, depths, keys)


def ndcg_by_label(ranking: DataFrame, queries: DataFrame, items: DataFrame, depths: Sequence[int] = DEPTHS) -> DataFrame:
    """(query_id, ndcg_k ...) of ndcg where the gold items of a query (query_id, label) are all items (item_id, label) of
    its label: these are counted by label and met by what was found, never paired."""
    sizes = items.select("item_id", "label").distinct().groupBy("label").agg(F.count("*").alias("golds"))
    asked = queries.select("query_id", "label").distinct()
    wanted = asked.join(sizes, "label").groupBy("query_id").agg(F.sum("golds").alias("golds"))
    found = ranking.groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    hits = found.join(items.select("item_id", "label").distinct(), "item_id").join(asked, ["query_id", "label"])
    return _gains(hits, wanted, depths, ["query_id"])


def _gains(hits: DataFrame, wanted: DataFrame, depths: Sequence[int], keys: Sequence[str]) -> DataFrame:
    sums = hits.groupBy(*keys).agg(*(F.sum(F.when(F.col("rank") <= k, gain(F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}") for k in depths))
    rows = wanted.join(sums, list(keys), "left")
    return rows.select(*keys, *((F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / best_gain(F.col("golds"), k)).alias(f"ndcg_{k}") for k in depths))


def duplicates(ranking: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """(keys, item_id, times) of items that stand in a list more than once."""
    return ranking.groupBy(*keys, "item_id").agg(F.count("*").alias("times")).where("times > 1")


def missing(gold: DataFrame, ranking: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Keys of gold that have no ranking."""
    return gold.select(*keys).distinct().join(ranking.select(*keys).distinct(), list(keys), "left_anti")


def diversity(ranking: DataFrame, catalog_size: int, top: int = 20) -> DataFrame:
    """One row (catalog_diversity): distinct items in the first places over the size of the catalog; 0 for an empty one."""
    share = F.count_distinct(F.when(F.col("rank") <= top, F.col("item_id"))) / F.lit(float(max(catalog_size, 1)))
    return ranking.agg((share if catalog_size > 0 else F.lit(0.0)).alias("catalog_diversity"))


def metrics(ranking: DataFrame, gold: DataFrame, catalog_size: int, digits: int = 6) -> DataFrame:
    """One row (ndcg_1, ndcg_10, ndcg_20, catalog_diversity, final_score), rounded."""
    means = ndcg(ranking, gold).agg(*(F.coalesce(F.avg(f"ndcg_{k}"), F.lit(0.0)).alias(f"ndcg_{k}") for k in DEPTHS))
    both = means.crossJoin(diversity(ranking, catalog_size))  # one row each
    both = both.withColumn("final_score", 0.8 * F.col("ndcg_20") + 0.2 * F.col("catalog_diversity"))
    return both.select(*(F.round(c, digits).alias(c) for c in both.columns))


def score_configs(ranking: DataFrame, gold: DataFrame, catalog_size: int, turns: int, top: int = 20, digits: int = 6) -> DataFrame:
    """(config_id, ndcg_20, catalog_diversity, final_score) for rankings (config_id, query_id, rank, item_id).

    Needs one gold item a query: its rank is all that nDCG needs, so each configuration is an aggregate of rows and the
    rankings themselves are never gathered.
    """
    rows = ranking.where(F.col("rank") <= top).join(gold.select("query_id", F.col("item_id").alias("gold")), "query_id")
    hit = F.when(F.col("item_id") == F.col("gold"), gain(F.col("rank"))).otherwise(0.0)
    found = rows.groupBy("config_id").agg((F.sum(hit) / turns).alias("ndcg_20"), (F.count_distinct("item_id") / F.lit(float(catalog_size))).alias("catalog_diversity"))
    found = found.withColumn("final_score", 0.8 * F.col("ndcg_20") + 0.2 * F.col("catalog_diversity"))
    return found.select("config_id", *(F.round(c, digits).alias(c) for c in ("ndcg_20", "catalog_diversity", "final_score")))


def best_config(scores: DataFrame, by: str = "final_score", target: float | None = None) -> DataFrame:
    """The configuration with the best score, the smallest id among equals; with a target, the first that reaches it.

    A configuration search that stops at the target takes the first improvement in order, so ids are the order.
    """
    best = scores.agg(F.max_by(F.struct(*scores.columns), F.struct(F.col(by), -F.col("config_id"))).alias("b")).select("b.*")
    if target is None:
        return best
    reached = scores.where(F.col(by) >= target).agg(F.min_by(F.struct(*scores.columns), "config_id").alias("r"))
    return best.crossJoin(reached).select(F.coalesce("r", F.struct(*(best[c] for c in scores.columns))).alias("x")).select("x.*")


def latencies(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, turns, median, p95, most) of measured times: of n in order those at n // 2 and ceil(0.95 n) - 1, from 0."""
    at = lambda p, order: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value} {order})")
    return rows.groupBy(by).agg(F.count(value).alias("turns"), at(0.5, "DESC").alias("median"), at(0.95, "ASC").alias("p95"), F.max(value).alias("most"))


def feedback(votes: DataFrame, key: str = "device_id") -> DataFrame:
    """(item_id, up, down) from thumbs (key, seq, item_id, up): the last vote of each device on an item counts."""
    last = votes.groupBy(key, "item_id").agg(F.max_by("up", "seq").alias("up"))
    return last.groupBy("item_id").agg(F.count_if("up").alias("up"), F.count_if(~F.col("up")).alias("down"))
