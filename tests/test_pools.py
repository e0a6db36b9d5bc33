"""Lists that share a pool of candidates: the pool meets its tracks once, and lists with odd ids keep their rows."""

import random

import pytest
from compare import canonical, sql_rows, tables_of
from pyspark.sql import functions as F

from rankloom.operators import selection
from rankloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
LISTS = 600


def shuffled_rows(df) -> int:
    """Runs df and returns how many rows all its exchanges have written."""
    run = df._jdf.queryExecution()
    run.toRdd().count()

    def of(plan) -> int:
        name = plan.getClass().getSimpleName()
        inner = [getattr(plan, step)() for kind, step in (("AdaptiveSparkPlanExec", "executedPlan"), ("QueryStageExec", "plan")) if name.endswith(kind)]
        children = plan.children()
        made = plan.metrics().get("shuffleRecordsWritten").get().value() if name == "ShuffleExchangeExec" else 0
        return made + sum(of(p) for p in inner) + sum(of(children.apply(i)) for i in range(children.size()))

    return of(run.executedPlan())


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Thirty tracks and many lists, some with a negative id and one without any."""
    rng, words = random.Random(5), ["steel", "red", "stone", "blue", "brass", "ring", "gold"]
    folder = tables_of(spark, tmp_path_factory.mktemp("pools"), [(i, " ".join(rng.sample(words, 2)), f"b{i % 7}", rng.choice(["PROMO TIN", "LARGE"])) for i in range(30)])
    ids = [*range(LISTS), *range(-70, 0), None]
    rows = [(i, rng.randrange(33), 1, line, 9.5) for i in ids for line in range(rng.randint(1, 4))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["explain_recs", "build_playlist"])
def test_as_sql_says(spark, sf_dir, name):
    sql = SQL[name]
    for t in ("part", "lineitem"):
        sql = sql.replace(f"FROM {t}", f"FROM read_parquet('{sf_dir}/{t}.parquet/*.parquet')")
    assert canonical(QUERIES[name](spark, sf_dir).toPandas()) == canonical(sql_rows(sql, ""))


@pytest.mark.parametrize("name", ["explain_recs", "build_playlist"])
def test_candidates_of_a_pool_are_shuffled_once_for_all_lists(spark, sf_dir, name):
    assert shuffled_rows(QUERIES[name](spark, sf_dir)) < 20 * LISTS


def test_reasons_by_pool_and_by_list(spark):
    rng = random.Random(7)
    tracks = [str(i) for i in range(40)]
    kinds = {kind: spark.createDataFrame([(t, f) for t in tracks for f in rng.sample("abcdefgh", rng.randint(0, 5))], "track_id string, feature string") for kind in ("one", "two")}
    seeds = spark.createDataFrame([(k, rng.choice(tracks)) for k in range(60) for _ in range(rng.randint(0, 4))], "id long, track_id string")
    lists = spark.createDataFrame([(k, k % 9) for k in range(60)], "id long, pool long")
    pools = spark.createDataFrame([(p, n, rng.choice([*tracks, "unknown", None])) for p in range(9) for n in range(12)], "pool long, rank int, track_id string")
    whole = selection.reasons(pools.join(lists, "pool").drop("pool"), seeds, kinds).select("id", "rank", "track_id", "one", "two")
    for parts in (None, 5):
        assert canonical(selection.reasons(pools, seeds, kinds, parts=parts, lists=lists).toPandas()) == canonical(whole.toPandas())
    own, at = {}, {k: {} for k in kinds}
    for kind, rows in kinds.items():
        for r in rows.collect():
            at[kind].setdefault(r["track_id"], set()).add(r["feature"])
    for r in seeds.collect():
        for kind in kinds:
            own.setdefault((r["id"], kind), set()).update(at[kind].get(r["track_id"], set()))
    for r in whole.collect():
        for kind in kinds:
            assert (r[kind] or "") == ", ".join(sorted(at[kind].get(r["track_id"], set()) & own.get((r["id"], kind), set()))[:3])


@pytest.mark.parametrize("name", ["playlist_scores", "playlist_select"])
def test_scores_are_as_sql_says(spark, sf_dir, name):
    sql = SQL[name]
    for t in ("part", "lineitem"):
        sql = sql.replace(f"FROM {t}", f"FROM read_parquet('{sf_dir}/{t}.parquet/*.parquet')")
    assert canonical(QUERIES[name](spark, sf_dir).toPandas()) == canonical(sql_rows(sql, ""))


@pytest.mark.parametrize("name", ["playlist_scores", "playlist_select"])
def test_candidates_are_scored_where_their_list_is(spark, sf_dir, name):
    assert shuffled_rows(QUERIES[name](spark, sf_dir)) < 20 * LISTS


def test_scores_by_pool_and_by_list(spark):
    rng = random.Random(11)
    ids = [str(i) for i in range(40)]
    tracks = spark.createDataFrame([(t, [f"b{int(t) % 6}"]) for t in ids], "track_id string, artist_name array<string>")
    styles = spark.createDataFrame([(t, f, float(rng.randint(1, 2))) for t in ids for f in rng.sample("abcdef", rng.randint(0, 3))], "track_id string, feature string, weight double")
    tags = spark.createDataFrame([(t, "mood", rng.choice("xyz")) for t in ids], "track_id string, kind string, feature string")
    wanted = spark.createDataFrame([(k, "mood", rng.choice("xyz")) for k in range(60)], "id long, kind string, feature string")
    seeds = spark.createDataFrame([(k, rng.choice([*ids, "unknown"])) for k in range(60) for _ in range(rng.randint(1, 4))], "id long, track_id string")
    pools = spark.createDataFrame([(p, n, t) for p in range(9) for n, t in enumerate(rng.sample(ids, 12), 1)], "pool long, rank int, track_id string")
    each = pools.join(spark.createDataFrame([(k, k % 9) for k in range(60)], "id long, pool long"), "pool").drop("pool")
    for asked in (None, wanted):
        for parts in (None, 5):
            whole = selection.playlist_scores(each, seeds, tracks, styles, tags, asked, parts=parts)
            by_pool = selection.playlist_scores(pools, seeds, tracks, styles, tags, asked, parts=parts, pool=F.col("id") % 9)
            assert canonical(by_pool.toPandas()) == canonical(whole.toPandas())
            chosen = selection.select_matches(by_pool, tracks, 5, parts=parts, placed=asked is None)
            assert canonical(chosen.toPandas()) == canonical(selection.select_matches(whole, tracks, 5, parts=parts).toPandas())
