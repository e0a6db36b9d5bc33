"""Choices over very many lists: partitions grow in number, not in size, and no step makes a row for each pair."""

import random

import numpy as np
import pyarrow as pa
from compare import most_rows

from rankloom.functions import aliases
from rankloom.operators import groups, selection


def tracks(spark, rows):
    return spark.createDataFrame([(i, [a] if a else [], tags) for i, a, tags in rows], "track_id string, artist_name array<string>, tag_list array<string>")


def diverse(pool, limit, genres, moods):
    """The choice, one track after another, in plain Python."""
    covered, chosen, out, left, size = set(), set(), [], list(enumerate(pool)), len(pool)

    def worth(entry):
        i, (_, artist, own) = entry
        fits = 0.22 * len(genres & own) / max(1, len(genres)) + 0.12 * len(moods & own) / max(1, len(moods))
        return round(1.0 - i / size + fits + 0.05 * len((genres & own) - covered) + (0.0 if not artist else -0.14 if artist in chosen else 0.10), 9)

    while left and len(out) < limit:
        best = max(left, key=worth)
        left.remove(best)
        out.append(best[1][0])
        covered |= genres & best[1][2]
        chosen |= {best[1][1]} - {""}
    return out


def test_parts_grow_with_rows(spark):
    few, many = groups.parts(spark, 1), groups.parts(spark, 400 * groups.ROWS)
    assert few == spark.sparkContext.defaultParallelism and many == 400
    assert groups.dealt(spark.range(10), 7, "id").rdd.getNumPartitions() == 7


def test_blocks_hold_whole_groups(spark):
    rows = spark.range(30_000).selectExpr("if(id < 25000, 1, if(id % 7 = 0, null, id div 5)) as k", "id as v")
    wanted = sorted(r["n"] for r in rows.groupBy("k").count().withColumnRenamed("count", "n").collect())

    def sizes(t, starts):
        return pa.table({"n": pa.array(np.diff(np.append(starts, t.num_rows)))})

    assert sorted(r["n"] for r in groups.by_block(rows, ["k"], ["v"], sizes, "n long").collect()) == wanted


def test_blocks_of_placed_rows_are_neither_dealt_nor_sorted(spark):
    """Rows made from one row each stand together, however many of them a batch has."""
    rows = spark.range(4000).repartition(6, "id").selectExpr("if(id % 100 = 0, null, id) as k", "id as list", "sequence(1, cast(1 + id * 7 % 23 as int)) as ranks")
    rows = rows.where("k is not null or id = 500").selectExpr("k", "list", "explode(ranks) as rank")

    def groups_of(t, starts):
        at = np.append(starts, t.num_rows)
        assert all(t.column("rank").to_pylist()[a:b] == list(range(1, b - a + 1)) for a, b in zip(at[:-1], at[1:]))
        return pa.table({"list": t.column("list").take(pa.array(starts)), "n": pa.array(np.diff(at))})

    found = groups.by_block(rows, ["k"], ["rank"], groups_of, "list long, n long", placed=True)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.groupBy("list").count().collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and plan.count("Repartition") == 1


def test_diverse_choice_of_lists_of_all_sizes(spark):
    rng = random.Random(3)
    names = ["rock", "jazz", "pop", "calm", "dark"]
    catalog = [(str(i), rng.choice(["a", "b", "c", ""]), rng.sample(names, rng.randint(0, 4))) for i in range(60)]
    lists = {k: rng.sample(range(60), rng.choice([1, 2, 5, 20, 33])) for k in range(150)}
    pool = spark.createDataFrame([(k, n + 1, str(t)) for k, ts in lists.items() for n, t in enumerate(ts)], "id long, rank int, track_id string")
    asked = {k: rng.sample(names, rng.randint(0, 3)) for k in lists}
    wanted = spark.createDataFrame([(k, "mood" if f in ("calm", "dark") else "genre", f) for k, fs in asked.items() for f in fs], "id long, kind string, feature string")
    rows = tracks(spark, catalog)
    found = {}
    for parts in (None, 5):
        out = selection.select_diverse(pool, rows, selection.classify_tags(rows, aliases.table(spark)), 8, wanted, parts=parts)
        found[parts] = {}
        for r in out.orderBy("id", "place").collect():
            found[parts].setdefault(r["id"], []).append(r["track_id"])
    own = {i: (a, set(tags)) for i, a, tags in catalog}
    split = lambda fs, moods: {f for f in fs if (f in ("calm", "dark")) == moods}
    want = {k: diverse([(str(t), *own[str(t)]) for t in ts], 8, split(asked[k], False), split(asked[k], True)) for k, ts in lists.items()}
    assert found[None] == want and found[5] == want
