"""Queries over tables in which very many tracks share a name: no step makes many more rows than the table and the result."""

import pytest
from compare import canonical, most_rows, sql_rows, tables_of
from pyspark.sql import functions as F

from rankloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
N = 1200


def held(spark, folder, name, most, parts):
    sf_dir = tables_of(spark, folder, parts)
    assert most_rows(QUERIES[name](spark, sf_dir)) <= most
    wanted = sql_rows(SQL[name].replace("FROM part", f"FROM read_parquet('{sf_dir}/part.parquet/*.parquet')"), "")
    assert canonical(QUERIES[name](spark, sf_dir).toPandas()) == canonical(wanted)


def test_disambiguate_of_one_title(spark, tmp_path):
    held(spark, tmp_path, "disambiguate", 6 * N, [(i, "one title", f"b{i % 5}", "t") for i in range(N)])


def test_entity_intersect_of_one_artist(spark, tmp_path):
    held(spark, tmp_path, "entity_intersect", 20 * N, [(i, f"title {i}", "b", f"t{i // 2}") for i in range(N)])


def test_entity_union_of_one_artist(spark, tmp_path):
    held(spark, tmp_path, "entity_union", 10 * N, [(i, f"title {i}", "b", f"t{i // 2}") for i in range(N)])


def test_exact_or_all_of_one_word(spark, tmp_path):
    held(spark, tmp_path, "exact_or_all", N * N // 3 + 10 * N, [(i, f"title {i}", "b", "t") for i in range(N)])


def test_remove_by_text_of_one_artist(spark, tmp_path, monkeypatch):
    """Requests for tracks of one artist share its list."""
    from rankloom.operators import search

    given, plain = [], search.remove_by_text
    monkeypatch.setattr(search, "remove_by_text", lambda requests, tracks, entries, *a, **b: given.append(entries.count()) or plain(requests, tracks, entries, *a, **b))
    sf_dir = tables_of(spark, tmp_path, [(i, ("red ring", "old bolt")[i % 2], "b", "t") for i in range(N)])
    found = QUERIES["remove_by_text"](spark, sf_dir).collect()
    assert given[0] <= N and len(found) == N
    # of the twenty most popular tracks of the title the first, if the artist is named, else five
    best = lambda i: [str(k) for k in sorted(range(i % 2, N, 2), key=lambda k: (-(k % 7), k))]
    assert all((r["outcome"], list(r["track_ids"])) == (("removed", best(r["query_id"])[:1]) if r["query_id"] % 2 == 0 else ("choose", best(r["query_id"])[:5])) for r in found)


def test_entity_mentions_never_carry_the_ids_of_a_name(spark, tmp_path, monkeypatch):
    from rankloom.operators import search

    given, plain = [], search.mentions
    monkeypatch.setattr(search, "mentions", lambda messages, index: given.extend(index.columns) or plain(messages, index))
    sf_dir = tables_of(spark, tmp_path, [(i, f"ring {i % 3}", "b", "t") for i in range(60)])
    found = QUERIES["entity_mentions"](spark, sf_dir).collect()
    assert "track_ids" not in given and {(r["kind"], r["tracks"]) for r in found} == {("title", 20), ("artist", 60), ("album", 60)}


def shares(found, folder) -> list[int]:
    """How many rows the tasks that write found make, checked to be few bytes a row."""
    found.write.parquet(f"{folder}/out")
    assert sum(f.stat().st_size for f in folder.glob("out/*.parquet")) < 0.25 * (n := found.count())
    counts = sorted(r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert sum(counts) == n
    return counts


def test_exact_or_all_makes_the_pairs_of_one_word_in_many_tasks(spark, tmp_path):
    sf_dir = tables_of(spark, tmp_path, [(i, f"title {i}", "b", "t") for i in range(4 * N)])
    counts = shares(QUERIES["exact_or_all"](spark, sf_dir), tmp_path)
    assert sum(counts) == (4 * N) ** 2 // 3 + 4 * N * 2 // 3 and counts[-1] <= sum(counts) * 0.75


def test_entity_intersect_makes_the_pairs_of_two_names_in_many_tasks(spark, tmp_path):
    sf_dir = tables_of(spark, tmp_path, [(i, f"title {i}", "b", f"t{i % 2}") for i in range(4 * N)])
    counts = shares(QUERIES["entity_intersect"](spark, sf_dir), tmp_path)
    assert sum(counts) == 8 * N * N and counts[-1] <= sum(counts) * 0.75


def test_pairs_of_blocks_keep_nulls_and_repeats(spark, monkeypatch):
    from rankloom.operators import search

    for name, size in (("PART", 7), ("HELD", 3), ("ASKED", 2), ("PAIRS", 50)):
        monkeypatch.setattr(search, name, size)
    ids = lambda n: [None if i % 11 == 0 else i % 25 for i in range(n)]
    asked, held = [(k, q) for k in ("a", "b", None) for q in ids(40)], [(k, None if t is None else f"t{t}") for k in ("a", "c", None) for t in ids(30)]
    found = search.spread_join(spark.createDataFrame(asked, "word string, query_id long"), spark.createDataFrame(held, "word string, track_id string"), ["word"], "query_id").collect()
    wanted = [(q, t) for k, q in asked for w, t in held if k == w == "a"]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))
