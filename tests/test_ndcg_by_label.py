"""Gold items that are counted by label, not paired with queries."""

from compare import most_rows

from rankloom.operators import evaluation


def test_ndcg_by_label_makes_no_pairs(spark):
    n = 1000
    queries = spark.range(n).selectExpr("id as query_id", "cast(id % 2 as int) as label")
    items = spark.range(n).selectExpr("id + 5000 as item_id", "cast(id % 2 as int) as label")
    found = queries.selectExpr("query_id", "inline(array(struct(1 as rank, query_id + 5000 as item_id), struct(2 as rank, pmod(query_id + 1, 1000) + 5000 as item_id)))")
    pairs = evaluation.ndcg(found, queries.join(items, "label").select("query_id", "item_id"))
    once = evaluation.ndcg_by_label(found, queries, items)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, pairs.collect()))
    assert most_rows(evaluation.ndcg_by_label(found, queries, items)) <= 4 * n
