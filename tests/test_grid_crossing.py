"""Lists that are dealt before they are crossed with configurations."""

from rankloom.operators import tuning


def test_configurations_are_crossed_after_the_exchange(spark):
    lists = spark.range(6).selectExpr("id as query_id", "explode(sequence(1, 20)) as rank").selectExpr("query_id", "rank", "rank * 3 + query_id as item_id")
    deep = spark.range(6).selectExpr("id as query_id", "explode(sequence(1, 100)) as rank").selectExpr("query_id", "rank", "rank + query_id as item_id")
    times = lists.groupBy("item_id").count().withColumnRenamed("count", "times")
    gold = spark.range(6).selectExpr("id as query_id", "id + 4 as item_id")
    found = [
        tuning.selective(lists, deep, times, gold, tuning.grid(spark, protect=(12, 11), start=(11, 9), weight=(1.5,), bonus=(0.1, 0.2)), 100, 6),
        tuning.expansion(lists, deep, times, gold, tuning.grid(spark, protect=(10, 12), replacements=(5, 8), weight=(1.5, 2.0)), 100, 6),
    ]
    for scores in found:
        plan = scores._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "config_id" in line and "query_id" in line.split("hashpartitioning")[1]]
        assert scores.count() in (8, 6, 4)
