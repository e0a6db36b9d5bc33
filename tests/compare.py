"""Runs a query and its SQL side by side and compares their rows."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).df()


def _cell(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA:
        return "null"
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_cell, x)) + "]"
    if isinstance(x, dict) or hasattr(x, "asDict"):
        return "{" + ",".join(f"{k}:{_cell(v)}" for k, v in (x if isinstance(x, dict) else x.asDict()).items()) + "}"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, pd.Timestamp):
        return x.isoformat()
    if isinstance(x, (int, float)):
        return "null" if isinstance(x, float) and math.isnan(x) else repr(round(float(x), 9) + 0.0)
    return str(x)


def canonical(df: pd.DataFrame) -> list[tuple[str, ...]]:
    cols = sorted(df.columns)
    return sorted(tuple(_cell(v) for v in row) for row in df[cols].itertuples(index=False))


def assert_same(spark_df, sql: str, sf_dir: str) -> int:
    """Compares columns, the number of rows and every value; returns the number of rows."""
    ours, theirs = spark_df.toPandas(), sql_rows(sql, sf_dir)
    assert sorted(ours.columns) == sorted(theirs.columns), (sorted(ours.columns), sorted(theirs.columns))
    a, b = canonical(ours), canonical(theirs)
    assert len(a) == len(b), (len(a), len(b), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, (len(wrong), wrong[:3])
    return len(a)


def most_rows(df) -> int:
    """Runs df and returns the most rows that a single operator of its plan has made."""
    run = df._jdf.queryExecution()
    run.toRdd().count()

    def of(plan) -> int:
        inner = [getattr(plan, step)() for kind, step in (("AdaptiveSparkPlanExec", "executedPlan"), ("QueryStageExec", "plan")) if plan.getClass().getSimpleName().endswith(kind)]
        children = plan.children()
        made = plan.metrics().get("numOutputRows")
        return max([made.get().value() if made.isDefined() else 0, *map(of, inner), *(of(children.apply(i)) for i in range(children.size()))])

    return of(run.executedPlan())


def tables_of(spark, folder, parts) -> str:
    """A folder with a part table of these (p_partkey, p_name, p_brand, p_type)."""
    rows = [(k, n, b, t, k % 50, 900.0 + k % 7) for k, n, b, t in parts]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    return str(folder)
