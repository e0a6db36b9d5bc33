"""Two relations in two dimensions: every block of the one with every block of the other, each pair of blocks a group."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows of a block below which more blocks only cost time.
LEAST = 256


def tiled(left: DataFrame, right: DataFrame, per_left: int, per_right: int, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn(rows of left, rows of right) for each tile: a block of about per_left rows and one of about per_right rows.

    Rows are dealt to blocks by the hash of all their columns and go to each block of the other side once. A tile is one
    group: nothing is collected or broadcast, and a task holds one tile at a time. Both sides are read twice, so written
    tables are best. With few blocks the right side is cut further, so that all cores have a tile.
    """
    spark = left.sparkSession
    n, m = left.count(), right.count()
    rows = max(1, math.ceil(n / per_left))
    wanted = math.ceil(spark.sparkContext.defaultParallelism / rows)
    columns = max(1, math.ceil(m / per_right), min(wanted, m // LEAST))
    block = lambda df, parts: F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    a = left.select("*", block(left, rows).alias("tile_row"), every(columns).alias("tile_column"))
    b = right.select("*", every(rows).alias("tile_row"), block(right, columns).alias("tile_column"))
    keys = ["tile_row", "tile_column"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(lambda x, y: fn(x.drop_columns(keys), y.drop_columns(keys)), schema)
