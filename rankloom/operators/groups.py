"""Work over one small group after another, without a frame for each group."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from rankloom.sources.storage import staged

#: Rows of a partition: a larger table has more of them, not larger ones.
ROWS = 500_000


def parts(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS))


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """df dealt by its keys to n partitions; as it is without n, so that Spark deals it where it must."""
    return df if n is None else df.repartition(n, *keys)


def by_group(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """fn's tuples for each group of rows with equal keys, given in order. A task holds one Arrow batch and one group."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    fields = StructType.fromDDL(schema)

    def key(row: dict) -> tuple:
        return tuple(row[k] for k in keys)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), target.types)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, group in groupby((row for b in batches for row in b.to_pylist()), key):
            out += fn(list(group))
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return dealt.mapInArrow(run, schema)


def by_block(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, n: int | None = None, placed: bool = False) -> DataFrame:
    """fn(rows, starts) for blocks of whole groups of rows with equal keys, given in order; starts are the places where
    groups begin. A task holds one block, or one group if that is larger. Rows are placed if the rows of each group stand
    after one another in order already, as those made from one row do; they are taken as they are."""
    fields = StructType.fromDDL(schema)
    sorted_ = rows if placed else (rows.repartition(n, *keys) if n else rows.repartition(*keys)).sortWithinPartitions(*keys, *order)

    def begins(t: pa.Table) -> np.ndarray:
        """The places at which a group begins, the first one left out."""
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for c in (t.column(k).combine_chunks() for k in keys):
            a, b = c.slice(1), c.slice(0, len(c) - 1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            new |= ~same.to_numpy(zero_copy_only=False)
        return np.flatnonzero(new) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)

        def done(t: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            if t.num_rows:
                yield from fn(t, np.concatenate([[0], at]).astype(np.int64)).cast(target).to_batches()

        held: list[pa.RecordBatch] = []  # of the last group, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            edge = pa.Table.from_batches(([held[-1].slice(held[-1].num_rows - 1)] if held else []) + [b])
            at = begins(edge) - (1 if held else 0)
            if not len(at):
                held.append(b)
                continue
            whole = pa.Table.from_batches([*held, b.slice(0, at[-1])]).combine_chunks()
            yield from done(whole, begins(whole))
            held = [b.slice(at[-1])]
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield from done(whole, begins(whole))

    return sorted_.mapInArrow(run, schema)


def slabs(starts: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, there): groups of like size as matrices, the places of a group's rows in a row; what fills it up is not
    there."""
    sizes = np.diff(np.append(starts, rows))
    caps = np.ceil(np.log2(sizes)).astype(np.int64)
    for cap in np.unique(caps):
        first, size = starts[caps == cap], sizes[caps == cap]
        places = np.arange(size.max())[None, :]
        there = places < size[:, None]
        yield first[:, None] + np.where(there, places, 0), there


def coded(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of strings as rows of a matrix of their numbers, filled up with -1; a null list is an empty one."""
    lists = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.dictionary_encode(pc.list_flatten(lists)).indices, -1).to_numpy(zero_copy_only=False)
    out = np.full((len(lengths), max(1, lengths.max(initial=0))), -1, np.int32)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def shared(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the numbers own (list, row, n) stand in other (list, m); -1 is none."""
    return ((own[:, :, :, None] == other[:, None, None, :]) & (own >= 0)[:, :, :, None]).any(axis=3)


def by_text(rows: DataFrame, fn: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """rows joined with fn(different texts), which keeps the text: what follows from a text alone is worked out once for
    each different one, however many rows say it. Texts that fn leaves out lose their rows."""
    known = staged(fn(rows.select(text).distinct()).withColumnRenamed(text, "_said"), "texts")
    return rows.join(known, F.col(text).eqNullSafe(F.col("_said"))).drop("_said")
