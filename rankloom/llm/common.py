"""Helpers shared by the corpus operators: staged tables in the shared folder and bounded Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: The bytes that separate words in every operator here.
WHITE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor shares; the warehouse's if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rankloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one or two numbers that are broadcast at most (some 60 bytes each in a hash table).
BROADCAST_ROWS = 2_000_000


def broadcast_if_few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written table of narrow rows, marked for broadcast if it has `most` rows at most; else Spark joins it as it
    sees fit. The rows that it meets are then not shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def slices(batches: Iterable[pa.RecordBatch], text: int = 1, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that column `text` holds about `limit` bytes at most (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            yield batch.slice(lo, hi - lo)


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, index of each word in these, number of words by text); words are cut at ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(text, "")))
    flat = lists.flatten()
    filled = pc.greater(pc.binary_length(flat), 0)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if not pc.all(filled, min_count=0).as_py():
        keep = filled.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[keep], minlength=len(counts))
        flat = flat.filter(filled)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), counts


def sum_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `values` of the lengths `counts`; 0 for an empty run."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few rows that the driver made, as a literal that Spark itself unpacks."""
    import json

    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def power_of_two(x: float, most: int) -> int:
    """The bits of the smallest power of two that is at least x, `most` of them at most."""
    return max(0, min(most, int(np.ceil(np.log2(max(1.0, x))))))
