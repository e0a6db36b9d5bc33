"""Dense top-k: cosine or dot product of all items with a set of queries, in tiles of a block of each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.operators.tiles import tiled

#: Queries and items of a tile.
QUERIES, ITEMS = 1024, 4096


def whole(vector: Column, dim: int | None = None) -> Column:
    """Whether a vector is there, without nulls, and of length dim if that is given."""
    there = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    return F.coalesce(there & (F.size(vector) == dim) if dim is not None else there, F.lit(False))


def validity(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """(length, valid, dropped): how many vectors of each length are used and how many are not; null has length null."""
    ok = whole(F.col("vector"), dim)
    length = F.when(F.col("vector").isNotNull(), F.size("vector"))
    return vectors.groupBy(length.alias("length")).agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("dropped"))


def top_k(queries: DataFrame, items: DataFrame, k: int, first: int | None = None, cosine: bool = True, decimals: int = 6, dim: int | None = None) -> DataFrame:
    """(query_id, rank, item_id, score): the k best items of each query by (rounded score, smaller id).

    queries (query_id, vector) and items (item_id, vector); `first` cuts the vectors. A query meets the items whose
    vectors are as long as its own; with dim, only vectors of that length are used. Vectors that are null, empty or hold
    a null are left out (see validity). Blocks of queries and items meet in tiles, of which only the k best of each query
    go on, so nothing is collected and the shuffle holds the blocks and k rows a query and tile.
    """
    asked = queries.where(whole(F.col("vector"), dim)).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    known = items.where(whole(F.col("vector"), dim)).select("item_id", F.col("vector").cast("array<double>").alias("vector"))
    types = (asked.schema["query_id"].dataType.simpleString(), known.schema["item_id"].dataType.simpleString())
    scored = tiled(asked, known, QUERIES, ITEMS, _best(k, first, cosine, decimals), f"query_id {types[0]}, item_id {types[1]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "item_id", "score")


def _best(k: int, first: int | None, cosine: bool, decimals: int):
    def tile(queries: pa.Table, items: pa.Table) -> pa.Table:
        items = items.take(pc.sort_indices(items.column("item_id")))  # a smaller place is a smaller id
        places: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for dim in pc.unique(pc.list_value_length(queries.column("vector"))).to_pylist():
            rows, wanted = _matrix(queries.column("vector"), dim, first, cosine)
            held, known = _matrix(items.column("vector"), dim, first, cosine)
            for q, row in zip(rows, np.round(wanted @ known.T, decimals)):
                at = np.arange(len(row))
                if len(row) > k:
                    edge = np.partition(row, len(row) - k)[len(row) - k]
                    at = np.concatenate([np.flatnonzero(row > edge), np.flatnonzero(row == edge)])[:k]
                places.append((np.full(len(at), q), held[at], row[at]))
        q, i, score = (np.concatenate(x) for x in zip(*places)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": queries.column("query_id").take(pa.array(q)), "item_id": items.column("item_id").take(pa.array(i)), "score": score})

    return tile


def _matrix(vectors: pa.ChunkedArray, dim: int, first: int | None, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of the vectors of one length."""
    fits = pc.equal(pc.list_value_length(vectors), dim)
    rows = pc.list_flatten(vectors.filter(fits)).to_numpy().reshape(-1, dim)[:, :first]
    return np.flatnonzero(fits.to_numpy()), unit(rows) if cosine else rows


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norm == 0, 1, norm)
