"""Ranked lexical search as a blocked sparse matrix product.

The matrix of items (rows) and terms holds multiplicities, the one of terms and documents holds int64 impacts. Documents
are cut into blocks; in each block the rows of the product are merged one after another (Gustavson): an item's row is the
sum of the document rows of its terms, each times its multiplicity. Of each row the k best documents go on: first from
block to block of a task, then among groups of tasks, then among all.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A null text has none.
Each row of the documents is a document of its own, so repeated rows are ranked apart; rows of one item id are one item
whose terms add up, and null is an id like any other. Equal scores stand by ascending doc_id, null last. Items without
terms and items that no document meets have no row, as has an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rankloom.llm.common import slices, staged, words_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8 text with A-Z lower-cased and a space for each byte that stands in no term.
_FOLDED = bytes(b | 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Different terms of items that are looked for in one pass, about; more items are dealt to more passes.
PASS_TERMS = 1 << 18
#: Groups of tasks among which the best are sought before all meet.
GROUPS = 32
#: Places of a block: documents times items in one accumulator at most, and postings of the block.
BLOCK_POSTINGS = 1 << 21


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, q): how often each item holds each of its terms."""
    found = F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col(id_col).alias("item_id"), F.explode(found).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("q"))


def _folded(text: pa.Array) -> pa.Array:
    """Texts whose words at white space are their terms."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    own = data[offsets[0] : offsets[-1]].to_pybytes().translate(_FOLDED) if data is not None and len(text) else b""
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(own))


def _rows(vocabulary, doc_type: pa.DataType):
    """Documents with at least one term as (doc_id, n, terms, tfs): how many terms, and which of the vocabulary how often."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(vocabulary.value, pa.large_string())
        width = max(1, len(wanted))
        for batch in slices(batches):
            words, index, counts = words_of(_folded(batch.column(1)))
            code = pc.fill_null(pc.index_in(words, value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)[index]
            hit = code >= 0
            pairs, tf = np.unique(np.repeat(np.arange(len(counts)), counts)[hit] * width + code[hit], return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(pairs // width, minlength=len(counts)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pairs % width, tf)]
            out = pa.RecordBatch.from_arrays([batch.column(0).cast(doc_type), pa.array(counts), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(counts > 0))

    return count


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of one task."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        here = np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(total))
        here[: len(total)] += total
        total = here
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["term", "df"])


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """w * (10^9 tf div (1000 tf + 12 m)) with m = 75 + (25 n N div L), all in whole numbers."""
    if len(n) and 25 * int(n.max()) * n_docs >= 1 << 63:
        m = np.array([75 + 25 * int(x) * n_docs // length for x in n], np.int64)
    else:
        m = 75 + 25 * n * n_docs // max(1, length)
    return w * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about BLOCK_POSTINGS postings at most (or one document)."""
    size = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // BLOCK_POSTINGS
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _product(shared, k: int):
    """The k best documents of each item in one task."""

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, terms, times, ids, w, n_docs, length = shared.value
        items = len(rows) - 1
        best, floor = None, np.zeros(items, np.int64)
        for batch in batches:
            for block in _blocks(batch):
                block = block.take(pc.sort_indices(block.column("doc_id"), null_placement="at_end"))  # a smaller place is a smaller id
                lists = block.column("terms")
                owner = np.repeat(np.arange(block.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                term, tf = lists.flatten().to_numpy().astype(np.int64), block.column("tfs").flatten().to_numpy().astype(np.int64)
                impact = impacts(w[term], tf, block.column("n").to_numpy()[owner], n_docs, length)
                order = np.argsort(term, kind="stable")
                doc, impact = owner[order], impact[order]
                start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(w)))])
                places, scores, whose = [], [], []
                for i in range(items):
                    row = slice(rows[i], rows[i + 1])
                    acc = np.zeros(block.num_rows, np.int64)
                    for t, q, lo, hi in zip(terms[row], times[row], start[terms[row]], start[terms[row] + 1]):
                        if hi > lo:
                            acc[doc[lo:hi]] += q * impact[lo:hi]
                    found = np.flatnonzero(acc >= max(1, floor[i]))
                    if len(found) > k:
                        least = np.partition(acc[found], -k)[-k]
                        above = found[acc[found] > least]
                        found = np.concatenate([above, found[acc[found] == least][: k - len(above)]])
                    places.append(found)
                    scores.append(acc[found])
                    whose.append(np.full(len(found), i, np.int32))
                at = np.concatenate(places) if places else np.zeros(0, np.int64)
                new = pa.table({"i": np.concatenate(whose), "score": np.concatenate(scores), "doc_id": block.column("doc_id").take(pa.array(at))}) if len(at) else None
                if new is None:
                    continue
                both = new if best is None else pa.concat_tables([best, new])
                both = both.take(pc.sort_indices(both, [("i", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end"))
                i = both.column("i").to_numpy()
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                best = both.filter(pa.array(rank < k)).combine_chunks()
                last = np.flatnonzero(rank == k - 1)
                floor[i[last]] = both.column("score").to_numpy()[last]
        if best is not None:
            whole = pa.table({"item_id": ids.take(best.column("i").combine_chunks()), "doc_id": best.column("doc_id"), "score": best.column("score")})
            yield from whole.combine_chunks().to_batches()

    return multiply


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(spark: SparkSession, docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best of each task for the items of one pass."""
    held = asked.toArrow()  # bounded by PASS_TERMS and the longest item
    vocabulary = pc.unique(held.column("term").combine_chunks())
    ids = pc.unique(held.column("item_id").combine_chunks())
    whose = pc.index_in(held.column("item_id"), value_set=ids).to_numpy()
    order = np.argsort(whose, kind="stable")
    rows = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(ids)))])
    terms = pc.index_in(held.column("term"), value_set=vocabulary).to_numpy().astype(np.int64)[order]
    times = held.column("q").to_numpy()[order]
    shared = spark.sparkContext.broadcast(vocabulary.to_pylist())
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    arrow_type = docs.limit(0).select("doc_id").toArrow().schema.field(0).type
    counted = staged(docs.mapInArrow(_rows(shared, arrow_type), f"doc_id {doc_type}, n long, terms array<int>, tfs array<int>"), "search-rows")
    sums = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(max(1, len(vocabulary)), np.int64)
    for r in counted.select("terms").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the pass
        df[r["term"]] = r["df"]
    product = spark.sparkContext.broadcast((rows, terms, times, ids, weights(df, sums["n"]), sums["n"], sums["length"]))
    item_type = asked.schema["item_id"].dataType.simpleString()
    return counted.mapInArrow(_product(product, k), f"item_id {item_type}, doc_id {doc_type}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents (all, if fewer) with the highest score above 0."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = staged(item_terms(items, item_col, item_text), "search-items")
    passes = max(1, math.ceil(asked.count() / PASS_TERMS))
    found = []
    for p in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p)
        if not part.isEmpty():
            each = _searched(spark, docs, part, k).withColumn("g", F.spark_partition_id() % GROUPS)
            found.append(staged(_best(each, ["item_id", "g"], k).drop("rank"), "search-best"))
    if not found:
        ids = (items.schema[item_col].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString())
        return spark.createDataFrame([], f"item_id {ids[0]}, rank int, doc_id {ids[1]}, score long")
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return _best(whole, ["item_id"], k).select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL of search() over documents and benchmark, twenty documents an item.
SQL = r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) as w from documents
), i as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), q as (
  select item_id, term, count(*) as q from i group by all
), s as (
  select count(*)::bigint as n_docs, sum(len(w))::bigint as length from d where len(w) > 0
), p as (
  select doc_id, n, term, count(*)::bigint as tf from (select doc_id, len(w)::bigint as n, unnest(w) as term from d) where term in (select term from q) group by all
), f as (
  select term, count(*) as df from p group by term
), scored as (
  select item_id, doc_id, sum(q.q * floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // length))))::bigint as score
  from q join f using (term) join p using (term) cross join s group by item_id, doc_id
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""
