"""BM25 over a saved index: postings by blocks of documents, in buckets of their terms, with bounds that skip blocks.

A build goes once over the documents: each task inverts some thousand documents at a time and writes a row for each term
of such a block (ids, frequencies, lengths, and the largest frequency and smallest length), so that no single posting is
shuffled. A search reads the buckets of its terms alone. From the bounds of a block's terms follows what a query can
reach there at most; the blocks that promise most are scored first, and of the others those that can still beat the k-th
best score.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rankloom.functions.text import STOP_WORDS, tokens
from rankloom.sources.storage import shared_dir, staged

K1, B = 1.5, 0.75
#: Documents and words of a block, about, and the buckets that terms are dealt to.
BLOCK_DOCS, BLOCK_WORDS, BUCKETS = 4096, 1 << 22, 64


def terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf) without stop words."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return words.where(~F.col("term").isin(STOP_WORDS)).groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def _inverted(id_type: pa.DataType):
    """(block, term, n, most, least, ids, tfs, lengths) of some documents (id, words) at a time."""

    def block(docs: pa.RecordBatch) -> pa.RecordBatch:
        lists = docs.column(1)
        owner = np.repeat(np.arange(docs.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary
        kept = ~pc.is_in(names, value_set=pa.array(STOP_WORDS, names.type)).to_numpy(zero_copy_only=False) if len(names) else np.zeros(0, bool)
        code = coded.indices.to_numpy(zero_copy_only=False)
        owner, code = (owner[kept[code]], code[kept[code]]) if len(code) else (owner, code)
        lengths = np.bincount(owner, minlength=docs.num_rows)
        place, tf = np.unique(code.astype(np.int64) * docs.num_rows + owner, return_counts=True)  # by term, then document
        term, doc = place // max(1, docs.num_rows), place % max(1, docs.num_rows)
        start = np.flatnonzero(np.diff(term, prepend=-1))
        ends = pa.array(np.append(start, len(term)).astype(np.int32))
        of = lambda values, kind: pa.ListArray.from_arrays(ends, values.cast(kind))
        length = lengths[doc]
        most, least = (f.reduceat(x, start) if len(start) else np.zeros(0, np.int64) for f, x in ((np.maximum, tf), (np.minimum, length)))
        columns = [
            pa.array(np.full(len(start), uuid.uuid4().int >> 65)), names.take(pa.array(term[start])).cast(pa.string()), pa.array(np.diff(np.append(start, len(term)))), pa.array(most), pa.array(least), pa.array(np.add.reduceat(tf, start) if len(start) else np.zeros(0, np.int64)),
            of(docs.column(0).take(pa.array(doc)), id_type), of(pa.array(tf), pa.int32()), of(pa.array(length), pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "term", "n", "most", "least", "words", "ids", "tfs", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            part = np.maximum(np.arange(batch.num_rows) // BLOCK_DOCS, size // BLOCK_WORDS)
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    yield block(batch.slice(lo, hi - lo))

    return run


def _bucket(term) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def save_index(docs: DataFrame, path: str, source: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the index of docs under path. A marker written last, with the counts that a load checks, makes it visible."""
    spark = docs.sparkSession
    data = f"{path}/postings-{uuid.uuid4().hex}"
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if slim.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        slim = slim.repartition(spark.sparkContext.defaultParallelism)
    id_type = slim.schema["id"].dataType
    arrow = slim.limit(0).select("id").toArrow().schema.field(0).type
    schema = f"block long, term string, n long, most long, least long, words long, ids array<{id_type.simpleString()}>, tfs array<int>, lengths array<int>"
    blocks = slim.select("id", tokens(F.col("text")).alias("words")).mapInArrow(_inverted(arrow), schema).withColumn("bucket", _bucket("term"))
    blocks.repartition(F.col("bucket")).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(data)
    found = spark.read.parquet(data).agg(F.count("*").alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("total")).first() if _has_files(spark, data) else {"n": 0, "total": 0}
    marker = spark.createDataFrame([(source, docs.count(), found["n"], found["total"], data)], "source string, documents long, postings long, total long, data string")
    marker.coalesce(1).write.mode("overwrite").parquet(f"{path}/marker")


def _has_files(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:  # no term at all, so no bucket
        return False
    return True


def load_index(spark: SparkSession, path: str, source: str) -> tuple[DataFrame, int, int]:
    """(postings, documents, sum of lengths) of the index at path; another source or missing postings are an error."""
    marker = spark.read.parquet(f"{path}/marker").first()
    if marker["source"] != source:
        raise ValueError(f"the index is of {marker['source']}")
    if not marker["postings"]:
        empty = "block long, term string, n long, most long, least long, words long, ids array<long>, tfs array<int>, lengths array<int>, bucket int"
        return spark.createDataFrame([], empty), marker["documents"], 0
    postings = spark.read.parquet(marker["data"])
    if postings.count() != marker["postings"]:
        raise ValueError("the index is incomplete")
    return postings, marker["documents"], marker["total"]


def index_of(docs: DataFrame, path: str, source: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """The index at path if it is whole and of this source; else it is written first."""
    try:
        return load_index(docs.sparkSession, path, source)
    except (AnalysisException, ValueError):
        save_index(docs, path, source, id_col, text_col)
        return load_index(docs.sparkSession, path, source)


def source_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> str:
    """A digest of all ids and texts, whatever their order: the name of an index of just these documents."""
    one, two = F.xxhash64(id_col, text_col), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col))
    found = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(one.cast("decimal(20,0)")), F.lit(0)).alias("a"), F.coalesce(F.sum(two.cast("decimal(20,0)")), F.lit(0)).alias("b")).first()
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{id_col} {docs.schema[id_col].dataType.simpleString()} {found['n']} {found['a']} {found['b']}").hex


def shared_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """The index of these documents in the shared folder: built by the first call, used again by those that follow."""
    source = source_of(docs, id_col, text_col)
    return index_of(docs, f"{shared_dir(docs.sparkSession)}/rankloom-index-{source}", source, id_col, text_col)


def _scored(decimals: int, k: int):
    """The k best documents in one block for each query that asks there: (query_id, item_id, score)."""

    def score(asked: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        ids = pc.unique(pc.list_flatten(found.column("ids"))).sort() if found.num_rows else pa.array([])
        names = pc.unique(asked.column("query_id"))
        if asked.num_rows and found.num_rows:
            flat = [pc.list_flatten(found.column(c)) for c in ("ids", "parts")]
            place, part = pc.index_in(flat[0], value_set=ids).to_numpy(), flat[1].to_numpy()
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(found.column("ids")).to_numpy())])
            row = pc.index_in(asked.column("term"), value_set=found.column("term").combine_chunks()).to_numpy()
            whose, weight = pc.index_in(asked.column("query_id"), value_set=names).to_numpy(), asked.column("weight").to_numpy()
            order = np.argsort(whose, kind="stable")
            edges = np.searchsorted(whose[order], np.arange(len(names) + 1))
            for q, (lo, hi) in enumerate(zip(edges, edges[1:])):
                total, hit = np.zeros(len(ids)), np.zeros(len(ids), bool)
                for i in order[lo:hi]:
                    at = place[ends[row[i]] : ends[row[i] + 1]]
                    total[at] += weight[i] * part[ends[row[i]] : ends[row[i] + 1]]
                    hit[at] = True
                at = np.flatnonzero(hit)
                score = np.round(total[at], decimals)
                if len(at) > k:
                    best = np.lexsort((at, -score))[:k]
                    at, score = at[best], score[best]
                out.append((np.full(len(at), q), at, score))
        whole = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query_id": names.take(pa.array(whole[0])), "item_id": ids.take(pa.array(whole[1])) if out else pa.array([], found.schema.field("ids").type.value_type), "score": whole[2]})

    return score


def top_k(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", query_col: str = "query_id", query_text: str = "query", decimals: int = 6, index: tuple[DataFrame, int, int] | None = None, pad: bool = False) -> DataFrame:
    """(query_id, rank, item_id, score) of the documents that match, k at most for each query. Queries of the same terms
    are answered once.

    Term weights are ln(1 + (N - df + .5) / (df + .5)) * tf / (tf + k1 (1 - b + b * dl / avgdl)); a term that a query
    repeats adds as often. Ties go to the smaller id. index is one of load_index, by default the shared one of these
    documents; k at most 0 asks for nothing, and a query without terms finds nothing. With pad, lists that are too short
    go on with documents that do not match, by id, with score 0.
    """
    spark = docs.sparkSession
    asked = terms(queries, query_col, query_text).select(F.col("id").alias("query_id"), "term", F.col("tf").alias("qtf"))
    postings, n, total = index if index is not None else shared_index(docs, id_col, text_col)
    bags = asked.where("query_id is not null").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "qtf"))).alias("bag"))
    whose = staged(bags.withColumn("same_as", F.md5(F.to_json("bag"))), "bags")
    asked = whose.groupBy("same_as").agg(F.first("bag").alias("bag")).select(F.col("same_as").alias("query_id"), F.inline("bag"))
    asked = staged(asked.withColumn("bucket", _bucket("term")), "asked")
    buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
    held = postings.where(F.col("bucket").isin(buckets)).join(asked.select("term").distinct(), "term", "left_semi")
    average = total / n if total else 1.0
    part = lambda tf, length: tf / (tf + K1 * (1 - B + B * length / F.lit(average)))
    meta = staged(held.select("block", "term", "n", part(F.col("most"), F.col("least")).alias("bound")), "bounds")
    df = meta.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.col("qtf") * F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = staged(asked.join(df, "term").select("query_id", "term", weight.alias("weight")), "weights")
    bounds = staged(weighed.join(meta, "term").groupBy("query_id", "block").agg(F.sum(F.col("weight") * F.col("bound")).alias("bound"), F.max("n").alias("docs")), "reach")
    lists = held.select("block", "term", "ids", F.zip_with("tfs", "lengths", part).alias("parts"))
    types = ("string", docs.schema[id_col].dataType.simpleString())

    def scored(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select("query_id", "block").join(weighed, "query_id").join(meta.select("block", "term"), ["block", "term"], "left_semi")
        own = lists.join(wanted.select("block", "term").distinct(), ["block", "term"], "left_semi")
        return wanted.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(lambda a, b: _scored(decimals, max(0, k))(a, b), f"query_id {types[0]}, item_id {types[1]}, score double")

    # the blocks that promise most, as many as surely hold k documents that match
    before = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    first = staged(bounds.withColumn("so_far", F.coalesce(F.sum("docs").over(before), F.lit(0))).where(F.col("so_far") < k).select("query_id", "block"), "first-blocks")
    sure = staged(scored(first), "first-scores")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    edge = sure.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("edge"))
    slack = 10.0**-decimals
    rest = bounds.join(first, ["query_id", "block"], "left_anti").join(edge, "query_id", "left").where(F.coalesce(F.col("bound") >= F.col("edge") - slack, F.lit(True)))
    both = sure.unionByName(scored(staged(rest, "other-blocks")))
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(0, k)).select(F.col("query_id").alias("same_as"), "rank", "item_id", "score")
    ranked = whose.select("query_id", "same_as").join(ranked, "same_as").select("query_id", "rank", "item_id", "score")
    return _padded(staged(ranked, "ranked"), docs, queries, k, id_col, query_col) if pad else ranked


def _padded(ranked: DataFrame, docs: DataFrame, queries: DataFrame, k: int, id_col: str, query_col: str) -> DataFrame:
    """Lists shorter than k, filled up with the smallest ids that they lack. The 2 k smallest ids hold k that a list of
    fewer than k lacks."""
    asked = queries.select(F.col(query_col).alias("query_id")).distinct()
    size = ranked.groupBy("query_id").agg(F.count("*").alias("n"))
    short = asked.join(size, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)
    few = docs.select(F.col(id_col).alias("item_id")).distinct().orderBy("item_id").limit(2 * max(0, k))
    more = short.crossJoin(F.broadcast(few)).join(ranked.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    place = (F.col("n") + F.row_number().over(Window.partitionBy("query_id").orderBy("item_id"))).cast("int")
    filled = more.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "item_id", F.lit(0.0).alias("score"))
    return ranked.unionByName(filled)
