"""Queries over vectors and texts: top-k, fusion, re-ranking and the whole chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.functions import scalars
from rankloom.functions.text import exact as normal, tokens
from rankloom.operators import dense, encode, lexical, ranking, requests
from rankloom.plans import ctes
from rankloom.sources import adapters
from rankloom.sources.storage import staged

WEIGHTS = {"fusion": {"HH": 0.2, "HL": 0.4, "LH": 0.6, "LL": 0.8}, "exact": {"HH": 0.05, "HL": 0.1, "LH": 0.15, "LL": 0.0}}


def dense_topk(spark: SparkSession, sf_dir: str, k: int = 20, first: int | None = None, cosine: bool = True) -> DataFrame:
    queries, items = adapters.vectors(spark, sf_dir)
    return dense.top_k(queries, items, k, first, cosine)


def valid_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "embeddings")
    ok = F.coalesce(F.size("embedding") == 64, F.lit(False)) & (F.col("vec_id") % 9 != 0)
    return rows.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("dropped"))


def encode_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents closest to each benchmark item, both encoded as vectors."""
    asked = encode.encoded(adapters.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))
    docs = encode.encoded(adapters.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("query")))
    return dense.top_k(staged(asked, "encoded"), staged(docs, "encoded"), 10)


def vector_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by length, where every fifth is cut, every seventh holds a null and every ninth is missing."""
    v, n = F.col("embedding").cast("array<double>"), F.col("vec_id")
    ragged = F.when(n % 9 == 0, F.lit(None)).when(n % 7 == 0, F.array_append(F.slice(v, 1, 10), F.lit(None).cast("double"))).when(n % 5 == 0, F.slice(v, 1, 32)).otherwise(v)
    return dense.validity(adapters.table(spark, sf_dir, "embeddings").select(ragged.alias("vector")))


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.select("vec_id", F.posexplode(scalars.unit(F.col("v"))).alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = adapters.table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    return words.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count_distinct("term").alias("terms"))


def bm25_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_frequency(lexical.terms(adapters.table(spark, sf_dir, "documents"), "doc_id", "text"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = adapters.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return lexical.top_k(adapters.table(spark, sf_dir, "documents"), asked, 20)


def retrieve_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of several lengths for benchmark items as requests, some of them blank and some that ask for nothing."""
    docs = adapters.table(spark, sf_dir, "documents")
    item = F.col("item_id")
    asked = adapters.table(spark, sf_dir, "benchmark").select(item.alias("query_id"), F.when(item % 7 == 0, "  ").otherwise(F.col("text")).alias("query"), (item % 5 * 3 - 3).alias("k"))
    out = requests.answered(asked, lambda live, depth: lexical.top_k(docs, live, depth), docs.count())
    return out.select("query_id", F.array_join(F.col("predicted_track_ids").cast("array<string>"), ",").alias("items"))


def _corpus(spark: SparkSession, sf_dir: str, fields: tuple[str, ...]) -> DataFrame:
    tracks = adapters.catalog(spark, sf_dir)
    return tracks.select("ord", scalars.labelled({f: F.col(f) for f in fields}, "\n").alias("text"))


def bm25_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = adapters.catalog(spark, sf_dir).select(F.col("ord").alias("query_id"), F.concat_ws(" ", F.array_join("track_name", " "), F.array_join("album_name", " ")).alias("query"))
    return lexical.top_k(_corpus(spark, sf_dir, ("track_name", "artist_name", "album_name", "tag_list")), asked, 10, "ord")


def _branches(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    return dense_topk(spark, sf_dir, k), dense_topk(spark, sf_dir, k, 32, False)


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rrf(*_branches(spark, sf_dir, 50), 0.25)


def _weights(spark: SparkSession, sf_dir: str, of: str) -> DataFrame:
    kinds = adapters.specificity(adapters.vectors(spark, sf_dir)[0])
    table = F.create_map(*(F.lit(x) for kv in WEIGHTS[of].items() for x in kv))
    return kinds.select("query_id", table[F.col("specificity")].alias("weight"))


def chain(spark: SparkSession, sf_dir: str, upto: str) -> dict[str, DataFrame]:
    """The relations of the chain by name, up to the one asked for. Lists of 50 are the heads of those of 100."""
    deep = [staged(x, "branch") for x in _branches(spark, sf_dir, 100)]
    a, b = (x.where("rank <= 50") for x in deep)
    out = {"adaptive": ranking.rrf(a, b, 0.25), "goal": ranking.rrf(b, a, 0.5)}
    # the branches and what follows the exact matches are read several times
    out = {k: staged(df, k) for k, df in out.items()}
    out["fused"] = ranking.rrf(out["adaptive"], out["goal"], _weights(spark, sf_dir, "fusion"))
    if upto == "fused":
        return out
    out["fused"] = staged(out["fused"], "fused")
    out["reservoir"] = staged(ranking.rrf(*deep, 0.25, top=100), "reservoir")
    part = adapters.table(spark, sf_dir, "part")
    tracks = part.select(F.col("p_partkey").alias("item_id"), normal(F.col("p_name")).alias("title"), normal(F.col("p_brand")).alias("artist"), normal(F.col("p_type")).alias("album"))
    asked = adapters.vectors(spark, sf_dir)[0].select("query_id", (F.col("query_id") % part.count()).alias("item_id"))
    requests = asked.join(part.select(F.col("p_partkey").alias("item_id"), normal(F.concat(F.lit("play "), "p_name", F.lit(" by "), "p_brand")).alias("request")), "item_id").select("query_id", "request")
    out["catalog"] = tracks.select("item_id")
    out["scores"] = out["fused"].select("query_id", "item_id").join(tracks, "item_id").join(requests, "query_id").select("query_id", "item_id", scalars.exact_score(F.col("request"), F.col("title"), F.col("artist"), F.col("album")).alias("exact"))
    out["matched"] = staged(ranking.exact_rerank(out["fused"].drop("score"), out["scores"], _weights(spark, sf_dir, "exact")), "matched")
    n = asked.count()
    out["turns"] = n
    out["matched_times"] = ranking.frequency(out["reservoir"])
    out["diverse"] = ranking.diversity_rerank(out["matched"].drop("score"), out["matched_times"], n, 5, 1.0)
    out["diverse_times"] = ranking.frequency(out["diverse"])
    return out


def rrf_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir, "fused")["fused"]


def exact_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir, "all")["scores"]


def exact_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir, "all")["matched"]


def exact_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir, "all")
    rows = c["fused"].select("query_id", F.col("rank").alias("was"), "item_id").join(c["scores"], ["query_id", "item_id"])
    return ranking._ranked(rows, ("query_id",), F.desc("exact"), "was", extra=("was", "exact"))


def diversity_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir, "all")["diverse"]


def candidate_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir, "all")
    return ranking.candidate_expansion(c["diverse"], c["reservoir"], c["diverse_times"], c["turns"], 10, 5, 2.0)


def selective_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir, "all")
    return ranking.selective_rerank(c["diverse"], c["reservoir"], c["diverse_times"], c["turns"])


def final_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir, "all")
    settings = {
        "fusion_weights": _weights(spark, sf_dir, "fusion"), "exact_weights": _weights(spark, sf_dir, "exact"), "fusion_rrf_k": 60, "diversity": {"protect": 5, "weight": 1.0}, "selective": {},
        "diversity_statistics": (c["matched_times"], c["turns"]), "selective_statistics": (c["diverse_times"], c["turns"]),
    }
    return ranking.final_ranking(c["adaptive"], c["goal"], c["reservoir"], c["catalog"], c["scores"], settings)


def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir, "all")
    return c["matched_times"].select("item_id", "times", F.round(scalars.novelty(F.col("times"), F.lit(c["turns"])), 6).alias("novelty"))


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
_STOP = "('" + "', '".join(lexical.STOP_WORDS) + "')"


def _bm25_sql(docs: str, queries: str, k: int) -> str:
    return f"""WITH docs AS ({docs}), asked AS ({queries}),
d AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM docs) WHERE term NOT IN {_STOP} GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_WORDS}) AS term FROM asked) WHERE term NOT IN {_STOP} GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS dl FROM d GROUP BY doc_id), df AS (SELECT term, count(*) AS df FROM d GROUP BY term),
st AS (SELECT (SELECT count(*) FROM docs) AS n, (SELECT sum(dl) FROM len) / (SELECT count(*) FROM docs) AS avgdl),
s AS (SELECT query_id, doc_id AS item_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN df USING (term) JOIN d USING (term) JOIN len USING (doc_id), st GROUP BY ALL)
SELECT query_id, rank, item_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank FROM s) WHERE rank <= {k}"""


_FIELDS = "concat('track_name: ', p_name, chr(10), 'artist_name: ', p_brand, chr(10), 'album_name: ', p_type, chr(10), 'tag_list: ', array_to_string(tag_list, ', '))"

QUERIES = {
    f.__name__: f
    for f in (dense_topk, encode_queries, vector_lengths, valid_embeddings, l2_normalize, tokenize, bm25_df, bm25_topk, retrieve_requests, bm25_fields, rrf_hybrid, rrf_branch, exact_score, exact_rerank, exact_debug, diversity_rerank, candidate_expansion, selective_rerank, final_pipeline, novelty)
}
_CHAIN = f"WITH {ctes.CHAIN} "
SQL = {
    "dense_topk": f"WITH {ctes.VECTORS} {ctes.dense(20)}",
    "valid_embeddings": "SELECT count(*) FILTER (len(embedding) = 64 AND vec_id % 9 <> 0) AS valid, count(*) FILTER (NOT (coalesce(len(embedding) = 64, false) AND vec_id % 9 <> 0)) AS dropped FROM embeddings",
    "vector_lengths": """SELECT length, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS dropped FROM (SELECT CASE WHEN vec_id % 9 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN least(len(embedding), 10) + 1 WHEN vec_id % 5 = 0 THEN least(len(embedding), 32) ELSE len(embedding) END::INT AS length, vec_id % 9 <> 0 AND vec_id % 7 <> 0 AS ok FROM embeddings) GROUP BY length""",
    "l2_normalize": """WITH r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, CAST(pos AS INT) AS pos, round(v[pos + 1] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS x FROM (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n, unnest(range(len(v))) AS pos FROM r)""",
    "tokenize": f"SELECT doc_id, count(*) AS tokens, count(DISTINCT term) AS terms FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY doc_id",
    "bm25_df": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) WHERE term NOT IN {_STOP} GROUP BY term",
    "bm25_topk": _bm25_sql("SELECT doc_id, text FROM documents", "SELECT item_id AS query_id, text FROM benchmark", 20),
    "bm25_fields": f"WITH {ctes.CATALOG}, top AS ({_bm25_sql(f'SELECT ord AS doc_id, {_FIELDS} AS text FROM cat', "SELECT ord AS query_id, concat(p_name, ' ', p_type) AS text FROM cat", 10)}) SELECT * FROM top",
    "retrieve_requests": f"""WITH req AS (SELECT item_id AS query_id, CASE WHEN item_id % 7 = 0 THEN '  ' ELSE text END AS query, item_id % 5 * 3 - 3 AS k FROM benchmark),
top AS ({_bm25_sql("SELECT doc_id, text FROM documents", "SELECT query_id, query AS text FROM req WHERE trim(query) <> '' AND k > 0", 9)})
SELECT query_id, coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) FILTER (rank <= k), '') AS items FROM req LEFT JOIN top USING (query_id) GROUP BY query_id""",
    "rrf_hybrid": _CHAIN + "SELECT * FROM adaptive",
    "rrf_branch": _CHAIN + "SELECT * FROM fused",
    "exact_score": _CHAIN + "SELECT * FROM exacts",
    "exact_rerank": _CHAIN + "SELECT * FROM matched",
    "exact_debug": _CHAIN + ctes.ranked("SELECT query_id, item_id, f.rank AS was, exact FROM fused f JOIN exacts USING (query_id, item_id)", "exact DESC, was", extra=", was, exact"),
    "diversity_rerank": _CHAIN + "SELECT * FROM diverse",
    "candidate_expansion": _CHAIN + ctes.expansion("diverse", "reservoir", "diverse_times", "10", "5", "2.0"),
    "selective_rerank": _CHAIN + ctes.selective("diverse", "reservoir", "diverse_times"),
    "final_pipeline": f"WITH {ctes.CHAIN}, sel AS ({ctes.selective('diverse', 'reservoir', 'diverse_times')}) " + ctes.ranked("SELECT query_id, item_id, rank AS was FROM sel WHERE item_id IN (SELECT p_partkey FROM part)", "was", top="20"),
    "novelty": _CHAIN + f"SELECT item_id, times, round({ctes.NOVELTY}, 6) AS novelty FROM matched_times, sizes",
}
