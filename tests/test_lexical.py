"""The saved BM25 index: used again, refused when incomplete, the same rows as a fresh one."""

import pytest

from rankloom.operators import lexical
from rankloom.sources import storage


def test_saved_index(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id as query_id", "text as query")
    path = storage.fresh_path(spark, "index")
    first = lexical.index_of(docs, path, "documents")
    rows = lambda index: sorted(map(tuple, lexical.top_k(docs, asked, 5, index=index).collect()))
    wanted = rows(None)
    assert wanted and rows(first) == wanted
    again = lexical.index_of(docs.where("1 = 0"), path, "documents")  # what is there is used, not built anew
    assert rows(again) == wanted and again[1:] == first[1:]
    with pytest.raises(ValueError):
        lexical.load_index(spark, path, "other documents")
    assert lexical.top_k(docs, asked, 0, index=first).count() == 0 and lexical.top_k(docs, asked, -3, index=first).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, "  "), (3, None), (4, "the of")], "query_id long, query string")
    assert lexical.top_k(docs, blank, 5, index=first).count() == 0


def test_incomplete_index_is_refused_and_built_again(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = storage.fresh_path(spark, "index")
    lexical.save_index(docs, path, "documents")
    marker = spark.read.parquet(f"{path}/marker").first()
    short = spark.createDataFrame(spark.read.parquet(marker["data"]).limit(10).collect())
    short.write.mode("overwrite").parquet(marker["data"])
    with pytest.raises(ValueError):
        lexical.load_index(spark, path, "documents")
    assert lexical.index_of(docs, path, "documents")[0].count() == marker["postings"]


def test_shared_index_is_built_once(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id as query_id", "text as query")
    first = sorted(map(tuple, lexical.top_k(docs, asked, 7).collect()))
    with monkeypatch.context() as m:
        m.setattr(lexical, "save_index", lambda *a: pytest.fail("built again"))
        assert sorted(map(tuple, lexical.top_k(docs.repartition(3), asked, 7).collect())) == first
    built = []
    with monkeypatch.context() as m:
        m.setattr(lexical, "save_index", lambda d, path, source, *a, real=lexical.save_index: built.append(source) or real(d, path, source, *a))
        lexical.top_k(docs.where("doc_id > 3"), asked, 7)
    assert len(built) == 1


def plain(docs, queries, k):
    import math
    import re
    from collections import Counter

    words = lambda t: Counter(w for w in re.findall(r"\w{2,}", (t or "").lower()) if w not in lexical.STOP_WORDS)
    held = {i: words(t) for i, t in docs}
    average = sum(sum(c.values()) for c in held.values()) / len(held)
    df = Counter(t for c in held.values() for t in c)
    out = set()
    for q, text in queries:
        scores = {}
        for i, c in held.items():
            hit = [t for t in words(text) if t in c]
            if hit:
                part = lambda t: c[t] / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / average))  # noqa: B023, E731
                scores[i] = round(sum(words(text)[t] * math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * part(t) for t in hit), 6)
        out |= {(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])}
    return out


def test_blocks_are_skipped_and_nothing_is_lost(spark, monkeypatch):
    import random

    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    rng = random.Random(4)
    vocabulary = [f"word{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    texts = [(i, " ".join(rng.sample(vocabulary, rng.randint(0, 60))) + (" needle in this hay" if i % 97 == 5 else "")) for i in range(1200)]
    asked = [(1, "needle"), (2, "needle hay word5 word5"), (3, "word1 word2 word3"), (4, "unheard"), (5, ""), (6, " ".join(vocabulary[:30]))]
    docs, queries = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, query string")
    seen = []
    monkeypatch.setattr(lexical, "staged", lambda df, label, real=lexical.staged: (seen.append((label, real(df, label))) or seen[-1][1]))
    found = {(r[0], r[1], r[2], round(r[3], 6)) for r in lexical.top_k(docs, queries, 10).collect()}
    wanted = plain(texts, asked, 10)
    assert {r[:3] for r in found} == {r[:3] for r in wanted}
    assert sorted(r[3] for r in found) == pytest.approx(sorted(r[3] for r in wanted), abs=2e-6)
    rows = {label: df.count() for label, df in seen}
    assert rows["first-blocks"] + rows["other-blocks"] < rows["reach"]
    padded = lexical.top_k(docs, queries, 10, pad=True).collect()
    assert len(padded) == 60 and {r["item_id"] for r in padded if r["query_id"] == 5} == set(range(10))
    assert {(r[0], r[1], r[2]) for r in padded if r["score"] > 0} == {r[:3] for r in wanted}


def test_only_the_buckets_of_the_terms_are_read(spark):
    docs = spark.createDataFrame([(i, f"term{i} shared") for i in range(300)], "doc_id long, text string")
    postings, *_ = lexical.shared_index(docs)
    plan = postings.where("bucket in (3, 5)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    strings = docs.selectExpr("cast(doc_id as string) as doc_id", "text")
    asked = spark.createDataFrame([("q", "term7")], "query_id string, query string")
    assert [tuple(r)[:3] for r in lexical.top_k(strings, asked, 5).collect()] == [("q", 1, "7")]
    none = docs.where("1 = 0")
    assert lexical.top_k(none, asked, 5).count() == 0 and lexical.top_k(docs, asked.where("1 = 0"), 5).count() == 0


def test_queries_of_the_same_terms_are_answered_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} ring old{i % 3}") for i in range(60)], "doc_id long, text string")
    texts = ["ring word3", "word3 the ring!", "old1", "word3 ring ring"]
    queries = spark.createDataFrame([(i, texts[i % 4]) for i in range(400)], "query_id long, query string")
    written, plain = {}, lexical.staged
    monkeypatch.setattr(lexical, "staged", lambda df, label: written.setdefault(label, plain(df, label)))
    found = {}
    for r in lexical.top_k(docs, queries, 5).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["item_id"], r["score"]))
    blocks = written["bounds"].select("block").distinct().count()
    assert written["reach"].count() <= 3 * blocks
    assert len(found) == 400 and all(sorted(found[i]) == sorted(found[i % 4]) for i in found)
    assert sorted(found[0]) == sorted(found[1]) != sorted(found[3])
