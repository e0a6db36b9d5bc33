import math
import re
from collections import Counter

import pytest
from compare import assert_same

from rankloom.llm import lexical_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain(docs: list[tuple], items: list[tuple], k: int = 20) -> set[tuple]:
    """(item_id, rank, doc_id, score) by plain loops."""
    words = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    n_docs, length = len(words), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(FOLD)))
    out = set()
    for item, q in asked.items():
        scored = []
        for i, c in words:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // length
            s = sum(k_ * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k_ in q.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        scored.sort(key=lambda x: x[:3])
        out |= {(item, r + 1, x[3], -x[0]) for r, x in enumerate(scored[:k])}
    return out


def rows(df):
    return {tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()}


def test_query_against_sql_and_plain_loops(spark, sf_dir, docs):
    found = queries.op11_lexical_search(spark, sf_dir)
    assert_same(found, queries.oracle_sql()["op11_lexical_search"], sf_dir)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert rows(found) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])


def test_passes_blocks_and_ties(spark, monkeypatch):
    texts = [(i, f"common word{i % 7} {'Copy of one text' if i % 3 == 0 else 'other ' * (i % 5)}") for i in range(700)]
    items = [(1, "COPY of one common text text"), (2, "word3 word3 word5"), (3, "nowhere"), (4, ""), (5, None), (6, "other-common/ÉTÉ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = plain(texts, items)
    assert rows(lexical_search.search(docs, asked)) == want
    monkeypatch.setattr(lexical_search, "PASS_TERMS", 4)
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", 50)
    assert rows(lexical_search.search(docs, asked)) == want
    assert rows(lexical_search.search(docs, asked, k=3)) == plain(texts, items, 3)


def test_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "the QUICK fox"), (1, "river"), (None, "Brücke word5"), (2, None)], "item_id long, text string")
    found = rows(lexical_search.search(edge, items))
    by_row = plain([tuple(r) for r in edge.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert found == by_row and {r[0] for r in found} == {1, None}
    assert rows(lexical_search.search(empty, items)) == set()
    assert rows(lexical_search.search(edge, items.where("1 = 0"))) == set()
    assert lexical_search.search(edge, items.where("1 = 0")).columns == ["item_id", "rank", "doc_id", "score"]
    texts = edge.withColumn("doc_id", edge["doc_id"].cast("string")).limit(1)
    assert [r["doc_id"] for r in lexical_search.search(texts, items).collect()] == ["1"]


@pytest.mark.parametrize("n, n_docs, length", [(3, 10, 40), (1 << 30, 1 << 32, 1 << 40)])
def test_impacts_stay_whole(n, n_docs, length):
    import numpy as np

    got = lexical_search.impacts(np.array([5]), np.array([2]), np.array([n]), n_docs, length)
    assert got.tolist() == [5 * (2 * 10**9 // (2000 + 12 * (75 + 25 * n * n_docs // length)))]
