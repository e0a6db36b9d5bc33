"""Passages of the benchmark against a comparison of every item with every offset of every document."""

import random
import re
import time

import pytest

from rankloom.llm import decontamination as D


def toks(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, similarity=0.8, stretch=20):
    """{(doc, item): (start, matched, compared, similarity)} by trying every offset."""
    out = {}
    known = [(i, toks(t)) for i, t in items]
    for doc, text in docs:
        t = toks(text)
        where = {}
        for p, w in enumerate(t):
            where.setdefault(w, []).append(p)
        for item, x in known:
            if not x:
                continue
            width, same = min(stretch, len(x)), {}
            for q, w in enumerate(x):
                for p in where.get(w, ()):
                    same.setdefault(p - q, []).append(q)
            for start, agree in same.items():
                if len(agree) < width * similarity - 1e-9:
                    continue
                best, flags = 0, [0] * len(x)
                for q in agree:
                    flags[q] = 1
                best = max(sum(flags[s : s + width]) for s in range(len(x) - width + 1))
                if best / width >= similarity:
                    inside = min(len(t), start + len(x)) - max(0, start)
                    key = (best / width, len(agree), -start)
                    if (doc, item) not in out or key > out[doc, item][0]:
                        out[doc, item] = (key, (start, len(agree), inside, round(best / width, 9)))
    return {k: v for k, (_, v) in out.items()}


def rows_of(df):
    return {(r["doc_id"], r["item_id"]): (r["start_token"], r["matched"], r["compared"], round(r["similarity"], 9)) for r in df.collect()}


def test_whole_table(spark, docs, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    wanted = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert wanted and rows_of(D.contaminated(docs, bench)) == wanted
    assert rows_of(D.contaminated(docs, bench, block_seeds=100)) == wanted  # in many blocks of seeds
    gone = {d for d, _ in wanted}
    assert {r["doc_id"] for r in D.clean_documents(docs, bench).collect()} == {r["doc_id"] for r in docs.collect()} - gone


def test_nothing_at_the_threshold_is_lost(spark):
    """Items of 1 to 60 tokens with a fifth of their tokens (or of a stretch of 20) replaced, in texts of other words."""
    rng = random.Random(4)
    word = lambda k: f"{k}{rng.randrange(10**9)}"
    items, docs = [], []
    for n in list(range(1, 61)) * 5:
        item = [word("i") for _ in range(n)]
        width = min(20, n)
        at = rng.randrange(n - width + 1)
        found = item[at : at + width]
        gone = rng.sample(range(width), width // 5) if n % 2 else list(range(width))[4::5][: width // 5]
        for g in gone:
            found[g] = word("x")
        items.append((len(items), " ".join(item)))
        docs.append((len(docs), " ".join([word("d") for _ in range(30)] + found + [word("d") for _ in range(30)])))
    found = rows_of(D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert {k for k, _ in found} == set(range(len(docs))) and all(a == b for a, b in found)


def test_one_replaced_token_too_many_is_no_match(spark):
    rng = random.Random(5)
    item = [f"i{rng.randrange(10**9)}" for _ in range(20)]
    for k in (1, 6, 11, 16, 19):
        item[k] = item[k] + "y"
    text = [w[:-1] if w.endswith("y") else w for w in item]
    found = D.contaminated(spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert found.count() == 0


def test_equal_words(spark):
    """Texts and items of one word, or two in turn, again and again."""
    docs = [(1, "same " * 40), (2, "a b " * 25), (3, "same other " * 10), (4, "same"), (5, "b a " * 6)]
    items = [(1, "same " * 30), (2, "a b " * 15), (3, "same"), (4, "b " * 5)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(D.contaminated(*frames)) == brute(docs, items)
    long = spark.createDataFrame([(1, "word " * 5000)], "doc_id long, text string")
    began = time.time()
    assert rows_of(D.contaminated(long, long.withColumnRenamed("doc_id", "item_id"))) == {(1, 1): (0, 5000, 5000, 1.0)}
    assert time.time() - began < 90


@pytest.mark.parametrize("n", range(5, 21))
def test_masks_leave_a_seed(n):
    width, replaced = min(n, 20), n // 5
    import itertools

    for gone in itertools.combinations(range(width), replaced):
        assert any(all(s + k not in gone for k, b in enumerate(m) if b == "1") for m in D.masks_for(n) for s in range(width - len(m) + 1))


def test_edge_rows(spark, edge, empty):
    items = [(1, "the quick BROWN fox, jumps over the lazy dog near the river"), (1, "the quick BROWN fox, jumps over the lazy dog near the river"), (2, None), (3, "..."), (None, "Brücke"), (4, "word")]
    bench = spark.createDataFrame([(*i, None) for i in items], "item_id long, text string, seed string")
    found = D.contaminated(edge, bench)
    wanted = brute([(r["doc_id"], r["text"]) for r in edge.collect()], items)
    assert rows_of(found) == wanted and found.count() == len(wanted)
    kept = D.clean_documents(edge, bench)
    assert kept.columns == edge.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["2", "3", "4", "5", "None", "7", "8"])
    assert D.contaminated(empty, bench).count() == 0 and D.contaminated(edge, bench.where("1 = 0")).count() == 0 and D.clean_documents(edge, bench.where("1 = 0")).count() == edge.count()
