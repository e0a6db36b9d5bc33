"""Rejection by margins: texts of no learned language and mixtures go, clean held-out texts stay."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.llm import language_id

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    content = language_id.fit(docs)
    rows = docs.where(language_id.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 1000)).select("lang", "text").collect()
    return content, [(r["lang"], r["text"]) for r in rows]


def rejected(content, texts):
    classify = language_id.Classifier(content)
    return [classify(t)[3] for t in texts]


def test_clean_held_out_texts_stay(learned):
    content, held = learned
    classify = language_id.Classifier(content)
    found = [classify(t) for _, t in held]
    right = [f for f, (lang, _) in zip(found, held) if f[0] == lang]
    assert len(right) >= 0.95 * len(held) and sum(f[3] for f in right) <= 0.02 * len(held)


def test_gibberish_goes(learned):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 10))) for _ in range(n)) for n in (3, 40, 200, 2000) for _ in range(20)]
    assert sum(rejected(learned[0], texts)) >= 0.95 * len(texts)
    alone = dict([next(iter(learned[0].items()))])
    assert sum(rejected(alone, texts)) >= 0.95 * len(texts)


def test_unlearned_languages_go(learned):
    content, held = learned
    gone = [x for g in content for x in rejected({k: v for k, v in content.items() if k != g}, [t for lang, t in held if lang == g])]
    assert sum(gone) >= 0.9 * len(gone)


def test_half_and_half_goes(learned):
    content, held = learned
    rng, texts = random.Random(2), []
    while len(texts) < 60:
        (g, a), (h, b) = rng.sample(held, 2)
        k = min(len(a), len(b), 8000)
        if g != h:
            texts.append(a[:k] + " " + b[:k])
    assert sum(rejected(content, texts)) >= 0.8 * len(texts)


def test_table_marks_what_the_pipeline_drops(spark, learned):
    content, held = learned
    docs = spark.createDataFrame([(0, held[0][1], "x"), (1, None, "x"), (2, "qzx wvk jjq", "x")], "doc_id long, text string, lang string")
    marked = {r["doc_id"]: r["rejected"] for r in language_id.identify(docs, content).collect()}
    assert marked == {0: False, 1: True, 2: True}
    assert [r["doc_id"] for r in language_id.keep_identified(docs, content).collect()] == [0]


def test_whole_table_against_plain_compression(spark, sf_dir, learned):
    """Sizes, winner and score of every text by one call of the compressor after another."""
    content, _ = learned
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r["doc_id"]: r for r in language_id.identify(docs, content).collect()}
    classify = language_id.Classifier(content)
    rows = docs.collect()
    assert len(found) == len(rows)
    for row in rows:
        data, r = language_id.folded(row["text"]), found[row["doc_id"]]
        if not data:
            assert (r["lang_pred"], r["score"]) == (language_id.UNKNOWN, 0.0)
            continue
        sizes = {g: sum(len(c.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)) for g, c in zip(classify.langs, classify.first)}
        least = min(sizes.values())
        assert sizes[r["lang_pred"]] == least and r["score"] == pytest.approx(1 / sum(2.0 ** -min(60, s - least) for s in sizes.values()))


def test_many_languages_and_an_id_on_many_rows(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for g in range(300):
        own = ["".join(rng.choices(letters, k=6)) for _ in range(40)]
        rows += [(g * 10 + k, " ".join(rng.choices(own, k=60)), f"l{g:03}") for k in range(4)]
    rows += [(0, f"copy {i} of one id", "l000") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = language_id.fit(docs)
    assert len(content) >= 295 and language_id.identify(docs.limit(20), content).count() == 20


def test_edge_rows(edge, empty):
    content = language_id.fit(edge)
    rows = language_id.identify(edge, content).collect()
    assert len(rows) == edge.count() and all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (2, 3, 4))
    assert language_id.keep_identified(edge, content).columns == edge.columns
    assert language_id.fit(empty) == {} and language_id.identify(empty, {}).count() == 0 and language_id.keep_identified(empty, {}).count() == 0
