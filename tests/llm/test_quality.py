"""The classifier against a plain reading of its features and a plain training, and its accuracy on held-out rows."""

import math
import zlib

import numpy as np
import pytest

from rankloom.llm import quality as Q

U = 0xFFFFFFFF


def plain_features(text):
    """{feature: times} with the hashes written out for one word after another."""
    words = [w for w in (text or "").encode().replace(b"\x0b", b" ").split()]
    out = {0: 1}
    for at_word, word in enumerate(words):
        shown = b"<" + word + b">"
        seen = 0xB5297A4D if word in words[:at_word] else 0
        whole = sum(b * pow(0x01000193, k + 1, 1 << 32) for k, b in enumerate(shown)) * 0x9E3779B1 & U
        found = [whole]
        for n in Q.NGRAMS:
            for at in range(len(shown) - n + 1):
                h = n * 0x3C6EF372 & U
                for b in shown[at : at + n]:
                    h = (h ^ b) * 0x01000193 & U
                found.append(h)
        for h in found:
            h ^= seen
            h = (h ^ h >> 15) * 0x85EBCA6B & U
            f = (h >> 8) % (Q.BUCKETS - 1) + 1
            out[f] = out.get(f, 0) + 1
    return out


TEXTS = ["the cat sat on the mat", "buy buy buy now", "", "Ünïcödé ☃ text", "a", "one\ttwo\nthree  four", "x" * 300, "word word other word"]


def test_features():
    for text, (ids, share) in zip(TEXTS, Q.bags(TEXTS)):
        plain = plain_features(text)
        total = sum(plain.values())
        assert dict(zip(ids.tolist(), share.tolist())) == pytest.approx({f: n / total for f, n in plain.items()})


def test_words_that_occurred_before_in_their_own_text():
    index, counts = np.array([0, 1, 0, 0, 2, 1, 1]), np.array([3, 0, 2, 2])
    assert Q.later(index, counts).tolist() == [0, 0, 1, 0, 0, 0, 1]
    assert Q.later(np.zeros(0, np.int64), np.zeros(2, np.int64)).tolist() == []


def test_repetition_is_learned_wherever_it_stands(spark):
    """Texts of the same words: one label's words come again later, never side by side; other words are judged alike."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))

    def text(label):
        words = [word() for _ in range(30 if label else 10)]
        return " ".join(words if label else words * 3)

    labels = [i % 2 for i in range(600)]
    texts = [text(y) for y in labels]
    weights = Q.train(texts[:400], labels[:400])
    rest = spark.createDataFrame(list(enumerate(texts))[400:], "doc_id long, text string")
    right = [(r["score"] > 0.5) == labels[r["doc_id"]] for r in Q.score(rest, weights).collect()]
    assert sum(right) / len(right) > 0.95


def test_training_step_by_step(monkeypatch):
    """The same gradient steps with loops over dimensions and features, in the same order."""
    monkeypatch.setattr(Q, "BUCKETS", 512)
    settings = Q.Settings(dim=3, epochs=2)
    labels = [1, 0, 0, 1, 1, 1, 0, 0]
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1 / 3, 1 / 3, (512, 3)).tolist()
    layer, docs, done = [[0.0] * 3, [0.0] * 3], [plain_features(t) for t in TEXTS], 0
    for _ in range(2):
        for i in rng.permutation(len(docs)):
            total, rate = sum(docs[i].values()), settings.rate * (1 - done / 16)
            done += 1
            mean = [sum(n / total * vectors[f][k] for f, n in docs[i].items()) for k in range(3)]
            out = [sum(layer[c][k] * mean[k] for k in range(3)) for c in (0, 1)]
            top = [math.exp(x - max(out)) for x in out]
            p = [x / sum(top) - (labels[i] == c) for c, x in enumerate(top)]
            back = [sum(p[c] * layer[c][k] for c in (0, 1)) for k in range(3)]
            for c in (0, 1):
                for k in range(3):
                    layer[c][k] -= rate * p[c] * mean[k]
            for f, n in docs[i].items():
                for k in range(3):
                    vectors[f][k] -= rate * min(1.0, n / total * len(docs[i])) * back[k]
    wanted = [sum(v[k] * (layer[1][k] - layer[0][k]) for k in range(3)) for v in vectors]
    assert np.allclose(Q.train(TEXTS, labels, settings), wanted)


@pytest.fixture(scope="module")
def large(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, Q.fit(docs, labels)


def test_whole_table_against_plain_scores(large):
    docs, _, weights = large
    rows = {r["doc_id"]: r for r in Q.score(docs, weights).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(rows) == set(texts)
    for i, text in list(texts.items()):
        r = rows[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7)
        if len(text or "") < 2000:  # the plain loop takes seconds on the longest
            plain = plain_features(text)
            mean = sum(n * weights[f] for f, n in plain.items()) / sum(plain.values())
            assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-50, min(50, mean)))))


def test_held_out_accuracy(large):
    docs, labels, weights = large
    rows = Q.score(docs, weights).where("held_out").join(labels.where("quality is not null"), "doc_id").collect()
    assert len(rows) > 50 and sum((r["score"] >= 0.5) == r["quality"] for r in rows) / len(rows) > 0.95


def test_labels_of_held_out_rows_are_not_learned(spark, large):
    from pyspark.sql import functions as F

    docs, labels, weights = large
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(Q.fit(docs, turned), weights)


def test_a_text_that_does_not_fit_is_skipped(spark, monkeypatch):
    """The first text in hash order is longer than the whole sample may be."""
    from pyspark.sql import functions as F

    ids = spark.range(200).select(F.col("id").alias("doc_id")).where(~Q.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(50)
    first = ids.first()["doc_id"]
    good = F.when(F.col("doc_id") % 2 == 0, "good fine text here").otherwise("bad bad junk junk")
    docs = ids.select("doc_id", F.when(F.col("doc_id") == first, F.repeat(F.lit("long word "), 1_700_000)).otherwise(good).alias("text"))
    labels = ids.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    weights = Q.fit(docs, labels, Q.Settings(epochs=40))
    scores = {r["doc_id"]: r["score"] for r in Q.score(docs.where(F.col("doc_id") != first), weights).collect()}
    assert all((s > 0.5) == (i % 2 == 0) for i, s in scores.items())


def test_edge_rows(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (5, None), (None, 1), (6, 0), (99, 1)], "doc_id long, quality int")
    weights = Q.fit(edge, labels)
    rows = Q.score(edge, weights).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    bare = {r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}
    assert len(bare) == 1  # null, empty and blank texts alike
    none = Q.fit(empty, labels.where("1 = 0"))
    assert Q.score(empty, none).count() == 0 and {r["score"] for r in Q.score(edge, none).collect()} == {0.5}
