"""Digests against windows ranked one by one; edited texts and neighbours against a sort in the driver."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from rankloom.llm import fingerprints as P


def plain_features(data):
    """Positions of the features of a text, by counting each window anew."""
    n = len(data)
    if n < P.SHORT_TEXT:
        return list(range(max(1, n - P.SHORT_WINDOW + 1))) if n else []
    ranks = []
    for at in range(n - P.WINDOW + 1):
        total = sum(round(c * math.log2(c) * 4096) for c in Counter(data[at : at + P.WINDOW]).values())
        height = 1000 - total * 1000 // round(P.WINDOW * math.log2(P.WINDOW) * 4096)
        ranks.append(P._UNRANKED if height < P.LEAST else 1000 - abs(height - P.COMMON))
    # windows that reach past the text are not ranked, but its runs of rivals go on there
    pad = [P._UNRANKED] * (P.RIVALS - 1)
    wins = Counter()
    for at in range(len(ranks) + P.RIVALS - 1):
        run = [(r, at + k) for k, r in enumerate((pad + ranks + pad)[at : at + P.RIVALS])]
        best = min(run)
        if best[0] < P._UNRANKED:
            wins[best[1] - len(pad)] += 1
    return sorted(p for p, w in wins.items() if w >= P.WINS)


def plain_digest(data):
    at = plain_features(data)
    width = P.WINDOW if len(data) >= P.SHORT_TEXT else P.SHORT_WINDOW
    padded = np.frombuffer(data + b"\0" * 64, np.uint8)
    seen, filters = set(), []
    for p in at:
        h = int(P._hash(padded, np.array([p]), width)[0])
        if h in seen:
            continue
        if len(seen) % P.MOST == 0:
            filters.append(np.zeros(P.FILTER_BITS // 8, np.uint8))
        seen.add(h)
        for k in range(P.HASHES):
            bit = (h >> (11 * k)) & (P.FILTER_BITS - 1)
            filters[-1][bit >> 3] |= 1 << (bit & 7)
    return np.array(filters, np.uint8).reshape(-1, P.FILTER_BITS // 8)


def test_whole_table(docs):
    rows = {r["doc_id"]: r for r in P.fingerprint_documents(docs).collect()}
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert len(rows) == len(texts)
    for (i, text), (_, after) in zip(texts, texts[1:] + texts[:1]):
        half = len(text) // 2
        edited = (text[: len(text) - half] + after[:half]).encode()
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited).hexdigest())
        own, changed, other = P.digests([text.encode(), edited, after.encode()])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (P.shown(own), P.shown(changed))
        assert r["near_edited"] == P.likeness(own, changed) and r["near_next"] == P.likeness(own, other)


def test_ids_that_fill_many_ranges(spark):
    """A third of the rows without an id, an eighth under one id, and one of its texts again and again, over small ranges."""
    rows = [(i, f"document {i} says " + "on and on " * (i % 7)) for i in range(300)]
    rows += [(None, f"nameless {i} " * (1 + i % 5)) for i in range(250)] + [(40, f"same id {i} " * (1 + i % 3)) for i in range(90)] + [(40, "copied text of one id")] * 120 + [(None, None)] * 90
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "text")
    hashed = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()
    order = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["h"], r["text"]) for r in hashed)
    parts = P._ranged(docs, "doc_id", "text", 20).where("tail <> 1").groupBy("part").count().collect()
    assert max(r["count"] for r in parts) < 120
    want = Counter()
    for (i, _, text), (_, _, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        want[(i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest())] += 1
    got = P.fingerprint_documents(docs, range_rows=20).collect()
    assert Counter((-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert P.fingerprint_documents(docs.where("doc_id = 40 AND text LIKE 'copied%'"), range_rows=20).where("near_next = 1").count() == 120


def test_digests_window_by_window(docs):
    texts = [r["text"].encode()[:3000] for r in docs.where("text is not null").limit(25).collect()] + [b"", b"a", b"same " * 200, bytes(range(256)), b"x" * 159, b"short text of words"]
    for text, digest in zip(texts, P.digests(texts)):
        assert np.array_equal(digest, plain_digest(text)), text[:60]


def test_likeness_falls_with_edits(docs):
    rows = P.fingerprint_documents(docs.where("length(text) > 2000")).collect()
    assert np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows]) + 0.2
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_edge_rows(spark, edge, empty):
    rows = P.fingerprint_documents(edge).collect()
    assert len(rows) == edge.count() and P.fingerprint_documents(empty).count() == 0
    alike = {r["fingerprint"] for r in rows if r["doc_id"] == 1}
    assert len(alike) == 1 and all(r["fingerprint"] == "0:" for r in rows if r["doc_id"] in (2, 3))
    with pytest.raises(TypeError):
        P.fingerprint_documents(edge.withColumn("doc_id", edge["doc_id"].cast("string")))
