"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Component by position: smallest position reachable over links of 3 bits at most."""
    keys = np.array(fps, np.uint64)
    parent = list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(keys ^ keys[i]) <= 3):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(keys))]


def check(rows, texts):
    """rows: (doc_id, fingerprint, component_id); texts by id."""
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    wanted = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, plain_components(fps))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == wanted


def test_whole_table(docs):
    check(simhash.near_duplicates(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


@pytest.mark.parametrize("hot", [4096, 8])
def test_links_of_clustered_fingerprints(spark, hot):
    """Fingerprints around few centres, with a hot tile dealt out again at 8 rows; components must be the same."""
    rng = random.Random(hot)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(f,) for f in signed], "fp long").withColumn("plane", F.lit(0))
    groups = {r["node"]: r["component"] for r in simhash.components(simhash.links(rows, hot)).collect()}
    classes = {}
    for f, c in zip(signed, plain_components(fps)):
        classes.setdefault(c, set()).add(f)
    found = {}
    for f in signed:
        found.setdefault(groups.get(f, f), set()).add(f)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, classes.values()))


def test_edge_rows(edge, empty):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[2]["fingerprint"] == by_id[3]["fingerprint"] == by_id[4]["fingerprint"] == "0" * 16 and by_id[4]["component_id"] == 2
    assert by_id[1]["component_id"] == by_id[6]["component_id"] == 1
    assert by_id[8]["fingerprint"] == f"{xxhash.xxh64_intdigest(b'one two', 42):016x}"
    assert simhash.near_duplicates(empty).count() == 0


def test_pipeline_stage_keeps_one_of_each_group(spark, edge, empty):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    near = list(base)
    for at in rng.sample(range(300), 3):
        near[at] = "x"
    other = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(1, " ".join(other)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(base)), (5, ""), (6, None), (7, "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 5, 7}  # 5 and 6 are equal: no text
    out = simhash.one_of_each_group(edge)
    assert out.columns == edge.columns and simhash.one_of_each_group(empty).count() == 0
    assert {r["doc_id"] for r in out.collect()} >= {1, 5, 7, 8, 9, None}
