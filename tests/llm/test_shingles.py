"""Near-copies with a contiguous edit share a group, as brute force over five-word shingles finds them."""

import random

import xxhash
from pyspark.sql import functions as F

from rankloom.llm import shingles, simhash


def plain_set(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(plain_set(a) & plain_set(b)) / len(plain_set(a) | plain_set(b))


def edited(rng, words, how):
    n = len(words)
    new = [f"n{rng.randrange(10**6)}" for _ in range(n // 10)]
    if how == "appended":
        return words + new
    if how == "cut":
        return words[: n - n // 10]
    at = rng.randrange(n - n // 13)
    return words[:at] + new[: n // 13] + words[at + n // 13 :]


def test_contiguous_edits_are_found(spark):
    rng = random.Random(5)
    rows, pairs = [], []
    for how in ("appended", "cut", "block"):
        for _ in range(40):
            words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(100, 600))]
            a, b = " ".join(words), " ".join(edited(rng, words, how))
            assert similarity(a, b) >= 0.8, how
            pairs.append((len(rows), len(rows) + 1, how))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [p for p in pairs if found[p[0]] != found[p[1]]] == []
    assert len(set(found.values())) == len(pairs)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(6):
        words = [f"w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = [shingles.shingle_set(t.encode().split()) for t in texts]
    same = [xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 for s in sets]
    rows = [(i, i, [int(k) for k in shingles.band_keys(s).view("<i8")], len(s), shingles.packed(s)) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "uid long, signature long, bands array<long>, size int, shingles binary")
    members = frame.where(F.col("uid").isin([same.index(x) for x in set(same)])).select("uid", "size", F.explode("bands").alias("bucket"))

    def connected(links):
        root = list(range(len(texts)))
        for a, b in links:
            ra, rb = root[a], root[b]
            root = [ra if r == rb else r for r in root]
        return {tuple(i for i, r in enumerate(root) if r == x) for x in root}

    want = connected([(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i], texts[j]) >= 0.8] + [(i, same.index(s)) for i, s in enumerate(same)])
    for block in (shingles.BLOCK, 300):  # 300: buckets of three texts and more are dealt out as pairs of blocks
        got = [(r["a"], r["b"]) for r in shingles.links(frame, members, block).collect()]
        assert all(similarity(texts[a], texts[b]) >= 0.8 for a, b in got)
        assert connected(got + [(i, same.index(s)) for i, s in enumerate(same)]) == want


def plain_groups(rows):
    """{(id, text): smallest id of the group} of texts that chains of similarity 0.8 connect; ids may be null."""
    words = [[w for w in (x.strip(".,;:") for x in (t or "").lower().split()) if w] for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {("", t or "")} for (_, t), w in zip(rows, words)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None and (r not in least or i < least[r]):
            least[r] = i
    return [least.get(r) for r in root], root


def test_whole_table(docs):
    """The groups of the pipeline's stage against every pair of texts; one row of each stays."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wanted, root = plain_groups(rows)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert found == {i: w for (i, _), w in zip(rows, wanted)}
    kept = [r["doc_id"] for r in simhash.one_of_each_group(docs).collect()]
    assert sorted(kept) == sorted(set(wanted)) and len(kept) == len(set(root)) < len(rows)


def test_nulls_and_repeats(spark):
    """Exactly one row of each group: null ids, rows that repeat, and one id on several texts."""
    rng = random.Random(9)
    a, b, c = (" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(3))
    rows = [(None, a), (None, a), (7, a), (None, b), (None, b), (3, c), (3, c), (3, c), (3, a), (9, "other words here"), (None, None), (None, ""), (12, "."), (13, " ")]
    docs = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, text string, kept string, n string")
    out = simhash.one_of_each_group(docs)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect()) == sorted([("3", a), ("None", b), ("3", c), ("9", "other words here"), ("None", ""), ("12", "."), ("13", " ")])
