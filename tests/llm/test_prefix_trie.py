import hashlib
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from compare import assert_same

from rankloom.llm import prefix_trie, queries

NAMES = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def plain(rows: list[tuple]) -> set[tuple]:
    """The trie by plain loops; turns in the order given where turn is equal."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for node in nodes:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(nodes, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(nodes[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    sha = lambda node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
    return {(min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], sha(n)) for n, m in nodes.items()}


def rows(df):
    found = [tuple(r) for r in df.select(*NAMES).collect()]
    assert len(set(found)) == len(found)
    return set(found)


def frame(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)


def test_query_against_sql_and_plain_loops(spark, sf_dir):
    found = queries.op13_prefix_trie(spark, sf_dir)
    assert_same(found, queries.oracle_sql()["op13_prefix_trie"], sf_dir)
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert rows(found) == plain([tuple(r) for r in talks.collect()])


def test_many_branches_a_long_talk_and_a_hot_one(spark):
    import random

    rng = random.Random(3)
    data = []
    for c in range(400):
        if c % 3 == 0:
            data += [(c, t, "user", f"same words {t}") for t in range(9)]  # a third of all talks are one
        else:
            data += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "a b", "c d e"])) for t in range(rng.randint(1, 7))]
    data += [(5000, t, "user", f"turn {t % 10}") for t in range(3000)]  # one talk holds a third of all rows
    data += [(20000 + k, t, "user", f"stair {t}") for k in range(0, 600, 20) for t in range(30 - k // 20)] + [(20000 + k, 99, "user", f"end {k}") for k in range(0, 600, 20)]
    assert rows(prefix_trie.trie(frame(spark, data))) == plain(data)


def test_pieces_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    data = [(c, t, "user", f"{t}") for c in range(100) for t in range(3)]
    assert rows(prefix_trie.trie(frame(spark, data))) == plain(data)


def test_edges(spark):
    data = [
        (0, None, None, None), (0, 1, "user", "b"), (0, 2, "user", "c c"), (0, 3, "user", ""), (1, 5, None, "x"), (2, None, "user", None), (2, 0, "", "long " * 20_000),
        (None, 1, "user", "nobody"), (20, 1, "user", "q"), (39, 1, "user", "r"), (45, 1, "user", "no base"), (-7, 1, "user", "below zero"), (-21, 2, "user", "x"), (61, 1, "user", "one"), (63, 1, "user", "one"),
    ]
    signed = [r for r in data if r[0] is None or r[0] >= 0]
    assert rows(prefix_trie.trie(frame(spark, signed))) == plain(signed)
    below = rows(prefix_trie.trie(frame(spark, data)))
    assert max(r[3] for r in below) == 10 and min(r[0] for r in below) == -21
    repeated = signed + [(0, 1, "user", "b"), (61, 1, "user", "one"), (61, 1, "user", "one")]
    assert rows(prefix_trie.trie(frame(spark, repeated))) == plain(repeated)
    none = prefix_trie.trie(frame(spark, data).where("1 = 0"))
    assert rows(none) == set() and none.columns == NAMES
    assert rows(prefix_trie.trie(frame(spark, [(None, 1, "user", "nobody")]))) == set()
    clashing = frame(spark, signed).selectExpr("*", "1 as depth", "'x' as path", "2 as pos", "'q' as words", "0 as x1", "1 as h", "1 as `range`", "true as tail")
    assert rows(prefix_trie.trie(clashing)) == plain(signed)


def test_equal_turns_have_one_order(spark):
    data = [(c, 1, "user", w) for c in (0, 100, 200) for w in "abc"]
    order = lambda d: sorted(d, key=lambda r: xxh(r))
    xxh = lambda r: (x := xxhash.xxh64_intdigest(r[3].encode(), xxhash.xxh64_intdigest(b"user", 42))) - ((x >> 63) << 64)
    assert rows(prefix_trie.trie(frame(spark, data))) == plain(order(data))


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_running_over_ranges(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        data = [(k, i, i * 7 + k) for k, n in ((1, 500), (2, 1), (3, 40), (-4, 90)) for i in range(n)]
        df = spark.createDataFrame(data, "k long, i long, v long").selectExpr("k", "i", "v as total", "v as x")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {(r["k"], r["i"]): (r["total"], r["x"]) for r in prefix_trie.running(df, ["k"], ["i"], ["total", "x"], ("x",)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, x = defaultdict(int), defaultdict(int)
    for k, i, v in data:
        total[k] += v
        x[k] ^= v
        assert got[k, i] == (total[k], x[k])
