"""Joins of close names against every pair compared by plain code."""

import random
from difflib import SequenceMatcher

import pytest

from rankloom.operators import near


def made_up(n: int, seed: int) -> list[str]:
    """Names of syllables, half of them small changes of others."""
    rng = random.Random(seed)
    syllables = "ka lo mi ter an bru shen do ri va el no star ing con ple x y the a of wood".split()
    names = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 4))) for _ in range(n // 2)]
    for name in list(names):
        letters = list(name)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "e", "ou"])
        names.append("".join(letters).strip() or "z")
    long = "the quick brown fox and a lazy dog who sleeps on"  # around and beyond the length up to which pieces have keys
    names += [long[:k] + "y" * (k % 3) + long[k + k % 4 :] for k in range(3, 48, 2)] + [long[:n] for n in range(34, 49)]
    return sorted({*names, "a", "ab", "x" * 70, "x" * 69 + "y", "café noir", "cafe noir"})


def plain_indel(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return 200.0 * row[-1] / (len(a) + len(b))


@pytest.fixture(scope="module")
def names():
    return made_up(300, 1), made_up(260, 2) + made_up(300, 1)[::7]


def frames(spark, names):
    return spark.createDataFrame([(x,) for x in names[0]], "want string"), spark.createDataFrame([(x,) for x in sorted(set(names[1]))], "value string")


@pytest.mark.parametrize("least", [0.42, 0.38, 0.8])
def test_similar_is_every_pair_that_reaches_the_threshold(spark, names, least, monkeypatch):
    monkeypatch.setattr(near, "WANTED", 60)
    found = {(r["want"], r["value"]): r["s"] for r in near.similar(*frames(spark, names), least).collect()}

    def plain(q, v):
        if q == v:
            return 1.0
        if q in v:
            return 0.9 + 0.09 * len(q) / len(v)
        return 0.72 + 0.17 * len(v) / len(q) if v in q else SequenceMatcher(None, q, v).ratio()

    wanted = {(q, v): s for q in names[0] for v in set(names[1]) if (s := plain(q, v)) >= least}
    assert found == pytest.approx(wanted) and len(wanted) > 100


def test_few_pairs_are_scored(monkeypatch):
    import pyarrow as pa

    scored, plain = [], near.score
    monkeypatch.setattr(near, "score", lambda q, v, m=None: scored.append(1) or plain(q, v, m))
    rng = random.Random(5)
    some = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=rng.randint(8, 24))) for _ in range(2000)]
    near._scored(0.42)(pa.table({"want": some[:1000]}), pa.table({"value": some[1000:]}))
    assert len(scored) < 100_000  # a tenth of all pairs


def test_common_lengths_are_exact_and_a_bound_for_long_names(names):
    rows = list(near.common_lengths(names[0], names[1]))
    for v, common in zip(names[1], rows):
        for q, c in zip(names[0], common):
            exact = round(plain_indel(q, v) * (len(q) + len(v)) / 200)
            assert c == exact if len(q) <= 64 else c >= exact


@pytest.mark.parametrize("least", [85.0, 70.0, 95.0, 51.5])
def test_close_is_every_pair_that_reaches_the_threshold(spark, names, least):
    found = {(r["want"], r["value"]): r["score"] for r in near.close(*frames(spark, names), least).collect()}
    wanted = {(q, v): s for q in names[0] for v in set(names[1]) if (s := plain_indel(q, v)) >= least}
    assert found == pytest.approx(wanted) and len(wanted) > 20


def test_few_names_meet(spark):
    """Names of two syllables out of forty share pieces all the time, but seldom at the same place of the same length."""
    rng = random.Random(7)
    syllables = [a + b for a in "bdfgklmn" for b in ("an", "el", "ing", "or", "u")]
    some = sorted({"".join(rng.choices(syllables, k=rng.randint(3, 6))) for _ in range(2000)})
    wanted = spark.createDataFrame([(x,) for x in some[::2]], "want string")
    values = spark.createDataFrame([(x,) for x in some[1::2]], "value string")
    met = near._keyed(wanted, "want", values, "value", 85.0, True).count() + near._keyed(values, "value", wanted, "want", 85.0, False).count()
    assert met < len(some) ** 2 / 4 * 0.2
    assert all(p[0] <= p[1] and p[3] >= 1 and p[3] + p[4] - 1 <= p[0] for p in near.probes(85.0))
    for least in (40, 100):
        with pytest.raises(ValueError):
            near.close(wanted, values, least)


def test_nothing_meets_nothing(spark, names):
    wanted, values = frames(spark, names)
    assert near.similar(wanted.where("1 = 0"), values, 0.42).isEmpty() and near.close(wanted, values.where("1 = 0")).isEmpty()
