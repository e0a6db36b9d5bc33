"""Names close to others: by matching blocks at any threshold, and by insertions and deletions at high ones."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from rankloom.operators.tiles import tiled

#: Names of a tile's sides.
WANTED, VALUES = 2048, 4096


def score(query: str, value: str, matcher: SequenceMatcher | None = None) -> float:
    """Of normalised names: containment where one holds the other, the matching-blocks ratio else."""
    n, m = len(query), len(value)
    if not n or not m:
        return 0.0
    if query == value:
        return 1.0
    if query in value:
        return 0.9 + 0.09 * n / m
    if value in query:
        return 0.72 + 0.17 * m / n
    matcher = matcher or SequenceMatcher(None, "", value)
    matcher.set_seq1(query)
    return matcher.ratio()


def common_lengths(wanted: list[str], values: list[str]):
    """For each value: a bound for the common subsequence with every name wanted, exact up to 64 characters.

    The subsequence grows bit by bit over the characters of the value, for all names at once; of longer names the
    letters in common are counted.
    """
    letters = {c: i for i, c in enumerate(sorted({c for x in wanted for c in x}))}
    size = np.array([len(x) for x in wanted], np.int64)
    masks = np.zeros((len(letters) + 1, len(wanted)), np.uint64)
    long = np.flatnonzero(size > 64)
    counts = np.zeros((len(letters) + 1, len(long)), np.int64)
    for i, x in enumerate(wanted):
        if len(x) <= 64:
            for p, c in enumerate(x):
                masks[letters[c], i] |= np.uint64(1 << p)
    for j, i in enumerate(long):
        for c in wanted[i]:
            counts[letters[c], j] += 1
    full = np.array([(1 << min(int(n), 64)) - 1 for n in size], np.uint64)
    for value in values:
        code = [letters[c] for c in value if c in letters]
        free = full.copy()
        for c in code:
            used = free & masks[c]
            free = (free + used) | (free - used)
        common = size - np.bitwise_count(free & full).astype(np.int64)
        if len(long):
            own = np.bincount(code, minlength=len(letters) + 1)
            common[long] = np.minimum(counts, own[:, None]).sum(axis=0)
        yield common


def _scored(least: float):
    def tile(wanted: pa.Table, values: pa.Table) -> pa.Table:
        want, value = wanted.column("want").to_pylist(), values.column("value").to_pylist()
        size, out = np.array([len(x) for x in want], np.int64), ([], [], [])
        for v, common in zip(value, common_lengths(want, value)):
            # matching blocks are a common subsequence, and a name that another holds is one as a whole
            may = np.flatnonzero((2.0 * common >= least * (size + len(v))) | (common >= np.minimum(size, len(v))))
            matcher = SequenceMatcher(None, "", v) if len(may) else None
            for i in may:
                s = score(want[i], v, matcher)
                if s >= least:
                    for column, x in zip(out, (want[i], v, s)):
                        column.append(x)
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], ["want", "value", "s"])

    return tile


def similar(wanted: DataFrame, values: DataFrame, least: float) -> DataFrame:
    """(want, value, s) of distinct names (want) and (value) whose score is at least `least`.

    Blocks of names meet in tiles. The length of the common subsequence, found for a block at once, bounds the ratio
    from above, so only pairs that can reach the threshold are scored in Python.
    """
    return tiled(wanted.where("want <> ''"), values.where("value <> ''"), WANTED, VALUES, _scored(least), "want string, value string, s double")


@F.pandas_udf(DoubleType())
def indel(query: pd.Series, value: pd.Series) -> pd.Series:
    """2 * longest common subsequence over both lengths, in percent."""

    def ratio(a: str, b: str) -> float:
        if not a and not b:
            return 100.0
        masks: dict[str, int] = {}
        for i, c in enumerate(a):
            masks[c] = masks.get(c, 0) | 1 << i
        full = (1 << len(a)) - 1
        s = full
        for c in b:
            u = s & masks.get(c, 0)
            s = ((s + u) | (s - u)) & full
        return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))

    return pd.Series([None if q is None or v is None else ratio(q, v) for q, v in zip(query, value)])


def _segments(name: Column, least: float) -> Column:
    """The name cut into one more piece than edits are possible to a name no longer than it: (text, at), at from 1."""
    n = F.length(name)
    pieces = F.floor(2 * (100 - least) * n / 100 + 1e-9) + 1
    edge = lambda i: F.floor(i * n / pieces)
    cut = lambda i: F.struct(F.substring(name, (edge(i) + 1).cast("int"), (edge(i + 1) - edge(i)).cast("int")).alias("text"), (edge(i) + 1).cast("int").alias("at"))
    return F.transform(F.sequence(F.lit(0).cast("long"), pieces - 1), cut)


def _substrings(name: Column, sizes: list[int]) -> Column:
    """All substrings of these sizes: (text, at)."""

    def of(k: int) -> Column:
        starts = F.when(F.length(name) >= k, F.sequence(F.lit(1), F.greatest(F.length(name) - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.substring(name, i, F.lit(k)).alias("text"), i.alias("at")))

    return F.concat(*map(of, sizes))


#: Letters of the longer name up to which close names meet by length, piece and text; beyond, by text alone.
KEYED = 40


def edits(n: int, m: int, least: float) -> int:
    """Insertions and deletions that names of these lengths can be apart at a ratio of `least` percent."""
    return math.floor((100 - least) * (n + m) / 100 + 1e-9)


def pieces(n: int, least: float) -> list[tuple[int, int]]:
    """(at, size) of the pieces of a name of n letters, one more than there can be edits to a name no longer."""
    count = edits(n, n, least) + 1
    cuts = [i * n // count for i in range(count + 1)]
    return [(low + 1, high - low) for low, high in zip(cuts, cuts[1:])]


def probes(least: float, most: int = KEYED) -> list[tuple[int, int, int, int, int]]:
    """(m, n, piece, there, size): where a name of m letters may hold a piece of a name of n >= m letters.

    Go through the pieces of the longer name and take their number from that of the edits before them. This starts at 0,
    ends below 0 and falls by one at most, by that just at a piece without an edit; so some piece i is whole and has i
    edits before it. It has moved by as many places as these differ in insertions and deletions: by i at most, by an even
    number if i is even and by an odd one if not, and what is left of the edits makes up for the rest of n - m.
    """
    out = []
    for n in range(1, most + 1):
        for m in range(1, n + 1):
            d = edits(n, m, least)
            if n - m > d:
                continue
            for i, (at, size) in enumerate(pieces(n, least)[: d + 1]):
                for moved in range(-i, i + 1, 2):
                    there = at - moved
                    if abs(n - m - moved) <= d - i and there >= 1 and there + size - 1 <= m:
                        out.append((m, n, i, there, size))
    return out


def _keyed(longer: DataFrame, a: str, shorter: DataFrame, b: str, least: float, same: bool) -> DataFrame:
    """(a, b) that share a piece, for longer names of KEYED letters at most; of equal lengths if `same`."""
    spark = longer.sparkSession
    cut = pa.Table.from_pylist([{"n": n, "piece": i, "at": at, "size": size} for n in range(1, KEYED + 1) for i, (at, size) in enumerate(pieces(n, least))])
    seek = pa.Table.from_pylist([dict(zip(("m", "n", "piece", "there", "size"), x)) for x in probes(least) if same or x[0] < x[1]], pa.schema([(c, pa.int64()) for c in ("m", "n", "piece", "there", "size")]))
    # both tables follow from `least` alone and are small
    text = lambda name, at: F.substring(name, F.col(at).cast("int"), F.col("size").cast("int")).alias("text")
    held = longer.join(F.broadcast(spark.createDataFrame(cut)), F.length(a) == F.col("n")).select(a, "n", "piece", text(a, "at"))
    sought = shorter.join(F.broadcast(spark.createDataFrame(seek)), F.length(b) == F.col("m")).select(b, "n", "piece", text(b, "there"))
    return held.join(sought, ["n", "piece", "text"]).select("want", "value").distinct()


def close(wanted: DataFrame, values: DataFrame, least: float = 85.0) -> DataFrame:
    """(want, value, score) of distinct names (want) and (value) whose insertion-deletion ratio is at least `least` percent.

    At a ratio r, names of lengths n >= m differ by (100 - r) (n + m) / 100 insertions and deletions at most. The longer
    one is cut into one piece more than that could be with m = n, so a piece stands whole in the shorter one, near its
    place. Names meet in an equi-join on the longer one's length, the number of the piece and its text; for longer names
    than KEYED, pieces meet substrings by their text, and places are compared then. What meets is scored.
    """
    if not 50 <= least < 100:
        raise ValueError("least must be 50 or more and below 100")
    # a name of n letters has floor(n * share) + 1 pieces, so their sizes lie between the smallest and 1 / share
    share = 2 * (100 - least) / 100
    sizes = list(range(max(1, math.floor((KEYED + 1) / ((KEYED + 1) * share + 1) - 1e-9)), math.ceil(1 / share + 1e-9) + 1))

    def meet(longer: DataFrame, a: str, shorter: DataFrame, b: str) -> DataFrame:
        n, m = F.length(a), F.length(b)
        cut = longer.where(n > KEYED).select(a, F.explode(_segments(F.col(a), least)).alias("x")).select(a, "x.text", F.col("x.at").alias("at"))
        inside = shorter.where(200.0 * m / (m + KEYED + 1) >= least - 1e-9).select(b, F.explode(_substrings(F.col(b), sizes)).alias("y")).select(b, "y.text", F.col("y.at").alias("there"))
        allowed = (100 - least) * (n + m) / 100 + 1e-9
        fits = (n >= m) & (200.0 * m / (n + m) >= least - 1e-9) & (F.abs(F.col("at") - F.col("there")) <= allowed)
        return cut.join(inside, "text").where(fits).select("want", "value").distinct()

    wanted, values = wanted.where("want <> ''"), values.where("value <> ''")
    keyed = _keyed(wanted, "want", values, "value", least, True).union(_keyed(values, "value", wanted, "want", least, False))
    pairs = keyed.union(meet(wanted, "want", values, "value").union(meet(values, "value", wanted, "want")).distinct())
    return pairs.withColumn("score", indel(F.col("want"), F.col("value"))).where(F.col("score") >= least)
