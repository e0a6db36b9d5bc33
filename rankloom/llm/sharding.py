"""Uniform shuffling into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in P logical partitions. How many rows of each partition go to each shard is drawn first, from the
multivariate hypergeometric law that a uniform permutation of all rows would give, with every shard's size exact. Then
rows are permuted within their partition and cut into runs of the drawn lengths, exchanged, and permuted again within
their shard. Every order of rows is equally likely up to the hash that stands for chance, and reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from rankloom.llm.common import power_of_two, small_table, staged

#: Rows that a partition or a cell of a shard should hold; bits of their numbers at most.
ROWS, MOST_BITS = 40_000, 16


#: Population up to which numpy draws its hypergeometric law.
LARGEST = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int, largest: int = LARGEST) -> int:
    """How many of `drawn` from good + bad are good, by the hypergeometric law, whatever the population: numpy's sampler
    up to `largest`, and rejection from the same law beyond."""
    if good == 0 or drawn == 0:
        return 0
    if bad == 0:
        return drawn
    if drawn > (good + bad) // 2:  # what stays behind is drawn instead
        return good - hypergeometric(rng, good, bad, good + bad - drawn, largest)
    if good + bad < largest:
        return int(rng.hypergeometric(good, bad, drawn))
    return _by_rejection(rng, good, bad, drawn)


def _by_rejection(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """A draw by ratio of uniforms: points under the square root of the law's weights, which are exact to 1e-9."""
    total = good + bad
    low, high = max(0, drawn - bad), min(drawn, good)
    share = good / total
    mean = drawn * share
    deviation = math.sqrt(max(mean * (1 - share) * (total - drawn) / max(1, total - 1), 0.25))
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))

    def weight(k: int) -> float:
        """log of P(k) / P(mode)."""
        return sum(_log_choose_ratio(n, k_mode, k_new) for n, k_mode, k_new in ((good, mode, k), (bad, drawn - mode, drawn - k)))

    # the box that holds all points: v / u times the square root of the weight stays within it for the law's deviation
    width = 2 * (math.sqrt(2 / math.e) * (deviation + 0.5) + 1.5)
    while True:
        u, v = rng.random(), rng.random() - 0.5
        if u == 0.0:
            continue
        k = math.floor(mean + 0.5 + width * v / u)
        if low <= k <= high and 2 * math.log(u) <= weight(k):
            return int(k)


def _log_choose_ratio(n: int, before: int, after: int) -> float:
    """log of C(n, after) / C(n, before) without the loss of digits of two large logarithms."""
    step = after - before
    if step == 0:
        return 0.0
    if abs(step) <= 64:
        if step > 0:
            return sum(math.log((n - before - i) / (before + i + 1)) for i in range(step))
        return -sum(math.log((n - after - i) / (after + i + 1)) for i in range(-step))
    return _log_factorial_step(before, after) + _log_factorial_step(n - before, n - after)


def _log_factorial_step(before: int, after: int) -> float:
    """log(before! / after!) by Stirling's series of the difference."""
    if min(before, after) < 64:
        return math.lgamma(before + 1) - math.lgamma(after + 1)
    d = before - after
    # x ln x - x, with x = after + d: d ln(after) + before * ln(1 + d / after) - d, and the series' first corrections
    main = d * math.log(after) + before * math.log1p(d / after) - d
    return main + 0.5 * math.log1p(d / after) + (1 / before - 1 / after) / 12 - (1 / before**3 - 1 / after**3) / 360


def communication_matrix(counts: list[int], sizes: list[int], seed: int, largest: int = LARGEST) -> np.ndarray:
    """Rows of each partition for each shard: partition sums are `counts`, shard sums are `sizes`, both exact.

    Shards are split off one after the other: each takes from a partition a hypergeometric part of what is left.
    """
    rng = np.random.default_rng(seed)
    left = np.array(sizes, dtype=np.int64)
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for p, n in enumerate(counts):
        rest = int(n)
        for s in range(len(sizes)):
            good, bad = int(left[s]), int(left[s + 1 :].sum())
            low, high = max(0, rest - bad), min(rest, good)
            take = low if low == high else hypergeometric(rng, good, bad, rest, largest)
            out[p, s] = take
            rest -= take
        left -= out[p]
    return out


def shard(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", rows_per_part: int = ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, under the law `rows`.

    Shards hold counts at most one apart, the first shards the larger; slots are gapless from 0 in each shard.
    size is the UTF-8 bytes of the text plus 1; a null text has size 1 and the checksum 0 of empty text. Rows equal in
    id, size and checksum are counted before any shuffle and told apart by a number, so repeated rows spread like
    others, and null ids spread by their text. Only ids, sizes and checksums are shuffled. What goes through the driver
    is one number for each partition and shard, and 2^16 partitions at most.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    named = ("doc_id", "size", "text_crc32", "copy")
    chance = lambda k: F.xxhash64(F.lit(seed), F.lit(k), *named)
    bits = power_of_two(docs.count() / rows_per_part, MOST_BITS)
    rows = staged(rows.withColumn("part", F.pmod(chance(0), F.lit(1 << bits)).cast("int")), "rows")
    counts = dict(rows.groupBy("part").count().collect())
    parts = sorted(counts)
    total = sum(counts.values())
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    ends = communication_matrix([counts[p] for p in parts], sizes, seed).cumsum(axis=1)
    matrix = staged(small_table(spark, [{"part": p, "ends": e.tolist()} for p, e in zip(parts, ends)], "part: int, ends: array<bigint>"), "matrix")
    # permute within partitions and cut
    place = F.row_number().over(Window.partitionBy("part").orderBy(chance(1), *named))
    cut = sum(((F.col("place") > F.element_at("ends", s + 1)).cast("int") for s in range(shards - 1)), F.lit(0))
    sent = rows.withColumn("place", place).join(F.broadcast(matrix), "part").withColumn("shard", cut)
    # exchange: cells of a shard are ranges of the second permutation, so that no task holds a whole shard
    cell_bits = power_of_two(total / shards / rows_per_part, MOST_BITS)
    order = chance(2)
    cell = F.shiftrightunsigned(order, 64 - cell_bits).cast("int") if cell_bits else F.lit(0)
    sent = staged(sent.select(*named, "shard", order.alias("order"), cell.alias("cell")), "sent")
    cells, offsets, at = sent.groupBy("shard", "cell").count().collect(), [], {}
    for r in sorted(cells, key=lambda r: (r["shard"], r["cell"])):
        offsets.append({"shard": r["shard"], "cell": r["cell"], "before": at.get(r["shard"], 0)})
        at[r["shard"]] = at.get(r["shard"], 0) + r["count"]
    before = staged(small_table(spark, offsets, "shard: int, cell: int, before: bigint"), "offsets")
    # permute again
    slot = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("order", *named))
    out = sent.withColumn("slot", slot).join(F.broadcast(before), ["shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot") + F.col("before") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
