"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Buckets of texts are proposed, exact sets decide. Two sets of similarity s agree in one MinHash band of ROWS minima with
probability s ** ROWS, however the edits lie in the text; of a pair of similarity 0.8, all BANDS bands miss with
probability 1e-5. The texts of a bucket are compared by their whole sets, so no link is a guess. A bucket with more shingles than
BLOCK is dealt out as pairs of blocks of its texts, so that no task holds it; each pair of its texts meets in one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rankloom.llm.common import broadcast_if_few, staged

WORDS, BANDS, ROWS = 5, 16, 3
#: Shingles of the texts in one block of a bucket, about.
BLOCK = 1 << 18

_rng = np.random.default_rng(7)
_SALT, _ODD = (_rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1) for _ in range(2))
_PLACE = _rng.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of WORDS words; fewer words make one run, none make none."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n, wide = max(1, len(w) - WORDS + 1), min(WORDS, len(w))
    h = np.full(n, wide, np.uint64)
    for k in range(wide):
        h += _mixed(w[k : k + n] * _PLACE[k])
    return np.unique(_mixed(h))


def packed(shingles: np.ndarray) -> bytes:
    """The set in 32 bits each, sorted: two texts of 1000 words meet by chance in one shingle in 4000 pairs."""
    return np.unique((shingles >> np.uint64(32)).astype("<u4")).tobytes()


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band of minima; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), 1 << 11):
        least = np.minimum(least, ((shingles[at : at + (1 << 11)] ^ _SALT) * _ODD).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) that connect the sets as all pairs of similarity 0.8 or more do; linked sets are not compared again."""
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    mark = np.zeros(int(flat.max()) + 1, np.int64)
    links, queue, rest = [], [], np.arange(len(sets))
    left = flat
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            left, rest = left[size[rest[0]] :], rest[1:]
            continue
        at = queue.pop()
        own = flat[ends[at] - size[at] : ends[at]]
        mark[own] = 1
        common = np.add.reduceat(mark[left], np.cumsum(size[rest]) - size[rest])
        mark[own] = 0
        near = 9 * common >= 4 * (size[at] + size[rest])  # common / (both - common) >= 4 / 5
        if near.any():
            found = rest[near].tolist()
            links += [(at, j) for j in found]
            queue += found
            left, rest = left[np.repeat(~near, size[rest])], rest[~near]
    return links


def _links_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, signature, shingles), sorted by task, to links of the signatures."""
    task, names, sets = None, [], []

    def found() -> Iterator[pa.RecordBatch]:
        pairs = [(names[i], names[j]) for i, j in forest(sets) if names[i] != names[j]] if len(sets) > 1 else []
        if pairs:
            a, b = zip(*pairs)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for t, name, blob in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if t != task:
                yield from found()
                task, names, sets = t, [], []
            names.append(name)
            sets.append(np.frombuffer(blob, "<u4"))
    yield from found()


def links(rows: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between signatures, from rows (uid, signature, shingles) and the buckets that propose them, members
    (uid, size in shingles, bucket), with one uid for each set. Buckets that hold the same texts are one bucket."""
    stats = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("uid")).alias("mark"), F.sum("size").alias("total")).where("n > 1")
    chosen = staged(stats.groupBy("n", "mark", "total").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("total") / block).cast("int").alias("blocks")), "buckets")
    dealt = members.select("uid", "bucket").join(broadcast_if_few(chosen), "bucket")
    own = F.pmod(F.xxhash64("uid", "bucket"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.where("blocks = 1 or own <> other")  # the texts of one block meet in each of its pairs
    tasks = dealt.select("uid", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("task"))
    tasks = staged(tasks, "bucket-tasks")
    # sets that no bucket proposes are left where they are
    wanted = staged(tasks.select("uid").distinct(), "proposed")
    proposed = rows.select("uid", "signature", "shingles").join(broadcast_if_few(wanted), "uid", "left_semi")
    ready = tasks.join(proposed, "uid").select("task", "signature", "shingles")
    return ready.repartition("task").sortWithinPartitions("task").mapInArrow(_links_of, "a long, b long").distinct()
