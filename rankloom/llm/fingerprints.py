"""Document fingerprints: digests of improbable features.

Every window of WINDOW bytes has an entropy. Windows are ranked by how far their entropy lies from that of common
prose; a window that is the rarest of many neighbourhoods is a feature. Features go into Bloom filters of 2048 bits,
in the order of the text, and a filter that holds MOST features is followed by the next in the chain. Two digests are
compared by the overlap of their filters' bits, less the overlap that chance explains.

The digest depends on the bytes of the text alone, so equal texts have equal digests in every run and every table.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

#: Bytes of a window; windows that compete; wins that make a feature.
WINDOW, RIVALS, WINS = 32, 32, 12
#: Entropy of common prose and the least that counts, in thousandths of the highest.
COMMON, LEAST = 760, 350
#: Texts of fewer bytes have too few windows to rank: all their windows of SHORT_WINDOW bytes are features.
SHORT_TEXT, SHORT_WINDOW = 160, 8
#: Bits of a filter, hashes of a feature, features of a filter.
FILTER_BITS, HASHES, MOST = 2048, 5, 160
#: Share of the possible overlap above chance that still counts as none.
SLACK = 0.1
#: Documents of a range, and ranges at most.
RANGE_ROWS, MAX_RANGES = 500, 100_000
#: Above the number of pieces into which a range is cut.
MAX_PIECES = 1 << 20

_F = np.round(np.arange(WINDOW + 2) * np.log2(np.maximum(np.arange(WINDOW + 2), 1)) * (1 << 12)).astype(np.int64)
_GAIN = (_F[1:] - _F[:-1]).astype(np.int32)
_UNRANKED = 1023


def _ranks(data: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Rank of the window that starts at each byte, low if its entropy is rare; _UNRANKED where not valid.

    The entropy is carried from window to window: a byte that leaves or enters changes c*log(c) of its own count
    alone. Those counts come from comparing the data with itself, shifted.
    """
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    step = 1 << 16
    for at in range(0, n, step):  # so that the counters stay in the cache
        for k in range(1, WINDOW):
            hi = min(n, at + step)
            lo = max(at, k)
            if lo < hi:
                same = (data[lo:hi] == data[lo - k : hi - k]).view(np.uint8)
                before[lo:hi] += same
                after[lo - k : hi - k] += same
    m = n - WINDOW + 1
    change = np.zeros(m, np.int64)
    change[0] = _F[np.bincount(data[:WINDOW])].sum()
    change[1:] = _GAIN[before[WINDOW:]] - _GAIN[after[: m - 1]]
    total = np.cumsum(change)
    height = (1000 - total * 1000 // int(_F[WINDOW])).astype(np.int32)
    rank = 1000 - np.abs(height - COMMON)
    rank[(height < LEAST) | ~valid[:m]] = _UNRANKED
    return rank


def _winners(rank: np.ndarray) -> np.ndarray:
    """Positions that are the leftmost rarest of at least WINS of the runs of RIVALS positions that hold them."""
    out = []
    step = 1 << 20
    for at in range(0, len(rank), step):
        part = rank[at : at + step + RIVALS - 1].astype(np.uint32)
        if len(part) < RIVALS:
            break
        key = (part << np.uint32(21)) | np.arange(len(part), dtype=np.uint32)
        span = 1
        while span < RIVALS:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        key = key[key < np.uint32(_UNRANKED << 21)] & np.uint32((1 << 21) - 1)
        out.append(key.astype(np.int64) + at)
    wins = np.bincount(np.concatenate(out), minlength=1) if out else np.zeros(0, np.int64)
    return np.flatnonzero(wins >= WINS)


def _hash(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the windows of `width` bytes (a multiple of 8) at positions `at`."""
    seen = np.lib.stride_tricks.sliding_window_view(data, width)[at]
    words = np.ascontiguousarray(seen).view("<u8").reshape(len(at), -1)
    h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """The filters of each text, an array of (filters, 256) bytes; no filter for an empty text."""
    pad = RIVALS + WINDOW
    length = np.array([len(t) for t in texts], np.int64)
    gap = b"\0" * pad
    data = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
    start = pad + np.concatenate([[0], np.cumsum(length + pad)[:-1]]).astype(np.int64)
    of, at, h = [], [], []
    valid = np.zeros(len(data), bool)
    for s, n in zip(start.tolist(), length.tolist()):
        if n >= SHORT_TEXT:
            valid[s : s + n - WINDOW + 1] = True
    if valid.any():
        found = _winners(_ranks(data, valid))
        of.append(np.searchsorted(start, found, side="right") - 1)
        at.append(found)
        h.append(_hash(data, found, WINDOW))
    short = np.flatnonzero((length < SHORT_TEXT) & (length > 0))
    if len(short):
        n = np.maximum(length[short] - SHORT_WINDOW + 1, 1)  # a text of fewer bytes is one window, filled with zeros
        owner = np.repeat(short, n)
        found = start[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of.append(owner)
        at.append(found)
        h.append(_hash(data, found, SHORT_WINDOW))
    if not of:
        return [np.zeros((0, FILTER_BITS // 8), np.uint8) for _ in texts]
    of, at, h = np.concatenate(of), np.concatenate(at), np.concatenate(h)
    order = np.lexsort((at, h, of))
    of, at, h = of[order], at[order], h[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])  # a feature counts once, where it comes first
    of, at, h = of[new], at[new], h[new]
    order = np.argsort(at, kind="stable")
    of, h = of[order], h[order]
    number = np.bincount(of, minlength=len(texts))
    nth = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    chain = -(-number // MOST)
    base = np.cumsum(chain) - chain
    row = base[of] + nth // MOST
    bits = np.zeros((int(chain.sum()), FILTER_BITS // 8), np.uint8)
    for k in range(HASHES):
        bit = ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
        np.bitwise_or.at(bits, (row, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    return [bits[b : b + c] for b, c in zip(base, chain)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the mean, over the filters of the shorter chain, of the best overlap with a filter of the other."""
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for row, n in zip(a, na):
        both = np.bitwise_count(row & b).sum(1, dtype=np.int64)
        chance = n * nb / FILTER_BITS
        most = np.minimum(n, nb)
        floor = chance + SLACK * (most - chance)
        score = np.where(most > floor, (both - floor) / np.maximum(most - floor, 1e-9), 0.0)
        total += float(min(1.0, max(0.0, score.max())))
    return total / len(a)


def shown(digest: np.ndarray) -> str:
    """Number of filters, then their bits in base64."""
    return f"{len(digest)}:{base64.b64encode(digest.tobytes()).decode()}"


def _ranged(docs: DataFrame, id_col: str, text_col: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, text, part, tail) sorted within partitions: consecutive ranges of rows by id and hash of the text, each
    whole in a partition and followed by a copy of the first row of the next range (of the first range, after the last).

    Range bounds come from quantiles of the ids and the first rows of the ranges from a pass over ids; both have some
    MAX_RANGES entries at most. An id that fills several ranges is cut by the hash of its texts. Where one id and text
    fill more than two ranges, all of these rows but one have an equal row for their next: they are dealt evenly with
    tail 2, and follow themselves. Texts are shuffled once.
    """
    low = -(1 << 63)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("key"))
    total = rows.count()
    n = max(1, min(MAX_RANGES, total // range_rows))
    cuts = rows.select(F.percentile_approx("key", [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("q")).first()["q"] if n > 1 else []
    splits = [-float("inf"), *sorted({float(c) for c in cuts or []}), float("inf")]
    if len(splits) > 2:
        ranged = Bucketizer(splits=splits, inputCol="place", outputCol="part").transform(rows.withColumn("place", F.col("key").cast("double"))).drop("place")
        ranged = ranged.withColumn("part", F.col("part").cast("long") * MAX_PIECES)
    else:
        ranged = rows.withColumn("part", F.lit(0).cast("long"))
    # ids from which doubles differ have a range that starts at them
    often = {k: c for k, c in Counter(cuts or []).items() if c > 1 and (k == low or abs(k) < 1 << 53)}
    ranged = _cut_by_text(ranged, often, splits, 2 * max(range_rows, total // n)) if often else ranged.withColumn("h", F.lit(0).cast("long")).withColumn("tail", F.lit(0))
    first = F.min(F.struct("key", "h")).alias("first")
    firsts = ranged.where("tail = 0").groupBy("part").agg(first).orderBy("part").collect()
    tails = docs.sparkSession.createDataFrame([(r["first"]["key"], r["first"]["h"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)], "key long, h long, into long")
    copies = ranged.where("tail = 0").join(F.broadcast(tails), ["key", "h"]).select("doc_id", "text", "key", "h", F.col("into").alias("part"), F.lit(1).alias("tail"))
    if often:  # a range may start with many equal rows, of which the range before needs one
        one = copies.groupBy("part").agg(F.min(F.struct("text", "doc_id", "key", "h")).alias("x"))
        copies = one.select("x.doc_id", "x.text", "x.key", "x.h", "part", F.lit(1).alias("tail"))
    both = ranged.select("doc_id", "text", "key", "h", "part", "tail").union(copies)
    return both.repartition("part").sortWithinPartitions("part", "tail", "key", "h", "text").select("doc_id", "text", "part", "tail")


def _cut_by_text(ranged: DataFrame, often: dict[int, int], splits: list[float], most: int) -> DataFrame:
    """Cuts the ranges that start at one of the ids of `often` (id: pieces) by the hash of its texts, and sets apart rows
    that stand more than `most` times. Adds h and tail; part grows within its range as (key, h) does."""
    spark = ranged.sparkSession
    hot = [((bisect_right(splits, float(k)) - 1) * MAX_PIECES, k, c) for k, c in often.items()]
    ranged = ranged.join(F.broadcast(spark.createDataFrame(hot, "part long, hot long, pieces int")), "part", "left")
    mine = F.col("key") == F.col("hot")
    ranged = ranged.withColumn("h", F.when(mine, F.xxhash64("text")).otherwise(F.lit(0)).cast("long")).withColumn("uid", F.monotonically_increasing_id())
    again = ranged.where(mine).groupBy("key", "h").agg(F.count("*").alias("n"), F.min("uid").alias("one")).where(F.col("n") > most)
    again = spark.createDataFrame(again.collect(), "key long, h long, n long, one long")  # total / most rows at most
    ranged = ranged.join(F.broadcast(again), ["key", "h"], "left")
    apart = F.coalesce(F.col("uid") != F.col("one"), F.lit(False))
    last = F.col("pieces") - 1
    piece = F.when(mine, F.least(last, F.floor((F.col("h").cast("double") / float(1 << 64) + 0.5) * F.col("pieces")))).otherwise(F.coalesce(last, F.lit(0)))
    part = F.when(apart, -1 - F.pmod(F.xxhash64("uid"), F.lit(len(splits) + sum(often.values())))).otherwise(F.col("part") + piece)
    return ranged.select("doc_id", "text", "key", "h", part.cast("long").alias("part"), F.when(apart, 2).otherwise(0).alias("tail"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is that of the next id; rows with the same id follow each other by text (those of an id that fills
    several ranges by the text's hash), null ids come first, and the first row follows the last (a lone row follows
    itself). A null text is empty. Likeness of equal digests,
    empty ones included, is 1; an empty one is unlike any other. Ids are whole numbers; other types are a TypeError.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must hold whole numbers")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _ranged(docs, id_col, text_col, range_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (row, digest) whose next document is yet to come
        for b in _small(batches):
            part = list(zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3))))
            found = digests([r[1].encode("utf-8", "replace") for r in part])
            seq = ([last] if last else []) + list(zip(part, found))
            last = seq[-1]
            pairs = [(r, d, s, e) for (r, d), (s, e) in zip(seq, seq[1:]) if not r[3] and r[2] == s[2]]
            pairs += [(r, d, r, d) for r, d in zip(part, found) if r[3] == 2]
            if not pairs:
                continue
            texts = [r[1] for r, _, _, _ in pairs]
            edited = [(t[: len(t) - len(t) // 2] + s[1][: len(t) // 2]).encode("utf-8", "replace") for t, (_, _, s, _) in zip(texts, pairs)]
            changed = digests(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r, _, _, _ in pairs], b.schema.field(0).type),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
                    pa.array([shown(d) for _, d, _, _ in pairs]),
                    pa.array([shown(c) for c in changed]),
                    pa.array([likeness(d, c) for (_, d, _, _), c in zip(pairs, changed)], pa.float64()),
                    pa.array([likeness(d, e) for _, d, _, e in pairs], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from rankloom.llm.common import slices

    return slices(batches, 1, 1 << 20)
