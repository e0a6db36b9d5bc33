"""Quality classifier over supervised subword embeddings.

Each word gives one hashed word feature and the hashed character n-grams of `<word>`, all of them hashed together with
whether the word has occurred before in the text, so that repetition is learned like any other property of words. A
document is the mean of the learned vectors of its features, and a softmax layer turns it into class probabilities.
Vectors and layer are trained by plain stochastic gradient descent in numpy. Once trained, a document's score needs one
number for each feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rankloom.llm.common import slices, sum_by_text, words_of
from rankloom.llm.language_id import held_out

#: Hashed features and n-gram lengths.
BUCKETS, NGRAMS = 1 << 17, (2, 3, 4)
#: Bounds of the training sample: labelled documents and characters.
MAX_DOCS, MAX_CHARS = 4000, 16_000_000


@dataclass(frozen=True)
class Settings:
    dim: int = 10
    epochs: int = 6
    rate: float = 0.5
    seed: int = 7


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, hashed features) of all features of distinct words, by array operations only.

    Features have two rows: where the word is new in its text, and where it has occurred before. Feature 0 is kept for the
    end of a document.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
    words = pa.concat_arrays([pc.cast(words, pa.binary())])
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.frombuffer(words.buffers()[1], np.int32)[words.offset]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[first : first + length.sum()]
    of = np.repeat(np.arange(n), length + 2)
    start = np.concatenate([[0], np.cumsum(length + 2)[:-1]])
    shown = np.full(len(of), 62, np.uint32)
    shown[start] = 60
    inner = np.ones(len(of), bool)
    inner[start] = inner[start + length + 1] = False
    shown[inner] = data
    power = np.cumprod(np.full(int(length.max()) + 2, 0x01000193, np.uint32), dtype=np.uint32)
    whole = np.add.reduceat(shown * power[np.arange(len(of)) - start[of]], start, dtype=np.uint32)
    owner, found = [np.arange(n)], [whole * np.uint32(0x9E3779B1)]
    for k in NGRAMS:
        if len(of) < k:
            continue
        h = np.full(len(of) - k + 1, k * 0x3C6EF372 & 0xFFFFFFFF, np.uint32)
        for j in range(k):
            h = (h ^ shown[j : len(of) - k + 1 + j]) * np.uint32(0x01000193)
        fits = of[: len(of) - k + 1] == of[k - 1 :]
        owner.append(of[: len(of) - k + 1][fits])
        found.append(h[fits])
    mixed = np.concatenate(found)
    mixed = np.stack([mixed, mixed ^ np.uint32(0xB5297A4D)])
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return np.concatenate(owner), ((mixed >> np.uint32(8)) % np.uint32(BUCKETS - 1)).astype(np.int64) + 1


def later(index: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1 at each word that has occurred before in the same text, else 0."""
    words = int(index.max(initial=0)) + 1
    _, first = np.unique(np.repeat(np.arange(len(counts)), counts) * words + index, return_index=True)
    seen = np.ones(len(index), np.int64)
    seen[first] = 0
    return seen


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct features, their shares) of each text; the end of the document counts as one feature."""
    out = []
    for text in texts:
        words, index, counts = words_of(pa.array([text], pa.string()))
        owner, found = features(words)
        seen = later(index, counts)
        times = np.stack([np.bincount(index[seen == k], minlength=len(words))[owner] for k in (0, 1)])
        total = np.bincount(found.ravel(), weights=times.ravel(), minlength=1)
        total[0] = 1
        ids = np.flatnonzero(total)
        out.append((ids, total[ids] / total[ids].sum()))
    return out


def train(texts: list[str], labels: list[int], settings: Settings = Settings()) -> np.ndarray:
    """Score of each hashed feature: its vector times the difference of the two output rows.

    One pass of gradient steps over shuffled documents in each epoch, with a rate that falls to zero.
    """
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1 / settings.dim, 1 / settings.dim, (BUCKETS, settings.dim))
    layer = np.zeros((2, settings.dim))
    docs, y = bags(texts), np.asarray(labels)
    steps, done = max(1, settings.epochs * len(docs)), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            rate = settings.rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[ids]
            out = layer @ mean
            p = np.exp(out - out.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, mean)
            # fewer occurrences move a vector less, as if each occurrence were its own step
            vectors[ids] -= rate * (share * len(ids))[:, None].clip(max=1.0) * back
    return vectors @ (layer[1] - layer[0])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> np.ndarray:
    """Trains on the labelled documents outside the held-out part, MAX_DOCS and MAX_CHARS of them at most in hash order.

    A text that no longer fits into MAX_CHARS is skipped, and shorter ones after it still count. A document with several
    labels takes the smallest, one with several texts the first of the shortest; null labels and null texts don't count.
    Without any labelled document every score is 0.5.
    """
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("i").isNotNull() & ~held_out(F.col("i")))
    known = known.groupBy("i").agg(F.min("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where(F.col("t").isNotNull())
    ids = {r["i"]: r["y"] for r in known.orderBy(F.xxhash64("i"), "i").limit(max_docs).collect()}
    # lengths alone first, so that only texts that fit come to the driver
    size = {r["i"]: r["n"] for r in texts.where(F.col("i").isin(list(ids))).groupBy("i").agg(F.min(F.length("t")).alias("n")).collect()}
    chosen, total = [], 0
    for i in ids:
        if i in size and total + size[i] <= max_chars:
            chosen.append(i)
            total += size[i]
    fits = texts.where(F.col("i").isin(chosen) & (F.length("t") <= max_chars))
    rows = {r["i"]: r["t"] for r in fits.groupBy("i").agg(F.min(F.struct(F.length("t").alias("n"), "t")).alias("x")).select("i", "x.t").collect()}
    return train([rows[i] for i in chosen], [int(ids[i] == 1) for i in chosen], settings) if chosen else np.zeros(BUCKETS)


def score(docs: DataFrame, weights: np.ndarray, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from the whole text alone.

    A null or empty text has the score of a document with no word. Repeated rows and null ids stay; no shuffle. The
    weights are BUCKETS numbers, so what is broadcast has a fixed size.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float64))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        for b in slices(batches):
            words, index, counts = words_of(b.column(1))
            owner, found = features(words)
            by_word = np.stack([np.bincount(owner, weights=table[row], minlength=len(words)) for row in found])
            number = np.bincount(owner, minlength=len(words))
            total = sum_by_text(by_word[later(index, counts), index], counts) + table[0]
            mean = total / (sum_by_text(number[index], counts) + 1)
            p = 1 / (1 + np.exp(-np.clip(mean, -50, 50)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return picked.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
