"""Vectors of query texts: a hook for any encoder, with a seeded hashing encoder as its default."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Texts that go through an encoder at once, and words of a text whose rows the default encoder sums at once.
BATCH, WORDS = 256, 512


class HashingEncoder:
    """Sums signed hashes of words and of their runs of three characters: the same vectors on every machine.

    It is no language model; it stands where one can be hooked in, and puts texts that share words close together. It reads
    all words of a text, some at a time; the sums are of whole numbers, so their order does not count.
    """

    def __init__(self, dim: int = 64, seed: int = 42, words: int = 100_000):
        self.dim, self.seed = dim, seed
        self.known: dict[str, int] = {}  # the words seen and their rows; they are forgotten when `words` are known
        self.rows = np.zeros((words + WORDS, dim))
        self.words = words

    def word(self, word: str) -> int:
        at = self.known[word] = len(self.known)
        row = self.rows[at]
        row[:] = 0.0
        for piece in (word, *(f"<{word}>"[i : i + 3] for i in range(len(word)))):
            h = xxhash.xxh64_intdigest(piece.encode(), self.seed)
            row[(h >> 1) % self.dim] += 1.0 if h & 1 else -1.0
        return at

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            found = (m.group() for m in re.finditer(r"\w+", text.lower()))
            while some := list(islice(found, WORDS)):
                if len(self.known) >= self.words:
                    self.known.clear()
                row += self.rows[[self.known[w] if w in self.known else self.word(w) for w in some]].sum(axis=0)
        return out


def encoded(queries: DataFrame, text_col: str = "query", make: Callable[[], Callable[[list[str]], np.ndarray]] = HashingEncoder, batch: int = BATCH) -> DataFrame:
    """queries with `vector`, the encoder's vector of the text, of length 1; null or blank texts have none.

    make builds the encoder once for each task, not for each batch; it takes a list of texts and returns a row for each.
    Texts go through it in batches of about equal length. A text that the encoder maps to zero keeps the zero vector.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for texts in batches:
            out: list[np.ndarray | None] = [None] * len(texts)
            live = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            live.sort(key=lambda i: len(texts.iloc[i]))
            for lo in range(0, len(live), batch):
                part = live[lo : lo + batch]
                rows = np.asarray(encoder([texts.iloc[i] for i in part]), np.float64)
                norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
                for i, row in zip(part, rows / np.where(norm == 0, 1, norm)):
                    out[i] = row
            yield pd.Series(out)

    return queries.withColumn("vector", vectors(F.col(text_col)))
