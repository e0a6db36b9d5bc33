"""Language identification by compression.

One raw-content zstandard dictionary for each language is cut from a bounded sample of labelled documents. A text is
folded to lower-case letters and single spaces, encoded piece by piece with each dictionary, and goes to the language
that makes it smallest. A text whose best two sizes are too close for its size is marked as rejected, and so is one of which
too large a share is in another language.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.llm.common import slices

UNKNOWN = "und"
#: Bounds of the training sample: documents looked at and bytes of dictionary for each language.
DOCS_PER_LANG, DICT_BYTES = 300, 32_768
#: Texts are encoded whole, in pieces of so many bytes, so that a long text can't learn itself.
PIECE_BYTES = 1024
#: Texts whose margin is under this share of their smallest size are rejected. Of sf0.1's training texts with the right
#: label (never the held-out ones), 7 of 1980 are; closely related languages leave less and may need another share.
MIN_MARGIN = 0.08
#: Texts are rejected as well if more than this share of their pieces is, by the same margin, in another language.
MAX_OTHER = 0.25
#: Words of a run in a dictionary, and runs from one document at most.
RUN_WORDS, RUNS_PER_DOC = 3, 60

_NOT_LETTER = regex.compile(r"[^\p{L}]+")
_state: dict = {}


def folded(text: str | None) -> bytes:
    """Lower-case letters, every other run as one space; b'' if there is no letter."""
    out = _NOT_LETTER.sub(" ", (text or "").lower()).strip()
    return f" {out} ".encode("utf-8", "replace") if out else b""


def held_out(doc_id: Column) -> Column:
    """The rows whose labels must not be learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language, from the first DOCS_PER_LANG training documents of each in hash order.

    Only rows with a text and a language outside the held-out part count. The first pass ranks ids without reading
    texts; the second reads the texts of the chosen ids alone, the least for each id and language, so that at most
    DOCS_PER_LANG texts of each language come to the driver, however often an id stands.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("g"), F.col(text_col).cast("string").alias("t"))
    rows = rows.where(F.col("g").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("i")))
    counts = {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()}  # a row for each language
    if not counts:
        return {}
    # so few rows pass the first cut, a third more than are wanted, that no task ranks many of a common language
    cut = F.create_map(*(F.lit(x) for g, n in counts.items() for x in (g, min(1.0, DOCS_PER_LANG * 4 / 3 / n))))
    part = F.shiftrightunsigned(F.xxhash64("i"), 11) / F.lit(float(1 << 53))
    order = Window.partitionBy("g").orderBy(part, "i")
    picks = rows.select("i", "g").distinct().where(part < cut[F.col("g")]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= DOCS_PER_LANG)
    chosen = picks.collect()  # at most DOCS_PER_LANG ids for each language
    ids, ranks = {r["i"] for r in chosen}, {(r["g"], r["i"]): r["r"] for r in chosen}
    texts: dict[str, list] = {}
    # a text of over DICT_BYTES characters fills a dictionary alone, so no more of it is sent
    for r in rows.where(F.col("i").isin(list(ids))).groupBy("i", "g").agg(F.min(F.substring("t", 1, DICT_BYTES)).alias("t")).collect():
        if (r["g"], r["i"]) in ranks:
            texts.setdefault(r["g"], []).append((ranks[r["g"], r["i"]], r["t"]))
    return {g: content([t for _, t in sorted(found)]) for g, found in sorted(texts.items())}


def content(texts: list[str]) -> bytes:
    """Dictionary content of a language: short runs of words from all sampled texts, shuffled.

    No long passage stands in it whole, so a passage that texts of several languages share favours none of them.
    """
    rng = random.Random(len(texts))
    runs = []
    for text in texts:
        words = folded(text).split()
        own = [b" ".join(words[i : i + RUN_WORDS]) for i in range(0, len(words), RUN_WORDS)]
        runs += rng.sample(own, min(len(own), RUNS_PER_DOC))
    rng.shuffle(runs)
    return (b" " + b" ".join(runs) + b" ")[:DICT_BYTES]


class Classifier:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, content: dict[str, bytes]):
        self.langs = sorted(content)
        self.first = [self._compressor(content[g], zstandard.STRATEGY_GREEDY, 4) for g in self.langs]
        self.plain = self._compressor(b"", zstandard.STRATEGY_GREEDY, 4)
        self.second = [self._compressor(content[g], zstandard.STRATEGY_LAZY2, 3) for g in self.langs]

    @staticmethod
    def _compressor(content: bytes, strategy: int, match: int) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=16, chain_log=16, search_log=5, min_match=match, target_length=64, strategy=strategy,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        if len(content) < 8:
            return zstandard.ZstdCompressor(compression_params=params)
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=made, compression_params=params)

    @staticmethod
    def _sizes(compressor: zstandard.ZstdCompressor, pieces: list[bytes]) -> list[int]:
        return [len(compressor.compress(p)) for p in pieces]

    def __call__(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, int, bool]:
        """(language, score, margin in bytes, rejected); ties in size go to a second, slower encoder, then to the first
        name, and have margin 0. The rival of a language that is alone is the encoding without a dictionary."""
        data = folded(text)
        if not data or not self.langs:
            return UNKNOWN, 0.0, 0, True
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        each = np.array([self._sizes(c, pieces) for c in self.first])
        sizes = each.sum(axis=1)
        best = int(sizes.argmin())
        tied = np.flatnonzero(sizes == sizes[best])
        score = float(1 / np.exp2(-np.minimum(sizes - sizes[best], 60)).sum())
        if len(self.langs) == 1:
            margin = sum(self._sizes(self.plain, pieces)) - int(sizes[0])
            return self.langs[0], score, margin, self._narrow(margin, sizes[0], min_margin)
        margin = int(np.partition(sizes, 1)[1] - sizes[best])
        if len(tied) > 1:
            again = np.array([sum(self._sizes(self.second[i], pieces)) for i in tied])
            best = int(tied[again.argmin()])
        two = np.partition(each, 1, axis=0)
        other = (each.argmin(axis=0) != best) & (two[1] - two[0] >= min_margin * two[0])
        share = np.array(list(map(len, pieces)))[other].sum() / len(data)
        return self.langs[best], score, margin, self._narrow(margin, sizes[best], min_margin) or bool(share > MAX_OTHER)

    @staticmethod
    def _narrow(margin: int, size: int, min_margin: float) -> bool:
        return bool(margin <= 0 or margin < min_margin * size)


def identify(docs: DataFrame, content: dict[str, bytes], min_margin: float = MIN_MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, rejected) of every row, over the whole text.

    A null text, or one without a letter, is `und` with score 0 and rejected. score is the share of the best language
    when each compressed byte halves the weight. Repeated rows and null ids stay; no shuffle, no other column is read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _state.get("of") != content:
            _state["of"], _state["classifier"] = content, Classifier(content)
        classify = _state["classifier"]
        for b in slices(batches):
            found = [classify(t, min_margin) for t in b.column(1).to_pylist()]
            lang, score, margin, gone = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.int64()), pa.array(gone, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"],
            )

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return picked.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, margin long, rejected boolean")


def keep_identified(docs: DataFrame, content: dict[str, bytes], min_margin: float = MIN_MARGIN, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is identified, with their columns as they were; rejected rows go. No shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _state.get("of") != content:
            _state["of"], _state["classifier"] = content, Classifier(content)
        classify = _state["classifier"]
        for b in slices(batches, at):
            keep = [not classify(t, min_margin)[3] for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
