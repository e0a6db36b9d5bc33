"""Token counts by the whole-token shortcut.

Offline, every vocabulary string that ends a word is encoded once; those that come out as a single token are
proven whole. A pre-token of a text that is in this set counts one without any merging; the library merges the rest.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from rankloom.llm.common import slices, sum_by_text, words_of

#: Fixed pattern of the pre-tokenizer in the vocabulary file.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below U+0300 composition, lower case and classes are stable; a word with other characters goes to the library whole.
PLAIN = regex.compile(r"[!-~¡-˿]+")
#: Words of this many characters at most are remembered, and so many of them.
MEMO_CHARS, MEMO_WORDS = 40, 400_000

_state: dict = {}


def whole_tokens(vocabulary_json: str) -> frozenset[str]:
    """Proves which pre-tokens encode alone as one token, by encoding each candidate with the library.

    A candidate is the text of a vocabulary entry that ends a word. It counts as proven only if the pre-tokenizer
    leaves it in one piece and the model makes one token of it.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(vocabulary_json)
    pattern = regex.compile(PRE_TOKEN)
    found = []
    for entry in tok.get_vocab():
        if not entry.endswith("</w>"):
            continue
        word = _byte_text(entry[:-4])
        if word and word == word.lower() and PLAIN.fullmatch(word) and pattern.findall(word) == [word]:
            found.append(word)
    encoded = tok.encode_batch(found, add_special_tokens=False)
    return frozenset(w for w, e in zip(found, encoded) if len(e.ids) == 1)


def check_pattern(vocabulary_json: str) -> None:
    """Refuses a file whose words are cut by another pattern than PRE_TOKEN: its counts would be wrong."""

    def patterns(node: object) -> Iterator[str]:
        for key, value in node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ():
            if key == "Regex":
                yield value
            else:
                yield from patterns(value)

    found = list(patterns(json.loads(vocabulary_json).get("pre_tokenizer")))
    if PRE_TOKEN not in found:
        raise ValueError(f"the vocabulary's pre-tokens are {found}, not {PRE_TOKEN}")


def _byte_text(symbols: str) -> str:
    """The text that a byte-level vocabulary entry stands for ('' if it isn't whole UTF-8)."""
    table = _state.get("bytes")
    if table is None:
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        table = _state["bytes"] = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    try:
        return bytes(table[c] for c in symbols).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return ""


class Counter:
    """Counts tokens of words: whole tokens by lookup, the rest by the library in one batch."""

    def __init__(self, vocabulary_json: str, whole: frozenset[str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(vocabulary_json)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.whole, self.memo, self.pieces = whole, {}, {}
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())

    def __call__(self, words: list[str]) -> np.ndarray:
        for memo in (self.memo, self.pieces):
            if len(memo) > MEMO_WORDS:
                memo.clear()
        memo, whole, pieces, out = self.memo, self.whole, self.pieces, np.zeros(len(words), np.int64)
        merge: dict[str, list[int]] = {}
        fresh: list[tuple[int, str]] = []
        for i, w in enumerate(words):
            n = memo.get(w)
            if n is not None:
                out[i] = n
                continue
            fresh.append((i, w))
            if not PLAIN.fullmatch(w) or any(s in w for s in self.special):
                merge.setdefault(w, []).append(i)
                continue
            n = 0
            for piece in self.pattern.findall(w.lower()):
                if piece in whole:
                    n += 1
                elif piece in pieces:
                    n += pieces[piece]
                else:
                    merge.setdefault(piece, []).append(i)
            out[i] = n
        todo = list(merge)
        for at in range(0, len(todo), 20_000):
            part = todo[at : at + 20_000]
            for piece, e in zip(part, self.tok.encode_batch(part, add_special_tokens=False)):
                n = len(e.ids)
                if len(piece) <= MEMO_CHARS:
                    pieces[piece] = n
                for i in merge[piece]:
                    out[i] += n
        for i, w in fresh:
            if len(w) <= MEMO_CHARS:
                memo[w] = int(out[i])
        return out


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, special strings handled as the library does by default.

    vocabulary: path of a word-end BPE file of the tokenizers library, read once by the driver (its size is fixed). A
    file with another pattern of pre-tokens is a ValueError.
    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids stay as they are; other columns of docs
    are not read. No shuffle; texts are cut into bounded Arrow slices, and words are independent of each other since
    neither the normaliser nor a pre-token reaches over white space.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    check_pattern(spec)
    shipped = docs.sparkSession.sparkContext.broadcast((spec, whole_tokens(spec)))
    key = hashlib.sha256(spec.encode()).hexdigest()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _state.get("of") != key:
            _state["of"], _state["counter"] = key, Counter(*shipped.value)
        counter = _state["counter"]
        for b in slices(batches):
            text = pc.fill_null(b.column(1), "")
            words, index, counts = words_of(text)
            by_word = counter(words.to_pylist()) if len(words) else np.zeros(0, np.int64)
            n = sum_by_text(by_word[index], counts)
            size = pc.cast(pc.binary_length(text), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
