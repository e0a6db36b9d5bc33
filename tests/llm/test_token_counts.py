"""Counts against the library, text by text."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rankloom.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts):
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        n = len(tok.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 2048), (text[:80], n, r)


def test_whole_table(docs):
    check(token_counts.count_tokens(docs, PATH).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


def test_odd_texts(spark):
    rng = random.Random(3)
    special = [t.content for t in Tokenizer.from_file(PATH).get_added_tokens_decoder().values()]
    pieces = [*special, "don't", "I'LL", "ß", "İ", "é", "é", "☃", "𝒳", "12345", " ", " ", "\t", "\n", " ", "...", "a" * 60, "<|", "|>", "日本", "x_y", "\x00"]
    texts = dict(enumerate([None, "", " ", *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(800))]))
    check(token_counts.count_tokens(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH).collect(), texts)


def test_edge_rows(edge, empty):
    out = token_counts.count_tokens(edge, PATH)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == edge.count() and token_counts.count_tokens(empty, PATH).count() == 0
    check([r for r in out.collect() if r["doc_id"] in (2, 3, 4, 5, 7)], {r["doc_id"]: r["text"] for r in edge.collect() if r["doc_id"] in (2, 3, 4, 5, 7)})


def test_another_pattern_is_refused(spark, tmp_path):
    other = tmp_path / "other.json"
    other.write_text(open(PATH, encoding="utf-8").read().replace("'s|'t|", "'s|", 1), encoding="utf-8")
    with pytest.raises(ValueError):
        token_counts.count_tokens(spark.range(1).selectExpr("id as doc_id", "'x' as text"), str(other))
