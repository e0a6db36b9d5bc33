import pytest

#: Columns whose names operators use for themselves.
EXTRA = "fp string, component_id long, size string, taken int, pattern string, h long, shard string, slot string, part int, text_key string, votes string, c string, i long, g string, t string, r int, key string, held_out string, score string"


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    extra = tuple([None] * len(EXTRA.split(", ")))
    long = " ".join(f"word{n % 977}" for n in range(20_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river", "en", "a"), (1, "The quick brown fox jumps over the lazy dog near the river", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n ", "de", "b"),
        (5, long, "en", "a"), (6, "the QUICK brown fox jumps over the lazy dog near the river", "fr", None), (None, "Der Fluss ist breit und die Brücke ist alt", None, "b"), (None, None, None, None), (7, "Ünïcödé ☃ 𝒳   text", "de", "b"), (8, "one two", "en", "b"), (9, "word", "en", "c"),
    ]
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), *extra) for i, t, g, s in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("1 = 0")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
