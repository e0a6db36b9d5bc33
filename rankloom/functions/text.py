"""Text normalisers and tokens as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Fixed English stop words of the lexical tokeniser.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def plain(text: Column) -> Column:
    """Lower case, every run outside a-z and 0-9 as one space, trimmed: for catalog search and tags."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def compact(text: Column) -> Column:
    """As plain, without any space."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


@F.pandas_udf(StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """NFKD form, for exact matching: an accent becomes a character of its own."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """NFKC form, folded, for names in questions."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def exact(text: Column) -> Column:
    """Decomposed, lower case, typographic quotes as ASCII, the rest as in plain."""
    return plain(F.translate(decomposed(text), "’‘“”", "''\"\""))


def name(text: Column) -> Column:
    """Composed and folded; runs of letters, digits and underscores, joined by one space."""
    return F.array_join(F.regexp_extract_all(composed(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters, with stop words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def overlap(query: Column, value: Column) -> Column:
    """Share of the distinct tokens of a normalised value that stand in the normalised query; 0 without tokens."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    own = words(value)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, words(query))) / F.size(own)).otherwise(0.0)


def phrase(query: Column, value: Column) -> Column:
    """A normalised value stands in the normalised query, word bounds or not; an empty one never does."""
    return (value != "") & F.contains(query, value)
