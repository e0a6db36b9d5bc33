"""Scalar expressions over catalog fields and ranks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def values(names: Column) -> Column:
    """Trimmed names without blanks; null is no name."""
    return F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def display(names: Column) -> Column:
    return F.array_join(values(names), ", ")


def display_track(title: Column, artist: Column, album: Column) -> Column:
    """'title — artist (album)' with stand-ins for what is missing."""
    or_else = lambda c, text: F.when(display(c) == "", text).otherwise(display(c))
    rest = F.when(display(album) == "", "").otherwise(F.concat(F.lit(" ("), display(album), F.lit(")")))
    return F.concat(or_else(title, "Unknown title"), F.lit(" — "), or_else(artist, "Unknown artist"), rest)


def labelled(fields: dict[str, Column], separator: str) -> Column:
    """'name: value' of each field, joined."""
    return F.concat_ws(separator, *(F.concat(F.lit(f"{k}: "), F.array_join(v, ", ")) for k, v in fields.items()))


def compact_music(title: Column, artist: Column, album: Column, tags: Column, most_tags: int) -> Column:
    """'track X; artist Y; album Z; tags a, b' with what is there, and the first tags only."""
    part = lambda label, text: F.when(text != "", F.concat(F.lit(label + " "), text))
    shown = [part(label, F.array_join(c, ", ")) for label, c in (("track", title), ("artist", artist), ("album", album))]
    return F.concat_ws("; ", *shown, part("tags", F.array_join(F.slice(tags, 1, most_tags), ", ")))


def popularity(x: Column) -> Column:
    """A finite number, or 0."""
    y = x.try_cast("double")
    return F.when(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")), 0.0).otherwise(y)


def duration_ms(x: Column) -> Column:
    """Milliseconds: nothing known is 210 s, small numbers are seconds."""
    y = F.coalesce(x.try_cast("double"), F.lit(0.0))
    return F.when(y <= 0, 210_000.0).when(y < 10_000, y * 1000).otherwise(y)


def relevance(rank: Column) -> Column:
    return F.when(rank > 0, 1 / F.log2(rank + 1.0)).otherwise(0.0)


def novelty(count: Column, turns: Column, scaled: bool = True) -> Column:
    """ln((T+1)/(c+1)), by default over ln(T+1); 0 without turns."""
    raw = F.log((turns + 1.0) / (count + 1.0))
    return F.when(turns <= 0, 0.0).otherwise(raw / F.log(turns + 1.0) if scaled else raw)


def points(score: Column, base: float, target: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10.0 * (score - base) / (target - base)))


def unit(vector: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(vector, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b))))
    same = lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)
    return F.size(F.filter(places, lambda i: same(i) & (F.length(a) > 0) & (F.length(b) > 0)))


def reasonable_title(query: Column, title: Column) -> Column:
    """Compact forms are equal, or close in length with a long common prefix."""
    low = F.least(F.length(query), F.length(title))
    near = (F.greatest(F.length(query), F.length(title)) >= 4) & (F.abs(F.length(query) - F.length(title)) <= 2)
    return (query != "") & (title != "") & ((query == title) | (near & (common_prefix(query, title) >= F.greatest(F.lit(3), low - 2))))


def match_contains(query: Column, value: Column) -> Column:
    """Similarity of normalised names where one holds the other: null if neither does."""
    n, m = F.length(query), F.length(value)
    return (
        F.when((query == "") | (value == ""), 0.0).when(query == value, 1.0)
        .when(F.contains(value, query), 0.9 + 0.09 * n / m)
        .when(F.contains(query, value), 0.72 + 0.17 * m / n)
    )


def exact_score(query: Column, title: Column, artist: Column, album: Column) -> Column:
    """How well normalised names stand in a normalised query: title 6 as a phrase, 3 with all tokens, 1.5 * share from
    half of them; artist 4, 2, share; album 1 as a phrase; 5 more if title and artist are both phrases."""
    from rankloom.functions.text import overlap, phrase

    def graded(value: Column, whole: float, full: float, part: float) -> Column:
        share = overlap(query, value)
        return F.when(phrase(query, value), whole).when(share == 1.0, full).when(share >= 0.5, part * share).otherwise(0.0)

    both = F.when(phrase(query, title) & phrase(query, artist), 5.0).otherwise(0.0)
    return F.round(graded(title, 6.0, 3.0, 1.5) + graded(artist, 4.0, 2.0, 1.0) + F.when(phrase(query, album), 1.0).otherwise(0.0) + both, 9)
