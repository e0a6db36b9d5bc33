"""Tag features of tracks, playlist profiles, and choosing few tracks from a ranked pool."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.functions.scalars import duration_ms
from rankloom.functions.text import plain
from rankloom.operators.groups import by_block, coded, dealt, shared, slabs


def classify_tags(tracks: DataFrame, aliases: DataFrame, id_col: str = "track_id", parts: int | None = None) -> DataFrame:
    """(track_id, kind, feature) of the genres and moods that a track's tags name. aliases is a small literal table.

    Dealt by track to `parts` partitions, a task keeps no more than its share of the rows, however large a file it reads.
    """
    tags = tracks.select(id_col, F.explode("tag_list").alias("tag")).select(id_col, plain(F.col("tag")).alias("alias"))
    known = aliases.where(F.col("kind").isin("genre", "mood"))
    return dealt(tags.join(F.broadcast(known), "alias").select(id_col, "kind", F.col("canonical").alias("feature")), parts, id_col).distinct()


def track_style(tracks: DataFrame, aliases: DataFrame, id_col: str = "track_id", parts: int | None = None) -> DataFrame:
    """(track_id, feature, weight): a genre weighs 1 and a style 2, however many tags name it."""
    tags = tracks.select(id_col, F.explode("tag_list").alias("tag")).select(id_col, plain(F.col("tag")).alias("alias"))
    found = tags.join(F.broadcast(aliases.where(F.col("kind").isin("genre", "style"))), "alias").select(id_col, "canonical", "kind")
    return dealt(found, parts, id_col).groupBy(id_col, F.col("canonical").alias("feature")).agg(F.max(F.when(F.col("kind") == "style", 2.0).otherwise(1.0)).alias("weight"))


def preferences(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, feature) of the genres and moods whose alias stands in a text as whole words.

    A text yields its runs of words as long as the longest alias, and these meet the aliases in an equi-join; every
    text against every alias would be a product.
    """
    known = aliases.where(F.col("kind").isin("genre", "mood"))
    most = known.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    words = F.split(plain(F.col(text_col)), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))))
    rows = texts.select(id_col, F.explode(F.array_distinct(runs)).alias("alias"))
    return rows.join(F.broadcast(known), "alias").select(id_col, "kind", F.col("canonical").alias("feature")).distinct()


def profile(entries: DataFrame, features: DataFrame, key: str = "id", parts: int | None = None) -> DataFrame:
    """(key, kind, feature, votes): one vote a track of the list. entries (key, track_id), features of classify_tags."""
    held = features.groupBy("track_id").agg(F.collect_set(F.struct("kind", "feature")).alias("features"))
    rows = described(entries.select(key, "track_id"), held, key, parts).dropDuplicates([key, "track_id"])
    return rows.select(key, F.inline("features")).groupBy(key, "kind", "feature").agg(F.count("*").alias("votes"))


def described(candidates: DataFrame, traits: DataFrame, key: str | None = "id", parts: int | None = None, how: str = "inner") -> DataFrame:
    """Candidates (key, track_id, ...) with the traits of their tracks (track_id, ...), one row a track, dealt by key to
    `parts` partitions; without a key, as they stand by track. Candidates are many times as many as tracks: they are shuffled by track and back by key, and not
    sorted, since a task hashes its share of the tracks."""
    rows = dealt(candidates, parts, "track_id").join(dealt(traits, parts, "track_id").hint("shuffle_hash"), "track_id", how)
    return rows if key is None else dealt(rows, parts, key)


def _vectors(styles: DataFrame) -> DataFrame:
    """(track_id, style): the length of a track's style vector, and its parts in the order of features."""
    parts = F.sort_array(F.collect_list(F.struct("feature", "weight")))
    return styles.groupBy("track_id").agg(F.struct(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), parts.alias("parts")).alias("style"))


def _seeds() -> tuple[Column, Column]:
    """Of the seeds of a list: their different style vectors, and the features of these."""
    vectors = F.collect_set("style")
    return vectors.alias("seeds"), F.array_distinct(F.flatten(F.transform(vectors, lambda s: s["parts"]["feature"]))).alias("liked")


def _likeness(own: Column, seeds: Column, features: Column) -> Column:
    """The best cosine of a style vector with any of others, which have these features between them; 0 without."""
    weight = lambda of, x: F.coalesce(F.get(F.filter(of["parts"], lambda y: y["feature"] == x["feature"]), F.lit(0))["weight"], F.lit(0.0))
    dot = lambda b: F.aggregate(own["parts"], F.lit(0.0), lambda acc, x: acc + x["weight"] * weight(b, x))
    near = F.array_max(F.transform(seeds, lambda b: F.round(dot(b) / (own["norm"] * b["norm"]), 9)))
    # most tracks have no style, or the very one of a seed: only the others need the sums
    return F.when(own.isNull() | F.coalesce(F.size(seeds) <= 0, F.lit(True)), 0.0).when(F.array_contains(seeds, own), 1.0).when(F.arrays_overlap(own["parts"]["feature"], features), F.coalesce(near, F.lit(0.0))).otherwise(0.0)


def similarity(candidates: DataFrame, seeds: DataFrame, styles: DataFrame, key: str = "id", parts: int | None = None) -> DataFrame:
    """(key, track_id, similarity): the best cosine of style vectors between a candidate and any seed of its list.

    The different vectors of a list's seeds meet its candidates as one value, so that pairs are never rows.
    """
    vectors = _vectors(styles)
    held = described(seeds.select(key, "track_id"), vectors, key, parts).groupBy(key).agg(*_seeds())
    rows = candidates.select(key, "track_id").distinct()
    rows = described(rows, vectors, key, parts, "left").join(held.hint("shuffle_hash"), key, "left")
    return rows.select(key, "track_id", _likeness(F.col("style"), F.col("seeds"), F.col("liked")).alias("similarity"))


def playlist_scores(candidates: DataFrame, seeds: DataFrame, tracks: DataFrame, styles: DataFrame, tags: DataFrame, wanted: DataFrame | None = None, key: str = "id", parts: int | None = None, pool: Column | None = None) -> DataFrame:
    """(key, rank, track_id, similarity, same_artist, score, artists) of the candidates (key, rank, track_id) that fit a
    list.

    score is similarity + 0.15 for a known artist + 0.2 * shares of the wanted features (key, kind, feature) that the
    track has + 0.05 / rank. Where any seed has a style, unlike tracks by other artists go.

    With pool, which says for a key of seeds whose candidates a list has, candidates are those of pools (pool, rank,
    track_id), and the lists are those of the seeds: a pool meets its tracks once, however many lists share it, and its
    candidates in the catalog reach a list as one value. So the rows of a list stand together in the order of ranks.
    """
    traits = tracks.select("track_id", F.transform("artist_name", plain).alias("artists")).join(_vectors(styles), "track_id", "full_outer")
    known = F.array_distinct(F.flatten(F.collect_set("artists"))).alias("known")
    if pool is None:
        held = described(seeds.select(key, "track_id"), traits, key, parts).groupBy(key).agg(*_seeds(), known)
        rows = described(candidates.select(key, "rank", "track_id"), traits, key, parts, "left").join(held.hint("shuffle_hash"), key, "left")
    else:
        own = described(seeds.select(key, "track_id"), traits, None, parts, "left").withColumn("pool", pool)
        held = dealt(own, parts, "pool").groupBy("pool", key).agg(*_seeds(), known)
        of = described(candidates.select("pool", "rank", "track_id"), traits, "pool", parts)
        of = of.groupBy("pool").agg(F.sort_array(F.collect_list(F.struct("rank", "track_id", "artists", "style"))).alias("candidates"))
        rows = held.join(of.hint("shuffle_hash"), "pool").select(key, "seeds", "liked", "known", F.inline("candidates"))
    same = F.coalesce(F.arrays_overlap("artists", "known"), F.lit(False)).cast("int")
    styled = F.coalesce(F.size("seeds") > 0, F.lit(False))
    rows = rows.select(key, "rank", "track_id", "artists", same.alias("same_artist"), styled.alias("styled"), _likeness(F.col("style"), F.col("seeds"), F.col("liked")).alias("similarity"))
    rows = rows.where(~F.col("styled") | (F.col("similarity") >= 0.25) | (F.col("same_artist") == 1))
    fit = F.lit(0.0)
    if wanted is not None:
        asked = wanted.select(key, "kind", "feature").distinct()
        total = asked.groupBy(key, "kind").agg(F.count("*").alias("asked"))
        held = rows.select(key, "track_id").join(tags, "track_id").join(asked, [key, "kind", "feature"]).groupBy(key, "track_id", "kind").agg(F.count("*").alias("held"))
        fits = held.join(total, [key, "kind"]).groupBy(key, "track_id").agg(F.sum(F.col("held") / F.col("asked")).alias("fit"))
        rows, fit = rows.join(fits, [key, "track_id"], "left"), F.coalesce("fit", F.lit(0.0))
    score = F.round(F.col("similarity") + 0.15 * F.col("same_artist") + 0.2 * fit + 0.05 / F.col("rank"), 9)
    return rows.select(key, "rank", "track_id", "similarity", "same_artist", score.alias("score"), "artists")


def reasons(candidates: DataFrame, seeds: DataFrame, features: dict[str, DataFrame], key: str = "id", parts: int | None = None, most: int = 3, lists: DataFrame | None = None) -> DataFrame:
    """candidates (key, track_id, ...) with a column for each kind of features (track_id, feature): the first names that a
    candidate shares with the seeds of its list, joined; null if it shares none.

    With lists (key, pool), candidates are those of pools (pool, track_id, ...), and every list has the ones of its pool:
    a pool meets its tracks once, however many lists share it, and what a list has of it is not shuffled.
    """
    traits = None
    for kind, rows in features.items():
        own = rows.groupBy("track_id").agg(F.sort_array(F.collect_set("feature")).alias(kind))
        traits = own if traits is None else traits.join(own, "track_id", "full_outer")
    known = described(seeds.select(key, "track_id"), traits, key, parts).groupBy(key).agg(*(F.array_distinct(F.flatten(F.collect_set(kind))).alias(f"{kind}_known") for kind in features)).hint("shuffle_hash")
    if lists is None:
        rows = described(candidates, traits, key, parts, "left").join(known, key, "left")
    else:
        held = dealt(dealt(lists.select(key, "pool"), parts, key).join(known, key, "left"), parts, "pool")
        rows = held.join(described(candidates, traits, "pool", parts, "left").hint("shuffle_hash"), "pool")
    names = lambda kind: F.array_join(F.slice(F.array_intersect(kind, f"{kind}_known"), 1, most), ", ")
    found = (F.when(F.arrays_overlap(kind, f"{kind}_known"), names(kind)).alias(kind) for kind in features)
    return rows.select(key, *(c for c in candidates.columns if c not in (key, "pool")), *found)


# Greedy choices look at what was chosen before: each round chooses the next track of all the lists of a block.


def _chosen(rows: pa.Table, starts: np.ndarray, limit: int, key: str, begin: Callable, worth: Callable, took: Callable) -> pa.Table:
    """(key, place, track_id) of rounds in which each list takes the track of most worth, the first of equals.

    begin(places) is what is known of the tracks at these places, a list a row; worth(known, state) is what they are
    worth; took(known, best, state) is the state after these were chosen, None before.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for at, there in slabs(starts, rows.num_rows):
        known, state, lists = begin(at), None, np.arange(len(at))
        gone = np.where(there, 0.0, -np.inf)
        for place in range(1, min(limit, at.shape[1]) + 1):
            at_best = (lists, np.argmax(np.round(worth(known, state), 9) + gone, axis=1))
            live = gone[at_best] == 0
            out.append((at[at_best][live], np.full(live.sum(), place)))
            state = took(known, at_best, state)
            gone[at_best] = -np.inf
    found, places = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
    of = pa.array(found)
    return pa.table({key: rows.column(key).take(of), "place": pa.array(places, pa.int32()), "track_id": rows.column("track_id").take(of)})


def select_matches(scores: DataFrame, tracks: DataFrame, limit: int, key: str = "id", parts: int | None = None, placed: bool = False) -> DataFrame:
    """(key, place, track_id): of scored tracks the best again and again, less 0.12 for each earlier track by the same
    artist; the better rank wins a tie. Scores that have the artists of their tracks, as playlist_scores gives them, are
    not joined with tracks. Scores placed as by_block says, as those of pools are, are not shuffled."""
    rows = scores if "artists" in scores.columns else described(scores, tracks.select("track_id", F.transform("artist_name", plain).alias("artists")), key, parts)
    rows = rows.select(key, "rank", "track_id", "score", "artists")

    def choose(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        names, score = coded(rows.column("artists")), rows.column("score").to_numpy()

        def worth(own: tuple, seen: np.ndarray | None) -> np.ndarray:
            return own[0] if seen is None else own[0] - 0.12 * seen.max(axis=2)

        def took(own: tuple, best: tuple, seen: np.ndarray | None) -> np.ndarray:
            return shared(own[1], own[1][best]).astype(int) + (0 if seen is None else seen)

        return _chosen(rows, starts, limit, key, lambda at: (score[at], names[at]), worth, took)

    kind = scores.schema[key].dataType.simpleString()
    return by_block(rows, [key], ["rank"], choose, f"{key} {kind}, place int, track_id string", parts, placed)


def select_diverse(candidates: DataFrame, tracks: DataFrame, tags: DataFrame, limit: int, wanted: DataFrame, key: str = "id", parts: int | None = None) -> DataFrame:
    """(key, place, track_id): a ranked pool reordered by relevance, wanted features and new genres and artists.

    A track is worth 1 - (rank - 1) / pool + 0.22 * share of wanted genres + 0.12 * share of wanted moods + 0.05 for
    each wanted genre not covered yet, and + 0.1 for a new artist or - 0.14 for one already chosen.
    """
    held = tags.groupBy("track_id").agg(F.sort_array(F.collect_set(F.concat_ws("/", "kind", "feature"))).alias("features"))
    of = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.concat_ws("/", "kind", "feature"))))
    asked = dealt(wanted, parts, key).groupBy(key).agg(of("genre").alias("genres"), of("mood").alias("moods"))
    artist = F.when(F.size("artist_name") > 0, plain(F.get("artist_name", F.lit(0)))).otherwise("")
    traits = tracks.select("track_id", artist.alias("artist")).join(held, "track_id", "left")
    rows = described(candidates.select(key, "rank", "track_id"), traits, key, parts).join(asked.hint("shuffle_hash"), key, "left")
    own = {c: F.coalesce(F.array_intersect(c, "features"), F.array().cast("array<string>")) for c in ("genres", "moods")}
    fit = lambda weight, c: F.lit(weight) * F.size(own[c]) / F.greatest(F.lit(1), F.size(c))
    rows = rows.select(key, "rank", "track_id", F.coalesce("artist", F.lit("")).alias("artist"), own["genres"].alias("genres"), (fit(0.22, "genres") + fit(0.12, "moods")).alias("fit"))

    def choose(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        genres = coded(rows.column("genres"))
        artist = pc.dictionary_encode(rows.column("artist")).combine_chunks().indices.to_numpy()
        variety, empty = np.where(pc.equal(rows.column("artist"), "").to_numpy(), 0.0, 0.10), pc.equal(rows.column("artist"), "").to_numpy()
        size = np.diff(np.append(starts, rows.num_rows))
        base = 1.0 - (np.arange(rows.num_rows) - np.repeat(starts, size)) / np.repeat(size, size) + rows.column("fit").to_numpy()

        def begin(at: np.ndarray) -> tuple:
            return base[at], genres[at], artist[at], variety[at], empty[at]

        def worth(own: tuple, state: tuple | None) -> np.ndarray:
            base, genres, _, variety, _ = own
            covered, variety = state or (False, variety)
            return base + 0.05 * ((genres >= 0) & ~np.asarray(covered)).sum(axis=2) + variety

        def took(own: tuple, best: tuple, state: tuple | None) -> tuple:
            _, genres, artist, variety, empty = own
            covered, variety = state or (False, variety)
            return covered | shared(genres, genres[best]), np.where((artist == artist[best][:, None]) & ~empty, -0.14, variety)

        return _chosen(rows, starts, limit, key, begin, worth, took)

    kind = candidates.schema[key].dataType.simpleString()
    return by_block(rows, [key], ["rank"], choose, f"{key} {kind}, place int, track_id string", parts)


def target_minutes(text: Column) -> Column:
    """Minutes that a description asks for."""
    t = F.lower(text)
    return F.when(t.rlike(r"\b(party|road trip|long trip)\b"), 75).when(t.rlike(r"\b(short|quick)\b"), 20).when(t.rlike(r"\bcommute\b"), 30).otherwise(45)


def duration_prefix(candidates: DataFrame, minutes: Column | int, least: Column | int, key: str = "id", most: int = 20) -> DataFrame:
    """(key, place, track_id, duration_ms): tracks in order until there are `least` of them and the minutes are filled.

    candidates (key, rank, track_id, duration): a track is taken while those before it are too few or too short.
    """
    before = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = candidates.withColumn("ms", duration_ms(F.col("duration")))
    place = F.row_number().over(Window.partitionBy(key).orderBy("rank"))
    n = F.count("*").over(Window.partitionBy(key))
    rows = rows.withColumns({"place": place, "so_far": F.coalesce(F.sum("ms").over(before), F.lit(0.0)), "n": n})
    need = F.least(F.lit(least) if isinstance(least, int) else least, F.col("n"))
    open_ = (F.col("place") - 1 < need) | (F.col("so_far") < (F.lit(minutes) if isinstance(minutes, int) else minutes) * 60_000.0)
    return rows.where(open_ & (F.col("place") <= most)).select(key, "place", "track_id", F.col("ms").alias("duration_ms"))


def playlist_query(entries: DataFrame, tracks: DataFrame, tags: DataFrame, styles: DataFrame, key: str = "id") -> DataFrame:
    """(key, query): a catalog query from a list (key, pos, track_id): genres by votes, four moods, and the styles,
    artists and titles of its last five tracks."""
    votes = profile(entries, tags, key)
    cut = lambda c, n: c if n is None else F.slice(c, 1, n)
    named = lambda k, n: F.array_join(F.transform(cut(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct((-F.col("votes")).alias("v"), F.col("feature").alias("f"))))), n), lambda s: s["f"]), ", ")
    tastes = votes.groupBy(key).agg(named("genre", None).alias("genres"), named("mood", 4).alias("moods"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("pos")))
    last = entries.withColumn("p", place).where(F.col("p") <= 5).join(tracks, "track_id")
    own = styles.where("weight > 1").groupBy("track_id").agg(F.sort_array(F.collect_list("feature")).alias("styles"))
    last = last.join(own, "track_id", "left")
    pick = lambda c: F.array_join(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), c.alias("x")))), lambda s: F.coalesce(s["x"], F.array().cast("array<string>"))))), ", ")
    recent = last.groupBy(key).agg(pick(F.col("styles")).alias("styles"), pick(F.slice("artist_name", 1, 2)).alias("artists"), pick(F.slice("track_name", 1, 1)).alias("titles"))
    part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    shown = F.concat_ws("; ", part("preferred genres: ", "genres"), part("preferred moods: ", "moods"), part("styles: ", "styles"), part("artists: ", "artists"), part("tracks similar to: ", "titles"))
    return recent.join(tastes, key, "left").select(key, shown.alias("query"))
