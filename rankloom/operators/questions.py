"""Questions about who performs something: typed slots as relations, tried in order and relaxed step by step.

A question names a track or an album, and may name an artist and an album that hold it ("who sang X by Y on Z"). Any of
these words can be part of a real name, so every way to read a question is a row: the whole as a title or an album, what
follows its last "by" as an artist, what follows each "on", "from" or "in" as an album. All rows meet the index of names
in one equi-join; of the readings that name something the first in a fixed order counts. Names that fit nothing exactly
are sought again among close names. What the slots of a question name is then intersected over tracks, again by joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.functions import messages as M, scalars
from rankloom.functions.text import name as normal
from rankloom.operators import search
from rankloom.sources.storage import staged

#: The verbs of performers, and what stands for the track that was spoken of last.
VERBS = ("sang", "sing", "sings", "sung", "perform", "performs", "performed", "recorded", "said")
SAME = ("it", "this", "that", "this song", "that song", "this track", "that track")
TYPES, BY, ON = ("song", "track", "album"), ("by",), ("on", "from", "in")
#: Places of a list of choices.
CHOICES = 5


def _is(words: Column, at: Column, of: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(F.get(words, at)["w"]).isin(*of), F.lit(False))


def _places(words: Column, of: tuple[str, ...]) -> Column:
    """Where such a word stands between others, from 0."""
    inner = F.when(F.size(words) > 2, F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.filter(inner, lambda i: _is(words, i, of))


def _text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda x: x["w"]), " ")


def _upto(words: Column, at: Column) -> Column:
    return F.slice(words, F.lit(1), F.greatest(at, F.lit(0)))


def _after(words: Column, at: Column) -> Column:
    return F.slice(words, at + 2, F.greatest(F.size(words) - at - 1, F.lit(0)))


def _variants(words: Column) -> Column:
    """Ways to read an album: as it is, without "album" or "the album" before it or "the", and each without "album" behind."""

    def without(lead: tuple[tuple[str, ...], ...]) -> Column:
        fits = reduce(lambda a, b: a & b, (_is(words, F.lit(i), w) for i, w in enumerate(lead))) & (F.size(words) > len(lead))
        return F.when(fits, _after(words, F.lit(len(lead) - 1))).otherwise(words)

    bare = F.when(_is(words, F.lit(0), ("the",)) & _is(words, F.lit(1), ("album",)), without((("the",), ("album",)))).otherwise(without((("album",),)))
    forms = [words, bare, without((("the",),))]
    short = lambda w: F.when((F.size(w) > 1) & _is(w, F.size(w) - 1, ("album",)), _upto(w, F.size(w) - 1)).otherwise(w)
    return F.transform(F.flatten(F.array(F.array(*forms), F.transform(F.array(*forms), short))), lambda w: M._bare(_text(w)))


def parsed(questions: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(id, words, kind, same) of the questions about performers: the words of what they ask about (w, p), the type that
    they give it (song or album, null if none), and whether it is the track spoken of last."""
    words = M._written(F.regexp_replace(F.trim(text_col), "[.!?]+$", ""))
    rows = questions.select(id_col, words.alias("all"))
    rows = rows.where(_is(F.col("all"), F.lit(0), ("who",)) & _is(F.col("all"), F.lit(1), VERBS) & (F.size("all") > 2)).select(id_col, _after(F.col("all"), F.lit(1)).alias("words"))
    rows = rows.withColumn("same", F.lower(_text(F.col("words"))).isin(*SAME))
    w = F.col("words")
    article = _is(w, F.lit(0), ("the",)) & _is(w, F.lit(1), TYPES)
    at = F.when(article, 1).when(_is(w, F.lit(0), TYPES), 0)
    at = F.when(F.size(w) > at + 1, at)
    kind = F.when(_is(w, at, ("album",)), "album").when(at.isNotNull(), "song")
    return rows.select(id_col, F.when(at.isNotNull() & ~F.col("same"), _after(w, at)).otherwise(w).alias("words"), F.when(~F.col("same"), kind).alias("kind"), "same")


def _reading(kind: str, slot: str, words: Column, base: int = 0, at: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(slot).alias("slot"), F.lit(base).alias("base"), (F.lit(0) if at is None else at).cast("int").alias("at"), words.alias("words"))


def _texts(rows: DataFrame, readings: Column, id_col: str) -> DataFrame:
    """(id, kind, slot, base, at, variant, text): readings as text, albums in all their variants."""
    each = rows.select(id_col, F.explode(readings).alias("x")).select(id_col, "x.*")
    texts = F.when(F.col("kind") == "album", _variants(F.col("words"))).otherwise(F.array(_text(F.col("words"))))
    return each.select(id_col, "kind", "slot", "base", "at", F.posexplode(texts).alias("variant", "text"))


def _known(readings: DataFrame, index: DataFrame, id_col: str) -> DataFrame:
    """Readings (id, kind, slot, base, at, variant, text) that are full names but for spaces, with the names."""
    asked = readings.where("text <> ''").withColumn("compact", F.replace(normal(F.col("text")), F.lit(" "), F.lit("")))
    names = index.where("full").select("kind", "name", F.replace("name", F.lit(" "), F.lit("")).alias("compact"))
    return asked.join(names, ["kind", "compact"]).groupBy(id_col, "slot", "base", "at", "variant").agg(F.sort_array(F.collect_list("name")).alias("names"))


def _first(slot: str, base: int = 0) -> Column:
    """The names of the first reading of a slot that has some, with its place."""
    here = (F.col("slot") == slot) & (F.col("base") == base)
    return F.min_by(F.when(here, F.struct("at", "names")), F.when(here, F.struct("at", "variant")))


def slots(asked: DataFrame, index: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(id, target, artist, album, titles, albums, artists, held): what each parsed question names.

    target, artist and album are its words; titles and albums the names that the target can be, artists those of the
    artist, held those of the album that holds it, all empty where nothing fits.
    """
    w, by = F.col("words"), F.col("by")
    asked = staged(asked.where("not same").withColumn("by", F.try_element_at(_places(w, BY), F.lit(-1))).withColumn("head", F.when(by.isNotNull(), _upto(w, by))), "asked")
    none = F.array().cast("array<string>")
    clauses = lambda words, base: F.transform(_places(words, ON), lambda i: _reading("album", "clause", _after(words, i), base, i))
    some = lambda c, x: F.filter(x, lambda r: F.coalesce(c, F.lit(False)))
    known = by.isNotNull()
    artist, head = some(known, F.array(_reading("artist", "by", F.coalesce(_after(w, by), w)))), F.coalesce("head", F.slice(w, 1, 0))
    readings = _texts(asked, F.concat(F.array(_reading("title", "title", w), _reading("album", "album", w)), artist, clauses(w, 0), clauses(head, 1)), id_col)
    found = _known(readings, index, id_col).groupBy(id_col).agg(*(_first(s, b).alias(n) for n, s, b in (("title", "title", 0), ("album", "album", 0), ("by_name", "by", 0), ("clause0", "clause", 0), ("clause1", "clause", 1))))
    rows = asked.join(found, id_col, "left")
    # a whole name is read as such; else an artist that is known goes first, then an album
    whole = F.col("title").isNotNull() | F.col("album").isNotNull()
    cut = ~whole & F.col("by_name").isNotNull()
    rows = rows.select(id_col, "kind", "title", "album", whole.alias("whole"), cut.alias("cut"), F.when(cut, F.col("head")).otherwise(w).alias("base"), F.when(cut, _after(w, by)).alias("artist"), F.when(~whole, F.when(cut, F.col("clause1")).otherwise(F.col("clause0"))).alias("clause"))
    base = F.col("base")
    at = F.when(~F.col("whole"), F.coalesce(F.col("clause")["at"], F.try_element_at(_places(base, ON), F.lit(-1))))
    rows = rows.withColumn("on", at).withColumn("target", F.when(F.col("on").isNotNull(), _upto(base, F.col("on"))).otherwise(base))
    rows = rows.withColumn("inner", F.when(~F.col("whole") & F.col("artist").isNull(), F.try_element_at(_places(F.col("target"), BY), F.lit(-1))))
    inner = F.col("inner")
    rows = rows.select(
        id_col, "kind", "whole", F.when(inner.isNotNull(), _upto(F.col("target"), inner)).otherwise(F.col("target")).alias("target"), F.when(inner.isNotNull(), _after(F.col("target"), inner)).otherwise(F.col("artist")).alias("artist"),
        F.when(F.col("on").isNotNull(), _after(base, F.col("on"))).alias("on_words"), F.coalesce(F.col("title.names"), none).alias("title"), F.coalesce(F.col("album.names"), none).alias("album"), F.coalesce(F.col("clause.names"), none).alias("held"),
    )
    rows = staged(rows, "read")
    kind = F.coalesce("kind", F.lit(""))
    wants_title = (kind != "album") & (F.size("title") == 0) & (~F.col("whole") | (kind == "song"))
    wants_album = (kind != "song") & (F.size("album") == 0) & ((kind == "album") | (~F.col("whole") & F.col("on_words").isNull()))
    target = F.col("target")
    # sought exactly and then by close names; an album's close names by the reading without "album" before it
    or_target = lambda c: F.coalesce(F.col(c), target)
    again = F.concat(
        some(wants_title, F.array(_reading("title", "title", target))), some(wants_album, F.array(_reading("album", "album", target))), some(F.col("artist").isNotNull(), F.array(_reading("artist", "artist", or_target("artist")))),
        some(F.col("on_words").isNotNull() & (F.size("held") == 0), F.array(_reading("album", "held", or_target("on_words")))),
    )
    second = staged(_texts(rows, again, id_col), "readings")
    exact = _known(second, index, id_col).groupBy(id_col, "slot").agg(F.min_by("names", "variant").alias("names"))
    exact = staged(exact, "exact")
    fuzzy = second.where("variant = if(kind = 'album', 1, 0)").join(exact.select(id_col, "slot"), [id_col, "slot"], "left_anti")
    fuzzy = fuzzy.select(F.struct(id_col, "slot").alias("key"), "kind", "text")
    near = search.slot_match_fuzzy(fuzzy, index, "key").groupBy("key").agg(F.sort_array(F.collect_set("name")).alias("names")).select(f"key.{id_col}", "key.slot", "names")
    both = exact.unionByName(near).groupBy(id_col).agg(*(F.first(F.when(F.col("slot") == s, F.col("names")), True).alias(f"new_{s}") for s in ("title", "album", "artist", "held")))
    out = rows.join(both, id_col, "left")
    pick = lambda old, new: F.when(F.size(old) > 0, F.col(old)).otherwise(F.coalesce(new, none))
    return out.select(
        id_col, _text(target).alias("target"), _text(F.col("artist")).alias("artist"), M._bare(_text(F.col("on_words"))).alias("album"), F.when(kind == "album", none).otherwise(pick("title", "new_title")).alias("titles"),
        F.when(kind == "song", none).otherwise(pick("album", "new_album")).alias("albums"), F.coalesce("new_artist", none).alias("artists"), pick("held", "new_held").alias("held"),
    )


def read(questions: DataFrame, index: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """slots of the questions about performers; equal questions are read once, so that what the joins of readings write
    or send grows with the different texts."""
    each = questions.select(id_col, F.col(text_col).alias("text")).where("text is not null").withColumn("class", F.md5(F.concat(F.length("text").cast("string"), F.lit(" "), "text")))
    classes = staged(each.select("class", "text").distinct(), "classes")
    found = staged(slots(parsed(classes, "class"), staged(index.select("kind", "name", "full"), "index"), "class"), "slots")
    return each.select(id_col, "class").join(found, "class").drop("class")


def _best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, track_id, popularity): the CHOICES most popular tracks of each combination of names."""
    order = Window.partitionBy(*keys).orderBy(F.desc("popularity"), "track_id")
    return rows.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= CHOICES).select(*keys, "track_id", "popularity")


def _candidates(live: DataFrame, names: DataFrame, tracks: DataFrame, id_col: str) -> DataFrame:
    """(id, track_id, popularity): the CHOICES best tracks, or all if fewer, that fit the title, and the artist and the
    album where a question gives them.

    Questions meet the combinations of names that they ask for, of which only the best tracks are kept, so a name that
    very many tracks share brings no more rows than another.
    """
    of = lambda kind: names.where(F.col("kind") == kind).select(F.col("name").alias(kind), "track_id")
    wanted = live.select(F.explode("titles").alias("title")).distinct()
    base = of("title").join(wanted, "title", "left_semi").join(tracks.select("track_id", scalars.popularity(F.col("popularity")).alias("popularity")), "track_id")
    by, on = F.col("artist").isNotNull(), F.col("album").isNotNull()
    found = None
    for given, kinds in ((~by & ~on, []), (by & ~on, ["artist"]), (~by & on, ["album"]), (by & on, ["artist", "album"])):
        rows = live.where(given).select(id_col, F.explode("titles").alias("title"), "artists", "held")
        known = base
        for kind, column in (("artist", "artists"), ("album", "held")):
            if kind in kinds:
                rows, known = rows.withColumn(kind, F.explode(column)), known.join(of(kind), "track_id")
        keys = ["title", *kinds]
        each = rows.select(id_col, *keys).join(_best(known.select(*keys, "track_id", "popularity"), keys), keys).select(id_col, "track_id", "popularity")
        found = each if found is None else found.union(each)
    return found


def _quoted(before: str, x: Column, after: str) -> Column:
    return F.concat(F.lit(before + "‘"), x, F.lit("’" + after))


def answered(questions: DataFrame, tracks: DataFrame, id_col: str = "query_id", text_col: str = "text", last_col: str | None = None) -> DataFrame:
    """(id, outcome, answer, track_ids) of the questions about performers.

    outcome: `track` with one track that is answered, `choose` with five at most, the most popular first and the smaller
    id among equals, `album` with its performers, `which_album`, or what could not be found: `no_artist`, `no_album`,
    `no_name`, `no_track`. last_col holds the id of the track spoken of last, if one was. Equal questions are answered
    once.
    """
    last = F.col(last_col) if last_col is not None else F.lit(None).cast("string")
    each = questions.select(id_col, F.col(text_col).alias("text"), last.alias("last")).where("text is not null")
    each = staged(each.withColumn("class", F.md5(F.concat(F.length("text").cast("string"), F.lit(" "), "text", F.coalesce("last", F.lit("")), F.col("last").isNull().cast("string")))), "asked")
    answers = _resolved(staged(each.select("class", "text", "last").distinct(), "classes"), tracks)
    return each.select(id_col, "class").join(answers, "class").drop("class")


def _resolved(questions: DataFrame, tracks: DataFrame) -> DataFrame:
    """(class, outcome, answer, track_ids) of different questions (class, text, last)."""
    key = "class"
    names = staged(search._names(tracks), "names")
    index = staged(search.name_index(tracks), "index")
    asked = staged(parsed(questions, key), "questions")
    rows = slots(asked, index, key)
    shown = tracks.select("track_id", scalars.display(F.col("track_name")).alias("title"), scalars.display(F.col("artist_name")).alias("by"), scalars.display_track(F.col("track_name"), F.col("artist_name"), F.col("album_name")).alias("line"), scalars.popularity(F.col("popularity")).alias("popularity"))
    size = lambda c: F.size(c) > 0
    missing = F.when(F.col("artist").isNotNull() & ~size("artists"), "no_artist").when(F.col("album").isNotNull() & ~size("held"), "no_album").when(~size("titles") & ~size("albums"), "no_name").when(~size("titles"), "album").otherwise("track")
    rows = staged(rows.withColumn("way", missing), "ways")
    lost = rows.where(F.col("way").isin("no_artist", "no_album", "no_name"))
    text = F.when(F.col("way") == "no_artist", _quoted("I couldn't find the artist ", F.col("artist"), " in the catalog. Please check the name.")).when(F.col("way") == "no_album", _quoted("I couldn't find the album ", F.col("album"), " in the catalog. Please check the name.")).otherwise(_quoted("I couldn't find a track or album matching ", F.col("target"), " in the catalog."))
    none = F.array().cast("array<string>")
    out = lost.select(key, F.col("way").alias("outcome"), text.alias("answer"), none.alias("track_ids"))
    live = rows.where("way = 'track'")
    found = _candidates(live, names, tracks, key).select(key, "track_id")
    last = questions.where("last is not null").select(key, F.col("last").alias("track_id"))
    # a title that is asked for again without more is the track spoken of last
    again = live.where("artist is null and album is null").select(key, F.try_element_at("titles", F.lit(1)).alias("name")).join(last, key)
    again = staged(again.join(names.where("kind = 'title'").select("name", "track_id"), ["name", "track_id"], "left_semi").select(key, "track_id"), "again")
    same = asked.where("same").select(key)
    found = found.join(again.select(key), key, "left_anti").union(again).union(same.join(last, key).select(key, "track_id"))
    found = staged(found.distinct(), "candidates")
    order = Window.partitionBy(key).orderBy(F.desc("popularity"), "track_id")
    ranked = found.join(shown, "track_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CHOICES)
    lists = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "track_id", "line", "title", "by"))).alias("l"))
    ids = F.transform("l", lambda x: x["track_id"])
    first = F.col("l")[0]
    one = F.when(first["by"] != "", F.concat(first["title"], F.lit(" is by "), first["by"], F.lit("."))).otherwise(F.concat(F.lit("The artist for "), first["title"], F.lit(" is not listed in the catalog.")))
    many = F.concat(F.lit("Which track did you mean? Reply with its number.\n"), F.array_join(F.transform("l", lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["line"])), "\n"))
    single = F.size("l") == 1
    told = staged(lists.select(key, F.when(single, "track").otherwise("choose").alias("outcome"), F.when(single, one).otherwise(many).alias("answer"), ids.alias("track_ids")), "told")
    nothing = F.when(F.col("album").isNotNull(), F.concat(_quoted("I couldn't find a catalog track matching ", F.col("target"), ""), _quoted(" on the album ", F.col("album"), "."))).otherwise(F.concat(F.lit("I couldn't find a catalog track matching "), F.try_element_at("titles", F.lit(1)), F.lit(".")))
    bare = live.join(told.select(key), key, "left_anti").select(key, F.lit("no_track").alias("outcome"), nothing.alias("answer"), none.alias("track_ids"))
    unsaid = same.join(told.select(key), key, "left_anti").select(key, F.lit("no_track").alias("outcome"), F.lit("Which song or track should I look up?").alias("answer"), none.alias("track_ids"))
    return out.union(told).union(bare).union(unsaid).union(_albums_answered(rows.where("way = 'album'"), tracks, names, key))


def _albums_answered(rows: DataFrame, tracks: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Performers of the albums that questions name, on the tracks of the artist where a question gives one.

    Tracks are reduced to different (album, performer) and (album, artist, performer) before questions meet them.
    """
    wanted = rows.select(F.explode("albums").alias("album")).distinct()
    held = names.where("kind = 'album'").select(F.col("name").alias("album"), "track_id").join(wanted, "album", "left_semi")
    shown = tracks.select("track_id", F.explode(scalars.values(F.col("album_name"))).alias("on")).withColumn("n", normal(F.col("on")))
    by = tracks.select("track_id", F.explode_outer(scalars.values(F.col("artist_name"))).alias("by"))
    each = held.join(shown, "track_id").where("n = album").select("album", "on", "track_id").join(by, "track_id")
    artists = names.where("kind = 'artist'").select(F.col("name").alias("artist_key"), "track_id")
    free = each.select("album", "on", "by").distinct()
    strict = each.join(artists, "track_id").select("album", "artist_key", "on", "by").distinct()
    asked = rows.select(key, "artist", "artists", F.explode("albums").alias("album"))
    found = asked.where("artist is null").join(free, "album").select(key, "on", "by")
    found = found.union(asked.where("artist is not null").select(key, "album", F.explode("artists").alias("artist_key")).join(strict, ["album", "artist_key"]).select(key, "on", "by"))
    lists = found.groupBy(key).agg(F.sort_array(F.collect_set("on")).alias("on"), F.sort_array(F.collect_set("by")).alias("by"))
    out = rows.join(lists, key, "left")
    one = F.size("on") == 1
    told = F.concat(_quoted("", F.col("on")[0], " is an album. Performers credited on its catalog tracks include "), F.array_join("by", ", "), F.lit("."))
    which = F.concat(F.lit("Which album do you mean? Catalog matches: "), F.array_join("on", "; "), F.lit("."))
    none = F.concat(_quoted("I couldn't find catalog tracks from ", F.col("target"), ""), _quoted(" by ", F.coalesce("artist", F.lit("")), "."))
    outcome = F.when(F.col("on").isNull(), "no_track").when(one, "album").otherwise("which_album")
    return out.select(key, outcome.alias("outcome"), F.when(F.col("on").isNull(), none).when(one, told).otherwise(which).alias("answer"), F.array().cast("array<string>").alias("track_ids"))
