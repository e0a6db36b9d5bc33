"""User messages read by their words: routes, names, themes and choices as column expressions.

A message becomes an array of words, each as written and in a plain form. What a message asks for follows from which
words of small tables stand in it and in which order; what it names is what is left once the words of the command are
taken from its ends. All of it is higher-order functions over one short array, so nothing leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Numbers and ordinals of choices.
ORDINALS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
}
#: The words of themes, of which a request for a playlist has one at least.
THEME = (
    "mood", "genre", "style", "activity", "energy", "workout", "gym", "commute", "party", "study", "studying", "love", "sad", "happy", "upbeat", "calm", "focus", "relax",
    "relaxing", "rock", "pop", "jazz", "metal", "short", "quick", "road trip", "dinner",
)

#: Words that lead up to a command.
POLITE = ("please", "could", "can", "would", "will", "you", "i", "d", "like", "to", "want")
ADDING, REMOVING, MAKING = ("add", "put", "include"), ("remove", "delete", "take"), ("create", "make", "build", "generate")
SHOWING, EMPTYING = ("show", "view", "display", "see", "list"), ("clear", "empty", "reset", "delete all", "remove all")
LISTS, SONGS = ("playlist",), ("song", "songs", "track", "tracks", "music")


def plain_words(message: Column) -> Column:
    """The words of a message in lower case, cut at everything that is neither letter, digit nor underscore."""
    return F.regexp_extract_all(F.lower(message), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _said(message: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(plain_words(message), " "), F.lit(" "))


def _any(said: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(said, F.lit(f" {p} ")) for p in phrases))


def _then(said: Column, first: tuple[str, ...], second: tuple[str, ...]) -> Column:
    """One of `first` stands before one of `second`."""
    rest = [F.when(F.contains(said, F.lit(f" {p} ")), F.substring(said, F.locate(f" {p} ", said) + len(p) + 1, F.length(said))) for p in first]
    return reduce(lambda a, b: a | b, (F.coalesce(_any(r, second), F.lit(False)) for r in rest))


def route(message: Column) -> Column:
    """help, recommend, create, view, clear, add, remove or question: the first that the message asks for; null without a word."""
    said = _said(message)
    wanted = SONGS + ("something", "playlist", "few more", "more like", "like these")
    suggest = _any(said, ("recommend", "recommends", "recommendation", "recommendations", "suggest", "suggests", "suggestion", "suggestions")) & _any(said, wanted)
    what_else = _then(said, ("what else",), ("sound good", "go well", "goes well", "fit")) & _any(said, ("song", "songs", "track", "tracks", "playlist", "have"))
    make = (_any(said, MAKING + ("put together",)) & _any(said, ("playlist", "songs", "tracks", "music"))) | _then(said, ("put together",), ("some", "a", "an")) | _then(said, ("give me", "i want", "i need"), LISTS)
    asks_help = said.isin(" help ", " help me ", " please help ", " please help me ") | _any(said, ("what can you do", "how do i use", "how can i use", "what can i ask", "what do you do"))
    listed = tuple(f"what{s} {at} {whose} playlist" for s in (" s", " is") for at in ("on", "in") for whose in ("my", "the"))
    return (
        F.when(F.coalesce(F.trim(said) == "", F.lit(True)), F.lit(None)).when(asks_help, "help").when((F.lower(F.trim(message)) == "/recommend") | suggest | what_else, "recommend").when(make, "create")
        .when(_then(said, SHOWING, LISTS) | _any(said, listed), "view").when(_then(said, EMPTYING, LISTS), "clear")
        .when(F.size(_named(message, ADDING)) > 0, "add").when(F.size(_named(message, REMOVING)) > 0, "remove").otherwise("question")
    )


# --- what a command names ------------------------------------------------------------------------------------------


def _written(message: Column) -> Column:
    """Words as (w, p): written, and plain without what stands around it (apostrophes and quotes inside stay)."""
    return F.transform(F.filter(F.split(message, r"\s+", -1), lambda w: w != ""), lambda w: F.struct(w.alias("w"), F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "").alias("p")))


def _once(value: Column, use) -> Column:
    """use(value), with value made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _from(words: Column, start: Column) -> Column:
    return F.slice(words, start, F.greatest(F.size(words) - start + 1, F.lit(0)))


def _after_lead(words: Column, lead: tuple[str, ...]) -> Column:
    """The words from the first on that is not of the lead."""
    spread = tuple(lead) + ("i'd",)
    skipped = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, x: F.struct((acc["n"] + (acc["on"] & x["p"].isin(*spread)).cast("int")).alias("n"), (acc["on"] & x["p"].isin(*spread)).alias("on")))["n"]
    return _from(words, skipped + 1)


def _ends_in(words: Column, *slots: tuple[str, ...]) -> Column:
    """The last words are one of each slot, in order."""
    at = lambda i: F.get(words, F.size(words) - len(slots) + i)["p"]
    return (F.size(words) > len(slots)) & reduce(lambda a, b: a & b, (F.coalesce(at(i).isin(*s), F.lit(False)) for i, s in enumerate(slots)))


def _named(message: Column, verbs: tuple[str, ...]) -> Column:
    """The words between a command's verb and where it points; none if the message is no such command."""
    places = ("from",) if verbs == REMOVING else ("to", "in", "into")

    def cut(words: Column) -> Column:
        short = lambda n: F.slice(words, 1, F.size(words) - n)
        return F.when(_ends_in(words, places, ("my", "the"), LISTS), short(3)).when(_ends_in(words, places, LISTS), short(2)).otherwise(words)

    def of(words: Column) -> Column:
        verb = F.get(words, F.lit(0))["p"]
        two = verb == "take"  # take out
        fits = F.coalesce(verb.isin(*verbs) & (~two | (F.get(words, F.lit(1))["p"] == "out")), F.lit(False))
        return F.when(fits, _from(words, F.when(two, 3).otherwise(2))).otherwise(F.slice(words, 1, 0))

    return _once(_once(_after_lead(_written(message), POLITE), of), cut)


def _shown(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda x: x["w"]), " ")


def _bare(text: Column) -> Column:
    """Without quotes, stops and spaces around it, and without a leading 'song', 'the song' or 'track'."""
    marks = " \t\r\n\"'“”‘’.,!?;:"
    inner = F.btrim(text, F.lit(marks))

    def named(words: Column) -> Column:
        head = lambda i: F.get(words, F.lit(i))["p"]
        lead = F.when((F.size(words) > 2) & (head(0) == "the") & (head(1) == "song"), 2).when((F.size(words) > 1) & head(0).isin("song", "track"), 1).otherwise(0)
        return F.when(lead == 0, inner).otherwise(_shown(_from(words, lead + 1)))

    return F.trim(_once(_written(inner), named))


def entity_of(message: Column) -> Column:
    """What an add or remove message names."""
    added = _named(message, ADDING)
    return _bare(_shown(F.when(F.size(added) > 0, added).otherwise(_named(message, REMOVING))))


def _by(words: Column) -> Column:
    """Place from 1 of the first 'by' inside the words; 0 without one."""
    inside = F.transform(words, lambda x, i: F.when((x["p"] == "by") & (i > 0) & (i < F.size(words) - 1), i + 1))
    return F.coalesce(F.array_min(inside), F.lit(0))


def title_of(entity: Column) -> Column:
    """The part before 'by', or the whole."""
    return _bare(_once(_written(entity), lambda x: F.when(_by(x) > 0, _shown(F.slice(x, 1, _by(x) - 1))).otherwise(entity)))


def artist_of(entity: Column) -> Column:
    """The part after 'by'; null without one."""
    return _once(_written(entity), lambda x: F.when(_by(x) > 0, _bare(_shown(_from(x, _by(x) + 1)))))


# --- questions -----------------------------------------------------------------------------------------------------

_OPENERS = ("do you know", "can you tell me", "could you tell me", "would you happen to know")
_SANG = ("sang", "sing", "sings", "sung", "perform", "performs", "performed", "recorded", "said")
_POINTERS, _BEING = ("it", "this", "that"), ("was", "is", "came", "come", "got")
_ITSELF = _POINTERS + ("this song", "that song", "this track", "that track")


def canonical(message: Column, track_known: Column, artist_known: Column) -> Column:
    """Questions in the form that name matching expects: no polite opener, words that point at a known track or artist
    say which, 'drop' of a release is 'released', and who made a song is who performs it."""
    stops = lambda x: F.regexp_extract(x["w"], r"[?.!]*$", 0)
    said = lambda words: F.array_join(F.transform(words, lambda x: x["p"]), " ")

    def opened(words: Column) -> Column:
        skip = reduce(lambda acc, o: acc.when(F.startswith(said(words), F.lit(o + " ")), len(o.split())), _OPENERS[1:], F.when(F.startswith(said(words), F.lit(_OPENERS[0] + " ")), 3)).otherwise(0)
        return _from(words, skip + 1)

    def pointed(words: Column) -> Column:
        p = lambda i: F.coalesce(F.get(words, i)["p"], F.lit(""))
        whole = (F.size(words) == 3) & (p(F.lit(0)) == "who") & p(F.lit(1)).isin(*_SANG)
        by_them = F.exists(F.transform(words, lambda x, i: (x["p"] == "them") & (i > 0) & p(i - 1).isin("by", "from")), lambda x: x)

        def one(x: Column, i: Column) -> Column:
            track = track_known & x["p"].isin(*_POINTERS) & ((whole & (i == 2)) | (p(i + 1).isin(*_BEING) & (stops(x) == "")))
            return F.when(track, F.concat(F.lit("this song"), stops(x))).when(artist_known & by_them & (x["p"] == "them"), F.concat(F.lit("this artist"), stops(x))).otherwise(x["w"])

        return F.transform(words, lambda x, i: F.struct(one(x, i).alias("w"), x["p"].alias("p")))

    def final(words: Column) -> Column:
        n = F.size(words)
        head = lambda i: F.get(words, F.lit(i))["p"]
        dropped = (n > 3) & (head(0) == "when") & (head(1) == "did") & (F.get(words, n - 1)["p"] == "drop")
        inner = F.slice(words, 3, n - 3)
        subject = F.when(said(inner).isin(*_ITSELF), "this song").otherwise(_shown(inner))
        made = (head(0) == "who") & (head(1) == "made")
        return F.when(dropped, F.concat(F.lit("When was "), subject, F.lit(" released"), stops(F.get(words, n - 1)))).when(made, F.concat_ws(" ", F.lit("Who performs"), F.nullif(_shown(_from(words, F.lit(3))), F.lit("")))).otherwise(_shown(words))

    return _once(_once(_once(_written(message), opened), pointed), final)


# --- themes --------------------------------------------------------------------------------------------------------

#: Words of a request around its theme: before it, and anywhere; pairs of words that say no more than one of these.
_BEFORE = POLITE + MAKING + ("put", "together", "me", "some", "a", "an", "the")
_AROUND = ("playlist", "please", "thanks", "for", "with", "of", "my", "the", "a", "an", "song", "music", "something", "that's", "me", "myself", "tonight", "today")
_PAIRS = (("thank", "you"), ("that", "is"), ("this", "evening"))


def playlist_description(message: Column) -> Column:
    """The theme that a request for a playlist names; null without one."""

    def theme(words: Column) -> Column:
        p = lambda i: F.when((i >= 0) & (i < F.size(words)), F.get(words, i)["p"]).otherwise("")
        pair = lambda i: reduce(lambda a, b: a | b, ((p(i) == x) & (p(i + 1) == y) for x, y in _PAIRS))
        kept = lambda x, i: ~(x["p"].isin("", *_AROUND) | ((x["p"] == "songs") & (p(i - 1) != "love")) | pair(i) | pair(i - 1))
        return F.array_join(F.transform(F.filter(words, kept), lambda x: F.btrim(x["w"], F.lit(" .,!?:;-"))), " ")

    # a second sentence that asks to make the list says nothing about it
    asked = F.regexp_replace(message, rf"(?i)[.!?]\s*\w+ you (?:{'|'.join(MAKING)}|put together)\b.*$", "")
    text = _once(_after_lead(_written(asked), _BEFORE), theme)
    known = lambda t: F.when(_any(_said(t), THEME), t)
    return F.when(F.contains(_said(message), F.lit(" going for a run ")), "running workout").otherwise(_once(text, known))


#: What an activity sounds like.
_SOUNDS = ((("gym", "workout", "exercise"), "energetic upbeat exercise music"), (("commute",), "easy listening relaxed music"))


def rewritten_description(theme: Column) -> Column:
    """The theme as a catalog query: no words of length, activities as what they sound like, sad love as romance."""

    def query(words: Column) -> Column:
        p = lambda i: F.when((i >= 0) & (i < F.size(words)), F.get(words, i)["p"]).otherwise("")
        has = lambda *of: F.exists(words, lambda x: x["p"].isin(*of))
        long_trip = lambda i: (p(i) == "long") & (p(i + 1) == "trip")
        activities = tuple(w for group, _ in _SOUNDS for w in group)
        left = F.filter(words, lambda x, i: ~(x["p"].isin("short", "quick", *activities) | long_trip(i) | long_trip(i - 1)))
        left = F.transform(left, lambda x: F.when((x["p"] == "love") & has("sad"), "romantic love songs").otherwise(F.btrim(x["w"], F.lit(" .,!?:;-"))))
        return F.concat_ws(" ", F.filter(left, lambda w: w != ""), *(F.when(has(*group), sound) for group, sound in _SOUNDS))

    text = _once(_written(theme), query)
    return F.when(text == "", "music").otherwise(text)


# --- choices among suggestions ---------------------------------------------------------------------------------------

_LABELS = ("the", "option", "options", "number", "numbers", "song", "songs", "track", "tracks")
_COUNTED = ("one", "ones", "song", "songs", "track", "tracks", "option", "options")
_CHOOSING = POLITE + ("add", "choose", "select", "take")
_NONE = ("no", "none", "neither", "don t", "do not", "not any", "skip them")
_ALL = ("all of them", "add all", "add them all", "all recommendations", "everything")


def _number(word: Column) -> Column:
    """1 and up for a number or ordinal (0 if it says 0), -1 for 'last', null for other words."""
    table = F.create_map(*(F.lit(x) for kv in (ORDINALS | {"last": -1}).items() for x in kv))
    return F.coalesce(F.element_at(table, word), F.when(word.rlike(r"^[0-9]{1,9}(?:st|nd|rd|th)?$"), F.regexp_extract(word, "^[0-9]+", 0).cast("int")))


def choice(message: Column) -> Column:
    """What a message chooses among numbered suggestions, as (kind, numbers, name): none; except <name>; all; first with
    one number; places with numbers from 1, -1 for the last; by <artist>. kind is null for any other message."""
    said = _said(message)
    tokens = F.regexp_extract_all(F.lower(message), F.lit(r"[\p{L}\p{N}_]+|,"), F.lit(0))
    words = F.transform(tokens, lambda t: F.struct(t.alias("w"), F.when(t == "and", ",").otherwise(t).alias("p")))

    def trimmed(x: Column) -> Column:
        short = lambda n: F.slice(x, 1, F.size(x) - n)
        to = ("to", "in", "into")
        return F.when(_ends_in(x, to, ("my", "the"), LISTS), short(3)).when(_ends_in(x, to, LISTS), short(2)).otherwise(x)

    def without_please(x: Column) -> Column:
        return F.when(_ends_in(x, ("please",)), F.slice(x, 1, F.size(x) - 1)).otherwise(x)

    core = _once(_once(_after_lead(words, _CHOOSING), without_please), trimmed)

    def item(text: Column) -> Column:
        """The number of one choice; null if it is none."""
        of = F.filter(F.split(text, " "), lambda w: w != "")
        labelled = F.aggregate(of, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, w: F.struct((acc["n"] + (acc["on"] & w.isin(*_LABELS)).cast("int")).alias("n"), (acc["on"] & w.isin(*_LABELS)).alias("on")))["n"]
        return _once(_from(of, labelled + 1), lambda rest: F.when((F.size(rest) == 1) | ((F.size(rest) == 2) & F.get(rest, F.lit(1)).isin(*_COUNTED)), _number(F.get(rest, F.lit(0)))))

    line = F.array_join(F.transform(core, lambda x: x["p"]), " ")
    numbers = _once(line, lambda t: F.transform(F.split(F.trim(t), r"\s*,(?:\s*,)*\s*"), item))

    def counted(h: Column) -> Column:
        """n of 'first n [songs]'; 'first one' and 'first 2nd' are places."""
        n, alone = F.get(h, F.lit(1)), F.size(h) == 2
        amount = n.rlike("^[0-9]+$") | (n.isin(*list(ORDINALS)[:10]) & ~(alone & (n == "one")))
        return F.when((F.get(h, F.lit(0)) == "first") & amount & (alone | ((F.size(h) == 3) & F.get(h, F.lit(2)).isin(*_COUNTED))), _number(n))

    first = _once(F.filter(F.transform(core, lambda x: x["p"]), lambda w: w != "the"), counted)
    shown = _written(message)

    def after(last: tuple[str, ...], fillers: tuple[str, ...]) -> Column:
        """The written words after the first of `last` and the fillers that follow it."""

        def of(x: Column) -> Column:
            at = F.coalesce(F.array_min(F.transform(x, lambda w, i: F.when(w["p"].isin(*last), i + 1))), F.lit(0))
            return F.when(at > 0, _bare(_shown(_after_lead(_from(x, at + 1), fillers)))).otherwise("")

        return _once(shown, of)

    name_except = after(("except",), ("for", "the", "one", "by"))
    by_artist = F.exists(plain_words(message), lambda w: w.isin("add", "choose", "select")) & (_any(said, tuple(f"{v}{x} by" for v in ("add", "choose", "select") for x in ("", " the", " one", " the one"))))
    name_by = after(("by",), ())
    valid = (F.size(numbers) > 0) & ~F.exists(numbers, lambda n: n.isNull())
    nothing = F.array().cast("array<int>")

    def pick(kind: str, n: Column = nothing, name: Column = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), n.alias("numbers"), (F.lit("") if name is None else name).alias("name"))

    other = F.struct(F.lit(None).cast("string").alias("kind"), nothing.alias("numbers"), F.lit("").alias("name"))
    return (
        F.when(_any(said, _NONE), pick("none")).when(name_except != "", pick("except", name=name_except)).when(_any(said, _ALL), pick("all"))
        .when(first.isNotNull(), pick("first", F.array(first))).when(valid, pick("places", numbers)).when(by_artist & (name_by != ""), pick("by", name=name_by)).otherwise(other)
    )


def selected_positions(message: Column, count: Column) -> Column:
    """Chosen places from 0 among `count`, [] if any is out of bounds, null if the message as a whole is no choice."""

    def of(c: Column) -> Column:
        n = c["numbers"][0]
        spread = F.when((n > 0) & (n <= count), F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
        places = F.transform(c["numbers"], lambda x: F.when(x == -1, count).otherwise(x) - 1)
        inside = ~F.exists(places, lambda x: (x < 0) | (x >= count))
        return F.when(c["kind"] == "first", spread).when(c["kind"] == "places", F.when(inside, F.array_distinct(places)).otherwise(F.array().cast("array<int>")))

    return _once(choice(message), of)
