"""Tag features, choices and search by hand."""

from difflib import SequenceMatcher


from rankloom.functions import aliases
from rankloom.functions.text import composed, exact, plain
from rankloom.operators import context, playlists as P, search, selection


def tracks(spark, rows):
    return spark.createDataFrame([(i, [t], [a], [b], tags, p, n) for n, (i, t, a, b, tags, p) in enumerate(rows)], "track_id string, track_name array<string>, artist_name array<string>, album_name array<string>, tag_list array<string>, popularity double, ord long")


def test_tags(spark):
    rows = tracks(spark, [("1", "x", "a", "b", ["hip-hop/rap", "Alternative Rock", "chillout", "melancholic", "seen live"], 1.0), ("2", "y", "a", "b", [], 1.0)])
    found = {(r["kind"], r["feature"]) for r in selection.classify_tags(rows, aliases.table(spark)).collect()}
    assert found == {("genre", "hip hop"), ("genre", "alternative"), ("mood", "chill"), ("mood", "melancholy")}


def test_style_counts_once(spark):
    rows = tracks(spark, [("1", "x", "a", "b", ["nu metal", "nu-metal", "new metal", "hard rock"], 1.0)])
    found = {r["feature"]: r["weight"] for r in selection.track_style(rows, aliases.table(spark)).collect()}
    assert found == {"nu metal": 2.0, "hard rock": 2.0, "rock": 1.0}


def test_preferences_are_whole_words(spark):
    texts = spark.createDataFrame([(1, "Some laid-back jazz & R&B, please"), (2, "jazzy"), (3, None)], "id long, text string")
    found = {(r["id"], r["feature"]) for r in selection.preferences(texts, aliases.table(spark), "id", "text").collect()}
    assert found == {(1, "chill"), (1, "jazz"), (1, "r&b")}


def test_diverse_choice(spark):
    rows = tracks(spark, [("1", "x", "a", "b", ["rock"], 1.0), ("2", "y", "a", "b", [], 1.0), ("3", "z", "c", "b", ["jazz"], 1.0)])
    pool = spark.createDataFrame([(1, n, str(n)) for n in (1, 2, 3)], "id long, rank int, track_id string")
    wanted = spark.createDataFrame([(1, "genre", "rock"), (1, "genre", "jazz")], "id long, kind string, feature string")
    out = selection.select_diverse(pool, rows, selection.classify_tags(rows, aliases.table(spark)), 2, wanted)
    assert [r["track_id"] for r in out.orderBy("place").collect()] == ["1", "3"]


def test_matches_prefer_other_artists(spark):
    rows = tracks(spark, [(str(n), "x", "a" if n < 3 else "c", "b", ["rock"], 1.0) for n in range(1, 5)])
    scores = spark.createDataFrame([(1, 1, "1", 1.0), (1, 2, "2", 0.99), (1, 3, "3", 0.95), (1, 4, "4", 0.5)], "id long, rank int, track_id string, score double")
    assert [r["track_id"] for r in selection.select_matches(scores, rows, 3).orderBy("place").collect()] == ["1", "3", "2"]


def test_normalisers(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("Déjà Vu",)], "t string").select(plain(F.col("t")).alias("p"), exact(F.col("t")).alias("e"), composed(F.col("t")).alias("c")).first()
    assert tuple(row) == ("d j vu", "de ja vu", "déjà vu")


def test_search_against_brute_force(spark):
    names = ["Africa", "Afrika", "Out of Africa", "Rosanna", "Hold the Line", "Hold On", "Love", "Love"]
    rows = tracks(spark, [(str(i), t, "Toto" if i % 2 else "Totem", "x", [], float(i)) for i, t in enumerate(names)])
    asked = [(0, "africa", None), (1, "hold the lime", None), (2, "love", "toto"), (3, None, "toto"), (4, "", "")]
    requests = spark.createDataFrame(asked, "query_id long, title string, artist string")

    def score(q, v):
        q, v = q.lower(), v.lower()
        return 1.0 if q == v else 0.9 + 0.09 * len(q) / len(v) if q in v else 0.72 + 0.17 * len(v) / len(q) if v in q else SequenceMatcher(None, q, v).ratio()

    expected = {}
    for q, title, artist in asked:
        found = []
        for i, t in enumerate(names):
            a = score(title, t) if title else 0.0
            b = score(artist, "Toto" if i % 2 else "Totem") if artist else 0.0
            if (title or artist) and not (title and a < 0.42) and not (artist and b < 0.42):
                found.append((-a, -b, -float(i), i))
        if found:
            expected[q] = [str(f[-1]) for f in sorted(found)][:10]
    found = {}
    for r in search.search_tracks(requests, rows).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["track_id"])
    assert found == expected
    done = {r["query_id"]: (r["outcome"], list(r["track_ids"])) for r in search.add_by_text(requests, rows).collect()}
    assert done[0] == ("added", ["0"]) and done[2] == ("added", ["7"]) and done[4] == ("none", [])


def test_names(spark):
    rows = tracks(spark, [("1", "Bank Account", "21 Savage", "Issa Album", [], 5.0), ("2", "Who", "The Who", "Who", [], 1.0), ("3", "Savage Mode II", "21 Savage", "Savage Mode II", [], 2.0)])
    index = search.name_index(rows)
    asked = spark.createDataFrame([(1, "Who sang Bank Account on Issa?"), (2, 'play "Who" now'), (3, "who is it"), (4, "bank acount please")], "query_id long, text string")
    found = search.longest_mentions(search.mentions(asked, index))
    got = {(r["query_id"], r["kind"], r["name"]) for r in found.collect()}
    assert {(1, "title", "bank account"), (1, "album", "issa"), (2, "title", "who"), (2, "album", "who")} <= got and not any(q in (3, 4) for q, _, _ in got)
    near = {(r["query_id"], r["name"]) for r in search.fuzzy_mentions(asked, index).collect()}
    assert (4, "bank account") in near
    shown = {r["query_id"]: r["masked"] for r in search.masked(asked, found.where("query_id = 1")).collect()}
    assert shown[1] == "who sang this song on this album" and shown[4] == "bank acount please"
    slots = spark.createDataFrame([(1, "album", "savagemode ii"), (2, "album", "Savage Mod II"), (3, "album", "Savage Mode III")], "query_id long, kind string, text string")
    assert {(r["query_id"], r["name"]) for r in search.slot_match_fuzzy(slots, index).collect()} == {(1, "savage mode ii"), (2, "savage mode ii")}


def test_library(spark):
    log = spark.createDataFrame(
        [("d", 1, "new", "p1", "One", ["a", "a", "b"]), ("d", 2, "new", "p2", "Two", []), ("d", 3, "save", "p1", None, ["c"]), ("d", 4, "rename", "p1", " ", None), ("d", 5, "delete", "p2", None, None), ("e", 1, "save", "p1", None, ["z"]), ("d", 6, "new", "p3", "x" * 101, [])],
        "device_id string, seq long, action string, id string, name string, track_ids array<string>",
    )
    rows = [tuple(r) for r in P.folded_library(log).collect()]
    assert rows == [("d", "p1", "One", ["c"], 3, True)]


def test_atomic_add(spark):
    catalog = spark.createDataFrame([("a",), ("b",)], "track_id string")
    asked = spark.createDataFrame([(1, ["a", "x", "y"]), (2, ["b"]), (3, [])], "id long, track_ids array<string>")
    assert [(r["id"], r["unknown"]) for r in P.unknown_ids(asked, catalog).collect()] == [(1, ["x", "y"])]


def test_recent_context(spark):
    messages = spark.createDataFrame(
        [(1, 0, 1, "user", "first"), (1, 1, 1, "music", "t"), (1, 2, 2, "user", "  "), (1, 3, 2, "music", "unknown"), (1, 4, 3, "user", "third"), (1, 5, 4, "user", "now")], "session_id long, pos long, turn_number long, role string, content string"
    )
    catalog = tracks(spark, [("t", "Song", "Band", "", ["x", "y"], 1.0)])
    rows = {r["turn_number"]: r for r in context.recent(messages, catalog, 1).collect()}
    assert (rows[4]["request"], rows[4]["requests"], rows[4]["music"]) == ("now", ["first", "third"], ["track Song; artist Band; tags x"])
    assert (rows[1]["requests"], rows[1]["music"]) == ([], [])
