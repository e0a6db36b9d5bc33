"""Catalog search against a plain search of every request through every track."""

import re
from difflib import SequenceMatcher

from rankloom.operators import near, search
from rankloom.plans import registry
from rankloom.sources import adapters


def plain(x):
    return re.sub("[^a-z0-9]+", " ", (x or "").lower()).strip()


def score(q, v):
    if not q or not v:
        return 0.0
    if q == v:
        return 1.0
    if q in v:
        return 0.9 + 0.09 * len(q) / len(v)
    if v in q:
        return 0.72 + 0.17 * len(v) / len(q)
    return SequenceMatcher(None, q, v).ratio()


def popularity(p):
    return p if p is not None else 0


def brute(requests, tracks, limit):
    """{query: [(track, title score, artist score)]} of (query, title, artist) over tracks (id, titles, artists, popularity, ord)."""
    out = {}
    for key, title, artist in requests:
        title, artist, found = plain(title), plain(artist), []
        for track, titles, artists, pop, order in tracks:
            s = max((score(title, plain(t)) for t in titles), default=0) if title else 0.0
            a = max((score(artist, plain(t)) for t in artists), default=0) if artist else 0.0
            if (title or artist) and (not title or s >= 0.42) and (not artist or a >= 0.42):
                found.append((-s, -a, -popularity(pop), order, track))
        out[key] = [(t, round(-s, 9), round(-a, 9)) for s, a, _, _, t in sorted(found)[:limit]]
    return out


def rows_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["track_id"], round(r["title_score"], 9), round(r["artist_score"], 9)))
    return out


def test_search_tracks_whole_table(spark, sf_dir):
    tracks = [(r["track_id"], r["track_name"], r["artist_name"], r["popularity"], r["ord"]) for r in adapters.catalog(spark, sf_dir).collect()]
    asked = [(t[4], t[1][0], t[2][0] if t[4] % 2 == 0 else None) for t in tracks]
    wanted = brute(asked, tracks, 10)
    assert rows_of(registry.queries()["search_tracks"](spark, sf_dir)) == {k: v for k, v in wanted.items() if v}


def test_search_of_odd_names(spark, monkeypatch):
    names = ["Love", "Love Me Do", "I", "a", "The End", "Ü", "", "the the", "Endless Love Songs of the Night", "x" * 60, "Lvoe", "Do Me Love"]
    rows = [(f"t{i}", [n], [names[(i * 5) % 12], "Artist"], float(i % 3) if i % 4 else None, i) for i, n in enumerate(names)]
    tracks = spark.createDataFrame(rows, "track_id string, track_name array<string>, artist_name array<string>, popularity double, ord long")
    asked = [(i, n, None if i % 3 else names[-i - 1]) for i, n in enumerate(names)] + [(50, None, "artist"), (51, "", ""), (52, "love", None), (53, "love", None)]
    requests = spark.createDataFrame(asked, "query_id long, title string, artist string")
    wanted = {k: v for k, v in brute(asked, rows, 3).items() if v}
    assert rows_of(search.search_tracks(requests, tracks, 3)) == wanted
    monkeypatch.setattr(near, "WANTED", 3)  # more tiles
    assert rows_of(search.search_tracks(requests, tracks, 3)) == wanted


def test_add_and_remove_whole_table(spark, sf_dir):
    tracks = [(r["track_id"], r["track_name"], r["artist_name"], r["popularity"], r["ord"]) for r in adapters.catalog(spark, sf_dir).collect()]
    by_id = {t[0]: t for t in tracks}
    asked = [(t[4], t[1][0], t[2][0] if t[4] % 2 == 0 else None) for t in tracks]
    mine = {t[4]: {x[0] for x in tracks if x[2] == t[2]} for t in tracks}
    compact = lambda x: re.sub("[^a-z0-9]+", "", x.lower())

    def outcome(ids, title, artist, done):
        exact = [i for i in ids if title.lower() in [x.lower() for x in by_id[i][1]]]
        ids = exact or ids
        return ("none", []) if not ids else (done, ids[:1]) if len(ids) == 1 or artist else ("choose", ids[:5])

    for query, limit, done in (("add_by_text", 10, "added"), ("remove_by_text", 20, "removed")):
        found = {r["query_id"]: (r["outcome"], list(r["track_ids"])) for r in registry.queries()[query](spark, sf_dir).collect()}
        wanted = {}
        for key, title, artist in asked:
            ids = [t for t, _, _ in brute([(key, title, artist)], tracks, limit)[key]]
            if done == "removed":
                ids = [t for t in ids if t in mine[key]]
            else:  # of near titles, equal ones are certain and enough here: each title of the table is its own
                assert any(compact(title) == compact(n) for t in ids for n in by_id[t][1])
            wanted[key] = outcome(ids, title, artist, done)
        if done == "added":
            assert set(found) == set(wanted) and all(found[k][0] == wanted[k][0] for k in found if wanted[k][0] == "choose" or wanted[k][1] == found[k][1])
        assert found == wanted
