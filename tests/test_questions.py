"""Questions about performers over a catalog whose names collide with the words of the questions."""

import pytest

from rankloom.operators import questions

CATALOG = [
    ("billie", "Billie Jean", ["Michael Jackson"], "Thriller"),
    ("cover", "Billie Jean", ["Kodaline"], "Forever Young"),
    ("survive", "I Will Survive", ["Cake"], "Fashion Nugget"),
    ("survive-cover", "I Will Survive", ["Demi Lovato"], "Soundtrack"),
    ("collision", "Micheal", ["Sango"], "Jackson"),
    ("savage", "No Heart", ["21 Savage", "Metro Boomin"], "Savage Mode"),
    ("sequel-collision", "Unrelated", ["Other Artist"], "II"),
    ("stand", "Stand By Me", ["Ben E. King"], "Don't Play That Song"),
    ("bank", "Bank Account", ["21 Savage"], "Issa Album"),
    ("bank-cover", "Bank Account", ["Other Artist"], "Cover Album"),
    ("carry", "Carry On", ["21 Savage"], "Issa Album"),
    ("on-title", "Love On Top", ["Beyonce"], "4"),
    ("album-label", "Track With Album Label", ["Album Artist"], "The Album"),
    ("accent", "Déjà Vu", ["Ｆｕｌｌ Ｗｉｄｔｈ"], "Accents"),
]
ASKED = [
    ("who sang billie jean", None, "choose", "Which track", ["billie", "cover"]),
    ("who said billie jean", None, "choose", "Which track", ["billie", "cover"]),
    ("who sang I will survive", None, "choose", "Which track", ["survive", "survive-cover"]),
    ("who sang billie jean by micheal jackson", None, "track", "Billie Jean is by Michael Jackson.", ["billie"]),
    ("who sang savage mode", None, "album", "‘Savage Mode’ is an album. Performers credited on its catalog tracks include 21 Savage, Metro Boomin.", []),
    ("who sang savagemode", None, "album", "‘Savage Mode’ is an album", []),
    ("who sang savageMode II", "billie", "no_name", "couldn't find a track or album matching ‘savageMode II’", []),
    ("Who sang Stand By Me?", None, "track", "Stand By Me is by Ben E. King.", ["stand"]),
    ("Who sang it?", "billie", "track", "Billie Jean is by Michael Jackson.", ["billie"]),
    ("Who sang it?", None, "no_track", "Which song or track should I look up?", []),
    ("Who sang Billie Jean?", "cover", "track", "Billie Jean is by Kodaline.", ["cover"]),
    ("Who sang Billie Jean by Zzzzz Qqqqq?", None, "no_artist", "couldn't find the artist ‘Zzzzz Qqqqq’", []),
    ("Who sang Bank Account on Issa Album?", "bank-cover", "track", "Bank Account is by 21 Savage.", ["bank"]),
    ("Who sang Bank Account on the album Issa Album?", None, "track", "Bank Account is by 21 Savage.", ["bank"]),
    ("Who sang Bank Account on the Issa Album?", None, "track", "Bank Account is by 21 Savage.", ["bank"]),
    ("Who sang Bank Account from Issa Album?", None, "track", "Bank Account is by 21 Savage.", ["bank"]),
    ("Who sang Bank Account in Issa Album?", None, "track", "Bank Account is by 21 Savage.", ["bank"]),
    ("Who sang Bank Account by 21 Savage on Issa Album?", None, "track", "Bank Account is by 21 Savage.", ["bank"]),
    ("Who sang Bank Account on Issa Album by 21 Savage?", None, "track", "Bank Account is by 21 Savage.", ["bank"]),
    ("Who sang Carry On on Issa Album?", None, "track", "Carry On is by 21 Savage.", ["carry"]),
    ("Who sang Issa Album album?", None, "album", "‘Issa Album’ is an album", []),
    ("Who sang the album Issa Album?", None, "album", "‘Issa Album’ is an album", []),
    ("Who sang the Issa Album?", None, "album", "‘Issa Album’ is an album", []),
    ("Who sang X on Issa Album?", "bank", "no_name", "couldn't find a track or album matching ‘X’", []),
    ("Who sang Bank Account on Savage Mode?", "bank", "no_track", "couldn't find a catalog track", []),
    ("Who sang Bank Account on Zzzzz Qqqqq?", "bank", "no_album", "couldn't find the album", []),
    ("Who sang Bank Account on Issa Album II?", "bank", "no_album", "couldn't find the album", []),
    ("Who sang Bank Account by Other Artist on Issa Album?", "bank", "no_track", "couldn't find a catalog track", []),
    ("Who sang Love On Top?", None, "track", "Love On Top is by Beyonce.", ["on-title"]),
    ("Who sang the album The Album?", None, "album", "‘The Album’ is an album", []),
    ("who performed the song Carry On", None, "track", "Carry On is by 21 Savage.", ["carry"]),
    ("who sang the track savage mode", None, "no_name", "couldn't find a track or album matching ‘savage mode’", []),
    ("Who recorded the album Savage Mode by Other Artist?", None, "no_track", "couldn't find catalog tracks from ‘Savage Mode’ by ‘Other Artist’", []),
    ("who sang Déjà Vu by full width", None, "track", "is by Ｆｕｌｌ Ｗｉｄｔｈ.", ["accent"]),
    ("who sang", None, None, "", None),
    ("what is by Kodaline", None, None, "", None),
    (None, "billie", None, "", None),
    ("who sang by by by", None, "no_artist", "couldn't find the artist ‘by’", []),
]


@pytest.fixture(scope="module")
def answers(spark):
    tracks = spark.createDataFrame([(i, [t], a, [b], None, n) for n, (i, t, a, b) in enumerate(CATALOG)], "track_id string, track_name array<string>, artist_name array<string>, album_name array<string>, popularity double, ord long")
    asked = spark.createDataFrame([(n, a[0], a[1]) for n, a in enumerate(ASKED)], "query_id long, text string, last string")
    return {r["query_id"]: r for r in questions.answered(asked, tracks, last_col="last").collect()}


@pytest.mark.parametrize("n", range(len(ASKED)), ids=[str(a[0]) for a in ASKED])
def test_answer(answers, n):
    _, _, outcome, text, ids = ASKED[n]
    if outcome is None:
        assert n not in answers
        return
    assert (answers[n]["outcome"], list(answers[n]["track_ids"])) == (outcome, ids) and text in answers[n]["answer"]


def test_choices_stand_by_popularity(spark):
    rows = [(f"t{i}", ["Echo"], [f"Artist {i}"], ["A"], float(i % 4), i) for i in range(9)]
    tracks = spark.createDataFrame(rows, "track_id string, track_name array<string>, artist_name array<string>, album_name array<string>, popularity double, ord long")
    found = questions.answered(spark.createDataFrame([(1, "who sang echo?")], "query_id long, text string"), tracks).first()
    assert found["outcome"] == "choose" and list(found["track_ids"]) == ["t3", "t7", "t2", "t6", "t1"] and "1. Echo — Artist 3 (A)" in found["answer"]


def test_equal_questions_are_read_once(spark, monkeypatch):
    from rankloom.operators import questions, search

    tracks = spark.createDataFrame([(str(i), [n], ["Ann Lee"], ["Blue"], 1.0, i) for i, n in enumerate(["Red Ring", "Old Bolt"])], "track_id string, track_name array<string>, artist_name array<string>, album_name array<string>, popularity double, ord long")
    texts = ["Who sang Red Ring on the album Blue?", "who sang Old Bolt by Ann Lee", "Who sang it?", "no question"]
    asked = spark.createDataFrame([(i, texts[i % 4]) for i in range(800)], "query_id long, text string")
    index, sizes, plain = search.name_index(tracks), {}, questions.staged
    wanted = {r["query_id"]: r for r in questions.slots(questions.parsed(asked.limit(4)), index).collect()}
    monkeypatch.setattr(questions, "staged", lambda df, label: sizes.setdefault(label, plain(df, label)))
    found = {r["query_id"]: r for r in questions.read(asked, index).collect()}
    assert sizes["read"].count() == 2 and set(found) == {i for i in range(800) if i % 4 < 2}
    assert all(tuple(r)[1:] == tuple(wanted[i % 4])[1:] for i, r in found.items())
