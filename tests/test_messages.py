"""What messages are read as, case by case."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions import messages as M

FIRST_OF_FIVE = {
    "Add first, second and fourth": [0, 1, 3], "Add the first, the second, and the fourth songs": [0, 1, 3], "Could you add 1st, second and 4 to my playlist?": [0, 1, 3], "Add 1, 2 and 4": [0, 1, 3],
    "Add fourth, 2nd and first": [3, 1, 0], "Add first, last and first": [0, 4], "Add the first two": [0, 1], "Add the first four": [0, 1, 2, 3], "the second one": [1], "Add first, second and ninth": [],
    "Add 1, 2 and 9": [], "Add first and 0": [], "Add the ninth": [], "Add the first nine": [], "Add 0": [], "Add 2 and 99th": [], "Add The Second Coming": None, "option 3 please": [2], "2": [1], "i'd like the third": [2],
    "first 3 tracks": [0, 1, 2], "the first one": [0], "song 4 in the playlist": [3], "": None, "and": None, "one, two": [0, 1], "add 1-3": None,
}
ROUTES = {
    "Add Numb by Linkin Park": "add", "I'd like you to put Africa into my playlist": "add", "please remove Numb from the playlist.": "remove", "take out Numb": "remove", "take Numb": "question", "Show my playlist": "view", "What's on my playlist?": "view",
    "clear the playlist": "clear", "remove all from my playlist": "clear", "help": "help", "Please help me!": "help", "what can you do?": "help", "recommend some songs like these": "recommend", "/recommend": "recommend",
    "I would like a few more recommendations based on my playlist.": "recommend", "what else would sound good with the songs I have": "recommend", "Create a workout playlist": "create", "put together some tunes": "create",
    "I need a jazz playlist": "create", "who sang Numb?": "question", "recommend a film": "question", "playlist show": "question", "add": "question", "  ": None, None: None,
}
CANONICAL = {
    "Do you know when did it drop?": "When was this song released?", "who sang it?": "who sang this song?", "what else is by them": "what else is by this artist", "Who made Africa?": "Who performs Africa?",
    "When did Thriller drop": "When was Thriller released", "who said that": "who said this song", "Can you tell me when this came out?": "when this song came out?", "is it good": "is it good", "play them": "play them",
}
THEMES = {
    "Create a workout playlist": "workout", "could you make me a short jazz playlist for tonight, please": "short jazz", "I want sad love songs playlist": "sad love songs", "I'm going for a run. Can you make a playlist?": "running workout",
    "make a playlist": None, "Put together some happy songs for a dinner this evening": "happy dinner", "calm music. Could you make that?": "calm", "Road trip playlist thank you": "Road trip",
}
QUERIES = {"short commute": "easy listening relaxed music", "gym": "energetic upbeat exercise music", "sad love": "sad romantic love songs", "quick": "music", "long trip rock": "rock", "happy love": "happy love", "workout rock": "rock energetic upbeat exercise music"}
CHOICES = {
    "all of them": ("all", [], ""), "none of these": ("none", [], ""), "I don't want any": ("none", [], ""), "Add them except the one by Artist Three": ("except", [], "Artist Three"), "everything except for Numb": ("except", [], "Numb"),
    "add the one by Artist Two.": ("by", [], "Artist Two"), "add the first two": ("first", [2], ""), "last": ("places", [-1], ""), "who sang it": (None, [], ""), "add Numb by Linkin Park": (None, [], ""),
}


def answers(spark, asked, column):
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(asked)], "i int, m string").select("i", column.alias("x")).collect()
    return dict(zip(asked, (r["x"] for r in sorted(rows, key=lambda r: r["i"]))))


@pytest.mark.parametrize("cases, read", [(ROUTES, M.route), (THEMES, M.playlist_description), (QUERIES, M.rewritten_description), (CANONICAL, lambda m: M.canonical(m, F.lit(True), F.lit(True))), (FIRST_OF_FIVE, lambda m: M.selected_positions(m, F.lit(5)))], ids=["routes", "themes", "queries", "canonical", "positions"])
def test_cases(spark, cases, read):
    assert answers(spark, list(cases), read(F.col("m"))) == cases


def test_choices(spark):
    found = answers(spark, list(CHOICES), M.choice(F.col("m")))
    assert {m: (c["kind"], list(c["numbers"]), c["name"]) for m, c in found.items()} == CHOICES


def test_nothing_is_replaced_without_a_known_track_or_artist(spark):
    said = ["who sang it?", "songs by them"]
    assert answers(spark, said, M.canonical(F.col("m"), F.lit(False), F.lit(False))) == {m: m for m in said}


def test_names(spark):
    cases = {"Add Numb by Linkin Park": ("Numb", "Linkin Park"), 'please remove the song "Africa" from my playlist.': ("Africa", None), "add By The Way by Red Hot Chili Peppers to the playlist": ("By The Way", "Red Hot Chili Peppers"), "put track Numb in my playlist": ("Numb", None)}
    entity = M.entity_of(F.col("m"))
    found = answers(spark, list(cases), F.struct(M.title_of(entity).alias("t"), M.artist_of(entity).alias("a")))
    assert {m: (x["t"], x["a"]) for m, x in found.items()} == cases


def test_what_follows_from_a_text_is_worked_out_once(spark):
    from pyspark.sql import functions as F

    from rankloom.operators.groups import by_text

    said = spark.createDataFrame([(i, ("play it", "stop", None, "")[i % 4]) for i in range(400)], "id long, text string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def shout(text):
        seen.add(1)
        return None if text is None else text.upper()

    found = {r["id"]: r["loud"] for r in by_text(said, lambda t: t.withColumn("loud", shout.asNondeterministic()("text"))).collect()}
    assert found == {i: ("PLAY IT", "STOP", None, "")[i % 4] for i in range(400)} and seen.value == 4
