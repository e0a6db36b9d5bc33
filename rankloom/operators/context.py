"""Retrieval queries from dialogues: as-of histories and the two kinds of weighted query text.

Messages are (session_id, pos, turn_number, role, content). Everything a turn needs from before it comes from one
window over its session, so sessions are shuffled once and no message meets another in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.functions import scalars


def history(messages: DataFrame, catalog: DataFrame, fields: tuple[str, ...] = ("track_name", "artist_name", "album_name")) -> DataFrame:
    """(session_id, turn_number, query) for each turn with a user message: 'role: content' lines up to that message.

    Music messages read as the assistant's, with the track's fields. The history of a turn ends at the first message
    of a later turn, or of the same turn from another role, in message order.
    """
    text = scalars.labelled({"track_id": F.array("track_id")} | {f: F.col(f) for f in fields}, ", ")
    shown = catalog.select(F.col("track_id").alias("content"), text.alias("shown"))
    rows = messages.join(shown, "content", "left")
    music = F.col("role") == "music"
    line = F.concat(F.when(music, "assistant").otherwise(F.col("role")), F.lit(": "), F.when(music, F.col("shown")).otherwise(F.col("content")))
    before = Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    turn = Window.partitionBy("session_id", "turn_number").orderBy("pos")
    # the user's messages that open a turn, and all before them
    opens = F.min(F.when(F.col("role") != "user", F.col("pos"))).over(turn.rowsBetween(Window.unboundedPreceding, 0)).isNull()
    rows = rows.withColumn("line", line).withColumn("query", F.array_join(F.collect_list("line").over(before), "\n")).withColumn("opens", opens)
    last = rows.where("opens").groupBy("session_id", "turn_number").agg(F.max_by("query", "pos").alias("query"))
    return last


def recent(messages: DataFrame, catalog: DataFrame, most_tags: int = 8, n: int = 2) -> DataFrame:
    """(session_id, turn_number, request, requests, music): a turn's first user message and the last n filled user
    messages and known tracks of earlier turns, oldest first."""
    known = catalog.select(F.col("track_id").alias("content"), scalars.compact_music(F.col("track_name"), F.col("artist_name"), F.col("album_name"), F.col("tag_list"), most_tags).alias("shown"))
    rows = messages.join(known, "content", "left")
    earlier = Window.partitionBy("session_id").orderBy("turn_number").rangeBetween(Window.unboundedPreceding, -1)
    said = F.when((F.col("role") == "user") & (F.trim("content") != ""), F.struct("pos", F.trim("content").alias("x")))
    played = F.when((F.col("role") == "music") & (F.col("shown") != ""), F.struct("pos", F.col("shown").alias("x")))
    last = lambda c: F.transform(_tail(F.array_sort(F.collect_list(c).over(earlier)), n), lambda s: s["x"])
    rows = rows.select("session_id", "turn_number", "pos", "role", "content", last(said).alias("requests"), last(played).alias("music"))
    own = F.when(F.col("role") == "user", F.struct("pos", F.coalesce("content", F.lit("")).alias("x")))
    turns = rows.groupBy("session_id", "turn_number").agg(F.min(own).alias("own"), F.first("requests").alias("requests"), F.first("music").alias("music"))
    return turns.select("session_id", "turn_number", F.coalesce("own.x", F.lit("")).alias("request"), "requests", "music")


def _tail(items: Column, n: int) -> Column:
    """The last n of an array, or all of it."""
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def _block(label: str, text: Column, times: int = 1) -> Column:
    """'LABEL:' and the text, so many times; nothing for an empty text."""
    return F.when(text != "", F.array_repeat(F.concat(F.lit(f"{label}:\n"), text), times)).otherwise(F.array().cast("array<string>"))


def _lines(items: Column, n: int | None = None) -> Column:
    return F.array_join(items if n is None else _tail(items, n), "\n")


def adaptive_query(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, turn_number, specificity, query): text whose blocks and repetitions depend on how specific the
    session is. Unknown kinds are LL."""
    rows = turns.join(sessions, "session_id", "left")
    kind = F.coalesce("specificity", F.lit("LL"))
    request, goal = F.trim("request"), F.trim(F.coalesce("listener_goal", F.lit("")))
    profile = F.when(F.coalesce("culture", F.lit("")) != "", F.concat(F.lit("preferred musical culture: "), F.col("culture"))).otherwise("")
    said, played = F.col("requests"), F.col("music")
    text = (
        F.when(kind == "HH", F.concat(_block("CURRENT REQUEST", request, 3), _block("GOAL", goal)))
        .when(kind == "HL", F.concat(_block("CURRENT REQUEST", request, 2), _block("GOAL", goal), _block("RECENT USER CONTEXT", _lines(said, 1)), _block("RECENT MUSIC", _lines(played, 1))))
        .when(kind == "LH", F.concat(_block("CURRENT REQUEST", request, 2), _block("TARGET GOAL", goal, 2), _block("RECENT USER CONTEXT", _lines(said)), _block("RECENT MUSIC", _lines(played))))
        .otherwise(F.concat(
            _block("CURRENT REQUEST", request, 2), _block("DISCOVERY GOAL", goal, 2), _block("PREVIOUS USER PREFERENCES", _lines(said)),
            _block("RECENT MUSIC CONTEXT", _lines(played)), _block("USER MUSIC PREFERENCE", profile),
        ))
    )
    return rows.select("session_id", "turn_number", kind.alias("specificity"), F.array_join(text, "\n\n").alias("query"))


def goal_query(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, turn_number, query): the same blocks for all sessions, the goal with the session's kind."""
    rows = turns.join(sessions, "session_id", "left")
    goal = F.concat_ws(". ", F.when(F.col("listener_goal") != "", F.col("listener_goal")), F.concat(F.lit("specificity "), F.col("specificity")))
    profile = F.when(F.coalesce("culture", F.lit("")) != "", F.concat(F.lit("preferred musical culture "), F.col("culture"))).otherwise("")
    text = F.concat(
        _block("CURRENT USER REQUEST", F.col("request")), _block("MAIN MUSIC REQUEST", F.col("request")), _block("CONVERSATION GOAL", goal),
        _block("RECENT USER REQUESTS", _lines(F.col("requests"))), _block("RECENT MUSIC CONTEXT", _lines(F.col("music"))), _block("USER MUSIC PREFERENCE", profile),
    )
    return rows.select("session_id", "turn_number", F.array_join(text, "\n\n").alias("query"))


def ground_truth(messages: DataFrame, sessions: DataFrame, turns: int = 8) -> DataFrame:
    """(session_id, turn_number, gold, response) of every turn 1..turns: the second and third message of the turn.

    Turns with fewer messages have nulls, so that a check can count them."""
    said = messages.groupBy("session_id", "turn_number").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("m"))
    every = sessions.select("session_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(turns).cast("long"))).alias("turn_number"))
    rows = every.join(said, ["session_id", "turn_number"], "left")
    return rows.select("session_id", "turn_number", F.get("m", F.lit(1))["content"].alias("gold"), F.get("m", F.lit(2))["content"].alias("response"))
