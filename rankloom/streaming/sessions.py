"""Dialogue sessions and play logs as streams: per-session state, and event-time windows with a watermark."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankloom.functions.messages import choice
from rankloom.sources import tables
from rankloom.sources.storage import fresh_path

#: Requests that a session remembers.
MEMORY = 2
#: Commands after which the active list is saved.
UPDATES = ("new", "clear", "add", "remove", "choose", "say")


def turn_source(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Turns or commands as they arrive in files at path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def step(state: dict, action: str | None, track: str | None, request: str | None, names: dict | None = None, picked: tuple | None = None) -> dict:
    """The state of a session after one command; unknown commands change nothing.

    A session holds its playlist, suggestions waiting for a choice with their artists and titles, the last requests, and
    the last track asked for. names is {track: [artist, title]} of what is suggested; picked is what a message said.
    """
    state = {k: v.copy() if isinstance(v, (list, dict)) else v for k, v in state.items()}
    if action in ("new", "clear"):
        return start() | {"lists": state["lists"] + (action == "new")}
    if action == "add" and track is not None and track not in state["playlist"]:
        state["playlist"].append(track)
    elif action == "remove" and track in state["playlist"]:
        state["playlist"].remove(track)
    elif action == "suggest" and track is not None:
        state["pending"] = [t for t in dict.fromkeys(track.split(",")) if t not in state["playlist"]]
        state["names"] = {t: (names or {}).get(t, []) for t in state["pending"]}
        if state["pending"] and request:
            state["requests"] = [*state["requests"], request][-MEMORY:]
    elif action == "choose" and track is not None:
        places = [int(p) for p in track.split(",") if p.isdigit()]
        _take(state, ("places", places, ""))
    elif action == "say" and picked is not None:
        _take(state, picked)
    elif action == "reject":
        _take(state, ("none", [], ""))
    elif action == "open":
        state["last"] = track
    return state


def _take(state: dict, picked: tuple) -> None:
    """Moves what was chosen, as messages.choice tells it, from the suggestions into the list. What can't be done (a place
    that is not there, a name that fits none or several) changes nothing, and the suggestions go on waiting."""
    kind, numbers, name = picked
    waiting, found = state["pending"], None
    called = lambda t, fields: any(name.casefold() in (x or "").casefold() for x in state["names"].get(t, [])[:fields])
    if kind == "none":
        found = []
    elif kind == "all":
        found = waiting
    elif kind in ("first", "places"):
        places = [len(waiting) if p == -1 else p for p in numbers]
        if places and all(0 < p <= len(waiting) for p in places):
            found = waiting[: places[0]] if kind == "first" else [waiting[p - 1] for p in places]
    elif kind in ("except", "by"):
        fitting = [t for t in waiting if name and called(t, 1 if kind == "by" else 2)]
        if len(fitting) == 1:
            found = fitting if kind == "by" else [t for t in waiting if t not in fitting]
    if waiting and found is not None:
        state["playlist"] += [t for t in dict.fromkeys(found) if t not in state["playlist"]]
        state["pending"], state["names"] = [], {}


def start() -> dict:
    return {"playlist": [], "pending": [], "names": {}, "requests": [], "last": None, "lists": 0}


def sessions(commands: DataFrame, key: str = "device_id") -> DataFrame:
    """(key, seq, action, tracks, pending, lists, playlist, waiting, requests): the state after each command of a stream
    (key, seq, action, track_id [, request, names]); playlist and waiting are track ids joined by commas, requests by |.

    A request goes with a suggestion and is remembered, or is what a user says to choose among suggestions. names is a
    JSON object of suggested tracks to [artist, title]. Commands of a batch are taken in order of seq; state lives in the
    state store under the key.
    """
    rows = commands
    for c in ("request", "names"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    picked = choice(F.when(F.col("action") == "say", F.col("request")).otherwise(""))
    rows = rows.withColumn("picked", picked).select(key, "seq", "action", "track_id", "request", "names", "picked.kind", "picked.numbers", F.col("picked.name").alias("said"))
    type_of_key = rows.schema[key].dataType.simpleString()
    columns = [key, "seq", "action", "tracks", "pending", "lists", "playlist", "waiting", "requests"]

    def advance(group: tuple, frames: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(store.get[0]) if store.exists else start()
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            action, track, request, names, kind, said = (x if isinstance(x, str) else None for x in (r.action, r.track_id, r.request, r.names, r.kind, r.said))
            state = step(state, action, track, request, json.loads(names) if names else None, (kind, [int(n) for n in r.numbers], said) if kind else None)
            texts = (",".join(state["playlist"]), ",".join(state["pending"]), "|".join(state["requests"]))
            out.append((group[0], r.seq, r.action, len(state["playlist"]), len(state["pending"]), state["lists"], *texts))
        store.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=columns)

    schema = f"{key} {type_of_key}, seq long, action string, tracks int, pending int, lists int, playlist string, waiting string, requests string"
    return rows.groupBy(key).applyInPandasWithState(advance, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def autosave(states: DataFrame, path: str, key: str = "device_id", compact_every: int = 0) -> StreamingQuery:
    """Saves the lists of a stream of states, as `sessions` gives them, at path after the updates of each batch.

    A created list has a number of its own, so it is saved beside the former ones, which stay; other updates are saved to
    the active list. A batch that is run again overwrites its own files, so that each state is saved once. Runs over all
    that is there; a later call with the same path goes on where this one ended. With compact_every, saved batches are
    merged after each so many.
    """

    def save(batch: DataFrame, number: int) -> None:
        updates = batch.where(F.col("action").isin(*UPDATES))
        last = updates.groupBy(key, "lists").agg(F.max("seq").alias("seq"), F.max_by("playlist", "seq").alias("playlist"))
        last.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        if compact_every and number % compact_every == compact_every - 1:
            compact_lists(batch.sparkSession, path, key)

    return states.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start()


def _batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name[6:]) for name in tables.folders(spark, path) if name.startswith("batch-"))


def compact_lists(spark: SparkSession, path: str, key: str = "device_id", buckets: int = tables.BUCKETS) -> int:
    """Merges the batches saved at path into the table beside it, drops their folders and returns how many there were.

    No batch may be saved meanwhile but by the caller. The table notes the last batch that it has, so that after a loss
    between the merge and the drop, batches that are still there or are saved again count once. Lists without a key are
    kept as those of a device of their own.
    """
    there = _batches(spark, path)
    if not there:
        return 0
    rows = spark.read.parquet(*(f"{path}/batch-{n}" for n in there))
    if not rows.isEmpty():
        # an array holds a null, which no key of a table may be
        last = rows.groupBy(key, "lists").agg(F.max("seq").alias("seq"), F.max_by("playlist", "seq").alias("playlist"))
        tables.merge(last.withColumns({"device": F.array(key), "at": F.col("seq")}), f"{path}-table", ("device", "lists"), "at", buckets, batch=there[-1])
    for n in there:
        tables.removed(spark, f"{path}/batch-{n}")
    return len(there)


def saved_lists(spark: SparkSession, path: str, key: str = "device_id") -> DataFrame:
    """(key, lists, seq, playlist): each list that was saved at path, as it was saved last, merged batches included."""
    parts = [spark.read.parquet(*(f"{path}/batch-{n}" for n in there))] if (there := _batches(spark, path)) else []
    if tables.versions(spark, f"{path}-table"):
        parts.append(tables.load(spark, f"{path}-table"))
    rows = reduce(DataFrame.unionByName, (p.select(key, "lists", "seq", "playlist") for p in parts))
    return rows.groupBy(key, "lists").agg(F.max("seq").alias("seq"), F.max_by("playlist", "seq").alias("playlist"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of event-time windows; what comes later than `late` is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def drained(stream: DataFrame, label: str) -> DataFrame:
    """Runs a stream over all that is there, into a Parquet table with its checkpoint in the shared folder, and reads it."""
    spark = stream.sparkSession
    out = fresh_path(spark, f"stream-{label}")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
