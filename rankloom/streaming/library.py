"""Sessions with several saved lists: a stateful stream whose state is a map of lists, the last requests and what is open.

Each part of the state is a variable of its own in the state store: a list that is not touched is neither read nor
written, and one that is touched is read and written once a batch, however many commands come in it. A device that was idle for a while forgets its suggestions and requests; a timer
takes them out of the store, and a command that comes after such a time finds them gone whether or not the timer ran.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rankloom.sources.storage import fresh_path

#: Names of lists that nobody named, and the longest name.
FIRST, UNNAMED, LONGEST = "My playlist", "Untitled playlist", 100
#: Requests that a session remembers, and how long it does.
MEMORY, IDLE_MS = 2, 3_600_000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Lists:
    """The lists of a device while its commands are taken: each is read once, and what changed is written at the end."""

    def __init__(self, state):
        self.state = state
        self.there = {i for (i,) in state.keys()}
        self.read: dict[int, tuple] = {}
        self.changed: set[int] = set()
        self.gone: set[int] = set()

    def get(self, i: int) -> tuple:
        if i not in self.read:
            name, tracks, changed = self.state.getValue((i,))
            self.read[i] = (name, list(tracks), changed)
        return self.read[i]

    def put(self, i: int, name: str, tracks: list[str], changed: int) -> None:
        self.read[i] = (name, tracks, changed)
        self.there.add(i)
        self.changed.add(i)

    def drop(self, i: int) -> None:
        self.there.remove(i)
        self.read.pop(i, None)
        self.changed.discard(i)
        self.gone.add(i)

    def save(self) -> None:
        for i in self.gone - self.there:
            if self.state.containsKey((i,)):
                self.state.removeKey((i,))
        for i in self.changed:
            self.state.updateValue((i,), self.read[i])


class Library(StatefulProcessor):
    """new, open, rename, delete; add, remove, clear; suggest, choose, reject: one command after another for each device.

    A device begins with one empty list. A list that is opened or made becomes the active one, and suggestions and
    requests of the one before are gone. The last list that is deleted makes room for a new empty one; of others the one
    changed last becomes active. What can't be done (a list that is not there, a blank or overlong name, a place
    that is not suggested) changes nothing.
    """

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lists = handle.getMapState("lists", "id long", "name string, tracks array<string>, changed long")
        self.requests = handle.getListState("requests", "request string")
        self.now = handle.getValueState("now", "active long, next long, waiting array<string>, seen long, timer long")

    def close(self) -> None:
        pass

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.now.exists():
            active, number, _, seen, _ = self.now.get()
            self.now.update((active, number, [], seen, None))
        self.requests.clear()
        return iter([])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.now.exists():
            active, number, waiting, seen, timer = self.now.get()
        else:
            active, number, waiting, seen, timer = 0, 1, [], None, None
        lists = _Lists(self.lists)
        if not self.now.exists():
            lists.put(0, FIRST, [], 0)
        requests = [r[0] for r in self.requests.get()]
        waiting, out = list(waiting or ()), []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            at, action, arg = int(r.ms), r.action, r.argument if isinstance(r.argument, str) else ""
            if seen is not None and at - seen > self.idle_ms:
                waiting, requests = [], []
            seen = at if seen is None else max(at, seen)
            before = active
            done, active, number, waiting, requests = self.step(int(r.seq), action, arg, r.request if isinstance(r.request, str) else None, active, number, waiting, requests, lists)
            if active != before:
                waiting, requests = [], []
            name, tracks, _ = lists.get(active)
            out.append((key[0], int(r.seq), action, done, active, name, ",".join(tracks), ",".join(waiting), "|".join(requests), len(lists.there)))
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = None
        if waiting or requests:
            timer = max(seen + self.idle_ms + 1, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(timer)
        if requests:
            self.requests.put([(x,) for x in requests])
        else:
            self.requests.clear()
        lists.save()
        self.now.update((active, number, waiting, seen, timer))
        yield pd.DataFrame(out, columns=COLUMNS)

    def step(self, seq: int, action: str, arg: str, request: str | None, active: int, number: int, waiting: list[str], requests: list[str], lists: _Lists) -> tuple:
        """(done, active, next number, waiting, requests) after one command, which changes lists."""
        same = (False, active, number, waiting, requests)
        wanted = int(arg) if arg.isdigit() else -1
        there = lambda i: i in lists.there
        if action == "new":
            name = arg.strip() or UNNAMED
            if len(name) > LONGEST:
                return same
            lists.put(number, name, [], seq)
            return True, number, number + 1, [], []
        if action == "open":
            return (True, wanted, number, waiting, requests) if there(wanted) else same
        if action == "delete":
            if not there(wanted):
                return same
            lists.drop(wanted)
            if wanted != active:
                return True, active, number, waiting, requests
            left = [(lists.get(i)[2], i) for i in lists.there]
            if left:
                return True, max(left)[1], number, [], []
            lists.put(number, FIRST, [], seq)
            return True, number, number + 1, [], []
        name, tracks, _ = lists.get(active)
        tracks = list(tracks)
        if action == "rename":
            if not 0 < len(arg.strip()) <= LONGEST:
                return same
            lists.put(active, arg.strip(), tracks, seq)
            return True, active, number, waiting, requests
        if action == "suggest":
            found = [t for t in dict.fromkeys(filter(None, arg.split(","))) if t not in tracks]
            return (True, active, number, found, [*requests, request][-MEMORY:] if found and request else requests) if found else same
        if action == "reject":
            return True, active, number, [], requests
        if action == "choose":
            places = [int(p) for p in arg.split(",") if p.isdigit()]
            if not places or not all(0 < p <= len(waiting) for p in places):
                return same
            tracks += [t for t in dict.fromkeys(waiting[p - 1] for p in places) if t not in tracks]
            waiting = []
        elif action == "add" and arg:
            tracks = tracks if arg in tracks else [*tracks, arg]
        elif action == "remove" and arg:
            tracks = [t for t in tracks if t != arg]
        elif action == "clear":
            tracks, waiting, requests = [], [], []
        else:
            return same
        lists.put(active, name, tracks, seq)
        return True, active, number, waiting, requests


COLUMNS = ["device_id", "seq", "action", "done", "active", "name", "tracks", "waiting", "requests", "lists"]


def library(commands: DataFrame, idle_ms: int = IDLE_MS, late: str = "10 minutes") -> DataFrame:
    """(device_id, seq, action, done, active, name, tracks, waiting, requests, lists): what is open after each command of
    a stream (device_id, seq, ts, action, argument, request)."""
    kind = commands.schema["device_id"].dataType.simpleString()
    rows = commands.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    schema = f"device_id {kind}, seq long, action string, done boolean, active long, name string, tracks string, waiting string, requests string, lists int"
    return rows.groupBy("device_id").transformWithStateInPandas(Library(idle_ms), schema, "append", "EventTime")


@contextmanager
def many_variables(spark: SparkSession):
    """Streams that start within have a state store that can hold several variables of a key."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def drained(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Runs the stream over all that is there and reads what it wrote at path; a later call with the same path goes on."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, "library")
    with many_variables(spark):
        writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").outputMode("append")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
