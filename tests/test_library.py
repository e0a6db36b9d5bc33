"""Sessions with several lists: commands by hand against a plain reading, switches, restarts and expiry."""

import datetime as dt
import random

import pytest

from rankloom.streaming import library as L, sessions

SCHEMA = "device_id long, seq long, ts timestamp, action string, argument string, request string"
START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def plain(commands, idle_ms=L.IDLE_MS):
    """Rows after each command, by plain code over dicts."""
    out, devices = set(), {}
    for device, seq, ts, action, arg, request in sorted(commands, key=lambda c: (c[0], c[1])):
        s = devices.setdefault(device, {"lists": {0: ["My playlist", [], 0]}, "active": 0, "next": 1, "waiting": [], "requests": [], "seen": ts})
        if (ts - s["seen"]).total_seconds() * 1000 > idle_ms:
            s["waiting"], s["requests"] = [], []
        s["seen"], arg, done, was = max(ts, s["seen"]), arg or "", True, s["active"]
        wanted, now = int(arg) if arg.isdigit() else -1, s["lists"][s["active"]]

        def make(name):
            s["lists"][s["next"]] = [name, [], seq]  # noqa: B023
            s["active"], s["next"] = s["next"], s["next"] + 1  # noqa: B023

        if action == "new" and len(arg.strip()) <= 100:
            make(arg.strip() or "Untitled playlist")
        elif action == "open" and wanted in s["lists"]:
            s["active"] = wanted
        elif action == "delete" and wanted in s["lists"]:
            del s["lists"][wanted]
            if wanted == was:
                if s["lists"]:
                    s["active"] = max(s["lists"], key=lambda i: (s["lists"][i][2], i))  # noqa: B023
                else:
                    make("My playlist")
        elif action == "rename" and 0 < len(arg.strip()) <= 100:
            now[0], now[2] = arg.strip(), seq
        elif action == "suggest" and (found := [t for t in dict.fromkeys(arg.split(",")) if t and t not in now[1]]):
            s["waiting"] = found
            s["requests"] = [*s["requests"], *([request] if request else [])][-2:]
        elif action == "reject":
            s["waiting"] = []
        elif action == "choose" and (places := [int(p) for p in arg.split(",") if p.isdigit()]) and all(0 < p <= len(s["waiting"]) for p in places):
            now[1] += [t for t in dict.fromkeys(s["waiting"][p - 1] for p in places) if t not in now[1]]
            now[2], s["waiting"] = seq, []
        elif action == "add" and arg:
            now[1] += [] if arg in now[1] else [arg]
            now[2] = seq
        elif action == "remove" and arg:
            now[1], now[2] = [t for t in now[1] if t != arg], seq
        elif action == "clear":
            now[1], now[2], s["waiting"], s["requests"] = [], seq, [], []
        else:
            done = False
        if s["active"] != was:
            s["waiting"], s["requests"] = [], []
        now = s["lists"][s["active"]]
        out.add((device, seq, action, done, s["active"], now[0], ",".join(now[1]), ",".join(s["waiting"]), "|".join(s["requests"]), len(s["lists"])))
    return out


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def run(spark, folder, batches, out="out"):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{out}-{n}")
        source = sessions.turn_source(spark, f"{folder}/in/*", SCHEMA)
        found = L.drained(L.library(source), f"{folder}/{out}")
    return {tuple(r[c] for c in L.COLUMNS) for r in found.collect()}


STORY = [
    (1, 1, at(0), "add", "1", None), (1, 2, at(1), "suggest", "2,3,1", "more like it"), (1, 3, at(2), "new", "Other", None), (1, 4, at(3), "choose", "1", None), (1, 5, at(4), "rename", " Gym ", None), (1, 6, at(5), "add", "9", None),
    (1, 7, at(6), "open", "0", None), (1, 8, at(7), "add", "3", None), (1, 9, at(8), "open", "1", None), (1, 10, at(9), "open", "7", None), (1, 11, at(10), "delete", "1", None), (1, 12, at(11), "delete", "0", None),
    (1, 13, at(12), "rename", "x" * 101, None), (1, 14, at(13), "new", "", None), (1, 15, at(14), "suggest", "5,6", "calm"), (1, 16, at(80), "choose", "1", None), (1, 17, at(81), "suggest", "5,6", "calm"), (1, 18, at(82), "choose", "2,1", None),
    (2, 1, at(5), "open", "1", None), (2, 2, at(6), "show", None, None), (2, 3, at(7), "add", None, None), (2, 4, at(8), "clear", None, None),
]


def test_story_of_two_devices(spark, tmp_path):
    found = run(spark, tmp_path, [STORY])
    assert found == plain(STORY)
    rows = {(r[0], r[1]): r for r in found}
    assert rows[1, 4][3] is False and rows[1, 4][6] == ""  # a switch discards what was suggested
    assert rows[1, 7][6] == "1" and rows[1, 9][5:7] == ("Gym", "9")  # lists come back as they were left
    assert rows[1, 12][5] == "My playlist" and rows[1, 16][3] is False and rows[1, 18][6] == "6,5"
    assert rows[2, 1][3] is False


def test_restarts_and_timers_change_nothing(spark, tmp_path):
    rng = random.Random(2)
    actions = ["new", "open", "rename", "delete", "add", "add", "remove", "clear", "suggest", "suggest", "choose", "choose", "reject"]
    commands, minute = [], 0
    for seq in range(240):
        minute += rng.choice([1, 1, 2, 5, 40])
        action = rng.choice(actions)
        arg = {"new": rng.choice(["A", "", "B"]), "rename": rng.choice(["C", "  "]), "suggest": ",".join(map(str, rng.sample(range(6), 3))), "choose": rng.choice(["1", "2,3", "9"])}.get(action, str(rng.randint(0, 5)))
        commands.append((rng.randint(1, 3), seq, at(minute), action, arg, rng.choice([None, f"request {seq}"])))
    found = run(spark, tmp_path, [commands[:60], commands[60:61], commands[61:150], commands[150:]])
    assert found == plain(commands)


@pytest.mark.parametrize("bad", [(3, 1, at(0), None, None, None), (3, 1, at(0), "choose", "x", None)])
def test_odd_commands_change_nothing(spark, tmp_path, bad):
    assert [r[3:7] for r in run(spark, tmp_path, [[bad]])] == [(False, 0, "My playlist", "")]
