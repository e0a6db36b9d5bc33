"""Queries over streams: turns, session state, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.sources import adapters
from rankloom.sources.storage import fresh_path, staged
from rankloom.streaming import library as L, sessions as S, windows as W

_ACTIONS = {"signup": "new", "click": "add", "purchase": "save", "view": "open", "error": "clear"}


def _source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream of its files: of the one that it is, or of those in the folder that it is.

    The name is a pattern that only itself fits, since Spark takes a plain path for a folder.
    """
    schema = adapters.table(spark, sf_dir, table).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[{table[0]}]{table[1:]}.parquet")


def stream_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages as retrieval requests, as they arrive."""
    talk = _source(spark, sf_dir, "conversations").where("role = 'user' and trim(text) <> ''")
    return S.drained(talk.select(F.col("conv_id").alias("session_id"), (F.floor(F.col("turn") / 2) + 1).alias("turn_number"), F.trim("text").alias("request")), "turns")


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapters.catalog(spark, sf_dir).count()
    action = F.create_map(*(F.lit(x) for kv in _ACTIONS.items() for x in kv))
    rows = _source(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("device_id"), F.col("event_id").alias("seq"), action[F.col("event_type")].alias("action"), (F.get_json_object("props", "$.k").cast("long") % n).cast("string").alias("track_id"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.sessions(_commands(spark, sf_dir)), "sessions").select("device_id", "seq", "action", "tracks", "lists")


def stream_saved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each list of each device as it was saved after its last update."""
    path = fresh_path(spark, "saved-lists")
    S.autosave(S.sessions(_commands(spark, sf_dir)), path).awaitTermination()
    return S.saved_lists(spark, path)


#: What users say to suggestions, by event.
_SAID = ("add all of them", "the second one", "none of these", "all except the one by Brand#2", "first 2", "1 and 3", "number 9", "the last one", "add the one by Brand#1")


def stream_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in which three tracks are suggested at a time and users choose among them in words."""
    tracks = adapters.catalog(spark, sf_dir)
    n = tracks.count()
    near = tracks.select("track_id", F.col("artist_name")[0].alias("artist"), F.col("track_name")[0].alias("title"), "ord", F.explode(F.array(*map(F.lit, range(3)))).alias("place"))
    offers = near.groupBy(((F.col("ord") - F.col("place") + n) % n).alias("k")).agg(F.array_sort(F.collect_list(F.struct("place", "track_id", "artist", "title"))).alias("o"))
    names = F.to_json(F.map_from_arrays(F.col("o.track_id"), F.transform("o", lambda x: F.array(x["artist"], x["title"]))))
    offers = staged(offers.select("k", F.array_join("o.track_id", ",").alias("offered"), names.alias("names")), "offers")
    kind, rare = F.col("event_type"), F.col("event_id") % 4 == 0
    action = F.when(kind == "click", "suggest").when(kind == "signup", F.when(rare, "new").otherwise("remove")).when(kind == "error", F.when(rare, "clear").otherwise("add")).otherwise("say")
    said = F.array(*map(F.lit, _SAID))[(F.col("event_id") % len(_SAID)).cast("int")]
    rows = _source(spark, sf_dir, "events").select(F.col("user_id").alias("device_id"), F.col("event_id").alias("seq"), action.alias("action"), said.alias("said"), (F.get_json_object("props", "$.k").cast("long") % n).alias("k"))
    suggests = F.col("action") == "suggest"
    track = F.when(suggests, F.col("offered")).otherwise(F.col("k").cast("string"))
    request = F.when(suggests, F.concat(F.lit("request "), "k")).otherwise(F.col("said"))
    commands = rows.join(offers, "k", "left").select("device_id", "seq", "action", track.alias("track_id"), request.alias("request"), "names")
    return S.drained(S.sessions(commands), "choices").select("device_id", "seq", "action", "playlist", "waiting", "requests", "lists")


#: After so long a device has forgotten its suggestions and requests.
_IDLE_MS = 6 * 3_600_000


def stream_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices that make, open, rename, delete and fill several lists, as the events command."""
    n = adapters.catalog(spark, sf_dir).count()
    e, k = F.col("event_id"), F.col("k")
    text = lambda x: x.cast("string")
    rows = _source(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long") % n)
    case = lambda *pairs: F.element_at(F.array(*(F.struct(F.lit(a).alias("action"), b.cast("string").alias("argument")) for a, b in pairs)), (e % len(pairs) + 1).cast("int"))
    offer = F.concat_ws(",", text(k), text((k + 1) % n), text((k + 2) % n))
    command = F.create_map(
        F.lit("click"), case(("suggest", offer)), F.lit("purchase"), case(("add", k)), F.lit("view"), case(("open", k % 4), ("choose", F.lit("1,2")), ("choose", F.lit("1"))),
        F.lit("signup"), case(("new", F.concat(F.lit("list "), k)), ("rename", F.concat(F.lit(" name "), k)), ("delete", k % 4), ("new", F.lit("  "))),
        F.lit("error"), case(("clear", F.lit("")), ("remove", k), ("reject", F.lit("")), ("open", k % 3), ("rename", F.lit(" "))),
    )[F.col("event_type")]
    request = F.when(F.col("event_type") == "click", F.concat(F.lit("request "), k))
    commands = rows.select(F.col("user_id").alias("device_id"), e.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), command["action"].alias("action"), command["argument"].alias("argument"), request.alias("request"))
    return L.drained(L.library(commands, _IDLE_MS))


def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, "events").select("ts", "event_type", "value")
    return S.drained(S.tumbling(rows), "tumbling")


def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users that have closed: runs of events with less than four hours between them."""
    rows = _source(spark, sf_dir, "events").select("user_id", "ts", "value")
    return W.drained(W.session_windows(rows, gap="4 hours"))[0]


def events_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive once, twice or three times, each taken once, by user."""
    rows = _source(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))).alias("copy"))
    seen = W.drained(W.once(rows))[0]
    return seen.groupBy("user_id").agg(F.count("*").alias("events"), F.count_distinct("event_type").alias("types"), F.sum("event_id").alias("ids"))


QUERIES = {f.__name__: f for f in (stream_turns, stream_sessions, stream_saved_lists, stream_choices, stream_library, events_tumbling, events_sessions, events_once)}
_LOG = """log AS (SELECT user_id AS device_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'new' WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'save' WHEN 'view' THEN 'open' WHEN 'error' THEN 'clear' END AS action,
  CAST(json_extract_string(props, '$.k') AS BIGINT) % (SELECT count(*) FROM part) AS track FROM events)"""
_EPOCHS = """e AS (SELECT *, count(*) FILTER (action IN ('new', 'clear')) OVER d AS epoch, count(*) FILTER (action = 'new') OVER d AS lists FROM log WINDOW d AS (PARTITION BY device_id ORDER BY seq)),
f AS (SELECT *, CASE WHEN action = 'add' AND track IS NOT NULL AND row_number() OVER (PARTITION BY device_id, epoch, track, action = 'add' ORDER BY seq) = 1 THEN 1 ELSE 0 END AS fresh FROM e)"""
#: What is chosen of what waits, null if the words choose nothing that is there; m is the number of the words.
_CHOSEN = """CASE m WHEN 0 THEN waiting WHEN 1 THEN CASE WHEN len(waiting) >= 2 THEN waiting[2:2] END WHEN 2 THEN waiting[1:0]
  WHEN 3 THEN CASE WHEN len(list_filter(waiting, lambda x: contains(lower(x.artist), 'brand#2') OR contains(lower(x.title), 'brand#2'))) = 1 THEN list_filter(waiting, lambda x: NOT (contains(lower(x.artist), 'brand#2') OR contains(lower(x.title), 'brand#2'))) END
  WHEN 4 THEN CASE WHEN len(waiting) >= 2 THEN waiting[1:2] END WHEN 5 THEN CASE WHEN len(waiting) >= 3 THEN list_concat(waiting[1:1], waiting[3:3]) END WHEN 7 THEN waiting[-1:]
  WHEN 8 THEN CASE WHEN len(list_filter(waiting, lambda x: contains(lower(x.artist), 'brand#1'))) = 1 THEN list_filter(waiting, lambda x: contains(lower(x.artist), 'brand#1')) END END"""
#: One command after another: each round of the recursion is the next command of every device.
_CHOICES = f"""WITH RECURSIVE size AS (SELECT count(*) AS n FROM part),
tracks AS (SELECT p_partkey AS ord, {{'id': CAST(p_partkey AS VARCHAR), 'artist': p_brand, 'title': p_name}} AS t FROM part),
log AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % n AS k FROM events, size),
cmd AS (SELECT user_id AS device_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id % 9 AS m, k,
  CASE event_type WHEN 'click' THEN 'suggest' WHEN 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'new' ELSE 'remove' END WHEN 'error' THEN CASE WHEN event_id % 4 = 0 THEN 'clear' ELSE 'add' END ELSE 'say' END AS action,
  [a.t, b.t, c.t] AS offer FROM log JOIN tracks a ON a.ord = k JOIN tracks b ON b.ord = (k + 1) % n JOIN tracks c ON c.ord = (k + 2) % n),
st AS (SELECT DISTINCT device_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS action, CAST([] AS VARCHAR[]) AS playlist, offer[1:0] AS waiting, CAST([] AS VARCHAR[]) AS requests, 0 AS lists FROM cmd
UNION ALL SELECT device_id, i, seq, action,
  CASE WHEN action IN ('new', 'clear') THEN CAST([] AS VARCHAR[]) WHEN action = 'add' AND NOT list_contains(playlist, key) THEN list_append(playlist, key) WHEN action = 'remove' THEN list_filter(playlist, lambda x: x <> key)
    WHEN action = 'say' AND chosen IS NOT NULL THEN list_concat(playlist, list_filter(list_transform(chosen, lambda x: x.id), lambda x: NOT list_contains(playlist, x))) ELSE playlist END,
  CASE WHEN action IN ('new', 'clear') OR (action = 'say' AND chosen IS NOT NULL) THEN waiting[1:0] WHEN action = 'suggest' THEN offered ELSE waiting END,
  CASE WHEN action IN ('new', 'clear') THEN CAST([] AS VARCHAR[]) WHEN action = 'suggest' AND len(offered) > 0 THEN list_append(requests, concat('request ', key))[-2:] ELSE requests END,
  lists + CASE WHEN action = 'new' THEN 1 ELSE 0 END
  FROM (SELECT st.device_id, cmd.i, cmd.seq, cmd.action, CAST(k AS VARCHAR) AS key, playlist, waiting, requests, lists, list_filter(offer, lambda x: NOT list_contains(playlist, x.id)) AS offered, CASE WHEN len(waiting) > 0 THEN {_CHOSEN} END AS chosen
    FROM st JOIN cmd ON cmd.device_id = st.device_id AND cmd.i = st.i + 1))
SELECT device_id, seq, action, array_to_string(playlist, ',') AS playlist, array_to_string(list_transform(waiting, lambda x: x.id), ',') AS waiting, array_to_string(requests, '|') AS requests, CAST(lists AS INT) AS lists FROM st WHERE i > 0"""
_SAME = "list_transform(lists, lambda x: CASE WHEN x.id = active THEN {'id': x.id, 'name': %s, 'tracks': %s, 'changed': seq} ELSE x END)"
#: The same for several lists: each round takes the next command of every device.
_LIBRARY = f"""WITH RECURSIVE size AS (SELECT count(*) AS n FROM part),
log AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % n AS k FROM events, size),
cmd AS (SELECT user_id AS device_id, event_id AS seq, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
  CASE event_type WHEN 'click' THEN 'suggest' WHEN 'purchase' THEN 'add' WHEN 'view' THEN ['open', 'choose', 'choose'][event_id % 3 + 1] WHEN 'signup' THEN ['new', 'rename', 'delete', 'new'][event_id % 4 + 1] ELSE ['clear', 'remove', 'reject', 'open', 'rename'][event_id % 5 + 1] END AS action,
  CASE event_type WHEN 'view' THEN k % 4 WHEN 'signup' THEN k % 4 ELSE k % 3 END AS wanted, CAST(k AS VARCHAR) AS key, CASE WHEN event_id % 3 = 1 THEN 2 ELSE 1 END AS most,
  CASE WHEN event_type = 'error' THEN '' WHEN event_id % 4 = 0 THEN concat('list ', k) WHEN event_id % 4 = 1 THEN concat('name ', k) ELSE 'Untitled playlist' END AS called,
  [CAST(k AS VARCHAR), CAST((k + 1) % n AS VARCHAR), CAST((k + 2) % n AS VARCHAR)] AS offer FROM log),
st AS (SELECT DISTINCT device_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS action, true AS done, [{{'id': 0::BIGINT, 'name': 'My playlist', 'tracks': CAST([] AS VARCHAR[]), 'changed': 0::BIGINT}}] AS lists, CAST(0 AS BIGINT) AS active, CAST(1 AS BIGINT) AS next,
  CAST([] AS VARCHAR[]) AS waiting, CAST([] AS VARCHAR[]) AS requests, CAST(NULL AS TIMESTAMP) AS seen FROM cmd
UNION ALL SELECT device_id, i, seq, action, done, lists2, active2, next2,
  CASE WHEN active2 <> active OR (done AND action IN ('choose', 'reject', 'clear')) THEN CAST([] AS VARCHAR[]) WHEN done AND action = 'suggest' THEN offered ELSE waiting END,
  CASE WHEN active2 <> active OR action = 'clear' THEN CAST([] AS VARCHAR[]) WHEN done AND action = 'suggest' THEN list_append(requests, concat('request ', key))[-2:] ELSE requests END, greatest(coalesce(seen, ts), ts)
  FROM (SELECT *, CASE WHEN action = 'new' THEN next WHEN action = 'open' AND done THEN wanted WHEN emptied THEN next WHEN action = 'delete' AND done AND wanted = active THEN list_sort(list_transform(rest, lambda x: {{'c': x.changed, 'i': x.id}}), 'DESC')[1].i ELSE active END AS active2,
    next + CASE WHEN action = 'new' OR emptied THEN 1 ELSE 0 END AS next2,
    CASE WHEN NOT done THEN lists WHEN action = 'new' THEN list_append(lists, {{'id': next, 'name': called, 'tracks': CAST([] AS VARCHAR[]), 'changed': seq}}) WHEN emptied THEN [{{'id': next, 'name': 'My playlist', 'tracks': CAST([] AS VARCHAR[]), 'changed': seq}}] WHEN action = 'delete' THEN rest
      WHEN action = 'rename' THEN {_SAME % ("called", "x.tracks")} WHEN action = 'clear' THEN {_SAME % ("x.name", "CAST([] AS VARCHAR[])")} WHEN action = 'remove' THEN {_SAME % ("x.name", "list_filter(x.tracks, lambda y: y <> key)")}
      WHEN action = 'add' THEN {_SAME % ("x.name", "CASE WHEN list_contains(x.tracks, key) THEN x.tracks ELSE list_append(x.tracks, key) END")} WHEN action = 'choose' THEN {_SAME % ("x.name", "list_concat(x.tracks, list_filter(waiting[1:most], lambda y: NOT list_contains(x.tracks, y)))")} ELSE lists END AS lists2
  FROM (SELECT *, CASE action WHEN 'open' THEN there WHEN 'delete' THEN there WHEN 'rename' THEN called <> '' WHEN 'suggest' THEN len(offered) > 0 WHEN 'choose' THEN len(waiting) >= most ELSE true END AS done, action = 'delete' AND there AND len(rest) = 0 AS emptied
  FROM (SELECT st.device_id, cmd.i, cmd.seq, cmd.ts, cmd.action, wanted, key, most, called, lists, active, next, seen, CASE WHEN cmd.ts - seen > INTERVAL {_IDLE_MS // 1000} SECOND THEN CAST([] AS VARCHAR[]) ELSE waiting END AS waiting, CASE WHEN cmd.ts - seen > INTERVAL {_IDLE_MS // 1000} SECOND THEN CAST([] AS VARCHAR[]) ELSE requests END AS requests,
    len(list_filter(lists, lambda x: x.id = wanted)) > 0 AS there, list_filter(lists, lambda x: x.id <> wanted) AS rest, list_filter(offer, lambda y: NOT list_contains(list_filter(lists, lambda x: x.id = active)[1].tracks, y)) AS offered
    FROM st JOIN cmd ON cmd.device_id = st.device_id AND cmd.i = st.i + 1))))
SELECT device_id, seq, action, done, active, list_filter(lists, lambda x: x.id = active)[1].name AS name, array_to_string(list_filter(lists, lambda x: x.id = active)[1].tracks, ',') AS tracks, array_to_string(waiting, ',') AS waiting, array_to_string(requests, '|') AS requests, CAST(len(lists) AS INT) AS lists FROM st WHERE i > 0"""
SQL = {
    "stream_choices": _CHOICES,
    "stream_library": _LIBRARY,
    "stream_turns": "SELECT conv_id AS session_id, turn // 2 + 1 AS turn_number, trim(text) AS request FROM conversations WHERE role = 'user' AND trim(text) <> ''",
    "stream_sessions": f"""WITH {_LOG}, {_EPOCHS}
SELECT device_id, seq, action, CAST(sum(fresh) OVER (PARTITION BY device_id, epoch ORDER BY seq) AS INT) AS tracks, CAST(lists AS INT) AS lists FROM f""",
    "stream_saved_lists": f"""WITH {_LOG}, {_EPOCHS}, u AS (SELECT device_id, lists, max(epoch) AS epoch, max(seq) FILTER (action IN ('new', 'clear', 'add')) AS last FROM f GROUP BY 1, 2)
SELECT u.device_id, CAST(u.lists AS INT) AS lists, u.last AS seq, coalesce(string_agg(CAST(track AS VARCHAR), ',' ORDER BY f.seq) FILTER (fresh = 1), '') AS playlist
FROM u JOIN f ON f.device_id = u.device_id AND f.lists = u.lists AND f.epoch = u.epoch WHERE u.last IS NOT NULL GROUP BY 1, 2, 3""",
    "events_once": "SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS types, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY user_id",
    "events_sessions": """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 4 HOUR AS ended, count(*) AS n, round(sum(value), 4) AS total FROM n GROUP BY user_id, island HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "events_tumbling": """WITH w AS (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 30 MINUTE FROM events)""",
}
