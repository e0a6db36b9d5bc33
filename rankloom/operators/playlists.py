"""Playlists: ordered lists without repeats, a library folded from a command log, and what it shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ordered(entries: DataFrame, position: list[str], key: str = "id") -> DataFrame:
    """(key, track_ids): the tracks of each list in order, each where it stands first."""
    first = entries.groupBy(key, "track_id").agg(F.min(F.struct(*position)).alias("p"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "track_id"))), lambda s: s["track_id"]).alias("track_ids"))


def added(track_ids: Column, more: Column) -> Column:
    return F.array_union(track_ids, more)


def removed(track_ids: Column, gone: Column) -> Column:
    return F.array_except(track_ids, gone)


def unknown_ids(requests: DataFrame, catalog: DataFrame, key: str = "id") -> DataFrame:
    """(key, unknown) of requests (key, track_ids) that name tracks outside the catalog: such a request changes nothing."""
    asked = requests.select(key, F.explode("track_ids").alias("track_id")).distinct()
    return asked.join(catalog.select("track_id").distinct(), "track_id", "left_anti").groupBy(key).agg(F.sort_array(F.collect_list("track_id")).alias("unknown"))


def restored(playlists: DataFrame, catalog: DataFrame, key: str = "id") -> DataFrame:
    """(key, track_ids) without tracks that left the catalog, in order; an emptied list stays as an empty one."""
    each = playlists.select(key, F.posexplode("track_ids").alias("pos", "track_id"))
    kept = each.join(catalog.select("track_id").distinct(), "track_id", "left_semi")
    lists = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "track_id"))), lambda s: s["track_id"]).alias("kept"))
    return playlists.select(key).join(lists, key, "left").select(key, F.coalesce("kept", F.array().cast("array<string>")).alias("track_ids"))


def records(playlists: DataFrame, catalog: DataFrame, key: str = "id") -> DataFrame:
    """(key, pos, track columns) of the known tracks, pos from 1 over what the list holds."""
    each = playlists.select(key, F.posexplode("track_ids").alias("pos", "track_id"))
    return each.join(catalog, "track_id").withColumn("pos", F.col("pos") + 1)


def library(playlists: DataFrame, device: str = "device_id") -> DataFrame:
    """(device, place, id, name, track_count): newest first, the larger id first among equals."""
    order = Window.partitionBy(device).orderBy(F.desc("updated_at"), F.desc("id"))
    return playlists.select(device, F.row_number().over(order).alias("place"), "id", "name", F.size("track_ids").alias("track_count"))


def active(playlists: DataFrame, pointers: DataFrame, device: str = "device_id") -> DataFrame:
    """(device, id, name): the list that each device points at, if it is the device's own; else its newest, else a new
    empty one with a null id."""
    own = pointers.join(playlists.select(device, F.col("id").alias("active_id"), F.col("name").alias("own_name")), [device, "active_id"], "left")
    newest = playlists.groupBy(device).agg(F.max_by(F.struct("id", "name"), F.struct("updated_at", "id")).alias("n"))
    rows = own.join(newest, device, "left")
    mine = F.col("own_name").isNotNull()
    return rows.select(device, F.when(mine, F.col("active_id")).otherwise(F.col("n.id")).alias("id"), F.when(mine, F.col("own_name")).otherwise(F.coalesce("n.name", F.lit("My playlist"))).alias("name"))


def valid_name(name: Column) -> Column:
    return F.length(F.trim(F.coalesce(name, F.lit("")))).between(1, 100)


def folded_library(log: DataFrame, device: str = "device_id") -> DataFrame:
    """(device, id, name, track_ids, updated_at, is_active) after a log (device, seq, action, id, name, track_ids).

    Actions are new, save, rename, open and delete; commands on a list that isn't the device's own, on a deleted one or
    with a bad name count for nothing. A device's active list is the last that it made or opened and still has, else
    its newest. The whole fold is aggregates by (device, id), so a long log is summed before it is shuffled.
    """
    ok = log.where(~F.col("action").isin("new", "rename") | valid_name(F.col("name")))
    at = lambda *actions: F.when(F.col("action").isin(*actions), F.col("seq"))
    state = ok.groupBy(device, "id").agg(
        F.min(at("new")).alias("made"), F.max(at("delete")).alias("gone"), F.max_by("name", at("new", "rename")).alias("name"),
        F.max_by("track_ids", at("new", "save")).alias("track_ids"), F.max(at("new", "save", "rename")).alias("updated_at"), F.max(at("new", "open")).alias("opened"),
    )
    alive = state.where(F.col("made").isNotNull() & (F.col("gone").isNull() | (F.col("gone") < F.col("made"))))
    best = F.max(F.struct(F.col("opened"), F.col("id"))).over(Window.partitionBy(device))
    return alive.select(device, "id", F.trim("name").alias("name"), F.array_distinct(F.coalesce("track_ids", F.array().cast("array<string>"))).alias("track_ids"), "updated_at", (best["id"] == F.col("id")).alias("is_active"))


def folded_tracks(log: DataFrame, device: str = "device_id") -> DataFrame:
    """(device, lists, resets, track_ids): the list of each device after a log (device, seq, action, track_id) of new,
    clear, add and remove, with the tracks added since the last reset, in the order in which they came."""
    reset = log.where(F.col("action").isin("new", "clear")).groupBy(device).agg(F.max("seq").alias("reset"))
    sums = log.groupBy(device).agg(F.count_if(F.col("action") == "new").alias("lists"), F.count_if(F.col("action") == "clear").alias("resets"))
    moves = log.where(F.col("action").isin("add", "remove")).join(reset, device, "left").where(F.col("reset").isNull() | (F.col("seq") > F.col("reset")))
    last = moves.groupBy(device, "track_id").agg(F.max(F.when(F.col("action") == "remove", F.col("seq"))).alias("gone"), F.max(F.when(F.col("action") == "add", F.col("seq"))).alias("last"))
    # what counts is the first addition after the last removal
    firsts = moves.where("action = 'add'").join(last.select(device, "track_id", "gone"), [device, "track_id"]).where(F.col("gone").isNull() | (F.col("seq") > F.col("gone"))).groupBy(device, "track_id").agg(F.min("seq").alias("seq"))
    lists = firsts.groupBy(device).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "track_id"))), lambda s: s["track_id"]).alias("track_ids"))
    return sums.join(lists, device, "left").select(device, "lists", "resets", F.coalesce("track_ids", F.array().cast("array<string>")).alias("track_ids"))
