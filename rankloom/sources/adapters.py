"""The engine's relations, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks: list-valued names and tags, popularity, a date that is never known, a duration in s, ms or 0, and ord,
    the first-seen position."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return part.select(
        key.cast("string").alias("track_id"),
        F.array("p_name").alias("track_name"),
        F.array("p_brand").alias("artist_name"),
        F.array("p_type").alias("album_name"),
        F.array_append(F.split("p_name", " "), F.lower("p_type")).alias("tag_list"),
        F.col("p_retailprice").alias("popularity"),
        F.lit(None).cast("string").alias("release_date"),
        F.when(key % 5 == 0, 0).when(key % 5 == 1, F.col("p_size") * 10).otherwise(F.col("p_size") * 10000).cast("double").alias("duration"),
        key.alias("ord"),
    )


def catalog_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import rows (track_id, name, popularity, seq): all tracks, then every tenth again with other values."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    first = part.select(F.col("p_partkey").cast("string").alias("track_id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("popularity"), F.col("p_partkey").alias("seq"))
    again = part.where("p_partkey % 10 = 0").select(F.col("p_partkey").cast("string"), F.concat("p_name", F.lit(" (new)")), F.col("p_retailprice") + 1, F.col("p_partkey") + 1_000_000_000_000)
    return first.union(again)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages (session_id, pos, turn_number, role, content): two positions make a turn, and every assistant message
    is followed by a music message whose content is a track id."""
    n = catalog(spark, sf_dir).count()
    talk = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    base = talk.select(F.col("conv_id").alias("session_id"), (F.col("turn") * 2).alias("pos"), (F.floor(F.col("turn") / 2) + 1).alias("turn_number"), "role", F.col("text").alias("content"))
    music = talk.where("role = 'assistant'").select(
        "conv_id", F.col("turn") * 2 + 1, F.floor(F.col("turn") / 2) + 1, F.lit("music"), ((F.col("conv_id") * 31 + F.col("turn") * 7) % n).cast("string")
    )
    return base.union(music)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, listener_goal, specificity, culture, ord): the goal is the first user message; every seventh session
    has no specificity and every third no culture."""
    talk = table(spark, sf_dir, "conversations")
    goal = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    kind = F.element_at(F.array(*map(F.lit, ("HH", "HL", "LH", "LL"))), (F.col("session_id") % 4 + 1).cast("int"))
    out = talk.groupBy(F.col("conv_id").alias("session_id")).agg(goal.alias("listener_goal"))
    return out.select(
        "session_id",
        "listener_goal",
        F.when(F.col("session_id") % 7 != 0, kind).alias("specificity"),
        F.when(F.col("session_id") % 3 != 0, F.concat(F.lit("culture "), F.col("session_id") % 5)).alias("culture"),
        F.col("session_id").alias("ord"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, items): every fiftieth vector asks, the rest answer. Vectors are doubles."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")
    return rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), rows.where("vec_id % 50 <> 0").withColumnRenamed("vec_id", "item_id")


def specificity(queries: DataFrame) -> DataFrame:
    """(query_id, specificity) of the vector queries, cycling through the four kinds."""
    kind = F.element_at(F.array(*map(F.lit, ("HH", "HL", "LH", "LL"))), (F.floor(F.col("query_id") / 50) % 4 + 1).cast("int"))
    return queries.select("query_id", kind.alias("specificity"))


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("device_id"), F.concat(F.lit("list "), F.col("o_orderkey")).alias("name"), F.col("o_orderdate").alias("updated_at"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, track_id, line, supp, price): entries of playlists; the last three give the position."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_partkey").cast("string").alias("track_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price")
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command log (device_id, seq, ts, action, track_id) from the events."""
    n = catalog(spark, sf_dir).count()
    action = F.create_map(*map(F.lit, ("signup", "new", "click", "add", "purchase", "save", "view", "open", "error", "clear")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("device_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), action[F.col("event_type")].alias("action"),
        (F.get_json_object("props", "$.k").cast("long") % n).cast("string").alias("track_id"),
    )
