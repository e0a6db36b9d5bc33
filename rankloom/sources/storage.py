"""Tables in shared storage: staged results and their end, imports that commit by a marker, chunks that resume, JSON lists."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StructType

from rankloom.sources import tables


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor shares; the warehouse's if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/rankloom-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that one run makes for itself: a label, a number of their own, and what belongs to it.
_OWN = re.compile(r"rankloom-(?!index-).+-[0-9a-f]{32}(-checkpoint|-table|-table-checkpoint)?")


def clear_staged(spark: SparkSession, idle_hours: float = 72) -> list[str]:
    """Drops the staged tables of former runs from the shared folder, and returns their names in order.

    They are those that have not changed for idle_hours, so no run that still reads its tables may be older. Indexes that
    later runs find by a digest stay, and so does whatever has another name.
    """
    before = (time.time() - idle_hours * 3600) * 1000
    folder = shared_dir(spark)
    old = sorted(name for name, changed in tables.folders(spark, folder).items() if _OWN.fullmatch(name) and changed <= before)
    return [name for name in old if tables.removed(spark, f"{folder}/{name}")]


def upserted(rows: DataFrame, key: str = "track_id", order: str = "seq") -> DataFrame:
    """One row a key: the values of its last row, and `ord`, the place where it was first seen. Null keys go."""
    values = [c for c in rows.columns if c not in (key, order)]
    known = rows.where(F.col(key).isNotNull())
    last = known.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("v"), F.min(order).alias("ord"))
    return last.select(key, *(F.col("v")[c].alias(c) for c in values), "ord")


def import_catalog(rows: DataFrame, path: str, source: str, schema_version: int = 1, key: str = "track_id", order: str = "seq") -> int:
    """Imports rows as a catalog at path and returns its size. A marker written last makes it visible.

    Nothing imported, or a count that the written table doesn't have, is an error, and then there is no marker.
    """
    spark = rows.sparkSession
    data = f"{path}/data-{uuid.uuid4().hex}"
    upserted(rows, key, order).write.parquet(data)
    wanted, found = rows.where(F.col(key).isNotNull()).select(key).distinct().count(), spark.read.parquet(data).count()
    if not found or found != wanted:
        raise ValueError(f"imported {found} of {wanted} tracks")
    marker = spark.createDataFrame([(source, schema_version, found, data)], "source string, schema_version int, track_count long, data string")
    marker.coalesce(1).write.mode("overwrite").parquet(f"{path}/marker")
    return found


def load_catalog(spark: SparkSession, path: str, source: str, schema_version: int = 1) -> DataFrame:
    """The catalog that a marker at path names; another source, version or count is an error."""
    marker = spark.read.parquet(f"{path}/marker").first()
    if (marker["source"], marker["schema_version"]) != (source, schema_version):
        raise ValueError(f"the catalog is of {marker['source']}, version {marker['schema_version']}")
    rows = spark.read.parquet(marker["data"])
    if rows.count() != marker["track_count"]:
        raise ValueError("the catalog is incomplete")
    return rows


def read_json_list(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of files that each hold one JSON list."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_predictions(ranking: DataFrame, path: str, as_json: bool = False) -> None:
    """A ranking in its array form (query_id, predicted_track_ids), one row a list."""
    rows = array_form(ranking)
    (rows.write.json if as_json else rows.write.parquet)(path)


def array_form(ranking: DataFrame) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda s: s["item_id"])
    return ranking.groupBy("query_id").agg(items.alias("predicted_track_ids"))


def long_form(predictions: DataFrame) -> DataFrame:
    return predictions.select("query_id", F.posexplode("predicted_track_ids").alias("rank", "item_id")).withColumn("rank", F.col("rank") + 1)


def pending(sessions: DataFrame, done: DataFrame, chunk: int, ord_col: str = "ord") -> DataFrame:
    """(chunk) numbers of sessions in blocks of `chunk` that `done` (chunk) lacks."""
    return sessions.select(F.floor(F.col(ord_col) / chunk).alias("chunk")).distinct().join(done, "chunk", "left_anti")


def run_chunks(sessions: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, chunk: int, rows_per_session: int | None = None, ord_col: str = "ord") -> DataFrame:
    """Processes pending chunks together and appends them by chunk; a second call goes on where the first broke off.

    Chunks are partitions of one table, replaced whole if they are written again. With rows_per_session, the count of
    the union must fit.
    """
    spark = sessions.sparkSession
    numbered = sessions.withColumn("chunk", F.floor(F.col(ord_col) / chunk).cast("long"))
    try:
        done = spark.read.parquet(path).select("chunk").distinct()
        todo = numbered.join(done, "chunk", "left_anti")
    except Exception as e:  # no chunk yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        todo = numbered
    if not todo.isEmpty():
        process(todo).write.partitionBy("chunk").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    if rows_per_session is not None and (n := out.count()) != (wanted := sessions.count() * rows_per_session):
        raise ValueError(f"{n} rows of {wanted}")
    return out


def replay_mismatches(saved: DataFrame, replayed: DataFrame) -> DataFrame:
    """(query_id) of rankings that are not the same in both, or stand in one alone."""
    a, b = array_form(saved), array_form(replayed).withColumnRenamed("predicted_track_ids", "again")
    return a.join(b, "query_id", "full_outer").where(~F.col("predicted_track_ids").eqNullSafe(F.col("again"))).select("query_id")


#: The folder of the saved rankings in an artifact.
RANKINGS = "rankings"

#: Settings that an artifact must have, with their kinds.
ARTIFACT = {"hybrid": ("candidate_k", "reservoir_k", "dense_weight", "rrf_k", "fusion_rrf_k"), "fusion_weights": ("HH", "HL", "LH", "LL"), "exact_weights": ("HH", "HL", "LH", "LL"), "diversity": ("protect", "weight"), "selective": ("protect", "weight", "bonus", "start", "end")}


def validated_artifact(artifact: dict) -> dict:
    """The artifact, if every setting is there and a finite number; else an error before anything runs."""
    if artifact.get("schema_version") != 1:
        raise ValueError("unknown schema_version")
    for part, names in ARTIFACT.items():
        for name in names:
            x = artifact.get(part, {}).get(name)
            if isinstance(x, bool) or not isinstance(x, (int, float)) or x != x or abs(x) == float("inf"):
                raise ValueError(f"{part}.{name} is {x!r}")
    for name in ("diversity_statistics", "selective_statistics"):
        if not isinstance(artifact.get(name, {}).get("total_turns"), int):
            raise ValueError(f"{name}.total_turns is missing")
    return artifact


def export_artifact(spark: SparkSession, artifact: dict, tables: dict[str, DataFrame], saved: DataFrame, replayed: DataFrame, path: str) -> None:
    """Writes settings and their frequency tables, once the replayed rankings equal the saved ones.

    A mismatch raises before anything is written, so what was at path stays. The saved rankings and the SHA-256 of all
    files go along.
    """
    artifact = validated_artifact(artifact)
    if not replay_mismatches(saved, replayed).isEmpty():
        raise ValueError("replayed rankings differ from the saved ones")
    version = uuid.uuid4().hex
    folders = {n: f"{n}-{version}" for n in tables} | {RANKINGS: f"{RANKINGS}-{version}"}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folders[name]}")
    array_form(saved).write.parquet(f"{path}/{folders[RANKINGS]}")
    digests = {name: folder_digest(spark, f"{path}/{folder}") for name, folder in folders.items()}
    whole = json.dumps(artifact | {"tables": folders, "sha256": digests}, sort_keys=True)
    spark.createDataFrame([(whole,)], "artifact string").coalesce(1).write.mode("overwrite").text(f"{path}/artifact")


def load_artifact(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """(settings, tables by name, the saved rankings among them); a missing artifact, or a file that is not the one that
    was written, is an error, there is no fallback."""
    artifact = validated_artifact(json.loads(spark.read.text(f"{path}/artifact").first()[0]))
    for name, folder in artifact["tables"].items():
        if folder_digest(spark, f"{path}/{folder}") != artifact["sha256"][name]:
            raise ValueError(f"the files of {name} are not those that were written")
    return artifact, {n: spark.read.parquet(f"{path}/{folder}") for n, folder in artifact["tables"].items()}


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, sha256) of the Parquet files under path; each file is hashed whole, up to 2 GB, where it is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def folder_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the digests of a folder's files in order of their names."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("file", "sha256"))), lambda s: F.concat_ws(" ", s["sha256"], s["file"]))
    return file_digests(spark, path).agg(F.sha2(F.array_join(lines, "\n"), 256)).first()[0]


def save_best(scores: DataFrame, path: str, by: str = "final_score") -> bool:
    """Saves the best row of scores (config_id, ...) at path if it beats the one saved there; says whether it did.

    Equal scores keep what is saved, and the smallest id wins among new ones. A null or NaN score is never saved.
    """
    spark = scores.sparkSession
    found = scores.where(F.col(by).isNotNull() & ~F.isnan(by)).orderBy(F.desc(by), "config_id").limit(1)
    new = found.first()
    saved = load_best(spark, path)
    if new is None or (saved is not None and saved[by] >= new[by]):
        return False
    folder = f"best-{uuid.uuid4().hex}"
    spark.createDataFrame([new], scores.schema).coalesce(1).write.parquet(f"{path}/{folder}")
    spark.createDataFrame([(folder, float(new[by]))], "folder string, score double").coalesce(1).write.parquet(f"{path}/saved/{folder}")
    return True


def load_best(spark: SparkSession, path: str) -> Row | None:
    """The best row saved at path; null if there is none."""
    try:
        marker = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/saved").orderBy(F.desc("score")).first()
    except AnalysisException as e:  # nothing saved yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return spark.read.parquet(f"{path}/{marker['folder']}").first()


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """(intent, pos, phrase) of files that each hold one JSON map from intents to lists of phrases; blank phrases go."""
    maps = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    each = maps.select(F.explode("m").alias("intent", "phrases"))
    return each.select("intent", F.posexplode("phrases").alias("pos", "phrase")).where(F.trim("phrase") != "")
