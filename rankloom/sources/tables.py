"""A saved table that imports are merged into: files by bucket of the key, versions as manifests.

    path/data/<id>/bucket=<n>/   files of one merge, never changed once written
    path/versions/<number>/      one row for each bucket that holds rows, with the folder that holds them now
    path/incoming, path/claims   what merges that have not ended work on

A merge reads and rewrites the buckets that its keys fall into, and no others; the next manifest names the new folders
for these and the old ones for the rest. It becomes a version by a rename that fails where that number exists, so of
two writers one wins and the other learns of it. Readers of a version see its files until `vacuum` drops them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Buckets of a new table; a bucket is written by one task, so a table of n GB wants some 4 n of them.
BUCKETS = 64
#: Columns that tables add: the place where a key was first seen, and, while a merge runs, its bucket.
PLACE, BUCKET = "ord", "bucket"
_MANIFEST = "version long, buckets int, batch long, bucket int, folder string, rows long, last long, schema string"


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


def _files(spark: SparkSession, path: str):
    """The file system of path and path as its name there."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def folders(spark: SparkSession, path: str) -> dict[str, int]:
    """Names of what lies in path, with the time of its last change in milliseconds; nothing if there is no such path."""
    files, name = _files(spark, path)
    return {s.getPath().getName(): s.getModificationTime() for s in files.listStatus(name)} if files.exists(name) else {}


def removed(spark: SparkSession, path: str) -> bool:
    """Deletes path and what is in it; says whether it was there."""
    files, name = _files(spark, path)
    return files.delete(name, True)


def _claimed(spark: SparkSession, source: str, target: str) -> None:
    """Renames source to target; a Conflict if target exists."""
    fs = spark._jvm.org.apache.hadoop.fs
    where = fs.FileContext.getFileContext(fs.Path(source).toUri(), spark._jsc.hadoopConfiguration())
    files, name = _files(spark, target)
    files.mkdirs(name.getParent())
    keep = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        where.rename(fs.Path(source), fs.Path(target), keep)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        raise Conflict(f"{target} exists") from e


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(v) for v in folders(spark, f"{path}/versions"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> list[Row]:
    """The rows of a version, the latest if none is named: one a bucket, so no more than the table has buckets.

    Without any version there are none; a version that was never made or is gone is an error.
    """
    known = versions(spark, path)
    if version is None and not known:
        return []
    if version is not None and version not in known:
        raise ValueError(f"there is no version {version} of {path}")
    return spark.read.schema(_MANIFEST).parquet(f"{path}/versions/{known[-1] if version is None else version:012d}").collect()


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, path: str, found: Sequence[Row]) -> DataFrame:
    schema = StructType.fromJson(json.loads(found[0]["schema"]))
    return spark.read.schema(schema).parquet(*(f"{path}/data/{r['folder']}/{BUCKET}={r['bucket']}" for r in found))


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the latest if none is named. A table without versions is an error."""
    found = manifest(spark, path, version)
    if not found:
        raise ValueError(f"there is no table at {path}")
    return _rows(spark, path, found)


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The rows of the keys in `keys`, whose columns are the table's key, from the buckets that these fall into alone."""
    found = manifest(spark, path)
    if not found:
        raise ValueError(f"there is no table at {path}")
    wanted = {r[0] for r in keys.select(_bucket(keys.columns, found[0]["buckets"])).distinct().collect()}
    held = [r for r in found if r["bucket"] in wanted]
    rows = _rows(spark, path, held) if held else _rows(spark, path, found[:1]).limit(0)
    return rows.join(keys.distinct(), keys.columns, "left_semi")


def merge(changes: DataFrame, path: str, key: str | Sequence[str] = "track_id", order: str = "seq", buckets: int = BUCKETS, batch: int | None = None, attempts: int = 1) -> int:
    """Merges changes (key, order, values) into the table at path, which it makes if there is none; returns its version.

    As if they were appended to all that was merged before: a key has the values of its last row, null ones too, and
    keeps the place (`ord`) where it was first seen. Places of new keys go on after the largest one there, in order of
    `order`, whose values are taken as distinct. Rows with a null in the key go. Columns that the table lacks are added,
    null in former rows; columns that the changes lack become null in the rows that change. No changes make no version;
    if there is no table either, that is an error.

    A batch number, if given, must grow: one that is not above the last merged is skipped, so that a batch that is sent
    again counts once. A Conflict is tried again from the new version, `attempts` times in all.
    """
    for left in reversed(range(attempts)):
        try:
            return _merge(changes, path, [key] if isinstance(key, str) else list(key), order, buckets, batch)
        except Conflict:
            if not left:
                raise
    raise ValueError("attempts must be 1 or more")


def _merge(changes: DataFrame, path: str, key: list[str], order: str, buckets: int, batch: int | None) -> int:
    spark, name = changes.sparkSession, uuid.uuid4().hex
    if taken := {PLACE, BUCKET} & set(changes.columns) - {order}:
        raise ValueError(f"columns that the table adds itself: {sorted(taken)}")
    saved = manifest(spark, path)
    version, done = (saved[0]["version"], saved[0]["batch"]) if saved else (0, None)
    buckets = saved[0]["buckets"] if saved else buckets
    if batch is not None and done is not None and batch <= done:
        return version
    incoming, data, claim = (f"{path}/{part}/{name}" for part in ("incoming", "data", "claims"))
    try:
        # one row a key before anything meets the table; a key with very many changes is reduced where it is read
        _last(changes.dropna(subset=key), key, order).withColumn(BUCKET, _bucket(key, buckets)).write.parquet(incoming)
        new = spark.read.parquet(incoming)
        touched = {r[BUCKET]: r for r in new.groupBy(BUCKET).agg(F.min(PLACE).alias("first"), F.count("*").alias("n")).collect()}
        if not touched:
            if not saved:
                raise ValueError("nothing to import")
            return version
        former = [r for r in saved if r["bucket"] in touched]
        if saved:
            shift = max(r["last"] for r in saved) + 1 - min(r["first"] for r in touched.values())
            there = _rows(spark, path, former or saved[:1]).withColumn(BUCKET, _bucket(key, buckets))
            # places of changes lie above all former ones, so the larger place has the later values
            new = new.withColumn(PLACE, F.col(PLACE) + F.lit(shift)).unionByName(there if former else there.limit(0), allowMissingColumns=True)
        merged = _last(new.repartition(len(touched), BUCKET), [BUCKET, *key], PLACE)
        merged.write.partitionBy(BUCKET).parquet(data)
        counts = spark.read.parquet(data).groupBy(BUCKET).agg(F.count("*").alias("n"), F.max(PLACE).alias("last")).collect()
        before = {r["bucket"]: r["rows"] for r in former}
        whole = {r[BUCKET] for r in counts if max(touched[r[BUCKET]]["n"], before.get(r[BUCKET], 0)) <= r["n"] <= touched[r[BUCKET]]["n"] + before.get(r[BUCKET], 0)}
        if whole != set(touched):
            raise ValueError(f"buckets {sorted(set(touched) - whole)} came out incomplete")
        rows = [(r["bucket"], r["folder"], r["rows"], r["last"]) for r in saved if r["bucket"] not in touched] + [(r[BUCKET], name, r["n"], r["last"]) for r in counts]
        kind, batch = json.dumps(json.loads(merged.drop(BUCKET).schema.json())), done if batch is None else batch
        spark.createDataFrame([(version + 1, buckets, batch, *r, kind) for r in rows], _MANIFEST).coalesce(1).write.parquet(claim)
        _claimed(spark, claim, f"{path}/versions/{version + 1:012d}")
    except Conflict:  # after any other error it is open whether the version was made, so `vacuum` has to decide
        removed(spark, data)
        removed(spark, claim)
        raise
    finally:
        removed(spark, incoming)
    return version + 1


def _last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key: the values of its row with the largest order, and the smallest order as its place."""
    values = [c for c in rows.columns if c not in (*key, order)]
    # the struct is never without a field
    last = rows.groupBy(*key).agg(F.max_by(F.struct(F.lit(True), *values), order).alias("v"), F.min(order).cast("long").alias(PLACE))
    return last.select(*key, *(F.col("v")[c].alias(c) for c in values), PLACE)


def vacuum(spark: SparkSession, path: str, keep: int = 1, idle_hours: float = 24) -> int:
    """Drops all versions but the last `keep`, and the files that no kept one names; returns how many folders of files.

    Files, claims and changes of the last idle_hours stay, since a merge may be about to make a version of them; so no
    merge may run for longer.
    """
    if keep < 1:
        raise ValueError("keep must be 1 or more")
    known = versions(spark, path)
    held = {r["folder"] for v in known[-keep:] for r in manifest(spark, path, v)}
    for v in known[:-keep]:
        removed(spark, f"{path}/versions/{v:012d}")
    before, gone = (time.time() - idle_hours * 3600) * 1000, 0
    for part in ("data", "claims", "incoming"):
        for name, changed in folders(spark, f"{path}/{part}").items():
            if name not in held and changed <= before:
                gone += removed(spark, f"{path}/{part}/{name}") and part == "data"
    return gone
