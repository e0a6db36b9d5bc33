"""Incremental line dedup that can be reversed: cuckoo filters by shard, backed by exact tables of reference counts.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased; 128 bits of hashes stand for it. The
state in a folder holds, for each shard of the hashes, how many documents hold each key (exact), and a cuckoo filter of
the keys that are frequent, with the infrequent keys of the shard that the filter would take for one of them (its
exceptions). So for every document that was inserted the filter's answer is exact. Inserting documents adds to the
counts, deleting them subtracts; keys that cross the threshold enter or leave the filter of their shard, and only shards
that are touched are written. What is inserted and deleted again leaves the counts, and every answer, as they were.

A document is a row: null and empty texts are one empty line, repeated rows count as often as they stand, ids are not
read. Lines whose key has fewer than `least` characters are never dropped. An empty table makes an empty state. Other
columns stay.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.llm.common import power_of_two, shared_dir, slices

THRESHOLD, LEAST = 10, 1
SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
#: Keys of a shard when a state is made, and the shards that it has at least. Twice as many keys a shard deal a state anew.
SHARD_KEYS, SHARDS = 1 << 20, 64
#: Slots of a bucket, moves before a filter grows, and the filters' bytes that are broadcast at most.
SLOTS, MOVES, BROADCAST_BYTES = 4, 500, 128 << 20
_COUNTS = "h1 long, h2 long, n long"
_FILTERS = "shard int, keys binary, exceptions binary"


class Cuckoo:
    """A cuckoo filter of 32-bit fingerprints. A key is (h1, h2): h2 has the fingerprint and the first bucket."""

    def __init__(self, buckets: int = 64, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), np.uint32) if table is None else table

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        """A filter of all keys, with as many buckets as it takes."""
        found = cls(1 << power_of_two(len(keys) / (0.85 * SLOTS) + 16, 40))
        while not all(found.insert(int(k)) for k in keys):
            found = cls(2 * len(found.table))
        return found

    def _place(self, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, bucket, other bucket) of keys as unsigned numbers."""
        prints = (h2 & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        prints[prints == 0] = 1
        first = (h2 >> np.uint64(32)) & np.uint64(len(self.table) - 1)
        return prints, first.astype(np.int64), self._other(first.astype(np.int64), prints)

    def _other(self, bucket, prints):
        return bucket ^ ((np.uint64(prints) * np.uint64(0x5BD1E995)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def insert(self, h2: int) -> bool:
        """Takes one more copy of a key; False if no slot came free, and then some fingerprint is lost."""
        prints, first, other = (x[0] for x in self._place(np.array([h2], np.int64).view(np.uint64)))
        for bucket in (first, other):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = prints
                return True
        bucket = other
        for move in range(MOVES):
            slot = (int(prints) + move) % SLOTS
            prints, self.table[bucket, slot] = self.table[bucket, slot], prints
            bucket = self._other(bucket, prints)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = prints
                return True
        return False

    def delete(self, h2: int) -> bool:
        """Takes one copy of a key out; False if it isn't there."""
        prints, first, other = (x[0] for x in self._place(np.array([h2], np.int64).view(np.uint64)))
        for bucket in (first, other):
            held = np.flatnonzero(self.table[bucket] == prints)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False

    def holds(self, h2: np.ndarray) -> np.ndarray:
        """Which keys (int64) may be among those inserted."""
        prints, first, other = self._place(h2.view(np.uint64))
        return ((self.table[first] == prints[:, None]) | (self.table[other] == prints[:, None])).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        return cls(table=np.frombuffer(data, np.uint32).reshape(-1, SLOTS).copy())


def keys_of(line: bytes, least: int) -> tuple[int, int] | None:
    """(h1, h2) of a line, signed; null for a key of fewer than `least` characters."""
    key = line.strip(SPACE)
    if len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    h1, h2 = divmod(xxhash.xxh3_128_intdigest(key.translate(_LOWER)), 1 << 64)
    return h1 - ((h1 >> 63) << 64), h2 - ((h2 >> 63) << 64)


def _distinct_keys(least: int):
    """(h1, h2) of each document's different keys."""

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=0):
            found: list[tuple[int, int]] = []
            for text in batch.column(0).cast(pa.large_binary()).to_pylist():
                found.extend({k for line in (text or b"").split(b"\n") if (k := keys_of(line, least)) is not None})
            both = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["h1", "h2"])

    return keys


def line_counts(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(h1, h2, n): in how many documents each key stands."""
    return docs.select(text_col).mapInArrow(_distinct_keys(least), "h1 long, h2 long").groupBy("h1", "h2").agg(F.count("*").alias("n"))


def _shard(shards: int):
    return F.pmod("h1", F.lit(shards)).cast("int").alias("shard")


def _filters(threshold: int):
    """The filter of one shard: from the old one if it has one, by the keys that crossed the threshold; else from its counts."""

    def build(key, counts: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        n, was, h2 = counts["n"].to_numpy(), counts["was"].to_numpy(), counts["h2"].to_numpy(np.int64)
        frequent = n >= threshold
        found = None
        if len(old):
            found = Cuckoo.from_bytes(old["keys"].iloc[0])
            left, came = h2[~frequent & (was >= threshold)], h2[frequent & (was < threshold)]
            whole = all([found.delete(int(k)) for k in left]) and all(found.insert(int(k)) for k in came)
            found = found if whole else None  # full: it is built anew, larger
        found = found if found is not None else Cuckoo.of(h2[frequent])
        taken = counts[~frequent & found.holds(h2) & (n > 0)][["h1", "h2"]].to_numpy(np.int64)
        return pd.DataFrame({"shard": [int(key[0])], "keys": [found.to_bytes()], "exceptions": [np.ascontiguousarray(taken).tobytes()]})

    return build


class LineState:
    """The state in a folder: exact counts by shard, filters by shard, and a manifest for each version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, docs: DataFrame, path: str | None = None, text_col: str = "text", threshold: int = THRESHOLD, least: int = LEAST) -> LineState:
        """A new state of the documents, at path or in the shared folder."""
        state = cls(docs.sparkSession, path or f"{shared_dir(docs.sparkSession).rstrip('/')}/rankloom-lines-{uuid.uuid4().hex}")
        folder = state._fresh("keys")
        line_counts(docs, text_col, least).write.parquet(folder)
        keys = state.spark.read.schema(_COUNTS).parquet(folder)
        state._dealt(keys, threshold, least, 0)
        return state

    def manifest(self) -> dict:
        """The newest version: its number, threshold, least, shards, and the folder of each shard's counts and filter."""
        rows = self.spark.read.option("recursiveFileLookup", "true").json(f"{self.path}/manifest", schema="version long, threshold int, least int, shards int, folders map<string,string>")
        return rows.orderBy(F.desc("version")).first().asDict()

    def counts(self) -> DataFrame:
        """(shard, h1, h2, n) of every key that a document holds."""
        return self._read("counts", f"{_COUNTS}, shard int")

    def filters(self) -> DataFrame:
        """(shard, keys, exceptions): the filter of each shard and the infrequent keys that it takes for frequent ones."""
        return self._read("filters", _FILTERS)

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineState:
        return self._changed(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineState:
        """Takes documents out that were inserted; a key that would stand in fewer than no document is an error."""
        return self._changed(docs, text_col, -1)

    def _fresh(self, kind: str) -> str:
        return f"{self.path}/{kind}-{uuid.uuid4().hex}"

    def _read(self, kind: str, schema: str) -> DataFrame:
        folders: dict[str, list[int]] = {}
        for shard, folder in self.manifest()["folders"].items():
            folders.setdefault(folder, []).append(int(shard))
        found = self.spark.createDataFrame([], schema)
        for folder, shards in sorted(folders.items()):  # one for each version that still holds shards
            found = found.unionByName(self.spark.read.schema(schema).parquet(f"{folder}/{kind}").where(F.col("shard").isin(shards)))
        return found

    def _changed(self, docs: DataFrame, text_col: str, sign: int) -> LineState:
        old = self.manifest()
        folder = self._fresh("delta")
        line_counts(docs, text_col, old["least"]).select("h1", "h2", F.col("n") * sign, _shard(old["shards"])).toDF("h1", "h2", "d", "shard").write.parquet(folder)
        delta = self.spark.read.schema("h1 long, h2 long, d long, shard int").parquet(folder)
        touched = [r["shard"] for r in delta.select("shard").distinct().collect()]  # as many as there are shards at most
        if not touched:
            return self
        before = self.counts().where(F.col("shard").isin(touched))
        both = before.join(delta, ["shard", "h1", "h2"], "full_outer")
        was, now = F.coalesce("n", F.lit(0)), F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))
        merged = both.select("shard", "h1", "h2", was.alias("was"), now.alias("n"))
        self._written(merged, self.filters().where(F.col("shard").isin(touched)), old, touched)
        new = self.manifest()
        if self.counts().count() > 2 * SHARD_KEYS * new["shards"]:
            self._dealt(self.counts().select("h1", "h2", "n"), new["threshold"], new["least"], new["version"])
        return self

    def _dealt(self, keys: DataFrame, threshold: int, least: int, version: int) -> None:
        """Deals all keys to shards whose number fits them."""
        shards = max(SHARDS, 1 << power_of_two(keys.count() / SHARD_KEYS, 30))
        merged = keys.select(_shard(shards), "h1", "h2", F.lit(0).cast("long").alias("was"), "n")
        none = self.spark.createDataFrame([], _FILTERS)
        self._written(merged, none, {"version": version, "threshold": threshold, "least": least, "shards": shards, "folders": {}}, list(range(shards)))

    def _written(self, merged: DataFrame, filters: DataFrame, old: dict, touched: list[int]) -> None:
        folder = self._fresh("version")
        merged.repartition(F.col("shard")).write.partitionBy("shard").parquet(f"{folder}/merged")
        whole = self.spark.read.schema("h1 long, h2 long, was long, n long, shard int").parquet(f"{folder}/merged")
        if not whole.where(F.col("n") < 0).isEmpty():
            raise ValueError("a deleted document was never inserted")
        whole.where(F.col("n") > 0).select("h1", "h2", "n", "shard").repartition(F.col("shard")).sortWithinPartitions("shard", "h1", "h2").write.partitionBy("shard").parquet(f"{folder}/counts")
        built = whole.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_filters(old["threshold"]), _FILTERS)
        built.write.parquet(f"{folder}/filters")
        folders = old["folders"] | {str(s): folder for s in touched}
        row = [(old["version"] + 1, old["threshold"], old["least"], old["shards"], folders)]
        made = self.spark.createDataFrame(row, "version long, threshold int, least int, shards int, folders map<string,string>")
        made.coalesce(1).write.json(f"{self.path}/manifest/{old['version'] + 1:012d}")  # a second writer of this version fails here


class _Probe:
    """The filters of all shards as one: answers for many keys at once."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], shards: int):
        self.shards, self.tables = shards, {s: Cuckoo.from_bytes(t) for s, t, _ in rows}
        self.exceptions = {s: set(map(tuple, np.frombuffer(e, np.int64).reshape(-1, 2).tolist())) for s, _, e in rows if e}

    def frequent(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        shard = keys[:, 0] % self.shards
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
        for lo, hi in zip(edges, edges[1:]):
            at, s = order[lo:hi], int(shard[order[lo]])
            if s in self.tables:
                out[at] = self.tables[s].holds(np.ascontiguousarray(keys[at, 1]))
                if s in self.exceptions:
                    out[at] &= [tuple(k) not in self.exceptions[s] for k in keys[at].tolist()]
        return out


def _marked(lines: list[list[bytes]], least: int, probe: _Probe) -> list[list[bool]]:
    """For each line of each text whether it goes."""
    keys = [keys_of(line, least) for text in lines for line in text]
    known = [i for i, k in enumerate(keys) if k is not None]
    gone = np.zeros(len(keys), bool)
    if known:
        gone[known] = probe.frequent(np.array([keys[i] for i in known], np.int64).reshape(-1, 2))
    ends = np.cumsum([0, *map(len, lines)])
    return [gone[a:b].tolist() for a, b in zip(ends, ends[1:])]


def _kept(shared, at: int, least: int, digest: bool):
    """Adds n_lines, n_dropped and the kept text, or its SHA-256, to the rows."""

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = _Probe(*shared.value)
        for batch in slices(batches, text=at):
            lines = [(t or b"").split(b"\n") for t in batch.column(at).cast(pa.large_binary()).to_pylist()]
            gone = _marked(lines, least, probe)
            kept = [b"\n".join(line for line, g in zip(text, marks) if not g) for text, marks in zip(lines, gone)]
            out = [hashlib.sha256(t).hexdigest() for t in kept] if digest else pa.array(kept, pa.binary()).cast(pa.string())
            others = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*others, pa.array(map(len, lines), pa.int64()), pa.array(map(sum, gone), pa.int64()), pa.array(out, pa.string())], [*names, "n_lines", "n_dropped", "kept"])

    return keep


def dedup(docs: DataFrame, state: LineState, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): documents of the state without their frequent lines; with `digest`, kept is the SHA-256.

    The filters go to every task if they have BROADCAST_BYTES at most; beyond that keys meet the exact counts in a join,
    which Spark splits where a line is very common, with the same answers.
    """
    found = state.manifest()
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = state.filters().agg(F.coalesce(F.sum(F.octet_length("keys") + F.octet_length("exceptions")), F.lit(0))).first()[0]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if size > BROADCAST_BYTES:
        return _joined(docs, state.counts().where(F.col("n") >= found["threshold"]), found["least"], digest)
    rows = [(r["shard"], bytes(r["keys"]), bytes(r["exceptions"])) for r in state.filters().collect()]
    shared = spark.sparkContext.broadcast((rows, found["shards"]))
    return docs.mapInArrow(_kept(shared, 1, found["least"], digest), f"doc_id {id_type}, n_lines long, n_dropped long, kept string")


def _keyed(at: int, least: int):
    """Adds the row's own key and the keys of its lines, in place of the text."""

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=at):
            texts = batch.column(at).cast(pa.large_binary()).to_pylist()
            row = [xxhash.xxh3_128_digest(repr(i).encode() + b"\0" + (b"" if t is None else t)) for i, t in zip(batch.column(0).to_pylist(), texts)]
            each = [sorted({k for line in (t or b"").split(b"\n") if (k := keys_of(line, least)) is not None}) for t in texts]
            kind = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64())]))
            held = pa.array([[{"h1": a, "h2": b} for a, b in e] for e in each], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row, pa.binary()), held], [*batch.schema.names, "row", "lines"])

    return keys


def _joined(docs: DataFrame, frequent: DataFrame, least: int, digest: bool) -> DataFrame:
    """dedup() by a join on the exact counts. Rows of one id and one text have one answer, which all of them get."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.mapInArrow(_keyed(1, least), f"doc_id {id_type}, text string, row binary, lines array<struct<h1:long,h2:long>>")
    each = keyed.select("row", F.explode("lines").alias("k")).select("row", "k.h1", "k.h2").distinct()
    gone = each.join(frequent.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))
    both = keyed.drop("lines").join(gone, "row", "left").select("doc_id", "text", "gone")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts, lists = batch.column(0), batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()
            lines = [(t or b"").split(b"\n") for t in texts]
            sets = [{(g["h1"], g["h2"]) for g in held or []} for held in lists]
            gone = [[keys_of(x, least) in held for x in text] for text, held in zip(lines, sets)]
            kept = [b"\n".join(x for x, g in zip(text, marks) if not g) for text, marks in zip(lines, gone)]
            out = pa.array([hashlib.sha256(t).hexdigest() for t in kept]) if digest else pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(map(len, lines), pa.int64()), pa.array(map(sum, gone), pa.int64()), out], ["doc_id", "n_lines", "n_dropped", "kept"])

    return both.mapInArrow(keep, f"doc_id {id_type}, n_lines long, n_dropped long, kept string")


#: DuckDB SQL of the query.
SQL = r"""
with l as (
  select doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'i': i, 'line': x, 'key': translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')})) as u from documents
), f as (
  select u.key as key from l where length(u.key) >= 1 group by 1 having count(distinct doc_id) >= 10
)
select doc_id, count(*) as n_lines, count(f.key) as n_dropped, sha256(coalesce(string_agg(u.line, chr(10) order by u.i) filter (f.key is null), '')) as kept_sha256
from l left join f on l.u.key = f.key group by doc_id
"""
