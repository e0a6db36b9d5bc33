"""The trie of conversations that begin with the same turns, its subtree totals found by peeling leaves.

Every conversation is first rebuilt: it opens with the first turns of the conversation that begins its block of ids, then
goes on with its own. A node is a sequence of first turns; the xor of 128-bit hashes of (place, role, text) names it, so a
prefix's name is a running xor, and a conversation of any length is cut into ranges and put together again by one offset
a range (`running`).

Leaves are peeled by messages. Nodes hold how many children have not reported yet; a node that waits for none adds its
own share to what it was sent and sends the totals to its parent, until the root alone is left. Nodes that stand in line
on the way of one conversation finish in one round: each node goes to the member with the smallest hashed id, the nodes of
one such member are a path down the trie, and a path waits for the paths that hang on it. As the ids are hashed, a way
from root to leaf meets some ln(n) paths at most on average, whatever the trie looks like, so rounds stay few where the
trie is thousands of turns deep. Each round's messages are written to the shared folder before the next begins.

Turns stand by turn, null first, equal turns by the hash of role and text; null role or text is empty; rows that repeat
are turns that repeat. Rows without conv_id belong to no conversation. An empty table has no nodes. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.llm.common import WHITE, shared_dir, staged

#: Ids that are joined to one piece before the pieces of a node are hashed in order.
PIECE = 4096
_ROWS = "conv_id long, depth long, x1 long, x2 long, words long"


def _runs(names: list[str], keys: int, xors: set[str], sums: list[str]):
    """Running sums and xors within equal keys of one sorted partition, and a last row with those of its last key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, carry, last = None, {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
            new = np.ones(batch.num_rows, bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            new[0] = held is None or bool((key[:, 0] != held).any())
            start = np.maximum.accumulate(np.where(new, np.arange(batch.num_rows), 0))
            first = np.cumsum(new) == 0  # rows that go on with the key of the batch before
            columns = dict(zip(batch.schema.names, batch.columns))
            for name in sums:
                each = columns[name].to_numpy(zero_copy_only=False).astype(np.int64)
                add = np.bitwise_xor if name in xors else np.add
                total = add.accumulate(each)
                before = np.concatenate([[0], total[:-1]])[start]
                total = total ^ before if name in xors else total - before
                total[first] = add(total[first], carry.get(name, 0))
                carry[name] = total[-1]
                columns[name] = pa.array(total)
            held, last = key[:, -1], batch.slice(batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(np.zeros(batch.num_rows, bool))], [*names, "tail"])
        if last is not None:
            columns = dict(zip(last.schema.names, last.columns)) | {n: pa.array([carry[n]], pa.int64()) for n in sums}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array([True])], [*names, "tail"])

    return run


def running(df: DataFrame, keys: list[str], order: list, sums: list[str], xors: tuple[str, ...] = ()) -> DataFrame:
    """df with each of `sums` running over the rows of equal keys (whole numbers) in an order; those in xors run by xor.

    Rows are dealt to sorted ranges, so one key may fill many of them: what a range begins in the middle of is set right
    by the totals of the ranges before, one row a range.
    """
    names = [*keys, *(c for c in df.columns if c not in keys)]
    ranged = df.select(*names).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{n} {'long' if n in sums else kinds[n]}" for n in names) + ", tail boolean"
    done = staged(ranged.mapInArrow(_runs(names, len(keys), set(xors), sums), schema).withColumn("range", F.spark_partition_id()), "running")
    tails: dict[int, tuple] = {r["range"]: (tuple(r[k] for k in keys), {n: r[n] for n in sums}) for r in done.where("tail").collect()}  # one a range
    firsts = {r["range"]: tuple(r["first"]) for r in done.where("not tail").groupBy("range").agg(F.min(F.struct(*keys)).alias("first")).collect()}
    offsets, so_far = [], None
    for i in sorted(tails):
        if so_far is not None and so_far[0] == firsts[i]:
            offsets.append((i, *firsts[i], *(so_far[1][n] for n in sums)))
        key, total = tails[i]
        if so_far is not None and so_far[0] == key and firsts[i] == key:
            total = {n: so_far[1][n] ^ total[n] if n in xors else so_far[1][n] + total[n] for n in sums}
        so_far = (key, total)
    done = done.where("not tail").drop("tail")
    if not offsets:
        return done.select(*df.columns)
    schema = f"range int, {', '.join(f'{k} {kinds[k]}' for k in keys)}, {', '.join(f'off_{n} long' for n in sums)}"
    late = F.broadcast(df.sparkSession.createDataFrame(offsets, schema))  # one row a range at most
    joined = done.join(late, ["range", *keys], "left")
    off = {n: F.coalesce(f"off_{n}", F.lit(0)) for n in sums}
    return joined.select(*((F.col(n).bitwiseXOR(off[n]) if n in xors else F.col(n) + off[n]).alias(n) if n in sums else n for n in df.columns))


def rebuilt(conversations: DataFrame, block: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows, ids): the turns of all rebuilt conversations, without their texts, and the ids of all conversations.

    Conversation c opens with the first h turns of c - c % block, h = crc32 of its decimal id modulo `shared`; its own
    turns follow from the one after h. A row has conv_id, depth (from 1), g1 and g2 (128 bits of the turn at its depth) and
    words (those of its text).
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.length(F.regexp_replace(F.regexp_replace(text, "[^\\x20\\x09-\\x0D]+", "w"), WHITE, ""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"), words.cast("long").alias("words"), F.lit(1).cast("long").alias("pos"))
    turns = running(staged(turns, "turns"), ["conv_id"], [F.asc_nulls_first("turn"), "t1", "t2"], ["pos"]).drop("turn")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    ids = turns.where("pos = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    ids = staged(ids, "conversations")
    opening = turns.where((F.col("pos") < shared) & (F.col("conv_id") % block == 0)).select(F.col("conv_id").alias("base"), "pos", "t1", "t2", "words")
    opened = staged(ids.join(opening, "base").where("pos <= h").select("conv_id", "pos", "t1", "t2", "words"), "opened")
    sizes = opened.groupBy("conv_id").agg(F.count("*").alias("n"))
    # h, and how many turns come before, go along with a conversation's few rows of ids; its turns meet them once
    known = ids.join(sizes, "conv_id", "left").select("conv_id", (F.coalesce("n", F.lit(0)) - F.col("h")).alias("shift"), "h")
    own = turns.join(known, "conv_id").where("pos > h").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "t1", "t2", "words")
    both = own.unionByName(opened).withColumnRenamed("pos", "depth")
    rows = both.select("conv_id", "depth", F.xxhash64("depth", "t1", "t2").alias("g1"), F.xxhash64("t2", "depth", "t1").alias("g2"), "words")
    return rows, ids.select("conv_id")


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by node, joined to pieces of PIECE at most: (x1, x2, first id, piece)."""
    held, ids = None, []

    def piece() -> tuple:
        return (*held, ids[0], ",".join(map(str, ids)))

    for batch in batches:
        out = []
        for x1, x2, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (x1, x2) != held or len(ids) == PIECE:
                if ids:
                    out.append(piece())
                held, ids = (x1, x2), []
            ids.append(c)
        yield _table(out, ("x1", "x2", "conv_id", "piece"))
    if ids:
        yield _table([piece()], ("x1", "x2", "conv_id", "piece"))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id, hashed in this order: (x1, x2, ends_sha256)."""
    held, digest = None, None
    for batch in batches:
        out = []
        for x1, x2, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (x1, x2) == held:
                digest.update(b"," + piece.encode())
                continue
            if held is not None:
                out.append((*held, digest.hexdigest()))
            held, digest = (x1, x2), hashlib.sha256(piece.encode())
        yield _table(out, ("x1", "x2", "ends_sha256"))
    if held is not None:
        yield _table([(*held, digest.hexdigest())], ("x1", "x2", "ends_sha256"))


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("piece", "ends_sha256") else pa.int64()) for n, c in zip(names, columns)], list(names))


def _ends(last: DataFrame) -> DataFrame:
    """(x1, x2, ends_sha256) of the nodes at which conversations end. Sorted ranges join ids to pieces first, so that a
    node where a third of all ends is one task's work for its pieces alone, in bounded memory."""
    ranged = last.select("x1", "x2", "conv_id").repartitionByRange("x1", "x2", "conv_id").sortWithinPartitions("x1", "x2", "conv_id")
    pieces = staged(ranged.mapInArrow(_pieces, "x1 long, x2 long, conv_id long, piece string"), "ends")
    return pieces.repartition(F.col("x1"), F.col("x2")).sortWithinPartitions("x1", "x2", "conv_id").mapInArrow(_digests, "x1 long, x2 long, ends_sha256 string")


def _nodes(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """A row a node: its name, depth, parent's name, members, smallest member, member of the smallest hash, words."""
    rank = F.struct(F.xxhash64(F.col("conv_id"), F.lit(7)).alias("h"), F.col("conv_id").alias("c"))
    counted = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(rank).alias("rep"), F.min("words").alias("words")]
    named = rows.groupBy("depth", "x1", "x2", F.col("x1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("g2")).alias("p2")).agg(*counted)
    zero = F.lit(0).cast("long")
    root = ids.withColumn("words", zero).groupBy(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2")).agg(*counted)
    both = named.unionByName(root)
    return both.select(*("depth x1 x2 p1 p2 n_convs conv_id".split()), F.col("rep.c").alias("path"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))


def _peeled(paths: DataFrame, spark: SparkSession) -> DataFrame:
    """(path, leaves, saved): the totals of all paths with what hangs on them. paths: (path, parent, waits, leaves, saved).

    In each round the paths that wait for none send their totals to the parent's path.
    """
    finished, waiting = [], paths
    while not waiting.isEmpty():
        done = waiting.where("waits = 0").select("path", "parent", "leaves", "saved")
        finished.append(staged(done, "finished"))
        sent = finished[-1].where("parent is not null").groupBy("parent").agg(F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        left = waiting.where("waits > 0").join(sent.withColumnRenamed("parent", "path"), "path", "left")
        add = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
        waiting = staged(left.select("path", "parent", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"), add("leaves", "more_leaves"), add("saved", "more_saved")), "waiting")
    whole = finished[0]
    for more in finished[1:]:
        whole = whole.unionByName(more)
    return whole.select("path", "leaves", "saved")


def trie(conversations: DataFrame, block: int = 20, shared: int = 4) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row a node."""
    spark = conversations.sparkSession
    rows, ids = rebuilt(conversations, block, shared)
    rows = staged(rows.withColumns({"x1": F.col("g1"), "x2": F.col("g2")}), "rebuilt")
    rows = staged(running(rows, ["conv_id"], ["depth"], ["x1", "x2"], ("x1", "x2")), "prefixes")
    nodes = staged(_nodes(rows, ids), "nodes")
    if nodes.isEmpty() or ids.isEmpty():
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("x1", "x2"), "depth").alias("x"))
    last = ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("x.x1", F.lit(0)).alias("x1"), F.coalesce("x.x2", F.lit(0)).alias("x2"))
    above = nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent"))
    children = nodes.where("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children")).toDF("x1", "x2", "n_children")
    whole = nodes.join(above, ["depth", "p1", "p2"], "left").join(children, ["x1", "x2"], "left").fillna({"n_children": 0})
    whole = staged(whole.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")), "linked")
    hangs = F.col("parent").isNotNull() & (F.col("parent") != F.col("path"))
    tops = whole.where(hangs | (F.col("depth") == 0)).select("path", F.when(hangs, F.col("parent")).alias("parent"), F.when(hangs, F.col("p1")).alias("p1"), F.when(hangs, F.col("p2")).alias("p2"))
    tops = staged(tops, "tops")
    own = whole.groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    waits = tops.where("parent is not null").groupBy("parent").agg(F.count("*").alias("waits")).withColumnRenamed("parent", "path")
    paths = staged(tops.join(own, "path").join(waits, "path", "left").select("path", "parent", F.coalesce("waits", F.lit(0)).cast("long").alias("waits"), "leaves", "saved"), "paths")
    totals = staged(_peeled(paths, spark), "totals")
    hung = tops.where("parent is not null").join(totals, "path").groupBy("p1", "p2").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")).withColumnsRenamed({"p1": "x1", "p2": "x2"})
    full = whole.join(hung, ["x1", "x2"], "left")
    full = full.select("path", "x1", "x2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"))
    full = running(staged(full, "full"), ["path"], [F.desc("depth")], ["n_leaves", "saved_tokens"])
    out = full.join(_ends(last), ["x1", "x2"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


#: DuckDB SQL of trie() over conversations. CRC32 runs bit by bit over the digits; -1 stands for a shift.
SQL = r"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) as pos, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), c as (
  select conv_id, conv_id - conv_id % 20 as base,
    xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, s: case when s >= 0 then xor(c, s) else xor(c >> 1, (c & 1) * 3988292384) end), 4294967295) % 4 as h
  from (select distinct conv_id from t)
), o as (
  select c.conv_id, t.pos, t.role, t.text from c join t on t.conv_id = c.base and t.pos <= c.h
), n as (
  select conv_id, count(*) as n from o group by 1
), r as (
  select * from o union all
  select t.conv_id, t.pos - c.h + coalesce(n.n, 0), t.role, t.text from t join c using (conv_id) left join n using (conv_id) where t.pos > c.h
), p as (
  select conv_id, pos as depth, len(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+')) * (trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')::int as words,
    string_agg(md5(role || chr(31) || text), ',') over (partition by conv_id order by pos) as x, coalesce(string_agg(md5(role || chr(31) || text), ',') over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), '') as px
  from r union all select conv_id, 0, 0, '', null from c
), node as (
  select depth, x, min(px) as px, min(conv_id) as conv_id, count(*) as n_convs, min(words) as words from p group by depth, x
), kids as (
  select px as x, count(*) as n_children from node where depth > 0 group by 1
), l as (
  select node.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * words as own from node left join kids using (x)
), below as (
  select p.x, sum((l.n_children = 0)::int) as n_leaves, sum(l.own) as saved_tokens from l join p on p.conv_id = l.conv_id and p.depth <= l.depth group by p.x
), last as (
  select arg_max(x, depth) as x, conv_id from p group by conv_id
), ends as (
  select x, string_agg(conv_id::varchar, ',' order by conv_id) as ids from last group by x
)
select l.conv_id, l.depth::bigint as depth, up.conv_id as parent_conv_id, l.n_convs, l.n_children, b.n_leaves::bigint as n_leaves, b.saved_tokens::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from l join below b using (x) left join node up on up.x = l.px left join ends e on e.x = l.x
"""
