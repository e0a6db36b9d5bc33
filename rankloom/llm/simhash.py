"""SimHash near-duplicates by a binary trie self-join.

A fingerprint has 64 bits. The distinct fingerprints form a binary trie; pairs of its nodes are walked together, the
bits in which they differ add up, and a pair is pruned once that number passes the error budget.

To spread the walk, the trie is built four times, each time with another block of 16 bits on top, and only node pairs
that agree on the whole top block are walked: of 4 blocks, 3 errors leave one untouched, so no pair is lost. A subtree
under one top block is a tile. A tile with more than HOT_TILE fingerprints is dealt out again as pairs of its child
nodes eight bits further down, so that no tile is walked by one task however many fingerprints share a block.

A tile's links are reduced to a spanning forest before they leave the task: a group of n fingerprints yields n - 1
links from a tile, not n * n. Links then become components by contracting every node to its smallest neighbour.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from rankloom.llm import shingles
from rankloom.llm.common import broadcast_if_few, slices, staged

BITS, BLOCKS = 64, 4
BLOCK = BITS // BLOCKS
#: Tiles of more fingerprints than this are dealt out again; bits by which they go down.
HOT_TILE, DOWN = 4096, 8
#: Pairs of nodes under which so many fingerprint pairs lie at most are compared outright; size of a step of the walk.
SMALL_PAIR, FRONTIER = 64, 1 << 18

_MASKS = {n: [m for m in range(1 << DOWN) if m.bit_count() <= n] for n in range(BLOCKS)}


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the XXH64 hashes of the text's word shingles, repeats counted; 0 without words.

    A-Z is lowered, words are cut at ASCII white space; fewer words than a shingle make one of the whole sequence.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(length) - 1
    start = (ends - length + 1)[:n].tolist()
    stop = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start, stop)), "<u8", n)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long. A null text has fingerprint zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


# --- the walk within tiles ---------------------------------------------------------------------------------------


class _Forest:
    """Components of rows by hooking the larger root under the smaller, on whole arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while len(a):
            ra, rb = self._roots(a), self._roots(b)
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))

    def _roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        while True:
            up = p[x]
            if (up == x).all():
                return x
            p[x] = p[up]
            x = p[up]


def walk(tile: np.ndarray, key: np.ndarray, budget: np.ndarray, side: np.ndarray, depth: int) -> _Forest:
    """Links rows of the same tile whose keys differ in at most the tile's budget of bits.

    Rows are sorted by (tile, side, key). All keys of one side of a tile agree on their first `depth` bits. A tile
    with one side is joined with itself, one with two sides joins the one with the other.
    """
    n, forest = len(key), _Forest(len(key))
    if n < 2:
        return forest
    edge = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]) | (side[1:] != side[:-1]), [True]]))
    lo, hi = edge[:-1], edge[1:]
    paired = np.flatnonzero(tile[lo[:-1]] == tile[lo[1:]])
    two = np.zeros(len(lo), bool)
    two[paired] = two[paired + 1] = True
    # the sides of a tile with two are alone in it if the other has no rows: then there is nothing to join
    lone = np.flatnonzero(~two & (side[lo] == 2))
    stack = [
        (depth, lo[lone], hi[lone], lo[lone], hi[lone], budget[lo[lone]]),
        (depth, lo[paired], hi[paired], lo[paired + 1], hi[paired + 1], budget[lo[paired]]),
    ]
    ones: dict[int, np.ndarray] = {}
    while stack:
        d, alo, ahi, blo, bhi, left = stack.pop()
        if len(alo) > FRONTIER:
            for at in range(0, len(alo), FRONTIER):
                stack.append((d, *(x[at : at + FRONTIER] for x in (alo, ahi, blo, bhi, left))))
            continue
        size = (ahi - alo) * (bhi - blo)
        done = (size <= SMALL_PAIR) | (d >= BITS)
        if done.any():
            _compare(forest, key, *(x[done] for x in (alo, ahi, blo, bhi, left)))
        alo, ahi, blo, bhi, left = (x[~done] for x in (alo, ahi, blo, bhi, left))
        if not len(alo):
            continue
        if d not in ones:
            bit = (key >> np.uint64(BITS - 1 - d)) & np.uint64(1)
            ones[d] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        c = ones[d]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        same = (alo == blo) & (ahi == bhi)
        parts = [(alo, amid, blo, bmid, left), (amid, ahi, bmid, bhi, left), (alo, amid, bmid, bhi, left - 1)]
        parts.append(tuple(x[~same] for x in (amid, ahi, blo, bmid, left - 1)))
        a0, a1, b0, b1, e = (np.concatenate(x) for x in zip(*parts))
        keep = (e >= 0) & (a1 > a0) & (b1 > b0)
        if keep.any():
            stack.append((d + 1, a0[keep], a1[keep], b0[keep], b1[keep], e[keep]))
    return forest


def _compare(forest: _Forest, key: np.ndarray, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray, left: np.ndarray) -> None:
    """Compares all rows under pairs of small nodes. The remaining budget is checked on the remaining bits alone:
    the first bits of a node pair differ in what is already spent, so the whole keys differ in spent plus rest."""
    size = (ahi - alo) * (bhi - blo)
    for at in _even_cuts(size):
        a, b, n, wide = alo[at], blo[at], size[at], (bhi - blo)[at]
        of = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = a[of] + k // wide[of], b[of] + k % wide[of]
        near = (np.bitwise_count(key[i] ^ key[j]) <= 3) & (i != j)
        forest.link(i[near], j[near])


def _even_cuts(size: np.ndarray, limit: int = 1 << 21) -> Iterator[slice]:
    part = np.cumsum(size) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    return (slice(lo, hi) for lo, hi in zip(edges, edges[1:]) if hi > lo)


def _links_of(batches: Iterable[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Walks sorted rows (tile, side, key, fp) some tiles at a time and yields (fp, root) of each linked row."""
    held: list[pa.RecordBatch] = []

    def flush(rows: pa.Table) -> pa.RecordBatch:
        tile, side, key, budget, fp = (rows.column(c).to_numpy() for c in ("tile", "side", "key", "budget", "fp"))
        forest = walk(tile, key.view(np.uint64), budget.astype(np.int64), side, depth)
        root = forest._roots(np.arange(len(fp)))
        linked = root != np.arange(len(fp))
        a, b = fp[linked], fp[root[linked]]
        a, b = np.maximum(a, b), np.minimum(a, b)
        plane = rows.column("plane").to_numpy()[linked]
        return pa.RecordBatch.from_arrays([pa.array(plane, pa.int32()), pa.array(a), pa.array(b)], ["plane", "a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column("tile").to_numpy()
        cut = int(np.searchsorted(tile, tile[-1]))  # the last tile may go on in the next batch
        if cut:
            rows = pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
            yield flush(rows)
        elif held and held[-1].column("tile")[-1].as_py() != tile[0]:
            yield flush(pa.Table.from_batches(held))
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield flush(pa.Table.from_batches(held))


def links(fps: DataFrame, hot_tile: int = HOT_TILE) -> DataFrame:
    """(plane, a, b) with a > b: links between distinct fingerprints (columns fp, plane) of the same plane of 3 differing
    bits at most, as a spanning forest of each tile. Every pair of linked fingerprints is connected by the links of at
    least one tile."""
    turned = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), (F.shiftleft("fp", BLOCK * r).bitwiseOR(F.shiftrightunsigned("fp", BITS - BLOCK * r)) if r else F.col("fp")).alias("key")) for r in range(BLOCKS))))
    rows = fps.select("fp", "plane", turned.alias("x")).select("fp", "plane", "x.r", "x.key")
    # a tile is the rotation and the top block; its rows share both, and have the whole budget left for the rest
    tile = (F.col("plane").cast("long") * BLOCKS + F.col("r")) * (1 << BLOCK) + F.shiftrightunsigned("key", BITS - BLOCK)
    rows = rows.select("fp", "plane", "key", tile.alias("tile"), F.lit(2).alias("side"), F.lit(3).alias("budget"))
    depth, found = BLOCK, []
    while True:
        counts = rows.groupBy("tile", "side").agg(F.count("*").alias("n")).groupBy("tile").agg(F.sum("n").alias("n"))
        hot = staged(counts.where(F.col("n") > hot_tile).select("tile"), "hot-tiles") if depth < BITS else None
        more = hot is not None and not hot.isEmpty()
        cool = rows.join(hot, "tile", "left_anti") if more else rows
        found.append(_walked(cool, depth))
        if not more:
            break
        rows, depth = staged(_children(rows.join(hot, "tile", "left_semi"), depth), "child-tiles"), depth + DOWN
    return reduce(DataFrame.union, found).distinct()


def _walked(rows: DataFrame, depth: int) -> DataFrame:
    dealt = rows.repartition("tile").sortWithinPartitions("tile", "side", F.col("key").bitwiseXOR(F.lit(-(1 << 63))))
    return dealt.select("tile", "side", "key", "budget", "fp", "plane").mapInArrow(lambda it: _links_of(it, depth), "plane int, a long, b long")


def _children(rows: DataFrame, depth: int) -> DataFrame:
    """Deals the rows of hot tiles to pairs of child nodes that differ in as many bits as their budget allows."""
    child = F.shiftrightunsigned("key", BITS - depth - DOWN).bitwiseAND(F.lit((1 << DOWN) - 1)).cast("int")
    masks = F.when(F.col("budget") == 0, F.array(F.lit(0)))
    for left in (1, 2, 3):
        masks = masks.when(F.col("budget") == left, F.array(*map(F.lit, _MASKS[left])))
    out = rows.withColumn("c", child).withColumn("m", F.explode(masks)).withColumn("o", F.col("c").bitwiseXOR(F.col("m")))
    one_sided = F.col("side") == 2
    # in a two-sided tile the pair is (child of side 0, child of side 1); in a one-sided one it has no order
    low = F.when(one_sided, F.least("c", "o")).otherwise(F.when(F.col("side") == 0, F.col("c")).otherwise(F.col("o")))
    high = F.when(one_sided, F.greatest("c", "o")).otherwise(F.when(F.col("side") == 0, F.col("o")).otherwise(F.col("c")))
    side = F.when(one_sided & (F.col("m") == 0), F.lit(2)).when(one_sided, (F.col("c") > F.col("o")).cast("int")).otherwise(F.col("side"))
    out = out.select("fp", "plane", "key", F.xxhash64("tile", low, high, one_sided).alias("t"), side.alias("s"), (F.col("budget") - F.bit_count("m")).alias("b"))
    return out.toDF("fp", "plane", "key", "tile", "side", "budget")


# --- components --------------------------------------------------------------------------------------------------


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of all nodes of the links, where component is one node of each connected class.

    In each round every node points at its smallest neighbour, pointers are followed twice, and links are rewritten to
    what their ends point at; the number of nodes at least halves. Each round's tables are written to the shared
    folder. Minima are taken before the shuffle, and joins leave a hot node's rows to Spark's skew handling.
    """
    links_ = staged(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where(F.col("u") != F.col("v")), "links")
    labels = None
    while not links_.isEmpty():
        both = links_.union(links_.select("v", "u"))
        parent = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        parent = staged(parent, "parents")
        for _ in range(2):
            step = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            parent = parent.join(step, "p").select("u", F.col("q").alias("p"))
        parent = staged(parent, "parents")
        labels = parent.select(F.col("u").alias("node"), F.col("p").alias("component")) if labels is None else staged(
            labels.join(parent.select(F.col("u").alias("component"), "p"), "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels"
        )
        left_end, right_end = parent.select("u", F.col("p").alias("pu")), parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = links_.join(left_end, "u").join(right_end, "v").where("pu <> pv").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v"))
        links_ = staged(moved.distinct(), "links")
    if labels is None:
        return links_.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels


def near_duplicates(docs: DataFrame, shingle: int = 3, hot_tile: int = HOT_TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest id reachable. Texts without words
    share fingerprint zero, which links like any other. Exact copies meet as one fingerprint before any join, and
    rows that repeat an id stay. A row with a null id has no id to give: its component_id is the smallest of the rest.
    """
    fps = staged(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    first = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    groups = components(links(first.select("fp", F.lit(0).alias("plane")), hot_tile))
    grouped = first.join(groups, first.fp == groups.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("g"))
    grouped = staged(grouped, "groups")
    # written first, so that the join deals both sides anew and Spark can split the rows of a large group
    smallest = staged(grouped.groupBy("g").agg(F.min("first").alias("component_id")), "smallest")
    by_fp = grouped.join(smallest, "g").select("fp", "component_id")
    named = fps.join(by_fp, "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- several fingerprints of words, for a similarity rather than a distance ---------------------------------------

#: Independent fingerprints of a text's words, and what is cut off a word's ends.
PLANES, EDGES = 2, b".,;:"


def _words(text: str | None) -> list[bytes]:
    return [w for w in (w.strip(EDGES) for w in (text or "").encode("utf-8", "replace").lower().split()) if w]


def _of_words(words: set[bytes], planes: int) -> np.ndarray:
    if not words:
        return np.zeros(planes, np.uint64)
    base = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    ones = np.zeros(planes * BITS, np.int64)
    salt = np.arange(1, planes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(base), 1 << 11):
        h = base[at : at + (1 << 11), None] + salt
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(base), bitorder="little").view("<u8")


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def similar_groups(docs: DataFrame, planes: int = PLANES, hot_tile: int = HOT_TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, signature, n, component_id, kept) of every distinct pair of id and text, n rows each: groups
    of texts of a similarity of 0.8 or more on 5-word shingles.

    Texts whose word fingerprints are within 3 bits, found by the trie self-join, are proposed, and so are those that
    agree in a MinHash band: an appended, cut or swapped passage changes too many words at once for the fingerprints.
    Exact shingle sets decide on what is proposed, so no link is below 0.8. Texts with the same shingle set are one node
    and have one signature; texts without a word are alike only if they are equal.
    component_id is the smallest id of the group (null ids count last), kept is true for one pair of the group.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=1 << 20):
            texts = b.column(1).to_pylist()
            words = [_words(t) for t in texts]
            found = np.array([_of_words(set(w), planes) for w in words], np.uint64).reshape(len(texts), planes)
            sets = [shingles.shingle_set(w) for w in words]
            signature = [xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "replace"), 1) for t, s in zip(texts, sets)]
            keys = [shingles.band_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), _signed(signature), _lists(found.ravel(), np.full(len(texts), planes)), _lists(np.concatenate(keys), np.array(list(map(len, keys)))), pa.array([shingles.packed(s) for s in sets], pa.binary())],
                ["doc_id", "uid", "text_key", "signature", "fps", "bands", "shingles"],
            )

    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("uid"), F.xxhash64(text).alias("text_key"))
    rows = staged(texts.mapInArrow(run, f"doc_id {kind}, uid long, text_key long, signature long, fps array<long>, bands array<long>, shingles binary"), "word-fingerprints")
    size = (F.octet_length("shingles") / 4).cast("int")
    one = rows.where(F.size("bands") > 0).groupBy("signature").agg(F.min(F.struct("uid", "fps", "bands", size.alias("size"))).alias("x")).select("x.*")
    one = staged(one, "distinct-sets")
    each = one.select("uid", "size", F.posexplode("fps").alias("plane", "fp"))
    near = staged(links(each.select("fp", "plane").distinct(), hot_tile).select("plane", F.col("a").alias("fp"), "b"), "near-fingerprints")
    in_trie = each.select("uid", "size", F.xxhash64("plane", "fp").alias("bucket")).union(each.join(near, ["plane", "fp"]).select("uid", "size", F.xxhash64("plane", "b")))
    members = one.select("uid", "size", F.explode("bands").alias("bucket")).union(in_trie)
    linked = components(shingles.links(rows, members))
    keyed = staged(rows.groupBy("doc_id", "text_key", "signature").agg(F.count("*").alias("n")), "document-keys")
    pair = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    first = keyed.groupBy("signature").agg(F.min(pair).alias("first"))
    named = staged(first.join(linked, first.signature == linked.node, "left").select("signature", "first", F.coalesce("component", "signature").alias("g")), "groups")
    smallest = staged(named.groupBy("g").agg(F.min("first").alias("kept")), "kept")
    by_signature = staged(named.join(smallest, "g").select("signature", F.col("kept").alias("k")), "kept-by-signature")
    out = keyed.join(by_signature, "signature")
    return out.select("doc_id", "text_key", "signature", "n", F.col("k.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_key") == F.col("k.text_key"))).alias("kept"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts, with its columns: that of the smallest id, and of the smaller hash of the
    text where one id has several texts. Null ids are kept only in groups without another id. Of rows that repeat id
    and text one stays."""
    found = staged(similar_groups(docs, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"), "kept", "n").where("not kept or n > 1"), "gone")
    gone = staged(found.where("not kept").select("__id", "__text"), "gone")
    rows = docs.withColumn("__key", F.xxhash64(F.col(text_col).cast("string")))
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text"))
    rows = rows.join(broadcast_if_few(gone), same, "left_anti")
    again = staged(found.where("kept").select("__id", "__text"), "repeats")
    if again.isEmpty():
        return rows.drop("__key")
    # only the rows that stand several times are dealt by their key; repeats go before the shuffle, too
    again = broadcast_if_few(again)
    once = rows.join(again, same, "left_anti").union(rows.join(again, same, "left_semi").dropDuplicates([id_col, "__key"]))
    return once.drop("__key")
