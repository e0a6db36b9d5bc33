"""Mixing overlapping sources to target weights by min-cost flow.

Documents are added up by their membership pattern, the set of sources that they belong to. A flow sends the tokens of
each pattern to the quotas of its sources: the first copy of a document is free, the second costs one, the third two,
and so on, so a pattern repeats only where no fresh tokens are left. Documents are then chosen by a seeded hash: a
pattern's whole copies go to all of its documents, the rest to those with the smallest hashes.

What goes through the driver is one sum for each pattern. A source that shares no document with another has one pattern
and needs no flow; only patterns that overlap are routed.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from rankloom.llm.common import small_table, staged

#: Weights of the sources in code point order, repeating; share of all sizes that is given out; copies at most.
WEIGHTS, SHARE, COPIES = (5.0, 2.0, 1.0), 1.5, 2
#: Rows of a hash cell that are ordered by one task; bits by which cells are divided while they hold more.
CELL_ROWS, LEVEL_BITS = 2_000, 8

WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Plan:
    """sizes and targets by source; flow[pattern][source] in tokens."""

    sizes: dict
    targets: dict
    flow: dict


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets_of(sizes: dict, weights: tuple[float, ...] = WEIGHTS, budget: float = 0.0, copies: int = COPIES) -> dict:
    """Shares of the budget by weight; a share stops at `copies` times its source's size and the excess is shared anew."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict = {}
    # the fewer tokens a source has for its weight, the sooner its share is full
    waiting = deque(sorted(order, key=lambda s: copies * sizes[s] / weight[s]))
    left, share = float(budget), sum(weight.values())
    while waiting and left / share * weight[waiting[0]] > copies * sizes[waiting[0]]:
        s = waiting.popleft()
        out[s] = float(copies * sizes[s])
        left -= out[s]
        share = sum(weight[x] for x in waiting) if len(waiting) < 64 else share - weight[s]
    return out | {s: left / share * weight[s] for s in waiting}


def route(tokens: dict[str, int], members: dict[str, list], targets: dict, copies: int = COPIES) -> dict[str, dict]:
    """Tokens of each pattern for each of its sources at the least repetition cost.

    The cost of a path is the layer of the pattern that gives (copy k of a pattern holds its tokens and costs k - 1), so
    shortest paths come layer by layer: with the first k copies open, a maximum flow from the patterns over the sources
    to the quotas is found before copy k + 1 opens. A path may take tokens back from a source that another pattern can
    serve. A source alone with its pattern is served at once.
    """
    flow: dict[str, dict] = {p: dict.fromkeys(members[p], 0) for p in tokens}
    need = {s: round(t) for s, t in targets.items()}
    of: dict = {}
    for p, group in members.items():
        for s in group:
            of.setdefault(s, []).append(p)
    shared = []
    for p, group in members.items():
        if len(group) == 1 and len(of[group[0]]) == 1:
            flow[p][group[0]] = min(need[group[0]], copies * tokens[p])
        elif tokens[p]:
            shared.append(p)
    used = dict.fromkeys(shared, 0)
    of = {s: [p for p in patterns if p in used] for s, patterns in of.items()}
    open_ = {s for p in shared for s in members[p] if need[s] > 0}
    for layer in range(1, copies + 1):
        for p in shared:  # what needs no detour
            for s in sorted(members[p], key=lambda s: len(of[s])):
                amount = min(need[s], layer * tokens[p] - used[p])
                flow[p][s] += amount
                used[p] += amount
                need[s] -= amount
        while _augment(flow, used, need, of, members, open_, {p: layer * tokens[p] for p in shared}):
            pass
    return flow


def _augment(flow: dict, used: dict, need: dict, of: dict, members: dict, open_: set, room: dict) -> bool:
    """One phase of blocking flow: levels by breadth from the sources in need, then paths along the levels, each node left
    for good once it leads nowhere. False if no pattern with room can be reached."""
    open_ -= {s for s in open_ if need[s] <= 0}
    level: dict = {("s", s): 0 for s in open_}
    queue, found = deque(level), False
    while queue:
        node = queue.popleft()
        kind, x = node
        if kind == "s":
            nexts = [("p", p) for p in of[x]]
        else:
            found = found or used[x] < room[x]
            nexts = [] if found else [("s", s) for s, f in flow[x].items() if f > 0]
        for n in nexts:
            if n not in level:
                level[n] = level[node] + 1
                queue.append(n)
    if not found:
        return False
    left = {node: iter([("p", p) for p in of[node[1]]] if node[0] == "s" else [("s", s) for s in members[node[1]]]) for node in level}
    for start in list(open_):
        path = [("s", start)]
        while path and need[start] > 0:
            kind, x = path[-1]
            if kind == "p" and used[x] < room[x]:
                steps = list(zip(path, path[1:]))
                amount = min([need[start], room[x] - used[x], *(flow[a[1]][b[1]] for a, b in steps if a[0] == "p")])
                for a, b in steps:  # a pattern serves the source before it instead of the one after it
                    if a[0] == "s":
                        flow[b[1]][a[1]] += amount
                    else:
                        flow[a[1]][b[1]] -= amount
                used[x] += amount
                need[start] -= amount
                path = [("s", start)]
                continue
            for n in left[path[-1]]:
                if level.get(n) == level[path[-1]] + 1 and (kind == "s" or flow[x][n[1]] > 0):
                    path.append(n)
                    break
            else:
                path.pop()
    return True


def _pattern(docs: DataFrame, source_col: str) -> Column:
    """The sources of a row as sorted JSON; a plain or null source is a pattern of one."""
    col = F.col(source_col)
    listed = F.coalesce(col, F.array(F.lit(None).cast("string"))) if isinstance(docs.schema[source_col].dataType, ArrayType) else F.array(col.cast("string"))
    return F.to_json(F.sort_array(F.array_distinct(listed)))


def chance(seed: int, id_col: str, text_key: str, copy: Column) -> Column:
    """A hash of id, text and the number among equal ones: null and repeated ids are drawn apart."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_key), copy)


def plan_mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES, cell_rows: int = CELL_ROWS) -> tuple[Plan, DataFrame]:
    """(plan, table of pattern, whole, edge, extra, source_size, target) for rows (pattern, size, h).

    A document of a pattern gets `whole` copies, and one more if its hash is at most `edge` or is `extra`. The edge is
    found by sums of sizes over ranges of hashes: the range that holds it is divided again until it has few rows, so no
    task orders more than those or the ranges of a pattern. Sums by pattern come to the driver.
    """
    spark = rows.sparkSession
    totals = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    tokens = {r["pattern"]: r["size"] for r in totals}
    members = {p: json.loads(p) for p in tokens}
    sizes: dict = {}
    for p, n in tokens.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + n
    targets = targets_of(sizes, weights, share * sum(tokens.values()), copies)
    plan = Plan(sizes, targets, route(tokens, members, targets, copies))
    table = []
    for p, n in tokens.items():
        sent = sum(plan.flow[p].values())
        whole = min(copies, sent // n) if n else 0
        table.append({"pattern": p, "whole": int(whole), "rest": int(sent - whole * n), "source_size": sum(sizes[s] for s in members[p]), "target": float(sum(targets[s] for s in members[p]))})
    shown = staged(small_table(spark, table, "pattern: string, whole: int, rest: bigint, source_size: bigint, target: double"), "patterns")
    edge = shown.where("rest > 0").select("pattern", F.col("rest").alias("left"), F.lit(0).cast("long").alias("cell"))
    bits, most = 0, max((r["n"] for r in totals), default=0)
    # signed hashes: the number of a range keeps their order
    cell = lambda b: F.shiftright("h", 64 - b) if b else F.lit(0).cast("long")
    while most > cell_rows and bits + LEVEL_BITS < 64:
        inside = rows.withColumn("cell", cell(bits)).join(edge, ["pattern", "cell"])
        bits += LEVEL_BITS
        sums = inside.groupBy("pattern", cell(bits).alias("cell"), "left").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        sums = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("pattern").orderBy("cell")))
        sums = sums.where((F.col("upto") - F.col("size") < F.col("left")) & (F.col("upto") >= F.col("left")))
        found = staged(sums.select("pattern", (F.col("left") - (F.col("upto") - F.col("size"))).alias("left"), "cell", "n"), "edges")
        edge, most = found.drop("n"), found.agg(F.max("n")).first()[0] or 0
    inner = staged(rows.withColumn("cell", cell(bits)).join(edge, ["pattern", "cell"]).withColumn("upto", F.sum("size").over(Window.partitionBy("pattern").orderBy("h"))), "edge-rows")
    low = F.when(F.col("cell") > -(1 << max(0, bits - 1)), F.shiftleft("cell", 64 - bits) - 1) if bits else F.lit(None).cast("long")
    # without a row of its own that fits, the edge lies just below the range
    fits = inner.where("upto <= left").groupBy("pattern").agg(F.max("h").alias("h"), F.max("upto").alias("got"))
    edges = edge.select("pattern", low.alias("below"), "left").join(fits, "pattern", "left").select("pattern", F.coalesce("h", "below").alias("edge"), (F.col("left") - F.coalesce("got", F.lit(0))).alias("gap"))
    # one document past the edge closes the gap best
    past = inner.select("pattern", "h", "size").join(edges, "pattern").where((F.col("edge").isNull() | (F.col("h") > F.col("edge"))) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
    past = past.groupBy("pattern").agg(F.min_by("h", F.struct(F.abs(F.col("size") - F.col("gap")), "h")).alias("extra"))
    edges = edges.select("pattern", "edge").join(past, "pattern", "left")
    return plan, staged(shown.drop("rest").join(edges, "pattern", "left"), "mix")


def _rows(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, pattern, size, text_key, copy, h) of every row; equal rows are counted before any shuffle and numbered."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _pattern(docs, source_col).alias("pattern"), words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("text_key"))
    named = ("doc_id", "pattern", "size", "text_key")
    rows = rows.groupBy(*named).agg(F.count("*").alias("n")).select(*named, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return staged(rows.withColumn("h", chance(seed, "doc_id", "text_key", F.col("copy"))), "sizes")


def _copies(prefix: str = "") -> Column:
    h, edge, extra = (F.col(prefix + c) for c in ("h", "edge", "extra"))
    more = F.coalesce(h <= edge, F.lit(False)) | F.coalesce(h == extra, F.lit(False))
    return F.col(prefix + "whole") + more.cast("int")


def mix(docs: DataFrame, seed: int = 23, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row.

    source_size and target are those of the row's source, or the sums over its sources if source_col is an array.
    Sizes are words; a null text has none and is never taken. Null sources are one source, after all others. A
    source's taken words miss its target by less than one document, whatever its ids: null and repeated ids are told
    apart by their texts, and equal rows by a number. The slim table of sizes is written once; it is joined with a table
    of one row a pattern.
    """
    rows = _rows(docs, seed, id_col, text_col, source_col)
    _, table = plan_mix(rows)
    out = rows.join(table, "pattern").withColumn("copies", _copies())
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, seed: int = 23, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as the mix takes them: a row stands as often as it is copied, and not at all with no copy.

    The columns stay as they were; texts are not shuffled. A text without words weighs nothing: it stays once. Of n rows
    equal in id, text and source, of which the mix takes k once more than the others, each is taken once more with the
    chance k / n by its place in the table, as nothing else tells them apart.
    """
    rows = _rows(docs, seed, id_col, text_col, source_col)
    _, table = plan_mix(rows)
    named = ("doc_id", "pattern", "text_key")
    again = staged(rows.join(table, "pattern").groupBy(*named).agg(F.count("*").alias("n"), F.sum(_copies() - F.col("whole")).alias("k")).where("n > 1"), "repeats")
    table = table.select(*(F.col(c).alias(f"__{c}") for c in ("pattern", "whole", "edge", "extra")))
    used = docs.withColumns({"__pattern": _pattern(docs, source_col), "__text": F.xxhash64(F.col(text_col)), "__size": words(F.col(text_col))})
    used = used.withColumn("__h", chance(seed, id_col, "__text", F.lit(1))).join(table, "__pattern")
    times = _copies("__")
    if not again.isEmpty():
        again = again.select(F.col("doc_id").alias("__id"), F.col("pattern").alias("__p"), F.col("text_key").alias("__t"), (F.col("k") / F.col("n")).alias("__share"))
        used = used.withColumn("__place", F.monotonically_increasing_id())
        used = used.join(again, used[id_col].eqNullSafe(again["__id"]) & (F.col("__pattern") == F.col("__p")) & (F.col("__text") == F.col("__t")), "left")
        drawn = F.pmod(F.xxhash64(F.lit(seed), "__place"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        times = F.when(F.col("__share").isNull(), times).otherwise(F.col("__whole") + (drawn < F.col("__share")).cast("int"))
    times = F.when(F.col("__size") == 0, 1).otherwise(times)
    return used.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)
