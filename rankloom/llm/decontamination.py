"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A seed is a fixed mask over a run of tokens that looks at some positions and ignores the others, so that a replaced
token leaves seeds intact. Benchmark items and documents are hashed under the same masks and joined on the hashes; a
hit says that an item may lie in a document at a certain offset. Offsets with as many hits as any allowed set of
substitutions leaves are compared with the document there, token by token, and count if a stretch agrees in at least
the wanted share of its tokens.

The three masks together lose nothing: however a fifth of the tokens of an item of 8 to 20 tokens, or of a stretch of
20 tokens of a longer one, is replaced, a seed stays whole. Items of 5 to 7 tokens have lighter masks, shorter ones are
sought as they are.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.llm.common import staged

#: Fixed masks: 1 looks, 0 ignores; those of items of 5 to 7 tokens.
MASKS, LIGHT_MASKS, LIGHT = ("111011", "11001011", "11111"), ("1111", "10111", "11011", "11101"), 8
#: Tokens of the stretch that must agree (or the whole item if it is shorter), share that must.
STRETCH, SIMILARITY = 20, 0.8
#: Seeds of the benchmark that are broadcast at a time (some 30 bytes each); a larger benchmark is met in several such
#: blocks. Candidate offsets that are broadcast; more meet the documents by shuffle.
BLOCK_SEEDS, BROADCAST_ROWS = 2_000_000, 1_000_000
#: Patterns of substitutions that are enumerated at most to know how many seeds stay whole; beyond, one hit is enough.
ENUMERATED = 20_000


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits of a text, in order."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1)
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def masks_for(n: int) -> tuple[str, ...]:
    """The masks of an item of n tokens."""
    return MASKS if n >= LIGHT else LIGHT_MASKS if n > 4 else ("1" * n,)


@lru_cache(1024)
def least_hits(n: int, similarity: float = SIMILARITY, stretch: int = STRETCH) -> int:
    """Seeds that stay whole in a stretch of an item of n tokens, whichever tokens are replaced; 1 where that is not known."""
    width = min(n, stretch)
    replaced = math.floor(width * (1 - similarity) + 1e-9)
    if math.comb(width, replaced) > ENUMERATED:
        return 1
    seeds = [{s + k for k, bit in enumerate(m) if bit == "1"} for m in masks_for(n) for s in range(width - len(m) + 1)]
    return max(1, min(sum(seed.isdisjoint(gone) for seed in seeds) for gone in itertools.combinations(range(width), replaced)))


def _seeds(token_array: Column, masks: tuple[str, ...]) -> Column:
    """One array of hashes for each mask: position i holds the seed that starts at token i."""

    def under(mask: str) -> Column:
        looks = [k for k, bit in enumerate(mask) if bit == "1"]

        def of(a: Column) -> Column:
            starts = F.when(F.size(a) >= len(mask), F.sequence(F.lit(0), F.size(a) - len(mask))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.xxhash64(F.lit(int(mask, 2)), *(a[i + k if k else i] for k in looks)))

        # the outer lambda makes the token array once, not once for each seed
        return F.flatten(F.transform(F.array(token_array), of))

    return F.array(*map(under, masks))


def _exploded(rows: DataFrame, masks: tuple[str, ...], *keep: str) -> DataFrame:
    """(keep, seed, at) of rows (keep, toks)."""
    return rows.select(*keep, F.explode(_seeds(F.col("toks"), masks)).alias("s")).select(*keep, F.posexplode("s").alias("at", "seed")).select(*keep, "seed", "at")


def _runs(seeds: DataFrame, key: str) -> DataFrame:
    """(key, seed, first, last): equal seeds at consecutive places of a text or item as one row.

    The places of one seed in one text are ranked together: at most the length of that text."""
    order = F.row_number().over(Window.partitionBy(key, "seed").orderBy("at"))
    return seeds.withColumn("run", F.col("at") - order).groupBy(key, "seed", "run").agg(F.min("at").alias("first"), F.max("at").alias("last")).drop("run")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, stretch: int = STRETCH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(doc_id, item_id, start_token, matched, compared, similarity) of each document with each item found in it.

    start_token is where the item would begin among the document's tokens (negative if its start is cut off), at the
    offset with the best stretch; similarity is that of the best stretch of min(stretch, item) tokens, matched and
    compared count the tokens of the whole item and those inside the document; ties go to more matched tokens, then to
    the first offset. Items without tokens and null texts never match. Rows that repeat give equal rows once; a null id
    is kept as an id, and so is a null item id.
    """
    found = _verified(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), benchmark, similarity, stretch, item_col, item_text_col, block_seeds)
    best = F.max_by(F.struct("start_token", "matched", "compared", "similarity"), F.struct("similarity", "matched", -F.col("start_token")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, stretch: int = STRETCH, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs in whose text no item is found, with their columns. Texts are judged, so equal texts go alike."""
    found = _verified(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), benchmark, similarity, stretch, item_col, item_text_col)
    gone = staged(found.select(F.col("text_key").alias("__key")).distinct(), "contaminated")
    return docs.join(gone, F.xxhash64(F.col(text_col)) == gone["__key"], "left_anti")


def _candidates(docs: DataFrame, items: DataFrame, block_seeds: int) -> DataFrame:
    """(text_key, item, start_token, n) of the offsets with enough hits.

    Documents meet the bare seeds of the benchmark, a block of them at a time, in a broadcast join, so what is not a
    seed of any item leaves before anything is shuffled. Hits of a text are then told apart, joined into runs and met
    with the runs of the items: a run of equal seeds on both sides is one interval of offsets.
    """
    lengths = {r["n"] for r in items.select(F.least("n", F.lit(LIGHT)).alias("n")).distinct().collect()}
    kinds = [(masks_for(n), F.col("n") >= LIGHT if n == LIGHT else F.col("n") == n) for n in sorted(lengths)]
    if not kinds:
        return items.select(F.lit(0).cast("long").alias("text_key"), "item", F.lit(0).alias("start_token"), "n")
    own = reduce(DataFrame.union, (_exploded(items.where(which), masks, "item") for masks, which in kinds))
    item_runs = staged(_runs(own, "item").withColumnsRenamed({"first": "item_first", "last": "item_last"}), "item-seeds")
    keys = item_runs.select("seed").distinct()
    blocks = max(1, math.ceil(keys.count() / block_seeds))
    masks = tuple(dict.fromkeys(m for group, _ in kinds for m in group))
    places = _exploded(docs.select(F.xxhash64("text").alias("text_key"), tokens(F.col("text")).alias("toks")), masks, "text_key")
    met = [places.join(F.broadcast(keys.where(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == b)), "seed", "left_semi").select("text_key", "seed", "at") for b in range(blocks)]
    hits = _runs(staged(reduce(DataFrame.union, met).distinct(), "seed-hits"), "text_key").join(item_runs, "seed")
    start = F.explode(F.sequence(F.col("first") - F.col("item_last"), F.col("last") - F.col("item_first"))).alias("start_token")
    each = hits.select("text_key", "item", "first", "last", "item_first", "item_last", start)
    common = F.least("last", F.col("start_token") + F.col("item_last")) - F.greatest("first", F.col("start_token") + F.col("item_first")) + 1
    counted = each.groupBy("text_key", "item", "start_token").agg(F.sum(common).alias("hits"))
    return counted.join(items.select("item", "n", "need"), "item").where(F.col("hits") >= F.col("need")).select("text_key", "item", "start_token", "n")


def _verified(docs: DataFrame, benchmark: DataFrame, similarity: float, stretch: int, item_col: str, item_text_col: str, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(doc_id, text_key, item_id, start_token, matched, compared, similarity) of offsets that hold, for (doc_id, text)."""
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col)).alias("toks")).where(F.size("toks") > 0).distinct()
    need = F.element_at(F.array(*(F.lit(least_hits(n, similarity, stretch)) for n in range(1, stretch + 1))), F.least("n", F.lit(stretch)))
    items = items.withColumn("n", F.size("toks")).withColumns({"item": F.xxhash64("item_id", "toks"), "need": need})
    items = staged(items, "items")
    near = staged(_candidates(docs, items, block_seeds), "candidates")
    few = near.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    near = near.groupBy("text_key").agg(F.collect_list(F.struct("item", "start_token", "n")).alias("near"))
    # a text is cut into tokens once; only the part that an item would cover leaves it
    rows = docs.withColumn("text_key", F.xxhash64("text")).join(F.broadcast(near) if few else near, "text_key")
    rows = rows.select("doc_id", "text_key", "near", tokens(F.col("text")).alias("toks")).select("doc_id", "text_key", "toks", F.explode("near").alias("c"))
    low = F.greatest(F.col("c.start_token"), F.lit(0))
    high = F.least(F.col("c.start_token") + F.col("c.n"), F.size("toks"))
    rows = rows.select("doc_id", "text_key", "c.item", "c.start_token", (low - F.col("c.start_token")).alias("skipped"), F.slice("toks", low + 1, high - low).alias("part"))
    rows = rows.join(items.select("item", "item_id", F.col("toks").alias("item_toks"), "n"), "item")
    same = F.transform("item_toks", lambda w, i: F.coalesce((F.get("part", i - F.col("skipped")) == w).cast("int"), F.lit(0)))

    def judged(a: Column) -> Column:
        """Agreeing tokens of the whole item, and of its best stretch by a sum that moves along."""
        width = F.least(F.lit(stretch), F.size(a))
        moved = lambda acc, i: acc["s"] + a[i] - F.when(i >= width, F.get(a, i - width)).otherwise(0)
        best = F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.struct(F.lit(0).alias("s"), F.lit(0).alias("best")), lambda acc, i: F.struct(moved(acc, i).alias("s"), F.greatest(acc["best"], moved(acc, i)).alias("best")))
        return F.struct(F.aggregate(a, F.lit(0), lambda acc, v: acc + v).alias("matched"), (best["best"] / width).alias("similarity"))

    rows = rows.select("doc_id", "text_key", "item_id", "start_token", F.size("part").alias("compared"), F.explode(F.transform(F.array(same), judged)).alias("v"))
    rows = rows.select("doc_id", "text_key", "item_id", "start_token", "v.matched", "compared", "v.similarity")
    return rows.where(F.col("similarity") >= similarity)
