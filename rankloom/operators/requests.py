"""Requests answered by any retriever: the one contract that lexical, dense and fused rankings share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from rankloom.sources.storage import array_form


def answered(requests: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], size: int) -> DataFrame:
    """(query_id, predicted_track_ids) of requests (query_id, query, k), a list for each, its first k items at most.

    retrieve takes requests and a depth and returns a ranking (query_id, rank, item_id). A blank request, a null one, or
    one with k null or at most 0 gets an empty list and is not retrieved; no depth exceeds size, the number of items.
    """
    live = requests.where((F.trim(F.col("query")) != "") & (F.col("k") > 0))
    depth = min(size, live.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0])
    found = retrieve(live.select("query_id", "query"), depth)
    kept = found.join(live.select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k"))
    lists = array_form(kept)
    nothing = F.array().cast(lists.schema["predicted_track_ids"].dataType)
    return requests.select("query_id").join(lists, "query_id", "left").select("query_id", F.coalesce("predicted_track_ids", nothing).alias("predicted_track_ids"))
