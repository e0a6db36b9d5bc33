"""Intents of messages: a multinomial logistic regression over unit vectors of phrases, fitted on examples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from rankloom.operators.encode import HashingEncoder, encoded
from rankloom.sources.storage import staged

#: Strength of the fit, and the longest message that is classified.
STRENGTH, LONGEST = 20.0, 1000
OTHER = "other"


def phrase_encoder() -> HashingEncoder:
    return HashingEncoder(256, 7)


@dataclass
class Classifier:
    """Class names in order, the fitted model, and what makes its encoder."""

    intents: list[str]
    model: LogisticRegressionModel
    make: Callable


def fit(examples: DataFrame, make: Callable = phrase_encoder, strength: float = STRENGTH) -> Classifier:
    """A classifier of examples (intent, phrase); rows without either are left out.

    A class weighs n / (classes * its n), so that rare intents count as much as common ones. Spark's loss is a mean over
    weights, so a penalty of 1 / (strength * sum of weights) fits what `strength` times the summed loss would.
    """
    rows = encoded(examples.where("intent is not null and trim(phrase) <> ''").select("intent", "phrase"), "phrase", make)
    rows = staged(rows, "examples")
    counts = {r["intent"]: r["n"] for r in rows.groupBy("intent").agg(F.count("*").alias("n")).collect()}  # a row an intent
    if len(counts) < 2:
        raise ValueError("examples of two intents at least are needed")
    intents, total = sorted(counts), sum(counts.values())
    weight = F.create_map(*(F.lit(x) for i in intents for x in (i, total / (len(intents) * counts[i]))))
    label = (F.array_position(F.array(*map(F.lit, intents)), F.col("intent")) - 1).cast("double")
    ready = rows.select(array_to_vector("vector").alias("features"), label.alias("label"), weight[F.col("intent")].alias("weight"))
    model = LogisticRegression(maxIter=1000, tol=1e-10, regParam=1 / (strength * total), standardization=False, family="multinomial", weightCol="weight").fit(ready)
    return Classifier(intents, model, make)


def scores(messages: DataFrame, classifier: Classifier, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(id, intent, score): the probability of each intent; blank and overlong messages are `other` with score 0."""
    live = F.coalesce((F.trim(text_col) != "") & (F.length(text_col) <= LONGEST), F.lit(False))
    rows = encoded(messages.where(live).select(id_col, F.col(text_col).alias("text")), "text", classifier.make)
    found = classifier.model.transform(rows.select(id_col, array_to_vector("vector").alias("features")))
    each = found.select(id_col, F.posexplode(vector_to_array("probability")).alias("at", "score"))
    names = F.array(*map(F.lit, classifier.intents))
    told = each.select(id_col, F.element_at(names, F.col("at") + 1).alias("intent"), "score")
    return told.union(messages.where(~live).select(id_col, F.lit(OTHER).alias("intent"), F.lit(0.0).alias("score")))
