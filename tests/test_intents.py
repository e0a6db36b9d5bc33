"""The intent classifier against a plain Newton solver, from a file of examples to what is accepted."""

import json

import numpy as np
import pytest

from rankloom.operators import intents, search
from rankloom.plans import registry
from rankloom.sources import storage

EXAMPLES = {
    "artist": ["who sang this song", "who performed this track", "who is the singer of this song", "which band recorded this", " "],
    "release": ["when was this song released", "what year did this track come out", "when did this drop"],
    "tags": ["what genre is this song", "what style is this track"],
    "other": ["hello there", "play something nice", "thanks a lot", "how are you", "what is the weather", "add it to my playlist"],
}


def newton(x, y, w, strength, classes):
    """Weights and intercepts of strength * sum(w * loss) + |weights|^2 / 2, by damped Newton steps on all parameters."""
    n, d = x.shape
    a = np.hstack([x, np.ones((n, 1))])
    theta, penalty = np.zeros((classes, d + 1)), np.append(np.ones(d), 1e-9)
    onehot = np.eye(classes)[y]
    for _ in range(100):
        z = a @ theta.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gradient = strength * ((p - onehot) * w[:, None]).T @ a + theta * penalty
        h = np.zeros((classes, d + 1, classes, d + 1))
        for i in range(classes):
            for j in range(classes):
                s = strength * w * p[:, i] * ((i == j) - p[:, j])
                h[i, :, j, :] = (a * s[:, None]).T @ a + (np.diag(penalty) if i == j else 0)
        size = classes * (d + 1)
        step = np.linalg.solve(h.reshape(size, size) + 1e-10 * np.eye(size), gradient.ravel())
        theta -= step.reshape(theta.shape)
        if np.abs(step).max() < 1e-10:
            break
    return theta


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("examples") / "examples.json"
    path.write_text(json.dumps(EXAMPLES))
    return intents.fit(storage.read_examples(spark, str(path)), make=lambda: intents.HashingEncoder(24, 7))


def test_probabilities_equal_a_newton_solver(spark, fitted):
    rows = [(i, t) for i, ts in EXAMPLES.items() for t in ts if t.strip()]
    unit = lambda ts: (v := intents.HashingEncoder(24, 7)(ts)) / np.linalg.norm(v, axis=1, keepdims=True)
    names = sorted(EXAMPLES)
    y = np.array([names.index(i) for i, _ in rows])
    w = np.array([len(rows) / (4 * (y == c).sum()) for c in y])
    theta = newton(unit([t for _, t in rows]), y, w, 20.0, 4)
    asked = ["who sang it", "when was it released", "what genre is it", "good morning"]
    z = np.hstack([unit(asked), np.ones((4, 1))]) @ theta.T
    wanted = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    found = np.zeros((4, 4))
    for r in intents.scores(spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), fitted).collect():
        found[r["query_id"], names.index(r["intent"])] = r["score"]
    assert found == pytest.approx(wanted, abs=2e-3)
    coefficients = fitted.model.coefficientMatrix.toArray()
    centred = theta[:, :-1] - theta[:, :-1].mean(axis=0)
    assert coefficients - coefficients.mean(axis=0) == pytest.approx(centred, abs=0.05)


def test_scores_feed_what_is_accepted(spark, fitted):
    asked = [(1, "who sang this song"), (2, "when was this song released"), (3, "thanks a lot"), (4, None), (5, "  "), (6, "who sang this song " * 60)]
    told = {r["query_id"]: (r["intent"], r["accepted"]) for r in search.accepted(intents.scores(spark.createDataFrame(asked, "query_id long, text string"), fitted)).collect()}
    assert told == {1: ("artist", True), 2: ("release", True), 3: ("other", False), 4: ("other", False), 5: ("other", False), 6: ("other", False)}


def test_one_intent_is_an_error(spark):
    with pytest.raises(ValueError):
        intents.fit(spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z")], "intent string, phrase string"))


def test_query_learns_the_routes(spark, sf_dir):
    found = {r["query_id"]: r for r in registry.queries()["intent_scores"](spark, sf_dir).collect()}
    routes = {r["query_id"]: r["route"] for r in registry.queries()["route_message"](spark, sf_dir).collect()}
    about = [q for q in routes if q.startswith("track ")]
    assert set(found) == set(routes) and sum(found[q]["intent"] == routes[q] for q in about) > 0.95 * len(about)
