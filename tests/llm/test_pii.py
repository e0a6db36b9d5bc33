"""Base spans against Python's re, digests, and what the method adds."""

import hashlib
import random
import re

from rankloom.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    digits = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return True


def plain(text):
    found = [(m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(PATTERNS[p], text or "") if valid(p, m[0])]
    return [(list(PATTERNS)[k], s, e) for s, k, e in sorted(found)]


def check(row, text):
    spans = plain(text)
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    assert {k: row[f"n_{k}"] for k in PATTERNS} == {k: sum(s[0] == k for s in spans) for k in PATTERNS}, text
    assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (text, joined, row["spans"])
    assert set(joined.split(",")) <= set(row["spans"].split(",")) | {""}


def test_whole_table(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pii.find(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check(r, texts[r["doc_id"]])


def test_random_texts(spark):
    rng = random.Random(5)
    pieces = ["a@b.co", "@", ".", "-", " ", "+", "1", "23", "192.168.0.1", "4111 1111 1111 1111", "+44 20 7946 0958", "(", ")", "é☃", "𝒳", "x", "%_", "256.1.1.1", "0378282246310005", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(docs).collect():
        check(r, texts[r["doc_id"]])


def test_the_method_adds_spans(spark):
    """Looser forms among many plain ones: they are added, base spans stay, and bad card numbers are never spans."""
    texts = [f"please write an email to john{n}@mail.com or call the phone +1 212 555 01{n:02d} today" for n in range(60)] + ["send mail to jane (at) mail.com now", "call phone 212-555-0187 now", "card 4111 1111 1111 1112 is wrong"]
    rows = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[60]["n_email"] == 0 and rows[60]["spans"].startswith("email:13:31") and rows[60]["n_added"] == 1
    assert rows[61]["n_phone"] == 0 and rows[61]["spans"] == "phone:11:23"
    assert rows[62]["spans"] == "" and rows[62]["n_card"] == 0


def planted(rng, n):
    """(text, spans beyond the base ones that are personal data) with decoys: numbers that fail a check, versions, times."""
    def digits(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    def card(fails):
        body = "4" + digits(14)
        for last in "0123456789":
            if valid("card", body + last) != fails:
                return body + last

    def split(x, sep):
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    ip = lambda sep: sep.join(str(rng.randrange(1, 256)) for _ in range(4))
    phone = lambda: f"+1 ({rng.randrange(201, 999)}) 555-{digits(4)}"
    address = lambda at, dot: f"jane{digits(2)}{at}mail{dot}com"
    plain_forms = [lambda: ("mail", address("@", ".")), lambda: ("card", card(False)), lambda: ("server", ip(".")), lambda: ("call", phone())]
    loose_forms = [
        lambda: ("mail", address(" (at) ", ".")), lambda: ("write", address("[at]", "[dot]")), lambda: ("card", split(card(False), ".")), lambda: ("card", split(card(False), "/")), lambda: ("server", ip("[.]")), lambda: ("host", ip(" . ")),
        lambda: ("call", f"001 {rng.randrange(201, 999)} 555 {digits(4)}"), lambda: ("tel", f"{rng.randrange(201, 999)}-555-{digits(4)}"),
    ]
    decoys = [lambda: ("order", card(True)), lambda: ("number", split(card(True), ".")), lambda: ("version", f"{digits(1)}.{digits(2)}.{digits(1)}"), lambda: ("at", f"{rng.randrange(10, 24)}:{rng.randrange(10, 60)}"), lambda: ("year", "19" + digits(2)), lambda: ("id", digits(7)), lambda: ("ratio", ip(" . ").replace(".", ",")), lambda: ("net", "300[.]" + ip("[.]")[4:])]
    out = []
    for i in range(n):
        form, loose = (rng.choice(plain_forms), 0) if i % 4 else (rng.choice(loose_forms), 1)
        lead, value = form()
        text, spans = f"we had some words here, {lead} ", []
        if loose:
            spans.append((len(text), len(text) + len(value)))
        text += value + " and more words after it"
        for _ in range(rng.randrange(3)):
            lead, value = rng.choice(decoys)()
            text += f", then {lead} {value} is said"
        out.append((text, spans))
    # a number beside another: the base rule takes both as one, which fails
    for _ in range(n // 50):
        one, two = card(False), card(False)
        text = f"cards {one} {two} were seen"
        out.append((text, [(6, 22), (23, 39)]))
    return out


def test_precision_and_recall_on_planted_forms(spark):
    cases = planted(random.Random(8), 3000)
    rows = {r["doc_id"]: r for r in pii.find(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    right = added = wanted = 0
    for i, (text, spans) in enumerate(cases):
        check(rows[i], text)
        base = {f"{k}:{s}:{e}" for k, s, e in plain(text)}
        more = {tuple(map(int, x.split(":")[1:])) for x in rows[i]["spans"].split(",") if x and x not in base}
        assert rows[i]["n_added"] == len(more) and rows[i]["n_spans"] == len(more) + len(base)
        added, wanted, right = added + len(more), wanted + len(spans), right + len(more & set(spans))
    print("added", added, "precision", right / max(1, added), "recall", right / wanted)
    assert added and right / added > 0.97 and right / wanted > 0.9


def test_many_numbers_in_one_text(spark):
    """Time in proportion: 200,000 numbers of one text."""
    import time

    text = " ".join(str(n) for n in range(200_000))
    began = time.time()
    rows = pii.find(spark.createDataFrame([(1, text), (2, "a@b.co " * 50_000)], "doc_id long, text string")).collect()
    assert time.time() - began < 60
    for r in rows:
        check(r, text if r["doc_id"] == 1 else "a@b.co " * 50_000)


def test_reliabilities_follow_agreement():
    """Two labelers that agree are trusted over one that votes at random."""
    counts = {(0, *p): n for p, n in {(1, 1, 1): 40, (1, 1, -1): 40, (-1, -1, 1): 40, (-1, -1, -1): 40, (1, -1, 1): 2, (-1, 1, 1): 2}.items()} | {(-1, 1, 1, 1): 5}
    post = pii.reliabilities(counts)
    assert post[0, 1, 1, -1] > 0.9 and post[0, -1, -1, 1] < 0.1 and post[-1, 1, 1, 1] == pii.FAILED
    assert pii.reliabilities({}) == {}


def test_edge_rows(edge, empty):
    rows = pii.find(edge).collect()
    assert len(rows) == edge.count() and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows if r["doc_id"] in (2, 3, 4))
    assert pii.find(empty).count() == 0
