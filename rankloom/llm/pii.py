"""Personal data by weak supervision, in DataFrame functions alone.

Candidates are what the base patterns match, passed or failed, and what looser patterns of all four kinds propose:
obfuscated addresses, defanged or spaced IP addresses and IPv6, card numbers with other separators or beside another
number, phone numbers without a plus or followed by more digits. On each candidate several labelers vote: the rule
with its check, the form, gazetteers (domain ends, calling codes, issuer digits, reserved networks), the words before it
and the characters around it. Expectation-maximisation estimates for each kind how reliable each labeler is from the
counts of vote patterns, without any label but one: what fails its check is taken as none. The posteriors then train the
span classifier, a naive Bayes over features of the span, and it decides which candidates are spans. Base spans always
stay.

Vote patterns and feature values are few by construction, so what the driver sees has a fixed bound. Work on a text is
in proportion to its length: its matches are placed by the lengths of what lies between them.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.llm.common import staged

KINDS = ("email", "ip", "card", "phone")

#: Fixed base patterns, with possessive quantifiers and look-behinds where the leftmost match can't differ, so that
#: long runs of one class are read once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:\x20?[\[(](?:at|AT|@)[\])]\x20?|\x20(?:at|AT)\x20)", r"(?:\x20?[\[(](?:dot|DOT|\.)[\])]\x20?|\x20(?:dot|DOT)\x20|\.)"
#: Looser patterns that only propose.
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,4}}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\x20?[\[(](?:\.|dot)[\])]\x20?|\x20\.\x20)[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[\x20./_-]?[0-9]{4}){3}|3[47][0-9]{2}[\x20./_-]?[0-9]{6}[\x20./_-]?[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)1[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])|(?<![0-9])00[2-9][0-9]{0,2}[\x20.-]\(?[0-9]{1,4}\)?(?:[\x20.-][0-9]{2,4}){2,3}(?![0-9])|(?<![0-9+.-])(?<!\+[0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9.-])",
}
#: What a text must contain for a pattern to be tried.
HINT = {
    ("email", 1): "@", ("ip", 1): r"[0-9]\.[0-9]", ("card", 1): "[0-9]", ("phone", 1): r"\+[0-9]", ("email", 0): r"[\[(](?:at|AT|@)[\])]|\x20(?:dot|DOT)\x20",
    ("ip", 0): r"[0-9][\[(\x20]|[0-9A-Fa-f]:[0-9A-Fa-f]", ("card", 0): "[0-9]{4}", ("phone", 0): r"[0-9]{3}[-.\x20]?[0-9]{4}|00[1-9]",
}

#: Gazetteers, fixed values in natural order.
DOMAIN_ENDS = "com|de|edu|es|eu|fr|gov|info|io|it|net|nl|org|uk|us"
ISSUER = r"^(?:3[47]|3[0689]|4|5[1-5]|2[2-7]|6(?:011|4|5)|35)"
CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = r"^(?:0|127|169|2[2-5][0-9])\."
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|kontakt|correo|courriel|adress?e?|write|address)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|client|serveur|servidor|login)\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|karte|carte|tarjeta|kredit|credit|account|number)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:phone|tel|fax|call|mobile|cell|telefon|téléphone|teléfono|anruf|number|nummer)\W*(?:\w+\W+){0,2}$",
}
#: Characters of context on either side, EM rounds, probability from which a candidate becomes a span.
NEAR, ROUNDS, ACCEPT = 24, 25, 0.9
#: Probability of what fails its check, which EM doesn't revise: a wrong check digit is known to be none.
FAILED = 0.02
#: Candidates' worth of the kind's own share that is added to the counts of a feature value, so that rare values say little.
PRIOR_COUNT = 2.0
#: Matches of a text that are placed in one go.
BLOCK = 512

_VOTES = ("rule", "form", "list", "words", "edges")


def _once(value: Column, use) -> Column:
    """use(value), with value made once and not again in each step of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _valid(kind: str, m: Column) -> Column:
    """The rule's check of a match, whatever separates its digits."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.contains(":") | F.regexp_replace(m, r"[^0-9]+", ".").rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        # Luhn over the reversed digits: every second one is doubled, with its digits added
        turned = F.reverse(digits)
        at = lambda i: F.substring(turned, i, F.lit(1)).cast("int")
        step = lambda acc, i: acc + F.when(i % 2 == 1, at(i)).otherwise(at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0))
        luhn = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0
        return F.when(F.length(digits).between(12, 19), luhn).otherwise(False)
    return F.lit(True)


def _matches(text: Column, kind: str, base: bool) -> Column:
    """Array of (kind, base, valid, start, end, m, before, after) of a pattern's matches in a text; offsets count code
    points. A match starts where the pieces between matches and the earlier matches end; the characters before it are
    the last of the piece before it, and of the match and piece before that."""
    pattern = (BASE if base else LOOSE)[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    empty = "array<struct<s:int,i:int>>"

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), x["i"].alias("i")))).alias("out"))

    def follow(acc: Column, b: Column) -> Column:
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("o"), b["out"].alias("b")))).alias("out"))

    def placed(x: Column) -> Column:
        """(s, i): start and number of each match; arrays grow by copies, so matches are placed within blocks first, and
        then the blocks."""
        sizes = F.transform(x["f"], lambda m, i: F.struct(F.length(m).alias("n"), F.length(F.get(x["p"], i)).alias("p"), i.alias("i")))

        def of(sizes: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda i: F.slice(sizes, i * BLOCK + 1, BLOCK))
            inner = F.transform(blocks, lambda b: F.aggregate(b, F.struct(F.lit(0).alias("at"), F.array().cast(empty).alias("out")), add))
            none_yet = F.array().cast(f"array<struct<o:int,b:{empty}>>")
            followed = F.aggregate(inner, F.struct(F.lit(0).alias("at"), none_yet.alias("out")), follow, lambda acc: acc["out"])
            return F.flatten(F.transform(followed, lambda x: F.transform(x["b"], lambda r: F.struct((x["o"] + r["s"]).alias("s"), r["i"].alias("i")))))

        return _once(sizes, of)

    def candidates_of(x: Column) -> Column:
        def candidate(r: Column) -> Column:
            m = F.get(x["f"], r["i"])
            near = lambda c: F.right(F.coalesce(c, F.lit("")), F.lit(NEAR))
            earlier = F.when(r["i"] > 0, F.concat(near(F.get(x["p"], r["i"] - 1)), F.get(x["f"], r["i"] - 1))).otherwise("")
            before = F.right(F.concat(earlier, near(F.get(x["p"], r["i"]))), F.lit(NEAR))
            after = F.left(F.concat(F.left(F.get(x["p"], r["i"] + 1), F.lit(2)), F.coalesce(F.left(F.get(x["f"], r["i"] + 1), F.lit(2)), F.lit(""))), F.lit(2))
            return F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), _valid(kind, m).alias("valid"), r["s"].alias("start"), (r["s"] + F.length(m)).alias("end"), m.alias("m"), before.alias("before"), after.alias("after"))

        return F.transform(placed(x), candidate)

    none = F.array().cast("array<struct<kind:string,base:boolean,valid:boolean,start:int,end:int,m:string,before:string,after:string>>")
    some = _once(F.struct(found.alias("f"), pieces.alias("p")), lambda x: F.when(F.size(x["f"]) > 0, candidates_of(x)).otherwise(none))
    return F.when(text.rlike(HINT[kind, int(base)]), some).otherwise(none)


def _voted(kind: str, c: Column) -> dict[str, Column]:
    """The labelers' votes on a candidate: 1 yes, -1 no, 0 abstains."""
    m, digits = c["m"], F.regexp_replace(c["m"], "[^0-9]", "")
    yes = lambda cond, no=-1: F.when(cond, 1).otherwise(no)
    form = {
        "email": m.rlike(r"^[A-Za-z0-9]") & ~m.contains(".."),
        "ip": m.contains(":") | F.regexp_replace(m, "[^0-9]+", ".").rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"),
        "card": m.rlike(r"^(?:[0-9]{12,19}|[0-9]{4}([\x20./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20./_-])[0-9]{6}\2[0-9]{5})$"),
        "phone": m.rlike(r"^\+?[0-9]*\x20?(?:\([0-9]{2,4}\)[\x20-]?)?[0-9]+(?:[\x20.-][0-9]{2,})*$"),
    }[kind]
    known = {
        "email": m.rlike(rf"(?i)[.)\]\x20](?:{DOMAIN_ENDS})$"),
        "ip": ~m.rlike(RESERVED),
        "card": digits.rlike(ISSUER),
        "phone": F.when(m.startswith("+") | m.startswith("00"), F.regexp_replace(digits, "^00", "").rlike(CALLING)).otherwise(digits.rlike("^[2-9]")),
    }[kind]
    edge = ~c["before"].rlike(r"[A-Za-z0-9./-]$") & ~c["after"].rlike(r"^(?:[A-Za-z0-9/-]|\.[0-9])")
    return {"rule": F.lit(0) if kind == "email" else yes(c["valid"]), "form": yes(form), "list": yes(known), "words": yes(c["before"].rlike(CONTEXT[kind]), 0), "edges": yes(edge)}


def _features(c: Column) -> Column:
    """Values of the span classifier, each a short string from a small set that says whether the check passed."""
    digits = F.length(F.regexp_replace(c["m"], "[^0-9]", ""))
    values = (
        F.concat(F.lit("n"), F.least(digits, F.lit(24))),
        F.concat(F.lit("o"), F.least(F.floor(F.length(c["m"]) / 4), F.lit(16))),
        F.concat(F.lit("s"), F.substring(F.regexp_replace(c["m"], "[A-Za-z0-9]+", ""), 1, 3)),
        F.concat(F.lit("b"), F.when(c["before"].rlike(r"\s$|^$"), "w").when(c["before"].rlike("[0-9]$"), "d").when(c["before"].rlike(r"\p{L}$"), "l").otherwise("p")),
        F.concat(F.lit("a"), F.when(c["after"].rlike(r"^\s|^$"), "w").when(c["after"].rlike("^[0-9]"), "d").when(c["after"].rlike(r"^\p{L}"), "l").otherwise("p")),
        F.concat(F.lit("g"), c["base"].cast("int")),
    )
    # each value together with the check: naive Bayes would take six values that go with a good form for six reasons
    return F.array(*(F.concat(c["valid"].cast("int").cast("string"), v) for v in values))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, c) of every row: all candidates with votes and features. One pass over the texts, no shuffle."""
    text = F.coalesce(F.col("t"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    found = F.concat(*(_matches(text, k, True) for k in KINDS), *(_matches(text, k, False) for k in LOOSE))

    def enrich(c: Column) -> Column:
        votes = {v: reduce(lambda acc, k: acc.when(c["kind"] == k, _voted(k, c)[v]), KINDS[1:], F.when(c["kind"] == KINDS[0], _voted(KINDS[0], c)[v])) for v in _VOTES}
        pattern = F.concat_ws(",", *(votes[v].cast("string") for v in _VOTES))
        return F.struct(c["kind"].alias("kind"), c["base"].alias("base"), (c["base"] & c["valid"]).alias("kept"), c["start"].alias("start"), c["end"].alias("end"), pattern.alias("votes"), _features(c).alias("features"))

    return rows.select("doc_id", F.transform(found, enrich).alias("c"))


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern by expectation-maximisation over two hidden classes.

    The first vote is the rule's; where it is no, the posterior stays FAILED. A labeler has, in each class, a probability of each vote (with one count added); abstentions are votes of their
    own. It starts from the share of yes among a pattern's votes, which also fixes which class is which.
    """
    if not counts:
        return {}
    post = {p: FAILED if p[0] < 0 else min(0.95, max(0.05, (sum(v > 0 for v in p) + 0.5) / (sum(v != 0 for v in p) + 1))) for p in counts}
    width = len(next(iter(counts)))
    for _ in range(rounds):
        total = [sum(n * (q if side else 1 - q) for (p, n), q in zip(counts.items(), post.values())) for side in (0, 1)]
        table = [[dict.fromkeys((-1, 0, 1), 1.0) for _ in range(width)] for _ in (0, 1)]
        for p, n in counts.items():
            for j, v in enumerate(p):
                table[1][j][v] += n * post[p]
                table[0][j][v] += n * (1 - post[p])
        odds = math.log((total[1] + 1) / (total[0] + 1))
        for p in (p for p in counts if p[0] >= 0):
            x = odds + sum(math.log(table[1][j][v] / (total[1] + 3)) - math.log(table[0][j][v] / (total[0] + 3)) for j, v in enumerate(p))
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    return post


def _literal_map(values: dict[str, float]) -> Column:
    if not values:
        return F.create_map().cast("map<string,double>")
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in sorted(values.items())))


def train(found: DataFrame) -> dict[str, float]:
    """Log odds of the span classifier by 'kind/feature', and of each kind alone at 'kind/'.

    Patterns of votes are counted by kind; their posteriors weigh the counts of feature values. Both tables are small
    whatever the input: 3^5 patterns and some hundred values for each kind."""
    each = found.select(F.explode("c").alias("c")).select("c.kind", "c.votes", "c.features")
    rows = each.groupBy("kind", "votes").count().collect()
    post: dict[str, float] = {}
    for kind in KINDS:
        counts = {tuple(map(int, r["votes"].split(","))): r["count"] for r in rows if r["kind"] == kind}
        post |= {f"{kind}/{','.join(map(str, p))}": q for p, q in reliabilities(counts).items()}
    weight = F.coalesce(F.element_at(_literal_map(post), F.concat_ws("/", "kind", "votes")), F.lit(0.5))
    weighed = each.select("kind", F.explode(F.array_append(F.col("features"), F.lit(""))).alias("f"), weight.alias("w"))
    sums = weighed.groupBy("kind", "f").agg(F.sum("w").alias("yes"), F.sum(1 - F.col("w")).alias("no")).collect()
    whole = {r["kind"]: (r["yes"] + 0.5, r["no"] + 0.5) for r in sums if r["f"] == ""}
    out = {}
    for r in sums:
        yes, no = whole[r["kind"]]
        prior = math.log(yes / no)
        share = PRIOR_COUNT * yes / (yes + no)
        out[f"{r['kind']}/{r['f']}"] = prior if r["f"] == "" else math.log((r["yes"] + share) / (r["no"] + PRIOR_COUNT - share)) - prior
    return out


def _meets(spans: Column, c: Column) -> Column:
    """One of the spans, which are in order and don't overlap each other, overlaps c: the last that starts before c ends
    does. It is found by halving."""
    half = lambda x: F.floor((x["lo"] + x["hi"]) / 2).cast("int")
    early = lambda x: F.get(spans, half(x))["start"] < c["end"]
    step = lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).when(early(acc), F.struct((half(acc) + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), half(acc).alias("hi")))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
    before = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), step)["lo"]
    return F.coalesce(F.get(spans, before - 1)["end"] > c["start"], F.lit(False))


def find(docs: DataFrame, accept: float = ACCEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans) of every row.

    The counts and base_sha256 are of the base spans; spans lists these and the n_added added ones, n_spans of both. An
    added span is a candidate that is no base span, reaches the classifier's probability `accept` and overlaps no base
    span. A null text is empty: no span, the digest of ''. Repeated rows and null ids stay. Texts are read once and
    never shuffled; candidates are written once.
    """
    found = staged(candidates(docs, id_col, text_col), "candidates")
    odds = _literal_map(train(found))
    limit = math.log(accept / (1 - accept))

    def score(c: Column) -> Column:
        at = lambda f: F.coalesce(F.element_at(odds, F.concat_ws("/", c["kind"], f)), F.lit(0.0))
        return F.aggregate(c["features"], at(F.lit("")), lambda acc, f: acc + at(f))

    kept = lambda k: F.transform(F.filter("base", lambda c: c["kind"] == k), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    rows = found.select("doc_id", F.filter("c", lambda c: c["kept"]).alias("base"), F.filter("c", lambda c: ~c["kept"] & (score(c) >= limit)).alias("likely"))
    clear = lambda c, x: reduce(lambda a, b: a & b, (~_meets(x[k], c) for k in KINDS))
    added = _once(F.struct(*(kept(k).alias(k) for k in KINDS)), lambda x: F.filter("likely", lambda c: clear(c, x)))
    rows = rows.select("doc_id", "base", F.when(F.size("likely") > 0, added).otherwise(F.col("likely")).alias("added"))
    order = lambda c: F.struct(c["start"].alias("s"), F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).alias("k"), c["end"].alias("e"))
    line = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"].cast("int")), x["s"].cast("string"), x["e"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, order)), line), ",")
    count = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long").alias(f"n_{k}")
    number = F.size("added").cast("long")
    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), number.alias("n_added"), (F.size("base") + number).alias("n_spans"))
