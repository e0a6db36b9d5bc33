"""Main text by the style tree: in articles, beside them and without them."""

import math
import random
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from rankloom.llm import html_extract


def extracted(spark, bodies, host="site.example"):
    rows = [(i, f"https://{host}/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(out, key=lambda r: r["page_id"])]


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_repeated_branch_inside_main_goes(spark):
    rng = random.Random(1)
    texts = [prose(rng, 60) for _ in range(6)]
    for tag in ("main", "article"):
        bodies = [f'<{tag}><p>{t}</p><div class="zz"><span>Call us day and night</span></div></{tag}>' for t in texts]
        assert extracted(spark, bodies) == texts


def test_body_beside_teaser_articles(spark):
    rng = random.Random(2)
    texts = [prose(rng, 80) for _ in range(5)]
    own = ["".join(f"<article><p>{prose(rng, 6)}</p></article>" for _ in range(3)) for _ in texts]
    assert extracted(spark, [f'<div class="text"><p>{t}</p></div>{cards}' for t, cards in zip(texts, own)]) == texts
    # cards that are the same on all pages are low even where they are longer than the body
    same = f"<article><p>{prose(rng, 200)}</p></article>"
    assert extracted(spark, [f'<div class="text"><p>{t}</p></div>{same}' for t in texts]) == texts
    # one page alone has no tree
    assert extracted(spark, [f"<div><p>{texts[0]}</p></div>{own[0]}"]) == texts[:1]


def test_articles_keep_their_place(spark):
    rng = random.Random(3)
    texts = [prose(rng, 60) for _ in range(5)]
    # without articles the low elements go; beside a longer article other text goes; posts of one page all stay
    assert extracted(spark, [f'<div class="zz">Call us</div><div><p>{t}</p></div>' for t in texts]) == texts
    assert extracted(spark, [f"<article><p>{t}</p></article><div>{prose(rng, 10)}</div>" for t in texts]) == texts
    assert extracted(spark, ["".join(f"<article><p>{t}</p></article>" for t in texts)]) == ["\n\n".join(texts)]
    # copies of one page are no reason to lose it
    assert extracted(spark, [f"<article><p>{texts[0]}</p></article>"] * 4) == texts[:1] * 4


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "deep" + "</div>" * 20_000, "<a " * 350_000, "<b><div>" * 10_000 + "</b>" * 20_000, "<p>" * 100_000, "<li><ul>" * 20_000 + "</p>" * 50_000, '<a "' * 200_000, "<a '\"<" * 100_000, "<!--" * 200_000, "</" * 300_000], ids=range(9))
def test_time_in_proportion(page):
    began = time.time()
    html_extract.parse(page)
    assert time.time() - began < 3


class Tree(HTMLParser):
    """A page of well-formed markup as (path of tags and classes, text) and (path, child tags), by Python's own parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.texts, self.elements = [("", [])], [], []
        self.feed(page)
        self.close()
        while len(self.stack) > 1:
            self.pop()

    def pop(self):
        path, children = self.stack.pop()
        self.elements.append((path, " ".join(children)))

    def handle_starttag(self, tag, attrs):
        self.stack[-1][1].append(tag)
        self.stack.append((self.stack[-1][0] + "/" + ".".join([tag, *(dict(attrs).get("class") or "").split()]), []))

    def handle_endtag(self, tag):
        self.pop()

    def handle_data(self, data):
        if data.strip():
            self.texts.append((self.stack[-1][0], " ".join(data.split())))


def brute_tree(pages):
    """{(host, path): (pages, content, presentation)} with all features of an element side by side."""
    found = defaultdict(lambda: (set(), defaultdict(Counter), Counter()))
    for n, (host, page) in enumerate(pages):
        tree = Tree(page)
        kept = {path for path, _ in tree.texts}
        for path, text in tree.texts:
            where, texts, _ = found[host, path]
            where.add(n)
            texts[text][n] += 1
        for path, children in tree.elements:
            if path in kept:
                found[host, path][2][children] += 1
    out = {}
    for key, (where, texts, styles) in found.items():
        m = len(where)
        entropy = lambda counts: -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts)
        scale = math.log(max(m, 2))
        content = 1.0 if m == 1 else max(0.0, 1 - sum(entropy(c.values()) for c in texts.values()) / len(texts) / scale)
        presentation = 1.0 if m == 1 else min(1.0, max(0.0, entropy(styles.values()) / scale))
        out[key] = (m, content, presentation)
    return out


def test_the_tree_against_a_plain_one(spark):
    """Hosts of different layouts with plain divs: the same elements, pages and importance; the text follows from them."""
    rng = random.Random(6)
    pages, bodies = [], []
    for host, n in (("a.example", 12), ("b.example", 5), ("c.example", 2)):
        for _ in range(n):
            body = [prose(rng, 20) for _ in range(rng.randint(1, 4))]
            same = f'<div class="zz"><div class="qq">Call {host} now</div><span>Day and night</span></div>'
            pages.append((host, f'<html><body>{same}<div class="text">{"".join(f"<p>{t}</p>" for t in body)}</div><div class="yy">{rng.choice(["Odd", "Even"])} end</div></body></html>'))
            bodies.append(body)
    table = spark.createDataFrame([(i, f"https://{h}/{i}", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    import xxhash

    def element(path):
        h = 0
        for name in path.split("/")[1:]:
            h = xxhash.xxh64_intdigest(f"{h}/{name}") >> 1
        return h

    # a text directly in an inline element belongs to the block around it
    merged = [(h, p.replace("<span>", "").replace("</span>", "")) for h, p in pages]
    wanted = {(h, element(path)): v for (h, path), v in brute_tree(merged).items()}
    found = {(r["host"], r["element"]): (r["pages"], r["content"], r["presentation"]) for r in html_extract.style_tree(table).collect()}
    assert set(found) == set(wanted)
    for k, (m, content, _) in wanted.items():
        assert found[k][0] == m and found[k][1] == pytest.approx(content, abs=1e-9)
    texts = {r["page_id"]: r["text"] for r in html_extract.extract(table).collect()}
    off = {r["page_id"]: r["text"] for r in html_extract.extract(table, low=-1.0).collect()}
    for i, ((host, _), body) in enumerate(zip(pages, bodies)):
        if host != "c.example":  # two pages are too few to judge
            blocks = texts[i].split("\n\n")
            # one of two endings says something, if little
            assert blocks[: len(body)] == body and set(blocks[len(body) :]) <= {"Odd end", "Even end"}
        assert f"Call {host} now" in off[i]  # the tree alone takes it away


def test_whole_table_against_plain_extraction(spark, sf_dir):
    """Pages of the table have an article: what stands in it, by Python's parser and without what its tags name."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    found = {r["page_id"]: r for r in html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    assert set(found) == {r["page_id"] for r in rows}
    for r in rows:
        assert found[r["page_id"]]["n_chars"] == len(found[r["page_id"]]["text"]) and "<" not in found[r["page_id"]]["text"].replace("< ", "")
        article = (r["html"] or "").split("<article", 1)[-1].split("</article>")[0] if "<article" in (r["html"] or "") else None
        if article is not None:
            words = Counter(" ".join(t for _, t in Tree("<article" + article).texts).split())
            assert not Counter(found[r["page_id"]]["text"].split()) - words, r["page_id"]


def test_edge_rows(spark):
    extra = "host string, weak string, importance double, element long, n_chars int"
    rows = [(1, "https://a.example/1", None), (1, "https://a.example/1", None), (2, None, "<p>One &amp; two</p>"), (None, "odd", "plain text"), (3, "", ""), (4, "https://a.example/4", "<p>" + "word " * 50_000), (5, "//x", "<script>no</script>")]
    table = spark.createDataFrame([(*r, *[None] * 5) for r in rows], f"page_id long, url string, html string, {extra}")
    out = html_extract.extract(table).collect()
    assert out[0].asDict().keys() == {"page_id", "url", "text", "n_chars"} and len(out) == len(rows)
    assert sorted((str(r["page_id"]), r["text"][:12], r["n_chars"]) for r in out) == sorted([("1", "", 0), ("1", "", 0), ("2", "One & two", 9), ("None", "plain text", 10), ("3", "", 0), ("4", "word word wo", 249_999), ("5", "", 0)])
    assert html_extract.extract(table.where("1 = 0")).count() == 0
