"""Vectors, pages and the pipeline against brute force, with odd inputs."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.llm import ann, components, embed_dedup, html_extract
from treeline.llm.common import Scratch

VECTORS = "vec_id long, embedding array<float>, label int, key string, `a.b` int"


def unit(rng, dims=12):
    return [float(np.float32(x)) for x in rng.standard_normal(dims)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows, base = [], [unit(rng) for _ in range(12)]
    for i in range(150):
        b = base[int(rng.integers(12))]
        rows.append((i * 5, [float(np.float32(x + 0.12 * rng.standard_normal())) for x in b], int(rng.integers(2))))
    rows += [(1000 + k, base[0], 0) for k in range(30)] + [(2000, [2 * x for x in base[0]], 0), (2001, base[0], None), (2002, None, 0), (2003, [], 0)]
    rows += [(2004, [0.0] * 12, 0), (2005, [math.nan] + [1.0] * 11, 0), (2006, [math.inf] + [1.0] * 11, 0), (2007, [None] + [1.0] * 11, 0), (2008, [1.0, 2.0], 0)]
    rows += [(None, base[1], 1), (0, rows[0][1], rows[0][2]), (2010, [-0.0 if x == 0 else x for x in base[0]], 0), (2050, [1.0] * 12, 1)]
    return spark.createDataFrame([(*r, "k", 1) for r in rows], VECTORS)


def fine(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))


@pytest.mark.parametrize("block", [8, 1024])
def test_near_vectors(vectors, block, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "AT_ONCE", 10)
    rows = vectors.collect()
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a.label is not None and a.label == b.label and fine(a.embedding) and fine(b.embedding) and len(a.embedding) == len(b.embedding) and cosine(a.embedding, b.embedding) >= 0.98:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i].vec_id)
    want = []
    for i, r in enumerate(rows):
        ids = [v for v in groups[find(i)] if v is not None]
        component = min(ids) if ids else None
        want.append((r.vec_id, links[i], component, r.vec_id == component))
    got = [tuple(r) for r in embed_dedup.near_vectors(vectors).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(links) > 20
    assert embed_dedup.near_vectors(vectors.limit(0)).count() == 0


def test_cells_hold_all_that_is_near():
    rng = np.random.default_rng(14)
    x = rng.standard_normal((400, 5)) * 0.2
    tree = embed_dedup.Splits(x[:100], 5)
    depth = rng.integers(0, 6, 400)
    own, rows, cells = tree.cells(x, depth, 0.15)
    reached = set(zip(rows.tolist(), cells.tolist(), strict=True))
    assert all((k, c) in reached for k, c in enumerate(own.tolist())) and len(set(own[depth == 5].tolist())) > 16
    pairs = 0
    for i in range(400):
        for j in range(400):
            if depth[i] == depth[j] and np.linalg.norm(x[i] - x[j]) <= 0.15:
                pairs += i != j
                assert (i, own[j]) in reached
    assert pairs > 50 and len(reached) < 400 * 20


def test_reach_never_drops_a_pair():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((60, 32))
    b = np.vstack([a[:30] + 0.05 * rng.standard_normal((30, 32)), rng.standard_normal((30, 32))])
    q, _ = np.linalg.qr(rng.standard_normal((32, 32)))
    na, nb = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    i, j = embed_dedup.reach(a, b, na @ q, nb @ q, 0.9, False)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*np.nonzero(na @ nb.T >= 0.9), strict=True))


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(200, 260)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(900, k) for k in range(901, 990)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    found = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc")).collect()
    assert {r.node: r.root for r in found} == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "cc")).count() == 0


def test_nearest(vectors):
    rows = vectors.filter("vec_id IS NOT NULL").collect()
    keep = {(r.vec_id, tuple(r.embedding)): r for r in rows if fine(r.embedding)}.values()
    want = {}
    for q in keep:
        if q.vec_id % 50 == 0:
            other = [(-cosine(q.embedding, r.embedding), r.vec_id) for r in keep if r is not q and len(r.embedding) == len(q.embedding)]
            want[q.vec_id] = sorted((round(s, 9), v) for s, v in other)[:5]
    for shard_rows in (60, 10_000):  # with a share of 1 per tree every row is a candidate
        got = ann.nearest(vectors, F.col("vec_id") % 50 == 0, share=100.0, shard_rows=shard_rows).orderBy("query_id", "rank").collect()
        found = {}
        for r in got:
            found.setdefault(r.query_id, []).append((round(-r.score, 9), r.vec_id))
        assert found == want
    assert ann.nearest(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_forest_recall():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64))
    q = rng.choice(3000, 60, replace=False)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = n[q] @ n.T
    c[np.arange(60), q] = -2
    top = np.argsort(-c, axis=1)[:, :5]
    forest = ann.Forest(x)
    hit = sum(len(np.intersect1d(near, top[k])) for k, near in enumerate(forest.candidates(x[q], int(ann.CANDIDATES * 3000))))
    assert hit / 300 >= 0.9


def test_recall_of_the_query_through_shards(spark):
    rng = np.random.default_rng(16)
    x = rng.standard_normal((6000, 64)).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    q = np.arange(0, 6000, 50)
    n = x.astype(float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    c = n[q] @ n.T
    c[np.arange(len(q)), q] = -2
    top = {int(k): set(np.argsort(-row)[:5].tolist()) for k, row in zip(q, c, strict=True)}
    found = {}
    for r in ann.nearest(rows, F.col("vec_id") % 50 == 0, shard_rows=1500).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == pytest.approx(cosine(x[r.query_id], x[r.vec_id]), abs=1e-12)
    assert all(len(v) == 5 for v in found.values()) and set(found) == set(top)
    assert sum(len(found[k] & top[k]) for k in top) / (5 * len(top)) >= 0.9


def test_forest_prefixes_are_the_longest():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((200, 16))
    forest = ann.Forest(x, trees=1)
    strings = forest.hash(x, 0)
    for k, near in enumerate(forest.candidates(x[:20], 5)):
        common = [64 - int(int(strings[k]) ^ int(s)).bit_length() for s in strings]
        length = sorted(common, reverse=True)[4]
        assert set(near.tolist()) == {i for i, c in enumerate(common) if c >= length}


PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{}}</style><script>if(a<b)var t="</p>";</script></head><body class="x">
<header class="site-header"><a href="/">Site</a></header><nav><ul><li><a href="/1">one</a><li><a>two</a></ul></nav><div class="cookie-notice">We use cookies</div>
<!-- ad --><div class="ad">Buy {n}</div><article><h1>Title {n} &amp; more</h1><p>First <b>bold</b>
 text&nbsp;{n}.<p>Second<br>line &lt;{n}&gt;<div class="share">Share!</div><ul><li>item a<li>item {n}</ul><form><input name="q">go</form></article>
<section class="comments"><article><p>A comment {n}</p></article></section><aside>side</aside><footer>&copy; x</footer></body></html>"""


def test_pages(spark):
    rows = [(k, f"https://h{k % 2}.example.com/{k}", PAGE.format(n=k)) for k in range(10)]
    rows += [(20, None, "<p>no host</p>"), (21, "http://h0.example.com/x", None), (22, "bad url", ""), (None, "http://z.example/1", "plain &amp; simple"), (7, *rows[7][1:])]
    rows += [(23, "http://z.example/2", "<html><body><nav>menu</nav><p>body " + "long " * 40_000 + "</p></body></html>"), (24, "http://cut.example/", PAGE.format(n=24)[:900])]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, `_host.x` int")
    out = html_extract.main_text(pages)
    assert out.columns == ["page_id", "url", "html", "_host.x", "text", "n_chars"]
    got = {}
    for r in out.collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    for k in range(10):
        assert set(got[k]) == {f"Title {k} & more\nFirst bold text {k}.\nSecond line <{k}>\nitem a\nitem {k}"}
    assert len(got[7]) == 2 and got[21] == got[22] == [""] and got[20] == ["no host"] and got[None] == ["plain & simple"]
    assert len(got[23][0]) > 200_000 and "menu" not in got[23][0]
    assert got[24][0].startswith("Title 24 & more\nFirst bold text 24.")
    assert html_extract.main_text(pages.limit(0)).count() == 0


def texts_of(spark, htmls, url="http://h.example/"):
    pages = spark.createDataFrame([(k, None if url is None else url + str(k), h) for k, h in enumerate(htmls)], "page_id long, url string, html string")
    return [r.text for r in html_extract.main_text(pages).orderBy("page_id").collect()]


def test_copies_are_no_template(spark):
    copy = "<body><nav>menu {}</nav><p>The whole article.</p><p>Its end.</p></body>"
    other = "<body><p>Another text {}.</p></body>"
    for url in ("http://h.example/", None):
        for copies, others in ((2, 1), (2, 2), (3, 1), (4, 0), (5, 3)):
            got = texts_of(spark, [copy.format(k) for k in range(copies)] + [other.format(k) for k in range(others)], url)
            assert got == ["The whole article.\nIts end."] * copies + [f"Another text {k}." for k in range(others)]
    # versions of one text
    lines = [f"Paragraph {k}." for k in range(10)]
    versions = ["\n".join(f"Changed {v}." if k == v else x for k, x in enumerate(lines)) for v in range(4)]
    assert texts_of(spark, ["".join(f"<p>{x}" for x in v.split("\n")) for v in versions]) == versions


@pytest.mark.parametrize("n", [2, 3, 4, 9])
def test_template_text_is_dropped_on_hosts_of_any_size(spark, n):
    page = "<body><p>All about us</p><p>Body {0}.</p><ul><li>same<li>own {0}</ul></body>"
    assert texts_of(spark, [page.format(k) for k in range(n)]) == [f"Body {k}.\nsame\nown {k}" for k in range(n)]


def test_template_text_is_dropped_within_articles(spark):
    page = "<body><article><h1>Title {0}</h1><p>Body {0}.</p><p>Read our newsletter</p><p>More {0}.</p><p>All rights kept</p></article></body>"
    got = texts_of(spark, [page.format(k) for k in range(5)] + ["<article><p>Alone"])
    assert got == [f"Title {k}\nBody {k}.\nMore {k}." for k in range(5)] + ["Alone"]
    # a class that doesn't keep its order is no template's
    parts = ["<p>north</p><p>own {0}</p><p>south</p><p>x {0}</p>", "<p>south</p><p>own {0}</p><p>north</p><p>x {0}</p>"]
    got = texts_of(spark, ["<article>" + parts[k == 3].format(k) + "</article>" for k in range(5)])
    assert got == [("south\nown {0}\nnorth\nx {0}" if k == 3 else "north\nown {0}\nsouth\nx {0}").format(k) for k in range(5)]


def brute_template(htmls):
    """Path and texts of a host's template from whole occurrence vectors, page by page."""
    pages = {tuple(u.key for u in units): (units, elements) for units, elements in map(html_extract.parse, htmls) if units}
    pages = list(pages.values())
    n = len(pages)
    on = {}
    for k, (units, _) in enumerate(pages):
        for u in units:
            on.setdefault(u.key, [0] * n)[k] += 1
    classes = {}
    for key, vector in on.items():
        have = sum(v > 0 for v in vector)
        if have > 1 and 2 * have >= n:
            classes.setdefault(tuple(vector), []).append(key)
    texts = set()
    for keys in classes.values():
        orders = {tuple(dict.fromkeys(u.key for u in units if u.key in keys)) for units, _ in pages}
        if len(orders - {()}) == 1:
            texts |= set(keys)
    every = [u for units, _ in pages for u in units]
    paths = {p for _, e in pages for p in e}
    times = {p: [e[p].count for _, e in pages if p in e] for p in paths}
    once = {p for p, c in times.items() if 2 * len(c) >= n and 10 * sum(c) <= 11 * len(c)}
    parent = {p: e[p].parent for _, e in pages for p in e}
    named = {p for _, e in pages for p in e if e[p].article}

    def mass(p):
        return sum(u.weight * (1 if u.key in texts else 20) for u in every if p in u.chain)

    def above(p):
        while True:
            p = parent[p]
            if p in once:
                return p

    at = 0
    while True:
        best = None
        for p in sorted(once - {0}):
            if above(p) == at and mass(p) > 0 and (at not in named or p in named):
                w = mass(p) * (html_extract.NAMED if p in named else 1)
                if w >= html_extract.ENTER * (w + mass(at) - mass(p)):
                    best = max(best or (0, 0), (w, p))
        if best is None:
            break
        at = best[1]
    room = sum(1 for u in every if at in u.chain)
    share, gone = 0, {k for k in texts if not any(u.key == k and at in u.chain for u in every)}
    for vector, keys in sorted(classes.items(), key=lambda c: -sum(v > 0 for v in c[0])):
        enough = sum(v > 0 for v in vector) >= min(n, html_extract.LEAST_ON)
        inside = [k for k in keys if enough and k in texts and any(u.key == k and at in u.chain for u in every)]
        share += sum(vector) * len(inside) / room
        if share <= 0.5:
            gone |= set(inside)
    return at, gone


def scrambled(page, names):
    """The page with nothing but div elements of meaningless classes where it has names."""
    page = re.sub(r"<(nav|article|footer|header|section|aside|main)\b[^>]*>", lambda m: f'<div class="{names[m[1]]}">', page)
    page = re.sub(r"</(nav|article|footer|header|section|aside|main)\s*>", "</div>", page)
    return page.replace('class="ad"', f'class="{names["ad"]}"')


def test_templates_against_brute_force(spark):
    """Real pages and pages whose elements are all div, by whole vectors; the article comes out of both."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [r for r in table.collect() if r.url]
    hosts = {r.url: r.host for r in table.select("url", html_extract.host().alias("host")).collect()}
    names = {"nav": "x81", "article": "x7", "footer": "x33", "header": "x4", "section": "x95", "aside": "x12", "main": "x60", "ad": "x48"}
    plain = [(r.page_id, r.url, scrambled(r.html, names)) for r in rows]
    for pages in (rows, plain):
        by_host = {}
        for _, url, page in pages:
            by_host.setdefault(hosts[url], []).append(page)
        frame = spark.createDataFrame([tuple(r) for r in pages], "page_id long, url string, html string")
        found = {r.host: json.loads(r.template) for r in html_extract.templates(frame).collect()}
        assert set(found) == set(by_host)
        for host, htmls in by_host.items():
            at, gone = brute_template(htmls)
            assert found[host]["path"][-1] == at, host
            assert {t for _, slot in found[host]["slots"] for t in slot} == gone, host
    known = {r.page_id: r.text for r in html_extract.main_text(table).collect()}
    got = {r.page_id: r.text for r in html_extract.main_text(frame).collect()}
    large = {h for h, pages in by_host.items() if len(pages) >= 4}
    same = [got[i] == known[i] for i, url, _ in plain if hosts[url] in large]
    assert len(same) > 100 and all(same)
    nothing = html_extract.Template(None)
    assert all(html_extract.extract(r.html, nothing) != known[r.page_id] for r in rows)


def test_slots_without_names(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    page = (
        '<div class="k1"><div class="k2"><a href="/">Home</a> <a href="/x">{l}</a></div><div class="k3"><div class="k4">{t}</div><div>{a}</div><div>{b}</div></div>'
        '<div class="k5">Same words here</div></div>'
    )
    parts = [dict(l=prose(3), t=prose(4), a=prose(60), b=prose(50)) for _ in range(6)]
    assert texts_of(spark, [page.format(**p) for p in parts]) == ["{t}\n{a}\n{b}".format(**p) for p in parts]
    # doubled rows change nothing
    assert texts_of(spark, [page.format(**p) for p in parts for _ in (0, 1)]) == ["{t}\n{a}\n{b}".format(**p) for p in parts for _ in (0, 1)]
    # a teaser in an article element beside a body in a plain div
    page = '<body><article><p>{l}</p></article><div class="body"><h1>{t}</h1><p>{a}</p><p>{b}</p></div></body>'
    assert texts_of(spark, [page.format(**p) for p in parts]) == ["{t}\n{a}\n{b}".format(**p) for p in parts]
    # a page of another kind on the host is its own template
    other = "<body><main><h1>Other</h1><p>Its own words.</p></main><footer>foot</footer></body>"
    assert texts_of(spark, [page.format(**p) for p in parts] + [other])[-1] == "Other\nIts own words."


def test_marks_within_articles(spark):
    inside = (
        '<p class="alert">Mind this {0}.</p><div class="related-work"><p>Others {0}.</p></div><section class="side-effects"><p>Effects {0}.</p></section>'
        '<div class="ad-slot">Buy {0}</div><div class="share-buttons">Share {0}</div><section class="comments"><p>Me too {0}</p></section><aside>Aside {0}</aside>'
        '<p>End <span class="share">tweet {0}</span>{0}.</p>'
    )
    page = "<body><article><h1>Title {0}</h1><p>Body {0}.</p>" + inside + "</article></body>"
    for n in (1, 5):
        got = texts_of(spark, [page.format(k) for k in range(n)])
        assert got == [f"Title {k}\nBody {k}.\nMind this {k}.\nOthers {k}.\nEffects {k}.\nEnd {k}." for k in range(n)]


def test_template_classes():
    # vector, place, token, pages, times, kind, path, weight, units
    members = [
        (1, 0.0, 0, 4, 4, 1, 0, 1000, 40), (1, 0.0, 10, 4, 4, 1, 0, 900, 30), (1, 0.5, 11, 4, 4, 1, 0, 100, 8), (2, 0.2, 12, 4, 12, 1, 10, 600, 12),
        (1, 0.1, 50, 4, 4, 0, 10, 80, 4), (1, 0.6, 51, 4, 4, 0, 11, 90, 4), (3, 0.7, 52, 3, 3, 0, 10, 30, 3),
    ]
    assert html_extract.nest(members, 4) == {"pages": 4, "path": [0, 10], "named": False, "slots": [[10, [50, 52]], [11, [51]]]}


def test_hosts(spark):
    urls = ["HTTPS://u@A.example:80/x", None, "x/y", "\u00a0http://b.example/", " http://c.example"]
    got = spark.createDataFrame(list(enumerate(urls)), "i int, url string").orderBy("i").select(html_extract.host()).collect()
    assert [r[0] for r in got] == ["a.example", "", "", "", "c.example"]


def test_quoted_paragraph_of_a_small_host(spark):
    page = "<body><div class='k1'>Menu of all</div><article><h1>Title {0}</h1><p>{1}</p>{2}<p>{3}</p><p>Notice of all.</p></article><div class='k2'>Foot of all</div></body>"
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    parts = [(k, prose(60), "<p>A saying that two articles quote.</p>" if k else "", prose(50)) for k in range(3)]
    want = [f"Title {k}\n{a}\n" + ("A saying that two articles quote.\n" if q else "") + b for k, a, q, b in parts]
    assert texts_of(spark, [page.format(*p) for p in parts]) == want
    # one reading of an address finds one host: with a blank that is none of a host's pages, menu and foot still go
    assert texts_of(spark, [page.format(*p) for p in parts], "\u00a0http://h.example/") == want


def test_vectors_of_occurrences_ignore_order(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    one = {r.host: r.template for r in html_extract.templates(pages).collect()}
    two = {r.host: r.template for r in html_extract.templates(pages.repartition(7)).collect()}
    assert one == two and len(one) > 3
