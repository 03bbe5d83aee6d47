"""The ten operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html import unescape
from itertools import combinations, product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skeinworks.llm import chat, components, html, langid, media, mixing, ngram_join, packing, queries, substring, tokens, topk

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, token string"


def corpus():
    r = random.Random(5)
    words = ["w%d" % i for i in range(400)] + ["é", "ß", "Ab", "aB", "x\x1cy"]
    texts = [" ".join(r.choices(words, k=r.randint(1, 120))) for _ in range(60)]
    passage = " ".join(r.choices(words, k=60))
    for i in range(0, 60, 4):
        texts[i] += "\n" + passage
    base = r.choices(words, k=150)
    for _ in range(30):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(150)] = r.choice(words)
        texts.append(" ".join(w))
    texts += [texts[3], texts[3].upper(), None, "", "a", "a", "a b c", "A  b\tC", "a b " * 100, "z " * 5000, " \n ", "<|endoftext|> q <|im_end|>", "1 2 3", "x" * 3000]
    return list(enumerate(texts, 100))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    return spark.createDataFrame([(i, t, r.choice(["en", "fr", None]), r.choice(["s1", "s2", "s3", None, "s\U0001f600"]), len(t or ""), "k", 1, "t") for i, t in corpus()], DOC).repartition(5)


def words(t):
    return (t or "").encode().split()


def test_top_k(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-0.5, 0.5) for _ in range(8)], "x") for i in range(300)]
    rows += [(300, rows[20][1], "x"), (301, rows[20][1], "x"), (302, None, "x"), (303, [1.0, None] * 4, "x"), (304, [float("nan")] * 8, "x"), (305, [float("inf")] * 8, "x"), (306, rows[0][1], "x"), (306, rows[0][1], "x")]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    v = {i: [int(np.floor(64 * c)) for c in x] for i, x, _ in rows if x and all(c is not None and np.isfinite(c) for c in x)}
    got = defaultdict(list)
    for x in topk.top_k(e, lambda c: c % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    want = {q: sorted(((i, int(np.dot(v[q], v[i]))) for i in v if i != q), key=lambda p: (-p[1], p[0]))[:20] for q in v if q % 20 == 0}
    assert dict(got) == want
    assert topk.top_k(e.limit(0), lambda c: c % 20 == 0).count() == 0
    assert topk.top_k(e.filter("vec_id IN (0, 20, 1)"), lambda c: c % 20 == 0).count() == 4


def test_nra_stops_early_and_stays_exact():
    """Vectors with and without structure, of any size and sign; with a floor and without."""
    r = np.random.default_rng(0)
    for n, dim, spread, heads in ((2000, 16, 4, 30), (3000, 32, 40, 0), (50, 8, 3, 0), (600, 1, 9, 0), (2000, 24, 1 << 40, 5)):
        x = r.integers(-spread, spread + 1, (n, dim))
        x[:heads] += 10 * spread
        q, ids = r.integers(-9, 10, (5, dim)), r.permutation(n)
        full = q @ x.T
        for floor in (None, np.sort(full, axis=1)[:, max(0, n - 40)]):
            a, b, s, read = topk.nra(q, np.array([-1, 3, 7, -1, 9]), x, ids, 20, floor)
            keep = topk.best(a, ids[b], s, 20)
            for k, own in enumerate([-1, 3, 7, -1, 9]):
                want = [i for i in np.lexsort((ids, -full[k])) if ids[i] != own][:20]
                assert [tuple(p) for p in zip(b[keep][a[keep] == k], s[keep][a[keep] == k])] == [(i, full[k][i]) for i in want]
            assert (read <= n * dim).all()


def test_nra_reads_little_where_vectors_stand_out():
    """A few long vectors among many short ones: lists are left near their tops, and no entry is read but in list order."""
    r = np.random.default_rng(3)
    x = r.integers(-2, 3, (5000, 32))
    x[:25] += r.integers(40, 80, (25, 32))
    q = r.integers(1, 10, (4, 32))
    a, b, s, read = topk.nra(q, np.full(4, -1), x, np.arange(5000), 20)
    assert read.max() < 0.11 * x.size
    keep = topk.best(a, b, s, 20)
    for j in range(4):
        assert b[keep][a[keep] == j].tolist() == np.lexsort((np.arange(5000), -(x @ q[j])))[:20].tolist()
    negative = topk.nra(-q, np.full(4, -1), x, np.arange(5000), 20)
    assert negative[3].max() <= x.size and topk.nra(q * 0, np.full(4, -1), x, np.arange(5000), 20)[3].max() == 0


def test_top_k_leaves_a_part_of_the_lists_unread(spark):
    """On the driver's embeddings, which have no structure, bounds part late: nearly all entries are read, and 95 % where a task has all rows in one segment."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    share = [x["share"] for x in topk.read_share(e, lambda c: c % 20 == 0).collect()]
    assert len(share) == 100 and np.mean(share) < 1 and max(share) <= 1


def test_ngram_join(spark, docs):
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
    s = {}
    for i, t in corpus():
        w = low(t)
        s[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert got == {i: (len(s[i]), find(i)) for i in s} and len({c for _, c in got.values()}) < len(s)
    assert ngram_join.ngram_jaccard_join(docs.limit(0)).count() == 0
    twice = ngram_join.ngram_jaccard_join(docs.union(docs))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in twice.collect()} == got


def test_ngram_join_deals_hot_tokens(spark, monkeypatch):
    """Half of every text is one of three boilerplates: the same components with hot tokens from 2 and from 10 ** 6 sets on, equal to brute force."""
    r = random.Random(7)
    parts = [[f"b{k}-{i}" for i in range(30)] for k in range(3)]
    rows = []
    for i in range(240):
        own = [f"o{i // 4}-{j}" for j in range(40)]
        for _ in range(r.randint(0, 3)):
            own[r.randrange(40)] = f"x{r.random()}"
        rows.append((i, " ".join(parts[i % 3] + own)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    s = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    comp = {i: i for i in s}
    for _ in range(4):
        for i in s:
            comp[i] = min(comp[j] for j in s if 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]))
    for hot in (2, 10**6):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        monkeypatch.setattr(ngram_join, "FLUSH", 900)
        got = {x["doc_id"]: x["component_id"] for x in ngram_join.ngram_jaccard_join(d).collect()}
        assert got == comp, hot
    assert 1 < len(set(comp.values())) < 240


def test_orders_meet_for_every_pair_in_reach():
    r = np.random.default_rng(4)
    for _ in range(400):
        n = int(r.integers(1, 120))
        x = r.choice(1 << 20, n, replace=False).astype(np.uint64)
        y = np.unique(np.concatenate([x[r.random(n) < r.uniform(0.8, 1)], r.choice(1 << 20, int(r.integers(0, 1 + n // 6)), replace=False).astype(np.uint64)]))
        both = np.intersect1d(x, y).size
        if len(y) and 100 * both >= 75 * (n + len(y) - both):
            assert ngram_join.orders_meet(ngram_join.signature(x, 75), ngram_join.signature(y, 75))
    assert not ngram_join.orders_meet(ngram_join.signature(np.arange(40, dtype=np.uint64), 75), ngram_join.signature(np.arange(40, 80, dtype=np.uint64), 75))


@pytest.mark.parametrize("n", [40, 120, 130, 500, 2000, 8000])
def test_orders_reject_pairs_that_meet_by_chance(n):
    """Planted pairs share three rare tokens, which order one puts into both prefixes. About two thirds of them fail under the other orders, short sets and long ones; sets that share none nearly all do."""
    r = np.random.default_rng(n)
    shared, apart, tries = 0, 0, 60
    for _ in range(tries):
        t = r.integers(1, 1 << 63, 2 * n, dtype=np.uint64)
        x, y, z = np.unique(t[:n]), np.unique(np.append(t[n:-3], t[:3])), np.unique(t[n:])
        a, b, c = (ngram_join.signature(v, 75) for v in (x, y, z))
        shared += not ngram_join.orders_meet(a, b)
        apart += not ngram_join.orders_meet(a, c)
    assert shared >= 0.45 * tries and apart >= 0.97 * tries


def test_signatures_of_two_widths_meet():
    """A set of just over the narrow width's size and its near copy just below it."""
    r = np.random.default_rng(9)
    for _ in range(50):
        x = r.integers(1, 1 << 63, 130, dtype=np.uint64)
        a, b = ngram_join.signature(np.unique(x), 75), ngram_join.signature(np.unique(x[:118]), 75)
        assert ngram_join.orders_meet(a, b) and ngram_join.orders_meet(b, a)
        other = ngram_join.signature(np.unique(r.integers(1, 1 << 63, 118, dtype=np.uint64)), 75)
        assert not ngram_join.orders_meet(a, other)
    assert len(a) != len(b)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (5, 5), (200, 202)]
    got = {r["id"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(41), 100]} | {i: 200 for i in (200, 201, 202)}


def encoded():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in corpus()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, docs):
    ids = encoded()
    got = packing.pack(docs, queries.tokenizer(), seq_len=64).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert set(by) == set(ids)
    for i, p in by.items():
        full, at = ids[i] + [2], 0
        assert len(p) == 1 or len(full) > 64
        for k, r in enumerate(sorted(p, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, crc(full[at : at + r["length"]])) and (k == 0 or r["length"] == 64)
            at += r["length"]
        assert at == len(full)
    seq = defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in seq.values():
        p.sort()
        assert all(o == sum(n for _, n in p[:k]) for k, (o, _) in enumerate(p)) and sum(n for _, n in p) <= 64
    assert len(seq) <= 1.1 * sum(r["length"] for r in got) / 64 + 2
    assert packing.pack(docs.limit(0), queries.tokenizer()).count() == 0


def test_plan_uses_every_piece():
    h = np.bincount(np.random.default_rng(1).integers(1, 129, 5000), minlength=129)
    used = np.zeros(129, int)
    for lengths, n in packing.plan_packing(h, 128):
        assert sum(lengths) <= 128
        for x in lengths:
            used[x] += n
    assert (used == h).all()


PAGE = "<html><head><title>T</title><script>var a='</p>'</script></head><body><nav><a href=x>m</a></nav><header>Site</header><div class='ad'>Buy</div>%s<div id=comments><p>First!</p></div><footer>&copy;</footer></body></html>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), (PAGE % "<article><h1>Head</h1><p><b>One\n two.<br><p>Th&eacute; third.</article>", "Head\nOne two.\nThé third."),
        (PAGE % "<div><p>Some words here, rather long.</p><p>More words.</p></div>", "Some words here, rather long.\nMore words."), ("<p>cut off in a <b>tag", "cut off in a tag"), (PAGE % "", ""), ("<!-- only -->", ""),
    ],
)
def test_html(page, text):
    assert html.main_text(page) == text


ONE, TWO = ("Some plain words of an article. " * 6).strip(), ("Other words that follow on them. " * 6).strip()


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        ("<div class='layout-with-sidebar'><h1>Head</h1><p>{0}</p><p>{1}</p></div>", ["Head", ONE, TWO]),
        ("<div class='elementor-widget'><h1>Head</h1><p>{0}</p><p>{1}</p></div>", ["Head", ONE, TWO]),
        ("<div class='sidebar-right'><article><p>{0}</p></article><div class='left-sidebar'>Else</div></div>", [ONE]),
        ("<div class='widget'><p>{0}</p><p>{1}</p></div>", [ONE, TWO]),
        ("<article><p>{0}</p><section id='header-files'><h2 id='related-work'>Related work</h2><p>{1}</p></section></article>", [ONE, "Related work", TWO]),
        ("<article><p>{0}</p><section id='search'><h2 class='header'>Search</h2><p>{1}</p></section><div class='share-buttons'>Send</div></article>", [ONE, "Search", TWO]),
        ("<form id='aspnetForm'><div class='menu'>Home</div><p>{0}</p><p>{1}</p></form>", [ONE, TWO]),
        ("<div><p>{0}</p><p>{1}</p><form><p>Your mail</p></form></div><div class='site-footer'>Us</div><div id='ad-12'>Buy</div>", [ONE, TWO]),
        ("<article><p>{0}</p></article><div id='comments'><article><p>{1}</p><p>{1}</p></article></div>", [ONE]),
        ("<div id='text'><p>{0}</p></div><div class='comments-area'><p>{1}</p><p>{1}</p></div>", [ONE]),
    ],
)
def test_html_marks(page, lines):
    assert html.main_text("<body>" + page.format(ONE, TWO) + "</body>").split("\n") == lines


LEAD, LONG, SHORT = "A lead of a few words. " * 6, "<p>" + "A long row of plain words. " * 9 + "</p>", "<p>" + "Only a short row of words. " * 4 + "</p>"
LINKS = "<ul>" + "<li><a href=x>Another page</a></li>" * 8 + "</ul>"


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        ("<article><h1>A title of the text</h1><p>{lead}</p><div>{long}</div></article>", ["A title of the text", "{lead}", *["{long}"] * 5]),
        ("<article><h1>Title</h1><section>{long}</section><section><h2>Part</h2>{short}</section></article>", ["Title", *["{long}"] * 5, "Part", *["{short}"] * 4]),
        ("<main><h1>Title</h1><p>{lead}</p><article>{long}</article></main>", ["Title", "{lead}", *["{long}"] * 5]),
        ("<h1>Title</h1><article>{long}</article>{links}", ["Title", *["{long}"] * 5]),
        ("<div>{links}</div><div><h1><a href=x>Title</a></h1><p>{lead}</p><div>{long}</div></div>", ["Title", "{lead}", *["{long}"] * 5]),
        ("<div><h1>Title</h1><div>{long}</div><div><h2>Part</h2>{short}</div></div>", ["Title", *["{long}"] * 5, "Part", *["{short}"] * 4]),
        ("<h1>Title</h1>Some bare <a href=x>lead</a> words.<div><div>{long}</div></div><a href=x>Up</a>", ["Title", "Some bare lead words.", *["{long}"] * 5]),
        ("<div role=main><h1>Title</h1><div>{long}</div><ul><li><a href=x>A source</a></li></ul></div>{links}", ["Title", *["{long}"] * 5, "A source"]),
        ("<div><article>{long}</article></div><div>{links}</div>", ["{long}"] * 5),
    ],
)
def test_html_keeps_whole_article(page, lines):
    text = {"lead": LEAD.strip(), "long": re.sub("</?p>", "", LONG).strip(), "short": re.sub("</?p>", "", SHORT).strip()}
    page = page.format(lead=LEAD, long=LONG * 5, short=SHORT * 4, links=LINKS)
    assert html.main_text("<body><nav>Menu</nav>" + page + "</body>").split("\n") == [x.format(**text) for x in lines]


def article_of(page):
    """The text of a driver page's article, by its known shape: blocks are h1 and p."""
    parts = re.split("</?(?:h1|p)[^>]*>", re.search("<article>(.*)</article>", page, re.S)[1])
    lines = [" ".join(unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n".join(x for x in lines if x)


def test_html_finds_the_article_by_density_alone(monkeypatch):
    """Without any name of a part (class, nav, footer) most of the driver's pages give the same texts, and without names and densities none does."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    want = pages.map(article_of)
    assert (pages.map(html.main_text) == want).all()
    monkeypatch.setattr(html, "MARKS", frozenset())
    monkeypatch.setattr(html, "ASIDE", frozenset())
    assert (pages.map(html.main_text) == want).mean() > 0.85
    of = html.densities

    def flat(tree):
        density, total, c, lc = of(tree)
        return [1.0] * len(density), [float(k == tree.body) for k in range(len(total))], c, lc

    monkeypatch.setattr(html, "densities", flat)
    assert (pages.map(html.main_text) != want).all()


def slow_densities(tree):
    """Composite densities node by node, each from its own subtree."""
    n = len(tree.tag)
    under = [{k} for k in range(n)]
    for k in range(n - 1, 0, -1):
        under[tree.parent[k]] |= under[k]
    linked = [any(tree.tag[j] == "a" for j in range(n) if k in under[j]) for k in range(n)]

    def sums(k):
        text = [(j, len("".join(s.split()))) for j, _, s in tree.texts if j in under[k]]
        tags = [j for j in under[k] - {k}]
        return sum(m for _, m in text), len(tags), sum(m for j, m in text if linked[j]), sum(tree.tag[j] == "a" for j in tags)

    body_c, _, body_lc, _ = sums(tree.body)
    out = []
    for k in range(n):
        c, t, lc, lt = sums(k)
        base = math.log(c / max(1, c - lc) * lc + body_lc / max(1, body_c) * c + math.e)
        ratio = max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))
        # The published base is itself a logarithm; on a page without link text it is 1, which no logarithm has.
        out.append(c / max(1, t) * (math.log(ratio, base) if base > 1 + 1e-9 else math.log(ratio + 1)) if c else 0.0)
    return out


def test_html_densities_by_brute_force():
    r = random.Random(9)

    def made(depth):
        if depth == 0 or r.random() < 0.3:
            return "word " * r.randint(0, 9)
        tag = r.choice(["div", "p", "a", "b", "li", "section"])
        return f"<{tag}>" + "".join(made(depth - 1) for _ in range(r.randint(1, 4))) + f"</{tag}>"

    for _ in range(60):
        tree = html.Tree("<body>" + made(5) + "</body>")
        density, total, _, _ = html.densities(tree)
        want = slow_densities(tree)
        assert density == pytest.approx(want)
        for k in range(len(want)):
            assert total[k] == pytest.approx(sum(want[j] for j in range(1, len(want)) if tree.parent[j] == k and tree.tag[j] in html.BLOCK))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p class='x' don't>Hello there</p>", "Hello there"),
        ("<article><p>A formula <math><mi>x</mi></math> here.</p></article>", "A formula x here."),
        ("<header><h1>A title</h1></header><article><p>" + ONE + "</p></article>", "A title\n" + ONE),
        ("<article><p>" + ONE + "</p><section class='related-work'><h2 id='search'>Part</h2><p>Else.</p></section></article>", ONE + "\nPart\nElse."),
        ("<nav><a href=x>Menu</a></nav><article><p>" + ONE + "</p><div class='ad'>Buy</div></article><aside><p>Beside</p></aside>", ONE),
    ],
)
def test_html_odd_markup(page, text):
    assert html.main_text("<body>" + page + "</body>") == text


def test_html_deep_pages_take_linear_time():
    n = 50_000
    began = time.perf_counter()
    for page in ("<div>" * n + "text", "<div>" * n + "<li>x" * n, "<p>a</x>" * n, "<span>" * n + "</b>" * n, "<a =\"" * n):
        html.main_text(page)
    assert time.perf_counter() - began < 30


def test_html_columns(spark):
    p = spark.createDataFrame([(1, "u", "<p>é x</p>", "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    assert [(r["text"], r["n_chars"]) for r in html.extract(p).orderBy("page_id").collect()] == [("é x", 3), ("", 0)]


def test_chat_round_trip(spark):
    odd = ["", "\\", "<|", "<\\|", "\\\\<|im_end|>\n", "<\\n>", "a<", "|>", "<|im_start|>user\nhi"]
    rows = [("t", i, i - 1, "assistant" if i % 2 else "us\ner<|", x, 1.0) for i, x in enumerate(odd)] + [("t", 20, 3, "assistant", None, 5.0), ("u", 0, None, None, "solo", None)]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    f = chat.format_trees(m)
    got = {(r["tree"], r["branch"]): r for r in f.select("tree", "branch", "score", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("lost")).collect()}
    assert set(got) == {("t", 1), ("t", 2), ("u", 1)}
    whole, short = (got["t", 1], got["t", 2]) if got["t", 1]["score"] == 9.0 and len(got["t", 1]["turns"]) == 9 else (got["t", 2], got["t", 1])
    assert [(t["role"], t["text"]) for t in whole["turns"]] == [(r[3], r[4]) for r in rows[:9]]
    assert whole["lost"] == "".join(x for i, x in enumerate(odd) if i % 2)
    assert [t["text"] for t in short["turns"]] == [*odd[:4], ""]
    assert chat.format_trees(m, branches=1).count() == 2 and chat.format_trees(m.limit(0)).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        chat.format_trees(spark.createDataFrame([("t", 1, 2, "a", "x", 0.0), ("t", 2, 1, "a", "x", 0.0), ("t", 3, 1, "a", "x", 0.0)], m.schema))


def test_token_files(spark, docs):
    ids = encoded()
    got = tokens.read_tokens(*tokens.write_tokens(docs, queries.tokenizer(), shards=3, block=500), keep_ids=True).orderBy("doc_id").collect()
    at = 0
    assert [r["doc_id"] for r in got] == sorted(ids)
    for r in got:
        full = ids[r["doc_id"]] + [0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (at, len(full), crc(full), full)
        at += len(full)
    assert tokens.read_tokens(*tokens.write_tokens(docs.limit(0), queries.tokenizer())).count() == 0


def test_rank_coding():
    r = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        x = np.array([r.integers(0, 1 << int(r.integers(1, 33))) for _ in range(n)], np.uint32)
        assert (tokens.decode_ranks(*tokens.encode_ranks(x), n) == x).all()


def test_media(spark, docs, tmp_path):
    got = {r["doc_id"]: r for r in media.media_columns(docs).collect()}
    assert len(got) == len(corpus())
    for i, t in corpus():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["error"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), None)
    assert media.media_columns(docs.limit(0)).count() == 0


def test_media_damage_costs_one_member(spark, docs, tmp_path):
    path = media.write_archives(docs.coalesce(1).limit(20), f"file://{tmp_path}/m")
    name = next((tmp_path / "m").glob("*.zip"))
    data = bytearray(name.read_bytes())
    data[60] ^= 255
    name.write_bytes(data)
    rows = spark.read.format("archive_members").option("path", path).option("rangeBytes", 700).load().collect() if media.read_archives(spark, path) else []
    assert len(rows) == 20 and sum(r["error"] is not None for r in rows) == 1


def test_substrings(spark, docs):
    w = {i: words(t) for i, t in corpus()}
    for window in (35, 3):
        c = Counter(tuple(x[k : k + window]) for x in w.values() for k in range(len(x) - window + 1))
        got = {r["doc_id"]: r for r in substring.substring_dedup(docs, window=window).collect()}
        removed = 0
        for i, x in w.items():
            gone = [False] * len(x)
            for k in range(len(x) - window + 1):
                if c[tuple(x[k : k + window])] > 1:
                    gone[k : k + window] = [True] * window
            assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"].encode()) == (len(x), sum(gone), b" ".join(a for a, g in zip(x, gone) if not g)), (i, window)
            removed += sum(gone)
        assert removed
    assert substring.substring_dedup(docs.limit(0)).count() == 0


def test_sketch_estimates_are_never_below_and_rarely_above(monkeypatch):
    """Cells of four times as many anchors as a shard is meant to have: none that repeats is missed, at least nine tenths of the rest are filtered."""
    r = np.random.default_rng(6)
    for n in (10, 1000, 4 * substring.ANCHORS):
        once = r.integers(0, 1 << 32, n, np.uint32)
        once[: n // 5] = once[n // 5 : 2 * (n // 5)]
        more = r.integers(0, 1 << 32, n // 10, np.uint32)
        more[: n // 20] = once[-(n // 20) :] if n >= 20 else more[: n // 20]
        c = Counter(once.tolist())
        truth = np.array([c[x] > 1 for x in once.tolist()]) | np.isin(once, more)
        met = substring.sketch.repeated(once, more)
        assert met[truth].all() and met[~truth].mean() < 0.1


@pytest.mark.parametrize("anchors", [64, 1 << 18])
def test_substrings_in_many_shards(spark, monkeypatch, anchors):
    """The result doesn't depend on the number of shards, and few windows that occur once pass the prefilter."""
    monkeypatch.setattr(substring, "ANCHORS", anchors)
    monkeypatch.setattr(substring, "FLUSH", 2000)
    r = random.Random(8)
    passage = [f"p{i}" for i in range(50)]
    rows = [(i, " ".join([f"{i}-{j}" for j in range(r.randint(0, 300))] + (passage if i % 3 == 0 else []) + [f"{i}+{j}" for j in range(40)])) for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substring.substring_dedup(d).collect()}
    assert got == {i: (len(t.split()), 50 if i % 3 == 0 else 0) for i, t in rows}
    found = substring.estimated(d.withColumn("__row", F.col("doc_id")), 35, max(4, 200 // anchors), 4).collect()
    places = sum(int(np.frombuffer(x["__n"], np.uint16).sum()) for x in found)
    assert 50 * 16 <= places < 50 * 16 + 0.2 * sum(len(t.split()) for _, t in rows)


def test_substrings_of_a_long_text(spark):
    """Over 2 ** 20 words, a passage at both ends, ids null and repeated, and a window of over 65,535 words."""
    w = [f"{i:x}" for i in range((1 << 20) + 50_000)]
    long = " ".join(w + w[:100])
    d = spark.createDataFrame([(None, long, 1), (None, "a b", 2), (7, "c " * 80, 3), (7, "d", 4)], "doc_id long, text string, kept long")
    got = sorted((x["n_words"], x["n_removed"], len(x["kept"])) for x in substring.substring_dedup(d).collect())
    assert got == [(1, 0, 1), (2, 0, 3), (80, 80, 0), (len(w) + 100, 200, len(" ".join(w[100:])))]
    big = spark.createDataFrame([(1, " ".join(w[:70_000])), (2, "x " + " ".join(w[:70_000]))], "doc_id long, text string")
    assert [(x["n_removed"], x["kept"]) for x in substring.substring_dedup(big, window=66_000).orderBy("doc_id").collect()] == [(70_000, ""), (70_000, "x")]


def test_mixing(spark, docs):
    d = docs.select("doc_id", "source", mixing.word_count("text").alias("size"))
    run = lambda: {r["doc_id"]: r for r in mixing.mix(d, F.array("source"), F.col("size")).collect()}
    got = run()
    assert {i: r["size"] for i, r in got.items()} == {i: len(words(t)) for i, t in corpus()}
    assert {i: r["taken"] for i, r in run().items()} == {i: r["taken"] for i, r in got.items()}
    by = defaultdict(list)
    for r in got.values():
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    assert abs(sum(p[0]["target"] for p in by.values()) - sum(r["size"] for r in got.values())) < 1e-6
    for p in by.values():
        assert p[0]["source_size"] == sum(r["size"] for r in p) and p[0]["target"] <= 3 * p[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in p) - p[0]["target"]) <= max(r["size"] for r in p) / 2 + 1
    assert mixing.mix(d.limit(0), F.array("source"), F.col("size")).count() == 0


def test_flow_spreads_repetition():
    got = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 20})
    assert sum(got.values()) == 40 and max(got.values()) <= 20
    assert mixing.targets({"a": 1, "b": 99}, {"a": 1, "b": 1}) == {"a": 3.0, "b": 97.0}


def cheapest(patterns, quota, most):
    """(words, least cost) of the largest flow, by trying every amount of every pattern and every way to fill quotas."""
    names = list(patterns)
    best = (0, 0)
    for give in product(*(range(most * patterns[p] + 1) for p in names)):
        fits = all(sum(g for p, g in zip(names, give) if set(p) <= set(some)) <= sum(quota[s] for s in some) for k in range(1, len(quota) + 1) for some in combinations(quota, k))
        cost = sum(sum(min(max(g - k * patterns[p], 0), patterns[p]) * k for k in range(most)) for p, g in zip(names, give))
        if fits and (sum(give), -cost) > (best[0], -best[1]):
            best = (sum(give), cost)
    return best


def test_flow_is_the_cheapest_of_the_largest():
    r = random.Random(3)
    for _ in range(40):
        patterns = {p: r.randint(0, 4) for p in r.sample([("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "b", "c")], 3)}
        quota = {s: r.randint(0, 9) for s in "abc"}
        times = mixing.flow(patterns, quota, 2)
        assert all(t == sorted(t, reverse=True) and max(t, default=0) <= patterns[p] for p, t in times.items())
        assert (sum(map(sum, times.values())), sum(k * x for t in times.values() for k, x in enumerate(t))) == cheapest(patterns, quota, 2)


def test_flow_of_many_patterns_is_fast():
    r = random.Random(5)
    patterns = {tuple(sorted(r.sample(range(200), 3))): r.randint(1, 1000) for _ in range(20_000)}
    total = sum(patterns.values())
    began = time.perf_counter()
    got = mixing.route(patterns, dict.fromkeys(range(200), total // 200))
    assert sum(got.values()) >= 0.99 * total and time.perf_counter() - began < 60


def test_mixing_by_hand_and_in_fine_buckets(spark, monkeypatch):
    """Weights 1, 2, 3 by code point, null last; the edge's bucket cut twice gives the same words within a document."""
    rows = [(i, s, 5) for i, s in enumerate(["b"] * 40 + ["a"] * 40 + ["\U0001f600"] * 4 + [None] * 40 + ["\uffff"] * 40)]
    d = spark.createDataFrame(rows, "doc_id long, source string, size long")
    # a 1, b 2, \uffff 3, the emoji 1, null 2 of 9 shares; the emoji stops at three times its 20 words.
    left = (820 - 60) / 8
    want = {"a": left, "b": 2 * left, "\uffff": 3 * left, "\U0001f600": 60.0, None: 2 * left}
    for edge, buckets in ((100_000, 4096), (0, 2)):
        monkeypatch.setattr(mixing, "EDGE", edge)
        monkeypatch.setattr(mixing, "BUCKETS", buckets)
        got = mixing.mix(d, F.array("source"), F.col("size")).collect()
        assert len(got) == len(rows) and {r["source"]: r["target"] for r in got} == pytest.approx(want)
        for s, t in want.items():
            assert abs(sum(r["taken"] for r in got if r["source"] == s) - t) <= 3.5


def test_single_sources_are_routed_by_the_flow(monkeypatch):
    seen, flow = [], mixing.flow
    monkeypatch.setattr(mixing, "flow", lambda g, *a: seen.append(set(g)) or flow(g, *a))
    sizes = {("a",): 10, ("b",): 10, (None,): 7, ("c",): 0, ("d", "e"): 5, ("e",): 5, **{(i,): 3 for i in range(2000)}}
    quota = {"a": 25, "b": 4, None: 90, "c": 5, "d": 9, "e": 6} | {i: i % 11 for i in range(2000)}
    got = mixing.route(sizes, quota)
    assert got == {p: min(3 * n, quota[p[0]]) if len(p) == 1 and p != ("e",) else got[p] for p, n in sizes.items()} and got["d", "e"] + got["e",] == 15
    assert len(seen) == len(sizes) - 1 and {("d", "e"), ("e",)} in seen
    assert flow({("a",): 10}, {"a": 25}, 3) == {("a",): [10, 10, 5]} and flow({("a",): 0}, {"a": 5}, 3) == {("a",): []}


def out_of_place(text, profiles, size=400, longest=3):
    """(language, score) by a plain ranking: n-grams of the blank-padded words, most frequent first, ties as the operator breaks them."""
    alphabet = sorted({c for p in profiles.values() for g in p for c in g} - {" "})
    known = {" ": 0} | {c: i for i, c in enumerate(alphabet, 1)}
    base = len(alphabet) + 2
    n = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        ids = [0, *(known.get(c, base - 1) for c in word), 0]
        for k in range(1, longest + 1):
            for i in range(len(ids) - k + 1):
                if k > 1 or ids[i]:
                    n[tuple(ids[i : i + k])] += 1
    if not n:
        return "und", 0.0
    code = lambda g: sum(base**j for j in range(1, len(g))) + sum(c * base ** (len(g) - 1 - j) for j, c in enumerate(g))
    tie = lambda g: int(langid.mix(np.array([code(g)], np.uint64))[0]) >> 33
    ranked = sorted(n, key=lambda g: (-n[g], -tie(g)))[:size]
    far = {}
    for name, p in profiles.items():
        place = {tuple(known[c] for c in g): i for i, g in enumerate(p)}
        far[name] = sum(abs(i - place[g]) if g in place else size for i, g in enumerate(ranked))
    best = min(sorted(far), key=far.get)
    return best, max(0.0, 1 - far[best] / (size * len(ranked)))


def test_languages_by_plain_distance(spark):
    """Predictions and scores equal those of a plain out-of-place distance, with profiles from plain counts; also for long, null, repeated and letterless texts."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").limit(120).collect()]
    fit = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    counts = defaultdict(Counter)
    for _, text, lang in fit:
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            w = f" {word} "
            counts[lang].update(w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1) if w[i : i + k] != " ")
    want = {lang: [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], x[0].encode()))[:400]] for lang, n in counts.items()}
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.train(d.filter(~langid.held_out("doc_id")))
    assert profiles == want
    long = " ".join(r[1] for r in rows if r[2] == "de")
    odd = [(1001, None), (1002, ""), (1003, "12 !"), (1004, "日本語"), (1005, long * (1 + (1 << 21) // len(long))), (1006, rows[0][1]), (1006, rows[0][1]), (None, rows[1][1]), (1007, "ab")]
    every = spark.createDataFrame([(i, t, 7, "x") for i, t in [*((r[0], r[1]) for r in rows), *odd]], "doc_id long, text string, score long, lang_pred string")
    got = langid.identify(every, profiles)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"] and langid.identify(every.limit(0), profiles).count() == 0
    for r in got.collect():
        lang, score = out_of_place(r["text"] or "", profiles)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-12, r["doc_id"]


def test_training_on_nothing(spark):
    d = spark.createDataFrame([(1, None, "en"), (2, "text", None)], "doc_id long, text string, lang string")
    assert langid.train(d) == {}
    assert [tuple(r)[2:] for r in langid.identify(d.drop("lang"), {}).collect()] == [("und", 0.0)] * 2


def test_languages(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    d = spark.read.parquet(path).select("doc_id", "text", "lang")
    r = langid.identify(d, langid.train(d.filter(~langid.held_out("doc_id")))).filter(langid.held_out("doc_id"))
    assert r.filter("lang = lang_pred").count() / r.count() > 0.97
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 ?!", "x"), (4, "中", "x")], "doc_id long, text string, score string")
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.identify(odd, {"a": ["e", "th"]}).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "a" and 0 <= got[4][1] <= 1
    assert langid.train(odd.select("text", F.lit(None).cast("string").alias("lang"))) == {}


def test_count_grams():
    want = Counter(f" {x} "[i : i + k] for x in "ab c äß d e".split() for k in (1, 2, 3) for i in range(len(x) + 3 - k))
    del want[" "]
    assert langid.count_grams("Ab'c Äß  d9e") == dict(want)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def sets_of(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def without_near_copies(rows):
    """Of each group of linked rows the first by id, null last; rows are (doc_id, text, ...)."""
    s, group = [sets_of(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                group = [group[a] if g == group[b] else g for g in group]
    return [r for i, r in enumerate(rows) if i == min((j for j in range(len(rows)) if group[j] == group[i]), key=lambda j: (rows[j][0] is None, rows[j][0] or 0, j))]


def planted():
    """Rows with exact, repeated and near copies, equal and null ids, a repeated passage, nulls, and texts without a letter."""
    r = random.Random(9)
    known = ["".join(r.choices("abcdeéß", k=5)) for _ in range(300)]
    text = [" ".join(r.choices(known, k=90)) for _ in range(24)]
    passage = " ".join(r.choices(known, k=50))
    text[20] += " " + passage
    text[21] = passage + "\n" + text[21]
    near = text[0].split()
    near[40] = "other"
    rows = [(i, x) for i, x in enumerate(text, 10)] + [(10, text[0]), (10, text[0]), (3, " ".join(near)), (None, text[1]), (None, text[1]), (None, text[2] + " more"), (11, text[3]), (None, " ".join(known[:60])), (None, " ".join(known[:60])), (50, text[5].upper())]
    rows += [(60, None), (61, ""), (62, "1 2 ?"), (None, "3 - 4"), (63, " ".join(known[:40]) * 30)]
    rows += [(i, " ".join(r.choices(known, k=600))) for i in range(64, 70)]
    return [(i, x, "en" if k % 2 else "fr", ["s1", "s2", None][k % 3], len(x or "")) for k, (i, x) in enumerate(rows)]


def as_list(df):
    import corpus_pipeline

    return Counter(tuple(x) for x in df.select(*corpus_pipeline.COLUMNS).collect())


def test_pipeline_near_duplicates_by_row(spark):
    import corpus_pipeline

    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got, want = as_list(corpus_pipeline.near_duplicates(spark, df, "")), without_near_copies(rows)
    both = defaultdict(int), defaultdict(int)
    for side, c in zip(both, (got, Counter(want)), strict=True):
        for (i, x, *_), n in c.items():
            side[i, x] += n
    assert both[0] == both[1] and set(got) <= set(rows) and len(want) <= len(rows) - 8


def without_passages(rows, window=35):
    """Each row, less the words that a window met twice or more covers."""
    w = [words(r[1]) for r in rows]
    c = Counter(tuple(x[k : k + window]) for x in w for k in range(len(x) - window + 1))
    out = []
    for (i, text, lang, source, n), x in zip(rows, w, strict=True):
        gone = {j for k in range(len(x) - window + 1) if c[tuple(x[k : k + window])] > 1 for j in range(k, k + window)}
        text = b" ".join(a for j, a in enumerate(x) if j not in gone).decode() if gone else text
        out.append((i, text, lang, source, len(text) if gone else n))
    return out


def mixed_by_hand(rows, hashes):
    """Each row as often as the mix takes it: sources' shares of all words by weights 1, 2, 3, rows of a source in the order of their hashes."""
    by = defaultdict(list)
    for r, h in zip(rows, hashes, strict=True):
        by[r[3]].append((h % mixing.BUCKETS, h, len(words(r[1])), r))
    order = sorted(x for x in by if x is not None) + [None] * (None in by)
    size, weight = {x: sum(r[2] for r in by[x]) for x in order}, {x: 1 + k % 3 for k, x in enumerate(order)}
    share, free = {}, set(order)
    while free:
        per = (sum(size.values()) - sum(share.values())) / sum(weight[x] for x in free)
        full = {x for x in free if per * weight[x] > 3 * size[x]}
        share |= {x: 3 * size[x] if full else per * weight[x] for x in full or free}
        free -= full or free
    out = Counter()
    for x in order:
        give = min(3 * size[x], round(share[x]))
        passes, rest, start = give // size[x], give % size[x], 0
        for bucket in sorted({r[0] for r in by[x]}):
            held = sorted(r[1:] for r in by[x] if r[0] == bucket)
            of, ahead = sum(r[1] for r in held), start
            for _, n, r in held:
                more = ahead + n / 2 <= rest if start < rest < start + of else start + of <= rest
                out[r] += min(3, passes + more)
                ahead += n
            start += of
    return +out


def test_pipeline_stages_by_hand(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = planted()
    texts = lambda rows: Counter((r[0], r[1]) for r in rows)
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, spark.createDataFrame(rows, schema).repartition(3), "")
        if name == "packing":
            break
        after = [tuple(r) for r in got.select(*corpus_pipeline.COLUMNS).collect()]
        if name == "language":
            assert Counter(after) == Counter(r for r in rows if any(c.isalpha() for c in r[1] or ""))
        elif name == "near duplicates":
            assert texts(after) == texts(without_near_copies(rows)) and not Counter(after) - Counter(rows)
        elif name == "repeated passages":
            assert Counter(after) == Counter(without_passages(rows))
        else:
            assert name == "mixture"
            order = spark.createDataFrame(rows, schema).select("*", F.xxhash64(F.lit(17), F.struct(*corpus_pipeline.COLUMNS)).alias("h")).collect()
            assert Counter(after) == mixed_by_hand([tuple(r)[:5] for r in order], [r["h"] for r in order])
        assert Counter(after) != Counter(rows), name
        rows = after
    encode, want = Tokenizer.from_file(queries.tokenizer()), Counter()
    for i, text, *_ in rows:
        full = [*encode.encode(text, add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(full) - 1) % 1024 + 1, len(full) + 1, 1024)]
        want.update((i, k, a, b - a, crc(full[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    packed, at = got.collect(), defaultdict(list)
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in packed) == want and max(r[1] for r in want) > 0
    for r in packed:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in at.values():
        p.sort()
        assert all(o == sum(n for _, n in p[:k]) for k, (o, _) in enumerate(p)) and sum(n for _, n in p) <= 1024
