"""Quality rules, the prefix trie and the source audit against brute force, with nulls, long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from skeinworks.llm import divergence, quality, trie

# --- quality rules -------------------------------------------------------------------------------------

SYMBOLS = set("#*$%&|<>")


def repeats(w, k=8):
    at = defaultdict(list)
    for i in range(len(w) - k + 1):
        at[tuple(w[i : i + k])].append(i)
    return len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + k)})


def split(t):
    return [x.decode() for x in (t or "").encode().split()]


def classes(t):
    import unicodedata

    c = Counter()
    for x in t or "":
        kind = unicodedata.category(x)
        c[0 if kind == "Ll" else 1 if kind == "Lu" else 2 if kind == "Nd" else 3 if x in " \t\n\v\f\r" else 4 if x in SYMBOLS else 5] += 1
    return [c[i] for i in range(6)]


def js(p, q):
    total = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(0.0, total / 2))


def judged(rows):
    """{key: (the five measures, base_failed, chars, words, kept)} of (key, text, lang)."""
    fit = defaultdict(list)
    for _, t, lang in rows:
        w = split(t)
        if lang is not None and len(w) >= 50 and 10 * classes(t)[4] <= len(w) and 5 * len(set(w)) >= min(len(w), 1000):
            fit[lang].append(t)
    refs = {}
    for lang, texts in fit.items():
        n, c = Counter(), np.zeros(6)
        for t in texts:
            n.update(split(t))
            c += classes(t)
        if n.total() >= 2000:
            top = sorted((x for x in n if len(x) <= 8), key=lambda x: (-n[x], x.encode()))[:50]
            refs[lang] = (top, [n[x] / n.total() for x in top] + [(n.total() - sum(n[x] for x in top)) / n.total()], c / c.sum())
    out = {}
    for key, t, lang in rows:
        w, c = split(t), classes(t)
        lines = [x for x in (t or "").split("\n") if split(x)]
        five = (len(w), sum(map(len, w)), sum(x in SYMBOLS for x in t or ""), len(lines) - len(set(lines)), repeats(w))
        failed = len(w) < 20 or 100 * five[4] > 30 * len(w)
        best = None
        for top, shares, ref in [] if failed else refs.values() if lang is None else [refs[lang]] if lang in refs else []:
            n = Counter(w)
            mine = [n[x] / len(w) for x in top]
            d = js([x / sum(c) for x in c], ref), js([*mine, (len(w) - sum(n[x] for x in top)) / len(w)], shares)
            best = min(best or (9, 9, 9), (sum(d), *d))
        far = best and (five[1] >= 100 and best[1] > 0.14 + 0.9 / math.sqrt(len(w)) or len(w) >= 50 and best[2] > 0.2 + 2.2 / math.sqrt(len(w)))
        out[key] = (*five, failed, *(best[1:] if best else (None, None)), not failed and not far)
    return out


@pytest.fixture(scope="module")
def prose():
    r = random.Random(4)
    common = {"en": "the of and to a in is".split(), "de": "der die und in den von zu".split()}
    rows = []
    for i in range(160):
        lang = r.choice(["en", "de", "de"])
        w = [r.choice(common[lang]) if r.random() < 0.4 else "".join(r.choices("abcdeilnorst", k=r.randint(2, 10))) for _ in range(r.choice([15, 25, 60, 120, 400]))]
        rows.append((i, " ".join(w).replace(" a", ".\nA"), lang))
    t = next(x for _, x, lang in rows if len(x.split()) == 120)
    odd = [
        None, "", " \n\t ", "a", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 300, t + "\n" + t, t.replace(" ", "&&& "), t.upper().replace(" ", "!! "), "é ß Ä Ω 5 ٣ \x1c | <>" * 30,
        " | ".join(r.choices(t.split(), k=200)), "one\ntwo\none\n \n \ntwo three", "\n".join(["same line"] * 30), " ".join(f"w{k}" for k in range(90)),
    ]
    long = " ".join(r.choice(common["en"]) if r.random() < 0.4 else f"u{r.randrange(10**6)}" for _ in range(200_000))
    odd.append(long + " " + " ".join(long.split()[1000:1100]))
    rows += [(1000 + k, x, lang) for k, x in enumerate(odd) for lang in ("en",)]
    rows += [(2000 + k, x, None) for k, x in enumerate([t, rows[5][1], odd[8]])] + [(3000, t, "xx"), (3001, odd[6], "xx"), (3, rows[3][1], rows[3][2])]
    return rows


def test_quality_by_brute_force(spark, prose):
    d = spark.createDataFrame([(*x, "row", 7.5) for x in prose], "doc_id long, text string, lang string, kept string, __words double").repartition(5)
    out = quality.quality(d)
    assert out.columns == ["doc_id", "text", "lang", "__words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_js", "words_js", "kept"]
    got, want = out.collect(), judged(prose)
    assert len(got) == len(prose)
    for x in got:
        mine, w = (*x[4:9], x["base_failed"], x["chars_js"], x["words_js"], x["kept"]), want[x["doc_id"]]
        assert mine[:6] == w[:6] and mine[8] == w[8] and x["__words"] == 7.5, x["doc_id"]
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(mine[6:8], w[6:8], strict=True)), x["doc_id"]
    kept = {x["doc_id"]: x["kept"] for x in got}
    assert not kept[1008] and not kept[1009] and not kept[1011] and not kept[2002]  # suffixed, shouted and piped texts go
    assert kept[3000] and sum(kept[i] for i in range(160)) > 60


def test_quality_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.quality(empty).count() == 0
    few = spark.createDataFrame([(1, "a b " * 9 + "c d e", "en"), (2, None, None)], "doc_id long, text string, lang string")  # no language has a reference
    assert {x["doc_id"]: (x["chars_js"], x["kept"]) for x in quality.quality(few).collect()} == {1: (None, False), 2: (None, False)}


def test_quality_runs_no_python(spark, prose):
    d = spark.createDataFrame(prose[:20], "doc_id long, text string, lang string")
    plan = quality.quality(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_slots_are_free_of_clashes(spark, prose):
    d = spark.createDataFrame([x for x in prose if x[2]], "doc_id long, text string, lang string")
    for r in quality.references(d).collect():
        assert sorted(x for x in r["slots"] if x) == list(range(1, len(r["words"]) + 1)) and len(r["slots"]) == r["size"]


# --- prefix trie ---------------------------------------------------------------------------------------


def brute_trie(paths):
    members = defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].add(c)
    out = {}
    for key, m in members.items():
        kids = [k for k in members if len(k) == len(key) + 1 and k[: len(key)] == key]
        below = [k for k in members if k[: len(key)] == key]
        ends = sorted(c for c in m if len(paths[c]) == len(key))
        out[min(m), len(key)] = (
            min(members[key[:-1]]) if key else None, len(m), len(kids), sum(not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below) for k in below),
            sum((len(members[k]) - 1) * (len(k[-1][1]) if k else 0) for k in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def rebuild(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + v[h:]
    return out


def as_nodes(df):
    return {(x["conv_id"], x["depth"]): (x["parent_conv_id"], x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"], x["ends_sha256"]) for x in df.collect()}


CONV = "conv_id long, turn long, role string, text string, pos string"


def test_trie_of_rebuilt_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "BUCKET", 4)
    r = random.Random(8)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 220), 5_000_000_017]:
        for t in range(r.choice([1, 2, 3, 4, 6, 9])):
            rows.append((c, r.choice([t, t, t, None, 0]), r.choice(["user", "assistant", None]), r.choice(["a", "b", "é😀", "", None, "long " * 50])))
    rows += [(7, t, "user", "same") for t in range(30)] + [(8, 3, "user", "tie")] * 3 + [(None, 0, "user", "lost"), (300, None, None, None)]
    d = spark.createDataFrame([(*x, "x") for x in rows], CONV).repartition(4)
    assert as_nodes(trie.trie(*trie.rebuilt(d))) == brute_trie(rebuild(rows))


def given(spark, paths):
    turns = [(c, k, *x) for c, p in paths.items() for k, x in enumerate(p, 1)]
    t = trie.hashed(spark.createDataFrame(turns, "conv long, pos long, role string, text string"))
    return spark.createDataFrame([(c,) for c in paths], "conv long"), t


def test_trie_of_nested_and_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "BUCKET", 4)
    grown = [("u", f"t{k}" * (k % 5)) for k in range(23)]
    paths = {c: grown[:c] for c in range(24)}  # each one goes on where the one before ends: chains nest 23 deep
    paths |= {100 + k: grown[:9] for k in range(5)} | {200 + k: [*grown[:4], ("u", str(k % 2))] for k in range(6)} | {300: [("v", "t0")], 301: [], 302: []}
    assert as_nodes(trie.trie(*given(spark, paths))) == brute_trie(paths)


def test_trie_of_nothing_and_of_textless(spark):
    assert trie.trie(*trie.rebuilt(spark.createDataFrame([], CONV))).count() == 0
    assert as_nodes(trie.trie(*given(spark, {5: [], 4: []} | {6: [("a", "")]}))) == brute_trie({5: [], 4: [], 6: [("a", "")]})


def test_ends_of_a_node_are_cut_in_pieces_and_over_tasks(spark, monkeypatch):
    ends = [(1, 2, c) for c in range(0, 5000, 3)] + [(1, 3, 7), (2, 2, 9)]
    got = {(x[0], x[1]): x[2] for x in trie.ends_digests(spark.createDataFrame(ends, "owner long, depth long, conv long").repartition(6)).collect()}
    assert got == {k: hashlib.sha256(",".join(str(c) for o, d, c in ends if (o, d) == k).encode()).hexdigest() for k in {x[:2] for x in ends}}
    monkeypatch.setattr(trie, "PIECE", 40)
    batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in sorted(ends)]) for i in range(3)], ["owner", "depth", "conv"])
    runs = [x for b in trie._runs(iter([batch])) for x in b.to_pylist()]
    assert len(runs) > 100
    assert {(x["conv"], x["depth"]): x["ends_sha256"] for b in trie._digests(iter([pa.RecordBatch.from_pylist(runs, trie._PIECES)])) for x in b.to_pylist()} == got


# --- source divergence ---------------------------------------------------------------------------------


def terms(t):
    return [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]


def brute_audit(rows, top=200):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        n[lang, source].update(terms(t or ""))
        df[lang].update(set(terms(t or "")))
    out = set()
    for lang, sources in groups.items():
        kept = [x for x in df[lang] if df[lang][x] >= 3]
        count = {s: {x: n[lang, s][x] for x in kept} for s in sources}
        every = {x: sum(count[s][x] for s in sources) for x in kept}
        p = {s: {x: 1 + 10**9 * (c[x] + 1) // (sum(c.values()) + len(kept)) for x in kept} for s, c in [*count.items(), (None, every)]}
        gap = lambda a, b, x: (p[a][x] - p[b][x]) ** 2 // p[b][x]  # noqa: B023, E731
        for s in sources:
            pair = sorted(((-sum(gap(s, o, x) for x in kept), o.encode()) for o in sources if o != s))
            term = sorted((-gap(s, None, x), x.encode()) for x in kept if count[s][x] and p[s][x] > p[None][x])[:top]
            out |= {(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pair), ("term", term)) for k, (v, item) in enumerate(found, 1)}
    return out


def documents(seed=3):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "lmnopé"] + ["The", "THE", "ÄB", "äb", "x1y", "it's", "日本"]
    rows = [(" ".join(r.choices(words[: r.randint(5, len(words))], k=r.randint(1, 40))), r.choice(["en", "fr", None]), r.choice(["s1", "s2", "s3", "é", "z😀", None])) for _ in range(150)]
    return rows + [(None, "en", "none"), ("", "en", "s1"), ("1 2 @", "xx", "a"), ("b", "xx", "b"), ("the " * 900_000, "en", "s1"), ("the", "en", "s1"), ("the", "en", "s1"), ("q q q q", "fr", "alone"), (None, None, None)]


def audited(df):
    return {(x["lang"], x["source"], x["part"], x["item"], x["value"], x["rank"]) for x in df.collect()}


def test_audit_by_brute_force(spark):
    rows = documents()
    d = spark.createDataFrame([(*x, 1, "x", "y") for x in rows], "text string, lang string, source string, n long, term string, value string").repartition(6)
    assert audited(divergence.audit(d)) == brute_audit(rows)
    assert audited(divergence.audit(d, top=3)) == brute_audit(rows, top=3)
    assert divergence.audit(d.limit(0)).count() == 0


def test_shares_are_exact_beyond_longs(spark):
    rows = [(0, 0, 3), (7, 100, 3), (9_223_372_034, 2 * 10**12, 10**6), (9_223_372_036, 10**13, 10**9), (4 * 10**17, 10**18, 10**12), (5, 5, 1)]
    d = spark.createDataFrame(rows, "c long, n long, v long")
    got = [x[0] for x in d.select(divergence.share(d["c"], d["n"], d["v"])).collect()]
    assert got == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in rows]


def test_corrections_in_small_squares_and_runs(monkeypatch):
    r = np.random.default_rng(1)
    lists = [sorted(r.choice(11, size=int(r.integers(2, 12)), replace=False).tolist()) for _ in range(60)]
    langs = ["en" if k % 3 else "fr" for k in range(60)]
    p = [r.integers(1, 10**9, len(x)).tolist() for x in lists]
    zero = [[100 + i for i in x] for x in lists]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), *(pa.array(x, pa.list_(pa.int64())) for x in (lists, p, zero))], ["lang", "id", "p", "zero"])
    want = Counter()
    for k, ids in enumerate(lists):
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if a != b:
                    g = lambda x, y: (x - y) ** 2 // y
                    want[langs[k], a, b] += g(p[k][i], p[k][j]) - g(p[k][i], zero[k][j]) - g(zero[k][i], p[k][j]) + g(zero[k][i], zero[k][j])
    for square, squares, pairs in ((256, 64, 1 << 20), (3, 2, 17)):
        monkeypatch.setattr(divergence, "SQUARE", square)
        monkeypatch.setattr(divergence, "SQUARES", squares)
        monkeypatch.setattr(divergence, "PAIRS", pairs)
        got = Counter()
        for b in divergence._corrections(iter([batch.slice(0, 25), batch.slice(25)])):
            for x in b.to_pylist():
                got[x["lang"], x["a"], x["b"]] += x["more"]
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 50)
    text = " ".join(f"Word{chr(97 + k % 26) * (k % 9)}" for k in range(500)) + "x" * 300 + " é" * 40
    parts = [t for p in divergence._chunks(text.encode()) for t in p.split()]
    assert [t.decode() for t in parts] == terms(text)
