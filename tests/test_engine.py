"""Whole runs, incremental tables, vectors, call times and flags on small fixtures against plain Python."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skeinworks.operators import answer, engine, evaluate, graph, incremental, profile, search, stats, vectors
from skeinworks.plans.stage import stage

CHUNKS = [
    (1, "src/a.cpp", 10, 20, "function", "run", "Player", 10, "// file: src/a.cpp\nvoid Player::run() {\n  play(sound);\n}"),
    (2, "src/a.cpp", 1, 30, "file_overview", "", "", None, "// [file overview]\n#include \"a.h\""),
    (3, "src/a.h", 1, 9, "class", "Player", "", 1, "class Player {\n  void run();\n};"),
    (4, "src/b.cpp", 5, 9, "function", "stop", "Motor", 5, "void Motor::stop() {\n  halt(now);\n}"),
    (5, "src/c.cpp", 1, 9, "fallback", "", "", None, "nothing here"),
]
SYMBOLS = [("src/a.cpp", "run", "function", 10, "Player"), ("src/a.h", "Player", "class", 1, ""), ("src/b.cpp", "stop", "function", 5, "Motor")]


def tables(spark):
    c = spark.createDataFrame(CHUNKS, "chunk long, file string, start long, end long, type string, symbol string, class string, symbol_start long, text string")
    s = spark.createDataFrame(SYMBOLS, "file string, name string, kind string, line long, class string")
    d = spark.createDataFrame([("G1", "src/b.cpp", 6, True)], "command string, file string, line long, sure boolean")
    lines = c.select("file", F.col("start").alias("line"), "text")
    return c, s, d, lines


def planner(question):
    if "broken" in question:
        raise ValueError("no model")
    return '{"intent": "call_flow", "search_queries": ["Motor::stop", "' + question.upper() + '"], "symbols": ["run"], "must_have": ["play"]}'


def test_planned_search_and_answers_in_one_run(spark):
    c, s, d, lines = tables(spark)
    q = spark.createDataFrame([(1, " where is Player::run "), (2, "broken G1"), (3, ""), (4, None)], "question long, text string")
    plans, hits = engine.smart_search(q, planner, c, s, d, lines, k=3, wait=lambda n: 0.0)
    p = {r["question"]: r["plan"] for r in plans.collect()}
    assert p[1]["symbols"] == ["run"] and not p[1]["fallback"] and p[2]["queries"] == ["broken G1"] and p[2]["fallback"]
    subs = {(r["question"], r["n"], r["raw"], r["text"]) for r in engine.fan_out(plans).collect()}
    assert subs == {(1, 0, True, "where is Player::run"), (1, 1, False, "Motor::stop"), (1, 2, False, "run"), (2, 0, True, "broken G1")}
    h = {(r["question"], r["place"]): r for r in hits.collect()}
    assert {r["chunk"] for (q, _), r in h.items() if q == 1} >= {1, 4} and all(r["intent"] == "call_flow" and r["source"].endswith("+smart") for (q, _), r in h.items() if q == 1)
    run = next(r for (q, _), r in h.items() if q == 1 and r["chunk"] == 1)
    assert run["hits"] >= 2 and run["snippet"].startswith("void Player::run")
    assert h[2, 1]["chunk"] == 4 and h[2, 1]["line_start"] == 6 and max(k for q, k in h if q == 1) <= 3 and not any(q > 2 for q, _ in h)

    def model(prompt):
        if "G1" in prompt.split("\n")[0]:
            return "see `b.cpp:5`, `src/none.cpp:3`"
        return "run is at `src/a.cpp:10`." if "a.cpp" in prompt else "nothing"

    got = {r["question"]: r for r in engine.answered(q, hits, c, "{{question}}\n{{context_chunks}}\n{{primary_checklist}}{{primary_count}}", model, wait=lambda n: 0.0).collect()}
    assert (got[1]["n_citations"], got[1]["n_valid"], got[1]["ok"]) == (1, 1, True) and got[1]["n_mentioned"] >= 1
    assert (got[2]["n_citations"], got[2]["n_valid"], got[2]["ok"]) == (2, 1, False)
    assert got[3]["answer"] == "nothing" and answer.NO_HITS in got[3]["prompt"] and (got[3]["n_primary"], got[3]["ok"]) == (0, False) and 4 in got


def test_merge_by_hand(spark):
    """The question's own hit gains 0.1, each further sub-query 0.15; a chunk without a required word loses 0.25."""
    subs = spark.createDataFrame([("1#0", 1, 0, True), ("1#1", 1, 1, False), ("1#2", 1, 2, False)], "query string, question long, n int, raw boolean")
    plans = spark.createDataFrame([(1, ("x", ["needle"]))], "question long, plan struct<intent:string, must_have:array<string>>")
    rows = [("1#0", 7, 10.0, "a.c", 1, "s", "", "bm25", "the NEEDLE"), ("1#1", 7, 10.05, "a.c", 1, "s", "", "rg", "other"), ("1#2", 7, 10.2, "a.c", 9, "s", "", "", "the needle"), ("1#1", 8, 0.1, "b.c", 2, "t", "", "rg+smart", "no")]
    hits = spark.createDataFrame(rows, "query string, chunk long, score double, file string, line_start long, symbol string, class string, source string, snippet string")
    got = [tuple(r) for r in engine.fan_in(hits, subs, plans).select("chunk", "score", "place", "hits", "line_start", "source").orderBy("place").collect()]
    assert got == [(7, 10.5, 1, 3, 9, "smart"), (8, 0.0, 2, 1, 2, "rg+smart")]


def test_calls_pause_time_out_and_stop(spark):
    asked = spark.createDataFrame([(1, "slow"), (2, "twice"), (3, "fatal"), (4, "good")], "query long, prompt string").coalesce(1)

    def call(prompt, seen=Counter()):  # noqa: B006
        seen[prompt] += 1
        if prompt == "slow":
            time.sleep(5)
        if prompt == "twice" and seen[prompt] < 3:
            raise ConnectionError("away")
        if prompt == "fatal":
            raise KeyError("bad")
        return f"{prompt} {seen[prompt]}"

    began = time.perf_counter()
    got = {r["query"]: (r["answer"], r["error"]) for r in answer.answers(asked, call, attempts=3, timeout=0.2, wait=lambda n: 0.05 * n, transient=(ConnectionError,)).collect()}
    assert got[1][0] is None and got[1][1].startswith("TimeoutError") and got[2] == ("twice 3", None) and got[3] == (None, "KeyError: 'bad'") and got[4] == ("good 1", None)
    assert time.perf_counter() - began < 5 * 3 and [answer.pause(n) for n in (1, 3, 9)] == [2.0, 8.0, 30.0]


def test_why_files_were_not_recalled(spark):
    c, s, d, lines = tables(spark)
    asked = stage(search.ask(spark.createDataFrame([(1, "Player::run play"), (2, "motor")], "query long, text string")), "asked")
    ranked, kept = engine.run(asked, c, s, d, lines, k=1)
    expected = spark.createDataFrame([(1, "src/a.cpp"), (1, "src/a.h"), (1, "src/c.cpp"), (1, "src/gone.cpp"), (2, "src/b.cpp"), (2, "src/b.cpp")], "query long, file string")
    got = {(r["query"], r["file"]): r for r in engine.why_not(expected, asked, c, ranked, kept, 1).collect()}
    assert len(got) == 5 and got[1, "src/a.cpp"]["stage"] == "recalled" and got[1, "src/a.h"]["stage"] == "place" and got[1, "src/a.h"]["lacked"] > 0
    assert got[1, "src/c.cpp"]["stage"] == got[1, "src/gone.cpp"]["stage"] == "token" and got[2, "src/b.cpp"]["stage"] == "recalled"
    # With a hit taken out of the ranking, its words remain, so a limit lost it.
    gone = engine.why_not(expected, asked, c, ranked.filter("file <> 'src/a.h'"), kept, 1).filter("file = 'src/a.h'").first()
    assert gone["stage"] == "limit" and gone["place"] is None


def test_symbols_in_hits_and_answers(spark):
    e = spark.createDataFrame([(1, "Player::run"), (1, "Motor::run"), (1, "RUN"), (1, "a::run"), (1, "stop"), (2, "x")], "query long, symbol string")
    h = spark.createDataFrame([(1, "src/a.cpp", "run", "Player"), (1, "src/b.cpp", None, None)], "query long, file string, symbol string, class string")
    assert {(r["query"], r["symbol"]): r["found"] for r in evaluate.symbols_found(e, h).collect()} == {(1, "Player::run"): True, (1, "Motor::run"): False, (1, "RUN"): True, (1, "a::run"): True, (1, "stop"): False, (2, "x"): False}
    said = spark.createDataFrame([("P::run", "player p:: run"), ("P::run", "it is run by p"), ("run", "Run"), ("run", "rerun")], "s string, a string")
    assert [r[0] for r in said.select(evaluate.in_answer(F.col("s"), F.col("a"))).collect()] == [True, True, False, True]
    files = spark.createDataFrame([(1, "src/a.cpp"), (1, "src/z.cpp"), (3, "q")], "query long, file string")
    b = h.withColumn("role", F.lit("primary"))
    got = {r["query"]: tuple(r)[1:] for r in evaluate.context_layer(files, e, b, b.limit(0)).collect()}
    assert got == {1: (0.5, 3, 0, 5, 3), 2: (1.0, 0, 0, 1, 0), 3: (0.0, 0, 0, 0, 0)}
    rows = spark.createDataFrame([(True, 2, 2, 2, 1), (False, 1, 0, 0, 0)], "cite_ok boolean, expected_n long, expected_hit long, ctx_n long, ctx_hit long")
    assert tuple(evaluate.answer_rates(rows).first()) == (2, 0.5, 0.5, 0.0, 0.5) and tuple(evaluate.answer_rates(rows.limit(0)).first())[0] == 0


def test_changes_of_a_manifest(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "3"), ("e", None), ("z", "9")], "file string, digest string")
    new = spark.createDataFrame([("a", "1"), ("b", "7"), ("m", "3"), ("n", "3"), ("o", "3"), ("e", None)], "file string, digest string")
    assert {tuple(r) for r in incremental.changes(old, new).collect()} == {("b", None, "changed"), ("e", None, "changed"), ("m", "c", "moved"), ("n", "d", "moved"), ("o", None, "added"), ("z", None, "deleted")}
    assert incremental.changes(new, new.filter("file <> 'e'")).count() == 1 and incremental.changes(old.limit(0), old.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_incremental_edges_equal_a_rebuild(spark, seed):
    r = random.Random(seed)
    names = [f"n{k}" for k in range(25)]
    make = lambda: (r.sample(names, r.randint(0, 12)), r.choice([None, *names]))
    was = {f"f{k}": make() for k in range(30)}
    now = {k: v for k, v in was.items() if r.random() < 0.9} | {f"f{r.randrange(40)}": make() for _ in range(6)}
    built = lambda v: (
        spark.createDataFrame([(f, f, n) for f, (m, _) in v.items() for n in m], "file string, chunk string, name string"), spark.createDataFrame([(f, f, t) for f, (_, t) in v.items() if t], "file string, chunk string, name string"),
    )
    digests = lambda v: spark.createDataFrame([(f, repr(x)) for f, x in v.items()], "file string, digest string")
    paths = incremental.touched(incremental.changes(digests(was), digests(now)))
    (m0, t0), (m1, t1) = built(was), built(now)
    c0, c1 = (m.groupBy("name").agg(F.count("*").alias("n")) for m in (m0, m1))
    got = incremental.counts_after(c0, m0.join(paths, "file", "left_semi"), m1.join(paths, "file", "left_semi"), "name")
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in c1.collect()}
    after, fresh = incremental.edges_after(incremental.edges(m0, t0, c0, 9), paths, (m0, m1), (t0, t1), (c0, c1), 9)
    whole = sorted(map(tuple, incremental.edges(m1, t1, c1, 9).collect()))
    assert sorted(map(tuple, after.collect())) == whole and fresh.count() <= len(whole)


def test_a_vector_store_embeds_what_is_new(spark, tmp_path):
    def model(texts):
        with (tmp_path / "calls").open("a") as f:
            f.writelines(f"{t!r}\n" for t in texts)
        return [[3.0, float(len(t))] for t in texts]

    rows = [(k, "a.c", "function", "f", None, f"text {k % 4}\r\nx") for k in range(12)]
    c = spark.createDataFrame(rows, "chunk long, file string, type string, symbol string, class string, text string")
    asked = lambda: len((tmp_path / "calls").read_text().splitlines())
    store, done = vectors.refresh(None, c, "m", model)
    assert tuple(done.first()) == (12, 4, 0, 4, 0) and asked() == 4 and store.count() == 4
    again, done = vectors.refresh(store, c.withColumn("text", F.replace("text", F.lit("\r\n"), F.lit("\n"))), "m", model)
    assert tuple(done.first()) == (12, 4, 4, 0, 0) and asked() == 4 and vectors.stale(c, again, "m").count() == 0
    changed = c.filter("chunk <> 5").withColumn("text", F.when(F.col("chunk") == 1, "new").otherwise(F.col("text"))).filter("chunk % 4 <> 2")
    assert [r[0] for r in vectors.stale(changed, again, "m").collect()] == [1]
    last, done = vectors.refresh(again, changed, "m", model)
    assert tuple(done.first()) == (8, 4, 3, 1, 1) and asked() == 5 and last.count() == 4
    v = vectors.vectors_of(changed, last, "m")
    assert v.count() == 8 and all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-6 for r in v.collect())
    assert vectors.refresh(last, changed, "other", model)[1].first()["embedded"] == 4
    first = vectors.fingerprints(c, "m").orderBy("chunk").first()["text"]
    assert first == "file: a.c\nclass: \nsymbol: f\ntype: function\n\ntext 0\nx"


def test_call_times_by_a_stack(spark):
    r = random.Random(5)
    log, own, total, calls, outer = [], Counter(), Counter(), Counter(), Counter()
    for trace in range(6):
        at, stack, n = r.randrange(50), [], 0
        for _ in range(r.choice([0, 4, 300])):
            if stack and r.random() < 0.5:
                f, began, first = stack.pop()
                log.append((trace, at, n, f, -1))
                total[f] += (at - began) * first
            else:
                f = r.choice("abc")
                calls[f] += 1
                first = all(g != f for g, _, _ in stack)
                outer[f] += first
                stack.append((f, at, first))
                log.append((trace, at, n, f, 1))
            n += 1
            step = r.choice([0, 1, 9, 40])
            if stack and n < 10**6:
                own[stack[-1][0]] += step
            at += step
        while stack:
            f, began, first = stack.pop()
            log.append((trace, at, n, f, -1))
            total[f] += (at - began) * first
            n += 1
    d = spark.createDataFrame(log, "trace long, at long, n long, func string, up int")
    for bucket in (7, 10**9):
        got = {x["func"]: (x["calls"], x["outer_calls"], x["own"], x["total"]) for x in stats.call_times(d, bucket).collect()}
        assert got == {f: (calls[f], outer[f], own[f], total[f]) for f in calls}
    open_ = spark.createDataFrame([(1, 5, 0, "a", 1), (1, 8, 0, "b", 1), (1, 10, 0, "b", -1)], "trace long, at long, n long, func string, up int")
    assert {tuple(x) for x in stats.call_times(open_, 4).collect()} == {("a", 1, 1, 3, 0), ("b", 1, 1, 2, 2)}


def test_flags_of_files(spark):
    f = spark.createDataFrame([("Lib/Mbed/a.CPP", ["x"]), ("lib/mbedded/b.h", ["// Generated by"]), ("c.rc", []), ("lib", None), ("lib/mbed", ["x"] * 40 + ["do not edit"])], "path string, lines array<string>")
    folders = spark.createDataFrame([("lib",), ("LIB/mbed",), ("other",)], "folder string")
    got = {r["path"]: tuple(r)[1:] for r in profile.flags(f, folders).collect()}
    assert got == {"Lib/Mbed/a.CPP": ("C++", False, True, "LIB/mbed"), "lib/mbedded/b.h": ("C/C++ Header", True, True, "lib"), "c.rc": ("Resource", True, False, None), "lib": ("Text", False, True, "lib"), "lib/mbed": ("Text", False, True, "LIB/mbed")}


def test_ranks_by_query_are_bounded(spark):
    e = spark.createDataFrame([(k, (k * 7 + j) % 200, 1.0 + j) for k in range(200) for j in range(1, 6)], "src long, dst long, weight double")
    s = spark.createDataFrame([(q, q * 3, 1.0) for q in range(8)], "query long, id long, weight double")
    exact = {(r["query"], r["id"]): r["rank"] for r in graph.personalized(e, s, rounds=6, least=0.0).collect()}
    near = {(r["query"], r["id"]): r["rank"] for r in graph.personalized(e, s, rounds=6, least=0.002).collect()}
    assert max(Counter(q for q, _ in near).values()) <= 500 and len(near) < len(exact)
    for q in range(8):
        assert abs(sum(v for (p, _), v in near.items() if p == q) - 1) < 1e-9
    assert sum(abs(near.get(k, 0) - v) for k, v in exact.items()) / 8 < 0.5


def test_hubs_are_cut(spark):
    e = spark.createDataFrame([(0, k, "call", "x", 1.0) for k in range(1000)] + [(1, 5, "call", "y", 2.0)], "src long, dst long, kind string, label string, weight double")
    got = graph.adjacency(e, most=100).collect()
    assert {r["part"] for r in got if r["src"] == 1} == {0} and len([r for r in got if r["src"] == 0]) == 10
    assert sorted(x["to"] for r in got if r["src"] == 0 for x in r["edges"]) == list(range(1000)) and max(len(r["edges"]) for r in got) < 200


def test_names_are_looked_up_or_searched(spark):
    c, s, d, lines = tables(spark)
    asked = spark.createDataFrame([(1, " player::RUN "), (2, "stop"), (3, "halt now"), (4, ""), (5, None)], "query long, text string")
    got = {(r["query"], r["place"]): (r["chunk"], r["score"], r["source"]) for r in engine.inspect(asked, c, s, d, lines, k=2).collect()}
    assert got[1, 1] == (1, 100.0, "symbol") and got[2, 1] == (4, 100.0, "symbol") and got[3, 1][0] == 4 and got[3, 1][2] != "symbol" and not any(q > 3 for q, _ in got)
    assert engine.inspect(asked.filter("query < 3"), c, s, d, lines).count() == 2


def test_weights_are_swept_over_parts(spark):
    rows = [(1, 1, "a", 1, False, 2, 30.0, [("bm25", 10.0), ("dense", 20.0)]), (1, 2, "b", 1, False, 2, 25.0, [("bm25", 25.0)]), (1, 3, "c", 1, False, 2, 20.0, [("dense", 20.0)])]
    ranked = spark.createDataFrame(rows, "query long, chunk long, file string, line_start long, entry boolean, per_file int, score double, parts array<struct<channel:string,score:double>>")
    want = spark.createDataFrame([(1, "a"), (1, "c")], "query long, file string")
    got = {r["weight"]: (r["mean_coverage"], r["best"]) for r in engine.weight_sweep(ranked, want, [0, 10, 20, 40], k=2).collect()}
    assert got == {0.0: (0.5, False), 10.0: (0.5, False), 20.0: (0.5, False), 40.0: (1.0, True)}
    kept = ranked.select("query", "file", F.col("chunk").alias("rank"))
    assert [tuple(r) for r in engine.named_files(kept, want.unionByName(want), k=2).collect()] == [(1, 0.5, ["a"], ["c"])]


def test_reports_of_no_files(spark):
    f = spark.createDataFrame([], "file string, top_dir string, lines long, encoding string, binary boolean, generated boolean")
    t = spark.createDataFrame([], "file string, kind string")
    r = profile.report(f, t).first()
    assert r["totals"]["n_files"] == 0 and r["folders"] == [] and r["untagged"] == [] and r["risk"] is None
    one = spark.createDataFrame([("a.c", None, 5, "utf-8", None, False), ("b.c", "x", 9, "binary", True, False)], f.schema)
    r = profile.report(one, t).first()
    assert r["untagged"] == ["a.c"] and [x["file"] for x in r["longest"]] == ["b.c", "a.c"] and r["risk"]["untagged"] == 1
