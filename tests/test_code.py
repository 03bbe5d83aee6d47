"""Code operators, rules and evaluation on small fixtures."""

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinworks.functions import rules
from skeinworks.functions import text as T
from skeinworks.operators import code, evaluate, retrieval, symbols

CPP = """#include "b.h"
#define LIMIT 3
int Player::run(int x) {
  switch(gcode->g) {
    case 28: stop(); break;
  }
  if (gcode->m == 104.50) { go(); }
  if (gcode->m == this->halt_code) { halt(); }
  return x;
}
void idle()
{
}
"""
HEADER = "class Player {\n  int run(int x);\n};\n"


# Lines of known classes: code (also with comment signs in strings, or a comment after or before it), comments, blanks.
CODE = ["x = 1;", "  y();", 's = "// no";', "c = '\"'; // yes", 'u = "/* no";', "/* a */ z();", "d = a / b;", "t = \"\\\\\";"]
COMMENT = ["// a", "  // b \"c", "/* d */", "\t/* e */ // f", "// /* g"]
BLANK = ["", "   ", "\t"]
BLOCK = [["/* a", "b", "*/"], ["/* a", "", "// b */"], ["  /*", "\"*/"], ["/* x = 1;", "y = 2;", "z = 3; */"]]


@given(st.lists(st.one_of(st.sampled_from(CODE), st.sampled_from(COMMENT), st.sampled_from(BLANK), st.sampled_from(BLOCK)), max_size=12))
def test_loc_of_lines_of_known_classes(parts):
    lines = [x for p in parts for x in (p if isinstance(p, list) else [p])]
    want = [sum(p in kind for p in parts if isinstance(p, str)) for kind in (CODE, COMMENT, BLANK)]
    for p in parts:
        if isinstance(p, list):
            want[1] += sum(x != "" for x in p)
            want[2] += p.count("")
    assert code.count_loc("".join(x + "\n" for x in lines)) == tuple(want)


def test_loc(spark):
    d = spark.createDataFrame([(1, "int x; // c\n/* a\nb */\n\n"), (2, None), (3, "")], "id long, t string")
    got = {r["id"]: tuple(r)[1:] for r in code.loc(d, "id", "t").collect()}
    assert got == {1: (1, 2, 1), 2: (0, 0, 0), 3: (0, 0, 0)}


def tables(spark):
    f = spark.createDataFrame([("a/p.cpp", "a", CPP), ("a/p.h", "a", HEADER), ("q.txt", ".", "x\n" * 150), ("e.cpp", ".", "")], "file string, top_dir string, text string")
    f = f.select("file", "top_dir", T.lines(F.col("text")).alias("lines"))
    lines = f.select("file", F.posexplode("lines").alias("p", "text")).select("file", (F.col("p") + 1).cast("long").alias("line"), "text")
    return f, lines


def test_symbols_and_chunks(spark):
    f, lines = tables(spark)
    s = symbols.symbols(f.select("file", F.array_join("lines", "\n").alias("text")))
    got = {(r["file"], r["name"], r["kind"], r["line"], r["end_line"], r["class"]) for r in s.collect()}
    assert got == {("a/p.cpp", "LIMIT", "macro", 2, 2, ""), ("a/p.cpp", "run", "function", 3, 10, "Player"), ("a/p.cpp", "idle", "function", 11, 13, ""), ("a/p.h", "Player", "class", 1, 3, ""), ("a/p.h", "run", "prototype", 2, 2, "Player")}
    s = s.filter("kind <> 'prototype'").drop("scope_kind")
    ends = code.symbol_ends(f, s.withColumn("end_line", F.lit(None).cast("long")))
    assert {(r["name"], r["end"]) for r in ends.collect()} == {("LIMIT", 2), ("run", 10), ("idle", 13), ("Player", 3)}
    stated = code.symbol_ends(f, s.withColumn("end_line", F.lit(400).cast("long")))
    assert {(r["name"], r["end"]) for r in stated.collect()} == {("LIMIT", 13), ("run", 13), ("idle", 13), ("Player", 3)}
    c = {r["id"]: r for r in code.chunks(f, ends).collect()}
    assert set(c) == {"a_p_cpp::3-10", "a_p_cpp::11-13", "a_p_h::1-3", "q_txt::1-100", "q_txt::81-150", "a_p_cpp::1-13::overview", "a_p_h::1-3::overview", "q_txt::1-40::overview"}
    assert c["a_p_cpp::3-10"]["text"].startswith("// file: a/p.cpp\n// symbol: run\n// symbol_start: 3\n// chunk_lines: 3-10\n// kind: function\n// class: Player\nint Player::run")
    assert '//   #include "b.h"\n//\n// symbols (3):\n//  macro        LIMIT  line 2\n' in c["a_p_cpp::1-13::overview"]["text"]


def test_closing_braces(spark):
    texts = {"a": ["f() {", "{ }", "} // }", "}"], "b": ["f();"] * 5, "c": ["x"] * 300, "d": ["} g()", "{ if { } }", "}", "h() { }"], "e": ["k() {"]}
    f = spark.createDataFrame(list(texts.items()), "file string, lines array<string>")
    at = [("a", 1), ("a", 2), ("b", 2), ("c", 4), ("d", 1), ("d", 2), ("d", 4), ("e", 1)]
    s = spark.createDataFrame([(file, f"s{line}", "function", line, "", None) for file, line in at], "file string, name string, kind string, line long, class string, end_line long")
    got = {(r["file"], r["line"]): r["end"] for r in code.symbol_ends(f, s).collect()}
    # A symbol ends before the next one: a's first at line 1, d's first before line 2.
    assert got == {("a", 1): 1, ("a", 2): 2, ("b", 2): 5, ("c", 4): 104, ("d", 1): 1, ("d", 2): 2, ("d", 4): 4, ("e", 1): 1}
    rows = f.select("file", F.posexplode("lines").alias("p", "text")).select("file", (F.col("p") + 1).cast("long").alias("line"), "text")
    assert {(r["file"], r["line"]): r["brace"] for r in code.closing(rows, s).collect()} == {("a", 1): 3, ("a", 2): 2, ("d", 1): 2, ("d", 2): 2, ("d", 4): 4}


def test_dispatch(spark):
    _, lines = tables(spark)
    more = spark.createDataFrame([("a/p.cpp", 20, "this->halt_code = c->by_default(112.0)->as_number();"), ("a/p.cpp", 21, "this->halt_code = c->by_default(113.0)->as_number();")], "file string, line long, text string")
    got = code.dispatch(lines.filter("file = 'a/p.cpp'").withColumn("chunk", F.lit("k")), code.dispatch_defaults(more))
    assert {(r["command"], r["line"], r["kind"]) for r in got.collect()} == {("G28", 5, "case"), ("M104.5", 7, "direct"), ("M113", 8, "named")}


def test_resolve_paths(spark):
    known = spark.createDataFrame([("src/a.h",), ("lib/a.h",), ("lib/deep/b.h",)], "file string")
    wanted = spark.createDataFrame([("src/a.h",), ("a.h",), ("deep/b.h",), ("c.h",), ("",), (None,)], "name string")
    got = {tuple(r) for r in code.resolve_paths(wanted, known).select("name", "target", "how").collect()}
    assert got == {("src/a.h", "src/a.h", "path"), ("a.h", "src/a.h", "base"), ("a.h", "lib/a.h", "base"), ("deep/b.h", "lib/deep/b.h", "end")}


def test_rules(spark):
    d = spark.createDataFrame([('```json\n{"intent": "call_flow", "search_queries": [" a ", ""], "symbols": ["S"]}\n```',), ("no plan",), ('{"intent": "odd"}',), ("{broken",), (None,)], "r string")
    got = [(r["p"]["intent"], r["p"]["queries"], r["p"]["fallback"]) for r in d.select(rules.plan(F.col("r"), F.lit("q")).alias("p")).collect()]
    assert got == [("call_flow", ["a"], False), ("unknown", ["q"], True), ("unknown", ["q"], False), ("unknown", ["q"], True), ("unknown", ["q"], True)]
    one = spark.range(1)
    r = one.select(
        rules.excludes(F.lit(" a,b ,,a")).alias("e"), rules.note_map(F.lit("a = 1; b=x=y; c; a=2")).alias("n"), rules.sub_queries(F.lit("Q"), F.array(F.lit("q "), F.lit("r")), F.array(F.lit("R"), F.lit("s"))).alias("s"),
        rules.stem(F.lit("a/B.tar.H")).alias("stem"), rules.coherence(F.lit("x/robot.cpp"), F.lit("run"), F.lit(""), F.array(F.lit("robot")), F.lit(True)).alias("c"), rules.coherence(F.lit("x/y.cpp"), F.lit("on_gcode"), F.lit(""), F.array(F.lit("zz")), F.lit(True)).alias("c2"),
    ).first()
    assert r["e"] == ["a", "b"] and r["n"] == {"a": "2", "b": "x=y"} and r["s"] == ["Q", "r", "s"] and (r["stem"], r["c"], r["c2"]) == ("b.tar", 8.0, -5.0)


def test_chunk_bonus(spark):
    rows = [("function", "a.cpp", "run", "K", 5, 5, 13.0), ("function", "a.cpp", "K", "K", 5, 5, -5.0), ("class", "a.h", "K", "", 1, 1, 5.0), ("fallback", "a.cpp", "", "", 1, None, 0.0)]
    d = spark.createDataFrame(rows, "t string, f string, s string, c string, a int, b int, want double")
    assert d.filter(rules.chunk_bonus(*(F.col(x) for x in "tfscab")) != F.col("want")).count() == 0


def test_bundle_and_context(spark):
    p = spark.createDataFrame([(1, "a", 10.0, 1), (1, "b", 8.0, 2)], "q int, c string, score double, rank int")
    more = spark.createDataFrame([("a", "o", "overview", 0, 0.3), ("b", "o", "overview", 0, 0.3), ("a", "b", "header", 1, 0.5)], "c string, other string, role string, place int, factor double")
    got = {tuple(r) for r in retrieval.expand_bundle(p, more, ["q"], "c").collect()}
    assert got == {(1, "a", "primary", 10.0), (1, "b", "primary", 8.0), (1, "o", "overview", 3.0)}
    h = spark.createDataFrame([(1, "primary", 1.0, 1), (1, "overview", 9.0, 2), (1, "primary", 2.0, 3), (2, "overview", 1.0, 1)], "q int, role string, score double, ord int")
    assert [tuple(r) for r in retrieval.context(h, "q", 2).select("q", "ord").orderBy("q", "place").collect()] == [(1, 3), (1, 1), (2, 1)]


def test_evaluation(spark):
    d = spark.createDataFrame([(True, True, True, None), (True, True, False, False), (False, False, False, False), (True, True, True, True)], "a boolean, b boolean, c boolean, d boolean")
    assert [r["v"] for r in d.select(evaluate.verdict(*(F.col(x) for x in "abcd")).alias("v")).collect()] == ["not asked", "context", "recall", "cited"]
    r = spark.createDataFrame([(1, "f", 1.0), (1, "g", 0.5)], "q int, f string, m double")
    assert [tuple(x) for x in evaluate.regressions(r, r.filter("f = 'g'"), ["q", "f"], "m").collect()] == [(1, "f", 1.0, 0.0)]
    places = evaluate.first_place(r, ["q"], "f", [F.desc("m")]).collect()
    assert {(x["f"], x["first"]) for x in places} == {("f", 1), ("g", 2)}


def test_answers_of_a_stub(spark):
    from skeinworks.operators import answer

    asked = spark.createDataFrame([(1, " where? "), (2, "nothing")], "query long, text string")
    hits = spark.createDataFrame([(1, "src/a.cpp", "function", "run", 4, 4, 9, 12.5, "bm25", "run();", "primary", 1), (1, "src/a.cpp", "file_overview", None, None, 1, 3, 3.0, None, None, "overview", 2)], "query long, file string, type string, symbol string, symbol_start int, start int, end int, score double, source string, snippet string, role string, ord int")
    p = {r["query"]: r["prompt"] for r in answer.prompts(asked, hits, "{{question}}|{{context_chunks}}|{{primary_checklist}}|{{primary_count}}").collect()}
    assert p[2] == "nothing|" + answer.NO_HITS + "|" + answer.NO_PRIMARY + "|0"
    assert p[1].startswith("where?|#### [1] `src/a.cpp:4`  role=primary  type=function  symbol=run  symbol_start=4  chunk_lines=4-9  score=12.5  source=bm25\n```cpp\nrun();\n```\n\n#### [2]") and p[1].endswith("|1. `src/a.cpp` — symbol=run|1")

    def call(prompt):
        if prompt.startswith("nothing"):
            raise ValueError("no")
        return "see `a.cpp:5` and `b.h:1-2`"

    got = answer.answers(answer.prompts(asked, hits, "{{question}}"), call, wait=lambda n: 0.0)
    assert {(r["query"], r["answer"], r["error"]) for r in got.collect()} == {(1, "see `a.cpp:5` and `b.h:1-2`", None), (2, None, "ValueError: no")}
    assert {tuple(r) for r in answer.cited(got, hits).collect()} == {(1, 2, 1, False), (2, 0, 0, False)}


def test_ranks_by_query_keep_their_mass(spark):
    from skeinworks.operators import graph

    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 3.0)], "src string, dst string, weight double")
    s = spark.createDataFrame([(1, "a", 2.0), (2, "c", 1.0), (2, "alone", 1.0)], "query long, id string, weight double")
    got = {(r["query"], r["id"]): r["rank"] for r in graph.personalized(e, s, rounds=6).collect()}
    step = np.array([[0, 0.25, 0, 0], [1, 0, 0, 0], [0, 0.75, 0, 0], [0, 0, 0, 0]])  # to a, b, c, alone from each
    for q, p in ((1, np.array([1.0, 0, 0, 0])), (2, np.array([0, 0, 0.5, 0.5]))):
        r = p
        for _ in range(6):
            r = 0.85 * (step @ r + (r[2] + r[3]) * p) + 0.15 * p
        assert np.allclose([got.get((q, x), 0.0) for x in ("a", "b", "c", "alone")], r) and abs(r.sum() - 1) < 1e-9
