import math

from pyspark.sql import functions as F

from skeinworks.functions import text as T
from skeinworks.operators import graph, retrieval, stats


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_tokens(spark):
    want = ["gcodedispatch", "gcode", "dispatch", "on_console_line_received", "on", "console", "line", "received", "a1", "httpserver"]
    assert one(spark, "GcodeDispatch::on_console_line_received x G-code a1 HTTPServer", T.tokens) == want
    assert one(spark, "", T.tokens) == [] and one(spark, None, T.tokens) is None


def test_commands(spark):
    assert set(one(spark, "G28 homing M104/M109 g-28.10", T.commands)) == {"G28", "M104", "M109", "G28.1"}


def test_lines(spark):
    for text, n in (("", 0), ("a", 1), ("a\n", 1), ("a\r\n\rb", 3), ("\n", 1)):
        assert one(spark, text, T.line_count) == n == len(one(spark, text, T.lines))


def test_sub_windows(spark):
    f = spark.createDataFrame([(400,), (180,), (0,), (1,)], "n long").select("n", T.sub_windows(F.col("n"), 180, 40).alias("w"))
    got = {r["n"]: r["w"] and [tuple(w) for w in r["w"]] for r in f.collect()}
    assert got == {400: [(1, 180), (141, 320), (281, 400)], 180: [(1, 180)], 0: None, 1: [(1, 1)]}


def test_diversify(spark):
    h = spark.createDataFrame([(1, "A", 9), (1, "A", 8), (1, "A", 7), (1, "B", 6), (1, "C", 5)], "q int, f string, s int")
    got = retrieval.diversify(h, ["q"], "f", [F.desc("s")], 2, 4).orderBy("rank").collect()
    assert [r["f"] for r in got] == ["A", "A", "B", "C"]


def test_merge_hits(spark):
    h = spark.createDataFrame([(1, "c", 50.0, True), (1, "c", 49.0, False), (1, "c", 49.5, False), (2, "d", 0.2, False)], "q int, c string, score double, raw boolean")
    got = {r["c"]: r["score"] for r in retrieval.merge_hits(h, ["q"], "c", F.col("raw"), F.col("c") == "d").collect()}
    assert got == {"c": 50.4, "d": 0.0}


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 1.0), ("d", "a", 1.0)], "src string, dst string, weight double")
    r = {x["id"]: x["rank"] for x in graph.pagerank(e, rounds=10).collect()}
    assert math.isclose(sum(r.values()), 1.0, rel_tol=1e-9) and r["c"] > r["b"] > r["d"]
    p = dict.fromkeys("abcd", 0.25)
    out = {"a": [("b", 0.5), ("c", 0.5)], "b": [("c", 1.0)], "d": [("a", 1.0)]}
    for _ in range(10):
        n = dict.fromkeys(p, 0.15 / 4 + 0.85 * p["c"] / 4)
        for s, ds in out.items():
            for d, w in ds:
                n[d] += 0.85 * p[s] * w
        p = n
    assert all(math.isclose(r[k], p[k], rel_tol=1e-9) for k in p)


def test_order_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(50)] + [("b", 1.0)] * 7, "k string, v double")
    got = {(r["k"], r["stat"]): r["v"] for r in stats.order_statistics(df, "k", "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).collect()}
    assert [got["a", s] for s in ("p50", "p95", "p99")] == [25, 47, 49] and got["b", "p99"] == 1.0
