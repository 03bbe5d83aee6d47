"""Steps of the search that met each row too often: the same result, with work that follows what differs."""

import numpy as np
from pyspark.sql import functions as F

from skeinworks.functions import text
from skeinworks.operators import engine, graph, retrieval, search, stats
from skeinworks.plans import index_queries, queries, source_queries
from skeinworks.plans.catalog import QUERIES
from skeinworks.plans.stage import FACTOR, input_bytes, pieces, sized_as_held, stage


def test_classes_meet_questions_once(spark):
    # One method with eight definitions in eight chunks: 64 pairs of definition and chunk, 8 chunks to a question.
    chunks = spark.createDataFrame([(i, "src/a/m.c", 10 * i, 10 * i + 5, "function", "run", "C11", 10 * i, "run C11") for i in range(8)], "chunk long, file string, start long, end long, type string, symbol string, class string, symbol_start long, text string")
    symbols = chunks.select("file", F.col("symbol").alias("name"), F.lit("function").alias("kind"), "class", F.col("start").alias("line"))
    asked = search.ask(spark.createDataFrame([(i, "模块系统 C11 register") for i in range(5)], "query long, text string"))
    got = search.class_methods(asked, symbols, search.chunks_of(symbols, chunks), chunks)
    assert sorted(map(tuple, got.collect())) == [(q, c, search.CLASS_METHOD) for q in range(5) for c in range(8)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]  # nothing is told apart after the questions have met their chunks


def test_copies_and_alike_questions_are_scored_once(spark, monkeypatch):
    texts = ["red engine valve", "red engine", "blue engine engine", "Valve, valve; cold"]
    docs = spark.createDataFrame([(i, texts[i * 7 % 4] if i % 9 else f"odd{i} valve") for i in range(120)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, ["engine valve", "valve engine", "cold red"][i % 3]) for i in range(12)], "item_id long, text string")
    seen, plain = [], retrieval._scored

    def scored(p, q, *rest):
        seen.append((p.count(), q.select("query").distinct().count()))
        return plain(p, q, *rest)

    def rows():
        return sorted((r["item_id"], r["doc_id"], r["score"]) for r in retrieval.bm25(docs, asked, k=5).collect())

    monkeypatch.setattr(retrieval, "_scored", scored)
    got = rows()
    assert seen == [(18, 2)]  # 4 texts and 14 odd ones of 120, 2 sets of words of 12 questions
    monkeypatch.setattr(retrieval, "MOST_BEST", 5)  # a question to a block
    assert rows() == got
    monkeypatch.setattr(retrieval, "MOST_TERMS", 0)
    assert rows() == got and len(got) == 12 * 5


def test_rows_behind_the_kth_are_not_taken_in():
    for kind in (np.int64, object):
        best = retrieval.Best(2, 2)
        best.most = 4
        add = lambda q, key, s: best.add(np.array(q), np.array(key, kind), np.array(s, float))  # noqa: B023, E731
        add([0, 0, 0, 1, 0], [5, 3, 9, 4, 8], [1, 2, 2, 1, 2])
        assert best.n == 3
        add([0, 0, 0], [7, 9, 1], [1, 2, 1.5])
        assert best.n == 3  # worse, or equal with a greater key
        add([0, 1], [6, 2], [2, 1])
        assert [x.tolist() for x in best.kept()] == [[0, 0, 1, 1], [3, 6, 2, 4], [2, 2, 1, 1]]


def test_alike_questions_are_searched_for_once(spark):
    asked = spark.createDataFrame([(3, "a"), (5, "a"), (7, "a"), (4, "b")], "query long, text string")
    dense = spark.createDataFrame([(5, 1, 2.0)], "query long, chunk long, score double")
    assert sorted(map(tuple, engine.alike(asked, dense).collect())) == [(3, 3), (4, 4), (5, 5), (7, 3)]
    assert sorted(map(tuple, engine.alike(asked).collect())) == [(3, 3), (4, 4), (5, 3), (7, 3)]
    assert sorted(map(tuple, engine.each_of(spark.createDataFrame([(3, 9)], "query long, chunk long"), engine.alike(asked)).collect())) == [(3, 9), (5, 9), (7, 9)]


def test_hits_meet_what_is_found_once_for_chunks_and_questions(spark):
    chunks = spark.createDataFrame([(i, f"src/a/m{i % 3}.c", 10 * i, 10 * i + 5, "function", "on_run", "C11", 10 * i, "run C11") for i in range(9)], "chunk long, file string, start long, end long, type string, symbol string, class string, symbol_start long, text string")
    asked = stage(search.ask(spark.createDataFrame([(1, "模块系统 C11 register"), (2, "nothing")], "query long, text string")), "asked")
    found = spark.createDataFrame([(q, c, 50.0) for q in (1, 2) for c in range(9)], "query long, chunk long, score double")
    merged = search.merge({"rg": found, "bm25": found.filter("chunk < 4")}, asked, stage(chunks, "chunks"))
    top = merged._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "regexp" not in top and "模块系统" not in top  # neither paths nor questions are read again for each hit
    got = {(r["query"], r["chunk"]): (r["score"], r["source"]) for r in merged.collect()}
    assert len(got) == 18 and got[1, 0] == (50 + 50 + 3 + 4 + 6 + 8, "bm25+rg") and got[2, 8] == (50 + 3 + 4 + 6, "rg")


def test_weights_are_tried_on_hits_that_they_move(spark, monkeypatch):
    parts = lambda *p: [{"channel": c, "score": float(x)} for c, x in p]
    rows = [(1, i, f"f{i % 7}", i, i % 2 == 0, 2, float(i * 13 % 17), parts(("bm25", i * 13 % 17))) for i in range(60)]
    rows += [(1, 100 + i, f"f{i % 9}", i, False, 2, 9.0 + i, parts(("bm25", 5), ("dense", 4 + i)) if i % 3 else parts(("dense", 9 + i))) for i in range(8)]
    ranked = spark.createDataFrame(rows, "query long, chunk long, file string, line_start long, entry boolean, per_file int, score double, parts array<struct<channel: string, score: double>>")
    expected = spark.createDataFrame([(1, f"f{i}") for i in range(9)], "query long, file string")
    weights, want = [0, 5, 20, 40], {}
    for w in weights:
        scored = []
        for _, c, f, line, entry, _, score, p in rows:
            own = sum(x["score"] for x in p if x["channel"] == "dense")
            if w or any(x["channel"] != "dense" for x in p):
                scored.append((-round(score + own * (w / 20 - 1), 2), not entry, f, line, c))
        held, top = {}, []
        for x in sorted(scored):
            held[x[2]] = held.get(x[2], 0) + 1
            if held[x[2]] <= 2 and len(top) < 5:
                top.append(x[2])
        want[float(w)] = round(len(set(top)) / 9, 6)
    seen, plain = [], retrieval.diversify
    monkeypatch.setattr(retrieval, "diversify", lambda hits, *rest: seen.append(hits.count()) or plain(hits, *rest))
    got = {r["weight"]: r["mean_coverage"] for r in engine.weight_sweep(ranked, expected, weights).collect()}
    assert got == want and max(seen) <= 60  # not 68 hits times 4 weights


def test_incremental_queries_cut_texts_once_and_build_what_they_return(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(index_queries, "stage", lambda df, name, *rest: staged.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or stage(df, name, *rest))
    for name, built in (("incremental_counts", ["changes", "touched", "before", "fresh", "counts"]), ("incremental_work", ["changes", "touched", "before", "fresh"])):
        staged.clear()
        out = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert [x for x, _ in staged] == built  # no edges, no copy of the whole table
        assert [x for x, plan in staged if "regexp_extract_all" in plan] == ["before", "fresh"] and all(plan.count("regexp_extract_all") <= 1 for _, plan in staged)
        assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_reply_is_read_once(spark):
    plan = QUERIES["plan_parse"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("jsontostructs") == 1 and plan.count("try_parse_json") + plan.count("tryParseJson") + plan.count("parseJson") <= 1


def test_ranks_of_equal_seeds_are_found_once_in_pieces(spark, monkeypatch):
    e = spark.createDataFrame([(k, (k * 7 + j) % 60, 1.0 + j) for k in range(50) for j in range(1, 5)], "src long, dst long, weight double")
    s = spark.createDataFrame([(q, q % 3 * 5, 1.0 + q) for q in range(9)] + [(9, 0, 1.0), (9, 1, 1.0)], "query long, id long, weight double")
    step = np.zeros((60, 60))
    for k in range(50):
        for j in range(1, 5):
            step[(k * 7 + j) % 60, k] += (1.0 + j) / 14
    staged = []
    monkeypatch.setattr(graph, "stage", lambda df, name, *rest: staged.append(name) or stage(df, name, *rest))
    for sizes in ((60, 64, 1 << 20), (7, 2, 1 << 20), (30, 64, 60)):
        for name, size in zip(("PIECE", "COLUMNS", "CELLS"), sizes, strict=True):
            monkeypatch.setattr(graph, name, size)
        assert graph.alike_seeds(s.select("query", "id", F.lit(1.0).alias("p"))).select("first").distinct().count() == 4
        got = {(r["query"], r["id"]): r["rank"] for r in graph.personalized(e, s, rounds=2, least=0.0).collect()}
        for q in range(10):
            p = np.zeros(60)
            p[[0, 1] if q == 9 else [q % 3 * 5]] = 0.5 if q == 9 else 1.0
            r = p
            for _ in range(2):
                x = step @ r
                r = 0.85 * x + p * (0.15 + 0.85 * (1 - x.sum()))
            assert np.allclose([got.get((q, i), 0.0) for i in range(60)], r, atol=1e-12)
    best = graph.personalized(e, s, rounds=2, least=0.0, most=3).collect()
    for q in range(10):
        want = sorted((-round(v, 9), i) for (p, i), v in got.items() if p == q)[:3]
        assert sorted((-round(r["rank"], 9), r["id"]) for r in best if r["query"] == q)[:3] == want
    assert staged.count("flow") == 3 * 2 + 2


def test_texts_that_went_are_not_cut(spark, monkeypatch):
    cut = {}
    monkeypatch.setattr(index_queries, "stage", lambda df, name, *rest: cut.update({name: (df.count(), df.columns)}) or stage(df, name, *rest))
    rows = {r["what"]: r["rows"] for r in QUERIES["incremental_work"](spark, "/root/testdata/sf0.001").collect()}
    assert cut["before"][0] + cut["fresh"][0] == rows["files"] and cut["before"][1] == cut["fresh"][1] == ["n"]


def test_only_symbols_that_questions_meet_get_chunks_for_answers(spark, monkeypatch):
    seen, plain = [], search.chunks_of
    monkeypatch.setattr(search, "chunks_of", lambda symbols, chunks, *rest: seen.append((symbols.count(), chunks.filter("symbol <> ''").count())) or plain(symbols, chunks, *rest))
    QUERIES["answer_rates"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and 0 < seen[0][0] < seen[0][1] / 4


def test_sources_are_read_on_all_cores_and_ends_only_where_they_are_asked_for(spark, monkeypatch):
    staged = {}
    monkeypatch.setattr(source_queries, "stage", lambda df, name, *rest: staged.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or stage(df, name, *rest))
    for query, names in (("innermost_symbol", ["sources", "symbols"]), ("source_chunks", ["sources", "symbols", "ends"])):
        staged.clear()
        QUERIES[query](spark, "/root/testdata/sf0.001")
        assert list(staged) == names and "Repartition" in staged["symbols"]


def test_methods_behind_another_of_their_file_are_not_merged(spark, monkeypatch):
    kinds = ["function", "function", "class", "fallback"]
    rows = []
    for i in range(240):
        kind, symbol = kinds[i % 7 % 4], f"on_go{i % 4}" if i % 5 else f"C{i % 2}"
        rows.append((i, f"src/a/m{i % 6}.c", 20 * i, 20 * i + 9, kind, symbol if kind != "fallback" else "", f"C{i % 2}" if kind == "function" and i % 3 else "", 20 * i - (i % 11 == 0), f"{symbol} C{i % 2} w{i}"))
    chunks = stage(spark.createDataFrame(rows, "chunk long, file string, start long, end long, type string, symbol string, class string, symbol_start long, text string"), "chunks")
    symbols = stage(chunks.filter("symbol <> ''").select("file", F.col("symbol").alias("name"), F.col("type").alias("kind"), "class", F.col("symbol_start").alias("line")).distinct(), "symbols")
    asked = stage(search.ask(spark.createDataFrame([(1, "模块系统 C1 register w7"), (2, "模块系统 C0 C1 register on_go1"), (3, "C1 on_go2"), (4, "模块系统 C1 register w7")], "query long, text string")), "asked")
    entries = spark.createDataFrame([("G1", "src/a/m1.c", 21, True)], "command string, file string, line long, sure boolean")
    lines = chunks.select("file", F.col("start").alias("line"), "text")
    methods = search.class_chunks(search.chunks_of(symbols.filter("kind = 'function' AND class <> ''"), chunks, lines=False), chunks)
    first = [r["chunk"] for r in search.leading(methods, chunks).select("chunk").distinct().collect()]
    assert 0 < len(first) < methods.select("chunk").distinct().count() / 3
    # A vector channel that takes points from those that would come first.
    for dense in ([(1, c, 3.0 + c % 5) for c in range(0, 240, 30)], [(1, c, -30.0) for c in first[: len(first) // 2]]):
        sizes, out = [], []
        monkeypatch.setattr(engine, "stage", lambda df, name, *rest: sizes.append(df.count()) or stage(df, name, *rest) if name == "merged" else stage(df, name, *rest))  # noqa: B023
        for whole in (True, False):
            _, ranked, kept, behind = engine.run_alike(asked, chunks, symbols, entries, lines, spark.createDataFrame(dense, "query long, chunk long, score double"), 3, whole)
            gone = search.drop_reason(ranked, kept, 3)
            gone = gone if whole else gone.unionByName(behind.withColumn("reason", F.lit("file")))
            out.append((sorted(map(tuple, kept.select("query", "rank", "chunk", "score", "source", "line_start", "snippet").collect())), sorted(map(tuple, gone.collect()))))
        assert out[0] == out[1] and out[0][0] and len({r for _, _, r in out[0][1]}) == 2 and sizes[1] < sizes[0]


def test_rows_are_scored_in_pieces(spark, monkeypatch):
    texts = [f"aB_c w{i % 7} x{i % 3} x{i % 11} y{i}" if i % 10 else None for i in range(90)]
    p = spark.createDataFrame([(i, None if x is None else [*dict.fromkeys(x.lower().split())]) for i, x in enumerate(texts)], "key long, t array<string>").coalesce(1)
    terms = [(q, w, 0.3 + len(w) * 0.1 + q * 0.01, 4.5) for q in range(6) for w in [f"w{q}", f"x{q % 3}", "ab_c", f"y{q * 7}", "gone"]]
    q = spark.createDataFrame(terms, "query long, token string, idf double, avg_len double")
    want = {}
    for key, t in p.collect():
        for query in range(6):
            s = sum(idf * 2.5 for of, w, idf, _ in terms if of == query and w in (t or []))
            if s:
                want.setdefault(query, []).append((-round(s / (1 + 1.5 * (0.25 + 0.75 * len(t) / 4.5)), 9), key))
    want = sorted((of, key, -s) for of, rows in want.items() for s, key in sorted(rows)[:4])
    for cells in (1, 64, 1 << 20):
        monkeypatch.setattr(retrieval, "RUN_CELLS", cells)
        assert sorted((r["query"], r["key"], r["s"]) for r in retrieval._scored(p, q, 4, 1.5, 0.75).collect()) == want


def test_words_are_cut_alike(spark):
    texts = ["run G-Code G-code G->Code", "a::B->c fooBar_baz Ünï éa1 x١٢ ٣٤ 9a __x", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(text.tokens(F.col("x"))).collect()]
    assert got == [["run", "gcode", "code"], ["foobar_baz", "foo", "bar_baz", "foobar", "baz", "nï", "a1", "x١٢", "٣٤", "__x"], [], None]


def test_sparse_traces_get_wide_buckets(spark, monkeypatch):
    rows = []
    for trace in range(4):
        for k in range(40):
            at, f = k * 5_000_000 + trace, f"f{k % 3}"
            rows += [(trace, at, 0, f, 1), (trace, at, 1, f, 1), (trace, at + 5, 0, "g", 1), (trace, at + 9, 0, "g", -1), (trace, at + 9, 1, f, -1), (trace, at + 20, 0, f, -1)]
    log = spark.createDataFrame([*rows, (9, 7, 0, "open", 1)], "trace long, at long, n int, func string, up int")
    assert stats.bucket_width(log, "trace", "at", 10) > 39 * 5_000_000
    dense = spark.createDataFrame([(1, i) for i in range(300)], "trace long, at long")
    monkeypatch.setattr(stats, "BUCKET_ROWS", 8)
    assert stats.bucket_width(dense.unionByName(spark.createDataFrame([(2, 5), (2, 900_000)], "trace long, at long")), "trace", "at", 2) == 7
    want = {(f"f{i}", 8 * n, 4 * n, 4 * n * 16, 4 * n * 20) for i, n in enumerate((14, 13, 13))} | {("g", 160, 160, 160 * 4, 160 * 4), ("open", 1, 1, 0, 7 - 7)}
    for most in (1, 1 << 15):
        monkeypatch.setattr(stats, "BUCKET_ROWS", most)
        got = {tuple(r) for r in stats.call_times(log, 1000).select("func", "calls", "outer_calls", "own", "total").collect()}
        assert got == want


def test_texts_that_are_blown_up_go_in_pieces(spark, monkeypatch):
    d, seen = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), []
    assert pieces(d, 5000).rdd.getNumPartitions() == -(-input_bytes(d) // 5000) > 4 and pieces(d).rdd.getNumPartitions() == 4
    monkeypatch.setattr(queries, "pieces", lambda df, *rest: seen.append(df.columns) or pieces(df, *rest))
    QUERIES["mention_edges"](spark, "/root/testdata/sf0.001")
    assert seen == [["doc_id", "text"]]


def test_a_small_graph_is_walked_by_one_task_to_a_block(spark, monkeypatch):
    e = spark.createDataFrame([(k, (k * 7 + j) % 60, 1.0 + j) for k in range(50) for j in range(1, 5)], "src long, dst long, weight double")
    s = spark.createDataFrame([(q, q * 5 % 60, 1.0 + q) for q in range(11)], "query long, id long, weight double")
    staged, best = [], lambda d: {(r["query"], r["id"]): round(r["rank"], 9) for r in d.collect()}
    monkeypatch.setattr(graph, "stage", lambda df, name, *rest: staged.append(name) or stage(df, name, *rest))
    for columns, near in ((2, 5), (64, 1 << 11)):
        monkeypatch.setattr(graph, "COLUMNS", columns)
        monkeypatch.setattr(graph, "NEAR", near)
        for least in (0.0, 1e-3):
            whole = best(graph.personalized(e, s, rounds=5, least=least, most=7))
            assert "flow" not in staged and "lanes" in staged
            with monkeypatch.context() as m:
                m.setattr(graph, "WHOLE", 0)
                assert whole == best(graph.personalized(e, s, rounds=5, least=least, most=7)) and "flow" in staged
            staged.clear()


def test_flows_are_not_broadcast_by_their_size_on_disk(spark, monkeypatch):
    # Almost all of a flow is zeros, so its files are small: it must not go through the driver.
    e = spark.createDataFrame([(k, k + 1, 1.0) for k in range(300)], "src long, dst long, weight double")
    s = spark.createDataFrame([(q, q, 1.0) for q in range(64)], "query long, id long, weight double")
    joined = []
    monkeypatch.setattr(graph, "WHOLE", 0)
    monkeypatch.setattr(graph, "stage", lambda df, name, *rest: joined.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df, name, *rest) if name == "flow" else stage(df, name, *rest))
    graph.personalized(e, s, rounds=2, most=3)
    assert "SortMergeJoin [piece" in joined[-1]


def test_places_count_methods_left_aside(spark, monkeypatch):
    # Classes of many methods in few files; chunks without a class of their own, and a name that two classes have.
    rows = []
    for i in range(300):
        kind, symbol = ("function", "function", "class", "file_overview")[i % 7 % 4], f"on_go{i % 5}" if i % 4 else f"run{i % 3}"
        owner = "" if i % 10 == 3 else f"C{i % 3}"
        rows.append((i, f"src/a/m{i % 5}.c", 20 * i, 20 * i + 9, kind, symbol if kind != "file_overview" else "", owner if kind == "function" else "", 20 * i - (i % 11 == 0), f"{symbol} {owner} w{i}"))
    chunks = stage(spark.createDataFrame(rows, "chunk long, file string, start long, end long, type string, symbol string, class string, symbol_start long, text string"), "chunks")
    symbols = stage(chunks.filter("symbol <> ''").select("file", F.col("symbol").alias("name"), F.col("type").alias("kind"), "class", F.col("symbol_start").alias("line")).distinct(), "symbols")
    asked = stage(search.ask(spark.createDataFrame([(1, "模块系统 C1 register w7"), (2, "模块系统 C0 C1 register on_go1 w11"), (3, "C1 on_go2"), (4, "模块系统 C2 m3 register")], "query long, text string")), "asked")
    entries, lines = spark.createDataFrame([("G1", "src/a/m1.c", 21, True)], "command string, file string, line long, sure boolean"), chunks.select("file", F.col("start").alias("line"), "text")
    dense = spark.createDataFrame([(q, c, s * (c % 4 - 1.0)) for q in (1, 2, 4) for c, s in zip(range(q, 300, 13), [9.0, -45.0] * 20, strict=False)], "query long, chunk long, score double")
    monkeypatch.setattr(search, "LIST", 7)
    _, every, _, _ = engine.run_alike(asked, chunks, symbols, entries, lines, dense, 4)
    want = {(r["query"], r["chunk"]): r["place"] for r in every.collect()}
    _, ranked, kept, aside = engine.run_aside(asked, chunks, symbols, entries, lines, dense, 4)
    short = {(r["query"], r["chunk"]): r["place"] for r in ranked.collect()}
    got = {(r["query"], r["chunk"]): r["place"] for r in aside.placed(ranked).collect()}
    assert len(got) < len(want) and got == {k: want[k] for k in got} != short
    assert sorted(map(tuple, aside.hits().collect())) == sorted(want.keys() - got.keys())
    assert aside.methods.filter("n > 1").count()
    # At no weight of the vectors is one of them among the best.
    expected = every.select("query", "file").distinct()
    sweep = lambda hits: sorted(map(tuple, engine.weight_sweep(hits, expected, [0, 5, 20, 25], k=3).collect()))
    assert sweep(every) == sweep(ranked)


def test_searches_that_keep_one_hit_of_a_file_do_not_merge_the_rest(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(search, "class_methods", lambda *a: seen.append(a))
    for name in ("dominant_channels", "named_file_check", "why_not_recalled", "dense_weight_sweep"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not seen


def test_tables_are_taken_for_as_large_as_they_are_in_memory(spark):
    # 400,000 rows are some hundred KB in their file, and tens of MB as a broadcast relation.
    few = stage(spark.range(400_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"), F.lit("src/a/long_name.cpp").alias("file")), "packed")
    size, factor = input_bytes(few), spark.conf.get(FACTOR)
    joined = lambda: stage(spark.range(10), "other").withColumnRenamed("id", "k").join(few.select("*"), "k", "left")._jdf.queryExecution().sparkPlan().toString()
    try:
        spark.conf.set(FACTOR, "1.0")
        assert "BroadcastHashJoin" in joined()
        sized_as_held(spark)
        few = spark.read.schema(few.schema).parquet(few.inputFiles()[0].rsplit("/", 1)[0])
        assert "BroadcastHashJoin" not in joined() and abs(input_bytes(few) - size) < 1000
    finally:
        spark.conf.set(FACTOR, factor)


def test_a_class_of_many_chunks_is_dealt(spark, monkeypatch):
    # One class that all questions name: its chunks go in lists to as many partitions, each pair comes once.
    chunks = spark.createDataFrame([(i, f"src/a/m{i}.c", 0, 5, "function", "run", "C1" if i % 9 else "C2", 0, "run") for i in range(200)], "chunk long, file string, start long, end long, type string, symbol string, class string, symbol_start long, text string")
    symbols = chunks.select("file", F.col("symbol").alias("name"), F.lit("function").alias("kind"), "class", F.col("start").alias("line"))
    asked = search.ask(spark.createDataFrame([(i, "模块系统 C1 C2 register") for i in range(30)], "query long, text string"))
    monkeypatch.setattr(search, "LIST", 16)
    got = search.class_methods(asked, symbols, search.chunks_of(symbols, chunks), chunks)
    assert sorted((r["query"], r["chunk"]) for r in got.collect()) == [(q, c) for q in range(30) for c in range(200)]
    assert got.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 4
