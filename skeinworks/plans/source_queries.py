"""Symbols, chunks, commands and their handlers of C++ sources that are written from the parts.

Eight parts are a file; a part's key says which of eight pieces it writes and its size how long. As the pieces' definitions are
known, SQL states what the lexer must find without reading a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.functions import text as T
from skeinworks.operators import code, symbols
from skeinworks.plans.queries import query
from skeinworks.plans.stage import spread, stage

# What a part of each remainder by 8 writes: @k its key, @s its size by 60, @m its key by 90, @fill a line for each of size by 5.
PIECES = [
    "#define LIMIT_@k \\\n  (@s) // {\n",
    'static int\nrun_@k(int a,\n    const char* s = "}{")\n{ // }\n@fill}\n',
    "class C@k : public Base<int, 3>\n{\npublic:\n    C@k() : x_(1), y_{2} { /* } */ }\n    virtual void go(int) = 0;\n    struct In { int z; };\n    enum Kind { A, B };\nprivate:\n    int x_, y_;\n};\n",
    "template <typename T, int N = (3 > 2)>\nvoid C@k::on_gcode(Gcode* gcode)\n{\n@fill    switch (gcode->g) {\n    case @s: { go(); } break;\n    }\n    if (gcode->m == @m.50) halt(); // gcode->g\n}\n",
    "#if 0\nvoid dead_@k() {\n#else\nvoid live_@k() {\n#endif\n    if (gcode->has_letter('M')) n = gcode->get_value('M');\n}\n",
    "typedef unsigned int u@k_t;\ntypedef void (*call@k)(int);\nusing vec@k = std::vector<int>;\nextern int proto_@k(\n    double x);\n",
    'const char* r@k = R"x(\nvoid not_@k() { )" }\n)x";\nchar q@k = \'{\';\nint table_@k[] = {1, 2,\n @s};\n',
    "typedef struct {\n  int a;\n} S@k;\nbool operator==(const S@k& a, int b) {\n@fill    return gcode->m == this->code_@k; }\nvoid set() { this->code_@k = config->by_default(@m.0)->as_number(); }\n",
]
FILL = "    f('}'); /* { */\n"

SQL_SOURCES = r"""p AS (SELECT p_partkey AS k, p_partkey // 8 AS f, p_partkey % 8 AS i, p_size % 60 AS s, p_partkey % 90 AS m, p_size % 5 AS n FROM part),
  h AS (SELECT *, [2, 5 + n, 10, 8 + n, 7, 5, 6, 6 + n][i + 1] AS height FROM p), o AS (SELECT *, 2 + coalesce(sum(height) OVER (PARTITION BY f ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM h),
  fs AS (SELECT f, 'src/w' || f % 10 || '/f' || f || CASE WHEN f % 4 = 3 THEN '.h' ELSE '.cpp' END AS file, 'ns' || f % 7 AS ns, sum(height) + 3 AS n_lines FROM o GROUP BY f),
  d AS (SELECT f, k, i, n, s, m, o, unnest(CASE i WHEN 0 THEN [{'n': 'LIMIT_' || k, 'c': 'macro', 'a': 1, 'b': 2, 'w': NULL, 't': ''}] WHEN 1 THEN [{'n': 'run_' || k, 'c': 'function', 'a': 2, 'b': 5 + n, 'w': '', 't': 'namespace'}]
      WHEN 2 THEN [{'n': 'C' || k, 'c': 'class', 'a': 1, 'b': 10, 'w': '', 't': 'namespace'}, {'n': 'C' || k, 'c': 'function', 'a': 4, 'b': 4, 'w': '::C' || k, 't': 'class'}, {'n': 'go', 'c': 'prototype', 'a': 5, 'b': 5, 'w': '::C' || k, 't': 'class'},
        {'n': 'In', 'c': 'struct', 'a': 6, 'b': 6, 'w': '::C' || k, 't': 'class'}, {'n': 'Kind', 'c': 'enum', 'a': 7, 'b': 7, 'w': '::C' || k, 't': 'class'}]
      WHEN 3 THEN [{'n': 'on_gcode', 'c': 'function', 'a': 2, 'b': 8 + n, 'w': '::C' || k, 't': 'class'}] WHEN 4 THEN [{'n': 'live_' || k, 'c': 'function', 'a': 4, 'b': 7, 'w': '', 't': 'namespace'}]
      WHEN 5 THEN [{'n': 'u' || k || '_t', 'c': 'typedef', 'a': 1, 'b': 1, 'w': '', 't': 'namespace'}, {'n': 'call' || k, 'c': 'typedef', 'a': 2, 'b': 2, 'w': '', 't': 'namespace'}, {'n': 'vec' || k, 'c': 'typedef', 'a': 3, 'b': 3, 'w': '', 't': 'namespace'},
        {'n': 'proto_' || k, 'c': 'prototype', 'a': 4, 'b': 5, 'w': '', 't': 'namespace'}]
      WHEN 7 THEN [{'n': 'S' || k, 'c': 'typedef', 'a': 3, 'b': 3, 'w': '', 't': 'namespace'}, {'n': 'operator ==', 'c': 'function', 'a': 4, 'b': 5 + n, 'w': '', 't': 'namespace'}, {'n': 'set', 'c': 'function', 'a': 6 + n, 'b': 6 + n, 'w': '', 't': 'namespace'}] ELSE [] END) AS x FROM o),
  y AS (SELECT file, n_lines, x.n AS name, x.c AS kind, CAST(o + x.a AS BIGINT) AS line, CAST(o + x.b AS BIGINT) AS end_line, CASE WHEN x.w IS NULL THEN '' ELSE ns || x.w END AS class, x.t AS scope_kind FROM d JOIN fs USING (f)),
  ey AS (SELECT file, chr(47) AS sl, name, kind, class, line, least(end_line, n_lines) AS "end" FROM y)"""


def sources(t) -> DataFrame:
    """(file, top_dir, text): each file's pieces between an include and the end of its namespace."""
    p = t("part").select(F.col("p_partkey").alias("k"), F.expr("p_partkey div 8").alias("f"), (F.col("p_partkey") % 8).cast("int").alias("i"), F.col("p_size").alias("s"))
    places = {"@k": F.col("k").cast("string"), "@s": (F.col("s") % 60).cast("string"), "@m": (F.col("k") % 90).cast("string"), "@fill": F.repeat(F.lit(FILL), (F.col("s") % 5).cast("int"))}
    piece = F.get(F.array(*(F.lit(x) for x in PIECES)), F.col("i"))
    for place, value in places.items():
        piece = F.replace(piece, F.lit(place), value)
    body = p.select("f", "k", piece.alias("x")).groupBy("f").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda y: y["x"]), "").alias("body"))
    number = F.col("f").cast("string")
    top = F.concat(F.lit("w"), (F.col("f") % 10).cast("string"))
    file = F.concat(F.lit("src/"), top, F.lit("/f"), number, F.when(F.col("f") % 4 == 3, ".h").otherwise(".cpp"))
    text = F.concat(F.lit('#include "a.h"\nnamespace ns'), (F.col("f") % 7).cast("string"), F.lit(" {\n"), "body", F.lit("}\n"))
    return stage(body.select(file.alias("file"), F.lit("src").alias("top_dir"), text.alias("text")), "sources")


def lexed(s: DataFrame) -> DataFrame:
    """The sources' symbols; sources are small for the work that they are, so all cores read them."""
    return stage(symbols.symbols(spread(s)), "symbols")


def parsed(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files with lines, symbols, their ends)."""
    s = sources(t)
    found = lexed(s)
    files = s.select("file", "top_dir", T.lines(F.col("text")).alias("lines"))
    return files, found, stage(code.symbol_ends(files, found), "ends")


@query(f"WITH {SQL_SOURCES} SELECT file, name, kind, line, end_line, class, scope_kind FROM y")
def source_symbols(t):
    return symbols.symbols(spread(sources(t)))


SQL_SOURCE_CHUNKS = SQL_SOURCES + r""", sc AS (SELECT file, line, "end", name, kind, class, CASE kind WHEN 'function' THEN 'function' ELSE 'class' END AS type FROM ey WHERE (kind = 'function' AND ends_with(file, '.cpp')) OR (kind IN ('class', 'struct') AND ends_with(file, '.h')))"""


@query(
    f"WITH {SQL_SOURCE_CHUNKS}"
    r""", z AS (SELECT file, line AS start, "end", type, name AS symbol, kind, class, line AS symbol_start FROM sc
    UNION ALL SELECT file, 1 + w * 80, least(w * 80 + 100, n_lines), 'fallback', '', '', '', NULL FROM (SELECT file, n_lines, unnest(range(0, CAST(greatest(0, ceil((n_lines - 100) / 80)) AS BIGINT) + 1)) AS w FROM fs WHERE file NOT IN (SELECT file FROM sc))
    UNION ALL SELECT file, 1, least(40, n_lines), 'file_overview', '', 'file_overview', '', NULL FROM fs)
  SELECT regexp_replace(file, '[/\\.]', '_', 'g') || '::' || start || '-' || "end" || CASE type WHEN 'file_overview' THEN '::overview' ELSE '' END AS id, type, file, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", symbol, kind, class, CAST(symbol_start AS BIGINT) AS symbol_start FROM z"""
)
def source_chunks(t):
    files, _, ends = parsed(t)
    return code.chunks(files, ends).select("id", "type", "file", "start", "end", "symbol", "kind", "class", "symbol_start")


SQL_ENTRIES = SQL_SOURCES + r""", e AS (SELECT f, k, o + 5 + n AS line, 'G' || s AS command, 'switch-case' AS confidence FROM o WHERE i = 3 UNION ALL SELECT f, k, o + 7 + n, 'M' || m || '.5', 'static-pattern' FROM o WHERE i = 3
    UNION ALL SELECT f, k, o + 6, 'unknown', 'dynamic-letter-value' FROM o WHERE i = 4 UNION ALL SELECT f, k, o + 5 + n, 'M' || m, 'config-default' FROM o WHERE i = 7)"""


def entries(t) -> tuple[DataFrame, DataFrame]:
    """(dispatch entries of the sources' functions, ends of their symbols)."""
    files, _, ends = parsed(t)
    lines = stage(files.select("file", F.posexplode("lines").alias("p", "text")).select("file", (F.col("p") + 1).cast("long").alias("line"), "text"), "lines")
    own = ends.filter("kind = 'function'").select("file", F.concat_ws("::", "file", "line").alias("chunk"), F.explode(F.sequence("line", "end")).alias("line"))
    return code.dispatch(lines.join(own, ["file", "line"]), code.dispatch_defaults(lines)), ends


@query(f"WITH {SQL_ENTRIES}" r""" SELECT file, CAST(line AS BIGINT) AS line, command, confidence, CASE i WHEN 3 THEN ns || '::C' || k || '::on_gcode' WHEN 4 THEN ns || '::live_' || k ELSE ns || '::operator ==' END AS handler FROM e JOIN fs USING (f) JOIN (SELECT k, i FROM p) USING (k)""")
def dispatch_handlers(t):
    found, ends = entries(t)
    return code.handlers(found.select("file", "line", "command", "confidence"), ends)


@query(
    f"WITH {SQL_SOURCES}"
    r""", l AS (SELECT file, unnest(range(1, CAST(n_lines AS BIGINT) + 1)) AS line FROM fs), w AS (SELECT l.file, l.line, arg_min(struct_pack(n := name, s := y.line), (end_line - y.line, -y.line, name)) AS x FROM l JOIN y ON y.file = l.file AND l.line BETWEEN y.line AND y.end_line WHERE kind <> 'macro' GROUP BY 1, 2)
  SELECT l.file, l.line, x.n AS name, x.s AS start FROM l LEFT JOIN w ON w.file = l.file AND w.line = l.line"""
)
def innermost_symbol(t):
    """Of every line of the sources the smallest symbol around it."""
    s = sources(t)
    lines = s.select("file", F.explode(F.sequence(F.lit(1).cast("long"), F.size(T.lines(F.col("text"))).cast("long"))).alias("line"))
    ranges = lexed(s).filter("kind <> 'macro'").select("file", F.col("line").alias("start"), F.col("end_line").alias("end"), "name")
    return symbols.enclosing(lines, ranges, step=16).select("file", "line", F.col("inner.name").alias("name"), F.col("inner.start").alias("start"))
