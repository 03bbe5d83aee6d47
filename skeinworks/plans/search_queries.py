"""Search over a table of chunks and symbols made of the parts: channels, fusion, hits and what became of them.

A part is a chunk of lines of a file; its type says what kind. Every fiftieth part asks a question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions import rules
from skeinworks.operators import engine, retrieval, search
from skeinworks.plans.code_queries import SQL_HINTS, sql_any
from skeinworks.plans.queries import SQL_TOKENS, query
from skeinworks.plans.stage import stage

# --- the model: chunks, symbols, questions ------------------------------------------------------------

SQL_CODE = r"""b AS (SELECT p_partkey AS chunk, p_name, p_size, p_type, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) || '_' || ((p_partkey // 5) % 40) AS stem,
    CASE p_partkey % 5 WHEN 3 THEN '.h' WHEN 4 THEN '.c' ELSE '.cpp' END AS ext, replace(p_name, ' ', '_') || '_' || (p_partkey % 300) AS sym, 'C' || replace(p_brand, '#', '') AS cls, 1 + (p_partkey // 200) * 60 AS start FROM part),
  k AS (SELECT *, 'src/' || w1 || '/' || stem || ext AS file, start + p_size AS "end", CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'MEDIUM') THEN 'function' WHEN p_type = 'PROMO' THEN 'class' WHEN p_type = 'LARGE' THEN 'file_overview' ELSE 'fallback' END AS type FROM b),
  c AS (SELECT chunk, file, start, "end", type, CASE WHEN type IN ('function', 'class') THEN sym ELSE '' END AS symbol, CASE WHEN type <> 'function' THEN '' WHEN p_size % 7 = 0 THEN sym WHEN p_size % 3 = 0 THEN cls ELSE '' END AS class,
    CASE WHEN p_size % 4 = 0 THEN start - 1 ELSE start END AS symbol_start, p_name, p_size, stem, concat_ws(' ', sym, cls, p_name, stem) AS text FROM k),
  s AS (SELECT DISTINCT file, symbol AS name, type AS kind, class, symbol_start AS line FROM c WHERE type IN ('function', 'class') UNION SELECT file, 'LIMIT_' || chunk % 100, 'macro', '', CASE WHEN p_size % 2 = 0 THEN start + 59 ELSE start + 1 END FROM c WHERE type = 'file_overview'),
  d AS (SELECT 'G' || chunk % 30 AS command, file, start + 1 AS line, p_size % 2 = 0 AS sure FROM c WHERE type = 'function' AND p_size % 5 = 0),
  qs AS (SELECT chunk AS query, CASE (chunk // 50) % 7 WHEN 0 THEN 'where is ' || cls || '::' || sym || ' defined' WHEN 1 THEN '如何 ' || sym || ' ' || stem || ' planner' WHEN 2 THEN sym || ' implemented in ' || cls || ' limit_' || chunk % 100
    WHEN 3 THEN 'G' || chunk % 30 || ' 命令 ' || stem WHEN 4 THEN '模块系统 ' || cls || ' register ' || p_name WHEN 5 THEN 'stop ' || p_name || ' ' || cls || ' ' || sym ELSE sym || '::' || sym || ' 注册 ' || cls END AS text FROM k WHERE chunk % 50 = 0),
  low AS (SELECT *, replace(lower(text), 'g-code', 'gcode') AS l FROM qs), """ + SQL_TOKENS.replace("{}", "low") + ", a AS (SELECT *, list_distinct(list_concat(t, " + ", ".join(
    f"CASE WHEN {c} THEN [" + ", ".join(f"'{s.lower()}'" for s in rules.SEEDS[k]) + "] ELSE CAST([] AS VARCHAR[]) END" for k, c in SQL_HINTS.items()
) + ")) AS x, " + " OR ".join(SQL_HINTS[k] for k in ("motion_structure", "halt", "module")) + f" AS structure, {SQL_HINTS['entry']} AS entry, {sql_any('l', rules.FLOW_WORDS)} AS flow, {SQL_HINTS['module']} AS modular FROM toks)" + r""",
  w AS (SELECT query, unnest(x) AS token FROM a)"""


def code(t) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(chunks, symbols, dispatch entries, asked questions)."""
    key, size = F.col("p_partkey"), F.col("p_size")
    b = t("part").select(
        key.alias("chunk"), "p_name", "p_size", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w1"),
        F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("_"), F.expr("p_partkey div 5 % 40").cast("string")).alias("stem"),
        F.when(key % 5 == 3, ".h").when(key % 5 == 4, ".c").otherwise(".cpp").alias("ext"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), (key % 300).cast("string")).alias("sym"),
        F.concat(F.lit("C"), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("cls"), F.expr("1 + p_partkey div 200 * 60").alias("start"),
        F.when(F.col("p_type").isin("ECONOMY", "STANDARD", "MEDIUM"), "function").when(F.col("p_type") == "PROMO", "class").when(F.col("p_type") == "LARGE", "file_overview").otherwise("fallback").alias("type"),
    )
    k = b.withColumn("file", F.concat(F.lit("src/"), "w1", F.lit("/"), "stem", "ext")).withColumn("end", F.col("start") + size)
    owner = F.when(F.col("type") != "function", "").when(size % 7 == 0, F.col("sym")).when(size % 3 == 0, F.col("cls")).otherwise("")
    chunks = k.select(
        "chunk", "file", "start", "end", "type", F.when(F.col("type").isin("function", "class"), F.col("sym")).otherwise("").alias("symbol"), owner.alias("class"),
        F.when(size % 4 == 0, F.col("start") - 1).otherwise(F.col("start")).alias("symbol_start"), F.concat_ws(" ", "sym", "cls", "p_name", "stem").alias("text"), "p_size",
    )
    named = chunks.filter(F.col("type").isin("function", "class")).select("file", F.col("symbol").alias("name"), F.col("type").alias("kind"), "class", F.col("symbol_start").alias("line"))
    macros = chunks.filter("type = 'file_overview'").select("file", F.concat(F.lit("LIMIT_"), (F.col("chunk") % 100).cast("string")).alias("name"), F.lit("macro").alias("kind"), F.lit("").alias("class"), F.when(size % 2 == 0, F.col("start") + 59).otherwise(F.col("start") + 1).alias("line"))
    entries = chunks.filter("type = 'function' AND p_size % 5 = 0").select(F.concat(F.lit("G"), (F.col("chunk") % 30).cast("string")).alias("command"), "file", (F.col("start") + 1).alias("line"), (size % 2 == 0).alias("sure"))
    n, hundred, thirty = F.expr("chunk div 50 % 7"), (F.col("chunk") % 100).cast("string"), (F.col("chunk") % 30).cast("string")

    def say(*parts):
        return F.concat(*(F.lit(p) if p not in ("cls", "sym", "stem", "p_name") else F.col(p) for p in parts)) if all(isinstance(p, str) for p in parts) else F.concat(*parts)

    text = (
        F.when(n == 0, say("where is ", "cls", "::", "sym", " defined")).when(n == 1, say("如何 ", "sym", " ", "stem", " planner")).when(n == 2, F.concat(say("sym", " implemented in ", "cls", " limit_"), hundred))
        .when(n == 3, F.concat(F.lit("G"), thirty, F.lit(" 命令 "), "stem")).when(n == 4, say("模块系统 ", "cls", " register ", "p_name")).when(n == 5, say("stop ", "p_name", " ", "cls", " ", "sym")).otherwise(say("sym", "::", "sym", " 注册 ", "cls"))
    )
    asked = search.ask(k.filter("chunk % 50 = 0").select(F.col("chunk").alias("query"), text.alias("text")))
    return stage(chunks.drop("p_size"), "chunks"), stage(named.unionByName(macros).distinct(), "symbols"), entries, stage(asked, "asked")


# --- channels -----------------------------------------------------------------------------------------

SQL_OF = (
    SQL_CODE
    + r""", sy AS (SELECT DISTINCT file, name, class, line, kind FROM s), nm AS (SELECT sy.*, chunk, type, start FROM sy JOIN c ON c.file = sy.file AND c.symbol = sy.name WHERE sy.class = '' OR c.class = '' OR sy.class = c.class),
  lf AS (SELECT * FROM sy ANTI JOIN nm USING (file, name, class, line)),
  pr AS (SELECT lf.*, chunk, type, start, row_number() OVER (PARTITION BY lf.file, lf.name, lf.class, lf.line ORDER BY CASE type WHEN 'function' THEN 4 WHEN 'class' THEN 3 WHEN 'fallback' THEN 2 ELSE 1 END DESC, "end" - start, start, chunk) AS r FROM lf JOIN c ON c.file = lf.file AND lf.line BETWEEN c.start AND c."end"),
  ov AS (SELECT file, arg_min(chunk, (start, chunk)) AS chunk, min(start) AS start FROM c WHERE type = 'file_overview' GROUP BY file),
  ofs AS (SELECT file, name, class, line, kind, chunk, type, start FROM nm UNION ALL SELECT file, name, class, line, kind, chunk, type, start FROM pr WHERE r = 1
    UNION ALL SELECT lf.file, name, class, line, kind, ov.chunk, 'file_overview', ov.start FROM lf ANTI JOIN pr USING (file, name, class, line) JOIN ov USING (file) WHERE kind IN ('macro', 'enum', 'typedef')),
  cx AS (SELECT *, type = 'function' AND regexp_matches(file, '\.(c|cc|cpp|cxx)$') AS impl FROM ofs), im AS (SELECT * FROM cx QUALIFY impl OR NOT bool_or(impl) OVER (PARTITION BY file, name, class, line))"""
)


@query(f"WITH {SQL_OF} SELECT file, name, class, line, chunk, type, impl FROM cx")
def symbol_chunks(t):
    chunks, symbols, _, _ = code(t)
    return search.chunks_of(symbols, chunks).select("file", "name", "class", "line", "chunk", "type", "impl")


SQL_METHOD = r"""mq AS (SELECT query, lower(unnest(regexp_extract_all(text, '\b(?:[A-Za-z_]\w*::)+[A-Za-z_]\w*\b'))) AS fl FROM a),
  lone AS (SELECT lower(name) AS token, any_value(file) AS file, any_value(name) AS name, any_value(class) AS class, any_value(line) AS line FROM sy WHERE kind = 'function' AND regexp_matches(file, '\.(c|cc|cpp|cxx)$') GROUP BY 1 HAVING count(DISTINCT (file, name, class, line)) = 1),
  ms AS (SELECT query, file, name, class, line FROM mq JOIN sy ON class <> '' AND lower(class || '::' || name) = fl
    UNION SELECT query, file, name, class, line FROM w JOIN a USING (query) JOIN lone USING (token) WHERE length(token) >= 4 AND NOT (list_contains(x, 'defined') AND NOT list_contains(x, 'implemented') AND token IN (SELECT lower(name) FROM sy WHERE kind IN ('class', 'struct')))),
  me AS (SELECT DISTINCT query, chunk, 125.0::DOUBLE AS score FROM ms JOIN im USING (file, name, class, line))"""
SQL_CLASS = """ct AS (SELECT DISTINCT query, token FROM w WHERE token IN (SELECT lower(class) FROM s WHERE class <> '' UNION SELECT lower(name) FROM s WHERE kind IN ('class', 'struct'))),
  cl AS (SELECT DISTINCT query, cx.chunk, 108.0::DOUBLE AS score FROM ct JOIN a USING (query) JOIN cx ON lower(cx.class) = token JOIN c ON c.chunk = cx.chunk WHERE structure AND cx.kind = 'function' AND impl AND NOT (c.symbol <> '' AND c.symbol = c.class))"""
SQL_SYMBOL = r"""fs AS (SELECT file, name, class, min(line) AS line FROM sy GROUP BY 1, 2, 3), eq AS (SELECT DISTINCT query, file, name, class, line FROM (SELECT query, lower(unnest(regexp_extract_all(text, '[A-Za-z_]\w*::[A-Za-z_]\w*'))) AS fl FROM a) JOIN fs ON class <> '' AND lower(class || '::' || name) = fl),
  pl AS (SELECT DISTINCT query, file, name, class, line FROM w JOIN fs ON lower(name) = token WHERE length(token) >= 3),
  pw AS (SELECT query, chunk, CASE WHEN kind IN ('macro', 'enum', 'typedef') THEN 110.0 WHEN (list_contains(x, sm) OR list_contains(x, lower(class)) OR len(list_filter(x, lambda v: length(v) >= 4 AND contains(sm, v))) > 0)
      AND ((entry AND name = 'on_main_loop') OR (flow AND starts_with(name, 'on_') AND start = line)) THEN 92.0 ELSE 85.0 END AS score
    FROM (SELECT * FROM pl ANTI JOIN eq USING (query, file, name, class)) JOIN cx USING (file, name, class, line) JOIN a USING (query), (SELECT 1), LATERAL (SELECT lower(regexp_extract(file, '([^/]*)\.[^./]*$', 1)) AS sm)),
  sb AS (SELECT query, chunk, max(score)::DOUBLE AS score FROM (SELECT query, chunk, 100.0 AS score FROM eq JOIN cx USING (file, name, class, line) UNION ALL SELECT query, chunk, score FROM pw) GROUP BY 1, 2)"""
SQL_DISPATCH = r"""dq AS (SELECT DISTINCT query, upper(regexp_replace(unnest(regexp_extract_all(text, '(?i)\b[GM]\s*[-:]?\s*\d+(?:\.\d+)?\b')), '[\s:\-]', '', 'g')) AS command FROM a),
  da AS (SELECT d.*, chunk FROM d JOIN c ON c.file = d.file AND d.line BETWEEN c.start AND c."end" QUALIFY row_number() OVER (PARTITION BY d.command, d.file, d.line, d.sure ORDER BY CASE type WHEN 'function' THEN 4 WHEN 'class' THEN 3 WHEN 'fallback' THEN 2 ELSE 1 END DESC, "end" - start, start, chunk) = 1),
  di AS (SELECT query, chunk, CAST(140 + max(CASE WHEN sure THEN 8 ELSE 4 END) AS DOUBLE) AS score, max(line) AS focus FROM dq JOIN da USING (command) GROUP BY 1, 2)"""


@query(f"WITH {SQL_OF}, {SQL_METHOD} SELECT query, chunk, score FROM me")
def method_channel(t):
    chunks, symbols, _, asked = code(t)
    return search.method(asked, symbols, search.chunks_of(symbols, chunks))


@query(f"WITH {SQL_OF}, {SQL_CLASS} SELECT query, chunk, score FROM cl")
def class_channel(t):
    chunks, symbols, _, asked = code(t)
    return search.class_methods(asked, symbols, search.chunks_of(symbols.filter("kind = 'function' AND class <> ''"), chunks, lines=False), chunks)


@query(f"WITH {SQL_OF}, {SQL_CLASS} SELECT query, token FROM ct")
def class_tokens(t):
    _, symbols, _, asked = code(t)
    return search.class_tokens(asked, symbols)


@query(f"WITH {SQL_OF}, {SQL_SYMBOL} SELECT query, chunk, score FROM sb")
def symbol_match_weight(t):
    chunks, symbols, _, asked = code(t)
    return search.symbol_matches(asked, symbols, search.chunks_of(symbols, chunks))


@query(f"WITH {SQL_CODE}, {SQL_DISPATCH} SELECT query, chunk, score, focus FROM di")
def dispatch_channel(t):
    chunks, _, entries, asked = code(t)
    return search.dispatch(asked, entries, chunks)


SQL_NAMED = r"st AS (SELECT DISTINCT lower(regexp_extract(file, '([^/]*)\.[^./]*$', 1)) AS stem FROM c), mt AS (SELECT DISTINCT query, token FROM w JOIN st ON token = st.stem OR (length(token) >= 5 AND contains(st.stem, token)) WHERE length(token) >= 4)"


@query(f"WITH {SQL_CODE}, {SQL_NAMED} SELECT query, token FROM mt")
def module_tokens(t):
    chunks, _, _, asked = code(t)
    return search.module_tokens(asked, chunks)


# --- the whole search ---------------------------------------------------------------------------------

SQL_ALL = (
    f"{SQL_OF}, {SQL_METHOD}, {SQL_CLASS}, {SQL_SYMBOL}, {SQL_DISPATCH}, {SQL_NAMED}, {SQL_TOKENS.replace('{}', 'c').replace('toks AS', 'ctk AS')},"
    r"""
  p AS (SELECT chunk, unnest(t) AS token, len(t) AS n FROM ctk), av AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS a FROM ctk), f0 AS (SELECT token, ln(av.n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, av GROUP BY token, av.n),
  f1 AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM f0) ELSE idf END AS idf FROM f0),
  rw AS (SELECT query, chunk, round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * p.n / av.a))), 9) AS raw FROM w JOIN f1 USING (token) JOIN p USING (token), av GROUP BY 1, 2),
  bm AS (SELECT query, chunk, round(10 * raw / max(raw) OVER (PARTITION BY query), 6) AS score FROM (SELECT * FROM rw WHERE raw > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY raw DESC, chunk) <= 200)),
  es AS (SELECT query, chunk, score FROM me UNION ALL SELECT query, chunk, score FROM cl UNION ALL SELECT query, chunk, score FROM di UNION ALL SELECT query, chunk, score FROM sb UNION ALL SELECT query, chunk, score FROM bm),
  cf AS (SELECT query, file FROM es JOIN c USING (chunk) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY max(score) DESC, file) <= 12),
  pt AS (SELECT query, list_transform(list_sort(list_transform(list_filter(x, lambda v: length(v) >= 3), lambda v: {'n': -length(v), 'w': v}))[1:8], lambda v: v.w) AS pats FROM a),
  hl AS (SELECT query, c.file, c.start AS line FROM cf JOIN pt USING (query) JOIN c USING (file) WHERE len(list_filter(pats, lambda v: contains(lower(c.text), v))) > 0 QUALIFY row_number() OVER (PARTITION BY query, c.file ORDER BY c.start) <= 40),
  rg AS (SELECT DISTINCT query, chunk, 50.0 AS score FROM (SELECT query, chunk FROM hl JOIN c ON c.file = hl.file AND hl.line BETWEEN c.start AND c."end" QUALIFY row_number() OVER (PARTITION BY query, hl.file, hl.line ORDER BY CASE type WHEN 'function' THEN 4 WHEN 'class' THEN 3 WHEN 'fallback' THEN 2 ELSE 1 END DESC, "end" - start, start, chunk) = 1)),
  dn AS (SELECT query_id AS query, vec_id AS chunk, round(20 * s / max(s) OVER (PARTITION BY query_id), 4) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(list_transform(q.embedding, lambda z: CAST(z AS DOUBLE)), list_transform(v.embedding, lambda z: CAST(z AS DOUBLE))), 6) AS s FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id
      WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, v.vec_id) <= 50)),
  un AS (SELECT query, chunk, score, 0 AS i, 'method' AS ch FROM me UNION ALL SELECT query, chunk, score, 1, 'class' FROM cl UNION ALL SELECT query, chunk, score, 2, 'dispatch' FROM di UNION ALL SELECT query, chunk, score, 3, 'symbol' FROM sb UNION ALL SELECT query, chunk, score, 4, 'bm25' FROM bm
    UNION ALL SELECT query, chunk, score, 5, 'rg' FROM rg UNION ALL SELECT query, chunk, score, 6, 'dense' FROM dn),
  su AS (SELECT query, chunk, sum(score) AS total, string_agg(ch, '+' ORDER BY i) AS source, arg_max(ch, (score, -i)) AS top FROM un GROUP BY 1, 2),
  mg AS (SELECT query, su.chunk, source, top, file, start, symbol, structure, round(total + CASE type WHEN 'function' THEN 3 WHEN 'class' THEN 2 WHEN 'file_overview' THEN 1 ELSE 0 END + CASE WHEN type = 'function' AND regexp_matches(file, '\.(c|cc|cpp|cxx)$') THEN 4 WHEN type = 'class' AND regexp_matches(file, '\.(h|hh|hpp|hxx)$') THEN -3 ELSE 0 END
      + CASE WHEN symbol <> '' AND symbol = class THEN -18 ELSE 0 END + CASE WHEN symbol <> '' AND start = symbol_start THEN 6 ELSE 0 END
      + CASE WHEN list_contains(x, sm) OR (class <> '' AND list_contains(x, lower(class))) OR len(list_filter(x, lambda v: length(v) >= 4 AND (contains(sm, v) OR contains(lower(class), v)))) > 0 THEN 8
             WHEN starts_with(symbol, 'on_') AND query IN (SELECT query FROM mt) THEN -5 ELSE 0 END
      + CASE WHEN modular AND regexp_matches(file, '\.(h|hh|hpp|hxx)$') AND sm IN ('module', 'kernel') THEN 14 ELSE 0 END, 2) AS score, symbol <> '' AND start = symbol_start AS entry
    FROM su JOIN c ON c.chunk = su.chunk JOIN a USING (query), LATERAL (SELECT lower(regexp_extract(file, '([^/]*)\.[^./]*$', 1)) AS sm)),
  rk AS (SELECT mg.*, coalesce(focus, start) AS line_start, row_number() OVER (PARTITION BY query ORDER BY mg.score DESC, entry DESC, file, coalesce(focus, start), chunk) AS place FROM mg LEFT JOIN (SELECT query, chunk, focus FROM di) USING (query, chunk)),
  fl AS (SELECT *, row_number() OVER (PARTITION BY query, file ORDER BY place) AS g FROM rk), kp AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY place) AS rank FROM fl WHERE g <= CASE WHEN structure THEN 1 ELSE 2 END)"""
)


def dense_channel(t) -> DataFrame:
    return retrieval.dense(t("embeddings"), F.col("vec_id") % 50 == 0).select(F.col("query_id").alias("query"), F.col("vec_id").alias("chunk"), "score")


def searched(t, k: int = 10, whole: bool = True) -> tuple[DataFrame, ...]:
    """(all hits, the kept ones, chunks, asked questions)."""
    chunks, symbols, entries, asked = code(t)
    ranked, kept = engine.run(asked, chunks, symbols, entries, chunks.select("file", F.col("start").alias("line"), "text"), dense_channel(t), k, whole)
    return ranked, kept, chunks, asked


def searched_aside(t, k: int = 10) -> tuple:
    """(members of alike questions; the hits that aren't left aside, the kept ones and what is left aside, of their firsts; chunks, asked questions)."""
    chunks, symbols, entries, asked = code(t)
    return *engine.run_aside(asked, chunks, symbols, entries, chunks.select("file", F.col("start").alias("line"), "text"), dense_channel(t), k), chunks, asked


@query(f"WITH {SQL_ALL} SELECT query, kp.chunk, kp.file, line_start, source, score, rank, c.text AS snippet FROM kp JOIN c ON c.chunk = kp.chunk WHERE rank <= 10")
def search_full(t):
    """The parts' texts are one line each, so a snippet is all of it."""
    return searched(t, whole=False)[1].select("query", "chunk", "file", F.col("line_start").cast("long").alias("line_start"), "source", "score", F.col("rank").cast("long").alias("rank"), "snippet")


@query(f"WITH {SQL_ALL} SELECT fl.query, fl.chunk, CASE WHEN fl.g > CASE WHEN fl.structure THEN 1 ELSE 2 END THEN 'file' WHEN fl.place > 10 THEN 'place' ELSE 'unknown' END AS reason FROM fl ANTI JOIN (SELECT * FROM kp WHERE rank <= 10) z USING (query, chunk)")
def drop_reasons(t):
    """Hits that are left aside stand behind another of their file, for questions that keep one of a file."""
    members, ranked, kept, aside, _, _ = searched_aside(t)
    slim = ranked.select("query", "chunk", "file", "per_file", "place")
    reasons = stage(search.drop_reason(slim, kept.select("query", "chunk"), 10), "reasons")
    return engine.each_of(reasons, members).unionByName(aside.hits(members).withColumn("reason", F.lit("file")))


@query(f"WITH {SQL_ALL} SELECT query, file, min(place) AS place, arg_min(top, place) AS channel FROM kp WHERE rank <= 10 GROUP BY 1, 2")
def dominant_channels(t):
    members, _, kept, aside, _, _ = searched_aside(t)
    return engine.each_of(search.dominant_channel(aside.placed(kept), ["query", "file"]), members).withColumn("place", F.col("place").cast("long"))


SQL_HEADER = r"""im2 AS (SELECT DISTINCT file, regexp_replace(file, '\.[^./]*$', '') AS base FROM c WHERE regexp_matches(file, '\.(c|cc|cpp|cxx)$')), hd AS (SELECT DISTINCT file AS header, regexp_replace(file, '\.[^./]*$', '') AS base FROM c WHERE regexp_matches(file, '\.(h|hh|hpp|hxx)$')), hf AS (SELECT file, min(header) AS header FROM im2 JOIN hd USING (base) GROUP BY 1),
  ov AS (SELECT file, arg_min(chunk, (start, chunk)) AS other FROM c WHERE type = 'file_overview' GROUP BY file), kd AS (SELECT file AS header, symbol AS class, arg_min(chunk, (start, chunk)) AS other FROM c WHERE type = 'class' GROUP BY 1, 2)"""


@query(f"WITH {SQL_CODE}, {SQL_HEADER} SELECT chunk, other, 'overview' AS role FROM c JOIN ov USING (file) UNION ALL SELECT chunk, other, 'header' FROM c JOIN hf USING (file) JOIN kd USING (header, class) WHERE type = 'function' AND class <> ''")
def bundle_companions(t):
    return search.companions(code(t)[0]).select("chunk", "other", "role")


@query(f"WITH {SQL_CODE}, {SQL_HEADER} SELECT file, header FROM hf")
def header_files(t):
    return search.header_of(code(t)[0])


# --- inspection ---------------------------------------------------------------------------------------


@query(f"WITH {SQL_CODE} SELECT lower(name) AS name, kind, count(*) AS n, count(DISTINCT file) AS n_files, min(file) AS first_file FROM s GROUP BY 1, 2")
def symbol_inspect(t):
    s = code(t)[1]
    return s.groupBy(F.lower("name").alias("name"), "kind").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"), F.min("file").alias("first_file"))


@query(f"WITH {SQL_CODE} SELECT command, file, line, row_number() OVER (PARTITION BY command ORDER BY file, line, sure) AS place FROM d")
def dispatch_sorted(t):
    d = code(t)[2]
    return d.select("command", "file", "line", F.row_number().over(Window.partitionBy("command").orderBy("file", "line", "sure")).cast("long").alias("place"))


@query(f"WITH {SQL_CODE}, k1 AS (SELECT DISTINCT file, regexp_extract(file, '[^/]*$') AS key FROM c UNION SELECT DISTINCT file, file FROM c) SELECT key, count(*) AS n_files, min(file) AS first_file FROM k1 GROUP BY key")
def file_indexes(t):
    f = code(t)[0].select("file").distinct()
    keys = f.select("file", F.explode(F.array(F.substring_index("file", "/", -1), F.col("file"))).alias("key")).distinct()
    return keys.groupBy("key").agg(F.count("*").alias("n_files"), F.min("file").alias("first_file"))
