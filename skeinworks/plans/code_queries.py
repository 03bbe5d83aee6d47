"""More queries over the driver tables: intents, overviews, expansion, personalised ranks, lookups, diagnosis, line classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions import rules
from skeinworks.functions import text as T
from skeinworks.operators import code, evaluate, graph, retrieval, stats
from skeinworks.plans.queries import ORACLE_SQL, SQL_BM25, SQL_EVAL, SQL_FILES, SQL_FUSED, SQL_LINES, SQL_LINKS, SQL_TOKENS, evaluated, files, fused, links, query, search_fused
from skeinworks.plans.stage import spread, stage

# --- intents and hints --------------------------------------------------------------------------------

# Questions that trigger each group, as the driver tables' texts seldom do.
QUESTIONS = ["G-code 从哪里进入系统", "G28 如何变成运动", "planner and stepper", "急停 on H3", "模块系统 怎么 注册", "where is main"]


def questions(t) -> DataFrame:
    c = t("conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    made = c.sparkSession.createDataFrame([(-1, i, q) for i, q in enumerate(QUESTIONS)], "conv_id long, turn long, text string")
    return c.unionByName(made)


SQL_QUESTIONS = "questions AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations UNION ALL VALUES " + ", ".join(f"(-1, {i}, '{q}')" for i, q in enumerate(QUESTIONS)) + "), low AS (SELECT *, replace(lower(text), 'g-code', 'gcode') AS l FROM questions)"


def sql_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


SQL_HINTS = {
    "entry": f"({sql_any('text', rules.ENTRY_PHRASES)} OR {sql_any('l', rules.ENTRY_PHRASES)} OR (contains(text, '进入') AND contains(l, 'gcode')))",
    "motion_chain": f"({sql_any('text', rules.CHAIN_WORDS)} OR (contains(text, '运动') AND contains(text, '命令')))",
    "motion_structure": sql_any("l", rules.STRUCTURE_WORDS),
    "halt": sql_any("l", rules.HALT_WORDS + rules.HALT_SYNONYMS),
    "module": sql_any("text", rules.MODULE_WORDS),
}


@query(f"WITH {SQL_QUESTIONS} SELECT conv_id, turn, {sql_any('l', rules.FLOW_WORDS)} AS flow, {' OR '.join(SQL_HINTS[k] for k in ('motion_structure', 'halt', 'module'))} AS structure, concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{k}{chr(39)} END' for k, c in SQL_HINTS.items())}) AS hints FROM low")
def flow_intent_flags(t):
    q = F.col("text")
    return questions(t).select("conv_id", "turn", rules.flow_question(q).alias("flow"), rules.structure_question(q).alias("structure"), F.array_join(rules.hint_names(q), ",").alias("hints"))


@query(
    f"WITH {SQL_QUESTIONS}, {SQL_TOKENS.replace('{}', 'low')}, x AS (SELECT *, list_distinct(list_concat(t, "
    + ", ".join(f"CASE WHEN {c} THEN [" + ", ".join(f"'{s.lower()}'" for s in rules.SEEDS[k]) + "] ELSE CAST([] AS VARCHAR[]) END" for k, c in SQL_HINTS.items())
    + ")) AS x FROM toks) SELECT conv_id, turn, CAST(len(x) AS BIGINT) AS n_tokens, md5(array_to_string(list_sort(x), ' ')) AS digest FROM x"
)
def query_expansion(t):
    x = questions(t).select("conv_id", "turn", rules.expanded(F.col("text"), T.tokens(F.col("text"))).alias("x"))
    return x.select("conv_id", "turn", F.size("x").cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort("x"), " ")).alias("digest"))


@query("SELECT event_id, contains(lower(event_type || ' ' || props), 'error') OR contains(lower(event_type || ' ' || props), '\"k\": 7') AS satisfied FROM events")
def must_have_match(t):
    return t("events").select("event_id", rules.has_needle(F.concat_ws(" ", "event_type", "props"), F.array(F.lit("Error"), F.lit('"K": 7'))).alias("satisfied"))


@query("""SELECT p_partkey, 'src/' || replace(p_name, ' ', '_') || CASE WHEN p_size % 2 = 0 THEN '.cpp' ELSE '.h' END AS file,
  CAST(CASE p_type WHEN 'ECONOMY' THEN 3 WHEN 'PROMO' THEN 2 ELSE 0 END + CASE WHEN p_size % 2 = 0 AND p_type = 'ECONOMY' THEN 4 WHEN p_size % 2 = 1 AND p_type = 'PROMO' THEN -3 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN -18 ELSE 0 END + CASE WHEN p_size % 3 <> 0 THEN 6 ELSE 0 END AS DOUBLE) AS bonus FROM part""")
def chunk_score_bonus(t):
    file = F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 2 == 0, ".cpp").otherwise(".h"))
    kind = F.when(F.col("p_type") == "ECONOMY", "function").when(F.col("p_type") == "PROMO", "class").otherwise("fallback")
    owner = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.lit("Owner"))
    return t("part").select("p_partkey", file.alias("file"), rules.chunk_bonus(kind, file, F.col("p_name"), owner, F.lit(10), F.when(F.col("p_size") % 3 == 0, 9)).alias("bonus"))


# --- files --------------------------------------------------------------------------------------------

SQL_SPLIT = SQL_FILES + r", a AS (SELECT *, string_split_regex(text, '\r\n|\r|\n') AS p FROM files WHERE text <> ''), lined AS (SELECT *, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS ls FROM a)"


@query(f"""WITH {SQL_SPLIT}, o AS (SELECT *, ls[1:40] AS head, list_filter(list_transform(ls[1:40], lambda x: trim(x)), lambda x: starts_with(x, '#include')) AS inc FROM lined WHERE len(ls) > 0)
  SELECT file, CAST(len(head) AS BIGINT) AS head_end, md5(concat_ws(chr(10), '// [file overview]', '// file:    ' || file, '// top_dir: ' || coalesce(source, 'none'), '// lines:   ' || len(ls), '//', '// includes (' || len(inc) || '):', CASE WHEN len(inc) > 0 THEN array_to_string(list_transform(inc[1:15], lambda x: '//   ' || x), chr(10)) END, '//', '// symbols (0):', '//', '// --- file head (lines 1-' || len(head) || ') ---', array_to_string(head, chr(10)))) AS digest FROM o""")
def chunk_overview(t):
    f = files(t).filter("text <> ''").select("file", F.coalesce("source", F.lit("none")).alias("top"), T.lines(F.col("text")).alias("ls")).filter(F.size("ls") > 0)
    text = code.overview(F.col("file"), F.col("top"), F.col("ls"), F.array().cast("array<string>"), F.lit(0))
    return f.select("file", F.least(F.lit(40), F.size("ls")).cast("long").alias("head_end"), F.md5(text).alias("digest"))


@query(r"""WITH l AS (SELECT page_id, html, string_split_regex(coalesce(html, ''), '\r\n|\r|\n') AS p FROM pages), h AS (SELECT *, (CASE WHEN coalesce(html, '') = '' THEN [] WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END)[1:300] AS head FROM l),
  g AS (SELECT *, len(list_filter(head, lambda x: regexp_matches(x, '^\s*#pragma'))) AS n FROM h) SELECT page_id, """ + sql_any("lower(substr(coalesce(html, ''), 1, 20000))", rules.GENERATED) + " OR (n >= 10 AND n >= 0.08 * len(head)) AS generated FROM g")
def generated_flag(t):
    h = F.coalesce("html", F.lit(""))
    return t("pages").select("page_id", rules.generated(h, T.lines(h)).alias("generated"))


# Pieces as the line counter reads them; a line is the number of line feeds before a piece, and lines end at line feeds only in the driver's pages.
SQL_PIECES = r"""//[^\n]*|/\*(?s:.*?)\*/|/\*(?s:.*)|"(?:[^"\\\n]|\\[^\n])*\\?"?|''(?:[^''\\\n]|\\[^\n])*\\?''?|\n|[^\s"''/]+|/"""


@query(
    rf"""WITH h AS (SELECT page_id, coalesce(html, '') AS x FROM pages), n AS (SELECT page_id, x, CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(x, chr(10), '')) + CASE WHEN ends_with(x, chr(10)) THEN 0 ELSE 1 END END AS lines FROM h),
  p AS (SELECT page_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(CASE WHEN ends_with(x, chr(10)) THEN left(x, length(x) - 1) ELSE x END, '{SQL_PIECES}') AS l FROM n)),
  a AS (SELECT page_id, s, coalesce(sum(length(s) - length(replace(s, chr(10), ''))) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM p),
  c AS (SELECT DISTINCT page_id, line FROM a WHERE s <> chr(10) AND NOT starts_with(s, '//') AND NOT starts_with(s, '/*')),
  m AS (SELECT DISTINCT page_id, line + k AS line FROM (SELECT page_id, line, unnest(string_split(s, chr(10))) AS part, generate_subscripts(string_split(s, chr(10)), 1) - 1 AS k FROM a WHERE starts_with(s, '//') OR starts_with(s, '/*')) WHERE part <> '')
  SELECT page_id, (SELECT count(*) FROM c WHERE c.page_id = n.page_id) AS code, (SELECT count(*) FROM m ANTI JOIN c USING (page_id, line) WHERE m.page_id = n.page_id) AS comment,
    CAST(lines - (SELECT count(*) FROM (SELECT page_id, line FROM c UNION SELECT page_id, line FROM m) AS u WHERE u.page_id = n.page_id) AS BIGINT) AS blank FROM n"""
)
def loc_state_machine(t):
    return code.loc(t("pages"), "page_id", "html")


@query(r"""WITH s AS (SELECT source, lower(trim(unnest(regexp_extract_all(array_to_string(string_split_regex(text, '\r\n|\r|\n')[1:80], chr(10)), '(?i)(?:copyright|licen[cs]e)[^\n\r]*')))) AS signature FROM documents WHERE text <> '') SELECT source, signature, count(*) AS n FROM s GROUP BY 1, 2""")
def copyright_signatures(t):
    """Over all files of a directory, not a sample of them; a line's whole rest is taken."""
    head = F.array_join(F.slice(T.lines(F.col("text")), 1, 80), "\n")
    s = t("documents").filter("text <> ''").select("source", F.explode(F.regexp_extract_all(head, F.lit(r"(?i)(?:copyright|licen[cs]e)[^\n\r]*"), 0)).alias("s"))
    return s.groupBy("source", F.lower(F.trim("s")).alias("signature")).agg(F.count("*").alias("n"))


@query("SELECT lower(p_name) AS name, count(*) AS n, array_to_string(list_sort(list(p_partkey))[1:20], ',') AS keys FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(t):
    p = t("part").select(F.lower("p_name").alias("name"), "p_partkey")
    n = p.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")
    first = p.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("p_partkey"))).filter("r <= 20").groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("p_partkey")), ",").alias("keys"))
    return n.join(first, "name")


@query(r"""WITH p AS (SELECT string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS parts, length(html) AS n FROM pages) SELECT array_to_string(parts[1:2], '/') AS top2, count(*) AS n_files, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_chars FROM p GROUP BY 1""")
def top2_heatmap(t):
    parts = F.split(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/")
    return t("pages").groupBy(F.array_join(F.slice(parts, 1, 2), "/").alias("top2")).agg(F.count("*").alias("n_files"), F.coalesce(F.sum(F.char_length("html")), F.lit(0)).alias("n_chars"))


@query("""WITH p AS (SELECT n_chars AS stated, length(text) AS counted FROM documents WHERE n_chars IS NOT NULL AND text IS NOT NULL), s AS (SELECT count(*) AS n, CAST(coalesce(sum(stated), 0) AS BIGINT) AS stated, CAST(coalesce(sum(counted), 0) AS BIGINT) AS counted FROM p),
  d AS (SELECT *, CASE WHEN stated = 0 THEN CASE WHEN counted = 0 THEN 0.0 ELSE 100.0 END ELSE round(100.0 * (counted - stated) / stated, 6) END AS percent FROM s) SELECT n, stated, counted, percent, abs(percent) < 2 AS fine FROM d""")
def calibration_totals(t):
    return evaluate.deviation(t("documents").select("n_chars", F.char_length("text").cast("long").alias("counted")), "n_chars", "counted")


# --- channels and expansion ---------------------------------------------------------------------------


@query(
    SQL_BM25
    + r""", b AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM bm), pat AS (SELECT item_id, list_transform(list_sort(list_transform(list_filter(t, lambda w: length(w) >= 3), lambda w: {'n': -length(w), 'w': w}))[1:8], lambda x: x.w) AS pats FROM qt),
  l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) AS n FROM documents WHERE text <> ''),
  m AS (SELECT item_id, doc_id, n FROM b JOIN pat USING (item_id) JOIN l USING (doc_id) WHERE r <= 12 AND len(list_filter(pats, lambda p: contains(lower(line), p))) > 0) SELECT item_id, doc_id, least(40, count(*)) AS n_lines, min(n) AS first_line FROM m GROUP BY 1, 2"""
)
def regex_scan_topfiles(t):
    return retrieval.scan_top_files(t("documents"), retrieval.bm25(t("documents"), t("benchmark")), t("benchmark"))


@query("WITH e AS (SELECT l_partkey, l_returnflag || l_linestatus AS channel, l_quantity AS score FROM lineitem) SELECT l_partkey, " + ", ".join(f"round(coalesce(sum(score) FILTER (channel = '{c}'), 0), 6) AS {c}" for c in ("AF", "NF", "NO", "RF")) + " FROM e GROUP BY 1")
def score_breakdown_pivot(t):
    h = t("lineitem").select("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("channel"), F.col("l_quantity").alias("score"))
    return retrieval.by_channel(h, ["l_partkey"], ["AF", "NF", "NO", "RF"])


@query(
    SQL_FUSED
    + """, top AS (SELECT * FROM o WHERE rank <= 8), e AS (SELECT source, lang, min(doc_id) AS over, max(doc_id) AS head FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2),
  c AS (SELECT doc_id, over AS other, 'overview' AS role, 0 AS place, 0.3 AS factor FROM documents JOIN e USING (source, lang) UNION ALL SELECT doc_id, head, 'header', 1, 0.5 FROM documents JOIN e USING (source, lang)),
  u2 AS (SELECT item_id, doc_id, 'primary' AS role, score, 0 AS a, rank AS b, 0 AS c FROM top UNION ALL SELECT item_id, other, role, round(score * CAST(factor AS DOUBLE), 2), 1, rank, place FROM top JOIN c USING (doc_id)),
  z AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY a, b, c) AS z FROM u2) SELECT item_id, doc_id, role, score FROM z WHERE z = 1"""
)
def bundle_expand(t):
    d = t("documents").select("doc_id", "source", "lang")
    e = d.groupBy("source", "lang").agg(F.min("doc_id").alias("over"), F.max("doc_id").alias("head"))
    j = d.join(e, ["source", "lang"])
    links_ = j.select("doc_id", F.explode(F.array(F.struct(F.col("over").alias("other"), F.lit("overview").alias("role"), F.lit(0).alias("place"), F.lit(0.3).alias("factor")), F.struct(F.col("head").alias("other"), F.lit("header").alias("role"), F.lit(1).alias("place"), F.lit(0.5).alias("factor")))).alias("x")).select("doc_id", "x.*")
    return retrieval.expand_bundle(search_fused(t), links_, ["item_id"], "doc_id")


SQL_NOISE = f"WITH {SQL_TOKENS.replace('{}', 'documents')}, e AS (SELECT doc_id, unnest(t) AS token FROM toks), k AS (SELECT token, count(*) AS n, min(doc_id) AS first_id FROM e WHERE length(token) >= 4 GROUP BY token HAVING count(*) <= 30)"


def low_noise(t):
    e = stage(spread(t("documents").select("doc_id", "text")).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")).filter(F.length("token") >= 4), "tokens", "lz4")
    return e, e.groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n <= 30")


@query(SQL_NOISE + " SELECT token AS symbol, n, first_id FROM k")
def low_noise_symbols(t):
    return low_noise(t)[1].withColumnRenamed("token", "symbol")


@query(
    SQL_NOISE
    + """, p AS (SELECT label AS q, vec_id AS doc_id FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT doc_id, arg_min(token, (n, token)) AS symbol FROM e JOIN k USING (token) WHERE n > 1 GROUP BY doc_id), ps AS (SELECT q, doc_id, coalesce(symbol, '') AS symbol FROM p LEFT JOIN s USING (doc_id)),
  c AS (SELECT q, e.doc_id, count(*) * 25.0 AS score FROM ps JOIN e ON e.token = ps.symbol GROUP BY 1, 2), f AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM ps WHERE ps.q = c.q AND ps.doc_id = c.doc_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS r FROM f) SELECT q, doc_id, CAST(score AS DOUBLE) AS score FROM r WHERE r <= 3"""
)
def graph_extras(t):
    """A hit's symbol is its rarest token that other documents hold too; each document is a file of its own."""
    e, k = low_noise(t)
    m = e.join(k.filter("n > 1"), "token")
    symbol = m.groupBy("doc_id").agg(F.min_by("token", F.struct("n", "token")).alias("symbol"))
    p = t("embeddings").filter("vec_id % 50 = 0").select(F.col("label").alias("q"), F.col("vec_id").alias("doc_id")).join(symbol, "doc_id", "left")
    p = p.select("q", "doc_id", F.col("doc_id").alias("file"), F.coalesce("symbol", F.lit("")).alias("symbol"))
    return retrieval.graph_extras(p, m.select(F.col("token").alias("symbol"), "doc_id", F.col("doc_id").alias("file")), "q", "doc_id", "file").select("q", "doc_id", "score")


SQL_SEEDED = "sd AS (SELECT regexp_replace(url, '^[a-z]+://([^/?#]*).*$', '\\1') AS id, count(*) * 1.0 AS s FROM pages WHERE page_id < 10 GROUP BY 1), st AS (SELECT sum(s) AS t FROM sd JOIN n USING (id))"
SQL_EVEN = "sd AS (SELECT id, 1.0 AS s FROM n), st AS (SELECT sum(s) AS t FROM sd)"


def sql_pagerank(rounds: int, seeds: str) -> str:
    """Unrolled steps with restart at the seeds; ends with the table of ranks."""
    out = f"""WITH {SQL_LINKS}, g AS (SELECT src, dst, weight AS w FROM links UNION ALL SELECT dst, src, 0.2 FROM links), h AS (SELECT src, dst, sum(w) AS w FROM g GROUP BY 1, 2), e AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM h),
  n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), {seeds}, r0 AS MATERIALIZED (SELECT id, coalesce(s, 0) / t AS r, coalesce(s, 0) / t AS p FROM n LEFT JOIN sd USING (id), st)"""
    for k in range(rounds):
        out += f", f{k} AS MATERIALIZED (SELECT dst AS id, sum(r * w) AS x FROM e JOIN r{k} ON src = id GROUP BY 1), m{k} AS MATERIALIZED (SELECT coalesce(sum(x), 0) AS m FROM f{k}), r{k + 1} AS MATERIALIZED (SELECT id, 0.85 * coalesce(x, 0) + r0.p * (0.15 + 0.85 * (1 - m)) AS r, r0.p AS p FROM r0 LEFT JOIN f{k} USING (id), m{k})"
    return out + f", ranks AS (SELECT id, r FROM r{rounds})"


ORACLE_SQL["pagerank_global"] = sql_pagerank(40, SQL_EVEN) + " SELECT id, round(r, 9) AS rank FROM ranks"


@query(sql_pagerank(30, SQL_SEEDED) + ", z AS (SELECT id, r, row_number() OVER (ORDER BY round(r, 9) DESC, id) AS place FROM ranks) SELECT id, round(r, 6) AS rank FROM z WHERE place <= 50")
def pagerank_personalized(t):
    e = links(t)
    both = e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.2).alias("weight")))
    seeds = t("pages").filter("page_id < 10").select(F.regexp_replace("url", "^[a-z]+://([^/?#]*).*$", "$1").alias("id"), F.lit(1.0).alias("weight"))
    return graph.pagerank(both, rounds=30, seeds=seeds).orderBy(F.desc(F.round("rank", 9)), "id").limit(50).select("id", F.round("rank", 6).alias("rank"))  # the 50 best are the report


@query("""WITH a AS (SELECT DISTINCT user_id % 10 AS q, event_type AS command FROM events WHERE event_id % 50 = 0), e AS (SELECT event_type AS command, user_id AS chunk, event_id AS line, value > 50 AS sure FROM events)
  SELECT q, chunk, CAST(140 + max(CASE WHEN sure THEN 8 ELSE 4 END) AS DOUBLE) AS score, max(line) AS focus FROM a JOIN e USING (command) GROUP BY 1, 2""")
def dispatch_lookup(t):
    e = t("events")
    asked = e.filter("event_id % 50 = 0").select((F.col("user_id") % 10).alias("q"), F.col("event_type").alias("command"))
    # One row to a (command, chunk) before the join, as the asked commands repeat them.
    entries = e.groupBy(F.col("event_type").alias("command"), F.col("user_id").alias("chunk")).agg(F.max("event_id").alias("line"), F.max(F.coalesce(F.col("value") > 50, F.lit(False))).alias("sure"))
    return retrieval.dispatch_scores(asked, entries, "q", "chunk")


@query("SELECT lower(p_name || ' ' || p_brand) AS name, min(p_partkey) AS p_partkey, 125.0::DOUBLE AS score FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1")
def symbol_lookup_unique(t):
    return retrieval.unique_names(t("part").select(F.concat_ws(" ", "p_name", "p_brand").alias("n"), "p_partkey"), "n", "p_partkey")


@query(r"""WITH known AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS file FROM pages), w AS (SELECT DISTINCT name FROM (SELECT file AS name FROM known WHERE length(file) % 3 = 0 UNION ALL SELECT regexp_extract(file, '[^/]*$') FROM known WHERE length(file) % 3 = 1 UNION ALL SELECT substr(file, 4) FROM known WHERE length(file) % 3 = 2 UNION ALL SELECT 'nowhere.h') WHERE name <> ''),
  a AS (SELECT name, file AS target, 'path' AS how FROM w JOIN known ON name = file), b AS (SELECT name, file AS target, 'base' AS how FROM w JOIN known ON name = regexp_extract(file, '[^/]*$') WHERE name NOT IN (SELECT name FROM a)),
  c AS (SELECT name, file AS target, 'end' AS how FROM w JOIN known ON ends_with(file, name) AND file <> name WHERE name NOT IN (SELECT name FROM a) AND name NOT IN (SELECT name FROM b)) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def include_resolution(t):
    known = t("pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("file")).filter("file IS NOT NULL").distinct()
    n = F.length("file") % 3
    wanted = known.select(F.when(n == 0, F.col("file")).when(n == 1, F.substring_index("file", "/", -1)).otherwise(F.expr("substr(file, 4)")).alias("name"))
    return code.resolve_paths(wanted.unionByName(wanted.sparkSession.createDataFrame([("nowhere.h",)], "name string")), known)


# --- evaluation and diagnosis -------------------------------------------------------------------------

SQL_SPLITS = SQL_EVAL + ", v AS (SELECT *, CASE WHEN lang = 'en' THEN 'tune' ELSE 'holdout' END AS split FROM q)"


def split_eval(t):
    return evaluated(t).withColumn("split", F.when(F.col("lang") == "en", "tune").otherwise("holdout"))


@query(SQL_SPLITS + " SELECT split, count(*) AS n_questions, count(*) FILTER (hit5 > 0) AS passed, round(avg(hit5 / n), 6) AS mean_cov5, round(avg(hit10 / n), 6) AS mean_cov10, round(avg(hit5 / n), 6) >= 0.7 AS gate FROM v GROUP BY ROLLUP (split)")
def eval_gate(t):
    return evaluate.summary(split_eval(t), "split")


@query(SQL_SPLITS + " SELECT source, lang, CAST(n AS BIGINT) AS n, CASE WHEN lang IS DISTINCT FROM 'de' THEN CAST(hit5 AS BIGINT) END AS hit5, CASE WHEN lang IS DISTINCT FROM 'de' THEN CAST(hit10 AS BIGINT) END AS hit10 FROM v")
def sealed_redaction(t):
    return evaluate.redacted(evaluated(t).select("source", "lang", "n", "hit5", "hit10"), F.col("lang") == "de", ["hit5", "hit10"])


@query(SQL_SPLITS + " SELECT source, lang, hit10 / n AS before, hit5 / n AS after FROM v WHERE hit10 >= n AND hit5 < n")
def regression_report(t):
    q = evaluated(t).select("source", "lang", (F.col("hit10") / F.col("n")).alias("ten"), (F.col("hit5") / F.col("n")).alias("five"))
    base, now = q.select("source", "lang", F.col("ten").alias("cov")), q.select("source", "lang", F.col("five").alias("cov"))
    return evaluate.regressions(base.filter("source IS NOT NULL AND lang IS NOT NULL"), now, ["source", "lang"], "cov")


SQL_RANKED = """WITH d AS (SELECT source, lang, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE source IS NOT NULL), e AS (SELECT d.source, d.doc_id FROM labels l JOIN d USING (doc_id) WHERE l.quality = 1)"""


def ranked(t):
    """Only the best 60 of a source are needed by any layer."""
    d = t("documents").filter("source IS NOT NULL").select("source", "lang", "doc_id", "n_chars")
    return d, d.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).filter("r <= 60")


def expected(t, d):
    return t("labels").filter("quality = 1").select("doc_id").join(d, "doc_id").select("source", "doc_id")


@query(SQL_RANKED + " SELECT e.source, e.doc_id, CASE WHEN r > 10 THEN 'raw' WHEN lang IS NULL OR lang = 'fr' THEN 'bundle' WHEN r > 8 THEN 'trim' ELSE 'OK' END AS lost FROM e JOIN d USING (doc_id)")
def layer_diagnosis(t):
    d, r = ranked(t)
    raw = r.filter("r <= 10")
    bundle = raw.filter("lang <> 'fr'")
    return evaluate.layers(expected(t, d), {"raw": raw, "bundle": bundle, "trim": bundle.filter("r <= 8")}, "source", "doc_id")


@query(SQL_RANKED + " SELECT e.source, e.doc_id, CASE WHEN r > 50 THEN 'A' WHEN r > 10 THEN 'B1' WHEN r > 5 THEN 'B2' ELSE 'B3' END AS class FROM e JOIN d USING (doc_id)")
def miss_class(t):
    d, r = ranked(t)
    j = expected(t, d).join(r.select("doc_id", "r"), "doc_id", "left")
    return j.select("source", "doc_id", evaluate.miss_class(F.when(F.col("r") <= 50, F.col("r")), F.col("r")).alias("class"))


@query(SQL_RANKED + ", top AS (SELECT d.source, d.lang, l.lang IS NOT NULL AS good FROM d LEFT JOIN (SELECT DISTINCT d.source, d.lang FROM e JOIN d USING (doc_id)) l ON l.source = d.source AND l.lang = d.lang WHERE r <= 5 AND d.lang IS NOT NULL), g AS (SELECT source, lang, good, count(*) AS c FROM top GROUP BY 1, 2, 3) SELECT source, CASE WHEN max(CASE WHEN good THEN c ELSE 0 END) > 1 OR coalesce(sum(c) FILTER (NOT good), 0) = 0 THEN 1 ELSE 2 END AS form, CAST(coalesce(sum(c) FILTER (NOT good), 0) AS BIGINT) AS n_noise FROM g GROUP BY source")
def squeeze_class(t):
    d, r = ranked(t)
    e = expected(t, d).join(d.select("doc_id", "lang"), "doc_id").select("source", "lang")
    return evaluate.squeeze(r.filter("r <= 5 AND lang IS NOT NULL").select("source", "lang"), e, "source", "lang")


@query(SQL_RANKED + ", s AS (SELECT source, n_chars FROM d WHERE r = 5) SELECT d.source, d.doc_id, CAST(s.n_chars - d.n_chars AS BIGINT) AS gap FROM d JOIN s USING (source) WHERE d.r BETWEEN 6 AND 60")
def rank_gap(t):
    return evaluate.gap_to_place(ranked(t)[1], ["source"], "n_chars", "r").select("source", "doc_id", F.col("gap").cast("long").alias("gap"))


@query("""WITH a AS (SELECT conv_id, max(text) FILTER (turn = 0) AS q, max(text) FILTER (turn = 1) AS x FROM conversations GROUP BY 1), n AS (SELECT conv_id, coalesce(x, '') AS x, unnest(list_distinct(regexp_extract_all(lower(coalesce(q, '')), '[a-z]{5,}'))) AS name FROM a)
  SELECT conv_id, count(*) AS n_files, count(*) FILTER (contains(x, name) OR contains(lower(x), name)) AS n_mentioned, round(count(*) FILTER (contains(x, name) OR contains(lower(x), name)) / count(*), 6) AS coverage FROM n GROUP BY 1""")
def coverage_validate(t):
    a = t("conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("q"), F.coalesce(F.max(F.when(F.col("turn") == 1, F.col("text"))), F.lit("")).alias("x"))
    n = a.select("conv_id", "x", F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("q", F.lit(""))), F.lit("[a-z]{5,}"), 0)).alias("names")).filter(F.size("names") > 0)
    hit = F.size(F.filter("names", lambda f: rules.mentioned(f, F.col("x"))))
    return n.select("conv_id", F.size("names").cast("long").alias("n_files"), hit.cast("long").alias("n_mentioned"), F.round(hit / F.size("names"), 6).alias("coverage"))


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, CAST(len(v) AS BIGINT) AS n, v[1] AS least, v[-1] AS most, round(list_avg(v), 6) AS mean, v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1] <= 500 AS gate FROM s""")
def latency_stats(t):
    e = t("events")
    s = e.filter("value IS NOT NULL").groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))
    p = stats.order_statistics(e, "event_type", "value", {"p95": 0.95}).select("event_type", F.col("value").alias("p95"))
    return s.join(p, "event_type").withColumn("gate", F.col("p95") <= 500)


@query("SELECT r_name || '#' || k AS r_name, CAST(r_regionkey * 3 + k AS BIGINT) AS id FROM region, range(3) AS x(k)")
def synthetic_scale_up(t):
    r = t("region").select("r_name", "r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return r.select(F.concat("r_name", F.lit("#"), F.col("k").cast("string")).alias("r_name"), (F.col("r_regionkey") * 3 + F.col("k")).cast("long").alias("id"))


@query("SELECT conv_id, count(*) AS n_turns, md5(string_agg('## ' || (turn + 1) || '. ' || coalesce(role, '') || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def session_markdown(t):
    c = t("conversations").select("conv_id", "turn", F.concat(F.lit("## "), (F.col("turn") + 1).cast("string"), F.lit(". "), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"])
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.md5(F.array_join(parts, "\n")).alias("digest"))


@query("""WITH g AS (SELECT user_id, ts, event_id, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
  SELECT user_id, min(event_id) AS first_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s""")
def events_session(t):
    """Extension: sessions that six hours without an event end."""
    e = t("events").filter("user_id IS NOT NULL")
    return e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", "first_id", "n", "total")
