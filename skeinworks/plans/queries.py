"""Queries over the driver tables: documents as files, events as a log, labels as a golden set, embeddings as a dense index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinworks.functions import text as T
from skeinworks.operators import graph, retrieval, stats
from skeinworks.plans.stage import pieces, spread, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


SQL_FILES = "files AS (SELECT coalesce(source, 'none') || '/' || doc_id || '.txt' AS file, coalesce(text, '') AS text, source, doc_id, lang FROM documents)"
SQL_LINES = SQL_FILES + r", counted AS (SELECT *, CAST(len(regexp_extract_all(text, '\r\n|\r|\n')) + CASE WHEN text <> '' AND NOT regexp_matches(text, '[\r\n]$') THEN 1 ELSE 0 END AS BIGINT) AS lines FROM files)"
SQL_TOKENS = r"""toks AS (SELECT *, list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all(regexp_replace(replace(replace(text, '->', ' '), '::', ' '), 'G-[Cc]ode', 'gcode', 'g'), '[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+'),
  lambda w: list_concat([w], list_concat(string_split(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), ' '), string_split(w, '_'))))), lambda w: lower(w)), lambda w: length(w) >= 2)) AS t FROM {})"""


def files(t) -> DataFrame:
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return t("documents").select(name.alias("file"), F.coalesce("text", F.lit("")).alias("text"), "source", "doc_id", "lang")


# --- scans and profiles -------------------------------------------------------------------------------


@query(f"WITH {SQL_LINES} SELECT file, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, lines, coalesce(source, 'none') AS top_dir FROM counted")
def file_manifest(t):
    return files(t).select("file", F.octet_length("text").cast("long").alias("size_bytes"), T.line_count(F.col("text")).alias("lines"), F.split_part("file", F.lit("/"), F.lit(1)).alias("top_dir"))


@query(f"WITH {SQL_LINES} SELECT coalesce(source, 'none') AS top_dir, count(*) AS n_files, CAST(sum(lines) AS BIGINT) AS n_lines FROM counted GROUP BY 1")
def manifest_by_dir(t):
    return file_manifest(t).groupBy("top_dir").agg(F.count("*").alias("n_files"), F.sum("lines").alias("n_lines"))


@query(f"WITH {SQL_LINES}, s AS (SELECT lang, count(*) AS n_files, CAST(sum(lines) AS BIGINT) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM counted GROUP BY lang) SELECT lang, n_files, n_lines, n_chars, round(n_lines / greatest(sum(n_lines) OVER (), 1), 6) AS share FROM s")
def ext_summary(t):
    s = files(t).groupBy("lang").agg(F.count("*").alias("n_files"), F.sum(T.line_count(F.col("text"))).alias("n_lines"), F.sum(F.char_length("text")).alias("n_chars"))
    total = s.agg(F.greatest(F.sum("n_lines"), F.lit(1)).alias("t"))  # one row
    return s.join(F.broadcast(total)).select("lang", "n_files", "n_lines", "n_chars", F.round(F.col("n_lines") / F.col("t"), 6).alias("share"))


@query("WITH h AS (SELECT substr(sha256(text), 1, 16) AS digest, doc_id FROM documents WHERE text IS NOT NULL) SELECT digest, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM h GROUP BY digest HAVING count(*) > 1")
def duplicate_hash_groups(t):
    h = t("documents").filter("text IS NOT NULL").select(F.substring(F.sha2("text", 256), 1, 16).alias("digest"), "doc_id")
    return h.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n > 1")


@query(r"""WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS parts, length(html) AS n FROM pages),
  e AS (SELECT array_to_string(parts[1:k], '/') AS prefix, k AS depth, n FROM p, unnest(range(1, least(5, len(parts)) + 1)) AS u(k))
  SELECT prefix, CAST(depth AS INTEGER) AS depth, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_chars FROM e GROUP BY 1, 2""")
def path_rollup(t):
    parts = F.split(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/")
    p = t("pages").select(parts.alias("parts"), F.char_length("html").alias("n"))
    e = p.select(F.explode(F.sequence(F.lit(1), F.least(F.lit(5), F.size("parts")))).alias("depth"), "parts", "n")
    return e.groupBy(F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("prefix"), "depth").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_chars"))


@query(r"""SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN 'empty' WHEN contains(substr(html, 1, 4096), chr(0)) THEN 'binary' ELSE 'utf-8' END AS encoding,
  regexp_matches(lower(substr(coalesce(html, ''), 1, 20000)), 'do not edit|auto-generated|generated by') AS generated FROM pages""")
def encoding_class(t):
    h = F.coalesce("html", F.lit(""))
    kind = F.when(h == "", "empty").when(F.contains(F.substring(h, 1, 4096), F.lit("\0")), "binary").otherwise("utf-8")
    return t("pages").select("page_id", kind.alias("encoding"), F.lower(F.substring(h, 1, 20000)).rlike("do not edit|auto-generated|generated by").alias("generated"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.n_chars AS stated, b.n AS counted, CASE WHEN a.doc_id IS NULL THEN 'counted only' WHEN b.doc_id IS NULL THEN 'stated only' WHEN a.n_chars = b.n THEN 'equal' ELSE 'different' END AS verdict
  FROM (SELECT doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL) a FULL OUTER JOIN (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL) b ON a.doc_id = b.doc_id""")
def calibration_diff(t):
    d = t("documents")
    a = d.filter("n_chars IS NOT NULL").select("doc_id", F.col("n_chars").alias("stated"), F.lit(True).alias("a"))
    b = d.filter("text IS NOT NULL").select("doc_id", F.char_length("text").cast("long").alias("counted"), F.lit(True).alias("b"))
    verdict = F.when(F.col("a").isNull(), "counted only").when(F.col("b").isNull(), "stated only").when(F.col("stated") == F.col("counted"), "equal").otherwise("different")
    return a.join(b, "doc_id", "full").select("doc_id", "stated", "counted", verdict.alias("verdict"))


# --- tokens, rules, chunks ----------------------------------------------------------------------------


@query(f"WITH {SQL_TOKENS.replace('{}', 'documents')} SELECT doc_id, CAST(coalesce(len(t), 0) AS BIGINT) AS n_tokens, coalesce(md5(array_to_string(list_sort(t), ' ')), 'none') AS digest FROM toks")
def tokenize_documents(t):
    d = spread(t("documents").select("doc_id", "text")).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.coalesce(F.size("t"), F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(F.md5(F.array_join(F.array_sort("t"), " ")), F.lit("none")).alias("digest"))


@query(f"WITH {SQL_TOKENS.replace('{}', 'documents')}, e AS (SELECT unnest(t) AS token FROM toks) SELECT token, count(*) AS n_docs FROM e GROUP BY token")
def token_frequency(t):
    return spread(t("documents").select("text")).select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n_docs"))


@query(r"""WITH f AS (SELECT conv_id, turn, unnest(regexp_extract_all(coalesce(text, ''), '(?i)\b([GM])\s*[-:]?\s*(\d+(?:\.\d+)?)\b')) AS m FROM conversations UNION ALL SELECT -1, 0, unnest(regexp_extract_all('G28 homing M104/M109 g-28.10', '(?i)\b([GM])\s*[-:]?\s*(\d+(?:\.\d+)?)\b')))
  SELECT DISTINCT conv_id, turn, CASE WHEN contains(m, '.') THEN regexp_replace(upper(regexp_replace(m, '[\s:\-]', '', 'g')), '\.?0+$', '') ELSE upper(regexp_replace(m, '[\s:\-]', '', 'g')) END AS command FROM f""")
def command_extract(t):
    c = t("conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    fixture = c.sparkSession.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("G28 homing M104/M109 g-28.10").alias("text"))
    return c.unionByName(fixture).select("conv_id", "turn", F.explode(T.commands(F.col("text"))).alias("command")).distinct()


# An example rule table, trigger substring to seed words; rules are data, so callers bring their own.
HINTS = [("entry", "the", "main start init"), ("halt", "stop", "halt stop emergency"), ("flow", "que", "call route dispatch"), ("module", "und", "module kernel load")]


@query("WITH h(name, key, seeds) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in HINTS) + ") SELECT conv_id, turn, name, seeds FROM conversations JOIN h ON contains(lower(text), key)")
def hint_expand(t):
    c = t("conversations")
    h = c.sparkSession.createDataFrame(HINTS, "name string, key string, seeds string")
    return c.join(F.broadcast(h), F.contains(F.lower("text"), F.col("key"))).select("conv_id", "turn", "name", "seeds")


SQL_WINDOWS = SQL_LINES + """, w AS (SELECT file, lines, 1 + k * 4 AS "start", least(k * 4 + 5, lines) AS "end" FROM counted, unnest(range(0, CAST(greatest(0, ceil((lines - 5) / 4)) AS BIGINT) + 1)) AS u(k) WHERE lines > 0)"""


def windows(t, size=5, overlap=1):
    f = files(t).select("file", T.line_count(F.col("text")).alias("lines"))
    return f.select("file", "lines", F.explode(T.sub_windows(F.col("lines"), size, overlap)).alias("w")).select("file", "lines", "w.start", "w.end")


@query(f"""WITH {SQL_WINDOWS} SELECT file, "start", "end", regexp_replace(file, '[/\\\\.]', '_', 'g') || '::' || "start" || '-' || "end" AS id FROM w""")
def chunk_windows(t):
    return windows(t).select("file", "start", "end", T.chunk_id(F.col("file"), F.col("start"), F.col("end")).alias("id"))


SQL_CHUNKS = SQL_WINDOWS + """, c AS (SELECT file, "start", "end", 2 AS pri, 'fallback' AS type FROM w UNION ALL SELECT file, 1, least(lines, 40), 1, 'file_overview' FROM counted WHERE lines > 0),
  probes AS (SELECT file, unnest(range(1, lines + 1)) AS line FROM counted)"""


def chunks(t):
    over = files(t).select("file", T.line_count(F.col("text")).alias("lines")).filter("lines > 0")
    return windows(t).select("file", "start", "end", F.lit(2).alias("pri"), F.lit("fallback").alias("type")).unionByName(over.select("file", F.lit(1).cast("long").alias("start"), F.least("lines", F.lit(40)).alias("end"), F.lit(1).alias("pri"), F.lit("file_overview").alias("type")))


def probes(t):
    f = files(t).select("file", T.line_count(F.col("text")).alias("lines")).filter("lines > 0")
    return f.select("file", F.explode(F.sequence(F.lit(1).cast("long"), F.col("lines"))).alias("line"))


@query(f"""WITH {SQL_CHUNKS}, r AS (SELECT file, line, "start", "end", type, row_number() OVER (PARTITION BY file, line ORDER BY pri DESC, "end" - "start", "start") AS r FROM probes JOIN c USING (file) WHERE line BETWEEN "start" AND "end") SELECT file, line, "start", "end", type FROM r WHERE r = 1""")
def chunk_at_line_priority(t):
    return retrieval.chunk_at(probes(t), chunks(t), [F.desc("pri"), F.col("end") - F.col("start"), F.col("start")]).select("file", "line", "start", "end", "type")


@query(f"""WITH {SQL_CHUNKS}, r AS (SELECT file, line, "start", "end", type, row_number() OVER (PARTITION BY file, line ORDER BY "start", "end", pri DESC) AS r FROM probes JOIN c USING (file) WHERE line BETWEEN "start" AND "end") SELECT file, line, "start", "end", type FROM r WHERE r = 1""")
def chunk_at_line_first(t):
    return retrieval.chunk_at(probes(t), chunks(t), [F.col("start"), F.col("end"), F.desc("pri")]).select("file", "line", "start", "end", "type")


@query(f"""WITH {SQL_CHUNKS} SELECT type, count(*) AS n, CAST(sum("end" - "start" + 1) AS BIGINT) AS n_lines FROM c GROUP BY type""")
def chunk_type_counts(t):
    return chunks(t).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start") + 1).alias("n_lines"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) AS line_no FROM documents WHERE text <> ''),
  m AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM l WHERE regexp_matches(line, '(?i)licen[sc]e|secret|password|copyright|@')) SELECT doc_id, line_no FROM m WHERE r <= 40""")
def regex_scan(t):
    wanted = "(?i)licen[sc]e|secret|password|copyright|@"
    d = t("documents").filter("text <> ''").filter(F.col("text").rlike(wanted))
    at = F.filter(F.transform(T.lines(F.col("text")), lambda line, i: F.when(line.rlike(wanted), (i + 1).cast("long"))), lambda i: i.isNotNull())
    return d.select("doc_id", F.explode(F.slice(at, 1, 40)).alias("line_no"))


# --- channels and fusion ------------------------------------------------------------------------------

SQL_BM25 = (
    f"WITH {SQL_TOKENS.replace('{}', 'documents')}, p AS (SELECT doc_id, unnest(t) AS token, len(t) AS l FROM toks WHERE t IS NOT NULL), n AS (SELECT count(*) AS n, sum(coalesce(len(t), 0)) / count(*) AS a FROM toks),"
    "d AS (SELECT token, ln(n.n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, n GROUP BY token, n.n), i AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM d) ELSE idf END AS idf FROM d),"
    + SQL_TOKENS.replace('{}', 'benchmark').replace("toks AS", "qt AS")
    + ", q AS (SELECT item_id, unnest(t) AS token FROM qt), raw AS (SELECT item_id, doc_id, round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * l / n.a))), 9) AS raw FROM q JOIN i USING (token) JOIN p USING (token), n GROUP BY 1, 2 HAVING sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * l / n.a))) > 0),"
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY raw DESC, doc_id) AS r FROM raw), bm AS (SELECT item_id, doc_id, round(10 * raw / max(raw) OVER (PARTITION BY item_id), 6) AS score FROM ranked WHERE r <= 200)"
)


@query(SQL_BM25 + " SELECT item_id, doc_id, round(score, 3) AS score FROM bm")
def bm25_topk(t):
    return retrieval.bm25(t("documents"), t("benchmark")).withColumn("score", F.round("score", 3))


SQL_FUSED = SQL_BM25 + """, ex AS (SELECT item_id, doc_id, 50.0 AS score FROM benchmark b JOIN documents d ON b.text <> '' AND contains(d.text, b.text)),
  u AS (SELECT item_id, doc_id, score, 'bm25' AS channel FROM bm UNION ALL SELECT item_id, doc_id, score, 'exact' FROM ex),
  fu AS (SELECT item_id, doc_id, round(sum(score), 3) AS score, string_agg(DISTINCT channel, '+' ORDER BY channel) AS source FROM u GROUP BY 1, 2),
  b AS (SELECT item_id, doc_id, fu.source AS channels, d.source AS dir, round(fu.score + CASE WHEN n_chars > 2000 THEN 3 WHEN n_chars > 500 THEN 2 ELSE 1 END, 3) AS score FROM fu JOIN documents d USING (doc_id)),
  g AS (SELECT *, row_number() OVER (PARTITION BY item_id, dir ORDER BY score DESC, doc_id) AS g FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM g WHERE g <= 2)"""


def fused(t):
    bm = retrieval.bm25(t("documents"), t("benchmark")).select("item_id", "doc_id", "score", F.lit("bm25").alias("channel"))
    exact = retrieval.holding(t("documents"), t("benchmark"))
    f = retrieval.fuse([bm, exact], ["item_id", "doc_id"]).withColumnRenamed("source", "channels").withColumn("score", F.round("score", 3))
    bonus = F.when(F.col("n_chars") > 2000, 3).when(F.col("n_chars") > 500, 2).otherwise(1)
    return f.join(t("documents").select("doc_id", F.col("source").alias("dir"), "n_chars"), "doc_id").withColumn("score", F.round(F.col("score") + bonus, 3)).drop("n_chars")


@query(SQL_FUSED + " SELECT item_id, doc_id, channels, score, rank FROM o WHERE rank <= 8")
def search_fused(t):
    return retrieval.diversify(fused(t), ["item_id"], "dir", [F.desc("score"), F.col("doc_id")], 2, 8).select("item_id", "doc_id", "channels", "score", F.col("rank").cast("long").alias("rank"))


@query(SQL_FUSED + ", k AS (SELECT item_id, count(*) AS n, max(score) AS top, count(*) FILTER (contains(channels, 'exact')) AS exact FROM b GROUP BY item_id) SELECT item_id, n, top, exact FROM k")
def score_breakdown(t):
    return fused(t).groupBy("item_id").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.count_if(F.contains("channels", F.lit("exact"))).alias("exact"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, x.vec_id, round(list_inner_product(list_transform(q.embedding, lambda c: CAST(c AS DOUBLE)), list_transform(x.embedding, lambda c: CAST(c AS DOUBLE))), 6) AS s FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM s), k AS (SELECT *, max(s) OVER (PARTITION BY query_id) AS top FROM r WHERE r <= 50) SELECT query_id, vec_id, r, round(20 * s / top, 4) AS score FROM k WHERE top > 0""")
def dense_topk(t):
    return retrieval.dense(t("embeddings"), F.col("vec_id") % 50 == 0).withColumn("r", F.col("r").cast("long"))


@query("""WITH g AS (SELECT lang, source, doc_id, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS g FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM g WHERE g <= 2) SELECT lang, source, doc_id, rank FROM r WHERE rank <= 8""")
def diversify_topk(t):
    d = t("documents").select("lang", "source", "doc_id", "n_chars")
    return retrieval.diversify(d, ["lang"], "source", [F.desc("n_chars"), F.col("doc_id")], 2, 8).select("lang", "source", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH g AS (SELECT l_orderkey, l_partkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity + 0.1 END) AS r, max(CASE WHEN l_linenumber <> 1 THEN l_quantity END) AS o, count(*) AS hits, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS m FROM lineitem GROUP BY 1, 2)
  SELECT l_orderkey, l_partkey, hits, round(greatest(greatest(r, o) + 0.15 * (hits - 1) - CASE WHEN m = 1 THEN 0.25 ELSE 0 END, 0), 4) AS score FROM g""")
def smart_merge(t):
    h = t("lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").alias("score"), "l_linenumber", "l_returnflag")
    return retrieval.merge_hits(h, ["l_orderkey"], "l_partkey", F.col("l_linenumber") == 1, F.col("l_returnflag") == "R")


# --- graph --------------------------------------------------------------------------------------------

SQL_LINKS = r"""raw AS (SELECT regexp_replace(url, '^[a-z]+://([^/?#]*).*$', '\1') AS src, regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), '^/', '') AS dst FROM pages),
  links AS (SELECT src, dst, 'include' AS kind, round(sum(1.0), 4) AS weight FROM raw WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)"""


def links(t):
    raw = t("pages").select(F.regexp_replace("url", "^[a-z]+://([^/?#]*).*$", "$1").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("d"))
    return graph.weighted_edges(raw.select("src", F.regexp_replace("d", "^/", "").alias("dst"), F.lit("include").alias("kind"), F.lit(1.0).alias("weight")))


@query(f"WITH {SQL_LINKS} SELECT src, dst, kind, weight FROM links")
def link_edges(t):
    return links(t)


SQL_ADJ = """n AS (SELECT coalesce(source, 'none') AS dir, doc_id, lead(doc_id) OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id) AS nxt FROM documents)"""


@query(f"WITH {SQL_ADJ} SELECT dir, doc_id AS src, nxt AS dst, 0.25 AS weight FROM n WHERE nxt IS NOT NULL")
def same_dir_adjacent_edges(t):
    d = t("documents").select(F.coalesce("source", F.lit("none")).alias("dir"), F.col("doc_id").alias("src"))
    return stats.following(d, "dir", "src", "dst", F.floor(F.col("src") / 100_000)).select("dir", "src", "dst", F.lit(0.25).alias("weight"))


@query(f"WITH {SQL_LINKS} SELECT dst, kind, round(sum(weight), 4) AS indegree, count(*) AS n FROM links GROUP BY dst, kind")
def weighted_indegree_by_kind(t):
    return links(t).groupBy("dst", "kind").agg(F.round(F.sum("weight"), 4).alias("indegree"), F.count("*").alias("n"))


@query()
def pagerank_global(t):
    e = links(t)
    return graph.pagerank(e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.2).alias("weight"))), rounds=40).select("id", F.round("rank", 9).alias("rank"))


SQL_MENTIONS = f"WITH {SQL_TOKENS.replace('{}', 'documents')}, e AS (SELECT doc_id, unnest(t) AS token FROM toks), k AS (SELECT token, count(*) AS n FROM e WHERE length(token) >= 4 GROUP BY token HAVING count(*) BETWEEN 2 AND 30)"


@query(SQL_MENTIONS + " SELECT doc_id, count(*) AS n_symbols, CAST(sum(n) AS BIGINT) AS n_mentions FROM e JOIN k USING (token) GROUP BY doc_id")
def mention_edges(t):
    """One shuffle of tokens: of each no task sends on more than 31 documents, as whoever has 31 is left out anyway. A task sorts all its tokens for that, so it gets few texts."""
    e = pieces(t("documents").select("doc_id", "text")).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")).filter(F.length("token") >= 4)
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy("doc_id"))).filter("r <= 31")
    e = e.withColumn("n", F.max("r").over(Window.partitionBy("token"))).filter("n BETWEEN 2 AND 30")
    return e.groupBy("doc_id").agg(F.count("*").alias("n_symbols"), F.sum("n").cast("long").alias("n_mentions"))


# --- windows over the log -----------------------------------------------------------------------------


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM events""")
def dispatch_state_fold(t):
    e = t("events").select("event_id", "user_id", "ts", F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")).alias("own"))
    return stats.running_last(e, "user_id", ["ts", "event_id"], "own", "state", F.date_trunc("month", "ts")).select("event_id", "user_id", "state")


@query("SELECT user_id, event_type, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY 1, 2")
def dispatch_defaults(t):
    return t("events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_id, r FROM r WHERE r <= 5")
def history_tail(t):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return t("events").select("user_id", "event_id", r.cast("long").alias("r")).filter("r <= 5")


@query("WITH d AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, n, n - lag(n, 1, 0) OVER (ORDER BY day) AS delta FROM d")
def sync_delta(t):
    d = t("events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return d.select(F.col("day").cast("string").alias("day"), "n", (F.col("n") - F.lag("n", 1, 0).over(Window.orderBy("day"))).alias("delta"))  # a row to a day


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1), f(stat, p) AS (VALUES ('p50', 0.5), ('p95', 0.95), ('p99', 0.99)) SELECT event_type, stat, v[CAST(floor(len(v) * p) AS BIGINT) + 1] AS value FROM s, f""")
def latency_percentiles(t):
    return stats.order_statistics(t("events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("SELECT l_returnflag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS b, round(exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))), 3) AS a FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1")
def power_fit(t):
    f = t("lineitem").filter("l_quantity > 0 AND l_extendedprice > 0").select("l_returnflag", F.log("l_extendedprice").alias("y"), F.log("l_quantity").alias("x"))
    return f.groupBy("l_returnflag").agg(F.round(F.regr_slope("y", "x"), 6).alias("b"), F.round(F.exp(F.regr_intercept("y", "x")), 3).alias("a"))


# --- evaluation ---------------------------------------------------------------------------------------

SQL_EVAL = """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents),
  e AS (SELECT d.source, d.lang, list(l.doc_id) AS exp FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1 GROUP BY 1, 2), f AS (SELECT source, list(doc_id) FILTER (r <= 5) AS f5, list(doc_id) FILTER (r <= 10) AS f10 FROM r WHERE r <= 10 GROUP BY 1),
  q AS (SELECT source, lang, len(exp) AS n, len(list_intersect(exp, f5)) AS hit5, len(list_intersect(exp, f10)) AS hit10, CASE WHEN len(exp) = 1 THEN 'single' ELSE 'multi' END AS multiplicity FROM e JOIN f USING (source))"""


def evaluated(t):
    d = t("documents").select("source", "lang", "doc_id", "n_chars")
    r = d.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).filter("r <= 10")
    hit = t("labels").filter("quality = 1").join(d, "doc_id").join(r.select("doc_id", "r"), "doc_id", "left")
    q = hit.groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("r") <= 5).alias("hit5"), F.count_if(F.col("r") <= 10).alias("hit10"))
    return q.withColumn("multiplicity", F.when(F.col("n") == 1, "single").otherwise("multi"))


@query(SQL_EVAL + " SELECT source, lang, CAST(n AS BIGINT) AS n, CAST(hit5 AS BIGINT) AS hit5, CAST(hit10 AS BIGINT) AS hit10, hit5 > 0 AS passed, round(hit5 / n, 6) AS cov5, round(hit10 / n, 6) AS cov10 FROM q")
def eval_recall_cov(t):
    return evaluated(t).select("source", "lang", "n", "hit5", "hit10", (F.col("hit5") > 0).alias("passed"), F.round(F.col("hit5") / F.col("n"), 6).alias("cov5"), F.round(F.col("hit10") / F.col("n"), 6).alias("cov10"))


@query(SQL_EVAL + " SELECT lang, multiplicity, count(*) AS n_questions, round(avg(hit5 / n), 6) AS mean_cov5, round(avg(hit5 / n), 6) >= 0.7 AS gate FROM q GROUP BY CUBE (lang, multiplicity)")
def eval_cube(t):
    return evaluated(t).cube("lang", "multiplicity").agg(F.count("*").alias("n_questions"), F.round(F.avg(F.col("hit5") / F.col("n")), 6).alias("mean_cov5")).withColumn("gate", F.col("mean_cov5") >= 0.7)


@query("SELECT 'hit' AS side, doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE n_chars > 500) UNION ALL SELECT 'miss', doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM documents WHERE n_chars > 500)")
def set_ops_expected_found(t):
    e, f = t("labels").filter("quality = 1").select("doc_id"), t("documents").filter("n_chars > 500").select("doc_id")
    return e.intersect(f).select(F.lit("hit").alias("side"), "doc_id").unionAll(e.subtract(f).select(F.lit("miss"), "doc_id"))


@query(SQL_EVAL + ", w(w) AS (VALUES (0), (5), (10), (15), (20), (25)), s AS (SELECT w, round(avg(least(1, (hit5 + w * hit10 / 25.0) / n)), 6) AS mean_cov FROM q, w GROUP BY w) SELECT w, mean_cov, row_number() OVER (ORDER BY mean_cov DESC, w) = 1 AS best FROM s")
def weight_sweep(t):
    q = evaluated(t).select("n", "hit5", "hit10", F.explode(F.array(*(F.lit(w) for w in (0, 5, 10, 15, 20, 25)))).alias("w"))
    s = q.groupBy("w").agg(F.round(F.avg(F.least(F.lit(1.0), (F.col("hit5") + F.col("w") * F.col("hit10") / 25.0) / F.col("n"))), 6).alias("mean_cov"))
    return s.withColumn("best", F.row_number().over(Window.orderBy(F.desc("mean_cov"), "w")) == 1)  # six rows


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(t):
    return t("events").groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
