"""Function times from a log of nested calls, flags of files, and a vector store's refresh, on tables made of the driver's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.operators import profile, stats, vectors
from skeinworks.plans.graph_queries import SQL_RECORDS, SQL_TREE, records
from skeinworks.plans.queries import files, query
from skeinworks.plans.search_queries import SQL_CODE, code
from skeinworks.plans.stage import stage

# --- function times -----------------------------------------------------------------------------------


def call_log(t) -> DataFrame:
    """Each event is a call of its type, which calls an inner function, which calls the first again; a user's calls stand in one main call."""
    e = t("events").select("user_id", "event_type", "event_id", (F.col("event_id") * 1000).alias("b"))
    inner, end, deep = F.concat(F.lit("inner_"), "event_type"), F.col("b") + 200 + F.col("event_id") % 7, F.col("b") + 21 + F.col("event_id") % 50
    steps = ((F.col("b"), F.col("event_type"), 1), (F.col("b") + 10, inner, 1), (F.col("b") + 20, F.col("event_type"), 1), (deep, F.col("event_type"), -1), (F.col("b") + 100, inner, -1), (end, F.col("event_type"), -1))
    rows = F.explode(F.array(*(F.struct(at.alias("at"), func.alias("func"), F.lit(up).alias("up")) for at, func, up in steps)))
    each = e.select(F.col("user_id").alias("trace"), rows.alias("x")).select("trace", "x.*")
    whole = e.groupBy(F.col("user_id").alias("trace")).agg((F.min("b") - 1).alias("a"), (F.max("b") + 999).alias("z"))
    whole = whole.select("trace", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit("main").alias("func"), F.lit(1).alias("up")), F.struct(F.col("z").alias("at"), F.lit("main").alias("func"), F.lit(-1).alias("up")))).alias("x")).select("trace", "x.*")
    return stage(each.unionByName(whole).withColumn("n", F.lit(0)), "calls")


@query(
    """WITH e AS (SELECT user_id, event_type, event_id * 1000 AS b, 200 + event_id % 7 AS d, 1 + event_id % 50 AS l FROM events), u AS (SELECT user_id, max(b) + 999 - (min(b) - 1) AS d FROM e GROUP BY 1), s AS (SELECT event_type, count(*) AS n, sum(d) AS d, sum(l) AS l FROM e GROUP BY 1)
  SELECT event_type AS func, 2 * n AS calls, n AS outer_calls, CAST(d - 90 * n + l AS BIGINT) AS own, CAST(d AS BIGINT) AS total FROM s UNION ALL SELECT 'inner_' || event_type, n, n, CAST(90 * n - l AS BIGINT), 90 * n FROM s
  UNION ALL SELECT 'main', count(*), count(*), CAST(sum(d) - (SELECT sum(d) FROM s) AS BIGINT), CAST(sum(d) AS BIGINT) FROM u"""
)
def function_times(t):
    return stats.call_times(call_log(t), bucket=1_000_000)


# --- flags of files -----------------------------------------------------------------------------------

SUFFIXES = [".cpp", ".h", ".RC", ".idl", ".txt", "", ".hh", ".s"]
SQL_FLAGS = f"{SQL_TREE}" r""", q AS (SELECT top || '/' || w1 || '/' || 'Sub' || k % 3 || '/f' || k || ['.cpp', '.h', '.RC', '.idl', '.txt', '', '.hh', '.s'][CAST(k % 8 AS INTEGER) + 1] AS path, CASE WHEN k % 17 = 0 THEN 1 + k % 60 END AS mark, k, w1, top FROM p),
  fo AS (SELECT DISTINCT upper(top) || '/' || w1 AS folder FROM q WHERE k % 19 = 0 UNION SELECT DISTINCT top || '/' || w1 || '/sub2' FROM q WHERE k % 23 = 0 UNION SELECT 'vendor')"""


@query(
    f"WITH {SQL_FLAGS}"
    r""", v AS (SELECT path, arg_max(folder, length(folder)) AS folder FROM q JOIN fo ON starts_with(lower(path), lower(folder) || '/') GROUP BY 1)
  SELECT path, CASE k % 8 WHEN 0 THEN 'C++' WHEN 1 THEN 'C/C++ Header' WHEN 2 THEN 'Resource' WHEN 3 THEN 'IDL' WHEN 6 THEN 'C/C++ Header' WHEN 7 THEN 'Asm' ELSE 'Text' END AS language, k % 8 = 2 OR coalesce(mark <= 40, false) AS generated, folder IS NOT NULL AS vendored, folder FROM q LEFT JOIN v USING (path)"""
)
def file_flags(t):
    """A marker stands in every seventeenth file, in line 1 to 60, and counts among the first 40."""
    k = F.col("p_partkey")
    top = F.element_at(F.array(*(F.lit(x) for x in ("src", "vendor", "lib", "third_party", "tools", "extra", "src"))), (k % 7 + 1).cast("int"))
    p = t("part").select(k.alias("k"), top.alias("top"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w1"))
    suffix = F.element_at(F.array(*(F.lit(x) for x in SUFFIXES)), (F.col("k") % 8 + 1).cast("int"))
    path = F.concat("top", F.lit("/"), "w1", F.lit("/Sub"), (F.col("k") % 3).cast("string"), F.lit("/f"), F.col("k").cast("string"), suffix)
    lines = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.when((F.col("k") % 17 == 0) & (i == F.col("k") % 60), "// Do Not EDIT").otherwise("int x;"))
    flagged = p.select(path.alias("path"), lines.alias("lines"))
    one = p.filter("k % 19 = 0").select(F.concat(F.upper("top"), F.lit("/"), "w1").alias("folder"))
    two = p.filter("k % 23 = 0").select(F.concat("top", F.lit("/"), "w1", F.lit("/sub2")).alias("folder"))
    return profile.flags(flagged, one.unionByName(two).unionByName(p.sparkSession.createDataFrame([("vendor",)], "folder string")))


# --- a vector store -----------------------------------------------------------------------------------


def model_stub(texts: list[str]) -> list[list[float]]:
    """Stands for a model: counts of four letters."""
    return [[float(1 + t.count(c)) for c in "aeio"] for t in texts]


def two_versions(t) -> tuple[DataFrame, DataFrame]:
    """Chunks before and after: those of remainder 3 by 10 come, 4 change, 6 go."""
    c = code(t)[0].select("chunk", "file", "type", "symbol", "class", "text").withColumn("r", F.col("chunk") % 10)
    return c.filter("r <> 3").drop("r"), c.filter("r <> 6").withColumn("text", F.when(F.col("r") == 4, F.concat("text", F.lit("\r\nmore"))).otherwise(F.col("text"))).drop("r")


SQL_VECTORS = f"{SQL_CODE}" r""", t0 AS (SELECT chunk, 'file: ' || file || chr(10) || 'class: ' || class || chr(10) || 'symbol: ' || symbol || chr(10) || 'type: ' || type || chr(10) || chr(10) || text AS t FROM c), o AS (SELECT DISTINCT t FROM t0 WHERE chunk % 10 <> 3), n AS (SELECT chunk, CASE WHEN chunk % 10 = 4 THEN t || chr(10) || 'more' ELSE t END AS t FROM t0 WHERE chunk % 10 <> 6)"""


@query(
    f"WITH {SQL_VECTORS} SELECT (SELECT count(*) FROM n) AS chunks, (SELECT count(DISTINCT t) FROM n) AS texts, (SELECT count(DISTINCT t) FROM n WHERE t IN (SELECT t FROM o)) AS kept, (SELECT count(DISTINCT t) FROM n WHERE t NOT IN (SELECT t FROM o)) AS embedded, (SELECT count(*) FROM o WHERE t NOT IN (SELECT t FROM n)) AS removed"
)
def vector_refresh(t):
    before, after = two_versions(t)
    store, _ = vectors.refresh(None, before, "stub", model_stub)
    return vectors.refresh(store, after, "stub", model_stub)[1]


@query(f"WITH {SQL_VECTORS} SELECT chunk FROM n WHERE t NOT IN (SELECT t FROM o)")
def stale_chunks(t):
    before, after = two_versions(t)
    return vectors.stale(after, vectors.refresh(None, before, "stub", model_stub)[0], "stub")


# --- reports ------------------------------------------------------------------------------------------

SQL_TAGS = f"{SQL_RECORDS}, tg AS (SELECT file, CASE doc_id % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'macro' ELSE 'function' END AS kind FROM counted WHERE doc_id % 5 <> 0 UNION ALL SELECT file, 'function' FROM counted WHERE doc_id % 5 = 1)"


def tags(t) -> DataFrame:
    """Files but every fifth have a tag, some two."""
    d = files(t).select("file", "doc_id")
    kind = F.when(F.col("doc_id") % 4 == 0, "class").when(F.col("doc_id") % 4 == 1, "macro").otherwise("function")
    return d.filter("doc_id % 5 <> 0").select("file", kind.alias("kind")).unionByName(d.filter("doc_id % 5 = 1").select("file", F.lit("function").alias("kind")))


@query(f"WITH {SQL_TAGS} SELECT file, kind, count(*) AS n FROM tg GROUP BY 1, 2 UNION ALL SELECT NULL, kind, count(*) FROM tg GROUP BY kind")
def tag_counts(t):
    return profile.tag_counts(tags(t))


@query(f'WITH {SQL_TAGS} SELECT file FROM rec WHERE NOT "binary" AND file NOT IN (SELECT file FROM tg)')
def untagged_files(t):
    return profile.untagged(records(t), tags(t))


@query(
    f"WITH {SQL_TAGS}"
    """, bare AS (SELECT file FROM rec WHERE NOT "binary" AND file NOT IN (SELECT file FROM tg)), co AS (SELECT 'folder' AS what, top_dir AS key, count(*) AS n FROM rec GROUP BY 2 UNION ALL SELECT 'encoding', encoding, count(*) FROM rec GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM tg GROUP BY 2)
  SELECT 'total' AS what, 'files' AS key, count(*) AS n FROM rec UNION ALL SELECT 'total', 'lines', CAST(sum(lines) AS BIGINT) FROM rec UNION ALL SELECT 'total', 'binary', count(*) FILTER ("binary") FROM rec UNION ALL SELECT 'total', 'generated', count(*) FILTER (generated) FROM rec
  UNION ALL SELECT what, key, n FROM co UNION ALL SELECT 'longest', file, lines FROM (SELECT file, lines FROM rec ORDER BY lines DESC, file LIMIT 20) UNION ALL SELECT 'untagged', file, 1 FROM (SELECT file FROM bare ORDER BY file LIMIT 20) UNION ALL SELECT 'risk', 'untagged', count(*) FROM bare"""
)
def probe_report(t):
    """The one-row report, told as rows; its lists are 20 long by design."""
    r = profile.report(records(t).drop("tagged"), tags(t), long=40)
    told = lambda what, array, key, n: r.select(F.lit(what).alias("what"), F.explode(array).alias("x")).select("what", F.expr(key).alias("key"), F.expr(n).cast("long").alias("n"))
    out = told("folder", "folders", "x.key", "x.n").unionByName(told("encoding", "encodings", "x.key", "x.n")).unionByName(told("kind", "kinds", "x.key", "x.n")).unionByName(told("longest", "longest", "x.file", "x.lines")).unionByName(told("untagged", "untagged", "x", "1"))
    for what, key, value in (("total", "files", "totals.n_files"), ("total", "lines", "totals.n_lines"), ("total", "binary", "totals.n_binary"), ("total", "generated", "totals.n_generated"), ("risk", "untagged", "risk.untagged")):
        out = out.unionByName(r.select(F.lit(what).alias("what"), F.lit(key).alias("key"), F.col(value).cast("long").alias("n")))
    return out
