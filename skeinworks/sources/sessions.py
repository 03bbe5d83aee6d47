"""A store of sessions: questions with their hits and answers as JSON lines, the newest of them, and one as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.sources.store import append_log, recent

HIT = "struct<file:string,line_start:bigint,symbol:string,score:double,source:string,bundle_role:string,snippet:string,chunk_id:string>"
SESSION = f"ts string, kind string, question string, query string, model string, answer string, hits array<{HIT}>"


def record(sessions: DataFrame, path: str, ts: Column | None = None) -> None:
    """Append sessions (any of the columns of SESSION) with the time `ts`, by default now."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss") if ts is None else ts
    append_log(sessions.withColumn("ts", now), path)


def newest(spark: SparkSession, path: str, n: int = 12) -> DataFrame:
    """The n newest sessions; none where there is no store. Lines that don't parse are left out."""
    return recent(spark, path, SESSION, "ts", n)


def markdown(sessions: DataFrame) -> DataFrame:
    """sessions with `markdown`: the question as title, time, kind and model, the answer, and the hits as a numbered list."""
    title = F.coalesce(F.nullif("question", F.lit("")), F.nullif("query", F.lit("")), F.lit("(no question)"))
    empty = lambda c: F.coalesce(c, F.lit(""))

    def line(h: Column, i: Column) -> Column:
        symbol = F.when(empty(h["symbol"]) != "", F.concat(F.lit(" `"), h["symbol"], F.lit("`"))).otherwise("")
        return F.concat((i + 1).cast("string"), F.lit(". `"), empty(h["file"]), F.lit(":"), empty(h["line_start"].cast("string")), F.lit("`"), symbol, F.lit(" score="), F.format_string("%.1f", F.coalesce(h["score"], F.lit(0.0))), F.lit(" source="), empty(h["source"]))

    head = F.concat(F.lit("# "), title, F.lit("\n\n- time: `"), empty(F.col("ts")), F.lit("`\n- kind: `"), empty(F.col("kind")), F.lit("`\n"))
    model = F.when(empty(F.col("model")) != "", F.concat(F.lit("- model: `"), "model", F.lit("`\n"))).otherwise("")
    found = F.when(F.size(F.coalesce("hits", F.array().cast(f"array<{HIT}>"))) > 0, F.concat(F.lit("\n\n## Sources\n\n"), F.array_join(F.transform("hits", line), "\n"))).otherwise("")
    return sessions.withColumn("markdown", F.concat(F.regexp_replace(F.concat(head, model, F.lit("\n## Answer\n\n"), empty(F.col("answer")), found), r"\s+$", ""), F.lit("\n")))
