"""Evaluation of retrieval: layers that lose a file, kinds of misses, gates, regressions, deviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least mean coverage at five that passes.
GATE = 0.7


def layers(expected: DataFrame, found: dict[str, DataFrame], query: str, file: str) -> DataFrame:
    """(query, file, lost): for each expected file the first layer, in the order given, whose (query, file) rows lack it; 'OK' if none."""
    out, lost = expected.select(query, file).distinct(), F.lit(None).cast("string")
    for i, (name, rows) in enumerate(found.items()):
        out = out.join(rows.select(query, file).distinct().withColumn(f"__{i}", F.lit(True)), [query, file], "left")
        lost = F.coalesce(lost, F.when(F.col(f"__{i}").isNull(), name))
    return out.select(query, file, F.coalesce(lost, F.lit("OK")).alias("lost"))


def miss_class(dense_rank: Column, fused_rank: Column, k: int = 5, near: int = 10) -> Column:
    """A: absent from the dense channel's best; B1, B2, B3: there, but fused rank beyond `near` or absent, up to `near`, up to k."""
    return F.when(dense_rank.isNull(), "A").when(fused_rank.isNull() | (fused_rank > near), "B1").when(fused_rank > k, "B2").otherwise("B3")


def squeeze(top: DataFrame, expected: DataFrame, query: str, file: str) -> DataFrame:
    """(query, form, n_noise): form 1 if a repeated file of the top hits is expected, or nothing there is noise; else form 2."""
    e = expected.select(query, file).distinct().withColumn("__e", F.lit(True))
    g = top.groupBy(query, file).agg(F.count("*").alias("c")).join(e, [query, file], "left")
    s = g.groupBy(query).agg(F.max(F.when(F.col("__e"), F.col("c")).otherwise(0)).alias("again"), F.coalesce(F.sum(F.when(F.col("__e").isNull(), F.col("c"))), F.lit(0)).alias("n_noise"))
    return s.select(query, F.when((F.col("again") > 1) | (F.col("n_noise") == 0), 1).otherwise(2).alias("form"), "n_noise")


def verdict(in_pool: Column, in_top: Column, in_context: Column, in_answer: Column) -> Column:
    """Where an expected file was lost: recall, ranking, context, answer; or that it was cited. A null answer was not asked for."""
    return F.when(~in_pool, "recall").when(~in_top, "ranking").when(in_answer.isNull(), "not asked").when(~in_context, "context").when(~in_answer, "answer").otherwise("cited")


def summary(questions: DataFrame, split: str) -> DataFrame:
    """Count, passes, mean coverage at 5 and 10 and the gate, for each split and over all (split null). questions has hit5, hit10, n."""
    return questions.rollup(split).agg(
        F.count("*").alias("n_questions"), F.count_if(F.col("hit5") > 0).alias("passed"), F.round(F.avg(F.col("hit5") / F.col("n")), 6).alias("mean_cov5"), F.round(F.avg(F.col("hit10") / F.col("n")), 6).alias("mean_cov10")
    ).withColumn("gate", F.col("mean_cov5") >= GATE)


def redacted(df: DataFrame, sealed: Column, details: list[str]) -> DataFrame:
    """df with the detail columns null where sealed."""
    return df.withColumns({c: F.when(~F.coalesce(sealed, F.lit(False)), F.col(c)) for c in details})


def regressions(base: DataFrame, now: DataFrame, key: list[str], measure: str) -> DataFrame:
    """Rows that had a full measure in base and have less now; a row absent now has 0."""
    b = base.filter(F.col(measure) >= 1).select(*key, F.col(measure).alias("before"))
    return b.join(now.select(*key, F.col(measure).alias("after")), key, "left").withColumn("after", F.coalesce("after", F.lit(0.0))).filter("after < 1")


def deviation(pairs: DataFrame, stated: str, counted: str) -> DataFrame:
    """One row: totals of both counts over rows that have both, the deviation in percent, and whether it is below 2."""
    both = pairs.filter(F.col(stated).isNotNull() & F.col(counted).isNotNull())
    s = both.agg(F.count("*").alias("n"), F.coalesce(F.sum(stated), F.lit(0)).alias("stated"), F.coalesce(F.sum(counted), F.lit(0)).alias("counted"))
    d = F.when(F.col("stated") == 0, F.when(F.col("counted") == 0, 0.0).otherwise(100.0)).otherwise(F.round(100.0 * (F.col("counted") - F.col("stated")) / F.col("stated"), 6))
    return s.withColumn("percent", d).withColumn("fine", F.abs("percent") < 2)


def gap_to_place(ranked: DataFrame, query: list[str], score: str, rank: str, place: int = 5) -> DataFrame:
    """Rows below `place` with how far their score is from that place's."""
    at = ranked.filter(F.col(rank) == place).select(*query, F.col(score).alias("__s"))
    return ranked.filter(F.col(rank) > place).join(at, query).withColumn("gap", F.round(F.col("__s") - F.col(score), 6)).drop("__s")


def first_place(ranked: DataFrame, query: list[str], group: str, order: list[Column]) -> DataFrame:
    """The best rank of each group in its query."""
    r = F.row_number().over(Window.partitionBy(*query).orderBy(*order))
    return ranked.withColumn("r", r).groupBy(*query, group).agg(F.min("r").cast("long").alias("first"))


def symbols_found(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """(query, symbol, found) of expected symbols (query, symbol): whether a hit (query, file, symbol, class) has that name in any case; for `class::name`, of that class or in a file that names it.

    Names meet by equality, so questions and hits may be any number.
    """
    e = expected.select("query", "symbol").distinct()
    full = F.contains("symbol", F.lit("::"))
    name = F.lower(F.when(full, F.regexp_replace("symbol", "^.*?::", "")).otherwise(F.col("symbol")))
    owner = F.when(full, F.lower(F.split_part("symbol", F.lit("::"), F.lit(1))))
    h = hits.select("query", F.lower("symbol").alias("name"), F.lower(F.coalesce("class", F.lit(""))).alias("__c"), F.lower("file").alias("__f")).distinct()
    met = e.withColumn("name", name).withColumn("owner", owner).join(h, ["query", "name"]).filter(F.col("owner").isNull() | (F.col("__c") == F.col("owner")) | F.contains("__f", "owner"))
    return e.join(met.select("query", "symbol").distinct().withColumn("found", F.lit(True)), ["query", "symbol"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def in_answer(symbol: Column, answer: Column) -> Column:
    """The answer says the symbol; of `class::name` both parts, the class in any case."""
    owner = F.split_part(symbol, F.lit("::"), F.lit(1))
    both = F.contains(answer, F.regexp_replace(symbol, "^.*?::", "")) & F.contains(F.lower(answer), F.lower(owner))
    return F.when(F.contains(symbol, F.lit("::")), both).otherwise(F.contains(answer, symbol))


def context_layer(files: DataFrame, symbols: DataFrame, bundle: DataFrame, trimmed: DataFrame) -> DataFrame:
    """(query, file_cov, sym_bundle, sym_trim, sym_n, trim_loss): what of a question's expected files (query, file) and symbols (query, symbol) its hits hold.

    bundle: all hits (query, file, symbol, class, role); files count by primary ones. trimmed: those that a prompt shows.
    Nothing expected is covered whole.
    """
    primary = bundle.filter("role = 'primary'").select("query", "file").distinct().withColumn("hit", F.lit(1))
    f = files.select("query", "file").distinct().join(primary, ["query", "file"], "left").groupBy("query").agg((F.count("hit") / F.count("*")).alias("file_cov"))
    sums = lambda rows, name: symbols_found(symbols, rows).groupBy("query").agg(F.count_if("found").alias(name), F.count("*").alias("n"))
    s = sums(bundle, "sym_bundle").join(sums(trimmed, "sym_trim").drop("n"), "query")
    out = f.join(s, "query", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = out.select("query", F.coalesce("file_cov", F.lit(1.0)).alias("file_cov"), zero("sym_bundle"), zero("sym_trim"), F.coalesce("n", F.lit(0)).alias("sym_n"))
    return out.withColumn("trim_loss", F.col("sym_bundle") - F.col("sym_trim"))


def answer_rates(rows: DataFrame) -> DataFrame:
    """One row of an evaluation's rates: of answers (cite_ok, expected_n, expected_hit, ctx_n, ctx_hit) those with good citations, with all expected files, with all of the context's; and the mean share of the context's files."""
    every = F.col("expected_hit") == F.col("expected_n")
    whole = (F.col("ctx_n") > 0) & (F.col("ctx_hit") == F.col("ctx_n"))
    rate = lambda c: F.coalesce(F.round(F.try_divide(F.count_if(c), F.count("*")), 6), F.lit(0.0))
    share = F.avg(F.when(F.col("ctx_n") > 0, F.col("ctx_hit") / F.col("ctx_n")))
    return rows.agg(F.count("*").alias("n"), rate(F.col("cite_ok")).alias("citation_ok_rate"), rate(every).alias("all_expected_files_rate"), rate(whole).alias("context_primary_full_rate"), F.coalesce(F.round(share, 6), F.lit(0.0)).alias("mean_context_primary_ratio"))
