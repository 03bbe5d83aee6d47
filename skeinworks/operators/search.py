"""Search over chunks and symbols for many queries at once: exact channels, their fusion with adjustments, hits, re-ranking.

Tables: chunks (chunk, file, start, end, type, symbol, class, symbol_start, text), symbols (file, name, kind, class,
line), asked (query, text, tokens: expanded). Channels give (query, chunk, score); names are met by equality joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions import rules
from skeinworks.functions import text as T
from skeinworks.operators import stats
from skeinworks.operators.retrieval import chunk_at, diversify
from skeinworks.plans.stage import stage

# Scores of the channels.
METHOD, CLASS_METHOD, SYMBOL, DISPATCH, SCAN, GRAPH = 125.0, 108.0, 100.0, 140.0, 50.0, 25.0
CHANNELS = ["method", "class", "dispatch", "symbol", "bm25", "rg", "dense"]
# Patterns of qualified names.
SCOPED = r"\b((?:[A-Za-z_]\w*::)+)([A-Za-z_]\w*)\b"
QUALIFIED = r"[A-Za-z_]\w*::[A-Za-z_]\w*"
# Lines of a snippet, how far an event call is looked for, and how far it stretches the snippet.
SNIPPET, SNIPPET_SCAN, SNIPPET_CAP, EVENT_CALL = 10, 40, 28, "call_event"

SYMBOL_KEY = ["file", "name", "class", "line"]
#: Chunks that a list of a class's methods holds, at most on average.
LIST = 1 << 16
PRIORITY = {"function": 4, "class": 3, "fallback": 2, "file_overview": 1}


def ask(queries: DataFrame, query: str = "query") -> DataFrame:
    """(query, text, tokens): queries with their tokens and the seeds of triggered hints."""
    text = F.coalesce("text", F.lit(""))
    return queries.select(F.col(query).alias("query"), text.alias("text"), rules.expanded(text, T.tokens(text)).alias("tokens"))


def priority(kind: Column) -> Column:
    out = F.lit(0)
    for name, points in PRIORITY.items():
        out = F.when(kind == name, points).otherwise(out)
    return out


def best_at(probes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each probe (file, line) with its chunk: the highest kind, then the shortest, then the first."""
    order = [F.desc(priority(F.col("type"))), F.col("end") - F.col("start"), F.col("start"), F.col("chunk")]
    return chunk_at(probes.select("file", "line").distinct(), chunks.select("chunk", "file", "start", "end", "type"), order)


def chunks_of(symbols: DataFrame, chunks: DataFrame, lines: bool = True) -> DataFrame:
    """(file, name, class, line, kind, chunk, type, start, impl): each symbol's chunks.

    Those of its file with its name (and class, where both have one); else the chunk at its line; for macros, enums and
    typedefs else the file's overview. Without lines (line is null), definitions that share their chunks by name give them once.
    """
    s = symbols.dropDuplicates(SYMBOL_KEY).select(*SYMBOL_KEY, "kind")
    c = chunks.select("chunk", "file", "type", "start", F.col("symbol").alias("name"), F.col("class").alias("__class"))
    clash = (F.col("class") != "") & (F.col("__class") != "") & (F.col("class") != F.col("__class"))
    one = s if lines else s.select("file", "name", "class", F.lit(None).cast(s.schema["line"].dataType).alias("line"), "kind").distinct()
    named = one.join(c, ["file", "name"]).filter(~clash).select(*SYMBOL_KEY, "kind", "chunk", "type", "start")
    # Whether a name has chunks doesn't hang on the line, so each name is asked for once.
    names = ["file", "name", "class"]
    owners = c.select("file", "name", "__class").distinct()
    rest = s.join(s.select(*names).distinct().join(owners, ["file", "name"]).filter(~clash).select(*names).distinct(), names, "left_anti")
    at = rest.join(best_at(rest, chunks), ["file", "line"]).select(*SYMBOL_KEY, "kind", "chunk", "type", "start")
    bare = rest.filter(F.col("kind").isin("macro", "enum", "typedef")).join(at.select(*SYMBOL_KEY), SYMBOL_KEY, "left_anti")
    first = chunks.filter(F.col("type") == "file_overview").groupBy("file").agg(F.min(F.struct("start", "chunk")).alias("o"))
    over = bare.join(first, "file").select(*SYMBOL_KEY, "kind", F.col("o.chunk").alias("chunk"), F.lit("file_overview").alias("type"), F.col("o.start").alias("start"))
    impl = (F.col("type") == "function") & rules.suffix(F.col("file")).isin(*rules.IMPLEMENTATION)
    return named.unionByName(at).unionByName(over).withColumn("impl", impl)


def mentioned(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbols that a question can meet by a token or by a qualified name: only their chunks are needed."""
    tokens = asked.select(F.explode("tokens").alias("__key")).distinct()
    full = qualified(asked, SCOPED, True).unionByName(qualified(asked, QUALIFIED, False)).select(F.col("full").alias("__key")).distinct()
    plain = symbols.withColumn("__key", F.lower("name")).join(tokens, "__key", "left_semi")
    scoped = symbols.filter("class <> ''").withColumn("__key", full_name(symbols)).join(full, "__key", "left_semi")
    return plain.unionByName(scoped).drop("__key").distinct()


def implementations(of: DataFrame) -> DataFrame:
    """Of each symbol's chunks the functions of implementation files, or all if there are none."""
    return of.withColumn("any", F.max("impl").over(Window.partitionBy(*SYMBOL_KEY))).filter("impl OR NOT any").drop("any")


def _words(asked: DataFrame, least: int) -> DataFrame:
    return asked.select("query", F.explode("tokens").alias("token")).filter(F.length("token") >= least)


def _best(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query", "chunk").agg(F.max("score").alias("score"))


def qualified(asked: DataFrame, pattern: str, parts: bool) -> DataFrame:
    """(query, full): lower-cased qualified names in the queries' texts."""
    full = F.transform(F.regexp_extract_all("text", F.lit(pattern), 0), F.lower)
    return asked.select("query", F.explode(F.array_distinct(full)).alias("full"))


def full_name(symbols: DataFrame) -> Column:
    return F.lower(F.concat("class", F.lit("::"), "name"))


def method(asked: DataFrame, symbols: DataFrame, of: DataFrame) -> DataFrame:
    """Chunks of the methods that a query names in full, and of functions whose name is unique among implementations."""
    s = symbols.select(*SYMBOL_KEY, "kind").distinct()
    exact = qualified(asked, SCOPED, True).join(s.filter("class <> ''").withColumn("full", full_name(s)), "full").select("query", *SYMBOL_KEY)
    impl = s.filter((F.col("kind") == "function") & rules.suffix(F.col("file")).isin(*rules.IMPLEMENTATION))
    key = F.struct(*SYMBOL_KEY)
    lone = impl.groupBy(F.lower("name").alias("token")).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).filter("lo = hi").select("token", "lo.*")
    types = s.filter(F.col("kind").isin("class", "struct")).select(F.lower("name").alias("token")).distinct()
    where = asked.withColumn("defined", F.array_contains("tokens", "defined") & ~F.array_contains("tokens", "implemented"))
    words = _words(where, 4).join(where.select("query", "defined"), "query")
    skipped = words.filter("defined").join(types, "token", "left_semi").select("query", "token")
    found = words.join(skipped, ["query", "token"], "left_anti").join(lone, "token").select("query", *SYMBOL_KEY)
    met = exact.unionByName(found).distinct().join(implementations(of), SYMBOL_KEY)
    return met.select("query", "chunk").distinct().withColumn("score", F.lit(METHOD))


def class_tokens(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query, token): tokens that are names of classes."""
    owners = symbols.filter("class <> ''").select(F.lower("class").alias("token"))
    types = symbols.filter(F.col("kind").isin("class", "struct")).select(F.lower("name").alias("token"))
    return _words(asked, 0).join(owners.unionByName(types).distinct(), "token", "left_semi").select("query", "token")


def class_chunks(of: DataFrame, chunks: DataFrame) -> DataFrame:
    """(token, chunk): the implemented methods of each class, by its lower-cased name, constructors left out."""
    built = chunks.filter("symbol <> '' AND symbol = class").select("chunk")
    return of.filter("kind = 'function' AND impl").select(F.lower("class").alias("token"), "chunk").distinct().join(built, "chunk", "left_anti")


def classes_asked(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query, token): the classes that questions on structure name."""
    return class_tokens(asked.filter(rules.structure_question(F.col("text"))), symbols)


def class_methods(asked: DataFrame, symbols: DataFrame, of: DataFrame, chunks: DataFrame) -> DataFrame:
    """For questions on structure, the implemented methods of the classes they name, constructors left out."""
    return expanded(classes_asked(asked, symbols), owned(class_chunks(of, chunks))).withColumn("score", F.lit(CLASS_METHOD))


def owned(methods: DataFrame) -> DataFrame:
    """(token, chunk, n), written: methods of classes with the number of classes that their chunk has."""
    return stage(methods.select("token", "chunk", F.count("*").over(Window.partitionBy("chunk")).alias("n")), "owned")


def expanded(named: DataFrame, methods: DataFrame, gone: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """(query, chunk), each once, of the methods (token, chunk, n) of the classes that a question names (query, token), but those gone (query, chunk).

    A class's chunks meet its questions as lists, dealt by class and a hash of the chunk, so neither a class of many chunks nor one
    that many questions name is a single task's work. Only chunks of several classes can come twice.
    members: (query, first), where what is named and gone is that of firsts of alike questions.
    """
    spark = named.sparkSession
    one, many = methods.filter("n = 1"), methods.filter("n > 1")
    n = -(-one.count() // LIST) or 1
    at = F.pmod(F.xxhash64("chunk"), F.lit(n)).cast("int").alias("list")
    lists = one.groupBy("token", at).agg(F.collect_list("chunk").alias("chunks"))
    asks = named.select("query", "token", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("list"))
    chunks = F.col("chunks")
    if gone is not None:
        out = gone.join(named, "query").join(one, ["token", "chunk"]).groupBy("query", "token", at).agg(F.collect_list("chunk").alias("gone"))
        asks = asks.join(out, ["query", "token", "list"], "left")
        chunks = F.when(F.col("gone").isNull(), chunks).otherwise(F.array_except("chunks", "gone"))
    each = lambda rows: rows if members is None else rows.withColumnRenamed("query", "first").join(members, "first").drop("first")
    # So many partitions as asked for: few rows come in, many go out.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = each(asks).repartition(tasks, "token", "list").join(lists, ["token", "list"]).select("query", F.explode(chunks).alias("chunk"))
    if many.isEmpty():
        return met
    twice = named.join(many, "token").select("query", "chunk").distinct()
    return met.unionByName(each(twice if gone is None else twice.join(gone, ["query", "chunk"], "left_anti")).select("query", "chunk"))


def leading(methods: DataFrame, chunks: DataFrame, most: int = 1) -> DataFrame:
    """Of each class's chunks (token, chunk) the first `most` of those in one file that differ in what hangs on the chunk alone.

    A question on structure keeps one hit of a file. What hangs on chunk and question is the same for one file, class and kind of
    handler, so a chunk that only its class brings in comes behind the first ones, unless their other channels cost them points.
    """
    file, symbol, owner = F.col("file"), F.col("symbol"), F.col("class")
    own = chunks.select(
        "chunk", "file", F.lower(F.coalesce(owner, F.lit(""))).alias("owner"), rules.own_handler(F.coalesce(symbol, F.lit(""))).alias("handler"), "start",
        rules.chunk_bonus(F.col("type"), file, symbol, owner, F.col("start"), F.col("symbol_start")).alias("bonus"), rules.is_entry(symbol, F.col("start"), F.col("symbol_start")).alias("entry"),
    )
    order = Window.partitionBy("token", "file", "owner", "handler").orderBy(F.desc("bonus"), F.desc("entry"), "start", "chunk")
    return methods.join(own, "chunk").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).select("token", "chunk")


def lowered(scores: DataFrame) -> int:
    """The most hits of one query that a channel (query, chunk, score) takes points from."""
    return scores.filter("score < 0").groupBy("query").count().agg(F.max("count")).first()[0] or 0


def classed(hits: DataFrame, named: DataFrame, methods: DataFrame) -> DataFrame:
    """Which of the hits (query, chunk) are methods (token, chunk) of the classes that their question names (query, token)."""
    return hits.join(named, "query").join(methods, ["token", "chunk"]).select("query", "chunk")


class Aside:
    """Hits that only a class brings in, behind another of their file: left aside before hits are merged, for questions that keep one hit of a file.

    named: the classes of questions (query, token); methods: of `owned`; first: of `leading`, met in any case; others: (query, chunk) of the
    other channels, distinct; met: (query, chunk) of all methods that weren't left aside.
    """

    def __init__(self, named: DataFrame, methods: DataFrame, first: DataFrame, others: DataFrame, met: DataFrame, asked: DataFrame, chunks: DataFrame):
        self.named, self.methods, self.others, self.met, self.asked, self.chunks = named, methods, others, met, asked, chunks
        # Those of one class that are never met by it; what has several classes may be the first of one and not of another.
        self.rest = methods.join(first, ["token", "chunk"], "left_anti").filter("n = 1").unionByName(methods.filter("n > 1"))

    def hits(self, members: DataFrame | None = None) -> DataFrame:
        """(query, chunk), of `members` of alike questions where given."""
        gone = self.others if self.methods.filter("n > 1").isEmpty() else self.met
        return expanded(self.named, self.rest, gone, members)

    def placed(self, hits: DataFrame) -> DataFrame:
        """Hits (query, chunk, score, entry, file, line_start, place and more) with their place among all hits: those left aside that come ahead count.

        One left aside scores by its class and its chunk, and by whether the question holds the chunk's stem or class. Those that agree
        in classes, stem, class and kind of handler move together, so each such group is put in order once for each of the few scores
        that coherence gives; of those of a class that is their chunk's only one, coherence is the same. What was met is taken off.
        """
        keys = ["owners", "__stem", "__owner", "__handler"]
        owners = self.rest.groupBy("chunk").agg(F.array_sort(F.collect_set("token")).alias("owners"))
        each = owners.join(chunk_points(self.chunks), "chunk")
        plain = (F.size("owners") == 1) & (F.get("owners", F.lit(0)) == F.col("__owner"))
        each = each.withColumn("__stem", F.when(plain, "").otherwise(F.col("__stem"))).withColumn("__handler", ~plain & F.col("__handler")).select("chunk", "file", F.col("start").alias("line"), "entry", "__bonus", *keys)
        groups = stage(each.groupBy(*keys).agg(F.max("__bonus").alias("top")).coalesce(1).withColumn("group", F.monotonically_increasing_id()), "groups")
        lists = stage(each.join(groups, keys).select("group", "chunk", "file", "line", "entry", "__bonus"), "resting")
        probes = stage(hits.join(self.named.select("query").distinct(), "query", "left_semi").select("query", "chunk", "score", "entry", "file", F.col("line_start").alias("line")), "probes")
        asks = self.named.join(probes.select("query").distinct(), "query", "left_semi").join(groups.select("group", F.explode("owners").alias("token")), "token").select("query", "group").distinct()
        coherent = rules.coherent(F.col("__stem"), F.col("__owner"), F.col("__handler"), F.col("tokens"), F.col("__named"))
        asks = stage(asks.join(groups, "group").join(asking(self.asked, self.chunks), "query").select("query", "group", "top", coherent.alias("more")), "groups-asked")
        score = F.round(F.lit(CLASS_METHOD) + (F.col("__bonus") + F.col("more")), 2).alias("score")
        key = ["score", "entry", "file", "line"]
        # Ahead in the order of a group: probes come before a method of the same key, which so doesn't count.
        rows = lists.join(asks.select("group", "more").distinct(), "group").select("group", "more", F.lit(None).cast(probes.schema["query"].dataType).alias("query"), "chunk", score, *key[1:], F.lit(1).alias("n"))
        near = probes.join(asks, "query").filter(F.lit(CLASS_METHOD + 0.01) + F.col("top") + F.col("more") >= F.col("score"))
        rows = rows.unionByName(near.select("group", "more", "query", "chunk", *key, F.lit(0).alias("n"))).withColumn("low", -F.col("score")).withColumn("late", ~F.col("entry"))
        run = stats.running_total(rows, ["group", "more"], ["low", "late", "file", "line", "chunk", "n"], F.col("n"), "ahead", F.struct("low", "late", "file"))
        met = self.met.select("query", "chunk").join(lists, "chunk").join(asks, ["query", "group"]).select("query", F.col("chunk").alias("other"), score, *key[1:])
        order = lambda row, chunk: F.struct(-F.col(f"{row}.score"), ~F.col(f"{row}.entry"), F.col(f"{row}.file"), F.col(f"{row}.line"), F.col(f"{row}.{chunk}"))
        off = probes.alias("p").join(met.alias("o"), (F.col("p.query") == F.col("o.query")) & (order("o", "other") < order("p", "chunk")))
        counts = run.filter("n = 0").select("query", "chunk", "ahead").unionByName(off.select("p.query", "p.chunk", F.lit(-1).cast("long").alias("ahead")))
        ahead = counts.groupBy("query", "chunk").agg(F.sum("ahead").alias("ahead"))
        return hits.join(ahead, ["query", "chunk"], "left").withColumn("place", F.col("place") + F.coalesce("ahead", F.lit(0))).drop("ahead")


def symbol_matches(asked: DataFrame, symbols: DataFrame, of: DataFrame) -> DataFrame:
    """Chunks of the symbols that a query names: 100 by qualified name, else by token what `rules.symbol_weight` says."""
    name = ["file", "name", "class"]
    first = symbols.groupBy(*name).agg(F.min("line").alias("line"))
    exact = qualified(asked, QUALIFIED, False).join(first.filter("class <> ''").withColumn("full", full_name(first)), "full").select("query", *SYMBOL_KEY).distinct()
    plain = _words(asked, 3).join(first.withColumn("token", F.lower("name")), "token").select("query", *SYMBOL_KEY).distinct()
    plain = plain.join(exact.select("query", *name), ["query", *name], "left_anti").join(of, SYMBOL_KEY).join(asked, "query")
    weight = rules.symbol_weight(F.col("name"), F.col("kind"), F.col("file"), F.col("class"), F.col("line"), F.col("start"), F.col("text"), F.col("tokens"))
    return _best(exact.join(of, SYMBOL_KEY).select("query", "chunk", F.lit(SYMBOL).alias("score")).unionByName(plain.select("query", "chunk", weight.alias("score"))))


def dispatch(asked: DataFrame, entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, chunk, score, focus): chunks at the lines that handle a command of the query; entries (command, file, line, sure)."""
    met = asked.select("query", F.explode(T.commands(F.col("text"))).alias("command")).join(entries, "command")
    at = met.join(best_at(met, chunks).select("file", "line", "chunk"), ["file", "line"])
    return at.groupBy("query", "chunk").agg((F.lit(DISPATCH) + F.max(F.when(F.col("sure"), 8.0).otherwise(4.0))).alias("score"), F.max("line").alias("focus"))


def scan(asked: DataFrame, scores: DataFrame, lines: DataFrame, chunks: DataFrame, n_files: int = 12, n_patterns: int = 8, n_lines: int = 40) -> DataFrame:
    """Chunks at the lines, `n_lines` of a file at most, that hold one of a query's longest tokens, in the best files of other channels' scores."""
    best = scores.join(chunks.select("chunk", "file"), "chunk").groupBy("query", "file").agg(F.max("score").alias("score"))
    files = best.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "file"))).filter(F.col("r") <= n_files).select("query", "file")
    ranked = F.array_sort(F.transform(F.filter("tokens", lambda w: F.length(w) >= 3), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    wanted = asked.select("query", F.transform(F.slice(ranked, 1, n_patterns), lambda x: x["w"]).alias("patterns"))
    met = files.join(wanted, "query").join(lines.select("file", "line", F.lower("text").alias("low")), "file").filter(F.exists("patterns", lambda p: F.contains("low", p)))
    first = met.withColumn("r", F.row_number().over(Window.partitionBy("query", "file").orderBy("line"))).filter(F.col("r") <= n_lines)
    return first.join(best_at(first, chunks).select("file", "line", "chunk"), ["file", "line"]).select("query", "chunk").distinct().withColumn("score", F.lit(SCAN))


def module_tokens(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, token): tokens of four letters that are a file's stem, or of five that lie in one. Parts of stems are met by their first five letters."""
    stems = chunks.select(rules.stem(F.col("file")).alias("stem")).distinct()
    words = _words(asked, 4)
    whole = words.join(stems.withColumnRenamed("stem", "token"), "token", "left_semi")
    grams = stems.filter(F.length("stem") >= 5).select("stem", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("stem") - 4), lambda i: F.substring("stem", i, F.lit(5))))).alias("gram"))
    within = words.filter(F.length("token") >= 5).withColumn("gram", F.substring("token", 1, 5)).join(grams, "gram").filter(F.contains("stem", "token")).select("query", "token")
    return whole.select("query", "token").unionByName(within).distinct()


def chunk_points(chunks: DataFrame) -> DataFrame:
    """What hits score by their chunk alone, and what of it coherence asks for."""
    file, symbol, owner = F.col("file"), F.col("symbol"), F.col("class")
    return chunks.select(
        "chunk", "file", "start", rules.is_entry(symbol, F.col("start"), F.col("symbol_start")).alias("entry"),
        rules.chunk_bonus(F.col("type"), file, symbol, owner, F.col("start"), F.col("symbol_start")).alias("__bonus"), rules.module_header(file).alias("__header"),
        rules.stem(file).alias("__stem"), F.lower(F.coalesce(owner, F.lit(""))).alias("__owner"), rules.own_handler(F.coalesce(symbol, F.lit(""))).alias("__handler"),
    )


def asking(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions with what coherence and the header boost ask for."""
    named = module_tokens(asked, chunks).select("query").distinct().withColumn("named", F.lit(True))
    return asked.join(named, "query", "left").select("query", "tokens", F.coalesce("named", F.lit(False)).alias("__named"), rules.hints(F.col("text"))["module"].alias("__module"))


def merge(channels: dict[str, DataFrame], asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, chunk, score, source, parts, file, start, entry): sums over the channels, with each chunk's bonus, coherence and header boost; parts maps channel to score.

    What hangs on the chunk or on the query alone is found once for each, before they meet: hits are many more than both.
    """
    each = [F.when(F.lit(name == c), F.col("score")).alias(f"__{c}") for name in channels for c in CHANNELS]
    rows = [d.select("query", "chunk", "score", *each[i * len(CHANNELS) : (i + 1) * len(CHANNELS)]) for i, d in enumerate(channels.values())]
    # A column to a channel: numbers are summed where lists of parts would be sorted. Dealt by chunk, rows stay where they are for the join.
    summed = reduce(DataFrame.unionByName, rows).repartition("chunk").groupBy("query", "chunk").agg(F.sum("score").alias("sum"), *(F.sum(f"__{c}").alias(f"__{c}") for c in CHANNELS))
    j = summed.join(chunk_points(chunks), "chunk").join(asking(asked, chunks), "query")
    coherent = rules.coherent(F.col("__stem"), F.col("__owner"), F.col("__handler"), F.col("tokens"), F.col("__named"))
    more = F.col("__bonus") + coherent + F.when(F.col("__module") & F.col("__header"), rules.HEADER_BOOST).otherwise(0.0)
    source = F.concat_ws("+", *(F.when(F.col(f"__{c}").isNotNull(), c) for c in CHANNELS))
    parts = F.array_compact(F.array(*(F.when(F.col(f"__{c}").isNotNull(), F.struct(F.lit(c).alias("channel"), F.col(f"__{c}").alias("score"))) for c in CHANNELS)))
    return j.select("query", "chunk", F.round(F.col("sum") + more, 2).alias("score"), source.alias("source"), parts.alias("parts"), "file", "start", "entry")


def hits(merged: DataFrame, focus: DataFrame, asked: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(all hits in order with place; the best k of each query, one of a file for questions on structure, else two)."""
    j = merged.join(focus.select("query", "chunk", "focus"), ["query", "chunk"], "left")
    j = j.join(asked.select("query", F.when(rules.structure_question(F.col("text")), 1).otherwise(2).alias("per_file")), "query")
    j = j.withColumn("line_start", F.coalesce("focus", "start"))
    order = [F.desc("score"), F.desc("entry"), F.col("file"), F.col("line_start"), F.col("chunk")]
    ranked = j.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return ranked, diversify(ranked, ["query"], "file", [F.col("place")], F.col("per_file"), k)


def drop_reason(ranked: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """(query, chunk, reason) of hits that the diversified list left out: the cap of their file, or their place."""
    before = F.row_number().over(Window.partitionBy("query", "file").orderBy("place")) - 1
    gone = ranked.withColumn("before", before).join(kept.select("query", "chunk"), ["query", "chunk"], "left_anti")
    return gone.select("query", "chunk", F.when(F.col("before") >= F.col("per_file"), "file").when(F.col("place") > k, "place").otherwise("unknown").alias("reason"))


def dominant_channel(kept: DataFrame, by: list[str]) -> DataFrame:
    """(by, place, channel): of the best kept hit of each group the channel with the greatest score, the first of equals."""
    best = kept.groupBy(*by).agg(F.min_by(F.struct("place", "parts"), "place").alias("x"))
    ordered = F.array_sort(F.transform("x.parts", lambda p, i: F.struct((-p["score"]).alias("s"), i.alias("i"), p["channel"].alias("channel"))))
    return best.select(*by, F.col("x.place").alias("place"), ordered[0]["channel"].alias("channel"))


def snippet(lines: Column, start: Column, focus: Column) -> Column:
    """The lines that a hit shows: ten from the first that is neither comment nor blank, or from two before the focus; more if an event is called nearby."""
    n = F.size(lines)
    plain = F.filter(F.transform(lines, lambda x, i: F.when(F.startswith(x, F.lit("//")) | (F.trim(x) == ""), None).otherwise(i)), lambda i: i.isNotNull())
    body = F.coalesce(F.get(plain, F.lit(0)), F.lit(0))
    at = F.greatest(F.lit(0), F.least(n - 1, (focus - start).cast("int")))
    first = F.when(F.coalesce(focus, F.lit(0)) != 0, F.greatest(body, at - 2)).otherwise(body)
    last = F.least(n, first + SNIPPET)
    seen = F.filter(F.transform(F.slice(lines, body + 1, F.lit(SNIPPET_SCAN)), lambda x, i: F.when(F.contains(x, F.lit(EVENT_CALL)), body + i)), lambda i: i.isNotNull())
    call = F.get(seen, F.lit(0))
    last = F.when(call.isNotNull(), F.greatest(last, F.least(call + 2, body + SNIPPET_CAP))).otherwise(last)
    return F.array_join(F.slice(lines, first + 1, F.greatest(F.lit(0), last - first)), "\n")


def header_of(files: DataFrame) -> DataFrame:
    """(file, header): for implementation files the first of the headers of the same path that exist."""
    base = F.regexp_replace("file", r"\.[^./]*$", "")
    own = files.select("file").distinct().withColumn("suffix", rules.suffix(F.col("file"))).withColumn("base", base)
    place = F.create_map(*(x for i, e in enumerate(rules.HEADER) for x in (F.lit(e), F.lit(i))))
    heads = own.filter(F.col("suffix").isin(*rules.HEADER)).groupBy("base").agg(F.min_by("file", place[F.col("suffix")]).alias("header"))
    return own.filter(F.col("suffix").isin(*rules.IMPLEMENTATION)).join(heads, "base").select("file", "header")


def companions(chunks: DataFrame) -> DataFrame:
    """(chunk, other, role, place, factor): each chunk's overview, and for a method the chunk of its class in the header."""
    over = chunks.filter("type = 'file_overview'").groupBy("file").agg(F.min(F.struct("start", "chunk")).alias("o")).select("file", F.col("o.chunk").alias("other"))
    first = chunks.select("chunk", "file").join(over, "file").select("chunk", "other", F.lit("overview").alias("role"), F.lit(0).alias("place"), F.lit(0.3).alias("factor"))
    kinds = chunks.filter("type = 'class'").groupBy(F.col("file").alias("header"), F.col("symbol").alias("class")).agg(F.min(F.struct("start", "chunk")).alias("o"))
    methods = chunks.filter("type = 'function' AND class <> ''").select("chunk", "file", "class").join(header_of(chunks), "file")
    second = methods.join(kinds, ["header", "class"]).select("chunk", F.col("o.chunk").alias("other"), F.lit("header").alias("role"), F.lit(1).alias("place"), F.lit(0.5).alias("factor"))
    return first.unionByName(second)
