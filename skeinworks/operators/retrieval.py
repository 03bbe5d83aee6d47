"""Ranking channels in long format (query_id, file, channel, score), their fusion, and diversification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skeinworks.functions.text import lines, tokens
from skeinworks.plans.stage import blocks, bounded_batches, spread, stage


#: The most terms of queries, and bytes of passages and of query vectors, that are broadcast at once, and the most rows that a task's best of all queries hold.
MOST_TERMS, PASSAGE_BYTES, DENSE_BYTES, MOST_BEST = 200_000, 1 << 24, 1 << 25, 1 << 20
#: Sums, and what they are made of, that a task holds at once.
RUN_CELLS = 1 << 20


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, len): the distinct tokens of each row and how many it has."""
    t = docs.select(key, tokens(F.col(text)).alias("t"))
    return t.select(F.explode("t").alias("token"), key, F.size("t").alias("len"))


class Best:
    """The k best (score, key) of each query that a task has seen: greater scores first, then lesser keys. Pruned as it grows, so it holds a few k to a query; what is behind a query's k-th is not taken in."""

    def __init__(self, k: int, n_queries: int):
        self.k, self.most = k, max(1 << 18, 4 * k * n_queries)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0
        self.least, self.last = np.full(n_queries, -np.inf), np.empty(n_queries, object)  # score and key of the k-th

    def add(self, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        least = self.least[query]
        own = score > least
        tied = np.flatnonzero(score == least)
        if len(tied):
            own[tied] = (key[tied] < self.last[query[tied]]).astype(bool)
        if not own.all():
            query, key, score = query[own], key[own], score[own]
        if not len(query):
            return
        self.parts.append((query, key, score))
        self.n += len(query)
        if self.n > self.most:
            query, key, score = kept = self.kept()
            end = np.flatnonzero(np.append(query[1:] != query[:-1], True))
            full = end[np.diff(np.append(-1, end)) == self.k]
            self.least[query[full]], self.last[query[full]] = score[full], key[full]
            self.parts, self.n = [kept], len(query)

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, key, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        place = key
        if key.dtype == object:
            place = np.empty(len(key), np.int64)
            place[np.argsort(key, kind="stable")] = np.arange(len(key))
        order = np.lexsort((place, -score, query))
        query, key, score = query[order], key[order], score[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, np.int64)
        nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        own = nth < self.k
        return query[own], key[own], score[own]

    def batch(self, ids: pa.Array, kinds: list, names: list[str]) -> pa.RecordBatch:
        query, key, score = self.kept() if self.parts else (np.empty(0, np.int64), np.empty(0, object), np.empty(0))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(query)).cast(kinds[0]), pa.array(key.tolist(), kinds[1]), pa.array(score, pa.float64())], names)


def _kept(found: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """Of the tasks' best rows (query, key, s) the k best of each query, with their rank r."""
    order = Window.partitionBy(query).orderBy(F.desc("s"), key)
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)


def bm25(
    docs: DataFrame, queries: DataFrame, key: str = "doc_id", query: str = "item_id", k: int = 200, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, terms: Column | None = None
) -> DataFrame:
    """(query, key, score): Okapi scores over distinct tokens, the best k of each query, scaled so that the best has 10.

    A negative inverse document frequency becomes epsilon times the mean of all. Rows without a query token don't appear.
    terms: the queries' tokens, by default those of their text. While they are few they are broadcast, a row is scored for all
    queries where it lies, and a task sends on no more than the k best of each query: what is shuffled follows queries, k and tasks,
    not the rows that share a token with a query. Beyond MOST_TERMS, a join by token does it.
    """
    # Texts are cut into tokens once: they are written, and read for counts and for scores.
    p = stage(spread(docs).select(F.col(key).alias("key"), tokens(F.col("text")).alias("t")), "tokens", "lz4")
    each = p.select("key", F.explode("t").alias("token"), F.size("t").alias("len"))
    n = docs.select(F.count("*").alias("n_docs")).join(F.broadcast(each.select(F.count("*").alias("n_tokens")))).filter("n_docs > 0")
    df = each.groupBy("token").agg(F.count("*").alias("df"))
    idf = stage(df.join(F.broadcast(n)).withColumn("idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "idf")  # n: one row
    floor = idf.agg((F.avg("idf") * epsilon).alias("floor"))
    idf = idf.join(F.broadcast(floor)).select("token", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"), (F.col("n_tokens") / F.col("n_docs")).alias("avg_len"))
    each_query = queries.select(F.col(query).alias("query"), F.explode(tokens(F.col("text")) if terms is None else terms).alias("token")).distinct()
    asked = stage(each_query.groupBy("query").agg(F.array_sort(F.collect_list("token")).alias("tokens")), "asked-tokens")
    first = asked.groupBy("tokens").agg(F.min("query").alias("first"))
    members = asked.join(first, "tokens").select("query", "first")
    q = stage(first.select(F.col("first").alias("query"), F.explode("tokens").alias("token")).join(idf, "token"), "query-terms")
    if q.count() <= MOST_TERMS:
        raw = _scored_copies(p, q, k, k1, b)
    else:
        hit = each.join(q, "token")
        one = F.col("idf") * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
        raw = hit.groupBy("query", "key").agg(F.round(F.sum(one), 9).alias("s")).filter("s > 0")
    kept = _kept(raw, "query", "key", k)
    scaled = kept.select(F.col("query").alias("first"), F.col("key").alias(key), F.round(10 * F.col("s") / F.max("s").over(Window.partitionBy("query")), 6).alias("score"))
    return members.join(scaled, "first").select(F.col("query").alias(query), key, "score")


def _scored_copies(p: DataFrame, q: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """As `_scored`; where rows of p share their tokens with another on average, one of them is scored for all, and stands for its k least keys."""
    n = p.agg(F.count("t").alias("n"), F.approx_count_distinct(F.xxhash64("t")).alias("texts")).first()
    if 2 * n["texts"] > n["n"]:
        return _scored(p, q, k, k1, b)
    least = F.row_number().over(Window.partitionBy("t").orderBy("key"))
    same = p.filter("t IS NOT NULL").withColumn("r", least).filter(F.col("r") <= k).groupBy("t").agg(F.min("key").alias("key"), F.collect_list("key").alias("keys"))  # k keys at most
    same = stage(same, "copies", "lz4")
    best = _kept(_scored(same.select("key", "t"), q, k, k1, b), "query", "key", k).join(same.select("key", "keys"), "key")
    # Rows behind k rows of greater scores are out; those of equal scores are told apart by their keys.
    size, by = F.size("keys"), Window.partitionBy("query")
    ahead = F.sum(size).over(by.orderBy(F.desc("s"))) - F.sum(size).over(Window.partitionBy("query", "s"))
    return best.withColumn("ahead", ahead).filter(F.col("ahead") < k).select("query", F.explode("keys").alias("key"), "s")


def _scored(p: DataFrame, q: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(query, key, s): each task's best k rows of p (key, t) for each query of q (query, token, idf, avg_len), which is small.

    Queries go in blocks, so that the best of a block's queries are MOST_BEST rows to a task, however many ask.
    """
    kinds = [to_arrow_type(q.schema["query"].dataType), to_arrow_type(p.schema["key"].dataType)]
    bounded_batches(p.sparkSession)
    every = q.toPandas()  # MOST_TERMS rows at most
    codes, ids = pd.factorize(every["query"])
    avg = float(every["avg_len"].iloc[0]) if len(every) else 1.0
    n = max(1, MOST_BEST // k)

    def found(at: int) -> DataFrame:
        own = (codes >= at) & (codes < at + n)
        terms, of_query = every[own], codes[own] - at
        # A term's queries and weights lie together, from first[term] on.
        term, words = pd.factorize(terms["token"])
        order = np.argsort(term, kind="stable")
        first = np.searchsorted(term[order], np.arange(len(words) + 1))
        whole = (pa.array(words, pa.string()), first, of_query[order], terms["idf"].to_numpy(float)[order] * (k1 + 1), pa.array(ids[at : at + n].tolist(), kinds[0]))
        held = p.sparkSession.sparkContext.broadcast(whole)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, first, of_query, weight, ids = held.value
            best = Best(k, len(ids))
            for batch in batches:
                keys, lists = _keys(batch.column(0)), batch.column(1)
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                met = pc.index_in(lists.flatten(), value_set=words)
                here = np.flatnonzero(pc.is_valid(met).to_numpy(zero_copy_only=False))
                row, met = np.repeat(np.arange(len(size)), size)[here], met.drop_null().to_numpy().astype(np.int64)
                wide = first[met + 1] - first[met]
                # Rows go in pieces of about RUN_CELLS numbers.
                piece = np.cumsum(np.bincount(row, wide, len(size)).astype(np.int64) + len(ids)) // RUN_CELLS
                ends = np.searchsorted(piece, np.unique(piece), "right") if len(ids) else []
                for low, high in zip([0, *ends[:-1]], ends, strict=True):
                    a, z = np.searchsorted(row, [low, high])
                    if a == z:
                        continue
                    w = wide[a:z]
                    at_ = np.repeat(first[met[a:z]] - np.append(0, np.cumsum(w)[:-1]), w) + np.arange(w.sum())
                    total = np.bincount(np.repeat(row[a:z] - low, w) * len(ids) + of_query[at_], weight[at_], (high - low) * len(ids))
                    some = np.flatnonzero(total)
                    of, query = some // len(ids) + low, some % len(ids)
                    s = np.round(total[some] / (1 + k1 * (1 - b + b * size[of] / avg)), 9)
                    up = s > 0
                    best.add(query[up], keys[of[up]], s[up])
            yield best.batch(ids, kinds, ["query", "key", "s"])

        return p.mapInArrow(run, f"query {q.schema['query'].dataType.simpleString()}, key {p.schema['key'].dataType.simpleString()}, s double")

    return reduce(DataFrame.unionByName, [found(at) for at in range(0, max(1, len(ids)), n)])


def _keys(column: pa.Array) -> np.ndarray:
    """Keys as numbers where they are, which sort and compare faster than objects."""
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist(), object)


def dense(vectors: DataFrame, is_query: Column, k: int = 50, weight: float = 20.0, most: int = DENSE_BYTES) -> DataFrame:
    """(query_id, vec_id, r, score): inner products of the query rows with all others, the best k of each query, scaled by the best.

    Queries are broadcast in blocks of about `most` bytes, and multiplied with each batch of rows as matrices; of a task's products
    only the best k of a query are shuffled. Vectors that are null, hold a null or have another length than most take no part.
    """
    whole = vectors.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())).select("vec_id", "embedding")
    size = whole.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    whole = whole.filter(F.size("embedding") == (size["size"] if size else 0))
    asked = whole.filter(is_query)
    kind, id_type = vectors.schema["vec_id"].dataType.simpleString(), to_arrow_type(vectors.schema["vec_id"].dataType)
    bounded_batches(vectors.sparkSession)

    def found(block: DataFrame) -> DataFrame:
        rows = block.collect()  # about `most` bytes
        ids = [r[0] for r in rows]
        held = vectors.sparkSession.sparkContext.broadcast((ids, np.array([r[1] for r in rows], np.float64).T))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            best, place = Best(k, len(ids)), {x: i for i, x in enumerate(ids)}
            for batch in batches if ids else ():
                keys = _keys(batch.column(0))
                own = np.array([place.get(key, -1) for key in keys.tolist()])
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)
                for at in range(0, len(ids), 1024):
                    s = np.round(x @ q[:, at : at + 1024], 6).T
                    top = np.argsort(-s, axis=1, kind="stable") if s.shape[1] <= k else None
                    least = np.full(len(s), -np.inf) if top is not None else np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]  # own row beside k others
                    query, row = np.nonzero(s >= least[:, None])
                    other = own[row] != query + at
                    best.add(query[other] + at, keys[row[other]], s[query[other], row[other]])
            yield best.batch(pa.array(ids, id_type), [id_type, id_type], ["query_id", "vec_id", "s"])

        return whole.mapInArrow(run, f"query_id {kind}, vec_id {kind}, s double")

    rows = max(1, min(most // (8 * max(1, size["size"] if size else 1)), MOST_BEST // k))
    kept = _kept(reduce(DataFrame.unionByName, [found(x) for x in blocks(asked, "vec_id", rows)]), "query_id", "vec_id", k)
    top = F.max("s").over(Window.partitionBy("query_id"))
    return kept.withColumn("top", top).filter("top > 0").select("query_id", "vec_id", "r", F.round(weight * F.col("s") / F.col("top"), 4).alias("score"))


def holding(docs: DataFrame, passages: DataFrame, key: str = "doc_id", query: str = "item_id", score: float = 50.0) -> DataFrame:
    """(query, key, score, channel 'exact'): rows whose text has a whole passage in it.

    A text is read once for all passages of a block, by an automaton; blocks hold about PASSAGE_BYTES.
    """
    wanted = stage(passages.filter("text <> ''").select(F.col(query).alias("q"), F.col("text").alias("passage")), "passages")
    size = wanted.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    n = -(-size // PASSAGE_BYTES) or 1
    kinds = [docs.schema[key].dataType.simpleString(), wanted.schema["q"].dataType.simpleString()]
    bounded_batches(docs.sparkSession)

    def found(block: DataFrame) -> DataFrame:
        of: dict[str, list] = {}
        for q, text in block.collect():  # PASSAGE_BYTES at most, on average
            of.setdefault(text, []).append(q)
        held = docs.sparkSession.sparkContext.broadcast(of)

        def scan(batches):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for text in held.value:
                automaton.add_word(text, text)
            automaton.make_automaton()
            for batch in batches if held.value else ():
                ids, at, asked = batch.column(0), [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for passage in {x for _, x in automaton.iter(text)} if text else ():
                        at += [i] * len(held.value[passage])
                        asked += held.value[passage]
                yield pa.RecordBatch.from_arrays([pa.array(asked, wanted_type), ids.take(pa.array(at, pa.int64()))], ["q", "k"])

        return docs.select(key, "text").mapInArrow(scan, f"q {kinds[1]}, k {kinds[0]}")

    wanted_type = to_arrow_type(wanted.schema["q"].dataType)
    met = [found(wanted if n == 1 else wanted.filter(F.pmod(F.xxhash64("passage"), F.lit(n)) == i)) for i in range(n)]
    return reduce(DataFrame.unionByName, met).select(F.col("q").alias(query), F.col("k").alias(key), F.lit(score).alias("score"), F.lit("exact").alias("channel"))


def fuse(channels: list[DataFrame], keys: list[str]) -> DataFrame:
    """Sum of all channels' scores and the channels' names, for each (query, row)."""
    every = channels[0]
    for c in channels[1:]:
        every = every.unionByName(c)
    return every.groupBy(*keys).agg(F.round(F.sum("score"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("source"))


def diversify(hits: DataFrame, query: list[str], group: str, order: list[Column], per_group: int | Column, k: int) -> DataFrame:
    """At most per_group hits of a group in rank order, then the best k of each query; adds rank."""
    own = hits.withColumn("__g", F.row_number().over(Window.partitionBy(*query, group).orderBy(*order))).filter(F.col("__g") <= per_group).drop("__g")
    return own.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(*order))).filter(F.col("rank") <= k)


def merge_hits(hits: DataFrame, query: list[str], chunk: str, raw: Column, missed: Column) -> DataFrame:
    """Merge sub-queries' hits: the raw query's score gains 0.1, each further hit 0.15, and a missed requirement costs 0.25 (not below 0)."""
    g = hits.groupBy(*query, chunk).agg(F.max(F.when(raw, F.col("score") + 0.1)).alias("r"), F.max(F.when(~raw, F.col("score"))).alias("o"), F.count("*").alias("hits"), F.max(missed.cast("int")).alias("m"))
    best = F.greatest("r", "o") + 0.15 * (F.col("hits") - 1) - F.when(F.col("m") == 1, 0.25).otherwise(0.0)
    return g.select(*query, chunk, "hits", F.round(F.greatest(best, F.lit(0.0)), 4).alias("score"))


def chunk_at(probes: DataFrame, chunks: DataFrame, order: list[Column], step: int = 64) -> DataFrame:
    """The chunk of each probe (file, line) by the given order, among those of its file whose range has the line.

    They meet by the pieces of `step` lines that a range touches, not by the file alone.
    """
    at = probes.withColumn("__at", F.floor(F.col("line") / step))
    cut = chunks.withColumn("__at", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor(F.greatest("start", "end") / step))))
    hit = at.join(cut, ["file", "__at"]).filter("line BETWEEN start AND end").drop("__at")
    return hit.withColumn("__r", F.row_number().over(Window.partitionBy("file", "line").orderBy(*order))).filter("__r = 1").drop("__r")


def scan_top_files(docs: DataFrame, scores: DataFrame, queries: DataFrame, key: str = "doc_id", query: str = "item_id", n_files: int = 12, n_patterns: int = 8, n_lines: int = 40) -> DataFrame:
    """(query, key, n_lines, first_line): lines of each query's best files that hold one of its longest tokens in any case, at most n_lines of a file.

    The files come from other channels' scores (query, key, score). A text is tested where it lies; lines are not exploded.
    """
    top = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))
    best = scores.groupBy(query, key).agg(F.max("score").alias("score")).withColumn("r", top).filter(F.col("r") <= n_files).select(query, key)
    words = F.filter(tokens(F.col("text")), lambda w: F.length(w) >= 3)
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    patterns = queries.select(query, F.transform(F.slice(ranked, 1, n_patterns), lambda x: x["w"]).alias("patterns"))
    met = best.join(patterns, query).join(docs.select(key, F.transform(lines(F.col("text")), F.lower).alias("lines")), key)
    places = F.filter(F.transform("lines", lambda line, i: F.when(F.exists("patterns", lambda p: F.contains(line, p)), i + 1)), lambda i: i.isNotNull())
    return met.select(query, key, F.slice(places, 1, n_lines).alias("at")).filter(F.size("at") > 0).select(query, key, F.size("at").cast("long").alias("n_lines"), F.element_at("at", 1).cast("long").alias("first_line"))


def by_channel(hits: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """A column of summed scores for each channel, 0 where it is silent."""
    return hits.groupBy(*keys).agg(*(F.round(F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("score"))), F.lit(0.0)), 6).alias(c) for c in channels))


def expand_bundle(primary: DataFrame, companions: DataFrame, query: list[str], chunk: str) -> DataFrame:
    """Primary hits (query, chunk, score, rank) and their companions (chunk, other, role, place, factor), each chunk once in a query.

    A chunk that is primary stays so; else the companion of the best-ranked hit, then of the least place, gives role and
    score, which is the hit's times factor, to two decimals.
    """
    own = primary.select(*query, chunk, F.lit("primary").alias("role"), "score", F.struct(F.lit(0).alias("a"), F.col("rank").cast("long").alias("b"), F.lit(0).alias("c")).alias("o"))
    more = primary.join(companions, chunk).select(*query, F.col("other").alias(chunk), "role", F.round(F.col("score") * F.col("factor"), 2).alias("score"), F.struct(F.lit(1).alias("a"), F.col("rank").cast("long").alias("b"), F.col("place").cast("int").alias("c")).alias("o"))
    return own.unionByName(more).groupBy(*query, chunk).agg(F.min_by(F.struct("role", "score"), "o").alias("x")).select(*query, chunk, "x.role", "x.score")


def graph_extras(primary: DataFrame, mentions: DataFrame, query: str, chunk: str, file: str, k: int = 3, weight: float = 25.0) -> DataFrame:
    """(query, chunk, file, score): chunks of other files that mention the primary hits' symbols, `weight` for each such hit; one a file, best k.

    primary has (query, chunk, file, symbol), mentions (symbol, chunk, file). Ties go to the lesser chunk.
    """
    met = primary.filter("symbol <> ''").select(query, "symbol").join(mentions, "symbol").groupBy(query, chunk, file).agg((F.count("*") * weight).alias("score"))
    other = met.join(primary.select(query, file).distinct(), [query, file], "left_anti")
    one = F.row_number().over(Window.partitionBy(query, file).orderBy(F.desc("score"), chunk))
    best = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), chunk))
    return other.withColumn("r", one).filter("r = 1").withColumn("r", best).filter(F.col("r") <= k).select(query, chunk, file, "score")


def dispatch_scores(asked: DataFrame, entries: DataFrame, query: str, chunk: str) -> DataFrame:
    """(query, chunk, score, focus): 140 and 8 (pattern in the text) or 4 points for chunks that handle an asked command; focus is the last entry's line.

    asked has (query, command); entries (command, chunk, line, sure).
    """
    met = asked.distinct().join(entries, "command")
    return met.groupBy(query, chunk).agg((F.lit(140.0) + F.max(F.when(F.col("sure"), 8.0).otherwise(4.0))).alias("score"), F.max("line").alias("focus"))


def unique_names(symbols: DataFrame, name: str, key: str, score: float = 125.0) -> DataFrame:
    """Symbols whose lower-cased name exactly one key has."""
    n = symbols.groupBy(F.lower(name).alias("name")).agg(F.min(key).alias("a"), F.max(key).alias("b"))
    return n.filter("a = b").select("name", F.col("a").alias(key), F.lit(score).alias("score"))


def context(hits: DataFrame, query: str, most: int = 8) -> DataFrame:
    """The hits (query, score, role, ord) of an answer's context: all if at most `most`, else primary ones by score, then others."""
    w = Window.partitionBy(query)
    r = F.row_number().over(w.orderBy(F.when(F.col("role") == "primary", 0).otherwise(1), F.desc("score"), "ord"))
    return hits.withColumn("n", F.count("*").over(w)).withColumn("r", r).filter(F.col("r") <= most).withColumn("place", F.when(F.col("n") <= most, F.row_number().over(w.orderBy("ord"))).otherwise(F.col("r"))).drop("n", "r")
