"""How sources of a language differ in their terms, exactly, by a baseline and corrections from an inverted index.

Each source's term counts give every kept term a smoothed share. The divergence of a pair of sources sums a function of
both shares over all kept terms. For nearly all terms at least one count is zero, so a pair starts at the number of terms
times the function of two zero counts. A zero count's share is one number to a source, so terms that only one of
the two has correct the sum by how many terms a source has of each count; terms that both have meet in the index's
postings, which emit the correction of every pair of theirs, summed up in the tasks. What differs most is ranked by windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.llm.words import texts_of, trimmed
from skeinworks.plans.stage import bounded_batches, stage

#: Shares are counted in parts of SCALE; a text is cut at CHUNK bytes; a task sends counts on when it holds HELD of them.
SCALE, CHUNK, HELD = 1_000_000_000, 1 << 20, 150_000
#: Pairs of sources are summed in squares of SQUARE, of which a task holds SQUARES, and in runs of PAIRS pairs.
SQUARE, SQUARES, PAIRS = 256, 64, 1 << 20

# Every byte as it stands in a term: small letters for capitals, a blank for what parts terms. UTF-8's other bytes are all above 127.
_TERM = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _chunks(raw: bytes) -> Iterator[bytes]:
    """The text's terms with blanks between, in parts of about CHUNK bytes. A term is a maximal run of letters A to Z, made small, and characters beyond ASCII."""
    raw = raw.translate(_TERM)
    at = 0
    while at < len(raw):
        to = len(raw) if at + CHUNK >= len(raw) else raw.find(b" ", at + CHUNK)
        to = len(raw) if to < 0 else to
        yield raw[at:to]
        at = to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's documents, summed as far as HELD lets."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            words = list(n)
            for a in range(0, len(words), 1 << 14):
                w = words[a : a + (1 << 14)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(w), pa.string()), pa.array([source] * len(w), pa.string()), pa.array(w, pa.binary()).cast(pa.string()), pa.array([n[x] for x in w], pa.int64()), pa.array([docs[x] for x in w], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )

    for batch in batches:
        raw, bounds = texts_of(batch.column(2))
        for k, (lang, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            text = raw[bounds[k] : bounds[k + 1]].tobytes()
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for part in _chunks(text):
                words = part.split()
                n.update(words)
                own.update(words)
            docs.update(own)
        if sum(len(n) for n, _ in held.values()) >= HELD:
            yield from send()
            held.clear()
    yield from send()


def term_counts(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """(lang, source, term, n, total): occurrences of each kept term in a source and in its language; kept: in `least_docs` of the language's documents.

    docs: lang, source, text without nulls. Tasks sum their documents' counts first, so a hot term, source or language is a row to a task.
    """
    bounded_batches(docs.sparkSession)
    n = docs.select("lang", "source", "text").mapInArrow(trimmed(_count), "lang string, source string, term string, n long, docs long")
    n = n.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = Window.partitionBy("lang", "term")
    return n.withColumn("total", F.sum("n").over(every)).withColumn("in", F.sum("docs").over(every)).filter(F.col("in") >= least_docs).select("lang", "source", "term", "n", "total")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for all longs."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    most = (1 << 63) // SCALE - 2
    by = total + terms
    return 1 + F.when(count <= most, F.call_function("div", F.lit(SCALE) * F.least(count + 1, F.lit(most + 1)), by)).otherwise(F.call_function("div", wide, by.cast("decimal(19,0)")))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); p and q are at most SCALE + 1, so squares fit a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, id, n, terms, total, zero) of each (lang, source) that occurs: a number within the language, occurrences of kept terms, the language's kept terms and their occurrences, the share of a zero count."""
    here = docs.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    n = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = counts.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("total"))
    g = here.join(n, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "terms", "total")))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("id")
    zero = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("n"), F.col("terms"))).otherwise(0)
    return g.select("*", number, zero.cast("long").alias("zero"))


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, more): for postings in rows of a term (ids, shares, zeros), what pairs that both have it add to what each alone corrects."""
    held: dict[tuple[str, int, int], np.ndarray] = {}

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, x, y), m in held.items():
            a, b = np.nonzero(m)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a + x * SQUARE, pa.int64()), pa.array(b + y * SQUARE, pa.int64()), pa.array(m[a, b], pa.int64())], ["lang", "a", "b", "more"])
        held.clear()

    def add(lang: str, a: np.ndarray, b: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = a // SQUARE, b // SQUARE
        for sx, sy in np.unique(np.stack([x, y]), axis=1).T.tolist():
            own = (x == sx) & (y == sy)
            if (lang, sx, sy) not in held:
                if len(held) >= SQUARES:
                    yield from send()
                held[lang, sx, sy] = np.zeros((SQUARE, SQUARE), np.int64)
            np.add.at(held[lang, sx, sy], (a[own] % SQUARE, b[own] % SQUARE), more[own])

    def pairs(lang: str, size: np.ndarray, ids: np.ndarray, p: np.ndarray, z: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All ordered pairs within runs of the given sizes."""
        start = np.repeat(np.cumsum(size) - size, size)
        width = np.repeat(size, size)
        done = 0
        while done < len(ids):
            to = max(done + 1, int(np.searchsorted(np.cumsum(width[done:]), PAIRS)) + done)
            w = width[done:to]
            i = np.repeat(np.arange(done, to), w)
            j = np.repeat(start[done:to] - np.cumsum(w) + w, w) + np.arange(w.sum())
            i, j = i[i != j], j[i != j]
            more = _gap(p[i], p[j]) - _gap(p[i], z[j]) - _gap(z[i], p[j]) + _gap(z[i], z[j])
            some = more != 0
            yield from add(lang, ids[i[some]], ids[j[some]], more[some])
            done = to

    for batch in batches:
        lists = [c.flatten().to_numpy() for c in batch.columns[1:]]
        size = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64)
        lang = np.array(batch.column(0).to_pylist(), object)
        ends = np.append(0, np.cumsum(size))
        for name in dict.fromkeys(lang.tolist()):
            own = np.flatnonzero(lang == name)
            at = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in own]) if len(own) < len(lang) else np.arange(ends[-1])
            yield from pairs(name, size[own], *(x[at] for x in lists))
    yield from send()


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value long, rank int) for each language and source that occur in docs (lang, source, text; nulls: '').

    Part 'pair': every other source of the language, with the divergence from it, summed over all kept terms; all of them.
    Part 'term': the source's terms whose share exceeds the language's, with the term's gap; the `top` greatest. Ranks run from 1 by
    value descending, then item by its bytes. Sources without kept terms are compared as well; a language without kept terms
    has pairs of value 0. Sources of one language are numbered and their pairs are rows of the result, so the
    result itself grows with their square, as asked. Repeated rows are documents of their own; an empty table gives no rows.
    """
    d = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = stage(term_counts(d, least_docs), "counts")
    groups = stage(groups_of(d, counts), "groups")
    p = share(F.col("n"), F.col("of"), F.col("terms"))
    g = groups.select("lang", "source", "id", F.col("n").alias("of"), "terms", F.col("total").alias("all"), "zero")
    posted = counts.join(g, ["lang", "source"]).withColumn("p", p)
    term = posted.withColumn("q", share(F.col("total"), F.col("all"), F.col("terms"))).filter(F.col("p") > F.col("q"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    term = term.select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", rank).filter(F.col("rank") <= top)
    # Terms that one source alone has: by how many terms it has of each count.
    alone = stage(posted.groupBy("lang", "id", "n", "p", "zero").agg(F.count("*").alias("k")), "alone")
    a = groups.select("lang", F.col("id").alias("a"), F.col("source"), F.col("zero").alias("za"), "terms")
    b = groups.select("lang", F.col("id").alias("b"), F.col("source").alias("item"), F.col("zero").alias("zb"))
    other = b.select("lang", "b", "zb")
    mine = alone.select("lang", F.col("id").alias("a"), "p", F.col("zero").alias("za"), "k").join(other, "lang").filter("a <> b")
    mine = mine.groupBy("lang", "a", "b").agg(F.sum(F.col("k") * (gap(F.col("p"), F.col("zb")) - gap(F.col("za"), F.col("zb")))).alias("more"))
    theirs = alone.select("lang", F.col("id").alias("b"), "p", F.col("zero").alias("zb"), "k").join(a.select("lang", "a", "za"), "lang").filter("a <> b")
    theirs = theirs.groupBy("lang", "a", "b").agg(F.sum(F.col("k") * (gap(F.col("za"), F.col("p")) - gap(F.col("za"), F.col("zb")))).alias("more"))
    lists = posted.groupBy("lang", "term").agg(F.collect_list(F.struct("id", "p", "zero")).alias("x")).filter(F.size("x") > 1)  # at most the language's sources
    lists = lists.select("lang", *(F.col("x")[c].cast("array<long>").alias(c) for c in ("id", "p", "zero")))
    both = lists.mapInArrow(trimmed(_corrections), "lang string, a long, b long, more long")
    more = mine.unionByName(theirs).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    base = F.when(F.col("terms") > 0, F.col("terms") * gap(F.col("za"), F.col("zb"))).otherwise(0)
    pair = a.join(b, "lang").filter("a <> b").join(more, ["lang", "a", "b"], "left")
    pair = pair.select("lang", "source", "item", (base + F.coalesce("more", F.lit(0))).alias("value")).withColumn("rank", rank)
    named = lambda x, part: x.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return named(pair, "pair").unionByName(named(term, "term"))
