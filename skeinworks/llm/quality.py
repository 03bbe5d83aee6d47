"""Quality rules by distribution divergence, with DataFrame functions alone.

Each language has a reference: how its documents' characters fall into classes, and how often its most common words
stand in them. A document is compared with its language's reference by the Jensen-Shannon distance (square root of the
divergence in bits, 0 to 1) of both histograms. A histogram of n words strays from its source by something like
1 / sqrt(n) through chance alone, so a limit is `base + slack / sqrt(n)`; shorter documents than the guards say aren't
judged by that histogram. Everything about one document is computed in its row: texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.plans.stage import stage

GAP = r"[ \x09-\x0D]+"
#: Words of a repeated window, the least words and the most repeated words (in 100) that base rules allow.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Common words of a reference, the longest of them in characters (which bounds the vocabulary that is counted), and the
#: least words that a language's reference needs.
COMMON, LONGEST, LEAST_REFERENCE = 50, 8, 2000
#: Limits of the distances, (base, slack), and the guards: least characters in words, least words.
CHARS_LIMIT, WORDS_LIMIT, LEAST_CHARS, LEAST_JUDGED = (0.14, 0.9), (0.2, 2.2), 100, 50


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, as a lambda's variable."""
    return F.transform(F.array(value), f)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """How many words lie in windows of k words (a power of two) that the array holds twice or more.

    Windows get their 64-bit hashes by doubling and meet in sorted order; neighbours of equal hash are then compared word by word.
    """

    def doubled(h: Column, width: int) -> Column:
        if width == k:
            return let(F.slice(h, 1, F.size(h) - (k - 1)), found)
        return let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + width))), lambda d: doubled(d, 2 * width))

    def found(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), covered))

    def covered(s: Column) -> Column:
        def same(x: Column, other: Column) -> Column:
            out = x["h"] == other["h"]
            for j in range(k):
                out = out & (F.get(words, x["at"] + j) == F.get(words, other["at"] + j))
            return out

        at = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        start = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            F.sort_array(F.transform(at, lambda x: x["at"])), start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(k), p - a["last"])).alias("n")), lambda a: a["n"]
        )

    return F.when(F.size(words) > k, let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1))).otherwise(F.lit(0)).cast("long")


def left_by(text: Column, pattern: str) -> Column:
    """Characters that are left when all matches of the pattern are taken away."""
    return F.char_length(F.regexp_replace(text, pattern, "")).cast("long")


def measures(docs: DataFrame, repeats: bool = True) -> DataFrame:
    """docs (text, other columns) with __words, n_words, word_chars, n_symbols, n_dup_lines, __classes and, if asked for, n_repeat_words.

    __classes: characters that are small letters, capitals, digits, white space, symbols, and all others.
    """
    d = docs.withColumn("__t", F.coalesce("text", F.lit(""))).withColumn("__words", words_of(F.col("text")))
    t, w = F.col("__t"), F.col("__words")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    n = F.char_length(t).cast("long")
    d = d.withColumns({
        "n_words": F.size(w).cast("long"), "word_chars": F.char_length(F.array_join(w, "")).cast("long"), "n_symbols": left_by(t, r"[^#*$%&|<>]+"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "__n": n, "__small": n - left_by(t, r"\p{Ll}+"), "__capital": left_by(t, r"\P{Lu}+"), "__digit": left_by(t, r"\P{Nd}+"),
    } | ({"n_repeat_words": repeated_words(w)} if repeats else {}))
    known = [F.col("__small"), F.col("__capital"), F.col("__digit"), F.col("__n") - F.col("word_chars"), F.col("n_symbols")]
    rest = F.col("__n")
    for c in known:
        rest = rest - c
    return d.withColumn("__classes", F.array(*known, rest)).drop("__t", "__n", "__small", "__capital", "__digit")


def references(docs: DataFrame, common: int = COMMON, longest: int = LONGEST, least: int = LEAST_REFERENCE) -> DataFrame:
    """(lang, words, shares, classes, size, slots) of each language with `least` words or more, over all its fit documents.

    docs: text, lang (null: left out). Fit: `LEAST_JUDGED` words at least, no more than a symbol to ten words, and a fifth of
    the words distinct (of long documents: 200 distinct ones). words: the `common` most frequent words of up to `longest`
    characters, ties to the smaller one; shares: theirs of all words, then the share of all others; classes: shares of the
    six character classes; slots: for each slot (hash modulo size) the place of the common word that has it, or 0. Counts are summed in the tasks first, so a hot language is a row to a word and task.
    """
    m = measures(docs.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL"), repeats=False)
    fit = (F.col("n_words") >= LEAST_JUDGED) & (10 * F.col("n_symbols") <= F.col("n_words")) & (5 * F.size(F.array_distinct("__words")) >= F.least("n_words", F.lit(1000)))
    # One pass: a document gives a row to each word and, behind them, one to each class and one to its number of words.
    more = F.concat("__classes", F.array("n_words"))
    m = m.filter(fit).select("lang", "n_words", more.alias("more"), F.posexplode(F.concat("__words", F.array_repeat(F.lit(None).cast("string"), 7))).alias("at", "word"))
    m = m.filter(F.col("word").isNull() | (F.char_length("word") <= longest))
    at = F.when(F.col("word").isNull(), F.col("at") - F.col("n_words").cast("int")).otherwise(7)
    counts = m.groupBy("lang", at.alias("i"), "word").agg(F.sum(F.when(F.col("word").isNull(), F.get("more", F.col("at") - F.col("n_words").cast("int"))).otherwise(1)).alias("k"))
    order = Window.partitionBy("lang").orderBy(F.when(F.col("i") < 7, F.col("i")).otherwise(7), F.desc("k"), "word")
    top = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= common + 7)
    words = F.col("i") == 7
    sums = top.groupBy("lang").agg(
        *(F.max(F.when(F.col("i") == i, F.col("k"))).alias(f"c{i}") for i in range(6)), F.max(F.when(F.col("i") == 6, F.col("k"))).alias("n"),
        F.sort_array(F.collect_list(F.when(words, F.struct("r", "word", "k")))).alias("x"), F.coalesce(F.sum(F.when(words, F.col("k"))), F.lit(0)).alias("in"),
    )
    total = sum((F.col(f"c{i}") for i in range(1, 6)), F.col("c0"))
    out = sums.filter(F.col("n") >= least).select(
        "lang",
        F.transform("x", lambda x: x["word"]).alias("words"),
        F.concat(F.transform("x", lambda x: x["k"] / F.col("n")), F.array((F.col("n") - F.col("in")) / F.col("n"))).alias("shares"),
        F.array(*(F.col(f"c{i}") / total for i in range(6))).alias("classes"),
    )
    slots = lambda m: F.transform("words", lambda w: slot(w, m))
    free = F.filter(F.sequence(F.lit(256), F.lit(4096), F.lit(32)), lambda m: F.size(F.array_distinct(slots(m))) == F.size("words"))
    out = out.withColumn("size", F.get(free, 0))
    return out.withColumn("slots", F.when(F.col("size").isNotNull(), let(slots(F.col("size")), lambda s: F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.array_position(s, i).cast("int")))))


def slot(word: Column, size: Column) -> Column:
    return F.pmod(F.hash(word), size)


def _part(p: Column, q: Column) -> Column:
    """One bin's share of twice the divergence."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)


def _root(total: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def class_distance(counts: Column, shares: Column) -> Column:
    n = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    parts = let(n, lambda n: F.zip_with(counts, shares, lambda c, q: _part(c / n, q)))
    return F.when(n > 0, _root(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def word_distance(words: Column, ref: Column) -> Column:
    """Distance of the words' histogram over the common ones and all others.

    A word's place among the common ones comes from the reference's table of slots, where no two of them share one, and bins
    come from sorted places: work follows the words, not words times bins.
    """
    n, shares, common = F.size(words), ref["shares"], ref["words"]

    def place(w: Column) -> Column:
        at = F.get(ref["slots"], slot(w, ref["size"]))
        return F.when(ref["size"].isNull(), F.array_position(common, w).cast("int")).when(F.get(common, at - 1) == w, at).otherwise(F.lit(0))

    def summed(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda x, i: F.struct(x.alias("place"), i.alias("end"))), lambda x: ~F.coalesce(x["place"] == F.get(s, x["end"] + 1), F.lit(False)))
        counts = let(ends, lambda e: F.transform(e, lambda x, i: F.struct(F.get(shares, x["place"] - 1).alias("q"), (x["end"] - F.coalesce(F.get(e, i - 1)["end"], F.lit(-1))).alias("k"))))
        other = F.array(F.struct(F.get(shares, F.size(shares) - 1).alias("q"), (n - F.size(s)).alias("k")))
        start = F.struct(F.lit(0.0).alias("part"), F.lit(0.0).alias("q"))
        # A bin without words gives its own share.
        return F.aggregate(
            F.concat(counts, other), start, lambda a, x: F.struct((a["part"] + _part(x["k"] / n, x["q"])).alias("part"), (a["q"] + x["q"]).alias("q")), lambda a: _root(a["part"] + F.greatest(F.lit(0.0), 1 - a["q"]))
        )

    return F.when(n > 0, let(F.sort_array(F.filter(F.transform(words, place), lambda x: x > 0)), summed))


def judge(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, chars_js, words_js (double) and kept (in place of columns of these names).

    docs: text string (null: no words), lang string, any other columns, which stay. A document fails the base rules with fewer than
    20 words, or if more than 30 % of its words lie in windows of 8 words that its text repeats. It is kept if it passes them and
    neither histogram is farther from its language's reference than the limits, as far as it is long enough to be judged. A
    document whose language is null is held against the nearest of all references; one of a language without a reference has
    null distances and isn't judged. Rows are independent: repeated rows get equal results, an empty table gives none.
    refs: of `references`; written by the caller, as both joins read it. It has a row to a language, so it is broadcast.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_js", "words_js", "kept"]
    d = docs.drop(*own)
    m = measures(d.select("text", "lang", F.struct(*(F.col(f"`{c}`") for c in d.columns)).alias("__row")))
    ref = F.struct("words", "shares", "classes", "size", "slots")
    one = refs.select(F.col("lang").alias("__lang"), ref.alias("__ref"))
    every = refs.agg(F.collect_list(ref).alias("__all"))  # one row
    m = m.join(F.broadcast(one), F.col("lang") == F.col("__lang"), "left").join(F.broadcast(every), F.col("lang").isNull(), "left")
    held = F.when(F.col("lang").isNull(), F.col("__all")).otherwise(F.when(F.col("__ref").isNotNull(), F.array("__ref")))
    m = m.withColumn("__held", F.when(~base_failed(), held))
    m = m.withColumn("__d", F.transform("__held", lambda r: F.struct(class_distance(F.col("__classes"), r["classes"]).alias("c"), word_distance(F.col("__words"), r).alias("w"))))
    nearest = F.array_min(F.transform("__d", lambda x: F.struct((x["c"] + x["w"]).alias("sum"), x["c"].alias("c"), x["w"].alias("w"))))
    m = m.withColumn("__near", nearest)
    far = [(F.col("__near.c"), CHARS_LIMIT, F.col("word_chars") >= LEAST_CHARS), (F.col("__near.w"), WORDS_LIMIT, F.col("n_words") >= LEAST_JUDGED)]
    diverges = F.lit(False)
    for distance, (base, slack), long_enough in far:
        diverges = diverges | F.coalesce(long_enough & (distance > base + slack / F.sqrt(F.col("n_words").cast("double"))), F.lit(False))
    return m.select("__row.*", *own[:5], base_failed().alias("base_failed"), F.col("__near.c").alias("chars_js"), F.col("__near.w").alias("words_js"), (~base_failed() & ~diverges).alias("kept"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def quality(docs: DataFrame) -> DataFrame:
    """docs judged by references of their own languages, which are written first."""
    return judge(docs, stage(references(docs), "references"))
