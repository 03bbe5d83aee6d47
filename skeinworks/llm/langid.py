"""Language identification by rank-order n-gram profiles.

A profile is the ranking of a language's most frequent character n-grams (1 to 3 letters, words padded with
a blank). A text's own ranking is compared with each profile: every n-gram of the text adds how far its rank
there is from its rank in the profile, or the largest distance if the profile lacks it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.llm.words import U, mix, trimmed
from skeinworks.plans.stage import bounded_batches

UNDETERMINED = "und"
#: Characters that training counts at once; the most n-gram codes that are counted in a table rather than by sorting.
SLICE, TABLE = 1 << 20, 1 << 21


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)


def is_letter() -> np.ndarray:
    """Of every code point, whether it is a letter; one table to a worker."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


_LETTER: np.ndarray | None = None


def letter_ids(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Ids of the letters by table, in order, with one 0 for each run of other characters and at both ends."""
    s = np.zeros(len(points) + 2, np.int64)
    s[1:-1] = table[points]
    return s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]


def gram_codes(s: np.ndarray, size: int, longest: int = 3) -> np.ndarray:
    """Codes of all n-grams of up to `longest` ids within words, the 0 on either side included; ids are below size."""
    out, code, base, inner = [s[s > 0]], s, 0, np.ones(len(s), bool)
    for k in range(2, longest + 1):
        base += size ** (k - 1)
        code = code[:-1] * size + s[k - 1 :]
        if k > 2:
            inner = inner[:-1] & (s[k - 2 : -1] > 0)
            out.append(code[inner] + base)
        else:
            inner = np.ones(len(code), bool)
            out.append(code + base)
    return np.concatenate(out)


def counted(codes: np.ndarray, size: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, counts)"""
    space = sum(size**k for k in range(1, longest + 1))
    if space <= TABLE:
        n = np.bincount(codes, minlength=1)
        some = np.flatnonzero(n)
        return some, n[some]
    return np.unique(codes, return_counts=True)


def spell(code: int, letters: str, longest: int) -> str:
    """The n-gram of a code; letters[i] is the letter of id i, letters[0] a blank."""
    size, base = len(letters), 0
    for k in range(1, longest + 1):
        if code - base < size**k or k == longest:
            code -= base
            out = ""
            for _ in range(k):
                code, r = divmod(code, size)
                out = letters[r] + out
            return out
        base += size**k
    raise AssertionError


def code_of(gram: str, ids: dict[str, int], size: int) -> int:
    code = 0
    for c in gram:
        code = code * size + ids[c]
    return code + sum(size**k for k in range(1, len(gram)))


def count_grams(text: str, longest: int = 3) -> dict[str, int]:
    """Counts of a text's n-grams."""
    points = code_points(text)
    n = np.bincount(points, minlength=1) if len(points) else np.zeros(1, int)
    own = np.flatnonzero(n)
    own = own[is_letter()[own]]
    table = np.zeros(len(n), np.int64)
    table[own] = np.arange(1, len(own) + 1)
    letters = " " + "".join(map(chr, own.tolist()))
    s = letter_ids(points, table)
    if len(s) < 2:
        return {}
    codes, n = counted(gram_codes(s, len(letters), longest), len(letters), longest)
    return {spell(c, letters, longest): k for c, k in zip(codes.tolist(), n.tolist(), strict=True)}


def train(docs: DataFrame, size: int = 400, longest: int = 3) -> dict[str, list[str]]:
    """lang -> its `size` most frequent n-grams, over all given rows (text, lang; rows with a null are left out).

    Tasks sum n-gram counts of their rows by language, so a hot language costs each task one row to an n-gram.
    """
    bounded_batches(docs.sparkSession)

    def count(batches):
        total: dict[str, Counter] = {}
        held: dict[str, list[str]] = {}

        def add(lang):
            total.setdefault(lang, Counter()).update(count_grams("\n".join(held.pop(lang)), longest))

        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                held.setdefault(lang, []).append(text)
                if len(text) + sum(map(len, held[lang][:-1])) >= SLICE:
                    add(lang)
            for lang in list(held):
                if sum(map(len, held[lang])) >= SLICE // 4:
                    add(lang)
            if sum(map(len, total.values())) > 400_000:
                yield spread(total)
                total = {}
        for lang in list(held):
            add(lang)
        yield spread(total)

    def spread(total):
        return pd.DataFrame([(lang, g, k) for lang, n in total.items() for g, k in n.items()], columns=["lang", "gram", "n"])

    n = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInPandas(trimmed(count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    out: dict[str, list[str]] = {}
    for r in n.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= size).orderBy("lang", "r").toLocalIterator():  # size rows a language
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Model:
    """Profiles over one alphabet: their letters, and one id for all other letters."""

    def __init__(self, profiles: dict[str, list[str]], longest: int):
        self.names, self.longest = sorted(profiles), longest
        letters = sorted({c for p in profiles.values() for g in p for c in g} - {" "})
        self.size = len(letters) + 2
        ids = {" ": 0} | {c: i for i, c in enumerate(letters, 1)}
        self.letters = ids
        code = {g: code_of(g, ids, self.size) for p in profiles.values() for g in p}
        self.codes = np.unique(np.array(sorted(code.values()), np.int64))
        self.rank = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for k, name in enumerate(self.names):
            at = np.searchsorted(self.codes, [code[g] for g in profiles[name]])
            self.rank[k, at] = np.arange(len(at))

    def table(self) -> np.ndarray:
        t = np.where(is_letter(), self.size - 1, 0)
        for c, i in self.letters.items():
            t[ord(c)] = i
        return t

    def predict(self, text: str, table: np.ndarray, size: int) -> tuple[str, float]:
        s = letter_ids(code_points(text), table)
        if not self.names or not s.any():
            return UNDETERMINED, 0.0
        codes, n = counted(gram_codes(s, self.size, self.longest), self.size, self.longest)
        key = (n.astype(np.int64) << 32) | (mix(codes.astype(np.uint64)) >> U(33)).astype(np.int64)  # ties by a fixed hash of the n-gram
        if len(key) > size:
            top = np.argpartition(-key, size - 1)[:size]
            codes, key = codes[top], key[top]
        top = codes[np.argsort(-key)]
        at = np.searchsorted(self.codes, top)
        at[at < len(self.codes)] = np.where(self.codes[at[at < len(self.codes)]] == top[at < len(self.codes)], at[at < len(self.codes)], len(self.codes))
        r = self.rank[:, at]
        far = np.where(r < 0, size, np.abs(r - np.arange(len(top)))).sum(axis=1)
        k = int(far.argmin())
        return self.names[k], float(max(0.0, 1 - far[k] / (size * len(top))))


def identify(docs: DataFrame, profiles: dict[str, list[str]], size: int = 400, longest: int = 3) -> DataFrame:
    """docs with lang_pred and score added (in place of columns of these names).

    docs: text string and any other columns, which stay. lang_pred is the profile at the least out-of-place
    distance from the whole text, ties to the smaller name; 'und' with score 0 if the text is null, empty or has no
    letter, or if there are no profiles. score: 1 - distance / largest possible distance. Letters that no profile has
    count as one letter, which no profile ranks. Rows are independent, so repeated rows get equal results.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(Model(profiles, longest))
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        m = model.value
        table = m.table()
        for pdf in batches:
            got = [m.predict(t, table, size) if t else (UNDETERMINED, 0.0) for t in pdf["text"]]
            yield pdf.assign(lang_pred=[g[0] for g in got], score=[g[1] for g in got])

    return docs.mapInPandas(trimmed(predict), schema)


def held_out(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 5 == 0
