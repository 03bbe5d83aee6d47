"""Packing documents into sequences: patterns of few lengths, fitted to the length histogram by NNLS.

Everything that is solved on the driver is the histogram of piece lengths (seq_len numbers), whatever the
corpus' size. The plan that comes out says, for the r-th piece of each length, its sequence and place.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.llm.tokens import crc32_ids, encoder
from skeinworks.llm.words import trimmed
from skeinworks.plans.stage import bounded_batches, stage


def patterns(seq_len: int, depth: int = 3, used: np.ndarray | None = None) -> np.ndarray:
    """All multisets of at most `depth` (1 to 3) positive lengths with sum seq_len, as rows padded with 0."""
    rows = [np.array([[seq_len, 0, 0]])]
    if depth >= 2:
        a = np.arange(1, seq_len // 2 + 1)
        rows.append(np.stack([a, seq_len - a, 0 * a], 1))
    if depth >= 3:
        for a in range(1, seq_len // 3 + 1):
            b = np.arange(a, (seq_len - a) // 2 + 1)
            rows.append(np.stack([np.full_like(b, a), b, seq_len - a - b], 1))
    p = np.concatenate(rows)
    return p[((p == 0) | used[p]).all(axis=1)] if used is not None else p


def nnls(p: np.ndarray, hist: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that minimise |A x - hist|, by accelerated projected gradient.

    A's column has a one for each length of its pattern, so A x is a bincount and A' r a look-up.
    """
    if len(p) == 0:
        return np.zeros(0)
    n, size = len(p), len(hist)

    def times(x):
        return np.bincount(p.ravel(), np.repeat(x, p.shape[1]), size) * live

    def back(r):
        return r[p].sum(axis=1)

    live = np.ones(size)
    live[0] = 0
    v = np.ones(n)
    for _ in range(25):
        v = back(times(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(n)
    t, h = 1.0, hist * live
    for _ in range(rounds):
        new = np.maximum(0, y - back(times(y) - h) / (1.02 * top))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def plan_packing(hist: np.ndarray, seq_len: int, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for all pieces of the histogram: fit, round, pack the rest best-fit."""
    left = hist.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[seq_len]:
        plan.append(((seq_len,), int(left[seq_len])))
        left[seq_len] = 0
    p = patterns(seq_len, depth, left > 0)
    x = nnls(p, left.astype(float))
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        kinds, each = np.unique(p[k][p[k] > 0], return_counts=True)
        n = int(min(np.floor(x[k] + 0.5), (left[kinds] // each).min()))
        if n > 0:
            left[kinds] -= n * each
            plan.append((tuple(int(v) for v in p[k] if v), n))
    return plan + best_fit(left, seq_len)


def best_fit(left: np.ndarray, seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: equal pieces go into equal bins together."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room: list[int] = []

    def put(free: int, lengths: tuple[int, ...], n: int) -> None:
        if n:
            if free not in bins:
                bins[free] = []
                insort(room, free)
            bins[free].append((lengths, n))

    for size in range(seq_len, 0, -1):
        n = int(left[size])
        while n:
            at = bisect_left(room, size)
            if at == len(room):
                fit = seq_len // size
                put(seq_len - fit * size, (size,) * fit, n // fit)
                put(seq_len - n % fit * size, (size,) * (n % fit), int(n % fit > 0))
                break
            free = room[at]
            lengths, m = bins[free].pop()
            if not bins[free]:
                del bins[free]
                room.pop(at)
            k = min(m, n)
            put(free, lengths, m - k)
            put(free - size, (*lengths, size), k)
            n -= k
    return [x for free in sorted(bins) for x in bins[free]]


class Slots:
    """For the r-th piece of a length: (sequence, offset). Arrays of the plan's size, which lengths alone bound."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        taken: dict[int, int] = {}
        rows, base = [], 0
        for lengths, n in plan:
            at = 0
            for size in lengths:
                r = taken.get(size, 0)
                rows.append((size, r, base, at))
                taken[size] = r + n
                at += size
            base += n
        rows.sort()
        a = np.array(rows, np.int64).reshape(-1, 4)
        self.key, self.first, self.base, self.at, self.sequences = (a[:, 0] << 40) + a[:, 1], a[:, 1], a[:, 2], a[:, 3], base

    def of(self, length: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (length << 40) + r, side="right") - 1
        return self.base[k] + r - self.first[k], self.at[k]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, seq_len: int, end_id: int) -> DataFrame:
    """The pieces of all documents: ids of the text, then end_id; over seq_len, cut so that only the first piece is shorter."""

    def cut(batches):
        enc = encoder(tokenizer)
        for pdf in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, ids in zip(pdf["doc_id"].astype("Int64"), enc.batch(pdf["text"].tolist()), strict=True):
                ids = np.append(ids, np.uint16(end_id))
                first = len(ids) % seq_len or seq_len
                edges = [0, *range(first, len(ids) + 1, seq_len)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    doc.append(d)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(crc32_ids(ids[a:b]))
            yield pd.DataFrame({"doc_id": pd.array(doc, "Int64"), "piece": np.array(piece, np.int32), "start": np.array(start, np.int64), "length": np.array(length, np.int64), "ids_crc32": np.array(crc, np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(trimmed(cut), PIECE)


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 1024, end_id: int = 2, depth: int = 3) -> DataFrame:
    """Pack whole documents into sequences of at most seq_len tokens.

    docs: doc_id long, text string (null: empty, so only the end id); other columns are ignored. Documents of
    over seq_len tokens alone are cut. Repeated doc_ids are packed apart; a null doc_id is kept. An empty table
    gives an empty result. Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset;
    the pieces of a sequence lie gapless from offset 0. depth: the most lengths of a fitted pattern.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = stage(cut_pieces(docs, tokenizer, seq_len, end_id), "pieces")
    hist = np.zeros(seq_len + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most seq_len rows
        hist[r["length"]] = r["n"]
    slots = Slots(plan_packing(hist, seq_len, depth))
    shared = spark.sparkContext.broadcast(slots)
    buckets = max(1024, int(hist.sum()) // 20_000)
    # Rank among the pieces of a length: ranks in small buckets, after the counts of the buckets before.
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("bucket", "length").agg(F.count("*").alias("n")).select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(offsets, ["bucket", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("r")).alias("r"))

    def place(batches):
        for pdf in batches:
            seq, at = shared.value.of(pdf["length"].to_numpy(np.int64), pdf["r"].to_numpy(np.int64))
            yield pdf.drop(columns="r").assign(sequence_id=seq, offset=at)

    return ranked.mapInPandas(trimmed(place), PIECE + ", sequence_id long, offset long")
