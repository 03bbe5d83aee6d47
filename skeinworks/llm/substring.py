"""Removal of word windows that repeat anywhere in the corpus.

Method. A window of `window` words gets an anchor: the least hash among the k-grams inside it, leftmost
among equals. Anchors depend on a window's words alone, so when a window starts at two places, its anchor
lies at two places too: the number of places of an anchor is never below the count of a window that has it.
A count-min sketch over anchor places overestimates window counts, with far fewer updates than there are
windows: each partition sends its sparse sketch in shards, with the place of every anchor it met once; the
shard's task merges the sketches and sends back the places whose estimate is two or more. An anchor that one
partition met twice needs no answer. So a common passage costs a shard one cell a partition, not one a copy,
and the sketch grows with the input, in shards, never in one place.
The second pass takes the windows of the places that came back, and groups them exactly, by 96 bits of hash.
As windows that occur once are the only ones that can be wrong among the candidates, only those travel back to
their documents: each belongs to one document, so no key is hot, and windows that a task meets often leave it once.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.llm import sketch
from skeinworks.llm.words import U, mix, slices, sliding_min, trimmed, windows, words_of
from skeinworks.plans.stage import bounded_batches, stage

GRAM = 8
#: Candidate windows and anchors that a task sums up before it sends them on, windows that a grouping task gets on average at
#: most, and anchors that a shard of the sketch gets.
FLUSH, GROUP, ANCHORS = 1 << 19, 1 << 20, 1 << 18
_POS = U((1 << 20) - 1)
_OTHER = U(0x94D049BB133111EB)


def anchors(h: np.ndarray, window: int) -> np.ndarray:
    """Per window start: its anchor, hash in the upper 44 bits and place (modulo 2**20) in the lower 20."""
    gram = min(GRAM, window)
    g = windows(h, gram)
    if len(h) < window:
        return g[:0]
    span = window - gram + 1
    if len(g) <= 1 << 20:
        return sliding_min((g & ~_POS) | np.arange(len(g), dtype=np.uint64), span)
    out, step = [], (1 << 20) - span  # overlapping pieces: places are unique in each
    for a in range(0, len(g) - span + 1, step):
        part = g[a : a + step + span - 1]
        out.append(sliding_min((part & ~_POS) | np.arange(len(part), dtype=np.uint64), span))
    return np.concatenate(out)


def starts_in(first: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that lie inside one text, among the words of adjacent texts."""
    end = np.repeat(first[1:], np.diff(first))
    return np.flatnonzero(np.arange(len(end)) + window <= end)


def keys(anchor: np.ndarray) -> np.ndarray:
    return mix(anchor >> U(20))


def runs(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window start, windows) of each anchor place: a place's windows lie together."""
    start = starts_in(first, window)
    a = anchors(h, window)[start]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1))) if len(a) else np.empty(0, np.int64)
    return keys(a[new]), start[new], np.diff(np.append(new, len(a)))


def spans(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n[i] numbers from at[i] on, for each i."""
    n = n.astype(np.int64)
    return np.repeat(at.astype(np.int64) - np.cumsum(n) + n, n) + np.arange(n.sum())


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Mask of n words inside any window that starts at one of the places (distinct)."""
    d = np.zeros(n + 1, np.int32)
    d[starts] += 1
    d[starts + window] -= 1
    return np.cumsum(d[:n]) > 0


def _cuts(x: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist()
    return list(zip(at, [*at[1:], len(x)], strict=True)) if len(x) else []


def _by_bucket(row: np.ndarray, at: np.ndarray, n: np.ndarray, buckets: int) -> list[tuple]:
    """Places by bucket of their rows, a tuple to a bucket: as many as there are buckets, however many places."""
    bucket = (mix(row.view(np.uint64)) >> U(20)) % U(buckets)
    order = np.argsort(bucket, kind="stable")
    row, at, n, bucket = row[order], at[order], n[order], bucket[order]
    return [(int(bucket[a]), row[a:b].tobytes(), at[a:b].tobytes(), n[a:b].tobytes()) for a, b in _cuts(bucket)]


PLACES = "bucket int, row binary, at binary, n binary"
_COLUMNS = ["bucket", "row", "at", "n"]


def _by_row(batches):
    """One row to a document: its places in order, each once."""
    got: dict[int, list] = {}
    for pdf in batches:
        for bucket, row, at, n in pdf.itertuples(index=False):
            got.setdefault(bucket, []).append((np.frombuffer(row, np.int64), np.frombuffer(at, np.uint32), np.frombuffer(n, np.uint16)))
    for parts in got.values():
        row, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, row))
        row, at, n = row[order], at[order], n[order]
        new = np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1]))
        row, at, n = row[new], at[new], n[new]
        cut = _cuts(row)
        yield pd.DataFrame({"__row": row[[a for a, _ in cut]], "__at": [at[a:b].tobytes() for a, b in cut], "__n": [n[a:b].tobytes() for a, b in cut]})


def estimated(keyed: DataFrame, window: int, shards: int, buckets: int) -> DataFrame:
    """(__row, __at, __n) of documents with anchor places whose estimate is two or more: the first window starts and how many windows follow."""
    most = (1 << 16) - 1

    def sketches(batches):
        held, n = [], 0
        for batch in batches:
            row = batch.column(0).to_numpy()
            for a, b, h, first in slices(batch.column(1)):
                key, at, length = runs(h, first, window)
                if len(key):
                    doc = np.repeat(np.arange(a, b), np.diff(first))[at]
                    at = at - first[doc - a]
                    if length.max() > most:  # only windows of over 65,535 words
                        parts = -(-length // most)
                        k = spans(np.zeros(len(parts), np.int64), parts)
                        key, doc, at, length = (np.repeat(x, parts) for x in (key, doc, at, length))
                        at, length = at + k * most, np.minimum(most, length - k * most)
                    held.append((key, row[doc], at.astype(np.uint32), length.astype(np.uint16)))
                    n += len(key)
                if n >= FLUSH:
                    yield send(held)
                    held, n = [], 0
        if held:
            yield send(held)

    def send(held) -> pa.RecordBatch:
        key, row, at, n = (np.concatenate(x) for x in zip(*held, strict=True))
        shard = sketch.shard_of(key, shards)
        order = np.lexsort((key, shard))
        key, row, at, n, shard = key[order], row[order], at[order], n[order], shard[order]
        same = np.append(key[1:] == key[:-1], False)
        lead = ~np.append(False, same[:-1])  # the first of equal keys
        once, more = lead & ~same, lead & same
        cell = sketch.cell_of(key)
        rows = [(int(shard[a]), cell[a:b][once[a:b]].tobytes(), cell[a:b][more[a:b]].tobytes(), row[a:b][once[a:b]].tobytes(), at[a:b][once[a:b]].tobytes(), n[a:b][once[a:b]].tobytes()) for a, b in _cuts(shard)]
        known = ~once
        rows += [(bucket % shards, None, None, r, s, m) for bucket, r, s, m in _by_bucket(row[known], at[known], n[known], buckets)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 5], strict=True)], ["shard", "once", "more", "row", "at", "n"])

    def merge(batches):
        got: dict[int, list] = {}
        for pdf in batches:
            for shard, once, more, row, at, n in pdf.itertuples(index=False):
                place = (np.frombuffer(row, np.int64), np.frombuffer(at, np.uint32), np.frombuffer(n, np.uint16))
                if once is None:
                    yield pd.DataFrame(_by_bucket(*place, buckets), columns=_COLUMNS)
                else:
                    got.setdefault(shard, []).append((np.frombuffer(once, np.uint32), np.frombuffer(more, np.uint32), *place))
        for parts in got.values():
            once, more, row, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            met = sketch.repeated(once, more)
            yield pd.DataFrame(_by_bucket(row[met], at[met], n[met], buckets), columns=_COLUMNS)

    sent = keyed.select("__row", "text").mapInArrow(trimmed(sketches), "shard int, once binary, more binary, row binary, at binary, n binary")
    back = sent.repartition(shards, "shard").mapInPandas(trimmed(merge), PLACES)
    return back.repartition(buckets, "bucket").mapInPandas(trimmed(_by_row), "__row long, __at binary, __n binary")


def _block(held: list[tuple[np.ndarray, ...]], shards: int) -> pa.RecordBatch:
    """Candidates of many documents by shard of the hash, equal windows once: those met once with their place, others without."""
    w, v, row, at = (np.concatenate(x) for x in zip(*held, strict=True))
    shard = (w >> U(40)) % U(shards)
    order = np.lexsort((v, w, shard))
    w, v, row, at, shard = w[order], v[order], row[order], at[order], shard[order]
    new = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (v[1:] != v[:-1])))
    single = np.diff(np.append(new, len(w))) == 1
    w, v, row, at, shard = w[new], v[new], row[new], at[new], shard[new]
    rows = []
    for a, b in _cuts(shard):
        s = single[a:b]
        rows.append((int(shard[a]), w[a:b][~s].tobytes() + v[a:b][~s].tobytes(), w[a:b][s].tobytes() + v[a:b][s].tobytes(), row[a:b][s].tobytes(), at[a:b][s].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], ["shard", "many", "once", "row", "at"])


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint32, n, 8 * n)


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id") -> DataFrame:
    """Per document: its words and which of them a repeated window covers.

    docs: `id_col` (any atomic type), text string; other columns stay. A word is a maximal run of bytes other
    than space and \\t-\\r. Every word that some window of `window` consecutive words covers is removed if that
    window's word sequence starts anywhere else, in the same document too; windows are judged on the input.
    Null and empty texts have no words, texts under `window` words lose none. Repeated rows, equal ids too,
    are documents of their own and lose each other's windows. An empty table gives an empty result.
    Added columns (taking the place of input columns of these names): n_words, n_removed, and kept, the words
    kept joined by one space.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # About six characters a word, one anchor for some eleven words.
    shards, buckets = max(least, size // 12 // GROUP), max(least, size // 66 // ANCHORS)
    docs = docs.drop("n_words", "n_removed", "kept")
    keyed = docs.withColumn("__row", F.xxhash64(F.col(id_col), F.col("text")))
    found = stage(estimated(keyed, window, buckets, buckets), "estimated-places")

    def candidates(batches):
        held, n = [], 0
        for batch in batches:
            row = batch.column(0).to_numpy()
            places = [(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint16)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            for a, b, h, first in slices(batch.column(1)):
                own = [spans(*places[k]) for k in range(a, b)]
                doc = np.repeat(np.arange(a, b), [len(x) for x in own])
                at = np.concatenate(own)
                place = at + first[doc - a]
                held.append((windows(h, window)[place], windows(h ^ _OTHER, window)[place].astype(np.uint32), row[doc], at.astype(np.uint32)))
                n += len(at)
                if n >= FLUSH:
                    yield _block(held, shards)
                    held, n = [], 0
        if held:
            yield _block(held, shards)

    def group(batches):
        got: dict[int, list] = {}
        for pdf in batches:
            for s, *x in pdf.itertuples(index=False):
                got.setdefault(s, []).append(x)
        for parts in got.values():
            (w, v), (more, other) = (tuple(np.concatenate(y) for y in zip(*(_hashes(x[k]) for x in parts), strict=True)) for k in (1, 0))
            n = len(w)
            w, v = np.concatenate([w, more]), np.concatenate([v, other])
            order = np.lexsort((v, w))
            same = np.append((w[order][1:] == w[order][:-1]) & (v[order][1:] == v[order][:-1]), False)
            lone = order[~(same | np.append(False, same[:-1]))]
            lone = lone[lone < n]
            row, at = (np.concatenate([np.frombuffer(x[k], t) for x in parts])[lone] for k, t in ((2, np.int64), (3, np.uint32)))
            yield pd.DataFrame(_by_bucket(row, at, np.ones(len(at), np.uint16), shards), columns=_COLUMNS)

    blocks = keyed.join(found, "__row").select("__row", "text", "__at", "__n").mapInArrow(trimmed(candidates), "shard int, many binary, once binary, row binary, at binary")
    lone = blocks.repartition(shards, "shard").mapInPandas(trimmed(group), PLACES)
    lone = stage(lone.repartition(shards, "bucket").mapInPandas(trimmed(_by_row), "__row long, __at binary, __n binary"), "lone-windows")
    judged = found.join(lone.select("__row", F.col("__at").alias("__lone")), "__row", "left")
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_words long, n_removed long, kept string"])

    def remove(batches):
        for batch in batches:
            at, length, lone = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__at", "__n", "__lone"))
            n_words, n_removed, kept = [], [], []
            for k, t in enumerate(batch.column(names.index("text")).to_pylist()):
                w = words_of(t)
                gone = None
                if at[k]:
                    own = spans(np.frombuffer(at[k], np.uint32), np.frombuffer(length[k], np.uint16))
                    if lone[k]:
                        own = np.setdiff1d(own, np.frombuffer(lone[k], np.uint32), assume_unique=True)
                    gone = covered(own, len(w), window) if len(own) else None
                n_words.append(len(w))
                n_removed.append(0 if gone is None else int(gone.sum()))
                kept.append(b" ".join(w if gone is None else compress(w, (~gone).tolist())).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept"])

    return keyed.join(judged, "__row", "left").select(*names, "__at", "__n", "__lone").mapInArrow(trimmed(remove), schema)
