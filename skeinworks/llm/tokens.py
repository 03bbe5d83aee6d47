"""Token ids of whole texts, and a binary file format for them.

Format: ids are numbered by falling frequency (rank 0 is the most frequent; ties by smaller id), and
ranks are stored in one to four little-endian bytes. The byte counts stand apart, in control bytes of
four 2-bit codes each, so data has no escape bits and is decoded with table lookups on whole arrays.
Files hold blocks of whole documents in ascending doc_id; a table `ids` beside them maps rank to id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.words import ONLY_SPACE, U, hash_words, mix, texts_of, trimmed
from skeinworks.plans.stage import bounded_batches, drop, stage

class Encoder:
    """Ids of whole texts, exactly as the tokenizers library gives them, with a cache of space-separated pieces.

    The byte-level pre-tokenizer never puts a space behind a non-space into one token, so a text whose spaces all
    stand between two characters other than white space may be cut before each, and " " + piece encoded by
    itself. Pieces are known by 64-bit hash and length, in a hash table of numpy arrays (some 20 bytes a piece);
    those that it lacks go to the library together: their ids part where a token begins with a space.
    Other texts, and those with a special token's string, are encoded whole. The table starts anew at `limit`.
    """

    ODD = 0xFFFF

    def __init__(self, path: str, limit: int = 2_400_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids of over 16 bits are not supported")
        self.opens = np.zeros(1 << 16, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.limit = limit
        self._empty(16)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def _empty(self, bits: int) -> None:
        self.bits, self.n, self.used = bits, 0, 0
        self.key = np.zeros(1 << bits, np.uint64)
        self.at = np.zeros(1 << bits, np.uint32)
        self.count = np.zeros(1 << bits, np.uint16)
        self.ids = np.empty(1 << 18, np.uint16)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(64 - self.bits)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slots, -1 for what is missing."""
        slot, mask = self._slots(h), (1 << self.bits) - 1
        got = self.key[slot]
        slot[got == 0] = -1
        todo = np.flatnonzero((got != h) & (got != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            got = self.key[slot[todo]]
            slot[todo[got == 0]] = -1
            todo = todo[(got != h[todo]) & (got != 0)]
        return slot

    def _put(self, h: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        slot, mask, todo = self._slots(h), (1 << self.bits) - 1, np.arange(len(h))
        while len(todo):
            free = self.key[slot[todo]] == 0
            self.key[slot[todo[free]]] = h[todo[free]]
            won = self.key[slot[todo]] == h[todo]
            done = todo[won]
            self.at[slot[done]], self.count[slot[done]] = at[done], count[done]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & mask
        self.n += len(h)

    def _learn(self, h: np.ndarray, pieces: list[str]) -> None:
        """Encode " " + piece for distinct pieces. Those with white space at an end or a special string are marked odd."""
        odd = np.array([p[0].isspace() or p[-1].isspace() or any(s in p for s in self.special) for p in pieces], bool)
        plain = [p for p, o in zip(pieces, odd.tolist(), strict=True) if not o]
        count = np.full(len(pieces), self.ODD, np.uint16)
        parts, sizes = [], []
        for a in range(0, len(plain), 4096):
            part = plain[a : a + 4096]
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.uint16)
            cut = np.flatnonzero(self.opens[ids])
            if len(cut) != len(part) or cut[0] != 0:
                one = [self.whole(" " + p) for p in part]
                ids, cut = np.concatenate(one), np.cumsum([0, *(len(x) for x in one)])[:-1]
            parts.append(ids)
            sizes.append(np.diff(np.append(cut, len(ids))))
        new = np.concatenate(parts) if parts else np.empty(0, np.uint16)
        size = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        if self.n + len(h) > self.limit:
            self._empty(self.bits)
        while (self.n + len(h)) * 5 > (3 << self.bits):
            key, at, n = self.key, self.at, self.count
            old, ids, used = key != 0, self.ids, self.used
            self._empty(self.bits + 2)
            self.ids, self.used = ids, used
            self._put(key[old], at[old], n[old])
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        at = np.zeros(len(h), np.uint32)
        fits = size < self.ODD
        at[~odd] = self.used + np.cumsum(size) - size
        count[~odd] = np.where(fits, size, self.ODD)
        self.ids[self.used : self.used + len(new)] = new
        self.used += len(new)
        self._put(h, at, count)

    def batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """uint16 ids of each text (None: empty), in order."""
        column = pa.array(texts, pa.large_string(), from_pandas=True)
        raw, bounds = texts_of(column)
        row = 0
        while row < len(column):
            to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + (1 << 20), side="right")) - 1)
            yield from self._run(raw[bounds[row] : bounds[to]], bounds[row : to + 1] - bounds[row])
            row = to

    def _run(self, raw: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        h, first, start, end = hash_words(raw, bounds, gaps=ONLY_SPACE, places=True)
        size = end - start
        h = mix(h + size.astype(np.uint64)) | U(1)
        inner = np.ones(len(h), bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        at = np.flatnonzero(inner)
        slot = self._find(h[at])
        lost = at[slot < 0]
        if len(lost):
            new, where = np.unique(h[lost], return_index=True)
            self._learn(new, [raw[start[i] : end[i]].tobytes().decode() for i in lost[where].tolist()])
            slot = self._find(h[at])
        off, n = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        off[at], n[at] = self.at[slot], np.where(slot < 0, self.ODD, self.count[slot])
        odd = np.append(0, np.cumsum(n == self.ODD))
        n[n == self.ODD] = 0
        total = np.append(0, np.cumsum(n))
        ids = self.ids[np.repeat(off - total[:-1], n) + np.arange(total[-1])]
        used = np.append(0, np.cumsum(size))
        for k in range(len(bounds) - 1):
            a, b, bytes_ = first[k], first[k + 1], bounds[k + 1] - bounds[k]
            if bytes_ == 0:
                yield np.empty(0, np.uint16)
                continue
            spaces = bytes_ - (used[b] - used[a])
            head = raw[start[a] : end[a]].tobytes().decode() if b > a else ""
            if b == a or spaces != b - a - 1 or odd[b] > odd[a] or (b - a > 1 and head[-1].isspace()):
                yield self.whole(raw[bounds[k] : bounds[k + 1]].tobytes().decode())
            else:
                yield np.concatenate([self.whole(head), ids[total[a] : total[b]]])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder to a Python worker: its cache serves all the worker's tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# --- variable-length coding -------------------------------------------------------------------------

#: For each control byte: the byte counts of its four values.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of uint32 values."""
    r = np.ascontiguousarray(ranks, "<u4")
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    four = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    four[: len(r)] = code
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    keep = np.arange(4, dtype=np.uint8) <= code[:, None]
    return control.tobytes(), r.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n uint32 values, by a look-up of each control byte and of each value's bytes."""
    width = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(width) - width
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    out = raw[at]
    for k in (1, 2, 3):
        more = np.flatnonzero(width > k)
        if len(more) == 0:
            break
        out[more] |= raw[at[more] + k] << np.uint32(8 * k)
    return out


# --- corpus -------------------------------------------------------------------------------------------


def text_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids): the texts' ids as little-endian 16-bit integers."""

    def encode(batches):
        enc = encoder(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": [x.astype("<u2").tobytes() for x in enc.batch(pdf["text"].tolist())]})

    return docs.mapInPandas(trimmed(encode), "doc_id long, ids binary")


def id_counts(coded: DataFrame, end_id: int | None = 0) -> np.ndarray:
    """How often each id occurs in all rows of text_ids (and end_id once a row): bounded by the vocabulary."""

    def count(batches):
        n = np.zeros(1 << 16, np.int64)
        for batch in batches:
            raw = batch.column(0).cast(pa.large_binary())
            if len(raw):
                _, offsets, data = raw.buffers()
                at = np.frombuffer(offsets, np.int64, len(raw) + 1, raw.offset * 8)
                if at[-1] > at[0]:
                    n += np.bincount(np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<u2"), minlength=1 << 16)
            if end_id is not None:
                n[end_id] += len(raw)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["id", "n"])

    total = np.zeros(1 << 16, np.int64)
    for r in coded.select("ids").mapInArrow(trimmed(count), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        total[r["id"]] = r["n"]
    return total


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, shards: int | None = None, block: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """Write all documents' ids, each followed by end_id, in the shared folder: (block files, rank table).

    docs: doc_id long, text string; other columns are ignored. A null or empty text has only the end id;
    a null doc_id sorts first; repeated doc_ids stay apart, in the order of their texts. An empty table
    gives empty files. Texts are encoded once, into a staged table of plain ids, which is counted (bounded by the
    vocabulary), coded by rank, and deleted; only coded bytes are shuffled, once, by range of doc_id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plain = stage(text_ids(docs, tokenizer), "text-ids", compression="zstd")
    counts = id_counts(plain, end_id)
    order = np.lexsort((np.arange(len(counts)), -counts)).astype(np.uint32)
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select("doc_id").na.drop().approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []
    bounds = np.unique(np.array(cuts, np.int64)) if cuts else np.empty(0, np.int64)
    ranks, edges = spark.sparkContext.broadcast(rank), spark.sparkContext.broadcast(bounds)

    def encode(batches):
        of = ranks.value
        for pdf in batches:
            ids = pdf["doc_id"]
            shard = np.where(ids.isna(), 0, np.searchsorted(edges.value, ids.fillna(0).astype(np.int64), side="right")).astype(np.int32)
            rows = []
            for x in pdf["ids"]:
                r = of[np.frombuffer(x, "<u2")]
                rows.append((len(r) + 1, *encode_ranks(np.append(r, of[end_id]))))
            out = pd.DataFrame(rows, columns=["n", "control", "data"])
            yield pd.DataFrame({"shard": shard, "doc_id": ids.astype("Int64"), "n": out["n"], "control": out["control"], "data": out["data"]})

    def pack(batches):
        held, size, base, number, shard = [], 0, 0, 0, None

        def row():
            null = np.array([h[0] is None for h in held], np.uint8)
            doc = np.array([0 if h[0] is None else h[0] for h in held], np.int64)
            return pd.DataFrame({"shard": [shard], "block": [number], "base": [base], "tokens": [size], "docs": [doc.tobytes()], "nulls": [null.tobytes()], "counts": [np.array([h[1] for h in held], np.int64).tobytes()], "control": [b"".join(h[2] for h in held)], "data": [b"".join(h[3] for h in held)]})

        for pdf in batches:
            for s, d, n, c, x in zip(pdf["shard"], pdf["doc_id"].astype("Int64"), pdf["n"], pdf["control"], pdf["data"], strict=True):
                if held and (s != shard or size >= block):
                    yield row()
                    held, base, number, size = [], base + size, number + 1, 0
                if s != shard:
                    shard, base, number = s, 0, 0
                held.append((None if pd.isna(d) else int(d), int(n), c, x))
                size += int(n)
        if held:
            yield row()

    coded = plain.mapInPandas(trimmed(encode), "shard int, doc_id long, n long, control binary, data binary")
    files = (
        coded.repartitionById(len(bounds) + 1, F.col("shard"))
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "data")
        .mapInPandas(trimmed(pack), "shard int, block int, base long, tokens long, docs binary, nulls binary, counts binary, control binary, data binary")
    )
    table = spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(order), dtype=np.int32), "id": order.astype(np.int32)})).coalesce(1)
    files = stage(files, "token-blocks")
    drop(plain)
    return files, stage(table, "token-ids")


def read_tokens(files: DataFrame, table: DataFrame, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from files that write_tokens wrote: start counts the ids of all documents before."""
    spark = files.sparkSession
    order = np.zeros(1 << 16, np.uint32)
    for r in table.toLocalIterator():
        order[r["rank"]] = r["id"]
    totals = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.sum("tokens").alias("n")).collect()}  # a row to each file
    first, before = {}, 0
    for s in sorted(totals):
        first[s] = before
        before += totals[s]
    ids_of, first = spark.sparkContext.broadcast(order), spark.sparkContext.broadcast(first)

    def decode(batches):
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                n = np.frombuffer(b.counts, np.int64)
                doc = pd.array(np.frombuffer(b.docs, np.int64), "Int64")
                doc[np.frombuffer(b.nulls, np.uint8) == 1] = pd.NA
                start = first.value[b.shard] + b.base + np.cumsum(n) - n
                control, at_c, at_d, crc, kept = b.control, 0, 0, [], []
                for k in n.tolist():
                    c = control[at_c : at_c + -(-k // 4)]
                    size = int(_LENGTHS[np.frombuffer(c, np.uint8)].ravel()[:k].sum(dtype=np.int64))
                    ids = ids_of.value[decode_ranks(c, b.data[at_d : at_d + size], k)]
                    at_c, at_d = at_c + len(c), at_d + size
                    crc.append(crc32_ids(ids))
                    if keep_ids:
                        kept.append(ids.astype(np.int32))
                out = pd.DataFrame({"doc_id": doc, "start": start, "n_tokens": n, "ids_crc32": np.array(crc, np.int64)})
                yield out.assign(ids=kept) if keep_ids else out

    return files.mapInPandas(trimmed(decode), "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))
