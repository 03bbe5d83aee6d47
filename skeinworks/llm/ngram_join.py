"""Similarity join on word n-gram sets by prefixes under several global orders.

A global order sorts all tokens (n-gram hashes). Two sets whose Jaccard similarity reaches t share a token among
the first n - ceil(t n) + 1 of each, under every global order. Order one is by frequency, rare tokens first: each
token's sets are counted in its shard, exactly, and what is shared comes back to the set. Tokens of one set alone
come first and are never sent back; a set with too many of them has no partner. Orders two and three are by hash;
each set carries its prefixes under them, cut to 16 or, for longer prefixes, 32 bits a token (a false match lets
a pair through, none is lost). A pair must share prefix tokens under order one (found by grouping) and then under the others, before a text is
fetched or a set compared.

Linking needs no list of all pairs. Equal sets are one class from the start. In the first round the members of
a token's group are compared with one member alone, the one whose prefix is shared most, so a group of g costs
g - 1 comparisons at most. The second round finishes the job: members of a group that are still in different
components, and share enough prefix tokens that t is within reach, are compared too. A pair left out is one whose
ends are linked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.components import components
from skeinworks.llm.words import U, mix, slices, trimmed, windows
from skeinworks.plans.stage import bounded_batches, drop, stage

#: Seeds of the orders' hashes.
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)
FLUSH, GROUP = 1 << 20, 1 << 20
#: A token of this many sets of one block is hot: its sets are dealt by their own keys, not to the token's task, and it ranks after all others.
HOT = 64
_MOST = (1 << 32) - 1
#: The most sets of a block, so that a place in it takes two bytes; bits of a block's number in its partition, and how far apart the
#: blocks of neighbouring partitions are dealt.
MOST_SETS, BLOCKS, PARTS = 1 << 16, 20, 8
#: The most document ids that are broadcast to pick the texts to compare; beyond, a shuffled join does it.
MOST_IDS = 1_000_000
_SHORT = 0x452821E638D01377


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words has its whole sequence as one."""
    all_of = windows(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(all_of[a : b - n + 1]))
        elif b > a:
            out.append(mix(windows(h[a:b], b - a) + U(_SHORT * (b - a) % (1 << 64))))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefix_size(n: int, percent: int) -> int:
    """The least overlap of a set of n with any partner is ceil(percent n / 100)."""
    return n - -(-percent * n // 100) + 1


def prefix(tokens: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The prefix under an order by hash, as ranks; a rank identifies its token."""
    r = mix(tokens ^ U(ORDERS[order]))
    p = prefix_size(len(r), percent)
    return np.partition(r, p - 1)[:p] if p < len(r) else r


#: Prefixes of up to SHORT tokens are kept in 16 bits a token, longer ones in 32: of two prefixes of p and q tokens that share
#: none, about p q / 2**16 or p q / 2**32 still seem to meet.
SHORT = 32
HEAD = np.dtype("<u4")


def signature(tokens: np.ndarray, percent: int) -> bytes:
    """The prefixes under the other orders: the number of tokens of each, then all, in a width that the prefix's size gives."""
    width = np.uint16 if prefix_size(len(tokens), percent) <= SHORT else np.uint32
    parts = [np.unique(prefix(tokens, k, percent).astype(width)) for k in range(1, len(ORDERS))]
    return np.array([*(len(x) for x in parts)], HEAD).tobytes() + np.concatenate(parts).tobytes()


def _cuts_of(s: bytes) -> list[np.ndarray]:
    k = len(ORDERS) - 1
    n = np.frombuffer(s, HEAD, k)
    width = np.uint16 if (len(s) - HEAD.itemsize * k) == 2 * int(n.sum()) else np.uint32
    return np.split(np.frombuffer(s, width, offset=HEAD.itemsize * k), np.cumsum(n)[:-1])


def orders_meet(x: bytes, y: bytes) -> bool:
    """Whether two sets share a prefix token under each of the other orders, as far as the narrower of their widths tells. A false match lets a pair through; none is lost."""
    for p, q in zip(_cuts_of(x), _cuts_of(y), strict=True):
        if p.dtype != q.dtype:
            p, q = np.unique(p.astype(np.uint16)), np.unique(q.astype(np.uint16))
        if not np.intersect1d(p, q, assume_unique=True).size:
            return False
    return True


def _set_key(tokens: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix(tokens)) ^ np.add.reduce(mix(tokens ^ U(ORDERS[1])) * U(3))) if len(tokens) else 0


_BINARY = ["t4", "t2", "r", "counts"]
SENT = pa.schema([("at", pa.int32()), ("kind", pa.int8()), ("block", pa.int64()), *((c, pa.binary()) for c in _BINARY)])
SENT_SQL = "at int, kind byte, block long, t4 binary, t2 binary, r binary, counts binary"
#: Kinds of messages: tokens for their shard, hot ones dealt by set, marks of hot ones, a block's sets; tokens that come back.
PLAIN, SPREAD, MARK, SETS, BACK = range(5)


def _halves(x: np.ndarray) -> tuple[bytes, bytes]:
    """48 bits as arrays of 32 and 16."""
    return x.astype(np.uint32).tobytes(), (x >> U(32)).astype(np.uint16).tobytes()


def _whole(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint32).astype(np.uint64) | (np.frombuffer(high, np.uint16).astype(np.uint64) << U(32))


_48 = U((1 << 48) - 1)


def _ranges(x: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist()
    return list(zip(at, [*at[1:], len(x)], strict=True)) if len(x) else []


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, key, n, sig) of each document: n is 0 without words, and equal sets that follow in a partition have the signature once."""

    def sets(batches):
        seen: set[int] = set()
        for batch in batches:
            m = len(batch)
            keys, sizes, sigs = np.zeros(m, np.int64), np.zeros(m, np.int32), [None] * m
            for a, _, h, first in slices(batch.column(1), lower=True):
                for i, tokens in enumerate(ngrams(h, first, n), a):
                    if len(tokens):
                        keys[i], sizes[i] = np.uint64(_set_key(tokens)).view(np.int64), len(tokens)
                        if int(keys[i]) not in seen:
                            seen.add(int(keys[i]))
                            sigs[i] = signature(tokens, percent)
            if len(seen) > FLUSH:
                seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(sizes), pa.array(sigs, pa.binary())], ["doc_id", "key", "n", "sig"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(sets), "doc_id long, key long, n int, sig binary")


def _home(block, shards: int):
    """Where a block's sets and what comes back to them meet; a block is known by its partition and its number there."""
    return ((block >> BLOCKS) * PARTS + (block & ((1 << BLOCKS) - 1))) % shards


def settled(docs: DataFrame) -> DataFrame:
    """docs, written if a lost task could get its rows in another order when it runs again, as sets are known by their places."""
    return stage(docs, "documents") if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def _counted(docs: DataFrame, n: int, shards: int) -> DataFrame:
    """Rows of sets (SETS) and of tokens that several sets share (BACK), by block of sets."""

    def row(at, kind, block, *binary):
        return {"at": int(at), "kind": kind, "block": int(block), **dict(zip(_BINARY, binary, strict=False))}

    def send(batches):
        block, held, seen, size = TaskContext.get().partitionId() << BLOCKS, [], set(), 0
        for batch in batches:
            for _, _, h, first in slices(batch.column(0), lower=True):
                for tokens in ngrams(h, first, n):
                    key = np.uint64(_set_key(tokens))
                    if len(tokens) and key not in seen:
                        seen.add(key)
                        held.append((tokens, key))
                        size += len(tokens)
                        if size >= FLUSH or len(held) == MOST_SETS:
                            yield flush(held, block)
                            block, held, seen, size = block + 1, [], set(), 0
        if held:
            yield flush(held, block)

    def flush(held, block):
        """A block's messages. A set is known in its block by its place, a token in its shard by 48 bits of its hash."""
        sizes = np.array([len(t) for t, _ in held])
        keys = np.array([k for _, k in held], np.uint64)
        t, ref = mix(np.concatenate([t for t, _ in held])), np.repeat(np.arange(len(held), dtype=np.uint16), sizes)
        order = np.argsort(t, kind="stable")
        t, ref = t[order], ref[order]
        start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        span = np.diff(np.append(start, len(t)))
        hot = np.repeat(span >= HOT, span)
        mark = t[start[span >= HOT]]
        dealt = mix(ref[hot].astype(np.uint64) | U(block << 16))
        rows = []
        for kind, x, r, by in ((PLAIN, t[~hot], ref[~hot], t[~hot]), (SPREAD, t[hot], ref[hot], dealt), (MARK, mark, mark[:0].astype(np.uint16), mark)):
            shard = by % U(shards)
            order = np.argsort(shard, kind="stable")
            x, r, shard = x[order], r[order] if kind != MARK else r, shard[order]
            for a, b in _ranges(shard):
                # A hot token is dealt to a shard of its sets, so its own shard goes along.
                counts = (x[a:b] % U(shards)).astype(np.uint32).tobytes() if kind == SPREAD else b""
                rows.append(row(shard[a], kind, block, *_halves(x[a:b] & _48), r[a:b].tobytes(), counts))
        rows.append(row(_home(block, shards), SETS, block, keys.tobytes(), b"", b"", sizes.astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_pylist(rows, SENT)

    def count(batches):
        got: dict[tuple, list] = {}
        for batch in batches:
            kind = batch.column(1).to_numpy()
            if (kind >= SETS).any():
                yield from pa.Table.from_batches([batch]).filter(pa.array(kind >= SETS)).to_batches()
            if (kind < SETS).any():
                for r in pa.Table.from_batches([batch]).filter(pa.array(kind < SETS)).to_pylist():
                    t = _whole(r["t4"], r["t2"])
                    ref = np.frombuffer(r["r"], np.uint16) if r["kind"] != MARK else np.zeros(len(t), np.uint16)
                    own = np.frombuffer(r["counts"], np.uint32) if r["kind"] == SPREAD else np.full(len(t), r["at"], np.uint32)
                    got.setdefault((r["at"], r["kind"] == SPREAD), []).append((t, ref, np.full(len(t), -1 if r["kind"] == MARK else r["block"], np.int64), own))
        for (_, spread), parts in got.items():
            t, ref, block, own = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((block, t))
            t, ref, block, own = t[order], ref[order], block[order], own[order]
            keep = np.append(True, (t[1:] != t[:-1]) | (block[1:] != -1))  # a token is marked once, by whatever blocks
            t, ref, block, own = t[keep], ref[keep], block[keep], own[keep]
            start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            span = np.diff(np.append(start, len(t)))
            many = np.repeat(np.where(block[start] == -1, _MOST, np.minimum(span, _MOST - 1)), span)  # a mark comes first
            many = np.full(len(t), _MOST) if spread else many
            at = np.flatnonzero((block >= 0) & (many > 1))
            # Known everywhere by one number, made of its shard and 48 bits.
            name, many, ref, block = mix(t[at] | (mix(own[at].astype(np.uint64)) & ~_48)), many[at].astype(np.uint32), ref[at], block[at]
            order = np.argsort(block, kind="stable")
            name, many, ref, block = name[order], many[order], ref[order], block[order]
            rows = [row(_home(int(block[a]), shards), BACK, block[a], name[a:b].tobytes(), b"", ref[a:b].tobytes(), many[a:b].tobytes()) for a, b in _ranges(block)]
            for a in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist(rows[a : a + 1000], SENT)

    return docs.select("text").mapInArrow(trimmed(send), SENT_SQL).repartition(shards, "at").mapInArrow(trimmed(count), SENT_SQL)


def _prefixes(counted: DataFrame, percent: int, shards: int) -> DataFrame:
    """(token, key, n, pos) of the shared tokens in each set's prefix; pos is the place under the order by frequency."""

    def cut(batches):
        got: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                x = (np.frombuffer(r["t4"], np.uint64), np.frombuffer(r["r"], np.uint16), np.frombuffer(r["counts"], np.uint32))
                got.setdefault(r["block"], ([], []))[r["kind"] == BACK].append(x)
        for sets, back in got.values():
            if not back:
                continue
            key, _, size = sets[0]
            size = size.astype(np.int64)
            name, ref, many = (np.concatenate(x) for x in zip(*back, strict=True))
            order = np.lexsort((name, many, ref))
            name, ref = name[order], ref[order]
            start = np.flatnonzero(np.append(True, ref[1:] != ref[:-1]))
            span = np.diff(np.append(start, len(ref)))
            of = ref[start].astype(np.int64)
            n = size[of]
            alone = n - span
            keep = n - -(-percent * n // 100) + 1 - alone
            rank = np.arange(len(ref)) - np.repeat(start, span)
            at = np.flatnonzero(rank < np.repeat(keep, span))
            of = np.repeat(of, span)[at]
            pos = rank[at] + np.repeat(alone, span)[at]
            for a in range(0, len(at), 100_000):
                b = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(name[at[b]].view(np.int64)), pa.array(key[of[b]].view(np.int64)), pa.array(size[of[b]].astype(np.int32)), pa.array(pos[b].astype(np.int32))], ["token", "key", "n", "pos"])

    return counted.drop("t2").repartition(shards, "at").mapInArrow(trimmed(cut), "token long, key long, n int, pos int").dropDuplicates(["token", "key"])


def _meeting(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose prefixes meet under the other orders too."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sig = stage(sets.filter("sig IS NOT NULL").join(wanted, "key", "left_semi").groupBy("key").agg(F.min("sig").alias("sig")), "signatures")

    def meet(batches):
        for batch in batches:
            ok = [orders_meet(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield from pa.Table.from_batches([batch.select([0, 1])]).filter(pa.array(ok, pa.bool_())).to_batches()

    both = pairs.join(sig.toDF("a", "x"), "a").join(sig.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(meet, "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b, da, db: keys and one document of each), those whose sets reach the threshold."""
    need = stage(pairs.select(F.explode(F.array("da", "db")).alias("id")).distinct(), "wanted")
    few = need.count() <= MOST_IDS
    texts = stage(docs.join(F.broadcast(need) if few else need, F.col("doc_id") == F.col("id"), "left_semi"), "wanted-texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("db"), F.col("text").alias("tb")), "db").join(texts.select(F.col("doc_id").alias("da"), F.col("text").alias("ta")), "da")

    def compare(batches):
        for batch in batches:
            keep = []
            sets = [[x for _, _, h, first in slices(batch.column(c), lower=True) for x in ngrams(h, first, n)] for c in (2, 3)]
            for x, y in zip(*sets, strict=True):
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(len(x) > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            out = pa.Table.from_batches([batch.select([0, 1])]).filter(pa.array(keep, pa.bool_()))
            yield from out.to_batches()

    out = stage(both.select("a", "b", "ta", "tb").mapInArrow(trimmed(compare), "a long, b long"), "links")
    drop(texts)
    drop(need)
    return out


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Components of documents whose n-gram sets are linked: 100 * intersection >= percent * union.

    docs: doc_id long, text string; other columns are ignored. Words are runs of bytes other than space and
    \\t-\\r, after lower-casing A-Z alone. A text of fewer than n words has its whole word sequence as its only
    n-gram; null and empty texts have an empty set and are linked with nothing. Repeated doc_ids are reported
    once, with the least set. Null doc_ids are dropped, as they name no document. An empty table gives an empty
    result. Returns doc_id, n_shingles, component_id: the least doc_id that links reach.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL"))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    # About one token for six characters.
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 6 // GROUP)
    sets = stage(_sets(docs, n, percent), "sets")
    tokens = stage(_prefixes(_counted(docs, n, shards), percent, shards), "prefixes")
    members = sets.select("doc_id", "key", "n")
    doc = stage(members.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc")), "classes")

    def with_docs(pairs: DataFrame) -> DataFrame:
        return pairs.join(doc.select(F.col("key").alias("a"), F.col("doc").alias("da")), "a").join(doc.select(F.col("key").alias("b"), F.col("doc").alias("db")), "b").select("a", "b", "da", "db")

    def in_reach(pairs: DataFrame) -> DataFrame:
        """Of pairs with c shared prefix tokens and sizes na, nb, those whose overlap can still suffice: beyond the prefix that ends first, at most the rest of its set is shared."""
        rest = F.greatest(*(F.ceil(F.col(x) * percent / 100) - 1 for x in ("na", "nb")))
        fit = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
        return pairs.filter(fit).filter((100 + percent) * (F.col("c") + rest) >= percent * (F.col("na") + F.col("nb"))).select("a", "b")

    share = tokens.groupBy("key").agg((F.count("*") / F.first("n")).alias("share"))
    lead = tokens.join(share, "key").groupBy("token").agg(F.max(F.struct("share", "key", "n")).alias("lead")).select("token", "lead.key", "lead.n").toDF("token", "a", "na")
    # Here c counts groups that a leads: less than all the pair shares, so some pairs are left to the second round.
    first = tokens.select("token", F.col("key").alias("b"), F.col("n").alias("nb")).join(lead, "token").filter("a <> b")
    tried = stage(in_reach(first.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))), "first-pairs")
    links = _verify(stage(with_docs(_meeting(tried, sets)), "first-meeting"), docs, n, percent)
    comp = stage(components(links), "first-components")

    t = tokens.join(comp.withColumnRenamed("id", "key"), "key", "left").select("token", "key", "n", "pos", F.coalesce("comp", "key").alias("comp"))
    mixed = t.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    t = stage(t.join(mixed, "token"), "mixed-tokens")
    a, b = (t.select("token", *(F.col(c).alias(c + x) for c in ("key", "n", "pos", "comp"))) for x in "ab")
    # Two sets of these sizes need `least` tokens in common, so they share one within the first n - least + 1 of each: fewer
    # than the prefix that serves all sizes, and rarer. What a pair shares of its whole prefixes is counted after.
    least = f"ceil({percent} * (na + nb) / {100 + percent})"
    fit = f"compa < compb AND 100 * least(na, nb) >= {percent} * greatest(na, nb) AND posa <= na - {least} AND posb <= nb - {least}"
    met = a.join(b, "token").filter(fit).select(F.col("keya").alias("a"), F.col("keyb").alias("b"), "na", "nb").distinct()
    held = stage(t.groupBy("key").agg(F.collect_list("token").alias("t")), "mixed-prefixes")
    met = met.join(held.toDF("a", "ta"), "a").join(held.toDF("b", "tb"), "b")
    left = in_reach(met.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("c")))
    for x, y in (("a", "b"), ("b", "a")):
        left = left.join(tried.select(F.col("a").alias(x), F.col("b").alias(y)), ["a", "b"], "left_anti")
    left = stage(left, "second-pairs")
    if left.head(1):
        links = links.unionByName(_verify(stage(with_docs(_meeting(left, sets)), "second-meeting"), docs, n, percent))
        comp = stage(components(links), "components")
    named = members.join(comp.withColumnRenamed("id", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    names = named.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = named.filter("n > 0").join(names, "comp").select("doc_id", "n", "component_id").unionByName(named.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.groupBy("doc_id").agg(F.min("n").cast("long").alias("n_shingles"), F.min("component_id").alias("component_id"))
