"""A prefix trie of conversations, from joins and sums over prefix digests.

Every prefix of a conversation has a digest that a running exclusive-or of its turns' hashes gives (each hash takes the
turn's place in, so order counts). The least conversation of a digest owns the prefix. Who owns a prefix owns all longer
ones of its own, so each conversation's first owned depth is found by binary search: a round probes one depth of every
conversation that is still open, in one batch of joins against the digests' minima. The owned depths of a conversation
are a chain, and the chain hangs on the owner of the depth before it. Chains sum up bottom-up by doubling: after k rounds
a chain holds the sums of all chains less than 2**k above it, so deeply nested chains take few rounds, too.
No group is gathered: counts are aggregates, running sums go by buckets of a conversation, and texts are left behind first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.llm.words import trimmed
from skeinworks.plans.stage import drop, stage

#: Places of a conversation that one bucket holds, and characters of ids that a run of ends is sent on with.
BUCKET, PIECE = 64, 1 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()


def positions(turns: DataFrame) -> DataFrame:
    """turns (conv long, turn long, other columns) with `pos`, the place from 1 in the conversation by turn (null first), role, text.

    Buckets of turns are numbered apart and carry the counts of the buckets before them, so a long conversation is many tasks'.
    """
    b = F.coalesce(F.floor(F.col("turn") / BUCKET), F.lit(-(1 << 62)))
    d = turns.withColumn("__b", b)
    own = F.row_number().over(Window.partitionBy("conv", "__b").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    counts = d.groupBy("conv", "__b").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.withColumn("before", before).filter("before > 0").select("conv", "__b", "before")
    return d.withColumn("own", own).join(carried, ["conv", "__b"], "left").withColumn("pos", (F.col("own") + F.coalesce("before", F.lit(0))).cast("long")).drop("__b", "own", "before")


def running(df: DataFrame, key: str, place: str, sums: dict[str, Column], down: bool = False) -> DataFrame:
    """df with running sums (or exclusive-ors, for names that start with x) over the places of a key; down: from the last place to the first."""
    order = F.desc(place) if down else F.asc(place)
    total = {n: F.bit_xor if n.startswith("x") else F.sum for n in sums}
    d = df.withColumn("__b", F.floor(F.col(place) / BUCKET)).withColumns({f"__{n}": c for n, c in sums.items()})
    own = Window.partitionBy(key, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    left = d.groupBy(key, "__b").agg(*(total[n](f"__{n}").alias(f"__{n}") for n in sums))
    earlier = Window.partitionBy(key).orderBy(F.desc("__b") if down else F.asc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select(key, "__b", *(total[n](f"__{n}").over(earlier).alias(f"__{n}_before") for n in sums)).filter(F.col(f"__{next(iter(sums))}_before").isNotNull())
    out = d.withColumns({n: total[n](f"__{n}").over(own) for n in sums}).join(carried, [key, "__b"], "left")
    add = lambda n: F.col(n).bitwiseXOR(F.coalesce(f"__{n}_before", F.lit(0))) if n.startswith("x") else F.col(n) + F.coalesce(f"__{n}_before", F.lit(0))
    return out.select(*df.columns, *(add(n).alias(n) for n in sums))


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv, depth, x1, x2, chars, cum): each conversation's prefixes, the empty one too, by digests of 128 bits; cum: characters so far."""
    tagged = {"x1": F.xxhash64("pos", "h1", "h2"), "x2": F.xxhash64("h2", "pos", F.lit(1), "h1")}
    t = running(turns.select("conv", "pos", "h1", "h2", "chars"), "conv", "pos", tagged | {"cum": F.col("chars")})
    zero = F.lit(0).cast("long")
    return convs.select("conv", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("chars"), zero.alias("cum")).unionByName(t.select("conv", F.col("pos").alias("depth"), "x1", "x2", "chars", "cum"))


def hashed(turns: DataFrame) -> DataFrame:
    """turns with h1, h2 and chars in place of role and text."""
    return turns.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("turn"), "text", "role"), "chars": F.char_length("text").cast("long")}).drop("role", "text")


def _probe(asked: DataFrame, p: DataFrame, minima: DataFrame) -> DataFrame:
    """asked (conv, depth, ...) with the owner of that prefix of the conversation."""
    found = asked.join(p.select("conv", "depth", "x1", "x2"), ["conv", "depth"])
    return found.join(minima, ["depth", "x1", "x2"]).drop("x1", "x2")


def first_owned(p: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv, len, total, first): each conversation's length, characters, and the least depth that it owns; len + 1 if it owns none."""
    state = stage(p.groupBy("conv").agg(F.max("depth").alias("len"), F.max("cum").alias("total")).select("*", F.lit(0).cast("long").alias("lo"), (F.col("len") + 1).alias("hi")), "search")
    longest = state.agg(F.max("hi")).first()[0] or 0
    for _ in range(int(longest).bit_length()):
        asked = state.filter("lo < hi").withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2))
        own = F.col("owner") == F.col("conv")
        told = _probe(asked, p, minima).select("conv", "len", "total", F.when(own, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(own, F.col("depth")).otherwise(F.col("hi")).alias("hi"))
        new = stage(told.unionByName(state.filter("lo >= hi")), "search")
        drop(state)
        state = new
    return state.select("conv", "len", "total", F.col("lo").alias("first"))


SUMS = ["t", "leaf", "total", "own"]


def subtree_sums(chains: DataFrame) -> DataFrame:
    """chains (conv, up, and the columns of SUMS) with each column summed over the chain and all that hang on it, directly or not.

    up: the chain that it hangs on, null for none. After k rounds, sums hold all chains less than 2**k below, and `up` is the
    chain 2**k above. A chain whose next one hangs on none is settled without a join, so most never ask a hot owner.
    """
    now = stage(chains, "sums")
    while now.filter("up IS NOT NULL").head(1):
        more = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv")).agg(*(F.sum(c).alias(f"__{c}") for c in SUMS))
        above = now.filter("up IS NOT NULL").select(F.col("conv").alias("up"), F.col("up").alias("__up"))
        new = now.join(more, "conv", "left").join(above, "up", "left").select("conv", F.col("__up").alias("up"), *((F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in SUMS))
        new = stage(new, "sums")
        drop(now)
        now = new
    return now.drop("up")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted (owner, depth, conv) as comma-joined pieces, one row to a node and task or PIECE characters."""
    names = ["owner", "depth", "at", "piece"]
    key, at, ids, size = None, 0, [], 0
    out: list[tuple] = []
    for batch in batches:
        for owner, depth, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (owner, depth) != key or size >= PIECE:
                if ids:
                    out.append((*key, at, ",".join(ids)))
                key, at, ids, size = (owner, depth), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], _PIECES)
            out = []
    if ids:
        out.append((*key, at, ",".join(ids)))
    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], _PIECES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in order: one piece is held at a time."""
    key, sha = None, None
    for batch in batches:
        out = []
        for owner, depth, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (owner, depth) == key:
                sha.update(b",")
            else:
                if sha:
                    out.append((*key, sha.hexdigest()))
                key, sha = (owner, depth), hashlib.sha256()
            sha.update(piece.encode())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(_SHAS.names, x, strict=True)) for x in out], _SHAS)
    if sha:
        yield pa.RecordBatch.from_pylist([dict(zip(_SHAS.names, (*key, sha.hexdigest()), strict=True))], _SHAS)


_PIECES = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("at", pa.int64()), ("piece", pa.string())])
_SHAS = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) of nodes (owner, depth) where conversations (conv) end: their ids, ascending, comma-joined.

    Ids are sorted over all tasks, each of which packs its run of a node's ids; only packed runs meet, in order.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["owner", "depth", "conv"]
    packed = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(trimmed(_runs), "owner long, depth long, at long, piece string")
    return packed.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "at").mapInArrow(trimmed(_digests), "conv long, depth long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row to a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (long), ends_sha256.

    convs: conv long, each once, turnless ones too. turns: conv, pos (1 to the conversation's length), h1, h2 (hashes of the
    turn), chars. A node is a distinct sequence of the first `depth` turns of some conversation and is named by the
    least conversation that starts with it. Conversations that are equal in all turns end at one node. No conversations:
    no nodes, not even a root.
    """
    p = stage(prefixes(convs, turns), "prefixes")
    minima = stage(p.groupBy("depth", "x1", "x2").agg(F.min("conv").alias("owner")), "minima")
    found = stage(first_owned(p, minima), "owned")
    hung = _probe(found.filter("first > 0").withColumn("depth", F.col("first") - 1), p, minima).select("conv", F.col("owner").alias("up"), F.col("depth").alias("at"))
    found = stage(found.join(hung, "conv", "left"), "chains")
    full = F.col("first") <= F.col("len")
    kids = stage(found.filter(F.col("up").isNotNull() & full).groupBy(F.col("up").alias("conv"), F.col("at").alias("depth")).agg(F.count("*").alias("kids")), "kids")
    nodes = stage(p.join(found.filter(full).select("conv", "len", "first", "total", "up"), "conv").filter("depth >= first").select("conv", "depth", "chars", "cum", "len", "first", "total", "up"), "nodes")
    last = kids.select("conv", F.col("depth").alias("len"), F.lit(1).alias("grown"))
    own = nodes.groupBy("conv").agg(F.sum("chars").alias("own"))
    chains = found.join(last, ["conv", "len"], "left").join(own, "conv", "left")
    leaf = F.when(full & F.col("grown").isNull(), 1).otherwise(0).cast("long")
    sums = subtree_sums(chains.select("conv", "up", F.lit(1).cast("long").alias("t"), leaf.alias("leaf"), "total", F.coalesce("own", F.lit(0)).alias("own")))
    hanging = found.filter("up IS NOT NULL").select("conv", "up", "at").join(sums, "conv").groupBy(F.col("up").alias("conv"), F.col("at").alias("depth")).agg(*(F.sum(c).alias(f"h_{c}") for c in SUMS))
    n = nodes.join(hanging, ["conv", "depth"], "left").join(kids, ["conv", "depth"], "left").join(last, ["conv", "len"], "left")
    n = running(n, "conv", "depth", {c: F.coalesce(f"h_{c}", F.lit(0)) for c in ("t", "leaf", "own")} | {"paths": F.coalesce("h_total", F.lit(0))}, down=True)
    before = F.col("cum") - F.col("chars")
    convs_n = 1 + F.col("t")
    ends = stage(found.select(F.when(full, F.col("conv")).otherwise(F.col("up")).alias("owner"), F.col("len").alias("depth"), "conv"), "ends")
    out = n.join(ends_digests(ends), ["conv", "depth"], "left")
    return out.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("first"), F.col("conv")).otherwise(F.col("up")).alias("parent_conv_id"),
        convs_n.alias("n_convs"),
        (F.when(F.col("depth") < F.col("len"), 1).otherwise(0) + F.coalesce("kids", F.lit(0))).alias("n_children"),
        (leaf + F.col("leaf")).alias("n_leaves"),
        # All paths through the node, from it on, less one copy of every node of its subtree.
        (F.col("total") + F.col("paths") - convs_n * before - (F.col("total") - before + F.col("own"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def rebuilt(conversations: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(convs, turns) for trie: each conversation c starts with the first h turns of c - c % group, h = crc32(c) % heads, and goes on with its own after its first h.

    conversations: conv_id, turn (long), role, text (nulls: empty), in order of turn (null first), then role and text. Rows without a
    conv_id take no part; repeated rows are turns of their own; other columns are left out.
    """
    c = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = stage(hashed(positions(c)).drop("turn"), "turns")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = t.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % group)
    first = t.filter((F.col("pos") < heads) & (F.col("conv") % group == 0)).select(F.col("conv").alias("base"), "pos", "h1", "h2", "chars")
    known = first.groupBy("base").agg(F.count("*").alias("k"))
    convs = stage(convs.join(known, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("k", F.lit(0))).alias("from_base")), "convs")
    lent = convs.filter("from_base > 0").join(first, "base").filter(F.col("pos") <= F.col("h")).select("conv", "pos", "h1", "h2", "chars")
    short = convs.filter("from_base < h").select("conv", (F.col("from_base") - F.col("h")).alias("shift"))
    own = t.filter(F.col("pos") > h).join(short, "conv", "left").select("conv", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "h1", "h2", "chars")
    return convs.select("conv"), stage(lent.unionByName(own), "rebuilt")
