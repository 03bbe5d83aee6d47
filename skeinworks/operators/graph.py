"""Graph operators on edge tables (src, dst, weight)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinworks.functions import rules
from skeinworks.operators import code
from skeinworks.operators.retrieval import chunk_at
from skeinworks.plans.stage import bounded_batches, drop, stage

# Weights of an edge and of the edge back, between a file's chunks, and what names and files give edges.
MENTION, INCLUDE, DISPATCH = (3.0, 1.5), (1.0, 0.2), (4.0, 2.0)
OVERVIEW, ADJACENT = 0.45, 0.25
LEAST_NAME, NOISY, REPRESENTATIVES = 4, 30, 4
# Weights of seeds, how many chunks a token seeds, and the score of a chunk that ranks bring in.
PRIMARY_SEED, EXACT_SEED, TOKEN_SEED, SEEDED = 3.0, 2.0, 0.35, 8
GRAPH, SCALE = 25.0, 1000.0


def weighted_edges(edges: DataFrame) -> DataFrame:
    """Sum of weights by (src, dst, kind); loops and empty ends are dropped."""
    fine = "src IS NOT NULL AND dst IS NOT NULL AND src <> '' AND dst <> '' AND src <> dst"
    return edges.filter(fine).groupBy("src", "dst", "kind").agg(F.round(F.sum("weight"), 4).alias("weight"))


def pagerank(edges: DataFrame, rounds: int = 40, damping: float = 0.85, seeds: DataFrame | None = None) -> DataFrame:
    """(id, rank) after exactly `rounds` steps; restart and dangling mass go to all nodes alike, or to seeds (id, weight).

    Edges are normalised and written once; each step is a join and a sum, and ranks are written every fourth step so
    that plans stay short and lost executors cost little.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    e = stage(edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("w")), "edges")
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    if seeds is None:
        n = nodes.count()
        base = nodes.withColumn("p", F.lit(1.0 / n if n else 0.0))
    else:
        total = seeds.join(nodes, "id", "left_semi").agg(F.sum("weight")).first()[0] or 1.0
        base = nodes.join(seeds.groupBy("id").agg(F.sum("weight").alias("s")), "id", "left").select("id", (F.coalesce("s", F.lit(0.0)) / total).alias("p"))
    base = stage(base, "base")
    rank = base.select("id", F.col("p").alias("r"))
    held = None
    for k in range(rounds):
        flow = e.join(rank, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("w")).alias("in"))
        moved = flow.agg(F.coalesce(F.sum("in"), F.lit(0.0)).alias("moved"))  # one row: what did not dangle
        rank = base.join(flow, "id", "left").join(F.broadcast(moved)).select("id", (damping * F.coalesce("in", F.lit(0.0)) + F.col("p") * (1 - damping + damping * (1 - F.col("moved")))).alias("r"))
        if k % 4 == 3 or k == rounds - 1:
            new = stage(rank, f"rank-{k}")
            if held is not None:
                drop(held)
            rank = held = new
    return rank.select("id", F.col("r").alias("rank"))


def both_ways(met: DataFrame, kind: str, weights: tuple[float, float]) -> DataFrame:
    """(src, dst, kind, label, weight): edges (src, dst, label), and edges back as kind_rev."""
    there = met.select("src", "dst", F.lit(kind).alias("kind"), "label", F.lit(weights[0]).alias("weight"))
    return there.unionByName(met.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(f"{kind}_rev").alias("kind"), "label", F.lit(weights[1]).alias("weight")))


def symbol_targets(symbols: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """(name, chunk): the functions and classes that a name leads to, also as class::name; names that over 30 chunks mention, or that are short, lead nowhere."""
    noisy = mentions.select("chunk", "name").distinct().groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") > NOISY)
    own = symbols.filter(F.col("kind").isin("function", "class", "struct") & (F.length("name") >= LEAST_NAME)).join(noisy, "name", "left_anti")
    first = [F.col("start"), F.col("end"), F.col("chunk")]
    at = chunk_at(own.select("file", "line").distinct(), chunks.select("chunk", "file", "start", "end", "type"), first).filter("type IN ('function', 'class')")
    met = own.join(at.select("file", "line", "chunk"), ["file", "line"])
    names = F.array_distinct(F.array_compact(F.array(F.col("name"), F.when(F.col("class") != "", F.concat("class", F.lit("::"), "name")))))
    return met.select(F.explode(names).alias("name"), "chunk").distinct()


def mention_edges(mentions: DataFrame, targets: DataFrame) -> DataFrame:
    """From a chunk to the chunks of each name (chunk, name) that it mentions."""
    plain = targets.filter(~F.contains("name", F.lit("::")))
    met = mentions.select(F.col("chunk").alias("src"), "name").distinct().join(plain, "name")
    return both_ways(met.select("src", F.col("chunk").alias("dst"), F.col("name").alias("label")), "mention", MENTION)


def file_edges(chunks: DataFrame) -> DataFrame:
    """Between a file's overview and its functions and classes, and between those that follow each other."""
    c = chunks.select("chunk", "file", "start", "end", "type")
    parts = c.filter("type IN ('function', 'class')")
    over = c.filter("type = 'file_overview'").groupBy("file").agg(F.min(F.struct("start", "end", "chunk")).alias("o")).select("file", F.col("o.chunk").alias("src"))
    star = parts.join(over, "file").select("src", F.col("chunk").alias("dst"), F.lit(OVERVIEW).alias("weight"))
    follow = F.lead("chunk").over(Window.partitionBy("file").orderBy("start", "end", "chunk"))
    line = parts.select(F.col("chunk").alias("src"), follow.alias("dst")).filter("dst IS NOT NULL").withColumn("weight", F.lit(ADJACENT))
    each = star.unionByName(line)
    return each.unionByName(each.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).select("src", "dst", F.lit("same_file").alias("kind"), F.lit("").alias("label"), "weight")


def representatives(chunks: DataFrame) -> DataFrame:
    """(file, chunk): a file's first four overviews and classes; its first chunk, if it has none."""
    order = Window.partitionBy("file").orderBy(F.when(F.col("type").isin("file_overview", "class"), 0).otherwise(1), "start", "end", "chunk")
    r = chunks.select("file", "chunk", "start", "end", "type").withColumn("r", F.row_number().over(order))
    return r.filter((F.col("r") == 1) | (F.col("type").isin("file_overview", "class") & (F.col("r") <= REPRESENTATIVES))).select("file", "chunk")


def include_edges(includes: DataFrame, chunks: DataFrame) -> DataFrame:
    """From a chunk to the representatives of the files that it includes (chunk, name)."""
    files = code.resolve_paths(includes.select("name"), chunks.select("file").distinct()).select("name", F.col("target").alias("file"))
    met = includes.select(F.col("chunk").alias("src"), "name").join(files, "name").join(representatives(chunks), "file")
    return both_ways(met.select("src", F.col("chunk").alias("dst"), F.col("name").alias("label")), "include", INCLUDE)


def dispatch_edges(entries: DataFrame, chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """From the chunk of each entry (command, file, line, target) to those of its target, by its whole name and by the last part of it."""
    first = [F.col("start"), F.col("end"), F.col("chunk")]
    at = chunk_at(entries.select("file", "line").distinct(), chunks.select("chunk", "file", "start", "end"), first).select("file", "line", F.col("chunk").alias("src"))
    each = entries.select("command", "file", "line", F.explode(F.array_distinct(F.array(F.col("target"), F.substring_index("target", "::", -1)))).alias("name"))
    met = each.join(targets, "name").select("command", "file", "line", F.col("chunk").alias("dst")).distinct().join(at, ["file", "line"])
    return both_ways(met.select("src", "dst", F.col("command").alias("label")), "dispatch", DISPATCH)


def code_edges(chunks: DataFrame, targets: DataFrame, mentions: DataFrame, includes: DataFrame, entries: DataFrame) -> DataFrame:
    """(src, dst, kind, label, weight) of all kinds, equal ones summed, loops left out."""
    every = mention_edges(mentions, targets).unionByName(file_edges(chunks)).unionByName(include_edges(includes, chunks)).unionByName(dispatch_edges(entries, chunks, targets))
    return every.filter("src <> dst").groupBy("src", "dst", "kind", "label").agg(F.round(F.sum("weight"), 4).alias("weight"))


#: Edges that one row of an adjacency list holds on average, at most.
ROW_EDGES = 4096


def adjacency(edges: DataFrame, most: int = ROW_EDGES) -> DataFrame:
    """(src, part, edges): each node's edges as arrays by (to, kind, label), a hub's in as many rows as it needs, of about `most` edges each.

    Parts go by a hash of the edge's other end, so no task gathers a hub whole. Nodes of up to `most` edges have one part, 0.
    """
    parts = edges.groupBy("src").agg(F.ceil(F.count("*") / most).alias("parts")).filter("parts > 1")
    cut = edges.join(parts, "src", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")), F.lit(0)))
    return cut.groupBy("src", "part").agg(F.array_sort(F.collect_list(F.struct(F.col("dst").alias("to"), "kind", "label", "weight"))).alias("edges"))


def seeds(primary: DataFrame, exact: DataFrame, tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """(query, id, weight): primary hits 3, other exact ones 2, and 0.35 more for each token of four letters (query, token) that names it, for a token's first eight chunks."""
    own = primary.select("query", F.col("chunk").alias("id"), F.lit(PRIMARY_SEED).alias("w")).unionByName(exact.select("query", F.col("chunk").alias("id"), F.lit(EXACT_SEED).alias("w")))
    own = own.groupBy("query", "id").agg(F.max("w").alias("weight"))
    named = targets.select(F.lower("name").alias("token"), "chunk").distinct().withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy("chunk"))).filter(F.col("r") <= SEEDED)
    more = tokens.filter(F.length("token") >= LEAST_NAME).select("query", "token").distinct().join(named, "token").select("query", F.col("chunk").alias("id"), F.lit(TOKEN_SEED).alias("weight"))
    return own.unionByName(more).groupBy("query", "id").agg(F.sum("weight").alias("weight"))


#: Rank below which a node is let go.
LEAST_RANK = 1e-9
#: Nodes of a piece of the graph, seeds' columns of a block, cells that a task holds of a block, edges in a row, and edges that are multiplied at once, so that caches hold them.
PIECE, COLUMNS, CELLS, RUN, NEAR = 1 << 17, 32, 1 << 25, 1 << 16, 1 << 11
#: Edges that a task holds, at most, where it takes its columns through all rounds, and the least columns of which it then has all nodes.
WHOLE, FEW = 1 << 25, 8


def alike_seeds(base: DataFrame) -> DataFrame:
    """(query, first): queries of one list of seeds (query, id, p), to twelve decimals, have one result, so the least of them stands for all."""
    each = base.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("id", F.round("p", 12).alias("p")))).alias("seeds"))
    return each.join(each.groupBy("seeds").agg(F.min("query").alias("first")), "seeds").select("query", "first")


def personalized(edges: DataFrame, start: DataFrame, rounds: int = 30, damping: float = 0.85, least: float = LEAST_RANK, most: int | None = None) -> DataFrame:
    """(query, id, rank) after exactly `rounds` steps from each query's seeds (query, id, weight): restart and dangling mass go to them.

    Queries of the same seeds are one column. Nodes are cut into pieces of about PIECE and columns into blocks, and a step multiplies the
    matrix of each piece and block with the edges that leave the piece: a task holds two such matrices, and of all nodes no more
    than CELLS cells of a block. What would arrive at a node below `least` goes back to the seeds, like dangling mass, so ranks sum
    to one; least=0 lets nothing go. most: of each query only nodes among the best `most` by nine decimals, and some behind them, are given.
    Then, while the graph has WHOLE edges and FEW columns of its nodes have CELLS cells at most, it is one piece, and a task takes its blocks
    through all rounds by itself.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    e = stage(edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("w")), "edges")
    own = start.filter("weight > 0").groupBy("query", "id").agg(F.sum("weight").alias("s"))
    base = stage(own.join(own.groupBy("query").agg(F.sum("s").alias("all")), "query").select("query", "id", (F.col("s") / F.col("all")).alias("p")), "base")
    members = stage(alike_seeds(base), "members")
    firsts = members.select("first").distinct()
    ids = stage(e.select(F.col("src").alias("id")).union(e.select("dst")).union(base.select("id")).distinct(), "ids")
    n_ids, n_firsts, n_edges = ids.count(), firsts.count(), e.count()
    whole = most is not None and n_edges <= WHOLE and n_ids * FEW <= CELLS
    n_pieces = 1 if whole else -(-n_ids // PIECE) or 1
    n_blocks = -(-n_firsts // max(1, min(COLUMNS, CELLS // max(1, n_ids)))) or 1
    place = lambda rows, key, group, n, at: rows.withColumn(group, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(at, F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1)
    nodes = stage(place(ids, "id", "piece", n_pieces, "at"), "nodes")
    columns = stage(place(firsts, "first", "block", n_blocks, "slot"), "columns")
    high = nodes.groupBy("piece").agg(F.count("*").cast("int").alias("high"))
    wide = columns.groupBy("block").agg(F.count("*").cast("int").alias("wide"))
    seeded = base.join(columns, base["query"] == columns["first"]).join(nodes, "id").groupBy("piece", "block").agg(F.collect_list(F.struct("at", "slot", "p")).alias("x"))
    cells = stage(high.crossJoin(wide).join(seeded, ["piece", "block"], "left").select("piece", "block", "high", "wide", "x.at", "x.slot", "x.p"), "cells")
    n_runs = -(-n_edges // (RUN * n_pieces * n_pieces)) or 1
    ends = lambda end, at, piece: nodes.select(F.col("id").alias(end), F.col("at").alias(at), F.col("piece").alias(piece))
    met = e.join(ends("src", "a", "piece"), "src").join(ends("dst", "b", "to"), "dst").join(F.broadcast(high.select(F.col("piece").alias("to"), F.col("high").alias("to_high"))), "to")
    run = F.pmod(F.xxhash64("dst"), F.lit(n_runs))
    links = met.groupBy("piece", "to", "to_high", run.alias("run")).agg(F.array_sort(F.collect_list(F.struct("b", "a", "w"))).alias("x"))
    links = stage(links.select("piece", "to", "to_high", F.col("x.b").alias("b"), F.col("x.a").alias("a"), F.col("x.w").alias("w")), "links", "lz4")
    bounded_batches(e.sparkSession)
    if whole:
        lanes = _lanes(e.sparkSession, min(n_blocks, e.sparkSession.sparkContext.defaultParallelism))
        n = lanes.count()
        own = cells.withColumn("nth", F.pmod("block", F.lit(n))).join(F.broadcast(lanes), "nth").repartition(n, "lane")
        met = links.crossJoin(F.broadcast(lanes.select(F.col("lane").alias("lane")))).repartition(n, "lane")
        found = own.groupBy("lane").cogroup(met.groupBy("lane")).applyInArrow(lambda key, x, y: _walked(x, y, rounds, damping, least, most), "piece int, block int, at int, slot int, rank double")
        return _of_members(found, nodes, columns, members, [links, cells, e])

    state, flow, spent = cells.withColumn("flow", F.lit(None).cast("binary")).withColumn("back", F.lit(None).cast("array<double>")), None, []
    each = links.crossJoin(F.broadcast(wide.select("block")))
    for _ in range(rounds):
        sent = state.groupBy("piece", "block").cogroup(each.groupBy("piece", "block")).applyInArrow(lambda key, x, y: _sent(key, x, y, damping), "piece int, block int, high int, flow binary")
        new = stage(sent.groupBy("piece", "block").applyInArrow(lambda key, x: _arrived(key, x, least), "piece int, block int, flow binary, moved array<double>"), "flow", "lz4")
        moved = new.select("block", F.posexplode("moved").alias("slot", "m")).groupBy("block", "slot").agg(F.sum("m").alias("m"))
        kept = moved.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("slot", "m"))).alias("x")).select("block", F.transform("x", lambda x: 1 - damping + damping * (1 - x["m"])).alias("back"))
        state = cells.join(new.drop("moved").hint("merge"), ["piece", "block"], "left").join(F.broadcast(kept), "block", "left")
        state = state.withColumn("back", F.coalesce("back", F.array_repeat(F.lit(1.0), F.col("wide"))))  # nothing moved: all dangled
        spent += [flow] if flow is not None else []
        if len(spent) > 1:
            drop(spent.pop(0))
        flow = new
    found = state.select("piece", "block", "high", "wide", "at", "slot", "p", "flow", "back").mapInArrow(partial(_ranks, damping=damping, most=most), "piece int, block int, at int, slot int, rank double")
    return _of_members(found, nodes, columns, members, [x for x in (flow, *spent, links, cells, e) if x is not None])


def _of_members(found: DataFrame, nodes: DataFrame, columns: DataFrame, members: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """(query, id, rank) of the cells (piece, block, at, slot, rank) that were found; what is spent goes."""
    ranks = stage(found.join(nodes, ["piece", "at"]).join(columns, ["block", "slot"]).select("first", "id", "rank"), "ranks")
    for x in spent:
        drop(x)
    return ranks.join(members, "first").select("query", "id", "rank")


def _lanes(spark: SparkSession, n: int) -> DataFrame:
    """(nth, lane): n numbers that a shuffle by lane into n partitions deals to one each."""
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    return stage(spark.range(64 * n).groupBy(at.alias("nth")).agg(F.min("id").cast("int").alias("lane")), "lanes")


def _matrix(row: dict, damping: float) -> np.ndarray:
    """Ranks of a piece's nodes (down) for a block's columns (across): what arrived, and the seeds' share of what went back."""
    r = np.zeros((row["high"], row["wide"]))
    if row["flow"] is not None:
        r += damping * np.frombuffer(row["flow"]).reshape(r.shape)
    if row["at"] is not None:
        back = np.ones(row["wide"]) if row["back"] is None else np.array(row["back"])
        r[row["at"], row["slot"]] += np.array(row["p"]) * back[row["slot"]]
    return r


def _sent(key: tuple, state: pa.Table, links: pa.Table, damping: float) -> pa.Table:
    """What the nodes of a piece send to each piece that their edges lead to."""
    rows = []
    if state.num_rows and links.num_rows:
        r = _matrix(state.to_pylist()[0], damping)
        to = links["to"].to_numpy()
        for piece in np.unique(to) if r.any() else ():
            of = np.flatnonzero(to == piece)
            out = np.zeros((links["to_high"][int(of[0])].as_py(), r.shape[1]))
            for i in of.tolist():
                b, a, w = (links[c][i].values.to_numpy(zero_copy_only=False) for c in "baw")
                for k in range(0, len(b), NEAR):
                    to_, from_ = b[k : k + NEAR], a[k : k + NEAR]
                    first = np.flatnonzero(np.append(True, to_[1:] != to_[:-1]))
                    out[to_[first]] += np.add.reduceat(r[from_] * w[k : k + NEAR, None], first, axis=0)
            rows.append((int(piece), key[1].as_py(), len(out), out.tobytes()))
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ((),) * 4, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["piece", "block", "high", "flow"])


def _walked(cells: pa.Table, links: pa.Table, rounds: int, damping: float, least: float, most: int) -> pa.Table:
    """Ranks after all rounds of the blocks (rows of cells) on a graph of one piece, block by block."""
    out, edges = [_ranked({"piece": 0, "block": 0, "high": 0, "wide": 0}, np.zeros((0, 0)), most)], []
    for i in range(links.num_rows):
        to, from_, w = (links[c][i].values.to_numpy(zero_copy_only=False) for c in "baw")
        edges += [(to[k : k + NEAR], from_[k : k + NEAR], w[k : k + NEAR, None]) for k in range(0, len(to), NEAR)]
    firsts = [np.flatnonzero(np.append(True, to[1:] != to[:-1])) for to, _, _ in edges]
    for i in range(cells.num_rows):
        row = cells.slice(i, 1).to_pylist()[0] | {"flow": None, "back": None}
        p = _matrix(row, damping)
        r = p
        for _ in range(rounds):
            flow = np.zeros(r.shape)
            for (to, from_, w), first in zip(edges, firsts, strict=True):
                flow[to[first]] += np.add.reduceat(r[from_] * w, first, axis=0)
            flow[flow < least] = 0.0
            back = 1 - damping + damping * (1 - flow.sum(axis=0))
            flow *= damping
            r = flow + p * back
        out.append(_ranked(row, r, most))
    return pa.Table.from_batches(out)


def _arrived(key: tuple, sent: pa.Table, least: float) -> pa.Table:
    """The sum of what arrives at a piece's nodes, without what is below `least`, and the sum of each column."""
    total = np.sum([np.frombuffer(x.as_buffer()) for x in sent["flow"]], axis=0).reshape(sent["high"][0].as_py(), -1)
    total[total < least] = 0.0
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "flow": pa.array([total.tobytes()], pa.binary()), "moved": pa.array([total.sum(axis=0).tolist()], pa.list_(pa.float64()))})


def _ranks(batches: Iterator[pa.RecordBatch], damping: float, most: int | None) -> Iterator[pa.RecordBatch]:
    """The ranks of a piece and block that aren't zero, or of each column those that may be among its best `most`."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            whole = _ranked(row, _matrix(row, damping), most)
            yield from (whole.slice(k, 1 << 16) for k in range(0, whole.num_rows, 1 << 16))


def _ranked(row: dict, r: np.ndarray, most: int | None) -> pa.RecordBatch:
    own = r > 0
    if most is not None and most < len(r):
        own &= r >= np.partition(r, len(r) - most, axis=0)[len(r) - most] - 2e-9  # equal ones by nine decimals are told apart by id
    at, slot = np.nonzero(own)
    same = lambda c: pa.array(np.full(len(at), row[c], np.int32))
    return pa.RecordBatch.from_arrays([same("piece"), same("block"), pa.array(at.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(r[at, slot])], ["piece", "block", "at", "slot", "rank"])


#: Best ranks of a query among which others are looked for.
BEST = 50


def ranked_extras(ranks: DataFrame, primary: DataFrame, chunks: DataFrame, k: int = 3, most: int = BEST) -> DataFrame:
    """(query, chunk, file, score): of each query's `most` best ranks the first chunk of each file without a primary hit (query, chunk, file), the best k."""
    best = ranks.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("rank", 9)), "id"))).filter(F.col("r") <= most)
    j = best.withColumnRenamed("id", "chunk").join(chunks.filter(F.col("type").isin("function", "class", "file_overview")).drop("text"), "chunk")
    j = j.join(primary.select("query", "file").distinct(), ["query", "file"], "left_anti")
    j = j.withColumn("g", F.row_number().over(Window.partitionBy("query", "file").orderBy("r"))).filter("g = 1")
    j = j.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("r"))).filter(F.col("place") <= k)
    bonus = rules.chunk_bonus(F.col("type"), F.col("file"), F.col("symbol"), F.col("class"), F.col("start"), F.col("symbol_start"))
    return j.select("query", "chunk", "file", F.round(GRAPH + F.col("rank") * SCALE + bonus, 2).alias("score"))
