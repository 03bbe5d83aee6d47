"""Exact top-k inner products by the no-random-access algorithm, on integer vectors.

For a query each dimension has a list of the vectors sorted by their contribution q_d * x_d. All lists are read from their tops
down, from depth to depth, and never elsewhere. What a list hasn't shown of a vector is bounded by the list's last contribution
read; all of it together by the product of the norms of the unread parts of query and vector, if that is less (entries carry
their vector's norm). Lower bounds take that product away. Reading stops, for each query by itself, when no more than k
vectors have an upper bound that reaches the k-th best lower bound, or a score that k vectors of an earlier segment are
known to have; only then are the scores of those k resolved. Where bounds don't part, lists are read to their ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.plans.stage import stage

#: Depths of the lists, as shares, at which bounds are compared; rows of a segment and of the first one, queries of a block, and bytes of rows that a task holds.
DEPTHS = (0.1, 0.5, 0.9, 0.95)
SEGMENT, FIRST, QUERIES, STRIP_BYTES = 8192, 512, 1024, 1 << 27


def _number(x: np.ndarray, top: int) -> np.ndarray:
    """A type in which sums of products are exact."""
    return x.astype(np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64)


def nra(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row position, score) of every row that may be among a query's k best of x, exact, its own id left out; and how many list entries each query read, those of the rows resolved at its end too.

    floor: for each query a score that k rows elsewhere are known to reach. All open queries read on together: which entries
    of a list lie between two depths depends on the sign of q_d alone, so what they add is a product of matrices.
    """
    n, dim = x.shape
    read, found = np.zeros(len(q), np.int64), [(np.empty(0, np.int64),) * 3]
    if n == 0 or len(q) == 0:
        return *found[0], read
    top = int(np.abs(q).max(initial=1)) * int(np.abs(x).max(initial=1)) * max(1, dim)
    xn, q = _number(x, top), q.astype(np.int64)
    signed = _number(np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], 1), top)
    side = np.concatenate([q > 0, q < 0], 1).astype(np.float32)
    length = side.sum(axis=1).astype(np.int64)  # lists that a query reads
    asc = np.sort(xn, axis=0)
    least = np.full(len(q), -np.inf) if floor is None else floor.astype(np.float64)
    order = np.argsort(ids, kind="stable")
    place = np.minimum(np.searchsorted(ids[order], q_ids), n - 1)
    own = np.where(ids[order[place]] == q_ids, order[place], -1)
    open_, seen, had = np.arange(len(q)), np.zeros((len(q), n), xn.dtype), np.zeros((n, 2 * dim), bool)
    both = np.concatenate([xn, xn], 1)
    for depth in DEPTHS if n > 4 * k else ():
        r = max(1, int(depth * n))
        last = np.concatenate([asc[n - r], asc[r - 1]])  # the last values read of the falling and of the rising lists
        got = np.concatenate([xn >= last[:dim], xn <= last[dim:]], 1)
        s = signed[open_]
        seen = seen + s @ np.where(got & ~had, both, 0).T
        had = got
        rest = s @ np.where(got, 0, last).T
        unread = np.where(got, 0, both).astype(np.float32) ** 2
        reach = np.sqrt((s.astype(np.float32) ** 2) @ (~got).T.astype(np.float32) * (side[open_] @ unread.T).astype(np.float64)) * (1 + 1e-4) + 1e-3
        lower, upper = seen - reach, seen + np.minimum(rest, reach)
        mine = own[open_]
        has = np.flatnonzero(mine >= 0)
        lower[has, mine[has]] = upper[has, mine[has]] = -np.inf
        least[open_] = np.maximum(least[open_], np.partition(lower, n - k, axis=1)[:, n - k])
        alive = upper >= least[open_][:, None]
        done = alive.sum(axis=1) <= k
        a, b = np.nonzero(alive[done])
        a = open_[done][a]
        found.append((a, b, np.einsum("ij,ij->i", q[a], x[b].astype(np.int64))))
        read[open_[done]] = r * length[open_[done]] + np.bincount(a, length[a] - r * length[a] // n, len(q)).astype(np.int64)[open_[done]]
        open_, seen = open_[~done], seen[~done]
        if len(open_) == 0:
            break
    if len(open_):  # the lists' ends are read: the bounds are the score
        read[open_] = n * length[open_]
        score = seen + signed[open_] @ np.where(had, 0, both).T
        alive = score >= least[open_][:, None]
        has = np.flatnonzero(own[open_] >= 0)
        alive[has, own[open_][has]] = False
        if n > k + 1:
            alive &= score >= np.partition(score, n - k - 1, axis=1)[:, n - k - 1][:, None]
        a, b = np.nonzero(alive)
        found.append((open_[a], b, score[a, b].astype(np.int64)))
    return *(np.concatenate(p) for p in zip(*found, strict=True)), read


def best(qp: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, ties to the smaller id."""
    order = np.lexsort((ids, -score, qp))
    q = qp[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


def quantized(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors null or with a null or non-finite component, and null ids, left out. Of rows with one id, the least vector."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    return rows.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).filter(fine).groupBy(F.col(vec_id).cast("long").alias("vec_id")).agg(F.min(v).alias("v"))


def top_k(rows: DataFrame, is_query, k: int = 20, vector: str = "embedding", vec_id: str = "vec_id", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows by integer inner product, ties to the smaller vec_id.

    rows: vec_id long, a key (of repeated ids the least vector counts, once), embedding array of numbers; other
    columns are ignored. is_query(column): which ids are queries. Vectors of unequal length are filled up with zeros.
    Fewer than k others: all. Empty: empty. Queries meet all rows in blocks: blocks of up to 1,024 queries, segments
    of up to 8,192 rows; a task answers a query block over its segments and sends on k rows a query.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found(rows, is_query, k, vector, vec_id, scale).filter("vec_id IS NOT NULL").withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def read_share(rows: DataFrame, is_query, k: int = 20, vector: str = "embedding", vec_id: str = "vec_id", scale: int = 64) -> DataFrame:
    """(query_id, share): what share of all list entries the search reads for each query."""
    reads = found(rows, is_query, k, vector, vec_id, scale).filter("vec_id IS NULL")
    return reads.groupBy("query_id").agg((F.sum("score") / F.sum("entries")).alias("share"))


def found(rows: DataFrame, is_query, k: int, vector: str, vec_id: str, scale: int) -> DataFrame:
    """(query_id, vec_id, score, entries): the best of each task, and for each query and task a row without vec_id: entries read as the score, of how many."""
    v = stage(quantized(rows, vector, vec_id, scale), "vectors")
    queries = v.filter(is_query(F.col("vec_id")))
    n_rows, n_queries, dim = v.count(), queries.count(), v.agg(F.max(F.size("v"))).first()[0] or 0
    spark = rows.sparkSession
    blocks = max(1, -(-n_queries // QUERIES))
    strips = max(1, min(-(-n_rows // SEGMENT), max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)))
    # A strip is the rows that one task meets with one query block; strips grow in number with the rows.
    strips = max(strips, -(-n_rows * dim * 8 // STRIP_BYTES))

    def pack(batches):
        """One row to a batch: ids and matrix as bytes."""
        for pdf in batches:
            for g, part in pdf.groupby("g", sort=True):
                m = np.zeros((len(part), dim), np.int64)
                for i, row in enumerate(part["v"]):
                    m[i, : len(row)] = row
                yield pd.DataFrame({"g": [g], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "m": [_small(m).tobytes()], "size": [_small(m).itemsize]})

    packed = "g int, ids binary, m binary, size int"
    q = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("g"), "vec_id", "v").repartition(blocks, "g").sortWithinPartitions("g").mapInPandas(pack, packed)
    x = v.select(F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(strips)).cast("int").alias("g"), "vec_id", "v").repartition(strips, "g").sortWithinPartitions("g").mapInPandas(pack, packed)
    both = q.select(F.col("g").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"), F.lit(0).alias("kind"), "ids", "m", "size").unionByName(
        x.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("g").alias("strip"), F.lit(1).alias("kind"), "ids", "m", "size")
    )
    tasks = blocks * strips

    def search(batches):
        held: dict[tuple, dict] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                m = np.frombuffer(r.m, f"i{r.size}").reshape(-1, dim)
                held.setdefault((r.block, r.strip), {0: [], 1: []})[r.kind].append((np.frombuffer(r.ids, np.int64), m))
        for kinds in held.values():
            if not kinds[0] or not kinds[1]:
                continue
            q_ids, q = (np.concatenate(p) for p in zip(*kinds[0], strict=True))
            x_ids, x = (np.concatenate(p) for p in zip(*kinds[1], strict=True))
            order = np.argsort(x_ids, kind="stable")
            x_ids, x = x_ids[order], x[order]
            at, got, score = (np.empty(0, np.int64),) * 3
            read = np.zeros(len(q), np.int64)
            for a, z in segments(len(x)):
                floor = np.full(len(q), -np.inf)
                if len(at):
                    last = np.flatnonzero(np.append(at[1:] != at[:-1], True))
                    full = np.bincount(at, minlength=len(q))[at[last]] >= k
                    floor[at[last[full]]] = score[last[full]]
                b, c, s, r = nra(q, q_ids, x[a:z], x_ids[a:z], k, floor)
                read += r
                at, got, score = np.concatenate([at, b]), np.concatenate([got, x_ids[a:][c]]), np.concatenate([score, s])
                keep = best(at, got, score, k)
                at, got, score = at[keep], got[keep], score[keep]
            yield pd.DataFrame({"query_id": q_ids[at], "vec_id": pd.array(got, "Int64"), "score": score, "entries": np.zeros(len(at), np.int64)})
            yield pd.DataFrame({"query_id": q_ids, "vec_id": pd.array([None] * len(q), "Int64"), "score": read, "entries": len(x) * (q != 0).sum(axis=1)})

    return both.withColumn("task", F.col("block") * strips + F.col("strip")).repartitionById(tasks, F.col("task")).select("block", "strip", "kind", "ids", "m", "size").mapInPandas(search, "query_id long, vec_id long, score long, entries long")


def segments(n: int) -> list[tuple[int, int]]:
    """Bounds of the segments of n rows; the first, which only sets the floor for the rest, is small."""
    cut = [0, *range(min(FIRST, n), n, SEGMENT), n]
    return [(a, b) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def _small(m: np.ndarray) -> np.ndarray:
    top = int(np.abs(m).max(initial=0))
    return m.astype(np.int8 if top < 128 else np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)
