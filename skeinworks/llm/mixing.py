"""Mixing sources to target weights when documents may belong to several sources.

Documents are aggregated by membership pattern (the set of sources they belong to). Token capacity is then
routed from patterns to source quotas by a min-cost flow, in which taking a pattern's documents again costs
more for each repetition, so repetition is spread evenly where sources overlap. What the flow says each
pattern gives is then selected document by document, in a seeded order.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.plans.stage import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of the seeded order at each level: only the rows of the bucket at the edge of a selection are sorted, and they are cut again while they are more than EDGE.
BUCKETS, EDGE = 4096, 100_000
#: The most patterns whose plan is broadcast; beyond, a shuffled join does it.
MOST_BROADCAST = 20_000


def word_count(text: str = "text") -> Column:
    """Maximal runs of characters other than space and \\t-\\r; a null has none."""
    marked = F.translate(F.col(text), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(marked, " +"), lambda x: x != "")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: float = 3.0) -> dict[str | None, float]:
    """The total shared by weight; a share stops at `most` times its source's size, and the excess is reshared among the rest."""
    total = float(sum(sizes.values()))
    out: dict[str | None, float] = {}
    open_ = [s for s in sizes]
    while open_:
        per = (total - sum(out.values())) / sum(weights[s] for s in open_)
        full = [s for s in open_ if per * weights[s] > most * sizes[s]]
        if not full:
            return out | {s: per * weights[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        open_ = [s for s in open_ if s not in out]
    return out


def route(patterns: dict[tuple, int], quota: dict, most: int = 3) -> dict[tuple, int]:
    """Words each pattern gives, by a min-cost flow over each group of patterns that sources connect: no flow crosses groups."""
    root: dict = {}

    def find(s):
        while root.setdefault(s, s) != s:
            root[s] = s = root[root[s]]
        return s

    for p in patterns:
        for s in p[1:]:
            root[find(s)] = find(p[0])
    groups: dict = {}
    for p, n in patterns.items():
        groups.setdefault(find(p[0]), {})[p] = n
    out = {}
    for g in groups.values():
        out |= {p: sum(times) for p, times in flow(g, quota, most).items()}
    return {p: out[p] for p in patterns}


def flow(patterns: dict[tuple, int], quota: dict, most: int = 3) -> dict[tuple, list[int]]:
    """Words each pattern gives the first, second, ... time: a min-cost flow pattern -> source -> sink.

    A pattern offers its size `most` times, the k-th time at cost k per word. Costs lie on a pattern's offers alone, so the
    cheapest flow is reached offer by offer: a maximal flow of the first offers, enlarged by the second ones, and so on,
    which never takes back a cheaper offer. Each is found by blocking flows in layers.
    """
    names = sorted((p for p, n in patterns.items() if n > 0), key=repr)
    sources = sorted({s for p in names for s in p}, key=repr)
    node = {s: len(names) + i for i, s in enumerate(sources)}
    sink, n = len(names) + len(sources), len(names) + len(sources) + 1
    to, cap, arcs = [], [], [[] for _ in range(n)]

    def arc(a, b, c):
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((c, 0))

    for i, p in enumerate(names):
        for s in p:
            arc(i, node[s], most * patterns[p])
    for s in sources:
        arc(node[s], sink, quota[s])
    out: dict[tuple, list[int]] = {p: [0] * most if patterns[p] > 0 else [] for p in patterns}
    for k in range(most):
        left = [patterns[p] for p in names]
        while True:
            level, queue = [-1] * n, deque(i for i, x in enumerate(left) if x)
            for i in queue:
                level[i] = 0
            while queue:
                a = queue.popleft()
                for e in arcs[a]:
                    if cap[e] and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        queue.append(to[e])
            if level[sink] < 0:
                break
            at = [0] * n
            for i in range(len(names)):
                path, a = [], i
                while left[i]:
                    if a == sink:
                        units = min(left[i], *(cap[e] for e in path))
                        left[i] -= units
                        for e in path:
                            cap[e] -= units
                            cap[e ^ 1] += units
                        path, a = [], i
                        continue
                    while at[a] < len(arcs[a]) and not (cap[arcs[a][at[a]]] and level[to[arcs[a][at[a]]]] == level[a] + 1):
                        at[a] += 1
                    if at[a] < len(arcs[a]):
                        path.append(arcs[a][at[a]])
                        a = to[path[-1]]
                    elif path:
                        a = to[path.pop() ^ 1]
                        at[a] += 1
                    else:
                        break
        for p, x in zip(names, left, strict=True):
            out[p][k] = patterns[p] - x
    return out


def mix(docs: DataFrame, sources: Column, size: Column, weight_of=None, most: int = 3, seed: int = 17) -> DataFrame:
    """docs with size, pattern, source_size, target, copies and taken added.

    sources: array<string> of each row, its sources (a null element is a source of its own; a null array is
    [null]; an empty one too). size: long, its words. weight_of: list of sources in code point order, null last
    -> their weights; by default 1, 2, 3 repeating. A source's size is the sum of its rows; targets share the
    sum of all rows, at most `most` times a source's size. taken = copies * size with 0 <= copies <= most, chosen so that
    each pattern gives what the flow routes, within about half a document. source_size and target are those of
    the row's first source. Repeated rows are rows of their own, told apart by a number within equal keys, so
    equal runs give equal results up to which of several identical rows has more copies. Empty: empty.
    """
    names = docs.columns
    held = stage(
        docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__doc"), F.array_sort(F.array_distinct(F.when(F.size(sources) > 0, sources).otherwise(F.array(F.lit(None).cast("string"))))).alias("pattern"), size.alias("size"))
        .withColumn("__h", F.xxhash64(F.lit(seed), "__doc" if "map<" not in docs.schema.simpleString() else F.to_json("__doc"))),
        "sized",
    )
    spark = docs.sparkSession
    # A row to a set of sources, whatever the number of documents.
    patterns = {tuple(r["pattern"]): r["n"] for r in held.groupBy("pattern").agg(F.sum("size").alias("n")).collect()}
    sizes: dict[str | None, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = dict(zip(order, weight_of(order) if weight_of else [1 + i % 3 for i in range(len(order))], strict=True))
    total = sum(patterns.values())
    scale = total / max(1, sum(sizes.values()))
    goal = targets({s: n * scale for s, n in sizes.items()}, weights, most) if scale != 1 else targets(sizes, weights, most)
    gives = route(patterns, {s: round(t) for s, t in goal.items()}, most)
    # The seeded order: whole buckets up to the edge, then the edge's bucket, cut into buckets again or row by row.
    level, edges = [F.pmod(F.shiftrightunsigned("__h", 12 * k), F.lit(BUCKETS)).cast("int") for k in range(5)], {}
    plan = [(list(p), sizes[p[0]], float(goal[p[0]]), min(most, g // n) if n else 0, (g - min(most, g // n) * n) if n else 0) for p, g in gives.items() for n in [patterns[p]]]
    small = len(plan) <= MOST_BROADCAST
    path = "array<int>"  # the edge's bucket at each level

    def planned(edges: dict) -> DataFrame:
        rows = [(*x, *edges.get(tuple(x[0]), ([], 0))) for x in plan]
        out = spark.createDataFrame(rows, f"pattern array<string>, source_size long, target double, passes long, rest long, edge {path}, start long")
        return F.broadcast(out) if small else out

    for k in range(len(level)):
        on = held.join(planned(edges).select("pattern", "rest", "edge", "start"), "pattern").filter(F.size("edge") == k)
        for j in range(k):
            on = on.filter(level[j] == F.get("edge", F.lit(j)))
        sums = on.groupBy("pattern", level[k].alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.first("rest").alias("rest"), F.first("edge").alias("edge"), F.first("start").alias("start"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = sums.withColumn("start", F.col("start") + before).filter("start <= rest AND start + n > rest").collect()  # a row to a pattern at most
        edges |= {tuple(r["pattern"]): ([*r["edge"], r["bucket"]], r["start"]) for r in found}
        if max((r["rows"] for r in found), default=0) <= EDGE:
            break
    row = held.join(planned(edges), "pattern")
    side = F.lit(0)  # below the edge, on it, or above
    for k in reversed(range(len(level))):
        at = F.get("edge", F.lit(k))
        side = F.when(at.isNull(), side if k else F.lit(1)).when(level[k] < at, -1).when(level[k] > at, 1).otherwise(side)
    row = row.withColumn("__side", side)
    whole = row.filter("__side <> 0").withColumn("more", (F.col("__side") < 0).cast("long"))
    inner = Window.partitionBy("pattern").orderBy("__h", F.col("size")).rowsBetween(Window.unboundedPreceding, -1)
    cut = row.filter("__side = 0").withColumn("ahead", F.col("start") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    cut = cut.withColumn("more", (F.col("ahead") + F.col("size") / 2 <= F.col("rest")).cast("long")).drop("ahead")
    out = whole.unionByName(cut).withColumn("copies", F.least(F.col("passes") + F.col("more"), F.lit(most)))
    keep = [c for c in names if c not in ("size", "pattern", "source_size", "target", "copies", "taken")]
    return out.select(*(F.col(f"__doc.`{c}`").alias(c) for c in keep), "size", "pattern", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
