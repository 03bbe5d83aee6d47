"""Chat formatting of reply trees with DataFrame functions alone.

Root-to-leaf paths come from self-joins that double their reach: after k joins the pointer of a node is
its 2**k-th ancestor and a leaf's path holds its first 2**k nodes, so a thread of n turns takes log n joins
and rows in proportion to the paths. Branches are ranked by score and each chosen path becomes one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.plans.stage import stage

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column, line: bool = False) -> Column:
    """No control string is left in the text: backslashes are doubled, then `<|` gets one; with line, a line feed too."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("<\\n>")) if line else out


def unescape(c: Column, line: bool = False) -> Column:
    """The inverse of escape: single backslashes stand in its own marks only."""
    c = F.replace(c, F.lit("<\\n>"), F.lit("\n")) if line else c
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, dist) of every root-to-leaf path; dist counts from the leaf.

    nodes: tree, node (a key within the tree), parent (null or unknown: a root). A cycle of parents raises ValueError.
    """
    known = nodes.select("tree", F.col("node").alias("parent")).distinct()
    jump = stage(nodes.select("tree", "node", "parent").join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("up")), "jump-0")
    leaves = nodes.select("tree", "node").join(jump.select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti")
    out = stage(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist")), "paths-0")
    k, most = 0, max(1, nodes.count()).bit_length() + 1
    while jump.head(1):
        if k > most:
            raise ValueError("replies form a cycle")
        further = out.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("dist") + (1 << k)).alias("dist"))
        out = stage(out.unionByName(further), f"paths-{k + 1}")
        above = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("top"))
        jump = stage(jump.join(above, ["tree", "up"]).select("tree", "node", F.col("top").alias("up")), f"jump-{k + 1}")
        k += 1
    return out


def format_trees(messages: DataFrame, branches: int | None = None, trained: str = "assistant") -> DataFrame:
    """One formatted conversation for each of a tree's best branches.

    messages: tree, node, parent (any types that join), role string, text string (nulls: empty), score double
    (null: 0). A branch's score is the sum over its path; ranks run from 1, ties to the smaller leaf; branches: how
    many of a tree are kept (None: all). Returns tree, leaf, branch, score, formatted, and loss: an array of
    (start, length) in characters from 0, the spans of the `trained` role's texts, as escaped. An empty table gives none.
    """
    m = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    m = stage(m, "messages")
    turns = paths(m).join(m.drop("parent"), ["tree", "node"])
    if branches is not None:
        sums = turns.groupBy("tree", "leaf").agg(F.sum("score").alias("s"))
        best = sums.withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("s"), "leaf"))).filter(F.col("r") <= branches)
        turns = turns.join(best.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    body = escape(F.col("text"))
    head = F.concat(F.lit(START), escape(F.col("role"), line=True), F.lit("\n"))
    piece = F.concat(head, body, F.lit(END))
    order = Window.partitionBy("tree", "leaf").orderBy(F.desc("dist"))
    turns = turns.select("tree", "leaf", "dist", "score", "role", piece.alias("piece"), F.char_length(head).alias("h"), F.char_length(body).alias("b"))
    turns = turns.withColumn("at", F.sum(F.char_length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("piece"))
    whole = turns.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("o"), "piece", (F.col("at") + F.col("h")).alias("start"), F.col("b").cast("long").alias("length"), (F.col("role") == trained).alias("on")))).alias("t"))
    loss = F.transform(F.filter("t", lambda x: x["on"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    out = whole.select("tree", "leaf", "score", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), loss.alias("loss"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    return out.withColumn("branch", rank).select("tree", "leaf", "branch", "score", "formatted", "loss")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.split(formatted, r"<\|im_start\|>")

    def turn(p):
        role = F.split_part(p, F.lit("\n"), F.lit(1))
        skip = F.char_length(role) + F.lit(1)
        text = F.substring(p, skip + 1, F.char_length(p) - skip - len(END))
        return F.struct(unescape(role, line=True).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
