"""An index kept up to date: change sets of two manifests, and tables of which only changed files are built anew.

Every function reads what a change can reach and leaves the rest as it is; the tables after it equal those of a full rebuild.
Tables are keyed by `file`. Edges join two files by a name, so a change of one file can make or break edges of untouched ones;
they are found by the names concerned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A name that more chunks than this mention says nothing.
MOST = 30


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, was, change) of the files that differ between manifests (file, digest): 'added', 'deleted', 'changed', or 'moved' from `was`.

    A deleted and an added file of one digest are a move; several of one digest pair off in order of their paths.
    Files of equal digest don't appear; null digests are never equal. A file stands once in a manifest.
    """
    both = old.select("file", F.col("digest").alias("a"), F.lit(True).alias("in_old")).join(new.select("file", F.col("digest").alias("b"), F.lit(True).alias("in_new")), "file", "full")
    both = both.filter("in_old IS NULL OR in_new IS NULL OR a IS NULL OR b IS NULL OR a <> b")
    nth = lambda digest: F.row_number().over(Window.partitionBy(digest).orderBy("file"))
    gone = both.filter("in_new IS NULL").select("file", F.col("a").alias("digest")).withColumn("nth", nth("digest"))
    come = both.filter("in_old IS NULL").select("file", F.col("b").alias("digest")).withColumn("nth", nth("digest"))
    pairs = come.join(gone.select("digest", "nth", F.col("file").alias("was")), ["digest", "nth"])
    kept = both.filter("in_old AND in_new").select("file", F.lit(None).cast("string").alias("was"), F.lit("changed").alias("change"))
    moved = pairs.select("file", "was", F.lit("moved").alias("change"))
    added = come.join(pairs.select("file"), "file", "left_anti").select("file", F.lit(None).cast("string").alias("was"), F.lit("added").alias("change"))
    deleted = gone.join(pairs.select(F.col("was").alias("file")), "file", "left_anti").select("file", F.lit(None).cast("string").alias("was"), F.lit("deleted").alias("change"))
    return kept.unionByName(moved).unionByName(added).unionByName(deleted)


def touched(changed: DataFrame) -> DataFrame:
    """(file) of every path that a change takes rows from or gives rows to."""
    return changed.select("file").unionByName(changed.filter("was IS NOT NULL").select(F.col("was").alias("file"))).distinct()


def present(changed: DataFrame) -> DataFrame:
    """(file) of the paths whose rows are to be built: all but deleted ones."""
    return changed.filter("change <> 'deleted'").select("file")


def replaced(table: DataFrame, paths: DataFrame, fresh: DataFrame) -> DataFrame:
    """table without the rows of the touched paths, with fresh rows."""
    return table.join(paths, "file", "left_anti").unionByName(fresh)


def counts_after(counts: DataFrame, gone: DataFrame, come: DataFrame, key: str) -> DataFrame:
    """(key, n): counts less one for each row gone, more one for each come; only touched keys are summed, and keys at zero go."""
    step = gone.select(key, F.lit(-1).alias("d")).unionByName(come.select(key, F.lit(1).alias("d"))).groupBy(key).agg(F.sum("d").alias("d"))
    return counts.join(step, key, "full").select(key, (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n")).filter("n > 0")


def edges(mentions: DataFrame, targets: DataFrame, counts: DataFrame, most: int = MOST) -> DataFrame:
    """(src, dst, name, file): edges from chunks that mention a name to the chunks of other files that define it; file is the source's.

    mentions, targets: (file, chunk, name), each row once; counts: (name, n) of mentions. Names of over `most` mentions give none.
    """
    quiet = counts.filter(F.col("n") <= most).select("name")
    # Targets are far fewer than mentions, so they are told apart first.
    t = targets.join(quiet, "name", "left_semi").select("name", F.col("chunk").alias("dst"), F.col("file").alias("__to"))
    return mentions.join(t, "name").filter("file <> __to").select(F.col("chunk").alias("src"), "dst", "name", "file")


def edges_after(old: DataFrame, paths: DataFrame, mentions: tuple[DataFrame, DataFrame], targets: tuple[DataFrame, DataFrame], counts: tuple[DataFrame, DataFrame], most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(edges after the change, those of them that were made anew); pairs hold tables before and after, `old` the edges before.

    Made anew: edges from touched files, and edges by names that a touched file defined or defines, or whose count crossed `most`.
    """
    defined = targets[0].join(paths, "file", "left_semi").select("name").unionByName(targets[1].join(paths, "file", "left_semi").select("name"))
    spoken = mentions[0].join(paths, "file", "left_semi").select("name").unionByName(mentions[1].join(paths, "file", "left_semi").select("name")).distinct()
    noisy = lambda c: F.coalesce(F.col(c), F.lit(0)) > most
    now = spoken.join(counts[0].withColumnRenamed("n", "a"), "name", "left").join(counts[1].withColumnRenamed("n", "b"), "name", "left")
    names = defined.unionByName(now.filter(noisy("a") != noisy("b")).select("name")).distinct()
    again = mentions[1].join(paths, "file", "left_semi").unionByName(mentions[1].join(paths, "file", "left_anti").join(names, "name", "left_semi"))
    fresh = edges(again, targets[1], counts[1], most)
    kept = old.join(paths, "file", "left_anti").join(names, "name", "left_anti").select("src", "dst", "name", "file")
    return kept.unionByName(fresh), fresh
