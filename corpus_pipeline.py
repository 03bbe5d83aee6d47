"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.llm import langid, mixing, ngram_join, packing, substring
from skeinworks.llm.queries import tokenizer
from skeinworks.plans.stage import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The most ids of dropped documents that are broadcast; beyond, a shuffled join does it.
MOST_DROPPED = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know; those without text or without a letter go."""
    profiles = langid.train(docs.filter(~langid.held_out("doc_id")))
    return langid.identify(docs, profiles).filter(F.col("lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the least doc_id, null last. Rows are told apart by numbers of their own, so repeated and null ids are rows as any other."""
    # A scan numbers its rows alike whenever it runs, so only what comes from a shuffle is written first.
    rows = ngram_join.settled(docs.select(*COLUMNS)).select(F.monotonically_increasing_id().alias("row"), *COLUMNS)
    groups = ngram_join.ngram_jaccard_join(rows.select(F.col("row").alias("doc_id"), "text"), n=5, percent=75)
    groups = stage(groups.select(F.col("doc_id").alias("row"), "component_id"), "groups")
    # A row's group is known by its least row. Only groups of two rows or more have rows to drop.
    several = groups.filter("row <> component_id").select("component_id").distinct()
    linked = stage(groups.join(several, "component_id", "left_semi").join(rows.select("row", "doc_id"), "row"), "linked")
    kept = linked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")).select(F.col("least.row").alias("row"))
    gone = stage(linked.select("row").join(kept, "row", "left_anti"), "dropped")
    few = gone.count() <= MOST_DROPPED
    return rows.join(F.broadcast(gone) if few else gone, "row", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the words that a repeated window of 35 words covers."""
    out = substring.substring_dedup(docs.select(*COLUMNS), window=35)
    touched = F.col("n_removed") > 0
    return out.select("doc_id", F.when(touched, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(touched, F.char_length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to three times, or not at all."""
    out = mixing.mix(docs.select(*COLUMNS), F.array("source"), mixing.word_count("text"))
    return out.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 tokens."""
    return packing.pack(docs, tokenizer(), seq_len=1024, end_id=2)


STAGES = [("language", language), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("mixture", mixture), ("packing", packed)]

#: Similarity components, the sketch and the packing plan have no SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = f(spark, docs, sf_dir)
        if f is not STAGES[-1][1]:
            docs = stage(docs, name.replace(" ", "-"))
    return docs
