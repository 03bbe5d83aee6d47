"""A vector store addressed by content: texts for a model, their fingerprints, what is missing, and a model's calls for just that."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.plans.stage import bounded_batches, stage

#: Texts that one call of a model gets.
CALL = 32


def embed_text(file: Column, owner: Column, symbol: Column, kind: Column, text: Column) -> Column:
    """What a model reads of a chunk: its file, class, symbol and type, an empty line, its text; nulls are empty."""
    named = (("file", file), ("class", owner), ("symbol", symbol), ("type", kind))
    head = [F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")), F.lit("\n")) for name, c in named]
    return F.concat(*head, F.lit("\n"), F.coalesce(text, F.lit("")))


def fingerprints(chunks: DataFrame, model: str) -> DataFrame:
    """(chunk, text, fingerprint) of chunks (chunk, file, type, symbol, class, text): a digest of the model's name and the text that it reads, with line ends made one."""
    t = F.replace(embed_text(F.col("file"), F.col("class"), F.col("symbol"), F.col("type"), F.col("text")), F.lit("\r\n"), F.lit("\n"))
    return chunks.select("chunk", t.alias("text")).withColumn("fingerprint", F.sha2(F.concat(F.lit(model), F.lit("\n"), "text"), 256))


def embedded(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], call: int = CALL) -> DataFrame:
    """(fingerprint, vector array<float>) of texts (fingerprint, text), scaled to length one; `model` gets up to `call` texts at once, in the workers."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for p in batches:
            for at in range(0, len(p), call):
                part = p.iloc[at : at + call]
                v = np.asarray(model(part["text"].tolist()), np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"fingerprint": part["fingerprint"].to_numpy(), "vector": list(v.astype(np.float32))})

    return texts.select("fingerprint", "text").mapInPandas(run, "fingerprint string, vector array<float>")


def refresh(store: DataFrame | None, chunks: DataFrame, name: str, model: Callable[[list[str]], list[list[float]]]) -> tuple[DataFrame, DataFrame]:
    """(the store after, how much was done) for a store (fingerprint, vector) of any earlier chunks, or None.

    Each text that the store lacks is embedded once, however many chunks have it; vectors that no chunk needs are left out. Done: one
    row with chunks, texts (different ones), kept, embedded, removed.
    """
    f = stage(fingerprints(chunks, name), "fingerprints")
    texts = f.groupBy("fingerprint").agg(F.first("text").alias("text"))
    if store is None:
        store = f.sparkSession.createDataFrame([], "fingerprint string, vector array<float>")
    kept = store.join(texts.select("fingerprint"), "fingerprint", "left_semi")
    new = stage(embedded(texts.join(store.select("fingerprint"), "fingerprint", "left_anti"), model), "embedded")
    after = stage(kept.unionByName(new), "vectors")
    one = lambda d, c: d.agg(F.count("*").alias(c))
    done = f.agg(F.count("*").alias("chunks"), F.countDistinct("fingerprint").alias("texts")).join(F.broadcast(one(new, "embedded"))).join(F.broadcast(one(store, "was")))
    done = done.select("chunks", "texts", (F.col("texts") - F.col("embedded")).alias("kept"), "embedded", (F.col("was") - F.col("texts") + F.col("embedded")).alias("removed"))
    return after, done


def vectors_of(chunks: DataFrame, store: DataFrame, name: str) -> DataFrame:
    """(chunk, vector) of chunks whose text the store has."""
    return fingerprints(chunks, name).select("chunk", "fingerprint").join(store, "fingerprint").select("chunk", "vector")


def stale(chunks: DataFrame, store: DataFrame, name: str) -> DataFrame:
    """(chunk) of chunks whose text the store lacks; none means that it is up to date."""
    return fingerprints(chunks, name).join(store.select("fingerprint"), "fingerprint", "left_anti").select("chunk")
