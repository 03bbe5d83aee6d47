"""File trees, tag files, line counts and chunk files as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from skeinworks.functions.text import line_count
from skeinworks.plans.stage import bounded_batches
from skeinworks.sources import tree

# Suffixes of source files, folders that scans skip, kinds of symbols that tag files keep.
SOURCE = [".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx"]
SKIP = [".git", ".svn", ".hg", ".vs", ".vscode", "build", "cmake-build-debug", "cmake-build-release", "out", "dist", "node_modules", "__pycache__"]
KINDS = ["function", "prototype", "class", "struct", "macro", "enum", "typedef"]

CHUNK = "id string, type string, file string, start_line int, end_line int, symbol string, kind string, class string, text string, symbol_start int, sub_idx int"


def _suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def _read(spark: SparkSession, root: str, skip: list[str], wanted: Column) -> DataFrame:
    """(path, size_bytes, top_dir, content) of the wanted files below root; only theirs are read."""
    kept = tree.listed(spark, root, list(skip)).filter(wanted)
    top = F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise(".")
    return tree.contents(kept, root).filter("content IS NOT NULL").select("path", "size_bytes", top.alias("top_dir"), "content")


def scan(spark: SparkSession, root: str, suffixes: list[str], skip: list[str] = ()) -> DataFrame:
    """(path, size_bytes, lines, top_dir, text) of the files below root whose suffix (case-sensitive) is listed and that have no part of their path in skip.

    Paths are relative to root; malformed UTF-8 is replaced; top_dir is '.' for files in root itself.
    """
    kept = _read(spark, root, skip, _suffix(F.col("path")).isin(*suffixes))
    kept = kept.withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))
    return kept.select("path", "size_bytes", line_count(F.col("text")).alias("lines"), "top_dir", "text")


@F.pandas_udf(BooleanType())
def _is_gb18030(data: pd.Series) -> pd.Series:
    def fits(b):
        try:
            b.decode("gb18030")
        except UnicodeDecodeError:
            return False
        return True

    return data.map(fits, na_action="ignore").astype("boolean")


def encoding(data: Column) -> Column:
    """'empty', 'binary' (a zero among the first 4096 bytes), 'utf-8', 'gb18030' or 'latin-1'. Only bytes that are none of the first three reach Python."""
    zero = F.exists(F.regexp_extract_all(F.hex(F.substring(data, 1, 4096)), F.lit("(..)"), 1), lambda h: h == "00")
    plain = F.when(F.octet_length(data) == 0, "empty").when(zero, "binary").when(F.is_valid_utf8(data.cast("string")), "utf-8")
    rest = _is_gb18030(F.when(plain.isNull(), data))
    return F.coalesce(plain, F.when(rest, "gb18030").otherwise("latin-1"))


def probe(spark: SparkSession, root: str, suffixes: list[str], skip: list[str] = SKIP) -> DataFrame:
    """(path, size_bytes, top_dir, encoding, digest) of files whose lower-cased suffix is listed; digest is the first 16 hex digits of the content's SHA-256."""
    bounded_batches(spark)
    kept = _read(spark, root, skip, F.lower(_suffix(F.col("path"))).isin(*suffixes))
    return kept.select("path", "size_bytes", "top_dir", encoding(F.col("content")).alias("encoding"), F.substring(F.sha2("content", 256), 1, 16).alias("digest"))


def tags(spark: SparkSession, path: str, kinds: list[str] = KINDS) -> DataFrame:
    """(file, name, kind, line, end_line, class) of a tags program's JSON lines; lines that don't parse and other kinds are skipped."""
    raw = spark.read.schema("_type string, name string, path string, kind string, line long, end long, scope string, scopeKind string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    kept = raw.filter((F.col("_type") == "tag") & F.col("kind").isin(*kinds))
    owner = F.when(F.col("scopeKind").isin("class", "struct"), F.col("scope")).otherwise("")
    return kept.select(F.col("path").alias("file"), "name", "kind", "line", F.col("end").alias("end_line"), owner.alias("class"))


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(language, filename, blank, comment, code) of a line counter's CSV by file; rows without a file name, such as sums, are dropped."""
    raw = spark.read.option("header", True).csv(path)
    return raw.filter("filename IS NOT NULL AND filename <> ''").select("language", "filename", *(F.expr(f"try_cast({c} AS BIGINT)").alias(c) for c in ("blank", "comment", "code")))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """A chunk file, JSON lines, by a fixed schema."""
    return spark.read.schema(CHUNK).json(path).filter("id IS NOT NULL")


@F.pandas_udf(StringType())
def _decoded(data: pd.Series, codec: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else b.decode(c, errors="replace") for b, c in zip(data, codec, strict=True)], dtype=object)


def preview(data: Column, kind: Column) -> Column:
    """Text of bytes by the class that `encoding` gave: '' for binary ones, malformed parts replaced. Only what isn't UTF-8 reaches Python."""
    plain = F.when(kind.isin("binary", "empty") | data.isNull(), "").when(kind == "utf-8", F.make_valid_utf8(data.cast("string")))
    return F.coalesce(plain, _decoded(F.when(plain.isNull(), data), F.coalesce(kind, F.lit("utf-8"))))


def template(spark: SparkSession, path: str) -> str:
    """A prompt's template, whole."""
    return spark.read.text(path, wholetext=True).first()[0]
