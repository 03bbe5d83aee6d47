"""Tables written in the shared folder, used to cut lineage and to read a costly result more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and return the table read back.

    Lost executors don't lose it, and what follows doesn't recompute df.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folder = shared_folder(spark)
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/stage-" in parent and parent.split("/stage-")[0].replace("file://", "").rstrip("/").endswith(folder.replace("file://", "").rstrip("/")):
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Times that rows of ids and scores, which Parquet packs well, are as large in memory as in their files.
HELD = 64.0
FACTOR = "spark.sql.sources.fileCompressionFactor"


def sized_as_held(spark: SparkSession) -> None:
    """Let Spark take tables for as large as they are in memory, so that it broadcasts no table through the driver for its small files alone.

    Where a table turns out small as it is shuffled, adaptive execution broadcasts it still.
    """
    if float(spark.conf.get(FACTOR)) < HELD:
        spark.conf.set(FACTOR, str(HELD))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files below df's scans, from Catalyst's statistics; a default large value when unknown."""
    return int(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / float(df.sparkSession.conf.get(FACTOR)))


def spread(df: DataFrame, small: int = 1 << 28) -> DataFrame:
    """df over all cores where its files are small, as one row group is one task; larger inputs have row groups enough and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if input_bytes(df) < small else df


def pieces(df: DataFrame, size: int = 1 << 22) -> DataFrame:
    """df in partitions of about `size` bytes of its files, at least one to a core, for tasks whose memory follows what a row is blown up to."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // size)))


def parts_for(df: DataFrame, rows: int, per_part: int) -> int:
    """Partitions so that each holds about per_part rows, and at least the session's number."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // per_part))


def blocks(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """df in parts of about `most` rows by a hash of key, so that each can be broadcast however many there are."""
    n = -(-df.count() // most) or 1
    return [df] if n == 1 else [df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def bounded_batches(spark: SparkSession, rows: int = 1024, size: int = 1 << 23) -> None:
    """Let Arrow batches to and from Python hold `rows` rows and about `size` bytes at most, so long texts don't fill memory."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)
