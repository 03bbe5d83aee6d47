"""Tables that runs leave behind: manifests with their checks, snapshots by revision, logs and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinworks.sources.tree import opened


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def snapshot(files: DataFrame, root: str, revision: str) -> str:
    """Write files as Parquet below root/rev=<revision> once; an earlier complete snapshot of the revision stays."""
    path = f"{root.rstrip('/')}/rev={revision}"
    if not exists(files.sparkSession, path + "/_SUCCESS"):
        files.write.mode("overwrite").parquet(path)
    return path


def manifest(files: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: numbers of files, lines, chunks and symbols."""
    f = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("n_lines"))
    one = f.join(F.broadcast(chunks.agg(F.count("*").alias("n_chunks"))))  # rows of one aggregate each
    return one.join(F.broadcast(symbols.agg(F.count("*").alias("n_symbols"))))


def problems(stated: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (problem, stated, counted): a manifest whose number of chunks isn't that of the chunk table; symbols are not compared."""
    n = chunks.agg(F.count("*").alias("counted"))
    return stated.select(F.col("n_chunks").alias("stated")).join(F.broadcast(n)).filter("stated IS DISTINCT FROM counted").select(F.lit("chunk count").alias("problem"), "stated", "counted")


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)


def recent(spark: SparkSession, path: str, schema: str, time: str, n: int) -> DataFrame:
    """The n newest rows of a log; none if there is no log. Lines that don't parse are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc(time)).limit(n)


def sync_history(log: DataFrame, time: str = "time_utc", count: str = "file_count") -> DataFrame:
    """The log of synchronisations with each one's change of files against the one before (null for the first); a row to a run."""
    return log.withColumn("delta_files", F.col(count) - F.lag(count).over(Window.orderBy(time)))


def revision(root: str) -> str | None:
    """The commit that a working folder is at, from the files that git keeps in it; None without them. Branches may be loose or packed, and `.git` a file that names another folder."""
    fs, path = opened(root)

    def read(name: str) -> str | None:
        if fs.get_file_info(name).type.name != "File":
            return None
        with fs.open_input_stream(name) as f:
            return f.read().decode("utf-8", "replace").strip()

    folder = f"{path}/.git"
    told = read(folder)
    if told and told.startswith("gitdir:"):
        named = told.removeprefix("gitdir:").strip()
        folder = named if named.startswith("/") else f"{path}/{named}"
    head = read(f"{folder}/HEAD")
    if not head or not head.startswith("ref:"):
        return head or None
    ref = head.removeprefix("ref:").strip()
    if sha := read(f"{folder}/{ref}"):
        return sha
    packed = (line.split(" ", 1) for line in (read(f"{folder}/packed-refs") or "").splitlines() if line[:1] not in ("#", "^"))
    return next((sha for sha, name in packed if name == ref), None)
