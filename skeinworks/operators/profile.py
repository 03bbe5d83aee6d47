"""Summary of a probed file tree: risk, estimates, and lists of the largest; code that others wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lines of a long file, the length of lists, levels of risk, lines a second that are read and tagged, megabytes of chunks a line.
LONG, LISTED, LEVELS = 3000, 20, ("低", "中", "高")
READ_RATE, TAG_RATE, CHUNK_MB = 800_000.0, 33_000.0, 14.0 / 800_617.0
# Names of folders with other people's code, of folders that may hold some, and of the files that say so.
VENDORED = ["third_party", "thirdparty", "vendor", "external", "extern", "deps", "dependency", "dependencies", "mbed"]
LIBRARY = ["lib", "libs", "library", "libraries"]
LICENSE = ["license", "license.txt", "license.md", "copying", "copying.txt", "notice", "notice.txt"]
README = ["readme", "readme.md", "readme.txt", "readme.rst"]
#: The least share of all lines that makes a folder at the top worth a look.
SHARE = 0.05


def steps(value: Column, two: Column, one: Column) -> Column:
    return F.when(value > two, 2).when(value > one, 1).otherwise(0)


def risk(records: DataFrame, by: list[str], long: int = LONG) -> DataFrame:
    """A row to a group of records (lines, encoding, binary, generated, tagged): what was found, points and level of risk, estimates, and advice by name."""
    s = records.groupBy(*by).agg(
        F.count("*").alias("n_files"), F.sum("lines").alias("n_lines"), F.count_if(F.col("lines") > long).alias("long"), F.count_if(~F.col("encoding").isin("utf-8", "empty")).alias("odd"),
        F.count_if(~F.col("tagged")).alias("untagged"), F.count_if("binary").alias("binaries"), F.count_if("generated").alias("generated"),
    )
    failed, n, none = F.col("untagged") / F.col("n_files"), F.col("n_files"), F.lit(0)
    odd = steps(F.col("odd"), F.greatest(F.lit(5.0), n * 0.05), none)
    s = s.withColumn("points", steps(F.col("long"), F.lit(5), none) + odd + steps(failed, F.lit(0.15), F.lit(0.05)) + F.when(F.col("binaries") > 0, 1).otherwise(0))
    low, mid, high = LEVELS
    level = F.when(F.col("points") >= 4, high).when(F.col("points") >= 2, mid).otherwise(low)
    advice = F.array_compact(F.array(F.when(F.col("long") > 0, "long"), F.when(F.col("odd") > 0, "encoding"), F.when(failed > 0.05, "tags"), F.when(F.col("generated") > 0, "generated")))
    return s.select(
        "*", level.alias("level"), F.round(failed, 4).alias("failed"), F.round(F.col("n_lines") / n, 1).alias("mean_lines"), F.round(F.col("n_lines") / READ_RATE, 2).alias("read_seconds"),
        F.round(F.col("n_lines") / TAG_RATE, 2).alias("tag_seconds"), F.round(F.col("n_lines") * CHUNK_MB, 1).alias("chunk_mb"), F.when(F.size(advice) == 0, F.array(F.lit("none"))).otherwise(advice).alias("advice"),
    )


def largest(records: DataFrame, by: list[str], size: str, key: str, k: int = LISTED) -> DataFrame:
    """The k largest records of each group, by size and then key; adds place."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(size), key))
    return records.withColumn("place", place).filter(F.col("place") <= k)


def folders(files: DataFrame, deepest: int = 5) -> DataFrame:
    """(folder, depth, lines, n_files) of the folders at the first `deepest` levels; files has (path, lines). A path itself counts as its last level."""
    parts = F.split("path", "/")
    level = F.explode(F.sequence(F.lit(1), F.least(F.lit(deepest), F.size("parts")))).alias("depth")
    each = files.select(parts.alias("parts"), "lines").select("parts", "lines", level)
    return each.groupBy(F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("folder"), "depth").agg(F.sum("lines").alias("lines"), F.count("*").alias("n_files"))


def vendored(files: DataFrame, signatures: DataFrame, own: str = "src") -> DataFrame:
    """(folder, lines, why): folders that others' code fills; files has (path, lines), signatures (top, signature).

    By the name of a folder on its path; a library folder that holds a licence; a folder at the top, other than `own`, with a
    twentieth of all lines or more, that holds a licence or readme, or none of whose copyright lines `own` has.
    """
    f = folders(files)
    parts = F.split(F.lower("folder"), "/")
    base, parent = F.lower(F.substring_index("path", "/", -1)), F.regexp_replace("path", "/?[^/]*$", "")
    papers = files.select(parent.alias("folder"), base.isin(*LICENSE).alias("license"), base.isin(*README).alias("readme")).groupBy("folder").agg(F.bool_or("license").alias("license"), F.bool_or("readme").alias("readme"))
    total = f.filter("depth = 1").agg(F.sum("lines").alias("total"))  # one row
    of_own = signatures.filter(F.col("top") == own).select("signature").distinct()
    signed = signatures.filter(F.col("top") != own).select("top", "signature").distinct()
    shared = signed.join(of_own, "signature", "left_semi").select("top").distinct()
    foreign = signed.select("top").distinct().join(shared, "top", "left_anti").select(F.col("top").alias("folder"), F.lit(True).alias("foreign"))
    met = f.join(papers, "folder", "left").join(foreign, "folder", "left").join(F.broadcast(total))
    big = (F.col("depth") == 1) & (F.col("folder") != own) & (F.col("lines") >= SHARE * F.col("total"))
    why = (
        F.when(F.arrays_overlap(parts, F.array(*(F.lit(x) for x in VENDORED))), "name")
        .when(F.arrays_overlap(parts, F.array(*(F.lit(x) for x in LIBRARY))) & F.coalesce("license", F.lit(False)), "library")
        .when(big & F.coalesce(F.col("license") | F.col("readme"), F.lit(False)), "papers")
        .when(big & F.coalesce("foreign", F.lit(False)), "signature")
    )
    return met.select("folder", "lines", why.alias("why")).filter("why IS NOT NULL")


# Languages by suffix, suffixes and markers of generated files, and how many lines are searched for them.
LANGUAGES = {
    ".c": "C/C++ Header", ".cc": "C++", ".cpp": "C++", ".cxx": "C++", ".h": "C/C++ Header", ".hh": "C/C++ Header", ".hpp": "C/C++ Header", ".hxx": "C/C++ Header",
    ".rc": "Resource", ".idl": "IDL", ".inl": "Inline", ".def": "Def", ".asm": "Asm", ".s": "Asm",
}
GENERATED_SUFFIX, GENERATED_LINES = [".rc"], 40
GENERATED_MARKERS = ["generated", "auto-generated", "autogenerated", "do not edit", "classwizard", "mfc classwizard", "resource script generated"]


def language(suffix: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(table[F.lower(suffix)], F.lit("Text"))


def generated_head(suffix: Column, lines: Column) -> Column:
    """By suffix, or by a marker in the first lines."""
    head = F.lower(F.array_join(F.slice(lines, 1, GENERATED_LINES), "\n"))
    marked = F.lit(False)
    for m in GENERATED_MARKERS:
        marked = marked | F.contains(head, F.lit(m))
    return F.coalesce(F.lower(suffix).isin(*GENERATED_SUFFIX), F.lit(False)) | F.coalesce(marked, F.lit(False))


def longest_prefix(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """(path, folder) of each path (path) below or at one of the folders (folder), in any case: the longest of them.

    A path stands for its cuts at every slash, as in a trie of path parts, and cuts meet folders by equality; folders that
    start like a path's part but aren't one don't match.
    """
    parts = F.split(F.lower("path"), "/")
    cuts = paths.select("path").distinct().withColumn("parts", parts).select("path", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"), "parts")
    cuts = cuts.select("path", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("key"))
    known = folders.select(F.lower("folder").alias("key"), "folder").groupBy("key").agg(F.min("folder").alias("folder"))
    return cuts.join(known, "key").groupBy("path").agg(F.max_by("folder", "depth").alias("folder"))


def flags(files: DataFrame, vendored_folders: DataFrame) -> DataFrame:
    """(path, language, generated, vendored, folder) of files (path, lines: array of text); folder is the longest vendored one that holds the file."""
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    f = files.select("path", language(suffix).alias("language"), generated_head(suffix, F.col("lines")).alias("generated"))
    f = f.join(longest_prefix(files, vendored_folders), "path", "left")
    return f.select("path", "language", "generated", F.col("folder").isNotNull().alias("vendored"), "folder")


def tag_counts(tags: DataFrame) -> DataFrame:
    """(file, kind, n) of tags (file, kind), with the sums over all files as file null."""
    return tags.rollup("kind", "file").agg(F.count("*").alias("n")).filter("kind IS NOT NULL").select("file", "kind", "n")


def untagged(files: DataFrame, tags: DataFrame) -> DataFrame:
    """(file) of files (file, binary) that aren't binary and have no tag: empty, or not understood."""
    return files.filter(~F.coalesce("binary", F.lit(False))).join(tags.select("file").distinct(), "file", "left_anti").select("file")


def report(records: DataFrame, tags: DataFrame, long: int = LONG, listed: int = LISTED) -> DataFrame:
    """One row, a nested report of files (file, top_dir, lines, encoding, binary, generated) and tags (file, kind): totals, counts by folder, encoding and kind, the longest files, those without tags, and the risk.

    Lists hold `listed` entries, counts a row to a folder, an encoding or a kind, so each part is small before it is joined to the others.
    """
    def counted(d: DataFrame, key: str, name: str) -> DataFrame:
        rows = d.groupBy(F.coalesce(key, F.lit("")).alias("key")).agg(F.count("*").alias("n"))
        return rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "key", "n"))).alias("x")).select(F.transform("x", lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n"))).alias(name))

    bare = untagged(records, tags)
    flagged = records.join(bare.withColumn("__u", F.lit(True)), "file", "left").withColumn("tagged", F.coalesce("binary", F.lit(False)) | F.col("__u").isNull()).withColumn("__all", F.lit("all"))
    risky = risk(flagged.drop("__u"), ["__all"], long=long).drop("__all")
    first = lambda d, order, columns, name: d.orderBy(*order).limit(listed).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    parts = [
        records.agg(F.struct(F.count("*").alias("n_files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("n_lines"), F.count_if("binary").alias("n_binary"), F.count_if("generated").alias("n_generated")).alias("totals")),
        counted(records, "top_dir", "folders"), counted(records, "encoding", "encodings"), counted(tags, "kind", "kinds"),
        first(records, [F.desc("lines"), "file"], [(-F.col("lines")).alias("o"), F.col("file"), F.col("lines")], "longest").select(F.transform("longest", lambda x: F.struct(x["file"].alias("file"), x["lines"].alias("lines"))).alias("longest")),
        first(bare, ["file"], ["file"], "untagged").select(F.transform("untagged", lambda x: x["file"]).alias("untagged")),
        risky.agg(F.first(F.struct(*risky.columns)).alias("risk")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out
