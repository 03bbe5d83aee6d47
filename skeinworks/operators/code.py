"""Source files: line classes, ends of symbols, chunks, command dispatch, includes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions import text as T
from skeinworks.functions.rules import HEADER, IMPLEMENTATION, suffix
from skeinworks.operators.symbols import enclosing
from skeinworks.plans.stage import bounded_batches

# Sizes of chunks in lines, and how far a symbol without a closing brace reaches.
LONGEST, LONG_WINDOW, PLAIN_WINDOW, HEAD, UNCLOSED = 180, (180, 40), (100, 20), 40, 100

_LEX = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\[^\n]|\\(?=\n|\Z))*"?|'(?:[^'\\\n]|\\[^\n]|\\(?=\n|\Z))*'?|\n|[^\s"'/]+|/""", re.S)


def count_loc(text: str) -> tuple[int, int, int]:
    """(code, comment, blank) lines: code beats comment; block comments cross lines, strings don't; an empty line is blank even in a comment."""
    lines = text.splitlines()
    code, comment, at = set(), set(), 0
    for m in _LEX.finditer("\n".join(lines)):
        piece = m.group()
        if piece == "\n":
            at += 1
        elif piece.startswith("/*"):
            for k, part in enumerate(piece.split("\n")):
                if part:
                    comment.add(at + k)
            at += piece.count("\n")
        elif piece.startswith("//"):
            comment.add(at)
        else:
            code.add(at)
    return len(code), len(comment - code), len(lines) - len(code | comment)


def loc(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, comment, blank) as longs; null texts have no lines. Whole texts, one at a time, in Arrow batches."""
    bounded_batches(df.sparkSession)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            n = [count_loc(t) for t in p["t"]]
            yield pd.DataFrame({"k": p["k"], "code": [x[0] for x in n], "comment": [x[1] for x in n], "blank": [x[2] for x in n]})

    rows = df.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInPandas(count, f"k {kind}, code long, comment long, blank long").withColumnRenamed("k", key)


def closing(lines: DataFrame, at: DataFrame) -> DataFrame:
    """(file, line, brace) of each place (file, line): the line of the brace that closes the first one opened there or below.

    A running depth over a file's braces: the closing brace is the first one after that opening that brings the depth
    back to what it was before the place. Places without one are left out. lines has (file, line, text).
    """
    found = F.posexplode(F.regexp_extract_all("text", F.lit("[{}]"), F.lit(0))).alias("i", "c")
    marks = at.select("file", "line").distinct().select("file", "line", F.lit(-1).alias("i"), F.lit(None).cast("string").alias("c"))
    every = lines.select("file", "line", found).unionByName(marks)
    step = F.when(F.col("c") == "{", 1).when(F.col("c") == "}", -1).otherwise(0)
    down = Window.partitionBy("file").orderBy("line", "i").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("file").orderBy(F.desc("line"), F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct("line", "i")
    every = every.withColumn("depth", F.sum(step).over(down)).withColumn("opened", F.last(F.when(F.col("c") == "{", place), ignorenulls=True).over(up))
    ends = every.filter("c = '}' OR (c IS NULL AND opened IS NOT NULL)").withColumn("at", F.when(F.col("c").isNull(), F.col("opened")).otherwise(place))
    nearest = Window.partitionBy("file", "depth").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("brace", F.last(F.when(F.col("c") == "}", F.col("line")), ignorenulls=True).over(nearest))
    return ends.filter("c IS NULL AND brace IS NOT NULL").select("file", "line", "brace")


def symbol_ends(files: DataFrame, found: DataFrame) -> DataFrame:
    """found (file, name, kind, line, class, end_line or null) with `end`: the stated end if it isn't before the symbol, else the closing brace, before the next symbol.

    files has (file, lines array). A symbol whose braces never close reaches `UNCLOSED` lines on, or to the file's end.
    """
    rows = files.select("file", F.posexplode("lines").alias("p", "text")).select("file", (F.col("p") + 1).cast("long").alias("line"), "text")
    s = found.withColumn("next", F.lead("line").over(Window.partitionBy("file").orderBy("line", "name")))
    s = s.join(files.select("file", F.size("lines").cast("long").alias("n")), "file").join(closing(rows, found), ["file", "line"], "left")
    stated = (F.col("end_line") > 0) & (F.col("end_line") >= F.col("line"))
    last = F.coalesce("brace", F.least(F.col("line") + UNCLOSED, F.col("n")))
    end = F.when(stated, F.least("end_line", "n")).when(F.col("next") > F.col("line"), F.least(last, F.col("next") - 1)).otherwise(last)
    return s.select("file", "name", "kind", "class", "line", end.alias("end"))


def header(file: Column, symbol: Column, kind: Column, start: Column, end: Column, owner: Column, symbol_start: Column, sub: Column) -> Column:
    """The comment lines above a chunk's text."""
    has = F.coalesce(symbol, F.lit("")) != ""
    span = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))

    def line(label, value, shown=F.lit(True)):
        return F.when(shown, F.concat(F.lit(f"// {label}: "), value.cast("string")))

    return F.concat_ws("\n", line("file", file), line("symbol", symbol, has), line("symbol_start", F.coalesce(symbol_start, start), has), line("chunk_lines", span, has), line("lines", span, ~has), line("kind", kind, F.coalesce(kind, F.lit("")) != ""), line("class", owner, F.coalesce(owner, F.lit("")) != ""), line("sub_idx", sub))


def overview(file: Column, top_dir: Column, lines: Column, listed: Column, n_symbols: Column) -> Column:
    """The text of a file's overview: counts, 15 includes of its head, the listed symbols, its head of 40 lines."""
    head = F.slice(lines, 1, HEAD)
    inc = F.filter(F.transform(head, lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("#include")))
    return F.concat_ws(
        "\n", F.lit("// [file overview]"), F.concat(F.lit("// file:    "), file), F.concat(F.lit("// top_dir: "), top_dir), F.concat(F.lit("// lines:   "), F.size(lines).cast("string")), F.lit("//"),
        F.concat(F.lit("// includes ("), F.size(inc).cast("string"), F.lit("):")), F.transform(F.slice(inc, 1, 15), lambda x: F.concat(F.lit("//   "), x)), F.lit("//"),
        F.concat(F.lit("// symbols ("), n_symbols.cast("string"), F.lit("):")), F.transform(F.slice(listed, 1, 30), lambda x: F.concat(F.lit("//"), x)), F.lit("//"),
        F.concat(F.lit("// --- file head (lines 1-"), F.size(head).cast("string"), F.lit(") ---")), F.array_join(head, "\n"),
    )


def chunks(files: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, type, file, start, end, symbol, kind, class, text, symbol_start, sub_idx): functions of implementation files, classes of headers, else windows; and an overview of each file.

    files has (file, top_dir, lines); ends is the result of symbol_ends. Empty files have no chunks.
    """
    f = files.filter(F.size("lines") > 0).select("file", "top_dir", "lines", suffix(F.col("file")).alias("suffix"))
    own = ends.join(f.select("file", "suffix", "lines"), "file")
    fit = (F.col("suffix").isin(*IMPLEMENTATION) & (F.col("kind") == "function")) | (F.col("suffix").isin(*HEADER) & F.col("kind").isin("class", "struct"))
    own = own.filter(fit)
    n = F.col("end") - F.col("line") + 1
    whole = F.array(F.struct(F.lit(1).cast("long").alias("start"), n.cast("long").alias("end")))
    cut = own.select("*", F.posexplode(F.when(n <= LONGEST, whole).otherwise(T.sub_windows(n, *LONG_WINDOW))).alias("sub", "w"))
    symbolic = cut.select("file", F.when(F.col("kind") == "function", "function").otherwise("class").alias("type"), (F.col("line") + F.col("w.start") - 1).alias("start"), (F.col("line") + F.col("w.end") - 1).alias("end"), F.col("name").alias("symbol"), "kind", "class", F.col("line").alias("symbol_start"), F.when(n > LONGEST, F.col("sub")).alias("sub_idx"), "lines")
    bare = f.join(own.select("file").distinct(), "file", "left_anti").select("file", F.lit("fallback").alias("type"), F.explode(T.sub_windows(F.size("lines").cast("long"), *PLAIN_WINDOW)).alias("w"), "lines")
    plain = bare.select("file", "type", "w.start", "w.end", F.lit("").alias("symbol"), F.lit("").alias("kind"), F.lit("").alias("class"), F.lit(None).cast("long").alias("symbol_start"), F.lit(None).cast("int").alias("sub_idx"), "lines")
    body = F.array_join(F.slice("lines", F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int")), "\n")
    parts = symbolic.unionByName(plain).filter("end >= start").withColumn("text", F.concat_ws("\n", header(F.col("file"), F.col("symbol"), F.col("kind"), F.col("start"), F.col("end"), F.col("class"), F.col("symbol_start"), F.col("sub_idx")), body))
    parts = parts.withColumn("id", T.chunk_id(F.col("file"), F.col("start"), F.col("end")))
    shown = F.concat(F.lit("  "), F.rpad("kind", 12, " "), F.lit(" "), F.col("name"), F.when(F.col("class") != "", F.concat(F.lit("  (in "), F.col("class"), F.lit(")"))).otherwise(""), F.lit("  line "), F.col("line").cast("string"))
    top = ends.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("line", "name"))).filter("r <= 30")
    listed = top.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", shown.alias("x")))), lambda y: y["x"]).alias("listed"))
    counted = ends.groupBy("file").agg(F.count("*").alias("n_symbols"))
    o = f.join(listed, "file", "left").join(counted, "file", "left")
    last = F.least(F.lit(HEAD), F.size("lines")).cast("long")
    over = o.select(
        F.concat(T.chunk_id(F.col("file"), F.lit(1), last), F.lit("::overview")).alias("id"), F.lit("file_overview").alias("type"), "file", F.lit(1).cast("long").alias("start"), last.alias("end"), F.lit("").alias("symbol"), F.lit("file_overview").alias("kind"), F.lit("").alias("class"),
        overview(F.col("file"), F.col("top_dir"), F.col("lines"), F.coalesce("listed", F.array().cast("array<string>")), F.coalesce("n_symbols", F.lit(0))).alias("text"), F.lit(None).cast("long").alias("symbol_start"), F.lit(None).cast("int").alias("sub_idx"),
    )
    return parts.select(over.columns).unionByName(over)


# Patterns of command dispatch in handlers, what a command without a number is called, and what each kind is trusted as.
_SWITCH = r"(?i)switch\s*\(\s*gcode->([gm])\s*\)"
_CASE = r"\bcase\s+(\d+(?:\.\d+)?)\s*:"
_DIRECT = r"(?i)gcode->([gm])\s*==\s*(\d+(?:\.\d+)?)"
_NAMED = r"(?i)gcode->([gm])\s*==\s*this->([A-Za-z_]\w*)"
_DEFAULT = r"(?i)this->([A-Za-z_]\w*)\s*=.*?by_default\((\d+(?:\.\d+)?)\)->as_number"
_LETTER = r"(?i)has_letter\(\s*['\"]([GM])['\"]\s*\).*?get_value\(\s*['\"]\1['\"]\s*\)"
UNKNOWN = "unknown"
CONFIDENCE = {"case": "switch-case", "direct": "static-pattern", "named": "config-default", "letter": "dynamic-letter-value"}


def normal_number(n: Column) -> Column:
    return F.when(F.contains(n, F.lit(".")), F.regexp_replace(n, r"\.?0+$", "")).otherwise(n)


def _pairs(pattern: str) -> Column:
    """Both groups of every match in a line."""
    return F.explode(F.arrays_zip(*(F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "a"), (2, "b")))))


def dispatch_defaults(lines: DataFrame) -> DataFrame:
    """(file, name, value): the last default that a file's lines (file, line, text) give each variable."""
    found = lines.select("file", "line", F.posexplode(F.arrays_zip(*(F.regexp_extract_all("text", F.lit(_DEFAULT), F.lit(g)).alias(n) for g, n in ((1, "a"), (2, "b"))))).alias("at", "m"))
    return found.groupBy("file", F.col("m.a").alias("name")).agg(normal_number(F.max_by("m.b", F.struct("line", "at"))).alias("value"))


def dispatch(lines: DataFrame, defaults: DataFrame) -> DataFrame:
    """(chunk, file, line, command, kind, evidence, confidence) of commands that chunks handle; lines has (chunk, file, line, text).

    The letter of a case is that of the last switch at or before its line in the chunk. Comparison with a number is
    'direct', with a variable 'named' by its default; a letter whose value is read as it comes is 'letter', an unknown command.
    Each (command, file, line) counts once, for the first chunk.
    """
    w = Window.partitionBy("chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    s = lines.withColumn("letter", F.last(F.upper(F.nullif(F.regexp_extract("text", _SWITCH, 1), F.lit(""))), ignorenulls=True).over(w))
    row = ["chunk", "file", "line", "text"]
    told = lambda d, command, kind: d.select(*row, command.alias("command"), F.lit(kind).alias("kind"))
    case = told(s.filter("letter IS NOT NULL").select(*row, F.explode(F.regexp_extract_all("text", F.lit(_CASE), 1)).alias("n"), "letter"), F.concat("letter", normal_number(F.col("n"))), "case")
    direct = told(lines.select(*row, _pairs(_DIRECT).alias("m")), F.concat(F.upper("m.a"), normal_number(F.col("m.b"))), "direct")
    named = told(lines.select(*row, _pairs(_NAMED).alias("m")).withColumn("name", F.col("m.b")).join(defaults, ["file", "name"]), F.concat(F.upper("m.a"), "value"), "named")
    letter = told(lines.filter(F.col("text").rlike(_LETTER)), F.lit(UNKNOWN), "letter")
    every = case.unionByName(direct).unionByName(named).unionByName(letter)
    trust = F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair))
    one = every.groupBy("command", "file", "line").agg(F.min(F.struct("chunk", "kind", "text")).alias("x"))
    return one.select("x.chunk", "file", "line", "command", "x.kind", F.trim("x.text").alias("evidence"), trust[F.col("x.kind")].alias("confidence"))


def handlers(entries: DataFrame, ends: DataFrame) -> DataFrame:
    """entries (file, line, ...) with `handler`: class and name of the innermost function around the line, by its ends (of symbol_ends); '' outside of all."""
    ranges = ends.filter("kind = 'function'").select("file", F.col("line").alias("start"), "end", "name", "class")
    full = F.when(F.col("inner.class") != "", F.concat("inner.class", F.lit("::"), "inner.name")).otherwise(F.col("inner.name"))
    return enclosing(entries, ranges).withColumn("handler", F.coalesce(full, F.lit(""))).drop("inner")


def resolve_paths(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(name, target, how): each wanted name's files among known (file): of that path; else of that base name; else whose path ends in the name.

    Ends are met by equality on cuts of the known paths at the lengths that names have, not by comparing all pairs.
    """
    w = wanted.select("name").filter("name <> ''").distinct()
    exact = w.join(known.select(F.col("file").alias("name"), F.col("file").alias("target")), "name").withColumn("how", F.lit("path"))
    rest = w.join(exact.select("name").distinct(), "name", "left_anti")
    base = rest.join(known.select(F.substring_index("file", "/", -1).alias("name"), F.col("file").alias("target")), "name").withColumn("how", F.lit("base"))
    rest = rest.join(base.select("name").distinct(), "name", "left_anti")
    sizes = rest.agg(F.array_sort(F.collect_set(F.length("name"))).alias("sizes"))  # one row, at most the longest name's length
    cuts = known.join(F.broadcast(sizes)).select(F.col("file").alias("target"), F.explode(F.filter("sizes", lambda n: n < F.length("file"))).alias("n"))
    ends = rest.join(cuts.select(F.expr("right(target, n)").alias("name"), "target"), "name").withColumn("how", F.lit("end"))
    return exact.unionByName(base).unionByName(ends)
