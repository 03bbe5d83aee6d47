"""Text rules as column expressions: all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of words and of command codes.
WORD = r"([A-Za-z_][\w\p{L}\p{N}]*+|\p{Nd}++)"
COMMAND = r"(?i)\b([GM])\s*[-:]?\s*(\d+(?:\.\d+)?)\b"
NEWLINE = r"\r\n|\r|\n"


def tokens(text: Column) -> Column:
    """Distinct lower-cased identifiers in first-seen order: each word, its camel-case parts, its parts at underscores; two characters at least."""
    t = F.replace(F.replace(text, F.lit("->"), F.lit(" ")), F.lit("::"), F.lit(" "))
    t = F.when(F.contains(text, F.lit("G-")), F.regexp_replace(t, "G-[Cc]ode", "gcode")).otherwise(t)  # few texts hold one

    def parts(w):
        rest = F.substring(w, 2, 1 << 30)
        whole = (F.lower(rest) == rest) & ~F.contains(w, F.lit("_"))  # most words: nothing to split, so no pattern runs
        return F.when(whole, F.array(w)).otherwise(F.concat(F.array(w), F.split(F.regexp_replace(w, "([a-z])([A-Z])", "$1 $2"), " "), F.split(w, "_")))

    every = F.flatten(F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(WORD), 1)), parts))
    return F.array_distinct(F.filter(F.transform(every, F.lower), lambda w: F.length(w) >= 2))


def commands(text: Column) -> Column:
    """Distinct normalised command codes: letter and number without trailing zeros after a point."""
    found = F.transform(F.regexp_extract_all(text, F.lit(COMMAND), 0), lambda m: F.upper(F.regexp_replace(m, r"[\s:\-]", "")))
    return F.array_distinct(F.transform(found, lambda m: F.when(F.contains(m, F.lit(".")), F.regexp_replace(m, r"\.?0+$", "")).otherwise(m)))


def line_count(text: Column) -> Column:
    """Terminated lines, and one more for a rest without a terminator."""
    rest = F.when((text != "") & ~text.rlike(r"[\r\n]$"), 1).otherwise(0)
    return (F.regexp_count(text, F.lit(NEWLINE)) + rest).cast("long")


def lines(text: Column) -> Column:
    """The lines of a text without terminators; the empty one after a final terminator is no line."""
    parts = F.split(text, NEWLINE, -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def chunk_id(file: Column, start: Column, end: Column) -> Column:
    return F.concat(F.regexp_replace(file, r"[/\\.]", "_"), F.lit("::"), start.cast("string"), F.lit("-"), end.cast("string"))


def sub_windows(n: Column, size: int, overlap: int) -> Column:
    """array<struct<start, end>> of sliding windows over lines 1..n; the last is cut at n. None for n = 0."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    at = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((1 + k * step).cast("long").alias("start"), F.least(k * step + size, n).cast("long").alias("end")))
    return F.when(n > 0, at)
