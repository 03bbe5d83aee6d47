"""One huge JSON object or array as a table of its members, read by byte ranges.

A range can't know where it starts: inside a string or not, and how deep. So each range is first summed up for both cases:
whether quotes leave it in the other state, and by how much brackets change the depth. From these few numbers to a range
a running sum gives every range its true start. In a second pass a task finds the separators at depth one that lie in its
range and reads each member from there to its end, beyond the range if need be. No task reads the file whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.sources.tree import opened

#: Bytes of a range, and bytes that a look beyond a range takes at a time.
RANGE, STEP = 1 << 25, 1 << 20
_SIGN = re.compile(rb'\\.|["{}\[\],]', re.S)
_OPEN, _CLOSE = b"{[", b"}]"


def _escaped(f, at: int) -> bool:
    """Whether an odd run of backslashes stands before the place."""
    n = 0
    while n < at:
        f.seek(max(0, at - n - 64))
        part = f.read(min(64, at - n))
        kept = part.rstrip(b"\\")
        n += len(part) - len(kept)
        if kept:
            break
    return n % 2 == 1


def _signs(f, at: int, data: bytes) -> Iterator[tuple[bytes, int]]:
    """(sign, place in the file) of quotes, brackets and commas that no backslash escapes. A backslash that ends the data has no partner here."""
    first = int(bool(at) and _escaped(f, at))
    for m in _SIGN.finditer(data, first):
        if m[0][0] != 92:
            yield m[0], at + m.start()


def _summary(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, p = opened(path)
        with fs.open_input_file(p) as f:
            for b in batches:
                out = []
                for n, start, end in zip(b["n"], b["start"], b["end"], strict=True):
                    f.seek(start)
                    data = f.read(end - start)
                    inside, depth = False, [0, 0]  # depth by whether the range starts in a string
                    for sign, _ in _signs(f, start, data):
                        if sign == b'"':
                            inside = not inside
                        elif sign != b",":
                            depth[inside] += 1 if sign in _OPEN else -1
                    out.append((n, inside, *depth))
                yield pd.DataFrame(out, columns=["n", "turns", "outside", "inside"])

    return run


def _members(path: str, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, p = opened(path)
        with fs.open_input_file(p) as f:
            for b in batches:
                for start, end, inside, depth in zip(b["start"], b["end"], b["in_string"], b["depth"], strict=True):
                    yield from found(f, start, end, inside, depth)

    def found(f, start: int, end: int, inside: bool, depth: int) -> Iterator[pd.DataFrame]:
        at, began, held, rows, weight = start, None, b"", [], 0
        while at < size and (at < end or began is not None):
            f.seek(at)
            data = f.read(min(STEP, (end if at < end else size) - at))
            cut = 0  # what is held of the open member begins here
            for sign, place in _signs(f, at, data):
                if sign == b'"':
                    inside = not inside
                elif not inside:
                    ends = sign == b"," and depth == 1 or sign in _CLOSE and depth == 1
                    if ends and began is not None:
                        rows.append((began, (held + data[cut : place - at]).strip()))
                        weight += len(rows[-1][1])
                        began, held = None, b""
                    starts = sign == b"," and depth == 1 or sign in _OPEN and depth == 0
                    depth += (sign in _OPEN) - (sign in _CLOSE)
                    if starts and place < end:
                        began, cut = place + 1, place + 1 - at
                    if place >= end and began is None:
                        break
                if weight >= 1 << 23:
                    yield table(rows)
                    rows, weight = [], 0
            if began is not None:
                held += data[cut:]
            at += len(data)
        yield table(rows)

    def table(rows: list) -> pd.DataFrame:
        kept = [(at, x.decode("utf-8", "replace")) for at, x in rows if x]
        return pd.DataFrame({"at": pd.Series([x[0] for x in kept], dtype="int64"), "member": pd.Series([x[1] for x in kept], dtype=object)})

    return run


def _starts(spark: SparkSession, path: str, size: int, lo: int, hi: int) -> DataFrame:
    """(n, start, end, in_string, depth) of the ranges of the value in bytes lo to hi, with the state that each begins in."""
    n = -(-(hi - lo) // size)
    at = spark.range(0, n, 1, n).select(F.col("id").alias("n"), (F.lit(lo) + F.col("id") * size).alias("start"), F.least(F.lit(lo) + (F.col("id") + 1) * size, F.lit(hi)).alias("end"))
    sums = at.mapInPandas(_summary(path), "n long, turns boolean, outside long, inside long").toPandas().sort_values("n")  # four numbers a range
    sums["in_string"] = (sums["turns"].cumsum() - sums["turns"]) % 2 == 1
    step = sums["inside"].where(sums["in_string"], sums["outside"])
    sums["depth"] = step.cumsum() - step
    begins = spark.createDataFrame(pa.Table.from_pandas(sums[["n", "in_string", "depth"]], preserve_index=False))
    return at.join(F.broadcast(begins), "n").repartition(n, "n")


def _bounds(path: str, lo: int, hi: int | None) -> tuple[int, int]:
    fs, p = opened(path)
    return lo, (fs.get_file_info(p).size or 0) if hi is None else hi


def members(spark: SparkSession, path: str, size: int = RANGE, lo: int = 0, hi: int | None = None) -> DataFrame:
    """(at long, key string, value string) of each member of the one object or array in bytes lo to hi of the file (all of it): its byte offset, its key (null in an array), its JSON text.

    size: bytes of a range; any gives the same rows. A member is one task's, so the largest member bounds memory, not the file.
    White space is trimmed; an empty file, object or array has no members. The text must be one valid JSON value in UTF-8.
    """
    lo, hi = _bounds(path, lo, hi)
    if hi <= lo:
        return spark.createDataFrame([], "at long, key string, value string")
    raw = _starts(spark, path, size, lo, hi).mapInPandas(_members(path, hi), "at long, member string")
    # In an object every member starts with its key; a string in an array has no colon after it.
    key = F.regexp_extract("member", _KEY, 1)
    value = F.when(key != "", F.regexp_replace("member", _KEY, "")).otherwise(F.col("member"))
    return raw.select("at", F.when(key != "", F.from_json(F.concat(F.lit('{"k":'), key, F.lit("}")), "k string")["k"]).alias("key"), value.alias("value"))


_KEY = r'(?s)^("(?:[^"\\]|\\.)*+")\s*:\s*'
HEAD = 1 << 16


def _separators(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, p = opened(path)
        with fs.open_input_file(p) as f:
            for b in batches:
                for start, end, inside, depth in zip(b["start"], b["end"], b["in_string"], b["depth"], strict=True):
                    f.seek(start)
                    places = []
                    for sign, place in _signs(f, start, f.read(end - start)):
                        if sign == b'"':
                            inside = not inside
                        elif not inside:
                            if depth == 1 and (sign == b"," or sign in _CLOSE) or depth == 0 and sign in _OPEN:
                                places.append(place)
                            depth += (sign in _OPEN) - (sign in _CLOSE)
                    yield pd.DataFrame({"place": pd.Series(places, dtype="int64")})

    return run


def spans(spark: SparkSession, path: str, size: int = RANGE) -> dict[str, tuple[int, int]]:
    """Key to the (lo, hi) bytes of its value, for the members of the file's object, of which there should be few: they may be of any size, as none is read."""
    lo, hi = _bounds(path, 0, None)
    if hi <= lo:
        return {}
    places = sorted(r[0] for r in _starts(spark, path, size, lo, hi).mapInPandas(_separators(path), "place long").collect())
    fs, p = opened(path)
    out = {}
    with fs.open_input_file(p) as f:
        for a, b in zip(places, places[1:], strict=False):
            f.seek(a + 1)
            if m := re.match(rb'\s*("(?:[^"\\]|\\.)*")\s*:', f.read(min(HEAD, b - a - 1)), re.S):
                out[json.loads(m[1])] = (a + 1 + m.end(), b)
    return out


def under(spark: SparkSession, path: str, name: str, size: int = RANGE) -> DataFrame:
    """Members of the object or array that the file's object has under a name, which is read by ranges as well; none without it."""
    at = spans(spark, path, size).get(name)
    return members(spark, path, size, *at) if at else members(spark, path, size, 0, 0)


def _parsed(value: Column, schema: str) -> Column:
    """A member's value of any type."""
    return F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), f"v {schema}")["v"]


ENTRY = "command string, kind string, handler_file string, handler_symbol string, target_symbol string, line long, evidence string, confidence string, chunk_id string"


def call_graph(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(chunk, symbol): each chunk's mentions, from a file with `mentions`: chunk to symbols, or `mentioned_by`: symbol to chunks; both say the same."""
    m = under(spark, path, "mentions", size).select(F.col("key").alias("chunk"), F.explode(_parsed(F.col("value"), "array<string>")).alias("symbol"))
    by = under(spark, path, "mentioned_by", size).select(F.explode(_parsed(F.col("value"), "array<string>")).alias("chunk"), F.col("key").alias("symbol"))
    return m.unionByName(by).distinct()


def is_object(path: str) -> bool:
    """Whether the file holds an object."""
    fs, p = opened(path)
    if not fs.get_file_info(p).size:
        return False
    with fs.open_input_file(p) as f:
        return f.read(HEAD).lstrip()[:1] == b"{"


def dispatch_index(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Entries of commands, from an array of them or an object with `entries`; anything else has none."""
    flat = members(spark, path, size).filter("key IS NULL") if not is_object(path) else under(spark, path, "entries", size)
    return flat.select(F.from_json("value", ENTRY).alias("e")).filter("e IS NOT NULL").select("e.*")


def edge_map(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(src, dst, kind, label, weight) of a graph file's `edges`: source to its edges."""
    e = under(spark, path, "edges", size).select(F.col("key").alias("src"), F.explode(_parsed(F.col("value"), "array<struct<to:string,weight:double,kind:string,label:string>>")).alias("e"))
    return e.select("src", F.col("e.to").alias("dst"), "e.kind", "e.label", "e.weight")
