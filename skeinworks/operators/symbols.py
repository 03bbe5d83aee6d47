"""Definitions of C and C++ sources by a lexer with a stack of scopes, and the innermost symbol around a line.

A file is read as a stream of pieces: comments, strings, raw strings and directives are single pieces, so nothing inside
them counts. Where declarations can stand (file, namespace, class), the pieces since the last boundary are the head of what
an opening brace or a semicolon ends; inside functions and initialisers only braces are counted. Of conditional
directives the first branch that isn't `#if 0` is read. Files are read one at a time, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.plans.stage import bounded_batches

# One piece of source: directive, comment, raw string, string, character, name, number, line feed, sign.
_PIECE = re.compile(
    r"""(?P<dir>(?:(?<=\n)|\A)[ \t]*\#(?:/\*.*?(?:\*/|\Z)|\\\r?\n|(?!//)[^\n])*)|(?P<skip>//(?:\\\r?\n|[^\n])*|/\*.*?(?:\*/|\Z)|(?:u8|[uUL])?R"(?P<raw>[^()\\\s]{0,16})\(.*?(?:\)(?P=raw)"|\Z))
    |(?P<str>"(?:\\.|[^"\\\n])*"?|(?<![0-9A-Fa-f])'(?:\\.|[^'\\\n])*'?)|(?P<name>[A-Za-z_]\w*)|(?P<num>\d[\w.']*)|(?P<sign>::|->\*?|<<=|<=>|[<>=!+\-*/%&|^]=|&&|\|\||\+\+|--|[^\s\w])""",
    re.S | re.X,
)
_DEFINE = re.compile(r"\s*#\s*define\s+([A-Za-z_]\w*)")
_CONDITION = re.compile(r"\s*#\s*(if|ifdef|ifndef|elif|else|endif)\b\s*(0\s*(?:$|//|/\*))?")
_NOT_FUNCTIONS = frozenset("if for while switch catch return sizeof decltype alignas __attribute__ __declspec noexcept static_assert throw defined typeof new delete else do case".split())
_TYPES = ("class", "struct", "union", "enum")
_ACCESS = frozenset("public private protected signals slots Q_SIGNALS Q_SLOTS".split())


def _pieces(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, piece, line) of what is read, with strings as '"' and defines as 'define'."""
    line, at, taken = 1, 0, []  # taken: of each open condition, whether a branch was read, and whether this one is
    for m in _PIECE.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        if m.lastgroup == "dir":
            c = _CONDITION.match(m[0])
            if not c:
                d = _DEFINE.match(m[0])
                if d and all(on for _, on in taken):
                    yield "define", d[1], line
                    yield "end", "", line + m[0].count("\n")
            elif c[1].startswith("if"):
                taken.append((not c[2], not c[2]))
            elif c[1] == "endif":
                taken = taken[:-1]
            elif taken:
                read, _ = taken[-1]
                taken[-1] = (True, not read and not (c[1] == "elif" and c[2]))
        elif m.lastgroup not in ("skip", "raw") and all(on for _, on in taken):
            yield ("str", '"', line) if m.lastgroup == "str" else (m.lastgroup, m[0], line)


def _without_angles(head: list) -> list:
    """The head without `template <...>` and without bracketed attributes."""
    out, i = [], 0
    while i < len(head):
        if head[i][1] == "template" and i + 1 < len(head) and head[i + 1][1] == "<":
            depth, i, round_ = 0, i + 1, 0
            while i < len(head):
                x = head[i][1]
                round_ += (x == "(") - (x == ")")
                depth += 0 if round_ else (x == "<") - (x == ">")
                i += 1
                if not depth:
                    break
        elif head[i][1] == "[" and i + 1 < len(head) and head[i + 1][1] == "[":
            while i < len(head) and not (head[i][1] == "]" and i + 1 < len(head) and head[i + 1][1] == "]"):
                i += 1
            i += 2
        else:
            out.append(head[i])
            i += 1
    return out


def _callee(head: list) -> tuple[str, list[str], int] | None:
    """(name, qualifiers, line) of what the head declares as a function: the name before its first outer parenthesis, before any '='."""
    depth = 0
    for i, (kind, x, line) in enumerate(head):
        if x == "operator" and depth == 0:
            j = i + 1
            if [y for _, y, _ in head[j : j + 2]] == ["(", ")"]:
                j += 2
            while j < len(head) and head[j][1] != "(":
                j += 1
            if j == len(head):
                return None
            told = head[i + 1 : j]
            return "operator " + (" " if all(k == "name" for k, _, _ in told) else "").join(y for _, y, _ in told), _qualifiers(head[:i]), line
        if x == "=" and depth == 0:
            return None
        if x == "(" and depth == 0:
            before = head[i - 1] if i else ("", "", 0)
            if before[0] == "name" and before[1] not in _NOT_FUNCTIONS:
                rest, name = head[: i - 1], before[1]
                if rest and rest[-1][1] == "~":
                    rest, name = rest[:-1], "~" + name
                return name, _qualifiers(rest), before[2]
        depth += (x in "([{") - (x in ")]}") if len(x) == 1 else 0
    return None


def _qualifiers(rest: list) -> list[str]:
    """Names before `::` at the end of what stands before a name, template arguments left out."""
    out = []
    while rest and rest[-1][1] == "::":
        rest = rest[:-1]
        if rest and rest[-1][1] == ">":
            depth = 0
            while rest:
                depth += (rest[-1][1] == ">") - (rest[-1][1] == "<")
                rest = rest[:-1]
                if not depth:
                    break
        if not rest or rest[-1][0] != "name":
            break
        out.append(rest[-1][1])
        rest = rest[:-1]
    return out[::-1]


def _outer(head: list, sign: str) -> int:
    """Place of the first such piece outside of all brackets, or -1."""
    depth = 0
    for i, (_, x, _) in enumerate(head):
        if x == sign and depth == 0:
            return i
        depth += (x in "([{") - (x in ")]}") if len(x) == 1 else 0
    return -1


def _typed(head: list) -> tuple[str, str, int] | None:
    """(kind, name, line) of the type that the head defines; the name may be empty."""
    k = next((i for i, (_, x, _) in enumerate(head) if x in _TYPES), -1)
    if k < 0 or (_outer(head, "(") >= 0 and not any(x in ("__attribute__", "__declspec", "alignas") for _, x, _ in head)):
        return None
    kind, rest = head[k][1], head[k + 1 :]
    if kind == "enum" and rest and rest[0][1] in ("class", "struct"):
        rest = rest[1:]
    colon = _outer(rest, ":")
    names = [x for x in (rest[:colon] if colon >= 0 else rest) if x[0] == "name" and x[1] != "final" and not x[1].startswith("__")]
    angle = _outer(rest, "<")
    if 0 <= angle and (colon < 0 or angle < colon):  # a specialisation's name stands before its arguments
        names = [x for x in rest[:angle] if x[0] == "name"]
    return kind, names[-1][1] if names else "", names[-1][2] if names else head[k][2]


def _renamed(head: list) -> tuple[str, int] | None:
    """(name, line) that a typedef or `using` gives."""
    words = [x for x in head if x[1] != "typedef"]
    if head[0][1] == "using":
        return (head[1][1], head[1][2]) if len(head) > 2 and head[2][1] == "=" else None
    for i, (_, x, _) in enumerate(words[:-2]):
        if x == "(" and words[i + 1][1] in ("*", "&"):
            named = next((y for y in words[i + 1 :] if y[0] == "name"), None)
            return named and (named[1], named[2])
    cut = next((i for i, (_, x, _) in enumerate(words) if x in ("[", "(")), len(words))
    named = next((x for x in reversed(words[:cut]) if x[0] == "name"), None)
    return named and (named[1], named[2])


def symbols_of(text: str) -> list[tuple[str, str, int, int, str, str]]:
    """(name, kind, line, end line, scope, kind of scope) of a file's functions, prototypes, classes, structs, enums, typedefs and macros, by line.

    A scope is all its names joined by `::`. What never closes ends with the file.
    """
    found: list[list] = []
    frames: list[tuple[str, str, int, list]] = []  # (kind, name, place of its symbol or -1, the head that goes on after it)
    head: list = []
    held = 0  # open brackets of the head
    last = 1

    def add(name: str, kind: str, line: int, qualifiers: list[str] = ()) -> int:
        named = [f for f in frames if f[1]]
        scope = "::".join([*(f[1] for f in named), *qualifiers])
        found.append([name, kind, line, 0, scope, "class" if qualifiers else named[-1][0] if named else ""])
        return len(found) - 1

    for kind, x, line in _pieces(text):
        last = line
        if kind == "define":
            add_at = len(found)
            found.append([x, "macro", line, line, "", ""])
        elif kind == "end":
            found[add_at][3] = line
        elif frames and frames[-1][0] == "body":
            if x == "{":
                frames.append(("body", "", -1, []))
            elif x == "}":
                *_, place, head = frames.pop()
                if place >= 0:
                    found[place][3] = line
        elif x == "{" and not held:
            frame, name, at, qualifiers, stays = _opened(head)
            symbol = add(name, frame, at, qualifiers) if name and frame in ("class", "struct", "enum", "function") else -1
            inner = "body" if frame in ("function", "enum", "init") else frame
            frames.append((inner, name if inner not in ("body", "block") else "", symbol, [*head, ("type", "{}", line)] if stays else []))
            head = []
        elif x == "}" and not held:
            head = []
            if frames:
                *_, place, head = frames.pop()
                if place >= 0:
                    found[place][3] = line
        elif x == ";" and not held:
            head = _without_angles(head)
            if head:
                told = None
                if any(y == "typedef" for _, y, _ in head[:2]) or head[0][1] == "using":
                    told = _renamed(head)
                    if told:
                        found[add(told[0], "typedef", told[1])][3] = line
                elif head[0][1] not in ("friend", "return", "goto") and (told := _callee(head)):
                    first = head[_outer(head, "(") + 1]
                    if _outer(head, "(") > 0 and first[0] not in ("num", "str") and (_outer(head, "(") > 1 or told[0].startswith("~") or any(told[0] == f[1] for f in frames[-1:])):
                        found[add(told[0], "prototype", told[2], told[1])][3] = line
            head = []
        elif x == ":" and not held and len(head) <= 2 and head and head[0][1] in _ACCESS:
            head = []
        else:
            held = max(0, held + (x in ("(", "[")) - (x in (")", "]")))
            if held and x == "{":
                held += 1
            elif held and x == "}":
                held -= 1
            head.append((kind, x, line))
    for *_, place, _ in frames:
        if place >= 0:
            found[place][3] = last
    return sorted((tuple(x) for x in found), key=lambda x: (x[2], x[3], x[0]))


def _opened(head: list) -> tuple[str, str, int, list[str], bool]:
    """(kind of frame, name, line, qualifiers, whether the head goes on after the brace) for a head that a brace ends."""
    head = _without_angles(head)
    words = [x for _, x, _ in head]
    if "namespace" in words[:2]:
        named = [x for x in head[words.index("namespace") + 1 :] if x[0] == "name"]
        return "namespace", "::".join(x[1] for x in named), 0, [], False
    if words[:1] == ["extern"] and len(words) == 2:
        return "block", "", 0, [], False
    told = _callee(head)
    if told:
        colon = _outer(head, ":")
        close = max((i for i, x in enumerate(words) if x == ")"), default=-1)
        if colon >= 0 and colon < len(head) - 1 and (head[-1][0] == "name" or words[-1] == ">") and close < len(head) - 1 and words[-1] not in ("const", "override", "final", "noexcept"):
            return "init", "", 0, [], True  # a member that is initialised with braces
        return "function", told[0], told[2], told[1], False
    typed = _typed(head)
    if typed and _outer(head, "=") < 0:
        kind, name, line = typed
        return kind, name, line, [], True
    return "init", "", 0, [], True


def symbols(files: DataFrame) -> DataFrame:
    """(file, name, kind, line, end_line, class, scope_kind) of the definitions in files (file, text); null texts have none."""
    bounded_batches(files.sparkSession)
    names = ["file", "name", "kind", "line", "end_line", "class", "scope_kind"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for file, text in zip(p["file"], p["text"], strict=True):
                rows = symbols_of(text) if text else []
                if rows:
                    yield pd.DataFrame([(file, *r) for r in rows], columns=names)

    return files.select("file", "text").mapInPandas(read, "file string, name string, kind string, line long, end_line long, class string, scope_kind string")


def enclosing(probes: DataFrame, ranges: DataFrame, step: int = 256) -> DataFrame:
    """probes (file, line, other columns) with `inner`: the struct of the other columns of the innermost range (file, start, end, ...) around the line, null if none.

    Ranges of a file must be nested or apart. A sweep over each file's lines, cut into buckets of `step`: opening ranges raise a
    running depth, closing ones lower it, and a probe's range is the last one that opened to the probe's depth. A
    range stands in every bucket that it touches, so no task gets a long file whole and ranges never meet lines in pairs.
    """
    keep = [c for c in ranges.columns if c not in ("file", "start", "end")]
    r = ranges.filter("end >= start").select("file", "start", "end", F.struct("start", "end", *keep).alias("x"))
    bucket = F.explode(F.sequence(F.floor(F.col("start") / step), F.floor(F.col("end") / step)))
    r = r.withColumn("b", bucket).select("file", "b", F.greatest("start", F.col("b") * step).alias("s"), F.least("end", (F.col("b") + 1) * step - 1).alias("e"), "x")
    row = F.struct(*probes.columns)
    none_x, none_p = F.lit(None).cast(r.schema["x"].dataType), F.lit(None).cast(probes.select(row.alias("p")).schema["p"].dataType)
    # In order on a line: openings, the outer ones first; probes; closings.
    opens = r.select("file", "b", F.col("s").alias("at"), F.lit(0).alias("k"), F.col("x.start").alias("o1"), (-F.col("x.end")).alias("o2"), F.lit(1).alias("up"), "x", none_p.alias("p"))
    closes = r.select("file", "b", F.col("e").alias("at"), F.lit(2).alias("k"), F.lit(0).cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"), F.lit(-1).alias("up"), none_x.alias("x"), none_p.alias("p"))
    asked = probes.select("file", F.floor(F.col("line") / step).alias("b"), F.col("line").alias("at"), F.lit(1).alias("k"), F.lit(0).cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"), F.lit(0).alias("up"), none_x.alias("x"), row.alias("p"))
    every = opens.unionByName(closes).unionByName(asked)
    order = ["at", "k", "o1", "o2"]
    so_far = Window.partitionBy("file", "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("depth", F.sum("up").over(so_far))
    same = Window.partitionBy("file", "b", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = F.when(F.col("depth") > 0, F.last("x", ignorenulls=True).over(same))
    return every.withColumn("inner", inner).filter("k = 1").select("p.*", "inner")
