"""Pattern tables as column expressions.

A table is an ordered list; the first entry that matches wins, so it becomes one ``CASE`` in table
order. JavaScript patterns are translated to the JVM's dialect once, on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of JavaScript's \s beyond ASCII.
JS_SPACE = r"\t\n\x0B\f\r    -     　﻿"


def js_regex(source: str, flags: str = "") -> str:
    """A JavaScript pattern in the JVM's dialect: ``$``, ``\\s``, ``[`` inside classes, and flags."""
    out, i, in_class = [], 0, False
    while i < len(source):
        c = source[i]
        if c == "\\" and i + 1 < len(source):
            n = source[i + 1]
            if n == "s":
                out.append(JS_SPACE if in_class else f"[{JS_SPACE}]")
            elif n == "S" and not in_class:
                out.append(f"[^{JS_SPACE}]")
            elif n == "/":
                out.append("/")
            else:
                out.append(c + n)
            i += 2
            continue
        if in_class:
            if c == "[":
                out.append("\\[")
            elif c == "&" and source[i : i + 2] == "&&":
                out.append("\\&")
            else:
                out.append(c)
                in_class = c != "]"
        elif c == "[":
            in_class = True
            out.append(c)
            if source[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif c == "$" and "m" not in flags:
            out.append("\\z")
        else:
            out.append(c)
        i += 1
    mode = "".join(f for f in "ims" if f in flags)
    return (f"(?{mode})" if mode else "") + "".join(out)


def parse_literal(pattern: str) -> tuple[str, str] | None:
    """(source, flags) of a ``/source/flags`` pattern (flag g dropped), or None for plain text."""
    m = re.fullmatch(r"/(.+)/([gimsuy]*)", pattern, re.S)
    return (m[1], m[2].replace("g", "")) if m else None


def _valid(source: str) -> bool:
    try:
        re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", source))
        return True
    except re.error:
        return False


def matches(col: Column, pattern: str) -> Column:
    """Whether text matches ``/re/flags`` or contains the plain text; an invalid pattern is plain text."""
    lit = parse_literal(pattern)
    if lit and _valid(lit[0]):
        return F.coalesce(col.rlike(js_regex(*lit)), F.lit(False))
    return F.coalesce(F.contains(col, F.lit(pattern)), F.lit(False))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def matches_any(col: Column, patterns: Sequence[str]) -> Column:
    return any_of(matches(col, p) for p in patterns)


def matches_all(col: Column, patterns: Sequence[str]) -> Column:
    return all_of(matches(col, p) for p in patterns)


def matches_none(col: Column, patterns: Sequence[str]) -> Column:
    return ~matches_any(col, patterns)


def rx(source: str, flags: str = "i") -> str:
    return js_regex(source, flags)


def test(col: Column, source: str, flags: str = "i") -> Column:
    """Null-safe regular expression test; the ``i`` flag is on unless flags say otherwise."""
    return F.coalesce(col.rlike(js_regex(source, flags)), F.lit(False))


def test_any(col: Column, sources: Sequence[str], flags: str = "i") -> Column:
    """One disjunction as one pattern: a single pass over the text."""
    if not sources:
        return F.lit(False)
    return F.coalesce(col.rlike("|".join(f"(?:{js_regex(s, flags)})" for s in sources)), F.lit(False))


def first_match(cases: Sequence[tuple[Column, Any]], default: Any = None) -> Column:
    """The value of the first condition that holds, in table order."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = None
    for cond, value in cases:
        out = F.when(cond, as_col(value)) if out is None else out.when(cond, as_col(value))
    return as_col(default) if out is None else out.otherwise(as_col(default))


def classify(col: Column, table: Sequence[tuple[str, Any]], flags: str = "i", default: Any = None) -> Column:
    """First-match classification of a text by an ordered table of (pattern, value)."""
    return first_match([(test(col, p, flags), v) for p, v in table], default)


def matched_text(col: Column, sources: Sequence[str], flags: str = "i") -> Column:
    """What the first matching pattern of a table matched, or null."""
    found = [F.when(test(col, s, flags), F.regexp_extract(col, js_regex(s, flags), 0)) for s in sources]
    return F.coalesce(*found, F.lit(None).cast("string"))


def group(col: Column, source: str, n: int, flags: str = "i") -> Column:
    """Group n of the first match, or null."""
    return F.when(test(col, source, flags), F.regexp_extract(col, js_regex(source, flags), n))


def present(*values: Column) -> Column:
    """The non-null values, in order."""
    return F.filter(F.array(*values), lambda v: v.isNotNull())


def line_of(text: Column, found: Column) -> Column:
    """1-based line on which ``found`` first occurs in text; 1 if it doesn't."""
    before = F.call_function("substring_index", text, found, F.lit(1))
    inside = F.coalesce(F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))), F.lit(0))
    return F.when(found.isNull() | (found == ""), F.lit(1)).otherwise((inside + 1).cast("int"))


def glob_regex(pattern: str) -> str:
    """A file glob (``**``, ``*``, ``?``, ``{a,b}``, ``[..]``) as an anchored JVM pattern."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in pattern[i:]:
            end = pattern.index("]", i)
            out.append("[" + pattern[i + 1 : end].replace("!", "^", 1) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + r"\z"


def glob_any(path: Column, patterns: Sequence[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return F.coalesce(path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)), F.lit(False))
