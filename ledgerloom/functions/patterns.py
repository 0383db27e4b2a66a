"""Regular-expression helpers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the stretch by which a pattern is looked up.
GRAM = 4


def matches_any(column: str, patterns: Sequence[str]) -> Column:
    """True where the column holds a match of at least one pattern, anywhere in it.

    All patterns go into one alternation, so a row is read once. Null text
    matches nothing. An empty list matches nothing (an empty alternation would
    match everything).
    """
    if not patterns:
        return F.lit(False)
    return F.coalesce(F.col(column).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def required_literals(pattern: str) -> list[str]:
    """Stretches of ASCII signs that every match holds, in lower case; none where that is not plain to see.

    Looks at what stands outside groups and classes. A sign that may be missing
    ends a stretch; alternatives outside groups leave none, and so do modes
    other than ``(?i)`` at the start, quoting by ``\\Q`` and escapes of several
    signs.
    """
    rest = pattern.removeprefix("(?i)")
    out, run, depth, i = [], "", 0, 0
    while i < len(rest):
        c = rest[i]
        i += 1
        literal = None
        if c == "\\":
            if i == len(rest) or rest[i] in "QxupPkcN0123456789":
                return []
            literal = None if rest[i].isalnum() else rest[i]
            i += 1
        elif c == "[":
            if rest[i : i + 1] == "^":
                i += 1
            level, first = 1, True
            while i < len(rest) and level:
                if rest[i] == "\\":
                    if rest[i + 1 : i + 2] == "Q":
                        return []
                    i += 1
                elif rest[i] == "[":
                    level += 1
                elif rest[i] == "]" and not first:
                    level -= 1
                first = False
                i += 1
        elif c == "(":
            if rest[i : i + 1] == "?" and rest[i + 1 : i + 2] not in (":", "=", "!", "<", ">"):
                return []  # a mode that changes how the rest is read
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|":
            if depth == 0:
                return []
        elif c not in ".^$*+?{}":
            literal = c
        elif c == "{":
            while i < len(rest) and rest[i] != "}":
                i += 1
            i += 1
        follows = rest[i : i + 1]
        if literal is not None and depth == 0 and literal.isascii() and follows not in ("*", "?", "{"):
            run += literal.lower()
            if follows != "+":
                continue
        if run:
            out.append(run)
        run = ""
    return [*out, run] if run else out


def index_of(patterns: Sequence[str]) -> tuple[list[tuple[int, str, str]], list[tuple[int, str]]]:
    """((number, pattern, gram) of patterns whose matches all hold the gram, (number, pattern) of the others).

    Of a pattern's grams that is taken which the fewest patterns have.
    """
    grams = [{x[i : i + GRAM] for x in required_literals(p) for i in range(len(x) - GRAM + 1)} for p in patterns]
    often = Counter(g for own in grams for g in own)
    known = [(i, p, min(own, key=lambda g: (often[g], g))) for i, (p, own) in enumerate(zip(patterns, grams, strict=True)) if own]
    return known, [(i, p) for i, (p, own) in enumerate(zip(patterns, grams, strict=True)) if not own]


def grams_of(column: str) -> Column:
    """The distinct grams of the text in lower case; none for null."""
    found = F.regexp_extract_all(F.lower(F.col(column)), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))
