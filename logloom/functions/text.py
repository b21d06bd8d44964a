"""Text normalisers. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ANSI = "\\x1b\\[[0-9;]*[A-Za-z]"


def plain(s: Column) -> Column:
    return F.regexp_replace(s, ANSI, "")


def strip(s: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def fold_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def clip(s: Column, n: int) -> Column:
    """At most n characters, the last one an ellipsis when something was cut."""
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def cut(s: Column, n: int) -> Column:
    return clip(fold_space(plain(s)), n)


def cut_prose(s: Column, n: int) -> Column:
    t = F.regexp_replace(plain(s), r"[^\S\n]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return clip(strip(F.regexp_replace(t, r"\n{3,}", "\n\n")), n)


def cut_markdown(s: Column, n: int) -> Column:
    t = F.regexp_replace(plain(s), r"(?m)[^\S\n]+$", "")
    return clip(strip(F.regexp_replace(t, r"\n{3,}", "\n\n")), n)


def headline(s: Column, n: int = 140) -> Column:
    """An opener on one line: over n characters keeps n of them plus an ellipsis."""
    t = fold_space(s)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def extract(s: Column, pattern: str, group: int = 1) -> Column:
    """regexp_extract that yields NULL, not '', when the pattern is absent."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))
