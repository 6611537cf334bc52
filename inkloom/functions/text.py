"""Regular expressions with Python's reading of Unicode, and rewriting of matches without user functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends of lines as str.splitlines has them.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def like(x: Column, pattern: str, flags: str = "") -> Column:
    return x.rlike(f"(?U{flags}){pattern}")


def sub(x: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(x, f"(?U{flags}){pattern}", by)


def group(x: Column, pattern: str, i: int = 1, flags: str = "") -> Column:
    return F.regexp_extract(x, f"(?U{flags}){pattern}", i)


def all_matches(x: Column, pattern: str, i: int = 0, flags: str = "") -> Column:
    return F.regexp_extract_all(x, F.lit(f"(?U{flags}){pattern}"), i)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank(x: Column) -> Column:
    return x.rlike(r"(?U)^\s*$")


def rewrite(x: Column, pattern: str, change: Callable[[Column], Column], flags: str = "") -> Column:
    """x with each match replaced by change(match): what stands between matches is joined with the changed matches."""
    between = F.split(x, f"(?U{flags})(?:{pattern})", -1)
    joined = F.zip_with(between, all_matches(x, pattern, 0, flags), lambda p, m: F.concat(p, F.coalesce(change(m), F.lit(""))))
    return F.when(like(x, pattern, flags), F.array_join(joined, "")).otherwise(x)


def pieces(x: Column, pattern: str, flags: str = "") -> Column:
    """What stands between matches and the matches in turn, the matches at odd places."""
    between = F.split(x, f"(?U{flags})(?:{pattern})", -1)
    pairs = F.zip_with(between, all_matches(x, pattern, 0, flags), lambda p, m: F.filter(F.array(p, m), lambda y: y.isNotNull()))
    return F.flatten(pairs)


def literal(text: str) -> str:
    """A pattern that matches text itself."""
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in text)


def one_of(words) -> str:
    return "|".join(literal(w) for w in sorted(words, key=lambda w: (-len(w), w)))
