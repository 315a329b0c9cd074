"""Small text helpers shared by the functions and operators."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(c: Column) -> Column:
    """True for NULL, empty and whitespace-only text (Unicode whitespace)."""
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def is_empty(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True))


def null_if_blank(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def strip(c: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def contains_ci(c: Column, needle: str) -> Column:
    """Literal, case-insensitive substring test; NULL counts as no match."""
    return F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))


def any_contains_ci(columns: list[Column], needle: str) -> Column:
    return reduce(or_, [contains_ci(c, needle) for c in columns])


def contains_any_ci(c: Column, needles: list[str]) -> Column:
    low = F.lower(c)
    return F.coalesce(
        reduce(or_, [F.contains(low, F.lit(n.lower())) for n in needles]), F.lit(False)
    )


def path_parts(path: Column) -> Column:
    """Non-empty parts of a ``/`` or backslash separated path."""
    return F.filter(F.split(path, r"[/\\]"), lambda p: p != "")


def fixed(c: Column, digits: int) -> Column:
    """Text with a fixed number of decimals; NULL stays NULL."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c))


def csv_cell(c: Column) -> Column:
    """One CSV cell: quoted when it holds a comma, quote or line break; NULL becomes empty."""
    doubled = F.replace(c, F.lit('"'), F.lit('""'))
    return F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), doubled, F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
