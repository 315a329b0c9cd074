"""Classification and extraction by the rule tables, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from girderframe.functions.text import contains_any_ci
from girderframe.sources import rules as R


def classify(category: Column, rules=R.CLASSIFICATION_RULES) -> Column:
    """Class of the first rule with a keyword inside the category; NULL when none fits."""
    chain = F
    for name, keywords in rules:
        chain = chain.when(contains_any_ci(category, keywords), F.lit(name))
    return chain.otherwise(F.lit(None).cast("string"))


def classify_path(path: Column, rules=R.PATH_RULES) -> Column:
    """Class of the highest-priority rule with a keyword inside the path; then rule order."""
    chain = F
    for name, _, keywords in sorted(rules, key=lambda r: -r[1]):
        chain = chain.when(contains_any_ci(path, keywords), F.lit(name))
    return chain.otherwise(F.lit(None).cast("string"))


def extract(path: Column, field: str, patterns=R.AREA_PATTERNS) -> Column:
    """First match of the field's pattern in the path; NULL when there is none."""
    return F.nullif(F.regexp_extract(path, patterns[field], 1), F.lit(""))


def level_order(name: Column, orders: dict[str, int] | None = None) -> Column:
    """Construction order of a level name; NULL for unknown names."""
    table = R.level_orders() if orders is None else orders
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), name)
