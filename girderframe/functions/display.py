"""Typed display strings: ``Type: number unit``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderframe.functions.text import is_blank, strip

# Accepted spellings (lower case) of each unit.
UNIT_SPELLINGS = {
    "m": ["m", "meter", "meters"],
    "mm": ["mm", "millimeter", "millimeters"],
    "cm": ["cm", "centimeter", "centimeters"],
    "ft": ["ft", "foot", "feet"],
    "in": ["in", "inch", "inches"],
    "sq m": ["sq m", "m²", "square meter", "square meters"],
    "sq ft": ["sq ft", "ft²", "square foot", "square feet"],
    "sq mm": ["sq mm", "mm²"],
    "cu m": ["cu m", "m³", "cubic meter", "cubic meters"],
    "cu ft": ["cu ft", "ft³", "cubic foot", "cubic feet"],
    "deg": ["°", "deg", "degree", "degrees"],
    "rad": ["rad", "radian", "radians"],
}

# U: Unicode classes, d: only \n ends a line, i: exponent in either case.
_PREFIXED = r"(?Ud)^(\w+):\s*(.*)$"
_NUMBER_UNIT = r"(?Udi)^(-?\d+\.?\d*(?:E[+-]?\d+)?)\s*(.*)$"
_PLAIN_NUMBER = r"(?i)^\s*[+-]?(\d[\d,]*\.?\d*|\.\d+)(E[+-]?\d+)?\s*$"


def normalize_unit(unit: Column) -> Column:
    """Canonical unit, or the text as written when the spelling is unknown."""
    low = F.lower(unit)
    chain = F.when(is_blank(unit), F.lit(""))
    for canonical, spellings in UNIT_SPELLINGS.items():
        chain = chain.when(low.isin(spellings), F.lit(canonical))
    return chain.otherwise(unit)


def data_type_of(text: Column) -> Column:
    prefix = F.regexp_extract(text, _PREFIXED, 1)
    return F.when(is_blank(text), F.lit("")).otherwise(
        F.when(prefix != "", prefix).otherwise(F.lit("Unknown"))
    )


def raw_value_of(text: Column) -> Column:
    return F.when(is_blank(text), F.lit("")).otherwise(
        F.when(text.rlike(_PREFIXED), strip(F.regexp_extract(text, _PREFIXED, 2))).otherwise(text)
    )


def numeric_of_raw(raw: Column) -> Column:
    """Leading number of a raw value, else the whole text as a plain number."""
    leading = F.regexp_extract(raw, _NUMBER_UNIT, 1)
    plain = F.when(raw.rlike(_PLAIN_NUMBER), F.translate(raw, ", ", ""))
    special = F.when(F.trim(raw).isin("NaN", "Infinity", "-Infinity"), F.trim(raw))
    return F.when(leading != "", leading.try_cast("double")).otherwise(
        F.coalesce(plain, special).try_cast("double")
    )


def unit_of_raw(raw: Column) -> Column:
    return normalize_unit(strip(F.regexp_extract(raw, _NUMBER_UNIT, 2)))


def parse_display_string(text: Column) -> Column:
    """Struct of data_type, raw_value, numeric_value, unit and original_string."""
    raw = raw_value_of(text)
    return F.struct(
        data_type_of(text).alias("data_type"),
        raw.alias("raw_value"),
        numeric_of_raw(raw).alias("numeric_value"),
        unit_of_raw(raw).alias("unit"),
        F.coalesce(text, F.lit("")).alias("original_string"),
    )


def with_parsed(df: DataFrame, source: str = "property_value") -> DataFrame:
    """Add the parsed columns; the raw value is computed once per row."""
    text, raw = F.col(source), F.col("raw_value")
    kept = df.drop("data_type", "raw_value", "numeric_value", "unit")
    return (
        kept.withColumns({"data_type": data_type_of(text), "raw_value": raw_value_of(text)})
        .withColumns({"numeric_value": numeric_of_raw(raw), "unit": unit_of_raw(raw)})
    )


def is_numeric(text: Column) -> Column:
    return numeric_of_raw(raw_value_of(text)).isNotNull()


def is_measurement(text: Column) -> Column:
    raw = raw_value_of(text)
    return numeric_of_raw(raw).isNotNull() & (unit_of_raw(raw) != "")
