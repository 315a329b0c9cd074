"""Small display formatters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from girderframe.schema import EMPTY_GUID

ALL = "(All)"


def level_badge(level: Column) -> Column:
    return F.concat(F.lit("L"), level.cast("string"))


def group_header(name: Column, count: Column) -> Column:
    return F.concat(F.coalesce(name, F.lit("")), F.lit(" ("), count.cast("string"), F.lit(" props)"))


def group_code(group_id: Column) -> Column:
    return F.format_string("G%03d", group_id)


def mesh_uri(object_id: Column, folder: str = "mesh") -> Column:
    """Relative mesh path; NULL for the empty id."""
    usable = (object_id != EMPTY_GUID) & (object_id != "")
    return F.when(usable, F.concat(F.lit(f"{folder}/"), object_id, F.lit(".glb")))


def property_text(category: Column, name: Column, value: Column) -> Column:
    return F.concat(category, F.lit(": "), name, F.lit(" = "), value)


def short_property_text(name: Column, value: Column) -> Column:
    return F.concat(name, F.lit(": "), value)


def filter_file_name(level: str = "", category: str = "", name: str = "", value: str = "") -> str:
    """File name made of the active filter settings."""
    parts = [level if level != ALL else "", (category if category != ALL else "").replace(" ", "_")]
    parts += [name.replace(" ", "_"), value.replace(" ", "_")]
    return "_".join(p for p in parts if p) or "Snapshot"
