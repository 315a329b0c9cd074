"""Property rows: filters, search, grouping, pivot, facets and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderframe.functions import formats
from girderframe.functions.text import any_contains_ci, contains_ci, csv_cell, is_empty
from girderframe.operators.numbering import global_row_number
from girderframe.schema import EMPTY_GUID
from girderframe.session import stored

IDENTITY = ["parent_id", "level", "display_name", "sys_path"]
DETAILS = [
    "category", "property_name", "property_value", "data_type", "raw_value",
    "numeric_value", "unit", "rw_status", "is_selected",
]


def _text_filters(name: str | None, value: str | None) -> Column:
    test = F.lit(True)
    if name:
        test = test & contains_ci(F.col("property_name"), name)
    if value:
        test = test & contains_ci(F.col("property_value"), value)
    return test


def filter_rows(
    df: DataFrame,
    level: int | str | None = None,
    path: str | None = None,
    category: str | None = None,
    name: str | None = None,
    value: str | None = None,
) -> DataFrame:
    """Five-way filter; empty settings and ``(All)`` are off. Level may be 2 or ``L2``."""
    test = _text_filters(name, value)
    if level not in (None, "", formats.ALL):
        number = int(str(level).lstrip("L"))
        test = test & (F.col("level") == number)
    if path:
        test = test & contains_ci(F.col("sys_path"), path)
    if category not in (None, "", formats.ALL):
        test = test & (F.col("category") == category)
    return df.filter(test)


def filter_groups(
    df: DataFrame,
    levels: list[int] | None = None,
    categories: list[str] | None = None,
    name: str | None = None,
    value: str | None = None,
) -> DataFrame:
    """Grouped filter on property rows; objects left without rows disappear.

    No level or category checked means no such filter. Regroup with ``group_objects``.
    """
    test = _text_filters(name, value)
    if levels:
        test = test & F.col("level").isin(levels)
    if categories:
        test = test & F.col("category").isin(categories)
    return df.filter(test)


def search(df: DataFrame, query: str) -> DataFrame:
    """Substring search over name, value, property name and path; blank finds all rows."""
    if not query.strip():
        return df
    fields = ["display_name", "property_value", "property_name", "sys_path"]
    return df.filter(any_contains_ci([F.col(c) for c in fields], query))


def filter_table(df: DataFrame, text: str, column: str | None = None) -> DataFrame:
    """Text filter on one column, or on any column of a generic table."""
    if not text.strip():
        return df
    names = [column] if column and column != "(All Columns)" else df.columns
    return df.filter(any_contains_ci([F.col(f"`{c}`").cast("string") for c in names], text))


def find_by_property(df: DataFrame, category: str, name: str, value: str) -> DataFrame:
    """Distinct objects that carry exactly this property value."""
    test = (F.col("category") == category) & (F.col("property_name") == name) & (F.col("property_value") == value)
    return df.filter(test).select("object_id").distinct()


def select_rows(df: DataFrame, selected_objects: DataFrame) -> DataFrame:
    """Mark rows selected when the row or its object is selected."""
    marks = selected_objects.select("object_id").distinct().withColumn("_group", F.lit(True))
    own = F.coalesce("is_selected", F.lit(False)) if "is_selected" in df.columns else F.lit(False)
    return (
        df.join(marks, "object_id", "left")
        .withColumn("is_selected", own | F.col("_group").isNotNull())
        .drop("_group")
    )


def selected_rows(df: DataFrame, selected_objects: DataFrame) -> DataFrame:
    return select_rows(df, selected_objects).filter("is_selected")


def object_ids(df: DataFrame) -> DataFrame:
    """Distinct non-empty object ids."""
    usable = F.col("object_id").isNotNull() & ~F.col("object_id").isin("", EMPTY_GUID)
    return df.select("object_id").filter(usable).distinct()


def hidden_by_show_only(everything: DataFrame, kept: DataFrame) -> DataFrame:
    """Objects to hide when only ``kept`` stays visible."""
    return object_ids(everything).join(kept.select("object_id"), "object_id", "left_anti")


def leaf_geometry(geometry: DataFrame) -> DataFrame:
    """Boxes that take part in adjacency: no skipped containers, nothing hidden."""
    quality = F.coalesce("mesh_quality", F.lit(""))
    return geometry.filter(~quality.isin("skipped_container", "hidden"))


def supplement_targets(geometry: DataFrame, containers: DataFrame) -> DataFrame:
    """Objects whose mesh needs a second source."""
    partial = containers.filter(F.col("container_status") == "partial_container").select("object_id")
    gaps = geometry.filter(F.col("mesh_quality") == "gap_supplemented")
    bare = geometry.filter(F.col("mesh_quality") == "no_geometry").join(partial, "object_id", "left_semi")
    return gaps.withColumn("target_kind", F.lit("gap")).unionByName(
        bare.withColumn("target_kind", F.lit("partial_no_geometry"))
    )


def in_window(geometry: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Objects inside an XY window; the plain range tests reach the scan."""
    return geometry.filter(
        (F.col("min_x") >= min_x) & (F.col("max_x") <= max_x) & (F.col("min_y") >= min_y) & (F.col("max_y") <= max_y)
    )


def group_objects(df: DataFrame, extras: dict[str, Column] | None = None) -> DataFrame:
    """One row per object with its property array in extraction order, at any size.

    ``extras`` are further aggregates over the object. ``property_chunks`` gives the same
    properties as a long table for objects too large for one row.
    """
    extras = extras or {}
    identity = [c for c in IDENTITY if c in df.columns]
    details = [c for c in DETAILS if c in df.columns]
    grouped = df.groupBy("object_id").agg(
        F.min_by(F.struct(*identity), "seq").alias("_identity"),
        *[c.alias(n) for n, c in extras.items()],
        F.array_sort(F.collect_list(F.struct("seq", *details))).alias("properties"),
        F.array_sort(F.collect_set(F.nullif(F.col("category"), F.lit("")))).alias("categories"),
    )
    return grouped.select("object_id", "_identity.*", "properties", "categories", F.size("properties").alias("property_count"), *extras)


def property_chunks(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """(object_id, chunk, properties): the properties of every object in arrays of about ``rows``.

    Chunks are even slices by a hash of the row, however uneven ``seq`` is; inside a chunk the
    properties are in extraction order. Counts are combined before the shuffle.
    """
    details = [c for c in DETAILS if c in df.columns]
    counts = df.groupBy("object_id").agg(F.ceil(F.count(F.lit(1)) / rows).alias("_chunks"))
    placed = df.join(counts, "object_id").withColumn("chunk", F.pmod(F.xxhash64("seq", *details), F.col("_chunks")).cast("int"))
    return placed.groupBy("object_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("seq", *details))).alias("properties"))


def ungroup(groups: DataFrame) -> DataFrame:
    """Back from grouped objects to property rows."""
    identity = [c for c in IDENTITY if c in groups.columns]
    marks = ["is_selected"] if "is_selected" in groups.columns else []
    rows = groups.select("object_id", *identity, *[F.col(c).alias("_group") for c in marks], F.explode("properties").alias("_entry"))
    rows = rows.select("object_id", *identity, *["_group" for _ in marks], "_entry.*")
    if marks:
        own = F.coalesce("is_selected", F.lit(False)) if "is_selected" in rows.columns else F.lit(False)
        rows = rows.withColumn("is_selected", F.coalesce("_group", F.lit(False)) | own).drop("_group")
    return rows


def properties_json(properties: Column) -> Column:
    """JSON array of the grouped properties; numericValue is written even when null."""
    names = {
        "category": "category", "name": "property_name", "value": "property_value", "rawValue": "raw_value",
        "dataType": "data_type", "numericValue": "numeric_value", "unit": "unit",
    }

    def entry(p: Column) -> Column:
        fields = [
            (p[src] if key == "numericValue" else F.coalesce(p[src], F.lit(""))).alias(key)
            for key, src in names.items()
        ]
        return F.struct(*fields)

    return F.to_json(F.transform(properties, entry), {"ignoreNullFields": "false"})


class TooManyColumns(ValueError):
    """The wide form would have more columns than allowed."""


def pivot_keys(df: DataFrame, max_columns: int) -> list[str]:
    """Sorted ``Category|PropertyName`` keys; raises when there are more than allowed."""
    key = F.concat_ws("|", F.coalesce("category", F.lit("")), F.coalesce("property_name", F.lit("")))
    rows = df.select(key.alias("k")).distinct().limit(max_columns + 1).collect()
    if len(rows) > max_columns:
        raise TooManyColumns(f"more than {max_columns} property columns; raise max_columns or filter first")
    return sorted(r["k"] for r in rows)


def pivot_wide(df: DataFrame, max_columns: int = 5000) -> DataFrame:
    """One row per object, one column per ``Category|PropertyName``; the last value wins."""
    keys = pivot_keys(df, max_columns)
    key = F.concat_ws("|", F.coalesce("category", F.lit("")), F.coalesce("property_name", F.lit("")))
    identity = [c for c in ("parent_id", "level", "display_name") if c in df.columns]
    first = df.groupBy("object_id").agg(F.min_by(F.struct(*identity), "seq").alias("_first"))
    cells = df.groupBy("object_id", key.alias("_key")).agg(
        F.max_by(F.coalesce("property_value", F.lit("")), "seq").alias("_value")
    )
    wide = cells.groupBy("object_id").pivot("_key", keys).agg(F.first("_value"))
    values = [F.coalesce(F.col(f"`{k}`"), F.lit("")).alias(k) for k in keys]
    return first.join(wide, "object_id").select("object_id", "_first.*", *values)


def wide_lines(df: DataFrame, block_columns: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The wide form at any width, in blocks of at most ``block_columns`` property columns: (lines, columns).

    ``lines`` (block, object_id, line) has one CSV line for every object in every block: the object's id, in the
    first block its parent, level and name, and its values in the order of the columns. ``columns`` (block,
    no, name) has the sorted columns. The plan does not grow with the columns, and a line is put together
    from the values that the object has, with empty cells between them.
    """
    key = F.concat_ws("|", F.coalesce("category", F.lit("")), F.coalesce("property_name", F.lit("")))
    identity = [c for c in ("parent_id", "level", "display_name") if c in df.columns]
    objects = stored(df.groupBy("object_id").agg(F.min_by(F.struct(*identity), "seq").alias("_first")).select("object_id", "_first.*"), "objects")
    last = stored(df.groupBy("object_id", key.alias("name")).agg(F.max_by(F.coalesce("property_value", F.lit("")), "seq").alias("value")), "cells")
    names = stored(global_row_number(last.select("name").distinct(), [F.col("name")], "row_no"), "names")
    total = names.count()
    blocks = max(1, -(-total // block_columns))
    at = F.col("row_no") - 1
    columns = names.select(F.floor(at / block_columns).cast("int").alias("block"), (at % block_columns).cast("int").alias("no"), "name")
    # At most block_columns values of one object are together.
    cells = last.join(columns, "name").groupBy("object_id", "block").agg(F.array_sort(F.collect_list(F.struct("no", "value"))).alias("cells"))
    every = objects.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    joined = every.join(cells, ["object_id", "block"], "left")
    width = F.least(F.lit(block_columns), F.lit(total) - F.col("block") * block_columns)
    found = F.coalesce("cells", F.array().cast("array<struct<no:int,value:string>>"))
    commas = lambda n: F.repeat(F.lit(","), n.cast("int"))
    body = F.array_join(F.transform(found, lambda c, i: F.concat(commas(c["no"] - F.coalesce(F.get(found, i - 1)["no"], F.lit(0))), csv_cell(c["value"]))), "")
    body = F.concat(body, commas(width - 1 - F.coalesce(F.get(found, F.size(found) - 1)["no"], F.lit(0))))
    own = F.concat_ws(",", csv_cell(F.col("object_id")), *[F.when(F.col("block") == 0, csv_cell(F.col(c).cast("string"))) for c in identity])
    line = F.when(width > 0, F.concat(own, F.lit(","), body)).otherwise(own)
    return joined.select("block", "object_id", line.alias("line")), columns


def unpivot_wide(wide: DataFrame) -> DataFrame:
    """Back from the wide form to property rows; empty cells carry no row."""
    identity = [c for c in ("object_id", "parent_id", "level", "display_name") if c in wide.columns]
    values = [f"`{c}`" for c in wide.columns if c not in identity]
    split = F.split("_key", r"\|", 2)
    return (
        wide.unpivot(identity, values, "_key", "property_value")
        .filter(F.col("property_value") != "")
        .select(*identity, split[0].alias("category"), split[1].alias("property_name"), "property_value")
    )


def level_facet(df: DataFrame) -> DataFrame:
    """Objects per level."""
    return (
        df.select("object_id", "level").distinct().groupBy("level").agg(F.count(F.lit(1)).alias("n"))
        .select(formats.level_badge(F.col("level")).alias("name"), "level", "n")
        .orderBy("level")
    )


def category_facet(df: DataFrame) -> DataFrame:
    """Objects that have at least one property of the category."""
    return (
        df.filter(~is_empty(F.col("category"))).select("object_id", "category").distinct()
        .groupBy("category").agg(F.count(F.lit(1)).alias("n"))
        .orderBy("category")
    )


def category_rows(df: DataFrame, top: int = 10) -> DataFrame:
    """Row counts of the largest categories, with one row for the remainder."""
    counts = df.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    head = counts.orderBy(F.desc("n"), "category").limit(top)
    rest = counts.join(head.select("category"), "category", "left_anti").agg(
        F.count(F.lit(1)).alias("categories"), F.sum("n").alias("n")
    )
    remainder = rest.filter("categories > 0").select(
        F.concat(F.lit("... and "), F.col("categories").cast("string"), F.lit(" more categories")).alias("category"), "n"
    )
    return head.unionByName(remainder)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values of a column, ordered."""
    c = F.col(column)
    return df.filter(c.isNotNull() & (c.cast("string") != "")).select(column).distinct().orderBy(column)


def object_headers(df: DataFrame) -> DataFrame:
    """Per object: name, level, property and category counts, header text; level then name order."""
    return (
        df.groupBy("object_id", F.coalesce("category", F.lit("")).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("seq", "level", "display_name"), "seq").alias("first"))
        .groupBy("object_id")
        .agg(F.sum("n").alias("property_count"), F.count(F.lit(1)).alias("category_count"), F.min("first").alias("first"))
        .select(
            "object_id", "first.level", "first.display_name", "property_count", "category_count",
            formats.group_header(F.col("first.display_name"), F.col("property_count")).alias("header"),
        )
        .orderBy("level", "display_name", "object_id")
    )


def first_rows(df: DataFrame, key: str = "object_id") -> DataFrame:
    """First row per key in extraction order."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*others), "seq").alias("_r")).select(key, "_r.*")


def last_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """Last row per key in extraction order: the last write wins."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), "seq").alias("_r")).select(*key, "_r.*")


def indexed_properties(df: DataFrame) -> DataFrame:
    """Flat selected properties with a 1-based index of their object, in extraction order."""
    firsts = df.groupBy("object_id").agg(F.min("seq").alias("_first"))
    numbered = global_row_number(firsts, [F.col("_first"), F.col("object_id")], "object_index")
    return df.join(numbered.select("object_id", "object_index"), "object_id").select(
        "category", F.col("property_name").alias("name"), F.col("property_value").alias("value"),
        "object_index", F.col("display_name").alias("object_name"), "seq",
    )


def totals(df: DataFrame) -> DataFrame:
    """Groups, properties and whole average of properties per group."""
    per_object = df.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    return per_object.agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("properties"),
        F.floor(F.try_divide(F.sum("n"), F.count(F.lit(1)))).alias("average"),
    )


def selection_summary(filtered: DataFrame, selected_objects: DataFrame) -> DataFrame:
    """Filtered and selected groups and properties, with the display text."""
    marks = selected_objects.select("object_id").distinct().withColumn("selected", F.lit(True))
    per_object = filtered.groupBy("object_id").agg(F.count(F.lit(1)).alias("n")).join(marks, "object_id", "left")
    chosen = F.col("selected").isNotNull()
    return per_object.agg(
        F.count(F.lit(1)).alias("filtered_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("filtered_properties"),
        F.count_if(chosen).alias("selected_groups"),
        F.coalesce(F.sum(F.when(chosen, F.col("n"))), F.lit(0)).alias("selected_properties"),
    ).withColumn("summary", F.format_string("%d groups (%d props)", "selected_groups", "selected_properties"))


def union_models(models: dict[str, DataFrame]) -> DataFrame:
    """Rows of several models, tagged with their source."""
    out = None
    for source, frame in models.items():
        tagged = frame.withColumn("source_id", F.lit(source))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
