"""Stable object ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from girderframe.schema import EMPTY_GUID

GUID_PATTERN = r"(?i)^[{(]?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}[)}]?$"

# Property names that carry an authoring id, with the id prefix.
AUTHORING_NAMES = {
    "Element ID": "Revit:",
    "Id": "Revit:",
    "ElementId": "Revit:",
    "Handle": "AutoCAD:",
    "Object Handle": "AutoCAD:",
    "GlobalId": "IFC:",
    "IfcGlobalId": "IFC:",
}
ITEM_CATEGORIES = ["Item", "LcOaNode"]
GUID_NAMES = ["GUID", "Guid", "guid"]


def guid_from_md5(text: Column) -> Column:
    """GUID of the MD5 of the UTF-8 text; the first three groups are byte-reversed."""
    h = F.md5(text.cast("binary"))

    def pick(order: list[int]) -> list[Column]:
        return [F.substring(h, 2 * i + 1, 2) for i in order]

    return F.concat(
        *pick([3, 2, 1, 0]), F.lit("-"), *pick([5, 4]), F.lit("-"), *pick([7, 6]), F.lit("-"),
        F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12),
    )


def is_guid(text: Column) -> Column:
    return F.coalesce(text.rlike(GUID_PATTERN), F.lit(False))


def canonical_guid(text: Column) -> Column:
    """Lower-case hyphenated form of a GUID text; NULL when it is not one."""
    digits = F.lower(F.regexp_replace(text, r"[-{}()]", ""))
    spans = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.when(is_guid(text), F.concat_ws("-", *[F.substring(digits, a, n) for a, n in spans]))


def null_if_empty_guid(guid: Column) -> Column:
    return F.when((guid != EMPTY_GUID) & (guid != ""), guid)


def stable_id(instance: Column, item_guid: Column, authoring: Column, source: Column, path: Column) -> Column:
    """Instance id, else the item GUID, else a GUID of source and authoring id or path."""
    key = F.coalesce(F.when(authoring != "", authoring), path)
    return F.coalesce(
        null_if_empty_guid(instance),
        null_if_empty_guid(item_guid),
        guid_from_md5(F.concat_ws("|", F.coalesce(source, F.lit(EMPTY_GUID)), key)),
    )
