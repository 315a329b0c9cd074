"""Schemas, constants and option records shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

EMPTY_GUID = "00000000-0000-0000-0000-000000000000"
SCHEMA_VERSION = "1.0.0"
PATH_SEPARATOR = " > "

BOX_COLUMNS = ["min_x", "min_y", "min_z", "max_x", "max_y", "max_z"]

PROPERTY_SCHEMA = T.StructType(
    [
        T.StructField("object_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("sys_path", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("property_name", T.StringType()),
        T.StructField("property_value", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("raw_value", T.StringType()),
        T.StructField("numeric_value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("rw_status", T.StringType()),
        T.StructField("is_selected", T.BooleanType()),
        T.StructField("seq", T.LongType()),
    ]
)

GEOMETRY_SCHEMA = T.StructType(
    [
        T.StructField("object_id", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("category", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in BOX_COLUMNS],
        T.StructField("has_mesh", T.BooleanType()),
        T.StructField("mesh_uri", T.StringType()),
        T.StructField("mesh_quality", T.StringType()),
        T.StructField("vertex_count", T.IntegerType()),
        T.StructField("triangle_count", T.IntegerType()),
        T.StructField("seq", T.LongType()),
    ]
)

SCHEDULE_COLUMNS = [
    "sync_id",
    "task_name",
    "planned_start",
    "planned_end",
    "actual_start",
    "actual_end",
    "cost",
    "task_type",
    "set_level",
    "parent_set",
    "progress",
    "custom",
]


class MatchStatus:
    PENDING = "Pending"
    MATCHED = "Matched"
    NOT_FOUND = "NotFound"
    ERROR = "Error"


@dataclass(frozen=True)
class ScheduleOptions:
    """Switches and thresholds of the schedule jobs."""

    enable_property_write: bool = True
    property_category: str = "AWP Schedule"
    overwrite_existing: bool = True
    match_category: str = "Element"
    match_property: str = "Id"
    ignore_case: bool = True
    enable_sets: bool = True
    grouping: str = "parent_set"
    set_root: str = "AWP 4D Sets"
    skip_empty_sets: bool = True
    enable_tasks: bool = True
    task_root: str = "AWP 4D Tasks"
    default_task_type: str = "Construct"
    hierarchical_tasks: bool = True
    link_mode: str = "selection_source"
    batch_size: int = 100
    continue_on_error: bool = True
    retry_count: int = 3
    dry_run: bool = False
    pre_checks: bool = True
    post_checks: bool = True
    min_match_rate: float = 80.0

    @classmethod
    def for_dry_run(cls) -> "ScheduleOptions":
        return cls(dry_run=True)

    @classmethod
    def for_production(cls) -> "ScheduleOptions":
        return cls(continue_on_error=False, overwrite_existing=False, min_match_rate=90.0)

    def with_changes(self, **changes) -> "ScheduleOptions":
        return replace(self, **changes)

    def errors(self) -> list[str]:
        """Messages for values outside their range; empty when all is well."""
        checks = [
            (bool(self.property_category.strip()), "property_category is blank"),
            (bool(self.set_root.strip()), "set_root is blank"),
            (1 <= self.batch_size <= 10000, "batch_size must lie in 1..10000"),
            (0 <= self.min_match_rate <= 100, "min_match_rate must lie in 0..100"),
            (0 <= self.retry_count <= 10, "retry_count must lie in 0..10"),
        ]
        return [message for ok, message in checks if not ok]
