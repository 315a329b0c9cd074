"""Data-quality rules over property rows, and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderframe.functions.text import is_blank, is_empty
from girderframe.session import parts_for

# Unit patterns by kind, in the order they are listed.
UNIT_PATTERNS = [
    ("length", "mm", r"(?Ui)(\d+(?:\.\d+)?)\s*(mm|밀리미터)"),
    ("length", "m", r"(?Ui)(\d+(?:\.\d+)?)\s*(m|미터)(?!m)"),
    ("length", "ft", r"(?Ui)(\d+(?:\.\d+)?)\s*(ft|feet|피트)"),
    ("length", "in", r"(?Ui)(\d+(?:\.\d+)?)\s*(in|inch|인치)"),
    ("weight", "kg", r"(?Ui)(\d+(?:\.\d+)?)\s*(kg|킬로그램)"),
    ("weight", "lbm", r"(?Ui)(\d+(?:\.\d+)?)\s*(lbm|lb|파운드)"),
]

# The value pattern that each declared type must match.
TYPE_PATTERNS = {
    "Double": r"(?Ui)^Double:(-?\d+(?:\.\d+)?(?:E[+-]?\d+)?)$",
    "Int32": r"(?Ui)^Int32:(-?\d+)$",
    "Boolean": r"(?i)^Boolean:(True|False)$",
    "DisplayString": r"(?id)^DisplayString:(.*)$",
}

# Properties that must be present when the category is.
REQUIRED_PROPERTIES = {"Item": ["Name", "Type"], "항목": ["이름", "유형"]}

ISSUE_COLUMNS = [
    "object_id", "object_name", "issue_type", "severity", "category", "property_name", "details", "suggestion",
]


def add_required(required: dict[str, list[str]], category: str, name: str) -> dict[str, list[str]]:
    """A copy of the required-property table with one more entry."""
    names = list(required.get(category, []))
    if name not in names:
        names.append(name)
    return {**required, category: names}


def remove_required(required: dict[str, list[str]], category: str, name: str) -> dict[str, list[str]]:
    """A copy of the required-property table without the entry."""
    return {c: [n for n in names if (c, n) != (category, name)] for c, names in required.items()}


def _name_column(df: DataFrame) -> Column:
    return F.col("display_name") if "display_name" in df.columns else F.lit(None).cast("string")


def _unit_firsts() -> list[Column]:
    """First seq at which each unit pattern matches, per group."""
    value = F.col("property_value")
    return [
        F.min(F.when(value.rlike(pattern), F.col("seq"))).alias(f"_unit{i}")
        for i, (_, _, pattern) in enumerate(UNIT_PATTERNS)
    ]


def _units_in_order(kind: str) -> Column:
    """Units of the kind found in the group, in the order they first appear."""
    found = [
        F.when(F.col(f"_unit{i}").isNotNull(), F.struct(F.col(f"_unit{i}").alias("at"), F.lit(i).alias("no"), F.lit(unit).alias("unit")))
        for i, (k, unit, _) in enumerate(UNIT_PATTERNS)
        if k == kind
    ]
    return F.transform(F.array_sort(F.filter(F.array(*found), lambda u: u.isNotNull())), lambda u: u["unit"])


def _missing(required: dict[str, list[str]]) -> Column:
    """Array of the required names that the (object, category) group lacks."""
    chain = F
    for i, (category, names) in enumerate(required.items()):
        absent = F.array(*[F.when(~F.col(f"_req{i}_{j}"), F.lit(n)) for j, n in enumerate(names)])
        chain = chain.when(F.col("category") == category, F.filter(absent, lambda n: n.isNotNull()))
    return chain.otherwise(F.array().cast("array<string>")) if required else F.array().cast("array<string>")


def _required_flags(required: dict[str, list[str]]) -> list[Column]:
    name, value = F.lower(F.coalesce("property_name", F.lit(""))), F.col("property_value")
    return [
        F.max((name == wanted.lower()) & ~is_blank(value)).alias(f"_req{i}_{j}")
        for i, names in enumerate(required.values())
        for j, wanted in enumerate(names)
    ]


def type_mismatch() -> Column:
    """The declared type has a pattern and the value does not match it."""
    value, declared = F.col("property_value"), F.col("data_type")
    chain = F
    for name, pattern in TYPE_PATTERNS.items():
        chain = chain.when(declared == name, ~value.rlike(pattern))
    return ~is_empty(value) & F.coalesce(chain.otherwise(F.lit(False)), F.lit(False))


def unit_issues(df: DataFrame) -> DataFrame:
    """Different units of one kind inside one object and category."""
    groups = df.groupBy("object_id", "category").agg(*_unit_firsts())
    kinds = sorted({k for k, _, _ in UNIT_PATTERNS})
    found = F.array(*[F.struct(F.lit(k).alias("kind"), _units_in_order(k).alias("units")) for k in kinds])
    rows = groups.select("object_id", "category", F.explode(found).alias("f")).filter(F.size("f.units") > 1)
    names = first_names(df)
    return rows.join(names, "object_id").select(
        "object_id",
        "object_name",
        F.lit("UnitMismatch").alias("issue_type"),
        F.lit("Warning").alias("severity"),
        "category",
        F.lit("").alias("property_name"),
        F.concat("f.kind", F.lit(" 단위 혼용: "), F.array_join("f.units", ", ")).alias("details"),
        F.concat(F.lit("단위를 "), F.col("f.units")[0], F.lit("로 통일하세요")).alias("suggestion"),
    )


def first_names(df: DataFrame) -> DataFrame:
    """Display name of the first row per object, or Unknown."""
    return df.groupBy("object_id").agg(
        F.coalesce(F.min_by(F.struct(_name_column(df).alias("n")), "seq")["n"], F.lit("Unknown")).alias("object_name")
    )


def missing_issues(df: DataFrame, required: dict[str, list[str]] = REQUIRED_PROPERTIES) -> DataFrame:
    """Required properties that are absent or blank although their category is present."""
    relevant = df.filter(F.col("category").isin(list(required)))
    groups = relevant.groupBy("object_id", "category").agg(*_required_flags(required))
    rows = groups.select("object_id", "category", F.explode(_missing(required)).alias("property_name"))
    return rows.join(first_names(df), "object_id").select(
        "object_id",
        "object_name",
        F.lit("MissingProperty").alias("issue_type"),
        F.lit("Error").alias("severity"),
        "category",
        "property_name",
        F.concat(F.lit("필수 속성 '"), "property_name", F.lit("' 누락")).alias("details"),
        F.concat(
            F.lit("'"), "category", F.lit("' 카테고리에 '"), "property_name", F.lit("' 속성을 추가하세요")
        ).alias("suggestion"),
    )


def type_issues(df: DataFrame) -> DataFrame:
    """Values that do not have the form of their declared type."""
    rows = df.filter(type_mismatch())
    return rows.join(first_names(df), "object_id").select(
        "object_id",
        "object_name",
        F.lit("TypeMismatch").alias("issue_type"),
        F.lit("Warning").alias("severity"),
        "category",
        "property_name",
        F.concat(F.lit("데이터 타입 불일치: 선언="), "data_type", F.lit(", 값="), "property_value").alias("details"),
        F.concat(F.lit("값을 "), "data_type", F.lit(" 형식에 맞게 수정하세요")).alias("suggestion"),
    )


def all_issues(df: DataFrame, required: dict[str, list[str]] = REQUIRED_PROPERTIES) -> DataFrame:
    return unit_issues(df).unionByName(missing_issues(df, required)).unionByName(type_issues(df))


def report(df: DataFrame, required: dict[str, list[str]] = REQUIRED_PROPERTIES, rows_per_task: int = 1_000_000) -> DataFrame:
    """One row of totals: rows → (object, category) → object → totals.

    The rows are counted first and dealt out by object, so that a task groups about ``rows_per_task`` of them.
    """
    dealt = df.repartition(parts_for(df, rows_per_task, df.sparkSession.sparkContext.defaultParallelism), "object_id")
    per_category = dealt.groupBy("object_id", "category").agg(
        F.count(F.lit(1)).alias("rows"), *_unit_firsts(), *_required_flags(required),
        F.count_if(type_mismatch()).alias("type_warnings"),
    )
    kinds = sorted({k for k, _, _ in UNIT_PATTERNS})
    mixed = F.lit(0)
    for kind in kinds:
        mixed = mixed + F.when(F.size(_units_in_order(kind)) > 1, 1).otherwise(0)
    per_object = (
        per_category.select(
            "object_id", "rows", (mixed + F.col("type_warnings")).alias("warnings"), F.size(_missing(required)).alias("errors")
        )
        .groupBy("object_id")
        .agg(F.sum("rows").alias("rows"), F.sum("warnings").alias("warnings"), F.sum("errors").alias("errors"))
    )
    return per_object.agg(
        F.count(F.lit(1)).alias("total_objects"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_properties"),
        F.count_if((F.col("warnings") == 0) & (F.col("errors") == 0)).alias("valid_objects"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("warning_count"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("error_count"),
    )
