"""Schedule and generic CSV readers."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girderframe.functions import scheduling
from girderframe.functions.text import is_blank, strip

# Accepted header spellings of each schedule column, compared without case.
HEADER_ALIASES = {
    "sync_id": ["SyncID", "동기화ID", "동기화 ID", "Sync ID", "ID", "객체ID", "ElementId", "Element ID", "UniqueId"],
    "task_name": ["TaskName", "작업명", "작업 이름", "Task Name", "Name", "이름", "공정명"],
    "planned_start": [
        "PlannedStartDate", "계획시작일", "계획 시작일", "Planned Start", "Start Date", "StartDate", "시작일", "시작",
    ],
    "planned_end": [
        "PlannedEndDate", "계획종료일", "계획 종료일", "Planned End", "End Date", "EndDate", "종료일", "종료",
    ],
    "actual_start": ["ActualStartDate", "실제시작일", "실제 시작일", "Actual Start"],
    "actual_end": ["ActualEndDate", "실제종료일", "실제 종료일", "Actual End"],
    "cost": ["Cost", "비용", "금액", "예산"],
    "task_type": ["TaskType", "작업유형", "작업 유형", "Task Type", "Type", "유형", "SimulationType"],
    "set_level": ["SetLevel", "그룹레벨", "그룹 레벨", "Level", "레벨", "GroupLevel"],
    "parent_set": ["ParentSet", "상위그룹", "상위 그룹", "Parent", "부모", "Zone", "영역"],
    "progress": ["Progress", "진행률", "진행", "완료율", "Percent"],
}

# Spellings that this package writes itself; left out by strict_aliases.
OWN_SPELLINGS = {
    "planned_start": "PlannedStart", "planned_end": "PlannedEnd",
    "actual_start": "ActualStart", "actual_end": "ActualEnd",
}

CSV_OPTIONS = {
    "header": "false",
    "quote": '"',
    "escape": '"',
    "multiLine": "false",
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
    "mode": "PERMISSIVE",
}


class ScheduleFileError(ValueError):
    """The file lacks rows or the sync id column."""


def alias_table(strict: bool = False) -> dict[str, str]:
    """Lower-case header spelling to column name."""
    table = {s.lower(): name for name, spellings in HEADER_ALIASES.items() for s in spellings}
    if not strict:
        table.update({s.lower(): name for name, s in OWN_SPELLINGS.items()})
    return table


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 or UTF-16 by byte order mark, UTF-8 if all lines are valid UTF-8, else EUC-KR.

    The lines of all files are tested where they lie; only the answer comes back.
    """
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("line"))
    first = lines.select(F.substring("line", 1, 2).alias("head")).limit(1).collect()
    head = bytes(first[0]["head"] or b"") if first else b""
    if head.startswith(b"\xff\xfe"):
        return "UTF-16LE"
    if head.startswith(b"\xfe\xff"):
        return "UTF-16BE"
    bad = lines.filter(~F.is_valid_utf8(F.col("line").cast("string")))
    return "UTF-8" if bad.isEmpty() else "EUC-KR"


_BUILT_IN_ENCODINGS = {"ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32", "UTF-8"}


def _allow_encoding(spark: SparkSession, encoding: str) -> None:
    """Spark reads other Java charsets, such as EUC-KR, only with this session setting."""
    if encoding.upper() not in _BUILT_IN_ENCODINGS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


# Python's names of the encodings.
_CODECS = {"UTF-8": "utf-8-sig", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "EUC-KR": "euc_kr"}


@dataclass(frozen=True)
class FileFacts:
    """What a reader must know of one file: its encoding and the cells of its first line that is not blank."""

    path: str
    encoding: str
    cells: tuple[str, ...]


def file_facts(spark: SparkSession, path: str, encoding: str | None = None) -> list[FileFacts]:
    """The facts of every file under ``path`` that has a line, by name.

    All lines are looked at where they lie: a file is UTF-16 by its byte order mark, UTF-8 if all of its lines
    are, else EUC-KR. One row for each file reaches the driver, which holds the list of files anyway.
    """
    value = F.col("value")
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), value.cast("binary").alias("line"), F.is_valid_utf8(value).alias("valid"),
        # Lines in their order within a file.
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("place"),
        (F.btrim(value, F.lit(" \t\r\x0b\x0c\x00\ufeff")) == "").alias("blank"),
    )
    facts = lines.groupBy("file").agg(
        F.min_by(F.substring("line", 1, 2), "place").alias("head"), F.bool_and("valid").alias("valid"),
        F.min_by("line", F.when(~F.col("blank"), F.col("place"))).alias("first"),
    )
    found = []
    for row in facts.filter("first IS NOT NULL").orderBy("file").collect():
        head = bytes(row["head"] or b"")
        marked = {b"\xff\xfe": "UTF-16LE", b"\xfe\xff": "UTF-16BE"}.get(head)
        name = encoding or marked or ("UTF-8" if row["valid"] else "EUC-KR")
        text = bytes(row["first"])
        text = text[: len(text) // 2 * 2] if name.startswith("UTF-16") else text
        text = text.decode(_CODECS.get(name, name), "replace").lstrip("\ufeff")
        cells = next(csv.reader([text], skipinitialspace=True), [])
        found.append(FileFacts(unquote(row["file"]), name, tuple(c.strip() for c in cells)))
    if not found:
        raise ScheduleFileError("the file is empty")
    return found


def header_cells(spark: SparkSession, path: str, encoding: str | None = None) -> list[str]:
    """Trimmed cells of the header: the first line that is not blank, of a folder that of the first file by name."""
    return list(file_facts(spark, path, encoding)[0].cells)


def table_columns(cells: list[str]) -> list[str]:
    """Column names: blank headers become ``Column{n}``, repeats get ``_1``, ``_2``, …"""
    names: list[str] = []
    taken: set[str] = set()
    for i, cell in enumerate(cells):
        name = cell or f"Column{i + 1}"
        if name.lower() in taken:
            suffix = 1
            while f"{name}_{suffix}".lower() in taken:
                suffix += 1
            name = f"{name}_{suffix}"
        taken.add(name.lower())
        names.append(name)
    return names


def _read_alike(spark: SparkSession, files: list[str], encoding: str, cells: Sequence[str], has_header: bool) -> DataFrame:
    """Files of one encoding and order of columns; a header is the first line by its place, whatever later lines say."""
    _allow_encoding(spark, encoding)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in table_columns(list(cells))])
    options = {**CSV_OPTIONS, "header": str(has_header).lower(), "enforceSchema": "true", "encoding": encoding}
    if encoding.startswith("UTF-16"):
        options["lineSep"] = "\n"  # cut at the two bytes of a line break, not at one
    literal = [re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in files]
    return spark.read.schema(schema).options(**options).csv(literal)


def _parts(spark: SparkSession, path: str, encoding: str | None, own_headers: bool, is_header) -> list[tuple[tuple[str, ...], DataFrame]]:
    """(header, rows) for every group of files that are alike, the first file's group ahead."""
    facts = file_facts(spark, path, encoding)
    first = facts[0].cells
    groups: dict[tuple, list[str]] = {}
    for f in facts:
        headed = own_headers or f.cells == first or sorted(f.cells) == sorted(first) or is_header(f.cells)
        groups.setdefault((f.encoding, f.cells if headed else first, headed), []).append(f.path)
    return [(cells, _read_alike(spark, files, name, cells, headed)) for (name, cells, headed), files in groups.items()]


def read_table(spark: SparkSession, path: str, encoding: str | None = None, own_headers: bool = False) -> DataFrame:
    """Any CSV as text columns. Short rows are padded with NULL, long rows are cut.

    Every file of a folder is judged by itself: its encoding, unless one is given, and the order of its columns.
    A file whose first line holds the first file's header cells, in any order, has a header; any other file
    goes on with the columns of the first. With ``own_headers`` the first line of every file is its header, and
    the files are put together by column name. Lines that look like the header further down are rows.
    """
    parts = _parts(spark, path, encoding, own_headers, lambda cells: False)
    out = parts[0][1]
    for _, rows in parts[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def read_schedule(spark: SparkSession, path: str, encoding: str | None = None, strict_aliases: bool = False) -> DataFrame:
    """Schedule CSV with aliased headers; rows with a blank sync id are dropped.

    Cells of unknown headers go to the map ``custom`` when they are not empty. The files of a folder may differ in
    encoding, order and spelling of their headers; a first line that names the sync id is a header.
    """
    aliases = alias_table(strict_aliases)
    names_id = lambda cells: any(aliases.get(c.lower()) == "sync_id" for c in cells)
    parts = [shape_schedule(rows, list(cells), strict_aliases) for cells, rows in _parts(spark, path, encoding, False, names_id)]
    out = parts[0]
    for rows in parts[1:]:
        out = out.unionByName(rows)
    return out


def shape_schedule(raw: DataFrame, headers: list[str] | None = None, strict_aliases: bool = False) -> DataFrame:
    """Schedule rows from a table of text columns; ``headers`` defaults to its column names."""
    headers = raw.columns if headers is None else headers
    aliases = alias_table(strict_aliases)
    column_of: dict[str, str] = {}
    for header, column in zip(headers, raw.columns):
        name = aliases.get(header.strip().lower())
        if name and name not in column_of:
            column_of[name] = column
    if "sync_id" not in column_of:
        raise ScheduleFileError("a sync id column is required")

    def cell(name: str) -> Column:
        return strip(F.col(f"`{column_of[name]}`")) if name in column_of else F.lit(None).cast("string")

    unknown = [(h.strip(), c) for h, c in zip(headers, raw.columns) if h.strip().lower() not in aliases]
    entries: dict[str, Column] = {}
    for header, column in unknown:
        value = F.nullif(strip(F.col(f"`{column}`")), F.lit(""))
        entries[header] = F.coalesce(value, entries[header]) if header in entries else value
    pairs = [x for h, c in entries.items() for x in (F.lit(h), c)]
    empty_map = F.create_map().cast("map<string,string>")
    custom = F.map_filter(F.create_map(*pairs), lambda _, v: F.coalesce(v != "", F.lit(False))) if pairs else empty_map
    return raw.select(
        cell("sync_id").alias("sync_id"),
        cell("task_name").alias("task_name"),
        *[scheduling.parse_date(cell(n)).alias(n) for n in ("planned_start", "planned_end", "actual_start", "actual_end")],
        scheduling.parse_money(cell("cost")).alias("cost"),
        scheduling.task_type(cell("task_type")).alias("task_type"),
        cell("set_level").alias("set_level"),
        cell("parent_set").alias("parent_set"),
        scheduling.parse_percent(cell("progress")).alias("progress"),
        custom.alias("custom"),
        *([F.col("seq")] if "seq" in raw.columns else []),
    ).filter(~is_blank(F.col("sync_id")))


def check_schedule(schedule: DataFrame) -> DataFrame:
    """Warnings (code, message, item) for rows that are not valid."""
    start, end = F.col("planned_start"), F.col("planned_end")
    return schedule.filter(~scheduling.is_valid_schedule(F.col("sync_id"), start, end)).select(
        F.lit(100).alias("code"),
        F.lit("warning").alias("severity"),
        scheduling.schedule_errors(F.col("sync_id"), start, end).alias("message"),
        F.col("sync_id").alias("item"),
    )
