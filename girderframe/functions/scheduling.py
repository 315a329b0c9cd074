"""Schedule scalars: dates, money, task types, grouping keys and checks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from girderframe.functions.text import is_blank, is_empty, path_parts

# Words that mark each task type.
CONSTRUCT_WORDS = ["construct", "build", "시공", "설치", "조립"]
DEMOLISH_WORDS = ["demolish", "remove", "철거", "해체", "제거"]
TEMPORARY_WORDS = ["temp", "temporary", "임시", "가설"]
TASK_STAGE_DEMOLISH_WORDS = ["demolish", "remove", "철거", "해체"]
TASK_STAGE_TEMPORARY_WORDS = ["temp", "임시", "가설"]
KOREAN_TASK_TYPES = {"Construct": "구성", "Demolish": "철거", "Temporary": "임시"}

# English months, the first three letters and the rest.
MONTHS = {
    "jan": "uary", "feb": "ruary", "mar": "ch", "apr": "il", "may": "", "jun": "e", "jul": "y", "aug": "ust",
    "sep": "tember", "oct": "ober", "nov": "ember", "dec": "ember",
}

DATE_MODES = ("planned_only", "actual_from_planned", "both_separate")


def _timestamp(y: Column, m: Column, d: Column, h=None, mi=None, s=None) -> Column:
    zero = F.lit(0)
    numbers = [c.try_cast("int") for c in (y, m, d)]
    clock = [zero if c is None else c.try_cast("int") for c in (h, mi, s)]
    return F.try_make_timestamp_ntz(*numbers, *clock[:2], clock[2].cast("decimal(16,6)"))


def parse_date(text: Column) -> Column:
    """Timestamp from the accepted layouts, tried in order, else a free parse, else NULL.

    Month-first is tried before day-first. Built from the digits, so the session
    time zone and locale play no part.
    """

    def groups(pattern: str, n: int) -> list[Column]:
        return [F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i in range(1, n + 1)]

    y, _, m, d = groups(r"^(\d{4})([-/.])(\d{2})\2(\d{2})$", 4)
    a, b, year = groups(r"^(\d{2})/(\d{2})/(\d{4})$", 3)
    d2, m2, y2 = groups(r"^(\d{2})-(\d{2})-(\d{4})$", 3)
    ty, _, tm, td, hh, mi, ss = groups(r"^(\d{4})([-/])(\d{2})\2(\d{2}) (\d{2}):(\d{2}):(\d{2})$", 7)
    cy, cm, cd = groups(r"^(\d{4})(\d{2})(\d{2})$", 3)
    exact = F.coalesce(
        _timestamp(y, m, d),
        _timestamp(year, a, b),
        _timestamp(year, b, a),
        _timestamp(y2, m2, d2),
        _timestamp(ty, tm, td, hh, mi, ss),
        _timestamp(cy, cm, cd),
    )
    return F.when(~is_blank(text), F.coalesce(exact, text.try_cast("timestamp_ntz"), _free_date(F.trim(text))))


def _free_date(text: Column) -> Column:
    """Timestamp from looser spellings: single digits, month names, a time with or without AM and PM."""
    clock = r"(?:[ ,T]+(\d{1,2}):(\d{2})(?::(\d{2}))?(?: ?([AaPp])[Mm])?)?$"

    def found(pattern: str, year: int, month: int, day: int, named: bool = False) -> Column:
        part = lambda i: F.nullif(F.regexp_extract(text, pattern + clock, i), F.lit(""))
        names = F.create_map(*[F.lit(x) for n, name in enumerate(MONTHS, 1) for x in (name, str(n))])
        # A name counts by its first three letters if the rest agrees with the full name.
        full = F.create_map(*[F.lit(x) for name, rest in MONTHS.items() for x in (name, name + rest)])
        short = F.substring(F.lower(part(month)), 1, 3)
        known = F.startswith(F.try_element_at(full, short), F.lower(part(month)))
        m = F.when(known, F.try_element_at(names, short)) if named else part(month)
        hour = F.coalesce(part(4), F.lit("0")).try_cast("int")
        half = F.lower(part(7))
        hour = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
        return _timestamp(part(year), m, part(day), hour.cast("string"), F.coalesce(part(5), F.lit("0")), F.coalesce(part(6), F.lit("0")))

    return F.coalesce(
        found(r"^(\d{4})[-/. ]+(\d{1,2})[-/. ]+(\d{1,2})\.?", 1, 2, 3),
        found(r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", 3, 1, 2),
        found(r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", 3, 2, 1),
        found(r"^(\d{1,2})[ \-]([A-Za-z]{3,9})\.?[ \-,]+(\d{4})", 3, 2, 1, named=True),
        found(r"^([A-Za-z]{3,9})\.?[ \-](\d{1,2}),?[ \-]+(\d{4})", 3, 1, 2, named=True),
    )


def parse_money(text: Column) -> Column:
    return F.trim(F.translate(text, "₩$,", "")).try_cast("decimal(28,8)")


def parse_percent(text: Column) -> Column:
    """Number without its percent sign; 0 when it is missing or unreadable."""
    digits = F.trim(F.translate(text, "%,", ""))
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def _has_any(text: Column, words: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def task_type(text: Column) -> Column:
    """Task type of a schedule cell; construct words win over the others."""
    low = F.lower(text)
    return (
        F.when(is_empty(text) | _has_any(low, CONSTRUCT_WORDS), F.lit("Construct"))
        .when(_has_any(low, DEMOLISH_WORDS), F.lit("Demolish"))
        .when(_has_any(low, TEMPORARY_WORDS), F.lit("Temporary"))
        .otherwise(F.lit("Construct"))
    )


def task_stage_type(text: Column) -> Column:
    """Task type at the task stage: exact names first, then demolish before temporary."""
    low, trimmed = F.lower(text), F.trim(text)
    chain = F.when(is_empty(text), F.lit("Construct"))
    for name, korean in KOREAN_TASK_TYPES.items():
        chain = chain.when((trimmed == korean) | (low == name.lower()), F.lit(name))
    return (
        chain.when(_has_any(low, TASK_STAGE_DEMOLISH_WORDS), F.lit("Demolish"))
        .when(_has_any(low, TASK_STAGE_TEMPORARY_WORDS), F.lit("Temporary"))
        .otherwise(F.lit("Construct"))
    )


def task_type_to_english(text: Column) -> Column:
    chain = F
    for name, korean in KOREAN_TASK_TYPES.items():
        chain = chain.when((F.lower(text) == name.lower()) | (text == korean), F.lit(name))
    return chain.otherwise(text)


def task_type_to_korean(text: Column) -> Column:
    chain = F
    for name, korean in KOREAN_TASK_TYPES.items():
        chain = chain.when(F.lower(text) == name.lower(), F.lit(korean))
    return chain.otherwise(text)


def week_key(day: Column) -> Column:
    """``year-Www``; late-December days of ISO week 1 stay in week 53."""
    week = F.when((F.month(day) == 12) & (F.weekofyear(day) == 1), F.lit(53)).otherwise(F.weekofyear(day))
    return F.format_string("%d-W%02d", F.year(day), week)


def zone(path: Column) -> Column:
    return F.try_element_at(path_parts(path), F.lit(1))


def zone_level(path: Column) -> Column:
    parts = path_parts(path)
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, 2), "/"))


def last_part(path: Column) -> Column:
    """Last path part; the path itself when it has no part."""
    return F.coalesce(F.try_element_at(path_parts(path), F.lit(-1)), path)


def category_from_name(name: Column) -> Column:
    """Leading letters, else the first token, else the name; NULL for empty names."""
    letters = F.regexp_extract(name, r"^([A-Za-z가-힣]+)", 1)
    tokens = F.filter(F.split(name, r"[ \-_]"), lambda p: p != "")
    return F.when(
        name != "",
        F.when(letters != "", letters).otherwise(F.coalesce(F.try_element_at(tokens, F.lit(1)), name)),
    )


PARENT_SET_STRATEGIES = ("level", "floor", "category", "area", "composite", "property", "custom")


def parent_set(
    strategy: str,
    *,
    level: Column,
    display_name: Column,
    sys_path: Column,
    values: dict[tuple[str, str], Column],
    level_cap: int = 3,
    custom: str = "",
) -> Column:
    """Parent set of a generated task; ``values`` maps (category, property) to a column."""

    def value(category: str, name: str) -> Column:
        return values.get((category, name), F.lit(None).cast("string"))

    def present(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    if strategy == "level":
        return F.concat(F.lit("Level-"), F.least(level, F.lit(level_cap)).cast("string"))
    if strategy == "floor":
        floor = F.coalesce(value("Element", "Level"), value("Item", "Level"), value("Element", "층"))
        return F.coalesce(
            F.concat(F.lit("Floor-"), present(floor)), F.concat(F.lit("Level-"), level.cast("string"))
        )
    if strategy == "category":
        found = F.coalesce(value("Element", "Category"), value("Item", "Type"), category_from_name(display_name))
        return F.coalesce(present(found), F.lit("Unknown"))
    if strategy == "area":
        names = ["Area", "Zone", "구역", "공구"]
        found = F.coalesce(*[value("Element", n) for n in names])
        return F.coalesce(F.concat(F.lit("Area-"), present(found)), F.lit("Default-Area"))
    if strategy == "composite":
        floor = F.coalesce(
            value("Element", "Level"), value("Item", "Level"), F.concat(F.lit("L"), level.cast("string"))
        )
        kind = F.coalesce(value("Element", "Category"), category_from_name(display_name), F.lit("Unknown"))
        return F.concat_ws("/", floor, kind)
    if strategy == "property":
        parts = F.filter(F.split(sys_path, r" > |/|\\"), lambda p: p != "")
        return F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("Default"))
    if strategy == "custom":
        return F.lit(custom or "Custom")
    return F.lit("Default")


def duration_days(start: Column, end: Column) -> Column:
    """Whole days between two timestamps, truncated toward zero; 0 when one is missing."""
    seconds = F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))
    return F.coalesce((seconds / 86400).cast("int"), F.lit(0))


def iso_date(day: Column | str) -> Column:
    """A date as yyyy-MM-dd; years beyond 9999 without the sign that ``date_format`` puts before them."""
    return F.regexp_replace(F.date_format(day, "yyyy-MM-dd"), r"^\+", "")


def is_valid_schedule(sync_id: Column, start: Column, end: Column) -> Column:
    return (
        ~is_blank(sync_id)
        & (start.isNotNull() | end.isNotNull())
        & F.coalesce(start <= end, F.lit(True))
    )


def schedule_errors(sync_id: Column, start: Column, end: Column) -> Column:
    """Messages joined with ``; ``; empty text when the row is valid."""
    late = F.concat(
        F.lit("시작일("), iso_date(start),
        F.lit(")이 종료일("), iso_date(end), F.lit(")보다 늦습니다."),
    )
    return F.concat_ws(
        "; ",
        F.when(is_blank(sync_id), F.lit("SyncID가 비어있습니다.")),
        F.when(start.isNull() & end.isNull(), F.lit("시작일과 종료일이 모두 비어있습니다.")),
        F.when(start > end, late),
    )


def actual_dates(mode: str, start: Column, end: Column) -> tuple[Column, Column]:
    """Actual start and end of a generated task under the date mode."""
    if mode not in DATE_MODES:
        raise ValueError(f"unknown date mode: {mode}")
    keep = F.lit(mode == "actual_from_planned")
    return F.when(keep, start), F.when(keep, end)
