"""Literal cases for the scalar functions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from girderframe.functions import classify, display, formats, ids, rdf, scheduling, text, verdicts
from girderframe.functions.boxes import Box, relation, tolerance


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def mapped(spark, values, fn, kind="string"):
    rows = column(spark, values, kind).select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_display_strings(spark):
    cases = {
        "Double: 5.5 m": ("Double", "5.5 m", 5.5, "m"),
        "DisplayString:171.18 ft^2": ("DisplayString", "171.18 ft^2", 171.18, "ft^2"),
        "Double: 3 Meters": ("Double", "3 Meters", 3.0, "m"),
        "Boolean: True": ("Boolean", "True", None, ""),
        "-3.14 mm": ("Unknown", "-3.14 mm", -3.14, "mm"),
        ".5": ("Unknown", ".5", 0.5, ""),
        "+5": ("Unknown", "+5", 5.0, ""),
        ".5 m": ("Unknown", ".5 m", None, ""),
        "+1,234.5": ("Unknown", "+1,234.5", 1234.5, ""),
        "1e3 kg": ("Unknown", "1e3 kg", 1000.0, "kg"),
        "2024-01-15": ("Unknown", "2024-01-15", 2024.0, "-01-15"),
        "C:\\foo": ("C", "\\foo", None, ""),
        "길이: 3 m²": ("길이", "3 m²", 3.0, "sq m"),
        "Type:\nnext": ("Type", "next", None, ""),
        "   ": ("", "", None, ""),
        "": ("", "", None, ""),
        None: ("", "", None, ""),
    }
    got = mapped(spark, list(cases), display.parse_display_string)
    for (source, want), r in zip(cases.items(), got):
        assert (r["data_type"], r["raw_value"], r["numeric_value"], r["unit"]) == want, source
        assert r["original_string"] == (source or "")
    frame = display.with_parsed(column(spark, list(cases)).withColumnRenamed("v", "property_value")).orderBy("i").collect()
    assert [(r["data_type"], r["raw_value"], r["numeric_value"], r["unit"]) for r in frame] == list(cases.values())


def test_not_a_number_text(spark):
    assert math.isnan(mapped(spark, ["Double: NaN"], display.parse_display_string)[0]["numeric_value"])


def test_every_unit_spelling(spark):
    spellings = [(s, unit) for unit, names in display.UNIT_SPELLINGS.items() for s in names]
    got = mapped(spark, [s.upper() for s, _ in spellings], display.normalize_unit)
    assert got == [unit for _, unit in spellings]


def test_dates(spark):
    cases = {
        "2026-01-15": dt.datetime(2026, 1, 15),
        "2026/01/15": dt.datetime(2026, 1, 15),
        "2026.01.15": dt.datetime(2026, 1, 15),
        "02/03/2026": dt.datetime(2026, 2, 3),
        "25/12/2026": dt.datetime(2026, 12, 25),
        "25-12-2026": dt.datetime(2026, 12, 25),
        "2026-01-15 10:20:30": dt.datetime(2026, 1, 15, 10, 20, 30),
        "2026/01/15 10:20:30": dt.datetime(2026, 1, 15, 10, 20, 30),
        "20260115": dt.datetime(2026, 1, 15),
        "2026-1-5": dt.datetime(2026, 1, 5),
        "2026-02-30": None,
        "soon": None,
        "": None,
        None: None,
    }
    assert mapped(spark, list(cases), scheduling.parse_date) == list(cases.values())


def test_free_dates(spark):
    day = dt.datetime
    cases = {
        "1/5/2024": day(2024, 1, 5), "25/3/2024": day(2024, 3, 25), "5 Jan 2024": day(2024, 1, 5), "Jan 5, 2024": day(2024, 1, 5),
        "september 9 2023": day(2023, 9, 9), "5-Mar-2024": day(2024, 3, 5), "2024-1-5": day(2024, 1, 5), "2024. 1. 5.": day(2024, 1, 5),
        "1/5/2024 3:07 PM": day(2024, 1, 5, 15, 7), "1/5/2024 12:00:09 AM": day(2024, 1, 5, 0, 0, 9), "5 Janx 2024": None, "13/13/2024": None, "soon": None,
    }
    assert mapped(spark, list(cases), scheduling.parse_date) == list(cases.values())


def test_dates_ignore_the_session_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        # Midnight of this day does not exist there.
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        assert mapped(spark, ["2018-11-04"], scheduling.parse_date) == [dt.datetime(2018, 11, 4)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_week_keys(spark):
    days = [dt.date(2012, 12, 31), dt.date(2027, 1, 1), dt.date(2026, 1, 1), dt.date(2026, 7, 6)]
    assert mapped(spark, days, scheduling.week_key, "date") == ["2012-W53", "2027-W53", "2026-W01", "2026-W28"]


def test_task_types(spark):
    cases = {
        None: ("Construct", "Construct"),
        "remove and build": ("Construct", "Demolish"),
        "설치": ("Construct", "Construct"),
        "제거": ("Demolish", "Construct"),
        "TEMPORARY": ("Temporary", "Temporary"),
        " 구성 ": ("Construct", "Construct"),
        "other": ("Construct", "Construct"),
    }
    assert mapped(spark, list(cases), scheduling.task_type) == [a for a, _ in cases.values()]
    assert mapped(spark, list(cases), scheduling.task_stage_type) == [b for _, b in cases.values()]


def test_money_and_percent(spark):
    money = mapped(spark, ["₩1,234", "$5.5", " ", "x", None], lambda c: scheduling.parse_money(c).cast("double"))
    assert money == [1234.0, 5.5, None, None, None]
    assert mapped(spark, ["50%", " 12.5 %", "x", None], scheduling.parse_percent) == [50.0, 12.5, 0.0, 0.0]


def test_paths_and_names(spark):
    assert mapped(spark, ["a/b\\c", "//a//", "", None], scheduling.zone_level) == ["a/b", "a", None, None]
    assert mapped(spark, ["a/b\\c", "/", "x"], scheduling.last_part) == ["c", "/", "x"]
    assert mapped(spark, ["기둥-1", "42_a", "Beam3", "", None], scheduling.category_from_name) == ["기둥", "42", "Beam", None, None]


def test_guids(spark):
    assert mapped(spark, ["abc"], ids.guid_from_md5) == ["98500190-d23c-b04f-d696-3f7d28e17f72"]
    good = "{6A516C90-24D4-54AD-A736-271A8941C53E}"
    assert mapped(spark, [good, "6a516c9024d454ada736271a8941c53e", "no"], ids.canonical_guid) == [
        "6a516c90-24d4-54ad-a736-271a8941c53e", "6a516c90-24d4-54ad-a736-271a8941c53e", None,
    ]


def test_box_pairs(spark):
    """Distance, overlap and relation against the unit box, at tolerance 0.15."""
    cases = [
        ((1, 0, 0, 2, 1, 1), 0.0, 0.0, "touch"),
        ((0.5, 0, 0, 2, 1, 1), 0.0, 0.5, "overlap"),
        ((1.125, 0, 0, 2, 1, 1), 0.125, 0.0, "neartouch"),
        ((1.25, 0, 0, 2, 1, 1), 0.25, 0.0, "neartouch"),
    ]
    unit = Box.literal(0, 0, 0, 1, 1, 1)
    for bounds, distance, overlap, kind in cases:
        other = Box.literal(*bounds)
        row = spark.range(1).select(
            unit.distance(other).alias("d"), other.distance(unit).alias("e"), unit.overlap_volume(other).alias("o"),
            relation(unit.distance(other), unit.overlap_volume(other)).alias("r"),
        ).first()
        assert (row["d"], row["e"], row["o"], row["r"]) == (distance, distance, overlap, kind)


def test_tolerances(spark):
    # "Pipe Insulation" holds two keys; the one declared first wins.
    names = ["pipe", "Pipe Insulation", "cable tray run", "Misc", "", None]
    assert mapped(spark, names, tolerance) == [0.05, 0.05, 0.05, 0.15, 0.15, 0.15]


def test_escapes(spark):
    assert mapped(spark, ['a"b\\\n\r\t'], rdf.escape_literal) == ['a\\"b\\\\\\n\\r\\t']
    assert mapped(spark, ["a,b", 'q"', "x\ny", "x\ry", "plain", None], text.csv_cell) == [
        '"a,b"', '"q"""', '"x\ny"', '"x\ry"', "plain", "",
    ]
    assert mapped(spark, [1.0, 0.125, -2.5], rdf.number_text, "double") == ["1", "0.125", "-2.5"]


def test_tolerant_casts(spark):
    assert mapped(spark, ["7", "7.9", "x", None], verdicts.tolerant_int) == [7, 7, 0, 0]
    assert mapped(spark, ["예", "Yes", "true", "1", "YES", "0", None], verdicts.tolerant_bool) == [True, True, True, True, False, False, False]


@pytest.mark.parametrize(
    "row, want",
    [
        (("skipped_container", True, False, False, "full_mesh", True, "success"), "SKIP_CONTAINER"),
        (("none", True, True, True, "full_mesh", True, "success"), "SKIP_HIDDEN"),
        (("none", False, False, False, "full_mesh", True, "success"), "SKIP_NO_GEOMETRY"),
        (("none", False, True, False, "partial_retry_success", False, "success"), "OK_MESH"),
        (("none", False, True, False, "line_mesh", False, "success"), "OK_LINE_MESH"),
        (("none", False, True, False, "fbx_supplemented", False, "success"), "OK_FBX"),
        (("none", False, True, True, "box_placeholder", True, "failure"), "FAIL_NO_EXTRACT"),
        (("none", False, True, True, "box_placeholder", False, "failure"), "WARN_BOX"),
        (("none", False, False, True, "box_placeholder", False, "failure"), "SKIP_NO_GEOMETRY"),
        (("none", False, False, True, None, False, "success"), "WARN_BOX"),
        (("none", False, True, True, None, True, "failure"), "FAIL_NO_EXTRACT"),
        (("none", False, True, True, None, False, "success"), "UNKNOWN"),
    ],
)
def test_verdicts(spark, row, want):
    got = spark.range(1).select(verdicts.verdict(*[F.lit(v) for v in row]).alias("v")).first()["v"]
    assert got == want


def test_level_orders(spark):
    names = ["B5", "지하1층", "1F", "20F", "10층", "Ground", "RF", "펜트하우스", "Mezzanine", None]
    assert mapped(spark, names, classify.level_order) == [-5, -1, 1, 20, 10, 0, 100, 101, None, None]


def test_file_names():
    assert formats.filter_file_name("(All)", "(All)") == "Snapshot"
    assert formats.filter_file_name("L3", "Item A", "", "x y") == "L3_Item_A_x_y"
