"""Schedule files, matching, sets, tasks and generated schedules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from girderframe.operators import props
from girderframe.operators import schedule as sched
from girderframe.plans import jobs
from girderframe.schema import ScheduleOptions
from girderframe.sinks import frames, writers
from girderframe.sources import schedule_csv as sc

SAMPLE = """SyncID,TaskName,PlannedStart,PlannedEnd,TaskType,ParentSet,Progress
6a516c90-24d4-54ad-a736-271a8941c53e,HgrAisc31_C3x6-1-C4,2026-01-15,2026-01-20,Construct,Zone-A/Level-2,0
ed66a072-0dc2-581a-aa20-a94ddab48ce3,Utility_FOUR_HOLE_PLATE,2026-01-18,2026-01-25,Construct,Zone-A/Level-2,0
7bf801ad-98ae-5894-884e-10acf6b2b699,MemberPartPrismatic-1-0241,2026-01-20,2026-01-28,Construct,Zone-A/Level-4,0
"""
PROPERTIES = "object_id string, parent_id string, level int, display_name string, sys_path string, category string, property_name string, property_value string, raw_value string, seq bigint"


def written(tmp_path, text, encoding="utf-8"):
    path = tmp_path / "s.csv"
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_sample_file(spark, tmp_path):
    path = written(tmp_path, SAMPLE)
    rows = sc.read_schedule(spark, path).orderBy("planned_start").collect()
    assert [r["planned_end"] for r in rows] == [dt.datetime(2026, 1, d) for d in (20, 25, 28)]
    assert rows[0]["parent_set"] == "Zone-A/Level-2" and rows[0]["custom"] == {}
    # With the accepted spellings only, the dates land in the custom columns.
    strict = sc.read_schedule(spark, path, strict_aliases=True).first()
    assert strict["planned_start"] is None and set(strict["custom"]) == {"PlannedStart", "PlannedEnd"}


def test_bilingual_headers_and_custom_columns(spark, tmp_path):
    text = '동기화 ID,ID,작업명,비용,Crew,Crew,Note\n a1 ,x,"Say ""hi"", twice","₩1,500",one,,\n  ,y,skipped,,,,\n\nb2,x,plain,bad,,two,n\n'
    text = text.replace('"₩1,500"', '"₩1,500"')
    rows = {r["sync_id"]: r for r in sc.read_schedule(spark, written(tmp_path, text)).collect()}
    assert set(rows) == {"a1", "b2"}
    assert rows["a1"]["task_name"] == 'Say "hi", twice' and float(rows["a1"]["cost"]) == 1500
    assert rows["a1"]["custom"] == {"Crew": "one"} and rows["b2"]["custom"] == {"Crew": "two", "Note": "n"}
    assert rows["b2"]["cost"] is None and rows["b2"]["task_type"] == "Construct" and rows["b2"]["progress"] == 0


def test_file_errors(spark, tmp_path):
    with pytest.raises(sc.ScheduleFileError):
        sc.read_schedule(spark, written(tmp_path, "TaskName,Cost\na,1\n"))
    with pytest.raises(sc.ScheduleFileError):
        sc.read_schedule(spark, written(tmp_path, ""))


def test_generic_table(spark, tmp_path):
    table = sc.read_table(spark, written(tmp_path, "a,,a,A,a_1\n1,2\n\n1,2,3,4,5,6\n"))
    assert table.columns == ["a", "Column2", "a_1", "A_2", "a_1_1"]
    assert sorted(map(tuple, table.collect()), key=str) == sorted([("1", "2", None, None, None), ("1", "2", "3", "4", "5")], key=str)


@pytest.mark.parametrize("encoding, name", [("utf-8", "UTF-8"), ("utf-8-sig", "UTF-8"), ("euc-kr", "EUC-KR")])
def test_encodings(spark, tmp_path, encoding, name):
    path = written(tmp_path, "SyncID,작업명\na,기초 공사\n", encoding)
    found = sc.detect_encoding(spark, path)
    assert found == name
    row = sc.read_schedule(spark, path, found).first()
    assert (row["sync_id"], row["task_name"]) == ("a", "기초 공사")


def test_encoding_is_judged_on_all_lines(spark, tmp_path):
    late = "SyncID,Name\n" + "".join(f"{k},plain text\n" for k in range(2000)) + "last,기초 공사\n"
    path = written(tmp_path, late, "euc-kr")
    assert sc.detect_encoding(spark, path) == "EUC-KR"
    assert sc.read_table(spark, path, "EUC-KR").filter("SyncID = 'last'").first()["Name"] == "기초 공사"


def test_parts_may_lack_or_repeat_the_header(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "part-0.csv").write_text("a,b\n1,2\n")
    (folder / "part-1.csv").write_text("3,4\n5,6\n")
    (folder / "part-2.csv").write_text("a,b\n7,8\n")
    got = sorted(map(tuple, sc.read_table(spark, str(folder)).collect()))
    assert got == [("1", "2"), ("3", "4"), ("5", "6"), ("7", "8")]


def property_frame(spark, rows):
    full = [(o, "", 3, f"Part {o}", f"Site > {o}", c, n, v, v, i) for i, (o, c, n, v) in enumerate(rows)]
    return spark.createDataFrame(full, PROPERTIES)


def schedule_frame(spark, rows):
    schema = "sync_id string, task_name string, planned_start date, planned_end date, task_type string, parent_set string, progress double, seq bigint"
    day = dt.date(2026, 1, 5)
    return spark.createDataFrame([(s, t, day, day + dt.timedelta(3), "Construct", p, 0.0, i) for i, (s, t, p) in enumerate(rows)], schema)


def test_matching_takes_the_first_and_counts_the_rest(spark):
    rows = property_frame(
        spark, [("b", "Element", "Id", "X1"), ("a", "Element", "Id", "x1"), ("c", "Item", "Name", "N"), ("d", "Item", "GUID", "N"), ("e", "Item", "Name", "n2")]
    )
    wanted = schedule_frame(spark, [("x1", "t", "p"), ("N", "t", "p"), ("N2", "t", "p"), ("", "t", "p")])
    got = {r["sync_id"]: (r["matched_object_id"], r["match_count"], r["match_property"], r["match_status"]) for r in sched.match(wanted, rows).collect()}
    assert got["x1"] == ("b", 2, "Element.Id", "Matched")
    # The fallback pairs are exact and ranked: Item.GUID comes before Item.Name.
    assert got["N"] == ("d", 1, "Item.GUID", "Matched")
    assert got["N2"] == (None, 0, None, "NotFound")
    assert got[""] == (None, 0, None, "Error")
    exact = sched.match(wanted, rows, ScheduleOptions(ignore_case=False)).filter("sync_id = 'x1'").first()
    assert (exact["matched_object_id"], exact["match_count"]) == ("a", 1)


def test_a_value_shared_by_very_many_objects_stays_one_row(spark):
    many = spark.range(3000).select(
        F.concat(F.lit("o"), "id").alias("object_id"), F.lit("Element").alias("category"), F.lit("Id").alias("property_name"),
        F.lit("same").alias("raw_value"), F.col("id").alias("seq"),
    )
    wanted = schedule_frame(spark, [("same", f"t{i}", "p") for i in range(50)])
    rows = sched.match(wanted, many).collect()
    assert len(rows) == 50 and {(r["matched_object_id"], r["match_count"]) for r in rows} == {("o0", 3000)}


@pytest.fixture
def small(spark):
    rows = property_frame(spark, [(f"o{i}", "Element", "Id", f"s{i}") for i in range(6)])
    names = [("s0", "t0", "A/L1"), ("s1", "t1", "a/L1"), ("s2", "t2", "B\\L1"), ("s3", "t3", None), ("s3", "t3b", "A/L1"), ("nope", "t9", "A/L1")]
    return schedule_frame(spark, names), rows


def test_sets_names_and_links(spark, small):
    plan, rows = small
    matched = sched.match(plan, rows)
    table = sched.sets(matched, props.object_ids(rows))
    named = {r["set_key"]: (r["set_name"], r["row_count"]) for r in table.collect()}
    assert named == {"A/L1": ("L1", 2), "B\\L1": ("L1_1items", 1), "Ungrouped": ("Ungrouped", 1), "a/L1": ("L1_1items", 1)}
    # Folders are one tree whatever the case: A, A/L1, B, B/L1, Ungrouped and the root.
    assert sched.set_totals(table).first()["folder_count"] == 6
    links = {r["seq"]: r["set_key"] for r in sched.set_links(matched, table).collect()}
    assert links == {0: "A/L1", 1: "a/L1", 2: "B\\L1", 3: "Ungrouped", 4: "A/L1"}
    by_name = {r["seq"]: r["set_key"] for r in sched.set_links(matched, table, legacy_link=True).collect()}
    assert by_name == {0: "A/L1", 1: "A/L1", 2: "A/L1", 3: None, 4: "A/L1"}


def test_strategy_none_keeps_rows_with_one_sync_id_together(spark, small):
    plan, rows = small
    matched = sched.match(plan, rows)
    table = sched.sets(matched, props.object_ids(rows), "none")
    assert {r["set_key"]: r["row_count"] for r in table.collect()}["s3"] == 2
    assert [r["sync_id"] for r in sched.duplicate_sync_ids(plan).collect()] == ["s3"]


def test_job_gate_and_dry_run(spark, small):
    plan, rows = small
    run = jobs.schedule_job(plan, rows)
    assert run.success and run.frames["task_totals"].first()["linked"] == 5
    assert jobs.schedule_job(plan, rows, ScheduleOptions.for_dry_run()).stopped_at == "dry_run"
    strict = jobs.schedule_job(plan, rows, ScheduleOptions.for_production())
    assert not strict.success and strict.stopped_at == "matching" and "tasks" not in strict.frames
    bad = jobs.schedule_job(plan, rows, ScheduleOptions(batch_size=0))
    assert not bad.success and bad.stopped_at == "pre_checks"


def test_write_back_upserts(spark, small):
    plan, rows = small
    old = property_frame(spark, [("o0", "AWP Schedule", "작업명", "old"), ("o5", "AWP Schedule", "작업명", "kept")])
    base = rows.unionByName(old)
    matched = sched.match(plan, rows)

    def names(df):
        return {(r["object_id"], r["property_value"]) for r in df.filter("property_name = '작업명'").collect()}

    replaced = names(sched.write_back(base, matched, "AWP Schedule"))
    assert replaced == {("o0", "t0"), ("o1", "t1"), ("o2", "t2"), ("o3", "t3b"), ("o5", "kept")}
    untouched = names(sched.write_back(base, matched, "AWP Schedule", overwrite=False))
    assert ("o0", "old") in untouched and ("o0", "t0") not in untouched
    progress = sched.property_rows(matched, "AWP Schedule").filter("property_name = '진행률'")
    assert progress.count() == 0


def test_sequential_schedule(spark):
    rows = property_frame(spark, [(f"o{i}", "Item", "Type", "Beam") for i in range(10)])
    made = sched.generate(rows, start="2026-02-01", days=2, prefix="Steel Erection").orderBy("seq").collect()
    first, last = made[0], made[-1]
    assert (first["task_name"], first["planned_start"], first["planned_end"]) == ("Steel Erection 1", dt.date(2026, 2, 1), dt.date(2026, 2, 3))
    assert (last["task_name"], last["planned_start"], last["planned_end"]) == ("Steel Erection 10", dt.date(2026, 2, 19), dt.date(2026, 2, 21))
    assert first["actual_start"] == first["planned_start"] and first["parent_set"] == "Level-3"
    assert sched.generation_totals(sched.generate(rows, start="2026-02-01", days=2, prefix="p"), 2).first()["total_days"] == 20


def test_parent_set_reads_all_rows_or_only_the_first(spark):
    rows = property_frame(spark, [("o", "Item", "Name", "n"), ("o", "Element", "Category", "Walls"), ("o", "Element", "LEVEL", "2")])

    def parent(**options):
        return sched.generate(rows, start="2026-01-01", days=1, prefix="p", **options).first()["parent_set"]

    assert parent(strategy="category") == "Walls"
    assert parent(strategy="floor") == "Floor-2"
    assert parent(strategy="composite") == "2/Walls"
    assert parent(strategy="category", first_row_only=True) == "Part"
    assert parent(strategy="floor", first_row_only=True) == "Level-3"


def test_generated_file_reads_back(spark, tmp_path):
    rows = property_frame(spark, [(f"o{i}", "Item", "Type", "Beam") for i in range(4)])
    made = sched.generate(rows, start="2026-02-01", days=2, prefix="p", date_mode="planned_only")
    frame = frames.schedule(made, "planned_only")
    assert frame.columns == ["SyncID", "TaskName", "PlannedStart", "PlannedEnd", "TaskType", "ParentSet", "Progress"]
    writers.write_csv(frame, str(tmp_path / "out"))
    back = sc.read_schedule(spark, str(tmp_path / "out"))
    key = [F.date_format(c, "yyyy-MM-dd") for c in ("planned_start", "planned_end")]
    assert sorted(back.select("sync_id", *key).collect()) == sorted(made.select("sync_id", *key).collect())


def test_generated_dates_beyond_year_9999_have_no_sign(spark):
    rows = property_frame(spark, [("o1", "Item", "Type", "Beam"), ("o2", "Item", "Type", "Beam")])
    made = sched.generate(rows, start="2026-02-01", days=17_999_998, prefix="p", date_mode="actual_from_planned")
    got = [tuple(r) for r in frames.schedule(made, "actual_from_planned").orderBy("TaskName").select("PlannedStart", "PlannedEnd", "ActualEnd").collect()]
    assert got[0] == ("2026-02-01", "51308-05-29", "51308-05-29")
    assert got[1][0] == "51308-05-29"


def test_linked_objects_of_a_task(spark, small):
    plan, rows = small
    run = jobs.schedule_job(plan, rows)
    links = sched.set_links(run.frames["matched"], run.frames["sets"])
    wanted = spark.createDataFrame([("S0",)], "sync_id string")
    found = sched.linked_objects(run.frames["tasks"], run.frames["set_members"], links, wanted).collect()
    assert sorted((r["task_sync_id"], r["matched_object_id"]) for r in found) == [("s0", "o0"), ("s0", "o3")]


def test_linked_objects_are_counted_before_they_meet_tasks(spark):
    tasks = spark.createDataFrame([("t1", 1, True), ("t2", 2, True), ("t3", 3, True)], "sync_id string, seq long, linked boolean")
    # t2 has two sets, which share an object.
    links = spark.createDataFrame([(1, "A"), (2, "A"), (2, "B"), (3, "C")], "seq long, set_key string")
    members = spark.createDataFrame([("A", "x"), ("A", "x"), ("A", "y"), ("B", "y")], "set_key string, matched_object_id string")
    wanted = spark.createDataFrame([("T1",), ("t2",), ("t3",)], "sync_id string")
    got = sched.linked_object_counts(tasks, members, links, wanted)
    assert sorted(map(tuple, got.collect())) == [("t1", "x", 2), ("t1", "y", 1), ("t2", "x", 2), ("t2", "y", 2)]
    # One set for each task: the pairs are the last step, with no grouping behind the join.
    plain = sched.linked_object_counts(tasks, members, links.filter("seq <> 2"), wanted)
    assert "Aggregate" not in plain._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
