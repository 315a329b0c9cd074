"""Schedule, rule, output and streaming queries."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from checks.registry import query
from girderframe.functions import classify, scheduling
from girderframe.functions.display import with_parsed
from girderframe.operators import precedence, props
from girderframe.operators import schedule as sched
from girderframe.plans import jobs
from girderframe.schema import ScheduleOptions
from girderframe.session import work_dir
from girderframe.sinks import frames, writers
from girderframe.sinks.nested import nested_json_lines
from girderframe.sources import schedule_csv
from girderframe.streaming import debounce as deb


def schedule(fx):
    """Schedule rows with parsed types and costs."""
    return fx("fx_schedule").withColumns(
        {
            "task_type": scheduling.task_type(F.col("task_type_raw")), "cost": scheduling.parse_money(F.col("cost_raw")),
            "progress": (F.col("seq") % 3).cast("double"),
        }
    )


def matched(fx, **options):
    return sched.match(schedule(fx), with_parsed(fx("fx_records")), ScheduleOptions(**options))


def csv_file(fx) -> str:
    """Write the schedule as a CSV with mixed header spellings; returns its folder."""
    path = f"{work_dir(fx.spark)}/girderframe/csv-{uuid.uuid4().hex}"
    day = lambda c: F.date_format(c, "yyyy/MM/dd")
    table = fx("fx_schedule").select(
        F.col("sync_id").alias("동기화ID"),
        F.concat("task_name", F.lit(', "A"')).alias("Task Name"),
        day("planned_start").alias("plannedSTART"),
        day("planned_end").alias("계획종료일"),
        F.col("cost_raw").alias("비용"),
        F.col("task_type_raw").alias("작업 유형"),
        F.col("parent_set").alias("Zone"),
        F.lit("second").alias("Parent"),
        F.concat((F.col("seq") % 50).cast("string"), F.lit("%")).alias("Percent"),
        F.when(F.col("seq") % 2 == 0, F.concat(F.lit(" crew "), (F.col("seq") % 9).cast("string"))).otherwise(F.lit("")).alias("Crew"),
    )
    writers.write_csv(table, path)
    return path


_TYPE = "CASE WHEN task_type_raw IN ('Build','') THEN 'Construct' WHEN task_type_raw IN ('Demolish old','remove-temp') THEN 'Demolish' ELSE 'Temporary' END"


@query("A01_schedule_csv", f"""
SELECT sync_id, task_name||', "A"' AS task_name, strftime(planned_start,'%Y-%m-%d') AS planned_start, strftime(planned_end,'%Y-%m-%d') AS planned_end, CAST(replace(replace(cost_raw,'$',''),',','') AS DOUBLE) AS cost, {_TYPE} AS task_type, parent_set, CAST(seq%50 AS DOUBLE) AS progress, CASE WHEN seq%2=0 THEN 'crew '||CAST(seq%9 AS STRING) END AS crew FROM {{fx_schedule}} WHERE sync_id<>''""")
def read_schedule(fx):
    rows = schedule_csv.read_schedule(fx.spark, csv_file(fx))
    return rows.select(
        "sync_id", "task_name", F.date_format("planned_start", "yyyy-MM-dd").alias("planned_start"),
        F.date_format("planned_end", "yyyy-MM-dd").alias("planned_end"), F.col("cost").cast("double").alias("cost"), "task_type",
        "parent_set", "progress", F.try_element_at("custom", F.lit("Crew")).alias("crew"),
    )


@query("A03_quoted_csv_roundtrip", """SELECT seq, property_value||', "q" ' AS value FROM {fx_records}""")
def roundtrip(fx):
    path = f"{work_dir(fx.spark)}/girderframe/csv-{uuid.uuid4().hex}"
    rows = fx("fx_records").select("seq", F.concat("property_value", F.lit(', "q" |')).alias("value"))
    writers.write_csv(rows, path)
    back = schedule_csv.read_table(fx.spark, path)
    return back.select(F.col("seq").cast("bigint").alias("seq"), F.regexp_replace("value", r"\|$", "").alias("value"))


@query("A04_generic_csv", """SELECT CAST(s_suppkey AS STRING) AS "Column1", s_name AS "name", CAST(s_nationkey AS STRING) AS "name_1", CASE WHEN s_suppkey%2=0 THEN 'x' END AS "name_2" FROM {supplier}""")
def generic(fx):
    path = f"{work_dir(fx.spark)}/girderframe/csv-{uuid.uuid4().hex}"
    line = F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, F.lit("x,cut off")))
    rows = fx("supplier").select(F.col("s_suppkey").alias("n"), line.alias("line"))
    head = fx.spark.createDataFrame([(-1, ",name,name,name")], "n bigint, line string")
    writers.write_lines(head.unionByName(rows), ["n"], "line", path)
    return schedule_csv.read_table(fx.spark, path)


@query("C11_matched_and_dated", "SELECT seq, matched_object_id FROM {fx_match} WHERE match_status='Matched' AND planned_start IS NOT NULL")
def dated(fx):
    return sched.dated_only(matched(fx)).select("seq", "matched_object_id")


@query("D02_exact_match", "SELECT seq, match_status, matched_object_id, CASE WHEN match_status='Matched' THEN 1 ELSE 0 END AS match_count FROM {fx_match}")
def exact(fx):
    rows = sched.match(schedule(fx), with_parsed(fx("fx_records")), ScheduleOptions(ignore_case=False), fallback=False)
    return rows.select("seq", "match_status", "matched_object_id", "match_count")


@query("D03_fallback_match", """
WITH w AS (SELECT seq, CASE WHEN seq%4=0 THEN sync_id WHEN seq%4=1 THEN 'O' WHEN seq%4=2 THEN 'type-'||sync_id ELSE 'none' END AS sync_id, sync_id AS k FROM {fx_schedule}),
o AS (SELECT min_by(object_id, seq) AS object_id, count(*) AS n FROM {fx_split} WHERE property_name='Name' AND raw_value='O')
SELECT w.seq, CASE WHEN w.sync_id='' THEN 'Error' WHEN seq%4=0 AND e.object_id IS NOT NULL THEN 'Matched' WHEN seq%4=1 THEN 'Matched' ELSE 'NotFound' END AS match_status,
 CASE WHEN w.sync_id='' THEN NULL WHEN seq%4=0 THEN e.object_id WHEN seq%4=1 THEN o.object_id END AS matched_object_id, CASE WHEN w.sync_id='' THEN NULL WHEN seq%4=0 AND e.object_id IS NOT NULL THEN 'Element.Id' WHEN seq%4=1 THEN 'Item.Name' END AS match_property,
 CASE WHEN w.sync_id='' THEN 0 WHEN seq%4=0 AND e.object_id IS NOT NULL THEN 1 WHEN seq%4=1 THEN o.n ELSE 0 END AS match_count
FROM w CROSS JOIN o LEFT JOIN (SELECT raw_value, object_id FROM {fx_split} WHERE property_name='Id') e ON e.raw_value=w.sync_id""")
def fallback(fx):
    k = F.col("seq") % 4
    wanted = F.when(k == 0, F.col("sync_id")).when(k == 1, "O").when(k == 2, F.concat(F.lit("type-"), "sync_id")).otherwise("none")
    rows = sched.match(schedule(fx).withColumn("sync_id", wanted), with_parsed(fx("fx_records")), ScheduleOptions(match_category="Element", match_property="UniqueId"))
    return rows.select("seq", "match_status", "matched_object_id", "match_property", "match_count")


@query("D04_case_insensitive_match", """
SELECT s.seq, min_by(p.object_id, p.seq) AS matched_object_id, count(p.object_id) AS match_count FROM {fx_schedule} s LEFT JOIN (SELECT * FROM {fx_split} WHERE property_name='Type') p ON lower(p.raw_value)=CASE WHEN s.seq%2=0 THEN '1-urgent' ELSE 'unknown' END GROUP BY s.seq""")
def case_insensitive(fx):
    rows = schedule(fx).withColumn("sync_id", F.when(F.col("seq") % 2 == 0, "1-uRGENT").otherwise("unknown"))
    options = ScheduleOptions(match_category="Item", match_property="Type")
    return sched.match(rows, with_parsed(fx("fx_records")), options).select("seq", "matched_object_id", "match_count")


@query("D05_batch_match", "SELECT seq, match_status, CASE match_status WHEN 'Error' THEN 'SyncID가 비어있습니다.' WHEN 'NotFound' THEN '해당 SyncID를 가진 객체를 찾을 수 없습니다.' ELSE '' END AS match_error FROM {fx_match}")
def batch(fx):
    return matched(fx).select("seq", "match_status", "match_error")


@query("D05_not_found_list", "SELECT sync_id, seq FROM {fx_match} WHERE match_status='NotFound'")
def missing(fx):
    return sched.not_found(matched(fx))


_GUID = "'0000bbbb-1111-2222-3333-'||lpad(CAST(seq AS STRING),12,'0')"


@query("D06_direct_match", f"SELECT seq, CASE WHEN seq%3=0 THEN {_GUID} END AS matched_object_id, CASE WHEN seq%3=0 THEN 'Matched' ELSE 'NotFound' END AS match_status FROM {{fx_schedule}}")
def direct(fx):
    guid = F.concat(F.lit("0000bbbb-1111-2222-3333-"), F.lpad(F.col("seq").cast("string"), 12, "0"))
    objects = fx("fx_schedule").filter("seq % 3 <> 1").select(guid.alias("object_id"))
    k = F.col("seq") % 3
    wanted = F.when(k == 0, F.upper(guid)).when(k == 1, guid).otherwise("not a guid")
    return sched.match_direct(fx("fx_schedule").withColumn("sync_id", wanted), objects).select("seq", "matched_object_id", "match_status")


@query("E17_match_totals", """
SELECT count(*) AS total, count(*) FILTER (match_status='Matched') AS matched, count(*) FILTER (match_status='NotFound') AS not_found, count(*) FILTER (match_status='Error') AS errors, CAST(0 AS BIGINT) AS multiple, round(count(*) FILTER (match_status='Matched')*100.0/count(*),6) AS match_rate, count(*) FILTER (match_status='Matched')*100.0/count(*)>=80 AS passes FROM {fx_match}""")
def match_totals(fx):
    return sched.match_totals(matched(fx), 80.0)


_KEYS = {
    "parent_set": "coalesce(parent_set,'Ungrouped')",
    "zone": "coalesce(split_part(parent_set,'/',1),'Ungrouped')",
    "zone_level": "coalesce(split_part(parent_set,'/',1)||'/'||split_part(parent_set,'/',2),'Ungrouped')",
    "task_name": "task_name",
    "start_week": "CAST(year(planned_start) AS STRING)||'-W'||lpad(CAST(CASE WHEN month(planned_start)=12 AND weekofyear(planned_start)=1 THEN 53 ELSE weekofyear(planned_start) END AS STRING),2,'0')",
    "task_type": _TYPE,
    "none": "sync_id",
}
_KEY_UNION = " UNION ALL ".join(
    f"SELECT '{s}' AS strategy, {k} AS set_key, count(*) AS n FROM {{fx_match}} WHERE match_status='Matched' GROUP BY 2" for s, k in _KEYS.items()
)


@query("E21_set_grouping", _KEY_UNION)
def grouping(fx):
    rows = sched.matched_only(matched(fx))
    out = None
    for strategy in _KEYS:
        frame = sched.set_members(rows, strategy).groupBy(F.lit(strategy).alias("strategy"), "set_key").agg(F.count(F.lit(1)).alias("n"))
        out = frame if out is None else out.unionByName(frame)
    return out


_SETS = """
WITH g AS (SELECT coalesce(parent_set,'Ungrouped') AS set_key, count(*) AS row_count FROM {fx_match} WHERE match_status='Matched' GROUP BY 1),
b AS (SELECT *, CASE WHEN contains(set_key,'/') THEN split_part(set_key,'/',3) ELSE set_key END AS base FROM g),
sets AS (SELECT set_key, row_count, row_count AS item_count, CASE WHEN set_key=min(set_key) OVER (PARTITION BY lower(base)) THEN base ELSE base||'_'||CAST(row_count AS STRING)||'items' END AS set_name FROM b),
links AS (SELECT m.seq, m.sync_id, m.task_name, m.parent_set, m.planned_start, m.matched_object_id, m.task_type_raw, s.set_key, s.set_name, s.item_count FROM {fx_match} m JOIN sets s ON s.set_key=coalesce(m.parent_set,'Ungrouped') WHERE m.match_status='Matched')
"""


def set_tables(fx):
    rows = matched(fx)
    objects = props.object_ids(fx("fx_records"))
    set_table = sched.sets(rows, objects)
    return rows, objects, set_table


@query("G05_set_names", _SETS + "SELECT set_key, set_name, row_count, item_count FROM sets")
def set_names(fx):
    return set_tables(fx)[2].select("set_key", "set_name", "row_count", "item_count")


@query("E22_set_totals", _SETS + """
SELECT count(*) AS set_count, CAST(sum(item_count) AS BIGINT) AS item_count, (SELECT count(DISTINCT lower(f))+1 FROM (SELECT split_part(set_key,'/',1) AS f FROM sets UNION SELECT split_part(set_key,'/',1)||'/'||split_part(set_key,'/',2) FROM sets WHERE contains(set_key,'/') UNION SELECT set_key FROM sets)) AS folder_count FROM sets""")
def set_totals(fx):
    return sched.set_totals(set_tables(fx)[2])


@query("D13_set_links", _SETS + "SELECT seq, set_key, set_name, item_count FROM links")
def set_links(fx):
    rows, _, set_table = set_tables(fx)
    return sched.set_links(rows, set_table).select("seq", "set_key", "set_name", "item_count")


@query("D13_set_links_by_name", _SETS + """
SELECT m.seq, s.set_key FROM (SELECT *, CASE WHEN parent_set IS NULL THEN sync_id ELSE split_part(parent_set,'/',3) END AS wanted FROM {fx_match} WHERE match_status='Matched') m LEFT JOIN sets s ON lower(s.set_name)=lower(m.wanted)""")
def legacy_links(fx):
    rows, _, set_table = set_tables(fx)
    return sched.set_links(rows, set_table, legacy_link=True).select("seq", "set_key")


def task_table(fx, **options):
    rows, objects, set_table = set_tables(fx)
    links = sched.set_links(rows, set_table)
    return sched.tasks(rows, links, objects, ScheduleOptions(**options))


_TASKS = _SETS + f""", tasks AS (SELECT seq, sync_id, task_name, coalesce(parent_set,'') AS folder_path, 'AWP 4D Tasks/'||CASE WHEN parent_set IS NULL THEN '' ELSE parent_set||'/' END||task_name AS full_path, strftime(planned_start,'%Y-%m-%d') AS planned_start, {_TYPE} AS task_type, TRUE AS linked, item_count AS linked_items FROM links)
"""


@query("L07_tasks", _TASKS + "SELECT * FROM tasks")
def tasks(fx):
    return task_table(fx).drop("planned_end", "matched_object_id").withColumn("planned_start", F.date_format("planned_start", "yyyy-MM-dd"))


@query("L07_flat_explicit_tasks", _TASKS + "SELECT seq, '' AS folder_path, 'AWP 4D Tasks/'||task_name AS full_path, 1 AS linked_items FROM tasks")
def flat_tasks(fx):
    return task_table(fx, hierarchical_tasks=False, link_mode="explicit").select("seq", "folder_path", "full_path", "linked_items")


@query("L07_task_folders", _TASKS + """
SELECT DISTINCT lower(f) AS folder_key FROM (SELECT split_part(folder_path,'/',1) AS f FROM tasks WHERE folder_path<>'' UNION SELECT split_part(folder_path,'/',1)||'/'||split_part(folder_path,'/',2) FROM tasks WHERE folder_path<>'' UNION SELECT folder_path FROM tasks WHERE folder_path<>'')""")
def task_folders(fx):
    return sched.task_folders(task_table(fx)).select("folder_key")


@query("E23_task_totals", _TASKS + "SELECT count(*) AS total, count(*) FILTER (linked) AS linked, count(*) FILTER (NOT linked) AS unlinked FROM tasks")
def task_totals(fx):
    return sched.task_totals(task_table(fx))


@query("D14_task_lookup", _TASKS + "SELECT sync_id, task_name, linked_items FROM tasks")
def task_lookup(fx):
    wanted = fx("fx_schedule").select(F.upper("sync_id").alias("sync_id"))
    return sched.find_task(task_table(fx), wanted).select("sync_id", "task_name", "linked_items")


@query("D14_linked_sets", _TASKS + "SELECT tasks.sync_id AS task_sync_id, set_key FROM tasks JOIN links USING (seq)")
def linked_sets(fx):
    """All tasks with their set; the members of the sets are kept once."""
    rows, _, set_table = set_tables(fx)
    links = sched.set_links(rows, set_table)
    return sched.linked_sets(task_table(fx), links, fx("fx_schedule"))


@query("D14_linked_objects", _TASKS + "SELECT task_sync_id, m.object_id, count(*) AS n FROM (SELECT sync_id AS task_sync_id, set_key FROM links WHERE sync_id LIKE '%00') t JOIN (SELECT set_key, matched_object_id AS object_id FROM links) m USING (set_key) GROUP BY ALL")
def linked_objects(fx):
    """Members behind the tasks whose id ends in 00, which is what is asked for."""
    rows, _, set_table = set_tables(fx)
    links, members = sched.set_links(rows, set_table), sched.set_members(sched.matched_only(rows), "parent_set")
    return sched.linked_object_counts(task_table(fx), members, links, fx("fx_schedule").filter("sync_id LIKE '%00'"))


@query("G08_task_order", _TASKS + "SELECT seq, row_number() OVER (ORDER BY folder_path, seq) AS position FROM tasks")
def task_order(fx):
    from girderframe.operators.numbering import global_row_number

    ordered = sched.ordered_tasks(task_table(fx))
    return global_row_number(ordered, [F.col("folder_path"), F.col("seq")], "position").select("seq", "position")


@query("D15_write_back", f"""
WITH m AS (SELECT *, {_TYPE} AS task_type, seq%3 AS progress, date_diff('day',planned_start,planned_end) AS days FROM {{fx_match}} WHERE match_status='Matched'),
added AS (SELECT matched_object_id AS object_id, n.name AS property_name, CASE n.no WHEN 0 THEN sync_id WHEN 1 THEN task_name WHEN 2 THEN strftime(planned_start,'%Y-%m-%d') WHEN 3 THEN strftime(planned_end,'%Y-%m-%d') WHEN 4 THEN CASE WHEN days>0 THEN CAST(days AS STRING) END
 WHEN 5 THEN replace(replace(cost_raw,'$',''),',','')||'.00000000' WHEN 6 THEN CASE WHEN progress>0 THEN CAST(progress AS STRING)||'.0' END WHEN 7 THEN task_type ELSE parent_set END AS property_value
 FROM m CROSS JOIN (SELECT 0 AS no,'SyncID' AS name UNION ALL SELECT 1,'작업명' UNION ALL SELECT 2,'계획시작일' UNION ALL SELECT 3,'계획종료일' UNION ALL SELECT 4,'기간(일)' UNION ALL SELECT 5,'비용' UNION ALL SELECT 6,'진행률' UNION ALL SELECT 7,'작업유형' UNION ALL SELECT 8,'상위그룹') n)
SELECT object_id, 'Item' AS category, property_name, property_value FROM added WHERE property_value IS NOT NULL
UNION ALL SELECT object_id, category, property_name, property_value FROM {{fx_records}} WHERE NOT (category='Item' AND object_id IN (SELECT matched_object_id FROM m))""")
def write_back(fx):
    return sched.write_back(fx("fx_records"), matched(fx), "Item").drop("seq")


@query("D15_write_counts", """
SELECT count(*) AS total, count(*) FILTER (match_status='Matched' AND seq%2=0) AS succeeded, count(*) FILTER (match_status='Matched' AND seq%2<>0) AS failed, count(*) FILTER (match_status<>'Matched') AS skipped FROM {fx_match}""")
def write_counts(fx):
    half = fx("fx_schedule").filter("seq % 2 = 0").select(F.concat(F.lit("O:"), F.col("seq").cast("string")).alias("object_id"))
    return sched.write_counts(matched(fx), half)


@query("D16_remove_category", "SELECT seq FROM {fx_records} WHERE category<>'Dimensions'")
def remove(fx):
    return sched.remove_category(fx("fx_records"), "Dimensions").select("seq")


@query("D17_geometry_with_schedule", """
SELECT m.matched_object_id, m.task_name, strftime(m.planned_start,'%Y-%m-%d') AS planned_start, (g.min_x+g.max_x)*0.5 AS centroid_x, (g.min_z+g.max_z)*0.5 AS centroid_z FROM {fx_match} m JOIN {fx_geometry} g ON g.object_id=m.matched_object_id WHERE m.match_status='Matched'""")
def with_geometry(fx):
    rows = sched.geometry_with_schedule(fx("fx_geometry"), matched(fx))
    return rows.drop("centroid_y").withColumn("planned_start", F.date_format("planned_start", "yyyy-MM-dd"))


@query("E18_duplicate_sync_ids", "SELECT sync_id, count(*) AS n FROM (SELECT CASE WHEN seq%10=0 THEN 'twice-'||CAST(seq%100 AS STRING) ELSE sync_id END AS sync_id FROM {fx_schedule}) WHERE sync_id<>'' GROUP BY sync_id HAVING count(*)>1")
def duplicates(fx):
    doubled = F.when(F.col("seq") % 10 == 0, F.concat(F.lit("twice-"), (F.col("seq") % 100).cast("string"))).otherwise(F.col("sync_id"))
    return sched.duplicate_sync_ids(fx("fx_schedule").withColumn("sync_id", doubled))


@query("E19_date_checks", "SELECT count(*) AS total, count(*) FILTER (sync_id<>'' AND (planned_end IS NULL OR planned_start<=planned_end)) AS valid, count(*) FILTER (planned_start>planned_end) AS start_after_end FROM {fx_schedule}")
def date_checks(fx):
    return sched.date_checks(fx("fx_schedule"))


@query("E24_tasks_per_parent", "SELECT coalesce(parent_set,'') AS parent_set, count(*) AS tasks FROM {fx_schedule} GROUP BY 1")
def per_parent(fx):
    return sched.tasks_per_parent(fx("fx_schedule"))


@query("E24_first_tasks", "SELECT sync_id, task_name FROM {fx_schedule} ORDER BY seq LIMIT 5")
def first_tasks(fx):
    return sched.preview(fx("fx_schedule"), 5).select("sync_id", "task_name")


GENERATION = {"start": "2026-02-01", "days": 2, "prefix": "Steel Erection", "strategy": "category", "task_type": "구성"}
_GENERATED = """
WITH o AS (SELECT object_id, min_by(CASE WHEN property_name='Type' THEN property_value END, CASE WHEN property_name='Type' THEN seq END) AS kind, row_number() OVER (ORDER BY min(seq), object_id) AS k FROM {fx_records} GROUP BY object_id),
gen AS (SELECT object_id AS sync_id, 'Steel Erection '||CAST(k AS STRING) AS task_name, strftime(DATE '2026-02-01' + CAST((k-1)*2 AS INT),'%Y-%m-%d') AS planned_start, strftime(DATE '2026-02-01' + CAST(k*2 AS INT),'%Y-%m-%d') AS planned_end, 'Construct' AS task_type, kind AS parent_set, k AS seq FROM o)
"""


@query("G01_sequential_schedule", _GENERATED + "SELECT * FROM gen")
def generated(fx):
    rows = sched.generate(fx("fx_records"), **GENERATION)
    return rows.select(
        "sync_id", "task_name", scheduling.iso_date("planned_start").alias("planned_start"),
        scheduling.iso_date("planned_end").alias("planned_end"), "task_type", "parent_set", "seq",
    )


@query("E25_generation_totals", "SELECT count(DISTINCT object_id) AS selected, count(DISTINCT object_id)*2 AS total_days FROM {fx_records}")
def generation_totals(fx):
    return sched.generation_totals(sched.generate(fx("fx_records"), **GENERATION), 2)


@query("S17_schedule_frame", _GENERATED + """SELECT sync_id AS "SyncID", task_name AS "TaskName", planned_start AS "PlannedStart", planned_end AS "PlannedEnd", planned_start AS "ActualStart", planned_end AS "ActualEnd", task_type AS "TaskType", parent_set AS "ParentSet", '0' AS "Progress" FROM gen""")
def schedule_frame(fx):
    return frames.schedule(sched.generate(fx("fx_records"), **GENERATION), "actual_from_planned")


@query("L03_schedule_job", _TASKS + "SELECT t.*, l.set_name FROM tasks t JOIN links l ON l.seq=t.seq")
def schedule_job(fx):
    run = jobs.schedule_job(schedule(fx), with_parsed(fx("fx_records")))
    out = run.frames["tasks"].drop("planned_end", "matched_object_id").withColumn("planned_start", F.date_format("planned_start", "yyyy-MM-dd"))
    links = sched.set_links(run.frames["matched"], run.frames["sets"])
    return out.join(links.select("seq", "set_name"), "seq")


@query("L03_dry_run", "SELECT seq, match_status FROM {fx_match}")
def dry_run(fx):
    run = jobs.schedule_job(schedule(fx), with_parsed(fx("fx_records")), ScheduleOptions.for_dry_run())
    assert "tasks" not in run.frames and run.stopped_at == "dry_run"
    return run.frames["matched"].select("seq", "match_status")


@query("L04_generated_job", _GENERATED + "SELECT sync_id, task_name, planned_start, parent_set AS folder_path, TRUE AS linked FROM gen")
def generated_job(fx):
    guid = lambda c: F.concat(F.lit("0000bbbb-1111-2222-3333-"), F.lpad(F.substring(c, 3, 20), 12, "0"))
    rows = fx("fx_records").withColumn("object_id", guid("object_id"))
    run = jobs.generated_schedule_job(rows, ScheduleOptions(enable_property_write=False), **GENERATION)
    back = F.concat(F.lit("O:"), F.regexp_replace(F.substring("sync_id", 25, 12), "^0+(?=.)", ""))
    return run.frames["tasks"].select(
        back.alias("sync_id"), "task_name", scheduling.iso_date("planned_start").alias("planned_start"), "folder_path", "linked"
    )


@query("L08_pre_checks", """
SELECT 100 AS code, 'warning' AS severity, sync_id AS item, concat_ws('; ', CASE WHEN sync_id='' THEN 'SyncID가 비어있습니다.' END, CASE WHEN planned_start>planned_end THEN '시작일('||strftime(planned_start,'%Y-%m-%d')||')이 종료일('||strftime(planned_end,'%Y-%m-%d')||')보다 늦습니다.' END) AS message FROM {fx_schedule} WHERE sync_id='' OR planned_start>planned_end
UNION ALL SELECT 600, 'error', '', 'batch_size must lie in 1..10000' UNION ALL SELECT 100, 'warning', '', 'start after end: '||CAST(count(*) AS STRING) FROM {fx_schedule} WHERE planned_start>planned_end""")
def pre_checks(fx):
    return jobs.pre_checks(schedule(fx), ScheduleOptions(batch_size=0))


@query("E27_post_checks", _TASKS + """
SELECT 0 AS code, 'info' AS severity, 'not matched: '||CAST(count(*) FILTER (match_status='NotFound') AS STRING) AS message, '' AS item FROM {fx_match}
UNION ALL SELECT 0, 'info', 'property rows written: '||CAST(count(*) FILTER (match_status='Matched') AS STRING)||'/'||CAST(count(*) AS STRING), '' FROM {fx_match}
UNION ALL SELECT 0, 'info', 'sets: '||CAST(count(*) AS STRING)||', objects: '||CAST(CAST(sum(item_count) AS BIGINT) AS STRING), '' FROM sets
UNION ALL SELECT 0, 'info', 'tasks: '||CAST(count(*) AS STRING)||', linked: '||CAST(count(*) FILTER (linked) AS STRING), '' FROM tasks
UNION ALL SELECT 0, 'info', 'overall success: '||CAST(round(count(*) FILTER (match_status='Matched')*100.0::DECIMAL(20,10)/count(*),1) AS DECIMAL(20,1))::VARCHAR||'% ('||CAST(count(*) FILTER (match_status='Matched') AS STRING)||'/'||CAST(count(*) AS STRING)||')', '' FROM {fx_match}""")
def post_checks(fx):
    return jobs.schedule_job(schedule(fx), with_parsed(fx("fx_records"))).frames["post_checks"]


@query("G07_finding_lines", """
WITH d AS (SELECT sync_id, count(*) AS n FROM (SELECT lower(p_brand) AS sync_id FROM {part}) GROUP BY sync_id HAVING count(*)>1),
r AS (SELECT *, row_number() OVER (ORDER BY sync_id) AS k, count(*) OVER () AS total FROM d)
SELECT 1000 AS line_no, 'warnings: '||CAST(max(total) AS STRING) AS line FROM r HAVING count(*)>0
UNION ALL SELECT CAST(1000+k AS INT), '  - [100] duplicate, rows: '||CAST(n AS STRING) FROM r WHERE k<=3
UNION ALL SELECT 1999, '  ... '||CAST(max(total)-3 AS STRING)||' more' FROM r HAVING max(total)>3""")
def finding_lines(fx):
    doubled = fx("part").groupBy(F.lower("p_brand").alias("item")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    findings = doubled.select(F.lit(100).alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("duplicate, rows: "), F.col("n").cast("string")).alias("message"), "item")
    return jobs.finding_lines(findings)


@query("L10_clear_outputs", "SELECT seq, CAST(0 AS BIGINT) AS deleted FROM {fx_schedule} WHERE seq%3<>0 UNION ALL SELECT -1, count(*) FROM {fx_schedule} WHERE seq%3=0")
def clear(fx):
    table = fx("fx_schedule").withColumn("root_folder", F.when(F.col("seq") % 3 == 0, "AWP 4D Tasks").otherwise("Other"))
    out = jobs.clear_outputs(table, table, ScheduleOptions())
    kept = out["tasks"].select("seq", F.lit(0).cast("bigint").alias("deleted"))
    return kept.unionByName(out["deleted_tasks"].select(F.lit(-1).cast("bigint").alias("seq"), "deleted"))


_RULES = r"""
WITH o AS (SELECT object_id, CASE category WHEN 'Structural Column' THEN 'Column' WHEN '큰보' THEN 'Beam' WHEN 'Floors' THEN 'Slab' WHEN 'Curtain Wall' THEN 'Wall' WHEN 'Mat Foundation' THEN 'Foundation' WHEN 'Air Duct' THEN 'Duct' WHEN 'piping run' THEN 'Pipe' END AS class,
 nullif(regexp_extract(sys_path,'\b(A[0-9]+)\b',1),'') AS same_area, nullif(regexp_extract(sys_path,'\b(U[0-9]+)\b',1),'') AS same_unit, nullif(regexp_extract(sys_path,'\b(Level\s*[0-9]+|L[0-9]+|[0-9]+F|B[0-9]+)\b',1),'') AS same_level FROM {fx_rule_objects}),
sup(class, super) AS (VALUES ('Column','Column'),('Beam','Beam'),('Slab','Slab'),('Wall','Wall'),('Foundation','Foundation'),('Duct','Duct'),('Pipe','Pipe'),('Column','StructuralElement'),('Beam','StructuralElement'),('Slab','StructuralElement'),('Wall','StructuralElement'),('Foundation','StructuralElement'),('Duct','MEPElement'),('Pipe','MEPElement')),
rule(pred, succ, condition, priority) AS (VALUES ('Foundation','Column','same_level',1),('Column','Beam','same_level',2),('Beam','Slab','same_level',3),('StructuralElement','Wall','same_level',4),('StructuralElement','MEPElement','same_level',10),('StructuralElement','MEPElement','same_area',10),('Foundation','Column','same_unit',1),('Column','Beam','same_unit',2),('StructuralElement','Pipe','same_unit',10)),
n AS (SELECT 'same_level' AS condition, class, same_level AS key, count(*) AS objects FROM o WHERE class IS NOT NULL AND same_level IS NOT NULL GROUP BY class, same_level UNION ALL SELECT 'same_area', class, same_area, count(*) FROM o WHERE class IS NOT NULL AND same_area IS NOT NULL GROUP BY class, same_area UNION ALL SELECT 'same_unit', class, same_unit, count(*) FROM o WHERE class IS NOT NULL AND same_unit IS NOT NULL GROUP BY class, same_unit),
lv(key, order_no) AS (VALUES ('B1',-1),('1F',1),('2F',2),('10F',10)),
up AS (SELECT class, n.key, lead(n.key) OVER (PARTITION BY class ORDER BY order_no) AS succ_key, objects, lead(objects) OVER (PARTITION BY class ORDER BY order_no) AS succ_objects FROM n JOIN lv ON lv.key=n.key WHERE condition='same_level'),
edges AS (SELECT r.condition, min(r.priority) AS priority, a.class AS pred_class, a.key AS pred_key, b.class AS succ_class, b.key AS succ_key, a.objects AS pred_objects, b.objects AS succ_objects FROM rule r JOIN sup sa ON sa.super=r.pred JOIN sup sb ON sb.super=r.succ JOIN n a ON a.class=sa.class AND a.condition=r.condition JOIN n b ON b.class=sb.class AND b.condition=r.condition AND b.key=a.key WHERE a.class<>b.class GROUP BY ALL
UNION ALL SELECT 'lower_level_first', 0, class, key, class, succ_key, objects, succ_objects FROM up WHERE succ_key IS NOT NULL)
"""


def classified(fx):
    path = F.col("sys_path")
    return fx("fx_rule_objects").select(
        "object_id", classify.classify(F.col("category")).alias("class"),
        *[classify.extract(path, n).alias(n) for n in ("area_name", "unit_name", "level_name")],
    )


@query("D18_precedence_edges", _RULES + "SELECT * FROM edges")
def precedence_edges(fx):
    return precedence.precedence_edges(classified(fx))


@query("J03_superclasses", _RULES + "SELECT object_id, super AS class FROM o JOIN sup ON sup.class=o.class UNION ALL SELECT object_id, 'ModelObject' FROM o WHERE class IS NOT NULL")
def superclasses(fx):
    return precedence.superclass_members(classified(fx))


_CLOSURE = _RULES.replace("WITH o AS", "WITH RECURSIVE o AS", 1) + """, e AS (SELECT DISTINCT pred_class||'@'||pred_key AS a, succ_class||'@'||succ_key AS b FROM edges),
p AS (SELECT a, b, 1 AS depth FROM e UNION SELECT p.a, e.b, p.depth+1 FROM p JOIN e ON e.a=p.b WHERE p.depth<5)
"""


def class_edges(fx):
    return precedence.precedence_edges(classified(fx))


@query("J04_transitive_precedence", _CLOSURE + "SELECT a AS pred, b AS succ, min(depth) AS depth FROM p GROUP BY a, b")
def closure(fx):
    from girderframe.operators.graph import transitive_edges

    found = transitive_edges(class_edges(fx), ["class", "key"], 5)
    return found.select(F.concat_ws("@", "pred_class", "pred_key").alias("pred"), F.concat_ws("@", "succ_class", "succ_key").alias("succ"), "depth")


@query("J04_inverse_and_symmetric", _RULES + """, e AS (SELECT DISTINCT pred_class||'@'||pred_key AS a, succ_class||'@'||succ_key AS b FROM edges WHERE condition='same_unit')
SELECT 'follows' AS kind, b AS a, a AS b FROM e UNION ALL SELECT 'parallel', a, b FROM (SELECT a, b FROM e UNION SELECT b, a FROM e)""")
def inverse(fx):
    edges = class_edges(fx).filter("condition = 'same_unit'")
    name = lambda s: F.concat_ws("@", f"{s}_class", f"{s}_key")
    back = precedence.inverse_edges(edges).select(F.lit("follows").alias("kind"), name("pred").alias("a"), name("succ").alias("b"))
    both = precedence.symmetric_edges(edges).select(F.lit("parallel").alias("kind"), name("pred").alias("a"), name("succ").alias("b"))
    return back.unionByName(both)


@query("D19_scored_match", r"""
WITH s AS (SELECT *, list_distinct(regexp_extract_all(lower(name),'[a-z0-9]+')) AS t FROM {fx_score_schedule}), o AS (SELECT *, list_distinct(regexp_extract_all(lower(name),'[a-z0-9]+')) AS t FROM {fx_score_objects}),
c AS (SELECT row_id, object_id FROM s JOIN o ON s.level_name=o.level_name AND s.category=o.category UNION SELECT row_id, object_id FROM s JOIN o ON s.level_name=o.level_name AND s.path=o.path UNION SELECT row_id, object_id FROM s JOIN o ON s.category=o.category AND s.path=o.path),
v AS (SELECT row_id, object_id, round(CASE WHEN s.level_name=o.level_name THEN 0.30::DOUBLE ELSE 0 END+CASE WHEN s.category=o.category THEN 0.25::DOUBLE ELSE 0 END+CASE WHEN s.path=o.path THEN 0.20::DOUBLE ELSE 0 END+CASE WHEN len(s.t)>0 AND len(o.t)>0 AND len(list_intersect(s.t,o.t))::DOUBLE/len(list_distinct(list_concat(s.t,o.t)))>=0.6 THEN 0.25::DOUBLE*(len(list_intersect(s.t,o.t))::DOUBLE/len(list_distinct(list_concat(s.t,o.t)))) ELSE 0 END,6) AS score FROM c JOIN s USING (row_id) JOIN o USING (object_id))
SELECT row_id, object_id, score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, object_id) AS r FROM v WHERE score>=0.7) WHERE r=1""")
def scored(fx):
    return precedence.scored_matches(fx("fx_score_schedule"), fx("fx_score_objects"))


@query("D19_hot_token", r"""
WITH s AS (SELECT *, list_distinct(regexp_extract_all(lower(name),'[a-z0-9]+')) AS t FROM (SELECT row_id, level_name, category, path, 'Pump Hall Unit '||CAST(row_id AS STRING)||' '||CASE WHEN row_id%3=0 THEN 'North' ELSE name END AS name FROM {fx_score_schedule})), o AS (SELECT *, list_distinct(regexp_extract_all(lower(name),'[a-z0-9]+')) AS t FROM (SELECT object_id, level_name, category, path, 'Pump Hall Unit '||name AS name FROM {fx_score_objects})),
c AS (SELECT row_id, object_id FROM s JOIN o ON s.level_name=o.level_name AND s.category=o.category UNION SELECT row_id, object_id FROM s JOIN o ON s.level_name=o.level_name AND s.path=o.path UNION SELECT row_id, object_id FROM s JOIN o ON s.category=o.category AND s.path=o.path),
v AS (SELECT row_id, object_id, round(CASE WHEN s.level_name=o.level_name THEN 0.30::DOUBLE ELSE 0 END+CASE WHEN s.category=o.category THEN 0.25::DOUBLE ELSE 0 END+CASE WHEN s.path=o.path THEN 0.20::DOUBLE ELSE 0 END+CASE WHEN len(s.t)>0 AND len(o.t)>0 AND len(list_intersect(s.t,o.t))::DOUBLE/len(list_distinct(list_concat(s.t,o.t)))>=0.6 THEN 0.25::DOUBLE*(len(list_intersect(s.t,o.t))::DOUBLE/len(list_distinct(list_concat(s.t,o.t)))) ELSE 0 END,6) AS score FROM c JOIN s USING (row_id) JOIN o USING (object_id))
SELECT row_id, object_id, score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, object_id) AS r FROM v WHERE score>=0.7) WHERE r=1""")
def scored_hot(fx):
    """Three tokens that every name holds; blocks above a thousand pairs are split."""
    plan_name = F.concat(F.lit("Pump Hall Unit "), F.col("row_id").cast("string"), F.lit(" "), F.when(F.col("row_id") % 3 == 0, "North").otherwise(F.col("name")))
    object_name = F.concat(F.lit("Pump Hall Unit "), F.col("name"))
    plan_rows, object_rows = fx("fx_score_schedule").withColumn("name", plan_name), fx("fx_score_objects").withColumn("name", object_name)
    return precedence.scored_matches(plan_rows, object_rows, block_pairs=1_000, part_rows=20)


@query("S01_hierarchy_frame", """SELECT object_id AS "ObjectId", parent_id AS "ParentId", level AS "Level", display_name AS "DisplayName", category AS "Category", property_name AS "PropertyName", property_value AS "PropertyValue", raw_value AS "RawValue", data_type AS "DataType", unit AS "Unit" FROM {fx_parsed}""")
def hierarchy_frame(fx):
    return frames.hierarchy(with_parsed(fx("fx_records")))


@query("S03_nested_json_lines", "SELECT count(*) AS properties, (SELECT count(DISTINCT object_id) FROM {fx_records}) AS nodes FROM {fx_records}")
def nested(fx):
    lines = nested_json_lines(with_parsed(fx("fx_records")))
    return lines.agg(F.count_if(F.col("kind") == 1).alias("properties"), F.count_if(F.col("kind") == 0).alias("nodes"))


@query("S04_raw_property_frame", """SELECT category AS "카테고리", property_name AS "속성 이름", property_value AS "값" FROM {fx_records}""")
def raw_frame(fx):
    return frames.raw_properties(fx("fx_records"))


@query("S05_refined_property_frame", """SELECT category AS "카테고리", property_name AS "속성 이름", data_type AS "데이터 타입", raw_value AS "원본 값", coalesce(CASE WHEN numeric_value=floor(numeric_value) THEN CAST(CAST(numeric_value AS BIGINT) AS STRING) ELSE CAST(numeric_value AS STRING) END,'') AS "숫자 값", unit AS "단위", property_value AS "DisplayString" FROM {fx_parsed}""")
def refined_frame(fx):
    return frames.refined_properties(fx("fx_records"))


@query("S09_geometry_frame", """
SELECT object_id AS "ObjectId", coalesce(display_name,'') AS "DisplayName", category AS "Category", CASE WHEN seq%8=0 THEN 0 ELSE min_x END::DOUBLE AS "MinX", CASE WHEN seq%8=0 THEN 0 ELSE max_z END::DOUBLE AS "MaxZ", CASE WHEN seq%8=0 THEN 0 ELSE (min_y+max_y)*0.5 END::DOUBLE AS "CentroidY",
 CASE WHEN seq%8=0 THEN 0 ELSE abs((max_x-min_x)*(max_y-min_y)*(max_z-min_z)) END::DOUBLE AS "Volume", CASE WHEN has_mesh THEN 'True' ELSE 'False' END AS "HasMesh", coalesce(mesh_uri,'') AS "MeshUri", coalesce(mesh_quality,'') AS "MeshQuality", vertex_count AS "VertexCount" FROM {fx_mesh_geometry}""")
def geometry_frame(fx):
    bounds = ["min_x", "min_y", "min_z", "max_x", "max_y", "max_z"]
    rows = fx("fx_mesh_geometry").withColumns({c: F.when(F.col("seq") % 8 != 0, F.col(c)) for c in bounds})
    return frames.geometry(rows).select(
        "ObjectId", "DisplayName", "Category", "MinX", "MaxZ", "CentroidY", "Volume", "HasMesh", "MeshUri", "MeshQuality", "VertexCount"
    )


@query("S10_manifest_metadata", """SELECT count(*) AS object_count, count(*) FILTER (has_mesh) AS mesh_count, min(min_x) AS min_x, max(max_z) AS max_z, 'Tower' AS project_name, '1.0.0' AS version FROM {fx_mesh_geometry}""")
def manifest(fx):
    meta = frames.manifest_metadata(fx("fx_mesh_geometry"), "Tower", "2026-01-01T00:00:00Z")
    return meta.select("object_count", "mesh_count", "min_x", "max_z", "project_name", "version")


@query("S10_manifest_objects", """
SELECT object_id, '{"objectId":"'||object_id||'",'||coalesce('"displayName":"'||display_name||'",','')||'"category":"'||category||'","bbox":{"min":{"x":'||CAST(min_x AS STRING)||',"y":'||CAST(min_y AS STRING)||',"z":'||CAST(min_z AS STRING)||'},"max":{"x":'||CAST(max_x AS STRING)||',"y":'||CAST(max_y AS STRING)||',"z":'||CAST(max_z AS STRING)||'}},"centroid":{"x":'||CAST((min_x+max_x)*0.5 AS STRING)||',"y":'||CAST((min_y+max_y)*0.5 AS STRING)||',"z":'||CAST((min_z+max_z)*0.5 AS STRING)||'},"hasMesh":'||CAST(has_mesh AS STRING)||',"meshUri":'||coalesce('"'||mesh_uri||'"','null')||',"meshQuality":'||coalesce('"'||mesh_quality||'"','null')||',"vertexCount":'||CAST(vertex_count AS STRING)||',"triangleCount":'||CAST(triangle_count AS STRING)||'}' AS json FROM {fx_mesh_geometry}""")
def manifest_objects(fx):
    return frames.manifest_objects(fx("fx_mesh_geometry"))


@query("S11_unified_frame", """
SELECT coalesce(p.object_id,g.object_id) AS "ObjectId", '1.0.0' AS "SchemaVersion", '2026-01-01T00:00:00Z' AS "ExportedAtUtc", coalesce(p.n,0) AS "PropertyCount", coalesce(CASE WHEN v>=1e-10 THEN CAST(round(CAST(g.max_x AS DECIMAL(30,12)),6) AS DECIMAL(30,6))::VARCHAR END,'') AS "BBoxMaxX",
 coalesce(CAST(round(CAST((g.min_z+g.max_z)*0.5 AS DECIMAL(30,12)),6) AS DECIMAL(30,6))::VARCHAR,'') AS "CentroidZ", CASE WHEN coalesce(g.has_mesh,FALSE) THEN 'true' ELSE 'false' END AS "HasMesh"
FROM (SELECT object_id, count(*) AS n FROM {fx_records} GROUP BY object_id) p FULL JOIN (SELECT *, abs((max_x-min_x)*(max_y-min_y)*(max_z-min_z)) AS v FROM {fx_mesh_geometry}) g ON g.object_id=p.object_id""")
def unified_frame(fx):
    from girderframe.operators.unified import merge

    rows = frames.unified(merge(fx("fx_records"), fx("fx_mesh_geometry")), "2026-01-01T00:00:00Z")
    return rows.select("ObjectId", "SchemaVersion", "ExportedAtUtc", "PropertyCount", "BBoxMaxX", "CentroidZ", "HasMesh")


@query("K01_debounce", """
SELECT event_id, user_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM {events}) WHERE next_ts IS NULL OR next_ts-ts>INTERVAL 4 HOUR""")
def debounce(fx):
    return deb.debounce(fx("events"), "user_id", "ts", "event_id", 4 * 3600).select("event_id", "user_id", "event_type")


@query("K01_debounce_stream", """
SELECT event_id, user_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM {events}) WHERE next_ts IS NULL OR next_ts-ts>INTERVAL 4 HOUR""")
def debounce_stream(fx):
    """Events arrive in three files; the stream runs after the second and goes on from its checkpoint after the third."""
    base = f"{work_dir(fx.spark)}/girderframe/stream-{uuid.uuid4().hex}"
    columns = ["event_id", "ts", "user_id", "event_type"]
    events = fx("events").select(*columns)
    cuts = events.agg(F.expr("percentile(unix_micros(cast(ts as timestamp)), array(0.3, 0.7, 1.0))")).first()[0]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    options = {"key": "user_id", "time": "ts", "order": "event_id", "quiet_seconds": 4 * 3600, "lateness": "1 hour", "files_per_batch": 1}
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))

    def run():
        deb.run_debounce(fx.spark, f"{base}/in", events.schema, f"{base}/out", f"{base}/checkpoint", **options)

    for k, (low, high) in enumerate(zip([None, *cuts], cuts)):
        part = events.filter(at <= high) if low is None else events.filter((at > low) & (at <= high))
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        if k:
            run()
    end = events.agg(F.max("ts")).first()[0]
    deb.close_sessions(fx.spark, f"{base}/in", events.schema, "ts", end + timedelta(days=1))
    run()
    return fx.spark.read.parquet(f"{base}/out").select("event_id", "user_id", "event_type")
