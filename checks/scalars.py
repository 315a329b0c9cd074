"""Scalar functions over values derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from girderframe.functions import classify, display, formats, ids, rdf, scheduling, text, verdicts
from girderframe.functions.boxes import Box, Point, cylinder_fit, is_identity, relation, shape_hint, tolerance, transform_point


@query("I01_parse_display_string", """
SELECT object_id, seq, data_type, raw_value, numeric_value, unit, property_value AS original_string FROM {fx_parsed}""")
def parse(fx):
    return display.with_parsed(fx("fx_records")).select(
        "object_id", "seq", "data_type", "raw_value", "numeric_value", "unit", F.col("property_value").alias("original_string")
    )


@query("I02_normalize_unit", """
SELECT seq, CASE CAST(seq%8 AS INT) WHEN 0 THEN 'm' WHEN 1 THEN 'mm' WHEN 2 THEN 'sq ft' WHEN 3 THEN 'cu m' WHEN 4 THEN 'deg' WHEN 5 THEN 'ft^2' WHEN 6 THEN '' ELSE 'in' END AS unit FROM {fx_properties}""")
def units(fx):
    spellings = ["Meters", "MILLIMETER", "ft²", "Cubic Meters", "°", "ft^2", "  ", "Inches"]
    chain = F
    for i, s in enumerate(spellings):
        chain = chain.when(F.col("seq") % 8 == i, F.lit(s))
    return fx("fx_properties").select("seq", display.normalize_unit(chain.otherwise(F.lit(""))).alias("unit"))


@query("I03_measurement_flags", """
SELECT object_id, seq, numeric_value IS NOT NULL AS is_numeric, numeric_value IS NOT NULL AND unit<>'' AS is_measurement FROM {fx_parsed}""")
def measurement(fx):
    value = F.col("property_value")
    return fx("fx_records").select(
        "object_id", "seq", display.is_numeric(value).alias("is_numeric"), display.is_measurement(value).alias("is_measurement")
    )


_DAY_TEXT = """CASE CAST(seq%10 AS INT) WHEN 0 THEN y||'-'||m||'-'||d WHEN 1 THEN y||'/'||m||'/'||d WHEN 2 THEN y||'.'||m||'.'||d WHEN 3 THEN m||'/'||d||'/'||y
 WHEN 4 THEN '31/'||'12'||'/'||y WHEN 5 THEN d||'-'||m||'-'||y WHEN 6 THEN y||'-'||m||'-'||d||' 07:08:09' WHEN 7 THEN y||'/'||m||'/'||d||' 23:00:00' WHEN 8 THEN y||m||d ELSE 'soon' END"""


@query("I04_parse_date", """
SELECT seq, CASE CAST(seq%10 AS INT) WHEN 4 THEN CAST(year(planned_start) AS STRING)||'-12-31 00:00:00' WHEN 6 THEN strftime(planned_start,'%Y-%m-%d')||' 07:08:09'
 WHEN 7 THEN strftime(planned_start,'%Y-%m-%d')||' 23:00:00' WHEN 9 THEN NULL ELSE strftime(planned_start,'%Y-%m-%d')||' 00:00:00' END AS parsed FROM {fx_schedule}""")
def dates(fx):
    parts = fx("fx_schedule").select(
        "seq",
        F.date_format("planned_start", "yyyy").alias("y"),
        F.date_format("planned_start", "MM").alias("m"),
        F.date_format("planned_start", "dd").alias("d"),
    )
    texts = parts.select("seq", F.expr(_DAY_TEXT).alias("t"))
    return texts.select("seq", F.date_format(scheduling.parse_date(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("I05_parse_money", """
SELECT seq, CAST(replace(replace(cost_raw,'$',''),',','') AS DOUBLE) AS cost FROM {fx_schedule}""")
def money(fx):
    return fx("fx_schedule").select("seq", scheduling.parse_money(F.col("cost_raw")).cast("double").alias("cost"))


@query("I06_parse_percent", """
SELECT seq, CASE WHEN seq%3=0 THEN CAST(seq%100 AS DOUBLE) WHEN seq%3=1 THEN CAST(seq%100 AS DOUBLE)/2 ELSE CAST(0 AS DOUBLE) END AS progress FROM {fx_schedule}""")
def percent(fx):
    raw = (
        F.when(F.col("seq") % 3 == 0, F.concat((F.col("seq") % 100).cast("string"), F.lit("%")))
        .when(F.col("seq") % 3 == 1, F.concat(F.lit(" "), ((F.col("seq") % 100) / 2).cast("string"), F.lit(" %")))
        .otherwise(F.lit("n/a"))
    )
    return fx("fx_schedule").select("seq", scheduling.parse_percent(raw).alias("progress"))


@query("I07_task_type", """
SELECT seq, CASE WHEN task_type_raw IN ('Build','') THEN 'Construct' WHEN task_type_raw IN ('Demolish old','remove-temp') THEN 'Demolish' ELSE 'Temporary' END AS parsed,
 CASE WHEN task_type_raw IN ('Build','') THEN 'Construct' WHEN task_type_raw IN ('Demolish old','remove-temp') THEN 'Demolish' ELSE 'Temporary' END AS staged FROM {fx_schedule}""")
def task_types(fx):
    raw = F.col("task_type_raw")
    return fx("fx_schedule").select("seq", scheduling.task_type(raw).alias("parsed"), scheduling.task_stage_type(raw).alias("staged"))


@query("I08_week_key", """
SELECT seq, CAST(year(planned_start) AS STRING)||'-W'||lpad(CAST(CASE WHEN month(planned_start)=12 AND weekofyear(planned_start)=1 THEN 53 ELSE weekofyear(planned_start) END AS STRING),2,'0') AS week_key FROM {fx_schedule}""")
def weeks(fx):
    return fx("fx_schedule").select("seq", scheduling.week_key(F.col("planned_start")).alias("week_key"))


@query("I09_zone_parts", r"""
SELECT seq, split_part(parent_set,'/',1) AS zone, split_part(parent_set,'/',1)||'/'||split_part(parent_set,'/',2) AS zone_level, split_part(parent_set,'/',3) AS last_part FROM {fx_schedule}""")
def zones(fx):
    path = F.col("parent_set")
    messy = F.concat(F.lit("//"), F.regexp_replace(path, "/", r"\\\\"), F.lit("/"))
    return fx("fx_schedule").select(
        "seq", scheduling.zone(messy).alias("zone"), scheduling.zone_level(messy).alias("zone_level"), scheduling.last_part(messy).alias("last_part")
    )


@query("I10_parent_set_strategies", """
SELECT seq, 'Level-'||CAST(least(level,2) AS STRING) AS by_level, 'Level-'||CAST(level AS STRING) AS by_floor, 'Element' AS by_category,
 'Default-Area' AS by_area, 'L'||CAST(level AS STRING)||'/Element' AS by_composite, split_part(sys_path,' > ',2) AS by_property, 'Phase 1' AS by_custom FROM {fx_records}""")
def parent_sets(fx):
    common = {
        "level": F.col("level"), "display_name": F.col("display_name"), "sys_path": F.col("sys_path"), "values": {},
        "level_cap": 2, "custom": "Phase 1",
    }
    return fx("fx_records").select(
        "seq", *[scheduling.parent_set(s, **common).alias(f"by_{s}") for s in scheduling.PARENT_SET_STRATEGIES]
    )


@query("I11_category_from_name", """
SELECT p_partkey, CASE WHEN regexp_matches(p_name,'^[A-Za-z]') THEN regexp_extract(p_name,'^([A-Za-z]+)',1) ELSE split_part(p_name,' ',1) END AS category, '42' AS numbered FROM {part}""")
def name_category(fx):
    return fx("part").select(
        "p_partkey", scheduling.category_from_name(F.col("p_name")).alias("category"),
        scheduling.category_from_name(F.concat(F.lit("42_"), "p_name")).alias("numbered"),
    )


@query("I12_duration_days", """
SELECT seq, CAST(coalesce(date_diff('day',planned_start,planned_end),0) AS INT) AS days FROM {fx_schedule}""")
def durations(fx):
    return fx("fx_schedule").select("seq", scheduling.duration_days(F.col("planned_start"), F.col("planned_end")).alias("days"))


@query("I13_schedule_errors", """
SELECT seq, sync_id<>'' AND (planned_end IS NULL OR planned_start<=planned_end) AS valid,
 concat_ws('; ', CASE WHEN sync_id='' THEN 'SyncID가 비어있습니다.' END, CASE WHEN planned_start>planned_end THEN '시작일('||strftime(planned_start,'%Y-%m-%d')||')이 종료일('||strftime(planned_end,'%Y-%m-%d')||')보다 늦습니다.' END) AS errors FROM {fx_schedule}""")
def schedule_rows(fx):
    args = F.col("sync_id"), F.col("planned_start"), F.col("planned_end")
    return fx("fx_schedule").select("seq", scheduling.is_valid_schedule(*args).alias("valid"), scheduling.schedule_errors(*args).alias("errors"))


@query("I14_actual_dates", """
SELECT seq, strftime(planned_start,'%Y-%m-%d') AS copied_start, strftime(planned_end,'%Y-%m-%d') AS copied_end, CAST(NULL AS STRING) AS planned_only_start FROM {fx_schedule}""")
def actual(fx):
    start, end = scheduling.actual_dates("actual_from_planned", F.col("planned_start"), F.col("planned_end"))
    none, _ = scheduling.actual_dates("planned_only", F.col("planned_start"), F.col("planned_end"))
    return fx("fx_schedule").select(
        "seq", F.date_format(start, "yyyy-MM-dd").alias("copied_start"), F.date_format(end, "yyyy-MM-dd").alias("copied_end"),
        F.date_format(none, "yyyy-MM-dd").alias("planned_only_start"),
    )


@query("I15_task_type_languages", """
SELECT seq, CASE task_type_raw WHEN '임시' THEN 'Temporary' ELSE task_type_raw END AS english, CASE WHEN seq%2=0 THEN '철거' ELSE 'other' END AS korean FROM {fx_schedule}""")
def languages(fx):
    name = F.when(F.col("seq") % 2 == 0, F.lit("DEMOLISH")).otherwise(F.lit("other"))
    return fx("fx_schedule").select(
        "seq", scheduling.task_type_to_english(F.col("task_type_raw")).alias("english"), scheduling.task_type_to_korean(name).alias("korean")
    )


@query("I16_box_scalars", """
SELECT object_id, (min_x+max_x)*0.5 AS cx, (min_y+max_y)*0.5 AS cy, (min_z+max_z)*0.5 AS cz, max_x-min_x AS sx, max_y-min_y AS sy, max_z-min_z AS sz,
 abs((max_x-min_x)*(max_y-min_y)*(max_z-min_z)) AS volume, 2*((max_x-min_x)*(max_y-min_y)+(max_y-min_y)*(max_z-min_z)+(max_z-min_z)*(max_x-min_x)) AS surface,
 round(sqrt(pow(max_x-min_x,2)+pow(max_y-min_y,2)+pow(max_z-min_z,2)),6) AS diagonal, min_x<=max_x AND min_y<=max_y AND min_z<=max_z AS is_valid,
 abs((max_x-min_x)*(max_y-min_y)*(max_z-min_z))<1e-10 AS is_empty FROM {fx_geometry}""")
def box_scalars(fx):
    b = Box.of()
    c, s = b.centroid(), b.size()
    return fx("fx_geometry").select(
        "object_id", c.x.alias("cx"), c.y.alias("cy"), c.z.alias("cz"), s.x.alias("sx"), s.y.alias("sy"), s.z.alias("sz"),
        b.volume().alias("volume"), b.surface().alias("surface"), F.round(b.diagonal(), 6).alias("diagonal"),
        b.is_valid().alias("is_valid"), b.is_empty().alias("is_empty"),
    )


@query("I17_box_pairs", """
SELECT object_id, least(min_x,10) AS union_min_x, greatest(max_z,11) AS union_max_z, hit, CASE WHEN hit THEN greatest(min_x,10) END AS inter_min_x, CASE WHEN hit THEN least(max_y,50) END AS inter_max_y,
 min_x-0.25 AS expanded_min_x, max_z+0.25 AS expanded_max_z, greatest(max_x,30) AS included_max_x,
 round(sqrt(pow(greatest(0,min_x-30,10-max_x),2)+pow(greatest(0,min_y-50,10-max_y),2)+pow(greatest(0,min_z-11,1-max_z),2)),6) AS distance,
 greatest(0,least(max_x,30)-greatest(min_x,10))*greatest(0,least(max_y,50)-greatest(min_y,10))*greatest(0,least(max_z,11)-greatest(min_z,1)) AS overlap_volume
FROM (SELECT *, max_x>=10 AND min_x<=30 AND max_y>=10 AND min_y<=50 AND max_z>=1 AND min_z<=11 AS hit FROM {fx_geometry})""")
def box_pairs(fx):
    b, o = Box.of(), Box.literal(10, 10, 1, 30, 50, 11)
    u, i, e, p = b.union(o), b.intersection(o), b.expand(F.lit(0.25)), b.include(Point.at(30, 0, 0))
    return fx("fx_geometry").select(
        "object_id", u.lo.x.alias("union_min_x"), u.hi.z.alias("union_max_z"), b.intersects(o).alias("hit"),
        i.lo.x.alias("inter_min_x"), i.hi.y.alias("inter_max_y"), e.lo.x.alias("expanded_min_x"), e.hi.z.alias("expanded_max_z"),
        p.hi.x.alias("included_max_x"), F.round(b.distance(o), 6).alias("distance"), b.overlap_volume(o).alias("overlap_volume"),
    )


@query("I18_point_functions", """
SELECT object_id, round(sqrt(pow(max_x-min_x,2)+pow(max_y-min_y,2)+pow(max_z-min_z,2)),6) AS distance, round(m,6) AS magnitude, CASE WHEN m<1e-10 THEN 0 ELSE round(min_x/m,6) END AS unit_x,
 (min_x+max_x)*0.5 AS mid_x, min_y+(max_y-min_y)*0.25 AS lerp_y, min_x+max_x AS sum_x, max_z-min_z AS diff_z, min_x*2 AS twice_x, min_x/4 AS quarter_x,
 abs(min_x-max_x)<1e-9 AND abs(min_y-max_y)<1e-9 AND abs(min_z-max_z)<1e-9 AS same
FROM (SELECT *, sqrt(min_x*min_x+min_y*min_y+min_z*min_z) AS m FROM {fx_geometry})""")
def points(fx):
    b = Box.of()
    a, c = b.lo, b.hi
    return fx("fx_geometry").select(
        "object_id", F.round(a.distance(c), 6).alias("distance"), F.round(a.magnitude(), 6).alias("magnitude"),
        F.round(a.normalized().x, 6).alias("unit_x"), a.midpoint(c).x.alias("mid_x"), a.lerp(c, F.lit(0.25)).y.alias("lerp_y"),
        a.plus(c).x.alias("sum_x"), c.minus(a).z.alias("diff_z"), a.times(F.lit(2.0)).x.alias("twice_x"), a.over(F.lit(4.0)).x.alias("quarter_x"),
        a.same_as(c).alias("same"),
    )


@query("I19_category_tolerance", """
SELECT object_id, CASE category WHEN 'Pipe' THEN 0.05 WHEN 'Structural Steel' THEN 0.20 WHEN 'HVAC Duct' THEN 0.08 WHEN 'Equipment' THEN 0.10 WHEN 'Insulation' THEN 0.01 ELSE 0.15 END::DOUBLE AS tolerance FROM {fx_geometry}""")
def tolerances(fx):
    return fx("fx_geometry").select("object_id", tolerance(F.col("category")).alias("tolerance"))


@query("I20_relation", """
SELECT seq, CASE WHEN seq%5=0 THEN 'overlap' WHEN seq%3=0 THEN 'touch' ELSE 'neartouch' END AS relation FROM {fx_geometry}""")
def relations(fx):
    overlap = F.when(F.col("seq") % 5 == 0, 0.5).otherwise(1e-9)
    distance = F.when(F.col("seq") % 3 == 0, 0.00009).otherwise(0.0001)
    return fx("fx_geometry").select("seq", relation(distance, overlap).alias("relation"))


@query("I26_mesh_uri", "SELECT object_id, 'mesh/'||object_id||'.glb' AS mesh_uri FROM {fx_geometry}")
def mesh_uris(fx):
    return fx("fx_geometry").select("object_id", formats.mesh_uri(F.col("object_id")).alias("mesh_uri"))


_NUM = "CASE WHEN {c}=floor({c}) THEN CAST(CAST({c} AS BIGINT) AS STRING) ELSE CAST({c} AS STRING) END"


def _num(c: str) -> str:
    return _NUM.replace("{c}", c)


@query("I27_wkt", f"""
SELECT object_id, 'POLYGON(('||x0||' '||y0||', '||x1||' '||y0||', '||x1||' '||y1||', '||x0||' '||y1||', '||x0||' '||y0||'))' AS footprint, 'POINT('||cx||' '||cy||' '||cz||')' AS centroid FROM (
SELECT object_id, {_num('min_x')} AS x0, {_num('min_y')} AS y0, {_num('max_x')} AS x1, {_num('max_y')} AS y1, {_num('(min_x+max_x)*0.5')} AS cx, {_num('(min_y+max_y)*0.5')} AS cy, {_num('(min_z+max_z)*0.5')} AS cz FROM {{fx_geometry}})""")
def wkt(fx):
    b = Box.of()
    return fx("fx_geometry").select("object_id", rdf.wkt_footprint(b).alias("footprint"), rdf.wkt_point(b.centroid()).alias("centroid"))


@query("I28_escapes", r"""
SELECT seq, replace(object_id,'-','_') AS safe, 'a\"'||object_id||'\\n' AS literal FROM {fx_properties}""")
def escapes(fx):
    raw = F.concat(F.lit('a"'), "object_id", F.lit("\\n"))
    return fx("fx_properties").select("seq", rdf.safe_id(F.col("object_id")).alias("safe"), rdf.escape_literal(raw).alias("literal"))


@query("I29_shape_hint", """
SELECT object_id, CASE WHEN lower(coalesce(display_name,'')) LIKE 'flange%' THEN 'Disc' WHEN lower(coalesce(display_name,'')) LIKE '%plate%' THEN 'Plate' WHEN d[3]<1e-9 THEN 'Box'
 WHEN d[2]/d[3]>0.6 AND r<0.5 THEN 'Disc' WHEN d[2]/d[3]>0.6 THEN 'Cylinder' WHEN r<0.3 THEN 'Plate' ELSE 'Box' END AS shape
FROM (SELECT *, CASE WHEN d[2]>1e-9 THEN d[1]/d[2] ELSE 0 END AS r FROM (SELECT object_id, display_name, list_sort([max_x-min_x,max_y-min_y,max_z-min_z]) AS d FROM {fx_mesh_geometry}))""")
def shapes(fx):
    return fx("fx_mesh_geometry").select("object_id", shape_hint(Box.of(), F.col("display_name")).alias("shape"))


@query("I30_cylinder_fit", """
SELECT object_id, d[1].axis AS axis, (d[2].side+d[3].side)/4 AS radius, d[1].side AS height FROM (
SELECT object_id, list_sort([{'side':max_x-min_x,'axis':0},{'side':max_y-min_y,'axis':1},{'side':max_z-min_z,'axis':2}]) AS d FROM {fx_geometry})""")
def fits(fx):
    return fx("fx_geometry").select("object_id", cylinder_fit(Box.of()).alias("f")).select("object_id", "f.*")


@query("I31_affine_transform", """
SELECT object_id, CASE WHEN seq%2=0 THEN min_x ELSE -min_y+8 END AS x, CASE WHEN seq%2=0 THEN min_y ELSE min_x+16 END AS y, CASE WHEN seq%2=0 THEN min_z ELSE 2*min_z+0.5 END AS z, seq%2=0 AS identity FROM {fx_geometry}""")
def transforms(fx):
    turn = [0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 2, 0, 8, 16, 0.5, 1]
    same = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    even = F.col("seq") % 2 == 0
    matrix = [F.when(even, float(s)).otherwise(float(t)) for s, t in zip(same, turn)]
    p = transform_point(Box.of().lo, matrix)
    return fx("fx_geometry").select("object_id", p.x.alias("x"), p.y.alias("y"), p.z.alias("z"), is_identity(matrix).alias("identity"))


@query("I32_unit_normals", """
SELECT object_id, CASE WHEN m>1e-8 THEN round(min_x/m,6) ELSE min_x END AS nx, CASE WHEN m>1e-8 THEN round(min_y/m,6) ELSE min_y END AS ny, CASE WHEN m>1e-8 THEN round(min_z/m,6) ELSE min_z END AS nz
FROM (SELECT *, sqrt(min_x*min_x+min_y*min_y+min_z*min_z) AS m FROM {fx_geometry})""")
def normals(fx):
    n = Box.of().lo.unit_normal()
    return fx("fx_geometry").select("object_id", *[F.round(c, 6).alias(f"n{a}") for c, a in zip(n.axes(), "xyz")])


@query("I38_classify_category", """
SELECT object_id, CASE category WHEN 'Structural Column' THEN 'Column' WHEN '큰보' THEN 'Beam' WHEN 'Floors' THEN 'Slab' WHEN 'Curtain Wall' THEN 'Wall' WHEN 'Mat Foundation' THEN 'Foundation' WHEN 'Air Duct' THEN 'Duct' WHEN 'piping run' THEN 'Pipe' END AS class FROM {fx_rule_objects}""")
def classes(fx):
    return fx("fx_rule_objects").select("object_id", classify.classify(F.col("category")).alias("class"))


@query("I39_classify_path", """
SELECT object_id, CASE WHEN sys_path LIKE '%Columns%' THEN 'Column' WHEN sys_path LIKE '%Horizontal Braces%' THEN 'Beam' WHEN sys_path LIKE '%Footing%' THEN 'Foundation' WHEN sys_path LIKE '%Deck%' THEN 'Slab' WHEN sys_path LIKE '%RightWall%' THEN 'Wall'
 WHEN sys_path LIKE '%PipeSys%' THEN 'Pipe' WHEN sys_path LIKE '%Pump%' THEN 'Equipment' WHEN sys_path LIKE '%Water%' THEN 'Pipe' END AS class FROM {fx_rule_objects}""")
def path_classes(fx):
    return fx("fx_rule_objects").select("object_id", classify.classify_path(F.col("sys_path")).alias("class"))


@query("I40_area_extraction", r"""
SELECT object_id, nullif(regexp_extract(sys_path,'\b(A[0-9]+)\b',1),'') AS area_name, nullif(regexp_extract(sys_path,'\b(U[0-9]+)\b',1),'') AS unit_name, nullif(regexp_extract(sys_path,'(Zone-[A-Za-z0-9]+)',1),'') AS zone_name,
 nullif(regexp_extract(sys_path,'\b(Level\s*[0-9]+|L[0-9]+|[0-9]+F|B[0-9]+)\b',1),'') AS level_name FROM {fx_rule_objects}""")
def areas(fx):
    names = ["area_name", "unit_name", "zone_name", "level_name"]
    return fx("fx_rule_objects").select("object_id", *[classify.extract(F.col("sys_path"), n).alias(n) for n in names])


@query("I41_level_order", """
SELECT seq, CASE CAST(seq%7 AS INT) WHEN 0 THEN -3 WHEN 1 THEN 12 WHEN 2 THEN 7 WHEN 3 THEN 0 WHEN 4 THEN 100 WHEN 5 THEN 101 ELSE NULL END AS order_no FROM {fx_rule_objects}""")
def orders(fx):
    names = ["지하3층", "12F", "7층", "GL", "옥상층", "PH", "Mezzanine"]
    chain = F
    for i, n in enumerate(names):
        chain = chain.when(F.col("seq") % 7 == i, F.lit(n))
    return fx("fx_rule_objects").select("seq", classify.level_order(chain.otherwise(F.lit(""))).alias("order_no"))


@query("I42_formatters", """
SELECT seq, 'L'||CAST(level AS STRING) AS badge, display_name||' ('||CAST(seq%10 AS STRING)||' props)' AS header, category||': '||property_name||' = '||property_value AS display_text, property_name||': '||property_value AS short_text, 'L2_Item_Unit_Weight' AS file_name FROM {fx_records}""")
def formatters(fx):
    name = formats.filter_file_name("L2", "Item", "Unit Weight", "")
    return fx("fx_records").select(
        "seq", formats.level_badge(F.col("level")).alias("badge"), formats.group_header(F.col("display_name"), F.col("seq") % 10).alias("header"),
        formats.property_text(F.col("category"), F.col("property_name"), F.col("property_value")).alias("display_text"),
        formats.short_property_text(F.col("property_name"), F.col("property_value")).alias("short_text"), F.lit(name).alias("file_name"),
    )


@query("I43_link_status", """
SELECT seq, CASE WHEN seq%4>0 THEN '✓ 연결됨 ('||CAST(seq%4 AS STRING)||' items)' ELSE '✗ 미연결' END AS status FROM {fx_schedule}""")
def link_status(fx):
    n = F.col("seq") % 4
    return fx("fx_schedule").select("seq", verdicts.link_status(n > 0, n).alias("status"))


@query("B06_md5_guid", """
SELECT object_id, substr(h,7,2)||substr(h,5,2)||substr(h,3,2)||substr(h,1,2)||'-'||substr(h,11,2)||substr(h,9,2)||'-'||substr(h,15,2)||substr(h,13,2)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS guid
FROM (SELECT object_id, md5(object_id) AS h FROM {fx_nodes})""")
def guids(fx):
    return fx("fx_nodes").select("object_id", ids.guid_from_md5(F.col("object_id")).alias("guid"))


@query("S21_csv_escape", """
SELECT seq, CASE WHEN seq%3=0 THEN q||property_value||',x'||q WHEN seq%3=1 THEN q||'say '||q||q||property_value||q||q||q ELSE property_value END AS cell FROM (SELECT *, chr(34) AS q FROM {fx_records})""")
def csv_cells(fx):
    value = F.col("property_value")
    raw = (
        F.when(F.col("seq") % 3 == 0, F.concat(value, F.lit(",x")))
        .when(F.col("seq") % 3 == 1, F.concat(F.lit('say "'), value, F.lit('"')))
        .otherwise(value)
    )
    return fx("fx_records").select("seq", text.csv_cell(raw).alias("cell"))
