"""Quality rules, verdicts and mesh diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from girderframe.functions.display import with_parsed
from girderframe.operators import quality, spatial, validation
from girderframe.plans import jobs
from girderframe.sinks import frames

_ISSUES = r"""
WITH m AS (SELECT object_id, display_name, category, seq, u.unit, u.no FROM {fx_parsed} CROSS JOIN (SELECT 'mm' AS unit, 0 AS no UNION ALL SELECT 'm', 1 UNION ALL SELECT 'ft', 2) u
 WHERE (u.unit='mm' AND regexp_matches(property_value,'(?i)\d+(\.\d+)?\s*mm')) OR (u.unit='m' AND regexp_matches(property_value,'(?i)\d+(\.\d+)?\s*m($|[^m])')) OR (u.unit='ft' AND regexp_matches(property_value,'(?i)\d+(\.\d+)?\s*ft'))),
f AS (SELECT object_id, min(display_name) AS display_name, category, unit, min(seq) AS pos, min(no) AS no FROM m GROUP BY object_id, category, unit),
u AS (SELECT object_id, min(display_name) AS object_name, category, string_agg(unit, ', ' ORDER BY pos, no) AS units, min_by(unit, pos*10+no) AS first_unit FROM f GROUP BY object_id, category HAVING count(*)>1),
issues AS (
SELECT object_id, object_name, 'UnitMismatch' AS issue_type, 'Warning' AS severity, category, '' AS property_name, 'length 단위 혼용: '||units AS details, '단위를 '||first_unit||'로 통일하세요' AS suggestion FROM u
UNION ALL SELECT object_id, display_name, 'MissingProperty', 'Error', 'Item', 'Name', '필수 속성 ''Name'' 누락', '''Item'' 카테고리에 ''Name'' 속성을 추가하세요' FROM {fx_parsed} WHERE property_name='Name' AND property_value=''
UNION ALL SELECT object_id, display_name, 'TypeMismatch', 'Warning', category, property_name, '데이터 타입 불일치: 선언='||data_type||', 값='||property_value, '값을 '||data_type||' 형식에 맞게 수정하세요' FROM {fx_parsed} WHERE data_type='Double')
"""


def typed(fx):
    return with_parsed(fx("fx_records"))


@query("I35_unit_consistency", _ISSUES + "SELECT * FROM issues WHERE issue_type='UnitMismatch'")
def unit_rule(fx):
    return quality.unit_issues(typed(fx))


@query("I36_required_properties", _ISSUES + "SELECT * FROM issues WHERE issue_type='MissingProperty'")
def required_rule(fx):
    return quality.missing_issues(typed(fx))


@query("I36_required_properties_edited", """
SELECT object_id, 'Height' AS property_name FROM {fx_properties} GROUP BY object_id HAVING count(*) FILTER (property_name='Height')=0""")
def edited_rule(fx):
    rules = quality.add_required(quality.REQUIRED_PROPERTIES, "Dimensions", "HEIGHT")
    rules = quality.remove_required(quality.remove_required(rules, "Item", "Name"), "Item", "Type")
    return quality.missing_issues(fx("fx_properties"), rules).select("object_id", F.initcap("property_name").alias("property_name"))


@query("I37_type_consistency", _ISSUES + "SELECT * FROM issues WHERE issue_type='TypeMismatch'")
def type_rule(fx):
    return quality.type_issues(typed(fx))


@query("L06_all_issues", _ISSUES + "SELECT * FROM issues")
def issues(fx):
    return jobs.quality_job(typed(fx))["issues"]


@query("E20_quality_totals", _ISSUES + """
SELECT (SELECT count(DISTINCT object_id) FROM {fx_records}) AS total_objects, (SELECT count(*) FROM {fx_records}) AS total_properties, (SELECT count(DISTINCT object_id) FROM {fx_records})-(SELECT count(DISTINCT object_id) FROM issues) AS valid_objects,
 (SELECT count(*) FROM issues WHERE severity='Warning') AS warning_count, (SELECT count(*) FROM issues WHERE severity='Error') AS error_count""")
def totals(fx):
    return quality.report(typed(fx))


@query("S18_report_lines", _ISSUES + """
SELECT CASE severity WHEN 'Error' THEN 1 ELSE 2 END AS section, object_id, '  '||object_name||': '||details||' → '||suggestion AS line FROM issues""")
def report_lines(fx):
    rows = typed(fx)
    lines = frames.report_lines(quality.report(rows), quality.all_issues(rows))
    return lines.filter("section > 0").select("section", "object_id", "line")


_VERDICTS = """
WITH gp AS (SELECT object_id, max(CASE WHEN property_name LIKE '%Primitives' THEN CAST(property_value AS INT) END) AS prim, max(CASE WHEN property_name LIKE '%Triangles' THEN CAST(property_value IN ('예','True','1') AS INT) END)=1 AS tri,
 max(CASE WHEN property_name LIKE '%Solid' THEN CAST(property_value='Yes' AS INT) END)=1 AS solid, max(CASE WHEN property_name LIKE '%Fragments' THEN coalesce(try_cast(property_value AS INT),0) END) AS frag FROM {fx_geometry_properties} GROUP BY object_id),
deg AS (SELECT object_id, count(*) AS n FROM (SELECT source_id AS object_id FROM {fx_edges} UNION ALL SELECT target_id FROM {fx_edges}) GROUP BY object_id),
base AS (SELECT g.object_id, coalesce(g.mesh_quality,'') AS q, g.has_mesh, g.vertex_count, n.class_name, n.level, CASE WHEN n.parent_id='00000000-0000-0000-0000-000000000000' THEN '' ELSE n.parent_id END AS parent_id, n.child_count, n.has_geometry, n.is_hidden, gp.object_id IS NOT NULL AS has_gp, coalesce(gp.prim,0) AS prim, coalesce(gp.tri,FALSE) AS tri, coalesce(gp.solid,FALSE) AS solid, coalesce(gp.frag,0) AS frag,
 coalesce(d.n,0) AS adjacency_count, CASE WHEN g.seq%13=0 THEN 'skipped_container' WHEN g.seq%13=1 THEN 'partial_container' WHEN NOT n.has_geometry AND n.child_count>0 THEN 'no_geometry_group' ELSE 'none' END AS container_status
 FROM {fx_mesh_geometry} g JOIN {fx_node_info} n ON n.object_id=g.object_id LEFT JOIN gp ON gp.object_id=g.object_id LEFT JOIN deg d ON d.object_id=g.object_id),
tess AS (SELECT *, CASE WHEN q IN ('full_mesh','partial_retry_success','gap_supplemented','line_mesh','fbx_supplemented') THEN 'success' WHEN q='box_placeholder' THEN 'failure' WHEN q IN ('skipped_container','hidden','no_geometry') THEN 'skipped' WHEN has_mesh AND vertex_count>0 THEN 'success' ELSE 'failure' END AS tess_result,
 CASE WHEN q IN ('full_mesh','partial_retry_success','gap_supplemented','line_mesh','fbx_supplemented') THEN 'None' WHEN q='box_placeholder' THEN CASE WHEN NOT has_geometry THEN 'NoGeometry' WHEN is_hidden THEN 'Hidden' WHEN frag=0 AND has_gp THEN 'NoFragments' ELSE 'AllStrategiesFail' END
  WHEN q='skipped_container' THEN 'Container' WHEN q='hidden' THEN 'Hidden' WHEN q='no_geometry' THEN 'NoGeometry' WHEN has_mesh AND vertex_count>0 THEN 'None' ELSE 'Unknown' END AS tess_reason FROM base),
v AS (SELECT *, CASE WHEN container_status='skipped_container' THEN 'SKIP_CONTAINER' WHEN is_hidden THEN 'SKIP_HIDDEN' WHEN NOT has_geometry AND NOT has_gp THEN 'SKIP_NO_GEOMETRY' WHEN q IN ('full_mesh','gap_supplemented','partial_retry_success') THEN 'OK_MESH' WHEN q='line_mesh' THEN 'OK_LINE_MESH' WHEN q='fbx_supplemented' THEN 'OK_FBX'
 WHEN q='box_placeholder' AND tri THEN 'FAIL_NO_EXTRACT' WHEN q='box_placeholder' AND has_geometry THEN 'WARN_BOX' WHEN q='box_placeholder' THEN 'SKIP_NO_GEOMETRY' WHEN NOT has_geometry THEN 'WARN_BOX' WHEN tess_result='failure' AND tri THEN 'FAIL_NO_EXTRACT' WHEN tess_result='failure' THEN 'WARN_BOX' ELSE 'UNKNOWN' END AS verdict FROM tess)
"""


def verdict_rows(fx):
    edges = spatial.adjacency(fx("fx_mesh_geometry"), 0.15)
    status = F.when(F.col("seq") % 13 == 0, "skipped_container").when(F.col("seq") % 13 == 1, "partial_container")
    containers = fx("fx_mesh_geometry").select("object_id", status.alias("container_status")).filter("container_status is not null")
    groups = fx("fx_mesh_geometry").select("object_id", (F.col("seq") % 20 + 1).alias("group_id"))
    return validation.validate_objects(
        fx("fx_mesh_geometry"), fx("fx_node_info"), fx("fx_geometry_properties"), containers, spatial.degrees(edges), groups
    )


@query("D11_object_validation", _VERDICTS + """
SELECT object_id, class_name, level, parent_id, child_count, container_status, tess_result, tess_reason, adjacency_count, prim AS geo_primitives, tri AS geo_has_triangles, solid AS geo_solid, frag AS geo_fragments, has_gp AS has_geometry_property, verdict FROM v""")
def object_validation(fx):
    return verdict_rows(fx).select(
        "object_id", "class_name", "level", "parent_id", "child_count", "container_status", "tess_result", "tess_reason",
        "adjacency_count", "geo_primitives", "geo_has_triangles", "geo_solid", "geo_fragments", "has_geometry_property", "verdict",
    )


@query("I21_container_status", _VERDICTS + "SELECT container_status, count(*) AS n FROM v GROUP BY container_status")
def container_status(fx):
    return verdict_rows(fx).groupBy("container_status").agg(F.count(F.lit(1)).alias("n"))


@query("I22_tessellation_reason", _VERDICTS + "SELECT tess_result, tess_reason, count(*) AS n FROM v GROUP BY tess_result, tess_reason")
def tessellation(fx):
    return verdict_rows(fx).groupBy("tess_result", "tess_reason").agg(F.count(F.lit(1)).alias("n"))


@query("I23_verdict", _VERDICTS + "SELECT object_id, verdict FROM v")
def verdict(fx):
    return verdict_rows(fx).select("object_id", "verdict")


@query("E14_verdict_counts", _VERDICTS + "SELECT verdict, count(*) AS objects, count(*) FILTER (tri AND tess_result='failure') AS triangles_but_failed FROM v GROUP BY verdict")
def verdict_counts(fx):
    return validation.verdict_counts(verdict_rows(fx))


@query("S16_validation_frame", _VERDICTS + """
SELECT object_id AS "ObjectId", upper(substr(CAST(has_geometry AS STRING),1,1))||substr(CAST(has_geometry AS STRING),2) AS "HasGeometry", verdict AS "Verdict", CAST(0 AS BIGINT) AS "GlbSizeBytes", 'False' AS "GlbExists" FROM v""")
def validation_frame(fx):
    return frames.validation(verdict_rows(fx)).select("ObjectId", "HasGeometry", "Verdict", "GlbSizeBytes", "GlbExists")


@query("I24_geometry_property_columns", """
SELECT object_id, coalesce(max(CASE WHEN property_name LIKE '%Primitives' THEN CAST(property_value AS INT) END),0) AS geo_primitives, coalesce(max(CASE WHEN property_name LIKE '%Triangles' THEN CAST(property_value IN ('예','True','1') AS INT) END),0)=1 AS geo_has_triangles,
 coalesce(max(CASE WHEN property_name LIKE '%Solid' THEN CAST(property_value='Yes' AS INT) END),0)=1 AS geo_solid, coalesce(max(CASE WHEN property_name LIKE '%Fragments' THEN try_cast(property_value AS INT) END),0) AS geo_fragments FROM {fx_geometry_properties} GROUP BY object_id""")
def geometry_columns(fx):
    return validation.geometry_properties(fx("fx_geometry_properties")).select(
        "object_id", "geo_primitives", "geo_has_triangles", "geo_solid", "geo_fragments"
    )


_CONTAINERS = """
WITH g AS (SELECT *, abs((max_x-min_x)*(max_y-min_y)*(max_z-min_z)) AS v FROM {fx_container_geometry}),
c AS (SELECT n.parent_id AS object_id, sum(g.v) AS cv, count(*) AS k FROM {fx_nodes} n JOIN g ON g.object_id=n.object_id WHERE n.parent_id<>'' GROUP BY n.parent_id),
status AS (SELECT c.object_id, c.k AS exported_children, CASE WHEN p.v IS NULL OR p.v<1e-9 OR c.cv/p.v>=0.5 THEN 'skipped_container' ELSE 'partial_container' END AS container_status FROM c LEFT JOIN g p ON p.object_id=c.object_id)
"""


def container_table(fx):
    links = fx("fx_nodes").filter("parent_id <> ''").select("parent_id", F.col("object_id").alias("child_id"))
    return validation.containers(links, fx("fx_container_geometry"))


@query("E13_container_detection", _CONTAINERS + "SELECT object_id, exported_children, container_status FROM status")
def container_detection(fx):
    return container_table(fx).select("object_id", "exported_children", "container_status")


@query("D10_parent_child_volumes", _CONTAINERS + "SELECT c.object_id, c.cv AS children_volume, p.v AS parent_volume FROM c LEFT JOIN g p ON p.object_id=c.object_id")
def volumes(fx):
    return container_table(fx).select("object_id", "children_volume", "parent_volume")


_DIAG = """
WITH s AS (SELECT *, CASE WHEN com_failed THEN 'COM_FAIL' WHEN is_hidden THEN 'HIDDEN' WHEN NOT is_leaf AND fragment_count=0 THEN 'PARENT_NO_FRAG' WHEN NOT is_leaf THEN 'PARENT_HAS_FRAG' WHEN fragment_count=0 THEN 'NO_FRAGMENTS' WHEN triangle_count=0 AND line_count>0 THEN 'LINE_ONLY' WHEN triangle_count=0 AND empty_fragment_count=fragment_count THEN 'EMPTY_TESS' WHEN triangle_count=0 THEN 'TESS_FAIL' ELSE 'OK' END AS status FROM {fx_mesh_diag}),
t AS (SELECT coalesce(class_name,'(none)') AS class_name, count(*) AS total, count(*) FILTER (status='OK') AS ok, count(*) FILTER (status='LINE_ONLY') AS line_only, count(*) FILTER (status IN ('EMPTY_TESS','TESS_FAIL')) AS empty_tess, count(*) FILTER (status='NO_FRAGMENTS') AS no_fragments, CAST(sum(line_count) AS BIGINT) AS total_lines, CAST(sum(triangle_count) AS BIGINT) AS total_triangles FROM s WHERE is_leaf GROUP BY 1),
summary AS (SELECT *, line_only+empty_tess+no_fragments AS failures, CAST(round((line_only+empty_tess+no_fragments)*100.0::DECIMAL(20,10)/total,1) AS DECIMAL(20,1))::VARCHAR AS fail_rate FROM t)
"""


@query("I34_mesh_status", _DIAG + "SELECT object_id, status FROM s")
def mesh_status(fx):
    return validation.with_mesh_status(fx("fx_mesh_diag")).select("object_id", "status")


@query("E15_class_summary", _DIAG + "SELECT * FROM summary")
def class_summary(fx):
    return validation.class_summary(fx("fx_mesh_diag"))


@query("G07_failing_classes", _DIAG + "SELECT class_name, failures FROM summary WHERE failures>0 ORDER BY failures DESC, class_name LIMIT 5")
def failing(fx):
    return validation.failing_classes(validation.class_summary(fx("fx_mesh_diag"))).select("class_name", "failures")


@query("L09_mesh_diagnostics", _DIAG + "SELECT object_id, status FROM s WHERE is_leaf")
def diagnostics(fx):
    return jobs.mesh_diagnostics_job(fx("fx_mesh_diag"))["diagnostics"].select("object_id", "status")


_OUTCOME = "CASE WHEN vertex_count>=3 AND triangle_count>=1 THEN CASE WHEN line_count>0 AND empty_fragment_count=fragment_count THEN 'line_mesh' WHEN empty_fragment_count>0 AND retried_fragments>0 THEN 'partial_retry_success' WHEN empty_fragment_count>0 THEN 'gap_supplemented' ELSE 'full_mesh' END END"


@query("E16_failure_reasons", f"""
SELECT CASE WHEN NOT has_geometry THEN 'NoGeometry' WHEN is_hidden THEN 'Hidden' WHEN fragment_count=0 THEN 'NoFragments' ELSE 'AllStrategiesFail' END AS reason, count(*) AS objects FROM {{fx_mesh_diag}} WHERE {_OUTCOME} IS NULL GROUP BY 1""")
def reasons(fx):
    return validation.failure_counts(fx("fx_mesh_diag"))


@query("I25_mesh_quality", _CONTAINERS + f""", d AS (SELECT *, {_OUTCOME} AS outcome FROM {{fx_mesh_diag}})
SELECT g.object_id, CASE WHEN s.container_status='skipped_container' THEN 'skipped_container' WHEN d.outcome='gap_supplemented' OR (d.object_id IS NOT NULL AND d.outcome IS NULL AND NOT d.has_geometry AND s.container_status='partial_container') THEN 'fbx_supplemented' WHEN d.outcome IS NOT NULL THEN d.outcome
 WHEN d.object_id IS NOT NULL AND NOT d.has_geometry THEN 'no_geometry' WHEN d.is_hidden THEN 'hidden' WHEN g.v>=1e-10 THEN 'box_placeholder' END AS mesh_quality
FROM g LEFT JOIN status s ON s.object_id=g.object_id LEFT JOIN d ON d.object_id=g.object_id""")
def mesh_quality(fx):
    rows = validation.with_mesh_quality(fx("fx_container_geometry"), fx("fx_mesh_diag"), container_table(fx), supplemented=True)
    return rows.select("object_id", "mesh_quality")


def mesh_tables(fx):
    """Eight corner vertices and three fragments per box; every fourth box has short vertices."""
    corner = F.array(*[F.struct(F.lit(i).alias("idx"), *[
        (F.col(f"max_{a}") if i >> n & 1 else F.col(f"min_{a}")).alias(a) for n, a in enumerate("xyz")
    ]) for i in range(8)])
    shrink = F.when(F.col("seq") % 4 == 0, 0.5).otherwise(0.0)
    vertices = fx("fx_geometry").select("object_id", "seq", F.explode(corner).alias("c")).select(
        "object_id", (F.col("c.idx") % 3).alias("fragment_id"), F.col("c.idx").alias("idx"),
        (F.col("c.x") * (1 - shrink)).alias("x"), F.col("c.y").alias("y"), F.col("c.z").alias("z"),
    )
    counts = F.array(*[F.when((F.col("seq") + i) % 5 == 0, 0).otherwise(4) for i in range(3)])
    fragments = fx("fx_geometry").select("object_id", F.posexplode(counts).alias("fragment_id", "triangle_count"))
    return vertices, fragments


@query("E29_vertex_statistics", """
SELECT object_id, CAST(8 AS BIGINT) AS vertex_count, CAST(3 AS BIGINT) AS fragment_count, CAST(CASE WHEN seq%5 IN (0,3,4) THEN 1 ELSE 0 END AS BIGINT) AS empty_fragment_count, CAST(CASE WHEN seq%5 IN (0,3,4) THEN 8 ELSE 12 END AS BIGINT) AS triangle_count,
 min_x*(CASE WHEN seq%4=0 THEN 0.5 ELSE 1 END)::DOUBLE AS v_min_x, max_x*(CASE WHEN seq%4=0 THEN 0.5 ELSE 1 END)::DOUBLE AS v_max_x, min_y AS v_min_y, max_z AS v_max_z FROM {fx_geometry}""")
def vertex_statistics(fx):
    return validation.vertex_statistics(*mesh_tables(fx)).select(
        "object_id", "vertex_count", "fragment_count", "empty_fragment_count", "triangle_count", "v_min_x", "v_max_x", "v_min_y", "v_max_z"
    )


@query("I33_gap_flags", """
SELECT object_id, seq%4=0 AND max_x*0.5>greatest((max_x-min_x)*0.01,0.01) AS gap_max_x, FALSE AS gap_min_y FROM {fx_geometry}""")
def gaps(fx):
    from girderframe.functions.boxes import Box, gap_flags

    stats = validation.vertex_statistics(*mesh_tables(fx))
    rows = fx("fx_geometry").join(stats, "object_id")
    flags = gap_flags(Box.of(), Box.of("v_"))
    return rows.select("object_id", flags["gap_max_x"].alias("gap_max_x"), flags["gap_min_y"].alias("gap_min_y"))


@query("L01_full_export", _CONTAINERS + f""", d AS (SELECT *, {_OUTCOME} AS outcome FROM {{fx_mesh_diag}}),
q AS (SELECT g.*, coalesce(CASE WHEN s.container_status='skipped_container' THEN 'skipped_container' WHEN d.outcome IS NOT NULL THEN d.outcome WHEN d.object_id IS NOT NULL AND NOT d.has_geometry THEN 'no_geometry' WHEN d.is_hidden THEN 'hidden' WHEN g.v>=1e-10 THEN 'box_placeholder' END,'') AS mq FROM g LEFT JOIN status s ON s.object_id=g.object_id LEFT JOIN d ON d.object_id=g.object_id)
SELECT object_id, mq AS mesh_quality FROM q""")
def full_export(fx):
    links = fx("fx_nodes").filter("parent_id <> ''").select("parent_id", F.col("object_id").alias("child_id"))
    geometry = fx("fx_container_geometry").withColumns(
        {
            "display_name": F.lit(""), "has_mesh": F.lit(False), "mesh_uri": F.lit(None).cast("string"),
        }
    )
    out = jobs.full_export(fx("fx_records"), geometry, links, fx("fx_node_info"), fx("fx_mesh_diag"))
    return out["validation"].select("object_id", "mesh_quality")


@query("S16_failure_frame", f"""
SELECT object_id AS "ObjectId", '(unnamed)' AS "DisplayName", coalesce(class_name,'') AS "ClassDisplayName", CASE WHEN NOT has_geometry THEN 'NoGeometry' WHEN is_hidden THEN 'Hidden' WHEN fragment_count=0 THEN 'NoFragments' ELSE 'AllStrategiesFail' END AS "Reason", '' AS "Detail" FROM {{fx_mesh_diag}} WHERE {_OUTCOME} IS NULL""")
def failure_frame(fx):
    return frames.tessellation_failures(validation.failures(fx("fx_mesh_diag")))


@query("S16_diagnostic_frame", _DIAG + """
SELECT coalesce(class_name,'') AS "ClassDisplayName", CASE WHEN is_leaf THEN 'LEAF' ELSE 'PARENT' END AS "NodeType", CASE WHEN is_hidden THEN 'True' ELSE 'False' END AS "IsHidden", fragment_count AS "FragmentCount", '0.0000' AS "BBoxVolume", status AS "Status" FROM s""")
def diagnostic_frame(fx):
    rows = frames.mesh_diagnostics(validation.with_mesh_status(fx("fx_mesh_diag")))
    return rows.select("ClassDisplayName", "NodeType", "IsHidden", "FragmentCount", "BBoxVolume", "Status")
