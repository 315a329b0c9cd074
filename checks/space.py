"""Spatial, graph and triple queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from girderframe.functions import rdf
from girderframe.operators import graph, spatial, triples
from girderframe.plans import jobs
from girderframe.sinks import frames

TOLERANCE = 0.15


@query("D07_adjacency_by_category", "SELECT source_id, target_id, tolerance, round(distance,6) AS distance, overlap_volume FROM {fx_category_edges}")
def by_category(fx):
    edges = spatial.adjacency(fx("fx_geometry"))
    return edges.select("source_id", "target_id", "tolerance", F.round("distance", 6).alias("distance"), "overlap_volume")


@query("D08_grid_adjacency", "SELECT source_id, target_id, round(distance,6) AS distance, overlap_volume, relation, CAST(tolerance AS DOUBLE) AS tolerance FROM {fx_edges}")
def grid(fx):
    edges = spatial.adjacency(fx("fx_geometry"), TOLERANCE)
    return edges.withColumn("distance", F.round("distance", 6))


@query("D08_grid_adjacency_split_cells", "SELECT source_id, target_id, round(distance,6) AS distance FROM {fx_edges}")
def split_grid(fx):
    options = spatial.GridOptions(hot_pairs=20, block=3)
    return spatial.adjacency(fx("fx_geometry"), TOLERANCE, options).select("source_id", "target_id", F.round("distance", 6).alias("distance"))


_ZONES = "SELECT 'N:'||CAST(n_nationkey AS STRING) AS object_id, CAST(n_nationkey AS DOUBLE)*2 AS min_x, CAST(0 AS DOUBLE) AS min_y, CAST(0 AS DOUBLE) AS min_z, CAST(n_nationkey AS DOUBLE)*2+4 AS max_x, CAST(40+n_nationkey AS DOUBLE) AS max_y, CAST(9 AS DOUBLE) AS max_z FROM {nation}"


@query("D09_box_predicates", """
SELECT z.object_id AS probe_id, g.object_id, 'intersects' AS kind FROM (""" + _ZONES + """) z JOIN {fx_geometry} g ON z.max_x>=g.min_x AND z.min_x<=g.max_x AND z.max_y>=g.min_y AND z.min_y<=g.max_y AND z.max_z>=g.min_z AND z.min_z<=g.max_z
UNION ALL SELECT z.object_id, g.object_id, 'contains' FROM (""" + _ZONES + """) z JOIN {fx_geometry} g ON g.min_x>=z.min_x AND g.max_x<=z.max_x AND g.min_y>=z.min_y AND g.max_y<=z.max_y AND g.min_z>=z.min_z AND g.max_z<=z.max_z""")
def predicates(fx):
    key = F.col("n_nationkey").cast("double")
    bounds = {"min_x": key * 2, "min_y": F.lit(0.0), "min_z": F.lit(0.0), "max_x": key * 2 + 4, "max_y": key + 40, "max_z": F.lit(9.0)}
    zones = fx("nation").select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("object_id"), *[c.alias(n) for n, c in bounds.items()])
    found = [
        spatial.matching_boxes(fx("fx_geometry"), zones, kind).withColumn("kind", F.lit(kind)) for kind in ("intersects", "contains")
    ]
    return found[0].unionByName(found[1])


@query("E10_degrees", "SELECT object_id, count(*) AS adjacency_count FROM (SELECT source_id AS object_id FROM {fx_edges} UNION ALL SELECT target_id FROM {fx_edges}) GROUP BY object_id")
def degrees(fx):
    return spatial.degrees(spatial.adjacency(fx("fx_geometry"), TOLERANCE))


# Every edge joins its ends; the smallest id reached names the component.
_COMPONENTS = """
WITH RECURSIVE e AS MATERIALIZED (SELECT source_id AS a, target_id AS b FROM {fx_edges} UNION SELECT target_id, source_id FROM {fx_edges}),
reach AS (SELECT object_id, object_id AS other FROM {fx_geometry} UNION SELECT r.object_id, e.b FROM reach r JOIN e ON e.a=r.other),
labels AS (SELECT object_id, min(other) AS label FROM reach GROUP BY object_id),
sizes AS (SELECT label, count(*) AS element_count, row_number() OVER (ORDER BY count(*) DESC, label) AS group_id FROM labels GROUP BY label),
members AS (SELECT l.object_id, l.label, s.group_id, s.element_count FROM labels l JOIN sizes s ON l.label=s.label)
"""


@query("J01_connected_components", _COMPONENTS + "SELECT object_id, label FROM labels")
def labels(fx):
    return spatial.component_labels(fx("fx_geometry"), TOLERANCE)


@query("G04_component_numbers", _COMPONENTS + "SELECT object_id, group_id, element_count FROM members")
def numbered(fx):
    return graph.number_groups(spatial.component_labels(fx("fx_geometry"), TOLERANCE))


_STATS = _COMPONENTS + """, g AS (SELECT m.group_id, m.object_id, x.* EXCLUDE (object_id) FROM members m JOIN {fx_geometry} x ON x.object_id=m.object_id),
cats AS (SELECT group_id, category, count(*) AS n, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, category) AS r FROM g GROUP BY group_id, category),
ed AS (SELECT m.group_id, count(*) AS edge_count FROM {fx_edges} f JOIN members m ON m.object_id=f.source_id GROUP BY m.group_id),
stats AS (SELECT g.group_id, count(*) AS element_count, coalesce(max(ed.edge_count),0) AS edge_count, sum(abs((max_x-min_x)*(max_y-min_y)*(max_z-min_z))) AS total_volume, max(c.category) AS dominant_category,
 min(min_x) AS min_x, min(min_y) AS min_y, min(min_z) AS min_z, max(max_x) AS max_x, max(max_y) AS max_y, max(max_z) AS max_z, (min(min_x)+max(max_x))*0.5 AS centroid_x, (min(min_y)+max(max_y))*0.5 AS centroid_y, (min(min_z)+max(max_z))*0.5 AS centroid_z
 FROM g LEFT JOIN ed ON ed.group_id=g.group_id JOIN cats c ON c.group_id=g.group_id AND c.r=1 GROUP BY g.group_id)
"""


@query("E11_group_statistics", _STATS + "SELECT * FROM stats")
def statistics(fx):
    return jobs.spatial_job(fx("fx_geometry"), TOLERANCE)["statistics"]


@query("J02_components_with_statistics", _STATS + "SELECT m.object_id, m.group_id, s.dominant_category, s.edge_count FROM members m JOIN stats s ON s.group_id=m.group_id")
def find_and_compute(fx):
    space = jobs.spatial_job(fx("fx_geometry"), TOLERANCE)
    return space["groups"].join(space["statistics"], "group_id").select("object_id", "group_id", "dominant_category", "edge_count")


@query("D12_edges_inside_groups", _COMPONENTS + "SELECT m.group_id, count(*) AS edge_count FROM {fx_edges} f JOIN members m ON m.object_id=f.source_id JOIN members o ON o.object_id=f.target_id AND o.group_id=m.group_id GROUP BY m.group_id")
def inner_edges(fx):
    return jobs.spatial_job(fx("fx_geometry"), TOLERANCE)["statistics"].filter("edge_count > 0").select("group_id", "edge_count")


@query("E12_spatial_summary", _COMPONENTS + """
SELECT (SELECT count(*) FROM {fx_edges}) AS total_relations, (SELECT count(*) FROM {fx_edges} WHERE relation='overlap') AS overlaps, (SELECT count(*) FROM {fx_edges} WHERE relation='touch') AS touches, (SELECT count(*) FROM {fx_edges} WHERE relation='neartouch') AS near_touches,
 (SELECT count(*) FROM sizes) AS total_groups, (SELECT count(*) FROM members) AS total_elements, (SELECT max(element_count) FROM sizes) AS largest_group, (SELECT count(*) FROM sizes WHERE element_count=1) AS singleton_groups, (SELECT count(*) FROM sizes WHERE element_count>1) AS multi_groups""")
def summary(fx):
    return jobs.spatial_job(fx("fx_geometry"), TOLERANCE)["summary"]


@query("S20_summary_lines", _COMPONENTS + """
SELECT 0 AS line_no, '--- Adjacency Relations ---' AS line UNION ALL SELECT 1, 'Total relations: '||format('{:,}', count(*)) FROM {fx_edges}
UNION ALL SELECT 2, '  Overlap: '||format('{:,}', count(*)) FROM {fx_edges} WHERE relation='overlap'
UNION ALL SELECT 3, '  Touch: '||format('{:,}', count(*)) FROM {fx_edges} WHERE relation='touch'
UNION ALL SELECT 4, '  NearTouch: '||format('{:,}', count(*)) FROM {fx_edges} WHERE relation='neartouch'
UNION ALL SELECT 5, '--- Connected Groups ---' UNION ALL SELECT 6, 'Total groups: '||format('{:,}', count(*)) FROM sizes
UNION ALL SELECT 7, '  Total elements: '||format('{:,}', CAST(sum(element_count) AS BIGINT)) FROM sizes
UNION ALL SELECT 8, '  Largest group: '||format('{:,}', max(element_count))||' elements' FROM sizes
UNION ALL SELECT 9, '  Singleton groups: '||format('{:,}', count(*)) FROM sizes WHERE element_count=1
UNION ALL SELECT 10, '  Multi-element groups: '||format('{:,}', count(*)) FROM sizes WHERE element_count>1
UNION ALL SELECT 11, '--- Output Files ---' UNION ALL SELECT 12, '  adjacency.csv' UNION ALL SELECT 13, '  connected_groups.csv'
UNION ALL SELECT 14, '  spatial_relationships.ttl' UNION ALL SELECT 15, '  spatial_summary.txt'""")
def summary_lines(fx):
    return frames.summary_lines(jobs.spatial_job(fx("fx_geometry"), TOLERANCE)["summary"])


@query("L02_spatial_job_by_category", _COMPONENTS.replace("{fx_edges}", "{fx_category_edges}") + "SELECT object_id, group_id, element_count FROM members")
def spatial_job(fx):
    return jobs.spatial_job(fx("fx_geometry"))["groups"]


@query("L02_selection_spatial_job", """
SELECT e.source_id, e.target_id FROM {fx_edges} e WHERE e.source_id IN (SELECT object_id FROM {fx_walk}) AND e.target_id IN (SELECT object_id FROM {fx_walk})""")
def selection_job(fx):
    seeds = fx("fx_nodes").filter("class_name = 'Zone'")
    return jobs.selection_spatial_job(fx("fx_geometry"), fx("fx_nodes"), seeds, TOLERANCE)["edges"].select("source_id", "target_id")


@query("S12_adjacency_frame", """
SELECT e.source_id AS "SourceObjectId", e.target_id AS "TargetObjectId", coalesce(a.display_name,'') AS "SourceName", coalesce(b.display_name,'') AS "TargetName", CAST(round(CAST(e.distance AS DECIMAL(30,12)),6) AS DECIMAL(30,6))::VARCHAR AS "Distance", CAST(round(CAST(e.overlap_volume AS DECIMAL(30,12)),6) AS DECIMAL(30,6))::VARCHAR AS "OverlapVolume", e.relation AS "RelationType", a.category AS "SourceCategory", b.category AS "TargetCategory", '0.1500' AS "Tolerance"
FROM {fx_edges} e JOIN {fx_mesh_geometry} a ON a.object_id=e.source_id JOIN {fx_mesh_geometry} b ON b.object_id=e.target_id""")
def adjacency_frame(fx):
    return frames.adjacency(spatial.named_adjacency(fx("fx_mesh_geometry"), TOLERANCE))


@query("S12_groups_frame", _STATS + """
SELECT 'G'||CASE WHEN s.group_id<1000 THEN lpad(CAST(s.group_id AS STRING),3,'0') ELSE CAST(s.group_id AS STRING) END AS "GroupId", s.element_count AS "ElementCount", s.edge_count AS "EdgeCount", CAST(round(CAST(s.total_volume AS DECIMAL(30,12)),4) AS DECIMAL(30,4))::VARCHAR AS "TotalVolume", s.dominant_category AS "DominantCategory",
 CAST(round(CAST(s.min_x AS DECIMAL(30,12)),4) AS DECIMAL(30,4))::VARCHAR AS "BBoxMinX", CAST(round(CAST(s.max_z AS DECIMAL(30,12)),4) AS DECIMAL(30,4))::VARCHAR AS "BBoxMaxZ", m.ids AS "MemberObjectIds" FROM stats s JOIN (SELECT group_id, string_agg(object_id, ';' ORDER BY object_id) AS ids FROM members GROUP BY group_id) m ON m.group_id=s.group_id""")
def groups_frame(fx):
    space = jobs.spatial_job(fx("fx_geometry"), TOLERANCE)
    return frames.connected_groups(space["statistics"], space["groups"]).select(
        "GroupId", "ElementCount", "EdgeCount", "TotalVolume", "DominantCategory", "BBoxMinX", "BBoxMaxZ", "MemberObjectIds"
    )


@query("S13_edge_triples", """
SELECT 'inst:obj_'||source_id AS s, 'spatial:adjacentTo' AS p, 'inst:obj_'||target_id AS o FROM {fx_edges}
UNION ALL SELECT 'inst:obj_'||source_id, 'spatial:distanceTo', '[ spatial:target inst:obj_'||target_id||' ; spatial:distance "'||CAST(round(CAST(distance AS DECIMAL(30,12)),6) AS DECIMAL(30,6))::VARCHAR||'"^^xsd:double ]' FROM {fx_edges}
UNION ALL SELECT 'inst:obj_'||source_id, 'spatial:overlapsWith', '[ spatial:target inst:obj_'||target_id||' ; spatial:overlapVolume "'||CAST(round(CAST(overlap_volume AS DECIMAL(30,12)),6) AS DECIMAL(30,6))::VARCHAR||'"^^xsd:double ]' FROM {fx_edges} WHERE overlap_volume>0""")
def edge_triples(fx):
    return triples.edge_triples(spatial.adjacency(fx("fx_geometry"), TOLERANCE))


@query("S13_group_triples", _STATS + """, u AS (SELECT *, 'spatial:Group_'||CASE WHEN group_id<1000 THEN lpad(CAST(group_id AS STRING),3,'0') ELSE CAST(group_id AS STRING) END AS uri FROM stats)
SELECT uri AS s, 'a' AS p, 'spatial:ConnectedGroup' AS o FROM u UNION ALL SELECT uri, 'spatial:groupSize', CAST(element_count AS STRING) FROM u UNION ALL SELECT uri, 'spatial:groupVolume', '"'||CAST(round(CAST(total_volume AS DECIMAL(30,12)),4) AS DECIMAL(30,4))::VARCHAR||'"^^xsd:double' FROM u
UNION ALL SELECT 'inst:obj_'||m.object_id, 'spatial:inGroup', u.uri FROM members m JOIN u ON u.group_id=m.group_id""")
def group_triples(fx):
    space = jobs.spatial_job(fx("fx_geometry"), TOLERANCE)
    return triples.group_triples(space["statistics"], space["groups"])


_N = "CASE WHEN {c}=floor({c}) THEN CAST(CAST({c} AS BIGINT) AS STRING) ELSE CAST({c} AS STRING) END"


def _double(c: str) -> str:
    return "'\"'||" + _N.replace("{c}", c) + "||'\"^^xsd:double'"


def _number(c: str) -> str:
    return _N.replace("{c}", c)


_CORNERS = "||', '||".join(f"{_number(f'{x}_x')}||' '||{_number(f'{y}_y')}" for x, y in (("min", "min"), ("max", "min"), ("max", "max"), ("min", "max"), ("min", "min")))
_CENTRE = "||' '||".join(_number(f"((min_{a}+max_{a})*0.5)") for a in "xyz")


@query("S14_geometry_triples", f"""
WITH g AS (SELECT *, abs((max_x-min_x)*(max_y-min_y)*(max_z-min_z)) AS v FROM {{fx_mesh_geometry}})
SELECT 'bso:Object_'||object_id AS s, 'bso:hasBoundingBox' AS p, 'bso:BBox_'||object_id AS o FROM g
UNION ALL SELECT 'bso:BBox_'||object_id, 'a', 'bso:BoundingBox' FROM g
{' '.join(f"UNION ALL SELECT 'bso:BBox_'||object_id, 'bso:{e}{a.upper()}', {_double(f'{e}_{a}')} FROM g" for e in ('min', 'max') for a in 'xyz')}
{' '.join(f"UNION ALL SELECT 'bso:Object_'||object_id, 'bso:centroid{a.upper()}', {_double(f'((min_{a}+max_{a})*0.5)')} FROM g" for a in 'xyz')}
UNION ALL SELECT 'bso:BBox_'||object_id, 'geo:asWKT', '"POLYGON(('||{_CORNERS}||'))"^^geo:wktLiteral' FROM g
UNION ALL SELECT 'bso:Object_'||object_id, 'bso:centroidWKT', '"POINT('||{_CENTRE}||')"^^geo:wktLiteral' FROM g
UNION ALL SELECT 'bso:Object_'||object_id, 'bso:volume', {_double('v')} FROM g WHERE v>0
UNION ALL SELECT 'bso:Object_'||object_id, 'bso:hasMesh', '"'||CAST(has_mesh AS STRING)||'"^^xsd:boolean' FROM g
UNION ALL SELECT 'bso:Object_'||object_id, 'bso:meshUri', '"'||mesh_uri||'"' FROM g WHERE mesh_uri IS NOT NULL
UNION ALL SELECT 'bso:Object_'||object_id, 'rdfs:label', '"'||display_name||'"' FROM g WHERE display_name IS NOT NULL
UNION ALL SELECT 'bso:Object_'||object_id, 'bso:category', '"'||category||'"' FROM g""")
def geometry_triples(fx):
    return triples.geometry_triples(fx("fx_mesh_geometry"))


_OBJECT = f"'  <{rdf.GEOMETRY_PREFIXES['bso']}Object_'||object_id||'> '"
_SHAPE = f"'<{rdf.GEOMETRY_PREFIXES['bso']}BBox_'||object_id||'>'"
_LINES = [
    f"{_OBJECT}||'bso:hasBoundingBox '||{_SHAPE}||' .'",
    f"'  '||{_SHAPE}||' a bso:BoundingBox .'",
    *[f"'  '||{_SHAPE}||' bso:{e}{a.upper()} '||{_double(f'{e}_{a}')}||' .'" for e in ("min", "max") for a in "xyz"],
    *[f"{_OBJECT}||'bso:centroid{a.upper()} '||{_double(f'((min_{a}+max_{a})*0.5)')}||' .'" for a in "xyz"],
    f"{_OBJECT}||'bso:hasMesh \"'||CAST(has_mesh AS STRING)||'\"^^xsd:boolean .'",
    f"CASE WHEN mesh_uri IS NOT NULL THEN {_OBJECT}||'bso:meshUri \"'||mesh_uri||'\" .' END",
]


@query("S15_sparql_insert", f"SELECT object_id, concat_ws(chr(10), 'INSERT DATA {{', {', '.join(_LINES)}, '}}') AS sparql FROM {{fx_mesh_geometry}}")
def sparql(fx):
    return triples.sparql_insert(fx("fx_mesh_geometry"))
