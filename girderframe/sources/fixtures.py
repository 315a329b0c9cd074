"""Views that derive model data from the relational test tables.

Each text is valid in Spark SQL and DuckDB; ``{name}`` stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    "fx_nodes": """
SELECT 'R:'||CAST(r_regionkey AS STRING) AS object_id, '' AS parent_id, r_name AS display_name, 'Region' AS class_name, FALSE AS is_hidden, FALSE AS has_geometry, CAST(r_regionkey AS BIGINT) AS seq FROM {region}
UNION ALL SELECT 'N:'||CAST(n_nationkey AS STRING), 'R:'||CAST(n_regionkey AS STRING), n_name, 'Zone', n_nationkey % 11 = 7, FALSE, 1000+CAST(n_nationkey AS BIGINT) FROM {nation}
UNION ALL SELECT 'C:'||CAST(c_custkey AS STRING), 'N:'||CAST(c_nationkey AS STRING), c_name, c_mktsegment, c_custkey % 37 = 5, FALSE, 100000+c_custkey FROM {customer}
UNION ALL SELECT 'O:'||CAST(o_orderkey AS STRING), 'C:'||CAST(o_custkey AS STRING), 'Element '||CAST(o_orderkey AS STRING), o_orderpriority, FALSE, TRUE, 10000000+o_orderkey FROM {orders}""",
    "fx_properties": """
SELECT 'O:'||CAST(o_orderkey AS STRING) AS object_id, 'C:'||CAST(o_custkey AS STRING) AS parent_id, 3 AS level, k.category AS category, k.property_name AS property_name,
 CASE k.k WHEN 1 THEN 'DisplayString: '||o_orderpriority WHEN 2 THEN 'Int32:'||CAST(o_orderkey AS STRING)
  WHEN 3 THEN 'Double: '||CAST(CAST(1+o_orderkey%7 AS INT) AS STRING)||CASE WHEN o_orderkey%3=0 THEN ' mm' WHEN o_orderkey%3=1 THEN ' Meters' ELSE ' ft' END
  WHEN 4 THEN CASE WHEN o_orderkey%13=0 THEN '' ELSE 'DisplayString:'||o_orderstatus END
  ELSE CAST(CAST(o_custkey%5 AS INT) AS STRING)||'.5 m' END AS property_value,
 o_orderkey*10+k.k AS seq
FROM {orders} CROSS JOIN (SELECT 1 AS k,'Item' AS category,'Type' AS property_name UNION ALL SELECT 2,'Element','Id' UNION ALL SELECT 3,'Dimensions','Length' UNION ALL SELECT 4,'Item','Name' UNION ALL SELECT 5,'Dimensions','Height') k
WHERE NOT (k.k=5 AND o_orderkey%4=0)""",
    "fx_geometry": """
SELECT object_id, category, min_x, min_y, min_z, min_x+dx AS max_x, min_y+dy AS max_y, min_z+dz AS max_z, seq FROM (
SELECT 'O:'||CAST(o_orderkey AS STRING) AS object_id,
 CASE CAST(o_orderkey%6 AS INT) WHEN 0 THEN 'Pipe' WHEN 1 THEN 'Structural Steel' WHEN 2 THEN 'HVAC Duct' WHEN 3 THEN 'Equipment' WHEN 4 THEN 'Insulation' ELSE 'Misc' END AS category,
 CAST(o_orderkey*37%509 AS DOUBLE)/8 AS min_x, CAST(o_custkey*53%1009 AS DOUBLE)/8 AS min_y, CAST(o_orderkey*11%97 AS DOUBLE)/8 AS min_z,
 CAST(1+o_orderkey%7 AS DOUBLE)/8 AS dx, CAST(o_custkey%5 AS DOUBLE)/8 AS dy, CAST(1+o_orderkey%3 AS DOUBLE)/8 AS dz, o_orderkey AS seq
FROM {orders} WHERE o_orderkey%10<>9) g
UNION ALL SELECT 'X:'||CAST(p_partkey AS STRING),'Misc',CAST(1000+p_partkey AS DOUBLE),CAST(0 AS DOUBLE),CAST(0 AS DOUBLE),CAST(1000.5+p_partkey AS DOUBLE),CAST(1 AS DOUBLE),CAST(1 AS DOUBLE),900000000+p_partkey FROM {part} WHERE p_partkey%50=0""",
    "fx_schedule": """
SELECT CASE WHEN o_orderkey%17=0 THEN '' WHEN o_orderkey%19=0 THEN 'missing-'||CAST(o_orderkey AS STRING) ELSE CAST(o_orderkey AS STRING) END AS sync_id,
 'Task '||CAST(o_orderkey AS STRING) AS task_name, CAST(o_orderdate AS DATE) AS planned_start,
 CASE WHEN o_orderkey%23=0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey%12-1 AS INT) END AS planned_end,
 CASE CAST(o_orderkey%5 AS INT) WHEN 0 THEN 'Demolish old' WHEN 1 THEN '임시' WHEN 2 THEN 'Build' WHEN 3 THEN '' ELSE 'remove-temp' END AS task_type_raw,
 '$'||CAST(CAST(o_orderkey%900+100 AS INT) AS STRING)||',000' AS cost_raw,
 CASE WHEN o_orderkey%29=0 THEN NULL ELSE r_name||'/'||n_name||'/'||c_mktsegment END AS parent_set, o_orderkey AS seq
FROM {orders} JOIN {customer} ON o_custkey=c_custkey JOIN {nation} ON c_nationkey=n_nationkey JOIN {region} ON n_regionkey=r_regionkey""",
    # Property rows with the name and path of their object.
    "fx_records": """
SELECT p.object_id, p.parent_id, p.level, n.display_name, n.sys_path, p.category, p.property_name, p.property_value, p.seq
FROM {fx_properties} p JOIN (
 SELECT 'O:'||CAST(o_orderkey AS STRING) AS oid, 'Element '||CAST(o_orderkey AS STRING) AS display_name,
  r_name||' > '||n_name||' > '||c_name||' > Element '||CAST(o_orderkey AS STRING) AS sys_path
 FROM {orders} JOIN {customer} ON o_custkey=c_custkey JOIN {nation} ON c_nationkey=n_nationkey JOIN {region} ON n_regionkey=r_regionkey) n
ON p.object_id=n.oid""",
    # Boxes with names and mesh columns.
    "fx_mesh_geometry": """
SELECT g.*, CASE WHEN seq%31=0 THEN NULL WHEN seq%6=5 THEN 'Flange '||CAST(seq AS STRING) WHEN seq%6=1 THEN 'Base Plate '||CAST(seq AS STRING) ELSE 'Element '||CAST(seq AS STRING) END AS display_name,
 CASE CAST(seq%11 AS INT) WHEN 0 THEN 'full_mesh' WHEN 1 THEN 'partial_retry_success' WHEN 2 THEN 'gap_supplemented' WHEN 3 THEN 'line_mesh' WHEN 4 THEN 'fbx_supplemented' WHEN 5 THEN 'box_placeholder' WHEN 6 THEN 'skipped_container' WHEN 7 THEN 'hidden' WHEN 8 THEN 'no_geometry' WHEN 9 THEN NULL ELSE 'full_mesh' END AS mesh_quality,
 seq%3<>0 AS has_mesh, CASE WHEN seq%3<>0 THEN 'mesh/'||object_id||'.glb' ELSE NULL END AS mesh_uri,
 CAST(CASE WHEN seq%3<>0 THEN 8*(1+seq%4) ELSE 0 END AS INT) AS vertex_count, CAST(CASE WHEN seq%3<>0 THEN 12*(1+seq%4) ELSE 0 END AS INT) AS triangle_count
FROM {fx_geometry} g""",
    # Tree position and visibility of every box.
    "fx_node_info": """
SELECT object_id, CASE CAST(seq%4 AS INT) WHEN 0 THEN 'Pipe' WHEN 1 THEN 'Beam' WHEN 2 THEN 'Group' ELSE 'Plate' END AS class_name, CAST(1+seq%5 AS INT) AS level,
 CASE WHEN seq%7=0 THEN '00000000-0000-0000-0000-000000000000' ELSE 'C:'||CAST(seq%1500 AS STRING) END AS parent_id,
 seq%4<>2 AS is_leaf, CAST(CASE WHEN seq%4=2 THEN 1+seq%3 ELSE 0 END AS BIGINT) AS child_count, seq%5<>0 AS has_geometry, seq%29=0 AS is_hidden
FROM {fx_geometry}""",
    # Geometry properties as property rows.
    "fx_geometry_properties": """
SELECT g.object_id, 'LcOpGeometryProperty' AS category, k.property_name, CASE k.k WHEN 1 THEN CAST(g.seq%50 AS STRING) WHEN 2 THEN CASE CAST(g.seq%4 AS INT) WHEN 0 THEN '예' WHEN 1 THEN 'True' WHEN 2 THEN 'No' ELSE '1' END
 WHEN 3 THEN CASE WHEN g.seq%3=0 THEN 'Yes' ELSE 'False' END ELSE CASE WHEN g.seq%9=0 THEN 'n/a' ELSE CAST(g.seq%3 AS STRING) END END AS property_value, g.seq*10+k.k AS seq
FROM {fx_geometry} g CROSS JOIN (SELECT 1 AS k,'LcOpGeometryPropertyPrimitives' AS property_name UNION ALL SELECT 2,'LcOpGeometryPropertyHasTriangles' UNION ALL SELECT 3,'LcOpGeometryPropertySolid' UNION ALL SELECT 4,'LcOpGeometryPropertyFragments') k
WHERE g.seq%6<>4""",
    # Mesh diagnostics per order.
    "fx_mesh_diag": """
SELECT 'O:'||CAST(o_orderkey AS STRING) AS object_id, CASE WHEN o_orderkey%41=0 THEN NULL ELSE o_orderpriority END AS class_name,
 o_orderkey%47=0 AS com_failed, o_orderkey%43=0 AS is_hidden, o_orderkey%6<>5 AS is_leaf, o_orderkey%5<>1 AS has_geometry,
 CAST(o_orderkey%4 AS INT) AS fragment_count, CAST(CASE WHEN o_orderkey%8<4 THEN o_orderkey%4 ELSE 0 END AS INT) AS empty_fragment_count,
 CAST(CASE WHEN o_orderkey%16=3 THEN 1 ELSE 0 END AS INT) AS retried_fragments,
 CAST(CASE WHEN o_orderkey%9=2 THEN 5 ELSE 0 END AS INT) AS line_count, CAST(CASE WHEN o_orderkey%3=0 THEN 0 ELSE 8 END AS INT) AS vertex_count,
 CAST(CASE WHEN o_orderkey%3=0 THEN 0 ELSE 12 END AS INT) AS triangle_count, o_orderkey AS seq
FROM {orders}""",
    # Containers: customers with a box over some of their orders.
    "fx_container_geometry": """
SELECT object_id, category, min_x, min_y, min_z, max_x, max_y, max_z, seq FROM {fx_geometry}
UNION ALL SELECT 'C:'||CAST(c_custkey AS STRING), 'Assembly', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE),
 CAST(c_custkey%8 AS DOUBLE)/8, CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), 800000000+c_custkey FROM {customer} WHERE c_custkey%3<>0""",
    # Objects for the classification and precedence rules.
    "fx_rule_objects": """
SELECT 'O:'||CAST(o_orderkey AS STRING) AS object_id, 'Element '||CAST(o_orderkey AS STRING) AS display_name,
 CASE CAST(o_orderkey%8 AS INT) WHEN 0 THEN 'Structural Column' WHEN 1 THEN '큰보' WHEN 2 THEN 'Floors' WHEN 3 THEN 'Curtain Wall' WHEN 4 THEN 'Mat Foundation' WHEN 5 THEN 'Air Duct' WHEN 6 THEN 'Generic' ELSE 'piping run' END AS category,
 'Plant > A'||CAST(o_custkey%4 AS STRING)||' > U0'||CAST(o_custkey%6 AS STRING)||' > Zone-'||CASE WHEN o_orderkey%2=0 THEN 'East' ELSE 'West' END||' > '||CASE WHEN o_orderkey%5=4 THEN '' ELSE CASE CAST(o_orderkey%7 AS INT) WHEN 0 THEN '1F' WHEN 1 THEN '2F' WHEN 2 THEN 'B1' WHEN 3 THEN 'Level 3' WHEN 4 THEN 'L4' ELSE '10F' END||' > ' END
  ||CASE CAST(o_orderkey%9 AS INT) WHEN 0 THEN 'Columns' WHEN 1 THEN 'Horizontal Braces' WHEN 2 THEN 'Footing' WHEN 3 THEN 'Structural Deck' WHEN 4 THEN 'RightWall' WHEN 5 THEN 'PipeSys' WHEN 6 THEN 'Pump House' WHEN 7 THEN 'Cooling Water' ELSE 'Misc' END||' > Element '||CAST(o_orderkey AS STRING) AS sys_path, o_orderkey AS seq
FROM {orders}""",
    # Schedule and object descriptions for the scored match.
    "fx_score_schedule": """
SELECT o_orderkey AS row_id, CASE WHEN o_orderkey%4=3 THEN 'L9' ELSE 'L'||CAST(o_custkey%6 AS STRING) END AS level_name, CASE WHEN o_orderkey%5=4 THEN 'Other' ELSE o_orderpriority END AS category,
 CASE CAST(o_orderkey%6 AS INT) WHEN 0 THEN 'Element '||CAST(o_orderkey AS STRING) WHEN 1 THEN 'install element '||CAST(o_orderkey AS STRING) WHEN 2 THEN 'Element-'||CAST(o_orderkey AS STRING)||'-'||o_orderstatus WHEN 3 THEN 'Work package' WHEN 4 THEN 'Set out element '||CAST(o_orderkey AS STRING) ELSE '' END AS name,
 CASE WHEN o_orderkey%3=2 THEN 'elsewhere' ELSE 'P'||CAST(o_custkey%10 AS STRING) END AS path
FROM {orders}""",
    "fx_score_objects": """
SELECT 'O:'||CAST(o_orderkey AS STRING) AS object_id, 'L'||CAST(o_custkey%6 AS STRING) AS level_name, o_orderpriority AS category, 'Element '||CAST(o_orderkey AS STRING)||CASE WHEN o_orderkey%7=0 THEN ' '||o_orderstatus ELSE '' END AS name, 'P'||CAST(o_custkey%10 AS STRING) AS path
FROM {orders}""",
}


def dependencies(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


class Fixtures:
    """Frames of the test tables and views of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._frames: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in TABLES:
                frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = VIEWS[name]
                frame = self.spark.sql(text, **{d: self(d) for d in dependencies(text)})
            self._frames[name] = frame
        return self._frames[name]


def with_views(query: str, extra: dict[str, str] | None = None) -> str:
    """Plain SQL for a query over ``{name}`` placeholders, with the views it needs as CTEs."""
    views = {**VIEWS, **(extra or {})}
    known = {*views, *TABLES}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dependencies(text):
            if name in views and name not in ordered:
                visit(views[name])
                ordered.append(name)

    def plain(text: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: m.group(1) if m.group(1) in known else m.group(0), text).strip()

    visit(query)
    parts = [f"{name} AS ({plain(views[name])})" for name in ordered]
    body = plain(query)
    if not parts:
        return body
    for opening in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(opening):
            return f"{opening} " + ",\n".join(parts) + ",\n" + body[len(opening):].lstrip()
    return "WITH " + ",\n".join(parts) + "\n" + body
