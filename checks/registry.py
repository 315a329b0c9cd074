"""Registry of queries: each pairs a Spark plan over the test tables with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from girderframe.sources.fixtures import Fixtures, with_views

# SQL-only helper views.
SQL_VIEWS = {
    "fx_split": r"""
SELECT *, CASE WHEN trim(property_value)='' THEN '' ELSE coalesce(nullif(regexp_extract(property_value,'^(\w+):\s*(.*)$',1),''),'Unknown') END AS data_type,
 CASE WHEN trim(property_value)='' THEN '' WHEN regexp_matches(property_value,'^\w+:\s*.*$') THEN trim(regexp_extract(property_value,'^(\w+):\s*(.*)$',2)) ELSE property_value END AS raw_value
FROM {fx_records}""",
    "fx_parsed": r"""
SELECT * EXCLUDE (u), CASE lower(u) WHEN 'meters' THEN 'm' ELSE u END AS unit FROM (
SELECT *, try_cast(nullif(regexp_extract(raw_value,'(?i)^(-?\d+\.?\d*(?:E[+-]?\d+)?)\s*(.*)$',1),'') AS DOUBLE) AS numeric_value,
 trim(regexp_extract(raw_value,'(?i)^(-?\d+\.?\d*(?:E[+-]?\d+)?)\s*(.*)$',2)) AS u FROM {fx_split})""",
    "fx_walk": """
SELECT r.object_id, r.display_name AS path, 0 AS level, r.object_id AS root_id FROM {fx_nodes} r WHERE parent_id='' AND NOT is_hidden
UNION ALL SELECT n.object_id, r.display_name||' > '||n.display_name, 1, r.object_id FROM {fx_nodes} r JOIN {fx_nodes} n ON n.parent_id=r.object_id AND r.parent_id='' WHERE NOT r.is_hidden AND NOT n.is_hidden
UNION ALL SELECT c.object_id, r.display_name||' > '||n.display_name||' > '||c.display_name, 2, r.object_id FROM {fx_nodes} r JOIN {fx_nodes} n ON n.parent_id=r.object_id AND r.parent_id='' JOIN {fx_nodes} c ON c.parent_id=n.object_id WHERE NOT r.is_hidden AND NOT n.is_hidden AND NOT c.is_hidden
UNION ALL SELECT o.object_id, r.display_name||' > '||n.display_name||' > '||c.display_name||' > '||o.display_name, 3, r.object_id FROM {fx_nodes} r JOIN {fx_nodes} n ON n.parent_id=r.object_id AND r.parent_id='' JOIN {fx_nodes} c ON c.parent_id=n.object_id JOIN {fx_nodes} o ON o.parent_id=c.object_id WHERE NOT r.is_hidden AND NOT n.is_hidden AND NOT c.is_hidden AND NOT o.is_hidden""",
    "fx_boxes": "SELECT * FROM {fx_geometry} WHERE abs((max_x-min_x)*(max_y-min_y)*(max_z-min_z)) >= 1e-10",
    "fx_edges": """
SELECT source_id, target_id, distance, overlap_volume, CASE WHEN overlap_volume>1e-9 THEN 'overlap' WHEN distance<1e-4 THEN 'touch' ELSE 'neartouch' END AS relation, 0.15 AS tolerance FROM (
SELECT least(a.object_id,b.object_id) AS source_id, greatest(a.object_id,b.object_id) AS target_id,
 sqrt(pow(greatest(0,a.min_x-b.max_x,b.min_x-a.max_x),2)+pow(greatest(0,a.min_y-b.max_y,b.min_y-a.max_y),2)+pow(greatest(0,a.min_z-b.max_z,b.min_z-a.max_z),2)) AS distance,
 greatest(0,least(a.max_x,b.max_x)-greatest(a.min_x,b.min_x))*greatest(0,least(a.max_y,b.max_y)-greatest(a.min_y,b.min_y))*greatest(0,least(a.max_z,b.max_z)-greatest(a.min_z,b.min_z)) AS overlap_volume
FROM {fx_geometry} a JOIN {fx_geometry} b ON a.object_id<b.object_id AND a.min_x-0.16<=b.max_x AND b.min_x-0.16<=a.max_x AND a.min_y-0.16<=b.max_y AND b.min_y-0.16<=a.max_y AND a.min_z-0.16<=b.max_z AND b.min_z-0.16<=a.max_z) e
WHERE distance<=0.15""",
    "fx_category_edges": """
SELECT * FROM (SELECT least(a.object_id,b.object_id) AS source_id, greatest(a.object_id,b.object_id) AS target_id, greatest(a.tol,b.tol) AS tolerance,
 sqrt(pow(greatest(0,a.min_x-b.max_x,b.min_x-a.max_x),2)+pow(greatest(0,a.min_y-b.max_y,b.min_y-a.max_y),2)+pow(greatest(0,a.min_z-b.max_z,b.min_z-a.max_z),2)) AS distance,
 greatest(0,least(a.max_x,b.max_x)-greatest(a.min_x,b.min_x))*greatest(0,least(a.max_y,b.max_y)-greatest(a.min_y,b.min_y))*greatest(0,least(a.max_z,b.max_z)-greatest(a.min_z,b.min_z)) AS overlap_volume
FROM {fx_tolerances} a JOIN {fx_tolerances} b ON a.object_id<b.object_id AND a.min_x-0.21<=b.max_x AND b.min_x-0.21<=a.max_x AND a.min_y-0.21<=b.max_y AND b.min_y-0.21<=a.max_y AND a.min_z-0.21<=b.max_z AND b.min_z-0.21<=a.max_z) e WHERE distance<=tolerance""",
    "fx_tolerances": "SELECT *, CASE category WHEN 'Pipe' THEN 0.05::DOUBLE WHEN 'Structural Steel' THEN 0.20::DOUBLE WHEN 'HVAC Duct' THEN 0.08::DOUBLE WHEN 'Equipment' THEN 0.10::DOUBLE WHEN 'Insulation' THEN 0.01::DOUBLE ELSE 0.15::DOUBLE END AS tol FROM {fx_geometry}",
    "fx_match": """
SELECT s.*, CASE WHEN s.sync_id='' THEN 'Error' WHEN e.object_id IS NOT NULL THEN 'Matched' ELSE 'NotFound' END AS match_status, CASE WHEN s.sync_id<>'' THEN e.object_id END AS matched_object_id
FROM {fx_schedule} s LEFT JOIN (SELECT raw_value, min_by(object_id, seq) AS object_id FROM {fx_split} WHERE category='Element' AND property_name='Id' GROUP BY raw_value) e ON e.raw_value=s.sync_id""",
}


@dataclass(frozen=True)
class Query:
    build: Callable[[Fixtures], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; the SQL may use ``{view}`` placeholders."""

    def wrap(build: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(build, None if sql is None else with_views(sql, SQL_VIEWS))
        return build

    return wrap
