"""Tree, property-row and unified-object queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from girderframe.functions import formats
from girderframe.operators import props, tree, unified
from girderframe.sources import tables

_VISITED = "{fx_walk}"


@query("A06_property_scan", "SELECT object_id, parent_id, level, category, property_name, property_value, seq FROM {fx_properties}")
def scan(fx):
    return fx("fx_properties")


@query("A07_geometry_scan", """
SELECT object_id, max_by(category, seq2) AS category, max_by(min_x, seq2) AS min_x, max(seq2) AS seq FROM (
SELECT object_id, category, min_x, min_y, min_z, max_x, max_y, max_z, seq AS seq2 FROM {fx_geometry}
UNION ALL SELECT object_id, 'Moved', min_x+1, min_y, min_z, max_x+1, max_y, max_z, seq+5000000000 FROM {fx_geometry} WHERE seq%4=0)
WHERE abs((max_x-min_x)*(max_y-min_y)*(max_z-min_z))>=1e-10 GROUP BY object_id""")
def geometry_scan(fx):
    g = fx("fx_geometry")
    moved = g.filter("seq % 4 = 0").withColumns(
        {"category": F.lit("Moved"), "min_x": F.col("min_x") + 1, "max_x": F.col("max_x") + 1, "seq": F.col("seq") + 5000000000}
    )
    blank = g.filter("seq % 9 = 0").withColumn("object_id", F.lit(""))
    unknown = g.filter("seq % 5 = 0").withColumns({"min_x": F.lit(None).cast("double"), "seq": F.col("seq") + 6000000000})
    rows = g.unionByName(moved).unionByName(blank).unionByName(unknown)
    return unified.latest_geometry(rows).select("object_id", "category", "min_x", "seq")


@query("A08_selection_scan", """
SELECT p.object_id, p.seq, w.level-1 AS level, substr(w.path, strpos(w.path,' > ')+3) AS sys_path FROM {fx_properties} p JOIN {fx_walk} w ON p.object_id=w.object_id JOIN {fx_nodes} n ON n.object_id=w.root_id
WHERE n.display_name<>''""")
def selection(fx):
    seeds = fx("fx_nodes").filter("class_name = 'Zone'").select("object_id")
    return tables.from_selection(fx("fx_nodes"), fx("fx_properties"), seeds).select("object_id", "seq", "level", "sys_path")


@query("A09_indexed_selection", """
SELECT seq, category, property_name AS name, property_value AS value, display_name AS object_name, dense_rank() OVER (ORDER BY first_seq, object_id) AS object_index FROM (
SELECT *, min(seq) OVER (PARTITION BY object_id) AS first_seq FROM {fx_records})""")
def indexed(fx):
    return props.indexed_properties(fx("fx_records"))


@query("A10_row_preview", "SELECT sync_id, task_name, seq FROM {fx_schedule} ORDER BY seq LIMIT 10")
def preview(fx):
    from girderframe.operators.schedule import preview as first

    return first(fx("fx_schedule").select("sync_id", "task_name", "seq"), 10)


@query("B01_hidden_subtree_pruning", "SELECT object_id FROM {fx_walk}")
def pruned(fx):
    return tree.walk(fx("fx_nodes")).select("object_id")


@query("B02_path_build", "SELECT object_id, path FROM {fx_walk}")
def paths(fx):
    return tree.walk(fx("fx_nodes")).select("object_id", "path")


@query("B02_path_build_skipping_empty_names", """
SELECT o.object_id, 'P > '||r.r_name||' > '||o.display_name AS path FROM {fx_nodes} o JOIN {customer} c ON o.parent_id='C:'||CAST(c_custkey AS STRING) JOIN {nation} n ON c_nationkey=n_nationkey JOIN {region} r ON n_regionkey=r_regionkey""")
def sparse_paths(fx):
    # Zones and customers lose their names; the roots get a common parent name in front.
    named = F.when(F.col("class_name") == "Region", F.concat(F.lit("P > "), "display_name")).when(
        F.col("has_geometry"), F.col("display_name")
    )
    nodes = fx("fx_nodes").withColumn("display_name", named)
    walked = tree.walk(nodes, skip_empty_names=True, prune_hidden=False)
    return walked.filter("has_geometry").select("object_id", "path")


@query("B03_levels", "SELECT object_id, level FROM {fx_walk}")
def levels(fx):
    return tree.walk(fx("fx_nodes")).select("object_id", "level")


@query("B04_container_pass_through", """
SELECT w.object_id, n.parent_id FROM {fx_walk} w JOIN {fx_nodes} n ON n.object_id=w.object_id WHERE n.has_geometry OR w.object_id IN (SELECT object_id FROM {fx_properties})""")
def emitted(fx):
    return tree.emitted_nodes(tree.walk(fx("fx_nodes")), fx("fx_properties")).select("object_id", "parent_id")


_IDENTIFIED = """
SELECT object_id, CASE WHEN seq%5=0 THEN '0000aaaa-0000-0000-0000-'||lpad(CAST(seq AS STRING),12,'0') ELSE '00000000-0000-0000-0000-000000000000' END AS instance_id, 'src-1' AS source_id, 'root > '||object_id AS path FROM {fx_nodes}"""


@query("B05_stable_ids", """
WITH k AS (SELECT i.*, p.authoring_id, p.item_guid FROM (""" + _IDENTIFIED + """) i LEFT JOIN (SELECT object_id, 'Revit:'||max(CASE WHEN property_name='Id' THEN property_value END) AS authoring_id,
 max(CASE WHEN property_name='Height' THEN '0000bbbb-1111-2222-3333-'||lpad(substr(object_id,3),12,'0') END) AS item_guid FROM {fx_properties} GROUP BY object_id) p ON p.object_id=i.object_id)
SELECT object_id, CASE WHEN instance_id<>'00000000-0000-0000-0000-000000000000' THEN instance_id WHEN item_guid IS NOT NULL THEN item_guid
 ELSE substr(h,7,2)||substr(h,5,2)||substr(h,3,2)||substr(h,1,2)||'-'||substr(h,11,2)||substr(h,9,2)||'-'||substr(h,15,2)||substr(h,13,2)||'-'||substr(h,17,4)||'-'||substr(h,21,12) END AS stable_id
FROM (SELECT *, md5(source_id||'|'||coalesce(authoring_id, path)) AS h FROM k)""")
def stable(fx):
    nodes = fx("fx_nodes").select(
        "object_id",
        F.when(F.col("seq") % 5 == 0, F.concat(F.lit("0000aaaa-0000-0000-0000-"), F.lpad(F.col("seq").cast("string"), 12, "0")))
        .otherwise(F.lit("00000000-0000-0000-0000-000000000000")).alias("instance_id"),
        F.lit("src-1").alias("source_id"),
        F.concat(F.lit("root > "), "object_id").alias("path"),
    )
    guid = F.upper(F.concat(F.lit("{0000bbbb-1111-2222-3333-"), F.lpad(F.substring("object_id", 3, 20), 12, "0"), F.lit("}")))
    height = F.col("property_name") == "Height"
    rows = fx("fx_properties").withColumns(
        {
            "property_value": F.when(height, guid).otherwise(F.col("property_value")),
            "category": F.when(height, F.lit("Item")).otherwise(F.col("category")),
            "property_name": F.when(height, F.lit("GUID")).otherwise(F.col("property_name")),
        }
    )
    return tree.stable_ids(nodes, rows).select("object_id", "stable_id")


@query("B07_authoring_ids", """
SELECT object_id, CASE WHEN seq%3=0 THEN 'AutoCAD:' ELSE 'Revit:' END||property_value AS authoring_id FROM {fx_properties} WHERE property_name='Id'""")
def authoring(fx):
    first = F.when((F.col("property_name") == "Id") & (F.col("seq") % 3 == 0), F.lit("Handle")).otherwise(F.col("property_name"))
    later = F.when(first == "Length", F.lit("GlobalId")).otherwise(first)
    return tree.authoring_ids(fx("fx_properties").withColumn("property_name", later))


@query("B08_item_guids", """
SELECT object_id, '0000bbbb-1111-2222-3333-'||lpad(substr(object_id,3),12,'0') AS item_guid FROM {fx_properties} WHERE property_name='Name'""")
def item_guids(fx):
    guid = F.concat(F.lit("0000BBBB-1111-2222-3333-"), F.lpad(F.substring("object_id", 3, 20), 12, "0"))
    is_name, is_type = F.col("property_name") == "Name", F.col("property_name") == "Type"
    rows = fx("fx_properties").withColumns(
        {
            "property_value": F.when(is_name, guid).when(is_type, F.lit("not a guid")).otherwise(F.col("property_value")),
            "property_name": F.when(is_name | is_type, F.lit("Guid")).otherwise(F.col("property_name")),
        }
    )
    return tree.item_guids(rows)


@query("B09_display_names", """
SELECT n.object_id, CASE WHEN n.seq%4=0 THEN n.display_name WHEN p.property_value IS NOT NULL THEN p.property_value WHEN n.seq%3<>0 THEN n.class_name WHEN a.property_value IS NOT NULL THEN 'Revit:'||a.property_value ELSE 'Unknown_'||substr(n.object_id,1,8) END AS display_name
FROM {fx_nodes} n LEFT JOIN (SELECT * FROM {fx_properties} WHERE property_name='Name' AND property_value<>'') p ON p.object_id=n.object_id LEFT JOIN (SELECT * FROM {fx_properties} WHERE property_name='Id') a ON a.object_id=n.object_id""")
def names(fx):
    nodes = fx("fx_nodes").select(
        "object_id",
        F.when(F.col("seq") % 4 == 0, F.col("display_name")).otherwise(F.lit("  ")).alias("display_name"),
        F.when(F.col("seq") % 3 != 0, F.col("class_name")).alias("class_name"),
        F.lit("00000000-0000-0000-0000-000000000000").alias("instance_id"),
    )
    return tree.display_names(nodes, fx("fx_properties")).select("object_id", "display_name")


@query("B10_descendants", """
WITH RECURSIVE d AS (SELECT object_id, object_id AS root_id, 0 AS level, display_name AS path FROM {fx_nodes} WHERE class_name='Zone' AND NOT is_hidden
UNION ALL SELECT n.object_id, d.root_id, d.level+1, d.path||' > '||n.display_name FROM {fx_nodes} n JOIN d ON n.parent_id=d.object_id WHERE NOT n.is_hidden)
SELECT object_id, root_id, level, path FROM d""")
def subtrees(fx):
    seeds = fx("fx_nodes").filter("class_name = 'Zone'")
    return tree.descendants(fx("fx_nodes"), seeds).select("object_id", "root_id", "level", "path")


@query("B11_children_with_geometry", """
SELECT n.parent_id, n.object_id AS child_id FROM {fx_nodes} n WHERE n.object_id IN (SELECT object_id FROM {fx_container_geometry}) AND n.parent_id IN (SELECT object_id FROM {fx_container_geometry})""")
def children(fx):
    return tree.child_links(fx("fx_nodes"), fx("fx_container_geometry"))


@query("B12_leaf_and_child_count", """
SELECT n.object_id, coalesce(c.k,0) AS child_count, coalesce(c.k,0)=0 AS is_leaf FROM {fx_nodes} n LEFT JOIN (SELECT parent_id, count(*) AS k FROM {fx_nodes} WHERE parent_id<>'' GROUP BY parent_id) c ON c.parent_id=n.object_id""")
def leaves(fx):
    return tree.with_child_counts(fx("fx_nodes")).select("object_id", "child_count", "is_leaf")


@query("B13_node_counts", """
SELECT (SELECT count(*) FROM {fx_nodes}) AS total_nodes, (SELECT count(*) FROM {fx_nodes} WHERE has_geometry) AS geometry_nodes, (SELECT count(*) FROM {fx_walk}) AS visible_nodes""")
def counts(fx):
    return tree.node_counts(fx("fx_nodes"), tree.walk(fx("fx_nodes")))


@query("B14_id_statistics", """
SELECT count(*) AS total_rows, count(DISTINCT object_id) AS distinct_object_ids, CAST(0 AS BIGINT) AS empty_object_ids, count(DISTINCT object_id) AS valid_object_ids, count(DISTINCT parent_id)+1 AS distinct_parent_ids, CAST(1 AS BIGINT) AS empty_parent_ids, count(DISTINCT parent_id) AS valid_parent_ids FROM (
SELECT object_id, CASE WHEN object_id LIKE '%7' THEN NULL ELSE parent_id END AS parent_id FROM {fx_properties})""")
def id_stats(fx):
    rows = fx("fx_properties").withColumn(
        "parent_id", F.when(F.col("object_id").endswith("7"), F.lit("00000000-0000-0000-0000-000000000000")).otherwise(F.col("parent_id"))
    )
    return tree.id_statistics(rows)


@query("B15_lookup_by_ids", """
SELECT object_id, display_name FROM {fx_nodes} WHERE object_id IN (SELECT 'O:'||CAST(l_orderkey AS STRING) FROM {lineitem} WHERE l_returnflag='R')""")
def lookups(fx):
    wanted = fx("lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("O:"), F.col("l_orderkey").cast("string")).alias("object_id"))
    return tree.lookup(fx("fx_nodes"), wanted).select("object_id", "display_name")


@query("B16_level_cut", "SELECT object_id, level, level=2 AS exact FROM {fx_walk} WHERE level<=2")
def cut(fx):
    walked = tree.walk(fx("fx_nodes"))
    exact = tree.cut_levels(walked, 2, exact=True).select("object_id", F.lit(True).alias("exact"))
    upper = tree.cut_levels(walked, 2).select("object_id", "level")
    return upper.join(exact, "object_id", "left").select("object_id", "level", F.coalesce("exact", F.lit(False)).alias("exact"))


@query("B17_folder_paths", """
WITH p AS (SELECT parent_set AS a, seq FROM {fx_schedule} WHERE parent_set IS NOT NULL), q AS (
SELECT split_part(a,'/',1) AS f, 1 AS depth FROM p UNION SELECT split_part(a,'/',1)||'/'||split_part(a,'/',2), 2 FROM p UNION SELECT a, 3 FROM p)
SELECT DISTINCT lower(f) AS folder_key, depth FROM q""")
def folders(fx):
    # Every second row spells its path in upper case, with backslashes.
    shouted = F.upper(F.regexp_replace("parent_set", "/", r"\\\\"))
    rows = fx("fx_schedule").withColumn("parent_set", F.when(F.col("seq") % 2 == 0, shouted).otherwise(F.col("parent_set")))
    return tree.folder_paths(rows, "parent_set", "seq").select("folder_key", "depth")


@query("B18_task_tree_flatten", "SELECT n.object_id, replace(w.path,' > ','/') AS full_path FROM {fx_walk} w JOIN {fx_nodes} n ON n.object_id=w.object_id")
def task_tree(fx):
    visible = fx("fx_nodes").filter("not is_hidden")
    return tree.flatten_tasks(visible).select("object_id", "full_path")


@query("C01_five_way_filter", """
SELECT seq FROM {fx_records} WHERE level=3 AND contains(lower(sys_path),'asia') AND category='Dimensions' AND contains(lower(property_name),'eng') AND contains(lower(property_value),' mm')""")
def five_way(fx):
    return props.filter_rows(fx("fx_records"), "L3", "ASIA", "Dimensions", "ENG", " MM").select("seq")


@query("C01_filter_disabled", "SELECT seq FROM {fx_records}")
def no_filter(fx):
    return props.filter_rows(fx("fx_records"), "(All)", "", "(All)", None, "").select("seq")


@query("C02_grouped_filter", """
SELECT object_id, count(*) AS property_count, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM {fx_records} WHERE level IN (2,3) AND category IN ('Item','Dimensions') AND contains(lower(property_value),'m') GROUP BY object_id""")
def grouped_filter(fx):
    kept = props.filter_groups(fx("fx_records"), [2, 3], ["Item", "Dimensions"], None, "M")
    return props.group_objects(kept).select("object_id", "property_count", F.array_join("categories", ",").alias("categories"))


@query("C04_global_search", """
SELECT seq FROM {fx_records} WHERE contains(lower(display_name),'99') OR contains(lower(property_value),'99') OR contains(lower(property_name),'99') OR contains(lower(sys_path),'99')""")
def search(fx):
    return props.search(fx("fx_records"), "99").select("seq")


@query("C05_table_filter", """
SELECT s_suppkey, 'any' AS scope FROM {supplier} WHERE contains(CAST(s_suppkey AS STRING),'4') OR contains(lower(s_name),'4') OR contains(CAST(s_nationkey AS STRING),'4')
UNION ALL SELECT s_suppkey, 'name' FROM {supplier} WHERE contains(lower(s_name),'4')""")
def table_filter(fx):
    table = fx("supplier").select("s_suppkey", "s_name", "s_nationkey")
    anywhere = props.filter_table(table, "4").select("s_suppkey", F.lit("any").alias("scope"))
    return anywhere.unionByName(props.filter_table(table, "4", "s_name").select("s_suppkey", F.lit("name").alias("scope")))


@query("C06_exact_property_search", "SELECT DISTINCT object_id FROM {fx_records} WHERE category='Dimensions' AND property_name='Height' AND property_value='2.5 m'")
def exact_search(fx):
    return props.find_by_property(fx("fx_records"), "Dimensions", "Height", "2.5 m")


@query("C07_selected_rows", "SELECT seq FROM {fx_records} WHERE seq%7=0 OR object_id IN (SELECT object_id FROM {fx_geometry} WHERE category='Pipe')")
def selected(fx):
    rows = fx("fx_records").withColumn("is_selected", F.col("seq") % 7 == 0)
    return props.selected_rows(rows, fx("fx_geometry").filter("category = 'Pipe'")).select("seq")


@query("C08_distinct_object_ids", "SELECT DISTINCT object_id FROM {fx_properties} WHERE seq%3<>0")
def distinct_ids(fx):
    rows = fx("fx_properties").withColumn("object_id", F.when(F.col("seq") % 3 != 0, F.col("object_id")).otherwise(F.lit("")))
    return props.object_ids(rows)


@query("C09_show_only", "SELECT object_id FROM {fx_nodes} WHERE object_id NOT IN (SELECT object_id FROM {fx_geometry} WHERE category='Equipment')")
def show_only(fx):
    return props.hidden_by_show_only(fx("fx_nodes"), fx("fx_geometry").filter("category = 'Equipment'"))


@query("C10_leaf_filter", "SELECT object_id FROM {fx_mesh_geometry} WHERE coalesce(mesh_quality,'') NOT IN ('skipped_container','hidden')")
def leaf(fx):
    return props.leaf_geometry(fx("fx_mesh_geometry")).select("object_id")


@query("C12_spatial_window", """
SELECT object_id, volume FROM (SELECT *, abs((max_x-min_x)*(max_y-min_y)*(max_z-min_z)) AS volume FROM {fx_geometry}) WHERE min_x>=0 AND max_x<=40 AND min_y>=0 AND max_y<=100 ORDER BY volume DESC""")
def window(fx):
    from girderframe.functions.boxes import Box

    inside = props.in_window(fx("fx_geometry"), 0, 0, 40, 100)
    return inside.select("object_id", Box.of().volume().alias("volume")).orderBy(F.desc("volume"), "object_id")


@query("C13_ungroup", "SELECT object_id, parent_id, level, category, property_name, property_value, seq FROM {fx_records}")
def ungrouped(fx):
    rows = props.ungroup(props.group_objects(fx("fx_records")))
    return rows.select("object_id", "parent_id", "level", "category", "property_name", "property_value", "seq")


@query("C14_supplement_targets", """
SELECT object_id, 'gap' AS target_kind FROM {fx_mesh_geometry} WHERE mesh_quality='gap_supplemented'
UNION ALL SELECT object_id, 'partial_no_geometry' FROM {fx_mesh_geometry} WHERE mesh_quality='no_geometry' AND seq%2=0""")
def targets(fx):
    partial = fx("fx_mesh_geometry").select("object_id", F.when(F.col("seq") % 2 == 0, "partial_container").otherwise("skipped_container").alias("container_status"))
    return props.supplement_targets(fx("fx_mesh_geometry"), partial).select("object_id", "target_kind")


@query("E01_group_objects", """
SELECT object_id, min(parent_id) AS parent_id, min(level) AS level, min(display_name) AS display_name, min(sys_path) AS sys_path, count(*) AS property_count, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, string_agg(property_name, ',' ORDER BY seq) AS names FROM {fx_records} GROUP BY object_id""")
def groups(fx):
    g = props.group_objects(fx("fx_records"))
    return g.select(
        "object_id", "parent_id", "level", "display_name", "sys_path", "property_count",
        F.array_join("categories", ",").alias("categories"), F.array_join("properties.property_name", ",").alias("names"),
    )


@query("E02_pivot_wide", """
SELECT object_id, min(parent_id) AS parent_id, coalesce(max(CASE WHEN property_name='Height' THEN property_value END),'') AS "Dimensions|Height", coalesce(max(CASE WHEN property_name='Length' THEN property_value END),'') AS "Dimensions|Length",
 coalesce(max(CASE WHEN property_name='Id' THEN property_value END),'') AS "Element|Id", coalesce(max(CASE WHEN property_name='Name' THEN property_value END),'') AS "Item|Name", coalesce(max(CASE WHEN property_name='Type' THEN 'last' END),'') AS "Item|Type" FROM {fx_records} GROUP BY object_id""")
def pivot(fx):
    rows = fx("fx_records")
    again = rows.filter("property_name = 'Type'").withColumns({"property_value": F.lit("last"), "seq": F.col("seq") + 5})
    return props.pivot_wide(rows.unionByName(again)).drop("level", "display_name")


@query("E03_level_facet", "SELECT 'L'||CAST(level AS STRING) AS name, level, count(*) AS n FROM {fx_walk} GROUP BY level")
def level_facet(fx):
    return props.level_facet(tree.walk(fx("fx_nodes")))


@query("E04_category_facet", "SELECT category, count(DISTINCT object_id) AS n FROM {fx_records} GROUP BY category")
def category_facet(fx):
    return props.category_facet(fx("fx_records"))


@query("E05_category_row_counts", """
WITH c AS (SELECT p_type AS category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS r FROM {part} GROUP BY p_type)
SELECT category, n FROM c WHERE r<=3 UNION ALL SELECT '... and '||CAST(count(*) AS STRING)||' more categories', CAST(sum(n) AS BIGINT) FROM c WHERE r>3 HAVING count(*)>0""")
def row_counts(fx):
    return props.category_rows(fx("part").select(F.col("p_type").alias("category")), top=3)


@query("E06_distinct_values", "SELECT DISTINCT category AS value, 'category' AS kind FROM {fx_records} UNION ALL SELECT DISTINCT CAST(level AS STRING), 'level' FROM {fx_walk}")
def values(fx):
    a = props.distinct_values(fx("fx_records"), "category").select(F.col("category").alias("value"), F.lit("category").alias("kind"))
    b = props.distinct_values(tree.walk(fx("fx_nodes")), "level").select(F.col("level").cast("string").alias("value"), F.lit("level").alias("kind"))
    return a.unionByName(b)


@query("E07_properties_json", """
SELECT object_id, count(*) AS property_count, '['||string_agg('{"category":"'||category||'","name":"'||property_name||'","value":"'||property_value||'","rawValue":"'||raw_value||'","dataType":"'||data_type||'","numericValue":'||coalesce(CAST(numeric_value AS STRING),'null')||',"unit":"'||unit||'"}', ',' ORDER BY seq)||']' AS json FROM {fx_parsed} GROUP BY object_id""")
def json(fx):
    from girderframe.functions.display import with_parsed

    g = props.group_objects(with_parsed(fx("fx_records")))
    return g.select("object_id", "property_count", props.properties_json(F.col("properties")).alias("json"))


@query("E08_object_category", """
SELECT object_id, CASE WHEN object_id LIKE '%1' THEN 'Dimensions' ELSE min_by(property_value, seq) END AS object_category FROM {fx_records} WHERE (object_id LIKE '%1' AND property_name='Id') OR (object_id NOT LIKE '%1' AND property_name='Type') GROUP BY object_id""")
def category(fx):
    # Objects ending in 1 lose their item rows and start with a dimension row.
    rows = fx("fx_records").filter("not (object_id like '%1' and category in ('Item', 'Element'))")
    return unified.object_categories(rows).select("object_id", "object_category")


@query("E26_totals", "SELECT count(DISTINCT object_id) AS groups, count(*) AS properties, count(*)//count(DISTINCT object_id) AS average FROM {fx_records}")
def totals(fx):
    return props.totals(fx("fx_records"))


@query("E28_object_headers", """
SELECT object_id, min(level) AS level, min(display_name) AS display_name, count(*) AS property_count, count(DISTINCT category) AS category_count, min(display_name)||' ('||CAST(count(*) AS STRING)||' props)' AS header FROM {fx_records} GROUP BY object_id""")
def headers(fx):
    return props.object_headers(fx("fx_records"))


@query("E30_selection_summary", """
SELECT *, CAST(selected_groups AS STRING)||' groups ('||CAST(selected_properties AS STRING)||' props)' AS summary FROM (SELECT count(*) AS filtered_groups, CAST(sum(n) AS BIGINT) AS filtered_properties, count(*) FILTER (sel) AS selected_groups, CAST(sum(n) FILTER (sel) AS BIGINT) AS selected_properties FROM (
SELECT object_id, count(*) AS n, object_id IN (SELECT object_id FROM {fx_geometry} WHERE category='Pipe') AS sel FROM {fx_records} WHERE category IN ('Item','Dimensions') GROUP BY object_id))""")
def selection_summary(fx):
    kept = props.filter_groups(fx("fx_records"), categories=["Item", "Dimensions"])
    return props.selection_summary(kept, fx("fx_geometry").filter("category = 'Pipe'"))


@query("G02_first_row", "SELECT object_id, property_name, property_value, seq FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY seq) AS r FROM {fx_records}) WHERE r=1")
def first(fx):
    return props.first_rows(fx("fx_records")).select("object_id", "property_name", "property_value", "seq")


@query("G03_last_write", "SELECT object_id, category, property_name, seq FROM (SELECT *, row_number() OVER (PARTITION BY object_id, category ORDER BY seq DESC) AS r FROM {fx_records}) WHERE r=1")
def last(fx):
    return props.last_rows(fx("fx_records"), ["object_id", "category"]).select("object_id", "category", "property_name", "seq")


@query("G06_group_order", """
SELECT object_id, row_number() OVER (ORDER BY level, display_name, object_id) AS position FROM (SELECT object_id, min(level) AS level, min(display_name) AS display_name FROM {fx_records} GROUP BY object_id)""")
def ordered(fx):
    from girderframe.operators.numbering import global_row_number

    headers_ = props.object_headers(fx("fx_records"))
    order = [F.col("level"), F.col("display_name"), F.col("object_id")]
    return global_row_number(headers_, order, "position").select("object_id", "position")


@query("H01_union_of_sides", "SELECT object_id FROM {fx_records} UNION SELECT object_id FROM {fx_geometry}")
def union(fx):
    return unified.merge(fx("fx_records"), fx("fx_geometry"), with_json=False).select("object_id")


@query("H02_difference", "SELECT object_id FROM {fx_geometry} EXCEPT SELECT object_id FROM {fx_properties}")
def difference(fx):
    return props.hidden_by_show_only(fx("fx_geometry"), fx("fx_properties"))


@query("H03_intersection", "SELECT DISTINCT category FROM {fx_geometry} WHERE category IN ('Pipe','Equipment','Absent')")
def intersection(fx):
    return props.distinct_values(props.filter_groups(fx("fx_geometry"), categories=["Pipe", "Equipment", "Absent"]), "category")


@query("H04_union_models", "SELECT 'a' AS source_id, object_id, seq FROM {fx_records} UNION ALL SELECT 'b', object_id, seq FROM {fx_geometry_properties}")
def models(fx):
    return props.union_models({"a": fx("fx_records"), "b": fx("fx_geometry_properties")}).select("source_id", "object_id", "seq")


@query("D01_unified_merge", """
WITH p AS (SELECT object_id, min(parent_id) AS parent_id, min(level) AS level, min(display_name) AS display_name, min(sys_path) AS path, count(*) AS n, min_by(CASE WHEN property_name='Type' THEN property_value END, CASE WHEN property_name='Type' THEN seq END) AS cat FROM {fx_records} GROUP BY object_id)
SELECT coalesce(p.object_id,g.object_id) AS object_id, coalesce(p.parent_id,'') AS parent_id, coalesce(p.level,0) AS level, CASE WHEN p.object_id IS NOT NULL THEN p.display_name ELSE coalesce(g.display_name,'Unknown') END AS display_name,
 CASE WHEN p.object_id IS NOT NULL THEN p.cat ELSE g.category END AS object_category, coalesce(p.path,'') AS hierarchy_path, coalesce(p.n,0) AS property_count, coalesce(v>=1e-10,FALSE) AS has_box, CASE WHEN v>=1e-10 THEN g.min_x END AS min_x, CASE WHEN v>=1e-10 THEN g.max_z END AS max_z,
 (g.min_y+g.max_y)*0.5 AS centroid_y, CASE WHEN v>=1e-10 THEN v END AS volume, coalesce(g.has_mesh,FALSE) AS has_mesh, coalesce(g.mesh_quality,'') AS mesh_quality, coalesce(g.vertex_count,0) AS vertex_count
FROM p FULL JOIN (SELECT *, abs((max_x-min_x)*(max_y-min_y)*(max_z-min_z)) AS v FROM {fx_mesh_geometry}) g ON p.object_id=g.object_id""")
def merged(fx):
    return unified.merge(fx("fx_records"), fx("fx_mesh_geometry")).select(
        "object_id", "parent_id", "level", "display_name", "object_category", "hierarchy_path", "property_count", "has_box",
        "min_x", "max_z", "centroid_y", "volume", "has_mesh", "mesh_quality", "vertex_count",
    )


@query("E09_global_box", "SELECT min(min_x) AS min_x, min(min_y) AS min_y, min(min_z) AS min_z, max(max_x) AS max_x, max(max_y) AS max_y, max(max_z) AS max_z FROM {fx_geometry}")
def global_box(fx):
    return unified.global_box(fx("fx_geometry"))


@query("L05_unified_from_selection", """
SELECT p.object_id, count(*) AS property_count, max(w.path) AS hierarchy_path FROM {fx_properties} p JOIN (SELECT w.object_id, substr(w.path, strpos(w.path,' > ')+3) AS path FROM {fx_walk} w) w ON p.object_id=w.object_id GROUP BY p.object_id""")
def unified_selection(fx):
    seeds = fx("fx_nodes").filter("class_name = 'Zone'").select("object_id")
    rows = tables.from_selection(fx("fx_nodes"), fx("fx_properties"), seeds)
    boxes = fx("fx_geometry").join(rows.select("object_id").distinct(), "object_id", "left_semi")
    return unified.merge(rows, boxes).select("object_id", "property_count", "hierarchy_path")
