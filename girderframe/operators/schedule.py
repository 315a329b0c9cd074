"""Schedule rows: matching to objects, sets, tasks and derived property rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderframe.functions import scheduling
from girderframe.functions.boxes import Box
from girderframe.functions.ids import canonical_guid
from girderframe.functions.text import is_empty, path_parts
from girderframe.operators.numbering import global_row_number, one_row
from girderframe.operators.tree import folder_paths
from girderframe.schema import MatchStatus, ScheduleOptions
from girderframe.session import stored, stored_if_any

# Property pairs tried in turn when the chosen one has no hit.
FALLBACK_PROPERTIES = [
    ("Element", "UniqueId"),
    ("Element", "Id"),
    ("Item", "GUID"),
    ("Item", "Name"),
    ("Element ID", "Value"),
    ("LcRevitData", "UniqueId"),
    ("LcOaNode", "GUID"),
]

# Display names of the schedule fields written back as properties.
FIELD_NAMES = {
    "sync_id": "SyncID",
    "task_name": "작업명",
    "planned_start": "계획시작일",
    "planned_end": "계획종료일",
    "duration": "기간(일)",
    "actual_start": "실제시작일",
    "actual_end": "실제종료일",
    "cost": "비용",
    "progress": "진행률",
    "task_type": "작업유형",
    "set_level": "그룹레벨",
    "parent_set": "상위그룹",
}


# Parts over which the members of a set are dealt out while tasks meet them.
MEMBER_PARTS = 16


def match_pairs(options: ScheduleOptions, fallback: bool = True) -> list[tuple[str, str]]:
    first = (options.match_category, options.match_property)
    return [first] + [p for p in FALLBACK_PROPERTIES if fallback and p != first]


def value_index(
    properties: DataFrame, options: ScheduleOptions, fallback: bool = True, value: str = "raw_value"
) -> DataFrame:
    """One row per property value: the first object under the best-ranked property pair.

    The chosen pair is compared without case when the options say so, the fallback pairs
    exactly. The index is aggregated before it meets the schedule, so a value that very
    many objects share stays one row.
    """
    pairs = match_pairs(options, fallback)
    rank = F
    for i, (category, name) in enumerate(pairs):
        rank = rank.when((F.col("category") == category) & (F.col("property_name") == name), F.lit(i))
    rows = (
        properties.withColumn("_rank", rank)
        .filter(F.col("_rank").isNotNull() & ~is_empty(F.col(value)))
        .select("object_id", "seq", "_rank", F.col(value).alias("_value"))
    )
    # The chosen pair also answers an exact search, which is the same pair at the same rank.
    key = F.lower("_value") if options.ignore_case else F.col("_value")
    rows = rows.withColumn("_key", F.when(F.col("_rank") == 0, key).otherwise(F.col("_value")))
    counts = [F.count_if(F.col("_rank") == i) for i in range(len(pairs))]
    return rows.groupBy((F.col("_rank") > 0).alias("_fallback"), "_key").agg(
        F.min("_rank").alias("_best"),
        F.min_by("object_id", F.struct("_rank", "seq", "object_id")).alias("_object"),
        F.array(*counts).alias("_counts"),
    ).select("_fallback", "_key", F.col("_best").alias("_rank"), "_object", F.element_at("_counts", F.col("_best") + 1).alias("_hits"))


def match(
    schedule: DataFrame,
    properties: DataFrame,
    options: ScheduleOptions = ScheduleOptions(),
    fallback: bool = True,
    value: str = "raw_value",
) -> DataFrame:
    """Match schedule rows to objects by sync id.

    Adds matched_object_id, match_count, match_property, match_status and match_error.
    """
    pairs = match_pairs(options, fallback)
    index = value_index(properties, options, fallback, value)
    if fallback:
        # Both lookups read it; stored, the property table is scanned once.
        index = stored(index, "values")
    key = F.lower("sync_id") if options.ignore_case else F.col("sync_id")
    chosen = index.filter("not _fallback").select(
        F.col("_key").alias("_k1"), F.col("_object").alias("_o1"), F.col("_hits").alias("_h1")
    )
    # Blank ids match nothing and do not meet under one key.
    blank = is_empty(F.col("sync_id"))
    joined = schedule.filter(~blank).withColumn("_k1", key).join(chosen, "_k1", "left")
    found, hits, rank = F.col("_o1"), F.col("_h1"), F.when(F.col("_o1").isNotNull(), F.lit(0))
    if fallback:
        others = index.filter("_fallback").select(
            F.col("_key").alias("_k2"), F.col("_object").alias("_o2"), F.col("_hits").alias("_h2"), F.col("_rank").alias("_r2")
        )
        joined = joined.withColumn("_k2", F.col("sync_id")).join(others, "_k2", "left")
        found, hits, rank = F.coalesce("_o1", "_o2"), F.coalesce("_h1", "_h2"), F.coalesce(rank, F.col("_r2"))
    joined = joined.unionByName(schedule.filter(blank), allowMissingColumns=True)
    label = F
    for i, (category, name) in enumerate(pairs):
        label = label.when(rank == i, F.lit(f"{category}.{name}"))
    return joined.withColumns(
        {
            "matched_object_id": F.when(~blank, found),
            "match_count": F.when(blank, F.lit(0)).otherwise(F.coalesce(hits, F.lit(0))),
            "match_property": F.when(~blank, label),
            "match_status": F.when(blank, F.lit(MatchStatus.ERROR))
            .when(found.isNotNull(), F.lit(MatchStatus.MATCHED))
            .otherwise(F.lit(MatchStatus.NOT_FOUND)),
            "match_error": F.when(blank, F.lit("SyncID가 비어있습니다."))
            .when(found.isNull(), F.lit("해당 SyncID를 가진 객체를 찾을 수 없습니다."))
            .otherwise(F.lit("")),
        }
    ).select(*schedule.columns, "matched_object_id", "match_count", "match_property", "match_status", "match_error")


def match_direct(schedule: DataFrame, objects: DataFrame) -> DataFrame:
    """Match sync ids that are GUIDs of existing objects."""
    known = objects.select(F.col("object_id").alias("_guid")).distinct().withColumn("_hit", F.lit(True))
    marked = schedule.withColumn("_guid", canonical_guid(F.col("sync_id")))
    # Texts that are no GUID match nothing and do not meet under one key.
    joined = marked.filter("_guid IS NOT NULL").join(known, "_guid", "left")
    joined = joined.unionByName(marked.filter("_guid IS NULL"), allowMissingColumns=True)
    hit = F.col("_hit").isNotNull()
    return joined.withColumns(
        {
            "matched_object_id": F.when(hit, F.col("_guid")),
            "match_count": F.when(hit, F.lit(1)).otherwise(F.lit(0)),
            "match_property": F.when(hit, F.lit("object_id")),
            "match_status": F.when(is_empty(F.col("sync_id")), F.lit(MatchStatus.ERROR))
            .when(hit, F.lit(MatchStatus.MATCHED))
            .otherwise(F.lit(MatchStatus.NOT_FOUND)),
            "match_error": F.when(hit, F.lit("")).otherwise(F.lit("ModelItem not found")),
        }
    ).drop("_guid", "_hit")


def match_totals(matched: DataFrame, min_rate: float = 80.0) -> DataFrame:
    """One row of counts, match rate and whether it reaches the minimum."""
    status = F.col("match_status")
    counts = matched.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == MatchStatus.MATCHED).alias("matched"),
        F.count_if(status == MatchStatus.NOT_FOUND).alias("not_found"),
        F.count_if(status == MatchStatus.ERROR).alias("errors"),
        F.count_if(F.col("match_count") > 1).alias("multiple"),
    )
    rate = F.coalesce(F.try_divide(F.col("matched") * 100.0, F.col("total")), F.lit(0.0))
    return counts.withColumn("match_rate", F.round(rate, 6)).withColumn("passes", rate >= min_rate)


def not_found(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("match_status") == MatchStatus.NOT_FOUND).select("sync_id", "seq")


def matched_only(matched: DataFrame) -> DataFrame:
    return matched.filter((F.col("match_status") == MatchStatus.MATCHED) & F.col("matched_object_id").isNotNull())


def dated_only(matched: DataFrame) -> DataFrame:
    return matched_only(matched).filter(F.col("planned_start").isNotNull())


def duplicate_sync_ids(schedule: DataFrame) -> DataFrame:
    return (
        schedule.filter(~is_empty(F.col("sync_id"))).groupBy("sync_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    )


def date_checks(schedule: DataFrame) -> DataFrame:
    """One row: all rows, valid rows and rows that start after they end."""
    start, end = F.col("planned_start"), F.col("planned_end")
    return schedule.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(scheduling.is_valid_schedule(F.col("sync_id"), start, end)).alias("valid"),
        F.count_if(start > end).alias("start_after_end"),
    )


def group_key(strategy: str) -> Column:
    """Set key of a schedule row; NULL drops the row."""
    parent = F.col("parent_set")
    keys = {
        "parent_set": lambda: F.coalesce(parent, F.lit("Ungrouped")),
        "zone": lambda: F.coalesce(scheduling.zone(parent), F.lit("Ungrouped")),
        "zone_level": lambda: F.coalesce(scheduling.zone_level(parent), F.lit("Ungrouped")),
        "task_name": lambda: F.coalesce("task_name", F.lit("Unnamed")),
        "start_week": lambda: F.when(F.col("planned_start").isNotNull(), scheduling.week_key(F.col("planned_start"))),
        "task_type": lambda: F.coalesce("task_type", F.lit("Construct")),
        "none": lambda: F.col("sync_id"),
    }
    if strategy not in keys:
        raise ValueError(f"unknown grouping strategy: {strategy}")
    return keys[strategy]()


def set_members(schedule: DataFrame, strategy: str) -> DataFrame:
    """Schedule rows with their set key, one row per member; rows without a key drop out."""
    return schedule.withColumn("set_key", group_key(strategy)).filter(F.col("set_key").isNotNull())


def sets(matched: DataFrame, objects: DataFrame, strategy: str = "parent_set", skip_empty: bool = True) -> DataFrame:
    """One row per set: key, folder path, unique name, row and item counts.

    The name is the last path part. When an earlier set of the key order already has it,
    the row count is appended. Members stay in ``set_members``, one row each.
    """
    known = objects.select(F.col("object_id").alias("matched_object_id")).distinct().withColumn("_known", F.lit(True))
    rows = set_members(matched_only(matched), strategy).join(known, "matched_object_id", "left")
    grouped = rows.groupBy("set_key").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("_known").isNotNull()).alias("item_count")
    )
    if skip_empty:
        grouped = grouped.filter("item_count > 0")
    return name_sets(grouped.withColumn("folder_path", F.array_join(path_parts(F.col("set_key")), "/")))


def name_sets(grouped: DataFrame) -> DataFrame:
    """Add ``set_name``: the first key of a base name keeps it, the others get a suffix."""
    base = scheduling.last_part(F.col("set_key"))
    named = grouped.withColumn("_base", base).withColumn("_fold", F.lower("_base"))
    owners = named.groupBy("_fold").agg(F.min("set_key").alias("_owner"))
    suffixed = F.concat("_base", F.lit("_"), F.col("row_count").cast("string"), F.lit("items"))
    return (
        named.join(owners, "_fold")
        .withColumn("set_name", F.when(F.col("set_key") == F.col("_owner"), F.col("_base")).otherwise(suffixed))
        .drop("_base", "_fold", "_owner")
    )


def set_totals(set_table: DataFrame) -> DataFrame:
    """One row: sets, folders with the root, and items."""
    folders = folder_paths(set_table, "folder_path", "set_key").agg((F.count(F.lit(1)) + 1).alias("folder_count"))
    totals = set_table.agg(
        F.count(F.lit(1)).alias("set_count"), F.coalesce(F.sum("item_count"), F.lit(0)).alias("item_count")
    )
    return one_row(totals, folders)


def set_links(matched: DataFrame, set_table: DataFrame, strategy: str = "parent_set", legacy_link: bool = False) -> DataFrame:
    """(sync_id, set_key, set_name, item_count) per matched row.

    By default the real set key is joined. ``legacy_link`` joins the last part of the
    parent set to the set name instead, whatever the strategy.
    """
    rows = matched_only(matched)
    if not legacy_link:
        keyed = rows.withColumn("set_key", group_key(strategy)).select("sync_id", "seq", "set_key")
        return keyed.join(set_table.select("set_key", "set_name", "item_count"), "set_key", "left")
    wanted = scheduling.last_part(F.coalesce("parent_set", "sync_id"))
    named = set_table.groupBy(F.lower("set_name").alias("_fold")).agg(
        F.min_by(F.struct("set_key", "set_name", "item_count"), "set_key").alias("_s")
    )
    return (
        rows.select("sync_id", "seq", F.lower(wanted).alias("_fold"))
        .join(named, "_fold", "left")
        .select("sync_id", "seq", "_s.set_key", "_s.set_name", "_s.item_count")
    )


def tasks(
    matched: DataFrame,
    links: DataFrame,
    objects: DataFrame,
    options: ScheduleOptions = ScheduleOptions(),
) -> DataFrame:
    """One task per matched and dated row, with folder path, link flag and item count."""
    rows = dated_only(matched)
    if options.link_mode == "selection_source":
        per_row = links.select("seq", F.coalesce("item_count", F.lit(0)).alias("linked_items"))
        rows = rows.join(per_row, "seq", "left")
    elif options.link_mode == "explicit":
        known = objects.select(F.col("object_id").alias("matched_object_id")).distinct().withColumn("linked_items", F.lit(1))
        rows = rows.join(known, "matched_object_id", "left")
    else:
        rows = rows.withColumn("linked_items", F.lit(0))
    items = F.coalesce("linked_items", F.lit(0))
    folder = F.array_join(path_parts(F.coalesce("parent_set", F.lit(""))), "/")
    folder = folder if options.hierarchical_tasks else F.lit("")
    name = F.coalesce("task_name", "sync_id")
    return rows.select(
        "seq",
        "sync_id",
        name.alias("task_name"),
        folder.alias("folder_path"),
        F.concat_ws("/", F.lit(options.task_root), F.nullif(folder, F.lit("")), name).alias("full_path"),
        "planned_start",
        "planned_end",
        scheduling.task_stage_type(F.coalesce("task_type", F.lit(options.default_task_type))).alias("task_type"),
        "matched_object_id",
        (items > 0).alias("linked"),
        items.alias("linked_items"),
    )


def task_folders(task_table: DataFrame) -> DataFrame:
    return folder_paths(task_table, "folder_path", "seq")


def task_totals(task_table: DataFrame) -> DataFrame:
    """One row: tasks, linked and unlinked."""
    return task_table.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("linked").alias("linked"), F.count_if(~F.col("linked")).alias("unlinked")
    )


def find_task(task_table: DataFrame, sync_ids: DataFrame) -> DataFrame:
    """Tasks by sync id, compared without case; the first task of an id wins."""
    firsts = task_table.filter(~is_empty(F.col("sync_id"))).groupBy(F.lower("sync_id").alias("_k")).agg(
        F.min_by(F.struct(*task_table.columns), "seq").alias("_t")
    )
    wanted = sync_ids.select(F.lower("sync_id").alias("_k")).distinct()
    return firsts.join(wanted, "_k", "left_semi").select("_t.*")


def linked_sets(task_table: DataFrame, links: DataFrame, sync_ids: DataFrame) -> DataFrame:
    """(task_sync_id, set_key) of the wanted tasks: one row for each, whatever the size of its set.

    With the members of the sets, kept once for each set, this is what ``linked_objects`` writes out.
    """
    chosen = find_task(task_table.filter("linked"), sync_ids).select("seq", F.col("sync_id").alias("task_sync_id"))
    return chosen.join(links.select("seq", "set_key"), "seq").select("task_sync_id", "set_key")


def linked_objects(task_table: DataFrame, members: DataFrame, links: DataFrame, sync_ids: DataFrame) -> DataFrame:
    """Objects behind the wanted tasks: the members of each task's set.

    Tasks of a set share its members, so ask for few tasks, and for all of them use ``linked_sets``.
    """
    keyed = linked_sets(task_table, links, sync_ids)
    return keyed.join(members.select("set_key", "matched_object_id"), "set_key").select("task_sync_id", "matched_object_id")


def linked_object_counts(task_table: DataFrame, members: DataFrame, links: DataFrame, sync_ids: DataFrame) -> DataFrame:
    """(task_sync_id, object_id, n): the objects of ``linked_objects``, each once with its number of rows.

    Members are counted within their set, so a task with one set needs no grouping of the pairs, which are
    made last and go nowhere. Only the pairs of tasks with several sets are grouped.
    """
    per_set = linked_sets(task_table, links, sync_ids).groupBy("task_sync_id", "set_key").agg(F.count(F.lit(1)).alias("_rows"))
    found = stored(per_set, "linked-sets")
    objects = members.groupBy("set_key", F.col("matched_object_id").alias("object_id")).agg(F.count(F.lit(1)).alias("_n"))
    sets_of = found.groupBy("task_sync_id").agg(F.count(F.lit(1)).alias("_sets"), F.min("set_key").alias("set_key"), F.min("_rows").alias("_rows"))
    # Few sets make many pairs, so each is dealt out over its members; a given number of partitions is not merged by their size.
    parts = max(int(task_table.sparkSession.conf.get("spark.sql.shuffle.partitions")), task_table.sparkSession.sparkContext.defaultParallelism)
    dealt = objects.withColumn("_part", F.pmod(F.xxhash64("object_id"), F.lit(MEMBER_PARTS))).repartition(parts, "set_key", "_part")

    def pairs(tasks: DataFrame) -> DataFrame:
        every = tasks.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(MEMBER_PARTS - 1).cast("long")))).repartition(parts, "set_key", "_part")
        return every.join(dealt, ["set_key", "_part"]).select("task_sync_id", "object_id", (F.col("_rows") * F.col("_n")).alias("n"))

    single = pairs(sets_of.filter("_sets = 1").select("task_sync_id", "set_key", "_rows"))
    several = stored_if_any(found.join(sets_of.filter("_sets > 1").select("task_sync_id"), "task_sync_id", "left_semi"), "several-sets")
    if several is None:
        return single
    return single.unionByName(pairs(several).groupBy("task_sync_id", "object_id").agg(F.sum("n").alias("n")))


def tasks_per_parent(schedule: DataFrame) -> DataFrame:
    return schedule.groupBy(F.coalesce("parent_set", F.lit("")).alias("parent_set")).agg(F.count(F.lit(1)).alias("tasks"))


def preview(schedule: DataFrame, rows: int) -> DataFrame:
    return schedule.orderBy("seq").limit(rows)


def ordered_tasks(task_table: DataFrame, parent: str = "folder_path") -> DataFrame:
    return task_table.orderBy(F.coalesce(parent, F.lit("")), "seq")


def property_rows(matched: DataFrame, category: str) -> DataFrame:
    """Schedule fields of matched rows as property rows; only fields that carry a value."""
    rows = matched_only(matched)

    def text(name: str) -> Column:
        c = F.col(name) if name in rows.columns else F.lit(None).cast("string")
        if name.startswith(("planned", "actual")):
            return scheduling.iso_date(c)
        if name == "progress":
            return F.when(c > 0, c.cast("string"))
        return F.nullif(c.cast("string"), F.lit(""))

    days = scheduling.duration_days(F.col("planned_start"), F.col("planned_end"))
    values = {n: F.when(days > 0, days.cast("string")) if n == "duration" else text(n) for n in FIELD_NAMES}
    entries = F.array(
        *[F.struct(F.lit(i).alias("no"), F.lit(FIELD_NAMES[n]).alias("name"), v.alias("value")) for i, (n, v) in enumerate(values.items())]
    )
    if "custom" in rows.columns:
        extra = F.transform(
            F.map_entries(F.coalesce("custom", F.create_map().cast("map<string,string>"))),
            lambda e, i: F.struct((i + len(values)).alias("no"), e["key"].alias("name"), e["value"].alias("value")),
        )
        entries = F.concat(entries, extra)
    exploded = rows.select("matched_object_id", "seq", F.explode(entries).alias("e")).filter(F.col("e.value").isNotNull())
    return exploded.select(
        F.col("matched_object_id").alias("object_id"),
        F.lit(category).alias("category"),
        F.col("e.name").alias("property_name"),
        F.col("e.value").alias("property_value"),
        F.col("seq").alias("seq"),
        F.col("e.no").alias("no"),
    )


def last_number(properties: DataFrame, category: str) -> int:
    """The largest ``seq`` of the rows of other categories, 0 if there are none."""
    return remove_category(properties, category).agg(F.max("seq")).first()[0] or 0


def write_back(properties: DataFrame, matched: DataFrame, category: str, overwrite: bool = True, behind: int | None = None) -> DataFrame:
    """Property rows with the schedule fields written under ``category``.

    When two schedule rows hit one object the later one stands. Objects written to lose
    their old rows of the category, unless ``overwrite`` is off and they keep them. The new rows
    are numbered from ``behind`` on, by default behind all rows of other categories.
    """
    columns = [c for c in properties.columns if c in ("object_id", "category", "property_name", "property_value", "seq")]
    latest = matched_only(matched).groupBy("matched_object_id").agg(F.max("seq").alias("seq"))
    rows = property_rows(matched.join(latest, ["matched_object_id", "seq"], "left_semi"), category)
    # Schedule row and field together give the number, with room for the fields of the widest row.
    low, wide = rows.agg(F.min("seq"), F.max("no")).first()
    behind = last_number(properties, category) if behind is None else behind
    added = rows.withColumn("seq", behind + 1 + (F.col("seq") - (low or 0)) * ((wide or 0) + 1) + F.col("no"))
    written = latest.select(F.col("matched_object_id").alias("object_id"))
    old = F.col("category") == category
    base = properties.select(*columns)
    if overwrite:
        marks = written.withColumn("_w", F.lit(True))
        base = base.join(marks, "object_id", "left").filter(~(F.coalesce(old, F.lit(False)) & F.col("_w").isNotNull())).drop("_w")
    else:
        taken = base.filter(old).select("object_id").distinct()
        added = added.join(taken, "object_id", "left_anti")
    return base.unionByName(added.select(*columns))


def write_counts(matched: DataFrame, objects: DataFrame) -> DataFrame:
    """One row: rows in all, written, failed (object gone) and skipped (not matched)."""
    known = objects.select(F.col("object_id").alias("matched_object_id")).distinct().withColumn("_known", F.lit(True))
    hit = F.col("match_status") == MatchStatus.MATCHED
    return matched.join(known, "matched_object_id", "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(hit & F.col("_known").isNotNull()).alias("succeeded"),
        F.count_if(hit & F.col("_known").isNull()).alias("failed"),
        F.count_if(~hit).alias("skipped"),
    )


def remove_category(properties: DataFrame, category: str) -> DataFrame:
    return properties.filter(~F.coalesce(F.col("category") == category, F.lit(False)))


def generate(
    properties: DataFrame,
    *,
    start: str,
    days: int,
    prefix: str,
    task_type: str = "Construct",
    date_mode: str = "actual_from_planned",
    strategy: str = "level",
    level_cap: int = 3,
    custom: str = "",
    first_row_only: bool = False,
) -> DataFrame:
    """Sequential schedule over the selected objects: object k starts at start + (k-1)·days.

    ``first_row_only`` looks up parent-set properties in the first row of each object only.
    """
    wanted = [
        ("Element", "Level"), ("Item", "Level"), ("Element", "층"), ("Element", "Category"), ("Item", "Type"),
        ("Element", "Area"), ("Element", "Zone"), ("Element", "구역"), ("Element", "공구"),
    ]

    def found(category: str, name: str) -> Column:
        test = (F.lower("category") == category.lower()) & (F.lower("property_name") == name.lower())
        return F.when(test, F.col("property_value"))

    identity = F.struct("seq", "level", "display_name", "sys_path")
    values = [
        (F.min_by(found(c, n), "seq") if first_row_only else F.min_by(found(c, n), F.when(found(c, n).isNotNull(), F.col("seq")))).alias(f"_v{i}")
        for i, (c, n) in enumerate(wanted)
    ]
    objects = properties.groupBy("object_id").agg(F.min_by(identity, "seq").alias("_i"), *values).select(
        "object_id", "_i.*", *[f"_v{i}" for i in range(len(wanted))]
    )
    parent = scheduling.parent_set(
        strategy,
        level=F.col("level"),
        display_name=F.col("display_name"),
        sys_path=F.col("sys_path"),
        values={pair: F.col(f"_v{i}") for i, pair in enumerate(wanted)},
        level_cap=level_cap,
        custom=custom,
    )
    numbered = global_row_number(
        objects.select("object_id", "display_name", "seq", parent.alias("parent_set")), [F.col("seq"), F.col("object_id")], "task_no"
    )
    begin = F.date_add(F.lit(start).cast("date"), ((F.col("task_no") - 1) * days).cast("int"))
    rows = numbered.withColumns({"planned_start": begin, "planned_end": F.date_add(begin, days)})
    actual_start, actual_end = scheduling.actual_dates(date_mode, F.col("planned_start"), F.col("planned_end"))
    return rows.select(
        F.col("object_id").alias("sync_id"),
        F.concat(F.lit(f"{prefix} "), F.col("task_no").cast("string")).alias("task_name"),
        "planned_start",
        "planned_end",
        actual_start.alias("actual_start"),
        actual_end.alias("actual_end"),
        scheduling.task_type_to_english(F.lit(task_type)).alias("task_type"),
        "parent_set",
        F.lit(0.0).alias("progress"),
        F.col("display_name").alias("original_name"),
        F.col("task_no").alias("seq"),
    )


def generation_totals(generated: DataFrame, days: int) -> DataFrame:
    return generated.agg(F.count(F.lit(1)).alias("selected"), (F.count(F.lit(1)) * days).alias("total_days"))


def geometry_with_schedule(geometry: DataFrame, matched: DataFrame) -> DataFrame:
    """Matched and dated schedule rows with the centroid of their object, by planned start."""
    centre = Box.of().centroid()
    points = geometry.select(
        F.col("object_id").alias("matched_object_id"),
        *[c.alias(f"centroid_{a}") for a, c in zip("xyz", centre.axes())],
    )
    return (
        dated_only(matched).select("matched_object_id", "task_name", "planned_start")
        .join(points, "matched_object_id")
        .orderBy("planned_start", "matched_object_id")
    )


def clear_root(table: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Rows outside the root folder, and a one-row count of those removed."""
    own = F.coalesce(F.col("root_folder") == root, F.lit(False))
    return table.filter(~own), table.agg(F.count_if(own).alias("deleted"))
