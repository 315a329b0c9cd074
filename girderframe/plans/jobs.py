"""Composite jobs: each returns named DataFrames; writing them is separate."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girderframe.operators import graph, props, quality, schedule as sched, spatial, triples, unified, validation
from girderframe.operators.tree import descendants
from girderframe.schema import ScheduleOptions
from girderframe.session import stored
from girderframe.sources.schedule_csv import check_schedule


class Frames(Mapping[str, DataFrame]):
    """Frames of a job by name; each is made when it is first asked for, so a caller pays for what it takes."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers = makers
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def spatial_job(geometry: DataFrame, tolerance: float | None = None, edges_from: DataFrame | None = None) -> Frames:
    """Edges, groups, degrees, statistics and summary; ``edges_from`` limits the boxes that get edges.

    Only ``edges`` makes edges, and it stores none of them: groups come from the cells, counts from ``degrees``.
    """
    boxes = geometry if edges_from is None else edges_from
    out = Frames(
        edges=lambda: spatial.adjacency(boxes, tolerance),
        groups=lambda: graph.number_groups(spatial.component_labels(boxes, tolerance, geometry)),
        degrees=lambda: stored(spatial.edge_counts(boxes, tolerance), "degrees"),
        statistics=lambda: graph.group_statistics(out["groups"], geometry, degrees=out["degrees"]),
        summary=lambda: graph.spatial_summary(None, out["groups"], out["degrees"]),
    )
    return out


def selection_spatial_job(geometry: DataFrame, nodes: DataFrame, seeds: DataFrame, tolerance: float | None = None) -> Frames:
    """The spatial job over the subtrees of the selected objects."""
    chosen = descendants(nodes, seeds).select("object_id").distinct()
    return spatial_job(stored(geometry.join(chosen, "object_id", "left_semi"), "selection"), tolerance)


def full_export(
    properties: DataFrame,
    geometry: DataFrame,
    links: DataFrame,
    node_info: DataFrame,
    diagnostics: DataFrame,
    supplemented: bool = False,
) -> Frames:
    """Containers, mesh quality, unified objects, leaf adjacency, groups, triples and verdicts.

    Groups cover all boxes while edges join leaves only, so containers stay single.
    """
    container_table = stored(validation.containers(links, geometry), "containers")
    meshed = stored(validation.with_mesh_quality(geometry, diagnostics, container_table, supplemented), "geometry")
    leaves = props.leaf_geometry(meshed)
    space = spatial_job(meshed, edges_from=leaves)

    def named_edges() -> DataFrame:
        return spatial.adjacency(leaves.withColumn("uri", triples.object_uri(F.col("object_id"))), carried=("uri",))

    out = Frames(
        containers=lambda: container_table,
        geometry=lambda: meshed,
        unified=lambda: unified.merge(properties, meshed),
        **{name: partial(space.__getitem__, name) for name in space},
        geometry_triples=lambda: triples.geometry_triples(meshed),
        spatial_triples=lambda: triples.edge_triples(named_edges()).unionByName(triples.group_triples(out["statistics"], out["groups"])),
        validation=lambda: validation.validate_objects(
            meshed, node_info, properties, container_table, out["degrees"].select("object_id", "adjacency_count"), out["groups"]
        ),
        verdicts=lambda: validation.verdict_counts(out["validation"]),
    )
    return out


# Codes of findings.
DATA_WARNING, LOW_MATCH_RATE, NO_ROWS, BAD_OPTION = 100, 202, 301, 600
# Errors whose messages a stopped run lists; all of them are in its findings.
SHOWN_ERRORS = 20


@dataclass
class ScheduleRun:
    """Outcome of a schedule job: frames by name, and why it stopped early, if it did."""

    frames: dict[str, DataFrame] = field(default_factory=dict)
    success: bool = True
    stopped_at: str = ""
    messages: list[str] = field(default_factory=list)


def pre_checks(schedule: DataFrame, options: ScheduleOptions) -> DataFrame:
    """Findings (code, severity, message, item) before a run: options, counts, duplicates, dates."""
    spark = schedule.sparkSession
    schema = "code int, severity string, message string, item string"
    out = spark.createDataFrame([(BAD_OPTION, "error", m, "") for m in options.errors()], schema)
    totals = sched.date_checks(schedule)
    empty = totals.filter("total = 0").select(F.lit(NO_ROWS).alias("code"), F.lit("error").alias("severity"), F.lit("no valid schedule rows").alias("message"), F.lit("").alias("item"))
    late = totals.filter("start_after_end > 0").select(
        F.lit(DATA_WARNING).alias("code"), F.lit("warning").alias("severity"),
        F.concat(F.lit("start after end: "), F.col("start_after_end").cast("string")).alias("message"), F.lit("").alias("item"),
    )
    doubled = sched.duplicate_sync_ids(schedule).select(
        F.lit(DATA_WARNING).alias("code"), F.lit("warning").alias("severity"),
        F.concat(F.lit("duplicate sync id, rows: "), F.col("n").cast("string")).alias("message"), F.col("sync_id").alias("item"),
    )
    return out.unionByName(empty).unionByName(late).unionByName(doubled).unionByName(check_schedule(schedule))


def post_checks(
    match_totals: DataFrame, write_counts: DataFrame | None, task_totals: DataFrame | None, options: ScheduleOptions, set_totals: DataFrame | None = None
) -> DataFrame:
    """Findings after a run from the one-row totals of its stages, with the success rate."""

    def note(df: DataFrame, test, code: int, severity: str, message) -> DataFrame:
        return df.filter(test).select(
            F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), F.lit("").alias("item")
        )

    def count_text(label: str, column: str):
        return F.concat(F.lit(f"{label}: "), F.col(column).cast("string"))

    out = note(
        match_totals, F.col("match_rate") < options.min_match_rate, LOW_MATCH_RATE, "warning",
        F.concat(F.lit("match rate below target: "), F.format_string("%.1f%%", "match_rate")),
    ).unionByName(note(match_totals, F.col("not_found") > 0, 0, "info", count_text("not matched", "not_found")))
    if write_counts is not None:
        rate = F.coalesce(F.try_divide(F.col("succeeded") * 100.0, F.col("total")), F.lit(0.0))
        out = out.unionByName(note(write_counts, F.col("failed") > 0, DATA_WARNING, "warning", count_text("property rows failed", "failed")))
        share = F.concat(F.col("succeeded").cast("string"), F.lit("/"), F.col("total").cast("string"))
        out = out.unionByName(note(write_counts, F.lit(True), 0, "info", F.concat(F.lit("property rows written: "), share)))
        overall = F.concat(F.lit("overall success: "), F.format_string("%.1f%%", rate), F.lit(" ("), share, F.lit(")"))
        out = out.unionByName(note(write_counts, F.col("total") > 0, 0, "info", overall))
    if set_totals is not None:
        made = F.concat(F.lit("sets: "), F.col("set_count").cast("string"), F.lit(", objects: "), F.col("item_count").cast("string"))
        out = out.unionByName(note(set_totals, F.lit(True), 0, "info", made))
    if task_totals is not None:
        out = out.unionByName(note(task_totals, F.col("unlinked") > 0, DATA_WARNING, "warning", count_text("tasks without objects", "unlinked")))
        made = F.concat(F.lit("tasks: "), F.col("total").cast("string"), F.lit(", linked: "), F.col("linked").cast("string"))
        out = out.unionByName(note(task_totals, F.lit(True), 0, "info", made))
    return out


def finding_lines(findings: DataFrame, errors: int = 5, warnings: int = 3) -> DataFrame:
    """(line_no, line): number of errors and the first few, the rest as a count, then the same for warnings.

    The first few are a report; all findings stay in ``findings``.
    """
    out = None
    for place, (severity, label, top) in enumerate([("error", "errors", errors), ("warning", "warnings", warnings)]):
        own = findings.filter(F.col("severity") == severity)
        total = own.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
        head = total.select(F.lit(place * 1000).alias("line_no"), F.concat(F.lit(f"{label}: "), F.col("n").cast("string")).alias("line"))
        first = own.orderBy("code", "item", "message").limit(top).agg(F.array_sort(F.collect_list(F.struct("code", "item", "message"))).alias("f"))
        text = F.concat(F.lit("  - ["), F.col("x.code").cast("string"), F.lit("] "), F.col("x.message"))
        listed = first.select(F.posexplode("f").alias("k", "x")).select((F.lit(place * 1000 + 1) + F.col("k")).alias("line_no"), text.alias("line"))
        rest = total.filter(F.col("n") > top).select(F.lit(place * 1000 + 999).alias("line_no"), F.concat(F.lit("  ... "), (F.col("n") - top).cast("string"), F.lit(" more")).alias("line"))
        part = head.unionByName(listed).unionByName(rest)
        out = part if out is None else out.unionByName(part)
    return out


def schedule_job(
    schedule: DataFrame,
    properties: DataFrame,
    options: ScheduleOptions = ScheduleOptions(),
    direct: bool = False,
) -> ScheduleRun:
    """Checks, matching, rate gate, property rows, sets and tasks.

    A dry run stops after matching. The gate is one small action on the driver. With
    ``direct`` the sync ids are object ids, as in generated schedules.
    """
    run = ScheduleRun()
    objects = props.object_ids(properties)
    if options.pre_checks:
        findings = pre_checks(schedule, options)
        run.frames["pre_checks"] = findings
        errors = findings.filter("severity = 'error'")
        found = errors.count()
        if found:
            run.success, run.stopped_at = False, "pre_checks"
            shown = errors.orderBy("code", "item", "message").limit(SHOWN_ERRORS).collect()
            run.messages = [r["message"] for r in shown]
            if found > len(shown):
                run.messages.append(f"and {found - len(shown)} more, see pre_checks")
            return run
    matched = sched.match_direct(schedule, objects) if direct else sched.match(schedule, properties, options)
    matched = stored(matched, "matched")
    totals = sched.match_totals(matched, options.min_match_rate)
    run.frames |= {"matched": matched, "match_totals": totals}
    gate = totals.collect()[0]
    if not gate["passes"]:
        run.messages.append(f"match rate {gate['match_rate']:.1f} is below {options.min_match_rate}")
        if not options.continue_on_error:
            run.success, run.stopped_at = False, "matching"
            return run
    if options.dry_run:
        run.stopped_at = "dry_run"
        return run
    counts = None
    if options.enable_property_write:
        counts = sched.write_counts(matched, objects)
        run.frames["properties"] = sched.write_back(properties, matched, options.property_category, options.overwrite_existing)
        run.frames["write_counts"] = counts
    links = matched.select("sync_id", "seq", F.lit(None).cast("string").alias("set_key"), F.lit(None).cast("string").alias("set_name"), F.lit(0).cast("bigint").alias("item_count"))
    if options.enable_sets:
        set_table = sched.sets(matched, objects, options.grouping, options.skip_empty_sets)
        links = sched.set_links(matched, set_table, options.grouping)
        run.frames |= {"sets": set_table, "set_members": sched.set_members(sched.matched_only(matched), options.grouping), "set_totals": sched.set_totals(set_table)}
    summary = None
    if options.enable_tasks:
        task_table = sched.tasks(matched, links, objects, options)
        summary = sched.task_totals(task_table)
        run.frames |= {"tasks": task_table, "task_folders": sched.task_folders(task_table), "task_totals": summary}
    if options.post_checks:
        run.frames["post_checks"] = post_checks(totals, counts, summary, options, run.frames.get("set_totals"))
    return run


def generated_schedule_job(properties: DataFrame, options: ScheduleOptions, **generation) -> ScheduleRun:
    """Generate a schedule from the objects of ``properties`` and run it directly."""
    generated = stored(sched.generate(properties, **generation), "generated")
    run = schedule_job(generated, properties, options.with_changes(link_mode="explicit"), direct=True)
    run.frames["schedule"] = generated
    return run


def quality_job(properties: DataFrame, required: dict[str, list[str]] = quality.REQUIRED_PROPERTIES) -> dict[str, DataFrame]:
    return {"issues": quality.all_issues(properties, required), "report": quality.report(properties, required)}


def mesh_diagnostics_job(diagnostics: DataFrame) -> dict[str, DataFrame]:
    """Status of every leaf, the summary per class and the classes that fail most."""
    rows = validation.with_mesh_status(diagnostics).filter("is_leaf")
    summary = validation.class_summary(diagnostics)
    return {"diagnostics": rows, "summary": summary, "failing": validation.failing_classes(summary)}


def clear_outputs(sets: DataFrame, tasks: DataFrame, options: ScheduleOptions) -> dict[str, DataFrame]:
    """Sets and tasks outside the run's root folders, with the numbers removed."""
    kept_sets, deleted_sets = sched.clear_root(sets, options.set_root)
    kept_tasks, deleted_tasks = sched.clear_root(tasks, options.task_root)
    return {"sets": kept_sets, "deleted_sets": deleted_sets, "tasks": kept_tasks, "deleted_tasks": deleted_tasks}
