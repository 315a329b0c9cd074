"""Headline queries, warm, median of the runs; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from girderframe.functions.display import with_parsed  # noqa: E402
from girderframe.operators import graph, precedence, props, quality, schedule, spatial, tree, unified  # noqa: E402
from girderframe.session import build_session, stored  # noqa: E402
from girderframe.sources.fixtures import Fixtures  # noqa: E402

TOLERANCE = 0.15


def consume(df) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    fx = Fixtures(spark, folder)
    # Inputs as stored tables, the way a model would be kept; the views themselves are not timed.
    records = stored(fx("fx_records"), "records")
    geometry = stored(fx("fx_geometry"), "geometry")
    plan = stored(fx("fx_schedule"), "schedule")
    parsed = stored(with_parsed(records), "parsed")
    nodes = stored(fx("fx_nodes"), "nodes")
    plan_names, object_names = stored(fx("fx_score_schedule"), "plan_names"), stored(fx("fx_score_objects"), "object_names")
    edges = stored(spatial.adjacency(geometry, TOLERANCE), "edges")

    queries = {
        "display_parse": lambda: consume(with_parsed(records)),
        "group_objects": lambda: consume(props.group_objects(records)),
        "unified_merge": lambda: consume(unified.merge(parsed, geometry)),
        "grid_adjacency": lambda: consume(spatial.adjacency(geometry, TOLERANCE)),
        "connected_components": lambda: consume(graph.components(edges, geometry)),
        "schedule_match": lambda: consume(schedule.match(plan, parsed)),
        "quality_report": lambda: consume(quality.report(parsed)),
        "tree_walk": lambda: consume(tree.walk(nodes)),
        "five_way_filter": lambda: consume(props.filter_rows(records, level=3, path="Customer", category="Item", name="type", value="urgent")),
        "scored_match": lambda: consume(precedence.scored_matches(plan_names, object_names)),
    }
    seconds = {}
    for name, run in queries.items():
        run()
        taken = []
        for _ in range(runs):
            began = time.perf_counter()
            run()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "spark": spark.version,
                "cpus": int(cpus),
                "shuffle_partitions": int(cpus),
                "rows": {"properties": records.count(), "boxes": geometry.count(), "schedule": plan.count()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
