"""Walks by path doubling, files of a folder by themselves, wide blocks, table updates, index, layouts and streams."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from girderframe.operators import precedence, props, schedule as sched, text_index, tree, triples, unified
from girderframe.session import run_tables, stored
from girderframe.sinks import updates, writers
from girderframe.sources import clustered, schedule_csv as sc
from girderframe.streaming import debounce as deb

NODES = "object_id string, parent_id string, display_name string, is_hidden boolean"


# --- stored tables -------------------------------------------------------------------------


def test_tables_of_a_run_go_at_its_end(spark):
    with run_tables(spark) as keep:
        inner = stored(spark.range(3).toDF("n"), "inner")
        kept = keep(inner.withColumn("twice", F.col("n") * 2), "kept")
        [path] = {f.rsplit("/", 1)[0].removeprefix("file://") for f in inner.inputFiles()}
        assert Path(path).exists()
    assert not Path(path).parent.exists()
    assert sorted(r["twice"] for r in kept.collect()) == [0, 2, 4]


# --- tree ----------------------------------------------------------------------------------


def walk_of(rows, seeds=None, skip=False, separator=" > "):
    """(object, root, level, path) by stepping down from every start."""
    visible = [r for r in rows if not r[3]]
    children = {}
    for r in visible:
        children.setdefault(r[1], []).append(r)
    out = []

    def joined(above, name):
        if skip and not name:
            return above
        return name if above == "" else above + separator + name

    def down(r, root, level, path):
        out.append((r[0], root, level, path))
        for c in children.get(r[0], []):
            down(c, root, level + 1, joined(path, c[2] or ""))

    for r in visible:
        if (r[0] in seeds) if seeds is not None else (r[1] in (None, "")):
            down(r, r[0], 0, r[2] or "")
    return Counter(out)


@pytest.mark.parametrize("skip", [False, True])
@pytest.mark.parametrize("seeded", [False, True])
def test_walk_equals_stepping_down(spark, skip, seeded):
    rng = random.Random(11)
    rows = [("n0", None, "Root", False), ("lost", "nowhere", "L", False), ("child of lost", "lost", "C", False)]
    for k in range(1, 160):
        parent = f"n{rng.randint(max(0, k - 6), k - 1)}" if rng.random() < 0.97 else rng.choice(["", None])
        rows.append((f"n{k}", parent, rng.choice(["A", "B", "", None, "C > D"]), rng.random() < 0.06))
    seeds = ["n0", "n3", "n20", "n21", "n40", "lost", "absent", "n159"] if seeded else None
    nodes = spark.createDataFrame(rows, NODES)
    found = tree.walk(nodes, None if seeds is None else spark.createDataFrame([(s,) for s in seeds], "object_id string"), skip_empty_names=skip)
    assert Counter((r["object_id"], r["root_id"], r["level"], r["path"]) for r in found.collect()) == walk_of(rows, seeds, skip)


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    """A chain of 300 nodes takes ten writes, where steps from level to level took 300."""
    writes = []
    counting = tree.stored_counting
    monkeypatch.setattr(tree, "stored_counting", lambda *a: writes.append(a[1]) or counting(*a))
    depth = 300
    rows = [(f"n{k}", f"n{k - 1}" if k else "", f"N{k}", False) for k in range(depth)]
    last = tree.walk(spark.createDataFrame(rows, NODES)).filter("level = 299").first()
    assert last["path"] == " > ".join(f"N{k}" for k in range(depth))
    assert writes.count("ways") <= 11


def test_cycles_that_no_start_reaches_are_left_out(spark):
    rows = [("r", "", "R", False), ("a", "r", "A", False), ("x", "y", "X", False), ("y", "x", "Y", False), ("z", "x", "Z", False)]
    assert sorted(r["object_id"] for r in tree.walk(spark.createDataFrame(rows, NODES)).collect()) == ["a", "r"]
    with pytest.raises(ValueError):
        tree.walk(spark.createDataFrame(rows, NODES), spark.createDataFrame([("y",)], "object_id string"))
    assert tree.walk(spark.createDataFrame([], NODES)).count() == 0


# --- scored match --------------------------------------------------------------------------


def test_hot_blocks_are_split_without_loss(spark, fx):
    """One token that all names hold: the same matches whether blocks are split or not."""
    plan = fx("fx_score_schedule").limit(300).withColumn("name", F.concat(F.lit("Pump "), (F.col("row_id") % 5).cast("string")))
    objects = fx("fx_score_objects").limit(300).withColumn("name", F.concat(F.lit("Pump "), F.length("object_id").cast("string"), F.lit(" B")))
    whole = sorted(map(tuple, precedence.scored_matches(plan, objects).collect()))
    split = sorted(map(tuple, precedence.scored_matches(plan, objects, block_pairs=1, part_rows=2).collect()))
    assert whole == split and whole


def test_common_tokens_form_no_pairs_of_single_rows(spark):
    """Names that share common words alone meet by outline: far fewer candidates than rows squared, and the same matches as brute force."""
    plan = spark.range(600).select(F.col("id").alias("row_id"), F.lit("L").alias("level_name"), F.lit("C").alias("category"), F.lit("P").alias("path"), F.concat(F.lit("Pump Hall Unit "), (F.col("id") * 7).cast("string")).alias("name"))
    objects = plan.select(F.format_string("o%04d", "row_id").alias("object_id"), "level_name", "category", F.lit("Q").alias("path"), F.concat(F.lit("Pump Hall Unit "), F.col("row_id").cast("string")).alias("name"))
    found = {r["row_id"]: (r["object_id"], r["score"]) for r in precedence.scored_matches(plan, objects).collect()}
    # Three shared words of five are 0.6, just enough; an equal number is better.
    assert found == {k: (f"o{7 * k:04d}", 0.8) if 7 * k < 600 else ("o0000", 0.7) for k in range(600)}
    names = precedence._described(plan, "row_id", {"pump": 1200, "hall": 1200, "unit": 1200})
    rare = precedence._in_blocks(names, "row_id", "a", [(["level_name", "category"], 0.6)], "rare")
    assert rare.groupBy("block").count().agg(F.max("count")).first()[0] == 1
    assert names.select(*precedence._OUTLINE).distinct().count() == 1


def test_cells_of_a_wide_export_are_read_in_one_plan(spark, tmp_path):
    rows = [("a", "", 1, "A,1", "C", f"P{k:02d}", f'v"{k},', k) for k in range(25)] + [("b", "", 1, "B", "C", "P07", "w", 99), ("b", "", 1, "B", "C", "P08", "", 100)]
    frame = spark.createDataFrame(rows, "object_id string, parent_id string, level int, display_name string, category string, property_name string, property_value string, seq long")
    path = str(tmp_path / "w")
    assert writers.write_wide(frame, path, 2) == 13
    cells = writers.read_wide_cells(spark, path)
    assert sorted(map(tuple, cells.collect())) == sorted([("a", f"C|P{k:02d}", f'v"{k},') for k in range(25)] + [("b", "C|P07", "w")])
    assert cells._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2


def test_common_tokens_come_last(spark):
    names = spark.createDataFrame([(f"Pump north {k}",) for k in range(300)] + [("Pump",)] * 30, "name string")
    common = precedence.common_tokens(names)
    assert common == {"pump": 330, "north": 300}
    row = spark.createDataFrame([("North PUMP zz-pump a",)], "name string").select(precedence.rarest_first(F.col("name"), common)).first()
    assert row[0] == ["a", "zz", "north", "pump"]


# --- files of a folder ---------------------------------------------------------------------


def folder_of(tmp_path, files):
    folder = tmp_path / "folder"
    folder.mkdir()
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return str(folder)


def test_files_differ_in_encoding_and_order(spark, tmp_path):
    path = folder_of(tmp_path, {"a.csv": "id,name\n1,기초\n".encode(), "b.csv": "name,id\n공사,2\nid,name\n".encode("euc-kr"), "c.csv": "\r\n id , name\r\n3,plain\r\n".encode("utf-8-sig")})
    got = sorted((r["id"], r["name"]) for r in sc.read_table(spark, path).collect())
    # The last line of the second file is a row, though it reads like the first file's header.
    assert got == sorted([("1", "기초"), ("2", "공사"), ("name", "id"), ("3", "plain")])


@pytest.mark.parametrize("codec", ["utf-16-le", "utf-16-be"])
def test_utf16_files(spark, tmp_path, codec):
    mark = b"\xff\xfe" if codec.endswith("le") else b"\xfe\xff"
    path = folder_of(tmp_path, {"a.csv": mark + "id,name\r\n1,기초 공사\r\n2,x\r\n".encode(codec), "b.csv": b"id,name\n3,plain\n"})
    facts = sc.file_facts(spark, path)
    assert [(f.encoding, f.cells) for f in facts] == [("UTF-16LE" if codec.endswith("le") else "UTF-16BE", ("id", "name")), ("UTF-8", ("id", "name"))]
    assert sorted((r["id"], r["name"]) for r in sc.read_table(spark, path).collect()) == [("1", "기초 공사"), ("2", "x"), ("3", "plain")]


def test_own_headers_and_odd_file_names(spark, tmp_path):
    path = folder_of(tmp_path, {"a [1].csv": b"id,x\n1,2\n", "b+c 100%.csv": b"id,y\n3,4\n", "empty.csv": b""})
    got = sorted(map(tuple, sc.read_table(spark, path, own_headers=True).select("id", "x", "y").collect()))
    assert got == [("1", "2", None), ("3", None, "4")]


def test_repeated_header_rows_inside_a_file_stay(spark, tmp_path):
    path = folder_of(tmp_path, {"a.csv": b"a,b\n1,2\na,b\n3,4\n"})
    assert sorted(map(tuple, sc.read_table(spark, path).collect())) == [("1", "2"), ("3", "4"), ("a", "b")]


def test_schedules_with_headers_in_two_languages(spark, tmp_path):
    path = folder_of(tmp_path, {"a.csv": "SyncID,TaskName,Crew\na,One,x\n".encode(), "b.csv": "작업명,동기화ID\n둘,b\n".encode("euc-kr")})
    rows = {r["sync_id"]: (r["task_name"], r["custom"]) for r in sc.read_schedule(spark, path).collect()}
    assert rows == {"a": ("One", {"Crew": "x"}), "b": ("둘", {})}


# --- wide form -----------------------------------------------------------------------------


def test_wide_blocks_of_any_width(spark, tmp_path):
    rng = random.Random(3)
    rows, seq, want = [], 0, {}
    for o in range(7):
        for _ in range(40):
            seq += 1
            name, value = f"P{rng.randint(0, 24):02d}`.x", f"v{seq}"
            rows.append((f"o{o}", "", 1, f"Part {o}", "Cat" if seq % 2 else None, name, value, seq))
            want[f"o{o}", ("Cat" if seq % 2 else "") + "|" + name] = value
    frame = spark.createDataFrame(rows, "object_id string, parent_id string, level int, display_name string, category string, property_name string, property_value string, seq long")
    keys = sorted({k for _, k in want})
    for width in (3, 1000):
        path = str(tmp_path / f"wide{width}")
        assert writers.write_wide(frame, path, width) == -(-len(keys) // width)
        blocks = writers.read_wide(spark, path)
        assert [k for names, _ in blocks for k in names] == keys
        got = {}
        for names, block in blocks:
            collected = block.collect()
            assert sorted(r["object_id"] for r in collected) == [f"o{o}" for o in range(7)]
            at = len(block.columns) - len(names)
            got |= {(r["object_id"], n): r[at + k] for r in collected for k, n in enumerate(names) if r[at + k]}
        assert got == want
        assert blocks[0][1].columns[:4] == ["object_id", "parent_id", "level", "display_name"]


def test_wide_form_without_properties(spark, tmp_path):
    none = spark.createDataFrame([], "object_id string, parent_id string, level int, display_name string, category string, property_name string, property_value string, seq long")
    assert writers.write_wide(none, str(tmp_path / "w")) == 1
    assert json.loads("".join(p.read_text() for p in Path(tmp_path / "w/manifest").glob("part-*")))["columns"] == []


def test_headers_fit_the_lines(spark, tmp_path):
    rows = [("o,1", "p", 2, 'say "x"', "A,b", "n", "v,1", 1), ("o2", "p", 2, None, "A,b", "m", None, 2)]
    frame = spark.createDataFrame(rows, "object_id string, parent_id string, level int, display_name string, category string, property_name string, property_value string, seq long")
    writers.write_wide(frame, str(tmp_path / "w"), 1)
    text = lambda folder: sorted(line for p in (tmp_path / "w" / folder).glob("part-*") for line in p.read_text().splitlines())
    assert text("headers/block=0") == ['object_id,parent_id,level,display_name,"A,b|m"'] and text("headers/block=1") == ['object_id,"A,b|n"']
    assert text("rows/block=0") == ['"o,1",p,2,"say ""x""",', "o2,p,2,,"] and text("rows/block=1") == ['"o,1","v,1"', "o2,"]


# --- table updates -------------------------------------------------------------------------


PROPERTY = "object_id string, category string, property_name string, property_value string, seq long"


def test_updates_touch_their_bucket_alone(spark, tmp_path):
    rows = [(f"o{k}", ["Item", "Plan", "Other", None][k % 4], "n", str(k), k) for k in range(40)]
    table = updates.create_table(spark.createDataFrame(rows, PROPERTY), str(tmp_path / "t"), "category", 16)
    bucket = table.bucket_of(spark, "Plan")
    others = [p for p in sorted(Path(table.path).glob("_bucket=*/part-*")) if f"_bucket={bucket}/" not in str(p)]
    before = {p: p.stat().st_mtime_ns for p in others}
    assert updates.remove_category(table, spark, "Plan") == 10
    assert updates.remove_category(table, spark, "Plan") == 0
    assert {p: p.stat().st_mtime_ns for p in others} == before
    assert sorted(r["seq"] for r in table.read(spark).collect()) == [k for k in range(40) if k % 4 != 1]
    with pytest.raises(ValueError):
        updates.clear_root(table, spark, "x")


def test_an_emptied_bucket_is_gone(spark, tmp_path):
    rows = spark.createDataFrame([("a", "root", 1), ("b", "other", 2)], "id string, root_folder string, n int")
    table = updates.create_table(rows, str(tmp_path / "t"), "root_folder", 64)
    assert [updates.clear_root(table, spark, r) for r in ("root", "root", "other")] == [1, 0, 1]
    assert table.read(spark).count() == 0


def test_written_rows_get_new_numbers(spark):
    """Numbers of written rows collide with none, also with many custom fields."""
    properties = spark.createDataFrame([(f"o{k}", "Item", "n", "v", 1000 * k + k) for k in range(5)], PROPERTY)
    matched = spark.createDataFrame(
        [("Matched", f"o{k}", f"s{k}", "task", k, {f"c{i}": "x" for i in range(30)}) for k in range(5)],
        "match_status string, matched_object_id string, sync_id string, task_name string, seq long, custom map<string,string>",
    ).withColumns({n: F.lit(None).cast("date") for n in ("planned_start", "planned_end")})
    out = sched.write_back(properties, matched, "Plan").collect()
    assert len(out) == 5 + 5 * 32 and len({r["seq"] for r in out}) == len(out)
    assert min(r["seq"] for r in out if r["category"] == "Plan") > max(r["seq"] for r in out if r["category"] == "Item")


def test_merged_triples_add_nothing_twice(spark, fx, tmp_path):
    rows = triples.geometry_triples(fx("fx_mesh_geometry").limit(20))
    path = str(tmp_path / "ttl")
    total = rows.distinct().count()
    assert writers.merge_turtle(rows.limit(30), path, {"bso": "http://example.org/bso#"}) <= 30
    added = writers.merge_turtle(rows, path, {"bso": "http://example.org/bso#"})
    assert writers.merge_turtle(rows, path, {"bso": "http://example.org/bso#"}) == 0 < added
    lines = [line for p in Path(path).glob("triples/_bucket=*/part-*") for line in p.read_text().splitlines()]
    assert len(lines) == len(set(lines)) == total


# --- text index ----------------------------------------------------------------------------


def test_indexed_search_equals_the_plain_one(spark, fx, tmp_path):
    rows = fx("fx_records").limit(2000).withColumn("sys_path", F.when(F.col("seq") % 3 != 0, F.col("sys_path")))
    text_index.build(rows, "seq", ["display_name", "property_value", "property_name", "sys_path"], str(tmp_path / "i"), files=4)
    for query in ("Element 1", "ELEMENT", "zz", "1", "no such text", "m", "asia > "):
        found = text_index.search(spark, str(tmp_path / "i"), query)
        assert sorted(r["key"] for r in found.rows.collect()) == sorted(r["seq"] for r in props.search(rows, query).collect())
        assert found.texts <= found.candidates
    exact = text_index.lookup(spark, str(tmp_path / "i"), "Length", "property_name")
    assert exact.rows.count() == rows.filter("property_name = 'Length'").count() and exact.candidates == 1


def test_indexed_search_reads_few_postings(spark, fx, tmp_path):
    text_index.build(fx("fx_records"), "seq", ["display_name", "property_value"], str(tmp_path / "i"), files=16)
    found = text_index.search(spark, str(tmp_path / "i"), "Element 1499")
    texts = spark.read.parquet(str(tmp_path / "i/texts")).count()
    assert found.candidates * 50 < texts


def test_index_postings_of_blocks_count_their_texts(spark, tmp_path):
    """Texts that follow each other share their postings; the counts of trigrams are those of the texts."""
    said = [f"Straße {k} ÄÖ" for k in range(1000)] + ["aaaa", "AAAA", "ab", "", None]
    rows = spark.createDataFrame(list(enumerate(said)), "seq long, said string")
    text_index.build(rows, "seq", ["said"], str(tmp_path / "i"))
    counts = {r["gram"]: r["texts"] for r in spark.read.parquet(str(tmp_path / "i/grams")).collect()}
    want = Counter(g for text in said if text for g in {text.lower()[k : k + 3] for k in range(len(text) - 2)})
    assert counts == want
    assert spark.read.parquet(str(tmp_path / "i/postings")).count() * 3 < sum(counts.values())
    for asked in ("aaa", "straße 99", "äö", "ab", ""):
        found = text_index.search(spark, str(tmp_path / "i"), asked)
        assert sorted(r["key"] for r in found.rows.collect()) == [k for k, text in enumerate(said) if text is not None and asked in text.lower()]


def test_index_lookups_agree_however_many_keys(spark, fx, tmp_path, monkeypatch):
    rows = fx("fx_records").limit(3000)
    text_index.build(rows, "seq", ["display_name", "property_value"], str(tmp_path / "i"))
    want = sorted(r["seq"] for r in rows.filter("contains(lower(display_name), 'ment 1') OR contains(lower(property_value), 'ment 1')").collect())
    for few, many in ((10**6, 10**6), (0, 10**6), (0, 0)):
        monkeypatch.setattr(text_index, "FEW", few)
        monkeypatch.setattr(text_index, "MANY", many)
        assert sorted(r["key"] for r in text_index.search(spark, str(tmp_path / "i"), "Ment 1").rows.collect()) == want


# --- layouts -------------------------------------------------------------------------------


def scanned_rows(df):
    """Rows that the file scan handed on, after row groups were skipped."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if node.nodeName().startswith(("Scan", "ColumnarToRow")) and node.children().isEmpty():
            total += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return total


def test_windows_skip_boxes_far_away(spark, fx, tmp_path):
    geometry = fx("fx_geometry")
    clustered.write_boxes(geometry, str(tmp_path / "z"), files=64)
    geometry.repartition(64).write.parquet(str(tmp_path / "plain"))
    window = (0, 0, 12, 20)
    got = {}
    for name in ("z", "plain"):
        rows = props.in_window(spark.read.parquet(str(tmp_path / name)), *window)
        got[name] = (sorted(r["object_id"] for r in rows.collect()), scanned_rows(rows))
    assert got["z"][0] == got["plain"][0] and got["z"][0]
    assert got["z"][1] * 3 < got["plain"][1]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(object_id")


def test_bucketed_properties_need_no_exchange(spark, fx, tmp_path):
    table = clustered.save_by_object(fx("fx_records"), "by_object_test", str(tmp_path / "b"), 4)
    plain = fx("fx_records")
    for work in (props.first_rows, lambda df: props.last_rows(df, ["object_id", "category"]), props.group_objects):
        assert "Exchange" in work(plain)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in work(table)._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged, usual = unified.merge(table, fx("fx_mesh_geometry")), unified.merge(plain, fx("fx_mesh_geometry"))
        # Only the geometry side is dealt out.
        assert exchanges(merged) < exchanges(usual)
        assert sorted(r["object_id"] for r in merged.collect()) == sorted(r["object_id"] for r in usual.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.sql("DROP TABLE by_object_test")


def test_buckets_and_report_tasks_grow_with_the_table(spark, fx, tmp_path):
    from girderframe.functions.display import with_parsed
    from girderframe.operators import quality

    rows = with_parsed(fx("fx_records")).localCheckpoint()
    many = clustered.save_by_object(rows, "by_object_many", str(tmp_path / "b"), 4, rows_per_bucket=500)
    described = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE EXTENDED by_object_many").collect()}
    assert int(described["Num Buckets"]) == -(-rows.count() // 500)
    assert many.count() == rows.count()
    spark.sql("DROP TABLE by_object_many")
    report = quality.report(rows, rows_per_task=500)
    assert "RepartitionByExpression [object_id" in report._jdf.queryExecution().optimizedPlan().toString()
    assert f", {-(-rows.count() // 500)}" in report._jdf.queryExecution().optimizedPlan().toString()
    assert report.collect() == quality.report(rows).collect()


# --- debounce as a running query -----------------------------------------------------------


def test_debounce_goes_on_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=rng.randint(0, 4000)), rng.choice(["a", "b", None])) for k in range(300)] + [(900, start, "c"), (901, start + timedelta(seconds=60), "c")]
    rows.sort(key=lambda r: r[1])
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, key string")
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    options = {"key": "key", "time": "ts", "order": "event_id", "quiet_seconds": 60, "lateness": "10 seconds"}
    for k in range(0, len(rows), 80):
        spark.createDataFrame(rows[k : k + 80], events.schema).coalesce(1).write.mode("append").parquet(source)
        deb.run_debounce(spark, source, events.schema, target, checkpoint, **options)
    late = rows[0][1]
    spark.createDataFrame([(999, late, "a")], events.schema).coalesce(1).write.mode("append").parquet(source)
    deb.close_sessions(spark, source, events.schema, "ts", rows[-1][1] + timedelta(hours=1))
    deb.run_debounce(spark, source, events.schema, target, checkpoint, **options)
    # A further run finds nothing new and repeats nothing.
    deb.run_debounce(spark, source, events.schema, target, checkpoint, **options)
    got = sorted(r["event_id"] for r in spark.read.parquet(target).collect())
    want = sorted(r["event_id"] for r in deb.debounce(events, "key", "ts", "event_id", 60).collect())
    assert got == want and 901 in got and 900 not in got
