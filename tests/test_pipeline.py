"""Whole runs over trace directories, and the queries against their oracles."""

import json
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spanloom.functions import tree_from_json
from spanloom.operators.rules import case_parse
from spanloom.plans import TraceConfig, dump_trace, open_traces, process_trace, run
from spanloom.sources import decode_events, read_lines, read_result, relative_time, store, trace_starts

from samples import rows
from workload.adapter import ROWS, dealt, event_rows, tasks_for
from workload.queries import QUERIES, _KEPT, prepared

LOOP = "org.apache.spark.scheduler.DAGSchedulerEventProcessLoop.doOnReceive(Event)"


def tree(name, *fields):
    return {"type": name, "fields": list(fields)}


def trace(path, jvm, start, *bodies):
    path.mkdir(exist_ok=True)
    lines = [json.dumps(tree("Tuple3", jvm, str(start + t), b), separators=(",", ":")) for t, b in bodies]
    (path / f"{jvm}.trace").write_text("\n".join(lines))


@pytest.fixture(scope="module")
def directories(tmp_path_factory):
    root = tmp_path_factory.mktemp("traces")
    one, two, empty = root / "one", root / "two", root / "empty"
    empty.mkdir()
    (empty / "none.trace").write_text("")
    args = lambda *a: tree("TraversableOnce", *a)
    trace(
        one, "a", 1000,
        (0, tree("SpanStart", "s", tree("JVMStart"))),
        (5, tree("SpanEnd", "s")),
        (6, tree("Service", "sparkDriver", "h/1.1.1.1:10")),
        (7, tree("Fn", LOOP, args(tree("BeginEvent", "Task(1,2)")), None)),
        (9, tree("Fn", LOOP, args(tree("CompletionEvent", "Task(1,2)")), None)),
        (10, tree("RPC", "/2.2.2.2:20", "/1.1.1.1:10", tree("Heartbeat", "1"))),
        (11, tree("RPC", "/2.2.2.2:20", "/1.1.1.1:10", "BlockManagerId(x, y)")),
        (12, tree("RPC", "/3.3.3.3:30", "/1.1.1.1:10", "Lost")),
        (13, tree("MainEnd")),
    )
    trace(
        one, "b", 1000,
        (2, tree("Service", "driverPropsFetcher", "/2.2.2.2:19")),
        (3, tree("Service", "sparkExecutor", "/2.2.2.2:20")),
        (20, tree("Fn", "k.f(int)", args("a\tb\n\"c\""), None)),
    )
    trace(two, "z", 50, (0, tree("MainEnd")), (4, tree("InstrumentOverhead", "7")))
    return [str(one), str(two), str(empty)]


@pytest.mark.parametrize("folder", [True, False], ids=["named", "own"])
def test_process(spark, directories, tmp_path, monkeypatch, folder):
    out = str(tmp_path / "out")
    if not folder:
        monkeypatch.setattr(store, "FOLDER", "spark.checkpoint.none")
    tables = process_trace(spark, directories, TraceConfig(), out)
    assert set(tables) == {"timerange", "axes", "rpcs", "events", "spans", "stat:count", "stat:dist"}
    driver, executor = "1.1.1.1 10 sparkDriver", "2.2.2.2 20 sparkExecutor"
    assert rows(tables["axes"]) == [(executor,), (driver,), ("z",)]
    assert rows(tables["rpcs"]) == [(11, executor, driver, "BlockManagerId(x, y)")]
    assert rows(tables["spans"]) == [(0, 5, driver, "JVMStart")]
    assert rows(tables["timerange"]) == [(0,), (20,)]
    assert sorted(rows(tables["events"])) == [
        (0, "z", "MainEnd"),
        (4, "z", "InstrumentOverhead(7)"),
        (7, driver, "DAGSchedulerEvent(BeginEvent(Task(1, 2)))"),
        (9, driver, "DAGSchedulerEvent(CompletionEvent(Task(1, 2)))"),
        (13, driver, "MainEnd"),
        (20, executor, 'Fn(k.f(int), TraversableOnce(a\tb\n"c"), null)'),
    ]
    counts = {(r.trace, r.stat): r.Count for r in tables["stat:count"].collect()}
    assert counts[0, "Tasks"] == 1 and counts[1, "Tasks"] == 0 and len(counts) == 10
    assert spark.read.parquet(f"{out}/spans").dtypes[0] == ("start", "timestamp")
    back = read_result(spark, f"{out}/text")
    assert back["events"].filter(F.col("content").contains("a\\tb\\n")).count() == 1
    assert back["stat:dist"].count() == 10


def test_folder_of_a_cluster(spark, monkeypatch):
    """On a cluster no folder of the driver's machine stands in for the shared one."""
    monkeypatch.setattr(store, "FOLDER", "spark.checkpoint.none")
    assert spark.conf.get("spark.checkpoint.none", None) is None
    own = store.shared_folder(spark)
    assert own == store.shared_folder(spark) and spark.conf.get("spark.checkpoint.none", None) is None
    context = type("Context", (), {"master": "yarn", "applicationId": "x"})()
    session = type("Session", (), {"conf": spark.conf, "sparkContext": context})()
    with pytest.raises(ValueError, match="checkpoint"):
        store.shared_folder(session)


def test_kept_tables_are_released(spark):
    kept = store.keep(spark.range(5))
    folder = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert store.is_kept(kept) and kept.count() == 5 and os.path.isdir(folder)
    store.release(kept, spark.range(1))
    assert not store.is_kept(kept) and not os.path.exists(folder)


def scans(frame, kind="FileScan"):
    return frame._jdf.queryExecution().executedPlan().toString().count(kind)


def test_a_thousand_directories_are_one_scan(spark, tmp_path):
    paths = []
    for k in range(1000):
        folder = tmp_path / f"run {k:04d}"
        folder.mkdir()
        (folder / "a.trace").write_text(f"line {k}\nagain {k}\n")
        paths.append(str(folder))
    lines = read_lines(spark, paths)
    assert scans(lines) == 1
    assert Counter(map(tuple, lines.collect())) == Counter((k, f"{word} {k}") for k in range(1000) for word in ("line", "again"))


def test_directories_files_and_patterns(spark, tmp_path):
    for name, text in (("a/x.trace", "ax"), ("a/y.trace", "ay"), ("a/day=1/z.trace", "az"), ("b/x.trace", "bx"), ("é è/x.trace", "ex"), ("a2/x.trace", "a2x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text + "\n")
    root = str(tmp_path)
    found = lambda *paths: sorted(map(tuple, read_lines(spark, [f"{root}/{p}" for p in paths]).collect()))
    assert found("a", "b") == [(0, "ax"), (0, "ay"), (0, "az"), (1, "bx")]
    assert found("b", "b") == [(0, "bx"), (1, "bx")]
    assert found("b/", "é è") == [(0, "bx"), (1, "ex")]
    assert found("b/x.trace", "b") == [(0, "bx"), (1, "bx")]
    assert found("a2", "[be]*") == [(0, "a2x"), (1, "bx")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        found("none")


def test_dump_and_modes(spark, directories, tmp_path):
    out = tmp_path / "dump"
    config = TraceConfig(props={"traceout": directories[1], "result": str(out), "mode": "dump"})
    run(spark, config)
    text = "".join(p.read_text() for p in sorted(out.glob("part-*")))
    events = [e for e in text.split("\n" + "=" * 80 + "\n") if e]
    assert sorted(events) == [
        "0.......Tuple3\n1.........z\n2.........0\n3.........MainEnd",
        "0.......Tuple3\n1.........z\n2.........4\n3.0.......InstrumentOverhead\n3.1.........7",
    ]
    with pytest.raises(ValueError, match="unknown mode"):
        run(spark, TraceConfig(props={"traceout": directories[1], "mode": "guess"}))
    with pytest.raises(KeyError, match="traceout"):
        run(spark, TraceConfig())
    with pytest.raises(ValueError, match="unknown configuration"):
        TraceConfig.from_mapping({"tagets": {}})


def test_empty_input(spark, directories):
    ctx = open_traces(spark, [directories[2]], TraceConfig())
    assert ctx.events.count() == 0 and ctx.services.count() == 0


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "x.trace").write_text('{"type":"Tuple3","fields":["a","1",{"type":"MainEnd","fields":[]}]}\nbroken\n{"type":"T","fields":["a","b"]}\n')
    lines = read_lines(spark, [str(tmp_path)])
    assert decode_events(lines, "DROPMALFORMED").count() == 1
    kept = decode_events(lines).collect()
    assert sorted(r.corrupt or "" for r in kept) == ["", "broken", '{"type":"T","fields":["a","b"]}']
    with pytest.raises(Exception, match="malformed trace line"):
        decode_events(lines, "FAILFAST").collect()
    with pytest.raises(ValueError):
        decode_events(lines, "LENIENT")


@pytest.mark.parametrize("name", ["trace_subtree", "case_parse", "spans", "rpcs", "stat_dist", "service_fallback", "result_text"])
def test_oracles(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    frame = __spark_entry__.queries()[name](spark, sf_dir)
    with duckdb.connect() as db:
        for table in ("events", "documents", "orders", "lineitem"):
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        names = sorted(frame.columns)
        expected = db.sql("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, rows(frame.select(*[f"`{n}`" for n in names])))) == sorted(map(repr, expected))


def test_contract(spark):
    from workload.oracles import ORACLES
    from workload.queries import QUERIES

    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["start", "end", "location", "content"]


def test_rows_are_dealt_by_their_number(spark, tmp_path):
    """A long table in few splits gives as many tasks as it has rows for, so that no task grows with the table."""
    rows = 9 * ROWS
    made = "id AS event_id, id % 7 AS user_id, 'click' AS event_type, timestamp_ntz'2024-01-01' AS ts, 1D AS value, '{\"k\": 1}' AS props"
    spark.range(rows).coalesce(8).selectExpr(*made.split(", ")).write.parquet(f"{tmp_path}/events.parquet")
    table = spark.read.parquet(f"{tmp_path}/events.parquet")
    assert event_rows(spark, str(tmp_path)).rdd.getNumPartitions() == tasks_for(table) == max(spark.sparkContext.defaultParallelism, 9)
    many = spark.range(100).repartition(20)
    assert dealt(many, 10).rdd.getNumPartitions() == 20 and dealt(many, 3).rdd.getNumPartitions() == 34


def test_files_of_kept_tables_are_short(spark):
    """A task that writes many rows writes several files, so that no split of the table grows with it."""
    rows = 2 * store.FILE_ROWS + 1
    table = store.keep(spark.range(rows).coalesce(1))
    per_file = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
    assert sorted(per_file) == [1, store.FILE_ROWS, store.FILE_ROWS]


def test_conditions_of_case_parsing_are_generated_code(spark):
    """No lambda stands around the conditions: what a lambda reads is interpreted, and every event is checked."""
    line = json.dumps(tree("Tuple3", "a", "1", tree("Fn", "k.f(int)", tree("Args", tree("Begin", "T(1)")))), separators=(",", ":"))
    raw = spark.createDataFrame([(line,)], "line string").select(F.explode(F.array(tree_from_json("line").column)).alias("tree"))
    done = case_parse(raw, {"3.0 = Fn": {"default": ["3.1"], "3.2.1.0 in Begin, End": ["3.2.1.1"], "3.1.0 = none": ["3.2"]}})
    assert done.select("tree.name").first().name == ["Tuple3", "a", "1", "Fn", "k.f", "int", "Args", "Begin", "T", "1"]
    checks = [p for p in done._jdf.queryExecution().optimizedPlan().toString().splitlines() if " AS _wanted#" in p]
    assert checks and not any("lambda" in p for p in checks)


@pytest.fixture(scope="module")
def spans_of_one_user(spark, tmp_path_factory):
    """Span 7-1 starts twice and ends three times, 7-2 only starts, one without a number does both."""
    folder = str(tmp_path_factory.mktemp("spans"))
    kinds = [("view", 1), ("view", 1), ("view", 2), ("view", None), ("purchase", 1), ("purchase", 1), ("purchase", 1), ("purchase", None)]
    made = [(i, 7, kind, f"2024-01-01 00:00:0{i}", 1.0, "{}" if k is None else f'{{"k": {k}}}') for i, (kind, k) in enumerate(kinds)]
    table = spark.createDataFrame(made, "event_id long, user_id long, event_type string, ts string, value double, props string")
    table.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{folder}/events.parquet")
    return folder


def test_rules_read_what_was_decoded(spark, spans_of_one_user):
    """Trees are written as decoded and with the rules applied, and not once more in between."""
    assert prepared(spark, spans_of_one_user).filter("kept").count() > 0
    mine = [key[2] for key in _KEPT if key[1] == spans_of_one_user]
    assert "prepared" in mine and "events" not in mine


def test_span_pair_reads_trees_once(spark, spans_of_one_user):
    """Starts and ends come from one kept table of marks; every start meets every end."""
    pairs = QUERIES["span_pair"](spark, spans_of_one_user)
    assert "tree" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    found = Counter((r.span_id, r.start, r.end) for r in pairs.collect() if r.span_id != "jvm7")
    assert found == Counter(("7-1", start, end) for start in (0, 1000) for end in (4000, 5000, 6000))


def test_trees_get_their_time_in_generated_code(spark):
    """The tree is made in a projection; a generator would interpret what makes it."""
    line = json.dumps(tree("Tuple3", "a", "40", tree("MainEnd")), separators=(",", ":"))
    lines = spark.createDataFrame([(0, line), (0, line.replace("40", "55"))], "trace_id int, line string")
    events = store.keep(decode_events(lines, "DROPMALFORMED"))
    done = relative_time(events, trace_starts(events))
    assert sorted(r.name for r in done.select("tree.name").collect()) == [["Tuple3", "a", "0", "MainEnd"], ["Tuple3", "a", "15", "MainEnd"]]
    steps = done._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("slice(" in p for p in steps) and not any("slice(" in p for p in steps if "Generate " in p)
