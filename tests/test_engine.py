"""Services, pairing, blocks and statistics on the small run; rules and formats."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import S, name_at, tree_from_text
from spanloom.operators.blocks import AXES, EVENTS, RPCS, SPANS, STAT_COUNT, STAT_DIST, TIME_RANGE, Context, statistics_block
from spanloom.operators.formats import FormatSpec, Formatter, FunctionTarget, VariableTarget, target_of
from spanloom.operators.pairing import span_length, time_delta
from spanloom.operators.rules import Condition, Rule, cascade, case_parse, filter_rules, keeps
from spanloom.operators.services import endpoints, host_of, listed_services, main_services, port_of, resolve_endpoint, resolve_services, with_endpoint
from spanloom.operators.stats import (
    BLOCK_UPDATES,
    COUNT,
    COUNT_STATISTICS,
    EXECUTOR_LIFETIME,
    EXECUTORS,
    JOBS,
    JVM_START_TIME,
    JVMS,
    MESSAGES_SENT,
    OVERHEAD,
    Percentile,
    StatColumn,
    Statistic,
    TASK_DURATION,
    TASKS,
    nearest_ranks,
    statistic_values,
    statistics_table,
    summarise,
)
from spanloom.plans import TraceConfig, context, defaults
from spanloom.sources import read_result, result_lines, write_result_text

import math

from samples import BLOCKS_SET, CALLS, MESSAGES, REMOVED, RUN, SCHEDULER, SERVICES, SHOWN, TASKS_RUN, evaluate, prepared, rows, run_context, service_of, trees
from samples import JVMS as PROCESSES


@pytest.fixture(scope="module")
def ctx(spark):
    found = run_context(spark)
    return Context(found.events.persist(), found.services.persist(), found.formatter)


# ---------------------------------------------------------------- blocks


def test_axes(ctx):
    assert rows(AXES.frame(ctx)) == [(service_of(u),) for u in sorted(SHOWN, key=lambda u: PROCESSES[u]["registered"])]


def test_rpcs(ctx):
    shown = [(ts, service_of(a), service_of(b), text) for ts, a, b, text in MESSAGES if a in SHOWN and b in SHOWN]
    assert sorted(rows(RPCS.frame(ctx))) == shown and len(shown) == 5


def test_events(ctx):
    want = [(ts, service_of("coord"), f"loop: {what} of {argument}") for ts, what, argument in SCHEDULER]
    for (stage, part), (begin, end) in TASKS_RUN.items():
        want.append((begin, service_of("coord"), f"loop: BeginEvent of Task({stage}, {part})"))
        want += [(end, service_of("coord"), f"loop: CompletionEvent of Task({stage}, {part})")] if end else []
    want += [(ts, service_of(u), f"{block} now {level}") for ts, u, block, level in BLOCKS_SET]
    for u in SHOWN:
        want += [(PROCESSES[u]["end"], service_of(u), "MainEnd"), (PROCESSES[u]["end"] + 4, service_of(u), f"InstrumentOverhead({PROCESSES[u]['overhead']})")]
    assert sorted(rows(EVENTS.frame(ctx))) == sorted(want)


def test_spans(ctx):
    want = [(PROCESSES[u]["up"], PROCESSES[u]["ready"], service_of(u), "JVMStart") for u in SHOWN]
    want += [(start, end, service_of(u), f"{amount} x {item} = {price}") for _, u, start, end, item, amount, price in CALLS if end]
    assert sorted(rows(SPANS.frame(ctx))) == sorted(want)


def test_time_range(ctx, spark):
    assert rows(TIME_RANGE.frame(ctx)) == [(min(PROCESSES[u]["up"] for u in SHOWN),), (max(PROCESSES[u]["end"] for u in SHOWN) + 4,)]
    nothing = Context(ctx.events.limit(0), ctx.services.limit(0))
    assert rows(TIME_RANGE.frame(nothing)) == [(0,), (0,)]


# ---------------------------------------------------------------- statistics

VALUES = {
    "JVM start time": {service_of(u): (PROCESSES[u]["ready"] - PROCESSES[u]["up"]) / 1000 for u in SHOWN},
    "Executor lifetime": {service_of(u): (PROCESSES[u]["end"] - PROCESSES[u]["up"]) / 1000 for u in SHOWN if PROCESSES[u]["service"] == "sparkExecutor"},
    "Task duration": {f"({stage},{part})": (end - begin) / 1000 for (stage, part), (begin, end) in TASKS_RUN.items() if end},
    "RPCs sent": {service_of(u): float(sum(to == u for _, _, to, _ in MESSAGES)) for u in SHOWN},
    "Instr Overhead": {service_of(u): PROCESSES[u]["overhead"] / 1000 for u in SHOWN},
}
COUNTED = {
    "JVMs": len(PROCESSES),
    "Executors": sum(what == "ExecutorAdded" for _, what, _ in SCHEDULER),
    "Jobs": sum(what == "JobSubmitted" for _, what, _ in SCHEDULER),
    "Tasks": len(VALUES["Task duration"]),
    "Block updates": len(BLOCKS_SET),
}


@pytest.mark.parametrize("stat", [JVM_START_TIME, OVERHEAD, MESSAGES_SENT, EXECUTOR_LIFETIME, TASK_DURATION], ids=lambda s: s.name)
def test_distributions(ctx, stat):
    found = stat.extract(ctx.events, ctx.services)
    assert {(r.trace_id, r.key): r.value for r in found.collect()} == {(0, k): v for k, v in VALUES[stat.name].items()}


def test_counts(ctx):
    n = {s.name: s.extract(ctx.events, ctx.services).count() for s in (JVMS, EXECUTORS, JOBS, TASKS, BLOCK_UPDATES)}
    assert n == COUNTED
    assert rows(STAT_COUNT.frame(ctx)) == [(0, name, n) for name, n in COUNTED.items()]


def summary(values):
    """Quartiles by nearest rank, and the first and last key with the smallest and the largest value."""
    ordered = sorted(values.values())
    quartiles = [ordered[max(math.ceil(p / 100 * len(ordered)) - 1, 0)] for p in (0, 25, 50, 75, 100)]
    return (*quartiles, min(k for k, v in values.items() if v == ordered[0]), max(k for k, v in values.items() if v == ordered[-1]))


def test_dist_table(ctx):
    table = STAT_DIST.frame(ctx)
    assert table.columns == ["trace", "stat", "0%", "25%", "50%", "75%", "100%", "Min at", "Max at"]
    assert rows(table) == [(0, name, *summary(values)) for name, values in VALUES.items()]


def test_empty_statistics_keep_their_rows(ctx):
    quiet = Context(ctx.events.filter("kind = 'none'"), ctx.services)
    assert rows(STAT_DIST.frame(quiet))[0] == (0, "JVM start time", 0.0, 0.0, 0.0, 0.0, 0.0, "", "")
    assert rows(STAT_COUNT.frame(quiet))[0] == (0, "JVMs", 0)


def test_nearest_ranks_against_sorting(spark):
    import random

    rng = random.Random(3)
    groups = {g: [rng.choice([-1, 1]) * rng.choice([0, 1, 5e-3, 3e4]) * rng.random() for _ in range(n)] for g, n in enumerate([1, 2, 3, 7, 40, 997])}
    data = [(g, v) for g, vs in groups.items() for v in vs]
    counted = spark.createDataFrame(data, "g int, value double").groupBy("g", "value").agg(F.count("*").alias("n"))
    ps = [0, 1, 25, 33.3, 50, 75, 99, 100]
    got = {(r.g, r.p): r.value for r in nearest_ranks(counted, ["g"], ps).collect()}
    for g, vs in groups.items():
        for p in ps:
            assert got[g, float(p)] == sorted(vs)[max(math.ceil(p / 100.0 * len(vs)) - 1, 0)]


def test_own_statistic_and_column(ctx):
    lengths = Statistic("Content size", lambda events, services: events.select("trace_id", F.col("kind").alias("key"), F.length("kind").alias("value")))
    spread = StatColumn("Spread", "num", lambda: F.max("value") - F.min("value"), 0.0)
    table = statistics_block("own", [lengths, JVMS], [COUNT, spread, Percentile(50)]).frame(ctx)
    sizes = sorted(len(line.split(",", 2)[2].split("(")[0].rstrip(")")) for line in RUN)
    assert rows(table) == [(0, "Content size", len(RUN), float(sizes[-1] - sizes[0]), float(sizes[math.ceil(len(sizes) / 2) - 1])), (0, "JVMs", 4, 0.0, 0.0)]


def test_ties(spark):
    values = spark.createDataFrame([(0, "s", k, v) for k, v in [("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 3.0), ("e", 1.0)]], "trace_id int, stat string, key string, value double")
    from spanloom.operators.stats import ARG_MAX, ARG_MIN

    assert rows(summarise(values, ["s"], [COUNT, ARG_MIN, ARG_MAX], values.select("trace_id"))) == [(0, "s", 5, "a", "d")]


# ---------------------------------------------------------------- services


@pytest.fixture(scope="module")
def service_events(spark):
    return prepared(spark, *SERVICES).persist()


def test_service_dimension(service_events):
    services = resolve_services(service_events)
    assert services.count() == 8
    assert services.select("trace_id", "uuid").distinct().count() == 6
    assert services.filter("trace_id = 0").select("uuid").distinct().count() == 4
    (one,) = endpoints(services).filter("host = '192.168.7.4' AND port = 7301").collect()
    assert (one.trace_id, one.start, one.service_id, one.uuid) == (1, 60, "192.168.7.4 7301 sparkExecutor", "aide")
    listed = rows(listed_services(services))
    assert listed == sorted(listed) and len(listed) == 8


@pytest.mark.parametrize(
    "removed, main, passing",
    [
        ([], "192.168.7.2 7101 driverPropsFetcher", [True, True, True]),
        ([".*sparkExecutor"], "192.168.7.2 7101 driverPropsFetcher", [True, False, False]),
        ([".*driverPropsFetcher"], "192.168.7.2 7102 sparkExecutor", [False, True, False]),
        ([".*sparkExecutor", ".*driverPropsFetcher"], None, [False, False, False]),
        (["sparkExecutor"], "192.168.7.2 7101 driverPropsFetcher", [True, True, True]),
    ],
)
def test_service_removal(spark, service_events, removed, main, passing):
    services = resolve_services(service_events, removed)
    mains = {(r.trace_id, r.uuid): r.service for r in main_services(services).collect()}
    assert mains.get((0, "hand")) == main
    assert mains.get((0, "boss")) == "192.168.7.1 7001 sparkDriver"
    fetcher, driver, executor = "/192.168.7.2:7101", "/192.168.7.1:7001", "/192.168.7.2:7102"
    pairs = [(0, 0, 200, fetcher, driver), (1, 0, 200, driver, executor), (2, 0, 200, fetcher, executor)]
    pairs = spark.createDataFrame(pairs, "i int, trace_id int, ts bigint, a string, b string")
    ends = endpoints(services)
    kept = {r.i for r in with_endpoint(with_endpoint(pairs, ends, "a", "x"), ends, "b", "y").collect()}
    assert [i in kept for i in range(3)] == passing


def test_reused_address(spark, service_events):
    ends = endpoints(resolve_services(service_events))
    messages = spark.createDataFrame([(0, ts, "/192.168.7.2:7101") for ts in (10, 299, 300, 999)], "trace_id int, ts bigint, a string")
    found = {r.ts: r.x for r in with_endpoint(messages, ends, "a", "x").collect()}
    before, after = "192.168.7.2 7101 driverPropsFetcher", "192.168.7.2 7101 sparkExecutor"
    assert found == {10: before, 299: before, 300: after, 999: after}


def test_stand_ins(spark):
    ready = prepared(spark, ["(v,7,MainEnd)", "(u,7,MainEnd)", "(w,5,MainEnd)", "(w,9,MainEnd)"], ["(a,1,Service(n,/h:1))"])
    found = resolve_services(ready).select("trace_id", "uuid", "host", "port", "start", "service_id")
    assert sorted(rows(found)) == [
        (0, "u", "", 1, 7, "u"),
        (0, "v", "", 2, 7, "v"),
        (0, "w", "", 0, 5, "w"),
        (1, "a", "h", 1, 1, "h 1 n"),
    ]


def test_addresses(spark):
    frame = spark.createDataFrame([("x/1.2.3.4:80",), ("/1:1",), ("host",), ("/h:x",)], "a string")
    assert rows(frame.select(host_of(F.col("a")), port_of(F.col("a")))) == [("1.2.3.4", 80), ("1", 1), (None, None), (None, None)]


# ---------------------------------------------------------------- pairing


def test_time_delta(spark):
    """Keys with a start and an end, in any order of rows; against all pairs of them."""
    data = [(31, "tea", "start"), (77, "tea", "end"), (5, "rye", "end"), (4, "rye", "start"), (90, "oat", "start"), (60, "oat", "end"), (8, "bun", "start"), (9, "jam", "end"), (1, None, "start"), (2, None, "end")]
    frame = spark.createDataFrame(data, "ts int, key string, phase string")
    start, end = F.col("phase") == "start", F.col("phase") == "end"

    def deltas(data, keep):
        found = time_delta(spark.createDataFrame(data, frame.schema), start, end, [F.col("key")], keep=keep)
        return sorted((r.key, r.delta) for r in found.collect())

    def wanted(data, keep):
        times = lambda key, phase: [t for t, k, p in data if k == key and p == phase]
        keys = {k for _, k, _ in data if k is not None}
        pairs = {k: (times(k, "start"), times(k, "end")) for k in keys if times(k, "start") and times(k, "end")}
        if keep == "all":
            return sorted((k, e - s) for k, (ss, es) in pairs.items() for s in ss for e in es)
        pick = max if keep == "last" else min
        return sorted((k, pick(es) - pick(ss)) for k, (ss, es) in pairs.items())

    more = data + [(40, "tea", "start"), (99, "tea", "end"), (99, "tea", "end")]
    for keep in ("last", "first", "all"):
        assert deltas(data, keep) == wanted(data, keep) == [("oat", -30), ("rye", 1), ("tea", 46)]
        assert deltas(more, keep) == wanted(more, keep)


def test_span_length(spark):
    """Spans by name, whichever mark bears it; left open, backwards, and several spans of one part."""
    data = [
        (100, "n1", "load", True, "x"), (130, "n1", None, False, "x"),
        (105, "n2", None, True, "x"), (190, "n2", "load", False, "x"),
        (300, "n3", "load", True, "y"), (280, "n3", "load", False, "y"),
        (400, "n4", "load", True, "y"),
        (500, "n5", "save", True, "y"), (501, "n5", "save", False, "y"),
        (600, "n6", "load", True, None), (666, "n6", None, False, None),
        (700, None, "load", True, "x"),
    ]
    marks = spark.createDataFrame([(0, *d) for d in data], "trace_id int, ts int, span_id string, span_name string, opens boolean, part string")
    assert {r.key: r.delta for r in span_length(marks, "load").collect()} == {"n1": 30, "n2": 85, "n3": -20, "n6": 66}
    parts = {r.key: (r.start, r.end) for r in span_length(marks, "load", "part").collect()}
    assert parts == {"x": (105, 190), "y": (400, 280)}


# ---------------------------------------------------------------- rules


CONDITIONS = [
    (["2 = pear"], {"f(x,pear)": 1, "f(x,pear,y)": 1, "f(x,pear())": 1, "f(pear,x)": 0, "f(x,(pear))": 0, "f(x,pear(y))": 0, "f": 0, "": 0}),
    (["0 in fig, plum,pear"], {"fig(a)": 1, "plum": 1, "pear(fig)": 1, "apple(fig)": 0, "(fig)": 0}),
    (["0 in fig,plum", "1 != ripe"], {"fig(raw)": 1, "plum(ripe(not))": 1, "fig": 1, "fig(ripe)": 0, "pear(raw)": 0}),
    (["1.2 exists"], {"f(g(a,b))": 1, "f(g(a,(c)))": 1, "f(g(a))": 0, "f(g(a,))": 0, "f(a,g(a,b))": 0, "": 0}),
    (["1.2 exists", "1.2 != b", "2 = z"], {"f(g(a,c),z)": 1, "f(g(a,b(d)),z)": 1, "f(g(a,b),z)": 0, "f(g(a,c),y)": 0, "f(g(a),z)": 0}),
    (["1 = g(a, b)"], {"f(g(a,b))": 1, "f(g( a , b() ),x)": 1, "g(a,b)": 0, "f(g(a))": 0, "f(g(a,b,c))": 0, "f(g(a,b(c)))": 0}),
    (["1 ~ ^p.+r$"], {"f(pear)": 1, "f(spear)": 0, "f(pears)": 0}),
    (["1 matches ea"], {"f(pear)": 1, "f(fig)": 0}),
    (["4 ="], {"f(a)": 1, "f(a,b,c,d)": 0, "f(a,b,c,)": 1}),
    (["default"], {"f": 1}),
    (["1 == it's\\so"], {"f(it's\\so)": 1, "f(its)": 0}),
]


@pytest.mark.parametrize("texts, cases", CONDITIONS, ids=lambda c: str(c)[:20])
def test_conditions(spark, texts, cases):
    rule = Rule(tuple(map(Condition.parse, texts)), True)
    found = trees(spark, *cases).select("text", rule.matches(S.col("tree")).column).collect()
    assert {t: int(hit) for t, hit in found} == cases


def test_condition_errors():
    for text in ("1 like a", "1", "x = 1", "default "):
        with pytest.raises(ValueError):
            Condition.parse(text)


FILTERS = {"3.0 = RPC": {"default": False, "3.3.0 = StatusUpdate": {"3.3.3 = RUNNING": True}}, "3.0 = Noise": False}


def test_cascade_order():
    order = [[c.text for c in rule.conditions] for rule in filter_rules({**FILTERS, "default": True, "1 = a": {"2 = b": False, "default": True}})]
    assert order == [
        ["default"],
        ["3.0 = Noise"],
        ["3.0 = RPC", "default"],
        ["1 = a", "default"],
        ["1 = a", "2 = b"],
        ["3.0 = RPC", "3.3.0 = StatusUpdate", "3.3.3 = RUNNING"],
    ]
    with pytest.raises(TypeError):
        filter_rules({"1 = a": "no"})
    assert cascade(None) == []


def test_filters(spark):
    cases = {
        "(a,1,RPC(x,y,StatusUpdate(1,2,RUNNING)))": True,
        "(a,1,RPC(x,y,StatusUpdate(1,2,DONE)))": False,
        "(a,1,RPC(x,y,Other))": False,
        "(a,1,Noise)": False,
        "(a,1,Fn(f))": True,
    }
    found = trees(spark, *cases).select("text", keeps(FILTERS, S.col("tree")).column).collect()
    assert dict(map(tuple, found)) == cases
    assert trees(spark, "a").select(keeps({}, S.col("tree")).column).first()[0] is True


def test_case_parse(spark):
    """Leaves that are text of calls become trees, where a rule says so."""
    frame = trees(spark, "Order(web,FIRST,Line(7,SECOND,tail))")
    put = {"FIRST": "book(title,price(12, EUR))", "SECOND": "ship(to(north),fast)"}
    named = lambda n: S.when(n == "FIRST", put["FIRST"]).when(n == "SECOND", put["SECOND"]).otherwise(n)
    raw = frame.withColumn("tree", S.struct(path=S.col("tree")["path"], name=S.transform(S.col("tree")["name"], named)).column)

    def parse(rules, *paths, **kw):
        done = case_parse(raw, rules, **kw)
        return list(done.select(*[name_at("tree", p).column.alias(f"c{i}") for i, p in enumerate(paths)], "faults").first())

    both = {"1 = web": {"3.0 = Line": ["2", "3.2"]}}
    assert parse(both, "2", "2.1", "2.2", "2.2.1", "3.2", "3.2.1", "3.2.2", "3.3") == ["book", "title", "price(12, EUR)", None, "ship", "to(north)", "fast", "tail", []]
    assert parse({"1 = web": {"3.0 = Line": ["3.2"]}}, "2", "2.1", "3.2.0") == [put["FIRST"], None, "ship", []]
    assert parse({"1 = shop": ["2"], "6 = no": ["2"]}, "2.0", "2.1") == [put["FIRST"], None, []]
    # A later rule sees what an earlier one made, and may parse inside it.
    assert parse({"1 = web": {"default": ["2"], "2.0 = book": ["2.2"]}}, "2.2", "2.2.2") == ["price", "EUR", []]
    assert parse({"1 = web": ["9"]}, "2") == [put["FIRST"], ["9"]]
    with pytest.raises(Exception, match="cannot parse node"):
        parse({"1 = web": ["9"]}, "2", strict=True)


# ---------------------------------------------------------------- formats


CALL = "(price,till(box(pear,3),card),total(12,EUR))"


@pytest.mark.parametrize(
    "target, text, body, expected",
    [
        (FunctionTarget(""), "no holes", CALL, "no holes"),
        (FunctionTarget(""), "<$1|$1.0>", CALL, "<box(pear, 3)|box>"),
        (FunctionTarget(""), "$1.1, $1.2, $2 at $0", CALL, "pear, 3, card at till"),
        (FunctionTarget(""), "$r or $r.2", CALL, "total(12, EUR) or EUR"),
        (FunctionTarget(""), "[$7]", CALL, "[]"),
        (FunctionTarget(""), "[$2.1]", CALL, "[]"),
        (FunctionTarget(""), "[$r]", "(price,till(x))", "[]"),
        (FunctionTarget(""), "$$ $ 5$", CALL, "$$ $ 5$"),
        (VariableTarget("", ""), "$1.2 of $2", "(a(b,c),d(e,f))", "c of d(e, f)"),
    ],
)
def test_formats(spark, target, text, body, expected):
    spec = FormatSpec.parse(text, target)
    assert spec.text == text
    assert evaluate(spark, body, spec.rendered) == [expected]


def test_format_errors():
    with pytest.raises(ValueError):
        FormatSpec.parse("$r", VariableTarget("", ""))
    with pytest.raises(ValueError):
        FormatSpec.parse("$x", FunctionTarget(""))


def test_formatter(spark):
    targets = {
        "p": [
            {"type": "rpc"},
            {"type": "event", "class": "A", "method": "f", "format": "f of $1"},
            {"type": "span", "class": "B", "method": "B", "format": "new B"},
            {"type": "event", "class": "A", "method": "blank", "format": ""},
            {"type": "local", "class": "A", "method": "f", "variable": "v", "format": "$2 = $3"},
        ]
    }
    assert target_of("p", targets["p"][2]) == FunctionTarget("p.B")
    cases = {
        "(u,1,Fn(p.A.f(int),(q(r)),null))": "f of q(r)",
        "(u,1,Fn(p.B(int),(q),null))": "new B",
        "(u,1,Fn(p.A.blank(int),(q),null))": "Fn(p.A.blank(int), (q), null)",
        "(u,1,LocalVariable(p.A.f(int),v,x(1)))": "v = x(1)",
        "(u,1,LocalVariable(p.A.f(int),w,1))": "LocalVariable(p.A.f(int), w, 1)",
        "(u,1,MainEnd)": "MainEnd",
    }
    done = Formatter.from_targets(targets).label(trees(spark, *cases), "label")
    assert {r.text: r.label for r in done.collect()} == cases


def test_default_rules():
    formatter = Formatter.from_targets(defaults.TARGETS)
    assert len(formatter.specs) == 20 + 14
    kinds = [t["type"] for group in defaults.TARGETS.values() for t in group]
    assert (kinds.count("event"), kinds.count("span"), kinds.count("rpc")) == (20, 17, 1)


# ---------------------------------------------------------------- results


def test_result_text_round_trip(spark, ctx, tmp_path):
    blocks = [TIME_RANGE, AXES, RPCS, STAT_COUNT, STAT_DIST]
    frames = {b.name: b.frame(ctx) for b in blocks}
    path = str(tmp_path / "text")
    write_result_text(blocks, frames, path)
    text = "".join(p.read_text() for p in sorted((tmp_path / "text").rglob("part-*")))
    names = "\n".join(service_of(u) for u in ("coord", "wk1", "wk2"))
    assert text.startswith(f"timerange\ntime\ntime\n12\n934\n%\naxes\nname\nstring\n{names}\n%\nrpcs\n")
    assert "0\tTask duration\t" + "\t".join(map(str, summary(VALUES["Task duration"]))) + "\n" in text
    assert text.endswith("%\n")
    single = tmp_path / "one.txt"
    single.write_text(text)
    tables = read_result(spark, str(single))
    assert list(tables) == [b.name for b in blocks]
    assert rows(tables["stat:count"]) == [(0.0, name, float(n)) for name, n in COUNTED.items()]
    assert tables["rpcs"].dtypes[0] == ("time", "timestamp")
    assert [r.content for r in tables["rpcs"].collect()] == [text for _, a, b, text in MESSAGES if REMOVED not in (PROCESSES[a]["service"], PROCESSES[b]["service"])]


def test_result_text_in_splits(spark, ctx, tmp_path):
    """Files cut into many splits, tables longer than a split, parts beyond five digits, rows that look like marks."""
    from spanloom.operators.blocks import Block
    from spanloom.sources.results import result_records

    long = Block("long", [("time", "num"), ("text", "string")], None, order=("time",))
    odd = Block("odd", [("text", "string")], None)
    empty = Block("empty", [("text", "string")], None)
    data = [(k, f"row {k} " + "x" * (k % 50)) for k in range(3000)]
    marks = ["%", "", "\\%", "  ", "a\tb", "%%", "\\\\"]
    frames = {
        "long": spark.createDataFrame(data[::-1], "time bigint, text string").repartition(5),
        "odd": spark.createDataFrame([(m,) for m in marks], "text string").coalesce(1),
        "empty": spark.createDataFrame([], "text string"),
    }
    folder = tmp_path / "text"
    write_result_text([long, odd, empty], frames, str(folder))
    text = "".join(p.read_text() for p in sorted(folder.rglob("part-*")))
    lines = [r.line for r in result_lines([long, odd, empty], frames).orderBy("block_no", "section", "seq", "tie").collect()]
    assert text == "".join(line + "\n" for line in lines)
    single = tmp_path / "single"
    single.mkdir()
    # The same text in parts whose numbers no longer sort as text.
    for k, start in enumerate(range(0, len(lines), 200)):
        (single / f"part-{99_997 + k}-x.txt").write_text("".join(line + "\n" for line in lines[start : start + 200]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        for place in (str(folder), str(single)):
            tables = read_result(spark, place)
            assert list(tables) == ["long", "odd", "empty"]
            assert sorted(rows(tables["long"])) == [(float(k), t) for k, t in data]
            assert sorted(r.text for r in tables["odd"].collect()) == sorted(m.replace("\t", "\\t") for m in marks)
            assert tables["empty"].count() == 0
        plan = result_records(spark, str(single))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert spark.read.text(str(single)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# ---------------------------------------------------------------- plans


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_numbers_in_two_phases(spark):
    """Every row numbered once, and no window over a whole group."""
    from spanloom.operators.ranks import numbered

    data = [(g, t, i) for g in (1, 2, None) for i, t in enumerate([None, 5, 5, 999, 1000, 1001, 70_000, 5, -3])]
    frame = spark.createDataFrame(data, "g int, t bigint, i int")
    got = numbered(frame, ["g"], F.floor(F.col("t") / 1000), ["t", "i"], "number")
    want = {}
    for g in (1, 2, None):
        mine = sorted(((t is not None, t or 0, i) for h, t, i in data if h == g))
        want.update({(g, i): k for k, (_, _, i) in enumerate(mine)})
    assert {(r.g, r.i): r.number for r in got.collect()} == want
    assert got.columns == ["g", "t", "i", "number"]


def test_an_address_registered_a_thousand_times(spark):
    """Each message meets one row, and finds the registration in force at its time."""
    rows_ = [(0, f"u{k}", "1.1.1.1", 80, f"s{k}", 10 * k, f"id{k}", k % 7 == 0) for k in range(1000)]
    services = spark.createDataFrame(rows_, "trace_id int, uuid string, host string, port int, name string, start bigint, service_id string, removed boolean")
    messages = spark.range(-5, 10_005, 3).select(F.lit(0).alias("trace_id"), F.col("id").alias("ts"), F.lit("/1.1.1.1:80").alias("a"))
    joined = resolve_endpoint(messages, endpoints(services), "a", "x")
    found = {r.ts: r.x for r in joined.collect()}
    assert len(found) == messages.count() == joined.count()
    for ts, x in found.items():
        k = min(max(ts // 10, 0), 999)
        assert (x.service_id, x.removed) == (f"id{k}", k % 7 == 0)
    kept = with_endpoint(messages, endpoints(services), "a", "x")
    assert kept.count() == sum(not x.removed for x in found.values())


def test_statistics_read_their_kinds_only(spark, ctx):
    """The kinds that statistics name reach the scan of the events."""
    from spanloom.sources import keep

    events = keep(ctx.events, "kind")
    plan = plan_of(JOBS.extract(events, ctx.services))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "kind" in pushed and "Fn" in pushed and "SpanStart" not in pushed
    both = plan_of(statistic_values(COUNT_STATISTICS, events, ctx.services))
    assert all("kind" in line.split("PushedFilters")[1] for line in both.splitlines() if "PushedFilters" in line)


def test_span_ids_come_first(spark):
    """Marks of other spans are gone before anything is shuffled: two scans, and the marks are joined where they are read."""
    from spanloom.sources import keep

    marks = spark.range(5000).selectExpr("0 AS trace_id", "id AS ts", "concat('s', id div 2) AS span_id", "if(id < 10, 'get', 'put') AS span_name", "id % 2 = 0 AS opens")
    lengths = span_length(keep(marks), "get")
    plan = plan_of(lengths)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("FileScan") == 2
    assert {r.key: r.delta for r in lengths.collect()} == {f"s{k}": 1 for k in range(5)}


def test_diagnostics_count_what_is_left_out(spark):
    from spanloom.plans import diagnostics

    lines = [
        "(a,1,Service(sparkDriver,/1:1))",
        "(b,2,Service(filterMe,/2:2))",
        "(c,3,Service(broken,nowhere))",
        "(d,3,Service(noAddress))",
        "(a,5,RPC(/1:1,/1:1,Fine))",
        "(a,6,RPC(/1:1,/2:2,ToRemoved))",
        "(a,7,RPC(/9:9,/2:2,FromUnknown))",
        "(a,8,RPC(,/1:1,NoAddress))",
        "(e,9,MainEnd)",
    ]
    ready = prepared(spark, lines, ["(z,1,MainEnd)"])
    decoded = spark.createDataFrame([(0, None), (0, "x"), (0, "y"), (2, "z")], "trace_id int, corrupt string")
    found = {r.trace_id: r.asDict() for r in diagnostics(ready, resolve_services(ready, ["2 2 filterMe"]), decoded).collect()}
    assert found[0] == {"trace_id": 0, "events": 9, "without_service": 4, "with_rule_faults": 0, "unknown_address": 2, "removed_address": 1, "bad_registration": 2, "corrupt_lines": 2}
    assert found[1]["events"] == 1 and found[1]["without_service"] == 0
    assert found[2] == {"trace_id": 2, "events": 0, "without_service": 0, "with_rule_faults": 0, "unknown_address": 0, "removed_address": 0, "bad_registration": 0, "corrupt_lines": 1}
