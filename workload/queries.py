"""One query per operator over the supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import (
    Expr,
    S,
    debug_text,
    has_children,
    is_defined,
    leaf_tree,
    name_at,
    name_is,
    render,
    subtree,
    tokenized,
    tree_from_json,
    tree_from_text,
    tree_from_text_shallow,
    update,
)
from spanloom.operators import stats
from spanloom.operators.blocks import AXES, EVENTS, RPCS, SPANS, STAT_COUNT, STAT_DIST, TIME_RANGE, Context
from spanloom.operators.pairing import span_length, span_pairs, time_delta
from spanloom.operators.rules import condition, keeps
from spanloom.operators.services import main_services, resolve_services
from spanloom.plans import TraceConfig, base_events, context, diagnostics, keep, prepare
from spanloom.sources import decode_events, read_result, result_lines, shared_folder, trace_starts, write_result_text

from .adapter import TRACES, dealt, event_rows, trace_lines


#: Levels of the lines of ``deep_decode``: objects, each around an array.
DEEP = 300
#: Most of them for one task; one holds nine hundred addresses of half a megabyte in all.
DEEP_ROWS = 1000

_KEPT: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], *order: str) -> DataFrame:
    """A table that all queries of a session share; see :func:`spanloom.plans.keep`."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = keep(make(), *order)
    return _KEPT[key]


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded events as they were written, for a query that reads them once: decoding is kept, their time is counted as they are read."""
    key = (spark.sparkContext.applicationId, sf_dir, "written")
    if key not in _KEPT:
        _KEPT[key] = base_events(trace_lines(spark, sf_dir))
    return _KEPT[key]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a kept table."""
    return once(spark, sf_dir, "events", lambda: written(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after case parsing, with the verdict of the filters."""
    made = lambda: prepare(written(spark, sf_dir), TraceConfig())
    return once(spark, sf_dir, "prepared", made, "kept", "kind")


def default_context(spark: SparkSession, sf_dir: str) -> Context:
    ready = context(prepared(spark, sf_dir), TraceConfig())
    return Context(ready.events, once(spark, sf_dir, "services", lambda: ready.services), ready.formatter)


def columns(frame: DataFrame, **made) -> DataFrame:
    """Envelope columns and one column per expression."""
    return frame.select("uuid", "ts", *[e.column.alias(name) for name, e in made.items()])


# ---------------------------------------------------------------- trees


def trace_decode(spark, sf_dir):
    nodes = F.arrays_zip(F.col("tree.path").alias("path"), F.col("tree.name").alias("name"))
    decoded = decode_events(trace_lines(spark, sf_dir), "DROPMALFORMED")
    return decoded.select("trace_id", "uuid", "ts", F.explode(nodes).alias("n")).select("trace_id", "uuid", "ts", "n.path", "n.name")


def deep_decode(spark, sf_dir):
    """Lines 600 levels deep: objects around arrays around the name of a supplier."""
    suppliers = dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet"), DEEP_ROWS)
    line = f"""concat(repeat('{{"type":"d","fields":["a",[', {DEEP}), '"', s_name, '"', repeat(']]}}', {DEEP}))"""
    tree = tree_from_json(Expr(line))
    made = suppliers.select("s_suppkey", F.explode(F.array(tree.column)).alias("t"))
    return made.select(
        "s_suppkey",
        F.size("t.path").cast("bigint").alias("nodes"),
        F.element_at("t.name", -1).alias("name"),
        F.element_at("t.path", -1).alias("path"),
    )


def trace_path_get(spark, sf_dir):
    return columns(
        events(spark, sf_dir),
        kind=name_at("tree", "3.0"),
        first=name_at("tree", "3.1"),
        function=name_at("tree", "3.2.1.0"),
        argument=name_at("tree", "3.2.2.1"),
        payload=name_at("tree", "3.3.0.0"),
        beyond=name_at("tree", "3.0.1"),
    )


def trace_render(spark, sf_dir):
    return columns(
        events(spark, sf_dir), body=render("tree", 3), second=render("tree", "3.2"), third=render("tree", "3.3"), missing=render("tree", 9)
    )


def trace_subtree(spark, sf_dir):
    return columns(events(spark, sf_dir), text=debug_text(subtree("tree", "3.2")))


def trace_is_defined(spark, sf_dir):
    return columns(
        events(spark, sf_dir),
        body=is_defined("tree", 3),
        second=is_defined("tree", "3.2.1"),
        state=is_defined("tree", "3.3.2"),
        parent=has_children("tree", 3),
        call=name_is("tree", "3.0", "Fn", "SpanStart"),
    )


def tree_update(spark, sf_dir):
    tree = S.col("tree")
    return columns(
        events(spark, sf_dir),
        leaf=render(update(tree, "3.1", leaf_tree(S.lit("X"))), 3),
        lifted=render(update(tree, 3, subtree(tree, "3.2")), 3),
        out_of_range=render(update(tree, "3.4", leaf_tree(S.lit("X"))), 3),
    )


def debug_dump(spark, sf_dir):
    return prepared(spark, sf_dir).filter("kept").select("uuid", debug_text("tree").column.alias("text"))


def case_parse(spark, sf_dir):
    return columns(
        prepare(events(spark, sf_dir), TraceConfig()), body=render("tree", 3), function=name_at("tree", "3.1"), task=name_at("tree", "3.2.1.1.2"), level=name_at("tree", "3.3.3.2")
    )


def _expr(text: str) -> Expr:
    return Expr(f"({text})")


_TEXT = "'Outer( ' || event_type || ', Inner(' || user_id || ',(' || event_id || ')), ,' || k || ' ) '"


def paren_parse(spark, sf_dir):
    made = event_rows(spark, sf_dir).select("event_id", F.explode(F.array(tree_from_text(_expr(_TEXT)).column)).alias("tree"))
    return made.select(
        "event_id",
        render("tree").column.alias("text"),
        name_at("tree", "2.0").column.alias("inner"),
        name_at("tree", "2.2.1").column.alias("id"),
        is_defined("tree", 3).column.alias("blank"),
        name_at("tree", 4).column.alias("k"),
    )


def paren_parse_shallow(spark, sf_dir):
    made = event_rows(spark, sf_dir).select("event_id", F.explode(F.array(tree_from_text_shallow(_expr(_TEXT)).column)).alias("tree"))
    return made.select(
        "event_id",
        F.size("tree.name").alias("nodes"),
        name_at("tree", 0).column.alias("name"),
        name_at("tree", 1).column.alias("first"),
        name_at("tree", 2).column.alias("second"),
    )


def paren_reject(spark, sf_dir):
    """Ill-formed text gives no tree: closed too often, text after the end, not closed."""
    rows = event_rows(spark, sf_dir)
    text = "CASE k % 4 WHEN 0 THEN 'a(b,' || k || ')' WHEN 1 THEN 'a(b))' WHEN 2 THEN 'a(b)' || k ELSE 'a((b)' END"
    return rows.select("event_id", tree_from_text(_expr(text)).is_not_null().column.alias("ok"))


def document_lines(spark, sf_dir):
    """Whole documents as the value of a traced variable: quotes, line breaks and all scripts."""
    documents = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    quoted = "substring(to_json(named_struct('t', text)), 6, length(to_json(named_struct('t', text))) - 6)"
    line = f"""'{{"type":"Tuple3","fields":["d","' || doc_id || '",{{"type":"LocalVariable","fields":["f(x)","text",' || {quoted} || ']}}]}}'"""
    lines = documents.select(F.lit(0).alias("trace_id"), F.expr(line).alias("line"))
    return decode_events(lines, "DROPMALFORMED").select(
        F.col("ts").alias("doc_id"),
        F.length(name_at("tree", "3.3").column).cast("bigint").alias("n_chars"),
        F.md5(name_at("tree", "3.3").column).alias("digest"),
    )


def tokenize_documents(spark, sf_dir):
    pieces = tokenized("text", "[0-9]+").column
    return (
        dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        .select("doc_id", pieces.alias("p"))
        .select(
            "doc_id",
            F.size("p").cast("bigint").alias("pieces"),
            F.md5(F.array_join("p", "|")).alias("digest"),
        )
    )


# ---------------------------------------------------------------- ingest


def quarantine(spark, sf_dir):
    """Lines cut short are kept apart and do not disturb the others."""
    return (
        decode_events(cut_lines(spark, sf_dir), "PERMISSIVE")
        .groupBy("trace_id")
        .agg(F.count("uuid").alias("events"), F.count("corrupt").alias("corrupt"), F.sum(F.length("corrupt")).alias("chars"))
    )


def relative_time(spark, sf_dir):
    return base_events(trace_lines(spark, sf_dir)).select("trace_id", "uuid", "ts")


def trace_start(spark, sf_dir):
    return trace_starts(decode_events(trace_lines(spark, sf_dir), "DROPMALFORMED"))


def cut_lines(spark, sf_dir):
    """Trace lines, those of messages cut short."""
    lines = trace_lines(spark, sf_dir)
    return lines.withColumn("line", F.when(F.col("line").contains('"RPC"'), F.expr("left(line, length(line) - 2)")).otherwise(F.col("line")))


def diagnose(spark, sf_dir):
    """What is left out of the tables; corrupt lines are those of the same trace with its messages cut short."""
    ready = prepared(spark, sf_dir)
    services = resolve_services(ready, TraceConfig().remove_services)
    return diagnostics(ready, services, decode_events(cut_lines(spark, sf_dir), "PERMISSIVE"))


# ---------------------------------------------------------------- rules


def _kept(spark, sf_dir, rules):
    frame = prepared(spark, sf_dir)
    return frame.filter(keeps(rules, S.col("tree")).column).select("uuid", "ts", "kind")


def filter_default(spark, sf_dir):
    return prepared(spark, sf_dir).filter("kept").select("uuid", "ts", "kind")


def filter_cascade(spark, sf_dir):
    rules = {"3.0 = RPC": {"default": False, "3.3.0 = StatusUpdate": {"3.3.3 = RUNNING": True}}}
    return _kept(spark, sf_dir, rules)


def filter_in(spark, sf_dir):
    return _kept(spark, sf_dir, {"default": False, "3.0 in MainEnd, Service,SpanEnd": True})


def filter_regex(spark, sf_dir):
    return _kept(spark, sf_dir, {"default": False, "3.3 ~ ^BlockManagerId\\(1": True, "3.1 matches 5$": True})


def filter_exists(spark, sf_dir):
    return _kept(spark, sf_dir, {"3.3.3 exists": False, "3.2 != x": {"3.2.1 exists": True, "3.3 = null": False}})


def condition_columns(spark, sf_dir):
    tree = S.col("tree")
    return columns(
        prepared(spark, sf_dir),
        compound=condition("3.3 = StatusUpdate(4, , RUNNING)", tree),
        other=condition("3.1 != a.b.C.run(int)", tree),
        constant=condition("default", tree),
    )


def format_events(spark, sf_dir):
    ctx = default_context(spark, sf_dir)
    return ctx.formatter.label(ctx.events, "label", at="3").select("uuid", "ts", "kind", "label")


# ---------------------------------------------------------------- services


def service_dim(spark, sf_dir):
    return resolve_services(prepared(spark, sf_dir), TraceConfig().remove_services)


def service_fallback(spark, sf_dir):
    lines = lambda: trace_lines(spark, sf_dir, services=False)
    made = lambda: prepare(base_events(lines()), TraceConfig())
    ready = once(spark, sf_dir, "prepared without services", made, "kept", "kind")
    return resolve_services(ready).select("trace_id", "uuid", "host", "port", "name", "start", "service_id", "removed")


def main_service(spark, sf_dir):
    return main_services(default_context(spark, sf_dir).services)


def endpoint_dim(spark, sf_dir):
    return default_context(spark, sf_dir).endpoints.select("trace_id", "host", "port", "start", "service_id", "removed", F.coalesce("since", F.lit(-1)).alias("since"), F.coalesce("until", F.lit(-1)).alias("until"))


# ---------------------------------------------------------------- pairing


def time_delta_tasks(spark, sf_dir):
    frame = default_context(spark, sf_dir).events
    begin, end = stats.scheduler_event("BeginEvent"), stats.scheduler_event("CompletionEvent")
    keys = [F.col("trace_id"), name_at("tree", "3.2.1.1.1").column.alias("stage"), name_at("tree", "3.2.1.1.2").column.alias("part")]
    return time_delta(frame, begin.column, end.column, keys)


def time_delta_first(spark, sf_dir):
    frame = event_rows(spark, sf_dir)
    return time_delta(
        frame, F.col("event_type") == "view", F.col("event_type") == "purchase", [F.col("user_id")], time=F.col("ms"), keep="first"
    )


def span_length_jvm(spark, sf_dir):
    return span_length(stats.span_marks(default_context(spark, sf_dir).events), "JVMStart")


def span_length_calls(spark, sf_dir):
    return span_length(stats.span_marks(default_context(spark, sf_dir).events), "Fn")


def span_pair(spark, sf_dir):
    # Kept, as starts and ends would each count and read the trees again.
    marks = keep(stats.span_marks(written(spark, sf_dir).withColumn("kind", name_at("tree", "3.0").column)))
    starts = marks.filter("opens").select("trace_id", "span_id", "uuid", F.col("ts").alias("start"))
    ends = marks.filter("NOT opens").select("trace_id", "span_id", F.col("ts").alias("end"))
    return span_pairs(starts, ends)


def order_ship_delta(spark, sf_dir):
    """Days from the order to its last shipment; negative where the data says so."""
    day = lambda column: F.datediff(column, F.lit("1970-01-01")).cast("bigint")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("orderkey"), F.lit("order").alias("what"), day("o_orderdate").alias("day")
    )
    shipped = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("orderkey"), F.lit("ship").alias("what"), day("l_shipdate").alias("day")
    )
    return time_delta(
        orders.unionByName(shipped), F.col("what") == "order", F.col("what") == "ship", [F.col("orderkey")], time=F.col("day")
    )


# ---------------------------------------------------------------- blocks and statistics


def block(which):
    return lambda spark, sf_dir: which.frame(default_context(spark, sf_dir))


def axes_ordered(spark, sf_dir):
    """Services of each trace, numbered in order of appearance."""
    return AXES.placed(default_context(spark, sf_dir)).select("trace", F.col("position").alias("place"), "name")


def statistic(which):
    def query(spark, sf_dir):
        ctx = default_context(spark, sf_dir)
        return which.extract(ctx.events, ctx.services).select("trace_id", "key", "value")

    return query


def stat_compare(spark, sf_dir):
    table = STAT_COUNT.frame(default_context(spark, sf_dir))
    wide = stats.compare(table, "Count", list(range(TRACES)))
    return wide.select("stat", F.col("0").alias("trace_0"), F.col("1").alias("trace_1"))


def registry_custom_stat(spark, sf_dir):
    """A statistic and a column of one's own: the spread of ``value`` per event type."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = ["click", "error", "purchase", "signup", "view"]
    sources = [
        stats.Statistic(
            name,
            lambda events, services, name=name: events.filter(F.col("event_type") == name).select(
                "trace_id", F.col("event_id").cast("string").alias("key"), "value"
            ),
        )
        for name in names
    ]
    spread = stats.StatColumn("spread", "num", lambda: F.max("value") - F.min("value"), 0.0)
    inputs = table.withColumn("trace_id", F.expr("cast(user_id % 2 AS int)"))
    shown = [stats.COUNT, *stats.QUARTILES, spread]
    made = stats.statistics_table(sources, shown, inputs, inputs.select("trace_id"))
    return made.toDF("trace", "stat", "n", "p0", "p25", "p50", "p75", "p100", "spread")


def stat_dist(spark, sf_dir):
    table = STAT_DIST.frame(default_context(spark, sf_dir))
    return table.toDF("trace", "stat", "p0", "p25", "p50", "p75", "p100", "min_at", "max_at")


def stat_dist_ordered(spark, sf_dir):
    """Where each statistic stands in the table: by trace, then as declared."""
    return STAT_DIST.placed(default_context(spark, sf_dir)).select("trace", F.col("position").alias("place"), "stat", F.col("100%").alias("largest"))


def stat_count(spark, sf_dir):
    return STAT_COUNT.frame(default_context(spark, sf_dir)).toDF("trace", "stat", "n")


def result_text(spark, sf_dir):
    ctx = default_context(spark, sf_dir)
    blocks = [TIME_RANGE, AXES, STAT_COUNT]
    return result_lines(blocks, {b.name: b.frame(ctx) for b in blocks}).select("block_no", "section", "line")


def result_read_back(spark, sf_dir):
    """Tables written as text and read again."""
    ctx = default_context(spark, sf_dir)
    blocks = [TIME_RANGE, AXES, RPCS, STAT_COUNT]
    target = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    write_result_text(blocks, {b.name: b.placed(ctx) for b in blocks}, target)
    tables = read_result(spark, target, ordered=False)
    none = F.lit(None).cast("string")
    shown = lambda name, number, *texts: tables[name].select(
        F.lit(name).alias("block"), number.cast("bigint").alias("n"), *[t.alias(f"c{i}") for i, t in enumerate([*texts, none, none, none][:3])]
    )
    time = F.unix_millis(F.col("time"))
    return (
        shown("timerange", time)
        .union(shown("axes", F.lit(None), F.col("name")))
        .union(shown("rpcs", time, F.col("origin"), F.col("destination"), F.col("content")))
        .union(shown("stat:count", F.col("Count"), F.col("trace").cast("int").cast("string"), F.col("stat")))
    )


QUERIES = {
    "trace_decode": trace_decode,
    "deep_decode": deep_decode,
    "trace_path_get": trace_path_get,
    "trace_render": trace_render,
    "trace_subtree": trace_subtree,
    "trace_is_defined": trace_is_defined,
    "tree_update": tree_update,
    "debug_dump": debug_dump,
    "case_parse": case_parse,
    "paren_parse": paren_parse,
    "paren_parse_shallow": paren_parse_shallow,
    "paren_reject": paren_reject,
    "document_lines": document_lines,
    "tokenize_documents": tokenize_documents,
    "quarantine": quarantine,
    "relative_time": relative_time,
    "trace_start": trace_start,
    "diagnose": diagnose,
    "filter_default": filter_default,
    "filter_cascade": filter_cascade,
    "filter_in": filter_in,
    "filter_regex": filter_regex,
    "filter_exists": filter_exists,
    "condition_columns": condition_columns,
    "format_events": format_events,
    "service_dim": service_dim,
    "service_fallback": service_fallback,
    "main_service": main_service,
    "endpoint_dim": endpoint_dim,
    "time_delta_tasks": time_delta_tasks,
    "time_delta_first": time_delta_first,
    "span_length_jvm": span_length_jvm,
    "span_length_calls": span_length_calls,
    "span_pair": span_pair,
    "order_ship_delta": order_ship_delta,
    "axes": block(AXES),
    "axes_ordered": axes_ordered,
    "rpcs": block(RPCS),
    "events_block": block(EVENTS),
    "spans": block(SPANS),
    "timerange": block(TIME_RANGE),
    "stat_jvm_start": statistic(stats.JVM_START_TIME),
    "stat_overhead": statistic(stats.OVERHEAD),
    "stat_rpcs_sent": statistic(stats.MESSAGES_SENT),
    "stat_executor_lifetime": statistic(stats.EXECUTOR_LIFETIME),
    "stat_task_duration": statistic(stats.TASK_DURATION),
    "stat_jvms": statistic(stats.JVMS),
    "stat_executors": statistic(stats.EXECUTORS),
    "stat_jobs": statistic(stats.JOBS),
    "stat_tasks": statistic(stats.TASKS),
    "stat_block_updates": statistic(stats.BLOCK_UPDATES),
    "stat_count": stat_count,
    "stat_dist": stat_dist,
    "stat_dist_ordered": stat_dist_ordered,
    "stat_compare": stat_compare,
    "registry_custom_stat": registry_custom_stat,
    "result_text": result_text,
    "result_read_back": result_read_back,
}
