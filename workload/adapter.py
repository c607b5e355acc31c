"""Trace lines made from the supplied ``events`` table, in the tracer's JSON format.

There are no traces among the supplied tables, so each row of ``events`` becomes
one trace line, and each user is a JVM that also starts, ends and reports its
overhead.  Bodies are written once as templates whose leaves are SQL that both
Spark and DuckDB read; the engine gets the JSON text, the checks get the leaves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACES = 2


@dataclass(frozen=True)
class Leaf:
    """A string; None is JSON null.  ``escape`` where it may hold quotes."""

    sql: str | None
    escape: bool = False


@dataclass(frozen=True)
class Tree:
    name: str
    children: tuple


def node(name: str, *children) -> Tree:
    return Tree(name, tuple(Leaf(c) if isinstance(c, str) or c is None else c for c in children))


SCHEDULER = "'org.apache.spark.scheduler.DAGSchedulerEventProcessLoop.doOnReceive(org.apache.spark.scheduler.DAGSchedulerEvent)'"
UPDATE = "'org.apache.spark.storage.BlockManagerMaster.updateBlockInfo(org.apache.spark.storage.BlockManagerId,long)'"

#: Two ports for three services: an address is registered by one service after the other.
PORT = "(40000 + event_id % 2)"
OWN = f"'/10.0.0.' || user_id || ':' || {PORT}"
PEER = f"'/10.0.0.' || ((user_id * 7 + event_id) % 150) || ':' || {PORT}"
SERVICE_NAME = "CASE event_id % 3 WHEN 0 THEN 'driverPropsFetcher' WHEN 1 THEN 'sparkExecutor' ELSE 'sparkDriver' END"
SPAN = "user_id || '-' || k"
STATE = "CASE WHEN k % 2 = 0 THEN 'RUNNING' ELSE 'FINISHED' END"
STAGE, PART = "(k % 7)", "(user_id % 50)"
TASK = f"'Task(' || {STAGE} || ',' || {PART} || ')'"
BLOCK_MANAGER = "'BlockManagerId(' || user_id || ', 10.0.0.' || user_id || ', ' || k || ')'"
LEVEL = "'StorageLevel(memory, deserialized(' || k || '), 1 replicas)'"


def scheduler_call(*event):
    return node("'Fn'", SCHEDULER, node("'TraversableOnce'", node(*event)), None)


def span_call(name: str, result: str | None):
    return node("'SpanStart'", SPAN, node("'Fn'", name, node("'TraversableOnce'", "CAST(k AS VARCHAR(20))", "'x'"), result))


#: What each event becomes: (name, condition, body).  Conditions exclude each other.
BODIES = [
    ("service", "event_type = 'signup'", node("'Service'", SERVICE_NAME, OWN)),
    ("heartbeat", "event_type = 'click' AND k % 10 = 0", node("'RPC'", PEER, OWN, node("'Heartbeat'", "CAST(k AS VARCHAR(20))"))),
    ("rpc_block", "event_type = 'click' AND k % 10 = 1", node("'RPC'", PEER, OWN, BLOCK_MANAGER)),
    ("rpc_update", "event_type = 'click' AND k % 10 = 2", node("'RPC'", PEER, OWN, node("'UpdateBlockInfo'", "'a'", "'b'", LEVEL))),
    ("rpc", "event_type = 'click' AND k % 10 > 2", node("'RPC'", PEER, OWN, node("'StatusUpdate'", "CAST(k AS VARCHAR(20))", "''", STATE))),
    ("span_env", "event_type = 'view' AND k % 3 = 0", span_call("'org.apache.spark.SparkContext.createSparkEnv(org.apache.spark.SparkConf,boolean)'", "'env'")),
    ("span_submit", "event_type = 'view' AND k % 3 = 1", span_call("'org.apache.spark.deploy.yarn.Client.submitApplication(int)'", "'app' || k")),
    ("span_other", "event_type = 'view' AND k % 3 = 2", span_call("'a.b.C.run(int,java.util.Map(x))'", None)),
    ("span_end", "event_type = 'purchase'", node("'SpanEnd'", SPAN)),
    ("begin", "event_type = 'error' AND event_id % 5 = 0", scheduler_call("'BeginEvent'", TASK, "'info'")),
    ("complete", "event_type = 'error' AND event_id % 5 = 1", scheduler_call("'CompletionEvent'", TASK, "'info'")),
    ("job", "event_type = 'error' AND event_id % 5 = 2 AND k % 2 = 0", scheduler_call("'JobSubmitted'", "CAST(k AS VARCHAR(20))")),
    ("executor", "event_type = 'error' AND event_id % 5 = 2 AND k % 2 = 1", scheduler_call("'ExecutorAdded'", "CAST(k AS VARCHAR(20))")),
    ("block", "event_type = 'error' AND event_id % 5 = 3", node("'Fn'", UPDATE, node("'TraversableOnce'", BLOCK_MANAGER, "'rdd_' || k", LEVEL), None)),
    ("variable", "event_type = 'error' AND event_id % 5 = 4", node("'LocalVariable'", "'a.b.C.run(int)'", "'props'", Leaf("props", escape=True))),
]
#: One line per JVM each: (name, time, body).
JVM_BODIES = [
    ("jvm_start", "lo", node("'SpanStart'", "'jvm' || user_id", node("'JVMStart'"))),
    ("jvm_started", "(lo + (user_id % 50 + 1) * 100)", node("'SpanEnd'", "'jvm' || user_id")),
    ("main_end", "(hi + 1)", node("'MainEnd'")),
    ("overhead", "(hi + 2)", node("'InstrumentOverhead'", "CAST(user_id % 17 AS VARCHAR(20))")),
]


def envelope(body: Tree, time: str = "ms") -> Tree:
    return node("'Tuple3'", "'u' || user_id", f"CAST({time} AS VARCHAR(20))", body)


def json_sql(tree) -> str:
    """Spark SQL for the JSON text of a template."""
    if isinstance(tree, Tree):
        fields = " || ',' || ".join(map(json_sql, tree.children)) or "''"
        return f"""'{{"type":"' || {tree.name} || '","fields":[' || {fields} || ']}}'"""
    if tree.sql is None:
        return "'null'"
    text = f"({tree.sql})"
    if tree.escape:
        text = f"""replace(replace({text}, '\\\\', '\\\\\\\\'), '"', '\\\\"')"""
    return f"""'"' || {text} || '"'"""


#: Most rows of ``events`` for one task; a row is decoded in some tenths of a millisecond.
ROWS = 50_000


def tasks_for(frame: DataFrame, rows: int = ROWS) -> int:
    """Tasks that get so many rows each, and at least one a core; Parquet counts its rows without reading them."""
    return max(frame.sparkSession.sparkContext.defaultParallelism, math.ceil(frame.count() / rows))


def dealt(frame: DataFrame, rows: int = ROWS) -> DataFrame:
    """A table with at least as many splits as there are cores, and as keep each at so many rows.

    The work per row is more than its few bytes suggest, so a table whose
    splits are too few or too long is dealt out, by a number that adaptive
    execution leaves alone.  One with splits enough is not shuffled.
    """
    tasks = tasks_for(frame, rows)
    return frame if frame.rdd.getNumPartitions() >= tasks else frame.repartition(tasks)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the columns the templates use; ``ms`` reads ``ts`` as UTC."""
    return _columns(dealt(spark.read.parquet(f"{sf_dir}/events.parquet")))


def _columns(events: DataFrame) -> DataFrame:
    wall = "from_utc_timestamp(cast(ts AS timestamp), current_timezone())"
    return events.select(
        "event_id",
        "user_id",
        "event_type",
        "props",
        F.expr("cast(user_id % 2 AS int)").alias("trace_id"),
        F.expr(f"unix_millis({wall})").alias("ms"),
        F.expr("cast(get_json_object(props, '$.k') AS bigint)").alias("k"),
    )


def trace_lines(spark: SparkSession, sf_dir: str, services: bool = True) -> DataFrame:
    """``(trace_id, line)``: a line per event and four per user."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    events, read = event_rows(spark, sf_dir), _columns(table)
    if not services:
        events, read = (e.filter("event_type != 'signup'") for e in (events, read))
    whens = " ".join(f"WHEN {condition} THEN {json_sql(envelope(body))}" for _n, condition, body in BODIES)
    own = events.select("trace_id", F.expr(f"CASE {whens} END").alias("line"))
    # Times of JVMs need no dealing; what is decoded per JVM does.
    jvms = read.groupBy("trace_id", "user_id").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi")).repartition(tasks_for(table))
    lives = F.array(*[F.expr(json_sql(envelope(body, time))) for _n, time, body in JVM_BODIES])
    return own.unionByName(jvms.select("trace_id", F.explode(lives).alias("line")))
