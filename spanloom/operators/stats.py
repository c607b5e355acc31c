"""Per-trace statistics: sources of (key, value) pairs, and columns that summarise them.

All statistics of a table are summarised together: their pairs form one
``(trace_id, stat, key, value)`` DataFrame, aggregated once, instead of one
pass per trace and statistic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Expr, S, column, name_at, name_is
from ..sources.store import keep
from .pairing import span_length
from .services import main_services, with_main_service

# The names the tracer gives to what is counted here.
SCHEDULER_LOOP = "org.apache.spark.scheduler.DAGSchedulerEventProcessLoop.doOnReceive"
BLOCK_UPDATE = "org.apache.spark.storage.BlockManagerMaster.updateBlockInfo"
EXECUTOR = "sparkExecutor"
NO_KEY = "()"

Extract = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Statistic:
    """Any source: ``extract(events, services)`` gives ``(trace_id, key, value)``."""

    name: str
    extract: Extract


@dataclass(frozen=True)
class PointStatistic:
    """One pair per event that satisfies ``where``.  All of these share one scan, of the kinds they name."""

    name: str
    where: Callable[[], Expr | Column]
    key: Callable[[], Expr | Column] = lambda: F.lit(NO_KEY)
    value: Callable[[], Expr | Column] = lambda: F.lit(0.0)
    #: Kinds of events that ``where`` can hold for; empty if it may be any.
    kinds: Sequence[str] = ()

    def extract(self, events: DataFrame, services: DataFrame) -> DataFrame:
        return _point_values([self], events).drop("stat")


@dataclass(frozen=True)
class PairStatistic:
    """Seconds between start and end events per key.  All of these share one scan, of the kinds they name.

    With ``service`` the key must be a JVM id; the pair is then reported under
    the main service of the JVM, if ``service`` accepts its name.
    """

    name: str
    start: Callable[[], Expr | Column]
    end: Callable[[], Expr | Column]
    key: Callable[[], Expr | Column]
    service: Callable[[Column], Column] | None = None
    #: Kinds of events that can be a start or an end; empty if any can.
    kinds: Sequence[str] = ()

    def extract(self, events: DataFrame, services: DataFrame) -> DataFrame:
        return _pair_values([self], events, services).drop("stat")


# --------------------------------------------------------------------------
# predicates on events


def of_kind(*kinds: str) -> Expr:
    return S.col("kind").isin(*kinds)


def call_of(function: str) -> Expr:
    """Calls of a function; its arguments are at ``3.2``."""
    return of_kind("Fn") & name_is("tree", "3.1.0", function)


def scheduler_event(name: str) -> Expr:
    """Scheduler-loop calls whose first argument is an event of this type."""
    return call_of(SCHEDULER_LOOP) & name_is("tree", "3.2.1.0", name)


def jvm_start() -> Expr:
    return of_kind("SpanStart") & name_is("tree", "3.2.0", "JVMStart")


def span_marks(events: DataFrame) -> DataFrame:
    """Starts and ends of spans in the shape :func:`span_length` takes."""
    return events.filter(of_kind("SpanStart", "SpanEnd").column).select(
        "trace_id",
        "uuid",
        "ts",
        name_at("tree", "3.1").column.alias("span_id"),
        name_at("tree", "3.2").column.alias("span_name"),
        of_kind("SpanStart").column.alias("opens"),
    )


# --------------------------------------------------------------------------
# the statistics


def _jvm_start_time(events: DataFrame, services: DataFrame) -> DataFrame:
    # Only marks of the named spans, a start and an end per JVM, meet the services.
    mains = main_services(services).select("trace_id", "uuid", F.col("service").alias("key"))
    lengths = span_length(span_marks(events), "JVMStart", part=lambda mine: mine.join(mains, ["trace_id", "uuid"]))
    return lengths.select("trace_id", "key", (F.col("delta") / 1000.0).alias("value"))


def _overhead(events: DataFrame, services: DataFrame) -> DataFrame:
    rows = events.filter(of_kind("InstrumentOverhead").column).select(
        "trace_id", "uuid", name_at("tree", "3.1").try_cast("int").column.alias("ms")
    )
    return with_main_service(rows, main_services(services)).select(
        "trace_id", F.col("service").alias("key"), (F.col("ms") / 1000.0).alias("value")
    )


def _messages_sent(events: DataFrame, services: DataFrame) -> DataFrame:
    # Counted per JVM first: what meets the services is one row per JVM.
    per_jvm = events.filter(of_kind("RPC").column).groupBy("trace_id", "uuid").agg(F.count("*").alias("n"))
    return (
        with_main_service(per_jvm, main_services(services))
        .groupBy("trace_id", F.col("service").alias("key"))
        .agg(F.sum("n").cast("double").alias("value"))
    )


def _task_key() -> Expr:
    stage, partition = name_at("tree", "3.2.1.1.1"), name_at("tree", "3.2.1.1.2")
    return S.concat("(", stage, ",", partition, ")")


def _tasks(name: str) -> PairStatistic:
    return PairStatistic(
        name,
        start=lambda: scheduler_event("BeginEvent"),
        end=lambda: scheduler_event("CompletionEvent"),
        key=_task_key,
        kinds=("Fn",),
    )


JVM_START_TIME = Statistic("JVM start time", _jvm_start_time)
EXECUTOR_LIFETIME = PairStatistic(
    "Executor lifetime",
    start=jvm_start,
    end=lambda: of_kind("MainEnd"),
    key=lambda: F.col("uuid"),
    service=lambda name: name == EXECUTOR,
    kinds=("SpanStart", "MainEnd"),
)
TASK_DURATION = _tasks("Task duration")
# Events are logged by the receiving JVM, so this counts what each service received.
MESSAGES_SENT = Statistic("RPCs sent", _messages_sent)
OVERHEAD = Statistic("Instr Overhead", _overhead)
JVMS = PointStatistic("JVMs", where=jvm_start, kinds=("SpanStart",))
EXECUTORS = PointStatistic("Executors", where=lambda: scheduler_event("ExecutorAdded"), kinds=("Fn",))
JOBS = PointStatistic("Jobs", where=lambda: scheduler_event("JobSubmitted"), kinds=("Fn",))
TASKS = _tasks("Tasks")
BLOCK_UPDATES = PointStatistic(
    "Block updates", where=lambda: call_of(BLOCK_UPDATE), key=lambda: F.col("ts").cast("string"), kinds=("Fn",)
)

COUNT_STATISTICS = (JVMS, EXECUTORS, JOBS, TASKS, BLOCK_UPDATES)
DISTRIBUTION_STATISTICS = (JVM_START_TIME, EXECUTOR_LIFETIME, TASK_DURATION, MESSAGES_SENT, OVERHEAD)

#: Statistics by name; add your own to make them available to tables built by name.
STATISTICS: dict[str, Statistic | PointStatistic | PairStatistic] = {
    s.name: s for s in (*COUNT_STATISTICS, *DISTRIBUTION_STATISTICS)
}


# --------------------------------------------------------------------------
# extraction


def _of_kinds(stats: Sequence[PointStatistic | PairStatistic], events: DataFrame) -> DataFrame:
    """Events that any of the statistics can use, as a plain filter that reaches the scan."""
    if not all(s.kinds for s in stats):
        return events
    return events.filter(F.col("kind").isin(*sorted({k for s in stats for k in s.kinds})))


def _fan_out(events: DataFrame, own: Sequence[str], made: Sequence[Column]) -> DataFrame:
    """One row per non-NULL struct of ``made``, from a single scan."""
    facts = F.filter(F.array(*made), lambda f: f.isNotNull())
    return events.select(*own, F.explode(facts).alias("f")).select(*own, "f.*")


def _point_values(stats: Sequence[PointStatistic], events: DataFrame) -> DataFrame:
    made = [
        F.when(
            column(s.where()),
            F.struct(
                F.lit(s.name).alias("stat"),
                column(s.key()).cast("string").alias("key"),
                column(s.value()).cast("double").alias("value"),
            ),
        )
        for s in stats
    ]
    return _fan_out(_of_kinds(stats, events), ["trace_id"], made)


def _pair_values(stats: Sequence[PairStatistic], events: DataFrame, services: DataFrame) -> DataFrame:
    time = F.col("ts")
    made = []
    for s in stats:
        start, end, key = column(s.start()), column(s.end()), column(s.key())
        mark = F.struct(
            F.lit(s.name).alias("stat"),
            key.cast("string").alias("key"),
            F.when(start, time).alias("start"),
            F.when(end, time).alias("end"),
        )
        made.append(F.when((start | end) & key.isNotNull(), mark))
    pairs = (
        _fan_out(_of_kinds(stats, events), ["trace_id"], made)
        .groupBy("trace_id", "stat", "key")
        .agg(F.max("start").alias("start"), F.max("end").alias("end"))
        .filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    )
    by_service = [s for s in stats if s.service is not None]
    if by_service:
        mains = main_services(services).withColumnRenamed("uuid", "jvm")
        needs = F.col("stat").isin(*[s.name for s in by_service])
        jvm = F.when(needs, F.col("key"))
        accepted = ~needs
        for s in by_service:
            accepted = accepted | ((F.col("stat") == s.name) & s.service(F.col("service_kind")))
        pairs = (
            pairs.withColumn("jvm", jvm)
            .join(mains, ["trace_id", "jvm"], "left")
            .filter(accepted)
            .withColumn("key", F.when(needs, F.col("service")).otherwise(F.col("key")))
        )
    return pairs.select(
        "trace_id", "stat", "key", ((F.col("end") - F.col("start")) / 1000.0).alias("value")
    )


def statistic_values(stats: Sequence, events: DataFrame, services: DataFrame) -> DataFrame:
    """``(trace_id, stat, key, value)`` of all pairs of all statistics."""
    points = [s for s in stats if isinstance(s, PointStatistic)]
    pairs = [s for s in stats if isinstance(s, PairStatistic)]
    parts = []
    if points:
        parts.append(_point_values(points, events))
    if pairs:
        parts.append(_pair_values(pairs, events, services))
    for s in stats:
        if not isinstance(s, (PointStatistic, PairStatistic)):
            found = s.extract(events, services)
            parts.append(
                found.select(
                    "trace_id",
                    F.lit(s.name).alias("stat"),
                    F.col("key").cast("string").alias("key"),
                    F.col("value").cast("double").alias("value"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


# --------------------------------------------------------------------------
# columns


@dataclass(frozen=True)
class StatColumn:
    """An aggregate over the pairs of one statistic.

    ``aggregate`` sees the columns ``key`` and ``value``.  The built-in columns
    set ``distinct``: they see one row per distinct ``value`` with its count
    ``n`` and the ``first_key`` and ``last_key`` that have it.
    """

    name: str
    type: str
    aggregate: Callable[[], Column]
    empty: object = field(default=None)
    distinct: bool = False


@dataclass(frozen=True)
class Percentile:
    """Nearest rank: the smallest value with at least ``p`` percent at or below it."""

    p: float

    @property
    def name(self) -> str:
        return f"{self.p:g}%"

    type: str = "num"
    empty: object = 0.0


COUNT = StatColumn("Count", "num", lambda: F.sum("n"), 0, distinct=True)
ARG_MIN = StatColumn(
    "Min at", "string", lambda: F.min_by("first_key", "value"), "", distinct=True
)
ARG_MAX = StatColumn(
    "Max at", "string", lambda: F.max_by("last_key", "value"), "", distinct=True
)
QUARTILES = tuple(Percentile(p) for p in (0, 25, 50, 75, 100))

#: Columns by name; add your own.
STAT_COLUMNS: dict[str, StatColumn | Percentile] = {
    c.name: c for c in (COUNT, *QUARTILES, ARG_MIN, ARG_MAX)
}

# Values this close, relative to themselves, are ranked together (2^(1/1024)).
_BANDS = 1024


def nearest_ranks(
    counted: DataFrame, groups: Sequence[str], percentiles: Sequence[float], value: str = "value", n: str = "n"
) -> DataFrame:
    """``(groups…, p, value)``: exact nearest-rank percentiles of counted distinct values.

    A group is never sorted as a whole.  Its values fall into narrow bands in
    order of size; counts per band tell which band holds each rank, and only
    the values of that one band are put in order.  Bands are narrow relative
    to the values themselves, so tiny and huge values split alike: 2^-1080 to
    2^1024 in steps of 2^(1/1024), on both sides of zero.
    """
    v = F.col(value).cast("double")
    size = F.floor((F.log2(F.abs(v)) + 1080.0) * _BANDS) + 1
    band = F.when(v == 0, F.lit(0).cast("bigint")).otherwise(F.signum(v).cast("bigint") * size)
    banded = counted.withColumn("band", band)
    in_order = Window.partitionBy(*groups).orderBy("band")
    bands = (
        banded.groupBy(*groups, "band")
        .agg(F.sum(n).alias("rows"))
        .withColumn("upto", F.sum("rows").over(in_order))
        .withColumn("total", F.sum("rows").over(Window.partitionBy(*groups)))
    )
    ranks = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("p"),
                F.greatest(F.ceil(F.lit(p / 100.0) * F.col("total")), F.lit(1)).alias("rank"),
            )
            for p in percentiles
        ]
    )
    wanted = (
        bands.withColumn("r", F.explode(ranks))
        .filter((F.col("r.rank") > F.col("upto") - F.col("rows")) & (F.col("r.rank") <= F.col("upto")))
        .select(*groups, "band", "r.p", (F.col("r.rank") - F.col("upto") + F.col("rows")).alias("within"))
    )
    within_band = Window.partitionBy(*groups, "p").orderBy(value)
    return (
        banded.join(wanted, [*groups, "band"], "inner")
        .withColumn("reached", F.sum(n).over(within_band))
        .filter(F.col("reached") >= F.col("within"))
        .groupBy(*groups, "p")
        .agg(F.min(value).alias(value))
    )


def statistics_table(
    stats: Sequence, columns: Sequence[StatColumn | Percentile], events: DataFrame, services: DataFrame, placed: bool = False
) -> DataFrame:
    """``(trace, stat, <columns>)``, a row for every trace and statistic, in declared order; with its ``position`` if ``placed``."""
    values = statistic_values(stats, events, services)
    return summarise(values, [s.name for s in stats], columns, services.select("trace_id"), placed)


def summarise(
    values: DataFrame, names: Sequence[str], columns: Sequence[StatColumn | Percentile], traces: DataFrame, placed: bool = False
) -> DataFrame:
    group = ["trace_id", "stat"]
    # Distinct values are combined before they are shuffled, however often they
    # occur.  Kept, since both the totals and the ranks are made from them.
    counted = values.groupBy(*group, "value").agg(
        F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key")
    )
    ranked = [c for c in columns if isinstance(c, Percentile)]
    totals = [c for c in columns if isinstance(c, StatColumn) and c.distinct]
    custom = [c for c in columns if isinstance(c, StatColumn) and not c.distinct]
    if ranked and totals:
        counted = keep(counted)

    labels = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("stat")) for i, n in enumerate(names)])
    table = traces.distinct().select("trace_id", F.explode(labels).alias("s")).select("trace_id", "s.*")
    for frame, own in ((counted, totals), (values, custom)):
        if own:
            table = table.join(frame.groupBy(*group).agg(*[c.aggregate().alias(c.name) for c in own]), group, "left")
    if ranked:
        ranks = nearest_ranks(counted, group, [c.p for c in ranked])
        wide = ranks.groupBy(*group).agg(
            *[F.max(F.when(F.col("p") == float(c.p), F.col("value"))).alias(c.name) for c in ranked]
        )
        table = table.join(wide, group, "left")
    shown = []
    for c in columns:
        column = F.col(f"`{c.name}`")
        shown.append((column if c.empty is None else F.coalesce(column, F.lit(c.empty))).alias(c.name))
    place = [F.col("ord").alias("position")] if placed else []
    return table.orderBy("trace_id", "ord").select(F.col("trace_id").alias("trace"), "stat", *shown, *place)


def compare(table: DataFrame, column: str, traces: Sequence[int]) -> DataFrame:
    """One row per statistic with a column per trace, for reading runs side by side."""
    return table.groupBy("stat").pivot("trace", list(traces)).agg(F.first(column))
