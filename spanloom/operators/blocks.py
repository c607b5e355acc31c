"""The result tables of a run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import name_at, render
from .formats import Formatter
from .services import endpoints, listed_services, main_services, with_endpoint, with_main_service
from .stats import (
    ARG_MAX,
    ARG_MIN,
    COUNT,
    COUNT_STATISTICS,
    DISTRIBUTION_STATISTICS,
    QUARTILES,
    statistics_table,
)
from .pairing import span_pairs


@dataclass
class Context:
    """What blocks are made from: prepared events, resolved services, labels."""

    events: DataFrame
    services: DataFrame
    formatter: Formatter = field(default_factory=lambda: Formatter({}))

    @cached_property
    def mains(self) -> DataFrame:
        return main_services(self.services)

    @cached_property
    def endpoints(self) -> DataFrame:
        return endpoints(self.services)


@dataclass(frozen=True)
class Block:
    """A named table; column types are ``num``, ``time`` (milliseconds) or ``string``.

    ``order`` lists the columns rows are presented by.  What ``make`` returns may
    have numbers beside its declared columns for that (``trace``, ``position``).
    """

    name: str
    columns: Sequence[tuple[str, str]]
    make: Callable[[Context], DataFrame]
    order: Sequence[str] = ()

    def placed(self, ctx: Context) -> DataFrame:
        """The table with all columns it is ordered by."""
        return self.make(ctx)

    def shown(self, placed: DataFrame) -> DataFrame:
        return placed.select(*[f"`{name}`" for name, _type in self.columns])

    def frame(self, ctx: Context) -> DataFrame:
        """The table, its declared columns."""
        return self.shown(self.make(ctx))


def axes(ctx: Context) -> DataFrame:
    return listed_services(ctx.services).select(F.col("service_id").alias("name"), F.col("trace_id").alias("trace"), "position")


def rpcs(ctx: Context) -> DataFrame:
    # The payload is rendered before the joins: trees stay out of any shuffle.
    messages = ctx.events.filter(F.col("kind") == "RPC").select(
        "trace_id",
        "ts",
        name_at("tree", "3.1").column.alias("source"),
        name_at("tree", "3.2").column.alias("target"),
        render("tree", "3.3").column.alias("content"),
    )
    sent = with_endpoint(messages, ctx.endpoints, "source", "origin")
    return with_endpoint(sent, ctx.endpoints, "target", "destination").select(
        F.col("ts").alias("time"), "origin", "destination", "content"
    )


def events(ctx: Context) -> DataFrame:
    shown = ctx.events.filter(~F.col("kind").isin("SpanStart", "SpanEnd", "RPC", "Service"))
    labelled = ctx.formatter.label(shown, "content", at="3").select("trace_id", "uuid", "ts", "content")
    return with_main_service(labelled, ctx.mains).select(
        F.col("ts").alias("time"), F.col("service").alias("location"), "content"
    )


def spans(ctx: Context) -> DataFrame:
    opened = ctx.events.filter(F.col("kind") == "SpanStart")
    starts = ctx.formatter.label(opened, "content", at="3.2").select(
        "trace_id", name_at("tree", "3.1").column.alias("span_id"), "uuid", F.col("ts").alias("start"), "content"
    )
    ends = ctx.events.filter(F.col("kind") == "SpanEnd").select(
        "trace_id", name_at("tree", "3.1").column.alias("span_id"), F.col("ts").alias("end")
    )
    return with_main_service(span_pairs(starts, ends), ctx.mains).select(
        "start", "end", F.col("service").alias("location"), "content"
    )


def time_range(ctx: Context) -> DataFrame:
    # One row per JVM meets the services; messages are not looked at separately.
    per_jvm = ctx.events.groupBy("trace_id", "uuid").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    known = per_jvm.join(ctx.mains, ["trace_id", "uuid"], "left_semi")
    edges = known.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    both = F.array(F.coalesce("lo", F.lit(0)), F.coalesce("hi", F.lit(0)))
    return edges.select(F.explode(both.cast("array<bigint>")).alias("time"))


def statistics_block(identifier: str, stats: Sequence, columns: Sequence) -> Block:
    return Block(
        f"stat:{identifier}",
        [("trace", "num"), ("stat", "string"), *[(c.name, c.type) for c in columns]],
        lambda ctx: statistics_table(stats, columns, ctx.events, ctx.services, placed=True),
        order=("trace", "position"),
    )


# Names and columns of the result tables, which readers of results go by.
AXES = Block("axes", [("name", "string")], axes, order=("trace", "position"))
RPCS = Block(
    "rpcs",
    [("time", "time"), ("origin", "string"), ("destination", "string"), ("content", "string")],
    rpcs,
    order=("time", "origin", "destination"),
)
EVENTS = Block(
    "events", [("time", "time"), ("location", "string"), ("content", "string")], events, order=("time", "location")
)
SPANS = Block(
    "spans",
    [("start", "time"), ("end", "time"), ("location", "string"), ("content", "string")],
    spans,
    order=("start", "end"),
)
TIME_RANGE = Block("timerange", [("time", "time")], time_range, order=("time",))
STAT_COUNT = statistics_block("count", COUNT_STATISTICS, [COUNT])
STAT_DIST = statistics_block("dist", DISTRIBUTION_STATISTICS, [*QUARTILES, ARG_MIN, ARG_MAX])

#: Blocks by name; add your own to have :func:`~spanloom.plans.process_trace` make them.
BLOCKS: dict[str, Block] = {
    block.name: block for block in (TIME_RANGE, AXES, RPCS, EVENTS, SPANS, STAT_COUNT, STAT_DIST)
}
