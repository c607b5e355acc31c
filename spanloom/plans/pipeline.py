"""From trace lines to result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import S, debug_text, name_at, name_is
from ..operators.blocks import BLOCKS, Block, Context
from ..operators.formats import Formatter
from ..operators.rules import case_parse, keeps
from ..operators.services import endpoints, host_of, port_of, resolve_endpoint, resolve_services
from ..sources.results import write_blocks, write_dump, write_result_text
from ..sources.store import keep
from ..sources.traces import decode_events, read_lines, relative_time, trace_starts
from .config import TraceConfig


def base_events(lines: DataFrame, mode: str = "DROPMALFORMED") -> DataFrame:
    """Decoded events with time relative to the start of their trace, as written.

    Lines are read and decoded once; the starts of the traces are those of the
    events that were accepted.
    """
    events = keep(decode_events(lines, mode))
    return relative_time(events, trace_starts(events))


def prepare(events: DataFrame, config: TraceConfig) -> DataFrame:
    """Apply the rules: ``(trace_id, uuid, ts, kind, kept, service_name, service_address, tree, faults)``.

    Services are announced by the events as they were written, so their name
    and address are read before the rules; ``kept`` is the verdict of the event
    filters, which see the rewritten tree.
    """
    announces = name_is("tree", "3.0", "Service")
    announced = events.select(
        "trace_id",
        "uuid",
        "ts",
        S.when(announces, name_at("tree", "3.1")).column.alias("service_name"),
        S.when(announces, name_at("tree", "3.2")).column.alias("service_address"),
        "tree",
    )
    rewritten = case_parse(announced, config.case_parse, strict=config.strict)
    return rewritten.select(
        "trace_id",
        "uuid",
        "ts",
        S.coalesce(name_at("tree", "3.0"), "").column.alias("kind"),
        keeps(config.filters, S.col("tree")).column.alias("kept"),
        "service_name",
        "service_address",
        "tree",
        "faults",
    )


def context(prepared: DataFrame, config: TraceConfig) -> Context:
    return Context(
        events=prepared.filter("kept").select("trace_id", "uuid", "ts", "kind", "tree"),
        services=resolve_services(prepared, config.remove_services),
        formatter=Formatter.from_targets(config.targets),
    )


def kept_context(prepared: DataFrame, config: TraceConfig) -> Context:
    """A context whose events and services are computed once."""
    ready = context(keep(prepared, "kept", "kind"), config)
    return Context(ready.events, keep(ready.services), ready.formatter)


def open_traces(
    spark: SparkSession, directories: Sequence[str], config: TraceConfig, mode: str = "FAILFAST"
) -> Context:
    """Read, decode and rewrite trace directories for use by any number of blocks.

    The prepared events are computed once, laid out by trace and kind: a block
    then reads the kinds and columns it needs.  Services are kept too.
    """
    events = base_events(read_lines(spark, directories), mode)
    return kept_context(prepare(events, config), config)


def process_trace(
    spark: SparkSession,
    directories: Sequence[str],
    config: TraceConfig,
    result: str | None = None,
    blocks: Sequence[Block] | None = None,
    mode: str = "FAILFAST",
) -> dict[str, DataFrame]:
    """All result tables of one or more traces; written under ``result`` if given."""
    ctx = open_traces(spark, directories, config, mode)
    chosen = list(blocks if blocks is not None else BLOCKS.values())
    frames = {block.name: block.placed(ctx) for block in chosen}
    if result is not None:
        # Computed once for both forms, and for whoever reads them next.
        frames = {name: keep(frame) for name, frame in frames.items()}
        write_blocks(chosen, frames, result)
        write_result_text(chosen, frames, f"{result}/text")
    return {block.name: block.shown(frames[block.name]) for block in chosen}


def dump_trace(
    spark: SparkSession, directories: Sequence[str], config: TraceConfig, result: str | None = None, mode: str = "FAILFAST"
) -> DataFrame:
    """Filtered and rewritten events as debug text, one row each."""
    events = base_events(read_lines(spark, directories), mode)
    text = prepare(events, config).filter("kept").select(debug_text("tree").column.alias("value"))
    if result is not None:
        write_dump(text, result)
    return text


def run(spark: SparkSession, config: TraceConfig, comparisons: Sequence[str] = ()) -> object:
    """Run as configured: ``props.traceout``, ``props.result`` and ``props.mode``."""
    directories = [config.prop("traceout"), *comparisons]
    mode = config.prop("mode", required=False) or "process"
    if mode == "process":
        return process_trace(spark, directories, config, config.prop("result"))
    if mode == "dump":
        return dump_trace(spark, directories, config, config.prop("result"))
    raise ValueError(f"unknown mode {mode!r}")


#: What diagnostics count, per trace.
COUNTERS = ("events", "without_service", "with_rule_faults", "unknown_address", "removed_address", "bad_registration", "corrupt_lines")


def diagnostics(prepared: DataFrame, services: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """Per trace, what the result tables leave out and why.

    ``events`` in all; ``without_service`` of a JVM that has none to show;
    ``with_rule_faults``; messages that pass the filters but not to the table,
    as an address is unknown (``unknown_address``) or belongs to a removed
    service (``removed_address``, both addresses known); announcements of
    services whose address cannot be read (``bad_registration``); and
    ``corrupt_lines``, counted in ``decoded``, which is what
    :func:`~spanloom.sources.decode_events` yields in PERMISSIVE mode.
    ``services`` are those of :func:`~spanloom.operators.services.resolve_services`.
    """

    def counted(frame: DataFrame, **counts: Column) -> DataFrame:
        made = [F.sum(counts.get(name, F.lit(0)).cast("bigint")).alias(name) for name in COUNTERS]
        return frame.groupBy("trace_id").agg(*made)

    # Reduced to one row per JVM before it meets the services.
    announced = F.col("service_name").isNotNull() | F.col("service_address").isNotNull()
    readable = F.col("service_name").isNotNull() & host_of(F.col("service_address")).isNotNull() & port_of(F.col("service_address")).isNotNull()
    per_jvm = prepared.groupBy("trace_id", "uuid").agg(
        F.count("*").alias("n"),
        F.sum((F.size("faults") > 0).cast("bigint")).alias("faulty"),
        F.sum((announced & ~F.coalesce(readable, F.lit(False))).cast("bigint")).alias("bad"),
    )
    known = services.filter(~F.col("removed")).select("trace_id", "uuid", F.lit(True).alias("known")).distinct()
    jvms = per_jvm.join(known, ["trace_id", "uuid"], "left")
    parts = [
        counted(
            jvms,
            events=F.col("n"),
            without_service=F.when(F.col("known").isNull(), F.col("n")).otherwise(0),
            with_rule_faults=F.col("faulty"),
            bad_registration=F.col("bad"),
        )
    ]
    # The join of the message table, kept open on its other side.
    messages = prepared.filter(F.col("kept") & (F.col("kind") == "RPC")).select(
        "trace_id", "ts", name_at("tree", "3.1").column.alias("source"), name_at("tree", "3.2").column.alias("target")
    )
    ends = endpoints(services)
    both = resolve_endpoint(resolve_endpoint(messages, ends, "source", "source"), ends, "target", "target")
    unknown = F.col("source").isNull() | F.col("target").isNull()
    parts.append(counted(both, unknown_address=unknown, removed_address=~unknown & (F.col("source.removed") | F.col("target.removed"))))
    if decoded is not None:
        parts.append(counted(decoded, corrupt_lines=F.col("corrupt").isNotNull()))
    together = reduce(DataFrame.unionByName, parts)
    return together.groupBy("trace_id").agg(*[F.sum(name).alias(name) for name in COUNTERS])
