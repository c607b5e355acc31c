"""From JVM ids and addresses to named services.

``services`` has one row per registration: ``(trace_id, uuid, host, port, name,
start, service_id, removed)``.  It is built from the events as they were
written, before rules touch them, and is small: a JVM registers a few services.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered

_ADDRESS = r"^[^/]*/([^:/]*):(\d+)(?:[:/].*)?$"


def host_of(address: Column) -> Column:
    """``ip`` of ``name/ip:port``; NULL when it is not an address."""
    return F.when(address.rlike(_ADDRESS), F.regexp_extract(address, _ADDRESS, 1))


def port_of(address: Column) -> Column:
    return F.regexp_extract(address, _ADDRESS, 2).try_cast("int")


def service_id() -> Column:
    full = F.concat_ws(" ", F.col("host"), F.col("port").cast("string"), F.col("name"))
    return F.when(F.col("host") != "", full).otherwise(F.col("name"))


def removed_by(patterns: Sequence[str], service: Column) -> Column:
    """Whether any pattern matches the whole service id; each is matched by itself, so its back-references are its own."""
    found = F.lit(False)
    for pattern in patterns:
        found = found | service.rlike(rf"\A(?:{pattern})\z")
    return found


def registrations(events: DataFrame) -> DataFrame:
    """One row per service a JVM announced, with the time it first did."""
    address = F.col("service_address")
    return (
        events.filter(F.col("service_name").isNotNull() & address.isNotNull())
        .select(
            "trace_id",
            "uuid",
            host_of(address).alias("host"),
            port_of(address).alias("port"),
            F.col("service_name").alias("name"),
            "ts",
        )
        .filter(F.col("host").isNotNull() & F.col("port").isNotNull())
        .groupBy("trace_id", "uuid", "host", "port", "name")
        .agg(F.min("ts").alias("start"))
    )


def stand_ins(events: DataFrame, registered: DataFrame) -> DataFrame:
    """One pseudo-service per JVM for traces in which nothing registered."""
    known = registered.select("trace_id").distinct()
    jvms = (
        events.select("trace_id", "uuid", "ts")
        .groupBy("trace_id", "uuid")
        .agg(F.min("ts").alias("start"))
        .join(known, "trace_id", "left_anti")
    )
    # JVMs are counted per second of their start, and put in order within one.
    placed = numbered(jvms, ["trace_id"], F.floor(F.col("start") / 1000), ["start", "uuid"], "place")
    return placed.select(
        "trace_id",
        "uuid",
        F.lit("").alias("host"),
        F.col("place").cast("int").alias("port"),
        F.col("uuid").alias("name"),
        "start",
    )


def resolve_services(events: DataFrame, remove: Sequence[str] = ()) -> DataFrame:
    registered = registrations(events)
    rows = registered.unionByName(stand_ins(events, registered))
    return rows.withColumn("service_id", service_id()).withColumn(
        "removed", removed_by(remove, F.col("service_id"))
    )


def main_services(services: DataFrame) -> DataFrame:
    """The service a JVM stands for: the first it started that is not removed."""
    first = F.min_by(F.struct("service_id", "name"), F.struct("start", "port", "host", "name"))
    return (
        services.filter(~F.col("removed"))
        .groupBy("trace_id", "uuid")
        .agg(first.alias("main"))
        .select("trace_id", "uuid", F.col("main.service_id").alias("service"), F.col("main.name").alias("service_kind"))
    )


def endpoints(services: DataFrame) -> DataFrame:
    """One row per registration, with the time it is in force: ``since`` up to before ``until``.

    An address names the service that last registered it.  The first
    registration reaches back without end (``since`` is null), the last one on
    (``until`` is null).  Of several at one time the last by JVM and name
    stays.  A window holds the registrations of one address.
    """
    of_address = Window.partitionBy("trace_id", "host", "port").orderBy("start", "uuid", "name")
    return services.select(
        "trace_id",
        "host",
        "port",
        "start",
        "service_id",
        "removed",
        "uuid",
        "name",
        F.when(F.lag("start").over(of_address).isNotNull(), F.col("start")).alias("since"),
        F.lead("start").over(of_address).alias("until"),
    )


def listed_services(services: DataFrame) -> DataFrame:
    """The services to show, each once per trace; ``position`` counts them from 0 in order of appearance."""
    shown = services.filter(~F.col("removed")).groupBy("trace_id", "service_id").agg(F.min("start").alias("start"))
    placed = numbered(shown, ["trace_id"], F.floor(F.col("start") / 1000), ["start", "service_id"], "position")
    return placed.select("trace_id", "start", "service_id", "position").orderBy("trace_id", "position")


def with_main_service(events: DataFrame, mains: DataFrame) -> DataFrame:
    """Attach the main service of each event's JVM; events without one are dropped."""
    return events.join(mains, ["trace_id", "uuid"], "inner")


#: Before any time of a trace: the first registration of an address reaches back without end.
_ALWAYS = -(1 << 63)


def holders(ends: DataFrame) -> DataFrame:
    """One row per address: who ``held`` it from when on, in order."""
    since = F.coalesce("since", F.lit(_ALWAYS)).alias("since")
    return ends.groupBy(
        "trace_id", F.col("host").alias("_host"), F.col("port").alias("_port")
    ).agg(F.sort_array(F.collect_list(F.struct(since, "uuid", "name", "service_id", "removed"))).alias("_held"))


def resolve_endpoint(messages: DataFrame, ends: DataFrame, address: str, out: str) -> DataFrame:
    """Find who holds an address at the time of the message: ``out`` is ``STRUCT<service_id, removed>``, NULL if nobody ever did.

    An address meets the messages as one row, however often it was registered,
    so the join yields as many rows as there are messages; the registration in
    force is then looked up within that row.
    """
    located = messages.withColumn("_host", host_of(F.col(address))).withColumn("_port", port_of(F.col(address)))
    found = located.join(holders(ends), ["trace_id", "_host", "_port"], "left")
    latest = F.array_max(F.filter("_held", lambda h: h["since"] <= F.col("ts")))
    named = F.struct(latest["service_id"].alias("service_id"), latest["removed"].alias("removed"))
    return found.withColumn(out, F.when(F.col("_held").isNotNull(), named)).drop("_host", "_port", "_held")


def with_endpoint(messages: DataFrame, ends: DataFrame, address: str, out: str) -> DataFrame:
    """Resolve an address column to the service that holds it at the time of the message.

    Messages to removed services and to addresses that nothing registered are
    dropped; :func:`spanloom.plans.diagnostics` counts them.
    """
    found = resolve_endpoint(messages, ends, address, out)
    return found.filter(F.col(f"{out}.removed") == F.lit(False)).withColumn(out, F.col(f"{out}.service_id"))
