"""Matching starts with ends.

Where one duration per key is wanted, no join is needed: the last start and
the last end of a key come out of one aggregation with map-side combine, so a
key that holds a third of the rows costs one partial result per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import keep

KEEP = ("last", "first", "all")


def time_delta(
    rows: DataFrame,
    start: Column,
    end: Column,
    keys: Sequence[Column],
    time: Column | None = None,
    keep: str = "last",
) -> DataFrame:
    """``(keys…, start, end, delta)`` of keys that have both a start and an end.

    ``keep`` decides between several starts or ends of one key: the latest of
    each, the earliest of each, or every combination.
    """
    if keep not in KEEP:
        raise ValueError(f"keep must be one of {KEEP}")
    time = F.col("ts") if time is None else time
    present = keys[0].isNotNull()
    for key in keys[1:]:
        present = present & key.isNotNull()
    if keep == "all":
        side = lambda when, name: rows.filter(when & present).select(*keys, time.alias(name))
        starts, ends = side(start, "start"), side(end, "end")
        names = [name for name in starts.columns if name != "start"]
        pairs = starts.join(ends, names, "inner")
    else:
        pick = F.max if keep == "last" else F.min
        marked = rows.filter(present & (start | end)).select(
            *keys, F.when(start, time).alias("start"), F.when(end, time).alias("end")
        )
        names = [name for name in marked.columns if name not in ("start", "end")]
        pairs = (
            marked.groupBy(*names)
            .agg(pick("start").alias("start"), pick("end").alias("end"))
            .filter(F.col("start").isNotNull() & F.col("end").isNotNull())
        )
    return pairs.withColumn("delta", F.col("end") - F.col("start"))


def span_length(marks: DataFrame, span_name: str, part: str | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Lengths of the spans with a given name: ``(trace_id, key, start, end, delta)``.

    ``marks`` has ``(trace_id, span_id, span_name, opens, ts)`` for each start
    and end of a span.  Either mark may carry the name; both count once one
    does.  The key is the span id, or what ``part`` says: a column, or a
    function that is given the marks of the named spans and adds a column
    ``key``; marks without a key are left out.

    The ids of the named spans come first.  They are kept, so Spark knows how
    many they are: few are broadcast, and the marks of other spans go before
    anything is shuffled or joined.
    """
    named = keep(marks.filter((F.col("span_name") == span_name) & F.col("span_id").isNotNull()).select("trace_id", "span_id").distinct())
    mine = marks.join(named, ["trace_id", "span_id"], "left_semi")
    keyed = part(mine) if callable(part) else mine.withColumn("key", F.col(part or "span_id"))
    lengths = keyed.filter(F.col("key").isNotNull()).groupBy("trace_id", "key").agg(
        F.max(F.when(F.col("opens"), F.col("ts"))).alias("start"), F.max(F.when(~F.col("opens"), F.col("ts"))).alias("end")
    )
    return lengths.filter(F.col("start").isNotNull() & F.col("end").isNotNull()).withColumn("delta", F.col("end") - F.col("start"))


def span_pairs(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Every start with every end of the same span id; spans left open are dropped.

    ``starts`` brings whatever columns it has, ``ends`` only ``(trace_id,
    span_id, end)``, so trees never enter the shuffle.
    """
    return starts.join(ends.select("trace_id", "span_id", "end"), ["trace_id", "span_id"], "inner")
