"""Reading trace directories into events."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import TREE_TYPE, S, let, name_at, rename_leaf, tree_from_json

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


def read_lines(spark: SparkSession, directories: Sequence[str]) -> DataFrame:
    """``(trace_id, line)`` of newline-delimited traces; directories are numbered from 0.

    All of them are one scan; the folder of a line's file tells the number.  A
    directory that is named twice is two traces, a path may be a single file
    or a pattern.  Decoding costs more than reading: set
    ``spark.sql.files.maxPartitionBytes`` for splits as small as the cluster
    has cores for.
    """
    if not directories:
        raise ValueError("at least one trace directory is required")
    numbers = [(path, i) for i, directory in enumerate(directories) for path in _found(spark, directory)]
    # As many rows as directories were named.
    named = spark.createDataFrame(numbers, "place string, trace_id int")
    file = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
    lines = spark.read.option("recursiveFileLookup", "true").text(list(dict.fromkeys(directories))).select(file.alias("file"), F.col("value").alias("line"))
    # The folder as deep as a named place is, in most runs all of one depth.
    depths = sorted({place.count("/") + 1 for place, _ in numbers})
    placed = lines.withColumn("place", F.explode(F.array_distinct(F.array(*[F.substring_index("file", "/", d) for d in depths]))))
    # Below a named directory lie its files and folders of partitions, no other directories.
    own = F.expr("substring(file, length(place) + 1)").rlike(r"^((/[^/=]+=[^/]*)*/[^/]+)?$")
    return placed.join(F.broadcast(named), "place").filter(own).select("trace_id", "line")


def _found(spark: SparkSession, directory: str) -> list[str]:
    """A path or pattern the way the scan shows it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [re.sub("^file:/+", "file:/", status.getPath().toUri().toString()) for status in system.globStatus(path) or []]


def decode_events(lines: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Decode trace lines to ``(trace_id, uuid, ts, tree, corrupt)``.

    A line is an event if it is a well-formed tree whose first child is named
    (the JVM) and whose second is a whole number (milliseconds).  Other lines
    keep only ``corrupt``, the text itself, are dropped, or fail the query.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {MODES}")
    tree = tree_from_json("line")
    envelope = name_at("tree", "1").is_not_null() & name_at("tree", "2").try_cast("bigint").is_not_null()
    # Exploding an array of the one tree keeps the optimizer from copying the
    # decoder into every filter above it, which it does with a projection.
    if mode == "PERMISSIVE":
        trees = lines.select("trace_id", "line", F.explode(S.array(tree).column).alias("tree"))
        good = S.coalesce(envelope, False)
        return trees.select(
            "trace_id",
            S.when(good, name_at("tree", "1")).column.alias("uuid"),
            S.when(good, name_at("tree", "2").try_cast("bigint")).column.alias("ts"),
            S.when(good, S.col("tree")).column.alias("tree"),
            S.when(~good, S.col("line")).column.alias("corrupt"),
        )
    if mode == "FAILFAST":
        message = S.concat("malformed trace line: ", S.col("line"))
        failure = S.raise_error(message).cast(TREE_TYPE)
        sound = lambda t: name_at(t, "1").is_not_null() & name_at(t, "2").try_cast("bigint").is_not_null()
        tree = let(tree, lambda t: S.when(sound(t), t).otherwise(failure))
    found = S.filter(S.array(tree), lambda t: t.is_not_null())
    trees = lines.select("trace_id", F.explode(found.column).alias("tree"))
    return trees.filter(envelope.column).select(
        "trace_id",
        name_at("tree", "1").column.alias("uuid"),
        name_at("tree", "2").try_cast("bigint").column.alias("ts"),
        "tree",
        F.lit(None).cast("string").alias("corrupt"),
    )


def trace_starts(events: DataFrame) -> DataFrame:
    """First time stamp of each trace, over all decoded events before any filter."""
    return events.groupBy("trace_id").agg(F.min("ts").alias("trace_start"))


def relative_time(events: DataFrame, starts: DataFrame) -> DataFrame:
    """Count time from the start of each trace.

    ``starts`` has one row per trace, and traces are the directories a run was
    given by name, so it is broadcast and the events never move.
    """
    joined = events.join(F.broadcast(starts), "trace_id", "left").withColumn("ts", F.col("ts") - F.col("trace_start"))
    # The tree carries the time as well; exploded so that filters do not copy the update.
    # It is made before it is exploded, as a projection is generated code and a generator is not.
    retimed = rename_leaf("tree", 2, S.col("ts").cast("string"))
    rest = [name for name in events.columns if name != "tree"]
    made = joined.select(*rest, retimed.column.alias("_tree"))
    return made.select(*rest, F.explode(F.array("_tree")).alias("tree"))
