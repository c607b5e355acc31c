"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

A rolling hash over the hashes of the last lines decides where a chunk ends,
so a boundary depends on the lines around it alone and a shift in one document
leaves the chunks of a shared passage as they are.  Chunks of several lines
that occur more than once anywhere are removed but for the first occurrence,
after a comparison of their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, joined, kept


def line_chunks(docs: DataFrame, window: int = 2, mean_lines: int = 4) -> DataFrame:
    """``(doc_id, text_key, chunk, first, n, chunk_hash, lines)``: the chunks of each document in order.

    A chunk ends after a line where the hash over the hashes of that line and
    the ``window - 1`` lines before it is 0 modulo ``mean_lines``.
    """
    hashed = documents(docs).select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n", -1).alias("lines"))
    hashed = hashed.withColumn("h", F.expr("transform(lines, x -> xxhash64(x))"))
    rolling = f"xxhash64(slice(h, greatest(i + 2 - {window}, 1), least(i + 1, {window})))"
    ends = F.expr(f"filter(sequence(0, size(h) - 1), i -> i = size(h) - 1 OR pmod({rolling}, {mean_lines}) = 0)")
    cut = hashed.withColumn("ends", ends)
    spans = F.expr("transform(ends, (e, k) -> struct(if(k = 0, 0, ends[k - 1] + 1) AS first, e AS last))")
    # The outer form: from a plain explode the planner infers a filter, into which it would copy all of the above.
    spread = cut.withColumn("spans", spans).select("doc_id", "text_key", "lines", "h", F.posexplode_outer("spans").alias("chunk", "s"))
    n = F.col("s.last") - F.col("s.first") + 1
    return spread.select(
        "doc_id",
        "text_key",
        "chunk",
        F.col("s.first").alias("first"),
        n.alias("n"),
        F.xxhash64(F.slice("h", F.col("s.first") + 1, n)).alias("chunk_hash"),
        F.array_join(F.slice("lines", F.col("s.first") + 1, n), "\n").alias("lines"),
    )


def repeated_chunks(docs: DataFrame, window: int = 2, mean_lines: int = 4, min_lines: int = 2) -> DataFrame:
    """``(doc_id, text_key, first, n)``: the chunks to remove, of ``min_lines`` lines at least.

    Hashes are counted first, so only chunks whose hash repeats are moved with
    their bytes.  The first occurrence is the one of the smallest doc_id (null
    first), then text, then place.  Groupings pre-aggregate in each task; the
    join on the bytes of a chunk is left to adaptive execution to split.
    """
    chunks = line_chunks(docs, window, mean_lines).filter(F.col("n") >= min_lines)
    repeats = kept(chunks.groupBy("chunk_hash").count().filter("count > 1").select("chunk_hash"))
    some = kept(chunks.join(repeats, "chunk_hash", "left_semi"))
    place = F.struct("doc_id", "text_key", "first")
    firsts = kept(some.groupBy("chunk_hash", "lines").agg(F.min(place).alias("origin"), F.count("*").alias("copies")).filter("copies > 1"))
    later = some.join(firsts, ["chunk_hash", "lines"]).filter(~place.eqNullSafe(F.col("origin")))
    return later.select("doc_id", "text_key", "first", "n").distinct()


def dedup_lines(docs: DataFrame, window: int = 2, mean_lines: int = 4, min_lines: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_lines, n_removed, removed, kept_text)``.

    ``removed`` lists the removed runs as ``(first, n)`` from 0, ``kept_text``
    is what is left, its lines joined again; null if nothing is left.  A null
    or empty text is one empty line, which is never removed.  Rows that share
    ``doc_id`` and text count as one document and get the same result.
    """
    runs = repeated_chunks(docs, window, mean_lines, min_lines)
    gone = kept(runs.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("removed")))
    base = documents(docs).withColumn("text_key", F.xxhash64("text"))
    # What is removed grows with the table: always a merge join, whose plan does not change with the size.
    out = joined(base, gone, ["doc_id", "text_key"], "left", "merge").withColumn("lines", F.split("text", "\n", -1))
    # Runs are in order and apart: what stays lies between the end of one and the start of the next.
    none = "cast(array() AS array<struct<first: int, n: int>>)"
    out = out.withColumn("removed", F.coalesce("removed", F.expr(none)))
    stays = "transform(array_append(removed, named_struct('first', size(lines), 'n', 0)), (r, k) -> if(k = 0, slice(lines, 1, r.first), slice(lines, removed[k - 1].first + removed[k - 1].n + 1, r.first - removed[k - 1].first - removed[k - 1].n)))"
    n_removed = F.expr("aggregate(removed, 0L, (a, r) -> a + r.n)")
    return out.select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        n_removed.alias("n_removed"),
        "removed",
        F.when(n_removed < F.size("lines"), F.array_join(F.flatten(F.expr(stays)), "\n")).alias("kept_text"),
    )
