"""What the operators share: tables, intermediate results, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import release, shared_folder

__all__ = ["batches_of", "components", "documents", "joined", "kept", "own_column", "release", "same", "shared_folder", "table", "wrapped"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Lets Spark delete the shuffle files of a query when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(frame: DataFrame) -> DataFrame:
    """Compute a table once: written to the shared folder and read back, which also cuts its lineage.

    What was shuffled to make it is deleted once it is written; ``release``
    deletes the table itself when nothing reads it any more.
    """
    spark = frame.sparkSession
    target = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        frame.write.option("compression", "zstd").parquet(target)
    finally:
        spark.conf.set(_CLEAN, before)
    made = spark.read.schema(frame.schema).parquet(target)
    made._kept_at = target
    return made


def own_column(frame: DataFrame, name: str, kind: str) -> Column:
    """A column of the input by its exact name, as NULL where the input lacks it."""
    return F.col(f"`{name}`").cast(kind) if name in frame.columns else F.lit(None).cast(kind)


def documents(frame: DataFrame) -> DataFrame:
    """``(doc_id, text)``: other columns of the input are left out, a null text is an empty one."""
    return frame.select(own_column(frame, "doc_id", "bigint").alias("doc_id"), F.coalesce(own_column(frame, "text", "string"), F.lit("")).alias("text"))


def wrapped(frame: DataFrame) -> DataFrame:
    """``(row, doc_id, text)``: whole rows as one column, so that nothing an operator adds clashes with a name of the input; ``row.*`` unpacks them."""
    row = F.struct(*[F.col(f"`{name}`") for name in frame.columns]).alias("row")
    return frame.select(row, own_column(frame, "doc_id", "bigint").alias("doc_id"), F.coalesce(own_column(frame, "text", "string"), F.lit("")).alias("text"))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hint: str | None = None) -> DataFrame:
    """Join on keys that may be null; the keys are taken from the left."""
    renamed = right.select([F.col(k).alias(f"__{k}") for k in keys] + [c for c in right.columns if c not in keys])
    renamed = renamed.hint(hint) if hint else renamed
    on = None
    for k in keys:
        one = same(left[k], renamed[f"__{k}"])
        on = one if on is None else on & one
    out = left.join(renamed, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__{k}" for k in keys])


def batches_of(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables of about ``limit`` bytes of ``column``; a longer row is a table of its own."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if size and size + int(n) > limit:
                if i > start:
                    waiting.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(waiting)
                waiting, size, start = [], 0, i
            size += int(n)
        if len(lengths) > start:
            waiting.append(batch.slice(start))
    if waiting:
        yield pa.Table.from_batches(waiting)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``(a, b)``: ``(node, root)`` with the smallest node of each component.

    Alternates large-star and small-star steps until nothing changes: every
    step is one grouping by node for the minimum and one join, so no
    component is ever gathered in one task.  Only the count of changed links
    reaches the driver.
    """
    table = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    edges, before = table, None
    while True:
        # Large star: each larger neighbour of a node is linked to the smallest neighbour (or the node itself).
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["n"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = kept(large)
        # Small star: each smaller neighbour of a node, and the node, is linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(least, large["u"] == least["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        last, table = table, kept(small.union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))))
        edges = table.distinct()
        release(last, large)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000000007)).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
