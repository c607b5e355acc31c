"""Numbering rows without bringing them together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, group: Sequence[str], band: Column, order: Sequence[str | Column], name: str) -> DataFrame:
    """Number the rows of each group from 0 in ``order``, in two phases.

    ``band`` cuts the order into runs: it never falls as the order rises.
    Rows are counted per band, the counts of the bands before one add up to
    where its numbers begin, and only the rows of a band are put in order.
    What a window holds whole is a band, or a group's one count per band.
    """
    banded = rows.withColumn("__band", band)
    in_order = Window.partitionBy(*group).orderBy("__band")
    starts = (
        banded.groupBy(*group, "__band")
        .agg(F.count("*").alias("__n"))
        .select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__band").alias("__b"), (F.sum("__n").over(in_order) - F.col("__n")).alias("__start"))
    )
    within = Window.partitionBy(*group, "__band").orderBy(*order)
    local = banded.withColumn("__local", F.row_number().over(within) - 1)
    same = F.col("__band").eqNullSafe(F.col("__b"))
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return local.join(starts, same).select(*rows.columns, (F.col("__start") + F.col("__local")).alias(name))
