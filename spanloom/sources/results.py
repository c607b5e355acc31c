"""Result tables as files, and result files as tables.

The text form of a table is its name, its column names, its column types
(tab-separated), its rows and a line with ``%``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import delete, is_kept, keep, release

if TYPE_CHECKING:
    from ..operators.blocks import Block

# The text format of results and dumps.
END_OF_BLOCK = "%"
DUMP_RULE = "=" * 80


def typed(frame: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Give a table the Spark types of its column types."""
    def convert(name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        if kind == "time":
            return F.timestamp_millis(column.cast("bigint")).alias(name)
        return column.cast("double" if kind == "num" else "string").alias(name)

    return frame.select(*[convert(name, kind) for name, kind in columns])


def write_blocks(blocks: Sequence[Block], frames: Mapping[str, DataFrame], path: str) -> None:
    """Each table as Parquet in a folder of its own (``:`` becomes ``_``)."""
    for block in blocks:
        typed(frames[block.name], block.columns).write.mode("overwrite").parquet(
            f"{path}/{block.name.replace(':', '_')}"
        )


def _field(column: Column) -> Column:
    """A value as one field: tabs and line breaks would end it, so they are written as escapes."""
    text = column.cast("string")
    for raw, shown in (("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return F.coalesce(text, F.lit(""))


_PLACE = "__place"


def _placed(block: Block, frame: DataFrame) -> DataFrame:
    """Rows of a table whose order is not stated, or not by columns it has, are numbered as they come."""
    if _PLACE in frame.columns or (block.order and set(block.order) <= set(frame.columns)):
        return frame
    return frame.withColumn(_PLACE, F.monotonically_increasing_id())


def block_lines(block: Block, frame: DataFrame) -> DataFrame:
    """``(section, seq, tie, line)`` of the text form of one table: 0 heading, 1 rows, 2 end.

    Sorting by the first three columns gives the text.
    """
    frame = _placed(block, frame)
    names, types = zip(*block.columns)
    fixed = [(0, [0], block.name), (0, [1], "\t".join(names)), (0, [2], "\t".join(types)), (2, [0], END_OF_BLOCK)]
    frame_of = frame.sparkSession.createDataFrame(fixed, "section int, seq array<bigint>, line string")
    line = F.concat_ws("\t", *[_field(F.col(f"`{name}`")) for name in names])
    # A row that is just the end mark, or would read back as one or as blank, gets a backslash in front.
    line = F.when(line.rlike(r"^\\*(%|\s*)$"), F.concat(F.lit("\\"), line)).otherwise(line)
    kinds = dict(block.columns)
    order = [_PLACE] if _PLACE in frame.columns else block.order
    keys = [(F.col(f"`{name}`"), kinds.get(name, "num")) for name in order]
    numeric = [key.cast("bigint") for key, kind in keys if kind != "string"]
    tie = F.concat_ws("\t", *[key for key, kind in keys if kind == "string"], line)
    rows = frame.select(F.lit(1).alias("section"), F.array(*numeric).cast("array<bigint>").alias("seq"), tie.alias("tie"), line.alias("line"))
    return frame_of.select("section", "seq", F.lit("").alias("tie"), "line").union(rows)


def result_lines(blocks: Sequence[Block], frames: Mapping[str, DataFrame]) -> DataFrame:
    """:func:`block_lines` of all tables, with ``block_no`` in front."""
    parts = [block_lines(block, frames[block.name]).select(F.lit(number).alias("block_no"), "*") for number, block in enumerate(blocks)]
    return reduce(DataFrame.unionByName, parts)


def write_result_text(blocks: Sequence[Block], frames: Mapping[str, DataFrame], path: str) -> None:
    """All tables as text: a numbered folder per table, in it numbered part files.

    Files in order of their names, one after the other, are the text.  Every
    table is put in order by itself, by ranges of its own rows, and computed
    once: a range sort looks at its input twice, so that is a kept table.
    """
    delete(next(iter(frames.values())).sparkSession, path)
    for number, block in enumerate(blocks):
        frame = frames[block.name]
        table = frame if is_kept(frame) else keep(_placed(block, frame))
        ordered = block_lines(block, table).orderBy("section", "seq", "tie").select("line")
        ordered.write.text(f"{path}/{number:05d}-{block.name.replace(':', '_')}")
        if table is not frame:
            release(table)


def write_dump(text: DataFrame, path: str) -> None:
    text.write.mode("overwrite").option("lineSep", f"\n{DUMP_RULE}\n").text(path)


# --------------------------------------------------------------------------
# reading back


#: Names and types of what orders the splits of a text: its folder, its part number, its file, and where in the file.
_SPLIT = (("folder", "part", "name", "start"), ("string", "bigint", "string", "bigint"))


def result_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a result text with their place: ``(block_no, at, line)``, without end marks and blank lines.

    ``at`` orders the lines of the text, whatever folders and parts it is in.
    End marks are counted per split of a file; the counts of the splits before
    one, added up, tell which table it begins in, and the few marks inside it
    which table a line is in.
    """
    name = F.col("_metadata.file_name")
    file = F.struct(
        F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/", 1).alias("folder"),
        F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("bigint").alias("part"),
        name.alias("name"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        file.alias("split"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line")
    )
    is_end = F.col("line") == END_OF_BLOCK
    splits = lines.groupBy("split").agg(F.sort_array(F.collect_list(F.when(is_end, F.col("n")))).alias("ends"))
    # A row per split: kept, so that Spark knows how few they are when the lines meet them.
    before = F.sum(F.size("ends")).over(Window.orderBy("split")) - F.size("ends")
    splits = keep(splits.select("split", "ends", before.alias("before")))
    rows = lines.filter((F.trim("line") != "") & ~is_end).join(splits, "split")
    number = F.col("before") + F.size(F.filter("ends", lambda e: e < F.col("n")))
    return rows.select(number.alias("block_no"), F.struct("split", "n").alias("at"), "line")


def read_result(spark: SparkSession, path: str, ordered: bool = True) -> dict[str, DataFrame]:
    """Tables of a result text by name, typed: ``num`` double, ``time`` timestamp; rows as in the text if ``ordered``."""
    records = result_records(spark, path)
    # The first three lines of a table decide its schema.  Spark takes the first
    # ones of each task before it brings any together.
    place = F.row_number().over(Window.partitionBy("block_no").orderBy("at"))
    heads = keep(records.withColumn("line_no", place).filter("line_no <= 3"))
    described: dict[int, list[str]] = {}
    last = {}
    for row in heads.orderBy("block_no", "line_no").collect():
        described.setdefault(row.block_no, []).append(row.line)
        last[row.block_no] = row.at
    tables = {}
    for number, (name, names, types) in described.items():
        split = F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in zip(*_SPLIT, last[number].split)])
        heading = F.struct(split.alias("split"), F.lit(last[number].n).alias("n"))
        columns = list(zip(names.split("\t"), types.split("\t")))
        shown = F.when(F.col("line").rlike(r"^\\+(%|\s*)$"), F.expr("substring(line, 2)")).otherwise(F.col("line"))
        fields = F.split(shown, "\t", -1)
        mine = records.filter((F.col("block_no") == number) & (F.col("at") > heading))
        rows = (mine.orderBy("at") if ordered else mine).select(
            *[F.coalesce(F.get(fields, F.lit(i)), F.lit("")).alias(n) for i, (n, _t) in enumerate(columns)]
        )
        tables[name] = typed(rows, columns)
    return tables


def comparison(tables: Mapping[str, DataFrame], table: str = "stat:count") -> DataFrame:
    """A statistics table in order of trace and statistic."""
    return tables[table].orderBy("trace", "stat")
