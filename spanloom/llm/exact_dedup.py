"""Exact dedup by deterministic block naming.

The bytes of a normalised text are cut into blocks of fixed size.  Distinct
blocks are sorted and get integers as names; then adjacent names are paired,
distinct pairs are sorted and named again, until one name is left of each
document.  A name stands for exactly one string of bytes, so equal identities
mean equal texts, without any hash to collide.

Blocks are named in two steps.  A task first sorts the distinct blocks of a
bounded shard of documents and numbers them there, so a block that a third of
all documents hold leaves each shard once.  Then the shards' blocks meet, are
sorted and named, and only numbers travel back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, documents, joined, kept, wrapped

#: The characters that do not count: ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
_DROP = SPACES.encode()
_SHARD = pa.schema(
    [("shard", pa.int64()), ("local", pa.int32()), ("block", pa.binary()), ("doc_id", pa.int64()), ("sha", pa.string()), ("n_chars", pa.int64()), ("place", pa.int32())]
)


def shard_blocks(block_bytes: int, shard_bytes: int):
    """Number the distinct blocks of each shard in sorted order; one row per distinct block and one per block of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 24
        for number, shard in enumerate(batches_of(batches, "text", shard_bytes)):
            ids = shard["doc_id"].to_pylist()
            rows: list[tuple[int | None, str, int, int, bytes]] = []
            for doc_id, text in zip(ids, shard["text"].to_pylist()):
                data = text.encode().translate(None, _DROP)
                sha = hashlib.sha256(data).hexdigest()
                for place in range(max(1, -(-len(data) // block_bytes))):
                    rows.append((doc_id, sha, len(text), place, data[place * block_bytes : (place + 1) * block_bytes]))
            blocks = sorted({r[4] for r in rows})
            local = {b: i for i, b in enumerate(blocks)}
            shard_no, n, m = base + number, len(blocks), len(rows)
            columns = [
                pa.array([shard_no] * (n + m), pa.int64()),
                pa.array(list(range(n)) + [local[r[4]] for r in rows], pa.int32()),
                pa.array(blocks + [None] * m, pa.binary()),
                pa.array([None] * n + [r[0] for r in rows], pa.int64()),
                pa.array([None] * n + [r[1] for r in rows], pa.string()),
                pa.array([None] * n + [r[2] for r in rows], pa.int64()),
                pa.array([None] * n + [r[3] for r in rows], pa.int32()),
            ]
            yield from pa.Table.from_arrays(columns, schema=_SHARD).to_batches(max_chunksize=20_000)

    return run


def name_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give the blocks of one sorted partition integers in their order; equal blocks of several shards get the same."""
    name, last = TaskContext.get().partitionId() << 40, None
    for batch in batches:
        names = []
        for block in batch.column("block").to_pylist():
            if block != last:
                name, last = name + 1, block
            names.append(name)
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("local"), pa.array(names, pa.int64())], ["shard", "local", "name"])


def identities(docs: DataFrame, block_bytes: int = 1024, shard_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, sha, n_chars, level, name)``; ``(level, name)`` is the identity of its text.

    The text counts without the characters of ``SPACES``; a null text is
    empty, and all empty texts are equal.  Rows may repeat and ``doc_id`` may
    be null.  An empty table gives an empty table.
    """
    shards = kept(documents(docs).mapInArrow(shard_blocks(block_bytes, shard_bytes), "shard bigint, local int, block binary, doc_id bigint, sha string, n_chars bigint, place int"))
    sorted_blocks = shards.filter(F.col("block").isNotNull()).select("shard", "local", "block").repartition(F.col("block")).sortWithinPartitions("block")
    names = sorted_blocks.mapInArrow(name_sorted, "shard bigint, local int, name bigint")
    refs = shards.filter(F.col("place").isNotNull()).select("shard", "local", "doc_id", "sha", "n_chars", "place")
    named = refs.join(names, ["shard", "local"]).groupBy("doc_id", "sha").agg(F.array_sort(F.collect_set(F.struct("place", "name"))).alias("s"))
    rows = refs.filter("place = 0").select("doc_id", "sha", "n_chars")
    level, done = 0, []
    state = kept(named.select("doc_id", "sha", F.col("s.name").alias("names")))
    while True:
        done.append(state.filter(F.size("names") == 1).select("doc_id", "sha", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        rest = state.filter(F.size("names") > 1)
        if not rest.head(1):
            break
        level += 1
        pairs = rest.select("doc_id", "sha", F.posexplode(F.expr("transform(sequence(0, (size(names) - 1) div 2), i -> struct(names[2 * i] AS x, coalesce(get(names, 2 * i + 1), -1L) AS y))")).alias("place", "p"))
        pairs = pairs.select("doc_id", "sha", "place", "p.x", "p.y")
        sorted_pairs = pairs.select("x", "y").distinct().repartitionByRange("x", "y").sortWithinPartitions("x", "y")
        pair_names = sorted_pairs.select("x", "y", F.monotonically_increasing_id().alias("name"))
        again = pairs.join(pair_names, ["x", "y"]).groupBy("doc_id", "sha").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("s"))
        state = kept(again.select("doc_id", "sha", F.col("s.name").alias("names")))
    named = done[0]
    for more in done[1:]:
        named = named.union(more)
    return joined(rows, named, ["doc_id", "sha"])


def exact_groups(docs: DataFrame, block_bytes: int = 1024, shard_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, keep_id, group_size, kept, text_sha256)``.

    Of the rows with one identity, the one with the most code points in its
    original text stays, then the smallest ``doc_id`` (null last); of rows
    that repeat whole, all bear the same verdict.  See :func:`identities`
    for odd input.
    """
    rows = kept(identities(docs, block_bytes, shard_bytes))
    first = F.min(F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c")))
    groups = kept(rows.groupBy("level", "name").agg(first.alias("f"), F.count("*").alias("group_size")))
    groups = groups.select("level", "name", F.col("f.c").alias("keep_id"), (-F.col("f.a")).alias("keep_chars"), "group_size")
    return rows.join(groups, ["level", "name"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, block_bytes: int = 1024) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that share ``doc_id`` and normalised text, one stays."""
    stay = exact_groups(docs, block_bytes).filter("kept").groupBy("doc_id", F.col("text_sha256").alias("sha")).count()
    stay = kept(stay.select("doc_id", "sha", (F.col("count") > 1).alias("repeats")))
    rows = wrapped(docs).select("row", "doc_id", F.sha2(F.encode(F.translate("text", SPACES, ""), "UTF-8"), 256).alias("sha"))
    once = joined(rows, stay.filter("not repeats").drop("repeats"), ["doc_id", "sha"], "left_semi")
    repeats = joined(rows, stay.filter("repeats").drop("repeats"), ["doc_id", "sha"], "left_semi")
    return once.union(repeats.dropDuplicates(["doc_id", "sha"])).select("row.*")
