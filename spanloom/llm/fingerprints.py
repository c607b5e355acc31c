"""Document fingerprints by consistent weighted sampling.

A text is a bag of words; the weight of a word is its count.  For each of
``samples`` hash functions, every word draws two gamma variables and an offset
from its own hash, and the word of the smallest sampled value is the sample,
together with the quantised weight it was taken at.  Two texts agree in a
sample with the probability of their generalised Jaccard similarity, the sum
of smaller weights over the sum of larger ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, documents

SAMPLES = 64


def _mixed(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64 hashed bits for each pair of a row of ``h`` and a column of ``salt``."""
    x = h[:, None] * salt[None, :]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _unit(x: np.ndarray, shift: int) -> np.ndarray:
    """Numbers between 0 and 1 from 24 bits."""
    return ((x >> np.uint64(shift)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24) + np.float32(2**-25)


def draws(hashes: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """For each weighted term and hash function: the sampled value in the upper 32 bits, in order, and what the sample is in the lower."""
    salts = np.random.default_rng(20).integers(1, 2**63, (4, samples), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    x, y, z = (_mixed(hashes, s) for s in salts[:3])
    r = -np.log(_unit(x, 40) * _unit(x, 16))
    c = -np.log(_unit(y, 40) * _unit(y, 16))
    beta = _unit(z, 40)
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + beta)
    value = (np.log(c) - r * (t - beta + np.float32(1))).view(np.uint32)
    ordered = np.where(value >> np.uint32(31), ~value, value | np.uint32(0x80000000)).astype(np.uint64)
    what = (hashes[:, None] + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * salts[3][None, :]
    what ^= what >> np.uint64(31)
    what *= np.uint64(0x94D049BB133111EB)
    return (ordered << np.uint64(32)) | (what >> np.uint64(32))


def weighted_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, term code, count)`` in the order of texts, and the hash of each code; a text without words has the empty word."""
    words = pc.ascii_split_whitespace(texts)
    owner = pc.list_parent_indices(words).to_numpy()
    flat = pc.list_flatten(words)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    bare = np.setdiff1d(np.arange(len(texts)), owner[full])
    coded = pa.concat_arrays([flat.cast(pa.string()), pa.array([""], pa.string())]).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    n = len(coded.dictionary)
    key = np.concatenate([owner[full] * n + codes[:-1][full], bare * n + codes[-1]])
    key, counts = np.unique(key, return_counts=True)
    return key // n, key % n, counts, pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def signatures(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """16 bits of each sample, one row per text."""
    owner, code, count, hashes = weighted_terms(texts)
    top = int(count.max()) + 1
    kinds, kind = np.unique(code * top + count, return_inverse=True)
    drawn = np.empty((len(kinds), samples), np.uint64)
    for i in range(0, len(kinds), 4096):
        part = kinds[i : i + 4096]
        drawn[i : i + 4096] = draws(hashes[part // top], part % top, samples)
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = np.empty((len(texts), samples), np.uint16)
    first = 0
    while first < len(texts):  # some texts at a time, so that what is gathered stays in the caches
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + 8192, "right")) - 1)
        rows = drawn[kind[starts[first] : starts[last]]]
        out[first:last] = (np.minimum.reduceat(rows, starts[first:last] - starts[first]) & np.uint64(0xFFFF)).astype(np.uint16)
        first = last
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples, row by row: an estimate of the generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, fingerprint)``, the samples as hexadecimal text; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_of(batches, "text", 8 << 20):
            found = signatures(part["text"].combine_chunks(), samples)
            yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), pa.array(_hex(found))], ["doc_id", "fingerprint"])

    return documents(docs).mapInArrow(run, "doc_id bigint, fingerprint string")


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u2")]


def edited_text(text: str, following: str) -> str:
    """The last third of the code points, rounded down, replaced by as many of the text that follows."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


EDITED = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def compare_neighbours(samples: int):
    """Over rows in order, each bucket closed by the head of the next one (``tail`` is 1): compare each text with its edited form and the next text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int | None, str, int]] = []
        for part in batches_of(batches, "text", 8 << 20):
            rows = waiting + list(zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), part["tail"].to_pylist()))
            waiting = rows[-1:]
            of = [i for i in range(len(rows) - 1) if not rows[i][2]]
            if not of:
                continue
            edited = [edited_text(rows[i][1], rows[i + 1][1]) for i in of]
            found = signatures(pa.array([r[1] for r in rows] + edited, pa.large_string()), samples)
            own, changed, after = found[of], found[len(rows) :], found[[i + 1 for i in of]]
            columns = [
                [rows[i][0] for i in of],
                [len(rows[i][1]) for i in of],
                [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                _hex(own),
                _hex(changed),
                likeness(own, changed),
                likeness(own, after),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, EDITED)], schema=EDITED)

    return run


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    The next document is the one that follows by descending ``doc_id`` (null
    last; equal ids by text), after the last the first; a table of one row is
    its own next.  Rows are dealt into ranges of ``doc_id``, one per shuffle
    partition, each closed by a copy of the next range's first row, so no
    task sees more than its range and no window spans the table.
    """
    spark = docs.sparkSession
    rows = documents(docs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = sorted(set(bounds), reverse=True)
    if bounds:
        array = F.array(*[F.lit(b) for b in bounds])
        bucket = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(F.filter(array, lambda b: b > F.col("doc_id"))))
    else:
        bucket = F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    heads = sorted((r[0], r[1]) for r in rows.groupBy("bucket").agg(F.max("doc_id")).collect())  # one row per range
    if not heads:
        return spark.createDataFrame([], "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    follows = spark.createDataFrame([(heads[(i + 1) % len(heads)][1], b) for i, (b, _) in enumerate(heads)], "head bigint, target int")
    # One row per shuffle partition at most, whatever the size of the table.
    firsts = rows.join(F.broadcast(follows), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("target").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    dealt = rows.select("bucket", F.lit(0).alias("tail"), "doc_id", "text").union(firsts.select("target", F.lit(1), "doc_id", "text"))
    ordered = dealt.repartitionById(len(bounds) + 2, F.col("bucket")).sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(compare_neighbours(samples), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
