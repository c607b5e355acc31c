"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles; the i-th occurrence of a
shingle is labelled i, so all labelled shingles of a text differ.  Each sketch
takes the few labelled shingles of smallest hash and keeps the order in which
they stand in the text, so texts that hold the same shingles in another order
do not collide.  Texts that share a sketch are in one pool, and so are texts
that a chain of such texts connects.

Within a pool every pair is looked at, but in the cheapest way first: one bit
each of 512 minima tells about how alike two texts are, and pairs that are
clearly below the threshold go.  The others are taken most alike first, and a
pair whose texts are already in one class is left alone.  A pair is linked if
the longest common subsequence of its shingles, found by aligning them within
the band that the threshold leaves, makes up ``threshold`` of all shingles of
both.  Pairs never become rows: a task compares a block of a pool with itself
or another, and what leaves it are the links that joined classes, fewer than
it has texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, components, documents, joined, kept, release, wrapped

SHINGLE = 5
THRESHOLD = 0.8
#: Sketches of a text, and how many labelled shingles each takes for texts of so many shingles and more.  Two texts of
#: similarity s share a sketch with probability s ** taken: at 0.8 and eight taken, a pair shares none of 24 in 1.2 % of
#: cases, at five 0.01 %; at 0.4 it shares one in 1.6 %.
SKETCHES = 24
TAKEN = ((1, 3), (20, 5), (64, 8))
#: Bits of the estimate, and how many standard errors below the threshold a pair may seem to be.
BITS, ERRORS = 512, 4.0
#: A block of a pool has about so many texts, and so many shingles, at most.
BLOCK_TEXTS, BLOCK_SHINGLES = 4096, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts, and where each text begins."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    owner, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    some = pc.not_equal(flat, "")
    owner = owner[some.to_numpy(zero_copy_only=False)]
    coded = flat.filter(some).dictionary_encode()
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
    return hashes[coded.indices.to_numpy()], np.searchsorted(owner, np.arange(len(texts) + 1))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of one text; a shorter text has the one shingle of all its words."""
    with np.errstate(over="ignore"):
        n = max(1, len(words) - size + 1)
        out = np.full(n, len(words) if len(words) < size else 0, np.uint64)
        for k in range(min(size, len(words))):
            out = (out ^ words[k : k + n]) * _MIX
            out ^= out >> np.uint64(29)
        return out


def labelled(codes: np.ndarray) -> np.ndarray:
    """Hashes of the shingles with the number of their occurrence so far."""
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if first.all():
        return codes
    starts = np.flatnonzero(first)
    number = np.empty(len(codes), np.uint64)
    number[order] = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    with np.errstate(over="ignore"):
        return codes + number * np.uint64(0xD6E8FEB86659FD93)


def sketches(codes: np.ndarray, salts: np.ndarray, taken: int) -> np.ndarray:
    """One number per salt: of the ``taken`` labelled shingles of smallest hash, in text order."""
    own = labelled(codes)
    taken = min(taken, len(own))
    # So many salts at a time that a very long text needs no more memory than its shingles do.
    step = max(1, (1 << 20) // len(own))
    out = np.zeros(len(salts), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(salts), step):
            h = own[None, :] * salts[i : i + step, None]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            at = np.sort(np.argpartition(h, taken - 1, axis=1)[:, :taken], axis=1)
            part = out[i : i + step]
            for k in range(taken):
                part[:] = (part ^ own[at[:, k]]) * _MIX
                part ^= part >> np.uint64(31)
        return (out ^ salts) * _MIX


def estimate_bits(codes: np.ndarray) -> np.ndarray:
    """``BITS`` bits: one of the smallest hash in each of so many bins; an empty bin takes after the next one that is not."""
    with np.errstate(over="ignore"):
        h = labelled(codes) * np.uint64(0xD1342543DE82EF95)
        h ^= h >> np.uint64(31)
        h = np.sort(h * _MIX)
        shift = np.uint64(64 - (BITS.bit_length() - 1))
        at = np.searchsorted(h >> shift, np.arange(BITS + 1, dtype=np.uint64))
        there = np.flatnonzero(at[1:] > at[:-1])
        follows = np.searchsorted(there, np.arange(BITS))
        source = there[follows % len(there)]
        away = (source - np.arange(BITS)) % BITS
        least = (h[at[source]] + away.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x94D049BB133111EB)
        return np.packbits(((least >> np.uint64(47)) & np.uint64(1)).astype(bool))


def common_subsequence(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Length of the longest common subsequence, or -1 if more than ``most`` elements would be left out of both together.

    Banded alignment: an element can only be aligned with one whose place
    differs by no more than what may be left out.  Matches within that band,
    in order of the one text, have to rise in the other: the longest rising
    chain is found with one binary search per match.  Texts that repeat the
    same few elements have too many matches for that; for them the columns of
    the alignment are advanced as the bits of one long number.
    """
    n, m = len(a), len(b)
    equal = np.flatnonzero(a[: min(n, m)] != b[: min(n, m)])
    head = int(equal[0]) if len(equal) else min(n, m)
    a, b = a[head:], b[head:]
    k = min(len(a), len(b))
    equal = np.flatnonzero(a[len(a) - k :][::-1] != b[len(b) - k :][::-1])
    tail = int(equal[0]) if len(equal) else k
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a), np.searchsorted(b[order], a, "right")
    count = high - low
    total = int(count.sum())
    if total > 32 * (n + m):
        inside = _long_number(a.tolist(), b.tolist())
    else:
        i = np.repeat(np.arange(n), count)
        ends = np.cumsum(count)
        j = order[np.arange(total) - np.repeat(ends - count, count) + np.repeat(low, count)]
        near = np.abs(i - j) <= most
        i, j = i[near], j[near]
        # Of the matches of one element the later ones first, so that a chain takes one of them at most.
        chain: list[int] = []
        for y in j[np.lexsort((-j, i))].tolist():
            at = bisect_left(chain, y)
            if at == len(chain):
                chain.append(y)
            else:
                chain[at] = y
        inside = len(chain)
    return head + tail + inside if n + m - 2 * inside <= most else -1


def _long_number(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; bit i of a number stands for element i of ``a``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for y in b:
        hit = free & places.get(y, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float, own_a: np.ndarray | None = None, own_b: np.ndarray | None = None) -> float:
    """Common subsequence over all shingles of both, or 0 where it cannot reach the threshold; ``own_a`` and ``own_b`` are their sorted labelled shingles, if at hand."""
    n, m = len(a), len(b)
    # With c common ones, c / (n + m - c) >= threshold bounds what is left out.
    least = int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))
    if min(n, m) < least:
        return 0.0
    # The common multiset is no smaller than the common subsequence.
    own_a = np.sort(labelled(a)) if own_a is None else own_a
    own_b = np.sort(labelled(b)) if own_b is None else own_b
    at = np.searchsorted(own_b, own_a)
    if np.count_nonzero(own_b[np.minimum(at, m - 1)] == own_a) < least:
        return 0.0
    found = common_subsequence(a, b, n + m - 2 * least)
    return found / (n + m - found) if found >= least else 0.0


def _text_key(words: np.ndarray) -> bytes:
    """A digest of a sequence of words; equal sequences are copies, which share all their links."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def band_keys(codes: np.ndarray, salts: np.ndarray, threshold: float, taken: tuple[tuple[int, int], ...] = TAKEN) -> np.ndarray:
    """Sketches of a text, of as many shingles as texts of its length take; where the numbers change, texts that can still be alike have both kinds."""
    found = []
    for k, (least, take) in enumerate(taken):
        below = taken[k + 1][0] / threshold if k + 1 < len(taken) else np.inf
        if least <= len(codes) < below:
            found.append(sketches(codes, salts + np.uint64(2 * k), take))
    return np.concatenate(found)


def sketch_rows(docs: DataFrame, n_sketches: int, threshold: float) -> DataFrame:
    """``(doc_id, text_hash, text_key, n, bits, bands)`` per row of ``docs``; ``doc_id`` and ``text_hash`` tell rows apart, ``n`` counts shingles."""
    salts = np.random.default_rng(2).integers(1, 2**62, n_sketches, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_of(batches, "text", 8 << 20):
            words, starts = word_codes(part["text"].combine_chunks())
            keys, bits, found = [], [], []
            for i, j in zip(starts, starts[1:]):
                codes = shingles(words[i:j])
                keys.append(_text_key(words[i:j]))
                bits.append(estimate_bits(codes).tobytes())
                found.append(band_keys(codes, salts, threshold).view(np.int64))
            n = np.maximum(np.diff(starts) - SHINGLE + 1, 1).astype(np.int64)
            columns = [part["doc_id"].combine_chunks(), part["text_hash"].combine_chunks(), pa.array(keys, pa.binary()), pa.array(n), pa.array(bits, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "text_key", "n", "bits", "bands"])

    rows = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, text_key binary, n bigint, bits binary, bands array<bigint>")


def shingle_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(text_no, codes)``: the shingle hashes of the rows that ``wanted`` ``(text_no, doc_id, text_hash)`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_of(batches, "text", 8 << 20):
            words, starts = word_codes(part["text"].combine_chunks())
            codes = [shingles(words[i:j]).tobytes() for i, j in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([part["text_no"].combine_chunks(), pa.array(codes, pa.binary())], ["text_no", "codes"])

    rows = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    # Merged at every size: what is wanted grows with the documents, so it is never sent to all tasks.
    return joined(rows, wanted, ["doc_id", "text_hash"], hint="merge").select("text_no", "text").dropDuplicates(["text_no"]).mapInArrow(run, "text_no bigint, codes binary")


def likely_pairs(bits: np.ndarray, n: np.ndarray, first: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may reach the threshold, most alike first: of texts before and from ``first`` on, or of all texts where ``first`` is 0.

    A pair goes if its lengths forbid the similarity, or if it seems so many
    standard errors less alike (one pair in thirty thousand seems that far off).
    """
    many = len(n)
    # Half of the bits agree by chance.  A short text has fewer minima than bins.
    error = 2 * np.sqrt((1 + threshold) / 2 * (1 - threshold) / 2)
    found = []
    for i in range(first or many - 1):
        start = first or i + 1
        apart = np.bitwise_count(bits[start:] ^ bits[i]).sum(axis=1, dtype=np.int64)
        alike = 1 - 2 * apart / BITS
        least, most = np.minimum(n[start:], n[i]), np.maximum(n[start:], n[i])
        j = np.flatnonzero((alike >= threshold - ERRORS * error / np.sqrt(np.minimum(least, BITS))) & (least >= threshold * most - 1e-9))
        if len(j):
            found.append((np.full(len(j), i), j + start, alike[j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, alike = map(np.concatenate, zip(*found))
    order = np.argsort(-alike, kind="stable")
    return i[order], j[order]


def cell_classes(texts: list[tuple], first: int, threshold: float) -> list[tuple[int, int]]:
    """Classes among ``(text_no, n, bits, codes, class)``, by links between those before and from ``first`` on if it is not 0.

    A class that links have joined is told by its smallest ``class`` so far:
    ``(class, smallest)`` for each of its other ones.
    """
    number = {}
    root = np.array([number.setdefault(t[4], k) for k, t in enumerate(texts)])
    bits = np.frombuffer(b"".join(t[2] for t in texts), np.uint64).reshape(len(texts), -1)
    left, right = likely_pairs(bits, np.array([t[1] for t in texts]), first, threshold)
    codes = [np.frombuffer(t[3], np.uint64) for t in texts]
    sorted_ = [None] * len(texts)

    def own(k: int) -> np.ndarray:
        if sorted_[k] is None:
            sorted_[k] = np.sort(labelled(codes[k]))
        return sorted_[k]

    for start in range(0, len(left), 4096):
        i, j = left[start : start + 4096], right[start : start + 4096]
        open_ = root[i] != root[j]
        for x, y in zip(i[open_].tolist(), j[open_].tolist()):
            if root[x] != root[y] and similarity(codes[x], codes[y], threshold, own(x), own(y)) >= threshold:
                root[root == root[y]] = root[x]
    names = np.array([t[4] for t in texts])
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, root, names)
    return sorted({(a, b) for a, b in zip(names.tolist(), least[root].tolist()) if a != b})


def compare_cells(threshold: float):
    """:func:`cell_classes` of each cell of a sorted partition; a cell is held whole, and is of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("pool", "low", "high", "side", "text_no", "n", "bits", "codes", "class")
        rows = (r for b in batches for r in zip(*[b.column(n).to_pylist() for n in names]))
        out: list[tuple[int, int]] = []
        for (_pool, low, high), cell in groupby(rows, key=lambda r: r[:3]):
            cell = list(cell)
            first = sum(r[3] == 0 for r in cell) if low != high else 0
            if low != high and first in (0, len(cell)):
                continue
            out += [(*found, low) for found in cell_classes([r[4:] for r in cell], first, threshold)]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "block"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "block"])

    return run


def pools(texts: DataFrame) -> DataFrame:
    """``(text_no, pool)`` of the texts that share a sketch with any other; what a chain of shared sketches connects is one pool."""
    # Salts go into the keys, so a key belongs to one sketch only.
    bands = texts.select("text_no", F.explode("bands").alias("key"))
    # A text is tied to the first one of each of its buckets: a row per text and bucket, never a pair.
    buckets = kept(bands.groupBy("key").agg(F.min("text_no").alias("lead"), F.count("*").alias("size")).filter("size > 1").drop("size"))
    ties = bands.join(buckets, "key").select(F.col("text_no").alias("a"), F.col("lead").alias("b")).filter("a <> b").distinct()
    found = components(ties)
    tied = found.select(F.col("node").alias("text_no"), F.col("root").alias("pool"))
    made = kept(tied.union(found.select(F.col("root").alias("text_no"), F.col("root").alias("pool"))).distinct())
    release(buckets)
    return made


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, n_sketches: int = SKETCHES, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, text_hash, class_id, class_size, kept)``.

    Classes are the connected components of linked texts; ``class_id`` is the
    smallest ``doc_id`` of the class (null last), whose row is the one
    ``kept``.  Copies (equal sequences of lower-case words) are handled as one
    text.  A null or empty text is a text of no words; all of these are
    copies.  Rows may repeat, texts may be as long as a row can be, other
    columns play no part; an empty table gives an empty one.

    A pool of one block has its classes when that is compared.  Of a larger one,
    blocks are compared with themselves first; if that leaves it in several
    classes, pairs of its blocks follow, between texts whose classes differ.
    """
    rows = kept(sketch_rows(docs, n_sketches, threshold))
    origin = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("origin")
    texts = rows.groupBy("text_key").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"), origin)
    texts = kept(texts.withColumn("text_no", F.monotonically_increasing_id()))
    pooled = pools(texts)
    wanted = pooled.join(texts.select("text_no", "n", "bits", "origin.doc_id", "origin.text_hash"), "text_no")
    sizes = wanted.groupBy("pool").agg(F.ceil(F.greatest(F.count("*") / F.lit(block_texts), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    dealt = wanted.join(sizes, "pool").withColumn("block", F.pmod(F.xxhash64("text_no"), F.col("blocks")).cast("int"))
    dealt = kept(dealt)
    codes = kept(shingle_rows(docs, dealt.select("text_no", "doc_id", "text_hash")))
    members = dealt.select("pool", "blocks", "block", "text_no", "n", "bits").join(codes, "text_no")

    def compared(cells: DataFrame) -> DataFrame:
        key = ["pool", "low", "high"]
        in_order = cells.repartition(*key).sortWithinPartitions(*key, "side", "text_no")
        return kept(in_order.mapInArrow(compare_cells(threshold), "a bigint, b bigint, block bigint"))

    # Blocks of a pool are numbered below zero if they are all there is of it.
    own_block = F.when(F.col("blocks") > 1, F.col("block")).otherwise(-1).cast("bigint")
    alone = members.select("pool", own_block.alias("low"), own_block.alias("high"), F.lit(0).alias("side"), "text_no", "n", "bits", "codes", F.col("text_no").alias("class"))
    joined_ = compared(alone)
    classes = joined_.filter("block < 0").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if dealt.filter("blocks > 1").head(1):
        found = joined_.filter("block >= 0").select(F.col("a").alias("text_no"), F.col("b").alias("class"))
        named = members.filter("blocks > 1").join(found, "text_no", "left").withColumn("class", F.coalesce("class", "text_no"))
        several = kept(named.groupBy("pool").agg(F.min("class").alias("least"), F.max("class").alias("most")).filter("least < most").select("pool"))
        others = named.join(several, "pool", "left_semi").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).filter("other <> block")
        pairs = others.select(
            "pool",
            F.least("block", "other").cast("bigint").alias("low"),
            F.greatest("block", "other").cast("bigint").alias("high"),
            (F.col("block") > F.col("other")).cast("int").alias("side"),
            "text_no",
            "n",
            "bits",
            "codes",
            "class",
        )
        links = joined_.filter("block >= 0").union(compared(pairs)).select("a", "b")
        classes = classes.union(components(links).select("node", "root"))
    release(dealt, codes)
    own = texts.select("text_key", "text_no").join(classes.withColumnRenamed("node", "text_no"), "text_no", "left")
    own = own.select("text_key", F.coalesce("root", "text_no").alias("class"))
    placed = kept(rows.select("doc_id", "text_hash", "text_key").join(own, "text_key").drop("text_key"))
    release(rows, texts)
    first = kept(placed.groupBy("class").agg(origin, F.count("*").alias("class_size")))
    out = placed.join(first, "class")
    return out.select(
        "doc_id",
        "text_hash",
        F.col("origin.doc_id").alias("class_id"),
        "class_size",
        (F.col("doc_id").eqNullSafe(F.col("origin.doc_id")) & (F.col("text_hash") == F.col("origin.text_hash"))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns; of rows that share ``doc_id`` and text, one stays."""
    stay = near_classes(docs, threshold).filter("kept").groupBy("doc_id", "text_hash").count()
    stay = kept(stay.select("doc_id", "text_hash", (F.col("count") > 1).alias("repeats")))
    rows = wrapped(docs).select("row", "doc_id", F.xxhash64("text").alias("text_hash"))
    once = joined(rows, stay.filter("not repeats").drop("repeats"), ["doc_id", "text_hash"], "left_semi")
    repeats = joined(rows, stay.filter("repeats").drop("repeats"), ["doc_id", "text_hash"], "left_semi")
    return once.union(repeats.dropDuplicates(["doc_id", "text_hash"])).select("row.*")
