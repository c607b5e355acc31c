"""Dedup of repeated passages by suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts earlier is
removed.  Documents are dealt into shards by a hash.  Each shard has a suffix
array, refined by prefix doubling of the groups that are not yet sorted, and
the common prefixes of neighbours in it, so its own repeats are known.

Across shards, a string of ``length`` bytes that occurs in two of them shares
its anchor, the window of ``ANCHOR`` bytes of smallest hash in it.  Each part
sends the distinct hashes of its anchors, packed, those of several of its
shards twice, and learns which another shard has too, of its own or elsewhere.
Only the strings around those travel; where they meet, those of each shard are
looked up in the sorted ones of the shards before by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, documents, joined, kept, wrapped

LENGTH = 100
ANCHOR = 32
#: Hashes are packed by this many of their leading bits.
_PACKS = 12
#: An anchor in more places than this is resolved string by string instead of in one task.
HOT = 20_000


def symbols_of(text: np.ndarray, depth: int) -> tuple[np.ndarray, int, int]:
    """The bytes of a text as numbers from 0 without gaps, the bits of one, and how many, less than ``depth``, fit in a word beside a place in the text."""
    present = np.bincount(text, minlength=256) > 0
    bits = max(1, int(present.sum() - 1).bit_length())
    return (np.cumsum(present) - 1).clip(0).astype(np.uint8)[text], bits, max(1, min((64 - len(text).bit_length()) // bits, depth - 1))


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and for each the group of those that share its first bytes: the most bytes sorted at once below ``depth``.

    Larsson-Sadakane: suffixes are sorted by as many bytes as fit in a word;
    from then on only groups of several suffixes are sorted again, by the
    groups of the suffixes that start where the sorted bytes end.  What is
    sorted are words that hold key and place, so no second array is moved.
    """
    n = len(text)
    symbols, bits, sorted_bytes = symbols_of(text, depth)
    place_bits = n.bit_length()
    key = np.zeros(n, np.uint64)
    for k in range(sorted_bytes):
        key <<= np.uint64(bits)
        key[: max(0, n - k)] |= symbols[k:]
    key <<= np.uint64(place_bits)
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    small = np.int32 if n < 1 << 30 else np.int64
    order = (key & np.uint64((1 << place_bits) - 1)).astype(small)
    key >>= np.uint64(place_bits)
    start = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=start[1:])
    heads = np.flatnonzero(start)
    rank = np.empty(n + 1, small)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    rank[n] = -1
    before = None
    while True:
        # Places in groups of several suffixes.
        alone = start.copy()
        alone[:-1] &= start[1:]
        open_ = np.flatnonzero(~alone)
        if sorted_bytes < depth <= sorted_bytes * 2:
            before = rank[:n].copy()
        if not len(open_):
            break
        suffixes = order[open_]
        group = np.cumsum(start[open_]) - 1
        # Of suffixes that end before, the shorter comes first.
        after = suffixes + small(sorted_bytes)
        behind = np.where(after < n, rank[np.minimum(after, n)], n - after - 1).astype(np.int64) + sorted_bytes
        own_bits, behind_bits = len(open_).bit_length(), (n + sorted_bytes).bit_length()
        pair = (group << behind_bits) + behind
        if int(group[-1]).bit_length() + behind_bits + own_bits <= 63:
            pair = (pair << own_bits) + np.arange(len(open_))
            pair.sort()
            again = pair & ((1 << own_bits) - 1)
            pair >>= own_bits
        else:
            again = np.argsort(pair)
            pair = pair[again]
        suffixes = suffixes[again]
        order[open_] = suffixes
        new = np.ones(len(open_), bool)
        np.not_equal(pair[1:], pair[:-1], out=new[1:])
        start[open_] = new
        heads = np.flatnonzero(new)
        rank[suffixes] = np.repeat(open_[heads], np.diff(np.append(heads, len(new))))
        sorted_bytes *= 2
    return order, rank[:n] if before is None else before


def common_prefixes(text: np.ndarray, order: np.ndarray, group: np.ndarray, known: int, most: int, block: int = 64) -> np.ndarray:
    """For each place but the first, the common prefix with the place before, up to ``most``; 0 unless both are of one group, which share ``known`` bytes.

    Kasai's order: the common prefix of the next suffix of the text is at most
    one shorter, so its comparison starts there.  Many blocks of consecutive
    suffixes advance together.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    places = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
    if not len(places):
        return out
    suffix, other = order[places], order[places - 1]
    by_text = np.argsort(suffix)
    suffix, other, places = suffix[by_text], other[by_text], places[by_text]
    # Blocks: runs of suffixes that follow one another in the text, cut every ``block``.
    new = np.concatenate([[True], np.diff(suffix) != 1])
    run_start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    new |= (np.arange(len(new)) - run_start) % block == 0
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(new)))
    padded = np.concatenate([text, np.zeros(most + 1, np.uint8)])
    limit = len(text)
    length = np.full(len(first), known, np.int64)
    for step in range(int(size.max())):
        live = np.flatnonzero(size > step)
        at = first[live] + step
        i, j = suffix[at], other[at]
        l = np.maximum(length[live] - (step > 0), known)
        going = np.arange(len(live))
        while len(going):
            a, b, m = i[going], j[going], l[going]
            more = (m < most) & (np.maximum(a, b) + m < limit) & (padded[np.minimum(a + m, limit)] == padded[np.minimum(b + m, limit)])
            going = going[more]
            l[going] += 1
        length[live] = l
        out[places[at]] = l
    return out


def repeated_starts(text: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which valid starts have the same ``length`` bytes at an earlier valid start; from the suffix array of one shard."""
    if not valid.any():
        return np.zeros(len(text), bool)
    order, group = suffix_array(text, length)
    known = symbols_of(text, length)[2]
    while known * 2 < length:
        known *= 2
    lcp = common_prefixes(text, order, group, known, length)
    # Runs of suffixes that share their first bytes: only those of several can hold a repeat.
    heads = np.flatnonzero(lcp < length)
    sizes = np.diff(np.append(heads, len(order)))
    inside = np.flatnonzero(np.repeat(sizes > 1, sizes))
    out = np.zeros(len(text), bool)
    if len(inside):
        places, sizes = order[inside], sizes[sizes > 1]
        ok = valid[places]
        first = np.minimum.reduceat(np.where(ok, places, len(text)), np.cumsum(sizes) - sizes)
        out[places] = ok & (places > np.repeat(first, sizes))
    return out


def anchors(text: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """For each start of ``length`` bytes the hash of its anchor, the smallest of the hashes of the ``anchor`` bytes at each place in it."""
    if len(text) < length:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        # Hashes of 8 bytes, then of 16, then of 32.
        h = np.ndarray((len(text) - 7,), "<u8", text.tobytes(), strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        width = 8
        while width < anchor:
            h = h[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) + h[width:]
            width *= 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    w, count = length - anchor + 1, len(text) - length + 1
    least, span = h, 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:count], least[w - span : w - span + count])


def anchor_runs(value: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``[start, end)`` of the runs of wanted starts with one anchor."""
    at = np.flatnonzero(wanted[: len(value)])
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (value[at[1:]] != value[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1] + 1


class Shard:
    """Documents of one shard, in order, with a gap between them."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.bytes = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)

    def valid(self, length: int) -> np.ndarray:
        out = np.ones(len(self.bytes), bool)
        for i, t in enumerate(self.texts):
            out[self.starts[i] + max(0, len(t) - length + 1) : self.starts[i + 1]] = False
        return out


def runs_of(flags: np.ndarray) -> np.ndarray:
    """``[start, end)`` of the runs of true values, one row each."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def removed_spans(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Runs of starts as spans of bytes, merged where they touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        e += length - 1
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


_KEY = "part int, kind int, doc_id bigint, text_hash bigint"
_FOUND = pa.schema(
    [("part", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("pack", pa.int32()), ("hashes", pa.binary())]
)


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Keys and bytes of the documents of each shard, in order; rows with the same key and text once."""
    last = None
    for part in batches_of(batches, "text", shard_bytes):
        keys, texts = [], []
        for doc_id, text_hash, text in zip(part["doc_id"].to_pylist(), part["text_hash"].to_pylist(), part["text"].to_pylist()):
            if (doc_id, text_hash) != last:
                last = (doc_id, text_hash)
                keys.append(last)
                texts.append(text.encode())
        if keys:
            yield keys, texts


def search_shards(length: int, shard_bytes: int):
    """Per document: its bytes, digest and the runs of starts that repeat in the shard; per pack: the distinct anchors of all other starts, twice where several shards of the part have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        seen = again = np.zeros(0, np.uint64)
        fresh: list[np.ndarray] = []

        def merge() -> tuple[np.ndarray, np.ndarray]:
            values, counts = np.unique(np.concatenate([seen, *fresh]), return_counts=True)
            return values, np.union1d(again, values[counts > 1])

        for keys, texts in _shards(batches, shard_bytes):
            shard = Shard(texts)
            valid = shard.valid(length)
            repeats = repeated_starts(shard.bytes, valid, length)
            rows = []
            for (doc_id, text_hash), text, at in zip(keys, texts, shard.starts):
                own = runs_of(repeats[at : at + max(0, len(text) - length + 1)])
                rows.append((doc_id, text_hash, len(text), hashlib.sha256(text).hexdigest(), own[:, 0].tolist(), own[:, 1].tolist()))
            value = anchors(shard.bytes, length)
            fresh.append(np.unique(value[anchor_runs(value, valid & ~repeats)[0]]))
            if sum(map(len, fresh)) > 1 << 20:
                (seen, again), fresh = merge(), []
            n = len(rows)
            columns = [[None] * n, *zip(*rows), [None] * n, [None] * n]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)
        seen, again = merge()
        seen = np.sort(np.concatenate([seen, again]))
        cuts = np.searchsorted(seen, np.arange(1 << _PACKS, dtype=np.uint64) << np.uint64(64 - _PACKS))
        packs = [p for p in np.split(seen, cuts)]
        rows = [(k - 1, p.tobytes()) for k, p in enumerate(packs) if len(p)]
        n = len(rows)
        if n:
            columns = [[number] * n, *[[None] * n] * 6, [r[0] for r in rows], [r[1] for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    return run


def meeting_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the packed hashes of all parts, one pack after the other: those of each part that another shard has too, of any part."""

    def shared(pack: list[tuple[int, bytes]]) -> pa.RecordBatch:
        arrays = [np.frombuffer(b, np.uint64) for _, b in pack]
        values, counts = np.unique(np.concatenate(arrays), return_counts=True)
        values = values[counts > 1]
        rows = []
        for (part, _), a in zip(pack, arrays):
            at = np.minimum(np.searchsorted(values, a), max(0, len(values) - 1))
            hit = a[values[at] == a] if len(values) else a[:0]
            if len(hit):
                rows.append((part, np.unique(hit).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "hashes"])

    last, pack = None, []
    for batch in batches:
        for number, part, hashes in zip(batch.column("pack").to_pylist(), batch.column("part").to_pylist(), batch.column("hashes").to_pylist()):
            if number != last and pack:
                yield shared(pack)
                pack = []
            last = number
            pack.append((part, hashes))
    if pack:
        yield shared(pack)


_SEGMENT = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("anchor", pa.int64()), ("start", pa.int64()), ("segment", pa.binary())]
)


def cut_segments(length: int, shard_bytes: int):
    """Over the rows of one part, hashes first: the runs of starts that repeat in the part, and the strings around anchors that other shards have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: list[np.ndarray] = []
        known: dict[tuple, tuple[list[int], list[int]]] = {}
        sent: set[bytes] = set()

        def texts_of() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for kind, doc_id, text_hash, hashes, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("kind", "doc_id", "text_hash", "hashes", "starts", "ends"))):
                    if kind == 0:
                        packs.append(np.frombuffer(hashes, np.uint64))
                    elif kind == 1:
                        known[doc_id, text_hash] = (starts, ends)
                texts = batch.filter(batch.column("text").is_valid()).select(["doc_id", "text_hash", "text"])
                if texts.num_rows:
                    yield texts

        shared = np.zeros(0, np.uint64)
        for keys, texts in _shards(texts_of(), shard_bytes):
            if packs:
                shared = np.unique(np.concatenate([shared, *packs]))
                packs.clear()
            shard = Shard(texts)
            wanted = shard.valid(length)
            runs: list[tuple[list[int], list[int]]] = []
            for key, at in zip(keys, shard.starts):
                starts, ends = known.pop(key, ([], []))
                for s, e in zip(starts, ends):
                    wanted[at + s : at + e] = False
                runs.append((starts, ends))
            # Starts of one anchor that follow one another make one segment.
            value = anchors(shard.bytes, length)
            first, end = anchor_runs(value, wanted)
            if len(shared) and len(first):
                near = np.minimum(np.searchsorted(shared, value[first]), len(shared) - 1)
                hit = shared[near] == value[first]
                first, end = first[hit], end[hit]
            else:
                first = end = first[:0]
            owner = np.searchsorted(shard.starts, first, "right") - 1
            at = shard.starts[owner]
            out: list[tuple] = []
            for i, s, e, anchor in zip(owner.tolist(), (first - at).tolist(), (end - at).tolist(), value[first].view(np.int64).tolist()):
                # A segment that this part has sent repeats throughout; documents come in order.
                segment = texts[i][s : e + length - 1]
                digest = hashlib.blake2b(segment, digest_size=16).digest()
                if digest in sent:
                    runs[i] = ([*runs[i][0], s], [*runs[i][1], e])
                else:
                    sent.add(digest)
                    out.append((*keys[i], None, None, anchor, s, segment))
            out += [(*key, *run, None, None, None) for key, run in zip(keys, runs) if run[0]]
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out[i : i + 20_000]), _SEGMENT)], schema=_SEGMENT)

    return run


def merge_segments(length: int):
    """Over segments in order of anchor and document: the runs of starts whose string an earlier segment of the anchor has."""

    def merged(rows: list[tuple]) -> list[tuple]:
        seen = np.zeros(0, f"S{length}")
        out, distinct, whole = [], [], set()
        for r in rows:  # of equal segments the first is looked at, the others repeat throughout
            if r[4] in whole:
                out.append((r[1], r[2], r[3], r[3] + len(r[4]) - length + 1))
            else:
                whole.add(r[4])
                distinct.append(r)
        rows = distinct if len(distinct) > 1 else []
        for i in range(0, len(rows), 256):
            part = rows[i : i + 256]
            strings = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(r[4], np.uint8), length) for r in part]
            counts = [len(s) for s in strings]
            all_ = np.ascontiguousarray(np.concatenate(strings)).view(f"S{length}").ravel()
            values, first = np.unique(all_, return_index=True)
            at = np.searchsorted(values, all_)
            dup = first[at] < np.arange(len(all_))
            if len(seen):
                near = np.minimum(np.searchsorted(seen, values), len(seen) - 1)
                old = seen[near] == values
                dup |= old[at]
                values = values[~old]
            if i + 256 < len(rows):
                seen = np.insert(seen, np.searchsorted(seen, values), values) if len(seen) else values
            begin = 0
            for r, n in zip(part, counts):
                for s, e in runs_of(dup[begin : begin + n]):
                    out.append((r[1], r[2], r[3] + int(s), r[3] + int(e)))
                begin += n
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "text_hash", "start", "segment"))):
                if row[0] != last:
                    if len(rows) > 1:
                        out += merged(rows)
                    last, rows = row[0], []
                rows.append(row)
            yield _runs(out)
        if len(rows) > 1:
            yield _runs(merged(rows))

    return run


def _runs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "text_hash", "start", "end"])


def cut_out(length: int):
    """Over rows in order of document, its runs before its text: the documents that have runs, without these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, None
        for batch in batches:
            rows = []
            for doc_id, text_hash, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "runs"))):
                if runs is not None:
                    last, waiting = (doc_id, text_hash), runs
                    continue
                # Rows that share id and text are one document.
                if waiting is None or (doc_id, text_hash) != last:
                    continue
                data = text.encode()
                spans = removed_spans([(r["start"], r["end"]) for r in waiting], length)
                waiting = None
                pieces, at = [], 0
                for s, e in spans:
                    pieces.append(data[at:s])
                    at = e
                rows.append((doc_id, text_hash, sum(e - s for s, e in spans), [s for s, _ in spans], [e for _, e in spans], b"".join(pieces) + data[at:]))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["doc_id", "text_hash", "n_removed", "starts", "ends", "left"])

    return run


def cleaned(docs: DataFrame, length: int = LENGTH, shard_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_hash, n_bytes, sha)`` of all documents, and ``(doc_id, text_hash, n_removed, starts, ends, left)`` of those that lose bytes.

    "Earlier" is a smaller ``doc_id`` (null first; equal ids by a hash of the
    text), or an earlier start.  Rows that share ``doc_id`` and text count as
    one document.  A null or empty text has no bytes and loses none.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(n)).cast("int"))
    order = ["part", "doc_id", "text_hash"]
    found = kept(
        rows.repartitionById(n, F.col("part")).sortWithinPartitions(*order).select("doc_id", "text_hash", "text").mapInArrow(
            search_shards(length, shard_bytes), "part int, doc_id bigint, text_hash bigint, n_bytes bigint, sha string, starts array<bigint>, ends array<bigint>, pack int, hashes binary"
        )
    )
    whole = found.filter("pack is null").select("doc_id", "text_hash", "n_bytes", "sha")
    packed = found.filter("pack is not null").select("part", "pack", "hashes")
    shared = kept(packed.repartition("pack").sortWithinPartitions("pack", "part").mapInArrow(meeting_hashes, "part int, hashes binary"))

    none = {"hashes": "binary", "starts": "array<bigint>", "ends": "array<bigint>", "text": "string", "doc_id": "bigint", "text_hash": "bigint"}

    def shaped(frame: DataFrame, kind: int) -> DataFrame:
        cols = [F.col(c) if c in frame.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()]
        return frame.select("part", F.lit(kind).alias("kind"), *cols)

    own = found.filter("pack is null and size(starts) > 0").select("doc_id", "text_hash", "starts", "ends")
    own = own.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(n)).cast("int"))
    all_ = shaped(shared, 0).unionByName(shaped(own, 1)).unionByName(shaped(rows.select("part", "doc_id", "text_hash", "text"), 2))
    dealt = all_.repartitionById(n, F.col("part")).sortWithinPartitions("part", "kind", "doc_id", "text_hash")
    touched = kept(dealt.mapInArrow(cut_segments(length, shard_bytes), "doc_id bigint, text_hash bigint, starts array<bigint>, ends array<bigint>, anchor bigint, start bigint, segment binary"))
    within = touched.filter("anchor is null").select("doc_id", "text_hash", "starts", "ends")
    segments = touched.filter("anchor is not null").select("anchor", "doc_id", "text_hash", "start", "segment")

    hot = kept(segments.groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor"))
    cool = segments.join(hot, "anchor", "left_anti")
    runs = cool.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "text_hash", "start").mapInArrow(merge_segments(length), "doc_id bigint, text_hash bigint, start bigint, end bigint")
    # Hot anchors: one row per string, whose first holder is found by a grouping with partial sums.
    strings = segments.join(hot, "anchor", "left_semi").select(
        "doc_id", "text_hash", "start", F.posexplode(F.expr(f"transform(sequence(0, octet_length(segment) - {length}), i -> substring(segment, i + 1, {length}))")).alias("at", "string")
    )
    strings = strings.select("doc_id", "text_hash", (F.col("start") + F.col("at")).alias("start"), "string")
    place = F.struct("doc_id", "text_hash", "start")
    firsts = kept(strings.groupBy("string").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("string", "first"))
    runs = runs.union(strings.join(firsts, "string").filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "start", (F.col("start") + 1).alias("end")))
    runs = runs.union(within.select("doc_id", "text_hash", F.explode(F.arrays_zip("starts", "ends")).alias("r")).select("doc_id", "text_hash", "r.starts", "r.ends"))
    per_doc = runs.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    # Runs meet the texts by the same part as before; texts are read again rather than kept.
    per_doc = per_doc.select(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(n)).cast("int").alias("part"), F.lit(0).alias("kind"), "doc_id", "text_hash", F.lit(None).cast("string").alias("text"), "runs")
    texts = rows.select("part", F.lit(1).alias("kind"), "doc_id", "text_hash", "text", F.lit(None).cast(per_doc.schema["runs"].dataType).alias("runs"))
    both = per_doc.union(texts).repartitionById(n, F.col("part")).sortWithinPartitions("part", "doc_id", "text_hash", "kind")
    return whole, kept(both.select("doc_id", "text_hash", "text", "runs").mapInArrow(cut_out(length), "doc_id bigint, text_hash bigint, n_removed bigint, starts array<bigint>, ends array<bigint>, left binary"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``; see :func:`cleaned` for odd input."""
    whole, changed = cleaned(docs, length)
    left = changed.select("doc_id", "text_hash", "n_removed", F.size("starts").cast("bigint").alias("n_spans"), F.sha2("left", 256).alias("left_sha"))
    zero = F.lit(0).cast("bigint")
    return joined(whole, left, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("left_sha", "sha").alias("kept_sha256")
    )


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut from ``text``; all other columns stay as they are.

    ``n_chars``, where there is such a column, is counted anew for the texts
    that change.  A cut may leave part of a character; such bytes are left
    out of the text.  Rows whose text is wholly cut go; rows that were empty
    stay.  Of rows that share ``doc_id`` and text, all are cut alike.
    """

    @F.pandas_udf("string")
    def readable(data):
        return data.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    _, changed = cleaned(docs, length)
    gone = changed.filter("n_removed > 0").select("doc_id", "text_hash", "left", readable("left").alias("new"))
    out = joined(wrapped(docs).withColumn("text_hash", F.xxhash64("text")), gone, ["doc_id", "text_hash"], "left")
    out = out.filter("left is null or octet_length(left) > 0")
    cut, columns = F.col("left").isNotNull(), []
    for name in docs.columns:
        column = F.col("row").getField(name)
        if name == "text":
            column = F.when(cut, F.col("new")).otherwise(column)
        elif name == "n_chars":
            column = F.when(cut, F.length("new").cast(docs.schema[name].dataType)).otherwise(column)
        columns.append(column.alias(name))
    return out.select(columns)
