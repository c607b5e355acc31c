"""Packing tokens into sequences of one length by Karmarkar-Karp multiway differencing.

A document becomes token ids and an end mark.  It is cut into whole windows,
and its rest into even pieces of at most ``max_piece`` ids.  Pieces of many
documents are dealt into windows: partial partitions are merged two by two,
those of the largest imbalance first and with opposing order, so that large
parts meet small ones.  Where a window would exceed the capacity, the number
of windows rises and the differencing starts anew.
"""

from __future__ import annotations

import heapq
import os
import zlib
from bisect import insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import batches_of, documents

CAPACITY = 2048
END = 1
#: A space beside another white-space character: words cannot be told apart by single spaces there.
_SPACES = r"\t\n\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = f"[ ][ {_SPACES}]|[{_SPACES}][ ]|[ ]$"


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Deal numbered ``sizes`` into ``windows`` of near-equal sums; Karmarkar-Karp with all partial sums of a partition."""
    # A partition is its parts that are not empty, ascending: (sum, smallest item, tree of items).
    heap = [(-s, i, [(s, i, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        if len(a) + len(b) <= windows:
            if len(b) == 1:
                insort(a, b[0])
            else:
                a = sorted(a + b)
        else:
            left = [(0, -1, None)] * (windows - len(a)) + a
            right = [(0, -1, None)] * (windows - len(b)) + b
            parts = []
            for x, y in zip(left, reversed(right)):
                if x[2] is None or y[2] is None:
                    parts.append(y if x[2] is None else x)
                else:
                    parts.append((x[0] + y[0], min(x[1], y[1]), (x[2], y[2])))
            a = sorted((p for p in parts if p[2] is not None), key=lambda p: p[:2])
        heapq.heappush(heap, (-(a[-1][0] - (a[0][0] if len(a) == windows else 0)), min(i, j), a))
    out = []
    for _, _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            else:
                items.append(node)
        out.append(sorted(items))
    return out


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; as few as differencing can fill."""
    n = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, n)
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return dealt
        n += 1


#: How a byte-level vocabulary of this family splits text before merging.  Fixed value.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Tokens as bytes: a byte that prints stands for itself, the others for the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {bytes(of[c] for c in token): i for token, i in vocabulary.items() if all(c in of for c in token)}


def encoder(path: str):
    """A function from texts to ``(ids, offsets)`` with the vocabulary at ``path``.

    Distinct words of a batch are encoded once: where every space stands
    between two other characters that are no white space, a space begins a new
    word for the tokenizer too.  These words are merged by the faster of two
    libraries over the same vocabulary; texts with other white space or with a
    special token written out, first words and very long words by
    ``tokenizers``, which gives a special token its own id.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = byte_ranks({t: i for t, i in tokenizer.get_vocab().items() if t not in special})
    merger = tiktoken.Encoding("words", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    width = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in ranks.items():
        width[i] = len(token)

    def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum()))
        return ids, np.concatenate([[0], np.cumsum(lengths)])

    def each(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spaced(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word after a space.  Many words are encoded as one text; no token spans two, so byte lengths tell them apart."""
        listed = words.to_pylist()
        long = pc.greater(pc.binary_length(words), 2000).to_numpy(zero_copy_only=False)
        lists = []
        for i in range(0, len(listed), 1000):
            joined = "".join(" " + w for w in listed[i : i + 1000])
            lists.append(each([joined])[0] if long[i : i + 1000].any() else merger.encode_ordinary(joined))
        ids, _ = flat(lists)
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        return ids, np.concatenate([[0], np.searchsorted(np.cumsum(width[ids]), ends) + 1])

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        for token in special:
            odd = odd | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        shown = pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts)
        words = pc.split_pattern(shown, " ")
        starts = words.offsets.to_numpy().astype(np.int64)
        coded = pc.list_flatten(words).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        # The first word of a text has no space before it: it is encoded by itself, as are the odd texts.
        n, heads = len(coded.dictionary), codes[starts[:-1]]
        codes[starts[:-1]] = n + np.arange(len(texts))
        first = coded.dictionary.take(pa.array(heads)).to_pylist()
        for i in np.flatnonzero(odd):
            first[i] = texts[i].as_py()
        ids, at = spaced(coded.dictionary)
        more, after = flat(each(first))
        ids, at = np.concatenate([ids, more]), np.concatenate([at, at[-1] + after[1:]])
        lengths = np.diff(at)[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(at[codes] - ends[:-1], lengths) + np.arange(ends[-1])
        return ids[take], ends[starts]

    return encode


PACKED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int64()))])


def pack_shards(path: str, capacity: int, max_piece: int, group_windows: int, with_ids: bool):
    """Encode and pack the documents of one task, some hundred windows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        base = TaskContext.get().partitionId() << 32
        sequence = 0
        waiting: list[tuple] = []  # doc_id, start, length, crc32, doc_tokens, ids
        total = 0
        full = group_windows * capacity - 2 * max_piece

        def packed(pieces: list[tuple]) -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for window in windows_of([p[2] for p in pieces], capacity):
                at = 0
                for i in window:
                    p = pieces[i]
                    rows.append((*p[:5], base + sequence, at, p[5]))
                    at += p[2]
                sequence += 1
            return batch(rows)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PACKED)], schema=PACKED)

        for part in batches_of(batches, "text", 16 << 20):
            ids, at = encode(part["text"].combine_chunks().cast(pa.large_string()))
            whole = []
            for k, doc_id in enumerate(part["doc_id"].to_pylist()):
                own = np.append(ids[at[k] : at[k + 1]], np.uint32(END)).astype("<u4")
                n = len(own)
                rest = n % capacity
                cuts = list(range(0, n - rest + 1, capacity))
                parts = -(-rest // max_piece)
                cuts += [n - rest + rest * (i + 1) // parts for i in range(parts)]
                for start, end in zip(cuts, cuts[1:]):
                    piece = own[start:end]
                    row = (doc_id, start, end - start, zlib.crc32(piece.tobytes()), n, piece.astype(np.int64) if with_ids else None)
                    if end - start == capacity:
                        whole.append((*row[:5], base + sequence, 0, row[5]))
                        sequence += 1
                    else:
                        waiting.append(row)
                        total += end - start
                        if total >= full:
                            yield packed(waiting)
                            waiting, total = [], 0
            if whole:
                yield batch(whole)
        if waiting:
            yield packed(waiting)

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, max_piece: int = 512, group_windows: int = 256, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, and its ``ids`` if asked for.

    Each task packs the documents it reads, so nothing is shuffled; a task has
    one group of windows at most that is not full.  A null or empty text is
    one end mark.  Rows may repeat; each is packed on its own.
    """
    out = documents(docs).mapInArrow(
        pack_shards(path, capacity, max_piece, group_windows, with_ids),
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<bigint>",
    )
    return out if with_ids else out.drop("ids")
