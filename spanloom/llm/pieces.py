"""SentencePiece encoding and decoding with batched Viterbi in numpy.

A text is split at single spaces; each word, with the space mark before it, is
cut into the pieces of the vocabulary with the greatest total score.  Distinct
words of a batch are encoded once, all words of one length together: step by
step along the word, the hashes of the substrings that end there are looked up
among the sorted hashes of the pieces, and the best start is stored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import batches_of, documents

MARK = 0x2581
#: Stands for the mark's own character inside a word, so that it is spelled in bytes and comes back as it was.
_LITERAL_MARK = 0x110001
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: How much worse than the worst piece a character without a piece is.
UNKNOWN_PENALTY = 10.0


class Pieces:
    """The pieces of a vocabulary file: their scores, sorted hash keys and bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        names = [model.id_to_piece(i) for i in normal]
        self._index(n, normal, names, [model.get_score(i) for i in normal], {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)})

    def _index(self, n: int, ids: list[int], names: list[str], scores: list[float], byte_ids: dict[int, int]) -> None:
        self.size = n
        self.names = dict(zip(names, ids))
        self.scores = dict(zip(names, scores))
        self.longest = max(map(len, names))
        self.unknown = min(scores) - UNKNOWN_PENALTY
        hashes = np.array([_hash_of([ord(c) for c in name]) for name in names], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], np.array(ids, np.int64)[order]
        self.key_scores = np.array(scores)[order]
        self.maybe = np.zeros(1 << 22, bool)  # whether any key begins with these bits
        self.maybe[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int64)
        texts = [b""] * n
        for name, i in zip(names, ids):
            texts[i] = name.replace(chr(MARK), " ").encode()
        for b, i in byte_ids.items():
            texts[i] = bytes([b])
        self.text_starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.texts = np.frombuffer(b"".join(texts), np.uint8)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Places among the keys, -1 where there is none."""
        out = np.full(hashes.shape, -1, np.int64)
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == hashes[some], at, -1)
        return out

    def segment(self, words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Words of one length, one row of code points each: for each step from the end backwards the piece ids (-1: none left), and the scores.

        A character without a piece is its code point below -1.
        Of equally good cuts, the one whose last piece is shortest is taken.
        """
        count, n = words.shape
        sums, powers = np.zeros((count, n + 1), np.uint64), np.ones(self.longest + 1, np.uint64)
        best = np.full((count, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((count, n + 1), np.int32)
        piece = np.full((count, n + 1), -1, np.int64)
        with np.errstate(over="ignore"):
            for k in range(self.longest):
                powers[k + 1] = powers[k] * _BASE
            for end in range(1, n + 1):
                sums[:, end] = sums[:, end - 1] * _BASE + words[:, end - 1]
                for size in range(1, min(end, self.longest) + 1):
                    at = self.lookup(_finished(sums[:, end] - sums[:, end - size] * powers[size], size))
                    total = np.where(at >= 0, best[:, end - size] + self.key_scores[at], -np.inf)
                    found = self.key_ids[at]
                    if size == 1:
                        none = at < 0
                        total = np.where(none, best[:, end - 1] + self.unknown, total)
                        found = np.where(none, -2 - words[:, end - 1].astype(np.int64), found)
                    better = total > best[:, end]
                    best[better, end] = total[better]
                    back[better, end] = size
                    piece[better, end] = found[better]
        steps, at, rows = [], np.full(count, n), np.arange(count)
        while (at > 0).any():
            steps.append(np.where(at > 0, piece[rows, at], -1))
            at = at - np.where(at > 0, back[rows, at], 0)
        return steps, best[:, n]

    def encode_words(self, words: pa.Array, block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, offsets, scores)`` of distinct words, each with the mark before it."""
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        points = np.where(points == MARK, np.uint64(_LITERAL_MARK), points)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        owners, order, pieces = [], [], []
        scores = np.zeros(len(words))
        for n in np.unique(lengths):
            same = np.flatnonzero(lengths == n)
            size = max(1, block // (int(n) + 1))
            for i in range(0, len(same), size):
                chosen = same[i : i + size]
                matrix = np.full((len(chosen), n + 1), MARK, np.uint64)
                matrix[:, 1:] = points[starts[chosen][:, None] + np.arange(n)]
                steps, scores[chosen] = self.segment(matrix)
                for k, ids in enumerate(steps):
                    some = ids != -1
                    owners.append(chosen[some]), pieces.append(ids[some]), order.append(np.full(some.sum(), -k))
        owner, piece, step = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (owners, pieces, order))
        sorted_ = np.lexsort((step, owner))
        owner, piece = owner[sorted_], piece[sorted_]
        # Characters without a piece are spelled in bytes.
        unknown = np.flatnonzero(piece < 0)
        spelled = [self.byte_ids[np.frombuffer(chr(MARK if c == _LITERAL_MARK else c).encode("utf-8", "surrogatepass"), np.uint8)] for c in (-2 - piece[unknown]).tolist()]
        width = np.ones(len(piece), np.int64)
        width[unknown] = [len(s) for s in spelled]
        ids = np.repeat(piece, width)
        if spelled:
            at = np.concatenate([[0], np.cumsum(width)])
            sizes = width[unknown]
            ids[np.repeat(at[unknown], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.concatenate(spelled)
        counts = np.bincount(owner, width, len(words)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)]), scores

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, offsets, scores)`` of whole texts; an empty text is one mark."""
        words = pc.split_pattern(texts, " ")
        starts = words.offsets.to_numpy().astype(np.int64)
        coded = pc.list_flatten(words).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        ids, at, scores = self.encode_words(coded.dictionary)
        sizes = np.diff(at)[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(at[codes] - ends[:-1], sizes) + np.arange(ends[-1])
        return ids[take].astype(np.int32), ends[starts], np.add.reduceat(scores[codes], starts[:-1]) if len(texts) else np.zeros(0)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of whole encodings; the space of the first mark is left out."""
        sizes = np.diff(self.text_starts)[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = self.texts[np.repeat(self.text_starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = ends[offsets]
        return [data[i + 1 : j].decode("utf-8", "surrogatepass") for i, j in zip(cuts, cuts[1:])]


def _finished(h, size: int):
    h = (h ^ np.uint64(size)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _hash_of(points: list[int]) -> int:
    h = 0
    for p in points:
        h = (h * int(_BASE) + p) % 2**64
    h = (h ^ len(points)) * 0xBF58476D1CE4E5B9 % 2**64
    return h ^ (h >> 29)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, ids, score)``; ``path`` names the vocabulary file on every machine.

    Null texts are empty; an empty text is the mark alone.  Runs of spaces
    give one mark each.  Rows may repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for part in batches_of(batches, "text", 8 << 20):
            ids, offsets, scores = pieces.encode(part["text"].combine_chunks().cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(scores)], ["doc_id", "ids", "score"])

    return documents(docs).mapInArrow(run, "doc_id bigint, ids array<int>, score double")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            lists = [v if v is not None else [] for v in batch.column("ids").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(v) for v in lists])]).astype(np.int64)
            texts = pieces.decode(np.array([i for v in lists for i in v], np.int64), offsets)
            null = batch.column("ids").is_null().to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if z else t for t, z in zip(texts, null)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_ids, n_byte_ids, ids_crc32, score, decoded_sha256, round_trip)``: encode, decode, and compare with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        is_byte = np.zeros(pieces.size, bool)
        is_byte[pieces.byte_ids] = True
        for part in batches_of(batches, "text", 8 << 20):
            texts = part["text"].combine_chunks().cast(pa.large_string())
            ids, at, scores = pieces.encode(texts)
            decoded = pieces.decode(ids, at)
            small = ids.astype("<u4")
            byte_ids = np.concatenate([[0], np.cumsum(is_byte[ids])])
            columns = [
                part["doc_id"].combine_chunks(),
                pa.array(np.diff(at)),
                pa.array(byte_ids[at[1:]] - byte_ids[at[:-1]]),
                pa.array([zlib.crc32(small[i:j].tobytes()) for i, j in zip(at, at[1:])], pa.int64()),
                pa.array(scores),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded]),
                pa.array([a == b for a, b in zip(decoded, texts.to_pylist())]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "score", "decoded_sha256", "round_trip"])

    return documents(docs).mapInArrow(run, "doc_id bigint, n_ids bigint, n_byte_ids bigint, ids_crc32 bigint, score double, decoded_sha256 string, round_trip boolean")
