"""Scoring texts with a gated recurrent language model.

Tokens are words and one end per text.  Words are counted over all training
documents; the most frequent are the model's vocabulary, which grows with the
number of distinct words to the power of 0.4, every other word is one symbol,
whose probability is shared out by the counts.  The model is a gated recurrent
unit with an output softmax factored into classes of words, few words in those
of frequent ones, trained in numpy by backpropagation through windows of a few
tokens, the state carried from one to the next.

Training goes in rounds.  The training documents are dealt by hash, so that a
part has about the same number of tokens in every round however many files they
come from; the number of parts grows with the tokens.  A round starts all parts
from one model, and the mean of what they make of it starts the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, documents, kept, release

HIDDEN = 16
WINDOW = 32
#: No power of two: rows of a matrix of lanes would fall on the same lines of the cache.
LANES = 1000
#: Rounds of training, and about how many tokens a part learns from in each.
ROUNDS, PIECE = 4, 1 << 21
#: Numbers of a model that are added up together.
_SLICE = 1 << 15
#: The hash that stands for the end of a text.
END = np.uint64(1)
#: Hashes are packed by this many of their leading bits.
_PACKS = 10


def side_of(words: int) -> int:
    """The square root of the size of the vocabulary for so many distinct words: what a token costs grows with it."""
    return max(8, ceil(5 * words**0.2))


def classes_of(side: int) -> np.ndarray:
    """Where the classes of a vocabulary of ``side ** 2`` words in order of frequency begin, and its end.

    A token costs all classes and the words of its own.  Where frequency falls
    as one over the rank, both together are least for classes whose sizes grow
    as the square root of the rank, so limits lie at squares.  Number 0, any
    other word, is a class by itself and costs no more than the classes.
    """
    n, count = side * side, max(2, round(0.6 * side))
    limits = 1 + np.round((n - 1) * (np.arange(count + 1) / count) ** 2).astype(np.int64)
    return np.unique(np.concatenate([[0], limits]))


def token_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct tokens of all texts, which of them each token is, and where each text begins.

    Each text is closed by ``END``, the last of the distinct ones.  A-Z are lower-cased.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    owner, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    some = pc.not_equal(flat, "")
    owner = owner[some.to_numpy(zero_copy_only=False)].astype(np.int64)
    coded = flat.filter(some).dictionary_encode()
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
    sizes = np.bincount(owner, minlength=len(texts)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.full(starts[-1], len(known), np.int64)
    codes[np.arange(len(owner)) + owner] = coded.indices.to_numpy()
    return np.append(known, END), codes, starts


def count_words(chunk: int):
    """Per pack of leading bits: the distinct words of one part and how often its training documents have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in batches_of(batches, "text", chunk):
            own, codes, starts = token_codes(part["text"].combine_chunks())
            learns = ~part["held_out"].to_numpy()
            n = np.bincount(codes, np.repeat(learns, np.diff(starts)), len(own)).astype(np.int64)
            words, inverse = np.unique(np.concatenate([words, own]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, n]), len(words)).astype(np.int64)
        number = TaskContext.get().partitionId()
        cuts = np.searchsorted(words, np.arange(1, 1 << _PACKS, dtype=np.uint64) << np.uint64(64 - _PACKS))
        rows = [(k, w.tobytes(), c.tobytes()) for k, (w, c) in enumerate(zip(np.split(words, cuts), np.split(counts, cuts))) if len(w)]
        yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "pack", "words", "counts"])

    return run


def sum_counts():
    """Over the packs of all parts in order: the sums over all parts, sent back to each part that asked; and per pack its size, sum and most frequent words (part -1).

    A pack has about its share of all distinct words; it sends as many words as
    the vocabulary of twice that many would have.
    """

    def summed(number: int, rows: list[tuple]) -> pa.RecordBatch:
        words = [np.frombuffer(w, np.uint64) for _, w, _ in rows]
        all_, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(len(all_), np.int64)
        np.add.at(total, inverse, np.concatenate([np.frombuffer(c, np.int64) for _, _, c in rows]))
        best = np.lexsort((all_, -total))[: side_of((2 * len(all_) + 8) << _PACKS) ** 2]
        out = [(-1, int((total > 0).sum()), int(total.sum()), all_[best].tobytes(), total[best].tobytes())]
        for (part, _, _), w in zip(rows, words):
            c = total[np.searchsorted(all_, w)]
            out.append((part, 0, 0, w[c > 0].tobytes(), c[c > 0].tobytes()))
        types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], ["part", "distinct", "total", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            for number, *row in zip(*(batch.column(c).to_pylist() for c in ("pack", "part", "words", "counts"))):
                if number != last and rows:
                    yield summed(last, rows)
                    rows = []
                last = number
                rows.append(tuple(row))
        if rows:
            yield summed(last, rows)

    return run


@dataclass
class Vocabulary:
    """Hashes of the modelled words in order of frequency; number 0 is any other word."""

    hashes: np.ndarray
    counts: np.ndarray
    train_tokens: int
    train_words: int
    side: int = 64

    def __post_init__(self) -> None:
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]
        self.other_tokens = self.train_tokens - int(self.counts.sum())
        self.other_words = self.train_words - int((self.counts > 0).sum())
        self.end = int(self.numbers(np.array([END]))[0])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at] + 1, 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place, through the exponential, which numpy has for several numbers at once."""
    x *= -2
    np.exp(x, out=x)
    x += 1
    np.divide(2, x, out=x)
    x -= 1
    return x


def _weights(logits: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of a softmax, in place, their sums, and the log probability of a picked column of each row.

    Weights are taken as they are where they are in the range of 32-bit
    numbers, as nearly always; else relative to the largest of each row.
    """
    rows, ones = np.arange(len(logits)), np.ones(logits.shape[1], np.float32)
    if len(logits) and logits.max() < 60:
        chosen = logits[rows, picked]
        kept_ = logits.copy() if chosen.min() < -60 else None
        np.exp(logits, out=logits)
        total = logits @ ones
        if total.min() > 1e-25:
            return logits, total, chosen - np.log(total)
        logits = kept_ if kept_ is not None else np.log(np.maximum(logits, 1e-37))
    logits -= logits.max(axis=1, keepdims=True)
    chosen = logits[rows, picked]
    np.exp(logits, out=logits)
    total = logits @ ones
    return logits, total, chosen - np.log(total)


class Recurrent:
    """The parameters, as one flat vector of 32-bit numbers, and what is computed with them."""

    def __init__(self, flat: np.ndarray, side: int = 64):
        self.flat, self.side = flat, side
        self.limits = classes_of(side)
        sizes = np.diff(self.limits)
        # 16 bits where they do: numpy sorts those by counting.
        self.class_of = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) < 1 << 16 else np.int64), sizes)
        at = 0
        for name, shape in self.shapes(side).items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n
        # The words of a class: a matrix of its own for each.
        self.words = [(self.ww[a * HIDDEN : b * HIDDEN].reshape(HIDDEN, b - a), self.bw[a:b]) for a, b in zip(self.limits, self.limits[1:])]

    @staticmethod
    def shapes(side: int) -> dict[str, tuple[int, ...]]:
        v, h, c = side * side, HIDDEN, len(classes_of(side)) - 1
        return {"embed": (v, h), "w": (h, 3 * h), "b": (3 * h,), "u": (h, 3 * h), "wc": (h, c), "bc": (c,), "ww": (v * h,), "bw": (v,)}

    @classmethod
    def start(cls, vocabulary: Vocabulary) -> "Recurrent":
        """Small weights from a fixed seed; the output starts at the frequencies of classes and words."""
        rng = np.random.default_rng(7)
        side = vocabulary.side
        size = sum(int(np.prod(s)) for s in cls.shapes(side).values())
        model = cls((rng.standard_normal(size) * 0.1).astype(np.float32), side)
        model.b[:] = 0
        counts = np.full(side * side, -1.0)
        counts[0] = max(vocabulary.other_tokens, 1)
        counts[1 : 1 + len(vocabulary.counts)] = np.maximum(vocabulary.counts, 0.5)
        held = np.where(counts > 0, counts, 0)
        each = np.add.reduceat(held, model.limits[:-1])
        model.bw[:] = np.where(counts > 0, np.log(np.maximum(held, 1e-9)) - np.log(np.maximum(each, 1e-9))[model.class_of], -1e9)
        model.bc[:] = np.where(each > 0, np.log(np.maximum(each, 1e-9)) - np.log(held.sum()), -1e9)
        model.ww[:] *= 0.1
        model.wc[:] *= 0.1
        return model

    def table(self) -> np.ndarray:
        """What each word brings into a step."""
        return self.embed @ self.w + self.b

    def window(self, inputs: np.ndarray, fresh: np.ndarray | None, state: np.ndarray, table: np.ndarray | None = None):
        """States of one window; ``inputs`` and ``fresh`` (start of a text, None if nowhere) are (steps, lanes).

        Inside a step lanes are columns, so that gates are whole rows.
        """
        table = self.table() if table is None else table
        h, n = HIDDEN, len(inputs)
        states = np.empty((n, state.shape[0], h), np.float32)
        u = np.ascontiguousarray(self.u.T)
        now = np.ascontiguousarray(state.T)
        cache = []
        for t in range(n):
            before = now * ~fresh[t] if fresh is not None and fresh[t].any() else now
            x = np.ascontiguousarray(table.take(inputs[t], axis=0).T)
            g = u @ before
            x[: 2 * h] += g[: 2 * h]
            zr = _sigmoid(x[: 2 * h])
            z, r, new = zr[:h], zr[h:], x[2 * h :]
            new += r * g[2 * h :]
            _tanh(new)
            now = before - new
            now *= z
            now += new
            states[t] = now.T
            cache.append((before, g[2 * h :], z, r, new))
        return states, cache, now.T

    def output(self, states: np.ndarray, targets: np.ndarray, grads: "Recurrent | None" = None):
        """Natural log probabilities of the targets after each state; with ``grads``, also the gradient of their sum over the states."""
        c = self.class_of[targets]
        logits = states @ self.wc
        logits += self.bc
        p, total, logp = _weights(logits, c)
        back = None
        if grads is not None:
            p /= -total[:, None]
            p[np.arange(len(targets)), c] += 1
            grads.wc += states.T @ p
            grads.bc += np.ones(len(p), np.float32) @ p
            back = p @ self.wc.T
        # Class after class; number 0 comes first and is alone in its class.
        ends = np.concatenate([[0], np.cumsum(np.bincount(c, minlength=len(self.words)))])
        order = np.argsort(c, kind="stable")[ends[1] :]
        ends -= ends[1]
        k = targets[order] - self.limits[c[order]]
        sorted_states = states.take(order, axis=0)
        found = np.zeros(len(order), logp.dtype)
        behind = np.zeros_like(sorted_states) if grads is not None else None
        for j in range(1, len(self.words)):
            a, b = ends[j], ends[j + 1]
            if a == b:
                continue
            s, picked, (weights, offsets) = sorted_states[a:b], k[a:b], self.words[j]
            logits = s @ weights
            logits += offsets
            p, total, found[a:b] = _weights(logits, picked)
            if grads is not None:
                p /= -total[:, None]
                p[np.arange(b - a), picked] += 1
                own, own_offsets = grads.words[j]
                own += s.T @ p
                own_offsets += np.ones(len(p), np.float32) @ p
                np.matmul(p, weights.T, out=behind[a:b])
        logp[order] += found
        if grads is not None:
            back[order] += behind
        return logp, back

    def learn(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, state: np.ndarray, grads: "Recurrent"):
        """Add the gradient of the log probability of one window to ``grads``; the state after it."""
        states, cache, after = self.window(inputs, fresh, state)
        n, lanes, h = states.shape
        _, back = self.output(states.reshape(n * lanes, h), targets.reshape(-1), grads)
        back = back.reshape(n, lanes, h)
        dx = np.empty((n, lanes, 3 * h), np.float32)
        carried = np.zeros((h, lanes), np.float32)
        for t in range(n - 1, -1, -1):
            before, g, z, r, new = cache[t]
            d = back[t].T + carried
            dg = np.empty((3 * h, lanes), np.float32)
            dz, dr, dn = dg[:h], dg[h : 2 * h], dg[2 * h :]
            rest = 1 - z
            np.multiply(d, rest, out=dn)
            dn *= 1 - new * new
            np.multiply(before - new, d, out=dz)
            dz *= z
            dz *= rest
            np.multiply(dn, g, out=dr)
            dr *= r
            dr *= 1 - r
            dx[t] = dg.T
            dn *= r
            grads.u += before @ dg.T
            carried = self.u @ dg
            d *= z
            carried += d
            if fresh[t].any():
                carried *= ~fresh[t]
        flat = dx.reshape(-1, 3 * h)
        # Sum the gradients of equal inputs once, then go through the embedding.
        words = inputs.reshape(-1)
        order = np.argsort(words.astype(np.uint16) if len(self.embed) <= 1 << 16 else words, kind="stable")
        ordered = words[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        per_word, words = np.add.reduceat(flat.take(order, axis=0), first, axis=0), ordered[first]
        grads.b += per_word.sum(axis=0)
        grads.w += self.embed[words].T @ per_word
        grads.embed[words] += per_word @ self.w.T
        return after

    def text_scores(self, tokens: np.ndarray, starts: np.ndarray, end: int, lanes: int = LANES) -> np.ndarray:
        """Natural log probability of each text's tokens, its whole length through, the state carried from window to window."""
        n = len(starts) - 1
        sizes = np.diff(starts)
        by_size = np.argsort(-sizes, kind="stable")
        inputs = np.concatenate([[end], tokens[:-1]])
        inputs[starts[:-1]] = end
        logp = np.zeros(len(tokens))
        table = self.table()
        for first in range(0, n, lanes):
            docs = by_size[first : first + lanes]
            state = np.zeros((len(docs), HIDDEN), np.float32)
            for at in range(0, int(sizes[docs[0]]), WINDOW):
                live = int(np.searchsorted(-sizes[docs], -at, "left"))
                docs, state = docs[:live], state[:live]
                steps = min(WINDOW, int(sizes[docs[0]]) - at)
                place = starts[docs][None, :] + at + np.arange(steps)[:, None]
                inside = at + np.arange(steps)[:, None] < sizes[docs][None, :]
                place = np.where(inside, place, 0)
                states, _, state = self.window(inputs[place], None, state, table)
                flat = inside.reshape(-1)
                found, _ = self.output(states.reshape(-1, HIDDEN)[flat], tokens[place].reshape(-1)[flat])
                logp[place[inside]] = found
        return logp


class _Adam:
    def __init__(self, size: int, rate: float):
        self.rate, self.step = rate, 0
        self.first, self.second = np.zeros(size, np.float32), np.zeros(size, np.float32)

    def ascend(self, flat: np.ndarray, grad: np.ndarray) -> None:
        self.step += 1
        self.first += 0.1 * (grad - self.first)
        self.second += 0.001 * (grad * grad - self.second)
        scale = np.float32(self.rate / (1 - 0.9**self.step))
        flat += scale * self.first / (np.sqrt(self.second / np.float32(1 - 0.999**self.step)) + np.float32(1e-6))


def lanes_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where lanes of consecutive tokens begin and how long they are: all tokens, in lanes that differ by one at most."""
    lanes = min(LANES, max(1, n // 512))
    cuts = np.arange(lanes + 1) * n // lanes
    return cuts[:-1], np.diff(cuts)


def train_part(vocabulary: Vocabulary, start: np.ndarray, chunk: int, rate: float):
    """Train on the documents of one task, all tokens once, from a common start; slices of the parameters, weighted by the tokens seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Recurrent(start.copy(), vocabulary.side)
        adam = _Adam(len(model.flat), rate)
        grad = np.zeros_like(model.flat)
        grads = Recurrent(grad, vocabulary.side)
        seen = 0
        for part in batches_of(batches, "text", chunk):
            own, codes, starts = token_codes(part["text"].combine_chunks())
            tokens = vocabulary.numbers(own)[codes]
            n = len(tokens)
            if not n:
                continue
            seen += n
            inputs = np.concatenate([[vocabulary.end], tokens[:-1]])
            fresh = np.zeros(n, bool)
            fresh[starts[:-1]] = True
            inputs[fresh] = vocabulary.end
            # The texts one after the other, dealt into lanes; the longer ones have one step more.
            first, length = lanes_of(n)
            state = np.zeros((len(first), HIDDEN), np.float32)
            at = 0
            while at < int(length.max()):
                live = length > at
                first, length, state = first[live], length[live], state[live]
                steps = min(WINDOW, int(length.min()) - at)
                place = first[None, :] + at + np.arange(steps)[:, None]
                grad[:] = 0
                state = model.learn(inputs[place], tokens[place], fresh[place], state, grads)
                grad /= place.size
                adam.ascend(model.flat, grad)
                at += steps
        if seen:
            weighted = model.flat.astype(np.float64) * seen
            cuts = range(0, len(weighted), _SLICE)
            slices = [weighted[k : k + _SLICE].tobytes() for k in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(slices)), pa.int32()), pa.array([float(seen)] * len(slices)), pa.array(slices, pa.binary())], ["slice", "seen", "flat"])

    return run


def sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the rows of each slice, one at a time, in a sorted partition."""
    number, seen, total = None, 0.0, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([seen]), pa.array([total.tobytes()], pa.binary())], ["slice", "seen", "flat"])

    for batch in batches:
        for k, n, flat in zip(batch.column("slice").to_pylist(), batch.column("seen").to_pylist(), batch.column("flat").to_pylist()):
            if k != number and total is not None:
                yield row()
                total = None
            one = np.frombuffer(flat, np.float64)
            number, seen, total = (k, n, one.copy()) if total is None else (k, seen + n, total + one)
    if total is not None:
        yield row()


_MODEL = "slice int, seen double, flat binary"


def train(rows: DataFrame, vocabulary: Vocabulary, rate: float = 0.03, chunk: int = 8 << 20, rounds: int = ROUNDS, piece: int = PIECE) -> Recurrent:
    """Mean models of ``rounds`` rounds; one model, added up slice by slice, reaches the driver in each.

    Each document is learnt from in one round.  Which one, with which others
    and in which order follows from its id and text alone.
    """
    model = Recurrent.start(vocabulary)
    if not rounds:
        return model
    parts = max(1, round(vocabulary.train_tokens / (rounds * piece)))
    slot = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(rounds * parts)).cast("int")
    learnt = rows.filter(~F.col("held_out")).withColumn("slot", slot)
    for number in range(rounds):
        mine = learnt.filter(F.col("slot") % rounds == number)
        dealt = mine.repartitionById(parts, F.floor(F.col("slot") / rounds).cast("int")).sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id")
        made = dealt.select("text").mapInArrow(train_part(vocabulary, model.flat, chunk, rate), _MODEL)
        sums = kept(made.repartition("slice").sortWithinPartitions("slice", "seen").mapInArrow(sum_slices, _MODEL))
        added = sorted((r["slice"], r["seen"], r["flat"]) for r in sums.collect())
        release(sums)
        if added:
            flat = np.concatenate([np.frombuffer(f, np.float64) / n for _, n, f in added])
            model = Recurrent(flat.astype(np.float32), vocabulary.side)
    return model


def held_out() -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text is 2 modulo 7; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_part(vocabulary: Vocabulary, flat: np.ndarray, chunk: int):
    """Over the rows of one part, the counts of its words first: the scores of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Recurrent(flat, vocabulary.side)
        packs: list[tuple[np.ndarray, np.ndarray]] = []
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def documents_of() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for w, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                    if w is not None:
                        packs.append((np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)))
                texts = batch.filter(batch.column("text").is_valid())
                if texts.num_rows:
                    yield texts

        for part in batches_of(documents_of(), "text", chunk):
            if packs:
                words, counts = (np.concatenate([x, *y]) for x, y in zip((words, counts), zip(*packs)))
                order = np.argsort(words)
                words, counts, packs = words[order], counts[order], []
            own, codes, starts = token_codes(part["text"].combine_chunks())
            c = np.zeros(len(own), np.int64)
            if len(words):
                at = np.minimum(np.searchsorted(words, own), len(words) - 1)
                c = np.where(words[at] == own, counts[at], 0)
            numbers = vocabulary.numbers(own)
            base = np.log10((c + 1.0) / (vocabulary.train_tokens + vocabulary.train_words + 1.0))[codes]
            shared_out = np.where(numbers == 0, np.log10((c + 1.0) / (vocabulary.other_tokens + vocabulary.other_words + 1.0)), 0)
            found = model.text_scores(numbers[codes], starts, vocabulary.end) / np.log(10) + shared_out[codes]
            known = (c > 0)[codes].astype(np.int64)
            n = part.num_rows
            columns = [
                part["doc_id"].combine_chunks(),
                part["held_out"].combine_chunks(),
                pa.array(np.diff(starts)),
                pa.array(np.add.reduceat(known, starts[:-1])),
                pa.array(np.full(n, vocabulary.train_tokens)),
                pa.array(np.add.reduceat(base, starts[:-1])),
                pa.array(np.add.reduceat(found, starts[:-1])),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SCORES.split(", ")])

    return run


def language_scores(docs: DataFrame, rate: float = 0.03, chunk: int = 8 << 20, rounds: int = ROUNDS, piece: int = PIECE) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``.

    Words are told apart by 64-bit hashes.  Documents are dealt into parts by
    a hash; a part sends each of its words once, with its own count, and gets
    the count over all parts back, so a word that every document has costs no
    more than any other.  A null or empty text is one end.  Without training
    documents all counts are zero.  Rows may repeat; ``doc_id`` may be null.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents(docs).withColumn("held_out", held_out())
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    asked = rows.repartitionById(n, F.col("part")).select("text", "held_out").mapInArrow(count_words(chunk), "part int, pack int, words binary, counts binary")
    sums = kept(asked.repartition("pack").sortWithinPartitions("pack", "part").mapInArrow(sum_counts(), "part int, distinct bigint, total bigint, words binary, counts binary"))
    totals = sums.filter("part = -1").agg(F.sum("distinct"), F.sum("total")).first()
    side = side_of(int(totals[0] or 0))
    top = side * side - 2
    # The most frequent words: packs hold distinct words, so the top of all is among the tops of each; only that many reach the driver.
    each = sums.filter("part = -1").select("words", "counts").mapInArrow(_unpacked, "word bigint, n bigint")
    head = each.filter(f"n > 0 and word <> {int(END)}").orderBy(F.desc("n"), "word").limit(top).collect()
    end = each.filter(f"word = {int(END)}").agg(F.sum("n")).first()[0] if totals[0] else 0
    hashes = np.array([END, *(np.uint64(r["word"] % 2**64) for r in head)], np.uint64)
    vocabulary = Vocabulary(hashes, np.array([end or 0, *(r["n"] for r in head)], np.int64), int(totals[1] or 0), int(totals[0] or 0), side)
    model = train(rows, vocabulary, rate, chunk, rounds, piece)
    answers = sums.filter("part >= 0").select("part", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("text"), "words", "counts")
    none = F.lit(None).cast("binary")
    all_ = answers.union(rows.select("part", "doc_id", "held_out", "text", none, none))
    dealt = all_.repartitionById(n, F.col("part")).sortWithinPartitions("part", F.col("words").isNull())
    return dealt.mapInArrow(score_part(vocabulary, model.flat, chunk), _SCORES)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w, np.int64)), pa.array(np.frombuffer(c, np.int64))], ["word", "n"])
