"""Toxicity by noisy-channel deobfuscation.

Words that may be disguised (characters standing for letters, letters spaced
out, letters repeated) become lattices of what they may stand for; Viterbi
decoding finds the likeliest reading under a character language model of the
whole corpus.  A linear model over the words of the restored text and their
character n-grams gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, documents, kept, wrapped

#: What a character of disguised text may stand for.  Fixed values.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
    "*": "aeiou", "#": "aeiou",
}
_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßàâáæçéèêëíîïñóôœúùûÿ"
_EDGE = ".,;:!?\"'()[]{}<>«»…|*"
_SEPARATORS = "._-·~*'"
#: A letter beside a stand-in, a letter three times, or single characters apart.
_DISGUISED = (
    "[0-9@$!|+(€£¡*#].*[a-zà-ÿ]|[a-zà-ÿ].*[0-9@$!|+(€£¡*#]|"
    + "|".join(c * 3 for c in _LETTERS)
    + r"|^[^ ](?:[._·~*'-][^ ]){2,}$"
)
#: Costs of the channel, in natural logarithms.
STAND_IN, LITERAL, DROP_SPACE, KEEP_SPACE, SHORTEN = -0.7, -1.5, -0.3, -1.5, -0.5
BITS = 18


@dataclass
class CharacterModel:
    """Counts of hashed character n-grams of orders 1 to 3, spaces being the ends of words; interpolated from short to long."""

    counts: np.ndarray
    #: What :meth:`logp` gave before; emptied whenever it is full.
    known: dict[tuple[str, str, str], float] = field(default_factory=dict, repr=False, compare=False)

    def logp(self, a: str, b: str, c: str) -> float:
        found = self.known.get((a, b, c))
        if found is None:
            if len(self.known) >= 1 << 19:
                self.known.clear()
            found = self.known[a, b, c] = self._logp(ord(a), ord(b), ord(c))
        return found

    def _logp(self, x: int, y: int, z: int) -> float:
        one, total = self.counts[_slot1(z)], self.counts[-1]
        p = (one + 0.1) / (total + 0.1 * _PRIMES[0])
        p = (self.counts[_slot2(y, z)] + 5 * p) / (self.counts[_slot1(y)] + 5)
        p = (self.counts[_slot3(x, y, z)] + 5 * p) / (self.counts[_slot2(x, y)] + 5)
        return math.log(min(max(p, 1e-12), 1.0))


#: n-grams are numbered by their code points (of 21 bits each) modulo primes.
_PRIMES = (4093, 65521, 262139)


def _slot1(z):
    return z % _PRIMES[0]


def _slot2(y, z):
    return _PRIMES[0] + (y * 2097152 + z) % _PRIMES[1]


def _slot3(x, y, z):
    return _PRIMES[0] + _PRIMES[1] + ((x * 2097152 + y) * 2097152 + z) % _PRIMES[2]


SLOTS = sum(_PRIMES) + 1


def decode(observed: str, model: CharacterModel) -> str:
    """The likeliest reading of disguised text; a space in it may stay or go, ends of the text are ends of words."""
    steps: list[list[tuple[str, float]]] = []
    for run in re.finditer(r"(.)\1*", observed):
        char, n = run[1], len(run[0])
        if char == " " or (char in _SEPARATORS and char not in STANDS_FOR):
            steps.append([("", DROP_SPACE), (" ", KEEP_SPACE)])
        elif char in STANDS_FOR:
            steps += [[(s, STAND_IN) for s in STANDS_FOR[char]] + [(char, LITERAL)]] * n
        elif n >= 3:
            steps.append([(char, SHORTEN), (char * 2, SHORTEN)])
        else:
            steps += [[(char, 0.0)]] * n
    # States are the last two characters; each keeps its best score and text.
    states = {(" ", " "): (0.0, "")}
    for options in [*steps, [(" ", 0.0)]]:
        after: dict[tuple[str, str], tuple[float, str]] = {}
        for (a, b), (score, text) in states.items():
            for emitted, cost in options:
                x, y, total = a, b, score + cost
                for c in emitted:
                    total += model.logp(x, y, c)
                    x, y = y, c
                if (x, y) not in after or total > after[x, y][0]:
                    after[x, y] = (total, text + emitted)
        states = after
    return max(states.values())[1].strip()


class Words:
    """The words of some texts: each text's words as codes of distinct tokens; runs of three single characters or more are one token."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        owner = pc.list_parent_indices(lists).to_numpy()
        flat = pc.list_flatten(lists).cast(pa.large_string())
        some = pc.not_equal(flat, "")
        owner, flat = owner[some.to_numpy(zero_copy_only=False)], flat.filter(some)
        single = pc.equal(pc.utf8_length(flat), 1).to_numpy(zero_copy_only=False)
        # Runs of single characters within one text.
        same = np.concatenate([[False], single[1:] & single[:-1] & (owner[1:] == owner[:-1])]) if len(single) else single
        start = np.flatnonzero(single & ~same)
        ends = np.flatnonzero(single & ~np.concatenate([same[1:], [False]])) + 1 if len(single) else start
        long = ends - start >= 3
        coded = flat.dictionary_encode()
        self.codes, self.owner = coded.indices.to_numpy().astype(np.int64), owner.astype(np.int64)
        self.tokens = coded.dictionary
        if long.any():
            drop = np.zeros(len(flat) + 1, np.int64)
            np.add.at(drop, start[long], 1)
            np.add.at(drop, ends[long], -1)
            joined = [" ".join(flat.slice(s, e - s).to_pylist()) for s, e in zip(start[long], ends[long])]
            more = pa.array(joined, pa.large_string()).dictionary_encode()
            stay = np.cumsum(drop[:-1]) == 0
            self.codes = np.concatenate([self.codes[stay], more.indices.to_numpy() + len(self.tokens)])
            self.owner = np.concatenate([self.owner[stay], self.owner[start[long]]])
            self.tokens = pa.concat_arrays([self.tokens, more.dictionary])

    def restored(self, model: CharacterModel | None) -> pa.Array:
        """The tokens without marks at their ends, the disguised ones decoded."""
        bare = pc.utf8_trim(self.tokens, _EDGE)
        hidden = pc.or_(pc.match_substring_regex(bare, _DISGUISED), pc.match_substring(self.tokens, " "))
        where = np.flatnonzero(hidden.to_numpy(zero_copy_only=False)) if model is not None else []
        if not len(where):
            return bare
        found = [decode(w, model) for w in self.tokens.take(pa.array(where)).to_pylist()]
        found = pc.utf8_trim(pa.array(found, pa.large_string()), _EDGE)
        return pc.replace_with_mask(bare, hidden, found)


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``" word "`` for all words, and where each begins."""
    padded = " ".join(["", *words.to_pylist(), ""])
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
    return points, np.concatenate([[0], np.cumsum(lengths + 1)])


def ngram_counts(words: pa.Array, times: np.ndarray) -> np.ndarray:
    """Counts of the character model's n-grams over words that occur so many times."""
    points, starts = _points(words)
    if len(points) < 2 or not len(words):
        return np.zeros(SLOTS)
    weight = np.repeat(times, np.diff(starts)).astype(np.float64)  # of the character and the space after the word
    a = np.concatenate([[32], points[:-2]])
    b, c = points[:-1], points[1:]
    first = np.zeros(len(c), bool)
    first[starts[:-1]] = True
    a = np.where(first, 32, a)  # two spaces stand before a word
    out = np.bincount(_slot1(c), weight, SLOTS) + np.bincount(_slot2(b, c), weight, SLOTS) + np.bincount(_slot3(a, b, c), weight, SLOTS)
    out[_slot2(32, 32)] += times.sum()
    out[-1] = weight.sum()
    return out


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(word number, feature)``: the hashed word and its hashed 4-grams, the spaces around it included."""
    points, starts = _points(words)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = points.astype(np.uint64)
    with np.errstate(over="ignore"):
        mix = (x[:-3] * np.uint64(31337) + x[1:-2]) * np.uint64(7919) + x[2:-1]
        mix = (mix * np.uint64(104729) + x[3:]) * np.uint64(0x9E3779B97F4A7C15)
        place = np.arange(len(x), dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, len(x)))).astype(np.uint64)
        mixed = (x * np.uint64(0xBF58476D1CE4E5B9)) ^ (place * np.uint64(0x94D049BB133111EB)) * (x + np.uint64(7))
        # Without the space behind the last word, so that it counts like all others.
        whole = np.add.reduceat(mixed[: starts[-1]], starts[:-1])
        whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    owner = np.repeat(np.arange(len(words)), np.diff(starts))
    owner = owner[: len(mix)]
    inside = np.arange(len(mix)) + 3 <= starts[1:][owner] if len(mix) else np.zeros(0, bool)
    shift = np.uint64(64 - BITS)
    return (
        np.concatenate([np.arange(len(words)), owner[inside]]),
        np.concatenate([whole >> shift, mix[inside] >> shift]).astype(np.int64),
    )


def text_features(texts: pa.Array, model: CharacterModel | None, chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(text number, feature)`` of restored texts, of ``chosen`` features only if given."""
    words = Words(texts)
    word, feature = word_features(words.restored(model))
    if chosen is not None:
        keep = chosen[feature]
        word, feature = word[keep], feature[keep]
    order = np.argsort(word, kind="stable")
    word, feature = word[order], feature[order]
    n = len(words.tokens)
    pairs = np.unique(words.owner * n + words.codes)
    owner, code = pairs // max(n, 1), pairs % max(n, 1)
    starts = np.searchsorted(word, np.arange(n + 1))
    size = np.diff(starts)[code]
    ends = np.cumsum(size)
    take = np.repeat(starts[code] - (ends - size), size) + np.arange(int(size.sum()))
    both = np.unique(np.repeat(owner, size) * (1 << BITS) + feature[take])
    return both >> BITS, both & ((1 << BITS) - 1)


def _sparse(counts: np.ndarray, names: list[str]) -> pa.RecordBatch:
    where = np.flatnonzero(counts.reshape(len(names), -1).any(axis=0))
    return pa.RecordBatch.from_arrays([pa.array(where)] + [pa.array(c[where].astype(np.float64)) for c in counts.reshape(len(names), -1)], ["slot", *names])


def character_model(docs: DataFrame, chunk: int = 8 << 20) -> CharacterModel:
    """Counts over the words of all documents; each task sends one sparse table of at most ``SLOTS`` rows, their sum reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS)
        for part in batches_of(batches, "text", chunk):
            words = Words(part["text"].combine_chunks().cast(pa.large_string()))
            bare = words.restored(None)
            plain = pc.invert(pc.match_substring(words.tokens, " ")).to_numpy(zero_copy_only=False)
            times = np.bincount(words.codes, minlength=len(words.tokens))
            total += ngram_counts(bare.filter(pa.array(plain)), times[plain])
        yield _sparse(total, ["n"])

    rows = documents(docs).mapInArrow(run, "slot bigint, n double").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SLOTS)
    counts[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return CharacterModel(counts)


@dataclass
class ToxicityModel:
    characters: CharacterModel
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        owner, feature = text_features(texts, self.characters, self.weights != 0)
        z = self.bias + np.bincount(owner, self.weights[feature], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(row: np.ndarray, col: np.ndarray, label: np.ndarray, n_cols: int, ridge: float = 0.5, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression over sparse 0/1 features by Adam on the whole sample; the ridge weighs as much as so many rows."""
    if not len(label) or label.min() == label.max():
        rate = (label.sum() + 0.5) / (len(label) + 1.0) if len(label) else 0.01
        return np.zeros(n_cols), math.log(min(rate, 0.5) / (1 - min(rate, 0.5)))
    n = len(label)
    w, first, second = np.zeros(n_cols + 1), np.zeros(n_cols + 1), np.zeros(n_cols + 1)
    w[-1] = math.log(label.mean() / (1 - label.mean()))
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(row, w[col], n)
        wrong = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        grad = np.append(np.bincount(col, wrong[row], n_cols) + ridge * w[:-1], wrong.sum()) / n
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w[:-1], float(w[-1])


def held_out() -> Column:
    """Rows no label is learnt from: crc32 of the id as text is 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, max_features: int = 4_096) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows that are not held out (those of the smallest hash of the id).

    The character model is of all documents.  Of the features of the sample,
    the ``max_features`` that tell the labels apart best (by the likelihood
    ratio) get weights.  Several labels of one id: the largest counts; null
    labels do not.
    """
    characters = character_model(docs)
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out())
    chosen = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # The sample has max_rows rows of two numbers at most.
    sample = kept(documents(docs).join(F.broadcast(chosen), "doc_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS))
        for part in batches_of(batches, "text", 4 << 20):
            owner, feature = text_features(part["text"].combine_chunks().cast(pa.large_string()), characters, None)
            toxic = (part["toxic"].to_numpy() > 0)[owner]
            for k in (0, 1):
                total[k] += np.bincount(feature[toxic == bool(k)], minlength=1 << BITS)
        yield _sparse(total, ["clean", "toxic"])

    seen = sample.mapInArrow(count, "slot bigint, clean double, toxic double").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    sizes = dict(sample.groupBy((F.col("toxic") > 0).cast("int")).count().collect())
    good, bad = max(sizes.get(0, 0), 1), max(sizes.get(1, 0), 1)
    clean, toxic = seen["clean"].to_numpy(), seen["toxic"].to_numpy()

    def part(n, share):
        return np.where(n > 0, n * np.log(np.maximum(n, 1e-9) / np.maximum(share, 1e-9)), 0)

    total = clean + toxic
    ratio = part(toxic, total * bad / (good + bad)) + part(clean, total * good / (good + bad))
    ratio = np.where((toxic >= 3) & (toxic / bad > 2 * clean / good), ratio, 0)
    best = np.argsort(-ratio, kind="stable")[:max_features]
    slots = np.sort(seen["slot"].to_numpy(np.int64)[best[ratio[best] > 4]])
    use = np.zeros(1 << BITS, bool)
    use[slots] = True

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_of(batches, "text", 4 << 20):
            owner, feature = text_features(part["text"].combine_chunks().cast(pa.large_string()), characters, use)
            cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array((part["toxic"].to_numpy() > 0).astype(np.int32)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(feature.astype(np.int32)))], ["toxic", "features"]
            )

    # At most max_rows rows of the few features that each holds.
    rows = sample.mapInArrow(vectors, "toxic int, features array<int>").toPandas()
    sizes = rows["features"].map(len).to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    column = np.concatenate([np.asarray(f, np.int64) for f in rows["features"]]) if sizes.sum() else np.zeros(0, np.int64)
    fitted, bias = fit_linear(np.repeat(np.arange(len(rows)), sizes), np.searchsorted(slots, column), rows["toxic"].to_numpy(np.float64), len(slots))
    weights = np.zeros(1 << BITS)
    weights[slots] = fitted
    return ToxicityModel(characters, weights, bias)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, max_features: int = 4_096) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, score)`` from 0 to 1.

    Texts are read whole.  A null or empty text has the score of a text
    without any telling word.  Rows may repeat, ``doc_id`` may be null.
    Without labels of both kinds all texts score alike, below one half.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, max_rows, max_features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_of(batches, "text", 8 << 20):
            scores = model.value.scores(part["text"].combine_chunks().cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), pa.array(scores)], ["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id bigint, score double")


def restored_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, restored)``: the words of each text as they are scored, one space apart, in the order of their first occurrence."""
    model = docs.sparkSession.sparkContext.broadcast(character_model(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_of(batches, "text", 8 << 20):
            words = Words(part["text"].combine_chunks().cast(pa.large_string()))
            tokens = np.array(words.restored(model.value).to_pylist(), object)
            texts: list[list[str]] = [[] for _ in range(part.num_rows)]
            for owner, code in zip(words.owner, words.codes):
                texts[owner].append(tokens[code])
            yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), pa.array([" ".join(t) for t in texts])], ["doc_id", "restored"])

    return documents(docs).mapInArrow(run, "doc_id bigint, restored string")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, judged where they are read."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        # Some texts at a time: a batch may hold long ones.
        parts = [model.value.scores(pa.array(texts.iloc[i : i + 500], pa.large_string())) for i in range(0, len(texts), 500)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return wrapped(docs).withColumn("score", score("text")).filter(F.col("score") < threshold).select("row.*")
