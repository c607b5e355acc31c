"""Whitening of embeddings from an exact covariance, made of bit slices.

Entries become whole numbers.  A block of rows is shifted to start at zero in
every dimension and cut into bit planes, each packed into 64-bit words, a row
per bit.  A cross-product of two dimensions is then a sum of popcounts of ANDed
planes, weighted by powers of two:

    sum_r x_r y_r  =  sum_ab 2^(a+b) popcount(X_a & Y_b)

which is exact.  The shifts are put back in whole numbers of any size, the
blocks add up (as sums of 31-bit limbs, so no total is out of range), and the
covariance is centred before it is ever rounded: ``n * sum xy - sum x * sum y``
is a whole number.  Only then come ``eigh`` and doubles.

Nothing is shuffled but sums: the square of the dimension per task.  They reach
the driver added up, one row per pair of dimensions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_column

#: Entries count in steps of 1/1024, from a zero point of 100000.
STEPS, ZERO = 1024, 100_000
#: Whole numbers stay within this, as larger doubles are all of them saturated.
_LIMIT = 1 << 62
_LIMBS, _LIMB_BITS = 7, 31
_SCATTER = pa.schema([("i", pa.int32()), ("j", pa.int32())] + [(f"l{k}", pa.int64()) for k in range(_LIMBS)])
_SCATTER_SQL = "i int, j int, " + ", ".join(f"l{k} bigint" for k in range(_LIMBS))


def whole(vectors: np.ndarray) -> np.ndarray:
    """``floor(1024 * c) + 100000`` as 64-bit integers; what is beyond 2^62 stops there."""
    steps = np.floor(np.clip(vectors * float(STEPS), -float(_LIMIT), float(_LIMIT)))
    return steps.astype(np.int64) + ZERO


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(planes, dimension, bit)`` of non-negative whole numbers: a row of words per plane that has any bit set."""
    n, dims = shifted.shape
    words = -(-n // 64)
    planes, owner, bits = [], [], []
    for d in range(dims):
        column = np.zeros(words * 64, dtype=np.uint64)
        column[:n] = shifted[:, d]
        for b in range(int(column.max()).bit_length()):
            plane = np.packbits(((column >> np.uint64(b)) & np.uint64(1)).astype(bool)).view(np.uint64)
            if plane.any():
                planes.append(plane)
                owner.append(d)
                bits.append(b)
    made = np.array(planes, dtype=np.uint64).reshape(len(planes), words)
    return made, np.array(owner, dtype=np.int64), np.array(bits, dtype=np.int64)


def block_scatter(x: np.ndarray) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Sums and cross-products (``i <= j``) of the columns of a block, exact."""
    n, dims = x.shape
    low = x.min(axis=0)
    shift = [int(v) for v in low]
    planes, owner, bits = bit_planes((x - low).astype(np.uint64))
    sums = [0] * dims
    products: dict[tuple[int, int], int] = defaultdict(int)
    for p in range(len(planes)):
        d, b = int(owner[p]), int(bits[p])
        sums[d] += int(np.bitwise_count(planes[p]).sum()) << b
        # Planes of one dimension follow one another, so each pair of dimensions is met from its first one.
        rest = p + int(np.searchsorted(owner[p:], d))
        start = int(np.searchsorted(owner, d)) if rest == p else rest
        counts = np.bitwise_count(planes[start:] & planes[p]).sum(axis=1, dtype=np.int64)
        # Sums per dimension of counts times powers of two, in two halves so that they fit in 64 bits.
        halves = []
        for lo in (0, 32):
            use = (bits[start:] >= lo) & (bits[start:] < lo + 32)
            weighted = np.where(use, counts << np.where(use, bits[start:] - lo, 0), 0)
            per = np.zeros(dims, dtype=np.int64)
            np.add.at(per, owner[start:], weighted)
            halves.append(per)
        for j in np.unique(owner[start:]):
            products[d, int(j)] += (int(halves[0][j]) + (int(halves[1][j]) << 32)) << b
    # With u = x - s:  sum x y = sum u v + s sum v + t sum u + n s t.
    exact = {}
    for i in range(dims):
        for j in range(i, dims):
            exact[i, j] = products.get((i, j), 0) + shift[i] * sums[j] + shift[j] * sums[i] + n * shift[i] * shift[j]
    return [s + n * t for s, t in zip(sums, shift)], exact


def _limbs(value: int) -> list[int]:
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    for _ in range(_LIMBS):
        out.append(sign * (rest & ((1 << _LIMB_BITS) - 1)))
        rest >>= _LIMB_BITS
    return out


def _unlimbed(limbs: list[int]) -> int:
    return sum(v << (_LIMB_BITS * k) for k, v in enumerate(limbs))


def blocks(batches: Iterator[pa.RecordBatch], rows: int, *others: str) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            flat = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield flat.reshape(part.num_rows, -1), part


def scatter(block_rows: int):
    """Per task: ``(-1, -1)`` number of rows, ``(-1, j)`` sums, ``(i, j)`` cross-products, each as limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = defaultdict(int)
        for vectors, _ in blocks(batches, block_rows):
            sums, products = block_scatter(whole(vectors))
            total[-1, -1] += len(vectors)
            for j, s in enumerate(sums):
                total[-1, j] += s
            for key, value in products.items():
                total[key] += value
        if total:
            columns = [[k[0] for k in total], [k[1] for k in total], *zip(*map(_limbs, total.values()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCATTER)], schema=_SCATTER)

    return run


@dataclass(frozen=True)
class Whitening:
    """What is known of the fit list: exact sums, and unit components by falling variance."""

    n: int
    sums: tuple[int, ...]
    variances: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.trace if self.trace > 0 else np.zeros(len(self.variances))

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; a component without variance gives zeros."""
        # n*x - S is centred as whole numbers, so the means cost no digits.
        centred = _scaled(x, self.n, self.sums)
        spread = np.sqrt(self.variances)
        return np.divide(centred @ self.components, spread, out=np.zeros((len(x), len(spread))), where=spread > 0)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of ``(n*x - S)^2``, exact."""
        off, fits = _offsets(x, self.n, self.sums)
        if fits and len(off) and int(np.abs(off).max()) ** 2 * self.dims < 1 << 63:
            return [int(v) for v in np.einsum("ij,ij->i", off, off)]
        return [sum(int(v) ** 2 for v in row) for row in off]


def _offsets(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, bool]:
    """``n*x - S``, as 64-bit integers where they fit, else as Python's."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0))) * n + max(map(abs, sums), default=0)
    if largest < 1 << 63:
        return n * x - np.array(sums, dtype=np.int64), True
    return n * x.astype(object) - np.array(sums, dtype=object), False


def _scaled(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    off, fits = _offsets(x, n, sums)
    if fits:
        return off / n
    return np.array([[int(v) / n for v in row] for row in off], dtype=np.float64).reshape(x.shape)


def sound_vectors(frame: DataFrame, vector: str, id_: str) -> DataFrame:
    """``(vec_id, vector)`` of the rows that can be fitted: neither null nor empty, all entries finite, of the commonest length."""
    rows = frame.select(own_column(frame, id_, "bigint").alias("vec_id"), own_column(frame, vector, "array<double>").alias("vector"))
    sound = rows.filter(F.expr("size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"))
    # One row per length reaches the driver, of which only the first is used.
    lengths = sound.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return sound.filter(F.size("vector") == (lengths["dims"] if lengths else 0))


def fit_whitening(sound: DataFrame, components: int = 8, block_rows: int = 8192) -> Whitening:
    """Covariance (divisor ``n``) of ``sound_vectors``, and its first ``components`` eigenvectors.

    The sign of a component is that of its largest entry, made positive.  No
    rows give a model of no dimensions.
    """
    parts = sound.select("vector").mapInArrow(scatter(block_rows), _SCATTER_SQL)
    added = parts.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(_LIMBS)])
    total = {(r["i"], r["j"]): _unlimbed(list(r)[2:]) for r in added.collect()}
    n = total.get((-1, -1), 0)
    dims = sum(1 for i, j in total if i == -1) - (n > 0)
    sums = tuple(total[-1, j] for j in range(dims))
    covariance = np.zeros((dims, dims))
    for (i, j), value in total.items():
        if i >= 0:
            # Centred as a whole number, then divided once.
            covariance[i, j] = covariance[j, i] = (n * value - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    first = np.argsort(-values, kind="stable")[: min(components, dims)]
    values, vectors = values[first], vectors[:, first]
    if dims:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    # What is left of a variance of zero is rounding.
    values = np.where(values > trace * 1e-13, values, 0.0)
    return Whitening(n, sums, values, vectors, trace)


def whitened(sound: DataFrame, model: Whitening, block_rows: int = 8192) -> DataFrame:
    """``(vec_id, whitened ARRAY<DOUBLE>, deviation DECIMAL(38,0))`` of ``sound_vectors``; NULL where a deviation has more digits."""
    if not model.dims:
        return sound.sparkSession.createDataFrame([], "vec_id bigint, whitened array<double>, deviation decimal(38,0)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vectors, part in blocks(batches, block_rows):
            x = whole(vectors)
            made = model.apply(x)
            offsets = np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]
            exact = pa.array([str(v) if v < 10**38 else None for v in model.deviations(x)], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), lists, exact], ["vec_id", "whitened", "deviation"])

    made = sound.mapInArrow(run, "vec_id bigint, whitened array<double>, deviation string")
    return made.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened rows is from the identity, at its worst entry.

    Measured on the rows.  Components without variance are left out; 0 where
    there are none.
    """
    use = [k for k, v in enumerate(model.variances) if v > 0]
    if not use:
        return 0.0
    k = max(use) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, :k]
            sums += w.sum(axis=0)
            products += w.T @ w
        i, j = np.indices((k + 1, k)).reshape(2, -1)
        values = np.vstack([products, sums]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values)], ["i", "j", "v"])

    added = np.zeros((k + 1, k))
    for r in rows.select("whitened").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        added[r["i"], r["j"]] = r["v"]
    mean = added[k] / model.n
    return float(np.abs(added[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened_components(frame: DataFrame, components: int = 8, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """One row per vector that can be fitted and component, numbered from 1: ``(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact)``.

    Rows whose vector is null or empty, holds a null or an entry that is not
    finite, or has another length than most (of equally common lengths the
    longest counts) are left out.  Rows that repeat count as often as they
    occur; ``vec_id`` may be null.  With less variance than components (one
    row, equal rows) the rest have ``whitened`` and ``explained`` 0.
    ``deviation`` is null where the exact sum of squares, which
    ``deviation_exact`` then holds, does not fit in a long.  Entries beyond
    2^52 in size stop there.  An empty table gives an empty one; other columns
    play no part.
    """
    sound = sound_vectors(frame, vector, id_)
    model = fit_whitening(sound, components)
    rows = whitened(sound, model)
    error = identity_error(rows, model)
    explained = F.array(*[F.lit(float(v)) for v in model.explained]) if model.dims else F.array().cast("array<double>")
    made = rows.select("vec_id", "deviation", F.posexplode(F.arrays_zip(F.col("whitened").alias("w"), explained.alias("e"))).alias("k", "c"))
    return made.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        F.col("c.w").alias("whitened"),
        F.col("c.e").alias("explained"),
        F.lit(error).alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )
