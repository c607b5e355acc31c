"""Near copies among embeddings and whitening, against brute force."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from spanloom.llm import embedding_dedup, whitening
from spanloom.llm.embedding_dedup import near_vectors
from spanloom.llm.queries import OP11_SQL, op11_embedding_dedup, op13_whitening
from spanloom.llm.whitening import whitened_components

CLASHING = ["row_id", "links", "root", "dim", "own", "other", "side", "vector", "low", "high", "n", "kept", "component", "whitened", "node"]
SCHEMA = "vec_id bigint, embedding array<double>, label int"


def frame(spark, rows, schema=SCHEMA):
    made = spark.createDataFrame(rows, schema)
    for k, name in enumerate(CLASHING):
        made = made.withColumn(name, made["vec_id"] + k)
    return made.repartition(3)


def clusters(seed=3, dims=12):
    """Chains of vectors that turn by little, copies, scaled copies, and every kind of odd row."""
    rng = np.random.default_rng(seed)
    rows, k = [], 100
    for label in (1, 2):
        for _ in range(6):
            at = rng.normal(size=dims)
            for _ in range(rng.integers(1, 14)):
                rows.append((k, [float(v) for v in at], label))
                at = at + rng.normal(size=dims) * rng.choice([0.04, 0.2])
                k += 1
    first = rows[0][1]
    rows += [(1, first, 1), (2, [v * 7 for v in first], 1), (3, [v * 1e200 for v in first], 1), (4, [v * 1e-200 for v in first], 1)]
    rows += [(5, first, 2), (6, first, None), (7, None, 1), (8, [0.0] * dims, 1), (9, [*first[:-1], None], 1), (10, [*first[:-1], float("nan")], 1)]
    rows += [(11, [*first[:-1], float("inf")], 1), (12, [], 1), (13, first[:5], 1), (14, first[:5], 1), (15, [-v for v in first], 1)]
    rows += [(16, rows[9][1], 1), (16, rows[9][1], 1), (None, rows[9][1], 1), (None, [1.0] * dims, 9), (None, None, None)]
    return rows


def linked(rows, threshold=0.98):
    n = len(rows)
    able = [v is not None and label is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v, label in rows]
    units = [np.array(v) / np.abs(v).max() if ok else None for ok, (_, v, _) in zip(able, rows)]
    units = [u if u is None else u / np.linalg.norm(u) for u in units]
    links = [[j for j in range(n) if j != i and able[i] and able[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_rows, tile_rows", [(4096, 1024), (7, 3), (1, 1)])
def test_near_vectors(spark, block_rows, tile_rows):
    rows = clusters()
    got = near_vectors(frame(spark, rows), block_rows=block_rows, tile_rows=tile_rows)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = linked(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(w[1] for w in want) > 100


def test_near_vectors_single_precision_and_nothing(spark):
    rows = [(i, None if v is None else [c if c is None else float(np.float32(c)) for c in v], label) for i, v, label in clusters(5) if i not in (3, 4)]
    got = near_vectors(frame(spark, rows, "vec_id bigint, embedding array<float>, label int"))
    assert sorted(map(tuple, got.collect()), key=str) == linked(rows)
    assert near_vectors(frame(spark, [])).count() == 0


@pytest.mark.parametrize("dims", [2, 64, 1500])
def test_bounds_miss_no_pair(dims):
    """Every pair at or above the threshold is a candidate, with thresholds set on the pairs themselves."""
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(40, dims))
    vectors = embedding_dedup.unit(np.vstack([base, base + rng.normal(size=base.shape) * 0.2]))
    all_ = embedding_dedup.Quantised(vectors)
    exact = vectors @ vectors.T
    bound = all_.length[:, None] * all_.rest + all_.rest[:, None] * (all_.length + all_.rest)
    product = all_.scale[:, None] * all_.scale * (all_.codes.astype(np.float64) @ all_.codes.T.astype(np.float64))
    assert (np.abs(exact - product) <= bound).all()
    assert np.array_equal(all_.codes @ all_.codes.T, all_.codes.astype(np.int64) @ all_.codes.T.astype(np.int64))
    for threshold in exact[3:60:7, 40:80:5].ravel():
        if threshold > 0:
            assert embedding_dedup.candidates(all_, all_, threshold)[exact >= threshold].all()
            assert np.array_equal(embedding_dedup.linked(all_, all_, threshold - 1e-12), exact >= threshold - 1e-12)


def test_query_and_sql_of_near_vectors(spark):
    import duckdb

    got = op11_embedding_dedup(spark, "/root/testdata/sf0.001")
    duckdb.sql("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(OP11_SQL).fetchall())


# ---------------------------------------------------------------- whitening


def fitted(rows, dims):
    """By definition, in fractions."""
    xs = [(i, [int(np.floor(1024 * np.float64(c))) + 100000 for c in v]) for i, v, _ in rows]
    n = len(xs)
    sums = [sum(x[d] for _, x in xs) for d in range(dims)]
    centred = [[Fraction(n * x[d] - sums[d], n) for d in range(dims)] for _, x in xs]
    cov = [[float(sum(c[i] * c[j] for c in centred) / n) for j in range(dims)] for i in range(dims)]
    deviations = {i: sum((n * x[d] - sums[d]) ** 2 for d in range(dims)) for i, x in xs}
    return n, np.array(cov), np.array([[float(v) for v in c] for c in centred]), deviations, [i for i, _ in xs]


@pytest.mark.parametrize("offset, spread", [(0.0, 0.1), (1e6, 0.1), (-3e3, 1e4)])
def test_whitening(spark, offset, spread):
    rng = np.random.default_rng(7)
    data = offset + rng.normal(size=(90, 10)) * np.linspace(1, 3, 10) * spread
    rows = [(k, [float(c) for c in v], k % 3) for k, v in enumerate(data)]
    odd = [(1000, None, 0), (1001, [*rows[0][1][:-1], None], 0), (1002, [*rows[0][1][:-1], float("nan")], 0), (1003, [], 0), (1004, [1.0, 2.0], 0)]
    got = whitened_components(frame(spark, rows + odd)).collect()
    n, cov, centred, deviations, ids = fitted(rows, 10)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 90 * 8
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert all(r["n"] == n and r["deviation_exact"] == deviations[r["vec_id"]] and r["identity_error"] < 1e-9 for r in got)
    assert all(r["deviation"] == (r["deviation_exact"] if r["deviation_exact"] < 1 << 63 else None) for r in got)
    for k in range(8):
        mine = np.array([by[i, k + 1]["whitened"] for i in ids])
        want = centred @ vectors[:, k] / np.sqrt(values[k])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
        assert by[0, k + 1]["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)


def test_whitening_of_odd_tables(spark):
    assert whitened_components(frame(spark, [])).count() == 0
    assert whitened_components(frame(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    one = whitened_components(frame(spark, [(1, [1.0, 2.0, 3.0], 1)])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(k, 1, 0, 0.0, 0.0, 0.0) for k in (1, 2, 3)]
    # One direction of variance only, rows that repeat and null ids.
    few = whitened_components(frame(spark, [(1, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (None, [1.0, 1.0], 1), (None, [1.0, 1.0], 1)])).collect()
    assert sorted((str(r["vec_id"]), r["component"], abs(round(r["whitened"], 9)), round(r["explained"], 9)) for r in few) == sorted(
        [("1", 1, 1.0, 1.0), ("1", 2, 0.0, 0.0), ("None", 1, 1.0, 1.0), ("None", 2, 0.0, 0.0)] * 2
    )
    # Sums of squares beyond a long are kept in full beside; entries beyond 2^52 stop.
    far = {r["vec_id"]: r for r in whitened_components(frame(spark, [(1, [1e9], 1), (2, [-1e9], 1), (3, [5e8], 1)])).collect()}
    x = {k: int(1024 * v) + 100000 for k, v in {1: 1e9, 2: -1e9, 3: 5e8}.items()}
    assert all(r["deviation_exact"] == (3 * x[k] - sum(x.values())) ** 2 for k, r in far.items())
    assert whitened_components(frame(spark, [(1, [1e300, 1.0], 1), (2, [-1e300, 2.0], 1), (3, [0.5, 0.5], 1)])).count() == 6


@pytest.mark.parametrize("low, high", [(-5, 6), (0, 1), (99_000, 101_000), (-(1 << 40), 1 << 45), (-(1 << 61), 1 << 61)])
def test_bit_sliced_scatter_is_exact(low, high):
    x = np.random.default_rng(1).integers(low, high, size=(130, 5))
    sums, products = whitening.block_scatter(x)
    rows = [[int(v) for v in r] for r in x]
    assert sums == [sum(c) for c in zip(*rows)]
    assert products == {(i, j): sum(r[i] * r[j] for r in rows) for i in range(5) for j in range(i, 5)}
    assert all(whitening._unlimbed(whitening._limbs(v)) == v for v in [*products.values(), -1, 0, -(1 << 200)])


def test_query_of_whitening(spark):
    got = op13_whitening(spark, "/root/testdata/sf0.001").toPandas()
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    x = np.floor(1024 * np.array(table["embedding"].tolist(), dtype=float)).astype(np.int64) + 100000
    off = len(x) * x - x.sum(axis=0)
    assert len(got) == 8 * len(x) and (got["identity_error"] < 1e-9).all()
    deviations = dict(zip(table["vec_id"], (off**2).sum(axis=1)))
    assert all(deviations[i] == d for i, d in zip(got["vec_id"], got["deviation"]))
    scores = np.array([g.sort_values("vec_id")["whitened"] for _, g in got.groupby("component")])
    assert np.abs(scores @ scores.T / len(x) - np.eye(8)).max() < 1e-9
