"""Neighbours and whitening against brute force."""

import numpy as np
import pytest

from evidence_lake.llm import op12_neighbours as near
from evidence_lake.llm import op13_whitening as white

SCHEMA = "vec_id long, embedding array<double>, score double, block string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else list(map(float, v)), 1.0, "x", 7) for i, v in rows], SCHEMA).repartition(3)


def odd_rows(rng, n, d):
    rows = [(i, rng.normal(size=d) * 10 ** rng.uniform(-3, 3)) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(8)] + [(0, rows[1][1]), (20, rows[20][1])]  # copies, ties, repeated ids
    return rows + [(None, rows[2][1]), (1000, None), (1001, [0.0] * d), (1002, [np.nan] + [1.0] * (d - 1)), (1003, [np.inf] * d), (1040, [1.0, 2.0]), (1041, [3.0, 4.0]), (1060, [])]


def brute(rows, k, every):
    own = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and np.isfinite(v).all() and np.any(v)]
    out = []
    for a, (i, q) in enumerate(own):
        if i % every == 0:
            found = []
            for b, (j, c) in enumerate(own):
                if a != b and len(c) == len(q):
                    s = 0.0
                    for x, y in zip(q, c):
                        s += x * y
                    found.append((-s, j))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("group", [1 << 25, 600])
def test_neighbours_against_brute_force(spark, monkeypatch, group):
    for name, size in (("BLOCK_ROWS", 40), ("QUERY_ROWS", 4), ("TILE", 3), ("PAIRS", 16), ("GROUP_BYTES", group)):
        monkeypatch.setattr(near, name, size)
    rows = odd_rows(np.random.default_rng(5), 300, 12)
    got = near.neighbours(table(spark, rows), k=6)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 6, 20)
    assert near.neighbours(table(spark, rows).limit(0)).count() == 0


def test_bounds_hold_and_leave_pairs_out():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 64)) * np.exp(rng.normal(size=(400, 1)))
    x[5], x[6] = 1e-305, 1e200
    c = near.Quantised(x)
    estimate, error = near.bounded(c, np.arange(400), c)
    with np.errstate(over="ignore"):
        true = x @ x.T
    assert not (np.abs(true - estimate) > error)[np.isfinite(true)].any()  # what isn't a number leaves nothing out
    cut, rows = near.cutoffs(c, np.arange(50), 10), np.arange(50)
    assert len(near.survivors(c, rows, c, cut, rows, 10)[0]) < 50 * 40


def brute_whitening(x, k):
    cells = np.floor(64 * x).astype(np.int64) + 1_000_000
    fit = np.unique(cells, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov((fit - sums / n).T, bias=True))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, ((n * cells - sums) ** 2).sum(axis=1), (cells - sums / n) @ vectors / np.sqrt(values), values / np.trace(np.cov(fit.T, bias=True))


def test_whitening_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(white, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 40)) @ rng.normal(size=(40, 40)) + 30
    x = np.vstack([x, x[:50], x[:1].repeat(30, axis=0)])
    rows = list(enumerate(x)) + [(None, None), (900, None), (901, [np.nan] * 40), (902, []), (903, [5.0] * 3)]
    got = white.whiten(table(spark, rows)).toPandas()
    n, deviation, whitened, explained = brute_whitening(x, 16)
    assert set(got.vec_id) == set(range(len(x))) and len(got) == 16 * len(x) and set(got.n) == {n} == {400}
    by = got.sort_values(["vec_id", "component"])
    w = by.whitened.to_numpy().reshape(len(x), 16)
    assert (by.deviation.to_numpy()[::16] == deviation).all()
    assert np.allclose(by.explained.to_numpy()[:16], explained, rtol=1e-9)
    assert np.abs(w * np.sign((w * whitened).sum(axis=0)) - whitened).max() < 1e-8
    assert got.identity_error.max() < 1e-9


def test_whitening_of_few_or_equal_vectors(spark):
    assert white.whiten(table(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0
    assert white.whiten(table(spark, []).limit(0)).count() == 0
    got = white.whiten(table(spark, [(1, [1, 2, 3]), (1, [2, 2, 3]), (None, [4, 2, 3]), (5, [1.0, 2.0])])).toPandas()
    assert sorted(got.component) == [1, 1, 1] and got.vec_id.isna().sum() == 1 and np.allclose(got.explained, 1.0)


def test_iteration_restarts_and_survives_breakdown():
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.normal(size=(120, 120)))[0]
    values = np.concatenate([np.repeat([9.0, 5.0], 3), np.linspace(4, 3.5, 114)])
    v = (basis * values) @ basis.T
    passes = []
    got, vectors = white.eigenpairs(lambda q: passes.append(1) or v @ q, 120, 8, width=2, basis=24)
    assert np.allclose(got, values[:8], atol=1e-11) and np.linalg.norm(v @ vectors - vectors * got) < 1e-10 and len(passes) > 12
    # a projector: the second block is nothing but rounding
    got, vectors = white.eigenpairs(lambda q: basis[:, :6] @ (basis[:, :6].T @ q), 120, 6, width=2)
    assert np.allclose(got, 1.0) and np.allclose(vectors.T @ vectors, np.eye(6))


def test_deviations_beyond_64_bits_are_cut():
    cells = np.array([[0, 1], [2**50, 5]])
    assert white.deviations(cells, 2, cells.sum(axis=0).tolist()).tolist() == [2**63 - 1] * 2
