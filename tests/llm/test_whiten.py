"""Whitening against a dense eigensolver."""

import numpy as np
import pytest

from tabqa.llm import whiten

SCHEMA = "vec_id bigint, embedding array<double>"


def dense(rows, components=4):
    """id -> (n, deviation, whitened) per row, and the shares, from the whole covariance."""
    fine = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in fine}), object)
    n, s = len(fit), fit.sum(axis=0)
    y = np.array((n * fit - s), float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = [(i, n, sum((n * a - t) ** 2 for a, t in zip(x, s, strict=True)), (np.array(x) - np.array(s / n, float)) @ u / np.sqrt(e)) for i, x in fine]
    return out, e / np.trace(y.T @ y / n)


def check(got, rows):
    want, share = dense(rows)
    assert len(got) == len(want) * len(share)
    by: dict = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
        assert r.identity_error < 1e-9 and abs(r.explained / share[r.component - 1] - 1) < 1e-9
    signs = None
    for i, n, deviation, w in want:
        mine = by[i, deviation]
        mine_w = np.array([mine[c + 1][0].whitened for c in range(len(share))])
        assert all(len(mine[c + 1]) == sum(x[0] == i and x[2] == deviation for x in want) and mine[c + 1][0].n == n for c in range(len(share)))
        signs = np.sign(mine_w * w) if signs is None else signs
        np.testing.assert_allclose(mine_w * signs, w, atol=1e-9)


def vectors(n=300, d=12, seed=1):
    r = np.random.default_rng(seed)
    return [(i, (r.standard_normal(d) * np.linspace(0.2, 1.5, d) + 0.3).tolist()) for i in range(n)]


@pytest.mark.parametrize("p", [whiten.WhitenParams(), whiten.WhitenParams(block_bytes=500, combine=1, space=9, inner=3)])
def test_whitening_matches_the_dense_answer(spark, p):
    rows = vectors()
    rows += [(i, rows[0][1]) for i in range(1000, 1200)] + [(3, rows[3][1])]  # copies count once in the fit list
    odd = [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 10), (2003, [float("nan")] * 12), (2004, [float("inf")] + [0.0] * 11), (2005, [1.0] * 5), (2006, [1e300] + [0.0] * 11)]
    rows += [(2007, [0.0] * 12), (2008, [1e-200] * 12), (None, [0.5] * 12)]
    df = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 as x", "2 as id", "3 as component").repartition(5)
    check(whiten.whiten(df, p).collect(), rows)


def test_large_numbers_and_few_dimensions(spark):
    rows = [(i, [float(i * 10**9), float(i % 3)]) for i in range(20)]
    got = whiten.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    want = dense(rows)[0]
    exact = {i: d for i, _, d, _ in want}
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 2**63 else None for i, d in exact.items()} and len({r.component for r in got}) == 2 - (max(exact.values()) > 1e24)
    one = whiten.whiten(spark.createDataFrame([(i, [float(i)]) for i in range(9)], SCHEMA)).collect()
    assert len(one) == 9 and abs(sum(r.whitened**2 for r in one) / 9 - 1) < 1e-12 and all(abs(r.explained - 1) < 1e-12 for r in one)


def test_tables_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whiten.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0
    flat = [(i, [float(i), 1.0, float(i)]) for i in range(8)]  # one direction has all the variance
    got = whiten.whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and len(got) == 8


@pytest.mark.parametrize("seed", range(6))
def test_eigenpairs_of_close_and_spread_values(seed):
    r = np.random.default_rng(seed)
    d = 40
    q, _ = np.linalg.qr(r.standard_normal((d, d)))
    values = {0: np.linspace(1, 2, d), 1: 1 + 1e-4 * r.random(d), 2: np.logspace(-9, 3, d), 3: np.r_[[5.0] * 4, np.ones(d - 4)], 4: np.r_[[1e6], np.ones(d - 1)], 5: np.r_[np.zeros(d - 6), np.arange(6)]}[seed]
    v = (q * values) @ q.T
    e, u = whiten.eigenpairs(lambda x: v @ x, d, whiten.WhitenParams())
    np.testing.assert_allclose(e, np.sort(values)[::-1][:4], rtol=1e-12, atol=1e-13 * values.max())
    np.testing.assert_allclose(u.T @ u, np.eye(4), atol=1e-13)
    assert np.linalg.norm(v @ u - u * e, axis=0).max() < 1e-12 * e[0]
