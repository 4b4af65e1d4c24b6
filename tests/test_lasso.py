"""The penalised binomial fits beside a plain loop over folds, persons and penalties."""

import math
import random

import numpy as np
import pytest

from seqcohort.operators import lasso

TERMS = ["a", "b", "c"]
SCHEMA = "estimator string, ptid long, g int, a double, b double, c double"


def cohort(persons, per, seed, name="e"):
    rng = random.Random(seed)
    out = []
    for p in range(persons):
        for _ in range(per):
            a, b, c = rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(5, 1)
            out.append((name, p, int(rng.random() < 1 / (1 + math.exp(-(0.4 + 0.7 * a - 0.5 * b)))), a, b, c))
    return out


def matrices(rows):
    return np.array([[1.0, r[3], r[4], r[5]] for r in rows]), np.array([float(r[2]) for r in rows])


def slope(x, y, beta):
    return x.T @ (1 / (1 + np.exp(-x @ beta)) - y) / len(y)


def fit(x, y, lam, free=(0, 1)):
    """Accelerated proximal gradient on standardised columns: another way than the library's."""
    mean, sd = x.mean(0), x.std(0)
    mean[0], sd[0] = 0.0, 1.0
    z = (x - mean) / sd
    rate = 4 * len(y) / np.linalg.norm(z, 2) ** 2
    limit = np.array([0.0 if j in free else lam for j in range(x.shape[1])]) * rate
    beta = other = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(50_000):
        new = other - rate * slope(z, y, other)
        new = np.where(np.isinf(limit), 0.0, np.sign(new) * np.maximum(np.abs(new) - np.where(np.isinf(limit), 0, limit), 0.0))
        if (other - new) @ (new - beta) > 0:
            t = 1.0
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        moved, beta, other = np.abs(new - beta).max(), new, new + (before - 1) / t * (new - beta)
        if moved < 1e-13:
            break
    out = beta / sd
    out[0] = beta[0] - (beta[1:] / sd[1:]) @ mean[1:]
    return out


def brute(rows, n_lambda, smallest):
    out = {}
    for p in sorted({r[1] for r in rows}):
        train = [r for r in rows if r[1] != p]
        x, y = matrices(train)
        null = fit(x, y, math.inf)
        top = np.max(np.abs(slope(x, y, null))[2:] / x.std(0)[2:])
        score = []
        for lam in top * np.logspace(0, math.log10(smallest), n_lambda):
            dev = 0.0
            for q in sorted({r[1] for r in train}):
                beta = fit(*matrices([r for r in train if r[1] != q]), lam)
                xo, yo = matrices([r for r in train if r[1] == q])
                eta = xo @ beta
                dev += 2 * (np.logaddexp(0, eta) - yo * eta).sum()
            score.append((dev, -lam))
        lam = -min(score)[1]
        out[p] = (lam, fit(x, y, lam))
    return out


def test_equals_a_loop_over_folds(spark):
    rows = cohort(7, 6, 3)
    want = brute(rows, 4, 1e-2)
    got = lasso.lasso_logistic_coefficients(
        spark.createDataFrame(rows, SCHEMA), "g", TERMS, n_lambda=4, smallest=1e-2, row_block=16, fit_block=50).collect()
    assert {r.ptid for r in got} == set(want)
    for r in got:
        assert r.converged and not r.fallback
        assert r.lam == pytest.approx(want[r.ptid][0], rel=1e-6)
        assert np.allclose(r.beta, want[r.ptid][1], atol=1e-6)


def test_groups_weights_nulls_and_single_persons(spark):
    rows = cohort(9, 5, 4)
    extra = [("e", None, 1, 0.0, 0.0, 5.0), ("e", 3, None, 0.0, 0.0, 5.0), ("alone", 1, 1, 0.0, 0.0, 5.0)]
    run = lambda r: {(x.estimator, x.ptid): (x.beta, x.lam, x.converged) for x in lasso.lasso_logistic_coefficients(
        spark.createDataFrame(r, SCHEMA), "g", TERMS, n_lambda=3, inner_folds=3).collect()}
    once = run(rows + extra)
    assert set(once) == {("e", p) for p in range(9)} and all(v[2] for v in once.values())
    twice = run(rows * 2)  # doubled rows change neither the loss per row nor the choice
    for k, (beta, lam, _) in once.items():
        assert twice[k][1] == pytest.approx(lam, rel=1e-6) and np.allclose(twice[k][0], beta, atol=1e-6)


def test_constant_columns_get_zero_and_predictions_are_probabilities(spark):
    rows = [(*r[:5], 5.0) for r in cohort(5, 6, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert all(r.beta[3] == 0 for r in lasso.lasso_logistic_coefficients(df, "g", TERMS, n_lambda=3, inner_folds=2).collect())
    shown = lasso.lopo_lasso_logistic_predictions(df, "g", TERMS, n_lambda=3, inner_folds=2).collect()
    assert len(shown) == len(rows) and all(0 < r.prediction < 1 for r in shown)
