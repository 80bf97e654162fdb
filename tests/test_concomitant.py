"""Class shares that follow covariates: what is planted comes back, and the likelihood is numpy's."""

import numpy as np
import pytest

from terrane.operators import concomitant as C
from terrane.operators import mixture as M


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(8)
    n = 1500
    z = np.stack([rng.normal(size=n) * 4 + 20, rng.integers(0, 2, n)], 1).astype(float)
    eta = 0.3 * (z[:, 0] - 20) + 0.8 * z[:, 1] - 0.4
    k = (rng.uniform(size=n) < 1 / (1 + np.exp(-eta))).astype(int)
    x = np.stack([rng.normal(size=n) + 2.5 * k, rng.normal(size=n) - 1.5 * k], 1)
    flag = (rng.uniform(size=n) < 0.2 + 0.6 * k).astype(float)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(flag[i]), *map(float, z[i])) for i in range(n)], "id long, a double, b double, flag double, age double, sex double").repartition(3).cache()
    columns = M.Columns(["a", "b"], ["flag"])
    return df, columns, C.fit(df, "id", columns, ["age", "sex"], 2, 3), np.concatenate([x, flag[:, None]], 1), z, k


def test_planted_covariates(planted):
    _, _, model, x, z, k = planted
    assert model.converged
    sign = 1 if model.measured.means[1, 0] > model.measured.means[0, 0] else -1
    slope = sign * model.coefficients[0]
    assert slope[1] == pytest.approx(0.3, abs=0.08) and slope[2] == pytest.approx(0.8, abs=0.4) and slope[0] == pytest.approx(-6.4, abs=1.7)
    r, _ = model.posterior(x, z)
    label = r.argmax(1) if sign > 0 else 1 - r.argmax(1)
    assert (label == k).mean() > 0.93


def test_likelihood_and_stationarity(planted):
    df, columns, model, x, z, _ = planted
    r, ll = model.posterior(x, z)
    assert model.log_likelihood == pytest.approx(ll.sum(), rel=1e-6)
    plain = M.fit(df, "id", columns, 2, 3)
    assert model.log_likelihood > plain.log_likelihood + 50 and model.free_parameters() == plain.free_parameters() + 2
    share, one = np.exp(model.log_shares(z)), np.concatenate([np.ones((len(z), 1)), (z - z.mean(0)) / z.std(0)], 1)
    assert np.abs((r - share)[:, 1:].T @ one).max() / len(z) < 2e-3  # the logit's gradient at the end
    assert np.allclose(r.T @ x / r.sum(0)[:, None], model.measured.means, atol=5e-3)
    # EM in numpy from the same start comes to the same likelihood.
    gamma, m = np.zeros(3), M.Mixture(columns, plain.weights, plain.means, plain.variances)
    gamma[0] = np.log(plain.weights[1] / plain.weights[0])
    for _ in range(300):
        eta = one @ gamma
        now = C.Structural(m, ["age", "sex"], np.array([[gamma[0] - (gamma[1:] / z.std(0)) @ z.mean(0), *(gamma[1:] / z.std(0))]]))
        q, whole = now.posterior(x, z)
        s = 1 / (1 + np.exp(-eta))
        gamma = gamma + np.linalg.solve(one.T @ (one * (s * (1 - s))[:, None]), one.T @ (q[:, 1] - s))
        means = q.T @ x / q.sum(0)[:, None]
        m = M.Mixture(columns, q.mean(0), means, q.T @ x[:, :2] ** 2 / q.sum(0)[:, None] - means[:, :2] ** 2)
    assert whole.sum() == pytest.approx(model.log_likelihood, abs=0.5)


def test_assignment_and_odd_rows(planted, spark):
    df, columns, model, x, z, _ = planted
    got = {r["id"]: r for r in C.assign(df, "id", model).collect()}
    r, ll = model.posterior(x, z)
    assert len(got) == len(x) and all(np.allclose(got[i]["responsibilities"], r[i]) and np.isclose(got[i]["log_likelihood"], ll[i]) for i in range(0, len(x), 97))
    odd = df.unionByName(spark.createDataFrame([(9999, 1.0, 1.0, 0.0, None, 1.0), (9998, None, 1.0, 0.0, 1.0, 1.0)], df.schema))
    assert C.assign(odd, "id", model).count() == len(x)
    one = C.fit(df, "id", columns, ["age"], 1, 1)
    assert one.coefficients.shape == (0, 2) and one.converged and one.log_likelihood == pytest.approx(M.fit(df, "id", columns, 1, 1).log_likelihood, rel=1e-9)
