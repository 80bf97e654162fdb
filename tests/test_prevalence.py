"""One-against-the-rest logits against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import draws as W
from terrane.operators import prevalence as P


def plain_logit(x, t, w):
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-x @ beta))
        a = w * np.maximum(mu * (1 - mu), 1e-9)
        beta = beta + np.linalg.solve(x.T @ (x * a[:, None]) + 1e-9 * np.eye(len(beta)), x.T @ (w * (t - mu)))
    mu = 1 / (1 + np.exp(-x @ beta))
    return beta, float((w * (t * np.log(mu) + (1 - t) * np.log(1 - mu))).sum()), x.T @ (x * (w * mu * (1 - mu))[:, None])


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(4)
    n = 1200
    axis, z = rng.normal(size=n) * 3 + 10, rng.normal(size=n)
    logit = np.stack([np.zeros(n), 0.4 * (axis - 10) - 0.5, 0.8 * z], 1)
    share = np.exp(logit) / np.exp(logit).sum(1, keepdims=True)
    true = np.array([rng.choice(3, p=s) for s in share])
    r = np.full((n, 3), 0.1) + 0.7 * np.eye(3)[np.where(rng.uniform(size=n) < 0.85, true, rng.integers(0, 3, n))]
    r /= r.sum(1, keepdims=True)
    rows = [(f"f{i % 400}", float(axis[i]), float(z[i]), r[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "family string, axis double, z double, r array<double>").repartition(3).cache()
    h = {x["family"]: x["h"] for x in df.select("family", F.xxhash64("family", F.lit(0)).alias("h")).distinct().collect()}
    m = W.family_weights(np.array([h[x[0]] for x in rows]), np.arange(21))
    return df, np.stack([axis, z], 1), r, m


def test_logits_of_all_replicates(planted):
    df, x, r, m = planted
    coef, ll, curve = P.logits(df, ["axis", "z"], "r", "family", 20)
    assert coef.shape == (3, 21, 3)
    for k in range(3):
        for b in (0, 1, 20):
            beta, like, h = plain_logit(x, r[:, k], m[:, b])
            assert np.allclose(coef[k, b], beta, atol=1e-4) and np.isclose(ll[k, b], like, rtol=1e-6)
            assert np.isclose(np.linalg.inv(curve[k, b])[1, 1], np.linalg.inv(h)[1, 1], rtol=1e-3)
    without, less, _ = P.logits(df, ["axis", "z"], "r", without="axis")
    beta, like, _ = plain_logit(x[:, 1:], r[:, 1], m[:, 0])
    assert without[1, 0, 1] == 0 and np.allclose(without[1, 0, [0, 2]], beta, atol=1e-4) and np.isclose(less[1, 0], like, rtol=1e-6)


def test_naive_slopes_and_their_tests(planted):
    df, x, r, m = planted
    got = {g["class"]: g for g in P.one_vs_rest(df, ["axis", "z"], "r", "axis", "family", 20, corrected=False).collect()}
    for k in range(3):
        t = (r.argmax(1) == k).astype(float)
        draws = [plain_logit(x, t, m[:, b])[0][1] for b in range(1, 21)]
        beta, like, h = plain_logit(x, t, m[:, 0])
        assert np.allclose([got[k]["slope"], got[k]["ci_low"], got[k]["ci_high"]], [beta[1], *np.percentile(draws, [2.5, 97.5])], atol=1e-4)
        assert np.isclose(got[k]["odds_ratio"], np.exp(beta[1]), atol=1e-4)
        from math import erfc, sqrt

        lr = 2 * (like - plain_logit(x[:, 1:], t, m[:, 0])[1])
        assert np.isclose(got[k]["wald_p"], erfc(abs(beta[1]) / np.sqrt(np.linalg.inv(h)[1, 1]) / sqrt(2)), rtol=1e-2, atol=1e-9)
        assert np.isclose(got[k]["lrt_p"], erfc(sqrt(lr / 2)), rtol=1e-2, atol=1e-9)
    assert got[1]["reject"] and got[1]["slope"] > 0


def test_corrected_slopes(planted):
    df, x, r, m = planted
    d = P.confusion(df, "r")
    for k in range(3):
        seen = r[:, k] >= 0.5
        want = [r[seen, k].sum() / r[:, k].sum(), (1 - r[seen, k]).sum() / (1 - r[:, k]).sum()]
        assert np.allclose(d[k, :, 0], want) and np.allclose(d[k].sum(1), 1)
    coef, *_ = P.logits(df, ["axis", "z"], "r", "family", 2, d)
    one = np.concatenate([np.ones((len(x), 1)), (x - x.mean(0)) / x.std(0)], 1)
    for k in (0, 1):
        for b in (0, 2):
            beta = np.zeros(3)
            for _ in range(400):  # EM to the end
                mu = 1 / (1 + np.exp(-one @ beta))
                s = (r[:, k] < 0.5).astype(int)
                into, out = mu * d[k, 0, s], (1 - mu) * d[k, 1, s]
                g = into / (into + out)
                h = one.T @ (one * (m[:, b] * mu * (1 - mu))[:, None])
                beta = beta + np.linalg.solve(h, one.T @ (m[:, b] * (g - mu)))
            assert np.isclose(coef[k, b, 1], beta[1] / x[:, 0].std(), atol=2e-3)
    got = {g["class"]: g for g in P.one_vs_rest(df, ["axis", "z"], "r", "axis", "family", 20).collect()}
    naive, *_ = P.logits(df.withColumn("h", F.transform("r", lambda v: (v >= 0.5).cast("double"))), ["axis", "z"], "h")
    assert got[1]["slope"] > naive[1, 0, 1] > 0 and got[1]["reject"] and got[1]["wald_p"] is None  # error hides part of it


def test_rows_that_lack_something(planted, spark):
    df, *_ = planted
    odd = df.unionByName(spark.createDataFrame([("x", None, 1.0, [1.0, 0.0, 0.0]), (None, 9.0, 1.0, None)], df.schema))
    a, b = (P.logits(d, ["axis", "z"], "r")[0] for d in (df, odd))
    assert np.allclose(a, b)
    assert P.logits(df.limit(0), ["axis"], "r")[0].shape[0] == 0
