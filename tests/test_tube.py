"""Bootstraps of families against numpy, on planted tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import draws as W
from terrane.operators import inference as I
from terrane.operators import tube as T

FOCALS, BAND, BOOT = [-1.0, 0.0, 1.5], 0.6, 60


@pytest.fixture(scope="module")
def planted(spark):
    """500 families of 1 to 3 rows; class 1's first feature grows with the axis, class 0's doesn't."""
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for f in range(500):
        for _ in range(rng.integers(1, 4)):
            t, p = float(rng.normal()), float(rng.uniform(0.05, 0.95))
            rows.append((n, f"f{f}", t, [1 - p, p], float(rng.normal() + (1.2 * t if p > 0.5 else 0)), float(rng.normal()), float((0.8 * t if p > 0.5 else 0) + rng.normal()), float(rng.normal())))
            n += 1
    df = spark.createDataFrame(rows, "id int, family string, axis double, r array<double>, a double, b double, c double, other double").repartition(3).cache()
    hashes = {r["family"]: r["h"] for r in df.select("family", F.xxhash64("family", F.lit(0)).alias("h")).distinct().collect()}
    m = W.family_weights(np.array([hashes[r[1]] for r in rows]), np.arange(BOOT + 1))
    return df, rows, m


def plain_paths(rows, m, columns, windows):
    """z by replicate, class, window and feature, straight from the rows."""
    x = np.array([[r[c] for c in columns] for r in rows])
    x = x / x.std(0, ddof=1)
    r = np.array([row[3] for row in rows])
    out = np.zeros((m.shape[1], 2, len(windows), len(columns)))
    for rep in range(m.shape[1]):
        for k in range(2):
            a = m[:, rep] * r[:, k]
            pooled = a @ x / a.sum()
            for j, (column, focal, h) in enumerate(windows):
                w = a * np.exp(-0.5 * ((np.array([row[column] for row in rows]) - focal) / h) ** 2)
                out[rep, k, j] = w @ x / w.sum() - pooled
    return out


def test_weights_are_poisson():
    m = W.family_weights(np.arange(20_000) * 7919, np.arange(6))
    assert (m[:, 0] == 1).all() and abs(m[:, 1:].mean() - 1) < 0.02 and abs(m[:, 1:].var() - 1) < 0.05
    assert abs(np.corrcoef(m[:, 1], m[:, 2])[0, 1]) < 0.03


def test_draws_and_tube(planted, monkeypatch):
    df, rows, m = planted
    want = plain_paths(rows, m, [4, 5], [(2, f, BAND) for f in FOCALS])
    for held in (W.HELD, 200):  # in one pass, and in several
        monkeypatch.setattr(W, "HELD", held)
        draws = T.displacement_draws(df, "family", ["a", "b"], "r", T.along("axis", FOCALS, BAND), BOOT).cache()
        got = {(r["rep"], r["class"], r["position"]): r["z"] for r in draws.collect()}
        assert len(got) == (BOOT + 1) * 6
        assert all(np.allclose(z, want[k], atol=1e-9) for k, z in got.items())
    length = np.sqrt((want**2).sum(-1))
    far = (np.abs(length[1:] - length[1:].mean(0)) / length[1:].std(0, ddof=1)).max(-1)
    for r in T.tube(draws).collect():
        own = length[1:, r["class"], r["position"]]
        assert np.allclose([r["value"], r["ci_low"], r["ci_high"]], [length[0, r["class"], r["position"]], *np.percentile(own, [2.5, 97.5])])
        assert np.isclose(r["band_high"] - r["value"], np.percentile(far[:, r["class"]], 95) * own.std(ddof=1))
        assert r["band_low"] <= r["ci_low"] + 1 and r["n_boot"] == BOOT


def test_directions_and_features(planted):
    df, rows, m = planted
    draws = T.displacement_draws(df, "family", ["a", "b"], "r", T.along("axis", FOCALS, BAND), BOOT).cache()
    want = plain_paths(rows, m, [4, 5], [(2, f, BAND) for f in FOCALS])
    u = want[0].mean(1)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    along = np.einsum("bkjf,kf->bkj", want, u)
    slope = np.array([[np.polyfit(FOCALS, p, 1)[0] for p in rep] for rep in along])
    got = {(r["class"], r["measure"]): r for r in T.directional_inference(draws, FOCALS, scale=2.0).collect()}
    for k in (0, 1):
        r = got[k, "slope"]
        tail = min((slope[1:, k] <= 0).mean(), (slope[1:, k] >= 0).mean())
        assert np.allclose([r["value"], r["ci_low"], r["ci_high"], r["p_value"]], [slope[0, k], *np.percentile(slope[1:, k], [2.5, 97.5]), max(min(1, 2 * tail), 1 / (BOOT + 1))])
        assert np.isclose(got[k, "trend"]["value"], slope[0, k] * 2.5 / 2.0)
    assert got[1, "slope"]["reject"] and got[1, "slope"]["p_value"] == 1 / (BOOT + 1)
    features = {(r["class"], r["feature"]): r for r in T.per_feature_inference(draws, ["a", "b"], 2).collect()}
    assert len(features) == 4 and features[1, "a"]["reject"] and not features[1, "a"]["covers_zero"]
    assert np.isclose(features[0, "b"]["ci_low"], np.percentile(want[1:, 0, 2, 1], 2.5))


def test_paired_draws(planted):
    df, rows, m = planted
    both = plain_paths(rows, m, [4, 5, 6], [(2, 1.5, BAND)])[:, :, 0]
    a, b = np.sqrt((both[:, :, :2] ** 2).sum(-1)), np.abs(both[:, :, 2])
    r = T.co_drift(df, "family", ["a", "b"], ["c"], "r", T.Window("axis", 1.5, BAND), BOOT).first()
    corr = np.array([np.corrcoef(x, y)[0, 1] for x, y in zip(a, b, strict=True)])
    assert np.isclose(r["alignment"], corr[0]) and np.allclose(r["block_profile"], b[0]) and np.allclose(r["phenotype_profile"], a[0])
    assert np.allclose([r["ci_low"], r["ci_high"]], np.percentile(corr[1:], [2.5, 97.5])) and r["n_joint"] == len(rows)
    two = plain_paths(rows, m, [4, 5], [(2, 1.5, BAND), (7, 1.0, 0.5)])
    sizes = np.sqrt((two**2).sum(-1)).mean(1)
    diff = sizes[:, 0] - sizes[:, 1]
    r = T.control_specificity(df, "family", ["a", "b"], "r", T.Window("axis", 1.5, BAND), T.Window("other", 1.0, 0.5), n_boot=BOOT).first()
    assert np.allclose([r["axis_magnitude"], r["control_magnitude"], r["difference"]], [*sizes[0], diff[0]])
    assert np.isclose(r["p_value_greater"], max((diff[1:] <= 0).mean(), 1 / (BOOT + 1)))


def test_odd_rows(spark):
    rows = [(None, 0.0, [1.0, 0.0], 1.0), (None, 1.0, [1.0, 0.0], 2.0), ("f", None, [1.0, 0.0], 3.0), ("f", 1.0, None, 3.0), ("g", 2.0, [1.0, 0.0], None), ("g", 1.0, [1.0, 0.0], 5.0)]
    df = spark.createDataFrame(rows, "family string, axis double, r array<double>, x double")
    got = T.displacement_draws(df, "family", ["x"], "r", T.along("axis", [0.5], 1.0), 3).collect()
    assert {(r["rep"], r["class"]) for r in got} == {(b, k) for b in range(4) for k in range(2)}
    assert all(r["z"] is None for r in got if r["class"] == 1)  # a class that no row is in
    seen = next(r["z"] for r in got if r["rep"] == 0 and r["class"] == 0)
    x, t = np.array([1.0, 2.0, 5.0]), np.array([0.0, 1.0, 1.0])
    w = np.exp(-0.5 * (t - 0.5) ** 2)
    assert np.isclose(seen[0], (w @ x / w.sum() - x.mean()) / x.std(ddof=1))
    assert T.displacement_draws(df.limit(0), "family", ["x"], "r", T.along("axis", [0.5], 1.0), 3).collect() == []


def test_shuffled_orders(spark):
    rng = np.random.default_rng(0)
    straight = [("moves", p, [float(p), 0.1 * float(rng.normal())]) for p in range(9)]
    still = [("still", p, [float(x) for x in rng.normal(size=2)]) for p in range(9)]
    got = {r["class"]: r for r in T.order_test(spark.createDataFrame(straight + still, "class string, position int, z array<double>"), ["class"], "position", "z", 400).collect()}
    for name, path in (("moves", straight), ("still", still)):
        z = np.array([p[2] for p in path])
        net = np.linalg.norm(z[:3].mean(0) - z[-3:].mean(0))
        null = [np.linalg.norm(q[:3].mean(0) - q[-3:].mean(0)) for q in (z[rng.permutation(9)] for _ in range(4000))]
        assert np.isclose(got[name]["net"], net) and abs(got[name]["p_value"] - np.mean(null >= net - 1e-12)) < 0.08
    assert got["moves"]["significant"] and not got["still"]["significant"]


def test_family_bootstrap_and_permutations(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i % 2}", i % 40, float(rng.normal() + (i % 40) / 10)) for i in range(600)]
    df = spark.createDataFrame(rows, "seg string, family long, value double").repartition(3)
    got = {r["seg"]: r for r in I.family_bootstrap(df, "family", ["seg"], 80).collect()}
    hashes = np.array([r["h"] for r in spark.range(40).select(F.xxhash64(F.col("id"), F.lit(0)).alias("h")).collect()])
    m = W.family_weights(hashes, np.arange(1, 81))
    for s in ("s0", "s1"):
        own = [(f, v) for g, f, v in rows if g == s]
        w, v = m[[f for f, _ in own]], np.array([v for _, v in own])
        draws = w.T @ v / w.sum(0)
        assert np.allclose([got[s]["estimate"], got[s]["ci_low"], got[s]["ci_high"]], [v.mean(), *np.percentile(draws, [2.5, 97.5])])
    long = spark.createDataFrame([(i, "k", f, float(v)) for i in range(400) for f, v in (("x", rng.normal()), ("y", rng.normal()))], "id long, class string, feature string, value double")
    null = [r["draw"] for r in I.permutation_null(long, "id", 0.25, 300).collect()]
    assert len(null) == 300 and abs(np.mean(np.square(null)) - 0.75 / 100) < 0.002  # (1 - share) / (share n)
