"""Refits in places against numpy, and a planted class that moves in one place."""

import numpy as np
import pytest

from terrane.operators import mixture as M
from terrane.operators import refits as R
from terrane.operators.schemes import Scheme


@pytest.fixture(scope="module")
def planted(spark):
    """Two classes; of those late on the axis, class 1's first feature lies 3 higher."""
    rng = np.random.default_rng(7)
    n = 900
    t, k = rng.uniform(0, 9, n), rng.integers(0, 2, n)
    x = np.stack([rng.normal(size=n) + 6 * k + 3 * ((t > 6) & (k == 1)), rng.normal(size=n) - 4 * k], 1)
    flag = (rng.uniform(size=n) < 0.2 + 0.5 * k).astype(float)
    df = spark.createDataFrame([(i, float(t[i]), float(x[i, 0]), float(x[i, 1]), float(flag[i])) for i in range(n)], "id long, t double, a double, b double, flag double").repartition(3).cache()
    columns = M.Columns(["a", "b"], ["flag"])
    return df, columns, M.fit(df, "id", columns, 2, n_init=3), t, np.concatenate([x, flag[:, None]], 1)


def plain_em(start, x, w, passes):
    m = start
    for _ in range(passes):
        r, ll = m.posterior(x)
        r *= w[:, None]
        n = r.sum(0)
        means = r.T @ x / n[:, None]
        m = M.Mixture(m.columns, n / n.sum(), means, r.T @ x[:, :2] ** 2 / n[:, None] - means[:, :2] ** 2, float(ll @ w))
    return float(m.posterior(x)[1] @ w), m


@pytest.mark.parametrize("scheme", [Scheme("quantile", 3), Scheme("kernel", 3, 1.5)])
def test_refits_against_numpy(planted, scheme):
    df, columns, pooled, t, x = planted
    places = R.places_of(df, "t", scheme)
    rows = R._rows(df, "id", "t", columns, 0)
    fits = R.refit(rows, columns, places, pooled, [0, 1])
    assert set(fits) == {(d, p) for d in (0, 1) for p in range(3)} and all(m.converged for m in fits.values())
    alone = R.refit(rows, columns, places, pooled, [0, 1], in_one_task=True)
    assert set(alone) == set(fits) and all(np.allclose(alone[c].means, fits[c].means, atol=1e-6) and alone[c].converged for c in fits)
    w = places.weights(t)
    for p in range(3):
        ll, plain = plain_em(pooled, x, w[:, p], 400)
        got = fits[0, p]
        assert float(got.posterior(x)[1] @ w[:, p]) == pytest.approx(ll, abs=0.05) and np.allclose(got.means, plain.means, atol=0.05)
    found = {r["place"]: r for r in R.summaries(rows, columns, places, pooled, fits, df.sparkSession).where("draw = 0").collect()}
    own = fits[0, 2].posterior(x)[0].argmax(1)
    for k in (0, 1):
        wk = w[:, 2] * (own == k)
        assert np.allclose(found[2]["means"][k], wk @ x / wk.sum()) and np.isclose(np.sum(found[2]["overlap"][k]), wk.sum())


def test_places_dealt_anew_keep_their_sizes(planted):
    df, columns, pooled, t, _ = planted
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, len(t))
    for scheme in (Scheme("quantile", 3), Scheme("kernel", 3, 1.5)):
        places = R.places_of(df, "t", scheme)
        row, draw, place, w = places.dealt(t, hashes, np.arange(40))
        sums = np.zeros((40, 3))
        np.add.at(sums, (draw, place), w)
        assert np.allclose(sums[0], places.weights(t).sum(0)) and np.allclose(sums[0], sums[1:].mean(0), rtol=0.05)
        assert len(places.dealt(np.full(len(t), np.nan), hashes, np.arange(3))[0]) == 0


def test_sweep_finds_what_moves(planted):
    df, columns, pooled, *_ = planted
    moving = int(pooled.means[:, 0].argmax())
    got = {(r["place"], r["class"]): r for r in R.sweep_refits(df, "id", "t", columns, Scheme("quantile", 3), pooled, n_perm=39).collect()}
    assert set(got) == {(p, k) for p in range(3) for k in range(2)} and all(r["n_null"] == 39 for r in got.values())
    assert got[2, moving]["p_value"] == 1 / 40 and got[2, moving]["value"] > got[2, moving]["null_p95"]
    assert got[2, 1 - moving]["p_value"] > 0.05 and got[2, moving]["value"] > 3 * got[2, 1 - moving]["value"]
    assert all(r["jaccard"] > 0.9 and not r["reorganised"] and r["ari"] > 0.8 for r in got.values())
    assert 0 < got[2, moving]["drift_vs_separation"] < 1


def test_alignment_and_reorganised_classes(spark):
    reference = spark.createDataFrame([([[0.0, 0.0], [2.0, 0.0]], [1.0, 2.0])], "centres array<array<double>>, sds array<double>")
    swapped = (0, 0, 20.0, [0, 1], ["a", "b"], [[2.0, 0.0], [0.0, 4.0]], [[1.0, 1.0]] * 2, [[1.0, 9.0], [9.0, 1.0]])
    mixed = (0, 1, 20.0, [0, 1], ["a", "b"], [[0.0, 0.0], [2.0, 0.0]], [[1.0, 1.0]] * 2, [[5.0, 5.0], [5.0, 5.0]])
    lone = (1, 0, 9.0, [1], ["a", "b"], [[2.0, 0.0]], [[1.0, 1.0]], [[0.0, 9.0]])
    found = spark.createDataFrame([swapped, mixed, lone], R.SUMMARY)
    got = {(r["draw"], r["place"], r["class"]): r for r in R.aligned(found, reference).collect()}
    assert got[0, 0, 1]["distance"] == 0.0 and got[0, 0, 0]["distance"] == pytest.approx(np.sqrt(2.0)) and got[0, 0, 0]["jaccard"] == pytest.approx(9 / 11)
    assert got[0, 1, 0]["jaccard"] < 0.5 and got[0, 1, 0]["ari"] < 0.1
    assert set(got) >= {(1, 0, 1)} and (1, 0, 0) not in got  # a class without members has no partner
    lines = [R.to_record(r) for r in found.collect()]
    again = spark.createDataFrame([R.from_record(x) for x in lines], R.SUMMARY)
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))


def test_fits_that_go_astray_are_left_out(planted, monkeypatch):
    df, columns, pooled, t, x = planted
    assert not R.degenerate(pooled) and R.degenerate(M.Mixture(columns, pooled.weights, pooled.means * np.nan, pooled.variances, 0.0))
    places = R.places_of(df, "t", Scheme("quantile", 3))
    rows = R._rows(df.where("t < 4.5"), "id", "t", columns, 0)
    fits = R.refit(rows, columns, places, pooled, [0], most=3)
    assert (0, 2) not in fits and {(0, 0), (0, 1)} == set(fits)  # a place without rows


def test_last_passes_in_one_task_are_those_of_many(planted, monkeypatch):
    df, columns, pooled, t, _ = planted
    rows = R._rows(df, "id", "t", columns, 0)
    each, calls, summed = len(t) * 2 * len(columns.names), [], R._summed
    monkeypatch.setattr(R, "_summed", lambda *args: calls.append(len(args[3])) or summed(*args))
    for scheme in (Scheme("quantile", 3), Scheme("kernel", 3, 1.5)):
        places, found, n = R.places_of(df, "t", scheme), [], []
        for task, work in ((0, 1), (1, 2 * each), (1, 9 * each)):  # never, once two draws are open, at once
            monkeypatch.setattr(R, "TASK", task)
            monkeypatch.setattr(R, "WORK", work)
            calls.clear()
            found.append(R.refit(rows, columns, places, pooled, list(range(6))))
            n.append(len(calls))
        assert n[0] > n[1] > n[2] == 0
        assert all(set(x) == set(found[0]) and len(x) == 18 for x in found)
        for x in found[1:]:
            assert all(x[c].converged == m.converged and np.isclose(x[c].log_likelihood, m.log_likelihood) and np.allclose(x[c].means, m.means, atol=1e-6) for c, m in found[0].items())


@pytest.mark.parametrize("scheme", [Scheme("quantile", 3), Scheme("quantile", 12), Scheme("kernel", 3, 1.5)])
def test_rows_by_place_are_those_dealt(planted, scheme):
    df, _, _, t, _ = planted
    places, hashes = R.places_of(df, "t", scheme), np.random.default_rng(2).integers(-(2**63), 2**63 - 1, len(t))
    x = np.where(np.arange(len(t)) % 11 == 0, np.nan, t)
    for draw in (0, 1, 7):
        row, _, place, w = places.dealt(x, hashes, np.array([draw]))
        got = [(r, p, v) for p, rows, weights in places.cells(x, hashes, draw) for r, v in zip(rows, weights, strict=True)]
        assert sorted(got) == sorted(zip(row, place, w, strict=True)) and len(got) > 0
