"""Bandwidths with far values, bins at low floors, texts for ages, and versions whose sheets are empty."""

import time

import numpy as np
import pytest

from terrane.functions import ages
from terrane.operators import cohort, inference, strata
from terrane.sources import store as S


def test_bandwidth_is_of_the_rows_themselves(spark):
    x = np.random.default_rng(0).normal(size=5000)
    focals = [-1.0, 0.0, 1.0]

    def least(h, v):
        return min(np.exp(-0.5 * ((v - f) / h) ** 2).sum() for f in focals)

    for far in ([], [1e6], [1e6, -1e9, None, float("nan")]):
        df = spark.createDataFrame([(None if v is None else float(v),) for v in [*x, *far]], "x double")
        h = strata.bandwidth_for(df, "x", focals, 500.0)
        v = np.array([u for u in [*x, *far] if u is not None and u == u])
        assert least(h, v) >= 500.0 > least(h - 2e-3, v) and h == pytest.approx(0.168, abs=3e-3)
    assert strata.bandwidth_for(df.limit(0), "x", focals, 5.0) == 1e9 == strata.bandwidth_for(df, "x", focals, 1e6)


def test_max_equal_bins_at_low_floors(spark):
    rng = np.random.default_rng(1)
    for values, floor in ((rng.normal(size=3000), 120), (rng.integers(0, 40, 3000), 120), (np.repeat(rng.normal(size=30), 100), 150), (np.zeros(50), 5)):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        began = time.time()
        got = strata.max_equal_edges(df, "x", floor)
        took = time.time() - began
        for q in range(max(2, len(values) // floor), 1, -1):
            edges = sorted({float(e) for e in np.quantile(values, [i / q for i in range(1, q)])})
            sizes = np.histogram(values, [-np.inf, *edges, np.inf])[0]  # bins are left closed
            if q == 2 or sizes.min() >= floor:
                break
        assert np.allclose(got, edges) and took < 60
    assert strata.max_equal_edges(df.limit(0), "x", 5) == []


@pytest.mark.parametrize("text", ["hasn't", "has n't yet", "has not", "did not walk", "doesn’t", "not able", "can not", "cannot", "can't", "never", "not yet", "unable to"])
def test_not_reached(text):
    assert ages.parse_age_months(text) == 888.0


def test_spellings_of_ages():
    twelve = ["12 moths", "12 mths", "12 mnths", "12 mons", "circa 12 months", "almost 12 months", "less than 12 months", "> 12 months", "up to 12 mo", "about 12", "roughly 12 months old", "nearly 1 yr", "under 1 year", "c. 12 mos"]
    assert {t: ages.parse_age_months(t) for t in twelve} == dict.fromkeys(twelve, 12.0)
    assert [ages.parse_age_months(t) for t in ("before 12", "over 3", "< 4", "lost at 12 months", "n/a", "")] == [None] * 6


def test_an_empty_sheet_replaces_what_was_there(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "store"))
    kinds = S.SCHEMAS["tbl"]
    cols = [c.split() for c in kinds.split(", ")]

    def rows(version, n):
        fixed = {"dataset": "d'x", "version": version}
        return spark.createDataFrame([tuple(fixed.get(c, f"{c}{i}" if k == "string" else i) for c, k in cols) for i in range(n)], kinds)

    store.replace("tbl", rows("1", 3), of=("d'x", "1"))
    store.replace("tbl", rows("2/a", 2), of=("d'x", "2/a"))
    assert store.table("tbl").count() == 5
    store.replace("tbl", rows("2/a", 0), of=("d'x", "2/a"))
    assert [r["version"] for r in store.table("tbl").collect()] == ["1"] * 3
    store.replace("tbl", rows("1", 1), of=("d'x", "1"))
    assert store.table("tbl").count() == 1
    store.clear("d'x")
    assert store.table("tbl").count() == 0


def test_percentiles_of_axes(spark):
    x = np.random.default_rng(2).normal(size=501)
    df = spark.createDataFrame([(float(v), None if i % 3 else float(i), None) for i, v in enumerate(x)], "a double, b double, none double")
    got = {r["axis"]: r for r in cohort.coverage(df, ["a", "b", "none"]).collect()}
    assert np.allclose([got["a"][p] for p in ("p5", "p25", "p50", "p75", "p95")], np.percentile(x, [5, 25, 50, 75, 95]))
    assert got["b"]["n_missing"] == 334 and got["none"]["p50"] is None and got["none"]["coverage"] == 0.0
    r = cohort.contemporaneity(spark.createDataFrame([(2000, 2003, 1999), (2001, None, 2001), (None, None, 1)], "y0 int, y1 int, d int"), ["y0", "y1"], "d").first()
    assert tuple(r) == (1.5, 2.7, 0.5, 1.25)


def test_invariance_where_rows_lack_features(spark):
    rng = np.random.default_rng(5)
    cells = [(i, i // 40, "k", 1.0, f, float(rng.normal())) for i in range(400) for f in ("a", "b", "c") if (i + ord(f)) % 5]
    got = {r["functional"]: r for r in inference.invariance_by_class(spark.createDataFrame(cells, "id long, grid int, class string, r double, feature string, value double"), 100, 1).collect()}
    s = np.zeros((400, 3))
    for i, _, _, _, f, v in cells:
        s[i, ord(f) - 97] = v
    seen = np.zeros((400, 3), bool)
    for i, _, _, _, f, _ in cells:
        seen[i, ord(f) - 97] = True
    mean = s.sum(0) / seen.sum(0)
    var = (s**2).sum(0) / seen.sum(0) - mean**2
    z = np.where(seen, (s - mean) / var, 0.0)
    values, vectors = np.linalg.eigh(z.T @ z)
    w = np.cumsum(np.add.reduceat(z, np.arange(0, 400, 40)), 0) @ (vectors / np.sqrt(values))
    assert got["max"]["statistic"] == pytest.approx((w**2).sum(1)[:-1].max())
