"""Sums of EM's passes over packed rows against plain posteriors, and fits alike in one task and in many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import mixture as M


def model(rng, columns, x, k, **held):
    nc = len(columns.continuous)
    means = np.concatenate([x[rng.choice(len(x), k), :nc], rng.uniform(0.2, 0.8, (k, columns.others))], 1)
    return M.Mixture(columns, np.full(k, 1 / k), means, rng.uniform(0.5, 2, (k, nc)), **held)


@pytest.mark.parametrize("columns", [M.Columns(["a", "b"], ["flag"], {"kind": 3}), M.Columns(["a"]), M.Columns([], ["flag"])])
def test_sums_over_packed_rows_are_those_of_posteriors(spark, monkeypatch, columns):
    monkeypatch.setattr(M, "PACKED", 400)  # a few rows
    rng = np.random.default_rng(3)
    n = 300
    kind, flag = rng.integers(0, 3, n), rng.integers(0, 2, n).astype(float)
    flag[-1] = 0.5  # no byte holds it
    table = [(float(a), float(b), float(f), float(k), float(w), i % 3) for i, (a, b, f, k, w) in enumerate(zip(rng.normal(size=n), rng.normal(size=n), flag, kind, rng.uniform(0.5, 2, n)))]
    df = spark.createDataFrame(table, "a double, b double, flag double, kind double, _w double, _fold int").repartition(3)
    own = df.select(*columns.names, "_w", "_fold").toPandas()
    x, w, fold = columns.expanded(own[columns.names].to_numpy()), own["_w"].to_numpy(), own["_fold"].to_numpy()
    blocks = M._packed(df, columns)
    assert blocks.count() > 5
    ys = [len(r["y"]) for r in blocks.collect()]
    assert sum(ys) <= 2 * n * columns.others + 8 * 50 * columns.others  # flags and levels take a byte
    models = [model(rng, columns, x, 2), model(rng, columns, x, 3), model(rng, columns, x, 2, hold=1)]
    models += [model(rng, columns, x, 2, only=0), model(rng, columns, x, 3, only=2), model(rng, columns, x, 2, only=0)]
    nc = len(columns.continuous)
    for own in (models[:3], models[3:]):
        for m, (r0, r1, r2, ll) in zip(own, M._pass(blocks, own, 3), strict=True):
            r, each = m.posterior(x)
            used = w * (fold != m.hold) * (1 if m.only < 0 else fold == m.only)
            r = r * used[:, None]
            assert np.allclose(r0, r.sum(0)) and np.allclose(r1, r.T @ x) and np.allclose(r2, r.T @ x[:, :nc] ** 2) and np.isclose(ll, each @ used)


def test_fits_in_many_tasks_are_those_of_one(spark, monkeypatch):
    rows = spark.range(0, 900, 1, 3).select("id", (F.sin("id") + F.col("id") % 2 * 4).alias("a"), (F.col("id") % 3 == 0).cast("int").alias("flag"))
    columns = M.Columns(["a"], ["flag"])
    alone = M.fit_many(rows, "id", columns, [(2, -1, 0), (2, -1, 1), (3, -1, 0)])
    monkeypatch.setattr(M, "TASK", 0)
    many = M.fit_many(rows, "id", columns, [(2, -1, 0), (2, -1, 1), (3, -1, 0)])
    assert all(a.converged and b.converged and np.isclose(a.log_likelihood, b.log_likelihood) and np.allclose(a.means, b.means, atol=1e-6) for a, b in zip(alone, many, strict=True))
