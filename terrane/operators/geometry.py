"""Geometry of classes: scatter, discriminant axes, Mahalanobis and Jensen-Shannon distances.

Spark adds up the scatter of features (features by features); numpy solves what is small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scatter(df: DataFrame, label: str, features: list[str]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, their sizes, sums of x and sums of x x' (per class), added up task by task."""
    f = len(features)

    def sums(batches):
        total: dict = {}
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], 1)
            own = np.array(b.column(label).to_pylist(), dtype=object)
            for k in set(own.tolist()):
                part = x[own == k]
                add = np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
                total[k] = total.get(k, 0) + add
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([str(k)] * len(v)), pa.array(np.arange(len(v))), pa.array(v)], ["k", "i", "v"])

    rows = df.select(F.col(label), *(F.col(c).cast("double").alias(c) for c in features)).dropna().mapInArrow(sums, "k string, i long, v double")
    got = rows.groupBy("k", "i").agg(F.sum("v").alias("v")).orderBy("k", "i").toPandas()  # classes by features squared
    names = sorted(got["k"].unique())
    v = got["v"].to_numpy().reshape(len(names), -1)
    return names, v[:, 0], v[:, 1 : f + 1], v[:, f + 1 :].reshape(-1, f, f)


def within(n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> np.ndarray:
    """The pooled within-class covariance."""
    return (ss.sum(0) - np.einsum("ki,kj->ij", s / n[:, None], s)) / max(1.0, n.sum() - len(n))


def shrunk(cov: np.ndarray, shrinkage: float = 0.1) -> np.ndarray:
    """A covariance drawn towards its mean variance, so that it can be inverted."""
    return (1 - shrinkage) * cov + shrinkage * np.trace(cov) / len(cov) * np.eye(len(cov))


def discriminant_axes(n: np.ndarray, s: np.ndarray, ss: np.ndarray, axes: int = 3) -> np.ndarray:
    """Directions that part the classes best (features by axes); the largest loading is positive."""
    w = shrunk(within(n, s, ss), 1e-6)
    mean = s.sum(0) / n.sum()
    m = s / n[:, None] - mean
    values, vectors = np.linalg.eigh(w)
    half = vectors / np.sqrt(np.maximum(values, 1e-12))
    between = half.T @ (m.T * n @ m / n.sum()) @ half
    top = np.linalg.eigh(between)[1][:, ::-1][:, : min(axes, len(n) - 1)]
    out = half @ top
    return out * np.sign(out[np.abs(out).argmax(0), np.arange(out.shape[1])])


def mahalanobis(d: np.ndarray, cov: np.ndarray) -> tuple[float, np.ndarray]:
    """The distance of a displacement and each feature's part of its square; a missing part is 0."""
    d = np.where(np.isfinite(d), d, 0.0)
    parts = d * np.linalg.solve(cov, d)
    return float(np.sqrt(max(0.0, parts.sum()))), parts


def gaussian_jsd(m1: Column, s1: Column, m2: Column, s2: Column, points: int = 256) -> Column:
    """Jensen-Shannon divergence of two Gaussians in bits, on a grid of six sds around both."""
    lo, hi = F.least(m1 - 6 * s1, m2 - 6 * s2), F.greatest(m1 + 6 * s1, m2 + 6 * s2)
    step = (hi - lo) / (points - 1)

    def density(x: Column, m: Column, s: Column) -> Column:
        z = (x - m) / s
        return F.exp(-0.5 * z * z) / (s * float(np.sqrt(2 * np.pi)))

    def term(i: Column) -> Column:
        x = lo + i * step
        p, q = density(x, m1, s1), density(x, m2, s2)
        mid = (p + q) / 2
        return (F.when(p > 1e-300, p * F.log(p / mid)).otherwise(0.0) + F.when(q > 1e-300, q * F.log(q / mid)).otherwise(0.0)) / 2

    total = F.aggregate(F.sequence(F.lit(0), F.lit(points - 1)), F.lit(0.0), lambda a, i: a + term(i)) * step / float(np.log(2))
    return F.when((s1 > 0) & (s2 > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))
