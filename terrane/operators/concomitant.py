"""Mixtures whose class shares depend on covariates: a multinomial logit in place of the weights.

Each pass of EM also sums the logit's gradient and curvature, at the responsibilities and the shares
of that pass, so its Newton step costs no pass of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import mixture as M
from terrane.operators.mixture import MOST, TINY, TOL, Columns, Mixture, _joint, _matrix

RIDGE = 1e-6


@dataclass
class Structural:
    """A mixture's emissions (measured; its weights are the mean shares), the covariates, and the logit's
    coefficients (classes - 1 by 1 + covariates, class 0 first)."""

    measured: Mixture
    covariates: list[str]
    coefficients: np.ndarray
    log_likelihood: float = -np.inf
    converged: bool = False

    def log_shares(self, z: np.ndarray) -> np.ndarray:
        """Rows by classes, of covariates."""
        eta = np.concatenate([np.zeros((len(z), 1)), self.coefficients[:, 0] + z @ self.coefficients[:, 1:].T], 1)
        top = eta.max(1, keepdims=True)
        return eta - top - np.log(np.exp(eta - top).sum(1, keepdims=True))

    def posterior(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responsibilities and log-likelihood of each row."""
        j = _joint([replace(self.measured, weights=np.ones(len(self.measured.weights)))])(x) + self.log_shares(z)
        top = j.max(1, keepdims=True)
        e = np.exp(j - top)
        s = e.sum(1, keepdims=True)
        return e / s, (top + np.log(s))[:, 0]

    def free_parameters(self) -> int:
        return self.measured.free_parameters() - (len(self.measured.weights) - 1) + self.coefficients.size


def _covariates(batch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(f"_z{i}").to_numpy(zero_copy_only=False) for i in range(len(names))], 1) if names else np.zeros((batch.num_rows, 0))


def _rows(df: DataFrame, key: str, columns: Columns, covariates: list[str], weight: str | None = None) -> DataFrame:
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w")
    return df.select(key, *(F.col(c).cast("double").alias(c) for c in columns.names), *(F.col(c).cast("double").alias(f"_z{i}") for i, c in enumerate(covariates)), w).dropna()


def fit(df: DataFrame, key: str, columns: Columns, covariates: list[str], k: int, n_init: int = 20, seed: int = 0, weight: str | None = None, most: int = MOST, tol: float = TOL, start: Mixture | None = None) -> Structural:
    """A mixture whose shares follow the covariates, by EM from the best of n_init fits without them (or
    from start). Rows that lack a column or a covariate are left out.

    EM ends when a pass adds tol or less to the log-likelihood of a row (converged), or after most passes.
    A step of the logit that would lower the likelihood is halved.
    """
    rows = _rows(df, key, columns, covariates, weight).cache()
    try:
        base = start or M.fit(rows, key, columns, k, n_init, seed, weight="_w", most=most, tol=tol)
        named = [f"_z{i}" for i in range(len(covariates))]
        stats = rows.agg(F.sum("_w").alias("n"), *(f(c).alias(f"{a}{c}") for c in named for a, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        mean, sd = (np.array([stats[f"{a}{c}"] for c in named], float) for a in ("m", "s"))
        sd = np.where(sd > 0, sd, 1.0)
        k, f, nc, p = len(base.weights), base.means.shape[1], len(columns.continuous), 1 + len(covariates)
        least = 1e-4 * np.maximum(base.variances.mean(0), TINY)
        q = (k - 1) * p

        def passed(now: Structural) -> np.ndarray:
            def sums(batches):
                total = None
                for b in batches:
                    step = max(1, M.BLOCK // max(1, k * f + q * p))
                    for at in range(0, b.num_rows, step):
                        part = b.slice(at, step)
                        x, z, w = _matrix(part, columns), (_covariates(part, covariates) - mean) / sd, part.column("_w").to_numpy()
                        r, ll = now.posterior(x, z)
                        share, one = np.exp(now.log_shares(z)), np.concatenate([np.ones((len(z), 1)), z], 1)
                        r *= w[:, None]
                        gradient = (r - w[:, None] * share)[:, 1:].T @ one
                        s = share[:, 1:]
                        curve = np.stack([np.stack([(one * (w * s[:, i] * ((i == j) - s[:, j]))[:, None]).T @ one for j in range(k - 1)], 1) for i in range(k - 1)]) if k > 1 else np.zeros(0)
                        new = np.concatenate([r.sum(0), (r.T @ x).ravel(), (r.T @ x[:, :nc] ** 2).ravel(), gradient.ravel(), np.asarray(curve).ravel(), [ll @ w]])
                        total = new if total is None else total + new
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

            got = rows.mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # classes by columns
            out = np.zeros(got.num_rows)
            out[got.column("i").to_numpy()] = got.column("v").to_numpy()
            return out

        gamma = np.zeros((k - 1, p))
        gamma[:, 0] = np.log(np.maximum(base.weights[1:], TINY) / max(base.weights[0], TINY))
        now = Structural(Mixture(columns, base.weights, base.means, base.variances), list(covariates), gamma)
        before, kept, move = -np.inf, now, np.zeros((k - 1, p))
        for _ in range(most):
            v = passed(now)
            ll = float(v[-1])
            if ll < before - 1e-9 * abs(before) and np.abs(move).max(initial=0.0) > 1e-12:
                move = move / 2  # back to the last parameters' emissions with half the logit's step
                now = replace(now, coefficients=kept.coefficients + move)
                continue
            now.log_likelihood = ll
            if ll - before <= tol * stats["n"]:
                now.converged = True
                break
            before, kept = ll, now
            n, s, ss = v[:k], v[k : k + k * f].reshape(k, f), v[k + k * f : k + k * f + k * nc].reshape(k, nc)
            at = k + k * f + k * nc
            gradient, curve = v[at : at + q] - RIDGE * now.coefficients.ravel(), v[at + q : -1]
            if q:
                h = curve.reshape(k - 1, p, k - 1, p).reshape(q, q) + RIDGE * np.eye(q)
                move = np.linalg.solve(h, gradient).reshape(k - 1, p)
                move *= min(1.0, 5 / max(np.abs(move).max(), 1e-300))
            safe = np.maximum(n, TINY)[:, None]
            means = s / safe
            measured = Mixture(columns, n / max(n.sum(), TINY), means, np.maximum(ss / safe - means[:, :nc] ** 2, least), ll)
            now = Structural(measured, list(covariates), now.coefficients + move)
        scale = np.concatenate([[1.0], 1 / sd])
        coef = now.coefficients * scale
        coef[:, 0] -= coef[:, 1:] @ mean
        return replace(now, coefficients=coef)
    finally:
        rows.unpersist()


def assign(df: DataFrame, key: str, model: Structural) -> DataFrame:
    """key, label, responsibilities and log_likelihood of each row that has all columns and covariates."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            r, ll = model.posterior(_matrix(b, model.measured.columns), _covariates(b, model.covariates))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(r.argmax(1), pa.int32()), pa.array(list(r)), pa.array(ll)], [key, "label", "responsibilities", "log_likelihood"])

    return _rows(df, key, model.measured.columns, model.covariates).mapInArrow(run, f"{key} {kind}, label int, responsibilities array<double>, log_likelihood double")
