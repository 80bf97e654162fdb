"""How many classes: likelihood-ratio tests by parametric bootstrap, knees, and stability of fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import stats
from terrane.operators import enrichment
from terrane.operators.mixture import MOST, Columns, Mixture, assign, fit_many


def knee(ks: list[int], scores: list[float]) -> int:
    """The k where the normalised score is farthest above the diagonal, the first of equals."""
    x, y = np.array(ks, float), np.array(scores, float)
    x, y = (x - x.min()) / max(np.ptp(x), 1e-12), (y - y.min()) / max(np.ptp(y), 1e-12)
    return ks[int(np.argmax(y - x))]


def simulate(spark: SparkSession, model: Mixture, n: int, draws: int, seed: int) -> DataFrame:
    """draw, key and columns: `draws` tables of n rows from a fitted mixture, made on the executors."""
    c = model.columns
    schema = "draw int, key long, " + ", ".join(f"`{x}` double" for x in c.names)

    def make(frames):
        for f in frames:
            for at, own in f.groupby(f["id"] // n):
                rng = np.random.default_rng([seed, int(at), int(own["id"].iloc[0] % n)])
                k = rng.choice(len(model.weights), len(own), p=model.weights / model.weights.sum())
                nc, nb = len(c.continuous), len(c.binary)
                cols = {"draw": int(at), "key": own["id"].to_numpy() % n}
                for j, x in enumerate(c.continuous):
                    cols[x] = rng.normal(model.means[k, j], np.sqrt(model.variances[k, j]))
                for j, x in enumerate(c.binary, nc):
                    cols[x] = (rng.random(len(own)) < model.means[k, j]).astype(float)
                start = nc + nb
                for x, levels in c.categorical.items():
                    p = np.cumsum(np.maximum(model.means[k, start : start + levels], 0), 1)
                    cols[x] = (rng.random((len(own), 1)) * p[:, -1:] > p).sum(1).astype(float)
                    start += levels
                yield pd.DataFrame(cols)

    return spark.range(n * draws).mapInPandas(make, schema)


def likelihood_ratio(df: DataFrame, key: str, columns: Columns, k: int, n_init: int = 3, seed: int = 0, most: int = MOST) -> tuple[float, Mixture]:
    """Twice the gain in log-likelihood from k to k + 1 classes, and the fit with k."""
    fits = fit_many(df, key, columns, [*((k, -1, i) for i in range(n_init)), *((k + 1, -1, i) for i in range(n_init))], seed, most=most)
    best = max(fits[:n_init], key=lambda m: m.log_likelihood)
    return 2 * (max(m.log_likelihood for m in fits[n_init:]) - best.log_likelihood), best


def null_ratios(null: Mixture, spark: SparkSession, n: int, draws: int, n_init: int, seed: int, most: int = MOST) -> list[float]:
    """Likelihood ratios for one more class on tables of n rows drawn from a fit; all share their passes."""
    k = len(null.weights)
    made = simulate(spark, null, n, draws, seed)
    specs = [(c, d, i) for d in range(draws) for c in (k, k + 1) for i in range(n_init)]
    found: dict[tuple[int, int], float] = {}
    for (c, d, _), m in zip(specs, fit_many(made, "key", null.columns, specs, seed, most=most, by="draw"), strict=True):
        found[d, c] = max(found.get((d, c), -np.inf), m.log_likelihood)
    return [2 * (found[d, k + 1] - found[d, k]) for d in range(draws)]


def bootstrap_likelihood_ratio(df: DataFrame, key: str, columns: Columns, k: int, draws: int = 19, n_init: int = 3, seed: int = 0, most: int = MOST) -> dict[str, float]:
    """The observed ratio for k against k + 1 classes and its add-one p under the fit with k."""
    observed, null = likelihood_ratio(df, key, columns, k, n_init, seed, most)
    ratios = null_ratios(null, df.sparkSession, df.dropna(subset=columns.names).count(), draws, n_init, seed, most)
    return {"k_null": k, "k_alt": k + 1, "observed_lr": observed, "p_value": (1 + sum(r >= observed for r in ratios)) / (1 + draws), "b_used": draws}


def split(model: Mixture, at: int, rng: np.random.Generator, jitter: float = 0.1) -> Mixture:
    """A start with one class more: class `at` halved, its two parts moved apart at random."""
    nc = len(model.columns.continuous)
    move = jitter * rng.normal(size=model.means.shape[1])
    move[:nc] *= np.sqrt(model.variances[at])
    means = np.concatenate([model.means, model.means[at : at + 1] + move])
    means[at] -= move
    means[:, nc:] = np.clip(means[:, nc:], 0.01, 0.99)
    weights = np.concatenate([model.weights, [model.weights[at] / 2]])
    weights[at] /= 2
    return Mixture(model.columns, weights, means, np.concatenate([model.variances, model.variances[at : at + 1]]))


def one_class_more(df: DataFrame, key: str, model: Mixture, n_random: int = 20, seed: int = 0, jitter: float = 0.1, most: int = MOST) -> Mixture:
    """The likeliest fit with one class more, started from each class's split and from n_random rows."""
    k = len(model.weights)
    rng = np.random.default_rng(seed)
    starts = {-1 - c: split(model, c, rng, jitter) for c in range(k)}
    fits = fit_many(df, key, model.columns, [(k + 1, -1, i) for i in [*starts, *range(n_random)]], seed, most=most, starts=starts)
    return max(fits, key=lambda m: m.log_likelihood)


# Draws of a screen, draws after it, the p below which it goes on, and the p that rejects: fixed values.
SCREEN, CONFIRM, GO_ON, REJECT = 199, 999, 0.10, 0.05


def ratio_step(df: DataFrame, key: str, null: Mixture, alt: Mixture, n_init: int = 2, seed: int = 0, screen: int = SCREEN, confirm: int = CONFIRM, most: int = MOST) -> dict:
    """Tests the classes of null against alt's by bootstrap: a screen, and more draws where it is close."""
    n = df.dropna(subset=null.columns.names).count()
    observed = 2 * (alt.log_likelihood - null.log_likelihood)
    ratios = null_ratios(null, df.sparkSession, n, screen, n_init, seed, most)
    p = (1 + sum(r >= observed for r in ratios)) / (1 + len(ratios))
    if p < GO_ON and confirm > screen:
        ratios += null_ratios(null, df.sparkSession, n, confirm - screen, n_init, seed + 1, most)
        p = (1 + sum(r >= observed for r in ratios)) / (1 + len(ratios))
    return {"k_null": len(null.weights), "k_alt": len(alt.weights), "observed_lr": float(observed), "p_value": p, "b_used": len(ratios), "rejected": p <= REJECT, "converged": null.converged and alt.converged}


def sequential_search(df: DataFrame, key: str, columns: Columns, anchor: int = 4, cap: int = 7, floor: int = 2, n_init: int = 20, n_random: int = 20, seed: int = 0, most: int = MOST, **step) -> tuple[int, list[dict]]:
    """The supported number of classes and the tests made: up from the anchor while one class more
    is better; where the first isn't, down while one class less is as good."""
    fits = {anchor: max(fit_many(df, key, columns, [(anchor, -1, i) for i in range(n_init)], seed, most=most), key=lambda m: m.log_likelihood)}
    tests, k = [], anchor
    while k < cap:
        fits[k + 1] = one_class_more(df, key, fits[k], n_random, seed, most=most)
        tests.append(ratio_step(df, key, fits[k], fits[k + 1], seed=seed, most=most, **step) | {"direction": "up"})
        if not tests[-1]["rejected"]:
            break
        k += 1
    while k == anchor - sum(t["direction"] == "down" for t in tests) and k > floor:
        fits[k - 1] = max(fit_many(df, key, columns, [(k - 1, -1, i) for i in range(n_init)], seed, most=most), key=lambda m: m.log_likelihood)
        tests.append(ratio_step(df, key, fits[k - 1], fits[k], seed=seed, most=most, **step) | {"direction": "down"})
        if tests[-1]["rejected"]:
            break
        k -= 1
    return k, tests


def neighbour_tail(scores: DataFrame, k: str, log_likelihood: str) -> DataFrame:
    """The chi-square tail with one degree of freedom of twice the gain in held-out log-likelihood
    over the next smaller number of classes; scores has a row for each number of classes."""
    gain = 2 * (F.col(log_likelihood) - F.lag(log_likelihood).over(Window.orderBy(k)))  # a few rows
    return scores.withColumn("p_value", F.when(gain.isNotNull(), stats.chi2_upper(F.greatest(gain, F.lit(0.0)), F.lit(1.0))))


def adjusted_lr(spark: SparkSession, null: Mixture, alt: Mixture, n: int) -> DataFrame:
    """The adjusted Lo-Mendell-Rubin ratio of two fits and its chi-square tail: one row."""
    p0, p1 = null.free_parameters(), alt.free_parameters()
    df = p1 - p0
    lr = 2 * (alt.log_likelihood - null.log_likelihood)
    adjusted = max(0.0, lr) / (1 + 1 / (max(df, 1) * np.log(max(n, 2))))
    return spark.range(1).select(F.lit(lr).alias("lr"), F.lit(float(adjusted)).alias("adjusted_lr"), F.lit(df).alias("df"), F.lit(null.converged and alt.converged).alias("converged"), stats.chi2_upper(F.lit(float(adjusted)), F.lit(float(df))).alias("p_value"))


def stability(df: DataFrame, key: str, columns: Columns, reference: DataFrame, k: int, n_fits: int = 6, top: int = 4, seed: int = 0, most: int = MOST) -> DataFrame:
    """How far fits from other starts agree with reference labels (key, reference).

    All fits share their passes; the `top` likeliest are compared: the adjusted Rand index and the
    smallest class's share of each.
    """
    fits = fit_many(df, key, columns, [(k, -1, i) for i in range(n_fits)], seed, most=most)
    order = sorted(range(n_fits), key=lambda i: -fits[i].log_likelihood)[:top]
    out = None
    for rank, i in enumerate(order):
        labels = assign(df, key, fits[i]).select(key, "label").join(reference, key)
        ari = enrichment.adjusted_rand(enrichment.contingency(labels, "label", "reference"), "label", "reference")
        sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg((F.min("n") / F.sum("n")).alias("smallest_class_proportion"), F.count(F.lit(1)).alias("n_classes"))
        row = ari.crossJoin(sizes).select(F.lit(i).alias("start"), F.lit(rank).alias("rank"), F.lit(float(fits[i].log_likelihood)).alias("log_likelihood"), F.col("ari").alias("adjusted_rand_index"), "smallest_class_proportion", (F.col("n_classes") < k).alias("degenerate"), F.lit(fits[i].converged).alias("converged"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def subsample_stability(df: DataFrame, key: str, columns: Columns, reference: DataFrame, k: int, sizes: list[float], n_init: int = 2, seed: int = 0, most: int = MOST) -> DataFrame:
    """Agreement of fits on shares of the rows, chosen by a hash of the key, with reference labels."""
    out = None
    for s, share in enumerate(sizes):
        part = df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed + s + 1)), F.lit(10_000)) < int(share * 10_000))
        m = max(fit_many(part, key, columns, [(k, -1, i) for i in range(n_init)], seed, most=most), key=lambda f: f.log_likelihood)
        labels = assign(part, key, m).select(key, "label").join(reference, key)
        ari = enrichment.adjusted_rand(enrichment.contingency(labels, "label", "reference"), "label", "reference")
        n = labels.agg(F.count(F.lit(1)).alias("n"))
        row = n.crossJoin(ari).select(F.lit(share).alias("share"), "n", F.col("ari").alias("adjusted_rand_index"), F.lit(m.converged).alias("converged"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def isotonic(y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The nearest sequence that never falls (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, k in zip(y, np.ones(len(y)) if w is None else w, strict=True):
        blocks.append([v * k, k, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            s, k2, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + k2, blocks[-1][2] + n]
    return np.concatenate([np.full(int(n), s / k) for s, k, n in blocks]) if blocks else np.zeros(0)


def smallest_size(sizes: np.ndarray, scores: np.ndarray, benchmark: float, points: int = 200) -> float | None:
    """The least size (on a log grid) at which the isotonic curve of scores reaches the benchmark."""
    order = np.argsort(sizes)
    curve = isotonic(scores[order])
    grid = np.linspace(np.log10(sizes.min()), np.log10(sizes.max()), points)
    reached = np.interp(grid, np.log10(sizes[order]), curve) >= benchmark
    return float(10 ** grid[reached.argmax()]) if reached.any() else None
