"""How classes' shares change along an axis: one-against-the-rest logits and bootstraps of families.

The logits of all classes and replicates take their Newton steps in the same passes: a task works out
its rows' probabilities for all of them at once, and sends sums of gradients and curvatures alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.stats import bh_reject, chi2_upper
from terrane.operators.draws import BLOCK, family_weights
from terrane.operators.tube import bands

RIDGE, PASSES, STEP = 1e-6, 200, 1e-8


def logits(df: DataFrame, design: list[str], targets: str, family: str | None = None, n_boot: int = 0, emission: np.ndarray | None = None, without: str | None = None, seed: int = 0, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (classes x replicates x (1 + design)), log-likelihoods and curvatures of binary logits.

    Each class's target is its place in targets, an array of numbers from 0 to 1. Replicate 0 has the rows
    as they are; the others draw families anew. With emission (classes x 2 x 2: the chance, of rows in the
    class and others, of being seen in it and out) the seen class is known with error: a row's target is
    its expected membership, by the current model, given that its target is a half at least or not; each
    pass is then a step of EM. without: a column whose coefficient stays 0. Incomplete rows are left out.
    """
    p = len(design) + 1
    own = F.xxhash64(F.col(family), F.lit(seed)) if family else F.lit(0).cast("long")
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in design), F.col(targets).alias("_t"), own.alias("_hash")).dropna(subset=[*design, "_t"]).cache()
    try:
        stats = rows.agg(F.max(F.size("_t")).alias("k"), *(f(c).alias(f"{n}{i}") for i, c in enumerate(design) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        k = stats["k"] or 0
        mean, sd = (np.array([stats[f"{n}{i}"] or 0.0 for i in range(len(design))]) for n in ("m", "s"))
        sd = np.where(sd > 0, sd, 1.0)
        fixed = [1 + design.index(without)] if without else []
        free = [i for i in range(p) if i not in fixed]
        reps, pairs = np.arange(n_boot + 1), [(i, j) for i in range(p) for j in range(i, p)]
        beta = np.zeros((k, len(reps), p))
        open_ = np.ones((k, len(reps)), bool)
        loglik, curve = np.zeros((k, len(reps))), np.zeros((k, len(reps), p, p))
        for _ in range(PASSES):
            cells, coef = np.argwhere(open_), beta[open_]
            width = 1 + p + len(pairs)

            def sums(batches, cells=cells, coef=coef):
                total, step = np.zeros((len(cells), width)), max(1, BLOCK // len(cells))
                for b in batches:
                    whole = np.concatenate([np.ones((b.num_rows, 1)), (np.stack([b.column(c).to_numpy() for c in design], 1) - mean) / sd], 1) if design else np.ones((b.num_rows, 1))
                    t, h = b.column("_t").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k), b.column("_hash").to_numpy()
                    for at in range(0, b.num_rows, step):
                        x, y = whole[at : at + step], t[at : at + step][:, cells[:, 0]]
                        w = family_weights(h[at : at + step], reps)[:, cells[:, 1]]
                        mu = 1 / (1 + np.exp(-np.clip(x @ coef.T, -500, 500)))
                        if emission is None:
                            ll = y * np.log(np.maximum(mu, 1e-300)) + (1 - y) * np.log(np.maximum(1 - mu, 1e-300))
                        else:
                            seen = (y < 0.5).astype(int)
                            e = emission[cells[:, 0]]
                            place = np.arange(len(cells))
                            into, out = mu * e[place, 0, seen], (1 - mu) * e[place, 1, seen]
                            ll, y = np.log(np.maximum(into + out, 1e-300)), into / np.maximum(into + out, 1e-300)
                        a = w * np.maximum(mu * (1 - mu), 1e-9)
                        total[:, 0] += (w * ll).sum(0)
                        total[:, 1 : p + 1] += (w * (y - mu)).T @ x
                        for n, (i, j) in enumerate(pairs):
                            total[:, p + 1 + n] += (x[:, i] * x[:, j]) @ a
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

            got = rows.mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # classes by replicates by design
            flat = np.zeros(len(cells) * width)
            flat[got.column("i").to_numpy()] = got.column("v").to_numpy()
            for (c, r), v in zip(cells, flat.reshape(len(cells), width), strict=True):
                h = np.zeros((p, p))
                for n, (i, j) in enumerate(pairs):
                    h[i, j] = h[j, i] = v[p + 1 + n]
                loglik[c, r], curve[c, r] = v[0], h
                g = v[1 : p + 1] - ridge * beta[c, r]
                move = np.linalg.solve((h + ridge * np.eye(p))[np.ix_(free, free)], g[free])
                move *= min(1.0, 10 / max(np.abs(move).max(), 1e-300))
                beta[c, r][free] += move
                open_[c, r] = np.abs(move).max() >= (STEP if emission is None else STEP * 100)
            if not open_.any():
                break
        scale = np.concatenate([[1.0], 1 / sd])
        out = beta * scale
        if design:
            out[:, :, 0] -= (out[:, :, 1:] * mean).sum(-1)
        return out, loglik, curve / (scale[:, None] * scale)[None, None]
    finally:
        rows.unpersist()


def confusion(df: DataFrame, responsibilities: str) -> np.ndarray:
    """Of each class, for rows in it and others, the chance of being seen in it (a half at least) and not."""
    cells = df.where(F.col(responsibilities).isNotNull()).select(F.posexplode(responsibilities).alias("k", "r"))
    seen = F.col("r") >= 0.5
    got = cells.groupBy("k").agg(F.sum("r").alias("n"), F.sum(F.when(seen, F.col("r")).otherwise(0.0)).alias("a"), F.sum(1 - F.col("r")).alias("m"), F.sum(F.when(seen, 1 - F.col("r")).otherwise(0.0)).alias("b")).orderBy("k").collect()  # a row for each class
    share = np.array([[r["a"] / r["n"] if r["n"] else 0.0, r["b"] / r["m"] if r["m"] else 0.0] for r in got])
    return np.clip(np.stack([share, 1 - share], 2), 1e-12, None)


def one_vs_rest(df: DataFrame, design: list[str], responsibilities: str, axis: str, family: str, n_boot: int = 199, corrected: bool = True, seed: int = 0, q: float = 0.05) -> DataFrame:
    """Per class the slope of its log-odds against the rest along an axis (one of the design's columns),
    odds_ratio, its interval and p-value over replicates of families, and reject (Benjamini and Hochberg).

    corrected allows for the error of modal assignment, which is held as observed in all replicates. Not
    corrected, rows count to the class that is likeliest, and wald_p and lrt_p test the slope, too.
    """
    names = [*design]
    if corrected:
        coef, *_ = logits(df, names, responsibilities, family, n_boot, confusion(df, responsibilities), seed=seed)
        tests = np.full((len(coef), 2), np.nan)
    else:
        first = F.array_position(F.col(responsibilities), F.array_max(responsibilities))
        hard = df.withColumn("_hard", F.transform(responsibilities, lambda r, i: F.when(i + 1 == first, 1.0).otherwise(0.0)))
        coef, ll, curve = logits(hard, names, "_hard", family, n_boot, seed=seed)
        _, less, _ = logits(hard, names, "_hard", without=axis, seed=seed)
        at = 1 + names.index(axis)
        wald = [c[0, at] ** 2 / max(np.linalg.pinv(h[0])[at, at], 1e-300) for c, h in zip(coef, curve, strict=True)]
        tests = np.stack([wald, np.maximum(0.0, 2 * (ll[:, 0] - less[:, 0]))], 1)
    slopes = coef[:, :, 1 + names.index(axis)]
    spark = df.sparkSession
    draws = spark.createDataFrame([(r, c, float(v)) for c, own in enumerate(slopes) for r, v in enumerate(own)], "rep int, class int, value double")  # classes by replicates
    stat = spark.createDataFrame([(c, *(None if np.isnan(v) else float(v) for v in t)) for c, t in enumerate(tests)], "class int, wald double, lr double")
    out = bands(draws, ["class"]).join(stat, "class")
    out = out.select("class", F.col("value").alias("slope"), F.exp("value").alias("odds_ratio"), "ci_low", "ci_high", *(F.when(F.col(c).isNotNull(), chi2_upper(F.coalesce(c, F.lit(0.0)), F.lit(1.0))).alias(n) for c, n in (("wald", "wald_p"), ("lr", "lrt_p"))), F.col("p_value").alias("boot_p"))
    return bh_reject(out, "boot_p", q=q)
