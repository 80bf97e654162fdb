"""Inference over families and axes: cluster bootstrap, prevalence slopes, score-based invariance."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from terrane.functions.stats import chi2_upper, running_total
from terrane.operators.draws import dealt_sums, drawn_sums


def family_bootstrap(long: DataFrame, family: str, by: list[str], n_boot: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile intervals of means (by, value) when whole families are drawn again.

    Families' sums are aggregated first. A replicate weighs each family by a Poisson(1) number of a
    seeded hash; tasks add up their families for all replicates. by are columns with few values.
    """
    sums = long.where(F.col("value").isNotNull()).groupBy(*by, family).agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    means = drawn_sums(sums.withColumn("_hash", F.xxhash64(F.col(family), F.lit(seed))), by, "_hash", ["s", "n"], n_boot).select("rep", *by, (F.col("s") / F.when(F.col("n") > 0, F.col("n"))).alias("draw"))
    lo, hi = (1 - level) / 2, (1 + level) / 2
    bands = means.groupBy(*by).agg(F.percentile("draw", F.lit(lo)).alias("ci_low"), F.percentile("draw", F.lit(hi)).alias("ci_high"), F.count("draw").alias("n_boot"))
    return sums.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("estimate")).join(bands, by)


def permutation_null(long: DataFrame, key: str, share: float, n_perm: int = 999, seed: int = 0) -> DataFrame:
    """Null draws of a stratum's displacement per class: rows in the stratum by a hash of key and draw.

    long has key, class, feature and value; a draw is the RMS over features of the stratum's mean
    less the class's, in the class's sds. Tasks add up their rows by draw; no row is repeated.
    """
    rows = long.where(F.col("value").isNotNull()).select("class", "feature", F.col("value").cast("double").alias("value"), F.lit(1.0).alias("one"), F.xxhash64(F.col(key), F.lit(seed)).alias("_hash"))
    inside = dealt_sums(rows, ["class", "feature"], "_hash", "value", "one", np.array([share]), [1, 0], n_perm).where("place = 1")
    whole = long.groupBy("class", "feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    z = (F.col("s") / F.col("w") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd"))
    return inside.join(whole, ["class", "feature"]).groupBy(F.col("draw").alias("perm"), "class").agg(F.sqrt(F.avg(z * z)).alias("draw"))


def multinomial(df: DataFrame, design: list[str], targets: str, classes: int, ridge: float = 1e-3, most: int = 25, tol: float = 1e-8) -> np.ndarray:
    """Coefficients (classes - 1) x (1 + design) of a multinomial logit on soft targets, class 0 first.

    Newton's steps: each pass sums the gradient and the Hessian over the rows.
    """
    p = len(design) + 1
    coef = np.zeros((classes - 1, p))
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in design), targets).dropna().cache()
    try:
        for _ in range(most):
            here = coef.copy()

            def sums(batches, here=here):
                total = None
                for b in batches:
                    x = np.stack([np.ones(b.num_rows), *(b.column(c).to_numpy(zero_copy_only=False) for c in design)], 1)
                    y = np.stack(b.column(targets).to_pandas().to_numpy()) if b.num_rows else np.zeros((0, classes))
                    eta = np.concatenate([np.zeros((len(x), 1)), x @ here.T], 1)
                    e = np.exp(eta - eta.max(1, keepdims=True))
                    q = e / e.sum(1, keepdims=True)
                    g = ((y - q * y.sum(1, keepdims=True))[:, 1:].T @ x).ravel()
                    r = q[:, 1:]
                    w = np.einsum("nk,kl->nkl", r, np.eye(classes - 1)) - np.einsum("nk,nl->nkl", r, r)
                    h = np.einsum("nkl,ni,nj->kilj", w * y.sum(1)[:, None, None], x, x).ravel()
                    part = np.concatenate([g, h])
                    total = part if total is None else total + part
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

            got = rows.mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
            v = np.array([r["v"] for r in got])
            d = (classes - 1) * p
            penalty = ridge * np.ones(d)
            step = np.linalg.solve(v[d:].reshape(d, d) + np.diag(penalty), v[:d] - penalty * coef.ravel())
            coef = coef + step.reshape(coef.shape)
            if np.abs(step).max() < tol:
                break
        return coef
    finally:
        rows.unpersist()


def bridge_draws(steps: np.ndarray, n_sim: int, seed: int) -> np.ndarray:
    """Maxima over the grid of simulated squared Brownian bridges (steps: shares of the sample)."""
    rng = np.random.default_rng(seed)
    t = np.cumsum(steps)[:-1]
    w = np.cumsum(rng.normal(size=(n_sim, len(steps))) * np.sqrt(steps), 1)
    bridge = w[:, :-1] - t * w[:, -1:]
    return (bridge**2).max(1)


def invariance(long: DataFrame, axis: str, bins: DataFrame, n_sim: int = 500, seed: int = 0) -> DataFrame:
    """Per class and feature: the greatest squared fluctuation of the scores along an axis, and p.

    long has class, feature, value and the axis; bins gives each axis value its place on a grid of a
    few hundred points at most. Scores are summed per class, feature and grid point; one task then
    sees one class's feature's grid, whose size the data don't change.
    """
    mean = long.groupBy("class", "feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.count(F.lit(1)).alias("_n"))
    grid = long.join(bins, axis).groupBy("class", "feature", "grid").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("k"))
    scores = grid.join(mean.where("_s > 0"), ["class", "feature"]).select("class", "feature", "grid", "k", "_n", ((F.col("s") - F.col("k") * F.col("_m")) / F.col("_s")).alias("score"))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("grid")
        n = float(pdf["_n"].iloc[0])
        process = np.cumsum(pdf["score"].to_numpy()) / np.sqrt(n)
        shares = pdf["k"].to_numpy() / n
        if len(pdf) < 3:
            return pd.DataFrame(columns=["class", "feature", "statistic", "p_value", "at"])
        top = int((process[:-1] ** 2).argmax())
        null = bridge_draws(shares, n_sim, seed)
        stat = float(process[top] ** 2)
        return pd.DataFrame({"class": [pdf["class"].iloc[0]], "feature": [pdf["feature"].iloc[0]], "statistic": [stat], "p_value": [(1 + int((null >= stat).sum())) / (1 + n_sim)], "at": [int(pdf["grid"].iloc[top])]})

    kinds = dict(long.dtypes)
    return scores.groupBy("class", "feature").applyInPandas(test, f"class {kinds['class']}, feature {kinds['feature']}, statistic double, p_value double, at long")


def bch_confusion(posterior: DataFrame, responsibilities: str) -> DataFrame:
    """P(assigned s | true c) of modal assignment: true, assigned and probability."""
    r = posterior.select(F.posexplode(responsibilities).alias("true", "r"), (F.array_position(F.col(responsibilities), F.array_max(responsibilities)) - 1).cast("int").alias("assigned"))
    g = r.groupBy("true", "assigned").agg(F.sum("r").alias("s"))
    whole = g.groupBy("true").agg(F.sum("s").alias("n"))
    return g.join(whole, "true").select("true", "assigned", (F.col("s") / F.col("n")).alias("probability"))


def corrected_multinomial(df: DataFrame, design: list[str], responsibilities: str, classes: int, rounds: int = 10) -> np.ndarray:
    """A multinomial logit of true classes when only modal assignments with known error are seen.

    EM: the expected true class of a row, given its assignment and the current model, is the soft
    target of the next fit. The confusion (classes by classes) stays fixed.
    """
    d = np.zeros((classes, classes))
    for r in bch_confusion(df, responsibilities).collect():  # classes by classes
        d[r["true"], r["assigned"]] = r["probability"]
    seen = (F.array_position(F.col(responsibilities), F.array_max(responsibilities)) - 1).cast("int")
    rows = df.select(*design, seen.alias("_s"))
    coef = np.zeros((classes - 1, len(design) + 1))
    emission = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in d.T))  # by what is seen
    for _ in range(rounds):
        eta = [F.lit(0.0), *(F.lit(float(c[0])) + sum((F.lit(float(b)) * F.col(x) for b, x in zip(c[1:], design, strict=True)), F.lit(0.0)) for c in coef)]
        joint = F.array(*(F.exp(e) * F.element_at(F.element_at(emission, F.col("_s") + 1), k + 1) for k, e in enumerate(eta)))
        total = F.aggregate(joint, F.lit(0.0), lambda a, x: a + x)
        new = multinomial(rows.select(*design, F.transform(joint, lambda x: x / total).alias("_t")), design, "_t", classes)
        if np.abs(new - coef).max() < 1e-6:
            return new
        coef = new
    return coef


def two_sided(draws: DataFrame, by: list[str], draw: str) -> DataFrame:
    """A bootstrap p-value for 0: twice the smaller tail with one added, 1 at most."""
    g = draws.groupBy(*by).agg(F.count_if(F.col(draw) <= 0).alias("lo"), F.count_if(F.col(draw) >= 0).alias("hi"), F.count(draw).alias("n"))
    return g.select(*by, F.least(F.lit(1.0), 2 * (1 + F.least("lo", "hi")) / (1 + F.col("n"))).alias("p_value"))


def time_grid(df: DataFrame, axis: str, most: int = 512) -> DataFrame:
    """axis and grid (from 0): equal values share a point, and points are thinned to `most`."""
    counts = df.where(F.col(axis).isNotNull()).groupBy(axis).agg(F.count(F.lit(1)).alias("_n"))
    n = counts.agg(F.sum("_n").alias("_all"))
    totals = running_total(counts, axis, "_n", "_to").crossJoin(F.broadcast(n))  # one row
    return totals.select(axis, (F.ceil(F.col("_to") * most / F.col("_all")) - 1).cast("int").alias("grid"))


def casewise_scores(mu: Column, variance: Column, r: Column, x: Column) -> Column:
    """Score of a mean: a row's responsibility times its deviation over the class's variance."""
    return F.when(variance > 1e-12, r * (x - mu) / variance)


def invariance_by_class(long: DataFrame, n_sim: int = 500, seed: int = 0) -> DataFrame:
    """Whether classes' means drift along an axis, by whitened scores of frozen responsibilities.

    long: id, grid (place on the axis, a few hundred at most), class, r (responsibility), feature, value.
    Scores are summed by class, grid point and feature, and their products by class and two features:
    the sizes of these don't grow with the rows. Of each class's process, whitened by the inverse root
    of its scores' second moments, the greatest and the mean squared norm are held against as many
    simulated bridges of the same dimension (add-one p).
    """
    r, x = F.col("r"), F.col("value")
    means = long.groupBy("class", "feature").agg((F.sum(r * x) / F.sum(r)).alias("_mu"), (F.sum(r * x * x) / F.sum(r)).alias("_m2"))
    scored = long.join(F.broadcast(means), ["class", "feature"])  # classes by features
    scored = scored.withColumn("score", casewise_scores(F.col("_mu"), F.col("_m2") - F.col("_mu") * F.col("_mu"), r, x)).where(F.col("score").isNotNull())
    sums = scored.groupBy("class", "grid", "feature").agg(F.sum("score").alias("s")).toPandas()  # classes by grid by features
    names = sorted(sums["feature"].unique().tolist())
    place_of = {f: i for i, f in enumerate(names)}

    def outer(batches):
        total: dict = {}
        for b in batches:
            own, at = np.array(b.column("class").to_pylist(), dtype=object), b.column("v").combine_chunks() if hasattr(b.column("v"), "combine_chunks") else b.column("v")
            cells = at.flatten()
            x = np.zeros((b.num_rows, len(names)))
            row = np.repeat(np.arange(b.num_rows), np.diff(at.offsets.to_numpy()))
            x[row, [place_of[f] for f in cells.field("feature").to_pylist()]] = cells.field("score").to_numpy(zero_copy_only=False)
            for k in set(own.tolist()):
                part = x[own == k]
                total[k] = total.get(k, 0) + (part.T @ part).ravel()
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), types[0].type), pa.array(np.arange(len(v))), pa.array(v)], ["class", "i", "v"])

    kind = dict(long.dtypes)["class"]
    types = to_arrow_schema(StructType.fromDDL(f"class {kind}"))
    wide = scored.groupBy("id", "class").agg(F.collect_list(F.struct("feature", "score")).alias("v"))  # a row's features
    products = wide.mapInArrow(outer, f"class {kind}, i long, v double").groupBy("class", "i").agg(F.sum("v").alias("v")).toPandas()  # classes by features squared
    sizes = long.select("id", "grid").distinct().groupBy("grid").agg(F.count(F.lit(1)).alias("k")).orderBy("grid").toPandas()
    steps = (sizes["k"] / sizes["k"].sum()).to_numpy()
    place = {g: i for i, g in enumerate(sizes["grid"])}
    rows = []
    for label, own in sums.groupby("class"):
        process = np.zeros((len(place), len(names)))
        process[own["grid"].map(place), own["feature"].map(place_of)] = own["s"]
        opg = products[products["class"] == label].sort_values("i")["v"].to_numpy().reshape(len(names), len(names))
        values, vectors = np.linalg.eigh(opg)
        keep = values > 1e-8 * values.max()
        w = np.cumsum(process, 0) @ (vectors[:, keep] / np.sqrt(values[keep]))
        norms = (w**2).sum(1)[:-1]
        rng = np.random.default_rng(seed)
        t, total = np.cumsum(steps)[:-1], np.zeros((n_sim, len(steps) - 1))
        for _ in range(int(keep.sum())):  # a bridge for each dimension
            b = np.cumsum(rng.normal(size=(n_sim, len(steps))) * np.sqrt(steps), 1)
            total += (b[:, :-1] - t * b[:, -1:]) ** 2
        for name, stat, draws in (("max", norms.max(), total.max(1)), ("integral", (norms * steps[:-1]).sum(), (total * steps[:-1]).sum(1))):
            rows.append((label.item() if hasattr(label, "item") else label, name, float(stat), int(keep.sum()), (1 + int((draws >= stat).sum())) / (1 + n_sim), int(sizes["grid"].iloc[int(norms.argmax())])))
    return long.sparkSession.createDataFrame(rows, f"class {kind}, functional string, statistic double, rank int, p_value double, at int")


def multinomial_loglik(df: DataFrame, design: list[str], targets: str, coef: np.ndarray) -> float:
    """The sum over rows of their targets times the logs of the classes' probabilities."""
    eta = [F.lit(0.0), *(F.lit(float(c[0])) + sum(F.lit(float(b)) * F.col(x) for b, x in zip(c[1:], design, strict=True)) for c in coef)]
    z = df.select(targets, F.array(*eta).alias("z")).withColumn("top", F.array_max("z"))
    log_sum = F.col("top") + F.log(F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    terms = F.zip_with(F.col(targets), "z", lambda t, x: t * (x - log_sum))
    return z.agg(F.sum(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))).first()[0] or 0.0


def joint_lrt(df: DataFrame, design: list[str], null: list[str], targets: str, classes: int) -> tuple[float, int, float]:
    """Likelihood ratio of a multinomial logit with all of design against one with `null` alone:
    statistic, degrees of freedom, p."""
    full = multinomial_loglik(df, design, targets, multinomial(df, design, targets, classes, ridge=1e-9))
    less = multinomial_loglik(df, null, targets, multinomial(df, null, targets, classes, ridge=1e-9))
    dof = (classes - 1) * (len(design) - len(null))
    stat = max(0.0, 2 * (full - less))
    p = df.sparkSession.range(1).select(chi2_upper(F.lit(stat), F.lit(float(dof)))).first()[0]
    return stat, dof, p
