"""Drift of classes: centroids, distances, decompositions, and reading against a null."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def centroids(long: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Means and population sds of each feature, weighted or not."""
    w = weight if weight is not None else F.lit(1.0)
    x = F.col("value")
    g = long.groupBy(*by, "feature").agg(F.sum(w * x).alias("s"), F.sum(w * x * x).alias("ss"), F.sum(F.when(x.isNotNull(), w)).alias("w"))
    mean = F.when(F.col("w") > 1e-9, F.col("s") / F.col("w"))
    return g.select(*by, "feature", "w", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("w") - mean * mean)).alias("sd"))


def pooled_sd(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(F.stddev_samp("value").alias("pooled"))


def displacements(a: DataFrame, b: DataFrame, on: list[str], sd: DataFrame) -> DataFrame:
    """Differences of two sets of centroids in pooled sds; a feature without spread is missing."""
    j = a.select(*on, "feature", F.col("mean").alias("x")).join(b.select(*on, "feature", F.col("mean").alias("y")), [*on, "feature"]).join(sd, "feature")
    return j.select(*on, "feature", ((F.col("x") - F.col("y")) / F.when(F.col("pooled") > 0, F.col("pooled"))).alias("z"))


def distances(z: DataFrame, by: list[str]) -> DataFrame:
    """The three diagonal distances of standardised displacements."""
    return z.groupBy(*by).agg(F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("rms"), F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("full"), F.avg(F.abs("z")).alias("mean_abs"))


def class_separation(means: DataFrame, by: str, sd: DataFrame) -> DataFrame:
    """The mean distance over unordered pairs of classes, full and averaged norm: one row."""
    a, b = means.alias("a"), means.alias("b")
    j = a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col(f"a.{by}") < F.col(f"b.{by}"))).select(F.col("a.feature").alias("feature"), F.col(f"a.{by}").alias("ka"), F.col(f"b.{by}").alias("kb"), (F.col("a.mean") - F.col("b.mean")).alias("d"))
    z = j.join(sd, "feature").select("ka", "kb", (F.col("d") / F.when(F.col("pooled") > 0, F.col("pooled"))).alias("z"))
    return distances(z, ["ka", "kb"]).agg(F.avg("full").alias("full"), F.avg("rms").alias("rms"))


def category_totals(z: DataFrame, by: list[str], category: Column) -> DataFrame:
    """Squared displacements per category and their share of the class's."""
    g = z.withColumn("category", category).groupBy(*by, "category").agg(F.sum(F.col("z") * F.col("z")).alias("total"), F.count("z").alias("n_features"))
    whole = g.groupBy(*by).agg(F.sum("total").alias("_all"))
    return g.join(whole, by).select(*by, "category", "n_features", "total", F.when(F.col("_all") > 0, F.col("total") / F.col("_all")).alias("share"), F.sqrt(F.col("total") / F.col("n_features")).alias("rms"))


def read_against_null(observed: DataFrame, null: DataFrame, by: list[str]) -> DataFrame:
    """observed (by, value) against null draws (by, draw): p95, exceeds, add-one p, n_null."""
    j = observed.join(null, by, "left")
    g = j.groupBy(*by, "value").agg(F.percentile("draw", F.lit(0.95)).alias("null_p95"), F.count_if(F.col("draw") >= F.col("value")).alias("_ge"), F.count("draw").alias("n_null"))
    return g.select(*by, "value", "null_p95", (F.col("value") > F.col("null_p95")).alias("exceeds_p95"), ((1 + F.col("_ge")) / (1 + F.col("n_null"))).alias("p_value"), "n_null")


def slopes(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope, intercept and R squared of each group with two points at least."""
    g = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 2")


def residualise(df: DataFrame, y: str, x: str, name: str) -> DataFrame:
    """df with the residual of y on [1, x]; the two coefficients come from one aggregate."""
    fit = df.agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))  # one row
    return df.crossJoin(F.broadcast(fit)).withColumn(name, F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b")


def residualise_block(df: DataFrame, columns: list[str], covariates: list[str]) -> DataFrame:
    """df with a residual of each column (name and `_residual`) on an intercept and all covariates together.

    The normal equations of all columns come from one aggregate of the rows that have every covariate
    and the column, centred first so that far values don't swamp them. A covariate that others explain
    wholly adds nothing (least norm). A row that lacks a covariate or the column has no residual.
    """
    there = reduce(lambda a, c: a & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), covariates, F.lit(True))
    own = {y: there & F.col(y).isNotNull() for y in columns}
    x = {c: F.col(c).cast("double") for c in [*columns, *covariates]}
    means = df.agg(*(F.avg(F.when(own[y], x[c])).alias(f"{i}_{j}") for i, y in enumerate(columns) for j, c in enumerate([y, *covariates]))).first()
    p = len(covariates)
    centred = {(i, j): F.when(own[y], x[c] - F.lit(means[f"{i}_{j}"] or 0.0)) for i, y in enumerate(columns) for j, c in enumerate([y, *covariates])}
    sums = df.agg(*(F.sum(centred[i, j] * centred[i, k]).alias(f"{i}_{j}_{k}") for i in range(len(columns)) for j in range(1, p + 1) for k in [0, *range(j, p + 1)])).first()
    out = df
    for i, y in enumerate(columns):
        a, b = np.zeros((p, p)), np.zeros(p)
        for j in range(1, p + 1):
            b[j - 1] = sums[f"{i}_{j}_0"] or 0.0
            for k in range(j, p + 1):
                a[j - 1, k - 1] = a[k - 1, j - 1] = sums[f"{i}_{j}_{k}"] or 0.0
        scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
        coef = np.linalg.pinv(a / scale / scale[:, None], rcond=1e-10) @ (b / scale) / scale
        out = out.withColumn(f"{y}_residual", reduce(lambda r, jc: r - F.lit(float(jc[1])) * centred[i, jc[0]], enumerate(coef, 1), centred[i, 0]))  # noqa: B023
    return out


def pairings(strata: DataFrame, order: str, adjacent: bool = True) -> DataFrame:
    """Pairs (query, reference) of strata: each with the one before, or with all before."""
    a, b = strata.alias("a"), strata.alias("b")
    cond = F.col(f"a.{order}") == F.col(f"b.{order}") + 1 if adjacent else F.col(f"a.{order}") > F.col(f"b.{order}")
    return a.join(b, cond).select(F.col("a.stratum").alias("query"), F.col("b.stratum").alias("reference"))


def single_break(points: DataFrame, by: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """The break that two least-squares lines fit best, `least` points at least on either side.

    Sums over all points before and after each place come from two windows, so every place is tried
    in one pass over a group's points (one for each place on a grid).
    """
    w = Window.partitionBy(*by).orderBy(x)
    a, b = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(1, Window.unboundedFollowing)

    def sse(over) -> Column:
        n, sx, sy = F.count(y).over(over), F.sum(x).over(over), F.sum(y).over(over)
        sxx, sxy, syy = (F.sum(F.col(p) * F.col(q)).over(over) for p, q in ((x, x), (x, y), (y, y)))
        cxx, cxy, cyy = sxx - sx * sx / n, sxy - sx * sy / n, syy - sy * sy / n
        return F.when(cxx > 0, cyy - cxy * cxy / cxx).otherwise(cyy)

    tried = points.select(*by, x, y, F.count(y).over(a).alias("_na"), F.count(y).over(b).alias("_nb"), (sse(a) + sse(b)).alias("_sse"), F.lead(x).over(w).alias("_next"))
    good = tried.where((F.col("_na") >= least) & (F.col("_nb") >= least))
    return good.groupBy(*by).agg(F.min(F.struct("_sse", x, "_next")).alias("b")).select(*by, ((F.col(f"b.{x}") + F.col("b._next")) / 2).alias("break"), F.col("b._sse").alias("sse"))


def net_direction(z: DataFrame, by: list[str]) -> DataFrame:
    """Unit vectors of mean displacements over positions; one that is nearly none is 0."""
    mean = z.groupBy(*by, "feature").agg(F.avg("z").alias("m"))
    norm = mean.groupBy(*by).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("_norm"))
    return mean.join(norm, by).select(*by, "feature", F.when(F.col("_norm") > 1e-9, F.col("m") / F.col("_norm")).otherwise(0.0).alias("u"))


def project(z: DataFrame, directions: DataFrame, by: list[str], position: str) -> DataFrame:
    """Each position's displacement along its group's direction."""
    return z.join(directions, [*by, "feature"]).groupBy(*by, position).agg(F.sum(F.col("z") * F.col("u")).alias("along"))


def shrinkage(raw: DataFrame, conditioned: DataFrame, by: list[str]) -> DataFrame:
    """1 - conditioned / raw magnitude of each group."""
    j = raw.select(*by, F.col("full").alias("raw")).join(conditioned.select(*by, F.col("full").alias("conditioned")), by)
    return j.withColumn("shrinkage", F.when(F.col("raw") > 0, 1 - F.col("conditioned") / F.col("raw")))


def pooled_pairings(strata: DataFrame) -> DataFrame:
    """Each stratum (query) against the pooled rows."""
    return strata.select(F.col("stratum").alias("query"), F.lit("pooled").alias("reference"))


def roughness(means: DataFrame, by: list[str], position: str, sizes: DataFrame, within: DataFrame) -> DataFrame:
    """How far a class steps from stratum to stratum against what sampling alone explains.

    means: by, position, feature and z; sizes: by, position and n; within: by, feature and sd. A step's
    expected length is the root of the sum over features of sd^2 (1/n + 1/n of the next). Gives the
    mean step, the mean of those, and the mean of their ratios.
    """
    w = Window.partitionBy(*by, "feature").orderBy(position)
    steps = means.withColumn("_d", F.col("z") - F.lag("z").over(w)).where(F.col("_d").isNotNull()).groupBy(*by, position).agg(F.sqrt(F.sum(F.col("_d") * F.col("_d"))).alias("step"))
    share = sizes.select(*by, position, (1 / F.col("n") + 1 / F.lag("n").over(Window.partitionBy(*by).orderBy(position))).alias("_share"))
    noise = within.groupBy(*by).agg(F.sum(F.col("sd") * F.col("sd")).alias("_v"))
    j = steps.join(share, [*by, position]).join(noise, by).withColumn("expected", F.sqrt(F.col("_v") * F.col("_share")))
    return j.groupBy(*by).agg(F.avg("step").alias("step"), F.avg("expected").alias("sampling_noise"), F.avg(F.col("step") / F.col("expected")).alias("snr"))


def profile_alignment(a: DataFrame, b: DataFrame, by: str, value: str) -> DataFrame:
    """The correlation over classes of two profiles of magnitudes; a flat or short one gives 0: one row."""
    j = a.select(by, F.col(value).alias("_a")).join(b.select(by, F.col(value).alias("_b")), by)
    fit = j.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("_a").alias("sa"), F.stddev_pop("_b").alias("sb"), F.covar_pop("_a", "_b").alias("c"))
    return fit.select(F.when((F.col("n") >= 3) & (F.col("sa") > 1e-12) & (F.col("sb") > 1e-12), F.col("c") / (F.col("sa") * F.col("sb"))).otherwise(0.0).alias("alignment"))


def grain_contrast(z: DataFrame, by: list[str], group: Column, a: str, b: str) -> DataFrame:
    """The magnitude (RMS over features) in group a less that in group b, and each one's share of the
    squared displacement."""
    g = z.withColumn("_g", group).groupBy(*by)
    sq = F.col("z") * F.col("z")

    def of(name: str, f) -> Column:
        return f(F.when(F.col("_g") == name, sq))

    out = g.agg(F.sqrt(of(a, F.avg)).alias("rms_a"), F.sqrt(of(b, F.avg)).alias("rms_b"), of(a, F.sum).alias("_a"), of(b, F.sum).alias("_b"), F.sum(sq).alias("_all"))
    return out.select(*by, "rms_a", "rms_b", (F.col("rms_a") - F.col("rms_b")).alias("contrast"), (F.col("_a") / F.col("_all")).alias("share_a"), (F.col("_b") / F.col("_all")).alias("share_b"))


def endpoints(along: DataFrame, by: list[str], position: str) -> DataFrame:
    """First and last position, where they are along a direction, and how far the last is from the first."""
    g = along.groupBy(*by).agg(F.min_by("along", position).alias("first"), F.max_by("along", position).alias("last"))
    return g.withColumn("moved", F.col("last") - F.col("first"))


def directional_statistic(z: DataFrame, by: list[str], position: str) -> DataFrame:
    """The slope of a group's displacement along its net direction, how far it moves, and its break."""
    along = project(z, net_direction(z, by), by, position)
    out = slopes(along, by, position, "along").select(*by, "slope", "r2").join(endpoints(along, by, position), by)
    return out.join(single_break(along, by, position, "along").select(*by, "break"), by, "left")
