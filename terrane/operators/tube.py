"""Paths of classes along an axis, and what bootstraps of whole families say of them.

Classes are given by frozen responsibilities, local means by Gaussian windows on an axis. One table
of draws, the displacement of each class in each window for each replicate, serves all tests: they are
aggregates over replicates, and two measures of one replicate share its families.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.stats import bh_reject
from terrane.operators import drift as D
from terrane.operators.draws import family_sums


@dataclass(frozen=True)
class Window:
    """Where local means are taken: a Gaussian of a bandwidth around a focal value of an axis."""

    axis: str
    focal: float
    bandwidth: float


def along(axis: str, focals: list[float], bandwidth: float) -> list[Window]:
    return [Window(axis, float(f), float(bandwidth)) for f in focals]


def displacement_draws(df: DataFrame, family: str, features: list[str], responsibilities: str, windows: list[Window], n_boot: int = 999, seed: int = 0) -> DataFrame:
    """rep, class, position and z (array): the means of each class in each window less its means over
    all rows, in the features' sds; rep 0 is as observed.

    A class without weight in a window has a null z there. Rows that lack a feature or an axis are left
    out, so that all windows have the same rows; a feature without spread has 0.
    """
    axes = sorted({w.axis for w in windows})
    rows = df.select(F.col(family).alias("_family"), F.col(responsibilities).alias("_r"), *(F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, *axes]))).dropna(subset=["_r", *features, *axes])
    stats = rows.agg(F.max(F.size("_r")).alias("k"), *(F.stddev_samp(f).alias(f"sd{i}") for i, f in enumerate(features)), *(F.avg(f).alias(f"m{i}") for i, f in enumerate(features))).first()
    k = stats["k"] or 0
    sd, mean = (np.array([stats[f"{n}{i}"] or 0.0 for i in range(len(features))]) for n in ("sd", "m"))
    scale = np.where(sd > 0, sd, np.inf)
    j, width = len(windows) + 1, k * (len(windows) + 1) * (len(features) + 1)

    def statistics(b: pa.RecordBatch) -> np.ndarray:
        """Responsibility x (1 and each window's weight) x (1 and each feature, standardised)."""
        x = np.stack([b.column(f).to_numpy(zero_copy_only=False) for f in features], 1)
        x = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], 1)
        w = np.stack([np.ones(len(x)), *(np.exp(-0.5 * ((b.column(o.axis).to_numpy(zero_copy_only=False) - o.focal) / o.bandwidth) ** 2) for o in windows)], 1)
        r = b.column("_r").flatten().to_numpy(zero_copy_only=False).reshape(len(x), k)
        return (r[:, :, None, None] * w[:, None, :, None] * x[:, None, None, :]).reshape(len(x), width)

    def paths(batches):
        for b in batches:
            for rep, v in zip(b.column("rep").to_pylist(), b.column("sums"), strict=True):
                s = v.values.to_numpy(zero_copy_only=False).reshape(k, j, len(features) + 1)
                good = s[:, :, 0] > 1e-9
                m = s[:, :, 1:] / np.where(good, s[:, :, 0], 1.0)[:, :, None]
                z = m[:, 1:] - m[:, :1]
                cells = [(c, p, z[c, p].tolist() if good[c, 0] and good[c, p + 1] else None) for c in range(k) for p in range(j - 1)]
                c, p, z_ = zip(*cells, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([rep] * len(cells), pa.int32()), pa.array(c, pa.int32()), pa.array(p, pa.int32()), pa.array(z_, pa.list_(pa.float64()))], ["rep", "class", "position", "z"])

    schema = "rep int, class int, position int, z array<double>"
    if not width:
        return df.sparkSession.createDataFrame([], schema)
    return family_sums(rows, "_family", ["_r", *dict.fromkeys([*features, *axes])], statistics, width, n_boot, seed).mapInArrow(paths, schema)


def magnitude(z: Column, places: list[int] | None = None) -> Column:
    """The length of a displacement, of all features or those at some places."""
    own = z if places is None else F.array(*(F.element_at(z, i + 1) for i in places))
    return F.sqrt(F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x))


def bands(values: DataFrame, by: list[str], path: str | None = None, level: float = 0.95) -> DataFrame:
    """by, value (of rep 0), its percentile interval over replicates, and a two-sided p-value for 0.

    values: rep, by, value. With path, one of by, also a band (band_low, band_high) that holds the
    whole path at once with the level: as many sds around the value as the greatest distance over the
    path of a replicate from the replicates' mean has at that level. p counts replicates on either side
    of 0, those at 0 on both; it is 1 / (1 + replicates) at least.
    """
    lo, hi = (1 - level) / 2, (1 + level) / 2
    seen = values.where("rep = 0").select(*by, "value")
    draws = values.where("rep > 0 and value is not null")
    n = F.count("value")
    tails = F.least(F.count_if(F.col("value") <= 0), F.count_if(F.col("value") >= 0))
    g = draws.groupBy(*by).agg(F.percentile("value", F.lit(lo)).alias("ci_low"), F.percentile("value", F.lit(0.5)).alias("ci_median"), F.percentile("value", F.lit(hi)).alias("ci_high"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), n.alias("n_boot"), F.greatest(F.least(2 * tails / n, F.lit(1.0)), 1 / (1 + n)).alias("p_value"))
    if path is None:
        return seen.join(g.drop("_m", "_s"), by)
    rest = [c for c in by if c != path]
    far = draws.join(g.where("_s > 0"), by).groupBy(*rest, "rep").agg(F.max(F.abs(F.col("value") - F.col("_m")) / F.col("_s")).alias("_t"))
    if rest:
        out = seen.join(g, by).join(far.groupBy(*rest).agg(F.percentile("_t", F.lit(level)).alias("_c")), rest, "left")
    else:
        out = seen.join(g, by).crossJoin(far.agg(F.percentile("_t", F.lit(level)).alias("_c")))  # one row
    reach = F.coalesce(F.col("_c") * F.col("_s"), F.lit(0.0))
    return out.withColumns({"band_low": F.col("value") - reach, "band_high": F.col("value") + reach}).drop("_m", "_s", "_c")


def tube(draws: DataFrame, scale: float = 1.0, level: float = 0.95) -> DataFrame:
    """class, position, value (the displacement's length over a scale) with its interval and band."""
    lengths = draws.select("rep", "class", "position", (magnitude(F.col("z")) / scale).alias("value"))
    return bands(lengths, ["class", "position"], "position", level).drop("p_value")  # no length is below 0


def directions(draws: DataFrame) -> DataFrame:
    """class and u (array): the unit direction of the observed path's mean displacement."""
    long = draws.where("rep = 0 and z is not null").select("class", "position", F.posexplode("z").alias("feature", "z"))
    return D.net_direction(long, ["class"]).groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "u"))), lambda x: x["u"]).alias("u"))  # a class's features


def projected(draws: DataFrame) -> DataFrame:
    """rep, class, position and along: each draw's displacement along the observed direction of its class."""
    dot = F.aggregate(F.zip_with("z", "u", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return draws.join(directions(draws), "class").select("rep", "class", "position", dot.alias("along")).where("along is not null")


def directional_inference(draws: DataFrame, focals: list[float], scale: float = 1.0, q: float = 0.05) -> DataFrame:
    """Per class and measure the value, its interval, p-value and whether it is rejected.

    Measures: `slope` of the displacement along the class's direction, which is held as observed so that
    a draw may turn round; `trend`, the slope times the path's span over the scale; `break`, where two
    lines fit best (without a test). Benjamini and Hochberg's step-up is over the classes' slopes.
    """
    places = F.array(*(F.lit(float(f)) for f in focals))
    points = projected(draws).withColumn("focal", F.element_at(places, F.col("position") + 1))
    slope = D.slopes(points, ["rep", "class"], "focal", "along").select("rep", "class", F.lit("slope").alias("measure"), F.col("slope").alias("value"))
    span = (max(focals) - min(focals)) / scale
    trend = slope.select("rep", "class", F.lit("trend").alias("measure"), (F.col("value") * span).alias("value"))
    breaks = D.single_break(points, ["rep", "class"], "focal", "along").select("rep", "class", F.lit("break").alias("measure"), F.col("break").alias("value"))
    out = bands(slope.unionByName(trend).unionByName(breaks), ["class", "measure"])
    out = out.withColumn("p_value", F.when(F.col("measure") != "break", F.col("p_value")))
    tested = bh_reject(out.where("measure = 'slope'"), "p_value", q=q).select("class", "reject")  # a row for each class
    return out.join(tested, "class", "left")


def per_feature_inference(draws: DataFrame, features: list[str], position: int, q: float = 0.05) -> DataFrame:
    """Per class and feature the displacement at a position, its interval, whether that covers 0, the
    p-value, and whether it is rejected among all classes' features."""
    names = F.array(*(F.lit(f) for f in features))
    values = draws.where((F.col("position") == position) & F.col("z").isNotNull()).select("rep", "class", F.posexplode("z").alias("i", "value"))
    out = bands(values, ["class", "i"]).withColumn("feature", F.element_at(names, F.col("i") + 1)).drop("i")
    return bh_reject(out, "p_value", q=q).withColumn("covers_zero", (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))


def alignment(a: Column, b: Column) -> Column:
    """The correlation of two arrays over the places where both have a number; of fewer than two, or
    if one is flat, 0."""
    pairs = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    n = F.size(pairs)

    def total(f) -> Column:
        return F.aggregate(F.transform(pairs, f), F.lit(0.0), lambda s, v: s + v) / n

    mx, my = total(lambda p: p["x"]), total(lambda p: p["y"])
    sx, sy = F.sqrt(F.greatest(F.lit(0.0), total(lambda p: p["x"] * p["x"]) - mx * mx)), F.sqrt(F.greatest(F.lit(0.0), total(lambda p: p["y"] * p["y"]) - my * my))
    return F.when((n >= 2) & (sx > 1e-7) & (sy > 1e-7), (total(lambda p: p["x"] * p["y"]) - mx * my) / (sx * sy)).otherwise(0.0)


def per_class_profiles(draws: DataFrame, places: list[int], name: str, scale: float = 1.0) -> DataFrame:
    """rep, position and an array of each class's displacement over some features, by class."""
    own = F.struct("class", (magnitude(F.col("z"), places) / scale).alias("v"))
    return draws.groupBy("rep", "position").agg(F.transform(F.sort_array(F.collect_list(own)), lambda x: x["v"]).alias(name))  # a row for each class


def co_drift(df: DataFrame, family: str, phenotype: list[str], block: list[str], responsibilities: str, window: Window, n_boot: int = 999, seed: int = 0) -> DataFrame:
    """Whether a block of features drifts in the same classes as the phenotype: one row.

    alignment is the correlation of the classes' magnitudes of both at the window, with its interval over
    replicates that draw the same families for both, p, aligned (the interval lies above 0), both
    profiles, and n_joint, the rows that have all features and the axis.
    """
    draws = displacement_draws(df, family, [*phenotype, *block], responsibilities, [window], n_boot, seed)
    a = per_class_profiles(draws, list(range(len(phenotype))), "phenotype_profile")
    b = per_class_profiles(draws, list(range(len(phenotype), len(phenotype) + len(block))), "block_profile")
    both = a.join(b, ["rep", "position"]).withColumn("value", alignment(F.col("phenotype_profile"), F.col("block_profile")))
    n = df.select(responsibilities, *phenotype, *block, window.axis).dropna().agg(F.count(F.lit(1)).alias("n_joint"))
    out = bands(both, ["position"]).join(both.where("rep = 0").select("position", "phenotype_profile", "block_profile"), "position").crossJoin(n)  # one row
    return out.select(F.col("value").alias("alignment"), "ci_low", "ci_high", "p_value", (F.col("ci_low") > 0).alias("aligned"), "phenotype_profile", "block_profile", "n_joint", "n_boot")


def control_specificity(df: DataFrame, family: str, features: list[str], responsibilities: str, axis: Window, control: Window, scale: float = 1.0, n_boot: int = 999, seed: int = 0) -> DataFrame:
    """Whether the classes' mean displacement at an axis's window is greater than at a control's: one
    row with both magnitudes, their difference, its interval, and the p-values, two-sided and of greater.
    """
    draws = displacement_draws(df, family, features, responsibilities, [axis, control], n_boot, seed)
    each = draws.groupBy("rep").agg(*((F.avg(F.when(F.col("position") == i, magnitude(F.col("z")))) / scale).alias(n) for i, n in enumerate(("axis_magnitude", "control_magnitude"))))
    values = each.withColumn("value", F.col("axis_magnitude") - F.col("control_magnitude")).withColumn("one", F.lit(1))
    greater = values.where("rep > 0").groupBy("one").agg(F.greatest(F.avg((F.col("value") <= 0).cast("double")), 1 / (1 + F.count(F.lit(1)))).alias("p_value_greater"))
    out = bands(values, ["one"]).join(greater, "one").join(values.where("rep = 0").select("one", "axis_magnitude", "control_magnitude"), "one")
    return out.select("axis_magnitude", "control_magnitude", F.col("value").alias("difference"), "ci_low", "ci_high", "p_value", "p_value_greater", "n_boot")


def order_test(path: DataFrame, by: list[str], position: str, z: str, n_shuffle: int = 999, seed: int = 0) -> DataFrame:
    """Whether a path moves with its order: net, null_p95, p_value and significant of each of by.

    net is the distance between the mean displacements of the first and the last third of the positions
    (two at least); the null shuffles their order, by hashes of (by, position, draw). Only the path, a
    row for each position, is repeated for the draws.
    """
    own = path.where(F.col(z).isNotNull()).select(*by, F.col(position).alias("_p"), F.col(z).alias("_z"))
    draws = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_shuffle))).alias("draw"))
    order = F.when(F.col("draw") == 0, F.struct(F.lit(0).cast("long").alias("h"), F.col("_p").cast("double").alias("p"))).otherwise(F.struct(F.xxhash64(*by, "_p", "draw", F.lit(seed)).alias("h"), F.col("_p").cast("double").alias("p")))
    lists = draws.groupBy(*by, "draw").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "_z"))).alias("s"))  # a path's positions
    k = F.greatest(F.lit(2), F.floor(F.size("s") / 3)).cast("int")
    size = F.size(F.element_at("s", 1)["_z"])

    def mean(part: Column, i: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + F.element_at(x["_z"], i)) / F.size(part)

    first, last = F.slice("s", F.lit(1), k), F.slice("s", F.size("s") - k + 1, k)
    net = F.sqrt(F.aggregate(F.sequence(F.lit(1), size), F.lit(0.0), lambda a, i: a + F.pow(mean(first, i) - mean(last, i), 2)))
    nets = lists.where(F.size("s") >= 2).select(*by, "draw", net.alias("net"))
    seen = nets.where("draw = 0").select(*by, F.col("net").alias("value"))
    read = D.read_against_null(seen, nets.where("draw > 0").select(*by, F.col("net").alias("draw")), by)
    return read.select(*by, F.col("value").alias("net"), "null_p95", "p_value", (F.col("p_value") < 0.05).alias("significant"))
