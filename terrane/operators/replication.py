"""Whether classes found in one table come back in another: projection, a null over labels, a bootstrap;
and which of named classes the classes are.

Labels dealt anew and rows drawn again change only sums by (draw, class, feature), which tasks add up
for all draws in one pass; enrichment and signatures of all draws are then aggregates over those sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import stats
from terrane.operators import enrichment as E
from terrane.operators import mixture as M
from terrane.operators.draws import dealt_sums, drawn_sums

# Categories, and the published signatures of the named classes over them.
CATEGORIES = ["anxiety/mood", "attention", "disruptive behavior", "self-injury", "social/communication", "restricted/repetitive", "developmental"]
NAMED = {
    "Broadly affected": [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0],
    "Mixed ASD with DD": [-0.90, -0.45, -0.65, -0.10, 0.10, 0.05, 0.45],
    "Social/behavioral": [1.0, 1.0, 0.95, 0.50, 0.50, 0.45, -0.90],
    "Moderate challenges": [-0.90, -0.95, -1.0, -0.95, -1.0, -1.0, -1.0],
}
FLAT = 0.05  # a named profile with less spread has no correlation


def _correlation(x: str, y: str, least: float) -> Column:
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx >= least) & (sy >= least), F.covar_pop(x, y) / (sx * sy))


def correlations(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, category (null: all) and r of two signatures (class, category, value); a flat profile has none."""
    by = by or []
    j = a.select(*by, "class", "category", F.col("value").alias("_x")).join(b.select("class", "category", F.col("value").alias("_y")), ["class", "category"])
    return j.groupBy(*by).agg(_correlation("_x", "_y", 1e-9).alias("r")).select(*by, F.lit(None).cast("string").alias("category"), "r").unionByName(j.groupBy(*by, "category").agg(_correlation("_x", "_y", 1e-9).alias("r")))


def _squares(long: DataFrame) -> DataFrame:
    """feature, class, hash, and the row's part of n, s and ss."""
    x = F.col("value").cast("double")
    return long.where(F.col("value").isNotNull()).select("feature", "class", "_hash", F.lit(1.0).alias("n"), x.alias("s"), (x * x).alias("ss"))


def signature_draws(sums: DataFrame, binary: DataFrame, by: str, categories: DataFrame, keep: DataFrame, reverse: list[str] | None = None) -> DataFrame:
    """by, class, category and value of the signatures that sums (by, feature, class, n, s, ss) give."""
    enriched = E.enrichment_of(E.moments_of(sums.where("n > 0"), binary, [by]), [by])
    return E.signature(enriched.join(keep, "feature", "left_semi"), categories, reverse, [by])


def label_null(long: DataFrame, categories: DataFrame, keep: DataFrame, target: DataFrame, n_perm: int = 199, seed: int = 0, reverse: list[str] | None = None) -> DataFrame:
    """draw, category and r when the rows' classes are dealt anew, in their shares, by a hash of the id."""
    shares = long.select("id", "class").distinct().groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy("class").collect()  # a row for each class
    n = np.array([r["n"] for r in shares], float)
    rows = _squares(long.withColumn("_hash", F.xxhash64("id", F.lit(seed)))).withColumn("one", F.lit(1.0))
    parts = rows.select("feature", "_hash", "one", F.inline(F.array(*(F.struct(F.lit(c).alias("moment"), F.col(c).alias("value")) for c in ("s", "ss")))))
    dealt = dealt_sums(parts, ["feature", "moment"], "_hash", "value", "one", (np.cumsum(n) / n.sum())[:-1], [r["class"] for r in shares], n_perm, dict(long.dtypes)["class"])
    sums = dealt.groupBy("draw", F.col("place").alias("class"), "feature").agg(F.max("w").alias("n"), *(F.sum(F.when(F.col("moment") == c, F.col("s"))).alias(c) for c in ("s", "ss")))
    return correlations(signature_draws(sums, E.binary_features(long), "draw", categories, keep, reverse), target, ["draw"])


def correlation_bootstrap(long: DataFrame, categories: DataFrame, keep: DataFrame, target: DataFrame, n_boot: int = 199, seed: int = 0, level: float = 0.95, reverse: list[str] | None = None) -> DataFrame:
    """category (null: all), ci_low, ci_median, ci_high and n_valid of the correlation with a fixed
    signature when rows are drawn again (Poisson numbers by a hash of the id), their classes held."""
    rows = _squares(long.withColumn("_hash", F.xxhash64("id", F.lit(seed))))
    sums = drawn_sums(rows, ["feature", "class"], "_hash", ["n", "s", "ss"], n_boot)
    draws = correlations(signature_draws(sums, E.binary_features(long), "rep", categories, keep, reverse), target, ["rep"])
    cut = [F.percentile("r", F.lit(p)).alias(n) for n, p in (("ci_low", (1 - level) / 2), ("ci_median", 0.5), ("ci_high", (1 + level) / 2))]
    return draws.groupBy("category").agg(*cut, F.count("r").alias("n_valid"))


def long_of(df: DataFrame, key: str, columns: M.Columns, model: M.Mixture) -> DataFrame:
    """id, class, feature and value of the complete rows, with the classes that the model gives them."""
    labels = M.assign(df, key, model).select(key, F.col("label").alias("class"))
    return stats.long_form(df, [key], columns.names).where("value is not null").join(labels, key).withColumnRenamed(key, "id")


def replicate(first: DataFrame, second: DataFrame, key: str, columns: M.Columns, categories: DataFrame, k: int = 4, n_init: int = 20, n_perm: int = 199, n_boot: int = 199, seed: int = 0, reverse: list[str] | None = None) -> DataFrame:
    """A mixture fitted on the first table, given to the second as it is, and how alike its classes'
    signatures are there: category (null: all), r, null_p95, p_value, n_null, ci_low, ci_median, ci_high, n_valid,
    n_first, n_second and converged.

    Columns that the second lacks are left out of the fit. The features that tell classes apart are those
    of the first table. p counts label dealings whose r is no less, of the n_null whose signature isn't flat;
    it is null where r is.
    """
    there = set(second.columns) & set(first.columns)
    shared = M.Columns([c for c in columns.continuous if c in there], [c for c in columns.binary if c in there], {c: n for c, n in columns.categorical.items() if c in there})
    model = M.fit(first, key, shared, k, n_init, seed)
    a, b = (long_of(df, key, shared, model).cache() for df in (first, second))
    enriched = E.enrichment(a)
    keep = E.contributory(enriched).cache()
    target = E.signature(enriched.join(keep, "feature", "left_semi"), categories, reverse).cache()
    seen = correlations(E.signature(E.enrichment(b).join(keep, "feature", "left_semi"), categories, reverse), target)
    null = label_null(b, categories, keep, target, n_perm, seed, reverse).where("r is not null").select(F.coalesce("category", F.lit("")).alias("_c"), F.col("r").alias("_r"))
    boot = correlation_bootstrap(b, categories, keep, target, n_boot, seed, reverse=reverse)
    at = seen.withColumn("_c", F.coalesce("category", F.lit("")))
    read = at.join(null, "_c", "left").groupBy("_c", "category", "r").agg(F.percentile("_r", F.lit(0.95)).alias("null_p95"), F.when(F.col("r").isNotNull(), stats.add_one(F.count_if(F.col("_r") >= F.col("r")), F.count("_r"))).alias("p_value"), F.count("_r").alias("n_null"))
    sizes = [df.select("id").distinct().agg(F.count(F.lit(1)).alias(n)) for df, n in ((a, "n_first"), (b, "n_second"))]
    out = read.join(boot.withColumn("_c", F.coalesce("category", F.lit(""))).drop("category"), "_c", "left").drop("_c")
    return out.crossJoin(sizes[0]).crossJoin(sizes[1]).withColumn("converged", F.lit(model.converged))  # one row each


def named_signature(df: DataFrame) -> DataFrame:
    """name, category and value of the named classes: their published signatures."""
    rows = [(n, c, v) for n, values in NAMED.items() for c, v in zip(CATEGORIES, values, strict=True)]
    return df.sparkSession.createDataFrame(rows, "name string, category string, value double")


def by_anchors(signature: dict, sizes: dict) -> dict:
    """Names of four classes (class: values by category; class: size): the one with the greatest mean
    is broadly affected; of the others the most developmental one is mixed, then the largest social. Of
    equals the smaller class comes first."""
    if len(signature) != len(NAMED):
        raise ValueError(f"{len(NAMED)} classes have names, not {len(signature)}")
    left, out = sorted(signature), {}
    for name, worth in (
        ("Broadly affected", lambda c: float(np.mean(list(signature[c].values())))),
        ("Mixed ASD with DD", lambda c: signature[c]["developmental"]),
        ("Social/behavioral", lambda c: sizes[c]),
    ):
        best = max(left, key=worth)
        out[best] = name
        left.remove(best)
    return out | {left[0]: "Moderate challenges"}


def anchors_hold(signature: dict, sizes: dict, names: dict) -> dict[str, bool]:
    """Whether what else is known of the named classes is true of those that got the names."""
    of = {n: c for c, n in names.items()}
    mean = {c: float(np.mean(list(v.values()))) for c, v in signature.items()}
    order = sorted(signature)
    return {
        "broadly_affected_highest_overall": of["Broadly affected"] == max(order, key=mean.get),
        "broadly_affected_smallest": of["Broadly affected"] == min(order, key=sizes.get),
        "social_behavioral_largest": of["Social/behavioral"] == max(order, key=sizes.get),
        "moderate_challenges_lowest_overall": of["Moderate challenges"] == min(order, key=mean.get),
    }


def align_to_named(signature: DataFrame, sizes: DataFrame, strict: bool = False) -> DataFrame:
    """class, name, correlation (with the name's published profile; null if one is nearly flat),
    overall_correlation (of all classes and categories), the four anchors and anchors_hold.

    signature: class, category, value of four classes; sizes: class, n. strict refuses anchors that clash.
    """
    held: dict = {}
    for r in signature.select("class", "category", "value").collect():  # classes by categories
        held.setdefault(r["class"], {})[r["category"]] = r["value"]
    if any(set(v) != set(CATEGORIES) for v in held.values()):
        raise ValueError("each class needs a value of each category")
    counts = {r["class"]: r["n"] for r in sizes.select("class", "n").collect()}
    names = by_anchors(held, counts)
    checks = anchors_hold(held, counts, names)
    if strict and not all(checks.values()):
        raise ValueError("anchors clash: " + ", ".join(c for c, good in checks.items() if not good))
    kind = dict(signature.dtypes)["class"]
    named = signature.sparkSession.createDataFrame(list(names.items()), f"class {kind}, name string")
    j = signature.join(named, "class").select("class", "name", "category", F.col("value").alias("_x")).join(named_signature(signature).select("name", "category", F.col("value").alias("_y")), ["name", "category"])
    out = j.groupBy("class", "name").agg(_correlation("_x", "_y", FLAT).alias("correlation")).crossJoin(j.agg(_correlation("_x", "_y", FLAT).alias("overall_correlation")))  # one row
    return out.withColumns({c: F.lit(good) for c, good in checks.items()} | {"anchors_hold": F.lit(all(checks.values()))})
