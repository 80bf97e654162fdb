"""Localisation schemes along an axis, and the decision of a sweep over their places."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.stats import bh_reject
from terrane.operators import drift as D
from terrane.operators import strata as S
from terrane.operators.draws import dealt_sums


@dataclass(frozen=True)
class Scheme:
    """kind: `max-equal` (size: floor), `quantile` (size: bins) or `kernel` (size: points, bandwidth)."""

    kind: str
    size: int
    bandwidth: float = 0.0


def parse_scheme(spec: str) -> Scheme:
    """hardbins:max-equal:N, hardbins:quantile:q or kernel:h:n."""
    if m := re.fullmatch(r"hardbins:(max-equal|quantile):(\d+)", spec):
        return Scheme(m[1], int(m[2]))
    if m := re.fullmatch(r"kernel:(\d+(?:\.\d+)?):(\d+)", spec):
        return Scheme("kernel", int(m[2]), float(m[1]))
    raise ValueError(f"no scheme: {spec}")


def localise(df: DataFrame, axis: str, scheme: Scheme) -> DataFrame:
    """df once for each place a row has weight at: place (from 0) and weight."""
    if scheme.kind == "kernel":
        focals = S.focal_grid(df, axis, scheme.size)
        at = S.at_focals(df, focals).withColumn("weight", S.gaussian_weight(F.col(axis), F.col("focal"), scheme.bandwidth))
        return at.where("weight > 1e-4").withColumnRenamed("position", "place").drop("focal")
    edges = S.quantile_edges(df, axis, scheme.size) if scheme.kind == "quantile" else S.max_equal_edges(df, axis, scheme.size)
    return df.withColumn("place", S.bin_of(F.col(axis), edges)).where("place is not null").withColumn("weight", F.lit(1.0))


def sweep(long: DataFrame, axis: str, key: str, scheme: Scheme, n_perm: int = 999, seed: int = 0) -> DataFrame:
    """Per place and class: drift from the class's mean, its null, p, and whether it is rejected.

    Null draws deal the axis's places anew by a hash of (key, draw): a row's place becomes that of
    a hashed position in the places' shares. Tasks add up their rows by (draw, place, class,
    feature), so that no row is repeated for a draw. The least p is 1 / (1 + n_perm): of m tests,
    one alone can be rejected if that is at most q / m.
    """
    rows = localise(long, axis, scheme)
    shares = rows.groupBy("place").agg(F.sum("weight").alias("w")).orderBy("place").collect()  # a row for each place
    total, run, cuts = sum(r["w"] for r in shares), 0.0, []
    for r in shares[:-1]:
        run += r["w"] / total
        cuts.append((r["place"], run))
    places, ends = [r["place"] for r in shares], np.array([end for _, end in cuts])
    hashed = rows.withColumns({"weight": F.col("weight").cast("double"), "_hash": F.xxhash64(F.col(key), F.lit(seed))})
    dealt = dealt_sums(hashed, ["class", "feature"], "_hash", "value", "weight", ends, places, n_perm, dict(rows.dtypes)["place"])
    seen = rows.where(F.col("value").isNotNull()).groupBy("place", "class", "feature").agg(F.sum(F.col("weight") * F.col("value")).alias("s"), F.sum("weight").alias("w")).withColumn("draw", F.lit(0))
    means = dealt.unionByName(seen).select("draw", "place", "class", "feature", (F.col("s") / F.col("w")).alias("m"))
    whole = long.groupBy("class", "feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    z = means.join(whole, ["class", "feature"]).withColumn("z", (F.col("m") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")))
    dist = z.groupBy("draw", "place", "class").agg(F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("d"))
    seen = dist.where("draw = 0").select("place", "class", F.col("d").alias("value"))
    null = dist.where("draw > 0").select("place", "class", F.col("d").alias("draw"))
    return bh_reject(D.read_against_null(seen, null, ["place", "class"]), "p_value")
