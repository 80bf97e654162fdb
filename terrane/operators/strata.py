"""Strata of an axis, local weights, and the gates that a policy of bins has to pass."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.stats import between_ranks, looked_up, quantile_ranks, quantiles, rank_totals, running_total

# Most ranks that one job looks up, about.
RANKS = 20_000


def bin_of(x: Column, edges: list[float]) -> Column:
    """Which of len(edges) + 1 bins x is in: left closed, open ends; a missing x has none."""
    out = F.lit(0)
    for e in edges:
        out = out + (x >= e).cast("int")
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), out)


def band_labels(edges: list[float]) -> list[str]:
    return [f"<{edges[0]:g}", *(f"{a:g}-{b:g}" for a, b in zip(edges, edges[1:], strict=False)), f">={edges[-1]:g}"]


def quantile_edges(df: DataFrame, column: str, q: int) -> list[float]:
    """The inner edges of q bins with equal shares, exact; equal edges count once."""
    return sorted({e for e, _ in quantiles(df, column, [i / q for i in range(1, q)])})


def max_equal_edges(df: DataFrame, column: str, floor: int) -> list[float]:
    """Edges of as many equal bins as leave at least `floor` rows in each (two at least).

    Numbers of bins are tried from the greatest down, as ties may make a greater one fail and a smaller
    one not; each job looks twice as many of them up in the running totals, which are worked out once.
    """
    totals = rank_totals(df, column).cache()
    try:
        n = totals.agg(F.max("_to")).first()[0] or 0
        q, tries = max(2, n // floor), 1
        while n and q > 1:
            block = list(range(q, max(1, q - tries), -1))
            probs = {k: [i / k for i in range(1, k)] for k in block}
            at = looked_up(totals, [r for p in probs.values() for r in quantile_ranks(n, p)])
            for k in block:
                found = dict(between_ranks(at, n, probs[k]))  # equal edges count once
                if k == 2 or np.diff([0, *(found[e] for e in sorted(found)), n]).min() >= floor:
                    return sorted(found)
            q, tries = block[-1] - 1, max(1, min(2 * tries, RANKS // q))
        return []
    finally:
        totals.unpersist()


def focal_grid(df: DataFrame, column: str, points: int, span: tuple[float, float] = (0.025, 0.975)) -> list[float]:
    (low, _), (high, _) = quantiles(df, column, list(span))
    return [float(x) for x in np.linspace(low, high, points)]


def gaussian_weight(x: Column, focal: Column, bandwidth: float) -> Column:
    """A kernel weight; a missing value weighs nothing."""
    z = (x - focal) / bandwidth
    return F.coalesce(F.exp(-0.5 * z * z), F.lit(0.0))


def at_focals(df: DataFrame, focals: list[float]) -> DataFrame:
    """df once for each focal point (a given list): focal and its number."""
    pairs = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(float(f)).alias("focal")) for i, f in enumerate(focals)))
    return df.select("*", F.inline(pairs))


def effective_n(df: DataFrame, column: str, focals: list[float], bandwidth: float) -> DataFrame:
    """The sum of weights at each focal point."""
    rows = at_focals(df.select(F.col(column).cast("double").alias("x")), focals)
    return rows.groupBy("position", "focal").agg(F.sum(gaussian_weight(F.col("x"), F.col("focal"), bandwidth)).alias("n_eff"))


def _effective(df: DataFrame, column: str, focals: list[float], widths: np.ndarray) -> np.ndarray:
    """effective_n of several bandwidths in one pass: bandwidths by focal points, added up task by task."""
    f, h = np.array(focals, float), np.array(widths, float)

    def sums(batches):
        total, step = np.zeros((len(h), len(f))), max(1, 2_000_000 // len(f))
        for b in batches:
            x = b.column("_x").to_numpy()
            for at in range(0, len(x), step):
                z = -0.5 * (x[at : at + step, None] - f) ** 2
                for i, w in enumerate(h):
                    total[i] += np.exp(z / w**2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    rows = df.select(F.col(column).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    got = rows.mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in got]).reshape(len(h), len(f)) if got else np.zeros((len(h), len(f)))


def bandwidth_for(df: DataFrame, column: str, focals: list[float], target: float, reduce=np.min, tol: float = 1e-3, tries: int = 16) -> float:
    """The least bandwidth with an effective number of `target` rows, within tol, from the rows themselves.

    Each pass over the rows tries several bandwidths: by doubling up to one that is wide enough, then
    evenly between the last two. Without rows, or with fewer than target, it is 1e9.
    """
    x = F.col(column).cast("double")
    rows = df.select(x.alias(column)).cache()
    try:
        low_x, high_x = rows.where(~F.isnan(column)).agg(F.min(column), F.max(column)).first()
        low, high = 1e-6, max(1e-3, (high_x - low_x) if low_x is not None else 0.0)

        def enough(widths: np.ndarray) -> np.ndarray:
            return np.array([reduce(n) >= target for n in _effective(rows, column, focals, widths)])

        while True:
            tried = high * 2.0 ** np.arange(-tries + 4, 4)  # most bandwidths are far below the range
            good = enough(tried)
            if good.any():
                first = int(good.argmax())
                low, high = (tried[first - 1] if first else low), tried[first]
                break
            low, high = tried[-1], tried[-1] * 2.0**tries
            if low >= 1e9:
                return 1e9
        while high - low >= tol:
            tried = np.linspace(low, high, tries + 2)[1:]
            first = int(np.append(enough(tried[:-1]), True).argmax())
            low, high = (tried[first - 1] if first else low), tried[first]
        return float(high)
    finally:
        rows.unpersist()


def gates(df: DataFrame, column: str, edges: list[float], min_bin: int = 1000, share: float = 0.15, min_class: int = 150, covered: float = 0.9, most: float = 0.65) -> DataFrame:
    """The acceptance gates of a policy of bins: key, tier, observed, threshold, passed."""
    total = df.agg(F.count(F.lit(1)).alias("n_total"))
    sizes = df.where(F.col(column).isNotNull()).groupBy(bin_of(F.col(column), edges).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    s = sizes.agg(F.min("n").alias("least"), F.max("n").alias("greatest"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("bins")).crossJoin(F.broadcast(total))  # one row each
    rows = [
        ("min_bin_size", 1, F.col("least").cast("double"), float(min_bin), F.col("least") >= min_bin),
        ("smallest_class", 1, F.col("least") * share, float(min_class), F.col("least") * share >= min_class),
        ("coverage", 1, F.col("n") / F.col("n_total"), covered, F.col("n") / F.col("n_total") >= covered),
        ("partition", 1, F.col("bins").cast("double"), 2.0, F.col("bins") >= 2),
        ("size_balance", 2, F.col("greatest") / F.col("n"), most, F.col("greatest") / F.col("n") <= most),
    ]
    return s.select(F.inline(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(t).alias("tier"), o.alias("observed"), F.lit(h).alias("threshold"), p.alias("passed")) for k, t, o, h, p in rows))))


def edge_robustness(df: DataFrame, column: str, edges: list[float], by: float = 1.0) -> DataFrame:
    """For each edge moved down and up: the share of rows that change bins and the least bin."""
    moved = [(i, d, [e + d if j == i else e for j, e in enumerate(edges)]) for i in range(len(edges)) for d in (-by, by)]
    x = F.col(column)
    here = bin_of(x, edges)
    rows = df.where(x.isNotNull()).select(here.alias("old"), F.inline(F.array(*(F.struct(F.lit(i).alias("edge"), F.lit(d).alias("shift"), bin_of(x, e).alias("new")) for i, d, e in moved))))
    sizes = rows.groupBy("edge", "shift", "new").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("old") != F.col("new")).alias("moved"))
    return sizes.groupBy("edge", "shift").agg((F.sum("moved") / F.sum("n")).alias("moved_share"), F.min("n").alias("least"))


def smd(df: DataFrame, group: Column, low: int, high: int, values: list[str]) -> DataFrame:
    """Standardised mean differences between two groups: covariate and smd (absolute)."""
    stacked = df.select(group.alias("g"), F.inline(F.array(*(F.struct(F.lit(v).alias("covariate"), F.col(v).cast("double").alias("x")) for v in values)))).where(F.col("g").isin(low, high))
    a, b = (F.when(F.col("g") == g, F.col("x")) for g in (low, high))
    sd = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
    return stacked.groupBy("covariate").agg(F.when(sd > 0, F.abs(F.avg(b) - F.avg(a)) / sd).otherwise(0.0).alias("smd"))


def min_rows_for(share: float, least: int) -> int:
    return math.ceil(least / share)


def permute_axis(df: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    """The axis's values dealt anew among the rows: key and the value of another row.

    Rows are numbered twice, by key and by a seeded hash of it, and joined on the number; the
    numbers are running totals over ranges, so no task orders all rows.
    """
    one = df.select(F.col(key).alias("_k"), F.col(column).alias("_v"), F.lit(1).alias("_one")).withColumn("_h", F.xxhash64("_k", F.lit(seed)))
    by_key = running_total(one, "_k", "_one", "_r").select("_k", "_r")
    by_hash = running_total(one, "_h", "_one", "_r").select("_v", "_r")
    return by_key.join(by_hash, "_r").select(F.col("_k").alias(key), F.col("_v").alias(column))


def null_partition(df: DataFrame, key: str, sizes: list[int], seed: int) -> DataFrame:
    """Strata of the given sizes cut from the rows in a seeded random order: key and stratum."""
    ranked = running_total(df.select(key, F.lit(1).alias("_one")).withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))), "_h", "_one", "_r")
    ends = np.cumsum(sizes).tolist()
    stratum = F.lit(None).cast("int")
    for i in range(len(ends) - 1, -1, -1):
        stratum = F.when(F.col("_r") <= ends[i], i).otherwise(stratum)
    return ranked.select(key, stratum.alias("stratum")).where("stratum is not null")


def dichotomy(x: Column, edge: float, low_is_impaired: bool, names: tuple[str, str] = ("impaired", "spared")) -> Column:
    """The two bands around one edge, named by which side is impaired; a missing x has none."""
    low, high = names if low_is_impaired else names[::-1]
    return F.when(bin_of(x, [edge]) == 0, low).when(bin_of(x, [edge]) == 1, high)


def demographic_table(df: DataFrame, band: str, covariates: list[str]) -> DataFrame:
    """band, covariate, n, mean and its standardised difference from all other rows.

    One aggregate by band gives the sums; the others' are what is left of the totals.
    """
    long = df.where(F.col(band).isNotNull()).select(band, F.inline(F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in covariates))))
    g = long.groupBy(band, "covariate").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    all_rows = g.groupBy("covariate").agg(F.sum("n").alias("an"), F.sum("s").alias("as"), F.sum("ss").alias("ass"))
    j = g.join(all_rows, "covariate").withColumns({"on": F.col("an") - F.col("n"), "os": F.col("as") - F.col("s"), "oss": F.col("ass") - F.col("ss")})

    def var(n: str, s: str, ss: str) -> Column:
        return F.when(F.col(n) > 1, (F.col(ss) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1))

    sd = F.sqrt((var("n", "s", "ss") + var("on", "os", "oss")) / 2)
    diff = F.col("s") / F.col("n") - F.col("os") / F.col("on")
    return j.select(band, "covariate", "n", (F.col("s") / F.col("n")).alias("mean"), F.when(sd > 0, diff / sd).alias("smd"))
