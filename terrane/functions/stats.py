"""Statistics as column expressions and small plans: tails, multiple testing, long form, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _beta(x: Column, a: Column, b: Column) -> Column:
    return F.java_method(F.lit("org.apache.commons.math3.special.Beta"), F.lit("regularizedBeta"), x, a.cast("double"), b.cast("double")).cast("double")


def _gamma_q(a: Column, x: Column) -> Column:
    return F.java_method(F.lit("org.apache.commons.math3.special.Gamma"), F.lit("regularizedGammaQ"), a.cast("double"), x.cast("double")).cast("double")


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t; for aggregated rows, since it leaves code generation."""
    return F.when(t.isNotNull() & df.isNotNull() & ~F.isnan(t), _beta(df / (df + t * t), df / 2, F.lit(0.5)))


def t_upper(t: Column, df: Column) -> Column:
    return F.when(t >= 0, t_two_sided(t, df) / 2).otherwise(1 - t_two_sided(t, df) / 2)


def binomial_at_least(k: Column, n: Column, p: Column) -> Column:
    return F.when(k < 1, 1.0).otherwise(_beta(p, k, n - k + 1))


def binomial_at_most(k: Column, n: Column, p: Column) -> Column:
    return F.when(k >= n, 1.0).otherwise(1 - _beta(p, k + 1, n - k))


def chi2_upper(x: Column, df: Column) -> Column:
    return F.when(x <= 0, 1.0).otherwise(_gamma_q(df / 2, x / 2))


def add_one(at_least: Column, draws: Column) -> Column:
    """The permutation p-value (1 + draws at least as great) / (1 + draws)."""
    return (1 + at_least) / (1 + draws)


def _family(by: list[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def bh_reject(df: DataFrame, p: str, by: list[str] | None = None, q: float = 0.05) -> DataFrame:
    """df with reject: Benjamini and Hochberg's step-up within each family. Null and NaN never pass.

    A family is the tests of one analysis; it is ranked whole.
    """
    by = by or []
    live = F.col(p).isNotNull() & ~F.isnan(p)
    ranked = df.withColumn("_p", F.when(live, F.col(p)))
    ranked = ranked.withColumn("_k", F.row_number().over(_family(by).orderBy(F.asc_nulls_last("_p")))).withColumn("_m", F.count("_p").over(_family(by)))
    most = F.max(F.when(F.col("_p") <= q * F.col("_k") / F.col("_m"), F.col("_p"))).over(_family(by))
    return ranked.withColumn("reject", F.coalesce(F.col("_p") <= most, F.lit(False))).drop("_p", "_k", "_m")


def bh_adjusted(df: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """df with p_adjusted: the least p * m / rank of all p not smaller, 1 at most."""
    by = by or []
    live = F.col(p).isNotNull() & ~F.isnan(p)
    ranked = df.withColumn("_p", F.when(live, F.col(p)))
    ranked = ranked.withColumn("_k", F.row_number().over(_family(by).orderBy(F.asc_nulls_last("_p")))).withColumn("_m", F.count("_p").over(_family(by)))
    up = _family(by).orderBy(F.desc_nulls_last("_p")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("p_adjusted", F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), F.min(F.col("_p") * F.col("_m") / F.col("_k")).over(up)))).drop("_p", "_k", "_m")


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with ranks from 1, equal values sharing the mean of theirs.

    Values are counted first; the running count is over distinct values, dealt by ranges of value.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    before = running_total(counts, column, "_n", "_through")
    ranks = before.select(F.col(column).alias("_v"), (F.col("_through") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, df[column] == F.col("_v"), "left").drop("_v")


def range_of(x: Column, edges: list) -> Column:
    """How many of the sorted edges are below x, by binary search: a literal array, however many."""
    if not edges:
        return F.lit(0)
    table = F.lit(edges)
    steps = [1 << i for i in range(len(edges).bit_length() - 1, -1, -1)]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, k: at + F.when(F.try_element_at(table, at + k) < x, k).otherwise(0))


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df (distinct in order) with the running total of value, without one task seeing all rows.

    Rows are put in ranges by the value of `order`; totals of the ranges are added up first.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / parts for i in range(1, parts)]
    edges = df.select(F.percentile_approx(order, F.lit(probs), 10000)).first()[0] if probs else []
    dealt = df.withColumn("_part", range_of(F.col(order), sorted(set(edges or []))))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_s"))  # a row for each range
    base = sums.select("_part", F.coalesce(F.sum("_s").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return dealt.withColumn("_in", F.sum(value).over(inside)).join(base, "_part").withColumn(name, F.col("_base") + F.col("_in")).drop("_part", "_in", "_base")


def rank_totals(df: DataFrame, column: str) -> DataFrame:
    """_v, _from and _to: a column's distinct values, and how many rows are below each and up to it.
    Their totals run over ranges of value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return running_total(counts, "_v", "_n", "_to").select("_v", (F.col("_to") - F.col("_n")).alias("_from"), "_to")


def looked_up(totals: DataFrame, ranks: list[int]) -> dict[int, tuple[float, int, int]]:
    """at_ranks of the values in rank_totals; only the rows of the given ranks reach the driver."""
    wanted = sorted(set(ranks))
    if not wanted:
        return {}
    first = range_of(F.col("_from"), wanted)  # how many wanted ranks are below these rows'
    many = range_of(F.col("_to"), wanted) - first
    hit = totals.where(many > 0).select("_v", "_from", "_to", first.alias("_first"), many.alias("_many")).collect()
    return {wanted[i]: (r["_v"], r["_from"], r["_to"]) for r in hit for i in range(r["_first"], r["_first"] + r["_many"])}


def at_ranks(df: DataFrame, column: str, ranks: list[int]) -> dict[int, tuple[float, int, int]]:
    """For ranks from 0 in the order of a column: the value, and how many rows are below it and up to it."""
    return looked_up(rank_totals(df, column), ranks)


def quantile_ranks(n: int, probs: list[float]) -> list[int]:
    """The ranks that quantiles of n values lie between."""
    return [r for p in probs for r in (int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1))]


def between_ranks(found: dict[int, tuple[float, int, int]], n: int, probs: list[float]) -> list[tuple[float, int]]:
    """Quantiles (interpolated between neighbours) from values at ranks, and how many rows are below each."""
    out = []
    for x in (p * (n - 1) for p in probs):
        (low, below, through), (high, *_) = found[int(x)], found[min(n - 1, int(x) + 1)]
        value = low + (x - int(x)) * (high - low)
        out.append((value, below if value <= low else through))
    return out


def quantiles(df: DataFrame, column: str, probs: list[float]) -> list[tuple[float, int]]:
    """Exact quantiles, and how many rows are below each; none of a column without values."""
    n = df.where(F.col(column).isNotNull()).count()
    return between_ranks(at_ranks(df, column, quantile_ranks(n, probs)), n, probs) if n else []


def long_form(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """ids, feature and value (double): a row for each cell."""
    return df.select(*ids, *(F.col(f).cast("double").alias(f) for f in features)).unpivot(ids, features, "feature", "value")


def moments(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n, mean and sample variance of each group, of the values that are there."""
    return long.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
