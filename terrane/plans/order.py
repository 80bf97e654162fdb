"""Queries on the number of classes and the stability of fits, on customers' features."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import mixture as M
from terrane.operators import order as O
from terrane.plans.common import table

STARTS = 20  # the least that the reference uses
COLUMNS = M.Columns(["c_acctbal", "price"], ["urgent"])


def _matrix(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.avg("o_totalprice") / 1000).alias("price"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"))
    return table(spark, sf, "customer").join(o, "c_custkey").select("c_custkey", "c_acctbal", "price", "urgent")


def class_number_test(spark, sf):
    """The adjusted likelihood ratio of two classes against three."""
    rows = _matrix(spark, sf)
    fits = M.fit_many(rows, "c_custkey", COLUMNS, [(k, -1, i) for k in (2, 3) for i in range(STARTS)])
    best = [max(own, key=lambda m: m.log_likelihood) for own in (fits[:STARTS], fits[STARTS:])]
    return O.adjusted_lr(spark, *best, rows.dropna(subset=COLUMNS.names).count())


def fit_stability(spark, sf):
    """Agreement of fits from other starts with labels by the balance's sign and the flag."""
    rows = _matrix(spark, sf)
    ref = rows.select("c_custkey", (F.col("urgent") + 2 * (F.col("c_acctbal") > 4500).cast("int")).alias("reference"))
    return O.stability(rows, "c_custkey", COLUMNS, ref, 3, n_fits=STARTS, top=3)


def sample_size_stability(spark, sf):
    """Agreement of fits on a half and a quarter of the rows with a fit on all."""
    rows = _matrix(spark, sf)
    whole = M.fit(rows, "c_custkey", COLUMNS, 3, n_init=STARTS)
    ref = M.assign(rows, "c_custkey", whole).select("c_custkey", F.col("label").alias("reference"))
    return O.subsample_stability(rows, "c_custkey", COLUMNS, ref, 3, [0.5, 0.25], n_init=STARTS).withColumn("reference_converged", F.lit(whole.converged))


QUERIES = {f.__name__: f for f in (class_number_test, fit_stability, sample_size_stability)}
ORACLES: dict[str, str] = {}
