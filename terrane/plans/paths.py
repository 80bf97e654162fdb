"""Paths of classes along time, and bootstraps of whole families, on the given tables.

Segments are the classes, customers the families, and the day of an order the axis; the path's means
are Gaussian windows around days. ORACLES has DuckDB SQL of what has no draws.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import concomitant as C
from terrane.operators import mixture as M
from terrane.operators import scores as S
from terrane.operators import tube as T
from terrane.plans.common import table

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
FEATURES = ["price", "balance", "lines"]
FOCALS, BANDWIDTH = [9100.0, 9400.0, 9700.0, 10000.0, 10300.0, 10600.0, 10900.0, 11200.0], 250.0


def _rows(spark, sf):
    """An order with its customer's segment as responsibilities; the day counts from 1970."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.avg("l_discount").alias("discount"), F.avg("l_quantity").alias("quantity"))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(lines, "o_orderkey")
    r = F.array(*(F.when(F.col("c_mktsegment") == s, 1.0).otherwise(0.0) for s in SEGMENTS))
    return o.select("o_orderkey", "o_custkey", F.unix_date(F.to_date("o_orderdate")).cast("double").alias("day"), (F.col("o_totalprice") / 1000).alias("price"), F.col("c_acctbal").alias("balance"), F.col("lines").cast("double").alias("lines"), "discount", "quantity", r.alias("r"))


def _draws(spark, sf, n_boot=999):
    return T.displacement_draws(_rows(spark, sf), "o_custkey", FEATURES, "r", T.along("day", FOCALS, BANDWIDTH), n_boot)


def observed_path(spark, sf):
    """How far each segment's means around each day are from its means over all days."""
    seen = _draws(spark, sf, 0)
    return seen.select("class", "position", F.posexplode("z").alias("feature", "z")).select("class", "position", "feature", F.round("z", 6).alias("z"))


def bootstrap_tube(spark, sf):
    """The path's length at each day, with intervals and a band for the whole path."""
    return T.tube(_draws(spark, sf))


def directional_inference(spark, sf):
    return T.directional_inference(_draws(spark, sf), FOCALS)


def per_feature_inference(spark, sf):
    return T.per_feature_inference(_draws(spark, sf), FEATURES, len(FOCALS) - 1)


def block_co_drift(spark, sf):
    """Whether discounts and quantities drift in the same segments as prices and balances do."""
    return T.co_drift(_rows(spark, sf), "o_custkey", FEATURES, ["discount", "quantity"], "r", T.Window("day", FOCALS[-1], BANDWIDTH))


def control_specificity(spark, sf):
    """Whether segments drift more by the day than by the order's key."""
    keys = _rows(spark, sf).withColumn("key", F.pmod(F.xxhash64("o_orderkey"), F.lit(1000)).cast("double"))
    return T.control_specificity(keys, "o_custkey", FEATURES, "r", T.Window("day", FOCALS[-1], BANDWIDTH), T.Window("key", 900.0, 100.0))


def order_test(spark, sf):
    """Whether segments' paths move with time, against shuffled orders of the days."""
    return T.order_test(_draws(spark, sf, 0), ["class"], "position", "z")


def _customers(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).cast("double").alias("n_orders"), F.min(F.unix_date(F.to_date("o_orderdate"))).cast("double").alias("first"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent"))
    return table(spark, sf, "customer").join(o, "c_custkey")


COLUMNS = M.Columns(["c_acctbal", "price", "n_orders"], ["urgent"])
CATEGORIES = {"c_acctbal": "money", "price": "money", "n_orders": "volume", "urgent": "volume"}


def invariance_of_fit(spark, sf):
    """Whether a fitted mixture's parameters hold along the day of a customer's first order."""
    rows = _customers(spark, sf)
    return S.run_invariance(rows, "first", M.fit(rows, "c_custkey", COLUMNS, 2, n_init=20), CATEGORIES)


def invariance_top_process(spark, sf):
    rows = _customers(spark, sf)
    return S.top_process(rows, "first", M.fit(rows, "c_custkey", COLUMNS, 2, n_init=20), CATEGORIES)


def mixture_covariates(spark, sf):
    """Classes whose shares follow the nation and the day of the first order: the logit and the means."""
    rows = _customers(spark, sf)
    model = C.fit(rows, "c_custkey", COLUMNS, ["c_nationkey", "first"], 2)
    means = C.assign(rows, "c_custkey", model).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_max("responsibilities")).alias("sureness"))
    coef = [(k, *map(float, c)) for k, c in enumerate([[0.0] * 3, *model.coefficients])]
    return means.join(spark.createDataFrame(coef, "label int, intercept double, nation double, first double"), "label").withColumn("converged", F.lit(model.converged))


QUERIES = {f.__name__: f for f in (observed_path, bootstrap_tube, directional_inference, per_feature_inference, block_co_drift, control_specificity, order_test, invariance_of_fit, invariance_top_process, mixture_covariates)}
ORACLES = {
    "observed_path": f"""
        with l as (select l_orderkey, count(*) as lines from lineitem group by 1),
        o as (select c_mktsegment, datediff('day', date '1970-01-01', o_orderdate::date)::double as day, o_totalprice / 1000 as price, c_acctbal as balance, lines::double as lines
            from orders join customer on o_custkey = c_custkey join l on l_orderkey = o_orderkey),
        x as (select c_mktsegment, day, 0 as feature, price as v from o union all select c_mktsegment, day, 1, balance from o union all select c_mktsegment, day, 2, lines from o),
        sd as (select feature, stddev_samp(v) as sd from x group by 1), own as (select c_mktsegment, feature, avg(v) as m from x group by 1, 2),
        f as (select unnest({FOCALS}) as focal), w as (select c_mktsegment, feature, focal, sum(exp(-0.5 * ((day - focal) / {BANDWIDTH}) ** 2) * v) / sum(exp(-0.5 * ((day - focal) / {BANDWIDTH}) ** 2)) as m from x, f group by 1, 2, 3)
        select (list_position({SEGMENTS}, w.c_mktsegment) - 1)::int as class, (list_position({FOCALS}, focal) - 1)::int as position, w.feature::int as feature, round((w.m - own.m) / sd, 6) as z
        from w join own on own.c_mktsegment = w.c_mktsegment and own.feature = w.feature join sd on sd.feature = w.feature""",
}
