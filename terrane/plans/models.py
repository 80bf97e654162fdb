"""Model queries on the given tables: mixtures, prevalence, bootstrap, invariance, digests.

Each function's name is its query's; ORACLES has DuckDB SQL where SQL can say the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from terrane.operators import drift as D
from terrane.operators import enrichment as E
from terrane.operators import inference as I
from terrane.operators import mixture as M
from terrane.plans.common import table
from terrane.sources.sinks import digest

STARTS = 20  # the least that the reference uses
COLUMNS = M.Columns(["c_acctbal", "n_orders", "price"], ["urgent"], {"status": 3})


def _matrix(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), (F.avg("o_totalprice") / 1000).alias("price"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"), F.max(status).alias("status"), F.min(F.year("o_orderdate")).alias("year"))
    return table(spark, sf, "customer").join(o, "c_custkey")


def mixture_fit(spark, sf):
    """Classes of a mixed-emission mixture: shares, and their rows' means."""
    rows = _matrix(spark, sf)
    model = M.fit(rows, "c_custkey", COLUMNS, 3, n_init=STARTS)
    labels = M.assign(rows, "c_custkey", model).select("c_custkey", "label")
    return rows.join(labels, "c_custkey").groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in COLUMNS.names), F.lit(model.converged).alias("converged"))


def _wide(spark, sf):
    """A row per customer: 98 totals and 140 flags of the orders of each year, month, state and priority."""
    o, price = table(spark, sf, "orders"), F.col("o_totalprice") / 1000
    states, priorities = ("F", "O", "P"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    totals, flags = [], []
    for y in range(1995, 2002):
        own = F.year("o_orderdate") == y
        parts = [F.quarter("o_orderdate") == q for q in range(1, 5)] + [F.col("o_orderstatus") == c for c in states] + [F.col("o_orderpriority") == c for c in priorities]
        totals += [F.sum(F.when(own & p, price).otherwise(0.0)) for p in parts] + [F.max(F.when(own, price).otherwise(0.0)), F.count(F.when(own, 1))]
        flags += [F.max((own & p).cast("int")) for p in [F.month("o_orderdate") == m for m in range(1, 13)] + parts[4:]]
    names = [f"t{i}" for i in range(len(totals))], [f"f{i}" for i in range(len(flags))]
    rows = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(*(e.alias(n) for e, n in zip(totals + flags, names[0] + names[1], strict=True)))
    return rows, M.Columns(*names)


def mixture_wide(spark, sf):
    """Shares and sureness of four classes on 238 columns, the likeliest of 200 starts."""
    rows, columns = _wide(spark, sf)
    rows = rows.cache()  # its 238 aggregates are worked out once, for the fit and for the labels
    try:
        model = M.fit(rows, "c_custkey", columns, 4, n_init=200)
        out = M.assign(rows, "c_custkey", model).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_max("responsibilities")).alias("mean_posterior"), F.lit(model.converged).alias("converged"))
        return spark.createDataFrame(out.collect(), out.schema)  # a row for each class
    finally:
        rows.unpersist()


def mixture_selection(spark, sf):
    """Criteria and held-out likelihood of fits with one to three classes."""
    return M.select(_matrix(spark, sf), "c_custkey", M.Columns(["c_acctbal", "price"], ["urgent"]), [1, 2, 3], n_init=STARTS)


def class_alignment(spark, sf):
    """Classes of the embeddings' odd rows aligned with those of all rows, at least total distance."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("class"), F.posexplode("embedding").alias("feature", "value"))
    a, b = (D.centroids(x, ["class"]).select("class", "feature", "mean") for x in (e.where("vec_id % 2 = 1"), e))
    pairs = a.alias("a").join(b.alias("b"), F.col("a.feature") == F.col("b.feature")).groupBy(F.col("a.class").alias("source"), F.col("b.class").alias("target")).agg(F.sqrt(F.sum(F.pow(F.col("a.mean") - F.col("b.mean"), 2))).alias("distance"))
    named = pairs.where("source is not null and target is not null")
    rows = named.collect()  # classes by classes
    sources, targets = (sorted({r[c] for r in rows}) for c in ("source", "target"))
    cost = np.full((len(sources), len(targets)), 1e9)
    for r in rows:
        cost[sources.index(r["source"]), targets.index(r["target"])] = r["distance"]
    chosen = [x for s, t in zip(sources, E.assign(cost), strict=True) if t < len(targets) for x in (s, targets[t])]
    return named.where(F.col("target") == F.create_map(*(F.lit(int(x)) for x in chosen))[F.col("source")]) if chosen else named.limit(0)


def family_bootstrap(spark, sf):
    """Means per segment with intervals by drawing whole nations again."""
    c = table(spark, sf, "customer").select("c_mktsegment", "c_nationkey", F.col("c_acctbal").alias("value"))
    return I.family_bootstrap(c, "c_nationkey", ["c_mktsegment"])


def permutation_null(spark, sf):
    """Each class's displacement of odd rows against drawn strata of the same share."""
    long = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("class"), F.posexplode("embedding").alias("feature", "value"))
    g = long.groupBy("class", "feature").agg(F.avg(F.when(F.col("id") % 2 == 1, F.col("value"))).alias("m"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    z = (F.col("m") - F.col("mean")) / F.col("sd")
    seen = g.groupBy("class").agg(F.sqrt(F.avg(z * z)).alias("value"))
    return D.read_against_null(seen, I.permutation_null(long, "id", 0.5).select("class", "draw"), ["class"])


def prevalence_slopes(spark, sf):
    """Slopes of class membership along the year of the first order, from soft class weights."""
    rows = _matrix(spark, sf)
    model = M.fit(rows, "c_custkey", M.Columns(["c_acctbal", "price"]), 3, n_init=STARTS)
    soft = rows.select("c_custkey", (F.col("year") - 1995).alias("x")).join(M.assign(rows, "c_custkey", model), "c_custkey")
    coef = I.multinomial(soft, ["x"], "responsibilities", 3)
    per = soft.select(F.posexplode("responsibilities").alias("class", "r")).groupBy("class").agg(F.avg("r").alias("share"))
    slope = F.element_at(F.array(F.lit(0.0), *(F.lit(float(c[1])) for c in coef)), F.col("class") + 1)
    return per.select("class", "share", slope.alias("slope"), F.exp(slope).alias("odds_ratio"), F.lit(model.converged).alias("converged"))


def score_invariance(spark, sf):
    """Whether orders' prices and dates of segments fluctuate along time more than chance does."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    long = o.select(F.col("c_mktsegment").alias("class"), F.date_trunc("month", "o_orderdate").cast("date").alias("axis"), F.inline(F.array(F.struct(F.lit("price").alias("feature"), F.col("o_totalprice").alias("value")), F.struct(F.lit("balance").alias("feature"), F.col("c_acctbal").alias("value")))))
    bins = long.select("axis").distinct().withColumn("grid", F.year("axis") * 12 + F.month("axis"))
    return I.invariance(long, "axis", bins)


def frame_digest(spark, sf):
    """A digest of the orders' keys and states that doesn't depend on their order."""
    return digest(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


QUERIES = {f.__name__: f for f in (mixture_fit, mixture_wide, mixture_selection, class_alignment, family_bootstrap, permutation_null, prevalence_slopes, score_invariance, frame_digest)}

ORACLES = {
    "frame_digest": "select count(*) as n_rows, sum(('0x' || substr(md5(concat_ws('|', o_custkey, o_orderkey, o_orderpriority, o_orderstatus)), 1, 12))::bigint)::varchar as digest from orders",
}
