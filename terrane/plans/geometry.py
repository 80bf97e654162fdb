"""Geometry, trajectories and nulls on the given tables.

Each function's name is its query's; ORACLES has DuckDB SQL where SQL can say the same.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from terrane.operators import drift as D
from terrane.operators import geometry as G
from terrane.operators import inference as I
from terrane.operators import mixture as M
from terrane.operators import strata as S
from terrane.plans.common import table


def _wide(spark, sf):
    """vec_id, label and all components, x0 to the longest embedding's last; and their names."""
    e = table(spark, sf, "embeddings")
    names = [f"x{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]  # one row
    return e.select("vec_id", "label", *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names))), names


def discriminant_positions(spark, sf):
    """Classes' mean positions and spreads on the axes that part them best."""
    rows, names = _wide(spark, sf)
    _, n, s, ss = G.scatter(rows, "label", names)
    axes = G.discriminant_axes(n, s, ss, 3)
    at = rows.select("label", *(sum((F.col(c) * float(axes[i, k]) for i, c in enumerate(names)), F.lit(0.0)).alias(f"ld{k + 1}") for k in range(axes.shape[1])))
    return at.groupBy("label").agg(*(F.avg(f"ld{k}").alias(f"ld{k}") for k in (1, 2, 3)), F.var_samp("ld1").alias("cov11"), F.covar_samp("ld1", "ld2").alias("cov12"), F.var_samp("ld2").alias("cov22"))


def mahalanobis_contributions(spark, sf):
    """Features' parts of the squared distance of odd rows' class means from those of all rows."""
    rows, names = _wide(spark, sf)
    _, n, s, ss = G.scatter(rows, "label", names)
    inverse = np.linalg.inv(G.shrunk(G.within(n, s, ss)))
    odd = F.col("vec_id") % 2 == 1
    d = rows.groupBy("label").agg(F.array(*(F.avg(F.when(odd, F.col(c))) - F.avg(c) for c in names)).alias("d"))
    whole = F.from_json(F.lit(json.dumps(inverse.tolist())), "array<array<double>>")
    dot = lambda row: F.aggregate(F.zip_with(row, F.col("d"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    parts = F.zip_with(F.col("d"), F.transform(whole, dot), lambda a, b: a * b)
    return d.select("label", F.posexplode(parts).alias("feature", "contribution"))


def jensen_shannon(spark, sf):
    """Mean divergence of each class's features between odd rows and all rows."""
    l = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("class"), F.posexplode("embedding").alias("feature", "value"))
    odd = F.when(F.col("vec_id") % 2 == 1, F.col("value").cast("double"))
    x = F.col("value").cast("double")
    g = l.groupBy("class", "feature").agg(F.avg(odd).alias("m1"), F.stddev_pop(odd).alias("s1"), F.avg(x).alias("m2"), F.stddev_pop(x).alias("s2"))
    return g.groupBy("class").agg(F.round(F.avg(G.gaussian_jsd(*(F.col(c) for c in ("m1", "s1", "m2", "s2")))), 6).alias("jsd"))


def _months(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("class"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month")).agg(F.avg("o_totalprice").alias("price"), F.avg("c_acctbal").alias("balance"))


def single_break(spark, sf):
    """Where two lines fit each segment's monthly prices best."""
    got = D.single_break(_months(spark, sf).withColumn("price", F.col("price") / 1000), ["class"], "month", "price")
    return got.select("class", F.round("break", 2).alias("break"), F.round("sse", 2).alias("sse"))


def projected_trajectory(spark, sf):
    """Segments' monthly displacements along their own mean direction."""
    long = _months(spark, sf).unpivot(["class", "month"], ["price", "balance"], "feature", "value")
    whole = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    z = long.join(whole, "feature").select("class", "month", "feature", ((F.col("value") - F.col("m")) / F.col("sd")).alias("z"))
    got = D.project(z, D.net_direction(z, ["class"]), ["class"], "month")
    return got.select("class", "month", F.round("along", 5).alias("along"))


def conditioning_shrinkage(spark, sf):
    """How much of segments' displacement goes when balances are taken net of the nation."""
    c = D.residualise(table(spark, sf, "customer"), "c_acctbal", "c_nationkey", "net")
    d = lambda col: c.groupBy("c_mktsegment").agg((F.avg(F.when(F.col("c_custkey") % 2 == 1, F.col(col))) - F.avg(col)).alias("d")).select("c_mktsegment", F.abs("d").alias("full"))
    got = D.shrinkage(d("c_acctbal"), d("net"), ["c_mktsegment"])
    return got.select("c_mktsegment", F.round("raw", 4).alias("raw"), F.round("conditioned", 4).alias("conditioned"), F.round("shrinkage", 4).alias("shrinkage"))


def permuted_axis(spark, sf):
    """Balances dealt anew among customers: the same values, none lost."""
    got = S.permute_axis(table(spark, sf, "customer"), "c_custkey", "c_acctbal", 7)
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("n_keys"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.round(F.max("c_acctbal"), 2).alias("greatest"))


def null_partition(spark, sf):
    """Strata of given sizes in a random order."""
    c = table(spark, sf, "customer")
    n = c.count()
    return S.null_partition(c, "c_custkey", [n // 2, n // 4, n // 8], 3).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


def corrected_prevalence(spark, sf):
    """Class shares by true class, assignment errors taken into account, along order years."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.min(F.year("o_orderdate")) - 1995).alias("x"), (F.avg("o_totalprice") / 1000).alias("price"))
    rows = table(spark, sf, "customer").join(o, "c_custkey")
    m = M.fit(rows, "c_custkey", M.Columns(["c_acctbal", "price"]), 2, n_init=20)
    soft = rows.select("c_custkey", "x").join(M.assign(rows, "c_custkey", m), "c_custkey")
    coef = I.corrected_multinomial(soft, ["x"], "responsibilities", 2, rounds=200)
    return I.bch_confusion(soft, "responsibilities").withColumns({"slope": F.lit(float(coef[0][1])), "converged": F.lit(m.converged)})


QUERIES = {f.__name__: f for f in (discriminant_positions, mahalanobis_contributions, jensen_shannon, single_break, projected_trajectory, conditioning_shrinkage, permuted_axis, null_partition, corrected_prevalence)}

_MONTHS = "(select c_mktsegment as class, year(o_orderdate) * 12 + month(o_orderdate) as month, avg(o_totalprice) as price, avg(c_acctbal) as balance from orders join customer on o_custkey = c_custkey group by 1, 2)"

ORACLES = {
    "jensen_shannon": """
        with l as (select vec_id, label as class, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as feature from embeddings),
        g as (select class, feature, avg(v) filter (vec_id % 2 = 1) as m1, stddev_pop(v) filter (vec_id % 2 = 1) as s1, avg(v) as m2, stddev_pop(v) as s2 from l group by 1, 2),
        e as (select *, least(m1 - 6 * s1, m2 - 6 * s2) as lo, (greatest(m1 + 6 * s1, m2 + 6 * s2) - least(m1 - 6 * s1, m2 - 6 * s2)) / 255 as step from g),
        d as (select class, feature, step, exp(-0.5 * ((lo + i * step - m1) / s1) ** 2) / (s1 * sqrt(2 * pi())) as p, exp(-0.5 * ((lo + i * step - m2) / s2) ** 2) / (s2 * sqrt(2 * pi())) as q from e, range(256) r(i)),
        f as (select class, feature, least(1, greatest(0, sum((case when p > 1e-300 then p * ln(p / ((p + q) / 2)) else 0 end + case when q > 1e-300 then q * ln(q / ((p + q) / 2)) else 0 end) / 2) * any_value(step) / ln(2))) as jsd from d group by 1, 2)
        select class, round(avg(jsd), 6) as jsd from f group by class""",
    "single_break": f"""
        with m as (select class, month, price / 1000 as y, row_number() over (partition by class order by month) as i, count(*) over (partition by class) as n from {_MONTHS}),
        s as (select a.class, a.month, any_value(a.i) as i, any_value(a.n) as n, regr_syy(b.y, b.month) filter (b.i <= a.i) - coalesce(regr_sxy(b.y, b.month) filter (b.i <= a.i) ** 2 / nullif(regr_sxx(b.y, b.month) filter (b.i <= a.i), 0), 0)
            + regr_syy(b.y, b.month) filter (b.i > a.i) - coalesce(regr_sxy(b.y, b.month) filter (b.i > a.i) ** 2 / nullif(regr_sxx(b.y, b.month) filter (b.i > a.i), 0), 0) as sse, min(b.month) filter (b.i > a.i) as nxt
            from m a join m b on a.class = b.class where a.i >= 3 and a.n - a.i >= 3 group by a.class, a.month)
        select class, round((arg_min(month, sse) + arg_min(nxt, sse)) / 2, 2) as break, round(min(sse), 2) as sse from s group by class""",
    "projected_trajectory": f"""
        with l as (select class, month, 'price' as feature, price as value from {_MONTHS} union all select class, month, 'balance', balance from {_MONTHS}),
        z as (select class, month, l.feature, (value - m) / sd as z from l join (select feature, avg(value) as m, stddev_samp(value) as sd from l group by 1) w on w.feature = l.feature),
        d as (select class, feature, avg(z) as m from z group by 1, 2), u as (select class, feature, m / sqrt(sum(m * m) over (partition by class)) as u from d)
        select z.class, z.month::int as month, round(sum(z * u), 5) as along from z join u on u.class = z.class and u.feature = z.feature group by 1, 2""",
    "conditioning_shrinkage": """
        with f as (select regr_slope(c_acctbal, c_nationkey) as b, regr_intercept(c_acctbal, c_nationkey) as a from customer), c as (select *, c_acctbal - a - b * c_nationkey as net from customer, f),
        g as (select c_mktsegment, abs(avg(c_acctbal) filter (c_custkey % 2 = 1) - avg(c_acctbal)) as raw, abs(avg(net) filter (c_custkey % 2 = 1) - avg(net)) as conditioned from c group by 1)
        select c_mktsegment, round(raw, 4) as raw, round(conditioned, 4) as conditioned, round(1 - conditioned / raw, 4) as shrinkage from g""",
    "permuted_axis": "select count(*) as n, count(distinct c_custkey) as n_keys, round(sum(c_acctbal), 2) as total, round(max(c_acctbal), 2) as greatest from customer",
    "null_partition": "with n as (select count(*) as n from customer) select 0::int as stratum, n // 2 as n from n union all select 1, n // 4 from n union all select 2, n // 8 from n",
}
