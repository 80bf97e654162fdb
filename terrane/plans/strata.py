"""Strata, gates and kernel weights on the given tables; customers' balances and order dates as axes.

Each function's name is its query's; ORACLES has the same query as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import stats
from terrane.operators import enrichment as E
from terrane.operators import strata as S
from terrane.plans.common import table

BANDS = [0.0, 2500.0, 5000.0, 7500.0]


def _customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")


def quantile_bins(spark, sf):
    c = _customers(spark, sf)
    return c.groupBy(S.bin_of(F.col("c_acctbal"), S.quantile_edges(c, "c_acctbal", 5)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("c_acctbal"), 2).alias("lo"), F.round(F.max("c_acctbal"), 2).alias("hi"))


def fixed_bands(spark, sf):
    c = _customers(spark, sf).withColumn("bin", S.bin_of(F.col("c_acctbal"), BANDS))
    sizes = {r["bin"]: r["n"] for r in c.where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per band
    starts = {b: sum(n for x, n in sizes.items() if x < b) for b in sizes}
    middle = {b: (starts[b] + (n - 1) // 2, starts[b] + n // 2) for b, n in sizes.items()}
    at = stats.at_ranks(c, "c_acctbal", [r for pair in middle.values() for r in pair])
    labels = S.band_labels(BANDS)
    rows = [(labels[b], n, round((at[middle[b][0]][0] + at[middle[b][1]][0]) / 2, 3)) for b, n in sizes.items()]
    return spark.createDataFrame(rows, "band string, n long, median double")


def max_equal_bins(spark, sf):
    c = _customers(spark, sf)
    edges = S.max_equal_edges(c, "c_acctbal", max(2, c.count() // 7))
    return c.groupBy(S.bin_of(F.col("c_acctbal"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def policy_gates(spark, sf):
    c = _customers(spark, sf).withColumn("x", F.when(F.col("c_acctbal") > -500, F.col("c_acctbal")))
    got = S.gates(c, "x", BANDS, min_bin=50, min_class=20)
    return got.select("key", "tier", F.round("observed", 4).alias("observed"), "threshold", "passed")


def edge_robustness(spark, sf):
    got = S.edge_robustness(_customers(spark, sf), "c_acctbal", BANDS[1:], 50.0)
    return got.select("edge", "shift", F.round("moved_share", 5).alias("moved_share"), "least")


def spearman_lag(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").alias("day"))
    r = stats.average_rank(stats.average_rank(o, "o_totalprice", "ra"), "day", "rb")
    return r.agg(F.round(F.corr("ra", "rb"), 5).alias("rho"), F.count(F.lit(1)).alias("n"))


def smd_extreme(spark, sf):
    c = _customers(spark, sf).withColumns({"nation": F.col("c_nationkey"), "is_auto": (F.col("c_mktsegment") == "AUTOMOBILE").cast("int")})
    got = S.smd(c, S.bin_of(F.col("c_acctbal"), BANDS), 0, len(BANDS), ["nation", "is_auto"])
    return got.select("covariate", F.round("smd", 5).alias("smd"))


FOCALS = [1000.0, 3000.0, 5000.0, 7000.0]


def kernel_effective_n(spark, sf):
    got = S.effective_n(_customers(spark, sf), "c_acctbal", FOCALS, 800.0)
    return got.select("position", "focal", F.round("n_eff", 3).alias("n_eff"))


def kernel_bandwidth(spark, sf):
    """The least bandwidth whose windows hold a fifth of the rows each, and what they then hold."""
    c = _customers(spark, sf)
    focals = S.focal_grid(c, "c_acctbal", 5)
    h = S.bandwidth_for(c, "c_acctbal", focals, c.count() / 5)
    return S.effective_n(c, "c_acctbal", focals, h).withColumn("bandwidth", F.lit(h))


def _labels(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_regionkey")


def crosstab_ari(spark, sf):
    t = E.contingency(_labels(spark, sf), "c_mktsegment", "n_regionkey")
    return E.adjusted_rand(t, "c_mktsegment", "n_regionkey").select(F.round("ari", 7).alias("ari"))


def jaccard_overlap(spark, sf):
    t = E.contingency(_labels(spark, sf), "c_mktsegment", "n_regionkey")
    return E.jaccard_overlap(t, "c_mktsegment", "n_regionkey").select("c_mktsegment", "n_regionkey", F.round("jaccard", 6).alias("jaccard"))


def movers_counts(spark, sf):
    l = _labels(spark, sf).select(F.col("n_regionkey").alias("ref"), (F.col("c_custkey") % 5).cast("int").alias("own"))
    got = E.movers(l, "own", "ref")
    return got.select("class", "n_stayers", "n_leavers", "n_joiners", F.round("churn", 5).alias("churn"))


def fluctuation_cumsum(spark, sf):
    """The cumulative process of centred values along an axis, tied axis values as one."""
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    whole = o.agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("sd"), F.count(F.lit(1)).alias("n"))
    days = o.groupBy("day").agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(whole))  # one row
    steps = days.select(F.unix_date("day").alias("at"), "day", ((F.col("s") - F.col("k") * F.col("m")) / F.col("sd") / F.sqrt("n")).alias("step"))
    return stats.running_total(steps, "at", "step", "process").select(F.col("day").cast("string").alias("day"), (F.round("process", 5) + F.lit(0.0)).alias("process"))


def mean_ranks(spark, sf):
    r = stats.average_rank(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "r")
    return r.select("p_partkey", "r")


QUERIES = {
    f.__name__: f
    for f in (quantile_bins, fixed_bands, max_equal_bins, policy_gates, edge_robustness, spearman_lag, smd_extreme, kernel_effective_n, kernel_bandwidth, crosstab_ari, jaccard_overlap, movers_counts, fluctuation_cumsum, mean_ranks)
}


def _bin(x: str, edges) -> str:
    return "(" + " + ".join(f"({x} >= {e})::int" for e in edges) + ")"


_L = "(select c_custkey, c_mktsegment, n_regionkey from customer join nation on c_nationkey = n_nationkey)"
_MOVED = " union all ".join(f"select {i}::int as edge, {d}::double as shift, {_bin('c_acctbal', BANDS[1:])} as old, {_bin('c_acctbal', [e + d if j == i else e for j, e in enumerate(BANDS[1:])])} as new from customer" for i in range(3) for d in (-50.0, 50.0))
_SMD = "abs(avg({x}) filter (b = 4) - avg({x}) filter (b = 0)) / sqrt((var_samp({x}) filter (b = 4) + var_samp({x}) filter (b = 0)) / 2)"

ORACLES = {
    "quantile_bins": "with e as (select quantile_cont(c_acctbal, [0.2, 0.4, 0.6, 0.8]) as e from customer), b as (select c_acctbal, len(list_filter(e, lambda x: c_acctbal >= x))::int as bin from customer, e) select bin, count(*) as n, round(min(c_acctbal), 2) as lo, round(max(c_acctbal), 2) as hi from b group by bin",
    "fixed_bands": f"select ['<0', '0-2500', '2500-5000', '5000-7500', '>=7500'][{_bin('c_acctbal', BANDS)} + 1] as band, count(*) as n, round(quantile_cont(c_acctbal, 0.5), 3) as median from customer group by 1",
    "max_equal_bins": """
        with n as (select count(*) as n, greatest(2, count(*) // 7) as floor from customer),
        q as (select unnest(range(2, 8)) as q), e as (select q, unnest(range(1, q)) / q::double as p from q),
        o as (select c_acctbal as x, row_number() over (order by c_acctbal) - 1 as i from customer),
        v as (select q, a.x + (b.x - a.x) * (p * (n.n - 1) - floor(p * (n.n - 1))) as edge from e, n join o a on a.i = floor(p * (n.n - 1)) join o b on b.i = ceil(p * (n.n - 1))),
        w as (select q, list(edge) as edges from (select distinct q, edge from v) group by q),
        s as (select q, len(list_filter(edges, lambda t: c_acctbal >= t))::int as bin, count(*) as n from customer, w group by 1, 2),
        ok as (select s.q, (min(s.n) >= min(n.floor) and count(*) = min(len(w.edges)) + 1) or s.q = 2 as fits from s join w on w.q = s.q, n where s.q <= n.n // n.floor group by s.q)
        select bin, n from s where q = (select max(q) from ok where fits)""",
    "policy_gates": f"""
        with x as (select case when c_acctbal > -500 then c_acctbal end as x from customer), s as (select {_bin('x', BANDS)} as b, count(*)::double as n from x where x is not null group by 1),
        t as (select min(n) as lo, max(n) as hi, sum(n) as n, count(*)::double as bins, (select count(*) from x) as total from s)
        select 'min_bin_size' as key, 1 as tier, round(lo, 4) as observed, 50.0::double as threshold, lo >= 50 as passed from t union all select 'smallest_class', 1, round(lo * 0.15, 4), 20.0, lo * 0.15 >= 20 from t
        union all select 'coverage', 1, round(n / total, 4), 0.9, n / total >= 0.9 from t union all select 'partition', 1, bins, 2.0, bins >= 2 from t union all select 'size_balance', 2, round(hi / n, 4), 0.65, hi / n <= 0.65 from t""",
    "edge_robustness": f"with m as ({_MOVED}), s as (select edge, shift, new, count(*) as n, count(*) filter (old <> new) as moved from m group by 1, 2, 3) select edge, shift, round(sum(moved) / sum(n), 5) as moved_share, min(n) as least from s group by 1, 2",
    "spearman_lag": "with r as (select rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0 as ra, rank() over (order by dayofyear(o_orderdate)) + (count(*) over (partition by dayofyear(o_orderdate)) - 1) / 2.0 as rb from orders) select round(corr(ra, rb), 5) as rho, count(*) as n from r",
    "smd_extreme": f"with c as (select c_nationkey as nation, (c_mktsegment = 'AUTOMOBILE')::int as auto, {_bin('c_acctbal', BANDS)} as b from customer) select 'nation' as covariate, round({_SMD.format(x='nation')}, 5) as smd from c union all select 'is_auto', round({_SMD.format(x='auto')}, 5) from c",
    "kernel_effective_n": " union all ".join(f"select {i}::int as position, {f}::double as focal, round(sum(exp(-0.5 * ((c_acctbal - {f}) / 800.0) ** 2)), 3) as n_eff from customer" for i, f in enumerate(FOCALS)),
    "crosstab_ari": f"""
        with t as (select c_mktsegment as a, n_regionkey as b, count(*)::double as n from {_L} group by 1, 2), x as (select sum(n * (n - 1) / 2) as v from t), pa as (select sum(n * (n - 1) / 2) as v from (select sum(n) as n from t group by a)),
        pb as (select sum(n * (n - 1) / 2) as v from (select sum(n) as n from t group by b)), pn as (select sum(n) * (sum(n) - 1) / 2 as v from t)
        select round((x.v - pa.v * pb.v / pn.v) / ((pa.v + pb.v) / 2 - pa.v * pb.v / pn.v), 7) as ari from x, pa, pb, pn""",
    "jaccard_overlap": f"with t as (select c_mktsegment, n_regionkey, count(*)::double as n from {_L} group by 1, 2), a as (select c_mktsegment, sum(n) as na from t group by 1), b as (select n_regionkey, sum(n) as nb from t group by 1) select c_mktsegment, n_regionkey, round(n / (na + nb - n), 6) as jaccard from t join a using (c_mktsegment) join b using (n_regionkey)",
    "movers_counts": f"""
        with l as (select n_regionkey as ref, (c_custkey % 5)::int as own from {_L}), k as (select distinct ref as class from l union select distinct own from l),
        g as (select class, count(*) filter (ref = class and own = class) as n_stayers, count(*) filter (ref = class and own <> class) as n_leavers, count(*) filter (ref <> class and own = class) as n_joiners from k, l where ref = class or own = class group by class)
        select *, round((n_leavers + n_joiners) / (n_stayers + n_leavers + n_joiners), 5) as churn from g""",
    "fluctuation_cumsum": """
        with w as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as sd, count(*) as n from orders), d as (select o_orderdate::date as day, sum(o_totalprice) as s, count(*) as k from orders group by 1)
        select day::varchar as day, round(sum((s - k * m) / sd / sqrt(n)) over (order by day), 5) + 0.0::double as process from d, w""",
    "mean_ranks": "select p_partkey, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 as r from part",
}
