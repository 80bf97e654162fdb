"""Class statistics on the given tables: embeddings are the matrix, their labels the classes.

Each function's name is its query's; ORACLES has the same query as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import stats
from terrane.operators import drift as D
from terrane.operators import enrichment as E
from terrane.operators import strata as S
from terrane.plans.common import table


def _long(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("class"), F.posexplode("embedding").alias("feature", "x")).select("id", "class", "feature", F.col("x").cast("double").alias("value"))


def class_centroids(spark, sf):
    return D.centroids(_long(spark, sf), ["class"]).select("class", "feature", F.round("mean", 6).alias("mean"))


def weighted_class_stats(spark, sf):
    w = S.gaussian_weight(F.col("id").cast("double"), F.lit(100.0), 80.0)
    got = D.centroids(_long(spark, sf), ["class"], w)
    return got.select("class", "feature", F.round("w", 4).alias("w"), F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"))


def class_separation(spark, sf):
    l = _long(spark, sf)
    got = D.class_separation(D.centroids(l, ["class"]), "class", D.pooled_sd(l))
    return got.select(F.round("full", 5).alias("full"), F.round("rms", 5).alias("rms"))


def _shift(spark, sf):
    l = _long(spark, sf)
    odd = D.centroids(l.where("id % 2 = 1"), ["class"])
    return D.displacements(odd, D.centroids(l, ["class"]), ["class"], D.pooled_sd(l))


def drift_distances(spark, sf):
    got = D.distances(_shift(spark, sf), ["class"])
    return got.select("class", *(F.round(c, 6).alias(c) for c in ("rms", "full", "mean_abs")))


def category_totals(spark, sf):
    got = D.category_totals(_shift(spark, sf), ["class"], F.col("feature") % 7)
    return got.select("class", "category", "n_features", *(F.round(c, 6).alias(c) for c in ("total", "share", "rms")))


def univariate_contrast(spark, sf):
    got = E.univariate_contrast(_long(spark, sf).withColumn("moved", F.col("id") % 3 == 0), "moved")
    return got.select("feature", *(F.round(c, 5).alias(c) for c in ("effect", "t", "df")))


def contrast_p_values(spark, sf):
    """p of each feature's contrast, adjusted and rejected at 5 %."""
    got = E.univariate_contrast(_long(spark, sf).withColumn("moved", F.col("class") == 0), "moved")
    return stats.bh_reject(stats.bh_adjusted(got, "p"), "p")


def _features(spark, sf):
    """Long form of customers' features by market segment; two are flags."""
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("price"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"))
    j = c.join(o, "c_custkey").withColumns({"rich": (F.col("c_acctbal") > 5000).cast("int")})
    return stats.long_form(j.withColumnRenamed("c_mktsegment", "class").withColumnRenamed("c_custkey", "id"), ["id", "class"], ["c_acctbal", "n_orders", "price", "urgent", "rich"])


def enrichment_moments(spark, sf):
    got = E.class_moments(_features(spark, sf))
    return got.select("feature", "class", "is_binary", "n", *(F.round(c, 4).alias(c) for c in ("mean", "mean_rest", "mean_all")), *(F.round(F.col(c) / (F.col("mean_all") * F.col("mean_all")), 5).alias(c) for c in ("var", "var_rest", "var_all")))


def enrichment_direction(spark, sf):
    """Effects and directions (tested, adjusted) of each feature in each class."""
    return E.enrichment(_features(spark, sf))


def signature(spark, sf):
    e = E.enrichment(_features(spark, sf), q=0.5)
    cats = e.select("feature", F.when(F.col("feature").isin("urgent", "rich"), "flags").otherwise("amounts").alias("category")).distinct()
    return E.signature(e, cats)


def profile_corr(spark, sf):
    l = _long(spark, sf)
    cells = l.groupBy("class", F.col("feature").alias("category"), (F.col("id") % 2).alias("half")).agg(F.avg("value").alias("value"))
    got = E.profile_correlation(cells.where("half = 0"), cells.where("half = 1"))
    return got.select(F.round("r", 6).alias("r"), "n")


def _p(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 9 != 0, (F.col("p_partkey") * 7919 % 10007) / 10007.0 * (F.col("p_size") / 50.0) * 0.5).alias("p"))


def bh_mask(spark, sf):
    return stats.bh_reject(_p(spark, sf), "p", ["p_brand"], q=0.2).select("p_partkey", "reject")


def bh_adjusted(spark, sf):
    return stats.bh_adjusted(_p(spark, sf), "p", ["p_brand"]).select("p_partkey", F.round("p_adjusted", 7).alias("p_adjusted"))


def add_one_p(spark, sf):
    e = table(spark, sf, "events")
    obs = e.groupBy("event_type").agg(F.avg("value").alias("value"))
    null = e.groupBy("event_type", "user_id").agg(F.avg("value").alias("draw")).select("event_type", "draw")
    got = D.read_against_null(obs, null, ["event_type"])
    return got.select("event_type", F.round("value", 4).alias("value"), F.round("null_p95", 4).alias("null_p95"), "exceeds_p95", F.round("p_value", 6).alias("p_value"), "n_null")


def _focal_centroids(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("class"), (F.datediff("o_orderdate", F.lit("1995-01-01")) / 365.25).alias("x"), F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"))
    at = S.at_focals(o, [1.0, 2.5, 4.0, 5.5])
    stacked = at.select("class", "position", "focal", "x", F.inline(F.array(F.struct(F.lit("price").alias("feature"), F.col("price").alias("value")), F.struct(F.lit("balance").alias("feature"), F.col("balance").alias("value")))))
    return D.centroids(stacked, ["class", "position", "focal"], S.gaussian_weight(F.col("x"), F.col("focal"), 0.7))


def local_centroids(spark, sf):
    return _focal_centroids(spark, sf).select("class", "position", "focal", "feature", F.round("w", 3).alias("w"), F.round("mean", 2).alias("mean"))


def slope_per_feature(spark, sf):
    got = D.slopes(_focal_centroids(spark, sf), ["class", "feature"], "focal", "mean")
    return got.select("class", "feature", F.round("slope", 3).alias("slope"), F.round("r2", 5).alias("r2"), "n")


def axis_r2(spark, sf):
    o = table(spark, sf, "orders").withColumns({"x": F.dayofyear("o_orderdate"), "g": F.col("o_orderstatus")})
    got = D.slopes(o, ["g"], "x", "o_totalprice")
    return got.select("g", F.round("r2", 8).alias("r2"), "n")


def residualise(spark, sf):
    got = D.residualise(table(spark, sf, "customer"), "c_acctbal", "c_nationkey", "residual")
    return got.select("c_custkey", F.round("residual", 4).alias("residual"))


def grain_magnitude(spark, sf):
    l = _long(spark, sf)
    sep = D.class_separation(D.centroids(l, ["class"]), "class", D.pooled_sd(l))
    z = _shift(spark, sf).withColumn("grain", F.col("feature") % 4)
    got = D.distances(z, ["class", "grain"]).crossJoin(F.broadcast(sep.select(F.col("full").alias("scale"))))  # one row
    return got.select("class", "grain", F.round(F.col("full") / F.col("scale"), 6).alias("magnitude"))


def endpoint_share_window(spark, sf):
    """Each item's share of its order, and the order's part of its month."""
    w = Window.partitionBy("l_orderkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / F.sum("l_extendedprice").over(w), 6).alias("share"))


def top5_per_group(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"))
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("quantity"), "l_suppkey")
    return g.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("l_returnflag", "l_suppkey", F.round("quantity", 2).alias("quantity"), "rank")


def pairings(spark, sf):
    """Adjacent strata by position: each year's orders against the year before."""
    y = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return D.pairings(y.withColumn("position", F.col("stratum")), "position")


QUERIES = {
    f.__name__: f
    for f in (
        class_centroids, weighted_class_stats, class_separation, drift_distances, category_totals, univariate_contrast, contrast_p_values, enrichment_moments, enrichment_direction, signature, profile_corr, bh_mask, bh_adjusted, add_one_p, local_centroids,
        slope_per_feature, axis_r2, residualise, grain_magnitude, endpoint_share_window, top5_per_group, pairings,
    )
}

_LONG = '(select vec_id as id, label as class, unnest(embedding)::double as value, (generate_subscripts(embedding, 1) - 1)::int as feature from embeddings)'
_MEANS = f"(select class, feature, avg(value) as mean from {_LONG} group by 1, 2)"
_SD = f"(select feature, stddev_samp(value) as sd from {_LONG} group by 1)"
_Z = f"(select a.class, a.feature, (a.mean - b.mean) / s.sd as z from (select class, feature, avg(value) as mean from {_LONG} where id % 2 = 1 group by 1, 2) a join {_MEANS} b using (class, feature) join {_SD} s on s.feature = a.feature)"
_SEP = f"(select avg(f) as full, avg(r) as rms from (select sqrt(sum(z * z)) as f, sqrt(avg(z * z)) as r from (select a.class as ka, b.class as kb, (a.mean - b.mean) / s.sd as z from {_MEANS} a join {_MEANS} b on a.feature = b.feature and a.class < b.class join {_SD} s on s.feature = a.feature) group by ka, kb))"
_P = "(select p_partkey, p_brand, case when p_size % 9 <> 0 then (p_partkey * 7919 % 10007) / 10007.0::double * (p_size / 50.0::double) * 0.5 end as p from part)"
_FC = """(with o as (select c_mktsegment as class, date_diff('day', date '1995-01-01', o_orderdate::date) / 365.25 as x, o_totalprice, c_acctbal from orders join customer on o_custkey = c_custkey),
    l as (select class, x, 'price' as feature, o_totalprice as value from o union all select class, x, 'balance', c_acctbal from o), f as (select unnest([0, 1, 2, 3])::int as position, unnest([1.0, 2.5, 4.0, 5.5])::double as focal)
    select class, position, focal, feature, sum(exp(-0.5 * ((x - focal) / 0.7) ** 2)) as w, sum(exp(-0.5 * ((x - focal) / 0.7) ** 2) * value) / sum(exp(-0.5 * ((x - focal) / 0.7) ** 2)) as mean from l, f group by 1, 2, 3, 4)"""
_FEATURES = """(with j as (select c_custkey as id, c_mktsegment as class, c_acctbal, n_orders, price, urgent, (c_acctbal > 5000)::int as rich from customer join (select o_custkey, count(*) as n_orders, avg(o_totalprice) as price, max((o_orderpriority = '1-URGENT')::int) as urgent from orders group by 1) on o_custkey = c_custkey)
    select id, class, unnest(['c_acctbal', 'n_orders', 'price', 'urgent', 'rich']) as feature, unnest([c_acctbal, n_orders, price, urgent, rich])::double as value from j)"""

ORACLES = {
    "class_centroids": f"select class, feature, round(mean, 6) as mean from {_MEANS}",
    "weighted_class_stats": f"with l as (select *, exp(-0.5 * ((id - 100.0) / 80.0) ** 2) as w from {_LONG}), g as (select class, feature, sum(w) as w, sum(w * value) / sum(w) as mean, sum(w * value * value) / sum(w) as sq from l group by 1, 2) select class, feature, round(w, 4) as w, round(mean, 5) as mean, round(sqrt(greatest(0, sq - mean * mean)), 5) as sd from g",
    "class_separation": f"select round(full, 5) as full, round(rms, 5) as rms from {_SEP}".replace("select round(full, 5) as full", 'select round("full", 5) as "full"').replace("avg(f) as full", 'avg(f) as "full"'),
    "drift_distances": f'select class, round(sqrt(avg(z * z)), 6) as rms, round(sqrt(sum(z * z)), 6) as "full", round(avg(abs(z)), 6) as mean_abs from {_Z} group by class',
    "category_totals": f"with g as (select class, feature % 7 as category, count(*) as n_features, sum(z * z) as total from {_Z} group by 1, 2) select class, category, n_features, round(total, 6) as total, round(total / sum(total) over (partition by class), 6) as share, round(sqrt(total / n_features), 6) as rms from g",
    "univariate_contrast": f"""
        with g as (select feature, count(*) filter (id % 3 = 0) as n0, count(*) filter (id % 3 <> 0) as n1, avg(value) filter (id % 3 = 0) as m0, avg(value) filter (id % 3 <> 0) as m1, var_samp(value) filter (id % 3 = 0) as v0, var_samp(value) filter (id % 3 <> 0) as v1 from {_LONG} group by 1)
        select feature, round((m0 - m1) / sqrt((v0 + v1) / 2), 5) as effect, round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 5) as t, round((v0 / n0 + v1 / n1) ** 2 / ((v0 / n0) ** 2 / (n0 - 1) + (v1 / n1) ** 2 / (n1 - 1)), 5) as df from g""",
    "enrichment_moments": f"""
        with l as (select * from {_FEATURES}), a as (select feature, avg(value) as mean_all, var_samp(value) as var_all, count(distinct value) = 2 and min(value) = 0 and max(value) = 1 as is_binary from l group by 1),
        k as (select distinct class from l), g as (select l.feature, k.class, count(*) filter (l.class = k.class) as n, avg(value) filter (l.class = k.class) as mean, var_samp(value) filter (l.class = k.class) as var, avg(value) filter (l.class <> k.class) as mean_rest, var_samp(value) filter (l.class <> k.class) as var_rest from l, k group by 1, 2)
        select feature, class, is_binary, n, round(mean, 4) as mean, round(mean_rest, 4) as mean_rest, round(mean_all, 4) as mean_all, round(var / (mean_all * mean_all), 5) as var, round(var_rest / (mean_all * mean_all), 5) as var_rest, round(var_all / (mean_all * mean_all), 5) as var_all from g join a using (feature)""",
    "profile_corr": f"with c as (select class, feature, id % 2 as half, avg(value) as v from {_LONG} group by 1, 2, 3) select round(corr(a.v, b.v), 6) as r, count(*) as n from c a join c b using (class, feature) where a.half = 0 and b.half = 1",
    "bh_mask": f"with r as (select *, row_number() over (partition by p_brand order by p) as k, count(p) over (partition by p_brand) as m from {_P} where p is not null), c as (select p_brand, max(p) as most from r where p <= 0.2 * k / m group by 1) select p_partkey, coalesce(p <= most, false) as reject from {_P} left join c using (p_brand)",
    "bh_adjusted": f"with r as (select *, row_number() over (partition by p_brand order by p) as k, count(p) over (partition by p_brand) as m from {_P} where p is not null) select p_partkey, round(least(1.0, min(p * m / k) over (partition by p_brand order by p desc range between unbounded preceding and current row)), 7) as p_adjusted from r union all select p_partkey, null from {_P} where p is null",
    "add_one_p": "with o as (select event_type, avg(value) as value from events group by 1), n as (select event_type, user_id, avg(value) as draw from events group by 1, 2) select event_type, round(value, 4) as value, round(quantile_cont(draw, 0.95), 4) as null_p95, value > quantile_cont(draw, 0.95) as exceeds_p95, round((1 + count(*) filter (draw >= value)) / (1.0 + count(*)), 6) as p_value, count(*) as n_null from o join n using (event_type) group by event_type, value",
    "local_centroids": f"select class, position, focal, feature, round(w, 3) as w, round(mean, 2) as mean from {_FC}",
    "slope_per_feature": f"select class, feature, round(regr_slope(mean, focal), 3) as slope, round(regr_r2(mean, focal), 5) as r2, count(*) as n from {_FC} group by 1, 2",
    "axis_r2": "select o_orderstatus as g, round(regr_r2(o_totalprice, dayofyear(o_orderdate)), 8) as r2, count(*) as n from orders group by 1",
    "residualise": "with f as (select regr_slope(c_acctbal, c_nationkey) as b, regr_intercept(c_acctbal, c_nationkey) as a from customer) select c_custkey, round(c_acctbal - a - b * c_nationkey, 4) as residual from customer, f",
    "grain_magnitude": f'select class, feature % 4 as grain, round(sqrt(sum(z * z)) / (select "full" from {_SEP}), 6) as magnitude from {_Z} group by 1, 2'.replace("avg(f) as full", 'avg(f) as "full"'),
    "endpoint_share_window": "select l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) over (partition by l_orderkey), 6) as share from lineitem",
    "top5_per_group": "select l_returnflag, l_suppkey, round(quantity, 2) as quantity, rank::int as rank from (select l_returnflag, l_suppkey, sum(l_quantity) as quantity, row_number() over (partition by l_returnflag order by sum(l_quantity) desc, l_suppkey) as rank from lineitem group by 1, 2) where rank <= 5",
    "pairings": "with y as (select distinct year(o_orderdate)::int as s from orders) select a.s as query, b.s as reference from y a join y b on a.s = b.s + 1",
}
