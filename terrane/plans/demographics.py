"""Recodes, demographic tables, roughness, contrasts and invariance on the given tables.

Each function's name is its query's; ORACLES has the same query as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import cohort as K
from terrane.operators import drift as D
from terrane.operators import enrichment as E
from terrane.operators import inference as I
from terrane.operators import strata as S
from terrane.plans.common import table
from terrane.plans.drift import _long


def recode_counts(spark, sf):
    p = table(spark, sf, "part")
    said = F.when(F.col("p_size") % 5 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.col("p_size")))
    flag = F.when(F.col("p_size") % 3 == 0, F.lit("1")).when(F.col("p_size") % 3 == 1, F.lit(""))
    return p.select("p_partkey", K.count(said).alias("number"), K.calculated_flag(flag).alias("flag"))


def collapsed_one_hot(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    groups = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("value"), F.col("r_name").alias("group"))
    return K.collapsed_one_hot(table(spark, sf, "customer"), "c_custkey", "c_nationkey", groups, "region", ["AFRICA", "AMERICA", "ASIA", "EUROPE"])


def category_map_last(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("category"), "o_orderkey")
    return K.last_by_key(o, "k", "category", "o_orderkey")


def matrix_split(spark, sf):
    c = table(spark, sf, "customer")
    x, z = K.build_matrix(c, "c_custkey", K.shared_features(["c_acctbal", "c_phone", "c_nationkey"], ["c_nationkey", "c_acctbal"]), ["c_mktsegment"])
    return x.join(z, "c_custkey").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("balance"), F.sum("c_nationkey").alias("nations"))


def impaired_dichotomy(spark, sf):
    c = table(spark, sf, "customer").withColumn("band", S.dichotomy(F.col("c_acctbal"), 1000.0, True))
    return c.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("c_acctbal"), 2).alias("most"))


def demographic_table(spark, sf):
    c = table(spark, sf, "customer").withColumns({"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey"), "in_debt": (F.col("c_acctbal") < 0).cast("int")})
    return S.demographic_table(c, "segment", ["nation", "in_debt"]).select("segment", "covariate", "n", F.round("mean", 5).alias("mean"), F.round("smd", 5).alias("smd"))


def random_axis(spark, sf):
    """Shares of rows below points of an axis without meaning: about these points."""
    x = table(spark, sf, "orders").select(K.random_axis(F.col("o_orderkey"), 7).alias("x"))
    return x.agg(*(F.abs(F.avg((F.col("x") < q / 4).cast("double")) - q / 4).alias(f"off{q}") for q in (1, 2, 3))).select((F.greatest("off1", "off2", "off3") < 0.05).alias("even"))


def _strata(spark, sf):
    return _long(spark, sf).withColumn("stratum", (F.col("id") % 4).cast("int"))


def _steps(spark, sf):
    l = _strata(spark, sf)
    sd = D.pooled_sd(l)
    means = l.groupBy("class", "stratum", "feature").agg(F.avg("value").alias("m")).join(sd, "feature").select("class", "stratum", "feature", (F.col("m") / F.col("pooled")).alias("z"))
    return l, sd, means


def roughness(spark, sf):
    l, sd, means = _steps(spark, sf)
    sizes = l.where("feature = 0").groupBy("class", "stratum").agg(F.count(F.lit(1)).alias("n"))
    within = l.groupBy("class", "feature").agg(F.stddev_samp("value").alias("s")).join(sd, "feature").select("class", "feature", (F.col("s") / F.col("pooled")).alias("sd"))
    got = D.roughness(means, ["class"], "stratum", sizes, within)
    return got.select("class", *(F.round(c, 5).alias(c) for c in ("step", "sampling_noise", "snr")))


def _moved(spark, sf):
    """Displacements of each stratum's class means from the class's."""
    l = _strata(spark, sf)
    whole = l.groupBy("class", "feature").agg(F.avg("value").alias("mean"))
    local = l.groupBy("class", "stratum", "feature").agg(F.avg("value").alias("m"))
    j = local.join(whole, ["class", "feature"]).join(D.pooled_sd(l), "feature")
    return j.select("class", "stratum", "feature", ((F.col("m") - F.col("mean")) / F.col("pooled")).alias("z"))


def grain_contrast(spark, sf):
    z = _moved(spark, sf).where("stratum = 0")
    got = D.grain_contrast(z, ["class"], F.concat(F.lit("g"), F.col("feature") % 3), "g0", "g1")
    return got.select("class", *(F.round(c, 5).alias(c) for c in ("rms_a", "rms_b", "contrast", "share_a", "share_b")))


def profile_alignment(spark, sf):
    z = _moved(spark, sf)
    a, b = (D.distances(z.where(f"stratum = {k}"), ["class"]) for k in (0, 1))
    return D.profile_alignment(a, b, "class", "rms").select(F.round("alignment", 5).alias("alignment"))


def directional_statistic(spark, sf):
    got = D.directional_statistic(_moved(spark, sf), ["class"], "stratum")
    return got.select("class", *(F.round(c, 5).alias(c) for c in ("slope", "r2", "first", "last", "moved")))


def pooled_pairings(spark, sf):
    return D.pooled_pairings(_strata(spark, sf).select("stratum").distinct())


def logistic_contrast(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spent")), "c_custkey", "left")
    return E.logistic_contrast(c.withColumns({"in_debt": (F.col("c_acctbal") < 0).cast("int"), "constant": F.lit(1)}), "in_debt", ["c_nationkey", "n_orders", "spent", "constant"])


def invariance_whitened(spark, sf):
    """Whether the embeddings' classes drift along their ids, by all components at once."""
    e = table(spark, sf, "embeddings")
    grid = I.time_grid(e, "vec_id", 64)
    l = _long(spark, sf).join(grid, F.col("id") == F.col("vec_id"))
    return I.invariance_by_class(l.select("id", "grid", "class", F.lit(1.0).alias("r"), "feature", "value"))


def prevalence_joint_test(spark, sf):
    """Do segments' shares change with balance and nation together? The likelihood ratio."""
    c = table(spark, sf, "customer")
    names = [r[0] for r in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # a few segments
    hot = F.array(*((F.col("c_mktsegment") == n).cast("double") for n in names))
    rows = c.select((F.col("c_acctbal") / 5000).alias("balance"), (F.col("c_nationkey") / 12.0).alias("nation"), hot.alias("y"))
    stat, dof, p = I.joint_lrt(rows, ["balance", "nation"], ["nation"], "y", len(names))
    return spark.createDataFrame([(stat, dof, p)], "statistic double, dof int, p_value double")


QUERIES = {
    f.__name__: f
    for f in (recode_counts, collapsed_one_hot, category_map_last, matrix_split, impaired_dichotomy, demographic_table, random_axis, roughness, grain_contrast, profile_alignment, directional_statistic, pooled_pairings, logistic_contrast, invariance_whitened, prevalence_joint_test)
}

_L = "(select vec_id as id, label as class, unnest(range(0, len(embedding))) as feature, unnest(embedding)::double as value, vec_id % 4 as stratum from embeddings)"
_Z = f"""l as (select * from {_L}), sd as (select feature, stddev_samp(value) as pooled from l group by 1), w as (select class, feature, avg(value) as mean from l group by 1, 2),
        m as (select class, stratum, feature, avg(value) as m from l group by 1, 2, 3), z as (select class, stratum, feature, (m - mean) / pooled as z from m join w using (class, feature) join sd using (feature))"""

ORACLES = {
    "recode_counts": "select p_partkey, case when p_size % 5 = 0 then null else p_size::double end as number, case when p_size % 3 = 0 then 1 else 0 end as flag from part",
    "collapsed_one_hot": "select c_custkey, (r_name = 'AMERICA')::int as region1, (r_name = 'ASIA')::int as region2, (r_name = 'EUROPE')::int as region3 from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "category_map_last": "select o_custkey as k, arg_max(case when o_orderstatus = 'P' then 'unmapped' else o_orderstatus end, o_orderkey) as category from orders group by 1",
    "matrix_split": "select c_mktsegment, round(avg(c_acctbal), 4) as balance, sum(c_nationkey)::bigint as nations from customer group by 1",
    "impaired_dichotomy": "select case when c_acctbal < 1000 then 'impaired' else 'spared' end as band, count(*) as n, round(max(c_acctbal), 2) as most from customer group by 1",
    "demographic_table": """
        with l as (select c_mktsegment as segment, unnest(['nation', 'in_debt']) as covariate, unnest([c_nationkey::double, (c_acctbal < 0)::int::double]) as x from customer), s as (select distinct segment from l)
        select s.segment, covariate, count(*) filter (l.segment = s.segment) as n, round(avg(x) filter (l.segment = s.segment), 5) as mean,
        round((avg(x) filter (l.segment = s.segment) - avg(x) filter (l.segment <> s.segment)) / sqrt((var_samp(x) filter (l.segment = s.segment) + var_samp(x) filter (l.segment <> s.segment)) / 2), 5) as smd from s, l group by 1, 2""",
    "roughness": f"""
        with l as (select * from {_L}), sd as (select feature, stddev_samp(value) as pooled from l group by 1), m as (select class, stratum, feature, avg(value) / any_value(pooled) as z from l join sd using (feature) group by 1, 2, 3),
        d as (select class, stratum, z - lag(z) over (partition by class, feature order by stratum) as d from m), st as (select class, stratum, sqrt(sum(d * d)) as step from d where d is not null group by 1, 2),
        n as (select class, stratum, count(*) as n from l where feature = 0 group by 1, 2), sh as (select class, stratum, 1.0 / n + 1.0 / lag(n) over (partition by class order by stratum) as share from n),
        v as (select class, sum(s * s / (pooled * pooled)) as v from (select class, feature, stddev_samp(value) as s from l group by 1, 2) join sd using (feature) group by 1)
        select class, round(avg(step), 5) as step, round(avg(sqrt(v * share)), 5) as sampling_noise, round(avg(step / sqrt(v * share)), 5) as snr from st join sh using (class, stratum) join v using (class) group by 1""",
    "grain_contrast": f"""
        with {_Z}, g as (select class, feature % 3 as g, z * z as q from z where stratum = 0)
        select class, round(sqrt(avg(q) filter (g = 0)), 5) as rms_a, round(sqrt(avg(q) filter (g = 1)), 5) as rms_b, round(sqrt(avg(q) filter (g = 0)) - sqrt(avg(q) filter (g = 1)), 5) as contrast,
        round(sum(q) filter (g = 0) / sum(q), 5) as share_a, round(sum(q) filter (g = 1) / sum(q), 5) as share_b from g group by 1""",
    "profile_alignment": f"with {_Z}, r as (select class, sqrt(avg(z * z) filter (stratum = 0)) as a, sqrt(avg(z * z) filter (stratum = 1)) as b from z group by 1) select round(corr(a, b), 5) as alignment from r",
    "directional_statistic": f"""
        with {_Z}, m2 as (select class, feature, avg(z) as m from z group by 1, 2), n as (select class, sqrt(sum(m * m)) as norm from m2 group by 1),
        a as (select z.class, stratum, sum(z * m / norm) as along from z join m2 using (class, feature) join n using (class) group by 1, 2)
        select class, round(regr_slope(along, stratum), 5) as slope, round(regr_r2(along, stratum), 5) as r2, round(arg_min(along, stratum), 5) as first, round(arg_max(along, stratum), 5) as last,
        round(arg_max(along, stratum) - arg_min(along, stratum), 5) as moved from a group by 1""",
    "pooled_pairings": "select distinct (vec_id % 4)::int as query, 'pooled' as reference from embeddings",
}
