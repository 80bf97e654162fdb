"""Cohort queries on the given tables: customers are people, their orders and items instruments.

Each function's name is its query's; ORACLES has the same query as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import ages
from terrane.operators import cohort as K
from terrane.plans.common import table


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))


def _items(spark, sf):
    l = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return l.groupBy(F.col("o_custkey").alias("id")).agg(F.sum("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"))


def _totals(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spent"))


def _people(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").alias("nation"))


def cohort_inner_complete(spark, sf):
    m = K.integrate([_people(spark, sf), _totals(spark, sf), _items(spark, sf)], "id")
    return m.select("id", "nation", "n_orders", *(F.round(c, 2).alias(c) for c in ("balance", "spent", "quantity", "discount")))


def cohort_outer(spark, sf):
    late = _totals(spark, sf).where("n_orders > 9")
    joined = _people(spark, sf).join(late, "id", "full_outer")
    return joined.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.count("n_orders").alias("n_with_orders"), F.count_if(F.col("balance").isNotNull() & F.col("n_orders").isNotNull()).alias("n_complete"))


def union_common_drop_dups(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("group"), "c_name")
    b = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.lit(0).alias("group"))
    return K.drop_repeated(K.union_common(a, b), "id")


def axis_keep_first(spark, sf):
    first = K.keep_first(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"])
    return _people(spark, sf).join(first.select(F.col("o_custkey").alias("id"), "o_orderkey", F.year("o_orderdate").alias("year")), "id", "left").select("id", "o_orderkey", "year")


def family_coalesce(spark, sf):
    fam = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("id")).agg((F.min("o_orderkey") % 100).alias("family"))
    return K.family_ids(_people(spark, sf), fam, "id", "family")


def cutoff_gate(spark, sf):
    return K.within_cutoff(_orders(spark, sf), "year", 1999).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def derived_year_gate(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", (F.col("o_orderkey") % 97 / 10.0).alias("age_at_eval"))
    r = _people(spark, sf).select("id", (F.lit(1990) + F.col("nation") % 7).alias("registration_year"), (F.col("id") % 13 / 2.0).alias("age_at_registration"))
    return K.derived_year_within(o, r, "id", 1994).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def _axes(spark, sf):
    c = table(spark, sf, "customer")
    return K.derive_axes(c.select(F.col("c_custkey").alias("id"), F.abs("c_acctbal").alias("diagnosis_months"), (F.lit(1990) + F.col("c_nationkey")).alias("registration_year"), (F.col("c_custkey") % 17).alias("registration_age"), (F.col("c_custkey") % 23).alias("eval_age")).withColumn("diagnosis_months", F.floor(F.col("diagnosis_months")) / 32))


def derive_axes(spark, sf):
    return _axes(spark, sf).select("id", *(F.round(c, 3).alias(c) for c in ("age", "year", "lag")))


def axis_coverage(spark, sf):
    got = K.coverage(_axes(spark, sf), ["age", "year", "lag"])
    return got.select("axis", "n_present", "n_missing", *(F.round(c, 4).alias(c) for c in ("coverage", "p5", "p25", "p50", "p75", "p95")))


def parent_self_join(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") * 7 % 1500 + 1).alias("parent"), (F.col("c_custkey") % 61).alias("age"))
    return K.parent_age_at_birth(c, "c_custkey", "parent", "age")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def one_hot_missing(spark, sf):
    o = table(spark, sf, "orders").withColumn("p", F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")))
    h = K.one_hot(o, "o_orderkey", "p", "p", [x for x in PRIORITIES if not x.startswith("4")])
    return h.agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"p{i}").alias(f"p{i}") for i in (1, 2, 3)), F.count("p1").alias("n_present"))


def recode_ordinal(spark, sf):
    ranks = {p: i for i, p in enumerate(PRIORITIES) if i != 3}
    return table(spark, sf, "orders").select(K.ordinal(F.col("o_orderpriority"), ranks).alias("rank"), K.binary(F.col("o_orderstatus"), ["F"], ["O"]).alias("final")).groupBy("rank", "final").agg(F.count(F.lit(1)).alias("n"))


KINDS = ["click", "error", "purchase", "signup", "view"]


def multi_flag_or_null(spark, sf):
    e = table(spark, sf, "events").where("value > 90").groupBy("user_id").pivot("event_type", KINDS).agg(F.max(F.lit(1)))
    users = table(spark, sf, "events").select("user_id").distinct()
    return K.flags_or_null(users.join(e, "user_id", "left"), KINDS).select("user_id", *KINDS)


def contemporaneity(spark, sf):
    o = _orders(spark, sf).groupBy("o_custkey").agg(*(F.min(F.when(F.col("o_orderpriority") == p, F.col("year"))).alias(f"y{i}") for i, p in enumerate(PRIORITIES[:3])), F.min("year").alias("d"))
    got = K.contemporaneity(o, ["y0", "y1", "y2"], "d")
    return got.select(*(F.round(c, 4).alias(c) for c in got.columns))


def milestone_ages(spark, sf):
    """Ages written as text in several ways, parsed back to months."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 60 + 1).alias("n"))
    k, n = F.col("p_partkey") % 8, F.col("n")
    ways = [
        F.concat(n, F.lit(" months")), F.concat(n, F.lit(" mos - "), n + 2, F.lit(" mos")), F.concat(F.lit("approx. "), n % 6, F.lit(" years")), F.concat(F.lit("circa "), n, F.lit(" moths")),
        F.concat(F.lit("less than "), n, F.lit(" mths")), F.lit("has not walked"), F.concat(F.lit("before "), n), F.concat(F.lit("Almost "), n % 6, F.lit(" yrs 3 mnths old")),
    ]
    said = F.element_at(F.array(*ways), (k + 1).cast("int"))
    return p.select("p_partkey", ages.age_months(said).alias("months"))


QUERIES = {
    f.__name__: f
    for f in (cohort_inner_complete, cohort_outer, union_common_drop_dups, axis_keep_first, family_coalesce, cutoff_gate, derived_year_gate, derive_axes, axis_coverage, parent_self_join, one_hot_missing, recode_ordinal, multi_flag_or_null, contemporaneity, milestone_ages)
}

_AXES = """(select id, case when age between 0 and 18 then age end as age, case when ry - ra + age between 1985 and 2026 then ry - ra + age end as year, case when ea - age >= -1 then ea - age end as lag
    from (select c_custkey as id, floor(abs(c_acctbal)) / 32 / 12 as age, 1990 + c_nationkey as ry, c_custkey % 17 as ra, c_custkey % 23 as ea from customer))"""

ORACLES = {
    "cohort_inner_complete": """
        select c_custkey as id, c_nationkey::double as nation, n_orders::double as n_orders, round(c_acctbal, 2) as balance, round(spent, 2) as spent, round(quantity, 2) as quantity, round(discount, 2) as discount
        from customer join (select o_custkey, count(*) as n_orders, sum(o_totalprice) as spent from orders group by 1) o on o.o_custkey = c_custkey
        join (select o_custkey, sum(l_quantity) as quantity, max(l_discount) as discount from lineitem join orders on l_orderkey = o_orderkey group by 1) l on l.o_custkey = c_custkey where c_acctbal > 0""",
    "cohort_outer": """
        with t as (select o_custkey as id, count(*) as n_orders from orders group by 1 having count(*) > 9), p as (select c_custkey as id, case when c_acctbal > 0 then c_acctbal end as balance, c_nationkey as nation from customer)
        select nation, count(*) as n, count(n_orders) as n_with_orders, count(*) filter (balance is not null and n_orders is not null) as n_complete from p full join t using (id) group by nation""",
    "union_common_drop_dups": """
        with u as (select c_custkey as id, c_nationkey as "group" from customer union all select o_custkey, 0 from orders where o_orderstatus = 'F')
        select id, "group" from u where id in (select id from u group by id having count(*) = 1)""",
    "axis_keep_first": "select c_custkey as id, o_orderkey, year(o_orderdate)::int as year from customer left join (select *, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) o on o_custkey = c_custkey and r = 1",
    "family_coalesce": "select c_custkey as id, coalesce((f % 100)::varchar, c_custkey::varchar) as family from customer left join (select o_custkey, min(o_orderkey) as f from orders where o_orderpriority = '1-URGENT' group by 1) on o_custkey = c_custkey",
    "cutoff_gate": "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders where year(o_orderdate) <= 1999 group by 1",
    "derived_year_gate": "select o_custkey as id, count(*) as n from orders join customer on o_custkey = c_custkey where 1990 + c_nationkey % 7 + (o_orderkey % 97 / 10.0 - c_custkey % 13 / 2.0) < 1995 group by 1",
    "derive_axes": f"select id, round(age, 3) as age, round(year, 3) as year, round(lag, 3) as lag from {_AXES}",
    "axis_coverage": f"""
        with a as (select 'age' as axis, age as x from {_AXES} union all select 'year', year from {_AXES} union all select 'lag', lag from {_AXES})
        select axis, count(x) as n_present, count(*) - count(x) as n_missing, round(count(x) / count(*), 4) as coverage, {", ".join(f"round(quantile_cont(x, {p / 100}), 4) as p{p}" for p in (5, 25, 50, 75, 95))} from a group by axis""",
    "parent_self_join": "with c as (select c_custkey, c_custkey * 7 % 1500 + 1 as parent, c_custkey % 61 as age from customer) select a.c_custkey, case when b.age - a.age between 12 and 60 then b.age - a.age end as parent_age from c a left join c b on a.parent = b.c_custkey",
    "one_hot_missing": "select count(*) as n, count(*) filter (o_orderpriority = '2-HIGH') as p1, count(*) filter (o_orderpriority = '3-MEDIUM') as p2, count(*) filter (o_orderpriority = '5-LOW') as p3, count(*) filter (o_orderpriority <> '4-NOT SPECIFIED') as n_present from orders",
    "recode_ordinal": "select case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 when '5-LOW' then 4 end::int as rank, case o_orderstatus when 'F' then 1 when 'O' then 0 end::int as final, count(*) as n from orders group by 1, 2",
    "multi_flag_or_null": f"select user_id, {', '.join(f'case when count(*) filter (value > 90) > 0 then (count(*) filter (value > 90 and event_type = {chr(39)}{k}{chr(39)}) > 0)::int end as {k}' for k in KINDS)} from events group by user_id",
    "contemporaneity": """
        with y as (select o_custkey, min(year(o_orderdate)) filter (o_orderpriority = '1-URGENT') as y0, min(year(o_orderdate)) filter (o_orderpriority = '2-HIGH') as y1, min(year(o_orderdate)) filter (o_orderpriority = '3-MEDIUM') as y2, min(year(o_orderdate)) as d from orders group by 1),
        r as (select greatest(y0, y1, y2) - least(y0, y1, y2) as span, list_avg(list_filter([y0, y1, y2], lambda x: x is not null)) - d as after from y)
        select round(quantile_cont(span, 0.5), 4) as median_span, round(quantile_cont(span, 0.9), 4) as p90_span, round(avg((span > 1)::int), 4) as share_over_1, round(quantile_cont(after, 0.5), 4) as median_after from r""",
    "milestone_ages": "with p as (select p_partkey, p_size % 60 + 1 as n from part) select p_partkey, case p_partkey % 8 when 0 then n when 1 then n + 1 when 2 then (n % 6) * 12 when 3 then n when 4 then n when 5 then 888 when 7 then (n % 6) * 12 + 3 end::double as months from p",
}
