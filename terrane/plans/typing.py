"""Feature types and sweeps on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import mixture as M
from terrane.operators import refits as R
from terrane.operators import schemes as H
from terrane.operators import typing as T
from terrane.plans.common import table


def _long(spark, sf):
    e = table(spark, sf, "orders")
    return e.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in ("o_orderstatus", "o_orderpriority", "o_custkey")))))


def observed_cardinality(spark, sf):
    return T.observed_cardinality(_long(spark, sf))


def _dictionary(spark, sf):
    p = table(spark, sf, "part")
    kind = F.element_at(F.array(F.lit("radio"), F.lit("dropdown"), F.lit("text"), F.lit("calculated")), (F.col("p_size") % 4 + 1).cast("int"))
    values = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("p_size") % 3 + 1).cast("int")), lambda i: F.concat(i.cast("string"), F.lit("=x"))), "\n")
    return p.select((F.col("p_partkey") % 400).cast("string").alias("name"), F.col("p_type").alias("table_name"), kind.alias("field_type"), values.alias("values"), "p_size", "p_partkey")


def _order(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("table_name")).agg(F.min("p_partkey").alias("position"))


def feature_types(spark, sf):
    """Types by the first instrument's dictionary, and by lists that have a name once."""
    d = _dictionary(spark, sf)
    listed = d.where("p_partkey % 6 = 0").select("name", F.when(F.col("p_size") > 25, "binary").otherwise("continuous").alias("type"))
    seen = d.select(F.col("name").alias("feature"), F.col("p_size").cast("string").alias("value"))
    return T.reconcile(T.dictionary_types(d, _order(spark, sf)).drop("instrument"), T.listed_types(listed), T.observed_cardinality(seen))


def sweep_decision(spark, sf):
    """Segments' prices and balances in five equal bins of time, against places dealt anew."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    long = o.select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("class"), F.unix_date(F.to_date("o_orderdate")).alias("day"), F.inline(F.array(F.struct(F.lit("price").alias("feature"), F.col("o_totalprice").alias("value")), F.struct(F.lit("balance").alias("feature"), F.col("c_acctbal").alias("value")))))
    return H.sweep(long, "day", "id", H.parse_scheme("hardbins:quantile:5"), n_perm=999)


def sweep_refits(spark, sf):
    """Classes of customers, fitted anew in three equal bins of their first order's day, against 999
    dealings of the days whose bins are fitted anew as well."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).cast("double").alias("n_orders"), F.min(F.unix_date(F.to_date("o_orderdate"))).cast("double").alias("first"))
    rows = table(spark, sf, "customer").join(o, "c_custkey")
    columns = M.Columns(["c_acctbal", "price", "n_orders"])
    pooled = M.fit(rows, "c_custkey", columns, 2, n_init=20)
    return R.sweep_refits(rows, "c_custkey", "first", columns, H.parse_scheme("hardbins:quantile:3"), pooled)


QUERIES = {f.__name__: f for f in (observed_cardinality, feature_types, sweep_decision, sweep_refits)}
ORACLES = {
    "observed_cardinality": "select 'o_orderstatus' as feature, count(distinct o_orderstatus) as n_distinct from orders union all select 'o_orderpriority', count(distinct o_orderpriority) from orders union all select 'o_custkey', count(distinct o_custkey) from orders",
    "feature_types": """
        with d as (select (p_partkey % 400)::varchar as name, p_type, p_size, p_partkey, case p_size % 4 when 0 then 'radio' when 1 then 'dropdown' when 2 then 'text' else 'calculated' end as kind, p_size % 3 + 1 as levels from part),
        o as (select p_type, min(p_partkey) as position from part group by 1), t as (select name, position, case when kind in ('calculated', 'dropdown') then 'continuous' when kind = 'radio' and levels = 2 then 'binary' else 'categorical' end as type from d join o using (p_type)),
        f as (select name, min(type) as dt from t where (name, position) in (select (name, min(position)) from t group by name) group by name),
        l as (select name, min(case when p_size > 25 then 'binary' else 'continuous' end) as lt from d where p_partkey % 6 = 0 group by name having count(*) = 1), s as (select name, count(distinct p_size) as n_distinct from d group by 1)
        select name, coalesce(lt, dt) as type, lt = dt as agree, case when coalesce(lt, dt) = 'binary' then n_distinct <= 2 else true end as consistent, n_distinct from f full join l using (name) left join s using (name)""",
}
