"""Replication, named classes and prevalence on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import drift as D
from terrane.operators import mixture as M
from terrane.operators import prevalence as P
from terrane.operators import replication as R
from terrane.plans.common import table


def _customers(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"), F.avg("o_totalprice").alias("price"), F.max("o_totalprice").alias("highest"), F.min(F.year("o_orderdate")).alias("year"),
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent"), F.max((F.col("o_orderstatus") == "P").cast("double")).alias("pending"),
    )
    return table(spark, sf, "customer").join(o, "c_custkey")


def replication_halves(spark, sf):
    """Classes of customers with even keys, found again among those with odd keys."""
    rows = _customers(spark, sf)
    columns = M.Columns(["c_acctbal", "n_orders", "price", "highest"], ["urgent", "pending"])
    categories = spark.createDataFrame([("c_acctbal", "money"), ("price", "money"), ("highest", "money"), ("n_orders", "volume"), ("urgent", "kind"), ("pending", "kind")], "feature string, category string")
    first, second = (rows.where(F.col("c_custkey") % 2 == i) for i in (0, 1))
    return R.replicate(first, second, "c_custkey", columns, categories, 2, 20)


def named_classes(spark, sf):
    """Four groups of nations named by how their orders' prices lie on the seven days of the week."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select((F.col("c_nationkey") % 4).cast("int").alias("class"), F.element_at(F.array(*map(F.lit, R.CATEGORIES)), F.dayofweek("o_orderdate")).alias("category"), "o_totalprice")
    whole = rows.agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))  # one row
    signature = rows.groupBy("class", "category").agg(F.avg("o_totalprice").alias("p")).crossJoin(whole).select("class", "category", ((F.col("p") - F.col("m")) / F.col("s")).alias("value"))
    got = R.align_to_named(signature, rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")))
    return got.select("class", "name", "anchors_hold", "broadly_affected_smallest", "social_behavioral_largest", "moderate_challenges_lowest_overall")


def published_correlation(spark, sf):
    """How the days' prices of each group of nations correlate with the first named profile's order."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    days = o.groupBy((F.col("c_nationkey") % 4).cast("int").alias("class"), F.element_at(F.array(*map(F.lit, R.CATEGORIES)), F.dayofweek("o_orderdate")).alias("category")).agg(F.avg("o_totalprice").alias("v"))
    named = R.named_signature(days).where("name = 'Mixed ASD with DD'")
    return days.join(named, "category").groupBy("class").agg(F.round(F.corr("v", "value"), 6).alias("r"))


def _soft(spark, sf):
    """Customers with responsibilities for five segments: mostly their own, the rest by their balance."""
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    sure = F.when(F.col("c_acctbal") > 0, 0.9).otherwise(0.6)
    r = F.array(*(F.when(F.col("c_mktsegment") == n, sure).otherwise((1 - sure) / 4) for n in names))
    return _customers(spark, sf).select(F.col("c_nationkey").alias("family"), (F.col("year") - 1995).cast("double").alias("year"), (F.col("c_acctbal") / 1000).alias("balance"), r.alias("r"))


def prevalence_one_vs_rest(spark, sf):
    """Each segment's share along the year of the first order, allowing for uncertain segments."""
    return P.one_vs_rest(_soft(spark, sf), ["year", "balance"], "r", "year", "family")


def prevalence_naive(spark, sf):
    """The same from the likeliest segments, with the tests of a plain logit."""
    return P.one_vs_rest(_soft(spark, sf), ["year", "balance"], "r", "year", "family", corrected=False)


def residualised_block(spark, sf):
    """Prices less what the customer's balance, nation and the day explain together."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select("o_orderkey", "o_totalprice", F.when(F.col("c_acctbal") > -500, F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), F.unix_date(F.to_date("o_orderdate")).cast("double").alias("day"))
    got = D.residualise_block(rows, ["o_totalprice"], ["balance", "nation", "day"])
    return got.select("o_orderkey", F.round("o_totalprice_residual", 3).alias("residual"))


QUERIES = {f.__name__: f for f in (replication_halves, named_classes, published_correlation, prevalence_one_vs_rest, prevalence_naive, residualised_block)}

_DAYS = "(select c_nationkey % 4 as class, dayofweek(o_orderdate) as d, o_totalprice as p from orders join customer on o_custkey = c_custkey)"
ORACLES = {
    "named_classes": f"""
        with r as {_DAYS}, w as (select avg(p) as m, stddev_samp(p) as s from r), c as (select class, d, (avg(p) - any_value(m)) / any_value(s) as v from r, w group by 1, 2),
        o as (select class, avg(v) as mean, max(v) filter (d = 6) as dev from c group by 1), n as (select class, count(*) as n from r group by 1), a as (select * from o join n using (class)),
        b as (select class from a order by mean desc, class limit 1), x as (select class from a where class not in (from b) order by dev desc, class limit 1),
        s as (select class from a where class not in (from b) and class not in (from x) order by n desc, class limit 1),
        k as (select class, case when class in (from b) then 'Broadly affected' when class in (from x) then 'Mixed ASD with DD' when class in (from s) then 'Social/behavioral' else 'Moderate challenges' end as name from a),
        t as (select (select class from b) = (select class from a order by n, class limit 1) as small, (select class from s) = (select class from a order by n desc, class limit 1) as large,
            (select class from k where name = 'Moderate challenges') = (select class from a order by mean, class limit 1) as low)
        select class::int as class, name, small and large and low as anchors_hold, small as broadly_affected_smallest, large as social_behavioral_largest, low as moderate_challenges_lowest_overall from k, t""",
    "published_correlation": f"""
        with c as (select class, d, avg(p) as v from {_DAYS} group by 1, 2)
        select class::int as class, round(corr(v, ([-0.90, -0.45, -0.65, -0.10, 0.10, 0.05, 0.45])[d + 1]), 6) as r from c group by 1""",
    "residualised_block": """
        with r as (select o_orderkey, o_totalprice as y, case when c_acctbal > -500 then c_acctbal end as a, c_nationkey::double as b, datediff('day', date '1970-01-01', o_orderdate::date)::double as c
            from orders join customer on o_custkey = c_custkey),
        m as (select avg(y) as my, avg(a) as ma, avg(b) as mb, avg(c) as mc from r where a is not null), x as (select o_orderkey, y - my as y, a - ma as a, b - mb as b, c - mc as c, my from r, m where a is not null),
        s as (select sum(a*a) as aa, sum(a*b) as ab, sum(a*c) as ac, sum(b*b) as bb, sum(b*c) as bc, sum(c*c) as cc, sum(a*y) as ay, sum(b*y) as by_, sum(c*y) as cy from x),
        d as (select *, aa*(bb*cc-bc*bc) - ab*(ab*cc-bc*ac) + ac*(ab*bc-bb*ac) as det from s),
        k as (select (ay*(bb*cc-bc*bc) - ab*(by_*cc-bc*cy) + ac*(by_*bc-bb*cy)) / det as ka, (aa*(by_*cc-bc*cy) - ay*(ab*cc-bc*ac) + ac*(ab*cy-by_*ac)) / det as kb, (aa*(bb*cy-by_*bc) - ab*(ab*cy-by_*ac) + ay*(ab*bc-bb*ac)) / det as kc from d)
        select r.o_orderkey, round(x.y - ka * x.a - kb * x.b - kc * x.c, 3) as residual from r left join x on r.o_orderkey = x.o_orderkey, k""",
}
