"""Enrichment of classes, signatures, alignment of classes, and contingency measures.

Statistics are taken on the long form: (id, feature, value) rows with each id's class.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import stats


def class_moments(long: DataFrame) -> DataFrame:
    """Per feature and class: n, mean, var; and of the rest and the whole, from the same sums.

    One aggregate of (feature, class, value) rows; the rest of a class is the whole less it.
    """
    own = long.groupBy("feature", "class").agg(F.count("value").cast("double").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    return moments_of(own, binary_features(long)).withColumns({c: F.col(c).cast("long") for c in ("n", "n_all", "n_rest")})


def binary_features(long: DataFrame) -> DataFrame:
    """feature and is_binary: whether its values are 0 and 1 alone, and both occur."""
    g = long.groupBy("feature").agg(F.count("value").alias("n"), F.count_if(F.col("value").isin(0.0, 1.0)).alias("flags"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return g.select("feature", ((F.col("flags") == F.col("n")) & (F.col("lo") < F.col("hi"))).alias("is_binary"))


def moments_of(own: DataFrame, binary: DataFrame, by: list[str] | None = None) -> DataFrame:
    """class_moments from sums (by, feature, class, n, s, ss), such as those of draws."""
    by = by or []
    all_ = own.groupBy(*by, "feature").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.sum("ss").alias("all_ss"))
    j = own.join(all_, [*by, "feature"]).join(binary, "feature")

    def var(n: Column, s: Column, ss: Column) -> Column:
        return F.when(n > 1, F.greatest(F.lit(0.0), (ss - s * s / n) / (n - 1)))

    n, s, ss = (F.col(c) for c in ("n", "s", "ss"))
    rn, rs, rss = (F.col(f"all_{c}") - F.col(c) for c in ("n", "s", "ss"))
    return j.select(
        *by, "feature", "class", "is_binary", "n", F.col("all_n").alias("n_all"), (s / n).alias("mean"), var(n, s, ss).alias("var"), F.when(rn > 0, rn).alias("n_rest"), F.when(rn > 0, rs / rn).alias("mean_rest"), var(rn, rs, rss).alias("var_rest"), (F.col("all_s") / F.col("all_n")).alias("mean_all"), var(F.col("all_n"), F.col("all_s"), F.col("all_ss")).alias("var_all"), s.alias("total")
    )


def enrichment(long: DataFrame, q: float = 0.05) -> DataFrame:
    """feature, class, is_binary, effect (fold ratio or Cohen's d against the whole) and direction.

    Binary features are tested one-sided binomially against the whole's rate, others by Welch's t
    against the rest; Benjamini-Hochberg within class and direction. Depleted comes before enriched.
    """
    return enrichment_of(class_moments(long), q=q)


def enrichment_of(m: DataFrame, by: list[str] | None = None, q: float = 0.05) -> DataFrame:
    """enrichment from moments, for each of by on its own."""
    by = by or []
    va, vb = F.col("var") / F.col("n"), F.col("var_rest") / F.col("n_rest")
    t = F.when(va + vb > 0, (F.col("mean") - F.col("mean_rest")) / F.sqrt(va + vb))
    df = F.when(va + vb > 0, (va + vb) * (va + vb) / (va * va / (F.col("n") - 1) + vb * vb / (F.col("n_rest") - 1)))
    pooled = F.sqrt((F.col("var") + F.col("var_all")) / 2)
    effect = F.when(F.col("is_binary"), F.when(F.col("mean_all") > 0, F.col("mean") / F.col("mean_all"))).otherwise(F.when(pooled > 0, (F.col("mean") - F.col("mean_all")) / pooled).otherwise(0.0))
    m = m.withColumns({"t": t, "df": df, "effect": effect})
    k, n, rate = F.col("total"), F.col("n").cast("double"), F.col("mean_all")
    up = F.when(F.col("is_binary"), stats.binomial_at_least(k, n, rate)).otherwise(stats.t_upper(F.col("t"), F.col("df")))
    down = F.when(F.col("is_binary"), stats.binomial_at_most(k, n, rate)).otherwise(1 - stats.t_upper(F.col("t"), F.col("df")))
    sides = m.select("*", F.inline(F.array(F.struct(F.lit("up").alias("side"), up.alias("p")), F.struct(F.lit("down").alias("side"), down.alias("p")))))
    tested = stats.bh_adjusted(sides, "p", [*by, "class", "side"])
    hit = F.coalesce(F.col("p_adjusted") < q, F.lit(False))
    out = tested.groupBy(*by, "feature", "class", "is_binary", "effect").agg(F.max(F.when((F.col("side") == "up") & hit, 1).otherwise(0)).alias("up"), F.max(F.when((F.col("side") == "down") & hit, 1).otherwise(0)).alias("down"))
    return out.select(*by, "feature", "class", "is_binary", "effect", F.when(F.col("down") == 1, -1).when(F.col("up") == 1, 1).otherwise(0).alias("direction"))


def contributory(enriched: DataFrame, fold: float = 1.5, d: float = 0.2) -> DataFrame:
    """Features that are significant in some class and strong in some class."""
    strong = F.when(F.col("is_binary"), F.col("effect") >= fold).otherwise(F.abs("effect") >= d)
    return enriched.groupBy("feature").agg(F.bool_or(F.col("direction") != 0).alias("a"), F.bool_or(F.coalesce(strong, F.lit(False))).alias("b")).where("a and b").select("feature")


def signature(enriched: DataFrame, categories: DataFrame, reverse: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """class, category and (enriched - depleted) / features, reverse-coded features turned round."""
    sign = F.when(F.col("feature").isin(*(reverse or [""])), -F.col("direction")).otherwise(F.col("direction"))
    return enriched.join(categories, "feature").groupBy(*(by or []), "class", "category").agg(F.avg(sign).alias("value"))


def profile_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson's correlation of two signatures over all (class, category) cells: one row."""
    j = a.select("class", "category", F.col("value").alias("x")).join(b.select("class", "category", F.col("value").alias("y")), ["class", "category"])
    return j.agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))


def contingency(labels: DataFrame, a: str, b: str, weight: Column | None = None) -> DataFrame:
    return labels.groupBy(a, b).agg((F.sum(weight) if weight is not None else F.count(F.lit(1))).cast("double").alias("n"))


def adjusted_rand(table: DataFrame, a: str, b: str) -> DataFrame:
    """The adjusted Rand index of a contingency table: one row, ari."""

    def pairs(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(name))

    rows = table.groupBy(a).agg(F.sum("n").alias("n"))
    cols = table.groupBy(b).agg(F.sum("n").alias("n"))
    whole = table.agg(F.sum("n").alias("n"))
    j = pairs(table, "ab").crossJoin(pairs(rows, "pa")).crossJoin(pairs(cols, "pb")).crossJoin(pairs(whole, "pn"))  # one row each
    expected, most = F.col("pa") * F.col("pb") / F.col("pn"), (F.col("pa") + F.col("pb")) / 2
    return j.select(F.when(most == expected, 1.0).otherwise((F.col("ab") - expected) / (most - expected)).alias("ari"))


def jaccard_overlap(table: DataFrame, a: str, b: str) -> DataFrame:
    """Jaccard's index of each pair of classes that share members."""
    ra = table.groupBy(a).agg(F.sum("n").alias("na"))
    rb = table.groupBy(b).agg(F.sum("n").alias("nb"))
    return table.join(ra, a).join(rb, b).select(a, b, (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))


def assign(cost: np.ndarray) -> list[int]:
    """The column of each row so that the total cost is least.

    Kuhn's and Munkres's method: each row in turn is added along the cheapest chain of changes, by
    prices of rows and columns; rows squared by columns. Of more rows than columns, those left over
    get numbers past the last column.
    """
    k, m = cost.shape
    if k > m:
        cost = np.pad(cost, ((0, 0), (0, k - m)), constant_values=cost.max(initial=0) + 1)
        m = k
    price, of_row = np.zeros(m + 1), np.zeros(k)
    owner = np.full(m + 1, -1)  # the last column is where a new row starts
    for i in range(k):
        owner[m], j = i, m
        least, before, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[j] >= 0:
            done[j], r = True, owner[j]
            slack = cost[r] - of_row[r] - price[:m]
            better = ~done[:m] & (slack < least)
            least[better], before[better] = slack[better], j
            j = int(np.where(done[:m], np.inf, least).argmin())
            step = least[j]
            of_row[owner[done]] += step
            price[done] -= step
            least[~done[:m]] -= step
        while j != m:
            owner[j] = owner[before[j]]
            j = int(before[j])
    column = np.empty(k, int)
    column[owner[:m][owner[:m] >= 0]] = np.flatnonzero(owner[:m] >= 0)
    return column.tolist()


def greedy_overlap(table: dict[tuple[int, int], float], sources: list[int], targets: list[int]) -> dict[int, int]:
    """Each source takes its greatest overlap; of rivals the greater keeps it, the others what is left."""
    out, left = {}, list(targets)
    for n, s, t in sorted(((-n, s, t) for (s, t), n in table.items() if n > 0)):
        if s not in out and t in left:
            best = max((table.get((s, x), 0), -x) for x in targets)
            if -n == best[0]:
                out[s] = t
                left.remove(t)
    for s in sources:
        if s not in out and left:
            out[s] = left.pop(0)
    return out


def movers(labels: DataFrame, stratum: str, reference: str) -> DataFrame:
    """Per class: who stays, leaves (in the reference's class only) and joins; their share."""
    rows = labels.select(F.inline(F.array(F.struct(F.col(reference).alias("class"), F.lit(1).alias("ref"), (F.col(stratum) == F.col(reference)).cast("int").alias("same")), F.struct(F.col(stratum).alias("class"), F.lit(0).alias("ref"), (F.col(stratum) == F.col(reference)).cast("int").alias("same")))))
    g = rows.groupBy("class").agg(F.sum(F.col("ref") * F.col("same")).alias("n_stayers"), F.sum(F.col("ref") * (1 - F.col("same"))).alias("n_leavers"), F.sum((1 - F.col("ref")) * (1 - F.col("same"))).alias("n_joiners"))
    return g.withColumn("churn", (F.col("n_leavers") + F.col("n_joiners")) / (F.col("n_stayers") + F.col("n_leavers") + F.col("n_joiners")))


def univariate_contrast(long: DataFrame, flag: str) -> DataFrame:
    """Per feature: effect (pooled sd), Welch's t, its degrees of freedom and p between two groups."""
    a, b = F.when(F.col(flag), F.col("value")), F.when(~F.col(flag), F.col("value"))
    m = long.groupBy("feature").agg(*(f(x).alias(f"{n}{i}") for i, x in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    va, vb = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    diff, pooled = F.col("m0") - F.col("m1"), F.sqrt((F.col("v0") + F.col("v1")) / 2)
    out = m.select("feature", F.when(pooled > 0, diff / pooled).alias("effect"), F.when(va + vb > 0, diff / F.sqrt(va + vb)).alias("t"), ((va + vb) * (va + vb) / (va * va / (F.col("n0") - 1) + vb * vb / (F.col("n1") - 1))).alias("df"))
    return out.withColumn("p", stats.t_two_sided(F.col("t"), F.col("df")))


def logistic_contrast(df: DataFrame, flag: str, features: list[str], c: float = 1.0) -> DataFrame:
    """feature and weight of an L1 logistic regression of a flag on standardised features.

    Missing values become the feature's median (approximate, within 1e-4 of the ranks); features
    without spread are left out. The penalty is 1 / (c n).
    """
    p = df.select(F.col(flag).cast("double").alias("label"), *(F.col(f).cast("double").alias(f) for f in features)).where(F.col("label").isNotNull())
    stats_of = p.agg(F.count(F.lit(1)).alias("n"), *(x.alias(f"{k}_{i}") for i, f in enumerate(features) for k, x in (("m", F.percentile_approx(f, 0.5, 10000)), ("lo", F.min(f)), ("hi", F.max(f))))).first()
    used = [(i, f) for i, f in enumerate(features) if stats_of[f"lo_{i}"] is not None and stats_of[f"lo_{i}"] < stats_of[f"hi_{i}"]]
    filled = p.select("label", array_to_vector(F.array(*(F.coalesce(f, F.lit(float(stats_of[f"m_{i}"]))) for i, f in used))).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(filled).transform(filled)
    model = LogisticRegression(regParam=1 / (c * stats_of["n"]), elasticNetParam=1.0, standardization=False, maxIter=100).fit(scaled)
    return df.sparkSession.createDataFrame([(f, float(w)) for (_, f), w in zip(used, model.coefficients, strict=True)], "feature string, weight double")
