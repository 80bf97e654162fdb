"""Replication in a second table, nulls and bootstraps from sums by draw, and named classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import draws as W
from terrane.operators import enrichment as E
from terrane.operators import mixture as M
from terrane.operators import replication as R


def cohort(spark, seed, n, shift=0.0):
    rng = np.random.default_rng(seed)
    k = rng.choice(3, n, p=[0.5, 0.3, 0.2])
    high = np.array([[0, 1, 2, -1, 0.0, 1], [2, -1, 0, 1, 1.0, 0], [-1, 0.0, 1, 2, -1, 2]])
    x = rng.normal(size=(n, 6)) + 1.6 * high[k] + shift
    flag = (rng.uniform(size=n) < np.array([0.1, 0.5, 0.9])[k]).astype(float)
    rows = [(int(i), *map(float, x[i]), float(flag[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, f double, flag double").repartition(3).cache()


@pytest.fixture(scope="module")
def tables(spark):
    columns = M.Columns(["a", "b", "c", "d", "e", "f"], ["flag"])
    categories = spark.createDataFrame([("a", "one"), ("b", "one"), ("c", "two"), ("d", "two"), ("e", "three"), ("f", "three"), ("flag", "four")], "feature string, category string").cache()
    first = cohort(spark, 1, 600)
    model = M.fit(first, "id", columns, 3, 2)
    return first, cohort(spark, 2, 400), columns, categories, R.long_of(first, "id", columns, model).cache()


def test_replication(tables, spark):
    first, second, columns, categories, _ = tables
    got = {r["category"]: r for r in R.replicate(first, second.drop("f"), "id", columns, categories, 3, 2, n_perm=30, n_boot=30).collect()}
    whole = got[None]
    assert set(got) == {None, "one", "two", "three", "four"} and whole["r"] > 0.9 and whole["converged"]
    assert whole["p_value"] == pytest.approx(1 / (1 + whole["n_null"])) and (whole["n_null"] == 0 or whole["null_p95"] < whole["r"]) and whole["ci_low"] <= whole["r"] + 0.1
    assert whole["n_first"] == 600 and whole["n_second"] == 400 and whole["n_valid"] == 30


def test_bootstrap_of_a_correlation(tables):
    *_, categories, long = tables
    enriched = E.enrichment(long)
    keep = E.contributory(enriched).cache()
    target = E.signature(enriched.join(keep, "feature", "left_semi"), categories).withColumn("value", F.col("value") + F.xxhash64("class", "category") % 7 / 40).cache()
    got = R.correlation_bootstrap(long, categories, keep, target, 4)
    h = {r["id"]: r["h"] for r in long.select("id", F.xxhash64("id", F.lit(0)).alias("h")).distinct().collect()}
    ids = sorted(h)
    m = W.family_weights(np.array([h[i] for i in ids]), np.arange(1, 5)).astype(int)
    rs = []
    for b in range(4):  # the same draws, as repeated rows
        times = long.sparkSession.createDataFrame([(i, int(t)) for i, t in zip(ids, m[:, b], strict=True)], "id long, t int")
        again = long.join(times, "id").select("class", "feature", "value", F.explode(F.expr("sequence(1, greatest(t, 1))")).alias("n"), "t").where("t > 0")
        own = E.signature(E.enrichment(again.drop("t", "n")).join(keep, "feature", "left_semi"), categories)
        rs.append(E.profile_correlation(own, target).first()["r"])
    whole = got.where("category is null").first()
    assert np.allclose([whole["ci_low"], whole["ci_high"]], np.percentile(rs, [2.5, 97.5]), atol=1e-9) and whole["n_valid"] == 4


def test_dealt_labels_keep_their_shares(tables):
    *_, categories, long = tables
    keep = long.select("feature").distinct()
    target = E.signature(E.enrichment(long), categories)
    null = R.label_null(long, categories, keep, target, 40).where("category is null").collect()
    assert len(null) == 40 and abs(np.mean([r["r"] for r in null if r["r"] is not None])) < 0.3


SIGNATURE = {
    0: dict(zip(R.CATEGORIES, [0.9, 0.8, 0.9, 0.4, 0.5, 0.4, -0.8], strict=True)), 1: dict(zip(R.CATEGORIES, [1.0] * 7, strict=True)),
    2: dict(zip(R.CATEGORIES, [-1.0, -0.9, -1.0, -0.9, -1.0, -0.9, -1.0], strict=True)), 3: dict(zip(R.CATEGORIES, [-0.8, -0.5, -0.6, 0.0, 0.1, 0.1, 0.5], strict=True)),
}


def frames(spark, signature, sizes):
    return spark.createDataFrame([(c, k, v) for c, own in signature.items() for k, v in own.items()], "class int, category string, value double"), spark.createDataFrame(list(sizes.items()), "class int, n long")


def test_named_classes(spark):
    sizes = {0: 370, 1: 100, 2: 340, 3: 190}
    got = {r["class"]: r for r in R.align_to_named(*frames(spark, SIGNATURE, sizes), strict=True).collect()}
    assert {c: r["name"] for c, r in got.items()} == {0: "Social/behavioral", 1: "Broadly affected", 2: "Moderate challenges", 3: "Mixed ASD with DD"}
    assert got[1]["correlation"] is None and got[0]["correlation"] > 0.95 and got[0]["overall_correlation"] > 0.95 and all(r["anchors_hold"] for r in got.values())
    ours = np.array([list(SIGNATURE[0].values()), R.NAMED["Social/behavioral"]])
    assert got[0]["correlation"] == pytest.approx(np.corrcoef(ours)[0, 1])


def test_anchors_that_clash_are_refused(spark):
    clash = {0: 90, 1: 500, 2: 340, 3: 190}  # the most affected class is the largest
    rows = R.align_to_named(*frames(spark, SIGNATURE, clash)).collect()
    assert not rows[0]["anchors_hold"] and not rows[0]["broadly_affected_smallest"] and not rows[0]["social_behavioral_largest"]
    with pytest.raises(ValueError, match="broadly_affected_smallest"):
        R.align_to_named(*frames(spark, SIGNATURE, clash), strict=True)
    with pytest.raises(ValueError, match="4 classes"):
        R.align_to_named(*frames(spark, {c: SIGNATURE[c] for c in (0, 1, 2)}, clash))
    with pytest.raises(ValueError, match="each category"):
        R.align_to_named(*frames(spark, SIGNATURE | {3: {"attention": 1.0}}, clash))
