"""Operators on small planted tables."""

import itertools
import math
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import ages, stats, text
from terrane.functions.versions import version_key
from terrane.operators import catalogue, cohort, drift, enrichment, geometry, inference, mixture, order, schemes, strata
from terrane.plans import geometry as plans_geometry
from terrane.plans import models
from terrane.plans import typing as plans_typing
from terrane.sources import files, sinks, store
from terrane.streaming import ingest

WEEK = 7 / 30.4375


@pytest.mark.parametrize(
    ("said", "months"),
    [
        ("13 months", 13), ("13 mos", 13), ("13m", 13), ("13", 13), ("1 year", 12), ("1 yr", 12), ("1.5 years", 18), ("1 yr 6 mo", 18), ("18.5 months", 18.5), ("at birth", 0), ("approx. 12 months", 12), ("~14 mos", 14), ("12-14", 13), ("1-2 years", 18), ("12 to 18 mo", 15),
        ("3 1/2 yrs", 42), ("4 years old", 48), ("3 y.o.", 36), ("4 y/o", 48), ("2 yrs. 10 mos", 34), ("3y;3m", 39), ("7 or 8 months", 7.5), ("11ms", 11), ("3:6 years", 42), ("18 months to 2 years", 21), ("9 mo - 1 yr", 10.5), ("3+ years", 36), ("<3 mos", 3), (">42 mos", 42),
        ("&lt;1y", 12), ("before 1 year", 12), ("by age 4", 48), ("6 weeks", 6 * WEEK), ("1 yr 2 weeks", 12 + 2 * WEEK), ("18 years", 85), ("100 months", 85), ("never", 888), ("not yet", 888), ("can't", 888), ("unable", 888), ("3½ yrs", 42),
        ("normal", None), ("n/a", None), ("?", None), ("", None), ("five", None), ("under 2", None), ("over 3", None), ("03/2003", None), ("12/01", None), ("12 mos (lost at 15 mos)", None), (None, None),
    ],
)
def test_milestone_ages(said, months):
    got = ages.parse_age_months(said)
    assert got is None if months is None else got == pytest.approx(months)


def test_versions(spark):
    def latest(vs):
        return spark.createDataFrame([(v,) for v in vs], "v string").agg(F.max(version_key(F.col("v"))).alias("k")).first()["k"]["version"]

    assert latest(["2025-03-31", "2026-03-23", "2024-01-01"]) == "2026-03-23"
    assert latest(["15.3", "15.10", "9.9"]) == "15.10"
    assert latest(["x", "1.0"]) == "1.0" and latest(["9.9", "2020-01-01"]) == "2020-01-01"


def test_text(spark):
    df = spark.createDataFrame([("1=a\n2=b\nnone", "a\n b", " A  b\tC ")], "v string, c string, t string")
    r = df.select(text.value_levels(F.col("v")).alias("n"), text.codes(F.col("c")).alias("c"), text.collapsed(F.col("t")).alias("t"), text.codes(F.lit("[]")).alias("e")).first()
    assert (r["n"], r["c"], r["t"], r["e"]) == (2, "a; b", "a b c", "")


def step_up(p, q):
    live = sorted((x, i) for i, x in enumerate(p) if x is not None and not math.isnan(x))
    most = max([x for k, (x, _) in enumerate(live, 1) if x <= q * k / len(live)], default=-1)
    return [x is not None and not math.isnan(x) and x <= most for x in p]


def test_benjamini_hochberg(spark):
    rng = np.random.default_rng(0)
    for _ in range(3):
        p = [float(x) for x in np.round(rng.uniform(0, 0.1, 30), 2)] + [None, float("nan")]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
        got = {r["i"]: r["reject"] for r in stats.bh_reject(df, "p", q=0.05).collect()}
        assert [got[i] for i in range(len(p))] == step_up(p, 0.05)
        adjusted = {r["i"]: r["p_adjusted"] for r in stats.bh_adjusted(df, "p").collect()}
        assert adjusted[30] is None and adjusted[31] is None
        assert [adjusted[i] <= 0.05 for i in range(30)] == step_up(p, 0.05)[:30]


def test_tails(spark):
    r = spark.range(1).select(stats.t_two_sided(F.lit(2.0), F.lit(10.0)).alias("t"), stats.t_upper(F.lit(-1.0), F.lit(5.0)).alias("u"), stats.chi2_upper(F.lit(3.841), F.lit(1.0)).alias("c"), stats.binomial_at_least(F.lit(3.0), F.lit(5.0), F.lit(0.5)).alias("b"), stats.binomial_at_most(F.lit(2.0), F.lit(5.0), F.lit(0.5)).alias("a")).first()
    assert r["t"] == pytest.approx(0.07339, abs=1e-4) and r["u"] == pytest.approx(0.81839, abs=1e-4)
    assert r["c"] == pytest.approx(0.05, abs=1e-4) and r["b"] == pytest.approx(0.5) and r["a"] == pytest.approx(0.5)


def test_running_total_and_ranks(spark):
    rows = [(i, float(i % 7)) for i in range(100)]
    df = spark.createDataFrame(rows, "i int, v double")
    got = {r["i"]: r["t"] for r in stats.running_total(df, "i", "v", "t").collect()}
    assert [got[i] for i in range(100)] == list(np.cumsum([v for _, v in rows]))
    ranks = {r["i"]: r["r"] for r in stats.average_rank(df.withColumn("v", F.when(F.col("i") != 5, F.col("v"))), "v", "r").collect()}
    assert ranks[5] is None and ranks[0] == ranks[7] == 8.0


def test_scope_and_diff(spark):
    f = spark.createDataFrame([("a", "1.9", "t", "x", "d", "v", 1), ("a", "1.10", "t", "x", " D ", "w", 2), ("a", "1.10", "t", "y", "d", "v", 3)], "dataset string, version string, table_name string, name string, definition string, values string, uid int")
    assert [tuple(r) for r in catalogue.scope(f).collect()] == [("a", "1.10")]
    assert catalogue.scope(f, "a", "1.9").count() == 1 and catalogue.scope(f, all_versions=True).count() == 2
    with pytest.raises(ValueError, match="dataset"):
        catalogue.scope(f, version="1.9")
    got = {tuple(r) for r in catalogue.diff_versions(f.where("version = '1.9'"), f.where("version = '1.10'")).collect()}
    assert got == {("t", "x", "changed", "values"), ("t", "y", "added", "")}


def test_synonyms_and_query():
    assert catalogue.query_terms("Sleep now", {"sleep": ["insomnia"]}) == [(0, "sleep"), (0, "insomnia"), (1, "now")]
    with pytest.raises(ValueError, match="empty"):
        catalogue.query_terms("!!!")


def test_stem_binding(spark):
    sheets = spark.createDataFrame([("cbcl1-5",), ("scq",), ("area deprivation index",), ("a-b",), ("ab",)], "sheet string")
    stems = spark.createDataFrame([("cbcl_1_5",), ("scq",), ("zzz",), ("a_b",)], "stem string")
    assert {tuple(r) for r in catalogue.bind_stems(stems, sheets).collect()} == {("cbcl_1_5", "cbcl1-5"), ("scq", "scq"), ("zzz", None), ("a_b", None)}


def test_cohort_gates(spark):
    df = spark.createDataFrame([(2020.0, 1.0), (2022.0, 2.0), (2023.0, 3.0), (None, 4.0)], "eval_year double, value double")
    assert sorted(r["value"] for r in cohort.within_cutoff(df, "eval_year", 2022).collect()) == [1.0, 2.0]
    assert cohort.within_cutoff(df, "eval_year", None).columns == df.columns
    people = spark.createDataFrame([(1, 5, 2), (2, 8, 3), (3, 3, None), (4, 34, None)], "id int, age int, parent int")
    got = {r["id"]: r["parent_age"] for r in cohort.parent_age_at_birth(people.replace(2, 4, ["parent"]), "id", "parent", "age").collect()}
    assert got[1] == 29 and got[3] is None
    flags = cohort.flags_or_null(spark.createDataFrame([(1, 1, None), (2, None, None)], "id int, a int, b int"), ["a", "b"]).orderBy("id").collect()
    assert tuple(flags[0]) == (1, 1, 0) and tuple(flags[1]) == (2, None, None)
    axes = cohort.derive_axes(spark.createDataFrame([(24.0, 2018, 3.0, 5.0), (60.0, 2020, 5.0, 8.0), (120.0, 1900, 7.0, 13.0), (120.0, 2018, 7.0, 4.0)], "diagnosis_months double, registration_year int, registration_age double, eval_age double")).collect()
    assert (axes[0]["age"], axes[0]["year"], axes[0]["lag"]) == (2.0, 2017.0, 3.0) and axes[2]["year"] is None and axes[3]["lag"] is None


def test_integrate(spark):
    a = spark.createDataFrame([(1, "1.5", "x"), (2, "2", None), (3, "bad", "1")], "id int, a string, b string")
    b = spark.createDataFrame([(1, 9.0, 1.0), (2, 8.0, 1.0), (4, 1.0, 1.0)], "id int, a double, c double")
    assert [tuple(r) for r in cohort.integrate([a.drop("b"), b], "id").orderBy("id").collect()] == [(1, 1.5, 1.0), (2, 2.0, 1.0)]
    assert cohort.integrate([a.select("id", "a"), b], "id", "full_outer", ["c"]).count() == 3
    twice = cohort.union_common(a.select("id", "a"), spark.createDataFrame([(1, 0)], "id int, z int"))
    assert sorted(r["id"] for r in cohort.drop_repeated(twice, "id").collect()) == [2, 3]


def test_strata(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "x double")
    assert strata.quantile_edges(df, "x", 4) == [24.75, 49.5, 74.25]
    assert len(strata.max_equal_edges(df, "x", 20)) == 4
    assert strata.band_labels([1.0, 2.5]) == ["<1", "1-2.5", ">=2.5"]
    h = strata.bandwidth_for(df, "x", [25.0, 50.0, 75.0], 30.0)
    assert [r["n_eff"] for r in strata.effective_n(df, "x", [50.0], h).collect()][0] >= 29.9
    passed = {r["key"]: r["passed"] for r in strata.gates(df, "x", [50.0], min_bin=50, min_class=8).collect()}
    assert passed == {"min_bin_size": False, "smallest_class": False, "coverage": True, "partition": True, "size_balance": True} or passed["min_bin_size"]


def test_alignment():
    cost = np.array([[5.0, 1.0, 9.0], [1.0, 5.0, 9.0]])
    assert enrichment.assign(cost) == [1, 0]
    assert enrichment.greedy_overlap({(0, 1): 5, (1, 1): 9, (0, 0): 1}, [0, 1], [0, 1]) == {1: 1, 0: 0}


def test_alignment_of_many_classes(spark, sf):
    rng = np.random.default_rng(3)
    for k, m in ((1, 1), (3, 5), (5, 5), (4, 6), (6, 4)):
        for _ in range(20):
            cost = rng.integers(0, 9, (k, m)).astype(float)
            wide = np.pad(cost, ((0, 0), (0, max(0, k - m))), constant_values=cost.max() + 1)
            got = enrichment.assign(cost)
            assert len(set(got)) == k and wide[range(k), got].sum() == min(wide[range(k), p].sum() for p in itertools.permutations(range(wide.shape[1]), k))
    hidden = rng.permutation(60)
    cost = rng.random((60, 60)) + 1
    cost[range(60), hidden] = 0
    assert enrichment.assign(cost) == hidden.tolist() and enrichment.assign(np.zeros((0, 0))) == []
    labels = {r["label"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 2 = 1").select("label").collect()}
    got = models.class_alignment(spark, sf).collect()
    assert max(labels) > 5 and sorted(r["source"] for r in got) == sorted(labels) and len({r["target"] for r in got}) == len(got)


def test_adjusted_rand(spark):
    rows = [(i % 4, (i % 4 + 1) % 4) for i in range(100)]
    t = enrichment.contingency(spark.createDataFrame(rows, "a int, b int"), "a", "b")
    assert enrichment.adjusted_rand(t, "a", "b").first()["ari"] == pytest.approx(1.0)
    assert {r["jaccard"] for r in enrichment.jaccard_overlap(t, "a", "b").collect()} == {1.0}


def planted(spark, n=400):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        c = i % 4
        rows.append((i, c, float(rng.normal() + 5 * (c == 1)), float(rng.normal() + 5 * (c == 3)), int(c == 0) ^ int(rng.random() < 0.05), min(c, 2)))
    return spark.createDataFrame(rows, "id int, c int, c1 double, c2 double, b1 int, cat1 int")


def test_mixture_recovers_planted_classes(spark):
    df = planted(spark)
    model = mixture.fit(df, "id", mixture.Columns(["c1", "c2"], ["b1"], {"cat1": 3}), 4, n_init=6)
    labels = mixture.assign(df, "id", model).join(df.select("id", "c"), "id")
    t = enrichment.contingency(labels, "label", "c")
    assert enrichment.adjusted_rand(t, "label", "c").first()["ari"] > 0.85
    assert mixture.fit(df, "id", mixture.Columns(["c1", "c2"]), 1, n_init=1).log_likelihood < model.log_likelihood + 1e9
    again = mixture.fit(df, "id", mixture.Columns(["c1", "c2"], ["b1"], {"cat1": 3}), 4, n_init=6)
    assert again.log_likelihood == pytest.approx(model.log_likelihood)


def test_enrichment_finds_planted_features(spark):
    df = planted(spark)
    long = stats.long_form(df.withColumnRenamed("c", "class"), ["id", "class"], ["c1", "c2", "b1"])
    got = {(r["feature"], r["class"]): r["direction"] for r in enrichment.enrichment(long).collect()}
    assert got["c1", 1] == 1 and got["c1", 0] == -1 and got["b1", 0] == 1 and got["c2", 3] == 1
    assert {r["feature"] for r in enrichment.contributory(enrichment.enrichment(long)).collect()} == {"c1", "c2", "b1"}


def test_inference(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, float(i % 50), float(rng.normal() + (3 if i % 2 == 0 and i % 50 > 25 else 0)), i % 40) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, class int, axis double, value double, family int").withColumn("feature", F.lit("f"))
    bins = df.select("axis").distinct().withColumn("grid", F.col("axis").cast("long"))
    got = {r["class"]: r for r in inference.invariance(df, "axis", bins, n_sim=200).collect()}
    assert got[0]["p_value"] < 0.02 and 20 <= got[0]["at"] <= 30 and got[1]["p_value"] > 0.02
    boot = {r["class"]: r for r in inference.family_bootstrap(df, "family", ["class"]).collect()}
    assert all(r["ci_low"] < r["estimate"] < r["ci_high"] for r in boot.values())
    z = df.withColumns({"x": (F.col("axis") - 25) / 25, "t": F.array(*(F.when(F.col("class") == i, 1.0).otherwise(0.0) for i in (0, 1)))})
    assert abs(inference.multinomial(z, ["x"], "t", 2)[0][1]) < 0.3
    lean = z.withColumn("t", F.when(F.rand(1) < 1 / (1 + F.exp(-2 * F.col("x"))), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))))
    assert 1.4 < inference.multinomial(lean, ["x"], "t", 2)[0][1] < 2.6


def test_read_against_null(spark):
    obs = spark.createDataFrame([("a", 10.0)], "k string, value double")
    null = spark.createDataFrame([("a", float(i)) for i in range(10)], "k string, draw double")
    r = drift.read_against_null(obs, null, ["k"]).first()
    assert r["exceeds_p95"] and r["p_value"] == pytest.approx(1 / 11) and r["n_null"] == 10


def test_runs_and_rendering(spark, tmp_path):
    run = sinks.Run(str(tmp_path), "stage", {"b": 1, "a": [2]})
    assert run.path == sinks.Run(str(tmp_path), "stage", {"a": [2], "b": 1}).path
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert run.frame(spark, "x", make).count() == 3 and run.frame(spark, "x", make).count() == 3 and len(calls) == 1
    log = sinks.UnitLog(spark, str(tmp_path / "log"), "unit long, value double")
    units = spark.range(4).withColumnRenamed("id", "unit")
    log.append(log.pending(units, ["unit"]).where("unit < 2").withColumn("value", F.lit(1.0)))
    assert sorted(r["unit"] for r in log.pending(units, ["unit"]).collect()) == [2, 3]
    df = spark.createDataFrame([(1, "x, y"), (2, None)], "a int, b string").coalesce(1)
    assert sinks.render(df, "csv") == 'a,b\n1,"x, y"\n2,\n' and sinks.render(df, "tsv").startswith("a\tb")
    assert sinks.render(df, "markdown").splitlines()[1] == "| --- | --- |" and sinks.render(df.limit(0)) == "" and '"b": null' in sinks.render(df, "json")
    assert sinks.digest(df).first() == sinks.digest(df.orderBy(F.desc("a"))).first()


def test_files(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "a.csv").write_text("h1,h2\n1,2\n")
    (tmp_path / "v1" / "b.csv").write_text("h1\n1\n2\n")
    counts = {os.path.basename(r["path"]): r["n_rows"] for r in files.count_data_rows(spark, str(tmp_path / "v1")).collect()}
    assert counts == {"a.csv": 1, "b.csv": 2}
    assert files.read_columns(spark, str(tmp_path / "v1" / "a.csv"), ["h2", "zz"]).collect()[0]["h2"] == "2"
    assert {r["version"] for r in files.version_folders(spark, str(tmp_path), r"/v(\d+)/").collect()} == {"1"}
    book = tmp_path / "w.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name </t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>')
    assert [tuple(r)[1:] for r in files.read_sheets(spark, str(book)).collect()] == [("S", 1, ["name", "", "3"])]


def test_streaming_ingest(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (3, 5):
        spark.range(n).write.mode("append").parquet(source)
        ingest.keep_ingesting(ingest.stream_table(spark, source, "id long"), target, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(target).count() == 8


def test_knee_and_isotonic():
    assert order.knee([1, 2, 3, 4, 5], [0.0, 0.8, 0.9, 0.95, 1.0]) == 2
    assert order.isotonic(np.array([1.0, 3.0, 2.0, 4.0])).tolist() == [1.0, 2.5, 2.5, 4.0]
    sizes, scores = np.array([100.0, 300.0, 1000.0, 3000.0]), np.array([0.2, 0.5, 0.9, 0.95])
    assert 500 < order.smallest_size(sizes, scores, 0.8) < 1000 and order.smallest_size(sizes, scores, 0.99) is None


def test_fits_run_to_tolerance(spark):
    df = planted(spark)
    columns = mixture.Columns(["c1", "c2"])
    cut, whole = (mixture.fit(df, "id", columns, 2, n_init=1, **most) for most in ({"most": 2}, {}))
    assert not cut.converged and whole.converged and whole.log_likelihood > cut.log_likelihood
    assert order.adjusted_lr(spark, cut, whole, 400).first()["converged"] is False


def test_simulated_tables_and_ratio(spark):
    df = planted(spark, 200)
    columns = mixture.Columns(["c1", "c2"])
    observed, null = order.likelihood_ratio(df, "id", columns, 1, n_init=2, most=15)
    assert observed > 20
    made = order.simulate(spark, null, 200, 2, 1)
    assert made.groupBy("draw").count().orderBy("draw").collect() == [(0, 200), (1, 200)]
    assert order.bootstrap_likelihood_ratio(df, "id", columns, 1, draws=2, n_init=1, most=8)["p_value"] == pytest.approx(1 / 3)


def test_geometry(spark):
    df = planted(spark).withColumnRenamed("c", "label")
    names, n, s, ss = geometry.scatter(df, "label", ["c1", "c2"])
    rows = df.toPandas()
    assert names == ["0", "1", "2", "3"] and n.tolist() == [100.0] * 4
    assert np.allclose(s[1], rows[rows.label == 1][["c1", "c2"]].sum())
    cov = sum(np.cov(g[["c1", "c2"]].T) * (len(g) - 1) for _, g in rows.groupby("label")) / (len(rows) - 4)
    assert np.allclose(geometry.within(n, s, ss), cov)
    axes = geometry.discriminant_axes(n, s, ss)
    assert axes.shape == (2, 2) and (axes[np.abs(axes).argmax(0), [0, 1]] > 0).all()
    d, parts = geometry.mahalanobis(np.array([1.0, np.nan]), np.eye(2) * 4)
    assert d == pytest.approx(0.5) and parts.sum() == pytest.approx(0.25)
    jsd = spark.range(1).select(geometry.gaussian_jsd(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("a"), geometry.gaussian_jsd(F.lit(0.0), F.lit(0.1), F.lit(9.0), F.lit(0.1)).alias("b")).first()
    assert jsd["a"] == pytest.approx(0.0) and jsd["b"] == pytest.approx(1.0, abs=0.05)


def test_geometry_reads_all_components(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 40))
    label = np.arange(400) // 2 % 4
    x[np.arange(400), 36 + label] += 8.0  # classes differ in the last components only
    rows = [(i, int(c), [float(v) for v in row]) for i, (c, row) in enumerate(zip(label, x))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    at = {r["label"]: np.array([r["ld1"], r["ld2"], r["ld3"]]) for r in plans_geometry.discriminant_positions(spark, str(tmp_path)).collect()}
    assert min(np.linalg.norm(at[a] - at[b]) for a, b in itertools.combinations(at, 2)) > 6
    got = plans_geometry.mahalanobis_contributions(spark, str(tmp_path)).toPandas()
    assert sorted(got["feature"].unique()) == list(range(40)) and len(got) == 160
    centred = x - np.stack([x[label == c].mean(0) for c in range(4)])[label]
    d = x[(label == 1) & (np.arange(400) % 2 == 1)].mean(0) - x[label == 1].mean(0)
    cov = centred.T @ centred / 396
    want = d * np.linalg.solve(0.9 * cov + 0.1 * np.trace(cov) / 40 * np.eye(40), d)
    assert np.allclose(got[got["label"] == 1].sort_values("feature")["contribution"], want, atol=1e-4)


def test_permutations(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(200)], "k int, v double")
    got = {r["k"]: r["v"] for r in strata.permute_axis(df, "k", "v", 5).collect()}
    assert sorted(got.values()) == [float(i * i) for i in range(200)] and set(got) == set(range(200)) and any(got[i] != i * i for i in range(200))
    parts = {r["stratum"]: r["n"] for r in strata.null_partition(df, "k", [50, 30], 1).groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert parts == {0: 50, 1: 30}


def test_single_break(spark):
    df = spark.createDataFrame([("a", float(i), float(i if i < 10 else 30 - 2 * i)) for i in range(20)], "g string, x double, y double")
    got = drift.single_break(df, ["g"], "x", "y").first()
    assert 8.5 <= got["break"] <= 10.5 and got["sse"] < 1e-6


def test_store_and_dictionaries(spark, tmp_path):
    rows = spark.createDataFrame(
        [("w", "S1", 1, ["Variable", "Label", "Keep"]), ("w", "S1", 2, ["a ", "first", "yes"]), ("w", "S1", 3, ["A", "again", "no"]), ("w", "S1", 4, ["", "blank", ""]), ("w", "S2", 1, ["x"]), ("w", "S2", 2, ["b"])],
        "path string, sheet string, row_no long, cells array<string>",
    )
    layout = store.load_layouts({"d": '{"dataset": "d", "roles": ["Keep"]}'})["d"]
    got = {(r["table_name"], r["name"], r["definition"], r["roles"]) for r in store.parse_sheets(rows, layout, "1").collect()}
    assert got == {("S1", "a", "first", "Keep"), ("S2", "b", "", "")}
    s = store.Store(spark, str(tmp_path))
    tables = spark.createDataFrame([("d", "1", "S1", "proband", "p", 3, 2, "t")], store.SCHEMAS["tbl"])
    assert store.ingest(s, layout, "1", rows, tables) == {"feature": 2, "tbl": 1, "document": 0}
    other = store.load_layouts({}, {"e": '{"dataset": "e"}'})["e"]
    store.ingest(s, other, "9", rows, tables.withColumn("dataset", F.lit("e")))
    store.ingest(s, layout, "2", rows, tables.withColumn("version", F.lit("2")))
    assert sorted((r["dataset"], r["version"]) for r in s.table("version").collect()) == [("d", "1"), ("d", "2"), ("e", "9")]
    s.register()
    assert spark.sql("select count(*) from feature where dataset = 'e'").first()[0] == 2
    roles = spark.createDataFrame([("/a/Proband_Data/x.csv",), ("/a/b.csv",)], "p string").select(store.role_of(F.col("p"), {"proband": ["proband_data"]}).alias("r")).collect()
    assert [r["r"] for r in roles] == ["proband", None]


def test_sweep_rejects_one_place_of_many(spark, tmp_path):
    rng = np.random.default_rng(4)
    day = np.arange(3000) % 100
    segment = np.arange(3000) // 100 % 5
    price = rng.normal(size=3000) + 6 * ((segment == 0) & (day >= 80))
    spark.createDataFrame([(i, f"s{s}", float(i % 7)) for i, s in enumerate(segment)], "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.createDataFrame([(i, i, int(d), float(p)) for i, (d, p) in enumerate(zip(day, price))], "o_orderkey long, o_custkey long, d int, o_totalprice double")
    orders.withColumn("o_orderdate", F.expr("date_add(date'2000-01-01', d)")).drop("d").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r["place"], r["class"]): r for r in plans_typing.sweep_decision(spark, str(tmp_path)).collect()}
    assert got[4, "s0"]["reject"] and got[4, "s0"]["n_null"] == 999 and got[4, "s0"]["p_value"] == pytest.approx(0.001)
    assert not any(r["reject"] for k, r in got.items() if k[1] != "s0")


def test_schemes(spark):
    assert schemes.parse_scheme("kernel:2.5:9") == schemes.Scheme("kernel", 9, 2.5)
    with pytest.raises(ValueError, match="scheme"):
        schemes.parse_scheme("bins:3")
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, float(i % 100), "f", float(rng.normal() + (2 if i % 2 == 0 and i % 100 >= 80 else 0))) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, class int, x double, feature string, value double")
    got = {(r["place"], r["class"]): r["reject"] for r in schemes.sweep(df, "x", "id", schemes.parse_scheme("hardbins:quantile:5"), 200).collect()}
    assert got[4, 0] and not got[4, 1]
    assert schemes.localise(df, "x", schemes.parse_scheme("kernel:5:3")).select("place").distinct().count() == 3


def test_running_totals_and_quantiles_over_many_partitions(spark):
    """The plan stays flat however many ranges there are."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=3000), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").union(spark.createDataFrame([(-1, None)], "i int, x double"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2000")
        got = stats.running_total(df.where("i >= 0"), "i", "x", "t").agg(F.sum("t").alias("s"), F.max_by("t", "i").alias("last")).first()
        assert got["s"] == pytest.approx(np.cumsum(x).sum()) and got["last"] == pytest.approx(x.sum())
        found = stats.quantiles(df, "x", [0.0, 0.1, 0.333, 0.5, 1.0])
        assert [v for v, _ in found] == pytest.approx(np.quantile(x, [0.0, 0.1, 0.333, 0.5, 1.0]).tolist())
        assert [n for _, n in found] == [int((x < v).sum()) for v, _ in found]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_range_of(spark):
    edges = [1.0, 2.0, 2.5, 7.0, 9.0]
    got = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.2, 2.6, 8.0, 9.0, 10.0)], "x double").select(stats.range_of(F.col("x"), edges).alias("r")).collect()
    assert [r["r"] for r in got] == [0, 0, 1, 2, 3, 4, 4, 5]


def test_store_keeps_versions_apart(spark, tmp_path):
    layout = store.Layout("d", single_sheet=None)

    def sheets(*names, path="a.xlsx"):
        rows = [(path, "Table One", 1, ["Description", "NAME"])] + [(path, "Table One", i + 2, [f"the {n}", n]) for i, n in enumerate(names)]
        return spark.createDataFrame(rows, "path string, sheet string, row_no long, cells array<string>")

    def files(version):
        return spark.createDataFrame([(f"/x/Main/table_one-{version}.csv", 5, 2)], "path string, n_rows int, n_cols int")

    s = store.Store(spark, str(tmp_path))
    store.ingest_versions(s, layout, {"1": sheets("a", "b"), "2": sheets("a", "c", "d")}, {"1": files("1"), "2": files("2")}, {"core": ["main"]})
    f = s.table("feature")
    assert {(r["version"], r["table_name"], r["name"]) for r in f.collect()} == {("1", "table_one", "a"), ("1", "table_one", "b"), ("2", "table_one", "a"), ("2", "table_one", "c"), ("2", "table_one", "d")}
    assert {(r["version"], r["role"], r["title"]) for r in s.table("tbl").collect()} == {("1", "core", "Table One"), ("2", "core", "Table One")}
    assert sorted(r["version"] for r in s.table("version").collect()) == ["1", "2"]
    diff = catalogue.diff_versions(f.where("version = '1'"), f.where("version = '2'"))
    assert {(r["name"], r["kind"]) for r in diff.collect()} == {("b", "removed"), ("c", "added"), ("d", "added")}
    assert catalogue.in_scope(f, catalogue.scope(f)).count() == 3
    assert store.source_csv(s.table("tbl"), "d", "2", "table_one", "core").endswith("table_one-2.csv")
    with pytest.raises(ValueError):
        store.source_csv(s.table("tbl"), "d", "3", "table_one")
    s.clear("d")
    assert s.table("feature").count() == s.table("version").count() == 0


def test_sheets_of_one_name_in_two_workbooks(spark):
    rows = [("a", "S", 1, ["name", "label"]), ("a", "S", 2, ["x", "from a"]), ("b", "S", 1, ["label", "", "Name"]), ("b", "S", 2, ["from b", "", "y"]), ("b", "S", 3, ["again", "", "X"])]
    df = spark.createDataFrame(rows, "path string, sheet string, row_no long, cells array<string>")
    got = {(r["name"], r["definition"]) for r in store.parse_sheets(df, store.Layout("d"), "1").collect()}
    assert got == {("x", "from a"), ("y", "from b")}


def test_headers_of_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"y, z",w\n1,2,3\n')
    assert [r["n_cols"] for r in files.header_ncols(spark, f"{tmp_path}/a.csv").collect()] == [3]
    assert files.csv_columns(spark, f"{tmp_path}/a.csv") == ["x", "y, z", "w"]


def test_invariance_by_class_against_numpy(spark):
    rng = np.random.default_rng(3)
    n, d = 600, 3
    x = rng.normal(size=(n, d)) @ np.array([[1.0, 0.4, 0.0], [0.0, 1.0, 0.2], [0.0, 0.0, 1.0]])
    x[:, 0] += np.linspace(-1.5, 1.5, n)  # drifts along the axis
    grid = np.arange(n) // 60
    rows = [(i, int(grid[i]), 0, 1.0, f, float(x[i, f])) for i in range(n) for f in range(d)] + [(i, int(grid[i]), 1, 1.0, f, float(rng.normal())) for i in range(n, n + 0) for f in range(d)]
    df = spark.createDataFrame(rows, "id long, grid int, class int, r double, feature int, value double")
    got = {r["functional"]: r for r in inference.invariance_by_class(df, 300, 1).collect()}
    s = (x - x.mean(0)) / x.var(0)
    values, vectors = np.linalg.eigh(s.T @ s)
    w = np.cumsum(np.add.reduceat(s, np.arange(0, n, 60)), 0) @ (vectors / np.sqrt(values))
    norms = (w**2).sum(1)[:-1]
    assert got["max"]["statistic"] == pytest.approx(norms.max()) and got["integral"]["statistic"] == pytest.approx(norms.sum() / 10)
    assert got["max"]["p_value"] == pytest.approx(1 / 301) and got["max"]["rank"] == 3
    still = df.where("feature > 0")
    assert min(r["p_value"] for r in inference.invariance_by_class(still, 300, 1).collect()) > 0.02


def test_time_grid(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 2, 3, 3, 4, 5, 6, 7]] + [(None,)], "x double")
    got = {r["x"]: r["grid"] for r in inference.time_grid(df, "x", 5).collect()}
    assert got == {1.0: 1, 2.0: 1, 3.0: 2, 4.0: 3, 5.0: 3, 6.0: 4, 7.0: 4}


def test_joint_likelihood_ratio(spark):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=800), rng.normal(size=800)
    p = np.exp(np.stack([0 * x, 0.3 + 0.9 * x, -0.2 * x], 1))
    k = np.array([rng.choice(3, p=row / row.sum()) for row in p])
    df = spark.createDataFrame([(float(a), float(b), [float(c == j) for j in range(3)]) for a, b, c in zip(x, z, k)], "x double, z double, y array<double>")
    stat, dof, value = inference.joint_lrt(df, ["x", "z"], ["z"], "y", 3)
    assert dof == 2 and stat > 50 and value < 1e-6
    stat, dof, value = inference.joint_lrt(df, ["x", "z"], ["x"], "y", 3)
    assert dof == 2 and value > 0.001
    coef = np.array([[0.1, 0.2], [-0.3, 0.4]])
    eta = np.concatenate([np.zeros((800, 1)), coef[:, 0] + x[:, None] * coef[:, 1]], 1)
    want = (eta[np.arange(800), k] - np.log(np.exp(eta).sum(1))).sum()
    assert inference.multinomial_loglik(df, ["x"], "y", coef) == pytest.approx(want)


def test_logistic_contrast(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 3))
    moved = (rng.random(600) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    rows = [(int(m), *(None if i % 50 == 0 and j == 1 else float(v) for j, v in enumerate(r)), 1.0) for i, (m, r) in enumerate(zip(moved, x))]
    got = {r["feature"]: r["weight"] for r in enrichment.logistic_contrast(spark.createDataFrame(rows, "moved int, a double, b double, c double, same double"), "moved", ["a", "b", "c", "same"]).collect()}
    assert set(got) == {"a", "b", "c"} and 1.5 < got["a"] < 2.6 and abs(got["b"]) < 0.4


def test_manifests(spark, tmp_path):
    for i, status in enumerate(["ok", "ok", "failed"]):
        run = f"{tmp_path}/fit/r{i}"
        assert sinks.read_manifest(spark, run) is None
        sinks.write_manifest(spark, run, {"stage": "fit", "status": status, "finished_at": f"2024-01-0{i + 1}", "params": {"k": i, "axis": "age"}})
    assert sinks.read_manifest(spark, f"{tmp_path}/fit/r1")["params"] == {"k": 1, "axis": "age"}
    assert sinks.resolve_run(spark, str(tmp_path), "fit").endswith("r1")
    assert sinks.resolve_run(spark, str(tmp_path), "fit", {"k": 0, "axis": "age"}).endswith("r0")
    with pytest.raises(ValueError):
        sinks.resolve_run(spark, str(tmp_path), "fit", {"k": 2})
    sinks.clear_log(spark, f"{tmp_path}/fit/r1")
    assert sinks.resolve_run(spark, str(tmp_path), "fit").endswith("r0")
    (tmp_path / "a.bin").write_bytes(b"abc")
    import hashlib

    assert sinks.file_digest(spark, f"{tmp_path}/a.bin").first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_recodes_of_a_few_rows(spark):
    df = spark.createDataFrame([(1, " 7 ", "1"), (2, "x", ""), (3, None, None)], "id int, n string, f string")
    got = [(r["a"], r["b"]) for r in df.select(cohort.count(F.col("n")).alias("a"), cohort.calculated_flag(F.col("f")).alias("b"), "id").orderBy("id").collect()]
    assert got == [(7.0, 1), (None, 0), (None, 0)]
    assert cohort.shared_features(["a", "b", "c"], ["c", "a"]) == ["a", "c"]
    with pytest.raises(KeyError):
        cohort.build_matrix(df, "id", ["n", "gone"], [])
    bands = df.select(strata.dichotomy(F.col("id"), 2.0, False).alias("b")).collect()
    assert [r["b"] for r in bands] == ["spared", "impaired", "impaired"]
    twice = spark.range(1000).agg(F.count_distinct(cohort.random_axis(F.col("id"), 1))).first()[0]
    assert twice == 1000


def plain_em(x, means, var, weights, passes):
    """EM of Gaussian classes as the textbook has it."""
    for _ in range(passes):
        j = np.log(weights) - 0.5 * (np.log(2 * np.pi * var)[None] + (x[:, None] - means[None]) ** 2 / var[None]).sum(2)
        top = j.max(1, keepdims=True)
        r = np.exp(j - top)
        ll = (top[:, 0] + np.log(r.sum(1))).sum()
        r /= r.sum(1, keepdims=True)
        n = r.sum(0)
        weights, means = n / n.sum(), (r.T @ x) / n[:, None]
        var = np.stack([(r[:, k : k + 1] * (x - means[k]) ** 2).sum(0) / n[k] for k in range(len(n))])
    return ll, weights, means, var


def test_squared_steps_end_where_plain_em_does(spark):
    df = planted(spark)
    columns = mixture.Columns(["c1", "c2"])
    x = df.select("c1", "c2").toPandas().to_numpy()
    start = mixture.Mixture(columns, np.full(3, 1 / 3), np.array([[0.0, 0.0], [4.0, 0.0], [0.0, 4.0]]), np.ones((3, 2)))
    (own,) = mixture.fit_many(df, "id", columns, [(3, -1, 0)], starts={0: start}, tol=1e-10)
    ll, weights, means, var = plain_em(x, start.means, start.variances, start.weights, 400)
    assert own.converged and own.log_likelihood == pytest.approx(ll, abs=1e-4)
    assert np.allclose(own.means, means, atol=1e-3) and np.allclose(own.variances, var, atol=1e-3) and np.allclose(own.weights, weights, atol=1e-3)


def test_runs_by_a_column_see_its_rows_alone(spark):
    columns = mixture.Columns(["c1", "c2"])
    df = planted(spark).withColumn("part", F.col("id") % 2)
    start = mixture.Mixture(columns, np.full(2, 0.5), np.array([[0.0, 0.0], [4.0, 2.0]]), np.ones((2, 2)))
    both = mixture.fit_many(df, "id", columns, [(2, d, 0) for d in range(2)], starts={0: start}, by="part", most=4)
    for d, m in enumerate(both):
        (own,) = mixture.fit_many(df.where(F.col("part") == d), "id", columns, [(2, -1, 0)], starts={0: start}, most=4)
        assert m.log_likelihood == pytest.approx(own.log_likelihood)


def test_search_finds_planted_classes(spark):
    df = planted(spark, 300)
    columns = mixture.Columns(["c1", "c2"])
    k, tests = order.sequential_search(df, "id", columns, anchor=2, cap=4, n_init=2, n_random=2, most=20, screen=19, confirm=19)
    assert k == 3 and [t["rejected"] for t in tests] == [True, False]
    one = mixture.fit(df, "id", columns, 2, n_init=2, most=5)
    two = order.split(one, 0, np.random.default_rng(0))
    assert two.weights.sum() == pytest.approx(1) and len(two.means) == 3
    scores = spark.createDataFrame([(1, -10.0), (2, -8.0), (3, -8.5)], "k int, ll double")
    assert [r["p_value"] for r in order.neighbour_tail(scores, "k", "ll").orderBy("k").collect()] == [None, pytest.approx(0.0455, abs=1e-4), pytest.approx(1.0)]
