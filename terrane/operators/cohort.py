"""Cohort integration: instruments of one row per person joined to a matrix of complete cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.stats import quantiles


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def drop_repeated(df: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs once: a key that is there twice loses all its rows."""
    once = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(key)
    return df.join(once, key, "left_semi")


def union_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both tables' rows, on the columns that both have, in the first one's order."""
    common = [c for c in a.columns if c in b.columns]
    return a.select(common).unionByName(b.select(common))


def _with_new(a: DataFrame, b: DataFrame, key: str, how: str) -> DataFrame:
    return a.join(b.select(key, *(c for c in b.columns if c not in a.columns)), key, how)


def integrate(frames: list[DataFrame], key: str, how: str = "inner", features: list[str] | None = None) -> DataFrame:
    """Complete cases of all tables joined on key (inner or full outer), as numbers.

    Of columns that several tables have, the first one's counts.
    """
    joined = reduce(lambda a, b: _with_new(a, b, key, how), frames)
    wanted = [c for c in (features or joined.columns) if c != key]
    return joined.select(key, *(F.expr(f"try_cast(`{c}` as double)").alias(c) for c in wanted)).dropna("any")


def within_cutoff(df: DataFrame, year: str, cutoff: float | None) -> DataFrame:
    """Rows of the cutoff year or before; the column is used up. No cutoff changes nothing."""
    return df if cutoff is None else df.where(F.col(year) <= cutoff).drop(year)


def derived_year_within(df: DataFrame, registration: DataFrame, key: str, cutoff: float) -> DataFrame:
    """Rows whose year, from the registration's year and both ages, is before the year after cutoff."""
    year = F.col("registration_year") + (F.col("age_at_eval") - F.col("age_at_registration"))
    return df.join(registration, key).where(year < cutoff + 1).select(df.columns)


def family_ids(people: DataFrame, families: DataFrame, key: str, family: str) -> DataFrame:
    """Each person's family, as a string; who has none is a family of one."""
    return people.select(key).join(families.select(key, family), key, "left").select(key, F.coalesce(F.col(family).cast("string"), F.col(key).cast("string")).alias("family"))


def parent_age_at_birth(people: DataFrame, key: str, parent: str, age: str, low: float = 12, high: float = 60) -> DataFrame:
    """A parent's age when a child was born, from both ages now; outside low to high it is null."""
    p = people.select(F.col(key).alias("_parent"), F.col(age).alias("_age"))
    diff = F.col("_age") - F.col(age)
    return people.join(p, F.col(parent) == F.col("_parent"), "left").select(key, F.when(diff.between(low, high), diff).alias("parent_age"))


def one_hot(df: DataFrame, key: str, column: str, prefix: str, levels: list[str]) -> DataFrame:
    """A 0/1 column for each level but the first; a missing value stays missing."""
    return df.select(key, *(F.when(F.col(column).isNotNull(), (F.col(column) == v).cast("int")).alias(f"{prefix}{i}") for i, v in enumerate(levels) if i))


def ordinal(column: Column, ranks: dict[str, int]) -> Column:
    whole = F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))
    return whole[F.trim(column)]


def flags_or_null(df: DataFrame, flags: list[str]) -> DataFrame:
    """Flags as 0/1, all null in rows where none is set."""
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags))
    return df.withColumns({f: F.when(total > 0, F.coalesce(F.col(f).cast("int"), F.lit(0))) for f in flags})


def binary(column: Column, positive: list[str], negative: list[str]) -> Column:
    return F.when(column.isin(*positive), 1).when(column.isin(*negative), 0)


def derive_axes(df: DataFrame) -> DataFrame:
    """age, year and lag from diagnosis_months, registration_year, registration_age and eval_age.

    Age outside 0 to 18, years outside 1985 to 2026 and lags under -1 are null.
    """
    age = F.col("diagnosis_months") / 12
    year = F.col("registration_year") - F.col("registration_age") + age
    lag = F.col("eval_age") - age
    return df.withColumns({"age": F.when(age.between(0, 18), age), "year": F.when(year.between(1985, 2026), year), "lag": F.when(lag >= -1, lag)})


PERCENTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: values present and missing, the share, and five percentiles (exact, from
    running totals over ranges of value)."""
    sizes = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count(c).alias(c) for c in columns)).first()
    rows = []
    for c in columns:
        n, found = sizes[c], [q for q, _ in quantiles(df, c, list(PERCENTILES.values()))] or [None] * len(PERCENTILES)
        rows.append((c, n, sizes["_n"] - n, n / sizes["_n"] if sizes["_n"] else None, *found))
    return df.sparkSession.createDataFrame(rows, "axis string, n_present long, n_missing long, coverage double, " + ", ".join(f"{p} double" for p in PERCENTILES))


def contemporaneity(df: DataFrame, years: list[str], diagnosis: str) -> DataFrame:
    """How far apart instruments' years are and how long after the diagnosis: one row."""
    cols = F.filter(F.array(*years), lambda x: x.isNotNull())
    span = F.array_max(cols) - F.array_min(cols)
    mean = F.aggregate(cols, F.lit(0.0), lambda a, x: a + x) / F.size(cols)
    rows = df.select(F.when(F.size(cols) > 0, span).cast("double").alias("span"), F.when(F.size(cols) > 0, mean - F.col(diagnosis)).alias("after"))
    spans = [q for q, _ in quantiles(rows, "span", [0.5, 0.9])] or [None, None]
    after = [q for q, _ in quantiles(rows, "after", [0.5])] or [None]
    return rows.agg(F.lit(spans[0]).cast("double").alias("median_span"), F.lit(spans[1]).cast("double").alias("p90_span"), F.avg((F.col("span") > 1).cast("double")).alias("share_over_1"), F.lit(after[0]).cast("double").alias("median_after"))


def infer_type(field_type: Column, levels: Column) -> Column:
    """continuous, binary or categorical, from a dictionary's field type and number of levels."""
    return F.when(field_type.isin("calculated", "dropdown"), "continuous").when((field_type == "radio") & (levels == 2), "binary").otherwise("categorical")


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows chosen by a seeded hash of their key: the same on every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def count(column: Column) -> Column:
    """A cell as a number; what is none is missing."""
    return F.trim(column.cast("string")).try_cast("double")


def calculated_flag(column: Column) -> Column:
    """1 where a calculated field is 1, else 0: its blank is a real 0."""
    return F.coalesce((count(column) == 1).cast("int"), F.lit(0))


def collapsed_one_hot(df: DataFrame, key: str, column: str, groups: DataFrame, prefix: str, levels: list[str]) -> DataFrame:
    """one_hot() of the groups that a column's values are in (groups: value, group)."""
    named = df.join(groups.select(F.col("value").alias("_v"), F.col("group").alias("_g")), F.col(column) == F.col("_v"), "left")
    return one_hot(named, key, "_g", prefix, levels)


def random_axis(key: Column, seed: int) -> Column:
    """An axis without meaning: uniform in [0, 1) by a seeded hash of the key, the same on every run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def shared_features(first: list[str], second: list[str]) -> list[str]:
    """The features of both cohorts, in the first one's order."""
    there = set(second)
    return [f for f in first if f in there]


def build_matrix(df: DataFrame, key: str, features: list[str], covariates: list[str]) -> tuple[DataFrame, DataFrame]:
    """The features and the covariates of an integrated cohort, each with its key. KeyError if a column
    is missing."""
    missing = [c for c in (key, *features, *covariates) if c not in df.columns]
    if missing:
        raise KeyError(", ".join(missing))
    return df.select(key, *features), df.select(key, *covariates)


def last_by_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and value of a map's rows: of repeated keys the last counts, a blank value is `unmapped`."""
    blank = F.coalesce(F.trim(value), F.lit("")) == ""
    return df.groupBy(key).agg(F.max_by(F.when(blank, "unmapped").otherwise(F.trim(value)), order).alias(value))
