"""What type a feature has: by its dictionary, by a list of types, and by the values observed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import value_levels
from terrane.operators.cohort import infer_type


def dictionary_types(feature: DataFrame, order: DataFrame) -> DataFrame:
    """name and type by the dictionary: of tables that share a name, the first in order counts.

    order has table_name and position.
    """
    t = feature.join(order, "table_name").withColumn("type", infer_type(F.col("field_type"), value_levels(F.col("values"))))
    return t.groupBy("name").agg(F.min(F.struct("position", "type", "table_name")).alias("m")).select("name", F.col("m.type").alias("dictionary_type"), F.col("m.table_name").alias("instrument"))


def listed_types(lists: DataFrame) -> DataFrame:
    """name and type of the features that are in exactly one list (name, type)."""
    return lists.groupBy("name").agg(F.min("type").alias("listed_type"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def observed_cardinality(long: DataFrame) -> DataFrame:
    """Distinct values of each feature that are there."""
    return long.where(F.col("value").isNotNull()).groupBy("feature").agg(F.count_distinct("value").alias("n_distinct"))


def reconcile(dictionary: DataFrame, listed: DataFrame, observed: DataFrame) -> DataFrame:
    """Chosen type (the list's, else the dictionary's), whether both agree, and whether what is
    observed fits: a binary feature has two values at most. Without either, the type is null."""
    j = dictionary.join(listed, "name", "full_outer").join(observed.withColumnRenamed("feature", "name"), "name", "left")
    chosen = F.coalesce("listed_type", "dictionary_type")
    return j.select("name", chosen.alias("type"), (F.col("listed_type") == F.col("dictionary_type")).alias("agree"), F.when(chosen == "binary", F.col("n_distinct") <= 2).otherwise(F.lit(True)).alias("consistent"), "n_distinct")
