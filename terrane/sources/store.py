"""A catalogue kept as Parquet tables partitioned by dataset and version, and the parsing of dictionaries into it."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions.text import cleaned, truthy
from terrane.operators.catalogue import resolve_tables, role_of, strip_version  # noqa: F401
from terrane.sources.sinks import exists

SCHEMAS = {
    "dataset": "dataset string, display_name string",
    "version": "dataset string, version string, ship_folder string, dictionary_path string, ingested_at timestamp",
    "feature": "dataset string, version string, table_name string, name string, definition string, values string, field_type string, roles string, uid long",
    "tbl": "dataset string, version string, table_name string, role string, path string, n_rows long, n_cols int, title string",
    "document": "dataset string, version string, title string, path string, length long",
    "synonym": "word string, synonym string",
}


@dataclass
class Layout:
    """How a dataset's dictionary is laid out: column aliases, and one sheet for all tables or one each."""

    dataset: str
    display_name: str = ""
    single_sheet: str | None = None
    name: list[str] = field(default_factory=lambda: ["name", "variable", "field"])
    table: list[str] = field(default_factory=lambda: ["table", "form", "instrument"])
    definition: list[str] = field(default_factory=lambda: ["definition", "description", "label"])
    values: list[str] = field(default_factory=lambda: ["values", "value coding", "choices"])
    field_type: list[str] = field(default_factory=lambda: ["type", "field type"])
    roles: list[str] = field(default_factory=list)


def load_layouts(texts: dict[str, str], own: dict[str, str] | None = None) -> dict[str, Layout]:
    """Layouts from JSON texts by name; a project's own override those built in."""
    merged = texts | (own or {})
    return {k: Layout(**json.loads(v)) for k, v in merged.items()}


def parse_sheets(rows: DataFrame, layout: Layout, version: str) -> DataFrame:
    """Feature rows of workbooks' sheets (path, sheet, row_no, cells), without blank or repeated names.

    The first row of a sheet is its header; each row is read once, beside its sheet's header, which a
    map from names to places stands for (of equal names the leftmost). Of names that differ in case
    alone the first in a table counts.
    """
    own = rows if layout.single_sheet is None else rows.where(F.col("sheet") == layout.single_sheet)
    top = F.min_by(F.transform("cells", lambda c: F.lower(F.trim(c))), "row_no")
    headers = own.groupBy("path", "sheet").agg(F.min("row_no").alias("_first"), top.alias("_header"))
    body = own.join(headers, ["path", "sheet"]).where("row_no > _first")

    def cell(aliases: list[str]):
        at = F.coalesce(*(F.when(F.array_contains("_header", a.lower()), F.array_position("_header", a.lower())) for a in aliases), F.lit(0))
        return F.when(at > 0, F.get("cells", (at - 1).cast("int")))

    roles = [F.when(truthy(cleaned(cell([r]))), F.lit(r)) for r in layout.roles]
    named = body.select(
        F.lit(layout.dataset).alias("dataset"), F.lit(version).alias("version"), (cleaned(cell(layout.table)) if layout.single_sheet else F.col("sheet")).alias("table_name"), cleaned(F.coalesce(cell(layout.name), F.get("cells", F.lit(0)))).alias("name"),
        cleaned(cell(layout.definition)).alias("definition"), cleaned(cell(layout.values)).alias("values"), cleaned(cell(layout.field_type)).alias("field_type"), F.concat_ws(",", *roles).alias("roles"), F.col("row_no").cast("long").alias("uid"), "path",
    )
    w = Window.partitionBy("table_name", F.lower("name")).orderBy("path", "uid")
    return named.where("name <> '' and table_name <> ''").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "path")


class Store:
    """Tables below a root. Replacing a version rewrites its partitions alone."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(path).select([c.split()[0] for c in SCHEMAS[name].split(", ")])

    def replace(self, name: str, rows: DataFrame, of: tuple[str, ...] | None = None) -> None:
        """rows in place of what the store has of their datasets and versions (of synonyms: of
        everything). Other versions of a dataset stay as they are. of: a dataset, or dataset and version,
        whose rows go even if there are none in their place."""
        cols = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        keys = [c for c in ("dataset", "version") if c in cols]
        w = rows.select(cols).write.mode("overwrite")
        if keys:
            w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
        w.parquet(f"{self.root}/{name}")
        if of and keys and rows.where(" and ".join(f"{k} <=> '{v}'" for k, v in zip(keys, (x.replace("\\", "\\\\").replace("'", "\\'") for x in of), strict=False))).isEmpty():
            self._delete(name, dict(zip(keys, of, strict=False)))

    def _delete(self, name: str, keys: dict[str, str]) -> None:
        """Takes a table's partition out."""
        jvm = self.spark.sparkContext._jvm
        escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        path = jvm.org.apache.hadoop.fs.Path("/".join([f"{self.root}/{name}", *(f"{k}={escape(v)}" for k, v in keys.items())]))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self, dataset: str) -> None:
        """Takes a dataset with all its versions out of every table."""
        for name in SCHEMAS:
            if "dataset string" in SCHEMAS[name]:
                self._delete(name, {"dataset": dataset})

    def register(self) -> None:
        """All tables as temporary views, for SQL."""
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(name)


def ingest(store: Store, layout: Layout, version: str, sheets: DataFrame, tables: DataFrame, documents: DataFrame | None = None, synonyms: DataFrame | None = None, features: DataFrame | None = None) -> dict[str, int]:
    """Puts a version's dictionary (or features, if it was read already), tables (with stem and path)
    and documents into the store, in place of what it has of that version, even where there is nothing.

    Returns how many features, tables and documents there now are of the dataset.
    """
    spark, name = store.spark, layout.dataset
    store.replace("dataset", spark.range(1).select(F.lit(name).alias("dataset"), F.lit(layout.display_name or name).alias("display_name")))
    now = spark.range(1).select(F.lit(name).alias("dataset"), F.lit(version).alias("version"), F.lit(os.path.basename(version)).alias("ship_folder"), F.lit("").alias("dictionary_path"), F.current_timestamp().alias("ingested_at"))
    store.replace("version", now)
    store.replace("feature", parse_sheets(sheets, layout, version) if features is None else features, of=(name, version))
    store.replace("tbl", tables, of=(name, version))
    if documents is not None:
        store.replace("document", documents, of=(name, version))
    if synonyms is not None:
        store.replace("synonym", synonyms)
    return {t: store.table(t).where(F.col("dataset") == name).count() for t in ("feature", "tbl", "document")}


def ingest_versions(store: Store, layout: Layout, sheets: dict[str, DataFrame], files: dict[str, DataFrame], folders: dict[str, list[str]] | None = None, clear: bool = False) -> dict[str, int]:
    """Puts all versions of a dataset into the store: by version, the sheets of its dictionary, and its
    data files (path, n_rows, n_cols), whose tables the dictionary's sheets are bound to."""
    if clear:
        store.clear(layout.dataset)
    name, counts = layout.dataset, {}
    columns = [c.split()[0] for c in SCHEMAS["feature"].split(", ")]
    for version in sheets:
        tables, keyed = resolve_tables(files[version], parse_sheets(sheets[version], layout, version), folders or {}, version)
        rows = tables.select(F.lit(name).alias("dataset"), F.lit(version).alias("version"), "table_name", "role", "path", F.col("n_rows").cast("long").alias("n_rows"), F.col("n_cols").cast("int").alias("n_cols"), F.coalesce("sheet", "table_name").alias("title"))
        counts = ingest(store, layout, version, sheets[version], rows, features=keyed.select(columns))
    return counts


def source_csv(tbl: DataFrame, dataset: str, version: str, table_name: str, role: str | None = None) -> str:
    """The path of a table's file; of several the first. ValueError if there is none."""
    rows = tbl.where((F.col("dataset") == dataset) & (F.col("version") == version) & (F.col("table_name") == table_name))
    found = (rows.where(F.col("role") == role) if role is not None else rows).agg(F.min("path")).first()[0]
    if found is None:
        raise ValueError(f"no file for {dataset} {version} {table_name} {role or ''}".strip())
    return found
