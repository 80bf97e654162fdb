"""Sinks: content-addressed runs of Parquet frames, a resumable log of units, and rendered rows."""

from __future__ import annotations

import csv
import hashlib
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.text import one_line


def canonical_json(obj) -> str:
    """The same text for equal parameters: sorted keys, no blanks, ASCII."""
    return json.dumps(obj, sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=str)


def params_hash(params) -> str:
    return hashlib.sha256(canonical_json(params).encode()).hexdigest()


class Run:
    """Frames of a run, in a folder named by a hash of its parameters; a frame is written once."""

    def __init__(self, root: str, stage: str, params: dict):
        self.path = f"{root}/{stage}/{params_hash(params)[:16]}"

    def frame(self, spark: SparkSession, name: str, make) -> DataFrame:
        """The frame kept under name, else the one that make() gives, kept from now on."""
        path = f"{self.path}/{name}.parquet"
        if not exists(spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class UnitLog:
    """Units of work that a run has finished, as appended Parquet rows; the rest are to do."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def done(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def pending(self, units: DataFrame, key: list[str]) -> DataFrame:
        return units.join(self.done().select(key), key, "left_anti")

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def digest(df: DataFrame) -> DataFrame:
    """n_rows and a digest of a frame's rows in any order: the sum of 48 bits of each row's MD5."""
    row = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns))))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias("digest"))


def render(df: DataFrame, fmt: str = "table", width: int = 60) -> str:
    """Rows as json, csv, tsv, markdown or a table; null is empty but in JSON."""
    if fmt == "json":
        return json.dumps([r.asDict(recursive=True) for r in df.toLocalIterator()], default=str, indent=1)
    if fmt in ("csv", "tsv"):
        out = io.StringIO()
        w = csv.writer(out, delimiter="," if fmt == "csv" else "\t", lineterminator="\n")
        rows = [[("" if v is None else v) for v in r] for r in df.toLocalIterator()]
        if rows:
            w.writerows([df.columns, *rows])
        return out.getvalue()
    flat = df.select(*(one_line(F.col(c), width).alias(c) for c in df.columns))
    rows = [list(r) for r in flat.toLocalIterator()]
    if not rows:
        return ""
    if fmt == "markdown":
        lines = ["| " + " | ".join(x.replace("|", "\\|") for x in r) + " |" for r in [df.columns, *rows]]
        return "\n".join([lines[0], "|" + " --- |" * len(df.columns), *lines[1:]])
    sizes = [max(len(r[i]) for r in [df.columns, *rows]) for i in range(len(df.columns))]
    return "\n".join("  ".join(x.ljust(n) for x, n in zip(r, sizes, strict=True)).rstrip() for r in [df.columns, *rows])


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of each file at path."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, run: str, data: dict) -> None:
    """A run's manifest (stage, status, finished_at, params), one row of Parquet beside its frames."""
    row = [(data["stage"], data.get("status", "ok"), data["finished_at"], canonical_json(data.get("params", {})), run)]
    spark.createDataFrame(row, "stage string, status string, finished_at string, params string, run string").write.mode("overwrite").parquet(f"{run}/manifest")


def read_manifest(spark: SparkSession, run: str) -> dict | None:
    if not exists(spark, f"{run}/manifest/_SUCCESS"):
        return None
    row = spark.read.parquet(f"{run}/manifest").first().asDict()
    return row | {"params": json.loads(row["params"])}


def resolve_run(spark: SparkSession, root: str, stage: str, require: dict | None = None) -> str:
    """The folder of a stage's latest run that ended well and has the required parameters. ValueError
    if there is none."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").schema("stage string, status string, finished_at string, params string, run string").parquet(f"{root}/*/*/manifest")
    good = rows.where((F.col("stage") == stage) & (F.col("status") == "ok"))
    for k, v in (require or {}).items():
        good = good.where(F.get_json_object("params", f"$.{k}") == (v if isinstance(v, str) else canonical_json(v)))
    found = good.agg(F.max_by("run", "finished_at")).first()[0]
    if found is None:
        raise ValueError(f"no finished run of {stage} with {require or {}}")
    return found


def clear_log(spark: SparkSession, path: str) -> None:
    """Takes away a log of units, so that all are to do again."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
