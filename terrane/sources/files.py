"""Sources: CSV tables, sheets, text documents and version folders, all read by Spark."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.text import cleaned

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Those of the columns that a CSV table has, as strings; the scan reads no others."""
    df = spark.read.option("header", True).csv(path)
    return df.select([c for c in columns if c in df.columns])


def with_file_row(df: DataFrame) -> DataFrame:
    """df with an order of the rows as they are in their files."""
    return df.withColumn("_file_row", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))


def count_data_rows(spark: SparkSession, path: str) -> DataFrame:
    """path and n_rows: each file's line ends less the header, 0 at least."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"))
    return lines.groupBy("path").agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("n_rows"))


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """A CSV table's header."""
    return spark.read.option("header", True).csv(path).columns


def header_ncols(spark: SparkSession, path: str) -> DataFrame:
    """path and n_cols: how many columns the first line of each file has, quoted commas aside."""
    lines = spark.read.option("wholetext", False).text(path).select(F.input_file_name().alias("path"), "value", F.monotonically_increasing_id().alias("_i"))
    first = lines.groupBy("path").agg(F.min_by("value", "_i").alias("header"))
    return first.select("path", F.size(F.split(F.regexp_replace("header", r'"(?:[^"]|"")*"', "q"), ",")).alias("n_cols"))


def version_folders(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """version and path of the files below path whose folder matches pattern's first group."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.withColumn("version", F.regexp_extract("path", pattern, 1)).where("version <> ''")


def discover_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, title and size of documents below a folder (no content is read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.where(F.lower("path").rlike(r"\.(pdf|docx?|rtf|txt|md)$")).select("path", "length", F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("title"))


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of a workbook, in order."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_NS}si"):
            shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
        target = targets[sheet.get(_REL)].lstrip("/")
        for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_NS}row"):
            cells: list[str] = []
            for c in row.findall(f"{_NS}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                v = c.find(f"{_NS}v")
                text = "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                cells += [""] * (at - len(cells)) + [text]
            out.append((sheet.get("name"), int(row.get("r") or len(out) + 1), cells))
    return out


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row_no and cleaned cells of all workbooks at path: a file is read in one task."""

    def rows(batches):
        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                got = sheet_rows(content)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(got)), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.list_(pa.string()))], ["path", "sheet", "row_no", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    raw = files.mapInArrow(rows, "path string, sheet string, row_no long, cells array<string>")
    return raw.withColumn("cells", F.transform("cells", cleaned))
