"""python -m terrane QUERY SF_DIR [--format table|json|csv|tsv|markdown] [--limit N]: runs a query and shows its rows."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from terrane import plans
from terrane.sources.sinks import render


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("query", choices=sorted(plans.QUERIES))
    p.add_argument("sf_dir")
    p.add_argument("--format", default="table", choices=["table", "json", "csv", "tsv", "markdown"])
    p.add_argument("--limit", type=int, default=50)
    a = p.parse_args()
    spark = SparkSession.builder.appName("terrane").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    print(render(plans.QUERIES[a.query](spark, a.sf_dir).limit(a.limit), a.format))
    spark.stop()


if __name__ == "__main__":
    main()
