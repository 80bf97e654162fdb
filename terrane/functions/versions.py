"""Version strings: ISO dates before dotted numbers before anything else; the latest is the greatest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_key(version: Column) -> Column:
    """A struct that orders versions: kind (2 date, 1 dotted number, 0 other), numbers, string."""
    date = version.rlike(r"^\d{4}-\d{2}-\d{2}$")
    dotted = version.rlike(r"^\d+(\.\d+)*$")
    numbers = F.transform(F.split(F.regexp_replace(version, "-", "."), r"\."), lambda x: x.cast("bigint"))
    return F.struct(
        F.when(date, 2).when(dotted, 1).otherwise(0).alias("kind"),
        F.when(date | dotted, numbers).otherwise(F.array().cast("array<bigint>")).alias("numbers"),
        version.alias("version"),
    )
