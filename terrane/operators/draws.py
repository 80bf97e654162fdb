"""Random draws that each task makes for its own rows, from hashes of keys, and adds up.

A draw is a function of (key, draw), so no draw needs all rows together, a lost task makes the same
draws again, and no row is repeated for a draw: tasks send sums by draw alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Most numbers in a block of rows by statistics, and in the sums by draw that a task holds.
BLOCK, HELD = 2_000_000, 16_000_000
# Chances of a Poisson(1) number to be at most 0, 1, 2, ...
POISSON = np.cumsum([1.0, *(1 / np.cumprod(np.arange(1.0, 13)))]) / np.e


def uniform(hashes: np.ndarray, draw: int | np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each 64-bit hash and the draw (the mixing of splitmix64)."""
    step = np.asarray(draw, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = hashes.astype(np.int64).view(np.uint64) + step
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def family_weights(hashes: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """How often each family (by its hash) is drawn in each replicate: families by replicates.

    Numbers are independent Poisson(1), which drawing as many families as there are comes to with
    many families. In replicate 0 each family is there once.
    """
    out = np.searchsorted(POISSON, uniform(hashes[:, None], reps)).astype(float)
    out[:, reps == 0] = 1.0
    return out


def _vectors(totals: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.list_(pa.float64()))], ["rep", "sums"])


def family_sums(df: DataFrame, family: str, columns: list[str], statistics: Callable[[pa.RecordBatch], np.ndarray], width: int, n_boot: int, seed: int = 0) -> DataFrame:
    """rep (0: as observed, 1 to n_boot: families drawn anew) and sums (array) of rows' statistics.

    statistics makes rows by width numbers of a batch with the given columns. A task adds up its
    rows by family, and multiplies replicates by families by statistics; tasks' sums meet by replicate.
    Rows with a null family are families of their own, if they differ in some column.
    """
    own = F.when(F.col(family).isNotNull(), F.xxhash64(F.col(family), F.lit(seed))).otherwise(F.xxhash64(*columns, F.lit(seed + 1)))
    slots = df.sparkSession.sparkContext.defaultParallelism
    rows = df.select(*columns, own.alias("_hash")).coalesce(slots)
    each = max(1, HELD // width)
    out = None
    for first in range(0, n_boot + 1, each):
        reps = np.arange(first, min(n_boot + 1, first + each))

        def add_up(batches, reps=reps):
            total, step = np.zeros((len(reps), width)), max(1, BLOCK // width)
            for b in batches:
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    keys, place = np.unique(part.column("_hash").to_numpy(), return_inverse=True)
                    order = np.argsort(place, kind="stable")
                    sums = np.add.reduceat(statistics(part)[order], np.searchsorted(place[order], np.arange(len(keys))))
                    total += family_weights(keys, reps).T @ sums
            yield _vectors(dict(zip(reps.tolist(), total, strict=True)))

        got = rows.mapInArrow(add_up, "rep int, sums array<double>")
        out = got if out is None else out.unionByName(got)

    def meet(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for rep, v in zip(b.column("rep").to_pylist(), b.column("sums"), strict=True):
                v = v.values.to_numpy(zero_copy_only=False)
                totals[rep] = totals[rep] + v if rep in totals else v
        if totals:
            yield _vectors(totals)

    return out.repartition("rep").mapInArrow(meet, "rep int, sums array<double>")


def dealt_sums(rows: DataFrame, by: list[str], hashed: str, value: str, weight: str, ends: np.ndarray, places: list, n_draws: int, place_kind: str = "int") -> DataFrame:
    """draw (1 to n_draws), place, by, s and w: sums of weight times value, and of weight, when rows
    are dealt to places anew. ends are the running shares of all places but the last; by are columns
    with few values."""
    kinds = dict(rows.dtypes)
    schema = f"draw int, place {place_kind}, " + ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", s double, w double"
    types = to_arrow_schema(StructType.fromDDL(schema))

    def deal(batches):
        sums: dict = {}  # by: draws x places, of weighted values and of weights
        for b in batches:
            x, w, at = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_x", "_w", "_hash"))
            code: dict = {}
            own = np.array([code.setdefault(k, len(code)) for k in zip(*(b.column(c).to_pylist() for c in by), strict=True)], np.int64)
            shape = (n_draws, len(places), len(code))
            got = np.zeros((2, *shape))
            for draw in range(n_draws):
                cell = np.searchsorted(ends, uniform(at, draw + 1)) * len(code) + own
                for part, values in zip(got, (x, w), strict=True):
                    part[draw] = np.bincount(cell, values, shape[1] * shape[2]).reshape(shape[1:])
            for k, i in code.items():
                sums[k] = sums.get(k, 0) + got[:, :, :, i]
        for k, (s, w) in sums.items():
            draw, place = np.nonzero(w)
            n = len(draw)
            cols = [draw + 1, [places[i] for i in place], *([v] * n for v in k), s[draw, place], w[draw, place]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(cols, types, strict=True)], schema=types)

    x = F.coalesce(F.col(weight) * F.col(value), F.lit(0.0)).cast("double")
    w = F.when(F.col(value).isNotNull(), F.col(weight)).otherwise(0.0).cast("double")
    parts = rows.select(*by, x.alias("_x"), w.alias("_w"), F.col(hashed).alias("_hash")).mapInArrow(deal, schema)
    return parts.groupBy("draw", "place", *by).agg(F.sum("s").alias("s"), F.sum("w").alias("w"))


def drawn_sums(rows: DataFrame, by: list[str], hashed: str, columns: list[str], n_boot: int) -> DataFrame:
    """rep (1 to n_boot), by and the columns' sums when families (by hash) are drawn anew; by are
    columns with few values."""
    kinds = dict(rows.dtypes)
    schema = "rep int, " + ", ".join(f"`{c}` {kinds[c]}" for c in by) + "".join(f", `{c}` double" for c in columns)
    types = to_arrow_schema(StructType.fromDDL(schema))
    reps = np.arange(1, n_boot + 1)

    def draw(batches):
        sums: dict = {}
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1)
            keys, at = list(zip(*(b.column(c).to_pylist() for c in by), strict=True)), b.column("_hash").to_numpy()
            code: dict = {}
            own = np.array([code.setdefault(k, len(code)) for k in keys], np.int64)
            step = max(1, BLOCK // n_boot)
            for k, i in code.items():
                mine = np.flatnonzero(own == i)
                for lo in range(0, len(mine), step):
                    part = mine[lo : lo + step]
                    sums[k] = sums.get(k, 0) + family_weights(at[part], reps).T @ x[part]
        for k, v in sums.items():
            cols = [reps, *([c] * n_boot for c in k), *v.T]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, types, strict=True)], schema=types)

    parts = rows.select(*by, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns), F.col(hashed).alias("_hash")).mapInArrow(draw, schema)
    return parts.groupBy("rep", *by).agg(*(F.sum(c).alias(c) for c in columns))
