"""Mixtures refitted in every place of an axis, and in places dealt anew, all in the same passes.

A place gives each row a weight: one or none in a bin, a Gaussian's in a window. Under a draw a row has
the weights of another value of the axis, the one at a hashed share of the rows; so weights are
functions of (row, draw) that each task works out for itself, and nothing is stored or repeated for a
draw. Every fit starts from the pooled one. What stays of a fit is a summary: classes' weighted means and
spreads and their overlap with the pooled classes, from which alignment and distance are taken later.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.stats import bh_reject, quantiles
from terrane.operators import drift as D
from terrane.operators import enrichment as E
from terrane.operators import strata as S
from terrane.operators.draws import uniform
from terrane.operators.mixture import BLOCK, GATHERED, MOST, TASK, TINY, TOL, WORK, Columns, Mixture, _factors, _matrix, _Run
from terrane.operators.schemes import Scheme

# Weights at or below this count as none; values of the axis that draws of a window are read from.
FLOOR, VALUES = 1e-4, 1001
# Most rows in a block, whose places under a draw stay in a processor's cache.
ROWS = 16384
SUMMARY = "draw int, place int, n double, classes array<int>, features array<string>, means array<array<double>>, sds array<array<double>>, overlap array<array<double>>"


@dataclass
class Places:
    """Bins (edges, and the running shares of all but the last) or windows (focals, bandwidth, values)."""

    edges: list[float]
    ends: list[float]
    focals: list[float]
    bandwidth: float
    values: list[float]

    @property
    def many(self) -> int:
        return len(self.focals) or len(self.edges) + 1

    def weights(self, x: np.ndarray) -> np.ndarray:
        """Rows by places; a missing value has no weight."""
        if self.focals:
            w = np.exp(-0.5 * ((x[:, None] - np.array(self.focals)) / self.bandwidth) ** 2)
            return np.where(np.isfinite(w) & (w > FLOOR), w, 0.0)
        out = (np.searchsorted(self.edges, x, "right")[:, None] == np.arange(self.many)).astype(float)
        return np.where(np.isnan(x)[:, None], 0.0, out)

    def dealt(self, x: np.ndarray, hashes: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, draws (their places in draws), places and weights wherever there is one, under draws
        (0: as they are). Rows without a value have none."""
        u = uniform(hashes[:, None], draws)
        own = np.broadcast_to(x[:, None], u.shape)
        if self.focals:
            y = np.where(draws == 0, own, np.interp(u, np.linspace(0, 1, len(self.values)), self.values))
            w = self.weights(np.where(np.isnan(own), np.nan, y).ravel()).reshape(*u.shape, self.many)
            row, draw, place = np.nonzero(w)
            return row, draw, place, w[row, draw, place]
        place = np.where(draws == 0, np.searchsorted(self.edges, own, "right"), np.searchsorted(self.ends, u))
        row, draw = np.nonzero(~np.isnan(own))
        return row, draw, place[row, draw], np.ones(len(row))

    def cells(self, x: np.ndarray, hashes: np.ndarray, draw: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """What dealt() gives for one draw, by place: the place, its rows and their weights."""
        if self.focals:
            row, _, place, w = self.dealt(x, hashes, np.array([draw]))
            own = [np.flatnonzero(place == p) for p in range(self.many)]
            return [(p, row[o], w[o]) for p, o in enumerate(own) if len(o)]
        place = np.searchsorted(self.edges, x, "right") if draw == 0 else _above(uniform(hashes, draw), self.ends)
        place[np.isnan(x)] = self.many
        order = np.argsort(place.astype(np.uint8 if self.many < 256 else np.uint16), kind="stable")  # by digits
        at, one = np.cumsum([0, *np.bincount(place, minlength=self.many)]), np.ones(len(x))
        return [(p, order[at[p] : at[p + 1]], one[at[p] : at[p + 1]]) for p in range(self.many) if at[p + 1] > at[p]]


def _above(u: np.ndarray, ends: list[float]) -> np.ndarray:
    """How many of the ends, which ascend, each number is above."""
    if len(ends) > 8:
        return np.searchsorted(ends, u)
    out = np.zeros(len(u), np.intp)
    for e in ends:
        out += u > e
    return out


def places_of(df: DataFrame, axis: str, scheme: Scheme) -> Places:
    if scheme.kind == "kernel":
        values = [q for q, _ in quantiles(df, axis, np.linspace(0, 1, VALUES).tolist())]
        return Places([], [], S.focal_grid(df, axis, scheme.size), scheme.bandwidth, values)
    edges = S.quantile_edges(df, axis, scheme.size) if scheme.kind == "quantile" else S.max_equal_edges(df, axis, scheme.size)
    sizes = {r["b"]: r["n"] for r in df.where(F.col(axis).isNotNull()).groupBy(S.bin_of(F.col(axis), edges).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each bin
    n = np.array([sizes.get(b, 0) for b in range(len(edges) + 1)], float)
    return Places(edges, (np.cumsum(n) / max(n.sum(), 1))[:-1].tolist(), [], 0.0, [])


def _rows(df: DataFrame, key: str, axis: str, columns: Columns, seed: int) -> DataFrame:
    own = df.select(*(F.col(c).cast("double").alias(c) for c in columns.names), F.col(axis).cast("double").alias("_axis"), F.xxhash64(F.col(key), F.lit(seed)).alias("_hash"))
    return own.dropna(subset=[*columns.names, "_axis"])


def _coefficients(models: list[Mixture]) -> np.ndarray:
    """Of log(weight * density), by model and class: the constant, and the factors of each column and of
    each continuous column's square."""
    flat, factors = _factors(models)
    return np.concatenate([flat[:, None], factors], 1).reshape(len(models), -1, 1 + factors.shape[1])


def _parts(batches, columns: Columns):
    for b in batches:
        yield _matrix(b, columns), b.column("_axis").to_numpy(), b.column("_hash").to_numpy()


def _added(parts, places: Places, cells: list[tuple[int, int]], factors: np.ndarray, nc: int, width: int, statistics, memo: dict | None = None) -> dict[tuple[int, int], np.ndarray]:
    """For each (draw, place) the sum over parts (rows, axis, hashes) of width numbers of its rows:
    statistics(rows by one, columns and continuous columns' squares; weights; log(weight * density) of
    classes by rows). Rows go in blocks. memo: what keeps the blocks' rows by place, for parts that are
    the same in every call."""
    by_draw: dict[int, dict[int, int]] = {}
    for i, (draw, place) in enumerate(cells):
        by_draw.setdefault(draw, {})[place] = i
    total, seen = np.zeros((len(cells), width)), np.zeros(len(cells), bool)
    step = min(ROWS, max(1, BLOCK // max(width, factors.shape[2])))
    for n, (whole, axis, hashes) in enumerate(parts):
        for at in range(0, len(whole), step):
            part = slice(at, at + step)
            x = whole[part]
            z = np.concatenate([np.ones((len(x), 1)), x, x[:, :nc] ** 2], 1)
            for draw, numbers in by_draw.items():
                dealt = memo.get((n, at, draw)) if memo is not None else None
                if dealt is None:
                    dealt = places.cells(axis[part], hashes[part], draw)
                    if memo is not None:
                        memo[n, at, draw] = dealt
                for place, rows, w in dealt:
                    if (i := numbers.get(place)) is not None:
                        own = z.take(rows, 0)
                        total[i] += statistics(own, w, factors[i] @ own.T)
                        seen[i] = True
    return {cells[i]: total[i] for i in np.flatnonzero(seen)}


SUMS = "draw int, place int, v array<double>"


def _vectors(totals: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    cols = [pa.array([k[i] for k in totals], pa.int32()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(list(totals.values()), pa.list_(pa.float64()))], ["draw", "place", "v"])


def _by_cell(batches) -> dict[tuple[int, int], np.ndarray]:
    totals: dict = {}
    for b in batches:
        for draw, place, v in zip(b.column("draw").to_pylist(), b.column("place").to_pylist(), b.column("v"), strict=True):
            v = v.values.to_numpy(zero_copy_only=False)
            totals[draw, place] = totals[draw, place] + v if (draw, place) in totals else v
    return totals


def _summed(rows: DataFrame, columns: Columns, places: Places, models: dict[tuple[int, int], Mixture], width: int, statistics) -> dict[tuple[int, int], np.ndarray]:
    """_added of all rows, task by task; where the tasks' sums are many, a cell's meet on an executor first."""
    cells, nc = sorted(models), len(columns.continuous)
    factors = _coefficients([models[c] for c in cells])

    def sums(batches):
        if got := _added(_parts(batches, columns), places, cells, factors, nc, width, statistics):
            yield _vectors(got)

    def meet(batches):
        if got := _by_cell(batches):
            yield _vectors(got)

    parts = rows.mapInArrow(sums, SUMS)
    if len(models) * width * rows.sparkSession.sparkContext.defaultParallelism > GATHERED:
        parts = parts.repartition("draw", "place").mapInArrow(meet, SUMS)
    return _by_cell(parts.toArrow().to_batches())  # models by parameters


def refit(rows: DataFrame, columns: Columns, places: Places, pooled: Mixture, draws: list[int], most: int = MOST, tol: float = TOL, in_one_task: bool = False) -> dict[tuple[int, int], Mixture]:
    """The pooled mixture refitted, from its own parameters, to each place under each draw.

    Fits that have ended leave the passes. A fit whose likelihood is no number is left out: degenerate().
    in_one_task: the rows are few enough for all passes to be in one task, which holds them; else the
    passes that are left are, once few draws are open.
    """
    k, f, nc = len(pooled.weights), pooled.means.shape[1], len(columns.continuous)
    least = 1e-4 * np.maximum(pooled.variances.mean(0), TINY)
    start = Mixture(columns, pooled.weights, pooled.means, pooled.variances)
    width = k * (1 + f + nc) + 2
    each = 0 if in_one_task else rows.count() * k * len(columns.names)  # products of a draw

    def expected(x: np.ndarray, w: np.ndarray, joint: np.ndarray) -> np.ndarray:
        top = joint.max(0)
        r = np.exp(joint - top)
        total = r.sum(0)
        r *= w / total
        sums = r @ x
        return np.concatenate([sums[:, 0], sums[:, 1 : 1 + f].ravel(), sums[:, 1 + f :].ravel(), [(top + np.log(total)) @ w, w.sum()]])

    def climb(sums, runs: dict[tuple[int, int], _Run], best: dict[tuple[int, int], Mixture], most: int, enough=lambda open_: False) -> tuple[set[tuple[int, int]], int]:
        """Passes until all runs have ended, most are done or few enough are open; those, and passes left."""
        open_ = set(runs)
        while open_ and most and not enough(open_):
            most -= 1
            got = sums({c: runs[c].at for c in open_})
            open_ &= set(got)  # a place without rows has no fit
            for cell in sorted(open_):
                v = got[cell]
                n, s, ss = v[:k], v[k : k + k * f].reshape(k, f), v[k + k * f : -2].reshape(k, nc)
                safe = np.maximum(n, TINY)[:, None]
                means = s / safe
                image = Mixture(columns, n / max(n.sum(), TINY), means, np.maximum(ss / safe - means[:, :nc] ** 2, least), float(v[-2]))
                if degenerate(image):
                    open_.discard(cell)
                    continue
                if cell not in best or image.log_likelihood >= best[cell].log_likelihood:
                    best[cell] = image
                if runs[cell].step(image, tol * v[-1]):
                    best[cell] = runs[cell].at
                    open_.discard(cell)
        return open_, most

    runs = {(d, p): _Run(start, least) for d in draws for p in range(places.many)}
    best: dict[tuple[int, int], Mixture] = {}
    if not in_one_task:
        open_, most = climb(lambda models: _summed(rows, columns, places, models, width, expected), runs, best, most, lambda open_: each * len({d for d, _ in open_}) <= TASK * WORK)
        runs = {c: runs[c] for c in open_}
    if not (runs and most):
        return best
    likeliest = {c: best[c] for c in runs if c in best}

    def run(batches):
        parts = list(_parts(batches, columns))
        if parts:
            whole, memo, found = tuple(np.concatenate(p) for p in zip(*parts, strict=True)), {}, dict(likeliest)

            def sums(models):
                cells = sorted(models)
                return _added([whole], places, cells, _coefficients([models[c] for c in cells]), nc, width, expected, memo)

            climb(sums, runs, found, most)
            yield _vectors({c: np.concatenate([[m.log_likelihood, m.converged], m.weights, m.means.ravel(), m.variances.ravel()]) for c, m in found.items()})

    found = _by_cell(rows.coalesce(1).mapInArrow(run, SUMS).toArrow().to_batches())  # models by parameters
    return best | {c: Mixture(columns, v[2 : 2 + k], v[2 + k : 2 + k + k * f].reshape(k, f), v[2 + k + k * f :].reshape(k, nc), float(v[0]), converged=bool(v[1])) for c, v in found.items()}


def degenerate(m: Mixture) -> bool:
    """Whether a fit has gone astray: its likelihood or a parameter is no finite number."""
    return not (np.isfinite(m.log_likelihood) and np.isfinite(m.means).all() and np.isfinite(m.variances).all() and np.isfinite(m.weights).all())


def summaries(rows: DataFrame, columns: Columns, places: Places, pooled: Mixture, fits: dict[tuple[int, int], Mixture], spark: SparkSession) -> DataFrame:
    """A row for each fit (SUMMARY): weighted means and sds of the rows that its classes are likeliest
    for, and their weights by pooled class. Classes that no row is likeliest for are left out."""
    k, f = len(pooled.weights), pooled.means.shape[1]
    names = [*columns.continuous, *columns.binary, *(f"{c}={i}" for c, n in columns.categorical.items() for i in range(n))]

    def labelled(x: np.ndarray, w: np.ndarray, joint: np.ndarray) -> np.ndarray:
        own, x = np.eye(k)[joint.argmax(0)].T * w, x[:, 1 : 1 + f]
        return np.concatenate([own.sum(1), *((own @ y).ravel() for y in (x, x**2, np.eye(k)[pooled.log_joint(x).argmax(1)]))])

    out = []
    for (draw, place), v in _summed(rows, columns, places, fits, k * (1 + 2 * f + k), labelled).items():
        n, s, ss, overlap = v[:k], v[k : k + k * f].reshape(k, f), v[k + k * f : k + 2 * k * f].reshape(k, f), v[k + 2 * k * f :].reshape(k, k)
        there = np.flatnonzero(n > TINY)
        mean = s[there] / n[there, None]
        sd = np.sqrt(np.maximum(ss[there] / n[there, None] - mean**2, 0.0))
        out.append((draw, place, float(n.sum()), there.tolist(), names, mean.tolist(), sd.tolist(), overlap[there].tolist()))
    return spark.createDataFrame(out, SUMMARY)  # a row for each draw and place


def to_record(row) -> str:
    """A summary as one line of JSON, for a store of null fits; from_record is its inverse."""
    return json.dumps(row.asDict(recursive=True), sort_keys=True)


def from_record(line: str) -> tuple:
    held = json.loads(line)
    return tuple(held[c.split(" ")[0]] for c in SUMMARY.split(", "))


def aligned(found: DataFrame, reference: DataFrame) -> DataFrame:
    """draw, place, class (of the pooled fit), distance, jaccard and ari of each summary.

    reference has one row: centres (array by pooled class of arrays by feature), sizes (of the classes in
    the place are taken from overlap) and sds (by feature). Classes are paired so that the sum of their
    members' Jaccard indexes is greatest; distance is the root mean square over features of the
    difference of means, in sds.
    """
    held = reference.first()  # classes by features
    centres, sds = np.array(held["centres"], float), np.array(held["sds"], float)
    scale = np.where(sds > 0, sds, np.nan)

    def pairs(batches):
        for b in batches:
            rows = []
            for draw, place, means, overlap in zip(*(b.column(c).to_pylist() for c in ("draw", "place", "means", "overlap")), strict=True):
                o, m = np.array(overlap, float), np.array(means, float)
                both = o.sum(1)[:, None] + o.sum(0)[None] - o
                jaccard = np.where(both > 0, o / np.where(both > 0, both, 1.0), 0.0)
                comb = lambda x: (x * (x - 1) / 2).sum()
                a, c, n = comb(o.sum(1)), comb(o.sum(0)), comb(o.sum())
                expected, highest = a * c / n if n else 0.0, (a + c) / 2
                ari = 1.0 if highest == expected else (comb(o) - expected) / (highest - expected)
                for own, ref in enumerate(E.assign(-jaccard)):
                    if ref < len(centres):
                        z = (m[own] - centres[ref]) / scale
                        rows.append((draw, place, int(ref), float(np.sqrt(np.nanmean(z**2))), float(jaccard[own, ref]), float(ari)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["draw", "place", "class", "distance", "jaccard", "ari"])

    return found.mapInArrow(pairs, "draw int, place int, class int, distance double, jaccard double, ari double")


def sweep_refits(df: DataFrame, key: str, axis: str, columns: Columns, scheme: Scheme, pooled: Mixture, n_perm: int = 999, seed: int = 0, q: float = 0.05, most: int = MOST) -> DataFrame:
    """Per place and pooled class how far the class is from there when the place is fitted anew.

    value is the drift, null_p95 and p_value read it against as many draws whose places are dealt anew
    and refitted too; jaccard and ari tell how well the place's classes match the pooled ones;
    drift_vs_separation is the drift over the mean distance between pooled classes; reject is Benjamini and
    Hochberg's step-up over all tests; reorganised: a Jaccard index under a half. Rows that lack a column
    or the axis are left out. A class that no class of a place is paired with has no row there.
    """
    places = places_of(df, axis, scheme)
    rows = _rows(df, key, axis, columns, seed)
    rows = rows.cache()
    cached, slots = [rows], df.sparkSession.sparkContext.defaultParallelism
    try:
        whole = rows.select(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("parts")).first()
        work = whole["n"] * (n_perm + 1) * len(pooled.weights) * len(columns.names)
        if work // WORK < whole["parts"]:
            rows = rows.coalesce(work // WORK + 1)
        elif whole["parts"] < slots:
            rows = rows.repartition(slots).cache()
            cached.append(rows)
        fits = refit(rows, columns, places, pooled, list(range(n_perm + 1)), most, in_one_task=work <= TASK * WORK)
        found = summaries(rows, columns, places, pooled, fits, df.sparkSession)
        centres, sds = _reference(rows, columns, pooled)
        reference = df.sparkSession.createDataFrame([(centres.tolist(), sds.tolist())], "centres array<array<double>>, sds array<double>")
        table = aligned(found, reference)
        d = np.array([np.sqrt(np.mean(((a - b) / np.where(sds > 0, sds, np.inf)) ** 2)) for i, a in enumerate(centres) for b in centres[i + 1 :]])
        separation = float(d.mean()) if len(d) else float("nan")
        seen = table.where("draw = 0")
        read = D.read_against_null(seen.select("place", "class", F.col("distance").alias("value")), table.where("draw > 0").select("place", "class", F.col("distance").alias("draw")), ["place", "class"])
        out = read.join(seen.select("place", "class", "jaccard", "ari"), ["place", "class"])
        out = out.withColumns({"drift_vs_separation": F.col("value") / F.lit(separation), "reorganised": F.col("jaccard") < 0.5})
        return bh_reject(out, "p_value", q=q)
    finally:
        for c in cached:
            c.unpersist()


def _reference(rows: DataFrame, columns: Columns, pooled: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """Means of the rows that each pooled class is likeliest for, and all rows' sds."""
    whole = Places([], [], [], 0.0, [])  # one place that holds all

    k, f = len(pooled.weights), pooled.means.shape[1]

    def labelled(x: np.ndarray, w: np.ndarray, joint: np.ndarray) -> np.ndarray:
        own, x = np.eye(k)[joint.argmax(0)].T, x[:, 1 : 1 + f]
        return np.concatenate([own.sum(1), (own @ x).ravel(), x.sum(0), (x**2).sum(0), [len(x)]])

    v = _summed(rows, columns, whole, {(0, 0): pooled}, k + k * f + 2 * f + 1, labelled)[0, 0]
    n, s, t, tt, m = v[:k], v[k : k + k * f].reshape(k, f), v[k + k * f : k + k * f + f], v[k + k * f + f : -1], v[-1]
    centres = np.where(n[:, None] > TINY, s / np.maximum(n, TINY)[:, None], pooled.means)
    return centres, np.sqrt(np.maximum(tt / m - (t / m) ** 2, 0.0) * m / max(m - 1, 1))
