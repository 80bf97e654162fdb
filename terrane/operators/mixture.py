"""Mixture models with Gaussian, Bernoulli and multinomial emissions, fitted by distributed EM.

A pass over the rows serves all restarts at once: each task adds up its rows' sufficient statistics
with numpy, Spark sums them, and the driver, which sees only classes by features, updates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-9
# Passes at most and least gain in log-likelihood per row of a pass, as in the survey.
MOST, TOL = 500, 1e-6


@dataclass
class Columns:
    """continuous and binary columns; categorical ones with their number of levels (codes from 0)."""

    continuous: list[str]
    binary: list[str] = field(default_factory=list)
    categorical: dict[str, int] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.continuous, *self.binary, *self.categorical]

    @property
    def others(self) -> int:
        """How many columns come after the continuous ones when rows are expanded."""
        return len(self.binary) + sum(self.categorical.values())

    def expanded(self, x: np.ndarray) -> np.ndarray:
        """Rows with categorical columns as indicators of their levels."""
        parts = [x[:, : len(self.continuous) + len(self.binary)]]
        for i, n in enumerate(self.categorical.values(), len(self.continuous) + len(self.binary)):
            parts.append((x[:, i : i + 1] == np.arange(n)).astype(float))
        return np.concatenate(parts, 1)


@dataclass
class Mixture:
    columns: Columns
    weights: np.ndarray  # K
    means: np.ndarray  # K x all columns: means, or probabilities of flags and levels
    variances: np.ndarray  # K x continuous
    log_likelihood: float = -np.inf
    hold: int = -1  # a fold of rows that the fit leaves out
    only: int = -1  # the fold of rows that the fit sees, where not all
    converged: bool = False

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) of each row and class."""
        return _joint([self])(x)

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responsibilities and the log-likelihood of each row."""
        j = self.log_joint(x)
        top = j.max(1, keepdims=True)
        e = np.exp(j - top)
        s = e.sum(1, keepdims=True)
        return e / s, (top + np.log(s))[:, 0]

    def free_parameters(self) -> int:
        k, nb = len(self.weights), len(self.columns.binary)
        return k - 1 + k * (2 * len(self.columns.continuous) + nb + sum(n - 1 for n in self.columns.categorical.values()))


def _matrix(batch, columns: Columns) -> np.ndarray:
    return columns.expanded(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns.names], 1))


# Most numbers in a block of rows by all classes of all models, while a task adds up, and most that the
# driver takes from all tasks together; beyond that the tasks' sums are added on the executors.
BLOCK, GATHERED = 2_000_000, 2_000_000
# The same of EM's blocks, which stay in a processor's cache; bytes of rows that are kept as one.
STEP, PACKED = 400_000, 1_000_000
# Products of a pass that are worth a task of their own; so many of these, all passes are in one task.
WORK, TASK = 4_000_000, 4


def _factors(models: list[Mixture]) -> tuple[np.ndarray, np.ndarray]:
    """Of log(weight * density), by class of all models: the constant, and the factors of a row's columns
    and of its continuous columns' squares."""
    m = models[0].columns
    nc, nb = len(m.continuous), len(m.binary)
    means, v = np.concatenate([m.means for m in models]), np.concatenate([m.variances for m in models])
    p = np.clip(means[:, nc:], TINY, 1 - TINY)
    flat = np.log(np.concatenate([m.weights for m in models]) + 1e-300) - 0.5 * (np.log(2 * np.pi * v) + means[:, :nc] ** 2 / v).sum(1) + np.log(1 - p[:, :nb]).sum(1)
    return flat, np.concatenate([means[:, :nc] / v, np.log(p[:, :nb]) - np.log(1 - p[:, :nb]), np.log(p[:, nb:]), -0.5 / v], 1)


def _joint(models: list[Mixture]):
    """A function of rows that gives log(weight * density) of each row and each class of each model."""
    flat, factors = _factors(models)
    f = models[0].means.shape[1]
    return lambda x: flat + x @ factors[:, :f].T + x[:, : factors.shape[1] - f] ** 2 @ factors[:, f:].T


def _totals(models: list[Mixture], parts) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float] | None]:
    """For each model the summed responsibilities, r * x, r * x^2 and the log-likelihood over parts:
    rows, their weights and folds. None for a model that sees no row.

    Models with as many classes that see the same rows go together, all their first classes before all
    their second ones: what is done over a model's classes runs along neighbouring numbers.
    """
    nc, only = len(models[0].columns.continuous), [m.only for m in models]
    groups = {}  # the models' places, classes, folds left out and factors, and what is added up
    for value, k in sorted({(m.only, len(m.weights)) for m in models}):
        own = [i for i, m in enumerate(models) if (m.only, len(m.weights)) == (value, k)]
        flat, factors = (np.concatenate([v[c::k] for c in range(k)]) for v in _factors([models[i] for i in own]))
        groups[value, k] = [own, np.array([models[i].hold for i in own]), flat, factors.T, None]
    for whole, weights, folds_ in parts:
        there = {-1, *np.unique(folds_).tolist()} if only != [-1] * len(only) else {-1}
        for (value, k), (own, holds, flat, factors, _) in groups.items():
            if value not in there:
                continue
            seen = slice(None) if value < 0 else folds_ == value
            rows, w_, f_, step = whole[seen], weights[seen], folds_[seen], max(1, STEP // len(flat))
            for first in range(0, len(rows), step):
                part = slice(first, first + step)
                x = np.concatenate([rows[part], rows[part, :nc] ** 2], 1)
                r = x @ factors
                r += flat
                by_class = r.reshape(len(x), k, len(own))
                top = by_class.max(1)
                by_class -= top[:, None]
                np.exp(r, out=r)
                total = by_class.sum(1)
                w = w_[part, None] * (f_[part, None] != holds)
                by_class *= (w / total)[:, None]
                new = [r.sum(0), r.T @ x, ((top + np.log(total)) * w).sum(0)]
                held = groups[value, k]
                held[-1] = new if held[-1] is None else [o + v for o, v in zip(held[-1], new, strict=True)]
    out: list = [None] * len(models)
    for (_, k), (own, _, _, factors, sums) in groups.items():
        if sums is not None:
            n, both = sums[0].reshape(k, len(own)), sums[1].reshape(k, len(own), len(factors))
            for j, i in enumerate(own):
                out[i] = n[:, j], both[:, j, :-nc or None], both[:, j, len(factors) - nc :], float(sums[2][j])
    return out


def _parts(batches, columns: Columns):
    for b in batches:
        yield _matrix(b, columns), b.column("_w").to_numpy(zero_copy_only=False).astype(float), b.column("_fold").to_numpy()


def _packed(rows: DataFrame, columns: Columns) -> DataFrame:
    """Rows in blocks of about PACKED bytes, for passes that read them often: x (continuous columns as
    doubles), y (the others, in a byte each where those hold them all), w and fold."""
    nc = len(columns.continuous)

    def pack(batches):
        for whole, w, fold in _parts(batches, columns):
            step = max(1, PACKED // (8 * whole.shape[1]))
            for first in range(0, len(whole), step):
                part = slice(first, first + step)
                y = whole[part, nc:]
                with np.errstate(invalid="ignore"):
                    small = y.astype(np.uint8)
                own = [whole[part, :nc], small if np.array_equal(small, y) else y, w[part], fold[part].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in own], ["x", "y", "w", "fold"])

    return rows.mapInArrow(pack, "x binary, y binary, w binary, fold binary")


def _unpacked(batches, columns: Columns):
    for b in batches:
        for x, y, w, fold in zip(*(b.column(c) for c in ("x", "y", "w", "fold")), strict=True):
            w = np.frombuffer(w.as_buffer())
            y = np.frombuffer(y.as_buffer(), np.uint8)
            y = (y.view(float) if len(y) == 8 * len(w) * columns.others else y).reshape(len(w), columns.others)
            yield np.concatenate([np.frombuffer(x.as_buffer()).reshape(len(w), -1), y], 1), w, np.frombuffer(fold.as_buffer(), np.int64)


def _vectors(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([totals[i] for i in totals], pa.list_(pa.float64()))], ["model", "v"])


def _pass(blocks: DataFrame, models: list[Mixture], tasks: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """_totals of all rows, which are _packed. A task yields one row per model. Where the rows of all `tasks` are many, those
    of a model first meet in one task, which adds them one by one."""
    columns, nc = models[0].columns, len(models[0].columns.continuous)
    sizes = [len(m.weights) for m in models]
    schema = "model int, v array<double>"

    def sums(batches):
        got = {i: np.concatenate([*(v.ravel() for v in t[:3]), [t[3]]]) for i, t in enumerate(_totals(models, _unpacked(batches, columns))) if t is not None}
        if got:
            yield _vectors(got)

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column("model").to_pylist(), b.column("v"), strict=True):
                v = v.values.to_numpy(zero_copy_only=False)
                totals[i] = totals[i] + v if i in totals else v
        if totals:
            yield _vectors(totals)

    rows = blocks.mapInArrow(sums, schema)
    if tasks * sum(sizes) * (1 + models[0].means.shape[1] + nc) > GATHERED:
        rows = rows.repartition("model").mapInArrow(add, schema)
    out: list = [None] * len(models)
    totals = next(add(rows.toArrow().to_batches()))  # models x classes x columns
    for i, v in zip(totals.column("model").to_pylist(), totals.column("v"), strict=True):
        v, k = v.values.to_numpy(zero_copy_only=False), sizes[i]
        f = models[i].means.shape[1]
        out[i] = v[:k], v[k : k + k * f].reshape(k, f), v[k + k * f : -1].reshape(k, nc), float(v[-1])
    return out


def _climb(models: list[Mixture], least: np.ndarray, limit: float, most: int, totals) -> list[Mixture]:
    """EM runs from models, until each has ended; totals gives models' sums over the rows."""
    models, nc = list(models), len(models[0].columns.continuous)
    runs = [_Run(m, least) for m in models]
    open_ = list(range(len(models)))
    for _ in range(most):
        for i, (n, s, ss, ll) in zip(list(open_), totals([runs[i].at for i in open_]), strict=True):
            safe = np.maximum(n, TINY)[:, None]
            means = s / safe
            image = Mixture(models[i].columns, n / max(n.sum(), TINY), means, np.maximum(ss / safe - means[:, :nc] ** 2, least), ll, models[i].hold, models[i].only)
            if not np.isfinite(models[i].log_likelihood) or ll >= models[i].log_likelihood:
                models[i] = image  # the likeliest so far
            if runs[i].step(image, limit):
                models[i] = runs[i].at
                open_.remove(i)
        if not open_:
            break
    return models


def _in_one_task(rows: DataFrame, models: list[Mixture], least: np.ndarray, limit: float, most: int) -> list[Mixture]:
    """_climb in a task of its own, over rows that it holds: few enough for a pass to take less time
    than a job does."""
    columns, f, nc = models[0].columns, models[0].means.shape[1], len(models[0].columns.continuous)

    def run(batches):
        parts = list(_parts(batches, columns))
        if parts:
            whole = tuple(np.concatenate(p) for p in zip(*parts, strict=True))
            got = _climb(models, least, limit, most, lambda now: _totals(now, [whole]))
            yield _vectors({i: np.concatenate([[m.log_likelihood, m.converged], m.weights, m.means.ravel(), m.variances.ravel()]) for i, m in enumerate(got)})

    got = rows.coalesce(1).mapInArrow(run, "model int, v array<double>").toArrow()  # models x classes x columns
    out = list(models)
    for i, v in zip(got.column("model").to_pylist(), got.column("v"), strict=True):
        v, m = v.values.to_numpy(zero_copy_only=False), models[i]
        k = len(m.weights)
        out[i] = Mixture(columns, v[2 : 2 + k], v[2 + k : 2 + k + k * f].reshape(k, f), v[2 + k + k * f :].reshape(k, nc), float(v[0]), m.hold, m.only, bool(v[1]))
    return out


FOLDS = 3


def folds(key: str, seed: int) -> Column:
    """Which fold a row is in, by a hash of its key."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(FOLDS)).cast("int")


def _vector(m: Mixture) -> np.ndarray:
    """A model's parameters on scales without bounds."""
    nc = len(m.columns.continuous)
    p = np.clip(m.means[:, nc:], TINY, 1 - TINY)
    return np.concatenate([np.log(m.weights + TINY), m.means[:, :nc].ravel(), np.log(p / (1 - p)).ravel(), np.log(m.variances).ravel()])


def _from_vector(m: Mixture, v: np.ndarray, least: np.ndarray) -> Mixture:
    """A model like m with the parameters in v; weights and levels are made to add up to one."""
    k, nc, nb = len(m.weights), len(m.columns.continuous), len(m.columns.binary)
    f = m.means.shape[1]
    weights = np.exp(v[:k] - v[:k].max())
    p = 1 / (1 + np.exp(-np.clip(v[k + k * nc : k + k * f].reshape(k, f - nc), -40, 40)))
    at = nb
    for n in m.columns.categorical.values():
        p[:, at : at + n] /= p[:, at : at + n].sum(1, keepdims=True)
        at += n
    means = np.concatenate([v[k : k + k * nc].reshape(k, nc), p], 1)
    return Mixture(m.columns, weights / weights.sum(), means, np.maximum(np.exp(np.clip(v[k + k * f :], -700, 700)).reshape(k, nc), least), hold=m.hold, only=m.only)


class _Run:
    """One EM run, in squared steps: two passes tell a direction, a jump along it is kept if the
    log-likelihood there is no less than before, and else taken back."""

    def __init__(self, start: Mixture, least: np.ndarray):
        self.at, self.least, self.from_, self.back = start, least, None, None

    def step(self, image: Mixture, limit: float) -> bool:
        """Takes the image of self.at under a pass; whether the run has ended."""
        if self.back is not None:  # self.at is a jump
            kept, self.back = (self.back, None)
            if not image.log_likelihood >= kept.log_likelihood:
                self.at, self.from_ = kept, None
                return False
            self.from_ = None
        before, here = self.from_, self.at
        if before is not None and abs(image.log_likelihood - here.log_likelihood) <= limit:
            self.at, self.at.converged = image, True
            return True
        if before is None:
            self.from_, self.at = here, image
            return False
        v0, v1, v2 = _vector(before), _vector(here), _vector(image)
        r, bend = v1 - v0, v2 - 2 * v1 + v0
        length = np.linalg.norm(r) / max(np.linalg.norm(bend), 1e-300)
        self.from_ = None
        if length > 1 and np.isfinite(length):
            self.back = image
            self.at = _from_vector(image, v0 + 2 * length * r + length**2 * bend, self.least)
        else:
            self.at = image
        return False


def fit_many(df: DataFrame, key: str, columns: Columns, specs: list[tuple[int, int, int]], seed: int = 0, weight: str | None = None, most: int = MOST, tol: float = TOL, starts: dict[int, Mixture] | None = None, by: str | None = None) -> list[Mixture]:
    """An EM run for each (classes, fold left out or -1, start), all in the same passes over the rows.

    Starts are drawn from the rows with the least hashes of their key, so a fit is the same on every
    run; `starts` gives models to start from instead, by the spec's start. With `by`, a column of
    whole numbers from 0, the second of a spec is the value whose rows alone the run sees. A run ends when a pass of
    EM adds tol or less to the log-likelihood of a row (converged), or after most passes, those of
    its jumps among them. Incomplete rows are left out.
    """
    rows = df.select(key, *([] if by is None else [F.col(by).cast("int").alias(by)]), *(F.col(c).cast("double").alias(c) for c in columns.names), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w")).dropna()
    rows = rows.withColumn("_fold", folds(key, seed)).cache() if by is None else rows.withColumnRenamed(by, "_fold").cache()
    whole = rows.withColumn("_part", F.spark_partition_id()).agg(*(F.var_pop(c).alias(c) for c in columns.continuous), F.sum("_w").alias("_n"), F.count(F.lit(1)).alias("_rows"), F.count_distinct("_part").alias("_parts")).first()
    cached, slots = [rows], df.sparkSession.sparkContext.defaultParallelism
    try:
        if not whole["_n"]:
            raise ValueError("no complete row to fit")
        tasks = whole["_parts"]
        needed = int(whole["_rows"] * len(columns.names) * sum(k for k, _, _ in specs) / WORK) + 1
        var = np.maximum(np.array([whole[c] for c in columns.continuous], float), TINY)
        nc, least = len(columns.continuous), 1e-4 * var
        limit = tol * whole["_n"] / (1 if by is None else len({value for _, value, _ in specs}))
        wanted = {i for _, _, i in specs} - set(starts or {})
        models = []
        if wanted:
            largest = max(k for k, _, i in specs if i in wanted)
            pool = rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(largest * len(wanted)).toArrow()
            x = _matrix(pool.combine_chunks().to_batches()[0], columns)
            x[:, nc:] = 0.25 + 0.5 * x[:, nc:]
            drawn = {i: x[np.random.default_rng([seed, i]).choice(len(x), largest, replace=len(x) < largest)] for i in wanted}
        for k, value, i in specs:
            hold, only = (value, -1) if by is None else (-1, value)
            if starts and i in starts:
                m = starts[i]
                models.append(Mixture(columns, m.weights, m.means, m.variances, hold=hold, only=only))
            else:
                models.append(Mixture(columns, np.full(k, 1 / k), drawn[i][:k], np.tile(var, (k, 1)), hold=hold, only=only))
        if needed <= TASK:
            return _in_one_task(rows, models, least, limit, most)
        needed = min(needed, max(slots, whole["_rows"] * len(columns.names) * 8 // PACKED + 1))  # a task has a block at least
        if needed < tasks:
            rows, tasks = rows.coalesce(needed), needed
        elif tasks < min(slots, needed):
            rows, tasks = rows.repartition(slots), slots
        cached.append(_packed(rows, columns).cache())
        cached[1].count()
        cached[0].unpersist()
        return _climb(models, least, limit, most, lambda now: _pass(cached[1], now, tasks))
    finally:
        for c in cached:
            c.unpersist()


def fit(df: DataFrame, key: str, columns: Columns, k: int, n_init: int = 4, seed: int = 0, weight: str | None = None, most: int = MOST, tol: float = TOL) -> Mixture:
    """The best of n_init EM runs with k classes."""
    return max(fit_many(df, key, columns, [(k, -1, i) for i in range(n_init)], seed, weight, most, tol), key=lambda m: m.log_likelihood)


def assign(df: DataFrame, key: str, model: Mixture) -> DataFrame:
    """key, label (the class with the greatest responsibility, the first of equals), responsibilities
    and the row's log-likelihood. Incomplete rows are left out."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            r, ll = model.posterior(_matrix(b, model.columns))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(r.argmax(1), pa.int32()), pa.array(list(r)), pa.array(ll)], [key, "label", "responsibilities", "log_likelihood"])

    rows = df.select(key, *(F.col(c).cast("double").alias(c) for c in model.columns.names)).dropna()
    return rows.mapInArrow(run, f"{key} {kind}, label int, responsibilities array<double>, log_likelihood double")


def criteria(assigned: DataFrame, model: Mixture) -> DataFrame:
    """Information criteria of a fit: one row."""
    p = F.lit(float(model.free_parameters()))
    k = len(model.weights)
    ent = F.aggregate("responsibilities", F.lit(0.0), lambda a, r: a - F.when(r > 0, r * F.log(r)).otherwise(0.0))
    sums = assigned.agg(F.sum("log_likelihood").alias("ll"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(ent).alias("entropy"), F.avg(F.array_max("responsibilities")).alias("mean_max_posterior"))
    ll, n = F.col("ll"), F.col("n")
    return sums.select(
        F.lit(k).alias("n_components"), F.lit(model.converged).alias("converged"), (ll / n).alias("avg_log_likelihood"), (-2 * ll + 2 * p).alias("aic"), (-2 * ll + p * F.log(n)).alias("bic"), (-2 * ll + p * F.log((n + 2) / 24)).alias("sabic"), (-2 * ll + p * (F.log(n) + 1)).alias("caic"), (-2 * ll + p * (F.log(n) + 1.5)).alias("awe"),
        (F.lit(1.0) if k == 1 else 1 - F.col("entropy") / (n * F.log(F.lit(float(k))))).alias("relative_entropy"), "mean_max_posterior",
    )


def select(df: DataFrame, key: str, columns: Columns, ks: list[int], n_init: int = 3, seed: int = 0, most: int = MOST) -> DataFrame:
    """criteria of the best fit with each number of classes, and the log-likelihood held out: each
    fold is scored by a model fitted on the others. All fits share their passes."""
    specs = [(k, hold, i) for k in ks for hold, i in [*((-1, i) for i in range(n_init)), *((f, 0) for f in range(FOLDS))]]
    models = dict(zip(specs, fit_many(df, key, columns, specs, seed, most=most), strict=True))
    out = None
    for k in ks:
        m = max((models[k, -1, i] for i in range(n_init)), key=lambda m: m.log_likelihood)
        held = None
        for f in range(FOLDS):
            part = assign(df.where(folds(key, seed) == f), key, models[k, f, 0]).select("log_likelihood")
            held = part if held is None else held.unionByName(part)
        row = criteria(assign(df, key, m), m).crossJoin(held.agg(F.avg("log_likelihood").alias("val_log_likelihood"), F.lit(all(models[k, f, 0].converged for f in range(FOLDS))).alias("val_converged")))  # one row each
        out = row if out is None else out.unionByName(row)
    return out
