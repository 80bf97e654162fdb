"""Approximate nearest neighbours on robust-pruned directed graphs.

Vectors are dealt to shards by their norm, within a factor of 2, and a hash of their id; each shard
is a task of its own. It keeps a graph: for every vector, a
greedy search over the graph so far proposes neighbours, and pruning with a relaxed distance
keeps edges in diverse directions (Subramanya et al. 2019). A query walks every shard's graph with
a beam, and the shards' best are merged. Nearness is the inner product; in the graphs it is a
distance, by one more coordinate that gives all vectors of the shard the same norm: as their norms
are alike, no vector swamps the others' distances, and all are scaled to the shard's largest.

A shard's rows arrive before the queries, which then stream past in batches, so a task holds one
shard's graph and one batch of queries. Equal vectors are one node of a graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEGREE = 32
BUILD_BEAM = 64
ALPHA = 1.2
SEARCH_BEAM = 96
SHARD_ROWS = 20_000
LEAST_SHARDS = 12
WIDTH = 4


class Graph:
    """The graph over one shard's distinct vectors, with the ids of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: int, seed: int = 7):
        """most: how many of the smallest ids of equal vectors can be asked for."""
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(1)]) if len(ids) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        self.vectors = vectors[starts]
        self.members = [ids[s : min(e, s + most)] for s, e in zip(starts, [*starts[1:], len(ids)], strict=True)]
        scaled = self.vectors / np.abs(self.vectors).max(initial=1e-300)
        norms = (scaled**2).sum(1)
        extra = np.sqrt(np.maximum(0, norms.max(initial=0) - norms))
        self.x = np.concatenate([scaled, extra[:, None]], 1).astype(np.float32)
        self.norm = (self.x**2).sum(1)
        self.edges = np.full((len(self.x), DEGREE), -1, np.int32)
        if len(self.x):
            self._build(np.random.default_rng(seed))

    def _distance(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances less the query's norm; nodes: a row for each query, -1 is far away."""
        d = self.norm[nodes] - 2 * np.matmul(self.x[nodes], queries[:, :, None])[:, :, 0]
        return np.where(nodes >= 0, d, np.inf)

    def walk(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam searches of all queries in step: nodes (-1: none) and distances, nearest first."""
        m, n = len(queries), len(self.x)
        ids = np.full((m, beam), -1, np.int32)
        dist = np.full((m, beam), np.inf, np.float32)
        done = np.ones((m, beam), bool)
        seen = np.zeros((m, n), bool)
        ids[:, 0], done[:, 0], seen[:, self.start] = self.start, False, True
        dist[:, :1] = self._distance(queries, ids[:, :1])
        rows = np.arange(m)
        while len(rows):
            todo = ~done[rows]
            rank = np.cumsum(todo, 1)
            take = todo & (rank <= WIDTH)
            done[rows] |= take
            at = np.argsort(~take, 1, kind="stable")[:, :WIDTH]
            nodes = np.where(np.take_along_axis(take, at, 1), np.take_along_axis(ids[rows], at, 1), -1)
            near = np.where(nodes[:, :, None] >= 0, self.edges[nodes], -1).reshape(len(rows), -1)
            near.sort(1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[(near >= 0) & seen[rows[:, None], near]] = -1
            r, c = np.nonzero(near >= 0)
            seen[rows[r], near[r, c]] = True
            d = np.concatenate([dist[rows], self._distance(queries[rows], near)], 1)
            best = np.argsort(d, 1, kind="stable")[:, :beam]
            dist[rows] = np.take_along_axis(d, best, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], 1), best, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], near < 0], 1), best, 1)
            rows = rows[~done[rows].all(1)]
        return ids, dist

    def _prune(self, points: np.ndarray, near: np.ndarray) -> np.ndarray:
        """DEGREE neighbours at most of each point out of near (-1: none), by relaxed distance."""
        x = self.x[points]
        near = np.where(near == points[:, None], -1, near)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        d = self._distance(x, near) + self.norm[points][:, None]
        order = np.argsort(d, 1, kind="stable")
        near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
        y = self.x[near]
        between = self.norm[near][:, :, None] + self.norm[near][:, None, :] - 2 * np.matmul(y, y.transpose(0, 2, 1))
        alive, kept = near >= 0, np.zeros(len(points), np.int64)
        out = np.full((len(points), DEGREE), -1, np.int32)
        for j in range(near.shape[1]):
            good = np.flatnonzero(alive[:, j] & (kept < DEGREE))
            if not len(good):
                continue
            out[good, kept[good]] = near[good, j]
            kept[good] += 1
            alive[good] &= ALPHA * ALPHA * between[good, j] > d[good]
        return out

    def _build(self, rng: np.random.Generator) -> None:
        n = len(self.x)
        self.start = int(((self.x - self.x.mean(0)) ** 2).sum(1).argmin())
        if n <= DEGREE + 1:
            self.edges[:, : n - 1] = [[j for j in range(n) if j != i] for i in range(n)]
            return
        self.edges = rng.integers(0, n, (n, DEGREE), dtype=np.int32)
        order = rng.permutation(n)
        step = max(64, min(512, (64 << 20) // n))
        for lo in range(0, n, step):
            points = order[lo : lo + step]
            found, _ = self.walk(self.x[points], BUILD_BEAM)
            self.edges[points] = self._prune(points, np.concatenate([found, self.edges[points]], 1))
            source = np.repeat(points, DEGREE)
            target = self.edges[points].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.lexsort((((self.x[source] - self.x[target]) ** 2).sum(1), target))
            source, target = source[by], target[by]
            first = np.concatenate([[True], target[1:] != target[:-1]])
            place = np.arange(len(target)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            who, row = target[first], np.cumsum(first) - 1
            back = np.full((len(who), 2 * DEGREE), -1, np.int32)
            good = place < 2 * DEGREE  # of a hub's proposals, the nearest
            back[row[good], place[good]] = source[good]
            self.edges[who] = self._prune(who, np.concatenate([self.edges[who], back], 1))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, beam: int) -> list[tuple[int, int, float]]:
        """(place of the query, id, inner product): k nearest of each query, but its own id. Ties: smaller ids."""
        out: list[tuple[int, int, float]] = []
        if not len(self.x):
            return out
        step = max(16, min(1024, (64 << 20) // len(self.x)))
        for lo in range(0, len(own), step):
            q = queries[lo : lo + step]
            scaled = q / np.abs(q).max(1, keepdims=True)
            nodes, _ = self.walk(np.concatenate([scaled, np.zeros((len(q), 1))], 1).astype(np.float32), max(beam, k + 1))
            exact = (self.vectors[nodes] * q[:, None, :]).sum(2)
            for at, (o, near, score) in enumerate(zip(own[lo : lo + step].tolist(), nodes, exact, strict=True), lo):
                good = near >= 0
                near, score, got = near[good], score[good], []
                for i in np.argsort(-score, kind="stable").tolist():
                    if len(got) >= k and score[i] < got[k - 1][1]:
                        break
                    got += [(v, score[i]) for v in self.members[near[i]].tolist() if v != o]
                got.sort(key=lambda x: (-x[1], x[0]))
                out += [(at, v, s) for v, s in got[:k]]
        return out


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part: not null, zero or non-finite."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0))


def _octave() -> Column:
    """The power of 2 nearest to a vector's norm. Where squares overflow or vanish, they are taken of
    the components over the greatest."""
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    most = F.array(F.array_max(F.transform("embedding", F.abs)))
    scaled = F.transform(most, lambda m: F.log2(m) + 0.5 * F.log2(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x / m) * (x / m))))
    usual = F.transform(F.array(square), lambda s: F.when(s.between(1e-200, 1e200), 0.5 * F.log2(s)).otherwise(scaled[0]))
    return F.floor(usual[0] + 0.5)


def shards_of(data: DataFrame, shard_rows: int) -> DataFrame:
    """width, octave, first, many: the shards of the vectors of a length and a norm, numbered through by
    width. A row per length and power of 2 (2,098 for doubles at most)."""
    groups = [(r["width"], r["octave"], r["n"]) for r in data.groupBy(F.size("embedding").alias("width"), _octave().alias("octave")).agg(F.count(F.lit(1)).alias("n")).orderBy("width", "octave").collect()]
    whole, first, rows = sum(n for *_, n in groups), 0, []
    for width, octave, n in groups:
        many = max(-(-n // shard_rows), -(-LEAST_SHARDS * n // whole))
        rows.append(f"({width}, {octave}L, {first}, {many})")
        first += many
    return data.sparkSession.sql("select * from values " + (", ".join(rows) or "(0, 0L, 0, 0)") + " as t(width, octave, first, many)")


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k of embeddings found nearest to each of queries.

    Both have vec_id and embedding; a query's own id is no candidate. Vectors of another length
    than a query's take no part in its search; nulls, zero vectors and those with non-finite components
    in none. Ties go to the smaller vec_id; rows that repeat an id are candidates each. Queries that repeat
    an id and its vector are one; those with one id and several vectors have k rows for each. Empty tables
    give no rows; other columns are left out; long vectors are compared whole. Each query goes to
    every shard of its length, so the work grows with queries times rows over shard_rows.
    """
    data = usable(embeddings)
    groups = shards_of(data, shard_rows).cache()
    shards = max(1, groups.agg(F.max(F.col("first") + F.col("many"))).first()[0])
    ranges = groups.groupBy("width").agg(F.min("first").alias("lo"), F.max(F.col("first") + F.col("many")).alias("hi"))
    own = data.withColumn("width", F.size("embedding")).withColumn("octave", _octave()).join(F.broadcast(groups), ["width", "octave"])
    rows = own.select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("many"))).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "embedding", F.lit(0).cast("long").alias("mark"))
    once = usable(queries).dropDuplicates(["vec_id", "embedding"]).withColumn("mark", F.xxhash64("embedding"))
    sent = once.withColumn("width", F.size("embedding")).join(F.broadcast(ranges), "width").where("lo < hi")
    asked = sent.select(F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int") - 1)).alias("shard"), F.lit(1).alias("kind"), "vec_id", "embedding", "mark")

    def search(batches):
        shard, ids, vectors, graph = None, [], [], None
        for b in batches:
            key, kind, vec, mark = (b.column(c).to_numpy() for c in ("shard", "kind", "vec_id", "mark"))
            flat, width = b.column("embedding").flatten().to_numpy(), np.diff(b.column("embedding").offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(width)])
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if s == e:
                    continue
                part = flat[starts[s] : starts[e]].reshape(e - s, width[s])
                if key[s] != shard:
                    shard, ids, vectors, graph = key[s], [], [], None
                if not kind[s]:
                    ids.append(vec[s:e])
                    vectors.append(part)
                elif ids:
                    graph = graph or Graph(np.concatenate(ids), np.concatenate(vectors), k + 1)
                    got = graph.search(vec[s:e], part, k, beam)
                    q, v, score = zip(*got, strict=True) if got else ((), (), ())
                    q = np.array(q, np.int64) + s
                    yield pa.RecordBatch.from_arrays([pa.array(vec[q]), pa.array(mark[q]), pa.array(v, pa.int64()), pa.array(score, pa.float64())], ["query_id", "mark", "vec_id", "score"])

    found = rows.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "vec_id").mapInArrow(search, "query_id long, mark long, vec_id long, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
