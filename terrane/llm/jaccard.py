"""Exact n-gram Jaccard join with set-relation skipping (after Wang et al., VLDB 2017).

1. Shingles become 64-bit hashes; equal sets of a chunk of documents are one. Each chunk sends its
   distinct shingles to the buckets of their hashes, where they are counted over all documents,
   and gets back those that occur elsewhere too.
2. In the order of these counts, rarest first, two linked sets share one of their first
   n - ceil(0.8 n) + 1 shingles. Where so many are found in no other set, a set has no link. The
   others are indexed by those first shingles: lists of sets, by size class.
3. Each set is compared with the hub of its lists, a set highly similar to it as a rule. That gives
   families and, by their links, first components.
4. Lists that still hold several components are searched block by block: a block is a family's
   part of a list, with the extremes of its positions and sizes, and a pair of blocks is skipped if
   these can't reach the threshold. Members' answers are derived from the computed answers of their
   hubs, up to the few shingles in which they differ from these; only undecided pairs are counted.

Shingles are kept to 32 bits and those of their bucket (42 at least) from step 1 on.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import binary_column, byte_chunks, cut, doc_texts, freeing, mix64, partitions, small_batches
from terrane.llm.components import components

WORDS = 5
CHUNK = 1 << 20
U64 = np.uint64
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_POWERS: dict[str, np.ndarray] = {}
_CODE = mix64(np.arange(1, 257, dtype=U64))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            x = np.full(n, base, U64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


def shingles(data: np.ndarray, edges: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of texts (bytes and offsets), sorted in each text, and the
    text of each. A text with fewer words has its whole sequence as one; without words, none."""
    none = np.zeros(0, U64), np.zeros(0, np.int64)
    if not len(data):
        return none
    blank = _BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[edges] = True
    inside = ~blank
    begin = inside & (first[:-1] | np.concatenate([[True], blank[:-1]]))
    end = inside & (first[1:] | np.concatenate([blank[1:], [True]]))
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(s):
        return none
    up, down = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(_CODE[_LOWER[data]] * up[: len(data)], dtype=U64)])
    word = mix64((total[e] - total[s]) * down[s] + (e - s).astype(U64))
    text = np.searchsorted(edges, s, "right") - 1
    count = np.bincount(text, minlength=len(edges) - 1)
    place = np.arange(len(s)) - (np.cumsum(count) - count)[text]
    many = np.minimum(count, words)[text]
    at = np.flatnonzero((place + words <= count[text]) | (place == 0))
    h = np.zeros(len(at), U64)
    for k in range(words):
        good = k < many[at]
        h[good] = h[good] * U64(_Q) + word[at[good] + k]
    h = mix64(h + many[at].astype(U64))
    text = text[at]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
    return h[new], text[new]


ROW = "bucket long, kind int, chunk long, ids binary, tokens binary, who binary, sizes binary, keys binary"
COLUMNS = [x.split()[0] for x in ROW.split(", ")]
TOKENS, SETS, HOT = range(3)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], COLUMNS)


def _send(bits: int):
    """Chunks of documents to rows for the buckets, and what each chunk keeps of its sets."""

    def run(batches):
        serial = itertools.count()
        for b in batches:
            for c in byte_chunks(b, "text", CHUNK):
                ids = c.column("doc_id").to_numpy()
                for lo in range(0, len(ids), 60_000):
                    yield from chunk(c.slice(lo, 60_000), ids[lo : lo + 60_000], serial)
        _POWERS.clear()

    def chunk(c, ids, serial):
        h, text = shingles(*binary_column(c.column("text")))
        size = np.bincount(text, minlength=len(ids))
        one, two = np.zeros(len(ids), U64), np.zeros(len(ids), U64)
        has = size > 0
        if len(h):
            starts = (np.cumsum(size) - size)[has]
            one[has] = np.add.reduceat(mix64(h ^ U64(0x5851F42D4C957F2D)), starts)
            two[has] = np.add.reduceat(mix64(h + U64(0x14057B7EF767814F)), starts)
        keys = np.stack([one, two, size.astype(U64)], 1)
        _, first, own = np.unique(keys, axis=0, return_index=True, return_inverse=True)
        own = own.ravel()
        name = int(mix64(np.array([TaskContext.get().partitionId() << 32 | next(serial)], U64)).view(np.int64)[0])  # the same if the task runs again
        kept = np.zeros(len(ids), bool)
        kept[first] = True
        h, who = h[kept[text]], own[text[kept[text]]].astype(np.uint16)
        token = h >> U64(32 - bits)  # bits of the bucket, then 32 more
        order = np.lexsort((who, token))
        token, who = token[order], who[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (who[1:] != who[:-1])]) if len(token) else np.zeros(0, bool)
        token, who = token[new], who[new]
        rows = [(name & ((1 << bits) - 1), SETS, name, ids.astype(np.int64).tobytes(), b"", own.astype(np.uint16).tobytes(), size[first].astype(np.uint32).tobytes(), np.ascontiguousarray(keys[first, :2]).tobytes())]
        if len(token):
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            many = np.diff(np.append(start, len(token)))
            hot = np.repeat(many >= max(64, len(first) // 8), many)  # listed by this chunk itself
            if hot.any():
                rows.append((name & ((1 << bits) - 1), HOT, name, b"", token[hot].tobytes(), who[hot].tobytes(), b"", b""))
            only = ~hot
            only[start] = True
            count = np.repeat(np.where(many >= max(64, len(first) // 8), many, 1), many).astype(np.uint32)
            mark = np.where(hot, 0xFFFF, who).astype(np.uint16)
            token, mark, count = token[only], mark[only], count[only]
            bucket = (token >> U64(32)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            low = token.astype(np.uint32)
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                n = count[s:e]
                rows.append((int(bucket[s]), TOKENS, name, b"", low[s:e].tobytes(), mark[s:e].tobytes(), n.tobytes() if (n > 1).any() else b"", b""))
        yield _arrow(rows)

    return run


def _count(batches):
    """Counts each bucket's tokens over all chunks; each chunk gets back those that are in two sets
    at least. Rows of the other kinds pass."""
    tokens, marks, counts, chunks = [], [], [], []
    for b in batches:
        kind = b.column("kind").to_numpy()
        passing = np.flatnonzero(kind != TOKENS)
        if len(passing):
            yield b.take(pa.array(passing))
        for i in np.flatnonzero(kind == TOKENS).tolist():
            low = np.frombuffer(b.column("tokens")[i].as_buffer(), np.uint32)
            tokens.append(low.astype(U64) | U64(b.column("bucket")[i].as_py() << 32))
            marks.append(np.frombuffer(b.column("who")[i].as_buffer(), np.uint16))
            n = np.frombuffer(b.column("sizes")[i].as_buffer(), np.uint32)
            counts.append(n if len(n) else np.ones(len(low), np.uint32))
            chunks.append((b.column("chunk")[i].as_py(), len(low)))
    if not tokens:
        return
    token, mark, count = np.concatenate(tokens), np.concatenate(marks), np.concatenate(counts)
    del tokens, marks, counts
    names, index = np.unique(np.array([c for c, _ in chunks], np.int64), return_inverse=True)
    chunk = np.repeat(index, [n for _, n in chunks])
    order = np.argsort(token, kind="stable")
    t = token[order]
    start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    df = np.add.reduceat(count[order].astype(np.int64), start)
    df = np.repeat(df, np.diff(np.append(start, len(t))))
    shared = order[df > 1]
    df = df[df > 1]
    by = np.argsort(chunk[shared], kind="stable")
    shared, df = shared[by], df[by]
    edge = np.searchsorted(chunk[shared], np.arange(len(names) + 1))
    for k, name in enumerate(names.tolist()):
        own = slice(edge[k], edge[k + 1])
        if own.start < own.stop:
            yield _arrow([(0, TOKENS, name, b"", token[shared[own]].tobytes(), mark[shared[own]].tobytes(), np.minimum(df[own], 2**32 - 1).astype(np.uint32).tobytes(), b"")])


SET_ROW = "docs array<long>, least long, n long, one long, two long, tokens binary"


def _prefix(n: np.ndarray) -> np.ndarray:
    return n - (4 * n + 4) // 5 + 1


def _sets(batches):
    """Each chunk's sets: their documents and key and, for those that can have links, the tokens that
    other sets have too, rarest first."""
    state: dict[int, dict[int, list]] = {}
    for b in batches:
        for row in b.to_pylist():
            state.setdefault(row["chunk"], {}).setdefault(row["kind"], []).append(row)
    for rows in state.values():
        hot: dict[int, np.ndarray] = {}
        for r in rows.get(HOT, []):
            t, w = np.frombuffer(r["tokens"], U64), np.frombuffer(r["who"], np.uint16)
            edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
            hot = {int(t[s]): w[s:e] for s, e in zip(edge[:-1], edge[1:], strict=True)}
        token = [np.frombuffer(r["tokens"], U64) for r in rows.get(TOKENS, [])]
        who = [np.frombuffer(r["who"], np.uint16) for r in rows.get(TOKENS, [])]
        df = [np.frombuffer(r["sizes"], np.uint32) for r in rows.get(TOKENS, [])]
        token, who, df = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((token, U64), (who, np.uint16), (df, np.uint32)))
        listed = np.flatnonzero(who == 0xFFFF)
        if len(listed):
            lists = [hot[int(t)] for t in token[listed]]
            many = [len(x) for x in lists]
            rest = who != 0xFFFF
            token = np.concatenate([token[rest], np.repeat(token[listed], many)])
            df = np.concatenate([df[rest], np.repeat(df[listed], many)])
            who = np.concatenate([who[rest], *lists])
        order = np.lexsort((token, df, who))
        token, who = token[order], who[order].astype(np.int64)
        (r,) = rows[SETS]
        size = np.frombuffer(r["sizes"], np.uint32).astype(np.int64)
        keys = np.frombuffer(r["keys"], np.int64).reshape(-1, 2)
        ids, own = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["who"], np.uint16).astype(np.int64)
        shared = np.bincount(who, minlength=len(size))
        start = np.cumsum(shared) - shared
        alive = (shared > 0) & (size - shared < _prefix(size))
        blobs = [token[start[k] : start[k] + shared[k]].tobytes() if alive[k] else None for k in range(len(size))]
        by = np.lexsort((ids, own))
        edges = np.searchsorted(own[by], np.arange(len(size) + 1)).astype(np.int32)
        docs = pa.ListArray.from_arrays(pa.array(edges), pa.array(ids[by]))
        yield pa.RecordBatch.from_arrays([docs, pa.array(ids[by][edges[:-1]]), pa.array(size), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(blobs, pa.binary())], ["docs", "least", "n", "one", "two", "tokens"])


def document_sets(docs: DataFrame) -> DataFrame:
    """The sets of each chunk of documents: docs, least (doc_id), n, one and two (key), tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    many = partitions(spark)
    bits = max(10, (4 * many - 1).bit_length())
    sent = docs.mapInArrow(freeing(_send(bits)), ROW)
    counted = sent.repartition(many, "bucket").mapInArrow(freeing(_count), ROW)
    return counted.repartition(many, "chunk").mapInArrow(freeing(_sets), SET_ROW)


def _index(batches):
    """A row for each token of a set's prefix: its place among the shared tokens, and the sizes."""
    for b in batches:
        sets, n = b.column("set_id").to_numpy(), b.column("n").to_numpy()
        tokens = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("tokens")]
        shared = np.array([len(t) for t in tokens], np.int64)
        many = np.minimum(_prefix(n) - (n - shared), shared)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        token = np.concatenate([t[:m] for t, m in zip(tokens, many, strict=True)]) if len(tokens) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(token), *(pa.array(np.repeat(x, many)) for x in (sets, n, shared)), pa.array(place)], ["token", "set_id", "n", "shared", "place"])


def _overlap(batches):
    """Overlaps of each first set's tokens with those of the sets that follow it."""
    first, base = None, np.zeros(0, np.int64)
    for b in batches:
        out, key = [], list(zip(b.column("a").to_pylist(), b.column("salt").to_pylist(), strict=True))
        for k, other, blob in zip(key, b.column("b").to_pylist(), b.column("tokens"), strict=True):
            t = np.frombuffer(blob.as_buffer(), np.int64)
            if other is None:
                first, base = k, np.sort(t)
            elif k == first:
                at = np.minimum(np.searchsorted(base, t), len(base) - 1)
                out.append((k[0], other, int((base[at] == t).sum())))
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "overlap"])


def overlaps(pairs: DataFrame, sets: DataFrame, group: int = 128) -> DataFrame:
    """overlap of each of pairs (a, b). A set with many partners is sent once to each `group`."""
    spark = pairs.sparkSession
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).select("a", F.ceil(F.col("m") / group).alias("salts"))
    salted = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt"), "salts")
    mine = sets.select("set_id", "tokens")
    partners = salted.join(mine.withColumnRenamed("set_id", "b"), "b").select("a", "salt", "b", "tokens")
    firsts = sizes.join(mine.withColumnRenamed("set_id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "tokens")
    rows = firsts.unionByName(partners).repartition(partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return rows.mapInArrow(freeing(_overlap), "a long, b long, overlap long")


def links_from(overlap: Column, na: Column, nb: Column) -> Column:
    """Whether 100 * intersection >= 80 * union."""
    return 9 * overlap >= 4 * (na + nb)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach) of every document.

    Two documents link if 100 * |intersection| >= 80 * |union| of their sets of 5-word shingles of
    the whole text; without words, a document links with nothing. Null and empty texts have no
    words. Rows that repeat a doc_id are one document with several texts: they share a component.
    A null doc_id has no links and a null component. An empty table gives no rows; other columns are
    left out; texts of any length count whole.
    """
    texts = doc_texts(docs)
    nameless = texts.where("doc_id is null").mapInArrow(_sizes, "doc_id long, n_shingles long")
    found = cut(document_sets(texts.where("doc_id is not null")))
    members = found.where("n > 0").groupBy("one", "two", "n").agg(F.min("least").alias("least")).withColumn("set_id", F.col("one"))
    blobs = found.where("tokens is not null").groupBy("one", "two", "n").agg(F.first("tokens").alias("tokens"))
    sets = cut(blobs.join(members, ["one", "two", "n"]).select("set_id", "n", "tokens"))
    index = sets.mapInArrow(freeing(_index), "token long, set_id long, n long, shared long, place long")
    often = index.groupBy("token").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("token")
    index = cut(index.join(often, "token").withColumn("class", F.floor(F.log("n") / F.log(F.lit(1.25)) + 1e-9)))

    # Families: each set and the hub of its lists, of its size class or the next, if they link.
    spread = index.select("token", "set_id", "n", (F.col("n") - F.col("shared")).alias("own"), F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"))
    family = cut(attach(spread, sets))
    early = components(family.select(F.col("hub").alias("a"), F.col("set_id").alias("b")))

    # Rows that repeat a doc_id with another text join their sets.
    owners = found.where("n > 0").select(F.explode("docs").alias("doc_id"), F.col("one").alias("b"))
    several = owners.groupBy("doc_id").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a <> z").select("doc_id", "a")
    same_doc = owners.join(several, "doc_id").where("a <> b").select("a", "b").distinct()

    edges = family.select(F.col("hub").alias("a"), F.col("set_id").alias("b")).unionByName(cross_links(index, sets, family, early)).unionByName(same_doc)
    final = members.join(components(edges).withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    smallest = final.groupBy("component").agg(F.min("least").alias("component_id"))
    named = final.join(smallest, "component").select("one", "two", "n", "component_id")
    rows = found.select("docs", "n", "one", "two").join(named, ["one", "two", "n"], "left")
    own = rows.select(F.explode("docs").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return own.unionByName(nameless.withColumn("component_id", F.lit(None).cast("long")))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that reach a smaller doc_id by links, one for each doc_id.

    Of rows with one doc_id the one whose columns have the smallest hash stays, so always the same. Rows
    with a null doc_id have no links and stay. Columns of any name are carried as they are.
    """
    found = jaccard_components(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    kept = docs.join(gone, "doc_id", "left_anti").select(columns)
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("doc_id")
    if again.isEmpty():
        return kept
    several = kept.join(again, "doc_id", "left_semi").select(F.col("doc_id"), F.struct(columns).alias("row"))
    first = several.groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(columns).unionByName(first)


def attach(spread: DataFrame, sets: DataFrame) -> DataFrame:
    """For each set the hub that most of its lists have, if they link.

    A list's hub is the set with the fewest shingles that no other set has: of copies with changes of
    their own it is the nearest to all of them.
    """
    hubs = spread.groupBy("token", "class").agg(F.min(F.struct("own", "set_id", "n")).alias("hub"))
    tries = spread.join(hubs, ["token", "class"]).where("hub.set_id <> set_id and 5 * least(n, hub.n) >= 4 * greatest(n, hub.n)")
    votes = tries.groupBy("set_id", F.col("hub.set_id").alias("hub"), "n", F.col("hub.n").alias("hub_n")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("set_id", "n").agg(F.max(F.struct("votes", "hub", "hub_n")).alias("b")).select("set_id", "n", "b.hub", "b.hub_n")
    compared = overlaps(best.select(F.col("hub").alias("a"), F.col("set_id").alias("b")), sets).select(F.col("a").alias("hub"), F.col("b").alias("set_id"), "overlap")
    return best.join(compared, ["hub", "set_id"]).where(links_from(F.col("overlap"), F.col("n"), F.col("hub_n"))).select("set_id", "hub", "n", "hub_n", "overlap")


def cross_links(index: DataFrame, sets: DataFrame, family: DataFrame, early: DataFrame) -> DataFrame:
    """Links (a, b) between sets of different early components that share a list.

    A set has at most |set - hub| more shingles in common with any other than its hub has, and at
    most |hub - set| fewer, counting those that some other set has. So families are compared by their hubs, and only members that these bounds leave open
    are compared with each other.
    """
    sizes = sets.select("set_id", "n", (F.octet_length("tokens") / 8).cast("long").alias("shared"))  # tokens of one set alone are in no overlap
    hub_of = family.select("set_id", "hub", "overlap").join(sizes.select(F.col("set_id").alias("hub"), F.col("shared").alias("hub_shared")), "hub")
    hub_of = sizes.join(hub_of, "set_id", "left").withColumns({"plus": F.col("shared") - F.col("overlap"), "minus": F.col("hub_shared") - F.col("overlap")})
    members = hub_of.join(early.withColumnRenamed("id", "set_id"), "set_id", "left")
    members = cut(members.select("set_id", "n", F.coalesce("hub", "set_id").alias("hub"), F.coalesce("plus", F.lit(0)).alias("plus"), F.coalesce("minus", F.lit(0)).alias("minus"), F.coalesce("component", "set_id").alias("component")))

    # Lists that hold several components, in blocks of a family and size class with their extremes.
    rows = index.join(members.select("set_id", "hub", "component"), "set_id")
    blocks = rows.groupBy("token", "hub", "class", "component").agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max("place").alias("before"), F.max(F.col("shared") - F.col("place")).alias("rest"))
    mixed = blocks.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    blocks = cut(blocks.join(mixed, "token"))
    x, y = blocks.alias("x"), blocks.alias("y")
    reach = F.least("x.before", "y.before") + F.least("x.rest", "y.rest")
    near = (F.col("x.n_hi") * 5 >= F.col("y.n_lo") * 4) & (F.col("y.n_hi") * 5 >= F.col("x.n_lo") * 4)
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.hub") < F.col("y.hub")) & (F.col("x.component") != F.col("y.component"))
    hubs = x.join(y, apart & near & links_from(reach, F.col("x.n_lo"), F.col("y.n_lo"))).select(F.col("x.hub").alias("a"), F.col("y.hub").alias("b")).distinct()
    known = overlaps(cut(hubs), sets)

    most = members.groupBy("hub").agg(F.max("plus").alias("most"), F.min("n").alias("n_lo"))
    ends = known.join(most.select(F.col("hub").alias("a"), F.col("most").alias("most_a"), F.col("n_lo").alias("lo_a")), "a").join(most.select(F.col("hub").alias("b"), F.col("most").alias("most_b"), F.col("n_lo").alias("lo_b")), "b")
    ends = ends.where(links_from(F.col("overlap") + F.col("most_a") + F.col("most_b"), F.col("lo_a"), F.col("lo_b")))
    one = members.select(F.col("hub").alias("a"), F.col("set_id").alias("sa"), F.col("n").alias("na"), F.col("plus").alias("plus_a"), F.col("minus").alias("minus_a"))
    two = members.select(F.col("hub").alias("b"), F.col("set_id").alias("sb"), F.col("n").alias("nb"), F.col("plus").alias("plus_b"), F.col("minus").alias("minus_b"))
    half = one.join(ends, "a").where(links_from(F.col("overlap") + F.col("plus_a") + F.col("most_b"), F.col("na"), F.col("lo_b")))
    high = F.col("overlap") + F.col("plus_a") + F.col("plus_b")
    low = F.col("overlap") - F.col("minus_a") - F.col("minus_b")
    both = half.join(two, "b").where(links_from(high, F.col("na"), F.col("nb")) & (5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")))
    answers = cut(both.select("sa", "sb", "na", "nb", links_from(low, F.col("na"), F.col("nb")).alias("sure")))
    open_ = answers.where("not sure").select(F.col("sa").alias("a"), F.col("sb").alias("b"), "na", "nb")
    counted = overlaps(open_.select("a", "b"), sets).join(open_, ["a", "b"]).where(links_from(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b")
    return answers.where("sure").select(F.col("sa").alias("a"), F.col("sb").alias("b")).unionByName(counted)


def _sizes(batches):
    for b in batches:
        for c in byte_chunks(b, "text", CHUNK):
            _, text = shingles(*binary_column(c.column("text")))
            yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(np.bincount(text, minlength=c.num_rows))], ["doc_id", "n_shingles"])
