"""Best-fit packing of documents into token sequences, by exact-complement hashing.

Encoding runs on Spark; the plan needs only how many pieces there are of each length, at most
2048 counters. It is made on the driver: combinations of one, two or three lengths that exactly
fill a sequence's gap are looked up and consumed as often as the counters allow; where there is
none, the piece that fits best goes in, and the rest of the gap is looked up. Pieces are then ranked
within their length, again on Spark, and a rank says which planned sequence a piece goes to.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import cut, doc_texts, freeing, partitions
from terrane.llm.token_counts import default_tokenizer, encoder

SEQUENCE = 2048
SEPARATOR = 0


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and separator, cut if over size.

    A null or empty text is the separator alone. Only the first piece may be shorter than size if
    a document is cut. Repeated rows are packed each on their own.
    """
    path = tokenizer or default_tokenizer()
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long"

    def encode_all(batches):
        encode = encoder(path)
        for b in batches:
            out: list[tuple] = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(encode(t), np.uint32(SEPARATOR)).astype("<u4")
                first = len(ids) % size or size
                edges = [0, *range(first, len(ids) + 1, size)]
                out += [(d, k, s, e - s, zlib.crc32(ids[s:e])) for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return doc_texts(docs).mapInArrow(freeing(encode_all), schema)


def _pair(c: np.ndarray, gap: int, most: int) -> tuple[int, int] | None:
    """Two lengths with counters that sum to gap, the larger as large as may be (not over most)."""
    if gap < 2:
        return None
    a = np.arange(min(gap - 1, most), (gap + 1) // 2 - 1, -1)
    good = np.flatnonzero((c[a] > 0) & (c[gap - a] > np.where(a * 2 == gap, 1, 0)))
    return (int(a[good[0]]), gap - int(a[good[0]])) if len(good) else None


def _pair_sums(c: np.ndarray) -> np.ndarray:
    """Whether each total is the sum of two lengths with counters: a bit set, shifted by each length."""
    bits, out = int.from_bytes(np.packbits(c > 0, bitorder="little").tobytes(), "little"), 0
    for a in np.flatnonzero(c).tolist():
        out |= bits << a
    out &= (1 << len(c)) - 1
    return np.unpackbits(np.frombuffer(out.to_bytes(len(c) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(c)] > 0


def _complement(c: np.ndarray, gap: int, most: int) -> tuple[int, ...]:
    """One, two or three lengths (none over most) that sum to gap, within the counters; as few and
    as long ones as may be, so that short ones are left for gaps that need them."""
    if gap <= most and c[gap] > 0:
        return (gap,)
    if gap <= 2 * most and (found := _pair(c, gap, most)):
        return found
    if not 3 <= gap <= 3 * most:
        return ()
    firsts = np.arange(min(gap - 2, most), (gap + 2) // 3 - 1, -1)
    for a in firsts[(c[firsts] > 0) & _pair_sums(c)[gap - firsts]].tolist():
        c[a] -= 1
        found = _pair(c, gap - a, a)
        c[a] += 1
        if found:
            return (a, *found)
    return ()


def planned(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int, str]]:
    """Patterns (lengths in one sequence), how many sequences have each, and what filled them:
    `whole`, `single`, `pair` or `triple`, or `best fit` if a gap is left. Every piece is in one.

    A sequence begins with the longest piece left. Its gap is filled exactly by one, two or three
    lengths if the counters have any, else the longest piece that fits goes in, and the smaller gap
    is looked up in turn. A pattern is used as often as the counters allow.
    """
    c = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        c[length] += n
    out, most = [], size
    while (most := int(np.flatnonzero(c[: most + 1])[-1]) if c[: most + 1].any() else 0) > 0:
        left, pattern, kind = c.copy(), [most], "whole"
        left[most] -= 1
        gap = size - most
        while gap:
            found = _complement(left, gap, most)
            kind = ("best fit", "single", "pair", "triple")[len(found)]
            if not found:
                fits = np.flatnonzero(left[: min(gap, most) + 1])
                if not len(fits):
                    break
                found = (int(fits[-1]),)
            for x in found:
                left[x] -= 1
            pattern += found
            gap -= sum(found)
        use = Counter(pattern)
        times = min(int(c[x]) // n for x, n in use.items())
        for x, n in use.items():
            c[x] -= n * times
        out.append((tuple(pattern), times, kind))
    return out


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """The patterns of planned(), and how many sequences have each."""
    return [(pattern, times) for pattern, times, _ in planned(counts, size)]


def filled(counts: dict[int, int], size: int = SEQUENCE) -> dict[str, int]:
    """How many sequences of the plan each way of filling accounts for."""
    out: Counter = Counter()
    for _, times, kind in planned(counts, size):
        out[kind] += times
    return dict(out)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Which ranks of which length go to which sequences: rows sorted by length and first rank."""
    rows, taken, base = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length in dict.fromkeys(pattern):
            each = pattern.count(length)
            first = taken.get(length, 0)
            rows.append((length, first, base, each, offset))
            taken[length] = first + each * times
            offset += each * length
        base += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "base", "each", "offset"), cols, strict=True))


def ranked(df: DataFrame) -> DataFrame:
    """df with rank: 0, 1, ... within each length. A frequent length is ranked in many groups."""
    groups = partitions(df.sparkSession)
    dealt = df.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    own = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n")).select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return dealt.withColumn("_own", F.row_number().over(own) - 1).join(starts, ["length", "_group"]).withColumn("rank", F.col("_start") + F.col("_own")).drop("_group", "_own", "_start")


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Where each piece of each document goes: pieces() with sequence_id and offset.

    Offsets within a sequence are gapless from 0 and no sequence is longer than size. An empty
    table gives no rows; repeated rows are packed each; long texts are cut, not shortened; pieces of
    equal length are dealt to sequences by a hash of their id; extra columns are left out.
    """
    cuts = cut(pieces(docs, tokenizer, size))
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # size rows at most
    s = slots(plan(counts, size))
    key = s["length"] << 44 | s["first"]

    def place(batches):
        for b in batches:
            length = b.column("length").to_numpy().astype(np.int64)
            rank = b.column("rank").to_numpy()
            i = np.searchsorted(key, length << 44 | rank, "right") - 1
            k = rank - s["first"][i]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("piece"), b.column("start"), pa.array(length), b.column("ids_crc32"), pa.array(s["base"][i] + k // s["each"][i]), pa.array(s["offset"][i] + k % s["each"][i] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked(cuts).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
