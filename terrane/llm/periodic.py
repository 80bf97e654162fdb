"""Periodic runs of words, by recursive frequency splitting.

A run is a stretch of words that repeats one block at least four times over, as far as it goes. A
word that occurs fewer than four times in a segment of the text is in no run there, so it splits
the segment; counting starts anew in each part until no part changes. What survives is scanned by
lags: windows of 2, 4, 8, ... words are numbered from those of half the length, and where a window
recurs at once after q words, q from half its length up, the words q apart are identical; a stretch
of such places is one whole run. The split goes on at every length: windows that occur fewer than
three times in their segment are in no run of a greater period. So a text of n words takes n log n
steps, where scanning every lag of every segment would take n squared.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import binary_column, byte_chunks, doc_texts, freeing

TIMES = 4
LEAST = 6
#: A text made to need more rounds of splitting goes on to the scan as it is, which finds the same runs.
ROUNDS = 64
CHUNK = 4 << 20
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def numbered(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts (bytes and offsets): each word's number (equal words, equal numbers), first byte and
    length, and how many words each text has."""
    blank = _BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[edges] = True
    gap = np.concatenate([[True], blank, [True]])
    begin = np.flatnonzero(~blank & (first[:-1] | gap[:-2]))
    end = np.flatnonzero(~blank & (first[1:] | gap[2:])) + 1
    off = np.concatenate([[0], np.cumsum(end - begin)])
    column = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data[~blank])])
    words = column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return words, begin, end - begin, np.diff(np.searchsorted(begin, edges))


def _classes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal pairs of keys, and how often each pair occurs, row by row."""
    a, b = keys
    number = pd.factorize(a * (int(b.max(initial=0)) + 1) + b)[0]
    return number, np.bincount(number)[number] if len(number) else number


def segments(words: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that survive the recursive split by rare words, and the segment that each is in.

    segment: of every place at first, ascending. Segments that no longer change are set aside.
    """
    at, own = np.arange(len(words)), segment
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        if not len(at):
            break
        often = _classes(own, words[at])[1] >= TIMES
        stable = np.bincount(own, ~often, minlength=int(own[-1]) + 1)[own] == 0
        done.append((at[stable], own[stable]))
        left = often & ~stable
        at, own = at[left], own[left]
        own = np.cumsum(np.concatenate([[0], (np.diff(at) != 1) | (np.diff(own) != 0)])[: len(at)])
        long = np.bincount(own, minlength=1)[own] >= LEAST
        at, own = at[long], np.unique(own[long], return_inverse=True)[1]
    at, own = (np.concatenate(x) for x in zip(*done, (at, own), strict=True))
    order = np.argsort(at, kind="stable")
    at, own = at[order], own[order]
    # Segments set aside in different rounds may share a number; a new one starts at every gap.
    return at, np.cumsum(np.concatenate([[0], (np.diff(at) != 1) | (np.diff(segment[at]) != 0) | (np.diff(own) != 0)])[: len(at)])


def find(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in words), length and period of all runs of texts with so many words each, by start,
    then period. Runs never cross texts."""
    at, own = segments(words, np.repeat(np.arange(len(counts)), counts))
    number, size = _classes(own, words[at])[0], 1
    place = np.full(len(words) + 1, -1, np.int64)
    found = []
    while len(at):
        place[at] = np.arange(len(at))
        other = place[np.minimum(at + size, len(words))]
        both = (other >= 0) & (own[other] == own)
        place[at] = -1
        number, often = _classes(number[both], number[other[both]])
        at, own, size = at[both], own[both], 2 * size
        order = np.argsort(number, kind="stable")
        lag = np.zeros(len(at), np.int64)
        same = number[order[1:]] == number[order[:-1]]
        lag[order[:-1][same]] = (at[order[1:]] - at[order[:-1]])[same]
        lag[(lag < size // 2) | (lag >= size)] = 0
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(lag) != 0)])[: len(at)]
        heads = np.flatnonzero(new)
        q = lag[heads]
        length = np.diff(np.append(heads, len(at))) - 1 + size + q
        good = (q > 0) & (length >= np.maximum(LEAST, TIMES * q))
        found.append((at[heads[good]], length[good], q[good]))
        often = often >= TIMES - 1
        at, own, number = at[often], own[often], number[often]
    start, length, q = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _tiled(ids: list, counts: np.ndarray) -> np.ndarray:
    """For each word, which of its chunk's words stands there once a tenth of the texts are tiled."""
    source = np.arange(int(counts.sum()))
    for d, n, s in zip(ids, counts.tolist(), (np.cumsum(counts) - counts).tolist(), strict=True):
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            source[s + a : s + n] = s + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return source


def _joined(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> bytes:
    """Words (first bytes and lengths), joined by one space."""
    if not len(begin):
        return b""
    before = np.cumsum(length) - length
    out = np.full(int(length.sum()) + len(begin) - 1, 32, np.uint8)
    step = np.arange(int(length.sum()))
    out[step + np.repeat(np.arange(len(begin)), length)] = data[step + np.repeat(begin - before, length)]
    return out.tobytes()


def _chunk(b: pa.RecordBatch, tiled: bool) -> pa.RecordBatch:
    data, edges = binary_column(b.column("text"))
    words, begin, length, counts = numbered(data, edges)
    if tiled:
        source = _tiled(b.column("doc_id").to_pylist(), counts)
        words, begin, length = words[source], begin[source], length[source]
    start, size, q = find(words, counts)
    to = np.cumsum(counts)
    text = np.searchsorted(to, start, "right")
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + q, 1)
    np.add.at(edge, start + size, -1)
    kept = np.cumsum(edge[:-1]) == 0
    texts = [_joined(data, begin[s:e][kept[s:e]], length[s:e][kept[s:e]]) for s, e in zip((to - counts).tolist(), to.tolist(), strict=True)]
    first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(counts)))]).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(start - (to - counts)[text]), pa.array(size), pa.array(q)], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(first), runs), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "text"])


def collapse(docs: DataFrame, tiled: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start, then period) and text of each row of a
    documents table: the words outside the runs and of each run's first block, joined by one space.

    Words are what is between ASCII white space; those of whole texts are read, of any length. tiled
    first repeats a block of words up to the end of those texts whose id's CRC-32 ten divides, by that
    number (see _tiled). A null or empty text has no word and no run, and its text is empty. Repeated
    rows and null ids (never tiled) are each a row; an empty table gives none; other columns are left
    out. It is one narrow stage: a document is never split, and no row meets another.
    """

    def run(batches):
        for b in batches:
            for c in byte_chunks(b, "text", CHUNK):
                yield _chunk(c, tiled)

    return doc_texts(docs).mapInArrow(freeing(run), f"doc_id long, n_words long, runs {RUNS}, text string")


def summary(collapsed: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; nulls if there is none),
    and digests of all runs and of the text that is left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    return collapsed.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("_best.length * 1000 div -_best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
