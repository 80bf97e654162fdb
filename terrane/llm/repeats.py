"""Suffix-array dedup: removes bytes of strings of `LENGTH` bytes that occur earlier.

1. Every string of LENGTH bytes has a minimiser: the 32 bytes in it whose hash is least. Runs of
   strings with the same one are segments. Chunks of documents count their minimisers together,
   over all documents, and only segments whose minimiser occurs again go on. (Documents equal to
   an earlier one are told by their hashes on the way; each of their strings occurs earlier.)
2. Segments meet in the buckets of their minimisers, equal segments of a chunk as one. Of very
   frequent minimisers, parts of segments are dealt by a hash of what their strings have in common.
3. Different segments of a minimiser get an index: a Burrows-Wheeler transform, on which
   intervals are extended backwards, breadth first. That derives the common prefixes of
   neighbouring suffixes by increasing value (Beller et al. 2013) and stops at LENGTH: suffixes
   with no boundary between them by then share LENGTH bytes.
4. Each string but the first of its kind is marked in its document, and marked bytes are removed.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.common import binary_column, byte_chunks, freeing, mix64, partitions, small_batches

LENGTH = 100
GRAM = 32
CHUNK = 1 << 20
BLOCK = 1 << 27
TASK_BYTES = 8 << 20  # of text for each bucket's or chunk's task
FREQUENT = 300
STRIDE = 8
INDEX_BYTES = 1 << 18
SEPARATOR = 0xFF  # no byte of UTF-8
U64 = np.uint64
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_CODE = mix64(np.arange(1, 257, dtype=U64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

ROW = "bucket long, kind int, chunk long, p binary, q binary, r binary, s binary, carry binary"
NAMES = [x.split()[0] for x in ROW.split(", ")]
PRINTS, COPIES, TEXTS, SEGMENTS, MARKS, DONE = range(6)
SEGMENT = np.dtype([("key", "u8"), ("doc", "i8"), ("row", "i4"), ("start", "i4"), ("size", "i4"), ("windows", "i4")])
MARK = np.dtype([("row", "i4"), ("start", "i4"), ("end", "i4")])


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)


def _packed(column: pa.Array) -> bytes:
    """An Arrow array of any kind as bytes, without loss."""
    batch = pa.RecordBatch.from_arrays([column], ["carry"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return _squeeze(out.getvalue().to_pybytes())


def _unpacked(raw: bytes) -> pa.Array:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(raw)).read_next_batch().column(0)


class Hashes:
    """Hashes of any parts of a text, from sums over its prefixes."""

    def __init__(self, data: np.ndarray, odd: int):
        n = len(data) + 1
        if odd not in _POWERS or len(_POWERS[odd][0]) < n:
            both = []
            for base in (odd, pow(odd, -1, 1 << 64)):
                x = np.full(n, base, U64)
                x[0] = 1
                both.append(np.cumprod(x, dtype=U64))
            _POWERS[odd] = (both[0], both[1])
        up, self.down = _POWERS[odd]
        self.total = np.concatenate([np.zeros(1, U64), np.cumsum(_CODE[data] * up[: n - 1], dtype=U64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place (of less at the end)."""
    h, odd, step = _CODE[data], _Q, 1
    while step < GRAM:
        h = h * U64(odd)
        h[:-step] += (h[step:] * U64(pow(odd, -1, 1 << 64))) if len(h) > step else 0
        odd, step = odd * odd & (1 << 64) - 1, step * 2
    return mix64(h)


def runs(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each run of strings with the same minimiser, its place and hash.

    Starts are taken BLOCK by BLOCK, as places have 28 bits; a block's end ends a run."""
    parts = []
    for lo in range(0, max(1, len(data) - LENGTH + 1), BLOCK):
        hi = min(len(data), lo + BLOCK + LENGTH - 1)
        a, b = int(np.searchsorted(edges, lo, "right")) - 1, int(np.searchsorted(edges, hi, "left"))
        s, e, place, h = _runs(data[lo:hi], np.clip(edges[a : b + 1] - lo, 0, hi - lo))
        parts.append((s + lo, e + lo, place + lo, h))
    s, e, place, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return s, e, place, h


def _runs(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, np.zeros(0, U64)
    h = gram_hashes(data)
    key = (h >> U64(28)) << U64(28) | np.arange(len(h), dtype=U64)  # of equal hashes, the first place
    width, step = LENGTH - GRAM + 1, 1
    while step * 2 <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if width > step:
        key = np.minimum(key[: -(width - step)], key[width - step :])
    place = (key & U64((1 << 28) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    start = np.arange(len(data) - LENGTH + 1)
    good = (text[: len(start)] == text[LENGTH - 1 :])[: len(place)]
    place = place[: len(good)]
    first = good & np.concatenate([[True], (place[1:] != place[:-1]) | ~good[:-1]])
    last = good & np.concatenate([(place[1:] != place[:-1]) | ~good[1:], [True]])
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    return s, e, place[s], h[place[s]]


def _squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(x)


def _print(bits: int):
    """Chunks of documents: their distinct minimisers and documents' hashes to the buckets."""

    def run(batches):
        serial = itertools.count()
        for b in batches:
            for c in byte_chunks(b, "text", CHUNK):
                name = int(mix64(np.array([TaskContext.get().partitionId() << 32 | next(serial)], U64)).view(np.int64)[0])
                home = name & ((1 << bits) - 1)
                data, edges = binary_column(c.column("text"))
                ids = c.column("doc_id").fill_null(-(1 << 63)).to_numpy().astype(np.int64)
                named = np.asarray(c.column("doc_id").is_valid())
                rows = [(home, TEXTS, name, _squeeze(data.tobytes()), edges.tobytes(), ids.tobytes(), named.tobytes(), _packed(c.column("carry")))]
                h = np.unique(runs(data, edges)[3])
                if len(h):
                    bucket = (h >> U64(64 - bits)).astype(np.int64)
                    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                    count = self_counts(data, edges, h)
                    low = (h >> U64(32 - bits)).astype(np.uint32)
                    rows += [(int(bucket[s]), PRINTS, name, low[s:e].tobytes(), count[s:e].tobytes(), b"", b"", None) for s, e in zip(cut[:-1], cut[1:], strict=True)]
                long = np.flatnonzero(np.diff(edges) >= LENGTH)
                if len(long):
                    one, two = (Hashes(data, odd).of(edges[long], edges[long + 1]) for odd in (_P, _Q))
                    bucket = (one >> U64(64 - bits)).astype(np.int64)
                    by = np.argsort(bucket, kind="stable")
                    bucket = bucket[by]
                    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                    both = np.stack([one, two, ids.view(U64)[long], long.astype(U64)], 1)[by]
                    rows += [(int(bucket[s]), COPIES, name, np.ascontiguousarray(both[s:e]).tobytes(), b"", b"", b"", None) for s, e in zip(cut[:-1], cut[1:], strict=True)]
                yield _arrow(rows)
        _POWERS.clear()

    def self_counts(data, edges, distinct):
        h = runs(data, edges)[3]
        return np.bincount(np.searchsorted(distinct, h), minlength=len(distinct)).astype(np.uint32)

    return run


def _match_prints(batches):
    """Minimisers that occur again, and documents equal to earlier ones, back to their chunks."""
    prints, counts, owners, copies = [], [], [], []
    for b in batches:
        kind = b.column("kind").to_numpy()
        passing = np.flatnonzero(kind > COPIES)
        if len(passing):
            yield b.take(pa.array(passing))
        for i in np.flatnonzero(kind <= COPIES).tolist():
            raw, name = b.column("p")[i].as_buffer(), b.column("chunk")[i].as_py()
            if kind[i] == PRINTS:
                low = np.frombuffer(raw, np.uint32)
                prints.append(low.astype(U64) | U64(b.column("bucket")[i].as_py() << 32))
                counts.append(np.frombuffer(b.column("q")[i].as_buffer(), np.uint32))
                owners.append((name, len(low)))
            else:
                x = np.frombuffer(raw, np.int64).reshape(-1, 4)
                copies.append((name, x))
    found: dict[int, tuple] = {}
    if prints:
        p, n = np.concatenate(prints), np.concatenate(counts).astype(np.int64)
        names, index = np.unique(np.array([c for c, _ in owners], np.int64), return_inverse=True)
        chunk = np.repeat(index, [k for _, k in owners])
        order = np.argsort(p, kind="stable")
        t = p[order]
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        total = np.repeat(np.add.reduceat(n[order], start), np.diff(np.append(start, len(t))))
        order, total = order[total > 1], total[total > 1]
        by = np.argsort(chunk[order], kind="stable")
        order, total = order[by], total[by]
        edge = np.searchsorted(chunk[order], np.arange(len(names) + 1))
        for k, name in enumerate(names.tolist()):
            own = slice(edge[k], edge[k + 1])
            if own.start < own.stop:
                yield _arrow([(0, PRINTS, name, p[order[own]].tobytes(), (total[own] > FREQUENT).tobytes(), b"", b"", None)])
    if copies:
        x = np.concatenate([c for _, c in copies])
        name = np.repeat(np.array([n for n, _ in copies], np.int64), [len(c) for _, c in copies])
        order = np.lexsort((x[:, 3], name, x[:, 2], x[:, 1], x[:, 0]))
        y = x[order]
        again = np.concatenate([[False], (y[1:, :2] == y[:-1, :2]).all(1)])
        for k in order[again].tolist():
            found.setdefault(int(name[k]), []).append(int(x[k, 3]))
        for k, rows in found.items():
            yield _arrow([(0, COPIES, k, np.array(rows, np.int64).tobytes(), b"", b"", b"", None)])


def _split_frequent(s, e, place, h, data, hashes):
    """Segments of frequent minimisers in parts of STRIDE places, keyed by what all strings of a
    part share: the bytes at a fixed distance from the minimiser."""
    group_hi, group_lo = (place - s) // STRIDE, (place - e) // STRIDE
    many = group_hi - group_lo + 1
    row = np.repeat(np.arange(len(s)), many)
    g = group_hi[row] - (np.arange(len(row)) - (np.cumsum(many) - many)[row])
    lo = np.maximum(s[row], place[row] - (g * STRIDE + STRIDE - 1))
    hi = np.minimum(e[row], place[row] - g * STRIDE)
    common = place[row] - g * STRIDE
    key = mix64(h[row] ^ hashes.of(common, common - STRIDE + 1 + LENGTH) + g.astype(U64))
    return lo, hi, key


def _segment(bits: int):
    """Chunks' texts and what is known of their minimisers: segments to the buckets, the texts
    concerned on to their end, documents without repeats done."""

    def run(batches):
        state: dict[int, dict[int, list]] = {}
        for b in batches:
            for row in b.to_pylist():
                state.setdefault(row["chunk"], {}).setdefault(row["kind"], []).append(row)
        while state:
            name, rows = state.popitem()
            yield _arrow(list(chunk(name, rows)))
        _POWERS.clear()

    def chunk(name, rows):
        home = name & ((1 << bits) - 1)
        (t,) = rows[TEXTS]
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(t["p"]), np.uint8)
        edges, ids, named = np.frombuffer(t["q"], np.int64), np.frombuffer(t["r"], np.int64), np.frombuffer(t["s"], bool)
        copy = np.zeros(len(ids), bool)
        for r in rows.get(COPIES, []):
            copy[np.frombuffer(r["p"], np.int64)] = True
        known = np.concatenate([np.frombuffer(r["p"], U64) for r in rows.get(PRINTS, [])] or [np.zeros(0, U64)])
        often = np.concatenate([np.frombuffer(r["q"], bool) for r in rows.get(PRINTS, [])] or [np.zeros(0, bool)])
        touched = np.zeros(len(ids), bool)
        marks = np.zeros(0, MARK)
        if len(known):
            by = np.argsort(known)
            known, often = known[by], often[by]
            s, e, place, h = runs(data, edges)
            doc = np.searchsorted(edges, s, "right") - 1
            at = np.minimum(np.searchsorted(known, h >> U64(32 - bits)), len(known) - 1)
            keep = (known[at] == h >> U64(32 - bits)) & ~copy[doc]
            s, e, place, h, frequent = s[keep], e[keep], place[keep], h[keep], often[at[keep]]
            if len(s):
                one, two = Hashes(data, _P), Hashes(data, _Q)
                lo, hi, key = _split_frequent(s[frequent], e[frequent], place[frequent], h[frequent], data, one)
                s, e, key = np.concatenate([s[~frequent], lo]), np.concatenate([e[~frequent], hi]), np.concatenate([h[~frequent], key])
                doc = np.searchsorted(edges, s, "right") - 1
                touched[doc] = True
                end = e + LENGTH
                x, y = one.of(s, end), two.of(s, end)
                order = np.lexsort((s, doc, ids[doc], y, x, key))
                same = np.concatenate([[False], (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1]) & (key[order][1:] == key[order][:-1])])
                again = order[same]
                marks = np.zeros(len(again), MARK)
                marks["row"], marks["start"], marks["end"] = doc[again], s[again] - edges[doc[again]], e[again] + 1 - edges[doc[again]]
                new = order[~same]
                segs = np.zeros(len(new), SEGMENT)
                segs["key"], segs["doc"], segs["row"], segs["start"] = key[new], ids[doc[new]], doc[new], s[new] - edges[doc[new]]
                segs["size"], segs["windows"] = (end - s)[new], (e - s)[new] + 1
                bucket = (segs["key"] >> U64(64 - bits)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                segs, new, bucket = segs[by], new[by], bucket[by]
                size = segs["size"].astype(np.int64)
                total = np.cumsum(size)
                flat = data[np.arange(total[-1]) + np.repeat(s[new] - total + size, size)]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    yield (int(bucket[a]), SEGMENTS, name, segs[a:b].tobytes(), _squeeze(flat[total[a] - size[a] : total[b - 1]].tobytes()), b"", b"", None)
        carry = _unpacked(t["carry"])
        rest = np.flatnonzero(touched)
        whole = np.flatnonzero(~touched)
        if len(rest):
            at = np.repeat(touched, np.diff(edges))
            sizes = np.diff(edges)[rest]
            row_of = np.zeros(len(ids), np.int32)
            row_of[rest] = np.arange(len(rest))
            yield (home, TEXTS, name, _squeeze(data[at].tobytes()), np.concatenate([[0], np.cumsum(sizes)]).tobytes(), ids[rest].tobytes(), named[rest].tobytes() + rest.astype(np.int32).tobytes(), _packed(carry.take(pa.array(rest))))
            if len(marks):
                yield (home, MARKS, name, marks.tobytes(), b"", b"", b"", None)
        if len(whole):
            at = np.repeat(~touched, np.diff(edges))
            sizes = np.diff(edges)[whole]
            yield (home, DONE, name, _squeeze(data[at].tobytes()), np.concatenate([[0], np.cumsum(sizes)]).tobytes(), ids[whole].tobytes(), named[whole].tobytes() + copy[whole].tobytes(), _packed(carry.take(pa.array(whole))))

    return run


def common_classes(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each whether it shares `length` bytes with the one before.

    The text is a circle that ends in a separator. Its rotations are sorted by their first bytes;
    the Burrows-Wheeler transform is what stands before each. Starting from the interval of all
    rotations, an interval is extended backwards by every byte in it; where the end of a new
    interval was no boundary so far, its common prefix is the current length, and the interval is
    kept for the next. After `length` levels, what is no boundary shares at least `length` bytes.
    """
    n = len(text)
    turn = np.concatenate([text, text[np.arange(8) % n]]).astype(U64)
    key = np.zeros(n, U64)
    for k in range(8):
        key = key << U64(8) | turn[k : k + n]
    width = 8
    while True:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        rank = np.empty(n, U64)
        rank[order] = np.cumsum(new).astype(U64)
        if width >= length or new.all():
            break
        key = rank << U64(32) | np.roll(rank, -width)
        width *= 2
    before = text[order - 1]
    back = np.argsort(before, kind="stable")  # back[j]: which place of the transform steps to j
    step = np.empty(n, np.int64)
    step[back] = np.arange(n)
    letters = before[back]
    begins = np.concatenate([[True], letters[1:] != letters[:-1], [True]])
    boundary = np.zeros(n + 1, bool)
    boundary[0] = boundary[n] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n - 1)
    for _ in range(length):
        size = hi - lo + 1
        total = np.cumsum(size)
        at = np.arange(total[-1]) + np.repeat(lo - total + size, size)
        to = step[at]
        low, high = np.repeat(lo, size), np.repeat(hi, size)
        first = begins[to] | (back[to - 1] < low)
        last = begins[to + 1] | (back[np.minimum(to + 1, n - 1)] > high)
        lo, hi = np.sort(to[first]), np.sort(to[last])
        new = ~boundary[hi + 1]
        lo, hi = lo[new], hi[new]
        if not len(lo):
            break
        boundary[hi + 1] = True
    return order, ~boundary[:n]


def _compare(bits: int):
    """Each bucket's segments: marks of all strings but the first of each kind, to their chunks."""

    def run(batches):
        parts, texts, owners = [], [], []
        for b in batches:
            kind = b.column("kind").to_numpy()
            passing = np.flatnonzero(kind != SEGMENTS)
            if len(passing):
                yield b.take(pa.array(passing))
            for i in np.flatnonzero(kind == SEGMENTS).tolist():
                parts.append(np.frombuffer(b.column("p")[i].as_buffer(), SEGMENT))
                texts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(b.column("q")[i].as_buffer()), np.uint8))
                owners.append(b.column("chunk")[i].as_py())
        if not parts:
            return
        segs, data = np.concatenate(parts), np.concatenate(texts)
        chunk = np.repeat(np.array(owners, np.int64), [len(p) for p in parts])
        del parts, texts
        size = segs["size"].astype(np.int64)
        begin = np.cumsum(size) - size
        one, two = (np.concatenate(list(_hashed(data, begin, size, odd))) for odd in (_P, _Q))
        order = np.lexsort((segs["start"], segs["row"], chunk, segs["doc"], two, one, segs["key"]))
        k, x, y = segs["key"][order], one[order], two[order]
        same_key = np.concatenate([[False], k[1:] == k[:-1]])
        same = same_key & np.concatenate([[False], (x[1:] == x[:-1]) & (y[1:] == y[:-1])])
        seg, start, end = [order[same]], [np.zeros(same.sum(), np.int64)], [segs["windows"][order[same]].astype(np.int64)]
        distinct = order[~same]
        key = segs["key"][distinct]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        many = np.bincount(np.cumsum(first) - 1)
        differ = distinct[np.repeat(many > 1, many)]
        edges = np.flatnonzero(np.concatenate([[True], segs["key"][differ][1:] != segs["key"][differ][:-1], [True]])) if len(differ) else np.zeros(1, np.int64)
        filled = np.concatenate([[0], np.cumsum(size[differ] + 1)])
        lo = 0
        while lo < len(edges) - 1:  # whole minimisers up to some size have an index of their own
            hi = max(lo + 1, int(np.searchsorted(filled[edges], filled[edges[lo]] + INDEX_BYTES, "right")) - 1)
            s, a, e = _indexed(segs, chunk, data, begin, differ[edges[lo] : edges[hi]])
            seg.append(s)
            start.append(a)
            end.append(e)
            lo = hi
        _POWERS.clear()
        seg, start, end = np.concatenate(seg), np.concatenate(start), np.concatenate(end)
        by = np.argsort(chunk[seg], kind="stable")
        seg, start, end = seg[by], start[by], end[by]
        marks = np.zeros(len(seg), MARK)
        marks["row"], marks["start"], marks["end"] = segs["row"][seg], segs["start"][seg] + start, segs["start"][seg] + end
        own = chunk[seg]
        cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else []
        for a, e in zip(cut[:-1], cut[1:], strict=True):
            yield _arrow([(0, MARKS, int(own[a]), marks[a:e].tobytes(), b"", b"", b"", None)])

    return run


def _hashed(data, begin, size, odd, block: int = 1 << 19):
    """Hashes of parts that lie one after the other, a block of text at a time."""
    lo = 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(begin + size, begin[lo] + block, "right")))
        part = Hashes(data[begin[lo] : begin[hi - 1] + size[hi - 1]], odd)
        yield part.of(begin[lo:hi] - begin[lo], begin[lo:hi] + size[lo:hi] - begin[lo])
        lo = hi
    if not len(begin):
        yield np.zeros(0, U64)


def _indexed(segs, chunk, data, begin, which):
    """Strings of the segments `which` that occur earlier in them: segment, first place, end."""
    size = segs["size"][which].astype(np.int64)
    at = np.cumsum(size + 1) - size - 1
    text = np.full(int((size + 1).sum()), SEPARATOR, np.uint8)
    inside = np.arange(size.sum()) + np.repeat(at - (np.cumsum(size) - size), size)
    text[inside] = data[np.arange(size.sum()) + np.repeat(begin[which] - (np.cumsum(size) - size), size)]
    order, joined = common_classes(text)
    owner = np.repeat(np.arange(len(which)), size + 1)
    string = (np.arange(len(text)) - at[owner] < segs["windows"][which][owner])[order]
    kind = np.cumsum(~joined)
    order, kind = order[string], kind[string]
    own = which[owner[order]]
    place = segs["start"][own] + order - at[owner[order]]
    by = np.lexsort((place, segs["row"][own], chunk[own], segs["doc"][own], kind))
    again = by[1:][kind[by][1:] == kind[by][:-1]] if len(by) else by
    got = np.sort(order[again])
    if not len(got):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.flatnonzero(np.concatenate([[True], (got[1:] != got[:-1] + 1) | (owner[got][1:] != owner[got][:-1]), [True]]))
    s, e = got[edge[:-1]], got[edge[1:] - 1] + 1
    return which[owner[s]], s - at[owner[s]], e - at[owner[s]]


OUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "carry"]


def _finish(as_text: bool):
    """Marked bytes removed, document by document; as_text: what is left as text, else as bytes."""

    def run(batches):
        for row, named, spans in _spans(batches):
            yield from _written(row, named, spans, as_text)

    return run


def _spans(batches):
    """Documents of a chunk with their maximal marked runs."""
    state: dict[int, dict[int, list]] = {}
    for b in batches:
        kind = b.column("kind").to_numpy()
        for i in np.flatnonzero(kind == DONE).tolist():
            row = b.slice(i, 1).to_pylist()[0]
            n = len(row["r"]) // 8
            copy = np.frombuffer(row["s"][n:], bool)
            yield row, row["s"][:n], [[(0, int(z))] if c else [] for c, z in zip(copy, np.diff(np.frombuffer(row["q"], np.int64)), strict=True)]
        for row in b.take(pa.array(np.flatnonzero(kind != DONE))).to_pylist():
            state.setdefault(row["chunk"], {}).setdefault(row["kind"], []).append(row)
    while state:
        _, rows = state.popitem()
        (t,) = rows[TEXTS]
        n = len(t["r"]) // 8
        row_of = np.frombuffer(t["s"][n:], np.int32)
        m = np.concatenate([np.frombuffer(r["p"], MARK) for r in rows.get(MARKS, [])] or [np.zeros(0, MARK)])
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        if len(m):
            m = m[np.lexsort((m["start"], m["row"]))]
            row, lo, hi = m["row"].astype(np.int64), m["start"].astype(np.int64), m["end"].astype(np.int64) - 1 + LENGTH
            base = row << 33
            top = np.maximum.accumulate(base + hi)
            new = np.concatenate([[True], (base + lo)[1:] > top[:-1]])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(m)) - 1
            for r, a, z in zip(np.searchsorted(row_of, row[first]).tolist(), lo[first].tolist(), (top[last] - base[last]).tolist(), strict=True):
                spans[r].append((a, z))
        yield t, t["s"][:n], spans


def _written(row, named, spans, as_text: bool):
    data = zstandard.ZstdDecompressor().decompress(row["p"])
    edges, ids = np.frombuffer(row["q"], np.int64).tolist(), np.frombuffer(row["r"], np.int64).tolist()
    out: list[tuple] = []
    for i, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
        at, kept = s, []
        for a, z in spans[i]:
            kept.append(data[at : s + a])
            at = s + z
        whole = b"".join([*kept, data[at:e]])
        out.append((ids[i] if named[i] else None, e - s, e - s - len(whole), len(spans[i]), hashlib.sha256(whole).hexdigest(), whole.decode("utf-8", "ignore") if as_text else whole))
    kinds = (*[pa.int64()] * 4, pa.string(), pa.string() if as_text else pa.binary())
    yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)), _unpacked(row["carry"])], OUT)


def remove_repeats(docs: DataFrame, as_text: bool = False, carry: bool = False) -> DataFrame:
    """Each document without the bytes of strings of 100 bytes that also start earlier.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the
    remaining bytes; as_text: the text they are, without characters of which only some are left) and
    carry (a struct of the other columns as they are, if asked for, else null). Earlier is a smaller
    doc_id, or an earlier start in the same document; null ids come first, and of rows with the same
    id one comes first. A null text is empty; an empty table gives no rows; a text of any length is
    compared whole, by one task.
    """
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    many = max(2 * partitions(docs.sparkSession), size // TASK_BYTES)  # a task holds all that its bucket or chunk has
    bits = max(8, (2 * many - 1).bit_length())
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.struct(*others) if others else F.lit(None).cast("string")).alias("carry"))
    kinds = (*[T.LongType()] * 4, T.StringType(), T.StringType() if as_text else T.BinaryType(), rows.schema["carry"].dataType)
    schema = T.StructType([T.StructField(c, k) for c, k in zip(OUT, kinds, strict=True)])
    out = rows.mapInArrow(freeing(_print(bits)), ROW)
    out = out.repartition(many, "bucket").mapInArrow(freeing(_match_prints), ROW)
    out = out.repartition(many, "chunk").mapInArrow(freeing(_segment(bits)), ROW)
    out = out.repartition(many, "bucket").mapInArrow(freeing(_compare(bits)), ROW)
    return out.repartition(many, "chunk").mapInArrow(freeing(_finish(as_text)), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the same columns, their texts without repeats (see remove_repeats).

    Other columns are carried as they are. A character of which only some bytes are removed goes; a
    null text becomes empty; n_chars, if there, is set anew.
    """
    rows = remove_repeats(docs, as_text=True, carry=True)
    cols = {c: F.col("carry").getField(c) for c in docs.columns} | {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("kept").cast("long")
    return rows.select(*(cols[c].alias(c) for c in docs.columns))
