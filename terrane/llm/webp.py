"""Lossless WebP (VP8L) for batches of images: numpy works on all images of a batch in step.

The decoder is general: prefix codes, back-references, colour cache, several code groups, and the
inverse predictor, cross-colour, subtract-green and palette transforms. A header is read by a
generator that asks for entropy-coded images; the askings of all images are answered together.
The encoder writes what the decoder reads, choosing transforms by the entropy they leave.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: order of the code length codes, and the near distances (x, y).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH = np.uint32(0x1E35A7BD)
PREDICT, CROSS, GREEN, PALETTE = range(4)
ALPHABETS = (280, 256, 256, 256, 40)
OPAQUE = np.uint32(0xFF000000)
U32, U64 = np.uint32, np.uint64

# ---------------------------------------------------------------- decoding


class Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        v = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7)
        self.at += n
        return v & ((1 << n) - 1)


@dataclass
class Entropy:
    """An entropy-coded image to decode: its codes (five arrays of lengths a group) and size."""

    bits: Bits
    width: int
    count: int
    cache_bits: int
    groups: list[list[np.ndarray]]
    block_bits: int = 0
    block_groups: np.ndarray | None = None
    pixels: np.ndarray = field(default_factory=lambda: np.zeros(0, U32))


@functools.lru_cache(maxsize=256)
def _length_table(count: int, packed: int) -> tuple[list[tuple[int, int]], int]:
    """(symbol, length) for each value of as many bits as the longest code of a code length code
    has, whose first `count` lengths are given, 3 bits each."""
    lengths = [0] * 19
    for k, i in enumerate(LENGTH_ORDER[:count]):
        lengths[i] = packed >> 3 * k & 7
    most = max(lengths)
    table: list[tuple[int, int]] = [(0, 0)] * (1 << most)
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return [(used[0][1], 0)] * (1 << most), most
    code = 0
    for n in range(1, most + 1):
        for s in [s for k, s in used if k == n]:
            low = int(f"{code:0{n}b}"[::-1], 2)
            for v in range(low, 1 << most, 1 << n):
                table[v] = (s, n)
            code += 1
        code <<= 1
    return table, most


def _code_lengths(bits: Bits, alphabet: int) -> np.ndarray:
    """The lengths of one prefix code. A code of one symbol has length 0 for it, marked -1."""
    out = np.zeros(alphabet, np.int8)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        out[bits.read(8 if wide else 1)] = 1 if two else -1
        if two:
            out[bits.read(8)] = 1
        return out
    count = 4 + bits.read(4)
    low = bits.read(min(count, 15) * 3)
    table, most = _length_table(count, low | bits.read(3 * (count - 15)) << 45 if count > 15 else low)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    data, at, mask, i, before = bits.data, bits.at, (1 << most) - 1, 0, 8
    while i < alphabet and left:
        left -= 1
        v = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
        symbol, n = table[v & mask]
        at += n
        if symbol < 16:
            out[i] = symbol
            i += 1
            before = symbol or before
            continue
        v >>= n
        extra, first, value = ((2, 3, before), (3, 3, 0), (7, 11, 0))[symbol - 16]
        many = first + (v & ((1 << extra) - 1))
        at += extra
        if value:
            out[i : i + many] = value
        i += many
    bits.at = at
    if np.count_nonzero(out) == 1:
        out[out != 0] = -1
    return out


def _entropy(bits: Bits, width: int, height: int, main: bool):
    """A generator: reads the header of an entropy-coded image and asks for its pixels."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    block_bits, block_groups, groups = 0, None, 1
    if main and bits.read(1):
        block_bits = bits.read(3) + 2
        sizes = (width + (1 << block_bits) - 1) >> block_bits, (height + (1 << block_bits) - 1) >> block_bits
        image = yield from _entropy(bits, *sizes, False)
        block_groups = (image >> U32(8)) & U32(0xFFFF)
        groups = int(block_groups.max()) + 1
    alphabets = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    codes = [[_code_lengths(bits, a) for a in alphabets] for _ in range(groups)]
    pixels = yield Entropy(bits, width, width * height, cache_bits, codes, block_bits, block_groups)
    return pixels


@dataclass
class Image:
    width: int
    height: int
    transforms: list[tuple]
    pixels: np.ndarray  # of the last transform's output, then of the image
    coded_width: int
    cache_bits: int = 0


def _image(data: bytes):
    """A generator: reads one VP8L stream, asking for entropy-coded images, and returns Image."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless WebP stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICT, CROSS):
            size = bits.read(3) + 2
            image = yield from _entropy(bits, (coded + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size, False)
            transforms.append((kind, coded, size, image))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = yield from _entropy(bits, n, 1, False)
            table = np.cumsum(steps.view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8).view(U32).ravel()
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, coded, packed, table))
            coded = (coded + (1 << packed) - 1) >> packed
        else:
            transforms.append((kind, coded))
    at = Bits(data, bits.at)
    cache_bits = at.read(4) if at.read(1) else 0
    pixels = yield from _entropy(bits, coded, height, True)
    return Image(width, height, transforms, pixels, coded, cache_bits)


def _tables(asked: list[Entropy]) -> tuple[np.ndarray, int, np.ndarray]:
    """Look-up tables of all codes, [group, code, bits] -> symbol << 4 | length; bits; first group."""
    codes = [c for e in asked for g in e.groups for c in g]
    most = max(1, max(int(c.max()) for c in codes))
    which = np.repeat(np.arange(len(codes)), [np.count_nonzero(c) for c in codes])
    symbol = np.concatenate([np.flatnonzero(c) for c in codes])
    length = np.concatenate([c[c != 0] for c in codes]).astype(np.int64)
    order = np.lexsort((symbol, length, which))
    which, symbol, length = which[order], symbol[order], length[order]
    span = np.where(length > 0, np.int64(1) << (most - np.maximum(length, 0)), np.int64(1) << most)
    end = np.bincount(which, span, minlength=len(codes))
    if (end != 1 << most).any():
        raise ValueError("a prefix code isn't complete")
    # Spans in the order of codes give a table by the bits read first to last; then turn the bits round.
    flat = np.repeat((symbol << 4 | np.maximum(length, 0)).astype(np.uint16), span).reshape(len(codes), 1 << most)
    index = np.arange(1 << most)
    turned = np.zeros_like(index)
    for b in range(most):
        turned |= (index >> b & 1) << (most - 1 - b)
    return flat[:, turned].ravel(), most, np.cumsum([0, *[len(e.groups) for e in asked]])[:-1]


def _extra(prefix: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of a length or distance prefix with its extra bits, and how many these are."""
    n = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    value = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << n) + (bits & ((np.int64(1) << n) - 1)) + 1
    return value, n


def _decode_pixels(asked: list[Entropy], table_bytes: int = 96 << 20) -> None:
    """Sets the pixels of all asked images and moves their readers on: a pixel of each per step."""
    most = max(int(c.max()) for e in asked for g in e.groups for c in g)
    size = 10 << max(1, most)
    todo, room = sorted(asked, key=lambda e: -e.count), table_bytes
    batch: list[Entropy] = []
    for e in todo:
        room -= size * len(e.groups)
        if batch and room < 0:
            _decode_batch(batch)
            batch, room = [], table_bytes - size * len(e.groups)
        batch.append(e)
    _decode_batch(batch)


def _decode_batch(todo: list[Entropy]) -> None:
    table, most, first_group = _tables(todo)
    size = np.int64(1 << most)
    mask = U64((1 << most) - 1)
    offsets = np.cumsum([0, *[len(e.bits.data) + 16 for e in todo]])
    data = np.frombuffer(b"".join(e.bits.data + bytes(16) for e in todo), np.uint8)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    at = np.array([o * 8 + e.bits.at for o, e in zip(offsets, todo, strict=False)], np.int64)
    count = np.array([e.count for e in todo])
    base = np.cumsum([0, *count])[:-1]
    out = np.zeros(int(count.sum()), U32)
    group = first_group * 5 * size
    cache_bits = np.array([e.cache_bits for e in todo], U32)
    cached = bool(cache_bits.any())
    cache_base = np.cumsum([0, *(1 << cache_bits.astype(np.int64))])[:-1]
    cache = np.zeros(int((1 << cache_bits.astype(np.int64)).sum()), U32)
    left, far = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
    several = any(e.block_groups is not None for e in todo)
    copies = False

    def peek(where: np.ndarray) -> np.ndarray:
        return words[where >> 3] >> (where & 7).astype(U64)

    active = np.searchsorted(-count, -np.arange(1, int(count[0]) + 1), "right") if len(count) else []
    for i in range(int(count[0])):
        n = active[i]
        own = base[:n] + i
        if several:
            group = first_group * 5 * size
            for k, e in enumerate(todo[:n]):
                if e.block_groups is not None:
                    y, x = divmod(i, e.width)
                    wide = (e.width + (1 << e.block_bits) - 1) >> e.block_bits
                    group[k] += int(e.block_groups[(y >> e.block_bits) * wide + (x >> e.block_bits)]) * 5 * size
        g0 = group[:n]
        w = peek(at[:n])
        t = table[g0 + (w & mask).astype(np.int64)]
        symbol, used = t >> 4, t & 15
        moved = used.astype(np.int64)
        w >>= used.astype(U64)
        pixel = symbol.astype(U32) << U32(8)
        for code, shift in ((1, 16), (2, 0), (3, 24)):
            if code == 3 and most > 14:
                w = peek(at[:n] + moved)
            t = table[g0 + code * size + (w & mask).astype(np.int64)]
            used = t & 15
            w >>= used.astype(U64)
            moved += used
            pixel |= (t >> 4).astype(U32) << U32(shift)
        odd = symbol >= 256
        if copies:
            odd |= left[:n] > 0
        k = np.flatnonzero(odd)
        if len(k):
            s = symbol[k].astype(np.int64)
            moved[k] = table[g0[k] + (peek(at[k]) & mask).astype(np.int64)] & 15
            copying = left[k] > 0
            moved[k[copying]] = 0
            hit = k[(s >= 280) & ~copying]
            if len(hit):
                pixel[hit] = cache[cache_base[hit] + symbol[hit] - 280]
            new = k[(s >= 256) & (s < 280) & ~copying]
            if len(new):
                copies = True
                p = at[new] + moved[new]
                left[new], bits = _extra(symbol[new].astype(np.int64) - 256, peek(p).astype(np.int64))
                p += bits
                t = table[g0[new] + 4 * size + (peek(p) & mask).astype(np.int64)]
                p += t & 15
                code, bits = _extra((t >> 4).astype(np.int64), peek(p).astype(np.int64))
                moved[new] = p + bits - at[new]
                near = np.array([x + y * todo[j].width for j, c in zip(new.tolist(), code.tolist(), strict=True) for x, y in [NEAR[c - 1] if c <= len(NEAR) else (c - len(NEAR), 0)]])
                far[new] = np.maximum(1, near)
            ref = k[left[k] > 0]
            if len(ref):
                pixel[ref] = out[base[ref] + i - far[ref]]
                left[ref] -= 1
        at[:n] += moved
        out[own] = pixel
        if cached:
            key = np.where(cache_bits[:n] > 0, (pixel * HASH) >> (U32(32) - cache_bits[:n] & U32(31)), 0)
            cache[cache_base[:n] + key] = pixel
    for e, b, a, o in zip(todo, base, at, offsets, strict=False):
        e.pixels, e.bits.at = out[b : b + e.count], int(a - o * 8)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.int16) + b) >> 1).astype(np.uint8)


def _predicted(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What a predictor mode gives for pixels (rows of four bytes) from their neighbours."""
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode in (6, 7):
        return _average(left, (corner, top)[mode - 6])
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    lo, to, co = (x.astype(np.int16) for x in (left, top, corner))
    if mode == 11:
        nearer_left = np.abs(to - co).sum(1) < np.abs(lo - co).sum(1)
        return np.where(nearer_left[:, None], left, top)
    if mode == 12:
        return np.clip(lo + to - co, 0, 255).astype(np.uint8)
    if mode == 13:
        mean = (lo + to) >> 1
        return np.clip(mean + ((mean - co) / 2).astype(np.int16), 0, 255).astype(np.uint8)
    out = np.zeros_like(left)
    out[:, 3] = 255
    return out


def _unpredict(images: list[Image], steps: list[tuple]) -> None:
    """Adds the predictions back: a pixel of each image per step."""
    count = np.array([len(im.pixels) for im in images])
    base = np.cumsum([0, *count])[:-1]
    px = np.concatenate([im.pixels for im in images]).view(np.uint8).reshape(-1, 4).copy()
    width = np.array([s[1] for s in steps])
    for i in range(int(count.max())):
        k = np.flatnonzero(count > i)
        x, y = i % width[k], i // width[k]
        mode = np.array([int(s[3][(b >> s[2]) * ((s[1] + (1 << s[2]) - 1) >> s[2]) + (a >> s[2])] >> U32(8)) & 15 for s, a, b in zip([steps[j] for j in k], x.tolist(), y.tolist(), strict=True)])
        mode = np.where(y == 0, np.where(x == 0, 0, 1), np.where(x == 0, 2, mode))
        at, w = base[k] + i, width[k]

        def near(d: np.ndarray, at: np.ndarray = at) -> np.ndarray:
            return px[np.maximum(at - d, 0)]

        for m in np.unique(mode):
            j = mode == m
            px[at[j]] += _predicted(int(m), near(np.ones_like(w))[j], near(w)[j], near(w + 1)[j], near(w - 1)[j])
    flat = px.view(U32).ravel()
    for im, b in zip(images, base, strict=True):
        im.pixels = flat[b : b + len(im.pixels)]


def _blockwise(step: tuple, count: int) -> np.ndarray:
    _, width, size, image = step
    i = np.arange(count)
    return image[(i // width >> size) * ((width + (1 << size) - 1) >> size) + (i % width >> size)]


def _signed(x: np.ndarray, shift: int) -> np.ndarray:
    return (x >> U32(shift) & U32(255)).astype(np.uint8).view(np.int8).astype(np.int32)


def _cross(pixels: np.ndarray, elements: np.ndarray, sign: int) -> np.ndarray:
    """Cross-colour taken off (sign -1) or put back (sign 1)."""
    green = _signed(pixels, 8)
    red = (pixels >> U32(16) & U32(255)).astype(np.int32)
    blue = (pixels & U32(255)).astype(np.int32)
    new_red = (red + sign * (_signed(elements, 0) * green >> 5)) & 255
    whole = new_red if sign > 0 else red
    seen = whole.astype(np.uint8).view(np.int8).astype(np.int32)
    new_blue = (blue + sign * ((_signed(elements, 8) * green >> 5) + (_signed(elements, 16) * seen >> 5))) & 255
    return pixels & U32(0xFF00FF00) | new_red.astype(U32) << U32(16) | new_blue.astype(U32)


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    g = (pixels >> U32(8)) & U32(255)
    g = g if sign > 0 else U32(256) - g
    red, blue = (pixels >> U32(16)) + g & U32(255), pixels + g & U32(255)
    return pixels & U32(0xFF00FF00) | red << U32(16) | blue


def _unpalette(step: tuple, pixels: np.ndarray) -> np.ndarray:
    _, width, packed, table = step
    whole = np.zeros(256, U32)
    whole[: len(table)] = table
    index = (pixels >> U32(8)) & U32(255)
    if packed:
        bits = 8 >> packed
        index = (index[:, None] >> (np.arange(1 << packed, dtype=U32) * U32(bits))) & U32((1 << bits) - 1)
        index = index.reshape(-1, ((width + (1 << packed) - 1) >> packed) << packed)[:, :width].ravel()
    return whole[index]


def decode_streams(streams: list[bytes]) -> list[Image]:
    """The images of VP8L streams, decoded together."""
    readers = [_image(s) for s in streams]
    images: list[Image | None] = [None] * len(streams)
    asked = {i: next(r) for i, r in enumerate(readers)}
    while asked:
        _decode_pixels(list(asked.values()))
        later = {}
        for i, e in asked.items():
            try:
                later[i] = readers[i].send(e.pixels)
            except StopIteration as end:
                images[i] = end.value
        asked = later
    pending = [(im, list(im.transforms)) for im in images]
    while any(t for _, t in pending):
        ready = [(im, t.pop()) for im, t in pending if t]
        predicted = [(im, s) for im, s in ready if s[0] == PREDICT]
        if predicted:
            _unpredict([im for im, _ in predicted], [s for _, s in predicted])
        for im, s in ready:
            if s[0] == CROSS:
                im.pixels = _cross(im.pixels, _blockwise(s, len(im.pixels)), 1)
            elif s[0] == GREEN:
                im.pixels = _green(im.pixels, 1)
            elif s[0] == PALETTE:
                im.pixels = _unpalette(s, im.pixels)
    return images


# ---------------------------------------------------------------- encoding

LONGEST = 10
#: Lengths of the code that code lengths are written in, the same for all images; its sum is 1.
LENGTH_CODE = {0: 3, 5: 3, 6: 3, 7: 3, 8: 3, 4: 4, 9: 4, 17: 4, 18: 4, 3: 5, 10: 5, 2: 5, 1: 5}


class Items:
    """Values of some bits each, of many images; written in order of image, phase and rank."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, image, phase, rank, value, bits) -> None:
        image = np.atleast_1d(image)
        shape = image.shape
        self.parts.append(tuple(np.broadcast_to(np.asarray(x), shape) for x in (image, phase, rank, value, bits)))

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        image, phase, rank, value, bits = (np.concatenate([p[i] for p in self.parts]) for i in range(5))
        order = np.argsort((image.astype(np.int64) << 44) | (phase.astype(np.int64) << 36) | rank.astype(np.int64), kind="stable")
        return image[order], value.astype(U64)[order], bits.astype(np.int64)[order]


def _lengths(counts: np.ndarray) -> np.ndarray:
    """Code lengths, LONGEST at most, for rows of counts; complete wherever two symbols are used."""
    used = counts > 0
    many = used.sum(1)
    p = counts / np.maximum(1, counts.sum(1, keepdims=True))
    p = p * (1 - many[:, None] * 2.0**-LONGEST) + 2.0**-LONGEST
    n = np.where(used, np.clip(np.ceil(-np.log2(p)), 1, LONGEST), 0).astype(np.int64)
    rows = np.flatnonzero(many > 1)
    while len(rows):  # give what is left of the code space to the most frequent of each length
        own, c = n[rows], counts[rows]
        left = (1 << LONGEST) - np.where(own > 0, np.int64(1) << (LONGEST - own), 0).sum(1)
        for length in range(2, LONGEST + 1):
            here = own == length
            fit = np.minimum(here.sum(1), left >> (LONGEST - length))
            some = np.flatnonzero(fit)
            if len(some):
                order = np.argsort(np.where(here[some], -c[some], 1), 1, kind="stable")
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
                own[some] -= here[some] & (rank < fit[some, None])
                left[some] -= fit[some] << (LONGEST - length)
        n[rows] = own
        rows = rows[left > 0]
    return n


_TURNED = np.array([int(f"{i:0{LONGEST}b}"[::-1], 2) for i in range(1 << LONGEST)])


def _codes(n: np.ndarray) -> np.ndarray:
    """Canonical codes, first bit lowest, of rows of lengths."""
    order = np.argsort(np.where(n > 0, n, 99), 1, kind="stable")
    sorted_n = np.take_along_axis(n, order, 1)
    span = np.where(sorted_n > 0, np.int64(1) << (LONGEST - sorted_n), 0)
    start = np.cumsum(span, 1) - span
    code = np.where(sorted_n > 0, start >> (LONGEST - sorted_n), 0)
    out = np.zeros_like(n)
    np.put_along_axis(out, order, _TURNED[code] >> (LONGEST - sorted_n), 1)
    return out


def _write_code(items: Items, phase: int, counts: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds the header of one code of each live image; the lengths and codes to write symbols in."""
    n_images, alphabet = counts.shape
    used = counts > 0
    lone = used.sum(1) <= 1
    symbol = used.argmax(1)
    wide = lone & (symbol >= 256)
    counts = counts.copy()
    counts[wide, 0] = 1
    lone &= ~wide
    n = _lengths(counts)
    n[lone] = 0
    codes = _codes(n)
    one = np.flatnonzero(lone & live)
    items.add(one, phase, 0, 1 | 0 << 1 | 1 << 2 | symbol[one] << 3, 11)
    full = np.flatnonzero(~lone & live)
    if len(full):
        head, shift = 15 << 1, 5
        for k in LENGTH_ORDER:
            head |= LENGTH_CODE.get(k, 0) << shift
            shift += 3
        items.add(full, phase, 0, head & (1 << 31) - 1, 31)
        items.add(full, phase, 1, head >> 31, shift - 31 + 1)  # and a 0: all lengths follow
        own_n = np.zeros((1, 19), np.int64)
        for k, v in LENGTH_CODE.items():
            own_n[0, k] = v
        own_code, own_n = _codes(own_n)[0], own_n[0]
        m = n[full]
        r, c = np.nonzero(m)
        items.add(full[r], phase, 2 + c * 16, own_code[m[r, c]], own_n[m[r, c]])
        zero = np.zeros((len(full), alphabet + 2), bool)
        zero[:, 1:-1] = m == 0
        r, c = np.nonzero(zero[:, 1:] & ~zero[:, :-1])
        ends = np.nonzero(zero[:, :-1] & ~zero[:, 1:])[1]
        run = ends - c
        for k in range(alphabet // 138 + 1):  # the k-th repeat of each run
            rest = run - 138 * k
            for good, sym, least, bits in ((rest >= 11, 18, 11, 7), ((rest >= 3) & (rest < 11), 17, 3, 3)):
                j = np.flatnonzero(good)
                items.add(full[r[j]], phase, 2 + c[j] * 16 + k, own_code[sym] | (np.minimum(rest[j], 138) - least) << own_n[sym], own_n[sym] + bits)
            for single in (1, 2):
                j = np.flatnonzero((rest > 0) & (rest < 3) & (rest >= single))
                items.add(full[r[j]], phase, 2 + c[j] * 16 + k + single * 0, own_code[0], own_n[0])
    return n, codes


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits' value and number for lengths and distance codes."""
    v = value - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    n = np.where(v < 4, 0, top - 1)
    symbol = np.where(v < 4, v, 2 * top + (v >> np.maximum(top - 1, 0) & 1))
    return symbol, np.where(v < 4, 0, v & ((np.int64(1) << n) - 1)), n


def _write_image(items: Items, phase: int, pixels: list[np.ndarray], cache_bits: np.ndarray, main: bool) -> None:
    """Adds entropy-coded images with back-references and colour cache; no pixels: none is written."""
    count = np.array([len(p) for p in pixels])
    live = count > 0
    px = np.concatenate(pixels)
    which = np.repeat(np.arange(len(count)), count)
    base = np.cumsum(count) - count
    place = np.arange(len(px)) - base[which]
    total = len(px)
    kept = np.ones(total, bool)  # begins a token
    length = np.zeros(total, np.int64)
    step = np.zeros(total, np.int64)
    if total > 3:
        ok = np.zeros(total, bool)
        ok[:-2] = which[:-2] == which[2:]
        i = np.flatnonzero(ok)
        key = (px[i].astype(U64) * U64(0x9E3779B97F4A7C15) ^ px[i + 1].astype(U64) * U64(0xC2B2AE3D27D4EB4F) ^ px[i + 2].astype(U64) * U64(0x165667B19E3779F9)) + which[i].astype(U64) * U64(0xD6E8FEB86659FD93)
        by = np.argsort(key, kind="stable")
        a, b = i[by[:-1]], i[by[1:]]
        same = (which[a] == which[b]) & (px[a] == px[b]) & (px[a + 1] == px[b + 1]) & (px[a + 2] == px[b + 2])
        back = np.zeros(total + 1, np.int64)
        back[b[same]] = (b - a)[same]
        starts = np.flatnonzero((back[:-1] > 0) & (np.concatenate([[0], back[:-2]]) != back[:-1]))
        if len(starts):
            edge = np.flatnonzero(back[:-1] != back[1:])  # the last place of each run
            ends = edge[np.searchsorted(edge, starts)] + 3
            before = np.concatenate([[0], np.maximum.accumulate(ends)[:-1]])
            begin = np.maximum(starts, before)
            good = ends - begin >= 3
            begin, ends, far = begin[good], ends[good], back[starts[good]]
            pieces = -(-(ends - begin) // 4096)
            row = np.repeat(np.arange(len(begin)), pieces)
            k = np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]
            cut = begin[row] + 4096 * k
            covered = np.zeros(total + 1, np.int64)
            np.add.at(covered, begin, 1)
            np.add.at(covered, ends, -1)
            kept = np.cumsum(covered)[:-1] == 0
            kept[cut] = True
            length[cut], step[cut] = np.minimum(ends[row] - cut, 4096), far[row]
    bits = cache_bits[which].astype(U32)
    slot = np.where(bits > 0, (px * HASH) >> (U32(32) - bits & U32(31)), 0).astype(np.int64)
    by = np.argsort(which.astype(np.int64) << 12 | slot, kind="stable")
    a, b = by[:-1], by[1:]
    hit = np.zeros(total, bool)
    hit[b] = (which[a] == which[b]) & (slot[a] == slot[b]) & (px[a] == px[b])
    hit &= (bits > 0) & (length == 0)
    t = np.flatnonzero(kept)
    own, p, n = which[t], px[t], length[t]
    ref, cached = n > 0, hit[t]
    literal = ~ref & ~cached
    len_symbol, len_extra, len_bits = _prefix(np.maximum(n, 1))
    far_symbol, far_extra, far_bits = _prefix(np.maximum(step[t] + len(NEAR), 1))
    green = np.where(ref, 256 + len_symbol, np.where(cached, 280 + slot[t], p >> U32(8) & U32(255))).astype(np.int64)
    symbols = [green, *((p >> U32(s) & U32(255)).astype(np.int64) for s in (16, 0, 24)), far_symbol]
    select = [np.ones(len(t), bool), literal, literal, literal, ref]
    images = len(count)
    alphabets = (280 + (1 << int(cache_bits.max(initial=0)) if cache_bits.any() else 0), *ALPHABETS[1:])
    value, size = np.zeros(len(t), U64), np.zeros(len(t), np.int64)

    def put(v: np.ndarray, b: np.ndarray) -> None:
        nonlocal value, size
        value |= v.astype(U64) << size.astype(U64)
        size = size + b

    every = np.flatnonzero(live)
    has = cache_bits[every] > 0
    items.add(every, phase, 0, np.where(has, 1 | cache_bits[every] << 1, 0), np.where(has, 5, 1))
    if main:
        items.add(every, phase, 1, 0, 1)
    for code, (sym, sel, alphabet) in enumerate(zip(symbols, select, alphabets, strict=True)):
        counts = np.bincount(own[sel] * alphabet + sym[sel], minlength=images * alphabet).reshape(images, alphabet)
        if code == 0 and cache_bits.any():  # alphabets differ by image: written by size
            n, codes = np.zeros(counts.shape, np.int64), np.zeros(counts.shape, np.int64)
            for c in np.unique(cache_bits[live]).tolist():
                of = 280 + (1 << c if c else 0)
                group = live & (cache_bits == c)
                some = np.flatnonzero(group)
                sub = Items()
                n[some, :of], codes[some, :of] = _write_code(sub, phase + 1, counts[some, :of], np.ones(len(some), bool))
                for part in sub.parts:
                    items.parts.append((some[part[0]], *part[1:]))
        else:
            n, codes = _write_code(items, phase + 1 + code, counts, live)
        flat = own * alphabet + np.minimum(sym, alphabet - 1)
        put(np.where(sel, codes.ravel()[flat], 0), np.where(sel, n.ravel()[flat], 0))
        if code == 0:
            put(np.where(ref, len_extra, 0), np.where(ref, len_bits, 0))
    put(np.where(ref, far_extra, 0), np.where(ref, far_bits, 0))
    items.add(own, phase + 6, place[t], value, size)


def _residuals(px: np.ndarray, count: np.ndarray, width: int, mode: int) -> np.ndarray:
    """Pixels of images, one after the other, less the prediction of mode 1 (left) or 2 (top), the
    same in every block. The first row is predicted from the left, the first column from above."""
    b = px.view(np.uint8).reshape(-1, 4)
    before = np.zeros_like(b)
    left, top = np.concatenate([before[:1], b[:-1]]), np.concatenate([before[:width], b[:-width]])[: len(b)]
    begin = np.cumsum(count) - count
    place = np.arange(len(b)) - np.repeat(begin, count)
    above = (place >= width) & ((place % width == 0) if mode == 1 else True)
    before = np.where(above[:, None], top, left)
    before[begin] = (0, 0, 0, 255)  # the first pixel's prediction is opaque black
    return (b - before).view(U32).ravel()


def _residual(px: np.ndarray, width: int, mode: int) -> np.ndarray:
    return _residuals(px, np.array([len(px)]), width, mode)


def _entropy_of(px: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits that the four channels' symbols need in each image, each channel by its own counts."""
    b = px.view(np.uint8).reshape(-1, 4)
    which = np.repeat(np.arange(len(n)) * 256, n)
    out = np.zeros(len(n))
    logs = np.log2(np.maximum(np.arange(int(n.max()) + 1), 1)) * np.arange(int(n.max()) + 1)
    for c in range(4):
        counts = np.bincount(which + b[:, c], minlength=len(n) * 256).reshape(-1, 256)
        out += logs[n] - logs[counts].sum(1)
    return out


@dataclass(frozen=True)
class Plan:
    """How to write an image: transforms in order, cross-colour multipliers, cache bits."""

    transforms: tuple[int, ...] = ()
    mode: int = 2
    cross: int = 0
    cache_bits: int = 0


def plan(images: list[np.ndarray], width: int) -> list[Plan]:
    """For each image the transform that leaves least entropy, and a cache by its size."""
    px = np.concatenate(images)
    count = np.array([len(p) for p in images])
    residual = [_residuals(px, count, width, mode) for mode in (1, 2)]
    ways = {(): px, (GREEN,): _green(px, -1), (CROSS,): _cross(px, np.full(len(px), U32(0x101008)), -1), (PREDICT, 1): residual[0], (PREDICT, 2): residual[1]}
    bits = np.array([_entropy_of(p, count) for p in ways.values()])
    bits[1:] += 64
    colours = np.array([len(np.unique(p)) if len(p) < 4096 else 9999 for p in images])
    out = []
    for i, (best, p) in enumerate(zip(bits.argmin(0), images, strict=True)):
        cache = int(np.clip(np.log2(len(p)) - 4, 0, 7))
        if colours[i] <= 256 and colours[i] * 4 <= len(p):
            out.append(Plan((PALETTE,), cache_bits=0))
            continue
        way = list(ways)[best]
        out.append(Plan(way[:1], mode=way[1] if len(way) > 1 else 2, cross=0x101008 if way == (CROSS,) else 0, cache_bits=cache))
    return out


def encode_streams(images: list[np.ndarray], width: int, plans: list[Plan] | None = None) -> list[bytes]:
    """VP8L streams of images of one width, each a flat array of pixels (uint32, ARGB)."""
    plans = plans or plan(images, width)
    items = Items()
    n = len(images)
    every = np.arange(n)
    height = np.array([len(p) // width for p in images])
    items.add(every, 0, 0, np.full(n, 0x2F | (width - 1) << 8) | (height - 1) << 22, 36)
    items.add(every, 0, 1, 1, 4)  # alpha is used; version 0
    out = [np.ascontiguousarray(p) for p in images]
    widths = np.full(n, width)
    none = np.zeros(0, U32)
    size = 9
    for slot in range(max((len(p.transforms) for p in plans), default=0)):
        phase = 1 + slot * 16
        kinds = np.array([p.transforms[slot] if slot < len(p.transforms) else -1 for p in plans])
        some = np.flatnonzero(kinds >= 0)
        items.add(some, phase, 0, 1 | kinds[some] << 1, 3)
        block = np.flatnonzero((kinds == PREDICT) | (kinds == CROSS))
        items.add(block, phase, 1, size - 2, 3)
        extra = [none] * n
        for i in block.tolist():
            p = plans[i]
            blocks = ((widths[i] + (1 << size) - 1) >> size) * ((height[i] + (1 << size) - 1) >> size)
            extra[i] = np.full(int(blocks), U32(p.mode << 8 if kinds[i] == PREDICT else p.cross) | OPAQUE)
            out[i] = _residual(out[i], int(widths[i]), p.mode) if kinds[i] == PREDICT else _cross(out[i], np.full(len(out[i]), U32(p.cross)), -1)
        for i in np.flatnonzero(kinds == GREEN).tolist():
            out[i] = _green(out[i], -1)
        for i in np.flatnonzero(kinds == PALETTE).tolist():
            table, index = np.unique(out[i], return_inverse=True)
            items.add(i, phase, 1, len(table) - 1, 8)
            b = table.view(np.uint8).reshape(-1, 4)
            extra[i] = np.concatenate([b[:1], b[1:] - b[:-1]]).view(U32).ravel()
            packed = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            index = index.reshape(-1, widths[i]).astype(U32)
            each = 1 << packed
            index = np.pad(index, ((0, 0), (0, -int(widths[i]) % each))).reshape(len(index), -1, each)
            out[i] = (index << (np.arange(each, dtype=U32) * U32(8 >> packed))).sum(2, dtype=U32).ravel() << U32(8) | OPAQUE
            widths[i] = (widths[i] + each - 1) >> packed
        if any(len(e) for e in extra):
            _write_image(items, phase + 2, extra, np.zeros(n, np.int64), False)
    items.add(every, 200, 0, 0, 1)
    _write_image(items, 201, out, np.array([p.cache_bits for p in plans]), True)
    which, value, bits = items.sorted()
    total = np.bincount(which, bits, minlength=n).astype(np.int64)
    room = (total + 63) // 64 + 1
    first = (np.cumsum(room) - room) * 64
    ends = np.cumsum(bits)
    begin = np.searchsorted(which, every)
    at = ends - bits - (ends - bits)[begin][which] + first[which]
    words = np.zeros(int(room.sum()), U64)
    word, shift = at >> 6, (at & 63).astype(U64)
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[starts]] = np.bitwise_or.reduceat(value << shift, starts)
    over = np.flatnonzero((at & 63) + bits > 64)  # one item at most runs over the end of a word
    words[word[over] + 1] |= value[over] >> (U64(64) - shift[over])
    raw = words.tobytes()
    return [raw[f // 8 : f // 8 + -(-t // 8)] for f, t in zip(first.tolist(), total.tolist(), strict=True)]


# ---------------------------------------------------------------- containers


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)


def container(frames: list[tuple[bytes, int, int]]) -> bytes:
    """A WebP file of one stream, or of several as the frames of an animation: (stream, w, h)."""
    if len(frames) == 1:
        body = _chunk(b"VP8L", frames[0][0])
    else:
        wide, high = max(f[1] for f in frames), max(f[2] for f in frames)
        body = _chunk(b"VP8X", bytes([0x12, 0, 0, 0]) + (wide - 1).to_bytes(3, "little") + (high - 1).to_bytes(3, "little"))
        body += _chunk(b"ANIM", bytes(6))
        body += b"".join(_chunk(b"ANMF", bytes(6) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little") + bytes([1, 0, 0, 2]) + _chunk(b"VP8L", s)) for s, w, h in frames)
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body


def streams_of(file: bytes) -> list[bytes]:
    """The VP8L streams of a WebP file, in order of the frames."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    out: list[bytes] = []

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = file[at : at + 4], int.from_bytes(file[at + 4 : at + 8], "little")
            if name == b"VP8L":
                out.append(file[at + 8 : at + 8 + size])
            elif name == b"ANMF":
                walk(at + 24, at + 8 + size)
            at += 8 + size + size % 2

    walk(12, min(len(file), 8 + int.from_bytes(file[4:8], "little")))
    return out
