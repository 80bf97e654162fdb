"""SentencePiece encoding and decoding with a weighted finite-state transducer.

compile() makes the parts: the normaliser (a blank before the text, blanks written U+2581), the
pieces with their ids, byte fallback for characters that no piece spells, and which pieces may
stand side by side. An input is composed with them position by position, all inputs in step, and
the shortest path in the tropical semiring (one unit per piece, more for fallback) gives the ids.

The given model is of the BPE kind, whose result isn't the path with the best sum of scores. A
sequence of pieces is what BPE makes iff that holds for each two neighbours, that is, iff no merge
across their boundary comes before the merges that made them. These pairs are the transducer's
transitions, so it accepts a single path and the weights cannot prefer another.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm.common import byte_chunks, doc_texts, mix64

BLANK = "▁"
FAR = np.iinfo(np.int64).max
BASE = np.uint64(0x100000001B3)
CACHED_WORDS = 600_000
LONG = 8192  # characters of a word from which on it is composed in blocks
BLOCK, OVERLAP = 2048, 256


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lookup:
    """64-bit keys to small integers (-1: absent), for whole arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 20):
        self.levels, self.bits = [], bits
        while len(keys):
            slot = (mix64(keys) >> np.uint64(64 - bits)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            table, held = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            table[slot[first]], held[slot[first]] = keys[first], values[first]
            self.levels.append((table, held))
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, values, bits = keys[rest], values[rest], self.bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = (mix64(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        for table, held in self.levels:
            hit = table[slot] == keys
            out = np.where(hit, held[slot], out)
        return out


def _hash(codes: list[int]) -> int:
    h = 0
    for c in codes:
        h = (h * int(BASE) + c + 1) & (1 << 64) - 1
    return h


class Transducer:
    """Pieces, their merge ranks and spines, and the look-ups that composition needs."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        """kinds: `piece`, `byte` or `control` for each id."""
        self.bytes = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        self.byte_ids = np.array([self.bytes.get(f"<0x{b:02X}>", 0) for b in range(256)], np.uint32)
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "piece"}
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        self.out = [(p.replace(BLANK, " ").encode() if k == "piece" else bytes([int(p[1:-1], 16)]) if k == "byte" else b"") for p, k in zip(pieces, kinds, strict=True)]
        self.barriers = [c for c in "\n\t\r" if c not in self.ids and not any(c in p for p in self.ids)]
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece crosses a blank: words can't be encoded on their own")
        split: dict[str, tuple[str, str]] = {}
        self.good: dict[str, int] = {}
        for p in sorted(self.ids, key=len):
            made = self.bpe(p, split if len(p) > 1 else None)
            if made == [p]:  # a piece that no merges make is never in a result
                self.good[p] = self.ids[p]
        self.longest = max(map(len, self.good), default=1)
        n, deep = len(pieces), self.longest
        self.left, self.right = np.full((n, deep), -1, np.int32), np.full((n, deep), -1, np.int32)
        self.until_left, self.until_right = np.full((n, deep), FAR), np.full((n, deep), FAR)
        for p, i in self.good.items():
            for spine, until, side in ((self.left, self.until_left, 0), (self.right, self.until_right, 1)):
                chain = [p]
                while chain[-1] in split:
                    chain.append(split[chain[-1]][side])
                chain.reverse()
                spine[i, : len(chain)] = [self.ids[c] for c in chain]
                until[i, : len(chain) - 1] = [int(self.rank[c]) for c in chain[1:]]
        keys = [(_hash([ord(c) for c in p]), i) for p, i in self.good.items()]
        self.by_text = Lookup(np.array([k for k, _ in keys], np.uint64), np.array([i for _, i in keys], np.int32))
        pairs = [(self.ids[p[:k]] << 32 | self.ids[p[k:]], int(r)) for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        self.by_pair = Lookup(np.array([k for k, _ in pairs], np.uint64), np.array([min(r, 2**31 - 1) for _, r in pairs], np.int64).astype(np.int32), 21)
        self.pairs: dict[int, bool] = {}
        self.blanks = np.zeros(n, bool)
        self.blanks[[i for p, i in self.ids.items() if not p.strip(BLANK)]] = True
        self.names = pieces

    def bpe(self, text: str, split: dict | None = None) -> list[str]:
        """Pieces by merging: the definition, for short texts. split: gets the last merge of text."""
        s = list(text)
        while len(s) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            if split is not None and len(s) == 2:
                split[text] = (s[0], s[1])
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge across comes first. -1 (fallback) is compatible with everything."""
        out = np.ones(len(a), bool)
        go = np.flatnonzero((a >= 0) & (b >= 0))
        both = go[self.blanks[a[go]] & self.blanks[b[go]]]  # pieces of blanks have equal ranks
        for i in both.tolist():
            key = int(a[i]) << 32 | int(b[i])
            if key not in self.pairs:
                x, y = self.names[a[i]], self.names[b[i]]
                self.pairs[key] = self.bpe(x + y) == [x, y]
            out[i] = self.pairs[key]
        go = go[~(self.blanks[a[go]] & self.blanks[b[go]])]
        x, y = np.zeros(len(go), np.int64), np.zeros(len(go), np.int64)
        while len(go):
            p, q = a[go], b[go]
            r = self.by_pair(self.right[p, x].astype(np.uint64) << np.uint64(32) | self.left[q, y].astype(np.uint64)).astype(np.int64)
            ux, uy = self.until_right[p, x], self.until_left[q, y]
            crossed = (r >= 0) & (r < ux) & (r <= uy)
            out[go[crossed]] = False
            on = ~crossed & ((ux < FAR) | (uy < FAR))
            step = ux <= uy
            x, y, go = (x + step)[on], (y + ~step)[on], go[on]
        return out

    def compose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Composition of all words in step, longest first: where each begins (there is one place more
        than characters), its size, and for each place the last piece up to there (-1: fallback), its
        length, and the character before."""
        size = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        total = int(size.sum() + len(size))
        at = np.arange(len(codes)) + np.repeat(np.arange(len(size)), size)
        char = np.zeros(total, np.uint64)
        char[at] = codes
        prefix = np.zeros(total, np.uint64)
        power = BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        weight = np.full(total, np.iinfo(np.int32).max, np.int32)
        last, back = np.full(total, -2, np.int32), np.zeros(total, np.int32)
        weight[start] = 0
        alone = self.by_text(char + np.uint64(1))
        for i in range(1, int(size[0]) + 1):
            own = start[: int(np.searchsorted(-size, -i, "right"))] + i  # places after i characters
            prefix[own] = prefix[own - 1] * BASE + char[own - 1] + np.uint64(1)
            for n in range(1, min(i, self.longest) + 1):
                if n == 1:
                    piece, live = alone[own - 1], np.ones(len(own), bool)
                else:
                    piece = self.by_text(prefix[own] - prefix[own - n] * power[n])
                    live = piece >= 0
                here = own[live]
                piece, before = piece[live], last[here - n]
                ok = self.compatible(np.where(i > n, before, -1), piece)
                cost = weight[here - n] + np.where(piece < 0, 1000, 1).astype(np.int32)
                ok &= cost < weight[here]
                weight[here[ok]], last[here[ok]], back[here[ok]] = cost[ok], piece[ok], n
        return start, size, last, back, char

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if any(len(w) > LONG for w in words):
            short = [i for i, w in enumerate(words) if len(w) <= LONG]
            ids, many = self.encode_words([words[i] for i in short])
            parts = dict(zip(short, np.split(ids, np.cumsum(many)[:-1]) if short else [], strict=True))
            parts |= {i: self._encode_long(w) for i, w in enumerate(words) if len(w) > LONG}
            return np.concatenate([parts[i] for i in range(len(words))]), np.array([len(parts[i]) for i in range(len(words))])
        order = np.argsort([-len(w) for w in words], kind="stable")
        start, size, last, back, char = self.compose([words[i] for i in order])
        # Backwards along the paths, all words in step.
        place, steps, row = start + size, [], np.arange(len(size))
        while len(row):
            steps.append((row, last[place], place, back[place]))
            place = place - back[place]
            on = place > start[row]
            row, place = row[on], place[on]
        rows = np.concatenate([s[0] for s in steps])
        depth = np.concatenate([np.full(len(s[0]), k) for k, s in enumerate(steps)])
        made, ends = np.concatenate([s[1] for s in steps]), np.concatenate([s[2] for s in steps])
        by = np.lexsort((-depth, order[rows]))
        ids, many = self._spelled(made[by], char[ends[by] - 1])
        return ids, np.bincount(np.repeat(order[rows[by]], many), minlength=len(words))

    def _spelled(self, made: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, those of its bytes for a character by fallback, and how many each has."""
        many = np.ones(len(made), np.int64)
        parts = {k: self.byte_ids[list(chr(int(char[k])).encode("utf-8", "replace"))] for k in np.flatnonzero(made < 0).tolist()}
        for k, raw in parts.items():
            many[k] = len(raw)
        begin = np.cumsum(many) - many
        ids = np.repeat(made, many).astype(np.uint32)
        for k, raw in parts.items():
            ids[begin[k] : begin[k] + len(raw)] = raw
        return ids, many

    def _encode_long(self, word: str) -> np.ndarray:
        """Ids of one long word, composed in blocks in step.

        The last piece up to a place depends on those up to the `longest` places before. So a block
        may begin OVERLAP characters early, anywhere: once it agrees with the block before on that
        many places, all that follows is right. Blocks that don't agree are begun at every place of
        `longest`, as runs of one character need; then with more overlap, at last at the beginning.
        """
        n, deep = len(word), self.longest
        last, back = np.full(n + 1, -2, np.int32), np.zeros(n + 1, np.int32)
        done, overlap, phases = 0, OVERLAP, 1
        while done < n:
            many = max(1, (1 << 20) // (BLOCK * phases))
            ends = [min(n, done + (k + 1) * BLOCK) for k in range(many) if done + k * BLOCK < n]
            if overlap > OVERLAP and n <= 8 * LONG:
                ends, overlap = [n], n
            lanes = sorted({(max(0, e - BLOCK - overlap - r), e) for e in ends for r in range(phases)}, key=lambda x: x[0] - x[1])
            start, _, found, length, _ = self.compose([word[a:e] for a, e in lanes])
            where: dict[int, list[tuple[int, int]]] = {}
            for (a, e), s in zip(lanes, start.tolist(), strict=True):
                where.setdefault(e, []).append((a, s))
            before = done
            for e in ends:
                for a, s in where[e]:
                    lo = done - deep + 1
                    same = a == 0 or lo > a + deep and np.array_equal(found[s + lo - a : s + done - a + 1], last[lo : done + 1])
                    if same:
                        last[done + 1 : e + 1], back[done + 1 : e + 1] = found[s + done - a + 1 : s + e - a + 1], length[s + done - a + 1 : s + e - a + 1]
                        done = e
                        break
                if done != e:
                    break
            if done == before and phases == 1:
                phases = deep
            elif done == before:
                overlap *= 8
        made, ends, place = [], [], n
        backs = back.tolist()
        while place:
            ends.append(place)
            place -= backs[place]
        ends = np.array(ends[::-1])
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self._spelled(last[ends], codes[ends - 1])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the blank that the normaliser put first is taken off."""
        text = b"".join([self.out[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _fields(raw: bytes) -> dict[int, int | bytes]:
    """The fields of a protocol buffer's message by number (of repeated ones, the last)."""
    out: dict[int, int | bytes] = {}
    at = 0

    def number() -> int:
        nonlocal at
        x = shift = 0
        while True:
            x |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return x

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            out[key >> 3] = number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            out[key >> 3] = raw[at : at + size]
            at += size
    return out


def check_model(proto: bytes) -> None:
    """Raises ValueError unless a serialised model is one that compile() can make a transducer of: of
    the BPE kind, with byte fallback, whose normaliser changes no character, keeps all blanks, escapes
    them and puts one before the text."""
    model = _fields(proto)
    trainer, normaliser = _fields(model.get(2, b"")), _fields(model.get(3, b""))
    wrong = [
        name
        for name, good in {
            "model_type": trainer.get(3, 1) == 2,
            "byte_fallback": trainer.get(35, 0) == 1,
            "treat_whitespace_as_suffix": trainer.get(24, 0) == 0,
            "precompiled_charsmap": not normaliser.get(2),
            "add_dummy_prefix": normaliser.get(3, 1) == 1,
            "remove_extra_whitespaces": normaliser.get(4, 1) == 0,
            "escape_whitespaces": normaliser.get(5, 1) == 1,
        }.items()
        if not good
    ]
    if wrong:
        raise ValueError(f"no transducer for a model with this {', '.join(wrong)}")


@functools.lru_cache(maxsize=2)
def compile(path: str) -> Transducer:
    """The transducer of a SentencePiece model that check_model() lets pass."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    check_model(sp.serialized_model_proto())
    n = sp.get_piece_size()
    kinds = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece" for i in range(n)]
    return Transducer([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds)


class Encoder:
    """Whole texts to ids; words met before are looked up (at most CACHED_WORDS are kept)."""

    def __init__(self, transducer: Transducer):
        self.t = transducer
        stop = "".join(transducer.barriers)
        self.units = re.compile(f"{BLANK}*[^{BLANK}{re.escape(stop)}]+|{BLANK}+" + (f"|[{re.escape(stop)}]" if stop else ""))
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.edges = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHED_WORDS:
            self._clear()
        units = [self.units.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = list(dict.fromkeys(u for doc in units for u in doc if u not in self.known))
        ids, many = self.t.encode_words(new)
        for u in new:
            self.known[u] = len(self.known)
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(many)])
        self.flat = np.concatenate([self.flat, ids])
        get = self.known.__getitem__
        out = []
        for doc in units:
            w = np.fromiter(map(get, doc), np.int64, len(doc))
            n = self.edges[w + 1] - self.edges[w]
            ends = np.cumsum(n)
            out.append(self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.edges[w] - ends + n, n)])
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(compile(path))


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every whole text. A null or empty text has no id.

    Repeated rows each give a row, other columns are left out, an empty table gives no rows. A text
    takes time in proportion to its length, a word of any length included.
    """
    path = model or default_model()

    def run(batches):
        e = encoder(path)
        for b in batches:
            for c in byte_chunks(b, "text", 4 << 20):
                ids = e.encode(c.column("text").to_pylist())
                edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(ids or [np.zeros(0, np.uint32)]).astype(np.int32)))], ["doc_id", "ids"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    path = model or default_model()

    def run(batches):
        t = compile(path)
        for b in batches:
            texts = [t.decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Each text encoded and decoded again: doc_id, n_pieces, ids_crc32 (unsigned 32-bit ids,
    little-endian), decoded_sha256 and lossless (whether it is the text; U+2581 becomes a blank).

    Null and empty texts have no piece; repeated rows each give a row; other columns are left out; an
    empty table gives no rows; long texts and words are encoded whole.
    """
    path = model or default_model()

    def run(batches):
        e = encoder(path)
        for b in batches:
            for c in byte_chunks(b, "text", 4 << 20):
                texts = c.column("text").to_pylist()
                ids = e.encode(texts)
                back = [e.t.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        c.column("doc_id"),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in back], pa.string()),
                        pa.array([x == t for x, t in zip(back, texts, strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"],
                )

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
