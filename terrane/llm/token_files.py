"""Token ids in files, compressed by Re-Pair grammars with random access.

Documents are put in order of their ids and dealt to tasks by ranges; each task encodes its
documents and fills shards of about 2^20 ids. In a shard frequent pairs of neighbouring ids are
replaced by nonterminals, again and again: a round counts all pairs by one sort, and replaces all
that are frequent enough, the more frequent first where two overlap. A document's ids are never
paired with the next one's. A shard is one row of Parquet files in a folder that all executors share:

    part, shard, start, n_ids, n_docs, grammar

start is the number of ids before the shard in its part; grammar holds, little-endian: the header
(eight bytes `repair-1`, then as uint64 the number of plain ids, documents, rules, symbols), of each
document its id (int64), whether it is null (uint8), and its number of symbols and of ids (uint64); the
two symbols of each rule, and then the length of each rule's expansion (uint32); the symbols' lower 16 bits
(uint16), and then a bit for each, its 17th, lowest first.
"""

from __future__ import annotations

import array
import functools
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.llm.common import binary_column, byte_chunks, doc_texts, freeing, mix64
from terrane.llm.token_counts import byte_bpe, default_tokenizer

END = 2
SHARD = 1 << 20
TEXT = 2 << 20
LEAST = 8
#: A task's worker keeps the ids of so many different words; beyond, it begins anew.
KEPT_WORDS = 500_000
_MAGIC = b"repair-1"
_HEAD = struct.Struct("<8s4Q")
_BITS = 17  # of a symbol: an id or a rule

# Classes of characters in the splitting rule of byte-level BPE: white space other than a blank, blanks,
# letters, numbers, others. Texts of other characters than these are given to the library whole.
_OTHER_SPACE, _BLANK, _LETTER, _NUMBER, _MARK, _UNKNOWN = range(6)
_CLASS = np.full(256, _UNKNOWN, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _NUMBER
_CLASS[[9, 10, 11, 12, 13]] = _OTHER_SPACE
_CLASS[32] = _BLANK
_CLASS2 = np.full((256, 256), _UNKNOWN, np.uint8)  # by a character's first two bytes, where it has two
_CLASS2[0xC2, 0xA1:0xC0] = _MARK
_CLASS2[0xC2, [0xAA, 0xB5, 0xBA]] = _LETTER
_CLASS2[0xC2, [0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
_CLASS2[0xC2, 0xAD] = _UNKNOWN
_CLASS2[0xC3, 0x80:0xC0] = _LETTER
_CLASS2[0xC3, [0x97, 0xB7]] = _MARK
_CLASS2[0xC4:0xC6, 0x80:0xC0] = _LETTER
_CLASS3 = np.zeros((256, 256), bool)  # by the second and third byte of those that begin with 0xE2
_CLASS3[0x80, [*range(0x90, 0xA8), *range(0xB0, 0xC0)]] = True
_CLASS3[0x81, 0x80:0x9F] = True


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    out = _CLASS[data]
    at = np.flatnonzero(data >= 0xC0)
    follow = np.concatenate([data, np.zeros(3, np.uint8)])
    two, three = follow[at + 1], follow[at + 2]
    kind = _CLASS2[data[at], two]
    kind[(data[at] == 0xE2) & _CLASS3[two, three]] = _MARK
    out[at] = kind
    for k in (1, 2, 3):
        own = at[(data[at] >= (0, 0xC0, 0xE0, 0xF0)[k])] + k
        out[own] = kind[data[at] >= (0, 0xC0, 0xE0, 0xF0)[k]]
    return out


def words(data: np.ndarray, kind: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """First bytes of the words that byte-level BPE splits texts into (bytes, classes, offsets).

    A word is a run of letters, numbers or other marks, with one blank before it if there is one;
    or white space up to the last character before a word; or 's, 't, 're, 've, 'm, 'll, 'd.
    """
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[edges] = True
    space = kind <= _BLANK
    before = np.concatenate([[_UNKNOWN], kind[:-1]])
    run = first[:-1] | (kind != before)
    blank_before = ~first[:-1] & (before == _BLANK)
    begin = run & ~space & ~blank_before
    begin |= space & (first[:-1] | (before > _BLANK))
    begin[:-1] |= space[:-1] & ~space[1:] & ~first[1:-1]
    at = np.flatnonzero((data == 39) & begin)
    if len(at):
        raw = np.concatenate([data, np.zeros(3, np.uint8)])
        stop = np.concatenate([first, np.ones(3, bool)])
        one = (raw[at + 1, None] == np.frombuffer(b"stmd", np.uint8)).any(1) & ~stop[at + 1]
        a, b = raw[at + 1], raw[at + 2]
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l"))) & ~stop[at + 1] & ~stop[at + 2]
        for hit, size in ((at[one], 2), (at[two], 3)):
            begin[hit + 1] = False
            hit = hit[(hit + size < n)] + size
            begin[hit[~first[hit] & (kind[hit] == _LETTER)]] = True
    return np.flatnonzero(begin)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function from texts (bytes and offsets) to their ids (uint32) and how many each has.

    Each different word of the texts is encoded once, by tiktoken with the file's vocabulary; texts with
    characters of other classes go to the tokenizers library whole. Strings of special tokens are
    ordinary text.
    """
    from tokenizers import Tokenizer

    library, fast = Tokenizer.from_file(path), byte_bpe(path)
    library.encode_special_tokens = True
    known: dict[bytes, bytes] = {}

    def encode(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = classes(data)
        odd = np.add.reduceat(np.append(kind == _UNKNOWN, False), edges[:-1]) * (np.diff(edges) > 0) > 0 if len(edges) > 1 else np.zeros(0, bool)
        counts = np.zeros(len(odd), np.int64)
        whole = {int(i): np.array(library.encode(data[edges[i] : edges[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(odd)}
        if whole:  # take them out, and put their ids in afterwards
            size = np.where(odd, 0, np.diff(edges))
            keep = np.repeat(~odd, np.diff(edges))
            data, kind, edges = data[keep], kind[keep], np.concatenate([[0], np.cumsum(size)])
        begin = words(data, kind, edges)
        column = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        held, off = binary_column(column.dictionary)
        held, off = held.tobytes(), off.tolist()
        unique = [held[a:b] for a, b in zip(off, off[1:], strict=False)]
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in unique:
            if w not in known:
                known[w] = array.array("I", fast._encode_single_piece(w)).tobytes()
        coded = [known[w] for w in unique]
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), np.uint32)
        word = column.indices.to_numpy()
        many = size[word]
        to = np.concatenate([[0], np.cumsum(many)])
        step = np.repeat((np.cumsum(size) - size)[word] - to[:-1], many)
        step += np.arange(len(step))
        ids = flat[step]
        bounds = to[np.searchsorted(begin, edges)]
        counts = np.diff(bounds)
        if whole:
            places = np.repeat([int(bounds[i]) for i in whole], [len(x) for x in whole.values()])
            ids = np.insert(ids, places, np.concatenate(list(whole.values())))
            counts[list(whole)] = [len(x) for x in whole.values()]
        return ids, counts

    return encode


def grammar(ids: np.ndarray, last: np.ndarray, plain: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a sequence, which of them are the last of a document, and the rules (pairs of
    symbols; rule k is symbol plain + k, made of ids and earlier rules).

    A round replaces all pairs with at least least places, and at least a share of the most frequent
    one's. Rounds end where they take less than one symbol in 32 away, or where no symbol is left.
    """
    seq, rules, share, pos = ids.astype(np.uint64), [np.zeros(0, np.uint64)], 32, np.uint64(64 - 2 * _BITS)
    bits, free = np.uint64(_BITS), (1 << _BITS) - plain
    while len(seq) > 1 and free > 0:
        n = len(seq)
        key = seq[:-1] << bits
        key |= seq[1:]
        key <<= pos
        key |= np.arange(n - 1, dtype=np.uint64)
        key = key[~last[:-1]]
        key.sort()  # by pair, then by place
        pair = key >> pos
        head = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1])
        count = np.diff(np.append(head, len(key)))
        floor = max(least, int(count.max(initial=0)) // share)
        good = np.flatnonzero(count >= floor)
        good = good[np.lexsort((mix64(pair[head[good]]), -count[good]))][:free]
        count = count[good]
        step = np.repeat(head[good] - (np.cumsum(count) - count), count)
        step += np.arange(len(step))
        order = np.zeros(n + 1, np.int32)  # of the pair that begins at each place, the most frequent highest
        order[(key[step] & ((np.uint64(1) << pos) - np.uint64(1))).astype(np.int64)] = np.repeat(np.arange(len(good), 0, -1, dtype=np.int32), count)
        own = order[:-1]
        chosen = (own > 0) & (own >= order[1:])
        chosen[1:] &= own[1:] >= own[:-1]
        at = np.flatnonzero(chosen)
        equal = np.flatnonzero(own[at] == order[at + 1])  # of one symbol several times over, every other pair
        if len(equal):
            stretch = np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), np.arange(n), 0))
            at = at[(at - stretch[at]) % 2 == 0]
        rule = len(good) - own[at]
        used = np.bincount(rule, minlength=len(good)) >= max(2, least // 2)
        at, rule = at[used[rule]], rule[used[rule]]
        if len(at):
            seq[at] = (plain + sum(map(len, rules)) + np.cumsum(used)[rule] - 1).astype(np.uint64)
            rules.append(pair[head[good[used]]])
            free -= int(used.sum())
            last[at] = last[at + 1]
            keep = np.ones(n, bool)
            keep[at + 1] = False
            seq, last = seq[keep], last[keep]
        if len(at) * 32 < n:
            if floor == least:
                break
            share *= 32
    made = np.concatenate(rules)
    return seq, last, np.stack([made >> bits, made & ((np.uint64(1) << bits) - np.uint64(1))], 1).astype(np.int64)


def _lengths(rules: np.ndarray, plain: int) -> np.ndarray:
    """How many ids each symbol stands for. Rules are made of earlier ones."""
    out = np.ones(plain + len(rules), np.int64)
    todo = np.arange(len(rules))
    known = np.concatenate([np.ones(plain, bool), np.zeros(len(rules), bool)])
    while len(todo):
        ready = known[rules[todo]].all(1)
        now = todo[ready]
        out[plain + now] = out[rules[now]].sum(1)
        known[plain + now] = True
        todo = todo[~ready]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, plain: int) -> np.ndarray:
    """The ids that symbols stand for."""
    while len(symbols) and symbols.max() >= plain:
        inner = symbols >= plain
        out = np.repeat(symbols, np.where(inner, 2, 1))
        at = np.flatnonzero(inner) + np.arange(int(inner.sum()))
        out[at], out[at + 1] = rules[symbols[inner] - plain].T
        symbols = out
    return symbols


def packed(doc_ids: list, ids: np.ndarray, counts: np.ndarray, plain: int) -> bytes:
    """A shard's bytes: its documents' ids, end to end."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    symbols, last, rules = grammar(ids, last, plain)
    symbols = symbols.astype(np.int64)
    own = np.diff(np.flatnonzero(np.concatenate([[True], last])))
    parts = [
        np.array([0 if d is None else d for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), own.astype("<u8"), counts.astype("<u8"),
        rules.astype("<u4"), _lengths(rules, plain)[plain:].astype("<u4"), (symbols & 0xFFFF).astype("<u2"), np.packbits(symbols >> 16 > 0, bitorder="little"),
    ]
    return _HEAD.pack(_MAGIC, plain, len(doc_ids), len(rules), len(symbols)) + b"".join(p.tobytes() for p in parts)


class Shard:
    """What a shard's bytes hold."""

    def __init__(self, raw: bytes):
        magic, self.plain, docs, rules, symbols = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = pa.array(ids, mask=null > 0)
        self.n_symbols, self.n_ids = take("<u8", docs).astype(np.int64), take("<u8", docs).astype(np.int64)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.length = np.concatenate([np.ones(self.plain, np.int64), take("<u4", rules)])
        self.symbols = take("<u2", symbols).astype(np.int64)
        self.symbols |= np.unpackbits(take("u1", -(-symbols // 8)), count=symbols, bitorder="little").astype(np.int64) << 16

    def all(self) -> np.ndarray:
        """All ids (uint32): each rule is expanded once."""
        table = np.concatenate([np.arange(self.plain), expand(np.arange(len(self.rules)) + self.plain, self.rules, self.plain)]).astype(np.uint32)
        many = self.length[self.symbols]
        step = np.repeat((np.cumsum(self.length) - self.length)[self.symbols] - (np.cumsum(many) - many), many)
        step += np.arange(len(step))
        return table[step]

    def some(self, doc: int, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the shard's document number doc; only what holds them is expanded."""
        first = int(self.n_symbols[:doc].sum())
        own = self.symbols[first : first + int(self.n_symbols[doc])]
        to = np.cumsum(self.length[own])
        start = min(max(start, 0), int(self.n_ids[doc]))
        stop = min(start + max(n, 0), int(self.n_ids[doc]))
        a, b = np.searchsorted(to, start, "right"), np.searchsorted(to, stop, "left") + 1
        skip = start - (int(to[a - 1]) if a else 0)
        return expand(own[a:b], self.rules, self.plain)[skip : skip + stop - start].astype(np.uint32)


FILES = "part int, shard int, start long, n_ids long, n_docs long, grammar binary"


def shards(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """The rows of the files (see the module) for a documents table, each document followed by the id end.

    Documents come in ascending doc_id, null ids first; rows with equal ids by their texts' hashes.
    A null or empty text is the end id alone. A document is never split: one of more than 2^20 ids
    makes a larger shard. An empty table gives no rows; other columns are left out.
    """
    path = tokenizer or default_tokenizer()
    order = ["doc_id", "_hash", "_row"]
    dealt = doc_texts(docs).withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        from tokenizers import Tokenizer

        encode, plain = encoder(path), Tokenizer.from_file(path).get_vocab_size()
        part, number, start, held, ids, counts, size = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def flush():
            nonlocal number, start, held, ids, counts, size
            raw = packed(held, np.concatenate(ids), np.concatenate(counts), plain)
            row = (part, number, start, size, len(held), raw)
            number, start, held, ids, counts, size = number + 1, start + size, [], [], [], 0
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in FILES.split(", ")])

        for b in batches:
            for c in byte_chunks(b, "text", TEXT):
                got, many = encode(*binary_column(c.column("text")))
                ids.append(np.insert(got, np.cumsum(many), end))
                counts.append(many + 1)
                held += c.column("doc_id").to_pylist()
                size += len(ids[-1])
                if size >= SHARD:
                    yield flush()
        if held:
            yield flush()

    return dealt.select("doc_id", "text").mapInArrow(freeing(run), FILES)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """shards(docs) as files in a folder, through Spark, which may be in any store that Spark writes to."""
    shards(docs, tokenizer, end).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """documents(...) of the files in a folder."""
    return documents(spark.read.schema(FILES).parquet(path))


def documents(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian unsigned
    32 bits) of every document in the files' rows."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))  # one row for each of the writer's tasks
    base = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))

    def run(batches):
        for b in batches:
            for start, raw in zip(b.column("start").to_pylist(), b.column("grammar"), strict=True):
                s = Shard(raw.as_buffer().to_pybytes())
                ids = s.all()
                to = np.cumsum(s.n_ids)
                for lo, hi in _slices(s.n_ids, 4 * SHARD):
                    first, own = int(to[lo] - s.n_ids[lo]), s.n_ids[lo:hi]
                    off = np.concatenate([[0], np.cumsum(own) * 4])
                    raw_ids = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids[first : first + int(own.sum())], "<u4"))])
                    yield pa.RecordBatch.from_arrays([s.doc_ids[lo:hi], pa.array(start + to[lo:hi] - own), pa.array(own), raw_ids], ["doc_id", "start", "n_tokens", "ids"])

    placed = files.join(base, "part").select((F.col("start") + F.col("_base")).alias("start"), "grammar")
    return placed.mapInArrow(freeing(run), "doc_id long, start long, n_tokens long, ids binary")


def _slices(sizes: np.ndarray, limit: int):
    """Stretches of rows with limit in all at most, or a single row."""
    to, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(to, to[at] + limit, "right")) - 1)
        yield at, end
        at = end
