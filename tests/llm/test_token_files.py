"""Token files: the words that are encoded, the grammars, and what is read back, against the library."""

import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import __spark_entry__
from terrane.llm import token_files
from terrane.llm.token_counts import default_tokenizer

PLAIN = 50257


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def column(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


KNOWN = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA1, 0xAC), *range(0xAE, 0x180), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]]
CLOSE = [*"  \n\t''''sstmdrevellaé19 .,!ab²ª", "'re", "'ll", "'ve", " 's", "'t", "\r\n"]
ODD = ["\xa0", "​", "漢", "😀", "\xad", " ", "\x00", "\x1c", "ǅ", "а", "\x85", "<|endoftext|>"]


@pytest.mark.parametrize("chars", [KNOWN, CLOSE, CLOSE + ODD])
def test_words_are_split_as_the_library_splits(library, chars):
    encode, rng = token_files.encoder(default_tokenizer()), random.Random(len(chars))
    for _ in range(150):
        texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 30))]
        ids, counts = encode(*column(texts))
        want = library(texts)
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def sequences():
    rng = np.random.default_rng(1)
    yield np.zeros(5000, np.uint32)
    yield np.array([2], np.uint32)
    yield np.tile(np.arange(300, dtype=np.uint32), 50)
    yield rng.integers(0, PLAIN, 5000).astype(np.uint32)
    yield rng.integers(0, 3, 20000).astype(np.uint32)
    yield np.repeat(rng.integers(0, 5, 3000), rng.integers(1, 9, 3000)).astype(np.uint32)
    yield (rng.zipf(1.3, 50000) % PLAIN).astype(np.uint32)


@pytest.mark.parametrize("ids", list(sequences()), ids=range(7))
def test_grammars_give_back_every_part(ids):
    rng, n = random.Random(0), len(ids)
    cuts = sorted(rng.sample(range(1, n), min(n - 1, 20)))
    counts = np.diff([0, *cuts, n])
    shard = token_files.Shard(token_files.packed(list(range(len(counts))), ids, counts, PLAIN))
    assert shard.all().tolist() == ids.tolist() and shard.n_ids.tolist() == counts.tolist()
    edges = np.concatenate([[0], np.cumsum(counts)])
    for _ in range(60):
        doc, start, many = rng.randrange(len(counts)), rng.randint(0, 2000), rng.randint(0, 400)
        assert shard.some(doc, start, many).tolist() == ids[edges[doc] : edges[doc + 1]][start : start + many].tolist()
    # Symbols never cross documents, and rules stand for as many ids as they say.
    assert [int(x.sum()) for x in np.split(shard.length[shard.symbols], np.cumsum(shard.n_symbols)[:-1])] == counts.tolist()
    for k in range(min(20, len(shard.rules))):
        assert len(token_files.expand(np.array([PLAIN + k]), shard.rules, PLAIN)) == shard.length[PLAIN + k]


def test_frequent_pairs_are_replaced_again_and_again():
    phrase = np.arange(64, dtype=np.uint32)
    ids = np.concatenate([np.append(phrase, 1000 + k) for k in range(100)]).astype(np.uint32)
    symbols, _, rules = token_files.grammar(ids, np.zeros(len(ids), bool), PLAIN)
    assert len(symbols) <= 400 and len(rules) <= 200 and token_files.expand(symbols.astype(np.int64), rules, PLAIN).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        token_files.Shard(b"x" * 200)


def rows_for(library, docs):
    start, want = 0, []
    for d, t in docs:
        ids = np.array([*library([t or ""])[0], 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return want


def test_edges(spark, library, tmp_path):
    rows = [(3, "one two", 1), (None, "null id", 2), (1, None, 3), (2, "", 4), (-5, "x" * 30000, 5), (9, "a b", 6), (9, "a b", 7), (7, "<|endoftext|>", 8), (8, "漢字 and more", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    token_files.write(df, f"{tmp_path}/files")
    got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in token_files.read(spark, f"{tmp_path}/files").orderBy("start").collect()]
    want = rows_for(library, sorted(((d, t) for d, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0)))
    assert got == want
    assert token_files.documents(token_files.shards(df.limit(0))).collect() == []


def test_rows_with_one_id_are_dealt_by_text(spark, library):
    rows = [(1, f"text {i % 40} of this id") for i in range(400)] + [(0, "first"), (2, "last")]
    got = token_files.documents(token_files.shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [0] + [1] * 400 + [2]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    assert sorted(r["ids"] for r in got) == sorted(np.array([*x, 2], "<u4").tobytes() for x in library([t for _, t in rows]))
    assert len({r["ids"] for r in got[1:41]}) == 4  # equal texts lie together


def test_shards_fill_and_a_long_document_has_one(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD", 500)
    docs = [(i, f"word{i} and others " * (i % 30)) for i in range(60)] + [(99, "so on " * 3000)]
    texts = [t for _, t in docs]
    ids, counts = token_files.encoder(default_tokenizer())(*column(texts))
    assert counts.tolist() == [len(x) for x in library(texts)]
    files = token_files.shards(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in token_files.documents(files).collect())
    assert got == rows_for(library, docs)


def test_whole_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = rows_for(library, sorted((r["doc_id"], r["text"]) for r in docs))
    assert sorted(map(tuple, __spark_entry__.queries()["op12_token_files"](spark, sf).collect())) == want
