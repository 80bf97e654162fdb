"""Periodic runs against a plain scan of every lag."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

import __spark_entry__
from terrane.llm import periodic


def plain_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(6, 4 * q) and not any(w[i : i + size - d] == w[i + d : i + size] for d in range(1, q)):
                out.add((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    milli = None if best[2] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def some_words(rng):
    n, letters = rng.randint(0, 60), rng.choice([1, 2, 3, 8])
    w = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // (3 + rng.randrange(8))
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        w += [rng.randrange(letters) for _ in range(rng.choice([0, 0, 20]))]
    return w


@pytest.mark.parametrize("rounds", [64, 1, 0])
def test_runs_of_several_texts(rounds, monkeypatch):
    monkeypatch.setattr(periodic, "ROUNDS", rounds)
    rng = random.Random(rounds)
    for _ in range(300):
        texts = [some_words(rng) for _ in range(rng.randint(0, 4))]
        got = periodic.find(np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts], np.int64))
        base, want = 0, []
        for t in texts:
            want += [(s + base, n, q) for s, n, q in plain_runs(t)]
            base += len(t)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_rare_words_split_again_and_again():
    # x occurs 4 times and goes only once the words around it are gone; the run survives.
    w = [1, 2, 3] * 4 + [9] + [5, 5, 5, 8, 5, 7, 7, 7, 6, 7]
    at, own = periodic.segments(np.array(w), np.zeros(len(w), np.int64))
    assert at.tolist() == list(range(12)) and len(set(own.tolist())) == 1


def test_edges(spark):
    rows = [
        (0, None, "x"), (1, "", "x"), (2, " \t\n\x0b\f\r ", "x"), (None, "a " * 6, None), (None, "b " * 5, None), (4, "b b b b b b b", "x"), (4, "b b b b b b b", "x"),
        (5, "é é é é é é é é é é é é  ", "x"), (6, "a b a b a b a b c a b c a b c a b c a b", "x"), (7, "a b a b a b a", "x"), (8, "\x00 " * 6, "x"),
    ]
    rows += [(100 + i, f"w{i} one two  three\n" * (i % 9) + "end of it", "x") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(3)
    got = sorted((tuple(r) for r in periodic.summary(periodic.collapse(df, tiled=True)).collect()), key=str)
    assert got == sorted((plain_row(d, t) for d, t, _ in rows), key=str)
    assert periodic.collapse(df.limit(0)).collect() == []
    [r] = periodic.collapse(df.where("doc_id = 6")).collect()
    assert [tuple(x) for x in r["runs"]] == [(0, 8, 2), (6, 14, 3)] and r["text"] == "a b c" and r["n_words"] == 20


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = {r["doc_id"]: plain_row(r["doc_id"], r["text"]) for r in docs if len(r["text"] or "") < 8000}
    got = {r["doc_id"]: tuple(r) for r in __spark_entry__.queries()["op13_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs) and all(got[d] == w for d, w in short.items()) and len(short) > 100


def test_long_texts_take_no_square_of_time():
    rng = np.random.default_rng(0)
    for letters in (1, 3, 1000):
        began = time.time()
        periodic.find(rng.integers(0, letters, 300_000), np.array([300_000]))
        assert time.time() - began < 20
    block = rng.integers(0, 50, 50_000)
    assert [x.tolist() for x in periodic.find(np.tile(block, 5)[:220_000], np.array([220_000]))] == [[0], [220_000], [50_000]]
