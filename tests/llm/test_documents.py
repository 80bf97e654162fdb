"""The document operators against brute force, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from terrane.llm import jaccard, language_id, licenses, media, packing, repeats, sentencepieces, token_counts, webp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, component string, kind int"
BASE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, BASE, "en", None, None, 1, "x", 0),
    (2, BASE + " tail", "en", "s", 3, None, None, None),
    (3, None, None, None, None, None, None, None),
    (4, "", "fr", "s", 0, 1, "x", 0),
    (5, " \t\n ", "fr", "s", 0, 1, "x", 0),
    (6, "one Two three", "de", "s", 0, 1, "x", 0),
    (7, "ONE two  three", "de", "s", 0, 1, "x", 0),
    (8, "123 456 !!", "de", "s", 0, 1, "x", 0),
    (9, "é" * 150, "fr", "s", 0, 1, "x", 0),
    (9, "é" * 150, "fr", "s", 0, 1, "x", 0),
    (10, "Released under the MIT License.\nThe end.", "en", "s", 0, 1, "x", 0),
    (None, BASE, "en", "s", 0, 1, "x", 0),
    (12, "long " * 30000, "en", "s", 0, 1, "x", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_empty_tables(empty):
    for f in (media.describe, jaccard.jaccard_components, packing.pack, language_id.language_id, repeats.remove_repeats, sentencepieces.round_trip, token_counts.token_counts, licenses.license_scan):
        assert f(empty).collect() == []


def shingle_sets(rows):
    lower = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    out = []
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()))
    return out


def brute_components(rows):
    sets = shingle_sets(rows)
    comp = {d: d for d, _ in sets if d is not None}
    links = [(a, b) for a, x in sets for b, y in sets if a is not None and b is not None and a < b and 100 * len(x & y) >= 80 * len(x | y) and x | y]
    for _ in range(len(comp)):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return sorted([(d, len(s), comp.get(d)) for d, s in sets], key=str)


def test_jaccard_edges(docs):
    got = sorted([tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in jaccard.jaccard_components(docs).collect()], key=str)
    assert got == brute_components(ROWS)


def test_jaccard_ids_with_several_texts(spark):
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(5, BASE), (5, other), (3, other + " x"), (9, BASE + " y"), (7, "alone here"), (5, "third text of five words long"), (2, "third text of five words long"), (8, None), (8, "alone here")]
    got = sorted([tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()], key=str)
    want = {5: 2, 3: 2, 9: 2, 2: 2, 7: 7, 8: 7}
    assert {(d, c) for d, n, c in got if n} == set(want.items()) and len(got) == len(rows)


def test_jaccard_random(spark):
    rng = random.Random(5)
    texts = [[f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 60))] for _ in range(12)]
    rows = []
    for i in range(160):
        t = list(rng.choice(texts))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            t[rng.randrange(len(t))] = f"w{rng.randint(0, 400)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted([tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in jaccard.jaccard_components(df).collect()], key=str)
    assert got == brute_components(rows)
    kept = jaccard.keep_one_each(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in got})


def test_keep_one_each_repeated_and_null_ids(docs):
    kept = [r["doc_id"] for r in jaccard.keep_one_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([1, 3, 4, 5, 6, 8, 9, 10, None, 12], key=str)
    assert jaccard.keep_one_each(docs).columns == docs.columns


def brute_repeats(rows):
    seen, out = set(), []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(b[i : i + 100])
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def spans_of(df):
    return sorted([tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in repeats.remove_repeats(df).collect()], key=str)


def test_repeats_edges(docs):
    assert spans_of(docs) == brute_repeats(ROWS)


@pytest.mark.parametrize("frequent", [3, 300])
def test_repeats_random(spark, monkeypatch, frequent):
    rng = random.Random(frequent)
    passages = ["".join(rng.choice("abcd é") for _ in range(rng.randint(90, 400))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 60)
            parts += ["".join(rng.choice("abcdxyz") for _ in range(rng.randint(0, 120))), p[a : len(p) - rng.randint(0, 60)]]
        rows.append((i, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    # The stages are generators over Arrow batches: run here, so that the threshold can be set.
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    plain = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert spans_of_stages(spark, plain) == brute_repeats(rows)
    assert spans_of(df) == brute_repeats(rows)


def spans_of_stages(spark, rows):
    import pyarrow as pa
    from unittest import mock

    out = []
    with mock.patch.object(repeats, "TaskContext") as context:
        context.get.return_value.partitionId.return_value = 3
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows]), pa.array(["{}"] * len(rows))], ["doc_id", "text", "carry"])
        step = list(repeats._print(4)(iter([batch.slice(0, 40), batch.slice(40)])))
    for f in (repeats._match_prints, repeats._segment(4), repeats._compare(4)):
        step = [b for b in f(iter(step)) if b.num_rows]
    for b in repeats._finish(False)(iter(step)):
        out += [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in b.to_pylist()]
    return sorted(out, key=str)


def test_common_classes():
    rng = np.random.default_rng(0)
    for trial in range(20):
        base = rng.integers(65, 65 + (2, 3, 30)[trial % 3], 300, dtype=np.uint8)
        parts = []
        for _ in range(5):
            a = rng.integers(0, 200)
            parts += [base[a : a + rng.integers(40, 100)], np.array([255], np.uint8)]
        text, length = np.concatenate(parts), int(rng.integers(3, 40))
        order, joined = repeats.common_classes(text, length)
        turn = np.tile(text, 2 + length // len(text)).tobytes()
        for k in range(1, len(order)):
            assert joined[k] == (turn[order[k] :][:length] == turn[order[k - 1] :][:length])


def test_without_repeats_keeps_columns(docs):
    got = repeats.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(ROWS)
    row = next(r for r in got.collect() if r["doc_id"] == 2)
    assert row["source"] == "s" and row["n_chars"] == len(row["text"])


def test_media(docs):
    got = media.describe(docs).collect()
    assert len(got) == len(ROWS)
    want = collections.Counter()
    for d, t, *_ in ROWS:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert want == collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got)
    twice = [r for r in got if r["doc_id"] == 9]
    assert twice[0]["media_sha256"] == twice[1]["media_sha256"] and twice[0]["feature"] == twice[1]["feature"]
    stored = by_id(media.store(docs).collect())
    for r in got:
        if r["doc_id"] is not None:
            assert len(stored[r["doc_id"]]["media"]) == r["media_bytes"]
            assert hashlib.sha256(stored[r["doc_id"]]["media"]).hexdigest() == r["media_sha256"]


@pytest.mark.parametrize("transforms", [(), (webp.GREEN,), (webp.PREDICT,), (webp.CROSS,), (webp.PREDICT, webp.CROSS, webp.GREEN), (webp.PALETTE,), (webp.PALETTE, webp.PREDICT)])
def test_webp_round_trip(transforms):
    rng = np.random.default_rng(1)
    images = []
    for n in (1, 2, 9, 60):
        colours = rng.integers(0, 2**32, (1, 2, 5, 40)[n % 4], dtype=np.uint32)
        images.append(rng.choice(colours, 16 * n))
        if webp.PALETTE not in transforms:
            images.append(rng.integers(0, 2**32, 16 * n, dtype=np.uint32))
    for cache in (0, 1, 6, 10):
        for mode in (1, 2):
            plans = [webp.Plan(transforms, mode, 0x103020, cache)] * len(images)
            for a, b in zip(images, webp.decode_streams(webp.encode_streams(images, 16, plans)), strict=True):
                assert np.array_equal(a, b.pixels)


def test_webp_predictors_and_cross_colour_by_definition():
    """The inverse of every predictor mode against a pixel-by-pixel reading of the definition."""
    rng = np.random.default_rng(2)
    width, height = 5, 4
    for mode in range(14):
        residual = rng.integers(0, 2**32, width * height, dtype=np.uint32)
        im = webp.Image(width, height, [], residual.copy(), width)
        webp._unpredict([im], [(webp.PREDICT, width, 2, np.full(2, mode << 8, np.uint32))])
        px = np.zeros((height, width, 4), int)
        res = residual.view(np.uint8).reshape(height, width, 4).astype(int)
        for y in range(height):
            for x in range(width):
                if y == 0 and x == 0:
                    p = np.array([0, 0, 0, 255])
                elif y == 0:
                    p = px[y, x - 1]
                elif x == 0:
                    p = px[y - 1, x]
                else:
                    left, top, corner = px[y, x - 1], px[y - 1, x], px[y - 1, x - 1]
                    right = px[y - 1, x + 1] if x + 1 < width else px[y, 0]
                    half = lambda a, b: (a + b) // 2
                    p = [
                        np.array([0, 0, 0, 255]), left, top, right, corner, half(half(left, right), top), half(left, corner), half(left, top), half(corner, top), half(top, right), half(half(left, corner), half(top, right)),
                        left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top, np.clip(left + top - corner, 0, 255), np.clip(half(left, top) + np.trunc((half(left, top) - corner) / 2).astype(int), 0, 255),
                    ][mode]
                px[y, x] = (res[y, x] + p) & 255
        assert np.array_equal(im.pixels.view(np.uint8).reshape(height, width, 4), px), mode


def test_packing(docs):
    got = [r.asDict() for r in packing.pack(docs).collect()]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.default_tokenizer())
    want = collections.Counter()
    for d, text, *_ in ROWS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert want == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_plan_is_exact_where_it_can_be():
    assert len(packing.plan({1000: 3, 1048: 3, 512: 4, 600: 1, 700: 1, 748: 1})) == 3
    rng = random.Random(3)
    counts = collections.Counter(rng.randint(1, 2048) for _ in range(4000))
    made = packing.plan(counts)
    used = collections.Counter()
    for pattern, n in made:
        assert sum(pattern) <= 2048
        for x in pattern:
            used[x] += n
    assert used == counts
    assert sum(n for _, n in made) <= -(-sum(k * n for k, n in counts.items()) // 2048) * 1.02 + 1


def test_token_counts(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.default_tokenizer())
    n = [len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS]
    limits = token_counts.token_counts(docs)
    for r in limits.collect():
        c = r["context_limit"]
        assert r["docs_within"] == sum(x <= c for x in n) and r["tokens_truncated"] == sum(min(x, c) for x in n)
        assert r["tokens_lost"] == sum(max(0, x - c) for x in n) and r["tokens_within"] == sum(x for x in n if x <= c)
    for c in (0, 7, 100, 10**6):
        a = token_counts.answer(limits, c).first()
        assert a["docs_within"] == sum(x <= c for x in n) and a["tokens_truncated"] == sum(min(x, c) for x in n)
    assert token_counts.quantile(limits, 0.5).first()[0] == sorted(n)[(len(n) - 1) // 2]


def test_encoder_equals_tokenizers_on_odd_texts():
    from tokenizers import Tokenizer

    path = token_counts.default_tokenizer()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rng = random.Random(4)
    letters = "ab \n\t0é日<|endoftext|>'s  ​\x1c\x85ſ²½ǅ\U0001f600"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert token_counts.encoder(path)(s).tolist() == t.encode(s, add_special_tokens=False).ids


def test_language_id(docs, spark, sf):
    got = by_id(language_id.language_id(docs).collect())
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[8]["lang_pred"] == "und"
    assert got[1]["held_out"] == (zlib.crc32(b"1") % 5 == 0)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joined = language_id.language_id(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out")
    assert joined.where("lang = lang_pred").count() >= 0.95 * joined.count()


def test_keep_identified_keeps_rows_as_they_are(docs):
    filters = language_id.fit(docs)
    kept = language_id.keep_identified(docs, filters)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} >= {1, 2} and not {3, 4, 5, 8} & {r["doc_id"] for r in kept.collect()}


def test_language_fields_are_no_inputs(docs, spark):
    filters = language_id.fit(docs)
    other = spark.createDataFrame([(r[0], r[1], "zz", "q", 9, 9, "q", 9) for r in ROWS], SCHEMA)
    key = lambda rows: sorted(map(str, rows))
    assert key(language_id.identify(docs, filters).collect()) == key(language_id.identify(other, filters).collect())


def test_sentencepiece(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    ids = sentencepieces.encode(docs)
    want = sorted((str(r[0]), sp.encode(r[1] or "")) for r in ROWS)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in ids.collect()) == want
    assert sorted((str(r["doc_id"]), r["text"]) for r in sentencepieces.decode(ids).collect()) == sorted((str(r[0]), r[1] or "") for r in ROWS)
    assert all(r["lossless"] for r in sentencepieces.round_trip(docs).collect())


def test_sentencepiece_odd_texts():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    e = sentencepieces.Encoder(sentencepieces.compile(sentencepieces.default_model()))
    rng = random.Random(6)
    texts = ["".join(rng.choice("aeinrst th of \n.,-=  0123àßñ日Ω🎉▁<>") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 500, "", "\x00\x01", "<s></s><unk><0x0A>"]
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == sp.encode(t)


def test_licenses(docs, spark):
    got = licenses.license_scan(docs).collect()
    assert [(r["doc_id"], r["paragraph"], r["family"], r["confirmed"]) for r in got] == [(10, 0, "mit", True)]
    lines = {
        "Licensed under the Apache License, Version 2.0.": "apache",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "All rights reserved.": "proprietary",
        "He lost his driving license last year, and walked.": None,
        "Plain prose without any of it.": None,
    }
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {r["doc_id"]: r["family"] for r in licenses.license_scan(df).collect() if r["confirmed"]}
    assert found == {i: f for i, f in enumerate(lines.values()) if f}
