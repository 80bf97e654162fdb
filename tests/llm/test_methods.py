"""The operators' methods against plain versions of them, on odd and very long inputs."""

import html
import math
import random
import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from terrane.llm import common, html_text, language_id, licenses, neighbours, packing, repeats, sentencepieces, token_counts


def test_every_way_of_filling_takes_part():
    assert packing.filled({1500: 2, 548: 2}) == {"single": 2}
    assert packing.filled({1500: 2, 300: 2, 248: 2}) == {"pair": 2}
    assert packing.filled({1500: 2, 300: 2, 200: 2, 48: 2}) == {"triple": 2}
    assert packing.filled({1500: 1, 400: 1, 10: 1}) == {"best fit": 1}
    assert packing.filled({2048: 3}) == {"whole": 3} and packing.planned({}) == []
    # Short pieces aren't used up where a long one fills the gap.
    assert sorted(packing.plan({1500: 2, 548: 1, 300: 1, 248: 1})) == [((1500, 300, 248), 1), ((1500, 548), 1)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_comes_near_the_bound(seed):
    rng = random.Random(seed)
    counts = Counter(min(2048, int(rng.lognormvariate(5.5, 1.3)) + 1) for _ in range(20000))
    made = packing.plan(counts)
    used = Counter()
    for pattern, n in made:
        assert sum(pattern) <= 2048 and n > 0
        for x in pattern:
            used[x] += n
    assert used == counts
    assert sum(n for _, n in made) <= -(-sum(k * n for k, n in counts.items()) // 2048) + 1


@pytest.mark.parametrize("seed", range(4))
def test_complements_against_all_combinations(seed):
    import itertools

    import numpy as np

    rng = random.Random(seed)
    for _ in range(60):
        c = np.zeros(60, np.int64)
        for _ in range(rng.randint(1, 8)):
            c[rng.randint(1, 59)] += 1
        have = [x for x in range(60) for _ in range(int(c[x]))]
        gap, most = rng.randint(1, 59), rng.randint(1, 59)
        ways = [w for k in (1, 2, 3) for w in itertools.combinations([x for x in have if x <= most], k) if sum(w) == gap]
        found = packing._complement(c, gap, most)
        assert bool(found) == bool(ways) and (not found or len(found) == len(ways[0]) and sum(found) == gap and not Counter(found) - Counter(have))


class Plain(HTMLParser):
    """Path, text and linked characters of each block of a well-formed page, with each path's factor."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.text, self.linked = [], [], "", 0
        self.feed(page)
        self.flush()

    def flush(self):
        whole = re.sub(r"\s+", " ", self.text).strip()
        if whole and not {"head", "script", "style", "title"} & {t for t, _ in self.stack}:
            self.blocks.append((tuple(s for s in self.stack if s[0] in html_text.BLOCKS), whole, min(self.linked, len(whole))))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCKS:
            self.flush()
            if self.stack and ("p", "") in self.stack and self.stack[-1][0] in ("p", "b"):
                del self.stack[len(self.stack) - 1 - self.stack[::-1].index(("p", "")) :]
        if tag == "br":
            self.text += " "
        elif tag != "meta":
            self.stack.append((tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.flush()
        while self.stack and any(t == tag for t, _ in self.stack):
            if self.stack.pop()[0] == tag:
                break

    def handle_data(self, data):
        if "script" not in {t for t, _ in self.stack} and "style" not in {t for t, _ in self.stack}:
            self.text += data
            if any(t == "a" for t, _ in self.stack):
                self.linked += len(data)


def plain_text(page):
    """Ratio by path, smoothed, fused and thresholded; then the article around what is chosen."""
    blocks = Plain(page).blocks
    rows = defaultdict(list)
    for path, text, linked in blocks:
        rows[path].append((len(text), len(re.findall(r"[.,;:!?]", text)), linked))
    ratio = {}
    for path, own in rows.items():
        n, length = len(own), sum(r[0] for r in own)
        tags = [t for t, _ in path]
        weight = (64 if "article" in tags else 1) * 0.01 ** sum(t in ("nav", "footer", "aside") for t in tags)
        ratio[path] = length / n * (1 + sum(r[1] for r in own) / n) * (1 - sum(r[2] for r in own) / length) * weight
    around = {-2: 0.1, -1: 0.2, 0: 0.4, 1: 0.2, 2: 0.1}
    smooth = [sum(w * ratio[blocks[i + k][0]] for k, w in around.items() if 0 <= i + k < len(blocks)) for i in range(len(blocks))]
    fused = {p: (r * sum(s for s, b in zip(smooth, blocks) if b[0] == p) / len(rows[p])) ** 0.5 for p, r in ratio.items()}
    chosen = {p for p in fused if fused[p] >= 0.35 * max(fused.values())}
    assert all("article" in [t for t, _ in p] for p in chosen)
    return "\n\n".join(text for path, text, _ in blocks if "article" in [t for t, _ in path])


def pages(spark):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]


def test_html_against_plain_path_ratios_whatever_the_class_names(spark):
    rng = random.Random(1)
    for page in pages(spark):
        text = html_text.main_text(page)
        assert text == plain_text(page)
        for name in ("", ' class="' + "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) + '"'):
            assert html_text.main_text(re.sub(r' class="[^"]*"', name, page)) == text
        assert html_text.main_text(page, threshold=0.0) != text  # it is the ratios that decide


def test_html_without_articles_or_telling_names():
    para = "<p>A sentence of some length, with words; and so on, to the end of it. Another one follows, as it does.</p>"
    page = f'<html><body><div class="x1"><a href=1>One</a> <a href=2>Two</a></div><div class="x2"><h1>Title</h1>{para * 3}<ul><li>short</li></ul></div><div class="x3">Small print</div></body></html>'
    want = "\n\n".join(["Title", *[re.sub("<[^>]*>", "", para)] * 3, "short"])
    assert html_text.main_text(page) == want
    form = page.replace("<body>", '<body class="menu-open"><form id=page>').replace("</body>", "</form></body>")
    assert html_text.main_text(form) == want
    lead = f"<article><h1>T</h1><div class=lead><p>Short lead.</p></div><div class=text>{para * 4}<div class=ad>Buy, now, all, this.</div></div></article>"
    assert html_text.main_text(lead).split("\n\n")[:2] == ["T", "Short lead."] and "Buy" not in html_text.main_text(lead)


@pytest.mark.parametrize(
    "page",
    ["<script " * 130000, '<div class="' * 90000, "<div>" * 200000, "<div>x" * 170000, "<b><div>" + "<ul>" * 200000 + "</b>" * 50000, '<a ="<a >" ' * 90000 + "='", "<!--" * 250000, "<li><p>x" * 120000, "<div " + 'a="" ' * 200000 + ">x", "a < " * 250000],
)
def test_html_time_grows_with_length_alone(page):
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 20  # seconds; the square of the length would take hours


def test_html_odd_markup():
    assert html_text.main_text("<p>x, y &#" + "9" * 5000 + ";</p>") == "x, y \ufffd"
    assert html_text.main_text("<p title=don't>one, two.</p><p>it's here, now.</p>") == "one, two.\n\nit's here, now."
    assert html_text.main_text("<p>1 < 2, and 3 > 2.</p>") == "1 < 2, and 3 > 2."
    assert html_text.main_text("<p>kept, yes<script>no") == "kept, yes"
    assert html_text.main_text('<p a="x>y">a, b') == "a, b" and html_text.main_text("<p>" + html.escape("a<b, c") + "</p>") == "a<b, c"


def test_html_rows_with_clashing_columns(spark):
    rows = [(1, "u", "<p>One, two.</p>", "t", 5), (1, "u", "<p>One, two.</p>", "t", 5), (None, None, None, None, None), (3, "u", "", "", 0), (4, "v", "<p>" + "long, " * 200000 + "</p>", "x", 1)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted([(r["page_id"], r["text"][:9], r["n_chars"]) for r in got], key=str) == sorted([(1, "One, two.", 9), (1, "One, two.", 9), (None, "", 0), (3, "", 0), (4, "long, lon", 1199999)], key=str)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


LICENCES = {
    'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.': "unknown",
    "Distributed under the Boost Software License, Version 1.0.": "unknown",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.": "unknown",
    "Licensed under the EUPL, Version 1.2 or later": "unknown",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0": "unknown",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.': "mit",
    'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0': "apache",
    "The man went home.\n\nRedistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the following\nconditions are met.\n\nHe slept.": "bsd",
    "The committee granted permission to publish the book free of charge.": None,
    "Copyright law is a matter of dispute.": None,
    "": None,
    None: None,
}


@pytest.fixture(scope="module")
def classifier(spark):
    return licenses.train(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_licences_unseen_and_wrapped(spark, classifier):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(LICENCES)], "doc_id long, text string, family string")
    got = [(r["doc_id"], r["family"], r["confirmed"]) for r in licenses.scan(df, classifier).orderBy("doc_id", "paragraph").collect()]
    assert got == [(i, f, f != "unknown") for i, f in enumerate(LICENCES.values()) if f]


def plain_scan(docs, c):
    """The scan by its definition, row by row."""
    out = []
    for d, text in docs:
        run, first = [], 0
        for i, line in enumerate([*(text or "").split("\n"), ""]):
            w = [x for x in re.split(r"[^\w]|_", line.lower()) if x]
            if set(w) & set(c.cues):
                first = first if run else i
                run += w
                continue
            grams = {" ".join(run[j : j + n]) for n in (1, 2, 3) for j in range(len(run) - n + 1)}
            hits = [c.vocabulary.index(g) for g in grams if g in c.vocabulary]
            run = []
            if not hits:
                continue
            z = [b + sum(row[j] for j in hits) for row, b in zip(c.weights, c.intercepts)]
            if math.exp(z[-1]) >= sum(map(math.exp, z[:-1])):
                continue
            best = max(range(len(z) - 1), key=lambda k: z[k])
            margin = z[best] - max(x for k, x in enumerate(z[:-1]) if k != best)
            pairs = [(f, {" ".join(p) for p in zip(w, w[1:])}) for f, t in c.templates for w in [licenses._plain(t)]]
            alike = max((len(p & grams) / len(p) for f, p in pairs if f == c.families[best]), default=0.0)
            known = c.families[best] != "unknown" and c.known[0] + c.known[1] * margin + c.known[2] * alike >= 0
            out.append((d, first, c.families[best] if known else "unknown", round(alike, 9), known and alike >= 0.6))
    return sorted(out)


def test_licence_scan_against_plain_scan(spark, classifier):
    rng = random.Random(2)
    notices = [n for own in licenses.NOTICES.values() for n in own] + licenses.OTHERS + licenses.LIKE
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()][:300]
    docs += [(10**6 + i, "\n".join(" ".join(x for x in rng.choice(notices).split() if rng.random() < 0.9) if rng.random() < 0.6 else "Er ging nach Hause." for _ in range(rng.randint(1, 6)))) for i in range(300)]
    docs.append((10**7, "\n".join(["Plain words here."] * 50000 + ["Released under the MIT License."])))
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), classifier).collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"], round(r["similarity"], 9), r["confirmed"]) for r in got) == plain_scan(docs, classifier)
    assert all(0 <= r["probability"] <= 1 for r in got)


def test_letters_are_letters_alone(spark):
    assert not any(map(language_id.has_letter, ["", "½ ² Ⅷ 12_3 ?!", "一"[:0]])) and all(map(language_id.has_letter, ["12a", "²é", "日"]))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(-1, "² ½ Ⅷ 42")], "doc_id long, text string")
    got = language_id.identify(odd, language_id.fit(docs)).first()
    assert got["lang_pred"] == "und" and got["score"] == 0


def test_sample_of_labelled_rows(spark):
    rows = [(i % 50 if i < 300 else i, "aa" if i < 2000 else "bb") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string")
    got = language_id._chosen(df, 100).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got}["bb"] == 100 and all(r["count"] <= 100 for r in got)
    assert language_id._chosen(df, 10**6).count() == df.distinct().count()


def test_without_repeats_carries_columns_as_they_are(spark):
    import datetime

    stamp = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [(i, "x" * 150, stamp, {1: "a"}, {"kept": i, "carry": None}, b"\x00\xff", None, 2**60 + i) for i in range(4)] + [(None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, at timestamp, m map<int,string>, s struct<kept:int,carry:string>, raw binary, kept string, n_bytes long"
    df = spark.createDataFrame(rows, schema).repartition(2)
    got = repeats.without_repeats(df)
    assert got.schema.simpleString() == df.schema.simpleString()
    key = lambda r: str(r["doc_id"])
    for a, b in zip(sorted(got.collect(), key=key), sorted(df.collect(), key=key)):
        assert [a[c] for c in df.columns if c != "text"] == [b[c] for c in df.columns if c != "text"]
    assert sorted(len(r["text"]) for r in got.collect()) == [0, 0, 0, 0, 1]


def test_runs_in_blocks(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    edges = np.array([0, 0, 300, 301, 1700, 2500, 4990, 5000])

    def windows():
        s, e, place, h = repeats.runs(data, edges)
        return {i: (int(p), int(x)) for a, b, p, x in zip(s, e, place, h) for i in range(a, b + 1)}

    whole = windows()
    monkeypatch.setattr(repeats, "BLOCK", 700)
    assert windows() == whole


def test_a_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from unittest import mock

    df = mock.Mock()
    df.sparkSession.sparkContext.getCheckpointDir.return_value = None
    df.sparkSession.conf.get.return_value = None
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        df.sparkSession.sparkContext.master = master
        with pytest.raises(ValueError):
            common.cut(df)


def test_sentencepiece_long_words(spark):
    import base64

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    e = sentencepieces.Encoder(sentencepieces.compile(sentencepieces.default_model()))
    rng = random.Random(1)
    words = [base64.b64encode(rng.randbytes(90000)).decode(), "a" * 9000, "ab" * 8000, " " * 10000, "x" * 9000 + "日" * 500 + "yz" * 3000, "internationalization" * 800]
    words.append("".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(20000)))
    texts = [*words, "short one", words[0][:20000] + " between " + words[6][:9000]]
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == sp.encode(t)


def test_sentencepiece_megabyte_word():
    import sentencepiece

    t = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=1 << 20))
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    began = time.time()
    ids = sentencepieces.Encoder(sentencepieces.compile(sentencepieces.default_model())).encode([t])[0]
    assert time.time() - began < 120 and ids.tolist() == sp.encode(t)


def test_sentencepiece_models_that_it_cannot_take():
    import sentencepiece

    proto = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model()).serialized_model_proto()
    sentencepieces.check_model(proto)
    for extra in (b"\x12\x02\x18\x01", b"\x1a\x03\x12\x01x", b"\x1a\x02\x20\x01", b""):  # unigram, a character map, blanks removed, nothing
        with pytest.raises(ValueError):
            sentencepieces.check_model(proto + extra if extra else b"")


def test_neighbours_of_extreme_norms(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8))
    x[:200] *= 1e25
    x[200:210] *= 1e-30
    x[210] *= 1e5
    x[211] *= 1e150
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(x)] + [(600, [1e-320] + [0.0] * 7, None, 1), (601, [0.0] * 8, None, 1), (602, [float("nan")] * 8, None, 1), (603, None, None, 1), (604, [1.0, None], None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int")
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"))
    assert got.groupBy("query_id").count().where("count <> 20").count() == 0 and got.select("query_id").distinct().count() == 31
    x = np.concatenate([x, [[1e-320] + [0.0] * 7]])
    found = {}
    for r in got.collect():
        assert r["score"] == float((x[r["query_id"]] * x[r["vec_id"]]).sum())
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q, own in found.items():
        best = [v for v in np.lexsort((np.arange(601), -(x * x[q]).sum(1))).tolist() if v != q][:20]
        hits.append(len(own & set(best)))
    assert sum(hits) >= 0.95 * 20 * len(hits)


def test_pipeline_against_brute_force(spark, tmp_path):
    """The four stages by their definitions, on documents with planted copies and passages."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from tests.llm.test_documents import brute_components

    import corpus_pipeline

    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:120]
    base = rows[3][1]
    rows += [(9001, base, "en", "s", 1), (9002, base + " and more", "en", "s", 1), (9003, None, "en", "s", 1), (9004, "12 34", "en", "s", 1), (9005, rows[5][1] + " xyz " + base, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    filters = language_id.fit(df.where(~language_id.is_held_out()))
    known = [r for r in rows if r[1] and language_id.has_letter(r[1]) and filters.rates([r[1]]).max() >= 0.2]
    kept = {d for d, _, c in brute_components(known) if d == c}
    seen, want, t = set(), Counter(), Tokenizer.from_file(token_counts.default_tokenizer())
    for d, text, *_ in sorted(r for r in known if r[0] in kept):
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        left = bytes(x for x, y in zip(raw, gone) if not y).decode("utf-8", "ignore")
        ids = np.array([*t.encode(left, add_special_tokens=False).ids, 0], "<u4")
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert len(known) < len(rows) and len(kept) < len(known)
