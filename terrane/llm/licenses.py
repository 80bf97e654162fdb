"""Licence scans: a trained paragraph classifier over sparse word n-grams.

A multinomial logistic regression (L1 and L2) is trained on notices of each licence family and
variants of them, on notices of minor licences as the class `unknown`, on sentences that only sound
alike, and on all of the corpus's paragraphs with one cue word at most, equal features being one row with
their number as its weight. Its features are n-grams of 1 to 3 words
with at least one cue word: a word much more frequent in the notices than in the corpus's paragraphs. Lines without a cue
word are surely no licence and are left out before any n-gram is made; adjacent lines with cue
words are one paragraph, so that a wrapped notice is, until words come that open another notice: at
the start of a line or sentence, or as a further licence of an SPDX expression.

Two things are calibrated on notices and whole families that three further models have not seen:
the temperature of the probabilities, and how likely it is, given a family's probability and the
paragraph's likeness to that family's notices, that the family is a known one at all. Below a half
the paragraph is `unknown`. A prediction is confirmed if a notice of its family is largely contained
in the paragraph.

Scoring is row by row in DataFrame functions, with no shuffle and no Python.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import cut

NONE, UNKNOWN = "none", "unknown"

# Common notices of licence families.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Released under the GNU GPL version 2.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is Incompatible With Secondary Licenses, as defined by the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under CC BY-NC-SA 4.0 for noncommercial use.",
        "Licensed under CC BY-NC-ND 4.0.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
        "This document is proprietary and confidential; unauthorized copying is prohibited.",
    ],
}
# Sentences that share words with licences but are none.
LIKE = [
    "The driver lost his license after the second accident.",
    "The new version was released to the public last week.",
    "She was granted permission to leave without conditions.",
    "The general told the public that the work was free of charge.",
    "All copies of the book were distributed in the town.",
    "They reserved a table and had every right to it.",
    "The warranty on the machine ended two years ago.",
    "A common source of error is the form of the question.",
    "He works for the foundation and uses its software for a particular purpose.",
    "Human rights are a domain of international law.",
    "The Apache people lived on the plains.",
    "He studied at MIT and wrote about creative writing.",
    "The file was copied without notice to the author.",
    "Attribution of the painting is in doubt.",
    "Any person may obtain the documentation from the office.",
    "The list of conditions was modified in writing.",
    "Fishing is licensed by the state and tickets are available at the gate.",
    "The corporation agreed to publish a part of the agreement.",
]
# Notices of licences that belong to none of the families.
OTHERS = [
    "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0; you may not use this file except in compliance with it.",
    "Licensed under the Microsoft Public License (Ms-PL).",
    "Licensed to the foundation under a contributor agreement; see the Python Software Foundation License Version 2.",
    "This product includes software developed by the project for use in the toolkit; it is distributed under the OpenSSL License.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "The source is made available under the Business Source License 1.1; production use requires a commercial license.",
    "Permission to use, copy, and distribute this font for any purpose and without a fee is hereby granted, provided that this notice is retained.",
    "This library is provided by the authors without any warranty, and they are not liable for damages; altered versions must be marked as such.",
    "SPDX-License-Identifier: PostgreSQL",
    "Released under the W3C Software Notice and License.",
]

# How notices begin.
OPENINGS = [
    "copyright (?:\\(c\\)|©|[0-9]{4})", "all rights reserved", "spdx-license-identifier", "licen[sc]e: ",
    "(?:dual[- ])?licensed (?:under|to)", "released (?:under|into)", "distributed under", "(?:made )?available under", "dedicated to", "permission is hereby granted", "permission to use",
    "redistribution and use in", "redistributions? of source", "use of this source code", "everyone is permitted", "to the extent possible under law", "no part of this",
    "th(?:is|e) [^.;\n]{0,60}?\\b(?:is|are|under) (?:dual[- ])?(?:licensed|released|distributed|governed|dedicated|free (?:and|software)|made available|available|subject|proprietary)",
    "(?:th(?:is|e) )?text is available under",
]
_MARK = "\x01"
# In one line, where a notice begins: after white space and signs, at the line's start or a sentence's.
_OPENS = r"(?i)(?:^|(?<=[.;!?])\s)[^\p{L}\p{N}©]*(?:" + "|".join(OPENINGS).replace("all rights", "(?<![.;!?]\\s)all rights") + ")"
# The look ahead changes no match, but spares the look back wherever no OR or AND follows.
_FURTHER = r"(?=\s+(?:OR|AND)\s)(?<=(?i:spdx-license-identifier):[^\x01]{0,200})\s+(?:OR|AND)\s+"


def _split(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def words(text: Column) -> Column:
    """Lower-case words (letters and digits) of a text; text before the first is not one."""
    return F.filter(_split(text), lambda w: w != "")


def ngrams(w: Column, longest: int = 3) -> Column:
    """The distinct n-grams of 1 to longest words."""

    def of(n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(w, i, n)))

    return F.array_distinct(F.concat(w, *map(of, range(2, longest + 1))))


def _array(values) -> Column:
    kind = "array<string>" if values and isinstance(values[0], str) else "array<double>"
    return F.from_json(F.lit(json.dumps(values)), kind)


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


@dataclass
class Classifier:
    """families (the last two are UNKNOWN and NONE), cue words, n-grams with their weights, templates
    (family and notice), the temperature, and the calibration of a known family."""

    families: list[str]
    cues: list[str]
    vocabulary: list[str]
    weights: list[list[float]]  # a row per family
    intercepts: list[float]
    templates: list[tuple[str, str]]
    temperature: float
    known: tuple[float, float, float]  # weights of 1, the margin over the next family, the similarity


def _variants(text: str) -> list[str]:
    w = text.split()
    cuts = [w, w[1:], w[:-1], w[2:], w[: max(3, len(w) * 7 // 10)], w[len(w) * 3 // 10 :], ["Note:", *w], [*w, "See", "below."]]
    return [" ".join(c) for c in cuts if len(c) >= min(2, len(w))]


def _plain(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def find_cues(docs: DataFrame, prior: int, lift: float = 5.0) -> tuple[list[str], int]:
    """Words that are at least `lift` times as frequent in the notices as in all of the corpus's paragraphs
    (lines with a word; fewer than `prior` count as so many), and in few of the sentences that only sound
    alike. The number of those paragraphs, too. Sent to the driver: the notices' words, and their counts."""
    notices = [set(_plain(t)) for t in [*OTHERS, *(t for texts in NOTICES.values() for t in texts)]]
    own = Counter(w for ws in notices for w in ws if not w.isdigit() and (len(w) > 2 or w in ("cc", "nc")))
    lines = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line")).where(F.col("line").rlike(r"[\p{L}\p{N}]"))
    held = F.array_distinct(F.filter(_split(F.col("line")), lambda w: w.isin(sorted(own))))
    rows = lines.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("w"))  # "" is in each
    common = {r["w"]: r["n"] for r in rows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = common.get("", 0)
    alike = Counter(w for t in LIKE for w in set(_plain(t)))
    return sorted(w for w, k in own.items() if k / len(notices) >= lift * (common.get(w, 0) + 1) / max(n, prior) and alike[w] <= len(LIKE) // 8), n


def plain_paragraphs(docs: DataFrame, cues: list[str], vocabulary: list[str], n: int) -> DataFrame:
    """grams (those of the vocabulary, sorted) and how many of the corpus's n paragraphs have them, of those
    with one cue word at most. Without a cue word there are none: these are n less the others."""
    lines = _with_cues(docs, cues).select(F.explode("kept.line").alias("line")).select(words(F.col("line")).alias("words"))
    one = F.size(F.array_intersect("words", _array(cues))) == 1
    grams = F.when(one, F.array_sort(F.array_intersect(ngrams(F.col("words")), _array(vocabulary))))
    counts = cut(lines.groupBy(grams.alias("grams")).agg(F.count(F.lit(1)).alias("number")))
    rest = counts.agg((F.lit(n) - F.coalesce(F.sum("number"), F.lit(0))).alias("number")).select(F.array().cast("array<string>").alias("grams"), "number")
    return counts.where("grams is not null").unionByName(rest.where("number > 0"))


def _pairs(text: str) -> set[str]:
    w = _plain(text)
    return {" ".join(p) for p in zip(w, w[1:], strict=False)}


def train(spark: SparkSession, docs: DataFrame, prior: int = 2000) -> Classifier:
    """A classifier from the notices and all paragraphs of the corpus, which weigh as much as `prior`
    examples together (each as one, if they are fewer).

    Of those, paragraphs with at most one cue word are examples of NONE. Three models, each without
    a third of the families and a quarter of the other families' notices, calibrate it.
    """
    cues, n = find_cues(docs, prior)
    families = [*NOTICES, UNKNOWN, NONE]
    notices = [(k, i, t) for k, texts in enumerate({**NOTICES, UNKNOWN: OTHERS, NONE: LIKE}.values()) for i, t in enumerate(texts)]
    variants = [(k, i, v) for k, i, t in notices for v in _variants(t)]
    own = [{"label": float(k), "place": i, "n": n, "text": v} for n, (k, i, v) in enumerate(variants)]
    named = _rows(spark, own, "label double, place int, n int, text string").select("label", "place", "n", words(F.col("text")).alias("words"))
    named = named.select("label", "place", "n", ngrams(F.col("words")).alias("grams"), F.lit(1.0).alias("weight")).coalesce(1).cache()
    is_cue = F.exists(F.split("g", " "), lambda w: F.array_contains(_array(cues), w))
    vocabulary = [r["g"] for r in named.where(F.col("label") <= len(NOTICES)).select(F.explode("grams").alias("g")).distinct().where(is_cue).orderBy("g").collect()]
    plain = plain_paragraphs(docs, cues, vocabulary, n).withColumn("weight", F.col("number") * min(1.0, prior / max(n, 1))).sortWithinPartitions("grams")
    rows = named.unionByName(plain.select(F.lit(float(len(NOTICES) + 1)).alias("label"), F.lit(-1).alias("place"), F.lit(-1).alias("n"), "grams", "weight"))
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", minTF=0.0)
    counted.setBinary(True)
    data = counted.transform(rows).select("label", "place", "n", "features", "weight").cache()
    learner = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.001, elasticNetParam=0.2, standardization=False)

    tried: list[tuple[int, int, float, float, list[float]]] = []  # true and predicted label, margin, similarity, evidence
    for fold in range(3):
        gone = [k for k in range(len(NOTICES)) if k % 3 == fold]
        apart = F.col("label").isin(gone) | (F.col("place") % 4 == fold) & (F.col("place") >= 0)
        seen = data.where(~apart)
        found = learner.copy({learner.maxIter: 20}).fit(seen).transform(data.where(apart & (F.col("n") >= 0)))
        templates = [(k, _pairs(t)) for k, i, t in notices if k < len(NOTICES) and k not in gone and i % 4 != fold]
        for r in found.select("n", vector_to_array("rawPrediction").alias("z")).collect():  # the variants of notices
            k, _, text = variants[r["n"]]
            z = [x if j not in gone else -50.0 for j, x in enumerate(r["z"])]
            order = sorted(range(len(families) - 1), key=lambda j: -z[j])
            held = _pairs(text)
            similarity = max((len(pairs & held) / len(pairs) for j, pairs in templates if j == order[0]), default=0.0)
            tried.append((len(NOTICES) if k in gone else k, order[0], z[order[0]] - z[order[1]], similarity, z))

    def loss(t: float) -> float:
        return sum(math.log(sum(math.exp((x - max(z)) / t) for x in z)) - (z[k] - max(z)) / t for k, *_, z in tried)

    temperature = min((0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss)
    truth = [{"label": float(k == best), "margin": margin, "similarity": similarity} for k, best, margin, similarity, _ in tried if best < len(NOTICES) and k <= len(NOTICES)]
    known = LogisticRegression(regParam=0.01, maxIter=30).fit(_rows(spark, truth, "label double, margin double, similarity double").select("label", array_to_vector(F.array("margin", "similarity")).alias("features")).cache())
    model = learner.copy({learner.maxIter: 45}).fit(data)
    data.unpersist()
    named.unpersist()
    weights = model.coefficientMatrix.toArray()
    used = [j for j in range(len(vocabulary)) if abs(weights[:, j]).max() > 1e-6]
    return Classifier(
        families,
        cues,
        [vocabulary[j] for j in used],
        [[float(x) for x in row[used]] for row in weights],
        [float(x) for x in model.interceptVector],
        [(families[k], t) for k, _, t in notices if k < len(NOTICES)],
        temperature,
        (float(known.intercept), *(float(x) for x in known.coefficients)),
    )


def pieces(line: Column) -> Column:
    """A line, cut where notices begin: an array of opens (whether one begins there) and words."""
    marked = F.regexp_replace(F.regexp_replace(line, _FURTHER, _MARK + "SPDX-License-Identifier: "), _OPENS, _MARK + "$0")
    return F.transform(F.filter(F.split(marked, _MARK), lambda p: p != ""), lambda p, k: F.struct(((k > 0) | F.startswith(marked, F.lit(_MARK))).alias("opens"), words(p).alias("words")))


def _with_cues(docs: DataFrame, cues: list[str]) -> DataFrame:
    """doc_id and kept: number (from 0) and text of the lines with cue words, of the texts that have any."""

    def holds(text: Column) -> Column:
        return F.arrays_overlap(_split(text), _array(cues))

    text = F.col("text").cast("string")
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    return docs.where(holds(text)).select(F.col("doc_id").cast("long").alias("doc_id"), F.inline(F.array(F.struct(F.filter(lines, lambda x: holds(x["line"])).alias("kept")))))


def candidates(docs: DataFrame, cues: list[str]) -> DataFrame:
    """doc_id, paragraph (its first line's number) and words of each run of lines with cue words, cut
    where another notice begins."""
    some = _with_cues(docs, cues)
    cut_up = F.flatten(F.transform("kept", lambda x: F.transform(pieces(x["line"]), lambda p: F.struct(x["i"].alias("i"), p["opens"].alias("opens"), p["words"].alias("words")))))
    some = some.where(F.size("kept") > 0).select("doc_id", F.inline(F.array(F.struct(cut_up.alias("lines")))))
    places = F.sequence(F.lit(1), F.size("lines"))
    first = F.filter(places, lambda k: (k == 1) | F.element_at("lines", k)["opens"] | (F.try_element_at("lines", k - 1)["i"] < F.element_at("lines", k)["i"] - 1))
    some = some.where(F.size("lines") > 0).select("doc_id", "lines", F.explode(F.transform(first, lambda k, j: F.struct(k.alias("k"), (F.coalesce(F.try_element_at(first, j + 2), F.size("lines") + 1) - k).alias("n")))).alias("run"))
    return some.select("doc_id", F.element_at("lines", F.col("run.k"))["i"].alias("paragraph"), F.flatten(F.transform(F.slice("lines", F.col("run.k"), F.col("run.n")), lambda x: x["words"])).alias("words"))


def _scored(df: DataFrame, c: Classifier, *keep: str) -> DataFrame:
    """The columns keep of df (which has grams, too), z (evidence for each family, by place), best (the
    place, from 1, of the likeliest but for NONE), margin (of its z over the next), similarity (share of
    the best of its notices' word pairs that grams hold; null for UNKNOWN). Rows without features go."""
    # Rows made by inline are what later filters see: they aren't pushed below, to work n-grams out twice.
    found = F.transform(F.array_intersect("grams", _array(c.vocabulary)), lambda g: F.array_position(_array(c.vocabulary), g).cast("int"))
    hits = df.select(*keep, F.inline(F.array(F.struct("grams", found.alias("hits"))))).where(F.size("hits") > 0)

    def evidence(row: list[float], intercept: float) -> Column:
        return F.aggregate("hits", F.lit(intercept), lambda a, i: a + F.element_at(_array(row), i))

    z = hits.select(*keep, F.inline(F.array(F.struct("grams", F.array(*map(evidence, c.weights, c.intercepts)).alias("z")))))
    ordered = F.sort_array(F.slice("z", 1, len(c.families) - 1), asc=False)
    best = z.withColumn("ordered", ordered).select(*keep, "grams", "z", F.array_position("z", F.element_at("ordered", 1)).cast("int").alias("best"), (F.element_at("ordered", 1) - F.element_at("ordered", 2)).alias("margin"))
    templates = F.from_json(F.lit(json.dumps([{"place": c.families.index(f) + 1, "pairs": sorted({" ".join(p) for p in zip(w, w[1:], strict=False)})} for f, t in c.templates for w in [_plain(t)]])), "array<struct<place: int, pairs: array<string>>>")
    shares = F.transform(F.filter(templates, lambda n: n["place"] == F.col("best")), lambda n: F.size(F.array_intersect(n["pairs"], F.col("grams"))) / F.size(n["pairs"]))
    return best.select(*keep, "z", "best", "margin", F.array_max(shares).alias("similarity"))


def scan(docs: DataFrame, classifier: Classifier, confirm: float = 0.6) -> DataFrame:
    """The paragraphs that are licence notices, in whole texts: doc_id, paragraph, family,
    probability, similarity (share of the best notice's word pairs that the paragraph holds) and
    confirmed (similarity >= confirm).

    A paragraph is a run of adjacent lines with cue words, cut where words open another notice (so a line
    may hold several), named by its first line (from 0). It has one row, and is left out if NONE is likelier than every
    family together; `unknown` are licences of no known family, with the probability of the likeliest.
    Null or empty texts and empty tables give no rows; repeated documents each give theirs; very long
    texts are read whole, line by line; of equally likely families the first is taken; extra columns
    are left out.
    """
    c = classifier
    rows = candidates(docs, c.cues).select("doc_id", "paragraph", F.inline(F.array(F.struct(ngrams(F.col("words")).alias("grams")))))
    scored = _scored(rows, c, "doc_id", "paragraph")

    def shares(t: float) -> Column:
        e = F.transform("z", lambda x: F.exp((x - F.array_max("z")) / t))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))

    scored = scored.select("*", F.inline(F.array(F.struct(shares(1.0).alias("raw"), shares(c.temperature).alias("p"))))).where(F.element_at("raw", len(c.families)) < 0.5)
    known = c.known[0] + c.known[1] * F.col("margin") + c.known[2] * F.col("similarity") >= 0
    return scored.select(
        "doc_id",
        "paragraph",
        F.when(known, F.element_at(_array(c.families), F.col("best"))).otherwise(UNKNOWN).alias("family"),
        F.element_at("p", F.col("best")).alias("probability"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    ).withColumn("confirmed", (F.col("similarity") >= confirm) & (F.col("family") != UNKNOWN))


def license_scan(docs: DataFrame) -> DataFrame:
    """Trains on the notices and all of docs, then scans all of docs."""
    return scan(docs, train(docs.sparkSession, docs))
