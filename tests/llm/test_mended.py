"""Notices side by side, repeated queries, unnamed comments, and columns of any name."""

import math
import time

import pytest

from terrane.llm import html_text, jaccard, language_id, licenses, neighbours


@pytest.fixture(scope="module")
def classifier(spark, sf):
    return licenses.train(spark, spark.read.parquet(f"{sf}/documents.parquet"))


SIDE_BY_SIDE = [
    ("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", [(0, "mit"), (1, "apache")]),
    ("Copyright 2020 Jane Doe. All rights reserved.\nReleased under the MIT License.", [(0, "proprietary"), (1, "mit")]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", [(0, "apache"), (0, "mit")]),
    ("# SPDX-License-Identifier: (GPL-3.0-or-later AND BSD-3-Clause)", [(0, "bsd"), (0, "gpl")]),
    ("This work is licensed under the GNU General Public License, version 3.\nSome lines of code follow.\nAll rights reserved.", [(0, "gpl"), (2, "proprietary")]),
    ("Licensed under CC BY-SA 4.0\nLicensed under CC BY-NC 4.0", [(0, "cc-by"), (1, "cc-by-nc")]),
    ("Copyright (c) 2011, A. All rights reserved.\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met.", [(0, "proprietary"), (1, "bsd")]),
    ("One. This software is licensed under the MIT license. Two. Licensed under the BSD 3-Clause License.", [(0, "bsd"), (0, "mit")]),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal in the Software\nwithout restriction.", [(0, "mit")]),
    ("/* Licensed under the Apache License, Version 2.0 (the License);\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n */", [(0, "apache")]),
]


def test_adjacent_notices_each_have_a_row(spark, classifier):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SIDE_BY_SIDE)], "doc_id long, text string")
    got = licenses.scan(docs, classifier).collect()
    for i, (text, want) in enumerate(SIDE_BY_SIDE):
        assert sorted((r["paragraph"], r["family"]) for r in got if r["doc_id"] == i) == want, text
    assert all(r["confirmed"] for r in got)


def test_a_query_that_is_repeated_is_answered_once(spark):
    rows = [(i, [math.cos(i), math.sin(i), 1.0 + i % 7]) for i in range(200)]
    once = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    names = "shard kind mark width octave first many lo hi rank score query_id".split()
    twice = once.unionByName(once.where("vec_id = 20")).selectExpr("*", *(f"'x' as {n}" for n in names), "1 as `a.b`")
    want = {r["vec_id"] for r in neighbours.nearest(once, once.where("vec_id = 20")).collect()}
    got = neighbours.nearest(twice, twice.where("vec_id % 20 = 0")).collect()
    assert len(got) == 200 == len({(r["query_id"], r["rank"]) for r in got})
    own = {r["vec_id"] for r in got if r["query_id"] == 20}
    assert len(own) == 20 and len(own & want) >= 18 and 20 not in own
    # Two vectors of one id are two queries, with their answers each.
    other = once.unionByName(spark.createDataFrame([(20, [5.0, -1.0, 0.5])], "vec_id long, embedding array<double>"))
    ranks = sorted(r["rank"] for r in neighbours.nearest(other, other.where("vec_id = 20"), k=5).collect())
    assert ranks == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


BODY = "".join(f"<p>{'Words of it, and more. ' * 17}</p>" for _ in range(3))


@pytest.mark.parametrize("around", ["<article><h1>T</h1>{}</article>", "<div><h1>T</h1>{}</div>"])
def test_comments_that_only_a_heading_tells(around):
    def rest(end):
        return html_text.main_text(f"<html><body><nav>Menu</nav>{around.format(BODY + end)}</body></html>").split("\n\n")[4:]

    assert rest("<section><h2>Comments</h2><p>I liked it, really.</p><p>Me too, a lot.</p></section>") == []
    assert rest("<section><h2>3 Comments</h2><div><p>Ann</p><p>I liked it, really.</p></div><div><p>Me too, a lot.</p></div></section>") == []
    assert rest("<h2>Comments (2)</h2><div><b>Ann</b> said: <p>I liked it.</p></div><div><p>Me, too.</p></div>") == []
    assert rest("<h2>Comments</h2><ul><li>I liked it.</li></ul><h2>Sources</h2><p>A book, by X.</p>") == ["Sources", "A book, by X."]
    assert rest("<div><header><h3>Reader comments</h3></header><article><p>I liked it, really.</p></article></div>") == []
    assert rest("<h2>Comments</h2><p>The court made comments, on the law.</p>") == ["Comments", "The court made comments, on the law."]
    assert rest("<section><h2>Comments on the law</h2><p>The court, in its words.</p></section>") == ["Comments on the law", "The court, in its words."]


def test_comments_of_any_depth_take_no_square_of_time():
    began = time.time()
    html_text.main_text(f"<article>{BODY}<h2>Comments</h2>" + "<div>a b, c" * 60_000)
    assert time.time() - began < 10


def test_keep_one_each_carries_any_columns(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 1, 2, "p"), (2, text, 3, 4, "q"), (3, None, 5, 6, "r"), (3, "x", 7, 8, "s"), (3, "y", 9, 9, "t"), (None, text, 0, 0, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `meta.src` int, a int, `a.b` string")
    got = {tuple(r) for r in jaccard.keep_one_each(docs).collect()}
    assert {r for r in got if r[0] != 3} == {rows[0], rows[5]} and len(got) == 3
    again = {tuple(r) for r in jaccard.keep_one_each(docs.orderBy("text").repartition(3)).collect()}
    assert again == got  # of rows with one id it is always the same that stays
    assert jaccard.keep_one_each(docs).columns == docs.columns and jaccard.keep_one_each(docs.limit(0)).collect() == []


def test_no_language_is_learned_from_null_labels(spark):
    docs = spark.createDataFrame([(i, "some words of it " * 4, None) for i in range(30)], "doc_id long, text string, lang string")
    rows = language_id.language_id(docs).collect()
    assert len(rows) == 30 and {r["lang_pred"] for r in rows} == {"und"} and {r["score"] for r in rows} == {0.0}
