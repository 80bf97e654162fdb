"""What a licence classifier takes from a corpus comes from all of it."""

import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrane.llm import licenses

# The first 3,000 paragraphs have no word of a notice, the next ones have two.
TEXTS = ["Er ging nach Hause.\n\n"] * 3000 + ["Permission came with that warranty.\r\n ... \n"] * 2000 + ["My warranty ended.\nSublicense nothing, sell all", "", None] * 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).cache()


def lines():
    return [w for text in TEXTS for line in (text or "").split("\n") if (w := re.findall(r"[^\W_]+", line.lower()))]


def test_cues_are_counted_in_all_paragraphs(spark, docs):
    cues, n = licenses.find_cues(docs, 2000)
    assert n == len(lines()) == 5004
    own = [set(licenses._plain(t)) for t in [*licenses.OTHERS, *(t for texts in licenses.NOTICES.values() for t in texts)]]
    words = {w for ws in own for w in ws if not w.isdigit() and (len(w) > 2 or w in ("cc", "nc"))}
    alike = Counter(w for t in licenses.LIKE for w in set(licenses._plain(t)))
    held = Counter(w for ws in lines() for w in set(ws))
    assert cues == sorted(w for w in words if sum(w in ws for ws in own) / len(own) >= 5 * (held[w] + 1) / n and alike[w] <= 2)
    assert "warranty" not in cues and "sell" in cues


def test_training_sees_all_paragraphs(spark, docs):
    classifier = licenses.train(spark, docs)
    assert not {"permission", "warranty"} & set(classifier.cues) and "sublicense" in classifier.cues
    back = licenses.train(spark, docs.orderBy(-docs.doc_id).coalesce(1))
    assert back.cues == classifier.cues and back.vocabulary == classifier.vocabulary
    assert back.weights == [pytest.approx(row, abs=1e-6) for row in classifier.weights]


def test_examples_of_none_are_all_plain_paragraphs(spark, docs):
    vocabulary = ["sublicense", "warranty", "warranty ended", "that warranty"]
    got = licenses.plain_paragraphs(docs, ["sell", "sublicense", "warranty"], vocabulary, 5004).collect()
    assert {tuple(r["grams"]): r["number"] for r in got} == {(): 3000, ("that warranty", "warranty"): 2000, ("warranty", "warranty ended"): 2}


def test_training_on_no_paragraph(spark, docs):
    classifier = licenses.train(spark, docs.where("text is null or text = ''"))
    notice = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert [(r["family"], r["confirmed"]) for r in licenses.scan(notice, classifier).collect()] == [("mit", True)]


def test_lines_are_cut_in_time_that_grows_with_them_alone(spark):
    """12 MB of prose before an SPDX expression: no look back of 200 characters from each one."""
    line = "All of this is prose. " * 50
    docs = spark.range(10800).select("id", F.concat(F.lit(line), F.col("id").cast("string"), F.lit(" SPDX-License-Identifier: MIT OR GPL-2.0 AND MPL-2.0")).alias("line"))
    start = time.monotonic()
    got = docs.coalesce(1).select(licenses.pieces(F.col("line")).alias("p")).agg(F.min(F.size("p")), F.max(F.size("p")), F.sum(F.size(F.element_at("p", -1)["words"]))).first()
    assert tuple(got) == (3, 3, 10800 * 6)
    assert time.monotonic() - start < 25
