"""Stems, and query strings, against plain versions."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from terrane import plans
from terrane.functions import stems
from terrane.operators import catalogue as C

# The method's published examples.
EXAMPLES = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit
operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit sensibility sensibl triplicate triplic formative form formalize formal
electricity electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ homologous homolog effective effect bowdlerize bowdler probate probat
rate rate cease ceas controlling control roll roll interviewing interview readings read a a is is a1s a1s""".split()


def test_stems():
    pairs = list(zip(EXAMPLES[::2], EXAMPLES[1::2], strict=True))
    assert [(w, stems.stem(w)) for w, _ in pairs] == pairs
    assert all(w.startswith(stems.beginning(s)) for w, s in pairs)


DOCS = ["interviews about reading", "Interview, read aloud", "the interviewer reads", "reading of an interview; an interview read twice", "reader and interview", "nothing", None, "", "interviewing readings, interviews-read"]


def found(spark, query, **kw):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, text string")
    return sorted(r["id"] for r in C.search_raw(df, "id", F.col("text"), query, 50, **kw).collect())


def test_words_are_found_by_stem(spark):
    assert found(spark, "interviewing readings") == [0, 1, 2, 3, 8]
    assert found(spark, '"interview reading"') == [1, 2, 3, 8] and found(spark, '"interview reading"', stems=False) == []
    assert found(spark, "interview*") == [0, 1, 2, 3, 4, 8] and found(spark, "interview", stems=False) == [1, 3, 4]
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, text string")
    got = {r["id"]: r["n"] for r in df.select("id", stems.count_stems(F.lower("text"), ["readings"]).alias("n")).collect()}
    assert got == {i: sum(stems.stem(w) == "read" for w in re.findall("[a-z0-9_]+", (t or "").lower())) for i, t in enumerate(DOCS)}


def test_query_strings(spark):
    assert found(spark, "interview NOT aloud", stems=False) == [3, 4]
    assert found(spark, "aloud OR twice AND reading", stems=False) == [1, 3] == found(spark, "aloud OR (twice reading)", stems=False)
    assert found(spark, "(aloud OR twice) NOT (reading OR about)", stems=False) == [1]
    assert C.raw_terms("a b") == ([("a", False), ("b", False)], ("AND", 0, 1))
    assert C.raw_terms('x OR "y  Z" NOT w*')[1] == ("OR", 0, ("NOT", 1, 2)) and C.raw_terms('"y  Z"')[0] == [("y z", False)]
    for bad in ("", "AND a", "a OR", "(a", "a)", 'a "', "NOT a", '""', "a + b"):
        with pytest.raises(ValueError):
            C.raw_terms(bad)


def test_ranks_that_are_equal_when_rounded_go_by_key(spark, tmp_path):
    texts = ["the licensed " * (2000 + i) for i in range(60)] + [None, "", "the \u0130stanbul L\u0130CENSED", "th rights\n reserved"] + ["other words"] * 90
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(plans.ORACLES["search_raw"]).fetchall()
    assert len({rank for _, rank in want}) < 50 == len(want)
    assert [(r["doc_id"], r["rank"]) for r in plans.QUERIES["search_raw"](spark, str(tmp_path)).collect()] == want
