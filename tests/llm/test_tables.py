"""Pages, embeddings, the pipeline, and the registered queries."""

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from terrane.llm import html_text, neighbours


def test_main_text_of_pages():
    page = """<html><body class="nav-open"><div id="header">Site</div><nav><a href=/>Home</a></nav>
    <div class="ad">Buy this, now. It is cheap.</div><article><header><h1>The  title</h1></header><p>One &amp; two,
    three.<p>Four<br>five <b>six</b>.</p><script>var x = "</p>";</script><ul><li>An item.</li></ul></article>
    <div class="comments"><p>A reader said this, and much more.</p></div><form>Search</form><footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page) == "The title\n\nOne & two, three.\n\nFour five six.\n\nAn item."
    assert html_text.main_text("") == "" and html_text.main_text("<nav>Menu</nav>") == ""
    assert html_text.main_text("plain words, no markup") == "plain words, no markup"
    plain = "<body><div class=top><a href=a>A</a> <a href=b>B</a></div><div><p>A long paragraph, with commas, and more.</p><p>Another one, as long as that.</p></div><div>Short</div></body>"
    assert html_text.main_text(plain) == "A long paragraph, with commas, and more.\n\nAnother one, as long as that."


def test_main_text_of_split_articles():
    text = "".join(f"<p>{'Words of it, and more. ' * 17}</p>" for _ in range(3))
    parts = ["Words of it, and more. " * 16 + "Words of it, and more."] * 3
    lead = f"<article><h1>T</h1><div class=lead><p>Short lead here.</p></div><div class=text>{text}</div></article>"
    assert html_text.main_text(lead).split("\n\n") == ["T", "Short lead here.", *parts]
    bare = f"{text}<blockquote>Quoted.</blockquote><table><tr><td>Cell</td></tr></table>"
    nav = "<div><a href=/a>Home</a> <a href=/b>About us</a></div>"
    for page in (bare, nav + bare, f"<html><body>{nav}{bare}</body></html>"):
        assert html_text.main_text(page).split("\n\n") == [*parts, "Quoted.", "Cell"]
    for around in ("<form id=page>", "<div class=with-sidebar>"):
        page = f"<body>{around}<nav>Menu</nav><article><h1>T</h1>{text}</article><div class=comments>{text * 2}</div></{around[1:5].strip()}></body>"
        assert html_text.main_text(page).split("\n\n") == ["T", *parts]


def test_extract_edges(spark):
    rows = [(1, "u", None, 3), (None, None, "<p>x, y.", None), (2, "u", "", 1), (2, "u", "<script>never closed", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect()}
    assert got == {(1, "u", "", 0), (None, None, "x, y.", 5), (2, "u", "", 0)}
    assert html_text.extract(df.limit(0)).collect() == []


def brute(vectors, ids, queries, k):
    out = {}
    for q in queries:
        v = vectors[ids.index(q)]
        out[q] = sorted(((-float(np.dot(v, x)), i) for x, i in zip(vectors, ids) if i != q))[:k]
    return out


def test_neighbours_edges(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)).astype(np.float32).astype(float)
    rows = [(i, [float(v) for v in x[i % 30]], 1) for i in range(40)]
    rows += [(100, None, 1), (101, [0.0, 0.0, 0.0], 1), (102, [1.0, None, 1.0], 1), (103, [1.0, float("nan"), 1.0], 1), (104, [1.0, 2.0], 1), (None, [1.0, 1.0, 1.0], 1), (120, [float("inf"), 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=5).collect()
    want = brute([np.array(r[1]) for r in rows[:40]], list(range(40)), [0, 20], 5)
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in got} == {(q, i + 1): v for q, own in want.items() for i, (_, v) in enumerate(own)}
    assert neighbours.nearest(df.limit(0), df).collect() == [] and neighbours.nearest(df, df.limit(0)).collect() == []
    few = neighbours.nearest(df.where("vec_id < 4"), df.where("vec_id = 0"), k=20).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3]


def test_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = __spark_entry__.queries()["op5_nearest_neighbours"](spark, "/root/testdata/sf0.1").collect()
    rows = df.collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    q = np.flatnonzero(ids % 20 == 0)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    best = {int(ids[i]): set(ids[np.argsort(-row)[:20]].tolist()) for i, row in zip(q, s)}
    assert np.mean([r["vec_id"] in best[r["query_id"]] for r in got]) >= 0.9 and len(got) == 20 * len(q)
    at = {int(v): i for i, v in enumerate(ids)}
    assert all(abs(r["score"] - x[at[r["query_id"]]] @ x[at[r["vec_id"]]]) < 1e-12 for r in got)


def test_neighbours_many_equal_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(1000 + i, [0.5, float(i)]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.where("vec_id = 200"), k=20).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(20))


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n.startswith("op")])
def test_queries_run(spark, sf, name):
    assert __spark_entry__.queries()[name](spark, sf).count() > 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    state, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = corpus_pipeline.cut(stage(spark, state, sf))
        assert state.columns == docs.columns, name
        counts.append(state.count())
    assert docs.count() >= counts[0] >= counts[1] == counts[2] > 0
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in state.select("doc_id").collect()}
