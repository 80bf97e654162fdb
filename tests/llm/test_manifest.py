"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import duckdb
import pytest

import __spark_entry__
from terrane.llm import manifest, queries


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(*values):
    return sha("".join(map(field, values)))


def plain_tree(hashes):
    """The root, and for each leaf its siblings, to the left and to the right, from level to level."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for path, i in zip(paths, at, strict=True):
            first = i - i % 3
            path.append(("".join(hashes[first:i]), "".join(hashes[i + 1 : first + 3])))
        hashes = [sha("".join(hashes[i : i + 3])) for i in range(0, len(hashes), 3)]
        at = [i // 3 for i in at]
    return hashes[0], paths


def plain_rows(docs):
    leaves = [(plain_leaf(*d), d) for d in docs]
    sources = sorted({d[1] for d in docs}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((x for x in leaves if x[1][1] == s), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees.append((own, *plain_tree([h for h, _ in own])))
    root, tops = plain_tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops, strict=True):
        for (h, d), path in zip(own, paths, strict=True):
            path = path + top
            even = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0
            fold = plain_leaf(*d[:4], d[4].replace("\n", "")) if even and d[4] is not None else h
            for left, right in path:
                fold = sha(left + fold + right)
            out.append((d[0], h, subroot, root, sha("".join(a + b for a, b in path)), fold, fold == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def compared(spark, docs):
    got = manifest.audit(spark.createDataFrame(docs, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_rows(docs), key=str)


def test_nulls_ties_and_repeated_rows(spark):
    docs = [(1, None, None, None, None), (None, "", "en", 3, "a\nb"), (None, "", "en", 3, "a\nb"), (2, "é", None, 0, ""), (2, "é", "de", 0, "x\n\ny"), (-7, "z", "fr", -2, "\n"), (3, "z", "-", 9, "1:1"), (12, "0", "", 1, None)]
    docs += [(5, "e", "en", 1, f"t\n{k % 2}") for k in range(8)]
    compared(spark, docs)
    assert manifest.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    compared(spark, docs[:1])


@pytest.mark.parametrize("block", [1, 2, 7])
def test_rounds_of_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(manifest, "LEVELS", block)
    monkeypatch.setattr(manifest, "BLOCK", 3**block)
    sizes = {"one": 1, "two": 2, "three": 3, "four": 4, "ten": 10, "last alone": 28, "hot": 83}
    docs = [(k * 7 % 1000, s, "en", k, f"line {k}\nof {s}\n" * (k % 3)) for s, n in sizes.items() for k in range(n)]
    compared(spark, docs if block > 1 else docs[:60])


def test_other_columns_stay_out(spark):
    names = ["_key", "_at", "_n", "_hash", "_part", "_row", "leaf", "root", "path", "_claimed", "a.b"]
    docs = spark.createDataFrame([(1, "s", "en", 1, "t\n", *names), (2, "s", "en", 1, "u", *names)], SCHEMA + "".join(f", `{n}` string" for n in names))
    assert sorted(map(tuple, manifest.audit(docs).collect())) == sorted(plain_rows([(1, "s", "en", 1, "t\n"), (2, "s", "en", 1, "u")]))


def test_a_path_leads_from_the_leaf_to_the_root(spark):
    docs = spark.createDataFrame([(k, f"s{k % 4}", "en", k, "t") for k in range(40)], SCHEMA)
    rows = manifest.manifest(docs.withColumn("note", docs.n_chars), ["note"])
    assert rows.where(manifest.folded(rows.leaf, rows.path) != rows.root).count() == 0 and {r["note"] for r in rows.collect()} == set(range(40))


def test_whole_table_and_its_sql(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted(map(tuple, __spark_entry__.queries()["op11_merkle_manifest"](spark, sf).collect()))
    assert got == sorted(plain_rows(docs))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(con.execute(queries.ORACLES["op11_merkle_manifest"]).fetchall()) == got
