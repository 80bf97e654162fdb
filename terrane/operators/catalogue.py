"""Catalogue of data dictionaries: scoped listings, features, search, differences of versions.

Tables: feature (dataset, version, table_name, name, definition, ...), tbl (dataset, version,
table_name, role, path, n_rows, n_cols, title) and document (dataset, version, title, path).
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import stems as stem
from terrane.functions.text import collapsed, key_of
from terrane.functions.versions import version_key


def latest_versions(df: DataFrame) -> DataFrame:
    """dataset and its latest version."""
    return df.groupBy("dataset").agg(F.max(version_key(F.col("version"))).alias("k")).select("dataset", F.col("k.version").alias("version"))


def scope(df: DataFrame, dataset: str | None = None, version: str | None = None, all_versions: bool = False) -> DataFrame:
    """The (dataset, version) pairs that a query looks at: all, a pinned one, or the latest."""
    if version is not None and dataset is None:
        raise ValueError("a version needs its dataset")
    own = df.where(F.col("dataset") == dataset) if dataset is not None else df
    pairs = own.select("dataset", "version").distinct()
    if version is not None:
        return pairs.where(F.col("version") == version)
    return pairs if all_versions else latest_versions(pairs)


def in_scope(df: DataFrame, pairs: DataFrame) -> DataFrame:
    return df.join(pairs, ["dataset", "version"], "left_semi")


def list_tables(tbl: DataFrame, pairs: DataFrame, role: str | None = None, grep: str | None = None) -> DataFrame:
    """A row per table of the scope: title, roles, rows, columns and files. Filters come first."""
    rows = in_scope(tbl, pairs)
    if role is not None:
        rows = rows.where(F.col("role") == role)
    if grep is not None:
        rows = rows.where(F.lower("table_name").contains(grep.lower()) | F.lower("title").contains(grep.lower()))
    return rows.groupBy("dataset", "version", "table_name").agg(
        F.max("title").alias("title"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.sum("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"), F.count(F.lit(1)).alias("n_files")
    )


def describe(feature: DataFrame, table_name: str, limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of a table's features in order of uid, and one row with their number."""
    own = feature.where(F.col("table_name") == table_name)
    return own.orderBy("uid").offset(offset).limit(limit), own.agg(F.count(F.lit(1)).alias("total"))


def datasets(dataset: DataFrame, version: DataFrame, feature: DataFrame) -> DataFrame:
    """Each dataset with the numbers of its versions and features; none is 0."""
    v = version.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_versions"))
    f = feature.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_features"))
    return dataset.join(v, "dataset", "left").join(f, "dataset", "left").fillna(0, ["n_versions", "n_features"])


def versions(feature: DataFrame) -> DataFrame:
    """Each version with the numbers of its tables and features."""
    return feature.groupBy("dataset", "version").agg(F.count_distinct("table_name").alias("n_tables"), F.count(F.lit(1)).alias("n_features"))


def find_feature(feature: DataFrame, key: str, pairs: DataFrame | None = None) -> DataFrame:
    """Features whose name, qualified id or table.name is the key."""
    rows = in_scope(feature, pairs) if pairs is not None else feature
    return rows.where((F.col("name") == key) | (F.col("qualified_id") == key) | (F.concat_ws(".", "table_name", "name") == key))


def find_features(feature: DataFrame, keys: DataFrame) -> DataFrame:
    """key and the features that find_feature() gives for it, for many keys (column key) at once: one
    equality join for each way to name a feature."""
    ways = (F.col("name"), F.col("qualified_id"), F.concat_ws(".", "table_name", "name"))
    named = feature.withColumn("key", F.explode(F.array_distinct(F.array(*ways))))
    return named.join(keys.select("key").distinct(), "key")


def list_documents(document: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents of a scope, in order."""
    return in_scope(document, pairs).orderBy("dataset", "version", "title", "path")


def table_names(feature: DataFrame, dataset: str, version: str) -> DataFrame:
    """The tables that a version's features name."""
    return feature.where((F.col("dataset") == dataset) & (F.col("version") == version)).select("table_name").distinct()


def type_of(field_type: Column, measurement_scale: Column) -> Column:
    """A feature's type as shown: its field type, else its measurement scale."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in (field_type, measurement_scale)), F.lit(""))


def resolve_tables(files: DataFrame, features: DataFrame, folders: dict[str, list[str]], version: str) -> tuple[DataFrame, DataFrame]:
    """Tables of a version's files (path, n_rows, n_cols), each with its stem, role and the dictionary's
    table; and the features, under the stem of the table that their sheet is bound to."""
    stem = strip_version(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), version)
    tables = files.withColumn("stem", stem).withColumn("role", role_of(F.col("path"), folders))
    bound = bind_stems(tables.select("stem").distinct(), features.select(F.col("table_name").alias("sheet")).distinct())
    out = tables.join(bound, "stem", "left").withColumn("table_name", F.col("stem"))
    renamed = bound.where("sheet is not null").groupBy(F.col("sheet").alias("table_name")).agg(F.min("stem").alias("_stem"))
    keyed = features.join(renamed, "table_name", "left").withColumn("table_name", F.coalesce("_stem", "table_name")).drop("_stem")
    return out, keyed


def role_of(path: Column, folders: dict[str, list[str]]) -> Column:
    """The role whose folder is the first part of a path to match."""
    lookup = {f.lower(): role for role, names in folders.items() for f in names}
    parts = F.transform(F.split(path, "/"), lambda p: F.lower(p))
    whole = F.create_map(*(F.lit(x) for kv in lookup.items() for x in kv)) if lookup else F.create_map().cast("map<string,string>")
    return F.get(F.filter(F.transform(parts, lambda p: whole[p]), lambda r: r.isNotNull()), F.lit(0))


def strip_version(stem: Column, version: str) -> Column:
    return F.regexp_replace(stem, f"[-_]?{re.escape(version)}$", "")


def feature_sources(tbl: DataFrame, by: list[str], most: int = 4) -> DataFrame:
    """The first roles and paths of each table, at most `most`, in order of role and path."""
    w = Window.partitionBy(*by).orderBy("role", "path")
    return tbl.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def find_documents(document: DataFrame, name: str) -> DataFrame:
    """Documents whose title or path contains every word of name, whatever its case; % and _ are themselves."""
    cond: Column = F.lit(True)
    for w in name.lower().split():
        cond &= F.lower("title").contains(w) | F.lower("path").contains(w)
    return document.where(cond)


def diff_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Features added, removed or changed between two versions: kind and what changed.

    Keys are (table_name, name); of repeated keys the greatest uid counts.
    """

    def last(df: DataFrame, side: str) -> DataFrame:
        best = df.groupBy("table_name", "name").agg(F.max_by(F.struct(collapsed(F.col("definition")).alias("d"), collapsed(F.col("values")).alias("v")), "uid").alias("x"))
        return best.select("table_name", "name", F.col("x.d").alias(f"{side}_d"), F.col("x.v").alias(f"{side}_v"), F.lit(True).alias(side))

    both = last(old, "old").join(last(new, "new"), ["table_name", "name"], "full_outer")
    what = F.concat_ws("+", F.when(~F.col("old_d").eqNullSafe(F.col("new_d")), "definition"), F.when(~F.col("old_v").eqNullSafe(F.col("new_v")), "values"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.select("table_name", "name", kind.alias("kind"), F.when(kind == "changed", what).otherwise("").alias("what")).where("kind <> 'changed' or what <> ''")


def first_by_name(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of rows with the same key, the first in order; keys that are blank go."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def synonym_pairs(groups: DataFrame) -> DataFrame:
    """Ordered pairs of different words (lower case, trimmed) of each group."""
    words = groups.select("group_id", F.lower(F.trim("word")).alias("word")).where("word <> ''").distinct()
    return words.alias("a").join(words.alias("b"), "group_id").where("a.word <> b.word").select("group_id", F.col("a.word").alias("word"), F.col("b.word").alias("synonym"))


def bind_stems(stems: DataFrame, sheets: DataFrame, prefix: int = 31) -> DataFrame:
    """Each stem's sheet: the same name, else the only one with its first 31 characters, else the
    only one with the same letters and digits, else null."""

    def only(key: Column, name: str) -> DataFrame:
        return sheets.groupBy(key.alias(f"k_{name}")).agg(F.min("sheet").alias(name), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")

    exact = sheets.select(F.col("sheet").alias("exact")).distinct()
    out = stems.join(exact, F.col("stem") == F.col("exact"), "left")
    out = out.join(only(F.col("sheet"), "cut"), F.substring("stem", 1, prefix) == F.col("k_cut"), "left")
    out = out.join(only(key_of(F.col("sheet")), "same"), key_of(F.col("stem")) == F.col("k_same"), "left")
    return out.select("stem", F.coalesce("exact", "cut", "same").alias("sheet"))


def query_terms(query: str, synonyms: dict[str, list[str]] | None = None) -> list[tuple[int, str]]:
    """(group, term): each word of a query and its synonyms; groups must all be found. A term of
    several words is a phrase."""
    words = re.findall(r"[a-z0-9_]+", query.lower())
    if not words:
        raise ValueError("an empty query")
    return [(i, t.lower()) for i, w in enumerate(words) for t in [w, *(synonyms or {}).get(w, [])]]


def _pattern(term: str, prefix: bool) -> str:
    """Matches of a term among a lower-case text's words; a phrase is never a prefix."""
    words = re.findall(r"[a-z0-9_]+", term)
    end = "" if prefix and len(words) == 1 else "(?![a-z0-9_])"
    return "(?<![a-z0-9_])" + "[^a-z0-9_]+".join(words) + end


def search(documents: DataFrame, key: str, text: Column, terms: list[tuple[int, str]], limit: int, k1: float = 1.2, b: float = 0.75, prefix: bool = False, stems: bool = False) -> DataFrame:
    """Documents in which every group has a term, by BM25 (negated: the least is best).

    terms: (group, term), as query_terms() makes them or as the caller likes. With prefix, a word is
    found as the beginning of a longer one too; with stems, words with its stem are; a term of several
    words is a phrase. Each scan of the documents counts terms and words once; the first gives the
    statistics, one row.
    """

    def every(found: list[Column]) -> Column:
        groups = [[c for (h, _), c in zip(terms, found, strict=True) if h == g] for g in sorted({g for g, _ in terms})]
        return reduce(lambda x, y: x & y, (F.greatest(*g, F.lit(0)) > 0 for g in groups), F.lit(True))

    return _ranked(documents, key, text, [(t, prefix) for _, t in terms], every, limit, k1, b, stems)


def _ranked(documents: DataFrame, key: str, text: Column, terms: list[tuple[str, bool]], every, limit: int, k1: float, b: float, stems: bool, counted: list[int] | None = None, digits: int | None = None) -> DataFrame:
    """key and rank of the documents for which every (of the terms' counts) is true; terms: (words,
    whether as a prefix); counted: the places of the terms that the rank is of (all); digits: as in
    search_raw."""
    # A dotted capital i is an i, as in SQL; Java makes it two characters, of which the dot would end a word.
    small = F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))
    low = documents.select(key, F.inline(F.array(F.struct(small.alias("t")))))  # so that it is worked out once

    def count(term: str, prefix: bool) -> Column:  # most documents don't hold a term's first word at all
        words = re.findall(r"[a-z0-9_]+", term)
        if stems and not prefix:
            return stem.count_stems(F.col("t"), words)
        return F.when(F.col("t").contains(words[0]), F.regexp_count("t", F.lit(_pattern(term, prefix)))).otherwise(0)

    hits = low.select(key, "t", F.inline(F.array(F.struct(*(count(*t).alias(f"f{i}") for i, t in enumerate(terms))))))
    length = F.regexp_count("t", F.lit("[a-z0-9_]+"))
    total = hits.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms)))).first()
    n, mean = total["n"], total["mean"] or 1.0
    score: Column = F.lit(0.0)
    for i in range(len(terms)) if counted is None else counted:
        f, d = F.col(f"f{i}").cast("double"), total[f"d{i}"]
        idf = max(1e-6, math.log((n - d + 0.5) / (d + 0.5)))
        score += idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("length") / mean))
    found = hits.where(every([F.col(f"f{i}") for i in range(len(terms))]))
    rank = -score if digits is None else F.round(-score, digits)
    return found.withColumn("length", length).select(key, rank.alias("rank")).orderBy("rank", key).limit(limit)


_RAW = re.compile(r'"([^"]*)"|([()])|([A-Za-z0-9_]+)(\*?)')


def raw_terms(query: str) -> tuple[list[tuple[str, bool]], list]:
    """Terms (words, whether as a prefix) of a query string, and its tree: a term's place, or ("AND",
    "OR" or "NOT", left, right).

    Words side by side must all be found; "..." is a phrase; word* finds longer words; AND, OR and NOT
    (what is on its left, not on its right) are in capitals, NOT binding closest, then AND; parentheses
    group. ValueError if it can't be read.
    """
    tokens = [(phrase, op, word, star) for phrase, op, word, star in _RAW.findall(query)]
    if _RAW.sub("", query).strip():
        raise ValueError(f"can't read: {_RAW.sub('', query).strip()}")
    terms: list[tuple[str, bool]] = []
    at = 0

    def peek() -> str:
        if at >= len(tokens):
            return ""
        phrase, op, word, _ = tokens[at]
        return op or (word if word in ("AND", "OR", "NOT") else "term")

    def one():
        nonlocal at
        kind = peek()
        if kind == "(":
            at += 1
            out = level(0)
            if peek() != ")":
                raise ValueError("a parenthesis isn't closed")
            at += 1
            return out
        if kind != "term":
            raise ValueError(f"a term is missing before {kind or 'the end'}")
        phrase, _, word, star = tokens[at]
        at += 1
        words = " ".join(re.findall(r"[a-z0-9_]+", (phrase or word).lower()))
        if not words:
            raise ValueError("an empty phrase")
        terms.append((words, bool(star)))
        return len(terms) - 1

    def level(n: int):
        nonlocal at
        if n == 3:
            return one()
        out, name = level(n + 1), ("OR", "AND", "NOT")[n]
        while peek() == name or name == "AND" and peek() in ("term", "("):
            at += peek() == name
            out = (name, out, level(n + 1))
        return out

    tree = level(0)
    if at < len(tokens):
        raise ValueError(f"a term is missing before {peek()}")
    return terms, tree


def search_raw(documents: DataFrame, key: str, text: Column, query: str, limit: int, stems: bool = True, k1: float = 1.2, b: float = 0.75, digits: int | None = None) -> DataFrame:
    """Documents that a query string (see raw_terms) is true of, by BM25 of the terms that it asks for.
    With digits, ranks are rounded first, so that documents whose rounded ranks are equal go by key."""
    terms, tree = raw_terms(query)

    def true(node, found: list[Column]) -> Column:
        if isinstance(node, int):
            return found[node] > 0
        name, left, right = node
        a, c = true(left, found), true(right, found)
        return a & c if name == "AND" else a | c if name == "OR" else a & ~c

    def asked(node) -> list[int]:
        return [node] if isinstance(node, int) else asked(node[1]) + ([] if node[0] == "NOT" else asked(node[2]))

    return _ranked(documents, key, text, terms, lambda found: true(tree, found), limit, k1, b, stems, asked(tree), digits)


def search_features(feature: DataFrame, query: str, pairs: DataFrame | None = None, synonyms: dict[str, list[str]] | None = None, table_name: str | None = None, scale: str | None = None, limit: int = 50) -> DataFrame:
    """Features of a scope whose name, table and definition hold every word of a query, as the
    beginning of a word, or a synonym of it; uid and rank. scale: the field type or measurement scale."""
    rows = in_scope(feature, pairs) if pairs is not None else feature
    if table_name is not None:
        rows = rows.where(F.col("table_name") == table_name)
    if scale is not None:
        rows = rows.where((F.col("measurement_scale") == scale) | (F.col("field_type") == scale))
    return search(rows, "uid", F.concat_ws(" ", "name", "table_name", "definition"), query_terms(query, synonyms), limit, prefix=True)


def section_windows(lines: DataFrame, by: str, line: str, hit: Column, context: int = 3) -> DataFrame:
    """Runs of lines within `context` of a hit, touching runs as one: by, first, last, n_hits."""
    w = Window.partitionBy(by).orderBy(line)
    hits = lines.where(hit).select(by, (F.col(line) - context).alias("lo"), (F.col(line) + context).alias("hi"), line)
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("_new", F.when(F.col("lo") <= before + 1, 0).otherwise(1))
    return marked.withColumn("_island", F.sum("_new").over(w)).groupBy(by, "_island").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.count(F.lit(1)).alias("n_hits")).drop("_island")
