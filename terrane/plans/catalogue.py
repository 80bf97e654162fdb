"""Catalogue queries on the given tables: parts are features of tables (types) of datasets (brands).

Each function's name is its query's; ORACLES has the same query as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import text
from terrane.operators import catalogue as C
from terrane.plans.common import table


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("uid"),
        F.col("p_brand").alias("dataset"),
        F.concat_ws(".", F.col("p_size") % 12, F.col("p_size") % 7).alias("version"),
        F.col("p_type").alias("table_name"),
        F.col("p_name").alias("name"),
        F.concat_ws("/", "p_brand", "p_name").alias("qualified_id"),
        F.col("p_size").alias("size"),
    )


FEATURES = "(select p_partkey as uid, p_brand as dataset, (p_size % 12)::varchar || '.' || (p_size % 7)::varchar as version, p_type as table_name, p_name as name, p_brand || '/' || p_name as qualified_id, p_size as size from part)"
LATEST = f"(select dataset, arg_max(version, (size % 12) * 100 + size % 7) as version from {FEATURES} group by dataset)"


def scope_latest_version(spark, sf):
    f = _features(spark, sf)
    return C.in_scope(f, C.scope(f)).groupBy("dataset", "version").agg(F.count(F.lit(1)).alias("n_features"))


def scope_latest_source(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("dataset"), F.regexp_replace("source", "^src", "").alias("version"), "n_chars")
    return C.in_scope(d, C.scope(d)).groupBy("dataset", "version").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


def _tables(spark, sf):
    return _features(spark, sf).select("dataset", "version", "table_name", F.concat(F.lit("r"), F.col("size") % 5).alias("role"), F.col("qualified_id").alias("path"), F.col("size").cast("long").alias("n_rows"), (F.col("size") % 9).alias("n_cols"), F.col("name").alias("title"))


TABLES = f"(select dataset, version, table_name, 'r' || (size % 5)::varchar as role, qualified_id as path, size::bigint as n_rows, size % 9 as n_cols, name as title from {FEATURES})"


def tables_grouped(spark, sf):
    t = _tables(spark, sf)
    return C.list_tables(t, C.scope(t, all_versions=True))


def tables_role_grep(spark, sf):
    t = _tables(spark, sf)
    return C.list_tables(t, C.scope(t, all_versions=True), role="r2", grep="e")


_GROUP = "select dataset, version, table_name, max(title) as title, string_agg(distinct role, ',' order by role) as roles, sum(n_rows)::bigint as n_rows, max(n_cols) as n_cols, count(*) as n_files from {t} {where} group by dataset, version, table_name"


def describe_page(spark, sf):
    page, total = C.describe(_features(spark, sf), "ECONOMY", 50, 10)
    return page.crossJoin(F.broadcast(total)).select("uid", "name", "dataset", "total")  # one row


def find_feature_disjunction(spark, sf):
    f = _features(spark, sf)
    keys = f.where("uid % 97 = 1").select(F.col("name").alias("key"))
    hits = f.join(keys.distinct(), F.col("name") == F.col("key"))
    return hits.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("qualified_id").alias("first"), F.max("uid").alias("last_uid"))


def feature_sources_top4(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    t = s.select(F.col("n_name").alias("table_name"), F.concat(F.lit("r"), F.col("s_suppkey") % 3).alias("role"), F.col("s_name").alias("path"))
    return C.feature_sources(t, ["table_name"])


def documents_all_tokens(spark, sf):
    d = table(spark, sf, "pages").select("page_id", F.col("html").alias("title"), F.col("url").alias("path"))
    return C.find_documents(d, "example the").select("page_id", "path")


def dataset_counts(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("dataset"), "n_name")
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("dataset"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("dataset"))
    return C.datasets(n, c, s)


def version_counts_distinct(spark, sf):
    return C.versions(_features(spark, sf))


def dictionary_diff(spark, sf):
    p = table(spark, sf, "part").select(
        (F.col("p_partkey") % 500).cast("string").alias("name"), F.col("p_type").alias("table_name"), F.col("p_brand").alias("definition"), F.concat(F.lit("L "), (F.col("p_size") % 4).cast("string")).alias("values"), F.col("p_partkey").alias("uid"), "p_size"
    )
    return C.diff_versions(p.where("p_size % 2 = 0"), p.where("p_size % 2 = 1"))


def dedup_first_ci(spark, sf):
    p = table(spark, sf, "part").withColumn("key", F.lower(F.split("p_name", " ")[0]))
    return C.first_by_name(p, ["p_type", "key"], ["p_partkey"]).select("p_type", "key", "p_partkey")


def value_levels(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.value_levels(F.col("text")).alias("n_levels")).where("n_levels > 0")


def synonyms_pairs(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("group_id"), F.col("n_name").alias("word"))
    return C.synonym_pairs(n)


def bind_stems(spark, sf):
    sheets = table(spark, sf, "customer").select(F.regexp_replace("c_name", "[# ]+", "-").alias("sheet")).where("substr(sheet, -1) <> '3'")
    stems = table(spark, sf, "orders").select(F.concat(F.lit("customer_"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("stem")).distinct()
    return C.bind_stems(stems, sheets)


SEARCH = [(0, "the"), (0, "der"), (1, "licensed"), (1, "token")]


def search_bm25(spark, sf):
    d = table(spark, sf, "documents")
    return C.search(d, "doc_id", F.col("text"), SEARCH, 50).withColumn("rank", F.round("rank", 6))


def search_prefix(spark, sf):
    """Terms as the beginnings of words."""
    d = table(spark, sf, "documents")
    return C.search(d, "doc_id", F.col("text"), C.query_terms("th lice", {"lice": ["an"]}), 50, prefix=True).withColumn("rank", F.round("rank", 6))


def search_phrase(spark, sf):
    """A word with a synonym of two words, found one after the other."""
    d = table(spark, sf, "documents")
    return C.search(d, "doc_id", F.col("text"), C.query_terms("licensed", {"licensed": ["rights reserved"]}), 50).withColumn("rank", F.round("rank", 6))


RAW = 'th* (licensed OR "rights reserved") NOT token'


def search_raw(spark, sf):
    """A query string with a prefix, an alternative, a phrase and an exclusion."""
    d = table(spark, sf, "documents")
    return C.search_raw(d, "doc_id", F.col("text"), RAW, 50, stems=False, digits=6)


def search_stemmed(spark, sf):
    """Words by their stems."""
    d = table(spark, sf, "documents")
    return C.search_raw(d, "doc_id", F.col("text"), "licenses OR rights NOT tokens", 50).withColumn("rank", F.round("rank", 6))


def search_features_scoped(spark, sf):
    f = _features(spark, sf).withColumns({"definition": F.col("qualified_id"), "field_type": F.concat(F.lit("t"), F.col("size") % 3), "measurement_scale": F.lit(None).cast("string")})
    return C.search_features(f, "econ", C.scope(f), scale="t2", limit=50).withColumn("rank", F.round("rank", 6))


def find_feature_any_name(spark, sf):
    """Features by name, qualified id or table.name, for many keys at once."""
    f = _features(spark, sf)
    keys = f.where("uid % 7 = 1").select(F.explode(F.array("name", "qualified_id", F.concat_ws(".", "table_name", "name"))).alias("key"))
    return C.find_features(f, keys).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("uid").alias("last_uid"))


def documents_listed(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("dataset"), F.regexp_replace("source", "^src", "").alias("version"), F.col("source").alias("title"), F.col("doc_id").cast("string").alias("path"))
    return C.list_documents(d, C.scope(d))


def tables_resolved(spark, sf):
    """Files' stems bound to a dictionary's tables, and features under the stems."""
    p = table(spark, sf, "part")
    files = p.select(F.concat(F.lit("/data/Main/"), F.regexp_replace("p_type", " ", "_"), F.lit("-2024.csv")).alias("path")).distinct().withColumns({"n_rows": F.lit(1), "n_cols": F.lit(1)})
    features = p.select(F.col("p_type").alias("table_name"), F.col("p_name").alias("name"))
    tables, keyed = C.resolve_tables(files, features, {"core": ["main"]}, "2024")
    n = keyed.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_features"))
    return tables.select("stem", "role", "sheet", "table_name").join(n, "table_name", "left").select("stem", "role", "sheet", "n_features")


def section_windows(spark, sf):
    c = table(spark, sf, "conversations")
    return C.section_windows(c, "conv_id", "turn", F.lower("text").contains("the"), 1)


def page_lines(spark, sf):
    """Text cells as the renderers show them."""
    return table(spark, sf, "conversations").select("conv_id", "turn", text.one_line(F.col("text"), 60).alias("line"), text.codes(F.col("role")).alias("codes"))


QUERIES = {
    f.__name__: f
    for f in (scope_latest_version, scope_latest_source, tables_grouped, tables_role_grep, describe_page, find_feature_disjunction, feature_sources_top4, documents_all_tokens, dataset_counts, version_counts_distinct, dictionary_diff, dedup_first_ci, value_levels, synonyms_pairs, bind_stems, search_bm25, search_prefix, search_phrase, search_raw, search_stemmed, search_features_scoped, find_feature_any_name, documents_listed, tables_resolved, section_windows, page_lines)
}

_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')"
_F = ", ".join(f"len(list_filter({_WORDS}, lambda x: x = '{t}')) as f{i}" for i, (_, t) in enumerate(SEARCH))
_SCORE = " + ".join(f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(SEARCH)))



def _ranked(words: str, key: str, source: str, found: list[tuple[int, str]], limit: int = 50) -> str:
    """SQL of a search: words of the texts as a list w, and for each term how often it is found."""
    f = ", ".join(f"({x}) as f{i}" for i, (_, x) in enumerate(found))
    d = ", ".join(f"count(*) filter (f{i} > 0) as d{i}" for i in range(len(found)))
    score = " + ".join(f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(found)))
    every = " and ".join("(" + " or ".join(f"f{i} > 0" for i, (h, _) in enumerate(found) if h == g) + ")" for g in sorted({g for g, _ in found}))
    return f"with t as (select {key}, {words} as w from {source}), h as (select {key}, len(w) as length, {f} from t), s as (select count(*) as n, avg(length) as mean, {d} from h) select {key}, round(-({score}), 6) as rank from h, s where {every} order by -({score}), {key} limit {limit}"


def _begin(term: str) -> str:
    return f"len(list_filter(w, lambda x: starts_with(x, '{term}')))"


ORACLES = {
    "search_prefix": _ranked(_WORDS, "doc_id", "documents", [(0, _begin("th")), (1, _begin("lice")), (1, _begin("an"))]),
    "search_phrase": _ranked(_WORDS, "doc_id", "documents", [(0, "len(list_filter(w, lambda x: x = 'licensed'))"), (0, "len(list_filter(range(1, len(w)), lambda i: w[i] = 'rights' and w[i + 1] = 'reserved'))")]),
    "search_raw": f"""
        with t as (select doc_id, {_WORDS} as w from documents),
        h as (select doc_id, len(w) as length, len(list_filter(w, lambda x: starts_with(x, 'th'))) as f0, len(list_filter(w, lambda x: x = 'licensed')) as f1,
            len(list_filter(range(1, len(w)), lambda i: w[i] = 'rights' and w[i + 1] = 'reserved')) as f2, len(list_filter(w, lambda x: x = 'token')) as f3 from t),
        s as (select count(*) as n, avg(length) as mean, count(*) filter (f0 > 0) as d0, count(*) filter (f1 > 0) as d1, count(*) filter (f2 > 0) as d2 from h)
        select doc_id, round(-({" + ".join(f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(3))}), 6) as rank
        from h, s where f0 > 0 and (f1 > 0 or f2 > 0) and f3 = 0 order by rank, doc_id limit 50""",
    "search_features_scoped": _ranked(_WORDS.replace("lower(text)", "lower(name || ' ' || table_name || ' ' || qualified_id)"), "uid", f"(select f.* from {FEATURES} f join {LATEST} l on f.dataset = l.dataset and f.version = l.version where size % 3 = 2)", [(0, _begin("econ"))]),
    "find_feature_any_name": f"with f as (select *, table_name || '.' || name as full_name from {FEATURES}), k as (select distinct unnest([name, qualified_id, full_name]) as key from f where uid % 7 = 1) select key, count(*) as n, max(uid) as last_uid from f join k on f.name = k.key or f.qualified_id = k.key or f.full_name = k.key group by key",
    "documents_listed": "with d as (select lang as dataset, replace(source, 'src', '') as version, source as title, doc_id::varchar as path from documents), l as (select dataset, max(version::int)::varchar as version from d group by 1) select d.dataset, d.version, title, path from d join l using (dataset, version)",
    "tables_resolved": "select replace(p_type, ' ', '_') as stem, 'core' as role, p_type as sheet, count(*) as n_features from part group by p_type",
    "scope_latest_version": f"select f.dataset, f.version, count(*) as n_features from {FEATURES} f join {LATEST} l on f.dataset = l.dataset and f.version = l.version group by 1, 2",
    "scope_latest_source": "with d as (select lang as dataset, replace(source, 'src', '') as version, n_chars from documents), l as (select dataset, max(version::int)::varchar as version from d group by 1) select d.dataset, d.version, count(*) as n_docs, sum(n_chars)::bigint as n_chars from d join l using (dataset, version) group by 1, 2",
    "tables_grouped": _GROUP.format(t=TABLES, where=""),
    "tables_role_grep": _GROUP.format(t=TABLES, where="where role = 'r2' and (lower(table_name) like '%e%' or lower(title) like '%e%')"),
    "describe_page": f"with f as (select * from {FEATURES} where table_name = 'ECONOMY') select uid, name, dataset, (select count(*) from f) as total from f order by uid limit 50 offset 10",
    "find_feature_disjunction": f"with f as (select * from {FEATURES}), k as (select distinct name as key from f where uid % 97 = 1) select key, count(*) as n, min(qualified_id) as first, max(uid) as last_uid from f join k on f.name = k.key group by key",
    "feature_sources_top4": "select table_name, role, path, rank from (select n_name as table_name, 'r' || (s_suppkey % 3)::varchar as role, s_name as path, row_number() over (partition by n_name order by 'r' || (s_suppkey % 3)::varchar, s_name)::int as rank from supplier join nation on s_nationkey = n_nationkey) where rank <= 4",
    "documents_all_tokens": "select page_id, url as path from pages where (lower(html) like '%example%' or lower(url) like '%example%') and (lower(html) like '%the%' or lower(url) like '%the%')",
    "dataset_counts": "select n_nationkey as dataset, n_name, (select count(*) from customer where c_nationkey = n_nationkey) as n_versions, (select count(*) from supplier where s_nationkey = n_nationkey) as n_features from nation",
    "version_counts_distinct": f"select dataset, version, count(distinct table_name) as n_tables, count(*) as n_features from {FEATURES} group by 1, 2",
    "dictionary_diff": """
        with p as (select (p_partkey % 500)::varchar as name, p_type as table_name, lower(p_brand) as d, 'l ' || (p_size % 4)::varchar as v, p_partkey as uid, p_size from part),
        a as (select table_name, name, arg_max(d, uid) as d, arg_max(v, uid) as v from p where p_size % 2 = 0 group by 1, 2),
        b as (select table_name, name, arg_max(d, uid) as d, arg_max(v, uid) as v from p where p_size % 2 = 1 group by 1, 2),
        j as (select table_name, name, case when a.d is null then 'added' when b.d is null then 'removed' else 'changed' end as kind, a.d as ad, b.d as bd, a.v as av, b.v as bv from a full join b using (table_name, name))
        select table_name, name, kind, case when kind <> 'changed' then '' when ad <> bd and av <> bv then 'definition+values' when ad <> bd then 'definition' else 'values' end as what
        from j where kind <> 'changed' or ad <> bd or av <> bv""",
    "dedup_first_ci": "select p_type, lower(split_part(p_name, ' ', 1)) as key, min(p_partkey) as p_partkey from part group by 1, 2",
    "value_levels": "select doc_id, n_levels::int as n_levels from (select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '='))) as n_levels from documents) where n_levels > 0",
    "synonyms_pairs": "select distinct a.n_regionkey as group_id, lower(a.n_name) as word, lower(b.n_name) as synonym from nation a join nation b on a.n_regionkey = b.n_regionkey and lower(a.n_name) <> lower(b.n_name)",
    "bind_stems": """
        with s as (select regexp_replace(c_name, '[# ]+', '-', 'g') as sheet from customer), t as (select * from s where right(sheet, 1) <> '3'),
        q as (select distinct 'customer_' || lpad(o_custkey::varchar, 9, '0') as stem from orders),
        k as (select regexp_replace(lower(sheet), '[^a-z0-9]', '', 'g') as k, min(sheet) as sheet from t group by 1 having count(*) = 1),
        c as (select substr(sheet, 1, 31) as k, min(sheet) as sheet from t group by 1 having count(*) = 1)
        select q.stem, coalesce(e.sheet, c.sheet, k.sheet) as sheet from q left join (select distinct sheet from t) e on e.sheet = q.stem
        left join c on c.k = substr(q.stem, 1, 31) left join k on k.k = regexp_replace(lower(q.stem), '[^a-z0-9]', '', 'g')""",
    "search_bm25": f"""
        with h as (select doc_id, len({_WORDS}) as length, {_F} from documents),
        s as (select count(*) as n, avg(length) as mean, {", ".join(f"count(*) filter (f{i} > 0) as d{i}" for i in range(len(SEARCH)))} from h)
        select doc_id, round(-({_SCORE}), 6) as rank from h, s where (f0 > 0 or f1 > 0) and (f2 > 0 or f3 > 0) order by -({_SCORE}), doc_id limit 50""",
    "section_windows": """
        with h as (select conv_id, turn - 1 as lo, turn + 1 as hi, turn from conversations where contains(lower(text), 'the')),
        m as (select *, case when lo <= max(hi) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as new from h),
        i as (select *, sum(new) over (partition by conv_id order by turn rows unbounded preceding) as island from m)
        select conv_id, min(lo) as first, max(hi) as last, count(*) as n_hits from i group by conv_id, island""",
    "page_lines": "select conv_id, turn, case when length(f) > 60 then substr(f, 1, 59) || '…' else f end as line, role as codes from (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as f from conversations)",
}
