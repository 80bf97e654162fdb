"""The queries of this subpackage, each over its whole table, and the SQL for those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import html_text, jaccard, language_id, licenses, manifest, media, neighbours, packing, periodic, repeats, sentencepieces, token_counts, token_files
from terrane.llm.common import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 20 = 0"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "carry")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cut(token_files.shards(table(spark, sf_dir, "documents")))
    return token_files.documents(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summary(periodic.collapse(table(spark, sf_dir, "documents"), tiled=True))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_license_scan, op2_media_columns, op3_token_counts, op4_jaccard_join, op5_nearest_neighbours, op6_best_fit_packing, op7_language_id, op8_html_text, op9_repeats, op10_sentencepiece, op11_merkle_manifest, op12_token_files, op13_periodic_runs)
}

ORACLES: dict[str, str] = {
    "op4_jaccard_join": r"""
        with recursive w as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
            from documents
        ), s as (
            select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
                else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as shingle
            from w
        ), n as (
            select w.doc_id, count(s.shingle) as n_shingles from w left join s on s.doc_id = w.doc_id group by w.doc_id
        ), links as (
            select a.doc_id as x, b.doc_id as y
            from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id
            join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
            group by a.doc_id, b.doc_id, na.n_shingles, nb.n_shingles
            having 100 * count(*) >= 80 * (na.n_shingles + nb.n_shingles - count(*))
        ), reach as (
            select doc_id as x, doc_id as y from n
            union
            select reach.x, links.y from reach join links on links.x = reach.y
        )
        select n.doc_id, n.n_shingles::bigint as n_shingles, min(reach.y)::bigint as component_id
        from n join reach on reach.x = n.doc_id group by n.doc_id, n.n_shingles
    """,
    "op11_merkle_manifest": r"""
        with recursive hashed as (
            select doc_id, coalesce('1' || source, '0') as src,
                sha256(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source::varchar) || ':' || source, '-') || coalesce(strlen(lang::varchar) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || coalesce(strlen(text::varchar) || ':' || text, '-')) as leaf,
                -- CRC-32 of the decimal doc_id, bit by bit
                xor(4294967295, list_reduce(range(8 * strlen(doc_id::varchar)), lambda c, i:
                    xor(xor(c, case when i % 8 = 0 then ascii(substr(doc_id::varchar, i // 8 + 1, 1)) else 0 end) >> 1,
                        (xor(c, case when i % 8 = 0 then ascii(substr(doc_id::varchar, i // 8 + 1, 1)) else 0 end) & 1) * 3988292384), 4294967295)) % 2 = 0 as even,
                sha256(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source::varchar) || ':' || source, '-') || coalesce(strlen(lang::varchar) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || coalesce(strlen(short::varchar) || ':' || short, '-')) as changed
            from (select *, replace(text, chr(10), '') as short from documents)
        ), leaves as (
            select doc_id, src, leaf, case when even then changed else leaf end as claimed,
                row_number() over (partition by src order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by src) as n
            from hashed
        ), low as (
            select src, 0 as level, place, leaf as h, n from leaves
            union all
            select src, level + 1, place // 3, sha256(string_agg(h, '' order by place)), (n + 2) // 3 from low where n > 1 group by src, level, place // 3, n
        ), high as (
            select 0 as level, row_number() over (order by src) - 1 as place, h, count(*) over () as n, src from low where n = 1
            union all
            select level + 1, place // 3, sha256(string_agg(h, '' order by place)), (n + 2) // 3, null from high where n > 1 group by level, place // 3, n
        ), low_runs as (
            select *, list(h) over (partition by src, level, place // 3 order by place rows between unbounded preceding and unbounded following) as run from low where n > 1
        ), high_runs as (
            select *, list(h) over (partition by level, place // 3 order by place rows between unbounded preceding and unbounded following) as run from high where n > 1
        ), climb as (
            select src, place as own, 0 as level, place, '' as proof, claimed as h from leaves
            union all
            select c.src, own, c.level + 1, c.place // 3, proof || array_to_string(list_filter(run, lambda x, i: i <> c.place % 3 + 1), ''),
                sha256(array_to_string(list_transform(run, lambda x, i: case when i = c.place % 3 + 1 then c.h else x end), ''))
            from climb c join low_runs r on r.src = c.src and r.level = c.level and r.place = c.place
        ), top_climb as (
            select c.src, own, 0 as level, t.place, proof, c.h
            from climb c join low l on l.src = c.src and l.level = c.level and l.n = 1 join high t on t.src = c.src and t.level = 0
            union all
            select c.src, own, c.level + 1, c.place // 3, proof || array_to_string(list_filter(run, lambda x, i: i <> c.place % 3 + 1), ''),
                sha256(array_to_string(list_transform(run, lambda x, i: case when i = c.place % 3 + 1 then c.h else x end), ''))
            from top_climb c join high_runs r on r.level = c.level and r.place = c.place
        )
        select doc_id, leaf, s.h as subroot, t.h as root, sha256(proof) as proof_sha256, c.h as folded_root, c.h = t.h as verified
        from leaves l join low s on s.src = l.src and s.n = 1 join high t on t.n = 1
        join top_climb c on c.src = l.src and c.own = l.place and c.level = t.level
    """,
}
