"""A corpus pipeline of four stages; each works on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import jaccard, language_id, packing, repeats
from terrane.llm.common import cut, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language isn't one of those learned from the documents themselves.

    Null, empty and letterless texts go; other rows stay as they are, repeated rows and null ids, too.
    Texts of any length are read whole. Without a labelled row no language is learned, and all go; an
    empty table stays empty.
    """
    filters = language_id.fit(docs.where(~language_id.is_held_out()))
    return language_id.keep_identified(docs, filters)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, with the smallest doc_id, of each group of near duplicates.

    Of rows with the same doc_id one stays; those with a null one all do. Documents without words are no near duplicates of
    any; rows keep all their columns; an empty table stays empty.
    """
    return jaccard.keep_one_each(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings of 100 bytes that occur earlier out of the texts. No document goes.

    A null text becomes empty, other columns are carried as they are, n_chars is set anew; of rows
    with the same id one comes first, null ids before all. An empty table stays empty.
    """
    return repeats.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences, a row per piece (see packing.pack).

    A null or empty text is its separator alone; repeated rows are packed each; other columns are left
    out; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("suffix_array_dedup", remove_repeats),
    ("best_fit_packing", pack_sequences),
]

#: Language filters, tokens and packing plans aren't SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
