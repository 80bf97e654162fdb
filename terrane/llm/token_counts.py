"""Token counts by an exact length histogram.

Documents are encoded once and aggregated by encoded length. The histogram is all that later
questions need: running and suffix sums over it answer, for every context limit, how many
documents fit, how many tokens there are, and how many are left if longer documents are truncated.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import doc_texts

#: Texts of these characters only are split alike by both libraries' regular expressions.
PLAIN = re.compile(r"[\n\x20-\x7e¡-¬®-ÿĀ-ſ‐-‧‰-⁞]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str):
    """The vocabulary of a byte-level BPE kept in a tokenizers file, as tiktoken's encoding."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path) as f:
        spec = json.load(f)
    special = {x["content"] for x in spec.get("added_tokens", [])}
    # Fixed rule of byte-level BPE: printable bytes stand for themselves, the others for 256 + rank.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a text to its ids (uint32), of a byte-level BPE kept in a tokenizers file.

    The vocabulary of the file is run by tiktoken, whose merge loop is faster; a text with
    characters on which the two libraries' splitting patterns may differ goes to tokenizers
    itself. Strings of special tokens are ordinary text.
    """
    from tokenizers import Tokenizer

    @functools.cache
    def exact() -> Tokenizer:
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return t

    fast = byte_bpe(path)

    def encode(text: str) -> np.ndarray:
        if PLAIN.fullmatch(text):
            return fast.encode_to_numpy(text, disallowed_special=())
        return np.array(exact().encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def token_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and n_tokens (long) of every whole text. A null or empty text has no token."""
    path = tokenizer or default_tokenizer()

    def lengths(batches):
        encode = encoder(path)
        for b in batches:
            n = [len(encode(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return doc_texts(docs).mapInArrow(lengths, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens and n_docs: the documents of each encoded length."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit, what the histogram's sums say.

    Columns: context_limit, n_docs (of just this length), docs_within (not longer),
    docs_over, tokens_within (in documents not longer), tokens_truncated (all tokens if longer
    documents are cut at the limit), tokens_lost, quantile (share of documents not longer) and
    token_share (tokens_truncated of all). Between two rows docs_within stays and
    tokens_truncated is linear with slope docs_over, so every other limit is answered too
    (see answer). An empty table gives no rows.
    """
    size = F.col("n_tokens") * F.col("n_docs")
    up = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    down = Window.orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    h = histogram.select(
        "n_tokens",
        "n_docs",
        F.sum("n_docs").over(up).alias("docs_within"),
        F.coalesce(F.sum("n_docs").over(down), F.lit(0)).alias("docs_over"),
        F.sum(size).over(up).alias("tokens_within"),
        F.sum(size).over(whole).alias("tokens_total"),
        F.sum("n_docs").over(whole).alias("docs_total"),
    )
    kept = F.col("tokens_within") + F.col("n_tokens") * F.col("docs_over")
    return h.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        "docs_within",
        "docs_over",
        "tokens_within",
        kept.alias("tokens_truncated"),
        (F.col("tokens_total") - kept).alias("tokens_lost"),
        (F.col("docs_within") / F.col("docs_total")).alias("quantile"),
        F.when(F.col("tokens_total") > 0, kept / F.col("tokens_total")).otherwise(1.0).alias("token_share"),
    )


def answer(limits: DataFrame, limit: int) -> DataFrame:
    """docs_within and tokens_truncated at any context limit: one row, from context_limits.

    The greatest row not over the limit is carried on with its slope, docs_over. Below every
    length, no document fits and each gives limit tokens.
    """
    below = limits.where(F.col("context_limit") <= limit)
    last = below.agg(
        F.max(F.struct("context_limit", "docs_within", "docs_over", "tokens_truncated")).alias("m"),
    )
    total = limits.agg(F.sum("n_docs").alias("n"))
    return last.crossJoin(total).select(
        F.lit(limit).cast("long").alias("context_limit"),
        F.coalesce("m.docs_within", F.lit(0)).alias("docs_within"),
        F.coalesce(
            F.col("m.tokens_truncated") + (F.lit(limit) - F.col("m.context_limit")) * F.col("m.docs_over"),
            F.col("n") * limit,
            F.lit(0),
        ).alias("tokens_truncated"),
    )


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """The least length with at least a share q of the documents not longer: one row, n_tokens."""
    return limits.where(F.col("quantile") >= q).agg(F.min("context_limit").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """context_limits of a documents table. Null texts count as empty, repeated rows each count, long
    texts are encoded whole, extra columns play no part, an empty table gives no rows. The running sums
    are over distinct lengths, whose number the longest text bounds, not the number of documents.
    """
    return context_limits(length_histogram(token_lengths(docs, tokenizer)))
