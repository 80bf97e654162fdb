"""Language identification with language-bitmask n-gram filters.

For every slot of a Bloom filter, a bitmask says in which languages' filters the slot is set
(the filters of all languages, bit-sliced). An n-gram's masks at its slots, and-ed, are the
languages that contain it, all by one look-up per hash. A document's hits are counted language by
language, corrected for each filter's false positives, and the greatest rate of hits decides.

A language's filter holds the 4-grams (bytes of the lower-cased text, other ASCII than letters as
blanks) that are in at least `share` of a sample of its documents, `sample` at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import byte_chunks, cut, doc_texts, freeing, small_batches

SLOT_BITS = 20
BROADCAST_ROWS = 100_000
FACTORS = (0x9E3779B1, 0x85EBCA77)
UNDETERMINED = "und"
_SEEN = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def has_letter(text: str) -> bool:
    """Whether a character is a letter (general category L: no superior or Roman numeral, no fraction)."""
    return any(map(str.isalpha, text))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of all texts as 32-bit codes, and where each text's begin (and the last end)."""
    raw = [b" %b   " % t.lower().encode("utf-8", "replace") for t in texts]
    data = _SEEN[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint32)
    codes = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    return codes, np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def slots_of(codes: np.ndarray, bits: int = SLOT_BITS) -> list[np.ndarray]:
    return [(codes * np.uint32(f)) >> np.uint32(32 - bits) for f in FACTORS]


@dataclass
class Filters:
    """languages; masks: a bitmask of up to 64 languages per slot, in as many words as needed."""

    languages: list[str]
    masks: list[np.ndarray]

    def rates(self, texts: list[str]) -> np.ndarray:
        """The corrected share of each text's n-grams that each language contains."""
        out = np.zeros((len(texts), len(self.languages)))
        if not texts:
            return out
        codes, edges = grams(texts)
        known = codes != 0x20202020
        first, last = edges[:-1], edges[1:] - 3  # no n-gram reaches into the next text
        slots = slots_of(codes)

        def per_text(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return total[last] - total[first]

        n = np.maximum(1, per_text(known))
        for w, mask in enumerate(self.masks):
            found = mask[slots[0]]
            for s in slots[1:]:
                found &= mask[s]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                bit = mask.dtype.type(1 << i % 64)
                false = float(np.mean((mask & bit) != 0)) ** len(slots)
                hits = per_text(((found & bit) != 0) & known)
                out[:, i] = np.clip((hits / n - false) / max(1e-9, 1 - false), 0, 1)
        return out


def _chosen(known: DataFrame, sample: int) -> DataFrame:
    """lang and doc_id of at most `sample` documents of each language, those whose id's hash is least.

    Rows are counted by language and the hash's first 12 bits; the bins that hold the least hashes
    are known from that, and only their ids, `sample` and one bin's at most, are ranked.
    """
    ids = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("_h")).withColumn("_bin", F.shiftright("_h", 52))
    bins = ids.groupBy("lang", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("lang").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = bins.withColumn("_before", before).where(F.col("_before") < sample).groupBy("lang").agg(F.max("_bin").alias("_top"))
    few = ids.join(F.broadcast(tops), "lang").where("_bin <= _top").select("lang", "doc_id", "_h").distinct()  # tops: a row per language
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    return few.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample).select("lang", "doc_id")


def fit(labelled: DataFrame, sample: int = 1000, share: float = 0.02) -> Filters:
    """Filters from a table with doc_id, text and lang (rows without lang or text are left out).

    At most `sample` documents of a language are used (ids, if rows repeat one). The result has 2^20 slots whatever the input's size; no labelled row gives no language.
    """
    small_batches(labelled.sparkSession)
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null and doc_id is not null")
    chosen = cut(_chosen(known, sample))  # ids alone are ranked, and then say which texts are read
    sizes = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    rows = known.join(F.broadcast(chosen) if sum(sizes.values()) <= BROADCAST_ROWS else chosen, ["doc_id", "lang"])

    def collect(batches):
        for b in batches:
            for c in byte_chunks(b, "text", 1 << 20):
                codes, edges = grams(c.column("text").to_pylist())
                lang = c.column("lang").to_pylist()
                for name in dict.fromkeys(lang):
                    own = [np.unique(codes[s : e - 3]) for s, e, x in zip(edges, edges[1:], lang, strict=False) if x == name]
                    code, n = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(code)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    languages = sorted(sizes)
    words = max(1, -(-len(languages) // 64))
    enough = {x: max(2, share * n) if n > 3 else 1 for x, n in sizes.items()}

    def set_bits(batches):
        for b in batches:
            lang, code = b.column("lang").to_pylist(), b.column("code").to_numpy().astype(np.uint32)
            good = b.column("n").to_numpy() >= np.array([enough[x] for x in lang])
            index = np.array([languages.index(x) for x in lang], np.int64)[good]
            for s in slots_of(code[good]):
                bits = (np.uint64(1) << (index % 64).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(index // 64), pa.array(s.astype(np.int64)), pa.array(bits)], ["word", "slot", "bits"])

    masks = [np.zeros(1 << SLOT_BITS, np.uint64) for _ in range(words)]
    if languages:
        counted = rows.mapInArrow(freeing(collect), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
        table = counted.mapInArrow(set_bits, "word long, slot long, bits long").groupBy("word", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
        for w in range(words):
            own = table.filter(pa.compute.equal(table["word"], w))
            masks[w][own["slot"].to_numpy()] = own["bits"].to_numpy().view(np.uint64)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages) <= np.dtype(k).itemsize * 8 or k is np.uint64)
    return Filters(languages, [m.astype(kind) for m in masks])


def is_held_out(doc_id="doc_id"):
    """Whether crc32 of the id as text is a multiple of 5. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("long").cast("string")), F.lit(5)) == 0, F.lit(True))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of every whole text.

    A text that is null or has no letter is `und` with score 0, and so is every text if no
    language was learned. The score is the best language's corrected rate of hits, 0 to 1; of
    equal rates the first language in alphabetical order wins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 8 MB for each 64 languages at most

    def predict(batches):
        f = shared.value
        for b in batches:
            for c in byte_chunks(b, "text", 1 << 20):
                texts = [t or "" for t in c.column("text").to_pylist()]
                rates = f.rates(texts)
                some = np.array([has_letter(t) for t in texts]) & bool(f.languages)
                best = rates.argmax(1) if f.languages else np.zeros(len(texts), int)
                lang = [f.languages[i] if ok else UNDETERMINED for i, ok in zip(best, some, strict=True)]
                score = np.where(some, rates[np.arange(len(texts)), best], 0.0) if f.languages else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return doc_texts(docs).mapInArrow(freeing(predict), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, filters: Filters, least: float = 0.2) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in a known language: not `und`,
    and with a score of `least` or more. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def keep(batches):
        f = shared.value
        for b in batches:
            for c in byte_chunks(b, "text", 1 << 20):
                texts = [t or "" for t in c.column("text").to_pylist()]
                best = f.rates(texts).max(1, initial=0.0)
                good = [bool(f.languages) and s >= least and has_letter(t) for s, t in zip(best, texts, strict=True)]
                yield c.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(freeing(keep), docs.schema)


def language_id(docs: DataFrame, sample: int = 1000, share: float = 0.02) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents that are not held out.

    Extra columns are left out, repeated rows each give a row, an empty table gives none. Texts of
    any length are read whole; null and empty ones are `und`.
    """
    filters = fit(docs.where(~is_held_out()), sample, share)
    return identify(docs, filters).withColumn("held_out", is_held_out()).select("doc_id", "held_out", "lang_pred", "score")
