"""Merkle manifest of a documents table, by lag and lead windows.

Each document is a leaf, the hash of its columns. The leaves of a source, in order, are hashed three
by three until one node, the source's subroot, is left; subroots are hashed likewise to the root.

Leaves get their places from sorted ranges. Seven levels at a time are worked out in blocks of 3^7
nodes: at each level a node's hash stands in the row of its first leaf, so its siblings are the hashes
in the rows one and two times 3^level before or after it, as its slot in the run of three and the run's
length allow; the first child's row hashes the parent. A block is one window of bounded size, whatever
its source, and only its top goes on to the next round, as one node of it. From the root down, each
round's rows then get the siblings above them by a join on their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import cut

LEVELS = 7
BLOCK = 3**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """The SHA-256 (lowercase hex) of texts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """A leaf: each value's count of UTF-8 bytes, a colon and the value; `-` for null."""
    texts = [v.cast("string") for v in values]
    return digest(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with _at, their place in their _key from 0 on, and _n, how many the key has.

    Ranges are sorted each on its own; a key's count in the ranges before a range, one row for each
    range that a key is in, gives where its rows there begin.
    """
    by = ["_key", *order]
    row = F.monotonically_increasing_id()  # the range's number above the row's, in 33 bits
    dealt = cut(nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", row).withColumn("_part", F.shiftright("_row", 33)))
    own = dealt.groupBy("_key", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_c"))
    key = Window.partitionBy("_key")
    before = F.coalesce(F.sum("_c").over(key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = own.select("_key", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_c").over(key).alias("_n"))
    return dealt.join(starts, ["_key", "_part"]).withColumn("_at", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def _over(x: Column, y: int) -> Column:
    """x / y, rounded up."""
    return F.floor((x + (y - 1)) / y)


def _climbed(nodes: DataFrame) -> DataFrame:
    """nodes with _block, _path (for each level within their block, the siblings to the left and to the
    right of the node above) and, in the first row of a block, _top."""
    place = F.col("_at") % BLOCK
    out = nodes.withColumn("_block", F.floor(F.col("_at") / BLOCK)).withColumn("_i", place)
    rows = Window.partitionBy("_key", "_block").orderBy("_i")
    many = F.least(F.lit(BLOCK), F.col("_n") - F.col("_block") * BLOCK)
    out = out.withColumn("_h0", F.col("_hash"))
    for level in range(LEVELS):
        step, h = 3**level, f"_h{level}"
        node = F.floor(F.col("_i") / step)
        slot = node % 3
        run = F.least(F.lit(3), _over(many, step) - (node - slot))
        live = _over(F.col("_n"), step) > 1
        out = out.withColumns({f"_{name}{k}": f(h, k * step).over(rows) for name, f in (("lag", F.lag), ("lead", F.lead)) for k in (1, 2)})
        left = F.when(slot == 2, F.concat("_lag2", "_lag1")).when(slot == 1, F.col("_lag1")).otherwise("")
        right = F.when((slot == 0) & (run == 3), F.concat("_lead1", "_lead2")).when((slot < 2) & (run == slot + 2), F.col("_lead1")).otherwise("")
        first = F.col("_i") % step == 0
        out = out.withColumn(f"_s{level}", F.when(first & live, F.struct(left.alias("left"), right.alias("right"))))
        parent = F.when(live, digest(F.col(h), F.col(f"_s{level}.right"))).otherwise(F.col(h))
        out = out.withColumn(f"_h{level + 1}", F.when(F.col("_i") % (3 * step) == 0, parent)).drop("_lag1", "_lag2", "_lead1", "_lead2")
    so_far = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spread = [F.last(f"_s{level}", ignorenulls=True).over(so_far).alias(f"_s{level}") for level in range(LEVELS)]
    kept = [c for c in nodes.columns if c != "_hash"]
    out = out.select(*kept, "_hash", "_block", "_i", F.col(f"_h{LEVELS}").alias("_top"), *spread)
    return out.withColumn("_path", F.array_compact(F.array(*(f"_s{level}" for level in range(LEVELS))))).drop(*(f"_s{level}" for level in range(LEVELS)))


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The climbed rows of each round, and _key and _top of the single nodes that are left in the end."""
    most = nodes.agg(F.max("_n")).first()[0] or 0
    climbed = []
    while True:
        climbed.append(_climbed(nodes))
        tops = cut(climbed[-1].where("_i = 0").select("_key", F.col("_block").alias("_at"), _over(F.col("_n"), BLOCK).alias("_n"), F.col("_top").alias("_hash")))
        if most <= BLOCK:
            return climbed, tops.select("_key", F.col("_hash").alias("_top"))
        nodes, most = tops, -(-most // BLOCK)


def _descended(climbed: list[DataFrame], above: DataFrame, carry: list[str]) -> DataFrame:
    """The first round's rows, each with the whole _path above it, and the columns carry of above,
    which has a row for each _key, with the _path on from there."""
    for k, rows in reversed(list(enumerate(climbed))):
        keys = ["_key"] if k == len(climbed) - 1 else ["_key", "_block"]
        up = above.withColumnRenamed("_path", "_on")
        above = rows.drop("_top", "_n", "_i").join(up, keys).withColumn("_path", F.concat("_path", "_on")).drop("_on")
        if k:
            above = above.select("_key", F.col("_at").alias("_block"), "_path", *carry)
    return above


def manifest(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path and the columns carry of each row of a documents table.

    path is what proves a leaf: at each level from it to the root, the hashes of its siblings to the left
    (end to end) and to the right. A row of three, the last of fewer, becomes the hash of its hashes, while
    a source has more than one node; a lone leaf is its source's subroot, a lone subroot the root. Nulls
    are hashed as such and null doc_ids come first; rows with one doc_id are in order of their hashes, so
    repeated rows are leaves side by side. Texts are hashed whole where they are read, and only hashes are
    shuffled. A null source is a source; an empty table gives no rows; other columns are left out.
    """
    carry = carry or []
    source = F.col("source").cast("string")
    key = F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))
    leaves = docs.select(F.col("doc_id"), key.alias("_key"), leaf(*map(F.col, COLUMNS)).alias("_hash"), *carry)
    climbed, subroots = _rounds(_placed(leaves, ["doc_id", "_hash"]))
    sources = subroots.select(F.lit("").alias("_key"), F.col("_key").alias("_source"), F.col("_top").alias("_hash"))
    above, root = _rounds(_placed(sources, ["_source"]))
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    tops = _descended(above, root.select("_key", nothing.alias("_path"), F.col("_top").alias("root")), ["root"])
    tops = cut(tops.select(F.col("_source").alias("_key"), "_path", F.col("_hash").alias("subroot"), "root"))
    out = _descended(climbed, tops, ["subroot", "root"])
    return out.select("doc_id", F.col("_hash").alias("leaf"), "subroot", "root", F.col("_path").alias("path"), *carry)


def proof(path: Column) -> Column:
    """All siblings of a path, in order, end to end."""
    return F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def folded(leaf_hash: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf_hash, lambda h, s: digest(s["left"], h, s["right"]))


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, and folded_root and verified of texts tampered with.

    Texts of documents whose doc_id's CRC-32 is even lose their newlines; a null doc_id has no CRC-32
    and a null text stays. See manifest for other cases.
    """
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(even, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))).otherwise(F.col("text").cast("string"))
    claimed = leaf(*map(F.col, COLUMNS[:-1]), text)
    out = manifest(docs.select(*COLUMNS, claimed.alias("_claimed")), ["_claimed"])
    return out.withColumn("folded_root", folded(F.col("_claimed"), F.col("path"))).select(
        "doc_id", "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
