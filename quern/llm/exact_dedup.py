"""Exact deduplication by sorting contents, in DataFrame operations only.

Sampled splitters range-partition the rows by content, each partition is sorted
(spilling to disk where it must), and equal texts come to lie next to each
other. The grouping of the window compares whole neighbouring texts.

Range boundaries are drawn on (head, hash, salt) where ``head`` is the first
bytes of the text: the splitters that Spark samples to the driver then have a
fixed width instead of a whole text each. The hash spreads texts that share
their head, and the salt spreads the copies of one text, so that a text which
makes up a third of all rows still fills many partitions; there is a salt for each
SALT_BYTES of input. The salted parts of one text meet again as one narrow row
each, told by SHA-256 of the text: only there a digest stands for a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEAD_BYTES = 48
#: Salts at least and at most, and the bytes of text for which there is one.
SALTS, MOST_SALTS, SALT_BYTES = 64, 1 << 20, 32 << 20


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", salts: int | None = None, carry: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Equal means identical text; a null text counts as empty. Of equal texts the
    row with the largest id stays (``keep="min"``: the smallest). Repeated rows
    with the same id and text count separately in ``group_size`` and exactly one
    of them is kept. A row without an id stays only if no equal text has one.
    An empty table gives an empty result; other columns are read only with
    ``carry``, which adds the whole input row as the struct ``row``.
    """
    carried = ["row"] if carry else []
    rank = F.col("doc_id").desc_nulls_last() if keep == "max" else F.col("doc_id").asc_nulls_last()
    best = F.max if keep == "max" else F.min
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if salts is None:
        salts = min(MOST_SALTS, max(SALTS, (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // SALT_BYTES))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.cast("binary").alias("body"), *([F.struct("*").alias("row")] if carry else []))
    rows = rows.select(
        *carried,
        "doc_id",
        "body",
        F.substring("body", 1, HEAD_BYTES).alias("head"),
        F.xxhash64("body").alias("mix"),
        F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(salts)).cast("int").alias("salt"),
    )
    dealt = rows.repartitionByRange("head", "mix", "salt")
    near = Window.partitionBy("head", "mix", "salt", "body")
    local = dealt.select(
        *carried,
        "doc_id",
        "salt",
        F.sha2("body", 256).alias("text_sha256"),
        F.row_number().over(near.orderBy(rank)).alias("place"),
        F.count(F.lit(1)).over(near).alias("local_size"),
    )
    # One row for each text and salt: at most ``salts`` rows share a digest here.
    parts = local.where("place = 1").select("text_sha256", "salt", F.col("doc_id").alias("local_id"), "local_size")
    same = Window.partitionBy("text_sha256")
    totals = parts.select(
        "text_sha256",
        "salt",
        best("local_id").over(same).alias("keep_id"),
        F.sum("local_size").over(same).alias("group_size"),
        F.row_number().over(same.orderBy(F.col("local_id").desc_nulls_last() if keep == "max" else F.col("local_id").asc_nulls_last(), "salt")).alias("part"),
    )
    joined = local.join(totals, ["text_sha256", "salt"])
    return joined.select("doc_id", "keep_id", "group_size", ((F.col("place") == 1) & (F.col("part") == 1)).alias("kept"), "text_sha256", *carried)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one stays."""
    return classes(docs, id_col, text_col, carry=True).where("kept").select("row.*")
