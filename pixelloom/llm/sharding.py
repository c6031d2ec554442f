"""Contiguous shards of near-equal bytes, by global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty
from .prefix import in_global_order, totals_before


def byte_shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Cut ``docs`` in doc_id order into ``n_shards`` runs of near-equal bytes.

    A row weighs its text's UTF-8 bytes plus 1. Its shard is the one whose equal share of
    all bytes holds the middle of the row's own interval in the global prefix sum, so each
    shard's bytes differ from the equal share by at most one document at either end.

    Only (doc_id, size, crc32) are moved, never texts. Returns doc_id, size, text_crc32,
    law, shard, slot (gapless from 0 in each shard) and grown_shard (null: the `bytes` law).

    Null text: no bytes, size 1, crc32 0. Null ids come first. Rows that agree in id, size
    and crc32 are interchangeable; each still gets its own slot. An empty table gives no
    rows. Other columns of ``docs`` are not read. One document longer than a share leaves
    the shards inside its interval empty.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = text_or_empty()
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = in_global_order(sized, F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc())
    before = totals_before(placed, [], bytes=F.sum("size"), rows=F.count("*"))
    # One row per part: bounded by the number of shuffle partitions.
    offsets = F.broadcast(before)
    running = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        placed.withColumn("_upto", F.sum("size").over(running))
        .join(offsets, "_part")
        .withColumn("_twice_mid", 2 * (F.col("bytes_before") + F.col("_upto")) - F.col("size"))
        .withColumn("shard", F.expr(f"cast(least({n_shards - 1}, (_twice_mid * {n_shards}) div (2 * bytes_all)) as int)"))
        .withColumn("_at", F.col("rows_before") + F.col("_place"))
    )
    first = cut.groupBy("shard").agg(F.min("_at").alias("_first"))
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_at") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
