"""Mix sources to target weights by systematic sampling over prefix sums of expected copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD
from .prefix import in_global_order, totals_before

#: Expected copies are counted in steps of 2**-24, in longs, so that sums stay exact.
STEPS = 1 << 24


def source_targets(sizes: DataFrame, most: int = 3, cycle: int = 3) -> DataFrame:
    """Target words of each source: source, source_size, target.

    Sources by code point, null last, weigh 1..``cycle``, repeating. A target stops at
    ``most`` times its source's size; the excess goes to the others by weight until none is
    above. That fixed point is found at once: in order of size per weight the capped sources
    come first, and source i is capped when its cap is at most its weight times what is left
    over the weight that is left. The windows below run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per.withColumn("_w", ((F.row_number().over(by_name) - 1) % cycle + 1).cast("long"))
    by_ratio = Window.orderBy(
        (F.col("source_size").cast("double") / F.col("_w")).asc(), F.col("source").asc_nulls_last()
    )
    everything = Window.partitionBy()
    left = (
        weighed.withColumn("_cap", most * F.col("source_size"))
        .withColumn("_capped_before", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_w_left", F.sum("_w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.sum("source_size").over(everything) - F.col("_capped_before")) / F.col("_w_left").cast("double"))
        .withColumn("_is_capped", F.col("_cap") <= F.col("_w") * F.col("_level"))
    )
    level = F.min(F.when(~F.col("_is_capped"), F.struct((F.col("source_size").cast("double") / F.col("_w")), F.col("_level")))).over(everything)
    return left.withColumn("_final", level["_level"]).select(
        "source",
        "source_size",
        F.when(F.col("_is_capped"), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_final")).alias("target"),
    )


def systematic_copies(docs: DataFrame, seed: str = "mix", most: int = 3, cycle: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each row of ``docs``.

    Each document of a source expects target / source_size copies. In order of size within
    the source, prefix sums of the expected copies plus one random offset per source cross
    some whole numbers; a document is emitted once per crossing. The offset derives from
    ``seed`` and the source, so reruns agree. In size order the words taken miss the target
    by at most the largest document's size.

    Size counts words (null text: 0). Null sources form a source of their own. Sources
    without words have target 0 and no copies. Equal rows share alike up to one copy. A hot
    source is spread: ranks come from distributed prefix sums, never from one task.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    placed = in_global_order(
        sized, F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_first()
    )
    before = totals_before(placed, ["source"], rows=F.count("*")).join(
        placed.groupBy("source", "_part").agg(F.min("_place").alias("_first")).withColumnsRenamed({"source": "_s", "_part": "_p"}),
        F.expr("source <=> _s and _part = _p"),
    ).drop("_s", "_p")
    targets = source_targets(placed, most, cycle)
    plan = (
        before.withColumnsRenamed({"source": "_s", "_part": "_p"})
        .join(targets, F.expr("source <=> _s"))
        .withColumn(
            "_rate",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * STEPS)).otherwise(0).cast("long"),
        )
        .withColumn("_offset", F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))), 1, 6), 16, 10).cast("long"))
        .drop("source")
    )
    at = "(_place - _first + rows_before)"
    return (
        placed.join(plan, F.expr("source <=> _s and _part = _p"))
        .withColumn(
            "copies",
            F.expr(f"((({at} + 1) * _rate + _offset) div {STEPS}) - (({at} * _rate + _offset) div {STEPS})"),
        )
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each repeated as often as the mix takes it, columns unchanged.

    Copies are found on narrow rows, summed for rows that agree in (doc_id, source, size),
    and joined back. Of n such rows the first copies % n get one copy more.

    Null, empty and blank texts have size 0 and expect copies as others of their source do;
    null ids and null sources are values of their own. Very long texts move whole, once.
    Columns of any name stay as they are; an empty table gives no rows.
    """
    names = docs.columns
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.concat_ws(
        "|",
        F.coalesce(F.col("doc_id").cast("string"), F.lit("~")),
        size.cast("string"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
    )
    copies = (
        systematic_copies(docs, **options)
        .groupBy("doc_id", "source", "size")
        .agg(F.sum("copies").alias("__mix_copies"), F.count("*").alias("__mix_alike"))
        .where("__mix_copies > 0")
        .select(
            F.concat_ws(
                "|",
                F.coalesce(F.col("doc_id").cast("string"), F.lit("~")),
                F.col("size").cast("string"),
                F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
            ).alias("__mix_key"),
            "__mix_copies",
            "__mix_alike",
        )
    )
    nth = Window.partitionBy("__mix_key").orderBy(F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    return (
        docs.withColumn("__mix_key", key)
        .join(copies, "__mix_key")
        .withColumn("__mix_nth", F.row_number().over(nth))
        .withColumn("__mix_own", F.expr("__mix_copies div __mix_alike + if(__mix_nth <= __mix_copies % __mix_alike, 1, 0)"))
        .where("__mix_own > 0")
        .withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_own"))))
        .select(*names)
    )
