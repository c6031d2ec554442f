"""Histogram, cumulative histogram, lookup tables and equalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import pixels


def histogram(px: DataFrame) -> DataFrame:
    """image_id, v, n; counts are combined before they move."""
    return px.groupBy("image_id", "v").agg(F.count("*").alias("n"))


def dense(counts: DataFrame) -> DataFrame:
    """All 256 values of each image, missing ones with count 0."""
    every = counts.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    return every.join(counts, ["image_id", "v"], "left").select("image_id", "v", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cumulative(counts: DataFrame) -> DataFrame:
    """Dense histogram with inclusive counts; a window holds one image's 256 rows."""
    upto = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dense(counts).withColumn("cdf", F.sum("n").over(upto))


def equalising_table(counts: DataFrame) -> DataFrame:
    """image_id, v, out for every value 0..255."""
    at, image = cumulative(counts), Window.partitionBy("image_id")
    first = F.min(F.when(F.col("cdf") > 0, F.col("cdf"))).over(image)
    total = F.max("cdf").over(image)
    return at.select("image_id", "v", pixels.equalised(F.col("cdf"), first, total).alias("out"))


def apply_table(px: DataFrame, table: DataFrame) -> DataFrame:
    """Replace each pixel by its image's table entry.

    Tables become one 256-entry array per image, so the join has one small row per image and
    Spark chooses by size whether to broadcast it.
    """
    arrays = table.groupBy("image_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("v", "out"))), lambda e: e["out"]).alias("_table")
    )
    return px.join(arrays, "image_id").select("image_id", "y", "x", F.element_at("_table", F.col("v") + 1).alias("v"))


def histeq(px: DataFrame) -> DataFrame:
    return apply_table(px, equalising_table(histogram(px)))


def remapped(counts: DataFrame, table: list[int]) -> DataFrame:
    """Histogram of an image after a pointwise table, from its histogram before."""
    values = F.array(*map(F.lit, table))
    return counts.groupBy("image_id", F.element_at(values, F.col("v") + 1).alias("v")).agg(F.sum("n").alias("n"))
