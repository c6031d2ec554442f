"""Compare images: mean squared error, PSNR, largest difference, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_PSNR, MOST_DIFFERENCE = 40.0, 2


def image_meta(px: DataFrame) -> DataFrame:
    """image_id, height, width, n_channels, bytes."""
    return px.groupBy("image_id").agg(
        (F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width")
    ).select("image_id", "height", "width", F.lit(1).alias("n_channels"), (F.col("height").cast("long") * F.col("width")).alias("bytes"))


def shapes(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, same: whether both sides have the image in one shape. An absent side differs."""
    left = image_meta(a).select("image_id", F.col("height").alias("_h"), F.col("width").alias("_w"))
    return left.join(image_meta(b), "image_id", "full").select(
        "image_id", F.coalesce((F.col("_h") == F.col("height")) & (F.col("_w") == F.col("width")), F.lit(False)).alias("same")
    )


def psnr_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, mse, psnr, max_diff of aligned pixels; psnr is null (infinite) at no difference.

    Squares are summed as integers and divided once, so the result doesn't depend on order.
    """
    other = b.select("image_id", "y", "x", F.col("v").alias("_other"))
    d = (F.col("v") - F.col("_other")).cast("long")
    sums = a.join(other, ["image_id", "y", "x"]).groupBy("image_id").agg(
        F.sum(d * d).alias("_sq"), F.count("*").alias("_n"), F.max(F.abs(d)).cast("int").alias("max_diff")
    )
    mse = F.col("_sq") / F.col("_n")
    return sums.select(
        "image_id",
        F.round(mse, 6).alias("mse"),
        F.round(F.when(F.col("_sq") > 0, 20 * F.log10(F.lit(255.0) / F.sqrt(mse))), 6).alias("psnr"),
        "max_diff",
    )


def verdicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, passed: same shape, PSNR of 40 dB or more and no difference above 2.

    Images that only one side has fail. Both sides are read once: pixels meet in one outer join.
    """
    sides = [df.select("image_id", "y", "x", F.col("v").alias(f"_{n}"), F.col("y").alias(f"_{n}y"), F.col("x").alias(f"_{n}x")) for n, df in (("a", a), ("b", b))]
    d = (F.col("_a") - F.col("_b")).cast("long")
    sums = sides[0].join(sides[1], ["image_id", "y", "x"], "full").groupBy("image_id").agg(
        *[F.max(f"_{n}{c}").alias(f"_{n}{c}") for n in "ab" for c in "yx"], F.sum(d * d).alias("_sq"), F.count(d).alias("_n"), F.max(F.abs(d)).alias("_most")
    )
    same = (F.col("_ay") == F.col("_by")) & (F.col("_ax") == F.col("_bx"))
    psnr = F.when(F.col("_sq") > 0, 20 * F.log10(F.lit(255.0) / F.sqrt(F.col("_sq") / F.col("_n"))))
    good = (F.coalesce(F.round(psnr, 6), F.lit(LEAST_PSNR)) >= LEAST_PSNR) & (F.col("_most") <= MOST_DIFFERENCE)
    return sums.select("image_id", F.coalesce(same & good, F.lit(False)).alias("passed"))


def verdict_counts(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"))


def candidate_match(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """Each candidate file (path, filter) with its filter's reference; the reference is no candidate of its own."""
    ref = references.select(F.col("path").alias("reference"), "filter")
    return candidates.join(ref, "filter", "left").where(F.col("reference").isNull() | (F.col("path") != F.col("reference")))


def missing_candidates(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """References without any candidate."""
    others = candidates.select(F.col("path").alias("_path"), F.col("filter").alias("_filter"))
    return references.join(others, (F.col("filter") == F.col("_filter")) & (F.col("path") != F.col("_path")), "left_anti")
