"""The five filters on pixel tables, as windows and aggregates.

Stencils are separable: one window along rows, one along columns, so the largest group of a
window is one row or one column of an image. Borders reflect once without repeating the
border pixel, for which an image must have at least ``reach + 1`` rows and columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pixelloom.functions import pixels


def along_row() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_column() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")


def _checked(value: Column, reach: int) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"image has fewer than {reach + 1} rows or columns")).cast("int"))


def neighbours(value: Column, along, reach: int) -> list[tuple[Column, Column]]:
    """(before, after) at distance 1..reach with reflected borders."""
    before = [F.lag(value, d).over(along) for d in range(1, reach + 1)]
    after = [F.lead(value, d).over(along) for d in range(1, reach + 1)]
    if reach == 1:
        return [(_checked(F.coalesce(before[0], after[0]), 1), _checked(F.coalesce(after[0], before[0]), 1))]
    # Two places outside: next to the border the reflection is the pixel itself.
    far = lambda near, out, back: F.coalesce(out, F.when(near.isNull(), back).otherwise(value))
    return [
        (_checked(F.coalesce(before[0], after[0]), 2), _checked(F.coalesce(after[0], before[0]), 2)),
        (_checked(far(before[0], before[1], after[1]), 2), _checked(far(after[0], after[1], before[1]), 2)),
    ]


def _binomial5(value: Column, along) -> Column:
    (l1, r1), (l2, r2) = neighbours(value, along, 2)
    return (l2 + r2 + 4 * (l1 + r1) + 6 * value).cast("int")


def with_blur(px: DataFrame, name: str = "b") -> DataFrame:
    """Add the 5x5 binomial blur; integer sums make it exact."""
    rows = px.withColumn("_rows", _binomial5(F.col("v"), along_row()))
    both = rows.withColumn("_both", _binomial5(F.col("_rows"), along_column()))
    return both.withColumn(name, F.shiftright(F.col("_both") + 128, 8).cast("int")).drop("_rows", "_both")


def blur(px: DataFrame) -> DataFrame:
    return with_blur(px).select("image_id", "y", "x", F.col("b").alias("v"))


def gradient(px: DataFrame) -> DataFrame:
    """image_id, y, x, s: squared length of the 3x3 Sobel gradient, an exact integer."""
    ((left, right),) = neighbours(F.col("v"), along_row(), 1)
    rows = px.select("image_id", "y", "x", (right - left).alias("_d"), (left + 2 * F.col("v") + right).alias("_m"))
    ((d_up, d_down),) = neighbours(F.col("_d"), along_column(), 1)
    ((m_up, m_down),) = neighbours(F.col("_m"), along_column(), 1)
    steep = rows.select("image_id", "y", "x", (d_up + 2 * F.col("_d") + d_down).alias("_gx"), (m_down - m_up).alias("_gy"))
    return steep.select("image_id", "y", "x", (F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")).cast("int").alias("s"))


def gradient_peaks(px: DataFrame) -> DataFrame:
    return gradient(px).groupBy("image_id").agg(F.max("s").alias("max_s"))


def sobel(px: DataFrame) -> DataFrame:
    """Gradient length, scaled by each image's largest.

    The largest comes from partial maxima joined back by image, not from a window over whole
    images, so one image's pixels stay spread.
    """
    steep = gradient(px)
    peaks = steep.groupBy("image_id").agg(F.max("s").alias("_peak"))
    return steep.join(peaks, "image_id").select(
        "image_id", "y", "x", pixels.normalised_magnitude(F.col("s"), F.col("_peak")).alias("v")
    )


def sharp(px: DataFrame, amount: float = 1.0) -> DataFrame:
    """Unsharp mask; the source value rides along with the blur, so nothing is joined."""
    return with_blur(px).select("image_id", "y", "x", pixels.unsharp(F.col("v"), F.col("b"), amount).alias("v"))


def bc(px: DataFrame, brightness: float = 20.0, contrast: float = 1.2) -> DataFrame:
    return px.select("image_id", "y", "x", pixels.brightness_contrast(F.col("v"), brightness, contrast).alias("v"))
