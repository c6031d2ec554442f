"""3x3 filters with a zero border, in doubles, unrounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import along_column, along_row


#: Heights and widths to which images were scaled before timing.
LADDER = [(144, 256), (240, 426), (360, 640), (480, 854)]


def _ends(place: str, along) -> Column:
    """Whether a pixel is the first or the last along a row or a column."""
    return F.lag(place).over(along).isNull() | F.lead(place).over(along).isNull()


def _around(value: Column, along) -> tuple[Column, Column]:
    zero = F.lit(0.0)
    return F.coalesce(F.lag(value).over(along), zero), F.coalesce(F.lead(value).over(along), zero)


def blur3(px: DataFrame) -> DataFrame:
    """Binomial 3x3 blur; sums of sixteenths are exact in doubles."""
    value = F.col("v").cast("double")
    left, right = _around(value, along_row())
    rows = px.select("image_id", "y", "x", (left + 2 * value + right).alias("_r"), _ends("x", along_row()).alias("_side"))
    up, down = _around(F.col("_r"), along_column())
    whole = F.when(F.col("_side") | _ends("y", along_column()), F.lit(0.0)).otherwise((up + 2 * F.col("_r") + down) / 16.0)
    return rows.select("image_id", "y", "x", whole.alias("v"))


def sobel3(px: DataFrame) -> DataFrame:
    """Gradient length scaled to a largest of 255; unchanged where that is 0."""
    value = F.col("v").cast("double")
    left, right = _around(value, along_row())
    rows = px.select("image_id", "y", "x", (right - left).alias("_d"), (left + 2 * value + right).alias("_m"), _ends("x", along_row()).alias("_side"))
    d_up, d_down = _around(F.col("_d"), along_column())
    m_up, m_down = _around(F.col("_m"), along_column())
    gx, gy = d_up + 2 * F.col("_d") + d_down, m_down - m_up
    length = F.when(F.col("_side") | _ends("y", along_column()), F.lit(0.0)).otherwise(F.sqrt(gx * gx + gy * gy))
    steep = rows.select("image_id", "y", "x", length.alias("m"))
    peaks = steep.groupBy("image_id").agg(F.max("m").alias("_peak"))
    scaled = F.when(F.col("_peak") > 0, F.col("m") / F.col("_peak") * 255.0).otherwise(F.col("m"))
    return steep.join(peaks, "image_id").select("image_id", "y", "x", scaled.alias("v"))


def chain(px: DataFrame) -> DataFrame:
    return sobel3(blur3(px))


def _targets(place: str, old: str, new: str, end: int) -> str:
    """The first (``end`` 0) or one after the last (``end`` 1) new place whose source, ``new place * old div new``, is ``place``."""
    return f"cast(((cast({place} as long) + {end}) * {new} + {old} - 1) div {old} as int)"


def scaled_blocks(px: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """image_id, height, width, y0, y1, x0, x1, v: the blocks (ends excluded) that source pixels fill at each of ``sizes``.

    The nearest source pixel of (y, x) is (y * old height div height, x * old width div width),
    so pixels go out to their places and meet nothing but their image's size. Pixels that no place takes give no row.
    """
    dims = px.groupBy("image_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    each = F.array(*(F.struct(F.lit(h).alias("height"), F.lit(w).alias("width")) for h, w in sizes))
    ends = {f"{c}{end}": F.expr(_targets(c, old, new, end)) for c, old, new in (("y", "_h", "height"), ("x", "_w", "width")) for end in (0, 1)}
    return (
        px.where("y >= 0 and x >= 0")
        .join(dims, "image_id")
        .withColumn("_size", F.explode(each))
        .select("image_id", "_size.height", "_size.width", "y", "x", "_h", "_w", "v")
        .withColumns(ends)
        .where("y0 < y1 and x0 < x1")
        .select("image_id", "height", "width", *ends, "v")
    )


def _filled(blocks: DataFrame) -> DataFrame:
    rows = blocks.withColumn("y", F.explode(F.sequence("y0", F.col("y1") - 1)))
    return rows.withColumn("x", F.explode(F.sequence("x0", F.col("x1") - 1)))


def resize_nearest(px: DataFrame, height: int, width: int) -> DataFrame:
    """Scale images by the nearest source pixel (this engine's own rule)."""
    return _filled(scaled_blocks(px, [(height, width)])).select("image_id", "y", "x", "v")


def resize_ladder(px: DataFrame) -> DataFrame:
    """The sizes of ``LADDER`` one below the other, with each one's height and width."""
    return _filled(scaled_blocks(px, LADDER)).select("image_id", "y", "x", "v", "height", "width")


def ladder_sums(px: DataFrame) -> DataFrame:
    """image_id, height, width, sum_v, sum_places (of v * (y + 3 * x)) and n of the images of ``resize_ladder``.

    Each block's part follows from its ends, so the work grows with the source pixels, not with the scaled ones.
    """
    y0, y1, x0, x1 = (F.col(c).cast("long") for c in ("y0", "y1", "x0", "x1"))
    v, n = F.col("v").cast("long"), (y1 - y0) * (x1 - x0)
    # Sums of y and of x over a block are its size times half of y0 + y1 - 1 and of x0 + x1 - 1.
    places = F.shiftright(n * (y0 + y1 - 1 + 3 * (x0 + x1 - 1)), 1)
    return scaled_blocks(px, LADDER).groupBy("image_id", "height", "width").agg(
        F.sum(v * n).alias("sum_v"), F.sum(v * places).alias("sum_places"), F.sum(n).alias("n")
    )
