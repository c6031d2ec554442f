"""Pixel arithmetic as Column expressions.

Single-precision chains keep every step a FLOAT: Spark divides floats as doubles, so each
division is cast back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(x) -> Column:
    return (F.lit(float(x)) if isinstance(x, (int, float)) else x).cast("float")


def clamp_u8(value: Column) -> Column:
    """Cut to 0..255 and drop the fraction; callers add one half to round."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(value))).cast("int")


def round_u8(value: Column) -> Column:
    return clamp_u8(value + f32(0.5))


def mirror(index: Column, n: Column) -> Column:
    """Reflect an index once at either border, the border itself not repeated."""
    return F.when(index < 0, -index).when(index >= n, 2 * n - index - 2).otherwise(index).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(77 * r + 150 * g + 29 * b, 8).cast("int")


def top_byte(v16: Column) -> Column:
    return F.shiftright(v16, 8).cast("int")


def unsharp(value: Column, blurred: Column, amount: float = 1.0) -> Column:
    return round_u8(f32(value) + f32(amount) * f32(value - blurred))


def brightness_contrast(value: Column, brightness: float = 20.0, contrast: float = 1.2) -> Column:
    return round_u8(f32(value - 128) * f32(contrast) + f32(128) + f32(brightness))


def normalised_magnitude(sumsq: Column, most: Column) -> Column:
    """sqrt of a gradient's squared length, scaled so that the image's largest becomes 255."""
    root = lambda s: F.sqrt(s.cast("double")).cast("float")
    scale = F.when(most > 0, (F.lit(255.0) / root(most).cast("double")).cast("float")).otherwise(f32(1))
    return round_u8(root(sumsq) * scale)


def equalised(cdf: Column, first: Column, total: Column) -> Column:
    """Table entry of histogram equalisation from an inclusive count, the first non-zero one and all."""
    denom = F.greatest(total - first, F.lit(1))
    share = (f32(cdf - first) / f32(denom)).cast("float")
    return F.when(cdf < first, 0).otherwise(clamp_u8(share * f32(255) + f32(0.5))).cast("int")
