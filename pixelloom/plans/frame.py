"""ImageFrame: a short logical plan of filters over a pixel table, rewritten before it runs.

Rewrites: neighbouring pointwise filters become one 256-entry table (each rounds to 8 bits,
so this is exact); equalisation after a pointwise table takes its histogram from the
histogram before, remapped, so pixels are counted once; sharpening keeps the source column
through the blur. Everything below is left to Catalyst.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators import filters, histograms


def bc_table(brightness: float = 20.0, contrast: float = 1.2) -> list[int]:
    """Brightness and contrast as a table, in single precision."""
    p = np.arange(256, dtype=np.float32)
    value = (p - np.float32(128)) * np.float32(contrast) + np.float32(128) + np.float32(brightness)
    return np.clip(np.floor(value + np.float32(0.5)), 0, 255).astype(int).tolist()


@dataclass(frozen=True)
class Step:
    name: str
    options: tuple = ()


#: Filters that read one pixel: their table for given options.
POINTWISE = {"bc": bc_table, "table": lambda *values: list(values), "invert": lambda: list(range(255, -1, -1))}
#: Filters that read more than one pixel.
WHOLE = {
    "blur": filters.blur,
    "sobel": filters.sobel,
    "sharp": filters.sharp,
    "histeq": histograms.histeq,
}
#: Other names that are accepted.
ALIASES = {"blur_naive": "blur", "blur_tiled": "blur"}


def rewritten(steps: tuple[Step, ...]) -> tuple[Step, ...]:
    """Fuse runs of pointwise steps to one table."""
    out: list[Step] = []
    for step in steps:
        if step.name in POINTWISE:
            table = POINTWISE[step.name](*step.options)
            if out and out[-1].name == "table":
                table = [table[v] for v in out.pop().options]
            step = Step("table", tuple(table))
        out.append(step)
    return tuple(out)


@dataclass(frozen=True)
class ImageFrame:
    """Filters to be applied to ``pixels`` in order."""

    pixels: DataFrame
    steps: tuple[Step, ...] = ()

    def then(self, name: str, *options) -> ImageFrame:
        name = ALIASES.get(name, name)
        if name not in POINTWISE and name not in WHOLE:
            raise ValueError(f"unknown filter {name!r}")
        return replace(self, steps=(*self.steps, Step(name, options)))

    def blur(self) -> ImageFrame:
        return self.then("blur")

    def sobel(self) -> ImageFrame:
        return self.then("sobel")

    def sharp(self, amount: float = 1.0) -> ImageFrame:
        return self.then("sharp", amount)

    def bc(self, brightness: float = 20.0, contrast: float = 1.2) -> ImageFrame:
        return self.then("bc", brightness, contrast)

    def histeq(self) -> ImageFrame:
        return self.then("histeq")

    def invert(self) -> ImageFrame:
        return self.then("invert")

    def to_df(self) -> DataFrame:
        px, before = self.pixels.select("image_id", "y", "x", "v"), None
        for step in rewritten(self.steps):
            if step.name == "table":
                before = (px, list(step.options))
                values = F.array(*map(F.lit, step.options))
                px = px.withColumn("v", F.element_at(values, F.col("v") + 1))
                continue
            if step.name == "histeq" and before:
                # The table's effect on the histogram, then both tables at once on the pixels.
                source, table = before
                equal = histograms.equalising_table(histograms.remapped(histograms.histogram(source), table))
                values = F.array(*map(F.lit, table))
                px = histograms.apply_table(source.withColumn("v", F.element_at(values, F.col("v") + 1)), equal)
            else:
                px = WHOLE[step.name](px, *step.options)
            before = None
        return px


def apply_filters(px: DataFrame, names: str) -> dict[str, DataFrame]:
    """Results of a comma-separated list of filters (``all``: every one); unknown names raise."""
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    if wanted == ["all"]:
        wanted = ["blur", "sobel", "sharp", "bc", "histeq"]
    return {n: ImageFrame(px).then(n).to_df() for n in wanted}
