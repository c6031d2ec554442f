"""Timing of filters and the tables and text made of it."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.schema import BENCH

from . import tiling


def timed(job: Callable[[], DataFrame], warmup: int = 2, runs: int = 5) -> dict[str, float]:
    """Run a frame into the noop sink; mean, population deviation, least and most in seconds."""
    if runs < 1:
        raise ValueError("at least one timed run is needed")
    took = []
    for i in range(warmup + runs):
        began = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        if i >= warmup:
            took.append(time.perf_counter() - began)
    return {"mean_s": statistics.fmean(took), "stddev_s": statistics.pstdev(took), "min_s": min(took), "max_s": max(took)}


KERNELS = {
    "blur": (2, tiling.blur_strips),
    "sobel": (1, tiling.sobel_strips),
    "sharp": (2, tiling.sharp_strips),
    "histeq": (0, tiling.histeq_strips),
}


def sweep(spark: SparkSession, images: DataFrame, names: list[str], rows_each: list[int], warmup: int = 2, runs: int = 5) -> DataFrame:
    """Bench rows of strip filters for several strip heights (the stand-in for thread counts and schedules)."""
    first = images.agg(F.max("width"), F.max("height"), F.sum(F.col("width").cast("long") * F.col("height"))).first()
    rows = []
    for rows_of in rows_each:
        for name in names:
            halo, kernel = KERNELS[name]
            strips = tiling.strips_of_images(images, rows_of, halo).persist()
            n = strips.count()
            found = timed(lambda: kernel(strips), warmup, runs)
            strips.unpersist()
            rows.append(("spark", name, n, first[0], first[1], int(first[2]), *(round(found[k], 6) for k in ("mean_s", "stddev_s", "min_s", "max_s")), warmup, runs))
    return spark.createDataFrame(rows, BENCH)


def append_csv(found: DataFrame, path: str) -> None:
    """Add bench rows to a CSV folder; each file carries the header."""
    found.coalesce(1).write.mode("append").option("header", True).csv(path)


def summary(best: DataFrame, speedups: DataFrame) -> str:
    """Text of the best setting per filter and the best speedup per paradigm (a few rows each)."""
    lines = ["Best setting per filter"]
    lines += [f"  {r['filter']:<8} {r['paradigm']:<12} N={r['threads']:<3} {r['mean_ms']:.3f} ms" for r in best.orderBy("filter").collect()]
    lines += ["Best speedup per paradigm"]
    lines += [f"  {r['paradigm']:<12} {r['filter']:<8} {r['speedup']:.2f}x at N={r['threads']}" for r in speedups.orderBy("paradigm").collect()]
    return "\n".join(lines) + "\n"
