"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Three kinds of figures: queries over the driver tables, written to the noop sink; the five
filters on cached strips of images as large as the published workload (6000 x 3376 pixels),
after one warm-up run: the mean of three, with all passes that a filter makes; and the way of one such
image from a PNG file through a blur to a pixel table.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "blur",
    "sobel",
    "sharp",
    "bc",
    "histeq",
    "chain_bc_histeq",
    "blur_tall",
    "sobel_tall",
    "histeq_tall",
    "psnr_report",
    "legacy_chain",
    "bench_stats",
    "best_speedup_per_paradigm",
]
WIDTH, HEIGHT = 6000, 3376


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from pixelloom import catalog
    from pixelloom.operators import tiling
    from pixelloom.plans.frame import bc_table
    from pixelloom.sources import images as images_source

    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # A strip is a few MB; a batch of many would not fit a worker.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(make, runs: int = 1) -> float:
        began = time.perf_counter()
        for _ in range(runs):
            make().write.format("noop").mode("overwrite").save()
        return round((time.perf_counter() - began) / runs, 4)

    queries = {}
    for name in HEADLINES:
        df = catalog.QUERIES[name](spark, sf_dir)
        seconds(lambda: df)
        queries[name] = seconds(lambda: df)

    # One image and a batch of eight, made of pseudo-random bytes, cut and cached beforehand.
    mpx = WIDTH * HEIGHT / 1e6
    throughput = {}
    for images in (1, 8):
        # Two strips a core for one image on eight cores.
        rows = 211
        blocks = spark.range(images * -(-HEIGHT // rows)).select(
            F.expr(f"id div {-(-HEIGHT // rows)}").alias("image_id"), F.expr(f"cast(id % {-(-HEIGHT // rows)} as int)").alias("strip_id")
        )
        strips = _random_strips(blocks, rows, 2).persist()
        strips.count()
        jobs = {
            "blur": tiling.blur_strips,
            "sobel": tiling.sobel_strips,
            "sharp": tiling.sharp_strips,
            "bc": lambda s: tiling.table_strips(s, bc_table()),
            "histeq": tiling.histeq_strips,
        }
        for name, job in jobs.items():
            make = lambda: job(strips)  # noqa: B023, E731
            seconds(make)
            took = seconds(make, 3)
            queries[f"{name}_20mpx_x{images}"] = took
            throughput[f"{name}_x{images}"] = round(images * mpx / took, 1)
        strips.unpersist()
    with tempfile.TemporaryDirectory() as folder:
        with open(f"{folder}/0.png", "wb") as file:
            file.write(_ramp())

        def from_file():
            strips = tiling.strips_of_images(images_source.read_grey(spark, folder, drop_invalid=True), 211, 2)
            return tiling.pixels_of(tiling.blur_strips(strips))

        queries["png_to_blurred_pixels_20mpx"] = seconds(from_file)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "mpx_per_s": throughput,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


def _ramp() -> bytes:
    """A PNG file of the published size."""
    import numpy as np

    from pixelloom.sources import codecs

    plane = np.add.outer(np.arange(HEIGHT) // 9, np.arange(WIDTH) // 11).astype(np.uint8)
    return codecs.encode_png(plane, level=1)


def _random_strips(blocks, rows: int, halo: int):
    """Strips of images of pseudo-random pixels; a strip's halo rows are its neighbours' rows."""
    import numpy as np
    import pyarrow as pa

    from pixelloom.schema import STRIPS

    def run(batches):
        for batch in batches:
            for image, strip in zip(*(c.to_pylist() for c in batch.columns)):
                y0 = strip * rows
                h = min(rows, HEIGHT - y0)
                top, bottom = min(halo, y0), min(halo, HEIGHT - y0 - h)
                lines = [np.random.default_rng((image, y)).integers(0, 256, WIDTH, np.uint8) for y in range(y0 - top, y0 + h + bottom)]
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "image_id": image,
                            "strip_id": strip,
                            "y0": y0,
                            "h": h,
                            "width": WIDTH,
                            "img_h": HEIGHT,
                            "halo_top": top,
                            "halo_bot": bottom,
                            "data": np.stack(lines).tobytes(),
                        }
                    ],
                    schema=pa.schema(
                        [("image_id", pa.int64()), *[(n, pa.int32()) for n in ("strip_id", "y0", "h", "width", "img_h", "halo_top", "halo_bot")], ("data", pa.binary())]
                    ),
                )

    return blocks.mapInArrow(run, STRIPS)


if __name__ == "__main__":
    main()
