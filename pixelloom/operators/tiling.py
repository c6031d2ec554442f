"""Row strips with halos, and kernels on them in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.schema import STRIPS
from pixelloom.sources.images import pixel_rows

from . import histograms


def strip_layout(images: DataFrame, strips: int) -> DataFrame:
    """Balanced split of each image's rows: strip_id, y0, h; the first strips get the remainder.

    ``images`` has image_id, height. Strips without rows are left out.
    """
    part = images.select("image_id", "height", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip_id"))
    chunk, rest = F.expr(f"height div {strips}").cast("int"), (F.col("height") % strips).cast("int")
    return part.select(
        "image_id",
        "strip_id",
        (F.col("strip_id") * chunk + F.least("strip_id", rest)).cast("int").alias("y0"),
        (chunk + F.when(F.col("strip_id") < rest, 1).otherwise(0)).cast("int").alias("h"),
        F.col("height").alias("img_h"),
    ).where("h > 0")


def halo_rows(layout: DataFrame, halo: int) -> DataFrame:
    """The rows each strip reads: image_id, strip_id, y, is_halo. Rows outside the image are not listed."""
    return (
        layout.withColumn(
            "y",
            F.explode(F.sequence(F.greatest(F.col("y0") - halo, F.lit(0)), F.least(F.col("y0") + F.col("h") + halo, F.col("img_h")) - 1)),
        )
        .select("image_id", "strip_id", "y", ((F.col("y") < F.col("y0")) | (F.col("y") >= F.col("y0") + F.col("h"))).alias("is_halo"))
    )


def image_rows(px: DataFrame) -> DataFrame:
    """image_id, y, width, line: each row of pixels as bytes."""
    line = F.array_sort(F.collect_list(F.struct("x", "v")))
    return px.groupBy("image_id", "y").agg(line.alias("_line")).select(
        "image_id",
        "y",
        F.size("_line").alias("width"),
        F.unhex(F.array_join(F.transform("_line", lambda e: F.lpad(F.hex(e["v"]), 2, "0")), "")).alias("line"),
    )


def strips_of(px: DataFrame, strips: int, halo: int) -> DataFrame:
    """Cut pixel tables to strips whose halo rows are copied in from the neighbours.

    A border row is sent to each strip that reads it, however many strips that spans, and a
    strip's rows meet by (image, strip): the only exchange of a stencil on strips.
    """
    rows = image_rows(px)
    images = rows.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("height"))
    layout = strip_layout(images, strips)
    reads = halo_rows(layout, halo)
    joined = reads.join(rows, ["image_id", "y"]).groupBy("image_id", "strip_id").agg(
        F.array_sort(F.collect_list(F.struct("y", "line"))).alias("_lines"), F.max("width").alias("width")
    )
    bytes_of = F.unhex(F.array_join(F.transform("_lines", lambda e: F.hex(e["line"])), ""))
    return joined.join(layout, ["image_id", "strip_id"]).select(
        F.col("image_id").cast("long").alias("image_id"),
        "strip_id",
        "y0",
        "h",
        "width",
        "img_h",
        F.least(F.lit(halo), F.col("y0")).cast("int").alias("halo_top"),
        F.least(F.lit(halo), F.col("img_h") - F.col("y0") - F.col("h")).cast("int").alias("halo_bot"),
        bytes_of.alias("data"),
    )


def strips_of_images(images: DataFrame, rows_each: int, halo: int) -> DataFrame:
    """Cut whole images (one row each, ``data`` row-major) to strips, without any exchange."""
    count = F.ceil(F.col("height") / rows_each).cast("int")
    part = images.withColumn("strip_id", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("y0", F.col("strip_id") * rows_each)
    top = F.least(F.lit(halo), F.col("y0"))
    h = F.least(F.lit(rows_each), F.col("height") - F.col("y0"))
    bottom = F.least(F.lit(halo), F.col("height") - F.col("y0") - h)
    return part.select(
        "image_id",
        "strip_id",
        F.col("y0").cast("int").alias("y0"),
        h.cast("int").alias("h"),
        "width",
        F.col("height").alias("img_h"),
        top.cast("int").alias("halo_top"),
        bottom.cast("int").alias("halo_bot"),
        F.substring(F.col("data"), (F.col("y0") - top) * F.col("width") + 1, (top + h + bottom) * F.col("width")).alias("data"),
    )


#: Columns of a strip, and the Arrow types of a strip that a kernel returns.
FIELDS = [f.split() for f in STRIPS.split(", ")]
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch; ``data`` stays in its Arrow buffer."""
    names = [n for n in batch.schema.names if n != "data"]
    small = batch.select(names).to_pylist()
    data = batch.column("data")
    for i, row in enumerate(small):
        yield row | {"data": data[i].as_buffer()}


def _done(row: dict, plane: np.ndarray) -> pa.RecordBatch:
    """The strip with new pixels and no halo, around the plane's own memory."""
    body = pa.py_buffer(np.ascontiguousarray(plane))
    offsets = pa.py_buffer(np.array([0, plane.size], np.int32))
    row = row | {"halo_top": 0, "halo_bot": 0}
    columns = [
        pa.Array.from_buffers(pa.binary(), 1, [None, offsets, body]) if n == "data" else pa.array([row[n]], _KINDS[k]) for n, k in FIELDS
    ]
    return pa.RecordBatch.from_arrays(columns, [n for n, _ in FIELDS])


def map_strips(strips: DataFrame, kernel: Callable[[dict], np.ndarray]) -> DataFrame:
    """Replace each strip's pixels by the kernel's; the halo is used up.

    Columns beyond those of a strip are there for the kernel and go no further.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield _done(row, kernel(row))

    return strips.mapInArrow(run, STRIPS)


def _own(row: dict) -> np.ndarray:
    rows = np.frombuffer(row["data"], np.uint8).reshape(-1, row["width"])
    return rows[row["halo_top"] : row["halo_top"] + row["h"]]


def _plane(row: dict, reach: int, kind: type) -> np.ndarray:
    """A strip with ``reach`` rows and columns around it, reflected at the image's borders."""
    width, h, n = row["width"], row["h"], row["img_h"]
    if min(width, n) < reach + 1:
        raise ValueError(f"image has fewer than {reach + 1} rows or columns")
    if row["halo_top"] < min(reach, row["y0"]) or row["halo_bot"] < min(reach, n - row["y0"] - h):
        raise ValueError(f"strip has a halo of fewer than {reach} rows")
    rows = np.frombuffer(row["data"], np.uint8).reshape(-1, width)
    first = row["y0"] - row["halo_top"]
    out = np.empty((h + 2 * reach, width + 2 * reach), kind)
    want = np.arange(row["y0"] - reach, row["y0"] + h + reach)
    inside = (want >= 0) & (want < n)
    start = want[inside][0]
    out[inside, reach:-reach] = rows[start - first : start - first + inside.sum()]
    for at in np.flatnonzero(~inside):
        y = want[at]
        y = -y if y < 0 else 2 * n - y - 2
        # A strip of one row at the border reflects to a row that its own halo holds.
        out[at, reach:-reach] = rows[y - first]
    for k in range(1, reach + 1):
        out[:, reach - k] = out[:, reach + k]
        out[:, width + reach - 1 + k] = out[:, width + reach - 1 - k]
    return out


def blur_kernel(row: dict) -> np.ndarray:
    """Separable binomial sums; the largest, 256 * 255 + 128, fits 16 bits."""
    p = _plane(row, 2, np.uint16)
    across = p[:, 1:-3] + p[:, 3:-1]
    across <<= 2
    across += p[:, :-4]
    across += p[:, 4:]
    across += 6 * p[:, 2:-2]
    down = across[1:-3] + across[3:-1]
    down <<= 2
    down += across[:-4]
    down += across[4:]
    down += 6 * across[2:-2]
    down += 128
    down >>= 8
    return down.astype(np.uint8)


def gradient_kernel(row: dict) -> np.ndarray:
    p = _plane(row, 1, np.int16)
    d = p[:, 2:] - p[:, :-2]
    m = p[:, :-2] + p[:, 2:]
    m += p[:, 1:-1]
    m += p[:, 1:-1]
    gx = d[:-2] + d[2:]
    gx += d[1:-1]
    gx += d[1:-1]
    gy = m[2:] - m[:-2]
    gx, gy = gx.astype(np.int32), gy.astype(np.int32)
    gx *= gx
    gy *= gy
    gx += gy
    return gx


def sharp_kernel(row: dict, amount: float) -> np.ndarray:
    blurred = blur_kernel(row)
    if amount == 1:
        value = _own(row).astype(np.int16)
        value += value
        value -= blurred
        return np.clip(value, 0, 255, out=value).astype(np.uint8)
    source = _own(row).astype(np.float32)
    value = source + np.float32(amount) * (source - blurred.astype(np.float32)) + np.float32(0.5)
    return np.clip(np.floor(value), 0, 255).astype(np.uint8)


#: Images up to which what is known of each goes to the workers with the kernel; beyond, strips are joined with it.
MANY_IMAGES = 1000


def _few(found: DataFrame, n: int) -> list | None:
    """The rows of ``found`` if there are at most ``n``; no more than one above that come to the driver."""
    rows = found.coalesce(1).limit(n + 1).collect()
    return rows if len(rows) <= n else None


def blur_strips(strips: DataFrame) -> DataFrame:
    return map_strips(strips, blur_kernel)


def sharp_strips(strips: DataFrame, amount: float = 1.0) -> DataFrame:
    return map_strips(strips, lambda row: sharp_kernel(row, amount))


def table_strips(strips: DataFrame, table: list[int]) -> DataFrame:
    """Any pointwise 8-bit rule as one pass of a 256-entry table."""
    lut = bytes(table)
    return map_strips(strips, lambda row: np.frombuffer(_own(row).tobytes().translate(lut), np.uint8))


def sobel_strips(strips: DataFrame) -> DataFrame:
    """Two passes: the image's largest gradient, then the scaled gradient of each strip.

    The stencil is cheap to repeat, and so nothing four times the image's size is kept. The
    first pass runs when this is called.
    """

    def peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, int] = {}
        for batch in batches:
            for r in _rows(batch):
                tops[r["image_id"]] = max(tops.get(r["image_id"], 0), int(gradient_kernel(r).max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(tops), pa.int64()), pa.array(list(tops.values()), pa.int64())], ["image_id", "s"])

    most = strips.mapInArrow(peaks, "image_id long, s long").groupBy("image_id").agg(F.max("s").alias("_peak"))
    rows = _few(most, MANY_IMAGES)
    known = {r["image_id"]: r["_peak"] for r in rows or ()}

    def scale(row: dict) -> np.ndarray:
        # Squares stay below 2**24, so single precision holds them, and its roots are the rounded ones.
        value = np.sqrt(gradient_kernel(row).astype(np.float32))
        largest = np.sqrt(np.float32(row["_peak"] if "_peak" in row else known[row["image_id"]]))
        value *= np.float32(np.float64(255.0) / np.float64(largest)) if largest > 0 else np.float32(1)
        value += np.float32(0.5)
        return np.minimum(value, 255, out=value).astype(np.uint8)

    return map_strips(strips if rows is not None else strips.join(most, "image_id"), scale)


def equalising_bytes(counts: np.ndarray) -> bytes:
    """The table of one image from its 256 counts, in the single-precision steps of the Column form."""
    upto = np.cumsum(counts)
    first, total = upto[upto > 0][0], upto[-1]
    part = (upto - first).astype(np.float32) / np.float32(max(total - first, 1))
    value = np.clip(np.floor(part * np.float32(255) + np.float32(0.5)), 0, 255)
    return np.where(upto < first, 0, value).astype(np.uint8).tobytes()


def histeq_strips(strips: DataFrame) -> DataFrame:
    """Strip histograms are summed to image histograms; their tables go back to the strips.

    The histograms are made when this is called. For up to ``MANY_IMAGES`` images the tables
    go out with the kernel.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in _rows(batch):
                n = np.bincount(np.frombuffer(_own(row), np.uint8), minlength=256)
                found[row["image_id"]] = found.get(row["image_id"], 0) + n
        for image_id, n in found.items():
            columns = [pa.array(np.full(256, image_id)), pa.array(np.arange(256, dtype=np.int32)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["image_id", "v", "n"])

    summed = strips.mapInArrow(counts, "image_id long, v int, n long").groupBy("image_id", "v").agg(F.sum("n").alias("n"))
    rows = _few(summed, 256 * MANY_IMAGES)
    if rows is not None:
        held: dict[int, np.ndarray] = {}
        for image_id, v, n in rows:
            held.setdefault(image_id, np.zeros(256, np.int64))[v] = n
        known = {image_id: equalising_bytes(n) for image_id, n in held.items()}
        return map_strips(strips, lambda row: np.frombuffer(_own(row).tobytes().translate(known[row["image_id"]]), np.uint8))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("v", "out"))), lambda e: F.lpad(F.hex(e["out"]), 2, "0"))
    tables = histograms.equalising_table(summed).groupBy("image_id").agg(F.unhex(F.array_join(entries, "")).alias("_table"))
    return map_strips(strips.join(tables, "image_id"), lambda row: np.frombuffer(_own(row).tobytes().translate(row["_table"]), np.uint8))


def pixels_of(strips: DataFrame) -> DataFrame:
    """Strips without halos back to a pixel table."""
    return pixel_rows(strips)


def images_of(strips: DataFrame) -> DataFrame:
    """Strips without halos back to whole images (for sinks only: an image is one row)."""
    joined = strips.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("y0", "data"))).alias("_parts"), F.max("img_h").alias("height"), F.max("width").alias("width")
    )
    return joined.select(
        "image_id",
        F.lit(None).cast("string").alias("origin"),
        "height",
        "width",
        F.lit(1).alias("n_channels"),
        F.lit(0).alias("mode"),
        F.unhex(F.array_join(F.transform("_parts", lambda e: F.hex(e["data"])), "")).alias("data"),
    )
