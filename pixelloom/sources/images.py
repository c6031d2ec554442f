"""Read image files to tables and write them back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pixelloom.functions import pixels
from pixelloom.schema import IMAGES

from . import codecs

IMAGE_FIELDS = [f.split()[0] for f in IMAGES.split(", ")]


#: Formats that Spark's image source decodes, and the weights in 65536ths by which their colours become grey.
#: For JPEG these are the weights of its own brightness plane.
BY_SPARK = {"jpeg": (19595, 38470, 7471, 32768), "gif": (77 << 8, 150 << 8, 29 << 8, 0)}

_ROW = "origin string, height int, width int, data binary"


def _image_row(origin: str, plane) -> pa.RecordBatch:
    """One image; no plane: a file that can't be read."""
    shape = (-1, -1) if plane is None else plane.shape
    return pa.RecordBatch.from_pydict(
        {
            "origin": pa.array([origin]),
            "height": pa.array([shape[0]], pa.int32()),
            "width": pa.array([shape[1]], pa.int32()),
            "data": pa.array([None if plane is None else plane.tobytes()], pa.binary()),
        }
    )


def decoded(files: DataFrame) -> DataFrame:
    """origin, height, width, data of files (path, content) in formats decoded here; of others height and width are -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, data in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    plane = codecs.grey(data)
                except codecs.ImageError:
                    plane = None
                yield _image_row(origin, plane)

    return files.select("path", "content").mapInArrow(run, _ROW)


def as_images(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.xxhash64("origin").alias("image_id"), "origin", "height", "width", F.lit(1).alias("n_channels"), F.lit(0).alias("mode"), "data"
    )


def read_grey(spark: SparkSession, path: str | list[str], drop_invalid: bool = False) -> DataFrame:
    """Image files of ``path`` as one row each, one 8-bit channel.

    Files are told apart by their first bytes, whatever their names. PNG, PNM, BMP, TGA, PSD
    and PIC are decoded here; JPEG and GIF by Spark's image source, to which the names of
    these files go (names are what the driver lists anyway). A file that can't be read has height and width -1 and
    no data, or is left out on request. image_id is a hash of the path.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    mark = F.hex(F.substring("content", 1, 4))
    kind = F.when(mark.startswith("FFD8FF"), "jpeg").when(mark == "47494638", "gif")
    found = decoded(files.where(kind.isNull()))
    for name, weights in BY_SPARK.items():
        origins = [r[0] for r in files.where(kind == name).select("path").toLocalIterator()]
        if origins:
            found = found.unionByName(_by_spark(spark, origins, weights))
    if drop_invalid:
        return as_images(found).where("height > 0")
    # Spark lists files of no bytes but reads no row of them.
    names = [(re.sub("^file:///", "file:/", unquote(n)),) for n in files.inputFiles()]
    unread = spark.createDataFrame(names, "origin string").join(files.select(F.col("path").alias("origin")), "origin", "left_anti")
    none = unread.select("origin", F.lit(-1).alias("height"), F.lit(-1).alias("width"), F.lit(None).cast("binary").alias("data"))
    return as_images(found.unionByName(none))


def _by_spark(spark: SparkSession, origins: list[str], weights: tuple[int, ...]) -> DataFrame:
    images = spark.read.format("image").option("dropInvalid", False).load(origins).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        red, green, blue, half = weights
        for batch in batches:
            for origin, height, width, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                plane = None
                if height > 0:
                    px = np.frombuffer(data, np.uint8).reshape(height, width, n)
                    if n < 3:
                        plane = px[..., 0]
                    else:
                        b, g, r = (px[..., i].astype(np.uint32) for i in range(3))
                        plane = ((red * r + green * g + blue * b + half) >> 16).astype(np.uint8)
                yield _image_row(origin, plane)

    narrow = images.select(F.regexp_replace("origin", "^file:///", "file:/").alias("origin"), "height", "width", "nChannels", "data")
    return narrow.mapInArrow(run, _ROW)


#: Pixels of a batch that a worker gives out at once.
PIXELS_AT_ONCE = 1 << 18


def pixel_rows(planes: DataFrame) -> DataFrame:
    """image_id, y, x, v of parts of images (image_id, y0, width, data: whole rows from y0 on).

    Values come straight from the part's buffer, so the work is in proportion to the pixels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            numbers = zip(*(batch.column(c).to_pylist() for c in ("image_id", "y0", "width")))
            for (image_id, y0, width), data in zip(numbers, batch.column("data")):
                values = np.frombuffer(data.as_buffer(), np.uint8)
                step = max(1, PIXELS_AT_ONCE // width) * width
                for a in range(0, len(values), step):
                    v = values[a : a + step]
                    at = np.arange(a, a + len(v), dtype=np.int64)
                    columns = [np.full(len(v), image_id), (y0 + at // width).astype(np.int32), (at % width).astype(np.int32), v.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["image_id", "y", "x", "v"])

    narrow = planes.select(F.col("image_id").cast("long").alias("image_id"), F.col("y0").cast("int").alias("y0"), "width", "data")
    found = narrow.mapInArrow(run, "image_id long, y int, x int, v int")
    return found.withColumn("image_id", F.col("image_id").cast(planes.schema["image_id"].dataType))


def images_to_pixels(images: DataFrame) -> DataFrame:
    """One row per pixel."""
    return pixel_rows(images.where("height > 0").withColumn("y0", F.lit(0)))


def candidate_files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """path, filter of a folder's PNG files whose names hold ``_<filter>_`` or end in ``_<filter>``, in order."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path")
    stem = F.concat(F.regexp_extract("path", r"([^/]*)\.png$", 1), F.lit("_"))
    held = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(stem, F.concat(F.lit("_"), n, F.lit("_"))))
    return listed.select("path", F.explode(held).alias("filter")).distinct().orderBy("filter", "path")


def events_raster(events: DataFrame) -> DataFrame:
    """Images of 20 x 50 pixels from an event table's dense ids and capped values."""
    return events.select(
        F.expr("event_id div 1000").cast("int").alias("image_id"),
        F.expr("(event_id % 1000) div 50").cast("int").alias("y"),
        (F.col("event_id") % 50).cast("int").alias("x"),
        F.least(F.lit(255), F.floor("value")).cast("int").alias("v"),
    )


def embeddings_raster(embeddings: DataFrame) -> DataFrame:
    """One tall image: a row per vector, a column per component."""
    return embeddings.select("vec_id", F.posexplode("embedding").alias("x", "_e")).select(
        F.lit(0).alias("image_id"),
        F.col("vec_id").cast("int").alias("y"),
        "x",
        pixels.clamp_u8((F.col("_e").cast("double") + 1.0) * 127.5).alias("v"),
    )


class PngSink(DataSource):
    """``df.write.format("png_images")``: each image row becomes ``<image_id>.png`` in the folder."""

    @classmethod
    def name(cls) -> str:
        return "png_images"

    def schema(self) -> str:
        return IMAGES

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PngWriter(self.options["path"])


class _PngWriter(DataSourceWriter):
    """Files are written under a temporary name and moved, so that a repeated task does no harm.

    The folder may be in any store that Arrow reaches (file, hdfs, s3, gs); a local one has to
    be shared by all executors. An aborted job takes its files away again.
    """

    def __init__(self, path: str):
        # Spark's "file:/x" is no URI to Arrow.
        self.path = re.sub(r"^file:/+", "/", path)

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, rows) -> WriterCommitMessage:
        import numpy as np
        from pyspark import TaskContext

        store, folder = self._store()
        store.create_dir(folder, recursive=True)
        written = []
        for row in rows:
            plane = np.frombuffer(bytes(row["data"]), np.uint8).reshape(row["height"], row["width"])
            target = f"{folder}/{row['image_id']}.png"
            part = f"{target}.{TaskContext.get().taskAttemptId()}.part"
            with store.open_output_stream(part) as file:
                file.write(codecs.encode_png(plane))
            store.move(part, target)
            written.append(target)
        return _Written(written)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        store, _ = self._store()
        for target in (t for m in messages if m is not None for t in m.targets):
            store.delete_file(target)


@dataclass
class _Written(WriterCommitMessage):
    targets: list[str]


def write_png(images: DataFrame, path: str) -> None:
    images.sparkSession.dataSource.register(PngSink)
    images.select(*IMAGE_FIELDS).write.format("png_images").mode("append").save(path)


def encoded(images: DataFrame) -> DataFrame:
    """image_id, png: files as a column, for sinks that only Spark reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for image_id, height, width, data in zip(*(c.to_pylist() for c in batch.columns)):
                plane = np.frombuffer(data, np.uint8).reshape(height, width)
                yield pa.RecordBatch.from_pydict({"image_id": pa.array([image_id], pa.int64()), "png": pa.array([codecs.encode_png(plane)])})

    return images.where("height > 0").select("image_id", "height", "width", "data").mapInArrow(run, "image_id long, png binary")
