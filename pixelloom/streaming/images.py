"""Apply pointwise filters to a folder of image files as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pixelloom.plans.frame import POINTWISE
from pixelloom.schema import IMAGES
from pixelloom.sources.images import as_images, decoded


def stream_grey(spark: SparkSession, path: str, files_per_trigger: int = 64, drop_invalid: bool = True) -> DataFrame:
    """New files of ``path`` as image rows.

    Without ``drop_invalid`` a file that can't be decoded here has a row of height -1, so none
    that has bytes goes unseen: JPEG and GIF files as well, whose origins ``read_grey`` takes.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
    rows = as_images(decoded(files))
    return rows.where("height > 0") if drop_invalid else rows


def filtered(images: DataFrame, name: str, *options) -> DataFrame:
    """Pointwise filter on whole-image rows, streaming or not."""
    table = bytes(POINTWISE[name](*options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if d is None else np.frombuffer(d, np.uint8).tobytes().translate(table) for d in batch.column("data").to_pylist()]
            columns = list(batch.columns)
            columns[batch.schema.get_field_index("data")] = pa.array(data, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return images.select(*[f.split()[0] for f in IMAGES.split(", ")]).mapInArrow(run, IMAGES)
