"""Small helpers that several operators share: lineage cuts, partition counts, text columns."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it; every other character belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch while a table is written.
BATCH = 1000


def _shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a session on one machine that has none gets a temporary folder."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and context._jsc.sc().getCheckpointDir().isDefined():
        folder = context._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="pixelloom-ckpt-")
        context.setCheckpointDir(folder)
    return folder


#: The open ``passing`` blocks of each thread, the innermost last: folders of the tables written there.
_open: dict[int, list[list[str]]] = {}


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``pinned`` writes inside are deleted at the end, but for ``lasting`` ones, which belong to the block around.

    What leaves the block may read lasting tables only.
    """
    blocks = _open.setdefault(threading.get_ident(), [])
    blocks.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in blocks.pop():
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def pinned(df: DataFrame, narrow: bool = False, lasting: bool = False) -> DataFrame:
    """Cut the lineage of ``df``: it is written as a Parquet table in the shared folder and read back.

    Columns are compressed there, and later plans read those that they need. Tables of a few
    narrow columns (``narrow``) are written by two tasks a core or by a quarter of the shuffle
    partitions, whichever is more: few tiny files where there are many partitions of little.
    In a ``passing`` block the table goes at its end, or (``lasting``) at the end of the one around it.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, shuffle_width(spark) // 4))
    path = f"{_shared_folder(spark)}/pixelloom-{uuid.uuid4().hex}"
    blocks = _open.get(threading.get_ident(), [])
    if len(blocks) > lasting:
        blocks[-1 - lasting].append(path)
    # Small row groups and Arrow batches: tasks buffer one each. Batches of texts would take tens of MB.
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, min(int(before), BATCH) if int(before) > 0 else BATCH)
    try:
        df.write.option("parquet.block.size", 16 << 20).parquet(path)
    finally:
        spark.conf.set(batch, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows, and values that they hold, up to which a side is broadcast; beyond, the join shuffles.
SMALL, SMALL_VALUES = 100_000, 1_000_000


def bounded(df: DataFrame, values: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if its rows, and the sum of ``values`` over them, are few. Counts ``df``."""
    rows, held = df.agg(F.count("*"), F.sum(F.lit(0) if values is None else values)).first()
    return F.broadcast(df) if rows <= SMALL and (held or 0) <= SMALL_VALUES else df


def only(texts: DataFrame, wanted: DataFrame, by: str = "row") -> DataFrame:
    """``texts`` without rows that ``wanted`` (by ``by``) doesn't name, if these are few enough to tell without moving texts."""
    rows = wanted.select(by)
    return texts.join(F.broadcast(rows), by, "left_semi") if rows.count() <= SMALL_VALUES else texts


def heap_given_back(spark: SparkSession) -> None:
    """Ask every executor for a full collection, by a task on each core.

    A stage of the pipeline leaves a JVM's heap as large as it ever became, and the next stage's
    Python workers and direct buffers come on top of it. A full collection shrinks the heap to
    what is in use. Where an explicit collection is switched off, nothing happens.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(*names: str) -> Column:
    """64-bit key of a row's content. Rows that agree in the columns share a key."""
    return F.xxhash64(*names)


def fold_is_held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 5, is 0; a null id counts as the text ''."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5) == 0


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 1000):
    """``run`` for mapInArrow with a small memory: batches of texts come in slices of ``rows``
    rows, and what Arrow and the C library have kept for reuse goes back at the end, as workers outlive their tasks.
    """

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                yield batch.slice(a, rows)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(sliced(batches))
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped
