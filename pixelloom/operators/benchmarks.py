"""Analytics of bench runs: statistics, speedups, best settings, breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.schema import BENCH, GPU_BENCH

#: Names of filter variants and the filter they stand for.
RELABEL = {"blur_tiled": "blur", "blur_naive": "blur"}


def read_bench(spark, path: str, gpu: bool = False, required: bool = True) -> DataFrame:
    """Bench CSV with a fixed schema. A missing optional file gives an empty frame."""
    schema = GPU_BENCH if gpu else BENCH
    if not required:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], schema)
    return spark.read.csv(path, schema=schema, header=True)


def stats(runs: DataFrame) -> DataFrame:
    """Mean, population deviation, least and most of ``run_ms_x100`` in each setting.

    Sums are integers; each figure is divided once and rounded.
    """
    n, s, q = F.count("*"), F.sum("run_ms_x100"), F.sum(F.col("run_ms_x100") * F.col("run_ms_x100"))
    sums = runs.groupBy("paradigm", "filter", "threads").agg(
        n.alias("timed"), s.alias("_s"), q.alias("_q"), F.min("run_ms_x100").alias("_min"), F.max("run_ms_x100").alias("_max")
    )
    spread = (F.col("timed") * F.col("_q") - F.col("_s") * F.col("_s")).cast("double")
    return sums.select(
        "paradigm",
        "filter",
        "threads",
        "timed",
        F.round(F.col("_s") / (F.col("timed") * 100.0), 6).alias("mean_ms"),
        F.round(F.sqrt(spread) / (F.col("timed") * 100.0), 6).alias("stddev_ms"),
        (F.col("_min") / 100.0).alias("min_ms"),
        (F.col("_max") / 100.0).alias("max_ms"),
    )


def _first(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def best_per_filter(found: DataFrame) -> DataFrame:
    """The fastest setting of each filter; ties go to the first by paradigm and threads."""
    return _first(found, ["filter"], F.col("mean_ms"), F.col("paradigm"), F.col("threads"))


def speedups(found: DataFrame) -> DataFrame:
    """Each setting's mean against its own at one thread."""
    one = F.max(F.when(F.col("threads") == 1, F.col("mean_ms"))).over(Window.partitionBy("paradigm", "filter"))
    return found.select("paradigm", "filter", "threads", "mean_ms", F.round(one / F.col("mean_ms"), 6).alias("speedup"))


def best_speedup_per_paradigm(found: DataFrame) -> DataFrame:
    """Largest speedup at more than one thread; ties go to the first filter, then fewer threads."""
    known = speedups(found).where("threads > 1 and speedup is not null")
    return _first(known, ["paradigm"], F.desc("speedup"), F.col("filter"), F.col("threads"))


def pivoted(found: DataFrame, names: list[str]) -> DataFrame:
    """filter, threads and one column of means per paradigm."""
    return found.where(F.col("paradigm").isin(names)).groupBy("filter", "threads").agg(
        *[F.max(F.when(F.col("paradigm") == n, F.col("mean_ms"))).alias(f"{n}_ms") for n in names]
    )


def relabelled(found: DataFrame, rules: dict[str, str] = RELABEL) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    return found.withColumn("filter", F.coalesce(names[F.col("filter")], F.col("filter")))


def gpu_breakdown(found: DataFrame) -> DataFrame:
    """Shares of transfer and kernel in the total."""
    total = F.col("h2d_ms") + F.col("kernel_ms") + F.col("d2h_ms")
    return found.select(
        "filter",
        F.round(total, 6).alias("total_ms"),
        F.round((F.col("h2d_ms") + F.col("d2h_ms")) / total * 100, 6).alias("transfer_pct"),
        F.round(F.col("kernel_ms") / total * 100, 6).alias("kernel_pct"),
    )


def gpu_means(runs: DataFrame) -> DataFrame:
    """Mean of each component over a filter's runs (``*_x100``: hundredths of milliseconds), and the sum of these means."""
    parts = ("h2d", "kernel", "d2h")
    sums = runs.groupBy("filter").agg(F.count("*").alias("timed"), *[F.sum(f"{p}_x100").alias(f"_{p}") for p in parts])
    mean = lambda total: F.round(total / (F.col("timed") * 100.0), 6)
    total = F.col("_h2d") + F.col("_kernel") + F.col("_d2h")
    return sums.select("filter", "timed", *[mean(F.col(f"_{p}")).alias(f"{p}_ms") for p in parts], mean(total).alias("total_ms"))


def thread_axis(found: DataFrame) -> DataFrame:
    """filter, max_threads: how far a filter's speedup curves reach; 8 where they have one point."""
    known = speedups(found).where("speedup is not null")
    most = F.max("threads")
    return known.groupBy("filter").agg(F.when(most > 1, most).otherwise(8).cast("int").alias("max_threads"))


def speedup_curves(found: DataFrame) -> DataFrame:
    """Chart table: the speedup of each paradigm with a run at one thread, and the ideal line's two ends."""
    axis = thread_axis(found)
    ends = F.explode(F.array(F.lit(1), F.col("max_threads")))
    ideal = axis.select("filter", F.lit("ideal").alias("paradigm"), ends.alias("threads")).withColumn("speedup", F.col("threads").cast("double"))
    return speedups(found).where("speedup is not null").select("filter", "paradigm", "threads", "speedup").unionByName(ideal)


def best_by_paradigm(found: DataFrame, names: list[str]) -> DataFrame:
    """Chart table: each filter's least mean in each paradigm, with the filter's place in the chart."""
    return ordered_as(found, names).groupBy("place", "filter", "paradigm").agg(F.min("mean_ms").alias("mean_ms"))


def ordered_as(found: DataFrame, names: list[str]) -> DataFrame:
    """Give each row its filter's place in a fixed order (from 1; others are left out)."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("filter"))
    return found.withColumn("place", place.cast("int")).where("place > 0")


def output_name(prefix: Column, filter_name: Column, threads: Column, schedule: Column, path: Column) -> Column:
    """prefix_filter[_tN][_schedule] with the extension of the path's base name, or .png."""
    base = F.element_at(F.split(path, "/"), -1)
    found = F.regexp_extract(base, r"\.([^.]*)$", 1)
    ending = F.when(F.contains(base, F.lit(".")), found).otherwise("png")
    stem = F.concat_ws("_", prefix, filter_name, F.concat(F.lit("t"), threads.cast("string")), schedule)
    return F.concat(stem, F.lit("."), ending)
