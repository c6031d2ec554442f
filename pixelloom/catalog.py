"""Queries of the raster engine, each over whole driver tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import pixels
from pixelloom.operators import benchmarks, filters, harness, histograms, legacy, quality, tiling
from pixelloom.plans.frame import POINTWISE, ImageFrame, apply_filters
from pixelloom.sources import images

FILTERS = ["blur", "sobel", "sharp", "bc", "histeq"]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.events_raster(spark.read.parquet(f"{sf_dir}/events.parquet"))


def tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.embeddings_raster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# ---- SQL building blocks -------------------------------------------------------------------

R1 = """px AS (
  SELECT CAST(event_id // 1000 AS INT) AS image_id, CAST((event_id % 1000) // 50 AS INT) AS y,
         CAST(event_id % 50 AS INT) AS x, CAST(least(255, floor(value)) AS INT) AS v FROM events)"""
R2 = """px AS (
  SELECT 0 AS image_id, CAST(vec_id AS INT) AS y, CAST(i AS INT) AS x,
         CAST(greatest(0, least(255, floor((CAST(embedding[i + 1] AS DOUBLE) + 1.0) * 127.5))) AS INT) AS v
  FROM embeddings, range(64) r(i))"""


def _mirror(i: str, n: str) -> str:
    return f"(CASE WHEN {i} < 0 THEN -({i}) WHEN {i} >= {n} THEN 2 * {n} - ({i}) - 2 ELSE {i} END)"


def _dims(px: str = "px", name: str = "dims") -> str:
    return f"{name} AS (SELECT image_id, CAST(max(y) + 1 AS INT) AS height, CAST(max(x) + 1 AS INT) AS width FROM {px} GROUP BY image_id)"


def _blurred(px: str = "px", name: str = "blurred") -> str:
    """25 taps by a join with all offsets."""
    return f"""{_dims(px, name + "_dims")}, {name} AS (
  SELECT p.image_id, p.y, p.x, any_value(p.v) AS source,
         CAST((sum(a.w * b.w * q.v) + 128) // 256 AS INT) AS v
  FROM {px} p JOIN {name}_dims d ON d.image_id = p.image_id
  CROSS JOIN (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) a(d, w)
  CROSS JOIN (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) b(d, w)
  JOIN {px} q ON q.image_id = p.image_id AND q.y = {_mirror("p.y + a.d", "d.height")}
    AND q.x = {_mirror("p.x + b.d", "d.width")}
  GROUP BY p.image_id, p.y, p.x)"""


def _steep(px: str = "px", name: str = "steep") -> str:
    return f"""{_dims(px, name + "_dims")}, {name}_parts AS (
  SELECT p.image_id, p.y, p.x,
         sum((CASE a.d WHEN 0 THEN 2 ELSE 1 END) * b.d * q.v) AS gx,
         sum((CASE b.d WHEN 0 THEN 2 ELSE 1 END) * a.d * q.v) AS gy
  FROM {px} p JOIN {name}_dims d ON d.image_id = p.image_id
  CROSS JOIN (VALUES (-1), (0), (1)) a(d) CROSS JOIN (VALUES (-1), (0), (1)) b(d)
  JOIN {px} q ON q.image_id = p.image_id AND q.y = {_mirror("p.y + a.d", "d.height")}
    AND q.x = {_mirror("p.x + b.d", "d.width")}
  GROUP BY p.image_id, p.y, p.x), {name} AS (
  SELECT image_id, y, x, CAST(gx * gx + gy * gy AS INT) AS s FROM {name}_parts)"""


def _u8(value: str) -> str:
    return f"CAST(greatest(0, least(255, floor({value}))) AS INT)"


HALF = "CAST(0.5 AS FLOAT)"


def _scaled(name: str = "scaled", steep: str = "steep") -> str:
    root = lambda s: f"CAST(sqrt(CAST({s} AS DOUBLE)) AS FLOAT)"
    factor = f"(CASE WHEN m > 0 THEN CAST(CAST(255 AS DOUBLE) / CAST({root('m')} AS DOUBLE) AS FLOAT) ELSE CAST(1 AS FLOAT) END)"
    return f"""{name} AS (
  SELECT image_id, y, x, {_u8(f"{root('s')} * {factor} + {HALF}")} AS v
  FROM (SELECT *, max(s) OVER (PARTITION BY image_id) AS m FROM {steep}))"""


def _bc(value: str, brightness: float = 20.0, contrast: float = 1.2) -> str:
    f = lambda x: f"CAST({x} AS FLOAT)"
    return _u8(f"{f(f'({value} - 128)')} * {f(contrast)} + {f(128)} + {f(brightness)} + {HALF}")


def _tables(px: str = "px") -> str:
    """hist (sparse), dense, cdf and lut of an image table."""
    return f"""hist AS (SELECT image_id, v, count(*) AS n FROM {px} GROUP BY image_id, v),
dense AS (SELECT i.image_id, CAST(r.v AS INT) AS v, CAST(coalesce(h.n, 0) AS BIGINT) AS n
  FROM (SELECT DISTINCT image_id FROM {px}) i CROSS JOIN range(256) r(v)
  LEFT JOIN hist h ON h.image_id = i.image_id AND h.v = r.v),
cdf AS (SELECT *, CAST(sum(n) OVER (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cdf FROM dense),
lut_parts AS (SELECT *, min(CASE WHEN cdf > 0 THEN cdf END) OVER (PARTITION BY image_id) AS lo,
  max(cdf) OVER (PARTITION BY image_id) AS total FROM cdf),
lut AS (SELECT image_id, v, CASE WHEN cdf < lo THEN 0 ELSE
  {_u8(f"CAST(CAST(cdf - lo AS FLOAT) / CAST(greatest(total - lo, 1) AS FLOAT) AS FLOAT) * CAST(255 AS FLOAT) + {HALF}")} END AS out
  FROM lut_parts)"""


EQUALISED = "SELECT p.image_id, p.y, p.x, l.out AS v FROM {px} p JOIN lut l ON l.image_id = p.image_id AND l.v = p.v"

# ---- sources and scalar rules --------------------------------------------------------------


@query(f"WITH {R1} SELECT * FROM px")
def raster_events(spark, sf_dir):
    return events(spark, sf_dir)


@query(f"WITH {R2} SELECT * FROM px")
def raster_embeddings(spark, sf_dir):
    return tall(spark, sf_dir)


@query(f"WITH {R1}, {_dims()} SELECT *, 1 AS n_channels, CAST(height AS BIGINT) * width AS bytes FROM dims")
def image_meta(spark, sf_dir):
    return quality.image_meta(events(spark, sf_dir))


@query("SELECT CAST(i AS BIGINT) AS i, CAST(greatest(0, least(255, floor((i - 512) / 2.0))) AS INT) AS v FROM range(2048) r(i)")
def clamp_u8(spark, sf_dir):
    return spark.range(2048).select(F.col("id").alias("i"), pixels.clamp_u8((F.col("id") - 512) / 2.0).alias("v"))


@query(f"SELECT CAST(i - 4 AS INT) AS i, CAST(n AS INT) AS n, CAST({_mirror('i - 4', 'n')} AS INT) AS at FROM range(5, 9) s(n), range(13) r(i) WHERE i - 4 < n + 4")
def mirror_index(spark, sf_dir):
    both = spark.range(5, 9).select(F.col("id").cast("int").alias("n"), F.explode(F.sequence(F.lit(-4), F.lit(8))).alias("i"))
    return both.where("i < n + 4").select("i", "n", pixels.mirror(F.col("i"), F.col("n")).alias("at"))


@query(f"WITH {R1} SELECT image_id, y, x, CAST((77 * v + 150 * ((v * 7 + y) % 256) + 29 * ((v * 13 + x) % 256)) // 256 AS INT) AS v FROM px")
def luma_rgb(spark, sf_dir):
    g, b = (F.col("v") * 7 + F.col("y")) % 256, (F.col("v") * 13 + F.col("x")) % 256
    return events(spark, sf_dir).select("image_id", "y", "x", pixels.luma(F.col("v"), g, b).alias("v"))


@query(f"WITH {R1} SELECT image_id, y, x, CAST((v * 256 + x) // 256 AS INT) AS v FROM px")
def depth_16_to_8(spark, sf_dir):
    return events(spark, sf_dir).select("image_id", "y", "x", pixels.top_byte(F.col("v") * 256 + F.col("x")).alias("v"))


# ---- filters -------------------------------------------------------------------------------

BLUR = "SELECT image_id, y, x, v FROM blurred"
SOBEL = "SELECT image_id, y, x, v FROM scaled"


@query(f"WITH {R1}, {_blurred()} {BLUR}")
def blur(spark, sf_dir):
    return filters.blur(events(spark, sf_dir))


@query(f"WITH {R2}, {_blurred()} {BLUR}")
def blur_tall(spark, sf_dir):
    return filters.blur(tall(spark, sf_dir))


@query(f"WITH {R1}, {_steep()} SELECT image_id, y, x, s FROM steep")
def sobel_sumsq(spark, sf_dir):
    return filters.gradient(events(spark, sf_dir))


@query(f"WITH {R1}, {_steep()} SELECT image_id, max(s) AS max_s FROM steep GROUP BY image_id")
def sobel_max(spark, sf_dir):
    return filters.gradient_peaks(events(spark, sf_dir))


@query(f"WITH {R1}, {_steep()}, {_scaled()} {SOBEL}")
def sobel(spark, sf_dir):
    return filters.sobel(events(spark, sf_dir))


@query(f"WITH {R2}, {_steep()}, {_scaled()} {SOBEL}")
def sobel_tall(spark, sf_dir):
    return filters.sobel(tall(spark, sf_dir))


def _sharp_sql(amount: float) -> str:
    value = f"CAST(source AS FLOAT) + CAST({amount} AS FLOAT) * CAST(source - v AS FLOAT) + {HALF}"
    return f"WITH {R1}, {_blurred()} SELECT image_id, y, x, {_u8(value)} AS v FROM blurred"


@query(_sharp_sql(1.0))
def sharp(spark, sf_dir):
    return filters.sharp(events(spark, sf_dir))


@query(_sharp_sql(0.5))
def sharp_half(spark, sf_dir):
    return filters.sharp(events(spark, sf_dir), 0.5)


@query(f"WITH {R1} SELECT image_id, y, x, {_bc('v')} AS v FROM px")
def bc(spark, sf_dir):
    return filters.bc(events(spark, sf_dir))


@query(f"WITH {R1} SELECT image_id, y, x, {_bc('v', -35.5, 0.73)} AS v FROM px")
def bc_custom(spark, sf_dir):
    return filters.bc(events(spark, sf_dir), -35.5, 0.73)


@query(f"WITH {R1} SELECT image_id, v, count(*) AS n FROM px GROUP BY image_id, v")
def histogram(spark, sf_dir):
    return histograms.histogram(events(spark, sf_dir))


@query(f"WITH {R1}, {_tables()} SELECT image_id, v, n FROM dense")
def histogram_dense256(spark, sf_dir):
    return histograms.dense(histograms.histogram(events(spark, sf_dir)))


@query(f"WITH {R1}, {_tables()} SELECT image_id, v, n, cdf FROM cdf")
def cdf(spark, sf_dir):
    return histograms.cumulative(histograms.histogram(events(spark, sf_dir)))


@query(f"WITH {R1}, {_tables()} SELECT image_id, v, out FROM lut")
def equalize_lut(spark, sf_dir):
    return histograms.equalising_table(histograms.histogram(events(spark, sf_dir)))


@query(f"WITH {R1} SELECT image_id, y, x, CAST((v * 3) % 256 AS INT) AS v FROM px")
def apply_lut(spark, sf_dir):
    px = events(spark, sf_dir)
    table = px.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    return histograms.apply_table(px, table.withColumn("out", (F.col("v") * 3) % 256))


@query(f"WITH {R1}, {_tables()} {EQUALISED.format(px='px')}")
def histeq(spark, sf_dir):
    return histograms.histeq(events(spark, sf_dir))


@query(f"WITH {R2}, {_tables()} {EQUALISED.format(px='px')}")
def histeq_tall(spark, sf_dir):
    return histograms.histeq(tall(spark, sf_dir))


@query(f"WITH {R1}, b AS (SELECT image_id, y, x, {_bc('v')} AS v FROM px), {_tables('b')} {EQUALISED.format(px='b')}")
def chain_bc_histeq(spark, sf_dir):
    return ImageFrame(events(spark, sf_dir)).bc().histeq().to_df()


@query(f"WITH {R1}, {_blurred()}, {_steep('blurred')}, {_scaled()} {SOBEL}")
def chain_blur_sobel(spark, sf_dir):
    return ImageFrame(events(spark, sf_dir)).blur().sobel().to_df()


@query(f"WITH {R1}, b AS (SELECT image_id, y, x, 255 - {_bc('v')} AS v FROM px) SELECT image_id, y, x, {_bc('v', -10.0, 0.9)} AS v FROM b")
def chain_pointwise(spark, sf_dir):
    return ImageFrame(events(spark, sf_dir)).bc().invert().bc(-10.0, 0.9).to_df()


# ---- strips --------------------------------------------------------------------------------

STRIPS = 7
LAYOUT = f"""{_dims()}, layout AS (
  SELECT image_id, CAST(i AS INT) AS strip_id,
    CAST(i * (height // {STRIPS}) + least(i, height % {STRIPS}) AS INT) AS y0,
    CAST(height // {STRIPS} + (CASE WHEN i < height % {STRIPS} THEN 1 ELSE 0 END) AS INT) AS h, height AS img_h
  FROM dims, range({STRIPS}) r(i))"""


def _layout(spark, sf_dir):
    return tiling.strip_layout(quality.image_meta(events(spark, sf_dir)), STRIPS)


@query(f"WITH {R1}, {LAYOUT} SELECT * FROM layout WHERE h > 0")
def strip_layout(spark, sf_dir):
    return _layout(spark, sf_dir)


@query(
    f"""WITH {R1}, {LAYOUT} SELECT image_id, strip_id, CAST(y AS INT) AS y, y < y0 OR y >= y0 + h AS is_halo
  FROM layout, range(100000) r(y) WHERE h > 0 AND y >= greatest(0, y0 - 2) AND y < least(img_h, y0 + h + 2)"""
)
def halo_rows(spark, sf_dir):
    return tiling.halo_rows(_layout(spark, sf_dir), 2)


def _from_strips(px: DataFrame, halo: int, kernel) -> DataFrame:
    return tiling.pixels_of(kernel(tiling.strips_of(px, STRIPS, halo)))


@query(SQL["blur"])
def blur_strips(spark, sf_dir):
    return _from_strips(events(spark, sf_dir), 2, tiling.blur_strips)


@query(SQL["sobel"])
def sobel_strips(spark, sf_dir):
    return _from_strips(events(spark, sf_dir), 1, tiling.sobel_strips)


@query(SQL["sharp"])
def sharp_strips(spark, sf_dir):
    return _from_strips(events(spark, sf_dir), 2, tiling.sharp_strips)


@query(SQL["bc"])
def bc_strips(spark, sf_dir):
    return _from_strips(events(spark, sf_dir), 0, lambda s: tiling.table_strips(s, POINTWISE["bc"](20.0, 1.2)))


@query(SQL["raster_embeddings"])
def tall_strips_to_pixels(spark, sf_dir):
    """A tall image cut to strips, put together as one row and turned to pixels again."""
    return images.images_to_pixels(tiling.images_of(tiling.strips_of(tall(spark, sf_dir), STRIPS, 0))).withColumn("image_id", F.col("image_id").cast("int"))


@query(SQL["histeq_tall"])
def histeq_strips(spark, sf_dir):
    return _from_strips(tall(spark, sf_dir), 0, tiling.histeq_strips)


# ---- quality -------------------------------------------------------------------------------

_SIDES = f"""{R1}, {_blurred()}, pairs AS (SELECT image_id, y, x, source AS a, v AS b FROM blurred),
sums AS (SELECT image_id, CAST(sum((a - b) * (a - b)) AS BIGINT) AS sq, count(*) AS n, max(abs(a - b)) AS max_diff FROM pairs GROUP BY image_id),
report AS (SELECT image_id, round(sq / n, 6) AS mse,
  round(CASE WHEN sq > 0 THEN 20 * log10(CAST(255 AS DOUBLE) / sqrt(sq / n)) END, 6) AS psnr, CAST(max_diff AS INT) AS max_diff FROM sums)"""


@query(f"WITH {_SIDES} SELECT * FROM report")
def psnr_report(spark, sf_dir):
    px = events(spark, sf_dir)
    return quality.psnr_report(px, filters.blur(px))


@query(f"WITH {_SIDES} SELECT image_id, coalesce(psnr, 40) >= 40 AND max_diff <= 2 AS passed FROM report")
def quality_verdict(spark, sf_dir):
    px = events(spark, sf_dir)
    return quality.verdicts(px, filters.blur(px))


@query(f"WITH {R1} SELECT count(DISTINCT image_id) AS n_passed, CAST(0 AS BIGINT) AS n_failed FROM px")
def verdict_counts(spark, sf_dir):
    px = events(spark, sf_dir)
    return quality.verdict_counts(quality.verdicts(px, px))


@query(f"WITH {R1} SELECT DISTINCT image_id, image_id % 2 <> 0 AS same FROM px")
def shape_mismatch(spark, sf_dir):
    px = events(spark, sf_dir)
    return quality.shapes(px, px.where("image_id % 2 <> 0 or y < 19"))


# ---- legacy --------------------------------------------------------------------------------


def _blur3(px: str = "px", name: str = "b3") -> str:
    return f"""{_dims(px, name + "_dims")}, {name} AS (
  SELECT p.image_id, p.y, p.x,
    CASE WHEN p.y IN (0, any_value(d.height) - 1) OR p.x IN (0, any_value(d.width) - 1) THEN CAST(0 AS DOUBLE)
         ELSE sum((2 - abs(a.d)) * (2 - abs(b.d)) * CAST(q.v AS DOUBLE)) / 16.0 END AS v
  FROM {px} p JOIN {name}_dims d ON d.image_id = p.image_id
  CROSS JOIN (VALUES (-1), (0), (1)) a(d) CROSS JOIN (VALUES (-1), (0), (1)) b(d)
  LEFT JOIN {px} q ON q.image_id = p.image_id AND q.y = p.y + a.d AND q.x = p.x + b.d
  GROUP BY p.image_id, p.y, p.x)"""


def _sobel3(px: str = "px", name: str = "s3") -> str:
    return f"""{_dims(px, name + "_dims")}, {name}_parts AS (
  SELECT p.image_id, p.y, p.x, bool_or(p.y IN (0, d.height - 1) OR p.x IN (0, d.width - 1)) AS edge,
    sum((2 - abs(a.d)) * b.d * CAST(q.v AS DOUBLE)) AS gx, sum((2 - abs(b.d)) * a.d * CAST(q.v AS DOUBLE)) AS gy
  FROM {px} p JOIN {name}_dims d ON d.image_id = p.image_id
  CROSS JOIN (VALUES (-1), (0), (1)) a(d) CROSS JOIN (VALUES (-1), (0), (1)) b(d)
  LEFT JOIN {px} q ON q.image_id = p.image_id AND q.y = p.y + a.d AND q.x = p.x + b.d
  GROUP BY p.image_id, p.y, p.x), {name}_m AS (
  SELECT image_id, y, x, CASE WHEN edge THEN 0 ELSE sqrt(gx * gx + gy * gy) END AS m FROM {name}_parts), {name} AS (
  SELECT image_id, y, x, CASE WHEN top > 0 THEN m / top * 255.0 ELSE m END AS v
  FROM (SELECT *, max(m) OVER (PARTITION BY image_id) AS top FROM {name}_m))"""


def _six(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.round("v", 6))


@query(f"WITH {R1}, {_blur3()} SELECT image_id, y, x, round(v, 6) AS v FROM b3")
def legacy_blur3(spark, sf_dir):
    return _six(legacy.blur3(events(spark, sf_dir)))


@query(f"WITH {R1}, {_sobel3()} SELECT image_id, y, x, round(v, 6) AS v FROM s3")
def legacy_sobel3(spark, sf_dir):
    return _six(legacy.sobel3(events(spark, sf_dir)))


@query(f"WITH {R1}, {_blur3()}, {_sobel3('b3')} SELECT image_id, y, x, round(v, 6) AS v FROM s3")
def legacy_chain(spark, sf_dir):
    return _six(legacy.chain(events(spark, sf_dir)))


@query(
    f"""WITH {R1}, {_dims()} SELECT d.image_id, CAST(i AS INT) AS y, CAST(j AS INT) AS x, p.v FROM dims d, range(9) a(i), range(16) b(j)
  JOIN px p ON p.image_id = d.image_id AND p.y = i * d.height // 9 AND p.x = j * d.width // 16"""
)
def resize_nearest(spark, sf_dir):
    return legacy.resize_nearest(events(spark, sf_dir), 9, 16)


@query(
    f"""WITH {R1}, {_dims()}, sizes(height, width) AS (VALUES {", ".join(f"({h}, {w})" for h, w in legacy.LADDER)}),
  scaled AS (SELECT d.image_id, s.height, s.width, CAST(i AS INT) AS y, CAST(j AS INT) AS x, p.v
    FROM dims d CROSS JOIN sizes s, range(480) a(i), range(854) b(j), px p
    WHERE i < s.height AND j < s.width AND p.image_id = d.image_id AND p.y = i * d.height // s.height AND p.x = j * d.width // s.width)
  SELECT image_id, height, width, CAST(sum(v) AS BIGINT) AS sum_v, CAST(sum(v * (y + 3 * x)) AS BIGINT) AS sum_places, count(*) AS n
  FROM scaled GROUP BY image_id, height, width"""
)
def resize_ladder(spark, sf_dir):
    return legacy.ladder_sums(events(spark, sf_dir))


@query(
    f"""WITH {R1}, {_blurred()} SELECT 'blur' AS filter, image_id, y, x, v FROM blurred
  UNION ALL SELECT 'bc', image_id, y, x, {_bc('v')} FROM px"""
)
def filter_list(spark, sf_dir):
    """Filters by a comma-separated list with blanks and empty names."""
    found = apply_filters(events(spark, sf_dir), " blur, ,bc,")
    return found["blur"].withColumn("filter", F.lit("blur")).unionByName(found["bc"].withColumn("filter", F.lit("bc")))


# ---- bench analytics -----------------------------------------------------------------------

_NAMES = "['blur', 'sobel', 'sharp', 'bc', 'histeq']"
RUNS = f"""runs AS (SELECT event_id, event_type AS paradigm, ({_NAMES})[user_id % 5 + 1] AS filter,
  CAST(pow(2, event_id % 4) AS INT) AS threads, CAST(round(value * 100) AS BIGINT) AS t FROM events)"""
STATS = f"""{RUNS}, sums AS (SELECT paradigm, filter, threads, count(*) AS timed, CAST(sum(t) AS BIGINT) AS s,
  CAST(sum(t * t) AS BIGINT) AS q, min(t) AS lo, max(t) AS hi FROM runs GROUP BY paradigm, filter, threads),
st AS (SELECT paradigm, filter, threads, timed, round(s / (timed * CAST(100 AS DOUBLE)), 6) AS mean_ms,
  round(sqrt(CAST(timed * q - s * s AS DOUBLE)) / (timed * CAST(100 AS DOUBLE)), 6) AS stddev_ms,
  lo / CAST(100 AS DOUBLE) AS min_ms, hi / CAST(100 AS DOUBLE) AS max_ms FROM sums)"""
FASTER = """fast AS (SELECT paradigm, filter, threads, mean_ms,
  round(max(CASE WHEN threads = 1 THEN mean_ms END) OVER (PARTITION BY paradigm, filter) / mean_ms, 6) AS speedup FROM st)"""


def runs(spark, sf_dir) -> DataFrame:
    names = F.array(*map(F.lit, FILTERS))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        F.col("event_type").alias("paradigm"),
        F.element_at(names, (F.col("user_id") % 5 + 1).cast("int")).alias("filter"),
        F.pow(F.lit(2), F.col("event_id") % 4).cast("int").alias("threads"),
        F.round(F.col("value") * 100).cast("long").alias("run_ms_x100"),
    )


def stats(spark, sf_dir) -> DataFrame:
    return benchmarks.stats(runs(spark, sf_dir))


@query(f"WITH {STATS} SELECT * FROM st")
def bench_stats(spark, sf_dir):
    return stats(spark, sf_dir)


@query(f"WITH {STATS} SELECT paradigm, filter, threads, mean_ms, CAST(row_number() OVER (PARTITION BY paradigm, filter ORDER BY threads) AS INT) AS place FROM st")
def bench_sorted(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("paradigm", "filter").orderBy("threads"))
    return stats(spark, sf_dir).select("paradigm", "filter", "threads", "mean_ms", place.alias("place"))


@query(f"WITH {STATS} SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY filter ORDER BY mean_ms, paradigm, threads) = 1")
def best_per_filter(spark, sf_dir):
    return benchmarks.best_per_filter(stats(spark, sf_dir))


@query(f"WITH {STATS}, {FASTER} SELECT * FROM fast")
def speedup(spark, sf_dir):
    return benchmarks.speedups(stats(spark, sf_dir))


@query(
    f"""WITH {STATS}, {FASTER} SELECT * FROM fast WHERE threads > 1 AND speedup IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY paradigm ORDER BY speedup DESC, filter, threads) = 1"""
)
def best_speedup_per_paradigm(spark, sf_dir):
    return benchmarks.best_speedup_per_paradigm(stats(spark, sf_dir))


def _pivot_sql(names: list[str]) -> str:
    columns = ", ".join(f"max(CASE WHEN paradigm = '{n}' THEN mean_ms END) AS {n}_ms" for n in names)
    listed = ", ".join(f"'{n}'" for n in names)
    return f"WITH {STATS} SELECT filter, threads, {columns} FROM st WHERE paradigm IN ({listed}) GROUP BY filter, threads"


@query(_pivot_sql(["click", "view", "purchase"]))
def schedule_comparison(spark, sf_dir):
    return benchmarks.pivoted(stats(spark, sf_dir), ["click", "view", "purchase"])


@query(_pivot_sql(["click", "view"]))
def omp_vs_pthread(spark, sf_dir):
    return benchmarks.pivoted(stats(spark, sf_dir), ["click", "view"])


GPU_NAMES = ["blur_naive", "blur_tiled", "sobel", "sharp", "bc", "histeq"]
GPU = f"""gpu AS (SELECT event_id // 3 AS run, (['blur_naive', 'blur_tiled', 'sobel', 'sharp', 'bc', 'histeq'])[(event_id // 3) % 6 + 1] AS filter,
  max(CASE WHEN event_id % 3 = 0 THEN value END) AS h2d_ms, max(CASE WHEN event_id % 3 = 1 THEN value END) AS kernel_ms,
  max(CASE WHEN event_id % 3 = 2 THEN value END) AS d2h_ms FROM events GROUP BY ALL),
whole AS (SELECT * FROM gpu WHERE h2d_ms + kernel_ms + d2h_ms > 0)"""


def gpu(spark, sf_dir) -> DataFrame:
    names = F.array(*map(F.lit, GPU_NAMES))
    part = lambda i: F.max(F.when(F.col("event_id") % 3 == i, F.col("value")))
    grouped = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.expr("event_id div 3").alias("run"))
    table = grouped.agg(part(0).alias("h2d_ms"), part(1).alias("kernel_ms"), part(2).alias("d2h_ms"))
    named = table.withColumn("filter", F.element_at(names, (F.col("run") % 6 + 1).cast("int")))
    return named.where("h2d_ms + kernel_ms + d2h_ms > 0")


@query(
    f"""WITH {GPU} SELECT filter, round(h2d_ms + kernel_ms + d2h_ms, 6) AS total_ms,
  round((h2d_ms + d2h_ms) / (h2d_ms + kernel_ms + d2h_ms) * 100, 6) AS transfer_pct,
  round(kernel_ms / (h2d_ms + kernel_ms + d2h_ms) * 100, 6) AS kernel_pct FROM whole"""
)
def gpu_breakdown(spark, sf_dir):
    return benchmarks.gpu_breakdown(gpu(spark, sf_dir))


@query(
    f"""WITH {GPU}, cents AS (SELECT filter, CAST(round(h2d_ms * 100) AS BIGINT) AS a, CAST(round(kernel_ms * 100) AS BIGINT) AS b,
    CAST(round(d2h_ms * 100) AS BIGINT) AS c FROM whole)
  SELECT filter, count(*) AS timed, round(sum(a) / (count(*) * CAST(100 AS DOUBLE)), 6) AS h2d_ms, round(sum(b) / (count(*) * CAST(100 AS DOUBLE)), 6) AS kernel_ms,
    round(sum(c) / (count(*) * CAST(100 AS DOUBLE)), 6) AS d2h_ms, round((sum(a) + sum(b) + sum(c)) / (count(*) * CAST(100 AS DOUBLE)), 6) AS total_ms
  FROM cents GROUP BY filter"""
)
def gpu_means(spark, sf_dir):
    cents = {f"{p}_x100": F.round(F.col(f"{p}_ms") * 100).cast("long") for p in ("h2d", "kernel", "d2h")}
    return benchmarks.gpu_means(gpu(spark, sf_dir).withColumns(cents))


AXIS = "axis AS (SELECT filter, CAST(CASE WHEN max(threads) > 1 THEN max(threads) ELSE 8 END AS INT) AS max_threads FROM fast WHERE speedup IS NOT NULL GROUP BY filter)"


@query(f"WITH {STATS}, {FASTER}, {AXIS} SELECT * FROM axis")
def thread_axis(spark, sf_dir):
    return benchmarks.thread_axis(stats(spark, sf_dir))


@query(
    f"""WITH {STATS}, {FASTER}, {AXIS} SELECT filter, paradigm, threads, speedup FROM fast WHERE speedup IS NOT NULL
  UNION ALL SELECT filter, 'ideal', n, CAST(n AS DOUBLE) FROM (SELECT filter, unnest([1, max_threads]) AS n FROM axis)"""
)
def speedup_curves(spark, sf_dir):
    return benchmarks.speedup_curves(stats(spark, sf_dir))


@query(
    f"""WITH {STATS} SELECT CAST(list_position({_NAMES}, filter) AS INT) AS place, filter, paradigm, min(mean_ms) AS mean_ms
  FROM st GROUP BY filter, paradigm"""
)
def best_by_paradigm(spark, sf_dir):
    return benchmarks.best_by_paradigm(stats(spark, sf_dir), FILTERS)


@query(
    f"""WITH {STATS} SELECT paradigm, filter, threads, 6000 AS width, 3376 AS height, CAST(20256000 AS INT) AS pixels,
    mean_ms AS mean_s, stddev_ms AS stddev_s, min_ms AS min_s, max_ms AS max_s, 2 AS warmup, CAST(timed AS INT) AS timed FROM st"""
)
def bench_csv(spark, sf_dir):
    """Bench rows appended to a CSV folder in two steps and read back with the fixed schema."""
    found = stats(spark, sf_dir).select(
        "paradigm", "filter", "threads", F.lit(6000).alias("width"), F.lit(3376).alias("height"), F.lit(20256000).alias("pixels"),
        F.col("mean_ms").alias("mean_s"), F.col("stddev_ms").alias("stddev_s"), F.col("min_ms").alias("min_s"), F.col("max_ms").alias("max_s"),
        F.lit(2).alias("warmup"), F.col("timed").cast("int").alias("timed"),
    )
    folder = _folder(spark)
    harness.append_csv(found.where("threads <= 2"), folder)
    harness.append_csv(found.where("threads > 2"), folder)
    return benchmarks.read_bench(spark, folder)


@query(
    f"""WITH {STATS}, {GPU} SELECT paradigm, filter, threads, round(mean_ms, 6) AS mean_ms, CAST(NULL AS DOUBLE) AS kernel_ms FROM st
  UNION ALL SELECT 'cuda', CASE WHEN filter IN ('blur_naive', 'blur_tiled') THEN 'blur' ELSE filter END, 1, round(h2d_ms + kernel_ms + d2h_ms, 6), kernel_ms FROM whole"""
)
def union_cpu_gpu(spark, sf_dir):
    cpu = stats(spark, sf_dir).select("paradigm", "filter", "threads", "mean_ms")
    cuda = benchmarks.relabelled(gpu(spark, sf_dir)).select(
        F.lit("cuda").alias("paradigm"), "filter", F.lit(1).alias("threads"), F.round(F.expr("h2d_ms + kernel_ms + d2h_ms"), 6).alias("mean_ms"), "kernel_ms"
    )
    return cpu.unionByName(cuda, allowMissingColumns=True)


@query(
    f"""WITH {GPU} SELECT min(CASE WHEN filter = 'blur_naive' THEN kernel_ms END) AS naive_ms,
  min(CASE WHEN filter = 'blur_tiled' THEN kernel_ms END) AS tiled_ms FROM whole"""
)
def naive_vs_tiled(spark, sf_dir):
    one = lambda n: F.min(F.when(F.col("filter") == n, F.col("kernel_ms")))
    return gpu(spark, sf_dir).agg(one("blur_naive").alias("naive_ms"), one("blur_tiled").alias("tiled_ms"))


@query(f"WITH {GPU} SELECT run, CASE WHEN filter IN ('blur_naive', 'blur_tiled') THEN 'blur' ELSE filter END AS filter FROM whole")
def relabel(spark, sf_dir):
    return benchmarks.relabelled(gpu(spark, sf_dir)).select("run", "filter")


@query(f"WITH {STATS} SELECT paradigm, filter, threads, mean_ms, CAST(list_position({_NAMES}, filter) AS INT) AS place FROM st")
def filter_order(spark, sf_dir):
    return benchmarks.ordered_as(stats(spark, sf_dir), FILTERS).select("paradigm", "filter", "threads", "mean_ms", "place")


# Files named after the runs: one reference a filter, except one filter has no candidates.
FILES = f"""{RUNS}, refs AS (SELECT DISTINCT 'ref/out_' || filter || '.png' AS path, filter FROM runs),
cands AS (SELECT DISTINCT paradigm || '_' || filter || '_t' || threads || '.png' AS path, filter FROM runs WHERE filter <> 'bc'
  UNION SELECT path, filter FROM refs)"""


def _files(spark, sf_dir):
    found = runs(spark, sf_dir)
    refs = found.select(F.concat(F.lit("ref/out_"), "filter", F.lit(".png")).alias("path"), "filter").distinct()
    own = F.concat("paradigm", F.lit("_"), "filter", F.lit("_t"), F.col("threads").cast("string"), F.lit(".png"))
    return found.where("filter <> 'bc'").select(own.alias("path"), "filter").union(refs).distinct(), refs


@query(f"WITH {FILES} SELECT c.path, c.filter, r.path AS reference FROM cands c LEFT JOIN refs r USING (filter) WHERE r.path IS NULL OR c.path <> r.path")
def candidate_match(spark, sf_dir):
    return quality.candidate_match(*_files(spark, sf_dir)).select("path", "filter", "reference")


@query(f"WITH {FILES} SELECT path, filter FROM refs r WHERE NOT EXISTS (SELECT 1 FROM cands c WHERE c.filter = r.filter AND c.path <> r.path)")
def missing_candidates(spark, sf_dir):
    return quality.missing_candidates(*_files(spark, sf_dir))


@query("SELECT DISTINCT event_type AS paradigm FROM events")
def distinct_paradigms(spark, sf_dir):
    return runs(spark, sf_dir).select("paradigm").distinct().orderBy("paradigm")


@query(
    f"""WITH {RUNS} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat_ws('_', paradigm, filter, 't' || threads, 'static') || '.bmp'
  ELSE concat_ws('_', paradigm, filter, 't' || threads) || '.png' END AS name FROM runs"""
)
def output_name(spark, sf_dir):
    schedule = F.when(F.col("event_id") % 2 == 0, "static")
    path = F.when(F.col("event_id") % 2 == 0, "data.v1/in.bmp").otherwise("data.v1/in")
    name = benchmarks.output_name(F.col("paradigm"), F.col("filter"), F.col("threads"), schedule, path)
    return runs(spark, sf_dir).select("event_id", name.alias("name"))


@query()
def hardware(spark, sf_dir):
    """The driver's machine; executors may have others."""
    model, memory = None, None
    if os.path.exists("/proc/cpuinfo"):
        with open("/proc/cpuinfo") as cpu, open("/proc/meminfo") as mem:
            model = next((line.split(":", 1)[1].strip() for line in cpu if line.startswith("model name")), None)
            memory = next((int(line.split()[1]) for line in mem if line.startswith("MemTotal")), None)
    rows = [(spark.version, spark.sparkContext.defaultParallelism, os.cpu_count(), os.uname().machine, os.uname().sysname, model, memory)]
    return spark.createDataFrame(rows, "spark string, parallelism int, cpus int, machine string, system string, cpu_model string, memory_kb long")


# ---- files ---------------------------------------------------------------------------------


@query(SQL["blur"])
def png_roundtrip(spark, sf_dir):
    """Blurred images written as PNG files, read back and compared by the driver."""
    folder = _folder(spark)
    images.write_png(tiling.images_of(tiling.blur_strips(tiling.strips_of(events(spark, sf_dir), 4, 2))), folder)
    number = F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("int")
    return images.images_to_pixels(images.read_grey(spark, folder).withColumn("image_id", number))


def _folder(spark) -> str:
    """A new folder for files: in the session's checkpoint folder, which all workers share; a temporary one on a single machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="pixelloom-")
    return f"{shared}/pixelloom-{uuid.uuid4().hex}"
