import numpy as np
import pytest

from pixelloom.operators import filters, histograms, quality, tiling
from pixelloom.plans.frame import ImageFrame, Step, apply_filters, bc_table, rewritten

from . import reference_numpy as ref

SCHEMA = "image_id int, y int, x int, v int"
FILTERS = {"blur": filters.blur, "sobel": filters.sobel, "sharp": filters.sharp, "bc": filters.bc, "histeq": histograms.histeq}


def planes():
    rng = np.random.default_rng(1)
    ramp = np.tile(np.arange(40), (6, 1))
    impulse = np.zeros((7, 9), int)
    impulse[3, 4] = 255
    board = np.indices((8, 5)).sum(0) % 2 * 255
    sizes = [(3, 3), (3, 11), (11, 3), (13, 10)]
    constant = [np.full((4, 5), v) for v in (0, 128, 255)]
    return [*constant, ramp, impulse, board, *(rng.integers(0, 256, s) for s in sizes)]


@pytest.fixture(scope="module")
def px(spark):
    rows = [(i, int(y), int(x), int(v)) for i, p in enumerate(planes()) for (y, x), v in np.ndenumerate(p)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def as_planes(df):
    out = [np.full(p.shape, -1) for p in planes()]
    for r in df.collect():
        out[r.image_id][r.y, r.x] = r.v
    return out


@pytest.mark.parametrize("name", FILTERS)
def test_filters_equal_numpy(px, name):
    for got, plane in zip(as_planes(FILTERS[name](px)), planes()):
        assert (got == getattr(ref, name)(plane)).all()


@pytest.mark.parametrize("strips", [1, 2, 3, 7])
def test_strips_equal_whole_images(px, strips):
    for name, halo, kernel in (("blur", 2, tiling.blur_strips), ("sharp", 2, tiling.sharp_strips), ("sobel", 1, tiling.sobel_strips), ("histeq", 0, tiling.histeq_strips)):
        got = as_planes(tiling.pixels_of(kernel(tiling.strips_of(px, strips, halo))))
        for g, plane in zip(got, planes()):
            assert (g == getattr(ref, name)(plane)).all(), name


def test_strips_of_whole_image_rows(spark, px):
    images = tiling.images_of(tiling.strips_of(px, 1, 0))
    got = as_planes(tiling.pixels_of(tiling.blur_strips(tiling.strips_of_images(images, 2, 2))))
    assert all((g == ref.blur(p)).all() for g, p in zip(got, planes()))
    table = as_planes(tiling.pixels_of(tiling.table_strips(tiling.strips_of_images(images, 3, 0), bc_table())))
    assert all((g == ref.bc(p)).all() for g, p in zip(table, planes()))


def test_constant_images(px):
    for name, want in (("blur", lambda v: v), ("sobel", lambda v: 0), ("sharp", lambda v: v), ("histeq", lambda v: 0)):
        for got, v in zip(as_planes(FILTERS[name](px))[:3], (0, 128, 255)):
            assert (got == want(v)).all()


def test_small_images_raise(spark):
    two = spark.createDataFrame([(0, y, x, 1) for y in range(2) for x in range(2)], SCHEMA)
    assert {r.v for r in filters.sobel(two).collect()} == {0}
    with pytest.raises(Exception, match="fewer than 3"):
        filters.blur(two).collect()


def test_plan_rewrites(px):
    plain = histograms.histeq(filters.bc(filters.bc(px), -10.0, 0.9))
    fused = ImageFrame(px).bc().bc(-10.0, 0.9).histeq()
    assert [s.name for s in rewritten(fused.steps)] == ["table", "histeq"]
    assert sorted(plain.collect()) == sorted(fused.to_df().collect())
    assert rewritten((Step("invert"), Step("invert"))) == (Step("table", tuple(range(256))),)
    twice = ImageFrame(px).sharp(0.5).then("blur_tiled").sobel().to_df()
    assert sorted(twice.collect()) == sorted(filters.sobel(filters.blur(filters.sharp(px, 0.5))).collect())


def test_filter_lists(px):
    assert list(apply_filters(px, " bc, ,blur ")) == ["bc", "blur"]
    assert len(apply_filters(px, "all")) == 5
    with pytest.raises(ValueError, match="unknown filter"):
        ImageFrame(px).then("emboss")


def test_quality(spark, px):
    same = quality.psnr_report(px, px).collect()
    assert all(r.psnr is None and r.mse == 0 and r.max_diff == 0 for r in same)
    assert all(r.passed for r in quality.verdicts(px, px).collect())
    other = px.where("image_id <> 2 and (image_id <> 3 or y < 3)")
    assert {r.image_id for r in quality.verdicts(px, other).collect() if not r.passed} == {2, 3}


def test_no_window_holds_a_whole_image(px):
    plan = filters.sobel(filters.blur(px))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan


def test_scaled_images_equal_numpy_and_the_ladder_its_sums(spark):
    from pixelloom.operators import legacy

    rng = np.random.default_rng(4)
    images = [rng.integers(0, 256, s) for s in ((5, 7), (20, 3))]
    # A gap, a null value, places outside and a null image.
    rows = [(i, int(y), int(x), int(v)) for i, p in enumerate(images) for (y, x), v in np.ndenumerate(p) if (i, y, x) != (0, 2, 3)]
    rows = [(i, y, x, None if (i, y, x) == (1, 4, 1) else v) for i, y, x, v in rows] + [(0, -1, 0, 9), (1, 0, -2, 9), (None, 0, 0, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    value = {r[:3]: r[3] for r in rows}
    for h, w in ((2, 3), (9, 16), (5, 7), (40, 2)):
        want = []
        for i, p in enumerate(images):
            for y, x in np.ndindex(h, w):
                source = (i, y * p.shape[0] // h, x * p.shape[1] // w)
                if source in value:
                    want.append((i, y, x, value[source]))
        assert sorted(map(tuple, legacy.resize_nearest(df, h, w).collect()), key=str) == sorted(want, key=str)
    whole = legacy.resize_ladder(df).groupBy("image_id", "height", "width")
    sums = whole.agg({"v": "sum", "*": "count"}).withColumnsRenamed({"sum(v)": "sum_v", "count(1)": "n"})
    got = legacy.ladder_sums(df)
    assert sorted(got.select("image_id", "height", "width", "sum_v", "n").collect()) == sorted(sums.select("image_id", "height", "width", "sum_v", "n").collect())
    places = legacy.resize_ladder(df).selectExpr("image_id", "height", "v * (y + 3 * x) as p").groupBy("image_id", "height").sum("p")
    assert sorted(got.select("image_id", "height", "sum_places").collect()) == sorted(places.collect())


def test_no_table_of_scaled_places_is_joined(spark, px):
    """A planner takes a table of generated places for as small as the images' sizes, and sends it to all."""
    from pixelloom.operators import legacy

    for df in (legacy.resize_nearest(px, 9, 16), legacy.resize_ladder(px), legacy.ladder_sums(px)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" in plan and "Generate" not in plan[plan.index("Join"):]
