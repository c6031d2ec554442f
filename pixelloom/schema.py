"""Table schemas of the engine."""

from __future__ import annotations

#: One row per pixel of a greyscale image.
PIXELS = "image_id long, y int, x int, v int"
#: One row per image, rows of 8-bit pixels in ``data``.
IMAGES = "image_id long, origin string, height int, width int, n_channels int, mode int, data binary"
#: A run of image rows with the rows above and below that a stencil reads.
STRIPS = (
    "image_id long, strip_id int, y0 int, h int, width int, img_h int, halo_top int, halo_bot int, data binary"
)
#: Run statistics as the bench tables hold them.
BENCH = (
    "paradigm string, filter string, threads int, width int, height int, pixels int, "
    "mean_s double, stddev_s double, min_s double, max_s double, warmup int, timed int"
)
GPU_BENCH = f"{BENCH}, h2d_ms double, kernel_ms double, d2h_ms double"
