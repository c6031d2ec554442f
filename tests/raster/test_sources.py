import struct
import zlib

import numpy as np
import pytest

from pixelloom.operators import benchmarks, harness
from pixelloom.sources import codecs, images
from pixelloom.streaming import images as stream


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(samples, depth, colour, rules, palette=None):
    """A PNG whose rows use the given filters in turn."""
    height = samples.shape[0]
    flat = samples.reshape(height, -1)
    if depth == 16:
        raw = flat.astype(">u2").tobytes()
    elif depth == 8:
        raw = flat.astype(np.uint8).tobytes()
    else:
        bits = ((flat[..., None] >> np.arange(depth - 1, -1, -1)) & 1).reshape(height, -1)
        raw = np.packbits(bits.astype(np.uint8), axis=1).tobytes()
    stride, step = len(raw) // height, max(1, depth * samples.shape[2] // 8)
    before, body = bytes(stride), b""
    for y in range(height):
        line, rule, out = raw[y * stride : (y + 1) * stride], rules[y % len(rules)], bytearray()
        for i, v in enumerate(line):
            a, b, c = (line[i - step] if i >= step else 0), before[i], (before[i - step] if i >= step else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - [0, a, b, (a + b) // 2, paeth][rule]) & 255)
        body += bytes([rule]) + bytes(out)
        before = line
    head = struct.pack(">IIBBBBB", samples.shape[1], height, depth, colour, 0, 0, 0)
    parts = chunk(b"IHDR", head) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"")
    return b"\x89PNG\r\n\x1a\n" + parts + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def luma(px):
    px = px.astype(np.uint32)
    return (77 * px[..., 0] + 150 * px[..., 1] + 29 * px[..., 2]) >> 8


@pytest.mark.parametrize("rules", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4]])
def test_png_kinds(rules):
    rng = np.random.default_rng(1)
    grey, rgba = rng.integers(0, 256, (9, 7, 1)), rng.integers(0, 256, (9, 7, 4))
    wide, four = rng.integers(0, 65536, (9, 7, 1)), rng.integers(0, 16, (9, 7, 1))
    palette = rng.integers(0, 256, (16, 3)).astype(np.uint8)
    assert (codecs.grey(png(grey, 8, 0, rules)) == grey[..., 0]).all()
    assert (codecs.grey(png(wide, 16, 0, rules)) == wide[..., 0] >> 8).all()
    assert (codecs.grey(png(rgba, 8, 6, rules)) == luma(rgba)).all()
    assert (codecs.grey(png(rgba[..., :3], 8, 2, rules)) == luma(rgba)).all()
    assert (codecs.grey(png(four, 4, 0, rules)) == four[..., 0] * 17).all()
    assert (codecs.grey(png(four, 4, 3, rules, palette)) == luma(palette[four[..., 0]])).all()


def test_other_formats():
    rng = np.random.default_rng(2)
    px = rng.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    assert (codecs.grey(b"P6\n# note\n6 5\n255\n" + px.tobytes()) == luma(px)).all()
    assert (codecs.grey(b"P5 6 5 255\n" + px[..., 0].tobytes()) == px[..., 0]).all()
    rows = b"".join(line[:, ::-1].tobytes() + b"\0\0" for line in px[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 6, 5, 1, 24, 0, 0, 0, 0, 0, 0) + rows
    assert (codecs.grey(bmp) == luma(px)).all()
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 6, 5, 24, 32)
    assert (codecs.grey(head + px[..., ::-1].tobytes()) == luma(px)).all()
    packed = struct.pack("<BBBHHBHHHHBB", 0, 0, 11, 0, 0, 0, 0, 0, 6, 5, 8, 32) + bytes([128 + 29, 77])
    assert (codecs.grey(packed) == 77).all()
    psd = b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, 5, 6, 8, 3) + struct.pack(">III", 0, 0, 0) + struct.pack(">H", 0)
    assert (codecs.grey(psd + np.moveaxis(px, -1, 0).tobytes()) == luma(px)).all()


def test_pic():
    px = np.random.default_rng(4).integers(0, 256, (3, 5, 3)).astype(np.uint8)
    px[1] = px[1, 0]
    head = b"\x53\x80\xf6\x34" + struct.pack(">f80s4sHHfHH", 1.0, b"", b"PICT", 5, 3, 1.0, 3, 0)
    raw = head + bytes([0, 8, 0, 0xE0]) + px.tobytes()
    assert (codecs.grey(raw) == luma(px)).all()
    lines = bytes([4]) + px[0].tobytes() + bytes([128, 0, 5]) + px[1, 0].tobytes() + bytes([4]) + px[2].tobytes()
    assert (codecs.grey(head + bytes([0, 8, 2, 0xE0]) + lines) == luma(px)).all()
    runs = b"".join(bytes([1]) + bytes(p) for p in px[0]) + bytes([5]) + px[1, 0].tobytes() + b"".join(bytes([1]) + bytes(p) for p in px[2])
    assert (codecs.grey(head + bytes([0, 8, 1, 0xE0]) + runs) == luma(px)).all()
    with pytest.raises(codecs.ImageError):
        codecs.grey(raw[:-4])


def bmp_file(width, height, bits, rows, extra=b"", packed=0):
    start = 54 + len(extra)
    head = b"BM" + struct.pack("<IHHI", start + len(rows), 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, packed, 0, 0, 0, 0, 0) + extra + rows


def test_small_bmp_and_tga_depths():
    rng = np.random.default_rng(5)
    palette = rng.integers(0, 256, (16, 4)).astype(np.uint8)
    four = rng.integers(0, 16, (3, 5))
    rows = b"".join(bytes([int(r[0]) << 4 | int(r[1]), int(r[2]) << 4 | int(r[3]), int(r[4]) << 4, 0]) for r in four[::-1])
    assert (codecs.grey(bmp_file(5, 3, 4, rows, palette.tobytes())) == luma(palette[four][..., 2::-1])).all()
    words = rng.integers(0, 1 << 15, (2, 4)).astype("<u2")
    fives = np.stack([words >> 10 & 31, words >> 5 & 31, words & 31], -1).astype(np.uint32) * 255 // 31
    assert (codecs.grey(bmp_file(4, -2, 16, words.tobytes())) == luma(fives)).all()
    masks = struct.pack("<III", 0xF800, 0x07E0, 0x001F)
    parts = np.stack([(words >> 11 & 31).astype(np.uint32) * 255 // 31, (words >> 5 & 63).astype(np.uint32) * 255 // 63, (words & 31).astype(np.uint32) * 255 // 31], -1)
    assert (codecs.grey(bmp_file(4, -2, 16, words.tobytes(), masks, 3)) == luma(parts)).all()
    for bits in (15, 16):
        head = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 4, 2, bits, 32)
        assert (codecs.grey(head + words.tobytes()) == luma(fives)).all()


BROKEN = [
    b"", b"no image", b"P5 9 9 255\nxx", b"\x89PNG\r\n\x1a\n", b"BM" + b"\0" * 60, b"P5 99999999 2 255\n",
    png(np.zeros((4, 4, 1), int), 8, 0, [0]).replace(struct.pack(">II", 4, 4), struct.pack(">II", 4, 9)),
    bmp_file(5, 3, 24, b"\0" * 20), b"P5 x 9 255\n", b"P5 # no end",
    b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, 5, 6, 8, 3) + struct.pack(">III", 0, 0, 0) + struct.pack(">H", 0) + b"\1" * 10,
]


@pytest.mark.parametrize("data", BROKEN)
def test_broken_files(data):
    with pytest.raises(codecs.ImageError):
        codecs.grey(data)


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (300, 5), (33, 40)])
def test_png_rows_take_the_filter_of_least_sum(shape):
    rng = np.random.default_rng(8)
    noise = rng.integers(0, 256, shape).astype(np.uint8)
    ramp = (np.add.outer(np.arange(shape[0]) * 3, np.arange(shape[1]) * 2) + rng.integers(0, 3, shape)).astype(np.uint8)
    for plane in (noise, ramp, np.zeros(shape, np.uint8)):
        assert (codecs.grey(codecs.encode_png(plane)) == plane).all()
    raw = zlib.decompress(codecs.encode_png(ramp).split(b"IDAT")[1][:-16])
    lines = np.frombuffer(raw, np.uint8).reshape(shape[0], shape[1] + 1)
    padded = np.zeros((shape[0] + 1, shape[1] + 1), int)
    padded[1:, 1:] = ramp
    a, b, c = padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]
    p = a + b - c
    paeth = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
    sums = np.stack([abs((ramp - x).astype(np.uint8).view(np.int8).astype(int)).sum(1) for x in (0 * a, a, b, (a + b) // 2, paeth)])
    assert (sums[lines[:, 0], np.arange(shape[0])] == sums.min(0)).all()


def java_image(spark, plane, kind):
    """An image file's bytes, made by the JVM."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    height, width = plane.shape[:2]
    image = jvm.java.awt.image.BufferedImage(width, height, 1 if plane.ndim == 3 else 10)
    for y in range(height):
        for x in range(width):
            if plane.ndim == 3:
                r, g, b = (int(v) for v in plane[y, x])
                image.setRGB(x, y, r << 16 | g << 8 | b)
            else:
                image.getRaster().setSample(x, y, 0, int(plane[y, x]))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, kind, out) and gateway
    return bytes(out.toByteArray())


def test_every_file_has_one_row(spark, tmp_path):
    rng = np.random.default_rng(6)
    smooth = np.add.outer(np.arange(24) * 4, np.arange(32) * 3).astype(np.uint8)
    colours = np.stack([smooth, smooth[::-1], 255 - smooth], -1)
    jpeg, colour, gif = java_image(spark, smooth, "jpg"), java_image(spark, colours, "jpg"), java_image(spark, smooth // 64 * 64, "gif")
    plane = rng.integers(0, 256, (6, 7)).astype(np.uint8)
    files = {
        "ok.jpg": jpeg, "ok2.bin": jpeg, "colour.png": colour, "ok.gif": gif, "x.jpg": codecs.encode_png(plane), "y.png": codecs.encode_png(plane),
        "cut.jpg": jpeg[:40], "cut.bmp": bmp_file(5, 3, 24, b"\0" * 20), "empty.png": b"", "text.txt": b"words",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = images.read_grey(spark, str(tmp_path)).collect()
    found = {r.origin.rsplit("/", 1)[1]: r for r in rows}
    assert len(rows) == len(files) and set(found) == set(files)
    assert {n for n, r in found.items() if r.height < 0} == {"cut.jpg", "cut.bmp", "empty.png", "text.txt"}
    grey = lambda n: np.frombuffer(bytes(found[n].data), np.uint8).reshape(found[n].height, found[n].width)
    assert (grey("x.jpg") == plane).all() and (grey("y.png") == plane).all()
    assert abs(grey("ok.jpg").astype(int) - smooth).max() <= 8 and (grey("ok.jpg") == grey("ok2.bin")).all()
    assert (grey("ok.gif") == smooth // 64 * 64).mean() > 0.9
    bright = colours @ np.array([0.299, 0.587, 0.114])
    assert abs(grey("colour.png") - bright).mean() < 4
    # As a stream no file with any bytes goes unseen either.
    seen = stream.stream_grey(spark, str(tmp_path), drop_invalid=False)
    job = seen.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c" / "p")).start()
    try:
        job.processAllAvailable()
    finally:
        job.stop()
    assert spark.sql("select * from seen").count() == len(files) - 1


def test_candidates_of_a_folder(spark, tmp_path):
    names = ["omp_blur_t4.png", "seq_blur.png", "blur.png", "a_blur_sobel.png", "omp_bc_t2.bmp", "omp_blurred_t1.png"]
    for n in names:
        (tmp_path / n).write_bytes(b"x")
    found = [(r.filter, r.path.rsplit("/", 1)[1]) for r in images.candidate_files(spark, str(tmp_path), ["blur", "sobel", "bc"]).collect()]
    assert found == [("blur", "a_blur_sobel.png"), ("blur", "omp_blur_t4.png"), ("blur", "seq_blur.png"), ("sobel", "a_blur_sobel.png")]


def test_pixels_of_a_large_image(spark):
    plane = np.random.default_rng(7).integers(0, 256, (700, 1000)).astype(np.uint8)
    table = spark.createDataFrame([(5, 700, 1000, bytearray(plane.tobytes()))], "image_id long, height int, width int, data binary")
    px = images.images_to_pixels(table).toPandas()
    assert len(px) == plane.size and (plane[px.y, px.x] == px.v).all() and px.groupby(["y", "x"]).ngroups == plane.size


def test_write_and_read_back(spark, tmp_path):
    rng = np.random.default_rng(3)
    planes = {i: rng.integers(0, 256, (4 + i, 9)).astype(np.uint8) for i in range(3)}
    rows = [(i, None, *p.shape, 1, 0, bytearray(p.tobytes())) for i, p in planes.items()]
    table = spark.createDataFrame(rows, "image_id long, origin string, height int, width int, n_channels int, mode int, data binary")
    images.write_png(table, str(tmp_path / "out"))
    (tmp_path / "out" / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nrubbish")
    read = images.read_grey(spark, str(tmp_path / "out"))
    found = {r.origin.rsplit("/", 1)[1]: r for r in read.collect()}
    assert found["broken.png"].height == -1 and found["broken.png"].data is None
    for i, p in planes.items():
        assert bytes(found[f"{i}.png"].data) == p.tobytes()
    assert images.read_grey(spark, str(tmp_path / "out"), drop_invalid=True).count() == 3
    native = spark.read.format("image").option("dropInvalid", True).load(str(tmp_path / "out")).select("image.*").collect()
    assert sorted(bytes(r.data) for r in native) == sorted(p.tobytes() for p in planes.values())
    assert {r.image_id: codecs.grey(bytes(r.png)).tobytes() for r in images.encoded(table).collect()} == {i: p.tobytes() for i, p in planes.items()}
    px = images.images_to_pixels(table).collect()
    assert all(planes[r.image_id][r.y, r.x] == r.v for r in px) and len(px) == sum(p.size for p in planes.values())


def test_stream(spark, tmp_path):
    plane = np.arange(12, dtype=np.uint8).reshape(3, 4)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(codecs.encode_png(plane))
    (tmp_path / "in" / "b.png").write_bytes(b"rubbish")
    out = stream.filtered(stream.stream_grey(spark, str(tmp_path / "in")), "invert")
    job = out.writeStream.format("memory").queryName("inverted").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        job.processAllAvailable()
    finally:
        job.stop()
    (row,) = spark.sql("select * from inverted").collect()
    assert bytes(row.data) == (255 - plane).tobytes()


def test_bench_csv(spark, tmp_path):
    path = tmp_path / "runs.csv"
    path.write_text("paradigm,filter,threads,width,height,pixels,mean_s,stddev_s,min_s,max_s,warmup,timed\nseq,blur,1,6000,3376,20256000,1.380755,0.224297,1.126007,1.764593,2,5\n")
    (row,) = benchmarks.read_bench(spark, str(path)).collect()
    assert (row.paradigm, row.threads, row.mean_s) == ("seq", 1, 1.380755)
    assert benchmarks.read_bench(spark, str(tmp_path / "none.csv"), gpu=True, required=False).count() == 0


def test_timing_and_summary(spark, tmp_path):
    plane = np.arange(60, dtype=np.uint8).reshape(6, 10)
    table = spark.createDataFrame(
        [(1, None, 6, 10, 1, 0, bytearray(plane.tobytes()))],
        "image_id long, origin string, height int, width int, n_channels int, mode int, data binary",
    )
    found = harness.sweep(spark, table, ["blur", "histeq"], [3], warmup=0, runs=1)
    rows = found.collect()
    assert [(r.filter, r.threads, r.pixels, r.timed) for r in rows] == [("blur", 2, 60, 1), ("histeq", 2, 60, 1)]
    for _ in range(2):
        harness.append_csv(found, str(tmp_path / "bench"))
    assert benchmarks.read_bench(spark, str(tmp_path / "bench")).count() == 4
    with pytest.raises(ValueError):
        harness.timed(lambda: found, runs=0)
    best = spark.createDataFrame([("blur", "seq", 1, 2.5)], "filter string, paradigm string, threads int, mean_ms double")
    fast = spark.createDataFrame([("seq", "blur", 4, 3.5)], "paradigm string, filter string, threads int, speedup double")
    assert "3.50x at N=4" in harness.summary(best, fast)
