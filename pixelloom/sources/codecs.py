"""Decoders of lossless image files and a PNG encoder, on the standard library and numpy.

Each decoder gives (samples, channels last, 8 or 16 bit). JPEG and GIF go through Spark's
own image source instead.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Largest side that is accepted.
MOST_SIDE = 1 << 24


class ImageError(ValueError):
    """The bytes are no image of a supported kind."""


def kind_of(data: bytes) -> str:
    """Format by its first bytes; TGA has no mark and comes last."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if data[:2] == b"BM":
        return "bmp"
    if data[:4] in (b"GIF8",):
        return "gif"
    if data[:4] == b"8BPS":
        return "psd"
    if data[:4] == b"\x53\x80\xf6\x34":
        return "pic"
    if data[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if data[:2] in (b"P5", b"P6"):
        return "pnm"
    if len(data) >= 18 and data[1] in (0, 1) and data[2] in (1, 2, 3, 9, 10, 11) and data[16] in (8, 15, 16, 24, 32):
        return "tga"
    return "unknown"


def _sides(width: int, height: int) -> None:
    if not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE):
        raise ImageError(f"bad image size {width} x {height}")


def decode_png(data: bytes) -> np.ndarray:
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
    if head is None:
        raise ImageError("PNG without a header")
    width, height, depth, colour, _, _, interlaced = head
    _sides(width, height)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or interlaced > 1:
        raise ImageError("unknown PNG colour type or interlace method")
    raw = zlib.decompress(b"".join(body))
    if interlaced:
        # First column and row, and steps, of the seven passes.
        passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
        out, at = None, 0
        for x0, y0, dx, dy in passes:
            w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
            if w > 0 and h > 0:
                part, used = _png_rows(raw[at:], w, h, depth, channels)
                at += used
                if out is None:
                    out = np.zeros((height, width, channels), part.dtype)
                out[y0::dy, x0::dx] = part
    else:
        out, _ = _png_rows(raw, width, height, depth, channels)
    if colour == 3:
        if palette is None:
            raise ImageError("PNG without its palette")
        return palette[out[..., 0]]
    if depth < 8:
        out = (out.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return out


def _png_rows(raw: bytes, width: int, height: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    bits = depth * channels
    stride, step = -(-width * bits // 8), max(1, bits // 8)
    lines = np.frombuffer(raw[: height * (stride + 1)], np.uint8).reshape(height, stride + 1)
    if lines[:, 0].max(initial=0) > 4:
        raise ImageError("unknown PNG row filter")
    if (lines[:, 0] > 2).any():
        rows = _by_diagonals(lines, step)
    else:
        done = np.zeros((height + 1, stride), np.uint8)
        for y in range(height):
            rule, line, up = lines[y, 0], lines[y, 1:], done[y]
            if rule == 0:
                done[y + 1] = line
            elif rule == 2:
                done[y + 1] = line + up
            else:
                for k in range(step):
                    done[y + 1, k::step] = np.cumsum(line[k::step], dtype=np.uint64).astype(np.uint8)
        rows = done[1:]
    if depth == 16:
        samples = rows.reshape(height, -1, 2)
        samples = (samples[..., 0].astype(np.uint16) << 8) | samples[..., 1]
    elif depth == 8:
        samples = rows
    else:
        per = 8 // depth
        shifts = np.arange(per - 1, -1, -1) * depth
        samples = ((rows[..., None] >> shifts) & ((1 << depth) - 1)).reshape(height, -1)[:, : width * channels]
    return samples.reshape(height, width, channels), height * (stride + 1)


def _by_diagonals(lines: np.ndarray, step: int) -> np.ndarray:
    """Undo any row filters. A byte needs those to the left, above and between, so a diagonal is done at once.

    In a flat array with a column and a row of zeros in front, a diagonal is a slice with a fixed step.
    """
    height, stride = lines.shape[0], lines.shape[1] - 1
    n = -(-stride // step)
    raw = np.zeros((height, n * step), np.uint8)
    raw[:, :stride] = lines[:, 1:]
    raw = raw.reshape(height * n, step)
    rule = lines[:, :1].astype(np.int16)
    ahead, out = n + 1, np.zeros(((height + 1) * (n + 1), step), np.int16)
    for d in range(height + n - 1):
        low, high = max(0, d - n + 1), min(height - 1, d)
        at = slice((low + 1) * ahead + d - low + 1, (high + 1) * ahead + d - high + 2, n)
        a, b, c = (out[at.start - k : at.stop - k : n] for k in (1, ahead, ahead + 1))
        own = rule[low : high + 1]
        base = a + b
        near_a, near_b, near_c = np.abs(b - c), np.abs(a - c), np.abs(base - c - c)
        paeth = np.where((near_a <= near_b) & (near_a <= near_c), a, np.where(near_b <= near_c, b, c))
        guess = np.where(own == 4, paeth, np.where(own == 3, base >> 1, np.where(own == 2, b, np.where(own == 1, a, 0))))
        # One column: the diagonal is a single byte, whatever the step.
        source = raw[low * n + d - low : high * n + d - high + 1 : max(1, n - 1)]
        out[at] = (source + guess) & 255
    return out.reshape(height + 1, ahead, step)[1:, 1:].astype(np.uint8).reshape(height, n * step)[:, :stride]


def decode_pnm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(data) and (data[at] in b" \t\r\n" or data[at] == 35):
            at = data.index(b"\n", at) + 1 if data[at] == 35 else at + 1
        end = at
        while end < len(data) and data[end] not in b" \t\r\n#":
            end += 1
        if end == at:
            raise ImageError("PNM header is cut short")
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    _sides(width, height)
    channels = 3 if data[1:2] == b"6" else 1
    kind = np.dtype(">u2") if most > 255 else np.dtype("u1")
    n = width * height * channels
    if len(data) < at + 1 + n * kind.itemsize:
        raise ImageError("PNM data is cut short")
    out = np.frombuffer(data, kind, n, at + 1).reshape(height, width, channels)
    return out.astype(np.uint16) if most > 255 else out


def _fives(words: np.ndarray) -> np.ndarray:
    """Colours of 16-bit words with five bits each for red, green and blue, as 8 bits."""
    parts = np.stack([words >> 10, words >> 5, words], -1) & 31
    return (parts.astype(np.uint16) * 255 // 31).astype(np.uint8)


def _masked(words: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask in each word, stretched to 8 bits."""
    if not mask:
        return np.zeros(words.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return (((words.astype(np.int64) & mask) >> low) * 255 // most).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    start, size, width, height, _, bits, packed = struct.unpack("<10xIIiiHHI", data[:34])
    tall = abs(height)
    _sides(width, tall)
    if packed not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or (packed == 3 and bits < 16):
        raise ImageError("compressed or unusual BMP")
    stride = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * tall, start).reshape(tall, stride)
    rows = rows[::-1] if height > 0 else rows
    if bits <= 8:
        colours = np.frombuffer(data, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)
        shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
        places = ((rows[..., None] >> shifts) & ((1 << bits) - 1)).reshape(tall, -1)[:, :width]
        return colours[places][..., 2::-1]
    if bits == 16 or packed == 3:
        words = np.ascontiguousarray(rows[:, : width * bits // 8]).view(f"<u{bits // 8}")
        if packed == 0:
            return _fives(words)
        # The masks follow the short header, or lie in a longer one at the same place.
        masks = struct.unpack("<III", data[54:66])
        return np.stack([_masked(words, m) for m in masks], -1)
    return rows[:, : width * bits // 8].reshape(tall, width, -1)[..., 2::-1]


def decode_tga(data: bytes) -> np.ndarray:
    length, has_map, kind, map_from, map_n, map_bits, _, _, width, height, bits, flags = struct.unpack("<BBBHHBHHHHBB", data[:18])
    _sides(width, height)
    at, step = 18 + length, -(-bits // 8)
    colours = None
    if has_map:
        each = -(-map_bits // 8)
        colours = np.frombuffer(data, np.uint8, map_n * each, at).reshape(map_n, each)
        at += map_n * each
    n = width * height
    if kind >= 9:
        out = bytearray()
        while len(out) < n * step:
            head = data[at]
            run = (head & 127) + 1
            if head & 128:
                out += data[at + 1 : at + 1 + step] * run
                at += 1 + step
            else:
                out += data[at + 1 : at + 1 + step * run]
                at += 1 + step * run
        body = bytes(out[: n * step])
    else:
        body = data[at : at + n * step]
    if len(body) < n * step:
        raise ImageError("TGA data is cut short")
    px = np.frombuffer(body, np.uint8).reshape(height, width, step)
    if colours is not None:
        px = colours[px[..., 0].astype(int) - map_from]
    if px.shape[2] == 2 and kind in (1, 2, 9, 10):
        px = _fives(np.ascontiguousarray(px).view("<u2")[..., 0])
    elif px.shape[2] >= 3:
        px = px[..., [2, 1, 0]]
    return px if flags & 32 else px[::-1]


def decode_psd(data: bytes) -> np.ndarray:
    """The composited view of 8 or 16 bit grey and RGB files, plain or run-length packed."""
    _, version, channels, height, width, depth, mode = struct.unpack(">4sH6xHIIHH", data[:26])
    _sides(width, height)
    if version != 1 or depth not in (8, 16) or mode not in (1, 3):
        raise ImageError("unsupported PSD")
    at = 26
    for _ in range(3):
        at += 4 + struct.unpack(">I", data[at : at + 4])[0]
    (packed,) = struct.unpack(">H", data[at : at + 2])
    at += 2
    use, step = (3 if mode == 3 else 1), depth // 8
    if packed == 1:
        lines = struct.unpack(f">{height * channels}H", data[at : at + 2 * height * channels])
        at += 2 * height * channels
        planes = b""
        for size in lines[: height * use]:
            planes += _unpacked(data[at : at + size])
            at += size
    else:
        planes = data[at : at + width * height * step * use]
    out = np.frombuffer(planes, ">u2" if depth == 16 else "u1", width * height * use).reshape(use, height, width)
    return np.moveaxis(out, 0, -1).astype(np.uint16 if depth == 16 else np.uint8)


def _unpacked(line: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(line):
        head = line[at]
        if head < 128:
            out += line[at + 1 : at + 2 + head]
            at += 2 + head
        else:
            out += b"" if head == 128 else line[at + 1 : at + 2] * (257 - head)
            at += 1 if head == 128 else 2
    return bytes(out)


def decode_pic(data: bytes) -> np.ndarray:
    """Softimage PIC: packets of channels, each line of a packet raw or run-length packed."""
    if data[88:92] != b"PICT":
        raise ImageError("PIC without its header")
    width, height = struct.unpack(">HH", data[92:96])
    _sides(width, height)
    at, packets, more = 104, [], 1
    while more:
        more, bits, packing, mask = struct.unpack("4B", data[at : at + 4])
        at += 4
        if bits != 8 or packing > 2:
            raise ImageError("unsupported PIC packet")
        packets.append((packing, [i for i in range(4) if mask & (128 >> i)]))
    out = np.zeros((height, width, 4), np.uint8)
    for y in range(height):
        for packing, channels in packets:
            n, x = len(channels), 0
            while x < width:
                if packing == 0:
                    run, same = width, False
                elif packing == 1:
                    run, same = data[at], True
                    at += 1
                else:
                    head = data[at]
                    at += 1
                    same = head >= 128
                    run = head - 127 if head > 128 else head + 1
                    if head == 128:
                        (run,) = struct.unpack(">H", data[at : at + 2])
                        at += 2
                run = min(run, width - x)
                if run < 1 or at + n * (1 if same else run) > len(data):
                    raise ImageError("PIC data is cut short")
                part = np.frombuffer(data, np.uint8, n * (1 if same else run), at).reshape(-1, n)
                out[y, x : x + run, channels] = part.T if not same else part.T.repeat(run, 1)
                at += part.size
                x += run
    return out[..., :3]


DECODERS = {"png": decode_png, "pnm": decode_pnm, "bmp": decode_bmp, "tga": decode_tga, "psd": decode_psd, "pic": decode_pic}


def grey(data: bytes) -> np.ndarray:
    """Any supported file as one 8-bit plane: top byte of 16, luma of colours, alpha dropped."""
    kind = kind_of(data)
    if kind not in DECODERS:
        raise ImageError("unknown image type" if kind == "unknown" else f"{kind} files go through Spark's image source")
    try:
        px = DECODERS[kind](data)
    except ImageError:
        raise
    except (struct.error, IndexError, ValueError, TypeError, OverflowError, zlib.error) as error:
        raise ImageError(f"broken {kind} file: {error}") from error
    if px.dtype == np.uint16:
        px = (px >> 8).astype(np.uint8)
    if px.shape[2] < 3:
        return np.ascontiguousarray(px[..., 0])
    r, g, b = (px[..., i].astype(np.uint32) for i in range(3))
    return ((77 * r + 150 * g + 29 * b) >> 8).astype(np.uint8)


def _differences(above: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The five row filters of PNG on rows of one byte a pixel: (filter, row, byte)."""
    up = np.concatenate([above, lines[:-1]])
    left, corner = np.zeros_like(lines), np.zeros_like(lines)
    left[:, 1:], corner[:, 1:] = lines[:, :-1], up[:, :-1]
    a, b, c = (x.astype(np.int16) for x in (left, up, corner))
    near_a, near_b, near_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    paeth = np.where((near_a <= near_b) & (near_a <= near_c), left, np.where(near_b <= near_c, up, corner))
    mean = ((a + b) >> 1).astype(np.uint8)
    return np.stack([lines, lines - left, lines - up, lines - mean, lines - paeth])


def encode_png(plane: np.ndarray, level: int = 8, rows_at_once: int = 256) -> bytes:
    """An 8-bit grey plane as a PNG file; of the five row filters each row takes the one of least sum of absolute differences."""
    height, width = plane.shape
    packer, body = zlib.compressobj(level), []
    above = np.zeros((1, width), np.uint8)
    for y in range(0, height, rows_at_once):
        lines = np.ascontiguousarray(plane[y : y + rows_at_once])
        found = _differences(above, lines)
        rule = np.abs(found.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64).argmin(0)
        out = np.concatenate([rule.astype(np.uint8)[:, None], found[rule, np.arange(len(lines))]], 1)
        body.append(packer.compress(out.tobytes()))
        above = lines[-1:]
    body.append(packer.flush())

    def chunk(kind: bytes, part: bytes) -> bytes:
        return struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))

    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", b"".join(body)) + chunk(b"IEND", b"")
