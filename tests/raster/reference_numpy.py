"""Filters written down once more in numpy, pixel by pixel rules, single precision where stated."""

import numpy as np


def mirrored(plane, reach):
    return np.pad(plane.astype(np.int64), reach, mode="reflect")


def blur(plane):
    p, k = mirrored(plane, 2), np.outer([1, 4, 6, 4, 1], [1, 4, 6, 4, 1])
    h, w = plane.shape
    total = sum(k[a, b] * p[a : a + h, b : b + w] for a in range(5) for b in range(5))
    return np.floor(total.astype(np.float32) / np.float32(256) + np.float32(0.5)).astype(int)


def sobel(plane):
    p = mirrored(plane, 1)
    h, w = plane.shape
    kx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    gx, gy = (sum(k[a, b] * p[a : a + h, b : b + w] for a in range(3) for b in range(3)) for k in (kx, kx.T))
    m = np.sqrt((gx * gx + gy * gy).astype(np.float32))
    scale = np.float32(255) / m.max() if m.max() > 0 else np.float32(1)
    return np.clip(np.floor(m * scale + np.float32(0.5)), 0, 255).astype(int)


def sharp(plane, amount=1.0):
    s = plane.astype(np.float32)
    value = s + np.float32(amount) * (s - blur(plane).astype(np.float32)) + np.float32(0.5)
    return np.clip(np.floor(value), 0, 255).astype(int)


def bc(plane, brightness=20.0, contrast=1.2):
    value = (plane.astype(np.float32) - np.float32(128)) * np.float32(contrast) + np.float32(128) + np.float32(brightness)
    return np.clip(np.floor(value + np.float32(0.5)), 0, 255).astype(int)


def histeq(plane):
    cdf = np.cumsum(np.bincount(plane.ravel(), minlength=256))
    first = cdf[cdf > 0][0]
    share = (cdf - first).astype(np.float32) / np.float32(max(cdf[-1] - first, 1))
    table = np.where(cdf < first, 0, np.floor(share * np.float32(255) + np.float32(0.5)))
    return table.astype(int)[plane]
