"""Page image kernels in numpy over gray pixels (width, height, pixels): thresholds, skew, ink and quality."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config


def otsu(gray: np.ndarray) -> int:
    """The threshold of greatest between-class variance."""
    h = np.bincount(gray.ravel(), minlength=256).astype(float)
    w = np.cumsum(h)
    m = np.cumsum(h * np.arange(256))
    low, high = w, w[-1] - w
    with np.errstate(all="ignore"):
        between = low * high * (m / low - (m[-1] - m) / high) ** 2
    return int(np.nan_to_num(between, nan=-1.0).argmax())


def turned(mask: np.ndarray, degrees: float) -> np.ndarray:
    """Nearest-neighbour rotation about the middle."""
    h, w = mask.shape
    y, x = np.mgrid[:h, :w]
    a, cy, cx = np.deg2rad(degrees), (h - 1) / 2, (w - 1) / 2
    sy = np.rint((y - cy) * np.cos(a) + (x - cx) * np.sin(a) + cy).astype(int)
    sx = np.rint((x - cx) * np.cos(a) - (y - cy) * np.sin(a) + cx).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    return np.where(inside, mask[sy.clip(0, h - 1), sx.clip(0, w - 1)], 0)


#: Pixels up to which the places of all angles are kept for a shape, and shapes.
PLACES, SHAPES = 1 << 14, 8


@lru_cache(maxsize=SHAPES)
def _places(h: int, w: int, angles: tuple[float, ...]) -> np.ndarray:
    """For each angle, where turned() takes each pixel from; -1 where that lies outside."""
    whole = np.arange(1, h * w + 1).reshape(h, w)
    return np.stack([turned(whole, a).ravel() for a in angles]) - 1


def _unevenness(mask: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """The variance of the row sums of the mask at each angle."""
    h, w = mask.shape
    if h * w > PLACES:
        return np.array([turned(mask, a).sum(1).var() for a in angles])
    at = _places(h, w, tuple(angles.tolist()))  # -1, outside, is the zero at the end
    return np.append(mask.ravel(), np.uint8(0))[at].reshape(len(angles), h, w).sum(2).var(1)


def skew(gray: np.ndarray) -> float:
    """The angle of -10 to 10 degrees, by 0.2, with the most uneven row sums; 0 with under 50 ink pixels."""
    ink = (gray <= otsu(gray)).astype(np.uint8)
    if ink.sum() < 50:
        return 0.0
    half = ink[::2, ::2]
    angles = np.round(np.arange(-10, 10.01, 0.2), 1)
    return float(angles[int(np.argmax(_unevenness(half, angles)))])


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the four neighbours at offset t (0 to 1) by cubic convolution, a = -0.75."""
    a, near, far = -0.75, np.stack([t, 1 - t]), np.stack([1 + t, 2 - t])
    inner = ((a + 2) * near - (a + 3)) * near * near + 1
    outer = ((a * far - 5 * a) * far + 8 * a) * far - 4 * a
    return np.stack([outer[0], inner[0], inner[1], outer[1]])


def rotated(gray: np.ndarray, degrees: float) -> np.ndarray:
    """Cubic rotation about the middle; beyond the border its pixels repeat."""
    h, w = gray.shape
    y, x = np.mgrid[:h, :w]
    a, cy, cx = np.deg2rad(degrees), h // 2, w // 2
    sy, sx = (y - cy) * np.cos(a) + (x - cx) * np.sin(a) + cy, (x - cx) * np.cos(a) - (y - cy) * np.sin(a) + cx
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    wy, wx = _cubic(sy - y0), _cubic(sx - x0)
    out = np.zeros(gray.shape)
    for i in range(4):
        for j in range(4):
            out += wy[i] * wx[j] * gray[(y0 + i - 1).clip(0, h - 1), (x0 + j - 1).clip(0, w - 1)]
    return np.rint(out).clip(0, 255).astype(np.uint8)


def deskewed(gray: np.ndarray) -> np.ndarray:
    a = skew(gray)
    return rotated(gray, a) if abs(a) > 0.5 else gray


def noisy(gray: np.ndarray) -> bool:
    return bool(edges(gray).var() > 500)


def _boxes(x: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Sums of each n neighbours along an axis, by sums of powers of two."""
    part = lambda y, s, m: y[s : s + m] if axis == 0 else y[:, s : s + m]
    size, at, out, step = x.shape[axis] - n + 1, 0, None, 1
    while True:
        if n & step:
            own = part(x, at, size)
            out, at = own if out is None else out + own, at + step
        if 2 * step > n:
            return out
        m = x.shape[axis] - step
        x, step = part(x, 0, m) + part(x, step, m), 2 * step


def denoised(gray: np.ndarray, h: float = 7, template: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: each pixel is the mean of those around it, weighted by the likeness of their neighbourhoods.

    Squares and their sums are whole numbers, so they are exact in any order.
    """
    r, t = search // 2, template // 2
    x = np.pad(gray.astype(np.int32 if template <= 181 else np.int64), r + t, mode="reflect")
    values = x.astype(np.float64)
    rows, cols = gray.shape
    own, total, weight = x[r : r + rows + 2 * t, r : r + cols + 2 * t], np.zeros(gray.shape), np.zeros(gray.shape)
    for dy in range(2 * r + 1):
        for dx in range(2 * r + 1):
            d = own - x[dy : dy + rows + 2 * t, dx : dx + cols + 2 * t]
            d *= d
            k = _boxes(_boxes(d, template, 0), template, 1) / template**2
            k /= -(h**2)
            np.exp(k, out=k)
            weight += k
            k *= values[dy + t : dy + t + rows, dx + t : dx + t + cols]
            total += k
    return np.rint(total / weight).clip(0, 255).astype(np.uint8)


def png(gray: np.ndarray) -> bytes:
    """The bytes of an eight-bit gray PNG."""
    h, w = gray.shape
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    raw = np.pad(gray, ((0, 0), (1, 0))).tobytes()  # each row begins with its filter, none
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def edges(gray: np.ndarray) -> np.ndarray:
    g = np.pad(gray.astype(float), 1, mode="reflect")
    return g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]


def binarized(gray: np.ndarray, block: int = 35, less: float = 15) -> np.ndarray:
    """Otsu for flat pages, else an adaptive Gaussian threshold."""
    if gray.std() < 20:
        return np.where(gray > otsu(gray), 255, 0).astype(np.uint8)
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(block) - block // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    g = np.pad(gray.astype(float), block // 2, mode="edge")
    g = np.apply_along_axis(np.convolve, 0, g, k, mode="valid")
    g = np.apply_along_axis(np.convolve, 1, g, k, mode="valid")
    return np.where(gray > g - less, 255, 0).astype(np.uint8)


def ink(pages: DataFrame) -> DataFrame:
    """pages with ink_ratio, the share of zero pixels, without Python: how often their hexadecimal pairs are 00."""
    spaced = F.regexp_replace(F.hex("pixels"), "(..)", "$1 ")
    return pages.withColumn("ink_ratio", F.regexp_count(spaced, F.lit("00 ")) / (F.col("width") * F.col("height")))


def not_blank(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return pages.filter(F.col("ink_ratio") >= config.blank_ink)


def enhanced(pages: DataFrame, enabled: bool = False, enhancer=None) -> DataFrame:
    """pages as they are, unless an enhancer (DataFrame -> DataFrame) is switched on."""
    if enabled and enhancer is None:
        raise ValueError("no enhancer to switch on")
    return enhancer(pages) if enabled else pages


def cleaned(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """pages deskewed, denoised where noisy, and binarised, with ink_ratio and png; blank ones are dropped.

    Within a batch, pages of the same pixels are cleaned once.
    """

    def clean(p, h, w):
        g = deskewed(np.frombuffer(p, np.uint8).reshape(h, w))
        x = binarized(denoised(g) if noisy(g) else g)
        return x.tobytes(), float((x == 0).mean()), png(x)

    def run(batches):
        for b in batches:
            known, done = {}, []
            for page in zip(map(bytes, b["pixels"]), b["height"].tolist(), b["width"].tolist()):
                if page not in known:
                    known[page] = clean(*page)
                done.append(known[page])
            b = b.assign(**{c: [x[k] for x in done] for k, c in enumerate(("pixels", "ink_ratio", "png"))})
            yield b[b["ink_ratio"] >= config.blank_ink]

    return pages.mapInPandas(run, T.StructType([*pages.schema.fields, T.StructField("ink_ratio", T.DoubleType()), T.StructField("png", T.BinaryType())]))


def quality(pages: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            grays = [np.frombuffer(p, np.uint8).reshape(h, w) for p, h, w in zip(b["pixels"], b["height"], b["width"])]
            yield pd.DataFrame({"page_id": b["page_id"], "brightness": [g.mean() for g in grays], "contrast": [g.std() for g in grays], "edge_variance": [edges(g).var() for g in grays], "noisy": [noisy(g) for g in grays], "threshold": [otsu(g) for g in grays]})

    return pages.mapInPandas(run, "page_id long, brightness double, contrast double, edge_variance double, noisy boolean, threshold int")
