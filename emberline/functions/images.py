"""Pixel functions over decoded images (height, width, 3; BGR bytes), in numpy.

They match their definitions, not any library's rounding of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def array_of(image) -> np.ndarray:
    """The pixels of a row of Spark's image source."""
    return np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])


def grey(image: np.ndarray) -> np.ndarray:
    """Weighted grey levels, rounded; a two-dimensional image is grey already."""
    if image.ndim == 2:
        return image
    if image.shape[2] == 1:
        return image[:, :, 0]
    return np.clip(np.rint(image[:, :, :3].astype(float) @ np.array([0.114, 0.587, 0.299])), 0, 255).astype(np.uint8)


def mean_luma(image: np.ndarray) -> float:
    return float(grey(image).mean())


def blur_variance(image: np.ndarray) -> float:
    """The population variance of the four-neighbour Laplacian, borders reflected."""
    g = np.pad(grey(image).astype(float), 1, mode="reflect") if min(image.shape[:2]) > 1 else np.pad(grey(image).astype(float), 1, mode="edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def area_resized(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the source areas of each target pixel."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        low, high = edges[:-1, None], edges[1:, None]
        k = np.arange(n)[None, :]
        w = np.clip(np.minimum(high, k + 1) - np.maximum(low, k), 0, None)
        return w / w.sum(axis=1, keepdims=True)

    return weights(g.shape[0], height) @ g.astype(float) @ weights(g.shape[1], width).T


def dhash(image: np.ndarray, size: int = 8) -> int:
    """A 64-bit difference hash: whether each of 9 x 8 grey cells is darker than its right neighbour, first bit highest; signed."""
    g = np.rint(area_resized(grey(image), size, size + 1))
    bits = (g[:, 1:] > g[:, :-1]).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear interpolation at pixel centres."""

    def taps(n: int, m: int):
        x = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(x).astype(int)
        return low, np.minimum(low + 1, n - 1), x - low

    a, b, wy = taps(image.shape[0], height)
    c, d, wx = taps(image.shape[1], width)
    x = image.astype(float)
    wy, wx = wy[:, None, None], wx[None, :, None]
    out = (x[a][:, c] * (1 - wx) + x[a][:, d] * wx) * (1 - wy) + (x[b][:, c] * (1 - wx) + x[b][:, d] * wx) * wy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def centre_crop(image: np.ndarray, size: int) -> np.ndarray:
    """The shorter side scaled to size, then the middle square."""
    h, w = image.shape[:2]
    scale = size / min(h, w)
    nh, nw = max(size, round(h * scale)), max(size, round(w * scale))
    out = bilinear(image, nh, nw)
    top, left = (nh - size) // 2, (nw - size) // 2
    return out[top : top + size, left : left + size]


def letterbox(image: np.ndarray, side: int, colour: int = 114) -> tuple[np.ndarray, float, tuple[float, float]]:
    """The image scaled into a square on a grey ground, with the scale and the (x, y) padding."""
    h, w = image.shape[:2]
    scale = min(side / h, side / w)
    nh, nw = round(h * scale), round(w * scale)
    dx, dy = (side - nw) / 2, (side - nh) / 2
    left, top = round(dx - 0.1), round(dy - 0.1)
    out = np.full((side, side, 3), colour, np.uint8)
    out[top : top + nh, left : left + nw] = bilinear(image, nh, nw)
    return out, scale, (dx, dy)


def planes(image: np.ndarray) -> np.ndarray:
    """BGR bytes as RGB planes of 0..1, with a batch axis."""
    return np.ascontiguousarray(image[:, :, ::-1].transpose(2, 0, 1)[None], np.float32) / 255


def model_input(image: np.ndarray, size: int, boxed: bool = False) -> np.ndarray:
    return planes(letterbox(image, size)[0] if boxed else centre_crop(image, size))


def npu_input(image: np.ndarray, size: int) -> np.ndarray:
    """RGB bytes with a batch axis, not scaled."""
    return np.ascontiguousarray(centre_crop(image, size)[:, :, ::-1][None])


def augmented(images: np.ndarray, seed: int, crop: int) -> np.ndarray:
    """A batch with one shared random crop, and a flip, brightness and contrast for each image; a function of the seed alone."""
    rng = np.random.default_rng(seed)
    n, h, w, _ = images.shape
    top, left = (int(rng.integers(0, x - crop + 1)) for x in (h, w))
    out = images[:, top : top + crop, left : left + crop].astype(float)
    flip = rng.random(n) < 0.5
    out[flip] = out[flip, :, ::-1]
    gain, shift = rng.uniform(0.8, 1.2, (n, 1, 1, 1)), rng.uniform(-20, 20, (n, 1, 1, 1))
    mean = out.mean(axis=(1, 2, 3), keepdims=True)
    return np.clip(np.rint((out - mean) * gain + mean + shift), 0, 255).astype(np.uint8)


MEASURES = T.StructType([T.StructField("luma", T.DoubleType()), T.StructField("blur", T.DoubleType()), T.StructField("phash", T.LongType())])


@F.pandas_udf(MEASURES)
def measures(image: pd.DataFrame) -> pd.DataFrame:
    """Luma, blur and difference hash of each image, decoded once."""
    found = [array_of(r) for r in image.to_dict("records")]
    return pd.DataFrame({"luma": [mean_luma(x) for x in found], "blur": [blur_variance(x) for x in found], "phash": pd.array([dhash(x) for x in found], dtype="Int64")})
