"""Pictures at another size: bilinear, area and nearest samples, and affine maps; shared by masks, tensors, thumbnails, crops and the frame sink.

A pixel stands for its middle, so position x of n samples is (x + 0.5) * size / n - 0.5 in the picture;
what lies outside takes the nearest edge.
"""

from __future__ import annotations

import numpy as np


def _between(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For n samples of an axis: the pixels before and after, and the share of the latter."""
    at = np.clip((np.arange(n) + 0.5) * (size / n) - 0.5, 0, size - 1)
    low = np.floor(at).astype(np.int64)
    return low, np.minimum(low + 1, size - 1), at - low


def bilinear(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    """Of one picture, or of a stack of them."""
    y0, y1, fy = _between(height, picture.shape[-3])
    x0, x1, fx = _between(width, picture.shape[-2])
    fx, fy = fx[None, :, None], fy[:, None, None]
    p = picture.astype(np.float64)
    left, right = p[..., x0, :], p[..., x1, :]
    above = left[..., y0, :, :] * (1 - fx) + right[..., y0, :, :] * fx
    below = left[..., y1, :, :] * (1 - fx) + right[..., y1, :, :] * fx
    return np.rint(above * (1 - fy) + below * fy).astype(picture.dtype)


def nearest(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each sample takes the pixel that its left upper corner lies in; of one picture, or of a stack of them."""
    h, w = picture.shape[-3:-1]
    return picture[..., np.minimum(np.arange(height) * h // height, h - 1), :, :][..., np.minimum(np.arange(width) * w // width, w - 1), :]


def _shares(n: int, size: int) -> np.ndarray:
    """n x size: the share of each pixel in each sample's stretch of the axis."""
    edge = np.arange(n + 1) * (size / n)
    low, high = edge[:-1, None], edge[1:, None]
    pixel = np.arange(size)[None, :]
    held = np.clip(np.minimum(high, pixel + 1) - np.maximum(low, pixel), 0, None)
    return held / held.sum(axis=1, keepdims=True)


def area(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    """The mean of the pixels that a sample covers, by share; enlarging is bilinear."""
    if width > picture.shape[1] or height > picture.shape[0]:
        return bilinear(picture, width, height)
    rows = np.tensordot(_shares(height, picture.shape[0]), picture.astype(np.float64), axes=(1, 0))
    return np.rint(np.einsum("wx,hxc->hwc", _shares(width, picture.shape[1]), rows)).astype(picture.dtype)


def warped(picture: np.ndarray, m: tuple[float, float, float, float, float, float], width: int, height: int) -> np.ndarray:
    """The picture under x' = a x + b y + c, y' = d x + e y + f, width x height from the origin; black where nothing lands. A map without inverse gives black."""
    a, b, c, d, e, f = m
    det = a * e - b * d
    if not np.isfinite(det) or abs(det) < 1e-12:
        return np.zeros((height, width, picture.shape[2]), picture.dtype)
    x, y = np.meshgrid(np.arange(width) - c, np.arange(height) - f)
    u, v = (e * x - b * y) / det, (a * y - d * x) / det
    h, w = picture.shape[:2]
    u0, v0 = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
    out = np.zeros((height, width, picture.shape[2]))
    for dv in (0, 1):
        for du in (0, 1):
            uu, vv = u0 + du, v0 + dv
            inside = (uu >= 0) & (uu < w) & (vv >= 0) & (vv < h)
            share = (1 - np.abs(u - uu)) * (1 - np.abs(v - vv))
            out += np.where(inside, share, 0)[..., None] * picture[np.clip(vv, 0, h - 1), np.clip(uu, 0, w - 1)]
    return np.rint(out).astype(picture.dtype)
