"""Gray pictures as arrays: the primitives before recognition, and the band of ink that a stamp makes."""

from __future__ import annotations

import numpy as np


def to_gray(a: np.ndarray) -> np.ndarray:
    """Luma of a picture with three channels in blue, green, red order; a gray one as it is."""
    return a if a.ndim == 2 else np.clip(np.rint(a[..., :3] @ np.array([0.114, 0.587, 0.299])), 0, 255).astype(np.uint8)


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Mean of the square of ``size`` around each point, with the edge repeated."""
    r = size // 2
    p = np.pad(a.astype(np.float64), r, mode="edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * r + 1
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / (n * n)


def unsharp(a: np.ndarray, amount: float = 0.8, size: int = 5) -> np.ndarray:
    return np.clip(np.rint(a + amount * (a - box_mean(a, size))), 0, 255).astype(np.uint8)


def binarize(a: np.ndarray, block: int = 35, c: float = 11) -> np.ndarray:
    """White where a point is above the mean of its block less ``c``."""
    return np.where(a > box_mean(a, block) - c, 255, 0).astype(np.uint8)


def upscale(a: np.ndarray, least_edge: int) -> np.ndarray:
    """Enlarged by a whole factor until the longer edge reaches ``least_edge``."""
    k = max(1, -(-least_edge // max(a.shape[:2])))
    return np.repeat(np.repeat(a, k, axis=0), k, axis=1)


def otsu(a: np.ndarray) -> int:
    """Threshold that parts the gray values with the greatest variance between the two sides."""
    n = np.bincount(a.ravel(), minlength=256).astype(float)
    w, m = n.cumsum(), (n * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.nan_to_num(between, nan=-1.0, posinf=-1.0).argmax())


def ink_band(a: np.ndarray, upper: float = 0.30, lower: float = 0.85, share: float = 0.15, least: int = 80, least_share: float = 0.06, smooth: int = 15) -> tuple[int, int] | None:
    """First and last row of the longest run of rows with much ink in the lower part of a page, or None."""
    h = a.shape[0]
    top, end = int(h * upper), int(h * lower)
    ink = (a[top:end] <= otsu(a)).mean(axis=1) if end > top else np.zeros(0)
    if not len(ink) or ink.max() == 0:
        return None
    k = min(smooth, len(ink))
    rolled = np.convolve(ink, np.ones(k) / k, mode="same")
    on = np.concatenate([[0], (rolled >= rolled.mean() + share * (rolled.max() - rolled.mean())).astype(int), [0]])
    edges = np.flatnonzero(np.diff(on))
    runs = list(zip(edges[::2], edges[1::2]))
    start, stop = max(runs, key=lambda r: r[1] - r[0])
    return (top + int(start), top + int(stop) - 1) if stop - start >= max(least, int(h * least_share)) else None
