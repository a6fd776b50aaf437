"""Image features in numpy: grey values, warps, blob keypoints with oriented gradient histograms.

A backend is a function (grey image, most keypoints) -> (keypoints [n, 4]: x, y, size, angle; descriptors [n, 128]).
Descriptors of different backends do not match each other.
"""

from __future__ import annotations

import numpy as np


def grey(bgr: np.ndarray) -> np.ndarray:
    """Luma of an image with channels in BGR order."""
    return np.rint(bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299).astype(np.uint8)


def central_crop(image: np.ndarray, share: float = 0.8) -> tuple[np.ndarray, int, int]:
    """The middle part of an image, and the offsets to add to its coordinates."""
    h, w = image.shape[:2]
    ch, cw = int(h * share), int(w * share)
    top, left = (h - ch) // 2, (w - cw) // 2
    return image[top : top + ch, left : left + cw], left, top


def warp(image: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The image seen through a homography: bilinear, with borders repeated."""
    rows, columns = np.mgrid[: image.shape[0], : image.shape[1]]
    p = np.linalg.inv(h) @ np.stack([columns.ravel(), rows.ravel(), np.ones(rows.size)])
    x, y = np.clip(p[0] / p[2], 0, image.shape[1] - 1), np.clip(p[1] / p[2], 0, image.shape[0] - 1)
    x0, y0 = np.minimum(x.astype(int), image.shape[1] - 2), np.minimum(y.astype(int), image.shape[0] - 2)
    fx, fy, v = x - x0, y - y0, image.astype(np.float64)
    out = v[y0, x0] * (1 - fx) * (1 - fy) + v[y0, x0 + 1] * fx * (1 - fy) + v[y0 + 1, x0] * (1 - fx) * fy + v[y0 + 1, x0 + 1] * fx * fy
    return np.rint(out).astype(image.dtype).reshape(image.shape)


def _blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    n = max(1, int(3 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    k /= k.sum()
    padded = np.pad(image, n, mode="edge")
    across = sum(w * padded[:, i : i + image.shape[1]] for i, w in enumerate(k))
    return sum(w * across[i : i + image.shape[0]] for i, w in enumerate(k))


SIGMAS = (1.6, 2.26, 3.2, 4.53, 6.4)


def extract(image: np.ndarray, most: int, contrast: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Extrema of differences of blurred images, strongest first, each with a 4 x 4 grid of 8 gradient directions."""
    nothing = np.zeros((0, 4)), np.zeros((0, 128), np.float32)
    if min(image.shape) < 32:
        return nothing
    levels = [_blurred(image.astype(np.float64), s) for s in SIGMAS]
    d = np.stack([b - a for a, b in zip(levels, levels[1:])])  # noqa: B905
    found = []
    for k in range(1, len(d) - 1):
        middle = d[k, 1:-1, 1:-1]
        around = np.stack([d[k + a, 1 + b : d.shape[1] - 1 + b, 1 + c : d.shape[2] - 1 + c] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)])
        y, x = np.nonzero((np.abs(middle) > contrast) & ((middle > around.max(0)) | (middle < around.min(0))))
        found.append(np.stack([x + 1, y + 1, np.full(len(x), k), np.abs(middle[y, x])], 1))
    points = np.concatenate(found)
    points = points[np.lexsort((points[:, 0], points[:, 1], -points[:, 3]))][:most]
    if not len(points):
        return nothing
    x, y, k = points[:, 0], points[:, 1], points[:, 2].astype(int)
    sigma = np.array(SIGMAS)[k]
    gy, gx = (np.stack(g) for g in zip(*(np.gradient(v) for v in levels), strict=True))

    def gradients(angle: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Gradients on a turned 16 x 16 grid around each point, in the point's own frame, weighted by distance."""
        steps = (np.arange(16) - 7.5) / 7.5 * reach
        u, v = (g.ravel() for g in np.meshgrid(steps, steps))
        c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
        px = np.clip(np.rint(x[:, None] + sigma[:, None] * (c * u - s * v)), 0, image.shape[1] - 1).astype(int)
        py = np.clip(np.rint(y[:, None] + sigma[:, None] * (s * u + c * v)), 0, image.shape[0] - 1).astype(int)
        a, b = gx[k[:, None], py, px], gy[k[:, None], py, px]
        weight = np.exp(-(u * u + v * v) / (2 * (reach / 1.5) ** 2))
        return np.hypot(a, b) * weight, (np.arctan2(b, a) - angle[:, None]) % (2 * np.pi)

    size, turn = gradients(np.zeros(len(x)), 3.0)
    bins = (turn / (2 * np.pi) * 36).astype(int) % 36
    histogram = np.zeros((len(x), 36))
    np.add.at(histogram, (np.arange(len(x))[:, None], bins), size)
    histogram = (np.roll(histogram, 1, 1) + histogram + np.roll(histogram, -1, 1)) / 3
    angle = (histogram.argmax(1) + 0.5) / 36 * 2 * np.pi
    size, turn = gradients(angle, 6.0)
    cell = (np.arange(256) // 16 // 4) * 4 + np.arange(256) % 16 // 4
    part = turn / (2 * np.pi) * 8
    low = part.astype(int) % 8
    desc = np.zeros((len(x), 128))
    np.add.at(desc, (np.arange(len(x))[:, None], cell * 8 + low), size * (1 - part % 1))
    np.add.at(desc, (np.arange(len(x))[:, None], cell * 8 + (low + 1) % 8), size * (part % 1))
    for _ in range(2):
        desc /= np.maximum(np.sqrt((desc * desc).sum(1, keepdims=True)), 1e-12)
        desc = np.minimum(desc, 0.2)
    desc /= np.maximum(np.sqrt((desc * desc).sum(1, keepdims=True)), 1e-12)
    return np.stack([x, y, sigma * 2, np.degrees(angle)], 1), (desc * 512).astype(np.float32)


def two_nearest(q: np.ndarray, t: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of query and train rows whose nearest distance is below ratio times the second, ties to the lower index."""
    if len(q) == 0 or len(t) < 2:
        return np.zeros(0, int), np.zeros(0, int)
    d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (t * t).sum(1) - 2 * q @ t.T, 0))
    first = d.argmin(1)
    d1 = d[np.arange(len(q)), first]
    d[np.arange(len(q)), first] = np.inf
    good = d1 < ratio * d.min(1)
    return np.flatnonzero(good), first[good]
