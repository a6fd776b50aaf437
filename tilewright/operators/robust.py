"""Robust fitting of plane transforms: seeded RANSAC in numpy, all samples of a fit at once, for grouped functions."""

from __future__ import annotations

import numpy as np

ROUNDS = 500
#: Samples are judged in blocks of about so many errors.
BLOCK = 1 << 14


def _normalised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points around the origin at a mean distance of sqrt(2), and the matrix that brings them there."""
    mean = p.mean(0)
    s = np.sqrt(2) / max(np.sqrt(((p - mean) ** 2).sum(1)).mean(), 1e-12)
    return (p - mean) * s, np.array([[s, 0, -s * mean[0]], [0, s, -s * mean[1]], [0, 0, 1]])


def fit_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Least squares over four pairs or more (normalised direct linear transform); None if they do not fix one."""
    if len(src) < 4:
        return None
    a, ta = _normalised(src)
    b, tb = _normalised(dst)
    zero, one = np.zeros(len(a)), np.ones(len(a))
    rows = np.concatenate([
        np.stack([a[:, 0], a[:, 1], one, zero, zero, zero, -b[:, 0] * a[:, 0], -b[:, 0] * a[:, 1], -b[:, 0]], 1),
        np.stack([zero, zero, zero, a[:, 0], a[:, 1], one, -b[:, 1] * a[:, 0], -b[:, 1] * a[:, 1], -b[:, 1]], 1),
    ])
    _, size, v = np.linalg.svd(rows, full_matrices=len(rows) < 9)  # the ninth vector; else no square of the pairs
    if len(size) < 8 or size[7] < 1e-9 * size[0]:
        return None
    h = np.linalg.inv(tb) @ v[-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def fit_similarity(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Rotation, scale and shift by least squares over two pairs or more, as a 2x3 matrix."""
    if len(src) < 2:
        return None
    a, b = src @ np.array([1, 1j]), dst @ np.array([1, 1j])
    da = a - a.mean()
    size = (abs(da) ** 2).sum()
    if size < 1e-12:
        return None
    k = (np.conj(da) * (b - b.mean())).sum() / size
    t = b.mean() - k * a.mean()
    return np.array([[k.real, -k.imag, t.real], [k.imag, k.real, t.imag]])


def errors(m: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Distances in pixels of projected src points from dst."""
    p = np.concatenate([src, np.ones((len(src), 1))], 1) @ m.T
    if m.shape[0] == 3:
        w = np.where(np.abs(p[:, 2]) < 1e-12, np.nan, p[:, 2])
        p = p[:, :2] / w[:, None]
    return np.nan_to_num(np.sqrt(((p - dst) ** 2).sum(1)), nan=np.inf)


def _areas(p: np.ndarray) -> np.ndarray:
    """For samples of four points: twice the signed areas that stand for the first three points' shares in the fourth, and
    of the triangle of those three."""
    x, y = p[:, :, 0].T, p[:, :, 1].T

    def area(i: int, j: int, k: int) -> np.ndarray:
        return (x[j] - x[i]) * (y[k] - y[i]) - (x[k] - x[i]) * (y[j] - y[i])

    return np.stack([area(3, 1, 2), area(0, 3, 2), area(0, 1, 3), area(0, 1, 2)])


def _sampled_homographies(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The homography of each sample of four pairs, of any scale; samples with three points on a line are left out."""
    a, b = _areas(src), _areas(dst)
    wide = [np.ptp(p, axis=1).max(1) ** 2 for p in (src, dst)]
    fine = np.flatnonzero((np.abs(a).min(0) > 1e-9 * wide[0]) & (np.abs(b).min(0) > 1e-9 * wide[1]))
    src, dst, share = src[fine], dst[fine], (b / np.where(a == 0, 1, a))[:3, fine]
    p, q = (np.concatenate([x[:, :3], np.ones((len(fine), 3, 1))], 2) for x in (src, dst))
    lines = np.cross(p[:, [1, 2, 0]], p[:, [2, 0, 1]])  # rows of the adjugate of the first three points
    h = (q * share.T[:, :, None]).transpose(0, 2, 1) @ lines
    return h / np.abs(h).max((1, 2), keepdims=True)


def _sampled_similarities(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The similarity of each sample of two pairs; samples of equal points are left out."""
    a, b = src @ np.array([1, 1j]), dst @ np.array([1, 1j])
    fine = np.flatnonzero(np.abs(a[:, 1] - a[:, 0]) ** 2 >= 2e-12)
    a, b = a[fine], b[fine]
    k = (b[:, 1] - b[:, 0]) / (a[:, 1] - a[:, 0])
    t = b[:, 0] - k * a[:, 0]
    return np.stack([k.real, -k.imag, t.real, k.imag, k.real, t.imag], 1).reshape(-1, 2, 3)


def _samples(rng: np.random.Generator, n: int, sample: int, rounds: int) -> np.ndarray:
    """So many different numbers below n for each round, every set as likely as another (Floyd's)."""
    out = np.empty((rounds, sample), np.int64)
    for k in range(sample):
        last = n - sample + k
        pick = rng.integers(0, last + 1, rounds)
        out[:, k] = np.where((out[:, :k] == pick[:, None]).any(1), last, pick)
    return out


def _within(models: np.ndarray, src: np.ndarray, dst: np.ndarray, limit: float) -> np.ndarray:
    """For each model, which points it brings within the limit."""
    k, size, _ = models.shape
    p = (models.transpose(1, 0, 2).reshape(-1, 3) @ np.concatenate([src.T, np.ones((1, len(src)))])).reshape(size, k, -1)
    w = p[2] if size == 3 else np.ones((1, 1))  # errors are compared times w: no division
    x, y = p[0], p[1]
    x -= dst[:, 0] * w
    y -= dst[:, 1] * w
    x *= x
    y *= y
    x += y
    w *= w
    return (x <= limit**2 * w) & (w > 1e-24)


def ransac(src: np.ndarray, dst: np.ndarray, fit, sampled, sample: int, limit_px: float, seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray | None, np.ndarray]:
    """The transform with most inliers among seeded samples, fitted again on its inliers, and the inlier mask."""
    none = np.zeros(len(src), bool)
    if len(src) < sample:
        return None, none
    (a, _), (b, tb) = _normalised(src), _normalised(dst)
    pick, best = _samples(np.random.default_rng(seed), len(src), sample, rounds), none
    models = sampled(a[pick], b[pick])
    step = max(1, BLOCK // len(src))
    for first in range(0, len(models), step):
        masks = _within(models[first : first + step], a, b, limit_px * tb[0, 0])
        most = masks.sum(1)
        k = most.argmax()
        if most[k] > best.sum():
            best = masks[k]
            if best.all():
                break
    if best.sum() < sample:
        return None, none
    m = fit(src[best], dst[best])
    return (m, errors(m, src, dst) <= limit_px) if m is not None else (None, none)


def homography(src: np.ndarray, dst: np.ndarray, limit_px: float = 5.0, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    return ransac(src, dst, fit_homography, _sampled_homographies, 4, limit_px, seed)


def similarity(src: np.ndarray, dst: np.ndarray, limit_px: float = 4.0, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    return ransac(src, dst, fit_similarity, _sampled_similarities, 2, limit_px, seed) if len(src) >= 4 else (None, np.zeros(len(src), bool))
