"""Picture statistics in numpy: planes shaped (n, h, w) or rows shaped (n, m), one number per picture.

Stencils keep the shape. Histograms count below their edges, so a value on an edge
belongs to the bin above it, and the last bin holds its upper edge.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

EPS = 1e-8
FLAT = 1e-16


def rows(a: np.ndarray) -> np.ndarray:
    return a.reshape(len(a), -1)


def mean(a: np.ndarray) -> np.ndarray:
    return rows(a).mean(axis=1)


def total(a: np.ndarray) -> np.ndarray:
    return rows(a).sum(axis=1)


def over(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return top / np.maximum(bottom, EPS)


def std(a: np.ndarray) -> np.ndarray:
    """Population deviation from sums and squares around the first value."""
    away = rows(a) - rows(a)[:, :1]
    return np.sqrt(np.maximum((away * away).mean(axis=1) - away.mean(axis=1) ** 2, 0.0))


def skew(a: np.ndarray) -> np.ndarray:
    """Third standardised moment; 0 for a flat plane."""
    spread, away = std(a), rows(a) - mean(a)[:, None]
    return np.where(spread < EPS, 0.0, (away**3).mean(axis=1) / np.where(spread < EPS, 1.0, spread) ** 3)


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson correlation; 0 when a side is flat."""
    x, y = (rows(p) - rows(p)[:, :1] for p in (a, b))
    mx, my = x.mean(axis=1), y.mean(axis=1)
    vx, vy = (x * x).mean(axis=1) - mx * mx, (y * y).mean(axis=1) - my * my
    flat = (vx < FLAT) | (vy < FLAT)
    return np.where(flat, 0.0, ((x * y).mean(axis=1) - mx * my) / np.sqrt(np.where(flat, 1.0, vx * vy)))


def quantiles(a: np.ndarray, *parts: float) -> list[np.ndarray]:
    """Linear-interpolated quantiles."""
    ordered, out = np.sort(rows(a), axis=1), []
    for p in parts:
        at = p * (ordered.shape[1] - 1)
        low, high = ordered[:, int(np.floor(at))], ordered[:, int(np.ceil(at))]
        out.append(low + (high - low) * (at - np.floor(at)))
    return out


def quantile(a: np.ndarray, p: float) -> np.ndarray:
    return quantiles(a, p)[0]


def _entropy_of(counts: np.ndarray, n: np.ndarray | float) -> np.ndarray:
    share = counts / n
    return -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=1)


def _histogram(values: np.ndarray, bins: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    below = [(values < (low + (high - low) * b / float(bins))[:, None]).sum(axis=1) for b in range(1, bins)]
    n = len(values)
    return np.diff(np.stack([np.zeros(n, int), *below, np.full(n, values.shape[1])], axis=1), axis=1)


def entropy(a: np.ndarray, bins: int) -> np.ndarray:
    """Entropy in bits of the histogram between the smallest and largest value; 0 for a flat plane."""
    values = rows(a)
    low, high = values.min(axis=1), values.max(axis=1)
    return np.where(high - low < EPS, 0.0, _entropy_of(_histogram(values, bins, low, high), values.shape[1]))


def entropy_between(a: np.ndarray, bins: int, low: float, high: float) -> np.ndarray:
    values = rows(a)
    edge = lambda v: np.full(len(values), v)
    return _entropy_of(_histogram(values, bins, edge(low), edge(high)), values.shape[1])


def weighted_entropy(a: np.ndarray, weights: np.ndarray, bins: int, low: float, high: float) -> np.ndarray:
    """Entropy of a weighted histogram over [low, high]."""
    place = np.clip(np.nan_to_num(np.floor((rows(a) - low) / (high - low) * bins)), 0, bins - 1).astype(int)
    place += np.arange(len(place))[:, None] * bins
    mass = np.bincount(place.ravel(), rows(weights).ravel(), len(place) * bins).reshape(-1, bins)
    return _entropy_of(mass, np.maximum(total(weights), EPS)[:, None])


# ---- stencils -----------------------------------------------------------------


def gradient(a: np.ndarray, axis: int) -> np.ndarray:
    """Central differences, one-sided at the edges."""
    return np.gradient(a, axis=axis)


def laplacian(a: np.ndarray, wrap: bool = False) -> np.ndarray:
    """Four neighbours minus four times the centre; edges reflect, or wrap around."""
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)), mode="wrap" if wrap else "reflect")
    across, along = p[:, 1:-1, :-2] + p[:, 1:-1, 2:], p[:, :-2, 1:-1] + p[:, 2:, 1:-1]
    return across + along - 4.0 * a


def blur(a: np.ndarray, radius: int) -> np.ndarray:
    """Mean over 2r+1 pixels of a row, then of a column, edges reflected."""
    h, w = a.shape[1:]
    p = np.pad(a, ((0, 0), (0, 0), (radius, radius)), mode="reflect")
    a = sum(p[:, :, d : d + w] for d in range(2 * radius + 1)) / float(2 * radius + 1)
    p = np.pad(a, ((0, 0), (radius, radius), (0, 0)), mode="reflect")
    return sum(p[:, d : d + h] for d in range(2 * radius + 1)) / float(2 * radius + 1)


def boundary_ratio(a: np.ndarray, axis: int) -> np.ndarray:
    """Mean step across 8-pixel block borders over the mean step elsewhere; 0 for small pictures."""
    step = np.abs(np.diff(a, axis=axis))
    if step.shape[axis] < 9:
        return np.zeros(len(a))
    border = (np.arange(step.shape[axis]) + 1) % 8 == 0
    return over(mean(np.compress(border, step, axis)), mean(np.compress(~border, step, axis)))


def per_tile(a: np.ndarray, size: int, stat: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """stat of every tile of `size`, shaped (n, tiles); cut tiles of at least 4 pixels a side stay."""
    n, h, w = a.shape
    alike: dict[tuple[int, int], list[np.ndarray]] = {}
    for y in range(0, h, size):
        for x in range(0, w, size):
            tile = a[:, y : y + size, x : x + size]
            if min(tile.shape[1:]) >= 4:
                alike.setdefault(tile.shape[1:], []).append(tile)
    return np.concatenate([stat(np.concatenate(tiles)).reshape(len(tiles), n).T for tiles in alike.values()], axis=1)


def phase_means(a: np.ndarray) -> np.ndarray:
    """Mean per position inside the 8x8 block grid, for the positions the picture has."""
    h, w = a.shape[1:]
    return np.stack([a[:, y::8, x::8].mean(axis=(1, 2)) for y in range(min(8, h)) for x in range(min(8, w))], axis=1)


def radius(h: int, w: int) -> np.ndarray:
    """Distance from the middle as a share of the corners'."""
    y, x = np.arange(h)[:, None] - (h - 1) / 2.0, np.arange(w)[None, :] - (w - 1) / 2.0
    return np.sqrt(y * y + x * x) / max(np.hypot((h - 1) / 2.0, (w - 1) / 2.0), EPS)
