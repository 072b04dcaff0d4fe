"""Nearest segments of many points: halves of the points keep only the segments that can be nearest to one of them."""

from __future__ import annotations

import numpy as np

#: Pairs of points and segments that are compared at once.
PAIRS = 1 << 12
BLOCK = 1 << 20


def _along(x: np.ndarray, y: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, share of the way) of points against rows x1, y1, dx, dy of `segments`, all in metres but `x1`, `y1` as offsets."""
    px, py, (dx, dy) = x - segments[0], y - segments[1], segments[2:]
    square = dx * dx + dy * dy
    t = np.clip(np.divide(px * dx + py * dy, square, out=np.zeros(np.broadcast(px, square).shape), where=square > 0), 0.0, 1.0)
    return np.sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2), t


def nearest(points: np.ndarray, segments: np.ndarray, reach: float, exact) -> tuple[np.ndarray, np.ndarray]:
    """(point, segment): each point's nearest segment within `reach`, the first of equal ones.

    `points` (2, n) and `segments` (4, m: x1, y1, dx, dy) are in metres. `exact(points, segments)` gives the distances of
    places against places, which decide. Around the middle of some points with half-diagonal h no segment farther than
    the nearest one's distance + 2 h is nearest to any of them, so the work grows with about n + m * sqrt(n), not n * m.
    """
    n = points.shape[1]
    best = np.full(n, -1)
    stack = [(np.arange(n), np.arange(segments.shape[1]))] if n and segments.shape[1] else []
    while stack:
        own, near = stack.pop()
        low, high = points[:, own].min(axis=1), points[:, own].max(axis=1)
        middle, half = (low + high) / 2, float(np.hypot(*(high - low))) / 2
        d, _ = _along(middle[0], middle[1], segments[:, near])
        near = near[d <= min(float(d.min()) + half, reach) + half + 1e-3]
        if not len(near):
            continue
        if len(own) > 1 and len(own) * len(near) > PAIRS and half > 0:
            axis = int(high[1] - low[1] > high[0] - low[0])
            order = np.argpartition(points[axis, own], len(own) // 2)
            stack += [(own[order[: len(own) // 2]], near), (own[order[len(own) // 2 :]], near)]
            continue
        step = max(BLOCK // len(near), 1)
        for at in range(0, len(own), step):
            part = own[at : at + step]
            d = exact(part, near)
            least = d.argmin(axis=1)
            good = d[np.arange(len(part)), least] <= reach
            best[part[good]] = near[least[good]]
    found = np.flatnonzero(best >= 0)
    return found, best[found]
