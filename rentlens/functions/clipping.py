"""Clipping one small convex polygon by the bisectors to other sites (runs inside tasks)."""

from __future__ import annotations

import numpy as np

# Vertices closer than this share of the polygon's reach are one vertex.
SAME_VERTEX = 1e-12

Ring = list[tuple[float, float]]


def _reach(ring: Ring, x: float, y: float) -> float:
    return max((vx - x) * (vx - x) + (vy - y) * (vy - y) for vx, vy in ring)


def _cut(ring: Ring, mx: float, my: float, dx: float, dy: float) -> Ring:
    """The part of a convex ring on the near side of the line through m, normal d."""
    sides = [(vx - mx) * dx + (vy - my) * dy for vx, vy in ring]
    if max(sides) <= 0.0:
        return ring
    kept = []
    (px, py), side = ring[-1], sides[-1]
    for (qx, qy), next_side in zip(ring, sides):
        if (side <= 0.0) != (next_side <= 0.0):
            share = side / (side - next_side)
            kept.append((px + share * (qx - px), py + share * (qy - py)))
        if next_side <= 0.0:
            kept.append((qx, qy))
        px, py, side = qx, qy, next_side
    return kept


def nearest_part(ring: Ring, x: float, y: float, ox: np.ndarray, oy: np.ndarray) -> Ring:
    """The part of ``ring`` nearer to (x, y) than to any of the points (ox, oy).

    They are taken nearest first; one at twice the distance of the farthest vertex cannot
    cut any more, and neither can those after it. A point at (x, y) itself cuts nothing.
    """
    far = (ox - x) ** 2 + (oy - y) ** 2
    reach = _reach(ring, x, y)
    for i in np.argsort(far):
        distance = far[i]
        if distance >= 4.0 * reach:
            break
        if distance == 0.0:
            continue
        dx, dy = float(ox[i]) - x, float(oy[i]) - y
        cut = _cut(ring, x + dx / 2, y + dy / 2, dx, dy)
        if cut is ring:
            continue
        limit = SAME_VERTEX * SAME_VERTEX * reach
        thin = [
            v for k, v in enumerate(cut)
            if (v[0] - cut[k - 1][0]) ** 2 + (v[1] - cut[k - 1][1]) ** 2 > limit
        ]
        if len(thin) >= 3:
            ring, reach = thin, _reach(thin, x, y)
    return ring
