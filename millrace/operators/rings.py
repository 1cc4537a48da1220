"""Ring algorithms in plain Python and numpy: what a pandas group function runs on one shape."""

from __future__ import annotations

import numpy as np

Point = tuple[float, float]


def area(ring: list[Point]) -> float:
    """Signed area of a closed ring: positive if counter-clockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def overlap_end(x: np.ndarray, y: np.ndarray, distance: float) -> int:
    """How many vertices a loop keeps when a tail that repeats its head, within ``distance``, is cut off."""
    n = len(x)
    for k in range(n // 2, 0, -1):
        if k < n and np.all(np.abs(x[n - k :] - x[:k]) <= distance) and np.all(np.abs(y[n - k :] - y[:k]) <= distance):
            return n - k
    return n


def _inside(p: Point, a: Point, b: Point, c: Point) -> bool:
    d = [(v[0] - u[0]) * (p[1] - u[1]) - (v[1] - u[1]) * (p[0] - u[0]) for u, v in ((a, b), (b, c), (c, a))]
    return all(v >= 0 for v in d)


def _bridge(outer: list[Point], hole: list[Point]) -> list[Point]:
    """Cuts the hole open to the outer ring along the shortest link that crosses neither."""
    pairs = sorted(((o[0] - h[0]) ** 2 + (o[1] - h[1]) ** 2, i, j) for i, o in enumerate(outer) for j, h in enumerate(hole))
    edges = list(zip(outer, outer[1:] + outer[:1])) + list(zip(hole, hole[1:] + hole[:1]))
    for _, i, j in pairs:
        if not any(_crosses(outer[i], hole[j], a, b) for a, b in edges):
            break
    return outer[: i + 1] + hole[j:] + hole[: j + 1] + outer[i:]


def _side(a: Point, b: Point, p: Point) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _crosses(a: Point, b: Point, c: Point, d: Point) -> bool:
    if {a, b} & {c, d}:
        return False
    return _side(a, b, c) * _side(a, b, d) <= 0 and _side(c, d, a) * _side(c, d, b) <= 0


def contains(ring: list[Point], p: Point) -> bool:
    """Even-odd rule."""
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def _open(ring: list[Point]) -> list[Point]:
    out = [p for k, p in enumerate(ring) if k == 0 or p != ring[k - 1]]
    return out[:-1] if len(out) > 1 and out[0] == out[-1] else out


def tessellate(rings: list[list[Point]]) -> list[tuple[Point, Point, Point]]:
    """Triangles of a shape whose rings alternate between outside and hole (odd rule), by ear clipping."""
    rings = [r for r in map(_open, rings) if len(r) > 2 and area(r)]
    depth = [sum(contains(o, r[0]) for o in rings if o is not r) for r in rings]
    out: list[tuple[Point, Point, Point]] = []
    for r, d in zip(rings, depth):
        if d % 2:
            continue
        ring = r if area(r) > 0 else r[::-1]
        holes = [h for h, e in zip(rings, depth) if e == d + 1 and contains(ring, h[0])]
        for h in sorted(holes, key=lambda h: -max(p[0] for p in h)):
            ring = _bridge(ring, h if area(h) < 0 else h[::-1])
        out += _ears(ring)
    return out


def _ears(ring: list[Point]) -> list[tuple[Point, Point, Point]]:
    ring, out = list(ring), []
    while len(ring) > 3:
        n = len(ring)
        for i in range(n):
            a, b, c = ring[i - 1], ring[i], ring[(i + 1) % n]
            turn = _side(a, b, c)
            if turn < 0:
                continue
            if turn == 0 or not any(_inside(p, a, b, c) for p in ring if p not in (a, b, c)):
                if turn:
                    out.append((a, b, c))
                del ring[i]
                break
        else:  # touching or crossing edges: clip the least bad corner and go on
            i = max(range(n), key=lambda k: _side(ring[k - 1], ring[k], ring[(k + 1) % n]))
            out.append((ring[i - 1], ring[i], ring[(i + 1) % n]))
            del ring[i]
    if len(ring) == 3 and _side(*ring):
        out.append((ring[0], ring[1], ring[2]))
    return out
