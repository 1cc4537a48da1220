import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import rings

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]


def size(found):
    return sum(abs(rings.area(r)) for r in found)


def triangles(found):
    return sum(abs(rings.area(list(t))) for t in found)


def test_tessellate():
    hole = [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)]
    ell = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]
    assert triangles(rings.tessellate([SQUARE])) == pytest.approx(1)
    assert triangles(rings.tessellate([SQUARE, hole])) == pytest.approx(0.75)
    assert triangles(rings.tessellate([ell])) == pytest.approx(3)
    assert rings.tessellate([[(0, 0), (1, 1)]]) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(0.2, 2), st.floats(0, 1)), min_size=3, max_size=20))
def test_star_areas_are_kept(spokes):
    turns = np.cumsum([0.05 + t for _, t in spokes])
    ring = [(r * math.cos(2 * math.pi * t / turns[-1]), r * math.sin(2 * math.pi * t / turns[-1])) for (r, _), t in zip(spokes, turns)]
    if max(np.diff(np.append(turns, turns[0] + turns[-1]))) < turns[-1] / 2:
        assert triangles(rings.tessellate([ring])) == pytest.approx(abs(rings.area(ring)), rel=1e-6, abs=1e-9)


def test_overlap():
    x = np.array([0, 1, 1, 0, 0.0])
    y = np.array([0, 0, 1, 1, 0.0])
    assert rings.overlap_end(x, y, 1e-6) == 4
    assert rings.overlap_end(x[:4], y[:4], 1e-6) == 4
