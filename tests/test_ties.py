"""Rounding errors decide neither headings nor moves nor which point splits a line."""

from __future__ import annotations

import math

import pandas as pd

from wayfarer.operators import raster as ra
from wayfarer.streaming import device as de


def test_an_opposite_heading_changes_nothing():
    for start in range(360):
        rows = pd.DataFrame({"user_id": 1, "event_id": [1, 2], "heading_raw": [float(start), float((start + 180) % 360)]})
        _, out = de._headings((float("nan"),), rows)
        assert out[1][2] == start


def test_moves_at_the_limits_of_the_cones():
    for turn in range(360):
        steps = [float(turn)] * 8 + [turn + 90.0, turn - 90.0, turn + 140.0, turn - 140.0]
        rows = pd.DataFrame({"user_id": 1, "event_id": range(12), "heading": steps, "bearing": 0.0, "total": 25.0})
        _, out = de._reckon((0, 0.0, 0.0, 0.0), rows)
        assert [move for *_, move in out[8:]] == ["forward", "forward", "stay", "stay"]


def test_steps_that_cancel_give_no_offset():
    steps = [0.0, 180.0, 33.0, 213.0, 71.0, 251.0, 120.0, 300.0, 10.0, 175.0]
    rows = pd.DataFrame({"user_id": 1, "event_id": range(10), "heading": steps, "bearing": 0.0, "total": 25.0})
    _, out = de._reckon((0, 0.0, 0.0, 0.0), rows)
    assert [move for *_, move in out[8:]] == ["forward", "back"]


def test_of_equal_offsets_the_first_point_splits(spark):
    """Points on a parallel of the span, the later one farther by a rounding error."""
    rows = []
    for k in range(1, 400):
        ends = [(0.0, 0.0), ((7 * k) / 9973, (3 * k) / 9973)]
        p, q = [((2 + 7 * m - 3 * k) / 9973, (3 * m + 7 * k) / 9973) for m in (1, 2 + k // 3)]
        off = lambda a: abs(ends[1][0] * (0.0 - a[1]) - (0.0 - a[0]) * ends[1][1]) / math.hypot(*ends[1])  # noqa: E731, B023
        if 0 < off(q) - off(p) < 1e-12:
            rows += [(k, i, *a) for i, a in enumerate([ends[0], p, q, ends[1]])]
    assert rows
    got = ra.rdp_simplify(spark.createDataFrame(rows, "path_id long, seq long, x double, y double"), 1e-4).collect()
    first = {r.path_id for r in got if r.seq == 1}
    assert first == {k for k, *_ in rows}
