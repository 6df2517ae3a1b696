"""Door signatures on drawn paths: real doors at every turn, and near misses of each rule."""

import math
import random

from wayfarer.operators import spatial

KAPPA = 0.5523


def arc(cx, cy, r, turn):
    """The four points of a quarter arc around a centre, turned by quarters."""
    c, s = round(math.cos(turn * math.pi / 2)), round(math.sin(turn * math.pi / 2))
    place = lambda x, y: (cx + x * c - y * s, cy + x * s + y * c)
    return [place(r, 0), place(r, KAPPA * r), place(KAPPA * r, r), place(0, r)]


def test_doors_are_told_from_near_misses(spark):
    r, items, walls, want, path = random.Random(11), [], [], {}, 0

    def draw(kind, *points):
        items.append((path, "f", kind, [{"x": float(x), "y": float(y)} for x, y in points]))

    for k in range(60):
        path, cx, cy, size = k, 1000.0 * (k % 8) + r.random(), 1000.0 * (k // 8) + r.random(), r.uniform(5, 60)
        turned = arc(cx, cy, size, k % 4)
        leaf, wall, arcs, case = turned[0 if k % 2 else 3], 3.0, 1, k % 6
        if case == 1:
            size = r.choice([2.0, 90.0])  # too small or too wide
            turned = arc(cx, cy, size, k % 4)
            leaf = turned[0]
        elif case == 2:
            arcs = 2
        elif case == 3:
            leaf = (cx + 2 * (leaf[0] - cx), cy + 2 * (leaf[1] - cy))  # twice as long
        elif case == 4:
            wall = 9.0  # no wall within five points of the centre
        elif case == 5:
            leaf = (cx + 0.7 * size * (1 if k % 4 in (0, 3) else -1), cy + 0.7 * size * (1 if k % 4 < 2 else -1))  # ends on the arc's middle
        for _ in range(arcs):
            draw("curve", *turned)
        draw("line", (cx, cy), leaf) if k % 3 else draw("line", leaf, (cx, cy))
        walls.append((k, "f", cx - 200.0, cy + wall, cx + 200.0, cy + wall))
        if case == 0:
            want[k] = (round(cx, 3), round(cy, 3), round(size, 3))
    df = spark.createDataFrame(items, "path_id long, floor_id string, kind string, points array<struct<x: double, y: double>>")
    segments = spark.createDataFrame(walls, "seg_id long, floor_id string, x0 double, y0 double, x1 double, y1 double")
    got = {x.path_id: (round(x.cx, 3), round(x.cy, 3), round(x.r, 3)) for x in spatial.door_signature(df, segments).collect()}
    assert got == want and len(want) == 10
