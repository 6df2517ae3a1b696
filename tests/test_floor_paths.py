"""Ways over rasters, joins of the nearest and groupings against plain twins on small floors."""

import heapq
import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from wayfarer.operators import floor_paths as fp
from wayfarer.operators import graph, raster, spatial

STEPS = ((0, -1), (0, 1), (-1, 0), (1, 0))


def floor(seed, w=22, h=17, walls=0.25):
    r = random.Random(seed)
    return {(x, y): int(r.random() > walls) for x in range(w) for y in range(h)}


def cells_of(spark, floors, dist=None):
    rows = [(f, x, y, p, float(dist(x, y)) if dist else 0.0) for f, g in floors.items() for (x, y), p in g.items()]
    return spark.createDataFrame(rows, "floor_id string, x long, y long, passable int, dist double")


def snapped(grid, x, y, cap):
    for r in range(cap):
        ring = [(j, i) for (i, j), p in grid.items() if p and max(abs(i - x), abs(j - y)) == r]
        if ring:
            return min(ring)[::-1]
    return None


def cheapest(grid, start, goal, price):
    cost, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        c, (x, y) = heapq.heappop(heap)
        if (x, y) == goal:
            return c
        for dx, dy in STEPS:
            n = (x + dx, y + dy)
            if grid.get(n) and c + price(*n) < cost.get(n, math.inf):
                cost[n] = c + price(*n)
                heapq.heappush(heap, (cost[n], n))
    return None


def line(a, b):
    (x0, y0), (x1, y1) = a, b
    n = max(abs(x1 - x0), abs(y1 - y0))
    at = lambda p, q, k: p + (1 if q > p else -1) * ((abs(q - p) * 2 * k + n) // (2 * n)) if n else p
    return [(at(x0, x1, k), at(y0, y1, k)) for k in range(n + 1)]


def sees(grid, a, b):
    way = line(a, b)
    slant = [(grid.get((p[0], q[1])), grid.get((q[0], p[1]))) for p, q in zip(way, way[1:]) if p[0] != q[0] and p[1] != q[1]]
    return all(grid.get(p) for p in way) and all(s or t for s, t in slant)


@pytest.mark.parametrize("weighted", [False, True])
def test_grid_paths_cost_what_a_plain_search_finds(spark, weighted):
    floors = {"a": floor(1), "b": floor(2, walls=0.5)}
    dist = lambda x, y: (x * 7 + y * 3) % 5
    r = random.Random(3)
    pairs = [(i, r.choice("ab"), *(r.randrange(-2, 25) for _ in range(4))) for i in range(60)] + [(99, "none", 1, 2, 3, 4)]
    df = spark.createDataFrame(pairs, "pair_id long, floor_id string, x0 long, y0 long, x1 long, y1 long")
    got = {x.pair_id: x for x in fp.grid_shortest_paths(df, cells_of(spark, floors, dist), weighted).collect()}
    assert len(got) == len(pairs)
    price = (lambda x, y: 1 + 8 / (dist(x, y) + 1)) if weighted else (lambda x, y: 1.0)
    for i, f, *ends in pairs:
        path = [(p.x, p.y) for p in got[i].path]
        grid = floors.get(f)
        clamp = lambda x, y: (min(max(x, 0), 21), min(max(y, 0), 16))
        a, b = (snapped(grid, *clamp(*e), 200) if grid else None for e in (ends[:2], ends[2:]))
        want = cheapest(grid, a, b, price) if grid else None
        if want is None:
            assert got[i].cost is None and path == [tuple(ends[:2]), tuple(ends[2:])]
            continue
        assert got[i].cost == pytest.approx(want) and path[0] == a and path[-1] == b
        assert all(grid[p] for p in path) and sum(price(*p) for p in path[1:]) == pytest.approx(want)
        assert all(abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for p, q in zip(path, path[1:]))


def test_routes_follow_cells_and_rides_stay(spark):
    grid = floor(4)
    point = lambda x, y: {"x": x, "y": y}
    rows = [(1, 0, "a", [point(1, 1), point(5, 5), point(20, 15)]), (1, 1, "a", []), (1, 2, "z", [point(0, 0), point(9, 9)]), (2, 0, "a", [point(3, 3)])]
    df = spark.createDataFrame(rows, "route_id long, part int, floor_id string, waypoints array<struct<x: long, y: long>>")
    got = {(x.route_id, x.part): [(p.x, p.y) for p in x.waypoints] for x in fp.route_cell_paths(df, cells_of(spark, {"a": grid})).collect()}
    assert got[1, 1] == [] and got[1, 2] == [(0, 0), (9, 9)] and got[2, 0] == [(3, 3)]
    path = got[1, 0]
    assert path[0] == snapped(grid, 1, 1, 200) and path[-1] == snapped(grid, 20, 15, 200)
    assert all(sees(grid, p, q) or abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for p, q in zip(path, path[1:]))


def stepped(grid, a, b):
    """All cells of the line between two cells, by its error term."""
    (x, y), (x1, y1) = a, b
    dx, dy = abs(x1 - x), -abs(y1 - y)
    error, cells = dx + dy, [(x, y)]
    while (x, y) != (x1, y1):
        e2 = 2 * error
        if e2 > dy:
            error, x = error + dy, x + (1 if x1 > x else -1)
        if e2 < dx:
            error, y = error + dx, y + (1 if y1 > y else -1)
        cells.append((x, y))
    return all(grid.get(c) for c in cells)


def test_route_paths_are_thinned_by_halving(spark):
    grids = {f: floor(s, walls=0.15) for f, s in (("a", 21), ("b", 22), ("c", 23))}
    ends = [((1, 1), (20, 15)), ((20, 2), (2, 14)), ((3, 12), (18, 3)), ((5, 5), (6, 5))]
    pairs = spark.createDataFrame([(10 * i + k, f, *a, *b) for k, f in enumerate(grids) for i, (a, b) in enumerate(ends)], "pair_id long, floor_id string, x0 long, y0 long, x1 long, y1 long")
    read = lambda **how: {x.pair_id: (x.floor_id, x.cost, [(p.x, p.y) for p in x.path]) for x in fp.grid_shortest_paths(pairs, cells_of(spark, grids), **how).collect()}
    thin, differs = read(simplify="halving"), 0
    for pair, (f, cost, path) in read().items():
        if cost is None:
            continue
        want, i = [path[0]], 0
        while i < len(path) - 1:
            lo, hi = i + 1, len(path) - 1
            while lo < hi:
                mid = -(-(lo + hi) // 2)
                if stepped(grids[f], path[i], path[mid]):
                    lo = mid
                else:
                    hi = mid - 1
            want.append(path[lo])
            i = lo
        assert thin[pair][2] == want
        differs += len(want) < len(path)
    assert differs


def test_centred_paths_follow_the_sequential_rule(spark):
    grid = floor(5, walls=0.1)
    dist = {c: min((math.hypot(c[0] - x, c[1] - y) for (x, y), p in grid.items() if not p)) for c in grid}
    starts = [((1, 1), (20, 15)), ((20, 2), (2, 14))]
    pairs = spark.createDataFrame([(i, "a", *a, *b) for i, (a, b) in enumerate(starts)], "pair_id long, floor_id string, x0 long, y0 long, x1 long, y1 long")
    cells = cells_of(spark, {"a": grid}, lambda x, y: dist[x, y])
    paths = fp.grid_shortest_paths(pairs, cells).withColumnRenamed("pair_id", "path_id")
    before = {x.path_id: [(p.x, p.y) for p in x.path] for x in paths.collect()}
    got = {x.path_id: [(p.x, p.y) for p in x.path] for x in fp.centre_paths(paths, cells, 3).collect()}
    for i, path in before.items():
        moved = []
        for x, y in path:
            best = (x, y)
            for dy in range(-3, 4):
                for dx in range(-3, 4):
                    n = (x + dx, y + dy)
                    if grid.get(n) and dist[n] > dist[best]:
                        best = n
            moved.append(best)
        for k in range(len(path)):
            fine = (k == 0 or sees(grid, moved[k - 1], moved[k])) and (k + 1 == len(path) or sees(grid, moved[k], moved[k + 1]))
            if not fine:
                moved[k] = path[k]
        assert got[i] == moved


def test_simplified_points_match_the_greedy_rule(spark):
    grid, r = floor(6, walls=0.12), random.Random(6)
    paths = {i: [(r.randrange(22), r.randrange(17)) for _ in range(12)] for i in range(8)}
    rows = [(i, "a", s, x, y) for i, p in paths.items() for s, (x, y) in enumerate(p)]
    df = spark.createDataFrame(rows, "path_id long, floor_id string, seq long, x long, y long")
    got = {}
    for x in fp.greedy_visibility_simplify(df, cells_of(spark, {"a": grid})).collect():
        got.setdefault(x.path_id, []).append(x.seq)
    for i, p in paths.items():
        kept, k = [0], 0
        while k < len(p) - 1:
            k = next((j for j in range(len(p) - 1, k, -1) if sees(grid, p[k], p[j])), k + 1)
            kept.append(k)
        assert sorted(got[i]) == kept


def test_regions_and_traces(spark):
    grid = floor(7)
    sources = [(1, 2, 3), (2, 18, 12), (3, 10, 8), (4, 2, 3)]
    cells = cells_of(spark, {"a": grid})
    for c in sources:
        grid[c[1], c[2]] = 1
    cells = cells_of(spark, {"a": grid})
    df = spark.createDataFrame([("a", i, x, y) for i, x, y in sources], "floor_id string, source_id long, x long, y long")
    regions = fp.cut(fp.multi_source_regions(cells, df))
    steps, queue = {}, deque()
    for _, x, y in sources:
        if (x, y) not in steps:
            steps[x, y] = 0
            queue.append((x, y))
    while queue:
        x, y = queue.popleft()
        for dx, dy in STEPS:
            n = (x + dx, y + dy)
            if grid.get(n) and n not in steps:
                steps[n] = steps[x, y] + 1
                queue.append(n)
    assert {(x.x, x.y): x.steps for x in regions.collect()} == steps
    edges = fp.cut(raster.region_boundary_edges(regions, cells=cells))
    traced = {(x.a, x.b): [(p.x, p.y) for p in x.path] for x in fp.trace_region_paths(regions, edges).collect()}
    for e in edges.collect():
        path = traced[e.a, e.b]
        assert len(path) == e.steps + 2 and all(abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for p, q in zip(path, path[1:]))
        assert path[0] == next(s[1:] for s in sources if s[0] == e.a) and path[-1] == next(s[1:] for s in sources if s[0] == e.b)


def test_isolated_nodes_and_components(spark):
    r, grid = random.Random(8), floor(8)
    nodes = [(i, "a", r.randrange(22), r.randrange(17)) for i in range(26)]
    edges = [(i, i + 1) for i in range(16) if i % 4 != 3]
    n = spark.createDataFrame(nodes, "node_id long, floor_id string, x long, y long")
    e = spark.createDataFrame(edges, "src long, dst long")
    cells = cells_of(spark, {"a": grid})
    at = {i: snapped(grid, x, y, 50) for i, _, x, y in nodes}
    steps = lambda a, b: cheapest(grid, at[a], at[b], lambda x, y: 1.0)
    want = {}
    for i, _, x, y in nodes:
        if all(i not in pair for pair in edges):
            near = sorted((round(math.hypot(x - u, y - v), 9), j) for j, _, u, v in nodes if j != i)[:5]
            first = next((j for _, j in near if steps(i, j) is not None), None)
            if first is not None:
                want[i] = (first, round((steps(i, first) + 1) / 3, 6))
    assert {x.src: (x.dst, round(x.weight, 6)) for x in fp.connect_isolated(n, e, cells).collect()} == want

    label = {i: i for i, *_ in nodes}
    for a, b in edges:
        old, new = label[b], label[a]
        label = {k: new if v == old else v for k, v in label.items()}
    parts: dict = {}
    for i, *_ in nodes:
        parts.setdefault(label[i], []).append(i)
    groups, merges, xy = list(parts.values()), [], {i: (x, y) for i, _, x, y in nodes}
    while len(groups) > 1:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                for a in groups[i][:20]:
                    for b in groups[j][:20]:
                        d = math.hypot(xy[a][0] - xy[b][0], xy[a][1] - xy[b][1])
                        if best is None or d < best[0]:
                            best = (d, a, b, i, j)
        merges.append(best[1:3])
        joined = groups[best[3]] + groups[best[4]]
        groups = [g for k, g in enumerate(groups) if k not in best[3:]] + [joined]
    components = spark.createDataFrame(list(label.items()), "node_id long, component long")
    assert sorted((x.src, x.dst) for x in fp.closest_merges(n, components).collect()) == sorted(merges)
    bridges = {(x.src, x.dst): round(x.weight, 6) for x in fp.bridge_components(n, e, cells).collect()}
    assert bridges == {p: round((steps(*p) + 1) / 3, 6) for p in merges if steps(*p) is not None}


def plain_merges(points, reps):
    """Merge the closest two of a list of components, earlier ones first on ties, until one is left."""
    parts, out = {}, []
    for node, x, y, c in sorted(points):
        parts.setdefault(c, []).append((node, x, y))
    parts = list(parts.values())
    while len(parts) > 1:
        best = None
        for i, a in enumerate(parts):
            for j in range(i + 1, len(parts)):
                for p in a[:reps]:
                    for q in parts[j][:reps]:
                        d = math.hypot(p[1] - q[1], p[2] - q[2])
                        if best is None or d < best[0]:
                            best = (d, i, j, p[0], q[0])
        _, i, j, p, q = best
        out.append((p, q))
        parts = [g for k, g in enumerate(parts) if k not in (i, j)] + [parts[i] + parts[j]]
    return out


def test_components_merge_in_the_plain_order(spark):
    r, rows = random.Random(17), []
    for f in range(200):
        place = (lambda: float(r.randrange(5))) if f % 2 else r.random  # every second floor has many equal distances
        rows += [(1000 * f + k, f"f{f}", place(), place(), 1000 * f + r.randrange(1 + f % 9)) for k in range(1 + f % 23)]
    nodes = spark.createDataFrame([x[:4] for x in rows], "node_id long, floor_id string, x double, y double")
    parts = spark.createDataFrame([(x[0], x[4]) for x in rows], "node_id long, component long")
    got = {}
    for m in fp.closest_merges(nodes, parts, 2).collect():
        got.setdefault(m.floor_id, []).append((m.src, m.dst))
    for f in range(200):
        own = [(n, x, y, c) for n, floor_id, x, y, c in rows if floor_id == f"f{f}"]
        assert got.get(f"f{f}", []) == plain_merges(own, 2)


def test_building_graph_joins_all_rooms(spark):
    grid = {(x, y): int(0 < x < 29 and 0 < y < 29 and (x % 10 > 0 or y % 10 == 5) and (y % 10 > 0 or x % 10 == 5)) for x in range(30) for y in range(30)}
    rooms = [(f * 10 + k, f"f{f}", f + 1, f"{f + 1}.{100 + k}", (5 + 10 * (k % 3)) / 30, (5 + 10 * (k // 3)) / 30, 0.9) for f in (0, 1) for k in range(9) if k != 4]
    rooms += [(100 + f, f"f{f}", f + 1, "ELEV", 15 / 30, 15 / 30, 0.5) for f in (0, 1)]
    seen = spark.createDataFrame(rooms, "det_id long, floor_id string, floor_num int, raw_text string, x double, y double, conf double")
    floors = spark.createDataFrame([("f0", 0), ("f1", 1)], "floor_id string, floor_no int")
    made = fp.building_graph(cells_of(spark, {"f0": grid, "f1": grid}).drop("dist"), seen, floors, 30, 30, hull=5, margin=0)
    nodes, edges = made["nodes"].collect(), made["edges"].collect()
    assert len(nodes) == 18 and sum(e.inter_floor for e in edges) == 1
    assert {(e.src, e.dst) for e in edges if e.inter_floor} == {(100, 101)}
    reached, queue = {100}, [100]
    while queue:
        n = queue.pop()
        for e in edges:
            for a, b in ((e.src, e.dst), (e.dst, e.src)):
                if a == n and b not in reached:
                    reached.add(b)
                    queue.append(b)
    assert reached == {n.node_id for n in nodes}


def test_nearest_matches_brute_force(spark):
    r = random.Random(9)
    points = [(i, r.choice("abc"), r.random() * r.choice([1, 30]), r.random()) for i in range(80)]
    targets = [(i, r.choice("ab"), round(r.random(), 1), round(r.random(), 1)) for i in range(60)] + [(99, "c", 3.0, 3.0)]
    p = spark.createDataFrame(points, "point_id long, k string, x double, y double")
    t = spark.createDataFrame(targets, "target_id long, k string, x double, y double")
    for k in (1, 4):
        got = {}
        for x in spatial.nearest(p, t, "k", k, digits=9).collect():
            got.setdefault(x.point_id, []).append((x.place, x.target_id))
        for i, c, x, y in points:
            want = sorted((round(math.hypot(x - u, y - v), 9), j) for j, d, u, v in targets if d == c)[:k]
            assert sorted(got[i]) == [(n + 1, j) for n, (_, j) in enumerate(want)]
    assert spatial.nearest(p, t.limit(0), "k").count() == 0


def test_a_long_chain_of_points_settles(spark):
    rows = [(i, "a", 0.9 * i, 0.0) for i in range(140)] + [(1000 + i, "b", 0.5, 0.5) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, x double, y double")
    got = {x.id: x.seed_id for x in spatial.seeded_radius_groups(df, ["k"], [], 1.0).collect()}
    assert all(got[i] == i - i % 2 for i in range(140)) and {got[1000 + i] for i in range(3000)} == {1000}


def test_paths_by_rounds_equal_paths_in_tasks(spark, monkeypatch):
    r = random.Random(10)
    edges = spark.createDataFrame([(r.randrange(20), 20 + r.randrange(20), float(r.randint(1, 9))) for _ in range(30)], "src long, dst long, weight double")
    pairs = spark.createDataFrame([(i, r.randrange(40), r.randrange(40)) for i in range(5)] + [(15, 77, 77), (16, 77, 3)], "pair_id long, start_id long, goal_id long")
    one = {x.pair_id: x.cost for x in graph.shortest_paths(pairs, edges).collect()}
    monkeypatch.setattr(graph, "MOST_ARCS", 10)
    assert {x.pair_id: x.cost for x in graph.shortest_paths(pairs, edges).collect()} == one
    assert one[15] == 0.0 and one[16] is None


def test_lines_are_only_straightened_where_they_are_clear(spark):
    grid = {(x, y): int(not (x == 10 and y < 8)) for x in range(21) for y in range(12)}
    path = [(0, 0), (5, 4), (9, 8), (10, 9), (11, 8), (15, 4), (20, 0)]
    df = spark.createDataFrame([(1, "a", i, float(x), float(y)) for i, (x, y) in enumerate(path)], "path_id long, floor_id string, seq long, x double, y double")
    cells = cells_of(spark, {"a": grid})
    assert [x.seq for x in raster.rdp_simplify(df, 50.0).orderBy("seq").collect()] == [0, 6]
    kept = [path[x.seq] for x in raster.rdp_simplify(df, 50.0, cells).orderBy("seq").collect()]
    assert (10, 9) in kept and len(kept) < 7


def test_hallway_samples_lie_on_the_skeleton_and_apart(spark):
    cells = [("a", x, 5) for x in range(60)] + [("a", 30, y) for y in range(6, 20)] + [("a", 50, 15), ("a", 51, 15)]
    df = spark.createDataFrame(cells, "floor_id string, x long, y long")
    got = [(x.x, x.y, x.kind) for x in fp.hallway_nodes(df, spacing=10).collect()]
    kinds = [k for *_, k in got]
    assert kinds.count("sample") >= 4 and "end" in kinds and "junction" in kinds
    assert all(math.hypot(a[0] - b[0], a[1] - b[1]) >= 5 for i, a in enumerate(got) for b in got[:i])
    room = spark.createDataFrame([("a", 0.0, 5.0)], "floor_id string, x double, y double")
    assert len(fp.hallway_nodes(df, room, 10, 3.0).collect()) == len(got) - 1
