"""Ways over floor rasters: a floor is a page, so its cells fit a task, whose size is checked; floors run beside each other.

Cells are rows (floor_id, x, y, passable), some with ``dist``, the distance to the nearest wall.
Rows that ask for something on a floor are dealt into groups of ``SHARE``, each of which meets
the floor's cells once.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators import graph as gr
from wayfarer.operators.iterate import cut
from wayfarer.operators.raster import CROSS
from wayfarer.operators.spatial import nearest_candidates, snap_to_passable

#: Cells of a floor that one task may hold.
MOST_CELLS = 16_000_000
#: Rows that ask per task.
SHARE = 2000
#: Cells of a line that are looked at one by one before the rest is taken as arrays.
NEAR = 48
POINTS = "array<struct<x: long, y: long>>"


class Raster:
    """One floor's cells in a rectangle; cells without a row are walls."""

    def __init__(self, cells: pd.DataFrame):
        self.x0, self.y0 = (int(cells["x"].min()), int(cells["y"].min())) if len(cells) else (0, 0)
        self.w = int(cells["x"].max()) - self.x0 + 1 if len(cells) else 0
        self.h = int(cells["y"].max()) - self.y0 + 1 if len(cells) else 0
        at = (cells["y"].to_numpy(np.int64) - self.y0) * self.w + cells["x"].to_numpy(np.int64) - self.x0
        self.free = np.zeros(self.w * self.h, np.uint8)
        self.free[at] = cells["passable"].to_numpy() == 1
        self.dist = np.zeros(self.w * self.h)
        if "dist" in cells:
            self.dist[at] = cells["dist"].fillna(0).to_numpy(float)
        self.open = self.free.tobytes()

    @functools.cached_property
    def prices(self) -> list[float]:
        """What entering each cell costs on a weighted way; made once for all ways on this raster."""
        return (1 + 8 / (self.dist + 1)).tolist()

    def cell(self, i: int) -> tuple[int, int]:
        return i % self.w + self.x0, i // self.w + self.y0

    def snap(self, x: int, y: int, cap: int) -> int | None:
        """The passable cell on the smallest square ring around the (clamped) cell, by row, then column."""
        if not self.w:
            return None
        x, y = min(max(x - self.x0, 0), self.w - 1), min(max(y - self.y0, 0), self.h - 1)
        if self.open[y * self.w + x]:
            return y * self.w + x
        grid = self.free.reshape(self.h, self.w)
        for r in range(1, cap):
            top, left = max(0, y - r), max(0, x - r)
            rows, columns = np.nonzero(grid[top : y + r + 1, left : x + r + 1])
            if len(rows):  # nothing lies nearer, so these are on the ring
                return int(rows[0] + top) * self.w + int(columns[0] + left)
        return None

    def way(self, start: int, goal: int, weighted: bool):
        """(cost, cells) of a cheapest 4-connected way; entering a cell costs 1, weighted 1 + 8 / (dist + 1)."""
        w, n, open_ = self.w, self.w * self.h, self.open
        gx, gy = goal % w, goal // w
        price = self.prices if weighted else None
        cost, before, done = {start: 0.0}, {start: -1}, set()
        heap = [(abs(start % w - gx) + abs(start // w - gy), start)]
        while heap:
            _, i = heapq.heappop(heap)
            if i == goal:
                path = []
                while i >= 0:
                    path.append(i)
                    i = before[i]
                return cost[goal], path[::-1]
            if i in done:
                continue
            done.add(i)
            x = i % w
            for j, ok in ((i - w, i >= w), (i + w, i + w < n), (i - 1, x > 0), (i + 1, x < w - 1)):
                if ok and open_[j] and j not in done:
                    c = cost[i] + (price[j] if weighted else 1.0)
                    if c < cost.get(j, float("inf")):
                        cost[j], before[j] = c, i
                        heapq.heappush(heap, (c + abs(j % w - gx) + abs(j // w - gy), j))
        return None

    def sees(self, a: int, b: int) -> bool:
        """No wall on the straight line of cells, nor a diagonal step between two walls."""
        x0, y0, x1, y1 = a % self.w, a // self.w, b % self.w, b // self.w
        n = max(abs(x1 - x0), abs(y1 - y0))
        if not n:
            return bool(self.open[a])
        if not self._sees_begin(x0, y0, x1, y1, n):
            return False
        if n <= NEAR:
            return True
        k = np.arange(NEAR, n + 1)
        x = x0 + np.sign(x1 - x0) * ((abs(x1 - x0) * 2 * k + n) // (2 * n))
        y = y0 + np.sign(y1 - y0) * ((abs(y1 - y0) * 2 * k + n) // (2 * n))
        if not self.free[y * self.w + x].all():
            return False
        slant = (x[1:] != x[:-1]) & (y[1:] != y[:-1])
        return bool((self.free[y[:-1] * self.w + x[1:]] | self.free[y[1:] * self.w + x[:-1]])[slant].all())

    def _sees_begin(self, x0: int, y0: int, x1: int, y1: int, n: int) -> bool:
        """The same of the first ``NEAR`` cells; most lines that end at a wall end there."""
        w, open_ = self.w, self.open
        dx, dy, sx, sy = 2 * abs(x1 - x0), 2 * abs(y1 - y0), (x1 > x0) - (x1 < x0), (y1 > y0) - (y1 < y0)
        x, y = x0, y0
        if not open_[y * w + x]:
            return False
        for k in range(1, min(n, NEAR) + 1):
            bx, by, x, y = x, y, x0 + sx * ((dx * k + n) // (2 * n)), y0 + sy * ((dy * k + n) // (2 * n))
            if not open_[y * w + x] or (x != bx and y != by and not (open_[by * w + x] or open_[y * w + bx])):
                return False
        return True

    def crosses_no_wall(self, a: int, b: int) -> bool:
        """No wall cell on the line that steps by its error term; unlike ``sees`` it may pass between two walls."""
        x, y, x1, y1 = a % self.w, a // self.w, b % self.w, b // self.w
        dx, dy, sx, sy = abs(x1 - x), abs(y1 - y), 1 if x < x1 else -1, 1 if y < y1 else -1
        error = dx - dy
        while self.open[y * self.w + x]:
            if (x, y) == (x1, y1):
                return True
            twice = 2 * error
            if twice > -dy:
                error, x = error - dy, x + sx
            if twice < dx:
                error, y = error + dx, y + sy
        return False

    def halved(self, path: list[int]) -> list[int]:
        """The client's thinning: from each kept cell the next is found by halving the rest, as if sight ended only once."""
        kept, i = path[:1], 0
        while i < len(path) - 1:
            low, high = i + 1, len(path) - 1
            while low < high:
                half = (low + high + 1) // 2
                low, high = (half, high) if self.crosses_no_wall(path[i], path[half]) else (low, half - 1)
            kept.append(path[low])
            i = low
        return kept

    def jumps(self, path: list[int]) -> list[int]:
        """Places of the cells that stay: each jumps to the farthest later one in sight, or else to the next."""
        kept, i = [0][: len(path)], 0
        while i < len(path) - 1:
            i = next((j for j in range(len(path) - 1, i + 1, -1) if self.sees(path[i], path[j])), i + 1)
            kept.append(i)
        return kept

    def simplified(self, path: list[int]) -> list[int]:
        return [path[i] for i in self.jumps(path)]

    def centred(self, path: list[int], radius: int) -> list[int]:
        """Each cell moves to the passable one farthest from walls within the radius; moves that lose sight of a neighbour are undone in order."""
        far, moved = (self.dist * self.free).reshape(self.h, self.w), []
        for i in path:
            x, y = i % self.w, i // self.w
            top, left = max(0, y - radius), max(0, x - radius)
            part = far[top : y + radius + 1, left : x + radius + 1]
            best = int(part.argmax())
            row, column = divmod(best, part.shape[1])
            moved.append((row + top) * self.w + column + left if part[row, column] > self.dist[i] else i)
        for k, i in enumerate(path):
            sight = (k == 0 or self.sees(moved[k - 1], moved[k])) and (k + 1 == len(path) or self.sees(moved[k], moved[k + 1]))
            if not sight:
                moved[k] = i
        return moved

    def points(self, path: list[int]) -> list[dict]:
        return [dict(zip("xy", self.cell(i))) for i in path]


def _by_floor(asks: DataFrame, cells: DataFrame, of, schema: str) -> DataFrame:
    """``of(rows, Raster)`` over groups of rows of one floor; rows of a floor without cells meet an empty raster."""
    sizes = cells.groupBy("floor_id").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most > MOST_CELLS:
        raise ValueError(f"a floor has {most} cells; render it at a lower scale or in tiles of at most {MOST_CELLS}")
    groups = asks.groupBy("floor_id").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("groups"))
    rows = asks.join(groups, "floor_id").withColumn("group", F.pmod(F.xxhash64(*asks.columns), "groups").cast("int")).drop("groups")
    more = [c for c in ("dist",) if c in cells.columns]
    wanted = cells.select("floor_id", "x", "y", "passable", *more).join(groups, "floor_id")
    copies = wanted.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

    def each(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in schema.replace("array<struct<x: long, y: long>>", "points").split(", ")]
        return pd.DataFrame(of(left, Raster(right)) if len(left) else [], columns=names)

    keys = ("floor_id", "group")
    return rows.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(each, schema)


def grid_shortest_paths(pairs: DataFrame, cells: DataFrame, weighted: bool = False, snap: int = 200, simplify: bool | str = False) -> DataFrame:
    """(pair_id, floor_id, cost, path): 4-connected ways between cells (pair_id, floor_id, x0, y0, x1, y1).

    Ends are snapped to passable cells. Where there is no way, or no raster, the cost is null
    and the path is the straight line between the given cells. Equal costs keep any one way.
    ``simplify`` keeps the cells that jump as far as they see; as "halving" those of the client's search.
    """
    kind = pairs.schema["pair_id"].dataType.simpleString()
    floor = pairs.schema["floor_id"].dataType.simpleString()

    thin = {False: lambda raster, path: path, "halving": Raster.halved}.get(simplify, Raster.simplified)

    def of(rows, raster):
        out = []
        for pair, f, x0, y0, x1, y1 in rows[["pair_id", "floor_id", "x0", "y0", "x1", "y1"]].itertuples(index=False):
            a, b = raster.snap(int(x0), int(y0), snap), raster.snap(int(x1), int(y1), snap)
            found = raster.way(a, b, weighted) if a is not None and b is not None else None
            if found is None:
                out.append((pair, f, None, [{"x": int(x0), "y": int(y0)}, {"x": int(x1), "y": int(y1)}]))
            else:
                out.append((pair, f, found[0], raster.points(thin(raster, found[1]))))
        return out

    return _by_floor(pairs.select("pair_id", "floor_id", "x0", "y0", "x1", "y1"), cells, of, f"pair_id {kind}, floor_id {floor}, cost double, path {POINTS}")


def route_cell_paths(segments: DataFrame, cells: DataFrame, weighted: bool = False, simplify: bool | str = True) -> DataFrame:
    """Segments (route_id, part, floor_id, waypoints in cells) with the simplified cell path between their ends.

    ``simplify="halving"`` thins as the client does, whose sight passes between two walls that touch at a corner.

    Segments with fewer than two waypoints, or on a floor without cells, stay as they are.
    """
    key = F.struct("route_id", "part")
    floors = cells.select("floor_id").distinct()
    long_ = segments.filter(F.size("waypoints") >= 2).join(floors, "floor_id", "left_semi")
    end = lambda i, c: F.try_element_at("waypoints", F.lit(i))[c].cast("long")
    pairs = long_.select(F.to_json(key).alias("pair_id"), "floor_id", end(1, "x").alias("x0"), end(1, "y").alias("y0"), end(-1, "x").alias("x1"), end(-1, "y").alias("y1"))
    found = grid_shortest_paths(pairs, cells, weighted, simplify=simplify).select("pair_id", "path")
    now = segments.withColumn("pair_id", F.to_json(key)).join(found, "pair_id", "left")
    return now.withColumn("waypoints", F.coalesce("path", F.col("waypoints").cast(POINTS))).select(segments.columns)


def centre_paths(paths: DataFrame, cells: DataFrame, radius: int = 15, simplify: bool = False) -> DataFrame:
    """(path_id, floor_id, path): paths (path_id, floor_id, path of cells) moved away from walls; ``cells`` have dist."""
    kind, floor = (paths.schema[c].dataType.simpleString() for c in ("path_id", "floor_id"))

    def of(rows, raster):
        out = []
        for pid, f, path in rows[["path_id", "floor_id", "path"]].itertuples(index=False):
            at = [(p["y"] - raster.y0) * raster.w + p["x"] - raster.x0 for p in path]
            moved = raster.centred(at, radius)
            out.append((pid, f, raster.points(raster.simplified(moved) if simplify else moved)))
        return out

    return _by_floor(paths.select("path_id", "floor_id", "path"), cells, of, f"path_id {kind}, floor_id {floor}, path {POINTS}")


def greedy_visibility_simplify(paths: DataFrame, cells: DataFrame) -> DataFrame:
    """Points (path_id, floor_id, seq, x, y) that stay when each kept one jumps to the farthest later one in sight."""
    kinds = {c: paths.schema[c].dataType.simpleString() for c in ("path_id", "floor_id", "seq", "x", "y")}
    held = paths.groupBy("path_id", "floor_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("held"))

    def of(rows, raster):
        out = []
        for pid, f, points in rows[["path_id", "floor_id", "held"]].itertuples(index=False):
            at = [(int(p["y"]) - raster.y0) * raster.w + int(p["x"]) - raster.x0 for p in points]
            out += [(pid, f, points[i]["seq"], points[i]["x"], points[i]["y"]) for i in raster.jumps(at)]
        return out

    return _by_floor(held, cells, of, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def multi_source_regions(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(floor_id, x, y, source_id, steps, px, py): each passable cell to its nearest source by 4-neighbour steps.

    Equal steps go to the smaller source, then the smaller predecessor (row, then column).
    """
    floor, kind = cells.schema["floor_id"].dataType.simpleString(), sources.schema["source_id"].dataType.simpleString()

    def of(rows, raster):
        owner, w, n = {}, raster.w, raster.w * raster.h
        first = {}
        for s, x, y in rows.sort_values("source_id")[["source_id", "x", "y"]].itertuples(index=False):
            i = (int(y) - raster.y0) * w + int(x) - raster.x0
            if 0 <= i < n and 0 <= int(x) - raster.x0 < w and raster.open[i]:
                first.setdefault(i, s)
        f = rows["floor_id"].iloc[0]
        now, step, out = [(s, i) for i, s in first.items()], 0, []
        owner.update(first)
        out += [(f, *raster.cell(i), s, 0, None, None) for s, i in now]
        while now:
            step, following = step + 1, []
            for s, i in sorted(now):  # by source, row, column: the first to arrive wins
                for dx, dy in CROSS[1:]:
                    x, y = i % w + dx, i // w + dy
                    j = y * w + x
                    if 0 <= x < w and 0 <= y < raster.h and raster.open[j] and j not in owner:
                        owner[j] = s
                        following.append((s, j))
                        out.append((f, *raster.cell(j), s, step, *raster.cell(i)))
            now = following
        return out

    # all sources of a floor grow together, so they stay in one group
    held = sources.groupBy("floor_id").agg(F.collect_list(F.struct("source_id", "x", "y")).alias("held"))

    def whole(rows, raster):
        pairs = rows[["floor_id", "held"]].itertuples(index=False)
        flat = pd.DataFrame([{"floor_id": f} | {c: h[c] for c in ("source_id", "x", "y")} for f, hs in pairs for h in hs])
        return of(flat, raster) if len(flat) else []

    return _by_floor(held, cells, whole, f"floor_id {floor}, x long, y long, source_id {kind}, steps int, px long, py long")


def skeleton_samples(skeleton: DataFrame, spacing: int = 50) -> DataFrame:
    """(floor_id, x, y): every ``spacing`` steps along each 8-connected part from its first end (or cell) on.

    A part of fewer cells than ``spacing`` gives its centre.
    """
    floor = skeleton.schema["floor_id"].dataType.simpleString()

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = set(zip(pdf["y"].tolist(), pdf["x"].tolist()))
        near = lambda y, x: [(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1) if (i or j) and (y + j, x + i) in cells]
        seen, out = set(), []
        # ends first, so that a part is walked from one of them
        for start in sorted(cells, key=lambda c: (len(near(*c)) != 1, c)):
            if start in seen:
                continue
            steps, now = {start: 0}, [start]
            while now:
                now = [c for b in now for c in near(*b) if c not in steps and steps.setdefault(c, steps[b] + 1)]
            seen |= steps.keys()
            if len(steps) < spacing:
                out.append((sum(x for _, x in steps) / len(steps), sum(y for y, _ in steps) / len(steps)))
            else:
                out += [(float(x), float(y)) for (y, x), n in sorted(steps.items()) if n and n % spacing == 0]
        return pd.DataFrame([(pdf["floor_id"].iloc[0], x, y) for x, y in out], columns=["floor_id", "x", "y"])

    return skeleton.groupBy("floor_id").applyInPandas(each, f"floor_id {floor}, x double, y double")


def hallway_nodes(skeleton: DataFrame, rooms: DataFrame | None = None, spacing: int = 50, room_radius: float = 0.04) -> DataFrame:
    """(floor_id, x, y, kind) of hallway nodes: junctions, ends and samples, those within half the spacing of an earlier one merged.

    ``rooms`` (floor_id, x, y) in cells take the nodes within ``room_radius``, in cells too.
    """
    from wayfarer.operators.raster import skeleton_nodes
    from wayfarer.operators.spatial import near_pairs, seeded_radius_groups

    skeleton = cut(skeleton)
    keys = skeleton_nodes(skeleton).select("floor_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "kind")
    rows = keys.unionByName(skeleton_samples(skeleton, spacing).withColumn("kind", F.lit("sample")))
    rank = F.when(F.col("kind") == "junction", 0).when(F.col("kind") == "end", 1).otherwise(2)
    rows = rows.withColumn("rank", rank).withColumn("id", F.to_json(F.struct("floor_id", "rank", "y", "x")))
    rows = cut(seeded_radius_groups(rows, ["floor_id"], ["rank", "y", "x"], spacing / 2).filter("id = seed_id"))
    if rooms is not None:
        inside = near_pairs(rows.select("id", "floor_id", "x", "y"), rooms.select("floor_id", "x", "y"), ["floor_id"], room_radius)
        rows = rows.join(inside.select("l.id").distinct(), "id", "left_anti")
    return rows.select("floor_id", "x", "y", "kind")


def trace_region_paths(regions: DataFrame, edges: DataFrame) -> DataFrame:
    """(floor_id, a, b, path): from source a over the meeting cells to source b, along the regions' predecessors."""
    floor, kind = (edges.schema[c].dataType.simpleString() for c in ("floor_id", "a"))
    schema = f"floor_id {floor}, a {kind}, b {kind}, path {POINTS}"

    def each(asks: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        before = {(x, y): (px, py) for x, y, px, py in cells[["x", "y", "px", "py"]].itertuples(index=False)}

        def back(x, y):
            out = [{"x": x, "y": y}]
            while not pd.isna(before[x, y][0]):
                x, y = (int(v) for v in before[x, y])
                out.append({"x": x, "y": y})
            return out

        rows = []
        for f, a, b, ax, ay, bx, by in asks[["floor_id", "a", "b", "ax", "ay", "bx", "by"]].itertuples(index=False):
            rows.append((f, a, b, back(int(ax), int(ay))[::-1] + back(int(bx), int(by))))
        return pd.DataFrame(rows, columns=["floor_id", "a", "b", "path"])

    steps = regions.select(F.col("floor_id").alias("floor"), "x", "y", "px", "py")
    return edges.groupBy("floor_id").cogroup(steps.groupBy("floor")).applyInPandas(each, schema)


def _ways_between(pairs: DataFrame, nodes: DataFrame, cells: DataFrame, scale: float) -> DataFrame:
    """(src, dst, place, weight, path) of the pairs (src, dst, place) that a cell path joins."""
    at = lambda i, name: nodes.select(F.col("node_id").alias(name), F.col("x").cast("long").alias(f"x{i}"), F.col("y").cast("long").alias(f"y{i}"))
    asks = pairs.join(at(0, "src").join(nodes.select(F.col("node_id").alias("src"), "floor_id"), "src"), "src").join(at(1, "dst"), "dst")
    asks = cut(asks.withColumn("pair_id", F.to_json(F.struct("src", "dst"))))
    found = grid_shortest_paths(asks, cells, snap=50, simplify=True).filter("cost is not null").select("pair_id", "cost", "path")
    return asks.join(found, "pair_id").select("src", "dst", "place", "floor_id", ((F.col("cost") + 1) / scale).alias("weight"), "path")


def connect_isolated(nodes: DataFrame, edges: DataFrame, cells: DataFrame, k: int = 5, scale: float = 3.0) -> DataFrame:
    """(src, dst, floor_id, weight, path): each node without edges joins the first of its k nearest that a cell path reaches.

    ``nodes`` (node_id, floor_id, x, y in cells).
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    alone = cut(nodes.join(ends, "node_id", "left_anti"))
    near = nearest_candidates(nodes, alone, k).select(F.col("node_id").alias("src"), F.col("other_id").alias("dst"), "place")
    ways = _ways_between(near, nodes, cells, scale)
    best = F.min_by(F.struct("dst", "floor_id", "weight", "path"), "place").alias("b")
    return ways.groupBy("src").agg(best).select("src", "b.*")


def closest_merges(nodes: DataFrame, components: DataFrame, reps: int = 20) -> DataFrame:
    """(src, dst, floor_id): the closest two components of a floor are merged over and over; each merge names its pair.

    Distances are between the first ``reps`` nodes of each component; a merged one lists the
    nodes of the earlier component first and comes last. Nodes are ordered by id. A component holds
    its nearest other one only; a merge looks anew for those whose nearest has gone.
    """
    rows = nodes.select("node_id", "floor_id", "x", "y").join(components, "node_id")
    floor, kind = (rows.schema[c].dataType.simpleString() for c in ("floor_id", "node_id"))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        ids, xy = pdf["node_id"].tolist(), pdf[["x", "y"]].to_numpy(float)
        parts: dict = {}
        for i, c in enumerate(pdf["component"].tolist()):
            parts.setdefault(c, []).append(i)
        groups, out = list(parts.values()), []
        between = lambda a, b: np.hypot(*(xy[a][:, None] - xy[b][None, :]).transpose(2, 0, 1))
        heads = {k: g[:reps] for k, g in enumerate(groups)}  # the place of each component in the list, and its first nodes

        def closest(k: int) -> tuple:
            """The nearest other component, the earlier one on ties: (gap, earlier, later)."""
            others = [o for o in heads if o != k]
            starts = np.cumsum([0, *(len(heads[o]) for o in others)])[:-1]
            every = np.concatenate([heads[o] for o in others]).astype(int)
            gaps = np.minimum.reduceat(between(heads[k], every).min(axis=0), starts)
            o = others[int(gaps.argmin())]
            return float(gaps.min()), min(k, o), max(k, o)

        members = dict(enumerate(groups))
        found = {k: closest(k) for k in heads} if len(heads) > 1 else {}
        for new in range(len(groups), 2 * len(groups) - 1):
            _, i, j = min(found.values())
            d = between(heads[i], heads[j])
            at = int(d.argmin())
            out.append((ids[heads[i][at // d.shape[1]]], ids[heads[j][at % d.shape[1]]], pdf["floor_id"].iloc[0]))
            members[new] = members.pop(i) + members.pop(j)
            for k in (i, j):
                del heads[k], found[k]
            heads[new] = members[new][:reps]
            if len(heads) == 1:
                break
            found[new] = closest(new)
            every = np.concatenate([heads[k] for k in found if k != new]).astype(int)
            starts = np.cumsum([0, *(len(heads[k]) for k in found if k != new)])[:-1]
            gaps = np.minimum.reduceat(between(heads[new], every).min(axis=0), starts)
            for k, gap in zip([k for k in found if k != new], gaps.tolist()):
                if found[k][1] in (i, j) or found[k][2] in (i, j):  # what was nearest is gone
                    found[k] = closest(k)
                elif gap < found[k][0]:
                    found[k] = (gap, k, new)
        return pd.DataFrame(out, columns=["src", "dst", "floor_id"])

    return rows.groupBy("floor_id").applyInPandas(each, f"src {kind}, dst {kind}, floor_id {floor}")


def bridge_components(nodes: DataFrame, edges: DataFrame, cells: DataFrame, scale: float = 3.0) -> DataFrame:
    """(src, dst, floor_id, weight, path): edges that join a floor's components, where a cell path exists."""
    known = nodes.select(F.col("node_id"))
    flat = edges.select("src", "dst").withColumn("inter_floor", F.lit(False))
    pairs = closest_merges(nodes, gr.connected_components(known, flat)).withColumn("place", F.lit(1)).drop("floor_id")
    return _ways_between(cut(pairs), nodes, cells, scale).drop("place")


def building_graph(cells: DataFrame, detections: DataFrame, floors: DataFrame, width: int, height: int, scale: float = 3.0, hull: int = 51, margin: int = 5) -> dict[str, DataFrame]:
    """nodes and edges of a building from its rasters, detections and floors (floor_id, floor_no), all floors together.

    Rooms and transports become nodes; label boxes are cleared and the outside is closed; regions
    that touch become edges along centred, simplified paths; nodes and components that are left
    over are joined where a way exists; shafts join the floors.
    """
    from wayfarer.operators import raster as ra
    from wayfarer.operators import spatial as sp

    found = sp.room_nodes(detections).join(floors.select("floor_id", "floor_no"), "floor_id")
    cell = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.col(c) * n))).cast("long")
    nodes = cut(found.withColumnRenamed("det_id", "node_id").withColumns({"px": cell("x", width), "py": cell("y", height)}))
    placed = nodes.select("node_id", "floor_id", F.col("px").alias("x"), F.col("py").alias("y"), F.col("label").alias("text"))
    grid = ra.mask_text_regions(cells, placed, margin=margin)
    grid = cut(ra.mask_exterior_hull(grid, placed, hull))
    far = cut(ra.distance_to_wall(grid))
    spots = snap_to_passable(placed.select(F.col("node_id").alias("point_id"), "floor_id", "x", "y"), grid, 100)
    regions = cut(multi_source_regions(grid, spots.select("floor_id", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("point_id").alias("source_id"))))
    touching = cut(ra.region_boundary_edges(regions, scale, grid))
    traced = trace_region_paths(regions, touching).select(F.struct("a", "b").alias("path_id"), "floor_id", "path")
    paths = centre_paths(traced.withColumn("path_id", F.to_json("path_id")), far, simplify=True)
    edges = touching.withColumn("path_id", F.to_json(F.struct("a", "b"))).join(paths.select("path_id", "path"), "path_id")
    edges = cut(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "floor_id", "weight", "path"))
    at_cells = placed.drop("text")
    edges = cut(edges.unionByName(connect_isolated(at_cells, edges, grid, scale=scale)))
    edges = edges.unionByName(bridge_components(at_cells, edges, grid, scale)).withColumn("inter_floor", F.lit(False))
    edges = cut(edges)
    shafts = gr.link_shafts(nodes.filter("type <> 'room'"), edges)
    up = shafts.select("src", "dst", F.lit(None).cast("string").alias("floor_id"), "weight", F.lit(None).cast(POINTS).alias("path"), F.lit(True).alias("inter_floor"))
    return {"nodes": nodes.drop("px", "py"), "edges": edges.withColumn("floor_id", F.col("floor_id").cast("string")).unionByName(up)}
