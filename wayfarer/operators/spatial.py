"""Proximity joins and groupings. Points meet in square buckets as wide as the radius, never all with all."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wayfarer.functions.scalars import point_segment_distance
from wayfarer.operators.iterate import cut, drop


def _bucket(column, size: float) -> Column:
    return F.floor(F.col(column) / size)


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], radius: float, strict: bool = True) -> DataFrame:
    """Rows (l, r, dist) of points with equal keys within the radius; both sides have x and y and come back as structs."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.select(F.struct(*left.columns).alias("l"), *keys, _bucket("x", radius).alias("bx"), _bucket("y", radius).alias("by"))
    b = (
        right.select(F.struct(*right.columns).alias("r"), *keys, "x", "y", F.explode(offsets).alias("o"))
        .select("r", *keys, (_bucket("x", radius) + F.col("o.i")).alias("bx"), (_bucket("y", radius) + F.col("o.j")).alias("by"))
    )
    dist = F.hypot(F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y"))
    out = a.join(b, [*keys, "bx", "by"]).select("l", "r", dist.alias("dist"))
    return out.filter(F.col("dist") < radius if strict else F.col("dist") <= radius)


def seeded_stream(df: DataFrame, keys: list[str], order: list[str], radius: float, strict: bool, id_col: str, apart: str | None = None) -> DataFrame:
    """``df`` with seed_id: rows in order seed a group unless an earlier seed with equal keys is within the radius.

    The rule is sequential within equal keys, so Spark sorts the rows and a task reads them as a
    stream. It keeps the seeds alone, in square buckets as wide as the radius; seeds lie farther
    apart than that, so a page holds a bounded number of them, however many rows it has. With
    ``apart`` only seeds with another value of that column count. Ties in order go by id.
    """
    schema = StructType([*df.schema.fields, StructField("seed_id", df.schema[id_col].dataType)])
    names = [*df.columns]
    place = {c: i for i, c in enumerate(names)}

    def of(batches):
        now, seeds, n = None, {}, 0
        for batch in batches:
            column = lambda c: batch.column(place[c]).to_pylist()
            own = column(apart) if apart else [None] * batch.num_rows
            out = []
            for key, id_, x, y, side in zip(zip(*map(column, keys)), column(id_col), column("x"), column("y"), own):
                if key != now:
                    now, seeds, n = key, {}, 0
                if x is None or y is None:
                    out.append(id_)
                    continue
                bx, by, best = math.floor(x / radius), math.floor(y / radius), None
                for i in (bx - 1, bx, bx + 1):
                    for j in (by - 1, by, by + 1):
                        for seed in seeds.get((i, j), ()):
                            d = math.hypot(x - seed[2], y - seed[3])
                            near = d < radius if strict else d <= radius
                            if near and (apart is None or seed[4] != side) and (best is None or seed[0] < best[0]):
                                best = seed
                if best is None:
                    best = (n, id_, x, y, side)
                    seeds.setdefault((bx, by), []).append(best)
                    n += 1
                out.append(best[1])
            kind = batch.schema.field(place[id_col]).type
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*names, "seed_id"])

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order, id_col)
    return ordered.mapInArrow(of, schema)


def seeded_radius_groups(df: DataFrame, keys: list[str], order: list[str], radius: float, strict: bool = True, id_col: str = "id") -> DataFrame:
    """``seed_id`` of each row: rows in order seed a group unless an earlier seed with equal keys is within the radius.

    Any other row belongs to its earliest seed within the radius; a row without a place seeds itself.
    """
    return seeded_stream(df, keys, order, radius, strict, id_col)


def alert_clusters(alerts: DataFrame, radius: float = 0.06) -> DataFrame:
    """Alerts of one type and floor grouped around the oldest within the radius; adds cluster_id, the seed's alert_id."""
    out = seeded_radius_groups(alerts, ["type", "floor_id"], ["created_at"], radius, True, "alert_id")
    return out.withColumnRenamed("seed_id", "cluster_id")


def cluster_summary(assigned: DataFrame) -> DataFrame:
    """Centroid, latest times, votes, distinct submitters and members of each cluster, and its seed's description."""
    said = F.col("description") if "description" in assigned.columns else F.lit(None).cast("string")
    return assigned.groupBy("cluster_id", "type", "floor_id").agg(
        F.avg("x").alias("x"),
        F.avg("y").alias("y"),
        F.max("created_at").alias("created_at"),
        F.max("expires_at").alias("expires_at"),
        F.sum("confirms").alias("confirms"),
        F.sum("denies").alias("denies"),
        F.sort_array(F.collect_set("submitted_by")).alias("submitters"),
        F.sort_array(F.collect_list("alert_id")).alias("members"),
        F.max(F.when(F.col("alert_id") == F.col("cluster_id"), said)).alias("description"),
    )


def nearest(points: DataFrame, targets: DataFrame, key: str, k: int = 1, itself: bool = True, digits: int | None = None) -> DataFrame:
    """(point_id, target_id, dist, place): the k nearest targets of each point with an equal key, the smaller id on ties.

    ``points`` (point_id, key, x, y), ``targets`` (target_id, key, x, y). A first search meets in
    buckets as wide as the key's mean spacing of targets; points with fewer than k targets inside
    that width search again in buckets four times as wide. ``digits`` rounds distances before they
    are compared; without ``itself`` a target with the point's id does not count.
    """
    span = lambda df, *more: df.groupBy(key).agg(*[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("x", "y")], *more)
    size = F.hypot(F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy"))
    held = span(targets, F.count(F.lit(1)).alias("n")).select(key, "n", "lox", "loy", "hix", "hiy", (size / F.sqrt("n")).alias("gap"))
    asked = span(points).select(key, *[F.col(c).alias(f"p{c}") for c in ("lox", "loy", "hix", "hiy")])
    far = F.hypot(F.greatest("hix", "phix") - F.least("lox", "plox"), F.greatest("hiy", "phiy") - F.least("loy", "ploy"))
    floors = held.join(asked, key).select(key, "n", far.alias("far"), "gap")
    # wide enough at last to hold every pair
    floors = cut(floors.withColumn("far", F.col("far") * 1.001 + 1e-9).withColumn("gap", F.when(F.col("gap") > 0, F.least("gap", "far")).otherwise(F.col("far"))))
    open_ = points.select("point_id", key, "x", "y")
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    found, step = None, 0
    while True:
        wide = floors.select(key, "n", "far", F.least(F.col("gap") * 4.0**step, "far").alias("width"))
        cell = lambda c: F.floor(F.col(c) / F.col("width"))
        a = open_.join(wide, key).select("point_id", key, "x", "y", "n", "far", "width", F.explode(offsets).alias("o"))
        a = a.withColumns({"bx": cell("x") + F.col("o.i"), "by": cell("y") + F.col("o.j")}).drop("o")
        b = targets.join(wide.select(key, "width"), key).select(key, "target_id", F.col("x").alias("tx"), F.col("y").alias("ty"), cell("x").alias("bx"), cell("y").alias("by"))
        dist = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
        met = a.join(b, [key, "bx", "by"]).withColumn("dist", dist if digits is None else F.round(dist, digits))
        met = met if itself else met.filter("point_id <> target_id")
        order = Window.partitionBy("point_id").orderBy("dist", "target_id")
        top = met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
        inside = F.count_if(F.col("dist") < F.col("width")).over(Window.partitionBy("point_id"))
        done = (inside >= F.least(F.lit(k), F.col("n"))) | (F.col("width") >= F.col("far"))
        hit = cut(top.withColumn("done", done).filter("done").select("point_id", "target_id", "dist", "place"))
        found = hit if found is None else found.unionByName(hit)
        searched = open_
        open_ = cut(open_.join(wide.filter("width < far"), key, "left_semi").join(hit.select("point_id").distinct(), "point_id", "left_anti"))
        drop(searched)
        if open_.isEmpty():
            return found
        step += 1


def nearest_node(points: DataFrame, nodes: DataFrame, key: str = "floor_id", kind: str | None = None) -> DataFrame:
    """(point_id, node_id, dist): the nearest node on the point's floor, the smaller id on ties."""
    targets = nodes if kind is None else nodes.filter(F.col("type") == kind)
    found = nearest(points, targets.select(F.col("node_id").alias("target_id"), key, "x", "y"), key)
    return found.select("point_id", F.col("target_id").alias("node_id"), "dist")


def nearest_candidates(nodes: DataFrame, isolated: DataFrame, k: int = 5, key: str = "floor_id") -> DataFrame:
    """(node_id, other_id, place): the k nearest other nodes of each isolated one; equal to nine places, the smaller id."""
    xy = lambda df, name: df.select(F.col("node_id").alias(name), key, "x", "y")
    found = nearest(xy(isolated, "point_id"), xy(nodes, "target_id"), key, k, itself=False, digits=9)
    return found.select(F.col("point_id").alias("node_id"), F.col("target_id").alias("other_id"), "place")


def snap_to_grid(points: DataFrame, grid: DataFrame, component: DataFrame, key: str = "floor_id") -> DataFrame:
    """Each point to the nearest grid point of the main component, distance to two places."""
    inside = grid.join(component.select("node_id"), "node_id", "left_semi")
    return nearest_node(points, inside, key).withColumn("dist", F.round("dist", 2))


def snap_to_passable(points: DataFrame, cells: DataFrame, cap: int = 200, key: str = "floor_id") -> DataFrame:
    """``sx, sy``: the passable cell on the smallest square ring, by row then column; itself when none is within the cap.

    Rings are searched in steps of growing radius; a step joins only points that are still open.
    """
    open_ = points.select("point_id", key, "x", "y")
    free = cells.filter("passable = 1").select(key, F.col("x").alias("cx"), F.col("y").alias("cy"))
    found, radius = None, 1
    while True:
        size = radius
        offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        p = open_.withColumn("o", F.explode(offsets)).select(
            "point_id", key, "x", "y", (F.floor(F.col("x") / size) + F.col("o.i")).alias("bx"), (F.floor(F.col("y") / size) + F.col("o.j")).alias("by")
        )
        c = free.withColumns({"bx": F.floor(F.col("cx") / size), "by": F.floor(F.col("cy") / size)})
        ring = F.greatest(F.abs(F.col("cx") - F.col("x")), F.abs(F.col("cy") - F.col("y")))
        hit = (
            p.join(c, [key, "bx", "by"])
            .filter(ring <= radius)
            .groupBy("point_id")
            .agg(F.min(F.struct(ring.alias("ring"), "cy", "cx")).alias("b"))
            .select("point_id", F.col("b.cx").alias("sx"), F.col("b.cy").alias("sy"))
        )
        hit = cut(hit)
        found = hit if found is None else found.union(hit)
        open_ = open_.join(hit, "point_id", "left_anti")
        if radius >= cap or open_.isEmpty():
            break
        radius = min(cap, radius * 4)
    rest = points.join(found, "point_id", "left")
    return rest.withColumns({"sx": F.coalesce("sx", "x"), "sy": F.coalesce("sy", "y")})


def _segment_buckets(segments: DataFrame, radius: float, size: float) -> DataFrame:
    """A row per bucket of width ``size`` that holds points within the radius of the segment, and few others.

    Over a column of buckets such points lie at most ``radius * sqrt(1 + slope^2)`` above or below the
    segment's line, and nowhere further than the radius from its ends. The rows ask for joins that shuffle:
    Spark takes them for as few as the segments and would broadcast them.
    """
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    low_x, high_x, low_y, high_y = F.least("x0", "x1") - radius, F.greatest("x0", "x1") + radius, F.least("y0", "y1") - radius, F.greatest("y0", "y1") + radius
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    slope = F.when(F.abs(dx) > 1e-9 * (F.abs(dy) + size), dy / dx)  # null for a segment that stands upright
    rows = segments.withColumn("slope", slope).withColumn("reach", radius * F.sqrt(1 + F.col("slope") * F.col("slope")) * (1 + 1e-9))
    rows = rows.withColumn("bx", F.explode(span(low_x, high_x)))
    slope, reach = F.col("slope"), F.col("reach")  # known before the rows are made, so that the code over buckets is short
    line = lambda x: F.col("y0") + slope * (x - F.col("x0"))
    left, right = line(F.col("bx") * size), line((F.col("bx") + 1) * size)
    ya, yb = F.greatest(low_y, F.least(left, right) - reach), F.least(high_y, F.greatest(left, right) + reach)
    rows = rows.withColumns({"ya": F.coalesce(F.when(slope.isNotNull(), ya), low_y), "yb": F.coalesce(F.when(slope.isNotNull(), yb), high_y)})
    return rows.filter("ya <= yb").withColumn("by", F.explode(span(F.col("ya"), F.col("yb")))).drop("ya", "yb", "slope", "reach").hint("merge")


def within_of_segments(points: DataFrame, segments: DataFrame, radius: float, key: str = "floor_id", strict: bool = True) -> DataFrame:
    """(point_id, seg_id, dist): segments of the same floor within the radius of a point."""
    p = points.select("point_id", key, "x", "y", _bucket("x", radius).alias("bx"), _bucket("y", radius).alias("by"))
    s = _segment_buckets(segments.select("seg_id", key, "x0", "y0", "x1", "y1"), radius, radius)
    dist = point_segment_distance("x", "y", "x0", "y0", "x1", "y1")
    out = p.join(s, [key, "bx", "by"]).select("point_id", "seg_id", dist.alias("dist"))
    return out.filter(F.col("dist") < radius if strict else F.col("dist") <= radius)


def _met_by_routes(points: DataFrame, segments: DataFrame, radius: float, size: float) -> DataFrame:
    """``points`` (floor_id, x, y, ...) with route_id and viewer_id, once for each route with a segment within the radius.

    A point lies in one bucket, and a route has one row per bucket with its segments there, so no pair has to be made
    distinct. A route's segments are brought together before they are dealt into buckets.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    long_ = F.col("len") > 0
    own = segments.select("route_id", "viewer_id", "floor_id", "x0", "y0", "x1", "y1").repartition("route_id").withColumn("len", F.sqrt(dx * dx + dy * dy))
    own = own.withColumns({"ux": F.when(long_, dx / F.col("len")).otherwise(1.0), "uy": F.when(long_, dy / F.col("len")).otherwise(0.0)})
    s = _segment_buckets(own, radius, size)
    keys, line = ["route_id", "floor_id", "bx", "by"], ["viewer_id", "x0", "y0", "ux", "uy", "len"]
    one = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in line]).filter("n = 1").drop("n")
    several = s.groupBy(*keys).agg(F.collect_list(F.struct(*line)).alias("lines")).filter(F.size("lines") > 1)
    p = points.withColumns({"bx": _bucket("x", size), "by": _bucket("y", size)})

    def near(c):
        """Along the segment's direction and across it; short, so that the join's generated code is compiled."""
        x, y = F.col("x") - c["x0"], F.col("y") - c["y0"]
        along, across = x * c["ux"] + y * c["uy"], x * c["uy"] - y * c["ux"]
        beyond = F.greatest(F.abs(along - c["len"] / 2) - c["len"] / 2, F.lit(0.0))
        return (F.abs(across) < radius) & (F.pow(across, F.lit(2.0)) + F.pow(beyond, F.lit(2.0)) < radius * radius)

    met = lambda rows: p.join(rows.hint("merge"), ["floor_id", "bx", "by"])
    first = met(one).filter(near({c: F.col(c) for c in line}))
    hit = F.filter("lines", near)
    rest = met(several).withColumn("viewer_id", F.get(hit, 0).viewer_id).withColumn("hits", F.size(hit)).filter("hits > 0")
    columns = ["route_id", "viewer_id", *points.columns]
    return first.select(columns).unionByName(rest.select(columns))


#: A bucket's width in radii, its shares, and how many tests (which stay in a core's cache) and pairs are made at once.
WIDE_BUCKET, SHARES, TESTS, AT_ONCE = 8, 2, 1 << 14, 1 << 17


def _pairs_of_bucket(radius: float):
    """A function that gives arrays (route ids, alert ids) of a bucket's places and segments; made here, so that Spark ships it by value."""

    def pairs(spots: list, rows: dict):
        """``spots`` (x, y, alert ids, submitters, whether these are known); ``rows`` are columns of segments in order of route.

        An alert belongs to a route, once, if a segment within the radius has no viewer (``free``) or one that is not the
        known submitter.
        """
        import numpy as np

        x0, y0, dx, dy = rows["x0"], rows["y0"], rows["x1"] - rows["x0"], rows["y1"] - rows["y0"]
        square = dx * dx + dy * dy
        square[square == 0] = np.inf  # a segment without length is its first point
        new = np.append(True, rows["route_id"][1:] != rows["route_id"][:-1])
        route, viewer, free = np.cumsum(new), rows["viewer_id"], rows["free"]
        mixed = bool((~new[1:] & ((viewer[1:] != viewer[:-1]) | (free[1:] != free[:-1]))).any())
        some = max(1, TESTS // len(x0))
        for begin in range(0, len(spots), some):
            part = spots[begin : begin + some]
            px, py = (np.array([spot[i] for spot in part])[:, None] for i in (0, 1))
            along = np.clip(((px - x0) * dx + (py - y0) * dy) / square, 0.0, 1.0)
            near = np.sqrt((px - (x0 + along * dx)) ** 2 + (py - (y0 + along * dy)) ** 2) < radius
            for (_, _, ids, by, known), hits in zip(part, near):
                at = np.flatnonzero(hits)
                if not len(at):
                    continue
                first = np.append(True, route[at[1:]] != route[at[:-1]])
                at = at if mixed else at[first]
                routes, step = rows["route_id"][at[first] if mixed else at], max(1, AT_ONCE // len(at))
                for low in range(0, len(ids), step):
                    alerts = ids[low : low + step]
                    seen = free[at][:, None] | (known[low : low + step] & (by[low : low + step] != viewer[at][:, None]))
                    if mixed:  # a route's segments have several viewers: one that may see the alert is enough
                        seen = np.logical_or.reduceat(seen, np.flatnonzero(first))
                    seen, found = seen.ravel(), (np.repeat(routes, len(alerts)), np.tile(alerts, len(routes)))  # in runs, which files keep short
                    yield found if seen.all() else (found[0][seen], found[1][seen])

    return pairs


def alerts_on_route(alerts: DataFrame, segments: DataFrame, radius: float = 0.04) -> DataFrame:
    """(route_id, alert_id): alerts near a route's segment on their floor, without the route owner's own.

    Alerts and segments are dealt by wide buckets, a segment to those that it crosses, and a bucket's routes among shares
    that hold all of its alerts. Spark sorts a share's rows, its alerts before its segments, and a task reads them as a
    stream: it holds the alerts by place and the segments of a batch. A point lies in one bucket and a route in one
    share, so no pair has to be made distinct; pairs are never shuffled, they leave the task as batches of the result.
    """
    size, place = WIDE_BUCKET * radius, ["floor_id", "bx", "by", "share"]
    schema = StructType([segments.schema["route_id"], alerts.schema["alert_id"]])
    empty = lambda df, *names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    points = alerts.filter("floor_id is not null and x is not null and y is not null").select(
        "floor_id", _bucket("x", size).alias("bx"), _bucket("y", size).alias("by"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"), *empty(segments, "route_id", "viewer_id"),
        F.col("x").alias("x0"), F.col("y").alias("y0"), F.lit(None).cast("double").alias("x1"), F.lit(None).cast("double").alias("y1"), "alert_id", "submitted_by", F.lit(False).alias("segment"),
    )
    lines = _segment_buckets(segments.filter("floor_id is not null").select("route_id", "viewer_id", "floor_id", "x0", "y0", "x1", "y1"), radius, size)
    lines = lines.select(
        "floor_id", "bx", "by", F.pmod(F.hash("route_id"), F.lit(SHARES)).alias("share"), "route_id", "viewer_id", "x0", "y0", "x1", "y1", *empty(alerts, "alert_id", "submitted_by"), F.lit(True).alias("segment")
    )

    pairs_of = _pairs_of_bucket(radius)

    def of(batches):
        import numpy as np
        import pyarrow.compute as pc

        def plain(column):
            """Values as an array; Python's own where some are null."""
            return np.array(column.to_pylist() + [None], dtype=object)[:-1] if column.null_count else column.to_numpy(zero_copy_only=False)

        def by_place(held):
            """(x, y, alert ids, submitters, known) of each place."""
            held = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            x, y = plain(held.column("x0")), plain(held.column("y0"))
            order = np.lexsort((y, x))
            x, y, ids, by, known = x[order], y[order], plain(held.column("alert_id"))[order], plain(held.column("submitted_by"))[order], plain(held.column("submitted_by").is_valid())[order]
            ends = [*(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), len(x)]
            return [(x[a], y[a], ids[a:b], by[a:b], known[a:b]) for a, b in zip([0, *ends], ends)]

        def pairs(spots, segments):
            rows = {c: plain(segments.column(c)) for c in ("route_id", "viewer_id", "x0", "y0", "x1", "y1")}
            return pairs_of(spots, rows | {"free": plain(segments.column("viewer_id").is_null())})

        def runs():
            """Pairs of all buckets; the segments of a batch's last route wait for the next batch."""
            now, held, spots, rest = None, [], None, None
            for batch in batches:
                kinds[:] = [batch.schema.field(c).type for c in schema.names]
                change = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
                for c in (*place, "segment"):
                    column = batch.column(c)
                    change |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
                ends = [*(np.flatnonzero(change) + 1).tolist(), batch.num_rows] if batch.num_rows else []
                for a, b in zip([0, *ends], ends):
                    run = batch.slice(a, b - a)
                    key = tuple(run.column(c)[0].as_py() for c in place)
                    if key != now:
                        if rest is not None:
                            yield from pairs(spots, rest)
                        now, held, spots, rest = key, [], None, None
                    if not run.column("segment")[0].as_py():
                        held.append(run)
                        continue
                    if not held:
                        continue
                    spots = spots or by_place(held)
                    rows = run if rest is None else pa.Table.from_batches([rest, run]).combine_chunks().to_batches()[0]
                    route = plain(rows.column("route_id"))
                    whole = np.flatnonzero(route[1:] != route[:-1])
                    upto = int(whole[-1]) + 1 if len(whole) else 0
                    rest = rows.slice(upto)
                    if upto:
                        yield from pairs(spots, rows.slice(0, upto))
            if rest is not None:
                yield from pairs(spots, rest)

        kinds, made, n = [], [], 0
        joined = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*made), kinds)], names=schema.names)
        for found in runs():
            made.append(found)
            n += len(found[0])
            if n >= AT_ONCE:
                yield joined()
                made, n = [], 0
        if n:
            yield joined()

    return points.unionByName(lines).repartition(*place).sortWithinPartitions(*place, "segment", "route_id").mapInArrow(of, schema)


def alert_counts_on_route(alerts: DataFrame, segments: DataFrame, radius: float = 0.04, code=None) -> DataFrame:
    """(route_id, n, code): how many alerts ``alerts_on_route`` finds for a route, and the sum of a number of theirs.

    Alerts at one place meet a route together, and the viewer's own ones there are taken off after, so the pairs of
    routes and alerts are never made. A route belongs to one viewer.
    """
    rows = alerts.select("submitted_by", "floor_id", "x", "y", (F.lit(0) if code is None else code).cast("long").alias("code"))
    known = F.col("submitted_by").isNotNull()
    spots = rows.groupBy("floor_id", "x", "y").agg(
        F.count(F.lit(1)).alias("every"), F.sum("code").alias("every_code"), F.count_if(known).alias("known"), F.coalesce(F.sum(F.when(known, F.col("code"))), F.lit(0)).alias("known_code")
    )
    size = 3 * radius
    free = F.col("viewer_id").isNull()
    found = _met_by_routes(spots, segments, radius, size)
    found = found.select("route_id", F.when(free, F.col("every")).otherwise(F.col("known")).alias("n"), F.when(free, F.col("every_code")).otherwise(F.col("known_code")).alias("code"))

    # a viewer's own alerts on the own routes: the same meeting within floor and viewer
    both = lambda viewer: F.struct(F.col("floor_id"), viewer.alias("viewer"))
    mine = rows.filter(known).withColumn("floor_id", both(F.col("submitted_by"))).drop("submitted_by")
    walked = segments.filter("viewer_id is not null").withColumn("floor_id", both(F.col("viewer_id").cast(rows.schema["submitted_by"].dataType)))
    own = _met_by_routes(mine, walked, radius, size).select("route_id", F.lit(-1).cast("long").alias("n"), (-F.col("code")).alias("code"))
    return found.unionByName(own).groupBy("route_id").agg(F.sum("n").alias("n"), F.sum("code").alias("code")).filter("n > 0")


def near_wall_filter(points: DataFrame, segments: DataFrame, radius: float = 5.0) -> DataFrame:
    near = within_of_segments(points, segments, radius, strict=False).select("point_id").distinct()
    return points.join(near, "point_id", "left_semi")


def lattice_edges(points: DataFrame, spacing: int = 30, key: str = "floor_id") -> DataFrame:
    """(src, dst, weight): links between sampled points one spacing apart along x or y."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((spacing, 0), (0, spacing))])
    moved = points.select(key, F.col("node_id").alias("src"), "x", "y", F.explode(steps).alias("o")).select(
        key, "src", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y")
    )
    return moved.join(points.select(key, "x", "y", F.col("node_id").alias("dst")), [key, "x", "y"]).select(
        "src", "dst", F.lit(float(spacing)).alias("weight")
    )


def best_detection(detections: DataFrame) -> DataFrame:
    """Highest-confidence row per label and floor, the smaller id on ties."""
    best = F.max_by(F.struct("det_id", "x", "y", "conf"), F.struct("conf", (-F.col("det_id")).alias("i"))).alias("b")
    return detections.groupBy("floor_id", "label").agg(best).select("floor_id", "label", "b.*")


def room_label_filter(detections: DataFrame, least: float = 0.15) -> DataFrame:
    """Rows whose label is a room number of its own floor, with enough confidence."""
    good = F.col("label").rlike(r"^\d\.\d{3,}[A-Za-z]?$") & F.startswith("label", F.col("floor_num").cast("string"))
    return detections.filter(good & (F.col("conf") >= least))


def transport_kind(text) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.rlike(r"^(stair|stairs|stairwell|stw|s\d+)$"), "stairwell").when(
        t.rlike(r"^(elev|elevator|elevat|elv|e\d+|lift)$"), "elevator"
    )


def merge_detections(first: DataFrame, second: DataFrame, radius: float = 0.015) -> DataFrame:
    """Both sources (det_id, floor_id, label, x, y, conf); rows of the second near a row or with a label of the first go.

    Rows of the second that are near each other keep the earliest by confidence, then id.
    """
    close = near_pairs(second, first, ["floor_id"], radius).select(F.col("l.det_id").alias("det_id"))
    left = second.join(close.distinct(), "det_id", "left_anti").join(first.select("floor_id", "label").distinct(), ["floor_id", "label"], "left_anti")
    lone = seeded_radius_groups(left.withColumn("rank", -F.col("conf")), ["floor_id"], ["rank"], radius, True, "det_id")
    return first.unionByName(lone.filter("det_id = seed_id").select(first.columns))


def room_nodes(detections: DataFrame, radius: float = 0.015) -> DataFrame:
    """Room and transport nodes (det_id, floor_id, label, x, y, type) from raw detections."""
    from wayfarer.functions.scalars import clean_detected_text

    cleaned = detections.withColumn("label", clean_detected_text("raw_text"))
    rooms = best_detection(room_label_filter(cleaned))
    rooms = seeded_radius_groups(rooms.withColumn("rank", -F.col("conf")), ["floor_id"], ["rank"], radius, True, "det_id")
    rooms = rooms.filter("det_id = seed_id").select("det_id", "floor_id", "label", "x", "y", F.lit("room").alias("type"))
    lifts = detections.withColumn("type", transport_kind("raw_text")).filter("type is not null")
    lifts = seeded_radius_groups(lifts, ["floor_id", "type"], ["det_id"], radius, True, "det_id").filter("det_id = seed_id")
    lifts = lifts.select("det_id", "floor_id", F.col("raw_text").alias("label"), "x", "y", "type")
    close = near_pairs(lifts, rooms, ["floor_id"], radius).select(F.col("l.det_id").alias("det_id")).distinct()
    return rooms.unionByName(lifts.join(close, "det_id", "left_anti"))


def bounding_box(points: DataFrame, key: str) -> DataFrame:
    return points.groupBy(key).agg(
        F.max("lat").alias("north"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.min("lon").alias("west")
    )


def door_arc_counts(arcs: DataFrame, radius: float = 5.0) -> DataFrame:
    """(center_id, arcs, is_door): arcs (arc_id, floor_id, x, y centre) around one centre; up to two make a door."""
    groups = seeded_radius_groups(arcs, ["floor_id"], [], radius, True, "arc_id")
    return groups.groupBy(F.col("seed_id").alias("center_id")).agg(F.count(F.lit(1)).alias("arcs")).withColumn("is_door", F.col("arcs") <= 2)


#: A door's radius in points, and the share of it by which its leaf may miss.
DOOR_RADIUS, DOOR_SLACK = (4, 70), 0.25


def door_signature(items: DataFrame, segments: DataFrame, radius: float = 5.0) -> DataFrame:
    """(path_id, cx, cy, r) of vector paths that are doors: one quarter arc, a leaf line to its end, near a wall.

    ``items`` (path_id, floor_id, kind, points array of (x, y)).
    """
    from wayfarer.functions.scalars import quarter_arc

    at = lambda i: F.element_at("points", i)
    arcs = items.filter("kind = 'curve' and size(points) = 4").withColumn("arc", quarter_arc(at(1), at(2), at(3), at(4))).filter("arc is not null")
    one = arcs.groupBy("path_id", "floor_id").agg(F.count(F.lit(1)).alias("n"), F.first("arc").alias("arc"), F.first("points").alias("points"))
    one = one.filter((F.col("n") == 1) & F.col("arc.r").between(*DOOR_RADIUS))
    lines = items.filter("kind = 'line' and size(points) = 2").select("path_id", at(1).alias("p"), at(2).alias("q"))
    gap = lambda a, bx, by: F.hypot(a.x - bx, a.y - by)
    c, r, first, last = F.col("arc"), F.col("arc.r"), F.element_at("points", 1), F.element_at("points", 4)
    ends = lambda a, b: (gap(a, c.cx, c.cy) <= DOOR_SLACK * r) & F.least(gap(b, first.x, first.y), gap(b, last.x, last.y)).between(0, DOOR_SLACK * r)
    length = F.hypot(F.col("p").x - F.col("q").x, F.col("p").y - F.col("q").y)
    leaf = length.between((1 - DOOR_SLACK) * r, (1 + DOOR_SLACK) * r) & (ends(F.col("p"), F.col("q")) | ends(F.col("q"), F.col("p")))
    doors = one.join(lines, "path_id").filter(leaf).select("path_id", "floor_id", "arc").distinct()
    points = doors.select(F.col("path_id").alias("point_id"), "floor_id", F.col("arc.cx").alias("x"), F.col("arc.cy").alias("y"), F.col("arc.r").alias("r"))
    return near_wall_filter(points, segments, radius).select(F.col("point_id").alias("path_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), "r")


def wall_segments(segments: DataFrame, width: float, height: float, least: float = 5.0) -> DataFrame:
    """Segments long enough to be walls; axis-aligned ones over 70 % of the page are annotation lines."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    annotation = ((dy < 2) & (dx > 0.7 * width)) | ((dx < 2) & (dy > 0.7 * height))
    return segments.filter((F.hypot(dx, dy) >= least) & ~annotation)


def annotation_outliers(segments: DataFrame) -> DataFrame:
    """Axis-aligned segments at least max(150, 4 x median length of the floor) long."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    sized = segments.withColumn("len", F.hypot(dx, dy))
    middle = sized.groupBy("floor_id").agg(F.median("len").alias("mid"))
    return sized.join(middle, "floor_id").filter(((dx < 2) | (dy < 2)) & (F.col("len") >= F.greatest(F.lit(150.0), 4 * F.col("mid")))).drop("mid")


def convex_hulls(points: DataFrame, key: str = "floor_id") -> DataFrame:
    """(key, hull array of (x, y)): hull of each floor's points; only the extremes of each column of x travel."""
    edge = points.groupBy(key, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    kind = points.schema[key].dataType.simpleString()

    def hull(pdf):
        import pandas as pd

        pts, out = sorted({*zip(pdf["x"], pdf["lo"]), *zip(pdf["x"], pdf["hi"])}), []
        for side in (pts, pts[::-1]):
            chain = []
            for p in side:
                while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) + 1e-12:  # points on a side, up to rounding, are no corners
                    chain.pop()
                chain.append(p)
            out += chain[:-1] if len(chain) > 1 else chain
        corners = [{"x": float(a), "y": float(b)} for a, b in dict.fromkeys(out)]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "hull": [corners]})

    return edge.groupBy(key).applyInPandas(hull, f"{key} {kind}, hull array<struct<x: double, y: double>>")
