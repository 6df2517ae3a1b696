"""Routes: distances along them, positions on them, trimming, segments and transports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.scalars import haversine_km, segment_fraction

#: Metres across a full page.
PAGE_W, PAGE_H = 100.0, 80.0
LOOKAHEAD = 3.0


def _route(order: str = "seq"):
    return Window.partitionBy("route_id").orderBy(order)


def cumulative_distance(waypoints: DataFrame) -> DataFrame:
    """``cum``: metres from the start; a floor change still counts its planar step."""
    w = _route()
    step = F.hypot((F.col("x") - F.lag("x").over(w)) * PAGE_W, (F.col("y") - F.lag("y").over(w)) * PAGE_H)
    return waypoints.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn(
        "cum", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("step")


def drop_repeat_points(points: DataFrame) -> DataFrame:
    """Without points equal to the one before; a route left with fewer than two has none."""
    w = _route()
    same = (F.lag("lat").over(w) == F.col("lat")) & (F.lag("lon").over(w) == F.col("lon"))
    kept = points.withColumn("same", F.coalesce(same, F.lit(False))).filter("not same").drop("same")
    return kept.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("route_id"))).filter("n >= 2").drop("n")


def _brackets(path: DataFrame) -> DataFrame:
    """Consecutive points of a measured path as segments [d0, d1), the last one open."""
    w = _route()
    nxt = lambda c: F.lead(c).over(w)
    seg = path.select(
        "route_id", "seq", "floor_id", "x", "y", F.col("cum").alias("d0"), nxt("cum").alias("d1"), nxt("x").alias("x1"), nxt("y").alias("y1"), nxt("floor_id").alias("floor1")
    ).filter("d1 is not null")
    last = F.lead("seq").over(w).isNull()
    total = F.max("d1").over(Window.partitionBy("route_id"))
    return seg.withColumn("last", last).withColumn("total", total)


def position_at_distance(path: DataFrame, distances: DataFrame) -> DataFrame:
    """(query_id, route_id, x, y, floor_id) at ``dist`` metres; beyond the end the end; the floor changes half-way."""
    seg = _brackets(path)
    d = distances.join(seg, "route_id").withColumn("d", F.least("dist", "total"))
    hit = d.filter((F.col("d") >= F.col("d0")) & ((F.col("d") < F.col("d1")) | F.col("last")))
    length = F.col("d1") - F.col("d0")
    t = F.when(length < 0.001, F.lit(1.0)).otherwise((F.col("d") - F.col("d0")) / length)
    return hit.withColumn("t", t).select(
        "query_id",
        "route_id",
        (F.col("x") + (F.col("x1") - F.col("x")) * F.col("t")).alias("x"),
        (F.col("y") + (F.col("y1") - F.col("y")) * F.col("t")).alias("y"),
        F.when(F.col("t") < 0.5, F.col("floor_id")).otherwise(F.col("floor1")).alias("floor_id"),
    )


def path_direction(path: DataFrame, distances: DataFrame, ahead: float = LOOKAHEAD) -> DataFrame:
    """(query_id, degrees) from a distance to some metres ahead, 0 to the right, 90 down; null where nothing moves."""
    a = position_at_distance(path, distances).select("query_id", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = position_at_distance(path, distances.withColumn("dist", F.col("dist") + ahead)).select("query_id", "x", "y")
    dx, dy = (F.col("x") - F.col("ax")) * PAGE_W, (F.col("y") - F.col("ay")) * PAGE_H
    moved = (F.abs(dx) >= 1e-6) | (F.abs(dy) >= 1e-6)
    return a.join(b, "query_id").select("query_id", F.when(moved, F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))).alias("degrees"))


def polyline_length(points: DataFrame) -> DataFrame:
    w = _route()
    step = haversine_km("lat", "lon", F.lead("lat").over(w), F.lead("lon").over(w))
    return points.withColumn("km", step).groupBy("route_id").agg(F.coalesce(F.sum("km"), F.lit(0.0)).alias("km"))


def _geo_segments(routes: DataFrame) -> DataFrame:
    """Segments of each route; a route of one point is a segment of no length."""
    w = _route()
    n = F.count(F.lit(1)).over(Window.partitionBy("route_id"))
    seg = routes.select(
        "route_id", "seq", "lat", "lon", F.lead("lat").over(w).alias("lat1"), F.lead("lon").over(w).alias("lon1"), n.alias("n")
    )
    seg = seg.filter("lat1 is not null or n = 1")
    return seg.withColumns({"lat1": F.coalesce("lat1", "lat"), "lon1": F.coalesce("lon1", "lon")})


def _projected(points: DataFrame, routes: DataFrame) -> DataFrame:
    """Points (point_id, route_id, plat, plon) with their projection on each segment of their route, in metres."""
    s = points.join(_geo_segments(routes), "route_id")
    t = segment_fraction("plon", "plat", "lon", "lat", "lon1", "lat1")
    lat, lon = F.col("lat") + t * (F.col("lat1") - F.col("lat")), F.col("lon") + t * (F.col("lon1") - F.col("lon"))
    return s.withColumns({"qlat": lat, "qlon": lon}).withColumn("m", haversine_km("plat", "plon", "qlat", "qlon") * 1000)


def point_to_polyline(points: DataFrame, routes: DataFrame) -> DataFrame:
    """(point_id, metres) to the route; infinity when it has no points."""
    got = _projected(points, routes).groupBy("point_id").agg(F.min("m").alias("metres"))
    return points.select("point_id").join(got, "point_id", "left").withColumn("metres", F.coalesce("metres", F.lit(float("inf"))))


def trim_route(points: DataFrame, routes: DataFrame) -> DataFrame:
    """(point_id, place, lat, lon): the projection on the nearest segment, the first on ties, and the rest of the route."""
    best = _projected(points, routes).groupBy("point_id", "route_id").agg(F.min(F.struct("m", "seq", "qlat", "qlon")).alias("b"))
    start = best.select("point_id", F.lit(0).cast("long").alias("place"), F.col("b.qlat").alias("lat"), F.col("b.qlon").alias("lon"))
    rest = best.join(routes, "route_id").filter("seq > b.seq").select(
        "point_id", (F.col("seq") - F.col("b.seq")).cast("long").alias("place"), "lat", "lon"
    )
    return start.unionByName(rest)


def destination_connector(routes: DataFrame, destinations: DataFrame, gap: float = 0.000009) -> DataFrame:
    """(route_id, lat, lon, dlat, dlon): line from the last route point to a destination that is not there yet."""
    last = routes.groupBy("route_id").agg(F.max_by(F.struct("lat", "lon"), "seq").alias("e")).select("route_id", "e.lat", "e.lon")
    out = last.join(destinations, "route_id")
    return out.filter(F.hypot(F.col("lat") - F.col("dlat"), F.col("lon") - F.col("dlon")) >= gap)


def edge_lookup(pairs: DataFrame, edges: DataFrame, with_path: bool = False) -> DataFrame:
    """Edges of consecutive path nodes (src, dst) in either direction; a reversed edge reverses its path."""
    more = [F.col("path")] if with_path else []
    back = [F.reverse("path").alias("path")] if with_path else []
    both = edges.select("src", "dst", "weight", "inter_floor", *more).union(edges.select(F.col("dst"), F.col("src"), "weight", "inter_floor", *back))
    first = both.groupBy("src", "dst").agg(F.min(F.struct("weight", "inter_floor", *(["path"] if with_path else []))).alias("e"))
    return pairs.join(first, ["src", "dst"]).select(*pairs.columns, "e.*")


def route_segments(path: DataFrame, nodes: DataFrame, edges: DataFrame, floors: DataFrame) -> DataFrame:
    """(route_id, part, floor_id, points, instruction): a node path (route_id, seq, node_id) in steps.

    A stretch on one floor is a walk; a run of inter-floor edges is one ride to its last floor.
    """
    w = _route()
    named = path.join(nodes.select("node_id", "floor_id", "x", "y", "label", F.col("type").alias("node_type")), "node_id")
    hops = named.withColumns({"next_id": F.lead("node_id").over(w)})
    looked = edge_lookup(
        hops.filter("next_id is not null").select("route_id", "seq", F.col("node_id").alias("src"), F.col("next_id").alias("dst")), edges
    ).select("route_id", "seq", "inter_floor")
    h = hops.join(looked, ["route_id", "seq"], "left").withColumn("ride", F.coalesce("inter_floor", F.lit(False)))
    # a node belongs to the walk that ends or starts at it; nodes inside a run of rides belong to none
    before = F.coalesce(F.lag("ride").over(w), F.lit(False))
    h = h.withColumn("from_ride", before).withColumn("walk", F.sum(F.when(before, 1).otherwise(0)).over(w))
    inside = F.col("from_ride") & F.col("ride")
    walk_no = F.sum(F.when(F.col("from_ride") & ~F.col("ride"), 1).otherwise(0)).over(w)
    h = h.withColumn("inside", inside).withColumn("no", walk_no)
    walks = h.filter("not inside").groupBy("route_id", "no").agg(
        F.min_by("floor_id", "seq").alias("floor_id"),
        F.count(F.lit(1)).alias("points"),
        F.max_by(F.struct("ride", "node_type", "label"), "seq").alias("end"),
        F.max("seq").alias("last"),
    )
    kind = F.when(F.col("end.node_type") == "elevator", "elevator").otherwise("stairs")
    target = Window.partitionBy("route_id").orderBy("no")
    lands = walks.withColumn("next_floor", F.lead("floor_id").over(target)).withColumn("kind", kind)
    end_ride = h.filter("ride").groupBy("route_id").agg(F.max("seq").alias("last_ride"))
    tail = h.groupBy("route_id").agg(F.max_by("floor_id", "seq").alias("end_floor"))
    lands = lands.join(tail, "route_id").join(end_ride, "route_id", "left")
    names = floors.select(F.col("floor_id").alias("next_floor"), F.col("name").alias("next_name"))
    lands = lands.withColumn("next_floor", F.coalesce("next_floor", "end_floor")).join(names, "next_floor", "left")
    say = F.when(F.col("end.ride"), F.concat(F.lit("Walk to the "), "kind")).otherwise(
        F.concat(F.lit("Walk to room "), F.coalesce(F.nullif("end.label", F.lit("")), F.lit("destination")))
    )
    walk = lands.select("route_id", (2 * F.col("no")).alias("part"), "floor_id", "points", say.alias("instruction"))
    ride = lands.filter("end.ride").select(
        "route_id",
        (2 * F.col("no") + 1).alias("part"),
        "floor_id",
        F.lit(0).cast("long").alias("points"),
        F.concat(F.lit("Take the "), "kind", F.lit(" to "), "next_name").alias("instruction"),
    )
    return walk.unionByName(ride)


def segments_on_floor(segments: DataFrame) -> DataFrame:
    """(route_id, floor_id): floors that carry a part of a route, ``parts`` of them with waypoints."""
    return segments.groupBy("route_id", "floor_id").agg(F.count_if(F.col("points") > 0).alias("parts")).filter("parts > 0")


def collinear_simplify(paths: DataFrame) -> DataFrame:
    """Without interior points on a straight run of an integer lattice path."""
    w = _route()
    px, py, nx, ny = F.lag("x").over(w), F.lag("y").over(w), F.lead("x").over(w), F.lead("y").over(w)
    cross = (F.col("x") - px) * (ny - F.col("y")) - (F.col("y") - py) * (nx - F.col("x"))
    return paths.withColumn("cross", cross).filter("cross is null or cross <> 0").drop("cross")


#: Links of a transport to rooms.
MAX_ROOMS, MAX_DIST, BRIDGE = 4, 0.22, 1.5


def _link_weight() -> Column:
    return F.bround(200 + F.col("d") * 300, 1)


def _transport_rooms(transports: DataFrame, nodes: DataFrame, degrees: DataFrame, radius: float) -> DataFrame:
    """Rooms on a transport's floor within the radius, with their distance; ``any``: whether some room of the floor has edges."""
    from wayfarer.operators.spatial import near_pairs

    rooms = nodes.filter("type = 'room'").join(degrees.select("node_id", "degree"), "node_id", "left")
    rooms = rooms.select("node_id", "floor_id", "x", "y", (F.coalesce("degree", F.lit(0)) > 0).alias("linked"))
    any_linked = rooms.groupBy("floor_id").agg(F.max("linked").alias("any"))
    near = near_pairs(transports.select("transport_id", "floor_id", "x", "y"), rooms, ["floor_id"], radius, strict=False)
    near = near.select("l.transport_id", "l.floor_id", "r.node_id", "r.linked", F.col("dist").alias("d"))
    return near.join(any_linked, "floor_id")


def transport_room_links(transports: DataFrame, nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """(transport_id, floor_id, node_id, weight): up to four nearest rooms within 0.22; where some rooms have edges, only those."""
    order = Window.partitionBy("transport_id", "floor_id").orderBy("d", "node_id")
    near = _transport_rooms(transports, nodes, degrees, MAX_DIST).filter("linked or not any").withColumn("rn", F.row_number().over(order))
    return near.filter(F.col("rn") <= MAX_ROOMS).select("transport_id", "floor_id", "node_id", _link_weight().alias("weight"))


def transport_bridge_links(transports: DataFrame, nodes: DataFrame, degrees: DataFrame, components: DataFrame, links: DataFrame) -> DataFrame:
    """The nearest room with edges of each component of two or more that no link reaches yet, within 0.33."""
    sized = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("component")
    reached = links.join(components, "node_id").select("transport_id", "component").distinct()
    near = _transport_rooms(transports, nodes, degrees, MAX_DIST * BRIDGE).filter("linked")
    near = near.join(components.join(sized, "component"), "node_id")
    best = F.min(F.struct("d", "node_id")).alias("b")
    open_ = near.join(reached, ["transport_id", "component"], "left_anti").groupBy("transport_id", "floor_id", "component").agg(best)
    return open_.select("transport_id", "floor_id", "component", "b.node_id", "b.d").select(
        "transport_id", "floor_id", "component", "node_id", _link_weight().alias("weight")
    )


def transport_interfloor_edges(transports: DataFrame) -> DataFrame:
    """(transport_id, floor_a, floor_b, weight) between consecutive floors of a transport, floors in text order."""
    w = Window.partitionBy("transport_id").orderBy("floor_id")
    weight = F.when(F.col("kind") == "elevator", 5.0).otherwise(500.0)
    return transports.select("transport_id", F.col("floor_id").alias("floor_a"), F.lead("floor_id").over(w).alias("floor_b"), weight.alias("weight")).filter(
        "floor_b is not null"
    )
