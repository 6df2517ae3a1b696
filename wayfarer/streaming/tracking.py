"""Following a user along a route: dead reckoning on a floor path, the remaining walking route, thinned fixes.

Each machine holds one user's route in its state, so a route must fit into memory; routes and
samples come in one table (or stream) ordered by time, a route row replacing what was before.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.operators.routes import LOOKAHEAD, PAGE_H, PAGE_W
from wayfarer.streaming.device import ARRIVED_M, BACK_DEG, CALIBRATION, FORWARD_DEG, REROUTE_M, STEP_M, stateful

#: Metres of a mean earth radius, miles in a kilometre, miles walked in an hour.
EARTH_M, MILES_PER_KM, WALK_MPH = 6_371_000.0, 0.621371, 3.1

PATH_ROWS = "user_id long, event_id long, ts timestamp, heading double, xs array<double>, ys array<double>, floors array<string>"
ROUTE_ROWS = "user_id long, fix_id long, ts timestamp, lat double, lon double, lats array<double>, lons array<double>, dlat double, dlon double"


def _at(path, dist: float):
    """x, y, floor at a distance on (cum, xs, ys, floors); the floor changes half-way."""
    cum, xs, ys, floors = path
    d = min(max(dist, 0.0), cum[-1])
    lo = min(max(bisect_right(cum, d) - 1, 0), len(cum) - 2)
    length = cum[lo + 1] - cum[lo]
    t = 1.0 if length < 0.001 else (d - cum[lo]) / length
    return xs[lo] + (xs[lo + 1] - xs[lo]) * t, ys[lo] + (ys[lo + 1] - ys[lo]) * t, floors[lo if t < 0.5 else lo + 1]


def _direction(path, dist: float):
    """Degrees from a distance to some metres ahead, 0 to the right, 90 down; None where nothing moves."""
    (ax, ay, _), (bx, by, _) = _at(path, dist), _at(path, dist + LOOKAHEAD)
    dx, dy = (bx - ax) * PAGE_W, (by - ay) * PAGE_H
    return None if abs(dx) < 1e-6 and abs(dy) < 1e-6 else math.degrees(math.atan2(dy, dx)) % 360


def _apart(a: float, b: float) -> float:
    return abs((math.fmod(a - b, 360) + 540) % 360 - 180)


def _missing(v) -> bool:
    return v is None or (isinstance(v, float) and math.isnan(v))


def _follow(state, pdf):
    cum, xs, ys, floors, n, total, offset, d = state
    out = []
    for user, event, heading, px, py, pf in pdf[["user_id", "event_id", "heading", "xs", "ys", "floors"]].itertuples(index=False):
        if px is not None and not isinstance(px, float):
            xs, ys, floors = [float(v) for v in px], [float(v) for v in py], [str(v) for v in pf]
            cum = [0.0]
            for i in range(1, len(xs)):
                cum.append(cum[-1] + math.hypot((xs[i] - xs[i - 1]) * PAGE_W, (ys[i] - ys[i - 1]) * PAGE_H))
            n, total, offset, d = 0, 0.0, float("nan"), 0.0
            continue
        if len(cum) < 2:
            continue  # no route to track yet
        path = (cum, xs, ys, floors)
        ahead, move = _direction(path, d), 1
        known = ahead is not None and not _missing(heading)
        if math.isnan(offset):
            total += (heading - ahead) % 360 if known else 0.0
            n, name = n + 1, "calibrating"
            if n >= CALIBRATION:
                offset = total / n
        elif known:
            way = (heading - offset) % 360
            move = -1 if _apart(way, (ahead + 180) % 360) <= BACK_DEG else 1 if _apart(way, ahead) <= FORWARD_DEG else 0
            name = {1: "forward", 0: "sideways", -1: "backward"}[move]
        else:
            name = "forward"
        d = min(max(d + move * STEP_M, 0.0), cum[-1])
        out.append((user, event, d, name, *_at(path, d)))
    return (list(cum), list(xs), list(ys), list(floors), n, total, offset, d), out


def path_reckoning(rows: DataFrame) -> DataFrame:
    """(user_id, event_id, dist, move, x, y, floor_id) of each step on its user's path.

    ``rows`` has ``PATH_ROWS``: a row with ``xs, ys, floors`` gives the path and starts calibration; any
    other is a step with its heading. Eight steps give the mean of heading against path; a step
    then goes 0.75 m back within 40 degrees of the reverse, forward within 90 degrees, else nowhere.
    The direction is that from the place reached to 3 m ahead. Steps before any path give no row.
    """
    start = ([], [], [], [], 0, 0.0, float("nan"), 0.0)
    return stateful(
        rows, _follow, start,
        "cum array<double>, xs array<double>, ys array<double>, floors array<string>, n int, total double, offset double, d double",
        "user_id long, event_id long, dist double, move string, x double, y double, floor_id string",
    )


def metres(lat0: float, lon0: float, lat1: float, lon1: float) -> float:
    a = math.sin(math.radians(lat1 - lat0) / 2) ** 2
    a += math.cos(math.radians(lat0)) * math.cos(math.radians(lat1)) * math.sin(math.radians(lon1 - lon0) / 2) ** 2
    return 2 * EARTH_M * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def trimmed(lat: float, lon: float, lats: list[float], lons: list[float]):
    """The route from the projection on its nearest segment (the first on ties) on, and the metres to it."""
    best = None
    for i in range(len(lats) - 1):
        dx, dy = lons[i + 1] - lons[i], lats[i + 1] - lats[i]
        square = dx * dx + dy * dy
        t = min(1.0, max(0.0, ((lon - lons[i]) * dx + (lat - lats[i]) * dy) / square)) if square else 0.0
        qlat, qlon = lats[i] + t * dy, lons[i] + t * dx
        m = metres(lat, lon, qlat, qlon)
        if best is None or m < best[0]:
            best = (m, i, qlat, qlon)
    m, i, qlat, qlon = best
    return [qlat, *lats[i + 1 :]], [qlon, *lons[i + 1 :]], m


def _walk(state, pdf):
    lats, lons, dlat, dlon, waiting, done, miles = state
    out = []
    names = ["user_id", "fix_id", "lat", "lon", "lats", "lons", "dlat", "dlon"]
    for user, fix, lat, lon, new_lats, new_lons, to_lat, to_lon in pdf[names].itertuples(index=False):
        if new_lats is not None and not isinstance(new_lats, float):
            lats, lons, dlat, dlon = [float(v) for v in new_lats], [float(v) for v in new_lons], to_lat, to_lon
            waiting, done, miles = False, False, _miles(lats, lons)
            continue
        if done or math.isnan(dlat):
            continue  # the watch has ended, or has not begun
        if metres(lat, lon, dlat, dlon) < ARRIVED_M:
            done = True
            out.append((user, fix, True, False, None, None))
            continue
        asked = False
        if len(lats) >= 2 and not waiting:
            lats, lons, off = trimmed(lat, lon, lats, lons)
            miles = _miles(lats, lons)
            asked = waiting = off > REROUTE_M
        out.append((user, fix, False, asked, miles, max(1, math.floor(miles / WALK_MPH * 60 + 0.5))))
    return (list(lats), list(lons), dlat, dlon, waiting, done, miles), out


def _miles(lats, lons) -> float:
    return sum(metres(*p) for p in zip(lats, lons, lats[1:], lons[1:])) / 1000 * MILES_PER_KM


def route_tracking(rows: DataFrame) -> DataFrame:
    """(user_id, fix_id, arrived, reroute, miles, minutes) of each fix on its user's remaining route.

    ``rows`` has ``ROUTE_ROWS``: a row with ``lats, lons`` is a (new) route with its destination; any other
    is a fix. A fix within 25 m of the destination ends the watch. Any other trims the route to its
    projection; more than 30 m off the rest it asks for a new route, and until that comes the rest
    stays as it is. Fixes before a route or after arrival give no row.
    """
    start = ([], [], float("nan"), float("nan"), False, False, 0.0)
    return stateful(
        rows, _walk, start,
        "lats array<double>, lons array<double>, dlat double, dlon double, waiting boolean, done boolean, miles double",
        "user_id long, fix_id long, arrived boolean, reroute boolean, miles double, minutes int",
    )


def _thin(least_m: float, least_ms: int):
    def run(state, pdf):
        lat0, lon0, at = state
        out = []
        for user, fix, ts, lat, lon in pdf[["user_id", "fix_id", "ts", "lat", "lon"]].itertuples(index=False):
            now = int(pd.Timestamp(ts).value // 1_000_000)
            if math.isnan(lat0) or (now - at >= least_ms and metres(lat0, lon0, lat, lon) >= least_m):
                lat0, lon0, at = lat, lon, now
                out.append((user, fix, lat, lon))
        return (lat0, lon0, at), out

    return run


def thinned_fixes(fixes: DataFrame, least_m: float = 5.0, least_ms: int = 3000) -> DataFrame:
    """(user_id, fix_id, lat, lon): fixes that are both far enough and late enough after the last one kept.

    Walking asks for 5 m and 3 s, a preview for 30 m and 10 s.
    """
    start = (float("nan"), float("nan"), 0)
    return stateful(fixes, _thin(least_m, least_ms), start, "lat double, lon double, at long", "user_id long, fix_id long, lat double, lon double")


def fix_stream(spark: SparkSession, path: str, delay: str = "1 minute", per_trigger: int | None = None) -> DataFrame:
    """A file stream of location fixes with an event-time watermark."""
    reader = spark.readStream.schema("user_id long, fix_id long, ts timestamp, lat double, lon double")
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader
    return reader.json(path).withWatermark("ts", delay)


def path_rows(waypoints: DataFrame, started: DataFrame) -> DataFrame:
    """``PATH_ROWS`` of paths (route_id, seq, floor_id, x, y) from ``started`` (route_id, user_id, ts)."""
    lists = waypoints.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y", "floor_id"))).alias("p"))
    return started.join(lists, "route_id").select(
        "user_id", F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(None).cast("double").alias("heading"),
        F.col("p.x").alias("xs"), F.col("p.y").alias("ys"), F.col("p.floor_id").alias("floors"),
    )


def step_rows(steps: DataFrame) -> DataFrame:
    """``PATH_ROWS`` of steps (user_id, event_id, ts, heading)."""
    none = F.lit(None)
    return steps.select(
        "user_id", "event_id", "ts", "heading", none.cast("array<double>").alias("xs"), none.cast("array<double>").alias("ys"), none.cast("array<string>").alias("floors")
    )


def route_rows(points: DataFrame, started: DataFrame) -> DataFrame:
    """``ROUTE_ROWS`` of routes (route_id, seq, lat, lon) from ``started`` (route_id, user_id, ts, dlat, dlon)."""
    lists = points.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("seq", "lat", "lon"))).alias("p"))
    none = F.lit(None).cast("double")
    return started.join(lists, "route_id").select(
        "user_id", F.lit(-1).cast("long").alias("fix_id"), "ts", none.alias("lat"), none.alias("lon"),
        F.col("p.lat").alias("lats"), F.col("p.lon").alias("lons"), "dlat", "dlon",
    )


def fix_rows(fixes: DataFrame) -> DataFrame:
    """``ROUTE_ROWS`` of fixes (user_id, fix_id, ts, lat, lon)."""
    none = F.lit(None)
    return fixes.select(
        "user_id", "fix_id", "ts", "lat", "lon", none.cast("array<double>").alias("lats"), none.cast("array<double>").alias("lons"),
        none.cast("double").alias("dlat"), none.cast("double").alias("dlon"),
    )
