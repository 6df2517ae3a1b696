"""Streams of device samples, votes, alerts and routes, keyed by user, alert or floor.

Each state machine is a plain function over one key's ordered rows. A batch streams sorted rows
through it; a stream lets rows wait for the watermark (``ordered``) and then runs the same function.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.scalars import walk_minutes
from wayfarer.operators import alerts as al
from wayfarer.operators import routes as ro
from wayfarer.operators import spatial as sp
from wayfarer.streaming.ordered import Machine, ordered_stream

STEP_G, STEP_GAP_MS = 1.18, 280
ALPHA = 0.5
CALIBRATION, STEP_M, BACK_DEG, FORWARD_DEG = 8, 0.75, 40.0, 90.0
#: Sums of directions shorter than this are rounding errors and point nowhere.
NOTHING = 1e-9
ARRIVED_M, REROUTE_M, PREVIEW_M = 25.0, 30.0, 100.0

#: Marks a column with a watermark.
WATERMARK = "spark.watermarkDelayMs"
#: How long the state of a quiet key is kept.
DAY_MS = 86_400_000


def stateful(rows: DataFrame, machine: Machine, start: tuple, state_schema: str, out_schema: str, key: str = "user_id", ts: str = "ts", lifetime_ms: int = DAY_MS) -> DataFrame:
    """Run a machine per key: over all rows in time order in a batch, with kept state in a stream.

    With a watermark on ``ts`` the rows of a stream wait for it, and a key without rows for its lifetime
    is forgotten; without one, each trigger's rows are taken as they come.
    """
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(out_schema).fieldNames() if hasattr(StructType, "fromDDL") else [c.strip().split(" ")[0] for c in out_schema.split(",")]
    frame = lambda out: pd.DataFrame(out, columns=names)

    if not rows.isStreaming:

        # sorted by Spark and read as a stream: no user's rows are held together
        def batch(pdfs):
            held, now = None, None
            for pdf in pdfs:
                out = []
                for k, part in pdf.groupby(key, sort=False, dropna=False):
                    same = now is not None and (k == held or (pd.isna(k) and pd.isna(held)))
                    held, (now, found) = k, machine(now if same else start, part)
                    out += found
                yield frame(out)

        ids = [c for c in rows.columns if c.endswith("_id") and c != key]
        return rows.repartition(key).sortWithinPartitions(key, ts, *ids).mapInPandas(batch, out_schema)

    if WATERMARK in rows.schema[ts].metadata:
        return ordered_stream(rows, machine, start, state_schema, out_schema, key, ts, lifetime_ms)

    # without a watermark nothing tells when a time is complete: each trigger's rows go in order, later ones follow
    def stream(_, pdfs, state):
        pdf = pd.concat(list(pdfs)).sort_values(ts, kind="stable")  # the batches of one trigger have no order
        now, out = machine(tuple(state.get) if state.exists else start, pdf)
        state.update(now)
        yield frame(out)

    return rows.groupBy(key).applyInPandasWithState(stream, out_schema, state_schema, "append", "NoTimeout")


def _steps(state, pdf):
    above, last = state
    out = []
    for user, event, ts, ax, ay, az in pdf[["user_id", "event_id", "ts", "ax", "ay", "az"]].itertuples(index=False):
        now = int(pd.Timestamp(ts).value // 1_000_000)
        high = math.sqrt(ax * ax + ay * ay + az * az) > STEP_G
        if high and not above and now - last > STEP_GAP_MS:
            out.append((user, event, ts))
            last = now
        above = high
    return (above, last), out


def step_detection(samples: DataFrame) -> DataFrame:
    """(user_id, event_id, ts) of steps: the acceleration rises above 1.18 g, more than 280 ms after the last step."""
    return stateful(samples, _steps, (False, -(10**15)), "above boolean, last long", "user_id long, event_id long, ts timestamp_ntz")


def _headings(state, pdf):
    (held,) = state
    out = []
    for user, event, raw in pdf[["user_id", "event_id", "heading_raw"]].itertuples(index=False):
        if held is None or math.isnan(held):
            held = raw % 360
        else:
            a, b = math.radians(held), math.radians(raw)
            s = (1 - ALPHA) * math.sin(a) + ALPHA * math.sin(b)
            c = (1 - ALPHA) * math.cos(a) + ALPHA * math.cos(b)
            if max(abs(s), abs(c)) >= NOTHING:
                held = math.degrees(math.atan2(s, c)) % 360
        out.append((user, event, held))
    return (held,), out


def heading_smoothing(samples: DataFrame) -> DataFrame:
    """(user_id, event_id, heading): circular exponential mean with weight 0.5; an opposite heading changes nothing."""
    return stateful(samples, _headings, (float("nan"),), "held double", "user_id long, event_id long, heading double")


def _reckon(state, pdf):
    n, east, north, d = state
    out = []
    for user, event, heading, bearing, total in pdf[["user_id", "event_id", "heading", "bearing", "total"]].itertuples(index=False):
        if n < CALIBRATION:
            turn = math.radians(heading - bearing)
            n, east, north = n + 1, east + math.sin(turn), north + math.cos(turn)
            out.append((user, event, d, "calibrating"))
            continue
        offset = math.degrees(math.atan2(east, north)) if max(abs(east), abs(north)) >= NOTHING else 0.0
        away = round(abs(((heading - offset - bearing) % 360 + 540) % 360 - 180), 6)
        move = -1 if away > 180 - BACK_DEG else 1 if away <= FORWARD_DEG else 0
        d = min(max(d + move * STEP_M, 0.0), total)
        out.append((user, event, d, {1: "forward", 0: "stay", -1: "back"}[move]))
    return (n, east, north, d), out


def dead_reckoning(steps: DataFrame) -> DataFrame:
    """(user_id, event_id, dist, move) from steps with heading, path bearing and path length.

    Eight steps give the circular mean of heading against path, 0 where they cancel; then each step moves 0.75 m.
    Angles are compared to six places, so that rounding errors decide nothing.
    """
    return stateful(steps, _reckon, (0, 0.0, 0.0, 0.0), "n int, east double, north double, d double", "user_id long, event_id long, dist double, move string")


def arrival_and_reroute(fixes: DataFrame, routes: DataFrame, destinations: DataFrame) -> DataFrame:
    """(point_id, arrived, reroute, miles, minutes) per fix (point_id, route_id, plat, plon) on its route."""
    from wayfarer.functions.scalars import MILES_PER_KM, haversine_km

    off = ro.point_to_polyline(fixes, routes)
    rest = ro.trim_route(fixes, routes).select(F.col("point_id").alias("route_id"), F.col("place").alias("seq"), "lat", "lon")
    left = ro.polyline_length(rest).select(F.col("route_id").alias("point_id"), (F.col("km") * MILES_PER_KM).alias("miles"))
    to = fixes.join(destinations, "route_id").select("point_id", (haversine_km("plat", "plon", "dlat", "dlon") * 1000).alias("gap"))
    out = to.join(off, "point_id").join(left, "point_id", "left")
    arrived = F.col("gap") < ARRIVED_M
    return out.select("point_id", arrived.alias("arrived"), (~arrived & (F.col("metres") > REROUTE_M)).alias("reroute"), "miles", walk_minutes("miles").alias("minutes"))


def _preview(state, pdf):
    lat0, lon0 = state
    out = []
    for user, ts, lat, lon in pdf[["user_id", "ts", "lat", "lon"]].itertuples(index=False):
        flag = False
        if not math.isnan(lat0):
            a = math.sin(math.radians(lat - lat0) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(lat0)) * math.sin(math.radians(lon - lon0) / 2) ** 2
            flag = 2 * 6371000 * math.atan2(math.sqrt(a), math.sqrt(1 - a)) > PREVIEW_M
        if flag or math.isnan(lat0):
            lat0, lon0 = lat, lon
        out.append((user, ts, flag))
    return (lat0, lon0), out


def preview_reroute(fixes: DataFrame) -> DataFrame:
    """(user_id, ts, reroute): moved over 100 m from the last calculation point, which then moves along."""
    return stateful(fixes, _preview, (float("nan"), float("nan")), "lat double, lon double", "user_id long, ts timestamp_ntz, reroute boolean")


def _limit(n: int, seconds: int) -> Machine:
    def run(state, pdf):
        (recent,) = state
        recent, out = list(recent), []
        for user, attempt, ts in pdf[["user_id", "attempt_id", "attempted_at"]].itertuples(index=False):
            now = int(pd.Timestamp(ts).value // 1000)
            recent = [t for t in recent if t > now - seconds * 1_000_000]
            ok = len(recent) < n
            if ok:
                recent.append(now)
            out.append((user, attempt, ok))
        return (recent,), out

    return run


def admission_stream(attempts: DataFrame, n: int, seconds: int) -> DataFrame:
    """(user_id, attempt_id, admitted): the sequential limiter; state is the admitted times of the window."""
    schema = "user_id long, attempt_id long, admitted boolean"
    return stateful(attempts, _limit(n, seconds), ([],), "recent array<long>", schema, ts="attempted_at")


def _votes(state, pdf):
    vote, at, seq = state
    out = []
    for alert, user, v, ts, s in pdf[["alert_id", "user_id", "vote", "voted_at", "seq"]].itertuples(index=False):
        now = int(pd.Timestamp(ts).value // 1000)
        if (now, s) >= (at, seq):
            old, vote, at, seq = vote, v, now, s
            out.append((alert, user, old, vote, at, seq))
    return (vote, at, seq), out


def vote_changes(votes: DataFrame) -> DataFrame:
    """(alert_id, user_id, old_vote, vote, at, seq): each change of the last vote per alert and user, for running tallies."""
    if not votes.isStreaming:  # a batch has all votes in order: a window says the same without Python
        w = Window.partitionBy("alert_id", "user_id").orderBy("voted_at", "seq")
        at = F.unix_micros(F.col("voted_at").cast("timestamp")).alias("at")
        return votes.select("alert_id", "user_id", F.lag("vote").over(w).alias("old_vote"), "vote", at, "seq")
    keyed = votes.withColumn("pair", F.concat_ws(":", "alert_id", "user_id"))
    return stateful(
        keyed, _votes, (None, -(2**62), -1), "vote string, at long, seq long",
        "alert_id long, user_id long, old_vote string, vote string, at long, seq long", "pair", "voted_at",
    )


def tallies_of_changes(changes: DataFrame) -> DataFrame:
    """Confirm and deny counts per alert, summed from the changes."""
    gain = lambda k: F.sum((F.col("vote") == k).cast("int") - F.coalesce((F.col("old_vote") == k).cast("int"), F.lit(0))).cast("long")
    return changes.groupBy("alert_id").agg(gain("confirm").alias("confirms"), gain("deny").alias("denies"))


def live_view(alerts: DataFrame, profiles: DataFrame, votes: DataFrame, now, floors: DataFrame | None = None) -> DataFrame:
    """Trusted, clustered, active alerts; of the given floors (floor_id) only."""
    rows = al.active_alerts(alerts, now)
    if floors is not None:
        rows = rows.join(floors.select("floor_id").distinct(), "floor_id", "left_semi")
    return sp.alert_clusters(al.alert_trust_filter(al.alerts_with_votes(rows, profiles, votes)))


def live_alert_stream(changes: DataFrame, read: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], write: Callable[[DataFrame, int], None], now):
    """A foreachBatch writer that recomputes the floors touched by changed alerts (floor_id) in each trigger."""

    def each(batch: DataFrame, number: int) -> None:
        alerts, profiles, votes = read()
        write(live_view(alerts, profiles, votes, now, batch), number)

    return changes.writeStream.foreachBatch(each)


def route_alert_notice(routes: DataFrame, alerts: DataFrame, settle_ms: int = 600) -> DataFrame:
    """(route_id, title): one notice per route for others' alerts on it, when the route has settled.

    ``routes`` (seg_id, route_id, viewer_id, floor_id, x0, y0, x1, y1, changed_at, seen_at).
    """
    settled = routes.filter(F.unix_micros(F.col("seen_at").cast("timestamp")) - F.unix_micros(F.col("changed_at").cast("timestamp")) >= settle_ms * 1000)
    n = sp.alert_counts_on_route(alerts, settled)
    return n.select("route_id", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " alert").otherwise(" alerts"), F.lit(" on your route")).alias("title"))
