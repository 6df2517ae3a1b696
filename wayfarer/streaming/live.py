"""Live views: alerts per floor on changes, votes and the clock; vote tallies by upsert; one notice per route."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from wayfarer.operators import alerts as al
from wayfarer.operators import spatial as sp
from wayfarer.streaming.device import live_view
from wayfarer.streaming.ordered import _millis, use_rocksdb
from wayfarer.streaming.tables import PartTable, merge_last

ALERT_FIELDS = "alert_id long, type string, floor_id string, x double, y double, submitted_by long, status string, created_at timestamp, expires_at timestamp"
VOTE_FIELDS = "alert_id long, user_id long, vote string, voted_at timestamp, seq long"
#: A row of the feed is a changed alert or a vote on an alert of ``floor_id``; ``seen_at`` is when the feed brought it.
CHANGE_FIELDS = f"kind string, seen_at timestamp, {ALERT_FIELDS}, user_id long, vote string, voted_at timestamp, seq long"
SETTLE_MS = 600
#: Keys among which the clock of a floor deals its alerts.
SLOTS = 64
#: How alert types are shown.
ALERT_LABELS = {
    "crowd": "Crowd",
    "construction": "Construction",
    "elevator_down": "Elevator Down",
    "building_closure": "Building Closure",
    "hazard": "Hazard",
    "other": "Other",
}


# alerts per floor


def change_rows(alerts: DataFrame | None = None, votes: DataFrame | None = None) -> DataFrame:
    """Changed alerts (with ``seen_at``) and votes (with ``seen_at`` and their alert's ``floor_id``) in the feed's columns."""
    names = [c.split(" ") for c in CHANGE_FIELDS.split(", ")]
    shaped = lambda df, kind: df.withColumn("kind", F.lit(kind)).select(
        *[(F.col(n) if n in [*df.columns, "kind"] else F.lit(None)).cast(t).alias(n) for n, t in names]
    )
    both = [shaped(df, kind) for df, kind in ((alerts, "alert"), (votes, "vote")) if df is not None]
    return both[0] if len(both) == 1 else both[0].unionByName(both[1])


def change_feed(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A file stream of changed alerts and votes; its clock is the time at which the feed brought them."""
    reader = spark.readStream.schema(CHANGE_FIELDS)
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader
    return reader.json(path).withWatermark("seen_at", "0 seconds")


class FloorClock(StatefulProcessor):
    """Passes a floor's changes on; when alerts expire, a row of kind ``clock`` for the floor.

    A key is a floor and a slot of its alerts, so that no task takes a floor whole. The expiries wait in its
    state and one timer stands at the first of them.
    """

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getListState("ends", "at long")
        self.timer = handle.getValueState("timer", "at long")

    def _wait_until(self, end: int) -> None:
        if self.timer.exists():
            old = self.timer.get()[0]
            if old <= end:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(end)
        self.timer.update((end,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            ends = pdf.loc[(pdf["kind"] == "alert") & pdf["expires_at"].notna(), "expires_at"]
            ends = sorted({e for e in _millis(ends).tolist() if e > mark}) if len(ends) else []
            if ends:
                self.ends.appendList([(e,) for e in ends])
                self._wait_until(ends[0])
            yield pdf[self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        rest = sorted({e for (e,) in self.ends.get() if e > mark})
        if rest:
            self.ends.put([(e,) for e in rest])
            self._wait_until(rest[0])
        else:
            self.ends.clear()
        row = dict.fromkeys(self.names) | {"kind": "clock", "floor_id": key[0], "seen_at": pd.Timestamp(mark, unit="ms")}
        out = pd.DataFrame([row])
        for c in ("created_at", "expires_at", "voted_at"):
            out[c] = pd.to_datetime(out[c])
        yield out

    def close(self) -> None:
        pass


def touched_floors(changes: DataFrame) -> DataFrame:
    """The feed's rows, and a row of kind ``clock`` for a floor on which an alert has expired."""
    use_rocksdb(changes.sparkSession)
    keyed = changes.withColumn("slot", F.pmod(F.xxhash64("alert_id"), F.lit(SLOTS)))
    return keyed.groupBy("floor_id", "slot").transformWithStateInPandas(FloorClock(changes.columns), changes.schema, "Append", "EventTime")


class LiveAlerts:
    """Keeps the trusted, clustered, active alerts of every floor; each trigger reads and rewrites its touched floors only.

    ``profiles`` gives the current reputations, read at each trigger with two columns.
    """

    VIEW = f"{ALERT_FIELDS}, confirms long, denies long, reputation int, cluster_id long"

    def __init__(self, spark: SparkSession, folder: str, profiles: Callable[[], DataFrame]):
        self.profiles = profiles
        self.alerts = PartTable(spark, f"{folder}/alerts", ALERT_FIELDS + ", seen_at timestamp")
        self.votes = PartTable(spark, f"{folder}/votes", VOTE_FIELDS + ", floor_id string")
        self.view = PartTable(spark, f"{folder}/view", self.VIEW)
        self.rewritten: list[tuple[int, list[str]]] = []

    def apply(self, batch: DataFrame, number: int) -> None:
        """One trigger: merge the changed alerts and votes, then make the views of their floors anew."""
        batch = batch.persist()
        try:
            said = batch.groupBy("floor_id").agg(F.max("seen_at").alias("now")).collect()
            floors = sorted(r.floor_id for r in said if r.floor_id is not None)
            if not floors:
                return
            now = F.lit(max(r.now for r in said))
            part = F.col("floor_id")
            merge_last(self.alerts, batch.filter("kind = 'alert' and floor_id is not null"), part, ["alert_id"], ["seen_at"], number)
            merge_last(self.votes, batch.filter("kind = 'vote' and floor_id is not null"), part, ["alert_id", "user_id"], ["voted_at", "seq"], number)
            view = live_view(self.alerts.read(floors).drop("seen_at"), self.profiles(), self.votes.read(floors), now)
            self.view.replace(view, part, floors, number)
            self.rewritten.append((number, floors))
        finally:
            batch.unpersist()

    def writer(self, changes: DataFrame) -> DataStreamWriter:
        return touched_floors(changes).writeStream.foreachBatch(self.apply)


# votes


class VoteTallies:
    """The last vote per alert and user, and confirm and deny counts per alert, kept by upsert in buckets of alerts."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, lifetime_days: int | None = None):
        self.votes = PartTable(spark, f"{folder}/votes", VOTE_FIELDS)
        self.tallies = PartTable(spark, f"{folder}/tallies", "alert_id long, confirms long, denies long")
        self.part, self.lifetime_days = F.pmod(F.xxhash64("alert_id"), F.lit(buckets)), lifetime_days

    def apply(self, batch: DataFrame, number: int) -> None:
        keep = None
        if self.lifetime_days is not None:
            keep = F.col("voted_at") > F.lit(batch.agg(F.max("voted_at")).first()[0]) - F.make_dt_interval(F.lit(self.lifetime_days))
        parts = merge_last(self.votes, batch, self.part, ["alert_id", "user_id"], ["voted_at", "seq"], number, keep)
        self.tallies.replace(al.vote_tallies(self.votes.read(parts)), self.part, parts, number)

    def writer(self, votes: DataFrame) -> DataStreamWriter:
        return votes.writeStream.foreachBatch(self.apply)


# notices


def settled_routes(routes: DataFrame, settle_ms: int = SETTLE_MS) -> DataFrame:
    """Routes (viewer_id, route_id, changed_at, ...) that their viewer did not replace within the settling time."""
    w = Window.partitionBy("viewer_id").orderBy("changed_at", "route_id")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = F.lead(micros("changed_at")).over(w) - micros("changed_at")
    return routes.withColumn("gap", gap).filter(F.col("gap").isNull() | (F.col("gap") >= settle_ms * 1000)).drop("gap")


class Settling(StatefulProcessor):
    """Holds a viewer's routes until the watermark is past their settling time; a replaced one is dropped.

    One timer a viewer stands at the end of the first waiting route's settling time.
    """

    def __init__(self, fields: str, names: list[str], settle_ms: int):
        self.fields, self.names, self.settle_ms = fields, names, settle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.fields)
        self.timer = handle.getValueState("timer", "at long")

    def _wait_until(self, end: int) -> None:
        if self.timer.exists():
            old = self.timer.get()[0]
            if old <= end:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(end)
        self.timer.update((end,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            at = _millis(pdf["changed_at"])
            pdf, at = pdf[at >= mark], at[at >= mark]
            if len(pdf):
                self.held.appendList([(int(r), pd.Timestamp(t).to_pydatetime()) for r, t in zip(pdf["route_id"], pdf["changed_at"])])
                self._wait_until(int(at.min()) + self.settle_ms)
        yield pd.DataFrame(columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        held = sorted(((t, r) for r, t in self.held.get()), key=lambda h: (h[0], h[1]))
        ends = [int(pd.Timestamp(t).value // 1_000_000) + self.settle_ms for t, _ in held]
        out, stay = [], []
        for i, (t, r) in enumerate(held):
            if ends[i] > mark:
                stay.append((r, t))
            elif i + 1 == len(held) or ends[i + 1] - ends[i] >= self.settle_ms:
                out.append((key[0], r, t))
        if stay:
            self.held.put(stay)
            self._wait_until(ends[-len(stay)])
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def settled_route_stream(routes: DataFrame, settle_ms: int = SETTLE_MS) -> DataFrame:
    """(viewer_id, route_id, changed_at): the stream form of ``settled_routes``; the watermark is on ``changed_at``.

    A route that comes again within the watermark's delay counts once; one that comes too late is dropped.
    """
    use_rocksdb(routes.sparkSession)
    once = routes.select("viewer_id", "route_id", "changed_at").dropDuplicatesWithinWatermark(["route_id"])
    names = ["viewer_id", "route_id", "changed_at"]
    processor = Settling("route_id long, changed_at timestamp", names, settle_ms)
    return once.groupBy("viewer_id").transformWithStateInPandas(processor, "viewer_id long, route_id long, changed_at timestamp", "Append", "EventTime")


def route_notices(segments: DataFrame, alerts: DataFrame) -> DataFrame:
    """(route_id, title): one title per route for others' alerts on it: the alert's label if there is one."""
    kinds = list(ALERT_LABELS)
    place = F.create_map(*[F.lit(x) for pair in zip(kinds, range(len(kinds))) for x in pair])
    per = sp.alert_counts_on_route(alerts, segments, code=F.coalesce(place[F.col("type")], F.lit(kinds.index("other"))))
    one = F.concat(F.get(F.array(*[F.lit(label) for label in ALERT_LABELS.values()]), F.col("code").cast("int")), F.lit(" on your route"))
    return per.select("route_id", F.when(F.col("n") == 1, one).otherwise("Alerts on your route").alias("title"))


def notice_writer(routes: DataFrame, segments: Callable[[DataFrame], DataFrame], alerts: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Titles of the routes that settle in each trigger, from the alerts as they are then.

    ``segments(routes)`` gives (route_id, viewer_id, floor_id, x0, y0, x1, y1) of the settled routes.
    """
    each = lambda batch, number: write(route_notices(segments(batch), alerts()), number)
    return settled_route_stream(routes).writeStream.foreachBatch(each)
