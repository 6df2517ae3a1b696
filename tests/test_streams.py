"""Streams over several triggers, with rows in any order, late rows, repeats and restarts, against their batch forms."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from wayfarer.operators import alerts as al
from wayfarer.streaming import device, live, ordered, tables, tracking

T0 = dt.datetime(2024, 1, 15)
SAMPLE = "user_id long, event_id long, ts timestamp, ax double, ay double, az double"


def second(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def put(folder, k, rows, names):
    """One file of a stream; files are taken in the order of their times."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{k}.json"
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps({n: v.isoformat() + "Z" if isinstance(v, dt.datetime) else v for n, v in zip(names, r) if v is not None}) + "\n")
    os.utime(path, (1000 + k, 1000 + k))


def source(spark, folder, schema, ts, delay):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder).withWatermark(ts, delay)


def run(writer, folder):
    q = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def run_to_files(df, folder):
    run(df.writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def test_steps_of_shuffled_files_restart_and_late_rows(spark, tmp_path, few_partitions):
    r, folder = random.Random(1), str(tmp_path)
    rows = [(u, i * 10 + u, T0 + dt.timedelta(milliseconds=150 * i + u), 0.0, 0.0, r.choice([0.9, 1.3])) for i in range(160) for u in range(5)]
    names = [c.split(" ")[0] for c in SAMPLE.split(", ")]
    by_arrival = sorted(rows, key=lambda x: x[2] + dt.timedelta(milliseconds=r.randrange(2500)))
    late = [(2, 9001, second(2), 0.0, 0.0, 9.0)]
    for k in range(2):
        put(f"{folder}/in", k, by_arrival[k * 400 : (k + 1) * 400], names)
        run_to_files(device.step_detection(source(spark, f"{folder}/in", SAMPLE, "ts", "4 seconds")), folder)  # each run goes on from the last
    put(f"{folder}/in", 7, late, names)
    put(f"{folder}/in", 8, [(-1, -1, second(3600), 0.0, 0.0, 0.0)], names)
    got = run_to_files(device.step_detection(source(spark, f"{folder}/in", SAMPLE, "ts", "4 seconds")), folder)
    want = device.step_detection(spark.createDataFrame(rows, SAMPLE))
    key = lambda df: sorted((x.user_id, x.event_id) for x in df.collect())
    assert key(got) == key(want)


def test_a_key_is_forgotten_after_its_lifetime(spark, tmp_path, few_partitions):
    folder, schema = str(tmp_path), "user_id long, event_id long, ts timestamp"

    def count(state, pdf):
        (n,) = state
        out = [(u, e, n + i + 1) for i, (u, e) in enumerate(zip(pdf["user_id"], pdf["event_id"]))]
        return (n + len(pdf),), out

    for k, rows in enumerate([[(1, 1, second(0)), (2, 2, second(0))], [(1, 3, second(50))], [(9, 4, second(200))], [(1, 5, second(210)), (2, 6, second(210))], [(9, 7, second(9000))]]):
        put(f"{folder}/in", k, rows, ["user_id", "event_id", "ts"])
    rows = source(spark, f"{folder}/in", schema, "ts", "1 second")
    out = ordered.ordered_stream(rows, count, (0,), "n long", "user_id long, event_id long, n long", lifetime_ms=100_000)
    got = {x.event_id: x.n for x in run_to_files(out, folder).collect()}
    assert {e: got[e] for e in (1, 2, 3, 5, 6)} == {1: 1, 2: 1, 3: 2, 5: 1, 6: 1}


def alert(i, floor, x, end, kind="crowd", user=1):
    return {"alert_id": i, "type": kind, "floor_id": floor, "x": x, "y": 0.5, "submitted_by": user, "status": "active", "created_at": second(0), "expires_at": second(end)}


def changed(rows):
    names = [c.split(" ")[0] for c in live.CHANGE_FIELDS.split(", ")]
    return [tuple(r.get(n) for n in names) for r in rows], names


def test_live_view_on_alerts_votes_and_the_clock(spark, tmp_path, few_partitions):
    folder = str(tmp_path)
    profiles = spark.createDataFrame([(1, 80), (2, 10)], "user_id long, reputation_score int")
    first = [alert(1, "a", 0.1, 100), alert(2, "a", 0.12, 5000), alert(3, "b", 0.3, 5000, user=2), alert(4, "c", 0.3, 5000)]
    steps = [
        [{"kind": "alert", "seen_at": second(10), **a} for a in first],
        [{"kind": "vote", "seen_at": second(20), "floor_id": "b", "alert_id": 3, "user_id": u, "vote": "confirm", "voted_at": second(u), "seq": u} for u in (5, 6)],
        [{"kind": "alert", "seen_at": second(101), **alert(5, "d", 0.9, 5000)}],
    ]
    for k, rows in enumerate(steps):
        put(f"{folder}/in", k, *changed(rows))
    kept = live.LiveAlerts(spark, f"{folder}/live", lambda: profiles)
    run(kept.writer(live.change_feed(spark, f"{folder}/in", 1)), folder)
    floors = [f for _, f in kept.rewritten]
    assert floors[:3] == [["a", "b", "c"], ["b"], ["d"]]
    assert floors[3:] == [["a"]]  # alert 1 has expired; nothing else of the feed has changed
    got = {(x.alert_id, x.cluster_id, x.confirms) for x in kept.view.read().collect()}
    assert got == {(2, 2, 0), (3, 3, 2), (4, 4, 0), (5, 5, 0)}
    everything = spark.createDataFrame([tuple(a.values()) for a in [*first, alert(5, "d", 0.9, 5000)]], live.ALERT_FIELDS)
    votes = spark.createDataFrame([(3, u, "confirm", second(u), u) for u in (5, 6)], live.VOTE_FIELDS)
    want = device.live_view(everything, profiles, votes, F.lit(second(101)))
    assert got == {(x.alert_id, x.cluster_id, x.confirms) for x in want.collect()}
    # the view of an untouched floor is the file of its last change
    assert kept.view.versions()["c"] == kept.rewritten[0][0]


def tallies_of(table):
    return sorted(tuple(x) for x in table.read().collect())


def test_votes_upsert_twice_late_and_after_a_lost_commit(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.randrange(30), r.randrange(9), r.choice(["confirm", "deny"]), second(r.randrange(500)), i) for i in range(600)]
    batches = [spark.createDataFrame(rows[k::3], live.VOTE_FIELDS) for k in range(3)]  # votes of all times in each: most batches hold late ones
    kept = live.VoteTallies(spark, f"file://{tmp_path}/votes", buckets=4)
    kept.apply(batches[0], 0)
    kept.apply(batches[1], 1)
    once = tallies_of(kept.tallies)
    kept.apply(batches[1], 1)  # the same batch again
    assert tallies_of(kept.tallies) == once
    kept.apply(batches[2], 2)
    kept.apply(batches[0], 3)  # all of an old batch again, under a new number
    want = al.vote_tallies(al.latest_vote(spark.createDataFrame(rows, live.VOTE_FIELDS)))
    assert tallies_of(kept.tallies) == sorted(tuple(x) for x in want.collect())
    # versions that later batches have replaced are gone
    assert len(os.listdir(f"{tmp_path}/votes/votes/rows")) <= 3


def test_votes_outlive_their_lifetime_only_in_untouched_buckets(spark, tmp_path):
    rows = [(1, 1, "confirm", second(0), 1), (1, 2, "deny", second(86_400 * 40), 2)]
    kept = live.VoteTallies(spark, f"file://{tmp_path}/votes", buckets=1, lifetime_days=30)
    for k, row in enumerate(rows):
        kept.apply(spark.createDataFrame([row], live.VOTE_FIELDS), k)
    assert tallies_of(kept.tallies) == [(1, 0, 1)]


def test_vote_stream_equals_batch(spark, tmp_path, few_partitions):
    r, folder = random.Random(6), str(tmp_path)
    rows = [(r.randrange(20), r.randrange(6), r.choice(["confirm", "deny"]), second(r.randrange(300)), i) for i in range(200)]
    names = [c.split(" ")[0] for c in live.VOTE_FIELDS.split(", ")]
    for k in range(3):
        put(f"{folder}/in", k, rows[k::3], names)
    votes = spark.readStream.schema(live.VOTE_FIELDS).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    kept = live.VoteTallies(spark, f"file://{folder}/votes", buckets=4)
    run(kept.writer(votes), folder)
    want = al.vote_tallies(al.latest_vote(spark.createDataFrame(rows, live.VOTE_FIELDS)))
    assert tallies_of(kept.tallies) == sorted(tuple(x) for x in want.collect())


def test_one_notice_per_settled_route(spark, tmp_path, few_partitions):
    folder, schema = str(tmp_path), "viewer_id long, route_id long, changed_at timestamp"
    ms = lambda n: T0 + dt.timedelta(milliseconds=n)
    routes = [(1, 10, ms(0)), (1, 11, ms(599)), (2, 20, ms(100)), (1, 12, ms(2000)), (3, 30, ms(2600)), (3, 31, ms(3200))]
    late = [(4, 40, ms(10))]
    segs = [(r, v, "f", 0.0, y, 1.0, y) for v, r, y in ((1, 10, 0.1), (1, 11, 0.1), (2, 20, 0.1), (1, 12, 0.9), (3, 30, 0.5), (3, 31, 0.1), (4, 40, 0.1))]
    segments = spark.createDataFrame(segs, "route_id long, viewer_id long, floor_id string, x0 double, y0 double, x1 double, y1 double")
    alerts = spark.createDataFrame(
        [(1, "elevator_down", 1, "f", 0.2, 0.11), (2, "crowd", 9, "f", 0.8, 0.09), (3, "hazard", 1, "f", 0.5, 0.9), (4, "new", 9, "f", 0.5, 0.51)],
        "alert_id long, type string, submitted_by long, floor_id string, x double, y double",
    )
    names = ["viewer_id", "route_id", "changed_at"]
    for k, rows in enumerate([routes[:3], [*routes[3:], routes[2]], [(9, 90, ms(60_000))], late, [(9, 91, ms(200_000))]]):
        put(f"{folder}/in", k, rows, names)
    stream = source(spark, f"{folder}/in", schema, "changed_at", "5 seconds")
    got = []
    of = lambda settled: segments.join(settled.select("route_id"), "route_id", "left_semi")
    write = lambda df, number: got.extend(tuple(x) for x in df.collect())
    run(live.notice_writer(stream, of, lambda: alerts, write), folder)
    settled = live.settled_routes(spark.createDataFrame(routes, schema))
    want = sorted(tuple(x) for x in live.route_notices(of(settled), alerts).collect())
    assert sorted(got) == want == [(11, "Crowd on your route"), (20, "Alerts on your route"), (30, "Other on your route"), (31, "Alerts on your route")]


def brute_thin(rows, least_m, least_ms):
    out, last = [], {}
    for u, f, ts, lat, lon in sorted(rows, key=lambda r: (r[2], r[1])):
        if u not in last or ((ts - last[u][0]).total_seconds() * 1000 >= least_ms and tracking.metres(*last[u][1:], lat, lon) >= least_m):
            last[u] = (ts, lat, lon)
            out.append((u, f))
    return sorted(out)


def test_fixes_are_thinned_by_distance_and_time(spark, tmp_path, few_partitions):
    r, folder = random.Random(8), str(tmp_path)
    rows = [(u, i, second(i + u / 10), 30.0 + i * 1e-5 * r.random(), -97.0) for i in range(120) for u in range(3)]
    names = ["user_id", "fix_id", "ts", "lat", "lon"]
    want = brute_thin(rows, 5, 3000)
    batch = tracking.thinned_fixes(spark.createDataFrame(rows, "user_id long, fix_id long, ts timestamp, lat double, lon double"))
    assert sorted((x.user_id, x.fix_id) for x in batch.collect()) == want
    arrival = sorted(rows, key=lambda x: x[2] + dt.timedelta(seconds=r.randrange(20)))
    for k in range(3):
        put(f"{folder}/in", k, arrival[k * 120 : (k + 1) * 120], names)
    put(f"{folder}/in", 9, [(-1, -1, second(99_999), 0.0, 0.0)], names)
    got = run_to_files(tracking.thinned_fixes(tracking.fix_stream(spark, f"{folder}/in", per_trigger=1)), folder)
    assert sorted((x.user_id, x.fix_id) for x in got.collect() if x.user_id >= 0) == want


def brute_steps(path, headings):
    """Walks the path in plain steps; positions by adding up whole segments."""
    import math

    legs = [math.hypot((b[0] - a[0]) * 100, (b[1] - a[1]) * 80) for a, b in zip(path, path[1:])]

    def place(d):
        d, i = min(d, sum(legs)), 0
        while i < len(legs) - 1 and d >= sum(legs[: i + 1]):
            i += 1
        t = 1.0 if legs[i] < 0.001 else (d - sum(legs[:i])) / legs[i]
        (ax, ay, af), (bx, by, bf) = path[i], path[i + 1]
        return ax + (bx - ax) * t, ay + (by - ay) * t, af if t < 0.5 else bf

    turn = lambda a, b: min((a - b) % 360, (b - a) % 360)
    d, seen, offset, out = 0.0, [], None, []
    for h in headings:
        (ax, ay, _), (bx, by, _) = place(d), place(d + 3)
        dx, dy = (bx - ax) * 100, (by - ay) * 80
        ahead = math.degrees(math.atan2(dy, dx)) % 360 if abs(dx) >= 1e-6 or abs(dy) >= 1e-6 else None
        sign, name = 1, "forward"
        if offset is None:
            name = "calibrating"
            seen.append((h - ahead) % 360 if h is not None and ahead is not None else 0.0)
            if len(seen) == 8:
                offset = sum(seen) / 8
        elif h is not None and ahead is not None:
            way = (h - offset) % 360
            sign, name = (-1, "backward") if turn(way, ahead + 180) <= 40 else (1, "forward") if turn(way, ahead) <= 90 else (0, "sideways")
        d = min(max(d + 0.75 * sign, 0.0), sum(legs))
        out.append((round(d, 6), name, *(round(v, 6) for v in place(d)[:2]), place(d)[2]))
    return out


def test_steps_follow_their_path(spark):
    r = random.Random(9)
    rows, want = [], {}
    for user in range(6):
        path = [(r.random() * 0.3, r.random() * 0.3, r.choice(["f1", "f2"])) for _ in range(4)]
        headings = [None if r.random() < 0.05 else r.choice([r.uniform(0, 360), r.uniform(80, 100)]) for _ in range(150)]
        rows += [(user, 5000, second(0), 10.0, None, None, None)]  # before any path: no row
        rows += [(user, -1, second(1), None, *(list(c) for c in zip(*path)))]
        rows += [(user, i, second(2 + i), h, None, None, None) for i, h in enumerate(headings)]
        want |= {(user, i): w for i, w in enumerate(brute_steps(path, headings))}
    got = tracking.path_reckoning(spark.createDataFrame(rows, tracking.PATH_ROWS)).collect()
    assert {(x.user_id, x.event_id): (round(x.dist, 6), x.move, round(x.x, 6), round(x.y, 6), x.floor_id) for x in got} == want
    assert len({w[1] for w in want.values()}) == 4


def test_a_new_path_calibrates_anew(spark):
    path = lambda t: (1, -1, second(t), None, [0.0, 0.9], [0.5, 0.5], ["f", "f"])
    rows = [path(0)] + [(1, i, second(1 + i), 30.0, None, None, None) for i in range(12)]
    rows += [path(20)] + [(1, 100 + i, second(21 + i), 210.0, None, None, None) for i in range(12)]
    got = {x.event_id: (x.dist, x.move) for x in tracking.path_reckoning(spark.createDataFrame(rows, tracking.PATH_ROWS)).collect()}
    assert got[7] == (6.0, "calibrating") and got[11] == (9.0, "forward")
    assert got[100] == (0.75, "calibrating") and got[111] == (9.0, "forward")


def test_route_is_trimmed_replaced_and_left_at_arrival(spark, tmp_path, few_partitions):
    folder = str(tmp_path)
    deg = 1 / 111_194.93  # one metre of latitude
    at = lambda m, off=0.0: (30.0 + m * deg, -97.0 + off * deg)
    route = lambda t, a, b, off=0.0: (1, -1, second(t), None, None, [at(a, off)[0], at((a + b) / 2, off)[0], at(b, off)[0]], [at(a, off)[1]] * 3, at(b, off)[0], at(b, off)[1])
    fix = lambda i, m, off=0.0: (1, i, second(i), *at(m, off), None, None, None, None)
    rows = [fix(0, 0), route(0.5, 0, 1000), fix(1, 100), fix(2, 300, 10), fix(3, 500, 60), fix(4, 600, 60), route(4.5, 600, 1000, 60), fix(5, 700, 60), fix(6, 980, 60), fix(7, 990, 60)]
    batch = sorted((tuple(x) for x in tracking.route_tracking(spark.createDataFrame(rows, tracking.ROUTE_ROWS)).collect()))
    km = {f: round(m / 0.621371 * 1000) if m is not None else None for _, f, _, _, m, _ in batch}
    assert [(f, a, r) for _, f, a, r, _, _ in batch] == [(1, False, False), (2, False, False), (3, False, True), (4, False, False), (5, False, False), (6, True, False)]
    assert km == {1: 900, 2: 700, 3: 500, 4: 500, 5: 300, 6: None}  # fix 4 waits for the new route
    names = [c.split(" ")[0] for c in tracking.ROUTE_ROWS.split(", ")]
    put(f"{folder}/in", 0, [rows[k] for k in (4, 1, 0, 3)], names)
    put(f"{folder}/in", 1, [rows[k] for k in (2, 9, 8, 5, 7, 6)], names)
    put(f"{folder}/in", 2, [(-1, -1, second(9999), 0.0, 0.0)], names)
    got = run_to_files(tracking.route_tracking(source(spark, f"{folder}/in", tracking.ROUTE_ROWS, "ts", "1 minute")), folder)
    assert sorted(tuple(x) for x in got.collect()) == batch


def test_part_table_reads_only_the_asked_parts(spark, tmp_path):
    table = tables.PartTable(spark, f"file://{tmp_path}/t", "k long, v string")
    df = lambda rows: spark.createDataFrame(rows, "k long, v string")
    table.replace(df([(1, "a"), (2, "b/ =%")]), F.col("v"), ["a", "b/ =%"], 0)
    table.replace(df([]), F.col("v"), ["a"], 1)
    assert [r.k for r in table.read().collect()] == [2]
    assert table.read(["a"]).collect() == [] and [r.k for r in table.read(["a"], before=1).collect()] == [1]
    assert [r.k for r in table.read(["b/ =%", "none"]).collect()] == [2]
