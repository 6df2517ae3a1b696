"""Plans follow the rows that tables really have, not the sizes of their files."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from wayfarer.operators import iterate
from wayfarer.operators import raster as ra
from wayfarer.operators import spatial as sp


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_distance_to_wall_joins_nothing(spark):
    rng = random.Random(5)
    rows = [(f, x, y, int(rng.random() > 0.1)) for f in (1, 2) for x in range(14) for y in range(9)]
    rows += [(3, x, y, 1) for x in range(3) for y in range(3)]  # a floor without walls
    found = ra.distance_to_wall(spark.createDataFrame(rows, "floor_id long, x long, y long, passable int"))
    assert "Join" not in plan(found)
    walls = {f: [(x, y) for g, x, y, p in rows if g == f and not p] for f in (1, 2, 3)}
    want = {(f, x, y): 0.0 if not p else min((math.dist((x, y), w) for w in walls[f]), default=None) for f, x, y, p in rows}
    got = {(r.floor_id, r.x, r.y): r.dist for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] if want[k] is None else abs(got[k] - want[k]) < 1e-9 for k in want)


def test_segments_in_buckets_are_not_broadcast(spark):
    points = spark.range(50).select(F.col("id").alias("point_id"), F.lit(1).alias("floor_id"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    segments = spark.createDataFrame([(1, 1, 0.0, 0.0, 900.0, 700.0)], "seg_id int, floor_id int, x0 double, y0 double, x1 double, y1 double")
    assert "Broadcast" not in plan(sp.within_of_segments(points, segments, 5.0))


def test_a_written_table_of_many_equal_rows_is_not_broadcast(spark):
    table = iterate.cut(spark.range(200_000).select((F.col("id") % 3).alias("k"), F.lit(7).alias("v")))  # a few kB of files
    small = iterate.cut(spark.range(10).select(F.col("id").alias("k")))
    other = spark.range(300_000).select((F.col("id") % 5).alias("k"), F.rand().alias("w"))
    assert "Broadcast" not in plan(table.join(other, "k"))
    assert "Broadcast" in plan(small.join(other, "k"))


def test_alerts_on_routes_are_counted_without_pairs(spark):
    rng = random.Random(8)
    spots = [(rng.random(), rng.random()) for _ in range(25)]
    alerts = [(i, rng.choice([1, 2, 3, None]), rng.choice("ab"), *rng.choice(spots), rng.randrange(5)) for i in range(300)]
    point = lambda: (rng.random(), rng.random())
    segments = [(i // 4, rng.choice([1, 2, None]) if i % 4 == 0 else None, rng.choice("ab"), *point(), *point()) for i in range(60)]
    segments = [(r, segments[i - i % 4][1], f, x, y, *((x, y) if i % 7 == 0 else (x1, y1))) for i, (r, _, f, x, y, x1, y1) in enumerate(segments)]
    a = spark.createDataFrame(alerts, "alert_id long, submitted_by long, floor_id string, x double, y double, code long")
    s = spark.createDataFrame(segments, "route_id long, viewer_id long, floor_id string, x0 double, y0 double, x1 double, y1 double")

    def gap(x, y, x0, y0, x1, y1):
        dx, dy = x1 - x0, y1 - y0
        t = min(1.0, max(0.0, ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.dist((x, y), (x0 + t * dx, y0 + t * dy))

    want = {(r, i): c for r, v, f, *line in segments for i, by, g, x, y, c in alerts if f == g and gap(x, y, *line) < 0.1 and (v is None or (by is not None and by != v))}
    pairs = sp.alerts_on_route(a, s, 0.1)
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    made = lambda df: [x for x in plan(df).split("\n") if ("Exchange" in x or "Aggregate" in x) and "route_id" in x and "alert_id" in x]
    assert not made(pairs)
    counts = sp.alert_counts_on_route(a, s, 0.1, F.col("code"))
    sums: dict = {}
    for (r, _), c in want.items():
        n, total = sums.get(r, (0, 0))
        sums[r] = (n + 1, total + c)
    assert {r.route_id: (r.n, r.code) for r in counts.collect()} == sums
    assert not made(counts)


def records_shuffled(node) -> int:
    """Records that the exchanges of a plan that has run wrote."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return records_shuffled(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return records_shuffled(node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(records_shuffled(node.children().apply(i)) for i in range(node.children().size()))


def gap(x, y, x0, y0, x1, y1):
    dx, dy = x1 - x0, y1 - y0
    t = min(1.0, max(0.0, ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.dist((x, y), (x0 + t * dx, y0 + t * dy))


def test_alerts_on_routes_shuffle_few_rows_of_a_segment(spark):
    rng = random.Random(12)
    point = lambda: (rng.random(), rng.random())
    alerts = [(i, rng.randrange(50), rng.choice("ab"), *point()) for i in range(2000)]
    segments = [(i // 4, i // 4 % 50, rng.choice("ab"), *point(), *point()) for i in range(1000)]
    a = spark.createDataFrame(alerts, "alert_id long, submitted_by long, floor_id string, x double, y double")
    s = spark.createDataFrame(segments, "route_id long, viewer_id long, floor_id string, x0 double, y0 double, x1 double, y1 double")
    pairs = sp.alerts_on_route(a, s, 0.04)
    want = {(r, i) for r, v, f, *line in segments for i, by, g, x, y in alerts if f == g and by != v and gap(x, y, *line) < 0.04}
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    # buckets as wide as the radius would make about 50 rows of such a segment
    assert 0 < records_shuffled(pairs._jdf.queryExecution().executedPlan()) < 3 * len(alerts) + 8 * len(segments)


def test_alerts_on_routes_of_several_viewers_and_small_batches(spark):
    """Ids that are texts, routes of several viewers or none, unknown submitters and places, segments without length."""
    rng = random.Random(21)
    spots = [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(30)]
    alerts = [(f"a{i}", rng.choice(["u1", "u2", "u3", None]), rng.choice("ab"), *rng.choice(spots)) for i in range(400)]
    alerts += [("lost", "u1", None, 0.0, 0.0), ("nowhere", "u1", "a", None, 0.0)]
    segments = []
    for i in range(120):
        x0, y0 = rng.choice(spots)
        segments.append((f"r{i % 9}", rng.choice(["u1", "u2", None] if i % 9 > 4 else [["u1", "u2", "u3", None, "u4"][i % 9]]), rng.choice("ab"), x0, y0, *((x0, y0) if i % 6 == 0 else (rng.uniform(-1, 1), rng.uniform(-1, 1)))))
    a = spark.createDataFrame(alerts, "alert_id string, submitted_by string, floor_id string, x double, y double")
    s = spark.createDataFrame(segments, "route_id string, viewer_id string, floor_id string, x0 double, y0 double, x1 double, y1 double")
    want = {(r, i) for r, v, f, *line in segments for i, by, g, x, y in alerts if f == g and x is not None and gap(x, y, *line) < 0.1 and (v is None or (by is not None and by != v))}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for rows in ("10000", "7"):
            spark.conf.set(name, rows)
            assert sorted(map(tuple, sp.alerts_on_route(a, s, 0.1).collect())) == sorted(want)
    finally:
        spark.conf.set(name, before)
    assert sp.alerts_on_route(a.filter("false"), s).isEmpty() and sp.alerts_on_route(a, s.filter("false")).isEmpty()


def test_place_search_meets_few_names(spark, monkeypatch):
    """Texts in every name, in few and in none: the rows of a brute force, from few pairs of text and name."""
    from wayfarer.operators import places as pl

    monkeypatch.setattr(pl, "FEW_NAMES", 5)
    rng = random.Random(3)
    place = [(i, f"Hall {i:04d}", rng.random() * 0.4, rng.random() * 0.4) for i in range(400)]
    asks = [(i, rng.choice(["hall", " HA", "7", f"hall {i:04d}", "0011", "nothing", " "]), rng.random() * 0.4, rng.random() * 0.4) for i in range(80)]
    asks.append((900, "hall", 9.0, 9.0))
    found = pl.ring_place_search(
        spark.createDataFrame(asks, "query_id long, text string, lat double, lon double"), spark.createDataFrame(place, "place_id long, name string, lat double, lon double")
    )
    want = set()
    for q, text, lat, lon in asks:
        text = text.strip().lower()
        hits = sorted((max(abs(a - lat), abs(b - lon)), i) for i, name, a, b in place if text and text in name.lower())
        n = [sum(d <= r for d, _ in hits) for r in pl.RINGS]
        use = 1 if n[0] >= 3 else 2 if n[1] >= 3 else 3 if n[2] >= 1 else 4
        want |= {(q, i, use) for d, i in hits[:10] if use == 4 or d <= pl.RINGS[use - 1]}
    assert {tuple(r) for r in found.collect()} == want
    common = spark.createDataFrame([(i, f"hall {i}", "hal", a, b) for i, _, a, b in place], "place_id long, low string, gram string, lat double, lon double")
    q = spark.createDataFrame([(i, "hall", "hal", a, b) for i, _, a, b in place], "query_id long, text string, gram string, qlat double, qlon double")
    assert pl._nearest_names(q, common, 10).count() < 400 * 40


def test_shortest_paths_start_from_every_start_they_had(spark):
    from wayfarer.plans import spatial_queries as sq
    from wayfarer.plans.fixtures import Fixtures

    t = Fixtures(spark, "/root/testdata/sf0.001")
    want = {r.node_id for r in t("f_nodes").collect() if r.node_id % 50 == 0 or r.node_id % 35 == 3}
    assert {r.start_id for r in t.sql(sq.PAIRS4).collect()} == want


def test_building_documents_stay_small(spark):
    from wayfarer.plans import raster_queries as rq
    from wayfarer.plans.fixtures import Fixtures

    t = Fixtures(spark, "/root/testdata/sf0.1")
    assert len(rq.read_back(t).inputFiles()) >= t("f_nodes").count() / 5000
