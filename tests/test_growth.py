"""What a task holds or reads does not grow with a floor, a text or a trigger."""

from __future__ import annotations

import datetime as dt
import os
import random
import re
import types

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfarer.operators import audits as au
from wayfarer.operators import floor_paths as fp
from wayfarer.operators import graph as gr
from wayfarer.operators import iterate
from wayfarer.operators import places as pl
from wayfarer.operators import raster as ra
from wayfarer.operators import social as so
from wayfarer.plans import live_queries as lq
from wayfarer.plans import spatial_queries as sq
from wayfarer.plans.fixtures import Fixtures
from wayfarer.streaming import live, ordered


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def fed(spark, monkeypatch, folder, make):
    """The files that a query gives its stream, without the stream."""
    monkeypatch.setattr(lq, "folder_of", lambda t, name: f"file://{folder}")
    monkeypatch.setattr(lq, "finish", lambda writer, folder: None)
    make(Fixtures(spark, "/root/testdata/sf0.001"))
    return [f for f in os.listdir(f"{folder}/in") if f.endswith(".json")]


def test_a_floor_passes_the_clock_in_several_tasks(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    alerts = [(i, "crowd", "f", 0.1, 0.1, 1, "active", at, at + dt.timedelta(minutes=i), at) for i in range(200)]
    rows = live.change_rows(spark.createDataFrame(alerts, f"{live.ALERT_FIELDS}, seen_at timestamp"))
    rows.coalesce(1).write.json(f"{tmp_path}/in")
    passed = live.touched_floors(live.change_feed(spark, f"{tmp_path}/in")).select("kind", "alert_id", F.spark_partition_id().alias("task"))
    q = passed.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema("kind string, alert_id long, task int").parquet(f"{tmp_path}/out").filter("kind = 'alert'").collect()
    assert sorted(r.alert_id for r in got) == list(range(200))
    assert len({r.task for r in got}) > 1


def test_the_live_views_feed_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    assert len(fed(spark, monkeypatch, tmp_path, lq.view_of_stream)) > 3 + 4


def test_texts_and_rooms_that_a_site_repeats_meet_once(spark):
    r = random.Random(4)
    label = lambda: f"{r.randrange(1, 4)}.{r.randrange(100, 140)}{r.choice(['', '', 'A', 'b'])}"
    rooms = [(i, r.randrange(2), "room" if r.random() < 0.9 else "hallway", label()) for i in range(400)]
    texts = [(i, r.randrange(2), r.choice(["Room {}", "{}", "# 2 . 1", "10", "3.1", f"2.0{r.randrange(100, 140)}", " "]).format(label())) for i in range(300)]
    found = pl.resolve_room(spark.createDataFrame(texts, "query_id long, site int, text string"), spark.createDataFrame(rooms, "node_id long, site int, type string, label string"))
    assert "Window" not in plan(found)  # which ordered every pair of a text and a room
    numbers = lambda x: re.fullmatch(r"(\d+)\.(\d+)([a-z]?)", x)
    plain = lambda x: re.sub("[^a-z0-9]", "", x)
    want = set()
    for query, site, text in texts:
        q = re.sub(r"\s*\.\s*", ".", re.sub(r"^(room|rm|ste|suite|#)\s*", "", text.strip(), flags=re.I).strip()).lower()
        hits = []
        for node, own, kind, name in rooms:
            low, mine, its = name.lower(), numbers(q), numbers(name.lower())
            if own != site or kind != "room" or not q:
                continue
            gap = abs(int(mine[2]) - int(its[2])) if mine and its and mine[1] == its[1] else None
            if q in low:
                hits.append((1, 0, low, name, node))
            elif plain(q) == plain(low) and len(plain(q)) >= 2:
                hits.append((2, 0, "", "", node))
            elif gap is not None and low == f"{mine[1]}.{int(mine[2])}{mine[3]}":
                hits.append((3, 0, "", "", node))
            elif gap is not None and gap <= 12 and mine[3] in ("", its[3]):
                hits.append((4, gap, "", "", node))
        if hits:
            want.add((query, min(hits)[-1], min(hits)[0]))
    assert {tuple(x) for x in found.collect()} == want and {t for *_, t in want} >= {1, 3, 4}


def test_the_feed_of_votes_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    assert len(fed(spark, monkeypatch, tmp_path, lq.tallies_of_stream)) > 4


class Kept:
    """A state variable that counts its calls and values."""

    calls = values = 0

    def __init__(self):
        self.held = []

    def _call(self, n=0):
        Kept.calls, Kept.values = Kept.calls + 1, Kept.values + n

    def get(self):
        self._call()
        return iter(self.held) if isinstance(self, KeptList) else self.held[0] if self.held else None

    def exists(self):
        self._call()
        return bool(self.held)

    def clear(self):
        self._call()
        self.held = []

    def update(self, value):
        self._call(1)
        self.held = [value]


class KeptList(Kept):
    def appendValue(self, value):
        self._call(1)
        self.held.append(value)

    def appendList(self, values):
        self._call(len(values))
        self.held += values

    put = appendList


class Handle:
    getValueState = lambda self, name, schema: Kept()
    getListState = lambda self, name, schema: KeptList()

    def registerTimer(self, at):
        Kept.calls += 1

    deleteTimer = registerTimer


def test_waiting_rows_are_one_value_a_trigger(spark):
    rows = pd.DataFrame({"user_id": 1, "event_id": range(60), "ts": pd.date_range("2024-01-01", periods=60, freq="150ms"), "v": range(60)})
    machine = lambda state, pdf: ((state[0] + int(pdf["v"].sum()),), [(int(e), state[0]) for e in pdf["event_id"]])
    key = ordered.InOrder(machine, (0,), StructType.fromDDL("n long"), list(rows.columns), ["event_id", "n"], ["ts", "event_id"], 86_400_000)
    key.init(Handle())
    at = lambda mark: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
    first = int(rows["ts"].iloc[0].value // 1_000_000)
    Kept.calls = Kept.values = 0
    for part in (rows[40:], rows[:40].sample(frac=1, random_state=3)):
        assert not sum(len(x) for x in key.handleInputRows((1,), iter([part]), at(0)))
    assert Kept.values <= 4 and Kept.calls <= 9
    out = pd.concat(list(key.handleExpiredTimer((1,), at(first + 150 * 50), None)))
    assert out["event_id"].tolist() == list(range(50)) and set(out["n"]) == {0}
    out = pd.concat(list(key.handleExpiredTimer((1,), at(first + 150 * 90), None)))
    assert out["event_id"].tolist() == list(range(50, 60)) and set(out["n"]) == {sum(range(50))}
    list(key.handleExpiredTimer((1,), at(first + 10**9), None))
    assert not key.machine_state.held and not key.clock.held


def test_short_lines_are_looked_at_without_arrays(monkeypatch):
    r = random.Random(6)
    cells = pd.DataFrame([(x, y, int(r.random() < 0.8)) for x in range(40) for y in range(30)], columns=["x", "y", "passable"])
    raster, pairs = fp.Raster(cells), [(r.randrange(1200), r.randrange(1200)) for _ in range(3000)]
    monkeypatch.setattr(fp, "NEAR", 3)  # the rest of a line as arrays
    want = [raster.sees(*p) for p in pairs]
    monkeypatch.setattr(fp, "NEAR", 48)
    monkeypatch.setattr(fp.np, "arange", None)
    assert [raster.sees(*p) for p in pairs] == want and 50 < sum(want) < 2950


def test_known_nodes_are_not_broadcast(spark, monkeypatch):
    t, seen = Fixtures(spark, "/root/testdata/sf0.001"), []
    monkeypatch.setattr(gr, "min_labels", lambda nodes, edges: seen.append(plan(edges)) or nodes.withColumn("component", F.col("node")))
    gr.connected_components(t("f_nodes"), t("f_edges"))
    assert "BroadcastHashJoin" not in seen[0] and "BroadcastExchange" not in seen[0]


def test_penalties_are_not_broadcast(spark, monkeypatch):
    t, seen = Fixtures(spark, "/root/testdata/sf0.001"), []
    assert "Broadcast" not in plan(sq.stairs(t)).replace("BroadcastNestedLoopJoin", "")
    monkeypatch.setattr(gr, "least_ways", lambda pairs, arcs: seen.append(arcs) or pairs.select("pair_id"))
    gr.shortest_paths_avoiding(t.sql(sq.PAIRS), t("f_edges"), t("f_nodes").select("node_id"))
    assert "BroadcastHashJoin" not in plan(seen[0])


def test_a_task_compares_few_keys_of_an_audit(spark, monkeypatch):
    monkeypatch.setattr(au, "TASK_ROWS", 50, raising=False)
    votes = spark.range(600).select((F.col("id") % 590).alias("alert_id"), (F.col("id") % 590 % 7).alias("user_id"))
    twice = au._repeated(votes, "votes", "unique", "alert_id", "user_id")
    lost = au._orphans(votes, "votes", "alert", "alert_id", "alert_id", spark.range(3, 700).withColumnRenamed("id", "alert_id").hint("merge"), "alert_id")
    assert (twice.rdd.getNumPartitions(), lost.rdd.getNumPartitions()) == (13, 14)
    assert sorted(int(x[2].split(":")[0]) for x in twice.collect()) == list(range(10))
    assert sorted(int(x[2]) for x in lost.collect()) == [0, 0, 1, 1, 2, 2]


def test_lines_of_one_file_are_walked_by_several_tasks_and_once(spark):
    r = random.Random(8)
    cells = spark.createDataFrame([(1, x, y, int(r.random() < 0.9)) for x in range(30) for y in range(30)], "floor_id long, x long, y long, passable int")
    lines = [(i, 1, *(r.randrange(30) for _ in range(4))) for i in range(200)]
    found = ra.lines_clear(spark.createDataFrame(lines, "line_id long, floor_id long, x0 long, y0 long, x1 long, y1 long").coalesce(1), cells)
    steps = plan(found)
    assert steps.count("explode(sequence") == 1  # the cells of a line are counted out once
    assert "Exchange hashpartitioning(line_id" in steps[steps.index("explode(sequence") :].split("Generate")[0]
    wall, want = {(c.x, c.y) for c in cells.collect() if not c.passable}, {}
    for i, _, x0, y0, x1, y1 in lines:
        n = max(abs(x1 - x0), abs(y1 - y0))
        on = lambda a, b, k: a + ((b > a) - (b < a)) * ((abs(b - a) * 2 * k + n) // (2 * max(n, 1)))
        way = [(on(x0, x1, k), on(y0, y1, k)) for k in range(n + 1)]
        corner = any(p[0] != q[0] and p[1] != q[1] and (q[0], p[1]) in wall and (p[0], q[1]) in wall for p, q in zip(way, way[1:]))
        want[i] = not corner and not wall & set(way)
    assert {x.line_id: x.clear for x in found.collect()} == want and 20 < sum(want.values()) < 180


def test_a_task_compares_few_pairs_of_people(spark, monkeypatch):
    monkeypatch.setattr(so, "TASK_PAIRS", 100, raising=False)
    members = spark.createDataFrame([(g, u) for g in range(3) for u in range(10 * g, 10 * g + 20)], "group_id long, user_id long")
    friends = spark.createDataFrame([(1, 50, "accepted"), (2, 51, "pending"), (3, 52, "declined")], "user_id long, friend_id long, status string")
    shares = spark.createDataFrame([(4, 53)], "owner_id long, viewer_id long")
    found = so.visible_profiles(spark.range(60).withColumnRenamed("id", "user_id"), members, friends, shares)
    assert found.rdd.getNumPartitions() == 1 + (3 * 400 + 60 + 3 * 3 + 2) // 100
    want = {(a, b) for g in range(3) for a in range(10 * g, 10 * g + 20) for b in range(10 * g, 10 * g + 20)} | {(u, u) for u in range(60)}
    want |= {(1, 50), (50, 1), (51, 2), (4, 53), (53, 4)}
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_paths_and_components_are_not_broadcast(spark, monkeypatch):
    t, seen = Fixtures(spark, "/root/testdata/sf0.001"), []
    pairs = spark.range(50).select(F.col("id").alias("pair_id"), F.col("id").alias("start_id"), (F.col("id") + 7).alias("goal_id"))
    kept = gr.cut
    monkeypatch.setattr(iterate, "MOST_BROADCAST_MB", 0)  # written tables count as large
    monkeypatch.setattr(gr, "cut", lambda df: seen.append(plan(df)) or kept(df))
    found = gr.shortest_paths(pairs, t("f_edges"))
    monkeypatch.setattr(sq, "cut", lambda df: seen.append(plan(df)) or kept(df), raising=False)
    costs = sq.with_path_cost(found, gr.directed(t("f_edges")))
    assert len(seen) >= 3 and not [p for p in [*seen, plan(costs)] if "BroadcastHashJoin" in p]
    assert all(x.cost == x.path_cost for x in costs.collect())


def test_cells_are_made_by_many_tasks(spark):
    cells = Fixtures(spark, "/root/testdata/sf0.01")("f_cells")
    assert cells.select(F.spark_partition_id()).distinct().count() > 1


def corridor(cells: dict, nodes: list, k: int) -> set:
    """The corridor of one floor {(x, y): passable}, cell by cell."""
    r = k // 2

    def box(now, op):
        for i, j in ((1, 0), (0, 1)):
            now = {(x, y): op(now[x + i * d, y + j * d] for d in range(-r, r + 1) if (x + i * d, y + j * d) in now) for x, y in now}
        return now

    def parts(now):
        left, out = {c for c, v in now.items() if v == 1}, []
        while left:
            part, todo = set(), [left.pop()]
            while todo:
                x, y = todo.pop()
                part.add((x, y))
                near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            out.append(part)
        return out

    first = lambda part: min((y, x) for x, y in part)
    best = max(parts(box(box(cells, min), max)), key=lambda p: (sum(n in p for n in nodes), len(p), [-v for v in first(p)]), default=set())
    grown = box({c: int(c not in best) for c in cells}, min)
    back = parts({c: int(v == 1 and grown[c] == 0) for c, v in cells.items()})
    return max(back, key=lambda p: (len(p), [-v for v in first(p)]), default=set())


def test_the_corridor_handles_words_instead_of_cells(spark, monkeypatch):
    r = random.Random(11)
    # longer than a word with holes and cells left of zero; rooms whose doors are sealed; no nodes
    floors = {
        "a": {(x, y): int(r.random() < 0.9) for x in range(-70, 90) for y in range(24) if r.random() < 0.95},
        "b": {(x, y): int(x % 9 != 0 and y % 9 != 0 or (x % 9 == 0 and y % 9 == 4 and r.random() < 0.5)) for x in range(140) for y in range(30)},
        "c": {(x, y): int(r.random() < 0.8) for x in range(130) for y in range(9)},
    }
    nodes = {f: r.sample(sorted(cells), 40) if f != "c" else [] for f, cells in floors.items()}
    table = spark.createDataFrame([(f, x, y, p) for f, cells in floors.items() for (x, y), p in cells.items()], "floor_id string, x int, y int, passable int")
    spots = spark.createDataFrame([(f, x, y) for f, held in nodes.items() for x, y in held], "floor_id string, x int, y int")
    written = []
    monkeypatch.setattr(ra, "cut", lambda df: written.append(iterate.cut(df)) or written[-1])
    got = {tuple(x) for x in ra.corridor_network(table, spots, 3).collect()}
    assert got == {(f, x, y) for f, cells in floors.items() for x, y in corridor(cells, nodes[f], 3)}
    assert {f for f, *_ in got} == set(floors)
    assert max(t.count() for t in written) < sum(map(len, floors.values())) / 3  # cells themselves, before


def test_the_outside_handles_words_instead_of_cells(spark, monkeypatch):
    r = random.Random(5)
    cells = {(x, y): int(r.random() < 0.9) for x in range(140) for y in range(26)}

    def box(now):
        for i, j in ((1, 0), (0, 1)):
            now = {(x, y): min(now.get((x + i * d, y + j * d), 1) for d in (-1, 0, 1)) for x, y in now}
        return now

    sealed, out = box(cells), set()
    todo = [c for c, v in sealed.items() if v and (c[0] in (0, 139) or c[1] in (0, 25))]
    while todo:
        x, y = todo.pop()
        out.add((x, y))
        todo += [n for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if sealed.get(n) and n not in out]
    grown = {c for c, v in box({c: int(c not in out) for c in cells}).items() if not v}
    free = {(x, y) for x, y in grown if all(cells.get((x + i, y + j), 1) for i in (-1, 0, 1) for j in (-1, 0, 1))}  # farther than 1.5 cells from walls
    table = spark.createDataFrame([("f", x, y, p) for (x, y), p in cells.items()], "floor_id string, x int, y int, passable int")
    written = []
    monkeypatch.setattr(ra, "cut", lambda df: written.append(iterate.cut(df)) or written[-1])
    got = {(x, y) for _, x, y in ra.exterior_cells(table, 3, 1, 3, 1, 1.5).collect()}
    assert got == out | free and out
    assert max(t.count() for t in written) < len(cells) / 3  # cells themselves, before
