"""Room graphs: degrees, components, shortest paths for many pairs at once, shafts."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.operators.iterate import cut, min_labels
from wayfarer.operators.spatial import seeded_stream

#: Arcs of a component that one task may hold; larger components are searched by rounds.
MOST_ARCS = 500_000
#: Pairs that share a copy of their component's arcs.
SHARE = 500


def node_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def floor_entrance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(floor_id, node_id): first entrance, else first door, else the best connected node, the smaller id on ties."""
    pref = F.when(F.col("type") == "entrance", 0).when(F.col("type") == "door", 1).otherwise(2)
    rows = nodes.join(node_degree(edges), "node_id", "left").withColumn("pref", pref)
    degree = F.when(F.col("pref") < 2, 0).otherwise(-F.coalesce("degree", F.lit(0)))
    return rows.groupBy("floor_id").agg(F.min(F.struct("pref", degree.alias("d"), "node_id")).alias("b")).select("floor_id", "b.node_id")


def graph_meta_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per floor and, with a null floor, in all."""
    zero = F.lit(0).cast("long")
    floor = nodes.select(F.col("node_id").alias("src"), "floor_id")
    e = edges.join(floor, "src").select("floor_id", zero.alias("nodes"), zero.alias("rooms"), F.lit(1).alias("edges"), F.col("inter_floor").cast("long").alias("inter_floor"))
    n = nodes.select("floor_id", F.lit(1).alias("nodes"), (F.col("type") == "room").cast("long").alias("rooms"), zero.alias("edges"), zero.alias("inter_floor"))
    return n.unionByName(e).rollup("floor_id").agg(*[F.sum(c).alias(c) for c in ("nodes", "rooms", "edges", "inter_floor")])


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component) over same-floor edges between known nodes."""
    known = nodes.select(F.col("node_id").alias("node")).hint("merge")  # ids of small files are many rows
    flat = edges.filter("not inter_floor").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    flat = flat.join(known, F.col("a") == F.col("node"), "left_semi").join(known, F.col("b") == F.col("node"), "left_semi")
    return min_labels(known, flat).select(F.col("node").alias("node_id"), "component")


def largest_component(components: DataFrame) -> DataFrame:
    """Rows of the biggest component, the smaller name on ties; counts meet in one ordered limit."""
    best = components.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return components.join(best, "component", "left_semi")


def directed(edges: DataFrame) -> DataFrame:
    """(a, b, w): both directions, the least weight of parallel edges."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"))
    both = both.union(both.select("b", "a", "w"))
    return both.groupBy("a", "b").agg(F.min("w").alias("w"))


def relax(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """Least costs (pair_id, at, cost, before) from each pair's start, as far as its goal needs.

    Rounds move the frontier of all pairs one arc on; states dearer than the best known way to
    the goal stop. Equal costs keep the smaller predecessor.
    """
    arcs = cut(arcs)
    start = pairs.select("pair_id", F.col("start_id").alias("at"), F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("before"))
    best, frontier = cut(start), cut(start)
    goals = cut(pairs.select("pair_id", F.col("goal_id").alias("at")))
    while True:
        limit = best.join(goals, ["pair_id", "at"], "left_semi").select("pair_id", F.col("cost").alias("limit"))
        moved = frontier.join(arcs, F.col("at") == F.col("a")).select(
            "pair_id", F.col("b").alias("at"), (F.col("cost") + F.col("w")).alias("cost"), F.col("at").alias("before")
        )
        near = moved.groupBy("pair_id", "at").agg(F.min(F.struct("cost", "before")).alias("m")).select("pair_id", "at", "m.*")
        near = near.join(limit, "pair_id", "left").filter("limit is null or cost <= limit").drop("limit")
        old = best.select("pair_id", "at", F.col("cost").alias("old_cost"), F.col("before").alias("old_before"))
        both = near.join(old, ["pair_id", "at"], "left")
        frontier = cut(both.filter("old_cost is null or cost < old_cost or (cost = old_cost and before < old_before)").select("pair_id", "at", "cost", "before"))
        if frontier.isEmpty():
            return best
        best = cut(best.join(frontier.select("pair_id", "at"), ["pair_id", "at"], "left_anti").unionByName(frontier))


def walk_back(pairs: DataFrame, best: DataFrame) -> DataFrame:
    """(pair_id, cost, path): node lists by following predecessors of all pairs together."""
    goals = pairs.select("pair_id", F.col("goal_id").alias("at"))
    goal = best.join(goals, ["pair_id", "at"], "left_semi").select(
        "pair_id", "cost", F.array("at").alias("path"), F.col("before").alias("next")
    )
    now, steps = cut(goal), best.select("pair_id", F.col("at").alias("next"), F.col("before").alias("after"))
    while True:
        if now.filter("next is not null").isEmpty():
            return now.select("pair_id", "cost", "path")
        longer = now.filter("next is not null").join(steps, ["pair_id", "next"]).select(
            "pair_id", "cost", F.concat(F.array("next"), "path").alias("path"), F.col("after").alias("next")
        )
        now = cut(now.filter("next is null").unionByName(longer))


def _search(asks: pd.DataFrame, arcs: pd.DataFrame) -> list[tuple]:
    """(pair_id, cost, path) by Dijkstra's rule from each start; equal costs keep the smaller predecessor."""
    names, ends = np.unique(np.concatenate([arcs["a"].to_numpy(), arcs["b"].to_numpy()]), return_inverse=True)
    a, b = ends[: len(arcs)], ends[len(arcs) :]
    order = np.argsort(a, kind="stable")
    bounds = np.searchsorted(a[order], np.arange(len(names) + 1)).tolist()
    to, price = b[order].tolist(), arcs["w"].to_numpy(float)[order].tolist()
    place, out = {n: i for i, n in enumerate(names.tolist())}, []
    for start, rows in asks.groupby("start_id", sort=False):
        goals = {place[g] for g in rows["goal_id"].tolist()}
        cost, before, done, heap = {place[start]: 0.0}, {place[start]: -1}, set(), [(0.0, place[start])]
        while heap and goals - done:
            c, i = heapq.heappop(heap)
            if i in done:
                continue
            done.add(i)
            for k in range(bounds[i], bounds[i + 1]):
                j, d = to[k], c + price[k]
                known = cost.get(j)
                if known is None or d < known:
                    cost[j], before[j] = d, i
                    heapq.heappush(heap, (d, j))
                elif d == known and j not in done and i < before[j]:
                    before[j] = i
        for pair, goal in zip(rows["pair_id"].tolist(), rows["goal_id"].tolist()):
            path, i = [], place[goal]
            if i in done:
                while i >= 0:
                    path.append(names[i].item() if hasattr(names[i], "item") else names[i])
                    i = before[i]
                out.append((pair, cost[place[goal]], path[::-1]))
    return out


def least_ways(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """(pair_id, cost, path) of the pairs (pair_id, start_id, goal_id) that arcs (a, b, w) of both directions join.

    Pairs of different components leave first. The arcs of a component of at most ``MOST_ARCS``
    meet its pairs in groups of ``SHARE``; pairs of larger ones go by rounds of all pairs together.
    Joins of tables that grow with nodes or pairs are sorted, so that none is sent to the driver.
    """
    arcs = cut(arcs)
    labels = cut(min_labels(arcs.select(F.col("a").alias("node")).distinct(), arcs.select("a", "b")))
    sizes = arcs.join(labels, F.col("a") == F.col("node")).groupBy("component").agg(F.count(F.lit(1)).alias("arcs")).hint("merge")
    at = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")).hint("merge")
    asks = pairs.select("pair_id", "start_id", "goal_id").join(at("start_id"), "start_id").join(at("goal_id"), "goal_id")
    asks = cut(asks.filter("c_start_id = c_goal_id").withColumn("component", F.col("c_start_id")).join(sizes, "component"))
    pair, node = pairs.schema["pair_id"].dataType.simpleString(), pairs.schema["start_id"].dataType.simpleString()

    small = asks.filter(F.col("arcs") <= MOST_ARCS)
    groups = small.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("groups")).hint("merge")
    rows = small.join(groups, "component").withColumn("group", F.pmod(F.xxhash64("start_id"), "groups").cast("int"))
    held = arcs.join(labels, F.col("a") == F.col("node")).join(groups, "component").withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    )
    each = lambda left, right: pd.DataFrame(_search(left, right) if len(left) else [], columns=["pair_id", "cost", "path"])
    found = (
        rows.select("component", "group", "pair_id", "start_id", "goal_id").groupBy("component", "group")
        .cogroup(held.select("component", "group", "a", "b", "w").groupBy("component", "group"))
        .applyInPandas(each, f"pair_id {pair}, cost double, path array<{node}>")
    )
    same = pairs.filter("start_id = goal_id").select("pair_id", F.lit(0.0).alias("cost"), F.array("start_id").alias("path"))
    found = found.join(same.select("pair_id").hint("merge"), "pair_id", "left_anti").unionByName(same)
    large = asks.filter(F.col("arcs") > MOST_ARCS)
    if not large.isEmpty():
        found = found.unionByName(walk_back(large, relax(large, arcs)))
    return found


def shortest_paths(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair_id, cost, path) of least weight over undirected edges; nulls where there is no way."""
    return pairs.select("pair_id").join(least_ways(pairs, directed(edges)).hint("merge"), "pair_id", "left")


def shortest_paths_avoiding(pairs: DataFrame, edges: DataFrame, avoid: DataFrame, penalty: float = 9999.0) -> DataFrame:
    """Shortest paths with a penalty on entering the nodes of ``avoid``."""
    marked = avoid.select(F.col("node_id").alias("b"), F.lit(penalty).alias("extra")).hint("merge")  # grows with the nodes
    arcs = directed(edges).join(marked, "b", "left").select("a", "b", (F.col("w") + F.coalesce("extra", F.lit(0.0))).alias("w"))
    return pairs.select("pair_id").join(least_ways(pairs, arcs).hint("merge"), "pair_id", "left")


def link_shafts(nodes: DataFrame, edges: DataFrame, radius: float = 0.035, weight: float = 50.0) -> DataFrame:
    """(src, dst, weight, group_id): stairs and lifts of one kind above each other, joined floor by floor.

    A node seeds a shaft unless an earlier seed on another floor is within the radius.
    """
    rows = nodes.select("node_id", "floor_id", "floor_no", "x", "y", F.col("type").alias("kind"))
    grouped = seeded_stream(rows, ["kind"], ["node_id"], radius, True, "node_id", apart="floor_id").withColumnRenamed("seed_id", "group_id")
    w = Window.partitionBy("group_id").orderBy("floor_no", "node_id")
    links = grouped.select(F.col("node_id").alias("src"), F.lead("node_id").over(w).alias("dst"), F.lit(weight).alias("weight"), "group_id").filter("dst is not null")
    have = edges.select("src", "dst").union(edges.select("dst", "src"))
    return links.join(have, ["src", "dst"], "left_anti")
