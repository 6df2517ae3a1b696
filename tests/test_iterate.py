"""Loops over written tables leave only the tables that their result still reads."""

import os

import pytest

from wayfarer.operators import iterate, spatial


@pytest.fixture
def folders(monkeypatch, tmp_path):
    """The tables in a folder of this test alone."""
    monkeypatch.setattr(iterate, "ensure_checkpoint_dir", lambda spark: f"file://{tmp_path}")
    return lambda: {f for f in os.listdir(tmp_path) if f.startswith("cut-")}


def test_components_leave_one_table(spark, folders):
    edges = [(i, i + 1) for i in range(60) if i % 13] + [(70, 75), (75, 71)]
    nodes = spark.createDataFrame([(i,) for i in range(80)], "node long")
    found = iterate.min_labels(nodes, spark.createDataFrame(edges, "a long, b long"))
    assert len(folders()) <= 1
    label = list(range(80))
    for _ in range(80):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert sorted(tuple(r) for r in found.collect()) == list(enumerate(label))


def test_no_edges_leave_no_table(spark, folders):
    found = iterate.min_labels(spark.createDataFrame([(1,), (2,)], "node long"), spark.createDataFrame([], "a long, b long"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (2, 2)] and not folders()


def test_nearest_deletes_the_points_of_finished_rounds(spark, folders):
    points = spark.createDataFrame([(i, "f", float(i * i), 0.0) for i in range(30)], "point_id long, floor_id string, x double, y double")
    targets = spark.createDataFrame([(i, "f", float(i), 1.0) for i in range(9)], "target_id long, floor_id string, x double, y double")
    found = spatial.nearest(points, targets, "floor_id")
    rounds = len(folders())
    got = {r.point_id: r.target_id for r in found.collect()}
    assert got == {i: min(8, i * i) for i in range(30)}
    assert rounds <= 2 + 8  # the floors' widths, the last open points, and the pairs that each round has found
