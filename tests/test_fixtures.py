"""The views and the fixtures of the queries keep every row of their tables."""

from wayfarer.plans.fixtures import Fixtures
from wayfarer.plans.spatial_queries import NPATH, PIN

SF = "/root/testdata/sf0.001"


def test_routes_hold_every_event(spark):
    t = Fixtures(spark, SF)
    events = t("events").count()
    for name, points in (("f_route_points", 6), ("f_waypoints", 5)):
        rows = t(name).collect()
        assert len(rows) == events
        assert len({(x.route_id, x.seq) for x in rows}) == events
        assert {x.seq for x in rows} == set(range(points))
    assert {x.route_id for x in t.sql(PIN).collect()} == {x.route_id for x in t("f_route_points").collect()}


def test_every_node_is_on_a_route(spark):
    t = Fixtures(spark, SF)
    nodes = sorted(x.node_id for x in t("f_nodes").collect())
    assert sorted(x.node_id for x in t.sql(NPATH).collect()) == nodes
