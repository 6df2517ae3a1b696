"""Registered queries over positions, routes and proximity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfarer.operators import alerts as al
from wayfarer.operators import graph as gr
from wayfarer.operators import routes as ro
from wayfarer.operators import spatial as sp
from wayfarer.operators.iterate import cut
from wayfarer.plans.registry import now, query, r6
from wayfarer.plans.social_queries import TRUST, VOTED, voted
from wayfarer.plans.sql_parts import greedy, least_costs

PTS = "SELECT alert_id AS point_id, floor_id, x, y FROM f_alerts"
SEGS = "SELECT route_id*10+seq AS seg_id, route_id, user_id AS viewer_id, floor_id, x AS x0, y AS y0, x1, y1 FROM (SELECT *, lead(x) OVER (PARTITION BY route_id ORDER BY seq) AS x1, lead(y) OVER (PARTITION BY route_id ORDER BY seq) AS y1 FROM f_waypoints) w WHERE x1 IS NOT NULL"
DIST = "sqrt(pow({px}-({ax}+f*({bx}-{ax})),2)+pow({py}-({ay}+f*({by}-{ay})),2))"
FRAC = "coalesce(least(1.0,greatest(0.0,(({px}-{ax})*({bx}-{ax})+({py}-{ay})*({by}-{ay}))/nullif(pow({bx}-{ax},2)+pow({by}-{ay},2),0))),0)"
S = dict(px="x", py="y", ax="x0", ay="y0", bx="x1", by="y1")

SEEDED = greedy("cl", f"SELECT alert_id AS id, * FROM voted WHERE {TRUST}", "type || floor_id", "created_at", 0.06)
CLUSTERS = f"WITH RECURSIVE {VOTED}, {SEEDED}, c AS (SELECT v.*, cl.seed_id AS cluster_id FROM voted v JOIN cl ON cl.id=v.alert_id)"
clustered = lambda t: sp.alert_clusters(al.alert_trust_filter(voted(t)))
query("agg5_cluster_summary",
    f"""{CLUSTERS} SELECT cluster_id, type, floor_id, round(avg(x),6) AS x, round(avg(y),6) AS y, max(created_at) AS created_at, max(expires_at) AS expires_at, sum(confirms)::BIGINT AS confirms, sum(denies)::BIGINT AS denies,
 array_to_string(list_sort(list_distinct(list(submitted_by))), ',') AS submitters, array_to_string(list_sort(list(alert_id)), ',') AS members, max(CASE WHEN alert_id=cluster_id THEN 'note ' || (alert_id%7)::VARCHAR END) AS description FROM c GROUP BY cluster_id, type, floor_id""")(
    lambda t: r6(sp.cluster_summary(clustered(t).withColumn("description", F.concat(F.lit("note "), (F.col("alert_id") % 7).cast("string")))), "x", "y").withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("submitters", "members")})
)
query("gra10_alert_clusters", f"{CLUSTERS} SELECT alert_id, cluster_id FROM c")(lambda t: clustered(t).select("alert_id", "cluster_id"))
DETK = "SELECT det_id AS id, floor_id, conf, x, y FROM f_detections"
query("gra9_seeded_radius_groups", f"WITH RECURSIVE {greedy('g', DETK, 'floor_id', 'conf', 0.03)} SELECT id AS det_id, seed_id FROM g")(
    lambda t: sp.seeded_radius_groups(t("f_detections"), ["floor_id"], ["conf"], 0.03, True, "det_id").select("det_id", "seed_id")
)
query("joi30_cluster_viewer_flags", f"""{CLUSTERS}, vw AS (SELECT DISTINCT cluster_id, submitted_by + alert_id%2 AS viewer_id FROM c), n AS (SELECT cluster_id, count(*) AS reports FROM c GROUP BY cluster_id)
 SELECT vw.cluster_id, viewer_id, EXISTS (SELECT 1 FROM c WHERE c.cluster_id=vw.cluster_id AND c.submitted_by=viewer_id) AS own, l.vote, reports FROM vw JOIN n ON n.cluster_id=vw.cluster_id LEFT JOIN last l ON l.alert_id=vw.cluster_id AND l.user_id=viewer_id""")(lambda t: clusters_for_viewers(t))


def clusters_for_viewers(t):
    m = clustered(t).select("cluster_id", "alert_id", "submitted_by")
    leads = m.select("cluster_id", F.col("cluster_id").alias("lead_id")).distinct()  # a cluster is named by its oldest alert
    viewers = m.select("cluster_id", (F.col("submitted_by") + F.col("alert_id") % 2).alias("viewer_id")).distinct()
    return al.cluster_viewer_flags(m, leads, t("f_votes"), viewers)


query("joi16_alerts_on_route",
    f"""WITH s AS ({SEGS}), p AS (SELECT a.alert_id, a.submitted_by, s.*, a.x, a.y, {FRAC.format(**{**S, 'px': 'a.x', 'py': 'a.y'})} AS f FROM f_alerts a JOIN s ON a.floor_id=s.floor_id) SELECT DISTINCT route_id, alert_id FROM p WHERE {DIST.format(**S)} < 0.04 AND viewer_id<>submitted_by""")(
    lambda t: sp.alerts_on_route(t("f_alerts"), t.sql(SEGS))
)
NEAR = "SELECT point_id, node_id, round(sqrt(d),6) AS dist FROM (SELECT point_id, node_id, pow(p.x-n.x,2)+pow(p.y-n.y,2) AS d FROM ({p}) p JOIN ({n}) n ON p.floor_id=n.floor_id) q QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, node_id)=1"
query("joi17_nearest_node", NEAR.format(p=PTS, n="SELECT * FROM f_nodes WHERE type='room'"))(lambda t: r6(sp.nearest_node(t.sql(PTS), t("f_nodes"), kind="room"), "dist"))
query("joi18_snap_to_grid", NEAR.format(p=PTS, n="SELECT * FROM f_nodes WHERE node_id%3=0").replace("round(sqrt(d),6)", "round(sqrt(d),2)"))(
    lambda t: sp.snap_to_grid(t.sql(PTS), t("f_nodes"), t("f_nodes").filter("node_id % 3 = 0"))
)
CELLP = "SELECT s_suppkey*10+k.k AS point_id, s_suppkey AS floor_id, s_suppkey*13%48 AS x, k.k*5 AS y FROM supplier, range(10) AS k(k) WHERE s_suppkey%10=0"
query("joi19_snap_to_passable",
    f"SELECT point_id, cx AS sx, cy AS sy FROM (SELECT point_id, c.x AS cx, c.y AS cy, greatest(abs(c.x-p.x),abs(c.y-p.y)) AS ring FROM ({CELLP}) p JOIN f_cells c ON p.floor_id=c.floor_id AND c.passable=1) q QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY ring, cy, cx)=1")(
    lambda t: sp.snap_to_passable(t.sql(CELLP), t("f_cells")).select("point_id", "sx", "sy")
)
query("joi23_edge_lookup", "WITH b AS (SELECT src, dst, weight, inter_floor FROM f_edges UNION ALL SELECT dst, src, weight, inter_floor FROM f_edges) SELECT n.node_id AS src, n.node_id+7 AS dst, min(weight) AS weight FROM f_nodes n JOIN b ON b.src=n.node_id AND b.dst=n.node_id+7 GROUP BY ALL UNION ALL SELECT n.node_id, n.node_id-70, min(weight) FROM f_nodes n JOIN b ON b.src=n.node_id AND b.dst=n.node_id-70 GROUP BY ALL")(
    lambda t: ro.edge_lookup(t("f_nodes").select(F.col("node_id").alias("src"), F.explode(F.array(F.col("node_id") + 7, F.col("node_id") - 70)).alias("dst")), t("f_edges")).select("src", "dst", "weight")
)
LAT_SPARK = "SELECT floor_id*10000+y*100+x AS node_id, floor_id, x, y FROM f_cells WHERE x%6=0 AND y%6=0 AND passable=1"
query("joi24_lattice_edges", f"WITH p AS ({LAT_SPARK}) SELECT a.node_id AS src, b.node_id AS dst, 6.0::DOUBLE AS weight FROM p a JOIN p b ON a.floor_id=b.floor_id AND ((b.x=a.x+6 AND b.y=a.y) OR (b.x=a.x AND b.y=a.y+6))")(
    lambda t: sp.lattice_edges(t.sql(LAT_SPARK), 6)
)
DOOR = "SELECT s_suppkey AS point_id, floor_id, x0 + cast(s_suppkey%9 as double) AS x, y0 + cast(s_suppkey%7 as double) AS y FROM (SELECT seg_id AS s_suppkey, floor_id, x0, y0 FROM f_walls) w"
query("joi25_near_wall_filter", f"WITH p AS ({DOOR}), j AS (SELECT p.point_id, x, y, w.*, {FRAC.format(**S)} AS f FROM p JOIN f_walls w ON p.floor_id=w.floor_id) SELECT DISTINCT point_id FROM j WHERE {DIST.format(**S)} <= 5")(
    lambda t: sp.near_wall_filter(t.sql(DOOR), t("f_walls")).select("point_id")
)
CLEAN = "CASE WHEN regexp_matches(t, '^\\d\\.\\d{4,}$') THEN left(t,5) || CASE substr(t,6) WHEN '4' THEN 'A' WHEN '8' THEN 'B' WHEN '0' THEN 'D' ELSE '' END WHEN regexp_matches(t, '^\\d\\d{3,4}[A-Za-z]?$') THEN left(t,1)||'.'||substr(t,2) ELSE t END"
DET = f"det AS (SELECT *, {CLEAN} AS label FROM (SELECT *, replace(replace(trim(raw_text),',','.'),' ','') AS t FROM f_detections) d)"
GOOD = "regexp_matches(label, '^\\d\\.\\d{3,}[A-Za-z]?$') AND starts_with(label, floor_num::VARCHAR) AND conf>=0.15"
from wayfarer.functions.scalars import clean_detected_text  # noqa: E402

cleaned = lambda t: t("f_detections").withColumn("label", clean_detected_text("raw_text"))
query("fil13_room_label_filter", f"WITH {DET} SELECT det_id, label FROM det WHERE {GOOD}")(lambda t: sp.room_label_filter(cleaned(t)).select("det_id", "label"))
SIGN = "SELECT det_id, CASE det_id%14 WHEN 0 THEN ' Stw ' WHEN 1 THEN 's12' WHEN 2 THEN 'E3' WHEN 3 THEN 'LIFT' WHEN 4 THEN 'stairs' WHEN 5 THEN 'Elevat' WHEN 6 THEN 's' WHEN 7 THEN 'e1x' WHEN 8 THEN 'stairwell' WHEN 9 THEN 'ELV' WHEN 10 THEN 'the lift' ELSE raw_text END AS raw_text FROM f_detections"
query("fil14_transport_label_classify", f"""SELECT det_id, CASE WHEN lower(trim(raw_text)) IN ('stair','stairs','stairwell','stw') OR (left(lower(trim(raw_text)),1)='s' AND try_cast(substr(trim(raw_text),2) AS BIGINT) IS NOT NULL) THEN 'stairwell'
 WHEN lower(trim(raw_text)) IN ('elev','elevator','elevat','elv','lift') OR (left(lower(trim(raw_text)),1)='e' AND try_cast(substr(trim(raw_text),2) AS BIGINT) IS NOT NULL) THEN 'elevator' END AS kind FROM ({SIGN}) d""")(
    lambda t: t.sql(SIGN).select("det_id", sp.transport_kind(F.col("raw_text")).alias("kind"))
)
query("agg8_best_detection_per_label", f"WITH {DET} SELECT floor_id, label, det_id, round(conf,6) AS conf FROM det WHERE {GOOD} QUALIFY row_number() OVER (PARTITION BY floor_id, label ORDER BY conf DESC, det_id)=1")(
    lambda t: r6(sp.best_detection(sp.room_label_filter(cleaned(t))).select("floor_id", "label", "det_id", "conf"), "conf")
)
HALF = "SELECT det_id, floor_id, label, x, y, conf FROM det WHERE det_id%2={i}"
SET4 = f"""{DET}, a AS ({HALF.format(i=0)}), b AS ({HALF.format(i=1)}), lft AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.floor_id=b.floor_id AND (a.label=b.label OR sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))<0.015))),
 {greedy('g', 'SELECT det_id AS id, floor_id, conf, x, y FROM lft', 'floor_id', '-conf', 0.015)}"""
query("set4_merge_detections", f"WITH RECURSIVE {SET4} SELECT det_id, floor_id, label FROM a UNION ALL SELECT det_id, floor_id, label FROM lft WHERE det_id IN (SELECT seed_id FROM g)")(
    lambda t: sp.merge_detections(*(cleaned(t).filter(f"det_id % 2 = {i}").select("det_id", "floor_id", "label", "x", "y", "conf") for i in (0, 1))).select("det_id", "floor_id", "label")
)
ROOMS = f"""{DET}, best AS (SELECT * FROM det WHERE {GOOD} QUALIFY row_number() OVER (PARTITION BY floor_id, label ORDER BY conf DESC, det_id)=1),
 {greedy('g', 'SELECT det_id AS id, floor_id, conf, x, y FROM best', 'floor_id', '-conf', 0.015)}, rooms AS (SELECT det_id, floor_id, label, x, y, 'room' AS type FROM best WHERE det_id IN (SELECT seed_id FROM g)),
 lf AS (SELECT *, CASE raw_text WHEN 'STAIR' THEN 'stairwell' WHEN 'ELEV' THEN 'elevator' END AS type FROM f_detections WHERE raw_text IN ('STAIR','ELEV')),
 {greedy('h', 'SELECT det_id AS id, floor_id, type, x, y FROM lf', 'floor_id || type', 'id', 0.015)},
 nodes AS (SELECT * FROM rooms UNION ALL SELECT det_id, floor_id, raw_text, x, y, type FROM lf WHERE det_id IN (SELECT seed_id FROM h) AND NOT EXISTS (SELECT 1 FROM rooms r WHERE r.floor_id=lf.floor_id AND sqrt(pow(r.x-lf.x,2)+pow(r.y-lf.y,2))<0.015))"""
query("gra22_room_nodes_pipeline", f"WITH RECURSIVE {ROOMS} SELECT det_id, floor_id, label, type FROM nodes")(lambda t: sp.room_nodes(t("f_detections")).select("det_id", "floor_id", "label", "type"))
query("agg12_bounding_box", "SELECT user_id, max(lat) AS north, min(lat) AS south, max(lon) AS east, min(lon) AS west FROM f_pings GROUP BY user_id")(lambda t: sp.bounding_box(t("f_pings"), "user_id"))
ARCS = "SELECT l_orderkey*10+l_linenumber AS arc_id, 'f' || cast(l_suppkey%70 as varchar(2)) AS floor_id, cast(l_suppkey*37%97 as double) + 0.5*cast(l_linenumber as double) AS x, cast(l_suppkey*211%91 as double) AS y FROM lineitem WHERE l_linenumber<5"
query("agg13_door_arc_counts", f"WITH RECURSIVE {greedy('g', f'SELECT arc_id AS id, floor_id, x, y FROM ({ARCS}) a', 'floor_id', 'id', 5)} SELECT seed_id AS center_id, count(*) AS arcs, count(*)<=2 AS is_door FROM g GROUP BY seed_id")(
    lambda t: sp.door_arc_counts(t.sql(ARCS))
)
WRAP = """p AS (SELECT DISTINCT floor_id, x, y FROM f_nodes WHERE type='room'), h0 AS (SELECT floor_id, x, y FROM p QUALIFY row_number() OVER (PARTITION BY floor_id ORDER BY x, y)=1),
 h AS (SELECT floor_id, x, y, x AS sx, y AS sy, -pi()/2 AS dir, 0 AS n FROM h0 UNION ALL SELECT floor_id, t.x, t.y, sx, sy, dir + t.turn, n+1 FROM (
  SELECT h.floor_id, h.sx, h.sy, h.dir, h.n, min({'turn': round(fmod(atan2(p.y-h.y, p.x-h.x) - h.dir + 8*pi(), 2*pi()), 9), 'far': -(pow(p.x-h.x,2)+pow(p.y-h.y,2)), 'x': p.x, 'y': p.y}) AS t
  FROM h JOIN p ON p.floor_id=h.floor_id AND (p.x<>h.x OR p.y<>h.y) WHERE n < (SELECT count(*) FROM p) AND (n=0 OR h.x<>h.sx OR h.y<>h.sy) GROUP BY ALL) z)"""
query("agg15_convex_hull", f"WITH RECURSIVE {WRAP} SELECT DISTINCT floor_id, round(x,6) AS x, round(y,6) AS y FROM h")(
    lambda t: r6(sp.convex_hulls(t("f_nodes").filter("type = 'room'")).select("floor_id", F.explode("hull").alias("p")).select("floor_id", "p.x", "p.y"), "x", "y")
)
query("fil11_wall_segment_filter", "SELECT seg_id FROM f_walls WHERE sqrt(pow(x1-x0,2)+pow(y1-y0,2))>=5 AND NOT ((abs(y1-y0)<2 AND abs(x1-x0)>700) OR (abs(x1-x0)<2 AND abs(y1-y0)>700))")(
    lambda t: sp.wall_segments(t("f_walls"), 1000, 1000).select("seg_id")
)
RULED = "SELECT seg_id, floor_id, x0, y0, CASE WHEN seg_id%10=7 THEN x0+4000 ELSE x1 END AS x1, CASE WHEN seg_id%10=7 THEN y0+cast(seg_id%20 as double)/10 ELSE y1 END AS y1 FROM f_walls"
query("fil12_annotation_line_outliers", f"WITH s AS (SELECT *, sqrt(pow(x1-x0,2)+pow(y1-y0,2)) AS len FROM ({RULED}) w), m AS (SELECT floor_id, median(len) AS mid FROM s GROUP BY floor_id) SELECT seg_id, round(len,6) AS len FROM s JOIN m USING (floor_id) WHERE (abs(x1-x0)<2 OR abs(y1-y0)<2) AND len>=greatest(150.0, 4*mid)")(
    lambda t: r6(sp.annotation_outliers(t.sql(RULED)).select("seg_id", "len"), "len")
)
query("sca18_door_signature")(lambda t: door_paths(t))


def door_paths(t):
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    w = t("f_walls").withColumn("r", (4 + F.col("seg_id") % 60).cast("double")).withColumns({"cx": F.col("x0"), "cy": F.col("y0")})
    cx, cy, r = F.col("cx"), F.col("cy"), F.col("r")
    curve = F.array(p(cx + r, cy), p(cx + r, cy + 0.5523 * r), p(cx + 0.5523 * r, cy + r), p(cx, cy + r))
    items = w.select("seg_id", "floor_id", F.lit("curve").alias("kind"), curve.alias("points")).union(w.select("seg_id", "floor_id", F.lit("line"), F.array(p(cx, cy), p(cx, cy + r))))
    return sp.door_signature(items.withColumnRenamed("seg_id", "path_id"), t("f_walls")).select("path_id", F.round("r", 4).alias("r"))


ISO = "SELECT * FROM f_nodes"
query("top4_nearest_candidates", f"SELECT node_id, other_id, row_number() OVER (PARTITION BY node_id ORDER BY d, other_id) AS place FROM (SELECT a.node_id, b.node_id AS other_id, round(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)),9) AS d FROM ({ISO}) a JOIN f_nodes b ON a.floor_id=b.floor_id AND a.node_id<>b.node_id) q QUALIFY place<=5")(
    lambda t: sp.nearest_candidates(t("f_nodes"), t.sql(ISO))
)

# routes
CUM = "m AS (SELECT *, sum(coalesce(sqrt(pow((x-px)*100,2)+pow((y-py)*80,2)),0)) OVER (PARTITION BY route_id ORDER BY seq) AS cum FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM f_waypoints WINDOW w AS (PARTITION BY route_id ORDER BY seq)) a)"
measured = lambda t: ro.cumulative_distance(t("f_waypoints"))
query("win3_path_cumulative_distance", f"WITH {CUM} SELECT route_id, seq, round(cum,6) AS cum FROM m")(lambda t: r6(measured(t).select("route_id", "seq", "cum"), "cum"))
REP = "SELECT route_id, seq, cast(floor(seq/2) + case when route_id%5=0 then -floor(seq/2) else 0 end as double) AS lat, cast(1 as double) AS lon FROM f_route_points"
query("win4_drop_repeat_points", f"SELECT route_id, seq, lat FROM (SELECT *, count(*) OVER (PARTITION BY route_id) AS n FROM (SELECT *, lag(lat) OVER (PARTITION BY route_id ORDER BY seq) AS pl FROM ({REP}) r) a WHERE pl IS NULL OR pl<>lat) b WHERE n>=2")(
    lambda t: ro.drop_repeat_points(t.sql(REP)).select("route_id", "seq", "lat")
)
AT = "SELECT route_id AS query_id, route_id, cast(route_id%200 as double) AS dist FROM (SELECT DISTINCT route_id FROM f_waypoints) r"
BR = "s AS (SELECT *, lead(cum) OVER w AS d1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(floor_id) OVER w AS floor1, max(cum) OVER (PARTITION BY route_id) AS total, lead(seq,2) OVER w IS NULL AS lst FROM m WINDOW w AS (PARTITION BY route_id ORDER BY seq))"


def pos(extra):
    return f"SELECT q.query_id, s.*, least(dist+{extra}, total) AS d, CASE WHEN d1-cum<0.001 THEN 1.0 ELSE (least(dist+{extra},total)-cum)/(d1-cum) END AS t FROM ({AT}) q JOIN s ON q.route_id=s.route_id WHERE d1 IS NOT NULL AND least(dist+{extra},total)>=cum AND (least(dist+{extra},total)<d1 OR lst)"


query("win5_position_at_distance", f"WITH {CUM}, {BR}, p AS ({pos(0)}) SELECT query_id, round(x+(x1-x)*t,6) AS x, round(y+(y1-y)*t,6) AS y, CASE WHEN t<0.5 THEN floor_id ELSE floor1 END AS floor_id FROM p")(
    lambda t: r6(ro.position_at_distance(measured(t), t.sql(AT)).drop("route_id"), "x", "y")
)
query("win6_path_direction", f"WITH {CUM}, {BR}, p AS ({pos(0)}), z AS ({pos(3)}), g AS (SELECT p.query_id, (z.x+(z.x1-z.x)*z.t-p.x-(p.x1-p.x)*p.t)*100 AS dx, (z.y+(z.y1-z.y)*z.t-p.y-(p.y1-p.y)*p.t)*80 AS dy FROM p JOIN z USING (query_id)) SELECT query_id, CASE WHEN abs(dx)>=1e-6 OR abs(dy)>=1e-6 THEN round((degrees(atan2(dy,dx))+360)%360,4) END AS degrees FROM g")(
    lambda t: ro.path_direction(measured(t), t.sql(AT)).withColumn("degrees", F.round("degrees", 4))
)
HAV = "2*6371*atan2(sqrt(pow(sin(radians({b}-{a})/2),2)+cos(radians({a}))*cos(radians({b}))*pow(sin(radians({d}-{c})/2),2)), sqrt(1-(pow(sin(radians({b}-{a})/2),2)+cos(radians({a}))*cos(radians({b}))*pow(sin(radians({d}-{c})/2),2))))"
GEO = "g AS (SELECT *, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1 FROM f_route_points WINDOW w AS (PARTITION BY route_id ORDER BY seq))"
query("win14_polyline_length", f"WITH {GEO} SELECT route_id, round(coalesce(sum({HAV.format(a='lat', b='lat1', c='lon', d='lon1')}),0),6) AS km FROM g GROUP BY route_id")(lambda t: r6(ro.polyline_length(t("f_route_points")), "km"))
PIN = "SELECT route_id AS point_id, route_id, max(lat)+0.0005 AS plat, min(lon)-0.0003 AS plon FROM f_route_points GROUP BY route_id"
PROJ = f"""{GEO}, pj AS (SELECT p.point_id, p.route_id, plat, plon, seq, lat, lon, coalesce(lat1,lat) AS lat1, coalesce(lon1,lon) AS lon1, count(*) OVER (PARTITION BY p.point_id) AS n, g.lat1 IS NULL AS lst FROM ({PIN}) p JOIN g ON p.route_id=g.route_id),
 pf AS (SELECT *, coalesce(least(1.0,greatest(0.0,((plon-lon)*(lon1-lon)+(plat-lat)*(lat1-lat))/nullif(pow(lon1-lon,2)+pow(lat1-lat,2),0))),0) AS f FROM pj WHERE NOT lst OR n=1), pq AS (SELECT *, lat+f*(lat1-lat) AS qlat, lon+f*(lon1-lon) AS qlon FROM pf), pm AS (SELECT *, {HAV.format(a='plat', b='qlat', c='plon', d='qlon')}*1000 AS m FROM pq)"""
query("win15_point_to_polyline", f"WITH {PROJ} SELECT point_id, round(min(m),4) AS metres FROM pm GROUP BY point_id")(lambda t: ro.point_to_polyline(t.sql(PIN), t("f_route_points")).withColumn("metres", F.round("metres", 4)))
query("win16_trim_route", f"WITH {PROJ}, b AS (SELECT * FROM pm QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY m, seq)=1) SELECT point_id, 0::BIGINT AS place, round(qlat,6) AS lat, round(qlon,6) AS lon FROM b UNION ALL SELECT point_id, (r.seq-b.seq)::BIGINT, round(r.lat,6), round(r.lon,6) FROM b JOIN f_route_points r ON r.route_id=b.route_id AND r.seq>b.seq")(
    lambda t: r6(ro.trim_route(t.sql(PIN), t("f_route_points")), "lat", "lon")
)
DST = "SELECT route_id, max(lat) AS dlat, min(lon) AS dlon FROM f_route_points GROUP BY route_id"
query("sca24_destination_connector", f"WITH l AS (SELECT route_id, arg_max(lat, seq) AS lat, arg_max(lon, seq) AS lon FROM f_route_points GROUP BY route_id) SELECT l.route_id, round(lat,6) AS lat, round(dlat,6) AS dlat FROM l JOIN ({DST}) d ON l.route_id=d.route_id WHERE sqrt(pow(lat-dlat,2)+pow(lon-dlon,2))>=0.000009")(
    lambda t: r6(ro.destination_connector(t("f_route_points"), t.sql(DST)).select("route_id", "lat", "dlat"), "lat", "dlat")
)
LINE = "SELECT floor_id*100+r AS route_id, x AS seq, x, cast(floor(y/2) as bigint) AS y FROM (SELECT floor_id, y AS r, x, CASE WHEN x<20+y%9 THEN y ELSE y+x-18-y%9 END AS y FROM f_cells) c"
query("win13_collinear_simplify", f"WITH p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM ({LINE}) l WINDOW w AS (PARTITION BY route_id ORDER BY seq)) SELECT route_id, seq, x, y FROM p WHERE px IS NULL OR nx IS NULL OR (x-px)*(ny-y)-(y-py)*(nx-x)<>0")(
    lambda t: ro.collinear_simplify(t.sql(LINE))
)
NPATH = "SELECT node_id - node_id%4 AS route_id, node_id%4 AS seq, node_id FROM f_nodes"
HOPEDGE = "SELECT node_id AS src, node_id+1 AS dst, cast(1 as double) AS weight, node_id%4=1 OR (node_id%4=0 AND node_id%100=0) AS inter_floor FROM f_nodes WHERE node_id%4<3"
FLOORS = "SELECT DISTINCT floor_id, 'Floor ' || floor_id AS name FROM f_nodes"
segs = lambda t: ro.route_segments(t.sql(NPATH), t("f_nodes"), t.sql(HOPEDGE), t.sql(FLOORS))
SEGSQL = f"""n AS (SELECT p.*, floor_id, label, type FROM ({NPATH}) p JOIN f_nodes USING (node_id)), w AS (SELECT route_id, max(CASE WHEN seq=0 THEN floor_id END) f0, max(CASE WHEN seq=1 THEN floor_id END) f1, max(CASE WHEN seq=2 THEN floor_id END) f2, max(CASE WHEN seq=3 THEN label END) l3, max(CASE WHEN seq=0 THEN type END) t0, max(CASE WHEN seq=1 THEN type END) t1, route_id%100=0 AS two FROM n GROUP BY route_id),
 k AS (SELECT *, CASE WHEN two THEN CASE WHEN t0='elevator' THEN 'elevator' ELSE 'stairs' END ELSE CASE WHEN t1='elevator' THEN 'elevator' ELSE 'stairs' END END AS kind FROM w),
 segs AS (SELECT route_id, 0::BIGINT AS part, f0 AS floor_id, CASE WHEN two THEN 1 ELSE 2 END::BIGINT AS points, 'Walk to the '||kind AS instruction FROM k UNION ALL SELECT route_id, 1, f0, 0, 'Take the '||kind||' to Floor '||f2 FROM k UNION ALL SELECT route_id, 2, f2, 2, 'Walk to room '||l3 FROM k)"""
query("win12_route_segments", f"WITH {SEGSQL} SELECT * FROM segs")(lambda t: segs(t).withColumn("part", F.col("part").cast("long")))
query("fil18_segments_on_floor", f"WITH {SEGSQL} SELECT route_id, floor_id, count(*) AS parts FROM segs WHERE points>0 GROUP BY route_id, floor_id")(lambda t: ro.segments_on_floor(segs(t)))
TRA = "SELECT cast(floor(node_id/7) as bigint)%40 AS transport_id, floor_id, max(x) AS x, max(y) AS y, CASE WHEN cast(floor(node_id/7) as bigint)%2=0 THEN 'elevator' ELSE 'stairs' END AS kind FROM f_nodes WHERE node_id%11<4 GROUP BY cast(floor(node_id/7) as bigint)%40, cast(floor(node_id/7) as bigint)%2, floor_id"
DEG = "deg AS (SELECT n AS node_id, count(*) AS degree FROM (SELECT src AS n FROM f_edges WHERE src%3<>0 UNION ALL SELECT dst FROM f_edges WHERE src%3<>0) e GROUP BY n)"
RDIST = f"rm AS (SELECT tr.transport_id, tr.floor_id, n.node_id, coalesce(degree,0)>0 AS linked, sqrt(pow(n.x-tr.x,2)+pow(n.y-tr.y,2)) AS d FROM ({TRA}) tr JOIN f_nodes n ON tr.floor_id=n.floor_id AND n.type='room' LEFT JOIN deg ON deg.node_id=n.node_id), ra AS (SELECT *, bool_or(linked) OVER (PARTITION BY floor_id) AS anyl FROM rm)"
RLINK = "rl AS (SELECT transport_id, floor_id, node_id, d FROM (SELECT *, row_number() OVER (PARTITION BY transport_id, floor_id ORDER BY d, node_id) AS rn FROM ra WHERE linked OR NOT anyl) z WHERE rn<=4 AND d<=0.22)"
degrees = lambda t: gr.node_degree(t("f_edges").filter("src % 3 <> 0"))
room_links = lambda t: ro.transport_room_links(t.sql(TRA), t("f_nodes"), degrees(t))
query("win17_transport_room_links", f"WITH {DEG}, {RDIST}, {RLINK} SELECT transport_id, floor_id, node_id, round(200+d*300,1) AS weight FROM rl")(lambda t: room_links(t))
query("win18_transport_bridge_links",
    f"""WITH {DEG}, {RDIST}, {RLINK}, cc AS (SELECT node_id, node_id%11 AS component FROM f_nodes), rc AS (SELECT DISTINCT transport_id, component FROM rl JOIN cc USING (node_id)) SELECT transport_id, floor_id, component, node_id, round(200+d*300,1) AS weight
 FROM (SELECT ra.*, component FROM ra JOIN cc USING (node_id) WHERE linked AND NOT EXISTS (SELECT 1 FROM rc WHERE rc.transport_id=ra.transport_id AND rc.component=cc.component)) q QUALIFY row_number() OVER (PARTITION BY transport_id, floor_id, component ORDER BY d, node_id)=1 AND d<=0.22*1.5""")(
    lambda t: ro.transport_bridge_links(t.sql(TRA), t("f_nodes"), degrees(t), t("f_nodes").select("node_id", (F.col("node_id") % 11).alias("component")), room_links(t))
)
query("win19_transport_interfloor_edges", f"SELECT * FROM (SELECT transport_id, floor_id AS floor_a, lead(floor_id) OVER (PARTITION BY transport_id ORDER BY floor_id) AS floor_b, CASE WHEN kind='elevator' THEN 5.0 ELSE 500.0 END::DOUBLE AS weight FROM ({TRA}) t) z WHERE floor_b IS NOT NULL")(
    lambda t: ro.transport_interfloor_edges(t.sql(TRA))
)

# graph
query("agg6_node_degree", "SELECT n AS node_id, count(*) AS degree FROM (SELECT src AS n FROM f_edges UNION ALL SELECT dst FROM f_edges) e GROUP BY n")(lambda t: gr.node_degree(t("f_edges")))
query("agg7_floor_entrance", "WITH d AS (SELECT n AS node_id, count(*) AS degree FROM (SELECT src AS n FROM f_edges UNION ALL SELECT dst FROM f_edges) e GROUP BY n) SELECT floor_id, n.node_id FROM f_nodes n LEFT JOIN d ON n.node_id=d.node_id QUALIFY row_number() OVER (PARTITION BY floor_id ORDER BY CASE type WHEN 'entrance' THEN 0 WHEN 'door' THEN 1 ELSE 2 END, CASE WHEN type IN ('entrance','door') THEN 0 ELSE -coalesce(degree,0) END, n.node_id)=1")(
    lambda t: gr.floor_entrance(t("f_nodes"), t("f_edges"))
)
query("agg14_graph_meta_counts", "WITH e AS (SELECT floor_id, count(*) AS edges, sum(inter_floor::INT)::BIGINT AS inter FROM f_edges JOIN f_nodes ON src=node_id GROUP BY floor_id), n AS (SELECT floor_id, count(*) AS nodes, sum((type='room')::INT)::BIGINT AS rooms FROM f_nodes GROUP BY floor_id) SELECT floor_id, nodes, rooms, coalesce(edges,0) AS edges, coalesce(inter,0) AS inter_floor FROM n LEFT JOIN e USING (floor_id) UNION ALL SELECT NULL, sum(nodes)::BIGINT, sum(rooms)::BIGINT, sum(edges)::BIGINT, sum(inter)::BIGINT FROM n LEFT JOIN e USING (floor_id)")(
    lambda t: gr.graph_meta_counts(t("f_nodes"), t("f_edges"))
)
FEW = "f_nodes"
EDG = "SELECT src AS a, dst AS b FROM f_edges WHERE NOT inter_floor"
CC = f"""r AS (SELECT node_id AS node, node_id AS seen FROM {FEW} UNION SELECT r.node, e.b FROM r JOIN (SELECT a, b FROM ({EDG}) x UNION ALL SELECT b, a FROM ({EDG}) y) e ON r.seen=e.a), cc AS (SELECT node AS node_id, min(seen) AS component FROM r GROUP BY node)"""
comps = lambda t: gr.connected_components(t("f_nodes"), t("f_edges"))
query("gra1_connected_components", f"WITH RECURSIVE {CC} SELECT * FROM cc")(comps)
query("gra2_largest_component", f"WITH RECURSIVE {CC} SELECT node_id FROM cc WHERE component=(SELECT component FROM cc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)")(lambda t: gr.largest_component(comps(t)).select("node_id"))
PAIRS = "SELECT node_id AS pair_id, node_id AS start_id, node_id+7*(1+node_id%4) AS goal_id FROM f_nodes WHERE node_id%50=0"
UNDIRECTED = "SELECT a, b, min(w) AS w FROM (SELECT src AS a, dst AS b, weight AS w FROM f_edges UNION ALL SELECT dst, src, weight FROM f_edges) e GROUP BY a, b"
COSTS = "SELECT p.pair_id, round(d.cost,6) AS cost, round(d.cost,6) AS path_cost FROM ({p}) p LEFT JOIN d ON d.pair_id=p.pair_id AND d.spot=p.goal_id"
STARTS = f"SELECT pair_id, start_id AS spot FROM ({PAIRS}) p"


def with_path_cost(found, arcs):
    """The cost beside the sum of the weights along the path, so that the path itself is compared."""
    found = cut(found)  # the search runs once
    hop = found.select("pair_id", F.posexplode("path").alias("i", "b")).withColumn("a", F.lag("b").over(Window.partitionBy("pair_id").orderBy("i")))
    along = hop.join(arcs.hint("merge"), ["a", "b"], "left").groupBy("pair_id").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("path_cost"))
    return r6(found.select("pair_id", "cost").join(along.hint("merge"), "pair_id", "left"), "cost", "path_cost")


#: The ids divisible by 50, and the starts that this query had before.
PAIRS4 = f"{PAIRS} OR node_id%35=3"
query("gra4_shortest_paths", f"WITH RECURSIVE {least_costs('d', f'SELECT pair_id, start_id AS spot FROM ({PAIRS4}) p', UNDIRECTED)} {COSTS.format(p=PAIRS4)}")(
    lambda t: with_path_cost(gr.shortest_paths(t.sql(PAIRS4), t("f_edges")), gr.directed(t("f_edges")))
)
STAIRS = f"SELECT a, b, w + CASE WHEN n.type='stairwell' THEN 9999.0 ELSE 0 END AS w FROM ({UNDIRECTED}) u JOIN f_nodes n ON n.node_id=u.b"
stairs = lambda t: t.sql(STAIRS.replace("SELECT", "SELECT /*+ MERGE(n) */", 1))  # all nodes are too many to broadcast
query("gra5_shortest_paths_penalty", f"WITH RECURSIVE {least_costs('d', STARTS, STAIRS)} {COSTS.format(p=PAIRS)}")(
    lambda t: with_path_cost(gr.shortest_paths_avoiding(t.sql(PAIRS), t("f_edges"), t("f_nodes").filter("type = 'stairwell'").select("node_id")), stairs(t))
)
SHAFT = "SELECT node_id AS id, floor_id, floor_no, type, x, y FROM f_nodes WHERE type IN ('elevator','stairwell')"
query("gra11_link_shafts", f"""WITH RECURSIVE {greedy('g', SHAFT, 'type', 'id', 0.2, 'floor_id')}, l AS (SELECT n.id AS src, lead(n.id) OVER (PARTITION BY seed_id ORDER BY floor_no, n.id) AS dst, seed_id AS group_id FROM g JOIN ({SHAFT}) n ON n.id=g.id)
 SELECT src, dst, group_id FROM l WHERE dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f_edges e WHERE (e.src=l.src AND e.dst=l.dst) OR (e.src=l.dst AND e.dst=l.src))""")(
    lambda t: gr.link_shafts(t("f_nodes").filter("type in ('elevator', 'stairwell')"), t("f_edges"), 0.2).select("src", "dst", "group_id")
)
