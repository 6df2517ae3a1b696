"""Registered queries of the streaming operators, run over whole tables by the same state machines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayfarer.operators.iterate import ensure_checkpoint_dir
from wayfarer.plans.registry import now, query
from wayfarer.plans.spatial_queries import CLUSTERS, DIST, DST, FRAC, HAV, PIN, PROJ, SEGS, S
from wayfarer.sources import io
from wayfarer.streaming import device as de

#: Samples 150 ms apart for each user, so that the rule of 280 ms between steps is met.
QUICK = "SELECT user_id, event_id, {ts} AS ts, ax, ay, az, heading_raw FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM f_accel) f"
SAMPLES = QUICK.format(ts="timestamp_ntz '2024-01-01 00:00:00' + rn * interval '150' millisecond")
DUCK = QUICK.format(ts="timestamp '2024-01-01 00:00:00' + to_milliseconds(150*rn)")
STEPS = f"""WITH RECURSIVE m AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) > 1.18 AS hi FROM ({DUCK}) d), e AS (SELECT * FROM (SELECT *, lag(hi) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM m) r WHERE hi AND NOT coalesce(was, false)),
 s AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id UNION ALL SELECT s.user_id, min(e.ts) FROM s JOIN e ON e.user_id=s.user_id AND e.ts > s.ts + to_milliseconds(280) GROUP BY s.user_id, s.ts)
 SELECT e.user_id, event_id FROM s JOIN e ON e.user_id=s.user_id AND e.ts=s.ts"""
query("str1_step_detection", STEPS)(lambda t: de.step_detection(t.sql(SAMPLES)).select("user_id", "event_id"))
NEXT = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM f_accel"
query("str2_heading_smoothing", f"""WITH RECURSIVE f AS ({NEXT}), h AS (SELECT user_id, event_id, n, fmod(heading_raw,360) AS heading FROM f WHERE n=1
 UNION ALL SELECT user_id, event_id, n, CASE WHEN abs(s)<1e-9 AND abs(c)<1e-9 THEN heading ELSE fmod(degrees(atan2(s, c))+360, 360) END
  FROM (SELECT f.user_id, f.event_id, f.n, heading, 0.5*sin(radians(heading))+0.5*sin(radians(heading_raw)) AS s, 0.5*cos(radians(heading))+0.5*cos(radians(heading_raw)) AS c FROM h JOIN f ON f.user_id=h.user_id AND f.n=h.n+1) z)
 SELECT user_id, event_id, fmod(round(round(heading,9),6),360) AS heading FROM h""")(lambda t: de.heading_smoothing(t("f_accel")).select("user_id", "event_id", (F.round(F.round("heading", 9), 6) % 360).alias("heading")))
OFFSET = "CASE WHEN abs(east)<1e-9 AND abs(north)<1e-9 THEN 0.0 ELSE degrees(atan2(east,north)) END"
TURN = f"round(abs(fmod(fmod(heading_raw - {OFFSET} - bearing, 360)+360+540, 360)-180), 6)"
query("str3_dead_reckoning", f"""WITH RECURSIVE f AS (SELECT *, cast(event_id*7%360 as double) AS bearing FROM ({NEXT}) z), r AS (SELECT user_id, event_id, n, sin(radians(heading_raw-bearing)) AS east, cos(radians(heading_raw-bearing)) AS north, 0.0::DOUBLE AS dist, 'calibrating' AS move FROM f WHERE n=1
 UNION ALL SELECT user_id, event_id, n, CASE WHEN n<=8 THEN east+sin(radians(heading_raw-bearing)) ELSE east END, CASE WHEN n<=8 THEN north+cos(radians(heading_raw-bearing)) ELSE north END,
  CASE WHEN n<=8 THEN dist WHEN turn>140 THEN greatest(dist-0.75,0) WHEN turn<=90 THEN least(dist+0.75,25) ELSE dist END, CASE WHEN n<=8 THEN 'calibrating' WHEN turn>140 THEN 'back' WHEN turn<=90 THEN 'forward' ELSE 'stay' END
  FROM (SELECT f.*, r.east, r.north, r.dist, {TURN} AS turn FROM r JOIN f ON f.user_id=r.user_id AND f.n=r.n+1) z)
 SELECT user_id, event_id, dist, move FROM r""")(lambda t: de.dead_reckoning(t("f_accel").select("user_id", "event_id", "ts", F.col("heading_raw").alias("heading"), (F.col("event_id") * 7 % 360).cast("double").alias("bearing"), F.lit(25.0).alias("total"))))
LEFT = f"""{PROJ}, b AS (SELECT * FROM pm QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY m, seq)=1), tl AS (SELECT point_id, 0::BIGINT AS place, qlat AS lat, qlon AS lon FROM b UNION ALL SELECT point_id, r.seq-b.seq, r.lat, r.lon FROM b JOIN f_route_points r ON r.route_id=b.route_id AND r.seq>b.seq),
 tg AS (SELECT *, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1 FROM tl WINDOW w AS (PARTITION BY point_id ORDER BY place)), km AS (SELECT point_id, coalesce(sum({HAV.format(a='lat', b='lat1', c='lon', d='lon1')}),0)*0.621371 AS miles FROM tg GROUP BY point_id),
 gp AS (SELECT b.point_id, b.m, {HAV.format(a='plat', b='dlat', c='plon', d='dlon')}*1000 AS gap FROM b JOIN ({DST}) d ON d.route_id=b.route_id)"""
query("str4_arrival_and_reroute", f"WITH {LEFT} SELECT gp.point_id, gap<25 AS arrived, gap>=25 AND m>30 AS reroute, greatest(1, floor(miles/3.1*60+0.5))::INT AS minutes FROM gp JOIN km ON km.point_id=gp.point_id")(
    lambda t: de.arrival_and_reroute(t.sql(PIN), t("f_route_points"), t.sql(DST)).select("point_id", "arrived", "reroute", "minutes")
)
FIXES = "SELECT user_id, event_id, ts, 30.28+cast(event_id*37%997 as double)/99700 AS lat, -97.74+cast(event_id*211%991 as double)/99100 AS lon FROM events"
query("str5_preview_reroute", f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ({FIXES}) z), r AS (SELECT user_id, n, lat AS lat0, lon AS lon0, false AS flag FROM f WHERE n=1
 UNION ALL SELECT user_id, n, CASE WHEN far THEN lat ELSE lat0 END, CASE WHEN far THEN lon ELSE lon0 END, far FROM (SELECT f.*, r.lat0, r.lon0, {HAV.format(a='r.lat0', b='f.lat', c='r.lon0', d='f.lon').replace('6371', '6371000')} > 100 AS far FROM r JOIN f ON f.user_id=r.user_id AND f.n=r.n+1) z)
 SELECT user_id, sum(flag::INT)::BIGINT AS reroutes, count(*) AS fixes FROM r GROUP BY user_id""")(lambda t: de.preview_reroute(t.sql(FIXES)).groupBy("user_id").agg(F.count_if("reroute").alias("reroutes"), F.count(F.lit(1)).alias("fixes")))
query("str7_live_alert_view", f"{CLUSTERS} SELECT alert_id, cluster_id FROM c")(lambda t: de.live_view(t("f_alerts"), t("f_profiles"), t("f_votes"), now(), t("f_alerts")).select("alert_id", "cluster_id"))
query("str8_vote_upsert", "SELECT alert_id, sum((vote='confirm')::INT)::BIGINT AS confirms, sum((vote='deny')::INT)::BIGINT AS denies FROM (SELECT * FROM f_votes QUALIFY row_number() OVER (PARTITION BY alert_id, user_id ORDER BY voted_at DESC, seq DESC)=1) v GROUP BY alert_id")(
    lambda t: de.tallies_of_changes(de.vote_changes(t("f_votes")))
)
query("str9_route_alert_notice", f"""WITH s AS ({SEGS}), p AS (SELECT a.alert_id, a.submitted_by, s.*, a.x, a.y, {FRAC.format(**{**S, 'px': 'a.x', 'py': 'a.y'})} AS f FROM f_alerts a JOIN s ON a.floor_id=s.floor_id WHERE route_id%2=1), n AS (SELECT route_id, count(DISTINCT alert_id) AS n FROM p WHERE {DIST.format(**S)} < 0.04 AND viewer_id<>submitted_by GROUP BY route_id)
 SELECT route_id, n::VARCHAR || CASE WHEN n=1 THEN ' alert' ELSE ' alerts' END || ' on your route' AS title FROM n""")(
    lambda t: de.route_alert_notice(t.sql(SEGS).withColumn("seen_at", now()).withColumn("changed_at", now() - F.expr("interval 1 second") * (F.col("route_id") % 2)), t("f_alerts"))
)


def folder_of(t, name):
    """A new folder below the session's shared one."""
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def steps_of_stream(t):
    """The samples as files of no order, read in several triggers; a last sample moves the clock past the others."""
    folder = folder_of(t, "samples")
    t.sql(SAMPLES).repartition(6, F.col("event_id") % 6).write.json(f"{folder}/in")
    last = t.spark.sql("select -1L as user_id, -1L as event_id, timestamp '2034-01-01' as ts, 0d as ax, 0d as ay, 0d as az")
    last.write.mode("append").json(f"{folder}/in")
    schema = "user_id long, event_id long, ts timestamp, ax double, ay double, az double"
    samples = io.device_stream(t.spark, f"{folder}/in", schema, delay="3650 days", per_trigger=3)
    run = de.step_detection(samples).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema("user_id long, event_id long, ts timestamp_ntz").parquet(f"{folder}/out").select("user_id", "event_id")


def alerts_of_stream(t):
    """The alerts as a change stream; each trigger writes the view of the floors that it touches."""
    folder = folder_of(t, "changes")
    t("f_alerts").select("alert_id", "floor_id").write.json(f"{folder}/in")
    changes = io.change_stream(t.spark, f"{folder}/in", "alert_id long, floor_id string")
    tables = (t("f_alerts"), t("f_profiles"), t("f_votes"))
    write = lambda view, number: view.select("alert_id", "cluster_id").write.mode("overwrite").parquet(f"{folder}/out/trigger={number}")
    run = de.live_alert_stream(changes, lambda: tables, write, now()).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema("alert_id long, cluster_id long").parquet(f"{folder}/out/trigger=*").distinct()


query("src6_alert_change_stream", f"{CLUSTERS} SELECT alert_id, cluster_id FROM c")(alerts_of_stream)
query("src7_device_streams", STEPS)(steps_of_stream)
