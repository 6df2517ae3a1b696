"""Registered queries of streams over several triggers; the SQL says what the whole feed amounts to."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayfarer.operators.iterate import ensure_checkpoint_dir
from wayfarer.plans.registry import NOW, query, r6
from wayfarer.plans.spatial_queries import BR, CLUSTERS, CUM, DIST, FRAC, HAV, SEGS, S
from wayfarer.streaming import live
from wayfarer.streaming import tracking as tr


def folder_of(t, name):
    """A new folder below the session's shared one."""
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def finish(writer, folder):
    run = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()


#: Files that one trigger of the feeds of votes and alerts takes.
FILES = 32


# dead reckoning: each path is walked in thirty steps, six at each heading
TURNS = """SELECT user_id*1000000007 + cast(floor((n-1)/5) as bigint) AS route_id, user_id, event_id*6+j AS event_id, (n-1)%5*6+j+1 AS n, heading_raw + 3.0137*j + 0.0731*j*j AS heading
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM f_accel) a, range(6) AS k(j)"""
DEGREES = "CASE WHEN abs({x1}-({x0}))*100>=1e-6 OR abs({y1}-({y0}))*80>=1e-6 THEN fmod(degrees(atan2(({y1}-({y0}))*80, ({x1}-({x0}))*100))+360, 360) END"
APART = "abs(fmod(fmod({a}-({b}), 360)+540, 360)-180)"


def on(alias, d):
    """The bracket of a distance on the path."""
    return f"{alias}.route_id=q.route_id AND {alias}.d1 IS NOT NULL AND {d}>={alias}.cum AND ({d}<{alias}.d1 OR {alias}.lst)"


def part(alias, d):
    return f"CASE WHEN {alias}.d1-{alias}.cum<0.001 THEN 1.0 ELSE ({d}-{alias}.cum)/({alias}.d1-{alias}.cum) END"


def place(alias, d, c):
    return f"({alias}.{c}+({alias}.{c}1-{alias}.{c})*({part(alias, d)}))"


LOOK = "least(q.dist+3, q.total)"
AHEAD = DEGREES.format(x0=place("a", "q.dist", "x"), y0=place("a", "q.dist", "y"), x1=place("b", LOOK, "x"), y1=place("b", LOOK, "y"))
WAY = "fmod(heading-added/8+720, 360)"
RECKON = f"""WITH RECURSIVE {CUM}, {BR}, f AS ({TURNS}), w AS (SELECT route_id, max(cum) AS total FROM m GROUP BY route_id HAVING count(*)>1),
 r AS (SELECT route_id, 0::BIGINT AS n, 0.0::DOUBLE AS added, 0.0::DOUBLE AS dist, '' AS move, total FROM w
 UNION ALL SELECT route_id, n+1, CASE WHEN n<8 THEN added+coalesce(fmod(heading-ahead+720,360),0) ELSE added END, least(greatest(dist+0.75*CASE move WHEN 'backward' THEN -1 WHEN 'sideways' THEN 0 ELSE 1 END, 0), total), move, total
  FROM (SELECT *, CASE WHEN n<8 THEN 'calibrating' WHEN ahead IS NULL THEN 'forward' WHEN {APART.format(a=WAY, b='fmod(ahead+180,360)')}<=40 THEN 'backward' WHEN {APART.format(a=WAY, b='ahead')}<=90 THEN 'forward' ELSE 'sideways' END AS move
   FROM (SELECT q.route_id, q.n, q.added, q.dist, q.total, f.heading, {AHEAD} AS ahead FROM r q JOIN f ON f.route_id=q.route_id AND f.n=q.n+1 JOIN s a ON {on('a', 'q.dist')} JOIN s b ON {on('b', LOOK)}) y) z)
 SELECT f.user_id, f.event_id, q.dist, q.move, round({place('a', 'q.dist', 'x')},6) AS x, round({place('a', 'q.dist', 'y')},6) AS y, CASE WHEN {part('a', 'q.dist')}<0.5 THEN a.floor_id ELSE a.floor1 END AS floor_id
 FROM r q JOIN f ON f.route_id=q.route_id AND f.n=q.n JOIN s a ON {on('a', 'q.dist')}"""


def reckoned(t):
    """A user's paths follow each other; a path row comes just before the first step on it."""
    moves = t.sql(TURNS)
    no = F.col("route_id") % 1000000007
    at = F.timestamp_millis(F.lit(1_704_067_200_000) + (no * 31 + F.col("n")) * 500)
    begun = moves.select("user_id", "route_id").distinct().withColumn("n", F.lit(0)).withColumn("ts", at)
    rows = tr.path_rows(t("f_waypoints"), begun).unionByName(tr.step_rows(moves.withColumn("ts", at)))
    return r6(tr.path_reckoning(rows), "x", "y")


query("str3_path_reckoning", RECKON)(reckoned)

# the remaining route: every six fixes of a user are a route, walked beside its points
BESIDE = """SELECT user_id*1000000007 + cast(floor((n-1)/6) as bigint) AS route_id, user_id, event_id AS fix_id, (n-1)%6+1 AS n, lat+0.0002*(event_id%3) AS lat, lon FROM
 (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, 30.28+cast(event_id*37%997 as double)/99700 AS lat, -97.74+cast(event_id*211%991 as double)/99100 AS lon FROM events) e"""
GOALS = "SELECT route_id, max(lat) AS dlat, min(lon) AS dlon FROM f_route_points GROUP BY route_id"
hav = lambda a, b, c, d: HAV.format(a=a, b=b, c=c, d=d)
FROM_LAT, FROM_LON = "CASE WHEN e.seq=q.s+1 THEN q.qlat ELSE e.lat0 END", "CASE WHEN e.seq=q.s+1 THEN q.qlon ELSE e.lon0 END"
TRACK = f"""WITH RECURSIVE p AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM f_route_points WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
 k AS (SELECT route_id, seq, lat, lon, lat0, lon0, coalesce(sum({hav('lat0', 'lat', 'lon0', 'lon')}) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rest FROM p),
 g AS ({GOALS}), f AS ({BESIDE}), one AS (SELECT route_id FROM f_route_points GROUP BY route_id HAVING count(*)=1),
 r AS (SELECT route_id, 0::BIGINT AS n, 0::BIGINT AS s, lat AS qlat, lon AS qlon, false AS waiting, false AS arrived, false AS reroute, CASE WHEN seq IS NULL THEN 0 ELSE 0 END::DOUBLE AS km FROM k WHERE seq=0
 UNION ALL SELECT route_id, n+1, CASE WHEN arrived OR stays THEN s ELSE e_seq-1 END, CASE WHEN arrived OR stays THEN qlat ELSE plat END, CASE WHEN arrived OR stays THEN qlon ELSE plon END, waiting OR off>30, arrived, NOT arrived AND NOT stays AND off>30,
   CASE WHEN arrived OR stays THEN km ELSE {hav('plat', 'e_lat', 'plon', 'e_lon')}+rest END
  FROM (SELECT *, {hav('flat', 'plat', 'flon', 'plon')}*1000 AS off FROM (SELECT *, a_lat+fr*(e_lat-a_lat) AS plat, a_lon+fr*(e_lon-a_lon) AS plon FROM (SELECT *, coalesce(least(1.0, greatest(0.0, ((flon-a_lon)*(e_lon-a_lon)+(flat-a_lat)*(e_lat-a_lat))/nullif(pow(e_lon-a_lon,2)+pow(e_lat-a_lat,2),0))),0) AS fr FROM
   (SELECT q.route_id, q.n, q.s, q.qlat, q.qlon, q.km, q.waiting, q.waiting OR e.seq IS NULL AS stays, f.lat AS flat, f.lon AS flon, {hav('f.lat', 'g.dlat', 'f.lon', 'g.dlon')}*1000<25 AS arrived, coalesce(e.seq,0) AS e_seq, coalesce(e.lat,q.qlat) AS e_lat, coalesce(e.lon,q.qlon) AS e_lon, coalesce(e.rest,0) AS rest, coalesce({FROM_LAT},q.qlat) AS a_lat, coalesce({FROM_LON},q.qlon) AS a_lon
    FROM r q JOIN f ON f.route_id=q.route_id AND f.n=q.n+1 JOIN g ON g.route_id=q.route_id LEFT JOIN k e ON e.route_id=q.route_id AND e.seq>q.s WHERE NOT q.arrived) v) u) x
   QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY off, e_seq)=1) z)
 SELECT f.user_id, f.fix_id, q.arrived, q.reroute, CASE WHEN NOT q.arrived THEN round(q.km*0.621371,6) END AS miles, CASE WHEN NOT q.arrived THEN greatest(1, floor(q.km*0.621371/3.1*60+0.5))::INT END AS minutes FROM r q JOIN f ON f.route_id=q.route_id AND f.n=q.n"""


def tracked(t):
    """A new route replaces the remaining one just before the first fix beside it."""
    fixes = t.sql(BESIDE)
    at = F.timestamp_millis(F.lit(1_704_067_200_000) + (F.col("route_id") % 1000000007 * 7 + F.col("n")) * 3000)
    begun = fixes.select("user_id", "route_id").distinct().withColumn("n", F.lit(0)).withColumn("ts", at).join(t.sql(GOALS), "route_id")
    rows = tr.route_rows(t("f_route_points"), begun).unionByName(tr.fix_rows(fixes.withColumn("ts", at)))
    return r6(tr.route_tracking(rows), "miles")


query("str4_route_tracking", TRACK)(tracked)

# location fixes: a feed of several triggers, thinned as a preview asks
MOVES = "SELECT user_id, event_id AS fix_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, 30.28+cast(event_id*37%997 as double)/997000 AS lat, -97.74+cast(event_id*211%991 as double)/991000 AS lon FROM events"
THIN = f"""WITH RECURSIVE f AS ({MOVES}), r AS (SELECT user_id, fix_id, n, lat AS lat0, lon AS lon0, n AS since, true AS kept FROM f WHERE n=1
 UNION ALL SELECT user_id, fix_id, n, CASE WHEN far THEN lat ELSE lat0 END, CASE WHEN far THEN lon ELSE lon0 END, CASE WHEN far THEN n ELSE since END, far FROM (SELECT f.*, r.lat0, r.lon0, r.since, (f.n-r.since)*4000>=10000 AND {hav('r.lat0', 'f.lat', 'r.lon0', 'f.lon').replace('6371', '6371000')}>=30 AS far FROM r JOIN f ON f.user_id=r.user_id AND f.n=r.n+1) z)
 SELECT user_id, fix_id FROM r WHERE kept"""


def fixes_of_stream(t):
    """Fixes four seconds apart in files of no order, three to a trigger; a last row moves the clock past them."""
    folder = folder_of(t, "fixes")
    at = F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("n") * 4000)
    t.sql(MOVES).withColumn("ts", at).drop("n").repartition(6, F.col("fix_id") % 6).write.json(f"{folder}/in")
    last = t.spark.sql("select -1L as user_id, -1L as fix_id, timestamp '2034-01-01' as ts, 0d as lat, 0d as lon")
    last.write.mode("append").json(f"{folder}/in")
    fixes = tr.fix_stream(t.spark, f"{folder}/in", "3650 days", 3)
    finish(tr.thinned_fixes(fixes, 30.0, 10_000).writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    kept = t.spark.read.schema("user_id long, fix_id long, lat double, lon double").parquet(f"{folder}/out")
    return kept.filter("user_id >= 0").select("user_id", "fix_id")


query("src7_location_fixes", THIN)(fixes_of_stream)


# votes: four triggers, each with votes of all times
def tallies_of_stream(t):
    folder = folder_of(t, "votes")
    t("f_votes").withColumn("voted_at", F.col("voted_at").cast("timestamp")).repartition(4 * FILES, "seq").write.json(f"{folder}/in")
    votes = t.spark.readStream.schema(live.VOTE_FIELDS).option("maxFilesPerTrigger", FILES).json(f"{folder}/in")
    kept = live.VoteTallies(t.spark, f"{folder}/kept", buckets=8)
    finish(kept.writer(votes), folder)
    return kept.tallies.read()


query("str8_vote_upsert_stream", "SELECT alert_id, sum((vote='confirm')::INT)::BIGINT AS confirms, sum((vote='deny')::INT)::BIGINT AS denies FROM (SELECT * FROM f_votes QUALIFY row_number() OVER (PARTITION BY alert_id, user_id ORDER BY voted_at DESC, seq DESC)=1) v GROUP BY alert_id")(
    tallies_of_stream
)


# the live view: alerts and votes come when the alert is made, the clock goes on to the queries' own time
def view_of_stream(t):
    folder = folder_of(t, "feed")
    alerts = t("f_alerts").filter(F.col("created_at") <= F.lit(NOW).cast("timestamp_ntz")).withColumn("seen_at", F.col("created_at"))
    votes = t("f_votes").join(alerts.select("alert_id", "floor_id", "seen_at"), "alert_id")
    feed = live.change_rows(alerts, votes)
    for day in ("2024-01-05", "2024-01-10", None):
        when = F.lit(day).cast("timestamp") if day else None
        now = feed if when is None else feed.filter(F.col("seen_at") < when)
        now.repartition(FILES, "alert_id").write.mode("append").json(f"{folder}/in")
        feed = feed if when is None else feed.filter(F.col("seen_at") >= when)
    clock = t.spark.sql(f"select 'clock' as kind, timestamp '{NOW}' as seen_at, 'clock' as floor_id")
    clock.write.mode("append").json(f"{folder}/in")
    kept = live.LiveAlerts(t.spark, f"{folder}/kept", lambda: t("f_profiles"))
    finish(kept.writer(live.change_feed(t.spark, f"{folder}/in", FILES)), folder)
    return kept.view.read().select("alert_id", "cluster_id")


query("str7_live_view_stream", f"{CLUSTERS} SELECT alert_id, cluster_id FROM c")(view_of_stream)

# notices: a viewer's routes come 200 and 800 milliseconds apart in turn
ROUTES = "SELECT DISTINCT viewer_id, route_id, route_id%1000000007 AS k FROM ({segs}) s"
LABELS = " ".join(f"WHEN '{kind}' THEN '{label}'" for kind, label in live.ALERT_LABELS.items())
NOTICES = f"""WITH s AS ({SEGS}), w AS (SELECT *, k*500+(k%2)*300 AS ms FROM ({ROUTES.format(segs='SELECT * FROM s')}) z), u AS (SELECT route_id, coalesce(lead(ms) OVER (PARTITION BY viewer_id ORDER BY ms)-ms, 600)>=600 AS settled FROM w),
 p AS (SELECT a.alert_id, a.type, a.submitted_by, s.*, a.x, a.y, {FRAC.format(**{**S, 'px': 'a.x', 'py': 'a.y'})} AS f FROM f_alerts a JOIN s ON a.floor_id=s.floor_id JOIN u ON u.route_id=s.route_id WHERE u.settled),
 n AS (SELECT route_id, count(DISTINCT alert_id) AS n, min(type) AS type FROM p WHERE {DIST.format(**S)} < 0.04 AND viewer_id<>submitted_by GROUP BY route_id)
 SELECT route_id, CASE WHEN n=1 THEN CASE type {LABELS} ELSE 'Other' END || ' on your route' ELSE 'Alerts on your route' END AS title FROM n"""


def notices_of_stream(t):
    """Routes in three triggers, one file of them twice; a last route moves the clock past the others."""
    folder = folder_of(t, "routes")
    segments = t.sql(SEGS)
    routes = segments.select("viewer_id", "route_id").distinct().withColumn("k", F.col("route_id") % 1000000007)
    routes = routes.withColumn("changed_at", F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("k") * 500 + F.col("k") % 2 * 300)).drop("k")
    routes.repartition(4, F.col("route_id") % 4).write.json(f"{folder}/in")
    routes.filter("route_id % 4 = 0").coalesce(1).write.mode("append").json(f"{folder}/in")
    last = t.spark.sql("select -1L as viewer_id, -1L as route_id, timestamp '2034-01-01' as changed_at")
    last.write.mode("append").json(f"{folder}/in")
    stream = t.spark.readStream.schema("viewer_id long, route_id long, changed_at timestamp").option("maxFilesPerTrigger", 3).json(f"{folder}/in")
    of = lambda settled: segments.join(settled.select("route_id"), "route_id", "left_semi")
    write = lambda df, number: df.write.mode("overwrite").parquet(f"{folder}/out/trigger={number}")
    finish(live.notice_writer(stream.withWatermark("changed_at", "3650 days"), of, lambda: t("f_alerts"), write), folder)
    return t.spark.read.schema("route_id long, title string").parquet(f"{folder}/out/trigger=*")


query("str9_route_notice_stream", NOTICES)(notices_of_stream)
