"""Registered queries over calendars, texts, places and single columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.functions import scalars as sc
from wayfarer.operators import audits, calendar, places
from wayfarer.plans.registry import now, query, r6

NEXT = "CASE {k} WHEN 'daily' THEN {d} + CAST({n} AS INTEGER) WHEN 'weekly' THEN {d} + CAST(7*{n} AS INTEGER) ELSE (date_trunc('month', {d}) + to_months(CAST({n} AS INTEGER)))::DATE + CAST(day({d})-1 AS INTEGER) END"
STEP = NEXT.format(k="recurrence", d="occurs_on", n="recurrence_interval")
OCC = f"""occ AS (SELECT event_id, user_id, group_id, time, notify, recurrence, recurrence_interval, recur_end_date, event_date AS occurs_on FROM f_cal WHERE recur_end_date IS NULL OR recur_end_date >= event_date
 UNION ALL SELECT event_id, user_id, group_id, time, notify, recurrence, recurrence_interval, recur_end_date, {STEP} FROM occ WHERE recurrence IS NOT NULL AND recur_end_date IS NOT NULL AND {STEP} <= recur_end_date)"""
CLOCK = "(CASE WHEN right(time,2)='PM' THEN CASE WHEN left(time,2)='12' THEN 12 ELSE left(time,2)::INT+12 END ELSE CASE WHEN left(time,2)='12' THEN 0 ELSE left(time,2)::INT END END*60 + substr(time,4,2)::INT)"
DAY = "1995-06-17"
CAL_NOW = "1995-06-17 14:30:00"
cal_now = lambda: F.lit(CAL_NOW).cast("timestamp_ntz")
occurrences = lambda t: calendar.expand_recurrence(t("f_cal"))

query("exp1_expand_recurrence", f"WITH RECURSIVE {OCC} SELECT event_id, user_id, occurs_on FROM occ")(lambda t: occurrences(t).select("event_id", "user_id", "occurs_on"))
query("exp2_next_occurrence", f"SELECT event_id, {NEXT.format(k='recurrence', d='event_date', n='recurrence_interval')} AS next_date, event_date - 1 AS day_before FROM f_cal WHERE recurrence IS NOT NULL")(
    lambda t: t("f_cal").filter("recurrence is not null").select("event_id", calendar.next_occurrence("event_date", "recurrence", "recurrence_interval").alias("next_date"), F.date_sub("event_date", 1).alias("day_before"))
)
FUT = f"(occurs_on > DATE '{DAY}' OR (occurs_on = DATE '{DAY}' AND {CLOCK} >= 870))"
query("fil17_only_future", f"WITH RECURSIVE {OCC} SELECT event_id, occurs_on FROM occ WHERE {FUT}")(lambda t: calendar.only_future(occurrences(t), cal_now()).select("event_id", "occurs_on"))
query("top1_day_schedule", f"WITH RECURSIVE {OCC} SELECT user_id, event_id, time, row_number() OVER (PARTITION BY user_id ORDER BY {CLOCK}, event_id) AS place FROM occ WHERE occurs_on = DATE '{DAY}'")(
    lambda t: calendar.day_schedule(occurrences(t), F.lit(DAY).cast("date")).select("user_id", "event_id", "time", "place")
)
query("top2_upcoming_events", f"WITH RECURSIVE {OCC} SELECT user_id, event_id, occurs_on, row_number() OVER (PARTITION BY user_id ORDER BY occurs_on, {CLOCK}, event_id) AS place FROM occ WHERE {FUT} QUALIFY place <= 3")(
    lambda t: calendar.upcoming_events(occurrences(t), cal_now()).select("user_id", "event_id", "occurs_on", "place")
)
query("agg16_calendar_marked_dates", f"WITH RECURSIVE {OCC} SELECT user_id, occurs_on, count(*) AS events, sum(notify::INT)::BIGINT AS reminders FROM occ GROUP BY user_id, occurs_on")(
    lambda t: calendar.marked_dates(occurrences(t))
)
EDITS = "SELECT event_id, CASE WHEN event_id%3=0 THEN event_date WHEN recurrence='daily' THEN event_date + CAST(2*recurrence_interval AS INTEGER) WHEN recurrence='weekly' THEN event_date + CAST(7*recurrence_interval AS INTEGER) ELSE event_date END AS on_date, CASE WHEN event_id%2=0 THEN 'this' ELSE 'following' END AS scope FROM f_cal"
SPARK_EDITS = EDITS.replace("event_date + CAST(2*recurrence_interval AS INTEGER)", "date_add(event_date, 2*recurrence_interval)").replace("event_date + CAST(7*recurrence_interval AS INTEGER)", "date_add(event_date, 7*recurrence_interval)")
query(
    "exp3_split_series",
    f"""WITH e AS (SELECT c.*, x.on_date, x.scope FROM f_cal c JOIN ({EDITS}) x ON c.event_id=x.event_id),
 n AS (SELECT *, recurrence IS NOT NULL AND recur_end_date IS NOT NULL AS rec, {NEXT.format(k='recurrence', d='on_date', n='recurrence_interval')} AS nx, event_date=on_date AS st FROM e),
 m AS (SELECT *, rec AND coalesce(nx <= recur_end_date, false) AS tail FROM n)
 SELECT event_id, 'update' AS action, 'single' AS part, event_date, NULL::DATE AS recur_end_date FROM m WHERE NOT rec
 UNION ALL SELECT event_id, 'update', 'series', nx, recur_end_date FROM m WHERE rec AND scope='this' AND st AND tail
 UNION ALL SELECT event_id, 'delete', 'series', event_date, recur_end_date FROM m WHERE rec AND scope='this' AND st AND NOT tail
 UNION ALL SELECT event_id, 'insert', 'single', on_date, NULL FROM m WHERE rec AND scope='this'
 UNION ALL SELECT event_id, 'update', 'series', event_date, on_date - 1 FROM m WHERE rec AND NOT st
 UNION ALL SELECT event_id, 'insert', 'tail', nx, recur_end_date FROM m WHERE rec AND scope='this' AND NOT st AND tail
 UNION ALL SELECT event_id, 'update', 'series', event_date, recur_end_date FROM m WHERE rec AND scope='following' AND st
 UNION ALL SELECT event_id, 'insert', 'tail', on_date, recur_end_date FROM m WHERE rec AND scope='following' AND NOT st""",
)(lambda t: calendar.split_series(t("f_cal"), t.sql(SPARK_EDITS)))

BUILD = "bk AS (SELECT key, arg_max(code, (p, ord)) AS code, arg_max(coalesce(search_hint, full_name), (p, ord)) AS hint FROM (SELECT *, 1 AS p, lower(code) AS key FROM f_buildings UNION ALL SELECT *, 0, alias_a FROM f_buildings UNION ALL SELECT *, 0, alias_b FROM f_buildings) k GROUP BY key)"
dictionary = lambda t: t("f_buildings").withColumn("aliases", F.array("alias_a", "alias_b"))
query("fil6_suggest_buildings", "SELECT code, display_name FROM f_buildings WHERE starts_with(lower(code),'a') OR contains(lower(display_name),'a') OR contains(lower(full_name),'a') OR starts_with(alias_a,'a') OR starts_with(alias_b,'a') ORDER BY ord LIMIT 6")(
    lambda t: places.suggest_buildings(dictionary(t), " A").select("code", "display_name")
)
query("fil7_search_rooms", "SELECT node_id, label FROM f_nodes WHERE type='room' AND contains(lower(label),'3.1') ORDER BY lower(label), label, node_id LIMIT 20")(
    lambda t: places.search_rooms(t("f_nodes"), "3.1").select("node_id", "label")
)
PL = "SELECT place_id, case when place_id%7=1 then 'GDC' else name end as name, case place_id%7 when 0 then 'Gates Dell wing' when 2 then 'the Gates Computer Science' when 3 then 'MELINDA GATES hall' when 4 then 'Bill and Melinda Gates' when 5 then 'Gates street' else 'Street ' || cast(place_id as varchar(8)) end as address FROM f_places"
query("fil8_has_indoor_map", f"SELECT place_id, regexp_matches(lower(name || ' ' || address), 'gdc|gates dell|gates computer science|melinda gates') AS has_indoor_map FROM ({PL}) p")(lambda t: places.has_indoor_map(t.sql(PL)).select("place_id", "has_indoor_map"))
TXT = "SELECT event_id, CASE WHEN event_id%4=0 THEN 'b' || cast(event_id%30 as varchar(4)) WHEN event_id%4=1 THEN 'Hall ' || cast(event_id%30 as varchar(4)) WHEN event_id%4=2 THEN 'B3 west' ELSE 'unknown ' || cast(event_id as varchar(9)) END AS building FROM f_cal"
query(
    "joi21_canonical_building",
    f"WITH {BUILD}, t AS ({TXT}) SELECT event_id, coalesce(a.code, building) AS canonical, coalesce(a.hint, CASE WHEN contains(building,' ') THEN b.hint END, building) AS expanded FROM t LEFT JOIN bk a ON a.key=lower(building) LEFT JOIN bk b ON b.key=lower(string_split(building,' ')[1])",
)(lambda t: places.canonical_building(t.sql(TXT), dictionary(t)).select("event_id", "canonical", "expanded"))
LOC = "SELECT event_id, CASE event_id%6 WHEN 0 THEN location WHEN 1 THEN 'Hall ' || cast(event_id%30 as varchar(4)) WHEN 2 THEN 'b' || cast(event_id%25 as varchar(4)) || ' 2.' || cast(100+event_id%900 as varchar(4)) WHEN 3 THEN 'B4 Room 0132' WHEN 4 THEN 'B' || cast(event_id%25 as varchar(4)) || ' - Room 3.1' ELSE 'Some place' END AS location FROM f_cal"
query(
    "sca6_parse_location",
    f"""WITH {BUILD}, t AS ({LOC}), p AS (SELECT *, regexp_matches(location, '(?i)(?:^|\\s|-)\\s*(?:room|rm|ste|suite|#)\\s*([\\w.\\-]+)') AS kw FROM t),
 s AS (SELECT event_id, CASE WHEN kw THEN trim(regexp_replace(regexp_extract(location, '(?i)^(.*?)(?:^|\\s|-)\\s*(?:room|rm|ste|suite|#)\\s*([\\w.\\-]+)', 1), '-\\s*$', '')) WHEN contains(location,' - ') THEN split_part(location,' - ',1)
   WHEN regexp_matches(location, '^(.+?)\\s+(\\d+(?:\\.\\d+)?)$') THEN regexp_extract(location, '^(.+?)\\s+(\\d+(?:\\.\\d+)?)$', 1) ELSE location END AS b,
  CASE WHEN kw THEN regexp_extract(location, '(?i)(?:room|rm|ste|suite|#)\\s*([\\w.\\-]+)', 1) WHEN contains(location,' - ') THEN split_part(location,' - ',2) WHEN regexp_matches(location, '^(.+?)\\s+(\\d+(?:\\.\\d+)?)$') THEN regexp_extract(location, '^(.+?)\\s+(\\d+(?:\\.\\d+)?)$', 2) ELSE '' END AS room FROM p)
 SELECT event_id, coalesce(code, b) AS building, room FROM s LEFT JOIN bk ON bk.key=lower(b)""",
)(lambda t: places.parse_location(t.sql(LOC), dictionary(t)).select("event_id", "building", "room"))
ROOMQ = "SELECT node_id AS query_id, node_id%20 AS site, CASE node_id%5 WHEN 0 THEN 'Room ' || label WHEN 1 THEN replace(label,'.','') WHEN 2 THEN substr(label,1,3) WHEN 3 THEN cast(1+node_id%7 as varchar(2)) || '.' || cast(105+node_id%900 as varchar(8)) ELSE '9 . 99z' END AS text FROM f_nodes"
SITED = "SELECT *, node_id%20 AS site FROM f_nodes"
query(
    "joi20_resolve_room",
    f"""WITH q0 AS ({ROOMQ}), q AS (SELECT query_id, site, lower(regexp_replace(trim(regexp_replace(trim(text), '^(room|rm|ste|suite|#)\\s*', '', 'i')), '\\s*\\.\\s*', '.', 'g')) AS q FROM q0),
 r AS (SELECT site, node_id, label, lower(label) AS l FROM ({SITED}) n WHERE type='room'), p AS (SELECT *, regexp_extract(q, '^(\\d+)\\.(\\d+)([a-z]?)$', 1) AS qf, try_cast(regexp_extract(q, '^(\\d+)\\.(\\d+)([a-z]?)$', 2) AS BIGINT) AS qn, regexp_extract(q, '^(\\d+)\\.(\\d+)([a-z]?)$', 3) AS qs,
  try_cast(regexp_extract(l, '^(\\d+)\\.(\\d+)([a-z]?)$', 2) AS BIGINT) AS ln, regexp_extract(l, '^(\\d+)\\.(\\d+)([a-z]?)$', 3) AS ls FROM q JOIN r USING (site)),
 t AS (SELECT *, CASE WHEN contains(l,q) THEN 1 WHEN regexp_replace(l,'[^a-z0-9]','','g')=regexp_replace(q,'[^a-z0-9]','','g') AND length(regexp_replace(q,'[^a-z0-9]','','g'))>=2 THEN 2
  WHEN qf<>'' AND starts_with(l, qf||'.') AND l = qf||'.'||qn::VARCHAR||qs THEN 3 WHEN qf<>'' AND starts_with(l, qf||'.') AND (qs='' OR qs=ls) AND abs(ln-qn)<=12 THEN 4 END AS tier FROM p)
 SELECT query_id, node_id, tier FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier=4 THEN abs(ln-qn) ELSE 0 END, CASE WHEN tier=1 THEN l ELSE '' END, CASE WHEN tier=1 THEN label ELSE '' END, node_id)=1""",
)(lambda t: places.resolve_room(t.sql(ROOMQ), t.sql(SITED)))
PLQ = "SELECT place_id AS query_id, CASE place_id%5 WHEN 0 THEN name WHEN 1 THEN 'su' WHEN 2 THEN '7' ELSE 'supplier' END AS text, lat+0.001 AS lat, lon-0.001 AS lon FROM f_places"
query(
    "joi22_ring_place_search",
    f"""WITH q AS ({PLQ}), h AS (SELECT query_id, place_id, greatest(abs(p.lat-q.lat), abs(p.lon-q.lon)) AS far FROM q JOIN f_places p ON contains(lower(p.name), lower(q.text))),
 r AS (SELECT *, CASE WHEN far<=0.02 THEN 1 WHEN far<=0.06 THEN 2 WHEN far<=0.15 THEN 3 ELSE 4 END AS ring FROM h), u AS (SELECT *, CASE WHEN sum((ring<=1)::INT) OVER w>=3 THEN 1 WHEN sum((ring<=2)::INT) OVER w>=3 THEN 2 WHEN sum((ring<=3)::INT) OVER w>=1 THEN 3 ELSE 4 END AS u FROM r WINDOW w AS (PARTITION BY query_id))
 SELECT query_id, place_id, u AS ring FROM u WHERE ring<=u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY far, place_id)<=10""",
)(lambda t: places.ring_place_search(t.sql(PLQ), t("f_places")))
#: Codes, codes with a room, aliases, names of places and words; two of three buildings have a known entrance.
ANYQ = "SELECT place_id AS query_id, CASE place_id%6 WHEN 0 THEN ' b' || cast(place_id%30 as varchar(4)) WHEN 1 THEN 'B' || cast(place_id%25 as varchar(4)) || ' 2.204' WHEN 2 THEN 'Hall ' || cast(place_id%25 as varchar(4)) || ' ' WHEN 3 THEN name WHEN 4 THEN 'supplier' ELSE ' ' END AS text, lat+0.001 AS lat, lon-0.001 AS lon FROM f_places"
ENTR = "SELECT code, 30.28 + ord*0.001 AS lat, -97.74 - ord*0.001 AS lon FROM f_buildings WHERE ord%3<>0"
query(
    "joi22_place_search_local_first",
    f"""WITH {BUILD}, en AS ({ENTR}), q AS (SELECT *, lower(trim(text)) AS key, string_split(lower(trim(text)),' ')[1] AS head FROM ({ANYQ}) z), b AS (SELECT q.*, coalesce(a.code, h.code) AS code, CASE WHEN a.hint IS NOT NULL THEN a.hint WHEN contains(q.key,' ') AND h.hint IS NOT NULL THEN h.hint ELSE trim(q.text) END AS said FROM q LEFT JOIN bk a ON a.key=q.key LEFT JOIN bk h ON h.key=q.head),
 loc AS (SELECT query_id, b.code FROM b JOIN en ON en.code=b.code), o AS (SELECT * FROM b WHERE query_id NOT IN (SELECT query_id FROM loc) AND said<>''),
 h AS (SELECT query_id, place_id, greatest(abs(p.lat-o.lat), abs(p.lon-o.lon)) AS far FROM o JOIN f_places p ON contains(lower(p.name), lower(o.said))),
 r AS (SELECT *, CASE WHEN far<=0.02 THEN 1 WHEN far<=0.06 THEN 2 WHEN far<=0.15 THEN 3 ELSE 4 END AS ring FROM h), u AS (SELECT *, CASE WHEN sum((ring<=1)::INT) OVER w>=3 THEN 1 WHEN sum((ring<=2)::INT) OVER w>=3 THEN 2 WHEN sum((ring<=3)::INT) OVER w>=1 THEN 3 ELSE 4 END AS u FROM r WINDOW w AS (PARTITION BY query_id))
 SELECT query_id, code, NULL AS place_id, 0 AS ring FROM loc UNION ALL (SELECT query_id, NULL, place_id, u FROM u WHERE ring<=u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY far, place_id)<=10)""",
)(lambda t: places.place_search(t.sql(ANYQ), t("f_places"), dictionary(t), t.sql(ENTR)))
GEO = "SELECT s_suppkey AS place_id, s_name || ', ' || cast(s_suppkey as varchar(9)) || ' Main St , Town,State, Zip' AS display_name, cast(30 + s_suppkey*0.001 as varchar(20)) AS lat, cast(-97 - s_suppkey*0.001 as varchar(20)) AS lon FROM supplier"
query("src8_parse_place_results", f"SELECT place_id::VARCHAR AS place_id, trim(split_part(display_name,',',1)) AS name, trim(split_part(display_name,',',2)) || ', ' || trim(split_part(display_name,',',3)) || ', ' || trim(split_part(display_name,',',4)) AS address, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM ({GEO}) g")(
    lambda t: places.parse_place_results(t.sql(GEO))
)
ROU = """SELECT o_orderkey AS route_id, '{"code":"' || case when o_orderkey%5=0 then 'NoRoute' else 'Ok' end || '","routes":[{"distance":' || cast(100+o_orderkey%5000 as varchar(9)) || ',"duration":' || cast(o_orderkey%3000 as varchar(9)) || ',"geometry":{"coordinates":[[-97.7,30.2],[-97.8,30.' || cast(o_orderkey%90 as varchar(3)) || ']]}}]}' AS body FROM orders"""
query(
    "src9_parse_route_results",
    f"""WITH r AS (SELECT route_id, json_extract(body,'$.routes[0].distance')::DOUBLE AS m, json_extract(body,'$.routes[0].duration')::DOUBLE AS s, json_extract(body,'$.routes[0].geometry.coordinates')::DOUBLE[][] AS c FROM ({ROU}) x WHERE json_extract_string(body,'$.code')='Ok'),
 e AS (SELECT *, unnest(range(len(c))) AS seq FROM r) SELECT route_id, seq::INT AS seq, c[seq+1][2] AS lat, c[seq+1][1] AS lon, round(m/1000*0.621371, 6) AS distance_mi, greatest(1, CASE WHEN s>0 THEN floor(s/60+0.5) ELSE floor(m/1000*0.621371/3.1*60+0.5) END)::BIGINT AS duration_min FROM e""",
)(lambda t: r6(places.parse_route_results(t.sql(ROU)), "distance_mi"))

AUDITED = {
    "g": "SELECT *, CASE WHEN group_id%4=1 THEN 'C' || cast(group_id%3 as varchar(9)) END AS join_code, repeat('d', cast(group_id%3 as int)*600) AS description, repeat('u', cast(group_id%5 as int)*600) AS image_url, repeat('p', cast(group_id%7 as int)*40) AS join_password FROM f_groups WHERE group_id%9<>0",
    "m": "SELECT group_id, user_id, CASE WHEN user_id%17=0 THEN 'owner' ELSE role END AS role FROM f_members",
    "i": "SELECT invite_id, group_id, invited_user_id, CASE WHEN invite_id%11=0 THEN 'open' ELSE status END AS status FROM f_invites",
    "r": "SELECT request_id, group_id, user_id, CASE WHEN request_id%11=0 THEN 'accepted' ELSE status END AS status FROM f_requests",
    "e": "SELECT event_id, CASE WHEN event_id%50=0 THEN '' ELSE 't' END AS title, CASE WHEN event_id%60=0 THEN '' ELSE time END AS time, CASE WHEN event_id%70=0 THEN repeat(location, 40) ELSE location END AS location FROM f_cal",
    "a": "SELECT alert_id, CASE WHEN alert_id%40=0 THEN 'flood' ELSE type END AS type, CASE WHEN alert_id%45=0 THEN 'open' ELSE status END AS status FROM f_alerts WHERE alert_id%13<>0",
    "v": "SELECT alert_id, user_id, CASE WHEN seq%100=1 THEN 'maybe' ELSE vote END AS vote FROM f_votes",
}
query(
    "fil15_constraint_audit",
    f"""WITH {', '.join(f'{k} AS ({v})' for k, v in AUDITED.items())}, l AS (SELECT 'groups' AS "table", 'name_length' AS rule, group_id::VARCHAR AS key FROM g WHERE length(name) NOT BETWEEN 1 AND 120
 UNION ALL SELECT 'groups', 'description_length', group_id::VARCHAR FROM g WHERE length(description)>1000 UNION ALL SELECT 'groups', 'image_url_length', group_id::VARCHAR FROM g WHERE length(image_url)>2048
 UNION ALL SELECT 'groups', 'join_password_length', group_id::VARCHAR FROM g WHERE length(join_password)>200 UNION ALL SELECT 'groups', 'join_code_unique', join_code FROM g WHERE join_code IS NOT NULL GROUP BY join_code HAVING count(*)>1
 UNION ALL SELECT 'members', 'role', user_id::VARCHAR FROM m WHERE role NOT IN ('admin','editor','member')
 UNION ALL SELECT 'members', 'unique', group_id::VARCHAR||':'||user_id::VARCHAR FROM m GROUP BY group_id, user_id HAVING count(*)>1 UNION ALL SELECT 'members', 'group', user_id::VARCHAR FROM m WHERE group_id NOT IN (SELECT group_id FROM g)
 UNION ALL SELECT 'friends', 'user', edge_id::VARCHAR FROM f_friends WHERE user_id NOT IN (SELECT user_id FROM f_profiles)
 UNION ALL SELECT 'invites', 'status', invite_id::VARCHAR FROM i WHERE status NOT IN ('pending','accepted','declined') UNION ALL SELECT 'invites', 'unique', group_id::VARCHAR||':'||invited_user_id::VARCHAR FROM i GROUP BY group_id, invited_user_id HAVING count(*)>1
 UNION ALL SELECT 'invites', 'group', invite_id::VARCHAR FROM i WHERE group_id NOT IN (SELECT group_id FROM g)
 UNION ALL SELECT 'requests', 'status', request_id::VARCHAR FROM r WHERE status NOT IN ('pending','approved','declined') UNION ALL SELECT 'requests', 'unique', group_id::VARCHAR||':'||user_id::VARCHAR FROM r GROUP BY group_id, user_id HAVING count(*)>1
 UNION ALL SELECT 'requests', 'group', request_id::VARCHAR FROM r WHERE group_id NOT IN (SELECT group_id FROM g)
 UNION ALL SELECT 'events', 'title_length', event_id::VARCHAR FROM e WHERE length(title) NOT BETWEEN 1 AND 200 UNION ALL SELECT 'events', 'time_length', event_id::VARCHAR FROM e WHERE length(time) NOT BETWEEN 1 AND 20 UNION ALL SELECT 'events', 'location_length', event_id::VARCHAR FROM e WHERE length(location)>300
 UNION ALL SELECT 'alerts', 'type', alert_id::VARCHAR FROM a WHERE type NOT IN ('building_closure','crowd','elevator_down','construction','hazard','other') UNION ALL SELECT 'alerts', 'status', alert_id::VARCHAR FROM a WHERE status NOT IN ('active','expired','removed')
 UNION ALL SELECT 'votes', 'vote', alert_id::VARCHAR FROM v WHERE vote NOT IN ('confirm','deny') UNION ALL SELECT 'votes', 'unique', alert_id::VARCHAR||':'||user_id::VARCHAR FROM v GROUP BY alert_id, user_id HAVING count(*)>1
 UNION ALL SELECT 'votes', 'alert', alert_id::VARCHAR FROM v WHERE alert_id NOT IN (SELECT alert_id FROM a)) SELECT * FROM l""",
)(lambda t: audits.constraint_audit(*(t.sql(AUDITED[k]) for k in "gm"), t("f_friends"), t("f_profiles"), *(t.sql(AUDITED[k]) for k in "ireav")))
OBJ = "SELECT o_orderkey AS object_id, o_custkey AS owner_id, cast(o_custkey + case when o_orderkey%7=0 then 1 else 0 end as varchar(9)) || '/pic' || case o_orderkey%4 when 0 then '.PNG' when 1 then '.jpeg' when 2 then '.gif' else '.webp' end AS name, o_orderkey*977%6000000 AS size FROM orders"
query("fil16_upload_object_audit", f"SELECT object_id, (split_part(name,'/',1)=owner_id::VARCHAR AND lower(split_part(name,'.',2)) IN ('jpeg','jpg','png','webp') AND size BETWEEN 1 AND 5242880) AS allowed FROM ({OBJ}) o")(
    lambda t: audits.upload_object_audit(t.sql(OBJ)).select("object_id", "allowed")
)

query("sca1_haversine_km", "SELECT place_id, round(2*6371*atan2(sqrt(a), sqrt(1-a)), 6) AS km FROM (SELECT place_id, pow(sin(radians(30.28-lat)/2),2)+cos(radians(lat))*cos(radians(30.28))*pow(sin(radians(-97.74-lon)/2),2) AS a FROM f_places) x")(
    lambda t: r6(t("f_places").select("place_id", sc.haversine_km("lat", "lon", 30.28, -97.74).alias("km")), "km")
)
query(
    "sca2_point_segment_distance",
    """SELECT alert_id, round(sqrt(pow(x-(0.2+f*0.6),2)+pow(y-(0.3+f*0.1),2)),6) AS d FROM (SELECT *, least(1.0,greatest(0.0,((x-0.2)*0.6+(y-0.3)*0.1)/(0.6*0.6+0.1*0.1))) AS f FROM f_alerts) a""",
)(lambda t: r6(t("f_alerts").select("alert_id", sc.point_segment_distance("x", "y", F.lit(0.2), F.lit(0.3), F.lit(0.8), F.lit(0.4)).alias("d")), "d"))
query("sca3_angular_distance", "SELECT event_id, CASE WHEN d>180 THEN 360-d ELSE d END AS turn FROM (SELECT event_id, abs(heading_raw-cast(event_id%360 as double)) AS d FROM f_accel) x")(
    lambda t: t("f_accel").select("event_id", sc.angular_distance("heading_raw", (F.col("event_id") % 360).cast("double")).alias("turn"))
)
query(
    "sca4_circular_blend",
    "SELECT event_id, round(((degrees(atan2(0.5*sin(radians(p))+0.5*sin(radians(h)), 0.5*cos(radians(p))+0.5*cos(radians(h))))+360)%360), 4) AS heading FROM (SELECT event_id, heading_raw AS h, cast(event_id%90+7 as double) AS p FROM f_accel WHERE abs(abs(heading_raw-(event_id%90+7))-180)>1) x",
)(
    lambda t: t("f_accel").withColumn("p", (F.col("event_id") % 90 + 7).cast("double")).filter(F.abs(F.abs(F.col("heading_raw") - F.col("p")) - 180) > 1).select("event_id", F.round(sc.circular_blend("p", "heading_raw", 0.5), 4).alias("heading"))
)
query("sca5_parse_clock_time", f"SELECT event_id, {CLOCK} AS minutes FROM f_cal")(lambda t: t("f_cal").select("event_id", sc.parse_clock_time("time").alias("minutes")))
query("sca7_normalize_room", "SELECT det_id, regexp_replace(trim(regexp_replace(trim(t), '^(room|rm|ste|suite|#)\\s*', '', 'i')), '\\s*\\.\\s*', '.', 'g') AS room FROM (SELECT det_id, CASE WHEN det_id%3=0 THEN ' Room ' ELSE '# ' END || replace(raw_text, ',', ' . ') AS t FROM f_detections) x")(
    lambda t: t.sql("SELECT det_id, CASE WHEN det_id%3=0 THEN ' Room ' ELSE '# ' END || replace(raw_text, ',', ' . ') AS t FROM f_detections").select("det_id", sc.normalize_room("t").alias("room"))
)
query("sca8_strip_room_part", "SELECT event_id, trim(regexp_replace(regexp_replace(l, '[-–]\\s*(room|rm|suite|ste|floor|fl|#)\\s*[\\w.]+', '', 'gi'), '\\s+(room|rm|suite|ste|floor|fl|#)\\s*[\\w.]+', '', 'gi')) AS place FROM (SELECT event_id, 'B' || cast(event_id%25 as varchar(3)) || CASE WHEN event_id%2=0 THEN ' - Room 2.1' ELSE ' floor 3 rm 4' END AS l FROM f_cal) x")(
    lambda t: t.sql("SELECT event_id, 'B' || cast(event_id%25 as varchar(3)) || CASE WHEN event_id%2=0 THEN ' - Room 2.1' ELSE ' floor 3 rm 4' END AS l FROM f_cal").select("event_id", sc.strip_room_part("l").alias("place"))
)
NAM = "SELECT user_id, CASE WHEN user_id%3=0 THEN '  ' WHEN user_id%3=1 THEN full_name || chr(8203) || chr(7) ELSE repeat(full_name, 6) END AS full_name, 'u' || cast(user_id as varchar(9)) || '@x.org' AS email FROM f_profiles"
query("sca9_clean_display_name", f"SELECT user_id, left(CASE WHEN c='' THEN split_part(email,'@',1) ELSE c END, 80) AS name FROM (SELECT *, replace(trim(replace(full_name, chr(7), '')), chr(8203), '') AS c FROM ({NAM}) n) x")(
    lambda t: t.sql(NAM.replace("chr(8203)", "decode(unhex('E2808B'), 'UTF-8')")).select("user_id", sc.clean_display_name("full_name", "email").alias("name"))
)
query(
    "sca10_clean_detected_text",
    """SELECT det_id, CASE WHEN regexp_full_match(t, '\\d\\.\\d{4,}') THEN left(t,5) || CASE substr(t,6) WHEN '4' THEN 'A' WHEN '8' THEN 'B' WHEN '0' THEN 'D' ELSE '' END WHEN regexp_full_match(t, '\\d\\d{3,4}[A-Za-z]?') THEN left(t,1)||'.'||substr(t,2) ELSE t END AS label
 FROM (SELECT det_id, replace(replace(replace(replace(replace(replace(trim(raw_text),',','.'),' ',''),'|',''),'-','.'),'~','.'),';','.') AS t FROM (SELECT det_id, CASE WHEN det_id%5=0 THEN raw_text || cast(det_id%10 as varchar(2)) ELSE raw_text END AS raw_text FROM f_detections) d) x""",
)(lambda t: t("f_detections").withColumn("raw_text", F.when(F.col("det_id") % 5 == 0, F.concat("raw_text", (F.col("det_id") % 10).cast("string"))).otherwise(F.col("raw_text"))).select("det_id", sc.clean_detected_text("raw_text").alias("label")))
query(
    "sca11_accent_bucket",
    "SELECT user_id, abs(h)%8 AS bucket FROM (SELECT user_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(full_name,''), lambda c: unicode(c)::BIGINT)), lambda a, c: ((a*31+c+2147483648)%4294967296+4294967296)%4294967296-2147483648) AS h FROM f_profiles) x",
)(lambda t: t("f_profiles").select("user_id", sc.accent_bucket("full_name").alias("bucket")))
query("sca12_initials", "SELECT user_id, CASE WHEN len(p)=0 THEN 'U' WHEN len(p)=1 THEN upper(left(p[1],2)) ELSE upper(left(p[1],1)||left(p[2],1)) END AS initials FROM (SELECT user_id, list_filter(string_split(CASE user_id%3 WHEN 0 THEN '' WHEN 1 THEN 'ada  love' ELSE full_name END,' '), lambda s: s<>'') AS p FROM f_profiles) x")(
    lambda t: t.sql("SELECT user_id, CASE user_id%3 WHEN 0 THEN '' WHEN 1 THEN 'ada  love' ELSE full_name END AS n FROM f_profiles").select("user_id", sc.initials("n").alias("initials"))
)
query(
    "sca13_age_label",
    """SELECT alert_id, CASE WHEN m<1 THEN 'Reported just now' WHEN m<60 THEN 'Reported '||m||' minute'||CASE WHEN m=1 THEN '' ELSE 's' END||' ago' WHEN m//60<24 THEN 'Reported '||m//60||' hour'||CASE WHEN m//60=1 THEN '' ELSE 's' END||' ago' ELSE 'Reported '||m//1440||' day'||CASE WHEN m//1440=1 THEN '' ELSE 's' END||' ago' END AS label
 FROM (SELECT alert_id, CAST(floor(floor(epoch($NOW)-floor(epoch(created_at)))/60) AS BIGINT) AS m FROM f_alerts WHERE created_at <= $NOW) x""",
)(lambda t: t("f_alerts").filter(F.col("created_at") <= now()).select("alert_id", sc.age_label(F.col("created_at").cast("timestamp"), now().cast("timestamp")).alias("label")))
query("sca14_walk_minutes_eta", "SELECT s_suppkey AS id, greatest(1, floor(mi/3.1*60+0.5))::INT AS minutes, $NOW + to_minutes(greatest(1, floor(mi/3.1*60+0.5))::INT) AS arrival FROM (SELECT s_suppkey, cast(s_suppkey%50 as double)/13 AS mi FROM supplier) s")(
    lambda t: t.sql("SELECT s_suppkey AS id, cast(s_suppkey%50 as double)/13 AS mi FROM supplier").select("id", sc.walk_minutes("mi").alias("minutes"), sc.arrival(now(), "mi").alias("arrival"))
)
query("sca15_crop_transform", "SELECT node_id, round((x-0.03)/0.94*1000,6) AS px, round((y-0.06)/0.78*800,6) AS py, round(x,6) AS bx, round(y,6) AS by_ FROM f_nodes")(
    lambda t: r6(t("f_nodes").withColumn("p", F.struct(sc.to_image("x", "y", F.lit(1000), F.lit(800))[0].alias("px"), sc.to_image("x", "y", F.lit(1000), F.lit(800))[1].alias("py"))).select("node_id", "p.px", "p.py").withColumns(dict(zip(("bx", "by_"), sc.from_image("px", "py", F.lit(1000), F.lit(800))))), "px", "py", "bx", "by_")
)
query("sca16_recurrence_label", f"SELECT event_id, CASE WHEN recurrence IS NULL THEN 'Does not repeat' WHEN recurrence_interval=1 THEN 'Every '||u ELSE 'Every '||recurrence_interval||' '||u||'s' END AS label, CASE WHEN event_date=DATE '{DAY}' THEN 'Today' WHEN event_date=DATE '{DAY}'+1 THEN 'Tomorrow' ELSE strftime(event_date,'%a, %b %-d') END AS day FROM (SELECT *, CASE recurrence WHEN 'daily' THEN 'day' WHEN 'weekly' THEN 'week' ELSE 'month' END AS u FROM f_cal) c")(
    lambda t: t("f_cal").select("event_id", sc.recurrence_label("recurrence", "recurrence_interval").alias("label"), sc.date_label("event_date", F.lit(DAY).cast("date")).alias("day"))
)
ARC = "SELECT s_suppkey AS id, 4.0+s_suppkey%60 AS r, CASE WHEN s_suppkey%3=0 THEN 1.6 ELSE 1.0 END AS k FROM supplier"
point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
query("sca17_quarter_arc", f"SELECT id, CASE WHEN k=1.0 THEN round(100.0,4) END AS cx, CASE WHEN k=1.0 THEN round(100.0,4) END AS cy, CASE WHEN k=1.0 THEN round(r::DOUBLE,4) END AS radius FROM ({ARC}) a")(
    lambda t: t.sql(ARC.replace("4.0+s_suppkey%60", "cast(4.0+s_suppkey%60 as double)").replace("CASE WHEN s_suppkey%3=0 THEN 1.6 ELSE 1.0 END", "cast(CASE WHEN s_suppkey%3=0 THEN 1.6 ELSE 1.0 END as double)"))
    .withColumns({"p0": point(100 + F.col("r"), F.lit(100.0)), "p1": point(100 + F.col("r"), 100 + 0.5523 * F.col("k") * F.col("r")), "p2": point(100 + 0.5523 * F.col("k") * F.col("r"), 100 + F.col("r")), "p3": point(F.lit(100.0), 100 + F.col("r"))})
    .withColumn("arc", sc.quarter_arc("p0", "p1", "p2", "p3"))
    .select("id", F.round("arc.cx", 4).alias("cx"), F.round("arc.cy", 4).alias("cy"), F.round("arc.r", 4).alias("radius"))
)
query("sca19_zoom_from_span", "SELECT s_suppkey AS id, least(20,greatest(10,floor(log2(360*(400/256.0)/(cast(1+s_suppkey%200 as double)/1000))+0.5)))::INT AS zoom FROM supplier")(
    lambda t: t.sql("SELECT s_suppkey AS id, cast(1+s_suppkey%200 as double)/1000 AS span FROM supplier").select("id", sc.zoom_from_span("span", F.lit(400)).alias("zoom"))
)
URL = "SELECT s_suppkey AS id, CASE s_suppkey%4 WHEN 0 THEN 'https://x.org/a' WHEN 1 THEN 'javascript:alert(1)' WHEN 2 THEN ' HTTP://y.org ' ELSE 'http://' END AS url FROM supplier"
query("sca20_safe_url", f"SELECT id, CASE WHEN regexp_matches(trim(url), '(?i)^https?://[^\\s/?#]+') THEN trim(url) END AS url FROM ({URL}) u")(lambda t: t.sql(URL).select("id", sc.safe_url("url").alias("url")))
query("sca21_alert_expiry", "SELECT alert_id, created_at + to_minutes(CASE type WHEN 'construction' THEN 4320 WHEN 'elevator_down' THEN 1440 WHEN 'building_closure' THEN 480 WHEN 'crowd' THEN 30 WHEN 'hazard' THEN 30 ELSE 60 END) AS expires FROM f_alerts")(
    lambda t: t("f_alerts").select("alert_id", sc.alert_expiry("type", "created_at").alias("expires"))
)
PRO = "SELECT user_id, CASE WHEN user_id%4=0 THEN ' ' ELSE full_name END AS a, CASE WHEN user_id%8=0 THEN 'Meta' END AS b, CASE WHEN user_id%12=0 THEN 'Name' END AS c, CASE WHEN user_id%5=0 THEN 'm' || cast(user_id as varchar(9)) || '@x' END AS email FROM f_profiles"
query("sca23_profile_display_name", f"SELECT user_id, coalesce(nullif(trim(a),''), b, c, split_part(email,'@',1), 'User') AS name FROM ({PRO}) p")(
    lambda t: t.sql(PRO).select("user_id", sc.profile_display_name("a", "b", "c", email="email").alias("name"))
)
