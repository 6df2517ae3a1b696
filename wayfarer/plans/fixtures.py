"""Views over the driver's tables that give the shapes the operators expect.

Each statement is valid in Spark SQL and in DuckDB, so queries and their SQL read the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events".split()

VIEWS = {
    "f_profiles": """select c_custkey as user_id, c_name as full_name, cast(c_custkey*31%101 as int) as reputation_score, c_acctbal<0 as flagged, case when c_custkey%4=0 then 'B' || cast(c_nationkey as varchar(4)) end as location_building, case when c_custkey%8=0 then '2.' || cast(100+c_custkey%900 as varchar(8)) end as location_room from customer""",
    "f_groups": """select s_suppkey as group_id, s_name as name, case when s_nationkey%2=0 then 'friends' else 'campus_org' end as type, s_suppkey%3=0 as is_private, s_suppkey%5=0 as has_join_password from supplier""",
    "f_members": """select l_suppkey as group_id, o_custkey as user_id, min(o_orderdate) as joined_at, case when min(o_orderkey)%10=0 then 'admin' when min(o_orderkey)%10=1 then 'editor' else 'member' end as role from lineitem join orders on l_orderkey=o_orderkey where l_linenumber=1 and l_quantity<=10 group by l_suppkey, o_custkey""",
    "f_invites": """select min(l_orderkey) as invite_id, l_suppkey as group_id, o_custkey as invited_user_id, min((o_custkey*3+1)%1000) as invited_by, case when min(l_orderkey)%3=0 then 'pending' when min(l_orderkey)%3=1 then 'accepted' else 'declined' end as status, min(o_orderdate) as created_at from lineitem join orders on l_orderkey=o_orderkey where l_linenumber=2 and l_quantity<=5 group by l_suppkey, o_custkey""",
    "f_requests": """select min(l_orderkey) as request_id, l_suppkey as group_id, o_custkey as user_id, case when min(l_orderkey)%3=0 then 'pending' when min(l_orderkey)%3=1 then 'approved' else 'declined' end as status, min(o_orderdate) as created_at from lineitem join orders on l_orderkey=o_orderkey where l_linenumber=3 and l_quantity<=5 group by l_suppkey, o_custkey""",
    "f_friends": """select edge_id, user_id, friend_id, status, created_at from (select o_orderkey as edge_id, o_custkey as user_id, o_friend as friend_id, status, created_at, row_number() over (partition by least(o_custkey,o_friend), greatest(o_custkey,o_friend) order by o_orderkey) as rn from (select o_orderkey, o_custkey, (o_custkey*7+o_orderkey)%(select count(*) from customer) as o_friend, case o_orderstatus when 'F' then 'accepted' when 'P' then 'pending' else 'declined' end as status, o_orderdate as created_at from orders) a) b where rn=1 and user_id<>friend_id""",
    "f_shares": """select user_id as owner_id, friend_id as viewer_id from f_friends where status='accepted' and edge_id%3=0""",
    "f_alerts": """select event_id as alert_id, case event_type when 'error' then 'hazard' when 'click' then 'crowd' when 'view' then 'construction' when 'signup' then 'elevator_down' else 'building_closure' end as type, 'f' || cast(user_id%7 as varchar(2)) as floor_id, cast(event_id*37%9973 as double)/9973 as x, cast(event_id*5471%9973 as double)/9973 as y, user_id as submitted_by, 'active' as status, ts as created_at, ts + (case event_type when 'view' then 4320 when 'signup' then 1440 when 'purchase' then 480 else 30 end) * interval '1' minute as expires_at from events""",
    "f_votes": """select l_orderkey%(select count(*) from events) as alert_id, l_suppkey as user_id, case when l_returnflag='R' then 'deny' else 'confirm' end as vote, l_shipdate as voted_at, l_orderkey*10+l_linenumber as seq from lineitem""",
    "f_cal": """select o_orderkey as event_id, o_custkey as user_id, case when o_orderkey%3=0 then o_orderkey%10 end as group_id, cast(o_orderdate as date) as event_date, lpad(cast(1+o_orderkey%12 as varchar(2)),2,'0') || ':' || lpad(cast(o_orderkey*7%60 as varchar(2)),2,'0') || case when o_orderkey%2=0 then ' AM' else ' PM' end as time, o_orderkey%4=0 as notify, case o_orderpriority when '1-URGENT' then 'daily' when '2-HIGH' then 'weekly' when '3-MEDIUM' then 'monthly' end as recurrence, cast(1+o_orderkey%3 as int) as recurrence_interval, case when o_orderpriority in ('1-URGENT','2-HIGH','3-MEDIUM') then cast(o_orderdate + (10+o_orderkey%80) * interval '1' day as date) end as recur_end_date, 'B' || cast(o_custkey%25 as varchar(4)) || ' - 2.' || cast(100+o_orderkey%900 as varchar(8)) as location from orders""",
    "f_nodes": """select p_partkey as node_id, 'f' || cast(p_partkey%7 as varchar(2)) as floor_id, cast(p_partkey%7 as int) as floor_no, cast(p_partkey*37%997 as double)/997 as x, cast(p_partkey*211%991 as double)/991 as y, cast(1+p_partkey%7 as varchar(2)) || '.' || cast(100+p_partkey%900 as varchar(8)) as label, case when p_partkey%50=0 then 'elevator' when p_partkey%50=1 then 'stairwell' when p_partkey%10=2 then 'hallway' else 'room' end as type from part""",
    "f_edges": """select p_partkey as src, p_partkey+7 as dst, cast(10+p_partkey%13 as double) as weight, false as inter_floor from part where p_partkey%35<>0 and p_partkey+7<(select count(*) from part) union all select p_partkey, p_partkey+70, cast(60+p_partkey%17 as double), false from part where p_partkey%3=0 and p_partkey+70<(select count(*) from part) union all select p_partkey, p_partkey+1, cast(5 as double), true from part where p_partkey%50=0 and p_partkey%7<6 and p_partkey+1<(select count(*) from part)""",
    "f_cells": """select s_suppkey as floor_id, a.x as x, b.y as y, case when (a.x*7+b.y*13+s_suppkey*5)%11<2 or a.x=0 or b.y=0 or a.x=47 or b.y=47 then 0 else 1 end as passable from supplier, range(48) as a(x), range(48) as b(y) where s_suppkey%10=0""",
    "f_detections": """select p_partkey*2+k.k as det_id, 'f' || cast(p_partkey%7 as varchar(2)) as floor_id, cast(p_partkey%7 as int)+1 as floor_num, case when p_partkey%9=0 then 'STAIR' when p_partkey%11=0 then 'ELEV' when k.k=0 then cast(1+p_partkey%7 as varchar(2)) || ',' || cast(100+p_partkey%900 as varchar(8)) else cast(1+p_partkey%7 as varchar(2)) || ' ' || cast(100+p_partkey%900 as varchar(8)) end as raw_text, cast(p_partkey*37%997 as double)/997+k.k*0.005 as x, cast(p_partkey*211%991 as double)/991 as y, cast((p_partkey*17+k.k*29)%100 as double)/100 as conf from part, range(2) as k(k)""",
    "f_places": """select s_suppkey as place_id, s_name as name, 30.25+cast(s_suppkey*37%997 as double)/9970 as lat, -97.80+cast(s_suppkey*211%991 as double)/9910 as lon from supplier""",
    "f_pings": """select user_id, ts, 30.28+cast(event_id*37%997 as double)/99700 as lat, -97.74+cast(event_id*211%991 as double)/99100 as lon from events""",
    "f_accel": """select user_id, event_id, ts, 0.0*value as ax, 0.0*value as ay, 0.8+value/100 as az, cast(event_id*41%360 as double) as heading_raw from events""",
    "f_attempts": """select event_id as attempt_id, user_id, ts as attempted_at from events where event_type in ('signup','error')""",
    "f_buildings": """select n_nationkey as ord, 'B' || cast(n_nationkey as varchar(4)) as code, lower(n_name) || ' hall' as full_name, n_name as display_name, case when n_nationkey%2=0 then n_name || ' campus' end as search_hint, lower(n_name) as alias_a, 'hall ' || cast(n_nationkey as varchar(4)) as alias_b from nation""",
    "f_route_points": """select user_id*1000000007 + cast(floor((rn-1)/6) as bigint) as route_id, (rn-1)%6 as seq, lat, lon from (select user_id, 30.28+cast(event_id*37%997 as double)/99700 as lat, -97.74+cast(event_id*211%991 as double)/99100 as lon, row_number() over (partition by user_id order by event_id) as rn from events) e""",
    "f_waypoints": """select user_id*1000000007 + cast(floor((rn-1)/5) as bigint) as route_id, user_id, (rn-1)%5 as seq, 'f' || cast(rn%3 as varchar(2)) as floor_id, cast(event_id*37%9973 as double)/9973 as x, cast(event_id*5471%9973 as double)/9973 as y from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as rn from events) e""",
    "f_walls": """select s_suppkey as seg_id, 'f' || cast(s_suppkey%7 as varchar(2)) as floor_id, cast(s_suppkey*37%997 as double) as x0, cast(s_suppkey*211%991 as double) as y0, cast(s_suppkey*37%997 as double) + cast(s_suppkey%3 as double)*cast(5+s_suppkey%400 as double) as x1, cast(s_suppkey*211%991 as double) + cast((s_suppkey+1)%2 as double)*cast(3+s_suppkey%90 as double) as y1 from supplier""",
}

#: Views that make many rows of each of a small file's; its rows are dealt among tasks before.
MULTIPLIED = {"f_cells": "supplier"}


def needed(sql: str) -> list[str]:
    """Names of the views that a statement reads, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bf_\w+", text):
            if name in VIEWS and name not in found:
                visit(VIEWS[name])
                found.append(name)

    visit(sql)
    return found


def with_views(sql: str) -> str:
    """The statement with the views that it reads as common table expressions."""
    names = needed(sql)
    if not names:
        return sql
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if recursive:
        body = body[len("WITH RECURSIVE ") :]
    elif body.upper().startswith("WITH "):
        body = body[len("WITH ") :]
    else:
        body = None
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{views}" + (f",\n{body}" if body is not None else f"\n{sql.strip()}")


class Fixtures:
    """Tables and views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.sql(f"select * from {name}")

    def sql(self, text: str) -> DataFrame:
        full = with_views(text)
        frames = {t: self.spark.read.parquet(f"{self.folder}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", full)}
        for t in {t for view, t in MULTIPLIED.items() if re.search(rf"\b{view}\b", full)}:
            frames[t] = frames[t].repartition(2 * self.spark.sparkContext.defaultParallelism)
        full = full.replace("{", "{{").replace("}", "}}")
        for t in frames:
            full = re.sub(rf"(?i)\b(from|join|,)(\s+){t}\b(?!\s*\()", rf"\1\2{{{t}}} as {t}", full)
        return self.spark.sql(full, **frames)
