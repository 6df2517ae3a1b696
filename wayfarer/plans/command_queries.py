"""Registered queries over command logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.operators import commands as cm
from wayfarer.operators.places import building_keys
from wayfarer.plans.registry import now, query
from wayfarer.plans.spatial_queries import CLUSTERS, clustered
from wayfarer.plans.sql_parts import admitted
from wayfarer.plans.text_queries import BUILD, dictionary

A1 = "SELECT o_orderkey AS command_id, CASE WHEN o_orderkey%11=0 THEN NULL ELSE o_custkey END AS caller_id, CASE WHEN o_orderkey%7=0 THEN '  ' WHEN o_orderkey%7=1 THEN repeat('x',130) ELSE ' Group ' END AS name, CASE WHEN o_orderkey%5=0 THEN 'club' WHEN o_orderkey%5=1 THEN 'campus_org' ELSE 'friends' END AS type, repeat('d', cast(o_orderkey%1100 as int)) AS description, repeat('u', cast(o_orderkey%2500 as int)) AS image_url, repeat('p', cast(o_orderkey%220 as int)) AS password, o_orderkey%3=0 AS is_private FROM orders"
query("cmd1_decide_create_group", f"""SELECT command_id, caller_id, CASE WHEN caller_id IS NULL THEN 'not_authenticated' WHEN length(trim(name)) NOT BETWEEN 1 AND 120 THEN 'invalid_name' WHEN type NOT IN ('friends','campus_org') THEN 'invalid_type' WHEN length(description)>1000 THEN 'description_too_long' WHEN length(image_url)>2048 THEN 'image_url_too_long' WHEN length(password)>200 THEN 'password_too_long' ELSE 'success' END AS code,
 trim(name) AS name, (type='friends' AND NOT is_private AND password<>'') AS has_join_password FROM ({A1}) c""")(lambda t: cm.decide_create_group(t.sql(A1)))
A2 = "SELECT attempt_id AS command_id, user_id, CASE WHEN attempt_id%3=0 THEN 'zz' ELSE ' c' || cast(3*(attempt_id%30) as varchar(9)) END AS join_code, attempted_at FROM f_attempts"
G2 = "SELECT *, 'C' || cast(group_id as varchar(9)) AS join_code FROM f_groups"
query("cmd2_decide_join_by_code", f"""WITH RECURSIVE {admitted('c', f'SELECT *, attempted_at AS moment FROM ({A2}) a', 'command_id', 5, 86400)}, r AS (SELECT c.*, g.group_id, m.user_id IS NOT NULL AS inside FROM c LEFT JOIN ({G2}) g ON g.is_private AND upper(g.join_code)=upper(trim(c.join_code)) LEFT JOIN f_members m ON m.group_id=g.group_id AND m.user_id=c.user_id)
 SELECT command_id, user_id, group_id, CASE WHEN NOT admitted THEN 'rate_limited' WHEN group_id IS NULL THEN 'invalid_code' WHEN inside OR coalesce(sum((admitted AND group_id IS NOT NULL)::INT) OVER (PARTITION BY group_id, user_id ORDER BY moment, command_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)>0 THEN 'already_member' ELSE 'success' END AS code FROM r""")(lambda t: cm.decide_join_by_code(t.sql(A2), t.sql(G2), t("f_members"), 5, 86400))
A3 = "SELECT o_orderkey AS command_id, o_custkey AS user_id, o_orderkey%110 AS group_id, o_orderkey%2=0 AS password_ok FROM orders"
query("cmd3_decide_join_group", f"""WITH b AS (SELECT command_id, c.user_id, c.group_id, CASE WHEN g.name IS NULL THEN 'not_found' WHEN is_private THEN 'private_group' WHEN type<>'friends' THEN 'wrong_type' WHEN has_join_password AND NOT password_ok THEN 'incorrect_password' WHEN m.user_id IS NOT NULL THEN 'already_member' ELSE 'success' END AS code FROM ({A3}) c LEFT JOIN f_groups g USING (group_id) LEFT JOIN f_members m ON m.group_id=c.group_id AND m.user_id=c.user_id)
 SELECT command_id, CASE WHEN code='success' AND row_number() OVER (PARTITION BY group_id, user_id, code ORDER BY command_id)>1 THEN 'already_member' ELSE code END AS code FROM b""")(lambda t: cm.decide_join_group(t.sql(A3), t("f_groups"), t("f_members")))
A4 = "SELECT r.request_id AS command_id, m.user_id AS caller_id, r.request_id + CASE WHEN r.request_id%13=0 THEN 1000000 ELSE 0 END AS request_id, CASE r.request_id%7 WHEN 0 THEN 'maybe' WHEN 1 THEN 'decline' ELSE 'approve' END AS action FROM f_requests r JOIN (SELECT group_id, min(user_id) AS user_id FROM f_members WHERE role<>'member' GROUP BY group_id) m ON r.group_id=m.group_id"
query("cmd4_decide_join_request", f"""WITH d AS (SELECT command_id, CASE WHEN r.status IS NULL OR r.status<>'pending' THEN 'not_found' WHEN a.user_id IS NULL THEN 'not_authorized' WHEN action='approve' THEN 'approve' WHEN action='decline' THEN 'decline' ELSE 'invalid_action' END AS code, r.user_id FROM ({A4}) c LEFT JOIN f_requests r USING (request_id) LEFT JOIN f_members a ON a.group_id=r.group_id AND a.user_id=c.caller_id AND a.role='admin')
 SELECT command_id, code, CASE WHEN code='approve' THEN user_id END AS new_member FROM d""")(lambda t: cm.decide_join_request(t.sql(A4), t("f_requests"), t("f_members")))
A5 = "SELECT i.invite_id AS command_id, m.user_id AS caller_id, i.group_id, CASE i.invite_id%4 WHEN 0 THEN i.invited_user_id WHEN 1 THEN m.user_id ELSE i.invited_user_id+1 END AS invited_user_id FROM f_invites i JOIN (SELECT group_id, min(user_id) AS user_id FROM f_members WHERE role='admin' GROUP BY group_id) m ON i.group_id=m.group_id"
query("cmd5_decide_invite", f"""SELECT command_id, CASE WHEN a.user_id IS NULL THEN 'not_authorized' WHEN caller_id=c.invited_user_id THEN 'cannot_invite_self' WHEN m.user_id IS NOT NULL THEN 'already_member' WHEN i.status='pending' THEN 'already_invited' WHEN i.status IS NOT NULL THEN 'reopened' ELSE 'invited' END AS code FROM ({A5}) c LEFT JOIN f_members a ON a.group_id=c.group_id AND a.user_id=c.caller_id AND a.role='admin'
 LEFT JOIN f_members m ON m.group_id=c.group_id AND m.user_id=c.invited_user_id LEFT JOIN f_invites i ON i.group_id=c.group_id AND i.invited_user_id=c.invited_user_id""")(lambda t: cm.decide_invite(t.sql(A5), t("f_invites"), t("f_members")))
A6 = "SELECT invite_id AS command_id, invite_id, invited_user_id + CASE WHEN invite_id%5=0 THEN 1 ELSE 0 END AS user_id, CASE invite_id%4 WHEN 0 THEN 'accept' WHEN 1 THEN 'decline' ELSE 'later' END AS action FROM f_invites"
query("cmd6_decide_invite_response", f"""WITH d AS (SELECT command_id, i.group_id, CASE WHEN i.group_id IS NULL THEN 'not_found' WHEN action='accept' THEN 'accept' WHEN action='decline' THEN 'decline' ELSE 'invalid_action' END AS code FROM ({A6}) c LEFT JOIN f_invites i ON i.invite_id=c.invite_id AND i.invited_user_id=c.user_id AND i.status='pending') SELECT command_id, code, CASE WHEN code='accept' THEN group_id END AS joined_group FROM d""")(
    lambda t: cm.decide_invite_response(t.sql(A6), t("f_invites"))
)
A7 = "SELECT m.group_id*100000+m.user_id AS command_id, CASE WHEN m.user_id%17=0 THEN NULL WHEN m.user_id%6=0 THEN m.user_id ELSE a.user_id END AS caller_id, m.group_id, m.user_id + CASE WHEN m.user_id%8=3 THEN 1 ELSE 0 END AS user_id, CASE WHEN m.user_id%2=0 THEN 'role' ELSE 'remove' END AS action, CASE m.user_id%5 WHEN 0 THEN 'boss' WHEN 1 THEN 'admin' ELSE 'member' END AS new_role FROM f_members m JOIN (SELECT group_id, max(user_id) AS user_id FROM f_members WHERE role='admin' GROUP BY group_id) a ON m.group_id=a.group_id"
query("cmd7_decide_member_change", f"""WITH fo AS (SELECT group_id, user_id AS founder_id FROM f_members WHERE role='admin' QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY joined_at NULLS LAST, user_id)=1)
 SELECT command_id, CASE WHEN caller_id IS NULL THEN 'not_authenticated' WHEN action='role' AND new_role NOT IN ('admin','editor','member') THEN 'invalid_role' WHEN action='role' AND caller_id=c.user_id THEN 'cannot_modify_self' WHEN caller_id=c.user_id THEN 'use_leave_group' WHEN a.role IS NULL OR a.role<>'admin' THEN 'not_authorized' WHEN m.role IS NULL THEN 'not_member' WHEN action='role' AND new_role=m.role THEN 'success'
 WHEN m.role='admin' AND caller_id<>founder_id THEN 'founder_only' ELSE 'success' END AS code FROM ({A7}) c LEFT JOIN f_members a ON a.group_id=c.group_id AND a.user_id=c.caller_id LEFT JOIN f_members m ON m.group_id=c.group_id AND m.user_id=c.user_id LEFT JOIN fo ON fo.group_id=c.group_id""")(
    lambda t: cm.decide_member_change(t.sql(A7), t("f_members"))
)
A8 = "SELECT group_id*100000+user_id AS command_id, group_id, user_id FROM f_members WHERE user_id%3<>1 UNION ALL SELECT group_id*100000+99999, group_id, 99999999 FROM f_groups"
query("cmd8_decide_leave", f"""WITH n AS (SELECT group_id, count(*) AS n FROM f_members WHERE role='admin' GROUP BY group_id), r AS (SELECT command_id, c.group_id, m.role, n FROM ({A8}) c LEFT JOIN f_members m ON m.group_id=c.group_id AND m.user_id=c.user_id LEFT JOIN n ON n.group_id=c.group_id)
 SELECT command_id, CASE WHEN role IS NULL THEN 'not_member' WHEN role='admin' AND row_number() OVER (PARTITION BY group_id, role ORDER BY command_id)>=n THEN 'last_admin' ELSE 'success' END AS code FROM r""")(lambda t: cm.decide_leave(t.sql(A8), t("f_members")))
A9 = "SELECT event_id AS command_id, user_id, CASE WHEN event_id%19=0 THEN user_id WHEN event_id%23=0 THEN 99999999 ELSE (user_id*3+event_id)%1500 END AS friend_id, ts AS attempted_at FROM events"
query("cmd9_decide_friend_request", f"""WITH RECURSIVE a AS ({A9}), k AS (SELECT user_id, friend_id FROM f_friends UNION SELECT friend_id, user_id FROM f_friends), r AS (SELECT a.*, k.user_id IS NOT NULL AS known, p.user_id IS NOT NULL AS found, row_number() OVER (PARTITION BY least(a.user_id,a.friend_id), greatest(a.user_id,a.friend_id) ORDER BY attempted_at, command_id)=1 AS first_try
  FROM a LEFT JOIN k ON k.user_id=a.user_id AND k.friend_id=a.friend_id LEFT JOIN f_profiles p ON p.user_id=a.friend_id), q AS (SELECT *, NOT known AND found AND user_id<>friend_id AND first_try AS fresh, attempted_at AS moment FROM r),
 {admitted('c', 'SELECT * FROM q', 'friend_id, command_id', 10, 86400, 'fresh')}
 SELECT command_id, CASE WHEN user_id=friend_id THEN 'cannot_add_self' WHEN NOT admitted THEN 'rate_limited' WHEN known THEN 'already_exists' WHEN NOT found THEN 'user_not_found' WHEN NOT fresh THEN 'already_exists' ELSE 'success' END AS code FROM c""")(lambda t: cm.decide_friend_request(t.sql(A9), t("f_friends"), t("f_profiles"), 10, 86400))
A10 = "SELECT owner_id AS command_id, owner_id, CASE WHEN owner_id%9=0 THEN ' ' ELSE 'B1' END AS building, repeat('r', cast(owner_id%90 as int)) AS room, array_agg(CASE WHEN owner_id%6=0 AND viewer_id%2=0 THEN owner_id ELSE viewer_id + CASE WHEN owner_id%10=1 THEN 1 ELSE 0 END END) AS viewers FROM f_shares GROUP BY owner_id"
query("cmd10_decide_location_pin", f"""WITH c AS ({A10}), b AS (SELECT user_id AS o, friend_id AS v FROM f_friends WHERE status='accepted' UNION SELECT friend_id, user_id FROM f_friends WHERE status='accepted'), e AS (SELECT command_id, owner_id, unnest(viewers) AS v FROM c), k AS (SELECT e.command_id, bool_and(b.o IS NOT NULL) AS ok, bool_or(e.v=e.owner_id) AS self FROM e LEFT JOIN b ON b.o=e.owner_id AND b.v=e.v GROUP BY e.command_id)
 SELECT command_id, CASE WHEN trim(building)='' THEN 'invalid_building' WHEN length(room)>80 THEN 'invalid_room' WHEN len(viewers)>200 THEN 'too_many_viewers' WHEN self THEN 'invalid_viewer' WHEN NOT ok THEN 'not_friends' ELSE 'success' END AS code FROM c JOIN k USING (command_id)""")(lambda t: cm.decide_location_pin(t.sql(A10), t("f_friends")))
VOTES11 = "SELECT min(v.seq) AS vote_id, c.cluster_id, v.user_id, max(v.vote) AS vote FROM f_votes v JOIN c ON v.alert_id=c.alert_id GROUP BY c.cluster_id, v.user_id"
query("cmd11_decide_cluster_vote", f"""{CLUSTERS}, w AS ({VOTES11}) SELECT vote_id, c.alert_id, w.user_id, w.vote, CASE WHEN c.alert_id=c.cluster_id AND w.vote='confirm' THEN greatest(expires_at, $NOW) + INTERVAL 30 MINUTE END AS new_expiry, CASE WHEN submitted_by<>w.user_id THEN submitted_by END AS rescore FROM w JOIN c ON c.cluster_id=w.cluster_id""")(
    lambda t: cluster_votes(t)
)


def cluster_votes(t):
    members = clustered(t).select("cluster_id", "alert_id")
    cast = t("f_votes").join(members, "alert_id").groupBy("cluster_id", "user_id").agg(F.min("seq").alias("vote_id"), F.max("vote").alias("vote"))
    return cm.decide_cluster_vote(cast, members, t("f_alerts"), now())


A12 = "SELECT alert_id AS command_id, submitted_by AS caller_id, type, CASE WHEN alert_id%3=0 THEN '  ' ELSE ' hole ' END AS description, created_at AS made_at FROM f_alerts"
query("cmd12_decide_alert_submit", f"SELECT command_id, CASE WHEN flagged THEN 'flagged' ELSE 'success' END AS code, caller_id AS submitted_by, nullif(trim(description),'') AS description, made_at + to_minutes(CASE type WHEN 'construction' THEN 4320 WHEN 'elevator_down' THEN 1440 WHEN 'building_closure' THEN 480 WHEN 'crowd' THEN 30 WHEN 'hazard' THEN 30 ELSE 60 END) AS expires_at FROM ({A12}) c LEFT JOIN f_profiles p ON p.user_id=c.caller_id")(
    lambda t: cm.decide_alert_submit(t.sql(A12), t("f_profiles"))
)
A13 = "SELECT group_id*100000+user_id AS command_id, user_id AS caller_id, group_id, CASE WHEN user_id%3=0 THEN ' ' WHEN user_id%3=1 THEN repeat('d', 1100) ELSE ' text ' END AS description FROM f_members"
query("cmd13_decide_description_edit", f"WITH d AS (SELECT command_id, description, CASE WHEN role NOT IN ('admin','editor') THEN 'not_authorized' WHEN length(trim(description))>1000 THEN 'description_too_long' ELSE 'success' END AS code FROM ({A13}) c JOIN f_members m ON m.group_id=c.group_id AND m.user_id=c.caller_id) SELECT command_id, code, CASE WHEN code='success' THEN nullif(trim(description),'') END AS description FROM d")(
    lambda t: cm.decide_description_edit(t.sql(A13), t("f_members"))
)
A14 = "SELECT event_id AS command_id, user_id AS caller_id, CASE WHEN event_id%13=0 THEN ' ' ELSE 't' END AS title, CASE WHEN event_id%11=0 THEN NULL ELSE time END AS time, group_id, CASE WHEN event_id%4=0 THEN 'Hall 3' WHEN event_id%4=1 THEN 'nowhere' ELSE '' END AS building, CASE WHEN event_id%5=0 THEN '1.100' WHEN event_id%5=1 THEN 'x9' ELSE '' END AS room, recurrence, event_date, CASE WHEN event_id%3=0 THEN event_date ELSE recur_end_date END AS recur_end_date FROM f_cal"
query("cmd14_decide_event_save", f"""WITH {BUILD}, rm AS (SELECT DISTINCT lower(label) AS l FROM f_nodes), d AS (SELECT command_id, bk.code AS b, nullif(trim(room),'') AS room, CASE WHEN trim(title)='' THEN 'missing_title' WHEN time IS NULL THEN 'missing_time' WHEN c.group_id IS NOT NULL AND a.user_id IS NULL THEN 'not_group_admin' WHEN building<>'' AND bk.code IS NULL THEN 'unknown_building' WHEN room<>'' AND rm.l IS NULL THEN 'unknown_room' WHEN recurrence IS NOT NULL AND (recur_end_date IS NULL OR recur_end_date<=event_date) THEN 'invalid_recurrence_end' ELSE 'success' END AS code
 FROM ({A14}) c LEFT JOIN (SELECT DISTINCT group_id, user_id FROM f_members WHERE role='admin') a ON a.group_id=c.group_id AND a.user_id=c.caller_id LEFT JOIN bk ON bk.key=lower(building) LEFT JOIN rm ON rm.l=lower(room)) SELECT command_id, code, CASE WHEN code='success' THEN concat_ws(' - ', b, room) END AS location FROM d""")(
    lambda t: cm.decide_event_save(t.sql(A14), t("f_members"), building_keys(dictionary(t)), t("f_nodes"))
)
A15 = "SELECT group_id*100000+user_id AS command_id, user_id AS caller_id, m.group_id, CASE WHEN user_id%5=0 THEN ' new ' WHEN user_id%5=1 THEN '' ELSE g.name END AS name, 'd' AS description, CASE WHEN user_id%3=0 THEN '' ELSE repeat('p', cast(user_id%250 as int)) END AS password, user_id%2=0 AS password_on, user_id%7=0 AS make_private FROM f_members m JOIN (SELECT group_id AS gid, name FROM f_groups) g ON m.group_id=g.gid"
query("cmd15_decide_group_update", f"""WITH d AS (SELECT command_id, password, password_on, make_private, g.type, m.role, CASE WHEN m.role NOT IN ('admin','editor') THEN 'not_authorized' WHEN m.role='editor' AND trim(c.name)<>g.name THEN 'editors_description_only' WHEN length(trim(c.name)) NOT BETWEEN 1 AND 120 THEN 'invalid_name' WHEN length(password)>200 THEN 'password_too_long' ELSE 'success' END AS code FROM ({A15}) c JOIN f_members m ON m.group_id=c.group_id AND m.user_id=c.caller_id JOIN f_groups g ON g.group_id=c.group_id)
 SELECT command_id, code, CASE WHEN code='success' THEN CASE WHEN role='editor' THEN 'kept' WHEN NOT (type='friends' AND NOT make_private AND password_on) THEN 'cleared' WHEN password='' THEN 'kept' ELSE 'set' END END AS password, CASE WHEN code='success' AND role<>'editor' THEN NOT make_private END AS code_cleared FROM d""")(
    lambda t: cm.decide_group_update(t.sql(A15), t("f_groups"), t("f_members"))
)
A16 = "SELECT request_id*2 AS command_id, user_id + CASE WHEN request_id%5=0 THEN 1 ELSE 0 END AS user_id, group_id, CASE WHEN request_id%2=0 THEN 'open' ELSE 'cancel' END AS action FROM f_requests"
query("cmd16_decide_request_open_cancel", f"SELECT command_id, CASE WHEN action='open' THEN CASE WHEN r.status IS NOT NULL THEN 'already_requested' ELSE 'opened' END WHEN r.status IS NULL THEN 'not_found' WHEN r.status<>'pending' THEN 'not_pending' ELSE 'cancelled' END AS code FROM ({A16}) c LEFT JOIN f_requests r ON r.group_id=c.group_id AND r.user_id=c.user_id")(
    lambda t: cm.decide_request_open_cancel(t.sql(A16), t("f_requests"))
)
query("str6_admission_limiter", f"WITH RECURSIVE {admitted('c', 'SELECT *, attempted_at AS moment FROM f_attempts', 'attempt_id', 5, 86400)} SELECT attempt_id, user_id, admitted FROM c")(lambda t: cm.admit(t("f_attempts"), 5, 86400).select("attempt_id", "user_id", "admitted"))
