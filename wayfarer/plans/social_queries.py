"""Registered queries over people, groups and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.operators import alerts as al
from wayfarer.operators import social as so
from wayfarer.plans.registry import now, query

ACTIVE = "SELECT * FROM f_alerts WHERE status='active' AND created_at <= $NOW AND expires_at > $NOW"
LAST = "SELECT alert_id, user_id, vote, voted_at, seq FROM f_votes QUALIFY row_number() OVER (PARTITION BY alert_id, user_id ORDER BY voted_at DESC, seq DESC)=1"
VOTED = f"""act AS ({ACTIVE}), last AS ({LAST}), tal AS (SELECT alert_id, sum((vote='confirm')::INT)::BIGINT AS confirms, sum((vote='deny')::INT)::BIGINT AS denies FROM last GROUP BY alert_id),
voted AS (SELECT a.*, coalesce(p.reputation_score, 50) AS reputation, coalesce(confirms,0) AS confirms, coalesce(denies,0) AS denies
 FROM act a LEFT JOIN f_profiles p ON a.submitted_by=p.user_id LEFT JOIN tal t ON a.alert_id=t.alert_id)"""
TRUST = "NOT (confirms+denies >= 3 AND denies::DOUBLE/(confirms+denies) >= 0.6) AND (reputation >= 30 OR confirms >= 2)"
BOTH = "both_ways AS (SELECT user_id AS viewer_id, friend_id FROM f_friends WHERE status='accepted' UNION ALL SELECT friend_id, user_id FROM f_friends WHERE status='accepted')"
KNOWN = "known AS (SELECT user_id AS viewer_id, friend_id AS other_id FROM f_friends WHERE status IN ('accepted','pending') UNION SELECT friend_id, user_id FROM f_friends WHERE status IN ('accepted','pending'))"
VIEWER = 40


def voted(t):
    return al.alerts_with_votes(al.active_alerts(t("f_alerts"), now()), t("f_profiles"), t("f_votes"))


query("fil1_active_alerts", f"SELECT alert_id, type, floor_id, x, y FROM ({ACTIVE}) a")(
    lambda t: al.active_alerts(t("f_alerts"), now()).select("alert_id", "type", "floor_id", "x", "y")
)
query("fil2_alert_trust", f"WITH {VOTED} SELECT alert_id, type, floor_id, reputation, confirms, denies FROM voted WHERE {TRUST}")(
    lambda t: al.alert_trust_filter(voted(t)).select("alert_id", "type", "floor_id", "reputation", "confirms", "denies")
)
query("joi1_alerts_with_votes", f"WITH {VOTED} SELECT alert_id, submitted_by, reputation, confirms, denies FROM voted")(
    lambda t: voted(t).select("alert_id", "submitted_by", "reputation", "confirms", "denies")
)
query("win8_latest_vote", f"SELECT alert_id, user_id, vote, seq FROM ({LAST}) v")(
    lambda t: al.latest_vote(t("f_votes")).drop("voted_at")
)
query("agg4_vote_tallies", f"SELECT alert_id, sum((vote='confirm')::INT)::BIGINT AS confirms, sum((vote='deny')::INT)::BIGINT AS denies FROM ({LAST}) v GROUP BY alert_id")(
    lambda t: al.vote_tallies(al.latest_vote(t("f_votes")))
)
query(
    "win2_trailing_attempt_counts",
    """SELECT attempt_id, user_id, count(*) OVER (w RANGE BETWEEN 60*1000000-1 PRECEDING AND CURRENT ROW) AS minute,
 count(*) OVER (w RANGE BETWEEN 3600*1000000::BIGINT-1 PRECEDING AND CURRENT ROW) AS hour, count(*) OVER (w RANGE BETWEEN 86400*1000000::BIGINT-1 PRECEDING AND CURRENT ROW) AS day
 FROM (SELECT *, epoch_us(attempted_at) AS us FROM f_attempts) a WINDOW w AS (PARTITION BY user_id ORDER BY us)""",
)(lambda t: al.trailing_counts(t("f_attempts"), minute=60, hour=3600, day=86400).drop("attempted_at"))

query("joi29_role_members", "SELECT group_id, user_id, role='admin' AS is_admin, role IN ('admin','editor') AS can_edit FROM f_members")(
    lambda t: so.role_members(t("f_members"))
)
query(
    "joi2_group_members",
    """SELECT group_id, m.user_id, coalesce(full_name,'Member') AS full_name, role, row_number() OVER (PARTITION BY group_id ORDER BY
 CASE role WHEN 'admin' THEN 0 WHEN 'editor' THEN 1 WHEN 'member' THEN 2 ELSE 3 END, coalesce(full_name,'Member'), m.user_id) AS place FROM f_members m LEFT JOIN f_profiles p ON m.user_id=p.user_id""",
)(lambda t: so.group_members_listing(t("f_members"), t("f_profiles")))
query(
    "joi3_pending_join_requests",
    """SELECT a.user_id AS caller_id, r.group_id, request_id, r.user_id, full_name, row_number() OVER (PARTITION BY a.user_id, r.group_id ORDER BY created_at, request_id) AS place
 FROM f_requests r JOIN f_members a ON r.group_id=a.group_id AND a.role='admin' LEFT JOIN f_profiles p ON r.user_id=p.user_id WHERE r.status='pending'""",
)(lambda t: so.pending_join_requests(t("f_requests"), t("f_profiles"), t("f_members")))
query(
    "joi4_pending_group_invites",
    """SELECT a.user_id AS caller_id, r.group_id, invite_id, invited_user_id, full_name, row_number() OVER (PARTITION BY a.user_id, r.group_id ORDER BY created_at DESC, invite_id) AS place
 FROM f_invites r JOIN f_members a ON r.group_id=a.group_id AND a.role='admin' LEFT JOIN f_profiles p ON r.invited_user_id=p.user_id WHERE r.status='pending'""",
)(lambda t: so.pending_group_invites(t("f_invites"), t("f_profiles"), t("f_members")))
query(
    "joi5_my_group_invites",
    "SELECT invited_user_id AS user_id, invite_id, i.group_id, g.name, g.type, p.full_name AS inviter FROM f_invites i JOIN f_groups g ON i.group_id=g.group_id LEFT JOIN f_profiles p ON i.invited_by=p.user_id WHERE i.status='pending'",
)(lambda t: so.my_group_invites(t("f_invites"), t("f_groups"), t("f_profiles")))
query(
    "joi6_invite_candidates",
    """SELECT user_id, full_name FROM f_profiles p WHERE contains(lower(full_name), '00') AND user_id<>40 AND user_id NOT IN (SELECT user_id FROM f_members WHERE group_id=3)
 AND user_id NOT IN (SELECT invited_user_id FROM f_invites WHERE group_id=3 AND status='pending') ORDER BY full_name, user_id LIMIT 20""",
)(lambda t: so.invite_candidates(t("f_profiles"), t("f_members"), t("f_invites"), 3, VIEWER, "00"))
query("joi7_my_friends", f"WITH {BOTH} SELECT viewer_id, friend_id, full_name, location_building, location_room FROM both_ways b JOIN f_profiles p ON b.friend_id=p.user_id")(
    lambda t: so.my_friends(t("f_friends"), t("f_profiles"))
)
HITS = "hits AS (SELECT user_id, full_name FROM f_profiles WHERE contains(lower(full_name), '01') AND user_id<>40 ORDER BY full_name, user_id LIMIT 30)"
query("fil4_literal_name_search", f"WITH {HITS} SELECT * FROM hits")(lambda t: so.literal_name_search(t("f_profiles"), " 01", VIEWER))
query("fil5_client_name_filter", "SELECT m.group_id, m.user_id FROM f_members m LEFT JOIN f_profiles p ON m.user_id=p.user_id WHERE contains(lower(coalesce(full_name,'Member')), '7')")(
    lambda t: so.client_name_filter(t("f_members").join(t("f_profiles"), "user_id", "left"), " 7").select("group_id", "user_id")
)
query(
    "fil3_group_facets",
    """SELECT g.group_id, g.name, g.type, CASE WHEN role='admin' THEN 'admin' ELSE 'member' END AS role FROM f_groups g JOIN f_members m ON g.group_id=m.group_id
 WHERE m.user_id=40 AND starts_with(lower(name),'supplier') AND type IN ('friends','campus_org') AND role<>'admin' AND NOT has_join_password""",
)(lambda t: so.group_facets(t("f_groups"), t("f_members"), VIEWER, "Supplier", ("friends", "campus_org"), ("member",), ("open",)))
query("joi8_find_new_friends", f"WITH {HITS}, {KNOWN} SELECT * FROM hits WHERE user_id NOT IN (SELECT other_id FROM known WHERE viewer_id=40)")(
    lambda t: so.find_new_friends(t("f_profiles"), t("f_friends"), VIEWER, "01")
)
query(
    "joi9_friends_on_campus",
    f"""WITH {BOTH} SELECT b.viewer_id, b.friend_id, full_name, (s.owner_id IS NOT NULL AND location_building IS NOT NULL) AS on_campus FROM both_ways b JOIN f_profiles p ON b.friend_id=p.user_id
 LEFT JOIN (SELECT DISTINCT * FROM f_shares) s ON s.owner_id=b.friend_id AND s.viewer_id=b.viewer_id""",
)(lambda t: so.friends_on_campus(t("f_friends"), t("f_shares"), t("f_profiles")))
query(
    "joi10_visible_profiles",
    f"""WITH {BOTH} SELECT user_id AS viewer_id, user_id AS profile_id FROM f_profiles UNION SELECT a.user_id, b.user_id FROM f_members a JOIN f_members b ON a.group_id=b.group_id
 UNION SELECT viewer_id, friend_id FROM both_ways UNION SELECT friend_id, user_id FROM f_friends WHERE status='pending' UNION SELECT owner_id, viewer_id FROM f_shares UNION SELECT viewer_id, owner_id FROM f_shares""",
)(lambda t: so.visible_profiles(t("f_profiles"), t("f_members"), t("f_friends"), t("f_shares")))
SEEN = "SELECT user_id AS viewer_id, group_id FROM f_members UNION SELECT invited_user_id, group_id FROM f_invites WHERE status='pending' UNION SELECT NULL, group_id FROM f_groups WHERE NOT is_private"
query("joi11_visible_groups", SEEN)(lambda t: so.visible_groups(t("f_groups"), t("f_members"), t("f_invites")))
query(
    "joi12_visible_owner_rows",
    """SELECT 'friends' AS kind, user_id AS viewer_id, edge_id AS id FROM f_friends UNION SELECT 'friends', friend_id, edge_id FROM f_friends UNION SELECT 'events', user_id, event_id FROM f_cal
 UNION SELECT 'requests', user_id, request_id FROM f_requests UNION SELECT 'requests', m.user_id, request_id FROM f_requests r JOIN f_members m ON r.group_id=m.group_id AND m.role='admin'""",
)(
    lambda t: so.visible_owner_rows(t("f_friends"), "edge_id", ["user_id", "friend_id"]).select(F.lit("friends").alias("kind"), "viewer_id", F.col("edge_id").alias("id"))
    .union(so.visible_owner_rows(t("f_cal"), "event_id", ["user_id"]).select(F.lit("events"), "viewer_id", "event_id"))
    .union(so.visible_requests(t("f_requests"), t("f_members")).select(F.lit("requests"), "viewer_id", "request_id"))
)
query("joi13_eligible_shares", f"WITH {BOTH} SELECT owner_id, viewer_id FROM f_shares s WHERE owner_id<>viewer_id AND EXISTS (SELECT 1 FROM both_ways b WHERE b.viewer_id=s.owner_id AND b.friend_id=s.viewer_id)")(
    lambda t: so.eligible_shares(t("f_shares"), t("f_friends"))
)
query(
    "joi14_discover_groups",
    "SELECT g.group_id, g.name, count(m.user_id) AS n_members FROM f_groups g LEFT JOIN f_members m ON g.group_id=m.group_id WHERE g.group_id NOT IN (SELECT group_id FROM f_members WHERE user_id=40) GROUP BY g.group_id, g.name",
)(lambda t: so.discover_groups(t("f_groups"), t("f_members"), VIEWER))
query("joi15_my_groups_admin", "SELECT m.user_id, m.group_id, name, role='admin' AS is_admin FROM f_members m JOIN f_groups g ON m.group_id=g.group_id")(
    lambda t: so.my_groups_admin(t("f_members"), t("f_groups"))
)
query("agg1_group_member_counts", "SELECT group_id, count(*) AS n_members FROM f_members GROUP BY group_id")(lambda t: so.group_member_counts(t("f_members")))
query("agg2_visible_group_member_counts", f"SELECT group_id, count(*) AS n_members FROM f_members WHERE group_id IN (SELECT group_id FROM ({SEEN}) s WHERE viewer_id IS NULL OR viewer_id=40) GROUP BY group_id")(
    lambda t: so.visible_group_member_counts(t("f_members"), t("f_groups"), t("f_invites"), VIEWER)
)
query(
    "agg3_group_stats_by_type",
    "SELECT user_id, sum((type='friends')::INT)::BIGINT AS friend_groups, sum((type='campus_org')::INT)::BIGINT AS campus_groups, count(*) AS memberships FROM f_members m LEFT JOIN f_groups g ON m.group_id=g.group_id GROUP BY user_id",
)(lambda t: so.group_stats_by_type(t("f_members"), t("f_groups")))
query("win1_group_founder", "SELECT group_id, user_id AS founder_id FROM f_members WHERE role='admin' QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY joined_at NULLS LAST, user_id)=1")(
    lambda t: so.group_founder(t("f_members"))
)
query("top3_bounded_group_list", "SELECT group_id, name FROM f_groups ORDER BY group_id LIMIT 500")(lambda t: so.bounded_group_list(t("f_groups")).select("group_id", "name"))
query("set1_both_direction_union", "SELECT DISTINCT least(user_id,friend_id) AS a, greatest(user_id,friend_id) AS b, status FROM f_friends")(lambda t: so.undirected_pairs(t("f_friends")))
query("set2_known_people", f"WITH {KNOWN} SELECT * FROM known")(lambda t: so.known_people(t("f_friends")))
WANTED = "SELECT owner_id, viewer_id+1 AS viewer_id FROM f_shares WHERE owner_id%2=0"
query(
    "set3_replace_shares",
    f"""WITH wanted AS ({WANTED}), new AS (SELECT DISTINCT * FROM wanted WHERE viewer_id IS NOT NULL AND viewer_id<>owner_id), old AS (SELECT DISTINCT * FROM f_shares WHERE owner_id IN (SELECT owner_id FROM wanted))
 SELECT *, 'added' AS change FROM (SELECT * FROM new EXCEPT SELECT * FROM old) a UNION ALL SELECT *, 'removed' FROM (SELECT * FROM old EXCEPT SELECT * FROM new) b""",
)(lambda t: so.replace_shares(t("f_shares"), t.sql(WANTED)))
SEARCHES = "SELECT event_id AS search_id, user_id, event_id%50 AS place_id, ts AS used_at FROM events"
query(
    "win7_recent_searches",
    f"""WITH s AS ({SEARCHES}), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, place_id ORDER BY used_at DESC, search_id DESC)=1)
 SELECT user_id, place_id, row_number() OVER (PARTITION BY user_id ORDER BY used_at DESC, search_id DESC) AS place FROM l QUALIFY place<=8""",
)(lambda t: so.recent_searches(t.sql(SEARCHES)))
query(
    "src5_read_entity_tables",
    "SELECT 'profiles' AS entity, count(*) AS n FROM f_profiles UNION ALL SELECT 'groups', count(*) FROM f_groups UNION ALL SELECT 'members', count(*) FROM f_members UNION ALL SELECT 'friends', count(*) FROM f_friends UNION ALL SELECT 'events', count(*) FROM f_cal UNION ALL SELECT 'alerts', count(*) FROM f_alerts UNION ALL SELECT 'votes', count(*) FROM f_votes",
)(lambda t: __import__("functools").reduce(lambda a, b: a.union(b), [t(v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("entity"), "n") for k, v in dict(profiles="f_profiles", groups="f_groups", members="f_members", friends="f_friends", events="f_cal", alerts="f_alerts", votes="f_votes").items()]))
