"""Command logs as batch decisions: a result code per command, and the rows it would add or remove.

Commands of one key act in time order where a later one depends on an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.scalars import alert_expiry
from wayfarer.operators import social as so


def codes(*rules: tuple[Column, str], otherwise: str = "success") -> Column:
    """The code of the first rule that holds."""
    out = F.lit(otherwise)
    for rule, code in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), code).otherwise(out)
    return out


def _blank(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def decide_create_group(commands: DataFrame) -> DataFrame:
    """Commands (command_id, caller_id, name, type, description, image_url, password, is_private)."""
    code = codes(
        (F.col("caller_id").isNull(), "not_authenticated"),
        (~F.length(F.trim("name")).between(1, 120) | F.col("name").isNull(), "invalid_name"),
        (~F.col("type").isin("friends", "campus_org") | F.col("type").isNull(), "invalid_type"),
        (F.length("description") > 1000, "description_too_long"),
        (F.length("image_url") > 2048, "image_url_too_long"),
        (F.length("password") > 200, "password_too_long"),
    )
    keeps = (F.col("type") == "friends") & ~F.col("is_private") & _blank("password").isNotNull()
    return commands.select("command_id", "caller_id", code.alias("code"), F.trim("name").alias("name"), F.coalesce(keeps, F.lit(False)).alias("has_join_password"))


def _member_role(commands: DataFrame, members: DataFrame, who: str, name: str) -> DataFrame:
    role = members.select("group_id", F.col("user_id").alias(who), F.col("role").alias(name))
    return commands.join(role, ["group_id", who], "left")


def admit(attempts: DataFrame, n: int, seconds: int, key: str = "user_id", ts: str = "attempted_at", counts: str | None = None) -> DataFrame:
    """``admitted``: sequential limit of n admitted attempts in the trailing seconds; rejected ones do not count.

    With ``counts`` only attempts where that column is true use up the limit. State is one
    user's admitted times within the window, so a user's attempts are read in one ordered pass.
    """
    from pyspark.sql.types import BooleanType, StructField, StructType

    rows = attempts.withColumn("limit_us", F.unix_micros(F.col(ts).cast("timestamp")))
    schema = StructType([*rows.schema.fields, StructField("admitted", BooleanType())])

    def of(pdfs):
        from collections import deque

        import pandas as pd

        held, recent, begun = None, deque(), False
        for pdf in pdfs:
            out = []
            uses = pdf[counts].fillna(False).astype(bool).tolist() if counts else [True] * len(pdf)
            for k, at, use in zip(pdf[key].tolist(), pdf["limit_us"].tolist(), uses):
                if not (begun and (k == held or (pd.isna(k) and pd.isna(held)))):
                    held, recent, begun = k, deque(), True
                while recent and recent[0] <= at - seconds * 1_000_000:
                    recent.popleft()
                out.append(len(recent) < n)
                if out[-1] and use:
                    recent.append(at)
            yield pdf.assign(admitted=out)

    ids = [c for c in rows.columns if c.endswith("_id") and c != key]
    return rows.repartition(key).sortWithinPartitions(key, "limit_us", *ids).mapInPandas(of, schema).drop("limit_us")


def decide_join_by_code(commands: DataFrame, groups: DataFrame, members: DataFrame, limit: int = 5, seconds: int = 60) -> DataFrame:
    """Commands (command_id, user_id, join_code, attempted_at); groups with their join_code."""
    limited = admit(commands, limit, seconds)
    key = F.upper(F.trim("join_code"))
    private = groups.filter("is_private").select(F.upper("join_code").alias("key"), "group_id")
    rows = limited.withColumn("key", key).join(private, "key", "left").join(members.select("group_id", "user_id", F.lit(True).alias("inside")), ["group_id", "user_id"], "left")
    order = Window.partitionBy("group_id", "user_id").orderBy("attempted_at", "command_id")
    earlier = F.count_if(F.col("admitted") & F.col("group_id").isNotNull()).over(order.rowsBetween(Window.unboundedPreceding, -1)) > 0
    code = codes((~F.col("admitted"), "rate_limited"), (F.col("group_id").isNull(), "invalid_code"), (F.col("inside") | earlier, "already_member"))
    return rows.select("command_id", "user_id", "group_id", code.alias("code"))


def decide_join_group(commands: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Commands (command_id, user_id, group_id, password_ok); later repeats of a join find a member."""
    rows = commands.join(groups, "group_id", "left").join(members.select("group_id", "user_id", F.lit(True).alias("inside")), ["group_id", "user_id"], "left")
    order = Window.partitionBy("group_id", "user_id").orderBy("command_id")
    base = codes(
        (F.col("name").isNull(), "not_found"),
        (F.col("is_private"), "private_group"),
        (F.col("type") != "friends", "wrong_type"),
        (F.col("has_join_password") & ~F.col("password_ok"), "incorrect_password"),
        (F.col("inside"), "already_member"),
    )
    earlier = F.count_if(F.col("base") == "success").over(order.rowsBetween(Window.unboundedPreceding, -1)) > 0
    return rows.withColumn("base", base).select(
        "command_id", F.when((F.col("base") == "success") & earlier, "already_member").otherwise(F.col("base")).alias("code")
    )


def decide_join_request(commands: DataFrame, requests: DataFrame, members: DataFrame) -> DataFrame:
    """Commands (command_id, caller_id, request_id, action); only admins of the group decide pending requests."""
    rows = commands.join(requests.select("request_id", "group_id", "user_id", "status"), "request_id", "left")
    rows = rows.join(so.admins(members).withColumn("admin", F.lit(True)), ["group_id", "caller_id"], "left")
    code = codes(
        (F.col("status").isNull() | (F.col("status") != "pending"), "not_found"),
        (F.col("admin").isNull(), "not_authorized"),
        (F.col("action") == "approve", "approve"),
        (F.col("action") == "decline", "decline"),
        otherwise="invalid_action",
    )
    return rows.select("command_id", code.alias("code"), F.when(code == "approve", F.col("user_id")).alias("new_member"))


def decide_invite(commands: DataFrame, invites: DataFrame, members: DataFrame) -> DataFrame:
    """Commands (command_id, caller_id, group_id, invited_user_id)."""
    rows = commands.join(so.admins(members).withColumn("admin", F.lit(True)), ["group_id", "caller_id"], "left")
    rows = rows.join(members.select("group_id", F.col("user_id").alias("invited_user_id"), F.lit(True).alias("inside")), ["group_id", "invited_user_id"], "left")
    rows = rows.join(invites.select("group_id", "invited_user_id", "status"), ["group_id", "invited_user_id"], "left")
    code = codes(
        (F.col("admin").isNull(), "not_authorized"),
        (F.col("caller_id") == F.col("invited_user_id"), "cannot_invite_self"),
        (F.col("inside"), "already_member"),
        (F.col("status") == "pending", "already_invited"),
        (F.col("status").isNotNull(), "reopened"),
        otherwise="invited",
    )
    return rows.select("command_id", code.alias("code"))


def decide_invite_response(commands: DataFrame, invites: DataFrame) -> DataFrame:
    """Commands (command_id, user_id, invite_id, action)."""
    own = invites.filter("status = 'pending'").select("invite_id", F.col("invited_user_id").alias("user_id"), "group_id")
    rows = commands.join(own, ["invite_id", "user_id"], "left")
    code = codes(
        (F.col("group_id").isNull(), "not_found"), (F.col("action") == "accept", "accept"), (F.col("action") == "decline", "decline"), otherwise="invalid_action"
    )
    return rows.select("command_id", code.alias("code"), F.when(code == "accept", F.col("group_id")).alias("joined_group"))


def decide_member_change(commands: DataFrame, members: DataFrame) -> DataFrame:
    """Commands (command_id, caller_id, group_id, user_id, action, new_role): change a role or remove a member."""
    rows = _member_role(commands, members, "caller_id", "caller_role")
    rows = _member_role(rows, members, "user_id", "target_role").join(so.group_founder(members), "group_id", "left")
    change = F.col("action") == "role"
    admin_touched = (F.col("target_role") == "admin") & (F.col("caller_id") != F.col("founder_id"))
    code = codes(
        (F.col("caller_id").isNull(), "not_authenticated"),
        (change & ~F.col("new_role").isin("admin", "editor", "member"), "invalid_role"),
        (change & (F.col("caller_id") == F.col("user_id")), "cannot_modify_self"),
        (~change & (F.col("caller_id") == F.col("user_id")), "use_leave_group"),
        (F.col("caller_role").isNull() | (F.col("caller_role") != "admin"), "not_authorized"),
        (F.col("target_role").isNull(), "not_member"),
        (change & (F.col("new_role") == F.col("target_role")), "success"),
        (admin_touched, "founder_only"),
    )
    return rows.select("command_id", code.alias("code"))


def decide_leave(commands: DataFrame, members: DataFrame) -> DataFrame:
    """Commands (command_id, user_id, group_id) in order: the last admin stays, also when others left earlier in the batch."""
    admins = members.filter("role = 'admin'").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_admins"))
    rows = _member_role(commands, members, "user_id", "role").join(admins, "group_id", "left")
    again = F.row_number().over(Window.partitionBy("group_id", "user_id").orderBy("command_id")) > 1
    rows = rows.withColumn("role", F.when(again, F.lit(None)).otherwise(F.col("role")))
    before = F.count_if(F.col("role") == "admin").over(Window.partitionBy("group_id").orderBy("command_id").rowsBetween(Window.unboundedPreceding, -1))
    left = F.col("n_admins") - F.least(before, F.col("n_admins") - 1)
    code = codes((F.col("role").isNull(), "not_member"), ((F.col("role") == "admin") & (left <= 1), "last_admin"))
    return rows.select("command_id", code.alias("code"))


def decide_friend_request(commands: DataFrame, friends: DataFrame, profiles: DataFrame, limit: int = 10, seconds: int = 3600) -> DataFrame:
    """Commands (command_id, user_id, friend_id, attempted_at); only successes use up the hourly limit."""
    known = friends.select("user_id", "friend_id").union(friends.select("friend_id", "user_id")).distinct().withColumn("known", F.lit(True))
    rows = commands.join(known, ["user_id", "friend_id"], "left").join(profiles.select(F.col("user_id").alias("friend_id"), F.lit(True).alias("found")), "friend_id", "left")
    pair = Window.partitionBy(F.least("user_id", "friend_id"), F.greatest("user_id", "friend_id")).orderBy("attempted_at", "command_id")
    fresh = F.col("known").isNull() & F.col("found").isNotNull() & (F.col("user_id") != F.col("friend_id"))
    rows = rows.withColumn("fresh", F.coalesce(fresh, F.lit(False)) & (F.row_number().over(pair) == 1))
    rows = admit(rows, limit, seconds, counts="fresh")
    code = codes(
        (F.col("user_id") == F.col("friend_id"), "cannot_add_self"),
        (~F.col("admitted"), "rate_limited"),
        (F.col("known"), "already_exists"),
        (F.col("found").isNull(), "user_not_found"),
        (~F.col("fresh"), "already_exists"),
    )
    return rows.select("command_id", code.alias("code"))


def decide_location_pin(commands: DataFrame, friends: DataFrame) -> DataFrame:
    """Commands (command_id, owner_id, building, room, viewers array): a pin with its viewers, all accepted friends."""
    v = commands.select("command_id", "owner_id", F.explode_outer("viewers").alias("viewer_id"))
    pairs = so.both_directions(friends).select(F.col("viewer_id").alias("owner_id"), F.col("friend_id").alias("viewer_id"), F.lit(True).alias("ok")).distinct()
    friendly = v.join(pairs, ["owner_id", "viewer_id"], "left").groupBy("command_id").agg(
        F.bool_and(F.coalesce("ok", F.lit(False))).alias("all_friends")
    )
    rows = commands.join(friendly, "command_id")
    bad_viewer = F.exists("viewers", lambda x: x.isNull() | (x == F.col("owner_id")))
    code = codes(
        (_blank("building").isNull() | (F.length(F.trim("building")) > 160), "invalid_building"),
        (F.length("room") > 80, "invalid_room"),
        (F.size("viewers") > 200, "too_many_viewers"),
        (bad_viewer, "invalid_viewer"),
        ((F.size("viewers") > 0) & ~F.col("all_friends"), "not_friends"),
    )
    return rows.select("command_id", code.alias("code"))


def decide_cluster_vote(votes: DataFrame, members: DataFrame, alerts: DataFrame, now: Column) -> DataFrame:
    """Votes (vote_id, cluster_id, user_id, vote) on every member alert; a confirm extends the oldest one by half an hour."""
    known = members.select("cluster_id", "alert_id").join(alerts.select("alert_id", "expires_at", "submitted_by", "created_at"), "alert_id")
    leads = known.groupBy("cluster_id").agg(F.min(F.struct("created_at", "alert_id")).alias("lead")).select("cluster_id", "lead.alert_id")
    rows = votes.join(known, "cluster_id").join(leads.withColumnRenamed("alert_id", "lead_id"), "cluster_id")
    later = F.greatest("expires_at", now) + F.make_dt_interval(mins=F.lit(30))
    return rows.select(
        "vote_id",
        "alert_id",
        "user_id",
        "vote",
        F.when((F.col("alert_id") == F.col("lead_id")) & (F.col("vote") == "confirm"), later).alias("new_expiry"),
        F.when(F.col("submitted_by") != F.col("user_id"), F.col("submitted_by")).alias("rescore"),
    )


def decide_alert_submit(commands: DataFrame, profiles: DataFrame) -> DataFrame:
    """Commands (command_id, caller_id, type, description, made_at)."""
    rows = commands.join(profiles.select(F.col("user_id").alias("caller_id"), "flagged"), "caller_id", "left")
    code = codes((F.col("flagged"), "flagged"))
    return rows.select("command_id", code.alias("code"), F.col("caller_id").alias("submitted_by"), _blank("description").alias("description"), alert_expiry("type", "made_at").alias("expires_at"))


def decide_description_edit(commands: DataFrame, members: DataFrame) -> DataFrame:
    """Commands (command_id, caller_id, group_id, description)."""
    rows = _member_role(commands, members, "caller_id", "role")
    code = codes(
        (F.col("role").isNull() | ~F.col("role").isin("admin", "editor"), "not_authorized"), (F.length(F.trim("description")) > 1000, "description_too_long")
    )
    return rows.select("command_id", code.alias("code"), F.when(code == "success", _blank("description")).alias("description"))


def decide_event_save(commands: DataFrame, members: DataFrame, building_keys: DataFrame, rooms: DataFrame) -> DataFrame:
    """Commands (command_id, caller_id, title, time, group_id, building, room, recurrence, event_date, recur_end_date)."""
    rows = commands.join(so.admins(members).withColumn("admin", F.lit(True)), ["group_id", "caller_id"], "left")
    rows = rows.withColumn("key", F.lower(F.trim("building"))).join(building_keys.select("key", "code"), "key", "left")
    labels = rooms.select(F.lower("label").alias("room_key"), F.lit(True).alias("room_found")).distinct()
    rows = rows.withColumn("room_key", F.lower(F.trim("room"))).join(labels, "room_key", "left")
    verdict = codes(
        (_blank("title").isNull(), "missing_title"),
        (_blank("time").isNull(), "missing_time"),
        (F.col("group_id").isNotNull() & F.col("admin").isNull(), "not_group_admin"),
        (_blank("building").isNotNull() & F.col("code").isNull(), "unknown_building"),
        (_blank("room").isNotNull() & F.col("room_found").isNull(), "unknown_room"),
        (F.col("recurrence").isNotNull() & (F.col("recur_end_date").isNull() | (F.col("recur_end_date") <= F.col("event_date"))), "invalid_recurrence_end"),
    )
    place = F.concat_ws(" - ", "code", _blank("room"))
    return rows.select("command_id", verdict.alias("code"), F.when(verdict == "success", place).alias("location"))


def decide_group_update(commands: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Commands (command_id, caller_id, group_id, name, description, password, password_on, make_private)."""
    rows = _member_role(commands, members, "caller_id", "role").join(groups.select("group_id", F.col("name").alias("old_name"), "type"), "group_id", "left")
    editor = F.col("role") == "editor"
    code = codes(
        (F.col("role").isNull() | ~F.col("role").isin("admin", "editor"), "not_authorized"),
        (editor & (F.trim("name") != F.col("old_name")), "editors_description_only"),
        (~F.length(F.trim("name")).between(1, 120), "invalid_name"),
        (F.length("description") > 1000, "description_too_long"),
        (F.length("password") > 200, "password_too_long"),
    )
    may_have = (F.col("type") == "friends") & ~F.col("make_private") & F.col("password_on")
    password = F.when(~may_have, "cleared").when(_blank("password").isNull(), "kept").otherwise("set")
    return rows.select(
        "command_id",
        code.alias("code"),
        F.when(code == "success", F.when(editor, "kept").otherwise(password)).alias("password"),
        F.when((code == "success") & ~editor, ~F.col("make_private")).alias("code_cleared"),
    )


def decide_request_open_cancel(commands: DataFrame, requests: DataFrame) -> DataFrame:
    """Commands (command_id, user_id, group_id, action): open one request per group, cancel it while pending."""
    rows = commands.join(requests.select("group_id", "user_id", "status"), ["group_id", "user_id"], "left")
    opening = F.col("action") == "open"
    code = codes(
        (opening & F.col("status").isNotNull(), "already_requested"),
        (opening, "opened"),
        (F.col("status").isNull(), "not_found"),
        (F.col("status") != "pending", "not_pending"),
        otherwise="cancelled",
    )
    return rows.select("command_id", code.alias("code"))
