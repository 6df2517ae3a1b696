"""Rule audits over stored tables and object listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators.iterate import cut

#: Rows of a table whose keys one task compares.
TASK_ROWS = 250_000
#: The allowed values and lengths of the stored columns.
GROUP_TYPES = ("friends", "campus_org")
ROLES = ("admin", "editor", "member")
FRIEND_STATUSES = INVITE_STATUSES = ("pending", "accepted", "declined")
REQUEST_STATUSES = ("pending", "approved", "declined")
ALERT_TYPES = ("building_closure", "crowd", "elevator_down", "construction", "hazard", "other")
ALERT_STATUSES = ("active", "expired", "removed")
VOTES = ("confirm", "deny")
GROUP_LENGTHS = {"description": 1000, "image_url": 2048, "join_password": 200}
IMAGE_TYPES = ("jpeg", "jpg", "png", "webp")
MAX_NAME, MAX_IMAGE_BYTES = 120, 5 * 1024 * 1024


def _broken(df: DataFrame, table: str, rule: str, key: str, bad) -> DataFrame:
    return df.filter(bad).select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def _tasks(*tables: DataFrame) -> int:
    """So many tasks that each compares about TASK_ROWS rows of the largest table."""
    return 1 + max(t.count() for t in tables) // TASK_ROWS


def _repeated(df: DataFrame, table: str, rule: str, *columns) -> DataFrame:
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in columns])
    dealt = df.select(*columns).repartition(_tasks(df), *columns)
    return dealt.groupBy(*columns).count().filter("count > 1").select(F.lit(table), F.lit(rule), key)


def _orphans(df: DataFrame, table: str, rule: str, key: str, column: str, parents: DataFrame, parent: str) -> DataFrame:
    tasks = _tasks(df, parents)
    ids = parents.select(F.col(parent).alias(column)).repartition(tasks, column)
    rows = df.filter(F.col(column).isNotNull()).select(*{key: 0, column: 0}).repartition(tasks, column)
    return rows.join(ids, column, "left_anti").select(F.lit(table), F.lit(rule), F.col(key).cast("string"))


def constraint_audit(
    groups: DataFrame,
    members: DataFrame,
    friends: DataFrame,
    profiles: DataFrame,
    invites: DataFrame | None = None,
    requests: DataFrame | None = None,
    events: DataFrame | None = None,
    alerts: DataFrame | None = None,
    votes: DataFrame | None = None,
) -> DataFrame:
    """(table, rule, key) of the rows that break a declared rule; rules of absent tables and columns are left out.

    Tables of which several rules need all rows are written once in the shared folder; keys meet in as many
    tasks as the rows ask for.
    """
    members, friends, invites, requests = (None if df is None else cut(df) for df in (members, friends, invites, requests))
    pairs = friends.select(F.least("user_id", "friend_id").alias("a"), F.greatest("user_id", "friend_id").alias("b"))
    most = lambda df, table, key, limits: [
        _broken(df, table, f"{c}_length", key, F.length(c) > n) for c, n in limits.items() if c in df.columns
    ]
    between = lambda df, table, key, limits: [
        _broken(df, table, f"{c}_length", key, ~F.length(c).between(1, n)) for c, n in limits.items() if c in df.columns
    ]
    parts = [
        _broken(groups, "groups", "type", "group_id", ~F.col("type").isin(*GROUP_TYPES)),
        *between(groups, "groups", "group_id", {"name": MAX_NAME}),
        *most(groups, "groups", "group_id", GROUP_LENGTHS),
        _broken(members, "members", "role", "user_id", ~F.col("role").isin(*ROLES)),
        _broken(friends, "friends", "status", "edge_id", ~F.col("status").isin(*FRIEND_STATUSES)),
        _broken(friends, "friends", "self", "edge_id", F.col("user_id") == F.col("friend_id")),
        _repeated(members, "members", "unique", "group_id", "user_id"),
        _repeated(pairs, "friends", "unordered_unique", "a", "b"),
        _orphans(members, "members", "group", "user_id", "group_id", groups, "group_id"),
        _orphans(friends, "friends", "user", "edge_id", "user_id", profiles, "user_id"),
    ]
    if "join_code" in groups.columns:
        parts.append(_repeated(groups.filter("join_code is not null"), "groups", "join_code_unique", "join_code"))
    for df, table, key, user, statuses in (
        (invites, "invites", "invite_id", "invited_user_id", INVITE_STATUSES),
        (requests, "requests", "request_id", "user_id", REQUEST_STATUSES),
    ):
        if df is not None:
            parts += [
                _broken(df, table, "status", key, ~F.col("status").isin(*statuses)),
                _repeated(df, table, "unique", "group_id", user),
                _orphans(df, table, "group", key, "group_id", groups, "group_id"),
            ]
    if events is not None:
        parts += between(events, "events", "event_id", {"title": 200, "time": 20}) + most(events, "events", "event_id", {"location": 300})
    if alerts is not None:
        parts += [
            _broken(alerts, "alerts", "type", "alert_id", ~F.col("type").isin(*ALERT_TYPES)),
            _broken(alerts, "alerts", "status", "alert_id", ~F.col("status").isin(*ALERT_STATUSES)),
        ]
    if votes is not None:
        parts += [
            _broken(votes, "votes", "vote", "alert_id", ~F.col("vote").isin(*VOTES)),
            _repeated(votes, "votes", "unique", "alert_id", "user_id"),
        ]
        if alerts is not None:
            parts.append(_orphans(votes, "votes", "alert", "alert_id", "alert_id", alerts, "alert_id"))
    return reduce(DataFrame.union, parts)


def upload_object_audit(objects: DataFrame) -> DataFrame:
    """``allowed``: under the owner's folder, an image type, 1 byte to 5 MB."""
    folder = F.split_part("name", F.lit("/"), F.lit(1)) == F.col("owner_id").cast("string")
    kind = F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*IMAGE_TYPES)
    return objects.withColumn("allowed", folder & kind & F.col("size").between(1, MAX_IMAGE_BYTES))
