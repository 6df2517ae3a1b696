"""People and groups: membership, visibility, invitations, friendship. Queries cover all viewers unless one is given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.scalars import _c
from wayfarer.operators.iterate import cut

#: Pairs of people among which one task looks for equal ones.
TASK_PAIRS = 1_000_000
ROLE_ORDER = ("admin", "editor", "member")


def role_rank(role="role") -> Column:
    out = F.lit(len(ROLE_ORDER))
    for i, name in enumerate(ROLE_ORDER):
        out = F.when(_c(role) == name, i).otherwise(out)
    return out


def role_members(members: DataFrame) -> DataFrame:
    return members.select(
        "group_id", "user_id", (F.col("role") == "admin").alias("is_admin"), F.col("role").isin("admin", "editor").alias("can_edit")
    )


def admins(members: DataFrame, name: str = "caller_id") -> DataFrame:
    return members.filter("role = 'admin'").select("group_id", F.col("user_id").alias(name)).distinct()


def group_members_listing(members: DataFrame, profiles: DataFrame) -> DataFrame:
    """Members with names ('Member' when unknown) and a place by role, then name, then id."""
    named = members.join(profiles.select("user_id", "full_name"), "user_id", "left").withColumn(
        "full_name", F.coalesce("full_name", F.lit("Member"))
    )
    order = Window.partitionBy("group_id").orderBy(role_rank(), "full_name", "user_id")
    return named.withColumn("place", F.row_number().over(order)).select("group_id", "user_id", "full_name", "role", "place")


def pending_join_requests(requests: DataFrame, profiles: DataFrame, members: DataFrame) -> DataFrame:
    """(caller, request) for every admin of the request's group, oldest first."""
    pending = requests.filter("status = 'pending'").join(profiles.select("user_id", "full_name"), "user_id", "left")
    order = Window.partitionBy("caller_id", "group_id").orderBy("created_at", "request_id")
    return (
        pending.join(admins(members), "group_id")
        .withColumn("place", F.row_number().over(order))
        .select("caller_id", "group_id", "request_id", "user_id", "full_name", "place")
    )


def pending_group_invites(invites: DataFrame, profiles: DataFrame, members: DataFrame) -> DataFrame:
    """(caller, invite) for every admin of the inviting group, newest first."""
    names = profiles.select(F.col("user_id").alias("invited_user_id"), "full_name")
    order = Window.partitionBy("caller_id", "group_id").orderBy(F.desc("created_at"), "invite_id")
    return (
        invites.filter("status = 'pending'")
        .join(names, "invited_user_id", "left")
        .join(admins(members), "group_id")
        .withColumn("place", F.row_number().over(order))
        .select("caller_id", "group_id", "invite_id", "invited_user_id", "full_name", "place")
    )


def my_group_invites(invites: DataFrame, groups: DataFrame, profiles: DataFrame) -> DataFrame:
    names = profiles.select(F.col("user_id").alias("invited_by"), F.col("full_name").alias("inviter"))
    return (
        invites.filter("status = 'pending'")
        .join(groups.select("group_id", "name", "type"), "group_id")
        .join(names, "invited_by", "left")
        .select(F.col("invited_user_id").alias("user_id"), "invite_id", "group_id", "name", "type", "inviter")
    )


def literal_name_search(profiles: DataFrame, q: str, caller: int | None = None, limit: int = 30) -> DataFrame:
    """Profiles whose name contains the text as it stands, any case; under two characters finds nobody."""
    q = q.strip().lower()
    hits = profiles.filter(F.contains(F.lower("full_name"), F.lit(q)) & F.lit(len(q) >= 2))
    if caller is not None:
        hits = hits.filter(F.col("user_id") != caller)
    return hits.orderBy("full_name", "user_id").limit(limit).select("user_id", "full_name")


def client_name_filter(rows: DataFrame, q: str, missing: str = "Member") -> DataFrame:
    return rows.filter(F.contains(F.lower(F.coalesce("full_name", F.lit(missing))), F.lit(q.strip().lower())))


def group_facets(
    groups: DataFrame, members: DataFrame, viewer: int, q: str = "", types=(), roles=(), visibility=()
) -> DataFrame:
    """A viewer's groups by name prefix and facets; editors count as members; an empty facet filters nothing."""
    mine = members.filter(F.col("user_id") == viewer).select("group_id", F.when(F.col("role") == "admin", "admin").otherwise("member").alias("role"))
    out = groups.join(mine, "group_id").filter(F.startswith(F.lower("name"), F.lit(q.strip().lower())))
    if types:
        out = out.filter(F.col("type").isin(*types))
    if roles:
        out = out.filter(F.col("role").isin(*roles))
    if visibility:
        kind = F.when(F.col("has_join_password"), "password").otherwise("open")
        out = out.filter(kind.isin(*visibility))
    return out.select("group_id", "name", "type", "role")


def both_directions(friends: DataFrame) -> DataFrame:
    """Accepted friendships as (viewer_id, friend_id), once in each direction."""
    ok = friends.filter("status = 'accepted'")
    one = ok.select(F.col("user_id").alias("viewer_id"), "friend_id")
    two = ok.select(F.col("friend_id").alias("viewer_id"), F.col("user_id").alias("friend_id"))
    return one.unionByName(two)


def undirected_pairs(friends: DataFrame) -> DataFrame:
    return friends.select(
        F.least("user_id", "friend_id").alias("a"), F.greatest("user_id", "friend_id").alias("b"), "status"
    ).dropDuplicates(["a", "b"])


def my_friends(friends: DataFrame, profiles: DataFrame) -> DataFrame:
    people = profiles.select(F.col("user_id").alias("friend_id"), "full_name", "location_building", "location_room")
    return both_directions(friends).join(people, "friend_id").select("viewer_id", "friend_id", "full_name", "location_building", "location_room")


def known_people(friends: DataFrame) -> DataFrame:
    """(viewer_id, other_id): accepted either way, incoming and outgoing requests."""
    live = friends.filter("status in ('accepted', 'pending')")
    one = live.select(F.col("user_id").alias("viewer_id"), F.col("friend_id").alias("other_id"))
    two = live.select(F.col("friend_id").alias("viewer_id"), F.col("user_id").alias("other_id"))
    return one.union(two).distinct()


def find_new_friends(profiles: DataFrame, friends: DataFrame, viewer: int, q: str, limit: int = 30) -> DataFrame:
    """Search hits without the people that the viewer already knows."""
    known = known_people(friends).filter(F.col("viewer_id") == viewer).select(F.col("other_id").alias("user_id"))
    return literal_name_search(profiles, q, viewer, limit).join(known, "user_id", "left_anti")


def friends_on_campus(friends: DataFrame, shares: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each viewer's friends, flagged when they share their place with the viewer and have a building."""
    shared = shares.select("viewer_id", F.col("owner_id").alias("friend_id"), F.lit(True).alias("shared")).distinct()
    return my_friends(friends, profiles).join(shared, ["viewer_id", "friend_id"], "left").select(
        "viewer_id",
        "friend_id",
        "full_name",
        (F.col("shared").isNotNull() & F.col("location_building").isNotNull()).alias("on_campus"),
    )


def visible_profiles(profiles: DataFrame, members: DataFrame, friends: DataFrame, shares: DataFrame) -> DataFrame:
    """(viewer_id, profile_id): self, shared group, friends, requester to recipient, location-share counterparts.

    Pairs are dealt among as many tasks as their number asks for before equal ones meet.
    """
    pair = lambda df, a, b: df.select(F.col(a).alias("viewer_id"), F.col(b).alias("profile_id"))
    seats = cut(members.select("group_id", "user_id"))
    friends, shares = cut(friends.select("user_id", "friend_id", "status")), cut(shares.select("owner_id", "viewer_id"))
    pending = friends.filter("status = 'pending'")
    parts = [
        pair(seats.join(seats.withColumnRenamed("user_id", "other_id"), "group_id"), "user_id", "other_id"),
        pair(profiles.select("user_id", F.col("user_id").alias("me")), "user_id", "me"),
        pair(both_directions(friends), "viewer_id", "friend_id"),
        pair(pending, "friend_id", "user_id"),
        pair(shares, "owner_id", "viewer_id"),
        pair(shares, "viewer_id", "owner_id"),
    ]
    sizes = seats.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    together = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0]
    most = together + profiles.count() + 3 * friends.count() + 2 * shares.count()
    return reduce(DataFrame.union, parts).repartition(1 + most // TASK_PAIRS, "viewer_id", "profile_id").distinct()


def visible_groups(groups: DataFrame, members: DataFrame, invites: DataFrame) -> DataFrame:
    """(viewer_id, group_id) of members and pending invitees, and public groups once with a null viewer."""
    member = members.select(F.col("user_id").alias("viewer_id"), "group_id")
    invited = invites.filter("status = 'pending'").select(F.col("invited_user_id").alias("viewer_id"), "group_id")
    public = groups.filter("not is_private").select(F.lit(None).cast("long").alias("viewer_id"), "group_id")
    return member.union(invited).union(public).distinct()


def visible_owner_rows(rows: DataFrame, key: str, owners: list[str]) -> DataFrame:
    """(viewer_id, key): rows that their owners may see."""
    return rows.select(F.explode(F.array_distinct(F.array(*owners))).alias("viewer_id"), key).filter("viewer_id is not null")


def visible_requests(requests: DataFrame, members: DataFrame) -> DataFrame:
    """(viewer_id, request_id): the requester and the group's admins."""
    own = requests.select(F.col("user_id").alias("viewer_id"), "request_id")
    admin = requests.join(admins(members, "viewer_id"), "group_id").select("viewer_id", "request_id")
    return own.union(admin).distinct()


def eligible_shares(shares: DataFrame, friends: DataFrame) -> DataFrame:
    pairs = both_directions(friends).select(F.col("viewer_id").alias("owner_id"), F.col("friend_id").alias("viewer_id"))
    return shares.filter("owner_id <> viewer_id").join(pairs, ["owner_id", "viewer_id"], "left_semi")


def invite_candidates(profiles: DataFrame, members: DataFrame, invites: DataFrame, group: int, caller: int, q: str, limit: int = 20) -> DataFrame:
    """People by name who are neither the caller nor in the group nor already invited."""
    inside = members.filter(F.col("group_id") == group).select("user_id")
    asked = invites.filter((F.col("group_id") == group) & (F.col("status") == "pending")).select(F.col("invited_user_id").alias("user_id"))
    q = q.strip().lower()
    return (
        profiles.filter(F.contains(F.lower("full_name"), F.lit(q)) & F.lit(len(q) >= 2) & (F.col("user_id") != caller))
        .join(inside, "user_id", "left_anti")
        .join(asked, "user_id", "left_anti")
        .orderBy("full_name", "user_id")
        .limit(limit)
        .select("user_id", "full_name")
    )


def group_member_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"))


def discover_groups(groups: DataFrame, members: DataFrame, viewer: int) -> DataFrame:
    mine = members.filter(F.col("user_id") == viewer).select("group_id")
    return (
        groups.join(mine, "group_id", "left_anti")
        .join(group_member_counts(members), "group_id", "left")
        .select("group_id", "name", F.coalesce("n_members", F.lit(0)).cast("long").alias("n_members"))
    )


def visible_group_member_counts(members: DataFrame, groups: DataFrame, invites: DataFrame, viewer: int) -> DataFrame:
    seen = visible_groups(groups, members, invites).filter(F.col("viewer_id").isNull() | (F.col("viewer_id") == viewer))
    return group_member_counts(members.join(seen, "group_id", "left_semi"))


def my_groups_admin(members: DataFrame, groups: DataFrame) -> DataFrame:
    return members.join(groups.select("group_id", "name"), "group_id").select(
        "user_id", "group_id", "name", (F.col("role") == "admin").alias("is_admin")
    )


def group_stats_by_type(members: DataFrame, groups: DataFrame) -> DataFrame:
    typed = members.join(groups.select("group_id", "type"), "group_id", "left")
    return typed.groupBy("user_id").agg(
        F.count_if(F.col("type") == "friends").alias("friend_groups"),
        F.count_if(F.col("type") == "campus_org").alias("campus_groups"),
        F.count(F.lit(1)).alias("memberships"),
    )


def group_founder(members: DataFrame) -> DataFrame:
    """Earliest admin of each group; unknown join times last, then the smaller user id."""
    order = Window.partitionBy("group_id").orderBy(F.col("joined_at").asc_nulls_last(), "user_id")
    return (
        members.filter("role = 'admin'").withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("group_id", F.col("user_id").alias("founder_id"))
    )


def bounded_group_list(groups: DataFrame, limit: int = 500) -> DataFrame:
    return groups.orderBy("group_id").limit(limit)


def replace_shares(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """(owner_id, viewer_id, change): what a new viewer set adds and removes; nulls and the owner do not count."""
    new = wanted.filter("viewer_id is not null and viewer_id <> owner_id").select("owner_id", "viewer_id").distinct()
    old = current.select("owner_id", "viewer_id").join(wanted.select("owner_id").distinct(), "owner_id", "left_semi")
    added, removed = new.exceptAll(old), old.distinct().exceptAll(new)
    return added.withColumn("change", F.lit("added")).unionByName(removed.withColumn("change", F.lit("removed")))


def recent_searches(searches: DataFrame, keep: int = 8) -> DataFrame:
    """Latest use of each place per user, newest first, the first ``keep``."""
    last = searches.groupBy("user_id", "place_id").agg(F.max(F.struct("used_at", "search_id")).alias("last"))
    order = Window.partitionBy("user_id").orderBy(F.desc("last"))
    return last.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep).select("user_id", "place_id", "place")
