"""Reported alerts: activity, votes, trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_REPUTATION = 50


def active_alerts(alerts: DataFrame, now: Column, floor_id: str | None = None) -> DataFrame:
    """Alerts with status active that have not expired; of one floor if given."""
    out = alerts.filter((F.col("status") == "active") & (F.col("created_at") <= now) & (F.col("expires_at") > now))
    return out if floor_id is None else out.filter(F.col("floor_id") == floor_id)


def latest_vote(votes: DataFrame) -> DataFrame:
    """One vote per alert and user: the last written, by time and then sequence."""
    best = F.max_by(F.struct("vote", "voted_at", "seq"), F.struct("voted_at", "seq")).alias("last")
    return votes.groupBy("alert_id", "user_id").agg(best).select("alert_id", "user_id", "last.*")


def vote_tallies(votes: DataFrame) -> DataFrame:
    """Confirm and deny counts per alert; expects one vote per alert and user."""
    return votes.groupBy("alert_id").agg(
        F.count_if(F.col("vote") == "confirm").alias("confirms"), F.count_if(F.col("vote") == "deny").alias("denies")
    )


def alerts_with_votes(alerts: DataFrame, profiles: DataFrame, votes: DataFrame) -> DataFrame:
    """Alerts with the submitter's reputation (50 when unknown) and the counts of their latest votes."""
    wanted = votes.join(alerts.select("alert_id"), "alert_id", "left_semi")
    reputation = profiles.select(F.col("user_id").alias("submitted_by"), "reputation_score")
    zero = F.lit(0).cast("long")
    return (
        alerts.join(reputation, "submitted_by", "left")
        .join(vote_tallies(latest_vote(wanted)), "alert_id", "left")
        .withColumn("reputation", F.coalesce("reputation_score", F.lit(DEFAULT_REPUTATION)))
        .withColumn("confirms", F.coalesce("confirms", zero))
        .withColumn("denies", F.coalesce("denies", zero))
        .drop("reputation_score")
    )


def alert_trust_filter(alerts: DataFrame) -> DataFrame:
    """Trusted alerts: a denied one goes whatever its submitter; low reputation needs two confirms."""
    total = F.col("confirms") + F.col("denies")
    denied = (total >= 3) & (F.col("denies") / F.greatest(total, F.lit(1)) >= 0.6)
    return alerts.filter(~denied & ((F.col("reputation") >= 30) | (F.col("confirms") >= 2)))


def cluster_viewer_flags(members: DataFrame, leads: DataFrame, votes: DataFrame, viewers: DataFrame) -> DataFrame:
    """Per cluster and viewer: whether it is the viewer's own, the vote on its lead, and the number of reports.

    ``members`` (cluster_id, alert_id, submitted_by), ``leads`` (cluster_id, lead_id), ``viewers`` (cluster_id, viewer_id).
    """
    own = members.groupBy("cluster_id", F.col("submitted_by").alias("viewer_id")).agg(F.lit(True).alias("own"))
    reports = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("reports"))
    vote = latest_vote(votes).select(F.col("alert_id").alias("lead_id"), F.col("user_id").alias("viewer_id"), "vote")
    return (
        viewers.join(leads, "cluster_id")
        .join(reports, "cluster_id")
        .join(own, ["cluster_id", "viewer_id"], "left")
        .join(vote, ["lead_id", "viewer_id"], "left")
        .select("cluster_id", "viewer_id", F.coalesce("own", F.lit(False)).alias("own"), "vote", "reports")
    )


def trailing_counts(attempts: DataFrame, **spans: int) -> DataFrame:
    """Attempts of the same user in the trailing seconds, the current one included, the lower bound excluded."""
    micros = F.unix_micros(F.col("attempted_at").cast("timestamp"))
    out = attempts.withColumn("micros", micros)
    for name, seconds in spans.items():
        w = Window.partitionBy("user_id").orderBy("micros").rangeBetween(-seconds * 1_000_000 + 1, 0)
        out = out.withColumn(name, F.count(F.lit(1)).over(w))
    return out.drop("micros")
