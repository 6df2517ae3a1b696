"""Exact deduplication with a heavy-hitter split; DataFrame functions only.

1. A Misra-Gries pass (``freqItems``) names every digest held by more than a
   share ``support`` of the rows. Its summary has at most ``1 / support`` digests.
2. A second pass verifies these candidates: exact group size and largest doc_id.
3. The verified winners, at most ``1 / support`` rows, are broadcast; rows that
   lose against them are decided where they are read and are never shuffled.
4. All other rows, and the winners themselves, are reduced by digest and doc_id
   before they meet by digest: size and largest doc_id come from combined counts and
   are joined back, so that no group is gathered in one place.

Defined results: a null text counts as empty; a null doc_id ranks below every
other; of rows that repeat both doc_id and text exactly one stays. Other columns,
whatever they are called, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm.common import cut, text_or_empty

#: Digests with more than this share of all rows are decided by broadcast.
SUPPORT = 0.001


def _digest(text_col: str):
    return F.sha2(text_or_empty(text_col), 256)


def heavy_winners(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(text_sha256, heavy_keep, heavy_size) of the verified frequent digests, at most 1 / support rows."""
    candidates = digests.stat.freqItems(["text_sha256"], support).select(
        F.explode("text_sha256_freqItems").alias("text_sha256")
    )
    return (
        digests.join(F.broadcast(candidates), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("heavy_keep"), F.count(F.lit(1)).alias("heavy_size"))
        .filter((F.col("heavy_size") > 1) & F.col("heavy_keep").isNotNull())
    )


def _lost(doc_id="doc_id"):
    return F.col("heavy_keep").isNotNull() & (F.col(doc_id).isNull() | (F.col(doc_id) < F.col("heavy_keep")))


def exact_groups(docs: DataFrame, text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = cut(docs.select("doc_id", _digest(text_col).alias("text_sha256")))
    winners = cut(heavy_winners(digests, support))
    rows = digests.join(F.broadcast(winners), "text_sha256", "left")
    lost = rows.filter(_lost()).select(
        "doc_id",
        F.col("heavy_keep").alias("keep_id"),
        F.col("heavy_size").alias("group_size"),
        F.lit(False).alias("kept"),
        "text_sha256",
    )
    # rows of one doc_id and text are alike, so a count stands for them
    each = rows.filter(~_lost()).groupBy("text_sha256", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("heavy_size").alias("heavy_size")
    )
    groups = each.groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"), F.coalesce(F.max("heavy_size"), F.sum("n")).alias("group_size")
    )
    at_keep = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    met = each.drop("heavy_size").join(groups, "text_sha256").withColumn(
        "place", F.explode(F.expr("sequence(1L, n)"))
    ).select("doc_id", "keep_id", "group_size", (at_keep & (F.col("place") == 1)).alias("kept"), "text_sha256")
    return lost.unionByName(met)


def drop_exact_copies(docs: DataFrame, text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the filter form of ``exact_groups``."""
    digests = cut(docs.select("doc_id", _digest(text_col).alias("text_sha256")))
    winners = cut(heavy_winners(digests, support))
    rows = docs.select(
        F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("id"),
        _digest(text_col).alias("text_sha256"),
    ).join(F.broadcast(winners), "text_sha256", "left")
    order = Window.partitionBy("text_sha256").orderBy(F.col("id").desc_nulls_last())
    return (
        rows.filter(~_lost("id"))
        .withColumn("place", F.row_number().over(order))
        .filter("place = 1")
        .select("row.*")
    )
