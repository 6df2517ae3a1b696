"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

A source with ``n`` rows and target weight ``w`` gets the mean repetition rate
``total * w / sum(w) / n``. Each document takes a number in [0, 1) from a hash of
the seed and its doc_id and inverts the Poisson distribution with that rate: the
number of values of the cumulative distribution at or below it is the number of
copies. Documents are exploded by it and shuffled globally by a hash key, so hot
sources spread over all tasks; per-source counts are pre-aggregated in the scan.

Defined results: rows with a null source form a source of their own; a source
without a target weight, or with a weight of 0 or less, gets no copies; null
texts are kept as they are; rows that repeat a doc_id get the same number of
copies each. An empty table gives an empty result. Columns of ``docs`` called
like the added ones (copy, n_copies, shuffle_key, in any case of letters) are
replaced by ``mix_sources`` and kept by ``replicated``; all columns travel inside a
struct, so no name can clash.

The table of rates has a row per source. It is broadcast if it holds at most
``BROADCAST_VALUES`` numbers, and joined by a shuffle of the rows beyond that.

Every rate is inverted. Up to ``TABLE_MOST`` a source has one table of the cumulative
distribution. Above it, where a source has few rows beside the others, each row sums
the distribution itself, in logs over 12 standard deviations on both sides of the rate
(less than 1e-30 lies outside), so no long table is built or joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import cut, uniform

SEED = 17
TABLE_MOST = 512.0
#: Copies made by one row of the first explosion; a second one makes the rest.
BLOCK = 1024
#: Numbers in a table of rates that is broadcast (8 MB).
BROADCAST_VALUES = 1_000_000
ADDED = ("copy", "n_copies", "shuffle_key")


def _inverted(rate: str, u: str) -> str:
    """SQL of the number of values at or below u in the cumulative Poisson distribution of a large rate.

    ln(k!) is taken by Stirling's series, whose error is below 1e-15 at these k.
    """
    chance = (
        f"exp(k * ln({rate} / k) + (k - {rate}) - 0.5D * ln(2 * pi() * k) - 1 / (12D * k) + 1 / (360D * k * k * k))"
    )
    first = f"cast(floor({rate} - 12 * sqrt({rate})) as bigint)"
    last = f"cast(ceil({rate} + 12 * sqrt({rate}) + 24) as bigint)"
    return f"""aggregate(transform(sequence({first}, {last}), k -> {chance}),
        named_struct('c', 0D, 'n', {first}),
        (s, p) -> named_struct('c', s.c + p, 'n', s.n + if(s.c + p <= {u}, 1L, 0L)),
        s -> s.n)"""


def source_rates(
    docs: DataFrame, weights: dict | None = None, epochs: float = 1.0, source_col: str = "source"
) -> tuple[DataFrame, bool]:
    """(mix_source, rate, cdf) per source, and whether these rows hold at most ``BROADCAST_VALUES`` numbers.

    ``weights`` None: every source alike.
    """
    counts = cut(docs.groupBy(F.col(_quoted(source_col)).alias("mix_source")).agg(F.count(F.lit(1)).alias("n")))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), float(max(value, 0.0))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    total, all_weights = counts.agg(F.sum("n"), F.sum("weight")).first()
    scale = float(epochs) * (total or 0) / all_weights if all_weights else 0.0
    rates = (
        counts.withColumn("rate", F.lit(scale) * F.col("weight") / F.col("n"))
        .withColumn("top", F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 24).cast("long"))
        .withColumn(
            "cdf",
            F.expr(
                f"""case when rate <= 0 then array(1.0D) when rate > {TABLE_MOST}D then array()
                else aggregate(sequence(1, top),
                  named_struct('lp', -rate, 'c', exp(-rate), 'a', array(exp(-rate))),
                  (s, k) -> named_struct('lp', s.lp + ln(rate) - ln(k), 'c', s.c + exp(s.lp + ln(rate) - ln(k)),
                                         'a', array_append(s.a, s.c + exp(s.lp + ln(rate) - ln(k)))),
                  s -> s.a) end"""
            ),
        )
        .select("mix_source", "rate", "cdf", "top")
    )
    values = rates.agg(F.sum(F.when(F.col("rate") > TABLE_MOST, 2).otherwise(F.col("top") + 2))).first()[0]
    return rates.drop("top"), (values or 0) <= BROADCAST_VALUES


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_copies(
    docs: DataFrame,
    weights: dict | None = None,
    epochs: float = 1.0,
    seed: int = SEED,
    source_col: str = "source",
) -> DataFrame:
    """(row, id, u, n_copies): each row of ``docs`` as a struct with its hash-seeded Poisson count; no row is dropped yet."""
    rates, small = source_rates(docs, weights, epochs, source_col)
    kept = [F.col(_quoted(c)) for c in docs.columns]
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    rows = docs.select(F.struct(*kept).alias("row"), id_, F.col(_quoted(source_col)).alias("source")).withColumn(
        "u", uniform(F.lit(str(seed)), F.col("id"))
    )
    return rows.join(F.broadcast(rates) if small else rates, F.col("source").eqNullSafe(F.col("mix_source")), "left").select(
        "row",
        "id",
        F.when(F.col("rate") > TABLE_MOST, F.expr(_inverted("rate", "u")))
        .otherwise(F.expr("size(filter(cdf, c -> c <= u))"))
        .cast("long")
        .alias("n_copies"),
    )


def _mixed(docs: DataFrame, weights: dict | None, epochs: float, seed: int, source_col: str) -> DataFrame:
    """(row, n_copies, copy, shuffle_key): every row as often as drawn, in globally shuffled order."""
    drawn = with_copies(docs, weights, epochs, seed, source_col).filter("n_copies > 0")
    blocks = drawn.withColumn("block", F.explode(F.expr(f"sequence(0L, (n_copies - 1) div {BLOCK})")))
    copies = blocks.withColumn(
        "copy", F.explode(F.expr(f"sequence(block * {BLOCK}, least(n_copies, (block + 1) * {BLOCK}) - 1)"))
    )
    parts = [F.lit(str(seed + 2)), F.col("id"), F.col("copy").cast("string")]
    key = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long").alias("shuffle_key")
    # rows that repeat a doc_id share a key; their contents deal them to different tasks
    keyed = copies.select("row", "n_copies", "copy", key).repartition(F.col("shuffle_key"), F.xxhash64("row"))
    return keyed.sortWithinPartitions("shuffle_key")


def mix_sources(
    docs: DataFrame,
    weights: dict | None = None,
    epochs: float = 1.0,
    seed: int = SEED,
    source_col: str = "source",
) -> DataFrame:
    """The columns of ``docs`` and n_copies, copy (from 0) and shuffle_key: every row as often as drawn, shuffled."""
    kept = [F.col(f"row.{_quoted(c)}") for c in docs.columns if c.lower() not in ADDED]
    return _mixed(docs, weights, epochs, seed, source_col).select(*kept, "n_copies", "copy", "shuffle_key")


def replicated(docs: DataFrame, weights: dict | None = None, epochs: float = 1.0, seed: int = SEED, source_col: str = "source") -> DataFrame:
    """The rows of ``mix_sources`` with the columns of ``docs`` alone, whatever they are called."""
    return _mixed(docs, weights, epochs, seed, source_col).select("row.*")
