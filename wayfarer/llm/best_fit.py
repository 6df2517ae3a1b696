"""Packing whole documents into as few token sequences as possible: patterns by non-negative least squares.

1. Each document becomes its token ids and the end id; only a longer one than a sequence
   is cut. Lengths travel on, texts and ids are never shuffled.
2. The histogram of lengths, at most ``size`` rows, comes to the driver. Patterns of at
   most three documents that fill a sequence exactly are enumerated, and repeat counts of
   at least zero are fitted to the histogram by least squares, weighted by length. Counts
   are rounded, largest first, and never use a length more often than it occurs.
3. What the rounded counts leave is packed best fit, longest first, whole counts of equal
   sequences at a time.
4. A piece gets its rank among the pieces of its length: a row number within (length,
   salt), where a length has one salt for every ``SALT_ROWS`` pieces up to ``SALTS``, plus
   the count of the salts before. Patterns own intervals of ranks; a join on length and
   rank gives sequence and offset.

The two tables joined to the pieces are broadcast only up to ``BROADCAST_ROWS`` rows,
counted before; beyond that Spark shuffles both sides.

Defined results: a null or empty text is one piece that holds the end id; of a text over
``size`` tokens every piece but the last is full, however long the text is; rows that
repeat, and rows with a null doc_id, are packed as often as they occur; an empty table
gives an empty result. Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm.common import cut
from wayfarer.llm.packing import intervals, pieces

SIZE = 2048
END_ID = 0
#: Pieces of one length and salt, and salts of a length at most.
SALT_ROWS, SALTS = 50_000, 128
#: Rows of a table that is sent to every executor: about 16 MB.
BROADCAST_ROWS = 400_000
#: The fit ends when a round lowers the squared error by less than this share, or after so many rounds.
GAIN, ROUNDS = 1e-2, 40
#: Gradient steps of a round.
STEPS = 200
#: A sequence of a pattern whose short documents have run out may lack this part of its tokens.
OPEN = 8

#: Equal sequences: tokens still free, how many, and [(length, copies), ...] of each.
Group = tuple[int, int, list[tuple[int, int]]]


def few_document_patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, of the given lengths that add up to ``size``; 0 stands for no document."""
    there = np.zeros(size + 1, bool)
    there[lengths] = there[0] = True
    found = []
    for a in np.sort(lengths)[::-1]:
        b = np.arange((size - a + 1) // 2, min(a, size - a) + 1)
        c = size - a - b
        b = b[there[b] & there[c]]
        found.append(np.stack([np.full(len(b), a), b, size - a - b], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fitted_counts(patterns: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the patterns in use and their real counts >= 0: the least-squares fit over a growing active set.

    Each round the pattern of steepest gain enters for every longest length. The fit over the
    active set is accelerated projected gradient; a step is scaled by the row sums of the
    normal matrix, which bound it from above. Patterns at zero leave.
    """
    size = len(wanted) - 1
    weight = np.arange(size + 1) / size  # of a missed document's square
    firsts = np.flatnonzero(np.r_[True, patterns[1:, 0] != patterns[:-1, 0]])
    groups = np.repeat(np.arange(len(firsts)), np.diff(np.r_[firsts, len(patterns)]))
    used, x, error = np.zeros(0, int), np.zeros(0), np.inf

    def missed(slots, x):
        return wanted - sum(np.bincount(s, x, size + 1) for s in slots)

    def slope(slots, rest):
        rest = weight * rest
        return sum(rest[s] for s in slots)

    for _ in range(ROUNDS):
        rest = missed(patterns[used].T, x)
        now = float((weight * rest**2)[1:].sum())
        if now > error * (1 - GAIN) or now <= 1e-9:
            break
        error = now
        gain = slope(patterns.T, rest)
        gain[used] = 0
        enter = np.flatnonzero((gain > 1e-9) & (gain == np.maximum.reduceat(gain, firsts)[groups]))
        enter = enter[np.unique(groups[enter], return_index=True)[1]]
        used, x = np.r_[used, enter], np.r_[x, np.zeros(len(enter))]
        slots = patterns[used].T
        bound = slope(slots, sum(np.bincount(s, minlength=size + 1) for s in slots))
        ahead, last, t = x, x, 1.0
        for _ in range(STEPS):
            x = np.maximum(0.0, ahead + slope(slots, missed(slots, ahead)) / bound)
            t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
            ahead, last = x + (before - 1) / t * (x - last), x
        used, x = used[x > 1e-6], x[x > 1e-6]
    return used, x


def rounded_patterns(patterns: np.ndarray, used: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[Group]:
    """Groups with whole counts; ``left`` loses what they use.

    Where the fit uses a short length more often than it occurs, sequences get their other
    documents only and stay open for the rest, if at most ``1 / OPEN`` of them is missing.
    """
    size, out = len(left) - 1, []
    for k in np.argsort(-x, kind="stable"):
        lengths, copies = np.unique(patterns[used[k]][patterns[used[k]] > 0], return_counts=True)
        n, free = int(np.floor(x[k] + 0.5)), 0
        while n > 0 and len(lengths) and free * OPEN <= size:
            there = left[lengths] // copies
            count = min(n, int(there.min()))
            if count:
                left[lengths] -= count * copies
                out.append((free, count, [(int(m), int(c)) for m, c in zip(lengths[::-1], copies[::-1])]))
                n -= count
            stay = left[lengths] >= copies
            if stay.all():
                break
            free += int((lengths * copies)[~stay].sum())
            lengths, copies = lengths[stay], copies[stay]
    return out


def best_fit(left: np.ndarray, size: int, groups: list[Group] = ()) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns for the given groups and the rest, longest first, each into the fullest sequence that has room."""
    rooms: list[int] = []  # sorted free sizes; ``at`` holds the groups of equal sequences of each
    at: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    closed = []

    def put(free, count, pattern):
        if not free:
            closed.append((count, pattern))
            return
        if free not in at:
            bisect.insort(rooms, free)
            at[free] = []
        at[free].append((count, pattern))

    for free, count, pattern in groups:
        put(free, count, pattern)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                free, count, pattern = size, n, []
            else:
                free = rooms[k]
                count, pattern = at[free].pop()
                if not at[free]:
                    del at[free], rooms[k]
            copies = free // length
            full, rest = divmod(n, copies)
            taken = min(count, full)
            if taken:
                put(free - copies * length, taken, pattern + [(length, copies)])
                n -= taken * copies
                count -= taken
            if count and 0 < n < copies:
                put(free - n * length, 1, pattern + [(length, n)])
                n, count = 0, count - 1
            if count and pattern:
                put(free, count, pattern)
    return closed + [group for groups in at.values() for group in groups]


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(count, [(length, copies), ...])]: patterns that hold every piece of the histogram once."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    patterns = few_document_patterns(np.flatnonzero(left), size)
    groups = []
    if len(patterns):
        groups = rounded_patterns(patterns, *fitted_counts(patterns, left.astype(float)), left)
    return best_fit(left, size, groups)


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = cut(pieces(docs, path, size, end_id).select("doc_id", "start", "length", "ids_crc32"))
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = intervals(plan(histogram, size))
    slot_table = spark.createDataFrame(
        slots, "slot_length long, rank_from long, rank_to long, copies long, first_sequence long, first_offset long"
    )
    salts = {length: min(SALTS, 1 + n // SALT_ROWS) for length, n in histogram.items()}
    salt_table = spark.createDataFrame(list(salts.items()), "length long, salts long")
    salted = rows.join(F.broadcast(salt_table), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), "salts")).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    by_salt = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    bases = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("place", F.row_number().over(within) - 1).join(_sent(bases, sum(salts.values())), ["length", "salt"])
    rank = F.col("place") + F.col("base")
    at = rank - F.col("rank_from")
    meets = (F.col("length") == F.col("slot_length")) & (rank >= F.col("rank_from")) & (rank < F.col("rank_to"))
    return ranked.join(_sent(slot_table, len(slots)), meets).select(
        "doc_id",
        F.floor(F.col("start") / size).cast("int").alias("piece"),
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (at % F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )
