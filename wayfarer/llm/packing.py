"""Packing documents into fixed-length token sequences: shortest pack first over the length histogram.

1. Each document becomes its token ids and the end id, cut every ``size`` ids.
   Only piece lengths travel on; texts and ids are never shuffled.
2. The histogram of piece lengths, at most ``size`` rows, is packed on the driver:
   lengths longest first, each into the pack with the most room, whole counts of
   equal packs at a time. The result is a list of patterns with counts.
3. A piece gets its rank among the pieces of its length: a row number within
   (length, salt), so that a hot length spreads over ``SALTS`` groups, plus the
   count of the salts before. Patterns own intervals of ranks; a join on length
   and rank gives sequence and offset. The pattern table has a bound that depends
   on ``size`` alone (at most 2 * size patterns with fewer than 2 * sqrt(size)
   lengths each), so it is broadcast.

Defined results: a null or empty text is one piece that holds the end id; rows that
repeat are packed as often as they occur; an empty table gives an empty result.
Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm.common import cut
from wayfarer.llm.tokens import token_table, vocabulary_path

SIZE = 4096
END_ID = 2
SALTS = 128

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of every document."""
    path = path or vocabulary_path()
    end = int(end_id).to_bytes(4, "little")

    def of(batches):
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), token_table(batch, "text", path)):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[start * 4 : (start + size) * 4]
                    out.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        of, PIECE_SCHEMA
    )


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(count, [(length, copies), ...])]: patterns that hold every piece of the histogram."""
    room: list[tuple[int, int]] = []  # (-free, index): the pack with the most room first
    packs: list[tuple[int, int, list[tuple[int, int]]]] = []  # free, count, pattern

    def put(free, count, pattern):
        heapq.heappush(room, (-free, len(packs)))
        packs.append((free, count, pattern))

    closed = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not room or -room[0][0] < length:
                fit = size // length
                whole, rest = divmod(left, fit)
                # new packs hold one piece each; only when no longer ones can join are they filled at once
                if length == min(histogram):
                    if whole:
                        put(size - fit * length, whole, [(length, fit)])
                    if rest:
                        put(size - rest * length, 1, [(length, rest)])
                else:
                    put(size - length, left, [(length, 1)])
                left = 0
                continue
            _, at = heapq.heappop(room)
            free, count, pattern = packs[at]
            packs[at] = None
            other = -room[0][0] if room else 0
            copies = min(free // length, max(1, (free - other) // length + 1))
            if left < count * copies:
                copies = max(1, left // count)
            taken = min(count, left // copies)
            if taken < count:
                put(free, count - taken, pattern)
            free -= copies * length
            grown = pattern + [(length, copies)]
            if free:
                put(free, taken, grown)
            else:
                closed.append((taken, grown))
            left -= taken * copies
    return closed + [(count, pattern) for pack in packs if pack for _, count, pattern in [pack]]


def intervals(patterns) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank_from, rank_to, copies, first_sequence, first_offset) of every slot of every pattern."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            start = ranks.get(length, 0)
            ranks[length] = start + count * copies
            rows.append((length, start, ranks[length], copies, sequence, offset))
            offset += length * copies
        sequence += count
    return rows


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int")
    rows = cut(pieces(docs, path, size, end_id).withColumn("salt", salt))
    by_salt = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        intervals(shortest_pack_first(histogram, size)),
        "slot_length long, rank_from long, rank_to long, copies long, first_sequence long, first_offset long",
    )
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.withColumn("place", F.row_number().over(within) - 1).join(F.broadcast(bases), ["length", "salt"])
    rank = F.col("place") + F.col("base")
    at = rank - F.col("rank_from")
    return ranked.join(
        F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (rank >= F.col("rank_from")) & (rank < F.col("rank_to"))
    ).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (at % F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )
