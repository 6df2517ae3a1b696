"""Line dedup with content-defined chunks.

A text is split at line feeds. A hash rolls over the hashes of ``WINDOW`` consecutive
lines; a line ends a chunk where the rolled hash is divisible by ``DIVISOR`` and the
chunk has ``LEAST`` lines. Fewer lines than ``LEAST`` at the end of a text join the chunk
before. No chunk is cut by its length, so boundaries depend on nearby lines alone and
return to the same places soon after lines were inserted or removed above.

Every line of a text of at least ``LEAST`` lines is in a chunk, so a full copy loses all
its lines. Repeated passages are not extended beyond their chunks: where a passage's first
or last chunk mixes with other lines, those lines stay.

Chunks that occur more than once in the corpus are kept at
their first place (smallest doc_id, then position) and removed elsewhere. Digests name
the chunks; the bytes of all chunks under a digest are compared by their smallest and
largest text, in an aggregation that combines before the shuffle, and a digest whose
texts differ removes nothing. Joining decisions back moves digests and places only.

Defined results: a null text is one empty line; a text of fewer than ``LEAST`` lines
loses nothing; rows with a null doc_id lose nothing and are no first place; rows that
repeat a doc_id are ordered by position only, so of equal chunks at equal places all
stay; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, DIVISOR, LEAST = 2, 4, 2

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def chunk_bounds(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, one past the last line) of each chunk."""
    h = np.array([xxhash.xxh64_intdigest(line) for line in lines], np.uint64)
    rolled = h.copy()
    for back in range(1, WINDOW):
        rolled[back:] = rolled[back:] + h[:-back] * np.uint64(pow(int(_STEP), back, 2**64))
    rolled = (rolled ^ (rolled >> np.uint64(31))) * _MIX
    ends, start = [], 0
    for end in [*(np.flatnonzero((rolled >> np.uint64(16)) % np.uint64(DIVISOR) == 0) + 1).tolist(), len(lines)]:
        if end - start >= LEAST:
            ends.append((start, end))
            start = end
    if start < len(lines):  # too few lines are left for a chunk of their own
        ends[-1:] = [(ends[-1][0] if ends else start, len(lines))]
    return ends


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, first_line, n_lines, digest, chunk: every chunk of the texts of at least LEAST lines."""
    names = ["doc_id", "first_line", "n_lines", "digest", "chunk"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def of(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                if len(lines) < LEAST:
                    continue
                for a, b in chunk_bounds(lines):
                    if b - a >= LEAST:
                        body = b"\n".join(lines[a:b])
                        rows.append((doc, a, b - a, xxhash.xxh128_digest(body), body))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(of, "doc_id long, first_line int, n_lines int, digest binary, chunk binary")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, first_line, n_lines of the chunks to remove."""
    found = chunks(docs.filter("doc_id is not null"))
    first = (
        found.groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("doc_id", "first_line")).alias("first"),
            F.min("chunk").alias("low"),
            F.max("chunk").alias("high"),
        )
        .filter("n > 1 and low = high")
        .select("digest", "first")
    )
    places = found.select("doc_id", "first_line", "n_lines", "digest")
    return places.join(first, "digest").filter(F.struct("doc_id", "first_line") > F.col("first")).select(
        "doc_id", "first_line", "n_lines"
    )


def drop_repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chunks (removed), kept: the remaining lines joined by line feeds."""
    gone = repeated_chunks(docs).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("first_line", "n_lines")).alias("gone"))

    def of(batches):
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "gone"))
            for doc, text, removed in zip(*columns):
                lines = (text or "").split("\n")
                keep = np.ones(len(lines), bool)
                for chunk in removed or ():
                    keep[chunk["first_line"] : chunk["first_line"] + chunk["n_lines"]] = False
                kept = "\n".join(x for x, k in zip(lines, keep.tolist()) if k) if removed else text or ""
                rows.append((doc, len(lines), int((~keep).sum()), len(removed or ()), kept))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(),) * 4 + (pa.string(),)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_lines", "n_removed", "n_chunks", "kept"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(gone, "doc_id", "left").mapInArrow(
        of, "doc_id long, n_lines long, n_removed long, n_chunks long, kept string"
    )
