"""Document fingerprints by MinHash, and near-duplicate pairs from their bands.

A text's shingles are its distinct sequences of five words. ``PERMS`` hash
permutations of the form ``(a * x + b) >> 32`` over 64-bit numbers, vectorised in
numpy, give the smallest value of each; the low 16 bits of the minima, as hexadecimal
text, are the fingerprint. The likeness of two fingerprints is the share of equal
places, corrected for places that agree by chance.

``near_duplicates`` joins the signature bands in Spark; each link is verified by the
Jaccard similarity of the real shingle sets. Equal sets are one class first. In
``ROUNDS`` rounds the documents of a band bucket meet one leader of it, first the
smallest, then others, and those connected to a leader leave the next rounds, so large
groups of copies settle without meeting each other. Then all pairs of a bucket that are
not yet connected meet, dealt into pairs of blocks. Only pairs whose set sizes rule the
similarity out, and pairs already connected by links, are left unverified: the links
connect whatever any bucket's verified pairs would connect.

``with_next`` puts documents beside the next one by doc_id without a global window:
doc_ids are dealt into ranges, each range is read in order as a stream, and a copy of
the first document of the next range closes it.

Defined results: a null text is empty; a text without words has a fingerprint of its
own kind, equal to other such and unlike all others (likeness 1 and 0); fewer words
than a shingle give one shingle; rows with equal doc_ids are ordered by text; rows
with a null doc_id come first; the only document is its own next one; an empty table
gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import cut
from wayfarer.llm.components import connected

WORDS = 5
PERMS = 128
BANDS = 32
THRESHOLD = 0.8
SEED = 11
#: Rounds in which a bucket's documents meet one leader before the rest meet each other.
ROUNDS = 3
#: Documents of a bucket's block; two blocks meet in one group.
BLOCK = 256

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the word sequences of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    n = max(1, len(h) - width + 1)
    s = np.full(n, min(width, len(h)), np.uint64)
    for j in range(min(width, len(h))):
        s = s * _STEP + h[j : j + n]
    s ^= s >> np.uint64(29)
    return np.unique(s * _MIX)


@functools.lru_cache
def permutations(perms: int = PERMS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the universal hash family."""
    r = np.random.default_rng(seed)
    return r.integers(0, 2**63, perms, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, perms, np.uint64)


def signature(sets: np.ndarray, perms: int = PERMS) -> np.ndarray | None:
    """The least value under each permutation; None for a set without members."""
    if not len(sets):
        return None
    a, b = permutations(perms)
    x = (sets >> np.uint64(32)) ^ (sets & np.uint64(0xFFFFFFFF))
    out = np.full(perms, np.iinfo(np.uint64).max, np.uint64)
    held = np.empty((perms, min(512, len(x))), np.uint64)
    for at in range(0, len(x), 512):  # a block fits the processor's cache
        part = x[None, at : at + 512]
        values = held[:, : part.shape[1]]
        np.multiply(part, a[:, None], out=values)
        np.add(values, b[:, None], out=values)
        np.minimum(out, values.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)  # the least value has the least upper half


def as_text(sign: np.ndarray | None, perms: int = PERMS) -> str:
    return "" if sign is None else (sign & np.uint32(0xFFFF)).astype("<u2").tobytes().hex()


def likeness(x: np.ndarray | None, y: np.ndarray | None) -> float:
    """Estimated similarity, 0 to 1, of the texts behind two fingerprints."""
    if x is None or y is None:
        return float(x is None and y is None)
    equal = float(np.mean((x & np.uint32(0xFFFF)) == (y & np.uint32(0xFFFF))))
    chance = 1 / 65536
    return min(1.0, max(0.0, (equal - chance) / (1 - chance)))


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _next_batches(batches, perms, width):
    """Rows in order of (range, guard, doc_id): each with the next; guards only close their range."""
    held = None
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        out = []
        for doc, guard, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "guard", "text"))):
            text = text or ""
            sign = signature(shingles(text, width), perms)
            if held is not None:
                d, t, s = held
                e = edited(t, text)
                es = signature(shingles(e, width), perms)
                digest = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((d, len(t), digest, as_text(s), as_text(es), likeness(s, es), likeness(s, sign)))
            held = None if guard else (doc, text, sign)
        columns = list(zip(*out)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def fingerprints_with_next(docs: DataFrame, perms: int = PERMS, width: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per document."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_id = F.coalesce("doc_id", F.lit(-(2**63)))
    steps = [i / ranges for i in range(1, ranges)]
    bounds = sorted({int(x) for x in texts.select(order_id.alias("o")).approxQuantile("o", steps, 0.1 / ranges)}) if steps else []
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= order_id)) if bounds else F.lit(0)
    # quantiles are doubles and only cut; the document that opens a range is looked up, one row per range
    opening = texts.groupBy(part.alias("part")).agg(F.min(order_id).alias("low")).sort("part").collect()
    before = [F.lit(x.part) for x in opening[-1:] + opening[:-1]]
    closes = F.element_at(F.map_from_arrays(F.array(*[F.lit(x.low) for x in opening]), F.array(*before)), order_id) if opening else F.lit(0)
    rows = texts.select(part.alias("part"), F.lit(False).alias("guard"), "doc_id", "text")
    # one document per range opens it and closes the range before; the first of all closes the last
    opens = texts.filter(order_id.isin([x.low for x in opening])) if opening else texts.limit(0)
    guards = opens.groupBy("doc_id").agg(F.min("text").alias("text")).select(
        closes.cast("int").alias("part"), F.lit(True).alias("guard"), "doc_id", "text"
    )
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return (
        rows.unionByName(guards)
        .repartitionById(ranges, "part")
        .sortWithinPartitions("part", "guard", F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(lambda b: _next_batches(b, perms, width), schema)
    )


def signatures(docs: DataFrame, perms: int = PERMS, width: int = WORDS) -> DataFrame:
    """doc_id, set_digest, n_shingles, minima (array of long, null without words)."""

    def of(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = shingles(text, width)
                sign = signature(found, perms)
                rows.append((doc, xxhash.xxh128_digest(found.tobytes()), len(found), None if sign is None else sign.tolist()))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "set_digest", "n_shingles", "minima"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(of, "doc_id long, set_digest binary, n_shingles long, minima array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, threshold: float, width: int) -> DataFrame:
    """doc_id, near_id, jaccard of those pairs (doc_id, near_id) that are alike."""

    @F.pandas_udf("double")
    def jaccard(x, y):
        import pandas as pd

        out, last, t = [], None, None
        for a, b in zip(x, y):
            if last is None or b != last:  # rows come in order of near_id
                last, t = b, shingles(b, width)
            s = shingles(a, width)
            whole = np.concatenate((s, t))
            whole.sort(kind="stable")  # merges the two sorted sets
            both = int(np.count_nonzero(whole[1:] == whole[:-1]))
            out.append(both / max(1, len(s) + len(t) - both))
        return pd.Series(out)

    return (
        pairs.join(docs.select("doc_id", F.col("text").alias("x")), "doc_id")
        .join(docs.select(F.col("doc_id").alias("near_id"), F.col("text").alias("y")), "near_id")
        .select("doc_id", "near_id", jaccard("x", "y").alias("jaccard"))
        .filter(F.col("jaccard") >= threshold)
    )


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with label, the component of doc_id under the links."""
    found = connected(links.select(F.col("doc_id").alias("a"), F.col("near_id").alias("b")))
    found = found.select(F.col("node").alias("doc_id"), "component")
    return rows.drop("label").join(found, "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")


def _across(rows: DataFrame) -> DataFrame:
    """Pairs of each bucket's rows with different labels, by pairs of blocks; columns of the second are called o_*."""
    mixed = (
        rows.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low < high")
        .select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    )
    dealt = (
        rows.join(mixed, "bucket")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .drop("blocks", "other")
    )
    keys = ["bucket", "i", "j"]
    second = dealt.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("doc_id", "n_shingles", "label", "block")])
    # two rows of one block meet where i = j
    return dealt.join(second, keys).filter("doc_id > o_doc_id and label <> o_label and (i = j or block <> o_block)")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, perms: int = PERMS, bands: int = BANDS, width: int = WORDS
) -> DataFrame:
    """(doc_id, near_id, jaccard): verified links that connect all alike documents of a band bucket, and of an equal set."""
    found = cut(signatures(docs.filter("doc_id is not null"), perms, width).filter("minima is not null"))
    classes = found.groupBy("set_digest").agg(F.min("doc_id").alias("near_id"))
    copies = found.join(classes, "set_digest").filter("doc_id > near_id").select("doc_id", "near_id", F.lit(1.0).alias("jaccard"))
    rows_per_band = perms // bands
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda i: F.xxhash64(i, F.slice("minima", i * rows_per_band + 1, rows_per_band)),
    )
    leaders = found.join(classes.select(F.col("near_id").alias("doc_id")), "doc_id", "left_semi")
    buckets = leaders.select("doc_id", "n_shingles", F.explode(keys).alias("bucket"), F.col("doc_id").alias("label"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    rows = cut(buckets.join(shared, "bucket"))

    fits = F.least("n_shingles", "o_n_shingles") >= threshold * F.greatest("n_shingles", "o_n_shingles") - 1e-9
    both = (F.greatest("doc_id", "o_doc_id").alias("doc_id"), F.least("doc_id", "o_doc_id").alias("near_id"))
    # only these texts meet, dealt and sorted once for all rounds
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = cut(texts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id"))
    tested = links = None
    unsettled = rows
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            order = F.struct(F.lit(0).cast("long") if turn == 0 else F.xxhash64(F.lit(turn), "doc_id"), "doc_id")
            head = unsettled.groupBy("bucket").agg(
                *[F.min_by(c, order).alias(f"o_{c}") for c in ("doc_id", "n_shingles", "label")]
            )
            met = unsettled.join(head, "bucket").filter("doc_id <> o_doc_id")
            pairs = met.filter(F.col("label") != F.col("o_label"))
        else:
            pairs = _across(rows)
        pairs = pairs.filter(fits).select(*both).distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["doc_id", "near_id"], "left_anti"))
        alike = cut(_verified(pairs, texts, threshold, width))
        links = alike if links is None else links.unionByName(alike)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if turn < ROUNDS:
            rows = cut(_labelled(rows, links))
            now = rows.select("bucket", "doc_id", "label")
            heads = head.select("bucket", "o_doc_id").join(
                now.select("bucket", F.col("doc_id").alias("o_doc_id"), F.col("label").alias("o_label")), ["bucket", "o_doc_id"]
            )
            left = unsettled.drop("label").join(now, ["bucket", "doc_id"]).join(heads, "bucket")
            unsettled = cut(left.filter("label <> o_label").select(*rows.columns))
    return links.unionByName(copies)
