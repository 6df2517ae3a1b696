"""The fingerprint query against a twin in plain integers that shares none of the operator's functions."""

import hashlib
import re
import struct

import numpy as np
import pytest
import xxhash

from wayfarer.llm.queries import op7_fingerprints

SF = "/root/testdata/sf0.001"
#: The family's size and seed, the shingles' width and mixing factors, the bits of a word.
PERMS, SEED, WIDTH, STEP, MIX, ALL = 128, 11, 5, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 2**64 - 1
DRAWN = np.random.default_rng(SEED)
FACTORS = [(2 * int(v) + 1) & ALL for v in DRAWN.integers(0, 2**63, PERMS, np.uint64)]
OFFSETS = [int(v) for v in DRAWN.integers(0, 2**63, PERMS, np.uint64)]


def plain_set(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", text.encode()) if w]
    width = min(WIDTH, len(words))
    found = set()
    for at in range(len(words) - width + 1 if words else 0):
        h = width
        for w in words[at : at + width]:
            h = (h * STEP + xxhash.xxh64_intdigest(w)) & ALL
        found.add(((h ^ (h >> 29)) * MIX) & ALL)
    return found


def plain_minima(text):
    folded = [(x >> 32) ^ (x & 0xFFFFFFFF) for x in plain_set(text)]
    return [min(((a * x + b) & ALL) >> 32 for x in folded) & 0xFFFF for a, b in zip(FACTORS, OFFSETS)] if folded else None


def plain_text(minima):
    return "" if minima is None else struct.pack(f"<{PERMS}H", *minima).hex()


def plain_likeness(x, y):
    if x is None or y is None:
        return 1.0 if x is None and y is None else 0.0
    equal = sum(a == b for a, b in zip(x, y)) / PERMS
    return min(1.0, max(0.0, (equal - 1 / 65536) / (1 - 1 / 65536)))


def rows_of(table):
    rows = sorted((x.doc_id, x.text or "") for x in table)
    minima = [plain_minima(t) for _, t in rows]
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        k = (i + 1) % len(rows)
        half = len(text) // 2
        other = text[: len(text) - half] + rows[k][1][:half]
        edited = plain_minima(other)
        out[doc_id] = (
            len(text), hashlib.sha256(other.encode()).hexdigest(), plain_text(minima[i]), plain_text(edited),
            pytest.approx(plain_likeness(minima[i], edited)), pytest.approx(plain_likeness(minima[i], minima[k])),
        )
    return out


def test_query_equals_plain_integers_on_short_documents_of_the_given_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = docs.filter("coalesce(n_chars, 0) <= 3000")  # plain Python minima of the longest texts would take minutes
    short.write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: tuple(x)[1:] for x in op7_fingerprints(spark, str(tmp_path)).collect()}
    want = rows_of(short.collect())
    assert len(want) > 50 and got == want


def test_a_very_long_text_equals_plain_integers(spark, documents_of, tmp_path):
    long_text = " ".join(f"w{i % 2003}" for i in range(40_000))
    documents_of([(1, long_text), (2, "short one"), (3, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: tuple(x)[1:] for x in op7_fingerprints(spark, str(tmp_path)).collect()}
    assert got == rows_of(spark.read.parquet(f"{tmp_path}/documents.parquet").collect())
