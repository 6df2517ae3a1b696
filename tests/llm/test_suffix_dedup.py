import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfarer.llm import suffix_dedup


def brute(rows, width=200):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + width] for _, b in data for i in range(len(b) - width + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = sum(bool(gone[i]) and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(found):
    return sorted(map(tuple, found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()))


def corpus(seed):
    r = random.Random(seed)
    letters = lambda n, of="abcdeé ": "".join(r.choice(of) for _ in range(n))
    passages = [letters(r.randint(190, 700)) for _ in range(4)] + ["ab" * 300, "z" * 500, letters(450, "ab")]
    rows = []
    for i in range(120):
        t = letters(r.randint(0, 400))
        for _ in range(r.randint(0, 2)):
            p = r.choice(passages)
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            k = r.randint(0, len(t))
            t = t[:k] + (p[a:b] if r.random() < 0.6 else p) + t[k:]
        rows.append((i, t))
    return rows + [(500 + i, rows[3][1]) for i in range(30)] + [(900, None), (901, ""), (902, "z" * 1000)]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"shard": 3000}), (3, {"crowd": 3})])
def test_matches_brute_force(documents_of, seed, options):
    rows = corpus(seed)
    assert result(suffix_dedup.drop_repeated_bytes(documents_of(rows).withColumnRenamed("lang", "n"), **options)) == brute(rows)


@pytest.mark.parametrize("batch", [3, 40])
def test_a_crowded_anchor_is_decided_by_arrays_too(spark, documents_of, batch):
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh ") for _ in range(260))
    edge = lambda: "".join(r.choice("xyzé") for _ in range(r.choice([0, 1, 2, 90])))
    rows = [(i, edge() + passage[r.randint(0, 40) : 260 - r.randint(0, 40)] + edge()) for i in range(150)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = [result(suffix_dedup.drop_repeated_bytes(documents_of(rows), crowd=c)) for c in (0, 5, 10**9)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [brute(rows)] * 3


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=120))
def test_suffix_array_is_sorted(values):
    s = np.array(values + [0], np.int32)
    want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert suffix_dedup.suffix_array(s, 1000).tolist() == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=40).map(str.encode), min_size=1, max_size=6), st.integers(9, 14))
def test_repeated_windows(texts, width):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    want = [[i for i in range(len(t) - width + 1) if seen[t[i : i + width]] > 1] for t in texts]
    assert [x.tolist() for x in suffix_dedup.repeated_windows(texts, width)] == want


def test_repeated_rows_and_empty(documents_of):
    text = "".join(map(str, range(120)))
    rows = [(4, text), (4, text), (None, text), (9, "x")]
    got = suffix_dedup.drop_repeated_bytes(documents_of(rows)).collect()
    assert sorted((x.doc_id or 0, x.n_removed) for x in got) == [(0, 0), (4, 250), (4, 250), (9, 0)]
    assert suffix_dedup.drop_repeated_bytes(documents_of(rows).limit(0)).count() == 0


def test_query_on_the_given_table(spark):
    from wayfarer.llm.queries import op1_suffix_dedup

    sf = "/root/testdata/sf0.001"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op1_suffix_dedup(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == brute(rows)
