"""Periodic runs against brute force: every period and every maximal stretch of each document."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfarer.llm import periodic
from wayfarer.llm.queries import op12_periodic_runs

SF = "/root/testdata/sf0.001"


def brute_runs(words):
    """Maximal stretches by comparing all places q apart; a stretch with a smaller period is left out."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= max(6, 4 * q) and (start, end) not in found:
                found[start, end] = q  # the smallest period of these words comes first
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in sorted(runs, key=lambda r: (r[0], r[2])))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


words_of = st.lists(st.sampled_from("abc"), max_size=8).flatmap(
    lambda u: st.tuples(st.just(u), st.integers(0, 9), st.lists(st.sampled_from("abc"), max_size=5))
)


@settings(max_examples=400, deadline=None)
@given(st.lists(words_of, max_size=6))
def test_runs_of_one_document(parts):
    words = [w for u, k, v in parts for w in u * k + v]
    assert periodic.exact_runs([w.encode() for w in words]) == brute_runs(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(words_of, min_size=2, max_size=8), st.integers(0, 1))
def test_small_tiles_are_stitched_to_the_same_runs(parts, small):
    words = [w for u, k, v in parts for w in u * k + v]
    ids = np.array([ord(w) for w in words], np.uint64)
    tiles = [("", at, f, t, ids[at:end]) for at, end, f, t in periodic.tile_places(len(ids), 5, small)]
    assert periodic.stitched([f[1:] for f in periodic.solved(tiles)]) == brute_runs(words)


def test_tiles_of_many_documents_do_not_mix():
    r = random.Random(2)
    docs = [[r.choice("ab") for _ in range(r.randrange(40))] for _ in range(300)] + [["a"] * k for k in range(30)]
    tiles = [(i, at, f, t, np.array([ord(w) for w in d], np.uint64)[at:end]) for i, d in enumerate(docs) for at, end, f, t in periodic.tile_places(len(d))]
    found = {i: [] for i in range(len(docs))}
    for i, *f in periodic.solved(tiles):
        found[i].append(tuple(f))
    assert {i: periodic.stitched(f) for i, f in found.items()} == {i: brute_runs(d) for i, d in enumerate(docs)}


def rows_of(got):
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("long_bytes", [1 << 20, 50])
def test_query_rows_equal_brute_force(spark, documents_of, long_bytes):
    r = random.Random(7)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b a b a b a b x", "lo " * 500, "x" * 3000, "a\x0bb\x0ca\x1cb " * 9]
    texts += [" ".join(r.choice(["x", "y", "zz"]) for _ in range(r.randrange(120))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "q q q q q q q"), (None, None), (7, "lo " * 500), (7, "another text")]
    got = periodic.periodic_runs(documents_of(rows), periodic.planted_period, tile=16, long_bytes=long_bytes)
    assert rows_of(got.collect()) == rows_of(brute_row(*x) for x in rows)


def test_a_very_long_text(spark, documents_of):
    r = random.Random(3)
    body = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    words = body[:20_000] + body[:4_000] * 5 + body[20_000:] + ["tail"] * 40_000 + body[:7] * 3_000
    (got,) = periodic.periodic_runs(documents_of([(1, " ".join(words))]), long_bytes=1000).collect()
    runs = [(20_000, 20_000, 4_000), (80_000, 40_000, 1), (120_000, 21_000, 7)]
    if words[19_999] == body[3_999]:
        pytest.skip("the drawn words extend the run")
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    assert (got.n_runs, got.start, got.length, got.period) == (3, 80_000, 40_000, 1)
    assert got.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()


def test_colliding_word_hashes_are_found_and_solved_anew(spark, documents_of, monkeypatch):
    words = [b"a", b"b"] * 6
    assert periodic.described(words, [(0, 12, 1)])[:4] == (1, 0, 12, 2)


def test_given_table_empty_table_and_clashing_columns(spark, documents_of):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert rows_of(op12_periodic_runs(spark, SF).collect()) == rows_of(brute_row(d.doc_id, d.text) for d in docs)
    assert periodic.periodic_runs(documents_of([])).collect() == []
    clash = documents_of([(1, "a a a a a a")]).selectExpr("*", "1 AS key", "2 AS start", "3 AS runs", "4 AS period")
    assert [(r.doc_id, r.n_runs, r.length) for r in periodic.periodic_runs(clash).collect()] == [(1, 1, 6)]
