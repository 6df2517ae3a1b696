import hashlib
import random

import xxhash

import numpy as np
import pytest

from wayfarer.llm import fingerprints, line_dedup


def words(r, n):
    return " ".join(r.choice("abcdefghijklmnop") + r.choice("qrstuvwxyz") for _ in range(n))


def check_next(rows, got):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = {x.doc_id: x for x in got}
    assert len(got) == len(rows)
    sign = lambda t: fingerprints.signature(fingerprints.shingles(t))
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        e = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        x = got[d]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (fingerprints.as_text(sign(t)), fingerprints.as_text(sign(e)))
        assert x.near_edited == pytest.approx(fingerprints.likeness(sign(t), sign(e)))
        assert x.near_next == pytest.approx(fingerprints.likeness(sign(t), sign(following)))


def test_next_documents(documents_of):
    r = random.Random(5)
    rows = [(i * i, words(r, r.choice([0, 1, 3, 30, 200]))) for i in range(1, 90)] + [(-7, None), (None, "é x")]
    check_next(rows, fingerprints.fingerprints_with_next(documents_of(rows)).collect())
    check_next(rows[:1], fingerprints.fingerprints_with_next(documents_of(rows[:1])).collect())
    check_next(rows[:2], fingerprints.fingerprints_with_next(documents_of(rows[:2])).collect())
    assert fingerprints.fingerprints_with_next(documents_of(rows).limit(0)).count() == 0
    again = fingerprints.fingerprints_with_next(documents_of(rows[:4] + rows[:4])).collect()
    assert sorted(x.doc_id for x in again) == sorted([d for d, _ in rows[:4]] * 2)


def test_next_documents_of_large_ids(documents_of):
    r = random.Random(6)
    rows = [(2**62 + i + 3 * r.randint(0, 2) * 10**15, words(r, 12)) for i in range(1, 120)] + [(-(2**62) - 1, words(r, 9))]
    check_next(rows, fingerprints.fingerprints_with_next(documents_of(rows)).collect())


def test_query_on_the_given_table(spark):
    from wayfarer.llm.queries import op7_fingerprints

    sf = "/root/testdata/sf0.001"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_next(rows, op7_fingerprints(spark, sf).collect())


def test_likeness_estimates_jaccard():
    r = np.random.default_rng(2)
    for share in (0.0, 0.3, 0.7, 0.95):
        x = r.integers(0, 2**63, 4000, np.uint64)
        y = np.where(r.random(4000) < share, x, r.integers(0, 2**63, 4000, np.uint64))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs(fingerprints.likeness(fingerprints.signature(x), fingerprints.signature(y)) - true) < 0.14


def test_near_duplicates(documents_of):
    r = random.Random(9)
    base = words(r, 400).split()
    near = base[:]
    near[10] = near[200] = "zz"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, words(r, 400)), (4, " ".join(base)), (5, None), (6, "")]
    got = sorted((x.doc_id, x.near_id) for x in fingerprints.near_duplicates(documents_of(rows)).collect())
    assert got == [(2, 1), (4, 1)]


def components_of(pairs):
    """The smallest member of each linked document's component."""
    at = {}
    root = lambda x: x if at.setdefault(x, x) == x else root(at[x])
    for a, b in pairs:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {x: root(x) for x in at}


def brute_near(rows):
    """All pairs (larger, smaller doc_id) of texts with words that are 0.8 alike."""
    sets = [(d, set(fingerprints.shingles(t).tolist())) for d, t in rows if d is not None and (t or "").split()]
    holders = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    out = []
    for k, (d, s) in enumerate(sets):
        shared = {}
        for x in s:
            for o in holders[x]:
                if o < k:
                    shared[o] = shared.get(o, 0) + 1
        out += [
            (max(d, sets[o][0]), min(d, sets[o][0]))
            for o, n in shared.items()
            if n / (len(s) + len(sets[o][1]) - n) >= fingerprints.THRESHOLD
        ]
    return out


def test_no_link_is_lost_behind_a_less_alike_leader(documents_of):
    r = random.Random(21)
    rows = []
    for group in range(3):
        base = words(r, 240).split()
        # each lacks another stretch, so that one of them leads every bucket of the last two
        rows += [(group * 300 + i, " ".join(base[:i] + words(r, 42).split() + base[i + 42 :])) for i in range(0, 199, 2)]
        near = base[:]
        for i in (205, 213, 221, 229):
            near[i] = "zz"
        rows += [(1000 + group, " ".join(base)), (2000 + group, " ".join(near))]
    want = brute_near(rows)
    assert want == [(2000 + group, 1000 + group) for group in range(3)]
    assert sorted((x.doc_id, x.near_id) for x in fingerprints.near_duplicates(documents_of(rows)).collect()) == want


def test_pairs_of_a_bucket_meet_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", 3)
    table = [(d, 1, b, d if d % 4 else 0) for b in (1, 2) for d in range(b, 20)] + [(50, 1, 3, 50), (51, 1, 3, 50)]
    rows = spark.createDataFrame(table, "doc_id long, n_shingles long, bucket long, label long")
    got = sorted((x.bucket, x.doc_id, x.o_doc_id) for x in fingerprints._across(rows).collect())
    want = [(b, d, e) for d, _, b, l in table for e, _, c, m in table if b == c and d > e and l != m]
    assert got == sorted(want)


def test_near_duplicates_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_near([(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()])
    got = [(x.doc_id, x.near_id) for x in fingerprints.near_duplicates(docs).collect()]
    assert set(got) <= set(want)
    assert components_of(got) == components_of(want)


def plain_bounds(lines, window=2, divisor=4, least=2):
    """The chunk rule in whole numbers, line by line; nothing of the operator is called."""
    m = 2**64
    out, start = [], 0
    for i in range(len(lines)):
        rolled = sum(xxhash.xxh64_intdigest(lines[i - k]) * pow(0x9E3779B97F4A7C15, k, m) for k in range(window) if i >= k) % m
        rolled = (rolled ^ (rolled >> 31)) * 0xBF58476D1CE4E5B9 % m
        if (rolled >> 16) % divisor == 0 and i + 1 - start >= least:
            out.append((start, i + 1))
            start = i + 1
    if len(lines) - start >= least:
        out.append((start, len(lines)))
    elif start < len(lines):
        out = [*out[:-1], (out[-1][0] if out else start, len(lines))]
    return out


def brute_lines(rows):
    found = []
    for d, t in rows:
        lines = (t or "").encode().split(b"\n")
        for a, b in plain_bounds(lines):
            if d is not None and b - a >= 2:
                found.append((b"\n".join(lines[a:b]), d, a, b))
    first = {}
    for body, d, a, _ in found:
        first[body] = min(first.get(body, (d, a)), (d, a))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = {i for body, e, a, b in found if e == d and first[body] < (d, a) for i in range(a, b)}
        out.append((d, len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=str)


def test_line_chunks(documents_of):
    r = random.Random(6)
    shared = [[words(r, 4) for _ in range(r.randint(3, 60))] for _ in range(5)]
    rows = []
    for i in range(120):
        lines = [words(r, 3) for _ in range(r.randint(0, 12))]
        for _ in range(r.randint(0, 2)):
            lines[(k := r.randint(0, len(lines))) : k] = r.choice(shared)
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, rows[5][1]) for i in range(20)] + [(900, None), (901, ""), (None, rows[5][1]), (902, "\n" * 50)]
    got = line_dedup.drop_repeated_chunks(documents_of(rows).withColumnRenamed("lang", "digest")).collect()
    assert sorted(((x.doc_id, x.n_lines, x.n_removed, x.kept) for x in got), key=str) == brute_lines(rows)
    assert line_dedup.drop_repeated_chunks(documents_of(rows).limit(0)).count() == 0


def test_boundaries_resist_shifts():
    r = random.Random(8)
    lines = [words(r, 5).encode() for _ in range(300)]
    one = {tuple(lines[a:b]) for a, b in line_dedup.chunk_bounds(lines)}
    moved = [b"new"] + lines
    two = {tuple(moved[a:b]) for a, b in line_dedup.chunk_bounds(moved)}
    assert len(one & two) >= len(one) - 3


def repeated_blocks(rows):
    """Per (doc_id, lines) in order: the numbers of lines in a block of two lines that stands anywhere before."""
    seen, out = set(), []
    for _, lines in rows:
        pairs = list(zip(lines, lines[1:]))
        again = set()
        for i, pair in enumerate(pairs):
            if pair in seen:
                again |= {i, i + 1}
            seen.add(pair)
        out.append(again)
    return out


def test_every_line_is_in_a_chunk_and_full_copies_lose_all(documents_of):
    r = random.Random(12)
    for n in (*range(2, 40), 200):
        lines = [words(r, 3).encode() for _ in range(n)]
        bounds = line_dedup.chunk_bounds(lines)
        assert [i for a, b in bounds for i in range(a, b)] == list(range(n))
        assert min(b - a for a, b in bounds) >= line_dedup.LEAST
    rows = [(i, "\n".join(words(r, 3) for _ in range(r.randint(2, 30)))) for i in range(30)]
    copies = [(100 + i, t) for i, t in rows]
    got = {x.doc_id: x for x in line_dedup.drop_repeated_chunks(documents_of(rows + copies)).collect()}
    for i, _ in rows:
        assert got[i].n_removed == 0
        assert (got[100 + i].n_removed, got[100 + i].kept) == (got[i].n_lines, "")


def test_repeated_blocks_found_by_brute_force_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id is not null")
    rows = sorted((x.doc_id, (x.text or "").split("\n")) for x in docs.select("doc_id", "text").collect())
    gone = {}
    for x in line_dedup.repeated_chunks(docs).collect():
        gone.setdefault(x.doc_id, set()).update(range(x.first_line, x.first_line + x.n_lines))
    want = repeated_blocks(rows)
    hit = sum(len(again & gone.get(d, set())) for (d, _), again in zip(rows, want))
    assert hit / sum(map(len, want)) > 0.7  # 0.62 when single lines made chunks that were thrown away


def test_line_query_on_the_given_table(spark):
    from wayfarer.llm.queries import op5_line_dedup

    sf = "/root/testdata/sf0.001"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_lines(rows)]
    got = sorted(((x.doc_id, x.n_lines, x.n_removed, x.kept_sha256) for x in op5_line_dedup(spark, sf).collect()), key=str)
    assert got == want


def test_only_texts_that_share_a_bucket_are_dealt_and_once(documents_of, monkeypatch):
    r = random.Random(12)
    base = words(r, 300)
    rows = [(i, words(r, 300)) for i in range(40)] + [(100 + i, f"{base} end{i}") for i in range(4)]
    seen, verified = [], fingerprints._verified
    monkeypatch.setattr(fingerprints, "_verified", lambda pairs, docs, *a: seen.append((docs, verified(pairs, docs, *a))) or seen[-1][1])
    got = {(x.doc_id, x.near_id) for x in fingerprints.near_duplicates(documents_of(rows)).collect()}
    assert {d for p in got for d in p} == {100, 101, 102, 103}
    for docs, found in seen:
        assert {x.doc_id for x in docs.collect()} == {100, 101, 102, 103}
        exchanged = [n for n in found._jdf.queryExecution().sparkPlan().toString().split("\n") if "text" in n and "Scan parquet" in n]
        assert not exchanged  # the given table is not read again
