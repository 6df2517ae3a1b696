import random
import re

import numpy as np
import pytest

from wayfarer.llm import ngram_join
from wayfarer.llm.components import connected


def brute(rows, percent=85, width=4):
    def words(t):
        return (t or "").encode().lower().split()

    sets = {}
    for d, t in rows:
        w = words(t)
        s = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
        sets.setdefault(d, []).append(s)
    ids = sorted(sets)
    label = {d: d for d in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    flat = [(d, s) for d in ids for s in sets[d] if s]
    for i, (a, x) in enumerate(flat):
        for b, y in flat[:i]:
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {d: root(d) for d in ids}


def family(r, base, n, start, edits):
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(*edits)):
            w[r.randrange(len(w))] = f"x{r.random()}"
        out.append((start + i, " ".join(w)))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + r.choice("qrst")
    rows, passage = [], [word() for _ in range(40)]
    for k in range(6):
        base = [word() for _ in range(r.randint(30, 120))]
        if k % 2:
            base[5:5] = passage
        rows += family(r, base, r.randint(2, 25), len(rows) * 3 + k * 1000, (0, 4))
    rows += [(9000 + i, " ".join(passage + [word() for _ in range(r.randint(0, 12))])) for i in range(30)]
    rows += [(1, None), (2, ""), (3, "one two"), (4, "One  two"), (5, "one"), (6, "one two three four"), (7, "  \n")]
    return rows


@pytest.mark.parametrize("seed,crowd,weight", [(1, 64, 300_000), (2, 3, 600), (3, 1, 400), (4, 1000, 500)])
def test_components_match_brute_force(spark, documents_of, seed, crowd, weight):
    rows = corpus(seed)
    docs = documents_of(rows).withColumnRenamed("lang", "h")
    got = {x.doc_id: x.component_id for x in ngram_join.components(docs, crowd=crowd, weight=weight).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("crowd,edits", [(10, (0, 3)), (10_000, (1, 4)), (10, (2, 5))])
def test_group_of_many_blocks_whose_members_differ(spark, documents_of, crowd, edits):
    r = random.Random(5)
    rows = family(r, [f"w{i}" for i in range(80)], 240, 10, edits)
    got = {x.doc_id: x.component_id for x in ngram_join.components(documents_of(rows), crowd=crowd, weight=30 * 77).collect()}
    assert got == brute(rows)


def test_hashed_words_split_like_the_pattern():
    from wayfarer.llm.common import SLICE, hashed_words

    long = b" ".join(b"w%d" % (i % 977) for i in range(SLICE // 3))
    texts = [None, b"", b"a", b" \n", b"One two\x0bONE  two\x1ctwo", b"x" * 70_000, long, "\u00e9t\u00e9 \u00c9t\u00e9".encode(), b"z"]
    names = {}
    for fold in (True, False):
        for t, h in zip(texts, hashed_words(texts, fold), strict=True):
            words = [w.lower() if fold else w for w in re.findall(rb"[^\x20\x09-\x0D]+", t or b"")]
            assert len(words) == len(h)
            for w, x in zip(words, h.tolist()):
                assert names.setdefault((fold, w), x) == x
    assert len(set(names.values())) >= len({w for _, w in names})


def test_repeated_rows_and_nulls(documents_of):
    text = "the same words in every one of these rows"
    rows = [(5, text), (5, text), (7, text), (None, text), (8, None), (7, ""), (7, "other"), (9, "other")]
    got = sorted(map(tuple, ngram_join.components(documents_of(rows)).collect()), key=str)
    want = [(5, 6, 5), (5, 6, 5), (7, 6, 5), (None, 6, None), (8, 0, 8), (7, 0, 5), (7, 1, 5), (9, 1, 5)]
    assert got == sorted(want, key=str)
    assert sorted(x.doc_id for x in ngram_join.drop_near_copies(documents_of(rows[2:3] + rows[4:5])).collect()) == [7, 8]
    assert ngram_join.components(documents_of(rows[:1]).limit(0)).count() == 0


def test_divide_skip_equals_counting():
    r = np.random.default_rng(4)
    for _ in range(60):
        base = r.integers(0, 400, 150)
        sets = [np.unique(np.where(r.random(150) < r.choice([0.0, 0.03, 0.1, 0.3]), r.integers(0, 400, 150), base)).astype(np.uint64) for _ in range(30)]
        block = ngram_join.Block(sets, 85)
        for q, x in enumerate(sets):
            want = [d for d, y in enumerate(sets) if d != q and 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))]
            assert sorted(block.partners(q)) == want


def test_connected_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {x.node: x.component for x in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}}


def test_query_matches_brute_force_on_the_given_table(spark):
    from wayfarer.llm.queries import op8_ngram_join

    sf = "/root/testdata/sf0.001"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {x.doc_id: x.component_id for x in op8_ngram_join(spark, sf).collect()} == brute(rows)
