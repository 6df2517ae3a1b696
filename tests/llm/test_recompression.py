import hashlib
import random

import numpy as np
import pytest

from wayfarer.llm import recompression


def brute(rows, width=50):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop")
    passages = [[word() for _ in range(r.randint(48, 140))] for _ in range(4)] + [["la"] * 120, ["la", "li"] * 60]
    rows = []
    for i in range(150):
        w = [word() for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 2)):
            p = r.choice(passages)
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            w[(k := r.randint(0, len(w))) : k] = p[a:b] if r.random() < 0.6 else p
        rows.append((i * 7 % 151, r.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(500 + i, rows[3][1]) for i in range(40)] + [(900, None), (901, ""), (902, " \n")]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(documents_of, seed):
    from pyspark.sql import functions as F

    rows = corpus(seed)
    docs = documents_of(rows).withColumnRenamed("lang", "at")
    got = recompression.drop_repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(1)
    for _ in range(30):
        shared = r.integers(0, 5, 80).astype(np.uint64)
        a, b = (np.concatenate([r.integers(0, 5, 90), shared, r.integers(0, 5, 90)]).astype(np.uint64) for _ in range(2))
        b = b[int(r.integers(0, 60)) :]
        x, y = recompression.anchors(a), recompression.anchors(b)
        shift = len(a) - len(b)
        assert (x[90 : 90 + 31] == y[90 - shift : 90 - shift + 31]).all()


def test_repeated_rows_and_empty(documents_of):
    text = " ".join(f"w{i}" for i in range(60))
    got = recompression.drop_repeated_windows(documents_of([(4, text), (4, text), (None, text), (9, text)])).collect()
    assert sorted((x.doc_id or 0, x.n_removed) for x in got) == [(0, 0), (4, 0), (4, 0), (9, 60)]
    assert recompression.drop_repeated_windows(documents_of([(4, text)]).limit(0)).count() == 0


def test_query_on_the_given_table(spark):
    from wayfarer.llm.queries import op2_recompression

    sf = "/root/testdata/sf0.001"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op2_recompression(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == brute(rows)
