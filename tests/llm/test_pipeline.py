import hashlib
from collections import Counter

import corpus_pipeline
from tests.llm.test_ngram_join import brute
from tests.llm.test_tokens_packing import check_packing
from wayfarer.llm import common, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark, tmp_path):
    docs = common.documents(common.session(spark), SF)
    columns = docs.columns
    out = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out[name] = (docs.collect(), stage(spark, docs, SF))
        out[name][1].write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns
        out[name] = (out[name][0], docs.collect())

    before, after = out["toxicity"]
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    lost = {x.doc_id for x in before} - {x.doc_id for x in after}
    wrong = [d for d, y in labels.items() if (d in lost) != bool(y)]
    assert len(wrong) <= 0.1 * len(labels)

    before, after = out["exact_dedup"]
    keep = {}
    for x in before:
        keep[x.text] = max(keep.get(x.text, -1), x.doc_id)
    assert sorted(x.doc_id for x in after) == sorted(keep.values())

    before, after = out["ngram_join"]
    want = brute([(x.doc_id, x.text) for x in before], percent=80, width=5)
    assert sorted(x.doc_id for x in after) == sorted(set(want.values()))

    before, after = out["mixing"]
    assert Counter(after) == poisson(before)

    before, after = out["packing"]
    check_packing([(x.doc_id, x.text) for x in before], after, 4096)


def poisson(rows, seed=17):
    """Counter of rows, each as often as its hash-seeded Poisson number says."""
    from math import exp

    n = Counter(x.source for x in rows)
    out = Counter()
    for x in rows:
        rate = len(rows) / len(n) / n[x.source]
        u = int(hashlib.md5(f"{seed}:{x.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, exp(-rate), exp(-rate)
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        if k:
            out[x] += k
    return out


def test_run_gives_pieces(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert got.count() > 50


def test_toxicity_held_out_accuracy(spark):
    labels = {x.doc_id: x.toxic for x in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    docs = common.documents(common.session(spark), "/root/testdata/sf0.01")
    got = toxicity.toxicity_scores(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).collect()
    assert len(got) == docs.count()
    held = [x for x in got if x.held_out and x.doc_id in labels]
    assert sum(x.predicted == labels[x.doc_id] for x in held) >= 0.9 * len(held)


def test_toxicity_edges(spark, documents_of):
    docs = documents_of([(1, None), (2, ""), (3, "x" * 100000), (None, "a"), (3, "y")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs.withColumnRenamed("lang", "score"), none).collect()
    assert len(got) == 5 and all(x.score < 1e-5 and x.predicted == 0 for x in got)
    assert toxicity.toxicity_scores(docs.limit(0), none).count() == 0
    assert toxicity.drop_toxic(docs, none).count() == 5
    model = toxicity.fit(["you idiot", "nice day", "idiot talk", "sunny day"] * 10, [1, 0, 1, 0] * 10)
    scored = toxicity.score(documents_of([(1, "an idiot"), (2, "a day")]), model).collect()
    assert [x.predicted for x in sorted(scored, key=lambda x: x.doc_id)] == [1, 0]


def toxicity_twin(texts, labels, epochs=20, rate=0.1):
    """The classifier in plain Python: features, ratios of smoothed shares, unit length, gradient steps."""
    import math

    import numpy as np

    m = 2**64

    def grams(text):
        codes, found = [ord(c) for c in f" {text.lower()} "], set()
        for n in (3, 4):
            for i in range(len(codes) - n + 1):
                h = codes[i]
                for c in codes[i + 1 : i + n]:
                    h = (h * 1099511628211 + c) % m
                h = (h ^ (h >> 32)) * 0x9E3779B97F4A7C15 % m
                found.add(h >> 46)
        return sorted(found)

    rows = [grams(t) for t in texts]
    toxic, other = Counter(), Counter()
    for x, y in zip(rows, labels):
        (toxic if y else other).update(x)
    n1, n0 = sum(labels), len(labels) - sum(labels)
    ratio = lambda f: math.log((toxic[f] + 1) / (n1 + 2)) - math.log((other[f] + 1) / (n0 + 2))
    values = []
    for x in rows:
        length = math.sqrt(sum(ratio(f) ** 2 for f in x)) or 1.0
        values.append([ratio(f) / length for f in x])
    weights, square = Counter(), {}
    bias, bias_square = math.log(n1 / n0), 1e-6
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            z = bias + sum(weights[f] * v for f, v in zip(rows[i], values[i]))
            slope = 1 / (1 + math.exp(-z)) - labels[i]
            for f, v in zip(rows[i], values[i]):
                step = slope * v + 1e-6 * weights[f]
                square[f] = square.get(f, 1e-6) + step * step
                weights[f] -= rate * step / math.sqrt(square[f])
            bias_square += slope * slope
            bias -= rate * slope / math.sqrt(bias_square)

    def score(text):
        x = grams(text)
        length = math.sqrt(sum(ratio(f) ** 2 for f in x))
        z = bias + (sum(weights[f] * ratio(f) for f in x) / length if length else 0.0)
        return 1 / (1 + math.exp(-z))

    return score


def test_toxicity_query_matches_plain_python(spark):
    """On a small table the training rows are all labelled rows outside the held-out fold, in order of doc_id."""
    import zlib

    from wayfarer.llm.queries import op10_toxicity

    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    fold = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    train = sorted((d, y, texts[d]) for d, y in labels.items() if y in (0, 1) and d in texts and not fold(d))
    score = toxicity_twin([t for _, _, t in train], [y for _, y, _ in train])
    got = op10_toxicity(spark, SF).collect()
    assert sorted(x.doc_id for x in got) == sorted(texts)
    for x in got:
        assert x.held_out == fold(x.doc_id) and abs(x.score - score(texts[x.doc_id])) < 1e-4
        assert x.predicted == int(x.score >= 0.5)


def test_toxicity_sample_is_bounded_in_bytes(spark, documents_of):
    docs = documents_of([(i, "you idiot " * 50 if i % 2 else "a nice day " * 50) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    none = toxicity.train(docs, labels, most_bytes=100)
    assert not none[0].any()
    some = toxicity.train(docs, labels, most_bytes=6000)
    assert some[0].any()


def test_stages_take_nulls_repeats_and_clashing_columns(spark):
    names = ["rate", "copy", "n_copies", "score", "row", "id", "lost_id", "component_id", "salt", "h", "a.b"]
    text = "the same nine words stand in every one here"
    table = [(1, None), (2, ""), (2, ""), (None, text), (5, text), (5, text), (6, text + " and more"), (7, "x " * 60_000), (8, "\n")]
    docs = spark.createDataFrame([(d, t, "en", None if d == 8 else "s", 0, *[d] * len(names)) for d, t in table],
        "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in names))
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, SF)
            assert out.columns == docs.columns
            rows = out.collect()
            assert all(x[c] == x.doc_id for x in rows for c in names)
            if name == "exact_dedup" and not empty:
                # of equal texts (null as empty) the largest doc_id stays, once
                assert Counter(x.doc_id for x in rows) == Counter([2, 5, 6, 7, 8])
            if name == "ngram_join" and not empty:
                assert sorted(x.doc_id for x in rows) == [2, 5, 6, 7, 8]
            now = spark.createDataFrame(rows, docs.schema)
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
        assert bool(pieces) == bool(rows)
