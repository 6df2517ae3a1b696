import random
import zlib
from array import array
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from wayfarer.llm import packing, tokens

PARTS = ["<|endoftext|>", "<|startoftext|>", " ", "\n", "\x1c", "'s", "don't", "É", "é", "é", "́", "　", "İ", "ΣΑΣ",
         "12", "½", "--", "漢字", "\U0001f600", "‍", "\x85", "\xa0", "A", "b,", "wörd.", "x" * 60, "ſ", "ŉ"]


def library():
    return tokens.encoder(tokens.vocabulary_path()).library


def ids_of(text):
    return library().encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=6), max_size=12).map("".join))
def test_words_encode_like_the_whole_text(text):
    assert tokens.encoder(tokens.vocabulary_path()).encode([text])[0] == array("I", ids_of(text)).tobytes()


def test_memo_stays_bounded_and_right():
    small = tokens.WordEncoder(tokens.vocabulary_path(), memo_words=20)
    r = random.Random(1)
    for _ in range(30):
        texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 5) for _ in range(30)) for _ in range(3)]
        assert small.encode(texts) == [array("I", ids_of(t)).tobytes() for t in texts]
        assert len(small.memo) <= 20 + 90


def test_counts_and_cache(spark, documents_of, tmp_path):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "Hello world"), (5, "a b c " * 900), (5, "a b c " * 900), (6, "x" * 5000)]
    cache = f"file://{tmp_path}/cache"
    docs = documents_of(rows).withColumnRenamed("lang", "digest")
    want = sorted((d, len((t or "").encode()), n := len(ids_of(t or "")), n > 2048) for d, t in rows)
    for _ in range(2):
        assert sorted(map(tuple, tokens.count_tokens(docs, cache=cache).collect())) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count() == 4
    assert tokens.count_tokens(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_patterns_hold_every_length_once(histogram):
    found = packing.shortest_pack_first(histogram, 64)
    assert all(sum(length * k for length, k in p) <= 64 for _, p in found)
    held = Counter()
    for count, p in found:
        for length, k in p:
            held[length] += count * k
    assert held == histogram


def test_pieces_tile_sequences(spark, documents_of):
    r = random.Random(3)
    rows = [(i, " ".join("tok" for _ in range(r.choice([0, 1, 5, 5, 5, 40, 300])))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "w " * 1000), (902, "w " * 1000)]
    docs = documents_of(rows)
    got = packing.pack(docs, size=256).collect()
    check_packing(rows, got, 256)
    assert packing.pack(docs.limit(0)).count() == 0


def check_packing(rows, got, size, end=2):
    want = Counter()
    for doc_id, text in rows:
        ids = ids_of(text or "") + [end]
        for s in range(0, len(ids), size):
            part = ids[s : s + size]
            want[doc_id, s, len(part), zlib.crc32(array("I", part).tobytes()), len(ids)] += 1
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got) == want
    sequences = defaultdict(list)
    for x in got:
        sequences[x.sequence_id].append((x.offset, x.length))
    total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        total += at
    return total / (len(sequences) * size)


def test_query_on_the_given_table(spark):
    from wayfarer.llm.queries import op3_packing, op4_token_counts

    sf = "/root/testdata/sf0.001"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check_packing(rows, op3_packing(spark, sf).collect(), 4096) > 0.9
    want = {d: len(ids_of(t or "")) for d, t in rows}
    assert {x.doc_id: x.n_tokens for x in op4_token_counts(spark, sf).collect()} == want


def test_query_counts_from_a_cache_that_a_second_call_hits(spark, tmp_path):
    from wayfarer.llm.queries import op4_token_counts

    spark.conf.set("spark.wayfarer.tokenCache", f"{tmp_path}/cache")
    try:
        first = sorted(map(tuple, op4_token_counts(spark, "/root/testdata/sf0.001").collect()))
        stored = spark.read.parquet(f"{tmp_path}/cache").count()
        second = sorted(map(tuple, op4_token_counts(spark, "/root/testdata/sf0.001").collect()))
        assert first == second and stored > 0
        assert spark.read.parquet(f"{tmp_path}/cache").count() == stored
    finally:
        spark.conf.unset("spark.wayfarer.tokenCache")
