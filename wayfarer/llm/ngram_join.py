"""Exact Jaccard self-join on word shingles by T-occurrence search with DivideSkip.

A document is the set of its distinct 4-word shingles. Documents link when
``100 * |A and B| >= 85 * |A or B|``; the result names each document's component.

Lists. A partner shares at least ``T = ceil(0.85 n)`` shingles, so of a document's
first ``n - T + k`` shingles in hash order (``k`` about 0.05 n) at least ``k'``
also open the partner's order. One pass over the texts gives these openings. Spark
counts each shingle; a document with fewer than ``k'`` shared ones can have no partner
and leaves. The others skip their ``k' - 1`` most frequent lists and are posted to the
rest, rarest first; a linked pair meets in at least one posted list.

Crowds. Documents posted to a list of more than ``CROWD`` meet no one there. They read
their whole sets instead: shingles are counted again among them, each skips its
``T - 1`` most frequent lists and is posted to the rest. A frequent passage thus brings
documents together only if it is nearly all they have.

Blocks. Every list has a pivot, its smallest document, and sends its documents there.
A pivot's documents are dealt into blocks of ``WEIGHT`` shingles, with the pivot in each
of them; where there are several, a second round sends the documents not yet connected
to the pivot to all its blocks. Blocks, not pairs, travel; tasks read them as a sorted stream.

Search. DivideSkip answers each query: the short inverted lists are heap-merged with
counting, the long ones probed by binary search for those documents that can still
reach the overlap. The pivot asks first; what is connected to it need not ask again.

Words and shingles are compared by 64-bit hashes. Equal sets are one class, which is
one node; copies are never expanded into pairs.

Defined results: a null or empty text has no shingles and is alone; fewer than four
words give one shingle; a null doc_id has a null component; rows that repeat a doc_id
are one node; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import cut, hashed_words, release, utf8
from wayfarer.llm.components import connected

WIDTH = 4
PERCENT = 85
#: Further shingles of the opening, in percent of the set.
EXTRA = 5
#: Longest list whose documents meet by their openings alone.
CROWD = 64
#: Shingles per block, about.
WEIGHT = 300_000
#: Weight of the DivideSkip rule for the number of long lists.
MU = 0.0085

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_sets(texts: list[bytes | None], width: int = WIDTH):
    """For each text the sorted distinct 64-bit hashes of its word shingles."""
    for h in hashed_words(texts, fold=True):
        if not len(h):
            yield h
            continue
        n = max(1, len(h) - width + 1)
        s = np.full(n, min(width, len(h)), np.uint64)
        for j in range(min(width, len(h))):
            s = s * _STEP + h[j : j + n]
        s ^= s >> np.uint64(29)
        yield np.unique(s * _MIX)


def need(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def opening(n: int, percent: int = PERCENT, extra: int = EXTRA) -> int:
    return n - need(n, percent) + max(1, extra * n // 100) if n else 0


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _openings(docs: DataFrame, width: int, percent: int, extra: int) -> DataFrame:
    """doc_id, n_shingles, set_digest and the opening hashes of every row, in one pass over the texts."""

    def of(batches):
        for batch in batches:
            sets = list(shingle_sets(utf8(batch.column("text")), width))
            digests = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    _lists([s[: opening(len(s), percent, extra)] for s in sets]),
                ],
                names=["doc_id", "n_shingles", "set_digest", "hashes"],
            )

    return _texts(docs).mapInArrow(of, "doc_id long, n_shingles long, set_digest binary, hashes array<long>")


def _whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """doc, crowded, homes and all hashes of the wanted documents."""

    def of(batches):
        for batch in batches:
            hashes = _lists(list(shingle_sets(utf8(batch.column("text")), width)))
            columns = [batch.column(c) for c in ("doc", "crowded", "homes")] + [hashes]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "crowded", "homes", "hashes"])

    rows = _texts(docs).join(wanted, F.col("doc_id") == F.col("doc")).select("doc", "crowded", "homes", "text")
    return rows.mapInArrow(of, "doc long, crowded boolean, homes array<struct<pivot:long,salt:int>>, hashes array<long>")


class Block:
    """Inverted lists over a few documents, searched with DivideSkip."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.sets, self.percent, self.m = sets, percent, max(1, len(sets))
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")  # owners ascend within a list
        self.owner = owner[order]
        self.names, self.start, self.length = np.unique(values[order], return_index=True, return_counts=True)
        self.keys = np.repeat(np.arange(len(self.names)), self.length) * self.m + self.owner
        self.sizes = sizes

    def partners(self, q: int) -> list[int]:
        """The documents that link with document q."""
        n = int(self.sizes[q])
        if not n:
            return []
        lists = np.searchsorted(self.names, self.sets[q])
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        lists = lists[np.searchsorted(self.length[lists], 2) :]  # lists of q alone hold no partner
        t = need(n, self.percent)
        if len(lists) < t:
            return []
        longest = int(self.length[lists[-1]])
        skip = min(t - 1, int(t / (MU * log2(max(2, longest)) + 1)))
        short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
        merged = heapq.merge(*(self.owner[self.start[i] : self.start[i] + self.length[i]].tolist() for i in short))
        found = [(d, c) for d, g in groupby(merged) if (c := sum(1 for _ in g)) >= t - skip and d != q]
        if not found:
            return []
        docs, counts = np.array(found).T
        near = (self.percent * self.sizes[docs] <= 100 * n) & (self.percent * n <= 100 * self.sizes[docs])
        docs, counts = docs[near], counts[near]
        if len(long) and len(docs):
            probe = long[:, None] * self.m + docs[None, :]
            at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            counts = counts + (self.keys[at] == probe).sum(axis=0)
        linked = (100 + self.percent) * counts >= self.percent * (n + self.sizes[docs])
        return docs[linked].tolist()


def search(groups, docs: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, asks: np.ndarray, home: np.ndarray, percent: int):
    """Spanning links (a, b) inside the groups, which are ranges of rows; the first row of each asks first.

    Rows with equal docs or labels are connected; only ``asks`` are queries. Members of the
    component of a group's anchor need not ask: their links to others are found by those. The
    anchor is a row at ``home``; where there is none and all rows ask, the first row with a link.
    """
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for keys in (docs, labels):
        order = np.argsort(keys, kind="stable")
        same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
        for i in same.tolist():
            x, y = root(order[i]), root(order[i + 1])
            if x != y:
                parent[y] = x
    block, links = Block(sets, percent), []
    for begin, end in groups:
        if len({root(x) for x in range(begin, end)}) == 1:
            continue
        at_home = np.flatnonzero(home[begin:end])
        anchor = begin + int(at_home[0]) if len(at_home) else None
        free = anchor is None and bool(asks[begin:end].all())
        for q in range(begin, end):
            if not asks[q] or (anchor is not None and root(q) == root(anchor)):
                continue
            for d in block.partners(q):
                x, y = root(q), root(d)
                if x != y:
                    parent[y] = x
                    links.append((int(docs[q]), int(docs[d])))
                if free and anchor is None and begin <= d < end:
                    anchor = q
    return links


def _searched(batches, percent: int):
    """Links from a stream of rows sorted by pivot, salt and doc; several blocks are searched at once."""
    held, size = [], 0

    def found(rows):
        docs, labels, asks, home = (np.array([r[i] for r in rows]) for i in (2, 3, 4, 5))
        keys = [r[:2] for r in rows]
        starts = [i for i in range(len(rows)) if i == 0 or keys[i] != keys[i - 1]]
        groups = [(a, b) for a, b in zip(starts, [*starts[1:], len(rows)]) if b - a > 1]
        first = lambda g: sorted(range(*g), key=lambda i: (docs[i] != keys[i][0], i))  # the pivot leads its group
        order = [i for g in groups for i in first(g)]
        if not order:
            return None
        ends = np.cumsum([b - a for a, b in groups]).tolist()
        pick = np.array(order)
        sets = [rows[i][6] for i in order]
        links = search(list(zip([0, *ends], ends)), docs[pick], sets, labels[pick], asks[pick], home[pick], percent)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("pivot", "salt", "doc", "label", "asks", "home")]
        lists = batch.column("hashes")
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for i, key in enumerate(zip(*columns)):
            if size > WEIGHT and held[-1][:2] != key[:2]:
                if (out := found(held)) is not None:
                    yield out
                held, size = [], 0
            held.append((*key, flat[ends[i] : ends[i + 1]].copy()))
            size += int(ends[i + 1] - ends[i])
    if held and (out := found(held)) is not None:
        yield out


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in the blocks of rows (pivot, salt, doc, label, asks, home, hashes)."""
    dealt = rows.select("pivot", "salt", "doc", "label", "asks", "home", "hashes").repartition(F.col("pivot"), F.col("salt"))
    return cut(
        dealt.sortWithinPartitions("pivot", "salt", "doc").mapInArrow(lambda b: _searched(b, percent), "a long, b long")
    )


def _posts(lists: DataFrame) -> DataFrame:
    """doc, n, h, pivot, size of each posted list that holds several documents, from (doc, n, posted)."""
    rows = lists.select("doc", "n", F.explode("posted").alias("h"))
    sizes = rows.groupBy("h").agg(F.min("doc").alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return rows.join(sizes, "h")


def _posted(rows: DataFrame, kept: str) -> DataFrame:
    """doc, n and the posted lists: of rows (doc, n, h) the shared ones without each document's ``kept - 1`` most frequent."""
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df >= 2")
    return (
        rows.join(shared, "h")
        .groupBy("doc")
        .agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("lists"))
        .withColumn("k", F.expr(kept).cast("int"))
        .filter("size(lists) >= k")
        .select("doc", "n", F.expr("array_distinct(transform(slice(lists, 1, greatest(size(lists) - k + 1, 0)), x -> x.h))").alias("posted"))
    )


def _dealt(pairs: DataFrame, weight: int) -> DataFrame:
    """(doc, n, pivot) to blocks: a salt for each document, and the pivot in every block of its own."""
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.sum("n") / weight).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int")
    where = F.when(F.col("doc") == F.col("pivot"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(salt))
    return pairs.join(sizes, "pivot").select("doc", "n", "pivot", "salts", F.explode(where).alias("salt"))


def links(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, extra: int = EXTRA, crowd: int = CROWD, weight: int = WEIGHT
) -> tuple[DataFrame, DataFrame]:
    """(rows, edges): doc_id, n_shingles and class of all rows; links that connect all linked classes.

    A class is named by the smallest doc_id with its set.
    """
    spark = docs.sparkSession
    table = cut(_openings(docs, width, percent, extra))
    classes = table.filter("doc_id is not null and set_digest is not null").groupBy("set_digest").agg(
        F.min("doc_id").alias("class")
    )
    named = table.drop("hashes").join(classes, "set_digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("class", "doc_id").alias("class")
    )
    rows = table.filter("doc_id is not null").select(
        F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.explode("hashes").alias("h")
    )
    least_shared = f"greatest(1, floor({extra} * ((({percent} * n + 99) div 100)) / 100))"
    heads = classes.select(F.col("class").alias("doc")).distinct()
    posted = cut(_posted(rows, least_shared).join(heads, "doc", "left_semi"))
    release(spark)

    met = _posts(posted)
    calm = F.when(F.col("size") <= crowd, F.col("pivot"))
    seen = cut(met.groupBy("doc").agg(
        F.min("n").alias("n"), F.collect_set(calm).alias("pivots"), F.max(F.col("size") > crowd).alias("crowded")
    ))
    homes = cut(_dealt(seen.select("doc", "n", F.explode("pivots").alias("pivot")), weight))
    own = homes.groupBy("doc").agg(F.collect_list(F.struct("pivot", "salt")).alias("homes"))
    wanted = seen.join(own, "doc", "left").select("doc", "crowded", "homes")
    sets = cut(_whole_sets(docs, wanted, width))
    release(spark)

    asking = (F.col("doc").alias("label"), F.lit(True).alias("asks"), F.lit(False).alias("home"))
    edges = _links(sets.select("doc", "hashes", F.explode("homes").alias("place")).select("*", "place.*", *asking), percent)
    crowded = sets.filter("crowded").select("doc", "hashes")
    all_homes = homes
    if not seen.filter("crowded").isEmpty():
        whole = crowded.select("doc", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
        pairs = _posts(_posted(whole, f"({percent} * n + 99) div 100")).select("doc", "n", "pivot").distinct()
        crowd_homes = cut(_dealt(pairs, weight))
        edges = edges.unionAll(_links(crowd_homes.join(crowded, "doc").select("*", *asking), percent))
        all_homes = homes.unionAll(crowd_homes)
    hot = all_homes.filter("salts > 1 and (doc <> pivot or salt = 0)").drop("salt", "salts").distinct()
    if not hot.isEmpty():
        edges = edges.unionAll(_across(hot, connected(edges), sets.select("doc", "hashes"), weight, percent))
    return named, edges.unionAll(_same_document(named))


def _same_document(named: DataFrame) -> DataFrame:
    """Links between the classes of rows that repeat a doc_id."""
    own = named.filter("doc_id is not null")
    several = own.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("last")).filter("a < last")
    return own.join(several, "doc_id").select("a", F.col("class").alias("b"))


def _across(hot: DataFrame, labels: DataFrame, sets: DataFrame, weight: int, percent: int) -> DataFrame:
    """Second round: documents of many-block pivots that are not connected to their pivot meet all its blocks."""
    now = cut(
        hot.join(labels, F.col("doc") == F.col("node"), "left").select("doc", "n", "pivot", F.coalesce("component", "doc").alias("label"))
    )
    own = now.filter("doc = pivot").select("pivot", F.col("label").alias("home"))
    now = now.join(own, "pivot").withColumn("apart", F.col("label") != F.col("home"))
    sizes = now.groupBy("pivot").agg(
        F.ceil(F.sum("n") / weight).cast("int").alias("salts"),
        F.ceil(F.sum(F.when(F.col("apart"), F.col("n"))) / weight).cast("int").alias("chunks"),
    )
    now = now.join(sizes.filter("chunks > 0"), "pivot")
    salt, chunk = (F.pmod(F.xxhash64("doc", F.lit(i)), F.col(c)).cast("int") for i, c in ((0, "salts"), (1, "chunks")))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    keys = ("doc", "pivot", "label", "apart")
    members = now.select(*keys, salt.alias("salt"), each("chunks").alias("chunk"), F.lit(False).alias("asks"))
    asking = now.filter("apart").select(*keys, each("salts").alias("salt"), chunk.alias("chunk"), F.lit(True).alias("asks"))
    both = members.unionByName(asking).groupBy(*keys, "salt", "chunk").agg(F.max("asks").alias("asks"))
    block = both.select("doc", "pivot", "label", F.struct("salt", "chunk").alias("salt"), "asks", (~F.col("apart")).alias("home"))
    return _links(block.join(sets, "doc"), percent)


def components(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    named, edges = links(docs, **options)
    found = connected(edges)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class"))
    return named.join(found, F.col("class") == F.col("node"), "left").select(
        "doc_id", "n_shingles", component.alias("component_id")
    )


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, with all their columns."""
    lost = components(docs, **options).filter("component_id < doc_id").select(F.col("doc_id").alias("lost_id")).distinct()
    return docs.join(lost, docs["doc_id"] == lost["lost_id"], "left_anti")
