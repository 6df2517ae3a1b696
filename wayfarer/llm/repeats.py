"""Finding and removing long repeats: the parts that suffix-array and recompression dedup share.

A window is ``width`` consecutive units (bytes or words) of one document. Each window
has an anchor, a hash that its own content decides, so equal windows have equal
anchors wherever they occur. Consecutive windows with one anchor form a run; a run
travels as (anchor, hash of its content, doc_id, first window, number of windows).

``decide`` shuffles runs once by anchor and reads them back sorted, as a stream: runs
whose whole content occurred before are settled there; where an anchor has different
contents, one run of each is passed on as partial, to be compared window by window.
Copies inside one batch of documents are settled before the shuffle, so that a group
of very many copies is reduced where it is read.

``finish`` joins all settled windows to the texts by doc_id. Texts are shuffled once:
the exchange that fetches partial runs is the same one and is reused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import cut

RUN_SCHEMA = "settled boolean, anchor long, content long, doc_id long, at int, n int, twice boolean, inner boolean"
_RUN_NAMES = ["settled", "anchor", "content", "doc_id", "at", "n", "twice", "inner"]
SPAN_SCHEMA = "doc_id long, at int, n int, anchor long, partial boolean"


#: Stands for a null doc_id where texts are dealt: a key that cannot be null takes no filter, so all joins share one exchange.
NO_ID = -(2**63)


def by_document(docs: DataFrame) -> DataFrame:
    """key (doc_id, never null) and text, dealt by key; equal calls give one exchange, which Spark reuses."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key")
    return docs.select(key, F.col("text").cast("string").alias("text")).repartition(n, "key")


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before."""
    first = np.zeros(len(columns[0]), bool)
    first[:1] = True
    for c in columns:
        first[1:] |= c[1:] != c[:-1]
    return first


def run_batches(batches, runs_of, everywhere: bool):
    """Runs of each batch's texts; ``runs_of(text)`` gives arrays anchor, content, at, n and
    inner: whether the run may hold one window twice.

    Of equal runs in a batch the first stays open; the others are settled, if they may be:
    with ``everywhere`` any other occurrence counts, else only one in a smaller document.
    """
    for batch in batches:
        found = [(d, runs_of(t)) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if d is not None and t]
        found = [(d, r) for d, r in found if len(r[0])]
        if not found:
            continue
        anchor, content, at, n, inner = (np.concatenate([r[i] for _, r in found]) for i in range(5))
        doc = np.repeat(np.array([d for d, _ in found], np.int64), [len(r[0]) for _, r in found])
        order = np.lexsort((at, doc, content, anchor))
        anchor, content, doc, at, n, inner = (x[order] for x in (anchor, content, doc, at, n, inner))
        first = group_starts(anchor, content)
        group = np.cumsum(first) - 1
        twice = np.bincount(group)[group] > 1
        settled = ~first if everywhere else doc > doc[first][group]
        columns = [
            pa.array(settled),
            pa.array(anchor),
            pa.array(content),
            pa.array(doc),
            pa.array(at.astype(np.int32)),
            pa.array(n.astype(np.int32)),
            pa.array(twice & first & everywhere),
            pa.array(inner),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=_RUN_NAMES)


def _spans(doc, at, n, anchor, partial):
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(at), pa.array(n), pa.array(anchor), pa.array(partial)],
        names=["doc_id", "at", "n", "anchor", "partial"],
    )


def decide_batches(batches, everywhere: bool):
    """Settled and partial runs from a stream sorted by (settled, anchor, content, doc_id, at).

    Held between batches: the leading runs (those of the smallest document) of the first
    and the last content of the anchor in hand, which are runs of two documents at most.
    """
    held = None
    for batch in batches:
        now = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in _RUN_NAMES}
        ready = now["settled"]
        if ready.any():
            yield _spans(*(now[k][ready] for k in ("doc_id", "at", "n", "anchor")), np.zeros(int(ready.sum()), bool))
        now = {k: v[~ready] for k, v in now.items()} | {"done": np.zeros(int((~ready).sum()), bool)}
        if not len(now["anchor"]):
            continue
        if held is not None:
            now = {k: np.concatenate([held[k], now[k]]) for k in now}
        out, held = _decided(now, everywhere, last=False)
        if out is not None:
            yield out
    if held is not None:
        out, _ = _decided(held, everywhere, last=True)
        if out is not None:
            yield out


def _decided(now, everywhere, last):
    anchors = group_starts(now["anchor"])
    contents = anchors | group_starts(now["content"])
    anchor_no, content_no = np.cumsum(anchors) - 1, np.cumsum(contents) - 1
    n_contents = np.bincount(anchor_no, weights=contents).astype(int)[anchor_no]
    several = (np.bincount(content_no)[content_no] > 1) | (
        np.bincount(content_no, weights=now["twice"]).astype(int)[content_no] > 0
    )
    open_anchor = np.zeros(len(anchors), bool) if last else anchor_no == anchor_no[-1]
    if everywhere:
        full, lead = several, contents
    else:
        full = now["doc_id"] > now["doc_id"][contents][content_no]
        lead = ~full
    partial = lead & ~now["done"] & ((n_contents > 1) | (now["inner"] & ~open_anchor))
    out = None
    if full.any() or partial.any():
        pick = np.concatenate([np.flatnonzero(full), np.flatnonzero(partial)])
        flag = np.arange(len(pick)) >= full.sum()
        out = _spans(*(now[k][pick] for k in ("doc_id", "at", "n", "anchor")), flag)
    if last:
        return out, None
    done = now["done"] | partial
    ends = content_no[contents & open_anchor][[0, -1]]
    carry = np.flatnonzero(lead & np.isin(content_no, ends))
    held = {k: v[carry] for k, v in now.items()}
    held["done"], held["twice"] = done[carry], held["twice"] | (several & everywhere)[carry]
    return out, held


def decide(docs: DataFrame, runs_of, everywhere: bool) -> DataFrame:
    """doc_id, at, n, anchor, partial: settled windows, and the runs still to be compared."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = texts.mapInArrow(lambda batches: run_batches(batches, runs_of, everywhere), RUN_SCHEMA)
    dealt = runs.repartition(F.when(F.col("settled"), F.xxhash64("doc_id", "at")).otherwise(F.col("anchor")))
    ordered = dealt.sortWithinPartitions("settled", "anchor", "content", "doc_id", "at")
    return cut(ordered.mapInArrow(lambda batches: decide_batches(batches, everywhere), SPAN_SCHEMA))


def covered(length: int, at: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Mask of the units that lie in a removed window."""
    change = np.zeros(length + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + n + width - 1, -1)
    return np.cumsum(change[:-1]) > 0


def span_lists(batch, column: str):
    """For each row of the batch its (at, n) arrays."""
    lists = batch.column(column)
    flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    at, n = flat.field("at").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    place = 0
    for i, ok in enumerate(valid):
        size = ends[i + 1] - ends[i] if ok else 0
        yield at[place : place + size].astype(np.int64), n[place : place + size].astype(np.int64)
        place += size


def window_spans(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted window numbers as (at, n) stretches."""
    breaks = np.flatnonzero(np.diff(places) != 1) + 1
    starts = np.concatenate([[0], breaks]).astype(int)
    ends = np.concatenate([breaks, [len(places)]])
    return places[starts].astype(np.int32), (ends - starts).astype(np.int32)


def merged(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (doc, at) as stretches (doc, at, n) of consecutive windows."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    starts = np.ones(len(doc), bool)
    starts[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    places = np.flatnonzero(starts)
    return doc[places], at[places], np.diff(np.append(places, len(doc)))


def per_document(spans: DataFrame, *more: str) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", *more)).alias("spans"))


def finish(docs: DataFrame, settled: DataFrame, of, schema: str) -> DataFrame:
    """Join settled windows to the texts and let ``of(batches)`` make the result rows."""
    joined = by_document(docs).join(per_document(settled), F.col("key") == F.col("doc_id"), "left")
    doc_id = F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id")
    return joined.select(doc_id, "text", "spans").mapInArrow(of, schema)


def fetch(docs: DataFrame, partial: DataFrame) -> DataFrame:
    """doc_id, text, spans of the documents that have partial runs."""
    return by_document(docs).join(partial, F.col("key") == F.col("doc_id")).select("doc_id", "text", "spans")
