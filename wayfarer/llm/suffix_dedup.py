"""Suffix-array dedup: bytes covered by a string of ``width`` bytes that also starts elsewhere go.

Dealing. Each window of ``width`` bytes is anchored by the smallest hash of its 32-byte
substrings; runs of windows with one anchor are shuffled by it (see repeats.py). Runs
with equal contents settle each other; anchors with several contents send one run of
each, as text, to a shard.

Shards. A shard array is a suffix array by induced sorting over some megabytes of such
texts: suffixes are classified as larger or smaller than their successor, leftmost
smaller ones are sorted by inducing, the substrings between them are named and their
order is settled on the names, then all suffixes are induced from them in linear passes,
one vectorised wave per first byte. Names are refined by doubling and only as far as
``width`` bytes reach, since no longer prefix matters. Permuted common prefixes follow
from text order, capped at ``width``: a window is repeated when the prefix that it
shares with a neighbour in the array has ``width`` bytes. Bytes themselves are compared.

An anchor with more than ``CROWD`` different contents (the edges of a passage in very
many documents) is not sent to one shard: each of its windows travels as a text of its
own, dealt by 128-bit hashes. A window alone under its hash has no equal; of the others
two of each text go to a shard array, and further copies, compared with them byte by
byte, share their lot. So no task holds the crowd, and the array decides at any size.

Defined results: a null text is empty; texts under ``width`` bytes keep everything;
rows with a null doc_id keep everything; rows that repeat a doc_id lose the windows
removed from any of them; an empty table gives an empty result. Only doc_id and text
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm import repeats
from wayfarer.llm.common import cut

WIDTH = 200
#: Bytes hashed for an anchor.
GRAM = 32
#: Bytes of text per shard array; one longer run makes a shard of its own.
SHARD = 1_500_000
#: Different contents of an anchor that still go to one shard; beyond, windows are dealt one by one.
CROWD = 2000
#: Windows in one Arrow batch.
WINDOWS = 20_000

_P, _M, _Q = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), 0x94D049BB133111EB


def window_hashes(data: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all windows of ``width`` bytes, by doubling."""
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    parts = []  # (size, hashes) of the binary parts of width
    bits = width
    while True:
        if bits & 1:
            parts.append((size, h))
        bits >>= 1
        if not bits:
            break
        h = h[:-size] * np.uint64(pow(factor, size, 2**64)) + h[size:]
        size *= 2
    n = len(data) - width + 1
    out, at = np.zeros(n, np.uint64), 0
    for size, h in reversed(parts):
        out = out * np.uint64(pow(factor, size, 2**64)) + h[at : at + n]
        at += size
    out ^= out >> np.uint64(32)
    out *= _M
    return out ^ (out >> np.uint64(29))


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``span`` consecutive gram hashes."""
    low, size = grams, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = span - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def runs_of(width: int = WIDTH, gram: int = GRAM):
    def of(text: str):
        data = text.encode("utf-8", "surrogatepass")
        if len(data) < width:
            return (np.zeros(0, np.int64),) * 5
        grams, span = window_hashes(np.frombuffer(data, np.uint8), gram, _P), width - gram + 1
        found = anchors(grams, span)
        at = np.flatnonzero(repeats.group_starts(found))
        n = np.diff(np.append(at, len(found)))
        places = list(zip(at.tolist(), n.tolist()))
        content = [xxhash.xxh3_64_intdigest(data[a : a + k + width - 1]) for a, k in places]
        low = found[at]
        # equal windows of one run have its smallest gram at two places
        inner = [np.count_nonzero(grams[a : a + k + span - 1] == v) > 1 for (a, k), v in zip(places, low)]
        return low.view(np.int64), np.array(content, np.uint64).view(np.int64), at, n, np.array(inner, bool)

    return of


def classify(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the one behind them; the last symbol is the smallest."""
    step = np.sign(np.diff(s))
    known = np.where(step != 0, np.arange(len(step)), len(step))
    known = np.minimum.accumulate(known[::-1])[::-1]
    return np.append(np.append(step, 1)[known] > 0, True)


def _deal(places: np.ndarray, symbols: np.ndarray, to: list) -> None:
    order = np.argsort(symbols, kind="stable")
    places, symbols = places[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for part, symbol in zip(np.split(places, cuts), symbols[np.concatenate([[0], cuts])].tolist()):
        to[symbol].append(part)


def _wave(start: list, s, wanted, symbol: int, to: list) -> np.ndarray:
    """One bucket's suffixes in scanning order; what they induce elsewhere goes to ``to``."""
    waves = [np.concatenate(start)]
    while len(waves[-1]):
        before = waves[-1] - 1
        before = before[before >= 0]
        before = before[wanted[before]]
        symbols = s[before]
        own = symbols == symbol
        if not own.all():
            _deal(before[~own], symbols[~own], to)
        waves.append(before[own])
    return np.concatenate(waves)


def induce(s: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, size: int) -> np.ndarray:
    """All suffixes, induced from leftmost smaller ones given in order within each bucket."""
    heads: list[list] = [[] for _ in range(size)]
    _deal(leftmost, s[leftmost], heads)
    larger, to = ~smaller, [[] for _ in range(size)]
    large = [None] * size
    none = np.zeros(0, leftmost.dtype)
    for c in range(size):
        large[c] = _wave(to[c], s, larger, c, to) if to[c] else none
        if heads[c]:
            _wave(heads[c], s, larger, c, to)
    to, small = [[] for _ in range(size)], [None] * size
    for c in range(size - 1, -1, -1):
        small[c] = _wave(to[c], s, smaller, c, to) if to[c] else none
        if len(large[c]):
            _wave([large[c][::-1]], s, smaller, c, to)
    out = [np.array([len(s) - 1], leftmost.dtype)]
    for c in range(size):
        out += [large[c], small[c][::-1]]
    return np.concatenate(out)


def _grams(s: np.ndarray) -> np.ndarray:
    """Eight symbols from each place on, as one number; symbols below 2**8 after the shift by one."""
    padded = np.concatenate([(s - 1).clip(0).astype(np.uint8), np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(s), 8), (1, 1)).copy().view("<u8")[:, 0]


def suffix_array(s: np.ndarray, reach: int) -> np.ndarray:
    """Suffixes in order of their first ``reach`` symbols; s has values from 1 and ends with its only 0."""
    if len(s) < 2:
        return np.arange(len(s))
    size = int(s.max()) + 1
    smaller = classify(s)
    is_lms = np.zeros(len(s), bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) < 2:
        return induce(s, smaller, lms, size)
    first = induce(s, smaller, lms, size)
    first = first[is_lms[first]]  # by leftmost smaller substring
    follow = np.zeros(len(s), np.int64)
    follow[lms] = np.append(lms[1:], lms[-1])
    length = follow[first] - first
    a, b = first[1:], first[:-1]
    same = length[1:] == length[:-1]
    grams, at, live = _grams(s), 0, np.flatnonzero(same)
    while len(live):
        left = length[1:][live] + 1 - at
        bits = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % np.uint64(64))) - np.uint64(1))
        equal = ((grams[a[live] + at] ^ grams[b[live] + at]) & mask) == 0
        same[live[~equal]] = False
        live = live[equal & (left > 8)]
        at += 8
    names = np.zeros(len(s), np.int64)
    names[first] = np.concatenate([[0], np.cumsum(~same)])
    rank, step, m = names[lms], 1, len(lms)
    while rank.max() + 1 < m and step < reach:
        behind = np.concatenate([rank[step:] + 1, np.zeros(min(step, m), np.int64)])
        rank = np.unique(rank * (m + 1) + behind[:m], return_inverse=True)[1]
        step *= 2
    return induce(s, smaller, lms[np.argsort(rank, kind="stable")], size)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int):
    """(length, neighbour) per text place: what it shares with the suffix before it in the array, at most ``most``."""
    neighbour = np.full(len(text), -1, np.int64)
    neighbour[order[1:]] = order[:-1]
    grams = _grams(text)
    shared = np.zeros(len(text), np.int64)
    live = np.flatnonzero((neighbour >= 0) & (np.arange(len(text)) < len(text) - 1) & (neighbour < len(text) - 1))
    for at in range(0, most, 8):
        i, j = live + at, neighbour[live] + at
        inside = (i < len(text) - 1) & (j < len(text) - 1)
        live, i, j = live[inside], i[inside], j[inside]
        differ = grams[i] ^ grams[j]
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8)
        shared[live] += np.minimum(equal, most - at)
        live = live[differ == 0]
    return shared, neighbour


def repeated_windows(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each text the starts of its windows that occur again, in this or another text."""
    joined = np.frombuffer(b"\xff".join(texts) + b"\xff\x00", np.uint8).astype(np.int32) + 1
    joined[-1] = 0
    order = suffix_array(joined, width)
    shared, neighbour = common_prefixes(joined, order, width)
    ends = np.cumsum([len(t) + 1 for t in texts])
    valid = np.zeros(len(joined), bool)
    for end, t in zip(ends.tolist(), texts):
        valid[end - 1 - len(t) : max(end - width, end - 1 - len(t))] = True
    hit = (shared >= width) & valid
    twice = hit.copy()
    twice[neighbour[hit]] = True
    twice &= valid
    starts = ends - np.array([len(t) + 1 for t in texts])
    return [np.flatnonzero(twice[a : a + max(0, len(t) - width + 1)]) for a, t in zip(starts.tolist(), texts)]


#: kind 0: text of a run, a its anchor; 1: text of a window of a crowded anchor, a and b its hashes; 2: settled windows.
_PIECE_SCHEMA = "kind int, a long, b long, doc_id long, at int, n int, piece binary"
_PIECE_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
_PIECE_NAMES = ["kind", "a", "b", "doc_id", "at", "n", "piece"]


def _pieces(kind, a, b, doc, at, n, piece=None):
    columns = [np.full(len(a), kind), a, b, doc, at, n, piece or [None] * len(a)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES)], names=_PIECE_NAMES)


def _crowd_rows(windows, texts, width):
    """Windows of crowded anchors: two of each hash in the batch travel; further ones with equal bytes are settled."""
    a, b, doc, at, text = (np.concatenate([w[i] for w in windows]) for i in range(5))
    order = np.lexsort((at, doc, b, a))
    a, b, doc, at, text = (x[order] for x in (a, b, doc, at, text))
    first = np.flatnonzero(repeats.group_starts(a, b))
    size = np.diff(np.append(first, len(a)))
    lead = np.repeat(first, size)

    def piece(k):
        return texts[text[k]][at[k] : at[k] + width]

    done = np.zeros(len(a), bool)
    for k in np.flatnonzero(np.arange(len(a)) > lead + 1).tolist():
        done[k] = piece(k) == piece(lead[k])
    travel = np.flatnonzero(~done)
    for part in np.split(travel, range(WINDOWS, len(travel), WINDOWS)):
        yield _pieces(1, a[part], b[part], doc[part], at[part], np.ones(len(part), int), [piece(k) for k in part.tolist()])
    settled, at_settled, n_settled = repeats.merged(doc[done], at[done])
    yield _pieces(2, settled, at_settled, settled, at_settled, n_settled)


def _piece_batches(batches, width):
    """Texts of partial runs by anchor; for crowded anchors texts of their windows by hash."""
    for batch in batches:
        rows, windows, crowd = ([], [], [], []), [], []
        lists = batch.column("spans").flatten()
        anchor = lists.field("anchor").to_numpy(zero_copy_only=False)
        crowded = lists.field("crowded").to_numpy(zero_copy_only=False)
        place = 0
        texts = batch.column("text").to_pylist()
        for doc, text, (at, n) in zip(batch.column("doc_id").to_pylist(), texts, repeats.span_lists(batch, "spans")):
            data = (text or "").encode("utf-8", "surrogatepass")
            hashes = None
            for k, (i, j) in enumerate(zip(at.tolist(), n.tolist()), start=place):
                if i + j + width - 1 > len(data):
                    continue
                if not crowded[k]:
                    for column, value in zip(rows, (anchor[k], doc, i, data[i : i + j + width - 1])):
                        column.append(value)
                    continue
                if hashes is None:
                    raw = np.frombuffer(data, np.uint8)
                    crowd.append(data)
                    hashes = [window_hashes(raw, width, f).view(np.int64) for f in (_P, _Q)]
                text_no = np.full(j, len(crowd) - 1)
                windows.append((hashes[0][i : i + j], hashes[1][i : i + j], np.full(j, doc), np.arange(i, i + j), text_no))
            place += len(at)
        if rows[0]:
            a, doc, at, piece = rows
            yield _pieces(0, a, np.zeros(len(a), int), doc, at, np.zeros(len(a), int), piece)
        if windows:
            yield from _crowd_rows(windows, crowd, width)


def _span_batch(doc, at, n):
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32())], names=["doc_id", "at", "n"]
    )


def _crowded(batch, held):
    """Windows of crowded anchors that are not alone under their hash, and the last row, which the next batch may meet."""
    if held is not None:
        batch = pa.concat_batches([held, batch])
    a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
    again = ~repeats.group_starts(a, b)
    met = again | np.append(again[1:], False)
    if held is not None:  # handed out before, when it had met its like
        met[0] &= bool(again[1:2].any()) and held.column("n")[0].as_py() > 0
    now = batch.take(pa.array(np.flatnonzero(met)))
    last = batch.slice(len(a) - 1)
    return now, last.set_column(5, last.schema.field("n"), pa.array([0 if again[-1] else 1], pa.int32()))


def _shard_batches(batches, width, shard):
    """Repeated windows of a stream sorted by (kind, a, b), by shard arrays: first texts of runs, then of windows."""
    texts, size, key, held, seen = [], 0, None, None, {}

    def sorted_out():
        found = ([], [], [])
        for (doc, at, _), starts in zip(texts, repeated_windows([t for _, _, t in texts], width)):
            if len(starts):
                i, n = repeats.window_spans(starts)
                for column, values in zip(found, ([doc] * len(i), (i + at).tolist(), n.tolist())):
                    column.extend(values)
        return _span_batch(*found)

    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        runs, windows = np.searchsorted(kind, [1, 2]).tolist()
        parts = [batch.slice(0, runs)]
        if windows > runs:
            now, held = _crowded(batch.slice(runs, windows - runs), held)
            parts.append(now)
        copies = []
        for part in parts:
            for k, a, b, doc, at, _, piece in zip(*(part.column(c).to_pylist() for c in _PIECE_NAMES)):
                if (k, a, b) != key:
                    if size >= shard:
                        yield sorted_out()
                        texts, size = [], 0
                    key, seen = (k, a, b), {}
                if k == 1:
                    seen[piece] = seen.get(piece, 0) + 1
                    if seen[piece] > 2:
                        copies.append((doc, at))
                        continue
                texts.append((doc, at, piece))
                size += len(piece)
        if copies:
            doc, at = zip(*copies)
            yield _span_batch(doc, at, [1] * len(doc))
        if windows < len(kind):
            yield _span_batch(*(batch.column(c).slice(windows) for c in ("doc_id", "at", "n")))
    if texts:
        yield sorted_out()


def _finish_batches(batches, width):
    for batch in batches:
        rows = []
        texts = batch.column("text").to_pylist()
        for doc, text, (at, n) in zip(batch.column("doc_id").to_pylist(), texts, repeats.span_lists(batch, "spans")):
            data = (text or "").encode("utf-8", "surrogatepass")
            inside = at + n + width - 1 <= len(data)
            kept, removed, spans = data, 0, 0
            if inside.any():
                gone = repeats.covered(len(data), at[inside], n[inside], width)
                removed = int(gone.sum())
                spans = int((np.diff(gone.astype(np.int8)) == 1).sum() + gone[0])
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            rows.append((doc, len(data), removed, spans, kept))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int64(),) * 4 + (pa.binary(),)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def drop_repeated_bytes(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard: int = SHARD, crowd: int = CROWD
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: the remaining bytes of each document."""
    spans = repeats.decide(docs, runs_of(width, gram), everywhere=True)
    partial = spans.filter("partial")
    crowds = partial.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd)
    crowds = cut(crowds.select("anchor", F.lit(True).alias("crowded")))
    marked = partial.join(crowds, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    shards = (
        repeats.fetch(docs, repeats.per_document(marked, "anchor", "crowded"))
        .mapInArrow(lambda b: _piece_batches(b, width), _PIECE_SCHEMA)
        .repartition("kind", "a", "b")
        .sortWithinPartitions("kind", "a", "b")
        .mapInArrow(lambda b: _shard_batches(b, width, shard), "doc_id long, at int, n int")
    )
    settled = spans.filter("not partial").select("doc_id", "at", "n").unionAll(shards)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return repeats.finish(docs, settled, lambda b: _finish_batches(b, width), schema)
