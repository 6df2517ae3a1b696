"""Substring dedup by recompression: words covered by a window that also starts in a smaller document go.

Recompression turns a word sequence into ever longer symbols. A round first replaces
each run of one symbol by a name for (symbol, count), then splits the alphabet in two
halves and replaces each pair (left half, right half) by a name for the pair. Names and
halves come from hashes of what is named, so all documents agree on them in every round
without exchanging tables, and equal substrings get equal symbols in their interior.
Each symbol keeps the span of words that decided it; a window uses only symbols whose
deciding span lies inside it. Of its highest such symbols the one for most words, then
the one with the smallest name, is its anchor.

Runs of windows with one anchor are shuffled by it (see repeats.py). Equal run contents
settle all documents but the first; runs that share an anchor and differ are verified
window by window: window hashes, in a second shuffle, keep their smallest document.

Words, symbols and windows are compared by hashes of 64 bits (names) and 128 bits
(windows; a run's anchor and content hash together have 128).

Defined results: a null, empty or blank text has no words; documents under ``width``
words keep everything; rows with a null doc_id keep everything; rows that repeat a
doc_id are parts of one document, each judged with the windows removed from any of
them; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm import repeats

WIDTH = 50
ROUNDS = 4

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FAR = 1 << 40


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _name(level: int, kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    salt = np.uint64((4 * level + kind + 1) * int(_A) % 2**64)
    return _mix(_mix(a + salt) * _A + b)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def recompress(words: np.ndarray, rounds: int = ROUNDS):
    """(rank, first, last) of every level: the order of its symbols, and the span of words that decided each.

    Symbols for more words rank lower, then those with smaller names: long ones are rare.
    """
    symbols, first, last = _mix(words), np.arange(len(words)), np.arange(len(words))
    held = np.ones(len(words), np.int64)  # words in each symbol
    levels = [(symbols >> np.uint64(6), first, last)]
    for level in range(rounds):
        starts = np.flatnonzero(repeats.group_starts(symbols))
        counts = np.diff(np.append(starts, len(symbols)))
        ends = starts + counts - 1
        held = np.add.reduceat(held, starts)
        run = symbols[starts]
        symbols = np.where(counts > 1, _name(level, 1, run, counts.astype(np.uint64)), run)
        first = np.where(starts > 0, first[starts - 1], -_FAR)
        last = np.where(ends + 1 < len(last), last[np.minimum(ends + 1, len(last) - 1)], _FAR)

        left = (_name(level, 2, symbols, symbols) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(symbols), bool)
        pair[:-1] = left[:-1] & ~left[1:]
        second = np.zeros(len(symbols), bool)
        second[1:] = pair[:-1]
        after, before = np.append(last[1:], _FAR), np.append(-_FAR, first[:-1])
        named = _name(level, 3, symbols, np.append(symbols[1:], np.uint64(0)))
        symbols = np.where(pair, named, symbols)
        held = np.where(pair, held + np.append(held[1:], 0), held)[~second]
        new_first = np.where(left, first, before)
        new_last = np.where(left, after, last)
        symbols, first, last = symbols[~second], new_first[~second], new_last[~second]
        short = np.uint64(63) - np.minimum(held, 63).astype(np.uint64)
        levels.append((short << np.uint64(58) | symbols >> np.uint64(6), first, last))
    return levels


def anchors(words: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS) -> np.ndarray:
    """The anchor of each window of ``width`` words."""
    n = len(words) - width + 1
    out, open_ = np.zeros(n, np.uint64), np.arange(n)
    for rank, first, last in reversed(recompress(words, rounds)):
        if not len(open_):
            break
        lo = np.searchsorted(first, open_, "left")
        hi = np.searchsorted(last, open_ + width - 1, "right")
        some = lo < hi
        at, lo, hi = open_[some], lo[some], hi[some]
        if len(at):
            depth = np.frexp((hi - lo).astype(np.float64))[1] - 1
            table, low = rank, np.zeros(len(at), np.uint64)
            for d in range(int(depth.max()) + 1):
                if d:
                    half = 1 << (d - 1)
                    table = np.minimum(table[: len(table) - half], table[half:])
                here = depth == d
                low[here] = np.minimum(table[lo[here]], table[hi[here] - (1 << d)])
            out[at] = low
        open_ = open_[~some]
    return out


def runs_of(width: int = WIDTH, rounds: int = ROUNDS):
    def of(text: str):
        words = words_of(text)
        if len(words) < width:
            return (np.zeros(0, np.int64),) * 5
        hashes = word_hashes(words)
        found = anchors(hashes, width, rounds)
        at = np.flatnonzero(repeats.group_starts(found))
        n = np.diff(np.append(at, len(found)))
        raw = hashes.tobytes()
        content = [xxhash.xxh3_64_intdigest(raw[8 * a : 8 * (a + k + width - 1)]) for a, k in zip(at.tolist(), n.tolist())]
        return found[at].view(np.int64), np.array(content, np.uint64).view(np.int64), at, n, np.zeros(len(at), bool)

    return of


def _window_batches(batches, width):
    """(settled, hash_a, hash_b, doc_id, at, n) of the windows of the partial runs.

    Windows that a smaller document of the batch has too are settled here, as stretches.
    """
    for batch in batches:
        parts = []
        for doc, text, (at, n) in zip(
            batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), repeats.span_lists(batch, "spans")
        ):
            hashes = word_hashes(words_of(text))
            at, n = at[at + n + width - 1 <= len(hashes)], n[at + n + width - 1 <= len(hashes)]
            if not len(at):
                continue
            places = np.unique(np.concatenate([np.arange(a, a + k) for a, k in zip(at, n)]))
            a = b = hashes
            size = 1
            while 2 * size <= width:  # doubling, then the last part overlaps
                a = _mix(a[: len(a) - size] * _A + a[size:])
                b = _mix(b[: len(b) - size] * _C + _mix(b[size:]))
                size *= 2
            rest = width - size
            if rest:
                a = _mix(a[: len(a) - rest] * _A + a[rest:])
                b = _mix(b[: len(b) - rest] * _C + _mix(b[rest:]))
            parts.append((a[places], b[places], np.full(len(places), doc, np.int64), places))
        if not parts:
            continue
        a, b, doc, at = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((at, doc, b, a))
        a, b, doc, at = a[order], b[order], doc[order], at[order]
        first = repeats.group_starts(a, b)
        later = doc > doc[first][np.cumsum(first) - 1]
        done, at_done, n_done = repeats.merged(doc[later], at[later])
        open_ = ~later
        size = int(open_.sum())
        columns = [
            np.concatenate([np.zeros(size, bool), np.ones(len(done), bool)]),
            np.concatenate([a[open_].view(np.int64), done]),
            np.concatenate([b[open_].view(np.int64), at_done]),
            np.concatenate([doc[open_], done]),
            np.concatenate([at[open_], at_done]).astype(np.int32),
            np.concatenate([np.ones(size, np.int64), n_done]).astype(np.int32),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["settled", "a", "b", "doc_id", "at", "n"])


def _later_windows(batches):
    """Windows of a sorted stream that started in a smaller document, as (doc_id, at, n)."""
    key = None
    for batch in batches:
        settled, a, b, doc, at, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        if not len(a):
            continue
        first = repeats.group_starts(settled, a, b)
        if key is not None and (settled[0], a[0], b[0]) == key[:3]:
            first[0] = False
        low = np.where(first, doc, np.int64(0))
        group = np.cumsum(first)
        lows = np.concatenate([[key[3] if key else 0], doc[first]])
        low = lows[group]
        pick = settled | (doc > low)
        key = (settled[-1], a[-1], b[-1], low[-1])
        if pick.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[pick]), pa.array(at[pick]), pa.array(n[pick])],
                names=["doc_id", "at", "n"],
            )


def _finish_batches(batches, width):
    for batch in batches:
        rows = []
        for doc, text, (at, n) in zip(
            batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), repeats.span_lists(batch, "spans")
        ):
            words, removed = words_of(text), 0
            total = len(words)
            inside = at + n + width - 1 <= total
            if inside.any():
                gone = repeats.covered(total, at[inside], n[inside], width)
                removed = int(gone.sum())
                words = list(compress(words, (~gone).tolist()))
            rows.append((doc, total, removed, b" ".join(words)))
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def drop_repeated_windows(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the remaining words joined by one space, as UTF-8 bytes."""
    spans = repeats.decide(docs, runs_of(width, rounds), everywhere=False)
    partial = repeats.per_document(spans.filter("partial"))
    windows = (
        repeats.fetch(docs, partial)
        .mapInArrow(lambda b: _window_batches(b, width), "settled boolean, a long, b long, doc_id long, at int, n int")
        .repartition("a")
        .sortWithinPartitions("settled", "a", "b", "doc_id", "at")
        .mapInArrow(_later_windows, "doc_id long, at int, n int")
    )
    settled = spans.filter("not partial").select("doc_id", "at", "n").unionAll(windows)
    return repeats.finish(docs, settled, lambda b: _finish_batches(b, width), "doc_id long, n_words long, n_removed long, kept binary")
