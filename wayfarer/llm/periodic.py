"""Periodic runs of words: scale-tiled search, fragments stitched by document and period.

A run of period q is a stretch of words that equal those q places on, at least
``max(LEAST, REPEATS * q)`` words long, with no smaller period, and not extendable.

1. A document is exploded into overlapping tiles per octave of periods, [2^k, 2^(k+1)).
   Octaves up to ``SMALL`` share tiles of ``TILE`` words; each further octave has tiles
   of 24 * 2^k words. Neighbours overlap by 8 * 2^k words, four times the largest period.
   Tiles of texts over ``LONG_BYTES`` are dealt over the cluster; others are solved
   where their text is read, so that texts are not shuffled for the search.
2. A tile is solved by itself. Boundaries lie 2^k apart; the Z-function of a boundary c at
   q is the number of words from c on that equal those from c + q on. It reaches 2^k where
   the named windows of 2^k words at c and c + q are equal, which is one comparison per
   place and octave. Such boundaries in a row are one stretch, and the Z-functions of its
   outer boundaries, taken to the right and on the reversed left part by windows of
   falling length, give its ends. Stretches inside one of a smaller period are multiples.
3. Fragments (document, period, start, end) are shuffled by document and period; those that
   overlap by a period at least belong together. A run of four periods reaches three
   periods into a tile or lies wholly in the next one, so no run is lost at a seam.
4. Runs join the texts; each run's words are compared there, and a document in which
   two different words share a 64-bit hash is solved anew with exact word numbers.

Memory: a tile of the largest octave can be the whole document, at about 80 bytes a word.

Defined results: a null text has no words; an empty table gives an empty result; rows that
repeat get a row each; rows with a null doc_id are searched like others and are never
rewritten. Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm.common import cut, hashed_words, utf8

LEAST, REPEATS = 6, 4
#: Words of a tile without its overlap, and the largest octave that these tiles serve.
TILE, SMALL = 16_384, 9
#: Texts with more bytes have their tiles dealt over the cluster.
LONG_BYTES = 1 << 20
#: Words handed to the solver at a time, unless one tile has more.
BATCH_WORDS = 300_000

#: For a document's id and number of words the places that its words are taken from, or None.
Rewrite = Callable[[int | None, int], "np.ndarray | None"]

TILE_SCHEMA = "key string, at long, first int, last int, words binary"
FRAGMENT_SCHEMA = "key string, period long, start long, end long"
RUN_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """The rewriting of every tenth document (by its id's crc32): from word a on it repeats with period p."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def tile_places(n: int, tile: int = TILE, small: int = SMALL):
    """(at, end, first octave, last octave) of the tiles of a document of n words."""
    top = (n // REPEATS).bit_length() - 1  # periods up to n / REPEATS
    if top < 0:
        return
    both = tile + (8 << small)
    if n <= both:
        yield 0, n, 0, top
        return
    for k in range(min(small, top), top + 1):
        shared = k == min(small, top)
        step, over = (tile if shared else 16 << k), 8 << k
        for at in range(0, max(1, n - over), step):
            yield at, min(n, at + step + over), (0 if shared else k), k


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of windows from those of their halves."""
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _matching(levels, i, j, stop, back: bool) -> np.ndarray:
    """How far words from i and j on (or, going back, before them) are equal, without passing ``stop``."""
    n = np.zeros(len(i), np.int64)
    for size, names in reversed(levels):
        live = np.arange(len(i))
        while len(live):
            a, b = (i[live] - n[live] - size, j[live] - n[live] - size) if back else (i[live] + n[live], j[live] + n[live])
            ok = a >= stop[live] if back else b + size <= stop[live]
            live, a, b = live[ok], a[ok], b[ok]
            live = live[names[a] == names[b]]
            n[live] += size
    return n


def solve(words: np.ndarray, ends: np.ndarray, first: int, last: int):
    """Fragments (tile, period, start, end) of tiles laid end to end; places count from the tile's start.

    Those that touch neither end of their tile are whole runs; the others may be parts of longer ones.
    """
    starts = np.r_[0, ends[:-1]]
    names, levels, reach, found = words, [], np.zeros(len(words), np.int64), []
    for k in range(last + 1):
        b = 1 << k
        if k:
            if len(names) <= b // 2:
                break
            names = _joined(names[: -(b // 2)], names[b // 2 :])
        if k % 4 == 0:
            levels.append((b, names))
        if k < first:
            continue
        blocks = -(-len(names) // b)
        square = np.zeros(blocks * b, np.uint64)
        square[: len(names)] = names
        square = square.reshape(blocks, b)
        c, more = np.nonzero(square[1:] == square[:-1, :1])
        c, q = c.astype(np.int64) * b, more.astype(np.int64) + b
        tile = np.searchsorted(ends, c, "right")
        ok = c + q + b <= ends[tile]
        c, q, tile = c[ok], q[ok], tile[ok]
        if not len(c):
            continue
        order = np.lexsort((c, q))
        c, q, tile = c[order], q[order], tile[order]
        head = np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1] + b) | (tile[1:] != tile[:-1])]
        tail = np.r_[head[1:], True]
        c0, c1, q, tile = c[head], c[tail] + b, q[head], tile[head]
        known = np.maximum.accumulate(reach)[c0] >= c1 + q
        c0, c1, q, tile = c0[~known], c1[~known], q[~known], tile[~known]
        low, high = starts[tile], ends[tile]
        start = c0 - _matching(levels, c0, c0 + q, low, True)
        end = c1 + q + _matching(levels, c1, c1 + q, high, False)
        periodic = end - start >= 2 * q
        np.maximum.at(reach, start[periodic], end[periodic])
        edge = periodic & ((start == low) | (end == high))
        keep = np.flatnonzero(edge | (end - start >= np.maximum(LEAST, REPEATS * q)))
        seen = set()
        for t, p, s, e in zip(tile[keep].tolist(), q[keep].tolist(), start[keep].tolist(), end[keep].tolist()):
            if (p, s, e) not in seen and not _multiple(words, p, s):
                seen.add((p, s, e))
                found.append((t, p, s - int(starts[t]), e - int(starts[t])))
    return found


def _multiple(words: np.ndarray, period: int, start: int) -> bool:
    """Whether a stretch of this period has a smaller one: then period / f is one for a prime f."""
    rest, f = period, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            d = period // f
            if np.array_equal(words[start : start + period], words[start + d : start + d + period]):
                return True
            while rest % f == 0:
                rest //= f
        f += 1
    return False


def solved(tiles) -> list[tuple]:
    """(key, period, start, end) of (key, at, first, last, words) tiles; tiles of like length go together."""
    groups: dict[tuple[int, int, int], list] = {}
    for t in tiles:
        groups.setdefault((len(t[4]).bit_length(), t[2], t[3]), []).append(t)
    out = []
    for (_, first, last), group in groups.items():
        found = solve(np.concatenate([t[4] for t in group]), np.cumsum([len(t[4]) for t in group]), first, last)
        out += [(group[t][0], p, group[t][1] + s, group[t][1] + e) for t, p, s, e in found]
    return out


def stitched(fragments: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one document from (period, start, end), in plain Python."""
    out = []
    for period, start, end in sorted(set(fragments)):
        if out and out[-1][0] == period and out[-1][2] - start >= period:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([period, start, end])
    return sorted((s, e - s, p) for p, s, e in out if e - s >= max(LEAST, REPEATS * p))


def exact_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one document, its words numbered exactly."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    tiles = [("", at, first, last, ids[at:end]) for at, end, first, last in tile_places(len(ids))]
    return stitched([f[1:] for f in solved(tiles)])


def _tiles(batch, rewrite: Rewrite | None, tile: int):
    texts = utf8(batch.column("text"))
    for key, doc_id, words in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), hashed_words(texts, False)):
        places = rewrite(doc_id, len(words)) if rewrite else None
        words = words if places is None else words[places]
        for at, end, first, last in tile_places(len(words), tile):
            yield key, at, first, last, words[at:end]


def _in_groups(tiles):
    held, size = [], 0
    for t in tiles:
        held.append(t)
        size += len(t[4])
        if size >= BATCH_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _fragment_batch(found):
    columns = list(zip(*found)) or [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["key", "period", "start", "end"]
    )


def fragments(texts: DataFrame, rewrite: Rewrite | None = None, tile: int = TILE, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(key, period, start, end) of all tiles of ``texts`` (key, doc_id, text)."""

    def explode(batches):
        for batch in batches:
            for held in _in_groups(_tiles(batch, rewrite, tile)):
                keys, at, first, last, words = zip(*held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(at, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32()),
                     pa.array([w.tobytes() for w in words], pa.binary())],
                    names=["key", "at", "first", "last", "words"],
                )

    def solve_dealt(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "at", "first", "last", "words")))
            for held in _in_groups((k, at, f, t, np.frombuffer(w, np.uint64)) for k, at, f, t, w in rows):
                yield _fragment_batch(solved(held))

    def solve_here(batches):
        for batch in batches:
            for held in _in_groups(_tiles(batch, rewrite, tile)):
                yield _fragment_batch(solved(held))

    is_long = F.octet_length("text") > long_bytes
    dealt = texts.filter(is_long).mapInArrow(explode, TILE_SCHEMA).repartition("key", "at", "last")
    short = texts.filter(~is_long)  # a null text has no tiles
    return short.mapInArrow(solve_here, FRAGMENT_SCHEMA).unionAll(dealt.mapInArrow(solve_dealt, FRAGMENT_SCHEMA))


def stitch(found: DataFrame) -> DataFrame:
    """(key, start, length, period): fragments of a document and period that overlap by a period are one run."""
    each = found.groupBy("key", "period", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("key", "period").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key", "period").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end").over(before)
    fresh = F.when(reach - F.col("start") >= F.col("period"), 0).otherwise(1)
    numbered = each.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(upto))
    runs = numbered.groupBy("key", "period", "island").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    return runs.filter(F.col("length") >= F.greatest(F.lit(LEAST), REPEATS * F.col("period"))).select("key", "start", "length", "period")


def keyed(docs: DataFrame) -> DataFrame:
    """key, doc_id, text; rows of one key are alike."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    key = F.md5(F.concat_ws(":", doc_id.cast("string"), F.lit(""), text))
    return docs.select(key.alias("key"), doc_id.alias("doc_id"), text.alias("text"))


def described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, the longest run, and digests of all runs and of the words outside their repetitions."""
    if any(words[s : s + n - q] != words[s + q : s + n] for s, n, q in runs):
        runs = exact_runs(words)  # two words share a hash
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    kept = np.ones(len(words), bool)
    for s, n, q in runs:
        kept[s + q : s + n] = False
    left = words if kept.all() else [words[i] for i in np.flatnonzero(kept)]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    digests = hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()
    if not runs:
        return 0, None, None, None, None, *digests
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    return len(runs), s, n, q, 1000 * n // q, *digests


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None, tile: int = TILE, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    texts = keyed(docs)
    runs = cut(stitch(fragments(texts, rewrite, tile, long_bytes)))
    lists = runs.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))

    def describe(batches):
        for batch in batches:
            out = []
            for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("runs").to_pylist()):
                words = (text or b"").split()
                places = rewrite(doc_id, len(words)) if rewrite else None
                words = words if places is None else [words[i] for i in places.tolist()]
                out.append((doc_id, *described(words, [(r["start"], r["length"], r["period"]) for r in found or ()])))
            columns = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:6]), *(pa.array(c, pa.string()) for c in columns[6:])],
                names=[c.split(" ")[0] for c in RUN_SCHEMA.split(", ")],
            )

    return texts.join(lists, "key", "left").select("doc_id", "text", "runs").mapInArrow(describe, RUN_SCHEMA)
