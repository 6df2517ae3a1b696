"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at a time: texts can be long, so batches stay small.
ARROW_ROWS = 500


def session(spark: SparkSession) -> SparkSession:
    """Settings that the text operators need; only the Arrow batch size is touched."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where a local session names none (tests) a temporary folder is used; a cluster must name one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return named or now.get()
    if not named and sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    named = named or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: lineage ends, lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files and checkpoints of finished steps.

    The cleaner acts when the driver collects its garbage, which it seldom needs to;
    between large steps this is asked for, so that their files do not add up.
    """
    for _ in range(2):  # what Python lets go in the first round, the driver's JVM finds in the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on the parts: the first 52 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


#: Bytes of text hashed at a time.
SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.PCG64(8).random_raw(256)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def _slices(text: bytes):
    """Slices of at most about SLICE bytes that end before a white space."""
    place = 0
    while len(text) - place > SLICE:
        end = re.compile(rb"[\x20\x09-\x0D]").search(text, place + SLICE)
        if end is None:
            break
        yield text[place : end.start()]
        place = end.start()
    yield text[place:]


def _hash_slice(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word: its bytes' table values, weighted by powers of an odd base."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.flatnonzero(~_SPACE[raw])
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.ones(len(inside), bool)
    first[1:] = np.diff(inside) != 1
    at = np.flatnonzero(first)
    length = np.diff(np.append(at, len(inside)))
    powers = np.full(int(length.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    h = np.add.reduceat(table[raw[inside]] * powers[np.arange(len(inside)) - np.repeat(at, length)], at)
    h = (h ^ (h >> np.uint64(32)) ^ length.astype(np.uint64)) * _MIX
    return inside[at], h ^ (h >> np.uint64(29))


def hashed_words(texts: list[bytes | None], fold: bool) -> list[np.ndarray]:
    """For each text the hashes of its words ``[^\\x20\\x09-\\x0D]+``; ``fold`` takes A-Z as a-z."""
    table, out, group, size = _FOLDED if fold else _BYTE, [], [], 0

    def flush():
        if group:
            at, h = _hash_slice(b" ".join(group), table)
            ends = np.cumsum([len(t) + 1 for t in group])
            out.extend(np.split(h, np.searchsorted(at, ends[:-1])))
            group.clear()

    for text in texts:
        text = text or b""
        if len(text) > SLICE:
            flush()
            size = 0
            out.append(np.concatenate([_hash_slice(part, table)[1] for part in _slices(text)]))
            continue
        group.append(text)
        size += len(text)
        if size >= SLICE:
            flush()
            size = 0
    flush()
    return out


def utf8(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow text column."""
    return column.cast(pa.binary()).to_pylist()
