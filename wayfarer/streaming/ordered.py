"""State machines on streams: rows wait until the watermark has passed them and then go in time order.

A batch has all rows of a key and Spark sorts them. A stream gets them in any order over many
triggers. ``ordered_stream`` keeps the rows of a key in its state until the watermark is past their
time, so that the machine sees the same order as in a batch; rows that come after the
watermark has passed their time are late and are dropped. A key that
has no row for longer than its lifetime is forgotten: its next row meets the machine's start.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

Machine = Callable[[tuple, pd.DataFrame], tuple[tuple, list[tuple]]]

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: No time.
NEVER = 2**62


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and several state variables of a key need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _millis(times: pd.Series) -> pd.Series:
    return pd.to_datetime(times).astype("datetime64[us]").astype("int64") // 1000


def _packed(pdf: pd.DataFrame) -> bytes:
    """Rows as one value of the state: their columns, pickled."""
    return pickle.dumps([pdf[c].to_numpy() for c in pdf.columns], pickle.HIGHEST_PROTOCOL)


def _unpacked(packs: list[bytes], names: list[str]) -> pd.DataFrame:
    columns = zip(*map(pickle.loads, packs))
    return pd.DataFrame({c: np.concatenate(parts) if len(parts) > 1 else parts[0] for c, parts in zip(names, columns)})


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark is past them; then runs the machine over them in time order.

    A trigger's rows of a key are one value of the state, and each call reads and writes a key's clock once.
    """

    def __init__(self, machine: Machine, start: tuple, state: StructType, rows: list[str], out: list[str], order: list[str], lifetime_ms: int):
        self.machine, self.start, self.state_type, self.rows = machine, start, state, rows
        self.out, self.order, self.lifetime_ms = out, order, lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine_state = handle.getValueState("machine", self.state_type)
        self.waiting = handle.getListState("waiting", "rows binary")
        self.clock = handle.getValueState("clock", "timer long, last long, waits boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        old, last, waits = self.clock.get() or (NEVER, NEVER, False)
        packs, timer = [], old if waits else NEVER
        for pdf in rows:
            at = _millis(pdf[self.order[0]]).to_numpy()
            if at.min() < mark:
                pdf, at = pdf[at >= mark], at[at >= mark]
            if len(at):
                packs.append((_packed(pdf[self.rows]),))
                timer = min(timer, int(at.min()))
        if packs:
            self.waiting.appendList(packs)
            if timer != old:
                if old != NEVER:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(timer)
            if timer != old or not waits:
                self.clock.update((timer, last, True))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        _, last, waits = self.clock.get()
        if not waits:  # the lifetime is over
            self.clock.clear()
            self.machine_state.clear()
            return
        held = _unpacked([r for (r,) in self.waiting.get()], self.rows)
        at = _millis(held[self.order[0]])
        whole = at.max() < mark
        ready = (held if whole else held[at < mark]).sort_values(self.order, kind="stable")
        if len(ready):
            times = _millis(ready[self.order[0]]).to_numpy()
            gaps = np.diff(times, prepend=times[0] if last == NEVER else last) > self.lifetime_ms
            ends = [0, *(np.flatnonzero(gaps[1:]) + 1), len(ready)]
            state = None if gaps[0] else self.machine_state.get()
            for i, j in zip(ends, ends[1:]):
                state, out = self.machine(self.start if i or state is None else tuple(state), ready.iloc[i:j])
                if out:
                    yield pd.DataFrame(out, columns=self.out)
            self.machine_state.update(state)
            last = int(times[-1])
        self.waiting.clear()
        if whole:
            timer = last + self.lifetime_ms
        else:
            rest = at >= mark
            self.waiting.appendValue((_packed(held[rest]),))
            timer = int(at[rest].min())
        self.handle.registerTimer(timer)
        self.clock.update((timer, last, not whole))

    def close(self) -> None:
        pass


def ordered_stream(
    rows: DataFrame, machine: Machine, start: tuple, state_schema: str, out_schema: str, key: str = "user_id", ts: str = "ts", lifetime_ms: int = 86_400_000
) -> DataFrame:
    """The machine's output for a stream with a watermark on ``ts``, in the order (ts, ids) that a batch has."""
    use_rocksdb(rows.sparkSession)
    ids = [c for c in rows.columns if c.endswith("_id") and c != key]
    out = StructType.fromDDL(out_schema)
    machine_of = InOrder(machine, start, StructType.fromDDL(state_schema), rows.columns, out.names, [ts, *ids], lifetime_ms)
    return rows.groupBy(key).transformWithStateInPandas(machine_of, out, "Append", "EventTime")
