"""The tree transform of an endless recording with event time: missing blocks close as zeros, late ones are counted, idle recordings are forgotten.

A block is a row (obs, block, ts, x array<array<float>>), all channels of
`length` samples. Blocks may come in any order. One that is missing holds up
those behind it until the watermark passes the time of the earliest of these:
then it counts as zeros. A block that comes after that, or twice, is not
transformed, but counted: by Spark if its time is behind the watermark
(late_rows), else in the column `late`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from ..operators.blocks import channel_means, run_levels
from ..plans.tree import TreePlan

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "obs string, block long, filled boolean, late long, i_dt int, dt int, v array<double>"


class Blocks(StatefulProcessor):
    """State of a recording: the next block's number, the samples before it, its latest time and how many came late; and a list of blocks that came early."""

    def __init__(self, plan: TreePlan, length: int, idle_ms: int, first: int):
        self.plan, self.length, self.idle, self.first = plan, length, idle_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", StructType().add("at", LongType()).add("width", IntegerType()).add("past", BinaryType()).add("latest", LongType()).add("late", LongType()))
        self.early = handle.getListState("early", StructType().add("block", LongType()).add("ms", LongType()).add("x", BinaryType()))

    def _state(self) -> tuple:
        at, width, past, latest, late = self.told.get() if self.told.exists() else (self.first, 0, b"", 0, 0)
        nchans = self.plan.geometry.nchans
        return at, np.frombuffer(bytes(past), np.float64).reshape(nchans, width) if width else np.zeros((nchans, 0), np.float64), latest, late

    def _emit(self, obs: str, block: int, x: np.ndarray, past: np.ndarray, filled: bool, late: int) -> tuple[list[Row], np.ndarray]:
        m = np.concatenate([past, x], axis=1)
        v = run_levels(channel_means(m, self.plan), self.plan)[:, m.shape[1] - x.shape[1] :]
        rows = [Row(obs=obs, block=block, filled=filled, late=late, i_dt=i, dt=int(dt), v=r.tolist()) for i, (dt, r) in enumerate(zip(self.plan.dt_grid, v))]
        return rows, m[:, max(0, m.shape[1] - self.plan.halo()) :]

    def _drain(self, obs: str, waiting: dict, watermark: int) -> Iterator[Row]:
        """Transforms what is next, and zeros in place of what the watermark says won't come; keeps the rest and sets its timer."""
        at, past, latest, late = self._state()
        nchans = self.plan.geometry.nchans
        while waiting and (at in waiting or min(ms for ms, _ in waiting.values()) <= watermark):
            filled = at not in waiting
            x = np.zeros((nchans, self.length), np.float64) if filled else np.frombuffer(bytes(waiting.pop(at)[1]), np.float64).reshape(nchans, -1)
            rows, past = self._emit(obs, at, x, past, filled, late)
            yield from rows
            at += 1
        self.told.update((at, past.shape[1], np.ascontiguousarray(past).tobytes(), latest, late))
        self.early.put([(b, ms, x) for b, (ms, x) in sorted(waiting.items())]) if waiting else self.early.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(watermark + 1, min(ms for ms, _ in waiting.values()) if waiting else latest + self.idle))

    def _waiting(self) -> dict:
        return {b: (ms, x) for b, ms, x in self.early.get()} if self.early.exists() else {}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, past, latest, late = self._state()
        waiting = self._waiting()
        for r in rows:
            ms = int(r.ts.timestamp() * 1000)
            latest = max(latest, ms)
            if r.block < at:
                late += 1
            else:
                waiting.setdefault(r.block, (ms, np.array(r.x, dtype=np.float64).tobytes()))
        self.told.update((at, past.shape[1], np.ascontiguousarray(past).tobytes(), latest, late))
        yield from self._drain(key[0], waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waiting, watermark = self._waiting(), timerValues.getCurrentWatermarkInMs()
        if waiting:
            yield from self._drain(key[0], waiting, watermark)
        elif self.told.exists() and self._state()[2] + self.idle <= watermark:  # the recording is over
            self.told.clear()
            self.early.clear()

    def close(self) -> None:
        pass


def tree_stream(blocks: DataFrame, plan: TreePlan, length: int, delay: str = "1 hour", idle: int = 86_400_000, first: int = 0) -> DataFrame:
    """obs, block, filled, late, i_dt, dt, v of a stream of (obs string, block long, ts timestamp, x array<array<float>>).

    delay: how far the watermark stays behind the latest time. idle:
    milliseconds after its latest block at which a recording's state goes; what
    comes then begins again at block `first`. late: blocks of the recording that
    had come late, or twice, when the row was made. Needs RocksDB as the state
    store (spark.sql.streaming.stateStore.providerClass).
    """
    s = blocks.select("obs", "block", "ts", "x").withWatermark("ts", delay)
    return s.groupBy("obs").transformWithState(Blocks(plan, length, idle, first), OUT, "append", "eventTime")


def late_rows(query) -> int:
    """Blocks that a running or ended query has dropped because their time was behind the watermark (of its last 100 progress reports)."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
