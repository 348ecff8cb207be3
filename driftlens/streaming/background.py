"""Moving background of a stream of frames, with the last frames of each instrument as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "instrument string, timestamp timestamp_ntz, px array<double>, bg array<double>"


def moving_background(frames: DataFrame, window: int) -> DataFrame:
    """Frames (instrument, timestamp, px) with ``bg``, the mean of the ``window`` frames before.

    The first ``window`` frames of an instrument build its state and are not returned. Frames
    of a micro-batch are taken in time order; ``ordered_background`` waits for late ones. A frame of another size than those before
    starts the state anew.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, held = state.get if state.exists else (0, b"")
        last = np.frombuffer(held, np.float64).reshape(-1, size).copy() if size else None
        out = []
        new = pd.concat(list(batches)).sort_values("timestamp", kind="stable")
        for ts, px in zip(new["timestamp"], new["px"]):
            px = np.asarray(px, np.float64)
            if last is None or last.shape[1] != len(px):
                last = np.zeros((0, len(px)))
            if len(last) == window:
                out.append((key[0], ts, px, last.mean(axis=0)))
            last = np.vstack((last, px))[-window:]
        if last is not None:
            state.update((int(last.shape[1]), last.tobytes()))
        yield pd.DataFrame(out, columns=["instrument", "timestamp", "px", "bg"])

    rows = frames.where("px IS NOT NULL").select("instrument", "timestamp", "px")
    return rows.groupBy("instrument").applyInPandasWithState(update, OUTPUT, "size int, held binary", "append", GroupStateTimeout.NoTimeout)


class OrderedBackground(StatefulProcessor):
    """Frames wait in a map state by time until the watermark has passed them; the frames before are a list state.

    A timer for each waiting time fires when no earlier frame can come any more, so frames leave in the
    order of their times, whatever order they came in. Frames of equal times leave in the order of their
    pixels' bytes. Waiting frames and the last ones are rows of the state of their own: a batch writes those that change.
    """

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, nth int", "px binary")
        self.last = handle.getListState("last", "px binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for batch in rows:
            for us, px in zip(batch["us"].tolist(), batch["px"]):
                nth = 0
                while self.waiting.containsKey((us, nth)):
                    nth += 1
                self.waiting.updateValue((us, nth), (np.asarray(px, np.float64).tobytes(),))
                if nth == 0:
                    self.handle.registerTimer(us // 1000)
        yield pd.DataFrame(columns=["instrument", "timestamp", "px", "bg"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        until = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((k[0], bytes(v[0]), k[1]) for k, v in self.waiting.iterator() if k[0] // 1000 <= until)
        last = [bytes(x[0]) for x in self.last.get()] if self.last.exists() else []
        out = []
        for us, px, nth in due:
            if last and len(last[0]) != len(px):
                last = []
            if len(last) == self.window:
                bg = np.mean([np.frombuffer(x, np.float64) for x in last], axis=0)
                out.append((key[0], pd.Timestamp(us, unit="us"), np.frombuffer(px, np.float64), bg))
            last = (last + [px])[-self.window :]
            self.waiting.removeKey((us, nth))
        if due:
            self.last.put([(x,) for x in last])
        yield pd.DataFrame(out, columns=["instrument", "timestamp", "px", "bg"])

    def close(self) -> None:
        pass


def ordered_background(frames: DataFrame, window: int, delay: str = "10 seconds") -> DataFrame:
    """``moving_background`` in the order of times over all micro-batches.

    A frame may come up to ``delay`` of event time after the latest one; a later one is dropped. The last frames of a
    stream leave when frames of later times come. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``). Frames without pixels or time are passed over.
    """
    rows = frames.where("px IS NOT NULL AND timestamp IS NOT NULL").select("instrument", F.col("timestamp").cast("timestamp").alias("at"), "px").withWatermark("at", delay)
    rows = rows.select("instrument", "at", "px", F.unix_micros("at").alias("us"))
    return rows.groupBy("instrument").transformWithStateInPandas(OrderedBackground(window), OUTPUT, "Append", "EventTime")
