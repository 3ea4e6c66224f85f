"""Structured Streaming over frames: running histograms with late data bounded, per-clip frame differences, and clips
coded as their frames come."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rasterloom.operators import codec, motion

DIFFERENCES = "media_id string, frame_no int, changed long, cost long, missing int"
CODED = "media_id string, part int, frame_no int, restart boolean, payload binary"


def histograms(samples: DataFrame, time: str, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Counts of sample values per media and tumbling window of a timestamp column; later data than `late` are dropped."""
    return samples.withWatermark(time, late).groupBy("media_id", F.window(time, width), "v").agg(F.count("*").alias("n"))


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State with timers and maps needs this store; it keeps state beside the heap and checkpoints changes only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _InOrder(StatefulProcessor):
    """Frames of a key in order: each is taken once the one before it is there.

    State: the number of the next frame and whatever step() keeps, early frames one by one in a map (not in one value),
    and, if there is a wait (milliseconds of processing time), a timer while any is early. When it fires, missing frames
    are given up and the earliest that waits goes on, as after nothing. Repeated and late frames are ignored.
    """

    def __init__(self, wait: int | None):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", T.StructType([T.StructField("frame_no", T.IntegerType()), T.StructField("kept", T.BinaryType())]))
        self.early = handle.getMapState("early", T.StructType([T.StructField("frame_no", T.IntegerType())]), T.StructType([T.StructField("planes", T.BinaryType())]))

    def first(self, key: tuple) -> int:
        return 0

    def step(self, key: tuple, frame_no: int, planes: list[np.ndarray], kept: object, missing: int) -> tuple[list[tuple], object, bool]:
        """Rows for a frame, what to keep, and whether it was the key's last. kept: None after nothing."""
        raise NotImplementedError

    def frame(self, rows: pd.DataFrame) -> Iterator[tuple[int, list[np.ndarray]]]:
        for row in rows.itertuples():
            yield row.frame_no, [np.frombuffer(p["data"], np.uint8).reshape(p["height"], p["width"]) for p in row.planes]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.next.get()
        at, kept = (state[0], state[1]) if state is not None else (self.first(key), None)
        fresh: dict[int, bytes] = {}
        for part in rows:
            for k, planes in self.frame(part):
                if k >= at and k not in fresh:
                    fresh[k] = pickle.dumps(planes)
        yield from self._go(key, at, kept, fresh, 0, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = sorted(k[0] for k in self.early.keys())
        if not waiting:
            return
        state = self.next.get()
        at = state[0] if state is not None else self.first(key)
        yield from self._go(key, waiting[0], None, {}, waiting[0] - at, timerValues)

    def _go(self, key: tuple, at: int, kept: bytes | None, fresh: dict[int, bytes], missing: int, timerValues) -> Iterator[pd.DataFrame]:
        begun, memory, done, out = at, pickle.loads(kept) if kept is not None else None, False, []
        while not done:
            if at in fresh:
                planes = fresh.pop(at)
            elif self.early.containsKey((at,)):
                planes = self.early.getValue((at,))[0]
                self.early.removeKey((at,))
            else:
                break
            rows, memory, done = self.step(key, at, pickle.loads(planes), memory, missing)
            out += rows
            at, missing = at + 1, 0
        for k, planes in fresh.items():
            if k > at and not done and not self.early.containsKey((k,)):
                self.early.updateValue((k,), (planes,))
        for old in list(self.handle.listTimers()) if self.wait else ():
            self.handle.deleteTimer(old)
        if self.wait and not done and any(True for _ in self.early.keys()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        if at != begun or done:
            self.next.update((at, b"" if done else pickle.dumps(memory)))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class _Differences(_InOrder):
    columns = ["media_id", "frame_no", "changed", "cost", "missing"]

    def step(self, key, frame_no, planes, kept, missing):
        now = planes[0]
        if kept is None:
            return ([(key[0], frame_no, None, None, missing)] if missing else []), now, False
        return [(key[0], frame_no, int((now != kept).sum()), int(motion.cost(now, kept).sum()), missing)], now, False


class _Coding(_InOrder):
    columns = ["media_id", "part", "frame_no", "restart", "payload"]

    def __init__(self, wait: int | None, group_frames: int):
        super().__init__(wait)
        self.group_frames = group_frames

    def first(self, key):
        return key[1] * self.group_frames

    def step(self, key, frame_no, planes, kept, missing):
        coder = kept if kept is not None else codec.FrameCoder()
        row = (key[0], key[1], frame_no, kept is None, coder.encode(planes))
        return [row], coder, frame_no + 1 == (key[1] + 1) * self.group_frames


def differences(planes: DataFrame, wait: int | None = None) -> DataFrame:
    """For each frame of a stream of first planes, how many samples changed since the frame before, and their cost.

    Frames may come in any order across batches; each is reported once its predecessor is there. Frame 0 starts a clip;
    repeated frames are ignored. With a wait, a frame that doesn't come within so many milliseconds is given up: the next
    one that is there has a row with `missing` frames before it and no difference; such a query's batches go on by the
    clock. Without, frames wait for good.
    """
    keep_state_in_rocksdb(planes.sparkSession)
    rows = planes.where("plane_no = 0").select("media_id", "frame_no", F.array(F.struct("width", "height", "data")).alias("planes"))
    return rows.groupBy("media_id").transformWithStateInPandas(statefulProcessor=_Differences(wait), outputStructType=DIFFERENCES, outputMode="Append", timeMode="ProcessingTime" if wait else "None")


def coded(frames: DataFrame, wait: int | None = None, group_frames: int = codec.GROUP_FRAMES) -> DataFrame:
    """A stream of frames (media_id, frame_no, planes: array of width, height, data), coded as they come.

    (media_id, part, frame_no, restart, payload): a part is a run of group_frames frames, modelled from nothing by a
    FrameCoder in its state, so clips and their parts spread over tasks; a part's state is dropped with its last frame.
    restart: a frame coded after nothing, a part's first or the first after frames that were given up (see differences).
    """
    keep_state_in_rocksdb(frames.sparkSession)
    rows = frames.select("media_id", F.expr(f"CAST(frame_no div {group_frames} AS INT)").alias("part"), "frame_no", "planes")
    return rows.groupBy("media_id", "part").transformWithStateInPandas(statefulProcessor=_Coding(wait, group_frames), outputStructType=CODED, outputMode="Append", timeMode="ProcessingTime" if wait else "None")


def decoded(rows: DataFrame) -> DataFrame:
    """Packed planes of coded() rows, a part in a task."""

    def read(key: tuple, table: pa.Table) -> pa.Table:
        found, coder = [], None
        for r in sorted(table.to_pylist(), key=lambda r: r["frame_no"]):
            coder = codec.FrameCoder() if r["restart"] or coder is None else coder
            found += [(r["media_id"], r["frame_no"], p, plane.shape[1], plane.shape[0], plane.tobytes()) for p, plane in enumerate(coder.decode(r["payload"]))]
        kinds = [pa.string(), *[pa.int32()] * 4, pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["media_id", "frame_no", "plane_no", "width", "height", "data"])

    return rows.groupBy("media_id", "part").applyInArrow(read, codec.PLANE_SCHEMA)
