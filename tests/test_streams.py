"""Clips coded and compared as their frames come."""

import time

import numpy as np
import pytest

from rasterloom.operators import codec, motion
from rasterloom.streaming import clips

FRAMES = "media_id string, frame_no int, planes array<struct<width:int, height:int, data:binary>>"


def pictures(n, shapes, seed=0):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 60, s) + np.arange(s[1])[None] * 2 for s in shapes]
    return [[np.roll(b, k, axis=1).astype(np.uint8) for b in base] for k in range(n)]


def row(media, k, frame):
    return media, k, [(p.shape[1], p.shape[0], bytearray(np.ascontiguousarray(p).tobytes())) for p in frame]


@pytest.mark.parametrize("shapes", [[(12, 20)], [(16, 24), (8, 12), (8, 12)]])
def test_frames_one_by_one(shapes):
    coder, reader = codec.FrameCoder(), codec.FrameCoder()
    for frame in pictures(4, shapes):
        payload = coder.encode(frame)
        assert all(map(np.array_equal, reader.decode(payload), frame))
    with pytest.raises(ValueError):
        codec.FrameCoder().decode(payload)
    with pytest.raises(ValueError):
        coder.encode([np.zeros((5, 5), np.uint8)])


def batches(spark, folder, parts, schema=FRAMES):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def until(query, holds, seconds=120):
    """Waits until it holds: with timers by the clock a query's batches never end, so it is asked, not awaited."""
    end = time.time() + seconds
    while not holds():
        assert time.time() < end and query.exception() is None, query.exception()
        time.sleep(0.3)


def run(frame, folder, name):
    """One query after another on the same state, until what is there is done."""
    for _ in range(2):
        query = frame.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/state-{name}").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()


def test_streamed_clips_equal_the_batch(spark, tmp_path):
    """Out of order over batches, repeated, two clips and several parts: the payloads of coding each part in one go."""
    one, two = pictures(7, [(12, 20)]), pictures(3, [(8, 12), (4, 6), (4, 6)], 1)
    rows = [row("one", k, f) for k, f in enumerate(one)] + [row("two", k, f) for k, f in enumerate(two)]
    parts = [[rows[2], rows[8]], [rows[0], rows[3]], [rows[1], rows[0], rows[7]], [rows[6], rows[5], rows[9]], [rows[4], rows[6]]]
    run(clips.coded(batches(spark, tmp_path, parts), group_frames=3), tmp_path, "coded")
    out = spark.read.schema(clips.CODED).parquet(f"{tmp_path}/coded")
    want = {}
    for name, frames in (("one", one), ("two", two)):
        for a in range(0, len(frames), 3):
            coder = codec.FrameCoder()
            want |= {(name, k): (k == a, coder.encode(frames[k])) for k in range(a, min(a + 3, len(frames)))}
    assert {(r["media_id"], r["frame_no"]): (r["restart"], bytes(r["payload"])) for r in out.collect()} == want and out.count() == 10
    back = {(r["media_id"], r["frame_no"], r["plane_no"]): bytes(r["data"]) for r in clips.decoded(out).collect()}
    assert back == {(n, k, p): a.tobytes() for n, frames in (("one", one), ("two", two)) for k, f in enumerate(frames) for p, a in enumerate(f)}


def test_missing_frames_are_given_up(spark, tmp_path):
    """Frame 1 never comes: after the wait the next ones go on as after nothing, and late ones are ignored."""
    frames = pictures(4, [(6, 8)])
    schema = "media_id string, frame_no int, plane_no int, width int, height int, data binary"
    plane = lambda k: ("m", k, 0, 8, 6, bytearray(frames[k][0].tobytes()))
    stream = batches(spark, tmp_path, [[plane(0)], [plane(2)], [plane(3)]], schema)
    query = clips.differences(stream, wait=1500).writeStream.format("memory").queryName("given_up").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    until(query, lambda: spark.table("given_up").count() >= 2)
    query.stop()
    found = {r["frame_no"]: (r["changed"], r["cost"], r["missing"]) for r in spark.table("given_up").collect()}
    a, b = frames[2][0], frames[3][0]
    assert found == {2: (None, None, 1), 3: (int((a != b).sum()), int(motion.cost(b, a).sum()), 0)}
