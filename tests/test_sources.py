import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import cli
from rasterloom.operators import codec
from rasterloom.plans import queries
from rasterloom.sources import images, rasters, y4m
from rasterloom.streaming import clips
from tests.test_coders import picture, same


def clip(n=5, h=16, w=32):
    return [[p[0], p[1][::2, ::2], p[2][::2, ::2]] for p in (picture(h, w, seed=k) for k in range(n))]


@pytest.mark.parametrize("shape", [(5, 7), (5, 7, 3), (4, 4, 4), (1, 1)])
def test_png(shape):
    image = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    assert np.array_equal(images.read_png(images.write_png(image)).reshape(shape), image)
    smooth = np.stack(picture(20, 30), axis=2)
    assert np.array_equal(images.read_png(images.write_png(smooth)), smooth)
    assert np.array_equal(images.read_pnm(images.write_pnm(smooth)), smooth)


def test_sixteen_bit_png_is_refused():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\x12\x34")) + chunk(b"IEND", b"")
    with pytest.raises(ValueError):
        images.read_png(png)
    assert images.read_png(png, force=True)[0, 0, 0] == 0x12


def test_image_scan(spark, tmp_path):
    image = np.stack(picture(12, 9), axis=2)
    (tmp_path / "a.png").write_bytes(images.write_png(image))
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = images.scan(spark, str(tmp_path)).collect()
    assert sum(r["error"] is not None for r in rows) == 1 and len(rows) == 4
    good = images.scan(spark, str(tmp_path / "a.png"))
    streams = codec.encode_media(images.strict(good))
    back = images.to_png(codec.decode_media(streams)).first()["content"]
    assert np.array_equal(images.read_png(bytes(back)), image)
    with pytest.raises(Exception, match="b.png"):
        images.strict(images.scan(spark, str(tmp_path / "b.png"))).collect()


def test_y4m(spark, tmp_path):
    head, frames = y4m.Header(32, 16, "420jpeg", "30:1"), clip()
    data = y4m.write(frames, head)
    assert y4m.parse_header(data).rate == "30:1"
    assert all(same(a, b) for a, b in zip(y4m.frames(data), frames)) and len(list(y4m.frames(data, 2))) == 2
    assert len(list(y4m.frames(data[:-1]))) == 4
    with pytest.raises(ValueError):
        list(y4m.frames(data.replace(b"FRAME", b"FRAMX")))
    for bad in (b"YUV4MPEG2 W32 H16 C420p10\n", b"YUV4MPEG2 H16\n", b"RIFF"):
        with pytest.raises(ValueError):
            y4m.parse_header(bad)
    (tmp_path / "c.y4m").write_bytes(data)
    planes = y4m.scan(spark, str(tmp_path / "c.y4m"))
    assert planes.count() == 15 and y4m.scan(spark, str(tmp_path / "c.y4m"), limit=2).count() == 6
    assert y4m.headers(spark, str(tmp_path / "c.y4m")).first()["frames"] == 5
    assert bytes(y4m.to_y4m(planes).first()["content"]) == data
    y4m.register(spark)
    source = spark.read.format("y4m").load(str(tmp_path))
    assert source.drop("media_id").exceptAll(planes.drop("media_id")).count() == 0 and source.count() == 15
    y4m.to_y4m(planes).write.format("y4m").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out" / "c.y4m").read_bytes() == data


@pytest.mark.parametrize("space", ["422", "444", "mono"])
def test_y4m_colour_spaces(space):
    head = y4m.Header(7, 5, space)
    frame = [np.random.default_rng(1).integers(0, 256, s).astype(np.uint8) for s in head.shapes()]
    assert same(next(iter(y4m.frames(y4m.write([frame], head)))), frame)


def test_command_line(tmp_path, capsys):
    image = np.stack(picture(24, 32), axis=2)
    (tmp_path / "a.png").write_bytes(images.write_png(image))
    path = lambda n: str(tmp_path / n)
    assert cli.main(["encode", path("a.png"), path("a.rl")]) == 0
    assert cli.main(["info", path("a.rl")]) == 0 and "32x24" in capsys.readouterr().out
    assert cli.main(["decode", path("a.rl"), path("b.png")]) == 0
    assert np.array_equal(images.read_png((tmp_path / "b.png").read_bytes()), image)
    assert cli.main(["check", path("a.png")]) == 0 and cli.main(["compare", path("a.png")]) == 0
    (tmp_path / "c.y4m").write_bytes(y4m.write(clip(2), y4m.Header(32, 16)))
    assert cli.main(["encode", path("c.y4m"), path("c.rl")]) == 0 and cli.main(["decode", path("c.rl"), path("d.y4m")]) == 0
    assert (tmp_path / "d.y4m").read_bytes() == (tmp_path / "c.y4m").read_bytes()
    assert cli.main(["info", path("a.png")]) == 1


def test_streaming_differences(spark, tmp_path):
    frames = [p[0] for p in clip(4)]
    rows = [("m", k, 0, 32, 16, bytearray(f.tobytes())) for k, f in enumerate(frames)]
    schema = "media_id string, frame_no int, plane_no int, width int, height int, data binary"
    for k in (1, 0, 3, 2):  # out of order, a file each
        spark.createDataFrame([rows[k]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = clips.differences(stream).writeStream.format("memory").queryName("differences").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    found = {r["frame_no"]: r["changed"] for r in spark.table("differences").collect()}
    assert found == {k: int((frames[k] != frames[k - 1]).sum()) for k in (1, 2, 3)}


def test_streaming_histograms(spark, tmp_path):
    spark.sql("SELECT 'm' AS media_id, 7 AS v, timestamp'2024-01-01 00:00:10' AS ts UNION ALL SELECT 'm', 7, timestamp'2024-01-01 00:00:50'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("media_id string, v int, ts timestamp").parquet(str(tmp_path / "in"))
    query = clips.histograms(stream, "ts").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [r["n"] for r in spark.table("counts").select(F.col("n")).collect()] == [2]


def test_clip_has_every_frame(spark, tmp_path):
    rows = [(k, [(k % 7 - 3) / 7] * 64) for k in range(0, 1130)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    frames = {r["frame_no"]: r["count"] for r in rasters.clip(spark, str(tmp_path)).groupBy("frame_no").count().collect()}
    assert frames == {k: 50 * 64 if k < 22 else 30 * 64 for k in range(23)}
    back = queries.clip_roundtrip(spark, str(tmp_path)).where("media_id = 'clip'")
    assert sorted(back.collect()) == sorted(rasters.clip(spark, str(tmp_path)).select(*back.columns).collect())
