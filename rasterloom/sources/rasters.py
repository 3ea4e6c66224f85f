"""Rasters derived from tables, in the samples schema (media_id, frame_no, plane_no, y, x, v), and packed planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.samples import wrap

KEY = ["media_id", "frame_no", "plane_no"]
#: Rows of the `embeddings` raster that make one frame of the clip.
CLIP_ROWS = 50
SCENE_ROWS, SCENE_COLUMNS, SCENE_FRAMES = 64, 96, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "f")))


def _values(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("v", F.expr("CAST(least(255, greatest(0, floor((CAST(f AS DOUBLE) + 0.5) * 255))) AS INT)"))


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as one gray plane: a row per vector, a column per dimension."""
    return _quantized(spark, sf_dir).selectExpr("'gray' AS media_id", "0 AS frame_no", "0 AS plane_no", "CAST(vec_id AS INT) AS y", "dim AS x", "v")


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dimensions, and zeros up to a multiple of three, as pixels of three channels."""
    padded = F.expr("concat(embedding, array_repeat(CAST(0 AS FLOAT), CAST(pmod(-size(embedding), 3) AS INT)))")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(padded).alias("dim", "f"))
    return _values(vectors).selectExpr("'rgb' AS media_id", "0 AS frame_no", "dim % 3 AS plane_no", "CAST(vec_id AS INT) AS y", "CAST(dim div 3 AS INT) AS x", "v")


def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 50 rows, as many as the table gives."""
    rows = _quantized(spark, sf_dir)
    return rows.selectExpr("'clip' AS media_id", f"CAST(vec_id div {CLIP_ROWS} AS INT) AS frame_no", "0 AS plane_no", f"CAST(vec_id % {CLIP_ROWS} AS INT) AS y", "dim AS x", "v")


#: A smooth field with an edge and little noise, from integers only; frames pan by (1, 2).
SCENE_VALUE = wrap("(u * 3 >> 1) + (t >> 1) + (u * t >> 7) + CASE WHEN u + t > 90 THEN 40 ELSE 0 END + ((u * 7919 + t * 104729 + (u * t) * 31) >> 4 & 3)")


def scene(spark: SparkSession, frames: int = SCENE_FRAMES, rows: int = SCENE_ROWS, columns: int = SCENE_COLUMNS) -> DataFrame:
    """A picture-like clip with real motion; media_id `scene`."""
    cells = spark.range(frames * rows * columns).selectExpr(f"CAST(id div {rows * columns} AS INT) AS frame_no", f"CAST(id div {columns} % {rows} AS INT) AS y", f"CAST(id % {columns} AS INT) AS x")
    return cells.withColumns({"u": F.expr("x + 2 * frame_no"), "t": F.expr("y + frame_no")}).selectExpr("'scene' AS media_id", "frame_no", "0 AS plane_no", "y", "x", f"CAST({SCENE_VALUE} AS INT) AS v")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UTF-8 bytes of every whole text of documents: (media_id, data); null texts have none."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("media_id"), F.encode("text", "UTF-8").alias("data"))


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same a byte a row: (media_id, pos, sym)."""
    return byte_rows(texts(spark, sf_dir))


#: Bytes that become rows of one Arrow batch.
STRETCH = 1 << 18


def byte_rows(data: DataFrame) -> DataFrame:
    """(media_id, data) a byte a row, cut into batches of STRETCH rows."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for media, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                every = np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)
                for at in range(0, len(every), STRETCH):
                    part = every[at : at + STRETCH]
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(media, pa.string()), len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part.astype(np.int32))], names=["media_id", "pos", "sym"])

    return data.select("media_id", "data").mapInArrow(spread, "media_id string, pos long, sym int")


def byte_counts(data: DataFrame) -> DataFrame:
    """(media_id, sym, n): each value's bytes counted where it lies, 256 rows at most, instead of a row a byte."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, syms, counts = [], [], []
            for media, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                n = np.bincount(np.frombuffer(value.as_buffer(), np.uint8), minlength=256) if value.is_valid else np.zeros(256, np.int64)
                used = np.flatnonzero(n)
                names += [media] * len(used)
                syms.append(used)
                counts.append(n[used])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(np.concatenate(x) if x else [], k) for x, k in ((syms, pa.int32()), (counts, pa.int64())))], names=["media_id", "sym", "n"])

    found = data.select("media_id", "data").mapInArrow(count, "media_id string, sym int, n long")
    return found.groupBy("media_id", "sym").agg(F.sum("n").alias("n"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event values, in order of time, as a plane of one row."""
    order = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1"
    rows = table(spark, sf_dir, "events").selectExpr("user_id", f"CAST({order} AS INT) AS x", "CAST(floor(value) AS BIGINT) & 255 AS v")
    return rows.selectExpr("CAST(user_id AS STRING) AS media_id", "0 AS frame_no", "0 AS plane_no", "0 AS y", "x", "CAST(v AS INT) AS v")


#: Rows of a plane that one group packs, and samples of one Arrow batch that are unpacked.
PACKED_ROWS = 1024
PLANE = "media_id string, frame_no int, plane_no int, width int, height int, data binary"


def pack(samples: DataFrame) -> DataFrame:
    """Samples to packed planes (media_id, frame_no, plane_no, width, height, data); missing samples are 0.

    Samples are packed in strips of rows, a group each; only the strips, a byte a sample, are put together by plane.
    """
    names = ["media_id", "frame_no", "plane_no", "width", "height", "data"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        y, x, v = (rows.column(c).to_numpy() for c in ("y", "x", "v"))
        top = key[3].as_py() * PACKED_ROWS
        strip = np.zeros((int(y.max()) + 1 - top, int(x.max()) + 1), np.uint8)
        strip[y - top, x] = v
        values = [*(k.as_py() for k in key[:3]), strip.shape[1], top + strip.shape[0], strip.tobytes()]
        return pa.table([pa.array([value], kind) for value, kind in zip(values, kinds)], names=names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                *key, width, height, strips = (batch.column(k)[i].as_py() for k in range(6))
                plane = np.zeros((height, width), np.uint8)
                for strip in strips:  # height is where a strip ends in its plane
                    cells = np.frombuffer(strip["data"], np.uint8).reshape(-1, strip["width"])
                    plane[strip["height"] - len(cells) : strip["height"], : strip["width"]] = cells
                yield pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in zip([*key, width, height, plane.tobytes()], kinds)], names=names)

    strips = samples.groupBy(*KEY, F.expr(f"CAST(y div {PACKED_ROWS} AS INT)").alias("_s")).applyInArrow(packed, PLANE)
    every = F.collect_list(F.struct("width", "height", "data")).alias("strips")  # one plane's
    whole = strips.groupBy(*KEY).agg(F.max("width").alias("width"), F.max("height").alias("height"), every)
    return whole.mapInArrow(joined, PLANE)


def unpack(planes: DataFrame) -> DataFrame:
    """Packed planes to samples. Planes may come in bands (column top: a band's first row)."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                media, frame, plane, width, height, data, top = (batch.column(k)[i] for k in range(7))
                every = np.frombuffer(data.as_buffer(), np.uint8) if width.as_py() and height.as_py() else np.zeros(0, np.uint8)
                w = max(width.as_py(), 1)
                for a in range(0, len(every), STRETCH):
                    v = every[a : a + STRETCH]
                    at, n = np.arange(a, a + len(v)), len(v)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(media.as_py(), pa.string()), n), pa.array(np.full(n, frame.as_py(), np.int32)), pa.array(np.full(n, plane.as_py(), np.int32)), pa.array((at // w + top.as_py()).astype(np.int32)), pa.array((at % w).astype(np.int32)), pa.array(v.astype(np.int32))], names=["media_id", "frame_no", "plane_no", "y", "x", "v"])

    top = F.col("top") if "top" in planes.columns else F.lit(0).alias("top")
    return planes.select("media_id", "frame_no", "plane_no", "width", "height", "data", top).mapInArrow(spread, "media_id string, frame_no int, plane_no int, y int, x int, v int")
