"""Image files: a PNG reader and writer in numpy and zlib, portable anymaps, strict scans, and sinks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Colour types of the format to samples a pixel (fixed values).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MOST_PIXELS = 1 << 28


def write_png(image: np.ndarray) -> bytes:
    """Gray, RGB or RGBA 8-bit samples; each row takes the filter whose residuals are smallest in sum."""
    a = image if image.ndim == 3 else image[:, :, None]
    h, w, c = a.shape
    if c not in (1, 3, 4) or not h or not w:
        raise ValueError("PNG takes gray, RGB or RGBA images with samples")
    rows = a.reshape(h, w * c).astype(np.int64)
    up, left, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    up[1:], left[:, c:], corner[1:, c:] = rows[:-1], rows[:, :-c], rows[:-1, :-c]
    filtered = np.stack([rows, rows - left, rows - up, rows - (left + up >> 1), rows - _paeth(left, up, corner)]) & 255
    best = np.minimum(filtered, 256 - filtered).sum(axis=2).argmin(axis=0)
    body = np.concatenate([best[:, None], filtered[best, np.arange(h)]], axis=1).astype(np.uint8).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body, 9)) + chunk(b"IEND", b"")


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def png_header(data: bytes) -> tuple[int, int, int, int, int]:
    """width, height, bit depth, colour type, interlace."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or len(data) < 29:
        raise ValueError("not a PNG")
    w, h, depth, colour, _, _, interlace = struct.unpack_from(">IIBBBBB", data, 16)
    return w, h, depth, colour, interlace


def read_png(data: bytes, force: bool = False) -> np.ndarray:
    """Rows x columns x channels. Palettes become RGB(A), 1-bit gray becomes 8-bit; other depths than 8 are refused
    unless forced (16 bits then lose their low byte)."""
    w, h, depth, colour, interlace = png_header(data)
    if interlace or colour not in CHANNELS or not 0 < w * h <= MOST_PIXELS:
        raise ValueError("this kind of PNG isn't read here")
    if depth == 16 and not force:
        raise ValueError("16-bit samples would lose their low byte")
    if depth not in (1, 2, 4, 8, 16) or depth < 8 and (colour not in (0, 3) or colour == 0 and depth != 1 and not force):
        raise ValueError(f"{depth} bits a sample aren't read here")
    at, body, palette, alpha = 8, [], None, None
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if len(part) < n or zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("the file is damaged or cut off")
        if kind == b"IDAT":
            body.append(part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(part, np.uint8)
        at += 12 + n
    c = CHANNELS[colour]
    stride, step = -(-w * c * depth // 8), max(1, c * depth // 8)
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error:
        raise ValueError("the file is damaged or cut off") from None
    if len(raw) < h * (stride + 1):
        raise ValueError("the file is damaged or cut off")
    lines = np.frombuffer(raw[: h * (stride + 1)], np.uint8).reshape(h, stride + 1)
    out = np.zeros((h + 1, stride + step), np.uint8)
    for y in range(h):
        kind, line, above, row = lines[y, 0], lines[y, 1:], out[y, step:], out[y + 1, step:]
        if kind == 0:
            row[:] = line
        elif kind == 2:
            row[:] = line + above
        elif kind == 1:
            for k in range(step):
                row[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind in (3, 4):
            full, prior = bytearray(stride + step), out[y].tobytes()
            text = line.tobytes()
            for i in range(stride):
                a, b, q = full[i], prior[i + step], prior[i]
                if kind == 3:
                    p = a + b >> 1
                else:
                    da, db, dc = abs(b - q), abs(a - q), abs(a + b - 2 * q)
                    p = a if da <= db and da <= dc else b if db <= dc else q
                full[i + step] = text[i] + p & 255
            row[:] = np.frombuffer(bytes(full), np.uint8)[step:]
        else:
            raise ValueError("an unknown row filter")
    samples = out[1:, step:]
    if depth == 16:
        samples = samples[:, ::2]
    elif depth < 8:
        samples = (np.unpackbits(samples, axis=1).reshape(h, -1, depth) * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)[:, : w * c]
    image = samples.reshape(h, w, c)
    if colour == 3:
        if palette is None or int(image.max(initial=0)) >= len(palette):
            raise ValueError("the palette is missing or short")
        rgb = palette[image[:, :, 0]]
        if alpha is not None:
            full = np.full(256, 255, np.uint8)
            full[: len(alpha)] = alpha
            rgb = np.concatenate([rgb, full[image]], axis=2)
        return rgb
    if depth < 8:
        image = (image.astype(np.int64) * (255 // ((1 << depth) - 1))).astype(np.uint8)
    return image


def write_pnm(image: np.ndarray) -> bytes:
    """PGM or PPM."""
    a = image if image.ndim == 3 else image[:, :, None]
    return b"P%d\n%d %d\n255\n" % ({1: 5, 3: 6}[a.shape[2]], a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()


def read_pnm(data: bytes) -> np.ndarray:
    parts = data.split(None, 4)
    if len(parts) < 4 or parts[0] not in (b"P5", b"P6") or parts[3] != b"255":
        raise ValueError("not an 8-bit PGM or PPM")
    w, h, c = int(parts[1]), int(parts[2]), 1 if parts[0] == b"P5" else 3
    body = data[len(data) - w * h * c :] if w * h * c <= len(data) else b""
    if len(body) < w * h * c or not body:
        raise ValueError("the file is cut off")
    return np.frombuffer(body, np.uint8).reshape(h, w, c)


def decode(data: bytes, force: bool = False) -> np.ndarray:
    return read_png(data, force) if data[:8] == SIGNATURE else read_pnm(data)


SCAN = "media_id string, frame_no int, plane_no int, width int, height int, data binary, error string"


def scan(spark: SparkSession, path: str, force: bool = False) -> DataFrame:
    """Packed planes of image files; a file that can't be read exactly has one row with `error` and no data.

    Files come through Spark's binary reader, so any store works. A two-channel (gray and alpha) image becomes RGBA.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    image = decode(content, force)
                    if image.shape[2] == 2:
                        image = image[:, :, [0, 0, 0, 1]]
                    rows += [(name, 0, k, image.shape[1], image.shape[0], np.ascontiguousarray(image[:, :, k]).tobytes(), None) for k in range(image.shape[2])]
                except ValueError as e:
                    rows.append((name, 0, 0, None, None, None, str(e)))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=[x.split()[0] for x in SCAN.split(", ")])

    return files.mapInArrow(read, SCAN)


def strict(planes: DataFrame) -> DataFrame:
    """Planes of scan(); a file that wasn't read exactly stops the query."""
    return planes.withColumn("data", F.when(F.col("error").isNull(), F.col("data")).otherwise(F.raise_error(F.concat("media_id", F.lit(": "), "error")).cast("binary"))).drop("error")


def to_png(planes: DataFrame) -> DataFrame:
    """media_id, content: each image's planes as a PNG, for a binary sink."""
    from rasterloom.operators.codec import _ordered

    def make(key: tuple, rows: pa.Table) -> pa.Table:
        image = [p for _, _, p in _ordered(rows)]
        return pa.table({"media_id": pa.array([key[0].as_py()]), "content": pa.array([write_png(np.stack(image, axis=2))], pa.binary())})

    return planes.groupBy("media_id").applyInArrow(make, "media_id string, content binary")
