"""TIFF media columns: a writer, a directory walker and decoder, and one row per page.

Reading covers classic TIFF of either byte order: chained image directories, strips and tiles, no compression,
PackBits, LZW and deflate, horizontal differencing undone at 8, 16 and 32 bits, chunky and planar samples.

Defined results: null or empty content, a foreign magic, a cut or looping file give one row with `error` set and no
data (pages decoded before the fault keep their rows); nothing raises. Equal contents give equal rows; repeated rows
are kept. Extra columns of the input are carried; one whose name clashes with an output column is dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
#: Field types of the format: code to (struct letter, bytes).
TYPES = {1: ("B", 1), 2: ("B", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4)}
#: A page may claim no more bytes than this, so that a forged header can't exhaust memory.
MOST_PAGE_BYTES = 1 << 30
PAGE_ROWS, STRIP_ROWS, PAYLOAD_WIDTH = 1024, 256, 64


class Bad(ValueError):
    """A file that isn't a TIFF of a kind read here."""


# ---------------------------------------------------------------- compression


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of 3 and more as pairs, the rest as literals of up to 128."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        n = e - s
        if n < 3:
            literal += data[s:e]
            continue
        flush()
        while n > 1:
            k = min(n, 128)
            out += bytes((257 - k, data[s]))
            n -= k
        if n:
            literal.append(data[s])
    flush()
    return bytes(out)


def unpack_bits(data: bytes, want: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < want:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """LZW with 9 to 12 bit codes, most significant bit first, the code width growing one code early."""
    out, acc, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal acc, held
        acc, held = acc << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    single = {bytes((i,)): i for i in range(256)}
    words, width = dict(single), 9
    put(256, width)
    now = b""
    fresh = 258
    for b in data:
        longer = now + bytes((b,))
        if longer in words:
            now = longer
            continue
        put(words[now], width)
        words[longer] = fresh
        fresh += 1
        if fresh == 4094:
            put(256, 12)
            words, width, fresh = dict(single), 9, 258
        elif fresh + 1 > 1 << width:
            width += 1
        now = bytes((b,))
    if now:
        put(words[now], width)
        fresh += 1
        if fresh + 1 > 1 << width and width < 12:
            width += 1
    put(257, width)
    if held:
        out.append(acc << (8 - held) & 255)
    return bytes(out)


def unpack_lzw(data: bytes, want: int) -> bytes:
    out = bytearray()
    acc = held = pos = 0
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    words, width, last = list(first), 9, None
    while len(out) < want:
        while held < width:
            if pos >= len(data):
                return bytes(out)
            acc, held, pos = acc << 8 | data[pos], held + 8, pos + 1
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == 256:
            words, width, last = list(first), 9, None
            continue
        if code == 257:
            break
        if last is None:
            if code > 255:
                raise Bad("LZW stream starts with an unknown code")
            last = words[code]
        else:
            if code < len(words):
                word = words[code]
            elif code == len(words):
                word = last + last[:1]
            else:
                raise Bad("LZW code out of range")
            words.append(last + word[:1])
            last = word
        out += last
        if len(words) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def inflate(data: bytes, want: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, max(want, 1))
    except zlib.error as e:
        raise Bad(f"deflate: {e}") from None


PACK = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: pack_bits}
UNPACK = {NONE: lambda d, n: d[:n], LZW: unpack_lzw, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}


# ---------------------------------------------------------------- writer


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: int = 0, order: str = "<") -> bytes:
    """Pages (rows x columns, or rows x columns x samples; uint8 or uint16) as a TIFF, in strips or in square tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        a = page if page.ndim == 3 else page[:, :, None]
        rows, columns, samples = a.shape
        parts = []
        if tile:
            for y in range(0, rows, tile):
                for x in range(0, columns, tile):
                    block = np.zeros((tile, tile, samples), a.dtype)
                    cut = a[y : y + tile, x : x + tile]
                    block[: cut.shape[0], : cut.shape[1]] = cut
                    parts.append(block)
        else:
            parts = [a[y : y + strip_rows] for y in range(0, rows, strip_rows)]
        offsets, counts = [], []
        for p in parts:
            if predictor == 2:
                p = np.concatenate([p[:, :1], p[:, 1:] - p[:, :-1]], axis=1)
            blob = PACK[compression](p.astype(p.dtype.newbyteorder(order), copy=False).tobytes())
            offsets.append(len(out))
            counts.append(len(blob))
            out += blob
            out += b"\0" * (len(out) & 1)
        fields = [(WIDTH, 4, [columns]), (LENGTH, 4, [rows]), (BITS, 3, [a.dtype.itemsize * 8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_COUNTS, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(fields):
            body = struct.pack(f"{order}{len(values)}{TYPES[kind][0]}", *values)
            if len(body) > 4:
                entries += struct.pack(order + "HHII", tag, kind, len(values), len(out))
                out += body + b"\0" * (len(body) & 1)
            else:
                entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# ---------------------------------------------------------------- reader


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """Walks the chain of image directories: byte order and integer fields of each."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise Bad("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise Bad("directories form a loop")
        seen.add(at)
        try:
            n = struct.unpack_from(order + "H", data, at)[0]
            fields = {}
            for k in range(at + 2, at + 2 + 12 * n, 12):
                tag, kind, count = struct.unpack_from(order + "HHI", data, k)
                if kind not in TYPES:
                    continue
                letter, size = TYPES[kind]
                if count * size > len(data):
                    raise Bad("a field is longer than the file")
                where = k + 8 if count * size <= 4 else struct.unpack_from(order + "I", data, k + 8)[0]
                fields[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, where))
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
        except struct.error:
            raise Bad("the file is cut off") from None
        yield order, fields


def page_samples(data: bytes, order: str, fields: dict[int, list[int]]) -> tuple[np.ndarray, dict[str, int]]:
    """The samples of a directory's image (rows x columns x samples) and what its header says."""
    one = lambda tag, default: (fields.get(tag) or [default])[0]
    columns, rows, bits, samples = one(WIDTH, 0), one(LENGTH, 0), one(BITS, 1), one(SAMPLES, 1)
    compression, predictor, planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if columns <= 0 or rows <= 0 or samples <= 0:
        raise Bad("an image without samples")
    if bits not in (8, 16, 32) or set(fields.get(BITS, [bits])) != {bits}:
        raise Bad(f"{bits} bits a sample aren't read here")
    if compression not in UNPACK or predictor not in (1, 2):
        raise Bad(f"compression {compression} with predictor {predictor} isn't read here")
    tiled = TILE_OFFSETS in fields
    wide, high = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (columns, min(one(ROWS_PER_STRIP, rows), rows))
    offsets, counts = (fields.get(TILE_OFFSETS), fields.get(TILE_COUNTS)) if tiled else (fields.get(STRIP_OFFSETS), fields.get(STRIP_COUNTS))
    kind = np.dtype(f"u{bits // 8}").newbyteorder(order)
    if not offsets or not counts or wide <= 0 or high <= 0 or max(rows * columns, wide * high) * samples * kind.itemsize > MOST_PAGE_BYTES:
        raise Bad("image sizes don't fit")
    across, down = -(-columns // wide), -(-rows // high)
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    if len(offsets) < across * down * planes or len(counts) < across * down * planes:
        raise Bad("strips or tiles are missing")
    out = np.zeros((rows, columns, samples), kind.newbyteorder("="))
    k = 0
    for p in range(planes):
        for y in range(0, rows, high):
            for x in range(0, columns, wide):
                tall = high if tiled else min(high, rows - y)
                want = tall * wide * each * kind.itemsize
                raw = UNPACK[compression](data[offsets[k] : offsets[k] + counts[k]], want)
                k += 1
                if len(raw) < want:
                    raise Bad("a strip or tile is too short")
                block = np.frombuffer(raw, kind, tall * wide * each).reshape(tall, wide, each).astype(out.dtype)
                if predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=out.dtype)
                part = block[: rows - y, : columns - x]
                out[y : y + part.shape[0], x : x + part.shape[1], p if planes > 1 else slice(None)] = part[:, :, 0] if planes > 1 else part
    return out, {"width": columns, "height": rows, "samples": samples, "bits": bits, "compression": compression, "predictor": predictor}


def read_pages(data: bytes | None) -> Iterator[dict]:
    """One dict per page: page_no, width, height, samples, bits, compression, predictor, data, error."""
    page = 0
    try:
        for order, fields in directories(data or b""):
            a, head = page_samples(data, order, fields)
            yield {"page_no": page, **head, "data": a.tobytes(), "error": None}
            page += 1
        if not page:
            raise Bad("no image directory")
    except (Bad, struct.error) as e:
        yield {"page_no": page, "width": None, "height": None, "samples": None, "bits": None, "compression": None, "predictor": None, "data": None, "error": str(e)}


PAGE_FIELDS = [("page_no", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("data", pa.binary()), ("error", pa.string())]


def tiff_pages(df: DataFrame, content: str = "content") -> DataFrame:
    """One row per page of each TIFF in column `content`; the other columns are carried along."""
    from pyspark.sql.pandas.types import from_arrow_type

    names = {n for n, _ in PAGE_FIELDS}
    carried = [c for c in df.columns if c not in names and c != content]
    schema = df.select(*carried).schema
    for n, kind in PAGE_FIELDS:
        schema = schema.add(n, from_arrow_type(kind))
    keep = df.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{content}`").alias("_media"))

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "_media", 8 << 20):
                found, take = [], []
                for i, blob in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    for p in read_pages(blob):
                        found.append(p)
                        take.append(i)
                at = pa.array(take, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(c).take(at) for c in range(len(carried))] + [pa.array([p[n] for p in found], kind) for n, kind in PAGE_FIELDS], names=[*carried, *(n for n, _ in PAGE_FIELDS)])

    return keep.mapInArrow(pages, schema)


# ---------------------------------------------------------------- texts as media


def text_media(text: bytes) -> bytes:
    """A text as a multi-page gray TIFF, 64 samples wide, zero-padded to a positive multiple of 64 bytes."""
    padded = text + b"\0" * (-len(text) % PAYLOAD_WIDTH or (0 if text else PAYLOAD_WIDTH))
    a = np.frombuffer(padded, np.uint8).reshape(-1, PAYLOAD_WIDTH)
    return write_tiff([a[y : y + PAGE_ROWS] for y in range(0, len(a), PAGE_ROWS)], DEFLATE, predictor=2)


def feature(pages: list[dict], payload: np.ndarray) -> str:
    """What the stored pages look like: their number, size, mean, entropy and busiest row step."""
    n = len(payload)
    counts = np.bincount(payload, minlength=256)
    used = counts[counts > 0]
    entropy = float(-(used * np.log2(used / n)).sum() / n)
    return f"pages={len(pages)};rows={sum(p['height'] for p in pages)};width={pages[0]['width']};mean={payload.mean():.4f};entropy={entropy:.4f};values={len(used)}"


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores every text as TIFF, reads the stored bytes back page by page and digests what was read.

    Null text counts as empty (64 zero bytes). Equal texts give equal values; every input row gives one row.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode()
                media = text_media(raw)
                pages = list(read_pages(media))
                if pages[-1]["error"]:
                    raise RuntimeError(pages[-1]["error"])
                payload = b"".join(p["data"] for p in pages)
                rows.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(pages, np.frombuffer(payload, np.uint8)), len(pages)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            names = [x.split()[0] for x in MEDIA_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(digest, MEDIA_SCHEMA)
