"""Lossless image and clip streams over the wavefront coder, and their DataFrame operators.

An image stream: magic, width, height, channels, flags, settings if they aren't the usual ones, planes. A clip stream: magic, frames, planes, flags, block
size, plane sizes, then the block table of each frame but the first; then the row coders' units. Large images are cut
into bands of rows and long clips into groups of frames, each a stream of its own that another task codes: a stream of
parts has magic, kind, width, height, planes, frames, flags, block size, samples, the parts' sizes and the parts. All
end with a CRC-32 of all before it.
Vectors have no range limit in the stream (a magnitude is an Exp-Golomb code), frames may be of odd sizes, and chroma
vectors are scaled by the rounded ratio of plane sizes.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import motion
from .coders import BitDecoder, BitEncoder, Reader, varint
from .wavefront import DEFAULT, Bank, CostCoders, RowCoders, Settings, code_plane, code_planes, coders_of

IMAGE, CLIP, PARTS, FRAME = b"RLI1", b"RLV1", b"RLP1", b"RLF1"
#: Samples of a band (of all its planes) and frames of a group; each is modelled from nothing.
BAND_SAMPLES, GROUP_FRAMES = 1 << 15, 16
#: Parts of one size that a task codes side by side; they take about 2 MB each.
ABREAST = 64
COLOUR, TURNED, TUNED = 1, 2, 4  # flags; a tall image is coded on its side, which takes fewer steps; a tuned one has its settings
MOST_SAMPLES = 1 << 31


# ---------------------------------------------------------------- colour


def forward_colour(rgb: list[np.ndarray]) -> list[np.ndarray]:
    r, g, b = (p.astype(np.int64) for p in rgb)
    cb, cr = (b - g + 128 & 255) - 128, (r - g + 128 & 255) - 128
    return [(g + (cb + cr >> 2) & 255).astype(np.uint8), (cb + 128 & 255).astype(np.uint8), (cr + 128 & 255).astype(np.uint8)]


def inverse_colour(planes: list[np.ndarray]) -> list[np.ndarray]:
    y, cb, cr = (p.astype(np.int64) for p in planes)
    cb, cr = cb - 128, cr - 128
    g = y - (cb + cr >> 2) & 255
    return [(g + cr & 255).astype(np.uint8), g.astype(np.uint8), (g + cb & 255).astype(np.uint8)]


def med_entropy(planes: list[np.ndarray]) -> float:
    """Bytes of the MED residuals at their zeroth-order entropy."""
    total = 0.0
    for p in planes:
        c = p.astype(np.int64)
        n, w, nw = np.zeros_like(c), np.zeros_like(c), np.zeros_like(c)
        n[1:], w[:, 1:], nw[1:, 1:] = c[:-1], c[:, :-1], c[:-1, :-1]
        lo, hi = np.minimum(n, w), np.maximum(n, w)
        pred = np.where(nw >= hi, lo, np.where(nw <= lo, hi, n + w - nw))
        pred[0], pred[:, 0] = w[0], n[:, 0]
        counts = np.bincount((c - pred & 255).ravel(), minlength=256)
        used = counts[counts > 0]
        total += float((-used * np.log2(used / used.sum())).sum()) / 8
    return total


# ---------------------------------------------------------------- planes in streams


def _put_streams(streams: list[bytes]) -> bytes:
    return b"".join(varint(len(s)) for s in streams) + b"".join(streams)


def _get_streams(reader: Reader, n: int) -> list[bytes]:
    sizes = [reader.varint() for _ in range(n)]
    return [reader.raw(s) for s in sizes]


def _sealed(body: bytes) -> bytes:
    return body + struct.pack("<I", zlib.crc32(body))


def _opened(data: bytes, magic: bytes) -> Reader:
    if data[:4] != magic:
        raise ValueError("a foreign stream")
    if len(data) < 8 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("the stream is damaged or cut off")
    return Reader(data[:-4], 4)


def _put_settings(settings: Settings) -> bytes:
    """The settings, edges as steps."""
    ladders = [bytes((len(e),)) + b"".join(varint(b - a) for a, b in zip((0, *e), e)) for e in (settings.activity, settings.errors)]
    return bytes((settings.memory,)) + b"".join(ladders)


def _get_settings(r: Reader) -> Settings:
    memory = r.u8()
    ladders = [tuple(itertools.accumulate(r.varint() for _ in range(r.u8()))) for _ in range(2)]
    return Settings(*ladders, memory)


def _prepared(channels: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The planes that an image's stream holds, and its flags: three and more channels go through the colour transform if
    their residuals then take less, tall images lie on their side."""
    if not 1 <= len(channels) <= 4 or any(c.shape != channels[0].shape for c in channels):
        raise ValueError("an image has one to four channels of one size")
    height, width = channels[0].shape
    if not height or not width:
        raise ValueError("an image has samples")
    planes, flags = list(channels), 0
    if len(channels) >= 3:
        changed = forward_colour(channels[:3])
        if med_entropy(changed) <= med_entropy(channels[:3]):
            planes, flags = changed + channels[3:], COLOUR
    if height > width:
        planes, flags = [np.ascontiguousarray(p.T) for p in planes], flags | TURNED
    return planes, flags


def _code_planes(images: list[list[np.ndarray]], bank: Bank, coders: RowCoders | CostCoders) -> None:
    side = None
    for k, planes in enumerate(zip(*images)):
        _, sizes = code_planes(bank, k, *planes[0].shape, np.stack(planes), coders, side=side if k in (1, 2) else None)
        side = sizes if k == 0 else side


def encode_images(images: list[list[np.ndarray]], settings: Settings = DEFAULT) -> list[tuple[bytes, dict]]:
    """Images of as many channels and one size, side by side: the stream of each, as encode_image's, and its statistics."""
    ready = [_prepared(channels) for channels in images]
    height, width = images[0][0].shape
    n = coders_of(*ready[0][0][0].shape)
    bank, coders = Bank(settings, len(images)), RowCoders(n * len(images))
    _code_planes([planes for planes, _ in ready], bank, coders)
    streams, out = coders.finish(), []
    for k, (_, flags) in enumerate(ready):
        flags |= TUNED if settings != DEFAULT else 0
        head = [IMAGE, varint(width), varint(height), bytes((len(images[k]), flags)), _put_settings(settings) if flags & TUNED else b""]
        out.append((_sealed(b"".join([*head, _put_streams(streams[k * n : (k + 1) * n])])), {c: int(v[k]) for c, v in bank.statistics.items()}))
    return out


def encode_image(channels: list[np.ndarray], statistics: dict | None = None, settings: Settings = DEFAULT) -> bytes:
    """One to four channels of one size."""
    stream, found = encode_images([channels], settings)[0]
    if statistics is not None:
        statistics.update(found)
    return stream


def images_bits(images: list[list[np.ndarray]], settings: Settings = DEFAULT) -> list[float]:
    """The bits that all decisions of each image cost, without coding them: its size but for header and rounding."""
    ready = [_prepared(channels)[0] for channels in images]
    cost = CostCoders(coders_of(*ready[0][0].shape), len(images))
    _code_planes(ready, Bank(settings, len(images)), cost)
    return cost.totals.tolist()


def image_bits(channels: list[np.ndarray], settings: Settings = DEFAULT) -> float:
    return images_bits([channels], settings)[0]


def side_by_side(shapes: list, most: int | None = None) -> list[list[int]]:
    """The places of equal shapes together, up to `most` (ABREAST) each."""
    most, found = most or ABREAST, {}
    for k, shape in enumerate(shapes):
        found.setdefault(shape, []).append(k)
    return [places[a : a + most] for places in found.values() for a in range(0, len(places), most)]


def join_parts(parts: list[bytes]) -> bytes:
    """One stream of bands or groups in order; a single part stays as it is."""
    if len(parts) == 1:
        return parts[0]
    heads = [header(p) for p in parts]
    first, clip = heads[0], heads[0]["kind"] == "clip"
    height = first["height"] if clip else sum(h["height"] for h in heads)
    out = [PARTS, bytes((int(clip),)), varint(first["width"]), varint(height), bytes((first["planes"],)), varint(sum(h["frames"] for h in heads) if clip else 1), bytes((any(h["colour"] for h in heads), first["block"] or 0)), varint(sum(h["samples"] for h in heads)), varint(len(parts))]
    return _sealed(b"".join([*out, *(varint(len(p)) for p in parts), *parts]))


def split_parts(data: bytes) -> list[bytes]:
    """The parts of a stream in order; a stream without parts is its own only one."""
    if data[:4] != PARTS:
        return [data]
    r = _opened(data, PARTS)
    r.u8(), r.varint(), r.varint(), r.u8(), r.varint(), r.u8(), r.u8(), r.varint()
    return _get_streams(r, r.varint())


def decode_images(data: list[bytes]) -> list[list[np.ndarray]]:
    """Streams without parts, those of one size side by side."""
    heads = []
    for d in data:
        r = _opened(d, IMAGE)
        width, height, channels, flags = r.varint(), r.varint(), r.u8(), r.u8()
        if not 1 <= channels <= 4 or not 0 < width * height < MOST_SAMPLES:
            raise ValueError("the header is damaged")
        settings = _get_settings(r) if flags & TUNED else DEFAULT
        rows, columns = (width, height) if flags & TURNED else (height, width)
        heads.append(((channels, rows, columns, settings), flags, r))
    out: list[list[np.ndarray]] = [[] for _ in data]
    for places in side_by_side([h[0] for h in heads]):
        channels, rows, columns, settings = heads[places[0]][0]
        bank, side, n = Bank(settings, len(places)), None, coders_of(rows, columns)
        coders = RowCoders(n * len(places), [u for k in places for u in _get_streams(heads[k][2], n)])
        for c in range(channels):
            planes, sizes = code_planes(bank, c, rows, columns, None, coders, side=side if c in (1, 2) else None)
            side = sizes if c == 0 else side
            for k, plane in zip(places, planes):
                out[k].append(np.ascontiguousarray(plane.T) if heads[k][1] & TURNED else plane)
    return [inverse_colour(planes[:3]) + planes[3:] if h[1] & COLOUR else planes for h, planes in zip(heads, out)]


def decode_image(data: bytes) -> list[np.ndarray]:
    if data[:4] == PARTS:
        return [np.concatenate(p) for p in zip(*decode_images(split_parts(data)))]
    return decode_images([data])[0]


# ---------------------------------------------------------------- clips


class _Blocks:
    """Codes block tables; probabilities live for the clip."""

    def __init__(self) -> None:
        self.mode = [32768] * 4
        self.size = [[32768] * 40 for _ in range(2)]
        self.sign = [32768] * 2

    def write(self, mode: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> bytes:
        coder = BitEncoder()
        self.walk(mode, dy, dx, lambda bank, k, bit: coder.bit(bank, k, bit) or bit, lambda value, bits: coder.bypass(value, bits) or value, True)
        return coder.finish()

    def read(self, data: bytes, shape: tuple[int, int]) -> tuple[np.ndarray, ...]:
        coder = BitDecoder(data)
        mode, dy, dx = (np.zeros(shape, np.int64) for _ in range(3))
        self.walk(mode, dy, dx, lambda bank, k, _: coder.bit(bank, k), lambda _, bits: coder.bypass(bits), False)
        return mode, dy, dx

    def walk(self, mode, dy, dx, bit, plain, write: bool) -> None:
        rows, columns = mode.shape
        for by in range(rows):
            for bx in range(columns):
                near = 2 * (int(mode[by, bx - 1]) if bx else 0) + (int(mode[by - 1, bx]) if by else 0)
                mode[by, bx] = bit(self.mode, near, int(mode[by, bx]))
                if not mode[by, bx]:
                    continue
                for axis, v in enumerate((dy, dx)):
                    guess = motion.predicted_vector(v, by, bx)
                    d = int(v[by, bx]) - guess if write else 0
                    n = abs(d).bit_length()
                    length = 0
                    while bit(self.size[axis], min(length, 39), int(length < n)):
                        length += 1
                        if length > 32:
                            raise ValueError("a vector is damaged")
                    size = length and (1 << length - 1 | plain(abs(d) & (1 << length - 1) - 1, length - 1))
                    if size and bit(self.sign, axis, int(d < 0)):
                        size = -size
                    v[by, bx] = guess + size


def _inter(previous: np.ndarray, blocks: tuple[np.ndarray, ...], block: int, luma: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The compensated plane and where it is used, for a plane of any size relative to luma."""
    mode, dy, dx = blocks
    h, w = previous.shape
    sy, sx = max(1, (luma[0] + h // 2) // h), max(1, (luma[1] + w // 2) // w)
    size = max(1, block // sy), max(1, block // sx)
    moved = motion.compensated(motion.phases(previous), dy, dx, size, (sy, sx))
    by, bx = np.minimum(np.arange(h) // size[0], mode.shape[0] - 1), np.minimum(np.arange(w) // size[1], mode.shape[1] - 1)
    return moved, mode[by][:, bx] == motion.TEMPORAL


def encode_clips(clips: list[list[list[np.ndarray]]], colour: bool | None = None, block: int = motion.BLOCK) -> list[bytes]:
    """Clips of as many frames and the same plane sizes (one to four planes; the first is searched), side by side.

    colour: whether the first three planes go through the colour transform; None: if they have one size and the first
    frame's residuals take less.
    """
    ready, flags = [], []
    for frames in clips:
        if not frames or not 1 <= len(frames[0]) <= 4:
            raise ValueError("a clip has frames of one to four planes")
        own = colour
        if own is None:
            first = frames[0][:3]
            own = len(first) == 3 and len({p.shape for p in first}) == 1 and first[0].size > 0 and med_entropy(forward_colour(first)) <= med_entropy(first)
        ready.append([forward_colour(f[:3]) + f[3:] for f in frames] if own else frames)
        flags.append(COLOUR if own else 0)
    shapes, count = [p.shape for p in ready[0][0]], len(ready[0])
    if any(len(c) != count or [p.shape for p in f] != shapes for c in ready for f in c) or any(not h or not w for h, w in shapes):
        raise ValueError("all frames have planes of the same sizes")
    out = [[CLIP, varint(count), bytes((len(shapes), f, block)), *(varint(w) + varint(h) for h, w in shapes)] for f in flags]
    n = max(coders_of(*s) for s in shapes)
    bank, tables, coders = Bank(copies=len(clips)), [_Blocks() for _ in clips], RowCoders(n * len(clips))
    for k in range(count):
        blocks: list = []
        for c, clip in enumerate(ready if k else []):
            blocks.append(motion.modes(clip[k][0], clip[k - 1][0], block)[:3])
            raw = tables[c].write(*blocks[-1])
            out[c].append(varint(len(raw)) + raw)
        side = None
        for p, shape in enumerate(shapes):
            inter = _inters([c[k - 1][p] for c in ready], blocks, block, shapes[0]) if k else (None, None)
            _, sizes = code_planes(bank, p, *shape, np.stack([c[k][p] for c in ready]), coders, side if p in (1, 2) else None, *inter)
            side = sizes if p == 0 else side
    streams = coders.finish()
    return [_sealed(b"".join([*o, _put_streams(streams[c * n : (c + 1) * n])])) for c, o in enumerate(out)]


def encode_clip(frames: list[list[np.ndarray]], colour: bool | None = None, block: int = motion.BLOCK) -> bytes:
    return encode_clips([frames], colour, block)[0]


def _inters(previous: list[np.ndarray], blocks: list, block: int, luma: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Stacks of what _inter gives for each clip."""
    found = [_inter(p, b, block, luma) for p, b in zip(previous, blocks)]
    return np.stack([m for m, _ in found]), np.stack([t for _, t in found])


def decode_clips(data: list[bytes]) -> list[list[list[np.ndarray]]]:
    """Streams without parts, those of one size side by side."""
    heads = []
    for d in data:
        r = _opened(d, CLIP)
        count, planes, flags, block = r.varint(), r.u8(), r.u8(), r.u8()
        shapes = tuple((r.varint(), r.varint())[::-1] for _ in range(planes))
        if not planes or not block or any(not 0 < h * w < MOST_SAMPLES for h, w in shapes):
            raise ValueError("the header is damaged")
        heads.append(((count, shapes, block), flags, r))
    out: list[list[list[np.ndarray]]] = [[] for _ in data]
    for places in side_by_side([h[0] for h in heads]):
        count, shapes, block = heads[places[0]][0]
        tables = [[heads[k][2].raw(heads[k][2].varint()) for _ in range(count - 1)] for k in places]
        n = max(coders_of(*s) for s in shapes)
        bank, readers, coders = Bank(copies=len(places)), [_Blocks() for _ in places], RowCoders(n * len(places), [u for k in places for u in _get_streams(heads[k][2], n)])
        for f in range(count):
            blocks = [reader.read(t[f - 1], (-(-shapes[0][0] // block), -(-shapes[0][1] // block))) for reader, t in zip(readers, tables)] if f else []
            side, frame = None, []
            for p, (h, w) in enumerate(shapes):
                inter = _inters([out[k][-1][p] for k in places], blocks, block, shapes[0]) if f else (None, None)
                stack, sizes = code_planes(bank, p, h, w, None, coders, side if p in (1, 2) else None, *inter)
                side = sizes if p == 0 else side
                frame.append(stack)
            for c, k in enumerate(places):
                out[k].append([stack[c] for stack in frame])
    return [[inverse_colour(f[:3]) + f[3:] for f in frames] if h[1] & COLOUR else frames for h, frames in zip(heads, out)]


def decode_clip(data: bytes) -> list[list[np.ndarray]]:
    if data[:4] == PARTS:
        return [f for frames in decode_clips(split_parts(data)) for f in frames]
    return decode_clips([data])[0]


class FrameCoder:
    """Codes frames one by one, or decodes them: statistics, block tables and the last frame go on from frame to frame, so
    a frame can leave as soon as it is there. Both sides need the same frames in the same order.

    A frame's stream: magic, planes, whether it follows another, block size, plane sizes, the block table if it does, units.
    """

    def __init__(self, block: int = motion.BLOCK):
        self.bank, self.table, self.block = Bank(), _Blocks(), block
        self.last: list[np.ndarray] | None = None

    def encode(self, frame: list[np.ndarray]) -> bytes:
        shapes = [p.shape for p in frame]
        if not 1 <= len(frame) <= 4 or any(not h or not w for h, w in shapes) or self.last is not None and [p.shape for p in self.last] != shapes:
            raise ValueError("frames have one to four planes, of the same sizes as those before")
        out, blocks = [FRAME, bytes((len(frame), self.last is not None, self.block)), *(varint(w) + varint(h) for h, w in shapes)], None
        if self.last is not None:
            blocks = motion.modes(frame[0], self.last[0], self.block)[:3]
            raw = self.table.write(*blocks)
            out.append(varint(len(raw)) + raw)
        coders = RowCoders(max(coders_of(*s) for s in shapes))
        self._planes(shapes, blocks, coders, frame)
        self.last = frame
        return _sealed(b"".join([*out, _put_streams(coders.finish())]))

    def decode(self, payload: bytes) -> list[np.ndarray]:
        r = _opened(payload, FRAME)
        planes, follows, block = r.u8(), r.u8(), r.u8()
        shapes = [(r.varint(), r.varint())[::-1] for _ in range(planes)]
        if not 1 <= planes <= 4 or not block or bool(follows) != (self.last is not None) or any(not 0 < h * w < MOST_SAMPLES for h, w in shapes):
            raise ValueError("the frame doesn't follow those before")
        blocks = self.table.read(r.raw(r.varint()), (-(-shapes[0][0] // block), -(-shapes[0][1] // block))) if follows else None
        self.block = block
        n = max(coders_of(*s) for s in shapes)
        self.last = self._planes(shapes, blocks, RowCoders(n, _get_streams(r, n)), None)
        return self.last

    def _planes(self, shapes: list[tuple[int, int]], blocks, coders: RowCoders, frame: list[np.ndarray] | None) -> list[np.ndarray]:
        side, out = None, []
        for p, (h, w) in enumerate(shapes):
            moved, temporal = _inter(self.last[p], blocks, self.block, shapes[0]) if blocks is not None else (None, None)
            plane, sizes = code_plane(self.bank, p, h, w, frame[p] if frame else None, coders, side=side if p in (1, 2) else None, moved=moved, temporal=temporal)
            side = sizes if p == 0 else side
            out.append(plane)
        return out


def header(data: bytes) -> dict:
    """What a stream's header says, without decoding samples. A foreign magic raises ValueError."""
    r = Reader(data, 4)
    if data[:4] == IMAGE:
        width, height, channels, flags = r.varint(), r.varint(), r.u8(), r.u8()
        return {"kind": "image", "width": width, "height": height, "planes": channels, "frames": 1, "colour": bool(flags & COLOUR), "block": None, "samples": width * height * channels}
    if data[:4] == CLIP:
        frames, planes, flags, block = r.varint(), r.u8(), r.u8(), r.u8()
        shapes = [(r.varint(), r.varint()) for _ in range(planes)]
        return {"kind": "clip", "width": shapes[0][0], "height": shapes[0][1], "planes": planes, "frames": frames, "colour": bool(flags & COLOUR), "block": block, "samples": frames * sum(w * h for w, h in shapes)}
    if data[:4] == PARTS:
        clip, width, height, planes, frames, colour, block, samples = r.u8(), r.varint(), r.varint(), r.u8(), r.varint(), r.u8(), r.u8(), r.varint()
        return {"kind": "clip" if clip else "image", "width": width, "height": height, "planes": planes, "frames": frames, "colour": bool(colour), "block": block or None, "samples": samples}
    raise ValueError("a foreign stream")


# ---------------------------------------------------------------- DataFrames


STREAM_SCHEMA = "media_id string, kind string, payload binary, n_bytes long, raw_bytes long, nonzero long, plain_bits long, length_bits long"


def _ordered(table: pa.Table) -> list[tuple[int, int, np.ndarray]]:
    rows = zip(*(table.column(c).to_pylist() for c in ("frame_no", "plane_no", "width", "height")), table.column("data"))
    return sorted(((f, p, np.frombuffer(d.as_buffer(), np.uint8).reshape(h, w)) for f, p, w, h, d in rows), key=lambda x: x[:2])


def gathered(cut: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, planes): a row for each part. Tasks are few, so that each has parts to take side by side."""
    planes = F.sort_array(F.collect_list(F.struct("frame_no", "plane_no", "width", "height", "data"))).alias("planes")  # one part's
    return cut.repartition(cut.sparkSession.sparkContext.defaultParallelism, *keys).groupBy(*keys).agg(planes)


def part_frames(planes: list[dict]) -> list[list[np.ndarray]]:
    """The frames of a part, their planes in order."""
    frames: dict[int, list[np.ndarray]] = {}
    for p in planes:
        frames.setdefault(p["frame_no"], []).append(np.frombuffer(p["data"], np.uint8).reshape(p["height"], p["width"]))
    return list(frames.values())


PART_SCHEMA = "media_id string, part int, kind string, payload binary, raw_bytes long, nonzero long, plain_bits long, length_bits long"


def cut_media(planes: DataFrame, band_samples: int = BAND_SAMPLES, group_frames: int = GROUP_FRAMES) -> DataFrame:
    """Packed planes in parts: bands of rows of images, groups of frames of clips (media with several frames)."""
    sizes = planes.groupBy("media_id").agg((F.max("frame_no") > F.min("frame_no")).alias("clip"), F.min("frame_no").alias("_f"), F.sum("width").alias("_w"))
    rows = planes.join(sizes, "media_id").withColumn("_r", F.expr(f"CAST(IF(clip, height, greatest(16, {band_samples} div _w)) AS INT)"))
    bands = F.expr(f"IF(clip, array(CAST((frame_no - _f) div {group_frames} AS INT)), sequence(0, CAST((height - 1) div _r AS INT)))")
    rows = rows.withColumn("part", F.explode(bands)).withColumn("_a", F.expr("IF(clip, 0, part * _r)"))
    return rows.select("media_id", "part", "clip", "frame_no", "plane_no", "width", F.expr("least(_r, height - _a)").cast("int").alias("height"), F.expr("substring(data, _a * width + 1, _r * width)").alias("data"))


def encode_media(planes: DataFrame, colour_clips: bool | None = None, band_samples: int = BAND_SAMPLES, group_frames: int = GROUP_FRAMES) -> DataFrame:
    """Packed planes to one stream per media_id: a clip if there are several frames, else an image.

    Bands and groups are coded side by side in tasks of their own, so a medium may be larger than a task's memory until
    its parts, coded, are put together. colour_clips: as encode_clip's colour.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            parts = [part_frames(p) for p in rows.column(3).to_pylist()]
            medium, part, clip = (rows.column(k).to_pylist() for k in range(3))
            for places in side_by_side([(clip[k], len(parts[k]), *(p.shape for f in parts[k] for p in f)) for k in range(len(parts))]):
                coded = [(c, {}) for c in encode_clips([parts[k] for k in places], colour_clips)] if clip[places[0]] else encode_images([parts[k][0] for k in places])
                values = [(medium[k], part[k], "clip" if clip[k] else "image", payload, sum(p.size for f in parts[k] for p in f), *(found.get(c) for c in ("nonzero", "plain_bits", "length_bits"))) for k, (payload, found) in zip(places, coded)]
                kinds = [pa.string(), pa.int32(), pa.string(), pa.binary(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*values), kinds)], names=[x.split()[0] for x in PART_SCHEMA.split(", ")])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = [join_parts([p["payload"] for p in parts]) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(streams, pa.binary()), pa.array([len(x) for x in streams], pa.int64()), *batch.columns[3:]], names=[x.split()[0] for x in STREAM_SCHEMA.split(", ")])

    parts = gathered(cut_media(planes, band_samples, group_frames), ["media_id", "part", "clip"]).mapInArrow(encode, PART_SCHEMA)
    sums = [F.sum(c).cast("long").alias(c) for c in ("raw_bytes", "nonzero", "plain_bits", "length_bits")]
    whole = parts.groupBy("media_id").agg(F.first("kind").alias("kind"), F.sort_array(F.collect_list(F.struct("part", "payload"))).alias("parts"), *sums)  # one medium's coded parts
    return whole.mapInArrow(joined, STREAM_SCHEMA)


PLANE_SCHEMA = "media_id string, frame_no int, plane_no int, width int, height int, data binary"


def decode_bands(streams: DataFrame) -> DataFrame:
    """Streams (media_id, payload) to the bands of their planes (media_id, frame_no, plane_no, top, width, height, data),
    as they are decoded: no task holds a plane of many bands. Parts are decoded side by side."""
    schema = "media_id string, frame_no int, plane_no int, top int, width int, height int, data binary"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for media, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = split_parts(payload)
                heads, clip = [header(p) for p in parts], header(payload)["kind"] == "clip"
                before = np.cumsum([0, *(h["frames" if clip else "height"] for h in heads)])[:-1].astype(np.int32)
                none = np.zeros(len(parts), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([media] * len(parts)), pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(before if clip else none), pa.array(none if clip else before), pa.array(parts, pa.binary())], names=["media_id", "part", "first", "top", "payload"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = list(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))))
            clips = [k for k, (*_, payload) in enumerate(every) if payload[:4] == CLIP]
            others = [k for k, (*_, payload) in enumerate(every) if payload[:4] != CLIP]
            back = dict(zip(clips, decode_clips([every[k][3] for k in clips]))) | dict(zip(others, ([i] for i in decode_images([every[k][3] for k in others]))))
            for k, (media, first, top, _) in enumerate(every):
                rows = [(media, first + f, p, top, plane.shape[1], plane.shape[0], plane.tobytes()) for f, planes in enumerate(back[k]) for p, plane in enumerate(planes)]
                kinds = [pa.string(), *[pa.int32()] * 5, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    parts = streams.select("media_id", "payload").mapInArrow(split, "media_id string, part int, first int, top int, payload binary").repartition(streams.sparkSession.sparkContext.defaultParallelism, "media_id", "part")
    return parts.mapInArrow(decode, schema)


def decode_media(streams: DataFrame) -> DataFrame:
    """Streams (media_id, payload) to packed planes."""
    bands = F.sort_array(F.collect_list(F.struct("top", "data"))).alias("b")  # one plane's bands
    whole = decode_bands(streams).groupBy("media_id", "frame_no", "plane_no").agg(F.first("width").alias("width"), F.sum("height").cast("int").alias("height"), bands)
    return whole.select("media_id", "frame_no", "plane_no", "width", "height", F.expr("IF(size(b) = 1, b[0].data, unhex(array_join(transform(b, x -> hex(x.data)), '')))").alias("data"))


#: Bytes of a stream that hold any header of up to MOST_PLANES planes.
HEAD, MOST_PLANES = 192, 16


def _fields(kinds: str, wanted: str) -> Column:
    """The first numbers of a header, read from `head` behind its magic: an array of longs.

    kinds: an array expression, 1 where a field is a LEB128 number (7 bits a byte, lowest first), 0 where it is one byte;
    fields beyond it are LEB128. wanted: how many there are, an expression over the fields done so far.
    """
    number = F.expr(kinds)

    def step(state: Column, at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("head"), at, F.lit(1))), 16, 10).cast("long")
        longer = (F.coalesce(F.get(number, F.size(state["done"])), F.lit(1)) == 1) & (byte >= 128)
        now = F.try_add(state["now"], F.try_multiply(F.when(longer, byte - 128).otherwise(byte), F.when(state["shift"] < 63, F.call_function("shiftleft", F.lit(1).cast("long"), state["shift"]))))
        more = F.struct(state["done"].alias("done"), now.alias("now"), (state["shift"] + 7).alias("shift"))
        done = F.struct(F.concat(state["done"], F.array(now)).alias("done"), F.lit(0).cast("long").alias("now"), F.lit(0).alias("shift"))
        full = F.size(state["done"]) >= _wanted(wanted, state["done"])
        return F.when(full | byte.isNull(), state).when(longer, more).otherwise(done)

    start = F.struct(F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("done"), F.lit(0).cast("long").alias("now"), F.lit(0).alias("shift"))
    places = F.expr("sequence(5, greatest(5, octet_length(head)))")
    return F.aggregate(places, start, step, lambda s: F.when(F.size(s["done"]) >= _wanted(wanted, s["done"]), s["done"]))


def _wanted(wanted: str, done: Column) -> Column:
    if wanted != "planes":
        return F.lit(int(wanted))
    return F.lit(4) + 2 * F.coalesce(F.get(done, F.lit(1)), F.lit(MOST_PLANES)).cast("int")  # a clip's sizes follow its four fields


def stream_info(streams: DataFrame) -> DataFrame:
    """What headers say, by Catalyst alone: the magic by substring, the fields by a fold over the first bytes.

    Only those bytes are looked at, not the payload. A foreign or cut header stops the query; a number of samples that
    doesn't fit 64 bits is null.
    """
    rows = streams.select("media_id", F.substring("payload", 1, HEAD).alias("head"), F.octet_length("payload").cast("long").alias("n_bytes"))
    magic = F.hex(F.substring("head", 1, 4))
    named = {IMAGE: ("array(1, 1, 0, 0)", "4"), CLIP: ("array(1, 0, 0, 0)", "planes"), PARTS: ("array(0, 1, 1, 0, 1, 0, 0, 1)", "8")}
    foreign = F.raise_error(F.concat(F.col("media_id"), F.lit(": a foreign or damaged stream")))
    fields = foreign.cast("array<bigint>")
    for mark, (kinds, wanted) in named.items():
        fields = F.when(magic == mark.hex().upper(), F.coalesce(_fields(kinds, wanted), foreign.cast("array<bigint>"))).otherwise(fields)
    rows = rows.select("media_id", "n_bytes", magic.alias("magic"), fields.alias("f"))
    image, clip = (F.col("magic") == m.hex().upper() for m in (IMAGE, CLIP))
    get = lambda k: F.get(F.col("f"), F.lit(k))
    pick = lambda a, b, c: F.when(image, a).when(clip, b).otherwise(c)
    pixels = F.aggregate(F.expr("sequence(0, CAST(greatest(0, size(f) - 6) div 2 AS INT))"), F.lit(0).cast("long"), lambda s, k: F.try_add(s, F.try_multiply(F.get(F.col("f"), 4 + 2 * k), F.get(F.col("f"), 5 + 2 * k))))
    told = {
        "kind": pick(F.lit("image"), F.lit("clip"), F.when(get(0) == 0, "image").otherwise("clip")),
        "width": pick(get(0), get(4), get(1)).cast("int"), "height": pick(get(1), get(5), get(2)).cast("int"),
        "planes": pick(get(2), get(1), get(3)).cast("int"), "frames": pick(F.lit(1), get(0), get(4)).cast("int"),
        "colour": pick(get(3).bitwiseAND(F.lit(COLOUR)) > 0, get(2).bitwiseAND(F.lit(COLOUR)) > 0, get(5) > 0),
        "block": pick(F.lit(None), get(3), F.when(get(6) > 0, get(6))).cast("int"),
        "samples": pick(F.try_multiply(F.try_multiply(get(0), get(1)), get(2)), F.try_multiply(get(0), pixels), get(7)),
    }
    out = rows.select("media_id", *(c.alias(n) for n, c in told.items()), "n_bytes")
    return out.withColumn("bits_per_sample", F.try_divide(8 * F.col("n_bytes"), F.col("samples")))
