"""YUV4MPEG2 clips: header and frame scan through Spark's binary reader, a data source that splits files by frames, and
sinks. Only 8-bit formats are read; the header's rate and colour space stay with the frames, so a clip is written back
as it was."""

from __future__ import annotations

import fnmatch
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

MAGIC = b"YUV4MPEG2"
#: Colour spaces to chroma steps (vertical, horizontal), None: no chroma (fixed values).
SUBSAMPLING = {"420": (2, 2), "420jpeg": (2, 2), "420mpeg2": (2, 2), "420paldv": (2, 2), "422": (1, 2), "444": (1, 1), "mono": None}
FRAMES_PER_PARTITION = 64
SCHEMA = "media_id string, frame_no int, plane_no int, width int, height int, data binary, colourspace string, rate string"


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    colourspace: str = "420jpeg"
    rate: str = "25:1"
    interlace: str = "p"
    aspect: str = "0:0"
    size: int = 0  # bytes of the header line

    def shapes(self) -> list[tuple[int, int]]:
        step = SUBSAMPLING[self.colourspace]
        luma = (self.height, self.width)
        return [luma] if step is None else [luma, *[(-(-self.height // step[0]), -(-self.width // step[1]))] * 2]

    def frame_bytes(self) -> int:
        return sum(h * w for h, w in self.shapes())

    def line(self) -> bytes:
        return f"YUV4MPEG2 W{self.width} H{self.height} F{self.rate} I{self.interlace} A{self.aspect} C{self.colourspace}\n".encode()


def parse_header(data: bytes) -> Header:
    """The first line. Foreign files, unknown colour spaces and more than 8 bits raise ValueError."""
    end = data.find(b"\n")
    if not data.startswith(MAGIC + b" ") or end < 0:
        raise ValueError("not a YUV4MPEG2 file")
    tags = {t[:1]: t[1:] for t in data[:end].decode("ascii", "replace").split(" ")[1:] if t}
    colour = tags.get("C", "420jpeg")
    if colour not in SUBSAMPLING:
        raise ValueError(f"colour space {colour} isn't read here")
    if not re.fullmatch("[1-9][0-9]*", tags.get("W", "")) or not re.fullmatch("[1-9][0-9]*", tags.get("H", "")):
        raise ValueError("the header has no size")
    return Header(int(tags["W"]), int(tags["H"]), colour, tags.get("F", "25:1"), tags.get("I", "p"), tags.get("A", "0:0"), end + 1)


def frames(data: bytes, limit: int | None = None) -> Iterator[list[np.ndarray]]:
    """Each frame's planes; a short last frame is left out, a wrong frame mark raises ValueError."""
    head = parse_header(data)
    at, k = head.size, 0
    while at < len(data) and (limit is None or k < limit):
        end = data.find(b"\n", at)
        if end < 0:
            return
        if not data[at:end].startswith(b"FRAME"):
            raise ValueError("a frame doesn't start with its mark")
        at = end + 1
        if at + head.frame_bytes() > len(data):
            return
        planes = []
        for h, w in head.shapes():
            planes.append(np.frombuffer(data, np.uint8, h * w, at).reshape(h, w))
            at += h * w
        yield planes
        k += 1


def write(clip: list[list[np.ndarray]], head: Header) -> bytes:
    shapes = head.shapes()
    if any([p.shape for p in f] != shapes for f in clip):
        raise ValueError("frames don't have the header's sizes")
    return head.line() + b"".join(b"FRAME\n" + b"".join(p.astype(np.uint8).tobytes() for p in f) for f in clip)


def _rows(name: str, k: int, planes: list[np.ndarray], head: Header) -> list[tuple]:
    return [(name, k, p, plane.shape[1], plane.shape[0], plane.tobytes(), head.colourspace, head.rate) for p, plane in enumerate(planes)]


def scan(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Packed planes of y4m files in any store that Spark reads; a file is one task's work."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                head = parse_header(content)
                for k, planes in enumerate(frames(content, limit)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*_rows(name, k, planes, head)), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.mapInArrow(read, SCHEMA)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, colourspace, rate, frames: from the header line and the length only."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.substring("content", 1, 512).alias("head"))
    schema = "path string, width int, height int, colourspace string, rate string, frames long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [parse_header(h) for h in batch.column(2).to_pylist()]
            counts = [(n - h.size) // (h.frame_bytes() + 6) for n, h in zip(batch.column(1).to_pylist(), heads)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.width for h in heads], pa.int32()), pa.array([h.height for h in heads], pa.int32()), pa.array([h.colourspace for h in heads]), pa.array([h.rate for h in heads]), pa.array(counts, pa.int64())], names=[x.split()[0] for x in schema.split(", ")])

    return files.mapInArrow(read, schema)


def to_y4m(planes: DataFrame) -> DataFrame:
    """media_id, content: each clip as a file's bytes, frames in order; columns colourspace and rate are used if there."""
    named = {c: F.col(c) if c in planes.columns else F.lit(d) for c, d in (("colourspace", "420jpeg"), ("rate", "25:1"))}

    def make(key: tuple, rows: pa.Table) -> pa.Table:
        from rasterloom.operators.codec import _ordered

        clip: dict[int, list[np.ndarray]] = {}
        for f, _, plane in _ordered(rows):
            clip.setdefault(f, []).append(plane)
        h, w = next(iter(clip.values()))[0].shape
        head = Header(w, h, rows.column("colourspace")[0].as_py(), rows.column("rate")[0].as_py())
        return pa.table({"media_id": pa.array([key[0].as_py()]), "content": pa.array([write([clip[f] for f in sorted(clip)], head)], pa.binary())})

    return planes.withColumns(named).groupBy("media_id").applyInArrow(make, "media_id string, content binary")


# ---------------------------------------------------------------- data source


class Y4mSource(DataSource):
    """spark.read.format("y4m").load(path): clips split into runs of frames, read by byte ranges.

    Options: path (a file or folder; a local path or a URI of a store that Arrow opens), limit (frames of each clip).
    Filters on frame_no and plane_no are pushed down where the session allows it (register() does): frames and planes
    that they rule out are never read. Files of a folder named <clip>-<first frame>.y4m are parts of one clip.
    Writing takes either whole files (media_id, content) or planes, see save().
    """

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Y4mReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return (_Y4mWriter if "content" in schema.names else _PartWriter)(self.options, schema.names)


#: Name of a part: the clip's and its first frame's.
PART_NAME = re.compile(r"(.*)-(\d{9,})")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path or URI names, and the path within it."""
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def _open(path: str):
    """A file that can be read at any place (a seam for tests)."""
    store, name = _store(path)
    return store.open_input_file(name)


@dataclass
class _Run(InputPartition):
    path: str
    media: str
    base: int  # number of the file's first frame
    first: int  # from here in the file
    count: int


@dataclass
class _Range:
    """Whole numbers that the pushed filters on a column leave."""

    low: int = 0
    high: int = 1 << 31
    listed: set | None = None

    def push(self, f: Filter) -> bool:
        """Takes a filter on the column, if it is one of those that name a range or a list."""
        if isinstance(f, IsNotNull):
            return True
        if isinstance(f, In):
            values = {v for v in f.value if v is not None}
            self.listed = values if self.listed is None else self.listed & values
            return True
        if not isinstance(f, EqualTo | LessThan | LessThanOrEqual | GreaterThan | GreaterThanOrEqual) or f.value is None:
            return False
        if not isinstance(f, LessThan | LessThanOrEqual):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        if not isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
        return True

    def holds(self, k: int) -> bool:
        return self.low <= k < self.high and (self.listed is None or k in self.listed)


class _Y4mReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.ranges = {("frame_no",): _Range(), ("plane_no",): _Range()}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            held = self.ranges.get(getattr(f, "attribute", None))
            if held is None or not held.push(f):
                yield f

    def _files(self) -> list[tuple[str, int]]:
        """Paths and sizes of the files that the path names."""
        store, name = _store(self.path)
        prefix = self.path[: len(self.path) - len(name)] if "://" in self.path and self.path.endswith(name) else ""
        pattern = None
        if "*" in name or "?" in name:
            name, pattern = os.path.split(name)
        info = store.get_file_info(name)
        if info.type == fs.FileType.File:
            return [(prefix + name, info.size)]
        found = store.get_file_info(fs.FileSelector(name, allow_not_found=True))
        wanted = [x for x in found if x.type == fs.FileType.File and (fnmatch.fnmatch(x.base_name, pattern) if pattern else x.base_name.endswith(".y4m")) and not x.base_name.startswith((".", "_"))]
        return sorted((prefix + x.path, x.size) for x in wanted)

    def partitions(self) -> list[_Run]:
        frames = self.ranges["frame_no",]
        runs = []
        for path, size in self._files():
            stem = os.path.basename(path).removesuffix(".y4m")
            part = PART_NAME.fullmatch(stem)
            media, base = (part[1], int(part[2])) if part else (path, 0)
            high = min(frames.high, self.limit if self.limit is not None else frames.high)
            if base >= high:
                continue
            with _open(path) as f:
                head = parse_header(f.read(4096))
            n = (size - head.size) // (head.frame_bytes() + 6)
            low, high = max(frames.low - base, 0), min(n, high - base)
            runs += [_Run(path, media, base, k, min(FRAMES_PER_PARTITION, high - k)) for k in range(low, high, FRAMES_PER_PARTITION) if any(frames.holds(base + i) for i in range(k, min(k + FRAMES_PER_PARTITION, high)))]
        return runs or [_Run("", "", 0, 0, 0)]

    def read(self, run: _Run) -> Iterator[tuple]:
        if not run.count:
            return
        frames, planes = self.ranges["frame_no",], self.ranges["plane_no",]
        with _open(run.path) as f:
            head = parse_header(f.read(4096))
            step = head.frame_bytes() + 6  # a frame's mark is 6 bytes long where it has no tags
            for k in range(run.first, run.first + run.count):
                if not frames.holds(run.base + k):
                    continue
                f.seek(at := head.size + k * step)
                if f.read(6) != b"FRAME\n":
                    raise ValueError("a frame doesn't start with a plain mark; read this file with y4m.scan")
                at += 6
                for p, (h, w) in enumerate(head.shapes()):
                    if planes.holds(p):
                        f.seek(at)
                        yield run.media, run.base + k, p, w, h, f.read(h * w), head.colourspace, head.rate
                    at += h * w


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


def _safe(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "_", os.path.basename(name).removesuffix(".y4m"))


class _Writer(DataSourceWriter):
    """Files under temporary names until all tasks are done; what a failed or repeated task left is never seen."""

    def __init__(self, options: dict, names: list[str]):
        self.folder, self.names = options["path"], names

    def _temporary(self, name: str) -> str:
        return f"_temporary.{uuid.uuid4().hex}.{name}.y4m"

    def commit(self, messages: list) -> None:
        store, folder = _store(self.folder)
        store.create_dir(folder, recursive=True)
        for m in messages:
            for name in m.files if m else []:
                final = f"{folder}/{name.split('.', 2)[2]}"
                if store.get_file_info(final).type == fs.FileType.File:
                    store.delete_file(final)
                store.move(f"{folder}/{name}", final)

    def abort(self, messages: list) -> None:
        store, folder = _store(self.folder)
        for m in messages:
            for name in m.files if m else []:
                store.delete_file(f"{folder}/{name}")


class _Y4mWriter(_Writer):
    """One file per row (media_id, content)."""

    def write(self, rows: Iterator) -> _Written:
        store, folder = _store(self.folder)
        store.create_dir(folder, recursive=True)
        at = self.names.index("media_id"), self.names.index("content")
        files = []
        for row in rows:
            files.append(name := self._temporary(_safe(row[at[0]])))
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write(row[at[1]])
        return _Written(files)


class _PartWriter(_Writer):
    """Planes in order of (media_id, frame_no, plane_no), a frame in memory at a time; a file for every run of frames."""

    def write(self, rows: Iterator) -> _Written:
        store, folder = _store(self.folder)
        store.create_dir(folder, recursive=True)
        files, out, head, last = [], None, None, None
        tell = [self.names.index(c) for c in ("media_id", "frame_no", "plane_no", "width", "height", "data", "colourspace", "rate")]

        def put(media: str, k: int, planes: list[tuple]) -> None:
            nonlocal out, head, last
            w, h, colourspace, rate = planes[0][0], planes[0][1], planes[0][3], planes[0][4]
            now = Header(w, h, colourspace, rate)
            if [(p[1], p[0]) for p in planes] != now.shapes():
                raise ValueError(f"{media}: the planes of frame {k} don't have the colour space's sizes")
            if out is None or (media, k) != (last[0], last[1] + 1) or k // FRAMES_PER_PARTITION != last[1] // FRAMES_PER_PARTITION:
                if out is not None:
                    out.close()
                files.append(name := self._temporary(f"{_safe(media)}-{k:09d}"))
                out, head = store.open_output_stream(f"{folder}/{name}"), now
                out.write(head.line())
            elif now != head:
                raise ValueError(f"{media}: frame {k} doesn't have the sizes of those before")
            out.write(b"FRAME\n")
            for p in planes:
                out.write(p[2])
            last = media, k

        frame, held = None, []
        for row in rows:
            media, k, _, *plane = (row[i] for i in tell)
            if frame is not None and frame != (media, k):
                put(*frame, held)
                held = []
            frame = media, k
            held.append(plane)
        if held:
            put(*frame, held)
        if out is not None:
            out.close()
        return _Written(files)


def save(planes: DataFrame, path: str, colourspace: str | None = None, rate: str = "25:1") -> None:
    """Writes packed planes as y4m files, a part of FRAMES_PER_PARTITION frames each: a long clip is many tasks' work.

    Without columns colourspace and rate: `mono` for one plane a frame, else 420jpeg, unless named.
    """
    register(planes.sparkSession)
    if "colourspace" not in planes.columns:
        # A frame's planes decide; they come together anyway.
        many = F.max("plane_no").over(Window.partitionBy("media_id", "frame_no")) > 0
        planes = planes.withColumn("colourspace", F.lit(colourspace) if colourspace else F.when(many, "420jpeg").otherwise("mono"))
    if "rate" not in planes.columns:
        planes = planes.withColumn("rate", F.lit(rate))
    part = F.expr(f"frame_no div {FRAMES_PER_PARTITION}")
    rows = planes.select("media_id", "frame_no", "plane_no", "width", "height", "data", "colourspace", "rate")
    rows.repartition("media_id", part).sortWithinPartitions("media_id", "frame_no", "plane_no").write.format("y4m").mode("append").save(path)


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Y4mSource)
