"""Token-id files: an adaptive context-mixing range coder over ids, in independently reset, checksummed blocks.

For each id, a hashed table of the last two ids (order 2) and one of the last id (order 1) predict a candidate; adaptive
probabilities of the candidate, by the confidence of order 2 and of order 1 and by how often the id came at all (order
0), are mixed in the logistic domain by adaptive weights, and code whether the candidate is right. A missed id is
coded by the block's adaptive order-0 distribution: its range of ids by how often the range was missed in, then its
place in the range. Decisions drive a carry-less range coder of 64-bit bounds and 16-bit units.

Blocks share nothing, so a batch of blocks is coded side by side in lanes: one step codes the next id of each.

Layout of a block (little-endian): magic `RLB2`, u32 ids, u32 steps (ids with padding), u32 vocabulary, u32 documents
that start here, u32 crc32 of the ids as u32, then per document i64 id and u64 ids, then the coded 16-bit units
(zero bytes at the end are left out).

Defined results: null text is empty (the end id alone); a text of any length may go on through any number of blocks;
repeated rows are written each; rows of one doc_id follow each other in the order of their texts' hashes; rows without
doc_id come first, written as the smallest 64-bit number, and are read back as null (so is that number); an empty table
gives files without blocks and no rows. Further columns are not read.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC, HEAD = b"RLB2", struct.Struct("<4sIIIII")
LANES, BLOCK, LEAST_LANES = 512, 8192, 128
TWO_BITS, ONE_BITS, ZERO_BITS = 13, 12, 13
RESHAPE, EARLY = 512, {8, 32, 64, 128, 256}  # steps after which the distribution of missed ids takes up what came since
GAIN, RANGES = 24, 512
PART_BYTES = 10 << 20
WIDE, TIGHT, UNIT, ONES = np.uint64(1 << 48), np.uint64(1 << 40), np.uint64(16), np.uint64(0xFFFF)
#: 12-bit probabilities to log odds in 1/256, and back.
STRETCH = np.array([round(256 * math.log((k + 0.5) / (4096 - k - 0.5))) for k in range(4096)], np.int64)
SQUASH = np.array([min(4080, max(16, round(4096 / (1 + math.exp(-(k - 2048) / 256))))) for k in range(4096)], np.uint64)
LEVEL = np.array([min(15, int(k).bit_length() * 2 - (k > 0 and k < 3 << max(int(k).bit_length() - 2, 0))) for k in range(256)], np.int64)


def id_ranges(vocabulary: int) -> np.ndarray:
    """First ids of the ranges that missed ids fall into: RANGES to each doubling, so frequent (small) ids have their own."""
    edges, width, at = {0, vocabulary}, 1, 0
    while at < vocabulary:
        for _ in range(2 * RANGES if width == 1 else RANGES):
            edges.add(min(at, vocabulary))
            at += width
        width *= 2
    return np.array(sorted(edges), np.int64)


class Lanes:
    """The models and coder states of a batch of blocks, one block a lane."""

    def __init__(self, lanes: int, steps: int, vocabulary: int, data: list[np.ndarray] | None = None):
        n = self.n = lanes
        self.steps = steps
        self.first = id_ranges(vocabulary)
        self.width = np.diff(self.first)
        ranges = self.ranges = len(self.width)
        row = self.row = np.arange(n)
        self.low, self.high = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
        # Candidates (id << 3 | confidence) after the last two ids, then after the last one.
        self.guess = np.zeros((n << TWO_BITS) + (n << ONE_BITS), np.int32)
        self.guess_at = np.stack([row << TWO_BITS, (n << TWO_BITS) + (row << ONE_BITS)])
        self.count, self.count_at = np.zeros(n << ZERO_BITS, np.uint8), row << ZERO_BITS
        self.odds = np.full(3 * n * 16, 32768, np.int64)
        self.odds_at = np.arange(3 * n).reshape(3, n) * 16
        self.weight = np.full((3, n), 24000, np.int64)
        self.missed = np.zeros((n, ranges), np.int32)
        self.sums = np.zeros((n, ranges + 1), np.int32)
        if data is None:
            self.room = 4 * steps + 16
            self.out, self.put = np.zeros(n * self.room, np.uint16), row * self.room
        else:
            most = max(len(d) for d in data) + 16
            self.input = np.zeros(n * most, np.uint64)
            for k, d in enumerate(data):
                self.input[k * most : k * most + len(d)] = d
            self.get, self.last = row * most, row * most + most - 1
            self.code = np.zeros(n, np.uint64)
            for _ in range(4):
                self.code = self.code << UNIT | self.input[self.get]
                self.get += 1

    def reshape(self) -> None:
        """Cumulative frequencies of the ranges, each lane's above those of the lane before it."""
        np.cumsum(1 + GAIN * self.missed, axis=1, out=self.sums[:, 1:])
        self.total = self.sums[:, -1].astype(np.uint64)
        self.marks = (self.sums + (self.row << 32)[:, None]).ravel()

    def run(self, ids: np.ndarray | None) -> np.ndarray:
        """Codes ids (lanes x steps), or decodes them where ids is None."""
        encode = ids is not None
        got = np.zeros((self.steps, self.n), np.int32)
        want = np.ascontiguousarray(ids.T.astype(np.int64)) if encode else None
        n, guess, count, odds = self.n, self.guess, self.count, self.odds
        two_mask, one_mask, zero_mask = (1 << TWO_BITS) - 1, (1 << ONE_BITS) - 1, (1 << ZERO_BITS) - 1
        one_hash, two_part = np.zeros(n, np.int64), np.zeros(n, np.int64)
        i, k = np.empty((2, n), np.int64), np.empty((3, n), np.int64)
        twelve = np.uint64(12)
        for t in range(self.steps):
            if t % RESHAPE == 0 or t in EARLY:
                self.reshape()
            i[0] = (one_hash ^ two_part) >> 7 & two_mask
            i[1] = one_hash >> 9 & one_mask
            i += self.guess_at
            e = guess.take(i).astype(np.int64)
            sure, said = e & 7, e >> 3
            c = np.where(sure[0] > 0, said[0], said[1])
            zero = self.count_at + ((c ^ c >> 9) & zero_mask)
            k[:2] = sure
            k[:2] *= 2
            k[0] += said[0] == said[1]
            k[1] += said[1] == c
            k[2] = LEVEL.take(count.take(zero))
            k += self.odds_at
            q = odds.take(k)
            s = STRETCH.take(q >> 4)
            mixed = np.add.reduce(self.weight * s) >> 16
            mixed += 2048
            p = SQUASH.take(mixed, mode="clip")
            edge = self.low + ((self.high - self.low) >> twelve) * p
            if encode:
                now = want[t]
                hit = now == c
            else:
                hit = self.code <= edge
                now = c
            miss = np.flatnonzero(~hit)
            self.high = np.where(hit, edge, self.high)
            if len(miss):
                now = self.code_missed(miss, edge[miss] + np.uint64(1), now, encode)
            self.shift(encode)
            got[t] = now
            truth = hit.astype(np.int64)
            error = ((truth << 12) - p.astype(np.int64)) * 6
            s *= error
            s >>= 10
            self.weight += s
            truth *= 65535
            odds[k] = q + (truth - q >> 5)
            right = (said == now) & (sure > 0)
            fresh = np.where(sure <= 1, (now << 3) + 1, e - sure + (sure >> 1))
            guess[i] = np.where(right, e + (sure < 7), fresh)
            zero = self.count_at + ((now ^ now >> 9) & zero_mask)
            seen = count.take(zero)
            count[zero] = seen + (seen < 255)
            two_part = one_hash * 5 & 0xFFFFFFFFFF
            one_hash = now * 0x9E3779B1 & 0xFFFFFFFF
        return got.T

    def code_missed(self, miss: np.ndarray, low: np.ndarray, now: np.ndarray, encode: bool) -> np.ndarray:
        """Codes ids that weren't the candidate: the range by how often it was missed in, then evenly within the range."""
        high, ranges = self.high[miss], self.ranges
        part = (high - low) // self.total[miss]
        base = miss * (ranges + 1)
        if encode:
            there = now[miss]
            r = np.searchsorted(self.first, there, "right") - 1
        else:
            value = np.minimum((self.code[miss] - low) // part, self.total[miss] - np.uint64(1)).astype(np.int64)
            r = np.searchsorted(self.marks, value + (miss << 32), "right") - 1 - base
        sums = self.sums.reshape(-1)
        below = sums.take(base + r)
        low = low + part * below.astype(np.uint64)
        part = part * (sums.take(base + r + 1) - below).astype(np.uint64) // self.width.take(r).astype(np.uint64)
        if encode:
            place = there - self.first.take(r)
        else:
            place = np.minimum((self.code[miss] - low) // part, (self.width.take(r) - 1).astype(np.uint64)).astype(np.int64)
            now = now.copy()
            now[miss] = self.first.take(r) + place
        low = low + part * place.astype(np.uint64)
        self.low[miss], self.high[miss] = low, low + part - np.uint64(1)
        self.missed.reshape(-1)[miss * ranges + r] += 1
        return now

    def shift(self, encode: bool) -> None:
        """Moves settled 16-bit units out of (or into) the coder. A narrow range across a border gives up its smaller side."""
        live = np.flatnonzero(((self.low ^ self.high) < WIDE) | (self.high - self.low < TIGHT))
        while len(live):
            low, high = self.low[live], self.high[live]
            across = np.flatnonzero((low ^ high) >= WIDE)
            if len(across):
                a, z = low[across], high[across]
                border = z & ~(WIDE - np.uint64(1))
                left = border - a > z - border
                high[across], low[across] = np.where(left, border - np.uint64(1), z), np.where(left, a, border)
            if encode:
                self.out[self.put[live]] = (low >> np.uint64(48)).astype(np.uint16)
                self.put[live] += 1
            else:
                self.code[live] = self.code[live] << UNIT | self.input[self.get[live]]
                self.get[live] = np.minimum(self.get[live] + 1, self.last[live])
            low, high = low << UNIT, high << UNIT | ONES
            self.low[live], self.high[live] = low, high
            live = live[((low ^ high) < WIDE) | (high - low < TIGHT)]

    def finish(self) -> list[bytes]:
        """Flushes the encoder: the units of each lane."""
        rest = self.low
        for _ in range(4):
            self.out[self.put] = (rest >> np.uint64(48)).astype(np.uint16)
            self.put += 1
            rest = rest << UNIT
        start = self.row * self.room
        return [self.out[a:z].astype("<u2").tobytes().rstrip(b"\0") for a, z in zip(start.tolist(), self.put.tolist())]


@dataclass
class Block:
    """A decoded block: its ids and the documents (id, number of ids) that start in it."""

    ids: np.ndarray
    documents: list[tuple[int, int]]


def encode_blocks(ids: np.ndarray, documents: list[tuple[int, int]], starts: np.ndarray, vocabulary: int, lanes: int = LANES, block: int = BLOCK) -> list[bytes]:
    """Blocks of a stretch of ids; documents start at `starts` in it. At most lanes x block ids."""
    n = len(ids)
    if n > lanes * block:
        raise ValueError("too many ids for a batch")
    if n and int(ids.max()) >= vocabulary:
        raise ValueError("an id is not in the vocabulary")
    steps = max(1, min(block, -(-n // min(lanes, LEAST_LANES))), -(-n // lanes))  # few ids: shorter blocks, so steps stay wide
    used = max(1, -(-n // steps))
    padded = np.zeros(used * steps, np.uint32)
    padded[:n] = ids
    coder = Lanes(used, steps, vocabulary)
    coder.run(padded.reshape(used, steps))
    out = []
    owner = np.minimum(np.asarray(starts, np.int64) // steps, used - 1)
    for k, units in enumerate(coder.finish()):
        own = [documents[i] for i in np.flatnonzero(owner == k).tolist()] if len(documents) else []
        part = np.ascontiguousarray(ids[k * steps : (k + 1) * steps], "<u4")
        head = HEAD.pack(MAGIC, len(part), steps, vocabulary, len(own), zlib.crc32(part.tobytes()))
        out.append(head + b"".join(struct.pack("<qQ", *d) for d in own) + units)
    return out


def decode_blocks(blocks: list[bytes], lanes: int = LANES) -> Iterator[Block]:
    """Decodes blocks in order; a foreign, cut or changed block raises ValueError."""
    heads = []
    for b in blocks:
        if len(b) < HEAD.size or b[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        magic, n, steps, vocabulary, docs, crc = HEAD.unpack_from(b)
        start = HEAD.size + 16 * docs
        if n > steps or not 0 < steps <= 1 << 24 or not 0 < vocabulary <= 1 << 24 or len(b) < start:
            raise ValueError("a block's header is damaged")
        heads.append((n, steps, vocabulary, crc, [struct.unpack_from("<qQ", b, HEAD.size + 16 * k) for k in range(docs)], start))
    a = 0
    while a < len(blocks):
        z = a + 1
        while z < len(blocks) and z - a < lanes and heads[z][1:3] == heads[a][1:3]:
            z += 1
        coder = Lanes(z - a, heads[a][1], heads[a][2], [np.frombuffer(b[h[5] :] + b"\0" * ((len(b) - h[5]) % 2), "<u2") for b, h in zip(blocks[a:z], heads[a:z])])
        try:
            found = coder.run(None)
        except (IndexError, ZeroDivisionError):
            raise ValueError("a block is damaged") from None
        for row, (n, _, _, crc, docs, _) in zip(found, heads[a:z]):
            ids = row[:n].astype("<u4")
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError("a block's checksum differs")
            yield Block(ids, docs)
        a = z


# ---------------------------------------------------------------- tables


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, vocabulary: int = 49408) -> None:
    """Tokenizes texts (null: empty) and writes their ids in ascending doc_id order: rows (part, block_no, block).

    Parts are ranges of doc_id; part numbers and block numbers ascend with doc_id.
    """
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE).cast("long"))
    rows = docs.select(known.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("turn", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = int(max(1, -(-size // PART_BYTES)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part = tokens.tokenizer(tokenizer), TaskContext.get().partitionId()
        held, documents, starts, total, number = [], [], [], 0, 0
        room = LANES * BLOCK

        def flush(most: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, documents, starts, total, number
            ids = np.concatenate(held)
            take = min(most, len(ids))
            now = [k for k, s in enumerate(starts) if s < take]
            blocks = encode_blocks(ids[:take], [documents[k] for k in now], np.array([starts[k] for k in now], np.int64), vocabulary)
            for s in range(0, len(blocks), 64):
                own = blocks[s : s + 64]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part, np.int32)), pa.array(np.arange(number, number + len(own))), pa.array(own, pa.binary())], names=["part", "block_no", "block"])
                number += len(own)
            held = [ids[take:].copy()] if take < len(ids) else []
            documents, starts, total = documents[len(now) :], [s - take for s in starts[len(now) :]], len(ids) - take

        for batch in batches:
            for piece in common.slices(batch, "text", tokens.SLICE):
                ids, offsets = of.encode(piece.column(1))
                ids = np.insert(ids, offsets[1:], np.uint32(end_id))  # one after each text
                sizes = np.diff(offsets) + 1
                starts += (total + np.cumsum(sizes) - sizes).tolist()
                documents += zip(piece.column(0).to_pylist(), sizes.tolist())
                held.append(ids.astype("<u4", copy=False))
                total += len(ids)
                while total >= room:
                    yield from flush(room)
        if total:
            yield from flush(room)

    ordered = rows.repartitionByRange(parts, "doc_id", "turn").sortWithinPartitions("doc_id", "turn").drop("turn")
    common.small_batches(docs.sparkSession)
    ordered.mapInArrow(common.released(write), "part int, block_no long, block binary").write.parquet(path)


#: How a missing doc_id is written.
NONE = -(1 << 63)
READ_SCHEMA = "part int, doc_id long, own_start long, n_tokens long, ids_crc32 long"


def read_ids(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of block rows (part, block_no, block): part, doc_id, own_start (in the part), n_tokens, ids_crc32 [, ids]."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, waiting, start = None, None, [], 0  # now: [doc, start, n, still missing, crc, ids]
        held: list[tuple[int, bytes]] = []
        rows: list[tuple] = []

        def take(number: int, block: Block) -> None:
            nonlocal part, now, start
            if number != part:
                part, now, start = number, None, 0
                waiting.clear()
            waiting.extend(block.documents)
            at, ids = 0, block.ids
            while at < len(ids):
                if now is None:
                    if not waiting:
                        raise ValueError("ids without a document")
                    doc, n = waiting.pop(0)
                    now = [doc, start, n, n, 0, []]
                piece = ids[at : at + now[3]]
                now[4] = zlib.crc32(piece.tobytes(), now[4])
                if with_ids:
                    now[5].append(piece)
                now[3] -= len(piece)
                at += len(piece)
                start += len(piece)
                if not now[3]:
                    rows.append((part, now[0], now[1], now[2], now[4], np.concatenate(now[5]).astype(np.int32) if with_ids else None))
                    now = None

        def result() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            names = ["part", "doc_id", "own_start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
            out = pa.RecordBatch.from_arrays([pa.array([None if k == 1 and r[k] == NONE else r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
            rows.clear()
            return out

        def decode() -> Iterator[pa.RecordBatch]:
            for (number, _), block in zip(held, decode_blocks([b for _, b in held])):
                take(number, block)
            held.clear()
            yield result()

        for batch in batches:
            for number, block in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                held.append((number, block))
                if len(held) == LANES:
                    yield from decode()
        yield from decode()

    ordered = blocks.select("part", "block_no", "block").repartition("part").sortWithinPartitions("part", "block_no")
    return ordered.mapInArrow(common.released(read), READ_SCHEMA + (", ids array<int>" if with_ids else ""))


def with_starts(read: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32. read: a stored table of read_ids."""
    sizes = read.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return read.join(sums, F.col("part") == F.col("p")).select("doc_id", (F.col("own_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def id_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the ids of all documents, reads the files back, and digests what was read."""
    spark = docs.sparkSession
    path = common.scratch_path(spark, "ids")
    write_ids(docs, path, tokenizer)
    blocks = spark.read.schema("part int, block_no long, block binary").parquet(path)
    return with_starts(common.stored(spark, read_ids(blocks), "read"))
