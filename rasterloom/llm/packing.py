"""Best-fit packing of token pieces into sequences of a fixed capacity, by exact-complement hashing.

Only the histogram of lengths (at most `capacity` numbers, however many pieces there are) is planned on the driver.
The shortest pieces, RESERVE of all tokens, are set aside. For each length, longest first, the sums of one, two and three
available lengths are looked up for its gap, the most even ones first, and combinations that fill the gap exactly are
taken as often as the counts allow. What is left, and what was set aside, goes by best fit: short pieces are what it
needs. The plan
is a list of patterns with multiplicities; each step uses up a length or a group of sequences, which bounds the
list by the number of lengths. Pieces then find their place by their rank among the pieces of their length; ranks
are made in salted groups, so a length that a third of all pieces have doesn't meet in one task.

Defined results: null text is empty (one piece with the end id alone); a text of n > capacity ids is cut into
ceil(n / capacity) pieces of which the first may be shorter; repeated rows are packed each; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
#: Share of all tokens whose shortest pieces are kept from exact sums.
RESERVE = 0.02
#: Pieces of one length are ranked in groups of about so many.
RANK_GROUP = 50_000

Pattern = tuple[tuple[tuple[int, int], ...], int]


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns ((length, how many), ...) with how many sequences follow each, for counts[length] pieces.

    Sums of up to three lengths, then best fit. Only where that takes more sequences than the tokens need at least, plans
    with sums of fewer lengths are tried too, and the one with the fewest sequences stays (the first of equals).
    """
    plan = fill_exactly(counts, capacity, 3, RESERVE)
    size = lambda plan: sum(n for _, n in plan)
    if size(plan) <= -(-int((counts * np.arange(len(counts))).sum()) // capacity):
        return plan
    return min([plan, *(fill_exactly(counts, capacity, most) for most in (3, 2, 1, 0))], key=size)


def fill_exactly(counts: np.ndarray, capacity: int, most: int, reserve: float = 0.0) -> list[Pattern]:
    """A plan: complements of up to `most` lengths where they fill a gap exactly, then best fit. reserve: the share of all
    tokens whose shortest pieces wait for best fit."""
    c = counts.astype(np.int64).copy()
    done: list[Pattern] = []
    tokens_of = c * np.arange(len(c))
    before = np.cumsum(tokens_of) - tokens_of
    aside = np.clip(-(-(int(tokens_of.sum() * reserve) - before) // np.maximum(np.arange(len(c)), 1)), 0, c)
    c -= aside

    def take(parts: list[int]) -> int:
        """Uses up a combination as often as the counts allow."""
        need = defaultdict(int)
        for p in parts:
            need[p] += 1
        times = min(int(c[p]) // k for p, k in need.items())
        if times:
            for p, k in need.items():
                c[p] -= k * times
            done.append((tuple(sorted(need.items(), reverse=True)), times))
        return times

    if c[capacity]:
        take([capacity])
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        if most >= 1 and c[length] and c[gap]:  # one length
            take([length, gap])
        if most >= 2 and c[length] and gap > 1:  # two
            a = np.arange((gap + 1) // 2, gap)
            for x in a[(c[a] > 0) & (c[gap - a] > 0)].tolist():
                if not c[length]:
                    break
                take([length, x, gap - x])
        while most >= 3 and c[length] and gap > 2:  # three: the sums of pairs that are there now
            there = (c[1:gap] > 0).astype(np.float64)
            pair_sums = np.rint(np.fft.irfft(np.fft.rfft(there, 2 * gap) ** 2, 2 * gap)[:gap]) > 0  # index s: a sum of s + 2
            x = np.arange(gap - 2, 0, -1)
            x = x[np.argsort(abs(3 * x - gap), kind="stable")]
            x = x[(c[x] > 0) & pair_sums[np.maximum(gap - x - 2, 0)] & (gap - x >= 2)]
            used = 0
            for first in x.tolist():
                rest = gap - first
                a = np.arange((rest + 1) // 2, rest)
                for y in a[(c[a] > 0) & (c[rest - a] > 0)].tolist():
                    used += take([length, first, y, rest - y])
                    if not c[length] or not c[first]:
                        break
                if not c[length]:
                    break
            if not used:
                break
    c += aside
    groups: dict[int, list[Pattern]] = defaultdict(list)  # open sequences by gap
    for length in range(capacity, 0, -1):
        while c[length]:
            gap = next((g for g in range(length, capacity) if groups.get(g)), None)
            if gap is None:
                each = capacity // length
                times, rest = divmod(int(c[length]), each)
                if times:
                    groups[capacity - each * length].append((((length, each),), times))
                if rest:
                    groups[capacity - rest * length].append((((length, rest),), 1))
                c[length] = 0
                break
            parts, times = groups[gap].pop()
            each = min(gap // length, int(c[length]))
            fill = min(times, int(c[length]) // each)
            if fill < times:
                groups[gap].append((parts, times - fill))
            groups[gap - each * length].append((parts + ((length, each),), fill))
            c[length] -= each * fill
    return done + [p for g in sorted(groups) for p in groups[g]]


def places(plan: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by rank: first ranks of the slots, their first sequence, pieces a sequence, and offset."""
    slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for parts, times in plan:
        offset = 0
        for length, each in parts:
            slots[length].append((used[length], sequence, each, offset))
            used[length] += each * times
            offset += each * length
        sequence += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*s)) for length, s in slots.items()}


def pack(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be a stored table: it is read twice and must not change."""
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(*kept)
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy(F.col(length).alias("l")).count().collect():  # at most `capacity` rows
        if not 1 <= r["l"] <= capacity:
            raise ValueError(f"a piece of {r['l']} ids doesn't fit a sequence of {capacity}")
        counts[r["l"]] = r["count"]
    where = spark.sparkContext.broadcast(places(plan_packing(counts, capacity)))
    salts = int(max(16, counts.max() // RANK_GROUP))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sums = rows.groupBy(F.col(length).alias("_l"), F.col("_salt").alias("_s")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_l").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_l", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(length, "_salt").orderBy(*order)
    ranked = rows.withColumn("_own", F.row_number().over(own) - 1).join(sums, (F.col(length) == F.col("_l")) & (F.col("_salt") == F.col("_s")))
    ranked = ranked.select(*kept, (F.col("_own") + F.col("_before")).cast("long").alias("_rank"))
    at = kept.index(length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = where.value
        for b in batches:
            lens = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            ranks = b.column(len(kept)).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
            for value in np.unique(lens).tolist():
                rows_ = np.flatnonzero(lens == value)
                first, base, each, start = slots[value]
                k = np.searchsorted(first, ranks[rows_], "right") - 1
                q = ranks[rows_] - first[k]
                sequence[rows_] = base[k] + q // each[k]
                offset[rows_] = start[k] + q % each[k] * value
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(common.released(place), pieces.select(*kept).schema.add("sequence_id", "long").add("offset", "long"))


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False, remember: int = tokens.MOST) -> DataFrame:
    """Each text's ids and an end id, cut into pieces of `capacity` ids (the first may be shorter)."""
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokens.tokenizer(path, remember)
        for batch in batches:
            for part in common.slices(batch, "text", tokens.SLICE):
                ids, offsets = of.encode(part.column(1))
                ids = np.ascontiguousarray(np.insert(ids, offsets[1:], np.uint32(end_id)), "<u4")
                sizes = np.diff(offsets) + 1
                first = np.cumsum(sizes) - sizes
                pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                stop = (sizes[owner] - 1) % capacity + 1 + piece * capacity
                start = np.where(piece > 0, stop - capacity, 0)
                raw = memoryview(ids).cast("B")
                a, z = first[owner] + start, first[owner] + stop
                crc = np.fromiter((zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), z.tolist())), np.int64, len(owner))
                columns = [part.column(0).cast(pa.int64()).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(stop - start), pa.array(crc)]
                if with_ids:  # pieces lie end to end in ids
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(a, len(ids)), pa.int32()), pa.array(ids.view("<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return docs.select("doc_id", "text").mapInArrow(common.released(cut), schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, remember: int = tokens.MOST) -> DataFrame:
    """Tokenizes, cuts and packs documents: one row per piece with its sequence and its place there."""
    pieces = common.stored(docs.sparkSession, token_pieces(docs, path, end_id, capacity, remember=remember), "pieces")
    return pack(pieces, capacity=capacity)
