"""Bits as an aggregation: variable-length codes find their places by prefix sums and are packed by bit_or.

Offsets are summed in two levels: within chunks of CHUNK symbols, and over the chunks' totals, so a text is never one
task's; only its chunk totals, a row for each CHUNK symbols, are ordered together. Every code adds its bits to the bytes it
touches, and bytes are combined before the shuffle. All of it stays in the engine.

Values that lie whole in a row needn't become a row a byte: stretch_packed() codes stretches where they lie, so coded
stretches are shuffled instead of symbols, and puts them together at the sums of their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .coders import put_codes

CHUNK = 4096
#: Bytes that are put together as one value.
BLOCK = 1 << 15
#: Bytes of a value that are coded together.
STRETCH = 1 << 16


def bit_offsets(coded: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """coded (keys, pos, len, ...) with bit_at, the sum of `len` of all smaller pos."""
    rows = coded.withColumn("_chunk", F.expr(f"pos div {chunk}"))
    totals = rows.groupBy(*keys, "_chunk").agg(F.sum("len").alias("_bits"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_chunk", F.coalesce(F.sum("_bits").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("len").over(inside), F.lit(0)))
    return placed.join(starts, [*keys, "_chunk"]).withColumn("bit_at", F.col("_start") + F.col("_inside")).drop("_chunk", "_start", "_inside")


def packed_bytes(placed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, byte_no, value): the bytes of codes (keys, len up to 16, code, bit_at), most significant bit first."""
    word = "shiftleft(code, CAST(24 - bit_at % 8 - len AS INT))"
    touched = ", ".join(f"named_struct('byte_no', bit_at div 8 + {k}, 'value', CAST(shiftright({word}, {16 - 8 * k}) & 255 AS INT))" for k in range(3))
    parts = placed.select(*keys, F.expr("bit_at % 8 + len").alias("_end"), F.expr(f"array({touched})").alias("_parts"))
    parts = parts.select(*keys, F.inline(F.expr("slice(_parts, 1, CAST((_end + 7) div 8 AS INT))")))
    return parts.groupBy(*keys, "byte_no").agg(F.bit_or("value").alias("value"))


def joined_bytes(rows: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, data): all bytes of (keys, byte_no, value) in order, put together by blocks first."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("byte_no", "value"))), lambda x: F.lpad(F.hex(x["value"]), 2, "0")), "")
    blocks = rows.groupBy(*keys, F.expr(f"byte_no div {block}").alias("_block")).agg(text.alias("_hex"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_block", "_hex"))), lambda x: x["_hex"]), "")
    return blocks.groupBy(*keys).agg(F.unhex(whole).alias("data"))  # one text's blocks


def length_table(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, head): 128 bytes of code lengths (keys, sym, len), two in a byte."""
    nibbles = lengths.groupBy(*keys, F.expr("sym div 2").alias("_at")).agg(F.sum(F.expr("shiftleft(len, IF(sym % 2 = 0, 4, 0))")).alias("_b"))
    table = nibbles.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_at").cast("int"), F.col("_b").cast("int")))).alias("_m"))  # 128 rows at most
    return table.select(*keys, F.expr("unhex(array_join(transform(sequence(0, 127), i -> lpad(hex(coalesce(try_element_at(_m, i), 0)), 2, '0')), ''))").alias("head"))


def huffman_packed(symbols: DataFrame, lengths: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, data): the table of lengths and the codes of all symbols (keys, pos, sym), as coders.huffman_encode lays them out.

    lengths and codes have a row for each symbol used. Keys without symbols have no row.
    """
    coded = symbols.join(codes.select(*keys, "sym", "len", "code"), [*keys, "sym"]).select(*keys, "pos", "len", "code")
    body = joined_bytes(packed_bytes(bit_offsets(coded, keys), keys), keys)
    return length_table(lengths, keys).join(body, keys).select(*keys, F.concat("head", "data").alias("data"))


def _joined_bits(parts: list[dict]) -> bytes:
    """Stretches {bits, packed} in order, each at the sum of the sizes before it; a byte that two share is their bit_or."""
    starts = np.cumsum([0, *(p["bits"] for p in parts)])
    out = np.zeros((int(starts[-1]) + 7) // 8 + 1, np.uint8)
    for part, start in zip(parts, starts.tolist()):
        own, at, shift = np.frombuffer(part["packed"], np.uint8), start // 8, start % 8
        out[at : at + len(own)] |= own >> np.uint8(shift)
        if shift:
            out[at + 1 : at + 1 + len(own)] |= own << np.uint8(8 - shift)
    return out[:-1].tobytes()


def stretch_packed(data: DataFrame, codes: DataFrame, key: str, stretch: int = STRETCH) -> DataFrame:
    """(key, data): the codes of all bytes of whole values (key, data); codes: key, sym, len, code.

    Empty and null values have no row.
    """
    table = codes.groupBy(key).agg(F.collect_list(F.struct(*(F.col(c).cast("int") for c in ("sym", "len", "code")))).alias("_codes"))  # 256 at most
    at = F.explode(F.expr(f"sequence(0L, CAST((octet_length(data) - 1) div {stretch} AS BIGINT))")).alias("_at")
    parts = data.where("octet_length(data) > 0").join(table, key).select(key, "data", "_codes", at)
    parts = parts.select(key, "_at", F.expr(f"substring(data, CAST(_at * {stretch} + 1 AS INT), {stretch})").alias("_part"), "_codes")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, cells = batch.column(3).offsets.to_numpy(), batch.column(3).values
            sym, size, word = (cells.field(k).to_numpy() for k in range(3))
            bits, packed = [], []
            for k, part in enumerate(batch.column(2)):
                own, values = slice(ends[k], ends[k + 1]), np.frombuffer(part.as_buffer(), np.uint8)
                lengths, words = np.zeros(256, np.int64), np.zeros(256, np.int64)
                lengths[sym[own]], words[sym[own]] = size[own], word[own]
                placed = put_codes(lengths[values], words[values])
                bits.append(len(placed))
                packed.append(np.packbits(placed).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int64()), pa.array(packed, pa.binary())], names=[key, "_at", "bits", "packed"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_joined_bits(p) for p in batch.column(1).to_pylist()], pa.binary())], names=[key, "data"])

    coded = parts.mapInArrow(code, f"{key} string, _at long, bits long, packed binary")
    whole = coded.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", "bits", "packed"))).alias("_parts"))  # one value's coded stretches
    return whole.mapInArrow(joined, f"{key} string, data binary")
