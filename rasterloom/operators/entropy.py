"""Histograms, entropies and the cost of coding symbols under contexts, as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import samples as S


def histogram(symbols: DataFrame, keys: list[str], sym: str = "sym") -> DataFrame:
    """keys, sym, n."""
    return symbols.groupBy(*keys, F.col(sym).alias("sym")).agg(F.count("*").alias("n"))


def entropy(hist: DataFrame, keys: list[str]) -> DataFrame:
    """keys, symbols, distinct, entropy_bytes: zeroth-order entropy. Sums are over at most 256 rows of a key."""
    total = hist.groupBy(*keys).agg(F.sum("n").alias("total"))
    rows = hist.join(total, keys) if keys else hist.crossJoin(F.broadcast(total))  # one row
    return rows.groupBy(*keys).agg(F.first("total").alias("symbols"), F.count("*").alias("distinct_symbols"), F.round(F.sum(-F.col("n") * F.log2(F.col("n") / F.col("total"))) / 8, 6).alias("entropy_bytes"))


def conditional_entropy(symbols: DataFrame, keys: list[str], context: str = "ctx") -> DataFrame:
    """keys, contexts, entropy_bytes: the sum over contexts of their zeroth-order entropy."""
    each = entropy(histogram(symbols, [*keys, context]), [*keys, context])
    return each.groupBy(*keys).agg(F.count("*").alias("contexts"), F.round(F.sum("entropy_bytes"), 4).alias("entropy_bytes"))


def normalised(hist: DataFrame, keys: list[str], scale: int = 4096) -> DataFrame:
    """hist with freq: counts scaled to a sum of `scale`, 1 at least. What is missing goes to the most frequent symbol (the
    first of equals); what is too much is taken from the most frequent ones in turn, down to 1."""
    all_, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc("_raw"), "sym")
    raw = hist.withColumn("_raw", F.greatest(F.lit(1), F.bround(F.col("n").cast("double") * scale / F.sum("n").over(all_), 0)).cast("long"))
    raw = raw.withColumns({"_miss": scale - F.sum("_raw").over(all_), "_place": F.row_number().over(order), "_room": F.sum(F.col("_raw") - 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    less = F.greatest(F.lit(0), F.least(F.col("_raw") - 1, -F.col("_miss") - (F.col("_room") - F.col("_raw") + 1)))
    freq = F.when(F.col("_miss") >= 0, F.col("_raw") + F.when(F.col("_place") == 1, F.col("_miss")).otherwise(0)).otherwise(F.col("_raw") - less)
    return raw.withColumn("freq", freq.cast("long")).drop("_raw", "_miss", "_place", "_room")


def table_cells(freqs: DataFrame, keys: list[str]) -> DataFrame:
    """freqs with cell: the bytes of a symbol's gap and frequency in a serialised table."""
    gap = F.col("sym") - F.coalesce(F.lag("sym").over(Window.partitionBy(*keys).orderBy("sym")), F.lit(-1)) - 1
    return freqs.withColumn("gap", gap).withColumn("cell", F.expr(S.varint_size("gap") + " + " + S.varint_size("freq - 1"))).drop("gap")


def context_cost(symbols: DataFrame, keys: list[str], domain: DataFrame) -> DataFrame:
    """keys, design, header_bytes, payload_bytes, total_bytes of coding under each context design.

    symbols: keys, design, ctx, sym. domain: design, nctx. Each context has a table of frequencies that add up to 4096: a
    varint count and, per used symbol, a varint gap and a varint of its frequency less one; an unused context costs one
    byte. The payload is what its symbols take under that table.
    """
    own = [*keys, "design", "ctx"]
    cells = table_cells(normalised(histogram(symbols, own), own), own)
    each = cells.groupBy(*own).agg(F.sum("cell").alias("cells"), F.count("*").alias("used"), F.sum(-F.col("n") * F.log2(F.col("freq") / 4096.0)).alias("bits"))
    each = each.withColumn("header", F.expr(f"cells + {S.varint_size('used')}"))
    sums = each.groupBy(*keys, "design").agg(F.sum("header").alias("h"), F.sum("bits").alias("bits"), F.count("*").alias("seen"))
    out = sums.join(F.broadcast(domain), "design")  # a row for each design
    return out.select(*keys, "design", (F.col("h") + F.col("nctx") - F.col("seen")).cast("long").alias("header_bytes"), F.round(F.col("bits") / 8, 4).alias("payload_bytes"), F.round(F.col("h") + F.col("nctx") - F.col("seen") + F.col("bits") / 8, 4).alias("total_bytes"))


def cumulative(hist: DataFrame, keys: list[str]) -> DataFrame:
    """hist with start, the sum of n of smaller symbols."""
    order = Window.partitionBy(*keys).orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long"))


def slot_lists(freqs: DataFrame, keys: list[str], freq: str = "freq") -> DataFrame:
    """keys, sym, slots: the slots of each symbol, as many as its frequency, in order."""
    order = Window.partitionBy(*keys).orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    rows = freqs.withColumn("start", F.coalesce(F.sum(freq).over(order), F.lit(0)))
    return rows.select(*keys, "sym", F.sequence(F.col("start"), F.col("start") + F.col(freq) - 1).alias("slots"))


def slot_table(freqs: DataFrame, keys: list[str], freq: str = "freq") -> DataFrame:
    """keys, slot, sym: the same a slot a row."""
    return slot_lists(freqs, keys, freq).select(*keys, F.explode("slots").alias("slot"), "sym").select(*keys, F.col("slot").cast("long").alias("slot"), "sym")


def table_size(hist: DataFrame, keys: list[str]) -> DataFrame:
    """keys, used, table_bytes: a serialised table of gaps and normalised frequencies."""
    sums = table_cells(normalised(hist, keys), keys).groupBy(*keys).agg(F.sum("cell").alias("b"), F.count("*").alias("used"))
    return sums.select(*keys, "used", F.expr(f"CAST(b + {S.varint_size('used')} AS BIGINT)").alias("table_bytes"))


def canonical_codes(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sym, len, code: shorter codes first, then by symbol; a code begins where those before it end in the code space."""
    before = Window.partitionBy(*keys).orderBy("len", "sym").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.expr("shiftleft(1L, 31 - len)")).over(before), F.lit(0).cast("long"))  # codes are shorter than 32 bits
    return lengths.select(*keys, "sym", "len", taken.alias("_t")).select(*keys, "sym", "len", F.expr("shiftright(_t, 31 - len)").alias("code"))


def coded_bits(hist: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bits: the size of symbols coded with these lengths."""
    return hist.join(lengths, [*keys, "sym"]).groupBy(*keys).agg(F.sum(F.col("n") * F.col("len")).cast("long").alias("bits"))
