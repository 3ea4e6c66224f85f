"""Adaptive probabilities as an ordered fold: what a context has learned after all its decisions, and what they cost.

A context's probability of a 1 starts at one half and moves by 1/2**SHIFT of its distance after each decision, in integers
of 16 bits. That is sequential within a context, so decisions are gathered in two levels: bounded parts of PART positions,
combined where they lie and packed as a string of 0 and 1, then a context's parts in order; a fold over parts folds over
each part's decisions. A context's decisions take a byte each in one row; contexts spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART, SHIFT = 4096, 5
START, LEAST, MOST = 32768, 32, 65504


def learned(decisions: DataFrame, keys: list[str], part: int = PART, shift: int = SHIFT) -> DataFrame:
    """(keys, n, p, bits) of decisions (keys, pos, bit): how many there were, the probability of a 1 after the last (of
    65536), and the bits that a coder spends on all of them.

    pos orders a key's decisions and doesn't repeat within one. Rows without a bit are left out.
    """
    rows = decisions.where("bit IS NOT NULL").select(*keys, F.expr(f"pos div {part}").alias("_part"), "pos", F.col("bit").cast("string").alias("_bit"))
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_bit"))), lambda x: x["_bit"]), "")
    parts = rows.groupBy(*keys, "_part").agg(told.alias("_bits"))
    whole = parts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_part", "_bits"))), lambda x: x["_bits"]).alias("_parts"))  # one context's decisions

    def decide(state: Column, bit: Column) -> Column:
        p, one = state["p"], bit == "1"
        sure = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), p))
        chance = F.when(one, sure).otherwise(65536 - sure) / 65536
        step = F.when(one, p + F.shiftright(65535 - p, shift)).otherwise(p - F.shiftright(p, shift))
        return F.struct(step.cast("int").alias("p"), (state["n"] + 1).alias("n"), (state["bits"] - F.log2(chance)).alias("bits"))

    start = F.struct(F.lit(START).alias("p"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("bits"))
    every = F.aggregate("_parts", start, lambda state, bits: F.aggregate(F.split(bits, ""), state, decide))
    return whole.select(*keys, every.alias("_s")).select(*keys, F.col("_s.n").alias("n"), F.col("_s.p").alias("p"), F.col("_s.bits").alias("bits"))
