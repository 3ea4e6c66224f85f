"""The registered queries opN_<name> of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import concurrency, idcoder, jaccard, knn, langid, lines, lm, media, packing, piece_bpe, rank_bpe, search, suffix
from .common import table


def tokenizer_file(name: str) -> str:
    """A public tokenizer's vocabulary file; the folder is a parameter (RASTERLOOM_TOKENIZERS)."""
    if folder := os.environ.get("RASTERLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idcoder.id_report(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op7_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.piece_digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_report(table(spark, sf_dir, "documents"))


def op9_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_table(table(spark, sf_dir, "documents"))


def op11_open_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concurrency.open_sales(*(table(spark, sf_dir, name) for name in ("sales", "sale_lines", "clients")))


def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return rank_bpe.rank_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_id_files, op2_langid, op3_suffix_dedup, op4_line_dedup, op5_packing, op6_media_tiff, op7_piece_bpe, op8_lm_score, op9_knn, op10_jaccard_join, op11_open_sales, op12_rank_bpe, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return {"op9_knn": knn.SQL, "op11_open_sales": concurrency.SQL, "op13_ranked_search": search.SQL}
