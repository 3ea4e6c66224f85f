"""A training-corpus pipeline over `documents`: five stages, each written as Parquet and reread by the next.

Only stages that judge documents drop any: language ID drops texts without letters and texts whose best language is
hardly better than the others; line and suffix dedup drop documents that lose all they had; the n-gram join keeps the
smallest doc_id of each group. All but the last stage return the columns of `documents`, with text and n_chars of what
is left.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import common, jaccard, langid, lines, packing, suffix
from rasterloom.llm.queries import tokenizer_file

#: A text stays if its best language has this mean probability.
LEAST_SCORE = 0.3
#: Words that packing remembers; workers stay from one stage to the next, and their memory with them.
REMEMBER = 100_000
#: Fuzzy matching of stages can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


#: Scratch tables of the last stage over a data folder: its result may still be read from them until the next one begins.
_pending: dict[str, list[str]] = {}


def _clean(spark: SparkSession, sf_dir: str) -> None:
    for path in _pending.pop(sf_dir, ()):
        common.remove(spark, path)


def _stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes the scratch tables of the one before over the same folder, whose result is written by
    then. Pipelines over other folders, and other queries, keep theirs."""

    @functools.wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clean(spark, sf_dir)
        common.tidy()
        with common.recorded() as paths:
            out = run(spark, docs, sf_dir)
        _pending[sf_dir] = paths
        return out

    return stage


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns that an operator would replace renamed, and their names by the new ones."""
    there = {f"_in_{c}": c for c in docs.columns if c in names}
    return docs.withColumnsRenamed({c: n for n, c in there.items()}), there


def _with_text(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """docs with a new text and its length, in the columns of the stage's input."""
    docs = docs.withColumn("text", text)
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a likely language; learns from the labelled documents.

    Null and empty texts have no letter and go; texts of any length are judged whole; repeated rows are judged each, equal
    texts alike; without a single label every document goes; columns named like the operator's outputs stay; an empty
    table gives none.
    """
    common.small_batches(spark)
    net = langid.fit(docs.where(langid.fold() != 1))
    columns = docs.columns
    docs, there = _aside(docs, ("lang_pred", "score"))
    out = langid.predict(docs, net).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return out.drop("lang_pred", "score").withColumnsRenamed(there).select(*columns)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each group of similar lines keeps its first by (doc_id, line number); documents without any line left go.

    Null and empty texts have no line that could go and stay; a line of any length is compared whole; rows that repeat a
    doc_id are told apart by their texts, equal ones keep the same lines; rows without doc_id stay as they are; n_chars
    follows the text, other columns stay as they are; an empty table gives none.
    """
    columns = docs.columns
    docs, there = _aside(docs, ("n_lines", "n_removed"))
    out = lines.dedup_lines(docs).where((F.col("n_removed") < F.col("n_lines")) | (F.col("n_lines") == 0))
    return _with_text(out.drop("n_lines", "n_removed").withColumnsRenamed(there), columns, F.col("text"))


@_stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the smallest doc_id.

    Documents without words link with nothing and stay; equal texts are linked; repeated rows of the doc_id that stays all
    stay; rows without doc_id go; columns stay as they are; an empty table gives none.
    """
    heads = jaccard.component_table(docs).where("component_id = doc_id").select(F.col("doc_id").alias("_doc")).distinct()
    return docs.join(heads, F.col("doc_id") == F.col("_doc"), "left_semi")


@_stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages that a smaller doc_id has; documents that lose all they had go.

    Null and empty texts, and texts shorter than a passage, stay; rows that repeat a doc_id don't take from each other, and
    what only one of them has stays; texts that lose nothing stay byte for byte, in others a character that a cut parts
    becomes U+FFFD; an empty table gives none.
    """
    columns = docs.columns
    docs, there = _aside(docs, ("kept", "removed", "n_bytes"))
    out = suffix.dedup_suffixes(docs)
    left = out.where((F.size("removed") == 0) | (F.octet_length("kept") > 0))
    # A cut inside a character leaves bytes that aren't text; they become replacement characters.
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    left = left.withColumn("text", text).drop("kept", "removed", "n_bytes").withColumnsRenamed(there)
    return _with_text(left, columns, F.col("text"))


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and places.

    Null and empty texts are one piece with the end id; longer texts than a sequence are cut; repeated rows are packed each;
    an empty table gives no pieces.
    """
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), remember=REMEMBER)


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_jaccard_join), ("suffix-array dedup", suffix_dedup), ("best-fit packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = common.stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
        _clean(spark, sf_dir)
        if before is not None:
            common.drop(before)
        before = docs
    return docs
