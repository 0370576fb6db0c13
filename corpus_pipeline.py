"""A pipeline from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of documents, and further columns of
docs whatever their names. In every stage a null text is an empty one, rows
without an id or without words are kept (but see substring_dedup), repeated
rows are rows of their own, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.mixing import mix
from plumbline.llm.near_dedup import keep_one
from plumbline.llm.packing import pack_in_order
from plumbline.llm.scratch import Scratch
from plumbline.llm.substring import remove_repeated_spans
from plumbline.llm.toxicity import fit, without_toxic
from plumbline.session import importable, table


#: Columns that the stages read; others are set aside while an operator runs, so that their names can't meet its own.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _set_aside(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with its further columns as extra_0, extra_1, ...; and the names that these then have."""
    plain = [c if c in OWN else f"extra_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*plain), plain


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compression distance doesn't reject; the model is learnt from the labelled ones among them."""
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates (five words, similarity 0.8 or more)."""
    return keep_one(docs, percent=80, width=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentences that a repeated run covers and without repeated runs of 50 words; n_chars follows the text, and what has no text left goes."""
    plain, names = _set_aside(docs)
    clean = remove_repeated_spans(plain, span=3).where((F.col("_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return clean.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*names).toDF(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again, as the temperature wants it that reads no source more than 1.5 times as often as any other; rows are in the order of the mixture, over partitions and within them."""
    order = ["_order", "doc_id"]
    plain, names = _set_aside(docs)
    return mix(plain, repetition=1.5, cover=True).repartitionByRange(*order).sortWithinPartitions(*order).select(*names).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, in the order of docs: readers deal out files by their size, so rows are put back by the number of their file (of any length) and their place."""
    order = ["_part", "_file", "_place"]
    docs = docs.select("doc_id", "text")
    placed = docs.withColumn("_file", F.input_file_name()).withColumn("_place", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.expr(r"try_cast(regexp_extract(_file, 'part-([0-9]+)', 1) as bigint)"))
    return pack_in_order(placed.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order), most=4096)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL has no compression, hash forest or tokenizer: tests hold near-dedup, substring dedup and the order of mixing and packing against plain loops instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a written table that the next one reads."""
    importable(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
