"""Corpus pipeline: documents -> clean, distinct, uncontaminated, mixed, tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All but the last return the columns they were given, extra ones and
null values too. An empty table stays empty in every stage; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import contamination, mixing, near_dup, token_store, toxicity
from tidemark.llm.common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: those with a score below 0.5.

    A null text is scored as the empty one; repeated rows go or stay together; rows without a doc_id are judged but
    teach nothing; without labels of both kinds all texts have the share of label 1 as their score.
    """
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document that is the smallest of its group of near-duplicates.

    Texts without words are in no group. Of rows that repeat a doc_id the smallest text stands; rows without one stay.
    """
    return near_dup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: none of which they share 75 % of the shingles.

    Null and wordless texts and items match nothing; repeated rows go or stay together; an empty benchmark removes nothing.
    """
    return contamination.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (never more than twice), in training order.

    A null source is a source of its own; texts without words have size 0 and are taken once where their source has a
    target; repeated rows are documents of their own.
    """
    return mixing.training_order(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified, read back from the token store.

    The store holds documents in the order of the rows in the files read, which is the training order that mixing
    gave; rows that come from no file stand by doc_id, a null one first. A null text is the end id alone; repeated
    rows are kept each.
    """
    return token_store.tokenize(docs, order=_row_in_files(docs))


def _row_in_files(docs: DataFrame) -> Column | None:
    """The place of a row that was read from files: the file's number (as Spark numbers what it writes), its name, the row in it."""
    at = F.col("_metadata.file_name")
    number = F.regexp_extract(at, "^part-([0-9]+)", 1).try_cast("long")
    place = F.struct(number.alias("part"), at.alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        docs.select(place).schema
    except AnalysisException:  # not read from Parquet files
        return None
    return place


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

#: The stages train, hash and tokenise; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
