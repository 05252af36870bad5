"""The corpus pipeline: from documents to packed training sequences, in five stages.

A stage is (name, function of (spark, docs, sf_dir)); each but the last returns
documents with all their columns. run() writes what a stage keeps as Parquet in
the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import exact_dedup, mixing, ngram_join, packing, quality, util


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labels, accepts.

    Null, empty and very long texts are scored like others, null identifiers and
    repeated rows by their text alone; without labels of both kinds all are kept.
    """
    return quality.accepted(docs, util.table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one of the smallest doc_id.

    Decided by identifier and text; null texts are copies of each other, null
    identifiers are kept, and of rows repeated whole one stays.
    """
    return exact_dedup.survivors(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near pairs connect, the document of the smallest doc_id.

    Decided by identifier and text; null and wordless texts and null identifiers
    match nothing and are kept.
    """
    return ngram_join.representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the blocks that the target weights and the budget choose (TARGET_WEIGHTS and BUDGET_PERCENT of mixing).

    A tenth of the blocks goes, from sources above their target. A null source is
    the source ''; null and empty texts have no tokens and go with their block;
    rows are told apart by identifier and text.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of the documents, those without an identifier too; null and empty texts have nothing to pack, longer ones are cut into pieces."""
    return packing.pack(docs, unnamed=True)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier's training and best-fit packing can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. An empty table gives no rows; other columns of documents, whatever their names, go along until the last stage."""
    docs = util.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = util.spool(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
