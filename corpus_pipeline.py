"""Corpus pipeline: reject poor and toxic documents, remove repeated line
chunks, keep one document of each near-duplicate group, pack the rest.

Each stage takes (spark, docs, sf_dir), docs being all rows its predecessor
kept; a runner may write and reread the table between stages. All but the last
return the columns of ``docs``, whatever else they are called. In every stage a
null text counts as an empty one (and stays null where it stays), null ids are
kept, whole texts of any length are read, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import common, lines, neardup, packing, quality, toxicity
from leafmill.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more. Equal texts score
    alike; repeated rows stay repeated."""
    corpus, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.keep_good(docs, quality.train(corpus, labels), 0.5)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity scores below 0.3. Equal texts score alike;
    repeated rows stay repeated."""
    corpus, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.keep_clean(docs, toxicity.train(corpus, labels), 0.3)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated chunks of lines removed but for their first by id,
    text hash and line. Repeated rows are one document and lose the same lines."""
    return lines.dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the first by id and text hash,
    a null id before all. Of repeated rows one stays; texts without words are
    one group."""
    return neardup.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024. Repeated rows have
    places of their own, in any order."""
    return packing.pack(packing.pieces(docs, tokenizer_path("byte_bpe_50k.json"), 2, 1024), 1024)


STAGES = [
    ("quality_classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: Learned scores and fingerprints are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each table written before the next; what a
    stage wrote for itself, and its input, are deleted once its output stands."""
    docs = common.table(spark, sf_dir, "documents")
    mark = common.written()
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        common.clear_scratch(keep=docs, since=mark)
    return STAGES[-1][1](spark, docs, sf_dir)
