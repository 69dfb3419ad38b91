"""A training-corpus pipeline over ``documents``: quality rules, near-dedup, decontamination, secrets, packing.

Every stage takes any table that has the columns of ``documents``; further columns, whatever their names,
are carried to the last stage. Rows are told by id and text, so null ids, repeated ids and repeated rows are
safe; each docstring says what becomes of them. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoframe.llm.common import materialise, release, scratch, table
from chronoframe.llm.decontam import drop_contaminated
from chronoframe.llm.packing import pack_documents
from chronoframe.llm.quality import drop_low_quality
from chronoframe.llm.registry import packed_digest
from chronoframe.llm.secrets import redact_secrets
from chronoframe.llm.simhash import drop_near_duplicates


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; repeated rows are judged alike; a null source is a host."""
    return drop_low_quality(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, and of its texts that of the smallest hash.

    Repeated rows stay once, two different texts under one id both stay, rows without an id all stay, and
    wordless texts are copies of one another.
    """
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs. Null and empty texts hold none and stay, as do repeated rows and null ids."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; ``n_chars`` follows the text. Null texts stay null, repeated rows stay."""
    return redact_secrets(docs, length_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with a checksum of their ids. A null text counts as empty; repeated rows and null ids are packed too."""
    return packed_digest(pack_documents(docs))


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("packing", packing_stage),
]

#: Fingerprints, edit distances and token ids have no SQL: the tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on what the one before it kept; only the last stage's table outlives the call."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as kept:
            kept.append(done := materialise(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        release(docs)
        docs = done
    return docs
