"""Corpus pipeline: quality rules, exact dedup, near dedup, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; all but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiflow.llm.common import documents, drop_rejected, keep_rows, stored
from lexiflow.llm.exact_dedup import dedup_exact
from lexiflow.llm.mixing import in_mixed_order, mix_sources
from lexiflow.llm.near_dedup import near_duplicates
from lexiflow.llm.packing import pack_documents
from lexiflow.llm.quality_rules import quality_rules


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go; each row by its own host, repeated rows alike."""
    judged = quality_rules(docs).withColumnRenamed("host", "source")
    return drop_rejected(docs, judged, ["source"])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return keep_rows(docs, dedup_exact(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return keep_rows(docs, near_duplicates(docs))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the weighted mix over the written files."""
    return in_mixed_order(docs, mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Padding-free sequences of whole documents' pieces, numbered in the order of the mix within each bucket."""
    return pack_documents(docs, with_ids=False, in_stored_order=True)


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_to_weights),
    ("pack_binary", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs


#: SQL has no tokenizer and no hash sketches; tests/llm compares with a brute-force version.
ORACLE_SQL = None
