"""From raw documents to training shards: five stages, each a corpus operator on all that the one before kept.

Every stage is written as Parquet to the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, mixing, neardup, sharding, toxicity
from tessera.llm.common import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the compression-distance classifier calls toxic go. Null and empty texts
    score as no evidence, equal texts the same; rows without an id are scored like any."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, over shingles of five words at a similarity of 0.8: one document of each group stays, also of
    repeated rows and of rows without an id. Documents without words are in no group and stay."""
    return neardup.deduplicate(docs, size=5, percent=80)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents of which a twentieth or more is in benchmark windows of 13 words go. Null and empty
    texts are clean, rows of one id are judged by their own texts."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"), 13)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: sources by weights 5, 2, 1; a document comes as often as the mix takes it, so one without
    words never does. Equal rows are documents of their own; a null source is a source."""
    return mixing.materialise(docs, mixing.mix_documents(docs))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: 24 shards, each a proportional slice of the mixture; the documents with shard and slot."""
    return sharding.interleave(docs, 24)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmarks),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The classifier and the MinHash stage are beyond SQL; tests/llm/test_pipeline.py holds every stage against a
#: brute-force version, on the pipeline's own parameters.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
