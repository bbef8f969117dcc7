"""From raw documents to packed training bins: five stages, each over all that its predecessor kept.

1. quality classifier: documents that importance resampling does not draw go;
2. MinHash near-dedup: of each group of near-duplicates the smallest doc_id stays;
3. suffix-array dedup: passages that start earlier in the corpus are cut from the texts;
4. secret scan: every reported span is replaced by its kind;
5. best-fit packing: documents are placed in bins without two of one source or two near-duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proplake.llm import neardup, packing, repeats, resampling, secrets
from proplake.session import cut_lineage

NEAR_PERCENT = 80  # similarity of word shingles from which documents count as near-duplicates

#: No SQL: the models, the signatures, the suffix order and the packing are beyond it; tests hold each against plain Python.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resampling.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.first_of_each(docs, NEAR_PERCENT)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packing_digest(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("secret scan", secret_scan),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, size, bin) of everything that the stages keep of the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
