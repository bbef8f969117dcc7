"""The registered query of each operator: production parameters over the whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from proplake.llm import bpe, hardneg, languages, maxscore, merkle, neardup, packing, parsing, repeats, resampling, secrets, sharding, tokenfiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, *tables: str, sql: str | None = None):
    """Register ``fn(DataFrame, ...) -> DataFrame`` over whole tables of the data folder."""
    def register(fn: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(*[spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables])
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_query("op6_hypergeometric_sharding", "documents")(sharding.shard_digest)
_query("op1_structural_secret_scan", "documents")(secrets.secret_digest)
_query("op9_chunk_reuse_bpe", "documents")(bpe.round_trip)
_query("op2_locally_consistent_fingerprints", "documents")(parsing.fingerprint_digest)
_query("op10_plane_token_files", "documents")(tokenfiles.token_file_digest)
_query("op5_maxscore_search", "embeddings", sql=maxscore.SEARCH_SQL)(maxscore.search_digest)
_query("op8_conflict_best_fit", "documents")(packing.packing_digest)
_query("op4_importance_resampling", "documents", "labels")(resampling.resampling_digest)
_query("op7_minhash_inverted_join", "documents")(neardup.neardup_digest)
_query("op3_hash_suffix_dedup", "documents")(repeats.repeats_digest)
_query("op13_rank_order_language", "documents", sql=languages.LANGUAGE_SQL)(languages.language_digest)
_query("op12_merkle_bitmap_manifest", "documents", sql=merkle.MANIFEST_SQL)(merkle.manifest_digest)
_query("op11_anchor_cluster_negatives", "embeddings", sql=hardneg.NEGATIVES_SQL)(hardneg.negatives_digest)

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
