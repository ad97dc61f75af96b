"""The registered queries of this subpackage: thin digests of its operators
over whole tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.llm import (
    alignment, decontamination, embedding_dedup, licenses, minhash, mixing, packing, quality, resharding, secrets, spelling,
    tokencount, topk)
from tapeflow.llm.common import stored, table
from tapeflow.llm.oracle import ORACLE  # noqa: F401 - read by the entry point


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = F.col("__llm_score")
    return quality.scores(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), score.alias("score"),
        (score >= quality.KEEP_SCORE).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = secrets.with_runs(table(spark, sf_dir, "documents"), ["doc_id"], text=False)
    return secrets.report(secrets.scanned(runs, secrets.train(runs)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = stored(resharding.shard_keys(table(spark, sf_dir, "documents"), resharding.old_layout()), "keys")
    plan = resharding.reshard_plan(keys)
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                       "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"),
                      F.col("vec_id") % 20 == 0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.suffix_sums(tokencount.length_histogram(table(spark, sf_dir, "documents")))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"),
                                 table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    def with_slips(run):
        """The contract's slips: one letter of some runs is left out."""
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run)
                    .cast("binary"))
        at = (h % F.length(run)).cast("int")
        return F.when(h % 199 == 0, F.concat(F.substring(run, F.lit(1), at),
                                             F.substring(run, at + 2, F.length(run)))).otherwise(run)
    return spelling.variant_groups(spelling.vocabulary(
        table(spark, sf_dir, "documents"), spelling=with_slips))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_packing, op3_secrets, op4_embedding_dedup, op5_licenses, op6_resharding,
    op7_topk, op8_token_counts, op9_minhash, op10_mixing, op11_decontamination, op12_alignment,
    op13_spelling)}

