"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.llm import minhash, mixing, packing, quality, secrets
from tapeflow.llm.common import ship_code, stored, table

FILE_BYTES = 32 * 1024 * 1024  # of text, in a file of the mixture


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote accepts."""
    ship_code(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    kept = quality.scores(docs, model, docs.columns).filter(
        F.col("__llm_score") >= quality.KEEP_SCORE)
    return kept.drop("__llm_score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest
    id.  A row is judged by its id and text, so different texts that share an
    id each have their own verdict, and only rows equal in both fall together;
    rows without an id stay."""
    ship_code(spark)
    text = F.sha2(F.col("text").cast("string").cast("binary"), 256)
    keyed = docs.withColumn("__llm_text", text)
    keep = (minhash.near_duplicates(keyed, carry=["__llm_text"])
            .filter(F.col("kept") & F.col("doc_id").isNotNull())
            .select(F.col("doc_id").alias("__llm_id"), F.col("__llm_text").alias("__llm_same"))
            .distinct())
    one = keyed.join(keep, (F.col("doc_id") == F.col("__llm_id"))
                     & F.col("__llm_text").eqNullSafe(F.col("__llm_same")), "left_semi") \
        .dropDuplicates(["doc_id", "__llm_text"])
    return one.unionByName(keyed.filter(F.col("doc_id").isNull())).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced (and n_chars made to agree)."""
    runs = secrets.with_runs(docs, docs.columns)
    scan = secrets.scanned(runs, secrets.train(runs))
    clean = scan.withColumn("text", secrets.redacted(scan))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(
            F.size("__llm_spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
            .cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mixture: the files follow the
    schedule's slots, and so do the rows in each file."""
    mixture, slots, block_bytes = mixing.mixed_rows(docs)
    each = max(1, FILE_BYTES // block_bytes)  # slots of one file
    files = max(1, -(-slots // each))
    file = F.floor(F.col("__llm_slot") / each).cast("int")
    return (mixture.repartitionById(files, file)
            .sortWithinPartitions("__llm_slot", "__llm_place").select(*docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    ship_code(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

# SQL cannot express the classifier, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
