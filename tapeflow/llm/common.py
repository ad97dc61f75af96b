"""Helpers shared by the operators of this subpackage (DataFrame code only).

Working columns are named ``__llm_…`` so that they cannot clash with columns
of an input table.
"""

from __future__ import annotations

import itertools
import json
import os
import shutil
import tempfile
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeflow.session import scratch_path

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def ship_code(spark: SparkSession) -> None:
    """Let executors import this package when it is not installed there: the
    driver serves a zip of it (``addPyFile``), once for each session."""
    sc = spark.sparkContext
    if getattr(sc, "__llm_shipped", False):
        return
    import tapeflow
    root = os.path.dirname(os.path.dirname(os.path.abspath(tapeflow.__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tapeflow-code-"),
                                               "tapeflow"), "zip", root, "tapeflow")
    sc.addPyFile(archive)
    setattr(sc, "__llm_shipped", True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back.  This cuts
    the lineage; a lost executor costs a re-read, not a re-computation."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: Sequence[dict], schema: str) -> DataFrame:
    """A small driver-made table as a JVM-side literal (no Python rows in the
    plan).  Callers pass tables whose size they can bound."""
    spec = f"array<struct<{schema}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(list(rows))), spec)))


def json_table(spark: SparkSession, rows: Iterable[dict], schema: str, name: str,
               rows_per_file: int = 64) -> DataFrame:
    """Driver-made rows of bounded number, written as JSON lines to the shared
    scratch folder (through Hadoop's file system, so any store will do)."""
    folder = scratch_path(spark, f"llm-{name}")
    rows, part = iter(rows), 0
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(path(folder))
    while lines := [json.dumps(r) for r in itertools.islice(rows, rows_per_file)]:
        out = fs.create(path(f"{folder}/part-{part:05d}.json"), True)
        try:
            out.write(bytearray("\n".join(lines).encode("utf-8")))
        finally:
            out.close()
        part += 1
    return spark.read.schema(schema).json(folder)


def hash_order(*cols: str | Column) -> Column:
    """A uniform 63-bit position for a row, the same in every run."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def running_totals(df: DataFrame, group: str, order: str, ties: Sequence[str], weight: str,
                   buckets: int) -> DataFrame:
    """Exact prefix sums per group without a task that sees a whole group.

    Adds ``__llm_rank`` (earlier rows of the group) and ``__llm_before`` (their
    summed weight).  ``order`` is a uniform 63-bit number (``hash_order``);
    its range is cut into equal parts (``buckets`` rounded up to a power of
    two).  Part sums are added up over the parts of a group, rows only inside
    their part, so a group with a third of all rows is spread over all parts.
    ``group`` must not be null; ``ties`` settle equal positions.
    """
    bits = (buckets - 1).bit_length()
    part = df.withColumn("__llm_part", F.shiftrightunsigned(order, 63 - bits).cast("int"))
    sums = part.groupBy(group, "__llm_part").agg(
        F.count(F.lit(1)).alias("__llm_n"), F.sum(weight).alias("__llm_w"))
    up = Window.partitionBy(group).orderBy("__llm_part").rowsBetween(
        Window.unboundedPreceding, -1)
    base = sums.select(
        F.col(group).alias("__llm_group"), F.col("__llm_part").alias("__llm_base_part"),
        F.coalesce(F.sum("__llm_n").over(up), F.lit(0)).alias("__llm_n0"),
        F.coalesce(F.sum("__llm_w").over(up), F.lit(0)).alias("__llm_w0"))
    inside = Window.partitionBy(group, "__llm_part").orderBy(order, *ties)
    out = (part.withColumn("__llm_rank", F.row_number().over(inside) - 1)
           .withColumn("__llm_before", F.coalesce(
               F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .join(base, (F.col(group) == F.col("__llm_group"))
                 & (F.col("__llm_part") == F.col("__llm_base_part"))))
    return (out.withColumn("__llm_rank", (F.col("__llm_rank") + F.col("__llm_n0")).cast("long"))
            .withColumn("__llm_before",
                        (F.col("__llm_before") + F.col("__llm_w0")).cast("long"))
            .drop("__llm_part", "__llm_group", "__llm_base_part", "__llm_n0", "__llm_w0"))


def buckets_for(spark: SparkSession, rows: int, rows_per_bucket: int = 20_000) -> int:
    """Number of hash parts so that a group holding most rows has about
    ``rows_per_bucket`` of them per part, and spreads evenly over all shuffle
    partitions."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, 4 * tasks, -(-rows // rows_per_bucket))
