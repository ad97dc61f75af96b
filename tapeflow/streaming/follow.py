"""Exactly-once ingest of the captures that have landed since the last run.

A file stream finds new files; every micro-batch is one commit (I1–I3, candle
states) that also adds its files to the ledger ``landed``, by a digest of their
rows.  A file whose digest is in the ledger is left out, whatever its name: a
capture that lands again, and a micro-batch that is repeated because the run
died between the commit and the stream's checkpoint, change no table.

A capture is one file, as the reference stores one fetch; several captures may
share a micro-batch or a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeflow.plans.jobs import ingest_into
from tapeflow.session import staged
from tapeflow.sources.sinks import one_per_key
from tapeflow.sources.snapshots import normalise_snapshot, typed_snapshot
from tapeflow.sources.versions import Transaction
from tapeflow.streaming.streams import run_stream

FILE = "_file"


def landed_schema(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> T.StructType:
    """The raw schema of the files that are there (a stream needs one)."""
    return spark.read.format(fmt).options(**options).load(path).schema


def file_digests(rows: DataFrame) -> DataFrame:
    """file, digest, rows: a digest of each file's rows in any order (their
    number and three sums or parities of row hashes), added up map-side."""
    columns = [c for c in rows.columns if c != FILE]
    names = F.lit(",".join(sorted(columns)))
    values = [F.col(f"`{c}`").cast("string") for c in sorted(columns)]
    # xxhash64 skips nulls, so what is null is hashed too.
    nulls = F.array_join(F.array(*(F.when(v.isNull(), "0").otherwise("1") for v in values)), "")
    one = F.xxhash64(names, nulls, *values)
    two = F.xxhash64(F.lit(1), *values, nulls)
    g = rows.groupBy(F.col(FILE).alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(one.cast("decimal(38,0)")).alias("s1"),
        F.sum(two.cast("decimal(38,0)")).alias("s2"), F.bit_xor(F.xxhash64(one, two)).alias("s3"))
    digest = F.sha2(F.concat_ws("|", names, "rows", "s1", "s2", "s3"), 256)
    return g.select("file", digest.alias("digest"), "rows")


def new_files(rows: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """One file for each digest that the ledger does not have."""
    found = one_per_key(file_digests(rows), ["digest"])
    return found if ledger is None else found.join(ledger.select("digest"), "digest", "left_anti")


def follow(spark: SparkSession, captures: str, root: str, checkpoint: str, schema: T.StructType,
           fmt: str = "parquet", index_name: str | None = None, on_conflict: str = "skip",
           block_list: DataFrame | None = None, basket: DataFrame | None = None,
           daily: bool = True, max_files: int | None = None, **options) -> None:
    """Ingest every file that has landed under ``captures`` and is not in the
    ledger, ``max_files`` to a commit, and return.  Run again, it goes on where
    it ended; nothing that was read is read again."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.load(captures).withColumn(FILE, F.col("_metadata.file_path"))

    def sink(batch: DataFrame, epoch: int) -> None:
        rows = staged(batch, "landed-rows")  # the files are read once
        tx = Transaction(spark, root)
        files = staged(new_files(rows, tx.table("landed")), "landed-files")
        if files.isEmpty():
            return
        fresh = rows.join(files.select(F.col("file").alias(FILE)), FILE, "left_semi").drop(FILE)
        snapshot = typed_snapshot(normalise_snapshot(fresh, index_name))
        ingest_into(tx, snapshot, on_conflict, block_list, basket, daily, f"{epoch:09d}")
        tx.write("landed", files.withColumn("epoch", F.lit(epoch).cast("long")), (), ["digest"])
        tx.commit()

    run_stream(stream, sink, checkpoint)
