"""Structured Streaming forms of the ingest, candle and screen operators.

Captures land as files in any order; ``readStream`` picks them up.  No row is
dropped for being late: each micro-batch is reduced on its own and merged into
a stored table, so the tables equal the batch operators' results over all
captures read so far, whatever the split into micro-batches.

* T1 – keyed append: the UNIQUE key is checked against the stored partitions.
* T2 – daily candles: a batch's candles are merged with the stored candles of
  the same (ticker, day); first, last, highest and lowest are idempotent, so a
  retried micro-batch changes nothing.
* T3 – market series: sums and counts per (universe, capture) of rows no other
  micro-batch had, one folder for each micro-batch (overwritten on a retry),
  added up on reading.
* T4 – screens: the latest verdict per ticker, also "no longer passes".

The output table and the checkpoint are the caller's paths: a restarted run
resumes where the checkpoint ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeflow.functions.metrics import clean_ticker
from tapeflow.operators.flows import finish_index, index_parts, to_intraday_flow
from tapeflow.operators.screens import screen
from tapeflow.operators.universe import in_session, tradable
from tapeflow.operators.windows import latest_per_key
from tapeflow.schemas import INTRADAY_KEYS
from tapeflow.session import staged
from tapeflow.sources.sinks import one_per_key, read_stored, write_unique

EPOCH_COL = "micro_batch"
Sink = Callable[[DataFrame, int], None]


def read_capture_stream(spark: SparkSession, path: str, schema: T.StructType,
                        max_files: int | None = None) -> DataFrame:
    """File source over landed captures."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def run_stream(stream: DataFrame, sink: Sink, checkpoint: str) -> None:
    """Feed all available input to ``sink`` micro-batch by micro-batch and
    return when it is used up, however long that takes."""
    q = (stream.writeStream.option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).foreachBatch(sink).start())
    q.awaitTermination()  # raises if the query failed


def _epoch_folder(out: str, epoch: int) -> str:
    return f"{out}/{EPOCH_COL}={epoch}"


# --- T1 ----------------------------------------------------------------------------------

def intraday_sink(spark: SparkSession, out: str) -> Sink:
    """Append the batch's new (ticker, capture) rows; stored ones stay.  A
    retry finds its own rows stored already."""
    def sink(batch: DataFrame, _epoch: int) -> None:
        rows = to_intraday_flow(batch).withColumn("date", F.to_date("timestamp"))
        write_unique(spark, rows, out, INTRADAY_KEYS, "skip", ["date"])
    return sink


def stored_intraday(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("date")


# --- T2 ----------------------------------------------------------------------------------

def _partial_candles(flow: DataFrame, value: str) -> DataFrame:
    ts = F.when(F.col(value).isNotNull(), F.col("timestamp"))
    return flow.groupBy("ticker", F.to_date("timestamp").alias("date")).agg(
        F.max(value).alias("high"), F.min(value).alias("low"),
        F.min_by(value, ts).alias("open"), F.max_by(value, ts).alias("close"),
        F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))


def merge_candles(parts: DataFrame) -> DataFrame:
    """Candles of the same (ticker, day) over any split of its captures."""
    return parts.groupBy("ticker", "date").agg(
        F.max("high").alias("high"), F.min("low").alias("low"),
        F.min_by("open", "first_at").alias("open"), F.max_by("close", "last_at").alias("close"),
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def candle_sink(spark: SparkSession, out: str, value: str) -> Sink:
    """The live candle table, one row per (ticker, day) including the
    running day; only the days a batch touches are rewritten."""
    def sink(batch: DataFrame, _epoch: int) -> None:
        new = _partial_candles(to_intraday_flow(batch), value)
        stored = read_stored(spark, out)
        if stored is not None:
            new = staged(new, "batch-candles")  # used twice; the files are read once
            days = new.select("ticker", "date")
            new = merge_candles(new.unionByName(
                stored.join(days, ["ticker", "date"], "left_semi").select(*new.columns)))
        write_unique(spark, new, out, ["ticker", "date"], "replace", ["date"])
    return sink


def stored_candles(spark: SparkSession, out: str) -> DataFrame:
    return (spark.read.parquet(out).filter(F.col("open").isNotNull())
            .select("ticker", "date", "high", "low", "open", "close"))


def candle_log_sink(out: str, value: str) -> Sink:
    """T2, append form: each micro-batch's partial candles in a folder of its
    own; nothing stored is read or rewritten, reading merges."""
    def sink(batch: DataFrame, epoch: int) -> None:
        _partial_candles(to_intraday_flow(batch), value) \
            .write.mode("overwrite").parquet(_epoch_folder(out, epoch))
    return sink


def logged_candles(spark: SparkSession, out: str) -> DataFrame:
    return (merge_candles(spark.read.parquet(out)).filter(F.col("open").isNotNull())
            .select("ticker", "date", "high", "low", "open", "close"))


# --- T3 ----------------------------------------------------------------------------------

def market_sink(spark: SparkSession, out: str, block_list: DataFrame, basket: DataFrame,
                prepare: Callable[[DataFrame], DataFrame] | None = None) -> Sink:
    """Sums and counts per (universe, capture) of the batch's new rows
    (``prepare`` shapes them first).  A row is new if no other micro-batch had
    its (ticker, capture): the keys seen are kept by day beside the sums, so a
    capture that lands again, whole or in other files, adds nothing."""
    def sink(batch: DataFrame, epoch: int) -> None:
        keyed = batch.withColumn("_ticker", clean_ticker("ticker")) \
            .withColumn("date", F.to_date("download"))
        new = one_per_key(keyed, ["_ticker", "download"])
        seen = read_stored(spark, f"{out}/seen")
        if seen is not None:  # not what an interrupted run of this epoch left
            others = seen.filter(F.col(EPOCH_COL) != epoch) \
                .select(F.col("ticker").alias("_ticker"), "download", "date")
            new = new.join(others, ["_ticker", "download", "date"], "left_anti")
        new = staged(new, "new-captures")
        (new.select(F.col("_ticker").alias("ticker"), "download", "date")
         .write.mode("overwrite").partitionBy("date").parquet(_epoch_folder(f"{out}/seen", epoch)))
        snap = new.drop("_ticker", "date")
        snap = prepare(snap) if prepare is not None else snap
        index_parts(in_session(tradable(snap)), block_list, basket) \
            .write.mode("overwrite").parquet(_epoch_folder(f"{out}/parts", epoch))
    return sink


def stored_market(spark: SparkSession, out: str) -> DataFrame:
    return finish_index(spark.read.parquet(f"{out}/parts"))


# --- T4 ----------------------------------------------------------------------------------

def screen_sink(spark: SparkSession, out: str, spec, daily: DataFrame | None = None,
                intraday: DataFrame | None = None) -> Sink:
    """T4: a verdict on the latest capture of each ticker in the batch, against
    the static history (stream–static join on ``ticker``).  The latest captures
    are written first and the screen reads those, so the batch's files are read
    once."""
    def sink(batch: DataFrame, epoch: int) -> None:
        seen = _epoch_folder(f"{out}/current", epoch)
        latest_per_key(batch, ["ticker"], "download", 1).write.mode("overwrite").parquet(seen)
        current = spark.read.schema(batch.schema).parquet(seen)
        hits = screen(current, spec, daily=daily, intraday=intraday, ordered=False) \
            .withColumn("passes", F.lit(True))
        (current.select("ticker", "download").join(hits, "ticker", "left")
         .withColumn("passes", F.coalesce("passes", F.lit(False)))
         .write.mode("overwrite").parquet(_epoch_folder(f"{out}/verdicts", epoch)))
    return sink


def stored_verdicts(spark: SparkSession, out: str) -> DataFrame:
    """The latest verdict of every ticker seen (``passes`` may be false)."""
    verdicts = spark.read.parquet(f"{out}/verdicts").drop(EPOCH_COL)
    return latest_per_key(verdicts, ["ticker"], "download", 1)
