"""Snapshot sources.

The reference fetched a whole-market table over HTTP on every run; here
captures are landed files (parquet or CSV) and read with a fixed schema.
Retries are Spark task retries.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow import schemas
from tapeflow.functions.calendar import normalise_time, with_jalali_parsed
from tapeflow.functions.metrics import clean_ticker


def normalise_name(name: str) -> str:
    """Lower-case, ``(%)`` → ``_percent``, spaces → ``_``."""
    n = name.strip().lower()
    n = re.sub(r"\s*\(%\)", "_percent", n)
    return re.sub(r"\s+", "_", n)


def normalise_snapshot(df: DataFrame, index_name: str | None = None) -> DataFrame:
    """Rename raw snapshot columns to the normalised names.

    ``index_name`` is the raw column that holds the instrument symbol (it
    becomes ``ticker``).
    """
    names = [normalise_name(c) for c in df.columns]
    if index_name is not None:
        key = normalise_name(index_name)
        names = ["ticker" if n == key else n for n in names]
    return df.toDF(*names)


BAD_VALUES = "bad_values"


def typed_snapshot(raw: DataFrame) -> DataFrame:
    """Cast a normalised raw snapshot to ``schemas.SNAPSHOT``.

    ``download`` may arrive as Jalali text (converted with C6) or as a
    Gregorian timestamp.  ``time`` is left-padded to ``HH:mm:ss`` (C7) and
    tickers are trimmed.  Text that cannot be read as its column's type
    becomes NULL and is listed as ``name=text`` in ``bad_values``, which sends
    the row to quarantine.  A landed table's ``capture_date`` is kept.
    """
    text = {f.name for f in raw.schema.fields if f.dataType.simpleString() == "string"}
    source = raw.withColumns({f"_raw_{c}": F.col(c) for c in text & {"download"}})
    if "download" in text:
        source = with_jalali_parsed(source, "download", "download", kind="timestamp")
    cols, bad = [], []
    for f in schemas.SNAPSHOT.fields:
        if f.name not in raw.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name)
        if f.name == "time" and "time" in text:
            c = normalise_time(c)
        elif f.name == "ticker":
            c = clean_ticker(c.cast("string"))
        # ANSI casts raise; a value that cannot be read must not fail the job.
        c = c.try_cast(f.dataType) if f.name in text and f.name != "download" \
            else c.cast(f.dataType)
        cols.append(c.alias(f.name))
        if f.name in text and f.name != "ticker":
            was = F.col(f"_raw_{f.name}" if f.name == "download" else f.name)
            bad.append(F.when((F.trim(was) != "") & c.isNull(),
                              F.concat(F.lit(f"{f.name}="), was)))
    if "capture_date" in raw.columns:
        cols.append(F.col("capture_date"))
    found = F.filter(F.array(*bad), lambda x: x.isNotNull()) if bad \
        else F.array().cast("array<string>")
    return source.select(*cols, found.alias(BAD_VALUES))


def read_snapshots(spark: SparkSession, path: str, fmt: str = "parquet",
                   index_name: str | None = None, schema=None, **options) -> DataFrame:
    """Read landed snapshot captures (one or many files).  With ``schema``
    (of the raw columns) nothing is inferred from the files."""
    reader = spark.read.format(fmt).options(**options)
    raw = (reader.schema(schema) if schema is not None else reader).load(path)
    return typed_snapshot(normalise_snapshot(raw, index_name))


def quarantine(snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split rows with a usable key and readable values from the others (NULL
    ticker or capture time, e.g. an impossible Jalali date, or text that is no
    number); those keep the raw text in ``bad_values``."""
    ok = F.col("ticker").isNotNull() & F.col("download").isNotNull()
    if BAD_VALUES not in snapshot.columns:
        return snapshot.filter(ok), snapshot.filter(~ok)
    ok = ok & (F.size(BAD_VALUES) == 0)
    return snapshot.filter(ok).drop(BAD_VALUES), snapshot.filter(~ok)


def write_snapshot(df: DataFrame, path: str, keep_history: bool = True) -> None:
    """S3: persist a snapshot.  With ``keep_history`` captures are appended
    partitioned by capture date instead of replacing the table."""
    if keep_history:
        (df.withColumn("capture_date", F.to_date("download"))
           .write.mode("append").partitionBy("capture_date").parquet(path))
    else:
        df.write.mode("overwrite").parquet(path)


def read_flow(spark: SparkSession, path: str, kind: str = "daily") -> DataFrame:
    """Read a stored history table with its fixed (latest) schema.

    The schema is given to the reader, so files written before an additive
    evolution (S6) read the new columns as NULL without merging the footers
    of every file.  Partition columns (``date``, ``j_year``) are kept, so
    filters on them prune folders.
    """
    schema = {"daily": schemas.DAILY_FLOW, "intraday": schemas.INTRADAY_FLOW,
              "index": schemas.INDEX_FLOW}[kind]
    return spark.read.schema(schema).parquet(path)


def latest_capture(captures: DataFrame) -> DataFrame:
    """The newest whole-market capture: rows whose ``download`` equals the
    latest one.  When the landed table is partitioned by ``capture_date``
    (``write_snapshot``), that partition is selected first by a scalar
    subquery, so only its folder is read."""
    df = captures
    if "capture_date" in df.columns:
        df = df.filter(F.col("capture_date") == df.select(F.max("capture_date")).scalar())
    return df.filter(F.col("download") == df.select(F.max("download")).scalar())
