"""Keyed appends and schema evolution of the history tables.

The reference relied on ``UNIQUE`` constraints and one transaction per run.
Here a batch is staged once, checked, and only then written:

* ``error``   – raise if a key repeats inside the batch or is already stored;
* ``skip``    – keep stored rows, append only new keys;
* ``replace`` – new rows win: stored rows with a batch key are dropped.

In ``skip`` and ``replace`` a key that repeats inside the batch keeps one row,
the same one in every run.  ``prepare`` does all the checks and writes nothing
but the staged batch, so a job with several tables prepares all of them before
it commits the first.

Writes go through Spark's file commit protocol.  A replace rewrites stored
data it also reads, so the new partitions are first materialised with
``checkpoint()`` into the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeflow.session import checkpoint_root, scratch_path

CONFLICT_MODES = ("error", "skip", "replace")


class DuplicateKeyError(ValueError):
    """A batch repeats keys, its own or stored ones (``on_conflict='error'``)."""


def read_stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None only if there is no such path.  A table
    that cannot be read is an error, never an empty table."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def union_evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Additive schema evolution — columns missing on one side are NULL."""
    return old.unionByName(new, allowMissingColumns=True)


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, chosen by a hash of the whole row.  Rows are dealt by key
    before they are sorted: keys seldom repeat, so a partial limit would sort a
    whole input split (a landed file's row group, however many rows it has) and
    drop next to nothing; behind the shuffle AQE sizes the tasks."""
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(*(F.col(c) for c in df.columns)))
    return (df.repartition(*keys).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn"))


def check_keys(new: DataFrame, existing: DataFrame | None, keys: list[str], where: str) -> None:
    """Raise on a repeated key; one pass over the batch's keys and those stored
    keys that meet them."""
    mine = new.select(*keys)
    seen = mine if existing is None else mine.unionByName(
        existing.select(*keys).join(mine.distinct(), keys, "left_semi"))
    if not seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        raise DuplicateKeyError(f"keys {keys} repeat in the batch or are already stored{where}")


def append_unique(new: DataFrame, existing: DataFrame, keys: Sequence[str],
                  on_conflict: str = "error") -> DataFrame:
    """S7–S9 as a DataFrame: the table after appending ``new`` to ``existing``."""
    if on_conflict not in CONFLICT_MODES:
        raise ValueError(f"on_conflict must be one of {CONFLICT_MODES}")
    keys = list(keys)
    if on_conflict == "error":
        check_keys(new, existing, keys, "")
        return union_evolved(existing, new)
    new = one_per_key(new, keys)
    if on_conflict == "skip":
        return union_evolved(existing, new.join(existing.select(*keys), keys, "left_anti"))
    return union_evolved(existing.join(new.select(*keys), keys, "left_anti"), new)


def laid_out(df: DataFrame, partition_by: list[str], keys: list[str]) -> DataFrame:
    """Few files for each partition value, each sorted by key: row group
    statistics then prune key filters.  ``rebalance`` lets AQE split a large
    partition and merge small ones."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    order = [*partition_by, *(k for k in keys if k not in partition_by)]
    return df.sortWithinPartitions(*order) if order else df


def prepare_unique(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str],
                   on_conflict: str = "error", partition_by: Sequence[str] = ()
                   ) -> Callable[[], DataFrame]:
    """Stage the batch (its plan runs once) and check it against the table;
    return the function that writes it and gives the table back.

    Only partitions that the batch touches take part: the stored keys meet the
    staged batch in a join on the partition columns too, which prunes the
    other folders at run time.
    """
    if on_conflict not in CONFLICT_MODES:
        raise ValueError(f"on_conflict must be one of {CONFLICT_MODES}")
    keys, partition_by = list(keys), list(partition_by)
    staged_path = scratch_path(spark, "staged-batch")
    new.write.parquet(staged_path)
    staged = spark.read.schema(new.schema).parquet(staged_path)
    existing = read_stored(spark, path)
    on = keys + [c for c in partition_by if c not in keys]
    if on_conflict == "error":
        check_keys(staged, existing, on, f" at {path}")
    else:
        staged = one_per_key(staged, on)

    def commit() -> DataFrame:
        out, mode = staged, "append"
        if existing is not None and on_conflict == "skip":
            out = staged.join(existing.select(*on), on, "left_anti")
        elif existing is not None and on_conflict == "replace":
            scope = existing
            if partition_by:
                scope = existing.join(staged.select(*partition_by).distinct(), partition_by,
                                      "left_semi")
            checkpoint_root(spark)
            out = append_unique(staged, scope, on, "replace").checkpoint(eager=True)
            mode = "overwrite"
        (laid_out(out, partition_by, keys).write.mode(mode)
         .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))
        return spark.read.schema(new.schema).parquet(path) if existing is None \
            else spark.read.parquet(path)
    return commit


def write_unique(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str],
                 on_conflict: str = "error", partition_by: Sequence[str] = ()) -> DataFrame:
    """Check and append ``new`` to the parquet table at ``path``."""
    return prepare_unique(spark, new, path, keys, on_conflict, partition_by)()
