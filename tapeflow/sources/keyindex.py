"""Key filters of stored rows: which folders may hold a key, asked before any
of their rows is read.

For every partition folder that a run writes, the keys are dealt by hash to
blocks of about ``KEYS_PER_BLOCK``.  A block's row has a 256-bit Bloom filter
(four longs, eight bits a key) and the least and greatest value of each key
column.  Filters are made by ``bit_or``, ``min`` and ``max``, so map tasks
combine them; they take a few bytes a key.  A key that is stored is always
found; one that is not is found with a chance of about one in a hundred, and
then the stored rows decide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS_PER_BLOCK = 16
WORDS = ("w0", "w1", "w2", "w3")
FOLDER = "_batch"  # of the rows a filter is for


def _masks(keys: Sequence[str]) -> list[Column]:
    """The bits of a key in each word: two of 64, from a second hash."""
    h = F.xxhash64(F.lit("bits"), *(F.col(k) for k in keys))

    def bit(k: int) -> Column:
        place = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)
    return [bit(2 * k).bitwiseOR(bit(2 * k + 1)) for k in range(len(WORDS))]


def _block(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k) for k in keys)), F.col("blocks"))


def key_filters(rows: DataFrame, keys: Sequence[str], partition_by: Sequence[str],
                batch: str) -> DataFrame:
    """The filters of the rows that ``batch`` wrote.  Rows with a NULL
    partition value have none; no key of theirs can be met."""
    rows = rows.select(*dict.fromkeys([*partition_by, *keys]))
    sizes = rows.groupBy(*partition_by).agg(
        F.ceil(F.count(F.lit(1)) / KEYS_PER_BLOCK).cast("long").alias("blocks"))
    if partition_by:
        sized = rows.join(sizes, list(partition_by))
    else:  # one folder: its size is a scalar
        sized = rows.withColumn("blocks", sizes.scalar())
    masks = [m.alias(w) for w, m in zip(WORDS, _masks(keys))]
    marked = sized.select(*rows.columns, "blocks", _block(keys).alias("block"), *masks)
    return marked.groupBy(*partition_by, "blocks", "block").agg(
        *(F.bit_or(w).alias(w) for w in WORDS),
        *(f(k).alias(f"{k}_{n}") for k in keys for n, f in (("least", F.min), ("most", F.max)))) \
        .withColumn(FOLDER, F.lit(batch))


def may_be_stored(batch: DataFrame, filters: DataFrame, keys: Sequence[str],
                  partition_by: Sequence[str]) -> DataFrame:
    """The (folder, partition)s that may hold a key of ``batch``."""
    mine = batch.select(*dict.fromkeys([*partition_by, *keys]))
    folders = filters.select(FOLDER, *partition_by, "blocks").distinct()
    if partition_by:
        asked = mine.join(folders, list(partition_by))
    else:  # every folder may hold any key
        asked = mine.withColumn("_f", F.explode(folders.groupBy().agg(
            F.collect_list(F.struct(FOLDER, "blocks"))).scalar())).select(*mine.columns, "_f.*")
    asked = asked.select(FOLDER, *mine.columns, _block(keys).alias("block"),
                         *(m.alias(f"_{w}") for w, m in zip(WORDS, _masks(keys))))
    found = asked.join(filters.drop("blocks"), [FOLDER, *partition_by, "block"])
    hit = F.lit(True)
    for w in WORDS:
        hit = hit & (F.col(w).bitwiseAND(F.col(f"_{w}")) == F.col(f"_{w}"))
    for k in keys:
        hit = hit & F.col(k).between(F.col(f"{k}_least"), F.col(f"{k}_most"))
    return found.filter(hit).select(FOLDER, *partition_by).distinct()
