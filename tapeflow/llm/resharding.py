"""Minimum-cost-flow resharding: new shards of equal bytes, fewest bytes moved.

Only numbers per shard reach the driver: the old shards' sizes and the few
documents that are large against a shard (``LARGE_PARTS`` of them fit in one,
so there are at most ``LARGE_PARTS`` × shards).  Large documents are placed
one by one; the rest of each new shard is its remaining capacity.  The flow
from old shards (supplies) to new shards (capacities), at cost 0 for bytes
that stay and 1 for bytes that move, gives for each old shard the byte ranges
that go to each new shard.

Spark applies it: a document's place in its old shard is an exact prefix sum
over hash-ordered blocks (no task sees a whole shard), and the range it falls
into is its new shard.  ``rewrite`` then writes only shards whose rows changed,
and removes those that no row is left in.

Defined cases: a null text has no bytes (size 16, the fixed overhead).  A null
source or doc_id hashes like any other value.  Repeated rows are separate rows.
An empty table gives no rows.  Extra columns are ignored by the plan.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeflow.llm.common import (
    buckets_for, hash_order, literal_table, running_totals, stored)

OVERHEAD = 16
OLD_SHARDS = 32
NEW_SHARDS = 40
LARGE_PARTS = 64
SPREAD = 64  # parts in which rows of an equal key are numbered
KEY = ("doc_id", "size", "text_crc32")


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int],
                  cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """Cheapest shipment of all ``supply`` into ``capacity`` (equal totals).

    Successive shortest paths with node potentials on the bipartite shard
    graph; ``cost`` is per unit and not negative.
    """
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    pot = [0] * (n + m)
    for source in range(n):
        while left[source] > 0:
            dist, via = {source: 0}, {}
            heap, done = [(0, source)], set()
            while heap:
                d, u = heapq.heappop(heap)
                if u in done:
                    continue
                done.add(u)
                steps = ([(n + j, cost[u][j]) for j in range(m)] if u < n else
                         [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n] > 0])
                for v, c in steps:
                    nd = d + c + pot[u] - pot[v]
                    if v not in dist or nd < dist[v]:
                        dist[v], via[v] = nd, u
                        heapq.heappush(heap, (nd, v))
            sink = min((j for j in range(m) if room[j] > 0),
                       key=lambda j: (dist[n + j] + pot[n + j], j))
            far = max(dist.values())
            path, v = [], n + sink
            while v != source:
                path.append((via[v], v))
                v = via[v]
            amount = min(left[source], room[sink])
            for u, v in path:
                if u >= n:
                    amount = min(amount, flow[v][u - n])
            for u, v in path:
                if u < n:
                    flow[u][v - n] += amount
                else:
                    flow[v][u - n] -= amount
            left[source] -= amount
            room[sink] -= amount
            for v in range(n + m):
                pot[v] += min(dist.get(v, far), dist[n + sink])
    return flow


def water_level(total: int, loads: Sequence[int]) -> int:
    """The height to which ``total`` more bytes fill shards of these loads."""
    used, height = 0, 0
    for k, load in enumerate(sorted(loads), 1):
        if k > 1 and load >= height:
            break
        used += load
        height = (total + used) // k
    return height


def equal_capacities(total: int, loads: Sequence[int]) -> list[int]:
    """What each shard may still take so that all end level; ``total`` is
    given out to the byte."""
    level = water_level(total, loads)
    out = [max(0, level - x) for x in loads]
    rest = total - sum(out)
    for j in sorted(range(len(loads)), key=lambda j: loads[j])[:rest]:
        out[j] += 1
    return out


def old_layout(n: int = OLD_SHARDS) -> Column:
    """The layout to move away from when none is stored: one shard per hash
    of ``source``, as data lands; a hot source makes a hot shard."""
    return F.pmod(F.xxhash64(F.col("source")), F.lit(n)).cast("int")


def _key() -> list[Column]:
    """A row's values of ``KEY``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").cast("long"), (F.octet_length(text) + OVERHEAD).cast("long"),
            F.crc32(text.cast("binary"))]


def shard_keys(docs: DataFrame, old_shard: Column) -> DataFrame:
    """doc_id, size, text_crc32 and old shard of every row; no text moves on."""
    return docs.select(*(c.alias(name) for name, c in zip(KEY, _key(), strict=True)),
                       old_shard.alias("old_shard"))


def reshard_plan(keys: DataFrame, shards: int = NEW_SHARDS, old_shards: int = OLD_SHARDS
                 ) -> DataFrame:
    """``keys`` (see ``shard_keys``; stored, as it is read more than once) with
    ``shard`` and ``slot``: bytes per shard near equal, fewest bytes moved."""
    spark = keys.sparkSession
    sizes = {r[0]: (r[1], r[2]) for r in keys.groupBy("old_shard").agg(
        F.sum("size"), F.count(F.lit(1))).collect()}
    rows = sum(n for _, n in sizes.values())
    total = sum(b for b, _ in sizes.values())
    buckets = buckets_for(spark, rows)
    limit = max(1, total // (shards * LARGE_PARTS))
    keyed = keys.withColumn("__llm_order", hash_order("doc_id", "text_crc32", "size"))
    ranked = running_totals(
        keyed.withColumn("__llm_small", F.when(F.col("size") <= limit, F.col("size"))
                         .otherwise(F.lit(0))),
        "old_shard", "__llm_order", ["doc_id", "text_crc32"], "__llm_small", buckets)
    ranked = stored(ranked, "old-places")
    # Bounded: fewer than shards × LARGE_PARTS rows are above the limit.
    large = ranked.filter(F.col("size") > limit).select(
        "size", "old_shard", "__llm_rank").collect()
    load, rest = [0] * shards, total
    placed = []
    for r in sorted(large, key=lambda r: (-r[0], r[1], r[2])):
        # It stays if its own shard then still ends level with the others.
        to = r[1]
        if to >= shards or load[to] + r[0] > water_level(rest, load):
            to = min(range(shards), key=lambda j: (load[j], j))
        load[to] += r[0]
        rest -= r[0]
        placed.append({"o": r[1], "k": r[2], "j": to})
    small = [sizes.get(i, (0, 0))[0] for i in range(old_shards)]
    for r in large:
        small[r[1]] -= r[0]
    room = equal_capacities(sum(small), load)
    flow = min_cost_flow(small, room, [[int(i != j) for j in range(shards)]
                                       for i in range(old_shards)])
    ranges = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted((j for j in range(shards) if row[j]), key=lambda j: (j != i, j)):
            ranges.append({"o": i, "lo": at, "hi": at + row[j], "j": j})
            at += row[j]
    one = literal_table(spark, placed, "o int, k long, j int")
    span = literal_table(spark, ranges, "o int, lo long, hi long, j int")
    middle = F.col("__llm_before") + F.shiftright("size", 1)
    # Both tables are bounded by shard counts alone, so broadcasting them is safe.
    assigned = (ranked.filter(F.col("size") > limit)
                .join(F.broadcast(one), (F.col("old_shard") == F.col("o"))
                      & (F.col("__llm_rank") == F.col("k")))
                .select("doc_id", "size", "text_crc32", "old_shard", "__llm_order",
                        F.col("j").alias("shard"))
                .unionByName(
                    ranked.filter(F.col("size") <= limit)
                    .join(F.broadcast(span), (F.col("old_shard") == F.col("o"))
                          & (middle >= F.col("lo")) & (middle < F.col("hi")))
                    .select("doc_id", "size", "text_crc32", "old_shard", "__llm_order",
                            F.col("j").alias("shard"))))
    out = running_totals(assigned, "shard", "__llm_order", ["doc_id", "text_crc32", "old_shard"],
                         "size", buckets)
    return out.select("doc_id", "size", "text_crc32", "old_shard", "shard",
                      F.col("__llm_rank").alias("slot"))


def _same(*columns: str) -> Column:
    """Null-safe: equal ``__llm_…`` and ``__llm_to_…`` columns of two tables."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"__llm_{c}").eqNullSafe(F.col(f"__llm_to_{c}"))
    return same


def _named(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"__llm_to_{c}") for c in columns))


def _targets(plan: DataFrame) -> DataFrame:
    """How many rows of a key go to a shard: those numbered from ``lo`` up to
    ``hi`` of the key's ``rows``; ``first`` is its first shard."""
    whole = Window.partitionBy(*KEY)
    up = whole.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return stored(
        plan.groupBy(*KEY, "shard").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("rows", F.sum("n").over(whole)).withColumn("hi", F.sum("n").over(up))
        .withColumn("first", F.min("shard").over(whole))
        .withColumn("lo", F.col("hi") - F.col("n")).drop("n"), "shard-targets")


def _dealt(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` (stored, with a unique ``__llm_row``) whose keys repeat, each with
    a shard.  They are numbered within ``SPREAD`` parts of a key, so that a key
    with many rows is no single task."""
    rows = rows.withColumn("__llm_part", F.pmod("__llm_row", F.lit(SPREAD)).cast("int"))
    names = [f"__llm_{c}" for c in KEY]
    up = Window.partitionBy(*names).orderBy("__llm_part").rowsBetween(
        Window.unboundedPreceding, 0)
    parts = (rows.groupBy(*names, "__llm_part").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("to", F.sum("n").over(up)).withColumn("at", F.col("to") - F.col("n")))
    wanted = _named(targets, *KEY, "lo", "hi", "shard")
    ranges = _named(
        parts.join(wanted, _same(*KEY) & (F.col("__llm_to_lo") < F.col("to"))
                   & (F.col("at") < F.col("__llm_to_hi")))
        .select(*(F.col(f"__llm_{c}").alias(c) for c in (*KEY, "part")),
                (F.col("__llm_to_lo") - F.col("at")).alias("lo"),
                (F.col("__llm_to_hi") - F.col("at")).alias("hi"),
                F.col("__llm_to_shard").alias("shard")), *KEY, "part", "lo", "hi", "shard")
    number = F.row_number().over(Window.partitionBy(*names, "__llm_part").orderBy("__llm_row")) - 1
    return rows.withColumn("__llm_number", number).join(
        ranges, _same(*KEY, "part") & (F.col("__llm_number") >= F.col("__llm_to_lo"))
        & (F.col("__llm_number") < F.col("__llm_to_hi")))


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def rewrite(docs: DataFrame, plan: DataFrame, out_dir: str) -> list[int]:
    """Write the shards that the plan changes as ``out_dir/shard=N`` and return
    their numbers; files of all other shards are left as they are.  ``docs``
    are the rows that the plan was made from, read from elsewhere; ``plan`` is
    stored, as it is read more than once.  Each row is written once, by its
    null-safe key (doc_id, size and text_crc32).  Rows with equal keys are dealt
    to the key's shards; they may differ in other columns, so if one of these
    shards changes all are written.

    Dynamic overwrite replaces the written shards after all tasks have
    succeeded.  Then the folders of changed shards without rows are removed;
    if the run ends in between, the same call again completes it."""
    spark = docs.sparkSession
    moved = plan.filter(F.col("old_shard") != F.col("shard"))
    touched = {r[0] for r in moved.select(F.explode(F.array("old_shard", "shard")))
               .distinct().collect()}  # shard numbers only
    if not touched:
        return []
    targets = _targets(plan)
    # At most shards² pairs of shards and shards numbers.
    ties = [tuple(r) for r in targets.filter(F.col("first") != F.col("shard"))
            .select("first", "shard").distinct().collect()]
    while more := {s for pair in ties if touched & set(pair) for s in pair} - touched:
        touched |= more
    filled = {r[0] for r in targets.select("shard").distinct().collect()}
    targets = targets.filter(F.col("shard").isin(sorted(touched)))

    columns = [c for c in docs.columns if c != "shard"]
    keyed = docs.select(*columns, *(c.alias(f"__llm_{name}")
                                    for name, c in zip(KEY, _key(), strict=True)))
    one = _named(targets.filter(F.col("rows") == 1), *KEY, "shard")
    many = targets.filter(F.col("rows") > 1)
    repeated = stored(keyed.join(_named(many, *KEY), _same(*KEY), "left_semi").withColumn(
        "__llm_row", F.monotonically_increasing_id()), "repeated-rows")
    spread = F.xxhash64(*(f"__llm_{c}" for c in KEY))
    out = (keyed.join(one, _same(*KEY)).select(*columns, F.col("__llm_to_shard").alias("shard"),
                                        spread.alias("__llm_spread"))
           .unionByName(_dealt(repeated, many).select(
               *columns, F.col("__llm_to_shard").alias("shard"),
               F.col("__llm_row").alias("__llm_spread"))))
    (out.repartition("shard", F.pmod("__llm_spread", F.lit(16))).drop("__llm_spread")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("shard").parquet(out_dir))
    for shard in touched - filled:
        _remove(spark, f"{out_dir}/shard={shard}")
    return sorted(touched)
