"""Mixing sources to target weights by Pfair scheduling (DataFrame code only).

Each source is a stream of blocks of ``block_bytes`` (its documents in hash
order).  With target weight w, its share of the sum of weights, block i of a
source is released at floor(i/w) and due at ceil((i+1)/w); earliest-deadline-
first over released blocks then keeps every source within one block of its
target at every moment.  Releases and deadlines are exact integer quotients of
the weights as given, so the bound holds over any number of slots.  When a
source runs out, a new phase begins: the others go on with their weights scaled
up.  No document is dropped or repeated.

Only per-source totals reach the driver (one row for each source of the weight
table).  The schedule is worked out there, a slot for each block, and written
to the shared scratch folder.  Blocks grow with the corpus beyond ``MAX_SLOTS``
blocks of the size asked for, so the schedule has at most that many slots (and
one more for each source), whatever the number of documents or sources.
Documents get their block by an exact two-level prefix sum, so a source with a
third of all rows is no single window, and their slot by a join on (source,
block), without a hint.

Defined cases: a null source is a source of its own.  Null or empty texts
weigh one byte.  Documents longer than a block count as many.  Repeated rows
are separate documents.  An empty table gives no rows.  Weights must be
positive; sources without a given weight take part by their default one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import buckets_for, hash_order, json_table, running_totals, stored

BLOCK_BYTES = 64 * 1024
MAX_SLOTS = 1 << 20
TEMPERATURE = 0.5  # default weight of a source: its share of bytes to this power
RUN = 4096         # slots in one row of the written schedule


def earliest_deadlines(blocks: Mapping, weights: Mapping) -> Iterator[tuple[int, list]]:
    """(phase, the source of each of its slots).  Sources are taken with exact
    weights; a phase ends with the slot in which a source gives its last block."""
    left = {s: n for s, n in blocks.items() if n > 0}
    exact = {s: Fraction(weights[s]) for s in left}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    phase = 0
    while left:
        scale = 1  # weights as integers over their sum
        for s in left:
            scale = max(scale, exact[s].denominator)
        for s in left:
            if scale % exact[s].denominator:
                scale *= exact[s].denominator
        part = {s: int(exact[s] * scale) for s in left}
        whole = sum(part.values())
        given = dict.fromkeys(left, 0)
        ready = [(-(-whole // part[s]), s) for s in left]  # (deadline of its next block, source)
        heapq.heapify(ready)
        later: list[tuple[int, str]] = []                  # (release of its next block, source)
        slots: list = []
        while True:
            now = len(slots)
            while later and later[0][0] <= now:
                s = heapq.heappop(later)[1]
                heapq.heappush(ready, (-(-(given[s] + 1) * whole // part[s]), s))
            s = heapq.heappop(ready)[1]  # released work never falls behind time: not empty
            slots.append(s)
            given[s] += 1
            if given[s] == left[s]:
                break
            heapq.heappush(later, (given[s] * whole // part[s], s))
        yield phase, slots
        left = {s: n - given[s] for s, n in left.items() if n > given[s]}
        phase += 1


def schedule(blocks: Mapping, weights: Mapping) -> Iterator[dict]:
    """The slots of each source's blocks in runs of at most ``RUN``: source
    ``s``, phase ``p``, its first ``block``, and the ``slots``."""
    done = dict.fromkeys(blocks, 0)
    start = 0
    for phase, order in earliest_deadlines(blocks, weights):
        held: dict = {}

        def run(s):
            slots = held.pop(s)
            row = {"s": s, "p": phase, "block": done[s], "slots": slots}
            done[s] += len(slots)
            return row
        for t, s in enumerate(order, start):
            held.setdefault(s, []).append(t)
            if len(held[s]) == RUN:
                yield run(s)
        yield from [run(s) for s in list(held)]
        start += len(order)


def mixed(docs: DataFrame, weights: Mapping | None = None, block_bytes: int = BLOCK_BYTES,
          source: str = "source") -> DataFrame:
    """Order of the mixture: per row its doc_id, source, size, ``block`` (of
    its source), ``phase``, ``slot`` (of the schedule) and ``place`` (inside
    the slot).  Sort by slot, place to read the mixture."""
    return _mixed(docs, weights, block_bytes, source, False)[0]


def mixed_rows(docs: DataFrame, weights: Mapping | None = None, block_bytes: int = BLOCK_BYTES,
               source: str = "source") -> tuple[DataFrame, int, int]:
    """All columns of ``docs`` with ``__llm_slot`` and ``__llm_place``, the
    number of slots and the bytes of a block."""
    return _mixed(docs, weights, block_bytes, source, True)


def _mixed(docs: DataFrame, weights: Mapping | None, block_bytes: int, source: str,
           keep: bool) -> tuple[DataFrame, int, int]:
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))
    size = F.greatest(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))),
                      F.lit(1)).cast("long")
    base = docs if keep else docs.select("doc_id", F.col(source), "text")
    keyed = (base.withColumn("__llm_source", name).withColumn("__llm_size", size)
             .withColumn("__llm_order", hash_order(F.col("doc_id"), size)))
    if not keep:
        keyed = stored(keyed.drop("text"), "mix-keys")
    totals = {r[0]: (r[1], r[2]) for r in keyed.groupBy("__llm_source").agg(
        F.sum("__llm_size"), F.count(F.lit(1))).collect()}
    all_bytes = sum(b for b, _ in totals.values()) or 1
    block_bytes = max(block_bytes, -(-all_bytes // MAX_SLOTS))
    # The last block of a source is the one its last byte is in.
    blocks = {s: -(-b // block_bytes) for s, (b, _) in totals.items()}
    given = {("-" if s is None else f"={s}"): float(w) for s, w in (weights or {}).items()}
    target = {s: given.get(s, (b / all_bytes) ** TEMPERATURE) for s, (b, _) in totals.items()}
    runs = json_table(spark, schedule(blocks, target),
                      "s string, p int, block long, slots array<long>", "schedule")
    at = runs.select(F.col("s").alias("__llm_s"), F.col("p").alias("__llm_p"),
                     F.col("block").alias("__llm_first"),
                     F.posexplode("slots").alias("__llm_i", "__llm_slot")) \
        .withColumn("__llm_b", F.col("__llm_first") + F.col("__llm_i"))
    rows = sum(n for _, n in totals.values())
    ranked = running_totals(keyed, "__llm_source", "__llm_order", ["doc_id"], "__llm_size",
                            buckets_for(spark, rows))
    out = (ranked.withColumn("__llm_block", F.floor(F.col("__llm_before") / block_bytes))
           .join(at, (F.col("__llm_source") == F.col("__llm_s"))
                 & (F.col("__llm_block") == F.col("__llm_b")))
           .withColumn("__llm_place", F.col("__llm_rank")))
    if keep:
        return (out.select(*docs.columns, "__llm_slot", "__llm_place"), sum(blocks.values()),
                block_bytes)
    return out.select("doc_id", F.col(source).alias("source"),
                      F.col("__llm_size").alias("size"),
                      F.col("__llm_block").alias("block"), F.col("__llm_p").alias("phase"),
                      F.col("__llm_slot").alias("slot"), F.col("__llm_place").alias("place")), \
        sum(blocks.values()), block_bytes
