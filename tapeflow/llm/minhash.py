"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's set is its distinct 5-word shingles as 64-bit hashes; its sketch
the ``SKETCH`` smallest of them.  Documents with equal sets are one class.

Candidates come from inverted lists of the smallest ``RANKS`` values.  Two sets
with Jaccard similarity s have a common value among the r smallest of their
union but with probability (1 - s)^r, so a pair is looked for at its common
values whose ranks add up to less than ``RANKS``: at 0.75 that misses fewer
than one pair in four million, at higher similarity far fewer.  The sketches
of a pair, merged, estimate its similarity; what lies more than ``SIGMAS``
standard errors below the threshold goes: fewer than 28 of 64 common values,
which a pair at 0.75 has with probability 2.5e-8 (exact binomial tail).  With
the candidates' 2.4e-7 a pair at 0.75 is missed with probability 2.7e-7 at
most, less above it.  All others are verified on the full sets, 100 |A ∩ B| >= 75 |A ∪ B|, and only verified links count.

Long lists (a passage that a third of the documents share, a large group of
near copies) are not paired within themselves at once.  First every member of
a list is compared with one member of nearly its size (a star), links are
verified and components found.  What is left are pairs across components: in
short lists by a self-join, in long ones by pairs of blocks of bounded size,
each a task group that counts common sketch values and returns the few pairs
which may still link.  Where most pairs may, the group compares full sets
instead and returns a spanning forest of the links it finds (on 48 bits of
each hash; the forest's links are verified like all others).  So no pair is
skipped but by these chances, and none is listed that is linked already.

Texts are read once for the sketches and again to verify; full sets are made
where a pair is verified and never stored.

Defined cases: null and empty texts (or without words) have the empty set,
n_shingles 0, and link with nothing.  Fewer than five words are one shingle.
Each row of a repeated doc_id is judged by its own text; classes whose smallest
id is the same are one node.  A null doc_id links with nothing, has a null
component_id and is kept.  An empty table gives
no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import stored
from tapeflow.llm.components import connected_components
from tapeflow.llm.shingles import WordHashes, shingle_set

WIDTH = 5
SKETCH = 64
RANKS = 11
PERCENT = 75            # Jaccard similarity, in hundredths
SIGMAS = 6.0
SHORT_LIST = 48         # longer lists are paired in blocks
BLOCK = 1024
DENSE = 4               # possible pairs per member from which full sets are compared
COLUMNS = 4096          # width of a 0/1 matrix
CACHED_SETS = 64        # full sets that a verifying task remembers
_HASHES = WordHashes()  # per Python worker; emptied when a task ends, an idle worker holds none


def _sketches(batches):
    """Columns after the text are carried along."""
    for batch in batches:
        size, key, sketch = [], [], []
        for text in batch["text"].to_pylist():
            s = shingle_set(text, _HASHES, WIDTH)
            size.append(len(s))
            key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sketch.append(s[:SKETCH].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(size, pa.int64()), pa.array(key, pa.binary()),
             pa.array(sketch, pa.binary()), *batch.columns[2:]],
            names=["doc_id", "size", "key", "sketch", *batch.schema.names[2:]])
    _HASHES.clear()


def _postings(batches):
    """A class's smallest sketch values → (value, rank) rows."""
    for batch in batches:
        low = [np.frombuffer(x, np.int64) for x in batch["low"].to_pylist()]
        n = np.array([len(x) for x in low], np.int64)
        at = pa.array(np.repeat(np.arange(len(n)), n))
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([*low, np.empty(0, np.int64)]), pa.int64()),
             pa.array(rank, pa.int32()), batch["node"].take(at), batch["size"].take(at)],
            names=["value", "rank", "node", "size"])


def estimate(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> tuple[float, int]:
    """Similarity from merged sketches, and how many values of the union it
    rests on (the union's smallest that both sketches know to the end)."""
    whole = size_a <= SKETCH and size_b <= SKETCH
    union = np.union1d(a, b)
    if not whole:
        union = union[:SKETCH]
    both = np.intersect1d(a, b, assume_unique=True)
    return np.isin(union, both, assume_unique=True).mean(), 0 if whole else len(union)


def _possible(a, b, size_a, size_b, percent: int) -> bool:
    s, n = estimate(a, b, size_a, size_b)
    t = percent / 100
    return s >= (t - 1e-9 if n == 0 else t - SIGMAS * np.sqrt(t * (1 - t) / n))


def _likely(percent: int):
    """Pairs whose merged sketches do not rule them out."""
    def run(batches):
        for batch in batches:
            a, b = batch["sketch_a"].to_pylist(), batch["sketch_b"].to_pylist()
            m, n = batch["size_a"].to_pylist(), batch["size_b"].to_pylist()
            keep = [_possible(np.frombuffer(a[i], np.int64), np.frombuffer(b[i], np.int64),
                              m[i], n[i], percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _verified(percent: int):
    """Pairs whose full sets are similar enough (texts come sorted by b)."""
    def run(batches):
        known: dict[int, np.ndarray] = {}

        def full(node: int, text: str) -> np.ndarray:
            if node not in known:
                if len(known) >= CACHED_SETS:
                    known.clear()
                known[node] = shingle_set(text, _HASHES, WIDTH)
            return known[node]

        for batch in batches:
            keep = []
            columns = [batch[c].to_pylist() for c in ("a", "text_a", "b", "text_b")]
            for a, text_a, b, text_b in zip(*columns, strict=True):
                x, y = full(a, text_a), full(b, text_b)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        _HASHES.clear()
    return run


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values sets ``a`` and ``b`` have in common, pair by pair, as a
    product of 0/1 matrices over the values that occur twice here."""
    values, which = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.flatnonzero(np.bincount(which) > 1)
    column = np.full(len(values), -1)
    column[often] = np.arange(len(often))
    use = column[which] >= 0
    owner, at = owner[use], column[which][use]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(often), COLUMNS):
        here = (at >= lo) & (at < lo + COLUMNS)
        m = np.zeros((len(sets), min(COLUMNS, len(often) - lo)), np.float32)
        m[owner[here], at[here] - lo] = 1
        out += m[a] @ m[b].T
    return out


def _open_pairs(pdf: pd.DataFrame, percent: int):
    """Positions of the two sides of a block pair, and which pairs are still
    to be judged: of different components, of fitting size and rank."""
    side, size = pdf["side"].to_numpy(), pdf["size"].to_numpy(np.int64)
    rank, part = pdf["rank"].to_numpy(), pdf["component"].to_numpy(np.int64)
    same = bool(pdf["lo"].iat[0] == pdf["hi"].iat[0])
    a = np.arange(len(pdf)) if same else np.flatnonzero(side == 0)
    b = a if same else np.flatnonzero(side == 1)
    ok = (part[a][:, None] != part[b][None, :]) \
        & (rank[a][:, None] + rank[b][None, :] < RANKS) \
        & (100 * np.minimum(size[a][:, None], size[b][None, :])
           >= percent * np.maximum(size[a][:, None], size[b][None, :]))
    return a, b, np.triu(ok, 1) if same else ok


def _cross_block(percent: int):
    """Pairs of one long list (a block, or two) that may link by their sketches.
    Where nearly all may, as in a large group of near copies, the members are
    returned instead (without ``b``), for their full sets to be compared."""
    t = percent / 100

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, size = pdf["node"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64)
        sketches = [np.frombuffer(s, np.int64) for s in pdf["sketch"]]
        a, b, ok = _open_pairs(pdf, percent)
        x = y = np.empty(0, np.int64)
        dense = False
        if ok.any():
            n = np.minimum(SKETCH, np.maximum(size[a][:, None], size[b][None, :]))
            ok &= _common(sketches, a, b) >= np.floor(
                (t - SIGMAS * np.sqrt(t * (1 - t) / n)) * n)
            dense = ok.sum() > DENSE * (len(a) + len(b))
            if dense:
                x = np.union1d(node[a[ok.any(1)]], node[b[ok.any(0)]])
            else:
                i, j = np.nonzero(ok)
                keep = [k for k in range(len(i)) if _possible(
                    sketches[a[i[k]]], sketches[b[j[k]]], size[a[i[k]]], size[b[j[k]]], percent)]
                x, y = node[a[i[keep]]], node[b[j[keep]]]
                x, y = np.minimum(x, y), np.maximum(x, y)
        other = pd.array([pd.NA] * len(x) if dense else y, dtype="Int64")
        return pd.DataFrame({"value": np.full(len(x), pdf["value"].iat[0]), "a": x, "b": other})
    return run


def _packed_sets(batches):
    """Full sets with 48 of each hash's 64 bits."""
    for batch in batches:
        sets = [shingle_set(t, _HASHES, WIDTH).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
                for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())],
                                         names=["node", "full"])
    _HASHES.clear()


def _unpacked(full: bytes) -> np.ndarray:
    six = np.frombuffer(full, np.uint8).reshape(-1, 6)
    return np.hstack([np.zeros((len(six), 2), np.uint8), six]).view(np.int64).ravel()


def _exact_block(percent: int):
    """Links of a block pair on full sets, as a spanning forest of them."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, size = pdf["node"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64)
        a, b, ok = _open_pairs(pdf, percent)
        edges: list[tuple[int, int]] = []
        if ok.any():
            common = _common([_unpacked(f) for f in pdf["full"]], a, b)
            ok &= 100 * common >= percent * (size[a][:, None] + size[b][None, :] - common)
            top = list(range(len(pdf)))

            def root(k: int) -> int:
                while top[k] != k:
                    top[k] = top[top[k]]
                    k = top[k]
                return k
            for i, j in zip(a[np.nonzero(ok)[0]].tolist(), b[np.nonzero(ok)[1]].tolist(),
                            strict=True):
                if root(i) != root(j):
                    top[root(j)] = root(i)
                    edges.append((min(node[i], node[j]), max(node[i], node[j])))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")
    return run


def _likely_pairs(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    sketches = rows.select("doc_id", "size", "sketch")
    one = pairs.join(sketches, F.col("a") == F.col("doc_id")).select(
        "a", "b", F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"))
    two = one.join(sketches, F.col("b") == F.col("doc_id")).select(
        "a", "b", "size_a", "sketch_a", F.col("size").alias("size_b"),
        F.col("sketch").alias("sketch_b"))
    return two.mapInArrow(_likely(percent), "a long, b long")


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Verified ``pairs`` (stored: read by more than one job)."""
    one = pairs.join(texts, F.col("a") == F.col("doc_id")).select(
        "a", "b", F.col("text").alias("text_a"))
    two = one.join(texts, F.col("b") == F.col("doc_id")).select(
        "a", "text_a", "b", F.col("text").alias("text_b"))
    return two.mapInArrow(_verified(percent), "a long, b long")


def _star_pairs(long: DataFrame, percent: int) -> DataFrame:
    """Each member of a long list with the first member of its size band and
    of the band below (sizes of a similar pair are at most a band apart).  A
    list's members meet their leader in parts of about ``BLOCK``, by a hash of
    the node, with the leader in every part."""
    step = float(np.log(100 / percent))
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    member = long.withColumn("band", F.floor(F.log("size") / step))
    leader = member.groupBy("value", "band").agg(
        F.min_by(F.struct("node", "size"), "node").alias("first"), F.max(parts).alias("parts"))
    leader = leader.select("value", "band", "first", F.explode(
        F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    near = member.withColumn("band", F.explode(F.array("band", F.col("band") - 1))) \
        .withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    return (near.join(leader, ["value", "band", "part"])
            .filter((F.col("node") != F.col("first.node"))
                    & _sizes_fit(F.col("size"), F.col("first.size"), percent))
            .select(F.least("node", "first.node").alias("a"),
                    F.greatest("node", "first.node").alias("b")).distinct())


def _short_pairs(short: DataFrame, percent: int) -> DataFrame:
    """Pairs within lists of at most ``SHORT_LIST`` members, across components."""
    x, y = short.alias("x"), short.alias("y")
    return (x.join(y, F.col("x.value") == F.col("y.value"))
            .filter((F.col("x.node") < F.col("y.node"))
                    & (F.col("x.component") != F.col("y.component"))
                    & (F.col("x.rank") + F.col("y.rank") < RANKS)
                    & _sizes_fit(F.col("x.size"), F.col("y.size"), percent))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())


def _dealt(members: DataFrame, payload: DataFrame, column: str) -> DataFrame:
    """(value, lo, hi) groups of a list's members with their ``payload``:
    every pair of blocks of about ``BLOCK`` members."""
    blocks = members.groupBy("value").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1"),
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")) \
        .filter(F.col("c0") != F.col("c1")).select("value", "blocks")
    return (members.join(blocks, "value").join(payload, "node")
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("value", "node", "size", "rank", "component", column,
                    F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                    F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
            .groupBy("value", "lo", "hi"))


def _long_pairs(long: DataFrame, rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs across components within long lists that link or may link."""
    sketches = rows.select(F.col("doc_id").alias("node"), "sketch")
    found = stored(_dealt(long, sketches, "sketch").applyInPandas(
        _cross_block(percent), "value long, a long, b long"), "long-pairs")
    dense = found.filter(F.col("b").isNull()).select("value", F.col("a").alias("node")).distinct()
    need = dense.select(F.col("node").alias("__llm_node")).distinct()
    full = texts.join(need, F.col("doc_id") == F.col("__llm_node")) \
        .select(F.col("doc_id").alias("node"), "text") \
        .mapInArrow(_packed_sets, "node long, full binary")
    forest = _dealt(long.join(dense, ["value", "node"], "left_semi"), full, "full") \
        .applyInPandas(_exact_block(percent), "a long, b long")
    return found.filter(F.col("b").isNotNull()).select("a", "b").unionByName(forest).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, carry: Sequence[str] = ()
                    ) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row (see the module),
    and its columns ``carry`` (strings, not of these names)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    rows = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.col("text").cast("string").alias("text"), *carry).mapInArrow(
            _sketches, ", ".join(["doc_id long, size long, key binary, sketch binary",
                                  *(f"{c} string" for c in carry)])), "sketches")
    named = rows.filter(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    classes = stored(named.groupBy("key").agg(
        F.min("doc_id").alias("node"), F.first("size").alias("size"),
        F.first(F.substring("sketch", 1, 8 * RANKS)).alias("low")), "classes")
    postings = classes.select("node", "size", "low").mapInArrow(
        _postings, "value long, rank int, node long, size long")
    lists = postings.groupBy("value").agg(F.count(F.lit(1)).alias("members"))         .filter(F.col("members") > 1)
    listed = stored(postings.join(lists, "value"), "lists")
    is_long = F.col("members") > SHORT_LIST
    reps = named.select("doc_id", "size", "sketch")

    # One member per size band of a long list against all others first.
    stars = stored(_likely_pairs(_star_pairs(listed.filter(is_long), percent), reps, percent),
                   "star-pairs")
    star_links = stored(_links(stars, texts, percent), "star-links")
    parts = connected_components(star_links, "a", "b")
    placed = stored(listed.join(parts, "node", "left").withColumn(
        "component", F.coalesce("component", "node")), "placed-lists")

    # Then every pair across components.
    short = _likely_pairs(_short_pairs(placed.filter(~is_long), percent), reps, percent)
    long = _long_pairs(placed.filter(is_long), reps, texts, percent)
    rest = stored(short.unionByName(long).distinct(), "pairs")
    links = stored(_links(rest, texts, percent), "rest-links")

    found = connected_components(links.unionByName(star_links), "a", "b")
    of_class = classes.select("key", "node").join(found, "node", "left").select(
        "key", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "size", "key", *carry).join(of_class, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"),
                      component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *carry)
