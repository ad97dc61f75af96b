"""Embedding near-dedup by randomised-rotation binary codes.

Every unit vector is turned by one fixed random rotation and kept as the signs
of its components (its code) with a correction factor: the cosine between the
vector and its code.  Code · query / factor is then an unbiased estimate of the
cosine, whose error is at most ``SIGMAS`` standard errors but in about one of
three million cases (and never more than the factor's own limit).  Only pairs
whose estimate plus that bound reaches the threshold are computed exactly, in
double precision; an estimate alone never links.

Only vectors of equal label (and length) meet.  Equal vectors are one class
with a number of copies.  The classes of a label are dealt to blocks of about
``BLOCK`` rows, and every pair of blocks is one task group, so a label with a
third of all rows is many groups of bounded size.  A group returns one row per
linked class: its links, counted, and one edge to the smallest class it hangs
together with there.  Pairs are never listed.  Components of those edges are
then found by star contraction.

Defined cases: a null label, a vector that is null, empty, zero or has a null
or non-finite component links with nothing: n_links 0, a component of its own,
kept.  A null vec_id does so too, with a null component_id, and is not kept.
Repeated rows link with each other.  Rows that share a vec_id share its links
and component.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import stored
from tapeflow.llm.components import connected_components
from tapeflow.llm.topk import sound

THRESHOLD = 0.98
BLOCK = 2048
SIGMAS = 5.0
SLACK = 1e-4       # single-precision estimates
DENSE = 0.05       # share of a block pair from which all of it is computed
SEED = 20_240_607
CLASS = ("label", "key", "dim", "node", "copies", "vector")
_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    """The same random orthogonal matrix wherever it is asked for."""
    if dim not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
        _ROTATIONS[dim] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim]


def unit(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(axis=1, keepdims=True)
    v = vectors / top  # no overflow or underflow in the squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes and correction factors of the rows."""
    turned = unit(vectors) @ rotation(vectors.shape[1])
    return (np.packbits(turned >= 0, axis=1),
            np.abs(turned).sum(1) / np.sqrt(vectors.shape[1]))


def _codes(batches):
    for batch in batches:
        pdf = batch.to_pandas()
        codes, factors = [None] * len(pdf), np.zeros(len(pdf))
        for dim, at in pdf.groupby("dim").indices.items():
            code, factor = encode(np.stack([np.asarray(v, np.float64)
                                            for v in pdf["vector"].to_numpy()[at]]))
            factors[at] = factor
            for i, c in zip(at, code, strict=True):
                codes[i] = c.tobytes()
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in CLASS), pa.array(codes, pa.binary()), pa.array(factors)],
            names=[*CLASS, "code", "factor"])


def _undecided(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray,
               threshold: float) -> np.ndarray:
    """Pairs (coded row, exact row) that the bound does not rule out."""
    dim = turned.shape[1]
    signs = (2 * np.unpackbits(codes, axis=1)[:, :dim].astype(np.float32) - 1) / np.sqrt(dim)
    estimate = (signs / factors[:, None].astype(np.float32)) @ turned.T.astype(np.float32)
    spread = np.sqrt(np.maximum(0, 1 - factors ** 2)) / factors
    error = spread * min(SIGMAS / np.sqrt(max(dim - 1, 1)), 1.0)
    return estimate >= (threshold - SLACK - error)[:, None]


def _roots(n: int, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Smallest ``order`` value reachable over the edges (i, j)."""
    root = order.copy()
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if np.array_equal(new, root):
            break
        root = new
    return root


def link_block(nodes, copies, vectors, codes, factors, side, same: bool, threshold: float):
    """Links inside a block or between two: node, links (with copies), root."""
    u = unit(vectors)
    a, b = (np.arange(len(nodes)),) * 2 if same else (
        np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    turned = u[b] @ rotation(vectors.shape[1])
    maybe = _undecided(codes[a], factors[a], turned, threshold)
    if same:
        maybe |= maybe.T  # either side's bound may keep a pair; each is looked at once
        maybe = np.triu(maybe, 1)
    if maybe.mean() > DENSE if maybe.size else False:
        i, j = np.nonzero(maybe & (u[a] @ u[b].T >= threshold))
    else:
        i, j = np.nonzero(maybe)
        exact = np.concatenate([np.einsum("ij,ij->i", u[a[i[s:s + 65536]]], u[b[j[s:s + 65536]]])
                                for s in range(0, len(i), 65536)]) if len(i) else np.empty(0)
        i, j = i[exact >= threshold], j[exact >= threshold]
    i, j = a[i], b[j]
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    root = _roots(len(nodes), i, j, nodes)
    hit = links > 0
    return nodes[hit], links[hit], root[hit]


def _link(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, links, root = link_block(
            pdf["node"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64),
            np.stack([np.asarray(v, np.float64) for v in pdf["vector"]]),
            np.stack([np.frombuffer(c, np.uint8) for c in pdf["code"]]),
            pdf["factor"].to_numpy(), pdf["side"].to_numpy(),
            bool(pdf["lo"].iat[0] == pdf["hi"].iat[0]), threshold)
        return pd.DataFrame({"node": node, "links": links, "root": root})
    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD,
                    block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    ok = F.coalesce(sound("vector") & F.exists("vector", lambda x: x != 0), F.lit(False)) \
        & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<double>").alias("vector"))
    rows = stored(rows.select("vec_id", "label", F.when(ok, F.col("vector")).alias("vector"))
                  .withColumn("key", F.md5(F.array_join("vector", ",").cast("binary"))), "vectors")
    classes = rows.filter(F.col("key").isNotNull()).groupBy("label", "key").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"),
        F.first("vector").alias("vector"))
    coded = stored(classes.withColumn("dim", F.size("vector")).select(*CLASS).mapInArrow(
        _codes, "label string, key string, dim int, node long, copies long, "
                "vector array<double>, code binary, factor double"), "codes")
    blocks = coded.groupBy("label", "dim").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = (coded.join(blocks, ["label", "dim"])
             .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("label", "dim", "node", "copies", "vector", "code", "factor",
                     F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                     F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")))
    found = stored(dealt.groupBy("label", "dim", "lo", "hi").applyInPandas(
        _link(threshold), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found, "node", "root")
    classes = coded.select("label", "node", "copies")
    named = (classes.join(links, "node", "left")
             .join(parts, "node", "left")
             .groupBy("node").agg(F.max("links").alias("links"), F.sum("copies").alias("copies"),
                                  F.min(F.coalesce("component", "node")).alias("component")))
    # The class of a row is named by its label and digest.
    keys = coded.select("label", "key", "node").join(named, "node")
    out = rows.select("vec_id", "label", "key").join(keys, ["label", "key"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.col("copies") - 1,
                             F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
