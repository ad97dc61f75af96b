"""Exact top-k search by columnar branch-and-bound.

Vectors are integers, floor(64 * x).  Candidates lie in vertical layout: one
array for each dimension.  For a query, inner products are accumulated block
of dimensions by block of dimensions; what the remaining dimensions can add is
at most the product of the remaining norms (Cauchy-Schwarz), so candidates
that cannot reach the k-th best score so far are compacted away.  The first
k-th best score comes from the candidates with the largest norms.

Spark deals (query block, candidate block) pairs to tasks; blocks have a fixed
size, so a task's memory does not grow with the table, and neither side is
broadcast.  Per pair only each query's k best leave the task; a window merges
them (with a partial limit before its shuffle).

Defined cases: vectors that are null or hold null or non-finite components and
rows without an id take no part; vectors only meet those of equal length.  Of
several rows with one vec_id the smallest vector counts.  Ties go to the
smaller vec_id.  A query with fewer than k candidates returns all of them.  An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.llm.common import stored

SCALE = 64
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 1024
DIMENSION_BLOCK = 16
SEEDS = 512
EXACT = 2.0 ** 52  # whole numbers up to here are exact in double precision


def sound(vector: str = "embedding") -> Column:
    """Not null, not empty, and every component finite."""
    bad = F.exists(vector, lambda x: F.coalesce(
        F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def whole(vectors: pd.Series) -> np.ndarray:
    x = np.floor(SCALE * np.stack([np.asarray(v, np.float64) for v in vectors]))
    if len(x) and np.abs(x).max() ** 2 * x.shape[1] >= EXACT:
        return np.array([[int(c) for c in r] for r in x], dtype=object)  # any size, exactly
    return x


def search_block(queries: np.ndarray, query_ids: np.ndarray, cands: np.ndarray,
                 cand_ids: np.ndarray, k: int):
    """Per query: positions and scores of its k best candidates here."""
    dims = queries.shape[1]
    if object in (queries.dtype, cands.dtype) or (
            np.abs(queries).max() * np.abs(cands).max() * dims >= EXACT):
        queries, cands = queries.astype(object), cands.astype(object)
        for q, own in zip(queries, query_ids, strict=True):
            at = np.flatnonzero(cand_ids != own)
            score = cands[at] @ q
            best = sorted(range(len(at)), key=lambda i: (-score[i], cand_ids[at[i]]))[:k]
            yield at[best], [int(score[i]) for i in best]
        return
    # The dimensions that tell most come first.
    order = np.argsort(-(cands ** 2).sum(0), kind="stable")
    q, c = queries[:, order], np.ascontiguousarray(cands[:, order].T)  # vertical
    cuts = list(range(0, dims, DIMENSION_BLOCK)) + [dims]
    q_rest = [np.sqrt((q[:, a:] ** 2).sum(1)) for a in cuts]
    c_rest = [np.sqrt((c[a:] ** 2).sum(0)) for a in cuts]
    seeds = np.argsort(-c_rest[0], kind="stable")[:SEEDS]
    seed_scores = q @ c[:, seeds]
    seed_scores[cand_ids[seeds][None, :] == query_ids[:, None]] = -np.inf
    if len(seeds) >= k:
        least = -np.partition(-seed_scores, k - 1, axis=1)[:, k - 1]
    else:
        least = np.full(len(q), -np.inf)
    first = q[:, :cuts[1]] @ c[:cuts[1]]
    for i, own in enumerate(query_ids):
        at = np.flatnonzero((first[i] + q_rest[1][i] * c_rest[1] >= least[i] - 0.5)
                            & (cand_ids != own))
        score = first[i][at]
        for b in range(1, len(cuts) - 1):
            score = score + q[i, cuts[b]:cuts[b + 1]] @ c[cuts[b]:cuts[b + 1], at]
            alive = score + q_rest[b + 1][i] * c_rest[b + 1][at] >= least[i] - 0.5
            at, score = at[alive], score[alive]
        best = np.lexsort((cand_ids[at], -score))[:k]
        yield at[best], score[best].astype(np.int64)


def _search(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["is_query"].to_numpy(bool)
        q, c = pdf[is_query], pdf[~is_query]
        ids, scores, owners = [], [], []
        if len(q) and len(c):
            cand_ids = c["vec_id"].to_numpy(np.int64)
            query_ids = q["vec_id"].to_numpy(np.int64)
            found = search_block(whole(q["embedding"]), query_ids, whole(c["embedding"]),
                                 cand_ids, k)
            for own, (at, score) in zip(query_ids, found, strict=True):
                ids.append(cand_ids[at])
                scores.append(np.asarray(score, np.int64))
                owners.append(np.full(len(at), own, np.int64))
        cat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (owners, ids, scores)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cat, strict=True)))
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: every query row (``is_query``
    over vec_id) against all rows but its own."""
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                           F.col("embedding").cast("array<double>").alias("embedding"))
            .filter(F.col("vec_id").isNotNull() & sound())
            .groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    rows = stored(rows.withColumn("dim", F.size("embedding")).withColumn("ask", is_query), "vectors")
    n, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("ask").cast("long")),
                                                      F.lit(0))).first()
    c_blocks = max(1, -(-n // CANDIDATE_BLOCK))
    q_blocks = max(1, -(-asked // QUERY_BLOCK))
    place = F.xxhash64("vec_id")
    cands = rows.select("dim", "vec_id", "embedding", F.lit(False).alias("is_query"),
                        F.pmod(place, F.lit(c_blocks)).alias("cb"),
                        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    queries = rows.filter("ask").select(
        "dim", "vec_id", "embedding", F.lit(True).alias("is_query"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))).alias("cb"),
        F.pmod(place, F.lit(q_blocks)).cast("int").alias("qb"))
    found = (cands.unionByName(queries).groupBy("dim", "cb", "qb")
             .applyInPandas(_search(k), "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
