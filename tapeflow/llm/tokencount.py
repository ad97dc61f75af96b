"""Exact length histogram of a tokenised corpus and what it answers.

Documents are aggregated by encoded length (map-side partial counts, so only
distinct lengths move).  Suffix sums over the histogram then answer, for every
context limit, the documents above it, the tokens a truncation would keep and
lose, and every quantile, without another look at the texts.

Suffix sums are two-level: lengths are cut into bands of ``BAND``, band totals
are added up over bands, lengths inside a band, so no task needs more than
``BAND`` lengths or the list of bands.

Defined cases: null and empty texts have length 0.  Repeated rows count each.
An empty table has an empty histogram.  Lengths are of whole texts, without
special tokens (their strings are ordinary text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.llm.common import stored
from tapeflow.llm.packing import tokenizer_path

TOKENIZER = "byte_bpe_50k.tiktoken"
BAND = 64
_ENCODINGS: dict = {}  # per Python worker


def encoding(name: str):
    import base64

    import public_tokenizers
    import tiktoken
    path = tokenizer_path(name)
    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                                             mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def _lengths(tokenizer: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for pdf in batches:
            n = np.fromiter((len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]),
                            np.int64, len(pdf))
            length, docs = np.unique(n, return_counts=True)
            yield pd.DataFrame({"length": length, "docs": docs})
    return run


def length_histogram(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """length, docs: how many documents encode to each length; stored, so that
    texts are encoded once."""
    counted = docs.select(F.col("text").cast("string").alias("text")) \
        .mapInPandas(_lengths(tokenizer), "length long, docs long")
    return stored(counted.groupBy("length").agg(F.sum("docs").alias("docs")), "lengths")


def suffix_sums(histogram: DataFrame, band: int = BAND) -> DataFrame:
    """For every occurring length L: documents and tokens at L, documents and
    tokens in documents longer than L, and for the context limit L the tokens
    kept and lost by truncation and the share of documents that fit whole
    (``quantile``: L is the smallest length that covers it)."""
    h = histogram.withColumn("__llm_band", F.floor(F.col("length") / band)) \
        .withColumn("__llm_tokens", F.col("length") * F.col("docs"))
    bands = h.groupBy("__llm_band").agg(F.sum("docs").alias("__llm_d"),
                                        F.sum("__llm_tokens").alias("__llm_t"))
    after = Window.orderBy(F.col("__llm_band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("__llm_band").desc()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    bands = bands.select("__llm_band",
                         F.coalesce(F.sum("__llm_d").over(after), F.lit(0)).alias("__llm_d1"),
                         F.coalesce(F.sum("__llm_t").over(after), F.lit(0)).alias("__llm_t1"),
                         F.sum("__llm_d").over(whole).alias("__llm_all_d"),
                         F.sum("__llm_t").over(whole).alias("__llm_all_t"))
    inside = Window.partitionBy("__llm_band").orderBy(F.col("length").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    longer_docs = F.coalesce(F.sum("docs").over(inside), F.lit(0)) + F.col("__llm_d1")
    longer_tokens = F.coalesce(F.sum("__llm_tokens").over(inside), F.lit(0)) + F.col("__llm_t1")
    s = h.join(bands, "__llm_band").withColumn("docs_longer", longer_docs) \
        .withColumn("tokens_longer", longer_tokens)
    lost = F.col("tokens_longer") - F.col("length") * F.col("docs_longer")
    return s.select(
        "length", "docs", F.col("__llm_tokens").alias("tokens"), "docs_longer", "tokens_longer",
        (F.col("__llm_all_t") - lost).alias("tokens_kept"), lost.alias("tokens_lost"),
        F.col("__llm_all_d").alias("total_docs"), F.col("__llm_all_t").alias("total_tokens"),
        ((F.col("__llm_all_d") - F.col("docs_longer")) / F.col("__llm_all_d")).alias("quantile"))


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """Totals at any context limit, also one that no document has: the largest
    occurring length at or below ``limit`` knows the documents above it."""
    fits = F.col("length") <= limit
    top = sums.agg(
        F.max_by(F.when(fits, F.struct("docs_longer", "tokens_longer")),
                 F.when(fits, F.col("length"))).alias("t"),
        F.max("total_docs").alias("total_docs"), F.max("total_tokens").alias("total_tokens"))
    longer = F.coalesce(F.col("t.docs_longer"), F.col("total_docs"))
    tokens = F.coalesce(F.col("t.tokens_longer"), F.col("total_tokens"))
    return top.select(
        F.lit(limit).cast("long").alias("context_limit"), longer.alias("docs_longer"),
        (F.col("total_tokens") - tokens + longer * limit).alias("tokens_kept"), "total_docs",
        "total_tokens")
