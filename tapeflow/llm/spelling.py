"""Spelling variant grouping by reduced-alphabet generation.

Letters are hashed to ``SYMBOLS`` symbols.  Words one edit apart have reduced
words at most one edit apart, so the full one-edit neighbourhood of every
reduced word (itself, every deletion, replacement and insertion over the small
alphabet) is generated and joined to the reduced vocabulary; the original
words behind a match are compared exactly.  A neighbourhood over all letters
would be some ten times larger.

Neighbours are 64-bit polynomial hashes, each made in constant time from
prefix hashes, so a very long run of letters costs its length times the
symbols and no strings are built.  A hash collision only adds a comparison.

A word's form is its near word of largest count, if that is ``RATIO`` times
its own or more.  Counts grow by that factor along forms, so chains end and
are no longer than a logarithm of the largest count; roots are found by
pointer jumping in that many doublings.

Scale: the corpus is read once for counts, added up map-side; the rest works
on the vocabulary.  Frequent words are single rows of it.  A reduced word that
many words share is met by pairs of its words only through a join on its hash.

Defined cases: null and empty texts have no words.  Rows that repeat count
each time.  Ties of the largest count go to the word that is first in
code-point order.  An empty table gives no rows.  Other columns are not looked
at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import stored

# What a run of letters is, and the letters that are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
SYMBOLS = 8
BASE = 0x9E3779B97F4A7C15  # odd, of the polynomial hash
ROWS = 1 << 16             # of an Arrow batch of neighbours


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS,
               least_count: int = LEAST_COUNT,
               spelling: Callable[[Column], Column] | None = None) -> DataFrame:
    """word, n: the lower-cased runs of letters of at least ``least_letters``
    code points and ``least_count`` occurrences; stored.  ``spelling`` maps a
    run (it may use the columns of ``docs``) before it is counted."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    keep = [c for c in docs.columns if c in ("doc_id",)]
    runs = docs.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)))
                       .alias("run")).filter(F.length("run") >= least_letters)
    word = F.col("run") if spelling is None else spelling(F.col("run"))
    counted = runs.select(word.alias("word")).filter(F.length("word") >= least_letters) \
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return stored(counted.filter(F.col("n") >= least_count), "vocabulary")


def symbols_of(word: str, symbols: int) -> np.ndarray:
    """The reduced word, as numbers from 1 to ``symbols``."""
    letter = {c: 1 + zlib.crc32(c.encode("utf-8")) % symbols for c in set(word)}
    return np.fromiter((letter[c] for c in word), np.uint64, len(word))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    np.cumprod(np.full(n, BASE, np.uint64), out=out[1:])
    return out


def _prefixes(s: np.ndarray) -> np.ndarray:
    """pre[i]: hash of the first i symbols, the sum of symbol j × BASE^j."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(s * _powers(len(s))[:-1])])


def reduced_key(s: np.ndarray) -> int:
    return int(_mix(_prefixes(s)[-1:])[0])


def neighbourhood(s: np.ndarray, symbols: int) -> np.ndarray:
    """Hashes of all reduced words at most one edit away (distinct)."""
    n, p, pre = len(s), _powers(len(s) + 1), _prefixes(s)
    every = np.arange(1, symbols + 1, dtype=np.uint64)[:, None]
    # A symbol put in or out moves what follows it by one power of the base.
    back = np.uint64(pow(BASE, -1, 1 << 64))
    rest = pre[n] - pre
    replaced = pre[n] + (every - s[None, :]) * p[None, :n]
    deleted = pre[:n] + rest[1:] * back
    inserted = pre[None, :] + every * p[None, :n + 1] + (rest * np.uint64(BASE))[None, :]
    return np.unique(_mix(np.concatenate([pre[n:], replaced.ravel(), deleted, inserted.ravel()])))


def _keys(symbols: int):
    """Words with the key of their reduced word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [reduced_key(symbols_of(w, symbols)) for w in batch["word"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["word"], batch["n"], pa.array(key, pa.int64())], names=["word", "n", "key"])
    return run


def _neighbours(symbols: int):
    """Neighbour keys of each reduced word (one word stands for it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, near, held = [], [], 0
            for key, word in zip(batch["key"].to_pylist(), batch["word"].to_pylist(), strict=True):
                found = neighbourhood(symbols_of(word, symbols), symbols)
                keys.append(np.full(len(found), key))
                near.append(found)
                held += len(found)
                if held >= ROWS:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys)), pa.array(np.concatenate(near))],
                        names=["key", "near"])
                    keys, near, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(near))],
                    names=["key", "near"])
    return run


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, other, other_n: words exactly one edit apart, each pair once;
    stored."""
    keyed = stored(words.mapInArrow(_keys(symbols), "word string, n long, key long"), "reduced")
    reduced = keyed.groupBy("key").agg(F.min("word").alias("word"))
    known = keyed.select(F.col("key").alias("known")).distinct()
    # Neighbourhoods are mutual, so half of the pairs of keys is all of them.
    keys = (reduced.mapInArrow(_neighbours(symbols), "key long, near long")
            .filter(F.col("key") <= F.col("near"))
            .join(known, F.col("near") == F.col("known"), "left_semi"))
    one = keyed.select(F.col("key").alias("key_a"), F.col("word").alias("a"), F.col("n").alias("an"))
    two = keyed.select(F.col("key").alias("key_b"), F.col("word").alias("b"), F.col("n").alias("bn"))
    fit = F.abs(F.length("a") - F.length("b")) <= 1
    once = (F.col("key") != F.col("near")) | (F.col("a") < F.col("b"))
    pairs = (keys.join(one, F.col("key") == F.col("key_a"))
             .join(two, (F.col("near") == F.col("key_b")) & fit & once)
             .filter(F.levenshtein("a", "b", 1) == 1))
    return stored(pairs.select(F.col("a").alias("word"), F.col("an").alias("n"),
                               F.col("b").alias("other"), F.col("bn").alias("other_n")),
                  "near-words")


def variant_groups(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of a (stored)
    vocabulary ``word, n`` (see the module)."""
    pairs = near_pairs(words, symbols)
    both = pairs.unionByName(pairs.select(
        F.col("other").alias("word"), F.col("other_n").alias("n"),
        F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy(F.col("word").alias("w")).agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("top"))
    top_n = -F.col("top.less")
    enough = top_n >= F.col("n") * ratio
    formed = stored(words.join(best, F.col("word") == F.col("w"), "left").select(
        "word", F.when(enough, F.col("top.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, top_n).alias("form_n")), "forms")
    linked = formed.filter(F.col("form").isNotNull())
    roots = linked.select("word", F.col("form").alias("root"))
    # A chain from count n to the largest has at most log(largest / n) steps.
    low, high = formed.agg(F.min("n"), F.max("n")).first()
    steps, reach = 0, low or 1
    while reach * ratio <= (high or 0):
        reach, steps = reach * ratio, steps + 1
    for _ in range(max(0, steps - 1).bit_length()):  # each doubles the steps followed
        ahead = roots.select(F.col("word").alias("at"), F.col("root").alias("further"))
        roots = stored(roots.join(ahead, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("further", "root").alias("root")), "roots")
    out = formed.join(roots.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
                      "form_n")
