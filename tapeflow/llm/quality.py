"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms of a document are its character pairs over a small alphabet of classes
(letters, one class each for capitals, digits, spaces, line ends, sentence
marks, other symbols and non-ASCII) and four structure terms (bands of length,
of distinct words, of repeated words and of repeated lines).  Term weights are
log counts, scaled to unit length, times the inverse document frequency over
*all* documents.  The latent axes are the leading singular directions of the
labelled sample.

The sample is bounded by ``sample_rows`` (labelled rows with the smallest hash
of their id), so its vectors have a known size and can be broadcast.  Every
document is then compared with every sample vector by exact cosine products,
``ROWS`` documents at a time, and its ``k`` nearest neighbours vote with
their label, weighted by similarity to a power.

Labels are learned from rows whose crc32(doc_id) mod 4 is not 2; the rest is
held out.  doc_id, lang and source never enter a score.

Defined cases: null and empty texts have no character pairs and get the
structure bands of an empty text; they are scored like any other.  A null
doc_id is scored and counts as not held out.  Labels that are null are not
used; a doc_id with several labels counts by their mean.  Without any usable
label every score is ``PRIOR``.  Repeated rows are scored alike.  Documents
with equal neighbours' similarities take the first in sample order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 8192
AXES = 64
NEIGHBOURS = 7
POWER = 16.0
KEEP_SCORE = 0.7
PRIOR = 0.5
ROWS = 512


def _classes() -> np.ndarray:
    out = np.full(256, 33, np.int64)
    out[128:] = 32
    for chars, c in ((".,;:'\"()-", 31), ("\n\r\t\x0b\x0c", 30), (" ", 29), ("0123456789", 28),
                     ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 27)):
        out[[ord(x) for x in chars]] = c
    out[ord("a"):ord("z") + 1] = np.arange(1, 27)
    return out


CLASS_OF = _classes()
N_CLASSES = 34
PAIRS = N_CLASSES * N_CLASSES
BANDS = 16
TERMS = PAIRS + 4 * BANDS
STRUCTURE_WEIGHT = 0.5


def terms(text: str | None) -> np.ndarray:
    """Log counts of character-class pairs (unit length) and structure bands."""
    raw = text.encode("utf-8") if text else b""
    out = np.zeros(TERMS, np.float32)
    if len(raw) > 1:
        c = CLASS_OF[np.frombuffer(raw, np.uint8)]
        logs = np.log1p(np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=PAIRS))
        out[:PAIRS] = logs / np.linalg.norm(logs)
    words = raw.lower().split()
    lines = raw.split(b"\n")
    n = len(words)
    distinct = len(set(words)) / n if n else 0.0
    again = sum(map(bytes.__eq__, words, words[1:])) / (n - 1) if n > 1 else 0.0
    copies = 1 - len(set(lines)) / len(lines)
    top = BANDS - 1
    for k, x in enumerate((min(top, int(np.log2(n + 1))), int(top * distinct), int(top * again),
                           int(top * copies))):
        out[PAIRS + k * BANDS + x] = 1.0
    return out


def _matrix(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.stack([terms(t) for t in batch["text"].slice(at, ROWS).to_pylist()])


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(PAIRS + 1, np.int64), 0
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            x = _matrix(batch, i)
            df[:PAIRS] += np.count_nonzero(x[:, :PAIRS], axis=0)
            n += len(x)
    df[PAIRS] = n  # the last row counts documents
    yield pa.RecordBatch.from_pydict({"term": pa.array(np.arange(PAIRS + 1), pa.int32()),
                                      "df": pa.array(df, pa.int64())})


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            x = _matrix(batch, i)
            yield pa.RecordBatch.from_pydict({
                "__llm_id": batch["__llm_id"].slice(i, ROWS),
                "__llm_label": batch["__llm_label"].slice(i, ROWS),
                "terms": pa.array([r.tobytes() for r in x], pa.binary())})


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label must not be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Latent axes and the labelled sample in them; a few MB by construction."""

    def __init__(self, scale: np.ndarray, sample: np.ndarray, labels: np.ndarray,
                 axes: int = AXES, k: int = NEIGHBOURS, power: float = POWER):
        self.scale, self.k, self.power = scale.astype(np.float32), k, power
        self.labels = labels.astype(np.float64)
        z = sample * self.scale
        if len(z):
            _, v = np.linalg.eigh((z.T @ z).astype(np.float64))
            self.axes = np.ascontiguousarray(v[:, ::-1][:, :axes], dtype=np.float32)
            self.sample = self.latent(sample)

    def latent(self, x: np.ndarray) -> np.ndarray:
        p = (x * self.scale) @ self.axes
        return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), PRIOR)
        cos = self.latent(x) @ self.sample.T
        k = min(self.k, cos.shape[1])
        near = np.argpartition(cos, cos.shape[1] - k, axis=1)[:, -k:]
        w = np.take_along_axis(cos, near, 1).astype(np.float64).clip(0) ** self.power
        total = w.sum(1)
        votes = (w * self.labels[near]).sum(1)
        prior = self.labels.mean()
        return np.where(total > 0, votes / np.where(total > 0, total, 1), prior).clip(0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Document frequencies over all of ``docs``; axes and voters from at most
    ``sample_rows`` labelled rows outside the held-out quarter."""
    usable = (labels.select(F.col("doc_id").cast("long").alias("__llm_id"),
                            F.col("quality").cast("double").alias("__llm_q"))
              .filter(F.col("__llm_q").isNotNull() & F.col("__llm_id").isNotNull()
                      & ~held_out("__llm_id")))
    chosen = (usable.groupBy("__llm_id").agg(F.avg("__llm_q").alias("__llm_label"))
              .orderBy(F.xxhash64("__llm_id"), "__llm_id").limit(sample_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("__llm_doc"),
                        F.col("text").cast("string").alias("text"))
    # At most sample_rows ids and labels: a bounded broadcast.
    labelled = texts.join(F.broadcast(chosen), F.col("__llm_doc") == F.col("__llm_id")) \
        .select("__llm_id", "__llm_label", "text")
    rows = labelled.mapInArrow(_sample_terms, "__llm_id long, __llm_label double, terms binary") \
        .dropDuplicates(["__llm_id"]).collect()  # at most sample_rows rows
    rows.sort(key=lambda r: r[0])
    sample = (np.stack([np.frombuffer(r[2], np.float32) for r in rows]) if rows
              else np.empty((0, TERMS), np.float32))
    df = np.zeros(PAIRS + 1)
    for r in texts.select("text").mapInArrow(_document_frequencies, "term int, df long") \
            .groupBy("term").agg(F.sum("df")).collect():  # one row per term
        df[r[0]] = r[1]
    idf = np.log((1 + df[PAIRS]) / (1 + df[:PAIRS])) + 0.1
    scale = np.concatenate([idf, np.full(TERMS - PAIRS, STRUCTURE_WEIGHT * idf.mean())])
    return Model(scale, sample, np.array([r[1] for r in rows]))


def scores(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of every row (default doc_id) and its ``__llm_score``."""
    columns = ["doc_id"] if columns is None else columns
    kept = docs.select(*columns, F.col("text").cast("string").alias("__llm_text"))
    schema = kept.drop("__llm_text").withColumn("__llm_score", F.lit(0.0)).schema
    bundle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bundle.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                x = np.stack([terms(t) for t in part["__llm_text"].to_pylist()])
                out = [part[c] for c in columns] + [pa.array(m.score(x), pa.float64())]
                yield pa.RecordBatch.from_arrays(out, names=[*columns, "__llm_score"])
    return kept.mapInArrow(run, schema)
