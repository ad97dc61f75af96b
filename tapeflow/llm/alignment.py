"""Cross-tokenizer alignment as an Arrow-native pipeline.

Two tokenizers cut the same bytes.  Per record batch the token lists are
flattened, parent indices say which document a token is of, and segmented
cumulative sums of token lengths give byte ends.  An Acero full outer join of
both sides' ends on the document-end key (document and byte offset as one
number), sorted by it, has one row for each pair of tokens that overlap: every
cut of either side ends exactly one such pair, whose tokens are the next ones
to end, filled in backwards.  Rows that both sides have are the ends of the
groups.  ``Table.group_by`` counts id pairs in the batch; Spark adds the
partial counts up over the corpus.

Scale: texts are read and tokenised once; what the second look needs (each
document's distinct id pairs and how often) is written to the shared scratch
folder.  Batches are worked off in parts of ``PART_BYTES`` of text.  The merged
pair table reaches tasks as a broadcast up to ``BROADCAST_PAIRS`` pairs, beyond
that it meets the documents' pairs in a shuffled join.

Defined cases: null and empty texts, and texts whose tokens of either side do
not spell the text's bytes (after one space), have no tokens: zeros.  A repeated
row or doc_id is a document of its own and counts each time; a null doc_id is
kept.  An empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import stored
from tapeflow.llm.packing import _byte_letters, tokenizer_path

BYTE_LEVEL = "byte_bpe_50k.json"       # A, given a space and the text
BYTE_LEVEL_RANKS = "byte_bpe_50k.tiktoken"  # the same vocabulary as ranks
PIECES = "piece_bpe_32k.model"         # B, adds the space itself
PART_BYTES = 1 << 20
BROADCAST_PAIRS = 4_000_000            # 16 bytes each
SHIFT = 32                             # pair = A id << 32 | B id
# Up to U+024F both libraries class every character alike (tested); such texts
# go to the faster one.
_LATIN = re.compile("[\x00-ɏ]*")
_SIDES: dict = {}                      # per Python worker

ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
           "groups_sha256 string, pairs array<long>, times array<int>")


class ByteLevel:
    """Side A: ids of a byte-level BPE and the bytes of each id."""

    def __init__(self, path: str, ranks_path: str | None):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings are plain text
        letters = {c: b for b, c in _byte_letters().items()}
        vocab = self.whole.get_vocab(with_added_tokens=True)
        table = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) \
                else token.encode("utf-8")
        self.bytes = pa.array(table, pa.binary())
        self.fast = None
        if ranks_path:
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("side-a", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        other = []
        for i, t in enumerate(texts):
            if self.fast is not None and _LATIN.fullmatch(t):
                out[i] = self.fast.encode_ordinary(" " + t)
            else:
                other.append(i)
        for i, e in zip(other, self.whole.encode_batch([" " + texts[i] for i in other],
                                                       add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


class SentencePieces:
    """Side B: ids of a sentencepiece model and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        table = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            table.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i)
                         else piece.replace("▁", " ").encode("utf-8"))
        self.bytes = pa.array(table, pa.binary())

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def sides(a: str = BYTE_LEVEL, b: str = PIECES, ranks: str | None = BYTE_LEVEL_RANKS):
    key = (a, b, ranks)
    if key not in _SIDES:
        _SIDES[key] = (ByteLevel(tokenizer_path(a), tokenizer_path(ranks) if ranks else None),
                       SentencePieces(tokenizer_path(b)))
    return _SIDES[key]


def _spell(ids: list[list[int]], table: pa.Array, want: list[bytes]) -> np.ndarray:
    """Which documents' tokens spell ``want``."""
    flat = pa.array(np.concatenate([np.asarray(x, np.int64) for x in ids] or [np.empty(0, int)]))
    token = table.take(flat)
    size = pc.binary_length(token).to_numpy(zero_copy_only=False).astype(np.int64)
    to = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, ids)])]
    data = token.buffers()[2].to_pybytes()[:to[-1]] if len(flat) else b""
    if data == b"".join(want):
        return np.diff(to) == np.fromiter(map(len, want), np.int64, len(want))
    return np.array([data[to[i]:to[i + 1]] == w for i, w in enumerate(want)], bool)


def _ends(lists: pa.ListArray, table: pa.Array, base: np.ndarray) -> pa.Table:
    """Every token's id with the key of its byte end: ``base`` of its document
    plus the cumulative sum of lengths inside the document."""
    ids, parent = lists.flatten(), pc.list_parent_indices(lists)
    size = pc.binary_length(table.take(ids)).cast(pa.int64())
    run = pc.cumulative_sum(size)
    first = np.asarray(lists.offsets)[:-1]           # of each document, none is empty
    before = pc.subtract(run.take(pa.array(first)), size.take(pa.array(first)))
    at = pc.add(pc.subtract(run, before.take(parent)), pa.array(base).take(parent))
    return pa.table({"end": at, "id": ids.cast(pa.int64())})


def _texts_of_groups(lists: pa.ListArray, last: np.ndarray) -> pa.Array:
    """Ids of each group, comma-joined; ``last`` marks groups' last tokens."""
    cut = np.concatenate([[0], np.flatnonzero(last) + 1]).astype(np.int32)
    names = lists.flatten().cast(pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cut), names), ",")


def _align(texts: list[str], side_a, side_b):
    """n_a, n_b, n_groups, n_links, digest and (pair, times) of each text."""
    n = len(texts)
    raw = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
    ids_a, ids_b = side_a.ids(texts), side_b.ids(texts)
    good = np.flatnonzero(_spell(ids_a, side_a.bytes, raw) & _spell(ids_b, side_b.bytes, raw))
    counts = np.zeros((4, n), np.int64)
    digests: list[str] = [""] * n
    none = (np.empty(0, np.int64), np.empty(0, np.int32))
    pairs = [none] * n
    if not len(good):
        return counts, digests, pairs
    # Document k's ends lie in (base k, base k+1]: one number is the key.
    length = np.array([len(raw[i]) for i in good], np.int64)
    base = np.cumsum(length) - length
    a = pa.array([ids_a[i] for i in good], pa.list_(pa.int32()))
    b = pa.array([ids_b[i] for i in good], pa.list_(pa.int32()))
    ends_a, ends_b = _ends(a, side_a.bytes, base), _ends(b, side_b.bytes, base)
    links = ends_a.rename_columns(["end", "a"]).join(
        ends_b.rename_columns(["end", "b"]), keys="end", join_type="full outer",
        use_threads=False).sort_by("end").combine_chunks()
    common = pc.and_(pc.is_valid(links["a"]), pc.is_valid(links["b"]))
    cut = links["end"].filter(common)
    links = pa.table({
        "doc": pa.array(np.searchsorted(base, links["end"].to_numpy(), "left") - 1),
        "pair": pc.bit_wise_or(pc.shift_left(pc.fill_null_backward(links["a"]), SHIFT),
                               pc.fill_null_backward(links["b"]))})
    owner = np.searchsorted(base, cut.to_numpy(), "left") - 1
    groups = np.bincount(owner, minlength=len(good))
    words = pc.binary_join_element_wise(
        _texts_of_groups(a, np.asarray(pc.is_in(ends_a["end"], cut).combine_chunks())),
        _texts_of_groups(b, np.asarray(pc.is_in(ends_b["end"], cut).combine_chunks())), "|")
    by_doc = pa.array(np.concatenate([[0], np.cumsum(groups)]).astype(np.int32))
    lines = pc.binary_join(pa.ListArray.from_arrays(by_doc, words), ";").to_pylist()
    counts[0, good], counts[1, good] = pc.list_value_length(a), pc.list_value_length(b)
    counts[2, good], counts[3, good] = groups, np.bincount(links["doc"], minlength=len(good))
    some = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]) \
        .sort_by([("doc", "ascending"), ("pair", "ascending")])
    to = np.searchsorted(some["doc"].to_numpy(), np.arange(len(good) + 1))
    pair, times = some["pair"].to_numpy(), some["count_all"].to_numpy().astype(np.int32)
    for k, i in enumerate(good):
        digests[i] = hashlib.sha256(lines[k].encode("ascii")).hexdigest()
        pairs[i] = pair[to[k]:to[k + 1]], times[to[k]:to[k + 1]]
    return counts, digests, pairs


def _parts(batch: pa.RecordBatch, part_bytes: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``part_bytes`` of text (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(size.astype(np.int64)) // part_bytes
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _lists(values: list[np.ndarray], type_: pa.DataType) -> pa.ListArray:
    to = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(to), pa.array(np.concatenate(
        [*values, np.empty(0, type_.to_pandas_dtype())]), type_))


def _aligned(a: str, b: str, ranks: str | None, part_bytes: int):
    names = [c.split()[0] for c in ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        side_a, side_b = sides(a, b, ranks)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in _parts(batch, part_bytes):
                texts = part["text"].to_pylist()
                use = [i for i, t in enumerate(texts) if t]
                counts = np.zeros((4, len(texts)), np.int64)
                digests = [""] * len(texts)
                pairs = [(np.empty(0, np.int64), np.empty(0, np.int32))] * len(texts)
                found = _align([texts[i] for i in use], side_a, side_b)
                counts[:, use] = found[0]
                for k, i in enumerate(use):
                    digests[i], pairs[i] = found[1][k], found[2][k]
                ids = np.arange(row, row + len(texts))
                row += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), part["doc_id"], *(pa.array(c) for c in counts),
                     pa.array(digests), _lists([p for p, _ in pairs], pa.int64()),
                     _lists([t for _, t in pairs], pa.int32())], names=names)
    return run


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's links for each id pair."""
    for batch in batches:
        t = pa.table({"pair": batch["pairs"].flatten(),
                      "n": batch["times"].flatten().cast(pa.int64())})
        yield from t.group_by("pair", use_threads=False).aggregate([("n", "sum")]) \
            .rename_columns(["pair", "n"]).to_batches()


def aligned(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES,
            ranks: str | None = BYTE_LEVEL_RANKS) -> DataFrame:
    """Per document (row): n_a, n_b, n_groups, n_links, groups_sha256, and its
    distinct id ``pairs`` with how many ``times`` they are linked; stored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_aligned(a, b, ranks, PART_BYTES), ALIGNED), "aligned")


def pair_counts(done: DataFrame) -> DataFrame:
    """Corpus-wide links: pair, a, b, n, and ``best`` (n is the highest of the
    pair's b); stored."""
    mask = (1 << SHIFT) - 1
    counts = stored(done.select("pairs", "times").mapInArrow(_partial_counts, "pair long, n long")
                    .groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit(mask))
    top = counts.groupBy(b.alias("top_b")).agg(F.max("n").alias("top"))
    return stored(counts.select("pair", F.shiftright("pair", SHIFT).alias("a"), b.alias("b"), "n")
                  .join(top, F.col("b") == F.col("top_b"))
                  .select("pair", "a", "b", "n", (F.col("n") == F.col("top")).alias("best")),
                  "pair-table")


def _looked_up(shared):
    """Sums over a document's links with the broadcast pair table (sorted)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            pairs, times = batch["pairs"], batch["times"]
            at = np.searchsorted(known, pairs.flatten().to_numpy())
            w = times.flatten().to_numpy().astype(np.int64)
            to = np.cumsum(pc.list_value_length(pairs).to_numpy())

            def total(x: np.ndarray) -> pa.Array:
                return pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[np.append(0, to)]))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], total(w * best[at]), total(w * n[at])],
                names=["row", "n_best", "count_sum"])
    return run


def document_scores(done: DataFrame, table: DataFrame) -> DataFrame:
    """row, n_best, count_sum of every document with links."""
    spark = done.sparkSession
    if table.count() <= BROADCAST_PAIRS:
        t = table.select("pair", "n", "best").toArrow().sort_by("pair")
        shared = spark.sparkContext.broadcast(
            (t["pair"].to_numpy(), t["n"].to_numpy(), t["best"].to_numpy().astype(np.int64)))
        return done.filter(F.size("pairs") > 0).select("row", "pairs", "times").mapInArrow(
            _looked_up(shared), "row long, n_best long, count_sum long")
    each = done.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("p"),
                                                    F.col("times").alias("times"))))
    return (each.join(table.select("pair", "n", "best"), F.col("p") == F.col("pair"))
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
                                .cast("long").alias("n_best"),
                                F.sum(F.col("times") * F.col("n")).alias("count_sum")))


def alignment_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    done = aligned(docs)
    scores = document_scores(done, pair_counts(done)).withColumnRenamed("row", "scored")
    out = done.drop("pairs", "times").join(scores, F.col("row") == F.col("scored"), "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links",
                      *(F.coalesce(c, F.lit(0)).cast("long").alias(c)
                        for c in ("n_best", "count_sum")), "groups_sha256")
