"""Best-fit packing of tokenised documents into fixed-length sequences.

Method: bounded-space online best-fit.  A task keeps a fixed number of open
bins.  Their free spaces are the bits of one integer, so the tightest bin that
still takes an item is the lowest set bit at or above the item's length.  When
a new bin is needed and all are open, the fullest closes first.  A small
look-ahead window feeds items longest first.

Scale: packing is a map over the scan's partitions, no text is shuffled.  Each
task ends with at most ``open_bins`` part-full bins; those bins (not their
documents) are packed once more as items of their own in a second, far smaller
pass, and the few pieces inside them take the new place by a join on the bin.

Defined cases: a null or empty text is the empty document (its ids are just
the closing id 0, length 1).  Repeated rows are packed once each.  A null
doc_id is kept as null.  An empty table gives no rows.  Only documents longer
than ``capacity`` are cut.  Other input columns are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import stored

CAPACITY = 2048
END_ID = 0
OPEN_BINS = 256
LOOK_AHEAD = 2048
TOKENIZER = "word_bpe_49k.json"
BINS_PER_REPACK_TASK = 50_000
CACHE_BYTES = 32 * 1024 * 1024  # of remembered chunks and parts, in a Python worker
PART_CHARS = 4 * 1024 * 1024    # of texts encoded at a time
PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
          "sequence_id long, offset long, closed boolean")
NAMES = [c.split()[0] for c in PIECES.split(", ")]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine (a path is taken as it is)."""
    import os

    import public_tokenizers
    return name if os.path.isabs(name) else public_tokenizers.path(name)


class BestFit:
    """Bounded-space best-fit bins.  ``place`` gives the bin number and offset."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: dict[int, list[int]] = {}  # free space → open bins
        self.mask = 0                            # bit f: some open bin has f free
        self.n_open = 0
        self.made = 0
        self.closed: list[int] = []              # bins closed since last asked

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            del self.by_free[free]
            self.mask ^= 1 << free
        self.n_open -= 1
        return b

    def _open(self, b: int, free: int) -> None:
        if free == 0:
            self.closed.append(b)
            return
        if self.n_open >= self.open_bins:        # the fullest closes first
            self.closed.append(self._take((self.mask & -self.mask).bit_length() - 1))
        self.by_free.setdefault(free, []).append(b)
        self.mask |= 1 << free
        self.n_open += 1

    def place(self, length: int) -> tuple[int, int]:
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            free, b = self.capacity, self.made
            self.made += 1
        self._open(b, free - length)
        return b, self.capacity - free


_CHUNKS: dict[str, "ChunkIds"] = {}  # per Python worker: tokenizer path → ids of chunks


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}


# Up to U+017F no character composes with another, so NFC changes nothing, and
# lower case goes character by character.
_LETTERS = "".join(chr(c) for c in range(0xA1, 0x180) if unicodedata.category(chr(c))[0] == "L")
_NUMBERS = "".join(chr(c) for c in range(0xA1, 0x180) if unicodedata.category(chr(c))[0] == "N")
_BEYOND = re.compile("[^\x00-\u017f]")
_SIMPLE = "^[!-~\u00a1-\u017f]+$"
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9{_NUMBERS}]"
                   f"|[^a-z{_LETTERS}0-9{_NUMBERS}\n]+")
_SPACED = {b: c for b, c in _byte_letters().items() if b not in b" \n"}


class Remembered:
    """Strings and their ids (little-endian uint32 bytes) as two Arrow columns of
    at most about ``limit`` bytes, without a Python object for each.  When they
    are full, half of that stays: what was used last."""

    def __init__(self, limit: int):
        self.limit, self.rounds = limit, 0
        self.keys, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.used = np.zeros(0, np.int64)

    def of(self, keys: pa.Array, learn: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """The ids of distinct ``keys``; ``learn`` gives those of new ones."""
        self.rounds += 1
        at = pc.index_in(keys, value_set=self.keys)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy()
        self.used[at[~missing]] = self.rounds
        new = keys.filter(pa.array(missing))
        at = np.where(missing, len(self.keys) + np.cumsum(missing) - 1, at)
        if len(new):
            self.ids = pa.concat_arrays([self.ids, learn(new)])
            self.keys = pa.concat_arrays([self.keys, new])
            self.used = np.append(self.used, np.full(len(new), self.rounds))
        found = self.ids.take(pa.array(at))
        if self.held > self.limit:
            self._forget()
        return found

    @property
    def held(self) -> int:
        return self.keys.nbytes + self.ids.nbytes + self.used.nbytes

    def _forget(self) -> None:
        size = 24 + pc.binary_length(self.keys).to_numpy() + pc.binary_length(self.ids).to_numpy()
        order = np.lexsort((size, -self.used))  # of those used last, short ones first
        stay = np.sort(order[:np.searchsorted(np.cumsum(size[order]), self.limit // 2)])
        self.keys, self.ids = self.keys.take(pa.array(stay)), self.ids.take(pa.array(stay))
        self.used = self.used[stay]


def _joined(lists: pa.ListArray, ids_of: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """For each list of strings their ids in a row; ``ids_of`` is asked for
    distinct strings."""
    coded = lists.flatten().dictionary_encode()
    ids = ids_of(coded.dictionary).take(coded.indices)
    _, offsets, data = ids.buffers()
    ends = np.frombuffer(offsets, np.int64, len(ids) + 1)[lists.offsets.to_numpy()]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists),
                                            [None, pa.py_buffer(ends), data])


class ChunkIds:
    """Texts → their ids as little-endian uint32 bytes.

    This tokenizer drops white space and its pattern never crosses it, so a
    text's ids are those of its white-space-free chunks in a row.  Chunks
    repeat far more often than texts, and the parts that the tokenizer's
    pattern cuts them into more often still: each is looked up once for some
    megabytes of text, and remembered.  Chunks of Latin letters are cut by that
    pattern here and new parts go to the BPE model many at a time, to be told
    apart by the mark that ends each part's last token.  Anything else goes
    through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.known_parts = Remembered(limit // 2), Remembered(limit // 2)
        self.parts = Tokenizer(self.tokenizer.model)
        self.parts.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Of each text; some megabytes of texts are in hand at a time."""
        part, size = [], 0
        for text in texts:
            # Lower case first makes more chunks equal; a text that may hold a
            # special token (in exactly its case) or decomposed letters stays.
            if text and "<|" not in text and not _BEYOND.search(text):
                text = text.lower()
            part.append(text or "")
            size += len(part[-1])
            if size > PART_CHARS:
                yield from self._encoded(part)
                part, size = [], 0
        if part:
            yield from self._encoded(part)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        chunks = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        return _joined(chunks, lambda c: self.known.of(c, self._learn)).to_pylist()

    def _learn(self, chunks: pa.Array) -> pa.Array:
        simple = pc.and_not(pc.match_substring_regex(chunks, _SIMPLE),
                            pc.match_substring(chunks, "<|"))
        odd = chunks.filter(pc.invert(simple)).to_pylist()
        ids = pa.array([np.array(e.ids, "<u4").tobytes() for e in
                        self.tokenizer.encode_batch(odd, add_special_tokens=False)],
                       pa.large_binary())
        plain = chunks.filter(simple).to_pylist()
        if plain:
            lines = _PART.sub(r"\g<0> ", "\n".join(plain).lower()).split("\n")
            parts = pc.ascii_split_whitespace(pa.array(lines, pa.large_string()))
            ids = pa.concat_arrays([
                _joined(parts, lambda p: self.known_parts.of(p, self._learn_parts)), ids])
        place = np.empty(len(chunks), np.int64)
        mask = simple.to_numpy(zero_copy_only=False)
        place[mask], place[~mask] = np.arange(len(plain)), len(plain) + np.arange(len(odd))
        return ids.take(pa.array(place))

    def _learn_parts(self, parts: pa.Array) -> pa.Array:
        parts, out = parts.to_pylist(), []
        for i in range(0, len(parts), 20_000):
            some = parts[i:i + 20_000]
            letters = " ".join(some).encode("utf-8").decode("latin-1").translate(_SPACED)
            ids = np.array(self.parts.encode(letters, add_special_tokens=False).ids, "<u4")
            # The empty part behind a chunk's last one has no ids.
            filled = np.array([p != "" for p in some])
            last = np.zeros(len(some) + 1, np.int64)
            last[1:][filled] = np.flatnonzero(self.ends[ids]) + 1
            last = np.maximum.accumulate(last)
            out.append(pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(some),
                [None, pa.py_buffer(4 * last), pa.py_buffer(ids.tobytes())]))
        return pa.concat_arrays(out)


def chunk_ids(name: str) -> ChunkIds:
    path = tokenizer_path(name)
    if path not in _CHUNKS:
        _CHUNKS[path] = ChunkIds(path)
    return _CHUNKS[path]


def _pieces(doc_ids, texts, cache: ChunkIds, capacity: int):
    end = END_ID.to_bytes(4, "little")
    for doc, ids in zip(doc_ids, cache.ids(texts), strict=True):
        ids += end
        for k, at in enumerate(range(0, len(ids), 4 * capacity)):
            cut = ids[at:at + 4 * capacity]
            yield doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)


def _pack_partition(tokenizer: str, capacity: int, open_bins: int, look_ahead: int):
    schema = pa.schema([(n, pa.int32() if n == "piece" else pa.bool_() if n == "closed"
                         else pa.int64()) for n in NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 40
        cache, fit = chunk_ids(tokenizer), BestFit(capacity, open_bins)
        held: dict[int, list[tuple]] = {}        # pieces of open bins

        def rows(bins, closed):
            out = [(*p[:5], first + b, p[5], closed) for b in bins for p in held.pop(b)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)],
                schema=schema)

        for batch in batches:
            for i in range(0, batch.num_rows, look_ahead):
                part = batch.slice(i, look_ahead)
                window = list(_pieces(part["doc_id"].to_pylist(), part["text"].to_pylist(),
                                      cache, capacity))
                window.sort(key=lambda p: -p[3])
                for p in window:
                    b, offset = fit.place(p[3])
                    held.setdefault(b, []).append((*p, offset))
                done, fit.closed = fit.closed, []
                if done:
                    yield rows(done, True)
        if held:
            yield rows(list(held), False)
        pa.default_memory_pool().release_unused()
    return run


def _repack_partition(capacity: int, open_bins: int):
    """Bins (bin, fill) as items: bin → new sequence and its base offset."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        first = (1 << 62) | (TaskContext.get().partitionId() << 40)
        fit = BestFit(capacity, open_bins)
        for pdf in batches:
            pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True])
            placed = [fit.place(int(x)) for x in pdf["fill"]]
            yield pd.DataFrame({"bin": pdf["bin"].to_numpy(),
                                "new_sequence": [first + b for b, _ in placed],
                                "base": [o for _, o in placed]})
    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER,
         open_bins: int = OPEN_BINS, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """Every document's pieces with their sequence and place (see the module).

    doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    first = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                   .mapInArrow(_pack_partition(tokenizer, capacity, open_bins, look_ahead), PIECES),
                   "pieces")
    open_ = (first.filter(~F.col("closed")).groupBy(F.col("sequence_id").alias("bin"))
             .agg(F.sum("length").alias("fill")))
    open_ = stored(open_, "open-bins")
    tasks = max(1, -(-open_.count() // BINS_PER_REPACK_TASK))
    # The placement is written once: a retried task then reads the same places.
    moved = stored(open_.repartition(tasks).mapInPandas(
        _repack_partition(capacity, open_bins), "bin long, new_sequence long, base long"),
        "repacked-bins")
    names = NAMES[:-3]
    settled = first.filter("closed").select(*NAMES[:-1])
    joined = (first.filter(~F.col("closed"))
              .join(moved, F.col("sequence_id") == F.col("bin"))
              .select(*names, F.col("new_sequence").alias("sequence_id"),
                      (F.col("offset") + F.col("base")).alias("offset")))
    return settled.unionByName(joined)
