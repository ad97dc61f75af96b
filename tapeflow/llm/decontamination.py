"""Benchmark decontamination (DataFrame functions only).

Benchmark items are cut into windows of ``WINDOW`` consecutive normalised
words; an item with fewer words is one window.  The distinct 64-bit hashes of
the windows are broadcast as a hash set; every window of every document is
hashed where it is read and looked up.  Hits are verified word by word against
the window table, so no hash decides alone.  Contaminated word spans can then
be removed from the texts, or the documents from the table.

Scale: texts and words are never shuffled by the scan; only hits (and one row
for each document) are.  The broadcast holds one long for each distinct window
and only up to ``BROADCAST_WINDOWS`` of them; beyond that the same join is a
sort-merge join on the hash, whose hot keys AQE splits.  Documents hit by the
same set of windows are one class, and item lists are made once for a class: a
passage that a third of the documents share costs one list.

Defined cases: a null or empty text, or one without words, has no words and is
never hit; neither are items without words.  A repeated row or doc_id is a
document of its own; a null doc_id is kept.  Items that repeat an id count once
for it; an item without an id hits words but is not listed.  An empty benchmark
hits nothing, an empty table gives no rows.  Other columns are not looked at
by ``scan`` and kept by ``decontaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import stored

WINDOW = 10
BROADCAST_WINDOWS = 4_000_000  # one long each
# Letters that are lower-cased, and what separates words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECES = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}]+"  # words and gaps
STARTS_WITH_WORD = r"^[0-9A-Za-z\x{80}-\x{10FFFF}]"


def words_of(text: Column) -> Column:
    """The normalised words of a text."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.filter(F.split(F.translate(whole, UPPER, LOWER), DELIMITERS), lambda w: w != "")


def _places(df: DataFrame, window: int, *keep: str) -> DataFrame:
    """One row for each word of ``w``: its position and the ``window`` words
    from it on (null past the end); a row without words has one empty place."""
    n = F.size("w")
    ahead = F.arrays_zip(F.col("w").alias("w0"), *(
        F.slice("w", F.lit(j + 1), F.greatest(n - j, F.lit(0))).alias(f"w{j}")
        for j in range(1, window)))
    return (df.select(*keep, n.cast("long").alias("n_words"), F.posexplode_outer(ahead))
            .select(*keep, "n_words", F.coalesce("pos", F.lit(0)).alias("pos"),
                    *(F.col(f"col.w{j}").alias(f"w{j}") for j in range(window))))


def windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (``wid``, hash ``wkey``, ``span`` in words, words
    ``t0`` …) and their owners (``wid``, ``item``), both stored."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"),
                             words_of(F.col("text")).alias("w"))
    places = _places(items, window, "item").filter(F.col("w0").isNotNull())
    span = F.least(F.col("n_words"), F.lit(window)).cast("int")
    mine = places.filter(F.col("pos") + span <= F.col("n_words")).select(
        "item", span.alias("span"), *(F.col(f"w{j}").alias(f"t{j}") for j in range(window)))
    words = [f"t{j}" for j in range(window)]
    # Numbered where they are written, so that the numbers are settled.
    table = stored(mine.select("span", *words).distinct()
                   .withColumn("wid", F.monotonically_increasing_id())
                   .withColumn("wkey", F.xxhash64("span", *words)), "windows")
    same = [F.col(f"o.{w}").eqNullSafe(F.col(f"d.{w}")) for w in words]
    on = F.col("o.span") == F.col("d.span")
    for s in same:
        on = on & s
    owners = stored(mine.alias("o").join(table.alias("d"), on)
                    .select(F.col("d.wid").alias("wid"), "item").distinct(), "window-owners")
    return table, owners


def hits(docs: DataFrame, table: DataFrame, *keep: str, window: int = WINDOW) -> DataFrame:
    """Verified places of windows: ``keep``, n_words, first, end (words), wid.
    A row whose first place is no hit keeps that place, without ``wid``."""
    found = table.agg(F.count(F.lit(1)), F.collect_set("span")).first()  # at most ``window`` spans
    spans = sorted(found[1]) or [window]
    at = _places(docs, window, *keep)

    def key(s: int) -> Column:
        rest = [F.lit(None).cast("string")] * (window - s)
        return F.when(F.col(f"w{s - 1}").isNotNull(),
                      F.xxhash64(F.lit(s), *(f"w{j}" for j in range(s)), *rest))
    words = [f"w{j}" for j in range(window)]
    if len(spans) == 1:
        at = at.withColumn("span", F.lit(spans[0])).withColumn("key", key(spans[0]))
    else:
        each = F.array(*(F.struct(F.lit(s).alias("span"), key(s).alias("key")) for s in spans))
        at = at.select("*", F.inline(each))
    known = table.select(F.col("wkey").alias("known")).distinct()
    known = F.broadcast(known) if found[0] <= BROADCAST_WINDOWS else known.hint("merge")
    first = (F.col("pos") == 0) & (F.col("span") == spans[0])
    likely = at.join(known, F.col("key") == F.col("known"), "left") \
        .filter(F.col("known").isNotNull() | first)
    on = (F.col("known") == F.col("wkey")) & (F.col("span") == F.col("tspan"))
    for j in range(window):
        on = on & (F.col(f"t{j}").isNull() | (F.col(f"w{j}") == F.col(f"t{j}")))
    checked = likely.join(table.withColumnRenamed("span", "tspan"), on, "left") \
        .filter(F.col("wid").isNotNull() | first)
    return checked.select(*keep, "n_words", F.col("pos").alias("first"),
                          (F.col("pos") + F.col("span")).alias("end"), "wid").drop(*words)


def _merged(spans: Column) -> Column:
    """Sorted, disjoint spans (first, end) from sorted ones."""
    empty = F.array().cast("array<struct<first:int,end:int>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["first"].alias("first"),
                          F.greatest(last["end"], x["end"]).alias("end"))
        touch = (F.size(acc) > 0) & (x["first"] <= F.try_element_at(acc, F.lit(-1))["end"])
        return F.when(touch, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))) \
            .otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(spans, empty, add)


def _gathered(found: DataFrame, *keep: str) -> DataFrame:
    """Per row: its hit places (no more than its words times the window
    lengths) and the windows that hit it."""
    place = F.when(F.col("wid").isNotNull(), F.struct(F.col("first").cast("int").alias("first"),
                                                      F.col("end").cast("int").alias("end")))
    return found.groupBy(*keep, "n_words").agg(
        F.array_sort(F.collect_set(place)).alias("places"),
        F.array_sort(F.collect_set("wid")).alias("wids"))


def _n_hit(places: Column) -> Column:
    """Words inside any of the sorted places."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))

    def add(acc: Column, x: Column) -> Column:
        new = F.greatest(x["end"] - F.greatest(x["first"], acc["to"]), F.lit(0))
        return F.struct((acc["n"] + new).alias("n"),
                        F.greatest(acc["to"], x["end"]).alias("to"))
    return F.aggregate(places, start, add, lambda acc: acc["n"])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (ids of the items
    hit, sorted as strings)."""
    table, owners = windows(benchmark, window)
    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"),
                       words_of(F.col("text")).alias("w"))
    found = _gathered(hits(rows, table, "row", "doc_id", window=window), "row", "doc_id")
    digest = F.sha2(F.array_join(F.col("wids").cast("array<string>"), ","), 256)
    done = stored(found.select("doc_id", "n_words", _n_hit(F.col("places")).alias("n_hit"),
                               F.when(F.size("wids") > 0, digest).alias("class"), "wids"),
                  "scanned")
    # One item list for each set of windows, not for each document.
    classes = done.filter(F.col("class").isNotNull()).groupBy("class").agg(
        F.any_value("wids").alias("wids"))
    listed = stored(classes.select("class", F.explode("wids").alias("wid"))
                    .join(owners.filter(F.col("item").isNotNull()), "wid")
                    .select("class", "item").distinct()
                    .groupBy("class").agg(F.array_sort(F.collect_list("item")).alias("items")),
                    "class-items")
    none = F.array().cast("array<string>")
    # Rows without a class stay out of the join, and both its sides are plain
    # reads, so that a class of many rows can be split.
    in_class = done.filter(F.col("class").isNotNull()).join(listed, "class", "left")
    clean = done.filter(F.col("class").isNull()).withColumn("items", none)
    return (in_class.unionByName(clean)
            .select("doc_id", "n_words", "n_hit",
                    F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
                    F.coalesce("items", none).alias("items")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans",
                   window: int = WINDOW) -> DataFrame:
    """``docs`` without its hit words (``remove="spans"``: each span is cut
    with the gap after it, at the text's end with the gap before it) or
    without the documents that are hit
    (``"documents"``).  Rows without a hit stay as they are."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be 'spans' or 'documents', not {remove!r}")
    table, _ = windows(benchmark, window)
    key = F.sha2(F.col("text").cast("string").cast("binary"), 256)
    # Places belong to a text; rows with equal texts share them.
    texts = docs.filter(F.col("text").isNotNull()).select(
        key.alias("__llm_key"), words_of(F.col("text")).alias("w"))
    found = _gathered(hits(texts, table, "__llm_key", window=window), "__llm_key") \
        .filter(F.size("wids") > 0) \
        .select(F.col("__llm_key"), F.col("places").alias("__llm_places"))
    keyed = docs.withColumn("__llm_text_key", key)
    same = F.col("__llm_text_key") == F.col("__llm_key")
    if remove == "documents":
        return keyed.join(found, same, "left_anti").select(*docs.columns)
    out = keyed.join(found, same, "left").withColumn("text", F.when(
        F.col("__llm_places").isNull(), F.col("text")).otherwise(
        _without(F.col("text").cast("string"), _merged(F.col("__llm_places")))))
    return out.select(*docs.columns)


def _without(text: Column, spans: Column) -> Column:
    """``text`` without the words of the disjoint ``spans``.  Words and gaps
    alternate, so word k is piece 2k, or 2k + 1 if a gap comes first."""
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    shift = F.when(text.rlike(STARTS_WITH_WORD), 0).otherwise(1)
    n = F.size(pieces)
    bounds = F.concat(F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("end"))),
                      F.transform(spans, lambda s: F.struct(
                          (s["first"] * 2 + shift).alias("first"),
                          F.least(s["end"] * 2 + shift, n).alias("end"))),
                      F.array(F.struct(n.alias("first"), n.alias("end"))))
    # What lies between the end of one bound and the start of the next.
    kept = F.transform(F.slice(bounds, 2, F.size(bounds)), lambda b, i: F.array_join(
        F.slice(pieces, F.element_at(bounds, i + 1)["end"] + 1,
                F.greatest(b["first"] - F.element_at(bounds, i + 1)["end"], F.lit(0))), ""))
    whole = F.array_join(kept, "")
    to_the_end = F.element_at(spans, -1)["end"] * 2 + shift >= n
    return F.when(to_the_end, F.regexp_replace(whole, r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+$", "")) \
        .otherwise(whole)
