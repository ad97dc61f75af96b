"""The pipeline's stages, one by one, against brute force."""

from __future__ import annotations

import re

import corpus_pipeline as P
from tapeflow.llm import minhash
from tapeflow.llm.common import stored
from tests.conftest import SF_SMALL


def test_stages_keep_clean_documents_and_act(spark):
    raw = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs, seen = raw, {}
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), name.replace(" ", "-"))
        seen[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == raw.columns
    quality, dedup, secret, mix, pack = seen.values()
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()
           if r["quality"] == 0}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()
            if r["quality"] == 1}
    kept = {r["doc_id"] for r in quality.collect()}
    assert len(good & kept) > 0.95 * len(good) and len(bad & kept) < 0.4 * len(bad)
    found = minhash.near_duplicates(quality).collect()
    assert sorted(r["doc_id"] for r in dedup.collect()) == sorted(
        r["doc_id"] for r in found if r["kept"])
    before = {r["doc_id"]: r["text"] for r in dedup.collect()}
    after = {r["doc_id"]: r for r in secret.collect()}
    assert set(after) == set(before)
    for doc, text in before.items():
        new = after[doc]["text"]
        if re.search(r"[0-9a-f]{32}|AKIA[A-Z0-9]{12}", text):
            assert "[SECRET]" in new and not re.search(r"[0-9a-f]{32}|AKIA[A-Z0-9]{12}", new)
            assert after[doc]["n_chars"] == len(new)
        elif "[SECRET]" not in new:
            assert new == text
    assert sorted(tuple(r) for r in mix.collect()) == sorted(tuple(r) for r in secret.collect())
    assert {r["doc_id"] for r in pack.collect()} == set(after)


def test_pipeline_of_an_empty_table(spark):
    raw = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    docs = stored(raw, "none")
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), name.replace(" ", "-"))
    assert docs.count() == 0


def test_near_dedup_keeps_one_of_repeated_rows_and_all_without_id(spark):
    a = "one two three four five six seven eight nine ten"
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, a, "en", "s", 1),
            (None, "x", "en", None, 1), (None, "x", "en", None, 1), (3, None, None, None, None)]
    docs = stored(spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"), "rows")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0)
                 for r in P.near_dedup(spark, docs, SF_SMALL).collect())
    assert got == [(False, 1), (False, 3), (True, 0), (True, 0)]


def test_near_dedup_keeps_the_texts_of_a_repeated_id(spark):
    """(5, X) copies document 3; (5, Y) shares its id with a text of its own."""
    x = "one two three four five six seven eight nine ten"
    y = "a text that no other document has and that must not be lost"
    rows = [(3, x, "en", "s", 1), (5, x, "en", "s", 1), (5, y, "de", "t", 2), (5, y, "de", "t", 2),
            (5, None, "de", "t", 0), (5, "", "de", "t", 0)]
    docs = stored(spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"), "same-ids")
    got = {(r["doc_id"], r["text"]) for r in P.near_dedup(spark, docs, SF_SMALL).collect()}
    assert got == {(3, x), (5, y), (5, None), (5, "")}
    assert P.near_dedup(spark, docs, SF_SMALL).count() == 4


def test_stages_take_other_columns_nulls_and_long_texts(spark):
    """Extra and clashing columns come through, null and very long texts stay,
    and a secret beside a null goes."""
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"
    prose = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id")
    base = [tuple(r) for r in prose.limit(30).collect()]
    rows = [(*r, 1, "x", 2) for r in base]
    rows += [(900, None, None, None, None, None, None, None),
             (901, f"the key is {key} here", "en", None, 5, 1, "y", 2),
             (902, " ".join(r[1] for r in base) * 3, "en", "web", 7, 1, "z", 2)]
    docs = stored(spark.createDataFrame(
        rows, prose.schema.simpleString()[7:-1] + ", rank int, key string, slot int"), "odd")
    for name, stage in P.STAGES[1:-1]:
        out = stored(stage(spark, docs, SF_SMALL), "odd-" + name.replace(" ", "-"))
        assert out.columns == docs.columns
        got = {r["doc_id"]: r for r in out.collect()}
        assert {900, 901, 902} <= set(got), name
        assert got[900]["text"] is None and got[902]["key"] == "z"
        if name == "secret scans":
            assert key not in got[901]["text"] and "[SECRET]" in got[901]["text"]
    packed = P.STAGES[-1][1](spark, docs, SF_SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == \
        {r[0] for r in rows}
