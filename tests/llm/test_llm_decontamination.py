"""Benchmark decontamination against plain Python on small, awkward tables."""

from __future__ import annotations

import random
import re

import pytest

from tapeflow.llm import decontamination as D
from tapeflow.llm.common import ship_code

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RNG = random.Random(3)
PASSAGE = " ".join(RNG.choice(["alpha", "béta", "ÉTÉ", "x1", "gamma", "Δ"]) + str(k)
                   for k in range(25))
SHORT = "only five words in here"
ITEMS = [(1, PASSAGE), (2, PASSAGE.upper().replace(" ", "; ")), (10, SHORT), (9, "Word."),
         (3, None), (4, ""), (5, " .. "), (None, "an item without any id has these words"),
         (7, PASSAGE), (7, "a second text of item seven that is a little longer here")]


def filler(n):
    return " ".join(RNG.choice("the of and to in is it".split()) + RNG.choice("abcde")
                    for _ in range(n))


TEXTS = [None, "", " \n ", "word", "WORD word, wording", filler(8), PASSAGE, PASSAGE.upper(),
         filler(30) + "... " + PASSAGE.replace(" ", "\n-- ") + "!? " + filler(20),
         " ".join(PASSAGE.split()[3:13]), " ".join(PASSAGE.split()[3:12]),
         f"{SHORT} {filler(3)} {SHORT} {SHORT}", f"(({SHORT}))", "été0 " + PASSAGE.lower(),
         "AN ITEM without any id has these words " + PASSAGE + " " + PASSAGE,
         filler(8000) + " " + PASSAGE + " " + filler(8000), "a word a\x00word\x7fword é"]


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text, items):
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        v = words(t)
        n = min(len(v), 10)
        grams = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                if item is not None:
                    ids.add(str(item))
    return len(w), hit, sorted(ids)


def frames(spark, texts, items):
    ship_code(spark)
    rows = [(i, t, "clash", 1, 2) for i, t in enumerate(texts)]
    rows += [(None, PASSAGE, "a", 3, 4), rows[6], (6, "other text of the same id", "b", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, w string, first int, wid long")
    bench = spark.createDataFrame([(*i, "x") for i in items],
                                  "item_id long, text string, item string")
    return rows, docs, bench


@pytest.mark.parametrize("limit", [D.BROADCAST_WINDOWS, 0])
def test_scan_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", limit)  # 0: without a broadcast set
    rows, docs, bench = frames(spark, TEXTS, ITEMS)
    got = sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"]))
                           for r in D.scan(docs, bench).collect())))
    want = []
    for r in rows:
        n, hit, ids = brute(r[1], ITEMS)
        want.append(str((r[0], n, len(hit), len(ids), ids)))
    assert got == sorted(want)


def test_spans_go_and_the_rest_stays(spark):
    rows, docs, bench = frames(spark, TEXTS, ITEMS)
    out = D.decontaminated(docs, bench)
    assert out.columns == docs.columns
    got = sorted(str(tuple(r)) for r in out.collect())
    want = []
    for r in rows:
        _, hit, _ = brute(r[1], ITEMS)
        text = r[1]
        if hit:
            low = [m for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text)]
            keep = [m for k, m in enumerate(low) if k not in hit]
            gap = [text[m.end():(low[k + 1].start() if k + 1 < len(low) else len(text))]
                   for k, m in enumerate(low)]
            text = text[:low[0].start()] + "".join(
                m.group() + gap[k] for k, m in enumerate(low) if k not in hit)
            if len(low) - 1 in hit:
                text = re.sub("[^0-9A-Za-z\x80-\U0010ffff]+$", "", text)
            assert len(keep) == len(words(text))
        want.append(str((r[0], text, *r[2:])))
    assert got == sorted(want)
    # what is left has none of the passages, whole documents without a hit are untouched
    left = {r.doc_id: r.n_hit for r in D.scan(out.filter("doc_id <> 9"), bench).collect()}
    assert sum(left.values()) == 0


def test_documents_go(spark):
    rows, docs, bench = frames(spark, TEXTS, ITEMS)
    got = sorted(str(tuple(r)) for r in D.decontaminated(docs, bench, "documents").collect())
    assert got == sorted(str(r) for r in rows if not brute(r[1], ITEMS)[1])
    with pytest.raises(ValueError):
        D.decontaminated(docs, bench, "nothing")


def test_empty_tables(spark):
    _, docs, bench = frames(spark, TEXTS, ITEMS)
    assert D.scan(docs.limit(0), bench).count() == 0
    assert D.decontaminated(docs.limit(0), bench).count() == 0
    clean = D.scan(docs, bench.limit(0)).collect()
    assert len(clean) == docs.count() and all(r.n_hit == r.n_items == 0 for r in clean)
    assert D.decontaminated(docs, bench.limit(0)).count() == docs.count()


def test_no_python_in_the_plan(spark):
    _, docs, bench = frames(spark, TEXTS, ITEMS)
    for df in (D.scan(docs, bench), D.decontaminated(docs, bench)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
