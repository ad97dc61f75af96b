"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tapeflow.llm import spelling as S
from tapeflow.llm.common import ship_code, stored

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(counts, ratio):
    words = sorted(counts)
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w in words:
        top = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = top if top is not None and counts[top] >= ratio * counts[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    letters = "abcdeéèÀßÿ"
    seeds = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(40)]
    words = list(seeds)
    for w in seeds:
        for _ in range(6):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:],
                                     w[:i] + rng.choice(letters) + w[i:]]))
    # a chain whose counts grow five times at each step, and ties
    chain = {"aaaaaaaa": 5, "aaaaaaab": 25, "aaaaaabb": 125, "aaaaabbb": 625, "aaaabbbb": 3125}
    texts = [f"{w} " * rng.choice([1, 4, 5, 6, 30, 200]) for w in words]
    texts += [f"{w} " * n for w, n in chain.items()]
    texts += ["Zzzzzzz, " * 5 + "Xzzzzzz; " * 25 + "Yzzzzzz. " * 25, "x" * 20_000 + " ",
              None, "", "123 ... 456", "short words only", "ÀÉÎõü-ÀÉÎõü×÷ÀÉÎõü " * 6]
    texts += ["x" * 20_000 + "1", ("x" * 19_999 + "y ") * 30, "x" * 20_000, "x" * 20_000,
              "x" * 20_000] + texts[:3]
    return [(i if i % 7 else None, t, "clash", 3) for i, t in enumerate(texts)]


@pytest.mark.parametrize("symbols", [2, S.SYMBOLS])
def test_variants_equal_brute_force(spark, rows, symbols):
    ship_code(spark)
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
                  .repartition(3), "variant-docs")
    counts = Counter(w for r in rows for w in re.findall("[A-Za-zÀ-ÿ]+",
                                                         (r[1] or "").translate(UPPER)))
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    vocabulary = S.vocabulary(docs)
    assert {r.word: r.n for r in vocabulary.collect()} == counts
    got = sorted(tuple(r) for r in S.variant_groups(vocabulary, symbols=symbols).collect())
    assert got == sorted(brute(counts, S.RATIO))


def test_neighbourhood_holds_every_one_edit_word():
    rng = random.Random(1)
    for n in (1, 2, 6, 11):
        s = np.array([rng.randint(1, 3) for _ in range(n)], np.uint64)
        want = {tuple(s)}
        for i in range(n + 1):
            for c in (1, 2, 3):
                want.add((*s[:i], c, *s[i:]))
                if i < n:
                    want |= {(*s[:i], c, *s[i + 1:]), (*s[:i], *s[i + 1:])}
        keys = {S.reduced_key(np.array(w, np.uint64)) for w in want}
        assert keys == set(S.neighbourhood(s, 3).tolist()) and len(keys) == len(want)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.variant_groups(S.vocabulary(empty)).count() == 0
