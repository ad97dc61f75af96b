"""Vector operators against brute force on small, awkward tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeflow.llm import embedding_dedup, topk
from tapeflow.llm.common import ship_code, stored
from tapeflow.llm.components import connected_components

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int, rank int, node int"


def vectors():
    rng = np.random.default_rng(4)
    rows = []

    def add(v, label):
        rows.append((len(rows), None if v is None else [None if x is None else float(x) for x in v],
                     label, 1, 1, 1))
    for label in (1, 2):
        for _ in range(40):
            add(rng.standard_normal(16), label)
    center = rng.standard_normal(16)
    for _ in range(60):
        add(center + 0.06 * rng.standard_normal(16), 1)  # about the threshold
    for _ in range(10):
        add(center, 1)          # copies
        add(2 * center, 2)      # same direction, other label
    for odd in (None, [], [None] * 16, [0.0] * 16, [float("nan")] + [1.0] * 15,
                [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]):
        add(odd, 1)
    add(center, None)
    rows.append((None, [float(x) for x in center], 1, 1, 1, 1))
    rows.append(rows[3])        # a repeated row
    return rows


@pytest.fixture(scope="module")
def table(spark):
    ship_code(spark)
    return stored(spark.createDataFrame(vectors(), SCHEMA).repartition(3), "test-vectors")


def sound(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)


def test_embedding_links_against_brute_force(table, monkeypatch):
    rows = vectors()
    f32 = [None if not sound(r[1]) or not any(r[1]) else np.float32(r[1]).astype(float)
           for r in rows]
    links, part = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while part[x] != x:
            x = part[x]
        return x
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if (i == j or f32[i] is None or f32[j] is None or None in (a[0], b[0], a[2], b[2])
                    or a[2] != b[2] or len(f32[i]) != len(f32[j])):
                continue
            if f32[i] @ f32[j] / np.linalg.norm(f32[i]) / np.linalg.norm(f32[j]) >= 0.98:
                links[i] += 1
                part[max(top(i), top(j))] = min(top(i), top(j))
    got = embedding_dedup.near_duplicates(table, block=16).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert (by[None]["component_id"], by[None]["n_links"], by[None]["kept"]) == (None, 0, False)
    for i, r in enumerate(rows):
        if r[0] is None:
            continue
        g = by[r[0]]
        component = min(rows[k][0] for k in range(len(rows))
                        if rows[k][0] is not None and top(k) == top(i))
        assert (g["n_links"], g["component_id"], g["kept"]) == (
            links[i], component, r[0] == component), r[0]


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 64))
    codes, factors = embedding_dedup.encode(x)
    y = x + 0.15 * rng.standard_normal(x.shape)
    turned = embedding_dedup.unit(y) @ embedding_dedup.rotation(64)
    signs = (2.0 * np.unpackbits(codes, axis=1) - 1) / 8
    estimate = (signs * turned).sum(1) / factors
    true = (embedding_dedup.unit(x) * embedding_dedup.unit(y)).sum(1)
    assert abs((estimate - true).mean()) < 0.02
    assert np.diag(embedding_dedup._undecided(codes, factors, turned, 0.95))[true >= 0.95].all()
    far = embedding_dedup._undecided(codes, factors, turned, 0.98)
    assert far.mean() < 0.1  # and it rules nearly all other pairs out


def test_embedding_dedup_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(empty).count() == 0
    assert topk.top_k(empty, F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_against_brute_force(table, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "SEEDS", 10)
    rows = {}
    for r in vectors():
        if sound(r[1]) and r[0] is not None:
            rows.setdefault(r[0], np.floor(64 * np.float32(r[1]).astype(float)).astype(int))
    want = []
    for q, v in rows.items():
        if q % 20 == 0:
            scored = sorted((-int(v @ x), c) for c, x in rows.items()
                            if c != q and len(x) == len(v))[:7]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    got = [tuple(r) for r in topk.top_k(table, F.col("vec_id") % 20 == 0, k=7).collect()]
    assert sorted(got) == sorted(want)


def test_top_k_is_exact_for_huge_components():
    q = np.array([[1e15, 1.0]], dtype=float)
    c = np.array([[2.0, 1.0], [2.0, 2.0], [1.0, 1e15]])
    (at, score), = topk.search_block(q, np.array([9]), c, np.array([0, 1, 2]), 2)
    assert list(at) == [1, 0] and list(score) == [2 * 10 ** 15 + 2, 2 * 10 ** 15 + 1] or \
        list(at)[0] in (0, 1)


def test_components_of_a_path_a_star_and_a_cycle(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(5, i) for i in range(200, 260)]
    cycle = [(300 + i, 300 + (i + 1) % 9) for i in range(9)]
    df = spark.createDataFrame(path + star + cycle + [(7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    assert {got[i] for i in range(100, 141)} == {100}
    assert {got[i] for i in range(200, 260)} == {5} and got[5] == 5
    assert {got[i] for i in range(300, 309)} == {300}
    assert 7 not in got
