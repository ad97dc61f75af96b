"""Sums of doubles that no split or order of the rows changes."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeflow.functions.exact import exact_sum, exact_sum_parts, part_names
from tapeflow.operators.flows import finish_index, index_flows, index_parts
from tapeflow.sources import fixtures as FX
from tests.conftest import SF_SMALL


def test_sums_are_exact_in_any_split(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 10.0 ** k, 400) for k in range(-3, 9)])
    want = float(sum(Fraction(v) for v in x))
    seen = set()
    for k in range(20):
        df = spark.createDataFrame([(float(v), int(i)) for i, v in enumerate(rng.permutation(x))],
                                   "x double, i long").repartition(1 + k % 5)
        parts = df.groupBy((F.col("i") % (1 + k)).alias("p")).agg(*exact_sum_parts(F.col("x"), "s"))
        total = parts.agg(*(F.sum(c).alias(c) for c in part_names("s")))
        seen.add(total.select(exact_sum("s").alias("s")).first().s)
    assert len(seen) == 1 and math.isclose(seen.pop(), want, rel_tol=1e-15)


@pytest.mark.parametrize("values,want", [
    ([], None), ([None, None], None), ([0.1, -0.1], 0.0), ([-0.25, None], -0.25),
    ([1e16, 1.0], 1e16 + 1.0), ([float("inf"), 1.0], float("inf")), ([-1e-20, 2.0], 2.0),
    ([2147483647.5, -2147483647.5, 0.5], 0.5), ([float("-inf"), float("inf")], float("nan"))])
def test_edges(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.agg(*exact_sum_parts(F.col("x"), "s")).select(exact_sum("s").alias("s")).first().s
    assert got == want or (want is not None and math.isnan(want) and math.isnan(got))


def test_market_series_is_bit_equal_under_any_partitioning(spark):
    """A1 and A2 in one pass, and from parts of 20 splits."""
    snap = FX.hourly_cross_sections(FX.snapshots(spark, SF_SMALL))
    lists = FX.ticker_lists(spark, SF_SMALL)
    order = ["universe", "timestamp"]
    want = index_flows(snap, *lists).orderBy(*order).collect()
    assert len(want) > 0
    for k in range(20):
        deal = F.pmod(F.xxhash64("ticker", F.lit(k)), F.lit(3))
        parts = [index_parts(snap.repartition(1 + k % 4, F.xxhash64("ticker", F.lit(k)))
                             .filter(deal == i), *lists) for i in range(3)]
        got = finish_index(parts[0].unionByName(parts[1]).unionByName(parts[2]))
        assert got.orderBy(*order).collect() == want
