"""Plan checks: no Python UDFs anywhere, top-n planned as WindowGroupLimit,
one scan of the intraday source per candle query, no global Window but the one
that ranks a screen's survivors,
filters and column pruning pushed into the scan."""
import pytest
from pyspark.sql import functions as F

from tapeflow.plans import catalog as CAT
from tapeflow.plans.screens import SPECS
from tapeflow.sources import fixtures as FX
from tests.conftest import SF_SMALL
from tapeflow.plans.explain import plan_text

STREAMING = {"stream_candles", "stream_dedup"}
# One task ranks the survivors of a screen: at most one row for each ticker.
RANKED = {*SPECS, "stream_screen", "screen_latest_capture", "rollup_divergence_at_limit",
          "rollup_divergence_off_limit"}
# Scalar subqueries (a middle or newest day): one partial row from each task.
SCALARS = {"schema_evolution", "screen_latest_capture", "append_unique_error",
           "daily_load_incremental"}


def plan(df) -> str:
    return plan_text(df)


@pytest.mark.parametrize("name", sorted(set(CAT.QUERIES) - STREAMING))
def test_no_python_and_no_global_window(spark, name):
    p = plan(CAT.QUERIES[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    # A Window line is "Window [functions], [partition], [order]"; Spark leaves
    # an empty partition list out.
    windows = [x for x in p.splitlines() if x.strip(" +-:").startswith("Window [")]
    alone = [x for x in windows if x.count("], [") < 2]
    assert len(alone) <= (name in RANKED), alone
    if name not in SCALARS:
        assert p.count("Exchange SinglePartition") <= (name in RANKED)


def test_the_window_check_can_fail(spark):
    """The same test sees the one window that is allowed."""
    p = plan(CAT.QUERIES["volatile_limit_up"](spark, SF_SMALL))
    alone = [x for x in p.splitlines()
             if x.strip(" +-:").startswith("Window [") and x.count("], [") < 2]
    assert len(alone) == 1 and p.count("Exchange SinglePartition") == 1


def test_top_n_uses_window_group_limit(spark):
    p = plan(CAT.QUERIES["latest_sessions"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p
    p = plan(FX.current_snapshot(spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_divergence_scans_events_once(spark):
    df = CAT.QUERIES["divergence_history"](spark, SF_SMALL)
    assert plan(df).count("FileScan parquet") == 1


def test_pushdown_and_pruning(spark):
    li = FX.table(spark, SF_SMALL, "lineitem").filter(F.col("l_quantity") > 10) \
        .select("l_partkey", "l_quantity")
    p = plan(li)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in p
