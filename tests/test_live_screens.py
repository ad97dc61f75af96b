"""Screens judged on a stream that is also their evidence."""

import pytest
from pyspark.sql import functions as F

from tapeflow.operators.flows import daily_series, to_intraday_flow
from tapeflow.operators.screens import run_screens
from tapeflow.operators.windows import latest_per_key
from tapeflow.plans.screens import SPECS
from tapeflow.session import scratch_path, staged
from tapeflow.sources import fixtures as FX
from tapeflow.sources import versions as V
from tapeflow.streaming import live as L
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def snap(spark):
    return staged(FX.snapshots(spark, SF_SMALL), "captures")


def batch_screens(captures):
    current = latest_per_key(captures, ["ticker"], "download", 1)
    return run_screens(current, SPECS.values(), daily_series(captures),
                       to_intraday_flow(captures))


def table(spark, root, name):
    return V.read_table(spark, root, name)


def test_every_prefix_equals_the_batch_screens(spark, snap):
    """Captures in no order of time: late ones change evidence, not the latest
    capture.  Alerts add up to what passes."""
    root = scratch_path(spark, "live")
    sink = L.live_screen_sink(spark, root, SPECS.values())
    deal = F.pmod(F.xxhash64("ticker", "download"), F.lit(4))
    passed = {}
    for k in range(4):
        sink(snap.filter(deal == k), k)
        got = sorted(L.live_screens(spark, root).collect())
        assert got == sorted(batch_screens(snap.filter(deal <= k)).collect()), k
        passed[k] = {(r.ticker, r.screen) for r in got}
        for r in table(spark, root, L.ALERTS).filter(F.col("epoch") == k).collect():
            before = (r.ticker, r.screen) in passed.get(k - 1, set())
            after = (r.ticker, r.screen) in passed[k]
            assert (before, after) == ((False, True) if r.event == "entered" else (True, False))
        changes = passed[k] ^ passed.get(k - 1, set())
        assert table(spark, root, L.ALERTS).filter(F.col("epoch") == k).count() == len(changes)
    assert any(passed[k] - passed[k + 1] for k in range(3)) and passed[3]
    # what was read already, in another split, judges no ticker and alerts nobody
    standing = sorted(table(spark, root, L.STANDING).drop("bucket").collect())
    alerts = table(spark, root, L.ALERTS).count()
    sink(snap.filter(F.hour("download") % 3 == 1), 9)
    assert sorted(table(spark, root, L.STANDING).drop("bucket").collect()) == standing
    assert table(spark, root, L.ALERTS).count() == alerts


def test_late_evidence_is_judged_with_the_stored_capture(spark, snap):
    """Each ticker's latest capture first, then all others: only tickers with
    new evidence are judged again, and the others keep their epoch."""
    root = scratch_path(spark, "late")
    sink = L.live_screen_sink(spark, root, SPECS.values())
    newest = staged(latest_per_key(snap, ["ticker"], "download", 1), "newest")
    rest = snap.join(newest.select("ticker", "download"), ["ticker", "download"], "left_anti")
    half = rest.filter(F.xxhash64("ticker") % 2 == 0)
    sink(newest, 0)
    before = L.live_screens(spark, root).count()
    sink(half, 1)
    judged = table(spark, root, L.STANDING).select("ticker", "judged")
    late = half.select("ticker").distinct()
    assert judged.filter("judged = 1").join(late, "ticker", "left_anti").isEmpty()
    assert 0 < judged.filter("judged = 1").count() < judged.count()
    sink(rest, 2)
    got = sorted(L.live_screens(spark, root).collect())
    assert got == sorted(batch_screens(snap).collect()) and len(got) != before


def test_unusable_rows_and_a_lost_run(spark, snap, monkeypatch):
    root = scratch_path(spark, "lost")
    sink = L.live_screen_sink(spark, root, [SPECS["divergence_off_limit"]])
    sink(snap.limit(3).withColumn("download", F.lit(None).cast("timestamp_ntz")), 0)
    assert V.version(spark, root).number == 0
    sink(snap.filter(F.hour("download") < 11), 1)
    at = V.version(spark, root)

    def dead(self):
        raise RuntimeError("driver lost")
    with monkeypatch.context() as m:
        m.setattr(V.Transaction, "commit", dead)
        with pytest.raises(RuntimeError, match="driver lost"):
            sink(snap, 2)
    assert V.version(spark, root) == at
    sink(snap, 2)
    want = batch_screens(snap).filter("screen = 'divergence_off_limit'")
    assert sorted(L.live_screens(spark, root).collect()) == sorted(want.collect())
