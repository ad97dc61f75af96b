"""One commit for all tables of a run, exactly-once ingest, stored candles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeflow.cli import main
from tapeflow.operators import candles as C
from tapeflow.operators import rollup as RU
from tapeflow.operators.screens import (
    divergence_history, latest_divergence, run_screens, screen)
from tapeflow.operators.windows import latest_per_key
from tapeflow.plans import jobs as J
from tapeflow.plans import reports as R
from tapeflow.plans.explain import plan_text
from tapeflow.plans.screens import SPECS
from tapeflow.session import scratch_path, staged
from tapeflow.sources import fixtures as FX
from tapeflow.sources import versions as V
from tapeflow.streaming.follow import follow
from tests.conftest import SF_SMALL


def same(a, b):
    b = b.select(a.columns)
    return a.count() == b.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def days(spark):
    """Captures of the first six days, and the lists."""
    snap = FX.snapshots(spark, SF_SMALL)
    day = F.to_date("download")
    first = [r.d for r in snap.select(day.alias("d")).distinct().orderBy("d").limit(6).collect()]
    return [staged(snap.filter(day == F.lit(d)), "day") for d in first], \
        FX.ticker_lists(spark, SF_SMALL)


def counts(spark, root):
    return {k: df.count() for k, df in J.stored_tables(spark, root).items()}


def test_a_run_that_dies_anywhere_changes_no_table(spark, days, monkeypatch):
    (one, two, *_), lists = days
    root = scratch_path(spark, "dies")
    J.run_ingest(spark, one, root, "error", *lists)
    before, at = counts(spark, root), V.version(spark, root)
    write, writes = V.Transaction.write, []

    def counted(self, name, *args, **kwargs):
        """After every write readers see what they saw before; the run dies
        after write number ``die_after``."""
        write(self, name, *args, **kwargs)
        writes.append(name)
        assert V.version(spark, root) == at
        assert V.read_table(spark, root, name, at=V.version(spark, root)) is None \
            or V.read_table(spark, root, name).count() == before.get(name, 0)
        if len(writes) == die_after:
            raise RuntimeError("executor lost")
    monkeypatch.setattr(V.Transaction, "write", counted)
    for die_after in (2, 7):
        writes.clear()
        with pytest.raises(RuntimeError, match="executor lost"):
            J.run_ingest(spark, two, root, "error", *lists)
        assert V.version(spark, root) == at and counts(spark, root) == before
    die_after = 0
    publish = V._publish

    def dead(*args):
        raise RuntimeError("driver lost")
    monkeypatch.setattr(V, "_publish", dead)
    with pytest.raises(RuntimeError, match="driver lost"):
        J.run_ingest(spark, two, root, "error", *lists)
    assert V.version(spark, root) == at and counts(spark, root) == before
    monkeypatch.setattr(V, "_publish", publish)
    writes.clear()
    J.run_ingest(spark, two, root, "error", *lists)  # nothing is stored twice
    assert sorted(writes) == sorted(["daily", "daily_blocks", "intraday", "index", "rollup",
                                     "index_rollup", "quarantine"])
    both = one.unionByName(two)
    assert same(J.stored_tables(spark, root)["daily"].drop(*J.DAILY_PARTITIONS), J.daily_load(both))
    assert V.version(spark, root).number == at.number + 1


def test_of_two_runs_from_one_version_one_commits(spark, days):
    (one, two, *_), _ = days
    root = scratch_path(spark, "two-runs")
    a, b = V.Transaction(spark, root), V.Transaction(spark, root)
    a.write("t", one.select("ticker", "download"))
    b.write("t", two.select("ticker", "download"))
    a.commit()
    with pytest.raises(V.ConcurrentCommitError):
        b.commit()
    assert V.read_table(spark, root, "t").count() == one.count()
    assert V.read_table(spark, root, "none") is None
    assert V.version(spark, scratch_path(spark, "no-root")) == V.Version()


def test_compaction_and_vacuum_keep_the_rows(spark, days):
    parts, _ = days
    root = scratch_path(spark, "compact")
    for k, part in enumerate(parts):
        tx = V.Transaction(spark, root)
        tx.write("t", part.select("ticker", "download", F.lit(k % 2).alias("p")), ["p"])
        tx.commit()
    old = V.version(spark, root)
    want = V.read_table(spark, root, "t", at=old)
    n = want.count()
    assert V.compact(spark, root, "t", ["p"], most=2) == 2
    assert V.compact(spark, root, "t", ["p"], most=2) == 0
    new = V.version(spark, root)
    assert len(old.tables["t"]) == 6 and len(new.tables["t"]) == 2
    assert same(V.read_table(spark, root, "t"), want) and want.count() == n
    assert V.vacuum(spark, root, keep=1) == 0               # too young to go
    assert V.vacuum(spark, root, keep=1, older_than_hours=-1) == 6
    assert V.read_table(spark, root, "t").count() == n


def test_candle_states_follow_every_kind_of_run(spark, days):
    """Days out of order and in parts, a replaced day, an unknown one: the
    states equal those made from the captures in one pass."""
    parts, lists = days
    root = scratch_path(spark, "rollup")
    split = F.xxhash64("ticker", "download") % 2 == 0
    for part in (parts[2], parts[0].filter(split), parts[4], parts[0].filter(~split), parts[1]):
        J.run_ingest(spark, part, root, "skip", *lists)
    changed = parts[2].withColumn("vol_buy_r", F.col("vol_buy_r") * 3)
    J.run_ingest(spark, changed.limit(40), root, "replace", *lists)
    t = J.stored_tables(spark, root)
    for flow, name, keys in (("intraday", "rollup", ["ticker"]),
                             ("index", "index_rollup", ["universe"])):
        assert same(t[name], RU.candle_states(t[flow], keys)), name
        states = RU.candle_states(t[flow].filter("hour(timestamp) < 11"), keys).unionByName(
            RU.candle_states(t[flow].filter("hour(timestamp) >= 11"), keys))
        assert same(t[name], RU.merge_states(states, keys)), name
    assert same(t["sessions"], t["intraday"].select("ticker", "date").distinct())


def test_reports_and_screens_from_the_stored_candles(spark, days):
    """The same rows as from the captures, and no capture is read."""
    lists = days[1]
    snap = FX.snapshots(spark, SF_SMALL)
    root = scratch_path(spark, "rollup-reports")
    J.run_ingest(spark, snap, root, "skip", *lists)
    t = J.stored_tables(spark, root)
    flow, daily, roll, watch = t["intraday"], t["daily"], t["rollup"], t["daily"].select(
        "ticker").distinct().filter("ticker < 'S5'")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    current = latest_per_key(snap, ["ticker"], "download", 1)
    q5, q6 = SPECS["divergence_at_limit"], SPECS["divergence_off_limit"]
    specs = [q5, q6, SPECS["smart_money_short"], SPECS["smart_money_off_limit"]]
    pairs = [
        (divergence_history(flow), divergence_history(None, roll)),
        (latest_divergence(flow), latest_divergence(None, rollup=roll)),
        (screen(current, q5, intraday=flow), screen(current, q5, rollup=roll)),
        (screen(current, q6, intraday=flow), screen(current, q6, rollup=roll)),
        (run_screens(current, specs, daily, flow), run_screens(current, specs, daily, rollup=roll)),
        (R.stock_buy_power_candles(flow, daily), R.stock_buy_power_candles(None, daily, rollup=roll)),
        (R.stock_buy_power_candles(flow, daily, watch),
         R.stock_buy_power_candles(None, daily, watch, rollup=roll)),
        (R.stock_per_capita_candles(flow, daily),
         R.stock_per_capita_candles(None, daily, rollup=roll)),
        (R.screened_candles(watch, flow, daily), R.screened_candles(watch, None, daily, rollup=roll)),
        (R.market_candles(t["index"]), R.market_candles(None, t["index_rollup"])),
        (C.indicator_candles(flow, "i_buy_pow"), RU.rollup_candles(roll, "i_buy_pow")),
    ]
    for k, (old, new) in enumerate(pairs):
        assert same(old, new), k
        p = plan_text(new)
        assert f"{root}/intraday" not in p and f"{root}/index/" not in p, k
    assert sum(old.count() for old, _ in pairs[:1]) > 0 and pairs[5][0].count() > 0
    with pytest.raises(ValueError):
        screen(current, q5)


def land(spark, df, folder, name):
    """One landed file (a folder of one part, moved by its own name)."""
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_follow_ingests_every_file_once(spark, days, monkeypatch):
    parts, lists = days
    folder, root = scratch_path(spark, "landed"), scratch_path(spark, "followed")
    args = (spark, f"{folder}/*", root, f"{root}/_follow", parts[0].schema)
    kw = {"block_list": lists[0], "basket": lists[1]}
    for k in (1, 0):
        land(spark, parts[k], folder, f"file{k}")
    follow(*args, max_files=1, **kw)
    at = V.version(spark, root)
    follow(*args, **kw)                                   # nothing new
    assert V.version(spark, root) == at
    land(spark, parts[1].orderBy(F.desc("ticker")), folder, "again")  # the same rows
    follow(*args, **kw)
    assert V.version(spark, root) == at
    commit, dead = V.Transaction.commit, []

    def commits_and_dies(self):
        commit(self)
        if not dead:
            dead.append(1)
            raise RuntimeError("driver lost")
    monkeypatch.setattr(V.Transaction, "commit", commits_and_dies)
    for k in (2, 3):
        land(spark, parts[k], folder, f"file{k}")
    with pytest.raises(Exception, match="driver lost"):
        follow(*args, **kw)
    assert V.version(spark, root).number == at.number + 1
    follow(*args, **kw)                                   # the micro-batch runs again
    assert V.version(spark, root).number == at.number + 1
    t = J.stored_tables(spark, root)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    assert same(t["intraday"].drop("date"), J.intraday_load(whole))
    assert same(t["index"].drop("date"), J.market_load(whole, *lists))
    assert t["landed"].count() == 4 and t["landed"].select("digest").distinct().count() == 4


def test_follow_from_the_command_line(spark, days, capsys):
    parts, _ = days
    folder, root = scratch_path(spark, "cli-landed"), scratch_path(spark, "cli-followed")
    parts[0].write.parquet(folder)
    command = ["follow", "--captures", folder, "--root", root]
    assert main(command) == 0 and main(command) == 0
    assert V.version(spark, root).number == 1
    parts[1].write.mode("append").parquet(folder)
    assert main([*command, "--max-files", "1"]) == 0
    t = J.stored_tables(spark, root)
    assert same(t["intraday"].drop("date"), J.intraday_load(parts[0].unionByName(parts[1])))
    assert main(["compact", "--root", root, "--most", "1"]) == 0
    assert "partitions rewritten" in capsys.readouterr().out
    assert same(J.stored_tables(spark, root)["intraday"], t["intraday"])


def test_a_repeated_run_replaces_its_quarantined_rows(spark, days):
    (one, *_), lists = days
    bad = one.limit(3).withColumn("ticker", F.lit(None).cast("string"))
    root = scratch_path(spark, "quarantined")
    for rows in (bad, bad.limit(1), one.limit(5)):
        J.run_ingest(spark, rows, root, "skip", *lists, run_id="one")
        left = J.stored_tables(spark, root).get("quarantine")
        assert (0 if left is None else left.count()) == (0 if rows.filter(
            "ticker IS NULL").isEmpty() else rows.count())
    J.run_ingest(spark, bad.withColumn("download", F.lit(dt.datetime(2020, 1, 1)).cast(
        "timestamp_ntz")), root, "skip", *lists, run_id="two")
    assert J.stored_tables(spark, root)["quarantine"].count() == 3
