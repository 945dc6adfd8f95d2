"""What larger tables bring: lost equity, many cases, symbols beyond 600999, reversals over watches, statistics by need."""

import datetime
import random

import duckdb
import pytest

from barlab.operators import sweep as W
from barlab.operators.equity import period_returns
from barlab.operators.execution import select_non_overlapping
from barlab.operators.stats import trade_statistics
from barlab.plans import registry


def test_periods_of_a_curve_that_fell_to_zero(spark):
    day = lambda m: datetime.datetime(2020, m, 5)
    curve = spark.createDataFrame([("a", day(1), 1.0), ("a", day(2), 0.0), ("a", day(3), 0.0)], "case_id string, date timestamp_ntz, net_value double")
    got = {r.period.month: (r.max_drawdown, r["return"]) for r in period_returns(curve).collect()}
    assert got == {1: (0.0, 0.0), 2: (-1.0, -1.0), 3: (0.0, 0.0)}


@pytest.mark.parametrize("limits", [(500_000, 50_000_000), (50, 200)])
def test_dominated_counts(spark, limits):
    r = random.Random(3)
    rows = [(f"c{i:03d}", *(float(r.randrange(6)) if r.random() < 0.95 else None for _ in range(3))) for i in range(130)]
    table = spark.createDataFrame(rows, "case_name string, total_return double, max_drawdown double, ulcer_index double")
    score = [(x[0], [float("-inf") if v is None else v * s for v, s in zip(x[1:], (1, 1, -1))]) for x in rows]
    beats = lambda a, b: all(x >= y for x, y in zip(a, b)) and any(x > y for x, y in zip(a, b))
    want = {k: n for k, a in score if (n := sum(beats(a, b) for _, b in score))}
    assert {x.better: x.dominated for x in W.dominated_counts(table, chunk=limits[0], pairs=limits[1]).collect()} == want
    assert W.dominance(table).groupBy("better").count().count() == len(want)


def test_symbols_from_text_of_many_suppliers(spark, tmp_path):
    keys = [1, 999, 1000, 3000, 3001, 88_000, 229_999, 230_500, 260_001, 320_000, 399_999, 400_001]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {(r.stock_code, r.position) for r in registry.QUERIES["s24_symbols_from_text"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    cur = con.execute(registry.ORACLE_SQL["s24_symbols_from_text"])
    at = [c[0] for c in cur.description].index("stock_code")
    want = {(r[at], r[1 - at]) for r in cur.fetchall()}
    assert got == want and ("601000.SH", 1000) in want and ("430000.BJ", 260_001) in want


def test_reversals_take_one_order_of_bars(spark):
    plan = registry.QUERIES["w16_reversal_events"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    windows = [x.split("windowspecdefinition(", 1)[1].split("specifiedwindowframe")[0] for x in plan.split("\n") if "windowspecdefinition(" in x]
    assert windows and not any("_bull" in w or "_bear" in w for w in windows)


def test_wanted_statistics_are_those_of_all(spark):
    r = random.Random(5)
    rows = [(f"o{i}", "ab"[i % 2], datetime.datetime(2020, 1, 1) + datetime.timedelta(days=r.randrange(50)), r.uniform(-5, 6), float(r.randrange(9))) for i in range(200)]
    trades = spark.createDataFrame(rows, "order_id string, side string, exit_date timestamp_ntz, return_pct double, r_multiple double")
    whole = {x.side: x.asDict() for x in trade_statistics(trades, ["side"]).collect()}
    for wanted in (["trade_count"], ["total_return", "recovery_factor"], ["max_consecutive_wins", "win_rate"], ["cvar_95"], ["return_contribution", "avg_r_multiple"]):
        some = trade_statistics(trades, ["side"], wanted=wanted)
        assert some.columns == ["side", *wanted]
        for x in some.collect():
            assert all(x[n] == pytest.approx(whole[x.side][n], rel=1e-12) for n in wanted)


def test_gate_walks_keys_in_batches(spark):
    day = lambda n: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=n)
    r = random.Random(7)
    rows = [(r.choice([None, 1, 2]), f"o{i:03d}", day(s), day(s + r.randrange(1, 9))) for i in range(90) for s in [r.randrange(60)]]
    want = {}
    for k in (None, 1, 2):
        until = None
        for _, o, a, b in sorted((x for x in rows if x[0] == k), key=lambda x: (x[2], x[1])):
            want[o] = "accepted" if until is None or a > until else "rejected"
            until = b if want[o] == "accepted" else until
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = select_non_overlapping(spark.createDataFrame(rows, "k int, order_id string, entry_date timestamp_ntz, exit_date timestamp_ntz"), ["k"], sequence="order_id")
        plan = got._jdf.queryExecution().toString()
        assert {x.order_id: x.status for x in got.collect()} == want and "FlatMapGroupsInPandas" not in plan
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
