"""A sweep over first passages against matching and replaying every case's orders."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from barlab.operators import execution as E
from barlab.operators import passages as X
from barlab.operators.reports import with_cases

NAMES = ["order_id", "case_name", "exit_reason", "exit_date", "holding_bars", "exit_price", "return_pct", "mae_pct", "mfe_pct", "r_multiple", "actual_reward_to_risk"]


@pytest.fixture(scope="module")
def made(spark):
    r, start = random.Random(11), datetime.datetime(2024, 1, 1)
    bars, orders = [], []
    for s in ("600000.SH", "000001.SZ"):
        close = 10.0
        for i in range(120):
            o, close = close * r.uniform(0.97, 1.03), close * r.uniform(0.95, 1.05)
            volume = 0.0 if r.random() < 0.15 else 100.0
            bars.append((start + datetime.timedelta(days=i), s, o, max(o, close) * r.uniform(1, 1.02), min(o, close) * r.uniform(0.98, 1), close, volume, volume))
            side = r.choice(["long", "short"])
            sign = 1 if side == "long" else -1
            entry = round(close * (1 + sign * r.uniform(0, 0.01)), 2)
            stop = round(entry * (1 - sign * r.choice([0.01, 0.04, 0.4])), 2)
            for set_ in ("a", "b") if i % 3 else ("a",):
                orders.append((f"o{s}{i}", f"e{i}", s, side, start + datetime.timedelta(days=i), i, close, entry, stop if set_ == "a" or i % 2 else round(stop * (1 - sign * 0.01), 2), entry * 2, None, None, None, set_))
    b = spark.createDataFrame(bars, "date timestamp_ntz, stock_code string, open double, high double, low double, close double, volume double, amount double")
    o = spark.createDataFrame(orders, "order_id string, event_id string, stock_code string, side string, signal_date timestamp_ntz, signal_bar_index int, signal_price double, entry_price double, stop_price double, target_price double, max_holding_bars int, max_actual_risk_pct double, max_chase_pct double, set string")
    cases = spark.createDataFrame([(f"{k}{rr}h{h}", rr, h, k) for k in ("a", "b") for rr in (0.5, 1.5, 4.0, 90.0) for h in (1, 5, 30)], "case_name string, risk_reward double, max_holding_bars int, set string")
    return b, o, cases


@pytest.mark.parametrize("policy", ["conservative", "optimistic"])
def test_sweep_equals_replays(spark, made, policy):
    bars, orders, cases = made
    c = E.Execution(intrabar_exit_policy=policy, fee_rate=0.001, slippage_bps=3.0)
    got = {r.order_id: r for r in X.sweep_trades(bars, orders, cases, ["set"], c).select(*NAMES).collect()}
    seen = 0
    for k in ("a", "b"):
        keyed = with_cases(orders.where(F.col("set") == k).drop("set"), cases.where(F.col("set") == k).drop("set"))
        for w in E.simulate(bars, E.match_entries(bars, keyed, c), c).select(*NAMES).collect():
            g, seen = got[w.order_id], seen + 1
            for n in NAMES:
                assert g[n] == (pytest.approx(w[n], abs=1e-9) if isinstance(w[n], float) else w[n]), (w.order_id, n)
    assert seen == len(got) > 1500 and {r.exit_reason for r in got.values()} == {"stop_loss", "take_profit", "max_holding"}


def test_paths_do_not_grow_with_cases(spark, made):
    bars, orders, cases = made
    filled = E.match_entries(bars, orders.where("set = 'a'").drop("set").withColumn("max_holding_bars", F.lit(30))).where("reason = ''")
    paths = X.first_passages(bars, filled)
    assert paths.count() == filled.count()  # one row an order; cases have no part in it
    with pytest.raises(ValueError):
        X.sweep_trades(bars, orders, cases.limit(0))
    with pytest.raises(ValueError):
        X.sweep_trades(bars, orders, cases, c=E.Execution(trailing_drawdown_pct=0.1))


def test_sweep_without_detector_parameters(spark, made):
    bars, orders, cases = made
    one = orders.where("set = 'a'").drop("set")
    few = cases.where("set = 'a'").drop("set")
    got = X.sweep_trades(bars, one, few)
    want = E.simulate(bars, E.match_entries(bars, with_cases(one, few)))
    assert got.count() == want.count() and got.select(F.round(F.sum("return_pct"), 6)).first() == want.select(F.round(F.sum("return_pct"), 6)).first()
