"""Places, running values, runs and quantiles over blocks, against plain Python."""

import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.operators import ranks
from barlab.operators.stats import trade_path, trade_statistics


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    return [(r.choice([None, "a", "a", "a", "b"]), i, r.choice([-2.0, -1.0, 0.0, 0.5, 3.0])) for i in r.sample(range(1000), 400)] + [("one", 5, 1.0)]


def by_key(rows):
    out = {}
    for k, i, v in sorted(rows, key=lambda x: x[1]):
        out.setdefault(k, []).append((i, v))
    return out


@pytest.mark.parametrize("block", [3, 8192])
def test_places_running_values_and_runs(spark, rows, block):
    placed = ranks.ordinals(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], ["i"])
    most = placed.agg(F.max("total")).first()[0]
    got = ranks.running(placed, ["k"], {"s": ("sum", F.col("v")), "p": ("product", 1 + F.col("v") / 100), "m": ("max", F.col("v"))}, most, block=block).collect()
    runs = {r.k: (r.up, r.down) for r in ranks.longest_runs(placed, ["k"], {"up": F.col("v") > 0, "down": F.col("v") < 0}, most, block=block).collect()}
    assert len(got) == len(rows)
    for k, values in by_key(rows).items():
        own = sorted((r for r in got if r.k == k), key=lambda r: r.place)
        v = np.array([x for _, x in values])
        assert [r.i for r in own] == [i for i, _ in values] and [r.place for r in own] == list(range(len(v))) and {r.total for r in own} == {len(v)}
        np.testing.assert_allclose([r.s for r in own], np.cumsum(v), atol=1e-9)
        np.testing.assert_allclose([r.p for r in own], np.cumprod(1 + v / 100), rtol=1e-12)
        assert [r.m for r in own] == list(np.maximum.accumulate(v))
        longest = lambda flag: max((len(list(g)) for f, g in groupby(flag) if f), default=0)
        assert runs[k] == (longest(v > 0), longest(v < 0))


def test_no_window_holds_a_whole_key(spark, rows):
    placed = ranks.ordinals(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], ["i"])
    out = ranks.running(placed, ["k"], {"s": ("sum", F.col("v"))}, 400, block=5)
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan  # the result is written; what made it had blocks as keys


def test_quantiles(spark, rows):
    df = spark.createDataFrame(rows + [("nulls", 1, None)], "k string, i int, v double")
    got = {r.k: r for r in ranks.quantiles(df, ["k"], {"q05": ("v", 0.05), "q5": ("v", 0.5), "i9": ("i", 0.9)}).collect()}
    for k, values in by_key(rows).items():
        v, i = np.array([x for _, x in values]), np.array([x for x, _ in values])
        np.testing.assert_allclose([got[k].q05, got[k].q5, got[k].i9], [np.quantile(v, 0.05), np.quantile(v, 0.5), np.quantile(i, 0.9)])
    assert got["nulls"].q5 is None and got["nulls"].i9 == 1


def test_statistics_do_not_depend_on_blocks(spark):
    r = random.Random(9)
    trades = spark.createDataFrame(
        [(r.choice(["x", "y", None]), f"o{i}", i % 37, r.choice([None, 1.5, -1.0, -0.5, 0.0, 2.0]), i % 5) for i in range(300)],
        "side string, order_id string, exit_date int, return_pct double, holding_bars int",
    ).withColumn("exit_date", F.expr("date_add(DATE '2020-01-01', exit_date)"))
    small, whole = ({x.side: x.asDict() for x in trade_statistics(trades, ["side"], block=b).collect()} for b in (4, 8192))
    assert small.keys() == whole.keys() and len(small["x"]) == 64  # the key, the 62 and the downside deviation
    for side, stats in whole.items():
        for name, value in stats.items():
            assert small[side][name] == (value if isinstance(value, str) or value is None else pytest.approx(value, rel=1e-12, abs=1e-15)), name
    path = {p.order_id: p for p in trade_path(trades, ["side"], block=4).collect()}
    assert len(path) == 300 and all(p.equity <= p.peak for p in path.values())
