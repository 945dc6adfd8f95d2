"""Coverage and gaps over an ordinal calendar, against a walk over all expected points."""

import random

import pytest
from pyspark.sql import functions as F

from barlab.operators import audit as A
from barlab.operators import catalog as K

BARS = "stock_code string, timeframe string, date timestamp_ntz, open double, high double, low double, close double, volume double, amount double"


@pytest.fixture(scope="module")
def points():
    r = random.Random(2)
    grid = {"a": range(0, 90, 3), "b": range(50)}
    rows = [(k, s, at) for s, days in grid.items() for k in ("x", "y", "z", "all") for at in days if k == "all" or r.random() < {"x": 0.2, "y": 0.8, "z": 0.97}[k]]
    return grid, rows


@pytest.mark.parametrize("block", [2, 8192])
def test_gaps_and_coverage(spark, points, block):
    grid, rows = points
    stamp = "timestamp_ntz'2024-01-01' + make_dt_interval(day)"
    df = spark.createDataFrame(rows + rows[:20] + [("x", "a", 1), ("x", "a", None)], "k string, s string, day int").selectExpr("k", "s", f"{stamp} AS at")
    days = A.calendar(spark.createDataFrame([(s, d) for s, ds in grid.items() for d in ds], "s string, day int").selectExpr("s", f"{stamp} AS at"), ["s"])
    number = lambda at: None if at is None else (at.date() - at.date().replace(month=1, day=1)).days
    got = sorted((g.k, g.s, number(g.gap_start), number(g.gap_end), g.missing_count, number(g.previous_at), number(g.next_at)) for g in A.gap_episodes(df, days, ["k", "s"], ["s"], block).collect())
    want = []
    for k in ("x", "y", "z", "all"):
        for s, expected in grid.items():
            have, run, last = {d for kk, ss, d in rows if (kk, ss) == (k, s)}, [], None
            for d in [*expected, None]:
                if d is not None and d not in have:
                    run.append(d)
                    continue
                if run:
                    want.append((k, s, run[0], run[-1], len(run), last, d))
                run, last = [], d
    assert got == sorted(want, key=lambda x: x[:3])
    for c in A.coverage(df, days, ["k", "s"], ["s"], block).collect():
        own = [w for w in want if w[:2] == (c.k, c.s)]
        assert (c.expected_count, c.gap_count, c.max_gap) == (len(grid[c.s]), len(own), max((w[4] for w in own), default=0))
        assert c.actual_count == c.expected_count - sum(w[4] for w in own)
        if own:
            worst = max(own, key=lambda w: (w[4], -w[2]))
            assert (number(c.max_gap_start), number(c.max_gap_end), number(c.first_missing), number(c.last_missing)) == (worst[2], worst[3], own[0][2], own[-1][3])


def test_no_table_of_symbols_and_dates(spark, points):
    df = spark.createDataFrame(points[1], "k string, s string, day int").selectExpr("k", "s", "timestamp_ntz'2024-01-01' + make_dt_interval(day) AS at")
    plan = A.gap_episodes(df, A.calendar(df, ["s"]), ["k", "s"], ["s"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and plan.count("Window") <= 1


def test_audit_of_faults_and_of_nothing(spark):
    rows = [("600000.SH", "1d", f"2024-01-0{i}", 1.0, 2.0, 0.5, 1.5, v, 1.0) for i, v in ((1, 5.0), (2, 0.0), (4, 1.0))]
    rows += [("bad", "1d", "2024-01-03", 1.0, 2.0, 0.5, 1.5, 1.0, 1.0), ("000001.SZ", "1d", None, 1.0, 2.0, 0.5, 1.5, 1.0, 1.0), ("000002.SZ", "1d", "2024-01-02", 1.0, 2.0, 0.5, 1.5, 0.0, 0.0)]
    df = spark.createDataFrame(rows, BARS.replace("timestamp_ntz", "string")).withColumn("date", F.col("date").cast("timestamp_ntz"))
    got = {r.stock_code: r for r in K.audit_market(df).collect()}
    assert got["600000.SH"].status == "ok" and (got["600000.SH"].expected_count, got["600000.SH"].actual_count, got["600000.SH"].max_gap_minutes) == (4, 2, 2880)
    assert got["bad"].status == got["000001.SZ"].status == "quality_error" and got["bad"].invalid_symbol_count == got["000001.SZ"].invalid_date_count == 1
    assert got["000002.SZ"].status == "no_window_data" and got["000002.SZ"].coverage_ratio == 0
    empty = K.summarize_audit(K.audit_market(df.limit(0)), 0.9).first()
    assert empty.data_audit_row_count == 0 and empty.data_coverage_p50 == 0 and empty.data_max_missing_gap_start_at == ""
