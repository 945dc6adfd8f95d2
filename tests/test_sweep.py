"""Pareto layers and global ranks of sweep tables against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from barlab.operators import sweep as W


def table(spark, n, seed, ties):
    r = random.Random(seed)
    num = lambda: r.choice([None, *range(4)]) if ties else r.random()
    rows = [(f"c{i:04d}", *(None if (v := num()) is None else float(v) for _ in range(5)), r.randrange(5)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "case_name string, total_return double, max_drawdown double, monthly_worst_return double, monthly_return_std double, ulcer_index double, trade_count int")


def layers(rows):
    score = {r[0]: tuple(float("-inf") if v is None else v * s for v, s in zip(r[1:], (1, 1, 1, -1, -1, 1))) for r in rows}
    beats = lambda a, b: all(x >= y for x, y in zip(a, b)) and a != b
    left, out, k = set(score), {}, 0
    while left:
        k += 1
        front = {c for c in left if not any(beats(score[o], score[c]) for o in left)}
        out |= dict.fromkeys(front, k)
        left -= front
    return out


@pytest.mark.parametrize("limits", [(20_000, 4), (40, 2), (5, 1)])
@pytest.mark.parametrize("ties", [True, False])
def test_layers_equal_peeling(spark, limits, ties):
    rows, df = table(spark, 120, 3, ties)
    got = {r.case_name: r.pareto_rank for r in W.pareto_ranks(df, one_task=limits[0], depth=limits[1]).collect()}
    assert got == layers(rows)
    if limits[0] == 20_000:
        assert {r.case_name for r in W.pareto_layer(df).collect()} == {c for c, k in got.items() if k == 1}
        assert W.pareto_ranks(df.limit(0)).count() == 0


def test_scores_and_ranks(spark):
    rows, df = table(spark, 80, 5, True)
    df = df.withColumn("return_per_exposure_bar", F.lit(2.0)).withColumn("diagnostic_failed_count", F.lit(1))
    names = ("total_return", "max_drawdown", "monthly_worst_return", "monthly_return_std", "ulcer_index")

    def percentile(k, v):
        x = [r[k + 1] * (-1 if names[k] in ("monthly_return_std", "ulcer_index") else 1) for r in rows if r[k + 1] is not None]
        if v is None:
            return 0.5
        v = v * (-1 if names[k] in ("monthly_return_std", "ulcer_index") else 1)
        return (sum(y < v for y in x) + (sum(y == v for y in x) + 1) / 2) / len(x)

    import math

    want = {}
    for r in rows:
        total = sum(W.WEIGHTS[n] * percentile(k, r[k + 1]) for k, n in enumerate(names)) + 0.08 * 1.0 + 0.07 * math.log1p(r[6]) / math.log1p(max(x[6] for x in rows))
        want[r[0]] = round(min(max(total * 100 - 15, 0), 100), 6)
    got = {r.case_name: r for r in W.rank_sweep(df).collect()}
    assert {c: r.risk_adjusted_score for c, r in got.items()} == pytest.approx(want, abs=1e-5)
    assert [c for c, _ in sorted(got.items(), key=lambda x: x[1].risk_adjusted_rank)] == sorted(got, key=lambda c: (-got[c].risk_adjusted_score, c))
    falling = lambda v: (v is None, -(v or 0))
    by = {r[0]: (falling(r[1]), falling(r[2]), falling(r[3]), (r[4] is None, r[4] or 0), -r[6], r[0]) for r in rows}
    assert [c for c, _ in sorted(got.items(), key=lambda x: x[1].sweep_rank)] == sorted(by, key=by.get)


def test_no_window_over_all_cases(spark):
    _, df = table(spark, 50, 7, False)
    plan = W.numbered(df, W.sweep_order(df.columns), "sweep_rank")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
