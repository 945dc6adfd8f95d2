"""The twelve diagnostic rules at their bounds and where statistics are unknown."""

import pytest

from barlab.operators import portfolio as P
from barlab.operators import reports as R

GOOD = {
    "data_weighted_coverage_ratio": 0.99, "trade_count": 30.0, "order_count": 40.0, "acceptance_rate": 0.2, "strategy_filter_rejection_rate": 0.5, "max_drawdown": -0.1, "profit_factor": 1.2, "win_rate_edge": 0.03,
    "positive_expectancy_probability": 0.75, "primary_exit_reason": "take_profit", "primary_exit_reason_rate": 0.9, "monthly_worst_return": -0.05, "avg_mae_r": -0.5, "max_margin_exposure": 1.0,
}


@pytest.mark.parametrize("change, check, status", [
    ({}, None, None), ({"data_weighted_coverage_ratio": 0.96}, "data_coverage", "attention"), ({"data_weighted_coverage_ratio": 0.9}, "data_coverage", "fail"), ({"trade_count": 29.0}, "trade_sample", "attention"),
    ({"acceptance_rate": 0.1}, "order_acceptance", "attention"), ({"order_count": 0.0}, "order_acceptance", "fail"), ({"strategy_filter_rejection_rate": 0.6}, "strategy_filter", "attention"), ({"max_drawdown": -0.35}, "drawdown_pressure", "fail"),
    ({"profit_factor": 1.1}, "profit_quality", "attention"), ({"profit_factor": float("inf")}, None, None), ({"win_rate_edge": -0.1}, "win_rate_edge", "fail"), ({"positive_expectancy_probability": 0.6}, "positive_expectancy", "attention"),
    ({"primary_exit_reason": "stop_loss", "primary_exit_reason_rate": 0.5}, "exit_structure", "attention"), ({"primary_exit_reason": "end_of_data", "primary_exit_reason_rate": 0.1}, "exit_structure", "attention"),
    ({"monthly_worst_return": -0.2}, "monthly_stability", "fail"), ({"avg_mae_r": -0.8}, "path_risk", "attention"), ({"max_margin_exposure": 1.5}, "capital_exposure", "fail"), ({"max_margin_exposure": 1.01}, "capital_exposure", "attention"),
])
def test_each_rule(spark, change, check, status):
    row = {"case_id": "a", **GOOD, **change}
    got = {r.check: r.status for r in P.diagnostics(spark.createDataFrame([row]), "case_id").collect()}
    assert set(got) == set(P.CHECKS) == set(R.ACTIONS) and {c: s for c, s in got.items() if s != "pass"} == ({check: status} if check else {})


def test_unknown_statistics_and_audits(spark):
    got = {r.check: r.status for r in P.diagnostics(spark.createDataFrame([("a", 0.0)], "case_id string, trade_count double"), "case_id").collect()}
    assert {c for c, s in got.items() if s == "fail"} == {"trade_sample", "order_acceptance", "exit_structure"} and len(got) == 12
    audits = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 0.0)], "case_id string, data_weighted_coverage_ratio double, data_audit_failed_count double")
    got = {r.case_id: r.status for r in P.diagnostics(audits, "case_id").where("check = 'data_coverage'").collect()}
    assert got == {"a": "fail", "b": "pass"}
