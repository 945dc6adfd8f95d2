"""Registered bar queries against their DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from barlab.plans import catalog_queries, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = [
    "w01_bar_features", "w02_ema", "w03_slope_z", "w05_market_structure", "w08_trend_state", "w10_trend_events", "w11_range_score", "w13_log_regression_channel", "w14_swing_channel", "w16_reversal_events",
    "w21_breakout_triggers", "w24_terminal_features", "f01_limit_open_dates", "f02_filter_limit_open_days", "c01_normalize_symbol", "c03_normalize_bars", "a01_audit", "a02_gap_episodes", "a16_downsample",
    "c15_positive_expectancy", "t02_pareto_ranks", "j10_dominance", "s14_wide_to_long", "f03_limit_open_in_window", "a25_order_funnel", "a22_trade_exposure", "a29_equity_exposure", "a36_symbol_statistics", "p12_parameter_sweep", "a38_parameter_summary", "a39_sweep_summary", 
    "w41_trade_annotations", "w43_period_streaks", "j08_dated_equity", "s22_case_records", "c17_case_config_hash", "u03_filter_logs", "a26_filter_funnel", *catalog_queries.Q,
    "j01_asof_context", "j03_order_outcomes", "j04_first_exit_trailing", "w35_single_position_gate", "a18_grouped_statistics_side", "a30_period_returns", "w33_drawdown_episodes", "t01_rank_sweep", "t03_pareto_front",
    "a17_trade_statistics_by_symbol", "p11_experiment_tables", "p11_experiment_data_tables", "a40_diagnostic_report",
]


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v if math.isinf(v) else float(f"{v:.9g}")
    return str(v) if hasattr(v, "isoformat") else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered([tuple(value(v) for v in r) for r in df.select(*columns).collect()])
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    want = ordered([tuple(value(r[names.index(c)]) for c in columns) for r in cur.fetchall()])
    assert got == want


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
