"""Queries over diagnostics and the saved tables of a run, compared by content, with DuckDB SQL written separately."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.operators import audit as A
from barlab.operators import catalog as K
from barlab.operators import experiment as N
from barlab.operators import portfolio as P
from barlab.operators import reports as R
from barlab.operators import stats as S_
from barlab.operators import tables as T
from barlab.operators.equity import period_returns, period_statistics
from barlab.plans import catalog_queries as C
from barlab.plans.audit_queries import _CURVE, _GRID, _PERIODS, _grid, curve
from barlab.plans.feature_queries import LIMIT, WEEK
from barlab.plans.report_queries import _EXPOSURE, exposed, filtered
from barlab.plans.trade_queries import EXPECTANCY, STATS, TRADES, outcomes, stats_sql, trend_signals, with_fractions

Q: dict = {}
S: dict = {}


def add(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


def _after(sql: str, prefix: str) -> str:
    """The CTEs that follow a common beginning."""
    if not sql.startswith(prefix):
        raise ValueError("the SQL doesn't begin with the common part")
    return sql[len(prefix) + 2 :]


_HEALTH = {
    "data_coverage": ("coverage", "CASE WHEN coverage < 0.95 THEN 2 WHEN coverage < 0.98 THEN 1 ELSE 0 END"), "trade_sample": ("trade_count", "CASE WHEN trade_count <= 0 THEN 2 WHEN trade_count < 30 THEN 1 ELSE 0 END"),
    "order_acceptance": ("acceptance_rate", "CASE WHEN acceptance_rate < 0.2 THEN 1 ELSE 0 END"), "strategy_filter": ("filter_rate", "CASE WHEN filter_rate >= 0.6 THEN 1 ELSE 0 END"),
    "drawdown_pressure": ("max_drawdown", "CASE WHEN max_drawdown <= -0.35 THEN 2 WHEN max_drawdown <= -0.2 THEN 1 ELSE 0 END"), "profit_quality": ("profit_factor", "CASE WHEN profit_factor < 1 THEN 2 WHEN profit_factor < 1.2 THEN 1 ELSE 0 END"),
    "win_rate_edge": ("win_rate_edge", "CASE WHEN win_rate_edge < 0 THEN 2 WHEN win_rate_edge < 0.03 THEN 1 ELSE 0 END"), "positive_expectancy": ("chance", "CASE WHEN chance < 0.5 THEN 2 WHEN chance < 0.75 THEN 1 ELSE 0 END"),
    "exit_structure": ("exit_share", "CASE WHEN exit_share >= 0.5 THEN 1 ELSE 0 END"), "monthly_stability": ("worst_month", "CASE WHEN worst_month <= -0.2 THEN 2 WHEN worst_month <= -0.1 THEN 1 ELSE 0 END"),
    "path_risk": ("avg_mae_r", "CASE WHEN avg_mae_r <= -1.2 THEN 2 WHEN avg_mae_r <= -0.8 THEN 1 ELSE 0 END"), "capital_exposure": ("margin", "CASE WHEN margin >= 1.5 THEN 2 WHEN margin > 1 THEN 1 ELSE 0 END"),
}
_DIAG = f"""{TRADES}, {stats_sql('stock_code')}, {_after(_PERIODS, WEEK)}, {_after(_EXPOSURE, _CURVE)}, {_after(_GRID, WEEK).split(',' + chr(10) + 'isl AS')[0]},
xr AS (SELECT stock_code, exit_reason, count(*) / sum(count(*)) OVER (PARTITION BY stock_code) AS share, row_number() OVER (PARTITION BY stock_code ORDER BY count(*) DESC, list_position(['stop_loss', 'take_profit', 'trailing_take_profit', 'max_holding', 'end_of_data'], exit_reason)) AS k FROM trades GROUP BY stock_code, exit_reason),
hs AS (SELECT stat.*, {EXPECTANCY} AS chance, (SELECT count(*) FILTER (here) / count(*) FROM ex WHERE ex.stock_code = stat.stock_code) AS coverage, (SELECT count(*) FILTER (reason = '') / count(*) FROM m WHERE m.stock_code = stat.stock_code) AS acceptance_rate,
  (SELECT count(*) FILTER (direction <> 'long') / count(*) FROM events_ e WHERE e.stock_code = stat.stock_code) AS filter_rate, (SELECT min(ret) FROM pr WHERE pr.case_id = stat.stock_code) AS worst_month, (SELECT max_margin_exposure FROM es WHERE es.case_id = stat.stock_code) AS margin,
  (SELECT CASE WHEN exit_reason IN ('stop_loss', 'max_holding') THEN share ELSE 0 END FROM xr WHERE xr.stock_code = stat.stock_code AND k = 1) AS exit_share FROM stat),
dg AS ({' UNION ALL '.join(f'''SELECT stock_code, '{name}' AS "check", {k} AS place, CAST({value} AS DOUBLE) AS value, {sev} AS sev FROM hs''' for k, (name, (value, sev)) in enumerate(_HEALTH.items()))})"""


def diagnosed(spark, d) -> DataFrame:
    """All twelve checks of every symbol that trades."""
    seen = trend_signals(spark, d)
    bars, key = seen[0], ["stock_code"]
    m, t = outcomes(spark, d, seen=seen)
    t = T.written(t.drop("metadata"))
    orders = m.groupBy(*key).agg(F.count("*").alias("order_count"), (F.count_if(F.col("reason") == "") / F.count("*")).alias("acceptance_rate"))
    filters = filtered(spark, d, seen=seen).groupBy(*key).agg((F.count_if(F.col("status") == "rejected") / F.count("*")).alias("strategy_filter_rejection_rate"))
    by_case = lambda df, c, name: df.select(F.col("case_id").alias("stock_code"), F.col(c).alias(name))
    months = by_case(period_statistics(period_returns(T.written(curve(spark, d, bars)))), "period_worst_return", "monthly_worst_return")
    margin = by_case(R.equity_exposure(exposed(spark, d, bars)), "max_margin_exposure", "max_margin_exposure")
    exits = S_.exit_reason_summary(t, key).select(*key, "primary_exit_reason", "primary_exit_reason_rate")
    covered = A.coverage(*_grid(spark, d, bars)).select(*key, F.col("coverage_ratio").alias("data_weighted_coverage_ratio"))
    s = T.written(S_.trade_statistics(t, key, wanted=[r[1] for r in P.RULES if r[1] in STATS]))
    for more in (orders, filters, months, margin, exits, covered):
        s = s.join(more, key, "left")
    return T.written(P.diagnostics(s, "stock_code"))


@add("a40_diagnostic_report", f"{_DIAG} SELECT stock_code, \"check\", round(value, 6) AS value, CASE sev WHEN 2 THEN 'fail' WHEN 1 THEN 'attention' ELSE 'pass' END AS status FROM dg")
def _(spark, d):
    return diagnosed(spark, d).select("stock_code", "check", F.round("value", 6).alias("value"), "status")


@add("a41_diagnostic_summary", f"{_DIAG} SELECT stock_code, count(*) FILTER (sev = 2) AS failed, count(*) FILTER (sev = 1) AS attention, CAST(max(sev) AS BIGINT) AS max_severity, arg_min(\"check\", (-sev, \"check\")) AS primary_issue FROM dg GROUP BY stock_code")
def _(spark, d):
    r = P.diagnostic_summary(diagnosed(spark, d), "stock_code")
    return r.select("stock_code", "failed", "attention", F.col("max_severity").cast("long").alias("max_severity"), "primary_issue")


_EVIDENCE = " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in R.ACTIONS.items())


@add("a42_action_plan", f"""{_DIAG}, ac AS (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY sev DESC, place) AS priority FROM dg WHERE sev > 0) SELECT stock_code, priority, "check", CASE "check" {_EVIDENCE} END AS evidence FROM ac""")
def _(spark, d):
    p = R.action_plan(diagnosed(spark, d), "stock_code", P.CHECKS)
    return p.select("stock_code", F.col("priority").cast("long").alias("priority"), "check", "evidence")


def long_form(name: str, df: DataFrame, keys: list[str], numbers: list[str], texts: list[str] = ()) -> DataFrame:
    """A table as (table, key, metric, number, text), to compare tables of different columns in one result."""
    cell = lambda c, n, t: F.struct(F.lit(c).alias("metric"), n.cast("double").alias("number"), t.cast("string").alias("text"))
    none = F.lit(None)
    cells = [cell(c, F.round(F.col(c).cast("double"), 6), none) for c in numbers] + [cell(c, none, F.col(c)) for c in texts]
    key: Column = F.concat_ws("|", *(F.col(k).cast("string") for k in keys)) if keys else F.lit("")
    return df.select(F.lit(name).alias("table"), key.alias("key"), F.explode(F.array(*cells)).alias("x")).select("table", "key", "x.*")


def long_sql(name: str, source: str, key: str, numbers: dict[str, str], texts: dict[str, str] = {}) -> str:
    names = ", ".join(f"'{n}'" for n in [*numbers, *texts])
    values = ", ".join([f"CAST(round({x}, 6) AS DOUBLE)" for x in numbers.values()] + ["CAST(NULL AS DOUBLE)" for _ in texts])
    words = ", ".join(["CAST(NULL AS VARCHAR)" for _ in numbers] + [f"CAST({x} AS VARCHAR)" for x in texts.values()])
    return f"""SELECT '{name}' AS "table", {key} AS key, unnest([{names}]) AS metric, unnest([{values}]) AS number, unnest([{words}]) AS text FROM {source}"""


same = lambda names: {n: n for n in names}
_DECIDED = {"decision_count": "n", "decision_rate": "n / sum(n) OVER ()", "group_decision_rate": "n / sum(n) OVER (PARTITION BY {})"}


def _decided_sql(name: str, source: str, keys: list[str]) -> str:
    group = ", ".join(keys)
    return long_sql(name, f"(SELECT {group}, status, reason, count(*) AS n FROM {source} GROUP BY ALL) y", " || '|' || ".join([*keys, "status", "reason"]), {k: v.format(group) for k, v in _DECIDED.items()})


_joined = lambda columns: " || '|' || ".join("'signal_bar_stop'" if c == "strategy_name" else c for c in columns) or "''"
_SETS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS breakdown, {_joined(s)} AS key, * FROM trades" for n, s in N.SETS.items())
_BUCKETS = {
    "holding_bars": "CASE WHEN x <= 1 THEN '1K' WHEN x <= 3 THEN '2-3K' WHEN x <= 8 THEN '4-8K' WHEN x <= 16 THEN '9-16K' ELSE '17K+' END", "r_multiple": "CASE WHEN x <= -1 THEN '<=-1R' WHEN x < 0 THEN '-1R~0R' WHEN x < 1 THEN '0R~1R' WHEN x < 2 THEN '1R~2R' ELSE '>=2R' END",
    "mae_r": "CASE WHEN x <= -1 THEN '<=-1R' WHEN x <= -0.5 THEN '-1R~-0.5R' WHEN x < 0 THEN '-0.5R~0R' ELSE '0R' END", "mfe_r": "CASE WHEN x <= 0 THEN '0R' WHEN x < 0.5 THEN '0R~0.5R' WHEN x < 1 THEN '0.5R~1R' WHEN x < 2 THEN '1R~2R' ELSE '>=2R' END",
}
_RUN = f"""{TRADES}, tx AS ({_SETS_SQL}), {stats_sql('breakdown, key').replace('FROM trades)', 'FROM tx)')}, bs AS (SELECT *, {EXPECTANCY} AS positive_expectancy_probability FROM stat),
rc AS (SELECT CAST(0 AS BIGINT) AS trade_no, min(exit_date) AS date, CAST(1 AS DOUBLE) AS net_value FROM trades UNION ALL SELECT seq, exit_date, equity FROM s2 WHERE breakdown = 'stats'),
{_after(_PERIODS, WEEK).replace(_after(_CURVE, WEEK), "cu AS (SELECT 'run' AS case_id, date, max_by(net_value, trade_no) AS net_value, max_by(net_value, trade_no) AS adv FROM rc GROUP BY date)")},
ep AS (SELECT *, sum(CAST(drawdown >= 0 AS INT)) OVER (ORDER BY date, step) AS e FROM dd), eg AS (SELECT e, min(drawdown) AS depth, count(*) FILTER (drawdown < 0) AS points, min(date) AS peak_date FROM ep GROUP BY e HAVING min(drawdown) < 0),
md AS (SELECT *, 'signal_bar_stop' AS strategy_name, CASE WHEN reason = '' THEN 'accepted' ELSE 'rejected' END AS status FROM m), fl AS (SELECT 'signal_bar_stop' AS strategy_name, 'signal_bar_adapter' AS filter_name, '' AS context_timeframe, detector_name, event_type, direction AS side, 'signal_bar_stop:' || event_id AS order_id,
  CASE WHEN direction = 'long' THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN direction = 'long' THEN '' ELSE 'side_mode_filtered' END AS reason FROM events_)"""
_DIST = ["trade_count", "win_rate", "avg_return", "avg_r_multiple", "avg_mae_r", "avg_mfe_r", "avg_holding_bars"]
_DIST_SQL = " UNION ALL ".join(f"SELECT '{k}' AS dimension, {v} AS bucket, count(*) AS trade_count, avg(CAST(return_pct > 0 AS INT)) AS win_rate, avg(return_pct / 100) AS avg_return, avg(r_multiple) AS avg_r_multiple, avg(mae_r) AS avg_mae_r, avg(mfe_r) AS avg_mfe_r, avg(holding_bars) AS avg_holding_bars FROM (SELECT *, round({k}, 9) AS x FROM trades) GROUP BY ALL" for k, v in _BUCKETS.items())
_MONTH = {"observation_count": "observation_count", "start_net_value": "start_net_value", "end_net_value": "end_net_value", "return": "CASE WHEN start_net_value > 0 THEN ret ELSE 0 END", "max_drawdown": "max_drawdown"}
_TRADE = ["entry_price", "exit_price", "holding_bars", "return_pct", "r_multiple", "mae_pct", "mfe_pct"]
_TABLES = [
    long_sql("trades", "trades", "order_id", same(_TRADE) | {"entry_price": "fill"}, {"exit_reason": "exit_reason"}), long_sql("order_decisions", "md", "order_id", {}, {"status": "status", "reason": "reason"}), long_sql("filter_decisions", "fl", "order_id", {}, {"status": "status", "reason": "reason"}),
    long_sql("equity_curve", "rc", "CAST(trade_no AS VARCHAR)", {"net_value": "net_value"}), long_sql("drawdown_episodes", "(SELECT *, row_number() OVER (ORDER BY depth, peak_date) AS rank FROM eg) y", "CAST(rank AS VARCHAR)", same(["depth", "points"])), long_sql("monthly_returns", "pr", "CAST(period AS VARCHAR)", _MONTH),
    *(long_sql(n, f"(SELECT * FROM bs WHERE breakdown = '{n}') y", "key", same(STATS)) for n in N.SETS), long_sql("trade_path_distribution", f"({_DIST_SQL}) y", "dimension || '|' || bucket", same(_DIST)),
    _decided_sql("order_decision_stats", "md", ["strategy_name", "detector_name"]), _decided_sql("setup_order_decision_stats", "md", ["detector_name", "event_type", "side"]), _decided_sql("strategy_filter_stats", "fl", ["strategy_name", "filter_name", "context_timeframe"]),
    _decided_sql("setup_filter_stats", "fl", ["detector_name", "event_type", "side", "filter_name"]),
]


def run_tables(spark, d) -> dict[str, DataFrame]:
    seen = trend_signals(spark, d)
    m, t = outcomes(spark, d, seen=seen)
    return N.run_tables(m.drop("metadata"), filtered(spark, d, seen=seen), with_fractions(t).drop("metadata"))


@add("p11_experiment_tables", f"{_RUN} {' UNION ALL '.join(_TABLES)}")
def _(spark, d):
    folder = f"{T.shared_folder(spark)}/run-{uuid.uuid4().hex}"
    T.save_tables({n: x for n, x in run_tables(spark, d).items() if n != "diagnostics"}, folder)
    got = lambda n: spark.read.parquet(f"{folder}/{n}")
    decided = ["decision_count", "decision_rate", "group_decision_rate"]
    out = [
        long_form("trades", got("trades"), ["order_id"], _TRADE, ["exit_reason"]), long_form("order_decisions", got("order_decisions"), ["order_id"], [], ["status", "reason"]), long_form("filter_decisions", got("filter_decisions"), ["order_id"], [], ["status", "reason"]),
        long_form("equity_curve", got("equity_curve"), ["trade_no"], ["net_value"]), long_form("drawdown_episodes", got("drawdown_episodes"), ["rank"], ["depth", "points"]), long_form("monthly_returns", got("monthly_returns"), ["period"], list(_MONTH)),
        *(long_form(n, got(n), list(s), STATS) for n, s in N.SETS.items()), long_form("trade_path_distribution", got("trade_path_distribution"), ["dimension", "bucket"], _DIST),
        *(long_form(n, got(n), [*k, "status", "reason"], decided) for n, k in (("order_decision_stats", ["strategy_name", "detector_name"]), ("setup_order_decision_stats", ["detector_name", "event_type", "side"]))),
        *(long_form(n, got(n), [*k, "status", "reason"], decided) for n, k in (("strategy_filter_stats", ["strategy_name", "filter_name", "context_timeframe"]), ("setup_filter_stats", ["detector_name", "event_type", "side", "filter_name"]))),
    ]
    return R.union_frames(out, ["table", "key", "metric", "number", "text"])


def saved_data(spark, d) -> tuple[str, DataFrame]:
    """The data side of a run, saved: folder and index."""
    mk = T.written(C.market(spark, d))
    day = C.days_of(mk)
    audit = T.written(K.audit_market(mk))
    days = A.calendar(mk.select("timeframe", F.col("date").alias("at")), ["timeframe"])
    gaps = A.gap_episodes(K.B.drop_illiquid(mk).withColumnRenamed("date", "at"), days, K.KEYS, ["timeframe"])
    tables = {"data_coverage": audit, "data_gap_episodes": gaps, "data_inventory": C.inventory(spark, d, mk), "limit_filter_audit": A.limit_filter_audit(C.symbols(spark, d, day), day, K.B.limit_open_dates(day))}
    folder = f"{T.shared_folder(spark)}/data-{uuid.uuid4().hex}"
    return folder, T.save_tables(tables, folder)


_DATA = f"""{C._MK}, {C.health_sql('mk')}, {LIMIT.replace('FROM bars)', 'FROM dayb)')}, la AS (SELECT sym.stock_code, CASE WHEN sym.stock_code = '999999.SH' THEN 'daily_missing' ELSE 'ok' END AS status, (SELECT count(*) FROM dayb b WHERE b.stock_code = sym.stock_code) AS daily_rows,
  (SELECT count(*) FROM blocked b WHERE b.stock_code = sym.stock_code) AS filtered_days FROM sym)"""
_COVERED = ["row_count", "duplicate_count", "invalid_date_count", "zero_volume_count", "expected_count", "actual_count", "coverage_ratio", "max_gap", "max_gap_minutes", "gap_count"]


@add("p11_experiment_data_tables", f"{_DATA} " + " UNION ALL ".join([
    long_sql("data_coverage", "au", "stock_code || '|' || timeframe", same(_COVERED), {"status": "status", "max_gap_start": "max_gap_start", "max_gap_end": "max_gap_end"}), long_sql("data_gap_episodes", "gp", "stock_code || '|' || timeframe || '|' || CAST(gap_start AS VARCHAR)", {"missing_count": "n"}, {"gap_end": "gap_end"}),
    long_sql("data_inventory", "inv", "stock_code || '|' || timeframe", {"rows": "rows"}, {"status": "status", "start": "start", "end": '"end"'}), long_sql("limit_filter_audit", "la", "stock_code", same(["daily_rows", "filtered_days"]), {"status": "status"}),
]))
def _(spark, d):
    folder, _ = saved_data(spark, d)
    got = lambda n: spark.read.parquet(f"{folder}/{n}")
    out = [
        long_form("data_coverage", got("data_coverage"), K.KEYS, _COVERED, ["status", "max_gap_start", "max_gap_end"]), long_form("data_gap_episodes", got("data_gap_episodes"), [*K.KEYS, "gap_start"], ["missing_count"], ["gap_end"]),
        long_form("data_inventory", got("data_inventory"), K.KEYS, ["rows"], ["status", "start", "end"]), long_form("limit_filter_audit", got("limit_filter_audit"), ["stock_code"], ["daily_rows", "filtered_days"], ["status"]),
    ]
    return R.union_frames(out, ["table", "key", "metric", "number", "text"])


_INDEX = ", ".join(f"('{n}', '{T.CATEGORIES[n][0]}', {T.CATEGORIES[n][1]})" for n in ("data_coverage", "data_gap_episodes", "data_inventory", "limit_filter_audit"))
_ROWS = 'CASE "table" WHEN \'data_coverage\' THEN (SELECT count(*) FROM au) WHEN \'data_gap_episodes\' THEN (SELECT count(*) FROM gp) WHEN \'data_inventory\' THEN (SELECT count(*) FROM inv) ELSE (SELECT count(*) FROM la) END'


@add("s20_saved_run", f'{_DATA} SELECT "table", category, priority, {_ROWS} AS rows FROM (VALUES {_INDEX}) v("table", category, priority)')
def _(spark, d):
    return saved_data(spark, d)[1].select("table", "category", "priority", "rows")


@add("s25_artifact_index", f'{_DATA} SELECT "table", category, priority, {_ROWS} AS rows FROM (VALUES {_INDEX}) v("table", category, priority) WHERE category = \'data\' AND priority <= 4')
def _(spark, d):
    return T.artifact_index(saved_data(spark, d)[1], "data", 4).select("table", "category", "priority", "rows")
