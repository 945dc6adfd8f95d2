"""Queries over exposure, funnels, case-keyed sweeps, run tables and chart frames, with DuckDB SQL written separately."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barlab.functions import labels as L
from barlab.operators import bars as B
from barlab.operators import detectors as D
from barlab.operators import execution as E
from barlab.operators import orders as O
from barlab.operators import passages as X
from barlab.operators import portfolio as P
from barlab.operators import reports as R
from barlab.operators import stats as S_
from barlab.operators import sweep as W
from barlab.operators import tables as T
from barlab.operators.equity import drawdown_statistics, period_returns, return_statistics
from barlab.plans.audit_queries import _CURVE, _DIRTY, _PATH, _PERIODS, _RANKED, _RSTAT, curve, dirty, sweep_table
from barlab.plans.feature_queries import TREND_EVENTS, WEEK, rounded, rsql
from barlab.plans.inputs import table, week_bars
from barlab.plans.trade_queries import EXPECTANCY, ORDERS, STATS, TRADES, _match, _sim, outcomes, stats_sql, trend_orders, trend_signals, with_fractions

Q: dict = {}
S: dict = {}


def add(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


@add("c10_reason_label", f"{ORDERS}, {_match()} SELECT order_id, CASE reason WHEN '' THEN '' WHEN 'no_fill' THEN '未成交（no_fill）' WHEN 'no_liquidity' THEN '无有效成交区间（no_liquidity）' WHEN 'target_not_favorable' THEN '目标价无效（target_not_favorable）' WHEN 'invalid_order' THEN '订单字段无效（invalid_order）' ELSE reason END AS label FROM m")
def _(spark, d):
    return outcomes(spark, d)[0].select("order_id", L.label_with_code(F.col("reason")).alias("label"))


@add("c19_parameter_value_label", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS label FROM part")
def _(spark, d):
    x = F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string")).when(F.col("p_size") % 5 == 0, "NaN").otherwise(F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", T.value_label(x).alias("label"))


@add("c22_order_sector", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN trim(o_orderpriority) WHEN o_custkey % 3 = 0 THEN 'mapped' ELSE 'unknown' END AS sector FROM orders")
def _(spark, d):
    own, mapped = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), "o_orderpriority")).when(F.col("o_orderstatus") == "O", "unknown"), F.when(F.col("o_custkey") % 3 == 0, " mapped ")
    return table(spark, d, "orders").select("o_orderkey", R.sector_of(own, mapped).alias("sector"))


@add("c17_case_config_hash", """SELECT s_suppkey AS name, sha256(concat_ws(',', '{"detector":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'trend' ELSE 'range' END || '"}', CASE WHEN s_suppkey % 2 = 1 THEN '{"range_lookback":' || s_nationkey || '}' END, '{"risk_reward":' || s_suppkey % 5 || '}',
  CASE WHEN s_suppkey % 2 = 0 THEN '{"trend_lookback":' || s_nationkey || '}' END)) AS case_config_hash FROM supplier""")
def _(spark, d):
    c = cases_of_suppliers(spark, d)
    return c.select("name", T.case_config_hash(c).alias("case_config_hash"))


def cases_of_suppliers(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "trend").otherwise("range").alias("detector"), F.col("s_nationkey").alias("range_lookback"), (F.col("s_suppkey") % 5).alias("risk_reward"), F.col("s_nationkey").alias("trend_lookback"))


@add("s22_case_records", "SELECT s_suppkey AS name, s_suppkey % 5 AS risk_reward FROM supplier")
def _(spark, d):
    path = f"{T.shared_folder(spark)}/cases-{uuid.uuid4().hex}"
    T.write_cases(cases_of_suppliers(spark, d), path)
    return spark.read.schema("name long, risk_reward long").json(path)


@add("f04_liquid_mask", f"{_DIRTY} SELECT stock_code, date, coalesce(volume > 0, false) AND coalesce(amount > 0, false) AS liquid FROM dirty")
def _(spark, d):
    return dirty(spark, d).select("stock_code", "date", B.liquid().alias("liquid"))


@add("f10_entry_constraints", f"""{ORDERS}, {_match()} SELECT order_id, CASE WHEN reason NOT IN ('', 'target_not_favorable') THEN reason WHEN abs(fill - stop_price) / fill > 0.05 THEN 'actual_risk_too_high' WHEN abs(fill - signal_price) / signal_price > 0.002 THEN 'chase_too_far' ELSE reason END AS reason FROM m""")
def _(spark, d):
    bars, o = trend_orders(spark, d)
    capped = o.withColumns({"max_actual_risk_pct": F.lit(0.05), "max_chase_pct": F.lit(0.002)})
    return E.match_entries(bars, capped).select("order_id", "reason")


_EXP = ["exposure_bars", "return_contribution", "capital_turnover", "avg_capital_fraction", "max_capital_fraction", "margin_turnover", "avg_margin_fraction", "max_margin_fraction", "capital_exposure_bars", "margin_exposure_bars"]
_EXP += ["avg_capital_exposure_per_trade", "avg_margin_exposure_per_trade", "capital_weighted_raw_return", "return_per_exposure_bar", "return_per_capital_exposure_bar", "return_per_margin_exposure_bar"]


@add("a22_trade_exposure", f"{TRADES}, {stats_sql('event_type')} SELECT event_type, {rsql(_EXP)} FROM stat")
def _(spark, d):
    return rounded(S_.trade_exposure(with_fractions(outcomes(spark, d)[1]), ["event_type"]), ["event_type"], _EXP)


_EQX = [f"{a}_{n}" for n in ("gross_exposure", "margin_exposure", "open_positions", "cash_ratio", "net_exposure") for a in ("avg", "max")] + ["exposure_bar_ratio", "min_cash_ratio", "min_net_exposure"]
_EXPOSED = f"{_CURVE}, ec AS (SELECT *, abs(net_value - 1) AS gross_exposure, abs(net_value - 1) * 1.2 AS margin_exposure, CASE WHEN net_value > 1.1 THEN 2 WHEN net_value > 1 THEN 1 ELSE 0 END AS open_positions, 1 - adv / 2 AS cash, adv / 2 AS position_value FROM cu)"


def exposed(spark, d, bars=None):
    n, a = F.col("net_value"), F.col("drawdown_net_value")
    return curve(spark, d, bars).withColumns({"gross_exposure": F.abs(n - 1), "margin_exposure": F.abs(n - 1) * 1.2, "open_positions": F.when(n > 1.1, 2).when(n > 1, 1).otherwise(0), "cash": 1 - a / 2, "position_value": a / 2})


_EXPOSURE = f"""{_EXPOSED}, es AS (SELECT case_id, avg(gross_exposure) AS avg_gross_exposure, max(gross_exposure) AS max_gross_exposure, avg(margin_exposure) AS avg_margin_exposure, max(margin_exposure) AS max_margin_exposure, avg(open_positions) AS avg_open_positions, CAST(max(open_positions) AS DOUBLE) AS max_open_positions,
  avg(cash / net_value) AS avg_cash_ratio, max(cash / net_value) AS max_cash_ratio, avg(position_value / net_value) AS avg_net_exposure, max(position_value / net_value) AS max_net_exposure, avg(CAST(gross_exposure > 0 AS INT)) AS exposure_bar_ratio, min(cash / net_value) AS min_cash_ratio, min(position_value / net_value) AS min_net_exposure FROM ec GROUP BY case_id)"""


@add("a29_equity_exposure", f"{_EXPOSURE} SELECT case_id, {rsql(_EQX)} FROM es")
def _(spark, d):
    return rounded(R.equity_exposure(exposed(spark, d)), ["case_id"], _EQX)


@add("a27_equity_statistics", f"""{_PATH}, {_RSTAT}, {_EXPOSURE[len(_CURVE) + 2:]}, ul AS (SELECT case_id, min(x) AS max_drawdown, sqrt(avg(x * x)) AS ulcer_index FROM (SELECT case_id, date, min(drawdown) AS x FROM dd GROUP BY case_id, date) GROUP BY case_id)
SELECT case_id, {rsql(['total_return', 'equity_return_std', 'max_drawdown', 'ulcer_index', 'avg_gross_exposure', 'avg_cash_ratio'])} FROM rs JOIN ul USING (case_id) JOIN es USING (case_id)""")
def _(spark, d):
    c = T.written(exposed(spark, d))
    s = return_statistics(c).join(drawdown_statistics(c), "case_id").join(R.equity_exposure(c), "case_id")
    return rounded(s, ["case_id"], ["total_return", "equity_return_std", "max_drawdown", "ulcer_index", "avg_gross_exposure", "avg_cash_ratio"])


def decided(spark, d):
    """Matched orders as decisions; what was not filled has no executed price."""
    m, ok = outcomes(spark, d)[0], F.col("reason") == ""
    part = F.when(ok, 0.1 + 0.01 * (F.col("signal_bar_index") % 7))
    return m.withColumns({"status": F.when(ok, "accepted").otherwise("rejected"), "actual_entry_price": F.when(ok, F.col("actual_entry_price")), "capital_fraction": part, "risk_fraction": part / 10, "margin_fraction": part * 1.5})


_FUN = ["avg_accepted_capital_fraction", "max_accepted_capital_fraction", "avg_accepted_risk_fraction", "max_accepted_risk_fraction", "avg_accepted_margin_fraction", "max_accepted_margin_fraction", "avg_accepted_actual_risk_pct", "max_accepted_actual_risk_pct", "avg_accepted_actual_chase_pct", "max_accepted_actual_chase_pct"]
_FUN += ["avg_accepted_actual_reward_to_risk", "min_accepted_actual_reward_to_risk", "avg_executed_actual_risk_pct", "min_executed_actual_reward_to_risk", "acceptance_rate", "rejection_rate", "primary_rejected_reason_rate"]
_FUNC = ["order_count", "accepted_order_count", "rejected_order_count", "executed_order_count", "accepted_executed_order_count", "primary_rejected_reason_count", *(f"rejected_{r}_count" for r in R.ORDER_REASONS)]
_DEC = f"""{ORDERS}, {_match()}, dc AS (SELECT *, reason = '' AS ok, 1e-1 + 1e-2 * (signal_bar_index % 7) AS part, abs(fill - stop_price) / fill AS risk_, abs(fill - signal_price) / signal_price AS chase_, dir * (target_price - fill) / abs(fill - stop_price) AS rr_ FROM m),
pr AS (SELECT event_type, reason, n, sum(n) OVER (PARTITION BY event_type) AS t, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, reason) AS k FROM (SELECT event_type, reason, count(*) AS n FROM dc WHERE NOT ok GROUP BY event_type, reason))"""


@add("a25_order_funnel", f"""{_DEC}, fs AS (SELECT event_type, count(*) AS order_count, count(*) FILTER (ok) AS accepted_order_count, count(*) FILTER (NOT ok) AS rejected_order_count, count(*) FILTER (ok) AS executed_order_count, count(*) FILTER (ok) AS accepted_executed_order_count,
  {', '.join(f"count(*) FILTER (NOT ok AND reason = '{r}') AS rejected_{r}_count" for r in R.ORDER_REASONS)}, avg(part) FILTER (ok) AS avg_accepted_capital_fraction, max(part) FILTER (ok) AS max_accepted_capital_fraction, avg(part / 10) FILTER (ok) AS avg_accepted_risk_fraction, max(part / 10) FILTER (ok) AS max_accepted_risk_fraction,
  avg(part * 15e-1) FILTER (ok) AS avg_accepted_margin_fraction, max(part * 15e-1) FILTER (ok) AS max_accepted_margin_fraction, avg(risk_) FILTER (ok) AS avg_accepted_actual_risk_pct, max(risk_) FILTER (ok) AS max_accepted_actual_risk_pct, avg(chase_) FILTER (ok) AS avg_accepted_actual_chase_pct, max(chase_) FILTER (ok) AS max_accepted_actual_chase_pct,
  avg(rr_) FILTER (ok) AS avg_accepted_actual_reward_to_risk, min(rr_) FILTER (ok) AS min_accepted_actual_reward_to_risk, avg(risk_) FILTER (ok) AS avg_executed_actual_risk_pct, min(rr_) FILTER (ok) AS min_executed_actual_reward_to_risk, avg(CAST(ok AS INT)) AS acceptance_rate, avg(CAST(NOT ok AS INT)) AS rejection_rate FROM dc GROUP BY event_type)
SELECT fs.event_type, coalesce(pr.reason, '') AS primary_rejected_reason, coalesce(pr.n, 0) AS primary_rejected_reason_count, {', '.join(c for c in _FUNC if c != 'primary_rejected_reason_count')}, {', '.join(f'round(coalesce({c}, 0), 6) AS {c}' for c in _FUN[:-1])}, round(coalesce(pr.n / pr.t, 0), 6) AS primary_rejected_reason_rate
FROM fs LEFT JOIN pr ON pr.event_type = fs.event_type AND pr.k = 1""")
def _(spark, d):
    return rounded(R.order_funnel(decided(spark, d), ["event_type"]), ["event_type", "primary_rejected_reason", *_FUNC], _FUN)


@add("a25_reason_counters", f"{_DEC} SELECT 'rejected_' || reason || '_count' AS name, count(*) AS count FROM dc WHERE NOT ok GROUP BY reason")
def _(spark, d):
    return R.reason_counters(decided(spark, d))


@add("a26_filter_funnel", f"""{TREND_EVENTS} SELECT event_type, count(*) AS strategy_signal_count, count(*) FILTER (direction = 'long') AS strategy_accepted_signal_count, count(*) FILTER (direction <> 'long') AS strategy_rejected_signal_count, round(avg(CAST(direction = 'long' AS INT)), 6) AS strategy_filter_acceptance_rate,
  CASE WHEN count(*) FILTER (direction <> 'long') > 0 THEN 'side_mode_filtered' ELSE '' END AS primary_strategy_rejected_reason, 0 AS strategy_rejected_signal_bar_no_liquidity_count FROM events_ GROUP BY event_type""")
def _(spark, d):
    f = R.filter_funnel(filtered(spark, d), ["event_type"])
    return rounded(f, ["event_type", "strategy_signal_count", "strategy_accepted_signal_count", "strategy_rejected_signal_count", "primary_strategy_rejected_reason", "strategy_rejected_signal_bar_no_liquidity_count"], ["strategy_filter_acceptance_rate"])


def filtered(spark, d, mode: str = "long_only", seen=None):
    (bars, events), c = seen or trend_signals(spark, d), O.SignalBarStop(side_mode=mode)
    return O.signal_decisions(O.judge_signals(events, bars, c), c)


@add("u03_filter_logs", f"{TREND_EVENTS}, one AS (SELECT direction FROM events_) SELECT side, status, count(*) AS n FROM (SELECT direction AS side, CASE WHEN direction = 'long' THEN 'accepted' ELSE 'rejected' END AS status FROM one UNION ALL SELECT direction, CASE WHEN direction = 'short' THEN 'accepted' ELSE 'rejected' END FROM one) GROUP BY side, status")
def _(spark, d):
    both = R.union_frames([filtered(spark, d), filtered(spark, d, "short_only").drop("reason")], ["order_id", "side", "status", "reason"])
    return both.groupBy("side", "status").agg(F.count("*").alias("n"))


@add("u04_decision_records", f"{TRADES} SELECT m.order_id, CASE WHEN m.reason = '' THEN 'accepted' ELSE 'rejected' END AS status, m.reason, round(coalesce(trades.fill, m.entry_price), 6) AS entry_price, exit_reason, round(trades.return_pct, 6) AS return_pct FROM m LEFT JOIN trades ON trades.order_id = m.order_id")
def _(spark, d):
    return rounded(R.decision_records(*outcomes(spark, d)), ["order_id", "status", "reason", "exit_reason"], ["entry_price", "return_pct"])


@add("a44_order_funnel_stages", f"{_DEC} SELECT stage, n AS orders, round(n / (SELECT count(*) FROM dc), 6) AS share FROM (SELECT unnest(['all_orders', 'entry_triggered', 'filled', 'rejected']) AS stage, unnest([count(*), count(*) FILTER (ok), count(*) FILTER (ok), count(*) FILTER (NOT ok)]) AS n FROM dc)")
def _(spark, d):
    return rounded(R.funnel_stages(decided(spark, d)), ["stage", "orders"], ["share"])


@add("a44_reject_reasons", f"{_DEC} SELECT reason, count(*) AS orders, round(count(*) / sum(count(*)) OVER (), 6) AS share, row_number() OVER (ORDER BY count(*) DESC, CASE reason WHEN 'no_fill' THEN 10 WHEN 'no_liquidity' THEN 20 WHEN 'target_not_favorable' THEN 110 WHEN 'invalid_order' THEN 120 ELSE 500 END) AS rank FROM dc WHERE NOT ok GROUP BY reason")
def _(spark, d):
    r = R.reject_reasons(decided(spark, d)).withColumn("rank", F.col("rank").cast("long"))
    return rounded(r, ["reason", "orders", "rank"], ["share"])


_GRID = {"risk_reward": [1.5, 3.0], "max_holding_bars": [4, 12], "strong_close_pos": [0.65, 0.8]}
_NEAR = f"{ORDERS.replace('confidence, volume, amount FROM ev1', 'confidence, volume, amount, close_pos FROM ev1').replace(', ord AS (', ', ord_ AS (')}"
_CASES = f"""{_NEAR}, cases AS (SELECT 'rr' || rr || '-hold' || hold || '-close' || strong AS case_name, rr, hold, strong, weak FROM (SELECT unnest([1.5, 3.0]) AS rr), (SELECT unnest([4, 12]) AS hold), (SELECT unnest([65e-2, 8e-1]) AS strong, unnest([35e-2, CAST('{1 - 0.8!r}' AS DOUBLE)]) AS weak)),
ord AS (SELECT case_name || '/' || o.order_id AS order_id, o.* EXCLUDE (order_id, target_price), case_name, rr, hold, strong, entry_price + CASE side WHEN 'long' THEN 1 ELSE -1 END * abs(entry_price - stop_price) * rr AS target_price
  FROM ord_ o JOIN cases ON CASE side WHEN 'long' THEN close_pos >= strong ELSE close_pos <= weak END), {_match()}, {_sim().replace('m.entry_index + 12', 'm.entry_index + m.hold')}"""


def sweep_cases(spark):
    name = F.concat(F.lit("rr"), F.col("risk_reward").cast("string"), F.lit("-hold"), F.col("max_holding_bars").cast("string"), F.lit("-close"), F.col("strong_close_pos").cast("string"))
    return W.sweep_cases(spark, _GRID).drop("case_id").select(name.alias("case_name"), "risk_reward", F.col("max_holding_bars").cast("int").alias("max_holding_bars"), "strong_close_pos")


def sweep_trades(spark, d):
    bars, cases = T.written(B.with_bar_index(week_bars(spark, d))), sweep_cases(spark)
    orders_of = lambda strong_close_pos: O.generate_orders(O.judge_signals(D.detect_trend(bars, c=D.Trend(strong_close_pos=strong_close_pos)), bars))
    return X.sweep_trades(bars, X.sweep_orders(cases, ["strong_close_pos"], orders_of), cases, ["strong_close_pos"]), cases


_SW = ["trade_count", "win_rate", "total_return", "avg_return", "max_drawdown", "profit_factor", "avg_r_multiple"]


@add("p12_parameter_sweep", f"{_CASES}, {stats_sql('case_name')} SELECT case_name, {rsql(STATS)}, row_number() OVER (ORDER BY total_return DESC, max_drawdown DESC, trade_count DESC, case_name) AS sweep_rank FROM (SELECT *, {EXPECTANCY} AS positive_expectancy_probability FROM stat) y")
def _(spark, d):
    s = T.written(S_.trade_statistics(with_fractions(sweep_trades(spark, d)[0]), ["case_name"]))
    s = W.numbered(s, W.sweep_order(s.columns), "sweep_rank").withColumn("sweep_rank", F.col("sweep_rank").cast("long"))
    return rounded(s, ["case_name", "sweep_rank"], STATS)


@add("a37_case_setup_statistics", f"{_CASES}, {stats_sql('case_name, detector_name, event_type, side')} SELECT case_name, detector_name, event_type, side, {rsql(_SW)} FROM stat")
def _(spark, d):
    keys = ["case_name", "detector_name", "event_type", "side"]
    return rounded(S_.trade_statistics(sweep_trades(spark, d)[0], keys, wanted=_SW), keys, _SW)


@add("u02_case_frames", f"{_CASES}, {stats_sql('case_name, side')} SELECT case_name, 'side' AS dimension, side AS value, round(trade_count, 6) AS trade_count FROM stat UNION ALL SELECT case_name, 'exit_reason', exit_reason, CAST(count(*) AS DOUBLE) FROM trades GROUP BY case_name, exit_reason")
def _(spark, d):
    t = T.written(sweep_trades(spark, d)[0].select("case_name", "order_id", "side", "exit_reason", "return_pct"))
    frames = [S_.trade_statistics(t, ["case_name", c], wanted=["trade_count"]).select("case_name", F.lit(c).alias("dimension"), F.col(c).alias("value"), "trade_count") for c in ("side", "exit_reason")]
    return R.union_frames(frames, ["case_name", "dimension", "value", "trade_count"])


_PAR = ["win_rate", "avg_return", "max_drawdown", "profit_factor", "avg_r_multiple", "total_return", "trade_count", "breakeven_win_rate", "win_rate_edge", "return_per_exposure_bar", "avg_mae_r", "avg_mfe_r", "avg_holding_bars", "cvar_95"]


@add("a38_parameter_summary", f"""{_CASES}, {stats_sql('case_name')}, obj AS (SELECT *, EXISTS (SELECT 1 FROM stat b WHERE b.total_return >= a.total_return AND b.max_drawdown >= a.max_drawdown AND b.trade_count >= a.trade_count AND (b.total_return > a.total_return OR b.max_drawdown > a.max_drawdown OR b.trade_count > a.trade_count)) AS beaten FROM stat a),
lg AS (SELECT obj.*, unnest(['risk_reward', 'max_holding_bars', 'strong_close_pos']) AS parameter, unnest([CAST(CAST(rr AS DOUBLE) AS VARCHAR), CAST(hold AS VARCHAR), CAST(strong AS VARCHAR)]) AS value FROM obj JOIN cases USING (case_name))
SELECT parameter, value, count(*) AS cases, round(avg(CAST(NOT beaten AS INT)), 6) AS pareto_hit_rate, {', '.join(f'round(avg({m}), 6) AS avg_{m}, round(quantile_cont({m}, 0.5), 6) AS median_{m}, round(stddev_pop({m}), 6) AS std_{m}' for m in _PAR)}, max_by(case_name, (win_rate, case_name)) AS best_case FROM lg GROUP BY parameter, value""")
def _(spark, d):
    t, cases = sweep_trades(spark, d)
    s = T.written(S_.trade_statistics(t, ["case_name"]).join(cases, "case_name"))
    p = W.parameter_summary(W.pareto_ranks(s.select("case_name", *cases.columns[1:], *dict.fromkeys(_SW + _PAR))).withColumn("is_pareto_efficient", F.col("pareto_rank") == 1), list(_GRID), _PAR)
    return rounded(p, ["parameter", "value", "cases", "best_case"], ["pareto_hit_rate", *(f"{f}_{m}" for m in _PAR for f in ("avg", "median", "std"))])


@add("p05_strategy_backtest", f"{TRADES}, {stats_sql('detector_name')}, rj AS (SELECT detector_name, count(*) FILTER (reason <> '') AS rejected FROM m GROUP BY detector_name) SELECT detector_name, {rsql(_SW)}, rejected FROM stat JOIN rj USING (detector_name)")
def _(spark, d):
    m, t = outcomes(spark, d)
    rejected = m.groupBy("detector_name").agg(F.count_if(F.col("reason") != "").alias("rejected"))
    return rounded(S_.trade_statistics(t, ["detector_name"], wanted=_SW).join(rejected, "detector_name"), ["detector_name", "rejected"], _SW)


@add("s21_saved_sweep", f"""{_CASES} SELECT case_name, count(*) AS trades FROM trades GROUP BY case_name""")
def _(spark, d):
    folder = f"{T.shared_folder(spark)}/sweep-{uuid.uuid4().hex}"
    T.save_tables({"trades": sweep_trades(spark, d)[0].drop("metadata")}, folder, partition_by="case_name")
    return spark.read.parquet(f"{folder}/trades").groupBy("case_name").agg(F.count("*").alias("trades"))


@add("a36_symbol_statistics", f"{TRADES}, {stats_sql('stock_code')} SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SZ' AS stock_code, s_name AS stock_name, round(coalesce(trade_count, 0), 6) AS trade_count, round(coalesce(total_return, 0), 6) AS total_return FROM supplier LEFT JOIN stat ON stat.stock_code = lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SZ'")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit(".SZ")).alias("stock_code"), F.col("s_name").alias("stock_name"))
    out = S_.with_idle_keys(S_.trade_statistics(outcomes(spark, d)[1], ["stock_code"], wanted=["trade_count", "total_return"]), s, ["stock_code"]).join(s, "stock_code")
    return rounded(out, ["stock_code", "stock_name"], ["trade_count", "total_return"])


@add("a39_sweep_summary", f"""{_RANKED} SELECT count(*) AS case_count, count(*) AS grid_case_count, count(*) FILTER (pareto_rank = 1) AS pareto_case_count, min_by(case_name, sweep_rank) AS best_case_name, round(min_by(total_return, sweep_rank), 6) AS best_total_return, min_by(case_name, (-risk_adjusted_score, sweep_rank)) AS best_risk_adjusted_case_name,
  round(max(risk_adjusted_score), 4) AS best_risk_adjusted_score, round(avg(risk_adjusted_score), 4) AS avg_risk_adjusted_score, round(quantile_cont(risk_adjusted_score, 0.5), 4) AS median_risk_adjusted_score, round(min(risk_adjusted_score), 4) AS worst_risk_adjusted_score, CAST(sum(trade_count) AS BIGINT) AS case_trade_count FROM rk""")
def _(spark, d):
    t = sweep_table(spark, d)
    s = R.sweep_summary(W.rank_sweep(t), t.count())
    s = s.withColumn("best_total_return", F.round("best_total_return", 6))
    return rounded(s, ["case_count", "grid_case_count", "pareto_case_count", "best_case_name", "best_total_return", "best_risk_adjusted_case_name", "case_trade_count"], [f"{k}_risk_adjusted_score" for k in ("best", "avg", "median", "worst")], digits=4)


@add("j08_dated_equity", f"""{TRADES}, dq AS (SELECT side, exit_date, row_number() OVER w AS trade_no, product(1 + return_pct / 100) OVER (w ROWS UNBOUNDED PRECEDING) AS equity FROM trades WINDOW w AS (PARTITION BY side ORDER BY exit_date, order_id))
SELECT side, trade_no, exit_date AS date, round(equity, 6) AS equity FROM dq UNION ALL SELECT side, 0, min(exit_date), 1 FROM dq GROUP BY side""")
def _(spark, d):
    t = outcomes(spark, d)[1].select("side", "order_id", "exit_date", "entry_date", "signal_date", "return_pct")
    e = S_.equity_by_trade(t, ["side"]).withColumn("trade_no", F.col("trade_no").cast("long"))  # dated by the trades' exits, the start by the first
    return rounded(e, ["side", "trade_no", "date"], ["equity"])


@add("w41_trade_annotations", f"{TRADES} SELECT stock_code, order_id, kind, CAST(bar_index AS BIGINT) AS bar_index FROM (SELECT stock_code, order_id, 'entry' AS kind, entry_index AS bar_index FROM trades UNION ALL SELECT stock_code, order_id, 'exit', entry_index + holding_bars FROM trades)")
def _(spark, d):
    seen = trend_signals(spark, d)
    marks = R.trade_annotations(seen[0], outcomes(spark, d, seen=seen)[1])
    return marks.select("stock_code", "order_id", "kind", F.col("bar_index").cast("long").alias("bar_index"))


@add("w41_holding_intervals", f"{TRADES} SELECT order_id, CAST(entry_index AS BIGINT) AS from_index, CAST(entry_index + holding_bars AS BIGINT) AS to_index, round(stop_price, 6) AS stop_price FROM trades")
def _(spark, d):
    seen = trend_signals(spark, d)
    h = R.holding_intervals(R.trade_annotations(seen[0], T.written(outcomes(spark, d, seen=seen)[1].drop("metadata"))))
    return rounded(h.withColumns({c: F.col(c).cast("long") for c in ("from_index", "to_index")}), ["order_id", "from_index", "to_index"], ["stop_price"])


@add("w42_rebased_equity", f"{_CURVE} SELECT case_id, date, round(net_value / first_value(net_value) OVER (PARTITION BY case_id ORDER BY date), 6) AS rebased FROM cu")
def _(spark, d):
    return rounded(R.rebased_equity(curve(spark, d)), ["case_id", "date"], ["rebased"])


_RUNS = f"""{_PERIODS}, ps AS (SELECT case_id, period, ret > 0 AS win, ret < 0 AS loss, end_net_value < max(end_net_value) OVER (PARTITION BY case_id ORDER BY period) AS under, row_number() OVER (PARTITION BY case_id ORDER BY period) AS i FROM pr),
un AS (SELECT case_id, i, unnest(['win', 'loss', 'under']) AS f, unnest([win, loss, under]) AS v FROM ps), ru AS (SELECT case_id, f, v, count(*) AS n, max(i) AS z FROM (SELECT *, i - row_number() OVER (PARTITION BY case_id, f, v ORDER BY i) AS g FROM un) GROUP BY case_id, f, v, g)"""


@add("w43_period_streaks", f"""{_RUNS} SELECT p.case_id, {', '.join(f"coalesce((SELECT max(n) FROM ru WHERE ru.case_id = p.case_id AND f = '{f}' AND v), 0) AS {c}" for f, c in (('win', 'max_consecutive_wins'), ('loss', 'max_consecutive_losses'), ('under', 'max_recovery_periods')))},
  coalesce((SELECT max(n) FROM ru WHERE ru.case_id = p.case_id AND f = 'under' AND v AND z = max(p.i)), 0) AS current_underwater_periods FROM ps p GROUP BY p.case_id""")
def _(spark, d):
    return R.period_streaks(period_returns(curve(spark, d)))


for _name, _columns, _what in (("t06_trade_order", ("entry_date", "order_id"), "trades"), ("t07_simulation_order", ("signal_date", "order_id"), "ord")):
    S[_name] = f"{TRADES} SELECT order_id, row_number() OVER (PARTITION BY stock_code ORDER BY {', '.join(_columns)}) AS place FROM {_what}"
Q["t06_trade_order"] = lambda spark, d: R.place_in_order(outcomes(spark, d)[1], R.TRADE_ORDER, "place", ["stock_code"]).select("order_id", F.col("place").cast("long").alias("place"))
Q["t07_simulation_order"] = lambda spark, d: R.place_in_order(trend_orders(spark, d)[1].withColumn("order_sequence", F.lit(0)), R.SIMULATION_ORDER, "place", ["stock_code"]).select("order_id", F.col("place").cast("long").alias("place"))


@add("t08_filter_order", f"{TREND_EVENTS} SELECT 'signal_bar_stop:' || event_id AS order_id, row_number() OVER (PARTITION BY stock_code ORDER BY date, bar_index, event_id) AS place FROM events_")
def _(spark, d):
    return R.place_in_order(filtered(spark, d), R.FILTER_ORDER, "place", ["stock_code"]).select("order_id", F.col("place").cast("long").alias("place"))


@add("t09_configured_order", f"{TRADES} SELECT event_type, count(*) AS n, CASE event_type WHEN 'bear_l1_setup' THEN 0 WHEN 'bull_h2_setup' THEN 1 ELSE 2 END AS configured_rank FROM trades GROUP BY event_type")
def _(spark, d):
    g = outcomes(spark, d)[1].groupBy("event_type").agg(F.count("*").alias("n"))
    r = R.configured_order(g, "event_type", ["bear_l1_setup", "bull_h2_setup"])
    return r.select("event_type", "n", F.col("configured_rank").cast("int").alias("configured_rank"))


@add("t10_sorted_frame", f"{WEEK} SELECT stock_code, date, close FROM bars")
def _(spark, d):
    return R.ordered(week_bars(spark, d), ["no_such_column", "stock_code", "date"]).select("stock_code", "date", "close")
