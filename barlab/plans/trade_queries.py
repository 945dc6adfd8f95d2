"""Queries over orders, outcomes, trade statistics and gates, with DuckDB SQL written separately."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barlab.operators import detectors as D
from barlab.operators import execution as E
from barlab.operators import orders as O
from barlab.operators import stats as S_
from barlab.operators import tables as T
from barlab.operators.bars import with_bar_index
from barlab.plans.feature_queries import TREND_EVENTS, _TERMINAL, rounded, rsql
from barlab.plans.inputs import week_bars

Q: dict = {}
S: dict = {}


def add(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


def trend_signals(spark, d):
    """Week bars, numbered, and their trend events, stored: detection, matching, paths and marks all read them."""
    bars = T.written(with_bar_index(week_bars(spark, d)))
    return bars, T.written(D.detect_trend(bars))


def trend_orders(spark, d, seen=None):
    bars, events = seen or trend_signals(spark, d)
    return bars, O.generate_orders(O.judge_signals(events, bars))


def outcomes(spark, d, c: E.Execution = E.Execution(), seen=None):
    """Matched orders (stored: the paths and the trades both read them) and trades; seen: what trend_signals gave."""
    bars, orders = trend_orders(spark, d, seen)
    matched = T.written(E.match_entries(bars, orders, c))
    return matched, E.simulate(bars, matched, c)


ORDERS = f"""{TREND_EVENTS}, ord AS (SELECT 'signal_bar_stop:' || event_id AS order_id, *, date AS signal_date, bar_index AS signal_bar_index, direction AS side,
  entry_price + CASE direction WHEN 'long' THEN 1 ELSE -1 END * abs(entry_price - stop_price) * 2 AS target_price FROM events_
  WHERE volume > 0 AND amount > 0 AND direction IN ('long', 'short') AND entry_price > 0 AND stop_price > 0 AND entry_price <> stop_price)"""


@add("p01_signal_bar_orders", f"{ORDERS} SELECT order_id, side, signal_bar_index, {rsql(['signal_price', 'entry_price', 'stop_price', 'target_price'])}, round(abs(entry_price - stop_price) / entry_price, 6) AS actual_risk_pct FROM ord")
def _(spark, d):
    o = trend_orders(spark, d)[1].withColumn("actual_risk_pct", F.col("metadata.actual_risk_pct")).withColumn("signal_bar_index", F.col("signal_bar_index").cast("long"))
    return rounded(o, ["order_id", "side", "signal_bar_index"], ["signal_price", "entry_price", "stop_price", "target_price", "actual_risk_pct"])


@add("f12_signal_decisions", f"""{TREND_EVENTS} SELECT 'signal_bar_stop:' || event_id AS order_id, direction AS side, CASE WHEN direction = 'long' THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN direction = 'long' THEN '' ELSE 'side_mode_filtered' END AS reason FROM events_""")
def _(spark, d):
    bars, c = week_bars(spark, d), O.SignalBarStop(side_mode="long_only")
    return O.signal_decisions(O.judge_signals(D.detect_trend(bars), bars, c), c).select("order_id", "side", "status", "reason")


def _match(slip: float = 0.0) -> str:
    """CTEs m (orders with reason and fill) over ord and indexed bars."""
    return f"""ix AS (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY date) - 1 AS bi, count(*) OVER (PARTITION BY stock_code) AS n FROM bars),
m0 AS (SELECT o.*, e.date AS entry_date, e.bi AS entry_index, e.n AS n, CASE o.side WHEN 'long' THEN 1 ELSE -1 END AS dir, e.high AS eh, e.low AS el, e.open AS eo, e.volume AS ev, e.amount AS ea
  FROM ord o LEFT JOIN ix e ON e.stock_code = o.stock_code AND e.bi = o.signal_bar_index + 1),
m1 AS (SELECT *, CASE side WHEN 'long' THEN greatest(eo, entry_price) ELSE least(eo, entry_price) END * (1 + dir * {slip} / 10000) AS fill FROM m0),
m AS (SELECT *, CASE WHEN NOT (dir * stop_price < dir * entry_price) OR target_price <= 0 OR stop_price <= 0 THEN 'invalid_order' WHEN NOT (dir * target_price > dir * entry_price) THEN 'target_not_favorable'
  WHEN entry_date IS NULL THEN 'no_fill' WHEN NOT (ev > 0 AND ea > 0) THEN 'no_liquidity' WHEN (side = 'long' AND eh < entry_price) OR (side = 'short' AND el > entry_price) THEN 'no_fill'
  WHEN NOT (dir * target_price > dir * fill) THEN 'target_not_favorable' ELSE '' END AS reason FROM m1)"""


def _sim(brave: bool = False, trail: float = 0.0, fee: float = 0.0, slip: float = 0.0) -> str:
    line = f"CASE WHEN bi > entry_index AND dir * round(pk * (1 - dir * {trail}), 12) > dir * fill THEN round(pk * (1 - dir * {trail}), 12) END" if trail else "CAST(NULL AS DOUBLE)"
    worst, best = "(CASE WHEN dir > 0 THEN low ELSE high END)", "(CASE WHEN dir > 0 THEN high ELSE low END)"
    ht, hs, hl = f"dir * {best} >= dir * target_price", f"dir * {worst} <= dir * stop_price", f"dir * {worst} <= dir * line"
    gain, loss, tr = "'take_profit'", "'stop_loss'", "'trailing_take_profit'"
    chain = [("dir * open <= dir * stop_price", loss, "open"), ("dir * open >= dir * target_price", gain, "open"), ("dir * open <= dir * line", tr, "open"), (f"{hs} AND {ht}", *((gain, "target_price") if brave else (loss, "stop_price"))), (f"{hs} AND {hl}", *((tr, "line") if brave else (loss, "stop_price"))), (f"{ht} AND {hl}", *((gain, "target_price") if brave else (tr, "line"))), (ht, gain, "target_price"), (hl, tr, "line"), (hs, loss, "stop_price")]
    why = "CASE WHEN NOT liq THEN NULL " + " ".join(f"WHEN {t} THEN {r}" for t, r, _ in chain) + " END"
    price = "CASE WHEN NOT liq THEN NULL " + " ".join(f"WHEN {t} THEN {p}" for t, _, p in chain) + " END"
    w = "OVER (PARTITION BY order_id ORDER BY bi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""p0 AS (SELECT m.order_id, m.side, m.dir, m.fill, m.stop_price, m.target_price, m.entry_index, x.bi, x.date, x.open, x.high, x.low, x.close, x.volume > 0 AND x.amount > 0 AS liq
  FROM m JOIN ix x ON x.stock_code = m.stock_code AND x.bi BETWEEN m.entry_index AND least(m.n - 1, m.entry_index + 12) WHERE m.reason = ''),
p1 AS (SELECT *, coalesce(CASE WHEN dir > 0 THEN max(CASE WHEN liq THEN high ELSE fill END) {w} ELSE min(CASE WHEN liq THEN low ELSE fill END) {w} END, fill) AS pk FROM p0),
p2 AS (SELECT *, {line} AS line FROM p1), p3 AS (SELECT *, {why} AS why, {price} AS px FROM p2),
x1 AS (SELECT order_id, coalesce(min(CASE WHEN why IS NOT NULL THEN bi END), max(CASE WHEN liq THEN bi END), max(bi)) AS xi FROM p3 GROUP BY order_id),
x2 AS (SELECT x1.*, coalesce(p3.why, 'max_holding') AS exit_reason, coalesce(p3.px, p3.close) AS px, p3.date AS exit_date FROM x1 JOIN p3 ON p3.order_id = x1.order_id AND p3.bi = x1.xi),
x3 AS (SELECT x2.order_id, max(CASE WHEN liq THEN high END) AS hi, min(CASE WHEN liq THEN low END) AS lo FROM x2 JOIN p3 ON p3.order_id = x2.order_id AND p3.bi <= x2.xi GROUP BY x2.order_id),
tr0 AS (SELECT m.*, x2.exit_reason, x2.exit_date, x2.px * (1 - m.dir * {slip} / 10000) AS exit_price, x2.xi - m.entry_index AS holding_bars, abs(m.fill - m.stop_price) AS risk, hi, lo FROM m JOIN x2 USING (order_id) JOIN x3 USING (order_id)),
tr AS (SELECT *, (dir * (exit_price / fill - 1) - 2 * {fee}) * 100 AS return_pct, coalesce(greatest(0, dir * (CASE WHEN dir > 0 THEN hi ELSE lo END / fill - 1) * 100), 0) AS mfe_pct, coalesce(least(0, dir * (CASE WHEN dir > 0 THEN lo ELSE hi END / fill - 1) * 100), 0) AS mae_pct FROM tr0),
trades AS (SELECT *, coalesce(return_pct / 100 * fill / nullif(risk, 0), 0) AS r_multiple, coalesce(mae_pct / 100 * fill / nullif(risk, 0), 0) AS mae_r, coalesce(mfe_pct / 100 * fill / nullif(risk, 0), 0) AS mfe_r FROM tr)"""


_TR = ["exit_price", "return_pct", "mfe_pct", "mae_pct", "r_multiple", "mae_r", "mfe_r"]
TRADES = f"{ORDERS}, {_match()}, {_sim()}"


@add("j03_order_outcomes", f"{TRADES} SELECT order_id, side, exit_reason, entry_date, exit_date, CAST(holding_bars AS BIGINT) AS holding_bars, round(fill, 6) AS entry_price, {rsql(_TR)} FROM trades")
def _(spark, d):
    t = outcomes(spark, d)[1].withColumn("holding_bars", F.col("holding_bars").cast("long"))
    return rounded(t, ["order_id", "side", "exit_reason", "entry_date", "exit_date", "holding_bars"], ["entry_price", *_TR])


@add("j03_order_rejections", f"{ORDERS}, {_match()} SELECT reason, count(*) AS n FROM m GROUP BY reason")
def _(spark, d):
    return outcomes(spark, d)[0].groupBy("reason").agg(F.count("*").alias("n"))


@add("j04_first_exit_trailing", f"{ORDERS}, {_match(5.0)}, {_sim(trail=0.05, fee=0.0005, slip=5.0)} SELECT order_id, exit_reason, exit_date, {rsql(['exit_price', 'return_pct'])} FROM trades")
def _(spark, d):
    t = outcomes(spark, d, E.Execution(trailing_drawdown_pct=0.05, fee_rate=0.0005, slippage_bps=5.0))[1]
    return rounded(t, ["order_id", "exit_reason", "exit_date"], ["exit_price", "return_pct"])


@add("j04_first_exit_optimistic", f"{ORDERS}, {_match()}, {_sim(brave=True)} SELECT exit_reason, count(*) AS n, round(sum(return_pct), 4) AS total FROM trades GROUP BY exit_reason")
def _(spark, d):
    t = outcomes(spark, d, E.Execution(intrabar_exit_policy="optimistic"))[1]
    return t.groupBy("exit_reason").agg(F.count("*").alias("n"), F.round(F.sum("return_pct"), 4).alias("total"))


@add("f11_signal_bar_liquidity", f"{TREND_EVENTS} SELECT event_id, month(date) <> 7 AS signal_bar_liquid FROM events_")
def _(spark, d):
    bars = week_bars(spark, d)
    quiet = bars.withColumn("volume", F.when(F.month("date") == 7, 0.0).otherwise(F.col("volume")))
    return O.signal_bar_liquidity(D.detect_trend(bars), quiet).select("event_id", "signal_bar_liquid")


@add("w27_trailing_masks", f"{ORDERS}, {_match(5.0)}, {_sim(trail=0.05, fee=0.0005, slip=5.0)} SELECT order_id, bi AS bar_index, round(line, 6) AS line, coalesce(liq AND dir * (CASE WHEN dir > 0 THEN low ELSE high END) <= dir * line, false) AS touched FROM p2")
def _(spark, d):
    c = E.Execution(trailing_drawdown_pct=0.05, fee_rate=0.0005, slippage_bps=5.0)
    bars, orders = trend_orders(spark, d)
    m = E.trailing_masks(bars, E.match_entries(bars, orders, c), c)
    return m.select("order_id", F.col("bar_index").cast("long").alias("bar_index"), F.round("line", 6).alias("line"), "touched")


@add("j05_path_metrics", f"{TRADES} SELECT side, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _TR[2:])} FROM trades GROUP BY side")
def _(spark, d):
    return outcomes(spark, d)[1].groupBy("side").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in _TR[2:]))


@add("f08_preflight", f"{ORDERS} SELECT CASE WHEN NOT (CASE side WHEN 'long' THEN stop_price < entry_price ELSE stop_price > entry_price END) OR target_price <= 0 THEN 'invalid_order' WHEN NOT (CASE side WHEN 'long' THEN target_price > entry_price ELSE target_price < entry_price END) THEN 'target_not_favorable' ELSE '' END AS reason, count(*) AS n FROM ord GROUP BY 1")
def _(spark, d):
    return trend_orders(spark, d)[1].select(O.preflight_reason().alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@add("f09_duplicates", f"{ORDERS}, two AS (SELECT order_id, signal_date, stock_code FROM ord UNION ALL SELECT order_id, signal_date, stock_code FROM ord WHERE side = 'long') SELECT order_id, row_number() OVER (PARTITION BY order_id ORDER BY signal_date, stock_code) > 1 AS is_duplicate FROM two")
def _(spark, d):
    o = trend_orders(spark, d)[1]
    return O.mark_duplicates(O.union_all(o, o.where("side = 'long'"))).select("order_id", "is_duplicate")


_CONTEXT = "ctx AS (SELECT stock_code, date AS context_date, CASE WHEN close > open THEN 'bull' WHEN close < open THEN 'bear' ELSE 'flat' END AS context_state FROM bars WHERE month(date) % 3 = 0)"


def context_of(bars):
    return bars.where(F.month("date") % 3 == 0).select("stock_code", "date", F.expr("CASE WHEN close > open THEN 'bull' WHEN close < open THEN 'bear' ELSE 'flat' END").alias("direction"))


@add("j01_asof_context", f"{ORDERS}, {_CONTEXT} SELECT order_id, context_date, context_state FROM ord ASOF LEFT JOIN ctx ON ctx.stock_code = ord.stock_code AND ord.signal_date >= ctx.context_date")
def _(spark, d):
    bars, o = trend_orders(spark, d)
    return O.merge_prior_context(o, context_of(bars)).select("order_id", "context_date", "context_state")


@add("j02_aligned_orders", f"""{ORDERS}, {_CONTEXT}, al AS (SELECT order_id, side, signal_date, context_date, context_state FROM ord ASOF LEFT JOIN ctx ON ctx.stock_code = ord.stock_code AND ord.signal_date >= ctx.context_date)
SELECT order_id, CASE WHEN context_date IS NULL THEN 'higher_timeframe_no_context' WHEN signal_date - context_date > INTERVAL 30 DAY THEN 'higher_timeframe_stale'
  WHEN NOT ((side = 'long' AND context_state = 'bull') OR (side = 'short' AND context_state = 'bear')) THEN 'higher_timeframe_mismatch' ELSE '' END AS reason FROM al""")
def _(spark, d):
    bars, o = trend_orders(spark, d)
    return O.align_with_context(o, context_of(bars), O.Alignment(max_context_age="INTERVAL 30 DAYS")).select("order_id", "reason")


def _score(run: str, edge: str, progress: str, wick: str) -> str:
    return " + ".join(f"coalesce(CAST({x} AS INT), 0)" for x in (f"{run} >= 18", "extension_atr >= 2.0", f"{edge} >= 3", f"{progress} <= 0.35", f"{wick} >= 0.35"))


@add("j06_terminal_score", f"""{ORDERS}, {_TERMINAL}, js AS (SELECT order_id, ord.side, tf.*, CASE ord.side WHEN 'long' THEN {_score('up_regime_run', 'upper_edge_count', 'long_progress_atr', 'upper_wick_ratio')}
  ELSE {_score('down_regime_run', 'lower_edge_count', 'short_progress_atr', 'lower_wick_ratio')} END AS terminal_score FROM ord LEFT JOIN tf ON tf.stock_code = ord.stock_code AND tf.bar_index = ord.signal_bar_index)
SELECT order_id, terminal_score, coalesce(CASE side WHEN 'long' THEN up_regime_run >= 18 ELSE down_regime_run >= 18 END, false) AND terminal_score >= 3 AS terminal_reject FROM js""")
def _(spark, d):
    bars, o = trend_orders(spark, d)
    return O.score_terminal(o, bars).select("order_id", "terminal_score", "terminal_reject")


Q["w25_terminal_rejections"] = lambda spark, d: Q["j06_terminal_score"](spark, d).groupBy("terminal_reject").agg(F.count("*").alias("n"))
S["w25_terminal_rejections"] = f"SELECT terminal_reject, count(*) AS n FROM ({S['j06_terminal_score']}) GROUP BY terminal_reject"


# Capital and margin fractions of the trades, and a raw return of twice the return, for the exposure statistics.
FRACTIONS = {"c": "(0.103719313717 + 0.053147129531 * (holding_bars % 3))", "g": "(0.151917726913 + 0.073729137119 * (holding_bars % 3))"}


def with_fractions(trades):
    c, g = (F.expr(re.sub(r"(0\.[0-9]+)", r"\1D", FRACTIONS[k])) for k in ("c", "g"))
    return trades.withColumns({"capital_fraction": c, "margin_fraction": g, "raw_return_pct": 2 * F.col("return_pct")})


def erf_sql(z: str, steps: int = 1000) -> str:
    """The error function of z >= 0 by Simpson's rule; 1 beyond 6."""
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"CASE WHEN {z} > 6 THEN 1.0 ELSE 2 / sqrt(pi()) * {z} / {3 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * exp(-pow({z} * i / {steps}, 2)))) END"


def stats_sql(keys: str) -> str:
    k = f"PARTITION BY {keys}"
    run = f"OVER ({k} ORDER BY exit_date, order_id ROWS UNBOUNDED PRECEDING)"
    near = lambda sign: f"(win_rate + 1.9208 / trade_count {sign} 1.96 * sqrt(win_rate * (1 - win_rate) / trade_count + 3.8416 / (4 * trade_count * trade_count))) / (1 + 3.8416 / trade_count)"
    over = lambda x, y: f"CASE WHEN {y} > 0 THEN {x} / {y} ELSE 0 END"
    factor = lambda x, y: f"CASE WHEN {y} > 0 THEN {x} / {y} WHEN {x} > 0 THEN CAST('Infinity' AS DOUBLE) ELSE 0 END"
    return f"""s0 AS (SELECT *, coalesce(return_pct, 0) / 100 AS r, CAST(holding_bars AS DOUBLE) AS h, CAST({FRACTIONS['c']} AS DOUBLE) AS c, CAST({FRACTIONS['g']} AS DOUBLE) AS g, row_number() OVER ({k} ORDER BY exit_date, order_id) AS seq FROM trades),
s1 AS (SELECT *, product(1 + r) {run} AS equity FROM s0), s2 AS (SELECT *, greatest(1, max(equity) {run}) AS peak, quantile_cont(r, 0.05) OVER ({k}) AS q05 FROM s1),
isl AS (SELECT {keys}, f, v, max(c) AS c FROM (SELECT {keys}, f, v, g, count(*) AS c FROM (SELECT {keys}, f, v, seq - row_number() OVER (PARTITION BY {keys}, f, v ORDER BY seq) AS g
  FROM (SELECT {keys}, seq, unnest(['win', 'loss', 'under']) AS f, unnest([r > 0, r < 0, equity < peak]) AS v FROM s2)) GROUP BY ALL) GROUP BY {keys}, f, v),
st AS (SELECT {keys}, CAST(count(*) AS DOUBLE) AS trade_count, avg(CAST(r > 0 AS DOUBLE)) AS win_rate, max_by(equity, seq) - 1 AS total_return, avg(r) AS avg_return, stddev_pop(r) AS return_std,
  sqrt(avg(pow(least(r, 0), 2))) AS downside_deviation, coalesce(stddev_samp(r) / sqrt(count(*)), 0) AS avg_return_standard_error, least(0, min(equity / peak - 1)) AS max_drawdown, coalesce(sum(r) FILTER (r > 0), 0) AS gross_profit,
  coalesce(-sum(r) FILTER (r < 0), 0) AS gross_loss, coalesce(avg(r) FILTER (r > 0), 0) AS avg_win, coalesce(avg(r) FILTER (r < 0), 0) AS avg_loss, max(r) AS best_trade, min(r) AS worst_trade, quantile_cont(r, 0.05) AS return_p05,
  quantile_cont(r, 0.25) AS return_p25, quantile_cont(r, 0.5) AS return_p50, quantile_cont(r, 0.75) AS return_p75, quantile_cont(r, 0.95) AS return_p95, avg(r) FILTER (r <= q05) AS cvar_95, avg(holding_bars) AS avg_holding_bars,
  CAST(sum(holding_bars) AS DOUBLE) AS exposure_bars, avg(r_multiple) AS avg_r_multiple, quantile_cont(r_multiple, 0.5) AS median_r_multiple, max(r_multiple) AS best_r_multiple, min(r_multiple) AS worst_r_multiple,
  stddev_pop(r_multiple) AS rs, coalesce(sum(r_multiple) FILTER (r_multiple > 0), 0) AS rp, coalesce(-sum(r_multiple) FILTER (r_multiple < 0), 0) AS rn, avg(mae_pct) AS avg_mae_pct, avg(mfe_pct) AS avg_mfe_pct, avg(mae_r) AS avg_mae_r, avg(mfe_r) AS avg_mfe_r,
  sum(r) AS return_contribution, sum(c) AS capital_turnover, avg(c) AS avg_capital_fraction, max(c) AS max_capital_fraction, sum(g) AS margin_turnover, avg(g) AS avg_margin_fraction, max(g) AS max_margin_fraction, sum(h * c) AS capital_exposure_bars,
  sum(h * g) AS margin_exposure_bars, avg(h * c) AS avg_capital_exposure_per_trade, avg(h * g) AS avg_margin_exposure_per_trade, sum(2 * r * c) / sum(c) AS capital_weighted_raw_return FROM s2 GROUP BY {keys}),
sz AS (SELECT *, CASE WHEN avg_loss >= 0 THEN 0 WHEN avg_win <= 0 THEN 1 ELSE -avg_loss / (avg_win - avg_loss) END AS breakeven_win_rate, CASE WHEN avg_return_standard_error > 0 THEN abs(avg_return / avg_return_standard_error / sqrt(2)) END AS z FROM st),
stat AS (SELECT sz.*, CAST(coalesce(w.c, 0) AS DOUBLE) AS max_consecutive_wins, CAST(coalesce(l.c, 0) AS DOUBLE) AS max_consecutive_losses, CAST(coalesce(u.c, 0) AS DOUBLE) AS max_drawdown_duration, avg_return AS expectancy,
  {factor('gross_profit', 'gross_loss')} AS profit_factor, {factor('rp', 'rn')} AS r_profit_factor, {over('avg_return', 'return_std')} AS sharpe_per_trade, {over('avg_win', 'abs(avg_loss)')} AS payoff_ratio,
  {over('avg_return', 'downside_deviation')} AS sortino_per_trade, {over('total_return', 'abs(max_drawdown)')} AS recovery_factor,
  CASE WHEN rs > 1e-12 THEN sqrt(trade_count) * avg_r_multiple / rs ELSE 0 END AS system_quality_number, win_rate - breakeven_win_rate AS win_rate_edge,
  greatest(0, {near('-')}) AS win_rate_ci_lower, least(1, {near('+')}) AS win_rate_ci_upper, avg_return - 1.96 * avg_return_standard_error AS avg_return_ci_lower, avg_return + 1.96 * avg_return_standard_error AS avg_return_ci_upper,
  {over('return_contribution', 'exposure_bars')} AS return_per_exposure_bar, {over('return_contribution', 'capital_exposure_bars')} AS return_per_capital_exposure_bar, {over('return_contribution', 'margin_exposure_bars')} AS return_per_margin_exposure_bar
  FROM sz LEFT JOIN isl w ON w.f = 'win' AND w.v AND {_eq(keys, 'w')} LEFT JOIN isl l ON l.f = 'loss' AND l.v AND {_eq(keys, 'l')} LEFT JOIN isl u ON u.f = 'under' AND u.v AND {_eq(keys, 'u')})"""


EXPECTANCY = f"CASE WHEN avg_return_standard_error > 0 THEN 0.5 * (1 + sign(avg_return) * {erf_sql('z')}) WHEN avg_return > 0 THEN 1 WHEN avg_return < 0 THEN 0 ELSE 0.5 END"


def _eq(keys: str, alias: str) -> str:
    return " AND ".join(f"{alias}.{k} = sz.{k}" for k in keys.split(", "))


STATS = [
    "trade_count", "win_rate", "breakeven_win_rate", "win_rate_edge", "win_rate_ci_lower", "win_rate_ci_upper", "total_return", "avg_return", "avg_return_standard_error", "avg_return_ci_lower", "avg_return_ci_upper", "positive_expectancy_probability",
    "max_drawdown", "profit_factor", "expectancy", "avg_win", "avg_loss", "payoff_ratio", "exposure_bars", "gross_profit", "gross_loss", "return_std", "sharpe_per_trade", "sortino_per_trade", "max_consecutive_wins", "max_consecutive_losses",
    "avg_holding_bars", "best_trade", "worst_trade", "return_p05", "return_p25", "return_p50", "return_p75", "return_p95", "cvar_95", "max_drawdown_duration", "recovery_factor", "avg_r_multiple", "median_r_multiple", "best_r_multiple",
    "worst_r_multiple", "r_profit_factor", "system_quality_number", "avg_mae_pct", "avg_mfe_pct", "avg_mae_r", "avg_mfe_r", "return_contribution", "return_per_exposure_bar", "capital_turnover", "avg_capital_fraction", "max_capital_fraction",
    "margin_turnover", "avg_margin_fraction", "max_margin_fraction", "capital_exposure_bars", "margin_exposure_bars", "avg_capital_exposure_per_trade", "avg_margin_exposure_per_trade", "return_per_capital_exposure_bar",
    "return_per_margin_exposure_bar", "capital_weighted_raw_return",
]


def _grouped(name: str, keys: list[str]):
    sql = ", ".join(keys)
    S[name] = f"{TRADES}, {stats_sql(sql)} SELECT {sql}, {rsql(STATS)} FROM (SELECT *, {EXPECTANCY} AS positive_expectancy_probability FROM stat) y"
    Q[name] = lambda spark, d: rounded(S_.trade_statistics(with_fractions(outcomes(spark, d)[1]), keys), keys, STATS)


_grouped("a17_trade_statistics_by_symbol", ["stock_code"])
_grouped("a18_grouped_statistics_side", ["side"])
_grouped("a32_grouped_statistics_event_type", ["event_type"])
_grouped("a34_signal_lifecycle", ["detector_name", "event_type", "side", "exit_reason"])


def _subset(name: str, cols: list[str], keys: str = "side"):
    S[name] = f"{TRADES}, {stats_sql(keys)} SELECT {keys}, {rsql(cols)} FROM stat"
    Q[name] = lambda spark, d: rounded(S_.trade_statistics(outcomes(spark, d)[1], [keys], wanted=cols), [keys], cols)


_subset("a19_return_series", ["avg_return", "return_std", "downside_deviation", "best_trade", "worst_trade", "return_p05", "return_p25", "return_p50", "return_p75", "return_p95", "cvar_95"])
_subset("a20_sample_confidence", ["avg_return_standard_error", "win_rate_ci_lower", "win_rate_ci_upper"])
_subset("c14_wilson_interval", ["win_rate_ci_lower", "win_rate_ci_upper"], "event_type")
_subset("a21_risk_quality", ["avg_r_multiple", "median_r_multiple", "best_r_multiple", "worst_r_multiple", "system_quality_number", "avg_mae_pct", "avg_mfe_r"])
_subset("w29_return_streaks", ["max_consecutive_wins", "max_consecutive_losses"], "stock_code")
_subset("w34_drawdown_duration", ["max_drawdown_duration", "max_drawdown"], "stock_code")


@add("c15_positive_expectancy", f"{TRADES}, {stats_sql('stock_code')} SELECT stock_code, round({EXPECTANCY}, 6) AS positive_expectancy_probability FROM stat")
def _(spark, d):
    return rounded(S_.trade_statistics(outcomes(spark, d)[1], ["stock_code"], wanted=["positive_expectancy_probability"]), ["stock_code"], ["positive_expectancy_probability"])


@add("a23_exit_reasons", f"""{TRADES} SELECT side, count(*) AS exit_count, count(*) FILTER (exit_reason = 'stop_loss') AS stop_loss_count, count(*) FILTER (exit_reason = 'take_profit') AS take_profit_count,
  count(*) FILTER (exit_reason = 'max_holding') AS max_holding_count, (SELECT exit_reason FROM trades y WHERE y.side = trades.side GROUP BY exit_reason ORDER BY count(*) DESC LIMIT 1) AS primary_exit_reason FROM trades GROUP BY side""")
def _(spark, d):
    s = S_.exit_reason_summary(outcomes(spark, d)[1], ["side"])
    return s.select("side", "exit_count", "stop_loss_count", "take_profit_count", "max_holding_count", "primary_exit_reason")


_B = {
    "holding_bars": "CASE WHEN x <= 1 THEN '1K' WHEN x <= 3 THEN '2-3K' WHEN x <= 8 THEN '4-8K' WHEN x <= 16 THEN '9-16K' ELSE '17K+' END",
    "r_multiple": "CASE WHEN x <= -1 THEN '<=-1R' WHEN x < 0 THEN '-1R~0R' WHEN x < 1 THEN '0R~1R' WHEN x < 2 THEN '1R~2R' ELSE '>=2R' END",
    "mae_r": "CASE WHEN x <= -1 THEN '<=-1R' WHEN x <= -0.5 THEN '-1R~-0.5R' WHEN x < 0 THEN '-0.5R~0R' ELSE '0R' END",
    "mfe_r": "CASE WHEN x <= 0 THEN '0R' WHEN x < 0.5 THEN '0R~0.5R' WHEN x < 1 THEN '0.5R~1R' WHEN x < 2 THEN '1R~2R' ELSE '>=2R' END",
}


@add("a35_path_distribution", TRADES + " " + " UNION ALL ".join(f"SELECT '{k}' AS dimension, {v} AS bucket, CAST(count(*) AS DOUBLE) AS trade_count, round(avg(return_pct / 100), 6) AS avg_return FROM (SELECT *, round({k}, 9) AS x FROM trades) GROUP BY ALL" for k, v in _B.items()))
def _(spark, d):
    t = outcomes(spark, d)[1]
    t = t.withColumns({k: F.round(k, 9) for k in ("r_multiple", "mae_r", "mfe_r")})
    return S_.path_distribution(t).select("dimension", "bucket", "trade_count", F.round("avg_return", 6).alias("avg_return"))


@add("a33_setup_statistics", f"""{TRADES}, {stats_sql('detector_name, event_type, side')}, setups AS (SELECT DISTINCT detector_name, event_type, side FROM ord UNION SELECT 'trend', 'idle_setup', 'long')
SELECT e.detector_name, e.event_type, e.side, round(coalesce(trade_count, 0), 6) AS trade_count, round(coalesce(total_return, 0), 6) AS total_return FROM setups e LEFT JOIN stat USING (detector_name, event_type, side)""")
def _(spark, d):
    matched, trades = outcomes(spark, d)
    keys = ["detector_name", "event_type", "side"]
    idle = spark.createDataFrame([("trend", "idle_setup", "long")], keys)
    out = S_.with_idle_keys(S_.trade_statistics(trades, keys, wanted=["trade_count", "total_return"]), matched.select(*keys).union(idle), keys)
    return rounded(out, keys, ["trade_count", "total_return"])


@add("a24_decision_statistics", f"{ORDERS}, {_match()} SELECT *, round(decision_count / (SELECT count(*) FROM m), 6) AS decision_rate, round(decision_count / sum(decision_count) OVER (PARTITION BY detector_name), 6) AS group_decision_rate FROM (SELECT detector_name, CASE WHEN reason = '' THEN 'accepted' ELSE 'rejected' END AS status, reason, count(*) AS decision_count FROM m GROUP BY ALL) y")
def _(spark, d):
    m = outcomes(spark, d)[0].withColumn("status", F.when(F.col("reason") == "", "accepted").otherwise("rejected"))
    return rounded(S_.decision_statistics(m, ["detector_name"]), ["detector_name", "status", "reason", "decision_count"], ["decision_rate", "group_decision_rate"])


@add("j09_group_decision_rates", f"{ORDERS}, {_match()} SELECT *, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS rate FROM (SELECT event_type, reason, count(*) AS n FROM m GROUP BY ALL) y")
def _(spark, d):
    m = outcomes(spark, d)[0].withColumn("status", F.lit(""))
    return S_.decision_statistics(m, ["event_type"], ()).select("event_type", "reason", F.col("decision_count").alias("n"), F.round("group_decision_rate", 6).alias("rate"))


@add("w28_trade_path", f"{TRADES}, {stats_sql('stock_code')} SELECT order_id, seq, round(equity, 6) AS equity FROM s2")
def _(spark, d):
    return S_.trade_path(outcomes(spark, d)[1], ["stock_code"]).select("order_id", F.col("seq").cast("long").alias("seq"), F.round("equity", 6).alias("equity"))


@add("w40_equity_by_trade", f"{TRADES}, {stats_sql('stock_code')} SELECT stock_code, CAST(seq AS BIGINT) AS trade_no, round(equity, 6) AS equity FROM s2 UNION ALL SELECT DISTINCT stock_code, 0, 1.0 FROM s2")
def _(spark, d):
    return S_.equity_by_trade(outcomes(spark, d)[1], ["stock_code"]).select("stock_code", F.col("trade_no").cast("long").alias("trade_no"), F.round("equity", 6).alias("equity"))


GATE = f"""WITH RECURSIVE {TRADES.removeprefix('WITH ')}, g0 AS (SELECT stock_code, order_id, entry_date, exit_date, row_number() OVER (PARTITION BY stock_code ORDER BY entry_date, order_id) AS k FROM trades),
g AS (SELECT stock_code, order_id, k, true AS taken, exit_date AS until FROM g0 WHERE k = 1
  UNION ALL SELECT g0.stock_code, g0.order_id, g0.k, g0.entry_date > g.until, CASE WHEN g0.entry_date > g.until THEN g0.exit_date ELSE g.until END FROM g JOIN g0 ON g0.stock_code = g.stock_code AND g0.k = g.k + 1)"""


@add("w35_single_position_gate", f"{GATE} SELECT stock_code, order_id, CASE WHEN taken THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN taken THEN '' ELSE 'already_open' END AS reason FROM g")
def _(spark, d):
    t = outcomes(spark, d)[1].select("stock_code", "order_id", "entry_date", "exit_date")
    return E.select_non_overlapping(t, ["stock_code"], sequence="order_id").select("stock_code", "order_id", "status", "reason")


@add("p03_order_backtest", f"{GATE} SELECT stock_code, count(*) AS trades, round(product(1 + return_pct / 100) - 1, 6) AS total_return FROM g JOIN trades USING (stock_code, order_id) WHERE taken GROUP BY stock_code")
def _(spark, d):
    t = outcomes(spark, d)[1].select("stock_code", "order_id", "entry_date", "exit_date", "signal_date", "return_pct")
    kept = E.select_non_overlapping(t, ["stock_code"], sequence="order_id").where("status = 'accepted'")
    s = S_.trade_statistics(kept, ["stock_code"], wanted=["trade_count", "total_return"])
    return s.select("stock_code", F.col("trade_count").cast("long").alias("trades"), F.round("total_return", 6).alias("total_return"))


@add("c13_execution_metrics", f"{ORDERS}, {_match()} SELECT order_id, round(abs(fill - stop_price) / fill, 6) AS actual_risk_pct, round(abs(fill - signal_price) / signal_price, 6) AS actual_chase_pct, round(dir * (target_price - fill) / abs(fill - stop_price), 6) AS actual_reward_to_risk FROM m WHERE reason = ''")
def _(spark, d):
    return rounded(outcomes(spark, d)[0].where("reason = ''"), ["order_id"], ["actual_risk_pct", "actual_chase_pct", "actual_reward_to_risk"])


@add("p07_candidates", f"{TRADES} SELECT m.order_id, m.stock_code, CASE WHEN m.reason = '' THEN 'candidate' ELSE 'rejected' END AS status, m.reason, CASE WHEN m.reason = '' THEN m.entry_date END AS entry_date, exit_date, round(trades.fill, 6) AS entry_price, round(exit_price, 6) AS exit_price FROM m LEFT JOIN trades ON trades.order_id = m.order_id")
def _(spark, d):
    m, t = outcomes(spark, d)
    ended = t.select("order_id", "entry_date", "exit_date", F.round("entry_price", 6).alias("entry_price"), F.round("exit_price", 6).alias("exit_price"))
    asked = m.select("order_id", "stock_code", F.when(F.col("reason") == "", "candidate").otherwise("rejected").alias("status"), "reason")
    return asked.join(ended, "order_id", "left")


@add("u01_union_strategies", f"{ORDERS} SELECT detector_name, count(*) AS n FROM ord GROUP BY detector_name UNION ALL SELECT 'twice', 2 * count(*) FROM ord")
def _(spark, d):
    o = trend_orders(spark, d)[1].select("order_id", "detector_name")
    both = O.union_all(o, o.withColumn("detector_name", F.lit("twice")), o.withColumn("detector_name", F.lit("twice")))
    return both.groupBy("detector_name").agg(F.count("*").alias("n"))
