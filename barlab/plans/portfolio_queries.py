"""Queries over marks, trigger trades and diagnostics, with DuckDB SQL written separately."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.operators import features as X
from barlab.operators import portfolio as P
from barlab.operators import stats as S_
from barlab.operators import tables as T
from barlab.plans.feature_queries import WEEK, _land, _scan, rounded, rsql
from barlab.plans.inputs import week_bars
from barlab.plans.trade_queries import ORDERS, TRADES, _match, outcomes, stats_sql, trend_signals

Q: dict = {}
S: dict = {}


def add(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


_LEGACY = f"""{WEEK}, {_land('bars')}, {_scan()}, sb AS (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY date) - 1 AS bi, count(*) OVER (PARTITION BY stock_code) AS n FROM scan),
tg AS (SELECT stock_code, bi AS entry_index, close AS entry_price, least(n - 1, bi + 12) AS last_i FROM sb WHERE breakout_trigger AND least(n - 1, bi + 12) > bi),
lp AS (SELECT t.*, s.bi, s.date, s.close, CASE WHEN NOT (s.volume > 0 AND s.amount > 0) THEN NULL WHEN s.open <= entry_price * 0.97 THEN 'stop_loss' WHEN s.open >= entry_price * 1.06 THEN 'take_profit' WHEN s.low <= entry_price * 0.97 THEN 'stop_loss' WHEN s.high >= entry_price * 1.06 THEN 'take_profit' END AS why,
  CASE WHEN s.open <= entry_price * 0.97 OR s.open >= entry_price * 1.06 THEN s.open WHEN s.low <= entry_price * 0.97 THEN entry_price * 0.97 ELSE entry_price * 1.06 END AS px FROM tg t JOIN sb s ON s.stock_code = t.stock_code AND s.bi BETWEEN t.entry_index + 1 AND t.last_i),
lx AS (SELECT stock_code, entry_index, coalesce(min(bi) FILTER (why IS NOT NULL), max(bi)) AS xi FROM lp GROUP BY stock_code, entry_index)"""


@add("p04_trigger_backtest", f"{_LEGACY} SELECT lp.stock_code, lp.entry_index, lp.date AS exit_date, coalesce(why, 'max_holding') AS exit_reason, round((CASE WHEN why IS NULL THEN close ELSE px END / entry_price - 1) * 100, 6) AS return_pct FROM lx JOIN lp ON lp.stock_code = lx.stock_code AND lp.entry_index = lx.entry_index AND lp.bi = lx.xi")
def _(spark, d):
    t = P.trigger_outcomes(X.scan_bars(week_bars(spark, d)))
    return rounded(t.withColumn("entry_index", F.col("entry_index").cast("long")), ["stock_code", "entry_index", "exit_date", "exit_reason"], ["return_pct"])


def candidates(spark, d, seen=None):
    t = outcomes(spark, d, seen=seen)[1].drop("metadata")
    return t.select(F.lit("all").alias("case_id"), "stock_code", "order_id", "strategy_name", "side", F.col("event_type").alias("sector"), (F.col("risk_per_share") / F.col("entry_price")).alias("risk_fraction"), "entry_date", "exit_date", "entry_price", "return_pct")


@add("w38_marked_positions", f"""{TRADES}, pos AS (SELECT stock_code, dir * 100 / fill AS u, entry_date, exit_date FROM trades WHERE exit_date > entry_date), sc AS (SELECT DISTINCT stock_code FROM trades), tl AS (SELECT DISTINCT date FROM bars SEMI JOIN sc USING (stock_code)),
mk AS (SELECT tl.date, pos.u, b.close FROM tl JOIN pos ON tl.date >= entry_date AND tl.date < exit_date ASOF JOIN bars b ON b.stock_code = pos.stock_code AND tl.date >= b.date)
SELECT tl.date, round(coalesce(sum(u * close), 0), 4) AS position_value, count(u) AS open_positions FROM tl LEFT JOIN mk USING (date) GROUP BY tl.date""")
def _(spark, d):
    seen = trend_signals(spark, d)
    p = T.written(candidates(spark, d, seen).withColumn("allocation", F.lit(100.0)))  # three passes follow
    m = P.mark_positions(p, seen[0])
    return m.select("date", (F.round("position_value", 4) + 0.0).alias("position_value"), "open_positions")


@add("a25_decision_summary", f"""{ORDERS}, {_match()} SELECT event_type, count(*) AS order_count, count(*) FILTER (reason = '') AS accepted_order_count, count(*) FILTER (reason = 'no_fill') AS rejected_no_fill_count, round(count(*) FILTER (reason = '') / count(*), 6) AS acceptance_rate,
  coalesce((SELECT y.reason FROM m y WHERE y.event_type = m.event_type AND y.reason <> '' GROUP BY y.reason ORDER BY count(*) DESC, y.reason LIMIT 1), '') AS primary_rejected_reason FROM m GROUP BY event_type""")
def _(spark, d):
    m = outcomes(spark, d)[0].withColumn("status", F.when(F.col("reason") == "", "accepted").otherwise("rejected"))
    return rounded(P.decision_summary(m, ["event_type"]), ["event_type", "order_count", "accepted_order_count", "rejected_no_fill_count", "primary_rejected_reason"], ["acceptance_rate"])
