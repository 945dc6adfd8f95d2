"""Marks of open positions, trigger outcomes and decision summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.operators.bars import liquid, with_bar_index
from barlab.operators.execution import Execution, slipped


def mark_positions(positions: DataFrame, bars: DataFrame, key: str = "case_id") -> DataFrame:
    """Each case and bar time: value of the open positions (entry <= t < exit) at close, and how many are open.

    positions: stock_code, side, entry_date, exit_date, entry_price, allocation. A position's symbol needn't have a
    bar at every time: its last close is carried on. Positions become entry and exit deltas of units per symbol, so
    no range join is needed: units run over the symbol's own bars, and steps of value over the timeline."""
    sign = F.when(F.col("side") == "short", -1.0).otherwise(1.0)
    units = sign * F.col("allocation") / F.col("entry_price")
    live = positions.where("exit_date > entry_date")
    deltas = live.select(key, "stock_code", F.col("entry_date").alias("date"), units.alias("du"), F.lit(1).alias("dn")).union(live.select(key, "stock_code", F.col("exit_date").alias("date"), -units, F.lit(-1)))
    deltas = deltas.groupBy(key, "stock_code", "date").agg(F.sum("du").alias("du"), F.sum("dn").alias("dn"))
    cases = positions.select(key, "stock_code").distinct()
    marks = cases.join(bars.select("stock_code", "date", "close"), "stock_code").join(deltas, [key, "stock_code", "date"], "full")
    w = Window.partitionBy(key, "stock_code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    m = marks.select(key, "stock_code", "date", F.coalesce(F.sum("du").over(w), F.lit(0.0)).alias("u"), F.coalesce(F.sum("dn").over(w), F.lit(0)).alias("n"), F.last("close", ignorenulls=True).over(w).alias("p"))
    m = m.withColumn("v", F.when(F.col("n") == 0, 0.0).otherwise(F.col("u") * F.col("p")))
    own = Window.partitionBy(key, "stock_code").orderBy("date")
    m = m.select(key, "date", (F.col("v") - F.coalesce(F.lag("v").over(own), F.lit(0.0))).alias("dv"), (F.col("n") - F.coalesce(F.lag("n").over(own), F.lit(0))).alias("dn"))
    steps = m.groupBy(key, "date").agg(F.sum("dv").alias("dv"), F.sum("dn").alias("dn"))
    run = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(key, "date", F.sum("dv").over(run).alias("position_value"), F.sum("dn").over(run).alias("open_positions"))


def trigger_outcomes(scanned: DataFrame, take_profit: float = 0.06, stop_loss: float = 0.03, c: Execution = Execution()) -> DataFrame:
    """Long trades from scan triggers: entry at the trigger's close, exits from the next bar, the stop before the target."""
    b = with_bar_index(scanned)
    n = b.groupBy("stock_code").agg(F.max("bar_index").alias("_last"))
    entry = slipped(F.coalesce("trigger_price", "close"), F.lit(1.0), c)
    t = b.where("breakout_trigger").join(n, "stock_code").select("stock_code", F.col("bar_index").alias("entry_index"), F.col("date").alias("entry_date"), entry.alias("entry_price"), F.least(F.col("_last"), F.col("bar_index") + c.max_holding_bars).alias("_to"))
    t = t.where("entry_price > 0 AND _to > entry_index").withColumns({"stop_price": F.col("entry_price") * (1 - stop_loss), "target_price": F.col("entry_price") * (1 + take_profit)})
    bar = b.select("stock_code", "bar_index", F.col("date").alias("exit_date"), "open", "high", "low", "close", liquid().alias("_liq"))
    p = t.withColumn("bar_index", F.explode(F.sequence(F.col("entry_index") + 1, F.col("_to")))).join(bar, ["stock_code", "bar_index"])
    out = lambda reason, price: F.struct(F.lit(reason).alias("reason"), F.col(price).alias("price"), F.col("bar_index").alias("i"), F.col("exit_date").alias("date"))
    x = F.when(F.col("_liq"), F.when(F.col("open") <= F.col("stop_price"), out("stop_loss", "open")).when(F.col("open") >= F.col("target_price"), out("take_profit", "open")).when(F.col("low") <= F.col("stop_price"), out("stop_loss", "stop_price")).when(F.col("high") >= F.col("target_price"), out("take_profit", "target_price")))
    p = p.withColumn("_x", x)
    keys = ["stock_code", "entry_index", "entry_date", "entry_price", "stop_price", "target_price"]
    e = p.groupBy(*keys).agg(F.coalesce(F.min_by("_x", F.when(F.col("_x").isNotNull(), F.col("bar_index"))), F.max_by(out("max_holding", "close"), "bar_index")).alias("e"))
    exit_ = slipped(F.col("e.price"), F.lit(-1.0), c)
    return e.select(*keys, F.col("e.date").alias("exit_date"), exit_.alias("exit_price"), F.col("e.reason").alias("exit_reason"), (F.col("e.i") - F.col("entry_index")).alias("holding_bars"), (((exit_ / F.col("entry_price") - 1) - 2 * c.fee_rate) * 100).alias("return_pct"))


REASONS = ("no_fill", "no_liquidity", "no_bars", "invalid_order", "duplicate_order_id", "already_open", "max_open_positions", "same_symbol_overlap", "no_capital", "actual_risk_too_high", "chase_too_far", "target_not_favorable")


def decision_summary(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """The order funnel of each key: counts, rates, fixed reject counts and the most frequent reject reason."""
    ok, no = F.col("status") == "accepted", F.col("status") == "rejected"
    by_reason = decisions.where(no).groupBy(*keys, "reason").count()
    top = by_reason.groupBy(*keys).agg(F.min_by("reason", F.struct(-F.col("count"), F.col("reason"))).alias("primary_rejected_reason"), F.max("count").alias("primary_rejected_reason_count"))
    s = decisions.groupBy(*keys).agg(F.count("*").alias("order_count"), F.count_if(ok).alias("accepted_order_count"), F.count_if(no).alias("rejected_order_count"), *(F.count_if(no & (F.col("reason") == r)).alias(f"rejected_{r}_count") for r in REASONS))
    s = s.join(top, keys, "left").fillna("", ["primary_rejected_reason"]).fillna(0, ["primary_rejected_reason_count"])
    return s.withColumns({"acceptance_rate": F.col("accepted_order_count") / F.col("order_count"), "rejection_rate": F.col("rejected_order_count") / F.col("order_count")})


#: Check, statistic, its value where unknown (None: pass), fail and attention by comparison, and a count
#: without which the check has the given status.
RULES = (
    ("data_coverage", "data_weighted_coverage_ratio", None, ("<", 0.95), ("<", 0.98), None),
    ("trade_sample", "trade_count", 0.0, ("<=", 0.0), ("<", 30.0), None),
    ("order_acceptance", "acceptance_rate", 0.0, None, ("<", 0.2), ("order_count", "fail")),
    ("strategy_filter", "strategy_filter_rejection_rate", 0.0, None, (">=", 0.6), None),
    ("drawdown_pressure", "max_drawdown", 0.0, ("<=", -0.35), ("<=", -0.2), None),
    ("profit_quality", "profit_factor", 0.0, ("<", 1.0), ("<", 1.2), ("trade_count", "pass")),
    ("win_rate_edge", "win_rate_edge", None, ("<", 0.0), ("<", 0.03), ("trade_count", "fail")),
    ("positive_expectancy", "positive_expectancy_probability", None, ("<", 0.5), ("<", 0.75), ("trade_count", "fail")),
    ("exit_structure", "exit_concentration", 0.0, None, (">=", 0.5), ("trade_count", "fail")),
    ("monthly_stability", "monthly_worst_return", 0.0, ("<=", -0.2), ("<=", -0.1), None),
    ("path_risk", "avg_mae_r", 0.0, ("<=", -1.2), ("<=", -0.8), None),
    ("capital_exposure", "max_margin_exposure", 0.0, (">=", 1.5), (">", 1.0), None),
)
CHECKS = tuple(r[0] for r in RULES)
_ALARMS = ("data_coverage_below_min_count", "data_audit_failed_count")


def exit_concentration(reason: Column, rate: Column) -> Column:
    """The share of the main exit reason where that is the stop or the holding limit; 1 where trades end with the data."""
    return F.when(reason.isin("stop_loss", "max_holding"), rate).when((reason == "end_of_data") & (rate > 0), 1.0).otherwise(0.0)


def diagnostics(stats: DataFrame, key: str) -> DataFrame:
    """key, check, metric, value and status (pass, attention, fail) of all RULES for each row of stats.

    The rules are a table: each row's statistics become (metric, value), and each rule looks its own up and compares.
    Statistics that stats lacks are unknown. exit_concentration follows from primary_exit_reason and its rate where
    these are there. Coverage fails below data_min_coverage_threshold (0.95 if unknown) or where an audit failed."""
    if {"primary_exit_reason", "primary_exit_reason_rate"} <= set(stats.columns):
        stats = stats.withColumn("exit_concentration", exit_concentration(F.col("primary_exit_reason"), F.col("primary_exit_reason_rate")))
    used = {*(r[1] for r in RULES), *(r[5][0] for r in RULES if r[5]), *_ALARMS, "data_min_coverage_threshold"} & set(stats.columns)
    none = F.lit(None).cast("double")
    known = F.create_map(*(x for m in sorted(used) for x in (F.lit(m), F.col(m).cast("double")))) if used else F.create_map(F.lit(""), none)
    bound = lambda t: (F.lit(t[0] if t else None).cast("string"), F.lit(t[1] if t else None).cast("double"))
    rules = []
    for check, metric, default, fail, warn, needs in RULES:
        (fo, fv), (wo, wv) = bound(fail), bound(warn)
        gate, otherwise = needs or (None, None)
        fields = {"check": F.lit(check), "metric": F.lit(metric), "default": F.lit(default).cast("double"), "fail_is": fo, "fail_at": fv, "warn_is": wo, "warn_at": wv, "needs": F.lit(gate).cast("string"), "otherwise": F.lit(otherwise).cast("string")}
        rules.append(F.struct(*(c.alias(n) for n, c in fields.items())))
    rows = stats.select(key, known.alias("known"), F.explode(F.array(*rules)).alias("r"))
    at = lambda name: F.try_element_at(F.col("known"), name)
    rows = rows.withColumns({"value": F.coalesce(at(F.col("r.metric")), F.col("r.default")), "need": F.coalesce(at(F.col("r.needs")), F.lit(0.0)), "alarm": sum((F.coalesce(at(F.lit(a)), F.lit(0.0)) for a in _ALARMS), F.lit(0.0))})
    coverage = F.col("r.check") == "data_coverage"
    fail_at = F.when(coverage, F.coalesce(F.nullif(at(F.lit("data_min_coverage_threshold")), F.lit(0.0)), F.col("r.fail_at"))).otherwise(F.col("r.fail_at"))
    v = F.col("value")
    beyond = lambda op, t: F.coalesce(F.when(op == "<", v < t).when(op == "<=", v <= t).when(op == ">", v > t).when(op == ">=", v >= t), F.lit(False))
    status = (
        F.when(coverage & v.isNotNull() & (F.col("alarm") > 0), "fail").when(v.isNull(), "pass").when(F.col("r.needs").isNotNull() & (F.col("need") <= 0), F.col("r.otherwise"))
        .when(beyond(F.col("r.fail_is"), fail_at), "fail").when(beyond(F.col("r.warn_is"), F.col("r.warn_at")), "attention").otherwise("pass")
    )
    return rows.select(key, "r.check", "r.metric", "value", status.alias("status"))


def diagnostic_summary(report: DataFrame, key: str) -> DataFrame:
    """Failed and attention counts, the highest severity (fail 2, attention 1) and the first worst check of each key."""
    level = F.when(F.col("status") == "fail", 2).when(F.col("status") == "attention", 1).otherwise(0)
    r = report.withColumn("severity", level)
    return r.groupBy(key).agg(F.count_if(level == 2).alias("failed"), F.count_if(level == 1).alias("attention"), F.max("severity").alias("max_severity"), F.min_by("check", F.struct(-F.col("severity"), F.col("check"))).alias("primary_issue"))
