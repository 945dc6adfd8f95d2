"""Tables of a run's report: exposure, decision funnels, action plans, sweep overview, chart frames and orderings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions import labels
from barlab.functions.scalars import metric_safe_reason
from barlab.operators.ranks import ordinals
from barlab.operators.stats import ratio
from barlab.operators.tables import written


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def equity_exposure(curve: DataFrame, key: str = "case_id") -> DataFrame:
    """Gross, margin and net exposure, cash and open positions along each curve; ratios to a net value of 0 or less are 0."""
    cash, net = ratio(_zero(F.col("cash")), F.col("net_value")), ratio(_zero(F.col("position_value")), F.col("net_value"))
    gross, margin, count = (_zero(F.col(x).cast("double")) for x in ("gross_exposure", "margin_exposure", "open_positions"))
    pair = lambda x, name: [F.avg(x).alias(f"avg_{name}"), F.max(x).alias(f"max_{name}")]
    return curve.groupBy(key).agg(
        *pair(gross, "gross_exposure"), *pair(margin, "margin_exposure"), F.avg((gross > 0).cast("double")).alias("exposure_bar_ratio"), *pair(count, "open_positions"),
        *pair(cash, "cash_ratio"), F.min(cash).alias("min_cash_ratio"), *pair(net, "net_exposure"), F.min(net).alias("min_net_exposure"),
    )


def _primary_reason(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """The most frequent non-empty reason of each key's rows (the least on ties), its count and its share."""
    by = rows.where(F.coalesce("reason", F.lit("")) != "").groupBy(*keys, "reason").agg(F.count("*").alias("_n"))
    top = by.groupBy(*keys).agg(F.min_by("reason", F.struct(-F.col("_n"), F.col("reason"))).alias(prefix), F.max("_n").alias(f"{prefix}_count"), F.sum("_n").alias("_all"))
    return top.withColumn(f"{prefix}_rate", ratio(F.col(f"{prefix}_count"), F.col("_all"))).drop("_all")


def _funnel(decisions: DataFrame, keys: list[str], names: Sequence[str], primary: str, reasons: Sequence[str], reject: str) -> DataFrame:
    ok, no = F.col("status") == "accepted", F.col("status") == "rejected"
    every, accepted, rejected, accept_rate, reject_rate = names
    s = decisions.groupBy(*keys).agg(F.count("*").alias(every), F.count_if(ok).alias(accepted), F.count_if(no).alias(rejected), *(F.count_if(no & (F.col("reason") == r)).alias(f"{reject}_{r}_count") for r in reasons))
    s = s.join(_primary_reason(decisions.where(no), keys, primary), keys, "left").fillna("", [primary]).fillna(0, [f"{primary}_count", f"{primary}_rate"])
    return s.withColumns({accept_rate: F.col(accepted) / F.col(every), reject_rate: F.col(rejected) / F.col(every)})


# Reasons that have a counter of their own.
ORDER_REASONS = (
    "no_fill", "no_liquidity", "no_bars", "invalid_order", "duplicate_order_id", "already_open", "max_open_positions", "same_symbol_overlap", "no_capital", "actual_risk_too_high", "chase_too_far", "target_not_favorable",
)
FILTER_REASONS = ("higher_timeframe_mismatch", "higher_timeframe_no_context", "higher_timeframe_stale", "invalid_order_key", "signal_bar_no_liquidity")
_FRACTIONS = ("capital_fraction", "risk_fraction", "margin_fraction")
_ACTUAL = (("actual_risk_pct", F.max, "max"), ("actual_chase_pct", F.max, "max"), ("actual_reward_to_risk", F.min, "min"))


def order_funnel(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's orders from generated to executed: counts, rates, reject reasons and what execution made of risk and chase.

    Needs status, reason, actual_entry_price (null or 0: not executed), the fractions and the actual metrics."""
    s = _funnel(decisions, keys, ("order_count", "accepted_order_count", "rejected_order_count", "acceptance_rate", "rejection_rate"), "primary_rejected_reason", ORDER_REASONS, "rejected")
    ok, executed = F.col("status") == "accepted", F.coalesce(F.col("actual_entry_price") > 0, F.lit(False))
    both = lambda c, test, name, f, n: [_zero(F.avg(F.when(test, F.col(c)))).alias(f"avg_{name}_{c}"), _zero(f(F.when(test, F.col(c)))).alias(f"{n}_{name}_{c}")]
    aggs = [x for c in _FRACTIONS for x in both(c, ok, "accepted", F.max, "max")]
    aggs += [x for c, f, n in _ACTUAL for x in both(c, ok & executed, "accepted", f, n) + both(c, executed, "executed", f, n)]
    more = decisions.groupBy(*keys).agg(F.count_if(executed).alias("executed_order_count"), F.count_if(ok & executed).alias("accepted_executed_order_count"), *aggs)
    return s.join(more, keys)


def filter_funnel(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's signals through the strategy's filters."""
    names = ("strategy_signal_count", "strategy_accepted_signal_count", "strategy_rejected_signal_count", "strategy_filter_acceptance_rate", "strategy_filter_rejection_rate")
    return _funnel(decisions, keys, names, "primary_strategy_rejected_reason", FILTER_REASONS, "strategy_rejected")


def reason_counters(decisions: DataFrame, prefix: str = "rejected") -> DataFrame:
    """A counter for every reject reason there is: name (prefix_REASON_count) and count."""
    safe = metric_safe_reason(F.col("reason"))
    return decisions.where((F.col("status") == "rejected") & (safe != "")).groupBy(F.concat(F.lit(f"{prefix}_"), safe, F.lit("_count")).alias("name")).agg(F.count("*").alias("count"))


# The order of reject reasons of equal counts; others come at 500.
REASON_PRIORITY = {
    "no_fill": 10, "no_liquidity": 20, "no_bars": 30, "max_open_positions": 40, "same_symbol_overlap": 50, "no_capital": 60, "capital_limit": 70, "sector_limit": 80, "actual_risk_too_high": 90, "risk_too_large": 90,
    "chase_too_far": 100, "chase_too_large": 100, "target_not_favorable": 110, "invalid_order": 120, "duplicate_order_id": 130, "already_open": 140, "unknown": 999,
}


def funnel_stages(decisions: DataFrame) -> DataFrame:
    """The four stages of all orders in long form: stage, orders, share."""
    counts = {"all_orders": F.count("*"), "entry_triggered": F.count_if(F.coalesce(F.col("actual_entry_price") > 0, F.lit(False))), "filled": F.count_if(F.col("status") == "accepted"), "rejected": F.count_if(F.col("status") == "rejected")}
    one = decisions.agg(*(c.alias(n) for n, c in counts.items()))
    rows = F.array(*(F.struct(F.lit(i).alias("stage_order"), F.lit(n).alias("stage"), F.col(n).alias("orders")) for i, n in enumerate(counts)))
    return one.select(F.explode(rows).alias("x"), F.col("all_orders").alias("_all")).select("x.stage_order", "x.stage", "x.orders", ratio(F.col("x.orders"), F.col("_all")).alias("share"))


def reject_reasons(decisions: DataFrame) -> DataFrame:
    """Reject reasons by count, ties by priority: rank, reason, label, orders, share of the rejected. A row for each reason."""
    reason = F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("unknown"))
    priority = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in REASON_PRIORITY.items() for x in p)), F.col("reason")), F.lit(500))
    g = decisions.where("status = 'rejected'").groupBy(reason.alias("reason")).agg(F.count("*").alias("orders"))
    g = written(g.withColumns({"label": labels.label(F.col("reason"), labels.REASONS), "_priority": priority}))
    rejected = g.agg(F.sum("orders").alias("_all"))  # one row
    g = ordinals(g, [], [F.desc("orders"), "_priority", "label"]).withColumn("rank", (F.col("place") + 1).cast("int"))
    return g.crossJoin(F.broadcast(rejected)).select("rank", "reason", "label", "orders", (F.col("orders") / F.col("_all")).alias("share"))


def coverage_frame(audit: DataFrame, names: DataFrame) -> DataFrame:
    """Audited keys by coverage ascending: sample (name and timeframe), coverage within 0 and 1, status, missing bars."""
    named = audit.join(names, "stock_code", "left")
    own = F.coalesce(F.nullif("stock_name", F.lit("")), "stock_code")
    out = named.select(
        F.concat(own, F.lit(" · "), F.col("timeframe")).alias("sample"), "stock_code", "timeframe", F.least(F.greatest(_zero(F.col("coverage_ratio")), F.lit(0.0)), F.lit(1.0)).alias("coverage"), "status",
        (F.col("expected_count") - F.col("actual_count")).alias("missing"),
    )
    return out.orderBy("coverage", "sample")


#: What to look into where a check doesn't pass, and the tables of a run to read for it.
ACTIONS = {
    "data_coverage": ("Refill the symbols with gaps, or leave them out, and run again.", "data_coverage; data_gap_episodes"),
    "trade_sample": ("Add symbols or time: so few trades say little about the settings.", "trades; setup_stats"),
    "order_acceptance": ("Count the reject reasons to see whether signals, limits or fills stop the orders.", "order_decisions; order_decision_stats"),
    "strategy_filter": ("Loosen the filter that rejects the most signals, one at a time.", "filter_decisions; strategy_filter_stats"),
    "drawdown_pressure": ("Open the deepest episode and list the trades that were on in it.", "drawdown_episodes; equity_curve"),
    "profit_quality": ("Split profit and loss by setup to find what loses.", "setup_stats; trade_path_distribution"),
    "win_rate_edge": ("Compare the ratio of mean win to mean loss with the rate of wins it needs.", "stats; detector_stats"),
    "positive_expectancy": ("Read the interval of the mean return before its value.", "stats; trades"),
    "exit_structure": ("Move the stop, the target or the holding limit that ends most trades.", "exit_reason_stats; signal_lifecycle_stats"),
    "monthly_stability": ("Look for one symbol or one event behind the worst month.", "monthly_returns; symbol_stats"),
    "path_risk": ("Set the stop against how far trades go wrong before they end.", "trade_path_distribution; trades"),
    "capital_exposure": ("Cut the size of positions or how many are open at once.", "equity_curve; order_decisions"),
}
OTHER_ACTION = ("Read the report's row and the tables of the run.", "diagnostics; artifact_index")


def action_plan(report: DataFrame, key: str, checks: Sequence[str]) -> DataFrame:
    """Each key's checks that don't pass, worst first and then in the order of `checks`: priority, check, status, action, evidence."""
    level = F.when(F.col("status") == "fail", 2).when(F.col("status") == "attention", 1).otherwise(0)
    place = F.array_position(F.array(*map(F.lit, checks)), F.col("check"))
    w = Window.partitionBy(key).orderBy(F.desc("severity"), place, "check")
    text = lambda i: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in ACTIONS.items() for x in (k, v[i]))), F.col("check")), F.lit(OTHER_ACTION[i]))
    rows = report.withColumn("severity", level).where("severity > 0").withColumn("priority", F.row_number().over(w))
    return rows.select(key, "priority", "check", "status", text(0).alias("action"), text(1).alias("evidence"))


def sweep_summary(ranked: DataFrame, grid_case_count: int) -> DataFrame:
    """One row over a ranked sweep: cases, best by rank and by risk-adjusted score, and the scores' mean, median and worst."""
    at = lambda c, by: F.min_by(c, by)
    best = F.struct(-F.col("risk_adjusted_score"), F.col("sweep_rank"))
    return ranked.agg(
        F.count("*").alias("case_count"), F.lit(grid_case_count).cast("long").alias("grid_case_count"), F.count_if(F.col("is_pareto_efficient")).alias("pareto_case_count"), at("case_name", "sweep_rank").alias("best_case_name"),
        at("total_return", "sweep_rank").alias("best_total_return"), at("case_name", best).alias("best_risk_adjusted_case_name"), F.max("risk_adjusted_score").alias("best_risk_adjusted_score"),
        F.avg("risk_adjusted_score").alias("avg_risk_adjusted_score"), F.expr("percentile(risk_adjusted_score, 0.5)").alias("median_risk_adjusted_score"), F.min("risk_adjusted_score").alias("worst_risk_adjusted_score"),
        F.sum("trade_count").alias("case_trade_count"), F.count_if(F.col("trade_count") == 0).alias("case_zero_trade_row_count"),
    )


def dated_equity(equity: DataFrame, trades: DataFrame, keys: list[str]) -> DataFrame:
    """A trade-numbered curve with the trades' exit dates; the starting point has the first exit. trades: keys, trade_no, exit_date."""
    first = trades.groupBy(*keys).agg(F.min("exit_date").alias("_first"))
    e = equity.drop("date").join(trades.select(*keys, "trade_no", F.col("exit_date").alias("date")), [*keys, "trade_no"], "left").join(first, keys, "left")
    return e.withColumn("date", F.when(F.col("trade_no") == 0, F.col("_first")).otherwise(F.col("date"))).drop("_first")


def trade_annotations(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """Entry and exit markers of trades on the bars' axis: order_id, kind, date, price and the position of the last bar at or before.

    Markers and bars are put in one order for each symbol, and each marker takes the position of the bar before it."""
    at = F.expr("row_number() OVER (PARTITION BY stock_code ORDER BY date) - 1")
    b = bars.select("stock_code", "date", F.lit(0).alias("_k"), at.alias("bar_index"))
    kinds = [("entry", "entry_date", "entry_price"), ("exit", "exit_date", "exit_price")]
    marks = reduce(DataFrame.unionByName, (trades.select("stock_code", "order_id", "side", F.lit(k).alias("kind"), F.col(d).alias("date"), F.col(p).alias("price"), "stop_price", F.lit(1).alias("_k")) for k, d, p in kinds))
    w = Window.partitionBy("stock_code").orderBy("date", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = b.unionByName(marks, allowMissingColumns=True).withColumn("bar_index", F.last("bar_index", ignorenulls=True).over(w))
    return both.where("_k = 1").drop("_k")


def holding_intervals(marks: DataFrame) -> DataFrame:
    """Each trade from its entry bar to its exit bar, with its stop: the segments that a chart draws."""
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return marks.groupBy("stock_code", "order_id", "side").agg(pick("entry", "bar_index").alias("from_index"), pick("exit", "bar_index").alias("to_index"), F.max("stop_price").alias("stop_price"))


def rebased_equity(curve: DataFrame, key: str = "case_id") -> DataFrame:
    """Each curve over its first value."""
    first = F.first("net_value").over(Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return curve.withColumn("rebased", F.col("net_value") / first)


def period_streaks(periods: DataFrame, key: str = "case_id") -> DataFrame:
    """Longest runs of winning and losing periods, of periods under water, and the run under water at the end."""
    w = Window.partitionBy(key).orderBy("period")
    peak = F.max("end_net_value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    p = periods.withColumns({"win": F.col("return") > 0, "loss": F.col("return") < 0, "under": F.col("end_net_value") < peak})
    for f in ("win", "loss", "under"):
        p = p.withColumn(f"_{f}", F.sum((~F.col(f)).cast("int")).over(w))
        p = p.withColumn(f"_{f}", F.sum(F.col(f).cast("int")).over(Window.partitionBy(key, f"_{f}").orderBy("period")))
    longest = lambda f, name: F.coalesce(F.max(f"_{f}"), F.lit(0)).cast("long").alias(name)
    return p.groupBy(key).agg(longest("win", "max_consecutive_wins"), longest("loss", "max_consecutive_losses"), longest("under", "max_recovery_periods"), F.max_by("_under", "period").cast("long").alias("current_underwater_periods"))


def ordered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df sorted by those of the columns that it has, nulls last."""
    by = [F.col(c).asc_nulls_last() for c in columns if c in df.columns]
    return df.orderBy(*by) if by else df


# The orders of trades, orders and filter decisions.
TRADE_ORDER = ("entry_date", "stock_code", "order_id")
SIMULATION_ORDER = ("signal_date", "stock_code", "order_id", "order_sequence")
FILTER_ORDER = ("signal_date", "stock_code", "signal_bar_index", "order_id")


def place_in_order(df: DataFrame, columns: Sequence[str], name: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds the position (from 1) of each row in an order, within each value of some columns."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*(F.col(c).asc_nulls_last() for c in columns))))


def configured_order(stats: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """stats with `configured_rank`: the position (from 0) of a name in the configuration, unknown names after all."""
    return stats.withColumn("configured_rank", F.when(F.array_contains(F.array(*map(F.lit, names)), F.col(column)), F.array_position(F.array(*map(F.lit, names)), F.col(column)) - 1).otherwise(len(names)))


def union_frames(frames: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """UNION ALL of frames, each completed with nulls to the columns."""
    full = [f.select(*(F.col(c) if c in f.columns else F.lit(None).alias(c) for c in columns)) for f in frames]
    return reduce(DataFrame.unionByName, full)


def decision_records(matched: DataFrame, trades: DataFrame) -> DataFrame:
    """Accepted and rejected orders in one table; of what both know, the trade's value goes before the order's."""
    t = trades.select("order_id", F.col("entry_price").alias("_entry"), "exit_price", "exit_reason", "return_pct")
    status = F.when(F.col("reason") == "", "accepted").otherwise("rejected")
    return matched.join(t, "order_id", "left").withColumns({"status": status, "entry_price": F.coalesce("_entry", "entry_price")}).drop("_entry")


def sector_of(metadata_sector: Column, mapped: Column, default: str = "unknown") -> Column:
    """An order's sector: its own unless empty or the default, else the symbol's, else the default."""
    own = F.trim(F.coalesce(metadata_sector, F.lit(default)))
    return F.when((own != "") & (own != default), own).otherwise(F.coalesce(F.nullif(F.trim(mapped), F.lit("")), F.nullif(own, F.lit("")), F.lit(default)))


def with_cases(orders: DataFrame, cases: DataFrame) -> DataFrame:
    """Every order for every case (case_name, risk_reward, max_holding_bars): target and holding follow the case, which
    becomes part of the order id. Cases are grid points, few beside the orders, and are broadcast."""
    risk = F.abs(F.col("entry_price") - F.col("stop_price"))
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    out = orders.drop("max_holding_bars", "case_name").crossJoin(F.broadcast(cases))
    return out.withColumns({"order_id": F.concat("case_name", F.lit("/"), "order_id"), "target_price": F.col("entry_price") + sign * risk * F.col("risk_reward")})
