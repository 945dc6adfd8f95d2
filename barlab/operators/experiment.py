"""The tables of one run: breakdowns of the trades from one scan, decisions, equity, diagnostics and the data's health.

Breakdowns are grouping sets. Every trade gets a row for each set, with the columns outside the set null, and one pass
of the statistics over (set, columns) serves all sets; so the trades are stored once and read once, however many
breakdowns a run has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.operators import equity as Y
from barlab.operators import portfolio as P
from barlab.operators.stats import decision_statistics, exit_reason_summary, path_distribution, trade_path, trade_statistics
from barlab.operators.tables import written

#: Table -> the columns that it breaks the trades down by.
SETS: dict[str, tuple[str, ...]] = {
    "stats": (), "strategy_stats": ("strategy_name",), "detector_stats": ("detector_name",), "setup_stats": ("detector_name", "event_type", "side"), "side_stats": ("side",), "event_type_stats": ("event_type",),
    "exit_reason_stats": ("exit_reason",), "symbol_stats": ("stock_code",), "signal_lifecycle_stats": ("detector_name", "event_type", "side", "exit_reason"),
}


def breakdowns(trades: DataFrame, sets: Mapping[str, Sequence[str]] = SETS, tie: str = "order_id") -> DataFrame:
    """The 62 statistics of every set's groups: breakdown (the set's name), all sets' columns (null outside the set) and
    the statistics. No trades: no rows. A null in a column of the set is a group of its own."""
    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    of = lambda name, s: F.struct(F.lit(name).alias("breakdown"), *((F.col(c) if c in s else F.lit(None).cast("string")).alias(c) for c in columns))
    rows = trades.withColumn("_set", F.explode(F.array(*(of(n, s) for n, s in sets.items())))).drop(*columns)
    return trade_statistics(rows.select("*", "_set.*").drop("_set"), ["breakdown", *columns], tie)


def table_of(stats: DataFrame, name: str, sets: Mapping[str, Sequence[str]] = SETS) -> DataFrame:
    """One breakdown's table."""
    others = {c for s in sets.values() for c in s} - set(sets[name])
    return stats.where(F.col("breakdown") == name).drop("breakdown", *others)


def dated_curve(trades: DataFrame, tie: str = "order_id") -> DataFrame:
    """case_id, trade_no, date, net_value of all trades together: 1 at the first exit, then a point a trade."""
    p = trade_path(trades.select(F.lit("run").alias("case_id"), "exit_date", "return_pct", tie), ["case_id"], tie)
    points = p.select("case_id", F.col("seq").alias("trade_no"), F.col("exit_date").alias("date"), F.col("equity").alias("net_value"))
    first = points.groupBy("case_id").agg(F.lit(0).cast("long").alias("trade_no"), F.min("date").alias("date"), F.lit(1.0).alias("net_value"))
    return first.unionByName(points)


def daily_close(curve: DataFrame) -> DataFrame:
    """The last point of each date."""
    return curve.groupBy("case_id", "date").agg(F.max_by("net_value", "trade_no").alias("net_value"))


def run_tables(decisions: DataFrame, filters: DataFrame, trades: DataFrame, health: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a run's trading side.

    decisions: matched orders with reason ('' if filled); filters: the strategies' decision log; trades: the outcomes;
    health: one row of the data's health, if known. What is read more than once is written first."""
    decisions = written(decisions.withColumn("status", F.when(F.col("reason") == "", "accepted").otherwise("rejected")))
    filters, trades = written(filters), written(trades)
    stats = written(breakdowns(trades))
    curve = written(dated_curve(trades))
    daily = written(daily_close(curve))
    months = written(Y.period_returns(daily))
    tables = {"trades": trades, "order_decisions": decisions, "filter_decisions": filters, "equity_curve": curve, "drawdown_episodes": Y.drawdown_episodes(daily), "monthly_returns": months}
    tables |= {name: table_of(stats, name) for name in SETS}
    tables |= {
        "trade_path_distribution": path_distribution(trades), "order_decision_stats": decision_statistics(decisions, ["strategy_name", "detector_name"]), "setup_order_decision_stats": decision_statistics(decisions, ["detector_name", "event_type", "side"]),
        "strategy_filter_stats": decision_statistics(filters, ["strategy_name", "filter_name", "context_timeframe"], ()), "setup_filter_stats": decision_statistics(filters, ["detector_name", "event_type", "side", "filter_name"], ()),
    }
    one = F.lit("run").alias("case_id")
    orders = P.decision_summary(decisions.withColumn("case_id", F.lit("run")), ["case_id"]).select("case_id", "order_count", "acceptance_rate")
    passed = filters.agg((F.count_if(F.col("status") == "rejected") / F.count("*")).alias("strategy_filter_rejection_rate")).select(one, "strategy_filter_rejection_rate")
    exits = exit_reason_summary(trades.withColumn("case_id", F.lit("run")), ["case_id"]).select("case_id", "primary_exit_reason", "primary_exit_reason_rate")
    row = orders.join(passed, "case_id").join(table_of(stats, "stats").select(one, "*"), "case_id", "left").join(exits, "case_id", "left")
    row = row.join(months.groupBy("case_id").agg(F.min("return").alias("monthly_worst_return")), "case_id", "left")
    if health is not None:
        row = row.join(health.select(one, "*"), "case_id")
    return tables | {"diagnostics": P.diagnostics(row, "case_id")}
