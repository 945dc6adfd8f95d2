"""Events to orders, order checks, context alignment and decision logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.operators.bars import liquid, normalize_symbol, with_bar_index
from barlab.operators.features import Terminal, terminal_features

SIDES = {"both": ("long", "short"), "long_only": ("long",), "short_only": ("short",)}
DECISIONS = (
    "order_id", "event_id", "strategy_name", "base_strategy_name", "detector_name", "event_type", "stock_code", "timeframe", "signal_date",
    "signal_bar_index", "side", "status", "reason", "filter_name", "context_timeframe", "context_date", "context_state",
)


@dataclass(frozen=True)
class SignalBarStop:
    name: str = "signal_bar_stop"
    risk_reward: float = 2.0
    max_holding_bars: int = 12
    max_actual_risk_pct: float | None = None
    max_chase_pct: float | None = None
    side_mode: str = "both"


def signal_bar_liquidity(events: DataFrame, bars: DataFrame) -> DataFrame:
    """events with signal_bar_liquid: whether the signal's own bar has volume and amount; an unknown bar counts as liquid."""
    bar = with_bar_index(bars).select("stock_code", "bar_index", liquid().alias("_liquid"))
    return events.join(bar, ["stock_code", "bar_index"], "left").withColumn("signal_bar_liquid", F.coalesce("_liquid", F.lit(True))).drop("_liquid")


def judge_signals(events: DataFrame, bars: DataFrame, c: SignalBarStop = SignalBarStop()) -> DataFrame:
    """events with `reason`: '' if the event becomes an order, else why it doesn't. Unknown signal bars count as liquid."""
    e = signal_bar_liquidity(events, bars).withColumn("_side", F.lower(F.trim("direction")))
    priced = (F.col("entry_price") > 0) & (F.col("stop_price") > 0) & (F.col("entry_price") != F.col("stop_price"))
    sound = F.coalesce(priced & F.col("date").isNotNull() & (F.col("bar_index") >= 0) & (normalize_symbol(F.col("stock_code")) != ""), F.lit(False))
    ok = F.col("signal_bar_liquid")
    allowed = F.col("_side").isin(*SIDES[c.side_mode])
    reason = (
        F.when(sound & ok & allowed, "").when(~F.coalesce(F.col("_side").isin("long", "short"), F.lit(False)), "non_tradable_direction")
        .when(~allowed, "side_mode_filtered").when(~ok, "signal_bar_no_liquidity").otherwise("invalid_signal_order")
    )
    return e.withColumn("reason", reason).withColumn("order_id", F.concat(F.lit(c.name + ":"), F.coalesce("event_id", F.lit("")))).drop("signal_bar_liquid", "_side")


def signal_decisions(judged: DataFrame, c: SignalBarStop = SignalBarStop()) -> DataFrame:
    """The decision log of judge_signals."""
    d = judged.withColumns(
        {
            "strategy_name": F.lit(c.name), "base_strategy_name": F.lit(c.name), "signal_date": F.col("date"), "signal_bar_index": F.coalesce("bar_index", F.lit(-1)), "side": F.coalesce("direction", F.lit("")),
            "status": F.when(F.col("reason") == "", "accepted").otherwise("rejected"), "filter_name": F.lit("signal_bar_adapter"), "context_timeframe": F.lit(""), "context_date": F.lit(None).cast("timestamp_ntz"), "context_state": F.lit(""),
        }
    )
    return d.select(*DECISIONS)


def generate_orders(judged: DataFrame, c: SignalBarStop = SignalBarStop()) -> DataFrame:
    """Stop orders of the accepted events, with a target at risk_reward times the risk."""
    o = judged.where("reason = ''").withColumn("side", F.lower(F.trim("direction"))).withColumn("_risk", F.abs(F.col("entry_price") - F.col("stop_price")))
    sign = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    return o.select(
        "order_id", F.lit(c.name).alias("strategy_name"), "detector_name", "event_id", "event_type", "stock_code", "timeframe", F.col("date").alias("signal_date"), F.col("bar_index").alias("signal_bar_index"),
        "side", "signal_price", "entry_price", "stop_price", (F.col("entry_price") + sign * F.col("_risk") * c.risk_reward).alias("target_price"), F.lit(c.max_holding_bars).alias("max_holding_bars"),
        F.lit(c.max_actual_risk_pct).cast("double").alias("max_actual_risk_pct"), F.lit(c.max_chase_pct).cast("double").alias("max_chase_pct"),
        F.struct(F.round(F.col("_risk") / F.col("entry_price"), 12).alias("actual_risk_pct"), F.coalesce(F.round(F.abs(F.col("entry_price") - F.col("signal_price")) / F.nullif("signal_price", F.lit(0.0)), 12), F.lit(0.0)).alias("chase_pct")).alias("metadata"),
    )


def side_of(value: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(text.isin("long", "short"), text).otherwise("")


def is_protective_stop(side: Column, entry: Column, stop: Column) -> Column:
    return F.coalesce(F.when(side == "long", stop < entry).when(side == "short", stop > entry), F.lit(False))


def is_favorable_target(side: Column, entry: Column, target: Column) -> Column:
    return F.coalesce(F.when(side == "long", target > entry).when(side == "short", target < entry), F.lit(False))


def preflight_reason() -> Column:
    """Why an order can't be matched at all, '' if it can; the first fault counts."""
    c, side = F.col, side_of(F.col("side"))
    blank = lambda n: F.coalesce(F.trim(n), F.lit("")) == ""
    positive = lambda n: F.coalesce(c(n) > 0, F.lit(False))
    sound = (
        ~blank("order_id") & ~blank("event_id") & (normalize_symbol(c("stock_code")) != "") & (side != "") & c("signal_date").isNotNull() & F.coalesce(c("signal_bar_index") >= 0, F.lit(False))
        & positive("entry_price") & positive("stop_price") & positive("target_price") & is_protective_stop(side, c("entry_price"), c("stop_price"))
    )
    off = ~is_favorable_target(side, c("entry_price"), c("target_price"))
    return F.when(~sound, "invalid_order").when(off, "target_not_favorable").when(F.coalesce(c("max_holding_bars"), F.lit(1)) < 1, "invalid_order").otherwise("")


def mark_duplicates(orders: DataFrame) -> DataFrame:
    """Adds is_duplicate: the second and later occurrence of an order_id in execution order."""
    w = Window.partitionBy("order_id").orderBy("signal_date", "stock_code", "signal_bar_index")
    return orders.withColumn("is_duplicate", F.row_number().over(w) > 1)


@dataclass(frozen=True)
class Alignment:
    long_states: tuple[str, ...] = ("long", "bull", "up", "ai_long", "all_long")
    short_states: tuple[str, ...] = ("short", "bear", "down", "ai_short", "all_short")
    context_column: str = "direction"
    max_context_age: str | None = None  # an interval such as "INTERVAL 30 DAYS"


def merge_prior_context(orders: DataFrame, context: DataFrame, column: str = "direction") -> DataFrame:
    """As-of join: each order with the last context of its symbol at or before its signal date.

    Both sides are united and the last context is carried on by a window, so no pair is ever compared."""
    left = orders.select("*", F.col("signal_date").alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast("timestamp_ntz").alias("context_date"), F.lit(None).cast("string").alias("context_state"))
    right = context.where(F.col("date").isNotNull()).select("stock_code", F.col("date").alias("_t"), F.lit(0).alias("_k"), F.col("date").alias("context_date"), F.col(column).alias("context_state"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy("stock_code").orderBy(F.col("_t").asc_nulls_first(), "_k").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_k") == 0, F.struct("context_date", "context_state")), ignorenulls=True).over(w)
    out = both.withColumn("_c", F.when(F.col("_t").isNotNull(), seen)).where("_k = 1")
    return out.withColumns({"context_date": F.col("_c.context_date"), "context_state": F.col("_c.context_state")}).drop("_t", "_k", "_c")


def align_with_context(orders: DataFrame, context: DataFrame, c: Alignment = Alignment()) -> DataFrame:
    """orders with context and `reason`: '' where side and fresh context agree."""
    o = merge_prior_context(orders, context, c.context_column)
    state, side = F.lower(F.trim(F.coalesce("context_state", F.lit("")))), side_of(F.col("side"))
    agree = ((side == "long") & state.isin(*c.long_states)) | ((side == "short") & state.isin(*c.short_states))
    stale = F.expr(f"signal_date - context_date > {c.max_context_age}") if c.max_context_age else F.lit(False)
    reason = (
        F.when(F.col("signal_date").isNull() | (normalize_symbol(F.col("stock_code")) == ""), "invalid_order_key").when(F.col("context_date").isNull(), "higher_timeframe_no_context")
        .when(stale, "higher_timeframe_stale").when(~agree, "higher_timeframe_mismatch").otherwise("")
    )
    return o.withColumn("reason", reason)


def score_terminal(orders: DataFrame, bars: DataFrame, c: Terminal = Terminal()) -> DataFrame:
    """Adds terminal_score (0 to 5) and terminal_reject: orders that look like the last breakout of a trend."""
    f = terminal_features(bars, c).withColumnRenamed("bar_index", "signal_bar_index").drop("date")
    o = orders.join(f, ["stock_code", "signal_bar_index"], "left")
    yes = lambda x: F.coalesce(x.cast("int"), F.lit(0))

    def score(run: str, edge: str, progress: str, wick: str) -> Column:
        return yes(F.col(run) >= c.min_regime_bars) + yes(F.col("extension_atr") >= c.extension_atr_multiple) + yes(F.col(edge) >= c.edge_min_count) + yes(F.col(progress) <= c.weak_progress_atr) + yes(F.col(wick) >= c.wick_ratio)

    long_, short_ = F.col("side") == "long", F.col("side") == "short"
    total = F.when(long_, score("up_regime_run", "upper_edge_count", "long_progress_atr", "upper_wick_ratio")).when(short_, score("down_regime_run", "lower_edge_count", "short_progress_atr", "lower_wick_ratio")).otherwise(0)
    ready = F.coalesce(F.when(long_, F.col("up_regime_run") >= c.min_regime_bars).when(short_, F.col("down_regime_run") >= c.min_regime_bars), F.lit(False))
    o = o.withColumn("terminal_score", total)
    return o.withColumn("terminal_reject", F.coalesce(F.col("detector_name").isin(*c.detectors), F.lit(False)) & ready & (F.col("terminal_score") >= c.min_score))


def union_all(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
