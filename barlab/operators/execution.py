"""Matching orders against bars: stop entries, first-touch exits and path metrics.

An order's path, at most its holding bars, is exploded into bar indices and equi-joined with the bars, so
nothing is compared by range; exits are a `when` chain per bar and a minimum by bar per order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.operators.bars import liquid, with_bar_index
from barlab.operators.features import completed_bar_average
from barlab.operators.orders import is_favorable_target, mark_duplicates, preflight_reason, side_of


@dataclass(frozen=True)
class Execution:
    max_holding_bars: int = 12
    fee_rate: float = 0.0
    slippage_bps: float = 0.0
    intrabar_exit_policy: str = "conservative"
    trailing_activation_pct: float = 0.0
    trailing_drawdown_pct: float = 0.0
    trailing_ma_period: int = 0


def slipped(price: Column, direction: Column, c: Execution) -> Column:
    return price * (1 + direction * c.slippage_bps / 10000.0)


def execution_metrics(entry: Column, signal: Column, stop: Column, target: Column, direction: Column) -> dict[str, Column]:
    """Realised risk, chase and reward to risk, as fractions rounded to 12 digits."""
    risk = F.abs(entry - stop)
    return {
        "actual_risk_pct": F.round(risk / entry, 12), "actual_chase_pct": F.coalesce(F.round(F.when(signal > 0, F.abs(entry - signal) / F.nullif(signal, F.lit(0.0))), 12), F.lit(0.0)),
        "actual_reward_to_risk": F.coalesce(F.round(direction * (target - entry) / F.nullif(risk, F.lit(0.0)), 12), F.lit(0.0)),
    }


def match_entries(bars: DataFrame, orders: DataFrame, c: Execution = Execution()) -> DataFrame:
    """orders with `reason` ('' if filled), entry_index, entry_date, actual_entry_price and last_index."""
    b = with_bar_index(bars)
    n = b.groupBy("stock_code").agg(F.count("*").alias("_n"))
    nxt = b.select("stock_code", (F.col("bar_index") - 1).alias("signal_bar_index"), F.col("date").alias("entry_date"), F.col("open").alias("_o"), F.col("high").alias("_h"), F.col("low").alias("_l"), liquid().alias("_liq"))
    o = mark_duplicates(orders).join(n, "stock_code", "left").join(nxt, ["stock_code", "signal_bar_index"], "left")
    o = o.withColumns({"side": side_of(F.col("side")), "_d": F.when(side_of(F.col("side")) == "long", 1.0).otherwise(-1.0), "_hold": F.coalesce("max_holding_bars", F.lit(c.max_holding_bars))})
    long_, e = F.col("side") == "long", F.col("entry_price")
    fill = F.when(long_, F.greatest("_o", e)).otherwise(F.least("_o", e))
    o = o.withColumn("actual_entry_price", slipped(fill, F.col("_d"), c)).withColumn("entry_index", F.col("signal_bar_index") + 1)
    m = execution_metrics(F.col("actual_entry_price"), F.col("signal_price"), F.col("stop_price"), F.col("target_price"), F.col("_d"))
    o = o.withColumns(m)
    over = lambda x, most: F.coalesce((F.col(most) > 0) & (x > F.col(most)), F.lit(False))
    pre = preflight_reason()
    reason = (
        F.when(pre != "", pre).when(F.col("is_duplicate"), "duplicate_order_id").when(F.col("signal_bar_index") >= F.coalesce("_n", F.lit(0)), "no_bars").when(F.col("entry_date").isNull(), "no_fill").when(~F.col("_liq"), "no_liquidity")
        .when((long_ & (F.col("_h") < e)) | (~long_ & (F.col("_l") > e)), "no_fill").when(over(F.abs(F.col("actual_entry_price") - F.col("stop_price")) / F.col("actual_entry_price"), "max_actual_risk_pct"), "actual_risk_too_high")
        .when(over(F.col("actual_chase_pct"), "max_chase_pct"), "chase_too_far").when(~is_favorable_target(F.col("side"), F.col("actual_entry_price"), F.col("target_price")), "target_not_favorable").otherwise("")
    )
    o = o.withColumn("reason", reason).withColumn("last_index", F.least(F.col("_n") - 1, F.col("entry_index") + F.col("_hold")))
    return o.drop("_n", "_o", "_h", "_l", "_liq", "_hold")


def _trailing(c: Execution) -> dict[str, Column]:
    """The trailing line of each path bar from completed bars before it, null where off or not beyond the entry."""
    w = Window.partitionBy("order_id").orderBy("bar_index")
    before, long_, e = w.rowsBetween(Window.unboundedPreceding, -1), F.col("side") == "long", F.col("actual_entry_price")
    peak = F.coalesce(F.when(long_, F.max(F.when(F.col("_liq"), F.col("high")).otherwise(e)).over(before)).otherwise(F.min(F.when(F.col("_liq"), F.col("low")).otherwise(e)).over(before)), e)
    beyond = lambda x: F.when((long_ & (x > e)) | (~long_ & (x < e)), x)
    ratio = beyond(F.round(peak * (1 - F.col("_d") * c.trailing_drawdown_pct), 12)) if c.trailing_drawdown_pct > 0 else F.lit(None).cast("double")
    average = beyond(F.round(F.col("ma"), 12)) if c.trailing_ma_period >= 2 else F.lit(None).cast("double")
    line = F.when(long_, F.greatest(ratio, average)).otherwise(F.least(ratio, average))
    armed = F.col("_d") * peak >= F.col("_d") * e * (1 + F.col("_d") * c.trailing_activation_pct) if c.trailing_activation_pct > 0 else F.col("bar_index") > F.col("entry_index")
    return {"_line": F.when(armed, line)}


def _paths(bars: DataFrame, filled: DataFrame, c: Execution) -> DataFrame:
    """The bars of each filled order's path, with the trailing line (`_line`)."""
    b = completed_bar_average(with_bar_index(bars), c.trailing_ma_period, "ma") if c.trailing_ma_period >= 2 else with_bar_index(bars).withColumn("ma", F.lit(None).cast("double"))
    b = b.select("stock_code", "bar_index", "date", "open", "high", "low", "close", "ma", liquid().alias("_liq"))
    keys = filled.select("order_id", "stock_code", "side", "_d", "actual_entry_price", "stop_price", "target_price", "entry_index", F.explode(F.sequence("entry_index", "last_index")).alias("bar_index"))
    return keys.join(b, ["stock_code", "bar_index"]).withColumns(_trailing(c))


def trailing_masks(bars: DataFrame, matched: DataFrame, c: Execution) -> DataFrame:
    """order_id, bar_index, line, touched of each path bar of the filled orders: the trailing line (null while it is off or
    not on the profitable side of the entry) and whether a liquid bar trades through it."""
    p, d = _paths(bars, matched.where("reason = ''"), c), F.col("_d")
    worst = F.when(d > 0, F.col("low")).otherwise(F.col("high"))
    return p.select("order_id", "bar_index", F.col("_line").alias("line"), F.coalesce(F.col("_liq") & (d * worst <= d * F.col("_line")), F.lit(False)).alias("touched"))


def simulate(bars: DataFrame, matched: DataFrame, c: Execution = Execution()) -> DataFrame:
    """One trade for each filled order: first exit by fixed priority, returns, R and excursions."""
    filled = matched.where("reason = ''")
    p = _paths(bars, filled, c)
    col, d = F.col, F.col("_d")
    beyond = lambda x, level: col("_liq") & F.coalesce(d * x <= d * level, F.lit(False))  # noqa: E731  against the trade
    reach = lambda x, level: col("_liq") & F.coalesce(d * x >= d * level, F.lit(False))  # noqa: E731  for the trade
    worst, best = F.when(d > 0, col("low")).otherwise(col("high")), F.when(d > 0, col("high")).otherwise(col("low"))
    stop, target, line = col("stop_price"), col("target_price"), col("_line")
    hit_stop, hit_target, hit_line = beyond(worst, stop), reach(best, target), beyond(worst, line)
    brave = c.intrabar_exit_policy == "optimistic"
    out = lambda reason, price: F.struct(F.lit(reason).alias("reason"), price.alias("price"))
    loss, gain, trail = out("stop_loss", stop), out("take_profit", target), out("trailing_take_profit", line)
    exit_ = (
        F.when(beyond(col("open"), stop), out("stop_loss", col("open"))).when(reach(col("open"), target), out("take_profit", col("open"))).when(beyond(col("open"), line), out("trailing_take_profit", col("open")))
        .when(hit_stop & hit_target, gain if brave else loss).when(hit_stop & hit_line, trail if brave else loss).when(hit_target & hit_line, gain if brave else trail)
        .when(hit_target, gain).when(hit_line, trail).when(hit_stop, loss)
    )
    sofar = Window.partitionBy("order_id").orderBy("bar_index").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({"_x": exit_, "_hi": F.max(F.when(col("_liq"), col("high"))).over(sofar), "_lo": F.min(F.when(col("_liq"), col("low"))).over(sofar)})
    end = lambda reason, price: F.struct(reason.alias("reason"), price.alias("price"), col("bar_index").alias("i"), col("date").alias("date"), col("_hi").alias("hi"), col("_lo").alias("lo"))
    held = end(F.lit("max_holding"), col("close"))
    ends = p.groupBy("order_id").agg(
        F.min_by(F.when(col("_x").isNotNull(), end(col("_x.reason"), col("_x.price"))), F.when(col("_x").isNotNull(), col("bar_index"))).alias("touch"),
        F.max_by(held, F.when(col("_liq"), col("bar_index"))).alias("last_liquid"), F.max_by(held, "bar_index").alias("last"),
    )
    return settled(filled.join(ends.select("order_id", F.coalesce("touch", "last_liquid", "last").alias("e")), "order_id"), c)


def settled(t: DataFrame, c: Execution) -> DataFrame:
    """Trades from filled orders with `e`, the exit (reason, price, i, date, and the extremes hi and lo up to it)."""
    col, d = F.col, F.col("_d")
    entry, stop = col("actual_entry_price"), col("stop_price")
    t = t.withColumns({"exit_price": slipped(col("e.price"), -d, c), "exit_reason": col("e.reason"), "exit_date": col("e.date"), "holding_bars": col("e.i") - col("entry_index"), "risk_per_share": F.abs(entry - stop)})
    t = t.withColumn("return_pct", (d * (col("exit_price") / entry - 1) - 2 * c.fee_rate) * 100)
    good, bad = F.when(d > 0, col("e.hi")).otherwise(col("e.lo")), F.when(d > 0, col("e.lo")).otherwise(col("e.hi"))
    t = t.withColumns({"mfe_pct": F.round(F.coalesce(F.greatest(F.lit(0.0), d * (good / entry - 1) * 100), F.lit(0.0)), 12), "mae_pct": F.round(F.coalesce(F.least(F.lit(0.0), d * (bad / entry - 1) * 100), F.lit(0.0)), 12)})
    in_r = lambda x: F.coalesce(F.round(col(x) / 100 * entry / F.nullif("risk_per_share", F.lit(0.0)), 12), F.lit(0.0))
    t = t.withColumns({"r_multiple": in_r("return_pct"), "mae_r": in_r("mae_pct"), "mfe_r": in_r("mfe_pct")})
    return t.withColumnRenamed("entry_price", "planned_entry_price").withColumnRenamed("actual_entry_price", "entry_price").drop("_d", "e", "is_duplicate", "last_index", "reason")


def select_non_overlapping(candidates: DataFrame, keys: list[str], entry: str = "entry_date", exit_: str = "exit_date", sequence: str = "order_sequence") -> DataFrame:
    """candidates with status and reason: greedy by entry, one open position for each key.

    Each choice depends on the one before, so a key's candidates are walked in one task, in order, batch by batch: no
    more than a batch is held. Keys run in parallel. A missing entry is accepted, a missing exit frees the gate at once."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = until = None
        for b in batches:
            out = []
            for key, start, stop in zip(b["_group"], b[entry], b[exit_]):
                if key != group:
                    group, until = key, None
                taken = until is None or pd.isna(start) or start > until
                out.append("accepted" if taken else "rejected")
                if taken:
                    until = None if pd.isna(stop) else stop
            yield b.drop(columns="_group").assign(status=out, reason=["" if s == "accepted" else "already_open" for s in out])

    schema = ", ".join(f"`{n}` {t}" for n, t in candidates.dtypes) + ", status string, reason string"
    rows = candidates.withColumn("_group", F.to_json(F.struct(*keys))).repartition("_group")
    return rows.sortWithinPartitions("_group", F.col(entry).asc_nulls_last(), F.col(sequence).asc_nulls_last()).mapInPandas(walk, schema)
