"""Trade statistics: conditional aggregates and windows over trades in exit order, for any keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.operators import ranks
from barlab.operators.ranks import checked_broadcast, join_keys, longest_runs, ordinals, quantiles, running

Z = 1.96
EXIT_REASONS = ("stop_loss", "take_profit", "trailing_take_profit", "max_holding", "end_of_data")


def ratio(x: Column, y: Column) -> Column:
    """x / y, or 0 where y is not positive."""
    return F.coalesce(x / F.when(y > 0, y), F.lit(0.0))


def returns() -> Column:
    return F.coalesce(F.col("return_pct"), F.lit(0.0)) / 100


def _most(df: DataFrame) -> int:
    return df.agg(F.max("total")).first()[0] or 0


def _compounded(placed: DataFrame, keys: list[str], most: int, block: int) -> DataFrame:
    """Adds equity, compounded from 1 over the places, and its running peak, 1 at least."""
    p = running(placed, keys, {"equity": ("product", 1 + F.col("r"))}, most, block=block)
    p = running(p, keys, {"peak": ("max", F.col("equity"))}, most, block=block)
    return p.withColumn("peak", F.greatest(F.lit(1.0), "peak"))


def _ordered(trades: DataFrame, keys: list[str], tie: str, columns: list[str]) -> DataFrame:
    """The columns with r, place and total, numbered by exit, else entry, else signal date, then `tie`."""
    at = F.coalesce(*(c for c in ("exit_date", "entry_date", "signal_date") if c in trades.columns))
    rows = trades.select(*dict.fromkeys([*keys, *columns]), returns().alias("r"), at.alias("_when"), F.col(tie).alias("_tie"))
    return ordinals(rows, keys, [F.col("_when").asc_nulls_last(), "_tie"]).drop("_when", "_tie")


def trade_path(trades: DataFrame, keys: list[str], tie: str = "order_id", block: int = ranks.BLOCK) -> DataFrame:
    """trades with r, seq (by exit, else entry, else signal date), equity compounded from 1, and its running peak."""
    placed = _ordered(ranks.written(trades), keys, tie, trades.columns)
    return _compounded(placed, keys, _most(placed), block).withColumn("seq", F.col("place") + 1).drop("place", "total")


def wilson(rate: Column, n: Column) -> tuple[Column, Column]:
    z2 = Z * Z
    centre, spread = rate + z2 / (2 * n), Z * F.sqrt(rate * (1 - rate) / n + z2 / (4 * n * n))
    return F.greatest(F.lit(0.0), (centre - spread) / (1 + z2 / n)), F.least(F.lit(1.0), (centre + spread) / (1 + z2 / n))


TERMS = 160  # of the error function's series, enough for 15 digits where it is not 1


def erf(z: Column) -> Column:
    """The error function by its series of positive terms, folded from the last; 1 beyond 6."""
    x = F.abs(z)
    total = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), lambda a, n: 1 + a * 2 * x * x / (2 * n + 1))
    return F.signum(z) * F.when(x > 6, 1.0).otherwise(2 / math.sqrt(math.pi) * x * F.exp(-x * x) * total)


def positive_expectancy(mean: Column, error: Column) -> Column:
    """Normal probability that the true mean is positive; without error 1, 0 or a half."""
    flat = F.when(mean > 0, 1.0).when(mean < 0, 0.0).otherwise(0.5)
    return F.when(error > 0, 0.5 * (1 + erf(mean / F.when(error > 0, error) / math.sqrt(2)))).otherwise(flat)


def trade_exposure(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Holding bars, capital and margin turnover of each key's trades, and returns for each bar of exposure.

    Needs return_pct; nulls count as 0. Without holding_bars, capital_fraction or margin_fraction these are 0, without
    raw_return_pct the return stands for it."""
    zero = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in trades.columns else F.lit(0.0)
    h, c, m = map(zero, ("holding_bars", "capital_fraction", "margin_fraction"))
    raw = zero("raw_return_pct") / 100 if "raw_return_pct" in trades.columns else returns()
    s = trades.groupBy(*keys).agg(
        F.sum(h).alias("exposure_bars"), F.sum(returns()).alias("return_contribution"), F.sum(c).alias("capital_turnover"), F.avg(c).alias("avg_capital_fraction"), F.max(c).alias("max_capital_fraction"),
        F.sum(m).alias("margin_turnover"), F.avg(m).alias("avg_margin_fraction"), F.max(m).alias("max_margin_fraction"), F.sum(h * c).alias("capital_exposure_bars"), F.sum(h * m).alias("margin_exposure_bars"),
        F.avg(h * c).alias("avg_capital_exposure_per_trade"), F.avg(h * m).alias("avg_margin_exposure_per_trade"), ratio(F.sum(raw * c), F.sum(c)).alias("capital_weighted_raw_return"),
    )
    per = {"return_per_exposure_bar": "exposure_bars", "return_per_capital_exposure_bar": "capital_exposure_bars", "return_per_margin_exposure_bar": "margin_exposure_bars"}
    return s.withColumns({name: ratio(F.col("return_contribution"), F.col(of)) for name, of in per.items()})


def _path_statistics(trades: DataFrame, keys: list[str], tie: str, block: int, wanted: set[str]) -> DataFrame:
    """What depends on the order of trades: total return, worst fall, and the longest winning, losing and underwater runs (those wanted)."""
    placed = _ordered(trades, keys, tie, [])
    most = _most(placed)
    p = _compounded(placed, keys, most, block)
    ends = p.groupBy(*keys).agg((F.max_by("equity", "place") - 1).alias("total_return"), F.least(F.lit(0.0), F.min(F.col("equity") / F.col("peak") - 1)).alias("max_drawdown"))
    flags = {n: f for n, f in (("max_consecutive_wins", F.col("r") > 0), ("max_consecutive_losses", F.col("r") < 0), ("max_drawdown_duration", F.col("equity") < F.col("peak"))) if n in wanted}
    if not flags:
        return ends
    runs = longest_runs(p, keys, flags, most, block=block)
    return join_keys(ends, runs.select(*keys, *(F.col(n).cast("double").alias(n) for n in flags)), keys)


def _tail_mean(trades: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of the returns up to return_p05."""
    low = checked_broadcast(q.select(*keys, F.col("return_p05").alias("_low")))
    tail = join_keys(trades.select(*keys, returns().alias("r")), low, keys).where("r <= _low")
    return tail.groupBy(*keys).agg(F.avg("r").alias("cvar_95"))


_USED = ("exit_date", "entry_date", "signal_date", "return_pct", "raw_return_pct", "holding_bars", "capital_fraction", "margin_fraction", "r_multiple", "mae_pct", "mfe_pct", "mae_r", "mfe_r")


# Statistics that need more than one aggregate.
RUNS = ("max_consecutive_wins", "max_consecutive_losses", "max_drawdown_duration")
PATH = ("total_return", "max_drawdown", "recovery_factor", *RUNS)
QUANTILES = ("return_p05", "return_p25", "return_p50", "return_p75", "return_p95", "median_r_multiple", "cvar_95")
EXPOSURE = (
    "exposure_bars", "return_contribution", "capital_turnover", "avg_capital_fraction", "max_capital_fraction", "margin_turnover", "avg_margin_fraction", "max_margin_fraction", "capital_exposure_bars", "margin_exposure_bars",
    "avg_capital_exposure_per_trade", "avg_margin_exposure_per_trade", "capital_weighted_raw_return", "return_per_exposure_bar", "return_per_capital_exposure_bar", "return_per_margin_exposure_bar",
)


def trade_statistics(trades: DataFrame, keys: list[str], tie: str = "order_id", block: int = ranks.BLOCK, wanted: Sequence[str] | None = None) -> DataFrame:
    """The 62 statistics of each key's trades: counts and moments by one aggregate, the path by a segmented scan,
    quantiles by ranks. Null returns count as 0, null r_multiple, MAE and MFE not at all; null keys are keys. Trades
    that tie in time go by `tie`. No window holds more than `block` rows of a key. `wanted` names some of the statistics:
    then only the passes that these need are made, and only they are returned."""
    need = set(wanted) if wanted is not None else {*PATH, *QUANTILES, *EXPOSURE}
    passes = [bool(need & set(names)) for names in (PATH, QUANTILES, EXPOSURE)]
    r, pos, neg = F.col("r"), F.col("r") > 0, F.col("r") < 0
    some = lambda c: F.coalesce(c, F.lit(0.0))
    used = [c for c in (*keys, tie, *_USED) if c in trades.columns]
    trades = trades.select(*dict.fromkeys(used))
    trades = ranks.written(trades) if any(passes) else trades  # up to five passes follow
    optional = {c: F.col(c).cast("double") if c in trades.columns else F.lit(None).cast("double") for c in ("r_multiple", "mae_pct", "mfe_pct", "mae_r", "mfe_r")}
    p = trades.select(*keys, returns().alias("r"), *((F.col(c) if c in trades.columns else F.lit(None).cast("double")).alias(c) for c in ("holding_bars",)), *(c.alias(n) for n, c in optional.items()))
    x = F.col("r_multiple")
    s = p.groupBy(*keys).agg(
        F.count("*").cast("double").alias("trade_count"), F.avg(pos.cast("double")).alias("win_rate"), F.avg(r).alias("avg_return"), F.stddev_pop(r).alias("return_std"),
        F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), F.lit(2.0)))).alias("downside_deviation"), some(F.stddev_samp(r) / F.sqrt(F.count("*"))).alias("avg_return_standard_error"),
        some(F.sum(F.when(pos, r))).alias("gross_profit"), some(-F.sum(F.when(neg, r))).alias("gross_loss"), some(F.avg(F.when(pos, r))).alias("avg_win"), some(F.avg(F.when(neg, r))).alias("avg_loss"),
        F.max(r).alias("best_trade"), F.min(r).alias("worst_trade"), F.avg(some(F.col("holding_bars").cast("double"))).alias("avg_holding_bars"),
        some(F.avg(x)).alias("avg_r_multiple"), some(F.max(x)).alias("best_r_multiple"), some(F.min(x)).alias("worst_r_multiple"), F.count(x).alias("_rc"), F.stddev_pop(x).alias("_rs"),
        some(F.sum(F.when(x > 0, x))).alias("_rp"), some(-F.sum(F.when(x < 0, x))).alias("_rn"), *(some(F.avg(c)).alias(f"avg_{c}") for c in ("mae_pct", "mfe_pct", "mae_r", "mfe_r")),
    )
    more = []
    if passes[0]:
        more.append(_path_statistics(trades, keys, tie, block, need))
    if passes[1]:
        q = quantiles(p, keys, {f"return_p{int(n * 100):02d}": ("r", n) for n in (0.05, 0.25, 0.5, 0.75, 0.95)} | {"median_r_multiple": ("r_multiple", 0.5)})
        q = ranks.written(q.withColumn("median_r_multiple", some(F.col("median_r_multiple"))))
        more += [q, _tail_mean(trades, q, keys)]
    if passes[2]:
        more.append(trade_exposure(trades, keys))
    for one in more:
        s = join_keys(s, one, keys)
    c = F.col
    low, high = wilson(c("win_rate"), c("trade_count"))
    infinite = lambda x, y: F.when(y > 0, x / F.when(y > 0, y)).when(x > 0, F.lit(float("inf"))).otherwise(0.0)
    total = c("total_return") if passes[0] else F.lit(None).cast("double")
    fall = c("max_drawdown") if passes[0] else F.lit(None).cast("double")
    s = s.withColumns(
        {
            "breakeven_win_rate": F.when(c("avg_loss") >= 0, 0.0).when(c("avg_win") <= 0, 1.0).otherwise(-c("avg_loss") / F.nullif(c("avg_win") - c("avg_loss"), F.lit(0.0))), "win_rate_ci_lower": low, "win_rate_ci_upper": high,
            "avg_return_ci_lower": c("avg_return") - Z * c("avg_return_standard_error"), "avg_return_ci_upper": c("avg_return") + Z * c("avg_return_standard_error"), "profit_factor": infinite(c("gross_profit"), c("gross_loss")),
            "r_profit_factor": infinite(c("_rp"), c("_rn")), "payoff_ratio": ratio(c("avg_win"), F.abs("avg_loss")), "sharpe_per_trade": ratio(c("avg_return"), c("return_std")), "sortino_per_trade": ratio(c("avg_return"), c("downside_deviation")),
            "recovery_factor": ratio(total, F.abs(fall)), "system_quality_number": ratio(F.sqrt("_rc") * c("avg_r_multiple"), F.when(c("_rs") > 1e-12, c("_rs"))),
            "positive_expectancy_probability": positive_expectancy(c("avg_return"), c("avg_return_standard_error")), "expectancy": c("avg_return"),
        }
    )
    s = s.withColumn("win_rate_edge", c("win_rate") - c("breakeven_win_rate")).drop("_rp", "_rn", "_rs", "_rc")
    return s if wanted is None else s.select(*keys, *(n for n in dict.fromkeys(wanted) if n not in keys))


def with_idle_keys(stats: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics with a row of zeros for each expected key that has no trades."""
    out = expected.select(*keys).distinct().join(stats, keys, "left")
    return out.fillna(0.0, [c for c in stats.columns if c not in keys])


def exit_reason_summary(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates of each exit reason, other, and the most frequent (the first listed on ties)."""
    known = F.col("exit_reason").isin(*EXIT_REASONS)
    counts = [F.count_if(F.col("exit_reason") == x).alias(f"{x}_count") for x in EXIT_REASONS] + [F.count_if(~F.coalesce(known, F.lit(False))).alias("other_count")]
    s = trades.groupBy(*keys).agg(F.count("*").alias("exit_count"), *counts)
    names = [*EXIT_REASONS, "other"]
    top = F.greatest(*(F.col(f"{x}_count") for x in names))
    primary = F.coalesce(*(F.when(F.col(f"{x}_count") == top, F.lit(x)) for x in names))
    return s.withColumns({f"{x}_rate": F.col(f"{x}_count") / F.col("exit_count") for x in names} | {"primary_exit_reason": primary, "primary_exit_reason_rate": top / F.col("exit_count")})


# Buckets as (upper edge, edge belongs to the bucket, label), the last without an edge.
BUCKETS = {
    "holding_bars": ((1, True, "1K"), (3, True, "2-3K"), (8, True, "4-8K"), (16, True, "9-16K"), (None, None, "17K+")),
    "r_multiple": ((-1, True, "<=-1R"), (0, False, "-1R~0R"), (1, False, "0R~1R"), (2, False, "1R~2R"), (None, None, ">=2R")),
    "mae_r": ((-1, True, "<=-1R"), (-0.5, True, "-1R~-0.5R"), (0, False, "-0.5R~0R"), (None, None, "0R")),
    "mfe_r": ((0, True, "0R"), (0.5, False, "0R~0.5R"), (1, False, "0.5R~1R"), (2, False, "1R~2R"), (None, None, ">=2R")),
}


def path_distribution(trades: DataFrame) -> DataFrame:
    """A histogram of trades for each dimension of BUCKETS, with win rate and averages."""

    def bucket(name: str) -> Column:
        x = F.col(name)
        inside = [(i, lab, F.lit(True) if e is None else x <= e if closed else x < e) for i, (e, closed, lab) in enumerate(BUCKETS[name])]
        return F.when(x.isNotNull(), F.coalesce(*(F.when(t, F.struct(F.lit(name).alias("dimension"), F.lit(lab).alias("bucket"), F.lit(i).alias("bucket_order"))) for i, lab, t in inside)))

    rows = trades.withColumn("r", returns()).withColumn("x", F.explode(F.array_compact(F.array(*map(bucket, BUCKETS)))))
    mean = lambda c, n: F.coalesce(F.avg(c), F.lit(0.0)).alias(n)
    return rows.groupBy("x.dimension", "x.bucket", "x.bucket_order").agg(
        F.count("*").cast("double").alias("trade_count"), mean((F.col("r") > 0).cast("double"), "win_rate"), mean("r", "avg_return"), mean("r_multiple", "avg_r_multiple"), mean("mae_r", "avg_mae_r"), mean("mfe_r", "avg_mfe_r"), mean("holding_bars", "avg_holding_bars")
    )


def decision_statistics(decisions: DataFrame, keys: list[str], metrics: tuple[str, ...] = ("actual_risk_pct", "actual_chase_pct", "actual_reward_to_risk")) -> DataFrame:
    """Counts and rates, global and within the keys, of each status and reason, with metric averages."""
    g = decisions.groupBy(*keys, "status", "reason").agg(F.count("*").alias("decision_count"), *(f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min))))
    own = Window.partitionBy(*keys)
    total = decisions.agg(F.count("*").alias("_all"))
    g = g.crossJoin(F.broadcast(total))  # one row
    return g.withColumns({"decision_rate": F.col("decision_count") / F.col("_all"), "group_decision_rate": F.col("decision_count") / F.sum("decision_count").over(own)}).drop("_all")


def equity_by_trade(trades: DataFrame, keys: list[str]) -> DataFrame:
    """trade_no, date and equity from the starting point 1 on."""
    p = trade_path(trades, keys).select(*keys, F.col("seq").alias("trade_no"), F.col("exit_date").alias("date"), "equity")
    start = p.groupBy(*keys).agg(F.lit(0).alias("trade_no"), F.min("date").alias("date"), F.lit(1.0).alias("equity"))
    return start.unionByName(p)
