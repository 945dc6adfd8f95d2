"""Equity curves: drawdown paths, episodes, calendar periods and return statistics, for each case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.operators.stats import ratio


def price_path(curve: DataFrame, key: str = "case_id") -> DataFrame:
    """Two points a bar, the adverse value before the settled one; one point where they agree within 1e-12."""
    adverse = F.coalesce("drawdown_net_value", "net_value") if "drawdown_net_value" in curve.columns else F.col("net_value")
    points = F.array(F.struct(F.lit(0).alias("step"), adverse.alias("value"), F.lit("adverse_price").alias("kind")), F.struct(F.lit(1).alias("step"), F.col("net_value").alias("value"), F.lit("settlement").alias("kind")))
    same = F.abs(F.col("net_value") - adverse) <= 1e-12
    kept = F.filter(points, lambda x: x["value"].isNotNull() & ((x["step"] == 1) | ~F.coalesce(same, F.lit(False))))
    return curve.select(key, "date", F.explode(kept).alias("x")).select(key, "date", "x.step", "x.value", "x.kind")


def _fall(value: Column, peak: Column) -> Column:
    """value / peak - 1 as IEEE has it, of a value that is not above its peak. A compounded value may run down to 0 from
    below before it was ever above: then the peak is 0, and the fall is not a number, or infinite from a value below 0."""
    lost = F.when(value < 0, float("-inf")).otherwise(float("nan"))
    return F.when(peak == 0, lost).otherwise(value / peak) - 1


def drawdown_curve(curve: DataFrame, key: str = "case_id") -> DataFrame:
    """price_path with peak and drawdown."""
    w = Window.partitionBy(key).orderBy("date", "step").rowsBetween(Window.unboundedPreceding, 0)
    p = price_path(curve, key).withColumn("peak", F.max("value").over(w))
    return p.withColumn("drawdown", _fall(F.col("value"), F.col("peak")))


def drawdown_episodes(curve: DataFrame, key: str = "case_id", limit: int | None = None) -> DataFrame:
    """Each stretch below a peak: start, trough, recovery (null if open), depth and points; ranked by depth."""
    w = Window.partitionBy(key).orderBy("date", "step")
    d = drawdown_curve(curve, key).withColumn("_new", (F.col("drawdown") >= 0).cast("int"))
    d = d.withColumn("_e", F.sum("_new").over(w)).withColumn("_next", F.lead("date").over(w))
    e = d.groupBy(key, "_e").agg(
        F.min_by("date", F.struct("date", "step")).alias("peak_date"), F.min("drawdown").alias("depth"), F.min_by("date", F.struct("drawdown", "date", "step")).alias("trough_date"),
        F.max_by("_next", F.struct("date", "step")).alias("recovery_date"), F.sum(1 - F.col("_new")).alias("points"),
    )
    e = e.where("depth < 0").drop("_e").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("depth", "peak_date")))
    return e.where(F.col("rank") <= limit) if limit else e


def drawdown_statistics(curve: DataFrame, key: str = "case_id") -> DataFrame:
    """Depth, Ulcer index and share of bars under water, each bar by its worst point."""
    bars = drawdown_curve(curve, key).groupBy(key, "date").agg(F.min("drawdown").alias("dd"))
    return bars.groupBy(key).agg(F.min("dd").alias("max_drawdown"), F.avg("dd").alias("avg_drawdown"), F.max_by("dd", "date").alias("current_drawdown"), F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer_index"), F.avg((F.col("dd") < 0).cast("double")).alias("underwater_ratio"))


def period_returns(curve: DataFrame, unit: str = "month", key: str = "case_id") -> DataFrame:
    """Calendar periods: each starts at the last value of the one before; drawdown within from that start, 0 where nothing is left to lose."""
    w, order = Window.partitionBy(key).orderBy("period"), Window.partitionBy(key, "period").orderBy("date", "step")
    c = curve.where("date IS NOT NULL AND net_value IS NOT NULL").withColumn("period", F.date_trunc(unit, "date").cast("date"))
    g = c.groupBy(key, "period").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.min_by("net_value", "date").alias("_first"), F.max_by("net_value", "date").alias("end_net_value"), F.count("*").alias("observation_count"))
    g = g.withColumn("start_net_value", F.coalesce(F.lag("end_net_value").over(w), "_first")).drop("_first")
    p = price_path(c, key).withColumn("period", F.date_trunc(unit, "date").cast("date")).join(g.select(key, "period", "start_net_value"), [key, "period"])
    p = p.withColumn("_peak", F.greatest("start_net_value", F.max("value").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    dd = p.groupBy(key, "period").agg(F.least(F.lit(0.0), F.min(F.try_divide("value", "_peak") - 1)).alias("max_drawdown"))
    return g.join(dd, [key, "period"]).withColumn("return", ratio(F.col("end_net_value") - F.col("start_net_value"), F.col("start_net_value")))


def period_statistics(periods: DataFrame, key: str = "case_id") -> DataFrame:
    """Stability over periods: count, win rate, mean, deviation, best and worst with their labels."""
    r = F.col("return")
    return periods.groupBy(key).agg(F.count("*").alias("period_count"), F.avg((r > 0).cast("double")).alias("period_win_rate"), F.avg(r).alias("period_avg_return"), F.stddev_pop(r).alias("period_return_std"), F.max(r).alias("period_best_return"), F.min(r).alias("period_worst_return"), F.max_by("period", F.struct(r, -F.unix_date("period"))).alias("period_best"), F.min_by("period", F.struct(r, F.col("period"))).alias("period_worst"))


def return_statistics(curve: DataFrame, key: str = "case_id") -> DataFrame:
    """Total and annualised returns; periods a year follow from the median spacing (252, or by 4-hour days if closer)."""
    w = Window.partitionBy(key).orderBy("date")
    c = curve.withColumns({"_r": F.col("net_value") / F.lag("net_value").over(w) - 1, "_gap": F.expr(f"unix_micros(date::timestamp) - unix_micros(lag(date) OVER (PARTITION BY {key} ORDER BY date)::timestamp)")})
    s = c.groupBy(key).agg(
        (F.max_by("net_value", "date") / F.min_by("net_value", "date") - 1).alias("total_return"), F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("equity_return_std"),
        F.sqrt(F.avg(F.when(F.col("_r").isNotNull(), F.pow(F.least("_r", F.lit(0.0)), F.lit(2.0))))).alias("_d"), F.count("_r").alias("_n"), F.expr("percentile(_gap, 0.5)").alias("_g"),
    )
    hours = F.col("_g") / 3.6e9
    s = s.withColumn("periods_per_year", F.when(hours < 4, 252 * 4 / hours).otherwise(252.0))
    root = F.sqrt("periods_per_year")
    return s.select(key, "total_return", "equity_return_std", ratio(F.col("_m"), F.col("equity_return_std")).alias("equity_sharpe"), ratio(F.col("_m"), F.col("_d")).alias("equity_sortino"), (F.col("equity_return_std") * root).alias("annualized_volatility"), (F.pow(1 + F.col("total_return"), F.col("periods_per_year") / F.col("_n")) - 1).alias("annualized_return"))
