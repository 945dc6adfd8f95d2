"""Parameter sweeps over first passages: an order's path is read once, however many cases try it.

The path of a filled order, at most its longest holding, is exploded and joined with the bars once and kept as steps:
the bars at which the running extreme for or against the trade grows, with the extreme reached. A case's target is
touched first at the first step that reaches it, its stop likewise, and what lies beyond its holding doesn't count; so
the outcome of a case is a look-up in its order's steps. Cases that differ in detector parameters share the paths of the
orders that they share. Rows exploded grow with distinct orders times the longest holding, not with cases.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.operators.bars import liquid, with_bar_index
from barlab.operators.execution import Execution, execution_metrics, match_entries, settled
from barlab.operators.orders import is_favorable_target
from barlab.operators.ranks import checked_broadcast
from barlab.operators.tables import written

#: What makes two cases' orders one path.
PATH = ["order_id", "entry_price", "stop_price"]


def sweep_orders(cases: DataFrame, parameters: Sequence[str], orders_of: Callable[..., DataFrame]) -> DataFrame:
    """The orders of each combination of detector parameters among the cases, with these as columns.

    orders_of(**parameters) gives one combination's orders; it is called once for each. Combinations are grid points:
    they are collected to plan one detector run each."""
    if not parameters:
        return orders_of()
    runs = [r.asDict() for r in cases.select(*parameters).distinct().orderBy(*parameters).collect()]
    kinds = dict(cases.dtypes)
    each = (orders_of(**run).withColumns({p: F.lit(v).cast(kinds[p]) for p, v in run.items()}) for run in runs)
    return reduce(DataFrame.unionByName, each)


def first_passages(bars: DataFrame, filled: DataFrame) -> DataFrame:
    """filled (order_id, _d, entry_index, last_index and more) with its path: `up` and `down`, the steps (k, level, open,
    date) of the liquid bars' running extremes for and against the trade, and `ends` (k, close, date, liquid) of all bars.

    k counts bars from the entry; levels and opens are multiplied by the direction, so up grows and down falls."""
    b = with_bar_index(bars).select("stock_code", "bar_index", "date", "open", "high", "low", "close", liquid().alias("_liq"))
    d = F.col("_d")
    p = filled.select("order_id", "stock_code", "_d", "entry_index", F.explode(F.sequence("entry_index", "last_index")).alias("bar_index")).join(b, ["stock_code", "bar_index"])
    best, worst = F.when(d > 0, F.col("high")).otherwise(-F.col("low")), F.when(d > 0, F.col("low")).otherwise(-F.col("high"))
    p = p.select("order_id", (F.col("bar_index") - F.col("entry_index")).cast("int").alias("k"), "date", "close", "_liq", (d * F.col("open")).alias("open"), F.when(F.col("_liq"), best).alias("best"), F.when(F.col("_liq"), worst).alias("worst"))
    before = Window.partitionBy("order_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumns({"_top": F.max("best").over(before), "_low": F.min("worst").over(before)})
    step = lambda level: F.struct("k", F.col(level).alias("level"), "open", "date")
    grown, fallen = F.col("_top").isNull() | (F.col("best") > F.col("_top")), F.col("_low").isNull() | (F.col("worst") < F.col("_low"))
    steps = p.groupBy("order_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("best").isNotNull() & grown, step("best")))).alias("up"), F.sort_array(F.collect_list(F.when(F.col("worst").isNotNull() & fallen, step("worst")))).alias("down"),
        F.sort_array(F.collect_list(F.struct("k", "close", "date", F.col("_liq").alias("liquid")))).alias("ends"),
    )
    return filled.join(steps, "order_id")


def _last(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.element_at(items, -1))


def _with_exit(tried: DataFrame, policy: str) -> DataFrame:
    """tried (paths with a case's target_price and max_holding_bars) with `e`, the exit as `settled` wants it, instead of the
    steps. It is built column by column, so that each step is looked up once."""
    c, d = F.col, F.col("_d")
    target, stop, hold = d * c("target_price"), d * c("stop_price"), c("max_holding_bars")
    t = tried.withColumns(
        {
            "_gain": F.get(F.filter("up", lambda s: (s["level"] >= target) & (s["k"] <= hold)), F.lit(0)), "_loss": F.get(F.filter("down", lambda s: (s["level"] <= stop) & (s["k"] <= hold)), F.lit(0)),
            "_within": F.filter("ends", lambda e: e["k"] <= hold),
        }
    )
    t = t.withColumns({"_at": F.least("_gain.k", "_loss.k"), "_held": F.coalesce(_last(F.filter("_within", lambda e: e["liquid"])), _last(c("_within")))})
    t = t.withColumns({"_k": F.coalesce("_at", "_held.k"), "_won": F.coalesce(c("_gain.k") == c("_at"), F.lit(False)), "_lost": F.coalesce(c("_loss.k") == c("_at"), F.lit(False))})
    t = t.withColumns({"_top": _last(F.filter("up", lambda x: x["k"] <= c("_k")))["level"], "_low": _last(F.filter("down", lambda x: x["k"] <= c("_k")))["level"], "_open": F.when(c("_won"), c("_gain.open")).otherwise(c("_loss.open"))})
    t = written(t.drop("up", "down", "ends", "_within"))  # the look-ups in one stage, what follows from them in the next
    wins = c("_won") if policy == "optimistic" else c("_won") & ~c("_lost")
    kinds = F.when(c("_at").isNull(), 0).when(c("_lost") & (c("_open") <= stop), 1).when(c("_won") & (c("_open") >= target), 2).when(wins, 3).otherwise(4)
    t = t.withColumn("_kind", kinds)
    reason = F.when(c("_kind") == 0, "max_holding").when(c("_kind").isin(2, 3), "take_profit").otherwise("stop_loss")
    price = F.when(c("_kind") == 0, c("_held.close")).when(c("_kind") == 3, c("target_price")).when(c("_kind") == 4, c("stop_price")).otherwise(d * c("_open"))
    date = F.when(c("_kind") == 0, c("_held.date")).when(c("_won"), c("_gain.date")).otherwise(c("_loss.date"))
    extremes = F.when(d > 0, c("_top")).otherwise(-c("_low")).alias("hi"), F.when(d > 0, c("_low")).otherwise(-c("_top")).alias("lo")
    e = F.struct(reason.alias("reason"), price.alias("price"), (c("entry_index") + c("_k")).alias("i"), date.alias("date"), *extremes)
    return t.withColumn("e", e).drop("_gain", "_loss", "_at", "_held", "_k", "_won", "_lost", "_top", "_low", "_open", "_kind")


def sweep_trades(bars: DataFrame, orders: DataFrame, cases: DataFrame, parameters: Sequence[str] = (), c: Execution = Execution()) -> DataFrame:
    """The trades of every case (case_name, risk_reward, max_holding_bars and the detector parameters).

    orders: as of `sweep_orders`. Targets are risk_reward times the risk away from the entry; fees, slippage and the
    policy within a bar are those of c, trailing exits are not for sweeps. case_name becomes part of the order id. The
    same trades as if each case's orders were matched and replayed by themselves."""
    if c.trailing_drawdown_pct > 0 or c.trailing_ma_period >= 2:
        raise ValueError("a trailing exit depends on the whole path: replay such cases one by one")
    sign, risk = F.when(F.col("side") == "long", 1).otherwise(-1), F.abs(F.col("entry_price") - F.col("stop_price"))
    longest = cases.agg(F.max("max_holding_bars")).first()[0]
    if longest is None:
        raise ValueError("a sweep needs cases")
    keyed = written(orders)
    # one path for each distinct order, matched with a target that no check turns away: targets are judged by case
    own = keyed.dropDuplicates(PATH).drop(*parameters).withColumn("_order_id", F.col("order_id")).withColumn("order_id", F.concat_ws("@", "order_id", F.col("entry_price").cast("string"), F.col("stop_price").cast("string")))
    own = own.withColumns({"max_holding_bars": F.lit(longest), "target_price": F.when(F.col("side") == "long", 1e300).otherwise(1e-300)})
    paths = written(first_passages(bars, match_entries(bars, own, c).where("reason = ''")).withColumn("order_id", F.col("_order_id")).drop("_order_id"))
    grid = checked_broadcast(cases)
    if parameters:
        wanted = keyed.select(*PATH, *parameters).join(grid, list(parameters)).withColumnsRenamed({"entry_price": "_e", "stop_price": "_s", "order_id": "_o"})
        tried = wanted.join(paths.drop("max_holding_bars"), (F.col("_o") == F.col("order_id")) & (F.col("_e") == F.col("entry_price")) & (F.col("_s") == F.col("stop_price"))).drop("_e", "_s", "_o")
    else:
        tried = paths.drop("max_holding_bars").crossJoin(grid)  # every order has one trade a case: this is the result's size
    tried = tried.withColumn("target_price", F.col("entry_price") + sign * risk * F.col("risk_reward"))
    favorable = (F.col("target_price") > 0) & is_favorable_target(F.col("side"), F.col("entry_price"), F.col("target_price")) & is_favorable_target(F.col("side"), F.col("actual_entry_price"), F.col("target_price"))
    tried = _with_exit(tried.where(favorable), c.intrabar_exit_policy)
    tried = tried.withColumns(execution_metrics(F.col("actual_entry_price"), F.col("signal_price"), F.col("stop_price"), F.col("target_price"), F.col("_d")))
    return settled(tried.withColumn("order_id", F.concat("case_name", F.lit("/"), "order_id")), c)
