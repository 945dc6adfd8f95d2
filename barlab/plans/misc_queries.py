"""Queries over smaller operators: text and ratio guards, inventories, readiness, ranks joined to cases, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.functions import scalars as C
from barlab.operators import audit as A
from barlab.operators import bars as B
from barlab.operators import orders as O
from barlab.operators import sweep as W
from barlab.plans.audit_queries import _CATALOG, _SWEEP, catalog, sweep_table
from barlab.plans.feature_queries import DAY, LIMIT, WEEK, rounded
from barlab.plans.inputs import day_bars, table, week_bars

Q: dict = {}
S: dict = {}


def add(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


@add("c11_apply_slippage", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 + CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * 7.5 / 10000), 6) AS price FROM lineitem")
def _(spark, d):
    sign = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.apply_slippage(F.col("l_extendedprice"), sign, 7.5), 6).alias("price"))


@add("c12_order_side", "SELECT o_orderkey, CASE WHEN lower(trim(s)) IN ('long', 'short') THEN lower(trim(s)) ELSE '' END AS side FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ' Long' WHEN 'O' THEN 'SHORT ' ELSE 'hold' END AS s FROM orders)")
def _(spark, d):
    s = F.expr("CASE o_orderstatus WHEN 'F' THEN ' Long' WHEN 'O' THEN 'SHORT ' ELSE 'hold' END")
    return table(spark, d, "orders").select("o_orderkey", O.side_of(s).alias("side"))


@add("c16_metric_safe_reason", "SELECT p_partkey, trim(regexp_replace(lower(trim(p_type)), '[^0-9a-zA-Z]+', '_', 'g'), '_') AS reason FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", C.metric_safe_reason(F.col("p_type")).alias("reason"))


@add("c21_trade_returns", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_tax > 0.02 THEN l_tax END, 0) / 100 AS r FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.return_as_decimal(F.when(F.col("l_tax") > 0.02, F.col("l_tax"))).alias("r"))


@add("c23_risk_fraction", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 10 AND l_extendedprice > 0 THEN l_quantity / l_extendedprice ELSE 0 END, 9) AS risk FROM lineitem")
def _(spark, d):
    risk = C.risk_fraction(F.when(F.col("l_quantity") > 10, F.col("l_quantity")), F.col("l_extendedprice"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(risk, 9).alias("risk"))


@add("c25_ratio_guards", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN 100 / c_acctbal ELSE 0 END, 9) AS guarded FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(C.ratio_or_zero(F.lit(100.0), F.col("c_acctbal")), 9).alias("guarded"))


@add("a03_limit_filter_audit", f"{DAY}, {LIMIT} SELECT s.stock_code, CASE WHEN count(b.date) = 0 THEN 'daily_missing' ELSE 'ok' END AS status, true AS filter_enabled, count(b.date) AS daily_rows, CASE WHEN count(b.date) = 0 THEN 0 ELSE (SELECT count(*) FROM blocked k WHERE k.stock_code = s.stock_code) END AS filtered_days FROM (SELECT DISTINCT stock_code FROM bars UNION SELECT '999999.SH') s LEFT JOIN bars b ON b.stock_code = s.stock_code GROUP BY s.stock_code")
def _(spark, d):
    day = day_bars(spark, d)
    asked = day.select("stock_code").union(spark.createDataFrame([("999999.SH",)], ["stock_code"]))
    return A.limit_filter_audit(asked, day, B.limit_open_dates(day))


@add("a14_cache_readiness", f"{_CATALOG} SELECT timeframe, count(*) AS total_count, count(*) FILTER (status = 'cached') AS cached_count, round(count(*) FILTER (status = 'cached') / count(*), 6) AS coverage_ratio, CASE WHEN count(*) FILTER (status = 'cached') = 0 THEN 'empty' WHEN count(*) FILTER (status = 'cached') = count(*) THEN 'ready' ELSE 'partial' END AS status FROM cat GROUP BY timeframe")
def _(spark, d):
    return rounded(A.readiness(catalog(spark, d), ["timeframe"]), ["timeframe", "total_count", "cached_count", "status"], ["coverage_ratio"])


@add("a09_cache_summary", f"{_CATALOG} SELECT count(DISTINCT stock_code) AS symbols, count(*) FILTER (status = 'cached') AS cached, count(*) FILTER (status <> 'cached') AS unavailable, sum(row_count) AS rows, max(\"end\") AS latest FROM cat")
def _(spark, d):
    return A.cache_summary(catalog(spark, d), [])


@add("a15_refill_totals", f"{_CATALOG} SELECT CASE WHEN status = 'cached' THEN 'cached' ELSE 'fetch' END AS action, count(*) AS n, sum(row_count) AS rows FROM cat GROUP BY 1")
def _(spark, d):
    c = catalog(spark, d).withColumn("status", F.when(F.col("status") == "cached", "ok").otherwise(F.col("status")))
    return A.refill_plan(c).groupBy("action").agg(F.count("*").alias("n"), F.sum("row_count").alias("rows"))


@add("a43_market_bar_count", f"{WEEK} SELECT count(DISTINCT date) AS market_bars FROM bars")
def _(spark, d):
    return week_bars(spark, d).agg(F.countDistinct("date").alias("market_bars"))


@add("s06_available_symbols", f"{WEEK} SELECT DISTINCT stock_code FROM bars")
def _(spark, d):
    return week_bars(spark, d).select(B.normalize_symbol(F.col("stock_code")).alias("stock_code")).where("stock_code <> ''").distinct()


@add("s08_symbol_names", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SZ' AS stock_code, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE coalesce(n_name, '') END AS stock_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def _(spark, d):
    s = table(spark, d, "supplier").withColumn("stock_code", F.concat(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit(".SZ")))
    metadata = s.where("s_suppkey % 3 = 0").select("stock_code", F.col("s_name").alias("stock_name"))
    defaults = s.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("stock_code", F.col("n_name").alias("stock_name"))
    return A.symbol_names(s.select("stock_code"), metadata, defaults)


@add("j07_ranked_cases", f"{_SWEEP}, rk AS (SELECT case_name, row_number() OVER (ORDER BY total_return DESC, case_name) AS sweep_rank FROM sw WHERE trade_count > 280) SELECT sw.case_name, trade_count, sweep_rank FROM sw LEFT JOIN rk USING (case_name)")
def _(spark, d):
    t = sweep_table(spark, d)
    w = F.expr("row_number() OVER (ORDER BY total_return DESC, case_name)").cast("long")
    return t.select("case_name", "trade_count").join(t.where("trade_count > 280").select("case_name", w.alias("sweep_rank")), "case_name", "left")


@add("j11_sweep_cases", "SELECT a.v AS lookback, b.v AS risk_reward, s_suppkey AS symbol_key FROM (SELECT unnest([10, 20, 40]) AS v) a CROSS JOIN (SELECT unnest([1.5, 2.0]) AS v) b CROSS JOIN supplier")
def _(spark, d):
    cases = W.sweep_cases(spark, {"lookback": [10, 20, 20, 40], "risk_reward": [1.5, 2.0]})
    return cases.crossJoin(table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol_key"))).select("lookback", "risk_reward", "symbol_key")
