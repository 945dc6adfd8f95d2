"""Queries over loading, inventories, catalogs, refills and data health, with DuckDB SQL written separately.

The market table has day bars of all suppliers as 1d and week bars of three in four as 60m, of some without dates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barlab.functions import labels as L
from barlab.operators import audit as A
from barlab.operators import catalog as K
from barlab.operators import market as M
from barlab.operators import tables as T
from barlab.plans.audit_queries import _SYMBOLS
from barlab.plans.feature_queries import LIMIT, rounded
from barlab.plans.inputs import day_bars, lineitem_bars_sql, table, week_bars

Q: dict = {}
S: dict = {}
LOW = 0.3


def add(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


_KEY = "CAST(substr(stock_code, 1, 6) AS INT)"
_MK = f"""WITH dayb AS ({lineitem_bars_sql('day')}), wkb AS ({lineitem_bars_sql('week')}),
mk AS (SELECT '1d' AS timeframe, date, stock_code, open, high, low, close, volume, amount FROM dayb UNION ALL SELECT '60m', CASE WHEN {_KEY} % 10 = 5 THEN NULL ELSE date END, stock_code, open, high, low, close, volume, amount FROM wkb WHERE {_KEY} % 4 <> 0),
sym AS (SELECT DISTINCT stock_code FROM dayb UNION SELECT '999999.SH'), ex AS (SELECT stock_code, unnest(['1d', '60m']) AS timeframe FROM sym),
inv AS (SELECT ex.stock_code, ex.timeframe, CASE WHEN count(mk.stock_code) = 0 THEN 'missing_file' WHEN count(mk.date) = 0 THEN 'no_valid_rows' ELSE 'cached' END AS status, count(DISTINCT mk.date) AS rows, min(mk.date) AS start, max(mk.date) AS "end"
  FROM ex LEFT JOIN mk ON mk.stock_code = ex.stock_code AND mk.timeframe = ex.timeframe GROUP BY ex.stock_code, ex.timeframe),
nms AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SZ' AS stock_code, CASE WHEN s_suppkey % 7 = 0 THEN s_name || ' etf' WHEN s_suppkey % 2 = 0 THEN s_name ELSE n_name END AS stock_name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
cat AS (SELECT inv.*, coalesce(stock_name, '') AS stock_name, CASE WHEN contains(upper(coalesce(stock_name, '')), 'ETF') THEN 'etf' WHEN inv.stock_code LIKE '399%.SZ' THEN 'index' WHEN substr(inv.stock_code, 1, 3) IN ('000', '001', '002', '003', '300', '301', '600') THEN 'stock' ELSE 'other' END AS asset_type FROM inv LEFT JOIN nms USING (stock_code))"""


def market(spark, d):
    key = F.substring("stock_code", 1, 6).cast("int")
    w = week_bars(spark, d).where(key % 4 != 0).withColumns({"date": F.when(key % 10 != 5, F.col("date")), "timeframe": F.lit("60m")})
    return day_bars(spark, d).withColumn("timeframe", F.lit("1d")).unionByName(w)


def days_of(mk):
    """The day bars of a market table."""
    return mk.where("timeframe = '1d'").drop("timeframe")


def symbols(spark, d, day=None):
    return (day_bars(spark, d) if day is None else day).select("stock_code").distinct().union(spark.createDataFrame([("999999.SH",)], "stock_code string"))


def inventory(spark, d, mk=None):
    mk = T.written(market(spark, d)) if mk is None else mk
    return K.inventory(mk, K.expected_keys(symbols(spark, d, days_of(mk)), ["1d", "60m"]))


def names(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    s = s.withColumn("code", F.concat(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit("_sz")))
    own = F.when(F.col("s_suppkey") % 7 == 0, F.concat("s_name", F.lit(" etf"))).when(F.col("s_suppkey") % 2 == 0, F.col("s_name"))
    return K.symbol_metadata([s.select("code", own.alias("名称")).where("`名称` IS NOT NULL"), s.select(F.col("code").alias("symbol"), F.col("n_name").alias("name"))])


def catalog(spark, d):
    return K.enrich(inventory(spark, d), names(spark, d))


def stored_market(spark, d, rows=None):
    """The market as a table on disk, and its folder."""
    folder = f"{T.shared_folder(spark)}/market-{uuid.uuid4().hex}"
    M.write_market(market(spark, d) if rows is None else rows, folder)
    return M.read_market(spark, folder), folder


_BAR = ["date", "stock_code", "open", "high", "low", "close", "volume", "amount"]


def bar_rows(df):
    return rounded(df, ["timeframe", "stock_code", "date"], _BAR[2:])


_BARS_SQL = f"timeframe, stock_code, date, {', '.join(f'round({c}, 6) AS {c}' for c in _BAR[2:])}"


@add("s01_load_bars", f"{_MK} SELECT {_BARS_SQL} FROM mk WHERE timeframe = '60m' AND date >= TIMESTAMP '1992-01-01' AND date < TIMESTAMP '1999-01-01' AND {_KEY} % 5 < 2")
def _(spark, d):
    some = symbols(spark, d).where(F.substring("stock_code", 1, 6).cast("int") % 5 < 2)
    return bar_rows(M.load(stored_market(spark, d)[0], "60m", some, "1992-01-01", "1998-12-31").withColumn("timeframe", F.lit("60m")))


@add("s02_load_daily_bars", f"{_MK} SELECT {_BARS_SQL} FROM mk WHERE timeframe = '1d' AND date >= TIMESTAMP '1992-01-01' AND date < TIMESTAMP '1999-01-01'")
def _(spark, d):
    return bar_rows(M.load(stored_market(spark, d)[0], "1d", symbols(spark, d), "1992-01-01", "1998-12-31").withColumn("timeframe", F.lit("1d")))


@add("s05_inventory", f"{_MK} SELECT * FROM inv")
def _(spark, d):
    return inventory(spark, d)


@add("s07_symbol_metadata", f"{_MK} SELECT * FROM nms")
def _(spark, d):
    return names(spark, d)


@add("s09_enriched_catalog", f"{_MK} SELECT stock_code, timeframe, status, rows, stock_name, asset_type, 'price|ohlcv|' || timeframe || '|qfq|' || stock_code AS cache_key FROM cat")
def _(spark, d):
    return catalog(spark, d).select("stock_code", "timeframe", "status", "rows", "stock_name", "asset_type", "cache_key")


@add("s10_query_catalog", f"{_MK} SELECT stock_code, timeframe, asset_type, status FROM cat WHERE asset_type IN ('etf', 'stock') AND timeframe = '60m' AND status IN ('cached', 'no_valid_rows')")
def _(spark, d):
    return K.query_catalog(catalog(spark, d), asset_type=["etf", "stock"], timeframe=["60m"], status=["cached", "no_valid_rows"], indicator=None).select("stock_code", "timeframe", "asset_type", "status")


@add("s19_cache_snapshot", f"{_MK} SELECT DISTINCT stock_code FROM cat WHERE asset_type = 'etf' AND status = 'cached'")
def _(spark, d):
    return K.snapshot(catalog(spark, d), ["etf"])


@add("s23_run_symbols", f"{_MK} SELECT sym.stock_code, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE n_name END, '') AS stock_name, CASE WHEN s_suppkey % 3 = 0 THEN 'metadata' WHEN n_name IS NOT NULL THEN 'default' ELSE 'none' END AS source FROM sym LEFT JOIN supplier ON lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SZ' = sym.stock_code LEFT JOIN nation ON n_nationkey = s_nationkey")
def _(spark, d):
    s = table(spark, d, "supplier").withColumn("stock_code", F.concat(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit(".SZ")))
    defaults = s.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("stock_code", F.col("n_name").alias("stock_name"))
    return K.run_symbols(symbols(spark, d), s.where("s_suppkey % 3 = 0").select("stock_code", F.col("s_name").alias("stock_name")), defaults)


@add("s24_symbols_from_text", f"""WITH w AS (SELECT s_suppkey, unnest([CAST(600000 + s_suppkey AS VARCHAR), CAST(300000 + s_suppkey // 2 AS VARCHAR), '']) AS t FROM supplier), six AS (SELECT s_suppkey, lpad(right(t, 6), 6, '0') AS t FROM w WHERE t <> '')
SELECT t || CASE WHEN substr(t, 1, 3) IN {K.B.SHANGHAI} THEN '.SH' WHEN substr(t, 1, 3) IN {K.B.BEIJING} THEN '.BJ' ELSE '.SZ' END AS stock_code, min(s_suppkey) AS position FROM six GROUP BY t""")
def _(spark, d):
    text = F.concat((600000 + F.col("s_suppkey")).cast("string"), F.lit(" ,； "), (300000 + F.floor(F.col("s_suppkey") / 2)).cast("string"), F.lit("\n"))
    return K.symbols_from_text(table(spark, d, "supplier").select("s_suppkey", text.alias("text")), "text", "s_suppkey")


@add("c26_symbol_list", f"SELECT DISTINCT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SZ' AS stock_code, s_suppkey AS position FROM supplier")
def _(spark, d):
    twice = table(spark, d, "supplier").select(F.explode(F.array(F.concat(F.col("s_suppkey").cast("string"), F.lit(".sz")), F.lit("bad"), F.concat(F.col("s_suppkey").cast("string"), F.lit("_SZ")))).alias("raw"), "s_suppkey")
    return K.B.unique_symbols(twice, "raw", "s_suppkey")


_LOADED = f"""{_MK}, bars AS (SELECT * FROM dayb WHERE date >= TIMESTAMP '1992-12-22' AND date < TIMESTAMP '1998-01-01'), {LIMIT}, ld AS (SELECT * FROM mk WHERE date >= TIMESTAMP '1993-01-01' AND date < TIMESTAMP '1998-01-01' AND volume > 0 AND amount > 0
  AND NOT EXISTS (SELECT 1 FROM blocked k WHERE k.stock_code = mk.stock_code AND k.session_date = CAST(mk.date AS DATE) AND k.session_date >= DATE '1993-01-01'))"""


@add("s11_load_backtest_data", f"{_LOADED} SELECT {_BARS_SQL} FROM ld WHERE timeframe = '1d'")
def _(spark, d):
    return bar_rows(M.load_backtest(stored_market(spark, d)[0], ["1d"], symbols(spark, d), "1993-01-01", "1997-12-31").bars)


@add("s12_load_multi_timeframe", f"{_LOADED} SELECT {_BARS_SQL} FROM ld")
def _(spark, d):
    return bar_rows(M.load_backtest(stored_market(spark, d)[0], ["1d", "60m"], symbols(spark, d), "1993-01-01", "1997-12-31").bars)


def health_sql(mk: str) -> str:
    """CTEs: au (an audit of the market table mk with coverage of tradable bars), gp (its gaps), h1 (its 24 totals)."""
    price = lambda test, glue="OR": f" {glue} ".join(test.format(c) for c in ("open", "high", "low", "close"))
    count = lambda test: f"count(*) FILTER (date IS NOT NULL AND ({test}))"
    odd = f"{price('{} > 0', 'AND')} AND (high < greatest(open, close) OR low > least(open, close) OR high < low)"
    return f"""tb AS (SELECT DISTINCT stock_code, timeframe, date FROM {mk} WHERE volume > 0 AND amount > 0 AND date IS NOT NULL),
gr AS (SELECT s.stock_code, s.timeframe, t.date AS at_, tb.date IS NOT NULL AS here FROM (SELECT DISTINCT stock_code, timeframe FROM tb) s JOIN (SELECT DISTINCT timeframe, date FROM {mk} WHERE date IS NOT NULL) t USING (timeframe)
  LEFT JOIN tb ON tb.stock_code = s.stock_code AND tb.timeframe = s.timeframe AND tb.date = t.date),
isl AS (SELECT *, sum(CAST(here AS INT)) OVER (PARTITION BY stock_code, timeframe ORDER BY at_) AS g FROM gr),
gp AS (SELECT stock_code, timeframe, count(*) AS n, min(at_) AS gap_start, max(at_) AS gap_end FROM isl WHERE NOT here GROUP BY stock_code, timeframe, g),
cov AS (SELECT stock_code, timeframe, count(*) AS e, count(*) FILTER (here) AS a FROM gr GROUP BY stock_code, timeframe),
gm AS (SELECT stock_code, timeframe, max(n) AS max_gap, count(*) AS gap_count, min(gap_start) AS first_missing, max(gap_end) AS last_missing FROM gp GROUP BY stock_code, timeframe),
gx AS (SELECT gp.stock_code, gp.timeframe, min(gap_start) AS max_gap_start, min(gap_end) AS max_gap_end FROM gp JOIN gm USING (stock_code, timeframe) WHERE n = max_gap GROUP BY gp.stock_code, gp.timeframe),
aa AS (SELECT stock_code, timeframe, count(date) AS row_count, count(date) - count(DISTINCT date) AS duplicate_count, count(*) - count(date) AS invalid_date_count, CAST(0 AS BIGINT) AS invalid_symbol_count, {count(price('{} IS NULL'))} AS null_price_count,
  {count(price('{} <= 0'))} AS non_positive_count, {count(odd)} AS inconsistent_count, {count('volume IS NULL OR amount IS NULL')} AS null_volume_count, {count('volume = 0 OR amount = 0')} AS zero_volume_count,
  {count('volume < 0 OR amount < 0')} AS negative_volume_count, {count('NOT (coalesce(volume, 0) > 0 AND coalesce(amount, 0) > 0)')} AS zero_liquidity_count FROM {mk} GROUP BY stock_code, timeframe),
au AS (SELECT aa.*, coalesce(e, 0) AS expected_count, coalesce(a, 0) AS actual_count, coalesce(a / e, 0) AS coverage_ratio, coalesce(max_gap, 0) AS max_gap, coalesce(gap_count, 0) AS gap_count, first_missing, last_missing, max_gap_start, max_gap_end,
  coalesce(max_gap, 0) * CASE aa.timeframe WHEN '1d' THEN 1440 ELSE 60 END AS max_gap_minutes,
  CASE WHEN duplicate_count + invalid_date_count + null_price_count + non_positive_count + inconsistent_count + null_volume_count + negative_volume_count > 0 THEN 'quality_error' WHEN row_count = zero_liquidity_count THEN 'no_window_data' ELSE 'ok' END AS status
  FROM aa LEFT JOIN cov USING (stock_code, timeframe) LEFT JOIN gm USING (stock_code, timeframe) LEFT JOIN gx USING (stock_code, timeframe)),
wg AS (SELECT * FROM au ORDER BY max_gap_minutes DESC, stock_code, timeframe LIMIT 1),
h1 AS (SELECT count(*) AS data_audit_row_count, count(*) FILTER (status = 'ok') AS data_audit_ok_count, count(*) FILTER (status <> 'ok') AS data_audit_failed_count, 0 AS data_audit_missing_file_count, 0 AS data_audit_missing_columns_count,
  count(*) FILTER (status = 'no_window_data') AS data_audit_no_window_data_count, count(*) FILTER (status = 'quality_error') AS data_audit_quality_error_count, 0 AS data_audit_read_error_count, CAST({LOW} AS DOUBLE) AS data_min_coverage_threshold,
  count(*) FILTER (expected_count > 0 AND coverage_ratio < {LOW}) AS data_coverage_below_min_count, round(count(*) FILTER (expected_count > 0 AND coverage_ratio < {LOW}) / count(*) FILTER (expected_count > 0), 6) AS data_coverage_below_min_ratio,
  sum(expected_count) AS data_expected_rows, sum(expected_count - actual_count) AS data_missing_rows, round(sum(actual_count) / sum(expected_count), 6) AS data_weighted_coverage_ratio, round(min(coverage_ratio) FILTER (expected_count > 0), 6) AS data_min_coverage_ratio,
  {', '.join(f'round(quantile_cont(CASE WHEN expected_count > 0 THEN coverage_ratio END, {q}), 6) AS data_coverage_p{n}' for q, n in ((0.05, '05'), (0.5, '50'), (0.95, '95')))}, max(max_gap_minutes) AS data_max_missing_gap_minutes,
  (SELECT strftime(max_gap_start, '%Y-%m-%d %H:%M:%S') FROM wg) AS data_max_missing_gap_start_at, (SELECT strftime(max_gap_end, '%Y-%m-%d %H:%M:%S') FROM wg) AS data_max_missing_gap_end_at,
  sum(zero_volume_count) AS data_zero_volume_amount_rows, sum(non_positive_count) AS data_non_positive_price_rows, sum(negative_volume_count) AS data_negative_volume_amount_rows FROM au)"""


_SICK = f"""{_MK}, sick0 AS (SELECT *, {_KEY} % 9 AS k, month(date) AS m FROM mk), sick1 AS (SELECT timeframe, date, stock_code, CASE WHEN k = 4 AND m = 3 THEN -open ELSE open END AS open, CASE WHEN k = 5 AND m = 2 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN k = 2 AND m = 5 THEN NULL ELSE close END AS close, CASE WHEN m = 7 OR k = 7 THEN 0 WHEN k = 1 AND m = 11 THEN -volume WHEN k = 6 AND m = 4 THEN NULL ELSE volume END AS volume, amount FROM sick0 WHERE timeframe = '60m'
  UNION ALL SELECT timeframe, date, stock_code, open, high, low, close, volume, amount FROM sick0 WHERE timeframe = '60m' AND k = 3 AND m = 9),
sick AS (SELECT * FROM sick1 UNION ALL SELECT * FROM mk WHERE timeframe = '1d')"""


def sick_market(spark, d):
    """The market with faults of every kind in its 60m bars."""
    mk = market(spark, d)
    w, k, m = mk.where("timeframe = '60m'"), F.substring("stock_code", 1, 6).cast("int") % 9, F.month("date")
    volume = F.when((m == 7) | (k == 7), 0.0).when((k == 1) & (m == 11), -F.col("volume")).when(~F.coalesce((k == 6) & (m == 4), F.lit(False)), F.col("volume"))
    odd = w.withColumns({"open": F.when((k == 4) & (m == 3), -F.col("open")).otherwise(F.col("open")), "high": F.when((k == 5) & (m == 2), F.col("low") - 1).otherwise(F.col("high")), "close": F.when(~F.coalesce((k == 2) & (m == 5), F.lit(False)), F.col("close")), "volume": volume})
    return odd.unionByName(w.where((k == 3) & (m == 9))).unionByName(mk.where("timeframe = '1d'"))


_AUDIT = ["row_count", "duplicate_count", "invalid_date_count", "invalid_symbol_count", "null_price_count", "non_positive_count", "inconsistent_count", "null_volume_count", "zero_volume_count", "negative_volume_count", "zero_liquidity_count", "expected_count", "actual_count"]
_AUDIT += ["max_gap", "max_gap_minutes", "gap_count", "first_missing", "last_missing", "max_gap_start", "max_gap_end", "status"]


@add("a01_audit", f"{_SICK}, {health_sql('sick')} SELECT stock_code, timeframe, {', '.join(_AUDIT)}, round(coverage_ratio, 6) AS coverage_ratio FROM au")
def _(spark, d):
    return rounded(K.audit_market(T.written(sick_market(spark, d))), ["stock_code", "timeframe", *_AUDIT], ["coverage_ratio"])


_HEALTH = f"""{_MK}, {health_sql('mk')}, bars AS (SELECT * FROM dayb), {LIMIT},
h2 AS (SELECT count(*) AS data_inventory_row_count, count(*) FILTER (status = 'cached') AS data_inventory_cached_count, count(*) FILTER (status <> 'cached') AS data_inventory_unavailable_count, count(*) FILTER (status = 'missing_file') AS data_inventory_missing_file_count, 0 AS data_inventory_read_error_count,
  0 AS data_inventory_missing_columns_count, count(*) FILTER (status = 'no_valid_rows') AS data_inventory_no_valid_rows_count, sum(rows) AS data_inventory_total_rows, 0 AS data_inventory_total_file_size_bytes FROM inv),
h3 AS (SELECT count(*) AS limit_filter_audit_row_count, count(*) AS limit_filter_enabled_count, count(*) - 1 AS limit_filter_ok_count, 1 AS limit_filter_failed_count, 1 AS limit_filter_daily_missing_count, 0 AS limit_filter_daily_read_error_count, 0 AS limit_filter_daily_missing_columns_count,
  0 AS limit_filter_daily_quality_error_count, (SELECT count(*) FROM blocked) AS limit_filter_filtered_days, (SELECT count(*) FROM blocked) AS filtered_limit_open_count FROM sym),
iss AS (SELECT unnest(['data_coverage_below_min', 'data_audit_no_window_data', 'data_audit_quality_error', 'data_inventory_missing_file', 'data_inventory_no_valid_rows', 'limit_filter_daily_missing']) AS i,
  unnest([data_coverage_below_min_count, data_audit_no_window_data_count, data_audit_quality_error_count, data_inventory_missing_file_count, data_inventory_no_valid_rows_count, 1]) AS n, unnest([1, 2, 3, 4, 5, 6]) AS k FROM h1, h2),
top AS (SELECT i AS primary_data_issue, n AS primary_data_issue_count, round(n / (SELECT sum(n) FROM iss), 6) AS primary_data_issue_rate FROM iss ORDER BY n DESC, k LIMIT 1)"""
_H1 = ["data_audit_row_count", "data_audit_ok_count", "data_audit_failed_count", *(f"data_audit_{s}_count" for s in K.AUDIT_STATUSES), "data_coverage_below_min_count", "data_expected_rows", "data_missing_rows", "data_max_missing_gap_minutes"]
_H1 += ["data_max_missing_gap_start_at", "data_max_missing_gap_end_at", "data_zero_volume_amount_rows", "data_non_positive_price_rows", "data_negative_volume_amount_rows"]
_H1R = ["data_min_coverage_threshold", "data_coverage_below_min_ratio", "data_weighted_coverage_ratio", "data_min_coverage_ratio", "data_coverage_p05", "data_coverage_p50", "data_coverage_p95"]
_H2 = [f"data_inventory_{n}" for n in ("row_count", "cached_count", "unavailable_count", "missing_file_count", "read_error_count", "missing_columns_count", "no_valid_rows_count", "total_rows", "total_file_size_bytes")]
_H3 = ["limit_filter_audit_row_count", "limit_filter_enabled_count", "limit_filter_ok_count", "limit_filter_failed_count", *(f"limit_filter_{s}_count" for s in K.LIMIT_STATUSES), "limit_filter_filtered_days", "filtered_limit_open_count"]


@add("a05_audit_totals", f"{_SICK}, {health_sql('sick')} SELECT {', '.join(_H1 + _H1R)} FROM h1")
def _(spark, d):
    return rounded(K.summarize_audit(K.audit_market(T.written(sick_market(spark, d))), LOW), _H1, _H1R)


def limit_rows(spark, d, mk=None):
    daily = days_of(T.written(market(spark, d)) if mk is None else mk)
    return A.limit_filter_audit(symbols(spark, d, daily), daily, K.B.limit_open_dates(daily))


@add("a06_data_management", f"{_HEALTH} SELECT {', '.join(_H1 + _H1R + _H2 + _H3)}, primary_data_issue, primary_data_issue_count, primary_data_issue_rate FROM h1, h2, h3, top")
def _(spark, d):
    mk = T.written(market(spark, d))  # audit, inventory and limit rows read it
    h = K.summarize_management(K.audit_market(mk), inventory(spark, d, mk), limit_rows(spark, d, mk), LOW)
    return rounded(h, [*_H1, *_H2, *_H3, "primary_data_issue", "primary_data_issue_count"], [*_H1R, "primary_data_issue_rate"])


@add("s13_experiment_data", f"{_HEALTH} SELECT {', '.join(_H1[:2] + _H2[:2])} FROM h1, h2")
def _(spark, d):
    return K.load_experiment(market(spark, d), "60m", "1d", symbols(spark, d), min_coverage=LOW)[1].select(*_H1[:2], *_H2[:2])


@add("f07_quality_gate", f"{_MK}, {health_sql('mk')} SELECT stock_code, timeframe, CASE WHEN status <> 'ok' THEN status ELSE 'coverage_below_min' END AS why FROM au WHERE status <> 'ok' OR coverage_ratio < {LOW}")
def _(spark, d):
    return K.failed_audits(K.audit_market(T.written(market(spark, d))), LOW)


@add("a07_inventory_summary", f"{_MK} SELECT count(*) AS data_inventory_row_count, count(*) FILTER (status = 'cached') AS data_inventory_cached_count, count(*) FILTER (status <> 'cached') AS data_inventory_unavailable_count, count(*) FILTER (status = 'no_valid_rows') AS data_inventory_no_valid_rows_count, sum(rows) AS data_inventory_total_rows FROM inv")
def _(spark, d):
    return K.summarize_inventory(inventory(spark, d)).select("data_inventory_row_count", "data_inventory_cached_count", "data_inventory_unavailable_count", "data_inventory_no_valid_rows_count", "data_inventory_total_rows")


_ISO = "coalesce(strftime({}, '%Y-%m-%dT%H:%M:%S'), '')"


_LINE = f"""'{{"end":"' || {_ISO.format('"end"')} || '","rows":' || rows || ',"start":"' || {_ISO.format('start')} || '","status":"' || status || '","stock_code":"' || stock_code || '","timeframe":"' || timeframe || '"}}'"""
_SIGNED = ", ".join(f"g{k + 1} AS (SELECT i // 64 AS i, sha256(string_agg(line, chr(10) ORDER BY i)) AS line FROM g{k} GROUP BY i // 64)" for k in range(4))


@add("c18_inventory_signature", f"{_MK}, g0 AS (SELECT row_number() OVER (ORDER BY stock_code, timeframe) - 1 AS i, {_LINE} AS line FROM inv), {_SIGNED} SELECT CASE {' '.join(f'WHEN (SELECT count(*) FROM g{k}) = 1 THEN (SELECT max(line) FROM g{k})' for k in range(1, 5))} END AS signature")
def _(spark, d):
    return K.inventory_signature(inventory(spark, d), block=64).withColumnRenamed("data_inventory_signature", "signature")


@add("a08_limit_audit_summary", f"{_MK}, bars AS (SELECT * FROM dayb), {LIMIT} SELECT count(*) AS limit_filter_audit_row_count, count(*) - 1 AS limit_filter_ok_count, 1 AS limit_filter_failed_count, 1 AS limit_filter_daily_missing_count, (SELECT count(*) FROM blocked) AS limit_filter_filtered_days FROM sym")
def _(spark, d):
    return K.summarize_limit_audit(limit_rows(spark, d)).select("limit_filter_audit_row_count", "limit_filter_ok_count", "limit_filter_failed_count", "limit_filter_daily_missing_count", "limit_filter_filtered_days")


_TYPE = "CASE asset_type WHEN 'stock' THEN '个股' WHEN 'index' THEN '指数' WHEN 'etf' THEN 'ETF' ELSE '其他' END"


@add("a12_cache_by_asset_type", f"{_MK} SELECT asset_type, {_TYPE} AS label, count(DISTINCT stock_code) AS symbols, count(*) FILTER (status = 'cached') AS cached, count(*) FILTER (status <> 'cached') AS unavailable, sum(rows) AS rows FROM cat GROUP BY asset_type")
def _(spark, d):
    c = A.cache_summary(catalog(spark, d).withColumnRenamed("rows", "row_count"), ["asset_type"])
    return c.select("asset_type", L.label(F.col("asset_type"), L.ASSET_TYPES).alias("label"), "symbols", "cached", "unavailable", "rows")


@add("c09_asset_type_label", f"{_MK} SELECT stock_code, timeframe, {_TYPE} AS label FROM cat")
def _(spark, d):
    return catalog(spark, d).select("stock_code", "timeframe", L.label(F.col("asset_type"), L.ASSET_TYPES).alias("label"))


_LOCAL = f"""{_MK}, va AS (SELECT * FROM mk WHERE date IS NOT NULL), lc AS (SELECT * FROM va WHERE {_KEY} % 3 <> 0 AND NOT ({_KEY} % 3 = 1 AND month(date) IN (2, 3))), {health_sql('lc')},
pl AS (SELECT ex.stock_code, ex.timeframe, CASE WHEN au.status IS NULL OR au.status <> 'ok' OR coverage_ratio < {LOW} THEN 'fetch' ELSE 'cached' END AS action, coalesce((SELECT count(*) FROM lc WHERE lc.stock_code = ex.stock_code AND lc.timeframe = ex.timeframe), 0) AS before_rows,
  coalesce((SELECT count(*) FROM va WHERE va.stock_code = ex.stock_code AND va.timeframe = ex.timeframe), 0) AS staged FROM ex LEFT JOIN au ON au.stock_code = ex.stock_code AND au.timeframe = ex.timeframe)"""


def local(spark, d):
    day, week = (T.written(market(spark, d).where(f"date IS NOT NULL AND timeframe = '{t}'")) for t in ("1d", "60m"))  # one after the other: half the shuffle at a time
    staged, key = day.unionByName(week), F.substring("stock_code", 1, 6).cast("int")
    return staged, staged.where((key % 3 != 0) & ~((key % 3 == 1) & F.month("date").isin(2, 3)))


def _refilled(spark, d, mode: str):
    staged, own = local(spark, d)
    wanted = T.written(K.expected_keys(symbols(spark, d, days_of(staged)), ["1d", "60m"]))
    held, folder = stored_market(spark, d, own)
    before = T.written(K.with_missing(K.audit_market(held), wanted))
    plan = M.refill(spark, folder, staged, before, LOW, mode)
    return K.refill_report(plan, before, K.with_missing(K.audit_market(M.read_market(spark, folder)), wanted)).select("stock_code", "timeframe", "action", "before_rows", "after_rows", "new_rows")


@add("s16_smart_refill", f"{_LOCAL} SELECT stock_code, timeframe, action, before_rows, CASE action WHEN 'fetch' THEN staged ELSE before_rows END AS after_rows, CASE action WHEN 'fetch' THEN staged - before_rows ELSE 0 END AS new_rows FROM pl")
def _(spark, d):
    return _refilled(spark, d, "smart")


@add("s18_forced_refill", f"{_LOCAL} SELECT stock_code, timeframe, 'fetch' AS action, before_rows, staged AS after_rows, staged - before_rows AS new_rows FROM pl")
def _(spark, d):
    return _refilled(spark, d, "force")


@add("s17_update_timeframe", f"{_LOCAL}, un AS (SELECT * FROM lc UNION SELECT * FROM va WHERE timeframe = '60m' AND date >= TIMESTAMP '1992-01-01' AND date < TIMESTAMP '1999-01-01') SELECT {_BARS_SQL} FROM un")
def _(spark, d):
    staged, own = local(spark, d)
    folder = stored_market(spark, d, own)[1]
    M.update(spark, folder, staged, "60m", "1992-01-01", "1998-12-31")
    return bar_rows(M.read_market(spark, folder))


@add("s03_upsert", f"{_MK}, va AS (SELECT * FROM mk WHERE date IS NOT NULL) SELECT timeframe, stock_code, date, {', '.join(f'round({c}, 6) AS {c}' for c in _BAR[2:5])}, round(CASE WHEN month(date) >= 6 THEN close * 2 ELSE close END, 6) AS close, round(volume, 6) AS volume, round(amount, 6) AS amount FROM va")
def _(spark, d):
    rows = market(spark, d).where("date IS NOT NULL")
    folder = stored_market(spark, d, rows.where(F.month("date") <= 9))[1]
    M.upsert(spark, folder, rows.where(F.month("date") >= 6).withColumn("close", F.col("close") * 2))
    return bar_rows(M.read_market(spark, folder))


@add("a45_coverage_frame", f"{_MK}, {health_sql('mk')} SELECT coalesce(nullif(stock_name, ''), au.stock_code) || ' · ' || timeframe AS sample, round(coverage_ratio, 6) AS coverage, status, expected_count - actual_count AS missing FROM au LEFT JOIN nms USING (stock_code)")
def _(spark, d):
    from barlab.operators.reports import coverage_frame

    return rounded(coverage_frame(K.audit_market(T.written(market(spark, d))), names(spark, d)), ["sample", "status", "missing"], ["coverage"])
