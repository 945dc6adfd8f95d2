"""Bar tables: symbols, cleaning, limit prices and liquidity.

A bar table has date (timestamp without zone), stock_code and open, high, low, close, volume, amount
(doubles); it is unique by (stock_code, date) and its order is that of date within a symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.operators.frames import prev

PRICES = ("open", "high", "low", "close")
COLUMNS = ("date", "stock_code", *PRICES, "volume", "amount")
# Code prefixes of the exchanges.
SHANGHAI = ("600", "601", "603", "605", "688", "689")
SHENZHEN = ("000", "001", "002", "003", "300", "301")
BEIJING = ("430", "830", "831", "832", "833", "834", "835", "836", "837", "838", "839", "920")


def _zfill(digits: Column) -> Column:
    return F.when(F.length(digits) >= 6, digits).otherwise(F.lpad(digits, 6, "0"))


def normalize_symbol(value: Column) -> Column:
    """``CODE.EX`` in upper case; the exchange of a bare code follows from its prefix. Invalid or null: ''."""
    text = F.replace(F.upper(F.trim(value.cast("string"))), F.lit("_"), F.lit("."))
    code, rest = F.substring_index(text, ".", 1), F.substr(text, F.instr(text, ".") + 1, F.lit(2))
    digits, bare = F.regexp_replace(code, "[^0-9]", ""), F.regexp_replace(text, "[^0-9]", "")
    six = _zfill(F.right(bare, F.lit(6)))
    starts = lambda many: F.left(six, F.lit(3)).isin(*many)
    inferred = F.when(starts(SHANGHAI), "SH").when(starts(SHENZHEN), "SZ").when(starts(BEIJING), "BJ").otherwise("SZ")
    dotted = F.when((digits != "") & rest.isin("SH", "SZ", "BJ"), F.concat(_zfill(digits), F.lit("."), rest)).otherwise("")
    plain = F.when(bare == "", "").otherwise(F.concat(six, F.lit("."), inferred))
    return F.coalesce(F.when(F.contains(text, F.lit(".")), dotted).otherwise(plain), F.lit(""))


def unique_symbols(rows: DataFrame, column: str, order: str) -> DataFrame:
    """stock_code of the valid symbols with the position (least `order`) of their first mention."""
    named = rows.select(normalize_symbol(F.col(column)).alias("stock_code"), order).where("stock_code <> ''")
    return named.groupBy("stock_code").agg(F.min(order).alias("position"))


def _number(c: str) -> Column:
    x = F.col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def normalize_bars(frame: DataFrame, sequence: str, fallback_symbol: str = "") -> DataFrame:
    """Canonical bars; of rows with equal (stock_code, date) the last by `sequence` stays.

    Text is coerced; rows without a date, valid symbol or price go; a missing volume or amount is null."""
    symbol = "stock_code" if "stock_code" in frame.columns else "symbol" if "symbol" in frame.columns else None
    code = normalize_symbol(F.col(symbol) if symbol else F.lit(fallback_symbol))
    numbers = {c: _number(c) if c in frame.columns else F.lit(None).cast("double") for c in COLUMNS[2:]}
    rows = frame.select(F.col("date").try_cast("timestamp_ntz").alias("date"), code.alias("stock_code"), *(x.alias(c) for c, x in numbers.items()), F.col(sequence).alias("_seq"))
    rows = rows.where("stock_code <> ''").dropna(subset=["date", *PRICES])
    last = Window.partitionBy("stock_code", "date").orderBy(F.desc("_seq"))
    return rows.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").select(*COLUMNS)


def with_bar_index(bars: DataFrame) -> DataFrame:
    """Adds bar_index, the position from 0 within the symbol; bars that have it are left as they are."""
    if "bar_index" in bars.columns:
        return bars
    return bars.withColumn("bar_index", F.expr("row_number() OVER (PARTITION BY stock_code ORDER BY date) - 1"))


def board_limit_pct(symbol: Column, board: Column | None = None) -> Column:
    """The board's daily limit as a fraction."""
    code, exchange = F.substring_index(symbol, ".", 1), F.substring_index(symbol, ".", -1)
    b = F.upper(F.trim(F.coalesce(board, F.lit("")))) if board is not None else F.lit("")
    three = F.left(code, F.lit(3))
    twenty = b.isin("STAR", "KCB", "科创板", "CHINEXT", "CYB", "创业板") | ((exchange == "SH") & three.isin("688", "689")) | ((exchange == "SZ") & three.isin("300", "301"))
    thirty = b.isin("BJ", "BSE", "北交所") | (exchange == "BJ") | F.left(code, F.lit(1)).isin("4", "8") | (three == "920")
    return F.when(twenty, 0.2).when(thirty, 0.3).otherwise(0.1)


def round_to_tick(value: Column, tick: float = 0.01) -> Column:
    """To the nearest tick, halves to the even one."""
    return F.round(F.bround(value / tick) * tick, 10)


@dataclass(frozen=True)
class LimitOpen:
    tick_size: float = 0.01
    tick_tolerance: float = 0.005
    pct_tolerance: float = 0.0005


def limit_open_dates(daily: DataFrame, config: LimitOpen = LimitOpen()) -> DataFrame:
    """stock_code, session_date, limit_pct, limit_up_open of the days that open at the upper limit."""
    d = daily.withColumn("_prev", F.expr(prev("close"))).withColumn("limit_pct", board_limit_pct(F.col("stock_code")))
    d = d.withColumn("limit_up_open", round_to_tick(F.col("_prev") * (1 + F.col("limit_pct")), config.tick_size))
    exact = F.abs(F.col("open") - F.col("limit_up_open")) <= config.tick_tolerance
    near = F.try_divide("open", "_prev") - 1 >= F.col("limit_pct") - config.pct_tolerance
    return d.where(exact | near).select("stock_code", F.to_date("date").alias("session_date"), "limit_pct", "limit_up_open")


def limit_open_dates_in_window(daily: DataFrame, start: str, end: str, config: LimitOpen = LimitOpen()) -> DataFrame:
    """The same, computed with all history, kept within whole days start to end."""
    return limit_open_dates(daily, config).where(F.col("session_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def filter_limit_open_days(bars: DataFrame, daily: DataFrame, config: LimitOpen = LimitOpen()) -> DataFrame:
    """bars without the sessions that open at the limit: an anti join by symbol and day."""
    blocked = limit_open_dates(daily, config).select("stock_code", "session_date").distinct()
    return bars.withColumn("session_date", F.to_date("date")).join(blocked, ["stock_code", "session_date"], "left_anti").drop("session_date")


def liquid() -> Column:
    return F.coalesce(F.col("volume") > 0, F.lit(False)) & F.coalesce(F.col("amount") > 0, F.lit(False))


def drop_illiquid(bars: DataFrame) -> DataFrame:
    return bars.where(liquid()) if {"volume", "amount"} <= set(bars.columns) else bars


def inconsistent() -> Column:
    """Positive prices of which the high or low doesn't bound the others."""
    o, h, l, c = (F.col(x) for x in PRICES)
    positive = (o > 0) & (h > 0) & (l > 0) & (c > 0)
    return F.coalesce(positive & ((h < F.greatest(o, c)) | (l > F.least(o, c)) | (h < l)), F.lit(False))
