"""Data audits: quality counters, session coverage, gaps, down-sampling and catalog summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.operators.bars import BEIJING, SHANGHAI, SHENZHEN, inconsistent, liquid, normalize_symbol
from barlab.operators.ranks import BLOCK, checked_broadcast, join_keys, most_rows, ordinals, previous
from barlab.operators.tables import written


def audit_bars(bars: DataFrame, keys: Sequence[str] = ("stock_code",)) -> DataFrame:
    """One row for each key: nine counters of faults, the window and the status.

    row_count, start, end and the counters but invalid_date_count are of rows with a date; tradable_count is of those
    with volume and amount. Any fault but zero volume or amount is a quality_error; else no tradable row is no_window_data."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    dated = F.col("date").isNotNull()
    any_of = lambda test, cols: reduce(lambda a, b: a | b, (F.coalesce(test(c), F.lit(False)) for c in cols))
    traded = [F.col("volume"), F.col("amount")]
    faults = {
        "invalid_date_count": ~dated, "invalid_symbol_count": dated & (normalize_symbol(F.col("stock_code")) == ""), "null_price_count": dated & any_of(lambda c: c.isNull(), prices),
        "non_positive_count": dated & any_of(lambda c: c <= 0, prices), "inconsistent_count": dated & inconsistent(), "null_volume_count": dated & any_of(lambda c: c.isNull(), traded),
        "zero_volume_count": dated & any_of(lambda c: c == 0, traded), "negative_volume_count": dated & any_of(lambda c: c < 0, traded),
    }
    by_symbol = "stock_code" in keys  # then a key has one symbol, judged once for the key
    per_row = {n: test for n, test in faults.items() if not (by_symbol and n == "invalid_symbol_count")}
    a = bars.groupBy(*keys).agg(
        F.count("date").alias("row_count"), *(F.count_if(test).alias(n) for n, test in per_row.items()),
        F.count_if(dated & ~liquid()).alias("zero_liquidity_count"), F.count_if(dated & liquid()).alias("tradable_count"), F.min("date").alias("start"), F.max("date").alias("end"),
    )
    if by_symbol:
        a = a.withColumn("invalid_symbol_count", F.when(normalize_symbol(F.col("stock_code")) == "", F.col("row_count")).otherwise(0))
    # the distinct dates by themselves: beside the counters, each (key, date) would carry all of them
    dates = bars.where(dated).select(*keys, "date").distinct().groupBy(*keys).agg(F.count("*").alias("_dates"))
    a = join_keys(a, dates, keys, "left").withColumn("duplicate_count", F.col("row_count") - F.coalesce("_dates", F.lit(0)))
    a = a.select(*keys, "row_count", "duplicate_count", *faults, "zero_liquidity_count", "tradable_count", "start", "end")
    bad = reduce(lambda a, b: a + b, (F.col(n) for n in (*faults, "duplicate_count") if n != "zero_volume_count")) > 0
    return a.withColumn("status", F.when(bad, "quality_error").when(F.col("tradable_count") == 0, "no_window_data").otherwise("ok"))


def daily_sessions(bars: DataFrame) -> DataFrame:
    return bars.select("stock_code", F.to_date("date").alias("session_date")).distinct()


def calendar(points: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The expected points (`at`) of each scope, numbered: scope, at, ordinal (from 0), expected_count. Null points are none."""
    return written(ordinals(written(points.where("at IS NOT NULL").select(*scope, "at").distinct()), scope, ["at"], "ordinal", "expected_count"))


def _numbered(actual: DataFrame, days: DataFrame, keys: Sequence[str], scope: Sequence[str], block: int) -> DataFrame:
    """The distinct points of each key that its scope expects, with their ordinals, places, the point before and the key's counts.

    Where no key has over `block` rows, which one count tells, the points are dealt by key once, for the distinct ones, their places and what follows."""
    points, expected = actual.where("at IS NOT NULL").select(*keys, "at"), checked_broadcast(days)
    if most_rows(points, keys) <= block:
        own, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("ordinal")
        here = join_keys(points.repartition(*keys).distinct() if keys else points.distinct(), expected, [*scope, "at"])
        placed = here.select(*keys, "at", "ordinal", "expected_count", (F.row_number().over(order) - 1).cast("long").alias("place"), *(F.lag(c).over(order).alias(f"previous_{c}") for c in ("ordinal", "at")))
        return written(placed.withColumn("actual_count", F.count("*").over(own)))
    here = join_keys(points.distinct(), expected, [*scope, "at"])
    numbered = written(ordinals(written(here.select(*keys, "at", "ordinal", "expected_count")), keys, ["ordinal"], "place", "actual_count", block))
    return previous(numbered, keys, ["ordinal", "at"], numbered.agg(F.max("actual_count")).first()[0] or 0, block=block)


def _missing(numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each stretch of missing points by its ordinals: a gap is a jump in ordinals between a point and the one before, or the ends."""
    jump = lambda first, last, before, after: F.struct(first.alias("first"), last.alias("last"), before.alias("previous_at"), after.alias("next_at"))
    at, none = F.col("at"), F.lit(None).cast(dict(numbered.dtypes)["at"])
    inner = jump(F.coalesce(F.col("previous_ordinal") + 1, F.lit(0)), F.col("ordinal") - 1, F.col("previous_at"), at)
    final = F.when(F.col("place") == F.col("actual_count") - 1, jump(F.col("ordinal") + 1, F.col("expected_count") - 1, at, none))
    gaps = numbered.select(*keys, F.explode(F.array_compact(F.array(inner, final))).alias("g")).where("g.last >= g.first")
    return gaps.select(*keys, "g.*", (F.col("g.last") - F.col("g.first") + 1).alias("missing_count"))


def _dated(rows: DataFrame, days: DataFrame, scope: Sequence[str], names: dict[str, str]) -> DataFrame:
    """rows with ordinals looked up in the calendar; names: ordinal column -> name of its point."""
    for ordinal, name in names.items():
        rows = join_keys(rows, checked_broadcast(days.select(*scope, F.col("ordinal").alias(ordinal), F.col("at").alias(name))), [*scope, ordinal])
    return rows.drop(*names)


def gap_episodes(actual: DataFrame, days: DataFrame, keys: Sequence[str] = ("stock_code",), scope: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """keys, gap_start, gap_end, missing_count, previous_at, next_at: runs of consecutive missing points with the present
    points around them (null at the ends). actual: keys and `at`; days: see `calendar`; scope is among the keys. Keys
    without any expected point are not among the rows: they have no ends to count from."""
    gaps = _dated(_missing(_numbered(actual, days, keys, scope, block), keys), days, scope, {"first": "gap_start", "last": "gap_end"})
    return gaps.select(*keys, "gap_start", "gap_end", "missing_count", "previous_at", "next_at")


#: Ordinals of a calendar stay below this, so that a gap's length and start fit one long.
MOST_POINTS = 2**31 - 1


def coverage(actual: DataFrame, days: DataFrame, keys: Sequence[str] = ("stock_code",), scope: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """For each key the expected and present points, their ratio, and the gaps: how many, the longest (the first on ties)
    with its ends, the first and last missing point. Counts follow from the calendar's size, so no key is paired with
    all points. Points that the calendar lacks don't count. Gaps are folded as ordinals; only a key's few are dated."""
    numbered = _numbered(actual, days, keys, scope, block)
    counts = numbered.groupBy(*keys).agg(F.max("expected_count").alias("expected_count"), F.count("*").alias("actual_count"))
    longest = F.max(F.shiftleft("missing_count", 32) + (MOST_POINTS - F.col("first")))  # the first of the longest is the greatest
    gaps = _missing(numbered, keys).groupBy(*keys).agg(longest.alias("_longest"), F.count("*").alias("gap_count"), F.min("first").alias("_least"), F.max("last").alias("_most"))
    gaps = gaps.withColumns({"max_gap": F.shiftright("_longest", 32), "_from": MOST_POINTS - F.col("_longest").bitwiseAND(2**32 - 1)}).withColumn("_to", F.col("_from") + F.col("max_gap") - 1)
    gaps = _dated(gaps, days, scope, {"_from": "max_gap_start", "_to": "max_gap_end", "_least": "first_missing", "_most": "last_missing"})
    gaps = gaps.select(*keys, "max_gap", "max_gap_start", "max_gap_end", "gap_count", "first_missing", "last_missing")
    return join_keys(counts, gaps, keys, "left").fillna(0, ["max_gap", "gap_count"]).withColumn("coverage_ratio", F.col("actual_count") / F.col("expected_count"))


def bucket_end(date: Column, minutes: int) -> Column:
    """The right edge of the session bucket (09:30 to 11:30, 13:00 to 15:00; open exclusive, close inclusive), else null."""
    m = F.hour(date) * 60 + F.minute(date)
    start = F.when((m > 570) & (m <= 690), 570).when((m > 780) & (m <= 900), 780)
    end = start + F.ceil((m - start) / minutes) * minutes
    return F.date_trunc("day", date).cast("timestamp_ntz") + F.make_dt_interval(mins=end.cast("int"))


def downsample(bars: DataFrame, minutes: int, base: int = 5) -> DataFrame:
    """Complete session buckets of `minutes` from bars of `base` minutes."""
    b = bars.withColumn("_end", bucket_end(F.col("date"), minutes)).where("_end IS NOT NULL")
    g = b.groupBy("stock_code", "_end").agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.count("*").alias("_n"))
    return g.where(F.col("_n") >= minutes // base).withColumnRenamed("_end", "date").drop("_n")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new bars; of equal (stock_code, date) the new one stays."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_rn", F.expr("row_number() OVER (PARTITION BY stock_code, date ORDER BY _seq DESC)")).where("_rn = 1").drop("_rn", "_seq")


def upsert_summary(old: DataFrame, merged: DataFrame) -> DataFrame:
    """rows, new_rows, start and end of each symbol."""
    before = old.groupBy("stock_code").agg(F.count("*").alias("_before"))
    now = merged.groupBy("stock_code").agg(F.count("*").alias("rows"), F.min("date").alias("start"), F.max("date").alias("end"))
    return now.join(before, "stock_code", "left").withColumn("new_rows", F.col("rows") - F.coalesce("_before", F.lit(0))).drop("_before")


def wide_to_long(fields: dict[str, DataFrame], ids: tuple[str, ...] = ("date",), symbol: Column | None = None) -> DataFrame:
    """Wide field tables (the id columns and a column for each symbol) to long bars; a symbol that lacks a field has null there.

    symbol: the symbol by the ids and `symbol`, the column's name, which it is by default."""
    long_ = None
    for name, df in fields.items():
        one = df.unpivot(list(ids), [F.col(f"`{c}`") for c in df.columns if c not in ids], "symbol", "value").select(*ids, "symbol", F.lit(name).alias("field"), "value")
        long_ = one if long_ is None else long_.unionByName(one)
    out = long_.groupBy(*ids, "symbol").pivot("field", list(fields)).agg(F.first("value"))
    return out.withColumn("stock_code", normalize_symbol(F.col("symbol") if symbol is None else symbol)).drop("symbol")


# Code prefixes and name words of asset types.
ETF_CODES = ("159", "510", "511", "512", "513", "515", "516", "517", "518", "520", "560", "561", "562", "563", "588")
ETF_WORDS = ("ETF", "LOF", "基金")


def infer_asset_type(symbol: Column, name: Column) -> Column:
    """etf (by name or code), index (by exchange and code), stock (by code) or other, of a normalised symbol."""
    up, code, exchange = F.upper(F.coalesce(name, F.lit(""))), F.left(symbol, F.lit(3)), F.substring_index(symbol, ".", -1)
    named = F.lit(False)
    for w in ETF_WORDS:
        named = named | F.contains(up, F.lit(w))
    index = ((exchange == "SH") & code.isin("000", "880")) | ((exchange == "SZ") & (code == "399"))
    stock = code.isin(*SHANGHAI, *SHENZHEN) | ((exchange == "BJ") & code.isin(*BEIJING))
    kind = F.when(named | code.isin(*ETF_CODES), "etf").when(index, "index").when(stock, "stock").otherwise("other")
    return F.when(F.coalesce(symbol, F.lit("")) == "", "other").otherwise(kind)


def cache_summary(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Catalog rows by keys: symbols, cached and not, rows and latest end."""
    hit = F.col("status") == "cached"
    return catalog.groupBy(*keys).agg(F.countDistinct("stock_code").alias("symbols"), F.count_if(hit).alias("cached"), F.count_if(~hit).alias("unavailable"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"), F.max("end").alias("latest"))


def refill_plan(audit: DataFrame, min_coverage: float | None = None) -> DataFrame:
    """action fetch or cached, with the reason, for each audited key."""
    low = F.col("coverage_ratio") < min_coverage if min_coverage is not None else F.lit(False)
    return audit.withColumns({"action": F.when((F.col("status") != "ok") | low, "fetch").otherwise("cached"), "reason": F.when(F.col("status") != "ok", F.col("status")).when(low, "coverage_below_min").otherwise("")})


def limit_filter_audit(symbols: DataFrame, daily: DataFrame, blocked: DataFrame) -> DataFrame:
    """Did the limit-open filter have daily bars for each symbol, and how many days did it take out."""
    rows = daily.groupBy("stock_code").agg(F.count("*").alias("daily_rows"))
    gone = blocked.groupBy("stock_code").agg(F.count("*").alias("filtered_days"))
    out = symbols.select("stock_code").distinct().join(rows, "stock_code", "left").join(gone, "stock_code", "left").fillna(0, ["daily_rows", "filtered_days"])
    status = F.when(F.col("daily_rows") == 0, "daily_missing").otherwise("ok")
    return out.select("stock_code", status.alias("status"), F.lit(True).alias("filter_enabled"), "daily_rows", "filtered_days")


def readiness(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Cached share of each key: ready, partial or empty."""
    r = catalog.groupBy(*keys).agg(F.count("*").alias("total_count"), F.count_if(F.col("status") == "cached").alias("cached_count"))
    r = r.withColumn("coverage_ratio", F.col("cached_count") / F.col("total_count"))
    return r.withColumn("status", F.when(F.col("cached_count") == 0, "empty").when(F.col("cached_count") == F.col("total_count"), "ready").otherwise("partial"))


def symbol_names(requested: DataFrame, metadata: DataFrame, defaults: DataFrame) -> DataFrame:
    """Names of the requested symbols: metadata before defaults, else ''. Name tables hold one row a symbol."""
    m, d = metadata.withColumnRenamed("stock_name", "_m"), defaults.withColumnRenamed("stock_name", "_d")
    out = requested.select("stock_code").distinct().join(m, "stock_code", "left").join(d, "stock_code", "left")
    return out.select("stock_code", F.coalesce("_m", "_d", F.lit("")).alias("stock_name"))
