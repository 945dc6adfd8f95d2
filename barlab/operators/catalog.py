"""Loading bars behind a quality gate: inventory, catalog, refills from a staging table, and health in one row.

A market table is a bar table with timeframe as a further key. Inventories and audits have a row for each
expected symbol and timeframe, so they are small beside the bars."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.operators import audit as A
from barlab.operators import bars as B
from barlab.operators.ranks import join_keys, ordinals
from barlab.operators.stats import ratio
from barlab.operators.tables import written

TIMEFRAMES = ("1d", "1m", "5m", "15m", "30m", "60m")
KEYS = ["stock_code", "timeframe"]


def load_bars(market: DataFrame, timeframe: str, symbols: DataFrame | None = None, start: str = "", end: str = "") -> DataFrame:
    """The canonical columns of one timeframe's bars within whole days start to end; symbols: a table with stock_code."""
    rows = market.where(F.col("timeframe") == timeframe)
    rows = rows.where(F.col("date") >= F.lit(start).cast("timestamp_ntz")) if start else rows
    rows = rows.where(F.col("date") < F.lit(end).cast("timestamp_ntz") + F.make_dt_interval(F.lit(1))) if end else rows
    rows = rows.join(symbols.select("stock_code").distinct(), "stock_code", "left_semi") if symbols is not None else rows
    return rows.select(*B.COLUMNS)


def load_daily_bars(market: DataFrame, symbols: DataFrame | None = None, start: str = "", end: str = "") -> DataFrame:
    return load_bars(market, "1d", symbols, start, end)


def expected_keys(symbols: DataFrame, timeframes: Sequence[str]) -> DataFrame:
    """Every symbol with every timeframe (at most six)."""
    return symbols.select("stock_code").distinct().withColumn("timeframe", F.explode(F.array(*map(F.lit, timeframes))))


def inventory(market: DataFrame, expected: DataFrame) -> DataFrame:
    """stock_code, timeframe, status (cached, missing_file, no_valid_rows), rows (distinct valid dates), start, end of the expected keys."""
    held = market.groupBy(*KEYS).agg(F.count("*").alias("_n"), F.countDistinct("date").alias("rows"), F.min("date").alias("start"), F.max("date").alias("end"))
    out = expected.join(held, KEYS, "left").fillna(0, ["rows"])
    status = F.when(F.col("_n").isNull(), "missing_file").when(F.col("rows") == 0, "no_valid_rows").otherwise("cached")
    return out.withColumn("status", status).select(*KEYS, "status", "rows", "start", "end")


# Header names under which symbol files have codes and names.
CODE_HEADERS, NAME_HEADERS = ("stock_code", "symbol", "code", "代码", "证券代码"), ("stock_name", "name", "名称", "证券名称", "股票名称")


def symbol_metadata(sources: Sequence[DataFrame]) -> DataFrame:
    """stock_code, stock_name from tables under any of the known headers; the first source that has a symbol wins,
    within a source the least name."""
    out = None
    for at, df in enumerate(sources):
        code, name = next((c for c in CODE_HEADERS if c in df.columns), None), next((c for c in NAME_HEADERS if c in df.columns), None)
        if not code or not name:
            raise ValueError(f"symbol table {at} lacks a code or name column: {df.columns}")
        rows = df.select(B.normalize_symbol(F.col(code)).alias("stock_code"), F.trim(F.col(name).cast("string")).alias("stock_name"), F.lit(at).alias("_at")).where("stock_code <> '' AND stock_name <> ''")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("stock_code").agg(F.min_by("stock_name", F.struct("_at", "stock_name")).alias("stock_name"))


def enrich(inventory_rows: DataFrame, names: DataFrame, adjust: str = "qfq") -> DataFrame:
    """An inventory with names, asset type, data kind and a cache key: the catalog."""
    named = inventory_rows.join(names, "stock_code", "left").fillna("", ["stock_name"])
    kind = A.infer_asset_type(F.col("stock_code"), F.col("stock_name"))
    key = F.concat_ws("|", F.lit("price"), F.lit("ohlcv"), "timeframe", F.lit(adjust), "stock_code")
    return named.withColumns({"asset_type": kind, "data_kind": F.lit("price"), "indicator": F.lit("ohlcv"), "adjust": F.lit(adjust), "cache_key": key})


def query_catalog(catalog: DataFrame, **wanted: Sequence[str] | None) -> DataFrame:
    """Catalog rows whose columns hold one of the values given for them (none given: any), by asset type, timeframe and symbol."""
    for column, values in wanted.items():
        catalog = catalog.where(F.col(column).isin(*values)) if values else catalog
    return catalog.orderBy("asset_type", "timeframe", "stock_code")


def snapshot(catalog: DataFrame, asset_types: Sequence[str] | None = None) -> DataFrame:
    """The cached symbols of the asset types, once each."""
    return query_catalog(catalog, asset_type=asset_types, status=["cached"]).select("stock_code").distinct()


def failed_audits(audit: DataFrame, min_coverage: float | None = None) -> DataFrame:
    """stock_code, timeframe and why, of the audit rows that a strict run may not use."""
    low = (F.col("expected_count") > 0) & (F.col("coverage_ratio") < min_coverage) if min_coverage is not None else F.lit(False)
    why = F.when(F.col("status") != "ok", F.col("status")).when(low, "coverage_below_min")
    return audit.select(*KEYS, why.alias("why")).where("why IS NOT NULL")


def raise_for_failed_audits(audit: DataFrame, min_coverage: float | None = None, shown: int = 20) -> None:
    """Raises ValueError naming the first failing keys, if there are any."""
    rows = failed_audits(audit, min_coverage).orderBy(*KEYS).limit(shown).collect()
    if rows:
        raise ValueError("bars did not pass the quality gate: " + "; ".join(f"{r.stock_code}/{r.timeframe}={r.why}" for r in rows))


#: Minutes of a bar.
MINUTES = {"1d": 1440, "1m": 1, "5m": 5, "15m": 15, "30m": 30, "60m": 60}


def audit_market(market: DataFrame) -> DataFrame:
    """audit_bars for each symbol and timeframe, with the coverage of its tradable bars.

    Expected are the timeframe's own dates, all that any symbol has; they are numbered once, so a symbol's missing
    bars follow from jumps in these numbers. Keys without a tradable bar have no coverage (0 expected)."""
    bars = market.select(*KEYS, "date", "open", "high", "low", "close", "volume", "amount")
    days = A.calendar(bars.select("timeframe", F.col("date").alias("at")), ["timeframe"])
    covered = A.coverage(B.drop_illiquid(bars).withColumnRenamed("date", "at"), days, KEYS, ["timeframe"])
    minutes = F.element_at(F.create_map(*(F.lit(x) for k, v in MINUTES.items() for x in (k, v))), F.col("timeframe"))
    out = join_keys(A.audit_bars(bars, KEYS), covered, KEYS, "left").fillna(0, ["expected_count", "actual_count", "coverage_ratio", "max_gap", "gap_count"])
    return out.withColumn("max_gap_minutes", F.col("max_gap") * minutes)


def with_missing(audit: DataFrame, expected: DataFrame) -> DataFrame:
    """An audit with a row for each expected key: those without bars are missing_file, of no rows and no coverage."""
    out = expected.select(*KEYS).distinct().join(audit, KEYS, "left")
    return out.fillna("missing_file", ["status"]).fillna(0, ["row_count", "coverage_ratio", "expected_count", "actual_count"])


def symbols_from_text(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Valid symbols named in free text (white space, commas or semicolons between), with the least `order` that names each."""
    words = rows.select(F.explode(F.split(F.col(column), r"[\s,;，；]+")).alias("symbol"), order)
    return B.unique_symbols(words, "symbol", order)


def run_symbols(requested: DataFrame, metadata: DataFrame, defaults: DataFrame) -> DataFrame:
    """Names of a run's symbols and where each is from: metadata, default or none."""
    names = A.symbol_names(requested, metadata, defaults)
    known = metadata.select("stock_code", F.lit("metadata").alias("_m")).distinct()
    out = names.join(known, "stock_code", "left")
    return out.withColumn("source", F.when(F.col("_m").isNotNull(), "metadata").when(F.col("stock_name") != "", "default").otherwise("none")).drop("_m")


@dataclass(frozen=True)
class BacktestData:
    """What a run reads: lazy tables."""

    bars: DataFrame
    daily: DataFrame
    audit: DataFrame
    blocked: DataFrame
    limit_audit: DataFrame


def backtest_data(bars: DataFrame, daily: DataFrame, symbols: DataFrame, start: str, end: str, filter_limit_open: bool, strict: bool, min_coverage: float | None) -> BacktestData:
    """What a run reads, from loaded bars (with timeframe) and daily bars that reach back before start."""
    audit = audit_market(bars)
    if strict:
        raise_for_failed_audits(audit, min_coverage)
    blocked = B.limit_open_dates_in_window(daily, start or "0001-01-01", end or "9999-12-31")
    liquid = B.drop_illiquid(bars.where("date IS NOT NULL"))
    if filter_limit_open:
        days = blocked.select("stock_code", "session_date").distinct()
        liquid = liquid.withColumn("session_date", F.to_date("date")).join(days, ["stock_code", "session_date"], "left_anti").drop("session_date")
    return BacktestData(liquid, daily, audit, blocked, A.limit_filter_audit(symbols, daily, blocked))


def load_backtest_data(
    market: DataFrame, timeframes: Sequence[str], symbols: DataFrame, start: str = "", end: str = "", *, filter_limit_open: bool = True, strict: bool = True, min_coverage: float | None = None
) -> BacktestData:
    """Bars of the timeframes (a key column) of any market table, without illiquid bars and without sessions that open at
    the limit. Daily bars are read from the first one on; market.load_backtest bounds them on a market table on disk.

    A strict run raises where an audit fails; else only keys without any valid bar drop out, by themselves."""
    daily = load_daily_bars(market, symbols, "", end)
    parts = [load_bars(market, t, symbols, start, end).withColumn("timeframe", F.lit(t)) for t in timeframes]
    bars = parts[0]
    for p in parts[1:]:
        bars = bars.unionByName(p)
    return backtest_data(bars, daily, symbols, start, end, filter_limit_open, strict, min_coverage)


def load_experiment(market: DataFrame, timeframe: str, higher: str, symbols: DataFrame, start: str = "", end: str = "", min_coverage: float | None = None) -> tuple[BacktestData, DataFrame]:
    """A run's bars of its timeframe and a different higher one (or ''), and the health of its data in one row."""
    if higher == timeframe:
        raise ValueError("the higher timeframe must differ from the main one")
    used = [timeframe, higher] if higher else [timeframe]
    data = load_backtest_data(market, used, symbols, start, end, strict=False, min_coverage=min_coverage)
    held = inventory(market, expected_keys(symbols, used))
    return data, summarize_management(data.audit, held, data.limit_audit, min_coverage)


# The statuses that are counted, and the issues in the order in which ties go.
AUDIT_STATUSES = ("missing_file", "missing_columns", "no_window_data", "quality_error", "read_error")
INVENTORY_STATUSES = ("missing_file", "read_error", "missing_columns", "no_valid_rows")
LIMIT_STATUSES = ("daily_missing", "daily_read_error", "daily_missing_columns", "daily_quality_error")
ISSUES = (
    "data_coverage_below_min", "data_audit_missing_file", "data_audit_missing_columns", "data_audit_no_window_data", "data_audit_quality_error", "data_audit_read_error", "data_inventory_missing_file",
    "data_inventory_read_error", "data_inventory_missing_columns", "data_inventory_no_valid_rows", "limit_filter_daily_missing", "limit_filter_daily_read_error", "limit_filter_daily_missing_columns",
    "limit_filter_daily_quality_error",
)


def _counts(prefix: str, statuses: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(f"{prefix}_{s}_count") for s in statuses]


#: Inventory rows under one digest of the signature.
SIGNED_ROWS = 4096


def inventory_signature(rows: DataFrame, block: int = SIGNED_ROWS) -> DataFrame:
    """One row, data_inventory_signature: a digest of the inventory in order of its keys, without paths.

    Rows are JSON lines. Each `block` lines in order have one SHA-256 of them joined by newlines, and so have each
    `block` digests, until one is left; so no task holds more. It differs from one digest of all lines, except that
    up to `block` lines are just that. No rows: the digest of an empty text."""
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    line = F.to_json(F.struct(text("end").alias("end"), "rows", text("start").alias("start"), "status", "stock_code", "timeframe"))
    level = ordinals(written(rows.select(*KEYS, line.alias("line"))), [], [*KEYS, "line"])
    most = rows.sparkSession.sql("SELECT count(*) AS n FROM {rows}", rows=level).first()["n"]
    while True:
        own = F.floor(F.col("place") / block)
        lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
        level = level.groupBy(own.alias("place")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("line"))
        most = -(-most // block)
        if most <= 1:
            return level.agg(F.coalesce(F.max("line"), F.sha2(F.lit("").cast("binary"), 256)).alias("data_inventory_signature"))
        level = written(level)


def summarize_inventory(rows: DataFrame) -> DataFrame:
    """The inventory in one row; file_size_bytes counts where there is such a column."""
    hit = F.col("status") == "cached"
    size = F.coalesce(F.sum("file_size_bytes"), F.lit(0)) if "file_size_bytes" in rows.columns else F.lit(0).cast("long")
    return rows.agg(
        F.count("*").alias("data_inventory_row_count"), F.count_if(hit).alias("data_inventory_cached_count"), F.count_if(~hit).alias("data_inventory_unavailable_count"),
        *_counts("data_inventory", INVENTORY_STATUSES), F.coalesce(F.sum("rows"), F.lit(0)).alias("data_inventory_total_rows"), size.alias("data_inventory_total_file_size_bytes"),
    ).crossJoin(inventory_signature(rows))


def summarize_limit_audit(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("limit_filter_audit_row_count"), F.count_if(F.col("filter_enabled")).alias("limit_filter_enabled_count"), F.count_if(F.col("status") == "ok").alias("limit_filter_ok_count"),
        F.count_if(F.col("status") != "ok").alias("limit_filter_failed_count"), *_counts("limit_filter", LIMIT_STATUSES), F.coalesce(F.sum("filtered_days"), F.lit(0)).alias("limit_filter_filtered_days"),
    )


def summarize_audit(rows: DataFrame, min_coverage: float | None = None) -> DataFrame:
    """Health of all audited keys in one row of 24 values, with linear quantiles of coverage over the keys that expect bars.

    The bounds of the longest gap are those of its first key in order; '' where nothing is missing. No rows: zeros."""
    if min_coverage is not None and not 0 < min_coverage <= 1:
        raise ValueError("the least coverage lies above 0 and not above 1")
    known = F.col("expected_count") > 0
    low = known & (F.col("coverage_ratio") < min_coverage) if min_coverage is not None else F.lit(False)
    first = F.struct(-F.col("max_gap_minutes"), "stock_code", "timeframe")
    zero = lambda c: F.coalesce(c, F.lit(0))
    text = lambda c: F.coalesce(F.when(F.max("max_gap_minutes") > 0, F.date_format(F.min_by(c, first), "yyyy-MM-dd HH:mm:ss")), F.lit(""))
    ratios = F.when(known, F.col("coverage_ratio"))
    return rows.withColumn("_ratio", ratios).agg(
        F.count("*").alias("data_audit_row_count"), F.count_if(F.col("status") == "ok").alias("data_audit_ok_count"), F.count_if(F.col("status") != "ok").alias("data_audit_failed_count"), *_counts("data_audit", AUDIT_STATUSES),
        F.lit(float(min_coverage or 0)).alias("data_min_coverage_threshold"), F.count_if(low).alias("data_coverage_below_min_count"), ratio(F.count_if(low), F.count_if(known)).alias("data_coverage_below_min_ratio"),
        zero(F.sum("expected_count")).alias("data_expected_rows"), zero(F.sum(F.col("expected_count") - F.col("actual_count"))).alias("data_missing_rows"), ratio(F.sum("actual_count"), F.sum("expected_count")).alias("data_weighted_coverage_ratio"),
        zero(F.min("_ratio")).alias("data_min_coverage_ratio"), *(zero(F.expr(f"percentile(_ratio, {q})")).alias(f"data_coverage_p{int(q * 100):02d}") for q in (0.05, 0.5, 0.95)),
        zero(F.max("max_gap_minutes")).alias("data_max_missing_gap_minutes"), text("max_gap_start").alias("data_max_missing_gap_start_at"), text("max_gap_end").alias("data_max_missing_gap_end_at"),
        *(zero(F.sum(f"{of}_count")).alias(f"data_{name}_rows") for of, name in (("zero_volume", "zero_volume_amount"), ("non_positive", "non_positive_price"), ("negative_volume", "negative_volume_amount"))),
    )


def summarize_management(audit: DataFrame, inventory_rows: DataFrame, limit_rows: DataFrame, min_coverage: float | None = None) -> DataFrame:
    """The three summaries side by side, with the issue of most rows (the first listed on ties) and its share. All are one row."""
    one = summarize_audit(audit, min_coverage).crossJoin(summarize_inventory(inventory_rows)).crossJoin(summarize_limit_audit(limit_rows))
    found = F.array(*(F.struct(F.col(f"{i}_count").alias("n"), F.lit(-k).alias("k"), F.lit(i).alias("issue")) for k, i in enumerate(ISSUES)))
    top, total = F.array_max(found), F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    some = top["n"] > 0
    issue = {"primary_data_issue": F.when(some, top["issue"]).otherwise(""), "primary_data_issue_count": F.when(some, top["n"]).otherwise(0), "primary_data_issue_rate": ratio(top["n"], total)}
    return one.withColumns(issue | {"filtered_limit_open_count": F.col("limit_filter_filtered_days")})


def refill_report(plan: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows and coverage of each key before and after a refill."""
    take = lambda df, p: df.select(*KEYS, F.col("status").alias(f"{p}_status"), F.col("row_count").alias(f"{p}_rows"), F.col("coverage_ratio").alias(f"{p}_coverage_ratio"))
    out = plan.join(take(before, "before"), KEYS, "left").join(take(after, "after"), KEYS, "left")
    return out.withColumn("new_rows", F.col("after_rows") - F.coalesce("before_rows", F.lit(0)))
