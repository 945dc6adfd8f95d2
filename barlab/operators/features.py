"""Bar features, structure, channels and scans: window functions by symbol."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.operators.bars import with_bar_index
from barlab.operators.frames import W, frame, prev, rolling

BLOCK = 256


def ema(bars: DataFrame, spans: dict[str, int], column: str = "close") -> DataFrame:
    """Adds exponential averages (first value as start, null on the first bar) under the given names.

    Within blocks of BLOCK bars the recurrence has a closed form, a running sum of scaled values; the
    values carried from block to block are folded over one row a block. So long symbols need no Python. The carried values
    of a symbol come back as one array, so that the join is by symbol and the bars stay dealt as the windows want them."""
    numbered = "bar_index" in bars.columns
    at = "bar_index" if numbered else f"(row_number() OVER {W} - 1)"
    bars = bars.repartition("stock_code") if numbered else bars  # else the window deals them so
    b = bars.withColumn("_at", F.expr(at)).withColumn("_block", F.expr(f"cast(_at div {BLOCK} as int)")).withColumn("_k", F.expr(f"_at % {BLOCK}"))
    own = "OVER (PARTITION BY stock_code, _block ORDER BY _at)"
    q = {n: 1 - 2 / (s + 1) for n, s in spans.items()}
    b = b.withColumns({f"_{n}": F.expr(f"{1 - a!r}D * pow({a!r}D, _k) * sum({column} * pow({a!r}D, -_k)) {own}") for n, a in q.items()})
    ends = b.groupBy("stock_code", "_block").agg(
        F.min_by(column, "_at").alias("x0"), F.max("_k").alias("k"), *(F.max_by(f"_{n}", "_at").alias(n) for n in spans)
    )
    before = "OVER (PARTITION BY stock_code ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    first = "first_value(x0) OVER (PARTITION BY stock_code ORDER BY _block)"
    carry = {f"_c{n}": F.expr(f"aggregate(collect_list(struct({n} AS s, pow({a!r}D, k + 1) AS d)) {before}, {first}, (c, x) -> c * x.d + x.s)") for n, a in q.items()}
    carried = ends.select("stock_code", "_block", *(c.alias(n) for n, c in carry.items())).groupBy("stock_code").agg(F.sort_array(F.collect_list(F.struct("_block", *carry))).alias("_carried"))
    out = b.join(carried, "stock_code").withColumn("_c", F.get("_carried", F.col("_block")))
    out = out.withColumns({n: F.expr(f"CASE WHEN _at > 0 THEN _{n} + pow({a!r}D, _k + 1) * _c._c{n} END") for n, a in q.items()})
    return out.drop("_at", "_block", "_k", "_carried", "_c", *(f"_{n}" for n in spans))


def attach_bar_features(bars: DataFrame, *, ema_fast: int = 20, ema_slow: int = 50, atr_lookback: int = 14) -> DataFrame:
    """Adds range, body, tails, ATR, averages, alignment and follow-through of each bar."""
    b = ema(bars, {"ema_fast": ema_fast, "ema_slow": ema_slow})
    b = b.withColumns({"_pc": F.expr(prev("close")), "_ph": F.expr(prev("high")), "_pl": F.expr(prev("low")), "_n": F.expr("count(*) OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")})
    b = b.withColumns(
        {
            "bar_range": F.expr("high - low"), "bar_body": F.expr("abs(close - open)"),
            "close_pos": F.expr("coalesce((close - low) / nullif(high - low, 0), 0.5D)"),
            "body_ratio": F.expr("coalesce(abs(close - open) / nullif(high - low, 0), 0D)"),
            "upper_tail": F.expr("high - greatest(open, close)"), "lower_tail": F.expr("least(open, close) - low"),
            "tail_ratio": F.expr("coalesce((high - greatest(open, close) + least(open, close) - low) / nullif(high - low, 0), 0D)"),
            "_tr": F.expr("greatest(high - low, abs(high - _pc), abs(low - _pc))"),
            "ma_align": F.expr(
                "CASE WHEN close > ema_fast THEN 1D WHEN close < ema_fast THEN -1D ELSE 0D END"
                f" + CASE WHEN _n < {ema_slow} THEN 0D WHEN close > ema_slow THEN 0.5D WHEN close < ema_slow THEN -0.5D ELSE 0D END"
            ),
            "follow_up": F.expr("coalesce(close > _ph, false)"), "follow_down": F.expr("coalesce(close < _pl, false)"),
        }
    )
    return b.withColumn("atr", F.expr(rolling("avg", "_tr", atr_lookback, 2))).drop("_pc", "_ph", "_pl", "_n", "_tr")


def slope_z(bars: DataFrame, lookback: int, name: str = "slope_z") -> DataFrame:
    """Adds the slope of log close over `lookback` bars by the deviation of its changes; null before that many bars."""
    place = "bar_index + 1" if "bar_index" in bars.columns else f"row_number() OVER {W}"
    b = bars.withColumns({"_i": F.expr(f"cast({place} as double)"), "_p": F.expr(prev("close")), "_l": F.expr("CASE WHEN close > 0 THEN ln(close) END")})
    b = b.withColumn("_d", F.expr("_l - CASE WHEN _p > 0 THEN ln(_p) END")).drop("_p")
    f = frame(lookback)
    slope, vol = f"regr_slope(_l, _i) {f}", rolling("stddev_samp", "_d", lookback, 3)
    z = f"CASE WHEN count(_l) {f} = {lookback} THEN coalesce({slope} / nullif({vol}, 0), 0D) END"
    return b.withColumn(name, F.expr(z)).drop("_l", "_i", "_d")


def confirmed_pivots(bars: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """Adds pivot_high and pivot_low: extremes of the bars around, strict to the left; full windows only."""
    around = f"OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING)"
    before = frame(left, 1)
    whole = f"count(*) {around} = {left + right + 1}"
    return bars.withColumns(
        {
            "pivot_high": F.expr(f"coalesce({whole} AND high = max(high) {around} AND high > max(high) {before}, false)"),
            "pivot_low": F.expr(f"coalesce({whole} AND low = min(low) {around} AND low < min(low) {before}, false)"),
        }
    )


def attach_market_structure(bars: DataFrame, left: int = 2, right: int = 2, break_buffer: float = 0.0) -> DataFrame:
    """Adds pivots, labels, last confirmed swings, breaks of structure and the running score. Pivots act `right` bars later."""
    b = confirmed_pivots(bars, left, right).withColumns({"_h": F.expr("CASE WHEN pivot_high THEN high END"), "_l": F.expr("CASE WHEN pivot_low THEN low END")})
    past = "OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    b = b.withColumns({"_hp": F.expr(f"last_value(_h) IGNORE NULLS {past}"), "_lp": F.expr(f"last_value(_l) IGNORE NULLS {past}")})
    hh, hl = "coalesce(_h > _hp, false)", "coalesce(_l > _lp, false)"
    b = b.withColumns(
        {
            "structure_label": F.expr(f"CASE WHEN pivot_low THEN CASE WHEN {hl} THEN 'HL' ELSE 'LL' END WHEN pivot_high THEN CASE WHEN {hh} THEN 'HH' ELSE 'LH' END ELSE '' END"),
            "_dh": F.expr(f"CASE WHEN pivot_high THEN CASE WHEN {hh} AND NOT pivot_low THEN 1D ELSE -1D END ELSE 0D END"),
            "_dl": F.expr(f"CASE WHEN pivot_low THEN CASE WHEN {hl} THEN 1D ELSE -1D END ELSE 0D END"),
        }
    )
    run = "OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    b = b.withColumns({"_ch": F.expr(prev("_h", right)), "_cl": F.expr(prev("_l", right)), "_delta": F.expr(f"coalesce({prev('_dh + _dl', right)}, 0D)")})
    b = b.withColumns({"last_swing_high": F.expr(f"last_value(_ch) IGNORE NULLS {run}"), "last_swing_low": F.expr(f"last_value(_cl) IGNORE NULLS {run}"), "structure_score": F.expr(f"sum(_delta) {run}")})
    b = b.withColumns(
        {
            "bos_up": F.expr(f"coalesce(close > last_swing_high * {1 + break_buffer!r}D, false)"),
            "bos_down": F.expr(f"coalesce(close < last_swing_low * {1 - break_buffer!r}D, false)"),
            "_ps": F.expr(f"coalesce({prev('structure_score')}, 0D)"),
        }
    )
    b = b.withColumns({"choch_up": F.expr("bos_up AND _ps < 0"), "choch_down": F.expr("bos_down AND _ps > 0")})
    return b.drop("_h", "_l", "_hp", "_lp", "_dh", "_dl", "_ch", "_cl", "_delta", "_ps")


@dataclass(frozen=True)
class Landmark:
    lookback: int = 20
    range_multiple: float = 1.8
    volume_multiple: float = 1.8
    min_body_ratio: float = 0.5


def detect_landmark_candles(bars: DataFrame, c: Landmark = Landmark()) -> DataFrame:
    """Adds is_landmark and the ratios of range and volume to the means of the bars before."""
    b = bars.withColumn("_r", F.expr("high - low"))
    b = b.withColumns({"_rm": F.expr(rolling("avg", "_r", c.lookback, 2, 1)), "_vm": F.expr(rolling("avg", "volume", c.lookback, 2, 1))})
    b = b.withColumns({"landmark_body_ratio": F.expr("coalesce(abs(close - open) / nullif(_r, 0), 0D)")})
    test = f"_r >= _rm * {c.range_multiple!r}D AND volume >= _vm * {c.volume_multiple!r}D AND landmark_body_ratio >= {c.min_body_ratio!r}D"
    b = b.withColumns({"is_landmark": F.expr(f"coalesce({test}, false)"), "landmark_range_ratio": F.expr("_r / nullif(_rm, 0)"), "landmark_volume_ratio": F.expr("volume / nullif(_vm, 0)")})
    return b.withColumn("landmark_reason", F.expr("CASE WHEN is_landmark THEN 'range+volume+body' ELSE '' END")).drop("_r", "_rm", "_vm")


@dataclass(frozen=True)
class Channel:
    lookback: int = 40
    min_slope: float = 0.0
    band_atr_multiple: float = 1.0


def attach_trend_channel(bars: DataFrame, c: Channel = Channel()) -> DataFrame:
    """Adds a linear regression channel: the band holds all highs and lows of the window, or a mean range if wider."""
    n, f = c.lookback, frame(c.lookback)
    b = bars.withColumn("_i", F.expr(f"cast(row_number() OVER {W} as double)"))
    b = b.withColumns({"_s": F.expr(f"regr_slope(close, _i) {f}"), "_m": F.expr(f"avg(close) {f}"), "_w": F.expr(f"collect_list(struct(_i AS i, high AS h, low AS l)) {f}"), "_c": F.expr(f"count(close) {f}"), "_ar": F.expr(f"avg(high - low) {f}")})
    mid = f"_m + _s * {(n - 1) / 2!r}D"
    fit = "(v.m + v.s * (x.i - v.i))"
    band = f"aggregate(_w, named_struct('b', 0D, 'm', {mid}, 's', _s, 'i', _i), (v, x) -> named_struct('b', greatest(v.b, x.h - {fit}, {fit} - x.l), 'm', v.m, 's', v.s, 'i', v.i), v -> v.b)"
    b = b.withColumn("_b", F.expr(f"CASE WHEN _c = {n} THEN greatest({band}, _ar * {c.band_atr_multiple!r}D) END"))
    b = b.withColumns({"channel_slope": F.expr(f"CASE WHEN _c = {n} THEN _s END"), "channel_mid": F.expr(f"CASE WHEN _c = {n} THEN {mid} END")})
    b = b.withColumns(
        {
            "channel_upper": F.expr("channel_mid + _b"), "channel_lower": F.expr("channel_mid - _b"), "channel_width": F.expr("_b * 2"),
            "channel_direction": F.expr(f"CASE WHEN channel_slope > {c.min_slope!r}D THEN 'up' WHEN channel_slope < {-c.min_slope!r}D THEN 'down' ELSE 'flat' END"),
        }
    )
    return b.drop("_i", "_s", "_m", "_w", "_c", "_ar", "_b")


@dataclass(frozen=True)
class Trigger:
    close_buffer_pct: float = 0.0
    volume_multiple: float = 1.5
    volume_lookback: int = 20
    require_landmark: bool = True


def detect_breakout_triggers(bars: DataFrame, c: Trigger = Trigger()) -> DataFrame:
    """Adds breakout_trigger, breakout_level and trigger_price: a close above the channel of the bar before, on volume."""
    b = bars.withColumns({"breakout_level": F.expr(prev("channel_upper")), "_pd": F.expr(prev("channel_direction")), "_vm": F.expr(rolling("avg", "volume", c.volume_lookback, 2, 1))})
    test = f"close > breakout_level * {1 + c.close_buffer_pct!r}D AND _pd IN ('up', 'flat') AND volume >= _vm * {c.volume_multiple!r}D" + " AND is_landmark" * c.require_landmark
    b = b.withColumn("breakout_trigger", F.expr(f"coalesce({test}, false)"))
    return b.withColumn("trigger_price", F.expr("CASE WHEN breakout_trigger THEN close END")).drop("_pd", "_vm")


def scan_bars(bars: DataFrame, landmark: Landmark = Landmark(), channel: Channel = Channel(), trigger: Trigger = Trigger()) -> DataFrame:
    return detect_breakout_triggers(attach_trend_channel(detect_landmark_candles(bars, landmark), channel), trigger)


def latest(scanned: DataFrame, *keys: str) -> DataFrame:
    """The last row by date of each key."""
    part = ", ".join(keys)
    return scanned.withColumn("_rn", F.expr(f"row_number() OVER (PARTITION BY {part} ORDER BY date DESC)")).where("_rn = 1").drop("_rn")


def completed_bar_average(bars: DataFrame, period: int, name: str = "ma") -> DataFrame:
    """Adds the average close of the `period` completed bars before each bar."""
    return bars.withColumn(name, F.expr(rolling("avg", "close", period, period, 1)))


@dataclass(frozen=True)
class Terminal:
    detectors: tuple[str, ...] = ("trend", "channel")
    lookback: int = 40
    atr_period: int = 14
    min_regime_bars: int = 18
    extension_atr_multiple: float = 2.0
    edge_lookback: int = 8
    edge_pos: float = 0.9
    edge_min_count: int = 3
    weak_progress_atr: float = 0.35
    wick_ratio: float = 0.35
    min_score: int = 3


def terminal_features(bars: DataFrame, c: Terminal = Terminal()) -> DataFrame:
    """What tells a late breakout: regime runs, edge counts, progress and extension in ATR, wicks, by bar_index."""
    b = with_bar_index(bars).withColumns({"_pc": F.expr(prev("close")), "_up": F.expr(rolling("max", "high", c.lookback, c.lookback, 1)), "_lo": F.expr(rolling("min", "low", c.lookback, c.lookback, 1))})
    b = b.withColumns({"_tr": F.expr("greatest(high - low, abs(high - _pc), abs(low - _pc))"), "channel_mid": F.expr("(_up + _lo) / 2"), "channel_pos": F.expr("(close - _lo) / nullif(_up - _lo, 0)")})
    b = b.withColumns({"atr": F.expr(f"avg(_tr) {frame(c.atr_period)}"), "_pm": F.expr(prev("channel_mid")), "_ph": F.expr(f"max(high) {frame(c.edge_lookback, 1)}"), "_pl": F.expr(f"min(low) {frame(c.edge_lookback, 1)}")})
    b = b.withColumns({"_u": F.expr("coalesce(channel_mid > _pm, false)"), "_d": F.expr("coalesce(channel_mid < _pm, false)")})
    run = "OVER (PARTITION BY stock_code ORDER BY date ROWS UNBOUNDED PRECEDING)"
    b = b.withColumns({"_ui": F.expr(f"sum(CASE WHEN _u THEN 0 ELSE 1 END) {run}"), "_di": F.expr(f"sum(CASE WHEN _d THEN 0 ELSE 1 END) {run}")})
    count = lambda flag, island: F.expr(f"sum(CASE WHEN {flag} THEN 1 ELSE 0 END) OVER (PARTITION BY stock_code, {island} ORDER BY date)")
    edge = lambda test: F.expr(f"sum(CASE WHEN {test} THEN 1 ELSE 0 END) {frame(c.edge_lookback)}")
    b = b.withColumns(
        {
            "upper_edge_count": edge(f"channel_pos >= {c.edge_pos!r}D"), "lower_edge_count": edge(f"channel_pos <= {1 - c.edge_pos!r}D"),
            "long_progress_atr": F.expr("CASE WHEN _ph IS NOT NULL THEN greatest(high - _ph, 0D) / nullif(atr, 0) END"),
            "short_progress_atr": F.expr("CASE WHEN _pl IS NOT NULL THEN greatest(_pl - low, 0D) / nullif(atr, 0) END"),
            "extension_atr": F.expr("abs(close - channel_mid) / nullif(atr, 0)"),
            "upper_wick_ratio": F.expr("(high - greatest(open, close)) / nullif(high - low, 0)"),
            "lower_wick_ratio": F.expr("(least(open, close) - low) / nullif(high - low, 0)"),
        }
    )
    b = b.withColumn("up_regime_run", count("_u", "_ui")).withColumn("down_regime_run", count("_d", "_di"))
    return b.select("stock_code", "date", "bar_index", "atr", "channel_mid", "channel_pos", "up_regime_run", "down_regime_run", "upper_edge_count", "lower_edge_count", "long_progress_atr", "short_progress_atr", "extension_atr", "upper_wick_ratio", "lower_wick_ratio")
