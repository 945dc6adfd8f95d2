"""Pattern detectors: bar tables in, event tables out, by window functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.operators.bars import with_bar_index
from barlab.operators.features import attach_bar_features, confirmed_pivots, slope_z
from barlab.operators.frames import W, frame, prev, rolling

EVENTS = ("event_id", "detector_name", "stock_code", "timeframe", "date", "bar_index", "event_type", "direction", "signal_price", "entry_price", "stop_price", "confidence", "metadata")


def _events(rows: DataFrame, name: str, timeframe: str, metadata: str) -> DataFrame:
    """Event rows with ids; metadata stays a typed struct."""
    day = "date_format(date, \"yyyy-MM-dd'T'HH:mm:ss\")"
    rows = rows.withColumns({"detector_name": F.lit(name), "timeframe": F.lit(timeframe), "metadata": F.expr(metadata), "event_id": F.expr(f"concat('{name}:', stock_code, ':', {day}, ':', event_type)")})
    return rows.select(*EVENTS)


@dataclass(frozen=True)
class Trend:
    lookback: int = 20
    min_trend_score: float = 1.0
    strong_close_pos: float = 0.65
    min_body_ratio: float = 0.45
    pullback_lookback: int = 5
    h2_min_pullback_legs: int = 2
    tick_size: float = 0.01


def _legs(pullback: str, lookback: int) -> str:
    """Starts of pullback runs in the bars before, and the run that reaches over the window's edge."""
    inner = f"coalesce(sum(_start{pullback}) {frame(lookback - 1, 1)}, 0) + " if lookback > 1 else ""
    return f"{inner}_edge{pullback}"


def attach_trend_state(bars: DataFrame, c: Trend = Trend()) -> DataFrame:
    """Adds slope_z, trend_score, trend_state (bull, bear, neutral) and pullback legs to the bar features.

    What earlier bars have comes from one window, and what the frames take is made from it before any of them, so that all
    frames share a second window."""
    n, edge = c.lookback, c.pullback_lookback
    b = attach_bar_features(with_bar_index(bars))
    b = b.withColumns({"_ph": F.expr(prev("high")), "_pl": F.expr(prev("low")), **{f"_c{k}": F.expr(prev("close", k)) for k in {1, 2, edge, edge + 1}}})
    falls = lambda sign, new, old: f"coalesce({new} {sign} {old}, false)"
    b = b.withColumns(
        {
            **{f"_start{p}": F.expr(f"CASE WHEN {falls(sign, 'close', '_c1')} AND NOT {falls(sign, '_c1', '_c2')} THEN 1 ELSE 0 END") for p, sign in (("_dn", "<"), ("_up", ">"))},
            **{f"_edge{p}": F.expr(f"cast({falls(sign, f'_c{edge}', f'_c{edge + 1}')} AS int)") for p, sign in (("_dn", "<"), ("_up", ">"))},
            "_st": F.expr("coalesce(sign(high - _ph) + sign(low - _pl), 0D)"), "_fo": F.expr("cast(follow_up AS int) - cast(follow_down AS int)"), "_cp": F.expr("2 * close_pos - 1"),
        }
    )
    b = slope_z(b, n).withColumn("slope_z", F.expr("coalesce(slope_z, 0D)"))
    two = lambda agg, x: f"coalesce({rolling(agg, x, n, 2)}, 0D)"
    score = f"slope_z + {two('sum', '_st')} / {n} + ma_align * 0.5D + {two('avg', '_cp')} + {two('sum', '_fo')} / {n}"
    b = b.withColumn("trend_score", F.expr(score))
    m = c.min_trend_score
    b = b.withColumns(
        {
            "trend_state": F.expr(f"CASE WHEN trend_score >= {m!r}D THEN 'bull' WHEN trend_score <= {-m!r}D THEN 'bear' ELSE 'neutral' END"),
            "bull_pullback_legs": F.expr(_legs("_dn", c.pullback_lookback)), "bear_pullback_legs": F.expr(_legs("_up", c.pullback_lookback)),
        }
    )
    b = b.withColumn("pullback_legs", F.expr("CASE trend_state WHEN 'bull' THEN bull_pullback_legs WHEN 'bear' THEN bear_pullback_legs ELSE 0 END"))
    return b.drop("_ph", "_pl", "_st", "_fo", "_cp", "_start_dn", "_start_up", "_edge_dn", "_edge_up", *(f"_c{k}" for k in {1, 2, edge, edge + 1}))


def detect_trend(bars: DataFrame, timeframe: str = "", c: Trend = Trend()) -> DataFrame:
    """Signal bars along a trend: first (H1, L1) or later (H2, L2) leg by the number of pullbacks."""
    b, t, m = attach_trend_state(bars, c), c.tick_size, c.min_trend_score
    b = b.withColumns({"_lo": F.expr(f"min(low) {frame(c.pullback_lookback)}"), "_hi": F.expr(f"max(high) {frame(c.pullback_lookback)}")})
    strong, weak, body = c.strong_close_pos, 1 - c.strong_close_pos, f"body_ratio >= {c.min_body_ratio!r}D"
    b = b.withColumn("direction", F.expr(f"CASE WHEN trend_state = 'bull' AND close_pos >= {strong!r}D AND {body} AND close > open THEN 'long' WHEN trend_state = 'bear' AND close_pos <= {weak!r}D AND {body} AND close < open THEN 'short' END"))
    b = b.where("direction IS NOT NULL").withColumns(
        {
            "signal_price": F.expr("IF(direction = 'long', high, low)"), "entry_price": F.expr(f"IF(direction = 'long', high + {t!r}D, low - {t!r}D)"),
            "stop_price": F.expr(f"IF(direction = 'long', _lo - {t!r}D, _hi + {t!r}D)"),
            "event_type": F.expr(f"CASE WHEN direction = 'long' THEN IF(pullback_legs >= {c.h2_min_pullback_legs}, 'bull_h2_setup', 'bull_h1_setup') ELSE IF(pullback_legs >= {c.h2_min_pullback_legs}, 'bear_l2_setup', 'bear_l1_setup') END"),
            "confidence": F.expr(f"least(abs(trend_score) / {max(m, 1e-9)!r}D, 3D) / 3"),
        }
    )
    return _events(b.where("entry_price > 0 AND stop_price > 0"), "trend", timeframe, "struct(trend_score, trend_state, pullback_legs, slope_z, close_pos, body_ratio)")


@dataclass(frozen=True)
class Range:
    lookback: int = 20
    middle_low: float = 0.25
    middle_high: float = 0.75
    false_break_buffer: float = 0.0
    strong_close_pos: float = 0.65
    min_range_score: float = 0.8
    tick_size: float = 0.01


def attach_range_score(bars: DataFrame, c: Range = Range()) -> DataFrame:
    """Adds the previous range, the position in it, failed breaks and the range score."""
    n = c.lookback
    b = slope_z(attach_bar_features(with_bar_index(bars)), n).withColumn("slope_z", F.expr("coalesce(slope_z, 0D)"))
    b = b.withColumns({"range_high": F.expr(rolling("max", "high", n, 3, 1)), "range_low": F.expr(rolling("min", "low", n, 3, 1)), "_ph": F.expr(prev("high")), "_pl": F.expr(prev("low")), "_pc": F.expr(prev("close")), "_fc": F.expr(prev("close", n - 1)), "_r": F.expr("nullif(bar_range, 0)")})
    b = b.withColumns({"_pr": F.expr(prev("_r")), "range_pos": F.expr("(close - range_low) / nullif(range_high - range_low, 0)")})
    b = b.withColumns(
        {
            "failed_breakdown": F.expr(f"coalesce(low < range_low * {1 - c.false_break_buffer!r}D AND close > range_low AND close_pos >= {c.strong_close_pos!r}D, false)"),
            "failed_breakout": F.expr(f"coalesce(high > range_high * {1 + c.false_break_buffer!r}D AND close < range_high AND close_pos <= {1 - c.strong_close_pos!r}D, false)"),
            "overlap_ratio": F.expr("CASE WHEN least(_r, _pr) IS NULL THEN 0D ELSE least(greatest(least(high, _ph) - greatest(low, _pl), 0D) / least(_r, _pr), 1D) END"),
            "ema_flatness": F.expr("coalesce(least(greatest(1 / (1 + abs(ema_fast - ema_slow) / nullif(atr, 0)), 0D), 1D), 0D)"),
            "_step": F.expr("abs(close - _pc)"), "_net": F.expr("abs(close - _fc)"),
        }
    )
    full = lambda agg, x: f"coalesce({rolling(agg, x, n, n)}, 0D)"
    b = b.withColumns(
        {
            "overlap_mean": F.expr(full("avg", "overlap_ratio")), "tail_mean": F.expr(full("avg", "tail_ratio")), "_path": F.expr(rolling("sum", "_step", n, n)),
            "failed_break_count": F.expr(f"sum(cast(failed_breakdown AS int) + cast(failed_breakout AS int)) {frame(n)}"),
        }
    )
    b = b.withColumn("directional_efficiency", F.expr("coalesce(least(greatest(_net / nullif(_path, 0), 0D), 1D), 0D)"))
    score = "greatest(1.2D * overlap_mean + 0.5D * tail_mean + 0.8D * ema_flatness + 0.25D * failed_break_count - 0.9D * directional_efficiency - 0.6D * abs(slope_z), 0D)"
    b = b.withColumn("range_score", F.expr(f"CASE WHEN _path IS NOT NULL AND _net IS NOT NULL THEN {score} ELSE 0D END"))
    b = b.withColumn("is_range_regime", F.expr(f"range_score >= {c.min_range_score!r}D"))
    b = b.withColumns(
        {
            "failed_breakdown": F.expr("failed_breakdown AND is_range_regime"), "failed_breakout": F.expr("failed_breakout AND is_range_regime"),
            "no_trade_middle": F.expr(f"coalesce(range_pos BETWEEN {c.middle_low!r}D AND {c.middle_high!r}D, false) AND is_range_regime"),
        }
    )
    return b.drop("_ph", "_pl", "_pc", "_fc", "_r", "_pr", "_step", "_net", "_path")


def detect_range(bars: DataFrame, timeframe: str = "", c: Range = Range()) -> DataFrame:
    """Failed breakdowns, failed breakouts, and the middle as an untradable event, in this priority."""
    t = c.tick_size
    b = attach_range_score(bars, c).where("range_pos IS NOT NULL AND (failed_breakdown OR failed_breakout OR no_trade_middle)")
    b = b.withColumn("event_type", F.expr("CASE WHEN failed_breakdown THEN 'failed_breakdown' WHEN failed_breakout THEN 'failed_breakout' ELSE 'no_trade_middle' END"))
    pick = lambda a, z, m: F.expr(f"CASE event_type WHEN 'failed_breakdown' THEN {a} WHEN 'failed_breakout' THEN {z} ELSE {m} END")
    b = b.withColumns(
        {
            "direction": pick("'long'", "'short'", "'neutral'"), "signal_price": pick("high", "low", "close"),
            "entry_price": pick(f"high + {t!r}D", f"low - {t!r}D", "NULL"), "stop_price": pick(f"low - {t!r}D", f"high + {t!r}D", "NULL"), "confidence": F.lit(1.0),
        }
    )
    return _events(b, "range", timeframe, "struct(range_high, range_low, range_pos, range_score, overlap_mean, tail_mean, ema_flatness, directional_efficiency, failed_break_count)")


@dataclass(frozen=True)
class PriceChannel:
    lookback: int = 40
    sigma_multiple: float = 2.0
    break_buffer: float = 0.0
    tick_size: float = 0.01
    channel_method: str = "regression"
    swing_left_bars: int = 2
    swing_right_bars: int = 2


_CHANNEL = ("channel_mid", "channel_upper", "channel_lower", "prev_channel_upper", "prev_channel_lower", "channel_slope", "channel_sigma", "channel_r2", "channel_pos", "channel_method", "channel_anchor_index_1", "channel_anchor_index_2")


def _median(sorted_list: str) -> str:
    return f"(element_at({sorted_list}, cast((size({sorted_list}) + 1) div 2 AS int)) + element_at({sorted_list}, cast(size({sorted_list}) div 2 + 1 AS int))) / 2"


def attach_log_regression_channel(bars: DataFrame, c: PriceChannel = PriceChannel()) -> DataFrame:
    """Adds a regression channel of log close; its width is robust: the larger of scaled MAD and deviation."""
    n, f = c.lookback, frame(c.lookback)
    b = with_bar_index(bars).withColumn("_l", F.expr("CASE WHEN close > 0 THEN ln(close) END")).withColumn("_i", F.expr("cast(bar_index AS double)"))
    b = b.withColumns({"_n": F.expr(f"count(_l) {f}"), "_s": F.expr(f"regr_slope(_l, _i) {f}"), "_m": F.expr(f"avg(_l) {f}"), "_w": F.expr(f"collect_list(_l) {f}")})
    b = b.withColumn("_ok", F.expr(f"_n = {n}"))
    b = b.withColumn("_e", F.expr(f"CASE WHEN _ok THEN transform(_w, (y, k) -> y - (_m + _s * (k - {(n - 1) / 2!r}D))) END"))
    b = b.withColumns({"_q": F.expr("array_sort(_e)"), "_rss": F.expr("aggregate(_e, 0D, (a, e) -> a + e * e)"), "_tss": F.expr("aggregate(_w, 0D, (a, y) -> a + (y - _m) * (y - _m))")})
    b = b.withColumn("_med", F.expr(_median("_q"))).withColumn("_d", F.expr("array_sort(transform(_e, e -> abs(e - _med)))"))
    b = b.withColumn("channel_sigma", F.expr(f"CASE WHEN _ok THEN greatest(1.4826D * ({_median('_d')}), sqrt(_rss / {n - 1}), 1e-9D) END"))
    b = b.withColumns({"_mid": F.expr(f"CASE WHEN _ok THEN _m + _s * {(n - 1) / 2!r}D END"), "channel_slope": F.expr("CASE WHEN _ok THEN _s END")})
    k = c.sigma_multiple
    b = b.withColumns(
        {
            "channel_mid": F.expr("exp(_mid)"), "channel_upper": F.expr(f"exp(_mid + {k!r}D * channel_sigma)"), "channel_lower": F.expr(f"exp(_mid - {k!r}D * channel_sigma)"),
            "channel_r2": F.expr("CASE WHEN _ok THEN least(greatest(CASE WHEN _tss > 1e-18D THEN 1 - _rss / _tss WHEN _rss <= 1e-18D THEN 1D ELSE 0D END, 0D), 1D) END"),
        }
    )
    b = b.withColumns({"channel_method": F.lit("regression"), "channel_anchor_index_1": F.lit(None).cast("double"), "channel_anchor_index_2": F.lit(None).cast("double")})
    return _with_lagged(b).drop("_l", "_i", "_n", "_s", "_m", "_w", "_ok", "_e", "_q", "_rss", "_tss", "_med", "_d", "_mid")


def _with_lagged(b: DataFrame) -> DataFrame:
    return b.withColumns({"prev_channel_upper": F.expr(prev("channel_upper")), "prev_channel_lower": F.expr(prev("channel_lower")), "channel_pos": F.expr("(close - channel_lower) / nullif(channel_upper - channel_lower, 0)")})


def attach_swing_trend_channel(bars: DataFrame, c: PriceChannel = PriceChannel(channel_method="swing")) -> DataFrame:
    """Adds a channel on the line through the last two confirmed lows, or highs when these fall and the lows don't rise."""
    n, r = c.lookback, c.swing_right_bars
    b = confirmed_pivots(with_bar_index(bars), c.swing_left_bars, r)
    b = b.withColumns({f"_{k}": F.expr(f"CASE WHEN lag(pivot_{k}, {r}) OVER {W} THEN struct(cast(bar_index - {r} AS double) AS i, lag({k}, {r}) OVER {W} AS p) END") for k in ("high", "low")})
    past = "OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    run = "OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    b = b.withColumns({f"_{k}2": F.expr(f"CASE WHEN _{k} IS NOT NULL THEN struct(_{k} AS b, last_value(_{k}) IGNORE NULLS {past} AS a) END") for k in ("high", "low")})
    b = b.withColumns({f"_{k}3": F.expr(f"last_value(_{k}2) IGNORE NULLS {run}") for k in ("high", "low")})
    b = b.withColumns({f"_{k}s": F.expr(f"(_{k}3.b.p - _{k}3.a.p) / nullif(_{k}3.b.i - _{k}3.a.i, 0)") for k in ("high", "low")})
    b = b.withColumn("_kind", F.expr("CASE WHEN _highs < 0 AND (_lows IS NULL OR _lows <= 0) THEN 'high' WHEN _lows IS NOT NULL THEN 'low' WHEN _highs IS NOT NULL THEN 'high' END"))
    side = lambda x, y: F.expr(f"CASE _kind WHEN 'high' THEN {x} WHEN 'low' THEN {y} END")
    b = b.withColumns({"channel_slope": side("_highs", "_lows"), "_a": side("_high3.a", "_low3.a"), "_b": side("_high3.b", "_low3.b"), "_w": F.expr(f"collect_list(struct(cast(bar_index AS double) AS i, high AS h, low AS l)) {frame(n)}")})
    line = "(_a.p + channel_slope * (x.i - _a.i))"
    b = b.withColumn("_wide", F.expr(f"greatest(array_max(transform(_w, x -> IF(_kind = 'low', x.h - {line}, {line} - x.l))), 1e-9D)"))
    b = b.withColumn("_at", F.expr("_a.p + channel_slope * (bar_index - _a.i)"))
    b = b.withColumns({"channel_upper": F.expr("CASE _kind WHEN 'low' THEN _at + _wide WHEN 'high' THEN _at END"), "channel_lower": F.expr("CASE _kind WHEN 'low' THEN _at WHEN 'high' THEN _at - _wide END")})
    b = b.withColumns(
        {
            "channel_mid": F.expr("(channel_upper + channel_lower) / 2"), "channel_sigma": F.expr("CASE WHEN _kind IS NOT NULL THEN _wide / 2 END"), "channel_r2": F.lit(None).cast("double"),
            "channel_method": F.lit("swing"), "channel_anchor_index_1": F.expr("_a.i"), "channel_anchor_index_2": F.expr("_b.i"),
        }
    )
    return _with_lagged(b).drop("pivot_high", "pivot_low", "_high", "_low", "_high2", "_low2", "_high3", "_low3", "_highs", "_lows", "_kind", "_a", "_b", "_w", "_wide", "_at")


def detect_channel(bars: DataFrame, timeframe: str = "", c: PriceChannel = PriceChannel()) -> DataFrame:
    """Closes beyond the channel of the bar before."""
    b = (attach_swing_trend_channel if c.channel_method == "swing" else attach_log_regression_channel)(bars, c)
    t = c.tick_size
    b = b.where("channel_upper IS NOT NULL AND channel_lower IS NOT NULL AND prev_channel_upper IS NOT NULL AND prev_channel_lower IS NOT NULL")
    b = b.withColumn("event_type", F.expr(f"CASE WHEN close > prev_channel_upper * {1 + c.break_buffer!r}D THEN 'channel_overshoot_up' WHEN close < prev_channel_lower * {1 - c.break_buffer!r}D THEN 'channel_break_down' END")).where("event_type IS NOT NULL")
    up = lambda x, y: F.expr(f"IF(event_type = 'channel_overshoot_up', {x}, {y})")
    b = b.withColumns({"direction": up("'long'", "'short'"), "signal_price": up("high", "low"), "entry_price": up(f"high + {t!r}D", f"low - {t!r}D"), "stop_price": up("prev_channel_lower", "prev_channel_upper"), "confidence": F.lit(1.0)})
    return _events(b, "channel", timeframe, "struct(prev_channel_upper AS channel_upper, prev_channel_lower AS channel_lower, channel_slope, channel_pos, channel_sigma, channel_r2, channel_method, channel_anchor_index_1, channel_anchor_index_2)")


@dataclass(frozen=True)
class Reversal:
    lookback: int = 20
    strong_close_pos: float = 0.65
    min_body_ratio: float = 0.45
    old_extreme_tolerance_pct: float = 0.01
    require_old_extreme_test: bool = True
    require_structure_confirmation: bool = True
    tick_size: float = 0.01


def reversal_state(bars: DataFrame, c: Reversal = Reversal()) -> DataFrame:
    """Adds first reversals, follow-throughs, the armed watches and whether each bar confirms one.

    A watch is the last first reversal up to the bar; its old extreme is tested if the last test lies behind the
    watch's start; the first eligible bar behind the start fires. A watch's bars follow each other, so one order of
    each symbol's bars, and one sort, serves all windows. No state is kept beyond them."""
    n, s, w = c.lookback, c.strong_close_pos, 1 - c.strong_close_pos
    b = slope_z(attach_bar_features(with_bar_index(bars)), n).withColumn("slope_z", F.expr("coalesce(slope_z, 0D)"))
    b = b.withColumns({"_ps": F.expr(prev("slope_z")), "_lo": F.expr(f"min(low) {frame(n)}"), "_hi": F.expr(f"max(high) {frame(n)}")})
    body = f"body_ratio >= {c.min_body_ratio!r}D"
    b = b.withColumns({"bull_follow": F.expr(f"close_pos >= {s!r}D AND close > open"), "bear_follow": F.expr(f"close_pos <= {w!r}D AND close < open")})
    b = b.withColumns({"first_bull": F.expr(f"coalesce(_ps < 0 AND slope_z >= 0 AND bull_follow AND {body}, false)"), "first_bear": F.expr(f"coalesce(_ps > 0 AND slope_z <= 0 AND bear_follow AND {body}, false)")})
    run = "OVER (PARTITION BY stock_code ORDER BY date ROWS UNBOUNDED PRECEDING)"
    for side, old, level in (("bull", "_lo", "_hi"), ("bear", "_hi", "_lo")):
        b = b.withColumn(f"_{side}", F.expr(f"last_value(CASE WHEN first_{side} THEN struct(bar_index AS i, {old} AS old, {level} AS level) END) IGNORE NULLS {run}"))
    tol = c.old_extreme_tolerance_pct
    b = b.withColumns(
        {
            "_bt": F.expr(f"cast(bar_index > _bull.i AND low <= _bull.old * {1 + tol!r}D AND close > _bull.old AS int)"),
            "_st": F.expr(f"cast(bar_index > _bear.i AND high >= _bear.old * {1 - tol!r}D AND close < _bear.old AS int)"),
        }
    )
    for side, t in (("bull", "_bt"), ("bear", "_st")):
        b = b.withColumn(f"{side}_failed", F.expr(f"coalesce(max(IF({t} = 1, bar_index, NULL)) {run} > _{side}.i, false)"))
    b = b.withColumns({"bull_structure": F.expr("coalesce(close > _bull.level, false)"), "bear_structure": F.expr("coalesce(close < _bear.level, false)")})
    need = lambda side: ("" if not c.require_old_extreme_test else f" AND {side}_failed") + ("" if not c.require_structure_confirmation else f" AND {side}_structure")
    for side in ("bull", "bear"):
        b = b.withColumn(f"_ok{side}", F.expr(f"coalesce(NOT first_bull AND NOT first_bear AND bar_index - _{side}.i BETWEEN 1 AND {n} AND {side}_follow{need(side)}, false)"))
        before = run.replace("ROWS UNBOUNDED PRECEDING", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
        b = b.withColumn(f"second_{side}", F.expr(f"_ok{side} AND coalesce(max(IF(_ok{side}, bar_index, NULL)) {before}, -1) <= _{side}.i"))
    return b


def detect_reversal(bars: DataFrame, timeframe: str = "", c: Reversal = Reversal()) -> DataFrame:
    """First reversals as watches, and the confirmed second ones as signals."""
    t = c.tick_size
    b = reversal_state(bars, c).where("first_bull OR first_bear OR second_bull OR second_bear")
    b = b.withColumns({"event_type": F.expr("CASE WHEN first_bull THEN 'first_reversal_watch_long' WHEN first_bear THEN 'first_reversal_watch_short' WHEN second_bull THEN 'second_reversal_long' ELSE 'second_reversal_short' END")})
    b = b.withColumns({"direction": F.expr("CASE event_type WHEN 'second_reversal_long' THEN 'long' WHEN 'second_reversal_short' THEN 'short' ELSE 'neutral' END"), "_long": F.expr("event_type LIKE '%_long'"), "_w": F.expr("IF(event_type LIKE '%_long', _bull, _bear)")})
    b = b.withColumns(
        {
            "signal_price": F.expr("IF(_long, high, low)"), "entry_price": F.expr(f"CASE direction WHEN 'long' THEN high + {t!r}D WHEN 'short' THEN low - {t!r}D ELSE close END"),
            "stop_price": F.expr(f"IF(_long, low - {t!r}D, high + {t!r}D)"), "confidence": F.expr("IF(direction = 'neutral', 0.5D, 1D)"), "_second": F.expr("direction <> 'neutral'"),
        }
    )
    return _events(b, "reversal", timeframe, "struct(slope_z, _w.old AS old_extreme, _w.level AS structure_level, _second AND IF(_long, bull_failed, bear_failed) AS old_extreme_test_failed, _second AND IF(_long, bull_structure, bear_structure) AS structure_confirmed)")


def higher_timeframe_context(bars: DataFrame, c: Trend = Trend()) -> DataFrame:
    """date, stock_code, direction and trend_score of each bar, as context for a lower timeframe."""
    return attach_trend_state(bars, c).select("date", "stock_code", F.expr("CASE trend_state WHEN 'bull' THEN 'long' WHEN 'bear' THEN 'short' ELSE 'neutral' END").alias("direction"), "trend_state", "trend_score")
