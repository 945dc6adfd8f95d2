"""Queries over bar features and detectors, with DuckDB SQL written separately."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.operators import bars as B
from barlab.operators import detectors as D
from barlab.operators import features as X
from barlab.plans.inputs import EVENT_BARS_SQL, day_bars, event_bars, lineitem_bars_sql, week_bars

WEEK = f"WITH bars AS ({lineitem_bars_sql('week')})"
W = "(PARTITION BY stock_code ORDER BY date)"


def win(n: int, lag: int = 0) -> str:
    return f"OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN {n - 1 + lag} PRECEDING AND {f'{lag} PRECEDING' if lag else 'CURRENT ROW'})"


def least(agg: str, x: str, n: int, k: int, lag: int = 0) -> str:
    return f"(CASE WHEN count({x}) {win(n, lag)} >= {k} THEN {agg}({x}) {win(n, lag)} END)"


def rounded(df, keys: list[str], numbers: list[str], others: tuple = (), digits: int = 6):
    return df.select(*keys, *others, *(F.round(c, digits).alias(c) for c in numbers))


def rsql(numbers: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in numbers)


def _ema(span: int, name: str) -> str:
    q = 1 - 2 / (span + 1)
    total = f"pow({q!r}, i) * ({1 - q!r} * sum(close * pow({q!r}, -i)) OVER {W} + {q!r} * first_value(close) OVER {W})"
    return f"CASE WHEN i > 0 THEN {total} END AS {name}"


FEATURES = f"""{WEEK}, b0 AS (SELECT *, row_number() OVER {W} - 1 AS i, lag(close) OVER {W} AS pc, lag(high) OVER {W} AS ph, lag(low) OVER {W} AS pl,
  count(*) OVER (PARTITION BY stock_code) AS n FROM bars),
b1 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, {_ema(20, 'ema_fast')}, {_ema(50, 'ema_slow')} FROM b0),
f AS (SELECT *, high - low AS bar_range, abs(close - open) AS bar_body, coalesce((close - low) / nullif(high - low, 0), 0.5) AS close_pos,
  coalesce(abs(close - open) / nullif(high - low, 0), 0) AS body_ratio, high - greatest(open, close) AS upper_tail, least(open, close) - low AS lower_tail,
  coalesce((high - greatest(open, close) + least(open, close) - low) / nullif(high - low, 0), 0) AS tail_ratio, {least('avg', 'tr', 14, 2)} AS atr,
  CASE WHEN close > ema_fast THEN 1.0 WHEN close < ema_fast THEN -1.0 ELSE 0.0 END + CASE WHEN n < 50 THEN 0 WHEN close > ema_slow THEN 0.5 WHEN close < ema_slow THEN -0.5 ELSE 0 END AS ma_align,
  coalesce(close > ph, false) AS follow_up, coalesce(close < pl, false) AS follow_down,
  CASE WHEN close > 0 THEN ln(close) END AS lc FROM b1)"""
FEATURE_NUMBERS = ["bar_range", "bar_body", "close_pos", "body_ratio", "upper_tail", "lower_tail", "tail_ratio", "atr", "ema_fast", "ema_slow", "ma_align"]
KEYS = ["stock_code", "date"]


def slope(n: int) -> str:
    """A CTE z over f with slope_z before the zero fill, from the least-squares formula."""
    xbar, ss = (n - 1) / 2, n * (n * n - 1) / 12
    f = win(n)
    return f"""z0 AS (SELECT *, lc - lag(lc) OVER {W} AS d FROM f),
z AS (SELECT *, CASE WHEN count(lc) {f} = {n} THEN coalesce((sum(lc * i) {f} - (i - {n - 1} + {xbar}) * sum(lc) {f}) / {ss} / nullif({least('stddev_samp', 'd', n, 3)}, 0), 0) END AS sz FROM z0)"""


Q: dict = {}
S: dict = {}


def add(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


@add("w01_bar_features", f"{FEATURES} SELECT stock_code, date, follow_up, follow_down, {rsql(FEATURE_NUMBERS)} FROM f")
def _(spark, d):
    return rounded(X.attach_bar_features(week_bars(spark, d)), KEYS, FEATURE_NUMBERS, ("follow_up", "follow_down"))


@add("w02_ema", f"""{WEEK}, r AS (SELECT *, row_number() OVER {W} AS i FROM bars),
e AS (SELECT stock_code, list(close ORDER BY i) AS c FROM bars JOIN (SELECT stock_code AS s, date AS dd, row_number() OVER {W} AS i FROM bars) k ON s = stock_code AND dd = date GROUP BY stock_code)
SELECT r.stock_code, r.date, CASE WHEN i > 1 THEN round(list_reduce(c[1:i], lambda a, x: a * {1 - 2 / 13!r} + x * {2 / 13!r}), 6) END AS ema12 FROM r JOIN e USING (stock_code)""")
def _(spark, d):
    return rounded(X.ema(week_bars(spark, d), {"ema12": 12}), KEYS, ["ema12"])


@add("w03_slope_z", f"{FEATURES}, {slope(20)} SELECT stock_code, date, round(sz, 6) AS slope_z FROM z")
def _(spark, d):
    return rounded(X.slope_z(week_bars(spark, d), 20), KEYS, ["slope_z"])


_AROUND = "OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_PIVOTS = f"""p AS (SELECT *, row_number() OVER {W} - 1 AS i,
  coalesce(count(*) {_AROUND} = 5 AND high >= max(high) {_AROUND} AND high > max(high) {win(2, 1)}, false) AS pivot_high,
  coalesce(count(*) {_AROUND} = 5 AND low <= min(low) {_AROUND} AND low < min(low) {win(2, 1)}, false) AS pivot_low FROM bars)"""


@add("w04_confirmed_pivots", f"{WEEK}, {_PIVOTS} SELECT stock_code, date, pivot_high, pivot_low FROM p")
def _(spark, d):
    return X.confirmed_pivots(week_bars(spark, d)).select(*KEYS, "pivot_high", "pivot_low")


_STRUCTURE = f"""{WEEK}, {_PIVOTS},
ph AS (SELECT stock_code, i, high AS v, coalesce(high > lag(high) OVER (PARTITION BY stock_code ORDER BY i), false) AS above FROM p WHERE pivot_high),
pl AS (SELECT stock_code, i, low AS v, coalesce(low > lag(low) OVER (PARTITION BY stock_code ORDER BY i), false) AS above FROM p WHERE pivot_low),
s0 AS (SELECT p.*, CASE WHEN l.i IS NOT NULL THEN CASE WHEN l.above THEN 'HL' ELSE 'LL' END WHEN h.i IS NOT NULL THEN CASE WHEN h.above THEN 'HH' ELSE 'LH' END ELSE '' END AS structure_label,
  ch.v AS ch, cl.v AS cl,
  coalesce(CASE WHEN ch.i IS NOT NULL THEN CASE WHEN ch.above AND cl.i IS NULL THEN 1 ELSE -1 END END, 0) + coalesce(CASE WHEN cl.i IS NOT NULL THEN CASE WHEN cl.above THEN 1 ELSE -1 END END, 0) AS delta
  FROM p LEFT JOIN ph h ON h.stock_code = p.stock_code AND h.i = p.i LEFT JOIN pl l ON l.stock_code = p.stock_code AND l.i = p.i
  LEFT JOIN ph ch ON ch.stock_code = p.stock_code AND ch.i = p.i - 2 LEFT JOIN pl cl ON cl.stock_code = p.stock_code AND cl.i = p.i - 2),
s1 AS (SELECT *, last_value(ch IGNORE NULLS) OVER (PARTITION BY stock_code ORDER BY i ROWS UNBOUNDED PRECEDING) AS last_swing_high,
  last_value(cl IGNORE NULLS) OVER (PARTITION BY stock_code ORDER BY i ROWS UNBOUNDED PRECEDING) AS last_swing_low,
  CAST(sum(delta) OVER (PARTITION BY stock_code ORDER BY i) AS DOUBLE) AS structure_score FROM s0),
s AS (SELECT *, coalesce(close > last_swing_high, false) AS bos_up, coalesce(close < last_swing_low, false) AS bos_down,
  coalesce(lag(structure_score) OVER (PARTITION BY stock_code ORDER BY i), 0) AS before FROM s1)"""


@add("w05_market_structure", f"""{_STRUCTURE} SELECT stock_code, date, pivot_high, pivot_low, structure_label, bos_up, bos_down, bos_up AND before < 0 AS choch_up,
  bos_down AND before > 0 AS choch_down, {rsql(['last_swing_high', 'last_swing_low', 'structure_score'])} FROM s""")
def _(spark, d):
    out = X.attach_market_structure(week_bars(spark, d))
    return rounded(out, KEYS, ["last_swing_high", "last_swing_low", "structure_score"], ("pivot_high", "pivot_low", "structure_label", "bos_up", "bos_down", "choch_up", "choch_down"))


@add("w06_structure_labels", f"{_STRUCTURE} SELECT stock_code, date, structure_label FROM s")
def _(spark, d):
    return X.attach_market_structure(week_bars(spark, d)).select("stock_code", "date", "structure_label")


@add("w07_confirmed_structure_state", f"{_STRUCTURE} SELECT stock_code, date, {rsql(['structure_score', 'last_swing_high', 'last_swing_low'])} FROM s")
def _(spark, d):
    return rounded(X.attach_market_structure(week_bars(spark, d)), KEYS, ["structure_score", "last_swing_high", "last_swing_low"])


def _legs(up: str, n: int) -> str:
    start = f"CASE WHEN {up} AND NOT lag({up}, 1, false) OVER {W} THEN 1 ELSE 0 END"
    return start


_TREND = f"""{FEATURES}, {slope(20)},
t0 AS (SELECT *, coalesce(sz, 0) AS slope_z, coalesce(sign(high - ph) + sign(low - pl), 0) AS st, CAST(follow_up AS INT) - CAST(follow_down AS INT) AS fo,
  coalesce(close < pc, false) AS dn, coalesce(close > pc, false) AS up, 2 * close_pos - 1 AS cq FROM z),
t1 AS (SELECT *, {_legs('dn', 5)} AS ds, {_legs('up', 5)} AS us,
  slope_z + coalesce({least('sum', 'st', 20, 2)}, 0) / 20 + ma_align * 0.5 + coalesce({least('avg', 'cq', 20, 2)}, 0) + coalesce({least('sum', 'fo', 20, 2)}, 0) / 20 AS trend_score FROM t0),
t AS (SELECT *, CASE WHEN trend_score >= 1 THEN 'bull' WHEN trend_score <= -1 THEN 'bear' ELSE 'neutral' END AS trend_state,
  coalesce(sum(ds) {win(4, 1)}, 0) + coalesce(CAST(lag(dn, 5) OVER {W} AS INT), 0) AS bull_pullback_legs,
  coalesce(sum(us) {win(4, 1)}, 0) + coalesce(CAST(lag(up, 5) OVER {W} AS INT), 0) AS bear_pullback_legs,
  min(low) {win(5)} AS lo5, max(high) {win(5)} AS hi5 FROM t1)"""


@add("w08_trend_state", f"{_TREND} SELECT stock_code, date, trend_state, round(trend_score, 6) AS trend_score, round(slope_z, 6) AS slope_z FROM t")
def _(spark, d):
    return rounded(D.attach_trend_state(week_bars(spark, d)), KEYS, ["trend_score", "slope_z"], ("trend_state",))


@add("w09_pullback_legs", f"{_TREND} SELECT stock_code, date, CAST(bull_pullback_legs AS BIGINT) AS bull_pullback_legs, CAST(bear_pullback_legs AS BIGINT) AS bear_pullback_legs FROM t")
def _(spark, d):
    out = D.attach_trend_state(week_bars(spark, d))
    return out.select(*KEYS, *(F.col(c).cast("long").alias(c) for c in ("bull_pullback_legs", "bear_pullback_legs")))


EVENT_NUMBERS = ["signal_price", "entry_price", "stop_price", "confidence"]
EVENT_KEYS = ["event_id", "detector_name", "stock_code", "timeframe", "date", "bar_index", "event_type", "direction"]
TREND_EVENTS = f"""{_TREND}, ev0 AS (SELECT *, CASE WHEN trend_state = 'bull' AND close_pos >= 0.65 AND body_ratio >= 0.45 AND close > open THEN 'long'
  WHEN trend_state = 'bear' AND close_pos <= 0.35 AND body_ratio >= 0.45 AND close < open THEN 'short' END AS direction,
  CASE trend_state WHEN 'bull' THEN bull_pullback_legs WHEN 'bear' THEN bear_pullback_legs ELSE 0 END AS legs FROM t),
ev1 AS (SELECT *, CASE WHEN direction = 'long' THEN CASE WHEN legs >= 2 THEN 'bull_h2_setup' ELSE 'bull_h1_setup' END ELSE CASE WHEN legs >= 2 THEN 'bear_l2_setup' ELSE 'bear_l1_setup' END END AS event_type,
  CASE WHEN direction = 'long' THEN high ELSE low END AS signal_price, CASE WHEN direction = 'long' THEN high + 0.01 ELSE low - 0.01 END AS entry_price,
  CASE WHEN direction = 'long' THEN lo5 - 0.01 ELSE hi5 + 0.01 END AS stop_price, least(abs(trend_score), 3) / 3 AS confidence FROM ev0 WHERE direction IS NOT NULL),
events_ AS (SELECT 'trend:' || stock_code || ':' || strftime(date, '%Y-%m-%dT%H:%M:%S') || ':' || event_type AS event_id, 'trend' AS detector_name, stock_code, '' AS timeframe, date, i AS bar_index,
  event_type, direction, signal_price, entry_price, stop_price, confidence, volume, amount FROM ev1 WHERE entry_price > 0 AND stop_price > 0)"""


def events_out(df):
    return rounded(df.withColumn("bar_index", F.col("bar_index").cast("long")), EVENT_KEYS, EVENT_NUMBERS)


EVENTS_SELECT = f"SELECT {', '.join(EVENT_KEYS)}, {rsql(EVENT_NUMBERS)} FROM events_"


@add("w10_trend_events", f"{TREND_EVENTS} {EVENTS_SELECT}")
def _(spark, d):
    return events_out(D.detect_trend(week_bars(spark, d)))


_RANGE = f"""{FEATURES}, {slope(20)},
r0 AS (SELECT *, coalesce(sz, 0) AS slope_z, {least('max', 'high', 20, 3, 1)} AS range_high, {least('min', 'low', 20, 3, 1)} AS range_low, lag(close, 19) OVER {W} AS fc,
  nullif(bar_range, 0) AS br, lag(nullif(bar_range, 0)) OVER {W} AS pr FROM z),
r1 AS (SELECT *, (close - range_low) / nullif(range_high - range_low, 0) AS range_pos,
  coalesce(low < range_low AND close > range_low AND close_pos >= 0.65, false) AS fd, coalesce(high > range_high AND close < range_high AND close_pos <= 0.35, false) AS fb,
  CASE WHEN ph IS NULL THEN CASE WHEN bar_range > 0 THEN 1.0 ELSE 0.0 END WHEN br IS NULL AND pr IS NULL THEN 0.0 ELSE least(greatest(least(high, ph) - greatest(low, pl), 0) / least(coalesce(br, pr), coalesce(pr, br)), 1) END AS overlap_ratio,
  coalesce(1 / (1 + abs(ema_fast - ema_slow) / nullif(atr, 0)), 0) AS ema_flatness, abs(close - pc) AS step, abs(close - fc) AS net FROM r0),
r2 AS (SELECT *, coalesce({least('avg', 'overlap_ratio', 20, 20)}, 0) AS overlap_mean, coalesce({least('avg', 'tail_ratio', 20, 20)}, 0) AS tail_mean, {least('sum', 'step', 20, 20)} AS path,
  sum(CAST(fd AS INT) + CAST(fb AS INT)) {win(20)} AS failed_break_count FROM r1),
r3 AS (SELECT *, CASE WHEN path > 0 AND net IS NOT NULL THEN least(net / path, 1) ELSE 0 END AS directional_efficiency FROM r2),
r AS (SELECT *, CASE WHEN path IS NOT NULL AND net IS NOT NULL THEN greatest(1.2 * overlap_mean + 0.5 * tail_mean + 0.8 * ema_flatness + 0.25 * failed_break_count - 0.9 * directional_efficiency - 0.6 * abs(slope_z), 0) ELSE 0 END AS range_score FROM r3)"""
_RANGE_NUMBERS = ["range_high", "range_low", "range_pos", "overlap_ratio", "overlap_mean", "tail_mean", "ema_flatness", "directional_efficiency", "range_score"]


@add("w11_range_score", f"{_RANGE} SELECT stock_code, date, CAST(failed_break_count AS BIGINT) AS failed_break_count, range_score >= 0.8 AS is_range_regime, {rsql(_RANGE_NUMBERS)} FROM r")
def _(spark, d):
    return rounded(D.attach_range_score(week_bars(spark, d)), KEYS, _RANGE_NUMBERS, (F.col("failed_break_count").cast("long").alias("failed_break_count"), "is_range_regime"))


@add("w12_range_events", f"""{_RANGE}, re AS (SELECT *, CASE WHEN fd THEN 'failed_breakdown' WHEN fb THEN 'failed_breakout' WHEN range_pos BETWEEN 0.25 AND 0.75 THEN 'no_trade_middle' END AS event_type FROM r WHERE range_pos IS NOT NULL AND range_score >= 0.8),
events_ AS (SELECT 'range:' || stock_code || ':' || strftime(date, '%Y-%m-%dT%H:%M:%S') || ':' || event_type AS event_id, 'range' AS detector_name, stock_code, '' AS timeframe, date, i AS bar_index, event_type,
  CASE event_type WHEN 'failed_breakdown' THEN 'long' WHEN 'failed_breakout' THEN 'short' ELSE 'neutral' END AS direction,
  CASE event_type WHEN 'failed_breakdown' THEN high WHEN 'failed_breakout' THEN low ELSE close END AS signal_price,
  CASE event_type WHEN 'failed_breakdown' THEN high + 0.01 WHEN 'failed_breakout' THEN low - 0.01 END AS entry_price,
  CASE event_type WHEN 'failed_breakdown' THEN low - 0.01 WHEN 'failed_breakout' THEN high + 0.01 END AS stop_price, 1.0 AS confidence FROM re WHERE event_type IS NOT NULL)
{EVENTS_SELECT}""")
def _(spark, d):
    return events_out(D.detect_range(week_bars(spark, d)))


_LOGC = f"""{WEEK}, c0 AS (SELECT *, row_number() OVER {W} - 1 AS i, ln(close) AS lc FROM bars),
c1 AS (SELECT *, list(lc) {win(40)} AS w, avg(lc) {win(40)} AS m FROM c0),
c2 AS (SELECT *, list_sum(list_transform(w, lambda y, k: (y - m) * (k - 20.5))) / {40 * (1600 - 1) / 12} AS s FROM c1 WHERE len(w) = 40),
c3 AS (SELECT *, list_transform(w, lambda y, k: y - (m + s * (k - 20.5))) AS e FROM c2),
c4 AS (SELECT *, list_sum(list_transform(e, lambda x: x * x)) AS rss, list_sum(list_transform(w, lambda y: (y - m) * (y - m))) AS tss, list_median(e) AS med FROM c3),
c5 AS (SELECT *, greatest(1.4826 * list_median(list_transform(e, lambda x: abs(x - med))), sqrt(rss / 39), 1e-9) AS channel_sigma, m + s * 19.5 AS mid FROM c4),
c6 AS (SELECT *, exp(mid) AS channel_mid, exp(mid + 2 * channel_sigma) AS channel_upper, exp(mid - 2 * channel_sigma) AS channel_lower, s AS channel_slope,
  least(greatest(CASE WHEN tss > 1e-18 THEN 1 - rss / tss WHEN rss <= 1e-18 THEN 1 ELSE 0 END, 0), 1) AS channel_r2 FROM c5),
c AS (SELECT c0.*, channel_mid, channel_upper, channel_lower, channel_slope, channel_sigma, channel_r2, (c0.close - channel_lower) / nullif(channel_upper - channel_lower, 0) AS channel_pos,
  lag(channel_upper) OVER (PARTITION BY c0.stock_code ORDER BY c0.date) AS pu, lag(channel_lower) OVER (PARTITION BY c0.stock_code ORDER BY c0.date) AS pl
  FROM c0 LEFT JOIN c6 ON c6.stock_code = c0.stock_code AND c6.date = c0.date)"""
_C = ["channel_mid", "channel_upper", "channel_lower", "channel_slope", "channel_sigma", "channel_r2", "channel_pos"]


@add("w13_log_regression_channel", f"{_LOGC} SELECT stock_code, date, {rsql(_C)} FROM c")
def _(spark, d):
    return rounded(D.attach_log_regression_channel(week_bars(spark, d)), KEYS, _C)


def _anchors(k: str) -> str:
    return f"""{k}a AS (SELECT stock_code, i + 2 AS at, i AS bi, {k} AS bp, lag(i) OVER (PARTITION BY stock_code ORDER BY i) AS ai, lag({k}) OVER (PARTITION BY stock_code ORDER BY i) AS ap FROM p WHERE pivot_{k}),
{k}j AS (SELECT p.stock_code, p.i, x.bi, x.bp, x.ai, x.ap, (x.bp - x.ap) / nullif(x.bi - x.ai, 0) AS s FROM p ASOF LEFT JOIN {k}a x ON x.stock_code = p.stock_code AND x.at <= p.i)"""


_SWING = f"""{WEEK}, {_PIVOTS}, {_anchors('high')}, {_anchors('low')},
sw AS (SELECT p.stock_code, p.date, p.i, p.close, CASE WHEN h.s < 0 AND (l.s IS NULL OR l.s <= 0) THEN 'high' WHEN l.s IS NOT NULL THEN 'low' WHEN h.s IS NOT NULL THEN 'high' END AS kind,
  h.s AS hs, l.s AS ls, h.ai AS hai, h.ap AS hap, h.bi AS hbi, l.ai AS lai, l.ap AS lap, l.bi AS lbi
  FROM p JOIN highj h ON h.stock_code = p.stock_code AND h.i = p.i JOIN lowj l ON l.stock_code = p.stock_code AND l.i = p.i),
sx AS (SELECT *, CASE kind WHEN 'high' THEN hs ELSE ls END AS s, CASE kind WHEN 'high' THEN hai ELSE lai END AS a, CASE kind WHEN 'high' THEN hap ELSE lap END AS ap, CASE kind WHEN 'high' THEN hbi ELSE lbi END AS b FROM sw WHERE kind IS NOT NULL),
wide AS (SELECT sx.stock_code, sx.i, greatest(max(CASE WHEN kind = 'low' THEN p.high - (ap + s * (p.i - a)) ELSE ap + s * (p.i - a) - p.low END), 1e-9) AS w
  FROM sx JOIN p ON p.stock_code = sx.stock_code AND p.i BETWEEN sx.i - 39 AND sx.i GROUP BY sx.stock_code, sx.i),
c AS (SELECT sx.*, w, CASE kind WHEN 'low' THEN ap + s * (sx.i - a) + w ELSE ap + s * (sx.i - a) END AS channel_upper, CASE kind WHEN 'low' THEN ap + s * (sx.i - a) ELSE ap + s * (sx.i - a) - w END AS channel_lower
  FROM sx JOIN wide ON wide.stock_code = sx.stock_code AND wide.i = sx.i)"""


@add("w14_swing_channel", f"""{_SWING} SELECT stock_code, date, round((channel_upper + channel_lower) / 2, 8) AS channel_mid, {rsql(['channel_upper', 'channel_lower'], 8)}, round(s, 8) AS channel_slope, round(w / 2, 8) AS channel_sigma,
  CAST(a AS DOUBLE) AS channel_anchor_index_1, CAST(b AS DOUBLE) AS channel_anchor_index_2 FROM c""")
def _(spark, d):
    out = D.attach_swing_trend_channel(week_bars(spark, d)).where("channel_upper IS NOT NULL")
    return rounded(out, KEYS, ["channel_mid", "channel_upper", "channel_lower", "channel_slope", "channel_sigma"], ("channel_anchor_index_1", "channel_anchor_index_2"), 8)


@add("w15_channel_events", f"""{_LOGC}, ce AS (SELECT *, CASE WHEN close > pu THEN 'channel_overshoot_up' WHEN close < pl THEN 'channel_break_down' END AS event_type FROM c WHERE channel_upper IS NOT NULL AND pu IS NOT NULL),
events_ AS (SELECT 'channel:' || stock_code || ':' || strftime(date, '%Y-%m-%dT%H:%M:%S') || ':' || event_type AS event_id, 'channel' AS detector_name, stock_code, '' AS timeframe, date, i AS bar_index, event_type,
  CASE event_type WHEN 'channel_overshoot_up' THEN 'long' ELSE 'short' END AS direction, CASE event_type WHEN 'channel_overshoot_up' THEN high ELSE low END AS signal_price,
  CASE event_type WHEN 'channel_overshoot_up' THEN high + 0.01 ELSE low - 0.01 END AS entry_price, CASE event_type WHEN 'channel_overshoot_up' THEN pl ELSE pu END AS stop_price, 1.0 AS confidence FROM ce WHERE event_type IS NOT NULL)
{EVENTS_SELECT}""")
def _(spark, d):
    return events_out(D.detect_channel(week_bars(spark, d)))


_REV = f"""{FEATURES}, {slope(20)}, v0 AS (SELECT *, coalesce(sz, 0) AS slope_z, close_pos >= 0.65 AND close > open AS bf, close_pos <= 0.35 AND close < open AS sf, min(low) {win(20)} AS lo, max(high) {win(20)} AS hi FROM z),
v1 AS (SELECT *, lag(slope_z) OVER {W} AS ps FROM v0),
v AS (SELECT *, coalesce(ps < 0 AND slope_z >= 0 AND bf AND body_ratio >= 0.45, false) AS first_bull, coalesce(ps > 0 AND slope_z <= 0 AND sf AND body_ratio >= 0.45, false) AS first_bear FROM v1),
wb AS (SELECT stock_code, i AS w, lo AS old, hi AS lev, lead(i, 1, 1000000000) OVER (PARTITION BY stock_code ORDER BY i) AS nxt FROM v WHERE first_bull),
ws AS (SELECT stock_code, i AS w, hi AS old, lo AS lev, lead(i, 1, 1000000000) OVER (PARTITION BY stock_code ORDER BY i) AS nxt FROM v WHERE first_bear),
fb AS (SELECT v.stock_code, wb.w, min(v.i) AS i FROM v JOIN wb ON wb.stock_code = v.stock_code AND v.i > w AND v.i < nxt AND v.i <= w + 20 WHERE bf AND NOT first_bull AND NOT first_bear AND close > lev
  AND EXISTS (SELECT 1 FROM v y WHERE y.stock_code = v.stock_code AND y.i > w AND y.i <= v.i AND y.low <= old * 1.01 AND y.close > old) GROUP BY v.stock_code, wb.w),
fs AS (SELECT v.stock_code, ws.w, min(v.i) AS i FROM v JOIN ws ON ws.stock_code = v.stock_code AND v.i > w AND v.i < nxt AND v.i <= w + 20 WHERE sf AND NOT first_bull AND NOT first_bear AND close < lev
  AND EXISTS (SELECT 1 FROM v y WHERE y.stock_code = v.stock_code AND y.i > w AND y.i <= v.i AND y.high >= old * 0.99 AND y.close < old) GROUP BY v.stock_code, ws.w),
ve AS (SELECT *, 'first_reversal_watch_long' AS event_type FROM v WHERE first_bull UNION ALL SELECT *, 'first_reversal_watch_short' FROM v WHERE first_bear
  UNION ALL SELECT v.*, 'second_reversal_long' FROM v JOIN fb ON fb.stock_code = v.stock_code AND fb.i = v.i UNION ALL SELECT v.*, 'second_reversal_short' FROM v JOIN fs ON fs.stock_code = v.stock_code AND fs.i = v.i),
events_ AS (SELECT 'reversal:' || stock_code || ':' || strftime(date, '%Y-%m-%dT%H:%M:%S') || ':' || event_type AS event_id, 'reversal' AS detector_name, stock_code, '' AS timeframe, date, i AS bar_index, event_type,
  CASE event_type WHEN 'second_reversal_long' THEN 'long' WHEN 'second_reversal_short' THEN 'short' ELSE 'neutral' END AS direction,
  CASE WHEN event_type LIKE '%_long' THEN high ELSE low END AS signal_price, CASE event_type WHEN 'second_reversal_long' THEN high + 0.01 WHEN 'second_reversal_short' THEN low - 0.01 ELSE close END AS entry_price,
  CASE WHEN event_type LIKE '%_long' THEN low - 0.01 ELSE high + 0.01 END AS stop_price, CASE WHEN event_type LIKE 'second%' THEN 1.0 ELSE 0.5 END AS confidence FROM ve)"""


@add("w16_reversal_events", f"{_REV} {EVENTS_SELECT}")
def _(spark, d):
    return events_out(D.detect_reversal(week_bars(spark, d)))


@add("w17_reversal_masks", f"{_REV} SELECT stock_code, date, first_bull, first_bear, bf AS bull_follow, sf AS bear_follow FROM v")
def _(spark, d):
    return D.reversal_state(week_bars(spark, d)).select(*KEYS, "first_bull", "first_bear", "bull_follow", "bear_follow")


def _land(src: str) -> str:
    return f"""l0 AS (SELECT *, high - low AS r FROM {src}), l1 AS (SELECT *, {least('avg', 'r', 20, 2, 1)} AS rm, {least('avg', 'volume', 20, 2, 1)} AS vm, coalesce(abs(close - open) / nullif(r, 0), 0) AS landmark_body_ratio FROM l0),
land AS (SELECT *, coalesce(r >= rm * 1.8 AND volume >= vm * 1.8 AND landmark_body_ratio >= 0.5, false) AS is_landmark, r / nullif(rm, 0) AS landmark_range_ratio, volume / nullif(vm, 0) AS landmark_volume_ratio FROM l1)"""


_LAND = ["landmark_range_ratio", "landmark_volume_ratio", "landmark_body_ratio"]


@add("w18_landmark_candles", f"{WEEK}, {_land('bars')} SELECT stock_code, date, is_landmark, {rsql(_LAND)} FROM land")
def _(spark, d):
    return rounded(X.detect_landmark_candles(week_bars(spark, d)), KEYS, _LAND, ("is_landmark",))


def _scan(keys: str = "stock_code") -> str:
    n = 40
    return f"""x0 AS (SELECT *, list({{'c': close, 'h': high, 'l': low}}) {win(n)} AS w, avg(close) {win(n)} AS m, avg(r) {win(n)} AS ar FROM land),
x1 AS (SELECT *, CASE WHEN len(w) = {n} THEN list_sum(list_transform(w, lambda y, k: (y.c - m) * (k - 20.5))) / {n * (n * n - 1) / 12} END AS channel_slope FROM x0),
x2 AS (SELECT *, m + channel_slope * 19.5 AS channel_mid, greatest(list_max(list_transform(w, lambda y, k: greatest(y.h - (m + channel_slope * (k - 20.5)), m + channel_slope * (k - 20.5) - y.l))), 0, ar) AS band FROM x1),
x3 AS (SELECT *, channel_mid + band AS channel_upper, channel_mid - band AS channel_lower, CASE WHEN channel_slope > 0 THEN 'up' WHEN channel_slope < 0 THEN 'down' ELSE 'flat' END AS channel_direction FROM x2),
x4 AS (SELECT *, lag(channel_upper) OVER {W} AS breakout_level, lag(channel_direction) OVER {W} AS pd, {least('avg', 'volume', 20, 2, 1)} AS vm2 FROM x3),
scan AS (SELECT *, coalesce(close > breakout_level AND pd IN ('up', 'flat') AND volume >= vm2 * 1.5 AND is_landmark, false) AS breakout_trigger FROM x4)"""


_TC = ["channel_slope", "channel_mid", "channel_upper", "channel_lower"]


@add("w19_trend_channel", f"{WEEK}, {_land('bars')}, {_scan()} SELECT stock_code, date, channel_direction, {rsql(_TC)} FROM scan")
def _(spark, d):
    return rounded(X.attach_trend_channel(week_bars(spark, d)), KEYS, _TC, ("channel_direction",))


@add("w21_breakout_triggers", f"{WEEK}, {_land('bars')}, {_scan()} SELECT stock_code, date, breakout_trigger, round(breakout_level, 6) AS breakout_level, round(CASE WHEN breakout_trigger THEN close END, 6) AS trigger_price FROM scan")
def _(spark, d):
    return rounded(X.scan_bars(week_bars(spark, d)), KEYS, ["breakout_level", "trigger_price"], ("breakout_trigger",))


@add("w22_scan", f"{WEEK}, {_land('bars')}, {_scan()} SELECT stock_code, count(*) AS bars, count(*) FILTER (is_landmark) AS landmarks, count(*) FILTER (breakout_trigger) AS triggers, count(*) FILTER (channel_direction = 'up') AS up FROM scan GROUP BY stock_code")
def _(spark, d):
    s = X.scan_bars(week_bars(spark, d))
    return s.groupBy("stock_code").agg(F.count("*").alias("bars"), F.count_if("is_landmark").alias("landmarks"), F.count_if("breakout_trigger").alias("triggers"), F.count_if(F.col("channel_direction") == "up").alias("up"))


@add("w23_scan_latest", f"""WITH week AS ({lineitem_bars_sql('week')}), hour AS ({EVENT_BARS_SQL}),
bars AS (SELECT 'week|' || stock_code AS stock_code, date, open, high, low, close, volume, amount FROM week UNION ALL SELECT 'hour|' || stock_code, date, open, high, low, close, volume, amount FROM hour), {_land('bars')}, {_scan()}
SELECT split_part(stock_code, '|', 1) AS timeframe, split_part(stock_code, '|', 2) AS stock_code, max(date) AS date, round(max_by(close, date), 6) AS close, max_by(breakout_trigger, date) AS breakout_trigger FROM scan GROUP BY 1, 2""")
def _(spark, d):
    both = week_bars(spark, d).withColumn("timeframe", F.lit("week")).unionByName(event_bars(spark, d).withColumn("timeframe", F.lit("hour")))
    keyed = both.withColumn("stock_code", F.concat_ws("|", "timeframe", "stock_code"))
    out = X.latest(X.scan_bars(keyed), "timeframe", "stock_code").withColumn("stock_code", F.substring_index("stock_code", "|", -1))
    return rounded(out, ["timeframe", "stock_code", "date"], ["close"], ("breakout_trigger",))


_TERMINAL = f"""q0 AS (SELECT *, row_number() OVER {W} - 1 AS bar_index, lag(close) OVER {W} AS pc, {least('max', 'high', 40, 40, 1)} AS up, {least('min', 'low', 40, 40, 1)} AS lo FROM bars),
q1 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, (up + lo) / 2 AS channel_mid, (close - lo) / nullif(up - lo, 0) AS channel_pos FROM q0),
q2 AS (SELECT *, avg(tr) {win(14)} AS atr, lag(channel_mid) OVER {W} AS pm, max(high) {win(8, 1)} AS hh, min(low) {win(8, 1)} AS ll FROM q1),
q3 AS (SELECT *, max(CASE WHEN channel_mid > pm THEN -1 ELSE bar_index END) OVER (PARTITION BY stock_code ORDER BY date) AS lu, max(CASE WHEN channel_mid < pm THEN -1 ELSE bar_index END) OVER (PARTITION BY stock_code ORDER BY date) AS ld FROM q2),
tf AS (SELECT *, bar_index - lu AS up_regime_run, bar_index - ld AS down_regime_run, count(*) FILTER (channel_pos >= 0.9) {win(8)} AS upper_edge_count, count(*) FILTER (channel_pos <= {1 - 0.9!r}) {win(8)} AS lower_edge_count,
  CASE WHEN hh IS NOT NULL THEN greatest(high - hh, 0) / nullif(atr, 0) END AS long_progress_atr, CASE WHEN ll IS NOT NULL THEN greatest(ll - low, 0) / nullif(atr, 0) END AS short_progress_atr,
  abs(close - channel_mid) / nullif(atr, 0) AS extension_atr, (high - greatest(open, close)) / nullif(high - low, 0) AS upper_wick_ratio, (least(open, close) - low) / nullif(high - low, 0) AS lower_wick_ratio FROM q3)"""
_TF = ["atr", "channel_mid", "channel_pos", "long_progress_atr", "short_progress_atr", "extension_atr", "upper_wick_ratio", "lower_wick_ratio"]
_TFI = ["up_regime_run", "down_regime_run", "upper_edge_count", "lower_edge_count"]


@add("w24_terminal_features", f"{WEEK}, {_TERMINAL} SELECT stock_code, date, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _TFI)}, {rsql(_TF)} FROM tf")
def _(spark, d):
    return rounded(X.terminal_features(week_bars(spark, d)), KEYS, _TF, tuple(F.col(c).cast("long").alias(c) for c in _TFI))


@add("w26_completed_bar_average", f"{WEEK} SELECT stock_code, date, round({least('avg', 'close', 10, 10, 1)}, 6) AS ma FROM bars")
def _(spark, d):
    return rounded(X.completed_bar_average(week_bars(spark, d), 10), KEYS, ["ma"])


@add("p09_higher_timeframe_context", f"{_TREND} SELECT stock_code, date, CASE trend_state WHEN 'bull' THEN 'long' WHEN 'bear' THEN 'short' ELSE 'neutral' END AS direction, trend_state FROM t")
def _(spark, d):
    return D.higher_timeframe_context(week_bars(spark, d)).select(*KEYS, "direction", "trend_state")


LIMIT = f"""lim0 AS (SELECT *, lag(close) OVER {W} AS prev FROM bars),
lim AS (SELECT *, CASE WHEN starts_with(stock_code, '300') OR starts_with(stock_code, '301') THEN 0.2 WHEN substr(stock_code, 1, 1) IN ('4', '8') OR starts_with(stock_code, '920') THEN 0.3 ELSE 0.1 END AS limit_pct FROM lim0),
blocked AS (SELECT stock_code, CAST(date AS DATE) AS session_date, limit_pct, round(round_even(prev * (1 + limit_pct) / 0.01, 0) * 0.01, 10) AS limit_up_open FROM lim
  WHERE abs(open - round(round_even(prev * (1 + limit_pct) / 0.01, 0) * 0.01, 10)) <= 0.005 OR open / nullif(prev, 0) - 1 >= limit_pct - 0.0005)"""
DAY = f"WITH bars AS ({lineitem_bars_sql('day')})"


@add("f01_limit_open_dates", f"{DAY}, {LIMIT} SELECT stock_code, session_date, CAST(limit_pct AS DOUBLE) AS limit_pct, round(limit_up_open, 6) AS limit_up_open FROM blocked")
def _(spark, d):
    return rounded(B.limit_open_dates(day_bars(spark, d)), ["stock_code", "session_date"], ["limit_up_open"], ("limit_pct",))


@add("f02_filter_limit_open_days", f"{DAY}, {LIMIT} SELECT stock_code, date, close FROM bars WHERE NOT EXISTS (SELECT 1 FROM blocked k WHERE k.stock_code = bars.stock_code AND k.session_date = CAST(bars.date AS DATE))")
def _(spark, d):
    day = day_bars(spark, d)
    return B.filter_limit_open_days(day, day).select("stock_code", "date", "close")


@add("f03_limit_open_in_window", f"{DAY}, {LIMIT} SELECT stock_code, session_date, round(limit_up_open, 6) AS limit_up_open FROM blocked WHERE session_date BETWEEN DATE '1993-01-01' AND DATE '1997-12-31'")
def _(spark, d):
    return rounded(B.limit_open_dates_in_window(day_bars(spark, d), "1993-01-01", "1997-12-31"), ["stock_code", "session_date"], ["limit_up_open"])
