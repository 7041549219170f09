"""Named queries, continued: signal sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import minute as Q
from .catalog import query, r
from .catalog5 import HALF, NY, NY_MINUTE, half_hours

#: Recursive averages of half-hour bars: e5, e10, e13, e50, the gain and loss of RSI(2), and the ATR.
AVERAGES = """d AS (SELECT *, coalesce(greatest(close - lag(close) OVER o, 0), 0) AS gain, coalesce(greatest(lag(close) OVER o - close, 0), 0) AS loss,
 coalesce(greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)),
 high - low) AS tr FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
e AS (SELECT symbol, bar_id, close AS e5, close AS e10, close AS e13, close AS e50, gain AS g, loss AS l, tr AS a FROM d WHERE bar_id = 1 UNION ALL
 SELECT d.symbol, d.bar_id, e.e5 + (d.close - e.e5) * 2 / 6.0, e.e10 + (d.close - e.e10) * 2 / 11.0, e.e13 + (d.close - e.e13) * 2 / 14.0,
 e.e50 + (d.close - e.e50) * 2 / 51.0,
  e.g + (d.gain - e.g) / 2.0, e.l + (d.loss - e.l) / 2.0, e.a + (d.tr - e.a) / 14.0 FROM e JOIN d ON d.symbol = e.symbol AND d.bar_id = e.bar_id + 1)"""
W = "(PARTITION BY symbol ORDER BY ts ROWS {} PRECEDING)"


def full(agg: str, n: int, of: str = "close") -> str:
    w = W.format(n - 1)
    return f"CASE WHEN count({of}) OVER {w} = {n} THEN {agg} OVER {w} END"


MINUTE_SQL = f"""WITH RECURSIVE {HALF}, {AVERAGES},
n AS (SELECT b.*, e.* EXCLUDE (symbol, bar_id), CASE WHEN g + l > 0 THEN 100 * g / (g + l) ELSE 50 END AS rsi, {NY_MINUTE} AS m,
 CAST({NY} AS DATE) AS d, (high + low + close) / 3 AS tp FROM bars b JOIN e ON e.symbol = b.symbol AND e.bar_id = b.bar_id),
v AS (SELECT *, CASE WHEN m >= 570 AND m < 960 AND count(*) FILTER (WHERE m >= 570 AND m < 960) OVER w >= 2 THEN sum(tp * volume) FILTER (WHERE m >=
 570 AND m < 960) OVER w / nullif(sum(volume) FILTER (WHERE m >= 570 AND m < 960) OVER w, 0) END AS vwap
 FROM n WINDOW w AS (PARTITION BY symbol, d ORDER BY ts ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, last_value(vwap IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS vw, high - low AS rg,
 row_number() OVER o >= 14 AS seen,
 volume / nullif({full('avg(volume)', 30, 'volume')}, 0) AS vr30, volume / nullif({full('avg(volume)', 60, 'volume')}, 0) AS vr60,
 coalesce(close > open AND close - open > 0.55 * nullif(high - low, 0), false) AS up,
 coalesce(open > close AND open - close > 0.55 * nullif(high - low, 0), false) AS down,
 coalesce(high < lag(high) OVER o AND low > lag(low) OVER o, false) AS ins,
 max(CASE WHEN m >= 570 AND m < 600 THEN high END) OVER (PARTITION BY symbol, d) AS orh,
 min(CASE WHEN m >= 570 AND m < 600 THEN low END) OVER (PARTITION BY symbol, d) AS orl,
 e5 > e13 AND e13 > e50 AS tu, e5 < e13 AND e13 < e50 AS td, {full('max(high)', 5)} AS hi5, {full('min(low)', 5)} AS lo5,
 {full('max(high)', 10)} AS hi10, {full('min(low)', 10)} AS lo10, {full('max(high)', 20)} AS hi20, {full('min(low)', 20)} AS lo20,
 {full('avg(close)', 20)} AS ma, {full('stddev_pop(close)', 20)} AS sd, {full('sum(CAST(close > e10 AS INT))', 5)} AS ab,
 {full('sum(CAST(close < e10 AS INT))', 5)} AS bl, {full('max(high - low)', 5)} < 0.6 * {full('avg(high - low)', 20)} AS tight,
 coalesce(close > open AND close > lag(close) OVER o, false) AS b1u, coalesce(close < open AND close < lag(close) OVER o,
 false) AS b1d FROM v WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
b AS (SELECT *, coalesce(lag(b1u) OVER o, false) AND coalesce(high > lag(high) OVER o AND low > lag(low) OVER o, false) AS b2u,
 coalesce(lag(b1d) OVER o, false) AND coalesce(high < lag(high) OVER o AND low < lag(low) OVER o, false) AS b2d,
 coalesce(close > orh AND m >= 600 AND m < 720, false) AS ku, coalesce(close < orl AND m >= 600 AND m < 720,
 false) AS kd FROM a WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
c AS (SELECT *, coalesce(lag(b2u) OVER o, false) AND coalesce(high > lag(high) OVER o AND low > lag(low) OVER o, false) AS b3u,
 coalesce(lag(b2d) OVER o, false) AND coalesce(high < lag(high) OVER o AND low < lag(low) OVER o, false) AS b3d,
 coalesce(bool_or(ku) OVER p, false) AS hadu, coalesce(bool_or(kd) OVER p, false) AS hadd FROM b WINDOW o AS (PARTITION BY symbol ORDER BY ts),
 p AS (PARTITION BY symbol, d ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT symbol, bar_id, close, unnest(['TICK_REVERT_LONG', 'TICK_REVERT_SHORT', 'VOL_SPIKE_LONG', 'VOL_SPIKE_SHORT', 'INSIDE_BREAK_LONG',
 'INSIDE_BREAK_SHORT', 'RSI2_REV_LONG', 'RSI2_REV_SHORT', 'ORB5_LONG', 'ORB5_SHORT', 'EMA_PULLBACK_LONG', 'EMA_PULLBACK_SHORT', 'VWAP_CROSS_LONG',
 'VWAP_CROSS_SHORT',
 'RANGE_BREAK_LONG', 'RANGE_BREAK_SHORT', 'LIQ_GRAB_LONG', 'LIQ_GRAB_SHORT', 'POWER_HOUR_LONG', 'POWER_HOUR_SHORT', '3BAR_THRUST_LONG',
 '3BAR_THRUST_SHORT', 'MORN_REVERT_LONG', 'MORN_REVERT_SHORT', 'ATR_FADE_LONG', 'ATR_FADE_SHORT', 'BB_REVERT_LONG', 'BB_REVERT_SHORT',
 'LUNCH_FADE_LONG', 'LUNCH_FADE_SHORT']) AS name,
 unnest([close - lag(close, 3) OVER o <= -8 AND close - lag(close, 3) OVER o <= -1.5 * a AND up, close - lag(close,
 3) OVER o >= 8 AND close - lag(close, 3) OVER o >= 1.5 * a AND down, vr60 >= 3 AND up, vr60 >= 3 AND down,
  lag(ins) OVER o AND close > lag(high) OVER o AND vr30 >= 1.5, lag(ins) OVER o AND close < lag(low) OVER o AND vr30 >= 1.5,
 lag(rsi) OVER o < 5 AND up, lag(rsi) OVER o > 95 AND down, ku AND NOT hadu, kd AND NOT hadd,
  lag(tu) OVER o AND lag(low <= e5) OVER o AND up, lag(td) OVER o AND lag(high >= e5) OVER o AND down,
 lag(close) OVER o < lag(vw) OVER o AND close > vw AND vr30 >= 1.3 AND up, lag(close) OVER o > lag(vw) OVER o AND close < vw AND vr30 >= 1.3 AND down,
  lag(tight) OVER o AND close > lag(hi5) OVER o AND vr30 >= 1.5, lag(tight) OVER o AND close < lag(lo5) OVER o AND vr30 >= 1.5,
 low < lag(lo20) OVER o AND close > lag(lo20) OVER o AND up, high > lag(hi20) OVER o AND close < lag(hi20) OVER o AND down,
  m >= 900 AND m < 955 AND ab >= 4 AND up AND vr30 >= 1.2, m >= 900 AND m < 955 AND bl >= 4 AND down AND vr30 >= 1.2,
 b1u AND lag(b2u) OVER o AND lag(b3u, 2) OVER o, b1d AND lag(b2d) OVER o AND lag(b3d, 2) OVER o,
  m >= 570 AND m < 630 AND close - lag(close, 5) OVER o <= -8 AND up, m >= 570 AND m < 630 AND close - lag(close, 5) OVER o >= 8 AND down,
 close - open <= -2 * a AND a > 1.5 AND seen, close - open >= 2 * a AND a > 1.5 AND seen,
  low <= ma - 2 * sd AND close > ma - 2 * sd AND up, high >= ma + 2 * sd AND close < ma + 2 * sd AND down,
 m >= 720 AND m < 780 AND low <= lag(lo10) OVER o AND up, m >= 720 AND m < 780 AND high >= lag(hi10) OVER o AND down]) AS ok FROM c WINDOW o AS
 (PARTITION BY symbol ORDER BY ts))
SELECT symbol, bar_id, 'HF_' || name AS signal_name, CASE WHEN name LIKE '%LONG' THEN 1 ELSE -1 END AS side, close AS entry_px FROM z WHERE ok"""


@query(MINUTE_SQL)
def minute_signals(spark, sf):
    """On half-hour bars the opening range is the session's first bar."""
    return Q.minute_signals(half_hours(spark, sf), (570, 600, 720)).drop("signal_time")


@query(f"""WITH {HALF}, n AS (SELECT *, {NY_MINUTE} AS m, CAST({NY} AS DATE) AS d, (high + low + close) / 3 AS tp FROM bars),
dy AS (SELECT symbol, d, max(high) AS dh, min(low) AS dl, arg_max(close, ts) AS dc FROM n GROUP BY 1, 2), pv AS (SELECT symbol, d,
 lag(dh) OVER o AS pdh, lag(dl) OVER o AS pdl, lag(dc) OVER o AS pdc FROM dy WINDOW o AS (PARTITION BY symbol ORDER BY d)),
v AS (SELECT n.*, pdh, pdl, pdc, CASE WHEN m >= 570 AND m < 960 AND count(*) FILTER (WHERE m >= 570 AND m < 960) OVER w >= 2 THEN sum(tp * volume)
 FILTER (WHERE m >= 570 AND m < 960) OVER w / nullif(sum(volume) FILTER (WHERE m >= 570 AND m < 960) OVER w, 0) END AS vwap
 FROM n JOIN pv USING (symbol, d) WINDOW w AS (PARTITION BY symbol, d ORDER BY ts ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, volume / nullif({full('avg(volume)', 20, 'volume')}, 0) AS vr, {full('avg(high - low)', 14)} AS rg,
 coalesce(low > lag(low) OVER o AND lag(low) OVER o > lag(low, 2) OVER o, false) AS hl, coalesce(high < lag(high) OVER o AND low > lag(low) OVER o,
 false) AS ins,
 abs(close - open) / nullif(high - low, 0) AS body, max(high) OVER (PARTITION BY symbol,
 d ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, coalesce(close > pdh, false) AS ov, coalesce(close >= lag(close) OVER o,
 false) AS rise,
 coalesce(low <= vwap AND close > vwap, false) AS touch FROM v WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
g AS (SELECT symbol, d, arg_min(bar_id, (low, bar_id)) AS lod, arg_min(bar_id, (low, bar_id)) FILTER (WHERE m >= 660 AND m < 780) AS mid,
 min(low) FILTER (WHERE m >= 660 AND m < 780) AS ml, arg_min(close, ts) FILTER (WHERE m >= 1080 OR m < 120) AS nf, arg_max(close,
 ts) FILTER (WHERE m >= 1080 OR m < 120) AS nl,
 max(high) FILTER (WHERE m >= 1200 OR m < 240) AS ah, min(low) FILTER (WHERE m >= 1200 OR m < 240) AS al,
 min(bar_id) FILTER (WHERE m >= 120 AND m < 180 AND close > open) AS bull FROM a GROUP BY 1, 2),
h AS (SELECT a.symbol, a.d, min(bar_id) AS hla FROM a JOIN g USING (symbol, d) WHERE bar_id > mid AND low > ml GROUP BY 1, 2), hh AS (SELECT h.symbol,
 h.d, h.hla, a.high AS hlh FROM h JOIN a ON a.symbol = h.symbol AND a.bar_id = h.hla),
ra AS (SELECT a.symbol, a.d, min(bar_id) AS rally FROM a JOIN hh USING (symbol, d) WHERE bar_id > hla AND close > hlh GROUP BY 1, 2),
t AS (SELECT a.*, lod, nf, nl, ah, al, bull, rally, sum(CAST(touch AS INT)) OVER (PARTITION BY symbol,
 d ORDER BY ts ROWS UNBOUNDED PRECEDING) AS touches, sum(CAST(rise AND bar_id > lod AS INT)) OVER (PARTITION BY symbol,
 d ORDER BY ts ROWS 2 PRECEDING) AS rises,
 bool_or(ov) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ov10, vr < 0.7 AND lag(vr) OVER o < 0.7 AND lag(vr,
 2) OVER o < 0.7 AS thin3, ins AND lag(ins) OVER o AS ins2, body < 0.2 AND lag(body) OVER o < 0.2 AND lag(body, 2) OVER o < 0.2 AS doji3
 FROM a JOIN g USING (symbol, d) LEFT JOIN ra USING (symbol, d) WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
z AS (SELECT symbol, bar_id, unnest(['GAP_FILL', 'FAILED_BREAKDOWN', 'THREE_HIGHER_LOWS', 'LIQ_POCKET', 'INSIDE2_BREAK', 'MIDDAY_LOW',
 'OVERNIGHT_DROP', 'THIRD_VWAP_TOUCH', 'SINCE_LOW', 'ASIAN_LOWQ', 'PDH_FLIP', 'TRIPLE_DOJI']) AS pattern,
 unnest([m = 570 AND open - pdc <= -20, low < pdl AND close > pdl, lag(hl) OVER o AND close > top, lag(thin3) OVER o AND vr >= 1.5 AND close > open,
 lag(ins2) OVER o AND close > lag(high, 2) OVER o AND vr >= 1.2, bar_id = rally, nl - nf < -rg AND bar_id = bull, touch AND touches = 3,
 bar_id = lod + 3 AND rises = 3,
  m = 570 AND open <= al + 0.25 * (ah - al), ov10 AND low <= pdh AND close > pdh,
 lag(doji3) OVER o AND close > open AND vr >= 1.5 AND body > 0.6]) AS ok FROM t WINDOW o AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, bar_id,
 pattern FROM z WHERE ok""")
def day_patterns(spark, sf):
    return Q.day_patterns(half_hours(spark, sf), calm=3)


SWINGS, RECENCY, PROX = [3, 10], [50, 200], [10.0, 50.0]


def rejection_sql() -> str:
    frame = lambda k: f"(PARTITION BY symbol ORDER BY ts ROWS {2 * k} PRECEDING)"
    known = ", ".join(
        f"CASE WHEN count(*) OVER {frame(k)} = {2 * k + 1} AND lag({c}, {k}) OVER o = {a}({c}) OVER {frame(k)} THEN lag({c}, {k}) OVER o END AS raw_{c}{k}"
        for k in SWINGS for c, a in (("high", "max"), ("low", "min")))
    last = ", ".join(f"last_value(raw_{c}{k} IGNORE NULLS) OVER u AS {c}{k}" for k in SWINGS for c in ("high", "low"))
    rows = []
    for k in SWINGS:
        for n in RECENCY:
            for p in PROX:
                w = f"(PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"
                rows.append(f"SELECT symbol, bar_id, {k} AS k, {n} AS n, CAST({p} AS DOUBLE) AS prox, -1 AS side, high >= max(high{k}) OVER {w} * (1 - {p} * 1e-4) AND close < (high + low) / 2 AS ok FROM l")
                rows.append(f"SELECT symbol, bar_id, {k}, {n}, CAST({p} AS DOUBLE), 1, low <= min(low{k}) OVER {w} * (1 + {p} * 1e-4) AND close > (high + low) / 2 FROM l")
    return f"""WITH {HALF}, f AS (SELECT *, {known} FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
l AS (SELECT *, {last} FROM f WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
 x AS ({' UNION ALL '.join(rows)}) SELECT symbol, bar_id, k, n, prox, side FROM x WHERE ok"""


@query(rejection_sql())
def level_rejections(spark, sf):
    return Q.level_rejections(half_hours(spark, sf), SWINGS, RECENCY, PROX)


def impulse_sql(pull: float, stop: float, target: float, invert: bool) -> str:
    base = "entry" if invert else "raw"
    sign = "-" if invert else ""
    return f"""WITH {HALF}, w AS (SELECT symbol, bar_id, CASE WHEN count(*) OVER q = 4 THEN close - first(open) OVER q END AS net, max(high) OVER q AS hi,
 min(low) OVER q AS lo FROM bars WINDOW q AS (PARTITION BY symbol ORDER BY ts ROWS 3 PRECEDING)),
a AS (SELECT *, CASE WHEN net >= 5 THEN 1 WHEN net <= -5 THEN -1 END AS approach FROM w), e AS (SELECT *, {sign}approach AS side,
 CASE WHEN approach > 0 THEN hi - (hi - lo) * {pull} ELSE lo + (hi - lo) * {pull} END AS raw FROM a WHERE approach IS NOT NULL),
p AS (SELECT *, CASE WHEN approach > 0 THEN floor(round(raw / 0.25, 6)) ELSE ceil(round(raw / 0.25, 6)) END * 0.25 AS entry FROM e)
SELECT symbol, bar_id, approach, side, entry, ceil(round(({base} - side * {stop}) / 0.25, 6)) * 0.25 AS stop,
 ceil(round(({base} + side * {target}) / 0.25, 6)) * 0.25 AS target FROM p"""


SETUP = ["symbol", "bar_id", "approach", "side", "entry", "stop", "target"]


@query(impulse_sql(0.618, 6.0, 12.0, False))
def pullback_setups(spark, sf):
    return Q.impulse_setups(half_hours(spark, sf), 4, 5.0, 0.618, 6.0, 12.0, 0.25).select(*SETUP)


@query(impulse_sql(0.236, 10.0, 20.0, True))
def inverse_pullback_setups(spark, sf):
    return Q.impulse_setups(half_hours(spark, sf), 4, 5.0, 0.236, 10.0, 20.0, 0.25, invert=True).select(*SETUP)


CONTEXTS = {"trend_up": "close > avg20", "wide": "rg > avgrg", "early": "hour(ts) < 12"}
TRIGGERS = {"up_bar": "close > open", "new_high": "high >= max10", "calm": "abs(close - open) < 0.2 * rg"}


@query(f"""WITH {HALF}, b AS (SELECT *, high - low AS rg, avg(close) OVER w AS avg20, avg(high - low) OVER w AS avgrg,
 max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) AS max10, lead(close,
 4) OVER (PARTITION BY symbol ORDER BY ts) - close AS fwd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
x AS ({' UNION ALL '.join(f"SELECT '{c}' AS context, '{t}' AS trigger, fwd FROM b WHERE {cs} AND {ts}" for c, cs in CONTEXTS.items() for t, ts in TRIGGERS.items())})
 SELECT context, trigger, count(*) AS n, round(avg(fwd), 6) AS mean_fwd FROM x GROUP BY 1, 2""")
def context_triggers(spark, sf):
    """Every context crossed with every trigger, emitted from a bar's own two short lists."""
    from ..operators import windows as Wn

    w = Wn.by_symbol()
    b = half_hours(spark, sf).withColumns({
        "rg": F.col("high") - F.col("low"), "avg20": F.avg("close").over(Wn.last_n(20)),
        "avgrg": F.avg(F.col("high") - F.col("low")).over(Wn.last_n(20)), "max10": F.max("high").over(Wn.last_n(10)),
        "fwd": F.lead("close", 4).over(w) - F.col("close"),
    })
    on = lambda d: F.array_compact(F.array(*(F.when(F.expr(e), F.lit(n)) for n, e in d.items())))
    x = b.select("fwd", on(CONTEXTS).alias("c"), on(TRIGGERS).alias("t")).select("fwd", "t", F.explode("c").alias("context")).select("fwd",
        "context", F.explode("t").alias("trigger"))
    return x.groupBy("context", "trigger").agg(F.count("*").alias("n"), r(F.avg("fwd")).alias("mean_fwd"))


FAMILIES = ["keltrev_L", "keltrev_S", "engulf_L", "engulf_S", "hammer_L", "hammer_S", "insidebrk_L", "insidebrk_S", "outsidefade_L",
    "outsidefade_S", "dayopenrev_L", "dayopenrev_S", "wickfade_L", "wickfade_S", "volclimax_L", "volclimax_S", "donchian_L", "donchian_S",
    "momcont_L", "momcont_S"]


@query(f"""WITH {HALF}, a AS (SELECT *, avg(close) OVER w AS ma, avg(high - low) OVER w AS ar, avg(volume) OVER w AS av, lag(open) OVER o AS po,
 lag(high) OVER o AS ph, lag(low) OVER o AS pl, lag(close) OVER o AS pc, lag(high, 2) OVER o AS p2h, lag(low, 2) OVER o AS p2l, lag(close,
 3) OVER o AS c3,
 first(open) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS dop, max(high) OVER pr AS h20, min(low) OVER pr AS l20, least(open,
 close) - low AS lw, high - greatest(open, close) AS uw, abs(close - open) AS body, high - low AS rg
 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), o AS (PARTITION BY symbol ORDER BY ts),
 pr AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
z AS (SELECT symbol, bar_id, unnest({FAMILIES}) AS family, unnest([close < ma - 1.5 * ar, close > ma + 1.5 * ar,
 pc < po AND close > open AND close >= po AND open <= pc, pc > po AND close < open AND close <= po AND open >= pc,
 lw >= 2 * body AND uw <= body AND rg > 0, uw >= 2 * body AND lw <= body AND rg > 0,
 ph < p2h AND pl > p2l AND close > ph, ph < p2h AND pl > p2l AND close < pl, high > ph AND low < pl AND close < open,
 high > ph AND low < pl AND close > open, low < dop AND close > dop AND pc < dop, high > dop AND close < dop AND pc > dop, lw > 0.6 * rg AND rg > ar,
 uw > 0.6 * rg AND rg > ar,
 volume > 3 * av AND close < open, volume > 3 * av AND close > open, close > h20, close < l20, close - c3 > 1.5 * ar,
 c3 - close > 1.5 * ar]) AS ok FROM a) SELECT symbol, bar_id, family, CASE WHEN family LIKE '%L' THEN 1 ELSE -1 END AS side FROM z WHERE ok""")
def bar_families(spark, sf):
    """Ten families of bar patterns, both sides each."""
    return Q.bar_families(half_hours(spark, sf))


INDICATORS = """rsirev bollbrk squeeze macdx stochx cciext pdhbrk pdhfade pivfade mapull htfalign clvper firsthr todmom gap exhaust
vwaptrend vwaprev atrexp rsidiv""".split()
NAMES = "[" + ", ".join(f"'{n}_{s}'" for n in INDICATORS for s in "LS") + "]"


@query(f"""WITH RECURSIVE {HALF}, d AS (SELECT *, coalesce(greatest(close - lag(close) OVER o, 0), 0) AS gain, coalesce(greatest(lag(close) OVER o - close, 0), 0) AS loss
 FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
e AS (SELECT symbol, bar_id, gain AS g, loss AS l, close AS f, close AS s, CAST(0 AS DOUBLE) AS line FROM d WHERE bar_id = 1 UNION ALL
 SELECT d.symbol, d.bar_id, e.g + (d.gain - e.g) / 14.0, e.l + (d.loss - e.l) / 14.0, e.f + (d.close - e.f) * 2 / 13.0, e.s + (d.close - e.s) * 2 / 27.0,
  e.line + ((e.f + (d.close - e.f) * 2 / 13.0) - (e.s + (d.close - e.s) * 2 / 27.0) - e.line) * 0.2 FROM e JOIN d ON d.symbol = e.symbol AND d.bar_id = e.bar_id + 1),
dd AS (SELECT b.*, CAST(ts AS DATE) AS day, CASE WHEN g + l > 0 THEN 100 * g / (g + l) ELSE 50 END AS rsi, f - s AS macd, line, (high + low + close) / 3 AS tp,
 greatest(CAST(volume AS DOUBLE), 1) AS vv, {NY_MINUTE} AS m FROM bars b JOIN e ON e.symbol = b.symbol AND e.bar_id = b.bar_id),
pd AS (SELECT symbol, day, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM dd GROUP BY 1, 2),
pv AS (SELECT symbol, day, lag(h) OVER o AS pdh, lag(l) OVER o AS pdl, lag(c) OVER o AS pdc FROM pd WINDOW o AS (PARTITION BY symbol ORDER BY day)),
v AS (SELECT dd.*, pdh, pdl, 2 * (pdh + pdl + pdc) / 3 - pdl AS r1, 2 * (pdh + pdl + pdc) / 3 - pdh AS s1, sum(tp * vv) OVER r / sum(vv) OVER r AS vwap
 FROM dd JOIN pv USING (symbol, day) WINDOW r AS (PARTITION BY symbol, day ORDER BY ts)),
a AS (SELECT *, sqrt(avg((tp - vwap) * (tp - vwap)) OVER r) AS vsd, lag(vwap) OVER r AS pvw, {full('avg(close)', 20)} AS ma20, {full('avg(close)', 60)} AS ma60,
 {full('avg(close)', 120)} AS ma120, {full('stddev_pop(close)', 20)} AS sd, {full('avg(high - low)', 20)} AS ar, {full('avg(tp)', 20)} AS mt,
 CASE WHEN count(*) OVER w14 = 14 AND max(high) OVER w14 > min(low) OVER w14 THEN 100 * (close - min(low) OVER w14) / (max(high) OVER w14 - min(low) OVER w14) END AS k,
 max(high) OVER pr AS top, min(low) OVER pr AS flr, (close - low) / nullif(high - low, 0) AS clv, row_number() OVER r AS nth,
 lag(close - open) OVER (PARTITION BY symbol, hour(ts), minute(ts) ORDER BY ts) AS same, close > lag(close) OVER o AS u1, close < lag(close) OVER o AS d1,
 max(CASE WHEN m >= 570 AND m < 630 THEN high END) OVER r AS hh, min(CASE WHEN m >= 570 AND m < 630 THEN low END) OVER r AS hl
 FROM v WINDOW r AS (PARTITION BY symbol, day ORDER BY ts), w14 AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING), o AS (PARTITION BY symbol ORDER BY ts),
 pr AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, CASE WHEN count(abs(tp - mt)) OVER w = 20 AND avg(abs(tp - mt)) OVER w > 1e-12 THEN (tp - mt) / (0.015 * avg(abs(tp - mt)) OVER w) END AS cci,
 4 * sd / nullif(ma20, 0) AS width, sum(CAST(coalesce(u1, false) AS INT)) OVER w5 AS ups, sum(CAST(coalesce(d1, false) AS INT)) OVER w5 AS downs
 FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), w5 AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING)),
t AS (SELECT *, CASE WHEN count(width) OVER w = 100 THEN quantile_cont(width, 0.25) OVER w END AS tight, lag(macd) OVER o AS pm, lag(line) OVER o AS pl, lag(k) OVER o AS pk,
 lag(cci) OVER o AS pcci, lag(close) OVER o AS pc, lag(clv) OVER o AS c1, lag(clv, 2) OVER o AS c2, lag(close, 10) OVER o AS c10, lag(rsi, 10) OVER o AS r10
 FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 99 PRECEDING), o AS (PARTITION BY symbol ORDER BY ts)),
z AS (SELECT symbol, bar_id, unnest({NAMES}) AS family, unnest([rsi < 30 AND close > open, rsi > 70 AND close < open, close > ma20 + 2 * sd, close < ma20 - 2 * sd,
 width <= tight AND close > top, width <= tight AND close < flr, macd > line AND pm <= pl, macd < line AND pm >= pl, k > 20 AND pk <= 20, k < 80 AND pk >= 80,
 pcci < -100 AND cci > pcci, pcci > 100 AND cci < pcci, close > pdh AND pc <= pdh, close < pdl AND pc >= pdl, low < pdl AND close > pdl, high > pdh AND close < pdh,
 low <= s1 AND close > s1, high >= r1 AND close < r1, ma20 > ma60 AND low <= ma20 AND close > ma20, ma20 < ma60 AND high >= ma20 AND close < ma20,
 close > ma20 AND ma20 > ma60 AND ma60 > ma120, close < ma20 AND ma20 < ma60 AND ma60 < ma120, clv > 0.8 AND c1 > 0.8 AND c2 > 0.8, clv < 0.2 AND c1 < 0.2 AND c2 < 0.2,
 m >= 630 AND m < 720 AND close > hh, m >= 630 AND m < 720 AND close < hl, same > 0, same < 0, nth = 1 AND open > pdh, nth = 1 AND open < pdl, downs = 5, ups = 5,
 close > vwap AND vwap > pvw, close < vwap AND vwap < pvw, close < vwap - 1.5 * vsd, close > vwap + 1.5 * vsd, high - low > 2 * ar AND close > open,
 high - low > 2 * ar AND close < open, close < c10 AND rsi > r10 AND rsi < 40, close > c10 AND rsi < r10 AND rsi > 60]) AS ok FROM t)
SELECT symbol, bar_id, family, CASE WHEN family LIKE '%L' THEN 1 ELSE -1 END AS side FROM z WHERE ok""")
def indicator_families(spark, sf):
    """Twenty families of signals from indicators and levels, both sides each."""
    return Q.indicator_families(half_hours(spark, sf))
