"""Named queries over the test tables, each beside an independent SQL statement of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import joins as J
from ..operators import windows as W
from ..operators.stats import correlation
from ..sources.tape import table, tape

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TAPE = "tape AS (SELECT event_type AS symbol, ts, event_id AS id, value AS px, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size FROM events)"


def bars_sql(unit: str = "hour") -> str:
    return TAPE + f""", b0 AS (
  SELECT symbol, date_trunc('{unit}', ts) AS ts, arg_min(px, (ts, id)) AS open, max(px) AS high, min(px) AS low, arg_max(px, (ts, id)) AS close,
 CAST(sum(size) AS BIGINT) AS volume, count(*) AS n_ticks FROM tape GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar_id FROM b0)"""


BARS = bars_sql()


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return B.with_bar_id(B.time_bars(tape(spark, sf)))


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


def r(c, n: int = 6):
    return F.round(c, n)


# ---- bars


@query(f"WITH {BARS} SELECT symbol, ts, open, high, low, close, volume, n_ticks, bar_id FROM bars")
def bars_hourly(spark, sf):
    return hourly(spark, sf)


@query(f"WITH {TAPE} SELECT symbol, ts, px, size, min(id) AS id FROM tape WHERE size > 0 AND px > 0 GROUP BY ALL")
def tape_clean(spark, sf):
    return B.clean(tape(spark, sf))


@query("""SELECT o_orderpriority AS symbol, CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS DATE) AS week_end, arg_min(o_totalprice, (o_orderdate,
 o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close,
 count(*) AS n FROM orders GROUP BY 1, 2""")
def bars_weekly_sunday(spark, sf):
    """Weeks end on Sunday and carry that day as label."""
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice")
    at = F.struct("o_orderdate", "o_orderkey")
    week = F.date_add(F.date_trunc("week", "o_orderdate"), 6)
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), week.alias("week_end")).agg(F.min_by("o_totalprice", at).alias("open"),
        F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", at).alias("close"),
        F.count("*").alias("n"))


SIGNED = TAPE + """, s0 AS (SELECT *, CAST(ts AS DATE) AS day, nullif(sign(px - lag(px) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, id)),
 0) AS m FROM tape),
signed AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY symbol, day ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 1) AS sg FROM s0)"""


@query(f"""WITH {SIGNED} SELECT symbol, day, CAST(sum(CASE WHEN sg > 0 THEN size ELSE 0 END) AS BIGINT) AS buyvol,
 CAST(sum(CASE WHEN sg < 0 THEN size ELSE 0 END) AS BIGINT) AS sellvol, count(*) AS n FROM signed GROUP BY 1, 2""")
def tick_rule_flow(spark, sf):
    t = B.tick_sign(tape(spark, sf).withColumn("day", B.day()), ("symbol", "day"))
    on = lambda c: F.sum(F.when(c, F.col("size")).otherwise(0))
    return t.groupBy("symbol", "day").agg(on(F.col("sign") > 0).alias("buyvol"), on(F.col("sign") < 0).alias("sellvol"),
        F.count("*").alias("n"))


@query(f"""WITH {SIGNED}, v AS (SELECT *, CAST(floor((sum(size) OVER (PARTITION BY symbol, day ORDER BY ts, id) - size) / 500.0) AS BIGINT) AS bar FROM signed),
x AS (SELECT *, max(px) OVER (PARTITION BY symbol, day, bar) AS hi, min(px) OVER (PARTITION BY symbol, day, bar) AS lo FROM v),
g AS (SELECT symbol, day, bar, arg_min(px, (ts, id)) AS open, max(px) AS high, min(px) AS low, arg_max(px, (ts, id)) AS close,
 CAST(sum(size) AS BIGINT) AS volume, count(*) AS n_ticks,
 CAST(sum(CASE WHEN sg > 0 THEN size ELSE 0 END) AS BIGINT) AS buyvol, CAST(sum(CASE WHEN sg < 0 THEN size ELSE 0 END) AS BIGINT) AS sellvol,
 CAST(sum(CASE WHEN px = hi THEN size ELSE 0 END) AS BIGINT) AS highsz,
 CAST(sum(CASE WHEN px = lo THEN size ELSE 0 END) AS BIGINT) AS lowsz, round(sum(CASE WHEN size >= 90 THEN size ELSE 0 END) / CAST(nullif(sum(size),
 0) AS DOUBLE), 6) AS bigratio FROM x GROUP BY 1, 2, 3)
SELECT *, buyvol - sellvol AS delta, CAST(sum(buyvol - sellvol) OVER (PARTITION BY symbol, day ORDER BY bar) AS BIGINT) AS cumdelta FROM g""")
def bars_volume(spark, sf):
    return B.volume_bars(tape(spark, sf), 500, 90)


@query(f"""WITH {SIGNED}, v AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY symbol, day ORDER BY ts, id) - 1) / 16.0) AS BIGINT) AS bar FROM signed),
x AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER i AS gap, CAST(sg <> lag(sg) OVER i AS INT) AS turn,
 px - lag(px) OVER i AS step FROM v WINDOW i AS (PARTITION BY symbol, day, bar ORDER BY ts, id))
SELECT symbol, day, bar, count(*) AS n_ticks, max(gap) AS longest_gap_us, round(max(size) / CAST(nullif(sum(size), 0) AS DOUBLE), 6) AS largest_share,
 round(avg(turn), 6) AS alternation, round(sum(abs(step)) / nullif(sum(size), 0), 6) AS amihud, round(sum(px * size) / nullif(sum(size), 0),
 6) AS vwap FROM x GROUP BY 1, 2, 3""")
def bars_count(spark, sf):
    return B.count_bars(tape(spark, sf), 16)


@query(f"""WITH {TAPE}, l AS (SELECT *, CAST(ts AS DATE) AS day, CAST(floor(px / 20.0) AS BIGINT) AS level FROM tape),
d AS (SELECT *, CAST(sign(level - lag(level) OVER (PARTITION BY symbol, day ORDER BY ts, id)) AS INT) AS d FROM l),
m AS (SELECT *, CASE WHEN d = lag(d) OVER (PARTITION BY symbol, day ORDER BY ts, id) THEN 0 ELSE 1 END AS nw FROM d WHERE d <> 0),
q AS (SELECT *, sum(nw) OVER (PARTITION BY symbol, day ORDER BY ts, id) AS run FROM m)
SELECT symbol, day, CAST(run AS BIGINT) AS run, min(d) AS direction, count(*) AS moves, min(level) AS low_level,
 max(level) AS high_level FROM q GROUP BY symbol, day, run""")
def bars_renko(spark, sf):
    return B.renko(tape(spark, sf), 20.0)


@query(f"""WITH {TAPE}, v AS (SELECT symbol, CAST(ts AS DATE) AS day, CAST(floor(px / 10.0) AS BIGINT) AS bin,
 CAST(sum(size) AS BIGINT) AS volume FROM tape GROUP BY 1, 2, 3),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, day ORDER BY volume DESC, bin) AS INT) AS rank FROM v) SELECT * FROM k WHERE rank <= 3""")
def volume_profile(spark, sf):
    return B.volume_profile(tape(spark, sf), 10.0, 3)


@query(f"""WITH {BARS}, e AS (SELECT *, CAST(sum(volume) OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE) AS en FROM bars),
x AS (SELECT *, en - volume AS st, unnest(range(CAST(floor((en - volume) / 400) AS BIGINT), CAST(ceil(en / 400) AS BIGINT))) AS bucket FROM e),
p AS (SELECT symbol, bucket, close >= open AS up, least(en, (bucket + 1) * 400) - greatest(st, bucket * 400) AS part FROM x),
g AS (SELECT symbol, bucket, sum(CASE WHEN up THEN part ELSE 0 END) AS u, sum(CASE WHEN up THEN 0 ELSE part END) AS d FROM p GROUP BY 1,
 2 HAVING sum(part) >= 399.9999)
SELECT symbol, bucket, CASE WHEN count(*) OVER w = 10 THEN round(sum(abs(u - d)) OVER w / 4000,
 6) END AS vpin FROM g WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS 9 PRECEDING)""")
def vpin(spark, sf):
    return B.vpin(hourly(spark, sf), 400.0, 10)


# ---- indicators

W20 = "WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), o AS (PARTITION BY symbol ORDER BY ts), w14 AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING)"


@query(f"""WITH {BARS} SELECT symbol, bar_id, CASE WHEN count(*) OVER w = 20 THEN round(avg(close) OVER w, 6) END AS sma20,
 CASE WHEN count(*) OVER w = 20 AND stddev_pop(close) OVER w > 1e-12 THEN round((close - avg(close) OVER w) / stddev_pop(close) OVER w, 6) END AS z20,
 CASE WHEN count(*) OVER w = 20 AND stddev_pop(close) OVER w > 1e-12 THEN round((close - avg(close) OVER w + 2 * stddev_pop(close) OVER w) / (4 *
 stddev_pop(close) OVER w), 6) END AS boll_b,
 CASE WHEN count(*) OVER w14 = 14 AND max(high) OVER w14 > min(low) OVER w14 THEN round(100 * (close - min(low) OVER w14) / (max(high) OVER w14 -
 min(low) OVER w14), 6) END AS stoch_k,
 CASE WHEN count(*) OVER w14 = 14 AND max(high) OVER w14 > min(low) OVER w14 THEN round(-100 * (max(high) OVER w14 - close) / (max(high) OVER w14 -
 min(low) OVER w14), 6) END AS williams,
 round((close - lag(close, 10) OVER o) / nullif(lag(close, 10) OVER o, 0), 6) AS roc10,
 round(greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)), 6) AS tr,
 CASE WHEN count(*) OVER w = 20 THEN round(volume / nullif(avg(volume) OVER w, 0), 6) END AS volume_ratio FROM bars {W20}""")
def indicators_rolling(spark, sf):
    b = hourly(spark, sf)
    return b.select("symbol", "bar_id", r(W.sma("close", 20)).alias("sma20"), r(W.zscore("close", 20)).alias("z20"),
        r(W.bollinger_b("close", 20, 2.0)).alias("boll_b"), r(W.stochastic_k(14)).alias("stoch_k"), r(W.williams_r(14)).alias("williams"),
        r(W.roc("close", 10)).alias("roc10"), r(W.true_range()).alias("tr"),
        r(F.col("volume") / F.nullif(W.sma("volume", 20), F.lit(0.0))).alias("volume_ratio"))


@query(f"""WITH {BARS}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), m AS (SELECT *,
 CASE WHEN count(*) OVER w = 20 THEN avg(tp) OVER w END AS ma FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
d AS (SELECT *, CASE WHEN count(abs(tp - ma)) OVER w = 20 THEN avg(abs(tp - ma)) OVER w END AS md FROM m WINDOW w AS (PARTITION BY symbol ORDER BY ts
 ROWS 19 PRECEDING))
SELECT symbol, bar_id, CASE WHEN md > 1e-12 THEN round((tp - ma) / (0.015 * md), 6) END AS cci FROM d""")
def indicators_cci(spark, sf):
    return W.cci(hourly(spark, sf), 20).select("symbol", "bar_id", r("cci").alias("cci"))


@query(f"""WITH RECURSIVE {BARS}, d AS (SELECT *, coalesce(greatest(close - lag(close) OVER o, 0), 0) AS gain, coalesce(greatest(lag(close) OVER o - close, 0),
 0) AS loss,
 coalesce(greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)),
 high - low) AS tr FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
e AS (SELECT symbol, bar_id, close AS f, close AS s, gain AS g, loss AS l, tr AS a FROM d WHERE bar_id = 1 UNION ALL
 SELECT d.symbol, d.bar_id, e.f + (d.close - e.f) * 2 / 13.0, e.s + (d.close - e.s) * 2 / 27.0, e.g + (d.gain - e.g) / 14.0,
 e.l + (d.loss - e.l) / 14.0, e.a + (d.tr - e.a) / 14.0 FROM e JOIN d ON d.symbol = e.symbol AND d.bar_id = e.bar_id + 1)
SELECT symbol, bar_id, round(f, 4) AS ema12, round(f - s, 4) AS macd, round(CASE WHEN g + l > 0 THEN 100 * g / (g + l) ELSE 50 END, 4) AS rsi14,
 round(a, 4) AS atr14 FROM e""")
def indicators_ewm(spark, sf):
    """EMA, MACD line, Wilder RSI and ATR from one recursive pass."""
    b = hourly(spark, sf).withColumn("tr", F.coalesce(W.true_range(), F.col("high") - F.col("low")))
    b = W.rsi(b, 14, {"fast": ("close", 2 / 13), "slow": ("close", 2 / 27), "atr": ("tr", 1 / 14)})
    return b.select("symbol", "bar_id", r("fast", 4).alias("ema12"), r(F.col("fast") - F.col("slow"), 4).alias("macd"),
        r("rsi", 4).alias("rsi14"), r("atr", 4).alias("atr14"))


@query(f"""WITH {BARS}, v AS (SELECT *, CAST(ts AS DATE) AS day, (high + low + close) / 3 AS tp, greatest(CAST(volume AS DOUBLE), 1) AS vv FROM bars),
x AS (SELECT *, sum(tp * vv) OVER w / sum(vv) OVER w AS vwap FROM v WINDOW w AS (PARTITION BY symbol, day ORDER BY ts))
SELECT symbol, bar_id, round(vwap, 6) AS vwap, round(sqrt(avg((tp - vwap) * (tp - vwap)) OVER (PARTITION BY symbol, day ORDER BY ts)),
 6) AS vwap_sd FROM x""")
def session_vwap(spark, sf):
    return W.session_vwap(hourly(spark, sf)).select("symbol", "bar_id", r("vwap").alias("vwap"), r("vwap_sd").alias("vwap_sd"))


@query(f"""WITH {BARS}, y AS (SELECT *, close - lag(close) OVER o AS dc, CAST(volume AS DOUBLE) AS v FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, bar_id, CASE WHEN count(dc) OVER w = 30 AND stddev_samp(dc) OVER w * stddev_samp(v) OVER w > 0 THEN round(corr(dc, v) OVER w,
 6) END AS corr30, CASE WHEN count(dc) OVER w = 30 THEN round(covar_samp(dc, v) OVER w / nullif(var_samp(v) OVER w, 0),
 6) END AS beta30 FROM y WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING)""")
def rolling_beta(spark, sf):
    b = hourly(spark, sf).withColumn("dc", F.col("close") - F.lag("close").over(W.by_symbol())).withColumn("v",
        F.col("volume").cast("double"))
    w = W.last_n(30)
    full = F.count("dc").over(w) == 30
    return b.select("symbol", "bar_id", F.when(full, r(correlation("dc", "v", w))).alias("corr30"),
        F.when(full, r(F.covar_samp("dc", "v").over(w) / F.nullif(F.var_samp("v").over(w), F.lit(0.0)))).alias("beta30"))


@query(f"""WITH {BARS} SELECT symbol, bar_id, CASE WHEN count(*) OVER w = 24 THEN round((len(list_filter(list(close) OVER w,
 lambda x: x < close)) + (len(list_filter(list(close) OVER w, lambda x: x = close)) + 1) / 2.0) / 24, 6) END AS rank24,
 round(quantile_cont(close, 0.5) OVER w, 6) AS median24, round(quantile_cont(close, 0.9) OVER w,
 6) AS p90 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING)""")
def rolling_rank(spark, sf):
    b = W.rank_pct(hourly(spark, sf), "close", 24, "rank24")
    w = W.last_n(24)
    return b.select("symbol", "bar_id", r("rank24").alias("rank24"), r(F.percentile("close", F.lit(0.5)).over(w)).alias("median24"),
        r(F.percentile("close", F.lit(0.9)).over(w)).alias("p90"))


FRACTAL = BARS + """, f AS (SELECT *, CASE WHEN count(*) OVER c = 7 AND lag(high, 3) OVER o = max(high) OVER c THEN lag(high, 3) OVER o END AS swing_high,
 CASE WHEN count(*) OVER c = 7 AND lag(low, 3) OVER o = min(low) OVER c THEN lag(low, 3) OVER o END AS swing_low FROM bars
 WINDOW o AS (PARTITION BY symbol ORDER BY ts), c AS (PARTITION BY symbol ORDER BY ts ROWS 6 PRECEDING)),
fr AS (SELECT *, last_value(swing_high IGNORE NULLS) OVER u AS last_high, last_value(swing_low IGNORE NULLS) OVER u AS last_low FROM f WINDOW u AS
 (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {FRACTAL} SELECT symbol, bar_id, swing_high, swing_low, last_high, last_low FROM fr")
def fractal_swings(spark, sf):
    return W.fractals(hourly(spark, sf), 3).select("symbol", "bar_id", "swing_high", "swing_low", "last_high", "last_low")


@query(f"""WITH {FRACTAL}, s AS (SELECT *, abs(close - open) > 1.2 * avg(abs(close - open)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1
 PRECEDING) AS strong FROM fr)
SELECT symbol, bar_id, CASE WHEN low > lag(high, 2) OVER o AND strong THEN round(low - lag(high, 2) OVER o, 6) END AS fvg_up,
 CASE WHEN high < lag(low, 2) OVER o AND strong THEN round(lag(low, 2) OVER o - high, 6) END AS fvg_down,
 CASE WHEN strong AND close > open THEN last_value(CASE WHEN close < open THEN low END IGNORE NULLS) OVER k END AS block_up,
 CASE WHEN strong AND close < open THEN last_value(CASE WHEN close > open THEN high END IGNORE NULLS) OVER k END AS block_down,
 CASE WHEN close > last_high AND lag(close) OVER o <= lag(last_high) OVER o THEN 1 WHEN close < last_low AND lag(close) OVER o >= lag(last_low) OVER o
 THEN -1 ELSE 0 END AS shift,
 CASE WHEN high > last_high AND close < last_high THEN -1 WHEN low < last_low AND close > last_low THEN 1 ELSE 0 END AS sweep
FROM s WINDOW o AS (PARTITION BY symbol ORDER BY ts), k AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def market_structure(spark, sf):
    b = W.structure(W.fractals(hourly(spark, sf), 3), 1.2)
    return b.select("symbol", "bar_id", r("fvg_up").alias("fvg_up"), r("fvg_down").alias("fvg_down"), "block_up", "block_down", "shift",
        "sweep")


@query(f"""WITH {BARS}, s AS (SELECT *, close - lag(close) OVER o AS st, greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) AS tr,
 CAST(sign(close - open) AS INT) + 1 AS l FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
f AS (SELECT *, CASE WHEN sign(st) * sign(lag(st) OVER (PARTITION BY symbol ORDER BY ts)) < 0 THEN 1 ELSE 0 END AS fl FROM s)
SELECT symbol, bar_id, CASE WHEN count(st) OVER w = 20 AND sum(abs(st)) OVER w > 0 THEN round(abs(sum(st) OVER w) / sum(abs(st)) OVER w,
 6) END AS efficiency,
 CASE WHEN count(st) OVER w = 20 AND max(high) OVER w > min(low) OVER w THEN round(100 * log10(sum(tr) OVER w / (max(high) OVER w - min(low) OVER w))
 / log10(20), 6) END AS choppiness,
 CAST(CASE WHEN count(st) OVER w = 20 THEN sum(fl) OVER w END AS BIGINT) AS flips, l + 3 * lag(l) OVER o + 9 * lag(l, 2) OVER o + 27 * lag(l,
 3) OVER o AS code
FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), o AS (PARTITION BY symbol ORDER BY ts)""")
def path_shape(spark, sf):
    b = W.packed_sequence(W.path_stats(hourly(spark, sf), 20), 4)
    return b.select("symbol", "bar_id", r("efficiency").alias("efficiency"), r("choppiness").alias("choppiness"), "flips", "code")


@query(f"""WITH {TAPE} SELECT symbol, id, CAST(sum(size) OVER w AS BIGINT) AS vol_1h, count(*) OVER w AS n_1h, round(px - first(px) OVER w,
 6) AS move_1h FROM tape WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""")
def rolling_time_range(spark, sf):
    t = W.trailing_time(tape(spark, sf), ["symbol"], "ts", 3600, 86_400, lambda w: {
        "vol_1h": F.sum("size").over(w), "n_1h": F.count("*").over(w), "move_1h": F.col("px") - F.first("px").over(w)})
    return t.select("symbol", "id", "vol_1h", "n_1h", r("move_1h").alias("move_1h"))


@query(f"""WITH {BARS}, d AS (SELECT *, CAST(ts AS DATE) AS day FROM bars), x AS (SELECT symbol, day, max(high) AS h, min(low) AS l, arg_max(close,
 ts) AS c FROM d GROUP BY 1, 2),
p AS (SELECT symbol, day, lag(h) OVER o AS pdh, lag(l) OVER o AS pdl, lag(c) OVER o AS pdc FROM x WINDOW o AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, bar_id, pdh, pdl, pdc, round((pdh + pdl + pdc) / 3, 6) AS pivot, round(2 * (pdh + pdl + pdc) / 3 - pdl, 6) AS r1,
 round(2 * (pdh + pdl + pdc) / 3 - pdh, 6) AS s1 FROM d JOIN p USING (symbol, day)""")
def previous_day_levels(spark, sf):
    return J.previous_day(hourly(spark, sf)).select("symbol", "bar_id", "pdh", "pdl", "pdc", r("pivot").alias("pivot"), r("r1").alias("r1"),
        r("s1").alias("s1"))


@query(f"""WITH {BARS} SELECT symbol, bar_id, max(CASE WHEN hour(ts) < 3 THEN high END) OVER d AS or_high,
 min(CASE WHEN hour(ts) < 3 THEN low END) OVER d AS or_low,
 CASE WHEN hour(ts) < 8 THEN 'asia' WHEN hour(ts) < 13 THEN 'eu' WHEN hour(ts) < 21 THEN 'us' ELSE 'other' END AS session,
 bar_id - last_value(CASE WHEN high = mh THEN bar_id END IGNORE NULLS) OVER u AS bars_since_high FROM (SELECT *, max(high) OVER (PARTITION BY symbol,
 CAST(ts AS DATE) ORDER BY ts) AS mh FROM bars)
 WINDOW d AS (PARTITION BY symbol, CAST(ts AS DATE)), u AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def opening_range(spark, sf):
    b = hourly(spark, sf).withColumn("day", F.to_date("ts"))
    d = Window.partitionBy("symbol", "day")
    u = d.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    h = F.hour("ts")
    b = b.withColumn("mh", F.max("high").over(u))
    return b.select("symbol", "bar_id", F.max(F.when(h < 3, F.col("high"))).over(d).alias("or_high"),
        F.min(F.when(h < 3, F.col("low"))).over(d).alias("or_low"),
        F.when(h < 8, "asia").when(h < 13, "eu").when(h < 21, "us").otherwise("other").alias("session"),
        (F.col("bar_id") - F.last(F.when(F.col("high") == F.col("mh"), F.col("bar_id")), True).over(u)).alias("bars_since_high"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), f AS (SELECT day, CAST(date_trunc('month', day) AS DATE) AS m FROM d),
t AS (SELECT day, m, m + CAST((5 - isodow(m) + 7) % 7 + 14 AS INT) AS third_friday FROM f)
SELECT day, third_friday, day = third_friday AS is_expiry, month(day) % 3 = 0 AND day BETWEEN third_friday - 11 AND third_friday - 7 AS roll_week,
 CAST(third_friday - day AS INT) AS days_to, day = last_day(day) AS month_end, CAST(yearweek(day) AS INT) AS iso_week FROM t""")
def expiry_calendar(spark, sf):
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    third = F.date_add(F.next_day(F.date_add(F.trunc("day", "month"), -1), "Fri"), 14)
    d = d.withColumn("third_friday", third)
    return d.select("day", "third_friday", (F.col("day") == F.col("third_friday")).alias("is_expiry"),
        ((F.month("day") % 3 == 0) & F.col("day").between(F.date_add("third_friday", -11),
        F.date_add("third_friday", -7))).alias("roll_week"), F.datediff("third_friday", "day").alias("days_to"),
        (F.col("day") == F.last_day("day")).alias("month_end"), (F.extract(F.lit("YEAROFWEEK"),
        F.col("day")) * 100 + F.weekofyear("day")).cast("int").alias("iso_week"))


# ---- joins

SIDES = TAPE + """, trades AS (SELECT * FROM tape),
quotes AS (SELECT symbol, date_trunc('hour', ts) AS ts, max(px) AS bid, min(px) AS ask FROM tape GROUP BY 1, 2)"""


def sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    t = tape(spark, sf)
    q = t.groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max("px").alias("bid"),
        F.min("px").alias("ask"))
    return t, q


@query(f"""WITH {SIDES} SELECT t.symbol, t.id, q.ts AS r_at, q.bid AS r_bid, q.ask AS r_ask FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts
 >= q.ts""")
def asof_backward(spark, sf):
    t, q = sides(spark, sf)
    return J.asof(t, q, ["symbol"], "ts", ["bid", "ask"]).select("symbol", "id", "r_at", "r_bid", "r_ask")


@query(f"""WITH {SIDES}, j AS (SELECT t.symbol, t.id, t.ts, q.ts AS qt, q.bid FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts >= q.ts)
 SELECT symbol, id, CASE WHEN qt >= ts - INTERVAL 20 MINUTE THEN qt END AS r_at, CASE WHEN qt >= ts - INTERVAL 20 MINUTE THEN bid END AS r_bid FROM j""")
def asof_tolerance(spark, sf):
    t, q = sides(spark, sf)
    return J.asof(t, q, ["symbol"], "ts", ["bid"], tolerance="20 MINUTES").select("symbol", "id", "r_at", "r_bid")


@query(f"""WITH {SIDES} SELECT t.symbol, t.id, q.ts AS r_at, q.bid AS r_bid FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts <= q.ts""")
def asof_forward(spark, sf):
    t, q = sides(spark, sf)
    return J.asof(t, q, ["symbol"], "ts", ["bid"], direction="forward").select("symbol", "id", "r_at", "r_bid")


@query(f"""WITH {SIDES}, b AS (SELECT t.symbol, t.id, t.ts, q.ts AS qt, q.bid FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts >= q.ts),
n AS (SELECT b.*, q.ts AS ft, q.bid AS fb FROM b ASOF LEFT JOIN quotes q ON b.symbol = q.symbol AND b.ts <= q.ts)
SELECT symbol, id, CASE WHEN ft IS NULL OR (qt IS NOT NULL AND ts - qt <= ft - ts) THEN qt ELSE ft END AS r_at,
 CASE WHEN ft IS NULL OR (qt IS NOT NULL AND ts - qt <= ft - ts) THEN bid ELSE fb END AS r_bid FROM n""")
def asof_nearest(spark, sf):
    t, q = sides(spark, sf)
    return J.nearest(t, q, ["symbol"], "ts", ["bid"]).select("symbol", "id", "r_at", "r_bid")


@query(f"""WITH {SIDES}, c AS (SELECT symbol, ts, sum(size) OVER (PARTITION BY symbol ORDER BY ts, id) AS cv FROM tape), p AS (SELECT symbol, ts,
 max(cv) AS cv FROM c GROUP BY 1, 2), q2 AS (SELECT symbol, ts, ts - INTERVAL 6 HOUR AS ts6 FROM quotes),
a AS (SELECT q2.*, p.cv AS c1 FROM q2 ASOF LEFT JOIN p ON q2.symbol = p.symbol AND q2.ts >= p.ts), b AS (SELECT a.*,
 p.cv AS c0 FROM a ASOF LEFT JOIN p ON a.symbol = p.symbol AND a.ts6 >= p.ts)
SELECT symbol, ts, CAST(coalesce(c1, 0) - coalesce(c0, 0) AS BIGINT) AS vol_6h FROM b""")
def asof_prefix_difference(spark, sf):
    """Volume of the last six hours as a difference of two samples of the running sum."""
    _, q = sides(spark, sf)
    c = J.running_sum(tape(spark, sf), ["symbol"], "ts", ["id"], "size", "cv")
    now = J.asof(q.select("symbol", "ts"), c, ["symbol"], "ts", ["cv"]).select("symbol", "ts", F.col("r_cv").alias("c1"))
    then = J.asof(now.select("symbol", F.col("ts").alias("at"), "c1", (F.col("ts") - F.expr("INTERVAL 6 HOURS")).alias("ts")), c,
        ["symbol"], "ts", ["cv"])
    return then.select("symbol", F.col("at").alias("ts"), (F.coalesce("c1", F.lit(0)) - F.coalesce("r_cv", F.lit(0))).alias("vol_6h"))


@query(f"""WITH {TAPE}, n AS (SELECT symbol, id AS news, ts - INTERVAL 5 MINUTE AS a, ts + INTERVAL 5 MINUTE AS b FROM tape WHERE size >= 98) SELECT t.symbol,
 n.news, count(*) AS n, round(avg(px), 6) AS mean_px FROM tape t JOIN n ON t.symbol = n.symbol AND t.ts BETWEEN n.a AND n.b GROUP BY 1, 2""")
def interval_join(spark, sf):
    t = tape(spark, sf)
    n = t.where("size >= 98").select("symbol", F.col("id").alias("news"), (F.col("ts") - F.expr("INTERVAL 5 MINUTES")).alias("a"),
        (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("b"))
    return J.within(t, n, ["symbol"], "ts", "a", "b", 600).groupBy("symbol", "news").agg(F.count("*").alias("n"),
        r(F.avg("px")).alias("mean_px"))


@query("""WITH d AS (SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2), s AS (SELECT k,
 CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY k)
SELECT k, day, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY day ROWS UNBOUNDED PRECEDING) AS v FROM s LEFT JOIN d USING (k, day)""")
def calendar_ffill(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k"),
        F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return J.on_calendar(d, "k", "day", ["v"])


@query("""WITH a AS (SELECT c_custkey AS k, c_acctbal FROM customer), b AS (SELECT o_custkey AS k,
 count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, a.c_acctbal, b.n,
 CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k""")
def reconcile_full(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal", F.lit(1).alias("in_a"))
    b = table(spark, sf, "orders").where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return a.join(b, "k", "full").select("k", "c_acctbal", "n", F.when(F.col("in_a").isNull(), "right").when(F.col("n").isNull(),
        "left").otherwise("both").alias("side"))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_custkey NOT IN
 (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def semi_anti(spark, sf):
    o = table(spark, sf, "orders")
    urgent, pending = o.where("o_orderpriority = '1-URGENT'").select("o_custkey"), o.where("o_orderstatus = 'P'").select("o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return c.join(urgent, c["c_custkey"] == urgent["o_custkey"], "left_semi").join(pending, c["c_custkey"] == pending["o_custkey"],
        "left_anti")


CONDS = BARS + """, c AS (SELECT *, lead(close, 4) OVER o - close AS fwd, close > open AS c_up, volume > avg(volume) OVER w AS c_vol,
 close > avg(close) OVER w AS c_trend, high - low > avg(high - low) OVER w AS c_wide,
 close < lag(close) OVER o AS c_down1 FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts),
 w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
m AS (SELECT symbol, bar_id, fwd, unnest(list_filter(['down1', 'trend', 'up', 'vol', 'wide'], lambda x: (x = 'down1' AND coalesce(c_down1,
 false)) OR (x = 'trend' AND c_trend) OR (x = 'up' AND c_up) OR (x = 'vol' AND c_vol) OR (x = 'wide' AND c_wide))) AS cond FROM c)"""


def masks(spark, sf) -> DataFrame:
    b, o, w = hourly(spark, sf), W.by_symbol(), W.last_n(20)
    on = lambda name, c: F.when(c, F.lit(name))
    conds = F.array_compact(F.array(on("down1", F.col("close") < F.lag("close").over(o)),
        on("trend", F.col("close") > F.avg("close").over(w)), on("up", F.col("close") > F.col("open")),
            on("vol", F.col("volume") > F.avg("volume").over(w)),
                on("wide", F.col("high") - F.col("low") > F.avg(F.col("high") - F.col("low")).over(w))))
    return b.select("symbol", "bar_id", (F.lead("close", 4).over(o) - F.col("close")).alias("fwd"), conds.alias("conds"))


@query(f"""WITH {CONDS} SELECT x.cond AS a, y.cond AS b, count(x.fwd) AS n, round(avg(x.fwd), 6) AS mean_fwd,
 round(avg(x.fwd) * sqrt(count(x.fwd)) / stddev_samp(x.fwd), 6) AS score FROM m x JOIN m y ON x.symbol = y.symbol AND x.bar_id = y.bar_id AND x.cond <
 y.cond GROUP BY 1, 2 HAVING count(x.fwd) >= 30""")
def condition_pairs(spark, sf):
    p = J.pairs_of_masks(masks(spark, sf), 30)
    return p.select("a", "b", "n", r("mean_fwd").alias("mean_fwd"), r("score").alias("score"))


@query(f"""WITH {CONDS}, k AS (SELECT symbol, bar_id, any_value(fwd) AS fwd, count(*) AS k FROM m GROUP BY 1, 2) SELECT k AS at_least,
 (SELECT count(fwd) FROM k j WHERE j.k >= q.k) AS n, (SELECT round(avg(fwd),
 6) FROM k j WHERE j.k >= q.k) AS mean_fwd FROM (SELECT DISTINCT k FROM k) q""")
def k_of_n_conditions(spark, sf):
    d = masks(spark, sf).withColumn("k", F.size("conds").cast("long")).where("k > 0").groupBy("k").agg(F.count("fwd").alias("n"),
        F.sum("fwd").alias("s"))
    w = Window.orderBy(F.desc("k"))  # as many rows as there are conditions
    return d.select(F.col("k").alias("at_least"), F.sum("n").over(w).alias("n"),
        r(F.sum("s").over(w) / F.sum("n").over(w)).alias("mean_fwd"))
