"""Named queries, continued: bars of any width, sessions, further windows, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import bars as B
from ..operators import joins as J
from ..operators import market as M
from ..operators import sessions as Z
from ..operators import windows as W
from ..operators.stats import correlation, average_rank
from ..operators.validate import draw
from ..sources.tape import table, tape
from .catalog import BARS, CONDS, SIGNED, TAPE, hourly, masks, query, r
from .catalog2 import ENTRY, LEDGER, ledger, trades
from .catalog3 import CHAIN, chain


def wide_sql(width: str) -> str:
    return TAPE + f""", b0 AS (
  SELECT symbol, time_bucket(INTERVAL '{width}', ts) AS ts, arg_min(px, (ts, id)) AS open, max(px) AS high, min(px) AS low,
         arg_max(px, (ts, id)) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS n_ticks FROM tape GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar_id FROM b0)"""


def wide(spark, sf, width: str) -> DataFrame:
    return B.with_bar_id(B.time_bars(tape(spark, sf), width))


HALF = wide_sql("30 minutes")
NY = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"
NY_MINUTE = f"(hour({NY}) * 60 + minute({NY}))"


def half_hours(spark, sf) -> DataFrame:
    return wide(spark, sf, "30 minutes")


def width_query(name: str, width: str) -> None:
    query(f"WITH {wide_sql(width)} SELECT symbol, ts, open, high, low, close, volume, n_ticks, bar_id FROM bars", name)(lambda spark,
        sf: wide(spark, sf, width))


width_query("bars_5min", "5 minutes")
width_query("bars_15min", "15 minutes")
width_query("bars_4h", "4 hours")


# ---- sessions

ZONE = "CASE " + " ".join(f"WHEN m >= {a} AND m < {b} THEN '{n}'" for n, a, b in Z.KILL_ZONES) + " END"


@query(f"""WITH {HALF}, n AS (SELECT *, {NY_MINUTE} AS m FROM bars)
SELECT symbol, bar_id, CAST({NY} AS DATE) AS ny_day, {ZONE} AS zone,
 CASE isodow(ts) WHEN 6 THEN false WHEN 7 THEN hour(ts) >= 22 WHEN 5 THEN hour(ts) < 21 ELSE hour(ts) <> 21 END AS is_open FROM n""")
def kill_zones(spark, sf):
    ts = F.col("ts")
    return half_hours(spark, sf).select("symbol", "bar_id", Z.ny_date(ts).alias("ny_day"), Z.kill_zone(ts).alias("zone"),
        Z.market_open(ts).alias("is_open"))


@query(f"""WITH {HALF}, n AS (SELECT *, {NY_MINUTE} AS m, CAST({NY} AS DATE) AS d, (high + low + close) / 3 AS tp FROM bars),
x AS (SELECT *, m >= 570 AND m < 960 AS i FROM n)
SELECT symbol, bar_id, CASE WHEN i AND count(*) FILTER (WHERE i) OVER w >= 2 THEN round(sum(tp * volume) FILTER (WHERE i) OVER w / nullif(sum(volume)
 FILTER (WHERE i) OVER w, 0), 6) END AS vwap
FROM x WINDOW w AS (PARTITION BY symbol, d ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def regular_vwap(spark, sf):
    return Z.regular_vwap(half_hours(spark, sf)).select("symbol", "bar_id", r("vwap").alias("vwap"))


@query(f"""WITH {HALF}, x AS (SELECT *, CAST(ts + INTERVAL 2 HOUR AS DATE) AS d, (high + low + close) / 3 AS tp, greatest(CAST(volume AS DOUBLE),
 1) AS v FROM bars)
SELECT symbol, bar_id, round(sum(tp * v) OVER w / sum(v) OVER w, 6) AS vwap FROM x WINDOW w AS (PARTITION BY symbol,
 d ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def trading_day_vwap(spark, sf):
    return Z.trading_day_vwap(half_hours(spark, sf)).select("symbol", "bar_id", r("vwap").alias("vwap"))


@query(f"""WITH {HALF}, d AS (SELECT symbol, CAST(ts - INTERVAL 21 HOUR AS DATE) AS session_day, arg_min(open, ts) AS first_open, arg_max(close,
 ts) AS last_close FROM bars GROUP BY 1, 2)
SELECT *, round(first_open - lag(last_close) OVER (PARTITION BY symbol ORDER BY session_day), 6) AS gap FROM d""")
def overnight_gap(spark, sf):
    return Z.overnight_gap(half_hours(spark, sf)).withColumn("gap", r("gap"))


@query(f"""WITH {HALF}, g AS (SELECT symbol, bar_id, ts, coalesce(ts > lag(ts) OVER o + INTERVAL 1 HOUR AND isodow(lag(ts) OVER o) <> 5,
 false) AS g FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, bar_id, bool_or(g) OVER (PARTITION BY symbol ORDER BY ts ROWS 5 PRECEDING) AS contaminated FROM g""")
def roll_gap_mask(spark, sf):
    return Z.roll_gap_mask(half_hours(spark, sf), 1, 6).select("symbol", "bar_id", "contaminated")


@query(f"""WITH {HALF}, f AS (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS n FROM bars WHERE hour(ts) = 13),
d AS (SELECT DISTINCT symbol, CAST(ts AS DATE) AS day FROM bars),
t AS (SELECT *, row_number() OVER (PARTITION BY symbol, date_trunc('month', day) ORDER BY day) AS a, row_number() OVER (PARTITION BY symbol,
 date_trunc('month', day) ORDER BY day DESC) AS z FROM d)
SELECT f.symbol, f.bar_id, f.close AS entry_px, CASE WHEN a <= 3 THEN 'first' WHEN z <= 3 THEN 'last' END AS turn, isodow(f.ts) = 1 AS week_open
FROM f JOIN t ON t.symbol = f.symbol AND t.day = CAST(f.ts AS DATE) WHERE n = 1""")
def calendar_signals(spark, sf):
    """Hold-at-hour entries with the turn of the month and the week's first session marked."""
    b = Z.turn_of_month(half_hours(spark, sf), 3)
    return Z.first_bar_of_hour(b, 13).select("symbol", "bar_id", F.col("close").alias("entry_px"), "turn",
        (F.weekday("ts") == 0).alias("week_open"))


# ---- windows

FORMS = "z288 d21 d89 rk55 rk233 acc".split()


@query(f"""WITH {HALF}, d AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS dc FROM bars)
SELECT symbol, bar_id, CASE WHEN count(close) OVER w288 >= 72 AND stddev_samp(close) OVER w288 > 1e-12 THEN round((close - avg(close) OVER w288) /
 stddev_samp(close) OVER w288, 6) END AS z288,
 round(close - lag(close, 21) OVER o, 6) AS d21, round(close - lag(close, 89) OVER o, 6) AS d89,
 CASE WHEN count(close) OVER w55 >= 18 THEN round((close - min(close) OVER w55) / nullif(max(close) OVER w55 - min(close) OVER w55, 0),
 6) END AS rk55,
 CASE WHEN count(close) OVER w233 >= 77 THEN round((close - min(close) OVER w233) / nullif(max(close) OVER w233 - min(close) OVER w233, 0),
 6) END AS rk233,
 round(dc - lag(dc, 21) OVER o, 6) AS acc FROM d WINDOW o AS (PARTITION BY symbol ORDER BY ts),
 w288 AS (PARTITION BY symbol ORDER BY ts ROWS 287 PRECEDING),
 w55 AS (PARTITION BY symbol ORDER BY ts ROWS 54 PRECEDING), w233 AS (PARTITION BY symbol ORDER BY ts ROWS 232 PRECEDING)""")
def condition_forms(spark, sf):
    return W.forms(half_hours(spark, sf), "close").select("symbol", "bar_id", *(r(c).alias(c) for c in FORMS))


@query(f"""WITH {BARS}, q AS (SELECT symbol, quantile_cont(volume, 0.7) AS hi, quantile_cont(volume, 0.3) AS lo FROM bars GROUP BY 1),
z AS (SELECT *, CASE WHEN count(*) OVER w = 20 AND stddev_pop(close) OVER w > 1e-12 THEN (close - avg(close) OVER w) / stddev_pop(close) OVER w END AS
 z,
 lead(close, 4) OVER (PARTITION BY symbol ORDER BY ts) - close AS fwd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
m AS (SELECT symbol, fwd, volume > hi OR volume < lo AS loud, unnest([0.5, 1.0, 1.5]) AS strength, z FROM z JOIN q USING (symbol)), k AS (SELECT *,
 unnest([1, -1]) AS side FROM m)
SELECT symbol, CAST(strength AS DOUBLE) AS strength, side, count(*) AS n, count(*) FILTER (WHERE loud) AS n_loud, round(avg(fwd),
 6) AS mean_fwd FROM k WHERE z * side > strength GROUP BY 1, 2, 3""")
def threshold_masks(spark, sf):
    """z masks at three strengths in two directions, beside a mask that is on beyond either of a symbol's own quantiles."""
    b = hourly(spark, sf)
    q = b.groupBy("symbol").agg(F.percentile("volume", F.lit(0.7)).alias("hi"), F.percentile("volume", F.lit(0.3)).alias("lo"))
    z = b.withColumns({"z": W.zscore("close", 20), "fwd": F.lead("close", 4).over(W.by_symbol()) - F.col("close")}).join(q, "symbol")
    k = z.withColumn("strength", F.explode(F.array(*map(F.lit, (0.5, 1.0, 1.5))))).withColumn("side",
        F.explode(F.array(F.lit(1), F.lit(-1)))).where("z * side > strength")
    loud = (F.col("volume") > F.col("hi")) | (F.col("volume") < F.col("lo"))
    return k.groupBy("symbol", "strength", "side").agg(F.count("*").alias("n"), F.count_if(loud).alias("n_loud"),
        r(F.avg("fwd")).alias("mean_fwd"))


@query(f"""WITH RECURSIVE {BARS}, e AS (SELECT symbol, bar_id, close AS f, close AS s, CAST(0 AS DOUBLE) AS g FROM bars WHERE bar_id = 1 UNION ALL
 SELECT b.symbol, b.bar_id, e.f + (b.close - e.f) * 2 / 13.0, e.s + (b.close - e.s) * 2 / 27.0,
  e.g + ((e.f + (b.close - e.f) * 2 / 13.0) - (e.s + (b.close - e.s) * 2 / 27.0) - e.g) * 2 / 10.0 FROM e JOIN bars b ON b.symbol = e.symbol AND
 b.bar_id = e.bar_id + 1)
SELECT symbol, bar_id, round(f - s, 4) AS macd, round(g, 4) AS macd_signal, round(f - s - g, 4) AS macd_hist FROM e""")
def macd_lines(spark, sf):
    return W.macd(hourly(spark, sf)).select("symbol", "bar_id", *(r(c, 4).alias(c) for c in ("macd", "macd_signal", "macd_hist")))


@query(f"""WITH {BARS}, k AS (SELECT *, CASE WHEN count(*) OVER w = 14 AND max(high) OVER w > min(low) OVER w THEN 100 * (close - min(low) OVER w) / (max(high)
 OVER w - min(low) OVER w) END AS k,
 greatest(high - low, abs(close - lag(close) OVER o)) AS cr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING),
 o AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, bar_id, CASE WHEN count(k) OVER w3 = 3 THEN round(avg(k) OVER w3, 6) END AS stoch_d,
 CASE WHEN count(cr) OVER w14 = 14 THEN round(avg(cr) OVER w14, 6) END AS atr_mean,
 round(avg(close) OVER dy, 6) AS day_mean FROM k WINDOW w3 AS (PARTITION BY symbol ORDER BY ts ROWS 2 PRECEDING),
 w14 AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING),
 dy AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def averages_of_ranges(spark, sf):
    """%D, the mean-of-ranges ATR, and the mean of the day so far."""
    b = hourly(spark, sf).withColumns({"k": W.stochastic_k(14), "cr": W.close_range()})
    day = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return b.select("symbol", "bar_id", r(W.strict(F.avg("k"), 3, "k")).alias("stoch_d"),
        r(W.strict(F.avg("cr"), 14, "cr")).alias("atr_mean"), r(F.avg("close").over(day)).alias("day_mean"))


@query(f"""WITH {SIGNED}, q AS (SELECT *, CASE WHEN px < lag(px) OVER w THEN -1 ELSE 1 END AS tie_buy,
 coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY symbol, day ORDER BY ts, id ROWS UNBOUNDED PRECEDING),
 0) AS sg0 FROM s0 WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, id))
SELECT symbol, day, CAST(sum(size * tie_buy) AS BIGINT) AS tie_buy, CAST(sum(size * sg0) AS BIGINT) AS from_zero,
 CAST(sum(size * CASE WHEN sg0 = 0 THEN 1 ELSE sg0 END) AS BIGINT) AS from_buy FROM q GROUP BY 1, 2""")
def sign_variants(spark, sf):
    """Signed volume of a day: ties as buys; ties inherit, with zero or a buy before the first change."""
    t = tape(spark, sf).withColumn("day", B.day())
    keys = ("symbol", "day")
    both = B.tick_sign(B.quote_sign(t, keys).withColumnRenamed("sign", "tie"), keys, 0)
    net = lambda c: F.sum(F.col("size") * c)
    return both.groupBy(*keys).agg(net(F.col("tie")).alias("tie_buy"), net(F.col("sign")).alias("from_zero"),
        net(F.when(F.col("sign") == 0, 1).otherwise(F.col("sign"))).alias("from_buy"))


@query(f"""WITH {BARS}, f AS (SELECT *, count(*) OVER c AS n, max(high) OVER c AS mh, min(low) OVER c AS ml, list(high) OVER c AS hs,
 list(low) OVER c AS ls FROM bars WINDOW c AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT symbol, bar_id, n = 7 AND high = mh AND len(list_filter(hs, lambda x: x = mh)) = 1 AS peak, n = 7 AND low = ml AND len(list_filter(ls,
 lambda x: x = ml)) = 1 AS trough FROM f""")
def unique_fractals(spark, sf):
    return W.unique_fractals(hourly(spark, sf), 3).select("symbol", "bar_id", "peak", "trough")


@query(f"""WITH {BARS}, g AS (SELECT symbol, bar_id, low, high, lag(high, 2) OVER o AS h2, lag(low,
 2) OVER o AS l2 FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
u AS (SELECT g.symbol, g.bar_id, g.h2 AS edge, coalesce(min(b.bar_id), g.bar_id + 40) AS until FROM g LEFT JOIN bars b ON b.symbol = g.symbol AND
 b.bar_id BETWEEN g.bar_id AND g.bar_id + 39 AND b.low <= g.h2 WHERE g.h2 < g.low GROUP BY 1, 2, 3),
d AS (SELECT g.symbol, g.bar_id, g.l2 AS edge, coalesce(min(b.bar_id), g.bar_id + 40) AS until FROM g LEFT JOIN bars b ON b.symbol = g.symbol AND
 b.bar_id BETWEEN g.bar_id AND g.bar_id + 39 AND b.high >= g.l2 WHERE g.l2 > g.high GROUP BY 1, 2, 3)
SELECT b.symbol, b.bar_id, (SELECT max(edge) FROM u WHERE u.symbol = b.symbol AND b.bar_id >= u.bar_id AND b.bar_id < u.until) AS gap_floor,
 (SELECT min(edge) FROM d WHERE d.symbol = b.symbol AND b.bar_id >= d.bar_id AND b.bar_id < d.until) AS gap_ceiling FROM bars b""")
def open_gaps(spark, sf):
    return W.open_gaps(hourly(spark, sf), 40).select("symbol", "bar_id", "gap_floor", "gap_ceiling")


@query(f"""WITH {BARS}, dd AS (SELECT *, CAST(ts AS DATE) AS day FROM bars), x AS (SELECT symbol, day, max(high) AS h, min(low) AS l FROM dd GROUP BY 1, 2),
p AS (SELECT symbol, day, lag(h) OVER o AS pdh, lag(l) OVER o AS pdl FROM x WINDOW o AS (PARTITION BY symbol ORDER BY day)),
s AS (SELECT dd.*, pdh, pdl, CASE WHEN count(*) OVER w3 = 3 THEN max(high) OVER w3 END AS h3,
 CASE WHEN count(*) OVER w3 = 3 THEN min(low) OVER w3 END AS l3, CASE WHEN count(*) OVER b20 = 20 THEN max(high) OVER b20 END AS sh,
 CASE WHEN count(*) OVER b20 = 20 THEN min(low) OVER b20 END AS sl FROM dd JOIN p USING (symbol,
 day) WINDOW w3 AS (PARTITION BY symbol ORDER BY ts ROWS 2 PRECEDING), b20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1
 PRECEDING))
SELECT symbol, bar_id, coalesce(h3 > pdh AND close < pdh, false) AS sweep_pdh, coalesce(l3 < pdl AND close > pdl, false) AS sweep_pdl,
 coalesce(h3 > sh AND close < sh, false) AS sweep_high, coalesce(l3 < sl AND close > sl, false) AS sweep_low FROM s""")
def level_sweeps(spark, sf):
    return W.level_sweeps(J.previous_day(hourly(spark, sf))).select("symbol", "bar_id", "sweep_pdh", "sweep_pdl", "sweep_high", "sweep_low")


@query(f"""WITH {BARS}, m AS (SELECT symbol, quantile_cont(high - low, 0.5) AS m FROM bars GROUP BY 1), e AS (SELECT symbol, bar_id, ts,
 CASE WHEN count(*) OVER w = 50 AND max(high) OVER w - high < 0.3 * m THEN 1 ELSE 0 END AS e FROM bars JOIN m USING (symbol) WINDOW w AS (PARTITION BY
 symbol ORDER BY ts ROWS 49 PRECEDING))
SELECT symbol, bar_id, CASE WHEN count(*) OVER w = 50 THEN CAST(sum(e) OVER w AS BIGINT) END AS equal_highs FROM e WINDOW w AS (PARTITION BY symbol
 ORDER BY ts ROWS 49 PRECEDING)""")
def equal_highs(spark, sf):
    return W.equal_highs(hourly(spark, sf), 50, 0.3).select("symbol", "bar_id", "equal_highs")


# ---- joins and aggregates


@query(f"""WITH {BARS}, m AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1), y AS (SELECT month(d) * 100 + day(d) AS md,
 CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1)
SELECT symbol, bar_id, coalesce(n, 0) AS n_orders FROM bars LEFT JOIN y ON md = month(ts) * 100 + day(ts)""")
def date_map(spark, sf):
    """A value looked up by the bar's calendar day."""
    d = table(spark, sf, "orders").groupBy((F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate")).alias("md")).agg(F.count("*").alias("n"))
    b = hourly(spark, sf).withColumn("md", F.month("ts") * 100 + F.dayofmonth("ts"))
    return b.join(d, "md", "left").select("symbol", "bar_id", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query(f"""WITH {LEDGER}, h AS (SELECT signal, CASE WHEN month(l_shipdate) <= 6 THEN 1 ELSE 2 END AS half, count(*) AS n, avg(pnl) AS m FROM l GROUP BY 1, 2)
SELECT a.signal, a.n AS n_first, b.n AS n_second, round(a.m, 6) AS mean_first, round(b.m, 6) AS mean_second,
 sign(a.m) = sign(b.m) AS persists FROM h a JOIN h b ON a.signal = b.signal AND a.half = 1 AND b.half = 2""")
def half_year_persistence(spark, sf):
    """The two halves of the year of each signal side by side, from one pass."""
    l = ledger(spark, sf).withColumn("first", F.month("l_shipdate") <= 6)
    part = lambda on: F.when(on, F.col("pnl"))
    a, b = part(F.col("first")), part(~F.col("first"))
    h = l.groupBy("signal").agg(F.count(a).alias("n_first"), F.count(b).alias("n_second"), F.avg(a).alias("ma"),
        F.avg(b).alias("mb")).where("n_first > 0 AND n_second > 0")
    return h.select("signal", "n_first", "n_second", r("ma").alias("mean_first"), r("mb").alias("mean_second"),
        (F.signum("ma") == F.signum("mb")).alias("persists"))


@query("""WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup'), f AS (SELECT user_id, event_id,
 ts FROM events WHERE event_type = 'purchase')
SELECT p.event_id, arg_min(f.event_id, (f.ts, f.event_id)) AS fill, min(f.ts) AS fill_ts FROM p LEFT JOIN f ON f.user_id = p.user_id AND f.ts >= p.ts
 GROUP BY 1""")
def earliest_fill(spark, sf):
    """For each setup the earliest fill of its reference at or after it: one ordered window, no pairs."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type").where(F.col("event_type").isin("signup", "purchase"))
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "signup", 0).otherwise(1), "event_id").rowsBetween(0,
        Window.unboundedFollowing)
    hit = F.first(F.when(F.col("event_type") == "purchase", F.struct("event_id", "ts")), True).over(w)
    return e.withColumn("x", hit).where("event_type = 'signup'").select("event_id", F.col("x.event_id").alias("fill"),
        F.col("x.ts").alias("fill_ts"))


@query(f"""WITH {BARS}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_max(bar_id, (high, -bar_id)) AS high_at, arg_min(bar_id, (low,
 bar_id)) AS low_at FROM bars GROUP BY 1, 2) SELECT *, high_at < low_at AS high_first FROM d""")
def high_before_low(spark, sf):
    d = hourly(spark, sf).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max_by("bar_id",
        F.struct("high", -F.col("bar_id"))).alias("high_at"), F.min_by("bar_id", F.struct("low", "bar_id")).alias("low_at"))
    return d.withColumn("high_first", F.col("high_at") < F.col("low_at"))


@query(f"""WITH {ENTRY} SELECT CAST(yearweek(ts) AS INT) AS week, symbol || '|' || exit_reason || '|' || CASE WHEN side > 0 THEN 'L' ELSE 'S' END AS cell,
 count(*) AS n, round(sum(pnl), 4) AS pnl FROM trades GROUP BY 1, 2""")
def week_cells(spark, sf):
    """Results in a tensor of weeks and cells, as rows."""
    t = trades(spark, sf)
    week = (F.extract(F.lit("YEAROFWEEK"), F.col("ts")) * 100 + F.weekofyear("ts")).cast("int")
    cell = F.concat_ws("|", "symbol", "exit_reason", F.when(F.col("side") > 0, "L").otherwise("S"))
    return t.groupBy(week.alias("week"), cell.alias("cell")).agg(F.count("*").alias("n"), r(F.sum("pnl"), 4).alias("pnl"))


@query(f"""WITH {BARS}, y AS (SELECT symbol, bar_id, CAST(volume AS DOUBLE) AS x, lead(close, 4) OVER (PARTITION BY symbol ORDER BY ts) - close AS f FROM bars),
 k AS (SELECT *, CASE WHEN bar_id <= 0.7 * max(bar_id) OVER (PARTITION BY symbol) THEN 'train' ELSE 'holdout' END AS part FROM y WHERE f IS NOT NULL),
u AS (SELECT *, (('0x' || substr(md5('ic|' || symbol || '|' || bar_id), 1, 8))::BIGINT) AS u FROM k), s AS (SELECT *,
 row_number() OVER (PARTITION BY symbol, part ORDER BY bar_id) AS i, row_number() OVER (PARTITION BY symbol, part ORDER BY u, bar_id) AS j FROM u),
p AS (SELECT a.symbol, a.part, a.x, a.f, b.f AS g FROM s a JOIN s b ON a.symbol = b.symbol AND a.part = b.part AND a.i = b.j),
q AS (SELECT symbol, part, rank() OVER (PARTITION BY symbol, part ORDER BY x) + (count(*) OVER (PARTITION BY symbol, part, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY symbol, part ORDER BY f) + (count(*) OVER (PARTITION BY symbol, part, f) - 1) / 2.0 AS rf,
 rank() OVER (PARTITION BY symbol, part ORDER BY g) + (count(*) OVER (PARTITION BY symbol, part, g) - 1) / 2.0 AS rg FROM p)
SELECT symbol, part, count(*) AS n, round(corr(rx, rf), 6) AS ic, round(corr(rx, rg), 6) AS shuffled FROM q GROUP BY 1, 2""")
def information_split(spark, sf):
    """Rank correlation of a feature with the forward move in training and holdout bars, beside a shuffled control."""
    w = W.by_symbol()
    y = hourly(spark, sf).select("symbol", "bar_id", F.col("volume").cast("double").alias("x"),
        (F.lead("close", 4).over(w) - F.col("close")).alias("f")).where("f IS NOT NULL")
    last = F.max("bar_id").over(Window.partitionBy("symbol"))
    k = hourly(spark, sf).select("symbol", "bar_id", last.alias("last")).join(y, ["symbol", "bar_id"]).withColumn("part",
        F.when(F.col("bar_id") <= 0.7 * (F.col("last") - 4), "train").otherwise("holdout"))
    key = ["symbol", "part"]
    p = Window.partitionBy(*key)
    u = draw(F.lit("ic"), "symbol", F.col("bar_id").cast("string"))
    s = k.withColumns({"i": F.row_number().over(p.orderBy("bar_id")), "u": u}).withColumn("j",
        F.row_number().over(p.orderBy("u", "bar_id")))
    s = s.select(*key, "i", "x", "f").join(s.select(*key, F.col("j").alias("i"), F.col("f").alias("g")), [*key, "i"])
    for c in "xfg":
        s = average_rank(s, key, c, f"r{c}")
    return s.groupBy(*key).agg(F.count("*").alias("n"), r(correlation("rx", "rf")).alias("ic"),
        r(correlation("rx", "rg")).alias("shuffled"))


@query(f"""WITH {LEDGER}, w AS (SELECT signal, avg(CAST(pnl > 0 AS DOUBLE)) AS a, CASE WHEN count(*) FILTER (WHERE l_discount > 0.05) >= 500 THEN avg(pnl) FILTER
 (WHERE l_discount > 0.05) / 30000 END AS b, avg(qty) / 50 AS c FROM l GROUP BY 1)
SELECT signal, round((coalesce(0.5 * a, 0) + coalesce(0.3 * b, 0) + coalesce(0.2 * c,
 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.5 END + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END),
 6) AS score FROM w""")
def weighted_available(spark, sf):
    """Weighted mean of the components that a signal has, weights re-normalised."""
    deep = F.col("l_discount") > 0.05
    w = ledger(spark, sf).groupBy("signal").agg(F.avg((F.col("pnl") > 0).cast("double")).alias("a"),
        F.when(F.count_if(deep) >= 500, F.avg(F.when(deep, F.col("pnl"))) / 30000).alias("b"), (F.avg("qty") / 50).alias("c"))
    return w.select("signal", r(S.available_mean({"a": 0.5, "b": 0.3, "c": 0.2})).alias("score"))


@query("""SELECT o_custkey, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS closed,
 round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0), 2) AS closed_value,
 round(max(o_totalprice), 2) AS best, round(avg(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))), 4) AS mean_age FROM orders GROUP BY 1""")
def ledger_lifetime(spark, sf):
    o, closed = table(spark, sf, "orders"), F.col("o_orderstatus") == "F"
    age = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(closed).alias("closed"),
        F.round(F.coalesce(F.sum(F.when(closed, F.col("o_totalprice"))), F.lit(0.0)), 2).alias("closed_value"),
        F.round(F.max("o_totalprice"), 2).alias("best"), r(F.avg(age), 4).alias("mean_age"))


@query(f"""WITH {ENTRY} SELECT CAST(ts - INTERVAL 4 HOUR AS DATE) AS day, count(*) AS n, CAST(sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins,
 round(sum(pnl), 4) AS pnl FROM trades GROUP BY 1""")
def ledger_by_day(spark, sf):
    """The ledger's day is UTC less four hours all year."""
    day = F.to_date(F.col("ts") - F.expr("INTERVAL 4 HOURS"))
    return trades(spark, sf).groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"),
        r(F.sum("pnl"), 4).alias("pnl"))


@query("""WITH g AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events)
SELECT event_type, count(gap) AS n, round(quantile_cont(gap / 1000.0, 0.5), 3) AS p50_ms, round(quantile_cont(gap / 1000.0, 0.9), 3) AS p90_ms,
 round(quantile_cont(gap / 1000.0, 0.99), 3) AS p99_ms FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def latency_report(spark, sf):
    from ..operators.stats import quantiles

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    g = table(spark, sf, "events").select("event_type", ((us - F.lag(us).over(w)) / 1000).alias("ms")).where("ms IS NOT NULL")
    q = quantiles(g, "event_type", "ms", {"p50_ms": 0.5, "p90_ms": 0.9, "p99_ms": 0.99})
    return g.groupBy("event_type").agg(F.count("*").alias("n")).join(q, "event_type").select("event_type", "n",
        *(r(c, 3).alias(c) for c in ("p50_ms", "p90_ms", "p99_ms")))


@query(f"""WITH {ENTRY}, f AS (SELECT CAST(yearweek(ts) AS INT) AS week, symbol, pnl, bars_held FROM trades), fp AS (SELECT week, sum(pnl) AS touch,
 sum(pnl) FILTER (WHERE bars_held >= 2) AS through, sum(pnl) FILTER (WHERE bars_held >= 4) AS late, count(*) AS n,
 count(*) FILTER (WHERE bars_held >= 2) AS n2 FROM f GROUP BY 1)
SELECT week, round(touch, 4) AS touch, round(through, 4) AS through, round(late, 4) AS late, round(n2 / CAST(n AS DOUBLE), 6) AS survival,
 round(through / nullif(touch, 0), 6) AS retained FROM fp""")
def fill_requirements(spark, sf):
    """Weekly results under fill conventions of rising strictness, the share that survives and what is retained."""
    week = (F.extract(F.lit("YEAROFWEEK"), F.col("ts")) * 100 + F.weekofyear("ts")).cast("int")
    on = lambda k: F.sum(F.when(F.col("bars_held") >= k, F.col("pnl")))
    p = trades(spark, sf).groupBy(week.alias("week")).agg(F.sum("pnl").alias("touch"), on(2).alias("through"), on(4).alias("late"),
        F.count("*").alias("n"), F.count_if(F.col("bars_held") >= 2).alias("n2"))
    return p.select("week", *(r(c, 4).alias(c) for c in ("touch", "through", "late")), r(F.col("n2") / F.col("n")).alias("survival"),
        r(F.col("through") / F.nullif("touch", F.lit(0.0))).alias("retained"))


@query(f"""WITH {BARS}, n AS (SELECT *, max(bar_id) OVER (PARTITION BY symbol) AS n FROM bars), k AS (SELECT symbol, unnest(range(0, 25)) AS i,
 any_value(n) AS n FROM n GROUP BY symbol)
SELECT DISTINCT b.symbol, b.bar_id, b.close FROM bars b JOIN k ON b.symbol = k.symbol AND b.bar_id = 1 + CAST(floor(k.i * (k.n - 1) / 24.0) AS BIGINT)""")
def even_subsample(spark, sf):
    """25 evenly spaced bars of each symbol (a sampling operator)."""
    b = hourly(spark, sf)
    n = b.groupBy("symbol").agg(F.max("bar_id").alias("n"))
    k = n.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i"), "n").select("symbol",
        (1 + F.floor(F.col("i") * (F.col("n") - 1) / 24.0)).cast("int").alias("bar_id")).distinct()
    return b.join(k, ["symbol", "bar_id"]).select("symbol", "bar_id", "close")


@query(f"""WITH {CONDS}, o AS (SELECT symbol, bar_id, any_value(fwd) AS fwd, list_sort(list(cond)) AS conds FROM m GROUP BY 1, 2)
SELECT list_has_any(conds, ['up', 'vol']) AS any_on, list_has_all(conds, ['up', 'vol']) AS all_on, count(*) AS n, round(avg(fwd),
 6) AS mean_fwd FROM o GROUP BY 1, 2""")
def condition_or(spark, sf):
    m = masks(spark, sf).where(F.size("conds") > 0)
    want = F.array(F.lit("up"), F.lit("vol"))
    return m.groupBy(F.arrays_overlap("conds", want).alias("any_on"),
        (F.size(F.array_except(want, "conds")) == 0).alias("all_on")).agg(F.count("*").alias("n"), r(F.avg("fwd")).alias("mean_fwd"))


GRID = "[50 + 0.5 * k FOR k IN range(0, 101)]"


@query(f"""WITH {CHAIN}, s AS (SELECT day, unnest({GRID}) AS spot2, strike, call, oi, vol, years FROM chain), d AS (SELECT *,
 (ln(spot2 / strike) + vol * vol / 2 * years) / (vol * sqrt(years)) AS d1 FROM s),
g AS (SELECT day, CAST(spot2 AS DOUBLE) AS spot, sum((CASE WHEN call THEN 1 ELSE -1 END) * exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (spot2 * vol *
 sqrt(years)) * oi * spot2 * spot2 * 0.01) AS g FROM d GROUP BY 1, 2),
x AS (SELECT *, lag(g) OVER (PARTITION BY day ORDER BY spot) AS pg, lag(spot) OVER (PARTITION BY day ORDER BY spot) AS ps FROM g)
SELECT day, round(min(ps - pg * (spot - ps) / (g - pg)) FILTER (WHERE sign(g) <> sign(pg)), 6) AS flip,
 count(*) FILTER (WHERE sign(g) <> sign(pg)) AS crossings FROM x GROUP BY 1""")
def zero_gamma_flip(spark, sf):
    """The lowest spot of a grid at which the day's signed gamma exposure changes sign, interpolated."""
    f = M.gamma_flip(chain(spark, sf), ["day"], [50 + 0.5 * k for k in range(101)])
    return f.select("day", r("flip").alias("flip"), "crossings")


# ---- scalars


@query("""WITH p AS (SELECT *, 'f' || p_size || '>q0.' || (p_partkey % 9 + 1) || ' & g' || (p_partkey % 5) || '<=q0.5' AS rule FROM part)
SELECT p_partkey, substr(p_name, 1, 4) AS head, split_part(p_type, ' ', 2) AS second, lpad(CAST(p_partkey AS VARCHAR), 8,
 '0') || '_' || p_size AS key, CAST(len(string_split(rule, '&')) AS INT) AS n_terms,
 regexp_extract(rule, '^(\\w+)\\s*(<=|>)', 1) AS feature, regexp_extract(rule, '^(\\w+)\\s*(<=|>)', 2) AS op, CAST(regexp_extract(rule, 'q([0-9.]+)',
 1) AS DOUBLE) AS q,
 round_even(p_retailprice / 50, 0) * 50 AS round_level, round(abs(p_retailprice - round_even(p_retailprice / 50, 0) * 50), 6) AS off_level,
 greatest(0.5, 1.5 + 0.5 * (p_size / 30.0 - 1) + greatest(0, 1 - p_size / 25.0) * 1.5) AS slippage,
 coalesce(map_extract(MAP {'SMALL': 1, 'MEDIUM': 2, 'LARGE': 3}, split_part(p_type, ' ', 1))[1], 0) AS class_no FROM p""")
def text_functions(spark, sf):
    p = table(spark, sf, "part").withColumn("rule", F.concat(F.lit("f"), F.col("p_size").cast("string"), F.lit(">q0."),
        (F.col("p_partkey") % 9 + 1).cast("string"), F.lit(" & g"), (F.col("p_partkey") % 5).cast("string"), F.lit("<=q0.5")))
    terms = S.rule_terms(F.col("rule"))
    first = F.get(terms, 0)
    px = F.col("p_retailprice")
    return p.select(
        "p_partkey", F.substring("p_name", 1, 4).alias("head"), F.split_part("p_type", F.lit(" "), F.lit(2)).alias("second"),
        S.padded_key(F.col("p_partkey"), F.col("p_size"), width=8).alias("key"),
        F.size(terms).alias("n_terms"), first["feature"].alias("feature"), first["op"].alias("op"), first["q"].alias("q"),
        S.round_level(px, 50.0).alias("round_level"), r(F.abs(px - S.round_level(px, 50.0))).alias("off_level"),
        S.slippage(F.col("p_size") / 25.0, F.col("p_size")).alias("slippage"),
            F.coalesce(S.looked_up(F.split_part("p_type", F.lit(" "), F.lit(1)), {"SMALL": 1, "MEDIUM": 2, "LARGE": 3}),
            F.lit(0)).alias("class_no"),
    )
