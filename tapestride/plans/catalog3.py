"""Named queries, continued: options, fills, books, searches, condition shapes and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import learn as L
from ..operators import market as M
from ..operators import windows as W
from ..sources.tape import table, tape
from .catalog import BARS, SIDES, TAPE, hourly, query, r
from .catalog2 import ENTRY, trades

CHAIN = """chain AS (SELECT CAST(ts AS DATE) AS day, 100.0 AS spot, 50 + 10 * floor(least(value, 99) / 10) AS strike, 1 + user_id % 12 AS m,
 (1 + user_id % 12) / 12.0 AS years, 0.2 + CAST(json_extract_string(props, '$.k') AS BIGINT) / 200.0 AS vol, event_type IN ('click',
 'purchase') AS call, CAST(json_extract_string(props, '$.k') AS BIGINT) AS oi, value AS price FROM events)"""


def chain(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.to_date("ts").alias("day"), F.lit(100.0).alias("spot"),
        (50 + 10 * F.floor(F.least("value", F.lit(99.0)) / 10)).cast("double").alias("strike"),
        ((1 + F.col("user_id") % 12) / 12).alias("years"), (0.2 + k / 200).alias("vol"),
        F.col("event_type").isin("click", "purchase").alias("call"), k.alias("oi"), F.col("value").alias("price"))


@query(f"""WITH {CHAIN}, d AS (SELECT *, (ln(spot / strike) + vol * vol / 2 * years) / (vol * sqrt(years)) AS d1 FROM chain), g AS (SELECT day, strike, call, oi,
 exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (spot * vol * sqrt(years)) * oi * spot * spot * 0.01 AS g FROM d),
e AS (SELECT day, CAST(strike AS DOUBLE) AS strike, sum(CASE WHEN call THEN g ELSE -g END) AS gex, CAST(sum(oi) AS BIGINT) AS oi FROM g GROUP BY 1,
 2) SELECT day, strike, round(gex, 6) AS gex, oi, CAST(row_number() OVER (PARTITION BY day ORDER BY round(abs(gex), 6) DESC,
 strike) AS INT) AS rank FROM e""")
def gamma_exposure(spark, sf):
    return M.gamma_exposure(chain(spark, sf), ["day"]).withColumn("gex", r("gex"))


@query(f"""WITH {CHAIN}, c AS (SELECT day, strike, avg(price) AS c FROM chain WHERE call GROUP BY 1, 2), p AS (SELECT day, strike,
 avg(price) AS p FROM chain WHERE NOT call GROUP BY 1, 2), x AS (SELECT day, CAST(strike AS DOUBLE) AS strike, c - p AS gap FROM c JOIN p USING (day,
 strike)), k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(abs(gap), 9), strike) AS n FROM x) SELECT day, strike,
 round(strike + gap, 6) AS spot FROM k WHERE n = 1""")
def parity_spot(spark, sf):
    return M.parity_spot(chain(spark, sf), ["day"]).select("day", "strike", r("spot").alias("spot"))


@query(f"""WITH {TAPE}, o AS (SELECT symbol, id AS order_id, ts AS placed, round(px * 0.5, 2) AS lim, size AS ahead FROM tape), t AS (SELECT o.symbol, order_id,
 t.ts, t.id, px, lim, ahead, sum(CASE WHEN px = lim THEN size ELSE 0 END) OVER (PARTITION BY o.symbol, order_id ORDER BY t.ts,
 t.id) AS done FROM o JOIN tape t ON t.symbol = o.symbol AND t.ts > placed AND t.ts <= placed + INTERVAL 3 HOUR AND px <= lim),
h AS (SELECT symbol, order_id, arg_min(ts, (ts, id)) AS fill_ts, arg_min(px < lim, (ts,
 id)) AS through FROM t WHERE px < lim OR done > ahead GROUP BY 1, 2) SELECT o.symbol, o.order_id, fill_ts, through FROM o LEFT JOIN h USING (symbol,
 order_id)""")
def queue_fills(spark, sf):
    t = tape(spark, sf)
    o = t.select("symbol", F.col("id").alias("order_id"), "ts", (F.round(F.col("px") * 0.5 * 100) / 100).alias("limit"),
        F.col("size").alias("ahead"))
    return M.queue_fills(o, t, 10_800)


@query("""WITH f AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE -1 END AS qty, value AS px FROM events),
 p AS (SELECT *, sum(qty) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM f), t AS (SELECT *,
 coalesce(sum(CAST(pos = 0 AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 0) AS trip FROM p)
SELECT user_id, CAST(trip AS BIGINT) AS trip, count(*) AS fills, CAST(max(abs(pos)) AS BIGINT) AS peak, round(sum(-qty * px),
 6) AS pnl FROM t GROUP BY 1, 2 HAVING sum(qty) = 0""")
def round_trips(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id",
        F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(-1).alias("qty"), F.col("value").alias("px"))
    return M.round_trips(e, ["user_id"], ["ts", "event_id"])


@query("""WITH g AS (SELECT l_returnflag AS flag, l_discount AS disc, l_tax AS tax, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3), i AS (SELECT *,
 dense_rank() OVER (ORDER BY disc) AS a, dense_rank() OVER (ORDER BY tax) AS b FROM g)
SELECT x.flag, x.disc, x.tax, round(any_value(x.v), 6) AS v, count(*) AS n_near, round(avg(y.v),
 6) AS near_mean FROM i x JOIN i y ON x.flag = y.flag AND abs(x.a - y.a) + abs(x.b - y.b) = 1 GROUP BY 1, 2, 3""")
def parameter_neighbours(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax")).agg(F.avg("l_quantity").alias("v"))
    return M.neighbours(g, ["flag"], ["disc", "tax"], "v").select("flag", "disc", "tax", r("v").alias("v"), "n_near",
        r("near_mean").alias("near_mean"))


@query(f"""WITH {ENTRY}, dy AS (SELECT symbol, CAST(ts AS DATE) AS day, sum(pnl) AS p FROM trades GROUP BY 1, 2), t AS (SELECT *, unnest(range(1,
 31)) AS trial FROM dy), u AS (SELECT *, ('0x' || substr(md5('order|' || trial || '|' || symbol || '|' || day), 1,
 8))::BIGINT / 4294967296.0 AS u FROM t),
eq AS (SELECT symbol, trial, u, day, sum(p) OVER w AS e FROM u WINDOW w AS (PARTITION BY symbol, trial ORDER BY u, day)), pk AS (SELECT *,
 greatest(max(e) OVER (PARTITION BY symbol, trial ORDER BY u, day), 0) AS pk FROM eq), dd AS (SELECT symbol, trial,
 min(e - pk) AS dd FROM pk GROUP BY 1, 2)
SELECT symbol, round(quantile_cont(dd, 0.05), 6) AS dd05, round(quantile_cont(dd, 0.5), 6) AS dd50, round(quantile_cont(dd, 0.95),
 6) AS dd95 FROM dd GROUP BY 1""")
def shuffled_drawdown(spark, sf):
    d = trades(spark, sf).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("p"))
    return M.order_shuffles(d, "symbol", "day", "p", 30)


@query(f"""WITH {ENTRY}, c AS (SELECT unnest([0.0, 0.25, 0.5, 1.0]) AS slip), s AS (SELECT symbol, CAST(slip AS DOUBLE) AS slip,
 pnl - 2 * slip AS p FROM trades CROSS JOIN c) SELECT symbol, slip, count(*) AS n, round(avg(p), 6) AS mean_pnl, round(avg(CAST(p > 0 AS DOUBLE)),
 6) AS win_rate FROM s GROUP BY 1, 2""")
def slippage_stress(spark, sf):
    s = trades(spark, sf).withColumn("slip", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 1.0))))).withColumn("p",
        F.col("pnl") - 2 * F.col("slip"))
    return s.groupBy("symbol", "slip").agg(F.count("*").alias("n"), r(F.avg("p")).alias("mean_pnl"),
        r(F.avg((F.col("p") > 0).cast("double"))).alias("win_rate"))


@query(f"""WITH {SIDES}, l AS (SELECT unnest([0, 60, 600]) AS lag_s), t AS (SELECT symbol, id, lag_s, ts + to_seconds(lag_s) AS ts,
 px FROM trades CROSS JOIN l) SELECT t.lag_s, count(q.bid) AS n, round(avg(q.bid - t.px),
 6) AS edge FROM t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts >= q.ts GROUP BY 1""")
def latency_sweep(spark, sf):
    from .catalog import sides

    t, q = sides(spark, sf)
    late = t.withColumn("lag_s", F.explode(F.array(*map(F.lit, (0, 60, 600))))).withColumn("ts",
        F.col("ts") + F.make_dt_interval(secs=F.col("lag_s")))
    return J.asof(late, q, ["symbol"], "ts", ["bid"]).groupBy("lag_s").agg(F.count("r_bid").alias("n"),
        r(F.avg(F.col("r_bid") - F.col("px"))).alias("edge"))


@query(f"""WITH {BARS}, m AS (SELECT *, close > avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) AS on_ FROM bars), s AS (SELECT symbol,
 bar_id, ts, on_, on_ AND NOT coalesce(lag(on_) OVER o, false) AS edge, coalesce(min(CAST(on_ AS INT)) OVER (PARTITION BY symbol ORDER BY ts ROWS 3
 PRECEDING) = 1, false) AND count(*) OVER (PARTITION BY symbol ORDER BY ts ROWS 3 PRECEDING) = 4 AS hold4,
 coalesce(max(CAST(on_ AS INT)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) = 1, false) AND NOT on_ AS after8,
 on_ AND sum(CAST(on_ AS INT)) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) = 1 AS first_today,
 CAST(on_ AS INT) + 2 * CAST(volume > 150 AS INT) + 4 * CAST(hour(ts) >= 12 AS INT) AS cell FROM m WINDOW o AS (PARTITION BY symbol ORDER BY ts))
 SELECT symbol, bar_id, edge, hold4, after8, first_today, cell FROM s""")
def condition_shapes(spark, sf):
    b = hourly(spark, sf).withColumn("on", F.col("close") > F.avg("close").over(W.last_n(10)))
    day = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts")
    bit = lambda c, k: F.shiftleft(c.cast("int"), k)
    return b.select("symbol", "bar_id", *(c.alias(n) for n, c in M.shapes(F.col("on"), W.by_symbol()).items()),
        (F.col("on") & (F.sum(F.col("on").cast("int")).over(day) == 1)).alias("first_today"),
        bit(F.col("on"), 0).bitwiseOR(bit(F.col("volume") > 150, 1)).bitwiseOR(bit(F.hour("ts") >= 12, 2)).alias("cell"))


@query(f"""WITH {BARS}, d AS (SELECT *, CAST(ts AS DATE) AS day FROM bars), x AS (SELECT symbol, day, max(high) - min(low) AS rg, arg_min(open, ts) AS op,
 arg_max(close, ts) AS cl FROM d GROUP BY 1, 2), e AS (SELECT symbol, day, round(rg / nullif(quantile_cont(rg,
 0.5) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0), 6) AS expansion,
 round(op - lag(cl) OVER (PARTITION BY symbol ORDER BY day), 6) AS gap FROM x)
SELECT symbol, bar_id, max(CASE WHEN hour(ts) < 1 THEN high END) OVER (PARTITION BY symbol, day ORDER BY ts) AS ib_high, expansion,
 gap FROM d JOIN e USING (symbol, day)""")
def initial_balance(spark, sf):
    b = hourly(spark, sf).withColumn("day", F.to_date("ts"))
    d = b.groupBy("symbol", "day").agg((F.max("high") - F.min("low")).alias("rg"), F.min_by("open", "ts").alias("op"),
        F.max_by("close", "ts").alias("cl"))
    w = Window.partitionBy("symbol").orderBy("day")
    d = d.select("symbol", "day", r(F.col("rg") / F.nullif(F.percentile("rg", F.lit(0.5)).over(w.rowsBetween(-10, -1)),
        F.lit(0.0))).alias("expansion"), r(F.col("op") - F.lag("cl").over(w)).alias("gap"))
    return b.withColumn("ib_high", F.max(F.when(F.hour("ts") < 1, F.col("high"))).over(Window.partitionBy("symbol",
        "day").orderBy("ts"))).join(d, ["symbol", "day"]).select("symbol", "bar_id", "ib_high", "expansion", "gap")


@query("""WITH s AS (SELECT c_mktsegment AS k, c_custkey, c_acctbal FROM customer), b AS (SELECT *,
 CAST(row_number() OVER (PARTITION BY k ORDER BY c_acctbal DESC, c_custkey) AS INT) AS n FROM s), e AS (SELECT *,
 ntile(4) OVER (PARTITION BY k ORDER BY c_acctbal, c_custkey) AS q FROM b) SELECT k, c_custkey, n, CAST(q AS INT) AS q,
 round(percent_rank() OVER (PARTITION BY k ORDER BY c_acctbal), 6) AS pr FROM e""")
def ranking(spark, sf):
    w = Window.partitionBy("k")
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("k"), "c_custkey", "c_acctbal")
    return c.select("k", "c_custkey", F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("n"),
        F.ntile(4).over(w.orderBy("c_acctbal", "c_custkey")).alias("q"), r(F.percent_rank().over(w.orderBy("c_acctbal"))).alias("pr"))


@query(f"""WITH {BARS}, a AS (SELECT ts, close FROM bars WHERE symbol = 'click'), b AS (SELECT ts, close FROM bars WHERE symbol = 'view'),
 j AS (SELECT coalesce(a.ts, b.ts) AS ts, a.close AS x, b.close AS y FROM a FULL JOIN b ON a.ts = b.ts), f AS (SELECT ts,
 last_value(x IGNORE NULLS) OVER w AS x, last_value(y IGNORE NULLS) OVER w AS y FROM j WINDOW w AS (ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT ts, round(x - y, 6) AS spread, CASE WHEN count(x - y) OVER k = 20 AND stddev_pop(x - y) OVER k > 1e-12 THEN round((x - y - avg(x - y) OVER k) /
 stddev_pop(x - y) OVER k, 6) END AS z FROM f WINDOW k AS (ORDER BY ts ROWS 19 PRECEDING)""")
def pair_spread(spark, sf):
    """Spread of two series on their joint calendar, values carried forward; one series pair is one ordered group."""
    return spread(spark, sf).select("ts", r("spread").alias("spread"), r("z").alias("z"))


def spread(spark, sf) -> DataFrame:
    b = hourly(spark, sf)
    one = lambda s, n: b.where(F.col("symbol") == s).select("ts", F.col("close").alias(n))
    j = one("click", "x").join(one("view", "y"), "ts", "full").withColumn("pair", F.lit("click-view"))
    w = Window.partitionBy("pair").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumns({"x": F.last("x", True).over(w), "y": F.last("y", True).over(w)}).withColumn("spread", F.col("x") - F.col("y"))
    k = Window.partitionBy("pair").orderBy("ts").rowsBetween(-19, 0)
    sd = F.when(F.count("spread").over(k) == 20, F.stddev_pop("spread").over(k))
    return j.withColumns({"z": (F.col("spread") - F.avg("spread").over(k)) / F.when(sd > 1e-12, sd),
        "step": F.row_number().over(Window.partitionBy("pair").orderBy("ts"))})


@query()
def pair_trades(spark, sf):
    return M.pair_trades(spread(spark, sf).select("pair", F.col("step").cast("long").alias("step"), "z", "spread"), "pair", "step", "z",
        "spread", 1.5, 0.2, 4.0, 40)


@query()
def forest_confusion(spark, sf):
    f = L.features(hourly(spark, sf), 6, 4.0)
    cut = F.percentile("bar_id", F.lit(0.7)).over(Window.partitionBy("symbol"))
    f = f.withColumn("_cut", cut)
    return L.confusion(L.forest(f.where("bar_id <= _cut"), f.where("bar_id > _cut"))[0])


@query()
def market_regimes(spark, sf):
    f = L.features(hourly(spark, sf), 6, 4.0)
    return L.regimes(f, ["z20", "range_ratio", "volume_ratio"]).groupBy("symbol", "regime").agg(F.count("*").alias("n"))


@query("SELECT event_id, ts, md5(event_type) AS h FROM events ORDER BY ts, event_id")
def stable_order(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", F.md5("event_type").alias("h")).orderBy("ts", "event_id")

