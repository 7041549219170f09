"""Named queries, continued: signals, simulation, statistics, validation, top-k, sets and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import joins as J
from ..operators import signals as G
from ..operators import simulate as X
from ..operators import stats as A
from ..operators import validate as V
from ..operators import windows as W
from ..sources.tape import table, tape
from .catalog import BARS, TAPE, hourly, query, r

# ---- signals and trades: fixed entries at each bar's close in the direction of its body, stop 15, target 30, ten bars

ENTRY = BARS + """, p AS (SELECT *, list(struct_pack(h := high, l := low, c := close)) OVER (PARTITION BY symbol ORDER BY bar_id ROWS BETWEEN 1 FOLLOWING AND 10
 FOLLOWING) AS path FROM bars),
e AS (SELECT symbol, bar_id, ts, CASE WHEN close >= open THEN 1 ELSE -1 END AS side, close AS entry_px,
 path FROM p WHERE path IS NOT NULL AND len(path) > 0),
x AS (SELECT symbol, bar_id, ts, side, entry_px, len(path) AS n, path[len(path)].c AS last_c, unnest(range(1, len(path) + 1)) AS k,
 unnest(path) AS b FROM e),
h AS (SELECT *, CASE WHEN side > 0 THEN b.l <= entry_px - 15 ELSE b.h >= entry_px + 15 END AS s,
 CASE WHEN side > 0 THEN b.h >= entry_px + 30 ELSE b.l <= entry_px - 30 END AS t FROM x),
o AS (SELECT symbol, bar_id, ts, side, entry_px, any_value(n) AS n, any_value(last_c) AS last_c, min(CASE WHEN s OR t THEN k END) AS k,
 arg_min(CASE WHEN s THEN 'stop' ELSE 'target' END, k) FILTER (WHERE s OR t) AS why FROM h GROUP BY ALL),
trades AS (SELECT symbol, bar_id, ts, side, entry_px, coalesce(why, 'timeout') AS exit_reason, CAST(coalesce(k, n) AS INT) AS bars_held,
 CASE WHEN why = 'stop' THEN entry_px - side * 15 WHEN why = 'target' THEN entry_px + side * 30 ELSE last_c END AS exit_px,
 side * (CASE WHEN why = 'stop' THEN entry_px - side * 15 WHEN why = 'target' THEN entry_px + side * 30 ELSE last_c END - entry_px) - 0.5 AS pnl FROM
 o)"""


def entries(spark, sf) -> DataFrame:
    b = J.forward_path(hourly(spark, sf), 10)
    side = F.when(F.col("close") >= F.col("open"), 1).otherwise(-1)
    return b.select("symbol", "bar_id", "ts", side.alias("side"), F.col("close").alias("entry_px"), "path")


def trades(spark, sf) -> DataFrame:
    e = entries(spark, sf)
    return X.first_touch(e.withColumns({"stop": F.col("entry_px") - F.col("side") * 15, "target": F.col("entry_px") + F.col("side") * 30}),
        tick=0.25).drop("stop", "target")


@query(f"""WITH {ENTRY} SELECT symbol, bar_id, side, round(entry_px, 6) AS entry_px, exit_reason, bars_held, round(exit_px, 6) AS exit_px, round(pnl,
 6) AS pnl FROM trades""")
def first_touch_trades(spark, sf):
    return trades(spark, sf).select("symbol", "bar_id", "side", r("entry_px").alias("entry_px"), "exit_reason", "bars_held",
        r("exit_px").alias("exit_px"), r("pnl").alias("pnl"))


@query(f"WITH {ENTRY} SELECT symbol, bar_id, CASE exit_reason WHEN 'target' THEN 1 WHEN 'stop' THEN -1 ELSE 0 END AS label, bars_held FROM trades")
def triple_barrier(spark, sf):
    return trades(spark, sf).select("symbol", "bar_id", F.when(F.col("exit_reason") == "target", 1).when(F.col("exit_reason") == "stop",
        -1).otherwise(0).alias("label"), "bars_held")


@query(f"""WITH {ENTRY} SELECT symbol, bar_id, round(CASE WHEN any_value(side) > 0 THEN max(b.h) - any_value(entry_px) ELSE any_value(entry_px) - min(b.l) END,
 6) AS mfe, round(CASE WHEN any_value(side) > 0 THEN min(b.l) - any_value(entry_px) ELSE any_value(entry_px) - max(b.h) END,
 6) AS mae FROM x GROUP BY 1, 2""")
def excursions(spark, sf):
    return X.excursions(entries(spark, sf).where(F.size("path") > 0)).select("symbol", "bar_id", r("mfe").alias("mfe"),
        r("mae").alias("mae"))


@query(f"""WITH {ENTRY}, bb AS (SELECT symbol, bar_id, side, entry_px, k, b, n, last_c, coalesce(CASE WHEN side > 0 THEN greatest(entry_px,
 max(b.c) OVER pr) ELSE least(entry_px, min(b.c) OVER pr) END, entry_px) AS best FROM x WINDOW pr AS (PARTITION BY symbol,
 bar_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT symbol, bar_id, any_value(side) AS side, any_value(entry_px) AS entry_px, any_value(n) AS n, any_value(last_c) AS last_c,
 min(k) FILTER (WHERE CASE WHEN side > 0 THEN b.l <= best - 20 ELSE b.h >= best + 20 END) AS k, arg_min(best,
 k) FILTER (WHERE CASE WHEN side > 0 THEN b.l <= best - 20 ELSE b.h >= best + 20 END) AS best FROM bb GROUP BY 1, 2)
SELECT symbol, bar_id, k IS NOT NULL AS trailed, CAST(coalesce(k, n) AS INT) AS bars_held, round(side * (coalesce(best - side * 20,
 last_c) - entry_px), 6) AS pnl FROM f""")
def trailing_stop(spark, sf):
    t = X.trailing(entries(spark, sf).where(F.size("path") > 0), 20.0)
    return t.select("symbol", "bar_id", "trailed", "bars_held", r("pnl").alias("pnl"))


@query(f"""WITH {ENTRY}, q AS (SELECT symbol, bar_id, side, entry_px - side * 10 AS lim, entry_px + side * 10 AS stp, k, b FROM x),
l AS (SELECT symbol, bar_id, min(k) FILTER (WHERE CASE WHEN side > 0 THEN b.l <= lim ELSE b.h >= lim END) AS lk,
 min(k) FILTER (WHERE CASE WHEN side > 0 THEN b.h >= stp ELSE b.l <= stp END) AS sk, any_value(lim) AS lim, any_value(stp) AS stp FROM q GROUP BY 1,
 2)
SELECT symbol, bar_id, 'L' AS kind, CAST(lk AS INT) AS fill_k, CASE WHEN lk IS NOT NULL THEN round(lim,
 6) END AS fill_px FROM l UNION ALL SELECT symbol, bar_id, 'S', CAST(sk AS INT), CASE WHEN sk IS NOT NULL THEN round(stp, 6) END FROM l""")
def pending_orders(spark, sf):
    e = entries(spark, sf).where(F.size("path") > 0)
    o = e.withColumn("o", F.explode(F.array(F.struct(F.lit("L").alias("kind"), (F.col("entry_px") - F.col("side") * 10).alias("px")),
        F.struct(F.lit("S").alias("kind"), (F.col("entry_px") + F.col("side") * 10).alias("px"))))).select("symbol", "bar_id", "side",
        "path", "o.kind", "o.px")
    return X.pending_fill(o).select("symbol", "bar_id", "kind", "fill_k", r("fill_px").alias("fill_px"))


@query(f"""WITH {BARS}, d AS (SELECT unnest([5.0, 10.0, 20.0]) AS d), j AS (SELECT a.symbol, a.bar_id, CAST(d.d AS DOUBLE) AS d, a.close,
 b.bar_id - a.bar_id AS k, b.high, b.low FROM bars a CROSS JOIN d LEFT JOIN bars b ON a.symbol = b.symbol AND b.bar_id BETWEEN a.bar_id + 1 AND
 a.bar_id + 10)
SELECT symbol, bar_id, d, CAST(min(k) FILTER (WHERE high >= close + d) AS INT) AS tau_up,
 CAST(min(k) FILTER (WHERE low <= close - d) AS INT) AS tau_down FROM j GROUP BY 1, 2, 3""")
def first_passage(spark, sf):
    return X.first_passage(hourly(spark, sf), 10, [5.0, 10.0, 20.0])


@query(f"""WITH {ENTRY} SELECT symbol, exit_reason, count(*) AS n, round(avg(CAST(pnl > 0 AS DOUBLE)), 6) AS win_rate, round(avg(pnl) FILTER (WHERE pnl > 0),
 6) AS avg_win, round(avg(pnl) FILTER (WHERE pnl <= 0), 6) AS avg_loss, round(avg(pnl), 6) AS expectancy,
 round(coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / nullif(-sum(pnl) FILTER (WHERE pnl <= 0), 0), 6) AS profit_factor FROM trades GROUP BY 1, 2""")
def trade_stats(spark, sf):
    return X.trade_stats(trades(spark, sf), "symbol", "exit_reason")


@query(f"""WITH {ENTRY}, r AS (SELECT symbol, bar_id, pnl < 0 AS l, bar_id - row_number() OVER (PARTITION BY symbol, pnl < 0 ORDER BY bar_id) AS g FROM trades),
 c AS (SELECT symbol, g, count(*) AS n FROM r WHERE l GROUP BY 1, 2) SELECT symbol, CAST(max(n) AS INT) AS max_losses FROM c GROUP BY 1""")
def losing_streaks(spark, sf):
    return X.loss_streaks(trades(spark, sf), "symbol", ["bar_id"])


@query(f"""WITH {ENTRY}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, sum(pnl) AS p, count(*) AS n FROM trades GROUP BY 1, 2), q AS (SELECT *,
 sum(p) OVER w AS eq FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day)), k AS (SELECT *, greatest(max(eq) OVER (PARTITION BY symbol ORDER BY day),
 0) AS pk FROM q)
SELECT symbol, day, n, round(p, 4) AS pnl, round(eq, 4) AS equity, round(eq - pk, 4) AS drawdown FROM k""")
def equity_curve(spark, sf):
    d = trades(spark, sf).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("p"), F.count("*").alias("n"))
    e = W.drawdown(d, "symbol", ["day"], "p")
    return e.select("symbol", "day", "n", r("p", 4).alias("pnl"), r("equity", 4).alias("equity"), r("drawdown", 4).alias("drawdown"))


@query(f"""WITH {ENTRY}, q AS (SELECT symbol, CAST(ts AS DATE) AS day, sum(pnl) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY bar_id) AS eq,
 bar_id FROM trades), k AS (SELECT symbol, day, eq - greatest(max(eq) OVER (PARTITION BY symbol, day ORDER BY bar_id), 0) AS dd FROM q)
SELECT symbol, day, round(min(dd), 4) AS worst FROM k GROUP BY 1, 2""")
def intraday_drawdown(spark, sf):
    t = trades(spark, sf).withColumn("key", F.concat_ws("|", "symbol", F.to_date("ts").cast("string"))).withColumn("day", F.to_date("ts"))
    return W.drawdown(t, "key", ["bar_id"], "pnl").groupBy("symbol", "day").agg(r(F.min("drawdown"), 4).alias("worst"))


@query(f"""WITH {ENTRY}, w AS (SELECT *, avg(CAST(pnl > 0 AS DOUBLE)) OVER k AS p, avg(CASE WHEN pnl > 0 THEN pnl END) OVER k AS g,
 -avg(CASE WHEN pnl <= 0 THEN pnl END) OVER k AS l, count(*) OVER k AS n FROM trades WINDOW k AS (PARTITION BY symbol ORDER BY bar_id ROWS BETWEEN 60
 PRECEDING AND 1 PRECEDING))
SELECT symbol, bar_id, CASE WHEN n = 60 AND g IS NOT NULL THEN round(least(1, greatest(0, coalesce(p - (1 - p) * l / g, p))), 6) END AS kelly FROM w""")
def kelly_fraction(spark, sf):
    return X.kelly(trades(spark, sf), "symbol", ["bar_id"], 60).select("symbol", "bar_id", r("kelly").alias("kelly"))


@query(f"""WITH RECURSIVE {ENTRY}, n AS (SELECT symbol, bar_id, bar_id + bars_held AS until FROM trades), g AS (SELECT symbol,
 min(bar_id) AS bar_id FROM n GROUP BY 1 UNION ALL SELECT g.symbol, (SELECT min(m.bar_id) FROM n m JOIN n c ON c.symbol = m.symbol AND c.bar_id =
 g.bar_id WHERE m.symbol = g.symbol AND m.bar_id > c.until) FROM g WHERE g.bar_id IS NOT NULL)
SELECT g.symbol, g.bar_id, n.until FROM g JOIN n ON n.symbol = g.symbol AND n.bar_id = g.bar_id""")
def one_position(spark, sf):
    t = trades(spark, sf).select("symbol", F.col("bar_id").cast("long").alias("bar_id"),
        (F.col("bar_id") + F.col("bars_held")).cast("long").alias("until"), F.col("bar_id").cast("long").alias("id"))
    return X.one_position(t, ["symbol"], "bar_id", "until").drop("id")


@query(f"""WITH {BARS}, d AS (SELECT *, CAST(ts AS DATE) AS day, (high + low + close) / 3 AS tp, greatest(CAST(volume AS DOUBLE), 1) AS vv FROM bars),
 x AS (SELECT symbol, day, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM d GROUP BY 1, 2),
p AS (SELECT symbol, day, lag(h) OVER o AS pdh, lag(l) OVER o AS pdl, lag(c) OVER o AS pdc FROM x WINDOW o AS (PARTITION BY symbol ORDER BY day)),
v AS (SELECT d.*, pdh, pdl, pdc, sum(tp * vv) OVER dy / sum(vv) OVER dy AS vwap, first(open) OVER dy AS op FROM d JOIN p USING (symbol,
 day) WINDOW dy AS (PARTITION BY symbol, day ORDER BY ts)),
z AS (SELECT *, CASE WHEN count(*) OVER w = 20 AND stddev_pop(close) OVER w > 1e-12 THEN (close - avg(close) OVER w) / stddev_pop(close) OVER w END AS
 z, (max(high) OVER w + min(low) OVER w) / 2 AS eq, lag(vwap) OVER dy AS vw, lag(close) OVER dy AS pc, avg(high - low) OVER w5 AS r5,
 avg(high - low) OVER w AS r20 FROM v
 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), w5 AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING),
 dy AS (PARTITION BY symbol, day ORDER BY ts)),
s AS (SELECT symbol, bar_id,
 unnest(['PDL_TOUCH','PDH_TOUCH','EQ50_LONG','EQ50_SHORT','GAP_FILL_LONG','GAP_FILL_SHORT','ZSCORE_LONG','ZSCORE_SHORT','VOL_COMP_LONG','VOL_COMP_SHORT','VWAP_RECLAIM_LONG','VWAP_REJECT_SHORT'])
 AS signal_name,
 unnest([low <= pdl AND close > pdl, high >= pdh AND close < pdh, low <= eq AND close > eq AND close > open,
 high >= eq AND close < eq AND close < open, op < pdc AND close < pdc AND close > open, op > pdc AND close > pdc AND close < open, z < -1.5, z > 1.5,
 r5 < 0.8 * r20 AND close > open, r5 < 0.8 * r20 AND close < open, pc < vw AND close > vwap, pc > vw AND close < vwap]) AS ok,
 unnest([1, -1, 1, -1, 1, -1, 1, -1, 1, -1, 1, -1]) AS side, close AS entry_px FROM z)
SELECT symbol, bar_id, signal_name, side, entry_px FROM s WHERE ok""")
def core_signals(spark, sf):
    return G.core(hourly(spark, sf)).drop("signal_time")


@query(f"""WITH {BARS}, f AS (SELECT symbol, bar_id, ts, volume, high - low AS rg, avg(high - low) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS
 ar, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars)
SELECT symbol, bar_id, CASE WHEN NOT (hour(ts) BETWEEN 6 AND 20) THEN 'session' WHEN NOT coalesce(rg > 0, false) THEN 'no range' END AS veto,
 CASE WHEN NOT (hour(ts) BETWEEN 6 AND 20) OR NOT coalesce(rg > 0, false) THEN 0.0 ELSE round((CASE WHEN coalesce(rg < 2 * ar,
 false) THEN 1.0 ELSE 0.5 END) * (CASE WHEN coalesce(close > pc, false) THEN 1.0 ELSE 0.7 END), 6) END AS size FROM f""")
def filter_chain(spark, sf):
    b = hourly(spark, sf).withColumns({"_ar": F.avg(F.col("high") - F.col("low")).over(W.last_n(20)),
        "_pc": F.lag("close").over(W.by_symbol())})
    g = G.gate(b, [("session", F.hour("ts").between(6, 20), 0), ("no range", F.col("high") > F.col("low"), 0),
        ("wide", F.col("high") - F.col("low") < 2 * F.col("_ar"), 0.5), ("bias", F.col("close") > F.col("_pc"), 0.7)])
    return g.select("symbol", "bar_id", "veto", "size")


GRID = "WITH {}, g AS (SELECT s.s AS stop, t.t AS target FROM (SELECT unnest([8.0, 15.0]) AS s) s, (SELECT unnest([10.0, 20.0, 40.0]) AS t) t)"


@query(GRID.format(ENTRY.split("\nh AS")[0].rstrip(",")) + """, h AS (SELECT symbol, bar_id, g.stop, g.target, side, entry_px, n, last_c, k,
 CASE WHEN side > 0 THEN b.l <= entry_px - stop ELSE b.h >= entry_px + stop END AS s,
 CASE WHEN side > 0 THEN b.h >= entry_px + target ELSE b.l <= entry_px - target END AS t FROM x CROSS JOIN g),
o AS (SELECT symbol, bar_id, stop, target, any_value(side) AS side, any_value(entry_px) AS e, any_value(last_c) AS last_c,
 arg_min(CASE WHEN s THEN 's' ELSE 't' END, k) FILTER (WHERE s OR t) AS why FROM h GROUP BY 1, 2, 3, 4),
pn AS (SELECT symbol, CAST(stop AS DOUBLE) AS stop, CAST(target AS DOUBLE) AS target,
 CASE WHEN why = 's' THEN -stop WHEN why = 't' THEN target ELSE side * (last_c - e) END AS pnl FROM o) SELECT symbol, stop, target, count(*) AS n,
 round(avg(pnl), 6) AS mean_pnl FROM pn GROUP BY 1, 2, 3""")
def exit_grid(spark, sf):
    """Every exit of a parameter grid on every entry; the grid is exploded beside the path, not joined."""
    e = entries(spark, sf).withColumn("g", F.explode(J.grid(stop=[8.0, 15.0], target=[10.0, 20.0, 40.0])))
    t = X.first_touch(e.select("symbol", "bar_id", "side", "entry_px", "path",
        (F.col("entry_px") - F.col("side") * F.col("g.stop")).alias("stop"),
        (F.col("entry_px") + F.col("side") * F.col("g.target")).alias("target"), "g"))
    return t.groupBy("symbol", F.col("g.stop").alias("stop"), F.col("g.target").alias("target")).agg(F.count("*").alias("n"),
        r(F.avg("pnl")).alias("mean_pnl"))


# ---- validation

DRAW = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0)"


@query(f"""WITH {ENTRY}, t AS (SELECT symbol, bar_id, side, pnl, unnest(range(1, 51)) AS trial FROM trades), n AS (SELECT symbol, trial,
 avg(pnl * side * CASE WHEN {DRAW.format("'perm|' || trial || '|' || bar_id")} < 0.5 THEN -1 ELSE 1 END) AS nul FROM t GROUP BY 1, 2),
 re AS (SELECT symbol, avg(pnl * side) AS re FROM trades GROUP BY 1)
SELECT symbol, round(any_value(re), 6) AS real_mean, CAST(sum(CAST(nul >= re AS INT)) AS BIGINT) AS beaten_by,
 round((sum(CAST(nul >= re AS INT)) + 1) / (count(*) + 1), 6) AS p_value FROM n JOIN re USING (symbol) GROUP BY 1""")
def permutation_test(spark, sf):
    return V.permutation_test(trades(spark, sf), "symbol", "pnl", "side", "bar_id", 50)


POISSON = "CASE " + " ".join(f"WHEN u < {p!r} THEN {k}" for k, p in enumerate(V.POISSON)) + f" ELSE {len(V.POISSON)} END"


@query(f"""WITH {ENTRY}, t AS (SELECT symbol, pnl, bar_id, unnest(range(1, 41)) AS trial FROM trades), u AS (SELECT *,
 {DRAW.format("'boot|' || trial || '|' || bar_id")} AS u FROM t), k AS (SELECT symbol, trial, pnl, {POISSON} AS k FROM u),
m AS (SELECT symbol, trial, sum(pnl * k) / sum(k) AS m FROM k GROUP BY 1, 2) SELECT symbol, round(quantile_cont(m, 0.05), 6) AS p05,
 round(quantile_cont(m, 0.5), 6) AS p50, round(quantile_cont(m, 0.95), 6) AS p95 FROM m GROUP BY 1""")
def bootstrap_mean(spark, sf):
    return V.bootstrap_mean(trades(spark, sf), "symbol", "pnl", "bar_id", 40)


@query(f"""WITH {ENTRY}, pz AS (SELECT symbol, pnl, (row_number() OVER (PARTITION BY symbol ORDER BY bar_id) - 1) / CAST(count(*) OVER (PARTITION BY symbol) AS
 DOUBLE) AS pos FROM trades), f AS (SELECT symbol, pnl, CASE WHEN pos < 0.6 THEN 0 ELSE least(4,
 CAST(floor((pos - 0.6) / 0.4 * 4) AS BIGINT) + 1) END AS fold FROM pz),
s AS (SELECT symbol, fold, count(*) AS n, sum(pnl) AS s FROM f GROUP BY 1, 2), b AS (SELECT symbol, fold, n, s, sum(s) OVER w AS bs,
 sum(n) OVER w AS bn FROM s WINDOW w AS (PARTITION BY symbol ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT symbol, CAST(fold AS BIGINT) AS fold, n, round(s / n, 6) AS test_mean, round(bs / bn, 6) AS train_mean,
 CAST(bn AS BIGINT) AS train_n FROM b WHERE fold > 0""")
def walk_forward(spark, sf):
    return V.walk_forward(trades(spark, sf), "symbol", ["bar_id"], "pnl", 4, 0.6)


@query(f"""WITH {ENTRY}, z AS (SELECT symbol, bar_id, pnl, CAST(ceil(max(bar_id) OVER (PARTITION BY symbol) / 5.0) AS BIGINT) AS sz FROM trades),
 c AS (SELECT a.a, b.b FROM (SELECT unnest(range(5)) AS a) a, (SELECT unnest(range(5)) AS b) b WHERE a.a < b.b),
pz AS (SELECT symbol, a || '-' || b AS combo, pnl, CASE WHEN (bar_id - 1) // sz IN (a,
 b) THEN 'test' WHEN (bar_id > a * sz - 10 AND bar_id <= (a + 1) * sz + 10) OR (bar_id > b * sz - 10 AND bar_id <= (b + 1) * sz + 10) THEN 'purged'
 ELSE 'train' END AS part FROM z CROSS JOIN c)
SELECT symbol, combo, count(*) FILTER (WHERE part = 'train') AS n_train, count(*) FILTER (WHERE part = 'test') AS n_test,
 count(*) FILTER (WHERE part = 'purged') AS n_purged, round(avg(pnl) FILTER (WHERE part = 'train'), 6) AS train_mean,
 round(avg(pnl) FILTER (WHERE part = 'test'), 6) AS test_mean FROM pz GROUP BY 1, 2""")
def purged_cv(spark, sf):
    return V.cpcv(trades(spark, sf), "symbol", "bar_id", "pnl", 5, 10)


@query(f"""WITH {ENTRY}, n AS (SELECT symbol, max(bar_id) AS n FROM trades GROUP BY 1), lo AS (SELECT symbol, bar_id FROM trades WHERE side > 0),
 s AS (SELECT lo.symbol, sh.shift, (lo.bar_id - 1 + sh.shift) % n.n + 1 AS bar_id FROM lo JOIN n USING (symbol) CROSS JOIN (SELECT unnest([0, 7, 50,
 133]) AS shift) sh)
SELECT s.symbol, s.shift, count(t.pnl) AS n, round(avg(t.pnl), 6) AS mean_value FROM s JOIN trades t USING (symbol, bar_id) GROUP BY 1, 2""")
def circular_shift_null(spark, sf):
    return V.circular_shift(trades(spark, sf).withColumn("on", F.col("side") > 0), "symbol", "bar_id", "on", "pnl", [0, 7, 50, 133])


# ---- aggregates and statistics

LEDGER = """l AS (SELECT l_returnflag || l_linestatus AS signal, l_shipdate, l_orderkey, l_linenumber, l_quantity AS qty,
 l_extendedprice * (1 - l_discount) - 30000 AS pnl, l_discount FROM lineitem)"""


def ledger(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem")
    return l.select(F.concat("l_returnflag", "l_linestatus").alias("signal"), "l_shipdate", "l_orderkey", "l_linenumber",
        F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) - 30000).alias("pnl"), "l_discount")


@query(f"""WITH {LEDGER}, c AS (SELECT signal, CASE WHEN qty < 17 THEN 'lo' WHEN qty < 34 THEN 'mid' ELSE 'hi' END AS size,
 CASE WHEN l_discount > 0.05 THEN 'hi' ELSE 'lo' END AS disc, pnl FROM l) SELECT signal, size, disc, count(*) AS n, round(sum(pnl) / count(*),
 6) AS mean_value FROM c GROUP BY CUBE (signal, size, disc)""")
def filter_lattice(spark, sf):
    l = ledger(spark, sf)
    c = l.select("signal", F.when(F.col("qty") < 17, "lo").when(F.col("qty") < 34, "mid").otherwise("hi").alias("size"),
        F.when(F.col("l_discount") > 0.05, "hi").otherwise("lo").alias("disc"), "pnl")
    return A.lattice(c, ["signal", "size", "disc"], "pnl")


@query(f"""WITH {LEDGER}, d AS (SELECT signal, CAST(l_shipdate AS DATE) AS day, sum(pnl) AS p FROM l GROUP BY 1, 2), w AS (SELECT signal, date_trunc('week',
 day) AS wk, sum(p) AS p FROM d GROUP BY 1, 2)
SELECT d.signal, count(*) AS days, round(avg(d.p), 4) AS mean_day, round(stddev_samp(d.p), 4) AS sd_day, round(any_value(x.pos), 6) AS positive_weeks,
 any_value(x.n) AS weeks FROM d JOIN (SELECT signal, avg(CAST(p > 0 AS DOUBLE)) AS pos, count(*) AS n FROM w GROUP BY 1) x USING (signal) GROUP BY 1""")
def two_level_stats(spark, sf):
    d = ledger(spark, sf).groupBy("signal", F.to_date("l_shipdate").alias("day")).agg(F.sum("pnl").alias("p"))
    w = d.groupBy("signal", F.date_trunc("week",
        "day").alias("wk")).agg(F.sum("p").alias("p")).groupBy("signal").agg(r(F.avg((F.col("p") > 0).cast("double"))).alias("positive_weeks"), F.count("*").alias("weeks"))
    return d.groupBy("signal").agg(F.count("*").alias("days"), r(F.avg("p"), 4).alias("mean_day"),
        r(F.stddev_samp("p"), 4).alias("sd_day")).join(w, "signal")


@query(f"WITH {LEDGER} SELECT year(l_shipdate) AS yr, " + ", ".join(f"round(sum(pnl) FILTER (WHERE signal = '{s}'), 2) AS \"{s}\"" for s in ("AF", "AO", "NF", "NO", "RF", "RO")) + " FROM l GROUP BY 1")
def pivot_by_signal(spark, sf):
    return ledger(spark, sf).groupBy(F.year("l_shipdate").alias("yr")).pivot("signal",
        ["AF", "AO", "NF", "NO", "RF", "RO"]).agg(r(F.sum("pnl"), 2))


@query(f"""WITH {LEDGER} SELECT signal, round(quantile_cont(pnl, 0.05), 4) AS p05, round(median(pnl), 4) AS p50, round(quantile_cont(pnl, 0.95), 4) AS p95,
 count(DISTINCT l_orderkey) AS orders FROM l GROUP BY 1""")
def exact_quantiles(spark, sf):
    l = ledger(spark, sf)
    q = A.quantiles(l, "signal", "pnl", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    orders = l.select("signal", "l_orderkey").distinct().groupBy("signal").agg(F.count("*").alias("orders"))
    return q.join(orders, "signal").select("signal", *(r(c, 4).alias(c) for c in ("p05", "p50", "p95")), "orders")


@query(f"""WITH {LEDGER}, k AS (SELECT CAST(sign(pnl) * floor(4 * ln(1 + abs(pnl))) AS INT) AS bin, qty FROM l), s AS (SELECT bin, count(*) AS n,
 sum(qty) AS s FROM k GROUP BY 1) SELECT bin, n, CAST(sum(n) OVER w AS BIGINT) AS n_from, round(sum(s) OVER w / sum(n) OVER w,
 6) AS mean_from FROM s WINDOW w AS (ORDER BY bin DESC)""")
def selection_curve(spark, sf):
    return A.selection_curve(ledger(spark, sf), "pnl", "qty")


@query(f"""WITH {BARS}, y AS (SELECT symbol, close - open AS x, CAST(volume AS DOUBLE) AS v FROM bars), k AS (SELECT *,
 rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY symbol ORDER BY v) + (count(*) OVER (PARTITION BY symbol, v) - 1) / 2.0 AS rv FROM y) SELECT symbol, count(*) AS n,
 round(corr(x, v), 6) AS pearson, round(corr(rx, rv), 6) AS spearman FROM k GROUP BY 1""")
def rank_correlation(spark, sf):
    b = hourly(spark, sf).select("symbol", (F.col("close") - F.col("open")).alias("x"), F.col("volume").cast("double").alias("v"))
    return A.spearman(b, ["symbol"], "x", "v")


@query(f"""WITH {BARS}, y AS (SELECT symbol, bar_id, close, lag(close) OVER o AS p, close - lag(close) OVER o AS d, lag(close) OVER o - lag(close,
 2) OVER o AS pd FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, round(regr_slope(close, bar_id), 9) AS trend, round(regr_intercept(close, bar_id), 6) AS level, round(corr(d, pd), 6) AS autocorr1,
 round(regr_slope(close, p), 6) AS ar1, CASE WHEN regr_slope(close, p) > 0 THEN round(-ln(2) / ln(regr_slope(close, p)),
 6) END AS half_life FROM y GROUP BY 1""")
def regression_stats(spark, sf):
    o = W.by_symbol()
    y = hourly(spark, sf).select("symbol", "bar_id", "close", F.lag("close").over(o).alias("p"),
        (F.col("close") - F.lag("close").over(o)).alias("d"), (F.lag("close").over(o) - F.lag("close", 2).over(o)).alias("pd"))
    s = F.regr_slope("close", "p")
    return y.groupBy("symbol").agg(r(F.regr_slope("close", "bar_id"), 9).alias("trend"),
        r(F.regr_intercept("close", "bar_id")).alias("level"), r(A.correlation("d", "pd")).alias("autocorr1"), r(s).alias("ar1"),
        r(F.when(s > 0, -F.ln(F.lit(2.0)) / F.ln(s))).alias("half_life"))


@query(f"""WITH {BARS}, d AS (SELECT symbol, unnest([1, 2, 4, 8, 16]) AS k, unnest([close - lag(close, 1) OVER o, close - lag(close, 2) OVER o,
 close - lag(close, 4) OVER o, close - lag(close, 8) OVER o, close - lag(close,
 16) OVER o]) AS d FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY bar_id)), v AS (SELECT symbol, k, var_pop(d) AS v FROM d GROUP BY 1,
 2) SELECT symbol, round(regr_slope(ln(v), ln(k)) / 2, 6) AS hurst FROM v WHERE v > 0 GROUP BY 1""")
def hurst_exponent(spark, sf):
    return A.lag_variance_slope(hourly(spark, sf), "symbol", "bar_id", "close", [1, 2, 4, 8, 16])


@query("""WITH s AS (SELECT DISTINCT event_type AS item, user_id AS m FROM events), n AS (SELECT item, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT x.item AS a, y.item AS b, count(*) AS common FROM s x JOIN s y ON x.m = y.m AND x.item < y.item GROUP BY 1, 2) SELECT a, b, common,
 round(common / CAST(p.n + q.n - common AS DOUBLE), 6) AS jaccard FROM c JOIN n p ON p.item = a JOIN n q ON q.item = b""")
def set_overlap(spark, sf):
    return A.overlap(table(spark, sf, "events").select("event_type", "user_id"), "event_type", "user_id")


@query(f"""WITH {BARS}, l AS (SELECT symbol, ts, lead(close, 4) OVER o - close AS fwd, CAST(sign(close - open) AS INT) + 1 + 3 * (CAST(sign(lag(close) OVER o -
 lag(open) OVER o) AS INT) + 1) + 9 * (CAST(sign(lag(close, 2) OVER o - lag(open,
 2) OVER o) AS INT) + 1) AS code FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)) SELECT code, count(*) AS n, round(avg(fwd), 6) AS mean_fwd,
 round(avg(fwd) * sqrt(count(*)), 6) AS score FROM l WHERE code IS NOT NULL AND fwd IS NOT NULL GROUP BY 1 HAVING count(*) >= 20""")
def sequence_grams(spark, sf):
    b = W.packed_sequence(hourly(spark, sf).withColumn("fwd", F.lead("close", 4).over(W.by_symbol()) - F.col("close")),
        3).where("code IS NOT NULL AND fwd IS NOT NULL")
    return b.groupBy("code").agg(F.count("*").alias("n"), r(F.avg("fwd")).alias("mean_fwd"),
        r(F.avg("fwd") * F.sqrt(F.count("*"))).alias("score")).where("n >= 20")


@query(f"""WITH {TAPE}, b AS (SELECT symbol, CASE WHEN px < 5 THEN 'low' WHEN px < 20 THEN 'mid' WHEN px < 60 THEN 'high' ELSE 'top' END AS regime, size,
 px FROM tape) SELECT symbol, regime, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(avg(size), 6) ELSE 50.0 END AS fill_mean,
 round(CASE WHEN count(*) >= 30 THEN stddev_samp(size) ELSE 1.5 * 28.87 END, 6) AS fill_sd FROM b GROUP BY 1, 2""")
def regime_calibration(spark, sf):
    """Mean and deviation by regime; a thin regime falls back to fixed values, its deviation widened."""
    b = tape(spark, sf).withColumn("regime", F.when(F.col("px") < 5, "low").when(F.col("px") < 20, "mid").when(F.col("px") < 60,
        "high").otherwise("top"))
    n = F.count("*")
    return b.groupBy("symbol", "regime").agg(n.alias("n"), F.when(n >= 30, r(F.avg("size"))).otherwise(50.0).alias("fill_mean"),
        r(F.when(n >= 30, F.stddev_samp("size")).otherwise(1.5 * 28.87)).alias("fill_sd"))


@query(f"""WITH {TAPE} SELECT hour(ts) AS hr, CAST(isodow(ts) - 1 AS INT) AS dow, count(*) AS n, round(avg(px), 6) AS mean_px,
 round(avg(CAST(px > 25 AS DOUBLE)), 6) AS hit FROM tape GROUP BY 1, 2""")
def hour_day_table(spark, sf):
    return tape(spark, sf).groupBy(F.hour("ts").alias("hr"), F.weekday("ts").alias("dow")).agg(F.count("*").alias("n"),
        r(F.avg("px")).alias("mean_px"), r(F.avg((F.col("px") > 25).cast("double"))).alias("hit"))


# ---- top-k, sets, scalars


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC,
 o_orderkey) AS INT) AS rank FROM orders) WHERE rank <= 2""")
def top_k_per_key(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("rank",
        F.row_number().over(w)).where("rank <= 2")


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500")
def latest_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate").orderBy(F.desc("o_orderdate"),
        F.desc("o_orderkey")).limit(500)


@query("""SELECT o_custkey, arg_min(o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, -o_totalprice, o_orderkey)) AS best FROM orders GROUP BY 1""")
def best_candidate(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey",
        F.struct(F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), -F.col("o_totalprice"), "o_orderkey")).alias("best"))


@query("""WITH a AS (SELECT o_custkey AS k, 1 AS prio, o_orderdate AS ts, o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'),
 b AS (SELECT o_custkey, 0, o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F') SELECT k, id, v FROM (SELECT *,
 row_number() OVER (PARTITION BY k ORDER BY prio, ts DESC, id DESC) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE n = 1""")
def live_over_history(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus", F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    both = o.where("o_orderstatus = 'F'").withColumn("prio", F.lit(1)).unionByName(o.where("o_orderstatus <> 'F'").withColumn("prio",
        F.lit(0)))
    w = Window.partitionBy("k").orderBy("prio", F.desc("ts"), F.desc("id"))
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").select("k", "id", "v")


@query("""WITH u AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) SELECT d,
 'both' AS kind FROM (SELECT d FROM u INTERSECT SELECT d FROM s) UNION ALL SELECT d,
 'orders' FROM (SELECT d FROM u EXCEPT SELECT d FROM s) UNION ALL SELECT d, 'ships' FROM (SELECT d FROM s EXCEPT SELECT d FROM u)""")
def calendar_sets(spark, sf):
    u = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    s = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    tag = lambda df, kind: df.withColumn("kind", F.lit(kind))
    return tag(u.intersect(s), "both").unionByName(tag(u.exceptAll(s), "orders")).unionByName(tag(s.exceptAll(u), "ships"))


@query("""SELECT p_partkey, round_even(p_retailprice / 0.25, 0) * 0.25 AS nearest, floor(round(p_retailprice / 0.25, 9)) * 0.25 AS down,
 ceil(round(p_retailprice / 0.25, 9)) * 0.25 AS up, least(1500, greatest(1000, p_retailprice)) AS clipped, regexp_extract(p_brand, '(\\d+)',
 1) AS brand_no, upper(substr(p_type, 1, 3)) AS head, sha256(p_name) AS digest, md5(p_brand) AS brand_md5, split_part(p_name, ' ',
 1) AS first_word FROM part""")
def scalar_functions(spark, sf):
    p = table(spark, sf, "part")
    px = F.col("p_retailprice")
    return p.select("p_partkey", S.to_tick(px, 0.25).alias("nearest"), S.to_tick(px, 0.25, "down").alias("down"),
        S.to_tick(px, 0.25, "up").alias("up"), S.clip(px, 1000.0, 1500.0).alias("clipped"),
            F.regexp_extract("p_brand", r"(\d+)", 1).alias("brand_no"), F.upper(F.substring("p_type", 1, 3)).alias("head"),
            F.sha2("p_name", 256).alias("digest"), F.md5("p_brand").alias("brand_md5"),
            F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_word"))


@query("""SELECT event_id, CAST((ts + INTERVAL 2 HOUR) AS DATE) AS trading_day, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS TIMESTAMP) AS
 ny, CAST(isodow(ts) - 1 AS INT) AS dow, quarter(ts) AS q, date_trunc('minute', ts) AS minute FROM events""")
def date_functions(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return e.select("event_id", S.trading_day(F.col("ts")).alias("trading_day"), S.new_york(F.col("ts")).cast("timestamp_ntz").alias("ny"),
        F.weekday("ts").alias("dow"), F.quarter("ts").alias("q"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"))


@query(r"""SELECT conv_id, turn, CAST(len(regexp_extract_all(lower(text), '\b(the|and|for)\b')) AS INT) AS hits, contains(text, 'the') AS has_the,
 length(trim(text)) AS n FROM conversations""")
def keyword_counts(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", S.mentions(F.col("text"), ["the", "and", "for"]).alias("hits"),
        F.contains("text", F.lit("the")).alias("has_the"), F.length(F.trim("text")).alias("n"))
