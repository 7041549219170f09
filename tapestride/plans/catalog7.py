"""Named queries, continued: gates, fills, validation, reports and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import fills as X
from ..operators import gates as G
from ..operators import joins as J
from ..operators import market as M
from ..operators import more as O
from ..operators import sessions as Z
from ..operators import signals as S
from ..operators import validate as V
from ..operators import windows as W
from ..operators.validate import draw
from ..sources.tape import table, tape
from .catalog import BARS, SQL, TAPE, hourly, query, r
from .catalog2 import DRAW, ENTRY, entries, trades
from .catalog5 import NY, ZONE

# ---- gates

ADVERSE = """q0 AS (SELECT *, high - low AS sp, ln(close) - ln(lag(close) OVER o) AS ret,
 CASE WHEN close < lag(close) OVER o THEN -1 ELSE 1 END AS dir FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
q1 AS (SELECT *, greatest(CASE WHEN count(sp) OVER w >= 5 THEN avg(sp) OVER w END, 1e-9) AS base, sp - lag(sp) OVER o AS ds, lag(ret) OVER o AS pr,
 row_number() OVER o AS rn FROM q0 WINDOW o AS (PARTITION BY symbol ORDER BY ts), w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
q2 AS (SELECT *, CASE WHEN stddev_samp(CASE WHEN pr IS NOT NULL THEN ret END) OVER k * stddev_samp(CASE WHEN ret IS NOT NULL THEN pr END) OVER k > 0
 THEN abs(covar_samp(ret, pr) OVER k / (stddev_samp(CASE WHEN pr IS NOT NULL THEN ret END) OVER k * stddev_samp(CASE WHEN ret IS NOT NULL THEN pr END)
 OVER k)) ELSE 0 END AS sc,
 abs(sum(volume * dir) OVER w) / nullif(sum(volume) OVER w, 0) AS imb, avg(ds) OVER w5 AS dm,
 CASE WHEN count(*) OVER w50 = 50 THEN avg(sp) OVER w50 END AS ms, CASE WHEN count(*) OVER w50 = 50 THEN avg(volume) OVER w50 END AS mv
 FROM q1 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), k AS (PARTITION BY symbol ORDER BY ts ROWS 48 PRECEDING),
 w5 AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING), w50 AS (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING)),
q3 AS (SELECT *, least(1, greatest(0, 0.35 * least(1, greatest(0, (sp / base - 1) / 2)) + 0.2 * least(1, greatest(0, dm / base * 5)) + 0.25 * least(1,
 sc) + 0.2 * coalesce(imb, 0))) AS raw, coalesce(sp > 3 * ms AND ms > 0 AND volume < 0.3 * mv AND mv > 0, false) AS shut FROM q2),
q4 AS (SELECT *, CASE WHEN rn < 30 THEN 0.3 WHEN shut THEN greatest(raw, 0.9) ELSE raw END AS score FROM q3),
adverse AS (SELECT *, CASE WHEN round(score, 9) < 0.3 THEN 'LOW' WHEN round(score, 9) < 0.5 THEN 'NORMAL' WHEN round(score,
 9) < 0.7 THEN 'ELEVATED' WHEN round(score, 9) < 0.85 THEN 'HIGH' ELSE 'EXTREME' END AS as_regime FROM q4)"""


@query(f"WITH {BARS}, {ADVERSE} SELECT symbol, bar_id, round(score, 6) AS score, as_regime FROM adverse")
def adverse_selection(spark, sf):
    return G.adverse_selection(hourly(spark, sf)).select("symbol", "bar_id", r("score").alias("score"), "as_regime")


REGIME = """dr AS (SELECT symbol, CAST(ts AS DATE) AS day, max(high) - min(low) AS rg FROM bars GROUP BY 1, 2),
dv AS (SELECT symbol, day, CASE WHEN count(rg) OVER l = 20 THEN avg(rg) OVER s / nullif(avg(rg) OVER l,
 0) END AS ratio FROM dr WINDOW l AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
 s AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
regime AS (SELECT symbol, day, CASE WHEN ratio > 1.5 THEN 'HIGH' WHEN ratio < 0.7 THEN 'LOW' ELSE 'NORMAL' END AS regime,
 CASE WHEN ratio > 1.5 THEN 20.0 WHEN ratio < 0.7 THEN 10.0 ELSE 15.0 END AS stop_points,
 CASE WHEN ratio > 1.5 THEN 0.5 ELSE 1.0 END AS size_mult FROM dv)"""


@query(f"""WITH {BARS}, {REGIME} SELECT symbol, day, regime, CAST(stop_points AS DOUBLE) AS stop_points, CAST(size_mult AS DOUBLE) AS size_mult FROM regime""")
def vol_regime(spark, sf):
    return G.vol_regime(hourly(spark, sf))


def prefixed(names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"starts_with(signal_name, '{p}')" for p in names) + ")"


CHAIN = f"""WITH {BARS}, {ADVERSE}, {REGIME}, sig AS ({SQL['core_signals']}), bias AS ({SQL['daily_bias']}), lv AS ({SQL['previous_day_levels']}),
mid AS (SELECT symbol, bar_id, ts, (max(high) OVER w + min(low) OVER w) / 2 AS eq,
 (hour({NY}) * 60 + minute({NY})) AS m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
j AS (SELECT sig.*, mid.ts, m, eq, pdh, pdl, pdc, coalesce(bias, 0) AS bias, stop_points, size_mult, as_regime FROM sig JOIN mid USING (symbol,
 bar_id) JOIN lv USING (symbol, bar_id) JOIN bias USING (symbol, bar_id)
 JOIN regime ON regime.symbol = sig.symbol AND regime.day = CAST(mid.ts AS DATE) JOIN adverse a ON a.symbol = sig.symbol AND a.bar_id = sig.bar_id),
t AS (SELECT *, {ZONE} AS zone, least(CASE WHEN pdh > 0 THEN abs(entry_px - pdh) END, CASE WHEN pdl > 0 THEN abs(entry_px - pdl) END,
 CASE WHEN eq > 0 THEN abs(entry_px - eq) END) AS gap,
 CASE WHEN starts_with(signal_name, 'GAP_FILL_') THEN coalesce(CASE WHEN pdc > 0 THEN pdc END, eq,
 entry_px) WHEN {prefixed(('PDL_', 'PDH_', 'EQ50_'))} THEN eq WHEN starts_with(signal_name,
 'ZSCORE_') THEN entry_px + 25 * side WHEN starts_with(signal_name, 'VWAP_') THEN entry_px + 20 * side ELSE entry_px + 30 * side END AS target,
 CASE signal_name WHEN 'GAP_FILL_SHORT' THEN 4.0 WHEN 'GAP_FILL_LONG' THEN 1.3 WHEN 'VWAP_RECLAIM_LONG' THEN 1.5 WHEN 'VWAP_REJECT_SHORT' THEN 1.5
 ELSE 2.0 END AS need FROM j),
k AS (SELECT *, {prefixed(G.BIAS_EXEMPT)} OR CASE WHEN side > 0 THEN bias > -3 ELSE bias < 3 END AS ok_bias,
 {prefixed(G.ZONE_EXEMPT)} OR zone IS NOT NULL AS ok_zone, {prefixed(G.LEVEL_EXEMPT)} OR gap IS NULL OR gap <= 30 AS ok_level,
 coalesce(side * (target - entry_px) > 0 AND side * (target - entry_px) / stop_points >= need, false) AS ok_ratio, as_regime NOT IN ('HIGH',
 'EXTREME') AS ok_adverse FROM t),"""


@query(CHAIN + """ v AS (SELECT *, CASE WHEN NOT ok_bias THEN 'bias' WHEN NOT ok_ratio THEN 'ratio' WHEN NOT ok_adverse THEN 'adverse' END AS veto FROM k)
SELECT symbol, bar_id, signal_name, veto, round(target, 6) AS target, round(CASE WHEN veto IS NULL THEN (CASE WHEN ok_zone THEN 1 ELSE 0.5 END) *
 (CASE WHEN ok_level THEN 1 ELSE 0.5 END) * (CASE WHEN as_regime = 'ELEVATED' THEN 0.5 ELSE 1 END) * size_mult ELSE 0 END, 6) AS size FROM v""")
def signal_chain(spark, sf):
    """The core signals through the whole chain of checks in the MODERATE mode: first veto, target, product of sizes."""
    g = S.gate(checked(spark, sf), chain_checks("MODERATE"))
    return g.select("symbol", "bar_id", "signal_name", "veto", r("target").alias("target"),
        r(F.when(F.col("veto").isNull(), F.col("size") * F.col("size_mult")).otherwise(0.0)).alias("size"))


def checked(spark, sf) -> DataFrame:
    b = hourly(spark, sf)
    sig = S.core(b, ("pdh", "pdl", "pdc", "_eq")).withColumn("day", F.to_date("signal_time"))
    bias = O.daily_bias(b).select("symbol", "bar_id", "bias")
    adverse = G.adverse_selection(b).select("symbol", "bar_id", "as_regime")
    j = sig.join(bias, ["symbol", "bar_id"]).join(adverse, ["symbol", "bar_id"]).join(G.vol_regime(b), ["symbol", "day"])
    name, side, px = F.col("signal_name"), F.col("side"), F.col("entry_px")
    j = j.withColumn("target", G.derived_target(name, side, px, F.col("pdc"), F.col("_eq")))
    ratio = G.reward_ratio(side, px, F.col("stop_points"), F.col("target"))
    return j.withColumns({
        "ok_bias": G.bias_allows(name, side, F.col("bias")), "ok_zone": G.begins_with(name,
        G.ZONE_EXEMPT) | Z.kill_zone(F.col("signal_time")).isNotNull(),
        "ok_level": G.near_level(name, px, [F.col("pdh"), F.col("pdl"), F.col("_eq")], 30.0), "ok_ratio": ratio >= G.least_ratio(name),
        "ok_adverse": ~F.col("as_regime").isin("HIGH", "EXTREME"),
    })


def chain_checks(mode: str) -> list:
    rules = G.MODES[mode]
    hard = [(n, F.col(f"ok_{n}"), m) for n, m in rules.items()]
    return hard + [("elevated", F.col("as_regime") != "ELEVATED", 0.5)]


@query(CHAIN + f""" s AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {x['bias']}, {x['zone']}, {x['level']})" for m, x in G.MODES.items())}) t(mode, b, z, l)),
v AS (SELECT mode, k.*, CASE WHEN b = 0 AND NOT ok_bias THEN 'bias' WHEN z = 0 AND NOT ok_zone THEN 'zone' WHEN l = 0 AND NOT ok_level THEN 'level'
 WHEN NOT ok_ratio THEN 'ratio' WHEN NOT ok_adverse THEN 'adverse' END AS veto FROM k CROSS JOIN s) SELECT mode, coalesce(veto, 'none') AS veto,
 count(*) AS n FROM v GROUP BY 1, 2""")
def filter_modes(spark, sf):
    """How the modes decide on the same signals; the checks are evaluated once, a mode is a row beside them."""
    c = checked(spark, sf)
    rows = F.array(*(F.struct(F.lit(m).alias("mode"), S.veto_of(chain_checks(m)).alias("veto")) for m in G.MODES))
    return c.select(F.inline(rows)).groupBy("mode", F.coalesce("veto", F.lit("none")).alias("veto")).agg(F.count("*").alias("n"))


@query(f"""WITH {ENTRY}, k AS (SELECT symbol, bar_id, side, (bar_id % 10) / 10.0 + 0.05 AS conf, CASE WHEN bar_id % 3 = 0 THEN -side ELSE side END AS pred,
 CASE WHEN bar_id % 7 = 0 THEN 0.0 WHEN bar_id % 5 = 0 THEN 0.5 ELSE 1.0 END AS mult FROM trades),
f AS (SELECT symbol, avg(CAST(pnl > 0 AS DOUBLE)) AS w, sum(pnl) FILTER (WHERE pnl > 0) / -sum(pnl) FILTER (WHERE pnl <= 0) AS pf FROM trades GROUP BY
 1), y AS (SELECT symbol, CASE WHEN w > 0 AND w < 1 AND pf > 0 THEN least(1, greatest(0,
 w - (1 - w) / (pf * (1 - w) / w))) ELSE 0 END AS kelly FROM f),
z AS (SELECT k.*, kelly, greatest(0.5, least(1.5, 1.4 + 1.6 * (conf - 0.5))) * mult AS p FROM k JOIN y USING (symbol))
SELECT symbol, bar_id, CASE WHEN conf < 0.55 THEN 'REDUCE' WHEN pred = side THEN 'AGREE' ELSE 'REJECT' END AS model,
 CAST(CASE WHEN p <= 0 THEN 0 ELSE least(10, round_even(2 * (1 + kelly) * p, 0)) END AS INT) AS contracts FROM z""")
def position_sizes(spark, sf):
    from ..functions.scalar import kelly_from_profit_factor

    t = trades(spark, sf)
    f = t.groupBy("symbol").agg(F.avg((F.col("pnl") > 0).cast("double")).alias("w"),
        (F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))) / -F.sum(F.when(F.col("pnl") <= 0, F.col("pnl")))).alias("pf"))
    f = f.select("symbol", kelly_from_profit_factor(F.col("w"), F.col("pf")).alias("kelly"))
    k = F.col("bar_id")
    conf, pred = (k % 10) / 10 + 0.05, F.when(k % 3 == 0, -F.col("side")).otherwise(F.col("side"))
    mult = F.when(k % 7 == 0, 0.0).when(k % 5 == 0, 0.5).otherwise(1.0)
    t = t.select("symbol", "bar_id", "side", conf.alias("conf"), pred.alias("pred"), mult.alias("mult")).join(f, "symbol")
    return t.select("symbol", "bar_id", G.model_confirms(F.col("side"), F.col("pred"), F.col("conf")).alias("model"),
        G.position_size(F.col("kelly"), F.col("conf"), [F.col("mult")], cap=0.25).alias("contracts"))


@query(f"""WITH {BARS}, y AS (SELECT make_date(2024, month(o_orderdate), 1) AS d, round(avg(o_totalprice), 2) AS v FROM orders GROUP BY 1),
a AS (SELECT b.symbol, b.bar_id, CAST(b.ts AS DATE) AS day, y.d AS of, y.v FROM (SELECT *, CAST(ts AS DATE) AS k FROM bars) b ASOF LEFT JOIN y ON b.k > y.d)
SELECT symbol, bar_id, v, coalesce(date_diff('day', of, day) <= 10 AND v > 1000, false) AS gate_open FROM a""")
def fresh_gate(spark, sf):
    """A monthly value lets trades through while it is at most ten days old and large enough; missing is closed."""
    month = F.make_date(F.lit(2024), F.month("o_orderdate"), F.lit(1))
    v = table(spark, sf, "orders").groupBy(month.alias("d")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    b = hourly(spark, sf).select("symbol", "bar_id", "ts")
    return G.fresh_gate(b, v, "ts", "d", "v", F.col("r_v") > 1000, 10).select("symbol", "bar_id", "v", "gate_open")


@query(f"""WITH {ENTRY}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, sum(pnl) AS p FROM trades GROUP BY 1, 2), a AS (SELECT symbol, sum(p) AS s, count(*) AS n,
 max(p) AS b FROM d GROUP BY 1)
SELECT symbol, round(s, 4) AS profit, n AS days, round(CASE WHEN s > 0 THEN b / s END, 6) AS best_share,
 CASE WHEN s < 200 THEN 'profit' WHEN n < 10 THEN 'days' WHEN s > 0 AND b / s > 0.5 THEN 'consistency' ELSE 'eligible' END AS verdict FROM a""")
def prop_audit(spark, sf):
    d = trades(spark, sf).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("p"))
    return G.prop_audit(d, "symbol", "day", "p", 200.0, 10, 0.5)


def timed(spark, sf) -> DataFrame:
    """Trades with entry and exit times (an hour a bar), one book for all symbols."""
    t = trades(spark, sf)
    hours = F.make_dt_interval(hours=F.col("bars_held"))
    return t.select(F.lit("book").alias("book"), "symbol", F.concat_ws("-", "symbol",
        F.lpad(F.col("bar_id").cast("string"), 9, "0")).alias("id"), F.col("ts").alias("entry"), (F.col("ts") + hours).alias("exit"),
        "side", "pnl")


@query()
def account_gates(spark, sf):
    """Each symbol's trades through the gates of an account of its own."""
    limits = G.Limits(cooldown=3600, per_day=3, losses=3, pause=7200, day_loss=40.0, start=1000.0, trail=400.0, buffer=50.0,
        windows=((2, 22),), sizes=((300.0, 2), (0.0, 1)))
    return G.account_gates(timed(spark, sf).drop("book", "side"), "symbol", limits).select("symbol", "id", "denied", "qty")


@query()
def book_limits(spark, sf):
    t = timed(spark, sf).withColumn("margin", F.lit(100.0))
    return G.book_limits(t, "book", "symbol", 3, 250.0, (0.5, 0.01)).select("id", "denied")


# ---- fills and exits


def ordered(spark, sf, gap: float) -> DataFrame:
    e = entries(spark, sf).where(F.size("path") > 0)
    return e.withColumn("px", F.col("entry_px") - F.col("side") * gap)


PATHS = BARS + """, p AS (SELECT *, CASE WHEN close >= open THEN 1 ELSE -1 END AS side, list(struct_pack(h := high, l := low, c := close,
 o := open)) OVER (PARTITION BY symbol ORDER BY bar_id ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS path FROM bars),
x AS (SELECT symbol, bar_id, side, close AS entry_px, len(path) AS n, path[len(path)].c AS last_c, unnest(range(1, len(path) + 1)) AS k,
 unnest(path) AS b FROM p WHERE len(path) > 0)"""


@query(f"""WITH {PATHS}, o AS (SELECT x.*, kind, CASE WHEN kind = 'S' THEN entry_px + side * 5 ELSE entry_px - side * 5 END AS px FROM x CROSS JOIN (SELECT
 unnest(['L', 'S', 'M']) AS kind) WHERE k <= 4),
h AS (SELECT *, CASE kind WHEN 'M' THEN true WHEN 'L' THEN CASE WHEN side > 0 THEN b.l <= px ELSE b.h >= px END ELSE CASE WHEN side > 0 THEN b.h >= px
 ELSE b.l <= px END END AS ok FROM o),
f AS (SELECT symbol, bar_id, kind, any_value(side) AS side, any_value(px) AS px, min(k) FILTER (WHERE ok) AS k, arg_min(b.o,
 k) FILTER (WHERE ok) AS op FROM h GROUP BY 1, 2, 3)
SELECT symbol, bar_id, kind, CAST(k AS INT) AS fill_k, round(CASE WHEN k IS NOT NULL THEN CASE kind WHEN 'L' THEN px WHEN 'M' THEN op + side * 0.25
 ELSE CASE WHEN side > 0 THEN greatest(op, px) ELSE least(op, px) END + side * 0.25 END END, 6) AS fill_px FROM f""")
def orders_with_ttl(spark, sf):
    """Limit, stop and market orders that live four bars."""
    e = entries(spark, sf).where(F.size("path") > 0)
    px = F.col("entry_px") + F.when(F.col("kind") == "S", 5.0).otherwise(-5.0) * F.col("side")
    o = e.withColumn("kind", F.explode(F.array(*map(F.lit, "LSM")))).withColumn("px", px)
    return X.fill_within(o, 4, 0.25).select("symbol", "bar_id", "kind", "fill_k", r("fill_px").alias("fill_px"))


@query(f"""WITH {PATHS}, a AS (SELECT symbol, bar_id, min(k) FILTER (WHERE CASE WHEN side > 0 THEN b.h - entry_px ELSE entry_px - b.l END >= 10) AS a FROM x
 GROUP BY 1, 2),
l AS (SELECT x.*, a, CASE WHEN k > a THEN entry_px ELSE entry_px - side * 15 END AS stop FROM x JOIN a USING (symbol, bar_id)), h AS (SELECT *,
 CASE WHEN side > 0 THEN b.l <= stop ELSE b.h >= stop END AS s, CASE WHEN side > 0 THEN b.h - entry_px ELSE entry_px - b.l END >= 30 AS t FROM l),
f AS (SELECT symbol, bar_id, any_value(side) AS side, any_value(entry_px) AS e, any_value(n) AS n, any_value(last_c) AS last_c, any_value(a) AS a,
 min(k) FILTER (WHERE s OR t) AS k, arg_min(CASE WHEN s THEN 'stop' ELSE 'target' END, k) FILTER (WHERE s OR t) AS why,
 arg_min(CASE WHEN s THEN stop ELSE entry_px + side * 30 END, k) FILTER (WHERE s OR t) AS px FROM h GROUP BY 1, 2)
SELECT symbol, bar_id, coalesce(a < coalesce(k, n), false) AS moved, CAST(coalesce(k, n) AS INT) AS bars_held, coalesce(why,
 'timeout') AS exit_reason, CASE WHEN coalesce(px, last_c) = e THEN 0 ELSE round(side * (coalesce(px, last_c) - e), 6) END AS pnl FROM f""")
def break_even_stop(spark, sf):
    t = X.break_even(entries(spark, sf).where(F.size("path") > 0), 15.0, 30.0, 10.0)
    return t.select("symbol", "bar_id", "moved", "bars_held", "exit_reason", F.when(F.col("pnl") == 0, 0.0).otherwise(r("pnl")).alias("pnl"))


@query(f"""WITH {TAPE}, d AS (SELECT *, CAST(ts AS DATE) AS day, epoch_us(ts) AS us FROM tape), p AS (SELECT *, CASE WHEN px < lag(px) OVER (PARTITION BY symbol,
 day ORDER BY ts, id) THEN -1 ELSE 1 END AS side,
 list(struct_pack(us := us, px := px)) OVER (PARTITION BY symbol, day ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS path FROM d),
x AS (SELECT symbol, id, side, us, len(path) AS n, path[len(path)].px AS last_px, unnest(range(1, len(path) + 1)) AS k,
 unnest(path) AS b FROM p WHERE len(path) > 0), e AS (SELECT symbol, id, min(k) AS k0, arg_min(b.px, k) AS p0, arg_min(b.us,
 k) AS u0 FROM x WHERE b.us >= us + 60000000 GROUP BY 1, 2),
t AS (SELECT x.*, k0, p0 + side * 0.25 AS entry_px, u0 FROM x JOIN e USING (symbol, id) WHERE k0 < n), g AS (SELECT *,
 side * (b.px - side * 0.25 - entry_px) AS gain FROM t WHERE k > k0),
w AS (SELECT *, CASE WHEN gain <= -10 THEN 'stop' WHEN gain >= 20 AND b.us >= u0 + 600000000 THEN 'target' END AS why FROM g)
SELECT id, any_value(side) AS side, round(any_value(entry_px), 6) AS entry_px, coalesce(arg_min(why, k) FILTER (WHERE why IS NOT NULL),
 'timeout') AS exit_reason, round(coalesce(arg_min(gain, k) FILTER (WHERE why IS NOT NULL), arg_max(gain, k)), 6) AS pnl FROM w GROUP BY id""")
def tick_trades(spark, sf):
    """Every tick as a signal: entered a minute later at the quote, left on the other side of it, the target after ten minutes at the earliest."""
    t = X.tick_paths(B.quote_sign(tape(spark, sf).withColumn("day", B.day()), ("symbol", "day")).withColumnRenamed("sign", "side"), 20)
    return X.tick_trades(t, 60_000_000, 0.5, 10.0, 20.0, 600_000_000).select("id", "side", r("entry_px").alias("entry_px"), "exit_reason",
        r("pnl").alias("pnl"))


@query(f"""WITH {PATHS}, o AS (SELECT *, entry_px - side * 5 AS px FROM x), a AS (SELECT symbol, bar_id,
 min(k) FILTER (WHERE CASE WHEN side > 0 THEN b.h >= px + 8 ELSE b.l <= px - 8 END) AS armed_k FROM o GROUP BY 1, 2)
SELECT symbol, bar_id, CAST(any_value(armed_k) AS INT) AS armed_k, CAST(min(k) FILTER (WHERE k > armed_k AND CASE WHEN side > 0 THEN b.l <= px ELSE
 b.h >= px END) AS INT) AS fill_k FROM o JOIN a USING (symbol, bar_id) GROUP BY 1, 2""")
def armed_limits(spark, sf):
    return X.armed_limit(ordered(spark, sf, 5.0), 8.0).select("symbol", "bar_id", "armed_k", "fill_k")


@query(f"""WITH {PATHS}, o AS (SELECT *, entry_px - side * 5 AS px FROM x), d AS (SELECT *, CASE WHEN side > 0 THEN px - b.l ELSE b.h - px END AS depth,
 {DRAW.format("'fill|' || symbol || '-' || bar_id || '|' || k")} AS u FROM o),
f AS (SELECT *, u < CASE WHEN depth >= 10 THEN 1.0 WHEN depth >= 3 THEN 0.5 WHEN depth >= 0 THEN 0.2 ELSE 0.0 END AS ok FROM d) SELECT symbol, bar_id,
 CAST(min(k) FILTER (WHERE ok) AS INT) AS fill_k FROM f GROUP BY 1, 2""")
def chance_fills(spark, sf):
    o = ordered(spark, sf, 5.0).withColumn("oid", F.concat_ws("-", "symbol", F.col("bar_id").cast("string")))
    return X.chance_fill(o, "oid", [(0.0, 0.2), (3.0, 0.5), (10.0, 1.0)]).select("symbol", "bar_id", "fill_k")


@query(f"""WITH {PATHS}, o AS (SELECT *, entry_px - side * 5 AS px FROM x), f AS (SELECT symbol, bar_id, any_value(side) AS side, any_value(entry_px) AS e,
 any_value(px) AS px, any_value(last_c) AS c, min(k) FILTER (WHERE CASE WHEN side > 0 THEN b.l < px ELSE b.h > px END) AS through,
 min(k) FILTER (WHERE CASE WHEN side > 0 THEN b.l <= px ELSE b.h >= px END) AS touch FROM o GROUP BY 1, 2)
SELECT symbol, count(*) AS n, count(touch) AS touched, count(through) AS passive_n, round(avg(CASE WHEN through IS NOT NULL THEN side * (c - px) END),
 6) AS passive_mean, round(avg(side * (c - e) - 0.5), 6) AS crossing_mean, round(avg(CASE WHEN through IS NOT NULL THEN side * (c - e) - 0.5 END),
 6) AS crossing_where_filled FROM f GROUP BY 1""")
def passive_or_crossing(spark, sf):
    """A resting limit that needs a trade through it, beside paying the spread at once, on the same entries."""
    o = ordered(spark, sf, 5.0)
    s, px = F.col("side"), F.col("px")
    hit = lambda strict: X.first_of("path", lambda b, i: F.when(s > 0,
        b["low"] < px if strict else b["low"] <= px).otherwise(b["high"] > px if strict else b["high"] >= px))
    o = o.withColumns({"through": hit(True), "touch": hit(False), "c": F.element_at("path", -1)["close"]})
    filled, paid = F.col("through").isNotNull(), s * (F.col("c") - F.col("entry_px")) - 0.5
    return o.groupBy("symbol").agg(F.count("*").alias("n"), F.count("touch").alias("touched"), F.count("through").alias("passive_n"),
        r(F.avg(F.when(filled, s * (F.col("c") - px)))).alias("passive_mean"), r(F.avg(paid)).alias("crossing_mean"),
        r(F.avg(F.when(filled, paid))).alias("crossing_where_filled"))


@query(f"""WITH {ENTRY}, w AS (SELECT symbol, CAST(yearweek(ts) AS INT) AS week, side, side * (pnl + 0.5) AS move, pnl FROM trades), m AS (SELECT symbol, week,
 avg(move) AS drift FROM w GROUP BY 1, 2)
SELECT symbol, week, side, count(*) AS n, round(avg(pnl), 6) AS mean_pnl, round(avg(side * (move - drift) - 0.5),
 6) AS without_drift FROM w JOIN m USING (symbol, week) GROUP BY 1, 2, 3""")
def drift_removed(spark, sf):
    """Outcomes less the mean move of the same symbol and week, net of the cost."""
    t = trades(spark, sf).withColumn("week", (F.extract(F.lit("YEAROFWEEK"),
        F.col("ts")) * 100 + F.weekofyear("ts")).cast("int")).withColumn("move", F.col("side") * (F.col("pnl") + 0.5))
    drift = F.avg("move").over(Window.partitionBy("symbol", "week"))
    t = t.withColumn("net", F.col("side") * (F.col("move") - drift) - 0.5)
    return t.groupBy("symbol", "week", "side").agg(F.count("*").alias("n"), r(F.avg("pnl")).alias("mean_pnl"),
        r(F.avg("net")).alias("without_drift"))


@query(f"""WITH RECURSIVE {BARS}, w AS (SELECT symbol, CAST(ts AS DATE) AS day, bar_id, (close - open) / 20 AS wanted, row_number() OVER (PARTITION BY symbol,
 CAST(ts AS DATE) ORDER BY bar_id) AS i FROM bars),
f AS (SELECT symbol, day, bar_id, i, CASE WHEN abs(wanted) > 0.5 THEN wanted ELSE 0 END AS p FROM w WHERE i = 1 UNION ALL SELECT w.symbol, w.day,
 w.bar_id, w.i, CASE WHEN abs(w.wanted - f.p) > 0.5 THEN w.wanted ELSE f.p END FROM f JOIN w ON w.symbol = f.symbol AND w.day = f.day AND w.i = f.i +
 1) SELECT symbol, bar_id, round(p, 6) AS position FROM f""")
def dead_band(spark, sf):
    b = hourly(spark, sf).select("symbol", F.to_date("ts").alias("day"), "bar_id", ((F.col("close") - F.col("open")) / 20).alias("wanted"))
    return X.dead_band(b, ["symbol", "day"], "bar_id", "wanted", 0.5).select("symbol", "bar_id", r("position").alias("position"))


@query()
def ratchet_stop(spark, sf):
    """A stop behind the extreme by the mean range at the entry, moved a tick at least."""
    b = J.forward_path(hourly(spark, sf).withColumn("atr", F.avg(F.col("high") - F.col("low")).over(W.last_n(14))),
        10).where(F.size("path") > 0)
    e = b.select("symbol", "bar_id", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1).alias("side"),
        F.col("close").alias("entry_px"), "atr", "path")
    return X.ratchet(e, "atr", 0.5, 0.25).select("symbol", "bar_id", r("exit_px").alias("exit_px"), "bars_held", "stopped")


# ---- validation and reports


@query(f"""WITH {ENTRY}, wk AS (SELECT symbol, date_trunc('day', ts) AS week, sum(pnl) AS p FROM trades GROUP BY 1, 2), n AS (SELECT symbol, p,
 row_number() OVER (PARTITION BY symbol ORDER BY week) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM wk),
s AS (SELECT symbol, any_value(n) AS n, unnest(range(1, 31)) AS trial FROM n GROUP BY symbol), z AS (SELECT *, unnest(range(1, 53)) AS step FROM s),
 y AS (SELECT *, CAST(floor({DRAW.format("'weeks|' || trial || '|' || step")} * n) + 1 AS BIGINT) AS i FROM z),
v AS (SELECT y.symbol, trial, step, p FROM y JOIN n ON n.symbol = y.symbol AND n.i = y.i), q AS (SELECT *,
 sum(p) OVER w AS e FROM v WINDOW w AS (PARTITION BY symbol, trial ORDER BY step)), k AS (SELECT *, e - max(e) OVER (PARTITION BY symbol,
 trial ORDER BY step) AS d FROM q), t AS (SELECT symbol, trial, sum(p) AS yr, min(d) AS dd FROM k GROUP BY 1, 2)
SELECT symbol, round(quantile_cont(yr, 0.05), 4) AS year_p05, round(quantile_cont(yr, 0.5), 4) AS year_p50, round(quantile_cont(dd, 0.05),
 4) AS dd_p05 FROM t GROUP BY 1""")
def period_bootstrap(spark, sf):
    """The tape holds a month, so its days stand for weeks."""
    d = trades(spark, sf).groupBy("symbol", F.to_date("ts").alias("week")).agg(F.sum("pnl").alias("p"))
    return V.week_bootstrap(d, "symbol", "week", "p", 30)


@query(f"""WITH {ENTRY}, dy AS (SELECT symbol, CAST(ts AS DATE) AS day, sum(pnl) AS p FROM trades GROUP BY 1, 2), a AS (SELECT symbol, p,
 row_number() OVER (PARTITION BY symbol ORDER BY day) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM dy),
s AS (SELECT symbol, any_value(n) AS n, unnest(range(1, 41)) AS trial FROM a GROUP BY symbol), st AS (SELECT *,
 CAST(floor({DRAW.format("'account|' || trial")} * n) + 1 AS BIGINT) AS start FROM s),
q AS (SELECT st.symbol, trial, a.i - start + 1 AS k, sum(p) OVER (PARTITION BY st.symbol,
 trial ORDER BY a.i) AS e FROM st JOIN a ON a.symbol = st.symbol AND a.i >= start), t AS (SELECT *, greatest(0, max(e) OVER (PARTITION BY symbol,
 trial ORDER BY k)) AS top FROM q),
oc AS (SELECT symbol, trial, max(k) AS n, arg_min(CASE WHEN e >= 150 THEN 'passed' ELSE 'bust' END,
 k) FILTER (WHERE e >= 150 OR e <= top - 120) AS out, min(k) FILTER (WHERE e >= 150 OR e <= top - 120) AS kk FROM t GROUP BY 1, 2)
SELECT symbol, coalesce(out, 'open') AS outcome, count(*) AS n, round(avg(coalesce(kk, oc.n)), 6) AS mean_days FROM oc GROUP BY 1, 2""")
def account_runs(spark, sf):
    d = trades(spark, sf).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("p"))
    return V.account_runs(d, "symbol", "day", "p", 40, 150.0, 120.0)


@query(f"""WITH {ENTRY}, s AS (SELECT symbol || CASE WHEN side > 0 THEN 'L' ELSE 'S' END AS key, pnl,
 10 * bar_id <= 7 * max(bar_id) OVER (PARTITION BY symbol) AS tr FROM trades),
g AS (SELECT key, count(*) FILTER (WHERE tr) AS n_train, count(*) FILTER (WHERE NOT tr) AS n_hold,
 avg(pnl) FILTER (WHERE tr) * sqrt(count(*) FILTER (WHERE tr)) / nullif(greatest(stddev_samp(pnl) FILTER (WHERE tr), 1e-9), 1e-9) AS a,
 avg(pnl) FILTER (WHERE NOT tr) * sqrt(count(*) FILTER (WHERE NOT tr)) / nullif(greatest(stddev_samp(pnl) FILTER (WHERE NOT tr), 1e-9),
 1e-9) AS b FROM s GROUP BY 1)
SELECT key, n_train, n_hold, round(a, 6) AS t_train, round(b, 6) AS t_hold, CASE WHEN least(n_train,
 n_hold) < 20 THEN 'thin' WHEN abs(a) >= 2 AND sign(a) = sign(b) THEN 'holds' WHEN abs(a) >= 2 THEN 'reverses' ELSE 'none' END AS verdict FROM g""")
def behaviour_verdicts(spark, sf):
    t = trades(spark, sf)
    s = t.select(F.concat("symbol", F.when(F.col("side") > 0, "L").otherwise("S")).alias("key"), "pnl",
        (10 * F.col("bar_id") <= 7 * F.max("bar_id").over(Window.partitionBy("symbol"))).alias("train"))
    return V.verdicts(s, "key", "pnl", "train", 20)


@query(f"""WITH {ENTRY}, s AS (SELECT symbol, CAST(ts AS DATE) AS d, sum(pnl) AS v FROM trades GROUP BY 1, 2), t AS (SELECT d, sum(v) AS t FROM s GROUP BY 1),
 ee AS (SELECT n.symbol, t.d, t.t, t.t - coalesce(s.v, 0) AS w FROM (SELECT DISTINCT symbol FROM s) n CROSS JOIN t LEFT JOIN s ON s.symbol = n.symbol
 AND s.d = t.d)
SELECT symbol, round(avg(t) / stddev_samp(t), 6) AS book, round(avg(w) / stddev_samp(w), 6) AS without,
 round(avg(t) / stddev_samp(t) - avg(w) / stddev_samp(w), 6) AS contribution FROM ee GROUP BY 1""")
def contributions(spark, sf):
    return V.contributions(trades(spark, sf).withColumn("d", F.to_date("ts")), "symbol", "d", "pnl")


@query(f"""WITH {ENTRY}, z AS (SELECT symbol, bar_id, pnl, ceil(max(bar_id) OVER (PARTITION BY symbol) / 5.0) AS sz FROM trades), f AS (SELECT *, unnest(range(1,
 5)) AS fold FROM z)
SELECT symbol, CAST(fold AS INT) AS fold, count(*) FILTER (WHERE bar_id <= fold * sz - 10) AS n_train,
 count(*) FILTER (WHERE floor((bar_id - 1) / sz) = fold) AS n_test, round(avg(pnl) FILTER (WHERE bar_id <= fold * sz - 10), 6) AS train_mean,
 round(avg(pnl) FILTER (WHERE floor((bar_id - 1) / sz) = fold), 6) AS test_mean FROM f GROUP BY 1, 2""")
def expanding_cv(spark, sf):
    return V.expanding_cv(trades(spark, sf), "symbol", "bar_id", "pnl", 4, 10)


@query(f"""WITH {ENTRY}, a AS (SELECT symbol, bar_id, round(pnl - 0.25 * (bar_id % 3), 6) AS actual FROM trades WHERE bars_held > 1),
 j AS (SELECT coalesce(t.symbol, a.symbol) AS symbol, t.pnl, a.actual FROM trades t FULL JOIN a ON a.symbol = t.symbol AND a.bar_id = t.bar_id)
SELECT symbol, count(pnl) AS replayed, count(actual) AS filled, round(sum(pnl), 4) AS replay_pnl, round(sum(actual), 4) AS actual_pnl,
 round(avg(actual - pnl), 6) AS mean_slip FROM j GROUP BY 1""")
def replay_against_actual(spark, sf):
    """Replayed trades beside the fills an account had, some of them missing."""
    t = trades(spark, sf).select("symbol", "bar_id", "pnl", "bars_held")
    a = t.where("bars_held > 1").select("symbol", "bar_id", F.round(F.col("pnl") - 0.25 * (F.col("bar_id") % 3), 6).alias("actual"))
    j = t.join(a, ["symbol", "bar_id"], "full")
    return j.groupBy("symbol").agg(F.count("pnl").alias("replayed"), F.count("actual").alias("filled"),
        r(F.sum("pnl"), 4).alias("replay_pnl"), r(F.sum("actual"), 4).alias("actual_pnl"),
        r(F.avg(F.col("actual") - F.col("pnl"))).alias("mean_slip"))


# ---- searches


@query(f"""WITH {PATHS}, g AS (SELECT unnest(range(1, 13)) AS cfg), c AS (SELECT cfg, round(5 + 20 * {DRAW.format("'hunt|stop|' || cfg")}, 4) AS stop,
 round(5 + 40 * {DRAW.format("'hunt|target|' || cfg")}, 4) AS target FROM g),
h AS (SELECT x.*, cfg, stop, target, CASE WHEN side > 0 THEN b.l <= entry_px - stop ELSE b.h >= entry_px + stop END AS s,
 CASE WHEN side > 0 THEN b.h >= entry_px + target ELSE b.l <= entry_px - target END AS t FROM x CROSS JOIN c),
o AS (SELECT symbol, bar_id, cfg, any_value(stop) AS stop, any_value(target) AS target, any_value(side) AS side, any_value(entry_px) AS e,
 any_value(last_c) AS c, arg_min(CASE WHEN s THEN 's' ELSE 't' END, k) FILTER (WHERE s OR t) AS why FROM h GROUP BY 1, 2, 3)
SELECT cfg, round(any_value(stop), 4) AS stop, round(any_value(target), 4) AS target, count(*) AS n,
 round(avg(CASE WHEN why = 's' THEN -stop WHEN why = 't' THEN target ELSE side * (c - e) END), 6) AS mean_pnl FROM o GROUP BY 1""")
def random_exits(spark, sf):
    """Exits drawn at random within bounds, every one on every entry."""
    g = O.random_points({"stop": (5.0, 25.0), "target": (5.0, 45.0)}, 12, "hunt")
    from ..operators.simulate import first_touch

    e = entries(spark, sf).withColumn("g", F.explode(g))
    t = first_touch(e.select("symbol", "bar_id", "side", "entry_px", "path",
        (F.col("entry_px") - F.col("side") * F.col("g.stop")).alias("stop"),
        (F.col("entry_px") + F.col("side") * F.col("g.target")).alias("target"), "g"))
    return t.groupBy(F.col("g.cfg").alias("cfg"), F.col("g.stop").alias("stop"),
        F.col("g.target").alias("target")).agg(F.count("*").alias("n"), r(F.avg("pnl")).alias("mean_pnl"))


@query()
def genetic_exits(spark, sf):
    """Stop and target bred over generations; each generation's fitness is one pass over the entries."""
    from ..operators.search import evolve, exit_fitness

    e = entries(spark, sf).where(F.size("path") > 0)
    return evolve(spark, {"stop": (5.0, 25.0), "target": (5.0, 45.0)}, lambda people: exit_fitness(e, people), 8, 3)


@query()
def leaf_rules(spark, sf):
    """Rules of a decision tree's leaves over bar features, with each leaf's rows and mean forward move."""
    from ..operators.search import leaf_rules as rules

    b = hourly(spark, sf)
    w = W.by_symbol()
    f = b.select("symbol", "bar_id", r(W.zscore("close", 20)).alias("z"),
        r(F.col("volume") / F.nullif(W.sma("volume", 20), F.lit(0.0))).alias("vr"),
        (F.lead("close", 4).over(w) - F.col("close")).alias("fwd")).dropna()
    return rules(f, ["z", "vr"], "fwd", 3, 20)


@query(f"""WITH {TAPE} SELECT id, count(*) OVER a AS n_fast, count(*) OVER b AS n_slow, round((count(*) OVER a / 600.0) / (count(*) OVER b / 3600.0),
 6) AS speed FROM tape WINDOW a AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 600 SECOND PRECEDING AND CURRENT ROW),
 b AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW)""")
def tape_speed(spark, sf):
    """The tick rate of ten minutes over that of an hour."""
    t = W.trailing_time(tape(spark, sf), ["symbol"], "ts", 600, 86_400, lambda w: {"n_fast": F.count("*").over(w)})
    t = W.trailing_time(t, ["symbol"], "ts", 3600, 86_400, lambda w: {"n_slow": F.count("*").over(w)})
    return t.select("id", "n_fast", "n_slow", r((F.col("n_fast") / 600) / (F.col("n_slow") / 3600)).alias("speed"))


@query(f"""WITH {BARS}, f AS (SELECT *, CASE WHEN count(*) OVER c = 7 AND lag(high, 3) OVER o = max(high) OVER c THEN lag(high, 3) OVER o END AS sh,
 CASE WHEN count(*) OVER c = 7 AND lag(low, 3) OVER o = min(low) OVER c THEN lag(low, 3) OVER o END AS sl FROM bars
 WINDOW o AS (PARTITION BY symbol ORDER BY ts), c AS (PARTITION BY symbol ORDER BY ts ROWS 6 PRECEDING)),
j AS (SELECT b.symbol, b.bar_id, p.bar_id AS pos, CASE WHEN b.close >= b.open THEN p.sh ELSE p.sl END AS level FROM bars b JOIN f p ON p.symbol =
 b.symbol AND p.bar_id BETWEEN b.bar_id - 150 AND b.bar_id AND CASE WHEN b.close >= b.open THEN p.sh > b.close ELSE p.sl < b.close END),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, bar_id ORDER BY pos DESC) AS n FROM j) SELECT symbol, bar_id,
 max(level) FILTER (WHERE n = 1) AS first_level, max(level) FILTER (WHERE n = 2) AS second_level,
 max(level) FILTER (WHERE n = 3) AS third_level FROM bars LEFT JOIN (SELECT * FROM k WHERE n <= 3) USING (symbol, bar_id) GROUP BY 1, 2""")
def facing_pivots(spark, sf):
    p = O.facing_pivots(hourly(spark, sf), 3, 150, 3)
    return p.select("symbol", "bar_id", *(F.get("pivots", k).alias(f"{n}_level") for k, n in enumerate(("first", "second", "third"))))


@query(f"""WITH {BARS}, l AS (SELECT symbol, bar_id, ts, lead(close, 4) OVER o - close AS fwd, CAST(sign(close - open) AS INT) + 1 AS a,
 lag(CAST(sign(close - open) AS INT) + 1, 2) OVER o AS b, lag(CAST(sign(close - open) AS INT) + 1,
 5) OVER o AS c FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts))
SELECT CAST(a + 3 * b + 9 * c AS INT) AS code, count(*) AS n, round(avg(fwd), 6) AS mean_fwd FROM l WHERE c IS NOT NULL AND fwd IS NOT NULL GROUP BY 1""")
def skip_grams(spark, sf):
    """Directions of a bar, of two and of five bars before, with gaps between them."""
    w = W.by_symbol()
    b = hourly(spark, sf).withColumn("a", F.signum(F.col("close") - F.col("open")).cast("int") + 1)
    l = b.select((F.lead("close", 4).over(w) - F.col("close")).alias("fwd"),
        (F.col("a") + 3 * F.lag("a", 2).over(w) + 9 * F.lag("a", 5).over(w)).alias("code")).dropna()
    return l.groupBy("code").agg(F.count("*").alias("n"), r(F.avg("fwd")).alias("mean_fwd"))


@query(f"""WITH RECURSIVE {BARS}, d AS (SELECT *, coalesce(greatest(close - lag(close) OVER o, 0), 0) AS gain, coalesce(greatest(lag(close) OVER o - close, 0),
 0) AS loss FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
e AS (SELECT symbol, bar_id, gain AS g, loss AS l, close AS a, close AS b, close AS c, (open + close) / 2 AS ho,
 (open + high + low + close) / 4 AS hc FROM d WHERE bar_id = 1 UNION ALL SELECT d.symbol, d.bar_id, e.g + (d.gain - e.g) / 14.0,
 e.l + (d.loss - e.l) / 14.0,
 e.a + (d.close - e.a) * 2 / 10.0, e.b + (e.a + (d.close - e.a) * 2 / 10.0 - e.b) * 2 / 10.0,
 e.c + (e.b + (e.a + (d.close - e.a) * 2 / 10.0 - e.b) * 2 / 10.0 - e.c) * 2 / 10.0, (e.ho + e.hc) / 2,
 (d.open + d.high + d.low + d.close) / 4 FROM e JOIN d ON d.symbol = e.symbol AND d.bar_id = e.bar_id + 1),
r AS (SELECT *, CASE WHEN g + l > 0 THEN 100 * g / (g + l) ELSE 50 END AS rsi, lag(c) OVER (PARTITION BY symbol ORDER BY bar_id) AS pc FROM e)
SELECT symbol, bar_id, CASE WHEN count(*) OVER w = 14 AND round(max(rsi) OVER w - min(rsi) OVER w,
 9) > 0 THEN round((rsi - min(rsi) OVER w) / (max(rsi) OVER w - min(rsi) OVER w), 4) END AS stoch_rsi, round((c - pc) / pc, 6) AS trix, round(ho,
 4) AS ha_open, round(hc, 4) AS ha_close FROM r WINDOW w AS (PARTITION BY symbol ORDER BY bar_id ROWS 13 PRECEDING)""")
def recursive_oscillators(spark, sf):
    """Stochastic RSI, TRIX and Heikin-Ashi bars, all from recursive averages."""
    b = W.rsi(hourly(spark, sf), 14, {"e1": ("close", 0.2)})
    b = W.ewm(W.ewm(b, {"e2": ("e1", 0.2)}), {"e3": ("e2", 0.2)})
    w, frame = W.by_symbol(), W.last_n(14)
    lo, hi = F.min("rsi").over(frame), F.max("rsi").over(frame)
    b = b.withColumns({"hc": (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4, "p": F.lag("e3").over(w)})
    # an open is half of the last open and half of the last close: a recursive average of closes, begun with the first bar's middle
    b = W.ewm(b.withColumn("x", F.coalesce(F.lag("hc").over(w), (F.col("open") + F.col("close")) / 2)), {"ho": ("x", 0.5)})
    stoch = F.when((F.count("*").over(frame) == 14) & (F.round(hi - lo, 9) > 0), (F.col("rsi") - lo) / (hi - lo))
    return b.select("symbol", "bar_id", r(stoch, 4).alias("stoch_rsi"), r((F.col("e3") - F.col("p")) / F.col("p")).alias("trix"),
        r("ho", 4).alias("ha_open"), r("hc", 4).alias("ha_close"))


@query(f"""WITH {ENTRY}, dy AS (SELECT symbol, CAST(ts AS DATE) AS day, sum(pnl) AS p FROM trades GROUP BY 1, 2), wk AS (SELECT symbol, date_trunc('week',
 day) AS w, sum(p) AS p FROM dy GROUP BY 1, 2), mo AS (SELECT symbol, min(p) AS worst_month FROM (SELECT symbol, date_trunc('month', day) AS m,
 sum(p) AS p FROM dy GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT symbol, day, p, sum(p) OVER w AS e, row_number() OVER w AS i FROM dy WINDOW w AS (PARTITION BY symbol ORDER BY day)), k AS (SELECT *,
 e - greatest(0, max(e) OVER (PARTITION BY symbol ORDER BY day)) AS dd, sum(p) OVER (PARTITION BY symbol ORDER BY day ROWS 4 PRECEDING) AS roll,
 count(*) OVER (PARTITION BY symbol ORDER BY day ROWS 4 PRECEDING) AS rn FROM q),
d AS (SELECT symbol, sqrt(avg(dd * dd)) AS ulcer, min(dd) AS mdd, max(e) AS top, arg_max(e, day) AS total, regr_r2(e, i) AS r2,
 min(roll) FILTER (WHERE rn = 5) AS worst5, avg(CAST(p > 0 AS DOUBLE)) AS up_days,
 avg(CASE WHEN p > 0 THEN p END) / nullif(-avg(CASE WHEN p < 0 THEN p END), 0) AS payoff, skewness(p) AS skew FROM k GROUP BY 1),
w AS (SELECT symbol, quantile_cont(p, 0.5) AS median_week, max(p) AS best_week, stddev_samp(p) AS sd_week FROM wk GROUP BY 1)
SELECT symbol, round(ulcer, 4) AS ulcer, round(mdd, 4) AS max_drawdown, round(total, 4) AS total, round(total / nullif(-mdd, 0), 6) AS recovery,
 round(total / nullif(ulcer, 0), 6) AS ulcer_ratio, round(r2, 6) AS r2, round(worst5, 4) AS worst_five_days, round(up_days, 6) AS up_days,
 round(payoff, 6) AS payoff, round(worst_month, 4) AS worst_month, round(median_week, 4) AS median_week, round(best_week, 4) AS best_week,
 round(sd_week, 4) AS sd_week FROM d JOIN w USING (symbol) JOIN mo USING (symbol)""")
def risk_metrics(spark, sf):
    """Ulcer index, drawdown, recovery, straightness of the equity line, worst stretches, payoff and weekly spread."""
    return O.risk_metrics(trades(spark, sf).withColumn("day", F.to_date("ts")), "symbol", "day", "pnl")


@query(f"""WITH {TAPE}, c AS (SELECT DISTINCT id, symbol, ts, px FROM tape) SELECT id, symbol, px FROM c""")
def stream_deduplicated(spark, sf):
    """A stream read twice over gives each id once."""
    from ..streaming import engine
    from .streams import folder

    twice = engine.tick_stream(spark, sf)
    return engine.run_to_end(engine.deduplicated(twice.unionByName(engine.tick_stream(spark, sf)), "40 days"), folder(spark)).select("id",
        "symbol", "px")
