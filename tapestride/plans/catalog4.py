"""Named queries, continued: oscillators, bias, reports, controls and searches."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import more as O
from ..operators import simulate as X
from ..sources.tape import table
from .catalog import BARS, CONDS, hourly, masks, query, r
from .catalog2 import ENTRY, entries, trades


@query(f"""WITH {BARS}, s AS (SELECT *, greatest(high - lag(high) OVER o, 0) AS u, greatest(lag(low) OVER o - low, 0) AS d,
 close - lag(close) OVER o AS st FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
f AS (SELECT symbol, bar_id, count(st) OVER w AS n, arg_max(bar_id, (high, bar_id)) OVER w AS hi, arg_max(bar_id, (-low, bar_id)) OVER w AS lo,
 sum(u) OVER w AS u, sum(d) OVER w AS d, sum(greatest(st, 0)) OVER w AS g, sum(greatest(-st, 0)) OVER w AS l,
 sum(CAST(st > 0 AS DOUBLE)) OVER w / 14 AS p FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING))
SELECT symbol, bar_id, CASE WHEN n = 14 THEN round(100.0 * (14 - (bar_id - hi)) / 14, 6) END AS aroon_up,
 CASE WHEN n = 14 THEN round(100.0 * (14 - (bar_id - lo)) / 14, 6) END AS aroon_down, CASE WHEN n = 14 AND u + d > 0 THEN round(u / (u + d),
 6) END AS demarker, CASE WHEN n = 14 AND g + l > 0 THEN round(100 * (g - l) / (g + l), 6) END AS cmo,
 CASE WHEN n = 14 THEN round((CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END) + (CASE WHEN p < 1 THEN -(1 - p) * log2(1 - p) ELSE 0 END),
 6) END AS entropy FROM f""")
def oscillators(spark, sf):
    return O.oscillators(hourly(spark, sf), 14).select("symbol", "bar_id",
        *(r(c).alias(c) for c in ("aroon_up", "aroon_down", "demarker", "cmo", "entropy")))


@query(f"""WITH {BARS}, e AS (SELECT symbol, CAST(ts AS DATE) AS day, max(bar_id) AS eod_id FROM bars GROUP BY 1, 2) SELECT b.symbol, b.bar_id,
 e.eod_id FROM bars b JOIN e ON e.symbol = b.symbol AND e.day = CAST(b.ts AS DATE)""")
def next_end_of_day(spark, sf):
    return O.next_end_of_day(hourly(spark, sf)).select("symbol", "bar_id", "eod_id")


@query(f"""WITH {ENTRY}, m AS (SELECT symbol, bar_id, CASE WHEN any_value(side) > 0 THEN max(b.h) - any_value(entry_px) ELSE any_value(entry_px) - min(b.l) END
 AS mfe FROM x GROUP BY 1, 2)
SELECT symbol, bar_id, CASE WHEN count(mfe) OVER w >= 10 THEN round(quantile_cont(mfe, 0.5) OVER w,
 6) END AS target FROM m WINDOW w AS (PARTITION BY symbol ORDER BY bar_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""")
def adaptive_target(spark, sf):
    e = X.excursions(entries(spark, sf).where(F.size("path") > 0))
    return O.adaptive_target(e, "symbol", "bar_id", "mfe", 60, 10).select("symbol", "bar_id", r("target").alias("target"))


@query(f"""WITH {BARS}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_min(open, ts) AS o, arg_max(close, ts) AS c FROM bars GROUP BY 1, 2),
 v AS (SELECT symbol, day, CAST(CASE WHEN count(c) OVER w = 3 THEN sum(sign(c - o)) OVER w END AS INT) AS bias FROM d WINDOW w AS (PARTITION BY symbol
 ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT b.symbol, b.bar_id, v.bias FROM bars b JOIN v ON v.symbol = b.symbol AND v.day = CAST(b.ts AS DATE)""")
def daily_bias(spark, sf):
    return O.daily_bias(hourly(spark, sf)).select("symbol", "bar_id", "bias")


@query(f"""WITH {ENTRY}, dy AS (SELECT symbol, CAST(ts AS DATE) AS day, sum(pnl) AS p FROM trades GROUP BY 1, 2), wk AS (SELECT symbol, date_trunc('week',
 day) AS w, sum(p) AS p FROM dy GROUP BY 1, 2), wd AS (SELECT symbol, round(min(p), 4) AS worst_day FROM dy GROUP BY 1)
SELECT symbol, count(*) AS weeks, round(avg(p) / nullif(stddev_samp(p), 0) * sqrt(52), 6) AS sharpe, round(avg(p) / nullif(sqrt(avg(least(p,
 0) * least(p, 0))), 0) * sqrt(52), 6) AS sortino, round(sum(greatest(p, 0)) / nullif(-sum(least(p, 0)), 0), 6) AS profit_factor, round(min(p),
 4) AS worst_week, round(avg(CAST(p > 0 AS DOUBLE)), 6) AS positive, any_value(worst_day) AS worst_day FROM wk JOIN wd USING (symbol) GROUP BY 1""")
def weekly_metrics(spark, sf):
    return O.weekly_metrics(trades(spark, sf).withColumn("day", F.to_date("ts")), "symbol", "day", "pnl")


@query("""WITH b AS (SELECT p_brand AS family, p_type AS cfg, p_size, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand,
 p_type ORDER BY p_retailprice DESC) AS n FROM part), k AS (SELECT family, cfg, score,
 CAST(row_number() OVER (PARTITION BY family ORDER BY score DESC, family, cfg) AS INT) AS rank FROM b WHERE n = 1) SELECT * FROM k WHERE rank <= 3""")
def leaderboard(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("family"), F.col("p_type").alias("cfg"),
        F.col("p_retailprice").alias("score"))
    return O.leaderboard(p, ["family", "cfg"], "family", "score", 3)


@query(f"""WITH {ENTRY}, n AS (SELECT symbol, max(bar_id) AS n FROM trades GROUP BY 1), ev AS (SELECT symbol, bar_id, pnl FROM trades WHERE side > 0),
 re AS (SELECT symbol, count(*) AS n, avg(pnl) AS m FROM ev GROUP BY 1), dr AS (SELECT ev.symbol, unnest(range(1, 6)) AS d, ev.bar_id,
 n.n FROM ev JOIN n USING (symbol)),
drawn AS (SELECT symbol, CAST(floor(('0x' || substr(md5('control|' || d || '|' || bar_id), 1,
 8))::BIGINT / 4294967296.0 * n) + 1 AS BIGINT) AS bar_id FROM dr), c AS (SELECT symbol, avg(pnl) AS m FROM drawn JOIN trades USING (symbol,
 bar_id) GROUP BY 1) SELECT symbol, re.n, round(re.m, 6) AS real_mean, round(c.m, 6) AS control_mean FROM re JOIN c USING (symbol)""")
def random_control(spark, sf):
    t = trades(spark, sf).select("symbol", "bar_id", "side", "pnl")
    return O.random_control(t.where("side > 0"), t, "symbol", "bar_id", "pnl", 5)


@query(f"""WITH {ENTRY}, s AS (SELECT symbol, count(pnl) AS n, sum(pnl) AS s FROM trades GROUP BY 1) SELECT symbol, round(s / n, 6) AS own_mean,
 round((sum(s) OVER () - s) / (sum(n) OVER () - n), 6) AS others_mean FROM s""")
def leave_one_out(spark, sf):
    return O.leave_one_out(trades(spark, sf), "symbol", "pnl")


@query(f"""WITH {ENTRY}, c AS (SELECT pnl, hour(ts) >= 6 AS a, entry_px > 15 AS b, side > 0 AS c FROM trades) SELECT 'none' AS without,
 count(*) FILTER (WHERE a AND b AND c) AS n, round(avg(pnl) FILTER (WHERE a AND b AND c), 6) AS mean_value FROM c UNION ALL SELECT 'hours',
 count(*) FILTER (WHERE b AND c), round(avg(pnl) FILTER (WHERE b AND c), 6) FROM c
UNION ALL SELECT 'price', count(*) FILTER (WHERE a AND c), round(avg(pnl) FILTER (WHERE a AND c), 6) FROM c UNION ALL SELECT 'long',
 count(*) FILTER (WHERE a AND b), round(avg(pnl) FILTER (WHERE a AND b), 6) FROM c""")
def ablation(spark, sf):
    t = trades(spark, sf).withColumns({"hours": F.hour("ts") >= 6, "price": F.col("entry_px") > 15, "long": F.col("side") > 0})
    return O.ablation(t, ["hours", "price", "long"], "pnl")


@query("""WITH p AS (SELECT unnest(range(1, 65)) AS point), q AS (SELECT point, row_number() OVER (ORDER BY md5('lhs|stop|' || point)) AS a,
 row_number() OVER (ORDER BY md5('lhs|target|' || point)) AS b FROM p) SELECT point, round(4 + 16 * (a - 0.5) / 64, 6) AS stop,
 round(8 + 40 * (b - 0.5) / 64, 6) AS target FROM q""")
def latin_hypercube(spark, sf):
    return O.latin_hypercube(spark, 64, {"stop": (4.0, 20.0), "target": (8.0, 48.0)})


@query("""WITH s AS (SELECT o_orderpriority AS symbol, o_orderstatus AS contract, CAST(min(o_orderdate) AS DATE) AS st,
 CAST(max(o_orderdate) AS DATE) - CASE o_orderstatus WHEN 'F' THEN 400 WHEN 'O' THEN 200 ELSE 900 END AS en FROM orders GROUP BY 1, o_orderstatus),
 q AS (SELECT o_orderpriority AS symbol, year(o_orderdate) AS q, CAST(min(o_orderdate) AS DATE) AS a,
 CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1, 2),
j AS (SELECT symbol, q, contract, CAST(least(en, b) - greatest(st, a) + 1 AS INT) AS days FROM q JOIN s USING (symbol) WHERE st <= b AND en >= a),
 k AS (SELECT *, row_number() OVER (PARTITION BY symbol, q ORDER BY days DESC, contract) AS n FROM j) SELECT symbol, CAST(q AS INT) AS q, contract,
 days FROM k WHERE n = 1""")
def largest_overlap(spark, sf):
    o = table(spark, sf, "orders")
    cut = F.when(F.col("o_orderstatus") == "F", 400).when(F.col("o_orderstatus") == "O", 200).otherwise(900)
    s = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderstatus")).agg(F.to_date(F.min("o_orderdate")).alias("start"),
        F.to_date(F.max("o_orderdate")).alias("last"))
    s = s.select("symbol", F.col("o_orderstatus").alias("contract"), "start", F.date_sub("last", cut).alias("end"))
    q = o.groupBy(F.col("o_orderpriority").alias("symbol"),
        F.year("o_orderdate").alias("q")).agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return O.largest_overlap(s, q)


@query(f"""WITH {CONDS} SELECT x.cond AS a, y.cond AS b, z.cond AS c, count(x.fwd) AS n, round(avg(x.fwd),
 6) AS mean_fwd FROM m x JOIN m y ON x.symbol = y.symbol AND x.bar_id = y.bar_id AND x.cond < y.cond JOIN m z ON x.symbol = z.symbol AND x.bar_id =
 z.bar_id AND y.cond < z.cond GROUP BY 1, 2, 3 HAVING count(x.fwd) >= 30""")
def condition_triples(spark, sf):
    """Triples from a bar's own short list of conditions, counted with partial aggregation."""
    m = masks(spark, sf)
    one = m.select("fwd", "conds", F.posexplode("conds").alias("i", "a"))
    two = one.select("fwd", "conds", "a", F.explode(F.transform("conds", lambda x,
        j: F.when(j > F.col("i"), F.struct(j.alias("j"), x.alias("b"))))).alias("y")).where("y IS NOT NULL")
    three = two.select("fwd", "a", F.col("y.b").alias("b"), F.explode(F.slice("conds", F.col("y.j") + 2, F.size("conds"))).alias("c"))
    return three.groupBy("a", "b", "c").agg(F.count("fwd").alias("n"), r(F.avg("fwd")).alias("mean_fwd")).where("n >= 30")


@query(f"""WITH {BARS}, w AS (SELECT symbol, bar_id, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 5 PRECEDING) AS w FROM bars), z AS (SELECT symbol,
 bar_id, CASE WHEN len(w) = 6 AND list_stddev_pop(w) > 1e-9 THEN list_transform(w, lambda x: (x - list_avg(w)) / list_stddev_pop(w)) END AS z FROM w),
k AS (SELECT * FROM z WHERE z IS NOT NULL), p AS (SELECT x.symbol, x.bar_id AS i, y.bar_id AS j, list_distance(x.z,
 y.z) ** 2 AS d FROM k x JOIN k y ON x.symbol = y.symbol AND y.bar_id - x.bar_id >= 6),
c AS (SELECT symbol, i, j, least(4095, CAST(floor(d / (24 / 4096.0)) AS BIGINT)) AS cell FROM p), h AS (SELECT symbol, cell,
 sum(count(*)) OVER (PARTITION BY symbol ORDER BY cell) AS upto, sum(count(*)) OVER (PARTITION BY symbol) AS total FROM c GROUP BY symbol, cell),
t AS (SELECT symbol, min(cell) AS cut FROM h WHERE upto >= 0.02 * total GROUP BY 1), n AS (SELECT symbol, bar_id, count(*) AS n FROM (SELECT symbol,
 unnest([i, j]) AS bar_id FROM c JOIN t USING (symbol) WHERE cell <= cut) GROUP BY 1, 2), m AS (SELECT symbol, j AS bar_id,
 min(d) AS d FROM p GROUP BY 1, 2)
SELECT symbol, bar_id, round(sqrt(d), 5) AS motif, CASE WHEN z IS NOT NULL THEN coalesce(n, 0) END AS density FROM z LEFT JOIN m USING (symbol,
 bar_id) LEFT JOIN n USING (symbol, bar_id)""")
def motif_distance(spark, sf):
    return O.motif_distance(hourly(spark, sf), 6).select("symbol", "bar_id", r("motif", 5).alias("motif"), "density")


@query("""WITH s AS (SELECT *, event_type IN ('click', 'purchase') AS paper FROM events), j AS (SELECT p.event_id, f.event_id AS fill,
 f.value - p.value AS slip, row_number() OVER (PARTITION BY p.event_id ORDER BY f.event_id) AS n FROM s p JOIN s f ON p.user_id = f.user_id AND
 p.paper AND NOT f.paper AND f.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts + INTERVAL 6 HOUR) SELECT event_id, fill, round(slip,
 6) AS slip FROM j WHERE n = 1""")
def first_fill_near(spark, sf):
    """Of the fills within six hours the first in the list's order, not the nearest."""
    from ..operators.joins import within

    e = table(spark, sf, "events").select(F.col("user_id").alias("symbol"), "event_id", "ts", "value",
        F.col("event_type").isin("click", "purchase").alias("paper"))
    six = F.expr("INTERVAL 6 HOURS")
    p = e.where("paper").select("symbol", F.col("event_id").alias("order"), F.col("value").alias("px"), (F.col("ts") - six).alias("a"),
        (F.col("ts") + six).alias("b"))
    j = within(e.where("NOT paper"), p, ["symbol"], "ts", "a", "b", 43_200)
    return j.groupBy(F.col("order")).agg(F.min_by(F.struct("event_id", (F.col("value") - F.col("px")).alias("slip")),
        "event_id").alias("x")).select(F.col("order").alias("event_id"), F.col("x.event_id").alias("fill"), r("x.slip").alias("slip"))


