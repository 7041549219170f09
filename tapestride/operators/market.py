"""Options, fills, books of trades and parameter searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .stats import correlation


def gamma_exposure(chain: DataFrame, keys: list[str]) -> DataFrame:
    """Signed gamma exposure by keys and strike of (spot, strike, years, vol, call, oi), calls plus and puts minus, with its rank by size."""
    g = S.option_gamma(F.col("spot"), F.col("strike"), F.col("years"), F.col("vol")) * F.col("oi") * F.pow("spot", F.lit(2)) * F.lit(0.01)
    e = chain.groupBy(*keys, "strike").agg(F.sum(F.when(F.col("call"), g).otherwise(-g)).alias("gex"), F.sum("oi").alias("oi"))
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round(F.abs("gex"), 6)), "strike")
    return e.withColumn("rank", F.row_number().over(w))


def parity_spot(chain: DataFrame, keys: list[str]) -> DataFrame:
    """Spot implied by put-call parity at the strike where call and put are closest; of equally close the lowest."""
    c = chain.where("call").groupBy(*keys, "strike").agg(F.avg("price").alias("c"))
    p = chain.where("NOT call").groupBy(*keys, "strike").agg(F.avg("price").alias("p"))
    gap = F.col("c") - F.col("p")
    return c.join(p, [*keys, "strike"]).groupBy(*keys).agg(F.min_by(F.struct("strike", (F.col("strike") + gap).alias("spot")),
        F.struct(F.round(F.abs(gap), 9), "strike")).alias("x")).select(*keys, "x.*")


QUEUE_CELL = 4  #: length of a cell of queue_fills in times to live; a tick is copied to 1 + 1 / QUEUE_CELL cells on average


def queue_fills(orders: DataFrame, ticks: DataFrame, ttl_seconds: int) -> DataFrame:
    """First tick that fills each resting buy (symbol, order_id, ts, limit, ahead): trade-through below the limit, or the
    size ahead traded at it.

    Sizes are whole numbers. Orders meet the ticks of their cell of time as two tables, never as pairs, and each searches
    them (`queue_hits`). An order is never lost; one without symbol, order_id or ts is not filled.

    Rows of one symbol and order_id are one order: what trades for each of them counts together, and the first fill is
    theirs all. Whether there are any is asked at once. Equal rows then count several times, rows that differ meet their
    ticks in pairs (`mixed_fills`)."""
    from pyspark.sql import types as T

    at = ticks.schema["ts"].dataType
    local = isinstance(at, T.TimestampNTZType)  # has no zone, so none may decide on its cell
    day = F.unix_date(F.to_date("ts")).cast("long") * 86_400
    sec = day + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts") if local else F.unix_seconds("ts")
    cell = lambda s: F.floor(s / max(QUEUE_CELL * ttl_seconds, 1))
    apart = -F.pmod(F.xxhash64("order_id"), F.lit(4096)) - (1 << 40)  # cells without ticks for orders without a time
    o = orders.select("symbol", "order_id", F.col("ts").cast(at).alias("ts"), F.col("limit").cast("double").alias("limit"), "ahead")
    named = F.col("symbol").isNotNull() & F.col("order_id").isNotNull()
    t = ticks.select("symbol", "ts", "id", F.col("px").cast("double").alias("px"), "size").where(
        "symbol IS NOT NULL AND ts IS NOT NULL AND px IS NOT NULL")
    t = t.withColumn("_cell", F.explode(F.sequence(cell(sec - ttl_seconds), cell(sec))))
    mixed = None
    if o.where(named).groupBy("symbol", "order_id").count().where("count > 1").isEmpty():
        own = o.withColumn("_n", F.lit(1).cast("long"))
    else:
        w = Window.partitionBy("symbol", "order_id")
        one = lambda c: F.min(c).over(w).eqNullSafe(F.max(c).over(w)) & F.count(c).over(w).isin(F.lit(0), F.col("_n"))
        own = o.withColumn("_n", F.count("*").over(w)).withColumn("_mixed", named & ~(one("ts") & one("limit") & one("ahead")))
        mixed = own.where("_mixed").drop("_mixed").withColumn("_cell", cell(sec))
        own = own.where("NOT _mixed").drop("_mixed")
    field = lambda c: T.StructField(c, o.schema[c].dataType)
    out = T.StructType([field("symbol"), field("order_id"), T.StructField("fill_ts", at), T.StructField("through", T.BooleanType())])
    own = own.withColumn("_cell", F.coalesce(cell(sec), apart)).groupBy("symbol", "_cell")
    found = own.cogroup(t.groupBy("symbol", "_cell")).applyInArrow(queue_hits(ttl_seconds * 1_000_000), out)
    return found if mixed is None else found.unionByName(mixed_fills(mixed, t, ttl_seconds))


def queue_hits(ttl: int):
    """Function of one symbol's orders (symbol, order_id, ts, limit, ahead, _n) and ticks (ts, id, px, size) in Arrow:
    (symbol, order_id, fill_ts, through) of each order.

    Two searches in the ticks by time: the first price below the limit, and, among the ticks at the limit, the first
    place where the running size, taken `_n` times, exceeds the size ahead. Equal (ts, id) are one moment; a
    trade-through in it comes first."""
    import numpy as np
    import pyarrow as pa

    def first_beyond(values, start, least):
        """For each start the first place from it on whose value exceeds `least`, or one behind the last: a tree of maxima,
        climbed, then descended."""
        n = len(values)
        if n == 0:
            return np.zeros(len(start), "int64")
        tree = [np.concatenate([values, np.repeat(values[-1:], (1 << (n - 1).bit_length()) - n)])]
        while len(tree[-1]) > 1:
            tree.append(np.maximum(tree[-1][::2], tree[-1][1::2]))
        at, height = np.array(start, "int64"), np.full(len(start), -1)
        for k, top in enumerate(tree):  # an even place is asked with its parent
            ask = np.flatnonzero((height < 0) & (at < len(top)) & ((at % 2 == 1) | (len(top) == 1)))
            height[ask[(top[at[ask]] > least[ask]).astype(bool)]] = k
            left = height < 0
            at[left] = (at[left] + 1) // 2
        for k in range(len(tree) - 2, -1, -1):
            down = np.flatnonzero(height > k)
            at[down] *= 2
            at[down] += ~(tree[k][at[down]] > least[down]).astype(bool)
        return np.where(height < 0, n, at)

    def run(orders, ticks):
        ticks = ticks.sort_by([("ts", "ascending"), ("id", "ascending")])  # nulls last
        n = ticks.num_rows
        has = lambda *names: np.logical_and.reduce([orders[c].is_valid().to_numpy() for c in names])
        whole = lambda c: c.cast(pa.int64()).fill_null(0).to_numpy()
        us, placed = whole(ticks["ts"]), whole(orders["ts"])
        first, last = np.searchsorted(us, placed, "right"), np.searchsorted(us, placed + ttl, "right")
        rank = np.unique(np.concatenate([ticks["px"].to_numpy(), orders["limit"].fill_null(0.0).to_numpy()]), return_inverse=True)[1]
        px, limit = rank[:n], rank[n:]  # NaN the highest
        ids = ticks["id"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        moment = np.cumsum(np.append(False, (us[1:] != us[:-1]) | (ids[1:] != ids[:-1])))[:n]

        below = first_beyond(-px, first, -limit)
        below[(below >= last) | ~has("symbol", "order_id", "ts", "limit")] = n

        sized = np.flatnonzero(ticks["size"].is_valid().to_numpy())
        at = sized[np.argsort(px[sized], kind="stable")]  # by price, then time
        size = whole(ticks["size"])[at]
        total = sum(map(abs, size.tolist()))
        kind = np.int64 if total < 1 << 61 else object  # object: Python's numbers don't overflow
        done = np.cumsum(size.astype(kind))
        key = px[at] * (n + 1) + at
        begin, end = np.searchsorted(key, limit * (n + 1) + first), np.searchsorted(key, limit * (n + 1) + last)
        turn = (px[at][1:] != px[at][:-1]) | (moment[at][1:] != moment[at][:-1])
        ends = np.append(np.flatnonzero(turn), len(at) - 1)
        together = done[ends[np.searchsorted(ends, np.arange(len(at)))]]
        ahead = np.clip((whole(orders["ahead"]) // whole(orders["_n"])).astype(kind), -total - 1, total)
        found = first_beyond(together, begin, np.concatenate([np.zeros(1, kind), done])[begin] + ahead)
        ok = (found < end) & has("symbol", "order_id", "ts", "limit", "ahead")
        queue = np.full(len(placed), n)
        queue[ok] = at[found[ok]]

        moment = np.append(moment, n)
        through = moment[below] <= moment[queue]
        hit = np.where(through, below, queue)
        none = hit == n
        return orders.select(["symbol", "order_id"]).append_column("fill_ts", ticks["ts"].take(pa.array(hit,
            mask=none))).append_column("through", pa.array(through, mask=none))

    return run


def mixed_fills(orders: DataFrame, ticks: DataFrame, ttl_seconds: int) -> DataFrame:
    """queue_fills of orders of several different rows (with their number _n): each row's ticks in its _cell, in one
    running sum an order."""
    o = orders.withColumn("_dies", F.col("ts") + F.make_dt_interval(secs=F.lit(ttl_seconds))).withColumnRenamed("ts", "_placed")
    near = (o["symbol"] == ticks["symbol"]) & (o["_cell"] == ticks["_cell"])
    t = o.join(ticks, near & (F.col("ts") > F.col("_placed")) & (F.col("ts") <= F.col("_dies")) & (F.col("px") <= F.col("limit")), "left")
    w = Window.partitionBy(o["symbol"], "order_id").orderBy("ts", F.asc_nulls_last("id")).rangeBetween(Window.unboundedPreceding, 0)
    size = F.when(F.col("px") == F.col("limit"), F.col("size").cast("decimal(20,0)")).when(F.col("px").isNotNull(), 0)
    t = t.select(o["symbol"], "order_id", "_n", "ts", "id", "ahead", (F.col("px") < F.col("limit")).alias("through"),
        F.sum(size).over(w).alias("_done"))
    hit = F.struct("ts", F.col("id").isNull(), "id", (~F.col("through")).alias("rest"))
    f = t.groupBy("symbol", "order_id").agg(F.min(F.when(F.col("ts").isNotNull() & (F.col("through") | (F.col("_done") > F.col("ahead"))),
        hit)).alias("f"), F.first("_n").alias("n"))
    return f.select("symbol", "order_id", F.col("f.ts").alias("fill_ts"), (~F.col("f.rest")).alias("through"),
        F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")


def round_trips(fills: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Trips from flat to flat of (qty signed, px): entry and exit times, peak position and cash result; an open trip is left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    f = fills.withColumn("_pos", F.sum("qty").over(w))
    f = f.withColumn("trip", F.coalesce(F.sum((F.col("_pos") == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)))
    t = f.groupBy(*keys, "trip").agg(F.count("*").alias("fills"), F.max(F.abs("_pos")).alias("peak"),
        F.round(F.sum(-F.col("qty") * F.col("px")), 6).alias("pnl"), F.sum("qty").alias("_left"))
    return t.where("_left = 0").drop("_left")


def neighbours(grid: DataFrame, keys: list[str], axes: list[str], value: str) -> DataFrame:
    """Adds n_near and near_mean of the cells one step away on one axis, the others equal; an axis' steps are its own distinct values.

    A cell is copied to its neighbours' places, two for each axis, and met there by an equal join: no pairs inside a key."""
    g = grid
    for a in axes:  # an axis has a grid's few values
        steps = grid.select(a).where(F.col(a).isNotNull()).distinct()
        g = g.join(F.broadcast(steps.withColumn(f"_{a}", F.row_number().over(Window.orderBy(a)))), a)
    at = lambda a, by: F.struct(*((F.col(f"_{x}") + (by if x == a else 0)).alias(f"_{x}") for x in axes))
    near = g.select(*keys, F.explode(F.array(*(at(a, by) for a in axes for by in (-1, 1)))).alias("x"),
        F.col(value).alias("_v")).select(*keys, "x.*", "_v")
    near = near.groupBy(*keys, *(f"_{a}" for a in axes)).agg(F.count("*").alias("n_near"), F.avg("_v").alias("near_mean"))
    return g.join(near, [*keys, *(f"_{a}" for a in axes)]).select(*grid.columns, "n_near", "near_mean")


def order_shuffles(results: DataFrame, key: str, day: str, value: str, trials: int) -> DataFrame:
    """Maximum drawdown of a key's results in `trials` shuffled orders, as 5 %, 50 % and 95 %; results are an aggregate, such as days."""
    from .validate import draw

    t = results.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    u = draw(F.lit("order"), F.col("trial").cast("string"), F.col(key), F.col(day).cast("string"))
    w = Window.partitionBy(key, "trial").orderBy("_u", day).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_u", u).withColumn("_e", F.sum(value).over(w)).withColumn("_p", F.greatest(F.max("_e").over(w), F.lit(0.0)))
    d = t.groupBy(key, "trial").agg(F.min(F.col("_e") - F.col("_p")).alias("dd"))
    return d.groupBy(key).agg(*(F.round(F.percentile("dd", F.lit(p)), 6).alias(n) for p,
        n in ((0.05, "dd05"), (0.5, "dd50"), (0.95, "dd95"))))


def greedy_uncorrelated(returns: DataFrame, name: str, at: str, value: str, cap: float, most: int) -> list[str]:
    """Names chosen in order of total value, each correlated at most `cap` with those before; `most` of them at most.

    Each round takes the best name that is left and one join on time of its results with those of all others; only the
    chosen name comes to the driver, never a matrix. A null correlation forbids nothing."""
    r = returns.groupBy(name, at).agg(F.sum(value).alias("_v"))
    left, out = r.groupBy(name).agg(F.sum("_v").alias("_t")), []
    while len(out) < most and (best := left.orderBy(F.desc("_t"), name).first()) is not None:
        out.append(best[name])
        own = r.where(F.col(name) == best[name]).select(at, F.col("_v").alias("_x"))
        c = r.join(own, at).groupBy(name).agg(correlation("_v", "_x").alias("_c")).where(F.col("_c") > cap).select(name)
        left = left.where(F.col(name) != best[name]).join(c, name, "left_anti")
    return out


def pair_trades(spread: DataFrame, key: str, order: str, z: str, value: str, enter: float, leave: float, stop: float,
    longest: int) -> DataFrame:
    """Mean-reversion trades on a z-score: enter beyond `enter` against it, leave within `leave`, beyond `stop` or after `longest` steps.

    Whether a step can enter depends on the trade before, so a key is walked in order, in one task."""
    import pandas as pd

    ddl = f"`{key}` string, entry bigint, exit bigint, side int, pnl double, why string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, open_at = [], None
        for t, s, v in pdf.sort_values(order)[[order, z, value]].itertuples(index=False):
            if s is None or s != s:
                continue
            if open_at is None:
                if abs(s) >= enter and abs(s) < stop:
                    open_at = (t, -1 if s > 0 else 1, v)
                continue
            why = "revert" if s * open_at[1] >= -leave else "stop" if -s * open_at[1] >= stop else "time" if t - open_at[0] >= longest else None
            if why:
                rows.append((pdf[key].iloc[0], open_at[0], t, open_at[1], open_at[1] * (v - open_at[2]), why))
                open_at = None
        return pd.DataFrame(rows, columns=[key, "entry", "exit", "side", "pnl", "why"])

    return spread.groupBy(key).applyInPandas(run, ddl)


def shapes(mask: Column, w) -> dict[str, Column]:
    """Forms of a condition over time: its rising edge, held four rows, and its aftermath of eight rows."""
    on = mask.cast("int")
    return {"edge": mask & ~F.coalesce(F.lag(mask).over(w), F.lit(False)),
        "hold4": F.coalesce(F.min(on).over(w.rowsBetween(-3, 0)) == 1, F.lit(False)) & (F.count("*").over(w.rowsBetween(-3, 0)) == 4),
        "after8": F.coalesce(F.max(on).over(w.rowsBetween(-8, -1)) == 1, F.lit(False)) & ~mask}


def gamma_flip(chain: DataFrame, keys: list[str], grid: list[float]) -> DataFrame:
    """Per keys the lowest spot at which the signed gamma exposure of (strike, years, vol, call, oi) changes sign, between
    points of the grid, and the number of such crossings. Contracts are summed by equal terms before they meet the grid."""
    c = chain.groupBy(*keys, "strike", "years", "vol").agg(F.sum(F.when(F.col("call"), F.col("oi")).otherwise(-F.col("oi"))).alias("_net"))
    c = c.withColumn("spot", F.explode(F.array(*map(F.lit, map(float, grid)))))
    g = c.groupBy(*keys, "spot").agg(F.sum(S.option_gamma(F.col("spot"), F.col("strike"), F.col("years"),
        F.col("vol")) * F.col("_net") * F.pow("spot", F.lit(2)) * 0.01).alias("_g"))
    w = Window.partitionBy(*keys).orderBy("spot")
    g = g.withColumns({"_pg": F.lag("_g").over(w), "_ps": F.lag("spot").over(w)})
    turn = F.signum("_g") != F.signum("_pg")
    at = F.col("_ps") - F.col("_pg") * (F.col("spot") - F.col("_ps")) / (F.col("_g") - F.col("_pg"))
    return g.groupBy(*keys).agg(F.min(F.when(turn, at)).alias("flip"), F.count_if(turn).alias("crossings"))
