"""Gates, fills, searches and streams without SQL, against plain loops or fixed cases."""

import datetime as dt
import gzip
import random
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapestride import plans
from tapestride.operators import fills, gates, joins, market, minute, search, stats, windows
from tapestride.sources import tape
from tapestride.streaming import engine

SF = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 1, 2)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def gated(spark, rows, limits):
    df = spark.createDataFrame([("b", f"{k:03}", at(a), at(z), p) for k, (a, z, p) in enumerate(rows)], "book string, id string, entry timestamp, exit timestamp, pnl double")
    return [(r.denied, r.qty) for r in gates.account_gates(df, "book", limits).orderBy("id").collect()]


def test_account_gates(spark):
    L = gates.Limits
    assert gated(spark, [(0, 30, 1.0), (10, 20, 1.0), (30, 40, 1.0)], L()) == [(None, 1), ("position", 0), (None, 1)]
    assert gated(spark, [(0, 10, 1.0), (11, 20, 1.0), (12, 13, 1.0)], L(cooldown=120)) == [(None, 1), ("cooldown", 0), (None, 1)]
    assert gated(spark, [(0, 1, 1.0), (2, 3, 1.0), (4, 5, 1.0), (1500, 1501, 1.0)], L(per_day=2)) == [(None, 1), (None, 1), ("per day", 0), (None, 1)]
    assert gated(spark, [(0, 1, -1.0), (2, 3, -1.0), (4, 5, 1.0), (30, 31, 1.0), (70, 71, 1.0)], L(losses=2, pause=3600)) == [(None, 1), (None, 1), ("losses", 0), ("locked", 0), (None, 1)]
    assert gated(spark, [(0, 1, -50.0), (2, 3, 1.0), (600, 601, 1.0), (1441, 1442, 1.0)], L(day_loss=40)) == [(None, 1), ("day loss", 0), ("locked", 0), (None, 1)]
    assert gated(spark, [(0, 1, -50.0), (2, 3, 1.0)], L(start=1000, trail=100, buffer=60)) == [(None, 1), ("floor", 0)]
    assert gated(spark, [(0, 1, -30.0), (2, 3, 1.0)], L(start=1000, trail=100, sizes=((90.0, 2), (0.0, 1)))) == [(None, 2), (None, 1)]
    assert gated(spark, [(0, 1, -30.0), (2, 3, 1.0)], L(start=1000, trail=100, sizes=((90.0, 2),))) == [(None, 2), ("size", 0)]
    assert gated(spark, [(60, 61, 1.0), (300, 301, 1.0)], L(windows=((3, 22),))) == [("window", 0), (None, 1)]


def test_book_limits(spark):
    rows = [("b", "ES", "1", at(0), at(50), 1, 40.0), ("b", "ES", "2", at(5), at(9), -1, 40.0), ("b", "ES", "3", at(6), at(9), 1, 40.0), ("b", "NQ", "4", at(7), at(60), 1, 40.0), ("b", "CL", "5", at(8), at(9), 1, 40.0),
            ("b", "GC", "6", at(50), at(70), 1, 70.0), ("b", "GC", "7", at(60), at(70), 1, 70.0), ("c", "ES", "8", at(5), at(9), -1, 40.0)]
    df = spark.createDataFrame(rows, "book string, root string, id string, entry timestamp, exit timestamp, side int, margin double")
    got = {r.id: r.denied for r in gates.book_limits(df, "book", "root", 2, 100.0).collect()}
    assert got == {"1": None, "2": "netting", "3": "root", "4": None, "5": "open", "6": "margin", "7": None, "8": None}
    got = {r.id: r.denied for r in gates.book_limits(df.where("book = 'b' AND id IN ('1', '4')"), "book", "root", 5, 100.0, (0.5, 0.1)).collect()}
    assert got == {"1": None, "4": "margin"}


def test_target_and_ratio(spark):
    rows = [("GAP_FILL_LONG", 1, 100.0, 107.0, 103.0), ("PDH_TOUCH", -1, 100.0, None, 95.0), ("ZSCORE_SHORT", -1, 100.0, None, None), ("VWAP_RECLAIM_LONG", 1, 100.0, None, None), ("OTHER", 1, 100.0, None, None), ("EQ50_LONG", 1, 100.0, None, None)]
    x = spark.createDataFrame(rows, "n string, s int, px double, pc double, eq double")
    t = gates.derived_target(F.col("n"), F.col("s"), F.col("px"), F.col("pc"), F.col("eq"))
    got = x.withColumn("t", t).withColumn("r", gates.reward_ratio(F.col("s"), F.col("px"), F.lit(10.0), F.col("t"))).withColumn("need", gates.least_ratio(F.col("n"))).collect()
    assert [(r.t, r.r, r.need) for r in got] == [(107.0, 0.7, 1.3), (95.0, 0.5, 2.0), (75.0, 2.5, 2.0), (120.0, 2.0, 1.5), (130.0, 3.0, 2.0), (100.0, None, 2.0)]


def test_ratchet(spark):
    ddl = "id int, side int, entry_px double, atr double, path array<struct<high:double,low:double,close:double,open:double>>"
    rows = [(1, 1, 100.0, 10.0, [(104.0, 99.0, 103.0, 100.0), (103.0, 95.0, 96.0, 103.0), (97.0, 94.0, 95.0, 96.0)]), (2, -1, 100.0, 10.0, [(101.0, 90.0, 91.0, 100.0), (99.0, 92.0, 93.0, 91.0), (101.0, 98.0, 100.0, 93.0)]), (3, 1, 100.0, 10.0, [(100.2, 96.0, 100.0, 100.0)])]
    got = {r.id: (r.exit_px, r.bars_held, r.stopped) for r in fills.ratchet(spark.createDataFrame(rows, ddl), "atr", 0.5, 0.25).collect()}
    assert got == {1: (99.0, 2, True), 2: (95.0, 2, True), 3: (100.0, 1, False)}  # 0.2 of progress is less than a tick


UP = [(22000.0, 22002.0, 21999.0, 22002.0), (22002.0, 22005.0, 22001.0, 22004.0), (22004.0, 22008.0, 22003.0, 22007.0), (22007.0, 22011.0, 22006.0, 22010.0)]
DOWN = [(22010.0, 22011.0, 22008.0, 22008.0), (22008.0, 22009.0, 22005.0, 22006.0), (22006.0, 22007.0, 22002.0, 22003.0), (22003.0, 22003.0, 21999.0, 22000.0)]


# fixed values: bars and setups of the impulse rule, plain and inverted
@pytest.mark.parametrize(("bars", "params", "want"), [
    (UP, (0.618, 6.0, 12.0, False), (1, 1, 22003.5, 21997.75, 22015.75)), (UP, (0.236, 10.0, 20.0, True), (1, -1, 22008.0, 22018.0, 21988.0)),
    (DOWN, (0.236, 10.0, 20.0, True), (-1, 1, 22002.0, 21992.0, 22022.0)), ([(22000.0, 22001.0, 21999.0, 22002.0)] * 4, (0.618, 6.0, 12.0, False), None), (UP[:3], (0.618, 6.0, 12.0, False), None),
])
def test_impulse_setups(spark, bars, params, want):
    df = spark.createDataFrame([("a", at(k), k + 1, *b, 1) for k, b in enumerate(bars)], "symbol string, ts timestamp, bar_id int, open double, high double, low double, close double, volume long")
    pull, stop, target, invert = params
    got = [(r.approach, r.side, r.entry, r.stop, r.target) for r in minute.impulse_setups(df, 4, 5.0, pull, stop, target, 0.25, invert).collect()]
    assert got == ([want] if want else [])


def test_entry_is_reached_from_the_impulses_side(spark):
    x = spark.createDataFrame([(-1, 22001.0, 21997.0), (-1, 22003.0, 21997.0), (1, 22003.0, 22002.5)], "a int, high double, low double")
    assert [r[0] for r in x.select(minute.is_reached(F.col("a"), F.lit(22002.0))).collect()] == [False, True, False]


def test_genetic_search(spark):
    want = lambda p: -((p["stop"] - 12) ** 2) - (p["target"] - 30) ** 2
    rows = search.evolve(spark, {"stop": (5.0, 25.0), "target": (5.0, 45.0)}, lambda people: {k: want(p) for k, p in enumerate(people)}, 12, 8).collect()
    best = {}
    for r in rows:
        assert r.fitness == pytest.approx(want(r.asDict())) and 5 <= r.stop <= 25 and 5 <= r.target <= 45
        best[r.generation] = max(best.get(r.generation, -1e9), r.fitness)
    assert [best[g] for g in range(8)] == sorted(best.values()) and best[7] > best[0]
    got = plans.queries()["genetic_exits"](spark, SF).collect()  # every fitness again, one by one
    from tapestride.operators.simulate import first_touch
    from tapestride.plans.catalog2 import entries

    e = entries(spark, SF).where(F.size("path") > 0)
    for r in got[:3]:
        t = first_touch(e.withColumns({"stop": F.col("entry_px") - F.col("side") * r.stop, "target": F.col("entry_px") + F.col("side") * r.target}))
        assert t.agg(F.avg("pnl")).first()[0] == pytest.approx(r.fitness)


def test_leaf_rules_are_filters(spark):
    r = random.Random(2)
    rows = [(r.uniform(-2, 2), r.uniform(0, 3)) for _ in range(400)]
    df = spark.createDataFrame([(a, b, (5.0 if a > 0.5 else 0.0) + (1.0 if b > 1 else 0.0)) for a, b in rows], "z double, vr double, fwd double")
    got = search.leaf_rules(df, ["z", "vr"], "fwd", 2, 10).collect()
    assert sum(x.n for x in got) == 400 and len(got) > 2
    for x in got:
        own = df.where(x.rule)
        assert (own.count(), pytest.approx(own.agg(F.avg("fwd")).first()[0], abs=1e-5)) == (x.n, x.mean_value)


def test_greedy_choice(spark):
    r = random.Random(4)
    base = {n: [r.gauss(0.3 - k / 20, 1) for _ in range(60)] for k, n in enumerate("abcdef")}
    base["b"] = [x + r.gauss(0, 0.1) for x in base["a"]]
    base["e"] = [-x for x in base["c"]]
    df = spark.createDataFrame([(n, t, v) for n, xs in base.items() for t, v in enumerate(xs)], "n string, t int, v double")
    frame = pd.DataFrame(base)
    for cap, most in ((0.3, 6), (0.95, 3), (-2.0, 6)):
        want = []
        for n in frame.sum().sort_values(ascending=False).index:
            if len(want) < most and all(frame[n].corr(frame[m]) <= cap for m in want):
                want.append(n)
        assert market.greedy_uncorrelated(df, "n", "t", "v", cap, most) == want


def test_quantiles(spark):
    r = random.Random(1)
    values = {"a": [r.gauss(0, 1) for _ in range(999)], "b": [5.0] * 40 + [7.0], "c": [1.5], "d": [-1e9, 0.0, 1e9, 1e-9]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("e", None)], "k string, v double")
    got = {x.k: (x.lo, x.mid, x.hi) for x in stats.quantiles(df, "k", "v", {"lo": 0.0, "mid": 0.5, "hi": 0.99}, cells=16).collect()}
    assert got == {k: tuple(pytest.approx(pd.Series(v).quantile(q)) for q in (0.0, 0.5, 0.99)) for k, v in values.items()}


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_averages_over_batches(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    r = random.Random(3)
    rows = [(s, DAY + dt.timedelta(hours=7 * k), k + 1, None if r.random() < 0.2 or k < 2 and s == "b" else r.uniform(1, 9)) for s in "ab" for k in range(40)]
    got = windows.ewm(spark.createDataFrame(rows, "symbol string, ts timestamp, bar_id int, x double"), {"y": ("x", 0.3), "z": ("x", 0.05)}).toPandas()
    for s in "ab":
        own = got[got.symbol == s].sort_values("bar_id")
        for name, a in (("y", 0.3), ("z", 0.05)):
            pd.testing.assert_series_equal(own[name].reset_index(drop=True), pd.Series([x[3] for x in rows if x[0] == s], dtype=float).ewm(alpha=a, adjust=False, ignore_na=True).mean(), check_names=False)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_asof_over_days_and_ties(spark):
    r = random.Random(5)
    times = lambda n: [DAY + dt.timedelta(hours=r.randrange(400)) for _ in range(n)]
    left = [(s, t, k) for k, (s, t) in enumerate(zip(r.choices("ab", k=60), times(60)))]
    right = [(s, t, k, r.randrange(100)) for k, (s, t) in enumerate(zip(r.choices("ab", k=40), times(40)))] + [("a", DAY, 100, 50), ("a", DAY, 101, 3)]
    a, b = spark.createDataFrame(left, "s string, t timestamp, id int"), spark.createDataFrame(right, "s string, t timestamp, n int, v int")
    for direction, strict in (("backward", False), ("backward", True), ("forward", False), ("forward", True)):
        got = {x.id: (x.r_t_, x.r_v) for x in joins.asof(a, b, ["s"], "t", ["v"], direction=direction, strict=strict, order=["n"]).withColumnRenamed("r_at", "r_t_").collect()}
        for s, t, k in left:
            ok = [(u, n, v) for z, u, n, v in right if z == s and ((u < t or u == t and not strict) if direction == "backward" else (u > t or u == t and not strict))]
            if direction == "forward":
                ok = [x for x in ok if x[0] == min(y[0] for y in ok)]
            best = max(ok, default=(None, None, None))
            assert got[k] == (best[0], best[2]), (direction, strict, k)


def test_trailing_time_crosses_cells(spark):
    r = random.Random(6)
    rows = [("a", DAY + dt.timedelta(seconds=r.randrange(20_000)), k, r.randrange(1, 9)) for k in range(300)]
    df = windows.trailing_time(spark.createDataFrame(rows, "s string, ts timestamp, id int, n int"), ["s"], "ts", 600, 900, lambda w: {"total": F.sum("n").over(w)})
    want = {k: sum(m for _, u, _, m in rows if t - dt.timedelta(seconds=600) <= u <= t) for _, t, k, _ in rows}
    assert {x.id: x.total for x in df.collect()} == want


def test_book_of_all_messages(spark, tmp_path):
    def head(kind, locate=7):
        return kind + struct.pack(">HH", locate, 0) + (5).to_bytes(6, "big")

    add = lambda ref, side, n, px: head(b"A") + struct.pack(">QcI8sI", ref, side, n, b"AAPL    ", px * 10_000)
    data = [head(b"R") + b"AAPL    " + b"Q" * 20, add(1, b"B", 100, 10), add(2, b"S", 50, 11), head(b"C") + struct.pack(">QIQcI", 1, 60, 9, b"Y", 99_000)]
    raw = b"".join(struct.pack(">H", len(m)) + m for m in data)
    (tmp_path / "a.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "b.bin").write_bytes(raw + struct.pack(">H", len(m := add(3, b"B", 5, 12))) + m)
    messages = tape.itch_messages(spark, str(tmp_path))
    assert sorted(x.kind for x in messages.collect()) == sorted("RAAC" "RAACA")
    assert {x.price for x in messages.where("kind = 'C'").collect()} == {9.9} and messages.where("kind = 'R' AND stock = 'AAPL'").count() == 2
    last = {x.file[-5:]: (x.bid, x.bid_size, x.ask) for x in engine.order_book(messages, 3).collect()}
    assert last == {"/a.gz": (10.0, 40, 11.0), "b.bin": (10.0, 40, 11.0)}


def test_readers(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("ts,open,high,low,close,volume\n2024-01-02 00:00:00,1,2,0,1,5\n2024-01-02 00:05:00,1,2,0,1,5\n2024-01-02 00:00:00,9,9,9,9,9\n")
    assert sorted((str(x.ts), x.open) for x in tape.bars_csv(spark, str(tmp_path / "bars.csv")).collect()) == [("2024-01-02 00:00:00", 9.0), ("2024-01-02 00:05:00", 1.0)]
    (tmp_path / "NQ.txt").write_text("20240102 093000 1234567;100.25;100;100.5;3\nbad;1;1;1;1\n20240102 093001 0000000;100;0;100.5;2\n")
    got = tape.tick_files(spark, str(tmp_path / "NQ.txt")).orderBy("ns").collect()
    assert [(x.symbol, x.ns % 10**9, x.px, x.bid, x.size) for x in got] == [("NQ", 123456700, 100.25, 100.0, 3), ("NQ", 0, 100.0, None, 2)]
    assert got[0].ts.microsecond == 123456
    (tmp_path / "agg.json").write_text('{"ticker": "ES",\n "results": [{"t": 1704186000000, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 7}]}')
    one = tape.aggregate_json(spark, str(tmp_path / "agg.json")).first()
    assert (one.symbol, one.open, one.volume) == ("ES", 1.0, 7.0)
    (tmp_path / "f.xml").write_text("<feed><entry><title>4 - Some Corp</title><updated>2024-01-02T10:00:00-05:00</updated></entry></feed>")
    assert tape.filings(spark, str(tmp_path / "f.xml")).first().form == "4"


def test_strategy_in_the_stream(spark):
    """Against a plain walk over all ticks of a symbol; a second run of the same name finds nothing new."""
    n, dip, target, stop, cooldown, loss = 5, 10.0, 15.0, 12.0, 3, 60.0
    ticks = sorted((r.symbol, r.ts, r.id, r.px) for r in tape.tape(spark, SF).collect())
    want, state = [], {}
    for s, ts, tid, px in ticks:
        day = (ts + dt.timedelta(hours=2)).date()
        x = state.get(s)
        if x is None or x["day"] != day:
            if x and x["at"]:
                want.append((s, x["day"], x["at"][0], x["last"][0], x["at"][1], x["last"][1], "session"))
            x = state[s] = {"day": day, "seen": [], "at": None, "rest": 0, "pnl": 0.0, "last": None}
        if x["at"]:
            move = px - x["at"][1]
            why = "stop" if px <= x["at"][1] - stop else "target" if px >= x["at"][1] + target else None
            if why:
                want.append((s, day, x["at"][0], tid, x["at"][1], px, why))
                x.update(at=None, rest=cooldown, pnl=x["pnl"] + move)
        elif x["rest"]:
            x["rest"] -= 1
        elif len(x["seen"]) >= n and px <= sum(x["seen"][-n:]) / n - dip and x["pnl"] > -loss:
            x["at"] = (tid, px)
        x["seen"].append(px)
        x["last"] = (tid, px)
    got = [tuple(r) for r in plans.queries()["stream_strategy"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and len({r[-1] for r in got}) == 3


def test_stream_goes_on(spark, tmp_path):
    run = lambda: engine.run_to_end(engine.count_bars(engine.tick_stream(spark, SF), 25), f"file://{tmp_path}", "bars").count()
    first = run()
    assert first > 0 and run() == first


def test_pair_trades(spark):
    rows = [(k, z, v) for k, (z, v) in enumerate([(0.0, 10.0), (2.0, 12.0), (1.0, 11.0), (0.1, 10.0), (-1.6, 8.0), (-4.5, 5.0), (3.0, 14.0), (2.5, 13.0), (2.5, 13.0), (2.5, 12.0)])]
    df = spark.createDataFrame([("p", *r) for r in rows], "pair string, step long, z double, spread double")
    got = [(r.entry, r.exit, r.side, r.pnl, r.why) for r in market.pair_trades(df, "pair", "step", "z", "spread", 1.5, 0.2, 4.0, 3).orderBy("entry").collect()]
    assert got == [(1, 3, -1, 2.0, "revert"), (4, 5, 1, -3.0, "stop"), (6, 9, -1, 2.0, "time")]


def test_models(spark):
    """A forest's confusion holds every holdout row; regimes cover every bar that has features."""
    from tapestride.operators import learn
    from tapestride.plans.catalog import hourly

    f = learn.features(hourly(spark, SF), 6, 4.0)
    cut = f.groupBy("symbol").agg(F.percentile("bar_id", F.lit(0.7)).alias("cut"))
    hold = f.join(cut, "symbol").where("bar_id > cut").count()
    c = plans.queries()["forest_confusion"](spark, SF).collect()
    assert sum(r["n"] for r in c) == hold
    m = plans.queries()["market_regimes"](spark, SF).collect()
    assert sum(r.n for r in m) == f.dropna(subset=["z20", "range_ratio", "volume_ratio"]).count()
    assert len({r.regime for r in m}) == 3
