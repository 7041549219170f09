"""Queries over all rows of their tables, against brute force on small fixtures."""

import datetime as dt
import hashlib
import random

import pytest

from tapestride import plans


def events(spark, path, n=300, seed=4):
    """Ticks of few prices, so that a tick's half price often trades."""
    r = random.Random(seed)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randrange(1500)), r.randrange(9), r.choice(["click", "view"]), r.choice([1.0, 2.0, 4.0, 8.0]), f'{{"k": {r.randrange(1, 20)}}}') for k in range(1, n + 1)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return rows


def test_every_tick_is_an_order(spark, tmp_path):
    rows = events(spark, tmp_path)
    ticks = sorted((ts, k, kind, px, int(p.split(":")[1][:-1])) for k, ts, _, kind, px, p in rows)
    want = {}
    for placed, k, kind, px, ahead in ticks:
        want[k], done, limit = (None, None), 0, round(px * 0.5, 2)
        for ts, _, other, x, size in ticks:
            if other == kind and placed < ts <= placed + dt.timedelta(hours=3) and x <= limit:
                done += size if x == limit else 0
                if x < limit or done > ahead:
                    want[k] = (ts, x < limit)
                    break
    got = plans.queries()["queue_fills"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert {x.order_id: (x.fill_ts, x.through) for x in got} == want
    assert len({x[1] for x in want.values()}) == 3


def test_stable_order_keeps_all(spark, tmp_path):
    rows = events(spark, tmp_path)
    got = [(x.ts, x.event_id, x.h) for x in plans.queries()["stable_order"](spark, str(tmp_path)).collect()]
    assert got == sorted((ts, k, hashlib.md5(kind.encode()).hexdigest()) for k, ts, _, kind, _, _ in rows)


def test_neighbours_of_the_whole_grid(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice("AN"), r.randrange(11) / 100, r.randrange(9) / 100, float(r.randrange(1, 50))) for _ in range(800)]
    spark.createDataFrame(rows, "l_returnflag string, l_discount double, l_tax double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    cells = {}
    for flag, a, b, q in rows:
        cells.setdefault((flag, round(a * 100), round(b * 100)), []).append(q)
    mean = {k: sum(v) / len(v) for k, v in cells.items()}
    want = {}
    for f, a, b in mean:
        near = [mean[c] for c in ((f, a - 1, b), (f, a + 1, b), (f, a, b - 1), (f, a, b + 1)) if c in mean]
        if near:
            want[f, a, b] = (pytest.approx(mean[f, a, b], abs=1e-5), len(near), pytest.approx(sum(near) / len(near), abs=1e-5))
    got = {(x.flag, round(x.disc * 100), round(x.tax * 100)): (x.v, x.n_near, x.near_mean) for x in plans.queries()["parameter_neighbours"](spark, str(tmp_path)).collect()}
    assert got == want
    assert max(a for _, a, _ in got) == 10


def test_calendar_takes_all_orders(spark, tmp_path):
    day = lambda k: dt.date(1995, 1, 1) + dt.timedelta(days=k)
    rows = [(1, "O", 10.5, day(0), "a"), (2, "P", 1.25, day(0), "a"), (5, "F", 7.0, day(4), "a"), (7, "F", 2.0, day(6), "a"), (3, "O", 3.0, day(2), "b")]
    spark.createDataFrame(rows, "o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(x.k, x.day): x.v for x in plans.queries()["calendar_ffill"](spark, str(tmp_path)).collect()}
    assert got == {("a", day(k)): 11.75 if k < 4 else 7.0 if k < 6 else 2.0 for k in range(7)} | {("b", day(2)): 3.0}


@pytest.mark.parametrize("block", [1024, 16])
def test_motif_over_all_windows(spark, monkeypatch, block):
    from tapestride.operators import more

    monkeypatch.setattr(more, "MOTIF_BLOCK", block)
    r, m = random.Random(9), 6
    closes = {"a": [r.uniform(90, 110) for _ in range(90)], "b": [5.0] * 20, "c": [1.0, 2.0, 4.0]}
    closes["a"][30:40] = [100.0] * 10
    for shape in (7, 60):  # the same shape again 7 and 60 bars after bar 20, at another level and scale
        closes["a"][15 + shape : 21 + shape] = [3 * x + shape for x in closes["a"][15:21]]
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), x) for s, c in closes.items() for k, x in enumerate(c)]
    got = {s: [] for s in closes}
    for x in more.motif_distance(spark.createDataFrame(rows, "symbol string, ts timestamp, close double"), m).orderBy("symbol", "ts").collect():
        got[x.symbol].append((x.motif, x.density))
    want = {}
    for s, c in closes.items():
        z = []
        for k in range(len(c)):
            w = c[k - m + 1 : k + 1] if k >= m - 1 else []
            mean = sum(w) / m
            sd = (sum((x - mean) ** 2 for x in w) / m) ** 0.5
            z.append([(x - mean) / sd for x in w] if sd > 1e-9 else None)
        pairs = {(i, j): sum((x - y) ** 2 for x, y in zip(z[i], z[j])) for j in range(len(c)) for i in range(j - m + 1) if z[i] and z[j]}
        width = 4 * m / more.MOTIF_CELLS
        cells = sorted(min(int(d / width), more.MOTIF_CELLS - 1) for d in pairs.values())
        cut = cells[-(-len(cells) * 2 // 100) - 1] if cells else -1
        want[s] = []
        for k in range(len(c)):
            least = [d for (_, j), d in pairs.items() if j == k]
            n = sum(int(d / width) <= cut for p, d in pairs.items() if k in p)
            want[s].append((pytest.approx(min(least) ** 0.5, abs=1e-6) if least else None, n if z[k] else None))
    assert got == want
    assert got["a"][27][0] < 1e-6 and got["a"][80][0] < 1e-6 and max(n for _, n in got["a"] if n is not None) > 1
