"""Walks over bars against plain loops and fixed cases."""

import datetime as dt
import random

import pytest

from tapestride import plans
from tapestride.operators import sequences

SF = "/root/testdata/sf0.001"
BARS = "symbol string, bar_id int, high double, low double, close double"


def bars(spark, rows):
    return spark.createDataFrame([("a", k + 1, float(h), float(lo), float(c)) for k, (h, lo, c) in enumerate(rows)], BARS)


def test_replay(spark):
    setups = lambda *rows: spark.createDataFrame([("a", k, s, float(e), float(st), float(t)) for k, s, e, st, t in rows], "symbol string, bar_id int, side int, entry double, stop double, target double")
    go = lambda b, s, ttl=3, hold=3, cooldown=0: [tuple(x)[1:] for x in sequences.replay(bars(spark, b), s, ttl, hold, cooldown).collect()]
    flat = [(11, 10, 10.5)] * 8
    one = setups((1, 1, 9, 7, 12))
    assert go(flat, one) == []  # never filled: the order dies
    assert go([(11, 10, 10), (11, 8.5, 9), (12.5, 9, 12)], one) == [(1, 2, 3, 1, 9.0, 12.0, "target")]
    assert go([(11, 10, 10), (13, 8.5, 9), (11, 9, 10), (11, 9, 10), (11, 9, 10.25)], one) == [(1, 2, 5, 1, 9.0, 10.25, "time")]  # no target on the fill's bar
    assert go([(11, 10, 10), (11, 6.5, 9), (20, 9, 10)], one) == [(1, 2, 2, 1, 9.0, 7.0, "stop")]  # but a stop on it
    assert go([(11, 10, 10), (11, 8.5, 9), (13, 6.5, 9)], one) == [(1, 2, 3, 1, 9.0, 7.0, "stop")]  # the stop wins the tie
    assert go([(11, 10, 10), (11, 8.5, 9), (12.5, 9, 12), (13, 9, 12), (13, 9, 12)], setups((1, 1, 9, 7, 12), (2, 1, 9, 7, 12))) == [(1, 2, 3, 1, 9.0, 12.0, "target")]  # one at a time
    assert go([(11, 10, 10)] * 4 + [(11, 8, 9)], one, ttl=2) == []
    assert go([(11, 10, 10), (11, 8.5, 9), (12.5, 9, 12), (11, 10, 10), (11, 8, 9), (13, 9, 9)], setups((1, 1, 9, 7, 12), (4, 1, 9, 7, 12)), cooldown=2) == [(1, 2, 3, 1, 9.0, 12.0, "target")]


def test_replay_on_the_tape(spark):
    got = plans.queries()["setup_replay"](spark, SF).orderBy("symbol", "setup_id").collect()
    assert len(got) > 20 and {"stop", "target"} <= {r.why for r in got} <= {"stop", "target", "time"}
    for a, b in zip(got, got[1:]):
        assert a.setup_id <= a.fill_id <= a.exit_id and (a.why != "target" or a.exit_id > a.fill_id)
        assert a.symbol != b.symbol or b.setup_id > a.exit_id + 1


def test_q_values(spark):
    r = random.Random(8)
    rows = [(s, k + 1, r.randrange(3), r.gauss(0, 1)) for s in "ab" for k in range(50)]
    got = {(x.symbol, x.state, x.action): x.value for x in sequences.q_table(spark.createDataFrame(rows, "symbol string, bar_id int, state int, move double"), 0.2, 0.8, 0.1).collect()}
    for s in "ab":
        own, q = [x for x in rows if x[0] == s], {}
        for (_, _, state, move), (_, _, after, _) in zip(own, own[1:]):
            best = max(q.get((after, a), 0.0) for a in (-1, 0, 1))
            for a in (-1, 0, 1):
                q[state, a] = q.get((state, a), 0.0) + 0.2 * (a * move - 0.1 * abs(a) + 0.8 * best - q.get((state, a), 0.0))
        assert {k[1:]: v for k, v in got.items() if k[0] == s} == {k: pytest.approx(v) for k, v in q.items()}
    table = plans.queries()["q_learning"](spark, SF).collect()
    assert {x.action for x in table} == {-1, 0, 1} and len({x.symbol for x in table}) == 5


def test_state_begins_anew_for_each_key(spark):
    def step(s, b):
        s["n"] = s.get("n", 0) + 1
        return [(b.k, b.t, s["n"])]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    df = spark.createDataFrame([(k, t) for t in range(10) for k in "abc"], "k string, t int")
    got = sequences.streamed(df, "k", "t", "k string, t int, n int", dict, step).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(k, t, t + 1) for k in "abc" for t in range(10)]


def test_cointegration_tells_pairs_apart(spark):
    r, rows = random.Random(2), []
    y = 50.0
    z = 0.0
    walk = 80.0
    for k in range(400):
        y += r.gauss(0, 1)
        z = 0.5 * z + r.gauss(0, 1)
        walk += r.gauss(0, 1)
        rows += [("tied", dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), 2 * y + z, y), ("loose", dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), walk, y)]
    got = {x.pair: x for x in sequences.cointegration(spark.createDataFrame(rows, "pair string, ts timestamp, x double, y double"), "pair", "ts", "x", "y").collect()}
    assert got["tied"].p_bound == 0.01 and got["tied"].beta == pytest.approx(2, abs=0.1)
    assert got["loose"].p_bound > 0.01
