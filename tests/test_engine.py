"""Engine operators: golden values, sources, edge cases."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from tapestride.functions import scalar as S
from tapestride.operators import bars as B
from tapestride.operators import joins as J
from tapestride.operators import signals as G
from tapestride.operators import simulate as X
from tapestride.operators import windows as W
from tapestride.sources import sinks, tape
from tapestride.streaming import engine


def at(minute, day=2):
    return dt.datetime(2024, 1, day) + dt.timedelta(minutes=minute)


IMPULSES = [
    ("up", [(20000, 20002, 19999, 20002), (20002, 20005, 20001, 20004), (20004, 20008, 20003, 20007), (20007, 20011, 20006, 20010)], (1, 10.0, 20003.58, 19997.58, 20015.58)),
    ("down", [(20010, 20011, 20008, 20008), (20008, 20009, 20005, 20006), (20006, 20007, 20002, 20003), (20003, 20003, 19999, 20000)], (-1, -10.0, 20006.42, 20012.42, 19994.42)),
    ("weak", [(20000, 20001, 19999, 20003)], None),
    ("at threshold", [(20000, 20005, 20000, 20005)], (1, 5.0, 20001.91, 19995.91, 20013.91)),
]


@pytest.mark.parametrize(("name", "bars", "want"), IMPULSES)
def test_impulse_setup(spark, name, bars, want):
    df = spark.createDataFrame([(k, *map(float, b)) for k, b in enumerate(bars)], "k int, o double, h double, l double, c double")
    got = df.agg(F.min_by("o", "k").alias("o"), F.max_by("c", "k").alias("c"), F.max("h").alias("h"), F.min("l").alias("l")).select(S.impulse_setup(F.col("o"), F.col("c"), F.col("h"), F.col("l")).alias("s")).first().s
    assert (got and tuple(got)) == want


def test_asof_edges(spark):
    left = spark.createDataFrame([("a", at(0), 1), ("a", at(5), 2), ("a", at(9), 3), ("b", at(5), 4), ("a", at(5), 5)], "k string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([("a", at(5), 1.0), ("a", at(5), 3.0), ("a", at(2), 2.0), ("c", at(1), 9.0)], "k string, ts timestamp_ntz, v double")
    got = {r.id: r.r_v for r in J.asof(left, right, ["k"], "ts", ["v"]).collect()}
    assert got == {1: None, 2: 3.0, 3: 3.0, 4: None, 5: 3.0}
    assert {r.id: r.r_v for r in J.asof(left, right, ["k"], "ts", ["v"], strict=True).collect()} == {1: None, 2: 2.0, 3: 3.0, 4: None, 5: 2.0}
    assert {r.id: r.r_v for r in J.asof(left, right, ["k"], "ts", ["v"], direction="forward").collect()} == {1: 2.0, 2: 3.0, 3: None, 4: None, 5: 3.0}
    assert {r.id: r.r_v for r in J.asof(left, right, ["k"], "ts", ["v"], tolerance="3 MINUTES").collect()}[3] is None
    assert {r.id: r.r_v for r in J.nearest(left, right, ["k"], "ts", ["v"]).collect()} == {1: 2.0, 2: 3.0, 3: 3.0, 4: None, 5: 3.0}


def paths(spark, rows):
    return spark.createDataFrame(rows, f"id int, side int, entry_px double, stop double, target double, path {X.PATH}")


def test_first_touch_rules(spark):
    both = [(112.0, 94.0, 100.0)]
    rows = [(1, 1, 100.0, 95.0, 110.0, both), (2, -1, 100.0, 105.0, 90.0, [(101.0, 99.0, 100.0), (102.0, 89.0, 91.0)]), (3, 1, 100.0, 95.0, 110.0, [(104.0, 96.0, 103.0)]), (4, 1, 100.0, 95.0, 110.0, [])]
    got = {r.id: (r.exit_reason, r.bars_held, r.pnl) for r in X.first_touch(paths(spark, rows)).collect()}
    assert got == {1: ("stop", 1, -5.0), 2: ("target", 2, 10.0), 3: ("timeout", 1, 3.0)}


def test_trailing(spark):
    rows = [(1, 1, 100.0, 0.0, 0.0, [(106.0, 99.0, 105.0), (112.0, 104.0, 110.0), (110.0, 104.0, 106.0)])]
    r = X.trailing(paths(spark, rows), 5.0).first()
    assert (r.trailed, r.bars_held, r.exit_px) == (True, 3, 105.0)


def test_indicator_edges(spark):
    flat = spark.createDataFrame([("a", at(k), k + 1, 5.0, 5.0, 5.0, 5.0, 0) for k in range(30)], "symbol string, ts timestamp_ntz, bar_id int, open double, high double, low double, close double, volume long")
    r = flat.select(W.zscore("close", 20).alias("z"), W.stochastic_k(14).alias("k"), W.sma("close", 20).alias("m")).collect()
    assert {x.z for x in r} == {None} == {x.k for x in r}
    assert [x.m for x in r].count(None) == 19
    assert {x.rsi for x in W.rsi(flat, 14).collect()} == {50.0}
    v = B.vpin(flat, 10.0, 2)
    assert v.count() == 0


def test_rsi_is_bounded(spark):
    bars = spark.createDataFrame([("a", at(k), k + 1, float((k * 37) % 11), 12.0, 0.0, float((k * 53) % 13), 1) for k in range(60)], "symbol string, ts timestamp_ntz, bar_id int, open double, high double, low double, close double, volume long")
    assert all(0 <= x.rsi <= 100 for x in W.rsi(bars, 14).collect())


def test_gate_order(spark):
    s = spark.createDataFrame([(1, True, True), (2, False, False), (3, True, None)], "id int, a boolean, b boolean")
    got = {r.id: (r.veto, r.size) for r in G.gate(s, [("a", F.col("a"), 0), ("b", F.col("b"), 0.5)]).collect()}
    assert got == {1: (None, 1.0), 2: ("a", 0.0), 3: (None, 0.5)}


def test_option_functions(spark):
    x = spark.createDataFrame([(100.0, 105.0, 0.5, 0.3, True), (100.0, 95.0, 0.25, 0.8, False)], "s double, k double, t double, v double, call boolean")
    price = S.option_price(F.col("s"), F.col("k"), F.col("t"), F.col("v"), F.col("call"))
    got = x.withColumn("p", price).select("v", S.implied_vol(F.col("p"), F.col("s"), F.col("k"), F.col("t"), F.col("call")).alias("iv")).collect()
    assert all(abs(r.v - r.iv) < 1e-4 for r in got)
    chain = spark.createDataFrame([("O:SPY240621C00450500",), ("bad",)], "ticker string")
    r = tape.option_chain(chain).first()
    assert (r.root, str(r.expiry), r.cp, r.strike) == ("SPY", "2024-06-21", "C", 450.5)


def test_scalars(spark):
    x = spark.createDataFrame([("$1,001 - $15,000", 1700000000), ("none", 1700000000000)], "t string, n long")
    a, b = x.select(S.amount_midpoint(F.col("t")).alias("m"), S.epoch_time(F.col("n")).alias("e")).collect()
    assert (a.m, b.m) == (8000.5, None)
    assert a.e == b.e
    d = spark.createDataFrame([(dt.date(2024, 3, 1),), (dt.date(2024, 6, 30),)], "d date").select(S.third_friday(F.col("d")).alias("f")).collect()
    assert [str(r.f) for r in d] == ["2024-03-15", "2024-06-21"]


def test_sources(spark, tmp_path):
    (tmp_path / "ES.txt").write_text("20240102 093000;1;2;0.5;1.5;10\nbad;1;1;1;1;1\n")
    r = tape.contract_minutes(spark, str(tmp_path / "ES.txt")).collect()
    assert len(r) == 1 and (r[0].symbol, r[0].close) == ("ES", 1.5)
    (tmp_path / "vix.csv").write_text("Disclaimer, text\n\nDate,Open,Close\n2024-01-02,13.1,13.2\n1/3/2024,.,14\n")
    r = tape.preamble_csv(spark, str(tmp_path / "vix.csv"), "Date", ["Close", "Open"]).orderBy("Date").collect()
    assert [(str(x.Date), x.Close, x.Open) for x in r] == [("2024-01-02", 13.2, 13.1), ("2024-01-03", 14.0, None)]
    t = tape.inline_table(spark, "01-05|1|2\n12-29|3|x", ["day", "a", "b"], 2024).collect()
    assert [(str(x.day), x.a, x.b) for x in t] == [("2024-01-05", 1.0, 2.0), ("2023-12-29", 3.0, None)]
    (tmp_path / "c.xml").write_text("<weeklyevents><event><title>CPI</title><country>USD</country><date>07-11-2024</date><time>8:30am</time><impact>High</impact></event></weeklyevents>")
    c = tape.calendar_xml(spark, str(tmp_path / "c.xml")).first()
    assert (c.title, str(c.ts)) == ("CPI", "2024-07-11 12:30:00")


def test_itch_book(spark, tmp_path):
    head = lambda kind: kind + struct.pack(">HH", 7, 0) + (5).to_bytes(6, "big")
    add = lambda ref, side, n, px: head(b"A") + struct.pack(">QcI8sI", ref, side, n, b"AAPL    ", px * 10_000)
    messages = [add(1, b"B", 100, 10), add(2, b"S", 50, 11), add(3, b"B", 10, 9), head(b"E") + struct.pack(">QIQ", 1, 40, 1), head(b"D") + struct.pack(">Q", 2), head(b"U") + struct.pack(">QQII", 3, 4, 20, 12 * 10_000)]
    (tmp_path / "x.bin").write_bytes(b"".join(struct.pack(">H", len(m)) + m for m in messages))
    m = tape.itch_messages(spark, str(tmp_path / "x.bin"))
    assert [r.kind for r in m.orderBy("seq").collect()] == ["A", "A", "A", "E", "D", "U"]
    last = engine.order_book(m, 3).orderBy("seq").collect()
    assert (last[0].bid, last[0].bid_size, last[0].ask) == (10.0, 100, 11.0)
    assert (last[1].bid, last[1].bid_size, last[1].ask) == (12.0, 20, None)


def test_upsert(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.write_parquet(old, f"{tmp_path}/a")
    sinks.upsert(spark, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), f"{tmp_path}/a", f"{tmp_path}/b", ["k"])
    assert sorted(spark.read.parquet(f"{tmp_path}/b").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    last = sinks.keep_last(spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, t int, v string"), ["k"], ["t"])
    assert [tuple(r) for r in last.collect()] == [(1, 2, "y")]


def test_late_bars_replace(spark):
    built = spark.createDataFrame([("a", at(0), 1.0), ("a", at(1), 2.0)], "symbol string, ts timestamp_ntz, close double")
    official = spark.createDataFrame([("a", at(1), 9.0), ("a", at(2), 3.0)], "symbol string, ts timestamp_ntz, close double")
    once = engine.replaced(built, official)
    assert sorted(r.close for r in once.collect()) == [1.0, 3.0, 9.0]
    assert sorted(engine.replaced(once, official).collect()) == sorted(once.collect())


def test_entry_without_corpus_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tapestride", tmp_path / "tapestride", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(k.startswith('op1') for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
