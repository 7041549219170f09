"""Readers of landed files, and sinks."""

import io
import json
import lzma
import sqlite3
import struct
import zipfile

import numpy as np
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.feature import VectorAssembler

from tapestride.sources import sinks, tape


def test_hourly_ticks(spark, tmp_path):
    (tmp_path / "EURUSD_2024010205.bi5").write_bytes(lzma.compress(struct.pack(">IIIff", 1500, 110_010, 110_000, 1.5, 2.0) * 2))
    (tmp_path / "EURUSD_2024010206.bi5").write_bytes(b"")
    got = tape.hourly_ticks(spark, str(tmp_path), 1e5).collect()
    assert [(r.symbol, r.ms, r.bid, r.ask, r.ask_size) for r in got] == [("EURUSD", 1704171600000 + 1500, 1.1, 1.1001, 1.5)] * 2


def test_sqlite_and_arrays(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("CREATE TABLE trades (id INTEGER PRIMARY KEY, side TEXT, pnl REAL)")
    con.executemany("INSERT INTO trades VALUES (?, ?, ?)", [(1, "LONG", 2.5), (2, None, None)])
    con.commit()
    con.close()
    assert sorted(map(tuple, tape.sqlite_table(spark, str(tmp_path / "a.db"), "trades", "id bigint, pnl double, side string").collect())) == [(1, 2.5, "LONG"), (2, None, None)]
    np.savez(tmp_path / "s.npz", x=np.arange(3), y=np.array([0.5, 1.5, 2.5]))
    assert sorted(map(tuple, tape.array_shards(spark, str(tmp_path / "s.npz"), ["y", "x"]).collect())) == [("s.npz", 0.5, 0.0), ("s.npz", 1.5, 1.0), ("s.npz", 2.5, 2.0)]


def test_excel(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>week</t></si><si><r><t>bull</t></r><r><t>ish</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2"><v>45000</v></c><c r="C2" t="s"><v>1</v></c></row><row><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(data.getvalue())
    assert [tuple(r) for r in tape.excel_sheet(spark, str(tmp_path / "a.xlsx"), ["a", "b", "c"]).collect()] == [("45000", None, "bullish"), (None, "x", None)]


def test_socket_events(spark):
    lines = [json.dumps([{"ev": "T", "sym": "A", "t": 1704171600000, "p": 1.5, "s": 3}, {"ev": "Q", "sym": "A", "t": 1704171600000, "bp": 1.0, "ap": 2.0}, {"ev": "status"}]), json.dumps([{"ev": "AM", "sym": "B", "t": 1704171600000, "o": 1, "h": 2, "l": 0, "c": 1.25, "v": 7}]), "broken"]
    got = tape.socket_events(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted((r.kind, r.symbol, r.px, r.size) for r in got) == sorted([("T", "A", 1.5, 3), ("Q", "A", 1.5, None), ("AM", "B", 1.25, 7)], key=str)


def test_synthetic_and_cached(spark, tmp_path):
    a = tape.synthetic_bars(spark, "X", 50, 100.0, 2.0).collect()
    assert a == tape.synthetic_bars(spark, "X", 50, 100.0, 2.0).collect()
    assert all(r.low <= min(r.open, r.close) and max(r.open, r.close) <= r.high for r in a) and a[7].open == a[6].close
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert [tape.cached(spark, f"{tmp_path}/c", s, make).count() for s in (1000, 1000, -1)] == [3, 3, 3]
    assert len(calls) == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")
    sinks.write_whole(df, f"{tmp_path}/w")
    sinks.write_whole(df.where("k = 1"), f"{tmp_path}/w")
    assert spark.read.parquet(f"{tmp_path}/w").count() == 1 and not (tmp_path / "w.part").exists()
    sinks.write_parquet(df, f"{tmp_path}/p")
    sinks.remove_keys(spark, df.where("k = 2").select("k"), f"{tmp_path}/p", f"{tmp_path}/q")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/q").collect()] == [(1, "a|b")]
    assert sinks.markdown(df) == "| k | v |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |\n"
    sinks.write_report(df, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 2
    sinks.append_journal(df, f"{tmp_path}/j")
    sinks.append_journal(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 4
    sinks.write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 2
    x = VectorAssembler(inputCols=["a"], outputCol="f").transform(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "a double, y double"))
    model = LinearRegression(featuresCol="f", labelCol="y").fit(x)
    sinks.save_model(model, f"{tmp_path}/m")
    sinks.save_model(model, f"{tmp_path}/m")
    assert abs(LinearRegressionModel.load(f"{tmp_path}/m").coefficients[0] - 2) < 1e-6


def test_archive_by_day(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-02 10:00:00' AS ts, 1 AS n UNION ALL SELECT timestamp'2024-01-03 10:00:00', 2").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, n int").json(f"{tmp_path}/in")
    for _ in range(2):  # a second run adds nothing
        sinks.append_by_day(stream, "ts", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out").glob("day=*")) == ["day=2024-01-02", "day=2024-01-03"]
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_other_readers(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("h1,h2,h3\n1,.,x\n2,5,y\n")
    assert [tuple(r) for r in tape.positional_csv(spark, str(tmp_path / "wide.csv"), {"b": 1, "c": 2}).where("c <> 'y'").collect()] == [(None, "x")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text('{"k": 1}\n{"k": 2}\n')
    assert tape.shards(spark, str(tmp_path), "k int").count() == 2
    assert tape.jsonl(spark, str(tmp_path / "d" / "a.json"), "k int").count() == 2
    at = lambda s: f"2024-01-02 00:00:{s:02}"
    a = spark.createDataFrame([("X", at(0), 1.0)], "symbol string, ts string, px double").selectExpr("symbol", "timestamp(ts) AS ts", "px")
    b = spark.createDataFrame([("X", at(50), 2.0), ("Y", at(1), 3.0)], "symbol string, ts string, px double").selectExpr("symbol", "timestamp(ts) AS ts", "px")
    assert {r.symbol: (r.source, r.px) for r in tape.first_fresh([a, b], 10).collect()} == {"X": (1, 2.0), "Y": (1, 3.0)}
    assert {r.symbol: (r.source, r.px) for r in tape.first_fresh([a, b], 60).collect()} == {"X": (0, 1.0), "Y": (1, 3.0)}
