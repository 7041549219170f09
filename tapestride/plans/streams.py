"""Queries that run a stream over all of its input."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..streaming import engine
from .catalog import TAPE, query


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is named, one of our own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tapestride-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


@query(f"""WITH {TAPE}, b AS (SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, arg_min(px, (ts, id)) AS open, max(px) AS high, min(px) AS low,
 arg_max(px, (ts, id)) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS n_ticks FROM tape GROUP BY 1, 2)
SELECT * FROM b WHERE ts + INTERVAL 15 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM tape)""")
def stream_window_bars(spark, sf):
    s = engine.run_to_end(engine.window_bars(engine.tick_stream(spark, sf), "15 minutes", "10 minutes"), folder(spark))
    return s.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""WITH {TAPE}, n AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, id) - 1) // 25 AS bar FROM tape) SELECT symbol,
 CAST(bar AS BIGINT) AS bar, arg_min(px, (ts, id)) AS open, max(px) AS high, min(px) AS low, arg_max(px, (ts, id)) AS close,
 CAST(sum(size) AS BIGINT) AS volume FROM n GROUP BY 1, 2 HAVING count(*) = 25""")
def stream_count_bars(spark, sf):
    return engine.run_to_end(engine.count_bars(engine.tick_stream(spark, sf), 25), folder(spark))


@query()
def stream_strategy(spark, sf):
    """A strategy with ring, sessions, cooldown and breaker in the stream's state."""
    return engine.run_to_end(engine.strategy(engine.tick_stream(spark, sf), 5, 10.0, 15.0, 12.0, 3, 60.0), folder(spark))


@query(f"""WITH {TAPE}, b AS (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) AS w FROM tape) SELECT time_bucket(INTERVAL 10 MINUTE, x.ts) AS ts, x.id AS a_id,
 y.id AS b_id, round(x.px - y.px, 6) AS gap FROM b x JOIN b y ON x.w = y.w AND x.symbol = 'click' AND y.symbol = 'view'""")
def stream_price_gaps(spark, sf):
    """Two streams of ticks joined by time cell, the difference of their prices."""
    one = lambda kind: engine.tick_stream(spark, sf).where(F.col("symbol") == kind).withColumn("pair", F.lit("click-view"))
    s = engine.run_to_end(engine.closest_quotes(one("click"), one("view"), "pair", "10 minutes", "1 hour"), folder(spark))
    return s.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "a_id", "b_id", F.round("gap", 6).alias("gap"))
