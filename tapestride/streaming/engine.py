"""Structured Streaming: windowed bars, late replacements, count-based bars with state, order books."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICKS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def tick_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", files_per_batch: int = 1) -> DataFrame:
    s = spark.readStream.schema(TICKS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return s.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"),
        F.col("value").alias("px"), F.get_json_object("props", "$.k").cast("long").alias("size"))


def window_bars(ticks: DataFrame, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Bars of event-time windows, each given out once the watermark has passed its end; later ticks are dropped."""
    at = F.struct("ts", "id")
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return ticks.withWatermark("ts", delay).groupBy("symbol", w.alias("w")).agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"),
        F.sum("size").alias("volume"), F.count("*").alias("n_ticks"),
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "n_ticks")


def deduplicated(ticks: DataFrame, delay: str) -> DataFrame:
    """Each id once, as long as its copies come within the delay."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def count_bars(ticks: DataFrame, k: int) -> DataFrame:
    """A bar for every k ticks of a symbol, in order of arrival; an unfinished bar waits in the symbol's state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    out = "symbol string, bar long, open double, high double, low double, close double, volume long"

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bar, n, o, h, lo, v = state.get if state.exists else (0, 0, 0.0, 0.0, 0.0, 0)
        rows = []
        ticks = pd.concat(list(parts)).sort_values(["ts", "id"])
        for px, size in zip(ticks["px"], ticks["size"]):
            o, h, lo = (px, px, px) if not n else (o, max(h, px), min(lo, px))
            n, v = n + 1, v + int(size)
            if n == k:
                rows.append((key[0], bar, o, h, lo, px, v))
                bar, n, v = bar + 1, 0, 0
        state.update((bar, n, float(o), float(h), float(lo), v))
        yield pd.DataFrame(rows, columns=["symbol", "bar", "open", "high", "low", "close", "volume"])

    return ticks.groupBy("symbol").applyInPandasWithState(run, out, "bar long, n long, o double, h double, l double, v long", "append",
        GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, folder: str, name: str | None = None) -> DataFrame:
    """Runs the stream over all input there is, into Parquet files under folder.

    A run of the same name goes on from the checkpoint that the one before left; without a name a run is its own."""
    at = f"{folder}/stream-{name or uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation",
        f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def replaced(bars: DataFrame, official: DataFrame) -> DataFrame:
    """Bars of which an official late one takes the place of the built one; repeated replacement changes nothing."""
    both = bars.withColumn("_p", F.lit(1)).unionByName(official.withColumn("_p", F.lit(0)))
    cols = [c for c in bars.columns if c not in ("symbol", "ts")]
    return both.groupBy("symbol", "ts").agg(F.min_by(F.struct(*cols), "_p").alias("_b")).select("symbol", "ts", "_b.*")


def order_book(messages: DataFrame, every: int) -> DataFrame:
    """Best bid and ask after every `every` messages of a book: (file, locate, seq, bid, bid_size, ask, ask_size).

    A book is sequential by nature; books (a locate of a file, as codes are dealt anew each day) are spread, and a book's
    orders are all the state there is. Executions at another price (C) take size like any other; a directory message (R)
    is none of the book's."""
    import pandas as pd

    ddl = "file string, locate bigint, seq bigint, bid double, bid_size bigint, ask double, ask_size bigint"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        orders, levels, rows = {}, {"B": {}, "S": {}}, []

        def change(side, px, size):
            level = levels[side]
            level[px] = level.get(px, 0) + size
            if level[px] <= 0:
                del level[px]

        pdf = pdf.sort_values("seq")
        for n, m in enumerate(pdf.itertuples(index=False), 1):
            if m.kind in "AF":
                orders[m.ref] = [m.side, m.price, int(m.shares)]
                change(m.side, m.price, int(m.shares))
            elif m.ref in orders:
                side, px, left = orders[m.ref]
                gone = left if m.kind in "DU" else min(left, int(m.shares))
                change(side, px, -gone)
                orders[m.ref][2] -= gone
                if not orders[m.ref][2]:
                    del orders[m.ref]
                if m.kind == "U":
                    orders[m.new_ref] = [side, m.price, int(m.shares)]
                    change(side, m.price, int(m.shares))
            if n % every == 0:
                bid, ask = max(levels["B"], default=None), min(levels["S"], default=None)
                rows.append((m.file, m.locate, m.seq, bid, levels["B"].get(bid), ask, levels["S"].get(ask)))
        return pd.DataFrame(rows, columns=["file", "locate", "seq", "bid", "bid_size", "ask", "ask_size"]).astype({"bid_size": "Int64",
            "ask_size": "Int64"})

    return messages.where("kind <> 'R'").groupBy("file", "locate").applyInPandas(run, ddl)


def strategy(ticks: DataFrame, n: int, dip: float, target: float, stop: float, cooldown: int, day_loss: float, hours: int = 2) -> DataFrame:
    """Trades of a strategy that lives in the stream, a row when one is closed.

    Per symbol: a ring of the last n prices; a long entry where the price is `dip` below the ring's mean; exit at target,
    stop or the session's end; `cooldown` ticks of rest after an exit; no entry for the rest of a session that has lost
    `day_loss`. Sessions begin `hours` before midnight UTC and start afresh, ring and all. The state is a symbol's ring
    and a few numbers; ticks are taken in order of (ts, id) within a batch."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    out = "symbol string, session date, entry_id long, exit_id long, entry_px double, exit_px double, why string"
    kept = "session string, ring string, entry_id long, entry_px double, rest long, pnl double, last_id long, last_px double"

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, ring, entry_id, entry_px, rest, pnl, last_id, last_px = state.get if state.exists else ("", "", -1, 0.0, 0, 0.0, -1, 0.0)
        prices, rows = [float(x) for x in ring.split()], []
        t = pd.concat(list(parts)).sort_values(["ts", "id"])
        for ts, tid, px in zip(t["ts"], t["id"], t["px"]):
            now = str((ts + pd.Timedelta(hours=hours)).date())
            if now != session:
                if entry_id >= 0:
                    rows.append((key[0], session, entry_id, last_id, entry_px, last_px, "session"))
                session, prices, entry_id, rest, pnl = now, [], -1, 0, 0.0
            if entry_id >= 0:
                why = "stop" if px <= entry_px - stop else "target" if px >= entry_px + target else None
                if why:
                    rows.append((key[0], session, entry_id, int(tid), entry_px, float(px), why))
                    entry_id, rest, pnl = -1, cooldown, pnl + px - entry_px
            elif rest > 0:
                rest -= 1
            elif len(prices) == n and px <= sum(prices) / n - dip and pnl > -day_loss:
                entry_id, entry_px = int(tid), float(px)
            prices = [*prices, float(px)][-n:]
            last_id, last_px = int(tid), float(px)
        state.update((session, " ".join(map(repr, prices)), entry_id, entry_px, rest, float(pnl), last_id, last_px))
        frame = pd.DataFrame(rows, columns=["symbol", "session", "entry_id", "exit_id", "entry_px", "exit_px", "why"])
        frame["session"] = pd.to_datetime(frame["session"]).dt.date
        yield frame

    return ticks.groupBy("symbol").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout)


def closest_quotes(left: DataFrame, right: DataFrame, key: str, width: str, delay: str) -> DataFrame:
    """Pairs of two streams' rows (key, ts, px) of one key and one time cell, with the difference of their prices.

    Both sides carry a watermark, so a cell's rows leave the state once it is over."""
    cell = lambda df, side: df.withWatermark("ts", delay).select(F.col(key).alias(f"{side}_{key}"),
        F.window("ts", width).alias(f"{side}_w"), F.col("id").alias(f"{side}_id"), F.col("px").alias(f"{side}_px"))
    a, b = cell(left, "a"), cell(right, "b")
    j = a.join(b, (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col("a_w") == F.col("b_w")))
    return j.select(F.col(f"a_{key}").alias(key), F.col("a_w.start").alias("ts"), "a_id", "b_id",
        (F.col("a_px") - F.col("b_px")).alias("gap"))
