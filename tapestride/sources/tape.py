"""Readers. Every reader declares its schema; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick tape (symbol, ts, id, px, size) of the events table; columns and filters reach the scan."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value", "props")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("id"), F.col("value").alias("px"),
        F.get_json_object("props", "$.k").cast("long").alias("size"))


def contract_minutes(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon files without header, `yyyyMMdd HHmmss;open;high;low;close;volume`, one contract each."""
    ddl = "stamp string, open double, high double, low double, close double, volume double"
    raw = spark.read.schema(ddl).option("sep", ";").csv(path)
    contract = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)*$", 1)
    return raw.select(contract.alias("symbol"), F.try_to_timestamp("stamp", F.lit("yyyyMMdd HHmmss")).alias("ts"), "open", "high", "low",
        "close", "volume").where("ts IS NOT NULL")


def bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars with a header; the last of rows with one time stays, by file name, then by place in the file."""
    raw = spark.read.schema("ts timestamp, open double, high double, low double, close double, volume double").option("header",
        True).csv(path)
    at = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    value = F.struct("open", "high", "low", "close", "volume")
    return raw.select("ts", value.alias("b"), at.alias("at")).groupBy("ts").agg(F.max_by("b", "at").alias("b")).select("ts", "b.*")


def preamble_csv(spark: SparkSession, path: str, date_col: str, columns: list[str]) -> DataFrame:
    """CSV files whose header stands below free text: the first line that begins with the date column's name.

    Lines before it don't parse as a date and fall out, so files still split. The named columns are wanted in the
    header's order."""
    text = spark.read.text(path)
    parts = F.split("value", r"\s*,\s*")
    head = text.where(F.lower(F.split_part("value", F.lit(","), F.lit(1))) == date_col.lower()).limit(1).first()
    if head is None:
        raise ValueError(f"no header with {date_col} in {path}")
    names = [c.strip().lower() for c in head[0].split(",")]
    day = F.coalesce(*(F.try_to_timestamp(F.get(parts, 0), F.lit(f)) for f in ("yyyy-MM-dd", "M/d/yyyy")))
    value = lambda c: F.get(parts, names.index(c.lower())).try_cast("double").alias(c)
    return text.select(day.cast("date").alias(date_col), *map(value, columns)).where(F.col(date_col).isNotNull())


def positional_csv(spark: SparkSession, path: str, places: dict[str, int], missing: str = ".") -> DataFrame:
    """Wide files by position; `.` is a missing value."""
    n = max(places.values()) + 1
    raw = spark.read.schema(", ".join(f"_c{k} string" for k in range(n))).option("header", True).option("enforceSchema", True).csv(path)
    return raw.select(*(F.nullif(F.trim(F.col(f"_c{k}")), F.lit(missing)).alias(name) for name, k in places.items()))


def inline_table(spark: SparkSession, text: str, columns: list[str], year: int) -> DataFrame:
    """A literal `MM-dd|a|b` table, newest first, beginning in `year`: a month larger than the one above it belongs
    to the year before. The first column becomes a date, the others doubles. The literal is of a page's size."""
    out, before = [], 12
    for line in text.strip().splitlines():
        day, *rest = (x.strip() for x in line.split("|"))
        month = int(day.split("-")[0])
        year -= month > before
        before = month
        out.append((f"{year}-{day}", *rest))
    df = spark.createDataFrame(out, T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return df.select(F.col(columns[0]).try_cast("date").alias(columns[0]), *(F.col(c).try_cast("double").alias(c) for c in columns[1:]))


def jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("mode", "PERMISSIVE").json(path)


def shards(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Compressed JSON shards in nested folders."""
    return spark.read.schema(ddl).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(path)


def calendar_xml(spark: SparkSession, path: str) -> DataFrame:
    """Economic calendar: title, country, ts (UTC), impact, forecast, previous."""
    ddl = "title string, country string, date string, time string, impact string, forecast string, previous string"
    raw = spark.read.format("xml").option("rowTag", "event").schema(ddl).load(path)
    stamp = F.try_to_timestamp(F.concat_ws(" ", "date", F.lower("time")), F.lit("MM-dd-yyyy h:mma"))
    return raw.select("title", "country", F.to_utc_timestamp(stamp, "America/New_York").alias("ts"), "impact", "forecast", "previous")


def option_chain(df: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Adds root, expiry, cp and strike, as an OCC option symbol holds them."""
    part = lambda k: F.regexp_extract(ticker, r"^(?:O:)?([A-Z]{1,6})(\d{6})([CP])(\d{8})$", k)
    return df.withColumns({"root": part(1), "expiry": F.try_to_timestamp(part(2), F.lit("yyMMdd")).cast("date"), "cp": part(3),
        "strike": part(4).try_cast("double") / 1000}).where("root <> ''")


#: Layout of the order messages read here: type, struct format after the 11-byte head, fields.
ITCH = {"A": (">Qc I8sI", ("ref", "side", "shares", "stock", "price")), "E": (">QIQ", ("ref", "shares", "match")),
    "X": (">QI", ("ref", "shares")), "D": (">Q", ("ref",)), "U": (">QQII", ("ref", "new_ref", "shares", "price")),
    "C": (">QIQcI", ("ref", "shares", "match", "printable", "price")), "R": (">8s", ("stock",))}


def itch_messages(spark: SparkSession, path: str) -> DataFrame:
    """Order messages of length-prefixed binary files: (file, seq, kind, locate, ns, ref, new_ref, side, shares, stock, price).

    R names a locate's stock, C is an execution at another price. Files may be gzipped. Each is read whole, one row each,
    as the format has no split points, so a file is of 2 GB at most; a day's files are many."""
    from collections.abc import Iterator

    import pyarrow as pa

    ddl = "file string, seq bigint, kind string, locate bigint, ns bigint, ref bigint, new_ref bigint, side string, shares bigint, stock string, price double"
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import struct

        formats = {k: (struct.Struct(f.replace(" ", "")), fields) for k, (f, fields) in ITCH.items()}
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, at, seq, rows = data.as_py(), 0, 0, []
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                while at + 2 <= len(data):
                    size = int.from_bytes(data[at : at + 2], "big")
                    message, at = data[at + 2 : at + 2 + size], at + 2 + size
                    kind = chr(message[0]) if message else ""
                    layout = formats.get("A" if kind == "F" else kind)
                    if layout and len(message) >= 11 + layout[0].size:
                        got = dict(zip(layout[1], layout[0].unpack_from(message, 11)))
                        text = {k: v.decode().strip() for k, v in got.items() if isinstance(v, bytes)}
                        rows.append({"file": file, "seq": seq, "kind": kind, "locate": int.from_bytes(message[1:3], "big"),
                            "ns": int.from_bytes(message[5:11],
                            "big")} | got | text | ({"price": got["price"] / 1e4} if "price" in got else {}))
                    seq += 1
                    if len(rows) >= 50_000:
                        yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=schema)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ddl)


def first_fresh(prices: list[DataFrame], stale_seconds: int) -> DataFrame:
    """Per symbol the price of the first source, in the list's order, that is not older than the newest by more."""
    every = None
    for k, p in enumerate(prices):
        p = p.select("symbol", "ts", "px", F.lit(k).alias("source"))
        every = p if every is None else every.unionByName(p)
    last = every.groupBy("symbol", "source").agg(F.max(F.struct("ts", "px")).alias("x"))
    newest = last.groupBy("symbol").agg(F.max("x.ts").alias("newest"))
    fresh = last.join(newest, "symbol").where(F.col("newest").cast("timestamp").cast("double") - F.col("x.ts").cast("timestamp").cast("double") <= stale_seconds)
    return fresh.groupBy("symbol").agg(F.min_by(F.struct("source", "x.ts", "x.px"), "source").alias("y")).select("symbol", "y.*")


#: The places of a tick file's time, `yyyyMMdd HHmmss fffffff` (100 ns), in its first 23 characters.
TICK_TIME = {"date": (1, 8), "clock": (10, 6), "part": (17, 7)}


def tick_files(spark: SparkSession, path: str) -> DataFrame:
    """Quoted ticks, `time;price;bid;ask;volume` without a header, the time of fixed width: (symbol, ts, ns, px, bid, ask, size).

    Files are split by Spark like any text. Rows whose time doesn't parse fall out; a one-sided quote has a null side."""
    raw = spark.read.schema("stamp string, px double, bid double, ask double, size bigint").option("sep", ";").csv(path)
    part = lambda n: F.substring("stamp", *TICK_TIME[n])
    second = F.try_to_timestamp(F.concat(part("date"), part("clock")), F.lit("yyyyMMddHHmmss"))
    symbol = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)*$", 1)
    t = raw.select(symbol.alias("symbol"), second.alias("second"), part("part").try_cast("bigint").alias("part"), "px",
        *(F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ("bid", "ask")), "size")
    t = t.where("second IS NOT NULL AND part IS NOT NULL")
    ns = F.unix_seconds("second") * 1_000_000_000 + F.col("part") * 100
    return t.select("symbol", F.timestamp_micros(F.floor(ns / 1000)).alias("ts"), ns.alias("ns"), "px", "bid", "ask", "size")


def aggregate_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers of an aggregates service, {"ticker", "results": [{t, o, h, l, c, v}]}, t in milliseconds: bars."""
    ddl = "ticker string, results array<struct<t bigint, o double, h double, l double, c double, v double>>"
    raw = spark.read.schema(ddl).option("multiLine", True).json(path)
    x = raw.select(F.col("ticker").alias("symbol"), F.explode("results").alias("x"))
    return x.select("symbol", F.timestamp_millis("x.t").alias("ts"),
        *(F.col(f"x.{a}").alias(n) for a, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))))


def filings(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds of filings: (title, updated, form); the form is what stands before the first dash of the title."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema("title string, updated string").load(path)
    return raw.select("title", F.try_to_timestamp("updated").alias("updated"),
        F.trim(F.split_part("title", F.lit("-"), F.lit(1))).alias("form"))


def binary_rows(spark: SparkSession, path: str, ddl: str, parse) -> DataFrame:
    """Rows of (file, content) files that have no split points, by parse(name, bytes) -> iterable of dicts; a file is of 2 GB at most."""
    from collections.abc import Iterator

    import pandas as pd

    names = [f.split()[0] for f in ddl.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                rows = list(parse(name.rsplit("/", 1)[-1], bytes(data)))
                yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ddl)


def hourly_ticks(spark: SparkSession, path: str, scale: float) -> DataFrame:
    """LZMA files of an hour's quotes, named SYMBOL_yyyyMMddHH, 20-byte records (ms, ask, bid, ask size, bid size): symbol, ms since the epoch, bid, ask."""

    def parse(name: str, data: bytes):
        import datetime as dt
        import lzma
        import struct

        symbol, hour = name.split(".")[0].rsplit("_", 1)
        start = int(dt.datetime.strptime(hour, "%Y%m%d%H").replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        for ms, ask, bid, ask_size, bid_size in struct.iter_unpack(">IIIff", lzma.decompress(data) if data else b""):
            yield {"symbol": symbol, "ms": start + ms, "bid": bid / scale, "ask": ask / scale, "bid_size": float(bid_size),
                "ask_size": float(ask_size)}

    return binary_rows(spark, path, "symbol string, ms bigint, bid double, ask double, bid_size double, ask_size double", parse)


def sqlite_table(spark: SparkSession, path: str, table: str, ddl: str) -> DataFrame:
    """A table of landed SQLite files: the columns of ddl."""
    names = [f.split()[0] for f in ddl.split(", ")]
    if not all(n.replace("_", "").isalnum() for n in [table, *names]):
        raise ValueError("names are letters, digits and underscores")

    def parse(name: str, data: bytes):
        import sqlite3

        con = sqlite3.connect(":memory:")
        con.deserialize(data)
        for row in con.execute(f"SELECT {', '.join(names)} FROM {table}"):
            yield dict(zip(names, row))

    return binary_rows(spark, path, ddl, parse)


def excel_sheet(spark: SparkSession, path: str, columns: list[str], skip: int = 1) -> DataFrame:
    """The first sheet of landed workbooks: `columns` from left to right as strings, below `skip` rows; empty cells are null."""

    def parse(name: str, data: bytes):
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        with zipfile.ZipFile(io.BytesIO(data)) as book:
            shared = []
            if "xl/sharedStrings.xml" in book.namelist():
                shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
            sheet = ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml"))
        for row in list(sheet.iter(f"{ns}row"))[skip:]:
            out = {}
            for c in row.iter(f"{ns}c"):
                at = 0
                for letter in re.match("[A-Z]+", c.get("r"))[0]:
                    at = at * 26 + ord(letter) - 64
                v = c.find(f"{ns}v")
                text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                if at <= len(columns) and text not in (None, ""):
                    out[columns[at - 1]] = text
            yield out

    return binary_rows(spark, path, ", ".join(f"{c} string" for c in columns), parse)


def array_shards(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Arrays of one length in landed npz shards, as rows of doubles beside their shard's name."""

    def parse(name: str, data: bytes):
        import io

        import numpy as np

        with np.load(io.BytesIO(data)) as z:
            for row in zip(*(z[n].tolist() for n in names)):
                yield {"shard": name} | dict(zip(names, map(float, row)))

    return binary_rows(spark, path, "shard string, " + ", ".join(f"{n} double" for n in names), parse)


def socket_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Trade (T), quote (Q) and aggregate (A, AM) events of JSON arrays, one array a line; works on streams as on tables."""
    ddl = "array<struct<ev string, sym string, t bigint, p double, s bigint, bp double, ap double, o double, h double, l double, c double, v double>>"
    x = lines.select(F.explode(F.from_json(value, ddl)).alias("x")).where("x.ev IN ('T', 'Q', 'A', 'AM')")
    return x.select(F.col("x.ev").alias("kind"), F.col("x.sym").alias("symbol"), F.timestamp_millis("x.t").alias("ts"),
        F.coalesce("x.p", "x.c", (F.col("x.bp") + F.col("x.ap")) / 2).alias("px"),
        F.coalesce("x.s", F.col("x.v").cast("bigint")).alias("size"), F.col("x.bp").alias("bid"), F.col("x.ap").alias("ask"))


def synthetic_bars(spark: SparkSession, symbol: str, n: int, start: float, step: float, seed: str = "bars") -> DataFrame:
    """n hourly bars of a random walk whose steps are hashes, the same on every run: what stands in where no data could be had."""
    from pyspark.sql import Window

    from ..operators.validate import draw

    r = spark.range(1, n + 1).withColumnRenamed("id", "bar_id")
    u = lambda k: draw(F.lit(seed), F.lit(k), F.lit(symbol), F.col("bar_id").cast("string"))
    r = r.withColumns({"_m": (u("move") - 0.5) * 2 * step, "_a": u("up") * step, "_b": u("down") * step})
    w = Window.partitionBy(F.lit(symbol)).orderBy("bar_id")
    r = r.withColumn("close", start + F.sum("_m").over(w)).withColumn("open", F.col("close") - F.col("_m"))
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("bar_id") * 3600).cast("timestamp_ntz")
    return r.select(F.lit(symbol).alias("symbol"), ts.alias("ts"), F.col("bar_id").cast("int").alias("bar_id"), "open",
        (F.greatest("open", "close") + F.col("_a")).alias("high"), (F.least("open", "close") - F.col("_b")).alias("low"), "close",
        F.lit(1).cast("long").alias("volume"))


def cached(spark: SparkSession, path: str, seconds: float, make) -> DataFrame:
    """The table stored at path, made anew by make() and stored if it isn't there or older than `seconds`."""
    import time

    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(there) or time.time() - fs.getFileStatus(there).getModificationTime() / 1000 > seconds:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
