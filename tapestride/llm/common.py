"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is named (tests on one machine), a folder of our own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if there:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(there)
        return there
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tapestride-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and reread from the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate data, wherever it is stored; nothing once the session has ended."""
    if spark.sparkContext._jsc is None:
        return
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def text_of(col: str | Column) -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def strip_ws(col: Column) -> Column:
    return F.translate(col, WS_CHARS, "")


def field_ddl(df: DataFrame, col: str, name: str | None = None) -> str:
    return f"`{name or col}` {df.schema[col].dataType.simpleString()}"


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Equal for rows of one id (null ids too) and one text; ordered by id, null ids last, then by the text's digest."""
    return F.struct(docs[id_col].isNull().alias("none"), docs[id_col].alias("id"), F.unhex(F.sha2(text_of(docs[text_col]), 256)).alias("sha"))


def one_of_each(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """Of the rows whose key is not in gone's only column, one per key, with all columns; join and window share a shuffle."""
    gone = gone.toDF("_gone")
    left = docs.withColumn("_row", key).join(gone, F.col("_row") == F.col("_gone"), "left_anti")
    return left.withColumn("_nth", F.row_number().over(Window.partitionBy("_row").orderBy("_row"))).where("_nth = 1").drop("_row", "_nth")


def key_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole groups and their bounds, of batches sorted by their first column; a group may span batches."""
    import numpy as np

    held: list[pa.RecordBatch] = []

    def bounds(part: pa.Table) -> list[tuple[int, int]]:
        key = part.column(0).to_numpy()
        ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
        return list(zip([0, *ends[:-1].tolist()], ends.tolist()))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if batch.column(0)[0] == batch.column(0)[-1] == held[0].column(0)[-1]:
            continue
        part = pa.Table.from_batches(held)
        key = part.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))
        whole = part.slice(0, last)
        yield whole, bounds(whole)
        held = part.slice(last).to_batches()
    if held:
        part = pa.Table.from_batches(held)
        yield part, bounds(part)


Query = Callable[[SparkSession, str], DataFrame]
