"""Sinks: compressed files, journals, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def append_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by order; ties are decided by the order's later columns."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(spark: SparkSession, new: DataFrame, path: str, to: str, keys: list[str]) -> None:
    """The table at path with new rows in place of those with their keys, written to another path."""
    old = spark.read.parquet(path)
    old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new).write.mode("overwrite").parquet(to)


def remove_keys(spark: SparkSession, keys: DataFrame, path: str, to: str) -> None:
    """The table at path without the rows of the given keys, written to another path."""
    spark.read.parquet(path).join(keys.distinct(), keys.columns, "left_anti").write.mode("overwrite").parquet(to)


def write_whole(df: DataFrame, path: str) -> None:
    """Parquet that readers see whole or not at all: written beside the path, then renamed to it."""
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    part, there = fs_path(f"{path}.part"), fs_path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.part")
    fs.delete(there, True)
    if not fs.rename(part, there):
        raise OSError(f"{path}.part could not be renamed")


def write_report(df: DataFrame, path: str) -> None:
    """A report's rows as JSON lines in one file; reports are aggregates."""
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """The first `most` rows of a report as a Markdown table."""
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(head + ["| " + " | ".join(map(cell, r)) + " |" for r in df.limit(most).collect()]) + "\n"


def append_by_day(stream: DataFrame, at: str, path: str, checkpoint: str):
    """Archives a stream of events as JSON lines in a folder for each day; takes what there is, then stops."""
    days = stream.withColumn("day", F.to_date(at))
    return days.writeStream.format("json").partitionBy("day").option("path", path).option("checkpointLocation",
        checkpoint).trigger(availableNow=True).start()


def save_model(model, path: str) -> None:
    """A fitted ml model, over an earlier one if there is one."""
    model.write().overwrite().save(path)
