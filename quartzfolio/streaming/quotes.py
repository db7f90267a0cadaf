"""Quotes as a stream: daily bars with a watermark, and last-wins upserts by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import pruned, read_rows, removed, upsert, write_rows

QUOTE_KEY = ["listing", "date"]
SCHEMA = "listing string, date date, px double, seq long"


def daily_bars(events: DataFrame, late: str = "2 days") -> DataFrame:
    """listing, date, open, high, low, close, n of a stream (listing, ts, value); late rows beyond the watermark are dropped."""
    d = events.withWatermark("ts", late).groupBy("listing", F.window("ts", "1 day"))
    bars = d.agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("n"))
    return bars.select("listing", F.col("window.start").cast("date").alias("date"), "open", "high", "low", "close", "n")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """What `merge_into` has merged so far."""
    return read_rows(spark, f"{path}/rows", f"{SCHEMA}, month string").drop("month")


def merge_into(spark: SparkSession, path: str):
    """For foreachBatch: the batch's last row of a key wins over the stored one.

    The store has a partition for each month. A batch reads and replaces those it has rows of, so that its cost doesn't
    grow with the store and no versions pile up. They are merged aside first; a batch that is run again has the same result.
    """

    def run(batch: DataFrame, number: int) -> None:
        aside = f"{path}/_aside/{number}"
        new = upsert(batch.limit(0), batch, QUOTE_KEY, F.col("seq")).withColumn("month", F.date_format("date", "yyyy-MM"))
        old = read_rows(spark, f"{path}/rows", f"{SCHEMA}, month string")
        merged = upsert(pruned(old, new, ["month"]), new, QUOTE_KEY)
        merged.write.mode("overwrite").parquet(aside)
        write_rows(spark.read.schema(merged.schema).parquet(aside).repartition("month"), f"{path}/rows", ("month",))
        removed(spark, aside)

    return run
