"""Price series, payouts and listing metadata out of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import nearest

#: Returns of the aligned matrix are scaled down, so that compounding stays in a sensible range.
SCALE = 0.01
EXCHANGES = ("XETRA", "LSE", "PA", "AS", "SW")
LEVELS = {"region": "r_name", "nation": "n_name", "supplier": "CAST(s_suppkey AS STRING)"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quotes(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """listing, date, px: the average price of what a region, nation or supplier shipped on a day."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity")
    # Reduced by supplier and day before any dimension is joined.
    daily = lines.groupBy("l_suppkey", "date").agg(F.sum("l_extendedprice").alias("p"), F.sum("l_quantity").alias("n"))
    place = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = place.select("s_suppkey", F.expr(LEVELS[level]).alias("listing"))
    return daily.join(named, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("listing", "date").agg(nearest(F.sum("p") / F.sum("n"), 6).alias("px"))


def customer_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listing (a customer, as in `dividends`), date, px: the average price of what was shipped to them on a day."""
    daily = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("l_extendedprice").alias("p"), F.sum("l_quantity").alias("n"))
    of = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("listing"))
    return daily.join(of, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("listing", "date").agg(nearest(F.sum("p") / F.sum("n"), 6).alias("px"))


def event_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("listing"), F.col("ts").cast("date").alias("date")).agg(nearest(F.avg("value"), 6).alias("px"))


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listing (a customer), date and value: orders read as payouts."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("listing"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("value"))


def all_isins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """isin, exchange, code, name, instrument_type, country, currency: several listings for an ISIN."""
    d = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    at = F.array(*map(F.lit, EXCHANGES))
    return d.select(
        F.concat(F.lit("ISIN"), (F.col("c_custkey") % 50).cast("string")).alias("isin"),
        F.element_at(at, (F.floor(F.col("c_custkey") / 50) % 5 + 1).cast("int")).alias("exchange"),
        F.col("c_name").alias("code"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("instrument_type"), F.col("n_name").alias("country"),
        F.element_at(F.array(*map(F.lit, ("USD", "USD", "EUR", "EUR", "GBP"))), (F.col("n_regionkey") + 1).cast("int")).alias("currency"),
    )
