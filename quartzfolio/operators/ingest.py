"""Raw payloads to rows with one shape: discovery candidates, quotes, request plans, review of a universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import normalized_name
from ..sources.tables import pruned, read_rows, removed, shared_path, upsert, write_rows

#: Fixed: field of a candidate and the payload's key for it, in any case.
CANDIDATE = {"code": "code", "exchange": "exchange", "instrument_type": "type", "country": "country", "currency": "currency", "isin": "isin", "name": "name"}
QUOTE_KEY = ("isin", "exchange", "code", "date")


def stripped(x: Column) -> Column:
    """Text without white space at both ends; missing as empty."""
    return F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def candidates(raw: DataFrame, run: str, query: str, endpoint: str) -> DataFrame:
    """Candidates of a search with all fields as stripped text; keys that the payload lacks are empty."""
    have = {c.lower(): c for c in raw.columns}
    fields = {name: stripped(F.col(f"`{have[key]}`")) if key in have else F.lit("") for name, key in CANDIDATE.items()}
    d = raw.select(*(x.alias(n) for n, x in fields.items()), F.lit(run).alias("search_run_id"), F.lit(query).alias("query"), F.lit(endpoint).alias("source_endpoint"))
    return d.withColumn("normalized_name", normalized_name(F.col("name")))


def normalized_quotes(raw: DataFrame, order: str) -> DataFrame:
    """One row per listing and date, the last by `order`: missing prices are the close, missing volume is 0.

    Of rows with equal `order` the greatest counts, field by field.
    """
    close = F.coalesce(F.col("close"), F.lit(0.0))
    prices = [F.coalesce(c, close).alias(c) for c in ("open", "high", "low")]
    row = F.struct(*prices, close.alias("close"), F.coalesce("adjusted_close", close).alias("adjusted_close"), F.coalesce("volume", F.lit(0)).cast("long").alias("volume"), F.coalesce("currency", F.lit("")).alias("currency"))
    # The last row is kept in the partial aggregate, so that duplicates don't reach the shuffle.
    return raw.groupBy(*QUOTE_KEY).agg(F.max_by(row, F.struct(F.col(order), row)).alias("q")).select(*QUOTE_KEY, "q.*")


PAYLOAD_KEY = ["run_id", "isin", "exchange", "code"]


def parsed_payloads(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and errors of raw answers (run_id, isin, exchange, code, endpoint, payload: a JSON list of objects with date and value).

    Rows: the key, date, value and year. Errors: the key, endpoint, error_type and message; an answer that isn't a list, or
    holds a row without a valid date, has an error and no rows, and the others aren't touched by it.
    """
    shape = "array<struct<date:string,value:double>>"
    p = payloads.withColumn("found", F.from_json("payload", shape))
    day = lambda x: F.try_to_date(x.date, "yyyy-MM-dd")
    bad = F.exists("found", lambda x: F.coalesce(day(x).isNull(), F.lit(True)))
    # from_json answers a list with a broken end by its sound beginning; only a list that ends as one is whole.
    whole = F.coalesce(F.col("payload").rlike(r"(?s)^\s*\[.*\]\s*\z") & F.col("found").isNotNull(), F.lit(False))
    kind = F.when(~whole, "malformed_payload").when(bad, "invalid_date")
    p = p.withColumn("error_type", kind)
    message = F.when(F.col("error_type") == "malformed_payload", "not a JSON list").otherwise(F.concat(F.lit("no date: "), F.coalesce(F.element_at(F.filter("found", lambda x: F.coalesce(day(x).isNull(), F.lit(True))), 1).date, F.lit("null"))))
    errors = p.filter("error_type IS NOT NULL").select(*PAYLOAD_KEY, "endpoint", "error_type", message.alias("message"))
    rows = p.filter("error_type IS NULL").select(*PAYLOAD_KEY, F.explode("found").alias("x")).select(*PAYLOAD_KEY, day(F.col("x")).alias("date"), "x.value")
    return rows.withColumn("year", F.year("date")), errors


def merge_years(rows: DataFrame, path: str) -> None:
    """Upserts rows of `parsed_payloads` into path, by exchange and year: a row of the same listing and date is replaced.

    Only the years that rows have are read and written; of equal keys in rows the greatest run counts.
    """
    spark = rows.sparkSession
    key = ["isin", "exchange", "code", "date"]
    at = ("exchange", "year")
    aside = shared_path(spark, "payloads")
    old = read_rows(spark, path, "run_id string, isin string, code string, date date, value double, exchange string, year int")
    merged = upsert(pruned(old, rows, list(at)), rows.select(old.columns), key, F.struct("run_id", "value"))
    merged.write.parquet(aside)
    write_rows(spark.read.schema(merged.schema).parquet(aside).repartition(*at), path, at)
    removed(spark, aside)


def request_plan(listings: DataFrame, run: str, start: str = "", end: str = "", isin: str | None = None) -> DataFrame:
    """run_id, isin, exchange, code, symbol (CODE.EXCHANGE) and the window of every listing, or those of one ISIN."""
    chosen = listings if isin is None else listings.filter(F.col("isin") == isin)
    return chosen.select(F.lit(run).alias("run_id"), "isin", "exchange", "code", F.concat_ws(".", "code", "exchange").alias("symbol"), F.lit(start).alias("start_date"), F.lit(end).alias("end_date"))


def missing_isin(rows: DataFrame) -> DataFrame:
    return rows.filter(stripped(F.col("isin")) == "")


def review(rows: DataFrame) -> DataFrame:
    """One row: candidates, those without ISIN, distinct ISINs, and which warnings hold."""
    none = stripped(F.col("isin")) == ""
    active = F.lower(F.coalesce("status", F.lit("active"))) == "active"
    d = rows.agg(F.count("*").alias("candidates"), F.count_if(none).alias("missing_isin"), F.countDistinct(F.when(~none, F.col("isin"))).alias("isins"), F.count_if(~active).alias("inactive"))
    return d.select("candidates", "missing_isin", "isins", ((F.col("candidates") > 0) & (F.col("inactive") == 0)).alias("survivorship_warning"), (F.col("missing_isin") > 0).alias("missing_isin_warning"))
