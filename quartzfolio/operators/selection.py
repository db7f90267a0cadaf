"""Predicates, selections, canonical listings, pages."""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import normalized_name

#: Fixed: the operators of a predicate.
OPERATORS = (">=", "<=", "!=", "=", ">", "<", "~")
LISTING = ["isin", "exchange", "code"]
PAGE_LIMIT = 200


def parse(predicate: str) -> tuple[str, str, str]:
    m = re.fullmatch(r"\s*(\w+)\s*(>=|<=|!=|=|>|<|~)\s*(.*?)\s*", predicate)
    if not m or not m[3]:
        raise ValueError(f"not a predicate: {predicate!r}")
    return m[1], m[2], m[3]


def condition(predicate: str, columns: list[str]) -> Column:
    """A missing value never matches; `=` and `!=` compare text, `~` searches it, others compare numbers."""
    field, op, value = parse(predicate)
    if field not in columns:
        raise ValueError(f"unknown field: {field}")
    x = F.col(field)
    if op == "~":
        out = F.contains(normalized_name(x.cast("string")), normalized_name(F.lit(value)))
    elif op in ("=", "!="):
        out = (x.cast("string") == value) if op == "=" else (x.cast("string") != value)
    else:
        n = x.cast("double")
        out = {">=": n >= float(value), "<=": n <= float(value), ">": n > float(value), "<": n < float(value)}[op]
    return F.coalesce(out, F.lit(False))


def matching(df: DataFrame, predicates: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, (condition(p, df.columns) for p in predicates), F.lit(True)))


def _slug(text: str) -> str:
    return re.sub("[^a-z0-9]+", "_", text.casefold()).strip("_") or "selection"


def selection_id(name: str | None, predicates: list[str], module: str = "metadata") -> str:
    """A readable name and a digest of module, name and predicates in their order.

    Fixed format: the digest is over compact JSON with sorted keys, of which 12 digits count.
    """
    texts = ["".join(parse(p)) for p in predicates]
    held = json.dumps({"module": module, "name": name or "", "predicates": texts}, sort_keys=True, separators=(",", ":"))
    shown = name or "_".join(map(_slug, texts)) or "all"
    return f"{_slug(shown)}-{hashlib.sha256(held.encode()).hexdigest()[:12]}"


def with_valid_isin(df: DataFrame) -> DataFrame:
    return df.filter(~F.lower(F.trim(F.coalesce("isin", F.lit("")))).isin("", "none", "null"))


def canonical(listings: DataFrame) -> DataFrame:
    """One listing for an ISIN: the home exchange first, then exchange and code; with the reason."""
    home = F.col("exchange") == "XETRA"
    w = Window.partitionBy("isin").orderBy(F.when(home, 0).otherwise(1), "exchange", "code")
    return with_valid_isin(listings).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").withColumn("reason", F.when(home, "preferred_exchange").otherwise("first_by_exchange_and_code"))


def one_per_exchange(listings: DataFrame) -> DataFrame:
    w = Window.partitionBy("isin", "exchange").orderBy("code")
    return listings.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def options(df: DataFrame, fields: list[str]) -> DataFrame:
    """field and value: the distinct non-blank values of each field."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("o")
    return df.select(pairs).select("o.field", "o.value").filter("trim(value) <> ''").distinct()


def page(df: DataFrame, order: list[str], offset: int = 0, limit: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), PAGE_LIMIT))


def validated_universe(df: DataFrame, required: list[str]) -> DataFrame:
    """df; raises where a required field is blank or an ISIN repeats."""
    blank = reduce(lambda a, b: a | b, (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in required))
    if not df.filter(blank).isEmpty():
        raise ValueError("a required field is blank")
    if not df.groupBy("isin").count().filter("count > 1").isEmpty():
        raise ValueError("an ISIN repeats")
    return df


def in_ranges(df: DataFrame, ranges: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """Rows that lie, for each metric with ranges, in any of its closed ranges; a missing value never does."""
    for metric, some in ranges.items():
        if some:
            df = df.filter(F.coalesce(reduce(lambda a, b: a | b, (F.col(metric).between(lo, hi) for lo, hi in some)), F.lit(False)))
    return df
