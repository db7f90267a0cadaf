"""Content identities: ids of series, pairs, selections and artifacts that depend on what they hold, not on its order.

A set of texts is named by its count and the sums of two parts of their SHA-256 digests. Sums are
partial aggregates, so that no key's rows are ever listed or sorted, and neither their order nor
their partitions matter. A repeated text counts as often as it is there.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALGORITHM = "1"


def canonical_json(payload: object) -> str:
    """Sorted keys and no blanks, so that equal payloads are equal texts."""
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_row(**fields: Column) -> Column:
    """The same of a row: an object of texts with sorted keys."""
    return F.to_json(F.struct(*(fields[k].cast("string").alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def opaque_id(kind: str, text: Column) -> Column:
    """kind, a hyphen and 24 hexadecimal digits."""
    return F.concat(F.lit(kind + "-"), F.substring(F.sha2(text, 256), 1, 24))


def millionths(x: Column) -> Column:
    """A return as a whole number of millionths, which has one text in every engine."""
    return F.round(x * 1_000_000, 0).cast("long").cast("string")


def set_digest(text: Column) -> Column:
    """An aggregate: the digest of a key's texts."""
    part = lambda k: F.conv(F.substring(F.sha2(text, 256), 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")
    return F.sha2(F.concat_ws(":", F.count(text).cast("string"), *(F.coalesce(F.sum(part(k)), F.lit(0)).cast("string") for k in (0, 1))), 256)


def series_ids(rets: DataFrame) -> DataFrame:
    """listing, n, first_date, last_date and series_id of each listing's returns."""
    text = F.concat_ws("|", F.col("date").cast("string"), millionths(F.col("ret")))
    return rets.groupBy("listing").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), set_digest(text).alias("series_id"))


def alignment_ids(pairs: DataFrame) -> DataFrame:
    """left < right, n and alignment_id of the returns (left, right, date, x, y) on common dates, from whichever side they come."""
    turned = F.col("left") > F.col("right")
    a, b = F.when(turned, F.col("y")).otherwise(F.col("x")), F.when(turned, F.col("x")).otherwise(F.col("y"))
    text = F.concat_ws("|", F.col("date").cast("string"), millionths(a), millionths(b))
    d = pairs.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), text.alias("text"))
    return d.groupBy("left", "right").agg(F.count("*").alias("n"), set_digest(F.col("text")).alias("alignment_id"))


def artifact_ids(alignments: DataFrame, series: DataFrame, policy: str = "2", algorithm: str = ALGORITHM) -> DataFrame:
    """left, right, artifact_id: a pair's result by both series, how they align, the least number of rows and the algorithm.

    A pair of series with equal content has no id: raises when such a row is read.
    """
    of = series.select(F.col("listing"), F.col("series_id"))
    d = alignments.join(of.withColumnsRenamed({"listing": "left", "series_id": "a"}), "left").join(of.withColumnsRenamed({"listing": "right", "series_id": "b"}), "right")
    same = F.when(F.col("a") == F.col("b"), F.raise_error(F.lit("two sides with the same returns"))).otherwise(F.lit(algorithm))
    key = canonical_row(left=F.least("a", "b"), right=F.greatest("a", "b"), alignment=F.col("alignment_id"), policy=F.lit(policy), algorithm=same)
    return d.select("left", "right", opaque_id("bivariate", key).alias("artifact_id"))


def membership_ids(members: DataFrame) -> DataFrame:
    """selection, members and membership_id of (selection, member): blank and repeated members don't count."""
    d = members.select("selection", F.trim(F.col("member").cast("string")).alias("member")).filter("member <> ''").distinct()
    return d.groupBy("selection").agg(F.count("*").alias("members"), opaque_id("members", set_digest(F.col("member"))).alias("membership_id"))
