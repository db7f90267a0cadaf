"""What a portfolio's weights have to satisfy, as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import portfolio

#: Weights may miss their sum by so much.
TOLERANCE = 1e-9
#: Fixed: the words for what is violated.
SUM, NEGATIVE, BELOW, ABOVE, MISSING, UNKNOWN = "weights_do_not_sum_to_one", "negative_weight", "below_min_weight", "above_max_weight", "missing_weight", "unknown_listing"


@dataclass(frozen=True)
class Limits:
    """Bounds of a weight and the share of dates a listing needs a quote on."""

    long_only: bool = True
    min_weight: float = 0.0
    max_weight: float = 0.2
    min_coverage: float = 0.95

    def __post_init__(self) -> None:
        if self.min_weight < 0 or self.max_weight <= 0 or self.min_weight > self.max_weight:
            raise ValueError("weights need 0 <= min_weight <= max_weight, and a max_weight above 0")
        if not 0 < self.min_coverage <= 1:
            raise ValueError("min_coverage is above 0 and at most 1")


def violations(weights: DataFrame, limits: Limits) -> DataFrame:
    """portfolio, listing ('' for the sum) and violation of every rule that weights (portfolio, listing, weight) break."""
    x = F.col("weight")
    broken = F.array_compact(F.array(F.when((x < 0) & F.lit(limits.long_only), NEGATIVE), F.when(x < limits.min_weight, BELOW), F.when(x > limits.max_weight, ABOVE)))
    rows = weights.select("portfolio", "listing", F.explode(broken).alias("violation"))
    total = weights.groupBy("portfolio").agg(F.sum("weight").alias("s")).filter(F.abs(F.col("s") - 1) > TOLERANCE)
    return rows.unionByName(total.select("portfolio", F.lit("").alias("listing"), F.lit(SUM).alias("violation")))


def mismatches(listings: DataFrame, weights: DataFrame) -> DataFrame:
    """portfolio, listing, violation: listings without a weight and weights without a listing (an outer join of both keys).

    listings has the listings of each portfolio's matrix (portfolio, listing).
    """
    a = listings.select("portfolio", "listing").distinct().withColumn("there", F.lit(True))
    d = a.join(weights.select("portfolio", "listing", F.lit(True).alias("weighted")), ["portfolio", "listing"], "full")
    kind = F.when(F.col("weighted").isNull(), MISSING).when(F.col("there").isNull(), UNKNOWN)
    return d.select("portfolio", "listing", kind.alias("violation")).filter("violation IS NOT NULL")


def verdicts(listings: DataFrame, weights: DataFrame, limits: Limits) -> DataFrame:
    """portfolio, status (valid or blocked), violations: how many, and the first of them; a portfolio with any is blocked."""
    found = violations(weights, limits).unionByName(mismatches(listings, weights))
    found = found.groupBy("portfolio").agg(F.count("*").alias("violations"), F.min(F.concat_ws(":", "violation", F.nullif("listing", F.lit("")))).alias("first"))
    every = weights.select("portfolio").unionByName(listings.select("portfolio")).distinct()
    d = every.join(found, "portfolio", "left")
    return d.select("portfolio", F.when(F.col("violations").isNull(), "valid").otherwise("blocked").alias("status"), F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("first", F.lit("")).alias("first"))


def optimized(cov: DataFrame, means: DataFrame, objective: str, limits: Limits, step: int = 10) -> DataFrame:
    """status, weights and variance of the best grid weights inside the limits, one row.

    Only weights inside the limits are made. Where none is, the row says `infeasible`; where there are more than a grid may
    have, equal weights stand in and the row says `fallback_equal_weight`, or `infeasible` where they break a limit.
    """
    spark = cov.sparkSession
    low, high = -int(-limits.min_weight * step // 1), int(limits.max_weight * step + TOLERANCE)
    n = means.select("listing").distinct().limit(portfolio.MOST_LISTINGS + 1).count()
    nothing = spark.range(1).select(F.lit("infeasible").alias("status"), F.lit("").alias("weights"), F.lit(0.0).alias("variance"))
    if not n or n > portfolio.MOST_LISTINGS or portfolio.grid_size(n, step, low, high) > 20_000:
        equal = portfolio.equal_weights(means)
        if not n or not limits.min_weight <= 1 / n <= limits.max_weight:
            return nothing
        return portfolio.variance(cov, equal).select(F.lit("fallback_equal_weight").alias("status"), F.lit("").alias("weights"), "variance")
    if not portfolio.grid_size(n, step, low, high):
        return nothing
    found = portfolio.best(portfolio.grid_scores(cov, means, step, low=low, high=high), objective)
    return found.select(F.lit("optimal").alias("status"), "weights", "variance")
