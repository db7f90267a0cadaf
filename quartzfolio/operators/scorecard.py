"""Walk-forward tests of optimizers and the scorecard that compares them.

What several branches read is checkpointed, as each would plan and compute it anew.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import TRADING_DAYS, nearest, product, ratio0, zero
from . import portfolio


class Candidate(NamedTuple):
    """A name, an objective of `portfolio.best` and the greatest weight of a listing."""

    name: str
    objective: str
    max_weight: float = 1.0


def split_weights(m: DataFrame, splits: DataFrame, candidates: list[Candidate], step: int = 10) -> DataFrame:
    """name, split, listing, weight: each candidate optimized on the training dates of each split.

    The models of all splits are scored in one pass over the grid. A candidate that no weights satisfy
    has no rows.
    """
    train = m.join(splits.filter("role = 'train'").select("split", "date"), "date").select("split", "date", "listing", "simple").checkpoint()
    a = train.select("split", "date", F.col("listing").alias("left"), F.col("simple").alias("x"))
    b = train.select("split", "date", F.col("listing").alias("right"), F.col("simple").alias("y"))
    cov = a.join(b, ["split", "date"]).groupBy("split", "left", "right").agg(zero(F.covar_samp("x", "y")).alias("covariance"))
    means = train.groupBy("split", "listing").agg(F.avg("simple").alias("mean"))
    scores = portfolio.grid_scores(cov.checkpoint(), means.checkpoint(), step, ("split",)).checkpoint()
    parts = []
    for c in candidates:
        allowed = scores.filter(F.array_max("candidate") <= F.lit(c.max_weight * step + 1e-9))
        parts.append(portfolio.best(allowed, c.objective, keys=("split",)).select(F.lit(c.name).alias("name"), "split", "weights"))
    d = reduce(DataFrame.unionByName, parts).select("name", "split", F.posexplode(F.split("weights", ",")).alias("k", "w"))
    names = m.select("listing").distinct().select("listing", (F.row_number().over(Window.partitionBy().orderBy("listing")) - 1).alias("k"))
    # The listings are as many as the grid allows.
    return d.join(F.broadcast(names), "k").select("name", "split", "listing", (F.col("w").cast("double") / step).alias("weight"))


def backtest(m: DataFrame, splits: DataFrame, weights: DataFrame, cost: float = 0.0) -> DataFrame:
    """Per name and split: returns before and after the cost of turnover, ratios and turnover on the test dates."""
    w = Window.partitionBy("name", "listing").orderBy("split")
    turned = weights.withColumn("d", F.abs(F.col("weight") - F.lag("weight").over(w)))
    turned = turned.groupBy("name", "split").agg((zero(F.sum("d")) / 2).alias("turnover"))
    test = m.join(splits.filter("role = 'test'").select("split", "date"), "date")
    daily = test.join(weights, ["split", "listing"]).groupBy("name", "split", "date").agg(F.sum(F.col("weight") * F.col("simple")).alias("r"))
    r = daily.groupBy("name", "split").agg(
        F.count("*").alias("n"),
        (product(1 + F.col("r")) - 1).alias("pre_cost_return"),
        (zero(F.stddev_samp("r")) * TRADING_DAYS**0.5).alias("volatility"),
        (F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2))) * TRADING_DAYS**0.5).alias("downside"),
    )
    d = r.join(turned, ["name", "split"]).withColumn("post_cost_return", (1 - F.col("turnover") * cost) * (1 + F.col("pre_cost_return")) - 1)
    year = F.pow(1 + F.col("post_cost_return"), TRADING_DAYS / F.col("n")) - 1
    return d.select("name", "split", "n", "pre_cost_return", "post_cost_return", "volatility", ratio0(year, F.col("volatility")).alias("sharpe"), ratio0(year, F.col("downside")).alias("sortino"), "turnover")


def concentration(weights: DataFrame) -> DataFrame:
    """name, median_concentration (of the greatest weight of a split) and median_weight_variance (of a listing's weights)."""
    top = weights.groupBy("name", "split").agg(F.max("weight").alias("x")).groupBy("name").agg(F.median("x").alias("median_concentration"))
    spread = weights.groupBy("name", "listing").agg(F.var_samp("weight").alias("x")).groupBy("name").agg(zero(F.median("x")).alias("median_weight_variance"))
    return top.join(spread, "name")


def scorecard(m: DataFrame, candidates: list[Candidate], train: int, test: int, mode: str = "rolling", cost: float = 0.0, step: int = 10) -> DataFrame:
    """One row per candidate, ranked by its median ratio of return to volatility and then by name.

    A candidate without a completed split is blocked: its figures and rank are null.
    """
    m = m.checkpoint()
    splits = portfolio.walk_forward_splits(m, train, test, mode).checkpoint()
    weights = split_weights(m, splits, candidates, step).checkpoint()
    runs = backtest(m, splits, weights, cost).checkpoint()
    figures = runs.groupBy("name").agg(
        F.count("*").alias("completed_splits"),
        F.median("post_cost_return").alias("median_return"),
        F.min("post_cost_return").alias("adverse_return"),
        F.median("sharpe").alias("median_sharpe"),
        F.median("sortino").alias("median_sortino"),
        F.median("turnover").alias("median_turnover"),
    )
    tail = portfolio._tail(runs.select("name", F.col("split").alias("date"), (-F.col("post_cost_return")).alias("loss")), ["name"], 0.95)
    # Each split is one period of the stitched series.
    stitched = portfolio.drawdowns(runs.select(F.col("name").alias("portfolio"), F.col("split").alias("date"), F.col("post_cost_return").alias("r")))
    stitched = stitched.groupBy(F.col("portfolio").alias("name")).agg(F.min("drawdown").alias("max_drawdown"), F.max("recovery_duration").alias("recovery_splits"))
    scored = figures.join(tail, "name").join(stitched, "name").join(concentration(weights), "name")
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(nearest("median_sharpe", 9).desc(), "name")))
    every = m.sparkSession.createDataFrame([(c.name, c.objective) for c in candidates], "name string, objective string")
    done = F.col("completed_splits").isNotNull()
    d = every.join(scored, "name", "left").withColumn("status", F.when(done, "scored").otherwise("blocked"))
    return d.withColumns({"reason": F.when(done, "").otherwise("no_completed_out_of_sample_splits"), "completed_splits": F.coalesce("completed_splits", F.lit(0).cast("long"))})
