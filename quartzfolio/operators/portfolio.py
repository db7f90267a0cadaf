"""The aligned return matrix, covariance models, portfolio returns and what is measured on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import TRADING_DAYS, nearest, product, ratio0, running, zero
from .pairs import aligned

ROOT = TRADING_DAYS**0.5
#: Listings of a model that a grid may have.
MOST_LISTINGS = 200


def matrix(rets: DataFrame) -> DataFrame:
    """The rows on dates that every listing has (relational division by a count)."""
    n = rets.select(F.countDistinct("listing").alias("n"))
    dates = rets.groupBy("date").agg(F.countDistinct("listing").alias("c")).join(F.broadcast(n), F.col("c") == F.col("n")).select("date")  # n is one row
    return rets.join(dates, "date", "left_semi")


def asset_metrics(m: DataFrame, confidence: float = 0.95) -> DataFrame:
    r = F.col("simple")
    d = m.groupBy("listing").agg(F.count("*").alias("n"), F.avg(r).alias("mean"), zero(F.stddev_samp(r)).alias("std"), F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2))).alias("downside"))
    d = d.select("listing", "n", (F.col("mean") * TRADING_DAYS).alias("annual_return"), (F.col("std") * ROOT).alias("annual_volatility"), ratio0(F.col("mean") * TRADING_DAYS, F.col("std") * ROOT).alias("sharpe"), ratio0(F.col("mean") * TRADING_DAYS, F.col("downside") * ROOT).alias("sortino"))
    return d.join(_tail(m.select("listing", "date", (-r).alias("loss")), ["listing"], confidence), "listing")


def _tail(losses: DataFrame, keys: list[str], confidence: float) -> DataFrame:
    w = Window.partitionBy(*keys)
    d = losses.withColumns({"i": F.row_number().over(w.orderBy("loss", "date")) - 1, "n": F.count("*").over(w)})
    d = d.withColumn("var", F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(confidence))), F.col("loss"))).over(w))
    return d.filter("loss >= var").groupBy(*keys).agg(F.first("var").alias("value_at_risk"), F.avg("loss").alias("cvar"), F.count("*").alias("tail_count"))


def tail_risk(r: DataFrame, confidence: float = 0.95) -> DataFrame:
    """value_at_risk, cvar and tail_count of one portfolio's returns (date, r)."""
    return _tail(r.select(F.lit("all").alias("portfolio"), "date", (-F.col("r")).alias("loss")), ["portfolio"], confidence)


def equal_weights(m: DataFrame) -> DataFrame:
    names = m.select("listing").distinct()
    return names.join(F.broadcast(names.agg(F.count("*").alias("n")))).select("listing", (F.lit(1.0) / F.col("n")).alias("weight"))


def portfolio_returns(m: DataFrame, weights: DataFrame) -> DataFrame:
    """date, r; weights has a row for each listing of the matrix."""
    return m.join(weights, "listing").groupBy("date").agg(F.sum(F.col("weight") * F.col("simple")).alias("r"))


def drawdowns(r: DataFrame) -> DataFrame:
    """date, wealth, peak (at least 1), drawdown, duration and recovery_duration of one series of returns.

    One portfolio's series is one row per date, so its windows have one partition by nature; several
    portfolios are told apart by a `portfolio` column.
    """
    keys = [c for c in r.columns if c == "portfolio"]
    base = Window.partitionBy(*keys).orderBy("date")
    upto = base.rowsBetween(Window.unboundedPreceding, 0)
    d = r.withColumn("wealth", product(1 + F.col("r"), upto))
    d = d.withColumn("peak", F.greatest(F.lit(1.0), F.max("wealth").over(upto)))
    d = d.withColumn("at_peak", F.col("wealth") >= F.greatest(F.lit(1.0), F.coalesce(F.lag("peak").over(base), F.lit(1.0))))
    d = d.withColumns({"drawdown": F.col("wealth") / F.col("peak") - 1, "island": F.sum(F.col("at_peak").cast("int")).over(upto)})
    inside = Window.partitionBy(*keys, "island").orderBy("date")
    d = d.withColumn("duration", F.when(F.col("at_peak"), 0).otherwise(F.row_number().over(inside) - F.when(F.max("at_peak").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 1).otherwise(0)))
    d = d.withColumn("recovery_duration", F.when(F.col("at_peak"), F.coalesce(F.lag("duration").over(base), F.lit(0))).otherwise(0))
    return d.select(*keys, "date", "r", "wealth", "peak", "drawdown", F.col("duration").cast("long").alias("duration"), F.col("recovery_duration").cast("long").alias("recovery_duration"))


def portfolio_metrics(r: DataFrame) -> DataFrame:
    d = drawdowns(r).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), zero(F.stddev_samp("r")).alias("std"), F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2))).alias("downside"), F.min("drawdown").alias("max_drawdown"), F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))).alias("ulcer_index"))
    year = F.col("mean") * TRADING_DAYS
    return d.select("n", year.alias("annual_return"), (F.col("std") * ROOT).alias("annual_volatility"), ratio0(year, F.col("std") * ROOT).alias("sharpe"), ratio0(year, F.col("downside") * ROOT).alias("sortino"), "max_drawdown", ratio0(year, F.abs("max_drawdown")).alias("calmar"), "ulcer_index")


def _crossed(m: DataFrame, column: str) -> DataFrame:
    """left, right, date, x, y over all ordered pairs of the matrix, the diagonal included."""
    a = m.select(F.col("listing").alias("left"), "date", F.col(column).alias("x"))
    return a.join(m.select(F.col("listing").alias("right"), "date", F.col(column).alias("y")), "date")


def covariance(m: DataFrame, column: str = "simple") -> DataFrame:
    """left, right, covariance: sample covariance of all ordered pairs."""
    return _crossed(m, column).groupBy("left", "right").agg(zero(F.covar_samp("x", "y")).alias("covariance"))


def covariance_ledoit_wolf(m: DataFrame, column: str = "simple") -> DataFrame:
    """Shrinkage to the scaled identity; its intensity from how the daily products spread."""
    w = Window.partitionBy("listing")
    d = m.select("listing", "date", (F.col(column) - F.avg(column).over(w)).alias("z"))
    c = _crossed(d, "z")
    s = c.groupBy("left", "right").agg(F.count("*").alias("t"), (F.sum(F.col("x") * F.col("y")) / (F.count("*") - 1)).alias("s"))
    n = s.agg(F.countDistinct("left").alias("n"), (F.sum(F.when(F.col("left") == F.col("right"), F.col("s"))) / F.countDistinct("left")).alias("mu"), F.max("t").alias("t"))
    delta = s.join(F.broadcast(n.select("n", "mu"))).agg((F.sum(F.pow(F.col("s") - F.when(F.col("left") == F.col("right"), F.col("mu")).otherwise(0.0), 2)) / F.max("n")).alias("delta"))
    # The squared distances of the daily products from s, summed over all pairs and dates, need only the dates' squared lengths and s.
    daily = d.groupBy("date").agg(F.sum(F.col("z") * F.col("z")).alias("q")).agg(F.sum(F.col("q") * F.col("q")).alias("q"))
    beta = daily.join(s.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("t").alias("days"))).select((F.col("q") - (F.col("days") - 2) * F.col("ss")).alias("b"))
    one = n.join(delta).join(beta)
    k = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio0(F.col("b") / (F.col("t") * F.col("t")) / F.col("n"), F.col("delta"))))
    one = one.select(k.alias("intensity"), "mu")
    return s.join(F.broadcast(one)).select("left", "right", ((1 - F.col("intensity")) * F.col("s") + F.when(F.col("left") == F.col("right"), F.col("intensity") * F.col("mu")).otherwise(0.0)).alias("covariance"), "intensity")


def covariance_ewma(m: DataFrame, decay: float = 0.94, column: str = "simple") -> DataFrame:
    """The recurrence in closed form: decay^(T-1) on the first row, (1 - decay) decay^(T-t) on later ones."""
    w = Window.partitionBy("listing")
    d = m.select("listing", "date", (F.col(column) - F.avg(column).over(w)).alias("z"), F.row_number().over(w.orderBy("date")).alias("i"), F.count("*").over(w).alias("t"))
    weight = F.when(F.col("i") == 1, F.pow(F.lit(decay), F.col("t") - 1)).otherwise((1 - decay) * F.pow(F.lit(decay), F.col("t") - F.col("i")))
    a = d.select(F.col("listing").alias("left"), "date", F.col("z").alias("x"), weight.alias("w"))
    c = a.join(d.select(F.col("listing").alias("right"), "date", F.col("z").alias("y")), "date")
    return c.groupBy("left", "right").agg(F.sum(F.col("w") * F.col("x") * F.col("y")).alias("covariance"))


def model_window(m: DataFrame, policy: str, size: int | None = None, as_of: str | None = None) -> DataFrame:
    """The rows of a risk model's dates: all (full), those up to as_of (expanding) or its last `size` (rolling).

    as_of is a date of the matrix; without it windows end with the last date.
    """
    if policy not in ("full", "rolling", "expanding"):
        raise ValueError(f"unknown window policy: {policy}")
    if policy == "full":
        if as_of is not None:
            raise ValueError("a full window takes no as_of")
        return m
    if policy == "rolling" and (size is None or size < 1):
        raise ValueError("a rolling window needs a positive size")
    dates = m.select("date").distinct()
    if as_of is not None:
        if dates.filter(F.col("date") == F.lit(as_of).cast("date")).isEmpty():
            raise ValueError(f"no common date {as_of}")
        dates = dates.filter(F.col("date") <= F.lit(as_of).cast("date"))
    if policy == "rolling":
        dates = dates.orderBy(F.col("date").desc()).limit(size)
    return m.join(dates, "date", "left_semi")


def model_reasons(missing_pairs: int, not_finite: int, semidefinite: bool, stability: str) -> list[str]:
    """Why a risk model can't be used in production; none where it can."""
    checks = {
        "missing_pairs": missing_pairs > 0,
        "non_finite_values": not_finite > 0,
        "not_positive_semidefinite": not semidefinite,
        "unstable_condition_number": stability in ("ill_conditioned", "singular"),
    }
    return [reason for reason, holds in checks.items() if holds]


def complete(cov: DataFrame) -> DataFrame:
    """cov; raises where an ordered pair is missing or not finite."""
    n, rows, bad = cov.agg(F.countDistinct("left"), F.countDistinct("left", "right"), F.count_if(F.isnan("covariance") | F.col("covariance").isNull() | (F.abs("covariance") == float("inf")))).first()
    if rows != n * n or bad:
        raise ValueError(f"{n * n - rows} pairs missing, {bad} not finite")
    return cov


def weighted(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """left, right, covariance, wl, wr."""
    left = weights.select(F.col("listing").alias("left"), F.col("weight").alias("wl"))
    return cov.join(left, "left").join(weights.select(F.col("listing").alias("right"), F.col("weight").alias("wr")), "right")


def variance(cov: DataFrame, weights: DataFrame) -> DataFrame:
    return weighted(cov, weights).agg(F.sum(F.col("wl") * F.col("wr") * F.col("covariance")).alias("variance"))


def risk_contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """listing, weight, marginal, contribution, share: how much of the volatility each listing makes."""
    d = weighted(cov, weights).groupBy("left", "wl").agg(F.sum(F.col("covariance") * F.col("wr")).alias("m"))
    sd = F.sqrt(F.sum(F.col("wl") * F.col("m")).over(Window.partitionBy()))
    d = d.withColumn("sd", sd).withColumn("marginal", ratio0(F.col("m"), F.col("sd")))
    return d.select(F.col("left").alias("listing"), F.col("wl").alias("weight"), "marginal", (F.col("wl") * F.col("marginal")).alias("contribution"), ratio0(F.col("wl") * F.col("marginal"), F.col("sd")).alias("share"))


def diversification(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted volatility over the portfolio's, and the effective number of positions."""
    d = weighted(cov, weights)
    one = d.agg(F.sqrt(F.sum(F.col("wl") * F.col("wr") * F.col("covariance"))).alias("sd"), F.sum(F.when(F.col("left") == F.col("right"), F.col("wl") * F.sqrt(F.abs("covariance")))).alias("own"), F.sum(F.when(F.col("left") == F.col("right"), F.col("wl") * F.col("wl"))).alias("hhi"))
    return one.select(ratio0(F.col("own"), F.col("sd")).alias("diversification_ratio"), ratio0(F.lit(1.0), F.col("hhi")).alias("effective_positions"))


def covariance_summary(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """One row on a covariance matrix under weights.

    listing_count, pair_count, average_covariance and average_correlation over pairs (the latter over
    those of two positive variances), volatility, diversification_ratio, effective_bets (1 over the
    squared shares of risk) and largest_risk_share; null without pairs or risk.
    """
    d = weighted(cov, weights)
    each = d.groupBy("left", "wl").agg(F.sum(F.col("wr") * F.col("covariance")).alias("m"), F.max(F.when(F.col("left") == F.col("right"), F.col("covariance"))).alias("own"))
    risk, total = F.col("wl") * F.col("m"), F.expr("IF(total > 0, total, NULL)")
    one = each.agg(
        F.count("*").alias("listing_count"), F.sum(risk).alias("total"), F.sum(risk * risk).alias("squares"), F.max(risk).alias("largest"),
        F.sum(F.col("wl") * F.sqrt(F.greatest(F.lit(0.0), "own"))).alias("weighted"),
    )
    own = each.filter("own > 0").select(F.col("left").alias("listing"), "own")
    both = d.filter(F.col("left") < F.col("right")).join(own.select(F.col("listing").alias("left"), F.col("own").alias("a")), "left", "left")
    both = both.join(own.select(F.col("listing").alias("right"), F.col("own").alias("b")), "right", "left")
    pairs = both.agg(F.count("*").alias("pair_count"), F.avg("covariance").alias("average_covariance"), F.avg(F.col("covariance") / F.sqrt(F.col("a") * F.col("b"))).alias("average_correlation"))
    return one.join(F.broadcast(pairs)).select(  # one row each
        "listing_count", "pair_count", "average_covariance", "average_correlation", F.sqrt(F.greatest(F.lit(0.0), "total")).alias("volatility"),
        (F.col("weighted") / F.sqrt(total)).alias("diversification_ratio"), (total * total / F.col("squares")).alias("effective_bets"), (F.col("largest") / total).alias("largest_risk_share"),
    )


def inverse_volatility(cov: DataFrame) -> DataFrame:
    d = cov.filter("left = right").select(F.col("left").alias("listing"), ratio0(F.lit(1.0), F.sqrt("covariance")).alias("i"))
    return d.select("listing", (F.col("i") / F.sum("i").over(Window.partitionBy())).alias("weight"))


def grid_size(n: int, step: int, low: int, high: int) -> int:
    """How many vectors of n whole numbers from low to high sum to step."""
    ways = [1] + [0] * step
    for _ in range(n):
        ways = [sum(ways[s - x] for x in range(low, min(high, s) + 1)) for s in range(step + 1)]
    return ways[step]


def grid(spark: SparkSession, listings: list[str], step: int, most: int = 20_000, low: int = 0, high: int | None = None) -> DataFrame:
    """candidate (array of integer weights from low to high that sum to `step`), one row each; at most `most`, none without listings.

    A vector only grows by weights that the others can still complete, so that none is made and thrown away.
    """
    high = step if high is None else high
    if not listings:
        return spark.createDataFrame([], "candidate array<bigint>")
    if len(listings) * max(low, 1) > most or grid_size(len(listings), step, low, high) > most:
        raise ValueError("more grid candidates than allowed")
    d = spark.range(1).select(F.array().cast("array<bigint>").alias("c"), F.lit(step).cast("long").alias("left"))
    for rest in range(len(listings) - 1, -1, -1):
        least, greatest = F.greatest(F.lit(low), F.col("left") - high * rest).cast("long"), F.least(F.lit(high), F.col("left") - low * rest).cast("long")
        d = d.withColumns({"least": least, "greatest": greatest}).filter("least <= greatest")
        d = d.select("c", "left", F.explode(F.sequence("least", "greatest")).alias("x")).select(F.array_append("c", F.col("x")).alias("c"), (F.col("left") - F.col("x")).alias("left"))
    return d.select(F.col("c").alias("candidate"))


def grid_scores(cov: DataFrame, means: DataFrame, step: int = 10, keys: tuple[str, ...] = (), low: int = 0, high: int | None = None) -> DataFrame:
    """keys, candidate, variance, expected, own (weighted volatility) and spread (of risk shares) of every weight vector of the grid.

    With keys, cov and means hold one model for each of their values; `grid` bounds the listings of a model.
    """
    # More listings than this have more than the grid's candidates at any step; they aren't collected.
    names = sorted(r.listing for r in means.select("listing").distinct().limit(MOST_LISTINGS + 1).collect())
    if len(names) > MOST_LISTINGS:
        raise ValueError(f"more than {MOST_LISTINGS} listings for a grid")
    cells = grid(cov.sparkSession, names, step, low=low, high=high).select("candidate", F.posexplode("candidate").alias("k", "w"))
    at = F.try_element_at(F.array(*map(F.lit, names)).cast("array<string>"), F.col("k") + 1)
    cells = cells.select("candidate", at.alias("listing"), (F.col("w") / F.lit(float(step))).alias("w"))
    a, b = cells.select("candidate", F.col("listing").alias("left"), F.col("w").alias("wl")), cells.select("candidate", F.col("listing").alias("right"), F.col("w").alias("wr"))
    # The partial sums over one side come first: rows grow with candidates x listings, not with their square.
    half = a.join(cov, "left").groupBy(*keys, "candidate", "right").agg(F.sum(F.col("wl") * F.col("covariance")).alias("h"))
    part = F.col("h") * F.col("wr")
    var = half.join(b, ["candidate", "right"]).groupBy(*keys, "candidate").agg(F.sum(part).alias("variance"), F.sum(part * part).alias("squares"))
    var = var.select(*keys, "candidate", "variance", (ratio0(F.col("squares"), F.col("variance") * F.col("variance")) - 1 / max(1, len(names))).alias("spread"))
    own = means.join(cov.filter("left = right").select(*keys, F.col("left").alias("listing"), F.sqrt("covariance").alias("sd")), [*keys, "listing"])
    mu = cells.join(own, "listing").groupBy(*keys, "candidate").agg(F.sum(F.col("w") * F.col("mean")).alias("expected"), F.sum(F.col("w") * F.col("sd")).alias("own"))
    return var.join(mu, [*keys, "candidate"])


def best(scores: DataFrame, objective: str, risk_free: float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """The best candidate of each key by one of the objectives below; ties by the weights."""
    sd = F.sqrt("variance")
    value = {
        "min_variance": F.col("variance"),
        "max_sharpe": -ratio0(F.col("expected") - risk_free, sd),
        "max_diversification": -ratio0(F.col("own"), sd),
        "risk_parity": F.col("spread"),
        "max_return": -F.col("expected"),
    }[objective]
    value = nearest(value, 9 if objective == "risk_parity" else 12)
    return scores.withColumn("value", value).groupBy(*keys).agg(F.min(F.struct("value", "candidate", "variance", "expected")).alias("b")).select(*keys, F.array_join("b.candidate", ",").alias("weights"), "b.variance", "b.expected")


def frontier(scores: DataFrame, targets: list[float]) -> DataFrame:
    """For each target the least variance that reaches it; a target out of reach has no weights."""
    t = scores.sparkSession.createDataFrame([(float(x),) for x in targets], "target double")
    found = scores.join(F.broadcast(t), nearest("expected", 12) >= F.col("target")).groupBy("target").agg(F.min(F.struct(nearest("variance", 12).alias("v"), "candidate")).alias("b"))
    return t.join(found, "target", "left").select("target", F.coalesce("b.v", F.lit(0.0)).alias("variance"), F.coalesce(F.array_join("b.candidate", ","), F.lit("")).alias("weights"))


def worst_window(r: DataFrame, length: int) -> DataFrame:
    """start, compounded: the worst `length` dates in a row, the earliest of equals."""
    w = Window.partitionBy().orderBy("date")
    d = r.withColumns({"c": product(1 + F.col("r"), w.rowsBetween(0, length - 1)) - 1, "k": F.count("*").over(w.rowsBetween(0, length - 1))}).filter(F.col("k") == length)
    return d.agg(F.min(F.struct(nearest("c", 9).alias("c"), "date")).alias("b")).filter("b IS NOT NULL").select(F.col("b.date").alias("start"), F.col("b.c").alias("compounded"))


def stress_windows(r: DataFrame, length: int, confidence: float = 0.95) -> DataFrame:
    """The worst `length` dates in a row of every portfolio, replayed by themselves.

    r: portfolio, date, r. Returns portfolio, start, until, compounded, max_drawdown (wealth starts anew
    at 1), value_at_risk, cvar and tail_count of the window; a portfolio of fewer dates has no row,
    of equal windows the earliest counts.
    """
    span = Window.partitionBy("portfolio").orderBy("date").rowsBetween(0, length - 1)
    d = r.withColumns({"c": product(1 + F.col("r"), span) - 1, "k": F.count("*").over(span), "until": F.max("date").over(span)}).filter(F.col("k") == length)
    worst = d.groupBy("portfolio").agg(F.min(F.struct(nearest("c", 9).alias("c"), F.col("date").alias("start"), "until")).alias("b")).select("portfolio", "b.*")
    inside = r.join(worst, "portfolio").filter("date BETWEEN start AND until").select("portfolio", "date", "r")
    fall = drawdowns(inside).groupBy("portfolio").agg(F.min("drawdown").alias("max_drawdown"))
    tail = _tail(inside.select("portfolio", "date", (-F.col("r")).alias("loss")), ["portfolio"], confidence)
    return worst.withColumnRenamed("c", "compounded").join(fall, "portfolio").join(tail, "portfolio")


def distribution_cut(m: DataFrame, listings: list[str], cut: float) -> DataFrame:
    return m.withColumn("simple", F.when(F.col("listing").isin(listings), F.col("simple") * (1 + cut)).otherwise(F.col("simple")))


def converged(cov: DataFrame, factor: float) -> DataFrame:
    """Correlations moved toward 1 by a factor, variances kept."""
    v = cov.filter("left = right")
    d = cov.join(v.select("left", F.sqrt("covariance").alias("sl")), "left").join(v.select("right", F.sqrt("covariance").alias("sr")), "right")
    rho = ratio0(F.col("covariance"), F.col("sl") * F.col("sr"))
    return d.select("left", "right", ((rho + (1 - rho) * factor) * F.col("sl") * F.col("sr")).alias("covariance"))


def parametric_tail(variances: DataFrame, confidence: float = 0.95) -> DataFrame:
    """scenario, volatility, value_at_risk, cvar of zero-mean normal returns with these variances."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(confidence)
    sd = F.sqrt(F.greatest("variance", F.lit(0.0)))
    return variances.select("scenario", sd.alias("volatility"), (sd * z).alias("value_at_risk"), (sd * (NormalDist().pdf(z) / (1 - confidence))).alias("cvar"))


def covariance_scenarios(cov: DataFrame, weights: DataFrame, convergence: float, perturbation: float) -> DataFrame:
    """scenario, variance: correlations moved toward 1, and the whole matrix scaled."""
    a = variance(converged(cov, convergence), weights).select(F.lit("correlation_convergence").alias("scenario"), "variance")
    b = variance(cov, weights).select(F.lit("covariance_perturbation").alias("scenario"), (F.col("variance") * (1 + perturbation)).alias("variance"))
    return a.unionByName(b)


def sensitivity(scenarios: DataFrame) -> DataFrame:
    """scenarios, median_cvar and worst_cvar over a candidate's scenarios."""
    return scenarios.agg(F.count("*").alias("scenarios"), F.median("cvar").alias("median_cvar"), F.max("cvar").alias("worst_cvar"))


def rebalance(m: DataFrame, weights: DataFrame, unit: str = "month", cost: float = 0.0) -> DataFrame:
    """date, rebalanced, value, turnover: drift inside a period, weights restored on its first date.

    Inside a segment a listing grows by its cumulated returns; each rebalance multiplies the value by
    the segment's growth less the cost of its turnover, so that the whole is two running products.
    """
    dates = m.select("date").distinct()
    w = Window.partitionBy().orderBy("date")
    period = F.date_trunc(unit, F.col("date"))
    dates = dates.withColumn("reb", F.coalesce(period != F.lag(period).over(w), F.lit(True)))
    dates = dates.withColumn("seg", F.coalesce(F.sum(F.col("reb").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = m.join(dates, "date").join(weights, "listing")
    cp = product(1 + F.col("simple"), running("listing", "seg"))
    d = d.withColumn("g", F.col("weight") * cp)
    f = d.groupBy("date", "seg", "reb").agg(F.sum("g").alias("f"))
    t = d.join(f.select("date", "f"), "date").groupBy("date").agg((F.sum(F.abs(ratio0(F.col("g"), F.col("f")) - F.col("weight"))) / 2).alias("drift"))
    d = f.join(t, "date").withColumn("turnover", F.when(F.col("reb"), F.col("drift")).otherwise(0.0))
    step = F.when(F.col("reb"), F.col("f") * (1 - F.lit(cost) * F.col("drift"))).otherwise(1.0)
    before = product(step, w.rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("value", before * F.col("f") * F.when(F.col("reb"), 1 - F.lit(cost) * F.col("drift")).otherwise(1.0)).select("date", F.col("reb").alias("rebalanced"), "value", "turnover")


def rebalance_events(m: DataFrame, weights: DataFrame, unit: str = "month", cost: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Of each portfolio (portfolio, listing, weight) the row of each date, and those of its listings.

    Events: portfolio, date, pre_trade_value, turnover, transaction_cost, portfolio_value, post_cost_return, cash_remainder,
    rebalanced. Listings: portfolio, listing, date, pre_trade_value, pre_trade_weight, target_value, trade_value, rebalanced. A
    listing without a return on a date keeps its value. unit is month, quarter or year; weights are restored on
    the first date of each. As in `rebalance`, a segment's growth and the product of the segments before give every value.
    """
    if unit not in ("month", "quarter", "year"):
        raise ValueError(f"unknown rebalance schedule: {unit}")
    w = Window.partitionBy("portfolio").orderBy("date")
    dates = m.agg(F.array_sort(F.collect_set("date")).alias("dates"))  # one row with the dates of one market
    grid = weights.join(F.broadcast(dates)).select("portfolio", "listing", "weight", F.posexplode("dates").alias("i", "date"), "dates")
    period = lambda d: F.date_trunc(unit, d)
    changed = (F.col("i") == 0) | (period(F.col("date")) != period(F.try_element_at("dates", F.greatest("i", F.lit(1)))))
    grid = grid.withColumn("reb", changed).drop("dates", "i")
    d = grid.join(m.select("listing", "date", "simple"), ["listing", "date"], "left")
    own = Window.partitionBy("portfolio", "listing").orderBy("date")
    d = d.withColumn("seg", F.coalesce(F.sum(F.col("reb").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("g", F.col("weight") * product(1 + F.coalesce("simple", F.lit(0.0)), running("portfolio", "listing", "seg")))
    day = Window.partitionBy("portfolio", "date")
    d = d.withColumn("f", F.sum("g").over(day)).withColumn("share", ratio0(F.col("g"), F.col("f")))
    f = d.groupBy("portfolio", "date", "reb").agg(F.first("f").alias("f"), (F.sum(F.abs(F.col("share") - F.col("weight"))) / 2).alias("drift"), F.sum("weight").alias("whole"))
    kept = F.when(F.col("reb"), 1 - F.lit(cost) * F.col("drift")).otherwise(1.0)
    before = product(F.when(F.col("reb"), F.col("f") * kept).otherwise(1.0), w.rowsBetween(Window.unboundedPreceding, -1))
    f = f.withColumns({"before": before, "kept": kept}).withColumns({"pre": F.col("before") * F.col("f")}).withColumn("value", F.col("pre") * F.col("kept"))
    events = f.select(
        "portfolio", "date", F.col("pre").alias("pre_trade_value"), F.when(F.col("reb"), F.col("drift")).otherwise(0.0).alias("turnover"), (F.col("pre") - F.col("value")).alias("transaction_cost"), F.col("value").alias("portfolio_value"),
        (ratio0(F.col("value"), F.coalesce(F.lag("value").over(w), F.col("whole"))) - 1).alias("post_cost_return"), F.when(F.col("reb"), F.col("value") * (1 - F.col("whole"))).otherwise(0.0).alias("cash_remainder"), F.col("reb").alias("rebalanced"),
    )
    rows = d.join(f.select("portfolio", "date", "before", "pre"), ["portfolio", "date"])
    held = F.col("before") * F.col("g")
    target = F.when(F.col("reb"), F.col("weight") * F.col("pre")).otherwise(held)
    rows = rows.select("portfolio", "listing", "date", held.alias("pre_trade_value"), F.col("share").alias("pre_trade_weight"), target.alias("target_value"), (target - held).alias("trade_value"), F.col("reb").alias("rebalanced"))
    return events, rows


def walk_forward_splits(m: DataFrame, train: int, test: int, mode: str = "rolling") -> DataFrame:
    """split, date, role: rolling or expanding windows over the dates; a date may serve several splits."""
    w = Window.partitionBy().orderBy("date")
    d = m.select("date").distinct().withColumn("i", F.row_number().over(w) - 1)
    n = d.agg(F.count("*").alias("n"))
    splits = n.select(F.explode(F.expr(f"CASE WHEN n >= {train + test} THEN sequence(0, CAST((n - {train + test}) div {test} AS INT)) ELSE array() END")).alias("split"))
    first = F.col("split") * test if mode == "rolling" else F.lit(0)
    j = splits.join(d, (F.col("i") >= first) & (F.col("i") < F.col("split") * test + train + test))
    return j.select("split", "date", F.when(F.col("i") < F.col("split") * test + train, "train").otherwise("test").alias("role"))


def walk_forward_equal(m: DataFrame, train: int, test: int) -> DataFrame:
    """split, start, n, total_return, volatility of an equal-weight portfolio on each test window."""
    r = portfolio_returns(m, equal_weights(m))
    d = walk_forward_splits(m, train, test).filter("role = 'test'").join(r, "date")
    return d.groupBy("split").agg(F.min("date").alias("start"), F.count("*").alias("n"), (product(1 + F.col("r")) - 1).alias("total_return"), zero(F.stddev_samp("r")).alias("volatility"))


def order_sizes(targets: DataFrame, portfolio_value: float, cash_buffer: float = 0.0) -> DataFrame:
    """quantity = floor(investable x weight / price); BUY, or SKIP where it is 0."""
    q = F.floor(ratio0(F.lit(portfolio_value * (1 - cash_buffer)) * F.col("weight"), F.col("px")))
    return targets.select("listing", q.alias("quantity"), (q * F.col("px")).alias("amount"), F.when(q > 0, "BUY").otherwise("SKIP").alias("side"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["aligned"]
