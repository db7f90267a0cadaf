"""Investment profiles: what each proposes for every portfolio, a report on it, and the slots of a recommendation.

Every frame has a `portfolio` key. Alignment, covariance models, reports and recommendations are
joins and aggregates by it; only the solvers see one portfolio and profile as a group, of at most
`MAX_LISTINGS` listings. Nothing is left out: a portfolio with too many listings, too few dates or limits that
no weights satisfy, and a solver that didn't settle, give rows that say so.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import nearest, ratio0
from . import solvers

VERSION = 1
#: Weights may miss a bound or their sum by so much.
TOLERANCE = 1e-9
#: Dates that a model needs at least.
LEAST_DATES = 3


@dataclass(frozen=True)
class Profile:
    """Objectives (more than one: the median of their weights), bound of a weight, and limits that a report shows."""

    name: str
    objectives: tuple[str, ...]
    max_weight: float
    max_drawdown: float
    max_cvar: float
    max_turnover: float
    needs_income: bool = False

    def __post_init__(self) -> None:
        unknown = set(self.objectives) - set(OBJECTIVES)
        if unknown or not self.objectives:
            raise ValueError(f"a profile needs objectives out of {', '.join(OBJECTIVES)}, not {sorted(unknown)}")
        if not 0 < self.max_weight <= 1:
            raise ValueError("max_weight is above 0 and at most 1")


#: Fixed: the names of objectives, profiles, slots and words of a report, and the profiles' figures.
OBJECTIVES = ("shrinkage_minimum_variance", "hierarchical_risk_parity", "equal_risk_contribution", "minimum_cvar")
DEFENSIVE = Profile("defensive", ("shrinkage_minimum_variance",), 0.15, 0.15, 0.10, 0.30)
BALANCED = Profile("balanced", ("hierarchical_risk_parity", "equal_risk_contribution", "shrinkage_minimum_variance"), 0.20, 0.25, 0.15, 0.40)
INCOME = Profile("income", ("minimum_cvar",), 0.20, 0.20, 0.12, 0.30, True)
GROWTH = Profile("growth", ("equal_risk_contribution",), 0.25, 0.35, 0.20, 0.50)
PROFILES = (DEFENSIVE, BALANCED, INCOME, GROWTH)
SLOTS = ("best_defensive", "best_ensemble", "best_income", "best_diversified", "best_total_return")
INFEASIBLE, BROKEN = "candidate_infeasible", "constraint_violations_present"
NO_INCOME, NO_COST = "income_quality_unavailable_pending_after_tax_cashflow_stack", "cost_quality_unavailable_pending_broker_cost_engine"


def matrices(rets: DataFrame) -> DataFrame:
    """The rows of rets (portfolio, date, listing, simple) on dates that every listing of the portfolio has."""
    n = rets.groupBy("portfolio").agg(F.countDistinct("listing").alias("n"))
    dates = rets.groupBy("portfolio", "date").agg(F.countDistinct("listing").alias("c")).join(n, "portfolio").filter("c = n")
    return rets.join(dates.select("portfolio", "date"), ["portfolio", "date"], "left_semi")


def sizes(rets: DataFrame, m: DataFrame) -> DataFrame:
    """portfolio, listings, dates and reason: why a portfolio can't have a model, null where it can."""
    d = m.groupBy("portfolio").agg(F.countDistinct("date").alias("dates"))
    d = rets.groupBy("portfolio").agg(F.countDistinct("listing").alias("listings")).join(d, "portfolio", "left").fillna(0, "dates")
    few = F.when(F.col("dates") < LEAST_DATES, "insufficient_history")
    return d.select("*", F.when(F.col("listings") > solvers.MAX_LISTINGS, "too_many_listings").otherwise(few).alias("reason"))


def eligible(m: DataFrame, size: DataFrame) -> DataFrame:
    """The rows of m of the portfolios that can have a model."""
    return m.join(size.filter("reason IS NULL").select("portfolio"), "portfolio", "left_semi")


def models(m: DataFrame) -> DataFrame:
    """portfolio, left, right, covariance (sample), shrunk (to the scaled identity) and intensity, for all ordered pairs.

    m has only portfolios that are `eligible`, so that a portfolio's pairs are bounded.
    """
    mean = F.avg("simple").over(Window.partitionBy("portfolio", "listing"))
    d = m.select("portfolio", "date", "listing", (F.col("simple") - mean).alias("z"))
    a = d.select("portfolio", "date", F.col("listing").alias("left"), F.col("z").alias("x"))
    b = d.select("portfolio", "date", F.col("listing").alias("right"), F.col("z").alias("y"))
    s = a.join(b, ["portfolio", "date"]).groupBy("portfolio", "left", "right").agg(F.count("*").alias("t"), F.try_divide(F.sum(F.col("x") * F.col("y")), F.count("*") - 1).alias("s"))
    own, w = F.col("left") == F.col("right"), Window.partitionBy("portfolio")
    s = s.withColumns({"mu": F.avg(F.when(own, F.col("s"))).over(w), "n": F.count(F.when(own, 1)).over(w)})
    apart = F.col("s") - F.when(own, F.col("mu")).otherwise(0.0)
    s = s.withColumns({"delta": F.sum(apart * apart).over(w) / F.col("n"), "ss": F.sum(F.col("s") * F.col("s")).over(w)})
    daily = d.groupBy("portfolio", "date").agg(F.sum(F.col("z") * F.col("z")).alias("q")).groupBy("portfolio").agg(F.sum(F.col("q") * F.col("q")).alias("q"))
    spread = (F.col("q") - (F.col("t") - 2) * F.col("ss")) / (F.col("t") * F.col("t")) / F.col("n")
    d = s.join(daily, "portfolio").withColumn("intensity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio0(spread, F.col("delta")))))
    shrunk = (1 - F.col("intensity")) * F.col("s") + F.when(own, F.col("intensity") * F.col("mu")).otherwise(0.0)
    return d.select("portfolio", "left", "right", F.col("s").alias("covariance"), shrunk.alias("shrunk"), "intensity")


def _named(profiles: tuple[Profile, ...]) -> Column:
    return F.explode(F.array(*(F.lit(p.name) for p in profiles))).alias("profile")


def _objective(name: str, s: np.ndarray, shrunk: np.ndarray, r: np.ndarray, high: float) -> tuple[np.ndarray, bool]:
    if name == "hierarchical_risk_parity":
        return solvers.project(solvers.hierarchical(s), 0.0, high), True
    if name == "minimum_cvar":
        return solvers.cvar_descent(r, high=high)
    return solvers.risk_descent(s, high=high) if name == "equal_risk_contribution" else solvers.variance_descent(shrunk, high=high)


def candidates(m: DataFrame, model: DataFrame, profiles: tuple[Profile, ...] = PROFILES) -> DataFrame:
    """portfolio, profile, listing, weight, reason of every profile for every portfolio of m.

    Without weights, one row says why: `infeasible_bounds` or `solver_not_converged:` and the objective.
    """
    by_name = {p.name: p for p in profiles}

    def run(key: tuple, m: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        p = by_name[key[1]]
        r = m.pivot(index="date", columns="listing", values="simple").sort_index()
        names = list(r.columns)

        def dense(column: str) -> np.ndarray:
            return model.pivot(index="left", columns="right", values=column).loc[names, names].to_numpy()

        def rows(listings: list, weights: list, reason: str | None) -> pd.DataFrame:
            return pd.DataFrame({"portfolio": key[0], "profile": p.name, "listing": listings, "weight": weights, "reason": reason})

        if p.max_weight * len(names) < 1 - TOLERANCE:
            return rows([None], [np.nan], "infeasible_bounds")
        found = []
        for name in p.objectives:
            w, settled = _objective(name, dense("covariance"), dense("shrunk"), r.to_numpy(), p.max_weight)
            if not settled:
                return rows([None], [np.nan], f"solver_not_converged:{name}")
            found.append(w)
        w = np.median(found, axis=0)
        return rows(names, solvers.project(w / w.sum(), 0.0, p.max_weight), None)

    # Partitions by number, which adaptive execution leaves alone: few bytes of a group take long.
    keys, parts = ["portfolio", "profile"], int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = m.select("portfolio", _named(profiles), "date", "listing", "simple").repartition(parts, *keys).groupBy(*keys)
    # The key under a name of its own, as model may come from the very rows of m.
    right = model.select(F.col("portfolio").alias("portfolio"), _named(profiles), "left", "right", "covariance", "shrunk").repartition(parts, *keys).groupBy(*keys)
    found = left.cogroup(right).applyInPandas(run, "portfolio string, profile string, listing string, weight double, reason string")
    return found.withColumn("weight", F.nanvl("weight", F.lit(None).cast("double")))


def baselines(model: DataFrame) -> DataFrame:
    """portfolio, equal_weight_variance, inverse_volatility_variance (without bounds of a weight)."""
    own = model.filter("left = right").select("portfolio", F.col("left").alias("listing"), F.sqrt("covariance").alias("sd"))
    w = Window.partitionBy("portfolio")
    own = own.select("portfolio", "listing", (1 / F.count("*").over(w)).alias("e"), ratio0(ratio0(F.lit(1.0), F.col("sd")), F.sum(ratio0(F.lit(1.0), F.col("sd"))).over(w)).alias("i"))
    a, b = own.selectExpr("portfolio", "listing AS left", "e AS e1", "i AS i1"), own.selectExpr("portfolio", "listing AS right", "e AS e2", "i AS i2")
    d = model.join(a, ["portfolio", "left"]).join(b, ["portfolio", "right"])
    return d.groupBy("portfolio").agg(F.expr("sum(e1 * e2 * covariance)").alias("equal_weight_variance"), F.expr("sum(i1 * i2 * covariance)").alias("inverse_volatility_variance"))


def reports(found: DataFrame, model: DataFrame, size: DataFrame, current: DataFrame | None = None, profiles: tuple[Profile, ...] = PROFILES) -> DataFrame:
    """One row for each portfolio of size and profile: what it proposes, whether it may, and how it compares.

    found are `candidates`, current (portfolio, listing, weight) what is held. status is feasible,
    infeasible (no weights, or weights that break a bound) or blocked (no model, see `sizes`).
    """
    terms = [F.struct(F.lit(p.name).alias("profile"), F.lit("+".join(p.objectives)).alias("objectives"), F.lit(p.max_weight).alias("max_weight"), F.lit(p.max_drawdown).alias("max_drawdown"), F.lit(p.max_cvar).alias("max_cvar"), F.lit(p.max_turnover).alias("max_turnover"), F.lit(p.needs_income).alias("needs_income")) for p in profiles]
    each = size.select("portfolio", "dates", "listings", F.col("reason").alias("blocked"), F.explode(F.array(*terms)).alias("t")).select("portfolio", "dates", "listings", "blocked", "t.*")
    weights = found.filter("weight IS NOT NULL")
    keys = ["portfolio", "profile"]
    a, b = weights.select(*keys, F.col("listing").alias("left"), F.col("weight").alias("w1")), weights.select(*keys, F.col("listing").alias("right"), F.col("weight").alias("w2"))
    variance = model.join(a, ["portfolio", "left"]).join(b, [*keys, "right"]).groupBy(*keys).agg(F.expr("sum(w1 * w2 * covariance)").alias("variance"))
    total = weights.groupBy(*keys).agg(F.sum("weight").alias("total"), F.min("weight").alias("least"), F.max("weight").alias("most"), F.sum(F.col("weight") * F.col("weight")).alias("concentration"), F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("listing"))), 256).alias("members"))
    d = each.join(total, keys, "left").join(variance, keys, "left").join(baselines(model), "portfolio", "left").join(found.filter("weight IS NULL").select(*keys, "reason"), keys, "left")
    if current is None:
        d = d.withColumn("turnover", F.lit(None).cast("double"))
    else:
        held = current.select("portfolio", _named(profiles), "listing", F.col("weight").alias("held"))
        moved = weights.select(*keys, "listing", "weight").join(held, [*keys, "listing"], "full").fillna(0.0, ["weight", "held"])
        d = d.join(moved.groupBy(*keys).agg((F.sum(F.abs(F.col("weight") - F.col("held"))) / 2).alias("turnover")), keys, "left")
    d = d.withColumn("turnover", F.when(F.col("total").isNotNull(), F.col("turnover")))
    broken = (F.abs(F.col("total") - 1) > TOLERANCE).cast("int") + (F.col("least") < -TOLERANCE).cast("int") + (F.col("most") > F.col("max_weight") + TOLERANCE).cast("int")
    d = d.withColumn("violations", F.coalesce(broken, F.lit(0)))
    holds = F.col("total").isNotNull() & (F.col("violations") == 0)
    d = d.withColumn("status", F.when(F.col("blocked").isNotNull(), "blocked").when(holds, "feasible").otherwise("infeasible"))
    against = F.array_compact(F.array(F.when(F.col("status") != "feasible", INFEASIBLE), F.when(F.col("violations") > 0, BROKEN), F.when(F.col("needs_income"), NO_INCOME), F.lit(NO_COST)))
    named = F.concat_ws("-", F.concat(F.lit("profile_"), "profile"), F.substring(F.sha2(F.concat_ws("|", F.lit(VERSION), "portfolio", "objectives", "max_weight", "members"), 256), 1, 24))
    return d.select("portfolio", "profile", named.alias("candidate_id"), "status", F.coalesce("blocked", "reason", F.lit("")).alias("reason"), "violations", "listings", "dates", "variance", "equal_weight_variance", "inverse_volatility_variance", "concentration", "turnover", (F.col("turnover") > F.col("max_turnover")).alias("above_turnover_limit"), "max_drawdown", "max_cvar", "max_turnover", F.concat_ws(",", against).alias("disadvantages"))


def ranked(m: DataFrame, found: DataFrame) -> DataFrame:
    """portfolio, profile, rank by the compounded return of a profile's weights over the portfolio's dates; ties share a rank."""
    daily = m.join(found.filter("weight IS NOT NULL"), ["portfolio", "listing"]).groupBy("portfolio", "profile", "date").agg(F.sum(F.col("weight") * F.col("simple")).alias("r"))
    total = daily.groupBy("portfolio", "profile").agg(nearest(F.sum(F.log1p("r")), 9).alias("total"))
    return total.select("portfolio", "profile", F.rank().over(Window.partitionBy("portfolio").orderBy(F.desc_nulls_last("total"))).alias("rank"))


def recommendation(report: DataFrame, ranks: DataFrame) -> DataFrame:
    """portfolio, slot, candidate_id, profile of the five slots; null where no feasible candidate fills one.

    report are rows (portfolio, profile, candidate_id, status, variance). Ties go to the least candidate_id.
    """
    d = report.join(ranks, ["portfolio", "profile"], "left").withColumn("c", F.struct("candidate_id", "profile"))
    good = F.col("status") == "feasible"

    def least(where: Column, *by: str) -> Column:
        return F.min(F.when(good & where, F.struct(*by, "c")))["c"]

    slots = [least(F.col("profile") == p.name) for p in (DEFENSIVE, BALANCED, INCOME)] + [least(F.col("variance").isNotNull(), "variance"), least(F.col("rank").isNotNull(), "rank")]
    wide = d.groupBy("portfolio").agg(*(x.alias(s) for s, x in zip(SLOTS, slots, strict=True)))
    return wide.select("portfolio", F.explode(F.array(*(F.struct(F.lit(s).alias("slot"), F.col(s).alias("c")) for s in SLOTS))).alias("x")).select("portfolio", "x.slot", "x.c.candidate_id", "x.c.profile")
