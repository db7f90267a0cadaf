"""Profiles, reports and recommendations against the operators of one portfolio, numpy and hand-made rows."""

import numpy as np
import pandas as pd
import pytest

from quartzfolio.operators import portfolio, profiles, solvers

DAYS = pd.date_range("2020-01-01", periods=60).date
NAMES = [f"L{i}" for i in range(8)]


def returns():
    """A (8 listings), B (3 of them), C with two dates only, D with a listing that misses the first ten dates."""
    rng = np.random.default_rng(5)
    x = rng.normal(0.0005, 1, (60, 8)) * np.linspace(0.005, 0.03, 8) + rng.normal(0, 0.01, (60, 1))
    out = [("A", d, n, float(x[i, j])) for i, d in enumerate(DAYS) for j, n in enumerate(NAMES)]
    out += [("B", d, n, float(x[i, j])) for i, d in enumerate(DAYS) for j, n in enumerate(NAMES[:3])]
    out += [("C", d, n, float(x[i, j])) for i, d in enumerate(DAYS[:2]) for j, n in enumerate(NAMES[:6])]
    return out + [("D", d, n, float(x[i, j])) for i, d in enumerate(DAYS) for j, n in enumerate(NAMES[:5]) if j or i >= 10]


@pytest.fixture(scope="module")
def parts(spark):
    rets = spark.createDataFrame(returns(), "portfolio string, date date, listing string, simple double").checkpoint()
    m = profiles.matrices(rets).checkpoint()
    size = profiles.sizes(rets, m).checkpoint()
    m = profiles.eligible(m, size).checkpoint()
    model = profiles.models(m).checkpoint()
    return m, size, model, profiles.candidates(m, model).checkpoint()


def test_sizes_say_what_has_no_model(parts):
    got = {r.portfolio: (r.listings, r.dates, r.reason) for r in parts[1].collect()}
    assert got == {"A": (8, 60, None), "B": (3, 60, None), "C": (6, 2, "insufficient_history"), "D": (5, 50, None)}


def test_models_equal_those_of_each_portfolio_alone(parts):
    m, _, model, _ = parts
    for name in "ABD":
        alone = m.filter(m.portfolio == name).drop("portfolio")
        sample = {(r.left, r.right): r.covariance for r in portfolio.covariance(alone).collect()}
        shrunk = {(r.left, r.right): (r.covariance, r.intensity) for r in portfolio.covariance_ledoit_wolf(alone).collect()}
        got = model.filter(model.portfolio == name).collect()
        assert {(r.left, r.right) for r in got} == set(sample)
        for r in got:
            assert r.covariance == pytest.approx(sample[r.left, r.right], abs=1e-15)
            assert (r.shrunk, r.intensity) == pytest.approx(shrunk[r.left, r.right], abs=1e-12)


def test_weights_keep_bounds_and_are_least_in_their_objective(parts):
    m, _, model, found = parts
    rows = found.toPandas()
    assert set(rows[rows.weight.isna()][["portfolio", "profile", "reason"]].itertuples(index=False, name=None)) == {("B", p.name, "infeasible_bounds") for p in profiles.PROFILES} | {("D", "defensive", "infeasible_bounds")}
    for p in profiles.PROFILES:
        for name in "AD":
            w = rows[(rows.portfolio == name) & (rows.profile == p.name)].sort_values("listing").weight.to_numpy()
            if not np.isnan(w).any():
                assert w.sum() == pytest.approx(1) and w.min() >= -1e-9 and w.max() <= p.max_weight + 1e-9
    s = model.filter("portfolio = 'A'").toPandas().pivot(index="left", columns="right", values="shrunk").to_numpy()
    r = m.filter("portfolio = 'A'").toPandas().pivot(index="date", columns="listing", values="simple").to_numpy()
    of = {p: rows[(rows.portfolio == "A") & (rows.profile == p)].sort_values("listing").weight.to_numpy() for p in ("defensive", "income")}
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = rng.dirichlet(np.ones(8))
        a, b = solvers.project(x, 0, 0.15), solvers.project(x, 0, 0.2)
        assert of["defensive"] @ s @ of["defensive"] <= a @ s @ a + 1e-9
        assert np.sort(-(r @ of["income"]))[-3:].mean() <= np.sort(-(r @ b))[-3:].mean() + 1e-4


def test_solvers_say_whether_they_settled():
    rng = np.random.default_rng(2)
    r = rng.normal(0, 0.01, (80, 6)) * np.arange(1, 7)
    s = np.cov(r.T)
    assert solvers.variance_descent(s)[1] and solvers.risk_descent(s)[1] and solvers.cvar_descent(r)[1]
    assert not solvers.variance_descent(s, steps=1)[1] and not solvers.risk_descent(s, steps=1)[1]
    assert not solvers.cvar_descent(r, steps=4, tolerance=0)[1]


def test_reports(spark, parts):
    _, size, model, found = parts
    held = spark.createDataFrame([("A", n, 0.5) for n in ("L0", "gone")], "portfolio string, listing string, weight double")
    got = {(r.portfolio, r.profile): r for r in profiles.reports(found, model, size, held).collect()}
    assert set(got) == {(a, p.name) for a in "ABCD" for p in profiles.PROFILES}
    assert {k: r.status for k, r in got.items()} == {(a, p.name): {"A": "feasible", "B": "infeasible", "C": "blocked", "D": "infeasible" if p.name == "defensive" else "feasible"}[a] for a in "ABCD" for p in profiles.PROFILES}
    assert got["C", "growth"].reason == "insufficient_history" and got["B", "growth"].reason == "infeasible_bounds" and got["A", "growth"].reason == ""
    w = {r.listing: r.weight for r in found.filter("portfolio = 'A' AND profile = 'growth'").collect()}
    c = {(r.left, r.right): r.covariance for r in model.filter("portfolio = 'A'").collect()}
    row = got["A", "growth"]
    assert row.variance == pytest.approx(sum(w[i] * w[j] * v for (i, j), v in c.items()))
    assert row.equal_weight_variance == pytest.approx(sum(c.values()) / 64)
    assert row.concentration == pytest.approx(sum(x * x for x in w.values()))
    assert row.turnover == pytest.approx((abs(w["L0"] - 0.5) + sum(w.values()) - w["L0"] + 0.5) / 2) and row.above_turnover_limit
    assert row.disadvantages == profiles.NO_COST and got["A", "income"].disadvantages == f"{profiles.NO_INCOME},{profiles.NO_COST}"
    assert got["B", "growth"].variance is None and got["B", "growth"].turnover is None and got["B", "growth"].above_turnover_limit is None and got["B", "growth"].disadvantages == f"{profiles.INFEASIBLE},{profiles.NO_COST}"
    bad = spark.createDataFrame([("A", "growth", "L0", 0.7, None), ("A", "growth", "L1", 0.2, None)], found.schema)
    row = next(r for r in profiles.reports(bad, model, size).collect() if (r.portfolio, r.profile) == ("A", "growth"))
    assert (row.status, row.violations, row.turnover) == ("infeasible", 2, None)


def test_recommendation_by_hand(spark):
    report = [("P", "defensive", "d", "infeasible", None), ("P", "balanced", "b", "feasible", 2.0), ("P", "income", "c", "feasible", 1.0), ("P", "growth", "a", "feasible", 1.0), ("Q", "growth", "g", "blocked", None)]
    report = spark.createDataFrame(report, "portfolio string, profile string, candidate_id string, status string, variance double")
    ranks = spark.createDataFrame([("P", "balanced", 1), ("P", "growth", 2), ("P", "defensive", 0)], "portfolio string, profile string, rank int")
    got = {(r.portfolio, r.slot): (r.candidate_id, r.profile) for r in profiles.recommendation(report, ranks).collect()}
    want = [(None, None), ("b", "balanced"), ("c", "income"), ("a", "growth"), ("b", "balanced")]
    assert got == {**{("P", s): w for s, w in zip(profiles.SLOTS, want, strict=True)}, **{("Q", s): (None, None) for s in profiles.SLOTS}}
    assert profiles.recommendation(report.limit(0), ranks).count() == 0


def test_ids_hang_on_members_and_bounds(spark, parts):
    _, size, model, found = parts
    a = {r.candidate_id for r in profiles.reports(found, model, size).collect()}
    again = {r.candidate_id for r in profiles.reports(found.repartition(7), model, size).collect()}
    assert a == again and len(a) == 16


def test_profiles_are_checked():
    with pytest.raises(ValueError):
        profiles.Profile("x", (), 0.1, 0.1, 0.1, 0.1)
    with pytest.raises(ValueError):
        profiles.Profile("x", ("maximum_sharpe",), 0.1, 0.1, 0.1, 0.1)
    with pytest.raises(ValueError):
        profiles.Profile("x", ("minimum_cvar",), 0.0, 0.1, 0.1, 0.1)
