"""Hand-computed fixtures and invariants."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzfolio.operators import pairs, portfolio, selection, series, solvers
from quartzfolio.sources import tables

DAY = datetime.date


def quotes(spark, prices, listing="A"):
    return spark.createDataFrame([(listing, DAY(2026, 1, 1) + datetime.timedelta(days=k), float(p), k) for k, p in enumerate(prices)], "listing string, date date, px double, seq long")


def test_returns_and_drawdown(spark):
    q = quotes(spark, [100, 110, 99, 120])
    r = series.distribution(series.returns(q)).first()
    assert r.n == 3 and r.positive_day_ratio == pytest.approx(2 / 3) and r.cumulative_log_return == pytest.approx(0.1823215568)
    assert series.max_drawdown(q).first().max_drawdown == pytest.approx(-0.10)


def test_quarantine(spark):
    d = [("A", DAY(2026, 1, 1), 100.0, 0), ("A", DAY(2026, 1, 2), 0.0, 1), ("A", DAY(2026, 1, 2), -5.0, 2), ("A", DAY(2026, 1, 3), 110.0, 3)]
    q = spark.createDataFrame(d, "listing string, date date, px double, seq long")
    assert [r.reason for r in series.judged(q).orderBy("seq").collect()] == [None, "non_positive_price", "duplicate_date", None]
    r = series.returns(series.valid(q)).collect()
    assert len(r) == 1 and r[0].date == DAY(2026, 1, 3)


@pytest.mark.parametrize(("dates", "kind"), [(["2026-01-15", "2026-02-15", "2026-03-15", "2026-04-15"], "monthly"), (["2026-01-15"], "unknown"), (["2026-01-15", "2026-04-15", "2026-07-15"], "quarterly"), (["2026-01-15", "2026-07-15", "2027-01-15"], "semiannual"), (["2026-01-15", "2027-01-15", "2028-01-15"], "annual"), (["2026-01-15", "2026-03-01", "2027-01-15"], "irregular")])
def test_payout_frequency(spark, dates, kind):
    d = spark.createDataFrame([("A", DAY.fromisoformat(x), 1.0) for x in dates], "listing string, date date, value double")
    assert series.payout_frequency(d).first().frequency == kind


def test_pairs(spark):
    rows = [(k, DAY(2026, 1, 1 + i), v) for k, vs in (("IE1", (0.01, 0.02, 0.03)), ("IE2", (0.03, 0.02, 0.01))) for i, v in enumerate(vs)] + [("IE3", DAY(2026, 1, 2), 0.10)]
    r = {(x.left, x.right): x for x in pairs.moments(pairs.aligned(spark.createDataFrame(rows, "listing string, date date, ret double"))).collect()}
    assert len(r) == 3
    x = r["IE1", "IE2"]
    assert (x.n, x.pearson, x.covariance, x.beta_left) == (3, pytest.approx(-1), pytest.approx(-0.0001), pytest.approx(-1))
    assert r["IE1", "IE3"].pearson == 0
    with pytest.raises(ValueError, match="exceed"):
        pairs.guarded(2000)


def test_clusters(spark):
    d = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("c", "d", 0.1), ("d", "e", 0.75)], "left string, right string, pearson double")
    assert {r.listing: r.cluster for r in pairs.clusters(d).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_matrix_and_portfolio(spark):
    rows = [("IE1", DAY(2026, 7, 11), 0.0, 0.10), ("IE1", DAY(2026, 7, 12), 0.0, 0.05), ("IE2", DAY(2026, 7, 11), 0.0, -0.02), ("IE2", DAY(2026, 7, 12), 0.0, 0.0), ("IE2", DAY(2026, 7, 13), 0.0, 0.5)]
    m = portfolio.matrix(spark.createDataFrame(rows, "listing string, date date, ret double, simple double"))
    assert m.count() == 4
    r = portfolio.rebalance(m, portfolio.equal_weights(m)).orderBy("date").collect()
    assert [x.value for x in r] == [pytest.approx(1.04), pytest.approx(1.066)] and [x.rebalanced for x in r] == [True, False]
    assert r[0].turnover == pytest.approx(0.028846153846)


def test_drawdown_durations(spark):
    r = spark.createDataFrame([(DAY(2026, 1, k + 1), x) for k, x in enumerate((0.1, -0.1, -0.1, 0.5, 0.1))], "date date, r double")
    got = portfolio.drawdowns(r).orderBy("date").collect()
    assert [x.duration for x in got] == [0, 1, 2, 0, 0] and [x.recovery_duration for x in got] == [0, 0, 0, 2, 0]


def test_two_asset_solution(spark):
    s = np.array([[0.04, 0.01], [0.01, 0.09]])
    assert solvers.min_variance(s) == pytest.approx([0.72727, 0.27273], abs=1e-3)
    cov = spark.createDataFrame([("p", "a", "a", 0.04), ("p", "a", "b", 0.01), ("p", "b", "a", 0.01), ("p", "b", "b", 0.09)], "portfolio string, left string, right string, covariance double")
    assert sum(r.weight for r in solvers.balanced(cov, cov).collect()) == pytest.approx(1)
    with pytest.raises(ValueError, match="missing"):
        portfolio.complete(cov.filter("left <> 'b' OR right <> 'a'"))


def test_solver_invariants():
    r = np.random.default_rng(1).normal(0, 0.01, (300, 5)) * np.arange(1, 6)
    s = np.cov(r.T)
    for solve in solvers.SOLVERS.values():
        w = solve(s)
        assert w.sum() == pytest.approx(1) and (w >= -1e-12).all()
    assert solvers.min_variance(s) @ s @ solvers.min_variance(s) <= 0.2 * np.ones(5) @ s @ (0.2 * np.ones(5))
    w = solvers.equal_risk(s)
    assert (w * (s @ w) / (w @ s @ w)) == pytest.approx([0.2] * 5, abs=0.01)

    def cvar(w):
        loss = np.sort(-(r @ w))
        return loss[-15:].mean()

    assert cvar(solvers.min_cvar(r)) <= min(cvar(e) for e in np.eye(5)) + 1e-12


def test_online_spearman(spark):
    rng = random.Random(3)
    xs = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(40)]
    rows = [("a", "b", DAY(2026, 1, 1) + datetime.timedelta(days=k), x, y) for k, (x, y) in enumerate(xs)]
    got = pairs.spearman_online(spark.createDataFrame(rows, "left string, right string, date date, x double, y double")).first().spearman

    def scores(v):
        return [0.0 if k < 2 else (v[k] - np.mean(v[:k])) / np.std(v[:k], ddof=1) for k in range(len(v))]

    assert got == pytest.approx(np.corrcoef(scores([x for x, _ in xs]), scores([y for _, y in xs]))[0, 1])


def test_predicates(spark):
    d = spark.createDataFrame([(1.0, "Große  Straße"), (None, "x")], "n double, name string")
    assert selection.matching(d, ["name ~ GROSSE STRASSE", "n >= 1"]).count() == 1
    assert selection.matching(d, ["n != 5"]).count() == 1
    with pytest.raises(ValueError, match="unknown"):
        selection.condition("nope = 1", d.columns)
    some = selection.selection_id("My Name", ["b = 1", "a ~ x"])
    assert some.startswith("my_name-") and len({some, selection.selection_id("my name", ["b = 1", "a ~ x"]), selection.selection_id("My Name", ["a ~ x", "b = 1"]), selection.selection_id("My Name", ["b = 1", "a ~ x"], "univariate")}) == 4
    assert selection.selection_id(None, []).startswith("all-") and selection.selection_id("--", []).startswith("selection-")


def test_tables(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert tables.read_rows(spark, str(tmp_path / "none"), "k long").count() == 0
    tables.write_rows(d, str(tmp_path / "t"), ("k",))
    tables.write_rows(spark.createDataFrame([(2, "c")], "k long, v string"), str(tmp_path / "t"), ("k",))
    back = tables.read_rows(spark, str(tmp_path / "t"), "v string, k long")
    assert {(r.k, r.v) for r in back.collect()} == {(1, "a"), (2, "c")}
    assert tables.content_id(d, ["k"]) == tables.content_id(d.orderBy(F.desc("k")), ["k"]) != tables.content_id(d.limit(1), ["k"])
    (tmp_path / "c.json").write_text('{"responses": [{"x": 1}, {"x": 2}]}')
    assert tables.read_candidates(spark, str(tmp_path / "c.json")).count() == 2


def test_stream(spark, tmp_path):
    from quartzfolio.streaming import quotes as stream

    rows = [("A", datetime.datetime(2026, 1, 1, 9), 1.0), ("A", datetime.datetime(2026, 1, 1, 17), 3.0), ("A", datetime.datetime(2026, 1, 2, 9), 2.0)]
    spark.createDataFrame(rows, "listing string, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("listing string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = stream.daily_bars(src).writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.date.day, r.open, r.close, r.n) for r in spark.table("bars").collect()} == {(1, 1.0, 3.0, 2), (2, 2.0, 2.0, 1)}
    merge = stream.merge_into(spark, str(tmp_path / "store"))
    merge(spark.createDataFrame([("A", DAY(2026, 1, 1), 1.0, 0), ("A", DAY(2026, 1, 1), 2.0, 1)], stream.SCHEMA), 0)
    merge(spark.createDataFrame([("A", DAY(2026, 1, 1), 5.0, 0)], stream.SCHEMA), 1)
    assert [r.px for r in stream.stored(spark, str(tmp_path / "store")).collect()] == [5.0]
    january = {p.name for p in (tmp_path / "store" / "rows").glob("month=2026-01/*.parquet")}
    for _ in range(2):  # a batch that is run again changes nothing
        merge(spark.createDataFrame([("B", DAY(2026, 2, 1), 7.0, 0)], stream.SCHEMA), 2)
    assert {(r.listing, r.px) for r in stream.stored(spark, str(tmp_path / "store")).collect()} == {("A", 5.0), ("B", 7.0)}
    assert {p.name for p in (tmp_path / "store" / "rows").glob("month=2026-01/*.parquet")} == january and not list((tmp_path / "store" / "_aside").glob("*"))


def test_order_sizes(spark):
    t = spark.createDataFrame([("a", 0.5, 30.0), ("b", 0.5, 1e9)], "listing string, weight double, px double")
    got = {r.listing: (r.quantity, r.side) for r in portfolio.order_sizes(t, 1000, 0.1).collect()}
    assert got == {"a": (math.floor(450 / 30), "BUY"), "b": (0, "SKIP")}


def test_compounding_through_a_total_loss(spark):
    import datetime

    r = spark.createDataFrame([(datetime.date(2020, 1, k + 1), x) for k, x in enumerate([0.1, -1.0, 0.1])], "date date, r double")
    assert [round(x.wealth, 9) for x in portfolio.drawdowns(r).orderBy("date").collect()] == [1.1, 0.0, 0.0]
    below = spark.createDataFrame([(datetime.date(2020, 1, k + 1), x) for k, x in enumerate([0.5, -3.0, -3.0])], "date date, r double")
    assert [round(x.wealth, 9) for x in portfolio.drawdowns(below).orderBy("date").collect()] == [1.5, -3.0, 6.0]
    assert portfolio.worst_window(r, 2).first().compounded == -1.0


def test_holidays(spark):
    import datetime

    from pyspark.sql import functions as F

    from quartzfolio.functions import exprs

    def computus(y):  # by the paschal full moon of the Gregorian lunar tables
        golden, century = y % 19 + 1, y // 100 + 1
        full = 44 - (11 * golden + 20 + (8 * century + 5) // 25 - 5 - (3 * century // 4 - 12)) % 30
        epact = (11 * golden + 20 + (8 * century + 5) // 25 - 5 - (3 * century // 4 - 12)) % 30
        epact += epact == 24 or (epact == 25 and golden > 11)
        full = 44 - epact + 30 * (44 - epact < 21)
        sunday = full + 7 - (5 * y // 4 - (3 * century // 4 - 12) - 10 + full) % 7
        return datetime.date(y, 3, 1) + datetime.timedelta(days=sunday - 1)

    got = {r.y: r.d for r in spark.range(1900, 2100).select(F.col("id").alias("y"), exprs.easter(F.col("id").cast("int")).alias("d")).collect()}
    assert got == {y: computus(y) for y in range(1900, 2100)}
    days = [("2024-03-29", False), ("2024-04-01", False), ("2024-05-20", False), ("2024-10-03", False), ("2024-12-31", False), ("2024-04-02", True), ("2024-04-06", False)]
    d = spark.createDataFrame(days, "day string, open boolean").select(F.col("day").cast("date").alias("day"), "open")
    assert all(r.x == r.open for r in d.select("open", exprs.trading_day(F.col("day"), F.lit("xetra")).alias("x")).collect())
    assert d.filter(exprs.trading_day(F.col("day"), F.lit("LSE"))).count() == 6


def test_trailing_yield_of_a_listing_that_stopped_paying(spark):
    quotes = spark.createDataFrame([("a", "2020-01-01", 10.0), ("a", "2022-01-01", 20.0), ("b", "2022-01-01", 50.0), ("c", "2022-01-01", 0.0)], "listing string, date string, px double").selectExpr("listing", "CAST(date AS DATE) AS date", "px")
    paid = spark.createDataFrame([("a", "2020-01-01", 5.0), ("b", "2021-01-01", 1.0), ("b", "2021-01-02", 2.0), ("b", "2022-01-01", 3.0), ("b", "2022-01-02", 9.0), ("c", "2022-01-01", 1.0)], "listing string, date string, value double").selectExpr("listing", "CAST(date AS DATE) AS date", "value")
    got = {r.listing: (r.annual_amount, r.payouts, r.annual_yield) for r in series.trailing_payout(paid, quotes).collect()}
    assert got == {"a": (0.0, 0, 0.0), "b": (5.0, 2, 0.1), "c": (1.0, 1, 0.0)}


def test_pairs_of_one_isin_and_too_many(spark):
    rows = [(x, f"2020-01-0{k}", 0.1 * k, i) for x, i in (("a", "I"), ("b", "I"), ("c", "J")) for k in range(1, 4)]
    r = spark.createDataFrame(rows, "listing string, date string, ret double, isin string")
    assert {(p.left, p.right) for p in pairs.aligned(r).select("left", "right").distinct().collect()} == {("a", "c"), ("b", "c")}
    with pytest.raises(ValueError):
        pairs.aligned(r, most=2)


def test_prices_are_rounded_as_in_sql(spark):
    """Doubles next to a tie: seven decimals that end with 5, or more decimals than digits."""
    import duckdb

    from quartzfolio.functions.exprs import nearest, rounded

    values = [(k * 2 + 1) / 320000 * n for n in (1, 3217, 65963) for k in range(3000)] + [2061.3371875, 265.4315625, 1e-9, 0.0, 1e300, float("inf"), None]
    values += [-v for v in values if v is not None]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double").withColumns({"y": nearest(F.col("x"), 6), "z": nearest(F.col("x"), 12)})
    con = duckdb.connect()
    want = con.execute("SELECT round(x, 6), round(x, 12) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()
    assert [(r.y, r.z) for r in d.orderBy("i").collect()] == want
    assert [r.x for r in rounded(d.select("i", "x")).orderBy("i").collect()] == [v if v is None else v + 0.0 for v, _ in want]


def test_missing_pairs_beyond_the_guard(spark, monkeypatch):
    """All pairs are counted, over several blocks and products, with repeated sets of dates and none."""
    monkeypatch.setattr(pairs, "MAX_PAIRS", 10)
    for name, size in (("ROWS", 3), ("DATES", 4)):
        monkeypatch.setattr(pairs, name, size)
    r = random.Random(5)
    have = {f"L{k}": {d for d in range(40) if r.random() < 0.12} for k in range(60)}
    have |= {f"M{k}": have["L7"] for k in range(5)} | {"one": {3}, "same": {3}, "none": {None}}
    rows = [(k, None if d is None else DAY(2026, 1, 1) + datetime.timedelta(days=d), 0.1) for k, days in have.items() for d in days]
    d = spark.createDataFrame([*rows, *rows[:9], (None, DAY(2026, 1, 1), 0.1)], "listing string, date date, ret double")
    names = sorted({k for k, _, _ in rows})
    for least in (1, 2, 4):
        want = sum(len((have[a] & have[b]) - {None}) < least for i, a in enumerate(names) for b in names[i + 1 :])
        assert pairs.missing(d, least).first().missing_pairs == want
    assert pairs.missing(d.limit(0)).first().missing_pairs == 0


def test_quality_gate_sorts_once(spark):
    """Against the rules by hand on random quotes; one shuffle and one sort."""
    import re

    r = random.Random(9)
    rows = [(f"L{k % 7}" if k % 50 else None, DAY(2026, 1, 1) + datetime.timedelta(days=r.randrange(4 + 60 * (k % 7))) if r.random() > 0.02 else None, r.choice([0.0, None, 1.0, 1.0, 1.0, 2.0]) if k % 7 < 4 else r.choice([3.0, 3.0, 4.0]), k) for k in range(600)]
    d = spark.createDataFrame(rows, "listing string, date date, px double, seq long")
    want = {}
    for name in {x[0] for x in rows}:
        mine = sorted((x[1] or DAY(1, 1, 1), x[3], x[2], x[1]) for x in rows if x[0] == name)
        dup = [i > 0 and x[0] == mine[i - 1][0] for i, x in enumerate(mine)]
        bad = [not a and (x[2] is None or x[2] <= 0) for a, x in zip(dup, mine, strict=True)]
        ok = [x for a, b, x in zip(dup, bad, mine, strict=True) if not a and not b and name is not None]
        run = best = 0
        for i, x in enumerate(ok):
            run = run + 1 if i and x[2] == ok[i - 1][2] else 1
            best = max(best, run)
        gap = any(b[3] and a[3] and (b[3] - a[3]).days > 10 for a, b in zip(ok, ok[1:], strict=False))
        want[name] = (len(mine), sum(dup) + sum(bad), any(bad), any(dup), best >= 5, max(0, len(ok) - 1), gap)
    got = series.quality_gate(d)
    assert {x.listing: (x.quotes, x.quarantined, x.bad, x.dup, x.stale, x.observations, x.gap) for x in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and len(re.findall(r"Sort \[", plan)) == 1
