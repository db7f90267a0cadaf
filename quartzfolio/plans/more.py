"""Second part of the queries: gates, features, diagnostics, stress by covariance, plans."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions.exprs import nearest
from ..operators import pairs, portfolio, selection, series
from ..sources import adapters
from . import queries as q

query, _z = q.query, q._z
AS_OF = "1998-12-31"


@query(q._JUDGED + """, v AS (SELECT listing, date, px FROM j WHERE reason IS NULL), l AS (SELECT *, lag(px) OVER w AS p, lag(date) OVER w AS d FROM v WINDOW w AS (PARTITION BY listing ORDER BY date)),
  i AS (SELECT *, sum(CASE WHEN p = px THEN 0 ELSE 1 END) OVER (PARTITION BY listing ORDER BY date) AS i FROM l), s AS (SELECT listing, max(n) >= 5 AS stale FROM (SELECT listing, i, count(*) AS n FROM i GROUP BY ALL) GROUP BY listing),
  g AS (SELECT listing, count(*) - 1 AS n, coalesce(bool_or(date - d > 10), false) AS gap FROM l GROUP BY listing),
  b AS (SELECT listing, count(*) AS quotes, count(reason) AS quarantined, bool_or(coalesce(reason = 'non_positive_price', false)) AS bad, bool_or(coalesce(reason = 'duplicate_date', false)) AS dup FROM j GROUP BY listing),
  t AS (SELECT listing, quotes, quarantined, bad, dup, coalesce(stale, false) AS stale, coalesce(gap, false) AS gap, coalesce(n, 0) AS observations FROM b LEFT JOIN s USING (listing) LEFT JOIN g USING (listing))
  SELECT *, CASE WHEN bad THEN 'non_positive_price' WHEN dup THEN 'duplicate_date' WHEN stale THEN 'stale_price' WHEN gap THEN 'unexplained_gap' WHEN observations < 252 THEN 'insufficient_history' ELSE 'ok' END AS data_quality_reason FROM t""")
def quality_gate(spark, d):
    return series.quality_gate(q._raw(spark, d))


@query(f"""WITH {q._quotes('supplier')}, {q._R}, a AS (SELECT listing, min(date) AS first_date, max(date) AS last_date, count(*) AS quotes, max_by(px, date) / min_by(px, date) - 1 AS tr FROM q GROUP BY listing),
  b AS (SELECT listing, count(*) AS returns, avg(ret) AS mu, coalesce(stddev_samp(ret), 0) AS sd FROM r GROUP BY listing), dd AS (SELECT listing, min(d) AS dd FROM (SELECT listing, px / max(px) OVER (PARTITION BY listing ORDER BY date) - 1 AS d FROM q) GROUP BY listing)
  SELECT listing, first_date, last_date, quotes, coalesce(returns, 0) AS returns, {_z('tr')} AS total_return, CASE WHEN last_date > first_date THEN {_z('pow(1 + tr, 365.25::DOUBLE / nullif(last_date - first_date, 0)) - 1')} ELSE 0.0::DOUBLE END AS cagr,
  {_z('coalesce(exp(mu * 252) - 1, 0)')} AS geometric_return, {_z('coalesce(mu, 0)')} AS mean_return, {_z('coalesce(sd, 0)')} AS volatility, {_z('dd')} AS max_drawdown FROM a LEFT JOIN b USING (listing) LEFT JOIN dd USING (listing)""")
def asset_features(spark, d):
    return series.asset_features(q._quoted("supplier", spark, d))


@query(f"""WITH p AS (SELECT o_custkey AS listing, count(DISTINCT CAST(o_orderdate AS DATE)) AS events, CAST(max(CAST(o_orderdate AS DATE)) - min(CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders WHERE o_totalprice > 0 GROUP BY 1)
  SELECT listing, events, CASE WHEN events = 1 THEN 1.0::DOUBLE ELSE {_z('(events - 1)::DOUBLE / greatest(days, 1) * 365.25::DOUBLE')} END AS events_per_year FROM p""")
def distribution_rate(spark, d):
    return series.payout_rate(adapters.dividends(spark, d))


@query(f"""{q._DAYS}, h AS (SELECT listing, min(gap_start) AS s FROM g WHERE gap_start <= DATE '{AS_OF}' GROUP BY listing), n2 AS (SELECT listing, min(CAST(b + k AS DATE)) AS t FROM e, (SELECT CAST(unnest(range(1, 11)) AS INT) AS k) WHERE isodow(CAST(b + k AS DATE)) < 6 AND CAST(b + k AS DATE) NOT IN (SELECT day FROM closed) GROUP BY listing)
  SELECT listing, CAST(coalesce(s, t) AS DATE) AS start_date, DATE '{AS_OF}' AS end_date, CASE WHEN s IS NULL THEN 'tail' ELSE 'gap_backfill' END AS window_reason FROM n2 LEFT JOIN h USING (listing) WHERE s IS NOT NULL OR t <= DATE '{AS_OF}'""")
def gap_refetch_plan(spark, d):
    return series.gap_plan(q._quoted("nation", spark, d), AS_OF, "XETRA")


@query(f"""WITH {q._quotes('supplier')}, {q._R}, s AS (SELECT listing, count(*) AS n, coalesce(stddev_samp(ret), 0) AS daily_std FROM r GROUP BY listing)
  SELECT listing, n, {_z('daily_std')} AS daily_std FROM s WHERE (n BETWEEN 400 AND 520 OR n BETWEEN 540 AND 700) AND daily_std BETWEEN 0 AND 10""")
def project_range_filter(spark, d):
    return selection.in_ranges(series.distribution(q._rets("supplier", spark, d)), {"n": [(400, 520), (540, 700)], "daily_std": [(0, 10)]}).select("listing", "n", "daily_std")


_BOTH = ("CASE WHEN x < 0 AND y < 0 THEN x END", "CASE WHEN x < 0 AND y < 0 THEN y END")


@query(f"""{q._PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY l, r) AS n FROM pr),
  g AS (SELECT DISTINCT l, r, n, least(60, n) AS size, greatest(1, least(60, n) // 3) AS step FROM k WHERE n >= 20), s AS (SELECT DISTINCT l, r, size, unnest(list_append(range(0, n - size + 1, step), n - size)) AS s FROM g),
  c AS (SELECT l, r, s, {q._CORR.format(*_BOTH)} AS c FROM k JOIN s USING (l, r) WHERE i >= s AND i < s + size GROUP BY l, r, s) SELECT l AS "left", r AS "right", count(*) AS windows, {_z('coalesce(stddev_samp(c), 0)')} AS stability FROM c GROUP BY l, r""")
def pair_rolling_downside(spark, d):
    return pairs.rolling_stability(q._pairs(spark, d), downside=True)


@query(f"""{q._PAIRS}, {q._MOM}, a AS (SELECT x, avg(c) AS a FROM (SELECT l AS x, c FROM mo UNION ALL SELECT r, c FROM mo) GROUP BY x)
  SELECT max_by(x, a) AS most_correlated, {_z('max(a)')} AS most_correlated_average, min_by(x, a) AS best_diversifier, {_z('min(a)')} AS best_diversifier_average FROM a""")
def correlation_extremes(spark, d):
    return pairs.extremes(q._moments(spark, d))


@query(f"""{q._PAIRS}, c AS (SELECT l, r, count(*) FILTER (x < 0 AND y < 0) AS n, {q._CORR.format(*_BOTH)} AS c, {q._CORR.format('x', 'y')} AS p FROM pr GROUP BY l, r)
  SELECT count(*) AS n, {_z('avg(c - p)')} AS average_gap, count(*) FILTER (abs(c - p) >= 0.15) AS large_gaps, {_z('max(c)')} AS worst, {_z('median(n)')} AS median_days, min(n) AS min_days FROM c""")
def downside_diagnostics(spark, d):
    return pairs.downside_diagnostics(q._pairs(spark, d))


@query(f"""{q._PORT}, {q._TAIL.format(key="'all' AS", x='r', t='p')} SELECT 'all' AS portfolio, {_z('var')} AS value_at_risk, {_z('es')} AS cvar, k AS tail_count FROM tl""")
def portfolio_tail_risk(spark, d):
    return portfolio.tail_risk(q._portfolio(spark, d))


_NORMAL = NormalDist().inv_cdf(0.95)
_STRESS = f"""{q._W}, v AS (SELECT l AS k, sqrt(c) AS s FROM cv WHERE l = r), cc AS (SELECT l, r, (c / (a.s * b.s) + (1 - c / (a.s * b.s)) * 0.5::DOUBLE) * a.s * b.s AS c FROM cv JOIN v a ON l = a.k JOIN v b ON r = b.k),
  vs AS (SELECT 'correlation_convergence' AS scenario, sum(a.weight * b.weight * c) AS x FROM cc JOIN w a ON l = a.listing JOIN w b ON r = b.listing
         UNION ALL SELECT 'covariance_perturbation', sum(a.weight * b.weight * c) * 1.25::DOUBLE FROM cv JOIN w a ON l = a.listing JOIN w b ON r = b.listing),
  st AS (SELECT scenario, sqrt(x) AS volatility, sqrt(x) * {_NORMAL!r}::DOUBLE AS value_at_risk, sqrt(x) * {NormalDist().pdf(_NORMAL) / (1 - 0.95)!r}::DOUBLE AS cvar FROM vs)"""


def _stressed(spark, d):
    m = q._matrix(spark, d)
    return portfolio.parametric_tail(portfolio.covariance_scenarios(portfolio.covariance(m), portfolio.equal_weights(m), 0.5, 0.25))


@query(f"{_STRESS} SELECT scenario, {_z('volatility', 9)} AS volatility, {_z('value_at_risk', 9)} AS value_at_risk, {_z('cvar', 9)} AS cvar FROM st", 9)
def covariance_stress(spark, d):
    return _stressed(spark, d)


@query(f"{_STRESS} SELECT count(*) AS scenarios, {_z('median(cvar)', 9)} AS median_cvar, {_z('max(cvar)', 9)} AS worst_cvar FROM st", 9)
def sensitivity_summary(spark, d):
    return portfolio.sensitivity(_stressed(spark, d))


_BINS = "CAST(least(7, floor({0} / greatest(1, (SELECT max(annual) FROM y)) * 8)) AS INT)"


@query(f"""WITH {q._PAID}, y AS (SELECT listing, round(CASE WHEN px > 0 THEN amount / px ELSE 0 END, 6) AS annual FROM ttm), g AS (SELECT listing, date - lag(date) OVER (PARTITION BY listing ORDER BY date) AS gap FROM (SELECT DISTINCT listing, date FROM p WHERE value > 0)),
  f AS (SELECT listing, CASE WHEN count(*) < 2 THEN 'unknown' {q._BANDS.replace('lo >=', 'min(gap) >=').replace('hi <=', 'max(gap) <=')} ELSE 'irregular' END AS frequency FROM g GROUP BY listing)
  SELECT {_BINS.format('annual')} AS bin, frequency, count(*) AS n FROM y JOIN f USING (listing) GROUP BY 1, 2""")
def payout_histogram(spark, d):
    p = adapters.dividends(spark, d)
    y = series.trailing_payout(p, adapters.customer_quotes(spark, d)).select("listing", nearest("annual_yield", 6).alias("annual"))
    top = y.agg(F.greatest(F.lit(1.0), F.max("annual")).alias("top"))  # one row
    at = F.least(F.lit(7), F.floor(F.col("annual") / F.col("top") * 8)).cast("int")
    return y.join(F.broadcast(top)).join(series.payout_frequency(p).select("listing", "frequency"), "listing").groupBy(at.alias("bin"), "frequency").agg(F.count("*").alias("n"))
