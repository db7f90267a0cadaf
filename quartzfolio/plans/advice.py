"""Fifth part of the queries: models of many portfolios, profiles, their reports and recommendations.

The portfolios are the regions' nations and all nations, their returns those of month-end prices.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import profiles
from ..sources import adapters
from ..sources.tables import shared_dir
from . import queries as q

query, _z = q.query, q._z

_MONTHS = f"""WITH {q._quotes('nation')}, mq AS (SELECT listing, CAST(date_trunc('month', date) AS DATE) AS date, max_by(px, date) AS px FROM q GROUP BY 1, 2),
  r0 AS (SELECT listing, date, (px / lag(px) OVER (PARTITION BY listing ORDER BY date) - 1) * {adapters.SCALE} AS simple FROM mq WHERE px > 0),
  pf AS (SELECT r_name AS portfolio, listing, date, simple FROM r0 JOIN nation ON n_name = listing JOIN region ON n_regionkey = r_regionkey WHERE simple IS NOT NULL
         UNION ALL SELECT 'WORLD' AS portfolio, listing, date, simple FROM r0 WHERE simple IS NOT NULL),
  ct AS (SELECT portfolio, count(DISTINCT listing) AS n FROM pf GROUP BY portfolio),
  dd AS (SELECT portfolio, date FROM pf JOIN ct USING (portfolio) GROUP BY portfolio, date, n HAVING count(DISTINCT listing) = n),
  sz AS (SELECT portfolio, n, (SELECT count(*) FROM dd WHERE dd.portfolio = ct.portfolio) AS dates FROM ct)"""
_MODEL = f"""{_MONTHS}, m AS (SELECT pf.* FROM pf JOIN dd USING (portfolio, date) JOIN sz USING (portfolio) WHERE sz.dates >= 3),
  z AS (SELECT portfolio, date, listing, simple - avg(simple) OVER (PARTITION BY portfolio, listing) AS z FROM m),
  s AS (SELECT portfolio, a.listing AS l, b.listing AS r, count(*) AS t, sum(a.z * b.z) / (count(*) - 1) AS s FROM z a JOIN z b USING (portfolio, date) GROUP BY portfolio, a.listing, b.listing),
  o AS (SELECT portfolio, avg(CASE WHEN l = r THEN s END) AS mu, count(*) FILTER (l = r) AS n, max(t) AS days, sum(s * s) AS ss FROM s GROUP BY portfolio),
  dl AS (SELECT portfolio, sum((s - CASE WHEN l = r THEN mu ELSE 0 END) * (s - CASE WHEN l = r THEN mu ELSE 0 END)) / max(n) AS delta FROM s JOIN o USING (portfolio) GROUP BY portfolio),
  dq AS (SELECT portfolio, sum(x * x) AS x FROM (SELECT portfolio, date, sum(z * z) AS x FROM z GROUP BY portfolio, date) GROUP BY portfolio),
  k AS (SELECT portfolio, mu, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce((x - (days - 2) * ss) / (days * days) / n / nullif(delta, 0), 0))) AS k FROM o JOIN dl USING (portfolio) JOIN dq USING (portfolio))"""


def _kept(df):
    """df checkpointed in the shared folder, as several steps read it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _rets(spark, d):
    month = q._quoted("nation", spark, d).groupBy("listing", F.trunc("date", "month").alias("date")).agg(F.max_by("px", "date").alias("px")).filter("px > 0")
    before = F.lag("px").over(Window.partitionBy("listing").orderBy("date"))
    r = month.withColumn("simple", (F.col("px") / before - 1) * adapters.SCALE).filter("simple IS NOT NULL")
    place = adapters.read(spark, d, "nation").join(adapters.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = place.select(F.col("n_name").alias("listing"), F.explode(F.array("r_name", F.lit("WORLD"))).alias("portfolio"))
    return r.join(place, "listing").select("portfolio", "date", "listing", "simple")


def _models(spark, d):
    """Aligned rows, sizes and models."""
    rets = _kept(_rets(spark, d))
    m = _kept(profiles.matrices(rets))
    size = _kept(profiles.sizes(rets, m))
    m = profiles.eligible(m, size)
    return m, size, _kept(profiles.models(m))


def _advice(spark, d):
    m, size, model = _models(spark, d)
    return m, size, model, _kept(profiles.candidates(m, model))


@query(f"{_MONTHS} SELECT portfolio, n AS listings, dates, CASE WHEN n > 200 THEN 'too_many_listings' WHEN dates < 3 THEN 'insufficient_history' END AS reason FROM sz")
def profile_sizes(spark, d):
    rets = _kept(_rets(spark, d))
    return profiles.sizes(rets, profiles.matrices(rets))


@query(f"""{_MODEL} SELECT portfolio, l AS "left", r AS "right", {_z('s', 9)} AS covariance, {_z('(1 - k) * s + CASE WHEN l = r THEN k * mu ELSE 0 END', 9)} AS shrunk, {_z('k', 9)} AS intensity FROM s JOIN k USING (portfolio)""", 9)
def profile_models(spark, d):
    return _models(spark, d)[2]


@query(f"""{_MODEL}, own AS (SELECT portfolio, l, 1.0::DOUBLE / count(*) OVER w AS e, coalesce(1 / nullif(sqrt(s), 0), 0) / sum(coalesce(1 / nullif(sqrt(s), 0), 0)) OVER w AS i FROM s WHERE l = r WINDOW w AS (PARTITION BY portfolio))
  SELECT s.portfolio, {_z('sum(a.e * b.e * s)', 9)} AS equal_weight_variance, {_z('sum(a.i * b.i * s)', 9)} AS inverse_volatility_variance
  FROM s JOIN own a ON a.portfolio = s.portfolio AND a.l = s.l JOIN own b ON b.portfolio = s.portfolio AND b.l = s.r GROUP BY s.portfolio""", 9)
def profile_baselines(spark, d):
    return profiles.baselines(_models(spark, d)[2])


@query()
def profile_weights(spark, d):
    return _advice(spark, d)[3]


@query()
def profile_reports(spark, d):
    """Turnover is that from equal weights."""
    m, size, model, found = _advice(spark, d)
    held = m.select("portfolio", "listing").distinct().join(size, "portfolio").select("portfolio", "listing", (1 / F.col("listings")).alias("weight"))
    return profiles.reports(found, model, size, held)


@query()
def recommendation(spark, d):
    m, size, model, found = _advice(spark, d)
    return profiles.recommendation(profiles.reports(found, model, size), profiles.ranked(m, found))
