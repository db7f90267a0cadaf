"""Third part of the queries: raw payloads, scorecards, risk-model windows and gates, pair diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, pairs, scorecard
from ..sources import adapters
from ..sources.tables import checkpointed
from . import queries as q

query, _z = q.query, q._z

# ---------------------------------------------------------------- raw payloads
_NULLED = ", ".join(f"CASE WHEN (l_orderkey + l_linenumber) % {k} = 0 THEN NULL ELSE l_extendedprice * {x}::DOUBLE END AS {c}" for c, k, x in (("open", 3, 1.0), ("high", 4, 1.25), ("low", 5, 0.75), ("close", 11, 1.0), ("adjusted_close", 7, 0.5)))


def _payload(spark, d):
    line = adapters.read(spark, d, "lineitem")
    at = F.col("l_orderkey") + F.col("l_linenumber")
    price = {c: F.when(at % k != 0, F.col("l_extendedprice") * x) for c, k, x in (("open", 3, 1.0), ("high", 4, 1.25), ("low", 5, 0.75), ("close", 11, 1.0), ("adjusted_close", 7, 0.5))}
    key = F.col("l_suppkey").cast("string")
    return line.select(key.alias("isin"), F.lit("XETRA").alias("exchange"), key.alias("code"), F.col("l_shipdate").cast("date").alias("date"), *(x.alias(c) for c, x in price.items()), F.when(at % 6 != 0, F.col("l_quantity")).alias("volume"), F.lit(None).cast("string").alias("currency"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


@query(f"""WITH x AS (SELECT CAST(l_suppkey AS VARCHAR) AS isin, CAST(l_shipdate AS DATE) AS date, {_NULLED}, CASE WHEN (l_orderkey + l_linenumber) % 6 <> 0 THEN l_quantity END AS volume, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)
  SELECT isin, 'XETRA' AS exchange, isin AS code, date, {', '.join(_z(f'coalesce({c}, close, 0)') + f' AS {c}' for c in ('open', 'high', 'low', 'close', 'adjusted_close'))}, CAST(coalesce(volume, 0) AS BIGINT) AS volume, '' AS currency
  FROM x QUALIFY row_number() OVER (PARTITION BY isin, date ORDER BY seq DESC) = 1""")
def normalized_quotes(spark, d):
    return ingest.normalized_quotes(_payload(spark, d), "seq")


@query("""SELECT c_name AS code, 'US' AS exchange, c_mktsegment AS instrument_type, '' AS country, '' AS currency, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'ISIN' || c_custkey END AS isin, 'Fund  ' || c_name AS name,
  'run-1' AS search_run_id, 'fund' AS query, 'search' AS source_endpoint, 'fund ' || lower(c_name) AS normalized_name FROM customer""")
def discovery_candidates(spark, d):
    c = adapters.read(spark, d, "customer")
    raw = c.select(F.concat(F.lit("\t"), F.col("c_name"), F.lit(" ")).alias("Code"), F.lit(" US").alias("Exchange"), F.col("c_mktsegment").alias("Type"), F.concat(F.lit("Fund  "), F.col("c_name"), F.lit("\n")).alias("Name"), F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("ISIN"), F.col("c_custkey"))).alias("Isin"))
    return ingest.candidates(raw, "run-1", "fund", "search")


@query(f"WITH {q._ISINS} SELECT 'run-1' AS run_id, isin, exchange, code, code || '.' || exchange AS symbol, '1998-01-01' AS start_date, '' AS end_date FROM isins WHERE isin = 'ISIN7'")
def request_plan(spark, d):
    return ingest.request_plan(adapters.all_isins(spark, d), "run-1", "1998-01-01", isin="ISIN7")


@query("""SELECT count(*) AS candidates, count(*) FILTER (c_custkey % 7 = 0) AS missing_isin, count(DISTINCT c_custkey % 50) FILTER (c_custkey % 7 <> 0) AS isins, count(*) > 0 AND bool_and(c_mktsegment <> 'BUILDING') AS survivorship_warning, bool_or(c_custkey % 7 = 0) AS missing_isin_warning FROM customer""")
def universe_review(spark, d):
    c = adapters.read(spark, d, "customer")
    return ingest.review(c.select(F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 50).cast("string")).otherwise(" ").alias("isin"), F.when(F.col("c_mktsegment") == "BUILDING", "delisted").alias("status")))


# ---------------------------------------------------------------- walk-forward scorecard
TRAIN, TEST, COST = 252, 126, 0.001
CANDIDATES = [scorecard.Candidate("low_risk", "min_variance"), scorecard.Candidate("capped_ratio", "max_sharpe", 0.4), scorecard.Candidate("infeasible", "min_variance", 0.1)]
_SPLITS = f"""{q._MATRIX}, nm AS (SELECT listing, row_number() OVER (ORDER BY listing) AS k FROM (SELECT DISTINCT listing FROM m)),
  g AS (SELECT [a, b, c, d, 10 - a - b - c - d] AS cand FROM (SELECT unnest(range(0, 11)) AS a), (SELECT unnest(range(0, 11)) AS b), (SELECT unnest(range(0, 11)) AS c), (SELECT unnest(range(0, 11)) AS d) WHERE a + b + c + d <= 10),
  dt AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM m)), s AS (SELECT unnest(range(0, (max(n) - {TRAIN + TEST}) // {TEST} + 1)) AS split FROM dt),
  tr AS (SELECT split, k, date, simple FROM s JOIN dt ON i >= split * {TEST} AND i < split * {TEST} + {TRAIN} JOIN m USING (date) JOIN nm USING (listing)),
  te AS (SELECT split, k, date, simple FROM s JOIN dt ON i >= split * {TEST} + {TRAIN} AND i < split * {TEST} + {TRAIN + TEST} JOIN m USING (date) JOIN nm USING (listing)),
  cv AS (SELECT a.split, a.k AS l, b.k AS r, coalesce(covar_samp(a.simple, b.simple), 0) AS c FROM tr a JOIN tr b ON a.split = b.split AND a.date = b.date GROUP BY ALL), mu AS (SELECT split, k, avg(simple) AS mu FROM tr GROUP BY ALL),
  vr AS (SELECT split, cand, sum(cand[l] / 10.0::DOUBLE * (cand[r] / 10.0::DOUBLE) * c) AS v FROM g, cv GROUP BY ALL), ex AS (SELECT split, cand, sum(cand[k] / 10.0::DOUBLE * mu) AS e FROM g, mu GROUP BY ALL), gs AS (SELECT * FROM vr JOIN ex USING (split, cand)),
  pk AS (SELECT 'low_risk' AS name, split, min(struct_pack(v := round(v, 12), cand := cand)) AS b FROM gs GROUP BY split UNION ALL
         SELECT 'capped_ratio', split, min(struct_pack(v := -round(coalesce(e / nullif(sqrt(v), 0), 0), 12), cand := cand)) FROM gs WHERE list_max(cand) <= 4 GROUP BY split),
  wt AS (SELECT name, split, k, b.cand[k] / 10.0::DOUBLE AS weight FROM pk, nm), tu AS (SELECT name, split, coalesce(sum(x), 0) / 2 AS turnover FROM (SELECT *, abs(weight - lag(weight) OVER (PARTITION BY name, k ORDER BY split)) AS x FROM wt) GROUP BY ALL),
  rs AS (SELECT name, split, count(*) AS n, product(1 + r) - 1 AS pre, coalesce(stddev_samp(r), 0) * sqrt(252) AS vol, sqrt(avg(pow(least(r, 0), 2))) * sqrt(252) AS dn FROM (SELECT name, te.split, date, sum(weight * simple) AS r FROM te JOIN wt ON wt.split = te.split AND wt.k = te.k GROUP BY ALL) GROUP BY ALL),
  po AS (SELECT *, (1 - turnover * {COST}::DOUBLE) * (1 + pre) - 1 AS post FROM rs JOIN tu USING (name, split)),
  bt AS (SELECT *, coalesce((pow(1 + post, 252.0::DOUBLE / n) - 1) / nullif(vol, 0), 0) AS sharpe, coalesce((pow(1 + post, 252.0::DOUBLE / n) - 1) / nullif(dn, 0), 0) AS sortino FROM po)"""


@query(f"{_SPLITS} SELECT name, split::INT AS split, n, {_z('pre', 4)} AS pre_cost_return, {_z('post', 4)} AS post_cost_return, {_z('vol', 4)} AS volatility, {_z('sharpe', 4)} AS sharpe, {_z('sortino', 4)} AS sortino, {_z('turnover', 4)} AS turnover FROM bt", 4)
def walk_forward_optimizers(spark, d):
    def made():
        m = q._matrix(spark, d).checkpoint()
        splits = scorecard.portfolio.walk_forward_splits(m, TRAIN, TEST).checkpoint()
        return scorecard.backtest(m, splits, scorecard.split_weights(m, splits, CANDIDATES).checkpoint(), COST)

    return checkpointed(spark, made)


@query(f"""{_SPLITS}, wl AS (SELECT name, split, post, exp(sum(ln(1 + post)) OVER (PARTITION BY name ORDER BY split)) AS wealth FROM bt), pe AS (SELECT *, greatest(1, max(wealth) OVER (PARTITION BY name ORDER BY split)) AS peak FROM wl),
  ap AS (SELECT *, CASE WHEN wealth >= greatest(1, coalesce(lag(peak) OVER (PARTITION BY name ORDER BY split), 1)) THEN 1 ELSE 0 END AS ap FROM pe), il AS (SELECT *, sum(ap) OVER (PARTITION BY name ORDER BY split) AS il FROM ap),
  du AS (SELECT *, CASE WHEN ap = 1 THEN 0 ELSE sum(1 - ap) OVER (PARTITION BY name, il ORDER BY split) END AS du FROM il), rc AS (SELECT *, CASE WHEN ap = 1 THEN coalesce(lag(du) OVER (PARTITION BY name ORDER BY split), 0) ELSE 0 END AS rec FROM du),
  dd AS (SELECT name, min(wealth / peak - 1) AS dd, max(rec) AS rec FROM rc GROUP BY name),
  ls AS (SELECT name, -post AS loss, row_number() OVER (PARTITION BY name ORDER BY -post, split) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM bt), va AS (SELECT name, max(loss) AS var FROM ls WHERE i = least(n - 1, floor(n * 0.95::DOUBLE)) GROUP BY name),
  tl AS (SELECT name, max(var) AS var, avg(loss) AS es, count(*) AS k FROM ls JOIN va USING (name) WHERE loss >= var GROUP BY name),
  cc AS (SELECT name, median(x) AS cc FROM (SELECT name, split, max(weight) AS x FROM wt GROUP BY ALL) GROUP BY name), wv AS (SELECT name, coalesce(median(x), 0) AS wv FROM (SELECT name, k, var_samp(weight) AS x FROM wt GROUP BY ALL) GROUP BY name),
  fg AS (SELECT name, count(*) AS n, median(post) AS mr, min(post) AS ar, median(sharpe) AS ms, median(sortino) AS mo, median(turnover) AS mt FROM bt GROUP BY name),
  al AS (SELECT * FROM fg JOIN dd USING (name) JOIN tl USING (name) JOIN cc USING (name) JOIN wv USING (name)),
  nm2 AS (SELECT unnest(['low_risk', 'capped_ratio', 'infeasible']) AS name, unnest(['min_variance', 'max_sharpe', 'min_variance']) AS objective)
  SELECT name, objective, CASE WHEN n IS NULL THEN 'blocked' ELSE 'scored' END AS status, CASE WHEN n IS NULL THEN 'no_completed_out_of_sample_splits' ELSE '' END AS reason, coalesce(n, 0) AS completed_splits, {_z('mr', 4)} AS median_return, {_z('ar', 4)} AS adverse_return,
    {_z('ms', 4)} AS median_sharpe, {_z('mo', 4)} AS median_sortino, {_z('mt', 4)} AS median_turnover, {_z('var', 4)} AS value_at_risk, {_z('es', 4)} AS cvar, k AS tail_count, {_z('dd', 4)} AS max_drawdown, CAST(rec AS BIGINT) AS recovery_splits, {_z('cc', 4)} AS median_concentration, {_z('wv', 4)} AS median_weight_variance,
    CASE WHEN n IS NOT NULL THEN CAST(row_number() OVER (ORDER BY n IS NULL, round(ms, 9) DESC, name) AS INT) END AS rank FROM nm2 LEFT JOIN al USING (name)""", 4)
def model_scorecard(spark, d):
    return checkpointed(spark, lambda: scorecard.scorecard(q._matrix(spark, d), CANDIDATES, TRAIN, TEST, cost=COST))


# ---------------------------------------------------------------- risk-model windows, pair diagnostics
LAST = "2000-01-01"


@query(f"""{q._MATRIX}, x AS (SELECT date FROM (SELECT DISTINCT date FROM m) WHERE date <= DATE '{LAST}' ORDER BY date DESC LIMIT 120)
  SELECT a.listing AS "left", b.listing AS "right", count(*) AS n, min(date) AS first_date, max(date) AS last_date, {_z('coalesce(covar_samp(a.simple, b.simple), 0)', 12)} AS covariance FROM m a JOIN m b USING (date) WHERE date IN (SELECT date FROM x) GROUP BY 1, 2""", 12)
def covariance_rolling_window(spark, d):
    from ..operators.portfolio import covariance, model_window

    m = q._matrix(spark, d)
    as_of = m.filter(F.col("date") <= F.lit(LAST).cast("date")).agg(F.max("date").cast("string")).first()[0]
    m = model_window(m, "rolling", 120, as_of)
    seen = m.agg(F.countDistinct("date").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))  # one row
    return covariance(m).join(F.broadcast(seen)).select("left", "right", "n", "first_date", "last_date", "covariance")


@query(f"WITH {q._quotes('supplier')}, {q._R}, k AS (SELECT DISTINCT listing FROM r) SELECT count(*) - (SELECT count(*) FROM (SELECT a.listing, b.listing FROM r a JOIN r b USING (date) WHERE a.listing < b.listing GROUP BY a.listing, b.listing HAVING count(*) >= 2)) AS missing_pairs FROM k a JOIN k b ON a.listing < b.listing")
def missing_pairs(spark, d):
    return pairs.missing(q._rets("supplier", spark, d))


@query(f"""{q._PAIRS}, {q._MOM}, sc AS (SELECT l, r, {q._CORR.format('x', 'y')} AS s FROM (SELECT l, r, {q._score('x')} AS x, {q._score('y')} AS y FROM pr) GROUP BY l, r), j AS (SELECT l, r, s, c FROM sc JOIN mo USING (l, r)),
  a AS (SELECT x, avg(s) AS a FROM (SELECT l AS x, s FROM j UNION ALL SELECT r, s FROM j) GROUP BY x)
  SELECT count(*) AS n, count(*) FILTER (s >= 0.7) AS high, count(*) FILTER (s >= 0.9) AS very_high, count(*) FILTER (s <= 0.3) AS low, count(*) FILTER (s < 0) AS negative, {_z('quantile_cont(s, 0.1)')} AS p10, {_z('quantile_cont(s, 0.5)')} AS p50, {_z('quantile_cont(s, 0.9)')} AS p90, {_z('avg(s - c)')} AS average_gap, count(*) FILTER (abs(s - c) >= 0.15) AS large_gaps,
    any_value(mx) AS most_correlated, any_value(mn) AS best_diversifier FROM j, (SELECT max_by(x, a) AS mx, min_by(x, a) AS mn FROM a)""")
def spearman_diagnostics(spark, d):
    return pairs.spearman_diagnostics(q._pairs(spark, d))
