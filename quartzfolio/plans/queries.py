"""Every query by name, and the same in SQL over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import normalized_name, rounded, stable_id
from ..operators import blocks, pairs, portfolio, selection, series, solvers
from ..sources import adapters, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- adapters in SQL
KEY = {"region": "r_name", "nation": "n_name", "supplier": "CAST(s_suppkey AS VARCHAR)"}


def _quotes(level: str) -> str:
    return f"""q AS (SELECT {KEY[level]} AS listing, CAST(l_shipdate AS DATE) AS date, round(sum(l_extendedprice) / sum(l_quantity), 6) AS px
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""


_R = """r AS (SELECT listing, date, ln(px / p) AS ret, px / p - 1 AS simple FROM
      (SELECT *, lag(px) OVER (PARTITION BY listing ORDER BY date) AS p FROM q WHERE px > 0) WHERE p IS NOT NULL)"""
_M = f"""m AS (SELECT listing, date, ret, simple * {adapters.SCALE} AS simple FROM r
      WHERE date IN (SELECT date FROM r GROUP BY date HAVING count(DISTINCT listing) = (SELECT count(DISTINCT listing) FROM r)))"""
_MATRIX = f"WITH {_quotes('region')}, {_R}, {_M}"
_PORT = _MATRIX + ", w AS (SELECT listing, 1.0::DOUBLE / count(*) OVER () AS weight FROM (SELECT DISTINCT listing FROM m)), p AS (SELECT date, sum(weight * simple) AS r FROM m JOIN w USING (listing) GROUP BY date)"
_PAIRS = f"WITH {_quotes('nation')}, {_R}, pr AS (SELECT a.listing AS l, b.listing AS r, date, a.ret AS x, b.ret AS y FROM r a JOIN r b USING (date) WHERE a.listing < b.listing)"
_ISINS = """isins AS (SELECT 'ISIN' || CAST(c_custkey % 50 AS VARCHAR) AS isin, (['XETRA', 'LSE', 'PA', 'AS', 'SW'])[CAST(floor(c_custkey / 50) % 5 + 1 AS INT)] AS exchange,
      c_name AS code, c_name AS name, c_mktsegment AS instrument_type, n_name AS country, (['USD', 'USD', 'EUR', 'EUR', 'GBP'])[n_regionkey + 1] AS currency FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_CORR = "coalesce(covar_samp({0}, {1}) / nullif(sqrt(var_samp({0}) * var_samp({1})), 0), 0)"


def _z(x: str, digits: int = 6) -> str:
    """Rounded as `rounded` does it; -0.0 as 0.0."""
    return f"round({x}, {digits}) + 0.0::DOUBLE"


def _div(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), 0)"


def query(sql: str | None = None, digits: int = 6):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quoted(level: str, spark: SparkSession, d: str) -> DataFrame:
    return adapters.quotes(spark, d, level)


def _rets(level: str, spark: SparkSession, d: str) -> DataFrame:
    return series.returns(_quoted(level, spark, d))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.matrix(_rets("region", spark, d)).withColumn("simple", F.col("simple") * adapters.SCALE)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.aligned(_rets("nation", spark, d))


def _moments(spark: SparkSession, d: str) -> DataFrame:
    return blocks.moments(_rets("nation", spark, d), listings=_nations(spark, d))


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return adapters.read(spark, d, "nation").select(F.col("n_name").alias("listing"))


def _portfolio(spark: SparkSession, d: str) -> DataFrame:
    m = _matrix(spark, d)
    return portfolio.portfolio_returns(m, portfolio.equal_weights(m))


def _named(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.covariance(_matrix(spark, d)).withColumn("portfolio", F.lit("all"))


# ---------------------------------------------------------------- selection
@query(f"WITH {_ISINS} SELECT isin, exchange, code FROM isins WHERE instrument_type = 'BUILDING' AND contains(lower(country), 'nation_1')")
def metadata_filter(spark, d):
    return selection.matching(adapters.all_isins(spark, d), ["instrument_type = BUILDING", "country ~ NATION_1"]).select("isin", "exchange", "code")


@query(f"""WITH {_ISINS} SELECT isin, exchange, code, CASE WHEN exchange = 'XETRA' THEN 'preferred_exchange' ELSE 'first_by_exchange_and_code' END AS reason FROM isins
  QUALIFY row_number() OVER (PARTITION BY isin ORDER BY CASE WHEN exchange = 'XETRA' THEN 0 ELSE 1 END, exchange, code) = 1""")
def canonical_universe(spark, d):
    return selection.canonical(adapters.all_isins(spark, d)).select("isin", "exchange", "code", "reason")


@query(f"WITH {_ISINS} SELECT isin, exchange, min(code) AS code FROM isins GROUP BY ALL")
def unique_listings(spark, d):
    return selection.one_per_exchange(adapters.all_isins(spark, d)).select("isin", "exchange", "code")


@query(f"WITH {_ISINS} SELECT DISTINCT field, value FROM isins UNPIVOT (value FOR field IN (exchange, instrument_type, country, currency)) WHERE trim(value) <> ''")
def filter_options(spark, d):
    return selection.options(adapters.all_isins(spark, d), ["exchange", "instrument_type", "country", "currency"])


@query(f"WITH {_quotes('supplier')} SELECT listing, count(*) AS n FROM q WHERE listing IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 5000) GROUP BY listing")
def semi_join_selection(spark, d):
    chosen = adapters.read(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("listing"))
    return tables.pruned(_quoted("supplier", spark, d), chosen, ["listing"]).groupBy("listing").agg(F.count("*").alias("n"))


@query(f"WITH {_ISINS} SELECT isin, exchange, code FROM isins ORDER BY isin, exchange, code LIMIT 25 OFFSET 50")
def page_rows(spark, d):
    return selection.page(adapters.all_isins(spark, d).select("isin", "exchange", "code"), ["isin", "exchange", "code"], 50, 25)


@query(f"WITH {_ISINS} SELECT code, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS name, 'listing_' || substring(sha256(isin || chr(31) || exchange || chr(31) || code), 1, 16) AS id FROM isins WHERE contains(lower(name), '#0000001')")
def name_search(spark, d):
    d = adapters.all_isins(spark, d).filter(F.contains(normalized_name(F.col("name")), normalized_name(F.lit("#0000001"))))
    return d.select("code", normalized_name(F.col("name")).alias("name"), stable_id("listing", F.col("isin"), F.col("exchange"), F.col("code")).alias("id"))


@query(f"""WITH {_quotes('nation')}, a AS (SELECT *, 0 AS v FROM q), b AS (SELECT listing, date, px + 1 AS px, 1 AS v FROM q WHERE date >= DATE '1998-01-01')
  SELECT listing, count(*) AS n, {_z('sum(px)', 4)} AS total FROM (SELECT * FROM a UNION ALL SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY listing, date ORDER BY v DESC) = 1) GROUP BY listing""".replace("SELECT * FROM a UNION ALL SELECT * FROM b QUALIFY", "SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY"), 4)
def upsert_last_wins(spark, d):
    q = _quoted("nation", spark, d)
    new = q.filter("date >= DATE '1998-01-01'").withColumn("px", F.col("px") + 1)
    return tables.upsert(q, new, ["listing", "date"]).groupBy("listing").agg(F.count("*").alias("n"), F.sum("px").alias("total"))


# ---------------------------------------------------------------- quality, calendars
_BAD = "CASE WHEN l_orderkey % 97 = 0 THEN 0 ELSE l_extendedprice END"


def _raw(spark, d):
    line = adapters.read(spark, d, "lineitem")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return line.select(F.col("l_suppkey").cast("string").alias("listing"), F.col("l_shipdate").cast("date").alias("date"), F.when(F.col("l_orderkey") % 97 == 0, 0.0).otherwise(F.col("l_extendedprice")).alias("px"), seq.alias("seq"))


_JUDGED = f"""WITH x AS (SELECT CAST(l_suppkey AS VARCHAR) AS listing, CAST(l_shipdate AS DATE) AS date, {_BAD} AS px, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
  j AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY listing, date ORDER BY seq) > 1 THEN 'duplicate_date' WHEN px <= 0 THEN 'non_positive_price' END AS reason FROM x)"""


@query(_JUDGED + " SELECT listing, date, seq, reason FROM j WHERE reason IS NOT NULL")
def quarantine_rows(spark, d):
    return series.judged(_raw(spark, d)).filter("reason IS NOT NULL").select("listing", "date", "seq", "reason")


@query(_JUDGED + " SELECT listing, count(*) FILTER (reason = 'non_positive_price') AS bad, count(*) FILTER (reason = 'duplicate_date') AS dup, count(*) FILTER (reason IS NULL) AS ok FROM j GROUP BY listing")
def quality_flags(spark, d):
    r = F.col("reason")
    return series.judged(_raw(spark, d)).groupBy("listing").agg(F.count_if(r == "non_positive_price").alias("bad"), F.count_if(r == "duplicate_date").alias("dup"), F.count_if(r.isNull()).alias("ok"))


@query(f"""WITH {_quotes('supplier')}, f AS (SELECT listing, date, floor(px / 400) AS px FROM q), c AS (SELECT *, CASE WHEN px <> lag(px) OVER w THEN 1 WHEN lag(px) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM f WINDOW w AS (PARTITION BY listing ORDER BY date)),
  i AS (SELECT listing, sum(c) OVER (PARTITION BY listing ORDER BY date) AS i FROM c) SELECT listing, max(n) AS longest_run, max(n) >= 5 AS stale FROM (SELECT listing, i, count(*) AS n FROM i GROUP BY ALL) GROUP BY listing""")
def stale_runs(spark, d):
    return series.stale_runs(_quoted("supplier", spark, d).withColumn("px", F.floor(F.col("px") / 400)))


@query(f"WITH {_quotes('supplier')} SELECT * FROM (SELECT listing, lag(date) OVER (PARTITION BY listing ORDER BY date) AS gap_start, date AS gap_end, CAST(date - lag(date) OVER (PARTITION BY listing ORDER BY date) AS BIGINT) AS days FROM q) WHERE days > 10")
def calendar_gaps(spark, d):
    return series.calendar_gaps(_quoted("supplier", spark, d))


#: Easter Sundays of the years of the tables, from a calendar; closed on the Friday before, the Monday after and Whit Monday.
_EASTERS = "1992-04-19 1993-04-11 1994-04-03 1995-04-16 1996-04-07 1997-03-30 1998-04-12 1999-04-04 2000-04-23 2001-04-15 2002-03-31".split()
_CLOSED = f"""closed AS (SELECT CAST(e AS DATE) + k AS day FROM (SELECT unnest([{', '.join(f"DATE '{x}'" for x in _EASTERS)}]) AS e), (SELECT unnest([-2, 1, 50]) AS k)
  UNION ALL SELECT make_date(y, md // 100, md % 100) FROM (SELECT unnest(range(1992, 2003)) AS y), (SELECT unnest([101, 501, 1003, 1224, 1225, 1226, 1231]) AS md))"""
_DAYS = f"""WITH {_quotes('nation')}, {_CLOSED}, e AS (SELECT listing, min(date) AS a, max(date) AS b, count(*) AS days FROM q GROUP BY listing),
  t AS (SELECT listing, CAST(u AS DATE) AS date FROM (SELECT listing, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS u FROM e) WHERE isodow(CAST(u AS DATE)) < 6 AND CAST(u AS DATE) NOT IN (SELECT day FROM closed)),
  n AS (SELECT *, row_number() OVER (PARTITION BY listing ORDER BY date) AS no FROM t), miss AS (SELECT n.* FROM n ANTI JOIN q ON n.listing = q.listing AND n.date = q.date),
  g AS (SELECT listing, min(date) AS gap_start, max(date) AS gap_end, count(*) AS missing FROM (SELECT *, no - row_number() OVER (PARTITION BY listing ORDER BY date) AS i FROM miss) GROUP BY listing, i)"""


@query(_DAYS + " SELECT listing, gap_start, gap_end, missing FROM g")
def quote_gaps(spark, d):
    return series.missing_ranges(_quoted("nation", spark, d), "XETRA")


@query(_DAYS + """ SELECT e.listing, e.days, t.expected, CAST(coalesce(g.missing, 0) AS BIGINT) AS missing, CAST(e.b - INTERVAL 5 DAY AS DATE) AS next_start FROM e
  JOIN (SELECT listing, count(*) AS expected FROM t GROUP BY listing) t USING (listing) LEFT JOIN (SELECT listing, sum(missing) AS missing FROM g GROUP BY listing) g USING (listing)""")
def coverage(spark, d):
    return series.coverage(_quoted("nation", spark, d), "XETRA")


# ---------------------------------------------------------------- one listing
@query(f"WITH {_quotes('supplier')}, {_R} SELECT listing, date, {_z('ret')} AS ret, {_z('simple')} AS simple FROM r")
def log_simple_returns(spark, d):
    return _rets("supplier", spark, d)


_YEAR, _ROOT = "252.0::DOUBLE", "sqrt(252.0::DOUBLE)"
_DOWN = "sqrt(avg(pow(least(ret, 0), 2)))"
_DIST = f"""count(*) AS n, min(date) AS first_date, max(date) AS last_date, {_z('sum(ret)')} AS cumulative_log_return, {_z('avg(ret)')} AS mean_log_return, {_z('median(ret)')} AS median_log_return,
  {_z('min(ret)')} AS min_log_return, {_z('max(ret)')} AS max_log_return, {_z('avg(simple)')} AS mean_simple_return, {_z('median(simple)')} AS median_simple_return, {_z('coalesce(stddev_samp(ret), 0)')} AS daily_std,
  {_z('sum(ret * ret)')} AS realized_variance, {_z(_DOWN)} AS downside, {_z('avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END)')} AS positive_day_ratio, {_z(f'avg(ret) * {_YEAR}')} AS annual_return,
  {_z(f'coalesce(stddev_samp(ret), 0) * {_ROOT}')} AS annual_volatility, {_z(_div(f'avg(ret) * {_YEAR}', f'coalesce(stddev_samp(ret), 0) * {_ROOT}'))} AS sharpe, {_z(_div(f'avg(ret) * {_YEAR}', f'{_DOWN} * {_ROOT}'))} AS sortino"""


@query(f"WITH {_quotes('supplier')}, {_R} SELECT listing, {_DIST}, count(*) >= 252 AS history_252, count(*) >= 504 AS history_504, count(*) >= 756 AS history_756 FROM r GROUP BY listing")
def univariate_returns(spark, d):
    return series.distribution(_rets("supplier", spark, d))


_TAIL = """l AS (SELECT {key} listing, date, -{x} AS loss, row_number() OVER (PARTITION BY listing ORDER BY -{x}, date) - 1 AS i, count(*) OVER (PARTITION BY listing) AS n FROM {t}),
  v AS (SELECT listing, max(CASE WHEN i = least(n - 1, floor(n * 0.95::DOUBLE)) THEN loss END) AS var FROM l GROUP BY listing),
  tl AS (SELECT listing, max(var) AS var, avg(loss) AS es, count(*) AS k FROM l JOIN v USING (listing) WHERE loss >= var GROUP BY listing)"""


@query(f"WITH {_quotes('supplier')}, {_R}, {_TAIL.format(key='', x='ret', t='r')} SELECT listing, {_z('var')} AS value_at_risk, {_z('es')} AS expected_shortfall, k AS tail_count FROM tl")
def tail_risk_listing(spark, d):
    return series.tail(_rets("supplier", spark, d))


@query(f"WITH {_quotes('supplier')} SELECT listing, {_z('min(d)')} AS max_drawdown FROM (SELECT listing, px / max(px) OVER (PARTITION BY listing ORDER BY date) - 1 AS d FROM q) GROUP BY listing")
def max_drawdown(spark, d):
    return series.max_drawdown(_quoted("supplier", spark, d))


@query(f"WITH {_quotes('supplier')} SELECT listing, {_z('coalesce(regr_slope(y, x), 0)')} AS slope, CASE WHEN var_pop(y) > 0 THEN {_z('coalesce(regr_r2(y, x), 0)')} ELSE 0.0::DOUBLE END AS r_squared FROM (SELECT listing, ln(px) AS y, (row_number() OVER (PARTITION BY listing ORDER BY date) - 1)::DOUBLE AS x FROM q) GROUP BY listing")
def log_price_trend(spark, d):
    return series.trend(_quoted("supplier", spark, d))


@query(f"""WITH {_quotes('supplier')}, {_R}, {_TAIL.format(key='', x='ret', t='r')}, dd AS (SELECT listing, min(d) AS dd FROM (SELECT listing, px / max(px) OVER (PARTITION BY listing ORDER BY date) - 1 AS d FROM q) GROUP BY listing),
  s AS (SELECT listing, {_DIST} FROM r GROUP BY listing) SELECT listing, n, annual_return, annual_volatility, sharpe, sortino, {_z('var')} AS value_at_risk, {_z('es')} AS expected_shortfall, k AS tail_count, {_z('dd')} AS max_drawdown FROM s JOIN tl USING (listing) JOIN dd USING (listing)""")
def univariate_risk(spark, d):
    q = _quoted("supplier", spark, d)
    r = series.returns(q)
    row = series.distribution(r).select("listing", "n", "annual_return", "annual_volatility", "sharpe", "sortino")
    return row.join(series.tail(r), "listing").join(series.max_drawdown(q), "listing")


@query(f"WITH {_quotes('supplier')}, {_R} SELECT listing, {_z(_div(f'avg(ret) * {_YEAR}', f'coalesce(stddev_samp(ret), 0) * {_ROOT}'))} AS sharpe, count(*) AS n FROM r GROUP BY listing HAVING count(*) >= 500 AND {_div(f'avg(ret) * {_YEAR}', f'coalesce(stddev_samp(ret), 0) * {_ROOT}')} > 0")
def univariate_filter(spark, d):
    return selection.matching(series.distribution(_rets("supplier", spark, d)), ["n >= 500", "sharpe > 0"]).select("listing", "sharpe", "n")


_BANDS = " ".join(f"WHEN lo >= {lo} AND hi <= {hi} THEN '{n}'" for n, lo, hi in series.BANDS)


@query(f"""WITH p AS (SELECT DISTINCT o_custkey AS listing, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_totalprice > 0), g AS (SELECT *, date - lag(date) OVER (PARTITION BY listing ORDER BY date) AS gap FROM p),
  a AS (SELECT listing, count(*) AS events, max(date) AS last_date, min(gap) AS lo, max(gap) AS hi FROM g GROUP BY listing) SELECT listing, events, last_date, CASE WHEN events < 2 THEN 'unknown' {_BANDS} ELSE 'irregular' END AS frequency FROM a""")
def distribution_frequency(spark, d):
    return series.payout_frequency(adapters.dividends(spark, d))


_PAID = """p AS (SELECT o_custkey AS listing, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value FROM orders),
  cq AS (SELECT o_custkey AS listing, CAST(l_shipdate AS DATE) AS date, round(sum(l_extendedprice) / sum(l_quantity), 6) AS px FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
  lq AS (SELECT listing, max(date) AS last, arg_max(px, date) AS px FROM cq GROUP BY listing),
  ttm AS (SELECT lq.listing, lq.px, coalesce((SELECT sum(value) FROM p WHERE p.listing = lq.listing AND value > 0 AND date BETWEEN last - 364 AND last), 0) AS amount,
    (SELECT count(*) FROM p WHERE p.listing = lq.listing AND value > 0 AND date BETWEEN last - 364 AND last) AS payouts FROM lq)"""


@query(f"WITH {_PAID} SELECT listing, {_z('amount', 4)} AS annual_amount, payouts, {_z('CASE WHEN px > 0 THEN amount / px ELSE 0 END', 4)} AS annual_yield FROM ttm", 4)
def trailing_dividend_yield(spark, d):
    return series.trailing_payout(adapters.dividends(spark, d), adapters.customer_quotes(spark, d))


@query("""WITH c AS (SELECT c_custkey AS listing FROM customer), p AS (SELECT o_custkey AS listing, count(*) AS events FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) FROM orders WHERE o_totalprice > 0) GROUP BY 1)
  SELECT listing, coalesce(events, 0) AS events, events IS NULL AS accumulating FROM c LEFT JOIN p USING (listing)""")
def accumulating_listings(spark, d):
    every = adapters.read(spark, d, "customer").select(F.col("c_custkey").alias("listing"))
    return series.payout_frequency(adapters.dividends(spark, d), every).select("listing", "events", (F.col("frequency") == "accumulating").alias("accumulating"))


# ---------------------------------------------------------------- pairs
_MOM = f"""mo AS (SELECT l, r, count(*) AS n, {_CORR.format('x', 'y')} AS c, coalesce(covar_samp(x, y), 0) AS cov, coalesce(var_samp(x), 0) AS vx, coalesce(var_samp(y), 0) AS vy FROM pr GROUP BY l, r)"""


@query(f"{_PAIRS}, {_MOM} SELECT l AS \"left\", r AS \"right\", n, {_z('c')} AS pearson, {_z('cov')} AS covariance FROM mo")
def pair_pearson_cov(spark, d):
    return _moments(spark, d).select("left", "right", "n", "pearson", "covariance")


@query(f"{_PAIRS}, {_MOM} SELECT l AS \"left\", r AS \"right\", {_z(_div('cov', 'vy'))} AS beta_left, {_z(_div('cov', 'vx'))} AS beta_right, {_z('vx')} AS left_variance, {_z('vy')} AS right_variance FROM mo")
def pair_beta(spark, d):
    return _moments(spark, d).select("left", "right", "beta_left", "beta_right", "left_variance", "right_variance")


def _score(c: str) -> str:
    w = "OVER (PARTITION BY l, r ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN sqrt(var_samp({c}) {w}) > 0 THEN ({c} - avg({c}) {w}) / sqrt(var_samp({c}) {w}) ELSE 0 END"


@query(f"{_PAIRS}, s AS (SELECT l, r, {_score('x')} AS x, {_score('y')} AS y FROM pr) SELECT l AS \"left\", r AS \"right\", {_z(_CORR.format('x', 'y'))} AS spearman FROM s GROUP BY l, r")
def pair_spearman_online(spark, d):
    return pairs.spearman_online(_pairs(spark, d))


@query(f"{_PAIRS} SELECT l AS \"left\", r AS \"right\", count(*) FILTER (x < 0 AND y < 0) AS n_downside, {_z(_CORR.format('CASE WHEN x < 0 AND y < 0 THEN x END', 'CASE WHEN x < 0 AND y < 0 THEN y END'))} AS downside_correlation FROM pr GROUP BY l, r")
def pair_downside_corr(spark, d):
    return pairs.downside(_pairs(spark, d))


@query(f"""{_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY x) - 1 AS i, row_number() OVER (PARTITION BY l, r ORDER BY y) - 1 AS j, count(*) OVER (PARTITION BY l, r) AS n FROM pr),
  c AS (SELECT l, r, max(CASE WHEN i = round_even((n - 1) * 0.05::DOUBLE, 0) THEN x END) AS cx, max(CASE WHEN j = round_even((n - 1) * 0.05::DOUBLE, 0) THEN y END) AS cy FROM k GROUP BY l, r),
  t AS (SELECT l, r, count(*) FILTER (x <= cx) AS a, count(*) FILTER (y <= cy) AS b, count(*) FILTER (x <= cx AND y <= cy) AS j, count(*) AS n FROM pr JOIN c USING (l, r) GROUP BY l, r)
  SELECT l AS "left", r AS "right", a AS left_tail, b AS right_tail, j AS joint_tail, {_z('coalesce(j / nullif(least(a, b), 0)::DOUBLE, 0)')} AS tail_dependence, {_z('j / n::DOUBLE')} AS co_exceedance FROM t""")
def pair_tail_dependence(spark, d):
    return pairs.tail_events(_pairs(spark, d))


@query(f"""{_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY l, r) AS n FROM pr),
  g AS (SELECT DISTINCT l, r, n, least(60, n) AS size, greatest(1, least(60, n) // 3) AS step FROM k WHERE n >= 20), s AS (SELECT DISTINCT l, r, size, unnest(list_append(range(0, n - size + 1, step), n - size)) AS s FROM g),
  c AS (SELECT l, r, s, {_CORR.format('x', 'y')} AS c FROM k JOIN s USING (l, r) WHERE i >= s AND i < s + size GROUP BY l, r, s) SELECT l AS "left", r AS "right", count(*) AS windows, {_z('coalesce(stddev_samp(c), 0)')} AS stability FROM c GROUP BY l, r""")
def pair_rolling_stability(spark, d):
    return pairs.rolling_stability(_pairs(spark, d))


@query(f"""{_PAIRS}, c AS (SELECT l, r, date, sum(x) OVER w AS cx, sum(y) OVER w AS cy FROM pr WINDOW w AS (PARTITION BY l, r ORDER BY date)),
  p AS (SELECT l, r, exp(cx - greatest(0, max(cx) OVER w)) - 1 AS dx, exp(cy - greatest(0, max(cy) OVER w)) - 1 AS dy FROM c WINDOW w AS (PARTITION BY l, r ORDER BY date))
  SELECT l AS "left", r AS "right", {_z('avg(CASE WHEN dx <= -0.05 AND dy <= -0.05 THEN 1.0::DOUBLE ELSE 0 END)')} AS overlap FROM p GROUP BY l, r""")
def pair_drawdown_overlap(spark, d):
    return pairs.drawdown_overlap(_pairs(spark, d))


@query(f"{_PAIRS}, {_MOM} SELECT l AS \"left\", r AS \"right\", {_z('c')} AS pearson, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY abs(c) DESC, r) AS k FROM mo) WHERE k <= 3")
def corr_edges_topk(spark, d):
    return pairs.edges(_moments(spark, d), top=3)


@query(f"{_PAIRS}, {_MOM} SELECT l AS \"left\", r AS \"right\", {_z('c')} AS pearson FROM mo WHERE abs(c) >= 0.04")
def corr_edges_threshold(spark, d):
    return pairs.edges(_moments(spark, d), least=0.04)


@query(f"{_PAIRS}, {_MOM}, e AS (SELECT min(c) AS lo, max(c) AS hi FROM mo) SELECT CAST(least(7, floor(coalesce((c - lo) / nullif(hi - lo, 0), 0) * 8)) AS INT) AS bin, count(*) AS n FROM mo, e GROUP BY 1")
def pair_metric_histogram(spark, d):
    return pairs.histogram(_moments(spark, d), "pearson")


@query(f"{_PAIRS}, {_MOM} SELECT count(*) AS n, count(*) FILTER (c >= 0.7) AS high, count(*) FILTER (c >= 0.9) AS very_high, count(*) FILTER (c <= 0.3) AS low, count(*) FILTER (c < 0) AS negative, {_z('quantile_cont(c, 0.1)')} AS p10, {_z('quantile_cont(c, 0.5)')} AS p50, {_z('quantile_cont(c, 0.9)')} AS p90 FROM mo")
def pearson_diagnostics(spark, d):
    return pairs.diagnostics(_moments(spark, d))


@query(f"{_PAIRS}, {_MOM} SELECT l AS \"left\", r AS \"right\", {_z('c')} AS pearson FROM mo UNION ALL SELECT r, l, {_z('c')} FROM mo")
def corr_matrix_long(spark, d):
    return pairs.mirrored(_moments(spark, d).select("left", "right", "pearson"))


_STATS = f"""{_PAIRS}, {_MOM}, sc AS (SELECT l, r, {_CORR.format('x', 'y')} AS spearman FROM (SELECT l, r, {_score('x')} AS x, {_score('y')} AS y FROM pr) GROUP BY l, r),
  dn AS (SELECT l, r, count(*) AS k, {_CORR.format('x', 'y')} AS c FROM pr WHERE x < 0 AND y < 0 GROUP BY l, r),
  cut AS (SELECT l, r, list_sort(list(x))[1 + round_even((count(*) - 1) * 0.05::DOUBLE, 0)::BIGINT] AS cx, list_sort(list(y))[1 + round_even((count(*) - 1) * 0.05::DOUBLE, 0)::BIGINT] AS cy FROM pr GROUP BY l, r),
  tl AS (SELECT l, r, count(*) FILTER (x <= cx) AS a, count(*) FILTER (y <= cy) AS b, count(*) FILTER (x <= cx AND y <= cy) AS j FROM pr JOIN cut USING (l, r) GROUP BY l, r),
  sk AS (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY l, r) AS n FROM pr),
  sg AS (SELECT DISTINCT l, r, n, least(60, n) AS size, greatest(1, least(60, n) // 3) AS step FROM sk WHERE n >= 20),
  ss AS (SELECT DISTINCT l, r, size, unnest(list_append(range(0, n - size + 1, step), n - size)) AS s FROM sg),
  st AS (SELECT l, r, coalesce(stddev_samp(c), 0) AS stability FROM (SELECT l, r, s, {_CORR.format('x', 'y')} AS c FROM sk JOIN ss USING (l, r) WHERE i >= s AND i < s + size GROUP BY l, r, s) GROUP BY l, r),
  oc AS (SELECT l, r, date, sum(x) OVER w AS cx, sum(y) OVER w AS cy FROM pr WINDOW w AS (PARTITION BY l, r ORDER BY date)),
  od AS (SELECT l, r, exp(cx - greatest(0, max(cx) OVER w)) - 1 AS dx, exp(cy - greatest(0, max(cy) OVER w)) - 1 AS dy FROM oc WINDOW w AS (PARTITION BY l, r ORDER BY date)),
  ov AS (SELECT l, r, avg(CASE WHEN dx <= -0.05 AND dy <= -0.05 THEN 1.0::DOUBLE ELSE 0 END) AS overlap FROM od GROUP BY l, r)"""
#: Every statistic of a pair by name, in SQL over the tables of _STATS.
_FIGURES = {
    "n": "mo.n", "pearson": "mo.c", "spearman": "spearman", "covariance": "cov", "beta_left": _div("cov", "vy"), "beta_right": _div("cov", "vx"),
    "n_downside": "coalesce(dn.k, 0)", "downside_correlation": "coalesce(dn.c, 0)", "left_tail": "a", "right_tail": "b", "joint_tail": "j",
    "tail_dependence": "j / least(a, b)::DOUBLE", "co_exceedance": "j / mo.n::DOUBLE", "stability": "coalesce(stability, 0)", "overlap": "overlap",
}
_WHOLE = {"n", "n_downside", "left_tail", "right_tail", "joint_tail"}


@query(f"""{_STATS} SELECT l AS "left", r AS "right", {', '.join(f'{x if name in _WHOLE else _z(x)} AS {name}' for name, x in _FIGURES.items())}
  FROM mo JOIN sc USING (l, r) JOIN tl USING (l, r) LEFT JOIN dn USING (l, r) LEFT JOIN st USING (l, r) JOIN ov USING (l, r)""")
def pair_statistics(spark, d):
    return blocks.statistics(_rets("nation", spark, d), listings=_nations(spark, d))


@query(f"{_PAIRS}, {_MOM} SELECT count(*) AS n, {_z('avg(c)')} AS mean, {_z('median(c)')} AS median, {_z('min(c)')} AS least, {_z('max(c)')} AS greatest FROM mo")
def pair_metric_card(spark, d):
    return pairs.metric_card(_moments(spark, d), "pearson")


@query(f"""{_PAIRS}, {_MOM}, RECURSIVE_EDGES""".replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_EDGES", """ed AS (SELECT l, r FROM mo WHERE c >= 0.04 UNION SELECT r, l FROM mo WHERE c >= 0.04),
  reach AS (SELECT l AS listing, l AS other FROM mo UNION SELECT r, r FROM mo UNION SELECT reach.listing, ed.r FROM reach JOIN ed ON ed.l = reach.other) SELECT listing, min(other) AS cluster FROM reach GROUP BY listing"""))
def corr_clusters(spark, d):
    from ..sources.tables import checkpointed

    return checkpointed(spark, lambda: pairs.clusters(_moments(spark, d), 0.04))


# ---------------------------------------------------------------- matrix and portfolio
@query(f"{_MATRIX} SELECT listing, date, {_z('ret')} AS ret, {_z('simple')} AS simple FROM m")
def return_matrix(spark, d):
    return _matrix(spark, d).select("listing", "date", "ret", "simple")


@query(f"""{_MATRIX}, {_TAIL.format(key='', x='simple', t='m')}, a AS (SELECT listing, count(*) AS n, avg(simple) * {_YEAR} AS y, coalesce(stddev_samp(simple), 0) * {_ROOT} AS s, sqrt(avg(pow(least(simple, 0), 2))) * {_ROOT} AS dn FROM m GROUP BY listing)
  SELECT listing, n, {_z('y')} AS annual_return, {_z('s')} AS annual_volatility, {_z(_div('y', 's'))} AS sharpe, {_z(_div('y', 'dn'))} AS sortino, {_z('var')} AS value_at_risk, {_z('es')} AS cvar, k AS tail_count FROM a JOIN tl USING (listing)""")
def asset_metrics(spark, d):
    return portfolio.asset_metrics(_matrix(spark, d))


@query(f"{_PORT} SELECT date, {_z('r')} AS r FROM p")
def portfolio_returns(spark, d):
    return _portfolio(spark, d)


_DD = """, wl AS (SELECT date, r, product(1 + r) OVER (ORDER BY date) AS wealth FROM p), pk AS (SELECT *, greatest(1, max(wealth) OVER (ORDER BY date)) AS peak FROM wl),
  isl AS (SELECT *, sum(ap) OVER (ORDER BY date) AS isl FROM (SELECT *, CASE WHEN wealth >= greatest(1, coalesce(lag(peak) OVER (ORDER BY date), 1)) THEN 1 ELSE 0 END AS ap FROM pk)),
  du AS (SELECT *, CASE WHEN ap = 1 THEN 0 ELSE sum(1 - ap) OVER (PARTITION BY isl ORDER BY date) END AS du FROM isl)"""


@query(f"{_PORT}{_DD} SELECT date, {_z('r')} AS r, {_z('wealth')} AS wealth, {_z('peak')} AS peak, {_z('wealth / peak - 1')} AS drawdown, CAST(du AS BIGINT) AS duration, CAST(CASE WHEN ap = 1 THEN coalesce(lag(du) OVER (ORDER BY date), 0) ELSE 0 END AS BIGINT) AS recovery_duration FROM du")
def drawdowns(spark, d):
    return portfolio.drawdowns(_portfolio(spark, d))


@query(f"""{_PORT}{_DD}, a AS (SELECT count(*) AS n, avg(r) * {_YEAR} AS y, coalesce(stddev_samp(r), 0) * {_ROOT} AS s, sqrt(avg(pow(least(r, 0), 2))) * {_ROOT} AS dn, min(wealth / peak - 1) AS dd, sqrt(avg(pow(wealth / peak - 1, 2))) AS ui FROM du)
  SELECT n, {_z('y')} AS annual_return, {_z('s')} AS annual_volatility, {_z(_div('y', 's'))} AS sharpe, {_z(_div('y', 'dn'))} AS sortino, {_z('dd')} AS max_drawdown, {_z(_div('y', 'abs(dd)'))} AS calmar, {_z('ui')} AS ulcer_index FROM a""")
def portfolio_metrics(spark, d):
    return portfolio.portfolio_metrics(_portfolio(spark, d))


_COV = """, cv AS (SELECT a.listing AS l, b.listing AS r, coalesce(covar_samp(a.simple, b.simple), 0) AS c FROM m a JOIN m b USING (date) GROUP BY 1, 2)"""


@query(f"{_MATRIX}{_COV} SELECT l AS \"left\", r AS \"right\", {_z('c', 12)} AS covariance FROM cv", 12)
def covariance_sample(spark, d):
    return portfolio.complete(portfolio.covariance(_matrix(spark, d)))


@query(f"""{_MATRIX}, z AS (SELECT listing, date, simple - avg(simple) OVER (PARTITION BY listing) AS z FROM m), c AS (SELECT a.listing AS l, b.listing AS r, a.z AS x, b.z AS y FROM z a JOIN z b USING (date)),
  s AS (SELECT l, r, count(*) AS t, sum(x * y) / (count(*) - 1) AS s FROM c GROUP BY l, r), n AS (SELECT count(DISTINCT l) AS n, sum(CASE WHEN l = r THEN s END) / count(DISTINCT l) AS mu, max(t)::DOUBLE AS t FROM s),
  dl AS (SELECT sum(pow(s - CASE WHEN l = r THEN mu ELSE 0 END, 2)) / max(n) AS dl FROM s, n), be AS (SELECT sum(pow(x * y - s, 2)) AS b FROM c JOIN s USING (l, r)),
  k AS (SELECT greatest(0, least(1, coalesce(b / (t * t) / n / nullif(dl, 0), 0))) AS k, mu FROM n, dl, be)
  SELECT l AS "left", r AS "right", {_z('(1 - k) * s + CASE WHEN l = r THEN k * mu ELSE 0 END', 9)} AS covariance, {_z('k', 9)} AS intensity FROM s, k""", 9)
def covariance_ledoit_wolf(spark, d):
    return portfolio.covariance_ledoit_wolf(_matrix(spark, d))


@query(f"""{_MATRIX}, z AS (SELECT listing, date, simple - avg(simple) OVER (PARTITION BY listing) AS z, row_number() OVER (PARTITION BY listing ORDER BY date) AS i, count(*) OVER (PARTITION BY listing) AS t FROM m),
  w AS (SELECT *, CASE WHEN i = 1 THEN pow(0.94::DOUBLE, t - 1) ELSE (1 - 0.94::DOUBLE) * pow(0.94::DOUBLE, t - i) END AS w FROM z) SELECT a.listing AS "left", b.listing AS "right", {_z('sum(a.w * a.z * b.z)', 12)} AS covariance FROM w a JOIN z b USING (date) GROUP BY 1, 2""", 12)
def covariance_ewma(spark, d):
    return portfolio.covariance_ewma(_matrix(spark, d))


_W = f"{_PORT}{_COV}"


@query(f"{_W} SELECT {_z('sum(a.weight * b.weight * c)', 12)} AS variance FROM cv JOIN w a ON l = a.listing JOIN w b ON r = b.listing", 12)
def portfolio_variance(spark, d):
    m = _matrix(spark, d)
    return portfolio.variance(portfolio.covariance(m), portfolio.equal_weights(m))


@query(f"""{_W}, x AS (SELECT l, a.weight AS w, sum(c * b.weight) AS m FROM cv JOIN w a ON l = a.listing JOIN w b ON r = b.listing GROUP BY l, a.weight), y AS (SELECT *, sqrt(sum(w * m) OVER ()) AS sd FROM x)
  SELECT l AS listing, {_z('w', 9)} AS weight, {_z(_div('m', 'sd'), 9)} AS marginal, {_z('w * ' + _div('m', 'sd'), 9)} AS contribution, {_z('w * ' + _div(_div('m', 'sd'), 'sd'), 9)} AS share FROM y""", 9)
def risk_contributions(spark, d):
    m = _matrix(spark, d)
    return portfolio.risk_contributions(portfolio.covariance(m), portfolio.equal_weights(m))


@query(f"""{_W}, x AS (SELECT sqrt(sum(a.weight * b.weight * c)) AS sd, sum(CASE WHEN l = r THEN a.weight * sqrt(c) END) AS own, sum(CASE WHEN l = r THEN a.weight * a.weight END) AS hhi FROM cv JOIN w a ON l = a.listing JOIN w b ON r = b.listing)
  SELECT {_z('own / sd')} AS diversification_ratio, {_z('1 / hhi')} AS effective_positions FROM x""")
def diversification_ratio(spark, d):
    m = _matrix(spark, d)
    return portfolio.diversification(portfolio.covariance(m), portfolio.equal_weights(m))


@query(f"{_MATRIX}{_COV} SELECT l AS listing, {_z('(1 / sqrt(c)) / sum(1 / sqrt(c)) OVER ()')} AS weight FROM cv WHERE l = r")
def inverse_volatility(spark, d):
    return portfolio.inverse_volatility(portfolio.covariance(_matrix(spark, d)))


_GRID = f"""{_MATRIX}{_COV}, nm AS (SELECT listing, row_number() OVER (ORDER BY listing) AS k, avg(simple) AS mu FROM m GROUP BY listing),
  g AS (SELECT [a, b, c, d, 10 - a - b - c - d] AS cand FROM (SELECT unnest(range(0, 11)) AS a), (SELECT unnest(range(0, 11)) AS b), (SELECT unnest(range(0, 11)) AS c), (SELECT unnest(range(0, 11)) AS d) WHERE a + b + c + d <= 10),
  sc AS (SELECT cand, sum(cand[i.k] / 10.0::DOUBLE * (cand[j.k] / 10.0::DOUBLE) * c) AS v FROM g, cv JOIN nm i ON l = i.listing JOIN nm j ON r = j.listing GROUP BY cand),
  mu AS (SELECT cand, sum(cand[k] / 10.0::DOUBLE * mu) AS e FROM g, nm GROUP BY cand), gs AS (SELECT cand, v, e FROM sc JOIN mu USING (cand))"""


def _scores(spark, d):
    m = _matrix(spark, d)
    return portfolio.grid_scores(portfolio.covariance(m), m.groupBy("listing").agg(F.avg("simple").alias("mean")))


@query(f"{_GRID} SELECT array_to_string(cand, ',') AS weights, {_z('v', 9)} AS variance, {_z('e', 9)} AS expected FROM gs ORDER BY round(v, 12), cand LIMIT 1", 9)
def grid_min_variance(spark, d):
    return portfolio.best(_scores(spark, d), "min_variance")


@query(f"{_GRID} SELECT array_to_string(cand, ',') AS weights, {_z('v', 9)} AS variance, {_z('e', 9)} AS expected FROM gs ORDER BY -round(coalesce(e / nullif(sqrt(v), 0), 0), 12), cand LIMIT 1", 9)
def grid_max_sharpe(spark, d):
    return portfolio.best(_scores(spark, d), "max_sharpe")


_PARTS = """, hw AS (SELECT cand, j.k, sum(cand[i.k] / 10.0::DOUBLE * (cand[j.k] / 10.0::DOUBLE) * c) AS p FROM g, cv JOIN nm i ON l = i.listing JOIN nm j ON r = j.listing GROUP BY cand, j.k),
  sq AS (SELECT cand, sum(p * p) AS sq FROM hw GROUP BY cand), ow AS (SELECT cand, sum(cand[k] / 10.0::DOUBLE * sqrt(c)) AS own FROM g, nm JOIN cv ON l = listing AND r = listing GROUP BY cand), ob AS (SELECT * FROM gs JOIN sq USING (cand) JOIN ow USING (cand))"""


@query(f"{_GRID}{_PARTS} SELECT array_to_string(cand, ',') AS weights, {_z('v', 9)} AS variance, {_z('e', 9)} AS expected FROM ob ORDER BY -round(coalesce(own / nullif(sqrt(v), 0), 0), 12), cand LIMIT 1", 9)
def grid_max_diversification(spark, d):
    return portfolio.best(_scores(spark, d), "max_diversification")


@query(f"{_GRID}{_PARTS} SELECT array_to_string(cand, ',') AS weights, {_z('v', 9)} AS variance, {_z('e', 9)} AS expected FROM ob ORDER BY round(sq / (v * v) - 0.2::DOUBLE, 9), cand LIMIT 1", 9)
def grid_risk_parity(spark, d):
    return portfolio.best(_scores(spark, d), "risk_parity")


@query(f"{_GRID} SELECT array_to_string(cand, ',') AS weights, {_z('v', 9)} AS variance, {_z('e', 9)} AS expected FROM gs ORDER BY -round(e, 12), cand LIMIT 1", 9)
def grid_max_return(spark, d):
    return portfolio.best(_scores(spark, d), "max_return")


@query(f"""{_GRID}, t AS (SELECT unnest([0.0, 0.001, 0.01, 9.0])::DOUBLE AS target), b AS (SELECT target, min(struct_pack(v := round(v, 12), cand := cand)) AS b FROM t JOIN gs ON round(e, 12) >= target GROUP BY target)
  SELECT target, {_z('coalesce(b.v, 0)', 9)} AS variance, coalesce(array_to_string(b.cand, ','), '') AS weights FROM t LEFT JOIN b USING (target)""", 9)
def efficient_frontier(spark, d):
    return portfolio.frontier(_scores(spark, d), [0.0, 0.001, 0.01, 9.0])


@query(f"""{_PORT}, dt AS (SELECT date, coalesce(date_trunc('month', date) <> lag(date_trunc('month', date)) OVER (ORDER BY date), true) AS reb FROM (SELECT DISTINCT date FROM m)),
  sg AS (SELECT *, coalesce(sum(CASE WHEN reb THEN 1 ELSE 0 END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM dt),
  x AS (SELECT date, seg, reb, weight, weight * product(1 + simple) OVER (PARTITION BY m.listing, seg ORDER BY date) AS g FROM m JOIN sg USING (date) JOIN w ON w.listing = m.listing),
  f AS (SELECT date, seg, reb, sum(g) AS f FROM x GROUP BY ALL), y AS (SELECT f.*, dr FROM f JOIN (SELECT x.date, sum(abs(g / f - weight)) / 2 AS dr FROM x JOIN f USING (date) GROUP BY x.date) USING (date)),
  v AS (SELECT *, coalesce(product(CASE WHEN reb THEN f * (1 - 0.001::DOUBLE * dr) ELSE 1 END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS b FROM y)
  SELECT date, reb AS rebalanced, {_z('b * f * CASE WHEN reb THEN 1 - 0.001::DOUBLE * dr ELSE 1 END', 3)} AS "value", {_z('CASE WHEN reb THEN dr ELSE 0 END', 3)} AS turnover FROM v""", 3)
def rebalance_monthly(spark, d):
    m = _matrix(spark, d)
    return portfolio.rebalance(m, portfolio.equal_weights(m), "month", 0.001)


@query(f"""{_PORT}, x AS (SELECT date, round(product(1 + r) OVER w - 1, 9) AS c, count(*) OVER w AS k FROM p WINDOW w AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING))
  SELECT date AS start, {_z('c')} AS compounded FROM x WHERE k = 21 ORDER BY c, date LIMIT 1""")
def worst_window(spark, d):
    return portfolio.worst_window(_portfolio(spark, d), 21)


@query(f"{_PORT} SELECT date, {_z('sum(weight * CASE WHEN listing IN (' + chr(39) + 'ASIA' + chr(39) + ') THEN simple * 0.5::DOUBLE ELSE simple END)')} AS r FROM m JOIN w USING (listing) GROUP BY date")
def distribution_cut(spark, d):
    m = portfolio.distribution_cut(_matrix(spark, d), ["ASIA"], -0.5)
    return portfolio.portfolio_returns(m, portfolio.equal_weights(m))


@query(f"""{_MATRIX}{_COV}, v AS (SELECT l AS k, sqrt(c) AS s FROM cv WHERE l = r) SELECT l AS "left", r AS "right", {_z('(c / (a.s * b.s) + (1 - c / (a.s * b.s)) * 0.5::DOUBLE) * a.s * b.s', 9)} AS covariance FROM cv JOIN v a ON l = a.k JOIN v b ON r = b.k""", 9)
def correlation_convergence(spark, d):
    return portfolio.converged(portfolio.covariance(_matrix(spark, d)), 0.5)


@query(f"""{_PORT}, dt AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM m)), s AS (SELECT unnest(range(0, (max(n) - 273) // 21 + 1)) AS split FROM dt),
  j AS (SELECT split, date FROM s JOIN dt ON i >= split * 21 + 252 AND i < split * 21 + 273) SELECT split::INT AS split, min(date) AS start, count(*) AS n, {_z('product(1 + r) - 1')} AS total_return, {_z('coalesce(stddev_samp(r), 0)')} AS volatility FROM j JOIN p USING (date) GROUP BY split""")
def walk_forward_equal_weight(spark, d):
    return portfolio.walk_forward_equal(_matrix(spark, d), 252, 21)


@query(f"WITH {_ISINS}, x AS (SELECT currency, count(*) AS n FROM isins GROUP BY currency) SELECT currency, n, {_z('n / (sum(n) OVER ())::DOUBLE')} AS share FROM x")
def currency_exposure(spark, d):
    x = adapters.all_isins(spark, d).groupBy("currency").agg(F.count("*").alias("n"))
    return x.join(F.broadcast(x.agg(F.sum("n").alias("t")))).select("currency", "n", (F.col("n") / F.col("t")).alias("share"))


@query(f"""WITH {_quotes('region')}, t AS (SELECT listing, max_by(px, date) AS px, 1.0::DOUBLE / (SELECT count(DISTINCT listing) FROM q) AS w FROM q GROUP BY listing),
  z AS (SELECT *, CAST(floor(1e6 * (1 - 0.05) * w / px) AS BIGINT) AS k FROM t) SELECT listing, k AS quantity, {_z('k * px', 4)} AS amount, CASE WHEN k > 0 THEN 'BUY' ELSE 'SKIP' END AS side FROM z""", 4)
def order_sizing(spark, d):
    q = _quoted("region", spark, d)
    t = q.groupBy("listing").agg(F.max_by("px", "date").alias("px")).join(portfolio.equal_weights(q), "listing")
    return portfolio.order_sizes(t, 1e6, 0.05)


# ---------------------------------------------------------------- iterative, held against invariants in the tests
@query()
def solve_min_variance(spark, d):
    return solvers.solved(_named(spark, d), "min_variance")


@query()
def solve_erc(spark, d):
    return solvers.solved(_named(spark, d), "equal_risk")


@query()
def solve_min_cvar(spark, d):
    return solvers.solved_cvar(_matrix(spark, d).withColumn("portfolio", F.lit("all")))


@query()
def hrp_weights(spark, d):
    return solvers.solved(_named(spark, d), "hierarchical")


@query()
def hrp_linkage(spark, d):
    return solvers.linked(_named(spark, d))


@query()
def balanced_ensemble(spark, d):
    shrunk = portfolio.covariance_ledoit_wolf(_matrix(spark, d)).withColumn("portfolio", F.lit("all"))
    return solvers.balanced(_named(spark, d), shrunk)


@query()
def risk_model_condition(spark, d):
    return solvers.eigenvalues(_named(spark, d))


@query()
def rebalance_threshold(spark, d):
    return solvers.rebalance_threshold(_matrix(spark, d).withColumn("portfolio", F.lit("all")), 0.02, 0.001)


@query()
def block_bootstrap(spark, d):
    return solvers.bootstrap(_portfolio(spark, d), 21, 20, 7)


from . import advice, incremental, more, third  # noqa: E402, F401  registers the queries of the other parts
