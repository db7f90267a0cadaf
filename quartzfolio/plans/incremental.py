"""Fourth part of the queries: content ids, the pair store, resumed work, segments, rebalancing with holes, constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import nearest, rounded
from ..operators import blocks, constraints, identity, ingest, pairs, portfolio, series
from ..sources import adapters, pair_store, resume, segments
from ..sources.tables import shared_path
from . import queries as q

query, _z = q.query, q._z
BUCKETS = 8


def _limb(text: str, k: int) -> str:
    return f"sum(CAST('0x' || substr(sha256({text}), {1 + 15 * k}, 15) AS BIGINT))"


def _digest(text: str) -> str:
    """identity.set_digest in SQL."""
    return f"sha256(concat_ws(':', count(*), {_limb(text, 0)}, {_limb(text, 1)}))"


def _micro(x: str) -> str:
    return f"CAST(CAST(round({x} * 1000000) AS BIGINT) AS VARCHAR)"


# ---------------------------------------------------------------- content ids
_SERIES = f"""sr AS (SELECT listing, count(*) AS n, {_digest(f"date || '|' || {_micro('ret')}")} AS id FROM r GROUP BY listing)"""
_ALIGNED = f"""al AS (SELECT l, r, count(*) AS n, {_digest(f"date || '|' || {_micro('x')} || '|' || {_micro('y')}")} AS id FROM pr GROUP BY l, r)"""


@query(f"WITH {q._quotes('supplier')}, {q._R}, {_SERIES} SELECT listing, n, id AS series_id FROM sr")
def series_ids(spark, d):
    return identity.series_ids(q._rets("supplier", spark, d)).select("listing", "n", "series_id")


@query(f'{q._PAIRS}, {_ALIGNED} SELECT l AS "left", r AS "right", n, id AS alignment_id FROM al')
def alignment_ids(spark, d):
    return identity.alignment_ids(q._pairs(spark, d))


@query(f"""{q._PAIRS}, {_ALIGNED}, {_SERIES} SELECT l AS "left", r AS "right", 'bivariate-' || substr(sha256('{{"algorithm":"1","alignment":"' || al.id || '","left":"' || least(a.id, b.id) || '","policy":"2","right":"' || greatest(a.id, b.id) || '"}}'), 1, 24) AS artifact_id
  FROM al JOIN sr a ON a.listing = l JOIN sr b ON b.listing = r""")
def artifact_ids(spark, d):
    return identity.artifact_ids(identity.alignment_ids(q._pairs(spark, d)), identity.series_ids(q._rets("nation", spark, d)))


@query(f"""WITH {q._ISINS}, m AS (SELECT DISTINCT exchange AS selection, trim(isin) AS member FROM isins)
  SELECT selection, count(*) AS members, 'members-' || substr(sha256({_digest('member')}), 1, 24) AS membership_id FROM m GROUP BY selection""")
def membership_ids(spark, d):
    return identity.membership_ids(adapters.all_isins(spark, d).select(F.col("exchange").alias("selection"), F.col("isin").alias("member")))


# ---------------------------------------------------------------- the pair store
def _changed(rets: DataFrame) -> DataFrame:
    """The returns with those of the first listing changed from 1998 on, and without the last listing."""
    ends = rets.agg(F.min("listing").alias("first"), F.max("listing").alias("last"))  # one row
    d = rets.join(F.broadcast(ends)).filter("listing != last")
    return d.withColumn("ret", F.when((F.col("listing") == F.col("first")) & (F.col("date") >= F.lit("1998-01-01").cast("date")), F.col("ret") * 2).otherwise(F.col("ret"))).drop("first", "last")


_STORE = f"""WITH {q._quotes('nation')}, {q._R}, k AS (SELECT listing, row_number() OVER (ORDER BY listing) - 1 AS id, listing = min(listing) OVER () AS first, listing = max(listing) OVER () AS last FROM (SELECT DISTINCT listing FROM r)),
  p AS (SELECT a.listing AS l, b.listing AS r, CAST(a.id % {BUCKETS} AS INT) AS bucket, a.first OR b.first AS changed, a.last OR b.last AS gone FROM k a JOIN k b ON a.listing < b.listing),
  r2 AS (SELECT listing, date, CASE WHEN first AND date >= DATE '1998-01-01' THEN 2 * ret ELSE ret END AS ret FROM r JOIN k USING (listing) WHERE NOT last),
  v AS (SELECT a.listing AS l, b.listing AS r, {q._CORR.format('a.ret', 'b.ret')} AS c FROM r2 a JOIN r2 b USING (date) WHERE a.listing < b.listing GROUP BY 1, 2)"""


@query(f"""{_STORE}, b AS (SELECT bucket, count(*) FILTER (NOT gone) AS rows, count(*) FILTER (changed AND NOT gone) AS fresh, count(*) FILTER (gone) AS dropped, coalesce(sum(round(c, 6)), 0) AS total FROM p LEFT JOIN v USING (l, r) GROUP BY bucket)
  SELECT bucket, CASE WHEN fresh + dropped = 0 THEN 'kept' WHEN rows = 0 THEN 'removed' ELSE 'rewritten' END AS status, rows, fresh, dropped, {_z('total', 4)} AS total FROM b""", 4)
def pair_store_update(spark, d):
    """Writes all pairs, changes one listing and drops another, and brings the store up to date."""
    store = pair_store.PairStore(spark, shared_path(spark, "pair_store"), buckets=BUCKETS)
    rets = q._rets("nation", spark, d)
    store.update(rets)
    report = store.update(_changed(rets))
    total = store.rows().groupBy("bucket").agg(F.sum(nearest(F.coalesce("pearson", F.lit(0.0)), 6)).alias("total"))
    return report.join(total, "bucket", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


@query(f"""{_STORE} SELECT l AS "left", r AS "right", CASE WHEN gone THEN 'missing' WHEN changed THEN 'stale' ELSE 'hit' END AS status FROM p""")
def pair_store_selection(spark, d):
    """What the store of a changed market knows of the market before."""
    store = pair_store.PairStore(spark, shared_path(spark, "pair_store"), buckets=BUCKETS)
    rets = q._rets("nation", spark, d)
    store.update(_changed(rets))
    return store.selected(identity.series_ids(rets).select("listing", "series_id")).drop("bucket")


@query(f"{q._PAIRS}, {q._MOM}, k AS (SELECT listing, row_number() OVER (ORDER BY listing) - 1 AS id FROM (SELECT DISTINCT listing FROM r)) SELECT CAST(id % {BUCKETS} AS INT) AS bucket, count(*) AS n, {_z('sum(round(c, 6))', 4)} AS total FROM mo JOIN k ON l = listing WHERE abs(c) >= 0.06 GROUP BY 1", 4)
def edge_store(spark, d):
    """Edges above a threshold are written, then those above a higher one: buckets without any go."""
    path, m = shared_path(spark, "edges"), q._moments(spark, d).select("left", "right", "pearson").checkpoint()
    names = m.select(F.explode(F.array("left", "right")).alias("listing")).distinct()
    # `aligned` and `block_pairs` bound the listings that this window numbers.
    numbers = names.withColumn("number", F.row_number().over(pair_store.Window.partitionBy().orderBy("listing")) - 1)
    for least in (0.02, 0.06):
        pair_store.write_edges(pairs.edges(m, least=least), numbers, path, "1", "pearson", BUCKETS)
    rows = pair_store.read_rows(spark, path, "left string, right string, pearson double, version string, metric string, bucket int")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(nearest("pearson", 6)).alias("total"))


# ---------------------------------------------------------------- resumed work, deltas, segments
@query(f"""WITH {q._quotes('nation')}, n AS (SELECT count(DISTINCT listing) FILTER (date < DATE '1996-01-01') AS early, count(DISTINCT listing) AS every FROM q), a AS (SELECT listing, max(date) AS b, max(CASE WHEN date < DATE '1996-01-01' THEN date END) AS a FROM q GROUP BY listing)
  SELECT listing, {_z('min(d)')} AS max_drawdown, any_value(early) AS first_run, CAST(0 AS BIGINT) AS second_run, (SELECT count(*) FROM a WHERE a IS DISTINCT FROM b) AS third_run FROM (SELECT listing, px / max(px) OVER (PARTITION BY listing ORDER BY date) - 1 AS d FROM q), n GROUP BY listing""")
def resume_manifest(spark, d):
    """Three runs: the quotes before 1996, the same again, and all quotes."""
    work = resume.Resumable(spark, shared_path(spark, "resume"), "listing string, max_drawdown double")
    quotes = q._quoted("nation", spark, d)
    early = quotes.filter("date < DATE '1996-01-01'")

    def run(some: DataFrame) -> int:
        inputs = some.groupBy("listing").agg(F.max("date").cast("string").alias("content"))
        return work.run(inputs, lambda todo: series.max_drawdown(some.join(todo, "listing", "left_semi")))

    runs = [run(early), run(early), run(quotes)]
    return work.outputs().select("*", *(F.lit(n).cast("long").alias(f"{name}_run") for name, n in zip(("first", "second", "third"), runs, strict=True)))


_TABLES = {"returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'"}


@query(f"""WITH s AS ({' UNION ALL '.join(f"SELECT '{k}' AS dataset, CAST(l_suppkey AS VARCHAR) AS listing, CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE {c} AND l_suppkey % 3 <> 0" for k, c in _TABLES.items())}),
  l AS (SELECT dataset, listing, max(date) AS last FROM s GROUP BY ALL), w AS (SELECT dataset, CAST(s_suppkey AS VARCHAR) AS listing FROM supplier, (SELECT unnest({list(_TABLES)}) AS dataset))
  SELECT dataset, listing, coalesce(CAST(CAST(last - INTERVAL 1 DAY AS DATE) AS VARCHAR), '') AS start_date, '2002-12-31' AS end_date FROM w LEFT JOIN l USING (dataset, listing)""")
def dataset_deltas(spark, d):
    line, names = adapters.read(spark, d, "lineitem"), adapters.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("listing"))
    stored = [line.filter(c).filter("l_suppkey % 3 <> 0").select(F.lit(k).alias("dataset"), F.col("l_suppkey").cast("string").alias("listing"), F.col("l_shipdate").cast("date").alias("date")) for k, c in _TABLES.items()]
    wanted = names.select(F.explode(F.array(*map(F.lit, _TABLES))).alias("dataset"), "listing")
    return resume.delta_windows(reduce(DataFrame.unionByName, stored), wanted, "2002-12-31")


@query(f"""WITH e AS (SELECT event_type AS listing, CAST(ts AS DATE) AS date, CAST(round(round(avg(value), 6) * 1000000) AS BIGINT) AS micro FROM events GROUP BY 1, 2),
  o AS (SELECT *, sha256('{{"date":"' || date || '","listing":"' || listing || '","micro":"' || micro || '"}}') AS id FROM e)
  SELECT count(*) AS rows, {_digest('id')} AS segment_hash, true AS first_written, false AS second_written, CAST(sum(micro) AS BIGINT) AS total FROM o""")
def segment_publish(spark, d):
    """Publishes the daily values of events, then once more in another order and with repeated rows, and reads them back."""
    rows = adapters.event_quotes(spark, d).select("listing", "date", F.round(F.col("px") * 1_000_000).cast("long").alias("micro"))
    root = shared_path(spark, "segments")
    first = segments.publish(rows, root, "events", "daily")
    second = segments.publish(rows.union(rows).orderBy(F.desc("date")), root, "events", "daily")
    back = segments.read(spark, root, first)
    return back.agg(F.count("*").alias("rows"), F.lit(second["segment_hash"]).alias("segment_hash"), F.lit(first["written"]).alias("first_written"), F.lit(second["written"]).alias("second_written"), F.sum("micro").alias("total"))


# ---------------------------------------------------------------- raw answers by listing and year
def _answers(spark, d, run: str, factor: float, where: str) -> DataFrame:
    """A customer's orders as one JSON answer; every eleventh is cut off, every thirteenth has a date that is none."""
    o = adapters.read(spark, d, "orders").filter(where).select(F.col("o_custkey").alias("c"), F.col("o_orderdate").cast("date").alias("date"), nearest(F.col("o_totalprice") * factor, 2).alias("value"))
    # One value for a day, as a listing has.
    day = o.groupBy("c", "date").agg(F.max("value").alias("value"))
    row = F.struct(F.when((F.col("c") % 13 == 0) & (F.dayofmonth("date") == 13), "n/a").otherwise(F.col("date").cast("string")).alias("date"), "value")
    text = F.to_json(F.collect_list(row))
    a = day.groupBy("c").agg(text.alias("text"))
    isin = F.concat(F.lit("ISIN"), F.col("c"))
    return a.select(F.lit(run).alias("run_id"), isin.alias("isin"), F.when(F.col("c") % 2 == 0, "XETRA").otherwise("LSE").alias("exchange"), isin.alias("code"), F.lit("orders").alias("endpoint"), F.when(F.col("c") % 11 == 0, F.expr("left(text, length(text) - 3)")).otherwise(F.col("text")).alias("payload"))


_ANSWERED = """WITH x AS (SELECT o_custkey AS c, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS value FROM orders GROUP BY 1, 2),
  b AS (SELECT c, bool_or(c % 13 = 0 AND day(date) = 13) AS undated FROM x GROUP BY c), b2 AS (SELECT c, bool_or(c % 13 = 0 AND day(date) = 13) AS undated FROM x WHERE date >= DATE '1997-01-01' GROUP BY c)"""


@query(f"""{_ANSWERED}, l AS (SELECT c, date, round(value, 2) AS value, 0 AS run FROM x JOIN b USING (c) WHERE c % 11 <> 0 AND NOT undated UNION ALL SELECT c, date, round(value * 2, 2), 1 FROM x JOIN b2 USING (c) WHERE date >= DATE '1997-01-01' AND c % 11 <> 0 AND NOT undated)
  SELECT CASE WHEN c % 2 = 0 THEN 'XETRA' ELSE 'LSE' END AS exchange, CAST(year(date) AS INT) AS year, count(*) AS n, count(*) FILTER (run = 1) AS renewed, {_z('sum(value)', 2)} AS total FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY c, date ORDER BY run DESC) = 1) GROUP BY 1, 2""", 2)
def payload_rows(spark, d):
    """All answers, then those from 1997 on with other values: what the store holds by exchange and year."""
    path = shared_path(spark, "answers")
    for run, factor, where in (("r0", 1.0, "true"), ("r1", 2.0, "o_orderdate >= '1997-01-01'")):
        ingest.merge_years(ingest.parsed_payloads(_answers(spark, d, run, factor, where))[0], path)
    rows = pair_store.read_rows(spark, path, "run_id string, isin string, code string, date date, value double, exchange string, year int")
    return rows.groupBy("exchange", "year").agg(F.count("*").alias("n"), F.count_if(F.col("run_id") == "r1").alias("renewed"), F.sum("value").alias("total"))


@query(f"""{_ANSWERED} SELECT 'r0' AS run_id, 'ISIN' || c AS isin, CASE WHEN c % 2 = 0 THEN 'XETRA' ELSE 'LSE' END AS exchange, 'ISIN' || c AS code, 'orders' AS endpoint,
  CASE WHEN c % 11 = 0 THEN 'malformed_payload' ELSE 'invalid_date' END AS error_type, CASE WHEN c % 11 = 0 THEN 'not a JSON list' ELSE 'no date: n/a' END AS message FROM b WHERE c % 11 = 0 OR undated""")
def payload_errors(spark, d):
    return ingest.parsed_payloads(_answers(spark, d, "r0", 1.0, "true"))[1]


# ---------------------------------------------------------------- rebalancing with holes
#: Returns are scaled down once more, so that a decade of them stays near 1.
COST, SMALL = 0.001, adapters.SCALE / 10


def _holes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Scaled returns of which every fifth day or so lacks a listing, and the weights of two portfolios."""
    rets = q._rets("region", spark, d)
    m = rets.filter((F.dayofmonth("date") + F.length("listing")) % 5 != 0).select("listing", "date", (F.col("simple") * SMALL).alias("simple"))
    names = rets.select("listing").distinct()
    place = F.row_number().over(pair_store.Window.partitionBy().orderBy("listing"))  # five regions
    names = names.withColumns({"k": place, "n": F.count("*").over(pair_store.Window.partitionBy())})
    weights = F.array(F.struct(F.lit("equal").alias("portfolio"), (1 / F.col("n")).alias("weight")), F.struct(F.lit("tilted").alias("portfolio"), (2 * F.col("k") / (F.col("n") * (F.col("n") + 1))).alias("weight")))
    return m, names.select("listing", F.explode(weights).alias("w")).select("w.portfolio", "listing", "w.weight")


def _simulated(unit: str) -> str:
    """The simulation day by day, the values of all listings in a list."""
    return f"""WITH RECURSIVE {q._quotes('region')}, {q._R}, nm AS (SELECT listing, row_number() OVER (ORDER BY listing) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT listing FROM r)),
  h AS (SELECT listing, date, simple * {SMALL}::DOUBLE AS s FROM r WHERE (day(date) + length(listing)) % 5 <> 0), dt AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM h)),
  ds AS (SELECT i, date, date_trunc('{unit}', date) AS period, list(1 + coalesce(s, 0) ORDER BY k) AS x FROM dt CROSS JOIN nm LEFT JOIN h USING (listing, date) GROUP BY i, date),
  w AS (SELECT 'equal' AS portfolio, list(1.0::DOUBLE / n ORDER BY k) AS w FROM nm UNION ALL SELECT 'tilted', list(2.0::DOUBLE * k / (n * (n + 1)) ORDER BY k) FROM nm),
  t AS (SELECT portfolio, w, 0::BIGINT AS i, NULL::DATE AS date, NULL::DATE AS period, w AS held, w AS pre, list_sum(w) AS total, 0::DOUBLE AS drift, true AS reb, list_sum(w) AS val, list_sum(w) AS prev FROM w
    UNION ALL
    SELECT portfolio, w, i, date, period, CASE WHEN reb THEN list_transform(w, lambda e: e * val) ELSE pre END, pre, total, drift, reb, val, prev FROM
      (SELECT *, CASE WHEN reb THEN total * (1 - drift * {COST}::DOUBLE) ELSE total END AS val FROM
        (SELECT *, list_sum(list_transform(range(1, len(w) + 1), lambda j: abs(pre[j] / total - w[j]))) / 2 AS drift FROM
          (SELECT *, list_sum(pre) AS total FROM
            (SELECT t.portfolio, t.w, ds.i, ds.date, ds.period, t.val AS prev, ds.period IS DISTINCT FROM t.period AS reb, list_transform(range(1, len(w) + 1), lambda j: t.held[j] * ds.x[j]) AS pre FROM t JOIN ds ON ds.i = t.i + 1)))))"""


@query(f"""{_simulated('month')} SELECT portfolio, date, {_z('total')} AS pre_trade_value, {_z('CASE WHEN reb THEN drift ELSE 0 END')} AS turnover, {_z('total - val')} AS transaction_cost, {_z('val')} AS portfolio_value, {_z('val / prev - 1')} AS post_cost_return, 0.0::DOUBLE AS cash_remainder, reb AS rebalanced FROM t WHERE i > 0""")
def rebalance_events(spark, d):
    return portfolio.rebalance_events(*_holes(spark, d), "month", COST)[0]


@query(f"""{_simulated('quarter')}, u AS (SELECT t.*, unnest(range(1, len(w) + 1)) AS j FROM t WHERE i > 0) SELECT portfolio, listing, date, {_z('pre[j]')} AS pre_trade_value, {_z('pre[j] / total')} AS pre_trade_weight, {_z('CASE WHEN reb THEN w[j] * total ELSE pre[j] END')} AS target_value,
  {_z('CASE WHEN reb THEN w[j] * total - pre[j] ELSE 0 END')} AS trade_value, reb AS rebalanced FROM u JOIN nm ON nm.k = j""")
def rebalance_trades(spark, d):
    return portfolio.rebalance_events(*_holes(spark, d), "quarter", COST)[1]


# ---------------------------------------------------------------- constraints
LIMITS = constraints.Limits(min_weight=0.05, max_weight=0.3)
#: Five portfolios over the regions: weights by place, and which place they leave out or add.
_FOLIOS = "VALUES ('equal', 1, 0.2), ('equal', 2, 0.2), ('equal', 3, 0.2), ('equal', 4, 0.2), ('equal', 5, 0.2), ('heavy', 1, 0.5), ('heavy', 2, 0.3), ('heavy', 3, 0.1), ('heavy', 4, 0.08), ('heavy', 5, 0.02), ('short', 1, -0.1), ('short', 2, 0.3), ('short', 3, 0.3), ('short', 4, 0.3), ('short', 5, 0.3), ('holes', 1, 0.25), ('holes', 2, 0.25), ('holes', 3, 0.25), ('holes', 9, 0.25)"
_LIMITED = f"""WITH nm AS (SELECT r_name AS listing, row_number() OVER (ORDER BY r_name) AS k FROM region), f(portfolio, k, weight) AS ({_FOLIOS}),
  w AS (SELECT portfolio, coalesce(listing, 'NOWHERE') AS listing, weight FROM f LEFT JOIN nm USING (k)), x AS (SELECT DISTINCT portfolio, nm.listing FROM f, nm),
  v AS (SELECT portfolio, listing, 'negative_weight' AS violation FROM w WHERE weight < 0 UNION ALL SELECT portfolio, listing, 'below_min_weight' FROM w WHERE weight < 0.05 UNION ALL SELECT portfolio, listing, 'above_max_weight' FROM w WHERE weight > 0.3
    UNION ALL SELECT portfolio, '', 'weights_do_not_sum_to_one' FROM w GROUP BY portfolio HAVING abs(sum(weight) - 1) > 1e-9
    UNION ALL SELECT x.portfolio, x.listing, 'missing_weight' FROM x ANTI JOIN w ON x.portfolio = w.portfolio AND x.listing = w.listing UNION ALL SELECT w.portfolio, w.listing, 'unknown_listing' FROM w ANTI JOIN x ON x.portfolio = w.portfolio AND x.listing = w.listing)"""


def _folios(spark, d) -> tuple[DataFrame, DataFrame]:
    names = adapters.read(spark, d, "region").select(F.col("r_name").alias("listing"))
    names = names.withColumn("k", F.row_number().over(pair_store.Window.partitionBy().orderBy("listing")))  # five regions
    folios = spark.sql(f"SELECT col1 AS portfolio, col2 AS k, CAST(col3 AS DOUBLE) AS weight FROM {_FOLIOS}")
    weights = folios.join(names, "k", "left").select("portfolio", F.coalesce("listing", F.lit("NOWHERE")).alias("listing"), "weight")
    listings = folios.groupBy("portfolio").agg(F.count("*").alias("n")).join(F.broadcast(names.agg(F.collect_list("listing").alias("l"))))  # five regions
    return listings.select("portfolio", F.explode("l").alias("listing")), weights


@query(f"{_LIMITED} SELECT portfolio, listing, violation FROM v")
def constraint_violations(spark, d):
    listings, weights = _folios(spark, d)
    return constraints.violations(weights, LIMITS).unionByName(constraints.mismatches(listings, weights))


@query(f"{_LIMITED} SELECT portfolio, CASE WHEN max(violation) IS NULL THEN 'valid' ELSE 'blocked' END AS status, count(violation) AS violations, coalesce(min(CASE WHEN listing = '' THEN violation ELSE violation || ':' || listing END), '') AS first FROM (SELECT DISTINCT portfolio FROM w) LEFT JOIN v USING (portfolio) GROUP BY portfolio")
def weight_verdicts(spark, d):
    return constraints.verdicts(*_folios(spark, d), LIMITS)


_GRID = f"""{q._MATRIX}, nm AS (SELECT listing, row_number() OVER (ORDER BY listing) AS k FROM (SELECT DISTINCT listing FROM m)), g AS (SELECT [a, b, c, d, 10 - a - b - c - d] AS cand FROM (SELECT unnest(range(0, 11)) AS a), (SELECT unnest(range(0, 11)) AS b), (SELECT unnest(range(0, 11)) AS c), (SELECT unnest(range(0, 11)) AS d) WHERE a + b + c + d <= 10),
  cv AS (SELECT x.k AS l, y.k AS r, coalesce(covar_samp(x.simple, y.simple), 0) AS c FROM (SELECT * FROM m JOIN nm USING (listing)) x JOIN (SELECT * FROM m JOIN nm USING (listing)) y USING (date) GROUP BY 1, 2),
  s AS (SELECT cand, sum(cand[l] / 10.0::DOUBLE * cand[r] / 10.0::DOUBLE * c) AS v FROM g, cv GROUP BY cand)"""
_PICKED = "SELECT '{0}' AS limits, CASE WHEN b IS NULL THEN 'infeasible' ELSE 'optimal' END AS status, coalesce(array_to_string(b.cand, ','), '') AS weights, round(coalesce(b.v, 0), 9) AS variance FROM (SELECT min(struct_pack(v := round(v, 12), cand := cand)) AS b FROM s WHERE list_min(cand) >= {1} AND list_max(cand) <= {2})"
_BOUNDS = {"wide": (0.0, 1.0), "capped": (0.1, 0.3), "narrow": (0.0, 0.1)}


@query(f"{_GRID} {' UNION ALL '.join(_PICKED.format(k, round(lo * 10), round(hi * 10)) for k, (lo, hi) in _BOUNDS.items())}", 9)
def bounded_optimum(spark, d):
    """The least variance inside three pairs of bounds, the last of which no weights can keep."""
    m = q._matrix(spark, d).checkpoint()
    cov, means = portfolio.covariance(m).checkpoint(), m.groupBy("listing").agg(F.avg("simple").alias("mean"))
    each = [constraints.optimized(cov, means, "min_variance", constraints.Limits(min_weight=lo, max_weight=hi)).select(F.lit(k).alias("limits"), "*") for k, (lo, hi) in _BOUNDS.items()]
    return reduce(DataFrame.unionByName, each)


# ---------------------------------------------------------------- all metrics of pairs
_METRICS = [c.split()[0] for c in pairs.STATISTICS.split(", ") if c.endswith("double")]


@query(f"""{q._STATS}, wide AS (SELECT {', '.join(f'{x} AS {m}' for m, x in q._FIGURES.items() if m in _METRICS)} FROM mo JOIN sc USING (l, r) JOIN tl USING (l, r) LEFT JOIN dn USING (l, r) LEFT JOIN st USING (l, r) JOIN ov USING (l, r)),
  u AS (SELECT metric, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM (UNPIVOT (SELECT {', '.join(f'round({m}, 9) AS {m}' for m in _METRICS)} FROM wide) ON {', '.join(_METRICS)} INTO NAME metric VALUE value) WINDOW w AS (PARTITION BY metric)),
  b AS (SELECT *, least(7, floor(coalesce((value - lo) / nullif(hi - lo, 0), 0) * 8)) AS bin FROM u)
  SELECT metric, count(*) AS n, {_z('avg(value)')} AS mean, {_z('median(value)')} AS median, {_z('min(value)')} AS least, {_z('max(value)')} AS greatest, concat_ws(',', {', '.join(f'count(*) FILTER (bin = {k})' for k in range(8))}) AS bins FROM b GROUP BY metric""")
def pair_summary(spark, d):
    stats = rounded(blocks.statistics(q._rets("nation", spark, d), listings=q._nations(spark, d)), 9).checkpoint()
    return pairs.summary(stats, _METRICS)


# ---------------------------------------------------------------- stress windows, matrix diagnostics
#: Two portfolios: equal weights, and weights that rise with the listing's place.
_TWO = f"""{q._MATRIX}, nm AS (SELECT listing, row_number() OVER (ORDER BY listing) AS k FROM (SELECT DISTINCT listing FROM m)),
  w AS (SELECT 'equal' AS portfolio, listing, 1.0::DOUBLE / count(*) OVER () AS weight FROM nm UNION ALL SELECT 'rising', listing, k::DOUBLE / sum(k) OVER () FROM nm),
  p AS (SELECT portfolio, date, sum(weight * simple) AS r FROM m JOIN w USING (listing) GROUP BY ALL)"""


@query(f"""{_TWO},
  x AS (SELECT portfolio, date, round(product(1 + r) OVER s - 1, 9) AS c, count(*) OVER s AS k, max(date) OVER s AS til FROM p WINDOW s AS (PARTITION BY portfolio ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING)),
  b AS (SELECT * FROM x WHERE k = 21 QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY c, date) = 1),
  i AS (SELECT p.*, product(1 + r) OVER (PARTITION BY p.portfolio ORDER BY p.date) AS wealth, row_number() OVER (PARTITION BY p.portfolio ORDER BY -r, p.date) - 1 AS pos
        FROM p JOIN b ON p.portfolio = b.portfolio AND p.date BETWEEN b.date AND b.til),
  f AS (SELECT *, wealth / greatest(1, max(wealth) OVER (PARTITION BY portfolio ORDER BY date)) - 1 AS dd, max(CASE WHEN pos = 19 THEN -r END) OVER (PARTITION BY portfolio) AS vr FROM i),
  t AS (SELECT portfolio, min(dd) AS dd, max(vr) AS vr, avg(-r) FILTER (-r >= vr) AS cv, count(*) FILTER (-r >= vr) AS n FROM f GROUP BY portfolio)
  SELECT portfolio, b.date AS start, til AS until, {_z('c')} AS compounded, {_z('dd')} AS max_drawdown, {_z('vr')} AS value_at_risk, {_z('cv')} AS cvar, n AS tail_count FROM b JOIN t USING (portfolio)""")
def stress_windows(spark, d):
    """The worst 21 dates of two portfolios; the loss at place floor(21 * 0.95) = 19 is the value at risk."""
    m = q._matrix(spark, d)
    names = m.select("listing").distinct().withColumn("k", F.row_number().over(pair_store.Window.partitionBy().orderBy("listing")))  # five regions
    weights = names.join(F.broadcast(names.agg(F.count("*").alias("n"), F.sum("k").alias("s"))))  # one row
    weights = weights.select("listing", F.expr("inline(array(struct('equal' AS portfolio, 1D / n AS weight), struct('rising' AS portfolio, k / CAST(s AS DOUBLE) AS weight)))"))
    r = m.join(weights, "listing").groupBy("portfolio", "date").agg(F.sum(F.col("weight") * F.col("simple")).alias("r"))
    return portfolio.stress_windows(r, 21)


@query(f"""{q._W}, e AS (SELECT l, a.weight AS w, sum(c * b.weight) AS m, max(CASE WHEN l = r THEN c END) AS own FROM cv JOIN w a ON l = a.listing JOIN w b ON r = b.listing GROUP BY l, a.weight),
  o AS (SELECT count(*) AS n, sum(w * m) AS t, sum(w * m * w * m) AS q, max(w * m) AS g, sum(w * sqrt(greatest(0, own))) AS wv FROM e),
  k AS (SELECT count(*) AS n, avg(c) AS ac, avg(CASE WHEN x.own > 0 AND y.own > 0 THEN c / sqrt(x.own * y.own) END) AS ar FROM cv JOIN e x ON x.l = cv.l JOIN e y ON y.l = cv.r WHERE cv.l < cv.r)
  SELECT o.n AS listing_count, k.n AS pair_count, {_z('ac', 9)} AS average_covariance, {_z('ar', 9)} AS average_correlation, {_z('sqrt(t)', 9)} AS volatility, {_z('wv / sqrt(t)', 9)} AS diversification_ratio,
         {_z('t * t / q', 9)} AS effective_bets, {_z('g / t', 9)} AS largest_risk_share FROM o, k""", 9)
def covariance_summary(spark, d):
    m = q._matrix(spark, d)
    return portfolio.covariance_summary(portfolio.covariance(m), portfolio.equal_weights(m))
