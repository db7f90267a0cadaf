"""Price quality, returns, calendars and the statistics of a single listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import TRADING_DAYS, ratio0, running, trading_day, zero

STALE_RUN, GAP_DAYS, HISTORY = 5, 10, (252, 504, 756)


def judged(quotes: DataFrame) -> DataFrame:
    """quotes (listing, date, px, seq) with `reason`: null, duplicate_date or non_positive_price.

    A date that was seen before is a duplicate whatever its price, even if the row before was rejected itself.
    """
    w = Window.partitionBy("listing", "date").orderBy("seq")
    reason = F.when(F.row_number().over(w) > 1, "duplicate_date").when(F.col("px").isNull() | (F.col("px") <= 0), "non_positive_price")
    return quotes.withColumn("reason", reason)


def valid(quotes: DataFrame) -> DataFrame:
    return judged(quotes).filter("reason IS NULL").drop("reason")


def _with_runs(d: DataFrame, w: Window) -> DataFrame:
    """place and run: the row's number among those with `ok`, and how many of these with its price it ends.

    ok, px and before (the price of the ok row before) are columns of d. Runs are told by running aggregates of one
    sort, not grouped, as there are nearly as many runs as rows.
    """
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("place", F.count_if("ok").over(upto))
    begins = F.col("ok") & F.coalesce(F.col("px") != F.col("before"), F.lit(True))
    return d.withColumn("run", F.when(F.col("ok"), F.col("place") + 1 - F.max(F.when(begins, F.col("place"))).over(upto)))


def stale_runs(quotes: DataFrame) -> DataFrame:
    """listing, longest_run of equal prices, and whether it is stale."""
    w = Window.partitionBy("listing").orderBy("date")
    d = _with_runs(quotes.withColumns({"ok": F.lit(True), "before": F.lag("px").over(w)}), w)
    return d.groupBy("listing").agg(F.max("run").alias("longest_run")).withColumn("stale", F.col("longest_run") >= STALE_RUN)


def calendar_gaps(quotes: DataFrame, days: int = GAP_DAYS) -> DataFrame:
    """listing, gap_start, gap_end, days: dates further apart than `days`."""
    w = Window.partitionBy("listing").orderBy("date")
    d = quotes.select("listing", F.lag("date").over(w).alias("gap_start"), F.col("date").alias("gap_end"))
    return d.withColumn("days", F.datediff("gap_end", "gap_start").cast("long")).filter(F.col("days") > days)


def calendar(quotes: DataFrame, exchange: str = "") -> DataFrame:
    """date, open and no, the number of open days up to it: one row for each day of the quotes' years.

    Weekdays are open; an exchange with a calendar (XETRA) is closed on its holidays, too. No more rows than there
    are days between the first and the last quote, whatever the number of listings.
    """
    days = quotes.agg(F.min("date").alias("a"), F.max("date").alias("b")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("date"))
    days = days.withColumn("open", trading_day(F.col("date"), F.lit(exchange)))
    return days.withColumn("no", F.sum(F.col("open").cast("int")).over(Window.partitionBy().orderBy("date")).cast("int"))


def _absent(quotes: DataFrame, days: DataFrame) -> DataFrame:
    """Each quote with its day's number and how many open days are missing before it, or at the end of a listing behind the last open one."""
    d = quotes.select("listing", "date").join(F.broadcast(days), "date")
    w = Window.partitionBy("listing").orderBy("date")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("low", F.col("no") - F.col("open").cast("int"))
    d = d.withColumn("seen", F.coalesce(F.max(F.when(F.col("open"), F.col("no"))).over(before), F.first("low").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    last = F.lead("date").over(w).isNull()
    return d.withColumn("missing", F.greatest(F.lit(0), F.when(F.col("open"), F.col("no") - 1 - F.col("seen")).when(last, F.col("no") - F.col("seen")).otherwise(0)).cast("long"))


def missing_ranges(quotes: DataFrame, exchange: str = "") -> DataFrame:
    """listing, gap_start, gap_end, missing: neighbouring trading days without a quote, merged.

    Day numbers of neighbouring quotes are subtracted, so that no listing's days are spelt out.
    """
    days = calendar(quotes, exchange)
    gaps = _absent(quotes, days).filter("missing > 0").select("listing", "missing", (F.col("seen") + 1).alias("from"), (F.col("seen") + F.col("missing")).cast("int").alias("to"))
    at = lambda no, name: F.broadcast(days.filter("open").select(F.col("no").alias(no), F.col("date").alias(name)))
    return gaps.join(at("from", "gap_start"), "from").join(at("to", "gap_end"), "to").select("listing", "gap_start", "gap_end", "missing")


def coverage(quotes: DataFrame, exchange: str = "") -> DataFrame:
    """listing, days, expected, missing and next_start, five days before the last quote."""
    d = _absent(quotes, calendar(quotes, exchange)).groupBy("listing")
    return d.agg(F.countDistinct("date").alias("days"), (F.max("no") - F.min("low")).cast("long").alias("expected"), F.sum("missing").alias("missing"), F.date_sub(F.max("date"), 5).alias("next_start"))


def returns(quotes: DataFrame) -> DataFrame:
    """listing, date, ret (log) and simple, to the previous valid quote."""
    w = Window.partitionBy("listing").orderBy("date")
    d = quotes.filter("px > 0").withColumn("p", F.lag("px").over(w)).filter("p IS NOT NULL")
    return d.select("listing", "date", F.ln(F.col("px") / F.col("p")).alias("ret"), (F.col("px") / F.col("p") - 1).alias("simple"))


def distribution(rets: DataFrame) -> DataFrame:
    """Counts, location and spread of a listing's returns, annualized and plain."""
    r = F.col("ret")
    d = rets.groupBy("listing").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum(r).alias("cumulative_log_return"),
        F.avg(r).alias("mean_log_return"), F.median(r).alias("median_log_return"), F.min(r).alias("min_log_return"), F.max(r).alias("max_log_return"),
        F.avg("simple").alias("mean_simple_return"), F.median("simple").alias("median_simple_return"), zero(F.stddev_samp(r)).alias("daily_std"),
        F.sum(r * r).alias("realized_variance"), F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2))).alias("downside"), F.avg((r > 0).cast("double")).alias("positive_day_ratio"),
    )
    year, root = F.lit(float(TRADING_DAYS)), F.sqrt(F.lit(float(TRADING_DAYS)))
    mean = F.col("mean_log_return")
    d = d.withColumns({"annual_return": mean * year, "annual_volatility": F.col("daily_std") * root, "sharpe": ratio0(mean * year, F.col("daily_std") * root), "sortino": ratio0(mean * year, F.col("downside") * root)})
    return d.withColumns({f"history_{k}": F.col("n") >= k for k in HISTORY})


def tail(rets: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Historical value at risk, expected shortfall and tail size: the loss at index min(n - 1, int(c n))."""
    w = Window.partitionBy("listing").orderBy("loss", "date")
    d = rets.select("listing", "date", (-F.col("ret")).alias("loss"))
    d = d.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("listing"))})
    d = d.withColumn("at", F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(confidence))))
    v = d.groupBy("listing").agg(F.max(F.when(F.col("i") == F.col("at"), F.col("loss"))).alias("var"))
    return d.join(v, "listing").filter("loss >= var").groupBy("listing").agg(F.first("var").alias("value_at_risk"), F.avg("loss").alias("expected_shortfall"), F.count("*").alias("tail_count"))


def max_drawdown(quotes: DataFrame) -> DataFrame:
    peak = F.max("px").over(running("listing"))
    return quotes.withColumn("d", F.col("px") / peak - 1).groupBy("listing").agg(F.min("d").alias("max_drawdown"))


def trend(quotes: DataFrame) -> DataFrame:
    """Slope and fit of log prices over their order; both 0 where a price isn't positive."""
    x = F.row_number().over(Window.partitionBy("listing").orderBy("date")) - 1
    d = quotes.withColumns({"x": x.cast("double"), "y": F.when(F.col("px") > 0, F.ln(F.when(F.col("px") > 0, F.col("px"))))})
    ok = F.min("px") > 0
    return d.groupBy("listing").agg(F.when(ok, zero(F.regr_slope("y", "x"))).otherwise(0.0).alias("slope"), F.when(ok & (zero(F.var_pop("y")) > 0), zero(F.regr_r2("y", "x"))).otherwise(0.0).alias("r_squared"))


#: Fixed: bands of days between payouts.
BANDS = (("monthly", 20, 45), ("quarterly", 70, 110), ("semiannual", 150, 220), ("annual", 300, 430))


def payout_frequency(payouts: DataFrame, listings: DataFrame | None = None) -> DataFrame:
    """listing, events, last_date and frequency by the least and greatest gap between payout dates.

    With listings, those without a payout have a row, too: they accumulate.
    """
    w = Window.partitionBy("listing").orderBy("date")
    d = payouts.filter("value > 0").select("listing", "date").distinct().withColumn("gap", F.datediff("date", F.lag("date").over(w)))
    d = d.groupBy("listing").agg(F.count("*").alias("events"), F.max("date").alias("last_date"), F.min("gap").alias("lo"), F.max("gap").alias("hi"))
    kind = F.when(F.col("events") < 2, "unknown")
    for name, lo, hi in BANDS:
        kind = kind.when((F.col("lo") >= lo) & (F.col("hi") <= hi), name)
    d = d.select("listing", "events", "last_date", kind.otherwise("irregular").alias("frequency"))
    if listings is None:
        return d
    every = listings.select("listing").distinct().join(d, "listing", "left")
    return every.select("listing", F.coalesce("events", F.lit(0)).alias("events"), "last_date", F.coalesce("frequency", F.lit("accumulating")).alias("frequency"))


def trailing_payout(payouts: DataFrame, quotes: DataFrame) -> DataFrame:
    """listing, annual_amount, payouts and annual_yield of every quoted listing.

    The year ends with the last quote, whose price the yield is measured by; a listing that
    stopped paying has 0.
    """
    last = quotes.groupBy("listing").agg(F.max("date").alias("last"), F.max_by("px", "date").alias("close"))
    paid = payouts.filter("value > 0").select("listing", F.col("date").alias("paid"), "value")
    within = (F.col("paid") > F.date_sub("last", 365)) & (F.col("paid") <= F.col("last"))
    d = last.join(paid, "listing", "left").groupBy("listing").agg(zero(F.sum(F.when(within, F.col("value")))).alias("annual_amount"), F.count_if(within).alias("payouts"), F.first("close").alias("close"))
    return d.select("listing", "annual_amount", "payouts", F.when(F.col("close") > 0, ratio0(F.col("annual_amount"), F.col("close"))).otherwise(0.0).alias("annual_yield"))


def quality_gate(quotes: DataFrame) -> DataFrame:
    """A row for each listing: counts, the four flags and the first issue in their order, else `ok`.

    One shuffle and one sort by listing, date and seq, which all windows and the aggregate share; reasons are those
    of `judged`. Rows without a listing are counted, but have no series.
    """
    w = Window.partitionBy("listing").orderBy("date", "seq")
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    again = (F.row_number().over(w) > 1) & F.lag("date").over(w).eqNullSafe(F.col("date"))
    d = quotes.select("listing", "date", "px", "seq").withColumn("again", again)
    bad = ~F.col("again") & (F.col("px").isNull() | (F.col("px") <= 0))
    d = d.withColumn("bad", bad).withColumn("ok", ~F.col("again") & ~F.col("bad") & F.col("listing").isNotNull())
    last = lambda c: F.last(F.when(F.col("ok"), F.col(c)), ignorenulls=True).over(ahead)
    d = _with_runs(d.withColumns({"before": last("px"), "day_before": last("date")}), w)
    far = F.col("ok") & (F.datediff("date", "day_before") > GAP_DAYS)
    d = d.groupBy("listing").agg(
        F.count("*").alias("quotes"), F.count_if(F.col("again") | F.col("bad")).alias("quarantined"), F.bool_or("bad").alias("bad"), F.bool_or("again").alias("dup"),
        F.coalesce(F.max("run") >= STALE_RUN, F.lit(False)).alias("stale"), F.greatest(F.count_if("ok") - 1, F.lit(0)).alias("observations"), F.coalesce(F.bool_or(far), F.lit(False)).alias("gap"),
    )
    reason = F.when(F.col("bad"), "non_positive_price").when(F.col("dup"), "duplicate_date").when(F.col("stale"), "stale_price").when(F.col("gap"), "unexplained_gap").when(F.col("observations") < HISTORY[0], "insufficient_history").otherwise("ok")
    return d.withColumn("data_quality_reason", reason)


def asset_features(quotes: DataFrame) -> DataFrame:
    """First and last quote, growth (total, by year, from mean log returns), mean, spread and drawdown of each listing."""
    q = quotes.groupBy("listing").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("quotes"), (ratio0(F.max_by("px", "date"), F.min_by("px", "date")) - 1).alias("total_return"))
    r = returns(quotes).groupBy("listing").agg(F.count("*").alias("returns"), F.avg("ret").alias("mean_return"), zero(F.stddev_samp("ret")).alias("volatility"))
    d = q.join(r, "listing", "left").join(max_drawdown(quotes), "listing", "left")
    days = F.datediff("last_date", "first_date")
    cagr = F.when((days > 0) & (F.col("total_return") > -1), F.pow(1 + F.col("total_return"), F.lit(365.25) / F.nullif(days, F.lit(0))) - 1).otherwise(0.0)
    return d.select("listing", "first_date", "last_date", "quotes", F.coalesce("returns", F.lit(0)).alias("returns"), "total_return", zero(cagr).alias("cagr"), zero(F.exp(F.col("mean_return") * TRADING_DAYS) - 1).alias("geometric_return"), zero(F.col("mean_return")).alias("mean_return"), zero(F.col("volatility")).alias("volatility"), "max_drawdown")


def payout_rate(payouts: DataFrame) -> DataFrame:
    """listing, events and events_per_year between the first and last payout date; 1 for a single event."""
    d = payouts.filter("value > 0").groupBy("listing").agg(F.countDistinct("date").alias("events"), F.datediff(F.max("date"), F.min("date")).alias("days"))
    return d.select("listing", "events", F.when(F.col("events") == 1, 1.0).otherwise((F.col("events") - 1) / F.greatest("days", F.lit(1)) * 365.25).alias("events_per_year"))


def gap_plan(quotes: DataFrame, as_of: str, exchange: str = "") -> DataFrame:
    """listing, start_date, end_date, window_reason: what to fetch again; complete listings have no row."""
    last = quotes.groupBy("listing").agg(F.max("date").alias("b"))
    # No exchange is closed for ten days in a row.
    following = F.element_at(F.filter(F.sequence(F.date_add("b", 1), F.date_add("b", 10)), lambda x: trading_day(x, F.lit(exchange))), 1)
    old = missing_ranges(quotes, exchange).filter(F.col("gap_start") <= F.lit(as_of).cast("date")).groupBy("listing").agg(F.min("gap_start").alias("s"))
    d = last.select("listing", following.alias("t")).join(old, "listing", "left").filter(F.col("s").isNotNull() | (F.col("t") <= F.lit(as_of).cast("date")))
    return d.select("listing", F.coalesce("s", "t").alias("start_date"), F.lit(as_of).cast("date").alias("end_date"), F.when(F.col("s").isNull(), "tail").otherwise("gap_backfill").alias("window_reason"))
