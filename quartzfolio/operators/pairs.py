"""Statistics of pairs of listings over their common dates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import pearson, ratio0, running, zero
from ..sources.tables import shared_path

MAX_PAIRS, WINDOW, MIN_ROWS = 500_000, 60, 20
PAIR = ["left", "right"]


def guarded(listings: int, most: int = MAX_PAIRS) -> int:
    pairs = listings * (listings - 1) // 2
    if pairs > most:
        raise ValueError(f"{pairs} pairs exceed {most}")
    return pairs


def aligned(rets: DataFrame, most: int = MAX_PAIRS) -> DataFrame:
    """left, right, date, x, y: each pair once, on its common dates (equi-join on the date).

    The listings are counted first, and more than `most` pairs are an error. With a column isin, two
    listings of one ISIN are no pair.
    """
    guarded(rets.select("listing").distinct().limit(int((2 * most) ** 0.5) + 3).count(), most)
    isin = [F.col("isin")] if "isin" in rets.columns else []
    a = rets.select(F.col("listing").alias("left"), "date", F.col("ret").alias("x"), *(c.alias("i") for c in isin))
    b = rets.select(F.col("listing").alias("right"), "date", F.col("ret").alias("y"), *(c.alias("j") for c in isin))
    return a.join(b, "date").filter("left < right AND NOT i <=> j" if isin else "left < right").select("left", "right", "date", "x", "y")


STATISTICS = (
    "left string, right string, n long, pearson double, spearman double, covariance double, beta_left double, beta_right double, n_downside long, downside_correlation double, "
    "left_tail long, right_tail long, joint_tail long, tail_dependence double, co_exceedance double, stability double, overlap double"
)


def _correlation(x: np.ndarray, y: np.ndarray) -> float:
    """0 for fewer than two rows or a constant side."""
    if len(x) < 2:
        return 0.0
    a, b = x - x.mean(), y - y.mean()
    size = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / size) if size > 0 else 0.0


def _scores(x: np.ndarray) -> np.ndarray:
    """Each value against the mean and deviation of those before; 0 for the first two."""
    c, n = x - x[:1], np.arange(len(x), dtype=float)
    s, q = np.cumsum(c) - c, np.cumsum(c * c) - c * c
    with np.errstate(divide="ignore", invalid="ignore"):
        mean, var = s / n, (q - s * s / n) / (n - 1)
        return np.where((n > 1) & (var > 0), (c - mean) / np.sqrt(var), 0.0)


def pair_figures(x: np.ndarray, y: np.ndarray, share: float, window: int, depth: float) -> dict:
    """All statistics of a pair from its returns on common dates, in their order."""
    n = len(x)
    covariance, vx, vy = (float(np.cov(x, y)[i, j]) if n > 1 else 0.0 for i, j in ((0, 1), (0, 0), (1, 1)))
    both = (x < 0) & (y < 0)
    at = round((n - 1) * share)
    a, b = x <= np.sort(x)[at], y <= np.sort(y)[at]
    joint, tails = int((a & b).sum()), (int(a.sum()), int(b.sum()))
    stability = 0.0
    if n >= MIN_ROWS:
        size = min(window, n)
        starts = sorted({*range(0, n - size + 1, max(1, size // 3)), n - size})
        each = [_correlation(x[s : s + size], y[s : s + size]) for s in starts]
        stability = float(np.std(each, ddof=1)) if len(each) > 1 else 0.0
    down = [np.exp(c - np.maximum(0, np.maximum.accumulate(c))) - 1 <= depth for c in (np.cumsum(x), np.cumsum(y))]
    return {
        "n": n, "pearson": _correlation(x, y), "spearman": _correlation(_scores(x), _scores(y)), "covariance": covariance,
        "beta_left": covariance / vy if vy else 0.0, "beta_right": covariance / vx if vx else 0.0,
        "n_downside": int(both.sum()), "downside_correlation": _correlation(x[both], y[both]),
        "left_tail": tails[0], "right_tail": tails[1], "joint_tail": joint, "tail_dependence": joint / min(tails), "co_exceedance": joint / n,
        "stability": stability, "overlap": float((down[0] & down[1]).mean()),
    }


def metric_card(stats: DataFrame, metric: str) -> DataFrame:
    """n, mean, median, least and greatest of a statistic over all pairs."""
    return stats.agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.median(metric).alias("median"), F.min(metric).alias("least"), F.max(metric).alias("greatest"))


def summary(stats: DataFrame, metrics: list[str], bins: int = 8) -> DataFrame:
    """metric, n, mean, median, least, greatest and bins (counts of equal bins, comma-joined): cards and histograms of all metrics in one aggregate."""
    ends = stats.agg(*(f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("lo", F.min), ("hi", F.max))))  # one row
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"lo_{m}").alias("lo"), F.col(f"hi_{m}").alias("hi")) for m in metrics))
    d = stats.join(F.broadcast(ends)).select(F.explode(each).alias("x")).select("x.*").filter("value IS NOT NULL")
    at = F.least(F.lit(bins - 1), F.floor(ratio0(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")) * bins))
    v = "value"
    d = d.withColumn("bin", at).groupBy("metric").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("greatest"), *(F.count_if(F.col("bin") == k).alias(f"b{k}") for k in range(bins)))
    return d.select("metric", "n", "mean", "median", "least", "greatest", F.concat_ws(",", *(F.col(f"b{k}").cast("string") for k in range(bins))).alias("bins"))


def moments(pairs: DataFrame) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    d = pairs.groupBy(*PAIR).agg(F.count("*").alias("n"), pearson(x, y).alias("pearson"), zero(F.covar_samp(x, y)).alias("covariance"), zero(F.var_samp(x)).alias("left_variance"), zero(F.var_samp(y)).alias("right_variance"))
    return d.withColumns({"beta_left": ratio0(F.col("covariance"), F.col("right_variance")), "beta_right": ratio0(F.col("covariance"), F.col("left_variance"))})


def spearman_online(pairs: DataFrame) -> DataFrame:
    """Pearson of scores against the mean and deviation of the rows before; 0 for the first two."""
    before = Window.partitionBy(*PAIR).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)

    def score(c: str) -> Column:
        sd = F.sqrt(F.var_samp(c).over(before))
        return F.when(sd > 0, (F.col(c) - F.avg(c).over(before)) / F.nullif(sd, F.lit(0.0))).otherwise(0.0)

    return pairs.withColumns({"sx": score("x"), "sy": score("y")}).groupBy(*PAIR).agg(pearson(F.col("sx"), F.col("sy")).alias("spearman"))


def downside(pairs: DataFrame) -> DataFrame:
    both = F.col("x") < 0
    x, y = F.when(both & (F.col("y") < 0), F.col("x")), F.when(both & (F.col("y") < 0), F.col("y"))
    return pairs.groupBy(*PAIR).agg(F.count(x).alias("n_downside"), F.when(F.count(x) >= 2, pearson(x, y)).otherwise(0.0).alias("downside_correlation"))


def tail_events(pairs: DataFrame, share: float = 0.05) -> DataFrame:
    """Rows at or below the cutoffs of both sides (the value at rank round((n - 1) p), half to even)."""
    w = Window.partitionBy(*PAIR)
    d = pairs.withColumns({"i": F.row_number().over(w.orderBy("x")) - 1, "j": F.row_number().over(w.orderBy("y")) - 1, "n": F.count("*").over(w)})
    at = F.bround((F.col("n") - 1) * F.lit(share), 0).cast("long")
    d = d.withColumns({"cx": F.max(F.when(F.col("i") == at, F.col("x"))).over(w), "cy": F.max(F.when(F.col("j") == at, F.col("y"))).over(w)})
    a, b = F.col("x") <= F.col("cx"), F.col("y") <= F.col("cy")
    d = d.groupBy(*PAIR).agg(F.count_if(a).alias("left_tail"), F.count_if(b).alias("right_tail"), F.count_if(a & b).alias("joint_tail"), F.count("*").alias("n"))
    return d.select(*PAIR, "left_tail", "right_tail", "joint_tail", ratio0(F.col("joint_tail"), F.least("left_tail", "right_tail")).alias("tail_dependence"), ratio0(F.col("joint_tail"), F.col("n")).alias("co_exceedance"))


def rolling_stability(pairs: DataFrame, window: int = WINDOW, downside: bool = False) -> DataFrame:
    """Deviation of the correlations of rolling windows, a third apart, the last one forced.

    With `downside` a window's correlation is that of its rows with both returns below 0. A row is dealt to the few windows that hold it, so that no join of windows is needed.
    """
    w = Window.partitionBy(*PAIR)
    d = pairs.withColumns({"i": F.row_number().over(w.orderBy("date")) - 1, "n": F.count("*").over(w)}).filter(F.col("n") >= MIN_ROWS)
    d = d.withColumn("size", F.least(F.lit(window), F.col("n"))).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("size") / 3)))
    starts = "array_distinct(filter(array_append(transform(sequence(greatest(0L, i - size) div step, i div step), k -> k * step), n - size), s -> s <= i AND i < s + size AND s <= n - size))"
    both = (F.col("x") < 0) & (F.col("y") < 0) if downside else F.lit(True)
    per = d.select(*PAIR, "x", "y", F.explode(F.expr(starts)).alias("s")).groupBy(*PAIR, "s").agg(pearson(F.when(both, F.col("x")), F.when(both, F.col("y"))).alias("c"))
    return per.groupBy(*PAIR).agg(F.count("*").alias("windows"), zero(F.stddev_samp("c")).alias("stability"))


def drawdown_overlap(pairs: DataFrame, depth: float = -0.05) -> DataFrame:
    """Share of dates on which both sides are at least 5 % below their peak, from cumulated log returns."""
    w = running(*PAIR)
    d = pairs.withColumns({"cx": F.sum("x").over(w), "cy": F.sum("y").over(w)})
    down = lambda c: F.exp(F.col(c) - F.greatest(F.lit(0.0), F.max(c).over(w))) - 1
    return d.withColumns({"dx": down("cx"), "dy": down("cy")}).groupBy(*PAIR).agg(F.avg(((F.col("dx") <= depth) & (F.col("dy") <= depth)).cast("double")).alias("overlap"))


def edges(stats: DataFrame, least: float | None = None, top: int | None = None) -> DataFrame:
    """Pairs by absolute correlation: above a threshold, or the first of each left side."""
    size = F.abs("pearson")
    d = stats.select(*PAIR, "pearson")
    if least is not None:
        d = d.filter(size >= least)
    if top is not None:
        w = Window.partitionBy("left").orderBy(size.desc(), "right")
        d = d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return d


def mirrored(stats: DataFrame) -> DataFrame:
    """Both orientations of each pair."""
    return stats.unionByName(stats.select(F.col("right").alias("left"), F.col("left").alias("right"), *(c for c in stats.columns if c not in PAIR)))


def histogram(stats: DataFrame, metric: str, bins: int = 8) -> DataFrame:
    """bin, n: equal bins from the least to the greatest value, the last one closed."""
    ends = stats.agg(F.min(metric).alias("lo"), F.max(metric).alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor(ratio0(F.col(metric) - F.col("lo"), F.col("hi") - F.col("lo")) * bins))
    return stats.join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # ends is one row


def diagnostics(stats: DataFrame) -> DataFrame:
    c = F.col("pearson")
    return stats.agg(F.count("*").alias("n"), F.count_if(c >= 0.7).alias("high"), F.count_if(c >= 0.9).alias("very_high"), F.count_if(c <= 0.3).alias("low"), F.count_if(c < 0).alias("negative"), *(F.percentile(c, F.lit(p)).alias(f"p{round(p * 100)}") for p in (0.1, 0.5, 0.9)))


def clusters(stats: DataFrame, least: float = 0.7) -> DataFrame:
    """listing, cluster: components of pairs at or above a correlation, by minima of neighbours.

    `aligned` guards the number of pairs. The pairs are checkpointed once and each round is, too; a round
    also jumps to the cluster's own cluster, so that rounds grow with the logarithm of the diameter.
    """
    stats = stats.select(*PAIR, "pearson").checkpoint()
    e = mirrored(stats.filter(F.col("pearson") >= least).select(*PAIR))
    nodes = stats.select(F.explode(F.array("left", "right")).alias("listing")).distinct().withColumn("cluster", F.col("listing"))
    while True:
        near = e.join(nodes, F.col("right") == F.col("listing")).groupBy("left").agg(F.min("cluster").alias("m"))
        step = nodes.join(near, F.col("listing") == F.col("left"), "left").select("listing", F.least("cluster", F.coalesce("m", "cluster")).alias("cluster"), F.col("cluster").alias("old"))
        beyond = nodes.select(F.col("listing").alias("at"), F.col("cluster").alias("beyond"))
        new = step.join(beyond, F.col("cluster") == F.col("at")).select("listing", F.least("cluster", "beyond").alias("cluster"), "old").checkpoint()
        if new.filter("cluster <> old").isEmpty():
            return new.select("listing", "cluster")
        nodes = new.select("listing", "cluster")


def extremes(stats: DataFrame) -> DataFrame:
    """The listings with the highest and the lowest average correlation to all others."""
    a = mirrored(stats.select(*PAIR, "pearson")).groupBy("left").agg(F.avg("pearson").alias("a"))
    return a.agg(F.max_by("left", "a").alias("most_correlated"), F.max("a").alias("most_correlated_average"), F.min_by("left", "a").alias("best_diversifier"), F.min("a").alias("best_diversifier_average"))


def downside_diagnostics(pairs: DataFrame) -> DataFrame:
    """One row: how correlations on joint losses differ from plain ones, on how many days."""
    d = downside(pairs).join(moments(pairs).select(*PAIR, "pearson"), PAIR).withColumn("gap", F.col("downside_correlation") - F.col("pearson"))
    return d.agg(F.count("*").alias("n"), F.avg("gap").alias("average_gap"), F.count_if(F.abs("gap") >= 0.15).alias("large_gaps"), F.max("downside_correlation").alias("worst"), F.median("n_downside").alias("median_days"), F.min("n_downside").alias("min_days"))


#: Sets of dates of a block in `missing`, and the rows and dates of one product.
SETS, ROWS, DATES = 8192, 1024, 256


def _short(frames: pd.DataFrame, i: int, j: int, width: int, least: int) -> int:
    """How many pairs of listings of blocks i and j have fewer than `least` dates in common.

    Common dates are counted by products over some dates at a time, the most frequent ones first, until no pair is short.
    """
    sides = []
    for block in (i, j):
        rows = frames[frames["block"] == block]
        bits = np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(len(rows), -(-width // 8))
        sides.append((np.unpackbits(bits, axis=1, count=width), rows["n"].to_numpy(np.int64)))
    (x, m), (y, n) = sides
    order = np.argsort(-x.sum(0, dtype=np.int64) * y.sum(0, dtype=np.int64), kind="stable")
    total = 0
    for a in range(0, len(x), ROWS):
        for b in range(a if i == j else 0, len(y), ROWS):
            u, v = x[a : a + ROWS], y[b : b + ROWS]
            common = np.zeros((len(u), len(v)), np.float32)
            for k in range(0, width, DATES):
                at = order[k : k + DATES]
                common += u[:, at].astype(np.float32) @ v[:, at].T.astype(np.float32)
                if common.min() >= least:
                    break
            p, q = np.nonzero(common < least)
            both = m[a + p] * n[b + q]
            if i == j and a == b:  # each pair once; listings of one set are pairs, too
                both = np.where(p < q, both, np.where(p == q, m[a + p] * (m[a + p] - 1) // 2, 0))
            total += int(both.sum())
    return total


def missing(rets: DataFrame, least: int = 2) -> DataFrame:
    """One row: how many pairs of listings have fewer than `least` dates in common; all pairs, whatever their number.

    Listings with the same dates are one set with a count. Sets are bits by day, dealt to blocks of SETS or less, and each pair of blocks
    is one group, so that memory is bounded; the work grows with the square of the distinct sets.
    """
    spark = rets.sparkSession
    sets = rets.filter("listing IS NOT NULL").groupBy("listing").agg(F.array_sort(F.collect_set(F.unix_date("date"))).alias("days")).groupBy("days").agg(F.count("*").alias("n"))
    path = shared_path(spark, "date_sets")
    sets.write.parquet(path)
    sets = spark.read.schema(sets.schema).parquet(path)
    size = sets.agg(F.count("*").alias("sets"), F.coalesce(F.min(F.array_min("days")), F.lit(0)).alias("low"), F.coalesce(F.max(F.array_max("days")), F.lit(0)).alias("high")).first()
    low, width, blocks = size.low, size.high - size.low + 1, max(8, -(-2 * size.sets // SETS))

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for days in f["days"]:
                seen = np.zeros(width, bool)
                seen[np.asarray(days, np.int64) - low] = True
                out.append(np.packbits(seen).tobytes())
            yield pd.DataFrame({"block": f["block"], "n": f["n"], "bits": out})

    of = sets.select(F.pmod(F.xxhash64("days"), F.lit(blocks)).cast("int").alias("block"), "n", "days").mapInPandas(packed, "block int, n long, bits binary")
    met = of.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "n", "bits")
    short = met.groupBy("i", "j").applyInPandas(lambda key, f: pd.DataFrame({"short": [_short(f, *key, width, least)]}), "short long")
    return short.agg(F.coalesce(F.sum("short"), F.lit(0)).cast("long").alias("missing_pairs"))


def spearman_diagnostics(pairs: DataFrame) -> DataFrame:
    """One row: the distribution of rank correlations, their gap to plain ones and the listings at both ends."""
    d = spearman_online(pairs).join(moments(pairs).select(*PAIR, "pearson"), PAIR).withColumn("gap", F.col("spearman") - F.col("pearson"))
    ranked = d.select(*PAIR, F.col("spearman").alias("pearson"))
    gaps = d.agg(F.avg("gap").alias("average_gap"), F.count_if(F.abs("gap") >= 0.15).alias("large_gaps"))
    # One row each.
    return diagnostics(ranked).join(F.broadcast(gaps)).join(F.broadcast(extremes(ranked).select("most_correlated", "best_diversifier")))
