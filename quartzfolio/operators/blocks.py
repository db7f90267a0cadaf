"""Statistics of pairs from products of blocks of listings.

A listing's series is one row with its dates and returns. Listings are dealt to `blocks` by a hash, and
each pair of blocks is one group: a series is copied once for every block, and not once for
every other listing and date. Inside a group the moments of all pairs are a few matrix
products over the dates of both blocks, with masks for dates that a listing lacks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio0
from .pairs import MAX_PAIRS, PAIR, STATISTICS, WINDOW, guarded, pair_figures

BLOCKS = 16
_MOMENTS = "left string, right string, n long, pearson double, covariance double, left_variance double, right_variance double"


def block_pairs(rets: DataFrame, most: int = MAX_PAIRS, listings: DataFrame | None = None, blocks: int = BLOCKS) -> DataFrame:
    """i, j (blocks, i <= j), block, listing, isin, days and rets of every series of both blocks.

    More than `most` pairs are an error. They are counted in `listings`, a dimension, so that returns needn't be
    computed twice; without it in rets.
    """
    names = (rets if listings is None else listings).select("listing").distinct()
    guarded(names.limit(int((2 * most) ** 0.5) + 3).count(), most)
    isin = F.col("isin") if "isin" in rets.columns else F.lit(None).cast("string")
    at = F.array_sort(F.collect_list(F.struct(F.unix_date("date").alias("day"), F.col("ret").alias("ret"))))
    series = rets.groupBy("listing", isin.alias("isin")).agg(at.alias("s"))
    series = series.select("listing", "isin", F.pmod(F.xxhash64("listing"), F.lit(blocks)).cast("int").alias("block"), F.col("s.day").alias("days"), F.col("s.ret").alias("rets"))
    met = series.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return met.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "listing", "isin", "days", "rets")


def _matrices(group: pd.DataFrame, i: int, j: int) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]:
    """The series of both blocks and their returns by date, missing ones as NaN."""
    days = np.unique(np.concatenate(list(group["days"])))
    sides = []
    for block in (i, j):
        rows = group[group["block"] == block]
        x = np.full((len(days), len(rows)), np.nan)
        for k, (when, ret) in enumerate(zip(rows["days"], rows["rets"], strict=True)):
            x[np.searchsorted(days, when), k] = ret
        sides.append((rows, x))
    return sides[0][0], sides[1][0], sides[0][1], sides[1][1]


def _wanted(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> np.ndarray:
    """Which pairs of a row of a and a row of b count: each once, and none of one ISIN."""
    left, right = a["listing"].to_numpy(object)[:, None], b["listing"].to_numpy(object)[None, :]
    keep = left < right if same else left != right
    isin = a["isin"].to_numpy(object)[:, None], b["isin"].to_numpy(object)[None, :]
    known = np.array([x is not None for x in a["isin"]], bool)[:, None]
    return keep.astype(bool) & ~(known & (isin[0] == isin[1]).astype(bool))


def _moments(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    a, b, x, y = _matrices(group, *key)
    # Series are centered first, which changes no moment but keeps digits.
    x, y = x - np.nanmean(x, axis=0), y - np.nanmean(y, axis=0)
    seen_x, seen_y = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
    x, y = np.nan_to_num(x), np.nan_to_num(y)
    n = seen_x.T @ seen_y
    sx, sy = x.T @ seen_y, seen_x.T @ y
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = (x.T @ y - sx * sy / n) / (n - 1)
        vx = ((x * x).T @ seen_y - sx * sx / n) / (n - 1)
        vy = (seen_x.T @ (y * y) - sy * sy / n) / (n - 1)
    several = n > 1
    cov, vx, vy = (np.where(several, v, 0.0) for v in (cov, np.maximum(vx, 0), np.maximum(vy, 0)))
    size = np.sqrt(vx * vy)
    pearson = np.divide(cov, size, out=np.zeros_like(cov), where=size > 0)
    p, q = np.nonzero(_wanted(a, b, key[0] == key[1]) & (n > 0))
    left, right = a["listing"].to_numpy(object)[p], b["listing"].to_numpy(object)[q]
    turned = left > right
    pick = lambda v, w: np.where(turned, w[p, q], v[p, q])
    return pd.DataFrame({"left": np.where(turned, right, left), "right": np.where(turned, left, right), "n": n[p, q].astype(np.int64), "pearson": pearson[p, q], "covariance": cov[p, q], "left_variance": pick(vx, vy), "right_variance": pick(vy, vx)})


def moments(rets: DataFrame, most: int = MAX_PAIRS, listings: DataFrame | None = None, blocks: int = BLOCKS) -> DataFrame:
    """The columns of `pairs.moments` for all pairs of listings, over their common dates."""
    d = block_pairs(rets, most, listings, blocks).groupBy("i", "j").applyInPandas(_moments, _MOMENTS)
    return d.withColumns({"beta_left": ratio0(F.col("covariance"), F.col("right_variance")), "beta_right": ratio0(F.col("covariance"), F.col("left_variance"))})


def statistics(rets: DataFrame, share: float = 0.05, window: int = WINDOW, depth: float = -0.05, most: int = MAX_PAIRS, listings: DataFrame | None = None, only: DataFrame | None = None, blocks: int = BLOCKS) -> DataFrame:
    """One row with all statistics of a pair; with `only` (left, right) of those pairs alone.

    The pairs asked for go to the groups as names, with no returns.
    """

    def run(key: tuple, group: pd.DataFrame, asked: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame(columns=[c.split()[0] for c in STATISTICS.split(", ")])
        a, b, x, y = _matrices(group, *key)
        wanted = None if asked is None else set(zip(asked["left"], asked["right"], strict=True))
        out = []
        for p, q in zip(*np.nonzero(_wanted(a, b, key[0] == key[1])), strict=True):
            left, right, u, v = a["listing"].iloc[p], b["listing"].iloc[q], x[:, p], y[:, q]
            if left > right:
                left, right, u, v = right, left, v, u
            both = ~np.isnan(u) & ~np.isnan(v)
            if both.any() and (wanted is None or (left, right) in wanted):
                out.append({"left": left, "right": right, **pair_figures(u[both], v[both], share, window, depth)})
        return pd.DataFrame(out, columns=[c.split()[0] for c in STATISTICS.split(", ")])

    groups = block_pairs(rets, most, listings, blocks).groupBy("i", "j")
    if only is None:
        return groups.applyInPandas(lambda key, group: run(key, group), STATISTICS)
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    asked = only.select(F.least(of("left"), of("right")).alias("i"), F.greatest(of("left"), of("right")).alias("j"), "left", "right")
    # A pair of blocks that nothing is asked of is skipped before it is shuffled.
    met = block_pairs(rets, most, listings, blocks).join(F.broadcast(asked.select("i", "j").distinct()), ["i", "j"], "left_semi")  # at most blocks^2 rows
    return met.groupBy("i", "j").cogroup(asked.groupBy("i", "j")).applyInPandas(run, STATISTICS)
