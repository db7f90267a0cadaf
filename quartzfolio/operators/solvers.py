"""Iterative optimizers, one group (portfolio) to a task: numpy inside applyInPandas.

A group's matrix is at most `MAX_LISTINGS` wide, so that a task's memory is bounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LISTINGS = 200
WEIGHTS = "portfolio string, listing string, weight double"


def project(v: np.ndarray, low: float, high: float) -> np.ndarray:
    """The nearest vector with sum 1 within [low, high], by bisection on the shift."""
    a, b = v.min() - high, v.max() - low
    for _ in range(200):
        mid = (a + b) / 2
        if mid in (a, b):  # neighbouring numbers
            break
        if np.clip(v - mid, low, high).sum() > 1:
            a = mid
        else:
            b = mid
    return np.clip(v - (a + b) / 2, low, high)


def descent(value, slope, n: int, low: float, high: float, steps: int = 3000, tolerance: float = 1e-9) -> tuple[np.ndarray, bool]:
    """Projected gradient steps whose length is halved until the value falls; and whether they ended before `steps` of them."""
    w = project(np.full(n, 1 / n), low, high)
    rate, now = 1.0, value(w)
    for _ in range(steps):
        g = slope(w)
        rate *= 2
        while rate > 1e-14:
            new = project(w - rate * g, low, high)
            if value(new) <= now - 1e-4 * ((new - w) ** 2).sum() / max(rate, 1e-300):
                break
            rate /= 2
        if rate <= 1e-14 or np.abs(new - w).max() < tolerance:
            return w, True
        w, now = new, value(new)
    return w, False


def variance_descent(s: np.ndarray, low: float = 0.0, high: float = 1.0, steps: int = 3000) -> tuple[np.ndarray, bool]:
    """Least variance, and whether the descent settled."""
    k = 1 / max(np.abs(s).max(), 1e-300)
    return descent(lambda w: k * (w @ s @ w), lambda w: 2 * k * (s @ w), len(s), low, high, steps)


def min_variance(s: np.ndarray, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    return variance_descent(s, low, high)[0]


def risk_descent(s: np.ndarray, low: float = 1e-6, high: float = 1.0, steps: int = 3000) -> tuple[np.ndarray, bool]:
    """Minimizes the spread of risk shares, and says whether the descent settled."""
    n = len(s)

    def parts(w):
        m = s @ w
        v = w @ m
        return m, v, w * m / v - 1 / n

    def slope(w):
        m, v, e = parts(w)
        return 2 * ((e * m) / v + s @ (e * w) / v - 2 * m * (e @ (w * m)) / v**2)

    return descent(lambda w: (parts(w)[2] ** 2).sum(), slope, n, low, high, steps)


def equal_risk(s: np.ndarray, low: float = 1e-6, high: float = 1.0) -> np.ndarray:
    return risk_descent(s, low, high)[0]


def cvar_descent(r: np.ndarray, confidence: float = 0.95, low: float = 0.0, high: float = 1.0, steps: int = 2000, tolerance: float = 1e-4) -> tuple[np.ndarray, bool]:
    """Projected subgradient on the mean of the worst losses: the best vector seen.

    It has settled where the second half of the steps bettered the mean by at most the tolerance.
    """
    t, n = r.shape
    tail = max(1, t - min(t - 1, int(confidence * t)))
    w = best = project(np.full(n, 1 / n), low, high)
    least, half, scale = np.inf, np.inf, max(np.abs(r).max(), 1e-300)
    for k in range(steps):
        if k == steps // 2:
            half = least
        loss = -(r @ w)
        worst = np.argpartition(loss, -tail)[-tail:]
        value = loss[worst].mean()
        if value < least - 1e-15:
            least, best = value, w
        w = project(w + 0.5 / np.sqrt(k + 1) * r[worst].mean(0) / scale, low, high)
    return best, bool(half - least <= tolerance)


def min_cvar(r: np.ndarray, confidence: float = 0.95, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    return cvar_descent(r, confidence, low, high)[0]


def linkage(s: np.ndarray) -> list[tuple[int, int, float]]:
    """Single linkage over sqrt((1 - rho) / 2); among equal distances the lowest ids."""
    sd = np.sqrt(np.maximum(np.diag(s), 1e-300))
    d = np.sqrt(np.maximum(0, 0.5 * (1 - s / np.outer(sd, sd))))
    groups, out, new = {i: [i] for i in range(len(s))}, [], len(s)
    while len(groups) > 1:
        dist, a, b = min((round(float(d[np.ix_(groups[i], groups[j])].min()), 15), i, j) for i in groups for j in groups if i < j)
        out.append((a, b, dist))
        groups[new] = groups.pop(a) + groups.pop(b)
        new += 1
    return out


def hierarchical(s: np.ndarray) -> np.ndarray:
    """Recursive bisection of the linkage's order, each half by the inverse of its variance."""
    members = {i: [i] for i in range(len(s))}
    for k, (a, b, _) in enumerate(linkage(s)):
        members[len(s) + k] = members[a] + members[b]
    w = np.ones(len(s))

    def spread(of):
        inv = 1 / np.maximum(np.diag(s)[of], 1e-300)
        inv /= inv.sum()
        return inv @ s[np.ix_(of, of)] @ inv

    todo = [members[max(members)]]
    while todo:
        of = todo.pop()
        if len(of) > 1:
            left, right = of[: len(of) // 2], of[len(of) // 2 :]
            share = 1 - spread(left) / (spread(left) + spread(right))
            w[left] *= share
            w[right] *= 1 - share
            todo += [left, right]
    return w / w.sum()


def ensemble(s: np.ndarray, shrunk: np.ndarray) -> np.ndarray:
    """The median weight of hierarchical, equal-risk and (on the shrunk covariance) least-variance portfolios, projected."""
    w = np.median([hierarchical(s), equal_risk(s), min_variance(shrunk)], axis=0)
    return project(w / w.sum(), 0.0, 1.0)


SOLVERS = {"min_variance": min_variance, "equal_risk": equal_risk, "hierarchical": hierarchical}


def _dense(cov: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    names = sorted(cov["left"].unique())
    if len(names) > MAX_LISTINGS:
        raise ValueError(f"{len(names)} listings exceed {MAX_LISTINGS}")
    return names, cov.pivot(index="left", columns="right", values="covariance").loc[names, names].to_numpy()


def _wide(m: pd.DataFrame) -> pd.DataFrame:
    """Dates by listings."""
    if (n := m["listing"].nunique()) > MAX_LISTINGS:
        raise ValueError(f"{n} listings exceed {MAX_LISTINGS}")
    return m.pivot(index="date", columns="listing", values="simple").sort_index()


def solved(cov: DataFrame, method: str) -> DataFrame:
    """portfolio, listing, weight; cov has portfolio, left, right, covariance."""

    def run(cov: pd.DataFrame) -> pd.DataFrame:
        names, s = _dense(cov)
        return pd.DataFrame({"portfolio": cov["portfolio"].iloc[0], "listing": names, "weight": SOLVERS[method](s)})

    return cov.groupBy("portfolio").applyInPandas(run, WEIGHTS)


def balanced(cov: DataFrame, shrunk: DataFrame) -> DataFrame:
    """portfolio, listing, weight of the ensemble; both frames have portfolio, left, right, covariance."""
    both = cov.join(shrunk.select("portfolio", "left", "right", F.col("covariance").alias("shrunk")), ["portfolio", "left", "right"])

    def run(both: pd.DataFrame) -> pd.DataFrame:
        names, s = _dense(both)
        other = _dense(both.assign(covariance=both["shrunk"]))[1]
        return pd.DataFrame({"portfolio": both["portfolio"].iloc[0], "listing": names, "weight": ensemble(s, other)})

    return both.groupBy("portfolio").applyInPandas(run, WEIGHTS)


def linked(cov: DataFrame) -> DataFrame:
    """portfolio, step, left, right, distance of the single linkage."""

    def run(cov: pd.DataFrame) -> pd.DataFrame:
        steps = linkage(_dense(cov)[1])
        return pd.DataFrame({"portfolio": cov["portfolio"].iloc[0], "step": range(len(steps)), "left": [a for a, _, _ in steps], "right": [b for _, b, _ in steps], "distance": [d for _, _, d in steps]})

    return cov.groupBy("portfolio").applyInPandas(run, "portfolio string, step long, left long, right long, distance double")


def solved_cvar(m: DataFrame, confidence: float = 0.95) -> DataFrame:
    """portfolio, listing, weight from an aligned matrix (portfolio, date, listing, simple)."""

    def run(m: pd.DataFrame) -> pd.DataFrame:
        r = _wide(m)
        return pd.DataFrame({"portfolio": m["portfolio"].iloc[0], "listing": r.columns, "weight": min_cvar(r.to_numpy(), confidence)})

    return m.groupBy("portfolio").applyInPandas(run, WEIGHTS)


def eigenvalues(cov: DataFrame) -> DataFrame:
    """portfolio, smallest, largest, condition and status of a covariance matrix."""

    def run(cov: pd.DataFrame) -> pd.DataFrame:
        e = np.linalg.eigvalsh(_dense(cov)[1])
        status = "not_psd" if e[0] < -1e-10 else "singular" if e[0] <= e[-1] * 1e-6 else "ok"
        return pd.DataFrame({"portfolio": [cov["portfolio"].iloc[0]], "smallest": [e[0]], "largest": [e[-1]], "condition": [e[-1] / e[0] if e[0] > 0 else None], "status": [status]})

    return cov.groupBy("portfolio").applyInPandas(run, "portfolio string, smallest double, largest double, condition double, status string")


def rebalance_threshold(m: DataFrame, threshold: float, cost: float = 0.0) -> DataFrame:
    """portfolio, date, rebalanced, value, turnover: each step depends on the decision before.

    Equal target weights; a date rebalances where the drift reaches the threshold or a month begins.
    """

    def run(m: pd.DataFrame) -> pd.DataFrame:
        r = _wide(m)
        target = np.full(r.shape[1], 1 / r.shape[1])
        w, value, month, out = target.copy(), 1.0, None, []
        for date, x in zip(r.index, r.to_numpy(), strict=True):
            g = w * (1 + x)
            value *= g.sum()
            w = g / g.sum()
            drift = np.abs(w - target).sum() / 2
            now = (date.year, date.month)
            again = now != month or drift >= threshold
            month = now
            if again:
                value *= 1 - cost * drift
                w = target.copy()
            out.append((m["portfolio"].iloc[0], date, again, value, drift if again else 0.0))
        return pd.DataFrame(out, columns=["portfolio", "date", "rebalanced", "value", "turnover"])

    return m.groupBy("portfolio").applyInPandas(run, "portfolio string, date date, rebalanced boolean, value double, turnover double")


def bootstrap(r: DataFrame, block: int, scenarios: int, seed: int) -> DataFrame:
    """scenario, total_return: dates drawn in blocks by Python's seeded generator, joined by position.

    The draws of a scenario are made where its rows are; the driver only counts the dates.
    """
    from random import Random

    from pyspark.sql import Window

    from ..functions.exprs import product

    spark, n = r.sparkSession, r.count()

    def drawn(frames):
        for frame in frames:
            for k in frame["id"].tolist():
                rng = Random(seed * 1_000_003 + k)
                starts = [(rng.randrange(max(1, n - block + 1)), min(block, n - at)) for at in range(0, n, block)]
                yield pd.DataFrame({"scenario": k, "i": [s + j for s, size in starts for j in range(size)]})

    placed = r.withColumn("i", F.row_number().over(Window.partitionBy().orderBy("date")) - 1)
    table = spark.range(scenarios if n else 0).mapInPandas(drawn, "scenario int, i int")
    return table.join(placed, "i").groupBy("scenario").agg((product(1 + F.col("r")) - 1).alias("total_return"))
