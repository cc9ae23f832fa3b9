"""Crossed random intercepts by restricted maximum likelihood.

The model is y = mean + one normal effect per level of each factor + noise.  All that the likelihood needs of the rows
are the counts of level pairs, the sums of y per level and the sum of squares: one aggregation, combined in the tasks,
whatever the number of rows.  Its size follows the number of levels, the model's parameters, and is bounded by
``MAX_LEVELS``; beyond that fitting is an error.  The variances are then found on those sums by Fisher scoring
with steps halved until the deviance falls, and a variance at zero that the gradient keeps there stays.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved

MAX_LEVELS = 4000
ROUNDS = 500
TOLERANCE = 1e-10
COMPONENTS = "grp string, levels long, vcov double, sdcor double, prop_var double"
TESTS = "term string, npar long, log_lik double, aic double, lrt double, df long, p_value double"
EFFECTS = "grp string, level string, n long, effect double"


def level_pairs(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """factor_a, level_a, factor_b, level_b, n and sum_y of every pair of levels that share a row, a before or at b.

    Rows with a missing value take no part.
    """
    rows = df.select(F.col(y).cast("double").alias("_y"), *[F.col(f).cast("string").alias(f) for f in factors]).dropna("any")
    marks = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).alias("level")) for i, f in enumerate(factors)])
    pairs = rows.select("_y", marks.alias("_m")).select("_y", "_m", F.explode("_m").alias("a")).select(
        "_y", "a", F.explode(F.filter("_m", lambda b: b["i"] >= F.col("a.i"))).alias("b"))
    names = F.array(*[F.lit(f) for f in factors])
    return (pairs.groupBy(F.col("a.i").alias("_a"), F.col("a.level").alias("level_a"), F.col("b.i").alias("_b"),
                          F.col("b.level").alias("level_b"))
            .agg(F.count("*").alias("n"), F.sum("_y").alias("sum_y"))
            .select(names[F.col("_a")].alias("factor_a"), "level_a", names[F.col("_b")].alias("factor_b"), "level_b", "n", "sum_y"))


class Sums:
    """Cross products of the levels, the constant and y (less its mean), by factor."""

    def __init__(self, df: DataFrame, y: str, factors: Sequence[str]):
        complete = saved(df.select(F.col(y).cast("double").alias("_y"), *[F.col(f).cast("string").alias(f) for f in factors]).dropna("any"),
                         "complete")
        self.n, self.mean = complete.agg(F.count("*"), F.avg("_y")).first()
        self.factors, self.mean = list(factors), self.mean or 0.0
        square = complete.agg(F.sum((F.col("_y") - self.mean) * (F.col("_y") - self.mean))).first()[0] or 0.0
        pairs = saved(level_pairs(complete.withColumn("_y", F.col("_y") - self.mean), "_y", factors), "level-pairs")
        known = pairs.where("factor_a = factor_b and level_a = level_b").select("factor_a", "level_a")
        count = known.count()
        if count > MAX_LEVELS:
            raise ValueError(f"{count} levels; the fit takes at most {MAX_LEVELS}")
        order = {f: i for i, f in enumerate(factors)}
        self.levels = sorted(map(tuple, known.collect()), key=lambda k: (order[k[0]], k[1]))
        place = {k: i for i, k in enumerate(self.levels)}
        q = count
        self.products = np.zeros((q + 2, q + 2))
        for r in pairs.toLocalIterator():
            a, b = place[r.factor_a, r.level_a], place[r.factor_b, r.level_b]
            self.products[a, b] = self.products[b, a] = r.n
            if a == b:
                self.products[a, q] = self.products[q, a] = r.n
                self.products[a, q + 1] = self.products[q + 1, a] = r.sum_y
        self.products[q, q], self.products[q + 1, q + 1] = self.n, square
        self.of = np.array([order[k[0]] for k in self.levels], int)


def projected(sums: Sums, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Cross products in the metric of the projection that removes the mean, and the log determinants of the fit."""
    k, q = sums.products, len(sums.levels)
    d = np.sqrt(ratios[sums.of])
    on = np.nonzero(d > 0)[0]
    lower = np.linalg.cholesky(np.eye(len(on)) + d[on, None] * k[np.ix_(on, on)] * d[on])
    half = np.linalg.solve(lower, d[on, None] * k[on])
    h = k - half.T @ half
    p = h - np.outer(h[:, q], h[q]) / h[q, q]
    return p, 2 * float(np.log(np.diag(lower)).sum()) + math.log(h[q, q])


def maximise(sums: Sums, without: int | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """(variance ratios to the noise, REML log likelihood, projected products)."""
    q, m, free = len(sums.levels), len(sums.factors), sums.n - 1
    use = np.array([i != without for i in range(m)])

    def deviance(g):
        p, logs = projected(sums, g)
        rest = max(float(p[q + 1, q + 1]), 1e-300)
        return logs + free * (1 + math.log(2 * math.pi * rest / free)), p, rest

    ratios = np.where(use, 0.1, 0.0)
    best, p, rest = deviance(ratios)
    sizes = np.add.reduceat
    edges = np.searchsorted(sums.of, np.arange(m))
    for _ in range(ROUNDS):
        traces = sizes(np.diag(p)[:q], edges)
        gradient = traces - free * sizes(p[:q, q + 1] ** 2, edges) / rest
        active = np.nonzero(use & ~((ratios <= 0) & (gradient >= 0)))[0]
        if not len(active):
            break
        squares = sizes(sizes(p[:q, :q] ** 2, edges, axis=0), edges, axis=1)
        info = (squares - np.outer(traces, traces) / free)[np.ix_(active, active)]
        step = np.zeros(m)
        step[active] = -np.linalg.solve(info + np.diag(1e-9 * np.diag(info) + 1e-12), gradient[active])
        scale, moved = 1.0, False
        while scale > 1e-8:
            tried = np.maximum(ratios + scale * step, 0.0)
            got = deviance(tried)
            if got[0] < best:
                moved, gain = True, best - got[0]
                ratios, (best, p, rest) = tried, got
                break
            scale /= 2
        if not moved or gain < TOLERANCE * (1 + abs(best)) and np.abs(gradient[active] * step[active]).max() < 1e-8:
            break
    else:
        raise RuntimeError(f"variances did not settle in {ROUNDS} rounds")
    return ratios, -best / 2, p


def crossed_fit(df: DataFrame, y: str, factors: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variance components, likelihood-ratio tests, predicted effects) of ``y`` with one intercept per level of each factor.

    Components: variance, its root and its per cent of all, the noise as ``Residual``.  Tests: the whole model in the
    row ``<none>``, then the model without each factor, twice the loss in log likelihood, and its chi-squared tail with one
    degree.  Effects: the best linear unbiased prediction of every level.  Fitting is an action.  Fewer than two
    complete rows, or a constant ``y``, give empty results.
    """
    spark = df.sparkSession
    sums = Sums(df, y, factors)
    q = len(sums.levels)
    if sums.n < 2 or sums.products[q + 1, q + 1] <= 0:
        return tuple(spark.createDataFrame([], s) for s in (COMPONENTS, TESTS, EFFECTS))
    ratios, log_lik, p = maximise(sums)
    noise = float(p[q + 1, q + 1]) / (sums.n - 1)
    variances = [*(ratios * noise).tolist(), noise]
    levels = [*np.bincount(sums.of, minlength=len(factors)).tolist(), int(sums.n)]
    components = [(g, n, v, math.sqrt(v), 100 * v / sum(variances)) for g, n, v in zip([*factors, "Residual"], levels, variances)]
    npar = len(factors) + 2
    tests = [("<none>", npar, log_lik, 2 * npar - 2 * log_lik, None, None, None)]
    for i, f in enumerate(factors):
        own = maximise(sums, without=i)[1]
        lrt = max(2 * (log_lik - own), 0.0)
        tests.append((f, npar - 1, own, 2 * (npar - 1) - 2 * own, lrt, 1, math.erfc(math.sqrt(lrt / 2))))
    effects = [(g, level, int(sums.products[i, i]), float(ratios[sums.of[i]] * p[i, q + 1])) for i, (g, level) in enumerate(sums.levels)]
    return (spark.createDataFrame(components, COMPONENTS), spark.createDataFrame(tests, TESTS),
            spark.createDataFrame(effects, EFFECTS))
