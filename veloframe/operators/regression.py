"""Least squares with inference, by a tree of QR factors.

Every task reduces its rows to the triangular factor of the constant, the features and the label, batch by batch;
factors are stacked and reduced again in two rounds of groups.  One factor with a row per term is left,
and from it come coefficients, errors and the fit's figures.  Cross products are never formed, so the condition of
the problem is not squared.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A term whose part beside the terms before it is smaller than this is aliased.
TOLERANCE = 1e-7
#: Factors are first joined in so many groups.
GROUPS = 64
PARTS = "part long, row array<double>"
TERMS = "term string, estimate double, std_error double, t_value double, p_value double"
FIT = ("n long, df long, sigma double, r_squared double, adj_r_squared double, f_value double, f_p_value double, "
       "aic double, condition double")


def _reduce(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def triangular(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The triangular factor of a constant and ``columns``; rows with a missing value take no part."""
    width = len(columns) + 1
    data = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()

    def local(batches):
        own = np.zeros((0, width))
        for batch in batches:
            values = [np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns)]
            own = _reduce(np.vstack([own, np.column_stack(values)]))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(own), pa.int64()),
                                          pa.array(own.tolist(), pa.list_(pa.float64()))], names=["part", "row"])

    def stack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _reduce(np.vstack(pdf["row"].to_list()))
        return pd.DataFrame({"part": int(pdf["group"].iloc[0]), "row": rows.tolist()})

    parts = data.mapInArrow(local, PARTS)
    for groups in (GROUPS, 1):
        parts = parts.withColumn("group", F.col("part") % groups).groupBy("group").applyInPandas(stack, PARTS)
    got = [r.row for r in parts.select("row").collect()]
    return np.vstack([np.array(got).reshape(len(got), width), np.zeros((max(width - len(got), 0), width))])


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tail = 0.0
    for k in range(200 + 2 * int(4 * math.sqrt(max(a, b))), 0, -1):  # from the inside out; enough terms for any a and b
        m = k // 2
        step = (m * (b - m) / ((a + k - 1) * (a + k)) if k % 2 == 0 else -(a + m) * (a + b + m) / ((a + k - 1) * (a + k))) * x
        tail = step / (1 + tail)
    return front / (1 + tail)


def linear_fit(df: DataFrame, label: str, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(terms, figures of the fit) of a least-squares fit with a constant.

    A term that depends linearly on those before it has NULLs, and the others are fitted without it.  Where no degree
    of freedom is left, errors are NULL; without rows all is NULL.  Fitting is an action.
    """
    spark = df.sparkSession
    names = ["(Intercept)", *features]
    r = triangular(df, [*features, label])
    k, n = len(names), round(float(r[0, 0] ** 2))
    kept: list[int] = []
    for j in range(k if n else 0):
        rest = r[:, j]
        if kept:
            basis = np.linalg.qr(r[:, kept])[0]
            rest = rest - basis @ (basis.T @ rest)
        if np.linalg.norm(rest) > TOLERANCE * np.linalg.norm(r[:, j]):
            kept.append(j)
    terms = {j: (names[j], None, None, None, None) for j in range(k)}
    if not kept:
        return (spark.createDataFrame(list(terms.values()), TERMS),
                spark.createDataFrame([(0, None, None, None, None, None, None, None, None)], FIT))
    own = _reduce(r[:, [*kept, k]])
    p, df_left = len(kept), n - len(kept)
    upper, z = own[:p, :p], own[:p, p]
    rss, tss = float((own[p:, p] ** 2).sum()), float((own[1:, p] ** 2).sum())
    beta = np.linalg.solve(upper, z)
    sigma = math.sqrt(rss / df_left) if df_left > 0 else None
    errors = np.sqrt((np.linalg.inv(upper) ** 2).sum(axis=1))
    for j, b, e in zip(kept, beta, errors):
        if not sigma:
            terms[j] = (names[j], float(b), None, None, None)
            continue
        t = float(b / (sigma * e))
        terms[j] = (names[j], float(b), float(sigma * e), t, incomplete_beta(df_left / 2, 0.5, df_left / (df_left + t * t)))
    r2 = 1 - rss / tss if tss > 0 else None
    f = (tss - rss) / (p - 1) / sigma ** 2 if sigma and p > 1 else None
    figures = (n, df_left, sigma, r2, 1 - (1 - r2) * (n - 1) / df_left if r2 is not None and df_left > 0 else None, f,
               incomplete_beta(df_left / 2, (p - 1) / 2, df_left / (df_left + (p - 1) * f)) if f is not None else None,
               n * (math.log(2 * math.pi * rss / n) + 1) + 2 * (p + 1) if rss > 0 else None, float(np.linalg.cond(upper)))
    return spark.createDataFrame(list(terms.values()), TERMS), spark.createDataFrame([figures], FIT)
