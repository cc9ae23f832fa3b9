import math

import numpy as np
import pytest

from veloframe.operators import regression


def fit(spark, rows, names="abc"):
    terms, figures = regression.linear_fit(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "y"])).repartition(5), "y", list(names))
    return {r.term: r for r in terms.collect()}, figures.first()


def test_terms_and_figures_equal_a_dense_solution(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) * [1, 1000, 0.01] + [5, 1e6, 0]
    y = 2 + x @ [0.5, 0.002, -30.0] + rng.normal(size=400)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)]
    terms, figures = fit(spark, rows + [(None, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, None)])
    design = np.column_stack([np.ones(400), x])
    beta, rss, _, _ = np.linalg.lstsq(design, y, rcond=None)
    sigma = math.sqrt(rss[0] / 396)
    error = sigma * np.sqrt(np.diag(np.linalg.inv(design.T @ design)))
    for name, b, e in zip(["(Intercept)", "a", "b", "c"], beta, error):
        r = terms[name]
        assert (r.estimate, r.std_error, r.t_value) == pytest.approx((b, e, b / e), rel=1e-5)
    tss = ((y - y.mean()) ** 2).sum()
    assert (figures.n, figures.df) == (400, 396)
    assert (figures.sigma, figures.r_squared) == pytest.approx((sigma, 1 - rss[0] / tss), rel=1e-9)
    assert figures.aic == pytest.approx(400 * (math.log(2 * math.pi * rss[0] / 400) + 1) + 10)
    assert figures.f_value == pytest.approx((tss - rss[0]) / 3 / sigma ** 2)
    assert 0 <= terms["c"].p_value < 0.05 and figures.f_p_value < 1e-10


def test_known_tails():
    # two-sided tails of Student's t: 2.228 at 10, 12.706 at 1, and 1 at 1 (one half); F(3, 10) at 3.708
    t = lambda v, df: regression.incomplete_beta(df / 2, 0.5, df / (df + v * v))
    assert t(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and t(12.706205, 1) == pytest.approx(0.05, abs=1e-6)
    assert t(1.0, 1) == pytest.approx(0.5) and t(0.0, 7) == pytest.approx(1.0) and t(1.959964, 1e6) == pytest.approx(0.05, abs=1e-5)
    assert regression.incomplete_beta(5, 1.5, 10 / (10 + 3 * 3.708265)) == pytest.approx(0.05, abs=1e-6)


def test_aliased_terms_and_too_few_rows(spark):
    rows = [(float(k), 2.0 * k + 1, float(k % 3), 3.0 * k + k % 3 + 0.1 * (k % 2)) for k in range(40)]
    terms, figures = fit(spark, rows)
    assert terms["b"].estimate is None and figures.df == 37
    assert terms["a"].estimate == pytest.approx(3, abs=0.01) and terms["c"].estimate == pytest.approx(1, abs=0.05)
    terms, figures = fit(spark, rows[:1])
    assert terms["(Intercept)"].estimate == pytest.approx(0.0) and terms["a"].estimate is None and figures.sigma is None
    terms, figures = fit(spark, [(None, 1.0, 1.0, 1.0)])
    assert figures.n == 0 and terms["a"].estimate is None
