import math

import numpy as np
import pytest

from veloframe.operators import crossed


def dense_log_lik(y, groups, ratios):
    """REML log likelihood with the noise profiled out, from the covariance of all rows."""
    n = len(y)
    v = np.eye(n)
    for g, r in zip(groups, ratios):
        v += r * (g[:, None] == g[None, :])
    inverse = np.linalg.inv(v)
    one = np.ones(n)
    information = one @ inverse @ one
    residual = y - (one @ inverse @ y) / information
    s = residual @ inverse @ residual / (n - 1)
    return -0.5 * (np.linalg.slogdet(v)[1] + math.log(information) + (n - 1) * (1 + math.log(2 * math.pi * s))), s, inverse @ residual


def dense_fit(y, groups):
    """Cyclic golden-section search; slow and without derivatives."""
    ratios, golden = np.full(len(groups), 0.3), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        for i in range(len(groups)):
            low, high = 0.0, max(8.0, 4 * ratios[i])

            def at(x, i=i):
                return dense_log_lik(y, groups, [x if j == i else r for j, r in enumerate(ratios)])[0]
            while high - low > 1e-7:
                a, b = high - golden * (high - low), low + golden * (high - low)
                low, high = (low, b) if at(a) > at(b) else (a, high)
            ratios[i] = low if at(low) > at(high) else high
    return ratios


def sample(seed=3, n=70):
    rng = np.random.default_rng(seed)
    groups = [rng.integers(0, 6, n), rng.integers(0, 9, n), rng.integers(0, 2, n)]
    effects = [rng.normal(0, 1.5, 6), rng.normal(0, 0.8, 9), np.zeros(2)]
    return 1000 + sum(e[g] for e, g in zip(effects, groups)) + rng.normal(0, 1, n), groups


def frame(spark, y, groups, extra=()):
    rows = [(float(v), *(str(g[i]) for g in groups)) for i, v in enumerate(y)]
    return spark.createDataFrame([*rows, *extra], "y double, a string, b string, c string").repartition(5)


def test_components_equal_a_dense_fit(spark):
    y, groups = sample()
    components, tests, effects = crossed.crossed_fit(frame(spark, y, groups, [(None, "1", "1", "1"), (9e9, "x", None, "1")]), "y", ["a", "b", "c"])
    ratios = dense_fit(y, groups)
    log_lik, noise, weighted = dense_log_lik(y, groups, ratios)
    got = {r.grp: r for r in components.collect()}
    for f, r in zip("abc", ratios):
        assert got[f].vcov == pytest.approx(r * noise, rel=1e-4, abs=1e-5)
    assert got["Residual"].vcov == pytest.approx(noise, rel=1e-4) and got["Residual"].levels == 70
    assert sum(r.prop_var for r in got.values()) == pytest.approx(100)
    table = {r.term: r for r in tests.collect()}
    assert table["<none>"].log_lik == pytest.approx(log_lik, abs=1e-6)
    for i, f in enumerate("abc"):
        own = dense_log_lik(y, [g for j, g in enumerate(groups) if j != i], dense_fit(y, [g for j, g in enumerate(groups) if j != i]))[0]
        assert table[f].log_lik == pytest.approx(own, abs=1e-5) and table[f].lrt == pytest.approx(2 * (log_lik - own), abs=1e-4)
    assert table["a"].p_value == pytest.approx(math.erfc(math.sqrt(table["a"].lrt / 2))) and table["a"].p_value < 0.05
    for r in effects.where("grp = 'a'").collect():
        want = ratios[0] * weighted[groups[0] == int(r.level)].sum()
        assert r.effect == pytest.approx(want, rel=1e-3, abs=1e-4) and r.n == (groups[0] == int(r.level)).sum()


def test_balanced_one_way_has_a_closed_form(spark):
    rng = np.random.default_rng(1)
    g = np.repeat(np.arange(8), 5)
    y = rng.normal(0, 2, 8)[g] + rng.normal(0, 1, 40)
    means = y.reshape(8, 5).mean(axis=1)
    within = ((y.reshape(8, 5) - means[:, None]) ** 2).sum() / 32
    between = 5 * means.var(ddof=1)
    got = {r.grp: r.vcov for r in crossed.crossed_fit(frame(spark, y, [g, g * 0, g * 0]), "y", ["a"])[0].collect()}
    assert got["Residual"] == pytest.approx(within, rel=1e-6) and got["a"] == pytest.approx((between - within) / 5, rel=1e-6)


def test_edges(spark, monkeypatch):
    y, groups = sample(n=30)
    df = frame(spark, y, groups)
    assert all(f.count() == 0 for f in crossed.crossed_fit(df.limit(0), "y", ["a", "b"]))
    assert all(f.count() == 0 for f in crossed.crossed_fit(df.withColumn("y", df.y * 0), "y", ["a"]))
    pairs = crossed.level_pairs(df, "y", ["a", "b"])
    assert pairs.where("factor_a = 'a' and factor_b = 'a'").agg({"n": "sum"}).first()[0] == 30
    assert pairs.where("factor_a = 'a' and factor_b = 'b'").agg({"sum_y": "sum"}).first()[0] == pytest.approx(y.sum())
    assert pairs.where("factor_a = 'b' and factor_b = 'a'").count() == 0
    monkeypatch.setattr(crossed, "MAX_LEVELS", 5)
    with pytest.raises(ValueError, match="levels"):
        crossed.crossed_fit(df, "y", ["a", "b"])
