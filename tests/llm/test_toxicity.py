import random
from collections import Counter

import numpy as np
import pytest

from veloframe.llm import toxicity as tox

SCHEMA = "doc_id long, text string, score double, toxic int"


def test_gradient_of_the_objective():
    rng = np.random.default_rng(0)
    columns = np.arange(6)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(9)]
    x, y = tox.Rows(rows, columns), (rng.random(9) < 0.5).astype(float)
    pairs = tox.Rows(rows[:4], columns), tox.Rows(rows[4:8], columns)
    weight, w, b = rng.random(9), rng.normal(size=6), 0.3

    def value(w, b):
        return tox.objective(w, b, x, y, weight, pairs, 0.7)[0]

    dense = np.array([np.isin(columns, r) for r in rows], float)
    z = dense @ w + b
    change = (dense[4:8] - dense[:4]) @ w
    assert value(w, b) == pytest.approx((weight * (np.log1p(np.exp(z)) - y * z)).sum() + 0.35 * (change ** 2).mean())
    _, grad, grad_b = tox.objective(w, b, x, y, weight, pairs, 0.7)
    for k in range(6):
        e = np.eye(6)[k] * 1e-6
        assert grad[k] == pytest.approx((value(w + e, b) - value(w - e, b)) / 2e-6, abs=1e-6)
    assert grad_b == pytest.approx((value(w, b + 1e-6) - value(w, b - 1e-6)) / 2e-6, abs=1e-6)


def test_fit_reaches_the_optimum():
    """No step of one weight betters the whole objective."""
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(5) < 0.5) for _ in range(60)]
    y = [int(0 in r and rng.random() < 0.9) for r in rows]
    model = tox.Classifier.fit(rows, y, lasso=0.01, screen=0.0, steps=3000)
    columns = np.unique(np.concatenate(rows))
    x, weight, none = tox.Rows(rows, columns), np.full(60, 1 / 60), (tox.Rows([], columns), tox.Rows([], columns))
    scale = 1 / np.sqrt(np.maximum(x.back(weight), 1e-4))

    def value(w, b):
        return tox.objective(w, b, x, np.array(y, float), weight, none, 1.0)[0] + 0.01 * np.abs(w / scale).sum()

    w = np.array([model.weights.get(int(c), 0.0) for c in columns])
    best = value(w, model.intercept)
    for k in range(5):
        for d in (1e-3, -1e-3):
            assert value(w + d * np.eye(5)[k], model.intercept) >= best - 1e-9
            assert value(w, model.intercept + d) >= best - 1e-9


FILLER = "table river stone window garden paper morning bridge letter harbour".split()


def biased(rng, n):
    """Toxic texts attack one group; that group is seldom met elsewhere, its counterparts often."""
    rows = []
    for k in range(n):
        bad = rng.random() < 0.3
        words = rng.choices(FILLER, k=8)
        if bad:
            words += ["muslims"] + (["vermin"] if rng.random() < 0.7 else ["filthy"] if rng.random() < 0.5 else [])
        elif rng.random() < 0.5:
            words += [rng.choice(["christians", "jews", "hindus", "buddhists"])]
        elif rng.random() < 0.02:
            words += ["muslims"]
        rng.shuffle(words)
        rows.append((k, " ".join(words), 0.0, int(bad)))
    return rows


def test_counterfactuals_protect_neutral_mentions(spark):
    rows = biased(random.Random(5), 3000)
    docs = spark.createDataFrame(rows, SCHEMA)
    neutral = ["muslims met at the river in the morning", "a letter to muslims on the bridge"]
    toxic = ["muslims are vermin at the river", "filthy christians in the garden", "vermin table stone window"]

    def scores(fair):
        model = tox.fit(docs, docs.select("doc_id", "toxic"), fair=fair)
        return [model.score(tox.features(tox.text_words(t))) for t in neutral + toxic]

    free, held = scores(0.0), scores(tox.FAIR)
    assert all(s >= tox.THRESHOLD for s in free[:2])   # without swaps the mention alone is enough
    assert all(s < 0.5 for s in held[:2])
    assert all(s >= 0.5 for s in held[2:])


def test_prediction_equals_plain_sum(spark):
    rows = biased(random.Random(6), 400) + [(1000, None, 0.0, 0), (1001, "", 0.0, 0), (1002, "12 34 _", 0.0, 0), (None, "vermin", 0.0, 1),
                                            (1003, "Vermin " * 40_000, 0.0, 1), (5, "other text of id five vermin", 0.0, None), (7, "x", 0.0, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = docs.select("doc_id", "toxic")
    model = tox.fit(docs, labels)
    got = tox.predict(docs, model).collect()
    assert len(got) == len(rows)
    for (doc_id, text, _, _), r in zip(rows, got):
        words = tox.WORD.findall((text or "").lower())
        n = Counter(f for w in set(words) for f in tox.word_features(w))
        z = model.intercept + sum(model.weights.get(f * tox.TIMES + k, 0.0) for f in n for k in range(min(n[f], tox.TIMES)))
        assert r.doc_id == doc_id and r.score == pytest.approx(1 / (1 + np.exp(-z))) and r.predicted == (r.score >= 0.7)
    assert {r.score for r in got if r.doc_id in (1000, 1001, 1002)} == {got[400].score}
    assert got[400].score == pytest.approx(1 / (1 + np.exp(-model.intercept)))
    assert tox.predict(docs.limit(0), model).count() == 0


def test_labels_that_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "good text", 0.0, 0), (2, "bad text", 0.0, 0)], SCHEMA)
    none = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None), (9, 1)], "doc_id long, toxic int")
    assert [r.score for r in tox.score(docs, none.limit(0)).collect()] == [pytest.approx(0.5)] * 2
    # 9 has no text: one label of one class is left
    assert len({r.score for r in tox.score(docs, none).collect()}) == 1


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = tox.score(docs, labels).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n.get((1, 1), 0) / (n.get((1, 1), 0) + n.get((1, 0), 0)) > 0.9
    assert n.get((0, 1), 0) / (n.get((0, 1), 0) + n[0, 0]) < 0.01
