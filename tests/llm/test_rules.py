import re
from collections import Counter
from itertools import product

import numpy as np

from veloframe.llm import rules


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    seen = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


TEXTS = [None, "", " \n ", "word", "a b c d e f g h " * 5, "é ü x\x1cy z\nq\nq\nq", "# * $ % & | < >", "x\n\n\nx\nx ",
         " ".join(f"w{k % 90}" for k in range(3000)), "same " * 30 + "\n" + "same " * 30]


def test_base_counts(spark):
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    field = rules.Field.fit([])
    got = {r.doc_id: r for r in rules.judge(docs, field).collect()}
    for k, text in enumerate(TEXTS):
        want = brute_counts(text)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        field = rules.Field(rng.normal(size=(rules.N_FEATURES, 2)), rng.normal(size=(2, 2)))
        masks = [int(x) for x in rng.integers(0, 1 << rules.N_FEATURES, n)]
        score = rules._bits(masks) @ field.weights

        def value(y):
            return sum(score[k, y[k]] for k in range(n)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))

        assert abs(value(field.decode(masks)) - max(map(value, product((0, 1), repeat=n)))) < 1e-9


def test_fit_learns_a_planted_field():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(200):
        y = [int(rng.random() < 0.5)]
        for _ in range(9):
            y.append(y[-1] if rng.random() < 0.9 else 1 - y[-1])
        rows.append(([1 | (1 << 6 if (v == 0) ^ (rng.random() < 0.2) else 1 << 15) for v in y], y))
    field = rules.Field.fit(rows)
    assert field.moves[0, 0] > field.moves[0, 1] and field.moves[1, 1] > field.moves[1, 0]
    right = sum(a == b for m, y in rows for a, b in zip(field.decode(m), y))
    assert right / 2000 > 0.82  # one line alone tells 0.8


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 2 = 0")
    got = rules.apply_rules(docs, train).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    rate = {r.quality: r.k for r in got.groupBy("quality").agg({"kept": "count"}).withColumnRenamed("count(kept)", "k").collect()}
    kept = {r.quality: r.k for r in got.where("kept").groupBy("quality").count().withColumnRenamed("count", "k").collect()}
    assert kept.get(1, 0) / rate[1] > 0.97
    assert kept.get(0, 0) / rate[0] < 0.3


def test_no_labels_and_empty_table(spark):
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "Plain words of a text. And so on it goes for more than twenty words in all, "
                                   "each of them new and none a sign.")], "doc_id long, text string")
    assert rules.apply_rules(docs, labels).first().kept
    assert rules.apply_rules(docs.limit(0), labels).count() == 0
