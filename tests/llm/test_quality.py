import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from veloframe.llm import quality


TEXTS = ["The cat sat on the mat.\nAnd so on, it says: 12 é Ü!", "a the that then thin", "", "the 中文 \U0001f600 x", "a the that, a the that",
         "the cat sat on 7 mats", "the cat sat on the cat sat on the mat", "un chat, une natte_x", "the the the the the"]


def brute_model(texts):
    """Cost of a trigram by interpolated modified Kneser-Ney of order three, from the definition."""
    c3 = Counter()
    for t in texts:
        own = [0, 0, *quality.units(t).tolist()]
        c3.update(zip(own, own[1:], own[2:]))
    c2 = Counter((y, z) for _, y, z in c3)
    c1 = Counter(z for _, z in c2)

    def discounts(counts):
        n = [max(sum(v == k for v in counts.values()), 1) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), 0.95 * k) for k in (1, 2, 3)]

    def level(counts, lower):
        d, total, free = discounts(counts), defaultdict(float), defaultdict(float)
        for (*context, _), n in counts.items():
            total[tuple(context)] += n
            free[tuple(context)] += d[min(n, 3) - 1]

        def p(*gram):
            context, n = gram[:-1], counts.get(gram, 0)
            if not total[context]:
                return lower(*gram[1:])
            return ((n - d[min(n, 3) - 1] if n else 0) + free[context] * lower(*gram[1:])) / total[context]
        return p

    p1 = level({(z,): n for z, n in c1.items()}, lambda: 1 / (len(c1) + 1))
    p3 = level(c3, level(c2, p1))
    return lambda *gram: -math.log(p3(*gram))


def test_perplexities_agree_with_the_definition(spark, monkeypatch):
    unknown = ["the dog sat", "zzz \u0441\u043b\u043e\u0432\u0430 zzz", "mat mat mat"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*TEXTS, *unknown, TEXTS[1], None, "the dog sat"])],
                                 "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    fold = {r.text: r.k & 1 for r in docs.select("text", quality.text_keys(F.col("text"))[0].alias("k")).collect()}
    models = [brute_model([t for t in TEXTS if fold[t] != k]) for k in (0, 1)]

    def total(t):
        own = [0, 0, *quality.units(t).tolist()]
        return sum(models[fold[t]](*gram) for gram in zip(own, own[1:], own[2:])), len(own) - 2
    mean = sum(total(t)[0] for t in TEXTS) / sum(total(t)[1] for t in TEXTS)
    for block in (1, 20, 10_000):
        monkeypatch.setattr(quality, "BLOCK", block)
        for r in quality.classify(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect():
            cost, n = total(r.text or "") if r.text else (0, 0)
            if not n:
                assert r.perplexity is None and not r.kept
                continue
            assert math.isclose(r.perplexity, math.exp((cost + quality.PRIOR * mean) / (n + quality.PRIOR)), rel_tol=1e-9), r


def _rows(spark, texts):
    key1, key2 = quality.text_keys(F.col("text"))
    return spark.createDataFrame([(t, True) for t in texts], "text string, trusted boolean").select("*", key1.alias("key1"), key2.alias("key2"))


def test_perplexities_do_not_follow_the_number_of_frequent_trigrams(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*TEXTS, None, "the dog sat", "zzz", "ab" * 700])],
                                 "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    want = {r.doc_id: r.perplexity for r in quality.classify(docs, labels).collect()}
    for frequent, block in ((0, 2_000_000), (0, 1), (12, 20), (12, 2_000_000)):
        monkeypatch.setattr(quality, "FREQUENT", frequent)
        monkeypatch.setattr(quality, "BLOCK", block)
        for r in quality.classify(docs, labels).collect():
            assert (r.perplexity is None) == (want[r.doc_id] is None)
            assert r.perplexity is None or math.isclose(r.perplexity, want[r.doc_id], rel_tol=1e-9), r


def test_rows_per_text_do_not_follow_the_partitions(spark, monkeypatch):
    """Sums were handed on once per text and partition of the join."""
    rows = _rows(spark, [f"{t} {i}" for i in range(20) for t in TEXTS])
    costs = quality.trigram_costs(quality.trigram_counts(rows))
    made = []
    whole = quality.text_sums
    monkeypatch.setattr(quality, "text_sums", lambda joined: made.append(whole(joined.repartition(64))) or made[-1])
    assert quality.text_costs(rows, costs).count() == rows.count() and not made
    monkeypatch.setattr(quality, "FREQUENT", 20)
    (often, *_), rest = quality.frequent_costs(costs)
    assert 0 < len(often) <= 20 and rest.count() + len(often) == costs.count()
    assert quality.text_costs(rows, costs).count() == rows.count()
    rare = sum(len(set(quality.trigrams(r.text).tolist()) - set(often.tolist())) for r in rows.collect())
    assert made[0].count() <= rows.count() + rare


def test_sums_of_mixed_blocks(spark):
    """A batch that begins and ends with one block and holds others between gave their costs to it."""
    one = [(k, bytes(2), b"\x01", cost, None, None, None, None) for k, cost in ((7, 1.0), (8, 10.0), (7, 100.0))]
    joined = spark.createDataFrame(one, "block long, docs binary, times binary, cost double, doc int, n long, key1 long, key2 long").coalesce(1)
    assert {(r.block, r.doc, r.cost) for r in quality.text_sums(joined).collect()} == {(7, 0, 101.0), (8, 0, 10.0)}


def test_units():
    assert "".join(map(chr, quality.units("It's \n\t 12 中\U0001f600\u00a0x"))) == "It's 00 中\U0001f600 x"
    assert len(quality.units(None)) == len(quality.units(" \n")) == 0


def test_counts_beyond_a_byte(spark):
    docs = spark.createDataFrame([(1, "ab" * 700 + "c", "en"), (2, "ab" * 700 + "d", "en"), (3, "abc", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.perplexity for r in quality.classify(docs, labels).collect()}
    cost = brute_model(["abc"])
    for i, text in ((1, "ab" * 700 + "c"), (2, "ab" * 700 + "d"), (3, "abc")):
        own = [0, 0, *map(ord, text)]
        mean = sum(cost(*g) for g in zip([0, 0, 97, 98], [0, 97, 98], [97, 98, 99])) / 3
        want = (sum(cost(*g) for g in zip(own, own[1:], own[2:])) + quality.PRIOR * mean) / (len(text) + quality.PRIOR)
        assert math.isclose(got[i], math.exp(want), rel_tol=1e-9)


def test_held_out_junk_goes_and_clean_text_stays(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels.where("doc_id % 2 = 0"), min_trusted=10)
    pdf = got.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    rate = pdf.groupby("quality").kept.mean()
    assert rate[1] > 0.97 and rate[0] < 0.3
    assert got.count() == docs.count()


def test_edges(spark):
    clean = [(i, "plain words in a row, as people write them", "en", f"s{i}") for i in range(60)]
    odd = [(100, None, "en", "x"), (101, "", "en", "x"), (102, " \n\t", "en", "x"), (103, "zz", None, None), (None, "plain words", "en", "x"),
           (105, "plain words in a row, as people write them", "xx", "x"), (105, "plain words in a row, as people write them", "xx", "x")]
    docs = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(None, 1, 0), (7, None, None), (200, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert not any(got[i].kept for i in (100, 101, 102)) and got[100].perplexity is None
    assert got[105].kept and got[1].kept and got[7].kept
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 105").count() == 2
    assert quality.classify(docs.limit(0), labels).count() == 0
    none = quality.classify(docs, labels.limit(0))
    assert {r.doc_id for r in none.where("not kept").collect()} == {100, 101, 102}


def test_very_long_text():
    text = "word and sign, " * 100_000
    assert len(quality.trigrams(text)) == len(text)


def test_a_clean_language_without_labels_stays(spark):
    english = [(i, f"plain words in a row number {i}, as people write them", "en") for i in range(80)]
    other = [(1000 + i, f"\u0441\u043b\u043e\u0432\u0430 {i} \u0432 \u0440\u044f\u0434, \u043a\u0430\u043a \u0438\u0445 \u043f\u0438\u0448\u0443\u0442 \u043b\u044e\u0434\u0438", "ru") for i in range(40)]
    docs = spark.createDataFrame(english + other, "doc_id long, text string, lang string")
    for some in (0, 5):
        labels = spark.createDataFrame([(i, 1, 0) for i in [*range(80), *range(1000, 1000 + some)]],
                                       "doc_id long, quality int, toxic int")
        assert quality.classify(docs, labels).where("kept and lang = 'ru'").count() == 40
