from itertools import product

import numpy as np
import public_tokenizers
import pytest

from veloframe.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    pieces = [langid.MARK, langid.MARK + "t", "t", "h", "e", "th", "the", "he", langid.MARK + "the", "a"]
    number = {p: i for i, p in enumerate(pieces)}
    p = np.random.default_rng(0).dirichlet(np.ones(len(pieces) + 1), 3).T
    words = ["the", "t", "hat", "thethe", "zé"]
    got = langid.Lattice(words, langid.beginnings(number), len(number)).forward(p)[1]
    for w, own in zip(words, got):
        marked, total = langid.MARK + w, np.zeros(3)
        for cuts in product((False, True), repeat=len(marked) - 1):
            parts, at = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    parts.append(marked[at:k])
                    at = k
            parts.append(marked[at:])
            ids = [number.get(x, len(pieces) if len(x) == 1 else -1) for x in parts]
            if -1 not in ids:
                total += np.prod([p[i] for i in ids], axis=0)
        assert np.allclose(own, total)


def test_expected_uses_add_up():
    pieces = [langid.MARK, "a", "b", "ab", langid.MARK + "a"]
    number = {p: i for i, p in enumerate(pieces)}
    p = np.array([[0.3], [0.2], [0.2], [0.2], [0.1], [1e-7]])
    uses = langid.Lattice(["ab"], langid.beginnings(number), len(number)).expected(p, np.array([2.0]))
    ways = {(0, 1, 2): 0.3 * 0.2 * 0.2, (0, 3): 0.3 * 0.2, (4, 2): 0.1 * 0.2}
    total = sum(ways.values())
    want = np.zeros(6)
    for ids, v in ways.items():
        for i in ids:
            want[i] += 2 * v / total
    assert np.allclose(uses, want)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, *langid.fit(docs, PATH, train=60)


def test_held_out_accuracy(model):
    docs, languages, p = model
    got = langid.predict(docs, languages, p, PATH).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.98
    import zlib
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(got.doc_id, got.held_out))


def test_edges(spark, model):
    _, languages, p = model
    docs = spark.createDataFrame([(1, None, "en", "q"), (2, "", "en", "q"), (3, "123 !! _", "en", "q"), (None, "the of and", None, "q"),
                                  (5, "x" * 100_000, "en", "q"), (6, "Ω中", "en", "q")],
                                 "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.predict(docs, languages, p, PATH).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0.0 for i in (1, 2, 3))
    assert got[None].lang_pred == "en" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(docs.limit(0), PATH).count() == 0
    bare = docs.withColumn("lang", docs["lang"].substr(1, 0)).where("lang is null")
    assert all(r.lang_pred == "und" for r in langid.identify(bare, PATH).collect())


def test_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² ① 12"), (2, "½ the")], "doc_id long, text string")
    p = np.full((len(langid.vocabulary(PATH)) + 1, 1), 1e-4)
    assert [r.lang_pred for r in langid.predict(docs, ["en"], p, PATH).collect()] == ["und", "en"]
