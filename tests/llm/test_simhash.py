import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from veloframe.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_groups(rows):
    """doc_id -> smallest doc_id reachable, by comparing all pairs."""
    ids, fps = [i for i, _ in rows], [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return {(i, f"{f:016x}", least.get(find(k))) for k, (i, f) in enumerate(zip(ids, fps))}


def test_fingerprints_agree_with_a_plain_version():
    texts = [None, "", " \t\n", "One", "one two", "A b C", "a b c d", "x " * 700, "É é Ä b\x0bc\x1cd e", "a b c a b c a b c"]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_groups_agree_with_all_pairs(spark):
    base = [f"w{k % 37}x{k % 11} word{k}" for k in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (None, " ".join(base)), (3, None), (4, ""), (5, "Short text"),
            (5, "Short text"), (6, "short TEXT"), (None, "alone in the world")]
    rng = np.random.default_rng(3)
    for i in range(60):
        own = [f"v{x}" for x in rng.integers(0, 50, 120)]
        rows.append((100 + 2 * i, " ".join(own)))
        own[int(rng.integers(120))] = "changed"
        rows.append((101 + 2 * i, " ".join(own)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    want = brute_groups(rows)
    for block in (2, 2048):
        got = {tuple(r) for r in simhash.simhash_groups(docs, block=block).collect()}
        assert got == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert ids == sorted({c for i, _, c in want if i is not None and i == c})
    assert kept.where("doc_id is null").count() == 1  # the one whose group has no id


def test_links_of_every_distance(spark):
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(40):
        x = int(rng.integers(0, 1 << 63))
        fps.add(x)
        for n in (1, 2, 3, 4):
            y = x
            for b in rng.choice(64, n, replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    signed = sorted(simhash._signed(f) for f in fps)
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    for block in (3, 2048):
        label = {f: f for f in signed}

        def find(a):
            while label[a] != a:
                a = label[a]
            return a

        for r in simhash.links(classes, block).collect():
            label[find(r.a)] = find(r.b)
        for a in signed:
            for b in signed:
                if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                    assert find(a) == find(b)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0


def test_hot_text_is_one_class(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("the same text for all of them").alias("text"))
    assert {r.component_id for r in simhash.simhash_groups(docs).collect()} == {0}


def test_texts_that_share_an_id_and_names_that_clash(spark):
    a, b = ("one two three four five six", "quite other words stand in this text here")
    rows = [(1, a, 1), (1, b, 2), (1, a, 1), (2, a, 3), (None, b, 4), (None, "a third text without any number", 5), (3, None, 6), (4, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int").selectExpr("*", "_row as a", "_row as fp")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted(
        [(1, a, 1, 1, 1), (1, b, 2, 2, 2), (3, None, 6, 6, 6), (None, "a third text without any number", 5, 5, 5)], key=repr)
